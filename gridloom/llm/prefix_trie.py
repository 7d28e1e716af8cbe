"""Prefix trie of conversations by Patricia construction: only branch, end and leaf points are made, unary nodes are expanded at the end.

1. *Digests.* A node is a sequence of turns. Its key is a digest of the sums of its
   turns' digests, each salted with its depth (four sums of 32-bit parts of SHA-256), so
   all keys of a conversation come from one running sum and no text leaves the first
   shuffle.
2. *Sort.* Conversations are cut into blocks of ``BLOCK`` turns, keyed by the node that
   a block starts from, and sorted over the cluster by their keys. Where two neighbours
   part is a branch; where a conversation ends is an end or a leaf. No other points exist.
3. *Compressed tree.* Rows (conversation, point) give each point's members, smallest
   member, parent point and children by sums that are combined before they are shuffled.
   A subtree's saved tokens are a sum over its members: what a member has between the
   node and the place from which it is the smallest member of its own path, which is
   what it shares with a smaller one. A subtree's leaves are the members that are the
   smallest of a leaf. So no level of the tree waits for another.
4. *Expansion.* A unary node has the members of the next point below. It takes that
   point's figures, plus (members - 1) times the suffix sum of the edge from the node on.

A node with a third of all conversations is a partial sum as any other; joins by point
have one row on the other side, so its rows can be split. The ids of conversations that
end at one node are joined to chunks by the tasks that hold them sorted, and a node's
hash reads its chunks one by one. Turns of one conversation are numbered and summed in
a window of their own, which streams; a conversation is never one row.

Defined cases: turns are ordered by turn (null first), of equal ones by role and text;
null role or text is empty; repeated rows are turns each; rows whose conv_id is null
belong to no conversation; ``c - c % 100`` is SQL's (towards zero); an empty table has no
conversations and no nodes; conversations without rebuilt turns are members of the root
alone, which is a leaf if it has no children.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import Stage, bounded_batches, read

#: Turns of a block that is sorted as one row.
BLOCK = 64
#: A conversation takes its first turns from the first one of its group of so many ids, and fewer than so many turns.
GROUP, GRAFT = 100, 6
#: Characters of conversation ids in a row.
CHUNK = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
ROOT = ""


def turns(conversations: DataFrame) -> DataFrame:
    """c, i (from 1), t (digest of role and text), w (code points of the text) of each turn."""
    t = conversations
    role, text = (F.coalesce(t[n].cast("string"), F.lit("")) for n in ("role", "text"))
    rows = t.select(t["conv_id"].cast("long").alias("c"), t["turn"].alias("turn"), role.alias("role"), text.alias("text")).where(F.col("c").isNotNull())
    order = W.partitionBy("c").orderBy(F.asc_nulls_first("turn"), "role", "text")
    digest = F.unhex(F.sha2(F.concat(F.length("role"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    return rows.select("c", F.row_number().over(order).cast("long").alias("i"), digest.alias("t"), F.length("text").cast("long").alias("w"))


def plain(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations as they are: (c, m) with their lengths, and their turns (c, m, d, t, w)."""
    sizes = numbered.groupBy("c").agg(F.max("i").alias("m"))
    return sizes, numbered.join(sizes.withColumnRenamed("c", "s_c"), F.col("c") == F.col("s_c")).select("c", "m", F.col("i").alias("d"), "t", "w")


def grafted(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`plain`, with the first crc32(c) % ``GRAFT`` turns of each conversation those of the first one of its group."""
    h = F.crc32(F.col("c").cast("string").cast("binary")) % GRAFT
    sizes = numbered.groupBy("c").agg(F.max("i").alias("n")).select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % GROUP).alias("base"))
    bases = sizes.where(F.col("c") % GROUP == 0).select(F.col("c").alias("b"), F.least("n", F.lit(GRAFT)).alias("b_n"))
    k = F.least(F.col("h"), F.coalesce("b_n", F.lit(0).cast("long")))
    lens = sizes.join(bases, F.col("base") == F.col("b"), "left").select("c", "h", "base", k.alias("k"), (k + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))).alias("m"))
    shift = lens.select(F.col("c").alias("l_c"), "h", "k", "m")
    own = numbered.join(shift, (F.col("c") == F.col("l_c")) & (F.col("i") > F.col("h"))).select("c", "m", (F.col("i") - F.col("h") + F.col("k")).alias("d"), "t", "w")
    first = numbered.where((F.col("c") % GROUP == 0) & (F.col("i") < GRAFT)).select(F.col("c").alias("b"), F.col("i").alias("d"), "t", "w")
    lent = lens.where("k > 0").join(first, (F.col("base") == F.col("b")) & (F.col("d") <= F.col("k"))).select("c", "m", "d", "t", "w")
    return lens.select("c", "m"), own.unionByName(lent)


def keyed(paths: DataFrame) -> DataFrame:
    """c, m, d, key, prev (key of the node above), cum (code points of the first d turns), w."""
    hexed = F.sha2(F.concat(F.col("d").cast("string"), F.lit(":"), F.hex("t")).cast("binary"), 256)
    parts = [F.conv(F.substring(hexed, 8 * k + 1, 8), 16, 10).cast("long").alias(f"u{k}") for k in range(4)]
    own = W.partitionBy("c").orderBy("d")
    down = own.rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = [F.sum(f"u{k}").over(down).cast("string") for k in range(4)]
    key = F.substring(F.sha2(F.concat_ws(".", F.col("d").cast("string"), *sums).cast("binary"), 256), 1, 32)
    rows = paths.select("c", "m", "d", "w", *parts).select("c", "m", "d", "w", key.alias("key"), F.sum("w").over(down).alias("cum"))
    return rows.withColumn("prev", F.coalesce(F.lag("key").over(own), F.lit(ROOT)))


def _common(a: Column, b: Column) -> Column:
    """Length of the common prefix of two arrays."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differ == 0, F.size(a)).otherwise((differ - 1).cast("int"))


def branches(stage: Stage, rows: DataFrame, parts: int) -> DataFrame:
    """Keys of the nodes at which two neighbours in the sorted order part."""
    block = rows.groupBy("c", F.floor((F.col("d") - 1) / BLOCK).alias("r")).agg(F.sort_array(F.collect_list(F.struct("d", "key", "prev"))).alias("seq"))
    block = block.select("c", F.col("seq")[0]["prev"].alias("start"), F.transform("seq", lambda x: x["key"]).alias("seq"))
    dealt = stage.write(block.repartitionByRange(parts, "start", "seq", "c").withColumn("part", F.spark_partition_id()))
    own = W.partitionBy("part").orderBy("start", "seq", "c")
    pairs = dealt.select("part", "start", "seq", F.lag(F.struct("start", "seq")).over(own).alias("before"))
    # one row per part: its last block is the neighbour of the next part's first
    last = dealt.groupBy("part").agg(F.max(F.struct("start", "seq", "c")).alias("last"))
    last = last.select(F.col("part").alias("l_part"), F.lag(F.struct("last.start", "last.seq")).over(W.orderBy("part")).alias("edge"))
    pairs = pairs.join(F.broadcast(last), F.col("part") == F.col("l_part")).withColumn("before", F.coalesce("before", "edge")).where(F.col("before.start") == F.col("start"))
    pairs = pairs.withColumn("same", _common(F.col("before.seq"), F.col("seq"))).where((F.col("same") < F.size("before.seq")) & (F.col("same") < F.size("seq")))
    return pairs.select(F.when(F.col("same") == 0, F.col("start")).otherwise(F.get("seq", F.col("same") - 1)).alias("key"))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, ids): runs of rows (key, c) with one key as comma-joined ids."""
    key, first, ids, held, out = None, None, [], 0, []
    for batch in batches:
        for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if ids and (k != key or held > CHUNK):
                out.append((key, first, ",".join(ids)))
                ids, held = [], 0
            if not ids:
                key, first = k, c
            ids.append(str(c))
            held += len(ids[-1]) + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names=["key", "first", "ids"])
            out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["key", "first", "ids"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha) of the chunks (key, first, ids) in their order; one hash is open at a time."""
    key, state = None, None
    for batch in batches:
        keys, shas = [], []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if k == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                keys.append(key)
                shas.append(state.hexdigest())
            key, state = k, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], names=["key", "sha"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "sha"])


def ends_of(ends: DataFrame) -> DataFrame:
    """(key, sha): SHA-256 of the ids c, ascending and comma-joined, of each key of rows (key, c)."""
    chunks = ends.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c").mapInArrow(_chunks, "key string, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_hashes, "key string, sha string")


def trie(spark: SparkSession, sizes: DataFrame, paths: DataFrame) -> DataFrame:
    """One row per node of the conversations (c, m) with the turns (c, m, d, t, w), m a conversation's number of turns."""
    bounded_batches(spark)
    stage = Stage(spark, "trie")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = stage.write(sizes)
    rows = stage.write(keyed(paths))
    # the points: branches, ends and leaves
    ends = rows.where("d = m").select("key")
    points = branches(stage, rows, parts).where(F.col("key") != ROOT).unionByName(ends).distinct().withColumnRenamed("key", "p_key")
    at = rows.join(points, F.col("key") == F.col("p_key")).select("c", "m", "d", "key", "cum", "w")
    own = W.partitionBy("c").orderBy("d")
    above = F.lag(F.struct("key", "d", "cum")).over(own)
    at = at.withColumn("q", F.coalesce(above, F.struct(F.lit(ROOT).alias("key"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("cum"))))
    at = stage.write(at.select("c", "m", "d", "key", "cum", "w", F.col("q.key").alias("q_key"), F.col("q.d").alias("q_d"), F.col("q.cum").alias("q_cum")))
    # the compressed tree
    made = at.groupBy("key").agg(F.min("c").alias("conv"), F.count("*").alias("n"), F.count_if(F.col("d") == F.col("m")).alias("ends"), F.max("d").alias("d"), F.max("q_key").alias("q_key"), F.max("q_d").alias("q_d"))
    made = stage.write(made)
    told = at.join(made.select(F.col("key").alias("m_key"), "conv", (F.col("ends") == F.col("n")).alias("leaf")), F.col("key") == F.col("m_key"))
    smallest = F.col("conv") == F.col("c")
    leaf = F.max((smallest & F.col("leaf") & (F.col("d") == F.col("m"))).cast("long"))
    shared = F.coalesce(F.min(F.when(smallest, F.col("q_cum"))), F.max("cum"))  # code points above the place from which c is the smallest member
    convs = stage.write(told.groupBy("c").agg(shared.alias("shared"), leaf.alias("leaf")))
    apart = F.greatest(F.col("shared") - (F.col("cum") - F.col("w")), F.lit(0).cast("long"))
    sums = at.join(convs.withColumnRenamed("c", "v_c"), F.col("c") == F.col("v_c")).groupBy("key").agg(F.sum(apart).alias("saved"), F.sum("leaf").alias("n_leaves")).withColumnRenamed("key", "s_key")
    kids = made.groupBy(F.col("q_key").alias("k_key")).agg(F.count("*").alias("n_children"))
    hashed = ends_of(rows.where("d = m").select("key", "c")).select(F.col("key").alias("h_key"), "sha")
    root = _root(sizes, convs, made, ends_of(sizes.where("m = 0").select(F.lit(ROOT).alias("key"), "c")))
    root = stage.write(root)
    full = made.join(sums, F.col("key") == F.col("s_key")).join(kids, F.col("key") == F.col("k_key"), "left").join(hashed, F.col("key") == F.col("h_key"), "left")
    full = stage.write(full.select("key", "conv", "n", "d", "q_key", "q_d", "saved", "n_leaves", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.coalesce("sha", F.lit(EMPTY)).alias("sha")))
    upper = full.select(F.col("key").alias("u_key"), F.col("conv").alias("q_conv"))
    edges = full.join(upper, F.col("q_key") == F.col("u_key"), "left").join(F.broadcast(root.select(F.col("conv_id").alias("r_conv")))).withColumn("q_conv", F.coalesce("q_conv", "r_conv"))
    # the unary nodes, each on the path of its smallest member
    edge = edges.select(F.col("conv").alias("e_c"), F.col("d").alias("e_d"), F.struct("n", "d", "q_d", "q_conv", "saved", "n_leaves", "n_children", "sha").alias("p"))
    on = (F.col("c") == F.col("e_c")) & (F.col("d") == F.col("e_d"))
    before = (F.col("cum") - F.col("w")).alias("before")
    path = rows.select("c", "d", before).join(edge, on, "left")
    up = W.partitionBy("c").orderBy(F.desc("d")).rowsBetween(W.unboundedPreceding, W.currentRow)
    path = path.select("c", "d", "before", F.last(F.when(F.col("p").isNotNull(), F.struct("p", F.col("before").alias("end"))), True).over(up).alias("e")).where(F.col("d") > F.col("e.p.q_d"))
    p, here = F.col("e.p"), F.col("d") == F.col("e.p.d")
    nodes = path.select(
        F.col("c").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") - 1 == p["q_d"], p["q_conv"]).otherwise(F.col("c")).alias("parent_conv_id"), p["n"].alias("n_convs"),
        F.when(here, p["n_children"]).otherwise(1).alias("n_children"), p["n_leaves"].alias("n_leaves"),
        (p["saved"] + (p["n"] - 1) * (F.col("e.end") - F.col("before"))).alias("saved_tokens"), F.when(here, p["sha"]).otherwise(EMPTY).alias("ends_sha256"),
    )
    return nodes.unionByName(root)


def _root(sizes: DataFrame, convs: DataFrame, made: DataFrame, hashed: DataFrame) -> DataFrame:
    """The node of depth 0; no row without conversations."""
    zero = F.lit(0).cast("long")
    all_ = sizes.agg(F.min("c").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    below = convs.agg(F.coalesce(F.sum("shared"), zero).alias("saved_tokens"), F.coalesce(F.sum("leaf"), zero).alias("leaves"))
    kids = made.where(F.col("q_key") == ROOT).agg(F.count("*").alias("n_children"))
    sha = hashed.agg(F.coalesce(F.max("sha"), F.lit(EMPTY)).alias("ends_sha256"))
    one = all_.join(F.broadcast(below)).join(F.broadcast(kids)).join(F.broadcast(sha))  # one row each
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("leaves")).alias("n_leaves")
    return one.select("conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", leaves, "saved_tokens", "ends_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = Stage(spark, "turns").write(turns(read(spark, sf_dir, "conversations")))
    return trie(spark, *grafted(numbered))


#: CRC-32 of the decimal id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)),
 lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""

ORACLE = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, max(i) AS n, {_CRC} % {GRAFT} AS h FROM t GROUP BY c),
k AS (SELECT l.c, l.h, l.n, l.c - l.c % {GROUP} AS base, least(l.h, coalesce(b.n, 0)) AS k FROM l LEFT JOIN l b ON b.c = l.c - l.c % {GROUP}),
r AS (SELECT k.c, t.i - k.h + k.k AS d, role, txt FROM k JOIN t ON t.c = k.c AND t.i > k.h UNION ALL SELECT k.c, t.i, role, txt FROM k JOIN t ON t.c = k.base AND t.i <= k.k),
p AS (SELECT c, d, txt, string_agg(sha256(len(role) || ':' || role || txt), '') OVER (PARTITION BY c ORDER BY d) AS path FROM r UNION ALL SELECT c, 0, '', '' FROM l),
m AS (SELECT c, max(d) AS m FROM p GROUP BY c),
node AS (SELECT d, path, min(p.c) AS conv, count(*) AS n, any_value(length(txt)) AS w, coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (WHERE d = m.m), '') AS ends FROM p JOIN m USING (c) GROUP BY d, path),
up AS (SELECT u.conv, u.d, u.n, u.w, a.conv AS a_conv, a.d AS a_d FROM node u JOIN p ON p.c = u.conv AND p.d <= u.d JOIN node a ON a.d = p.d AND a.path = p.path),
kids AS (SELECT a_conv, a_d, count(*) AS kids FROM up WHERE a_d = d - 1 GROUP BY ALL),
agg AS (SELECT up.a_conv, up.a_d, count_if(kids.kids IS NULL) AS leaves, sum((n - 1) * w) AS saved FROM up LEFT JOIN kids ON kids.a_conv = up.conv AND kids.a_d = up.d GROUP BY ALL),
par AS (SELECT conv, d, a_conv FROM up WHERE a_d = d - 1)
SELECT node.conv AS conv_id, node.d::BIGINT AS depth, par.a_conv AS parent_conv_id, node.n AS n_convs, coalesce(kids.kids, 0)::BIGINT AS n_children, agg.leaves::BIGINT AS n_leaves, agg.saved::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node LEFT JOIN par ON par.conv = node.conv AND par.d = node.d LEFT JOIN kids ON kids.a_conv = node.conv AND kids.a_d = node.d JOIN agg ON agg.a_conv = node.conv AND agg.a_d = node.d
"""
