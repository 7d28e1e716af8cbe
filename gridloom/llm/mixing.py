"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``rate = target / source size`` copies.
The expected copies are prefix-summed in the order of (size, doc_id), one offset
in [0, 1) that depends only on the seed and the source is added, and a document
is emitted once for each integer boundary that its part of the sum crosses.
Neighbours in that order have like sizes, so the words taken miss the target by
a few documents' size at most.

The prefix sum never gathers a source in one task: documents are counted in
blocks (source, size class, and in a large class size and range of doc_id), the block table is prefix-summed, and only a
block's own documents are numbered together. A block holds about
``BLOCK_ROWS`` documents, whatever the size of the source.

Defined cases: a null text has size 0; a null source is a source of its own,
after all others; repeated rows count each on its own; an empty table gives an
empty result; columns other than doc_id, text and source are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from gridloom.llm._common import Stage, read

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
BLOCK_ROWS = 100_000
#: Ranges of doc_id that the rows of one large size are cut into.
PARTS = 200
#: Rows of the table of copies that may be broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> target: weights repeat over the sources in order, capped at ``cap`` sizes.

    The excess over the caps is reshared by weight until no target is above its
    cap: sources leave the sharing in the order of cap / weight, and the first
    share that its source can hold is the final one. The table has one row for
    each source.
    """
    at = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w).cast("double") for w in weights]), (F.pmod(at - 1, F.lit(len(weights))) + 1).cast("int"))
    capped = sources.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("cap"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    run = capped.withColumns({
        "all_size": F.sum("source_size").over(W.partitionBy()),
        "before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "rest": F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    share = (F.col("all_size") - F.col("before")) / F.col("rest")
    run = run.withColumn("share", F.when(share * F.col("weight") <= F.col("cap"), share))
    final = F.max("share").over(W.partitionBy())
    held = F.when(F.col("share").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("cap").cast("double"), final * F.col("weight")))
    return run.select("source", "source_size", held.alias("target"))


def offset(source: Column, seed: str = SEED) -> Column:
    """In [0, 1): the same for each run, from the first 32 bits of an MD5."""
    key = F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("\x00null")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED, carry_text: bool = False) -> DataFrame:
    """Columns of ``docs`` (text only with ``carry_text``), size, source_size, target, copies and taken."""
    stage = Stage(spark, "mixing")
    sized = docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"))
    sized = stage.write(sized)
    cls = F.floor(F.log2(F.col("size") + 1) * 8).cast("int")
    classes = sized.groupBy("source", cls.alias("cls")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    sources = classes.groupBy("source").agg(F.sum("words").alias("source_size"))
    rates = targets(sources, weights, cap).withColumn("rate", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    salts = classes.select("source", "cls", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("salts"))

    def joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        named = right.select(*[F.col(k).alias(f"r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
        on = [left[k].eqNullSafe(named[f"r_{k}"]) for k in keys]
        return left.join(named, on, "left").drop(*[f"r_{k}" for k in keys])

    # a large class is cut by size, a large size by ranges of doc_id: the order is (size, doc_id) at any size
    blocked = joined(sized.withColumn("cls", cls), salts, ["source", "cls"])
    blocked = blocked.withColumn("sub", F.when(F.col("salts") > 1, F.col("size")).otherwise(F.lit(0)).cast("long"))
    cuts = blocked.where("salts > 1").groupBy("source", "sub").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("doc_id", [i / PARTS for i in range(1, PARTS)]).alias("cuts"))
    cuts = cuts.where(F.col("n") > BLOCK_ROWS).select("source", "sub", "cuts")
    blocked = joined(blocked, cuts, ["source", "sub"])
    salt = F.coalesce(F.expr("CASE WHEN salts > 1 AND cuts IS NOT NULL THEN size(filter(cuts, c -> c < doc_id)) END"), F.lit(0))
    blocked = blocked.withColumn("salt", salt).drop("salts", "cuts")
    before = F.sum("n").over(W.partitionBy("source").orderBy("cls", "sub", "salt").rowsBetween(W.unboundedPreceding, -1))
    blocks = blocked.groupBy("source", "cls", "sub", "salt").agg(F.count(F.lit(1)).alias("n"))
    blocks = blocks.select("source", "cls", "sub", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = joined(blocked, blocks, ["source", "cls", "sub", "salt"])
    rank = F.col("before") + F.row_number().over(W.partitionBy("source", "cls", "sub", "salt").orderBy("size", "doc_id"))
    ranked = joined(ranked.withColumn("rank", rank), rates, ["source"])
    start = offset(F.col("source"), seed)
    copies = F.floor(start + F.col("rate") * F.col("rank")) - F.floor(start + F.col("rate") * (F.col("rank") - 1))
    copies = F.least(copies, F.lit(cap)).cast("long")
    out = ranked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mix(spark: SparkSession, docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as it was sampled, with its own columns.

    Copies are assigned to documents by (doc_id, source, size); rows that repeat
    in all three share their copies evenly, in the order of a digest of the text
    and a hash of the other columns, so that reruns agree.
    """
    taken = sample(spark, docs, weights, cap, seed)
    chosen = taken.groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("m_copies"), F.count(F.lit(1)).alias("m_rows"))
    chosen = chosen.where("m_copies > 0").select(F.col("doc_id").alias("m_doc"), F.col("source").alias("m_source"), F.col("size").alias("m_size"), "m_copies", "m_rows")
    chosen = Stage(spark, "mix").write(chosen)
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    keyed = docs.withColumn("m_words", word_count(docs["text"]))
    on = keyed["doc_id"].eqNullSafe(chosen["m_doc"]) & keyed["source"].eqNullSafe(chosen["m_source"]) & (keyed["m_words"] == chosen["m_size"])
    found = keyed.join(chosen, on)
    own = [keyed[c] for c in docs.columns]
    times = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n))
    single = found.where("m_rows = 1").select(*own, times(F.col("m_copies")).alias("m_copy"))
    others = [docs[f.name] for f in docs.schema if f.name != "text" and not isinstance(f.dataType, (MapType, VariantType))]
    order = (F.md5(docs["text"].cast("binary")), F.xxhash64(*others))
    nth = F.row_number().over(W.partitionBy("m_doc", "m_source", "m_size").orderBy(*order))
    share = F.floor((F.col("m_copies") * F.col("m_nth")) / F.col("m_rows")) - F.floor((F.col("m_copies") * (F.col("m_nth") - 1)) / F.col("m_rows"))
    several = found.where("m_rows > 1").withColumn("m_nth", nth).withColumn("m_times", share).where("m_times > 0").select(*own, times(F.col("m_times")).alias("m_copy"))
    return single.unionByName(several).drop("m_copy") if len(set(docs.columns)) == len(docs.columns) else single.union(several).drop("m_copy")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sample(spark, read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 3 * source_size AS cap,
    CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight
  FROM sources
), run AS (
  SELECT *, sum(source_size) OVER () AS all_size,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed
), shared AS (
  SELECT *, CASE WHEN (all_size - before) / rest * weight <= cap THEN (all_size - before) / rest END AS share FROM run
), targets AS (
  SELECT source, source_size,
    CASE WHEN share IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), max(share) OVER () * weight) END AS target
  FROM shared
), ranked AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0.0 ELSE t.target / t.source_size END AS rate,
    row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) AS rank,
    CAST(('0x' || substr(md5('mix-1:' || coalesce(s.source, chr(0) || 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copied AS (
  SELECT doc_id, size, source_size, target,
    CAST(least(floor(start + rate * rank) - floor(start + rate * (rank - 1)), 3) AS BIGINT) AS copies
  FROM ranked
)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""
