"""Similarity join of shingle sets with adaptive multi-match prefixes.

Two sets of similarity t or more share at least ``need(n) = ceil(t n)`` tokens,
n being the size of either. Order all tokens in one way; then the first
``n - need(n) + m`` tokens of the one and of the other (their m-prefixes) have m
tokens in common at least, for any m, and if the two take different m, the
smaller of the two. A longer prefix thus asks for more matches.

1. A first join on hashes alone drops the documents that are like no other. Each
   document sends its prefix in hash order, ``FIRST`` of its size longer than the
   shortest, as packed key fragments by key bucket; a bucket tells which keys
   occur twice; documents with fewer such keys than their partners' shortest
   prefix asks for are out. Two to three bytes per token leave the scan. A key
   that a task has sent twice is shared and not sent again, so that a frequent
   one takes as much of its bucket as there are tasks, not documents.
2. The sets of the others (equal sets once) are written. Tokens are counted
   among them, and the counts order the tokens, rare ones first. Tokens that
   stand alone join nothing but use up the prefix, which drops more documents.
   Each document then chooses its m: its prefix tokens' posting lists are read,
   the candidates that m matches leave are at most the lists' sum over m, and the
   m of the least estimated cost is taken.
3. Candidates that share the matches asked for are verified on the whole sets.
   Only components are wanted, so in rounds each document is first tried against
   the most central document of its posting lists; what is linked is one
   component, and only pairs of different components are candidates later. The
   last round tries all pairs that are left, so that no link is lost.

Defined cases: null and empty texts have an empty set, no links and their own
doc_id as component; repeated rows are linked; a component without any doc_id
has none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import Stage, read, skewed_join
from gridloom.llm.components import components
from gridloom.llm.textkernel import Sent, Words, mix, text_slices

SHINGLE = 5
#: Similarity of a link, in percent.
PERCENT = 80
#: Part of a set by which the first prefix is longer than the shortest.
FIRST = 0.15
#: Keys of a bucket of the first join, about.
BUCKET_KEYS = 1_000_000
#: Estimated cost of a posting and of verifying a candidate, each in pairs of postings.
POSTING_COST = 2.0
VERIFY_COST = 20.0
#: Documents of a rare token at most.
RARE = 64
#: Documents that may be named in a broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 2_000_000
STAR_ROUNDS = 12
#: Rounds go on while so large a part of the tries links.
STAR_YIELD = 0.01
#: Documents that each document is tried against in a round.
TRIES = 3


def need(n: int | np.ndarray, percent: int = PERCENT):
    """Least number of common tokens of a set of n tokens and one like it."""
    return -(-percent * n // 100)


def shingle_sets(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's runs of ``size`` words; the whole sequence if shorter."""
    runs, _ = words.shingles(size)
    first, out = words.first, []
    for i, count in enumerate(words.counts.tolist()):
        low = first[i]
        if count >= size:
            found = np.sort(runs[low : low + count - size + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif count:
            whole = np.uint64(count)
            with np.errstate(over="ignore"):
                for h in words.hashes[low : low + count]:
                    whole = whole * np.uint64(0xD1342543DE82EF95) + h
            out.append(mix(np.array([whole ^ np.uint64(0x5851F42D4C957F2D)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for low, high, data, offsets in text_slices(batch, batch.schema.get_field_index("text")):
            yield low, high, batch.slice(low, high - low), shingle_sets(Words(data, offsets, True))


def digest(tokens: np.ndarray) -> bytes:
    return blake2b(tokens.tobytes(), digest_size=16).digest()


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, node of each row; the node is a digest of the set."""
    for _, _, part, sets in sets_of(batches):
        nodes = [digest(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.binary())], names=["doc_id", "n", "node"])


def first_prefix(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Length of the first prefix and the matches that it must have."""
    extra = lambda k: np.ceil(FIRST * k).astype(np.int64)
    return np.minimum(n, n - need(n, percent) + extra(n)), np.minimum(extra(n), extra(need(n, percent)))


def send_prefixes(buckets: int, percent: int):
    """Rows (bucket, unit, keys, owners) of the documents of a slice, a row (unit, owners) of keys known to be shared, and one row (unit, row keys, matches asked for)."""
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    low = np.uint64(32 - (buckets.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sent = TaskContext.get().partitionId() << 24, Sent()
        for _, _, part, sets in sets_of(batches):
            unit += 1
            n = np.array([len(s) for s in sets], np.int64)
            length, asked = first_prefix(n, percent)
            keys = np.concatenate([s[:k] for s, k in zip(sets, length.tolist(), strict=True)])
            owner = np.repeat(np.arange(len(sets), dtype=np.uint32), length)
            keys = mix(keys ^ np.uint64(0xA0761D6478BD642F))  # prefixes hold the least hashes; the buckets should be even
            order = np.argsort(keys)
            keys, owner = keys[order], owner[order]
            ask = sent.split(keys)
            shared = owner[~ask].tobytes()
            keys, owner = keys[ask], owner[ask]
            bounds = np.searchsorted(keys >> shift, np.arange(buckets + 1, dtype=np.uint64))
            short, owner = (keys >> low).astype(np.uint32), owner.astype(np.uint16 if len(sets) < 1 << 16 else np.uint32)
            filled = np.flatnonzero(np.diff(bounds)).tolist()
            bucket = [*filled, unit % buckets, unit % buckets]
            head = part.column("row_key").to_numpy().astype(np.int64).tobytes()
            payload = [short[bounds[b] : bounds[b + 1]].view(np.uint8).reshape(-1, 4).T.tobytes() for b in filled] + [None, head]
            owners = [owner[bounds[b] : bounds[b + 1]].astype(np.uint32).tobytes() if owner.dtype == np.uint32 else owner[bounds[b] : bounds[b + 1]].tobytes() for b in filled] + [shared, asked.astype(np.int32).tobytes()]
            wide = [owner.dtype == np.uint32] * len(filled) + [True, None]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket, pa.int32()), pa.array([unit] * len(bucket), pa.int64()), pa.array(payload, pa.binary()), pa.array(owners, pa.binary()), pa.array(wide, pa.bool_())],
                names=["bucket", "unit", "keys", "owners", "wide"],
            )

    return run


def shared_keys(table: pa.Table) -> pa.Table:
    """Of a bucket: for each unit the owners of keys that occur twice. Heads and owners of shared keys pass through."""
    rows = table.select(["unit", "keys", "owners", "wide"]).to_pylist()
    heads = [r for r in rows if r["wide"] is None or r["keys"] is None]
    rows = [r for r in rows if r["wide"] is not None and r["keys"] is not None]
    units, owners, wide = [r["unit"] for r in heads], [r["owners"] for r in heads], [r["wide"] for r in heads]
    head_keys = [r["keys"] for r in heads]
    if rows:
        parts = [np.ascontiguousarray(np.frombuffer(r["keys"], np.uint8).reshape(4, -1).T).view(np.uint32).ravel() for r in rows]
        keys = np.concatenate(parts)
        found = np.sort(keys)
        twice = np.unique(found[1:][found[1:] == found[:-1]])
        if len(twice):
            maybe = np.zeros(1 << 22, bool)
            maybe[twice >> np.uint32(10)] = True
            hit = np.flatnonzero(maybe[keys >> np.uint32(10)])
            at = np.searchsorted(twice, keys[hit])
            hit = hit[twice[np.minimum(at, len(twice) - 1)] == keys[hit]]
            bounds = np.searchsorted(hit, np.concatenate([[0], np.cumsum([len(p) for p in parts])]))
            start = 0
            for r, p, a, b in zip(rows, parts, bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    own = np.frombuffer(r["owners"], np.uint32 if r["wide"] else np.uint16)
                    units.append(r["unit"])
                    owners.append(own[hit[a:b] - start].tobytes())
                    wide.append(r["wide"])
                    head_keys.append(None)
                start += len(p)
    return pa.table({"unit": pa.array(units, pa.int64()), "keys": pa.array(head_keys, pa.binary()), "owners": pa.array(owners, pa.binary()), "wide": pa.array(wide, pa.bool_())})


def survivors_of_unit(table: pa.Table) -> pa.Table:
    rows = table.select(["keys", "owners", "wide"]).to_pylist()
    head = next(r for r in rows if r["wide"] is None)
    keys, asked = np.frombuffer(head["keys"], np.int64), np.frombuffer(head["owners"], np.int32)
    shared = np.zeros(len(keys), np.int64)
    for r in rows:
        if r["wide"] is not None:
            shared += np.bincount(np.frombuffer(r["owners"], np.uint32 if r["wide"] else np.uint16), minlength=len(keys))
    return pa.table({"s_key": pa.array(np.unique(keys[(shared >= asked) & (asked > 0)]), pa.int64())})


def emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, _, sets in sets_of(batches):
        full = [s for s in sets if len(s)]
        flat = np.concatenate(full).view(np.int64) if full else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in full])]).astype(np.int32)
        arrays = [pa.array([digest(s) for s in full], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
        yield pa.RecordBatch.from_arrays(arrays, names=["digest", "tokens"])


def within(n: int, alive: np.ndarray, least: np.ndarray, most: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """Tokens that a partner may have, and the largest size of a partner.

    A partner's size lies between ``need(n)`` and what u common tokens allow, u
    being the number of tokens that may be common: 100 u >= percent (n + size - u).
    A token whose list has no size between these bounds can not be common either,
    which lowers u; this is repeated until nothing changes.
    """
    common = need(n, percent)
    while True:
        u = int(alive.sum())
        high = min(100 * n // percent, u * (100 + percent) // percent - n)
        now = alive & (least <= high) & (most >= common)
        if now.sum() == u:
            return alive, high
        alive = now


POSTING = {"node": pa.int64(), "label": pa.int64(), "n": pa.int64(), "m": pa.int64(), "low": pa.int64(), "high": pa.int64(), "central": pa.float64(), "rare": pa.bool_(), "others": pa.int64(), "tokens": pa.list_(pa.int64())}


def choose_prefixes(percent: int, split: bool):
    """(node, label, n, tokens that occur elsewhere with what their lists hold) -> postings of documents that may have a partner.

    With ``split``, pairs are sought in two ways. A pair that shares a rare token
    (in at most ``RARE`` documents) meets in that token's list, so all rare
    tokens are posted. A pair that shares none has only the other tokens in
    common; so few of them may be left that no partner has a fitting size. In a
    large group of near copies this spares the documents set apart by their own
    edits from being paired with the whole group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in POSTING}

            def post(*row):
                for k, v in zip(POSTING, row, strict=True):
                    out[k].append(v)

            lists = batch.column("pairs")
            flat = lists.flatten()
            fields = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("df", "token", "least", "most")]
            bounds = (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist() if len(lists) else [0]
            heads = zip(*(batch.column(k).to_pylist() for k in ("node", "label", "n")), strict=True)
            for (node, label, n), start, stop in zip(heads, bounds[:-1], bounds[1:], strict=True):
                counts, tokens, least, most = (f[start:stop] for f in fields)
                order = np.lexsort((tokens, counts))
                counts, tokens, least, most = counts[order], tokens[order], least[order], most[order]
                common, central = need(n, percent), float(counts.sum()) / n
                alive, high = within(n, np.ones(len(tokens), bool), least, most, percent)
                if alive.sum() < common or high < common:
                    continue
                if split:
                    rare = alive & (counts <= RARE)
                    alive = alive & ~rare
                    if rare.any():
                        post(node, label, n, 1, common, high, central, True, int(alive.sum()), tokens[rare])
                    alive, high = within(n, alive, least, most, percent)
                    if alive.sum() < common or high < common:
                        continue
                m = np.arange(1, common + 1)
                length = np.maximum(0, m - common + len(tokens))  # of the part of the prefix that occurs elsewhere
                if (np.concatenate([[0], np.cumsum(alive)])[length] < m).any():  # some m asks for more matches than there can be
                    continue
                posted = np.concatenate([[0], np.cumsum((counts - 1) * alive)])[length]
                best = int(np.argmin(posted * (1 + VERIFY_COST / m) + POSTING_COST * length))
                chosen = tokens[: length[best]][alive[: length[best]]]
                post(node, label, n, int(m[best]), common, high, central, False, int(n - (n - common + m[best])), chosen)
            yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in POSTING.items()], names=[*POSTING])

    return run


def _semi(df: DataFrame, keys: DataFrame, count: int) -> DataFrame:
    keys = F.broadcast(keys) if count <= BROADCAST_ROWS else keys
    return df.join(keys, F.col("row_key") == F.col("s_key"), "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link."""
    one = sets.select(F.col("node").alias("a"), F.col("tokens").alias("of_a"))
    two = sets.select(F.col("node").alias("b"), F.col("tokens").alias("of_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * common >= percent * (F.size("of_a") + F.size("of_b") - common)).select("a", "b")


def labelled(df: DataFrame, labels: DataFrame | None) -> DataFrame:
    """With the component of each node so far; a node without links is its own."""
    if labels is None:
        return df.withColumn("label", F.col("node"))
    named = labels.select(F.col("node").alias("l_node"), "component")
    return df.join(named, F.col("node") == F.col("l_node"), "left").withColumn("label", F.coalesce("component", "node")).drop("l_node", "component")


def postings_of(stage: Stage, sets: DataFrame, labels: DataFrame | None, percent: int, split: bool) -> DataFrame:
    """Prefix tokens of the documents that may link to another component, as ``POSTING`` with one row per token.

    A token whose documents all are of one component stands alone as far as new links go.
    """
    tokens = labelled(sets, labels).select("node", "label", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    counted = tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df"), F.min("n").alias("least"), F.max("n").alias("most"), F.min("label").alias("l1"), F.max("label").alias("l2"))
    counted = counted.where("l1 <> l2").select(F.col("token").alias("c_token"), "df", "least", "most")
    known = tokens.join(counted, F.col("token") == F.col("c_token"))
    known = known.groupBy("node").agg(F.first("label").alias("label"), F.first("n").cast("long").alias("n"), F.collect_list(F.struct("token", "df", "least", "most")).alias("pairs"))
    schema = "node long, label long, n long, m long, low long, high long, central double, rare boolean, others long, tokens array<long>"
    return stage.write(known.mapInArrow(choose_prefixes(percent, split), schema).withColumn("token", F.explode("tokens")).drop("tokens"))


def star_links(spark: SparkSession, stage: Stage, sets: DataFrame, percent: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Links found by trying each document with central ones, and (node, component) of the linked nodes."""
    postings = postings_of(stage, sets, None, percent, False).drop("label")
    # a document that stands for its component: the nodes' labels so far
    links, labels = None, None
    for turn in range(STAR_ROUNDS):
        own = labelled(postings, labels)
        who = [F.col(c).alias(c) for c in ("n", "low", "high", "label", "node")]
        best = own.groupBy("token", "label").agg(F.max(F.struct(F.col("central").alias("rank"), *who)).alias("top"), F.max(F.struct(F.xxhash64("token", "node", F.lit(turn)).cast("double").alias("rank"), *who)).alias("any"))
        # the most central label of a token and, for its own documents, another one: two extremes, however many labels there are
        pair = F.struct("top", "any")
        two = best.groupBy("token").agg(F.max(pair).alias("most"), F.max(F.struct(F.xxhash64("label", F.lit(turn)).alias("by"), "top", "any")).alias("some"), F.min(pair).alias("least"))
        two = two.where(F.col("most.top.label") != F.col("least.top.label"))
        some = F.when(F.col("some.top.label") != F.col("most.top.label"), F.struct("some.top", "some.any")).otherwise(F.col("least"))
        two = two.select(F.col("token").alias("t_token"), "most", some.alias("other"))
        tried = own.join(two, F.col("token") == F.col("t_token"))
        lead = F.when(F.col("most.top.label") != F.col("label"), F.col("most")).otherwise(F.col("other"))
        tried = tried.select("node", "n", "low", "high", lead.alias("leads"))
        tried = tried.select("node", "n", "low", "high", F.explode(F.array("leads.top", "leads.any")).alias("lead"))
        tried = tried.where("n BETWEEN lead.low AND lead.high AND lead.n BETWEEN low AND high")
        pairs = tried.groupBy("node", F.col("lead.node").alias("other")).agg(F.count(F.lit(1)).alias("shared"))
        pairs = pairs.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("shared", "other")), False), 1, TRIES).alias("picks"))
        pairs = pairs.select(F.col("node").alias("a"), F.explode("picks.other").alias("b"))
        pairs = stage.write(pairs)
        fresh = stage.write(verified(pairs, sets, percent))
        found = fresh.count()
        if found:
            links = fresh if links is None else links.unionByName(fresh)
            labels = components(stage, links)
        if found < STAR_YIELD * pairs.count() or not found:
            break
    return links, labels


def all_pairs(stage: Stage, labels: DataFrame | None, sets: DataFrame, percent: int) -> DataFrame:
    """Verified links among the pairs of different components that share what they must.

    ``others`` is the number of tokens outside of what a posting lists: those
    behind the prefix, or those that are not rare. A pair has at most the shared
    listed tokens and the larger of these numbers in common.
    """
    own = postings_of(stage, sets, labels, percent, True)
    kept = ("node", "n", "m", "low", "high", "others", "label")
    left = own.select("token", "rare", *[F.col(c).alias(f"{c}_a") for c in kept])
    right = own.select(F.col("token").alias("r_token"), F.col("rare").alias("r_rare"), *[F.col(c).alias(f"{c}_b") for c in kept])
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    sizes = F.col("n_a").between(F.col("low_b"), F.col("high_b")) & F.col("n_b").between(F.col("low_a"), F.col("high_a"))
    on = (F.col("token") == F.col("r_token")) & (F.col("rare") == F.col("r_rare")) & (F.col("label_a") != F.col("label_b")) & first & sizes
    asked, most = F.least("m_a", "m_b"), F.greatest("others_a", "others_b")
    pairs = left.join(right, on).groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b"), "rare").agg(
        F.count(F.lit(1)).alias("shared"), F.first(asked).alias("asked"), F.first(most).alias("most"), F.first(F.col("n_a") + F.col("n_b")).alias("sizes"))
    bound = F.col("shared") + F.col("most")
    pairs = pairs.where((F.col("shared") >= F.col("asked")) & (100 * bound >= percent * (F.col("sizes") - bound))).select("a", "b").distinct()
    return stage.write(verified(pairs, sets, percent))


def similarity_join(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    stage = Stage(spark, "ngram-join")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    table = stage.write(rows.mapInArrow(describe, "doc_id long, n long, node binary"))
    total = table.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << max(4, int(np.ceil(np.log2(max(1, total / BUCKET_KEYS)))))
    keyed = rows.select(F.xxhash64("text").alias("row_key"), "text").where("text IS NOT NULL")
    sent = keyed.mapInArrow(send_prefixes(buckets, percent), "bucket int, unit long, keys binary, owners binary, wide boolean")
    shared = sent.groupBy("bucket").applyInArrow(shared_keys, "unit long, keys binary, owners binary, wide boolean")
    left = stage.write(shared.groupBy("unit").applyInArrow(survivors_of_unit, "s_key long").distinct())
    alive = _semi(keyed, left, left.count())
    sets = stage.write(alive.mapInArrow(emit_sets, "digest binary, tokens array<long>").dropDuplicates(["digest"]).withColumn("node", F.monotonically_increasing_id()))
    links, labels = star_links(spark, stage, sets, percent)
    more = all_pairs(stage, labels, sets, percent)
    if not more.isEmpty():
        labels = components(stage, more if links is None else links.unionByName(more))
    # classes of equal sets, their components and the components' smallest doc_id
    classes = table.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    group = F.col("node")
    if labels is not None:
        named = sets.select("node", "digest").join(labels.select(F.col("node").alias("l_node"), "component"), F.col("node") == F.col("l_node")).select(F.col("digest").alias("l_digest"), "component")
        classes = classes.join(named, F.col("node") == F.col("l_digest"), "left")
        group = F.when(F.col("component").isNull(), F.col("node")).otherwise(F.col("component").cast("string").cast("binary"))
    classes = stage.write(classes.select("node", "least", "rows", group.alias("group")))
    smallest = stage.write(classes.groupBy(F.col("group").alias("g_group")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("classes")))
    number = classes.agg(F.count(F.lit(1)), F.sum("rows")).first()
    found = skewed_join(classes.select("node", "rows", "group"), smallest, ("group", "g_group"), "classes", number[0])
    found = stage.write(found.select(F.col("node").alias("f_node"), "rows", "component_id"))
    stage.keep(table, found)
    out = skewed_join(table.where("n > 0").select("doc_id", "n", "node"), found, ("node", "f_node"), "rows", number[1] or 0)
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(table.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component does: the one whose doc_id names it.

    Of rows that repeat a doc_id one stays. Rows without doc_id stay, unless
    another row has the very same text; of those alike, one stays.
    """
    table = Stage(spark, "keep-one").write(similarity_join(spark, docs, percent))
    left = table.where("doc_id <> component_id").count()
    named = docs.where("doc_id IS NOT NULL")
    drop = table.where("doc_id <> component_id").select(F.col("doc_id").alias("d_doc")).distinct()
    again = table.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("a_doc"))
    many = again.count()
    if left <= BROADCAST_ROWS:
        drop = F.broadcast(drop)
    kept = named.join(drop, named["doc_id"] == F.col("d_doc"), "left_anti")
    if many:
        again = F.broadcast(again) if many <= BROADCAST_ROWS else again
        once = kept.join(again, kept["doc_id"] == F.col("a_doc"), "left_anti")
        kept = once.unionByName(kept.join(again, kept["doc_id"] == F.col("a_doc"), "left_semi").dropDuplicates(["doc_id"]))
    nameless = docs.where("doc_id IS NULL").dropDuplicates(["text"])
    names = named.select(F.col("text").alias("n_text")).distinct()
    return kept if table.where("doc_id IS NULL").isEmpty() else kept.unionByName(nameless.join(names, nameless["text"] == F.col("n_text"), "left_anti"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(spark, read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""
