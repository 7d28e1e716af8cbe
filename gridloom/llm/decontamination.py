"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once.

A text's words are the runs of ASCII letters and digits and of all characters
beyond ASCII, with A-Z lower-cased. A window is ``WINDOW`` consecutive words of an
item; an item with fewer words, but not none, is one window. The automaton holds the
distinct windows as strings " w1 w2 ... ", so that whole words match only, and finds
every occurrence in one pass over a document's normalised words. Hits are mapped back
to word numbers and to character offsets of the original text.

The windows are made and told apart by Spark. Those of one automaton come to the
driver and go to the tasks, up to ``PART`` characters; a larger benchmark is dealt
into as many parts as it needs, by the windows' hashes, and the documents pass one
automaton after the other with the hits so far beside them. Documents are never
shuffled, so no source, copy or hot passage makes a task larger than its input.

Defined cases: a null or empty text has no words, no hits and is not contaminated; an
item without words matches nothing; equal items and items with one id count once by
their id; an item whose id is null marks words but is not counted among the items,
having no id to report; repeated documents are judged each on its own; an empty
benchmark contaminates nothing, and empty documents give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm._common import LOWER, UPPER, Stage, bounded_batches, columns_of, lower_ascii, read

WINDOW = 10
#: Characters of the windows of one automaton: about 100 bytes each in a worker.
PART = 2_000_000
#: A word of a text whose A-Z are lower case already.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in the original text.
_ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of a text's words: A-Z in lower case, other ASCII than letters and digits a blank. Bytes of longer characters stay.
_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))

SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("first", "last", "start", "end")]))
_SPANS = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))

_BUILT: dict[str, tuple] = {}


def words(text: Column) -> Column:
    """Normalised words of a text; none for null."""
    return F.coalesce(F.regexp_extract_all(lower_ascii(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def windows(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Distinct (item, pattern) of all items."""
    w, size = F.col("w"), F.least(F.size("w"), F.lit(width))
    rows = items.select(items["item_id"].cast("string").alias("item"), words(items["text"]).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.size(w) - size + 1)
    cut = F.transform(starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice(w, i, size), " "), F.lit(" ")))
    return rows.select("item", F.explode(cut).alias("pattern")).distinct()


def _automaton(found) -> tuple:
    """The automaton of a broadcast list of (pattern, items), kept for the worker's next batches; others are let go."""
    if found.value[0] not in _BUILT:
        import ahocorasick

        _BUILT.clear()
        own = ahocorasick.Automaton()
        for n, (pattern, _) in enumerate(found.value[1]):
            own.add_word(pattern.encode().decode("latin-1"), (n, pattern.count(" ") - 1))
        if len(own):
            own.make_automaton()
        _BUILT[found.value[0]] = (own if len(own) else None, [items for _, items in found.value[1]])
    return _BUILT[found.value[0]]


def _offsets(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Word runs with their character offsets in the original text."""
    ends = [m.span() for m in _ORIGINAL.finditer(text)]
    return [{"first": a, "last": b, "start": ends[a][0], "end": ends[b][1]} for a, b in runs]


def scan_text(own, text: str, before: list[tuple[int, int]] = ()) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words (``own``: an automaton, None for no patterns), maximal runs of hit words (with the runs ``before``), and numbers of the patterns that occur."""
    found = text.encode("utf-8", "surrogatepass").translate(_BYTES).split()
    hits = list(own.iter((b" " + b" ".join(found) + b" ").decode("latin-1"))) if found and own is not None else []
    if not hits and not before:
        return len(found), [], set()
    marks = np.zeros(len(found) + 1, np.int64)
    for a, b in before:
        marks[a] += 1
        marks[b + 1] -= 1
    if hits:
        starts = np.cumsum([0, *(len(w) + 1 for w in found)])  # places of the blanks before each word and behind the last
        last = np.searchsorted(starts, [end for end, _ in hits]) - 1
        size = np.array([n for _, (_, n) in hits])
        np.add.at(marks, last - size + 1, 1)
        np.add.at(marks, last + 1, -1)
    hit = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
    cuts = np.flatnonzero(np.diff(hit) > 1)
    runs = list(zip(hit[np.r_[0, cuts + 1]].tolist(), hit[np.r_[cuts, len(hit) - 1]].tolist(), strict=True))
    return len(found), runs, {n for _, (n, _) in hits}


def _scan(found, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: the text, what is kept, and, behind an earlier automaton, its n_words, spans and items."""
    own, items = _automaton(found)
    for batch in batches:
        names = batch.schema.names
        old = names[-1] == "_items"
        counts, spans, ids = [], [], []
        earlier = zip(batch.column(len(names) - 2).to_pylist(), batch.column(len(names) - 1).to_pylist(), strict=True) if old else [([], [])] * batch.num_rows
        for text, (had, names_before) in zip(batch.column(0).to_pylist(), earlier, strict=True):
            n, runs, patterns = scan_text(own, text or "", [(s["first"], s["last"]) for s in had])
            counts.append(n)
            spans.append(_offsets(text, runs) if runs else [])
            ids.append(sorted({i for p in patterns for i in items[p]} | set(names_before)))
        kept = batch.columns[: len(names) - 3] if old else batch.columns
        yield pa.RecordBatch.from_arrays([*kept, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(ids, pa.list_(pa.string()))], names=[*names[: len(kept)], "_n_words", "_spans", "_items"])


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, keep: list[str], width: int = WINDOW, part: int = PART) -> DataFrame:
    """_text, the columns ``keep`` of ``docs``, and of each row _n_words, _spans (runs of hit words, with character offsets) and _items (ids of items with occurring windows)."""
    bounded_batches(spark)
    stage = Stage(spark, "decontamination")
    made = stage.write(windows(items, width).groupBy("pattern").agg(F.collect_set("item").alias("items")))
    size = made.agg(F.coalesce(F.sum(F.length("pattern") + F.lit(8) * F.size("items")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part))
    rows = docs.select(docs["text"].cast("string").alias("_text"), *columns_of(docs, *keep))
    for k in range(parts):
        own = made.where(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == k).select("pattern", "items").collect()
        found = spark.sparkContext.broadcast((f"{stage.base}/{k}", [(r.pattern, r.items) for r in own]))
        schema = T.StructType([f for f in rows.schema if f.name not in ("_n_words", "_spans", "_items")])
        schema = schema.add("_n_words", T.LongType()).add("_spans", SPANS).add("_items", T.ArrayType(T.StringType()))
        rows = rows.mapInArrow(partial(_scan, found), schema)
        if k < parts - 1:
            rows = stage.write(rows)
    return rows


def n_hit() -> Column:
    return F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, most: float = 0.0, width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` of whose words at most the part ``most`` is hit by an item."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    seen = scan(spark, plain.withColumn("text", plain[names[docs.columns.index("text")]]), items, names, width)
    return seen.where(n_hit() <= F.col("_n_words") * F.lit(float(most))).select(*names).toDF(*docs.columns)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = scan(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), ["doc_id"])
    hit = n_hit()
    return seen.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("_n_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), {WINDOW}) AS k FROM (SELECT item_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}'), []) AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS s FROM i)),
win_at AS (SELECT rn, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT rn, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT a.rn, a.k, a.s, win.item_id FROM win_at a JOIN win ON a.k = win.k AND a.win = win.win),
n AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT rn, k, s FROM hit)) GROUP BY rn),
t AS (SELECT rn, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hit GROUP BY rn)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n.n, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rn) LEFT JOIN t USING (rn)
"""
