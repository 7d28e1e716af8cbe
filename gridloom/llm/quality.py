"""Quality rules: fixed counts plus a hashed n-gram logistic regression.

Features are three families of hashed n-grams, each a distribution over its
buckets: words, pairs of words, and runs of four characters. A text's score is the sum of the
families' mean weights, which one gather and one segment sum over an Arrow batch
give. The model is fitted on the driver from at most ``SAMPLE`` labelled rows,
chosen by a hash of doc_id; on a fifth of them that took no part in the fit a
logistic curve is fitted that makes the score a probability. Of fewer than
``FEW`` rows each fifth is scored by a fit to the others, and the curve is fitted
on all. Verdicts compare it
with the fixed ``THRESHOLD``.

Defined cases: a null text has no words and fails the base rule; without any
labelled row of both kinds the method keeps all; labels that are null are
ignored, and of several labels of a document the smallest counts; repeated rows
are judged each on its own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import bounded_batches, read
from gridloom.llm.textkernel import Words, mix, span_hashes, text_slices

SAMPLE = 1_500
FEW = 500
#: Bytes of the sample's texts that the fit on the driver looks at together.
FIT_SPAN = 1 << 17
BUCKETS = 1 << 16
FAMILIES = 3
THRESHOLD = 0.25
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
RESULT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, bound: int = SAMPLE, only=None) -> list:
    """At most ``bound`` rows (doc_id, text, label) by a hash of doc_id, in the order of doc_id."""
    known = labels.select(labels["doc_id"].alias("l_doc"), labels[column].cast("int").alias("label")).where("l_doc IS NOT NULL AND label IN (0, 1)")
    if only is not None:
        known = known.where(only("l_doc"))
    known = known.groupBy("l_doc").agg(F.min("label").alias("label"))
    known = known.orderBy(F.xxhash64("l_doc"), "l_doc").limit(bound)
    found = docs.join(F.broadcast(known), docs["doc_id"] == F.col("l_doc")).select(docs["doc_id"], docs["text"], "label").limit(2 * bound)
    return sorted(found.collect(), key=lambda r: (r["doc_id"], r["text"] or ""))


def character_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of four characters within its text."""
    starts = np.flatnonzero((words.data & 0xC0) != 0x80)
    ends = np.append(starts, len(words.data))
    low, high = starts[: max(0, len(starts) - 3)], ends[4 : 4 + max(0, len(starts) - 3)]
    text = np.searchsorted(words.offsets, low, "right") - 1
    inside = high <= words.offsets[1:][text] if len(low) else np.zeros(0, bool)
    low, high, text = low[inside], high[inside], text[inside]
    return span_hashes(words.data, words.eight, low, high), text


def buckets(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text) of each n-gram by family; words are taken as they are written."""
    pairs, whole = words.shingles(2)
    of_word = words.text_of_words()
    grams, of_gram = character_grams(words)
    shift = np.uint64(48)
    return [
        ((words.hashes >> shift).astype(np.int64), of_word),
        ((pairs[whole] >> shift).astype(np.int64), of_word[whole]),
        ((grams >> shift).astype(np.int64), of_gram),
    ]


def family_means(words: Words, weights: np.ndarray) -> np.ndarray:
    n = len(words.counts)
    total = np.zeros(n)
    for own, (at, text) in zip(weights, buckets(words), strict=True):
        total += np.bincount(text, own[at], n) / np.maximum(np.bincount(text, minlength=n), 1)
    return total


def fit(texts: list[str], labels: list[int], rounds: int = 120) -> dict | None:
    """Weights and calibration, or None where the labels are all alike."""
    y = np.asarray(labels, float)
    if len(set(labels)) < 2:
        return None
    n, m = len(texts), FAMILIES * BUCKETS
    #: (row, column, value) of the texts of a slice; what is computed from them takes a slice's memory and not the sample's
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    array = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(texts, pa.string())], names=["i", "t"])
    for low, _, data, offsets in text_slices(array, span=FIT_SPAN):
        words, own = Words(data, offsets, False), []
        for family, (at, text) in enumerate(buckets(words)):
            size = np.bincount(text, minlength=len(words.counts))
            key, count = np.unique(text * BUCKETS + at, return_counts=True)
            own.append(((key // BUCKETS + low).astype(np.int32), (key % BUCKETS + family * BUCKETS).astype(np.int32), (count / size[key // BUCKETS]).astype(np.float32)))
        parts.append(tuple(np.concatenate(x) for x in zip(*own, strict=True)))
    square = np.zeros(m)
    for _, col, value in parts:
        np.add.at(square, col, value * value)
    scale = 1 / np.sqrt(square / n + 1e-7)  # rare buckets weigh no more than common ones
    most = np.minimum(scale, 60.0)

    def scores(w: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for row, col, value in parts:
            out += np.bincount(row, value * most[col] * w[col], n)  # a row is in one part
        return out

    def slopes(error: np.ndarray) -> np.ndarray:
        out = np.zeros(m)
        for row, col, value in parts:
            np.add.at(out, col, value * most[col] * error[row])
        return out

    def descend(own: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Weights and bias fitted on the rows ``own``, and the score of every row."""
        share = np.where(y == 1, 0.5 / max(y[own].sum(), 1), 0.5 / max((1 - y[own]).sum(), 1)) * own
        w, b = np.zeros(m), 0.0
        first, second = np.zeros(m + 1), np.zeros(m + 1)
        for step in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.clip(scores(w) + b, -30, 30)))
            error = (p - y) * share
            slope = np.append(slopes(error) + 1e-4 * w, error.sum())
            first = 0.9 * first + 0.1 * slope
            second = 0.99 * second + 0.01 * slope * slope
            move = 0.05 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
            w, b = w - move[:-1], b - move[-1]
        return w, b, scores(w) + b

    part = mix(np.arange(n, dtype=np.uint64)) % np.uint64(5)
    both = lambda rows: len({*y[rows]}) == 2
    held, test = np.zeros(n), np.zeros(n, bool)
    for k in range(5 if n < FEW else 1):
        fold = part == k
        if both(~fold) and both(fold):
            w, b, score = descend(~fold)
            held[fold], test[fold] = score[fold], True
    if n < FEW or not test.any():
        w, b, score = descend(np.ones(n, bool))
        held, test = (held, test) if test.any() else (score, np.ones(n, bool))
    slope, level = calibrate(held[test], y[test])
    weights = (w * np.minimum(scale, 60.0)).reshape(FAMILIES, BUCKETS)
    return {"weights": weights.astype(np.float32), "bias": b, "slope": slope, "level": level}


def calibrate(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and level of the logistic curve of least loss, with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    goal = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = score.std() or 1.0
    x, a, b = score / scale, 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * x).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        move = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-9:
            break
    return float(a / scale), float(b)


def base_counts(words: Words) -> dict[str, np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    data, n = words.data, len(words.counts)
    inner = words.places_by_text(np.flatnonzero((data & 0xC0) == 0x80))  # bytes of a character but its first; none is a space
    word_bytes = np.bincount(words.text_of_words(), words.ends - words.starts, n).astype(np.int64)
    out = {"word_chars": word_bytes - inner, "n_symbols": words.places_by_text(np.flatnonzero(_SYMBOLS[data]))}
    # lines that hold a word, by the words' place among the line ends
    line_ends = np.unique(np.concatenate([np.flatnonzero(data == 10), words.offsets[1:]]))
    at = np.searchsorted(line_ends, words.starts, "right")  # a word's line ends at the first end past its start
    lines, first_word = np.unique(at, return_index=True)
    of_text = words.text_of_words()
    text = of_text[first_word]
    high = line_ends[lines]
    low = np.where(lines > 0, line_ends[np.maximum(lines - 1, 0)], 0)
    low = np.where((low < len(data)) & (data[np.minimum(low, max(len(data) - 1, 0))] == 10) & (lines > 0), low + 1, low) if len(data) else low
    low = np.maximum(low, words.offsets[text])
    with np.errstate(over="ignore"):
        salt = mix(text.astype(np.uint64) + np.uint64(1))
        key = words.span_hash(low, high) + salt
    distinct = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(text, minlength=n) - np.bincount(text[distinct], minlength=n)
    run, whole = words.shingles(WINDOW)
    place = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        key = run[place] + mix(of_text[place].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(place) + 1, bool)
    twice[1:-1] |= same if len(place) else False
    hit = np.zeros(len(place), bool)
    if len(place):
        hit[order] = np.append(twice[1:-1], False) | np.append(False, same)
    delta = np.zeros(len(words.hashes) + 1, np.int64)
    np.add.at(delta, place[hit], 1)
    np.add.at(delta, place[hit] + WINDOW, -1)
    covered = np.cumsum(delta)[:-1] > 0
    out["n_repeat_words"] = np.bincount(of_text[covered], minlength=n) if n else np.zeros(0, int)
    return out


def judge(model: dict | None, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_slices(batch):
                words = Words(data, offsets, False)
                n_words, base = words.counts, base_counts(words)
                failed = (n_words < MIN_WORDS) | (100 * base["n_repeat_words"] > MAX_REPEAT_PERCENT * n_words)
                if model is None:
                    p = np.ones(high - low)
                else:
                    score = family_means(words, model["weights"]) + model["bias"]
                    p = 1 / (1 + np.exp(-np.clip(model["slope"] * score + model["level"], -50, 50)))
                counts = [pa.array(base[k].astype(np.int64)) for k in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
                columns = [batch.column(0).slice(low, high - low), pa.array(n_words.astype(np.int64)), *counts, pa.array(failed), pa.array(~failed & (p >= threshold)), pa.array(p)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    rows = labelled_sample(docs, labels, "quality", sample)
    return fit([r["text"] or "" for r in rows], [r["label"] for r in rows])


def judge_documents(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(judge(model, threshold), RESULT)


def keep_good(docs: DataFrame, model: dict | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, without a shuffle."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decide = judge(model, threshold)
        for whole in batches:
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                two = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at)], names=["doc_id", "text"])
                kept = [k for part in decide(iter([two])) for k in part.column(7).to_pylist()]
                yield batch.filter(pa.array(kept, pa.bool_()))

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return judge_documents(docs, train(docs, read(spark, sf_dir, "labels")))
