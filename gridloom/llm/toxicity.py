"""Toxicity: a support vector machine over a gapped subsequence kernel.

Instances are the words of sentences (runs of single letters, as in "s p a c e d",
are joined to one word). The kernel counts common subsequences of three letters,
each weighted by ``DECAY`` to the power of the span that it covers, up to
``REACH`` letters wide, so that an inserted or left-out character keeps most of
the likeness. Nyström landmarks are words of the labelled sentences; a linear
support vector machine is fitted in the space that they span. Labels belong to
documents, so the machine is fitted in rounds: words that surely prefer toxic
documents are positive instances, a toxic document without one lends its
highest-scoring word, and clean documents lend their highest-scoring words.

The decision is a sum of kernel values with the landmarks, and the kernel is an
inner product of subsequence weights, so the sum over landmarks is folded into
one weight per subsequence: scoring a word costs its own subsequences, however
many landmarks there are. A document scores as its highest-scoring word; a
logistic curve fitted on documents that took no part in the fit makes that a
probability.

Defined cases: null and empty texts score as the lowest decision; without
labels of both kinds every score is 0; several labels of a document count as
the smallest; repeated rows are scored each on its own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import bounded_batches, read
from gridloom.llm.quality import calibrate, labelled_sample

SAMPLE = 3_000
LANDMARKS = 128
DECAY = 0.75
REACH = 7
ROUNDS = 4
FLOOR = -1.5
#: Least log-likelihood by which a word must prefer toxic documents to be a positive instance from the start.
EVIDENCE = 15.0
CACHE = 200_000
#: Words whose subsequences are held at once.
BLOCK = 8_192
LETTERS = 64
#: Longer words are scored by their overlapping parts of this length.
LONGEST = 32
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_SINGLES = re.compile(r"(?<!\S)(?:[^\W\d_][.\-_*]?\s+){2,}[^\W\d_](?!\S)")
#: Digits and signs that stand for letters.
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
_CODES = np.zeros(0x250, np.int64)
for _c in range(0x250):
    _ch = _STANDS_FOR.get(chr(_c), chr(_c)).lower()[:1]
    if "a" <= _ch <= "z":
        _CODES[_c] = ord(_ch) - 96
    elif _ch.isalpha():
        _CODES[_c] = 27 + ord(_ch) % (LETTERS - 27)
_PAIRS = [(d, s) for s in range(2, REACH) for d in range(1, s)]


def words_of(text: str) -> set[str]:
    low = text.lower()
    out = set(low.split())
    if _SINGLES.search(low):
        out |= {re.sub(r"[\s.\-_*]+", "", m.group()) for m in _SINGLES.finditer(low)}
    return out


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


class Strings:
    """Letters of many words in one array, without what is no letter; words are set apart by ``REACH`` blanks."""

    def __init__(self, words: list[str]):
        parts, self.owner = [], []
        for i, w in enumerate(words):
            if len(w) <= LONGEST:
                parts.append(w)
                self.owner.append(i)
            else:
                for at in range(0, len(w) - LONGEST // 2, LONGEST // 2):
                    parts.append(w[at : at + LONGEST])
                    self.owner.append(i)
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        codes = np.where(points < len(_CODES), _CODES[np.minimum(points, len(_CODES) - 1)], 27 + points.astype(np.int64) % (LETTERS - 27))
        codes = np.where((points >= len(_CODES)) & (points < 0x2000), codes, np.where(points < len(_CODES), codes, 0))
        end = points == 10
        keep = (codes > 0) | end
        part = (np.cumsum(end) - end)[keep]
        codes, end = codes[keep], end[keep]
        self.count = len(parts)
        sizes = np.bincount(part[~end], minlength=self.count)
        # each part takes its letters and REACH blanks
        self.starts = np.concatenate([[0], np.cumsum(sizes + REACH)])
        letter, own = codes[~end], part[~end]
        place = np.arange(len(letter)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + self.starts[own]
        self.letters = np.zeros(self.starts[-1] + REACH, np.int64)
        self.letters[place] = letter
        self.sizes = sizes
        self.owner = np.asarray(self.owner, np.int64)

    def subsequences(self):
        """(weight, index) for each way to take three letters: the index of the triple that starts at each place, 0 if none."""
        a, n = self.letters, len(self.letters) - REACH
        for d, s in _PAIRS:
            first, second, third = a[:n], a[d : n + d], a[s : n + s]
            inside = (first > 0) & (second > 0) & (third > 0)
            yield DECAY ** (s + 1), np.where(inside, (first * LETTERS + second) * LETTERS + third, 0)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Inner product of each part's subsequence weights with ``weights`` (weights[0] = 0)."""
        total = np.zeros(len(self.letters) - REACH)
        for w, at in self.subsequences():
            total += w * weights[at]
        run = np.concatenate([[0.0], np.cumsum(total)])
        return run[self.starts[1:]] - run[self.starts[:-1]]

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse subsequence weights (part, triple, weight)."""
        part = np.repeat(np.arange(self.count), self.sizes + REACH)
        keys, values = [], []
        for w, at in self.subsequences():
            has = at > 0
            keys.append(part[: len(at)][has] * LETTERS**3 + at[has])
            values.append(np.full(int(has.sum()), w))
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(back, np.concatenate(values), len(key))
        return key // LETTERS**3, key % LETTERS**3, weight

    def norms(self) -> np.ndarray:
        part, _, weight = self.features()
        return np.sqrt(np.bincount(part, weight * weight, self.count))


#: Least possible squared norm of a word of n letters: all its subsequences differ.
_LEAST = np.array([sum(max(0, n - s) * (s - 1) * DECAY ** (2 * (s + 1)) for s in range(2, REACH)) for n in range(LONGEST + 1)])


def decisions(words: list[str], weights: np.ndarray, bias: float, floor: float = FLOOR) -> np.ndarray:
    """The machine's decision on each word, cut off at ``floor`` below, which words of less than three letters get.

    The norm of a word needs its subsequences sorted; it is at least that of a
    word without repeated letters, so the exact norm is found only for the words
    whose decision can come above the floor.
    """
    if len(words) > BLOCK:
        return np.concatenate([decisions(words[i : i + BLOCK], weights, bias, floor) for i in range(0, len(words), BLOCK)])
    if not words:
        return np.zeros(0)
    strings = Strings(words)
    raw = strings.dot(weights)
    best = np.full(strings.count, floor)
    with np.errstate(divide="ignore", invalid="ignore"):
        bound = np.where(raw > 0, raw / np.sqrt(_LEAST[strings.sizes]), 0.0) + bias
    chosen = np.flatnonzero((bound > floor) & (strings.sizes >= 3))
    if len(chosen):
        text = [words[i] for i in strings.owner]
        parts = []
        for i in chosen:
            owner = strings.owner[i]
            w = text[i]
            if len(w) > LONGEST:
                k = i - np.searchsorted(strings.owner, owner)
                w = w[k * (LONGEST // 2) : k * (LONGEST // 2) + LONGEST]
            parts.append(w)
        norm = Strings(parts).norms()
        best[chosen] = np.maximum(floor, raw[chosen] / np.maximum(norm, 1e-12) + bias)
    out = np.full(len(words), floor)
    np.maximum.at(out, strings.owner, best)
    return out


def kernel(a: list[str], b: list[str]) -> np.ndarray:
    """Normalised kernel values of words of at most ``LONGEST`` letters."""
    out = np.zeros((len(a), len(b)))
    left, right = Strings(a), Strings(b)
    part, triple, weight = right.features()
    norm_a, norm_b = left.norms(), right.norms()
    dense = np.zeros(LETTERS**3)
    bounds = np.searchsorted(part, np.arange(len(b) + 1))
    taken = [(w, at.astype(np.int32)) for w, at in left.subsequences()]
    for j in range(len(b)):
        own = slice(bounds[j], bounds[j + 1])
        dense[triple[own]] = weight[own]
        total = sum(w * dense[at] for w, at in taken)
        out[:, j] = np.add.reduceat(total, left.starts[:-1]) / np.maximum(norm_a * norm_b[j], 1e-12)
        dense[triple[own]] = 0
    return out


def hinge(x: np.ndarray, y: np.ndarray, share: np.ndarray, c: float = 10.0, steps: int = 400) -> tuple[np.ndarray, float]:
    """Linear machine of squared hinge loss by accelerated gradient."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    look, momentum = w.copy(), 1.0
    ridge = np.append(np.ones(x.shape[1]), 1e-3)
    step = 1 / (1 + 2 * c * np.linalg.norm((z * share[:, None]).T @ z, 2))
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (z @ look))
        new = look - step * (ridge * look - 2 * c * (z.T @ (share * y * slack)))
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        look = new + (momentum - 1) / after * (new - w)
        w, momentum = new, after
    return w[:-1], float(w[-1])


def apart(bags: list[set[str]], seeds: int = 6) -> list[int]:
    """Numbers of the bags that are no near copies of an earlier one, by their least hashes."""
    seen, out = set(), []
    for i, bag in enumerate(bags):
        marks = [(k, min((crc32(w.encode(), 7919 * k + 1) for w in bag), default=0)) for k in range(seeds)]
        if sum(m in seen for m in marks) < seeds // 2:
            out.append(i)
        seen.update(marks)
    return out


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> dict | None:
    """Folded weights, bias and calibration, or None where the labels are all alike."""
    if len(set(labels)) < 2:
        return None
    same: dict[str, str] = {}  # each word is held once
    bags = [frozenset(same.setdefault(w, w) for w in {w for s in sentences(t) for w in words_of(s)} | words_of(t)) for t in texts]
    y = np.asarray(labels)
    test = np.arange(len(y)) % 5 == 4
    if len({*y[test]}) < 2 or len({*y[~test]}) < 2:
        test[:] = False
    own = np.flatnonzero(~test)
    toxic, clean = Counter(), Counter()
    for i in own:
        (toxic if y[i] else clean).update(w for w in bags[i] if 3 <= len(w) <= LONGEST)
    t, c = max(1, int(y[own].sum())), max(1, int((1 - y[own]).sum()))
    ratio = {w: (k / t) / ((clean[w] + 0.5) / c) for w, k in toxic.items()}
    # words that surely prefer toxic documents stay positive instances; copies of a document tell nothing new
    once = Counter(w for bag in ([bags[i] for i in own if y[i]][k] for k in apart([bags[i] for i in own if y[i]])) for w in bag if w in ratio)
    strength = {w: k * np.log(ratio[w]) for w, k in once.items() if k > 1 and ratio[w] > 4}
    telling = sorted((w for w, v in strength.items() if v > EVIDENCE), key=lambda w: (-strength[w], w))
    telling = telling or sorted(toxic, key=lambda w: (-toxic[w] * ratio[w], w))[:8]
    common = sorted(clean, key=lambda w: (-clean[w], w))
    marks = telling[: landmarks // 2]
    step = max(1, len(common) // max(1, 4 * landmarks))
    marks = list(dict.fromkeys(marks + common[: landmarks // 8] + common[landmarks // 8 :: step]))[:landmarks]
    gram = kernel(marks, marks)
    value, vector = np.linalg.eigh(gram)
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    sure = {w: toxic[w] for w in telling}
    positives = Counter(sure)
    hard: Counter = Counter()
    negatives = common[:1500] + common[1500 :: max(1, len(common) // 2500)]
    part, triple, weight = Strings(marks).features()
    norm = Strings(marks).norms()
    folded, bias = np.zeros(LETTERS**3), -1.0
    rows: dict[str, np.ndarray] = {}  # kernel values with the landmarks
    for _ in range(rounds):
        pos, neg = sorted(positives), sorted(({*negatives} | {*hard}) - positives.keys())
        new = [w for w in pos + neg if w not in rows]
        rows.update(zip(new, kernel(new, marks), strict=True) if new else ())
        x = np.array([rows[w] for w in pos + neg]) @ whiten
        goal = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        p = np.sqrt([positives[w] for w in pos])
        n = np.array([1.0 + 2.0 * (w in hard) for w in neg])
        share = np.r_[p / p.sum(), n / n.sum()] * 0.5 * len(goal) / 10
        w, bias = hinge(x, goal, share)
        beta = whiten @ w
        folded = np.bincount(triple, (beta / np.maximum(norm, 1e-12))[part] * weight, LETTERS**3)
        folded[0] = 0.0
        value_of = dict(zip(same, decisions([*same], folded, bias).tolist(), strict=True))
        positives, hard = Counter(sure), Counter()
        for i in own:
            if not bags[i]:
                continue
            if not y[i]:
                hard.update(w for w in sorted(bags[i], key=lambda w: (-value_of[w], w))[:3] if value_of[w] > -1 and len(w) <= LONGEST and w not in sure)
            elif not sure.keys() & bags[i]:
                best = max(bags[i], key=lambda w: (value_of[w], w))
                if len(best) <= LONGEST and value_of[best] > 0 and ratio.get(best, 0) > 2:
                    positives[best] += 1
    top = np.array([max((float(v) for v in decisions(sorted(b), folded, bias)), default=FLOOR) for b in bags])
    judged = test if test.any() else ~test
    slope, level = calibrate(top[judged], y[judged].astype(float))
    return {"weights": folded, "bias": bias, "slope": max(slope, 1e-6), "level": level, "landmarks": marks}


def score(model: dict | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                texts = [t or "" for t in part.column(1).to_pylist()]
                if model is None:
                    p = np.zeros(len(texts))
                else:
                    if len(known) > CACHE:
                        known.clear()
                    bags = [words_of(t) for t in texts]
                    missing = sorted({w for b in bags for w in b if w not in known})
                    known.update(zip(missing, decisions(missing, model["weights"], model["bias"]).tolist(), strict=True))
                    top = np.array([max(map(known.__getitem__, b), default=FLOOR) for b in bags])
                    p = 1 / (1 + np.exp(-np.clip(model["slope"] * top + model["level"], -50, 50)))
                columns = [part.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fits on at most ``sample`` labelled rows outside the held-out fold."""
    own = lambda doc: F.crc32(F.col(doc).cast("string")) % 5 != 0
    rows = labelled_sample(docs, labels, "toxic", sample, own)
    return fit([r["text"] or "" for r in rows], [r["label"] for r in rows])


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    out = rows.mapInArrow(score(model), "doc_id long, score double, predicted int")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
