"""Best-fit decreasing packing of tokenised documents into fixed-length sequences.

Tokens are counted where the texts are, in Arrow batches; only (document, piece,
start, length, checksum) leaves a task. Pieces of equal length are
interchangeable, so the histogram of lengths (at most ``limit`` rows, whatever
the corpus) says all that the packing has to know. The driver runs best-fit
decreasing over it: lengths descend, and a segment tree over remaining
capacities finds the tightest open bin. The outcome is a table of runs, "pieces
number a to b of this length go to bins from x on, k to a bin, at this offset",
whose size depends on ``limit`` alone. Pieces are numbered within their length
in salted blocks and joined to the runs, so that no task holds a whole length.

Defined cases: a null or empty text is the end token alone; a document longer
than ``limit`` is cut into pieces of ``limit`` and a rest; repeated rows are
packed each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import Stage, read
from gridloom.llm.textkernel import Words, _MASKS, mix

LIMIT = 4096
END = 1
#: Pieces of a length that are numbered together, about.
BLOCK_ROWS = 20_000
#: Words of at most 16 bytes that a worker keeps with their ids (about 40 bytes each), and longer ones.
CACHE = 400_000
LONG_CACHE = 20_000
#: Bytes of text encoded at once.
GROUP = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"
#: Outside of this, lower-casing and white space could differ between Python and the tokenizer.
ODD = re.compile("[^\x00-\u024f]|[\u0130\x1c-\x1f]")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def split_marks(data: np.ndarray, cut: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the first word of each text, with a last comma or full stop behind a letter set apart.

    The pre-tokenizer makes such a sign a piece of its own.
    """
    last = cut.ends - 1
    before = data[np.maximum(last - 1, 0)]
    marked = (cut.ends - cut.starts > 1) & ((data[last] == 44) | (data[last] == 46)) & (before >= 97) & (before <= 122)
    more = np.concatenate([[0], np.cumsum(marked)])
    place = np.arange(len(last)) + more[:-1]
    starts, ends = (np.empty(len(last) + more[-1], np.int64) for _ in range(2))
    starts[place], ends[place] = cut.starts, cut.ends - marked
    starts[place[marked] + 1], ends[place[marked] + 1] = last[marked], cut.ends[marked]
    return starts, ends, cut.first + more[cut.first]


class Encoder:
    """Ids of texts as packed little-endian 32-bit integers.

    The vocabulary's pre-tokenizer never joins what white space separates, so a
    text is split at white space and each distinct word is encoded once. Words of
    at most 16 bytes are told apart by these bytes and their length in arrays,
    longer ones in a dictionary; no hash decides. Texts where Python's notion of
    case or white space could differ go to the library as they are, as do texts
    with the strings of special tokens.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether an id is the last one of a piece.
        self.last = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.long: dict[bytes, np.ndarray] = {}
        # the table: order, first and second eight bytes, length, place and number of the ids
        self.order, self.one, self.two = (np.zeros(0, np.uint64) for _ in range(3))
        self.size, self.at, self.count = (np.zeros(0, np.int32) for _ in range(3))
        self.ids = np.zeros(0, "<u4")

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def several(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each word.

        A word of letters is one piece of the pre-tokenizer, and the last token
        of a piece is marked as such; so many of them are encoded as one text.
        """
        out: list[np.ndarray | None] = [None] * len(words)
        names = [w.decode() for w in words]
        plain = [i for i, w in enumerate(names) if w.isalpha()]
        parts = [plain[k : k + 256] for k in range(0, len(plain), 256)]
        rest = [i for i, w in enumerate(names) if not w.isalpha()]
        for own, found in zip(parts, self.tokenizer.encode_batch_fast([" ".join([names[i] for i in p]) for p in parts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            stop = np.flatnonzero(self.last[ids]) + 1
            if len(stop) == len(own):
                for i, x, y in zip(own, [0, *stop[:-1].tolist()], stop.tolist(), strict=True):
                    out[i] = ids[x:y]
            else:
                rest += own
        for low in range(0, len(rest), 20_000):
            part = rest[low : low + 20_000]
            for i, found in zip(part, self.tokenizer.encode_batch_fast([names[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = np.array(found.ids, "<u4")
        return out

    def simple(self, text: str) -> bool:
        if not text.isascii() and ODD.search(text) or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return False
        return not any(s in text for s in self.special)

    def lookup(self, order, one, two, size) -> np.ndarray:
        """Place in the table of each word, -1 if it is not there."""
        if not len(self.order):
            return np.full(len(order), -1)
        at = np.minimum(np.searchsorted(self.order, order), len(self.order) - 1)
        same = (self.order[at] == order) & (self.one[at] == one) & (self.two[at] == two) & (self.size[at] == size)
        return np.where(same, at, -1)

    def learn(self, order, one, two, size, words: list[bytes]) -> None:
        """Adds words, given in ascending order of ``order``, to the table."""
        found = self.several(words)
        count = np.array([len(f) for f in found], np.int32)
        at = len(self.ids) + np.cumsum(count) - count
        self.ids = np.concatenate([self.ids, *found])
        own = np.searchsorted(self.order, order)
        self.order, self.one, self.two = (np.insert(a, own, b) for a, b in ((self.order, order), (self.one, one), (self.two, two)))
        self.size, self.at, self.count = (np.insert(a, own, b.astype(np.int32)) for a, b in ((self.size, size), (self.at, at), (self.count, count)))

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of simple words, and where each text's ids start."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        cut = Words(data, offsets, False, hashed=False)
        starts, ends, first_word = split_marks(data, cut)
        size = ends - starts
        one = cut.eight[starts] & _MASKS[np.minimum(size, 8)]
        two = np.where(size > 8, cut.eight[np.minimum(starts + 8, len(data))] & _MASKS[np.clip(size - 8, 0, 8)], np.uint64(0))
        with np.errstate(over="ignore"):
            order = mix(one ^ mix(two + size.astype(np.uint64)))
        # distinct words: of equal order, those that differ from the first are encoded on their own
        rank = np.argsort(order)
        new = np.append(True, order[rank][1:] != order[rank][:-1])[: len(rank)]
        first = rank[new]
        group = np.zeros(len(rank), np.int64)
        group[rank] = np.cumsum(new) - 1
        odd = (size > 16) | (one != one[first][group]) | (two != two[first][group]) | (size != size[first][group])
        heads, first = first, first[size[first] <= 16]
        missing = first[self.lookup(order[first], one[first], two[first], size[first]) < 0]
        if len(self.order):  # as good as never: the table has another word of this order
            missing = missing[self.order[np.minimum(np.searchsorted(self.order, order[missing]), len(self.order) - 1)] != order[missing]]
        if len(missing) and len(self.order) < CACHE:  # words that come late are rare: they are not kept
            self.learn(order[missing], one[missing], two[missing], size[missing], [data[a:b].tobytes() for a, b in zip(starts[missing].tolist(), ends[missing].tolist(), strict=True)])
        place = self.lookup(order[heads], one[heads], two[heads], size[heads])[group]
        place[odd] = -1
        count = np.where(place >= 0, self.count[place], 0) if len(self.count) else np.zeros(len(place), np.int64)
        begin = np.where(place >= 0, self.at[place], 0) if len(self.at) else np.zeros(len(place), np.int64)
        pool = self.ids
        alone = np.flatnonzero(place < 0)
        if len(alone):
            names = [data[a:b].tobytes() for a, b in zip(starts[alone].tolist(), ends[alone].tolist(), strict=True)]
            if len(self.long) > LONG_CACHE:
                self.long.clear()
            fresh = [w for w in dict.fromkeys(names) if w not in self.long]
            now = dict(zip(fresh, self.several(fresh), strict=True))
            found = [now[w] if w in now else self.long[w] for w in names]
            self.long.update((w, f) for w, f in now.items() if 16 < len(w) <= 256)
            own = np.array([len(f) for f in found], np.int64)
            count[alone], begin[alone] = own, len(pool) + np.cumsum(own) - own
            pool = np.concatenate([pool, *found])
        run = np.concatenate([[0], np.cumsum(count)])
        ids = pool[np.repeat(begin - run[:-1], count) + np.arange(run[-1])]
        return ids, run[first_word]

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        own, plain = [], []
        for i, text in enumerate(texts):
            if not self.simple(text):
                out[i] = self.whole(text)
                continue
            if not text.isascii():
                if not unicodedata.is_normalized("NFC", text):
                    text = unicodedata.normalize("NFC", text)
                text = text.replace("\x85", " ").replace("\xa0", " ")
            own.append(i)
            plain.append(text.lower().encode())
        if own:
            ids, start = self.words(plain)
            for k, i in enumerate(own):
                out[i] = ids[start[k] : start[k + 1]]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(path: str, limit: int, end: int):
    tail = int(end).to_bytes(4, "little")
    step = 4 * limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        seen = 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64)
            group = np.concatenate([[0], np.cumsum(sizes + 1)])
            low = 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(group, group[low] + GROUP, "right")) - 1)
                part = batch.slice(low, high - low)
                low = high
                docs, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                out: list[tuple] = []
                for doc, found in zip(docs, encode.batch(texts), strict=True):
                    ids = found.tobytes() + tail
                    for k, at in enumerate(range(0, len(ids), step)):
                        piece = ids[at : at + step]
                        seen += 1
                        out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece), seen & 0x7FFFFFFF))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "salt"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


class OpenBins:
    """Runs of open bins by remaining capacity; a segment tree finds the smallest capacity that suffices."""

    def __init__(self, limit: int):
        self.size = 1 << (limit + 1).bit_length()
        self.any = bytearray(2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(limit + 1)]

    def _mark(self, at: int, full: bool) -> None:
        at += self.size
        self.any[at] = full
        while at > 1:
            at >>= 1
            self.any[at] = self.any[2 * at] | self.any[2 * at + 1]

    def push(self, capacity: int, low: int, count: int) -> None:
        if capacity > 0 and count > 0:
            self.runs[capacity].append((low, count))
            self._mark(capacity, True)

    def pop(self, capacity: int) -> tuple[int, int]:
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            self._mark(capacity, False)
        return run

    def tightest(self, least: int) -> int | None:
        """Smallest capacity >= least that has an open bin."""
        at = least + self.size
        if self.any[at]:
            return least
        while at > 1:
            if not at & 1 and self.any[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.any[2 * at] else 2 * at + 1
                return at - self.size
            at >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], limit: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (length, first, last, bin, per_bin, offset) of best-fit decreasing.

    Piece r of its length, first <= r < last, goes to bin ``bin + (r - first) // per_bin``
    at ``offset + (r - first) % per_bin * length``. Placing pieces of one length
    one by one, best fit stays with a bin as long as it has room, since that bin
    is then the tightest; so a bin takes as many as fit before the next is opened.
    """
    bins, opened, runs = OpenBins(limit), 0, []
    for length in sorted(histogram, reverse=True):
        done, total = 0, histogram[length]
        while done < total:
            capacity = bins.tightest(length)
            if capacity is None:
                capacity, low = limit, opened
                count = -(-(total - done) // (limit // length))
                opened += count
            else:
                low, count = bins.pop(capacity)
            each = capacity // length
            full, rest = divmod(min(total - done, count * each), each)
            for first, number, k in ((low, full, each), (low + full, min(rest, 1), rest)):
                if number:
                    runs.append((length, done, done + number * k, first, k, limit - capacity))
                    done += number * k
                    bins.push(capacity - k * length, first, number)
            used = full + min(rest, 1)
            bins.push(capacity, low + used, count - used)
    return runs


def pack(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    stage = Stage(spark, "packing")
    pieces = docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(cut(path, limit, end), PIECES)
    pieces = stage.write(pieces)
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit_decreasing(histogram, limit)
    fields = "r_length long, first long, last long, bin long, each long, at long"
    plan = F.broadcast(spark.createDataFrame(runs, fields)) if runs else spark.createDataFrame([], fields)
    # at most ``limit`` rows
    salts = F.broadcast(spark.createDataFrame([(n, -(-c // BLOCK_ROWS)) for n, c in histogram.items()] or [(1, 1)], "s_length long, salts long"))
    blocked = pieces.join(salts, F.col("length") == F.col("s_length")).withColumn("block", F.pmod(F.col("salt"), F.col("salts"))).drop("s_length", "salts")
    sizes = blocked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("length").alias("b_length"), F.col("block").alias("b_block"), before.alias("before"))
    number = F.row_number().over(W.partitionBy("length", "block").orderBy("doc_id", "piece", "salt")) - 1
    numbered = blocked.withColumn("number", number)
    numbered = numbered.join(starts, (F.col("length") == F.col("b_length")) & (F.col("block") == F.col("b_block")))
    numbered = numbered.withColumn("rank", F.col("number") + F.col("before"))
    placed = numbered.join(plan, (F.col("length") == F.col("r_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    past = F.col("rank") - F.col("first")
    sequence = F.col("bin") + F.floor(past / F.col("each")).cast("long")
    at = F.col("at") + F.pmod(past, F.col("each")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), at.cast("long").alias("offset"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark, read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
