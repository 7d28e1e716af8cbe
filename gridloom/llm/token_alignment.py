"""Alignment of two tokenizers' tokens: relational, over the distinct segments of the corpus.

A text is cut at places that are token boundaries of both tokenizers whatever stands
around them (:func:`cut`): before a blank or a line feed that follows a character which is
not white space, and around a line feed before such a character. The byte-level
pre-tokenizer never matches across such a place (of white space before a word it takes
the last sign apart), and no piece of the other vocabulary has
a blank behind another character or a line feed in it (checked when it is loaded; else
texts stay whole). So both token sequences, the common cuts, groups and links of a text
are those of its segments in a row, and each distinct segment is aligned once, as a
document of its own, weighted by how often it occurs:

1. Tasks count segments; distinct ones are encoded by both libraries.
2. Tokens are posexploded, a windowed running sum of byte lengths gives their ends, and
   an equi-join on segment and end gives the cuts. The running count of cuts above a
   token is its group; the tokens that end at a cut are linked.
3. Corpus-wide counts of id pairs are sums over links times occurrences; the highest
   count of each B id is a maximum over them.
4. Documents are taken in slices of neighbouring rows with at most ``SLICE`` characters
   (or one document). The distinct segments of a slice are joined to their figures and
   meet the slice's texts, where a document's figures are added up in order.

Broadcast are the table of id pairs up to ``PAIRS`` rows (beyond that it is joined with
frequent pairs told apart) and the figures of the ``FREQUENT`` most frequent short segments. A frequent segment is one row of a slice, so
neither words nor copies of documents make a task larger. The documents are read three
times and must give the same rows in the same partitions each time, as files do.

Defined cases: a null or empty text has no tokens and zeros, and so has one that holds a
character which a tokenizer doesn't give back byte by byte (such as U+2581); repeated
rows are aligned each on its own and count each; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm._common import Stage, bounded_batches, columns_of, read, skewed_join

#: Characters of the texts of a slice, of those that are looked up together, as each look-up hashes all segments of the slice, and of those that are cut and added up together.
SLICE = 32_000_000
LOOKUP = 8_000_000
TOGETHER = 500_000
#: Most frequent segments, of at most ``SHORT`` characters, whose figures go to all tasks; the others go to the slices that have them.
FREQUENT, SHORT = 100_000, 64
#: Rows of a batch that a task passes on.
ROWS = 20_000
#: Distinct segments that a task counts before it passes them on.
DISTINCT = 200_000
#: Rows of the table of id pairs that is broadcast.
PAIRS = 1_000_000
#: White space and control characters; the rest is what segments are cut beside.
_W = "\\x00-\\x20\\x7f-\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CUT = re.compile(rf"\n(?=[^{_W}])|[{_W}]+(?=\n[^{_W}])|[{_W}]*[^{_W}]+(?:(?![ \n])[{_W}][{_W}]*[^{_W}]*)*|[{_W}]+")
_LOADED: dict[tuple[str, str], Tokens] = {}

FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def cut(text: str) -> list[str]:
    """Segments of a text that begins with a blank, in order."""
    if "  " in text or "\n\n" in text or "\n " in text or " \n" in text or not text.replace("\n", "").isprintable():
        return _CUT.findall(text)
    # no white space but single blanks and line feeds: the same places, by splitting
    found = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    if found and not found[-1]:
        found.pop()
    return found[1:] if found and not found[0] else found


class Tokens:
    """Both tokenizers of a worker with the bytes of their ids, and whether characters come back as they are."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a, self.b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        # the byte-level alphabet: bytes that print stand for themselves, the others for characters from 256 on
        self_ = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(k): k for k in self_} | {chr(256 + i): k for i, k in enumerate(k for k in range(256) if k not in set(self_))}
        if set(byte) != set(ByteLevel.alphabet()):
            raise ValueError("not a byte-level alphabet")
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.cuts = not any(re.search("[^▁]▁|\n", p) for p in pieces) and len(self.b.encode("\n")) == 2
        self.good: set[str] = set()
        self.bad: set[str] = set()

    def segments(self, text: str) -> list[str]:
        return cut(text) if self.cuts else [text]

    def whole(self, text: str) -> bool:
        """Whether all characters come back byte by byte."""
        if new := set(text) - self.good - self.bad:
            for c in new:
                (self.good if self.given(" " + c) else self.bad).add(c)
        return not self.bad or self.bad.isdisjoint(text)

    def given(self, segment: str) -> bool:
        """Whether the joined bytes of both are those of the segment."""
        ((a, b),) = self.encode([segment])
        return b"".join(map(self.a_bytes.__getitem__, a)) == segment.encode() == b"".join(map(self.b_bytes.__getitem__, b))

    def encode(self, segments: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both. A blank is added before what is encoded, so a segment's own is left out; one without a blank, or with nothing else, is encoded behind a line feed, which is a token of its own."""
        a = [e.ids for e in self.a.encode_batch_fast(segments, add_special_tokens=False)]
        skip = [0 if s[0] == " " and len(s) > 1 else 2 for s in segments]
        b = self.b.encode([s[1:] if not k else "\n" + s for s, k in zip(segments, skip, strict=True)], num_threads=1)
        return [(x, y[k:]) for x, y, k in zip(a, b, skip, strict=True)]


def tokens(a: str, b: str) -> Tokens:
    if (a, b) not in _LOADED:
        _LOADED[a, b] = Tokens(a, b)
    return _LOADED[a, b]


def _count(a: str, b: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, n): occurrences in texts that come back whole; those of others count 0."""
    own, found = tokens(a, b), Counter()

    def rows():
        keys, counts = list(found.keys()), list(found.values())
        for k in range(0, len(keys), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + ROWS], pa.string()), pa.array(counts[k : k + ROWS], pa.int64())], names=["segment", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if not text:
                continue
            if own.whole(text):
                found.update(own.segments(" " + text))
            else:
                found.update(dict.fromkeys(own.segments(" " + text), 0))
            if len(found) > DISTINCT:
                yield from rows()
                found.clear()
    yield from rows()


_ENCODED = "segment string, n long, ok boolean, a array<int>, a_size array<int>, b array<int>, b_size array<int>"


def _encode(a: str, b: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = tokens(a, b)
    sizes = [np.array([len(x) for x in t], np.int32) for t in (own.a_bytes, own.b_bytes)]
    for batch in batches:
        segments, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ids = own.encode(segments)
        ok = []
        for s, (x, y), n in zip(segments, ids, counts, strict=True):
            ok.append(b"".join(map(own.a_bytes.__getitem__, x)) == s.encode() == b"".join(map(own.b_bytes.__getitem__, y)))
            if n and not ok[-1]:
                raise ValueError("a segment of characters that come back whole doesn't: these tokenizers can't be aligned by segments")
        columns = []
        for k in (0, 1):
            flat = np.fromiter((t for i in ids for t in i[k]), np.int32)
            ends = np.cumsum([0, *(len(i[k]) for i in ids)], dtype=np.int32)
            columns += [pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, sizes[k][flat])]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok), *columns], names=["segment", "n", "ok", "a", "a_size", "b", "b_size"])


def _ends(encoded: DataFrame, side: str) -> DataFrame:
    """sid, end, <side>_id: tokens with the running sum of their byte lengths."""
    rows = encoded.select("sid", F.posexplode(F.arrays_zip(F.col(side).alias("id"), F.col(f"{side}_size").alias("size"))).alias("pos", "t"))
    down = W.partitionBy("sid").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.select("sid", F.sum("t.size").over(down).alias("end"), F.col("t.id").alias(f"{side}_id"))


def _ids(side: str):
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col(f"{side}_id").isNotNull(), F.struct("end", f"{side}_id")))), lambda t: t[f"{side}_id"].cast("string")), ",")


def align(encoded: DataFrame, parts: int) -> DataFrame:
    """segment, n, ok, n_a, n_b, n_groups, n_links, groups (string), links (array of a * 2^32 + b) of the encoded segments."""
    dealt = encoded.repartition(parts, "sid")
    a, b = _ends(dealt, "a"), _ends(dealt, "b").withColumnsRenamed({"sid": "b_sid", "end": "b_end"})
    both = a.join(b, (F.col("sid") == F.col("b_sid")) & (F.col("end") == F.col("b_end")), "full")
    both = both.select(F.coalesce("sid", "b_sid").alias("sid"), F.coalesce("end", "b_end").alias("end"), "a_id", "b_id", (F.col("a_id").isNotNull() & F.col("b_id").isNotNull()).cast("long").alias("cut"))
    above = W.partitionBy("sid").orderBy("end").rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("g", F.coalesce(F.sum("cut").over(above), F.lit(0)))
    pair = F.when(F.col("cut") == 1, F.col("a_id").cast("long") * F.lit(1 << 32) + F.col("b_id"))
    group = both.groupBy("sid", "g").agg(F.concat(_ids("a"), F.lit("|"), _ids("b")).alias("ids"), F.collect_list(pair).alias("links"), F.count("a_id").alias("n_a"), F.count("b_id").alias("n_b"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "ids"))), lambda t: t["ids"]), ";")
    made = group.groupBy(F.col("sid").alias("g_sid")).agg(ordered.alias("groups"), F.flatten(F.collect_list("links")).alias("links"), F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"), F.count("*").alias("n_groups"))
    rows = dealt.select("sid", "segment", "n", "ok").join(made, F.col("sid") == F.col("g_sid"))
    return rows.select("segment", "n", "ok", "n_a", "n_b", "n_groups", F.size("links").cast("long").alias("n_links"), "groups", "links")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count (links corpus-wide), best (whether it is the highest of its B id), rows (segments' links with it)."""
    pairs = aligned.select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"), F.count("*").alias("rows"))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = pairs.groupBy(b.alias("b")).agg(F.max("count").alias("top"))
    return pairs.join(top, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("top")).cast("long").alias("best"), "rows")


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows (at, text, ...) of a task with the ``at`` of the first row of their slice, a batch for each stretch."""
    first, held = None, 0
    for batch in batches:
        sizes = [len(t or "") for t in batch.column(1).to_pylist()]
        at, low = batch.column(0).to_pylist(), 0
        for i, size in enumerate(sizes):
            if first is None or held + size > SLICE:
                if i > low:
                    yield first, batch.slice(low, i - low)
                first, held, low = at[i], 0, i
            held += size
        if batch.num_rows > low:
            yield first, batch.slice(low)


def _needed(cuts: bool, frequent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slice, segment): the distinct segments of each slice but for the frequent ones."""
    segments = cut if cuts else lambda text: [text]
    last, found, known = None, set(), set(_frequent(frequent)["segment"].to_pylist())

    def rows():
        every = list(found - known)
        for k in range(0, len(every), ROWS):
            part = every[k : k + ROWS]
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(part), pa.int64()), pa.array(part, pa.string())], names=["slice", "segment"])

    for first, batch in _sliced(batches):
        if first != last:
            yield from rows()
            last, found = first, set()
        for text in batch.column(1).to_pylist():
            if text:
                found.update(segments(" " + text))
    yield from rows()


def _frequent(sent) -> pa.Table:
    """The table of a broadcast in Arrow's format."""
    return pa.ipc.open_stream(sent.value).read_all()


def _tagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for first, batch in _sliced(batches):
        yield pa.RecordBatch.from_arrays([pa.array([first] * batch.num_rows, pa.int64()), *batch.columns[1:]], names=["slice", *batch.schema.names[1:]])


def _stretches(sizes: np.ndarray, low: int, high: int, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of the texts low to high with at most so many characters each (or one text); ``sizes`` are running sums."""
    while low < high:
        end = min(high, max(low + 1, int(np.searchsorted(sizes, (sizes[low - 1] if low else 0) + most, "right"))))
        yield low, end
        low = end


def _looked_up(segments, texts: pa.ChunkedArray, sizes: np.ndarray, low: int, high: int, figures: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each stretch of the texts low to high, the rows of its segments' figures and where each text's begin and end. Cut texts are kept in Arrow, and looked up in one go."""
    cut_, ends = [], []
    for a, b in _stretches(sizes, low, high, TOGETHER):
        lists = [segments(" " + t) if t else [] for t in texts.slice(a, b - a).to_pylist()]
        cut_.append(pa.array([s for x in lists for s in x], pa.string()))
        ends.append(np.cumsum([0, *map(len, lists)]))
    at = pc.index_in(pa.chunked_array(cut_, pa.string()), value_set=figures["segment"])
    return zip((x.to_numpy(zero_copy_only=False) for x in _same_chunks(at, cut_)), ends, strict=True)


def _same_chunks(found: pa.ChunkedArray, like: list[pa.Array]) -> Iterator[pa.Array]:
    low = 0
    for x in like:
        yield found.slice(low, len(x)).combine_chunks()
        low += len(x)


def _added(at: np.ndarray, ends: np.ndarray, figures: pa.Table, numbers: np.ndarray) -> tuple[np.ndarray, list[bytes | None]]:
    """Sums of the figures (with the number of bad segments last) and joined groups of each text."""
    sums = np.zeros((len(at) + 1, numbers.shape[1]), np.int64)
    np.cumsum(numbers[at], 0, out=sums[1:])
    found = figures["groups"].take(pa.array(at)).combine_chunks()
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), found), pa.scalar(b";", found.type)).to_pylist()
    joined = [x if some else None for x, some in zip(joined, np.diff(ends).tolist(), strict=True)]
    return sums[ends[1:]] - sums[ends[:-1]], joined


def _fold(cuts: bool, groups: bool, frequent, docs: pa.Table, figures: pa.Table) -> pa.Table:
    """Documents of a slice with the sums of their segments' figures and the digest of their groups."""
    _LOADED.clear()  # this worker may have encoded before
    segments = cut if cuts else lambda text: [text]
    shared = _frequent(frequent)
    figures = pa.concat_tables([figures.select(shared.column_names).cast(shared.schema), shared])
    numbers = np.stack([*(figures[c].to_numpy() for c in FIGURES), ~figures["ok"].to_numpy(zero_copy_only=False)], 1).astype(np.int64)
    figures = pa.table({"segment": figures["segment"].combine_chunks(), "groups": figures["groups"].cast(pa.large_binary()).combine_chunks()})
    sizes = np.cumsum(pc.fill_null(pc.utf8_length(docs["text"]), 0).to_numpy())
    sums, digests, whole = [], [], []
    for low, high in _stretches(sizes, 0, docs.num_rows, LOOKUP):
        for at, ends in _looked_up(segments, docs["text"], sizes, low, high, figures):
            own, joined = _added(at, ends, figures, numbers)
            good = (own[:, -1] == 0) & np.array([x is not None for x in joined])
            sums.append(np.where(good[:, None], own, 0))
            digests += [hashlib.sha256(x).hexdigest() if g else "" for x, g in zip(joined, good, strict=True)]
            whole += [x.decode() if g and groups else None for x, g in zip(joined, good, strict=True)]
    total = np.concatenate(sums) if sums else np.zeros((0, len(FIGURES)), np.int64)
    names = [c for c in docs.column_names if c not in ("slice", "text")]
    return pa.Table.from_arrays([*(docs[c] for c in names), *(pa.array(total[:, k]) for k in range(len(FIGURES))), pa.array(digests, pa.string()), pa.array(whole, pa.string())], names=[*names, *FIGURES, "groups_sha256", "groups"])


def _often(aligned: DataFrame):
    """A condition that the most frequent short segments meet, at most ``FREQUENT`` of them: whole steps of frequency, from the top."""
    step = F.floor(F.log2("n") * 8)
    short = (F.col("n") > 0) & (F.length("segment") <= SHORT)
    counts = sorted((tuple(r) for r in aligned.where(short).groupBy(step.alias("step")).count().collect()), reverse=True)  # a row a step: some hundreds
    least, total = 1 << 30, 0
    for at, count in counts:
        total += count
        if total > FREQUENT:
            break
        least = at
    return short & (step >= least)


def align_documents(spark: SparkSession, docs: DataFrame, a: str, b: str, keep: list[str], groups: bool = False) -> DataFrame:
    """The columns ``keep`` of each document, its figures, groups_sha256 and, where asked for, its groups.

    ``docs`` is read several times and must give the same rows in the same
    partitions each time, as files and written tables do. ``keep`` must not name
    one of the result's own columns.
    """
    bounded_batches(spark)
    stage, cuts = Stage(spark, "alignment"), tokens(a, b).cuts
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(docs["text"].cast("string").alias("text"))
    counted = texts.mapInArrow(partial(_count, a, b), "segment string, n long").groupBy("segment").agg(F.sum("n").alias("n"))
    encoded = stage.write(counted.mapInArrow(partial(_encode, a, b), _ENCODED).withColumn("sid", F.monotonically_increasing_id()), once=True)
    aligned = stage.write(align(encoded, parts), once=True)
    stage.drop(encoded)
    pairs = stage.write(pair_counts(aligned), once=True)
    size = pairs.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()

    def scored(some: DataFrame) -> DataFrame:
        """Segments with n_best and count_sum."""
        links = some.select(F.col("segment").alias("s_segment"), F.explode("links").alias("link"))
        told = links.join(F.broadcast(pairs), F.col("link") == F.col("pair")) if size[0] <= PAIRS else skewed_join(links, pairs, ("link", "pair"), "rows", size[1])
        scores = told.groupBy("s_segment").agg(F.sum("best").alias("n_best"), F.sum("count").alias("count_sum"))
        both = some.drop("links", "n").join(scores, F.col("segment") == F.col("s_segment"), "left").fillna(0, ["n_best", "count_sum"])  # one that doesn't come back whole may have no link
        return both.select("segment", "ok", *FIGURES, "groups")

    rows = docs.select(F.monotonically_increasing_id().alias("at"), docs["text"].cast("string").alias("text"), *columns_of(docs, *keep))
    often = scored(aligned.where(_often(aligned))).toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, often.schema) as out:
        out.write_table(often)
    frequent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    needed = rows.select("at", "text").mapInArrow(partial(_needed, cuts, frequent), "slice long, segment string").withColumnRenamed("segment", "r_segment")
    figures = needed.join(scored(aligned), F.col("r_segment") == F.col("segment")).drop("r_segment")
    kept = [f for f in rows.schema.fields if f.name not in ("at", "text")]
    tagged = rows.mapInArrow(_tagged, "slice long, text string" + "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in kept))
    out_schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept) + ", ".join(f"{c} long" for c in FIGURES) + ", groups_sha256 string, groups string"
    return tagged.groupBy("slice").cogroup(figures.groupBy("slice")).applyInArrow(partial(_fold, cuts, groups, frequent), out_schema)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import tokenizer_path

    docs = read(spark, sf_dir, "documents")
    found = align_documents(spark, docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"), ["doc_id"])
    return found.drop("groups")
