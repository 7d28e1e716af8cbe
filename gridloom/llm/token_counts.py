"""Token counts, with overlapping chunks of huge documents resynchronised.

Documents up to ``HUGE`` characters are encoded whole. A longer one is encoded
in overlapping chunks with offsets. Two neighbouring chunks are spliced at a
character position inside their overlap that is a token boundary in both and
lies between a letter or digit and a single blank that no white space follows:
the byte-level pre-tokenizer never has a match across such a place, whatever
stands before it, so the tokens before it depend only on the left part and the
tokens after it only on the right part. Where the overlap has no such place, it is
widened, up to the end of the document, and the chunk encoded again. Memory is
bounded by the chunk for all texts that have single blanks, and the counts are
those of the whole text in every case.

Defined cases: a null or empty text has no bytes and no tokens; repeated rows
are counted each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm._common import bounded_batches, read

LIMIT = 1024
HUGE = 32_768
OVERLAP = 512
#: Characters of texts encoded at once.
BATCH = 1 << 18

_TOKENIZERS: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _stable(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1].isalnum() and not text[at + 1].isspace()


def _ends(found) -> list[int]:
    return [b for _, b in found.offsets]


def count_huge(encode, text: str, chunk: int = HUGE, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``; ``encode`` takes a string and gives ids and offsets."""
    total, start, low = 0, 0, 0  # the chunk starts at ``start``; its tokens count from ``low`` on
    stop = min(len(text), chunk)
    found = encode(text[start:stop])
    while stop < len(text):
        left_ends = _ends(found)
        wide = overlap
        while True:
            from_ = max(low, stop - wide)
            to = min(len(text), from_ + chunk + wide - overlap)
            right = encode(text[from_:to])
            right_ends = set(_ends(right))
            place = None
            for end in reversed(left_ends):
                at = start + end
                if at <= from_:
                    break
                if at < stop and _stable(text, at) and at - from_ in right_ends:
                    place = at
                    break
            if place is not None:
                break
            if from_ == low and to == len(text):
                # nothing to splice: what is left is encoded as one piece
                return total + len(right.ids)
            if from_ == low:
                # the whole chunk has no common place: grow the left chunk instead
                stop = min(len(text), stop + chunk)
                found = encode(text[start:stop])
                left_ends = _ends(found)
                if stop == len(text):
                    return total + sum(1 for e in left_ends if start + e > low)
            wide *= 2
        total += bisect_right(left_ends, place - start) - bisect_right(left_ends, low - start) if low > start else bisect_right(left_ends, place - start)
        start, low, stop, found = from_, place, to, right
    ends = _ends(found)
    return total + len(ends) - (bisect_right(ends, low - start) if low > start else 0)


def counts(path: str, limit: int, huge: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        encode = lambda s: own.encode(s, add_special_tokens=False)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = [0] * len(texts)
            group: list[int] = []
            held = 0

            def flush():
                nonlocal group, held
                for i, e in zip(group, own.encode_batch_fast([texts[i] for i in group], add_special_tokens=False), strict=True):
                    found[i] = len(e)
                group, held = [], 0

            for i, text in enumerate(texts):
                if len(text) > huge:
                    found[i] = count_huge(encode, text, huge, overlap)
                elif text:
                    group.append(i)
                    held += len(text)
                    if held > BATCH:
                        flush()
            if group:
                flush()
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return run


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, huge: int = HUGE, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    return rows.mapInArrow(counts(path, limit, huge, overlap), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.packing import tokenizer_path

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
