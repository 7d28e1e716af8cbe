"""Removal of repeated 100-byte strings.

``suffix_array`` builds a suffix array in linear grouping steps: suffixes are
grouped by their Lyndon prefix, the groups processed in descending order with
pointers to the previous smaller suffix, and the order emitted group by group.
It is applied where texts are alike, not to the whole corpus in one task:

1. Every 100-byte window is represented by an anchor inside it, the 32-byte run
   of least hash (the leftmost of equals). The choice depends on the window's
   bytes alone, so equal windows have equal anchors at equal places. Neighbouring
   windows mostly share their anchor; a run of such windows is one row's worth.
2. Anchors go to buckets as packed key fragments; a bucket tells which occur
   twice. Only runs with a shared anchor are looked at further. A key that a task
   has sent twice is shared for certain and not sent again.
3. Texts that an earlier document has as a whole need no further look. Runs with
   the same bytes are one context; all its occurrences but the first are repeats
   as a whole. Those that follow one in the same text are told where the text is,
   so a context meets others once per document only. The contexts of an anchor
   that has several are put through a suffix array, whose symbols are short blocks
   aligned at the anchor; suffixes with enough common symbols give the candidates,
   and the bytes of their windows decide which start elsewhere earlier. An anchor
   with more than ``HOT`` contexts (a run of blanks) would be too much for one array:
   its contexts are dealt by further symbols. Windows whose anchor stands at up to
   a block's places share the ``WHOLE`` blocks that all of them hold, so the part of a
   context that these windows cover goes to the array of those blocks; parts
   that were there before are repeats as a whole, as contexts are.
4. The intervals of each document are united and cut out of its text.

Whole texts are told apart by SHA-256, contexts and parts of contexts that are equal
as a whole by 128-bit digests, all windows of others by their bytes.
Defined cases: a null text is empty; rows of one doc_id are one document, so their equal
starts are not earlier than each other; null doc_ids come after all others; texts
shorter than the window lose nothing; other columns are ignored. A long text is taken
in segments, which needs about six bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import Stage, read, skewed_join
from gridloom.llm.textkernel import Sent, eights, mix, text_slices

WINDOW = 100
#: Bytes of text handled at once.
SLICE = 1 << 19
GRAM = 32
#: Anchor keys of a bucket, about; runs of a bucket of windows, about.
BUCKET_KEYS = 500_000
BUCKET_RUNS = 20_000
#: Contexts of an anchor that go through one suffix array at most; beyond, they are dealt to several.
HOT = 20_000
#: Windows whose anchors are found at once; a place among them and the anchor's width fits ``PLACE`` bits.
SEGMENT = 1 << 21
PLACE = 22
#: Bytes of a symbol of the suffix array, and symbols that any window holds in full.
BLOCK = 8
WHOLE = (WINDOW - BLOCK + 1) // BLOCK
#: Bytes of row marks that may be broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 64 << 20
LAST = (1 << 63) - 1


def suffix_array(text) -> list[int]:
    """Suffix array of a sequence of integers by linear grouping.

    Suffixes are kept in groups of equal Lyndon prefix known so far, groups in
    ascending order in one array. Groups are taken in descending order: for each
    suffix the nearest one before it of a lower group is found over the pointers
    of those done, and it gets the group's prefix appended, as often as it is
    found. So it moves behind its own group, the further the more often. In the
    end every group is one Lyndon prefix. Then the order is emitted from the
    smallest suffix on: an emitted suffix is the next smaller one of the
    suffixes on its left up the pointers, and each of these takes the next place
    of its group.
    """
    n = len(text)
    ranks = {v: i + 1 for i, v in enumerate(sorted(set(text)))}
    symbols = [ranks[v] for v in text] + [0]
    order = sorted(range(n + 1), key=symbols.__getitem__)
    place, start, size = [0] * (n + 1), [0] * (n + 1), [0] * (n + 2)
    for at, i in enumerate(order):
        place[i] = at
        start[i] = start[order[at - 1]] if at and symbols[i] == symbols[order[at - 1]] else at
        size[start[i]] += 1
    before = [-1] * (n + 1)
    at = n
    while at >= 0:
        low = start[order[at]]
        times: dict[int, int] = {}
        for i in sorted(order[low : at + 1]):
            p = i - 1
            while p >= 0 and start[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            parts: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                parts.setdefault((-k, start[p]), []).append(p)
            for (_, group), moved in sorted(parts.items()):
                size[group] -= len(moved)
                new = group + size[group]
                for k, p in enumerate(moved):  # swap to the end of what is left of the group
                    there, other = place[p], order[new + k]
                    order[new + k], order[there] = p, other
                    place[p], place[other] = new + k, there
                for p in moved:
                    start[p] = new
                size[new] = len(moved)
        at = low - 1
    out, free, placed = [0] * (n + 1), list(range(n + 1)), bytearray(n + 1)
    out[0], placed[n] = n, 1
    for at in range(n + 1):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            out[free[start[j]]] = j
            free[start[j]] += 1
            placed[j] = 1
            j = before[j]
    return out[1:]


def common_prefixes(text, suffixes: list[int]) -> list[int]:
    """Length of the common prefix of each suffix with the one before it in order."""
    n = len(suffixes)
    rank, out, k = [0] * n, [0] * n, 0
    for r, i in enumerate(suffixes):
        rank[i] = r
    for i in range(n):
        if rank[i]:
            j = suffixes[rank[i] - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            out[rank[i]] = k
            k = max(0, k - 1)
        else:
            k = 0
    return out


def equal_windows(parts: list[bytes], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Classes of two or more equal windows, each window as (part, start), found with a suffix array of all parts."""
    text, owner, base = [], [], []
    for k, part in enumerate(parts):
        base.append(len(text))
        text += part
        owner += [k] * (len(part) + 1)
        text.append(256 + k)  # an end of its own
    suffixes = suffix_array(text)
    out, now = [], []
    for i, common in zip(suffixes, common_prefixes(text, suffixes), strict=True):
        if common < window:
            if len(now) > 1:
                out.append(now)
            now = []
        now.append((owner[i], i - base[owner[i]]))
    if len(now) > 1:
        out.append(now)
    return out


def united(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for low, high in sorted(intervals):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def repeats_by_suffix_array(texts: list[tuple[int, bytes]], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """Repeated intervals of each of a few texts, by one suffix array."""
    removed: list[list[tuple[int, int]]] = [[] for _ in texts]
    for same in equal_windows([t for _, t in texts], window):
        first = min((texts[k][0], at) for k, at in same)
        for k, at in same:
            if (texts[k][0], at) > first:
                removed[k].append((at, at + window))
    return [united(r) for r in removed]


def grams_of(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each place on."""
    count = max(0, len(data) - GRAM + 1)
    eight = eights(data)
    h = np.full(count, 0x5851F42D4C957F2D, np.uint64)
    for at in range(0, GRAM, 8):
        h = mix(h ^ eight[at : at + count])
    return h


def anchors_of(data: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of the anchor of each of the first windows of ``data``.

    Hashes are compared in their upper bits, the same number of them everywhere,
    and then by place: the choice depends on the window's bytes alone.
    """
    grams = grams_of(data)
    count, width = len(grams), WINDOW - GRAM + 1
    low = np.uint64(PLACE)
    padded = np.full(-(-count // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:count] = grams >> low << low | np.arange(count, dtype=np.uint64)
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:windows], ahead[width - 1 : width - 1 + windows])
    anchor = (least & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    return anchor, grams[anchor]


class Runs:
    """Runs of windows with one anchor: start of the first window, of the last, place and key of the anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        parts = []
        for first in range(0, max(0, len(data) - WINDOW + 1), SEGMENT):
            windows = min(SEGMENT, len(data) - WINDOW + 1 - first)
            place = first + np.arange(windows)
            anchor, key = anchors_of(data[first : first + windows + WINDOW - 1], windows)
            text = np.searchsorted(offsets, place, "right") - 1 if len(offsets) > 2 else np.zeros(windows, np.int64)
            inside = place + WINDOW <= offsets[1:][text]
            place, anchor, key, text = place[inside], anchor[inside] + first, key[inside], text[inside]
            new = np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]))[: len(place)]
            at = np.flatnonzero(new)
            last = place[np.append(at[1:], len(place)) - 1] if len(at) else at
            # anchors are least hashes: mixed again, their keys are spread evenly
            parts.append((place[at], last, anchor[at], text[at], mix(key[at])))
        none = np.zeros(0, np.int64)
        self.low, self.high, self.anchor, self.text, self.key = (np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (none, none, none, none, none.astype(np.uint64))


def send_anchors(buckets: int):
    """Rows (bucket, unit, keys, run numbers), a row (unit, run numbers) of keys known to be shared, and one row (unit, row keys and documents, runs of each row)."""
    bits = buckets.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sent = TaskContext.get().partitionId() << 24, Sent()
        for batch in batches:
            for low, high, data, offsets in text_slices(batch, batch.schema.get_field_index("text"), SLICE):
                unit += 1
                runs = Runs(data, offsets)
                order = np.argsort(runs.key, kind="stable")
                keys, own = runs.key[order], order.astype(np.uint32)
                ask = sent.split(keys)
                shared = own[~ask].tobytes()
                keys, own = keys[ask], own[ask]
                bounds = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(buckets + 1, dtype=np.uint64))
                short = (keys >> np.uint64(32 - bits)).astype(np.uint32)
                filled = np.flatnonzero(np.diff(bounds)).tolist()
                head = np.stack([batch.column(c).slice(low, high - low).to_numpy().astype(np.int64) for c in ("row_key", "doc")]).tobytes()
                counts = np.bincount(runs.text, minlength=high - low).astype(np.int32).tobytes()
                first = [short[bounds[b] : bounds[b + 1]].tobytes() for b in filled] + [None, head]
                second = [own[bounds[b] : bounds[b + 1]].tobytes() for b in filled] + [shared, counts]
                bucket = [*filled, unit % buckets, unit % buckets]
                columns = [pa.array(bucket, pa.int32()), pa.array([unit] * len(bucket), pa.int64()), pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array([False] * (len(filled) + 1) + [True])]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "unit", "keys", "owners", "head"])

    return run


def shared_anchors(table: pa.Table) -> pa.Table:
    """Of a bucket: for each unit the numbers of runs whose key occurs twice. Heads and runs of shared keys pass through."""
    rows = table.select(["unit", "keys", "owners", "head"]).to_pylist()
    out = [r for r in rows if r["head"] or r["keys"] is None]
    rows = [r for r in rows if not r["head"] and r["keys"] is not None]
    if rows:
        parts = [np.frombuffer(r["keys"], np.uint32) for r in rows]
        keys = np.concatenate(parts)
        found = np.sort(keys)
        equal = found[1:][found[1:] == found[:-1]]
        twice = equal[np.append(True, equal[1:] != equal[:-1])[: len(equal)]]
        if len(twice):
            at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
            hit = np.flatnonzero(twice[at] == keys)
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            bounds = np.searchsorted(hit, starts)
            for r, start, a, b in zip(rows, starts[:-1], bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    out.append({"unit": r["unit"], "keys": None, "owners": np.frombuffer(r["owners"], np.uint32)[hit[a:b] - start].tobytes(), "head": False})
    return pa.Table.from_pylist(out, schema=pa.schema([("unit", pa.int64()), ("keys", pa.binary()), ("owners", pa.binary()), ("head", pa.bool_())]))


def marks_of_unit(table: pa.Table) -> pa.Table:
    """(m_key, m_doc, marks): for each row the numbers of its runs with a shared anchor."""
    rows = table.select(["keys", "owners", "head"]).to_pylist()
    head = next(r for r in rows if r["head"])
    (keys, docs), counts = np.frombuffer(head["keys"], np.int64).reshape(2, -1), np.frombuffer(head["owners"], np.int32).astype(np.int64)
    runs = np.sort(np.concatenate([np.zeros(0, np.uint32), *[np.frombuffer(r["owners"], np.uint32) for r in rows if not r["head"]]]).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.searchsorted(runs, starts)
    picked = [i for i in range(len(keys)) if bounds[i + 1] > bounds[i]]
    marks = [(runs[bounds[i] : bounds[i + 1]] - starts[i]).astype(np.uint32).tobytes() for i in picked]
    return pa.table({"m_key": pa.array(keys[picked], pa.int64()), "m_doc": pa.array(docs[picked], pa.int64()), "marks": pa.array(marks, pa.binary())})


def digest(raw: bytes) -> bytes:
    return blake2b(raw, digest_size=16).digest()


def emit_contexts(with_bytes: bool):
    """One row per marked run: what tells it apart and where it is, or its bytes too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("marks").to_pylist()
            docs, keys = batch.column("doc").to_numpy(), batch.column("row_key").to_numpy()
            for low, high, data, offsets in text_slices(batch, batch.schema.get_field_index("text"), SLICE):
                runs = Runs(data, offsets)
                starts = np.searchsorted(runs.text, np.arange(high - low))
                pick = np.concatenate([np.frombuffer(marks[low + i], np.uint32).astype(np.int64) + starts[i] for i in range(high - low)])
                a, b, text = runs.low[pick], runs.high[pick] + WINDOW, runs.text[pick]
                lead = runs.anchor[pick] - a
                raw = data.tobytes()
                out = {"key": runs.key[pick].view(np.int64), "doc": docs[low + text], "row_key": keys[low + text], "low": a - offsets[text]}
                if with_bytes:
                    out |= {"lead": lead.astype(np.int32), "bytes": pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())}
                else:
                    context = [digest(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                    # a context that the same text had before is a repeat already
                    half = np.frombuffer(b"".join(context), np.uint64).reshape(-1, 2).T
                    order = np.lexsort((a, half[1], half[0], text))
                    known = np.zeros(len(pick), bool)
                    known[order[1:]] = (half[:, order[1:]] == half[:, order[:-1]]).all(0) & (text[order[1:]] == text[order[:-1]])
                    out |= {"known": known, "context": pa.array(context, pa.binary()), "windows": (b - a - WINDOW + 1).astype(np.int32), "run": (pick - starts[text]).astype(np.int32)}
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v) for v in out.values()], names=[*out])

    return run


def emit_dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts with their bytes, cut into parts: the windows that begin between k and k + 1 blocks before the anchor, for each k.

    ``key`` is a hash of the blocks that all windows of a part hold, ``context`` tells parts apart.
    """
    for batch in batches:
        for first in range(0, batch.num_rows, 1000):
            part = batch.slice(first, 1000)
            keys, leads, raws = (part.column(c).to_pylist() for c in ("key", "lead", "bytes"))
            out: list[tuple] = []
            for n, (key, lead, raw) in enumerate(zip(keys, leads, raws, strict=True)):
                least, most = lead - (len(raw) - WINDOW), lead
                for k in range(max(0, least) // BLOCK, most // BLOCK + 1):
                    near, far = max(least, k * BLOCK), min(most, k * BLOCK + BLOCK - 1)
                    start, own = lead - far, raw[lead - far : lead - near + WINDOW]
                    held = raw[lead - k * BLOCK : lead + (WHOLE - k) * BLOCK]
                    deal = int.from_bytes(digest(held + key.to_bytes(8, "little", signed=True) + bytes([k]))[:8], "little", signed=True)
                    out.append((n, deal, start, far, own, digest(own + bytes([far]))))
            if not out:
                continue
            n, deal, start, far, own, same = zip(*out, strict=True)
            at = np.array(n)
            columns = [pa.array(deal, pa.int64()), *[pa.array(part.column(c).to_numpy()[at]) for c in ("doc", "row_key")], pa.array(part.column("low").to_numpy()[at] + np.array(start)), pa.array(far, pa.int32()), pa.array(own, pa.binary()), pa.array(same, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "doc", "row_key", "low", "lead", "bytes", "context"])


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run numbers of a row as one string of bytes."""
    for batch in batches:
        marks = [np.sort(np.array(v, np.uint32)).tobytes() for v in batch.column("runs").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("hot"), batch.column("row_key"), batch.column("doc"), pa.array(marks, pa.binary())], names=["hot", "m_key", "m_doc", "marks"])


def equal_aligned(contexts: list[bytes], leads: list[int], window: int = WINDOW) -> Iterator[list[tuple[int, int]]]:
    """Classes of two or more equal windows of contexts around one anchor, each window as (context, start).

    Blocks of ``BLOCK`` bytes, aligned at the anchor, are the symbols of the
    suffix array. Any window holds ``whole`` blocks in full at least, so equal
    windows begin, up to less than a block before, at suffixes with that many
    common symbols. Neighbours in the array that have them form a class, and the
    bytes of its windows decide.
    """
    whole = (window - BLOCK + 1) // BLOCK
    symbols: dict[bytes, int] = {}
    text, owner = [], []
    for k, (raw, lead) in enumerate(zip(contexts, leads, strict=True)):
        for at in range(lead % BLOCK, len(raw) - BLOCK + 1, BLOCK):
            block = raw[at : at + BLOCK]
            text.append(symbols.setdefault(block, len(symbols)))
            owner.append((k, at))
        text.append(-1 - k)  # an end of its own
        owner.append((k, -1))
    suffixes = suffix_array(text)
    now: list[int] = []
    for i, common in [*zip(suffixes, common_prefixes(text, suffixes), strict=True), (0, 0)]:
        if common < whole:
            if len(now) > 1:
                same: dict[bytes, list[tuple[int, int]]] = {}
                for j in now:
                    k, at = owner[j]
                    raw = contexts[k]
                    for start in range(max(0, at - BLOCK + 1), min(at, len(raw) - window) + 1):
                        same.setdefault(raw[start : start + window], []).append((k, start))
                yield from (found for found in same.values() if len(found) > 1)
            now = []
        now.append(i)


def repeated_windows(table: pa.Table) -> pa.Table:
    """Of a bucket of contexts: intervals (row_key, doc, low, high) of windows that start earlier elsewhere."""
    table = table.sort_by("key")
    keys, doc, row, low, lead, raw = (table.column(k).to_pylist() for k in ("key", "doc", "row_key", "low", "lead", "bytes"))
    out: list[tuple[int, int, int, int]] = []
    start = 0
    for stop in range(1, len(keys) + 1):
        if stop < len(keys) and keys[stop] == keys[start]:
            continue
        later: dict[int, list[tuple[int, int]]] = {}
        for same in equal_aligned(raw[start:stop], lead[start:stop]):
            places = [(doc[start + k], low[start + k] + at, start + k) for k, at in same]
            first = min(places)[:2]
            for d, at, k in places:
                if (d, at) != first:
                    later.setdefault(k, []).append((at, at + WINDOW))
        out += [(row[k], doc[k], a, b) for k, found in later.items() for a, b in united(found)]
        start = stop
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("i_key", "i_doc", "low", "high"), columns, strict=True)})


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlapping and adjacent intervals of each row as one."""
    kind = pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            lists = part.column(2)
            flat = lists.flatten()
            low, high = flat.field("low").to_numpy(), flat.field("high").to_numpy()
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            out = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                order = np.argsort(low[a:b], kind="stable")
                start, end = low[a:b][order], np.maximum.accumulate(high[a:b][order])
                cut = np.flatnonzero(np.append(True, start[1:] > end[:-1]))
                out.append([{"low": x, "high": y} for x, y in zip(start[cut].tolist(), end[np.append(cut[1:], len(start)) - 1].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, kind)], names=["i_key", "i_doc", "spans"])


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            data, removed = (text or "").encode(), united([(s["low"], s["high"]) for s in spans or ()])
            kept, at = sha256(), 0
            for a, b in removed:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            out.append((len(data), sum(b - a for a, b in removed), len(removed), kept.hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _joined(stage_rows: DataFrame, texts: DataFrame, key: str, size: str, how: str) -> DataFrame:
    """``texts`` joined on row_key and doc with a written table of rows, by broadcast if that is small.

    Beyond that the rows are in the order of their keys, so that a task that is run again
    sees them in the same order.
    """
    total = stage_rows.agg(F.sum(F.expr(size))).first()[0] or 0
    small = total <= BROADCAST_BYTES
    found = texts.join(F.broadcast(stage_rows) if small else stage_rows, (F.col("row_key") == F.col(f"{key}_key")) & (F.col("doc") == F.col(f"{key}_doc")), how)
    return found if small else found.sortWithinPartitions("row_key", "doc")


def later_ones(stage: Stage, places: DataFrame, key: str) -> DataFrame:
    """``places`` (doc, low, ...) with ``again``: whether the key has an earlier place. A key's rows need not meet in one task."""
    first = places.groupBy(F.col(key).alias("p_key")).agg(F.min(F.struct("doc", "low")).alias("first"), F.count(F.lit(1)).alias("rows"))
    first = stage.write(first)
    told = skewed_join(places, first, (key, "p_key"), "rows", places.count())
    out = stage.write(told.withColumn("again", (F.col("doc") != F.col("first.doc")) | (F.col("low") != F.col("first.low"))).drop("first"))
    stage.drop(first)
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row."""
    stage = Stage(spark, "suffix-dedup")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    rows = rows.withColumns({"row_key": F.xxhash64("text"), "doc": F.coalesce("doc_id", F.lit(LAST))})
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, int(np.ceil(np.log2(max(1, size * 2 / (WINDOW - GRAM + 2) / BUCKET_KEYS)))))
    texts = rows.where(F.octet_length("text") >= WINDOW)
    # a text that an earlier document has as a whole is all repeats
    named = stage.write(texts.select("doc", "row_key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("same"), F.octet_length("text").cast("long").alias("bytes")))
    least = stage.write(named.groupBy(F.col("same").alias("l_same")).agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    copies = skewed_join(named, least, ("same", "l_same"), "rows", named.count()).where("doc > first")
    copies = stage.write(copies.select(F.col("row_key").alias("c_key"), F.col("doc").alias("c_doc"), "bytes").distinct())
    stage.drop(named)
    stage.drop(least)
    texts = _joined(copies.select("c_key", "c_doc"), texts, "c", "32", "left_anti")
    sent = texts.select("row_key", "doc", "text").mapInArrow(send_anchors(buckets), "bucket int, unit long, keys binary, owners binary, head boolean")
    shared = sent.groupBy("bucket").applyInArrow(shared_anchors, "unit long, keys binary, owners binary, head boolean")
    marks = stage.write(shared.groupBy("unit").applyInArrow(marks_of_unit, "m_key long, m_doc long, marks binary").dropDuplicates(["m_key", "m_doc"]))
    marked = _joined(marks, texts, "m", "length(marks) + 40", "inner")
    where = "key long, doc long, row_key long, low long, "
    contexts = stage.write(marked.select("doc", "text", "row_key", "marks").mapInArrow(emit_contexts(False), where + "known boolean, context binary, windows int, run int"))
    # every occurrence of a context but the first is a repeat
    placed = later_ones(stage, contexts.where("NOT known"), "context")
    span = ["row_key", "doc", "low", "windows"]
    whole = placed.where("again").select(*span).unionByName(contexts.where("known").select(*span))
    whole = whole.select(F.col("row_key").alias("i_key"), F.col("doc").alias("i_doc"), "low", (F.col("low") + F.col("windows") - 1 + WINDOW).alias("high"))
    whole = whole.unionByName(copies.select(F.col("c_key").alias("i_key"), F.col("c_doc").alias("i_doc"), F.lit(0).cast("long").alias("low"), F.col("bytes").alias("high")))
    # bytes of the first occurrences of contexts whose anchor has several
    firsts = placed.where("NOT again").select("key", "row_key", "doc", "run")
    several = stage.write(firsts.groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    firsts = skewed_join(firsts, several.withColumn("hot", F.col("rows") > HOT), ("key", "s_key"), "rows", contexts.count())
    # dealt out before they are gathered: what a row costs then does not depend on the number of tasks
    named = firsts.select("row_key", "doc", "run", "hot").repartition("row_key").groupBy("row_key", "doc", "hot").agg(F.collect_set("run").alias("runs"))
    again = stage.write(named.mapInArrow(packed, "hot boolean, m_key long, m_doc long, marks binary"))
    intervals = whole
    for hot in (False, True):
        own = again.where(F.col("hot") == hot).drop("hot")
        number = own.agg(F.sum(F.length("marks") / 4)).first()[0] or 0
        if not number:
            continue
        bytes_of = _joined(own, texts, "m", "length(marks) + 40", "inner").select("doc", "text", "row_key", "marks").mapInArrow(emit_contexts(True), where + "lead int, bytes binary")
        found = "i_key long, i_doc long, low long, high long"
        if hot:
            dealt = later_ones(stage, stage.write(bytes_of.mapInArrow(emit_dealt, where + "lead int, bytes binary, context binary")), "context")
            ends = (F.col("low") + F.octet_length("bytes")).cast("long").alias("high")
            intervals = intervals.unionByName(dealt.where("again").select(F.col("row_key").alias("i_key"), F.col("doc").alias("i_doc"), "low", ends))
            # parts that share their blocks with another one
            bytes_of = dealt.where("NOT again").drop("again", "context", "rows")
            some = stage.write(bytes_of.groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
            number = some.agg(F.sum("n")).first()[0] or 0
            bytes_of = bytes_of.join(some, F.col("key") == F.col("s_key"), "left_semi")
        parts = max(1, -(-int(number) // BUCKET_RUNS))
        found = bytes_of.withColumn("part", F.pmod("key", F.lit(parts))).groupBy("part").applyInArrow(lambda t: repeated_windows(t), found)
        intervals = intervals.unionByName(found)
    spans = intervals.repartition("i_key").groupBy("i_key", "i_doc").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    spans = stage.write(spans.mapInArrow(unite, "i_key long, i_doc long, spans array<struct<low:long,high:long>>"))
    stage.keep(spans)
    out = _joined(spans, rows, "i", "16 * size(spans) + 40", "left")
    return out.select("doc_id", "text", "spans").mapInArrow(cut_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, read(spark, sf_dir, "documents"))
