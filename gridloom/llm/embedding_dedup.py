"""Embedding near-duplicates over a robust-pruned flat graph.

Vectors are normalised in double precision and equal ones collapsed. Groups that
no shard could hold (see below) are set apart. Centroids
are fitted on a bounded sample; each other vector joins the shards of its nearest
centroids, so that shards overlap. In each shard every vector gets its nearest
ones as candidates, pruned robustly: a candidate goes if a chosen neighbour is
nearer to it, by a factor, than the vector itself. The adjacency lists of a
vector's shards are united. Then each shard searches for its own vectors on the
united graph: greedily from the shard's medoid and from the vector's own node to
the nearest vectors, then expanding over all nodes within the range, a little
beyond it so that a link is not lost behind a node just outside. Neighbours in the
range that belong to other shards come along as the shard's fringe, with their own
lists, so that the search crosses shards where links may. Pairs found are verified
by their cosine; a link counts in the first of the vector's shards that hold the other.

A group of near copies larger than ``DENSE`` would spread over shards that each see
a part of its links, so the sample is searched for the middles of such groups. What
lies around a middle is a cell: a core, within half the threshold's angle, and a
shell. By the angle to the middle each vector of the table is surely linked with
all members of a cell, or with none, or neither is sure. Sure links are counted by
the cell, so a core costs no pairs at all; the rest is compared exactly, in blocks of
``BLOCK`` by ``BLOCK`` vectors. Vectors in cells are no nodes of the graph.

Whatever the sizes of shards, groups and lists, a task's kernels hold about
``HELD`` numbers of a kind at once beside the shard's or block's own rows.

Vectors outside of cells are drawn and compared with all such rows, in blocks, until ``AUDIT`` of them
have a few links; those with few and with many links are judged apart, as a mean
over the vectors and over the links, so that a large group hides no small one. If
the search found less than ``RECALL`` of any, the shards' overlap is doubled and
the graph built again. Too few linked vectors are no evidence: pairs made at the
threshold then fill up for them, found if they share a shard. A shard's output is
its vectors' link counts and a spanning forest of its links, so it grows with the
vectors, not with their pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; so do vectors of different lengths with each
other; repeated rows link with each other; null vec_ids take part but name no
component unless alone; other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._common import Stage, read, skewed_join
from gridloom.llm.components import components

THRESHOLD = 0.9
#: How far below the threshold the search still expands.
SLACK = 0.05
#: Sample for the centroids, their largest number, and the vectors of a shard aimed at.
SAMPLE = 20_000
MOST_SHARDS = 4_096
SHARD = 1_000
OVERLAP = 2
#: Centroids nearer than this are one, so that no group of near copies lies between them.
MERGED = 0.985
#: Vectors of a group that is set apart, vectors of the sample tried as its middle, vectors of a side of a block of pairs.
DENSE = 1_000
TRIED = 2_500
BLOCK = 2_048
#: Numbers of a kind that a kernel holds at once.
HELD = 2 << 20
#: More than the rounding of an angle's cosine.
ROUNDING = 1e-7
#: Candidates and neighbours of a node, the factor of the pruning, the beam of the search.
CANDIDATES = 40
DEGREE = 20
ALPHA = 1.2
BEAM = 16
#: Linked vectors that the audit wants, the fewest links that are many, how many vectors are drawn at most after each step, and judged of a kind.
AUDIT = 100
MANY = 16
DRAWN = (1_000, 4_000, 16_000)
JUDGED = 500
RECALL = 0.95

log = logging.getLogger(__name__)


def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, node (digest of the unit vector, null if there is none), unit vector as bytes."""
    for batch in batches:
        nodes, units, column = [], [], batch.column(1)
        flat, ends, given = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(column)):
            x = flat[ends[i] : ends[i + 1]] if given[i] else np.zeros(0)  # null components are NaN here
            norm = np.sqrt((x * x).sum()) if len(x) and np.isfinite(x).all() else 0.0
            if norm > 0 and not np.isfinite(norm) or 0 < norm < 1e-150:  # squares overflow or vanish
                x = x / np.abs(x).max()
                norm = np.sqrt((x * x).sum())
            if norm > 0:
                u = (x / norm).tobytes()
                units.append(u)
                nodes.append(blake2b(u, digest_size=16).digest())
            else:
                units.append(None)
                nodes.append(None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.binary()), pa.array(units, pa.binary())], names=["vec_id", "node", "unit"])


def matrix(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(b, np.float64) for b in column.to_pylist()]


def centroids(sample: list[np.ndarray], k: int, rounds: int = 8) -> np.ndarray:
    x = np.array(sample)
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(x[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(x), 2048)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    kept = [0]
    for i in range(1, len(c)):
        if (c[kept] @ c[i]).max() < MERGED:
            kept.append(i)
    return c[kept]


def products(units: list[np.ndarray], middle: dict[int, np.ndarray]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(numbers of the rows, number of the first middle, cosines to the middles) by length, so many rows at a time that ``HELD`` bounds them."""
    base = 0
    for d in sorted(middle):
        own = np.array([i for i, u in enumerate(units) if len(u) == d], int)
        step = max(1, HELD // max(1, d, len(middle[d])))
        for low in range(0, len(own), step):
            rows = own[low : low + step]
            yield rows, base, np.array([units[i] for i in rows]) @ middle[d].T
        base += len(middle[d])


def assign(middle: dict[int, np.ndarray], overlap: int):
    """Rows (node, unit, size, shards): the nearest shards by number. Shards of different dimensions are apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column("unit"))
            shards = [[-len(u)] for u in units]  # a length that the sample missed: one shard of its own
            for rows, base, cosine in products(units, middle):
                near = np.argpartition(-cosine, overlap - 1, axis=1)[:, :overlap] if overlap < cosine.shape[1] else np.tile(np.arange(cosine.shape[1]), (len(rows), 1))
                for i, own in zip(rows, np.sort(near + base, axis=1).tolist(), strict=True):
                    shards[i] = own
            kept = batch.select(["node", "unit", "size"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shards, pa.list_(pa.int64()))], names=["node", "unit", "size", "shards"])

    return run


def robust_prune(x: np.ndarray, near: np.ndarray, degree: int, alpha: float, rows: np.ndarray | None = None) -> list[np.ndarray]:
    """Neighbours kept of the candidates (nearest first, -1: none) of each row, or of the ``rows``, by squared distance."""
    rows = np.arange(len(near)) if rows is None else rows
    step = max(1, HELD // max(1, near.shape[1] * x.shape[1]))
    return [own for low in range(0, len(rows), step) for own in _pruned(x, near[low : low + step], x[rows[low : low + step]], degree, alpha)]


def _pruned(x: np.ndarray, near: np.ndarray, centre: np.ndarray, degree: int, alpha: float) -> list[np.ndarray]:
    n, width = near.shape
    alive, kept, count = near >= 0, np.zeros((n, width), bool), np.zeros(n, int)
    around = x[np.maximum(near, 0)]
    own = 2 - 2 * np.einsum("ijk,ik->ij", around, centre)
    pairs = 2 - 2 * around @ around.transpose(0, 2, 1) if width <= x.shape[1] else None  # else only those asked for
    for j in range(width):
        rows = np.flatnonzero(alive[:, j] & (count < degree))
        if len(rows):
            kept[rows, j] = True
            count[rows] += 1
            between = pairs[rows, j] if pairs is not None else 2 - 2 * np.einsum("ijk,ik->ij", around[rows], around[rows, j])
            alive[rows] &= alpha * alpha * between > own[rows]
    return [near[i][kept[i]] for i in range(n)]


def nearest(x: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` nearest others of each row, nearest first."""
    n = len(x)
    width = min(width, n - 1)
    out = np.full((n, max(width, 1)), -1)
    step = max(1, HELD // max(1, n))
    for i in range(0, n, step):
        s = x[i : i + step] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        if width:
            part = np.argpartition(-s, width - 1, axis=1)[:, :width]
            out[i : i + len(s)] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
    return out


def build(least: float):
    def run(table: pa.Table) -> pa.Table:
        """(node, neighbours, close) of one shard, with reverse edges, pruned to ``DEGREE``; close ones are within ``least``."""
        table = table.sort_by("node")
        x, nodes = np.array(matrix(table.column("unit"))), table.column("node").to_pylist()
        kept = robust_prune(x, nearest(x, CANDIDATES), DEGREE, ALPHA)
        both: list[set[int]] = [set(k.tolist()) for k in kept]
        for i, k in enumerate(kept):
            for j in k.tolist():
                both[j].add(i)
        width = np.array([len(b) for b in both])
        if width.max(initial=0) > DEGREE:
            order = np.argsort(width, kind="stable")  # few rows have many, as those of a hub
            for low in range(0, len(order), 256):
                rows = order[low : low + 256]
                ranked = np.full((len(rows), max(1, width[rows[-1]])), -1)
                for k, i in enumerate(rows.tolist()):
                    own = np.fromiter(both[i], int, len(both[i]))
                    ranked[k, : len(own)] = own[np.lexsort((own, -(x[own] @ x[i])))]
                for i, again in zip(rows.tolist(), robust_prune(x, ranked, DEGREE, 1.0, rows), strict=True):
                    both[i] = {*again.tolist(), *kept[i].tolist()}
        lists = [sorted(b) for b in both]
        close = [[j for j, inside in zip(b, x[b] @ x[i] >= least, strict=True) if inside] if b else [] for i, b in enumerate(lists)]
        named = [pa.array([[nodes[j] for j in b] for b in some], pa.list_(pa.binary())) for some in (lists, close)]
        return pa.table({"node": pa.array(nodes, pa.binary()), "neighbours": named[0], "close": named[1]})

    return run


def greedy(x: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: int, beam: int) -> np.ndarray:
    """Beam of nearest nodes (-1: none) of each query, from the entry and the query's own node."""
    n = len(queries)
    ids = np.full((n, beam), -1)
    ids[:, 0] = entry
    if beam > 1:
        ids[:, 1] = np.where(queries == entry, -1, queries)
    sims = np.where(ids >= 0, np.einsum("ijk,ik->ij", x[np.maximum(ids, 0)], x[queries]), -np.inf)
    done = ids < 0
    while True:
        rows = np.flatnonzero(~done.all(1))
        if not len(rows):
            return ids
        pick = np.where(done[rows], -np.inf, sims[rows]).argmax(1)
        done[rows, pick] = True
        new = links[ids[rows, pick]]
        known = (new[:, :, None] == ids[rows][:, None, :]).any(2) | (new < 0)
        value = np.where(known, -np.inf, np.einsum("ijk,ik->ij", x[np.maximum(new, 0)], x[queries[rows]]))
        all_ids, all_sims = np.hstack([ids[rows], new]), np.hstack([sims[rows], value])
        all_done = np.hstack([done[rows], known])
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_sims, all_done))
        done[rows] |= ~np.isfinite(sims[rows])


def expand(x: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, node, cosine) of all nodes within ``least`` that are reached over nodes within it."""
    n = len(x)
    seen = np.zeros(len(queries) * n, bool)
    key = np.unique((np.arange(len(queries))[:, None] * n + start)[start >= 0])
    seen[key] = True
    few, step = max(1, HELD // x.shape[1]), max(1, HELD // links.shape[1])
    found, cosines = [np.zeros(0, int)], [np.zeros(0)]
    while len(key):
        cosine = np.concatenate([np.einsum("ij,ij->i", x[queries[k // n]], x[k % n]) for k in (key[i : i + few] for i in range(0, len(key), few))])
        key = key[cosine >= least]
        found.append(key)
        cosines.append(cosine[cosine >= least])
        fresh = [key[:0]]
        for low in range(0, len(key), step):
            some = key[low : low + step]
            new = links[some % n]
            new = ((some // n * n)[:, None] + new)[new >= 0]
            new = np.unique(new[~seen[new]])
            seen[new] = True
            fresh.append(new)
        key = np.concatenate(fresh)
    key = np.concatenate(found)
    return key // n, key % n, np.concatenate(cosines)


def tie(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node known to be connected with each, after pairs are joined; ``parent`` is the one before."""
    while True:
        low, high = np.minimum(parent[a], parent[b]), np.maximum(parent[a], parent[b])
        apart = low < high
        if not apart.any():
            return parent
        a, b = a[apart], b[apart]
        parent = parent.copy()
        np.minimum.at(parent, high[apart], low[apart])
        while not (parent[parent] == parent).all():
            parent = parent[parent]


def outcome(nodes: list[bytes], count: np.ndarray, parent: np.ndarray) -> pa.Table:
    """(node, other, links): link counts per node, and the edges of a spanning forest."""
    some, tied = np.flatnonzero(count).tolist(), np.flatnonzero(parent != np.arange(len(nodes))).tolist()
    tied = [(nodes[i], nodes[p]) for i, p in zip(tied, parent[tied].tolist(), strict=True) if nodes[i] != nodes[p]]
    node = [nodes[i] for i in some] + [a for a, _ in tied]
    links = np.concatenate([count[some], np.zeros(len(tied), np.int64)])
    return pa.table({"node": pa.array(node, pa.binary()), "other": pa.array([None] * len(some) + [b for _, b in tied], pa.binary()), "links": pa.array(links, pa.int64())})


def search(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Of one shard and its fringe: (node, other, links): link counts per node, and the edges of a spanning forest."""
        table = table.sort_by("node")
        x, nodes, shard = np.array(matrix(table.column("unit"))), table.column("node").to_pylist(), table.column("shard")[0].as_py()
        size = table.column("size").to_numpy()
        homes, fringes = table.column("shards").to_pylist(), table.column("fringe").to_pylist()
        lists = table.column("neighbours").combine_chunks()
        row, other = pc.list_parent_indices(lists).to_numpy(), pc.index_in(pc.list_flatten(lists), value_set=table.column("node").combine_chunks()).fill_null(-1).to_numpy()
        row, other = row[other >= 0], other[other >= 0]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        links = np.full((len(nodes), place.max(initial=0) + 1), -1, np.int32)
        links[row, place] = other
        members = np.array([i for i, own in enumerate(homes) if shard in own])
        # of each member the shards before this one, and whether they hold a node
        before = [[s for s in own if s < shard] if shard in own else [] for own in homes]
        number = {s: k for k, s in enumerate(sorted({s for own in before for s in own}))}
        held = np.zeros((len(nodes), len(number) + 1), bool)
        for i, own in enumerate(homes):
            held[i, [number[s] for s in {*own, *(fringes[i] or ())} if s in number]] = True
        earlier = np.full((len(nodes), max(1, max(map(len, before)))), len(number))
        for i, own in enumerate(before):
            earlier[i, : len(own)] = [number[s] for s in own]
        medoid = int(members[(x[members] @ x[members].mean(0)).argmax()])
        count, parent = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
        step = max(1, min(256, HELD // len(nodes), 4 * HELD // (links.shape[1] * x.shape[1])))
        for low in range(0, len(members), step):
            queries = members[low : low + step]
            q, node, cosine = expand(x, links, queries, greedy(x, links, queries, medoid, BEAM), threshold - SLACK)
            q = queries[q]
            good = (q != node) & (cosine >= threshold)
            q, node = q[good], node[good]
            for some in np.array_split(np.arange(len(q)), -(-len(q) * earlier.shape[1] // HELD) or 1):
                first = some[~held[node[some, None], earlier[q[some]]].any(1)]
                np.add.at(count, q[first], size[node[first]])
            parent = tie(parent, q, node)
        return outcome(nodes, count, parent)

    return run


def middles(sample: list[np.ndarray], need: int, threshold: float) -> np.ndarray:
    """Of groups that have ``need`` or more vectors of the sample around their middle: the middles."""
    x = np.array(sample)
    left, out, step = np.ones(len(x), bool), [], max(1, HELD // len(x))
    near = np.concatenate([(x[i : i + step][: TRIED - i] @ x.T >= threshold).sum(1) for i in range(0, min(TRIED, len(x)), step)])
    for i in np.argsort(-near, kind="stable"):
        if near[i] < need:
            break
        if left[i]:
            own = left & (x @ x[i] >= threshold)
            for _ in range(4):
                if own.sum() < need:
                    break
                middle = x[own].sum(0) / np.linalg.norm(x[own].sum(0))
                own = left & (x @ middle >= np.sqrt(threshold))
            if own.sum() >= need:
                out.append(middle)
                left &= ~own
    return np.array(out).reshape(len(out), x.shape[1])


def celled(middle: dict[int, np.ndarray], threshold: float):
    """Rows with the cell of each vector (twice its middle's number, and 1 if it lies in the shell; null if in none) and the cosine to its middle."""
    core, wide = np.sqrt((1 + threshold) / 2) + 10 * ROUNDING, np.sqrt(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column("unit"))
            cell, inner = np.full(len(units), -1), np.zeros(len(units))
            for rows, base, cosine in products(units, middle):
                best = cosine.argmax(1)
                inner[rows] = cosine[np.arange(len(rows)), best]
                cell[rows] = np.where(inner[rows] >= wide, 2 * (base + best) + (inner[rows] < core), -1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, mask=cell < 0), pa.array(inner)], names=[*batch.schema.names, "cell", "inner"])

    return run


def around(middle: dict[int, np.ndarray], cells: dict[int, float], threshold: float):
    """Of vectors near cells (by number, with the least cosine of a member to the middle): the cells with which each is surely linked as a whole, and those not sure."""
    angle = np.arccos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column("unit"))
            sure: list[list[int]] = [[] for _ in units]
            unsure: list[list[int]] = [[] for _ in units]
            for rows, base, cosine in products(units, middle):
                for part in (0, 1):
                    numbers = 2 * (base + np.arange(cosine.shape[1])) + part
                    there = np.array([int(c) in cells for c in numbers])
                    reach = np.arccos(np.clip([cells.get(int(c), 1.0) for c in numbers], -1, 1))
                    whole = there & (cosine >= np.cos(angle - reach) + ROUNDING)
                    for out, hit in ((sure, whole), (unsure, there & ~whole & (cosine >= np.cos(np.minimum(np.pi, angle + reach)) - ROUNDING))):
                        for i, c in zip(*(k.tolist() for k in np.nonzero(hit)), strict=True):
                            out[rows[i]].append(int(numbers[c]))
            near = [i for i in range(len(units)) if sure[i] or unsure[i]]
            lists = [pa.array([some[i] for i in near], pa.list_(pa.int64())) for some in (sure, unsure)]
            kept = batch.select(["node", "unit", "size", "cell"]).take(pa.array(near, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *lists], names=[*kept.schema.names, "sure", "unsure"])

    return run


def compared(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Of one block, members of a cell and vectors near it: (node, other, links) as of a shard; members count the vectors outside of cells alone, others their own."""
        table = table.sort_by("node")
        inside = table.column("member").to_numpy().astype(bool)
        x, nodes, size = np.array(matrix(table.column("unit"))), table.column("node").to_pylist(), table.column("size").to_numpy()
        outside = table.column("cell").is_null().to_numpy()
        members, others = np.flatnonzero(inside), np.flatnonzero(~inside)
        at = {nodes[i]: k for k, i in enumerate(members.tolist())}
        same = np.array([at.get(nodes[i], -1) for i in others.tolist()], int)
        count = np.zeros(len(nodes), np.int64)
        parent = tie(np.arange(len(nodes)), others[same >= 0], members[same[same >= 0]])  # a vector not sure of its own cell stands on both sides
        step = max(1, HELD // max(1, len(members)))
        for low in range(0, len(others), step):
            own, twin = others[low : low + step], same[low : low + step]
            hit = x[own] @ x[members].T >= threshold
            hit[np.flatnonzero(twin >= 0), twin[twin >= 0]] = False
            count[own] += hit @ size[members]
            count[members] += size[own][outside[own]] @ hit[outside[own]]
            a, b = np.nonzero(hit)
            parent = tie(parent, own[a], members[b])
        return outcome(nodes, count, parent)

    return run


def dense_links(stage: Stage, placed: DataFrame, middle: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """(node, other, links) of all links that vectors in cells have, exactly: as counts and connecting edges."""
    inside = placed.where("cell IS NOT NULL").select("node", "unit", "size", "cell")
    about = F.count(F.lit(1)).alias("rows"), F.sum("size").alias("weight"), F.min("inner").alias("inner"), F.min("node").alias("head")
    cells = placed.where("cell IS NOT NULL").groupBy("cell").agg(*about).collect()
    near = stage.write(placed.mapInArrow(around(middle, {r["cell"]: r["inner"] for r in cells}, threshold), "node binary, unit binary, size long, cell long, sure array<long>, unsure array<long>"))
    told = F.broadcast(stage.spark.createDataFrame([(r["cell"], r["weight"], r["head"]) for r in cells], "t_cell long, weight long, head binary"))
    sure = near.select("node", "size", "cell", F.explode("sure").alias("s_cell")).join(told, F.col("s_cell") == F.col("t_cell"))
    none, zero = F.lit(None).cast("binary"), F.lit(0).cast("long")
    out = sure.groupBy("node").agg(F.sum(F.col("weight") - F.when(F.col("cell") == F.col("s_cell"), F.col("size")).otherwise(0)).alias("links")).select("node", none.alias("other"), "links")
    out = out.unionByName(sure.where("node <> head").select("node", F.col("head").alias("other"), zero.alias("links")))
    more = near.where("cell IS NULL").select(F.explode("sure").alias("m_cell"), "size").groupBy("m_cell").agg(F.sum("size").alias("links"))
    out = out.unionByName(inside.join(F.broadcast(more), F.col("cell") == F.col("m_cell")).select("node", none.alias("other"), "links"))
    rows, step = {r["cell"]: r["rows"] for r in cells}, BLOCK
    unsure = near.select("node", "unit", "size", "cell", F.explode("unsure").alias("b_cell"))
    dealt = [(r["b_cell"], -(-rows[r["b_cell"]] // step), -(-r["count"] // step)) for r in unsure.groupBy("b_cell").count().collect()]
    if dealt:
        blocks = F.broadcast(stage.spark.createDataFrame(dealt, "d_cell long, high int, wide int"))
        part = lambda side, parts: F.pmod(F.xxhash64(F.lit(side), "node"), parts).cast("int")
        every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
        kept = ("node", "unit", "size", "cell")
        one = inside.join(blocks, F.col("cell") == F.col("d_cell")).select("d_cell", part("member", F.col("high")).alias("i"), every("wide").alias("j"), *kept, F.lit(True).alias("member"))
        two = unsure.join(blocks, F.col("b_cell") == F.col("d_cell")).select("d_cell", every("high").alias("i"), part("near", F.col("wide")).alias("j"), *kept, F.lit(False).alias("member"))
        out = out.unionByName(one.unionByName(two).groupBy("d_cell", "i", "j").applyInArrow(lambda t: compared(threshold)(t), "node binary, other binary, links long"))
    out = stage.write(out)
    stage.drop(near)
    return out


def exact_counts(queries: list[tuple[bytes, np.ndarray]], threshold: float):
    """Partial link counts of few queries over all vectors, block by block."""
    by_size: dict[int, list[int]] = {}
    for i, (_, u) in enumerate(queries):
        by_size.setdefault(len(u), []).append(i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(queries), np.int64)
        for batch in batches:
            units, size = matrix(batch.column("unit")), batch.column("size").to_numpy()
            for d, own in by_size.items():
                rows = [i for i, u in enumerate(units) if len(u) == d]
                if rows:
                    x = np.array([units[i] for i in rows]).T
                    for low in range(0, len(own), 512):
                        part = own[low : low + 512]
                        total[part] += (np.array([queries[i][1] for i in part]) @ x >= threshold) @ size[rows]
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in queries], pa.binary()), pa.array(total)], names=["node", "links"])

    return run


def first_by_hash(classes: DataFrame, n: int, limit: int, *salt) -> DataFrame:
    """The rows with the least hashes; of a large table hardly more than these are sorted and sent."""
    order, enough = F.xxhash64(*salt, "node"), limit + 6 * limit**0.5 + 50
    if n > 2 * enough:
        classes = classes.where(order < int(-(2**63) + 2**64 * (enough / n)))
    return classes.orderBy(order).limit(limit)


def audited(classes: DataFrame, n: int, threshold: float) -> tuple[dict[bytes, int], list[np.ndarray]]:
    """Links of linked vectors beyond their own copies, and the vectors to make pairs of for want of more of them."""
    drawn = first_by_hash(classes.select("node", "unit", "size"), n, DRAWN[-1], F.lit("audit")).collect()
    queries, copies = [(bytes(r["node"]), np.frombuffer(r["unit"], np.float64)) for r in drawn], {bytes(r["node"]): r["size"] for r in drawn}
    few, many, low = {}, {}, 0
    for high in DRAWN:
        if low >= n or len(few) >= AUDIT:
            break
        found = classes.select("node", "unit", "size").mapInArrow(exact_counts(queries[low:high], threshold), "node binary, links long").groupBy("node").agg(F.sum("links").alias("links"))
        for r in found.orderBy("node").collect():
            v, links = bytes(r["node"]), r["links"] - copies[bytes(r["node"])]
            if links:
                (few if links < MANY else many)[v] = links
        low = high
    lacking = 0 if low >= n else max(0, AUDIT - len(few))
    judged = {v: k for kind in (few, many) for v, k in list(kind.items())[:JUDGED]}
    return judged, [u for _, u in queries[:lacking]]


def dense_middles(sample: list[np.ndarray], n: int, threshold: float) -> dict[int, np.ndarray]:
    """By length, the middles of groups that stand in the sample as ``DENSE`` vectors of all ``n`` would."""
    need = max(8, -(-DENSE * len(sample) // max(1, n)))
    found = {d: middles([u for u in sample if len(u) == d], need, threshold) for d in {len(u) for u in sample}} if threshold > 0 else {}
    return {d: c for d, c in found.items() if len(c)}


def shared(middle: dict[int, np.ndarray], units: list[np.ndarray], overlap: int, threshold: float) -> list[float]:
    """Of each vector: whether it shares a shard with one at the threshold from it, in some direction."""
    rng, out = np.random.default_rng(5), []
    for u in units:
        side = rng.normal(size=len(u))
        side -= side @ u * u
        norm = np.linalg.norm(side)
        other = threshold * u + np.sqrt(1 - threshold**2) * side / norm if norm > 1e-9 else u
        c = middle.get(len(u), np.zeros((1, len(u))))
        near = [set(np.argsort(-(c @ v), kind="stable")[:overlap].tolist()) for v in (u, other)]
        out.append(float(bool(near[0] & near[1])))
    return out


def measured(want: dict[bytes, int], had: dict[bytes, int], made: list[float]) -> float:
    """The least of the recalls of vectors with few links (and made pairs) and with many, per vector and per link."""
    parts = []
    for many in (False, True):
        links = np.array([k for k in want.values() if (k >= MANY) == many] + ([] if many else [1] * len(made)), float)
        found = np.array([min(had.get(v, 0), k) for v, k in want.items() if (k >= MANY) == many] + ([] if many else made), float)
        if len(links):
            parts += [float((found / links).mean()), float(found.sum() / links.sum())]
    return min(parts, default=1.0)


def with_fringe(dealt: DataFrame, graph: DataFrame) -> DataFrame:
    """(shard, node, unit, size, shards, fringe, neighbours) of each shard's vectors and of the close neighbours that they have elsewhere."""
    named = dealt.join(graph, F.col("node") == F.col("u_node"), "left")
    edges = named.select(F.col("shards").alias("from"), F.explode("close").alias("c_node")).distinct()
    away = edges.join(dealt.select("node", "shards"), F.col("c_node") == F.col("node")).select("c_node", F.explode(F.array_except("from", "shards")).alias("away"))
    away = away.groupBy(F.col("c_node").alias("f_node")).agg(F.collect_set("away").alias("fringe"))
    rows = named.join(away, F.col("node") == F.col("f_node"), "left").withColumn("fringe", F.coalesce("fringe", F.array().cast("array<long>")))
    return rows.select(F.explode(F.concat("shards", "fringe")).alias("shard"), "node", "unit", "size", "shards", "fringe", "neighbours")


def near_duplicates(spark: SparkSession, vectors: DataFrame, threshold: float = THRESHOLD, overlap: int = OVERLAP) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of each row, and the recall that the audit found."""
    stage = Stage(spark, "embedding-dedup")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("embedding"))
    table = stage.write(rows.mapInArrow(unit, "vec_id long, node binary, unit binary"))
    classes = table.where("node IS NOT NULL").groupBy("node").agg(F.first("unit").alias("unit"), F.count(F.lit(1)).alias("size"), F.min("vec_id").alias("least"))
    classes = stage.write(classes)
    n = total = classes.count()
    sample = [np.frombuffer(r["unit"], np.float64) for r in first_by_hash(classes.select("node", "unit"), n, SAMPLE).collect()]
    free, dense = classes, None
    if apart := dense_middles(sample, n, threshold):
        placed = stage.write(classes.mapInArrow(celled(apart, threshold), "node binary, unit binary, size long, least long, cell long, inner double"))
        stage.drop(classes)
        classes, free = placed, placed.where("cell IS NULL").select("node", "unit", "size")
        dense, n = dense_links(stage, placed, apart, threshold), free.count()
        sample = [u for u in sample if len(u) not in apart or (apart[len(u)] @ u).max() < np.sqrt(threshold)]
        log.info("%d of %d vectors lie around %d middles", total - n, total, sum(map(len, apart.values())))
    middle = {d: centroids([u for u in sample if len(u) == d], min(MOST_SHARDS, -(-n // SHARD))) for d in {len(u) for u in sample}}
    want, spare = audited(free, n, threshold)
    most = max(map(len, middle.values()), default=0)
    recall, searched, width = 1.0, None, overlap
    while n:
        made = shared(middle, spare, width, threshold)
        if width < most and measured(want, want, made) < RECALL:  # whatever the search finds
            width *= 2
            continue
        dealt = stage.write(free.select("node", "unit", "size").mapInArrow(assign(middle, width), "node binary, unit binary, size long, shards array<long>"))
        lists = dealt.select(F.explode("shards").alias("shard"), "node", "unit").groupBy("shard")
        lists = lists.applyInArrow(lambda t: build(threshold - SLACK)(t.select(["node", "unit"])), "node binary, neighbours array<binary>, close array<binary>")
        united = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("neighbours", "close")]
        graph = stage.write(lists.groupBy(F.col("node").alias("u_node")).agg(*united))
        searched = stage.write(with_fringe(dealt, graph).groupBy("shard").applyInArrow(search(threshold), "node binary, other binary, links long"))
        got = searched.where(F.col("other").isNull() & F.col("node").isin(list(want))).groupBy("node").agg(F.sum("links").alias("links")).collect()
        recall = measured(want, {bytes(r["node"]): r["links"] for r in got}, made)
        log.info("overlap %d: recall %.3f of %d linked vectors and %d made pairs", width, recall, len(want), len(made))
        if recall >= RECALL or width >= most:
            break
        for made_table in (dealt, graph, searched):
            stage.drop(made_table)
        width *= 2
    parts = [p for p in (searched, dense) if p is not None]
    if not parts:
        return table.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")), recall
    found = parts[0].unionByName(parts[-1]) if len(parts) > 1 else parts[0]
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "n_node")
    labels = components(stage, found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    labels = labels.select(F.col("node").alias("l_node"), "component")
    full = classes.select("node", "size", "least").join(counts, F.col("node") == F.col("n_node"), "left").join(labels, F.col("node") == F.col("l_node"), "left")
    full = full.select("node", "size", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("group"))
    full = stage.write(full)
    smallest = stage.write(full.groupBy(F.col("group").alias("g_group")).agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("g_rows")))
    full = skewed_join(full, smallest, ("group", "g_group"), "g_rows", total).select(F.col("node").alias("f_node"), (F.col("links") + F.col("size") - 1).alias("n_links"), "component_id")
    out = table.join(full, F.col("node") == F.col("f_node"), "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), recall


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, recall = near_duplicates(spark, read(spark, sf_dir, "embeddings"))
    if recall < RECALL:
        raise RuntimeError(f"the search found {recall:.3f} of the audited links, less than {RECALL}")
    return out


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
  SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, link.y FROM reach JOIN link ON link.x = reach.r
)
SELECT v.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, m.c AS component_id, v.vec_id = m.c AS kept
FROM v LEFT JOIN (SELECT x, count(*) AS n FROM link GROUP BY x) l ON l.x = v.vec_id JOIN (SELECT vec_id, min(r) AS c FROM reach GROUP BY vec_id) m ON m.vec_id = v.vec_id
"""
