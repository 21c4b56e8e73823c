"""Exact top-k by inner product with M-trees.

Inner products become distances: with M the largest norm, a vector v gets one more component sqrt(M^2 - |v|^2) and
a query gets 0 there; then |q - v|^2 = |q|^2 + M^2 - 2 q.v, so the nearest vectors have the highest products. Vectors
are dealt to cells around pivots and cells are split into trees of bounded size. A tree's nodes are pages of at most PAGE
entries: leaves hold vectors, inner nodes hold the routing objects of their children, with covering radius and
distance to the parent's object; each vector keeps its distance to its leaf's object. Each query goes best-first: of the
nodes it has met it opens the one with the least lower bound, until none is under its present k-th distance. Stored
distances and the triangle inequality bound nodes and entries before anything is computed for them.

Where such bounds leave a query more than SCAN of a tree's pages, opening them one by one saves nothing: these pages are
read in one product, and only scores above the query's present k-th are looked at.

A query first searches the tree that holds it; the k-th score found there bounds which cells can still matter. Trees are
gathered in groups of bounded bytes. A query's vector goes once to each group with a tree of such cells, in messages of at
most QUERY_BLOCK queries that are made one at a time; a group's task holds its trees and takes the messages block by block.
So a task holds GROUP_BYTES of trees and one block, however large the table is; the queries are written once a group, not
once a tree.

Contract: vectors that are null or hold a null, NaN or infinite component take no part, nor do rows without vec_id; every
other row is a candidate for every query but its own row, so rows equal in vec_id and vector are each other's candidates
and each asks its own query; shorter vectors are filled up with zeros; ties go to the smaller vec_id; where fewer than k
candidates exist all are returned; an empty table gives an empty result; other columns are never read. Products are exact
integers: from 2^52 of the largest square norm on they are computed in 64-bit integers, and from 2^62 on top_k() refuses.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, release, ship, table

K = 5
SCALE = 256
EVERY = 50
#: Vectors of one tree, entries of one page and children of one inner node.
TREE, PAGE, FANOUT = 2048, 64, 8
#: Bytes of one tree's vectors and of one group of trees, about.
TREE_BYTES, GROUP_BYTES = 1 << 19, 64 << 20
#: Share of a tree's pages over which a query reads them at once, and queries of one such product.
SCAN, STRIP = 1 / 8, 512
#: Pivots come from a sample of this many vectors at most; more vectors make more trees, not more pivots.
PIVOT_SAMPLE, MOST_PIVOTS, VECTORS_PER_PIVOT = 4096, 256, 2000
#: Queries of one block, and rows of which distances to all pivots are held at once.
QUERY_BLOCK = 4096
SLACK = 1e-6
EXACT_SINGLE, EXACT_FLOAT, EXACT_LONG = 2.0**24, 2.0**52, 2.0**62
#: What stands for no score and for no vec_id: under all scores, over all ids.
NONE, NO_ID = -(2**63) + 1, 2**63 - 1


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (the vector as floor(scale x component), 32-bit integers), its size and square norm, and a number for the row.

    Rows that take no part are gone; where the square norm passes 2^62, v is not to be used.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), QUERY_BLOCK):
                batch = whole.slice(a, QUERY_BLOCK)
                column = batch.column(1)
                size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
                owner = np.repeat(np.arange(len(batch)), size)
                x = pc.cast(column.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
                good = np.bincount(owner, weights=~np.isfinite(x), minlength=len(batch)) == 0
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(x * scale)
                    square = np.bincount(owner, weights=x * x, minlength=len(batch)).astype(np.float64)  # integers where all are empty
                    body = np.where(np.abs(x) < 2.0**31, x, 0).astype(np.int32)
                starts = np.concatenate([[0], np.cumsum(4 * size)]).astype(np.int32)
                v = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(starts), pa.py_buffer(body)])
                out = pa.RecordBatch.from_arrays([batch.column(0), v, pa.array(size), pa.array(square), batch.column(2)], ["vec_id", "v", "size", "square", "row"])
                yield out.filter(pa.array(good))

    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(convert, "vec_id long, v binary, size long, square double, row long")


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a column of 32-bit integers as float64, filled up with zeros."""
    rows = column.to_pylist()
    flat = np.frombuffer(b"".join(rows), np.int32)
    sizes = np.fromiter((len(x) // 4 for x in rows), np.int64, len(rows))
    if (sizes == width).all():
        return flat.astype(np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    at = 0
    for i, n in enumerate(sizes):
        out[i, :n] = flat[at : at + n]
        at += n
    return out


class Space:
    """Distances after the extra component; top is M^2."""

    def __init__(self, top: float):
        self.top = top
        #: What products are exact in, since no partial sum exceeds M^2, and what holds a component.
        self.kind = np.float32 if top < EXACT_SINGLE else np.float64 if top < EXACT_FLOAT else np.int64
        self.stored = np.int16 if top < 2.0**30 else np.int32

    def products(self, q: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Exact inner products, in the kind of number that holds them."""
        return q.astype(self.kind, copy=False) @ v.astype(self.kind, copy=False).T

    def lift(self, v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.top - (v * v).sum(1), 0))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of stored vectors."""
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T + (self.lift(a)[:, None] - self.lift(b)[None]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def from_query(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + self.top - 2 * q @ b.T, 0))

    def of_score(self, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q * q).sum(1) + self.top - 2 * score, 0))


def _spread(v: np.ndarray, count: int, space: Space) -> np.ndarray:
    """Rows of v that lie apart: farthest-first from row 0."""
    chosen = [0]
    near = space.between(v, v[:1])[:, 0]
    while len(chosen) < min(count, len(v)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, space.between(v, v[chosen[-1:]])[:, 0])
    return np.asarray(chosen)


def build(ids: np.ndarray, rows: np.ndarray, v: np.ndarray, space: Space) -> dict:
    """One tree: entries in order of leaves; nodes bottom-up, the root last; all that searching needs is stored."""
    order = np.lexsort((rows, ids))
    ids, rows, v = ids[order], rows[order], v[order]
    centres = v[_spread(v, -(-len(v) // PAGE), space)]
    d = space.between(v, centres)
    page = d.argmin(1)
    # leaves hold at most PAGE entries: a fuller one is split in order of distance, with rings of its own
    entry = d[np.arange(len(v)), page]
    order = np.lexsort((entry, page))
    ids, rows, v, page, entry = ids[order], rows[order], v[order], page[order], entry[order]
    first = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    within = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
    starts = np.append(np.flatnonzero(within % PAGE == 0), len(v))
    leaves = len(starts) - 1
    objects = [centres[page[i]] for i in starts[:-1]]
    radius, inner = list(np.maximum.reduceat(entry, starts[:-1])), list(np.minimum.reduceat(entry, starts[:-1]))
    below = [np.arange(a, b) for a, b in zip(starts, starts[1:], strict=False)]  # entries under each node
    children: list[list[int]] = [[] for _ in range(leaves)]
    to_parent = [0.0] * leaves
    level = list(range(leaves))
    while len(level) > 1:
        at = np.asarray([objects[n] for n in level])
        heads = at[_spread(at, -(-len(level) // FANOUT), space)]
        near = space.between(at, heads).argmin(1)
        above = []
        for h in range(len(heads)):
            group = [n for n, x in zip(level, near.tolist(), strict=True) if x == h]
            if not group:
                continue
            members = np.concatenate([below[n] for n in group])
            reach = space.between(v[members], heads[h : h + 1])[:, 0]
            for n, far in zip(group, space.between(np.asarray([objects[n] for n in group]), heads[h : h + 1])[:, 0].tolist(), strict=True):
                to_parent[n] = far
            above.append(len(objects))
            objects.append(heads[h])
            radius.append(reach.max())
            inner.append(reach.min())
            below.append(members)
            children.append(group)
            to_parent.append(0.0)
        level = above
    return {
        "ids": ids, "rows": rows, "v": v.astype(space.stored), "entry": entry, "starts": starts, "objects": np.asarray(objects), "radius": np.asarray(radius), "inner": np.asarray(inner),
        "children": [np.asarray(c, np.int64) for c in children], "parent": np.asarray(to_parent),
    }


class Block:
    """Queries under way: the k best that were found, and what a candidate has to beat, by score and then vec_id."""

    def __init__(self, rows: np.ndarray, v: np.ndarray, low: np.ndarray, low_id: np.ndarray, space: Space, k: int = K):
        self.rows, self.low, self.low_id, self.space, self.k = rows, low.copy(), low_id.copy(), space, k
        self.v, self.wide = v.astype(space.kind), v.astype(np.float64)
        self.scores, self.found = np.full((len(rows), k), NONE), np.full((len(rows), k), NO_ID)
        self.limit = np.full(len(rows), np.inf)
        self._limits(np.flatnonzero(low > NONE))
        self.slack = SLACK * (1 + np.sqrt(space.top))

    def _limits(self, at: np.ndarray) -> None:
        self.limit[at] = self.space.of_score(self.wide[at], self.low[at].astype(float))

    def offer(self, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Candidates of the queries at; the k best stay."""
        scores = scores.astype(np.int64)
        better = (scores > self.low[at]) | ((scores == self.low[at]) & (ids < self.low_id[at]))
        at, ids, scores = at[better], ids[better], scores[better]
        if not len(at):
            return
        asked, own = np.unique(at, return_inverse=True)
        every_q = np.concatenate([np.repeat(np.arange(len(asked)), self.k), own])
        every_s = np.concatenate([self.scores[asked].ravel(), scores])
        every_i = np.concatenate([self.found[asked].ravel(), ids])
        order = np.lexsort((every_i, -every_s, every_q))
        size = np.bincount(every_q)
        place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
        order = order[place < self.k]
        self.scores[asked], self.found[asked] = every_s[order].reshape(-1, self.k), every_i[order].reshape(-1, self.k)
        full = asked[self.scores[asked, -1] > NONE]
        self.low[full], self.low_id[full] = self.scores[full, -1], self.found[full, -1]
        self._limits(full)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vec_id, score), each query's best first."""
        row, at = np.nonzero(self.scores > NONE)
        return row, self.found[row, at], self.scores[row, at]


def _meet(tree: dict, entries: np.ndarray | slice, block: Block, near: np.ndarray, useful: np.ndarray | None = None) -> None:
    """Offers entries of a tree to the queries near, their own rows left out; useful has the pairs that bounds leave."""
    ids, rows, v = tree["ids"][entries], tree["rows"][entries], tree["v"][entries].astype(block.space.kind)
    for a in range(0, len(near), STRIP):
        some = near[a : a + STRIP]
        s = block.space.products(block.v[some], v)
        hit = s >= block.low[some].astype(block.space.kind)[:, None]
        if useful is not None:
            hit &= useful[a : a + STRIP]
        pairs = np.flatnonzero(hit.ravel())
        at, e = some[pairs // len(ids)], pairs % len(ids)
        other = rows[e] != block.rows[at]
        block.offer(at[other], ids[e[other]], s.ravel()[pairs[other]])


def search(tree: dict, block: Block, asking: np.ndarray, space: Space) -> None:
    """Offers the queries asking what this tree holds within their limits.

    Queries go best-first: in each round every query opens the node with its own least bound; queries at one node are
    handled together. A query without a limit goes so until it has one; where a limit then leaves more than SCAN of the
    tree's pages, the query reads what is left of these at once.
    A node's bound comes from its parent's known distance and stored ones; the distance to its own object is computed when
    it is opened, and bounds its ring and each of its entries before any product is.
    """
    leaves = len(tree["starts"]) - 1
    low = np.full((len(asking), len(tree["objects"])), np.inf)
    low[:, -1] = 0
    opened = np.zeros((len(asking), leaves), bool)
    _best_first(tree, block, asking, space, low, opened, True)
    bounded = np.flatnonzero(np.isfinite(block.limit[asking]))
    d = space.from_query(block.wide[asking[bounded]], tree["objects"][:leaves])
    left = np.maximum(d - tree["radius"][:leaves], tree["inner"][:leaves] - d) <= (block.limit[asking[bounded]] + block.slack)[:, None]
    left &= ~opened[bounded]
    many = left.mean(1) > SCAN
    if many.any():
        size = np.diff(tree["starts"])
        pages = left[many].any(0)
        entries = slice(None) if pages.all() else np.flatnonzero(np.repeat(pages, size))
        done = opened[bounded[many]]
        _meet(tree, entries, block, asking[bounded[many]], np.repeat(~done, size, axis=1)[:, entries] if done.any() else None)
    rest = np.delete(np.arange(len(asking)), bounded[many | ~left.any(1)])
    _best_first(tree, block, asking[rest], space, low[rest], opened[rest], False)


def _best_first(tree: dict, block: Block, asking: np.ndarray, space: Space, low: np.ndarray, opened: np.ndarray, first_limit: bool) -> None:
    """The rounds of search(), over the nodes met (low, their bounds; infinite once opened); to the end or to a first limit."""
    leaves, slack = len(tree["starts"]) - 1, block.slack
    everyone = np.arange(len(asking))
    while len(asking):
        pick = low.argmin(1)
        least = low[everyone, pick]
        going = np.flatnonzero((least <= block.limit[asking] + slack) & (least < np.inf) & ~(first_limit & np.isfinite(block.limit[asking])))
        if not len(going):
            break
        low[going, pick[going]] = np.inf
        order = going[np.argsort(pick[going], kind="stable")]
        at, first = np.unique(pick[order], return_index=True)
        for node, near in zip(at.tolist(), np.split(order, first[1:]), strict=True):
            if node < leaves:
                opened[near, node] = True
            d = space.from_query(block.wide[asking[near]], tree["objects"][node : node + 1])[:, 0]
            ring = np.maximum(np.maximum(d - tree["radius"][node], tree["inner"][node] - d), 0)
            inside = ring <= block.limit[asking[near]] + slack
            near, d, ring = near[inside], d[inside], ring[inside]
            if not len(near):
                continue
            if node >= leaves:
                below = tree["children"][node]
                bounds = np.abs(d[:, None] - tree["parent"][below][None]) - tree["radius"][below][None]
                low[near[:, None], below[None]] = np.maximum(bounds, ring[:, None])
                continue
            a, b = tree["starts"][node], tree["starts"][node + 1]
            useful = np.abs(d[:, None] - tree["entry"][a:b][None]) <= (block.limit[asking[near]] + slack)[:, None]
            some = np.flatnonzero(useful.any(0))
            if len(some):
                _meet(tree, a + some, block, asking[near], useful[:, some])


FOUND = "query_row long, query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score for the rows whose vec_id is divisible by every."""
    spark = vectors.sparkSession
    ship(spark)
    v = cut(integers(vectors, scale), "mtree-vectors")
    n, top, width = v.agg(F.count("*"), F.max("square"), F.max("size")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if top >= EXACT_LONG:
        raise ValueError("inner products may exceed 64-bit integers; scale the vectors down")
    width = max(width, 1)  # all vectors may be empty
    space = Space(float(top))
    sample = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < F.lit(1_000_000 * PIVOT_SAMPLE / n)).limit(2 * PIVOT_SAMPLE).select("v").toArrow()
    if sample.num_rows == 0:
        sample = v.limit(1).select("v").toArrow()
    pool = _matrix(sample.column("v"), width)
    pool = pool[np.lexsort(pool.T[::-1])]
    pivots = pool[_spread(pool, int(min(MOST_PIVOTS, max(1, n // VECTORS_PER_PIVOT))), space)]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), QUERY_BLOCK):
                batch = whole.slice(a, QUERY_BLOCK)
                wide = _matrix(batch.column(1), width)
                d = space.between(wide, pivots)
                cell = d.argmin(1)
                body = pa.array([x.tobytes() for x in wide.astype(space.stored)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), body, batch.column(2), pa.array(cell), pa.array(d[np.arange(len(cell)), cell])], ["vec_id", "v", "row", "cell", "away"])

    in_cells = cut(v.select("vec_id", "v", "row").mapInArrow(assign, "vec_id long, v binary, row long, cell long, away double"), "mtree-cells")
    release(v)
    cells = in_cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius"), F.min("away").alias("inner")).toPandas()  # one row a pivot
    vector_bytes = width * np.dtype(space.stored).itemsize
    parts = np.zeros(len(pivots), np.int64)
    radius, inner = np.zeros(len(pivots)), np.zeros(len(pivots))
    at = cells["cell"].to_numpy()
    parts[at], radius[at], inner[at] = -(-cells["n"].to_numpy() // max(PAGE, min(TREE, TREE_BYTES // max(vector_bytes, 1)))), cells["radius"], cells["inner"]
    offset = np.concatenate([[0], np.cumsum(parts)])
    part_of = F.element_at(F.array(*(F.lit(int(x)) for x in np.maximum(parts, 1))), F.col("cell").cast("int") + 1)
    start_of = F.element_at(F.array(*(F.lit(int(x)) for x in offset[:-1])), F.col("cell").cast("int") + 1)
    dealt = in_cells.withColumn("tree", start_of + F.pmod(F.xxhash64("row", F.lit(3)), part_of))

    def plant(frame: pd.DataFrame) -> pd.DataFrame:
        wide = np.frombuffer(b"".join(frame["v"]), space.stored).reshape(len(frame), width).astype(np.float64)
        tree = build(frame["vec_id"].to_numpy(np.int64), frame["row"].to_numpy(np.int64), wide, space)
        return pd.DataFrame({"tree": [int(frame["tree"].iloc[0])], "body": [pickle.dumps(tree, protocol=5)]})

    trees = cut(dealt.select("tree", "vec_id", "row", "v").groupBy("tree").applyInPandas(plant, "tree long, body binary"), "mtree-trees")
    release(in_cells)
    # trees of a cell lie in one group or in neighbouring ones; enough groups to keep all cores busy
    count = int(offset[-1])
    groups = min(count, max(-(-n * (vector_bytes + 24) // GROUP_BYTES), 4 * spark.sparkContext.defaultParallelism))
    cell_of = np.repeat(np.arange(len(parts)), parts)
    group_of = np.arange(count) * groups // count
    cell_groups = np.zeros((len(parts), groups), np.float32)
    cell_groups[cell_of, group_of] = 1

    def ring(wide: np.ndarray, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Least distances of queries to anything in these cells."""
        d = space.from_query(wide, pivots[some])
        return np.maximum(np.maximum(d - radius[some], inner[some] - d), 0)

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Searches each tree for its own queries; one row for each query with its vector, what was found and what is to beat."""
        for frame in frames:
            for number, body in zip(frame["tree"], frame["body"], strict=True):
                tree = pickle.loads(body)
                own = np.flatnonzero(tree["ids"] % every == 0)
                for a in range(0, len(own), QUERY_BLOCK):
                    some = own[a : a + QUERY_BLOCK]
                    block = Block(tree["rows"][some], tree["v"][some], np.full(len(some), NONE), np.full(len(some), NO_ID), space, k)
                    search(tree, block, np.arange(len(some)), space)
                    row, vec_id, score = block.best()
                    cut_at = np.cumsum(np.bincount(row, minlength=len(some)))[:-1]
                    yield pd.DataFrame({
                        "query_row": block.rows, "query_id": tree["ids"][some], "tree": int(number), "v": [x.tobytes() for x in tree["v"][some]],
                        "low": block.low, "low_id": block.low_id, "vec_ids": np.split(vec_id, cut_at), "scores": np.split(score, cut_at),
                    })

    asked = cut(trees.mapInPandas(ask, "query_row long, query_id long, tree long, v binary, low long, low_id long, vec_ids array<long>, scores array<long>"), "mtree-asked")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Queries in blocks, one message at a time to each group with a tree that their limits leave."""
        for whole in frames:
            for a in range(0, len(whole), QUERY_BLOCK):
                frame = whole.iloc[a : a + QUERY_BLOCK]
                q_rows, q_ids, home, low, low_id = (frame[c].to_numpy() for c in ("query_row", "query_id", "tree", "low", "low_id"))
                v = np.frombuffer(b"".join(frame["v"]), space.stored).reshape(len(frame), width)
                block = Block(q_rows, v, low, low_id, space, k)
                wanted = (ring(block.wide) <= (block.limit + block.slack)[:, None]).astype(np.float32) @ cell_groups > 0
                for group in np.flatnonzero(wanted.any(0)).tolist():
                    here = np.flatnonzero(wanted[:, group])
                    yield pd.DataFrame({"group": [group], "message": True, "tree": -1, "body": [pickle.dumps((q_rows[here], q_ids[here], home[here], v[here], low[here], low_id[here]), protocol=5)]})

    def answer(held: list[tuple[int, dict]], messages: list[tuple]) -> pd.DataFrame:
        q_rows, q_ids, home, v, low, low_id = (np.concatenate(x) for x in zip(*messages, strict=True))
        block = Block(q_rows, v, low, low_id, space, k)
        cell, bounds = -1, None
        for number, tree in held:
            if cell_of[number] != cell:
                cell = cell_of[number]
                bounds = ring(block.wide, slice(cell, cell + 1))[:, 0]
            asking = np.flatnonzero((bounds <= block.limit + block.slack) & (home != number))
            if len(asking):
                search(tree, block, asking, space)
        row, vec_id, score = block.best()
        return pd.DataFrame({"query_row": q_rows[row], "query_id": q_ids[row], "vec_id": vec_id, "score": score})

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by group, its trees before the messages to it: one group and one block are held at a time."""
        group, held, messages, waiting = None, [], [], 0
        for frame in frames:
            for g, message, number, body in zip(frame["group"], frame["message"], frame["tree"], frame["body"], strict=True):
                found = pickle.loads(body)
                size = len(found[0]) if message else 0
                if messages and (g != group or waiting + size > QUERY_BLOCK):
                    yield answer(held, messages)
                    messages, waiting = [], 0
                if g != group:
                    group, held = g, []
                if message:
                    messages.append(found)
                    waiting += size
                else:
                    held.append((number, found))
        if messages:
            yield answer(held, messages)

    near = asked.select("query_row", "query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select("query_row", "query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    letters = asked.select("query_row", "query_id", "tree", "v", "low", "low_id").mapInPandas(route, "group long, message boolean, tree long, body binary")
    mail = trees.select(F.expr(f"tree * {groups} div {count}").alias("group"), F.lit(False).alias("message"), "tree", "body").unionByName(letters)
    far = mail.repartition(groups, "group").sortWithinPartitions("group", "message", "tree").mapInPandas(look, FOUND)
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return near.unionByName(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_mtree_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.own, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
