"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample, every vector is filed under its leaf. A query walks the
tree with a priority queue of nodes ordered by distance and so meets the leaves in the order of
their promise; it visits the first ``visits`` of them. How many are needed is measured: for a bounded
set of probe queries an exact search over all vectors tells in which leaves the true neighbours
lie, and the visits are widened until the recall asked for is reached.

Neighbouring leaves share a shelf of about ``PART`` vectors, a larger leaf takes several. A query goes
once to each shelf that it visits, with the list of its leaves there, and gets one list back. The vectors
of a shelf come first, queries stream past them, and shelves with many queries are copied for blocks of them.

Nearness is the inner product. The tree works on distances: each vector gets one more component
that brings all vectors to the same length, so the largest product is the smallest distance.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeharbor.llm.runs import bounds
from citeharbor.sources.stages import cut

SAMPLE = 20_000  # vectors that the tree is fitted on, at most
BRANCH, LEAF = 16, 64  # children of a node; sampled vectors of a leaf
PROBES = 128  # queries that calibrate the number of visits
RECALL = 0.97  # over the probes; leaves room above the 0.9 asked of the whole
WALKS = 4096  # queries that one task walks the tree for, about
VISIT_ROWS = 4096  # rows of queries and shelves made at once
PART = 4096  # vectors of a shelf, about
BLOCK_QUERIES = 1 << 16  # queries of a shelf that one task group answers, about
ASKED = 128  # queries compared with a shelf at once
PAIRS = 1 << 16  # exact products made at once


@dataclass
class Tree:
    """Centres in ascending node order; ``children[i]`` is the range of node i, empty for a leaf."""

    centres: np.ndarray
    children: list[range]
    leaf: np.ndarray  # leaf number of a node, -1 for inner nodes
    longest: float
    held: np.ndarray | None = None  # distinct stored vectors of each leaf
    shelf: np.ndarray | None = None  # first shelf of each leaf
    shelves: np.ndarray | None = None  # number of shelves of each leaf

    @property
    def leaves(self) -> int:
        return int((self.leaf >= 0).sum())

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.longest ** 2 - (vectors ** 2).sum(axis=1), 0)
        return np.column_stack([vectors, np.sqrt(rest)])

    def assign(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of each vector, going down to the nearest child."""
        points = self.lifted(vectors)
        node = np.zeros(len(points), dtype=np.int64)
        waiting = [(0, np.arange(len(points)))]
        while waiting:
            at, members = waiting.pop()
            kids = self.children[at]
            if not len(kids) or not len(members):
                node[members] = at
                continue
            nearest = _distances(points[members], self.centres[kids.start:kids.stop]).argmin(axis=1)
            for k in range(len(kids)):
                waiting.append((kids[k], members[nearest == k]))
        return self.leaf[node]

    def best_first(self, query: np.ndarray, visits: int, least: int = 0) -> list[int]:
        """The first leaves of a best-bin-first walk for one query.

        At least ``visits`` of them, and as many as hold ``least`` stored vectors; all, if need be.
        """
        return self.walks(query[None, :], visits, [least])[0]

    def walks(self, queries: np.ndarray, visits: int, least: list[int]) -> list[list[int]]:
        """:meth:`best_first` of several queries; their distances to all centres are made at once."""
        if visits >= self.leaves:
            return [list(range(self.leaves))] * len(queries)
        far = _distances(np.column_stack([queries, np.zeros(len(queries))]), self.centres)
        return [self._walk(far[q].tolist(), visits, least[q]) for q in range(len(queries))]

    def _walk(self, far: list[float], visits: int, least: int) -> list[int]:
        queue, found, met = [(0.0, 0)], [], 0
        while queue and (len(found) < visits or met < least):
            at = heapq.heappop(queue)[1]
            kids = self.children[at]
            if not len(kids):
                found.append(int(self.leaf[at]))
                met += least and int(self.held[found[-1]])
            for kid in kids:
                heapq.heappush(queue, (far[kid], kid))
        return found

    def place(self, stored: np.ndarray, part: int) -> None:
        """Deal the leaves, which hold ``stored`` rows each, out to shelves of about ``part`` rows."""
        self.shelf, self.shelves = np.zeros((2, len(stored)), dtype=np.int64)
        at, room = -1, 0
        for leaf, n in enumerate(stored.tolist()):
            self.shelves[leaf] = many = max(1, -(-n // part))
            if many > 1 or n > room:
                at += 1
                room = part
            self.shelf[leaf] = at
            at += many - 1
            room = 0 if many > 1 else room - n


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (centres ** 2).sum(axis=1)[None, :] - 2 * points @ centres.T


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(steps):
        nearest = _distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        n = np.bincount(nearest, minlength=k)
        centres = np.where(n[:, None] > 0, sums / n.clip(1)[:, None], centres)
    return centres


def grow(sample: np.ndarray, longest: float, branch: int = BRANCH, leaf: int = LEAF, seed: int = 7) -> Tree:
    """Split the sample by k-means, again and again, until a node holds ``leaf`` vectors or copies."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, sample.shape[1] + 1)), [range(0)], np.array([-1]), longest)
    points = tree.lifted(sample)
    centres, children, waiting = [np.zeros(points.shape[1])], [range(0)], [(0, np.arange(len(points)))]
    while waiting:
        at, members = waiting.pop()
        distinct = np.unique(points[members], axis=0) if len(members) > leaf else points[:1]
        if len(members) <= leaf or len(distinct) < 2:
            continue
        k = min(branch, len(distinct))
        found = _kmeans(distinct, k, rng)
        nearest = _distances(points[members], found).argmin(axis=1)
        used = np.unique(nearest)
        if len(used) < 2:
            continue
        children[at] = range(len(centres), len(centres) + len(used))
        for c in used:
            waiting.append((len(centres), members[nearest == c]))
            centres.append(found[c])
            children.append(range(0))
    leaf_of = np.full(len(centres), -1)
    ends = [i for i, kids in enumerate(children) if not len(kids)]
    leaf_of[ends] = np.arange(len(ends))
    return Tree(np.array(centres), children, leaf_of, longest)


def _matrix(lists, width: int = -1) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    values = np.asarray(lists.flatten(), dtype=np.float64)
    return values.reshape(len(lists), width) if len(lists) else np.zeros((0, max(width, 0)))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added up from the first component to the last."""
    parts = np.ascontiguousarray((queries * vectors).T)
    total = np.zeros(len(queries))
    for part in parts:
        total += part
    return total


class Shelf:
    """Stored vectors by leaf, rows that repeat id and vector once, and of equal vectors the ``k`` + 1 smallest
    ids: with one id left out for the query's own, no others can be among its ``k`` best."""

    def __init__(self, ids: np.ndarray, leaves: np.ndarray, vectors: np.ndarray, k: int):
        vectors = vectors + 0.0  # no negative zeros, so equal vectors have equal bytes
        _, same = np.unique(np.ascontiguousarray(vectors).view(f"V{8 * vectors.shape[1]}").ravel(),
                            return_inverse=True)
        order = np.lexsort((ids, same, leaves))
        ids, same = ids[order], same[order]
        fresh = np.ones(len(ids), dtype=bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (same[1:] != same[:-1])
        order, same = order[fresh], same[fresh]
        first = np.flatnonzero(np.append(True, same[1:] != same[:-1]))
        place = np.arange(len(same)) - np.repeat(first, np.diff(np.append(first, len(same))))
        order, ids = order[place <= k], ids[fresh][place <= k]
        self.ids, self.vectors, self.k = ids, vectors[order], k
        self.leaves, starts = np.unique(leaves[order], return_index=True)
        self.cuts = np.append(starts, len(order))

    def best(self, asked: np.ndarray, queries: np.ndarray, visited: list[np.ndarray] | None = None):
        """Query position, stored position and score of the ``k`` best in the leaves that each query visits."""
        rough = np.full((len(queries), len(self.ids)), -np.inf)
        if visited is None:
            rough = queries @ self.vectors.T
        else:
            who = np.repeat(np.arange(len(visited)), [len(v) for v in visited])
            which = np.concatenate(visited)
            for n, leaf in enumerate(self.leaves):
                rows = who[which == leaf]
                low, high = self.cuts[n], self.cuts[n + 1]
                rough[rows, low:high] = queries[rows] @ self.vectors[low:high].T
        rough[asked[:, None] == self.ids[None, :]] = -np.inf
        real = np.isfinite(rough)
        floor = np.full(len(queries), -np.inf)
        if len(self.ids) > self.k:
            floor = np.partition(rough, len(self.ids) - self.k, axis=1)[:, len(self.ids) - self.k]
        slack = 1e-9 * (1 + np.abs(rough[real]).max(initial=0.0))
        at, near = np.nonzero(real & (rough >= floor[:, None] - slack))
        scores = np.concatenate([np.zeros(0), *(
            products(queries[at[i:i + PAIRS]], self.vectors[near[i:i + PAIRS]]) for i in range(0, len(at), PAIRS))])
        return first_of(at, self.ids[near], scores, self.k)


def first_of(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The ``k`` best rows of each value of ``at``: largest score first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, dtype=np.int64)
    keep = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at)))) < k
    return at[keep], ids[keep], scores[keep]


def usable(vector: Column) -> Column:
    """Vectors that take part: not NULL, no NULL or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


BLOCK = ["shelf", "block"]
FOUND = "query_id long, vec_id long, score double"


def _compare(k: int):
    """Best vectors of each shelf for each query that visits it: rows of a block come vectors first."""
    def run(batches):
        key, held, shelf = None, [], None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            cuts = bounds(table, [*BLOCK, "query"])
            for low, high in zip(cuts[:-1], cuts[1:]):
                rows = table.slice(low, high - low)
                here = tuple(rows[c][0].as_py() for c in BLOCK)
                if here != key:
                    key, held, shelf = here, [], None
                if not rows["query"][0].as_py():
                    held.append(rows)
                    continue
                if shelf is None and held:
                    stored, held = pa.concat_tables(held).combine_chunks(), []
                    leaves = np.asarray(stored["leaves"].combine_chunks().flatten())
                    shelf = Shelf(stored["id"].to_numpy(), leaves, _matrix(stored["vector"]), k)
                for start in range(0, len(rows), ASKED):
                    part = rows.slice(start, ASKED)
                    ids = part["id"].to_numpy()
                    visited = [np.asarray(v.values) for v in part["leaves"]]
                    at, near, scores = shelf.best(ids, _matrix(part["vector"]), visited)
                    yield _batch(ids[at], near, scores)
    return run


def _batch(queries: np.ndarray, near: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(queries), pa.array(near), pa.array(scores)], ["query_id", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query: largest score first, ties to the smaller id, ids once."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rows = found.repartition("query_id").distinct()  # one shuffle serves both
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def _visits(tree, k: int, visits: int):
    """A row for each query and shelf it visits, with its leaves there; a bounded number of rows at a time.

    Leaves visited hold ``k`` vectors besides the query's own (third column: how many those are).
    """
    def run(batches):
        grown = tree.value
        step = max(1, VISIT_ROWS // int(grown.shelves.sum()))
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                paths = grown.walks(_matrix(part.column(1)), visits, [k + n for n in part.column(2).to_pylist()])
                row = np.repeat(np.arange(len(paths)), [len(p) for p in paths])
                leaf = np.concatenate(paths).astype(np.int64)
                many = grown.shelves[leaf]  # a leaf in several shelves counts for each of them
                first = np.repeat(np.cumsum(many) - many, many)
                row, leaf = np.repeat(row, many), np.repeat(leaf, many)
                shelf = grown.shelf[leaf] + np.arange(len(leaf)) - first
                order = np.lexsort((leaf, shelf, row))
                row, leaf, shelf = row[order], leaf[order], shelf[order]
                new = np.append(True, (row[1:] != row[:-1]) | (shelf[1:] != shelf[:-1]))
                starts = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(leaf.astype(np.int32)))
                n = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(n), part.column(1).take(n), pa.array(shelf[starts].astype(np.int32)), lists],
                    ["id", "vector", "shelf", "leaves"])
    return run


def _filed(tree):
    def run(batches):
        for batch in batches:
            leaf = tree.value.assign(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(leaf.astype(np.int32))], ["id", "vector", "leaf"])
    return run


class Index:
    """Every usable vector of a table under its leaf, in a checkpoint."""

    def __init__(self, vectors: DataFrame, width: int, sample: int = SAMPLE, branch: int = BRANCH, leaf: int = LEAF,
                 part: int = PART):
        spark = vectors.sparkSession
        self.kind = vectors.schema["vector"].dataType.simpleString()
        size = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.aggregate(
            F.col("vector"), F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))).alias("longest")).first()
        self.rows, self.leaves, self.vectors = size["n"], 0, vectors
        if not self.rows:
            return
        # Only rows near the beginning of the hash order are sorted: somewhat more than the sample.
        order = F.xxhash64("id", "vector")
        share = min(1.0, 1.25 * sample / self.rows)
        early = vectors if share == 1 else vectors.filter(
            F.shiftrightunsigned(order, 11) < F.lit(int(share * (1 << 53))))
        chosen = early.orderBy(order, "id").limit(sample).select("vector").toArrow()
        grown = grow(_matrix(chosen["vector"], width), size["longest"], branch, leaf)
        self.leaves = grown.leaves
        first = spark.sparkContext.broadcast(grown)  # at most ``sample`` leaves
        filed = cut(vectors.select("id", "vector").mapInArrow(
            _filed(first), f"id long, vector {self.kind}, leaf int"))
        distinct = filed.groupBy("leaf", "id", F.xxhash64("vector").alias("h")).agg(F.count(F.lit(1)).alias("n"))
        distinct = cut(distinct.select("leaf", "id", "n"))  # narrow
        stored, grown.held = np.zeros((2, self.leaves), dtype=np.int64)
        for r in distinct.groupBy("leaf").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held")).collect():
            stored[r["leaf"]], grown.held[r["leaf"]] = r["n"], r["held"]  # one row for each leaf
        grown.place(stored, part)
        self.tree = spark.sparkContext.broadcast(grown)
        self.repeats = distinct.groupBy(F.col("id").alias("__id")).agg(F.count(F.lit(1)).alias("__own"))
        shelf = F.element_at(F.lit(grown.shelf.tolist()), F.col("leaf") + 1)
        many = F.element_at(F.lit(grown.shelves.tolist()), F.col("leaf") + 1)
        self.filed = filed.select(
            (shelf + F.pmod(F.xxhash64("id"), many)).cast("int").alias("shelf"), F.lit(0).alias("query"), "id",
            "vector", F.array("leaf").alias("leaves"))

    def search(self, queries: DataFrame, k: int, visits: int) -> DataFrame:
        """``query_id, rank, vec_id, score``: the ``k`` best vectors in the leaves visited."""
        own = queries.join(self.repeats, queries["id"] == self.repeats["__id"], "left")
        tasks = max(self.vectors.sparkSession.sparkContext.defaultParallelism, -(-queries.count() // WALKS))
        own = own.select("id", "vector", F.coalesce("__own", F.lit(0)).alias("own")).repartition(tasks)
        asked = cut(own.mapInArrow(
            _visits(self.tree, k, visits), f"id long, vector {self.kind}, shelf int, leaves array<int>"))
        blocks = asked.groupBy(F.col("shelf").alias("__shelf")).agg(
            F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).cast("int").alias("blocks"))
        stored = self.filed.join(blocks, F.col("shelf") == F.col("__shelf")).select(
            "shelf", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "query", "id", "vector",
            "leaves")
        asked = asked.join(blocks, F.col("shelf") == F.col("__shelf")).select(
            "shelf", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("query"),
            "id", "vector", "leaves")
        rows = stored.unionByName(asked)
        found = rows.repartition(*BLOCK).sortWithinPartitions(*BLOCK, "query").mapInArrow(_compare(k), FOUND)
        return _best(found, k)

    def exact(self, queries: DataFrame, k: int) -> DataFrame:
        """The same by comparing a bounded set of queries with all vectors, batch by batch."""
        asked = queries.select("id", "vector").toArrow()
        probes = self.vectors.sparkSession.sparkContext.broadcast(
            (asked["id"].to_numpy(), _matrix(asked["vector"])))

        def run(batches):
            ids, points = probes.value
            best = [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)]
            for batch in batches:
                for low in range(0, batch.num_rows, PART):
                    part = batch.slice(low, PART)
                    shelf = Shelf(part.column(0).to_numpy(), np.zeros(part.num_rows, dtype=np.int64),
                                  _matrix(part.column(1)), k)
                    new = shelf.best(ids, points)
                    best = first_of(*(np.concatenate(x) for x in zip(best, new)), k)
            if len(best[0]):
                yield _batch(ids[best[0]], best[1], best[2])

        return _best(self.vectors.select("id", "vector").mapInArrow(run, FOUND), k)

    def calibrate(self, queries: DataFrame, k: int, recall: float = RECALL, probes: int = PROBES) -> int:
        """Leaves to visit for ``recall`` over ``probes`` of the queries, against the exact result."""
        few = cut(queries.orderBy(F.xxhash64("id"), "id").limit(probes))
        truth = self.exact(few, k).select("query_id", F.col("vec_id").alias("id"))
        leaves = self.filed.select("id", F.element_at("leaves", 1).alias("leaf"))
        places = leaves.join(F.broadcast(truth), "id").groupBy("query_id").agg(  # k rows a probe at most
            F.collect_list("leaf").alias("leaves"))
        at = {r["query_id"]: r["leaves"] for r in places.collect()}
        grown, ranks = self.tree.value, []
        for row in few.collect():
            walk = grown.best_first(np.array(row["vector"], dtype=np.float64), self.leaves - 1)
            order = {leaf: n for n, leaf in enumerate(walk)}
            ranks.extend(order.get(leaf, self.leaves - 1) for leaf in at.get(row["id"], []))
        met = np.cumsum(np.bincount(ranks, minlength=1))
        visits = min(8, self.leaves)
        while ranks and visits < self.leaves and met[min(visits, len(met)) - 1] < recall * len(ranks):
            visits += 1
        return visits


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, recall: float = RECALL,
                       **options) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest vectors found for each query.

    Both tables have ``vec_id`` and ``embedding``; other columns are ignored. A query is not its own
    neighbour (rows with its id). NULL, all-zero or not wholly finite vectors and NULL ids take no
    part; nor do vectors whose length is not the commonest one. Rows that repeat id and vector are
    one candidate. Fewer than ``k`` candidates are all returned; an empty table gives no rows.
    """
    kinds = {df.schema["embedding"].dataType.simpleString() for df in (vectors, queries)}
    kind = kinds.pop() if kinds == {"array<float>"} else "array<double>"  # floats are widened where they are multiplied

    def clean(df):
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("vector")).filter(
            F.col("id").isNotNull() & usable(F.col("vector")))

    all_rows = clean(vectors)
    width = all_rows.groupBy(F.size("vector").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "w").first()
    if width is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = F.size("vector") == width["w"]
    asked = cut(clean(queries).filter(same).distinct())
    index = Index(all_rows.filter(same), width["w"], **options)
    return index.search(asked, k, index.calibrate(asked, k, recall))
