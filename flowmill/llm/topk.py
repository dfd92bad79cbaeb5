"""Exact top-k by inner product: a dual-tree search over cover trees of queries and of all vectors.

Vectors are dealt to pivots - a net of farthest points of a bounded sample (`SAMPLE` rows), so the
pivots are the top level of the cover tree - and each pivot's vectors to chunks of about `CHUNK`, by a
hash, so a pivot that many vectors share is many chunks. A chunk's own cover tree is built where its
rows meet. Queries are dealt and indexed in the same way.

A pair of nodes can be left out when the largest inner product that their centres and covering radii
allow is below the worst kth score of the query node. It is used three times: over pivots (on the
driver, at most PIVOTS^2 pairs), over chunks (in Spark, from their summaries), and within chunks. A
first round searches one chunk near each query chunk, for kth scores to begin with. Query chunks meet
a data chunk in groups of `TOGETHER`, so what a task holds is bounded.

Defined cases: vectors that are null or empty (an empty one has no components to be finite), or hold null or non-finite components, take no part, nor do
rows without an id; components beyond the range of a long are held at its ends; vectors are compared
with those of their own length; rows with a query's id are taken for its own and are no candidates of
it; of query rows with equal ids the least vector asks; repeated candidate rows count each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowmill.llm.shared import materialize

SAMPLE = 4096
PIVOTS = 64
CHUNK = 4096
QUERIES_A_CHUNK = 512
TOGETHER = 64
LEAF = 96
#: The ratio of the radii of a tree's levels, the share of pairs over which a tree isn't worth its while, and the rows of a block then.
BASE = 1.3
WORTH = 0.5
BLOCK = 1024


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers, as integers held in the range of a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a @ b.T).astype(np.int64)
    exact = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(u, v, strict=True)))) for v in b] for u in a]
    return np.array(exact, np.int64).reshape(len(a), len(b))


def distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((points - centre) ** 2).sum(axis=1))


def farthest(points: np.ndarray, most: int, radius: float) -> list[int]:
    """Indices of a net: farthest points in turn, until all lie within the radius of one."""
    net, near = [0], distances(points, points[0])
    while len(net) < most and near.max() > radius:
        net.append(int(near.argmax()))
        near = np.minimum(near, distances(points, points[net[-1]]))
    return net


class CoverTree:
    """A cover tree over rows of integers, down to cells of about `LEAF` rows.

    Level i has a net of the rows for the radius top / BASE^i: farthest rows become centres in turn, so each
    level's centres are also the next one's (nesting), lie further apart than its radius (separation), and
    hold every row within its radius (covering). A centre's parent is the nearest centre of the level above.
    A node that has itself as its only child is left out. The finest net stops at a centre for `LEAF` rows.

    `nodes` has, for each node in breadth-first order, where its rows begin and end, its centre's row, and where
    its children begin and end among the nodes; `radius` is measured over the node's rows."""

    def __init__(self, ids: np.ndarray, points: np.ndarray):
        order = np.lexsort((*points.T[::-1], ids)) if points.size else np.argsort(ids)
        ids, points = ids[order], points[order].astype(np.float64)
        most = max(1, -(-len(ids) // LEAF))
        centres, parent, born = [0], [0], [0]
        near, own = distances(points, points[0]), np.zeros(len(ids), np.int64)
        reach, level = float(near.max()), 0
        self.radii = [reach]
        while len(centres) < most and near.max() > 0:
            level, reach, above = level + 1, reach / BASE, own.copy()
            self.radii.append(reach)
            while len(centres) < most and near.max() > reach:
                row = int(near.argmax())
                far = distances(points, points[row])
                nearer = far < near
                nearer[row] = True
                own[nearer], near[nearer] = len(centres), far[nearer]
                centres.append(row)
                parent.append(int(above[row]))
                born.append(level)
        children: dict[int, dict[int, list[int]]] = {}
        for c in range(1, len(centres)):
            children.setdefault(parent[c], {}).setdefault(born[c], []).append(c)
        cells = np.split(np.argsort(own, kind="stable"), np.cumsum(np.bincount(own, minlength=len(centres)))[:-1])
        # (centre, level after which it has children) in breadth-first order, each with its children
        kin: list[list[int]] = []
        todo = [(0, 0)]
        for c, after in todo:
            later = min((k for k in children.get(c, ()) if k > after), default=None)
            kin.append([] if later is None else list(range(len(todo), len(todo) + 1 + len(children[c][later]))))
            if later is not None:
                todo += [(c, later), *[(x, later) for x in children[c][later]]]
        spans, rows = [(0, 0)] * len(todo), []

        def lay(node: int) -> None:
            begin = len(rows)
            if kin[node]:
                for child in kin[node]:
                    lay(child)
            else:
                rows.extend(cells[todo[node][0]].tolist())
            spans[node] = (begin, len(rows))

        lay(0)
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        self.ids, self.points = ids[rows], points[rows]
        self.nodes = np.array([(a, b, place[centres[c]], k[0] if k else 0, k[-1] + 1 if k else 0) for (a, b), (c, _), k in zip(spans, todo, kin, strict=True)], np.int64)
        self._measure()

    def _measure(self) -> None:
        self.centre = self.points[self.nodes[:, 2]]
        self.norm = np.sqrt((self.centre**2).sum(axis=1))
        self.radius = np.array([distances(self.points[a:b], c).max() for (a, b), c in zip(self.nodes[:, :2], self.centre, strict=True)])

    def pack(self) -> bytes:
        """Little-endian: rows, components, nodes; then ids, components (as doubles) and nodes."""
        head = np.array([*self.points.shape, len(self.nodes)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.ids.astype("<i8"), self.points.astype("<f8"), self.nodes.astype("<i8")))

    @classmethod
    def unpack(cls, raw: bytes) -> CoverTree:
        tree, held = cls.__new__(cls), np.frombuffer(raw, "<i8")
        n, size, nodes = held[:3].tolist()
        tree.ids = held[3 : 3 + n]
        tree.points = held[3 + n : 3 + n + n * size].view("<f8").reshape(n, size)
        tree.nodes = held[3 + n + n * size :].reshape(nodes, 5)
        tree._measure()
        return tree


def reach(queries: CoverTree, qi: np.ndarray, data: CoverTree, di: np.ndarray) -> np.ndarray:
    """No inner product between rows of two nodes is above this: a matrix for all pairs of the nodes given."""
    inner, qr, dr = queries.centre[qi] @ data.centre[di].T, queries.radius[qi][:, None], data.radius[di][None]
    qn, dn = queries.norm[qi][:, None], data.norm[di][None]
    top = inner + qr * dn + dr * qn + qr * dr
    return top + 1e-9 * (np.abs(top) + qn * dn + 1)


class Search:
    """The k best of a data tree for each query of a query tree, and how many of all pairs were scored.

    Pairs of nodes are taken best bound first, and left out where the bound is below the worst kth score
    among the query node's. Where the bounds of the finest nodes leave out few pairs - in many dimensions
    vectors lie at much the same distance from each other - the tree has nothing to give, and the whole
    product is taken in blocks: the same result, and the cost of brute force."""

    def __init__(self, queries: CoverTree, data: CoverTree, k: int, floor: np.ndarray):
        self.queries, self.data, self.k = queries, data, k
        self.floor = floor.astype(np.float64).copy()
        self.found: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        self.scored, self.pairs = 0, len(queries.ids) * len(data.ids)
        ql, dl = (np.flatnonzero(t.nodes[:, 4] == 0) for t in (queries, data))
        worst = np.array([self.floor[a:b].min() for a, b in queries.nodes[ql, :2]])
        bounds = reach(queries, ql, data, dl)
        rows, columns = (t.nodes[x, 1] - t.nodes[x, 0] for t, x in ((queries, ql), (data, dl)))
        open_ = float(rows @ (bounds >= worst[:, None]) @ columns)
        if open_ > WORTH * self.pairs and np.isfinite(worst).all():
            for a in range(0, len(data.ids), BLOCK):
                self._score(0, len(queries.ids), a, min(a + BLOCK, len(data.ids)))
        else:
            self._descend()

    def _score(self, qa: int, qb: int, da: int, db: int) -> None:
        scores, ids = dot(self.queries.points[qa:qb], self.data.points[da:db]), self.data.ids[da:db]
        self.scored += scores.size
        good = (scores >= self.floor[qa:qb, None]) & (self.queries.ids[qa:qb, None] != ids)
        for row in np.flatnonzero(good.any(axis=1)):
            at, mine = np.flatnonzero(good[row]), qa + int(row)
            if len(at) > self.k:
                at = at[np.lexsort((ids[at], -scores[row, at]))[: self.k]]
            best = sorted(self.found[mine] + list(zip(scores[row, at].tolist(), (-ids[at]).tolist(), strict=True)), reverse=True)[: self.k]
            self.found[mine] = best
            if len(best) == self.k:
                self.floor[mine] = max(self.floor[mine], best[-1][0])

    def _descend(self) -> None:
        q, d = self.queries, self.data
        todo = [(np.inf, 0, 0)]
        while todo:
            top, qi, di = todo.pop()
            qa, qb, _, qf, qt = q.nodes[qi]
            da, db, _, df, dt = d.nodes[di]
            if top < self.floor[qa:qb].min():
                continue
            if not qt and not dt:
                self._score(qa, qb, da, db)
                continue
            if qt and (not dt or q.radius[qi] >= d.radius[di]):
                qs, ds = np.arange(qf, qt), np.array([di])
            else:
                qs, ds = np.array([qi]), np.arange(df, dt)
            bounds = reach(q, qs, d, ds)
            todo += sorted((bounds[i, j], int(x), int(y)) for i, x in enumerate(qs) for j, y in enumerate(ds))


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id and the integer vector of each row that takes part."""
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    fine &= F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _matrix(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(n, -1)


def pivots_of(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each length of vectors a net of a bounded sample, the rows of least hash."""
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).toArrow()
    by: dict[int, list] = {}
    for v in sample["v"].to_pylist():
        by.setdefault(len(v), []).append(v)
    out = {}
    for size, vectors in by.items():
        points = np.unique(np.array(vectors, np.float64), axis=0)
        out[size] = points[farthest(points, max(1, PIVOTS * len(vectors) // sum(map(len, by.values()))), 0.0)]
    return out


def dealt(rows: DataFrame, pivots: dict[int, np.ndarray], chunk: int, ahead: str) -> DataFrame:
    """Rows with their pivot's number (a length without pivots has one, at the origin), the distance to it, and a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(1).value_lengths())
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                points = _matrix(part.column(1), len(part))
                net = pivots.get(size, np.zeros((1, size)))
                far = np.stack([distances(points, p) for p in net])
                own = far.argmin(axis=0)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(part), size), pa.int32()), pa.array(own, pa.int32()), pa.array(far.min(axis=0))], ["vec_id", "v", "size", "pivot", "far"])

    placed = materialize(rows.mapInArrow(run, "vec_id long, v array<long>, size int, pivot int, far double"), ahead)
    counts = placed.groupBy("size", "pivot").agg(F.expr(f"cast(ceil(count(*) / {chunk}) as int)").alias("chunks"))
    return placed.join(counts, ["size", "pivot"]).withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "vec_id", "v"), "chunks").cast("int")).drop("chunks")


CHUNKS = "size int, pivot int, chunk int, centre array<double>, radius double, norm double, tree binary"


def indexed(rows: DataFrame, ahead: str) -> DataFrame:
    """One row for each chunk: its covering ball and its tree."""

    def build(t: pa.Table) -> pa.Table:
        tree = CoverTree(np.asarray(t["vec_id"], np.int64), _matrix(t["v"], len(t)))
        key = [[t[c][0].as_py()] for c in ("size", "pivot", "chunk")]
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        return pa.table([*[pa.array(k, pa.int32()) for k in key], pa.array([tree.centre[0].tolist()]), pa.array([tree.radius[0]]), pa.array([tree.norm[0]]), pa.array([tree.pack()], pa.binary())], names)

    grouped = rows.select("size", "pivot", "chunk", "vec_id", "v").groupBy("size", "pivot", "chunk")
    return materialize(grouped.applyInArrow(build, CHUNKS), ahead)


def _reach(qc: Column, qr: Column, qn: Column, dc: Column, dr: Column, dn: Column) -> Column:
    inner = F.aggregate(F.zip_with(qc, dc, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    top = inner + qr * dn + dr * qn + qr * dr
    return top + F.lit(1e-9) * (F.abs(top) + qn * dn + 1)


def _pivot_pairs(queries: DataFrame, data: DataFrame, worst: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Pairs of pivots whose vectors may meet; the driver sees a radius and a score for each pivot."""
    spark = queries.sparkSession
    radius = {(side, r["size"], r["pivot"]): r["far"] for side, rows in (("q", queries), ("d", data)) for r in rows.groupBy("size", "pivot").agg(F.max("far").alias("far")).collect()}
    least = {(r["size"], r["pivot"]): r["worst"] for r in worst.groupBy("size", "pivot").agg(F.min("worst").alias("worst")).collect()}
    pairs = []
    for (side, size, p), far in radius.items():
        for (other, size2, p2), far2 in radius.items():
            if side == "q" and other == "d" and size == size2:
                net = pivots.get(size, np.zeros((1, size)))
                q, d, qr, dr = net[p], net[p2], far * (1 + 1e-12), far2 * (1 + 1e-12)
                qn, dn = float(np.sqrt((q**2).sum())), float(np.sqrt((d**2).sum()))
                top = float(q @ d) + qr * dn + dr * qn + qr * dr
                if top + 1e-9 * (abs(top) + qn * dn + 1) >= least.get((size, p), -np.inf):
                    pairs.append((size, p, p2))
    return spark.createDataFrame(pairs, "size int, pivot int, other int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all other rows, ties to the smaller vec_id."""
    rows = materialize(scaled(vectors), "vectors")
    pivots = pivots_of(rows)
    data_rows = dealt(rows, pivots, CHUNK, "data_dealt")
    asking = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    query_rows = dealt(asking, pivots, QUERIES_A_CHUNK, "queries_dealt")
    data, queries = indexed(data_rows, "data_trees"), indexed(query_rows, "query_trees")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = CoverTree.unpack(row["tree"])
                floor = np.full(len(q.ids), -np.inf)
                if row["near"] is not None:
                    found = Search(q, CoverTree.unpack(row["near"]), k, floor).found
                    floor = np.array([f[-1][0] if len(f) == k else -np.inf for f in found], np.float64)
                worst = float(floor.min())
                yield pa.RecordBatch.from_arrays([pa.array([row["size"]], pa.int32()), pa.array([row["pivot"]], pa.int32()), pa.array([row["chunk"]], pa.int32()), pa.array([floor.tolist()]), pa.array([worst])], ["size", "pivot", "chunk", "floor", "worst"])

    near = data.where("chunk = 0").select("size", "pivot", F.col("tree").alias("near"))
    begun = queries.join(near, ["size", "pivot"], "left").select("size", "pivot", "chunk", "tree", "near")
    floors = materialize(begun.mapInArrow(first, "size int, pivot int, chunk int, floor array<double>, worst double"), "floors")

    pairs = _pivot_pairs(query_rows, data_rows, floors, pivots)
    q = queries.drop("tree").join(floors.drop("floor"), ["size", "pivot", "chunk"]).select("size", "pivot", "chunk", F.col("centre").alias("qc"), F.col("radius").alias("qr"), F.col("norm").alias("qn"), "worst")
    d = data.select("size", F.col("pivot").alias("other"), F.col("chunk").alias("other_chunk"), F.col("centre").alias("dc"), F.col("radius").alias("dr"), F.col("norm").alias("dn"))
    could = _reach(*(F.col(c) for c in ("qc", "qr", "qn", "dc", "dr", "dn"))) >= F.col("worst")
    key = ["size", "other", "other_chunk", "together"]
    meet = q.join(pairs, ["size", "pivot"]).join(d, ["size", "other"]).where(could)
    meet = materialize(meet.select("size", "pivot", "chunk", "other", "other_chunk", F.pmod(F.xxhash64("pivot", "chunk"), F.lit(TOGETHER)).alias("together")), "meet")
    groups = meet.groupBy(*key[:3]).agg(F.count("*").alias("n"))
    meet = meet.join(groups, key[:3]).withColumn("together", F.when(F.col("n") > TOGETHER, F.col("together")).otherwise(F.lit(0))).drop("n")
    asked = meet.join(queries.select("size", "pivot", "chunk", F.col("tree").alias("q_tree")).join(floors.drop("worst"), ["size", "pivot", "chunk"]), ["size", "pivot", "chunk"]).select(*key, "q_tree", "floor")
    held = meet.select(*key).distinct().join(data.select("size", F.col("pivot").alias("other"), F.col("chunk").alias("other_chunk"), F.col("tree").alias("d_tree")), key[:3]).select(*[F.col(c).alias(f"d_{c}") for c in key], "d_tree")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        for tree in right["d_tree"].to_pylist():
            data_tree = CoverTree.unpack(tree)
            for i in range(len(left)):
                query_tree = CoverTree.unpack(left["q_tree"][i].as_py())
                for query, found in zip(query_tree.ids.tolist(), Search(query_tree, data_tree, k, np.array(left["floor"][i].as_py())).found, strict=True):
                    for score, minus in found:
                        for column, value in zip(out, (query, -minus, score), strict=True):
                            column.append(value)
        return pa.table([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    found = asked.groupBy(*key).cogroup(held.groupBy(*[f"d_{c}" for c in key])).applyInArrow(both, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
