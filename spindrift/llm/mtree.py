"""Exact top-k search in M-trees: paged metric nodes with covering radii and parent distances, best first.

The vectors are parted by their nearest pivot; each part is one M-tree, whose routing object at the top is the pivot.
Trees are tables of pages in the shared folder. A task takes some thousand queries, searches the tree that each lives in
first, and then the others by their least possible distance, reading the pages of those alone that the distances found so
far, pivot distance and covering radius don't rule out. In its own tree each query takes nodes by their least possible distance;
queries that are at the same node share its page. Through other trees the task goes page by page, with all queries that the page
isn't ruled out for: products of 32 bits with a bound on their error say which entries may be near, and the distances of these
are computed exactly. Entries of a page are sorted by their distance to the page's centre, so those that the triangle
inequality rules out are cut off at either end without computing a distance.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.llm._common import materialize, shared_path
from spindrift.llm.sortpass import by_length, matrix, usable

PAGE, TREE_ROWS, SLICE_QUERIES, LEAST_QUERIES, PIVOT_BYTES = 512, 8192, 4096, 256, 64 << 20
_EPS = 1e-9
_PAGE_SCHEMA = "tree int, page int, leaf boolean, refs array<bigint>, vecs array<double>, parent array<double>, radius array<double>"
_FOUND = "query_id bigint, neighbor_id bigint, rank int, distance double"


def _distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


class Best:
    """The k nearest so far of some queries: rows of distances and ids in order, infinite and -1 where there are fewer."""

    def __init__(self, queries: int, k: int):
        self.k, self.d, self.i = k, np.full((queries, k), np.inf), np.full((queries, k), -1)

    @property
    def bound(self) -> np.ndarray:
        return self.d[:, -1]

    def add(self, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
        """Take in neighbours (query, distance, id); ties by id."""
        own = np.unique(q)
        q = np.concatenate([q, np.repeat(own, self.k)])
        d, i = np.concatenate([d, self.d[own].ravel()]), np.concatenate([i, self.i[own].ravel()])
        order = np.lexsort((i, d, q))
        first = np.searchsorted(q[order], own)
        on = order[(first[:, None] + np.arange(self.k)).ravel()]
        self.d[own], self.i[own] = d[on].reshape(-1, self.k), i[on].reshape(-1, self.k)


class Tree:
    """Pages of an M-tree over rows (ids, x). A page is (leaf, refs, vectors, parent distances, covering radii)."""

    def __init__(self, pages: list[tuple]):
        self.pages = pages
        self.norms = [(p[2] * p[2]).sum(1) for p in pages]

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, center: np.ndarray, page: int = PAGE) -> Tree:
        """Page 0 is the root, whose centre is ``center``. Rows are split by nearest pivot until they fit a page."""
        pages: list = []

        def grow(rows: np.ndarray, c: np.ndarray) -> int:
            at = len(pages)
            pages.append(None)
            d = _distances(x[rows], c)
            if len(rows) <= page:
                order = np.lexsort((ids[rows], d))
                pages[at] = (True, ids[rows][order], x[rows][order], d[order], np.zeros(len(rows)))
                return at
            fan = min(page, 2 * -(-len(rows) // page))
            pivots = rows[np.linspace(0, len(rows) - 1, fan).astype(int)]
            cross = np.stack([_distances(x[rows], x[p]) for p in pivots], axis=1)
            near = cross.argmin(1)
            parts = [np.flatnonzero(near == j) for j in range(fan)]
            if max(map(len, parts)) == len(rows):  # nearly all alike: cut in even runs
                parts = np.array_split(np.arange(len(rows)), fan)
            refs, vecs, radii = [], [], []
            for j, part in enumerate(parts):
                if len(part):
                    vecs.append(x[pivots[j]])
                    radii.append(cross[part, j].max())
                    refs.append(grow(rows[part], x[pivots[j]]))
            vecs = np.array(vecs)
            parent = _distances(vecs, c)
            order = np.argsort(parent, kind="stable")
            pages[at] = (False, np.array(refs)[order], vecs[order], parent[order], np.array(radii)[order])
            return at

        grow(np.arange(len(ids)), center)
        return cls(pages)

    def search(self, q: np.ndarray, k: int, to_root: float, bound: float = np.inf, own: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, ids, distances computed) of the k nearest within ``bound``, ties by id, ``own`` left out."""
        best = Best(1, k)
        computed = self.search_all(q[None], np.array([-1 if own is None else own]), best, np.array([to_root]), np.array([bound]))
        n = int((best.i[0] >= 0).sum())
        return best.d[0, :n], best.i[0, :n], computed

    def search_all(self, x: np.ndarray, own: np.ndarray, best: Best, to_root: np.ndarray, bound: np.ndarray | None = None) -> int:
        """Bring ``best`` up to date for all queries ``x``, whose own ids are left out; returns the number of distances computed.

        Each round every query that has a node left within its bound takes its nearest one.
        """
        most = np.full(len(x), np.inf) if bound is None else bound
        qq = (x * x).sum(1)
        low, center = np.full((len(x), len(self.pages)), np.inf), np.zeros((len(x), len(self.pages)))
        low[:, 0], center[:, 0] = 0, to_root
        computed = 0
        while True:
            limit = np.minimum(best.bound, most)
            at = low.argmin(1)
            least = low[np.arange(len(x)), at]
            on = np.flatnonzero(np.isfinite(least) & (least <= limit + _EPS))
            if not len(on):
                return computed
            on = on[np.argsort(at[on], kind="stable")]
            for rows in np.split(on, np.flatnonzero(np.diff(at[on])) + 1):
                node = at[rows[0]]
                low[rows, node] = np.inf
                leaf, refs, vecs, parent, radii = self.pages[node]
                if not leaf:
                    d = np.sqrt(((x[rows, None] - vecs) ** 2).sum(2))
                    near = np.abs(center[rows, node, None] - parent) - radii <= limit[rows, None] + _EPS
                    computed += int(near.sum())
                    floor = np.maximum(np.maximum(d - radii, least[rows, None]), 0.0)
                    low[rows[:, None], refs] = np.where(near & (floor <= limit[rows, None] + _EPS), floor, np.inf)
                    center[rows[:, None], refs] = d
                    continue
                rows = rows[np.argsort(center[rows, node], kind="stable")]  # alike ranges side by side
                for part in np.array_split(rows, -(-len(rows) // 256)):
                    lo = np.searchsorted(parent, center[part, node] - limit[part] - _EPS)
                    hi = np.searchsorted(parent, center[part, node] + limit[part] + _EPS)
                    part, lo, hi = part[lo < hi], lo[lo < hi], hi[lo < hi]
                    if len(part):
                        computed += int((hi - lo).sum())
                        self._leaf(node, x, qq, own, best, part, int(lo.min()), int(hi.max()), limit[part])

    def _leaf(self, node: int, x: np.ndarray, qq: np.ndarray, own: np.ndarray, best: Best, rows: np.ndarray, lo: int, hi: int, limit: np.ndarray) -> None:
        _, refs, vecs, _, _ = self.pages[node]
        square = self.norms[node][lo:hi] - 2 * (x[rows] @ vecs[lo:hi].T) + qq[rows, None]
        slack = 1e-7 * (1 + qq[rows])
        top = np.minimum(limit, 1e150) ** 2 + slack
        hit = square <= top[:, None]
        many = np.flatnonzero(hit.sum(1) > 4 * best.k)
        if len(many):  # the k-th of these, the query itself apart, bounds what must be exact
            top[many] = np.minimum(top[many], np.partition(square[many], best.k, axis=1)[:, best.k] + slack[many])
            hit = square <= top[:, None]
        q, e = np.nonzero(hit)
        ids = refs[lo:hi][e]
        other = ids != own[rows[q]]
        q, e, ids = rows[q[other]], e[other], ids[other]
        if len(q):
            best.add(q, _distances(vecs[lo:hi][e], x[q]), ids)


    def sweep(self, x: np.ndarray, own: np.ndarray, best: Best, to_root: np.ndarray) -> None:
        """What ``search_all`` does, page by page; for queries whose bounds are good already."""
        offset, width = self.pages[0][2][0], x.shape[1] + 10
        away = x - offset
        moved = [p[2] - offset for p in self.pages]
        xx, norms = (away * away).sum(1), [(m * m).sum(1) for m in moved]
        far = np.sqrt(max(xx.max(), *(n.max() for n in norms))) or 1.0
        if not 1e-100 < far < 1e100:
            self.search_all(x, own, best, to_root)
            return
        narrow = np.concatenate([away / far, np.ones((len(x), 1))], axis=1).astype(np.float32)
        slop = _EPS * max(1.0, far)
        todo = [(0, np.arange(len(x)), np.zeros(len(x)), to_root, to_root)]
        while todo:
            node, rows, floor, low, high = todo.pop()
            on = floor <= best.bound[rows] + slop
            rows, low, high = rows[on], low[on], high[on]
            leaf, refs, vecs, parent, radii = self.pages[node]
            if not len(rows):
                continue
            if leaf:
                bound = best.bound[rows] + slop
                lo, hi = np.searchsorted(parent, low - bound), np.searchsorted(parent, high + bound)
                rows, lo, hi = rows[lo < hi], lo[lo < hi], hi[lo < hi]
                if len(rows):
                    lo, hi = int(lo.min()), int(hi.max())
                    entries = np.concatenate([moved[node][lo:hi] * (-2 / far), norms[node][lo:hi, None] / far**2], axis=1).astype(np.float32)
                    # products of so many terms, of numbers rounded to 24 bits
                    slack = 2.0**-22 * width * (np.sqrt(xx[rows]) / far + np.sqrt(norms[node].max()) / far) ** 2
                    self._near(node, lo, x, own, best, rows, narrow, entries.T, xx[rows] / far**2, slack, far)
                continue
            square = norms[node] - 2 * (away[rows] @ moved[node].T) + xx[rows, None]
            error = 2.0**-50 * width * (np.sqrt(xx[rows, None]) + np.sqrt(norms[node])) ** 2
            low, high = np.sqrt(np.maximum(square - error, 0)), np.sqrt(np.maximum(square + error, 0))
            floor = np.maximum(low - radii, 0)
            for j in np.argsort(-floor.mean(0), kind="stable"):
                todo.append((int(refs[j]), rows, floor[:, j], low[:, j], high[:, j]))

    def _near(self, node: int, lo: int, x: np.ndarray, own: np.ndarray, best: Best, rows: np.ndarray, narrow: np.ndarray, entries: np.ndarray, xx: np.ndarray, slack: np.ndarray, far: float) -> None:
        _, refs, vecs, _, _ = self.pages[node]
        top = (np.minimum(best.bound[rows] / far, 1e15) ** 2 - xx + slack).astype(np.float32)
        top += 2.0**-23 * np.abs(top)
        found = []
        for i in range(0, len(rows), 256):
            square = narrow[rows[i : i + 256]] @ entries
            some = np.flatnonzero(square.min(1) <= top[i : i + 256])
            square, most = square[some], top[i : i + 256][some]
            hit = square <= most[:, None]
            if (many := np.flatnonzero(hit.sum(1) > 4 * best.k)).size:  # the k-th of these, the query itself apart, bounds what must be exact
                kth = np.partition(square[many], best.k, axis=1)[:, best.k]
                most[many] = np.minimum(most[many], kth + 2.5 * slack[i + some[many]])
                hit = square <= most[:, None]
            at, e = np.nonzero(hit)
            found.append((some[at] + i, e + lo))
        q, e = (np.concatenate(f) for f in zip(*found))
        q, ids = rows[q], refs[e]
        other = ids != own[q]
        q, e, ids = q[other], e[other], ids[other]
        if len(q):
            best.add(q, _distances(vecs[e], x[q]), ids)


def _to_pages(tree: int, t: Tree) -> pa.Table:
    return pa.table({
        "tree": pa.array(np.full(len(t.pages), tree, np.int32)), "page": pa.array(np.arange(len(t.pages), dtype=np.int32)), "leaf": pa.array([p[0] for p in t.pages]),
        "refs": pa.array([p[1] for p in t.pages], pa.list_(pa.int64())), "vecs": pa.array([p[2].ravel() for p in t.pages], pa.list_(pa.float64())),
        "parent": pa.array([p[3] for p in t.pages], pa.list_(pa.float64())), "radius": pa.array([p[4] for p in t.pages], pa.list_(pa.float64())),
    })


def _from_pages(table: pa.Table) -> Tree:
    table = table.sort_by("page")
    pages = []
    for i in range(table.num_rows):
        refs, vecs, parent, radius = (np.asarray(table[c][i].values) for c in ("refs", "vecs", "parent", "radius"))
        pages.append((table["leaf"][i].as_py(), refs, vecs.reshape(len(refs), -1), parent, radius))
    return Tree(pages)


def _pivots(rows: DataFrame, tree_rows: int) -> dict[int, np.ndarray]:
    """Of each length one vector for every ``tree_rows``, by the least hashes of their ids; fewer where they would pass PIVOT_BYTES."""
    count = {r["n"]: r["count"] for r in rows.groupBy("n").count().collect()}
    size = sum(n * 8 * c for n, c in count.items()) / tree_rows
    wanted = [(n, max(1, math.ceil(c / (tree_rows * max(1.0, size / PIVOT_BYTES)))), c) for n, c in count.items()]
    plan = rows.sparkSession.createDataFrame([(n, t, min(1.0, (2 * t + 50) / c)) for n, t, c in wanted] or [(0, 0, 0.0)], "n int, trees int, share double")
    chance = F.xxhash64("id").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    few = rows.join(plan, "n").where(chance < F.col("share"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(chance, "id"))
    picked = few.withColumn("rank", rank).where("rank <= trees").select("n", "rank", "vec").toPandas().sort_values(["n", "rank"])
    return {int(n): np.stack(part["vec"].map(np.asarray).to_list()) for n, part in picked.groupby("n")}


def knn(df: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", page: int = PAGE, tree_rows: int = TREE_ROWS, every: int = 1) -> DataFrame:
    """(query_id, neighbor_id, rank, distance): for every vector its ``k`` nearest others of its length by Euclidean distance, exactly.
    With ``every`` the queries are the vectors whose id is divisible by it; all are searched.

    Ties go to the lesser id. With fewer than ``k`` others there are fewer rows. Vectors that are null, empty, or have null, NaN or
    infinite parts are neither queries nor neighbours; equal vectors are neighbours at distance 0; an id that repeats
    counts once. Other columns are ignored; an empty table gives no rows.

    Scale: vectors are shuffled to their tree and queries to their slice, once each; pages are read from the shared folder by the
    tasks that need them, each a slice of ``SLICE_QUERIES`` at most. What is broadcast is the pivots, bounded by PIVOT_BYTES. Where distances concentrate, as in
    many dimensions, bounds rule out little and the work is that of comparing all pairs; no method that is exact avoids that.
    """
    spark = df.sparkSession
    rows = materialize(usable(df, id_col, vec_col), "vectors")
    by = _pivots(rows, tree_rows)
    if not by:
        return spark.createDataFrame([], _FOUND)
    first = dict(zip(by, np.cumsum([0, *map(len, by.values())]).tolist()))
    shared = spark.sparkContext.broadcast(by)

    def assign(batches):
        for batch in batches:
            for n, part in by_length(batch, 1):
                x, p = matrix(part.column(2)), shared.value[n]
                near, step = np.empty(len(x), np.int64), max(1, (4 << 20) // len(p))
                moved = p - p[0]  # any tree will do: rounding may at most choose one of two that are as near
                norms = (moved * moved).sum(1)
                for i in range(0, len(x), step):
                    near[i : i + step] = (norms - 2 * ((x[i : i + step] - p[0]) @ moved.T)).argmin(1)
                yield pa.RecordBatch.from_arrays([pa.array((near + first[n]).astype(np.int32)), *(part.column(i) for i in range(3)), pa.array(_distances(x, p[near]))], ["tree", "id", "n", "vec", "away"])

    assigned = materialize(rows.mapInArrow(assign, "tree int, id bigint, n int, vec array<double>, away double"), "assigned")
    asked = F.col("id") % every == 0
    extent = {r["tree"]: (r["away"], r["n"], r["count"]) for r in assigned.groupBy("tree", "n").agg(F.max("away").alias("away"), F.count_if(asked).alias("count")).collect()}

    def build(table: pa.Table) -> pa.Table:
        tree, n = table["tree"][0].as_py(), table["n"][0].as_py()
        return _to_pages(tree, Tree.build(table["id"].to_numpy(), matrix(table["vec"]), shared.value[n][tree - first[n]], page))

    folder = shared_path(spark, "pages")
    assigned.groupBy("tree").applyInArrow(build, _PAGE_SCHEMA).write.partitionBy("tree").parquet(folder)
    where = folder if "://" in folder else "file://" + folder.removeprefix("file:")

    def load(tree: int) -> Tree:
        fs, base = pafs.FileSystem.from_uri(where)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{base}/tree={tree}")) if f.path.endswith(".parquet")]
        return _from_pages(pa.concat_tables([pq.read_table(f, filesystem=fs, partitioning=None) for f in files]))

    reach = {t: away for t, (away, _, _) in extent.items()}

    def search(table: pa.Table) -> pa.Table:
        n, homes = table["n"][0].as_py(), table["tree"].to_numpy()
        x, ids, best, pivots = matrix(table["vec"]), table["id"].to_numpy(), Best(table.num_rows, k), shared.value[n]

        def take(j: int, on: np.ndarray, d: np.ndarray, way) -> None:
            if len(on):
                own = Best(len(on), k)
                own.d, own.i = best.d[on], best.i[on]
                way(load(first[n] + j))(x[on], ids[on], own, d)
                best.d[on], best.i[on] = own.d, own.i

        for home in np.unique(homes):
            on = np.flatnonzero(homes == home)
            take(home - first[n], on, _distances(x[on], pivots[home - first[n]]), lambda t: t.search_all)
        # a rough order is enough; who needs a tree is decided by distances when it comes up
        moved, away = pivots - pivots[0], x - pivots[0]
        norms, xx = (moved * moved).sum(1), (away * away).sum(1)
        closest = np.concatenate([(norms[i : i + 512] - 2 * (away @ moved[i : i + 512].T) + xx[:, None]).min(0) for i in range(0, len(moved), 512)])
        radius = np.array([reach.get(first[n] + j, -np.inf) for j in range(len(pivots))])
        order = np.argsort(np.maximum(np.sqrt(np.maximum(closest, 0)) - radius, 0), kind="stable")
        for j in order[np.isfinite(radius[order])]:
            d = _distances(x, pivots[j])
            on = np.flatnonzero((d - radius[j] <= best.bound + _EPS * np.maximum(1, d)) & (homes != first[n] + j))
            take(j, on, d[on], lambda t: t.sweep)
        q, r = np.nonzero(best.i >= 0)
        return pa.table({"query_id": ids[q], "neighbor_id": best.i[q, r], "rank": (r + 1).astype(np.int32), "distance": best.d[q, r]})

    total = sum(c for _, _, c in extent.values())
    most = min(SLICE_QUERIES, max(LEAST_QUERIES, -(-total // (3 * spark.sparkContext.defaultParallelism))))
    sliced = assigned.where(asked).join(spark.createDataFrame(_slices(extent, most), "tree int, base int, parts int"), "tree")
    sliced = sliced.select("tree", "id", "n", "vec", (F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("slice"))
    return sliced.groupBy("slice").applyInArrow(search, _FOUND)


def _slices(extent: dict[int, tuple], most: int) -> list[tuple[int, int, int]]:
    """(tree, first slice, slices) of each tree's queries: trees of one length share a slice until it would have more than
    ``most``; a tree that has more by itself is parted."""
    out, base, size, length = [], -1, 0, None
    for tree, (_, n, count) in sorted(extent.items()):
        if size == 0 or n != length or size + count > most:
            base, size, length = base + 1, 0, n
        parts = max(1, math.ceil(count / most))
        out.append((tree, base, parts))
        base, size = base + parts - 1, 0 if parts > 1 else size + count
    return out


ORACLE_KNN = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
d AS (
  SELECT a.vec_id AS query_id, b.vec_id AS neighbor_id, list_distance(a.e, b.e) AS dist FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, neighbor_id) AS rn FROM d)
SELECT query_id, neighbor_id, CAST(rn AS INTEGER) AS rank, round(dist, 6) AS distance FROM r WHERE rn <= 10
"""
