"""Embedding near-dedup by sorted projection passes.

Each pass hashes a vector by random hyperplanes of its own, through the mean of all directions, and orders all vectors
lexicographically by the concatenated sign bits. Vectors that point nearly the same way share a long prefix, so they come to
stand close together; each is compared with the ``window`` that follow it. Pairs that reach the cosine are verified exactly
and joined across passes.

How many passes it takes goes by the table. Two vectors of cosine c, seen from the mean (of length m), have the cosine
1 - (1 - c) / (1 - m * m) and differ in a share q of their bits, the angle over pi. They stand within the window of each
other where they share the log2(n / window) bits that leave no more than a window of the n vectors between them, so a pass
misses them with probability 1 - (1 - q) ** log2(n / window) at most: ``passes_for`` passes find ``recall`` of the pairs
at the threshold itself. So many are done at first (``FIRST`` at most). That counts vectors spread as one cloud; where they
stand in dense ones there are more in between. So rounds of a third as many passes follow. If a third of the first
round misses a pair with probability y, the share of what is found that the k-th such round adds is y ** (k + 2) * (1 - y) /
(1 - y ** (k + 2)); solved for y, it says what is still missing, y ** (k + 3). Rounds end where that is 1 - ``recall`` or less.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._common import components, discard, pick, stored

BITS, WINDOW, COSINE, RECALL, FIRST, PART_ROWS = 62, 24, 0.95, 0.98, 32, 50_000


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, n, vec) of the rows that can be compared: no nulls, no NaN or infinity; n is the length, and only vectors of one
    length are comparable. An id that repeats counts once, with its least vector."""
    rows = pick(df, id=id_col, vec=vec_col).select(F.col("id").cast("bigint").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    rows = rows.where("id is not null and vec is not null and size(vec) > 0 and forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).select("id", F.size("vec").alias("n"), "vec")


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(flat, pa.ChunkedArray):
        flat = flat.chunk(0)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def by_length(batch: pa.RecordBatch, column: int):
    """Parts of a batch whose vectors are of one length, which stands in ``column``."""
    n = batch.column(column).to_numpy()
    for value in np.unique(n):
        yield int(value), batch if (n == value).all() else batch.take(pa.array(np.flatnonzero(n == value)))


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def passes_for(n: int, mean: float, cosine: float, window: int, recall: float) -> int:
    """Passes that find ``recall`` of the pairs at ``cosine`` among ``n`` vectors whose directions have a mean of that length."""
    if n <= window:
        return 1  # all stand within a window
    seen = max(0.0, 1 - (1 - cosine) / max(1e-6, 1 - mean * mean))
    meet = (1 - math.acos(min(1.0, seen)) / math.pi) ** max(1.0, math.log2(n / window))
    return max(1, math.ceil(math.log(1 - recall) / math.log1p(-min(meet, 0.999))))


def missing(share: float, k: int) -> float:
    """The share of all pairs that is still missing after the k-th further round added ``share`` of what was known before it."""
    lo, hi = 0.0, 1 - 1e-9
    for _ in range(60):
        y = (lo + hi) / 2
        m = y ** (k + 2)
        lo, hi = (y, hi) if m * (1 - y) / (1 - m) < share else (lo, y)
    return hi ** (k + 3)


def _means(rows: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """Of each length, how many vectors there are and the mean of their directions."""

    def run(batches):
        total: dict[int, list] = {}
        for batch in batches:
            for n, part in by_length(batch, 1):
                own = total.setdefault(n, [0, np.zeros(n)])
                own[0] += part.num_rows
                own[1] += _unit(matrix(part.column(2))).sum(0)
        for n, (count, sums) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([count]), pa.array([sums.tolist()])], ["n", "count", "sums"])

    parts = rows.mapInArrow(run, "n int, count bigint, sums array<double>").select("n", "count", F.posexplode("sums").alias("at", "x"))
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in parts.groupBy("n", "at").agg(F.sum("count").alias("count"), F.sum("x").alias("x")).collect():
        out.setdefault(r["n"], (r["count"], np.zeros(r["n"])))[1][r["at"]] = r["x"] / r["count"]
    return out


def _hash(passes: range, means: dict, seed: int):
    """(grp, key, id, sketch): one row a pass; grp is the length and the pass. A sketch is a direction in eight bits a
    number, with their unit and the length of what rounding took away, which bounds the error of a cosine."""

    def run(batches):
        for batch in batches:
            for n, part in by_length(batch, 1):
                u = _unit(matrix(part.column(2)))
                unit = np.abs(u).max(1, keepdims=True) / 127
                small = np.rint(u / unit).astype(np.int8)
                lost = np.sqrt(((u - small * unit) ** 2).sum(1, keepdims=True))
                flat = np.concatenate([np.concatenate([unit, lost], axis=1).astype(np.float32).view(np.int8), small], axis=1)
                sketch = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer((np.arange(len(u) + 1) * flat.shape[1]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
                for p in passes:
                    planes = np.random.default_rng([seed, p, n]).normal(size=(n, BITS))
                    key = ((u - means[n][1]) @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), n << 32 | p)), pa.array(key.astype(np.int64)), part.column(0), sketch], ["grp", "key", "id", "sketch"])

    return run


class _Rows:
    """Rows of one pass in order: places, ids, sketches."""

    def __init__(self, place: np.ndarray, ids: np.ndarray, sketch: np.ndarray):
        self.place, self.ids, self.sketch = place, ids, sketch

    def __getitem__(self, on) -> _Rows:
        return _Rows(self.place[on], self.ids[on], self.sketch[on])

    def near(self, window: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose places differ by at most ``window`` and whose cosine may reach the threshold."""
        head = np.ascontiguousarray(self.sketch[:, :8]).view(np.float32)
        x, lost = self.sketch[:, 8:].astype(np.float32) * head[:, :1], head[:, 1]
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(1, min(window, len(self.ids) - 1) + 1):
            dot = np.einsum("ij,ij->i", x[:-j], x[j:])
            may = dot >= cosine - 1e-5 - lost[:-j] - lost[j:] - lost[:-j] * lost[j:]
            at = np.flatnonzero(may & (self.place[j:] - self.place[:-j] <= window))
            a.append(self.ids[at])
            b.append(self.ids[at + j])
        return np.concatenate(a), np.concatenate(b)


def _join(one: _Rows, two: _Rows) -> _Rows:
    return _Rows(*(np.concatenate([getattr(one, f), getattr(two, f)]) for f in ("place", "ids", "sketch")))


def _runs(grp: np.ndarray, sketch: pa.Array):
    """(first, last, sketches) of the runs of rows of one pass."""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(grp)) + 1, [len(grp)]]) if len(grp) else [0]
    for lo, hi in itertools.pairwise(edges):
        part = sketch.slice(lo, hi - lo)
        edge = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, part.offset * 4)
        yield lo, hi, np.frombuffer(part.buffers()[2], np.int8, edge[-1] - edge[0], edge[0]).reshape(hi - lo, -1)


_OUT = "kind int, a bigint, b bigint, part int, place bigint, grp bigint, sketch binary"


def _out(kind, a, b, part, place, grp, sketch) -> pa.RecordBatch:
    n = len(a)
    full = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), n))
    return pa.RecordBatch.from_arrays([full(kind, np.int32), full(a, np.int64), full(b, np.int64), full(part, np.int32), full(place, np.int64), full(grp, np.int64), pa.array([None] * n if sketch is None else [s.tobytes() for s in sketch], pa.binary())], ["kind", "a", "b", "part", "place", "grp", "sketch"])


def _walk(window: int, cosine: float):
    """Pairs within a sorted partition (kind 0), its first and last rows (kind 1), and its size (kind 2)."""

    def run(batches):
        from pyspark import TaskContext

        part, seen, tail, of = TaskContext.get().partitionId(), 0, None, None
        for batch in batches:
            grp, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, sketch in _runs(grp, batch.column(3)):
                rows = _Rows(np.arange(seen, seen + hi - lo), ids[lo:hi], sketch)
                if seen < window:
                    head = rows[: window - seen]
                    yield _out(1, head.ids, 0, part, head.place, grp[lo], head.sketch)
                if of == grp[lo]:
                    rows = _join(tail, rows)
                elif tail is not None and seen - window > tail.place[0]:
                    tail = None
                yield _out(0, *rows.near(window, cosine), part, 0, 0, None)
                seen += hi - lo
                tail, of = rows[-window:], grp[lo]
        if tail is not None:
            last = tail[tail.place >= window]  # those before were given as first rows
            yield _out(1, last.ids, 0, part, last.place, of, last.sketch)
            yield _out(2, [seen], 0, part, 0, 0, None)

    return run


def near_pairs(rows: DataFrame, means: dict, passes: range, cosine: float = COSINE, window: int = WINDOW, seed: int = 3) -> DataFrame:
    """Verified pairs (a, b) of ``rows`` (id, n, vec) whose cosine is at least ``cosine`` and that one of ``passes`` brings close together.

    Sketches go through the sort; vectors meet only for the pairs whose sketches leave open that they are near.
    """
    count = sum(c for c, _ in means.values())
    parts = max(1, math.ceil(count * len(passes) / PART_ROWS))
    hashed, one = stored(rows.mapInArrow(_hash(passes, means, seed), "grp bigint, key bigint, id bigint, sketch binary"), "hashes")
    ordered = hashed.repartitionByRange(parts, "grp", "key", "id").sortWithinPartitions("grp", "key", "id")
    walked, two = stored(ordered.mapInArrow(_walk(window, cosine), _OUT), "walked")
    sizes = {r["part"]: r["a"] for r in walked.where("kind = 2").select("part", "a").collect()}
    before = itertools.accumulate([0, *[sizes[p] for p in sorted(sizes)]])
    offsets = rows.sparkSession.createDataFrame(list(zip(sorted(sizes), before)), "part int, base bigint")
    block = 4 * window
    ends = walked.where("kind = 1").join(offsets, "part").select("a", "grp", "sketch", (F.col("place") + F.col("base")).alias("place"))
    ends = ends.select("*", F.explode(F.array_distinct(F.array(F.floor(F.col("place") / block), F.floor((F.col("place") + window) / block)))).alias("block"))

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("place").combine_chunks()
        place, ids = table["place"].to_numpy(), table["a"].to_numpy()
        found = [_Rows(place[lo:hi], ids[lo:hi], s).near(window, cosine) for lo, hi, s in _runs(table["grp"].to_numpy(), table["sketch"].chunk(0))]
        return pa.table({"a": np.concatenate([a for a, _ in found]), "b": np.concatenate([b for _, b in found])})

    open_ = walked.where("kind = 0").select("a", "b").unionByName(ends.groupBy("block").applyInArrow(across, "a bigint, b bigint"))
    open_ = open_.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(batches):
        for batch in batches:
            for _, part in by_length(batch, 2):
                on = (_unit(matrix(part.column(3))) * _unit(matrix(part.column(4)))).sum(1) >= cosine - 1e-6
                yield pa.RecordBatch.from_arrays([part.column(i).filter(pa.array(on)) for i in (0, 1)], ["a", "b"])

    side = lambda c: rows.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}"))
    both = open_.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size("va").alias("n"), "va", "vb")
    pairs, _ = stored(both.mapInArrow(verify, "a bigint, b bigint"), "pairs")
    for path in (one, two):
        discard(rows.sparkSession, path)
    return pairs


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE, window: int = WINDOW, recall: float = RECALL, seed: int = 3) -> DataFrame:
    """(vec_id, duplicate_of) for every vector that isn't the first of its group; duplicate_of is the group's least id.

    Groups are the components of the verified pairs. Vectors are compared with those of their own length. Those that are null,
    empty, or have null, NaN or infinite parts are never duplicates; vectors of zeros have cosine 0 with all. Equal
    vectors are one until all passes are done, so any number of copies is joined and takes no place in a window. An id that
    repeats counts once. Other columns are ignored.

    Scale: each round is one range-partitioned sort of passes x vectors in sketches of a byte a number; only the ``window``
    first and last rows of a partition are compared again, by place in the whole order, and no group of rows is ever held
    as one. The number of passes grows as a power of the table (see above).
    """
    spark = df.sparkSession
    rows, _ = stored(usable(df, id_col, vec_col).where("exists(vec, x -> x <> 0)").withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(7), "vec")}), "vectors")
    one, _ = stored(rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.min("n").alias("n"), F.min("vec").alias("vec")).select("id", "n", "vec", "h1", "h2"), "unlike")
    vectors = one.select("id", "n", "vec")
    means = _means(vectors)
    first = min(FIRST, max([1, *[passes_for(count, float(np.sqrt(mean @ mean)), cosine, window, recall) for count, mean in means.values()]]))
    roots, known, done, more = None, 0, 0, first
    for k in itertools.count() if means else ():
        pairs = near_pairs(vectors, means, range(done, done + more), cosine, window, seed)
        old = [] if roots is None else [roots.select(F.col("node").alias("a"), F.col("root").alias("b"))]
        roots, _ = stored(components(functools.reduce(DataFrame.unionByName, old, pairs)), "roots")
        now, done, more = roots.count(), done + more, math.ceil(first / 3)
        if first == 1 or k and (not now or missing((now - known) / max(1, known), k) <= 1 - recall):
            break
        known = now
    if roots is None:
        return spark.createDataFrame([], "vec_id bigint, duplicate_of bigint")
    named = one.select(F.col("id").alias("node"), "h1", "h2").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    return rows.join(named, ["h1", "h2"]).where("id <> root").select(F.col("id").alias("vec_id"), F.col("root").alias("duplicate_of"))
