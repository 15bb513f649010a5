"""SimHash near-dedup by multi-index hashing.

A text's features are its lower-case words (runs of letters and digits), weighted by the root of their count; a text
without words has its stripped self as the one feature. The fingerprint is the sign of the weighted sum of 128-bit
hashes. The bits are cut into segments, each with a ball radius of its own. Where the radii, each plus one, add up to more
than the distance sought, two fingerprints within that distance differ by no more than the ball radius in some segment
(else every segment adds a bit too many), so enumerating the balls within each segment finds every pair; complete distances
are verified then. Nothing is sampled or capped.

Scale: ``layout`` chooses widths and radii from the number of distinct fingerprints: the more there are, the wider the
segments and the larger the balls, so that a probe meets about one row however large the table is. Equal fingerprints
collapse first, and are named after the components are known. Rows are grouped by (segment, leading bits), as many leading
bits as keep a group small; a ball member that flips leading bits travels as an extra row, the others are enumerated
inside the group. As pairs are symmetric, a member is enumerated only where it clears the highest bit that it flips; each
pair is then met from one side. A group reports a spanning forest of its verified pairs instead of the pairs, and members
that are known to be in one component aren't compared again, so thousands of copies cost thousands of rows.
"""

from __future__ import annotations

import functools
import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._common import Positional, alone, components, discard, pick, stored

BITS, RADIUS, GROUP_ROWS = 128, 17, 1 << 17
_WORD = re.compile(r"[^\W_]+")
_CACHE_WORDS = 100_000
#: Widest segment and largest ball that are weighed; a bucket of more rows than ``_MANY`` is compared leader by leader.
_WIDEST, _LARGEST, _MANY = 44, 6, 64

Layout = tuple[tuple[int, int, int], ...]


@functools.lru_cache(1000)
def layout(n: int, radius: int = RADIUS) -> Layout:
    """(first bit, width, ball radius) of the segments that find all pairs within ``radius`` among ``n`` fingerprints.

    The least work for a fingerprint by a dynamic program over bits and radii: a segment of ``w`` bits and ball radius ``t``
    costs its ball's members, and for each of them the ``n / 2**w`` rows that it meets on average.
    """
    n = 1 << max(0, n - 1).bit_length()
    price = {(w, t): sum(math.comb(w, j) for j in range(t + 1)) * (1 + 1.5 * n / 2**w) for w in range(1, _WIDEST + 1) for t in range(min(w - 1, _LARGEST) + 1)}
    best: dict[tuple[int, int], tuple[float, tuple]] = {(b, 0): (0.0, ()) for b in range(BITS + 1)}
    for mass in range(1, radius + 2):
        for bits in range(1, BITS + 1):
            found = None
            for (w, t), cost in price.items():
                if w <= bits and (before := best.get((bits - w, max(0, mass - t - 1)))) and (found is None or before[0] + cost < found[0]):
                    found = before[0] + cost, (*before[1], (w, t))
            if found:
                best[bits, mass] = found
    parts = best[BITS, radius + 1][1]
    first = [0, *itertools.accumulate(w for w, _ in parts)]
    return tuple((f, w, t) for f, (w, t) in zip(first, parts))


def masks(width: int, flips: int) -> list[int]:
    """All numbers of ``width`` bits of which ``flips`` are set."""
    return [sum(1 << b for b in on) for on in itertools.combinations(range(width), flips)]


class _Hasher:
    """Sign rows of words, kept between batches up to a bounded number."""

    def __init__(self):
        self.clear()

    def clear(self):
        self.row: dict[str, int] = {}
        self.signs = np.empty((4096, BITS), np.int8)

    def lookup(self, words: list[str]) -> np.ndarray:
        fresh = [w for w in words if w not in self.row]
        if fresh:
            if len(self.row) + len(fresh) > _CACHE_WORDS:
                self.clear()
                fresh = words
            n = len(self.row)
            while len(self.signs) < n + len(fresh):
                self.signs = np.concatenate([self.signs, np.empty_like(self.signs)])
            digests = b"".join(xxhash.xxh3_128_digest(w.encode("utf-8", "surrogatepass")) for w in fresh)
            self.signs[n : n + len(fresh)] = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(len(fresh), 16), axis=1).astype(np.int8) * 2 - 1
            self.row.update((w, n + i) for i, w in enumerate(fresh))
        return self.signs[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))]


_hasher = _Hasher()


def fingerprint(text: str | None) -> bytes | None:
    """16 bytes, or None where the text is null or blank. A sum of exactly 0 gives bit 0."""
    if text is None or not (stripped := text.strip()):
        return None
    words = _WORD.findall(text.lower()) or [stripped]
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    weights = np.sqrt(np.fromiter(count.values(), np.float32, len(count)))
    names, total = list(count), np.zeros(BITS, np.float32)
    for i in range(0, len(names), 20_000):
        total += weights[i : i + 20_000] @ _hasher.lookup(names[i : i + 20_000]).astype(np.float32)
    return np.packbits(total > 1e-4).tobytes()


def _fingerprints(batches):
    alone("simhash", _hasher.clear)
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        both = [fingerprint(t.as_py()) for t in texts]
        flat = np.frombuffer(b"".join(x or bytes(16) for x in both), ">i8").astype(np.int64).reshape(-1, 2)
        void = np.array([x is None for x in both], bool)
        yield pa.RecordBatch.from_arrays([ids, pa.array(np.ascontiguousarray(flat[:, 0]), mask=void), pa.array(np.ascontiguousarray(flat[:, 1]), mask=void)], ["id", "hi", "lo"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, hi, lo): the two halves of each fingerprint, null for null and blank texts."""
    return pick(df, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint")).mapInArrow(_fingerprints, "id bigint, hi bigint, lo bigint")


def _segment(hi: np.ndarray, lo: np.ndarray, first: int, width: int) -> np.ndarray:
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    end, mask = first + width, np.uint64((1 << width) - 1)
    if end <= 64:
        return ((hi >> np.uint64(64 - end)) & mask).astype(np.int64)
    if first >= 64:
        return ((lo >> np.uint64(128 - end)) & mask).astype(np.int64)
    return (((hi << np.uint64(end - 64)) | (lo >> np.uint64(128 - end))) & mask).astype(np.int64)


def _spread(parts: Layout, prefix_bits: int):
    """Rows by (segment, prefix); ``left`` is what a guest may still flip inside the group, -1 where the row is at home."""

    def spread(batches):
        alone("simhash pairs")
        for batch in batches:
            node, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for s, (first, width, ball) in enumerate(parts):
                own = min(prefix_bits, width)
                prefix = _segment(hi, lo, first, width) >> (width - own)
                groups, picks, left = [prefix], [np.arange(len(node))], [np.full(len(node), -1, np.int8)]
                for flips in range(1, min(ball, own) + 1):
                    for mask in masks(own, flips):
                        on = np.flatnonzero(prefix >> (mask.bit_length() - 1) & 1)
                        groups.append(prefix[on] ^ mask)
                        picks.append(on)
                        left.append(np.full(len(on), ball - flips, np.int8))
                g, at = np.concatenate(groups), np.concatenate(picks)
                yield pa.RecordBatch.from_arrays([pa.array(s << prefix_bits | g), pa.array(np.concatenate(left)), pa.array(node[at]), pa.array(hi[at]), pa.array(lo[at])], ["grp", "left", "node", "hi", "lo"])

    return spread


class Forest:
    """Union by least root over arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.root[a], self.root[b]
            on = ra != rb
            if not on.any():
                return
            a, b, ra, rb = a[on], b[on], ra[on], rb[on]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _ranges(lo: np.ndarray, hi: np.ndarray, most: int):
    """Expand ranges into (owner, member) arrays, about ``most`` at a time."""
    n = hi - lo
    on = np.flatnonzero(n > 0)
    lo, n = lo[on], n[on]
    total = np.cumsum(n)
    start = 0
    while start < len(on):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + most, "right")))
        k = n[start:end]
        owner = np.repeat(on[start:end], k)
        member = np.arange(len(owner)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(lo[start:end], k)
        yield owner, member
        start = end


def _verify(parts: Layout, prefix_bits: int, radius: int):
    def verify(table: pa.Table) -> pa.Table:
        alone("simhash pairs")
        grp, left, node, hi, lo = (c.to_numpy() for c in table.columns)
        first, width, ball = parts[int(grp[0]) >> prefix_bits]
        free = width - min(prefix_bits, width)
        low = _segment(np.ascontiguousarray(hi), np.ascontiguousarray(lo), first, width) & ((1 << free) - 1)
        names, local = np.unique(node, return_inverse=True)
        forest = Forest(len(names))
        hi, lo = hi.view(np.uint64), lo.view(np.uint64)
        home = np.flatnonzero(left < 0)
        home = home[np.argsort(low[home], kind="stable")]
        key, thi, tlo, tloc = low[home], hi[home], lo[home], local[home]
        dense = free <= 20  # a place for every key; else the keys that there are
        keys = None if dense else np.unique(key)
        edge = np.concatenate([[0], np.cumsum(np.bincount(key, minlength=1 << free))]) if dense else np.append(np.searchsorted(key, keys), len(key))

        def place(value: np.ndarray) -> np.ndarray:
            """Bucket of each key; an empty one where there is none."""
            if dense:
                return value
            at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
            return np.where(keys[at] == value, at, -1)

        def near(xhi, xlo, member: np.ndarray) -> np.ndarray:
            return np.bitwise_count(xhi ^ thi[member]).astype(np.int16) + np.bitwise_count(xlo ^ tlo[member]) <= radius

        def compare(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
            """Each row of ``owner`` with the home rows of its range."""
            for at, member in _ranges(start, stop, 1_000_000):
                x = owner[at]
                on = near(hi[x], lo[x], member)
                forest.join(local[x[on]], tloc[member[on]])

        def within(lo_: int, hi_: int) -> None:
            """All pairs of a large bucket: who is near a leader is one component with it and needs no more comparing inside."""
            rest = np.arange(lo_, hi_)
            while len(rest) > 1:
                on = near(thi[rest[0]], tlo[rest[0]], rest[1:])
                same, other = rest[1:][on], rest[1:][~on]
                forest.join(np.full(len(same), tloc[rest[0]]), tloc[same])
                for x in same if len(other) else ():
                    if len(apart := other[forest.root[tloc[other]] != forest.root[tloc[x]]]):
                        on = near(thi[x], tlo[x], apart)
                        forest.join(np.full(int(on.sum()), tloc[x]), tloc[apart[on]])
                rest = other

        if len(home):
            count = np.diff(edge)
            for b in np.flatnonzero(count > _MANY):
                within(edge[b], edge[b + 1])
            bucket = np.repeat(np.arange(len(count)), count)
            small = np.flatnonzero(count[bucket] <= _MANY)
            compare(home[small], small + 1, edge[bucket[small] + 1])
            whole = np.full(len(count), -1)  # the component of buckets that are all of one
            some = np.flatnonzero(count)
            roots = forest.root[tloc]
            least, most = np.minimum.reduceat(roots, edge[some]), np.maximum.reduceat(roots, edge[some])
            whole[some] = np.where(least == most, least, -1)

            def probe(rows: np.ndarray, value: np.ndarray) -> None:
                at = place(value)
                on = (at >= 0) & (count[at] > 0)
                rows, at = rows[on], at[on]
                on = whole[at] != forest.root[local[rows]]
                compare(rows[on], edge[at[on]], edge[at[on] + 1])

            guests = [np.flatnonzero(left >= flips) for flips in range(ball + 1)]
            for flips in range(min(ball, free) + 1):
                for mask in masks(free, flips):
                    if flips:
                        on = np.flatnonzero(key >> (mask.bit_length() - 1) & 1)
                        probe(home[on], key[on] ^ mask)
                    if len(guests[flips]):
                        probe(guests[flips], low[guests[flips]] ^ mask)
        moved = np.flatnonzero(forest.root != np.arange(len(names)))
        return pa.table({"a": names[moved], "b": names[forest.root[moved]]})

    return verify


def near_edges(unique: DataFrame, n: int, radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Edges (a, b) that span the pairs within ``radius`` of ``unique`` (node, hi, lo), ``n`` rows without equal ones."""
    parts = layout(n, radius)
    prefix_bits = max(0, math.ceil(math.log2(max(1, n) / group_rows)))
    rows = unique.mapInArrow(_spread(parts, prefix_bits), "grp bigint, left tinyint, node bigint, hi bigint, lo bigint")
    return rows.groupBy("grp").applyInArrow(_verify(parts, prefix_bits, radius), "a bigint, b bigint")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, duplicate_of) for every document that isn't the first of its group; duplicate_of is the group's least id.

    Groups are the connected components of "fingerprints within ``radius`` bits" (0 to 40). ``group_rows`` is about how many
    fingerprints a task holds at home in a group; it changes no result.

    Null or blank texts and null ids are never duplicates. Equal texts always are. Rows that repeat an id count as one
    document if their texts agree; if not, each text is compared, and the id is named once, with the least id of the groups that
    its texts are in. Texts of any length are hashed whole. An empty table gives an empty result; other columns are ignored.

    Scale: fingerprints are shuffled, never texts. The work for a fingerprint grows with their number as its ball of probes
    does, about as its root; equal texts cost one row each, in a join that is split where a text has very many copies.
    """
    if not 0 <= radius <= 40:
        raise ValueError("radius must lie between 0 and 40")
    spark = df.sparkSession
    found, _ = stored(fingerprints(df, id_col, text_col).where("id is not null and hi is not null"), "fingerprints")
    unique, _ = stored(found.groupBy("hi", "lo").agg(F.min("id").alias("node")).select("node", "hi", "lo"), "unique")
    # one id may stand for several fingerprints where rows repeat it: nodes of the graph are numbered by id all the same
    edges, path = stored(near_edges(unique, unique.count(), radius, group_rows), "near")
    roots = components(edges)
    discard(spark, path)
    named = unique.join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("root"))
    return found.join(named, ["hi", "lo"]).where("id <> root").groupBy(F.col("id").alias("doc_id")).agg(F.min("root").alias("duplicate_of"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` without the documents that ``near_duplicates`` names; all columns as they were."""
    p = Positional(df)
    gone = near_duplicates(df, id_col, text_col, **options).select(F.col("doc_id").alias("__gone")).distinct()
    return p.restore(p.df.join(gone, p.col(id_col).cast("bigint") == F.col("__gone"), "left_anti"))
