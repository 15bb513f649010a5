"""Quality classifier: naive Bayes support vectors over hashed n-gram indicators.

Features of a text are indicators (present or not) of its byte n-grams of 1 to 4, of its words, of its word pairs, and of the
share of words that repeat the word before, hashed into 2**18 places. Indicators are scaled by the class log-count
ratio and brought to unit length; a linear hinge-loss model is fitted to them by dual coordinate descent.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm._common import Positional, alone, discard, pick, stored

#: Bound of the labelled rows of each class that a model is fitted to.
SAMPLE_PER_CLASS = 3000
#: Bound of the bytes of their texts, half for each class: what is fitted to comes to the driver.
SAMPLE_BYTES = 128 << 20
LOG_SIZE = 18
_SIZE = 1 << LOG_SIZE
_RNG = np.random.default_rng(20240601)
_BYTE = _RNG.integers(0, 2**63, (4, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M, _K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_SHIFT = np.uint64(64 - LOG_SIZE)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at once; n-grams and words that cross a border are hashed as if there were none.
_BLOCK = 1 << 18


def _mark(flags: np.ndarray, h: np.ndarray) -> None:
    flags[((h ^ (h >> np.uint64(29))) * _M) >> _SHIFT] = True


def features(text: str, flags: np.ndarray | None = None) -> np.ndarray:
    """Sorted places of the indicators of a text that isn't null; whole texts, of any length."""
    flags = np.zeros(_SIZE, bool) if flags is None else flags
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    at, n = 0, len(raw)
    same = pairs = 0
    last = None
    begun, length = np.uint64(0), 0  # hash and bytes so far of a word that is longer than a block
    while at < n:
        end = min(n, at + _BLOCK)
        if end < n:  # ends a block after white space, where there is any
            spaces = np.flatnonzero(_SPACE[raw[at:end]])
            end = at + int(spaces[-1]) + 1 if len(spaces) else end
        b = raw[at : min(n, end + 3)]
        own = end - at
        h = _BYTE[0][b]
        _mark(flags, h[:own])
        for k in range(1, 4):
            if len(b) > k:
                h = h[:-1] + _BYTE[k][b[k:]]
                _mark(flags, h[:own])
        b = raw[at:end]
        words = np.zeros(0, np.uint64)
        where = np.flatnonzero(~_SPACE[b])
        if len(where):
            new = np.empty(len(where), bool)
            new[0] = True
            new[1:] = np.diff(where) > 1
            starts = np.flatnonzero(new)
            place = np.arange(len(where)) - np.repeat(starts, np.diff(np.append(starts, len(where))))
            power = np.cumprod(np.full(int(place.max()) + 1, _M, np.uint64))
            words = np.add.reduceat(_WORD[b[where]] * power[place], starts)
        if length:
            if len(where) and not where[0]:  # the open word goes on
                words[:1] = words[:1] * np.uint64(pow(int(_M), length, 1 << 64)) + begun
            else:
                words = np.append(np.array([begun], np.uint64), words)
        if end < n and len(where) == own:  # a block without white space: its one word stays open
            begun, length, words = words[0], length + own, words[:0]
        else:
            length = 0
        if len(words):
            _mark(flags, words * _K2)
            chain = words if last is None else np.concatenate([[last], words])
            if len(chain) > 1:
                _mark(flags, chain[:-1] * _K1 + chain[1:])
                same += int((chain[:-1] == chain[1:]).sum())
                pairs += len(chain) - 1
            last = words[-1]
        at = end
    level = 0 if not pairs else 1 + int(np.ceil(8 * same / pairs))
    _mark(flags, np.array([level], np.uint64) * _K2 + _K1)
    found = np.flatnonzero(flags)
    flags[found] = False
    return found


class Model:
    """ratio * weight of each place, squared ratios for the length, and the threshold."""

    def __init__(self, scaled: np.ndarray, squared: np.ndarray, bias: float, threshold: float):
        self.scaled, self.squared, self.bias, self.threshold = scaled, squared, bias, threshold

    def margin(self, text: str, flags: np.ndarray | None = None) -> float:
        f = features(text, flags)
        return float(self.scaled[f].sum(dtype=np.float64) / np.sqrt(self.squared[f].sum(dtype=np.float64) + 1e-12) + self.bias)


def fit_features(rows: list[np.ndarray], y: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(scaled weights, squared ratios, bias) by log-count ratios and dual coordinate descent; y is +1 or -1."""
    p, q = np.ones(_SIZE), np.ones(_SIZE)
    for f, label in zip(rows, y):
        (p if label > 0 else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = [(ratio[f] / np.sqrt((ratio[f] ** 2).sum() + 1e-12)).astype(np.float32) for f in rows]
    w, bias, alpha = np.zeros(_SIZE), 0.0, np.zeros(len(y))
    norm = np.array([float(v @ v) + 1.0 for v in x])  # 1 is the bias
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ x[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), c)
            if step := new - alpha[i]:
                w[rows[i]] += step * y[i] * x[i]
                bias += step * y[i]
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return ratio * w, ratio**2, bias


def fit(texts: list[str], labels: np.ndarray) -> Model | None:
    """Fit to four fifths, set the threshold on the rest. None where either class is absent.

    Of texts that are alike (``unlike``) the first counts.
    """
    y = np.where(np.asarray(labels) > 0, 1, -1)
    if not len(y) or (y == y[0]).all():
        return None
    flags = np.zeros(_SIZE, bool)
    first = unlike(texts)
    if len(set(y[first])) == 2:
        texts, y = [texts[i] for i in first], y[first]
    rows = [features(t, flags).astype(np.int32) for t in texts]
    held = np.arange(len(y)) % 5 == 4
    if (y[~held] == y[~held][0]).all() or not held.any():
        held[:] = False
    fit_to = np.flatnonzero(~held)
    model = Model(*fit_features([rows[i] for i in fit_to], y[fit_to]), 0.0)
    on = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else np.arange(len(y))
    m = np.array([model.scaled[rows[i]].sum() / np.sqrt(model.squared[rows[i]].sum() + 1e-12) + model.bias for i in on])
    model.threshold = split(m, y[on] > 0)
    return model


def unlike(texts: list[str]) -> list[int]:
    """Places of texts that share none of their three least word-triple hashes with an earlier one.

    Copies of a few documents would else teach a model their wording.
    """
    seen: set[int] = set()
    out = []
    for i, t in enumerate(texts):
        w = t.lower().split()
        least = heapq.nsmallest(3, {zlib.crc32(" ".join(w[j : j + 3]).encode("utf-8", "surrogatepass")) for j in range(max(1, len(w) - 2))})
        if seen.isdisjoint(least):
            out.append(i)
        seen.update(least)
    return out


def split(margin: np.ndarray, good: np.ndarray, weight: int = 10) -> float:
    """Threshold with the fewest errors, in the widest gap among the best; a good text lost counts ``weight`` times."""
    order = np.argsort(margin, kind="stable")
    m, g = margin[order], good[order]
    wrong = weight * np.concatenate([[0], np.cumsum(g)]) + np.concatenate([np.cumsum((~g)[::-1])[::-1], [0]])
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    gap = np.diff(edges)
    best = np.flatnonzero(wrong == wrong.min())
    k = best[np.argmax(gap[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def sample_labels(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> pd.DataFrame:
    """(id, y, text) of at most ``per_class`` labelled rows of each class that have a text, chosen and ordered by a hash of the id.

    Of either class the texts, one after the other, hold ``sample_bytes / 2`` at most, but for the first one. Null labels, ids and
    texts don't count. An id that repeats, in either table, counts once, with its greatest label and its least text.
    Texts come to the driver only for what is chosen; the choice is made on ids and sizes.
    """
    given = pick(labels, id="doc_id", y=label).where("id is not null and y is not null").groupBy("id").agg((F.max("y") > 0).cast("int").alias("y"))
    texts = pick(docs, id=id_col, text=text_col).where("id is not null and text is not null")
    have = texts.select("id", F.octet_length("text").alias("size")).join(given, "id").groupBy("id", "y").agg(F.max("size").alias("size")).withColumn("h", F.xxhash64("id"))
    have, path = stored(have, "labelled")
    few = pd.concat([have.where(F.col("y") == y).orderBy("h", "id").limit(per_class).toPandas() for y in (0, 1)])
    discard(docs.sparkSession, path)
    if few.empty:
        return pd.DataFrame({"id": [], "y": [], "text": []})
    few = few[few.groupby("y")["size"].transform(lambda n: (n.cumsum() <= sample_bytes / 2) | (np.arange(len(n)) == 0)).astype(bool)]
    wanted = docs.sparkSession.createDataFrame(few[["id", "y", "h"]].astype("int64"), "id bigint, y int, h bigint")
    found = texts.join(F.broadcast(wanted), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text")).toPandas()
    return found.sort_values(["h", "id"]).reset_index(drop=True)


def fit_tables(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    rows = sample_labels(docs, labels, "quality", per_class, id_col, text_col, sample_bytes)
    return fit(list(rows["text"]), rows["y"].to_numpy())


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast((model.scaled.astype(np.float32), model.squared.astype(np.float32), model.bias))

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        alone("quality")
        m = Model(*shared.value, 0.0)
        flags = np.zeros(_SIZE, bool)
        return pd.Series([None if t is None else m.margin(t, flags) for t in text], dtype="float64")

    return score


def classify(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, margin, keep) for every row of ``docs``.

    keep is true where the margin is at least the model's threshold. A null text has a null margin and isn't kept; an
    empty text is scored by what an empty text has (no n-grams). Without labels of both classes nothing can be
    judged: margins are null and all is kept. Rows that repeat an id are scored one by one; other columns are ignored.

    ``per_class`` bounds the labelled rows of each class that the model is fitted to, ``sample_bytes`` their texts; of labelled
    texts that are alike (``unlike``) the first counts. Every document is scored whole, in one pass without a shuffle.
    """
    model = fit_tables(docs, labels, per_class, id_col, text_col, sample_bytes)
    rows = pick(docs, doc_id=id_col, text=text_col)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("margin"), F.lit(True).alias("keep"))
    scored = rows.select("doc_id", _scorer(docs.sparkSession, model)("text").alias("margin"))
    return scored.withColumn("keep", F.coalesce(F.col("margin") >= model.threshold, F.lit(False)))


def keep_good(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``docs`` without the rows that ``classify`` rejects, all columns as they were."""
    model = fit_tables(docs, labels, per_class, id_col, text_col, sample_bytes)
    if model is None:
        return docs
    p = Positional(docs)
    return p.restore(p.df.where(_scorer(docs.sparkSession, model)(p.col(text_col)) >= model.threshold))
