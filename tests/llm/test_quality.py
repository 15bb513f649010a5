import numpy as np
import pytest

from spindrift.llm import quality
from tests.llm.frames import docs, empty

LABELS = "doc_id bigint, quality int, toxic int"


def made(n, seed=0):
    """Texts of invented words; every third one is junk: signs behind each word, or words said over and over."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("aeioubcdfglmnrst"), rng.integers(2, 8))) for _ in range(2000)]
    rows, good = [], {}
    for i in range(n):
        w = list(rng.choice(words, rng.integers(20, 200)))
        if i % 3 == 0:
            w = [x + rng.choice(["%%%", "***", "&&&"]) for x in w] if i % 2 else [x for x in w[: len(w) // 8 + 1] for _ in range(8)]
        rows.append((i, " ".join(w), "en", "s", 0))
        good[i] = int(i % 3 != 0)
    return rows, good


def test_held_out_accuracy(spark):
    rows, good = made(600)
    labels = spark.createDataFrame([(i, good[i], 0) for i in range(300)], LABELS)
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs(spark, rows), labels).collect()}
    held = range(300, 600)
    assert np.mean([got[i] for i in held if good[i]]) >= 0.98
    assert np.mean([not got[i] for i in held if not good[i]]) >= 0.95


def test_held_out_labels(spark, data):
    d = data.replace("sf0.001", "sf0.01")
    df, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = lab.toPandas().sort_values("doc_id").reset_index(drop=True)
    train, test = rows[rows.index % 2 == 0], rows[rows.index % 2 == 1]
    got = {r["doc_id"]: r["keep"] for r in quality.classify(df, spark.createDataFrame(train)).collect()}
    keep = test["doc_id"].map(got)
    assert keep[test["quality"] == 1].mean() >= 0.98 and (~keep[test["quality"] == 0].astype(bool)).mean() >= 0.5


def test_dual_descent_reaches_the_optimum():
    """Against subgradient descent on the same objective."""
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 60, 8)) for _ in range(80)]
    y = np.where([(5 in r) or (7 in r) or rng.random() < 0.3 for r in rows], 1, -1)
    scaled, squared, bias = quality.fit_features(rows, y, c=0.5, epochs=400)
    ratio = np.sqrt(squared) * np.sign(np.where(squared > 0, 1, 1))
    p, q = np.ones(quality._SIZE), np.ones(quality._SIZE)
    for f, t in zip(rows, y):
        (p if t > 0 else q)[f] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    x = np.zeros((80, 61))
    for i, f in enumerate(rows):
        x[i, f] = ratio[f] / np.sqrt((ratio[f] ** 2).sum())
    x[:, 60] = 1
    w = np.append(np.divide(scaled[:60], ratio[:60], out=np.zeros(60), where=ratio[:60] != 0), bias)
    value = lambda v: 0.5 * v @ v + 0.5 * np.maximum(0, 1 - y * (x @ v)).sum()
    v = np.zeros(61)
    best = value(v)
    for t in range(1, 20_000):
        v -= (v - 0.5 * (x * y[:, None])[y * (x @ v) < 1].sum(0)) / t
        best = min(best, value(v))
    assert value(w) <= best * 1.01


def test_features_cover_whole_texts(monkeypatch):
    monkeypatch.setattr(quality, "_BLOCK", 64)
    text = "ab cd efg " * 40 + "zq9!" + " tail" * 3
    small = quality.features(text)
    monkeypatch.setattr(quality, "_BLOCK", 1 << 18)
    assert small.tolist() == quality.features(text).tolist()
    assert len(quality.features("")) == 1 and len(quality.features("x" * 1000)) > 1


def test_edges(spark):
    rows, good = made(90)
    labels = spark.createDataFrame([(i + 100, g, 0) for i, g in good.items()] + [(None, 1, 0), (7, None, None), (100, 0, 0)], LABELS)
    df = docs(spark).union(docs(spark, [(i + 100, *r) for i, *r in rows]))
    got = quality.classify(df, labels)
    assert got.columns == ["doc_id", "margin", "keep"] and got.count() == 101
    three = got.where("doc_id = 3").first()
    assert three["margin"] is None and three["keep"] is False
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id = 3").count() == 0
    one_class = labels.where("quality = 1")
    assert quality.keep_good(df, one_class).count() == 101
    assert {(r["margin"], r["keep"]) for r in quality.classify(df, labels.limit(0)).collect()} == {(None, True)}
    assert quality.classify(empty(spark), labels).count() == 0 and quality.keep_good(empty(spark), labels).count() == 0


@pytest.mark.parametrize("margin, good", [([0.0, 1.0], [False, True]), ([1.0, 1.0], [True, False]), ([3.0], [True])])
def test_threshold_keeps_the_good(margin, good):
    t = quality.split(np.array(margin), np.array(good))
    assert all(m >= t for m, g in zip(margin, good) if g)


def test_long_words_are_hashed_whole(monkeypatch):
    text = "ab " * 50 + "x" * 1000 + "yz" * 700 + " tail of words " + "q" * 300 + "\n" + "r" * 64 + " " + "s" * 65
    want = quality.features(text).tolist()
    for block in (64, 65, 100, 257, 5000):
        monkeypatch.setattr(quality, "_BLOCK", block)
        assert quality.features(text).tolist() == want


def test_samples_hold_as_many_as_there_are(spark):
    """Labels of rows without a text take no place, whatever their share; sizes bound what comes to the driver."""
    rows = [(i, None if i % 10 else "t" * 100 + str(i), "en", "s", 0) for i in range(2000)] + [(10, "a", "en", "s", 0)]
    labels = spark.createDataFrame([(i, i % 20 // 10, 0) for i in range(2000)] + [(20, 0, 0), (20, None, 0), (None, 1, 0)], LABELS)
    got = quality.sample_labels(docs(spark, rows), labels, "quality", 90)
    assert got["y"].value_counts().to_dict() == {0: 90, 1: 90} and not got["id"].duplicated().any() and not (got["id"] % 10).any()
    assert quality.sample_labels(docs(spark, rows), labels, "quality", 150).query("id == 10")["text"].tolist() == ["a"]
    few = quality.sample_labels(docs(spark, rows), labels, "quality", 90, sample_bytes=2000)
    assert few.groupby("y")["text"].apply(lambda t: t.str.len().sum()).max() <= 1000 and len(few) == 18
    assert len(quality.sample_labels(docs(spark, rows), labels, "quality", 90, sample_bytes=1)) == 2
