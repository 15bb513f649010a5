import numpy as np

from spindrift.llm import toxicity
from tests.llm.frames import docs, empty

LABELS = "doc_id bigint, quality int, toxic int"


def test_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network(5, seed=1)
    x, mask = rng.normal(size=(4, 7, 5)), np.ones((4, 7))
    mask[1, 4:] = mask[2, 1:] = 0
    x *= mask[:, :, None]
    y = rng.normal(size=4)
    loss = lambda: float(net.forward(x, mask)[0] @ y)
    _, cache = net.forward(x, mask)
    g, dx = net.backward(cache, y)
    for name, grad in [*g.items(), ("x", dx * mask[:, :, None])]:
        value = x if name == "x" else net.w[name]
        for at in [tuple(rng.integers(0, n) for n in value.shape) for _ in range(6)]:
            if name == "x" and not mask[at[:2]]:
                continue
            old = value[at]
            value[at] = old + 1e-6
            up = loss()
            value[at] = old - 1e-6
            down = loss()
            value[at] = old
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-6 * max(1, abs(grad[at])), name


def model(seed=3):
    rng = np.random.default_rng(seed)
    words = {f"w{i}": i + 1 for i in range(20)}
    return toxicity.Model(words, rng.normal(size=(21, toxicity.WIDTH)).astype(np.float32), rng.normal(size=(1 << toxicity.LOG_GRAMS, toxicity.WIDTH)).astype(np.float32), toxicity.Network(2 * toxicity.WIDTH))


def test_scores_are_the_worst_of_all_windows():
    m = model()
    texts = [" ".join(f"w{(i * 7 + k) % 30}" for i in range(n)) for k, n in enumerate((1, 31, 32, 33, 56, 57, 200))] + ["", "!!"]
    got, counts = m.scores(texts)
    for t, p, n in zip(texts, got, counts):
        words = toxicity.words_of(t)
        if not words:
            assert (p, n) == (0, 0)
            continue
        starts = toxicity.window_starts(len(words))
        assert n == len(starts) and starts[-1] + toxicity.WINDOW >= len(words) and set(np.diff(starts)) <= {toxicity.STRIDE}
        best = -np.inf
        for s in starts:
            part = words[s : s + toxicity.WINDOW]
            x, mask = np.zeros((1, toxicity.WINDOW, 2 * toxicity.WIDTH)), np.zeros((1, toxicity.WINDOW))
            x[0, : len(part)], mask[0, : len(part)] = m.inputs(part), 1
            best = max(best, m.network.forward(x, mask)[0][0])
        assert abs(p - 1 / (1 + np.exp(-best))) < 1e-4


def test_the_graph_is_the_network(monkeypatch):
    monkeypatch.setattr(toxicity, "_RUN", 50)
    m = model()
    words = [f"w{i * 11 % 37}" for i in range(170)]
    at = m.rows(words)
    spans = at[np.arange(170 - toxicity.WINDOW + 1)[:, None] + np.arange(toxicity.WINDOW)]
    assert np.allclose(m._runs(at), m._logits(spans, np.full(len(spans), toxicity.WINDOW)), atol=1e-5)


def test_words_of_few_training_texts_have_no_row():
    rows, bad = made(300, 9)
    texts, y = [r[1] for r in rows], np.array([bad[r[0]] for r in rows])
    held = [len(toxicity.fit(texts, y, steps=4, least_texts=k).vocabulary) for k in (1, 3, 30)]
    assert held[0] > held[1] > held[2]


def test_a_passage_counts_alike_at_all_offsets():
    m = model()
    passage = [f"w{i * 5 % 20}" for i in range(toxicity.WINDOW)]
    alone = m.scores([" ".join(passage)])[0][0]
    clean = [f"w{i * 7 % 20}" for i in range(120)]
    got, counts = m.scores([" ".join(clean[:k] + passage + clean[k:]) for k in range(121)])
    assert (got >= alone - 1e-5).all() and set(counts) == {121}


def test_the_cache_changes_nothing(monkeypatch):
    texts = [f"alpha{i} beta{i} gamma" for i in range(50)]
    want = model().scores(texts)[0]
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 5)
    m = model()
    assert np.allclose([m.scores([t])[0][0] for t in texts], want, atol=1e-6)


def test_a_worker_keeps_one_operators_things(monkeypatch):
    from spindrift.llm import _common, bpe

    monkeypatch.setattr(_common, "_CACHES", {})
    bpe.codec().encode(["some words"])
    first, second = model(), model()
    first.scores(["word " * 40])
    assert bpe._CODECS and first.row and first.session
    _common.alone("toxicity", first.clear)
    assert not bpe._CODECS and first.row
    _common.alone("toxicity", first.clear)
    assert first.row
    _common.alone("toxicity", second.clear)  # the model of another run
    assert not first.row and first.session is None


def test_what_is_kept_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(toxicity, "CACHE_WORDS", 100)
    m = model()
    for i in range(30):
        m.rows([f"w{i}x{j}" for j in range(20)] * 3)
        assert len(m.row) <= 100 and len(m.table) <= 101
    assert m.rows([]).shape == (0,)


def test_grams_cover_whole_words():
    places, n = toxicity.grams_of(["a", "abcdef", "é" * 500])
    assert n.tolist() == [1, 6 + 5 + 4 + 3, 500 + 499 + 498 + 497] and len(places) == n.sum()


def made(n, seed):
    """Every fourth text has one or two forms of a bad stem, mostly forms that no other text has."""
    rng = np.random.default_rng(seed)
    syllables = ["".join(rng.choice(list("bcdfglmnprst"), 1)) + rng.choice(list("aeiou")) for _ in range(60)]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows, bad = [], {}
    for i in range(n):
        w = [word() for _ in range(rng.integers(10, 150))]
        bad[i] = int(i % 4 == 0)
        for _ in range(rng.integers(1, 3) * bad[i]):
            w.insert(rng.integers(0, len(w) + 1), "zorgx" + word())
        rows.append((i, " ".join(w), "en", "s", 0))
    return rows, bad


def test_held_out_texts(spark):
    rows, bad = made(1000, 5)
    labels = spark.createDataFrame([(i, 1, bad[i]) for i in range(600)], LABELS)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.classify(docs(spark, rows), labels).collect()}
    held = range(600, 1000)
    assert np.mean([got[i] for i in held if bad[i]]) >= 0.9
    assert np.mean([got[i] for i in held if not bad[i]]) <= 0.01


def test_edges(spark):
    rows, bad = made(120, 6)
    labels = spark.createDataFrame([(i + 100, 1, b) for i, b in bad.items()] + [(None, 1, 1), (7, None, None)], LABELS)
    df = docs(spark).union(docs(spark, [(i + 100, *r) for i, *r in rows]))
    got = toxicity.classify(df, labels)
    assert got.columns == ["doc_id", "score", "windows", "toxic"] and got.count() == 131
    three, four = got.where("doc_id = 3").first(), got.where("doc_id = 4").first()
    assert (three["score"], three["windows"], three["toxic"]) == (None, 0, False) and (four["score"], four["windows"]) == (0.0, 0)
    long = got.where("doc_id = 6").first()
    assert long["windows"] == len(toxicity.window_starts(30_001))
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.where("doc_id = 3").count() == 1
    assert toxicity.drop_toxic(df, labels.where("toxic = 0")).count() == 131
    assert {(r["score"], r["toxic"]) for r in toxicity.classify(df, labels.limit(0)).collect()} == {(None, False)}
    assert toxicity.classify(empty(spark), labels).count() == 0 and toxicity.drop_toxic(empty(spark), labels).count() == 0


def test_no_product_of_the_graph_has_one_column(monkeypatch):
    from spindrift.llm import onnx

    shapes, constant = [], onnx.Graph.constant
    monkeypatch.setattr(onnx.Graph, "constant", lambda g, a: shapes.append(a.shape) or constant(g, a))
    toxicity._graph(model().network.w)
    assert shapes and all(s[1] > 1 for s in shapes if len(s) == 2)
