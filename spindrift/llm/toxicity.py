"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word (a run of letters and digits, in lower case) enters as two embeddings: one of the word itself, where training
knew it, and the maximum over those of its character n-grams (3 to 6, with borders), so that unseen forms of a known
stem count. Embeddings start from each feature's association with toxic training texts. Two gated recurrent units read a window of words in
either direction; attention pools their states; a logistic unit scores the window. Training is all numpy. Full windows are
scored by the same network as a graph for onnxruntime, made of the trained weights, as millions of them overlap.
A text's score is that of its worst window; a window starts at every word that has a whole window before the text's end.
Training looks for its windows at every ``TRAIN_STRIDE``-th word and moves them by chance; the threshold is set on scores over all windows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import onnx
from spindrift.llm._common import Positional, alone, pick
from spindrift.llm.quality import SAMPLE_BYTES, sample_labels, split, unlike

#: Bound of the labelled rows of each class that a model is fitted to.
SAMPLE_PER_CLASS = 2500
WINDOW, STRIDE, TRAIN_STRIDE, HIDDEN, WIDTH, ATTENTION = 32, 1, 24, 8, 6, 8
#: A word has an embedding of its own where it stands in so many training texts at least.
LEAST_TEXTS = 3
#: Windows that are read side by side.
_RUN = 4096
LOG_GRAMS, CACHE_WORDS = 18, 100_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F], np.uint64)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_by_size(words: list[str]):
    """For 3 to 6 characters: (words that are long enough with their borders, hashed places of their n-grams one after the other, how many each has)."""
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.fromiter(map(len, words), np.int64, len(words)) + 2
    left = np.repeat(np.cumsum(n), n) - np.arange(len(code))  # characters up to the word's end
    h = code * _MIX[0]
    for k in range(1, 6):
        h = h[: len(code) - k] * _MIX[1] + code[k:]
        if k >= 2:
            own = h[left[: len(h)] > k]
            which = np.flatnonzero(n > k)
            if len(which):
                yield which, (((own ^ (own >> np.uint64(31))) * _MIX[2]) >> np.uint64(64 - LOG_GRAMS)).astype(np.int64), n[which] - k


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed places of all character n-grams of 3 to 6 with borders, word by word; how many each word has)."""
    parts = list(grams_by_size(words))
    owner = np.concatenate([np.repeat(which, n) for which, _, n in parts])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([places for _, places, _ in parts])[order], np.bincount(owner, minlength=len(words))


def window_starts(n: int, stride: int = STRIDE) -> np.ndarray:
    """Starts of the windows over n words: every ``stride`` until the end is covered; one for a text without words."""
    return np.arange(max(1, -(-(n - WINDOW) // stride) + 1)) * stride


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Weights by name; direction is the first axis of the recurrent ones: 0 reads onward, 1 backward."""

    def __init__(self, inputs: int, seed: int = 5):
        r, h = np.random.default_rng(seed), HIDDEN
        self.w = {
            "in": r.normal(0, 0.5 / np.sqrt(inputs), (2, inputs, 3 * h)), "bias": np.zeros((2, 1, 3 * h)), "re": r.normal(0, 0.5 / np.sqrt(h), (2, h, 3 * h)),
            "att": r.normal(0, 0.5 / np.sqrt(2 * h), (2 * h, ATTENTION)), "see": r.normal(0, 0.5, ATTENTION), "out": r.normal(0, 0.5, 2 * h), "off": np.zeros(1),
        }

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of windows; x: (windows, words, inputs), mask: (windows, words), 1 at words."""
        w, h = self.w, HIDDEN
        n, t, _ = x.shape
        pre = np.stack([x @ w["in"][0] + w["bias"][0], x @ w["in"][1] + w["bias"][1]])
        s = np.zeros((2, n, h), x.dtype)
        states, kept = np.zeros((2, n, t, h), x.dtype), []
        for i in range(t):
            at = (i, t - 1 - i)
            a = np.stack([pre[0, :, at[0]], pre[1, :, at[1]]])
            m = np.stack([mask[:, at[0]], mask[:, at[1]]])[:, :, None]
            gate = _sigmoid(a[:, :, : 2 * h] + s @ w["re"][:, :, : 2 * h])
            r, z = gate[:, :, :h], gate[:, :, h:]
            back = s @ w["re"][:, :, 2 * h :]
            new = np.tanh(a[:, :, 2 * h :] + r * back)
            kept.append((s, r, z, back, new, m))
            s = s + m * (1 - z) * (new - s)
            states[0, :, at[0]], states[1, :, at[1]] = s[0], s[1]
        both = np.concatenate([states[0], states[1]], axis=2)
        look = np.tanh(both @ w["att"])
        e = np.where(mask > 0, look @ w["see"], -1e9)
        e = np.exp(e - e.max(1, keepdims=True))
        share = e / e.sum(1, keepdims=True)
        pooled = (share[:, :, None] * both).sum(1)
        return pooled @ w["out"] + w["off"], {"x": x, "kept": kept, "both": both, "look": look, "share": share, "pooled": pooled}

    def backward(self, c: dict, d: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights and of x, from those of the logits."""
        w, h = self.w, HIDDEN
        x, both, look, share = c["x"], c["both"], c["look"], c["share"]
        n, t, _ = x.shape
        g = {"out": c["pooled"].T @ d, "off": np.array([d.sum()])}
        dpool = d[:, None] * w["out"]
        dboth = share[:, :, None] * dpool[:, None, :]
        dshare = (both * dpool[:, None, :]).sum(2)
        de = share * (dshare - (share * dshare).sum(1, keepdims=True))
        g["see"] = (look * de[:, :, None]).sum((0, 1))
        dlook = de[:, :, None] * w["see"] * (1 - look**2)
        g["att"] = both.reshape(n * t, -1).T @ dlook.reshape(n * t, -1)
        dboth = dboth + dlook @ w["att"].T
        dpre, ds, g["re"] = np.zeros((2, n, t, 3 * h), x.dtype), np.zeros((2, n, h), x.dtype), np.zeros_like(w["re"])
        for i in range(t - 1, -1, -1):
            at = (i, t - 1 - i)
            s, r, z, back, new, m = c["kept"][i]
            ds = ds + np.stack([dboth[:, at[0], :h], dboth[:, at[1], h:]])
            step = ds * m
            dnew = step * (1 - z) * (1 - new**2)
            dz = step * (s - new) * z * (1 - z)
            dr = dnew * back * r * (1 - r)
            da = np.concatenate([dr, dz, dnew], axis=2)
            drec = np.concatenate([dr, dz, dnew * r], axis=2)
            dpre[0, :, at[0]], dpre[1, :, at[1]] = da[0], da[1]
            g["re"] += s.transpose(0, 2, 1) @ drec
            ds = ds * (1 - m) + step * z + drec @ w["re"].transpose(0, 2, 1)
        flat = x.reshape(n * t, -1)
        g["in"] = np.stack([flat.T @ dpre[k].reshape(n * t, -1) for k in (0, 1)])
        g["bias"] = dpre.sum((1, 2))[:, None, :]
        return g, dpre[0] @ w["in"][0].T + dpre[1] @ w["in"][1].T


def _column(v: np.ndarray, k: int) -> np.ndarray:
    """A square matrix that has ``v`` as its column ``k``: products by these, added up, are those by one column each, side by
    side, and take a fraction of the time, as kernels are made for rows of results."""
    m = np.zeros((HIDDEN, HIDDEN), np.float32)
    m[:, k] = v
    return m


def _graph(w: dict) -> bytes:
    """The network over windows side by side, without its offset: input x<direction><gate>_<step> is the share of the gate that the
    words at that place of all windows have. Where windows start at consecutive words these are views of one array."""
    g, h, t = onnx.Graph(), HIDDEN, WINDOW
    f32 = lambda a: np.ascontiguousarray(a, np.float32)
    columns = g.constant(np.array([1]))
    states = np.empty((2, t), object)
    for d in (0, 1):
        reset, update, new = (g.constant(f32(w["re"][d][:, k * h : (k + 1) * h])) for k in range(3))
        s = None
        for at in range(t) if d == 0 else range(t - 1, -1, -1):
            x = [f"x{d}{k}_{at}" for k in range(3)]
            if s is None:  # from zeros
                z, n = g.add("Sigmoid", x[1]), g.add("Tanh", x[2])
                s = g.add("Sub", n, g.add("Mul", z, n))
            else:
                r, z = g.add("Sigmoid", g.add("Gemm", s, reset, x[0])), g.add("Sigmoid", g.add("Gemm", s, update, x[1]))
                n = g.add("Tanh", g.add("Add", g.add("Mul", r, g.add("MatMul", s, new)), x[2]))
                s = g.add("Add", n, g.add("Mul", z, g.add("Sub", s, n)))
            states[d, at] = s
    att = [g.constant(f32(w["att"][d * h : (d + 1) * h])) for d in (0, 1)]
    see, *out = ([g.constant(_column(v, k)) for k in range(h)] for v in (w["see"], w["out"][:h], w["out"][h:]))
    looks, votes = [], []
    for i in range(t):
        look = g.add("Tanh", g.add("Gemm", states[1, i], att[1], g.add("MatMul", states[0, i], att[0])))
        for held, parts in ((looks, [(look, see)]), (votes, [(states[d, i], out[d]) for d in (0, 1)])):
            if i % h == 0:  # the next h steps
                value, weights = parts.pop(0)
                held.append(g.add("MatMul", value, weights[0]))
            for value, weights in parts:
                held[-1] = g.add("Gemm", value, weights[i % h], held[-1])
    looks, votes = g.add("Concat", *looks, axis=1), g.add("Concat", *votes, axis=1)
    logit = g.add("ReduceSum", g.add("Mul", g.add("Softmax", looks, axis=1), votes), columns, keepdims=0)
    # the first step of either direction starts from zeros and has no use for the reset gate
    return g.model({f"x{d}{k}_{i}": h for d in (0, 1) for k in range(3) for i in range(t) if k or i != (0 if d == 0 else t - 1)}, logit)


class Model:
    def __init__(self, vocabulary: dict[str, int], word: np.ndarray, gram: np.ndarray, network: Network, threshold: float = 0.5):
        self.vocabulary, self.word, self.gram, self.network, self.threshold = vocabulary, word, gram, network, threshold
        self.clear()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("row", "table", "session", "inputs_of")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.table = self.session = None

    def inputs(self, words: list[str]) -> np.ndarray:
        """(words, 2 * WIDTH): the word's embedding and the maximum of its n-grams'."""
        if not words:
            return np.zeros((0, 2 * WIDTH), np.float32)
        out = []
        for i in range(0, len(words), 20_000):
            part = words[i : i + 20_000]
            top = np.full((len(part), WIDTH), -np.inf, np.float32)
            for which, places, n in grams_by_size(part):
                top[which] = np.maximum(top[which], np.maximum.reduceat(self.gram.take(places, axis=0), np.cumsum(n) - n))
            out.append(np.concatenate([self.word[[self.vocabulary.get(w, 0) for w in part]], top], axis=1))
        return np.concatenate(out).astype(np.float32)

    def rows(self, words: list[str]) -> np.ndarray:
        """Places of words in ``table``, which holds their share of both directions' gates; place 0 is no word.

        Only distinct words are looked up. What is kept is forgotten where it would pass CACHE_WORDS: an older generation
        costs as much memory again, and about what it saves, as most words are new.
        """
        if not words:
            return np.zeros(0, np.int64)
        codes, names = pd.factorize(np.array(words, object))
        names = names.tolist()
        fresh = [x for x in names if x not in self.row]
        if len(self.row) + len(fresh) > CACHE_WORDS and self.row:
            self.row, self.table, fresh = {}, None, names
        w = self.network.w
        n = len(self.row) + 1
        if self.table is None or len(self.table) < n + len(fresh):
            kept = self.table
            self.table = np.zeros((max(n + len(fresh), min(2 * n, CACHE_WORDS)), 6 * HIDDEN), np.float32)
            if kept is not None:
                self.table[:n] = kept[:n]
        if fresh:
            x = self.inputs(fresh)
            for k in (0, 1):
                np.add(x @ w["in"][k], w["bias"][k], out=self.table[n : n + len(fresh), 3 * k * HIDDEN : 3 * (k + 1) * HIDDEN], casting="unsafe")
            self.row.update(zip(fresh, range(n, n + len(fresh))))
        return np.fromiter(map(self.row.__getitem__, names), np.int64, len(names))[codes]

    def _logits(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """at: (windows, WINDOW) places in ``table``; the forward pass of the network, with shared input products."""
        w, h, n, t = self.network.w, HIDDEN, len(at), WINDOW
        scale = np.repeat([0.5, 0.5, 1.0], h).astype(np.float32)  # a logistic is a tanh of half its argument
        re = (w["re"] * scale).astype(np.float32)
        s = np.zeros((2, n, h), np.float32)
        states = np.empty((t, 2, n, h), np.float32)
        full = bool((length == t).all())
        a = np.empty((2, n, 3 * h), np.float32)
        for i in range(t):
            a[0] = self.table[at[:, i], : 3 * h] * scale
            a[1] = self.table[at[:, t - 1 - i], 3 * h :] * scale
            u = s @ re
            gate = np.tanh(a[:, :, : 2 * h] + u[:, :, : 2 * h])
            gate += 1
            gate *= 0.5
            new = np.tanh(a[:, :, 2 * h :] + gate[:, :, :h] * u[:, :, 2 * h :])
            move = (1 - gate[:, :, h:]) * (new - s)
            if not full:
                move[0] *= (i < length)[:, None]
                move[1] *= (t - 1 - i < length)[:, None]
            s = s + move
            states[i] = s
        both = np.concatenate([states[:, 0], states[::-1, 1]], axis=2)
        e = np.tanh(both @ w["att"].astype(np.float32)) @ w["see"].astype(np.float32)
        if not full:
            e = np.where(np.arange(t)[:, None] < length, e, -1e9)
        e = np.exp(e - e.max(0))
        score = both @ w["out"].astype(np.float32)
        return (e * score).sum(0) / e.sum(0) + w["off"][0]

    def _runs(self, at: np.ndarray) -> np.ndarray:
        """Logits of the windows that start at each of ``at`` (places in ``table``) but the last WINDOW - 1, as ``_logits`` gives them."""
        h = HIDDEN
        if self.session is None:
            self.session = onnx.session(_graph(self.network.w))
            self.inputs_of = [(i.name, int(i.name[1]), int(i.name[2]), int(i.name[4:])) for i in self.session.get_inputs()]
        out = np.empty(len(at) - WINDOW + 1, np.float32)
        for lo in range(0, len(out), _RUN):
            n = min(_RUN, len(out) - lo)
            x = self.table.take(at[lo : lo + n + WINDOW - 1], axis=0)
            parts = {(d, k): np.ascontiguousarray(x[:, (3 * d + k) * h : (3 * d + k + 1) * h]) for d in (0, 1) for k in range(3)}
            out[lo : lo + n] = self.session.run(None, {name: parts[d, k][i : i + n] for name, d, k, i in self.inputs_of})[0]
        return out + self.network.w["off"][0]

    def scores(self, texts: list[str], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
        """(highest probability over all windows, number of windows) of each text; 0 and 0 for one without words."""
        lists = [words_of(t) for t in texts]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.concatenate([self.rows([x for words in lists for x in words]), np.zeros(WINDOW, np.int64)])
        first = np.cumsum(n) - n
        counts = np.where(n > 0, np.maximum(1, -(-(n - WINDOW) // stride) + 1), 0)
        best = np.full(len(n), -np.inf)
        dense = (n >= WINDOW) & (stride == 1)
        if dense.any():
            logit = self._runs(flat[:-WINDOW][np.repeat(dense, n)])
            start = np.cumsum(n[dense]) - n[dense]
            # windows that reach into the next text count for neither
            best[dense] = np.maximum.reduceat(np.append(logit, -np.inf), np.stack([start, start + counts[dense]], axis=1).ravel())[::2]
        apart = np.where(dense, 0, counts)
        doc = np.repeat(np.arange(len(n)), apart)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(apart) - apart, apart)) * stride
        length = np.minimum(WINDOW, n[doc] - start)
        logit = np.empty(len(doc), np.float32)
        span = np.arange(WINDOW)
        for on in (np.flatnonzero(length == WINDOW), np.flatnonzero(length < WINDOW)):
            for i in range(0, len(on), 2048):
                k = on[i : i + 2048]
                at = flat[first[doc[k], None] + start[k, None] + span]
                at = np.where(span < length[k, None], at, 0)
                logit[k] = self._logits(at, length[k])
        np.maximum.at(best, doc, logit)
        return np.where(counts > 0, 1 / (1 + np.exp(-np.clip(best, -60, 60))), 0.0), counts


def _association(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """By how many deviations the number of toxic texts that have a feature is above what its commonness lets expect."""
    expected = (toxic + clean) * n_toxic / max(1, n_toxic + n_clean)
    return (toxic - expected) / np.sqrt(expected + 1)


def _start(z: np.ndarray) -> np.ndarray:
    return np.sign(z) * np.log1p(np.abs(z))


class _Trainer:
    """Training texts as places of known words, and the words' n-grams one after the other."""

    def __init__(self, texts: list[str]):
        lists = [words_of(t) for t in texts]
        self.index: dict[str, int] = {}
        self.texts = [np.fromiter((self.index.setdefault(w, len(self.index)) for w in ws), np.int64, len(ws)) for ws in lists]
        self.names = list(self.index)
        parts = [(p.astype(np.int32), n) for p, n in (grams_of(self.names[i : i + 20_000]) for i in range(0, len(self.names), 20_000))]
        self.places = np.concatenate([p for p, _ in parts])
        self.count = np.concatenate([n for _, n in parts])
        self.first = np.cumsum(self.count) - self.count

    def grams(self, words: np.ndarray) -> np.ndarray:
        n = self.count[words]
        return self.places[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[words], n)]

    def strongest(self, value: np.ndarray) -> np.ndarray:
        """The greatest value that any n-gram of each word has, some words at a time."""
        out = np.empty(len(self.names))
        for i in range(0, len(out), 20_000):
            n = self.count[i : i + 20_000]
            at = self.first[i]
            out[i : i + 20_000] = np.maximum.reduceat(value[self.places[at : at + n.sum()]], np.cumsum(n) - n)
        return out

    def batch(self, model: Model, part: list[tuple[int, int]]):
        """(x, mask, what ``spread`` needs) of windows (text, start)."""
        at = np.full((len(part), WINDOW), -1)
        for k, (i, s) in enumerate(part):
            own = self.texts[i][s : s + WINDOW]
            at[k, : len(own)] = own
        mask = (at >= 0).astype(np.float32)
        words, inverse = np.unique(np.maximum(at, 0), return_inverse=True)
        places, n = self.grams(words), self.count[words]
        each = model.gram[places]
        top = np.maximum.reduceat(each, np.cumsum(n) - n)
        known = self.known[words]
        x = np.concatenate([model.word[known], top], axis=1)[inverse.reshape(at.shape)] * mask[:, :, None]
        return x.astype(np.float32), mask, (inverse.ravel(), known, places, n, each == np.repeat(top, n, axis=0))

    @staticmethod
    def spread(dx: np.ndarray, used) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Gradients of the touched rows of the word and the n-gram table: (places, rows) of either."""
        inverse, known, places, n, is_top = used
        flat = dx.reshape(-1, 2 * WIDTH)
        own = np.stack([np.bincount(inverse, flat[:, d], len(n)) for d in range(2 * WIDTH)], axis=1)
        rows = np.repeat(own[:, WIDTH:], n, axis=0) * is_top
        on = np.flatnonzero(is_top.any(1))
        which, back = np.unique(places[on], return_inverse=True)
        gram = np.stack([np.bincount(back, rows[on, d], len(which)) for d in range(WIDTH)], axis=1)
        return (known, own[:, :WIDTH] * (known > 0)[:, None]), (which, gram)


def fit(texts: list[str], labels: np.ndarray, steps: int = 300, seed: int = 11, least_texts: int = LEAST_TEXTS) -> Model | None:
    """Train on four fifths of the texts, set the threshold on the rest. None where either class is absent.

    Of texts that are alike (``unlike``) the first counts. A word has an embedding of its own where ``least_texts`` training
    texts have it; all words have those of their n-grams.

    A text's label says only that some window is toxic. A first choice of that window goes by the association of
    words and n-grams; half way, the network's own worst window takes its place. Clean texts give their likeliest and random windows.
    """
    y = np.asarray(labels) > 0
    if not len(y) or y.all() or not y.any():
        return None
    first = unlike(texts)
    if len(set(y[first])) == 2:
        texts, y = [texts[i] for i in first], y[first]
    some = [i for i, t in enumerate(texts) if _WORD.search(t)]
    texts, y = [texts[i] for i in some], y[some]
    if len(set(y)) < 2:
        return None
    held = np.zeros(len(y), bool)
    for k in (True, False):
        held[np.flatnonzero(y == k)[4::5]] = True
    fit_to = np.flatnonzero(~held)
    t = _Trainer([texts[i] for i in fit_to])
    toxic_text = y[fit_to]
    n_toxic, n_clean = int(toxic_text.sum()), int((~toxic_text).sum())
    word_count, gram_count = np.zeros((2, len(t.names))), np.zeros((2, 1 << LOG_GRAMS))
    for own, label in zip(t.texts, toxic_text):
        own = np.unique(own)
        word_count[int(label), own] += 1
        gram_count[int(label), np.unique(t.grams(own))] += 1
    zw, zg = _association(word_count[1], word_count[0], n_toxic, n_clean), _association(gram_count[1], gram_count[0], n_toxic, n_clean)
    often = np.flatnonzero(word_count.sum(0) >= least_texts)
    r = np.random.default_rng(seed)
    word, gram = r.normal(0, 0.05, (len(often) + 1, WIDTH)).astype(np.float32), r.normal(0, 0.05, (1 << LOG_GRAMS, WIDTH)).astype(np.float32)
    word[0] = 0
    word[1:, 0], gram[:, 0] = _start(zw[often]), _start(zg)
    t.known = np.zeros(len(t.names), np.int64)
    t.known[often] = np.arange(1, len(often) + 1)
    model = Model({t.names[w]: i + 1 for i, w in enumerate(often)}, word, gram, Network(2 * WIDTH, seed))
    net = model.network
    net.w = {k: v.astype(np.float32) for k, v in net.w.items()}

    evidence = np.maximum(zw, t.strongest(zg))
    cut = [(i, int(s)) for i, own in enumerate(t.texts) for s in window_starts(len(own), TRAIN_STRIDE)]
    owner, starts = np.array(cut).T
    peak = np.array([s + int(evidence[t.texts[i][s : s + WINDOW]].argmax()) for i, s in cut])
    worth = np.array([evidence[t.texts[i][p]] for i, p in zip(owner, peak)])
    room = np.array([max(0, len(own) - WINDOW) for own in t.texts])[owner]
    is_toxic = toxic_text[owner]

    def choose() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((-worth, owner))
        top = order[np.concatenate([[True], owner[order][1:] != owner[order][:-1]])]
        return top[is_toxic[top]], top[~is_toxic[top]], np.flatnonzero(~is_toxic)

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (net.w | {"word": word, "gram": gram}).items()}
    half, (bad, likely, clean) = 48, choose()
    for step in range(1, steps + 1):
        if step == steps // 2:
            for lo in range(0, len(cut), 512):
                x, mask, _ = t.batch(model, cut[lo : lo + 512])
                worth[lo : lo + 512] = net.forward(x, mask)[0]
            bad, likely, clean = choose()
        # windows are scored at every word, so those trained on start at any too: with what speaks for them at any place, or anywhere
        some = np.concatenate([r.choice(bad, half), r.choice(likely, half - half // 2), r.choice(clean, half // 2)])
        start = np.where(np.arange(2 * half) < 2 * half - half // 2, peak[some] - r.integers(0, WINDOW, 2 * half), starts[some] + r.integers(0, TRAIN_STRIDE, 2 * half))
        x, mask, used = t.batch(model, list(zip(owner[some], np.clip(start, 0, room[some]))))
        logit, cache = net.forward(x, mask)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - np.repeat([1.0, 0.0], half)).astype(np.float32) / (2 * half)
        g, dx = net.backward(cache, d)
        changes = {k: (slice(None), v) for k, v in g.items()} | dict(zip(("word", "gram"), t.spread(dx * mask[:, :, None], used)))
        rate = 0.02 if step < steps * 0.7 else 0.005
        for k, (on, grad) in changes.items():
            value = net.w[k] if k in net.w else getattr(model, k)
            m1, m2 = moments[k]
            m1[on] += 0.1 * (grad - m1[on])
            m2[on] += 0.01 * (grad**2 - m2[on])
            value[on] -= rate * (m1[on] / (1 - 0.9**step)) / (np.sqrt(m2[on] / (1 - 0.99**step)) + 1e-8)
    test = np.flatnonzero(held) if held.any() and len(set(y[held])) == 2 else np.arange(len(y))
    del t, moments, evidence, word_count, gram_count
    p = np.concatenate([model.scores([texts[i] for i in test[k : k + 200]])[0] for k in range(0, len(test), 200)])
    logit = np.log(np.clip(p, 1e-12, 1)) - np.log(np.clip(1 - p, 1e-12, 1))
    model.threshold = float(1 / (1 + np.exp(split(-logit, ~y[test], 3))))
    model.clear()
    return model


def fit_tables(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> Model | None:
    rows = sample_labels(docs, labels, "toxic", per_class, id_col, text_col, sample_bytes)
    return fit(list(rows["text"]), rows["y"].to_numpy())


def _scorer(spark: SparkSession, model: Model):
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<score double, windows bigint>")
    def score(text: pd.Series) -> pd.DataFrame:
        m = shared.value  # the worker keeps it, with its cache of words, from task to task
        alone("toxicity", m.clear)
        best, count = np.full(len(text), np.nan), np.zeros(len(text), np.int64)
        on = [i for i, t in enumerate(text) if t is not None]
        start, size = 0, 0
        for k, i in enumerate(on):
            size += len(text[i])
            if size > 1_000_000 or k == len(on) - 1:
                part = on[start : k + 1]
                best[part], count[part] = m.scores([text[j] for j in part])
                start, size = k + 1, 0
        return pd.DataFrame({"score": best, "windows": count})

    return score


def classify(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, score, windows, toxic) for every row of ``docs``.

    toxic is true where the score of the worst window is at least the model's threshold. A null text has a null score,
    no windows and isn't toxic; a text without words scores 0. Without labels of both classes nothing can be judged:
    scores are null and nothing is toxic. Rows that repeat an id are scored one by one; other columns are ignored.

    ``per_class`` bounds the labelled rows of each class that the model is fitted to, ``sample_bytes`` their texts; of labelled
    texts that are alike one counts. Every window of every document is scored, at each word, in one pass without a
    shuffle.
    """
    model = fit_tables(docs, labels, per_class, id_col, text_col, sample_bytes)
    rows = pick(docs, doc_id=id_col, text=text_col)
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("score"), F.lit(0).cast("bigint").alias("windows"), F.lit(False).alias("toxic"))
    s = rows.select("doc_id", F.col("text").isNull().alias("void"), _scorer(docs.sparkSession, model)("text").alias("s"))
    score = F.when(~F.col("void"), F.col("s.score"))
    return s.select("doc_id", score.alias("score"), F.col("s.windows").alias("windows"), F.coalesce(score >= model.threshold, F.lit(False)).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text", sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``docs`` without the rows that ``classify`` finds toxic, all columns as they were; null texts stay."""
    model = fit_tables(docs, labels, per_class, id_col, text_col, sample_bytes)
    if model is None:
        return docs
    p = Positional(docs)
    scored = p.df.withColumn("__s", _scorer(docs.sparkSession, model)(p.col(text_col)))
    return p.restore(scored.where(p.col(text_col).isNull() | (F.col("__s.score") < model.threshold)))
