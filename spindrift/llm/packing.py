"""Best-fit packing: vector bin packing by residual capacities of tokens, documents and attention cost."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm._common import alone, materialize
from spindrift.llm.bpe import VOCABULARY, count_tokens

TOKENS, DOCUMENTS, COST, GROUP_ITEMS = 4096, 64, 4096 * 2048, 16_384


def pack(sizes: np.ndarray, capacity: tuple[int, int, int], rule: str = "norm") -> np.ndarray:
    """Bin of each item, given their sizes in the order in which they come.

    An item of n tokens takes (n, 1, n * n). Of the bins that still hold it under every constraint the best one takes
    it: least residual norm after the item ("norm"), or greatest dot product of item and residual ("dot"), both in shares of the
    capacities, weighted by the items' mean demand; the oldest bin wins ties. Else a new bin opens. An item that no
    empty bin holds is an error.
    """
    n = sizes.astype(np.float64)
    top = np.asarray(capacity, np.float64)
    if len(n) and ((n > top[0]).any() or (n * n > top[2]).any() or top[1] < 1):
        raise ValueError("an item is larger than a bin")
    item = np.stack([n, np.ones_like(n), n * n], axis=1) / top
    weight = item.mean(0) / max(item.mean(0).sum(), 1e-12) if len(n) else np.ones(3)
    least = np.minimum.accumulate(item[::-1], axis=0)[::-1] if len(n) else item
    out = np.empty(len(n), np.int64)
    free, names, count = np.empty((64, 3)), np.empty(64, np.int64), 0
    opened = 0
    for i, v in enumerate(item):
        if i % 256 == 0 and count:  # bins that nothing to come fits into are closed
            on = (free[:count] >= least[i] - 1e-12).all(1)
            k = int(on.sum())
            free[:k], names[:k], count = free[:count][on], names[:count][on], k
        rest = free[:count] - v
        fits = np.flatnonzero((rest >= -1e-12).all(1))
        if len(fits):
            score = (rest[fits] ** 2) @ weight if rule == "norm" else -(free[fits] @ (weight * v))
            b = int(fits[np.argmin(score)])
            free[b] = rest[b]
        else:
            if count == len(free):
                free, names = np.concatenate([free, np.empty_like(free)]), np.concatenate([names, np.empty_like(names)])
            b, count = count, count + 1
            free[b], names[b] = 1 - v, opened
            opened += 1
        out[i] = names[b]
    return out


def _pack_group(capacity: tuple[int, int, int], rule: str):
    def run(table: pa.Table) -> pa.Table:
        alone("packing")
        grp, doc, piece, start, n = (table.column(c).to_numpy() for c in ("grp", "doc_id", "piece", "start", "tokens"))
        order = np.lexsort((piece, doc, -n))
        bins = pack(n[order], capacity, rule)
        return pa.table({"bin_id": grp[order].astype(np.int64) << 32 | bins, "doc_id": doc[order], "piece": piece[order], "start": start[order], "tokens": n[order], "place": places(bins, n[order])})

    return run


def places(bins: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Where each item starts in its bin's sequence, when items stand there in the order in which they came."""
    order = np.argsort(bins, kind="stable")
    before = np.cumsum(n[order]) - n[order]
    new = np.flatnonzero(np.diff(bins[order], prepend=-1))
    out = np.empty(len(n), np.int32)
    out[order] = before - np.repeat(before[new], np.diff(np.append(new, len(n))))
    return out


def items(df: DataFrame, capacity: tuple[int, int, int], id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, tokens): the tokens of each text, in pieces of at most what an empty bin holds."""
    longest = min(capacity[0], math.isqrt(capacity[2]))
    rows = count_tokens(df, id_col, text_col, path).where("doc_id is not null and n_tokens > 0").withColumnRenamed("n_tokens", "n")
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / longest).cast("int")))
    return rows.select("doc_id", "n", piece.alias("piece")).select("doc_id", "piece", (F.col("piece") * longest).alias("start"), F.least(F.lit(longest), F.col("n") - F.col("piece") * longest).alias("tokens"))


def pack_documents(df: DataFrame, tokens: int = TOKENS, documents: int = DOCUMENTS, cost: int = COST, rule: str = "norm", group_items: int = GROUP_ITEMS, id_col: str = "doc_id", text_col: str = "text", path: str = VOCABULARY) -> DataFrame:
    """(bin_id, doc_id, piece, start, tokens, place): which training sequence takes each document, and where in it.

    Tokens are those of the byte-level vocabulary at ``path``, as ``bpe.encode`` gives them: a sequence is made by putting each
    piece's ids from ``start`` on, ``tokens`` of them, at ``place``. No bin has more than ``tokens`` tokens, ``documents``
    pieces or ``cost`` as the sum of squared lengths. A document that is longer than an empty bin holds is cut into
    pieces, in order, the last of which is shorter; start is a piece's first token. Texts that are null or have no tokens take no
    place, and null ids can't be named: neither has rows. Rows that repeat an id are packed each. Other columns are ignored.

    Scale: only lengths are kept and shuffled. Items are spread over groups of about ``group_items`` by a hash of id
    and piece; each group is packed by itself in order of falling length, which leaves some half-empty bins a group.
    """
    capacity = (tokens, documents, cost)
    every = materialize(items(df, capacity, id_col, text_col, path), "items")
    groups = max(1, math.ceil(every.count() / group_items))
    spread = every.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)))
    return spread.groupBy("grp").applyInArrow(_pack_group(capacity, rule), "bin_id bigint, doc_id bigint, piece int, start int, tokens int, place int")
