import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from spindrift.llm import _common, linededup, packing, simhash, toxicity


@pytest.mark.parametrize("step", ["local", "stream", "runs", "apply", "spread", "verify", "pack"])
def test_operators_without_a_cache_give_back_those_of_others(monkeypatch, step):
    monkeypatch.setattr(_common, "_CACHES", {})
    m = toxicity.Model({"word": 1}, *(np.ones((n, toxicity.WIDTH), np.float32) for n in (2, 1 << toxicity.LOG_GRAMS)), toxicity.Network(2 * toxicity.WIDTH))
    m.scores(["word " * 40])
    _common.alone("toxicity", m.clear)
    assert m.row and m.session
    none = pd.Series([], dtype=object)
    {
        "local": lambda: list(linededup._local(iter([]))),
        "stream": lambda: list(linededup._stream(iter([]))),
        "runs": lambda: linededup._runs.func(none, none),
        "apply": lambda: linededup._apply.func(none, none),
        "spread": lambda: list(simhash._spread(simhash.layout(100, 17), 8)(iter([]))),
        "verify": lambda: simhash._verify(simhash.layout(100, 17), 8, 17)(pa.table({"grp": pa.array([0], pa.int64()), "left": pa.array([-1], pa.int8()), **{c: pa.array([0], pa.int64()) for c in ("node", "hi", "lo")}})),
        "pack": lambda: packing._pack_group((10, 10, 100), "norm")(pa.table({"grp": [0], "doc_id": [1], "piece": [0], "start": [0], "tokens": [3]})),
    }[step]()
    assert not m.row and m.session is None
