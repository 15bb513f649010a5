"""Computation graphs for onnxruntime, written from Python in the interchange format's wire encoding."""

from __future__ import annotations

import numpy as np


def _varint(n: int) -> bytes:
    out, n = b"", n & ((1 << 64) - 1)
    while True:
        n, low = n >> 7, n & 127
        out += bytes([low | 128 * (n > 0)])
        if not n:
            return out


def _field(number: int, value: int | str | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _value(name: str, width: int | None) -> bytes:
    """A float tensor of any number of rows."""
    shape = _field(1, _field(2, "rows" if width else "windows")) + (_field(1, _field(1, width)) if width else b"")
    return _field(1, name) + _field(2, _field(1, _field(1, 1) + _field(2, shape)))


class Graph:
    """Nodes in order, each with one result, and constants (float32 or int64)."""

    def __init__(self):
        self.nodes: list[bytes] = []
        self.constants: list[bytes] = []

    def constant(self, a: np.ndarray) -> str:
        name = f"c{len(self.constants)}"
        kind = {"float32": 1, "int64": 7}[str(a.dtype)]
        self.constants.append(b"".join(_field(1, int(d)) for d in a.shape) + _field(2, kind) + _field(8, name) + _field(9, a.tobytes()))
        return name

    def add(self, op: str, *inputs: str, **attributes: int) -> str:
        name = f"n{len(self.nodes)}"
        given = b"".join(_field(5, _field(1, k) + _field(3, v) + _field(20, 2)) for k, v in attributes.items())
        self.nodes.append(b"".join(_field(1, i) for i in inputs) + _field(2, name) + _field(4, op) + given)
        return name

    def model(self, inputs: dict[str, int], result: str) -> bytes:
        """``inputs``: name and width of each matrix; ``result``: a vector."""
        g = b"".join(_field(1, n) for n in self.nodes) + _field(2, "g") + b"".join(_field(5, c) for c in self.constants)
        g += b"".join(_field(11, _value(k, w)) for k, w in inputs.items()) + _field(12, _value(result, None))
        return _field(1, 8) + _field(7, g) + _field(8, _field(1, "") + _field(2, 13))


def session(model: bytes):
    """A session of one thread, as tasks are what runs side by side."""
    import onnxruntime as ort

    o = ort.SessionOptions()
    o.intra_op_num_threads = o.inter_op_num_threads = 1
    o.log_severity_level = 3
    return ort.InferenceSession(model, o, providers=["CPUExecutionProvider"])
