"""Arrays that workers map from a broadcast's file: pages that an executor's workers share, instead of a copy in each of them."""

from __future__ import annotations

import ctypes
import json
import mmap
import pickle

import numpy as np
import pyarrow as pa

MARK = b"sentloom arrays\n"
EACH = 64  # arrays begin at multiples of so many bytes
#: Bytes that pickle writes before a large value's own.
BEFORE = pickle.dumps(b"\xff" * (1 << 20), pickle.HIGHEST_PROTOCOL).index(b"\xff" * EACH)


def packed(arrays: dict[str, np.ndarray]) -> pickle.PickleBuffer:
    """What a broadcast of arrays takes for mapped(): a head that says where each is, and the arrays."""
    about, at = {}, 0
    for name, x in arrays.items():
        about[name] = [x.dtype.str, x.shape, at]
        at += -(-x.nbytes // EACH) * EACH
    head = json.dumps(about).encode()
    begin = len(MARK) + 8 + len(head)
    begin += -(BEFORE + begin) % EACH
    # of a size for which pickle writes the value apart from its frames
    out = np.zeros(max(begin + at, 1 << 17), np.uint8)
    out[: len(MARK) + 8 + len(head)] = np.frombuffer(MARK + np.array([len(head)], "<i8").tobytes() + head, np.uint8)
    for (name, x), (_, _, place) in zip(arrays.items(), about.values(), strict=True):
        out[begin + place : begin + place + x.nbytes] = np.ascontiguousarray(x).reshape(-1).view(np.uint8)
    out.flags.writeable = False
    return pickle.PickleBuffer(out)


def mapped(shared) -> dict[str, np.ndarray]:
    """The arrays of a broadcast of packed(). Where its file can't be mapped, since Spark encrypts it, a worker holds them itself."""
    path = getattr(shared, "_path", None)
    if path is not None:
        with open(path, "rb") as f:
            whole = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        if whole[BEFORE : BEFORE + len(MARK)].tobytes() == MARK:
            return _arrays(whole, BEFORE)
    return _arrays(np.frombuffer(shared.value, np.uint8), 0)


def _arrays(whole: np.ndarray, at: int) -> dict[str, np.ndarray]:
    size = int(whole[at + len(MARK) : at + len(MARK) + 8].view("<i8")[0])
    first = at + len(MARK) + 8
    about = json.loads(whole[first : first + size].tobytes())
    begin = first + size
    begin += -(begin - at + BEFORE) % EACH
    out = {}
    for name, (kind, shape, place) in about.items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = np.require(whole[begin + place : begin + place + n].view(kind).reshape(shape), requirements="A")
    return out


def trim() -> None:
    """Gives memory that a step has freed back to the system, where the C library can: workers live on and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if free is not None:
        free(0)
