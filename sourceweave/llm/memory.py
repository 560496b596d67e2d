"""What a worker remembers between texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import ranges


class Memory:
    """Values of byte strings, each some 32-bit integers, that are learned when a string is first met; a full memory forgets all.

    learn: gives the values of strings, one after the other, and how many each has.
    """

    def __init__(self, size: int, learn: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.size, self.learn = size, learn
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.flat, self.first = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def values(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the strings between neighbouring cuts of data: all their values, one after the other, and how many each has."""
        strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(data)])
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if len(self.number) + len(distinct) > self.size:
            self.forget()
        get = self.number.get
        at = np.fromiter((get(s, -1) for s in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [distinct[i] for i in missing.tolist()]
            flat, counts = self.learn(new)
            at[missing] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(new, at[missing].tolist(), strict=True))
            self.flat = np.concatenate((self.flat, flat)).astype(np.int32)
            self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))
        at = at[coded.indices.to_numpy()]
        counts = self.first[at + 1] - self.first[at]
        return self.flat[ranges(self.first[at], counts)], counts
