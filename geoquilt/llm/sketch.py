"""Fixed-size count-min sketches of hashes, with counters that saturate at two, merged over partitions.

A sketch has `rows` rows of 2**bits counters. A counter is two bits in two bitmaps: seen once, seen again. A partition
builds its own, sends the slices it touched (compressed), and slices merge in steps: once = or,
again = or of again's and of what both have once. The estimate never falls below the true count, so a hash that two
documents hold always passes `maybe_repeated`.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few_files, lean, most_partitions
from .textscan import mix

_SLICE = 20
_AT_ONCE = 64
_FEW = 1 << 22  # hashes that a partition holds as they are
_CHUNK = 1 << 20
_BITS = np.left_shift(1, np.arange(7, -1, -1)).astype(np.uint8)


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h, 101 + row) >> np.uint64(64 - bits)).astype(np.uint32)


class _Local:
    """A partition's own sketch: few hashes as they are, many as whole bitmaps, whose memory goes back at once when it is sent."""

    def __init__(self, bits: int, rows: int, least: int):
        self.bits, self.rows, self.least = bits, rows, least
        self.width = min(_SLICE, bits)
        self.once: list[np.ndarray] = []
        self.again: list[np.ndarray] = []
        self.touched: set[int] = set()
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def add(self, h: np.ndarray) -> None:
        for k in range(0, len(h), _CHUNK):
            self.waiting.append(h[k : k + _CHUNK])
            self.n += len(self.waiting[-1])
            if self.n >= (_CHUNK if self.once else _FEW):
                self.flush()

    def _parts(self, waiting: list[np.ndarray]):
        """Of hashes by row and slice: (row, key, seen here, seen here again). Takes half the hashes' bytes besides them."""
        at = np.empty(sum(map(len, waiting)), np.uint32)
        lows = np.arange(1 << (self.bits - self.width), dtype=np.uint32) << np.uint32(self.width)
        for row in range(self.rows):
            done = 0
            for h in waiting:
                at[done : done + len(h)] = cells(h, row, self.bits)
                done += len(h)
            at.sort()
            bounds = [*np.searchsorted(at, lows).tolist(), len(at)]
            for key, low in enumerate(lows):
                if bounds[key] < bounds[key + 1]:
                    own = at[bounds[key] : bounds[key + 1]] - low
                    yield row, key, _pack(own, self.width), _pack(own[1:][own[1:] == own[:-1]], self.width)

    def flush(self) -> None:
        if not self.once:
            size = max(1, 1 << (self.bits - 3))
            self.once = [np.zeros(size, np.uint8) for _ in range(self.rows)]
            self.again = [np.zeros(size, np.uint8) for _ in range(self.rows)] if self.least > 1 else []
        waiting, self.waiting, self.n = self.waiting, [], 0
        size = 1 << (self.width - 3)
        for row, key, a, b in self._parts(waiting) if waiting else ():
            part = slice(key * size, (key + 1) * size)
            if self.again:
                self.again[row][part] |= b | (self.once[row][part] & a)
            self.once[row][part] |= a
            self.touched.add(row << 12 | key)

    def slices(self):
        if not self.once:
            for row, key, a, b in self._parts(self.waiting) if self.n else ():
                yield row << 12 | key, a, b if self.least > 1 else a[:0]
            return
        self.flush()
        size = 1 << (self.width - 3)
        for own in sorted(self.touched):
            part = slice((own & 4095) * size, ((own & 4095) + 1) * size)
            yield own, self.once[own >> 12][part], self.again[own >> 12][part] if self.again else self.once[0][:0]


def _pack(own: np.ndarray, width: int) -> np.ndarray:
    flags = np.zeros(1 << width, bool)
    flags[own] = True
    return np.packbits(flags)


class Bitmaps:
    """What came out: which counters reached two (or one), by row."""

    def __init__(self, bits: int, maps: list[np.ndarray]):
        self.bits, self.maps = bits, maps

    def __getstate__(self):
        return self.bits, [zlib.compress(x, 1) for x in self.maps]  # sparse maps travel small

    def __setstate__(self, state):
        self.bits, self.maps = state[0], [np.frombuffer(zlib.decompress(x), np.uint8) for x in state[1]]

    def maybe(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for row, held in enumerate(self.maps):
            at = cells(h, row, self.bits)
            found &= (held[at >> 3] & _BITS[at & 7]) != 0
        return found


def merged(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows: int, least: int = 2, per_core: int = 2) -> Bitmaps:
    """The sketch of all hashes that `hashes` yields from the batches of df; each document must give each hash once.

    The driver gets rows * 2**bits / 8 bytes at most, whatever the input's size. least=2 keeps counters of two and more,
    least=1 all that were touched (a Bloom filter). df is read in per_core partitions a
    core, or in as many as keep a task's share near 128 MB if that is more.
    """

    def build(batches):
        local = _Local(bits, rows, least)
        for batch in batches:
            for h in hashes(batch):
                local.add(h)
        part = TaskContext.get().partitionId()
        for key, a, b in local.slices():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "slice": pa.array([key], pa.int32()), "once": pa.array([zlib.compress(a, 1)], pa.binary()), "again": pa.array([zlib.compress(b, 1)], pa.binary())})

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        once = again = None
        for a, b in zip(pdf["once"], pdf["again"]):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            once, again = (a, b) if once is None else (once | a, (again | b | (once & a)) if len(b) else b)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0])], "slice": [int(pdf["slice"].iloc[0])], "once": [zlib.compress(once, 1)], "again": [zlib.compress(again, 1)]})

    schema = "part int, slice int, once binary, again binary"
    slices = few_files(df, per_core).mapInArrow(lean(build), schema)
    parts = most_partitions(df, per_core) or _AT_ONCE**2
    while parts > _AT_ONCE:  # each slice comes from every partition: they meet in steps, about _AT_ONCE to a group
        parts = -(-parts // _AT_ONCE)
        slices = slices.withColumn("part", (F.col("part") % parts).cast("int")).groupBy("slice", "part").applyInPandas(merge, schema)
    slices = slices.groupBy("slice").applyInPandas(merge, schema)
    width = min(_SLICE, bits)
    maps = [np.zeros(max(1, 1 << (bits - 3)), np.uint8) for _ in range(rows)]
    size = 1 << (width - 3)
    for x in slices.select("slice", F.col("again" if least == 2 else "once").alias("held")).collect():  # as many bytes as the maps at most
        key = x["slice"] & 4095
        maps[x["slice"] >> 12][key * size : (key + 1) * size] = np.frombuffer(zlib.decompress(x["held"]), np.uint8)
    return Bitmaps(bits, maps)
