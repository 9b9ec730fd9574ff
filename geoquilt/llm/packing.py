"""Packing documents into fixed-length sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import arrow_rows, lean, runs, text_buffers, written


@lru_cache(maxsize=2)
def _codec(path: str, fine: bool) -> tokens.UnitCodec:
    return tokens.UnitCodec(path, fine=fine)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, fine_units: bool = False) -> DataFrame:
    """Documents as pieces of at most `capacity` ids, each document closed by end_id.

    Rows (doc_id, piece, start, length, ids_crc32[, ids]). Only documents over the capacity are cut; all but their last
    piece are full. Null text is empty: the end id alone. fine_units: see tokens.UnitCodec.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    @lean
    def run(batches):
        codec = _codec(tokenizer_path, fine_units)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in runs(offsets, 1 << 20):
                part = offsets[i : j + 1]
                ids, first = codec.ids(data[part[0] : part[-1]], part - part[0])
                yield _cut(batch.column(0).slice(i, j - i), ids, first)

    def _cut(keys, ids, first):
        n = np.diff(first) + 1
        k = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), k)
        piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        start = piece * capacity
        length = np.minimum(capacity, n[doc] - start)
        closed = np.insert(ids.astype("<u4"), first[1:], end_id)  # an end id after each document
        begin = (first[:-1] + np.arange(len(n)))[doc] + start
        slices = [closed[a:b] for a, b in zip(begin.tolist(), (begin + length).tolist())]
        columns = [keys.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(x.tobytes()) for x in slices], pa.int64())]
        if with_ids:
            columns.append(pa.array([x.astype(np.int32) for x in slices], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, schema)


class Packer:
    """One island's work: items are lengths, a solution is each item's bin number."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = np.asarray(sizes, np.int64), capacity
        self.random = np.random.Generator(np.random.PCG64(seed))

    def best_fit(self, bins: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Put items (in the order given) each into the fullest bin that still holds it; bins: -1 for those to place."""
        held = bins >= 0
        load = np.bincount(bins[held], weights=self.sizes[held]).astype(np.int64) if held.any() else np.zeros(0, np.int64)
        room: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, r in enumerate((self.capacity - load).tolist()):
            if 0 < r < self.capacity:
                room[r].append(b)
                mask |= 1 << r
        fresh = len(load)
        for item, size in zip(items.tolist(), self.sizes[items].tolist()):
            fits = mask >> size
            if fits:
                r = size + (fits & -fits).bit_length() - 1
                b = room[r].pop()
                if not room[r]:
                    mask ^= 1 << r
            else:
                r, b, fresh = self.capacity, fresh, fresh + 1
            bins[item] = b
            if r > size:
                if not room[r - size]:
                    mask |= 1 << (r - size)
                room[r - size].append(b)
        return np.unique(bins, return_inverse=True)[1]

    def fresh(self, noise: float) -> np.ndarray:
        """Best fit of all items, largest first; noise perturbs the order."""
        order = np.argsort(-self.sizes * (1 + noise * self.random.random(len(self.sizes))), kind="stable")
        return self.best_fit(np.full(len(self.sizes), -1, np.int64), order)

    def fitness(self, bins: np.ndarray) -> float:
        """Fewer bins first; among equals the more uneven fill, which leaves room in one place."""
        fill = np.bincount(bins, weights=self.sizes) / self.capacity
        return -len(fill) + float((fill**2).mean())

    def cross(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Inject well-filled bins of one into two, drop two's bins that hold a duplicate, best-fit what they displace."""
        load = np.bincount(one, weights=self.sizes)
        good = np.flatnonzero(load >= self.capacity * (1 - 0.02 * self.random.random()))
        if not len(good):
            return two.copy()
        chosen = np.zeros(len(load), bool)
        chosen[good[self.random.random(len(good)) < self.random.uniform(0.2, 0.8)]] = True
        injected = chosen[one]
        hit = np.zeros(int(two.max()) + 1, bool)
        hit[two[injected]] = True
        child = np.where(hit[two], -1, two)
        child[injected] = one[injected] + len(hit)
        displaced = np.flatnonzero(child < 0)
        _, child[child >= 0] = np.unique(child[child >= 0], return_inverse=True)
        return self.best_fit(child, displaced[np.argsort(-self.sizes[displaced], kind="stable")])

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """Empty the worst-filled bins and a few others, and place their items anew."""
        load = np.bincount(bins, weights=self.sizes)
        gone = np.zeros(len(load), bool)
        gone[np.argsort(load, kind="stable")[: max(1, len(load) // 50)]] = True
        gone |= self.random.random(len(load)) < 0.02
        child = np.where(gone[bins], -1, bins)
        items = np.flatnonzero(child < 0)
        _, child[child >= 0] = np.unique(child[child >= 0], return_inverse=True)
        return self.best_fit(child, items[np.argsort(-self.sizes[items] * (1 + 0.2 * self.random.random(len(items))), kind="stable")])

    def evolve(self, population: list[np.ndarray], generations: int) -> np.ndarray:
        """The fittest after so many generations; stops at the bound no packing can beat."""
        bound = -(-int(self.sizes.sum()) // self.capacity)
        ranked = sorted(((self.fitness(x), i, x) for i, x in enumerate(population)), key=lambda x: (-x[0], x[1]))
        tick = len(population)
        for _ in range(generations):
            if int(ranked[0][2].max()) + 1 <= bound:
                break
            a, b = self.random.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
            child = self.cross(ranked[a][2], ranked[b][2]) if a != b else ranked[0][2]
            if a == b or self.random.random() < 0.5:
                child = self.mutate(child)
            tick += 1
            ranked = sorted([*ranked, (self.fitness(child), tick, child)], key=lambda x: (-x[0], x[1]))[: max(2, len(population))]
        return ranked[0][2]


def pack(sized: DataFrame, capacity: int = 2048, shard_items: int = 8192, islands: int = 2, epochs: int = 2, population: int = 4, generations: int = 12) -> DataFrame:
    """Where each item (uid, length <= capacity) goes: rows (uid, sequence_id, offset).

    Items are dealt by hash to shards of about shard_items. Each shard evolves on several islands; after each epoch an
    island's elite also goes to the next island of the ring, and at the end the fittest elite of a shard stays. The
    bins that are left partly filled at the shards' ends meet once more, 32 shards at a time. Rows of one shard and one
    island are the most that a task holds at once, whatever the input's size. Items as long as the capacity take a
    sequence each and no part in the search.
    """
    full = sized.where(F.col("length") >= capacity).select("uid", (F.col("uid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = sized.where(F.col("length") < capacity).select("uid", "length")
    shards = max(1, -(-rest.count() // shard_items))
    dealt = rest.select("uid", F.col("length").cast("int").alias("length"), F.pmod(F.xxhash64("uid"), F.lit(shards)).alias("shard"))
    schema = "shard long, island int, source int, uid long, length int, bin int, fitness double"

    def evolve(pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0])
        elites = [x.sort_values("uid") for _, x in pdf.groupby("source", sort=True)]
        one = elites[0]
        seed = (shard * 31 + island) * 1009 + int(one["bin"].iloc[0] >= 0) * 7 + len(elites)
        packer = Packer(one["length"].to_numpy(), capacity, seed)
        start = [x["bin"].to_numpy(np.int64) for x in elites] if one["bin"].iloc[0] >= 0 else [packer.fresh(0.0 if island == 0 else 0.02)]
        start += [packer.fresh(0.05 * (k + 1)) for k in range(population - len(start))]
        best = packer.evolve(start, generations)
        return pd.DataFrame({"shard": shard, "island": island, "source": island, "uid": one["uid"].to_numpy(), "length": one["length"].to_numpy(), "bin": best, "fitness": packer.fitness(best)})

    state = dealt.select("shard", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"), F.lit(-1).alias("source"), "uid", "length", F.lit(-1).alias("bin"), F.lit(0.0).alias("fitness"))
    state = state.groupBy("shard", "island").applyInPandas(evolve, schema)
    for _ in range(epochs - 1):
        moved = state.withColumn("island", ((F.col("island") + 1) % islands).cast("int"))
        state = state.union(moved).groupBy("shard", "island").applyInPandas(evolve, schema)

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        best = pdf.sort_values(["fitness", "source", "uid"], ascending=[False, True, True])
        best = best[best["source"] == best["source"].iloc[0]]
        return _placed(best, int(best["shard"].iloc[0]))

    def _placed(best: pd.DataFrame, shard: int) -> pd.DataFrame:
        best = best.sort_values(["bin", "uid"])
        size = best["length"].to_numpy(np.int64)
        before = np.cumsum(size) - size
        new = np.r_[True, np.diff(best["bin"].to_numpy()) != 0]
        offset = before - np.maximum.accumulate(np.where(new, before, 0))
        load = best.groupby("bin")["length"].transform("sum").to_numpy()
        return pd.DataFrame({"shard": shard, "uid": best["uid"].to_numpy(), "length": size, "bin": best["bin"].to_numpy(np.int64), "offset": offset, "load": load})

    held = state.groupBy("shard").applyInPandas(settle, "shard long, uid long, length long, bin long, offset long, load long")
    held = written(held, "packed")
    tail = F.col("load") < int(capacity * 0.97)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("uid")
        packer = Packer(pdf["length"].to_numpy(), capacity, 1)
        old = pd.factorize(pdf["shard"] * 2**31 + pdf["bin"], sort=True)[0].astype(np.int64)
        best = packer.evolve([old, packer.fresh(0.0), packer.fresh(0.05)], generations)
        return _placed(pdf.assign(bin=best), int(pdf["group"].iloc[0]))[["shard", "uid", "bin", "offset"]]

    last = held.where(tail).withColumn("group", F.floor(F.col("shard") / 32)).groupBy("group").applyInPandas(merge, "shard long, uid long, bin long, offset long")
    number = lambda kind: (F.shiftleft("shard", 26) + F.col("bin")) * 4 + kind
    kept = held.where(~tail).select("uid", number(1).alias("sequence_id"), "offset")
    return full.union(kept).union(last.select("uid", number(2).alias("sequence_id"), "offset"))


def packed_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False, fine_units: bool = False, **search) -> DataFrame:
    """All documents packed: rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]).

    Each sequence holds its pieces gapless from offset 0. An empty table gives no rows; repeated rows are packed each;
    null ids stay null; other columns are not read.
    """
    with arrow_rows(docs.sparkSession, 1000):  # whole texts: 10,000 a batch take several times their bytes
        cut = written(pieces(docs, tokenizer_path, capacity, end_id, with_ids, fine_units).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    places = pack(cut.select("uid", "length"), capacity, **search)
    out = cut.join(places, "uid").drop("uid")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)
