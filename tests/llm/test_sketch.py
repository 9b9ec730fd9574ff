import subprocess
import sys
import tracemalloc

import numpy as np

from geoquilt.llm import shared, sketch


def test_few_and_many_hashes_make_the_same_slices(monkeypatch):
    r = np.random.Generator(np.random.PCG64(1))
    h = r.integers(0, 2**63, 9000, dtype=np.uint64)
    h = np.concatenate([h, h[:3000], h[1000:1500]])
    for bits, rows, least in ((16, 2, 2), (22, 2, 2), (21, 1, 1), (14, 3, 2)):
        got = []
        for few in (1 << 21, 500):
            monkeypatch.setattr(sketch, "_FEW", few)
            local = sketch._Local(bits, rows, least)
            for k in range(0, len(h), 400):
                local.add(h[k : k + 400])
            assert bool(local.once) == (few == 500)
            got.append([(key, a.tobytes(), b.tobytes()) for key, a, b in local.slices()])
        assert got[0] == got[1] and len(got[0]) >= rows
    assert list(sketch._Local(16, 2, 2).slices()) == []


def test_counts_never_fall_short(spark):
    r = np.random.Generator(np.random.PCG64(2))
    h = r.integers(-(2**62), 2**62, 5000)
    twice = h[:2000]
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([h, twice])], "h long").repartition(5)

    def hashes(batch):
        yield np.asarray(batch.column(0), np.int64).view(np.uint64)

    for bits in (12, 22):
        held = sketch.merged(df, hashes, bits, 2)
        assert held.maybe(twice.view(np.uint64)).all()
        assert sketch.merged(df, hashes, bits, 2, least=1).maybe(h.view(np.uint64)).all()
    assert held.maybe(h[2000:].view(np.uint64)).mean() < 0.01
    assert not sketch.merged(df.limit(0), hashes, 12, 2).maybe(h.view(np.uint64)).any()


def test_a_partition_of_some_thousand_texts_takes_little_besides_its_hashes():
    r = np.random.Generator(np.random.PCG64(3))
    for n in (2_000_000, 4_000_000):  # what 16 MB and 32 MB of text give
        tracemalloc.start()
        local = sketch._Local(28, 2, 2)
        for _ in range(n // 50_000):
            local.add(r.integers(0, 2**63, 50_000, dtype=np.uint64))
        slices = sum(1 for _ in local.slices())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert slices == 512 and peak < 2 * 8 * n, peak


def test_one_long_array_of_hashes_is_counted_like_its_parts(monkeypatch):
    monkeypatch.setattr(sketch, "_FEW", 1 << 19)
    monkeypatch.setattr(sketch, "_CHUNK", 1 << 17)
    h = np.random.Generator(np.random.PCG64(4)).integers(0, 2**63, 1 << 20, dtype=np.uint64)
    h = np.concatenate([h, h[:70_000]])
    got = []
    for step in (len(h), 9_999):
        local = sketch._Local(22, 2, 2)
        for k in range(0, len(h), step):
            local.add(h[k : k + step])
        got.append([(key, a.tobytes(), b.tobytes()) for key, a, b in local.slices()])
    assert got[0] == got[1]
    for row in range(2):
        count = np.bincount(sketch.cells(h, row, 22), minlength=1 << 22)
        for least, at in ((1, 1), (2, 2)):
            whole = b"".join(x[at] for x in got[0] if x[0] >> 12 == row)
            assert (np.unpackbits(np.frombuffer(whole, np.uint8)) == (count >= least)).all()


GIVES_BACK = r"""
import re
import numpy as np
from geoquilt.llm.shared import lean

def held():
    return sum(map(int, re.findall(r"\nRss:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def task(batches):
    for _ in batches:
        parts = [np.ones(10_000) for _ in range(2000)]  # 160 MB in pieces that the C library keeps
        pins.append(parts.pop())
        yield len(parts)

pins = []
before = held()
assert list(lean(task)([1, 2])) == [1999, 1999]
assert held() < before + 40, (before, held())
stopped = lean(task)([1, 2])
next(stopped)
stopped.close()
assert held() < before + 40, (before, held())
"""


def test_a_worker_gives_memory_back_after_a_task():
    assert shared.lean(iter).__wrapped__ is iter
    if sys.platform == "linux":
        subprocess.run([sys.executable, "-c", GIVES_BACK], check=True, timeout=120)


def test_partitions_follow_bytes(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(40000).selectExpr("id", "hash(id) as h").repartition(30).write.parquet(path)
    df = spark.read.parquet(path)
    size = shared.bytes_read(df)
    assert size == sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    assert shared.bytes_read(df.where("id > 3").groupBy("h").count().join(df, "h")) >= size  # a join counts what it reads
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size // 25))
    try:
        assert shared.few_files(df, 1).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
        monkeypatch.setattr(shared, "_PART_BYTES", size // 10)
        assert 10 <= shared.few_files(df, 1).rdd.getNumPartitions() <= 11
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert shared.most_partitions(spark.range(3)) == 2 * spark.sparkContext.defaultParallelism


def test_slices_that_meet_in_steps(spark, monkeypatch):
    h = np.random.Generator(np.random.PCG64(3)).integers(-(2**62), 2**62, 3000)
    df = spark.createDataFrame([(int(x),) for x in np.concatenate([h, h[:900]])], "h long").repartition(7)

    def hashes(batch):
        yield np.asarray(batch.column(0), np.int64).view(np.uint64)

    whole = sketch.merged(df, hashes, 14, 2)
    monkeypatch.setattr(sketch, "_AT_ONCE", 2)
    assert all((a == b).all() for a, b in zip(whole.maps, sketch.merged(df, hashes, 14, 2).maps))
