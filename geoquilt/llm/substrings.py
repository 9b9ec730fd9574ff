"""Removal of word windows that an earlier document already has.

A merged count-min sketch of all windows overestimates in how many documents each stands. Only windows that it takes
for repeated are grouped, exactly; those that two documents really hold give the removals. None is lost, because the
sketch never estimates too low.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import sketch, textscan
from .shared import discard, lean, runs, small_batches, splittable, text_buffers, written

def _scan(data: np.ndarray, offsets: np.ndarray):
    """For runs of texts: (first text number, bytes, word starts, word ends, first word of each text, hashes of words)."""
    for i, j in runs(offsets, 1 << 19):
        part = offsets[i : j + 1] - offsets[i]
        piece = data[offsets[i] : offsets[j]]
        starts, ends, first = textscan.words(piece, part)
        yield i, piece, starts, ends, first, textscan.span_hashes(piece, starts, ends)


def _placed(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows within one text each: text number, position in it, two independent hashes."""
    w1 = textscan.windows(h, n)
    size = np.diff(first)
    many = np.maximum(0, size - n + 1)
    doc = np.repeat(np.arange(len(size)), many)
    position = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = first[:-1][doc] + position
    w2 = textscan.windows(h, n, seed=5)
    return doc, position, w1[at], w2[at]


def _judged(docs: DataFrame, n: int, sketch_bits: int, most_broadcast: int):
    """What goes from docs (doc_id, text): (doc_id, tag, positions of windows), whole copies (doc_id), and a broadcast bitmap of both's ids.

    Ids of exact copies are broadcast, so that their windows are looked at once, up to most_broadcast bytes of known
    size; beyond, or where an id has several texts, copies go the way of all other documents, to the same result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    profile = written(docs.mapInArrow(lean(_digests), "doc_id long, n_words long, d1 long, d2 long"), "digests")
    some = profile.where("doc_id is not null").where(F.col("n_words") >= n)
    firsts = some.groupBy("d1", "d2", "n_words").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = some.join(splittable(firsts), ["d1", "d2", "n_words"]).where("doc_id > least").select("doc_id").distinct()
    copies = written(copies, "copies")
    ids_once = profile.where("doc_id is not null").groupBy("doc_id").agg(F.min("d1").alias("x"), F.max("d1").alias("y")).where("x <> y")
    ambiguous = ids_once.limit(1).count() > 0  # an id with different texts: then copies aren't told by id
    n_copies = copies.count()
    live = docs
    if n_copies and not ambiguous and n_copies * 8 <= most_broadcast:  # of known size; else copies go the way of all others
        live = docs.join(F.broadcast(copies), "doc_id", "left_anti")

    def hashes(batch: pa.RecordBatch):
        ids = np.asarray(batch.column(0).is_valid(), bool)
        data, offsets = text_buffers(batch.column(1))
        for i, _, _, _, first, h in _scan(data, offsets):
            doc, _, w1, _ = _placed(h, first, n)
            w1, doc = w1[ids[i + doc]], doc[ids[i + doc]]
            order = np.lexsort((w1, doc))
            w1, doc = w1[order], doc[order]
            yield w1[np.r_[True, (w1[1:] != w1[:-1]) | (doc[1:] != doc[:-1])]] if len(w1) else w1

    repeated = spark.sparkContext.broadcast(sketch.merged(live, hashes, sketch_bits, 2, per_core=8))

    def candidates(batches):
        held = repeated.value
        for batch in batches:
            keys = batch.column(0)
            valid = np.asarray(keys.is_valid(), bool)
            data, offsets = text_buffers(batch.column(1))
            for i, _, _, _, first, h in _scan(data, offsets):
                doc, _, w1, w2 = _placed(h, first, n)
                on = held.maybe(w1) & valid[i + doc]
                yield pa.RecordBatch.from_arrays([pa.array(w1[on].view(np.int64)), pa.array((w2[on] >> np.uint64(32)).astype(np.uint32).view(np.int32)), keys.take(pa.array(i + doc[on]))], ["h1", "h2", "doc_id"])

    found = live.mapInArrow(lean(candidates), "h1 long, h2 int, doc_id long")
    found = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h1", "h2", "least")
    found = written(found, "repeated")
    repeated.unpersist()

    def found_hashes(batch: pa.RecordBatch):
        yield np.asarray(batch.column(0), np.int64).view(np.uint64)

    surely = spark.sparkContext.broadcast(sketch.merged(found.select("h1"), found_hashes, sketch_bits, 1, least=1))

    def occurrences(batches):
        held = surely.value
        for batch in batches:
            keys = batch.column(0)
            valid = np.asarray(keys.is_valid(), bool)
            data, offsets = text_buffers(batch.column(1))
            for i, _, _, _, first, h in _scan(data, offsets):
                doc, position, w1, w2 = _placed(h, first, n)
                on = held.maybe(w1) & valid[i + doc]
                place = (_tags(h, first)[doc[on]] >> np.uint64(32) << np.uint64(32)) | position[on].astype(np.uint64)  # the text's tag tells texts of one id apart
                yield pa.RecordBatch.from_arrays([pa.array(w1[on].view(np.int64)), pa.array((w2[on] >> np.uint64(32)).astype(np.uint32).view(np.int32)), keys.take(pa.array(i + doc[on])), pa.array(place.view(np.int64))], ["h1", "h2", "doc_id", "place"])

    hits = live.mapInArrow(lean(occurrences), "h1 long, h2 int, doc_id long, place long").join(found, ["h1", "h2"]).where("doc_id > least").select("doc_id", F.shiftright("place", 32).alias("tag"), F.col("place").bitwiseAND(0xFFFFFFFF).cast("int").alias("position"))
    cuts = hits.groupBy("doc_id", "tag").agg(F.collect_set("position").alias("positions"))  # at most a document's own windows
    cuts = written(cuts, "cuts")
    surely.unpersist()
    discard(found)

    def cut_hashes(batch: pa.RecordBatch):
        yield textscan.mix(np.asarray(batch.column(0), np.int64).view(np.uint64), 78)

    touched = spark.sparkContext.broadcast(sketch.merged(cuts.select("doc_id").distinct().union(copies), cut_hashes, 26, 2, least=1))
    whole = copies.withColumn("whole", F.lit(True))
    return cuts, (whole if live is not docs else whole.limit(0)), touched


def deduplicated(docs: DataFrame, n: int = 13, sketch_bits: int = 28, with_text: bool = False, most_broadcast: int = 32 << 20) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256[, kept]), one for each row of docs.

    A word goes if a window of n words that covers it also starts in a document of a smaller doc_id; what is left is
    joined by single spaces. Windows are judged on the input. Null texts and texts of fewer than n words lose nothing.
    A null doc_id is smaller than none and later than none: its row is returned as it is and takes nothing from others.
    Repeated rows of one id never remove each other. Other columns are not read. Windows are told apart by 96 bits of
    hashes: of W windows any two meet by chance with odds below W * W / 2**97.
    """
    docs = docs.selectExpr("cast(doc_id as long) as doc_id", "text")
    cuts, whole, touched = _judged(docs, n, sketch_bits, most_broadcast)
    shape = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text
    untouched, rest = _parted(docs, touched)

    def keep(batches):
        for batch in batches:
            yield _finished(batch, None, None, n, with_text)

    def remove(batches):
        for batch in batches:
            yield _finished(batch.select(["doc_id", "text"]), batch.column("positions"), batch.column("whole"), n, with_text)

    joined = rest.join(cuts, ["doc_id", "tag"], "left").join(whole, "doc_id", "left")
    return untouched.mapInArrow(lean(keep), shape).union(joined.select("doc_id", "text", "positions", "whole").mapInArrow(lean(remove), shape))


def _parted(docs: DataFrame, touched) -> tuple[DataFrame, DataFrame]:
    """docs without those whose doc_id the bitmap may hold, which need no shuffle; and those, with their texts' tags."""
    key, text = docs.columns.index("doc_id"), docs.columns.index("text")

    def part(batches, ours: bool):
        held = touched.value
        for batch in batches:
            valid = np.asarray(batch.column(key).is_valid(), bool)
            ids = np.asarray(batch.column(key).fill_null(0), np.int64)
            mine = held.maybe(textscan.mix(ids.view(np.uint64), 78)) & valid
            some = batch.take(pa.array(np.flatnonzero(mine if ours else ~mine)))
            if ours:
                data, offsets = text_buffers(some.column(text))
                tags = [_tags(h, first) for _, _, _, _, first, h in _scan(data, offsets)]
                tags = np.concatenate(tags) if tags else np.zeros(0, np.uint64)
                some = some.append_column("tag", pa.array(tags.view(np.int64) >> 32))
            yield some

    return docs.mapInArrow(lean(lambda b: part(b, False)), docs.schema), docs.mapInArrow(lean(lambda b: part(b, True)), StructType([*docs.schema.fields, StructField("tag", LongType())]))


def cleaned(docs: DataFrame, n: int = 13, sketch_bits: int = 28, most_broadcast: int = 32 << 20) -> DataFrame:
    """docs with the removals made in text (and n_chars, where there is one); documents that lose every word go.

    Rows that lose nothing stay exactly as they are, with all their columns, and are not shuffled.
    """
    columns = docs.columns
    cuts, whole, touched = _judged(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), n, sketch_bits, most_broadcast)
    inner = [c if c in ("doc_id", "text", "n_chars") else f"c{i}" for i, c in enumerate(columns)]  # no column of docs meets one of ours
    docs = docs.toDF(*inner)
    untouched, rest = _parted(docs, touched)
    joined = rest.join(cuts, ["doc_id", "tag"], "left").join(whole, "doc_id", "left").select(*inner, "positions", "whole")

    def remove(batches):
        for batch in batches:
            done = _finished(batch.select(["doc_id", "text"]), batch.column("positions"), batch.column("whole"), n, True)
            lost = np.asarray(done.column("n_removed")) > 0
            texts = [k if x else t for x, k, t in zip(lost, done.column("kept").to_pylist(), batch.column("text").to_pylist())]
            out = [pa.array(texts, batch.schema.field(c).type) if c == "text" else batch.column(c) for c in inner]
            if "n_chars" in inner:
                at = inner.index("n_chars")
                out[at] = pa.array([len(t) if x else old for x, t, old in zip(lost, texts, out[at].to_pylist())], out[at].type)
            yield pa.RecordBatch.from_arrays(out, inner).filter(pa.array([not x or t != "" for x, t in zip(lost, texts)]))

    return untouched.union(joined.mapInArrow(lean(remove), docs.schema)).toDF(*columns)


def _tags(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's words in their order."""
    order = np.arange(len(h), dtype=np.uint64) - np.repeat(first[:-1], np.diff(first)).astype(np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textscan.mix(h, 1) * textscan.mix(order, 9))])
    return sums[first[1:]] - sums[first[:-1]]


def _digests(batches):
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        size, d1, d2 = [], [], []
        for _, _, _, _, first, h in _scan(data, offsets):
            order = np.arange(len(h), dtype=np.uint64)
            for seed, out in ((1, d1), (2, d2)):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textscan.mix(h, seed) * textscan.mix(order - np.repeat(first[:-1], np.diff(first)).astype(np.uint64), seed + 8))])
                out.append(sums[first[1:]] - sums[first[:-1]])
            size.append(np.diff(first))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(join(size, np.int64).astype(np.int64)), pa.array(join(d1, np.uint64).view(np.int64)), pa.array(join(d2, np.uint64).view(np.int64))], ["doc_id", "n_words", "d1", "d2"])


def _finished(batch: pa.RecordBatch, positions, whole, n: int, with_text: bool) -> pa.RecordBatch:
    """The result of a batch of (doc_id, text), with the removed windows' positions or none."""
    data, offsets = text_buffers(batch.column(1))
    n_words, n_removed, digest, kept = [], [], [], []
    for i, piece, starts, ends, first, _ in _scan_words(data, offsets):
        gone = np.zeros(len(starts) + 1, np.int64)
        if positions is not None:
            for k in range(len(first) - 1):
                if whole[i + k].as_py():
                    gone[first[k]] += 1
                    gone[first[k + 1]] -= 1
                elif positions[i + k].is_valid:
                    p = np.asarray(positions[i + k].values, np.int64) + first[k]
                    np.add.at(gone, p, 1)
                    np.add.at(gone, p + n, -1)
        gone = np.cumsum(gone)[:-1] > 0
        raw = piece.tobytes()
        stay = np.flatnonzero(~gone)
        bounds = np.searchsorted(stay, first)
        a, b = starts[stay].tolist(), ends[stay].tolist()
        for k in range(len(first) - 1):
            low, high = bounds[k], bounds[k + 1]
            text = b" ".join([raw[x:y] for x, y in zip(a[low:high], b[low:high])])
            n_words.append(int(first[k + 1] - first[k]))
            n_removed.append(n_words[-1] - int(high - low))
            digest.append(hashlib.sha256(text).hexdigest())
            if with_text:
                kept.append(text.decode("utf-8", "replace"))
    columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
    if with_text:
        columns.append(pa.array(kept, pa.string()))
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])


def _scan_words(data: np.ndarray, offsets: np.ndarray):
    for i, j in runs(offsets, 1 << 19):
        piece = data[offsets[i] : offsets[j]]
        yield i, piece, *textscan.words(piece, offsets[i : j + 1] - offsets[i]), None


ORACLE = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS k) WHERE len(w) >= 13
), f AS (
  SELECT s, min(doc_id) AS least FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)
), g AS (
  SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS place FROM x JOIN f USING (s) WHERE doc_id > least
), h AS (
  SELECT doc_id, list(place) AS gone FROM g GROUP BY doc_id
), r AS (
  SELECT doc_id, w, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(gone, i)) END AS kept FROM d LEFT JOIN h USING (doc_id)
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM r
"""
