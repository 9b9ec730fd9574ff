"""Spelling variants of a corpus's words by full neighbourhood generation.

Every deletion, replacement and insertion of one letter over the observed alphabet is formed for every word and
hash-joined, as a string, to the vocabulary: what meets is a neighbour, so no distance is ever computed. Most candidates
are no words. Their hashes follow by arithmetic from prefix sums of the word's own hash, and a bitmap of the
vocabulary's hashes (of fixed size) tells nearly all of them before a string is built or sent.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import lean, runs, text_buffers, written
from .textscan import LOWER, mix

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LEAD = 0xC3  # of the code points U+00C0 to U+00FF
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_BITS = 27
_CELLS = 1 << 21  # candidates whose hashes are formed together
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span, continued from the CRC-32 of what goes before it."""
    size = ends - starts
    out = np.empty(len(starts), np.uint32)
    for i in np.flatnonzero(size > 64).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(begun[i]))
    order = np.flatnonzero(size <= 64)
    order = order[np.argsort(-size[order], kind="stable")]
    state, at, left = ~begun[order].astype(np.uint32), starts[order], -size[order]
    for k in range(int(-left[0]) if len(left) else 0):
        n = int(np.searchsorted(left, -k))  # spans longer than k
        head = state[:n]
        state[:n] = _TABLE[(head ^ data[at[:n] + k]) & 0xFF] ^ (head >> 8)
    out[order] = ~state
    return out


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of true that cross no text's border."""
    before, after = np.zeros(len(inside) + 1, bool), np.zeros(len(inside) + 1, bool)
    before[1:], after[:-1] = inside, inside
    before[offsets] = False
    after[offsets] = False
    return np.flatnonzero(inside & ~before[:-1]), np.flatnonzero(inside & ~after[1:]) + 1


def _words(keys: list, data: np.ndarray, offsets: np.ndarray, every: int, shortest: int) -> pa.Array:
    low = LOWER[data]
    lead = low == _LEAD
    inside = _LETTER[low] | lead
    inside[1:] |= lead[:-1]
    starts, ends = _spans(inside, offsets)
    pairs = np.concatenate([[0], np.cumsum(lead)])
    points = ends - starts - (pairs[ends] - pairs[starts])
    long = points >= shortest  # what is shorter can't become long enough
    starts, ends, points = starts[long], ends[long], points[long]
    begun = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in keys], np.uint32)
    crc = crc32(low, starts, ends, begun[np.searchsorted(offsets, starts, side="right") - 1]).astype(np.int64)
    hit = crc % every == 0
    gone = np.zeros(len(low) + 1, bool)
    narrow = hit & (points == ends - starts)
    gone[starts[narrow] + crc[narrow] % points[narrow]] = True
    for i in np.flatnonzero(hit & ~narrow).tolist():
        heads = np.flatnonzero((low[starts[i] : ends[i]] & 0xC0) != 0x80)
        p = int(starts[i] + heads[int(crc[i]) % len(heads)])
        gone[p : p + 1 + (low[p] == _LEAD)] = True
    stays = points - hit >= shortest
    starts, ends = starts[stays], ends[stays]
    size = ends - starts
    to = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(to[-1]) + np.repeat(starts - to[:-1], size)
    kept = ~gone[index]
    places = np.concatenate([[0], np.cumsum(kept)])[to]
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(low[index[kept]]))


def vocabulary(docs: DataFrame, every: int = 31, shortest: int = 7, least: int = 2, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (word, n): words of at least `shortest` letters and `least` occurrences in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z change case. Of a word whose CRC-32 with
    its document's id `every` divides, one letter is left out: misspellings at a known rate; 0 leaves all as they are.
    """

    @lean
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in runs(offsets, 4 << 20):
                found = _words(batch.column(0).slice(i, j - i).to_pylist(), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], every or 1 << 32, shortest)
                counts = found.value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0).cast(pa.string()), counts.field(1)], ["word", "n"])

    rows = docs.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Coded:
    """Words as code points, with the parts their neighbours' hashes are made of. A word's hash is the sum of its code
    points times powers of an odd base, modulo 2**64."""

    def __init__(self, words: list[str]):
        self.size = np.array([len(w) for w in words], np.int64)
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.word = np.repeat(np.arange(len(words)), self.size)
        self.at = np.arange(len(self.codes)) - self.first[self.word]
        steps = np.full(int(self.size.max(initial=0)) + 1, _BASE, np.uint64)
        steps[:1] = 1
        self.power = np.multiply.accumulate(steps)
        self.term = self.codes * self.power[self.at]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.term)])
        self.total = sums[self.first[1:]] - sums[self.first[:-1]]
        self.before = sums[:-1] - sums[self.first[self.word]]


def positions(hashes: np.ndarray) -> np.ndarray:
    """Each hash's place in the bitmap."""
    return (mix(hashes) >> np.uint64(64 - _BITS)).astype(np.int64)


def neighbourhood(words: list[str], alphabet: list[str], known: np.ndarray | None = None) -> list[tuple[str, str]]:
    """(word, candidate), each once: all strings one deletion, replacement or insertion away over the alphabet; with a
    bitmap of known hashes only those whose hash is in it."""
    held = Coded(words)
    letters = np.array([ord(a) for a in alphabet], np.uint64)
    passes = (lambda h: np.ones(h.shape, bool)) if known is None else (lambda h: (lambda p: (known[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool))(positions(h)))
    out: set[tuple[str, str]] = set()
    total = held.total[held.word]
    after = total - held.before - held.term
    for i in np.flatnonzero(passes(held.before + after * np.uint64(_BACK))).tolist():
        w, k = words[held.word[i]], int(held.at[i])
        out.add((w, w[:k] + w[k + 1 :]))
    if not len(letters):
        return sorted(out)
    step = max(1, _CELLS // len(letters))
    for low in range(0, len(held.codes), step):
        part = slice(low, low + step)
        swapped = total[part, None] - held.term[part, None] + letters * held.power[held.at[part], None]
        for i, a in zip(*(x.tolist() for x in np.nonzero(passes(swapped) & (held.codes[part, None] != letters)))):
            w, k = words[held.word[low + i]], int(held.at[low + i])
            out.add((w, w[:k] + alphabet[a] + w[k + 1 :]))
    # a letter goes in before each letter and at each word's end
    word = np.concatenate([held.word, np.arange(len(words))])
    at = np.concatenate([held.at, held.size])
    before = np.concatenate([held.before, held.total])
    for low in range(0, len(word), step):
        part = slice(low, low + step)
        grown = (before[part] + (held.total[word[part]] - before[part]) * np.uint64(_BASE))[:, None] + letters * held.power[at[part], None]
        for i, a in zip(*(x.tolist() for x in np.nonzero(passes(grown)))):
            w, k = words[word[low + i]], int(at[low + i])
            out.add((w, w[:k] + alphabet[a] + w[k:]))
    return sorted(out)


def _bitmap(vocab: DataFrame) -> np.ndarray:
    """The vocabulary's hashes as 2**27 bits: 16 MB, whatever its size."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(positions(Coded(batch.column(0).to_pylist()).total) + 1)], ["at"])

    bits = vocab.select("word").mapInArrow(run, "at long")
    parts = bits.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()  # 4096 rows of 4 KB at most
    known = np.zeros(1 << (_BITS - 3), np.uint8)
    for x in parts:
        known[(x["bucket"] - 1) * 4096 : x["bucket"] * 4096] = np.frombuffer(x["bits"], np.uint8)
    return known


def near_words(vocab: DataFrame) -> DataFrame:
    """Rows (word, near): every two words of a table with a column of distinct words that differ by one letter, both ways."""
    spark = vocab.sparkSession
    letters = sorted(x[0] for x in vocab.select(F.explode(F.split("word", "")).alias("a")).where("a <> ''").distinct().collect())  # an alphabet
    known = spark.sparkContext.broadcast(_bitmap(vocab))

    @lean
    def run(batches):
        for batch in batches:
            words = batch.column(0).to_pylist()
            low = 0
            while low < len(words):  # words of about 16,384 letters at a time
                high, size = low, 0
                while high < len(words) and (high == low or size + len(words[high]) <= 16384):
                    size += len(words[high])
                    high += 1
                pairs = neighbourhood(words[low:high], letters, known.value)
                low = high
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["word", "near"])

    parts = max(spark.sparkContext.defaultParallelism, -(-vocab.count() // 50_000))
    candidates = vocab.select("word").repartition(parts, "word").mapInArrow(run, "word string, near string")
    return candidates.join(vocab.select(F.col("word").alias("near")), "near").select("word", "near")


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, root) of rows (word, form) that have no circle: where the forms lead in the end, by pointer doubling."""
    held = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = held.select(F.col("word").alias("root"), F.col("root").alias("next"))
        held = written(held.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not held.where("moved").limit(1).count():
            return held.select("word", "root")


def variants(docs: DataFrame, every: int = 31, shortest: int = 7, least: int = 2, times: int = 10, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one a word of the vocabulary.

    A word's form is its most frequent neighbour (ties: the smallest by code points) if that is `times` times as
    frequent, else null; root is where forms lead in the end, or the word itself; n_near counts neighbours. Null texts
    hold no words; a null id stands for the empty string; repeated rows count each; an empty table gives no rows.
    Other columns are not read.
    """
    vocab = written(vocabulary(docs, every, shortest, least, id_, text), "words")
    near = near_words(vocab).join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"))
    rows = vocab.join(best, "word", "left")
    chosen = F.col("best.near_n") >= times * F.col("n")
    rows = written(rows.select("word", F.when(chosen, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen, F.col("best.near_n")).alias("form_n")), "variants")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: CRC-32 is linear: a key's is the sum (xor) of what each byte gives by its distance from the end, and of the start value's part.
ORACLE = """
WITH RECURSIVE bits(b, k, v) AS (
  SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), t AS (SELECT b, v FROM bits WHERE k = 8), found AS (
  SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents)
), keyed AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS k FROM found WHERE length(run) >= 7 GROUP BY ALL
), longest AS (SELECT max(strlen(key)) AS n FROM keyed), c(d, b, v) AS (
  SELECT 0, b, v FROM t UNION ALL SELECT c.d + 1, c.b, xor(c.v >> 8, t.v) FROM c JOIN t ON t.b = c.v & 255 WHERE c.d < (SELECT n FROM longest)
), z(n, v) AS (
  SELECT 0, 4294967295 UNION ALL SELECT z.n + 1, xor(z.v >> 8, t.v) FROM z JOIN t ON t.b = z.v & 255 WHERE z.n < (SELECT n FROM longest)
), bytes AS (
  SELECT key, strlen(key) AS n, i, CAST('0x' || substr(hex(key), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT) AS b FROM (SELECT key, unnest(range(strlen(key))) AS i FROM keyed)
), summed AS (SELECT key, n, bit_xor(c.v) AS v FROM bytes JOIN c ON c.d = n - 1 - i AND c.b = bytes.b GROUP BY key, n), crcs AS (
  SELECT key, xor(xor(s.v, z.v), 4294967295) AS h FROM summed s JOIN z ON z.n = s.n
), spelt AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM keyed JOIN crcs USING (key)
), v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2), less AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS near FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word FROM less a JOIN v b ON a.s = b.word UNION SELECT b.word, a.word FROM less a JOIN v b ON a.s = b.word
), ranked AS (
  SELECT near.word, near, v.n AS near_n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY v.n DESC, near) AS r FROM near JOIN v ON v.word = near.near
), told AS (
  SELECT v.word, CASE WHEN near_n >= 10 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN ranked ON ranked.word = v.word AND r = 1
), follow(word, here) AS (
  SELECT word, word FROM told UNION ALL SELECT f.word, told.form FROM follow f JOIN told ON told.word = f.here WHERE told.form IS NOT NULL
), ends AS (SELECT f.word, f.here AS root FROM follow f JOIN told ON told.word = f.here WHERE told.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM told JOIN ends USING (word)
"""
