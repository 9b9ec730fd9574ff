"""Fill-in-the-middle rearrangement of documents, cut between units by run-length class encoding.

A text is held as its maximal runs of one character class, with the units and code points up to each run. A cut after u
units is found by binary search for the run in which unit u ends, and its place follows by arithmetic from the run's
start and the bytes and code points that a unit has there. Texts are never split into lists of units.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import lean, runs, text_buffers
from .textscan import IS_SPACE

SENTINELS = ("<P>", "<S>", "<M>")
_WIDTH = np.ones(256, np.int64)  # bytes of the code point that a lead byte begins
_WIDTH[0xC0:], _WIDTH[0xE0:], _WIDTH[0xF0:] = 2, 3, 4


@dataclass
class Runs:
    """Class runs of several texts: starts in bytes; units and chars before each run (one entry more than runs), bytes
    and code points of one unit within it; first: each text's first run (one more than texts)."""

    offsets: np.ndarray
    first: np.ndarray
    starts: np.ndarray
    units: np.ndarray
    chars: np.ndarray
    unit_bytes: np.ndarray
    unit_chars: np.ndarray

    def counts(self) -> np.ndarray:
        """Units of each text."""
        return self.units[self.first[1:]] - self.units[self.first[:-1]]

    def cut(self, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte place and code points of each text after its first after[i] units."""
        base = self.units[self.first[:-1]]
        place, chars = self.offsets[:-1].copy(), np.zeros(len(base), np.int64)
        some = np.flatnonzero(after > 0)
        goal = base[some] + after[some]
        run = np.searchsorted(self.units[1:], goal)  # the first run up to whose end so many units are complete
        within = goal - self.units[run]
        place[some] = self.starts[run] + within * self.unit_bytes[run]
        chars[some] = self.chars[run] + within * self.unit_chars[run] - self.chars[self.first[:-1][some]]
        return place, chars


def encoded(data: np.ndarray, offsets: np.ndarray, unit: str = "token") -> Runs:
    """Runs of texts (UTF-8). unit token: classes are white space and the rest; each run of the rest ends a unit, and so
    does white space at a text's end. unit character: classes are code points of one, two, three and four bytes."""
    lead = (data & 0xC0) != 0x80
    change = np.zeros(len(data), bool)
    change[offsets[:-1][offsets[:-1] < len(data)]] = True
    if unit == "token":
        space = IS_SPACE[data]
        change[1:] |= space[1:] != space[:-1]
    elif unit == "character":
        at = np.flatnonzero(lead)
        wide = _WIDTH[data[at]]
        change[at[1:][wide[1:] != wide[:-1]]] = True
    else:
        raise ValueError("unit must be token or character")
    starts = np.flatnonzero(change)
    length = np.diff(starts, append=len(data))
    first = np.searchsorted(starts, offsets)
    points = np.add.reduceat(lead, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    if unit == "token":
        count = (~space[starts]).astype(np.int64)
        count[first[1:][np.diff(first) > 0] - 1] = 1
        unit_bytes, unit_chars = length, points
    else:
        count, unit_bytes, unit_chars = points, _WIDTH[data[starts]], np.ones(len(starts), np.int64)
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    return Runs(offsets, first, starts, before(count), before(points), unit_bytes, unit_chars)


def draws(keys: list, seed: int) -> np.ndarray:
    """Four numbers below 2**32 for each key: the first 32 hexadecimal digits of the SHA-256 of `seed:key`."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys)
    return np.frombuffer(raw, ">u4").reshape(-1, 4).astype(np.int64)


def transformed(
    docs: DataFrame, percent: int = 50, suffix_first: int = 80, seed: int = 42, sentinels: tuple[str, str, str] = SENTINELS, unit: str = "token", id_: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output), one a document.

    n is the number of units. `percent` of the documents are cut in prefix, middle and suffix at two places drawn from
    their ids and the seed; of these `suffix_first` percent come suffix first (spm), the others prefix first (psm), the
    middle last. Empty texts, and texts that hold a sentinel (prefix, suffix, middle), stay as they are (plain). Null
    text is empty, a null id is drawn for as the empty string, repeated rows come out alike; an empty table gives no
    rows. Other columns are not read. A task holds a text's bytes and, for a unit, some 50 bytes more.
    """
    marks = [s.encode() for s in sentinels]
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("sentinels must be three different strings")

    @lean
    def run(batches):
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for i, j in runs(offsets, 1 << 20):
                keys = batch.column(0).slice(i, j - i)
                yield pa.RecordBatch.from_arrays([keys, *_forms(keys.to_pylist(), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])], names)

    def _forms(keys: list, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        held = encoded(data, offsets, unit)
        n, h = held.counts(), draws(keys, seed)
        one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
        (low, low_chars), (high, high_chars) = held.cut(np.minimum(one, two)), held.cut(np.maximum(one, two))
        raw, ends = data.tobytes(), offsets.tolist()
        plain = (n == 0) | (h[:, 2] % 100 >= percent)
        for mark in marks:
            if mark in raw:
                plain |= np.array([mark in raw[a:b] for a, b in zip(ends, ends[1:])], bool)
        spm = ~plain & (h[:, 3] % 100 < suffix_first)
        p, s, m = marks
        out = []
        for a, b, c, d, stays, turned in zip(ends, low.tolist(), high.tolist(), ends[1:], plain.tolist(), spm.tolist()):
            out.append(raw[a:d] if stays else s + raw[c:d] + p + raw[a:b] + m + raw[b:c] if turned else p + raw[a:b] + s + raw[c:d] + m + raw[b:c])
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")).tolist(), pa.string())
        return [pa.array(n), form, pa.array(low_chars, mask=plain), pa.array(high_chars - low_chars, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]

    names = [id_, "n", "form", "prefix_chars", "middle_chars", "output"]
    rows = docs.select(F.col(id_).cast("long").alias(id_), F.col(text).cast("string").alias(text))
    return rows.mapInArrow(run, f"`{id_}` long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that `transformed` was given, from its output and form alone."""
    p, s, m = sentinels

    def parts(opening: str, between: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(opening) + 1))
        one = F.substring_index(body, between, 1)
        rest = F.substr(body, F.length(one) + len(between) + 1)
        two = F.substring_index(rest, m, 1)
        return one, two, F.substr(rest, F.length(two) + len(m) + 1)

    prefix, suffix, middle = parts(p, s)
    back, front, inner = parts(s, p)
    return F.when(form == "plain", output).when(form == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(front, inner, back))


def digests(docs: DataFrame) -> DataFrame:
    """What `transformed` makes of documents, texts as SHA-256: (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    rows = transformed(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS t, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1,
    CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, len(t) AS n, least(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS a, greatest(h1 % (len(t) + 1), h2 % (len(t) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, coalesce(array_to_string(t[1:a], ''), '') AS prefix, coalesce(array_to_string(t[a + 1:b], ''), '') AS middle, coalesce(array_to_string(t[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p
"""
