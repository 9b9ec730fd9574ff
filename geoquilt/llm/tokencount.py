"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where they surely agree."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .shared import lean, runs, text_buffers

_SPACE = frozenset(" \t\n\v\f\r")


@lru_cache(maxsize=2)
def _codec(path: str) -> tokens.UnitCodec:
    return tokens.UnitCodec(path)


def splice_places(text: str, low: int, high: int):
    """Character positions in (low, high) where white space follows a solid character: what stands before cannot change what follows."""
    for p in range(max(low, 1), high):
        if text[p] in _SPACE and not text[p - 1].isspace() and text[p - 1].isprintable():
            yield p


def resynchronised_ids(tokenizer, text: str, chunk: int = 1 << 16, overlap: int = 256) -> list[int]:
    """The ids of tokenizer.encode(text, add_special_tokens=False), by chunks.

    Each chunk reaches `overlap` characters into the next. The two are spliced at a place in the overlap where both
    encodings begin a token (their offsets tell) and white space follows a solid character: up to there the earlier
    chunk is right, from there on the later one. Where the overlap holds no such place it is doubled, up to the text's
    end, so a text without white space is encoded whole. Tokenizers whose added tokens hold white space, take it away
    on their sides or are matched after normalisation have no such proof: with them the text is encoded whole.
    """
    added = [x for x in tokenizer.get_added_tokens_decoder().values()]
    if len(text) <= chunk + overlap or any(x.lstrip or x.rstrip or x.single_word or any(c.isspace() for c in x.content) for x in added):
        return tokenizer.encode(text, add_special_tokens=False).ids
    out: list[int] = []
    begin, skip_to = 0, 0  # the current chunk's first character; the place from which its tokens count
    reach, end = overlap, min(len(text), chunk + overlap)
    current = tokenizer.encode(text[:end], add_special_tokens=False)
    while True:
        starts = [begin + a for a, _ in current.offsets]
        if end >= len(text):
            return out + [i for i, s in zip(current.ids, starts) if s >= skip_to]
        later_begin = end - reach
        later_end = min(len(text), later_begin + chunk + reach)
        later = tokenizer.encode(text[later_begin:later_end], add_special_tokens=False)
        agreed = _agreed(text, current, begin, later, later_begin, max(later_begin, skip_to), end)
        if agreed is None:  # widen: the current chunk reaches further
            reach *= 2
            end = min(len(text), end + reach)
            current = tokenizer.encode(text[begin:end], add_special_tokens=False)
            continue
        out += [i for i, s in zip(current.ids, starts) if skip_to <= s < agreed]
        begin, end, current, skip_to, reach = later_begin, later_end, later, agreed, overlap


def _agreed(text: str, one, one_begin: int, two, two_begin: int, low: int, high: int) -> int | None:
    """The last place that is stable and cut by no token of either chunk.

    A tokenizer that drops white space leaves gaps, so a place counts where no token spans it."""

    def spans(encoding, begin: int, p: int) -> bool:
        return any(begin + a < p < begin + b for a, b in encoding.offsets[_near(encoding, p - begin) :][:8])

    for p in reversed(list(splice_places(text, low + 1, high))):
        if not spans(one, one_begin, p) and not spans(two, two_begin, p):
            return p
    return None


def _near(encoding, p: int) -> int:
    """The number of a token a little before character p."""
    low, high = 0, len(encoding.offsets)
    offsets = encoding.offsets if isinstance(encoding.offsets, list) else list(encoding.offsets)
    while low < high:
        mid = (low + high) // 2
        low, high = (mid + 1, high) if offsets[mid][1] < p else (low, mid)
    return max(0, low - 2)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, huge: int = 1 << 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit) for every row of docs, one for one.

    Texts of over `huge` characters go through resynchronised_ids, others through the unit cache. Null texts are empty:
    0 bytes, 0 tokens. Null keys stay null, repeated rows stay repeated, other columns (whatever their names) are not read.
    The tokenizer's special strings inside a text count as the library counts them by default: one token each.
    """

    @lean
    def run(batches):
        codec = _codec(tokenizer_path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n_bytes = np.diff(offsets)
            counts = np.zeros(len(n_bytes), np.int64)
            long = n_bytes > huge  # at least as many bytes as characters
            for i in np.flatnonzero(long).tolist():
                whole = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace")
                counts[i] = len(resynchronised_ids(codec.tokenizer, whole, huge))
            edges = np.flatnonzero(np.diff(np.concatenate([[True], long, [True]]).astype(np.int8)))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # stretches of ordinary texts
                for i, j in runs(offsets[a : b + 1], 1 << 20):
                    part = offsets[a + i : a + j + 1]
                    counts[a + i : a + j] = codec.counts(data[part[0] : part[-1]], part - part[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{key}` as long) as doc_id", f"`{text}` as text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
