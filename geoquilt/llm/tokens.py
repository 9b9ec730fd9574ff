"""Token ids of many texts through the tokenizers library, encoding each distinct piece of text once.

A text is cut where a solid character is followed by white space. No pre-token of the supported tokenizers
(split by white-space-aware patterns, normalised character by character) reaches across such a place, and what
follows it is matched from there on without looking back. So the ids of a text are those of its units in turn,
and a unit has the same ids wherever it stands. tests/llm holds this against whole-text encoding.
"""

from __future__ import annotations

import os

import numpy as np

from . import textscan

_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0x80:] = True
#: Second last bytes that UTF-8 white space may have (U+0085, U+00A0, U+1680, U+2000 to U+205F, U+3000).
_MAYBE = np.zeros(256, bool)
_MAYBE[[0xC2, 0x9A, 0x80, 0x81]] = True


def load(path: str):
    """A tokenizer of the library from its .json file; each process uses one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def unit_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where units begin: at each text's start, and at white space after what is surely no white space."""
    first = np.zeros(len(data), bool)
    if len(data) > 1:
        solid = _SOLID[data[:-1]]
        wide = data[:-1] >= 0x80
        wide[1:] &= _MAYBE[data[:-2]]
        wide[:1] = False
        first[1:] = textscan.IS_SPACE[data[1:]] & solid & ~wide
    first[offsets[:-1][offsets[:-1] < offsets[-1]]] = True
    return np.flatnonzero(first)


#: Classes of bytes for fine units: 1 letters, 2 digits, 3 punctuation, 0 whatever may not be parted from its neighbours.
_CLASS = np.zeros(256, np.int8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x61:0x7B] = 1
_CLASS[0x27] = 0


def fine_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words cut further where letters, digits and punctuation meet; data is lower case.

    For tokenizers that drop white space, lower-case, and match runs of letters, digits and other characters apart.
    Apostrophes and bytes beyond ASCII stay with their neighbours, but for the Latin letters of lead byte C3.
    """
    starts, ends, _ = textscan.words(data, offsets)
    kind = _CLASS[data]
    if len(data) > 1:
        latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        kind[:-1][latin] = 1
        kind[1:][latin] = 1
    cuts = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)) + 1
    return np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))


class UnitCodec:
    """Ids of units, kept by 64-bit hash in sorted arrays: some 40 bytes a unit and 4 an id. Memory is bounded: beyond `most`
    units, or four ids for each of these, everything kept is forgotten. Two of k distinct units share a hash, and so get
    the same ids, with a probability of about k**2 / 2**65: 3e-8 for a million.

    fine=True is for tokenizers that drop white space, lower-case, and part letters, digits and other characters: their
    units are smaller and fewer are distinct. Such units of letters alone are one pre-token each, so many are encoded
    as one text and told apart by the tokens that end a word.
    """

    def __init__(self, path: str, most: int = 1_000_000, fine: bool = False):
        self.tokenizer, self.most, self.fine = load(path), most, fine
        self.special = [x.content.lower().encode() for x in self.tokenizer.get_added_tokens_decoder().values()]
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) if fine else None
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        if suffix:
            self.closes[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.keys, self.row = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.rows_used = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0
        self.at, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def _add(self, ids) -> int:
        n, k = len(ids), self.rows_used
        self.rows_used += 1
        while self.used + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if k >= len(self.at):
            self.at, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size))
        self.pool[self.used : self.used + n] = ids
        self.at[k], self.size[k] = self.used, n
        self.used += n
        return k

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each unit its row in at and size, and each text's first unit number (one more than texts)."""
        fine = self.fine
        if fine:
            low = textscan.LOWER[data]
            raw = low.tobytes()
            fine = not any(x in raw for x in self.special)  # their strings may not be cut or change case
        if fine:
            data = low
            starts, ends = fine_units(data, offsets)
        else:
            raw = data.tobytes()
            starts = unit_starts(data, offsets)
            ends = np.append(starts[1:], len(data))
        keys = textscan.span_hashes(data, starts, ends)
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.most or self.used > 4 * self.most:
            self._forget()
        place = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        inner = place < len(self.keys)
        known[inner] = self.keys[place[inner]] == distinct[inner]
        found = np.zeros(len(distinct), np.int64)
        found[known] = self.row[place[known]]
        missing = np.flatnonzero(~known)
        lost = where[missing]
        texts = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[lost].tolist(), ends[lost].tolist())]
        if len(texts):
            found[missing] = [self._add(x) for x in self._encoded(texts, fine)]
            self.keys = np.insert(self.keys, place[missing], distinct[missing])
            self.row = np.insert(self.row, place[missing], found[missing].astype(np.int32))
        return found[back], np.searchsorted(starts, offsets)

    def _encoded(self, texts: list[str], fine: bool) -> list:
        out: list = [None] * len(texts)
        together = [i for i, x in enumerate(texts) if x.isalpha()] if fine and self.closes.any() else []
        for low in range(0, len(together), 64):
            some = together[low : low + 64]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[i] for i in some])], add_special_tokens=False)[0].ids, np.int32)
            last = np.flatnonzero(self.closes[ids]) + 1
            if len(last) == len(some) and last[-1] == len(ids):
                for i, a, b in zip(some, [0, *last[:-1].tolist()], last.tolist()):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for low in range(0, len(rest), 4096):
            for i, got in zip(rest[low : low + 4096], self.tokenizer.encode_batch_fast([texts[i] for i in rest[low : low + 4096]], add_special_tokens=False)):
                out[i] = got.ids
        return out

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        rows, first = self.rows(data, offsets)
        sums = np.concatenate([[0], np.cumsum(self.size[rows], dtype=np.int64)])
        return sums[first[1:]] - sums[first[:-1]]

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and each text's first (one more than texts)."""
        rows, first = self.rows(data, offsets)
        size = self.size[rows].astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(size)])
        places = np.arange(sums[-1]) + np.repeat(self.at[rows] - sums[:-1], size)
        return self.pool[places], sums[first]
