"""Token ids of whole texts by a public tokenizer file, with a cache by word.

The tokenizer's pre-tokenisation never joins characters across white space, so a
text's ids are those of its words in order, and plain words fall apart into runs of
letters, digits and other characters. These units are hashed in numpy; ids of units
that were seen before come from a sorted table, the others from the library. Words in
which the file's added tokens may stand, such as ``<|endoftext|>``, go to the library whole
and as they are written; it gives an added token's own id wherever its string stands.
"""

from __future__ import annotations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from . import textkit as tk

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Words that the cache keeps; beyond that it starts anew.
CACHE_WORDS = 2_000_000

# Kinds of bytes: white space 0, letters 1 (those of two bytes from C3 too), digits 2, others 3.
_KIND = np.full(256, 3, np.uint8)
_KIND[tk.SPACE] = 0
_KIND[48:58] = 2
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
#: Bytes that make a word odd: an apostrophe, controls, and what is beyond letters of the form C3 xx.
_ODD = np.zeros(256, bool)
_ODD[[0x27, 0x7F, *range(0x20), *range(0x80, 0x100)]] = True
_ODD[tk.SPACE] = False

_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_rest = [b for b in range(256) if b not in _printable]
#: The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256.
_ALPHABET = {b: 256 + i for i, b in enumerate(_rest)}


def _added(data: np.ndarray) -> np.ndarray:
    """Where ``<|`` stands, with which the added tokens begin."""
    out = np.zeros(len(data), bool)
    out[:-1] = (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    return out


class WordEncoder:
    """Encodes Arrow texts: ``encode(data, offs)`` gives all ids as uint32 and each text's first position (one more at the end)."""

    def __init__(self, name: str = VOCABULARY, keep: int = CACHE_WORDS):
        self.tok = Tokenizer.from_file(public_tokenizers.path(name))
        if not all(t.content.startswith("<|") and not t.normalized for t in self.tok.get_added_tokens_decoder().values()):
            raise ValueError(f"{name} has added tokens of another kind")
        self.model = self.tok.model
        self.keep = keep
        self._clear()

    def _clear(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def unit(self, w: bytes, odd: bool) -> list[int]:
        """Ids of a run of letters, a digit or a run of other characters by the library's model; an odd word goes through its whole pipeline."""
        s = w.decode("utf-8", "replace")
        if odd:
            return self.tok.encode(s, add_special_tokens=False).ids
        if not s.isascii():
            s = s.lower().encode().decode("latin-1").translate(_ALPHABET)
        return [t.id for t in self.model.tokenize(s)]

    def units(self, data: np.ndarray, offs: np.ndarray):
        """Starts, ends and oddness of the units, and each text's first unit. Words without odd bytes are split where the pattern of the file splits them."""
        s, e, _ = tk.words(data, offs)
        odd = _ODD[data]
        lead = data == 0xC3
        odd &= ~lead
        after = np.zeros(len(data), bool)
        after[1:] = lead[:-1]
        odd &= ~(after & (data != 0x97) & (data != 0xB7))
        odd |= _added(data)
        seen = np.concatenate([[0], np.cumsum(odd)])
        odd_word = seen[e] > seen[s]
        kind = _KIND[data]
        start = np.zeros(len(data), bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= kind == 2
        start &= kind > 0
        start[s] = True
        u = np.flatnonzero(start)
        w = np.searchsorted(s, u, "right") - 1
        keep = ~odd_word[w] | (u == s[w])
        u, w = u[keep], w[keep]
        end = e[w]
        inner = w[1:] == w[:-1]
        end[:-1][inner] = u[1:][inner]
        return u, end, odd_word[w], np.searchsorted(u, offs)

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s, e, odd, first = self.units(data, offs)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        # Letters fold before normalisation only where nothing combines with them and no added token may stand.
        fold = not ((data == 0xCC) | (data == 0xCD) | _added(data)).any()
        h = tk.span_hashes(data, s, e, tk.BYTE_LOWER if fold else tk.BYTE)  # without folding, plain units keep their case in the key only
        keys, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.key, keys)
        known = np.zeros(len(keys), bool)
        inside = pos < len(self.key)
        known[inside] = self.key[pos[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            if len(self.key) + len(new) > self.keep and len(self.key):
                self._clear()
                new = np.arange(len(keys))
            ids: list[int] = []
            sizes = np.empty(len(new), np.int32)
            for j, k in enumerate(new):
                w = data[s[where[k]] : e[where[k]]].tobytes()
                got = self.unit(w.lower() if fold or not odd[where[k]] else w, odd[where[k]])
                sizes[j] = len(got)
                ids += got
            at = len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes
            self.pool = np.concatenate([self.pool, np.array(ids, np.uint32)])
            slot = np.searchsorted(self.key, keys[new])
            self.key = np.insert(self.key, slot, keys[new])
            self.at = np.insert(self.at, slot, at)
            self.size = np.insert(self.size, slot, sizes)
            pos = np.searchsorted(self.key, keys)
        count = self.size[pos][inverse].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(count)])
        out = self.pool[np.arange(begin[-1]) + np.repeat(self.at[pos][inverse] - begin[:-1], count)]
        return out, begin[first]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(name: str = VOCABULARY) -> WordEncoder:
    """One encoder for each Python worker."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(name)
    return _ENCODERS[name]


def encode_with_end(data: np.ndarray, offs: np.ndarray, name: str = VOCABULARY, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Ids with ``end_id`` after each text, as little-endian uint32, and each text's first position."""
    ids, first = encoder(name).encode(data, offs)
    n = len(offs) - 1
    out = np.full(len(ids) + n, end_id, "<u4")
    size = np.diff(first)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), size)] = ids
    return out, first + np.arange(n + 1)
