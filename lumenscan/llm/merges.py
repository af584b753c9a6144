"""Byte-pair merges of many words at once, in arrays.

The merges and the vocabulary are read from the file of a byte-level tokenizer. Words are rows of a matrix of tokens; in
each round, the pair of lowest rank (the leftmost of equals) of every row is merged, as the library does word by word. A
row without a pair that can be merged is done. The ids are the library's own.

Taken are words of printable ASCII but the apostrophe, and of Latin letters, of at most ``LONGEST`` bytes. The
pre-tokenizer cuts such a word where letters, digits and other characters meet; of(), which looks at all merges, gives
None unless none of them reaches over such a place, and for files with anything else that would change ids.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The characters by which byte-level models write bytes.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_WRITTEN = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINTABLE)}
#: Words that are merged here: every character of theirs but ASCII ones is a letter.
PLAIN = r"^[!-&(-~\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}]+$"
LONGEST = 48
#: Bytes that may stand in such a word, with the space before it; others can't make a pair there.
_PART = re.compile(rb"[\x80-\xbf]? ?(?:[!-&(-~]|\xc2(?:[\xaa\xb5\xba]|$)|[\xc3-\xc9](?:[\x80-\xbf]|$))*")
_ROWS = 8_192
_NONE = np.int32(1 << 30)
_EMPTY = np.uint64((1 << 64) - 1)


def _kind(byte: int) -> str:
    c = chr(byte)
    return "letter" if c.isascii() and c.isalpha() or byte >= 0x80 else "digit" if c.isdigit() else "other"


class Merges:
    def __init__(self, vocab: dict[str, int], pairs: list[tuple[str, str]]):
        self.of_byte = np.array([vocab[AS_WRITTEN[b]] for b in range(256)], np.int32)
        self.n = max(vocab.values()) + 2  # the last one is no token: it fills rows up
        self.to = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([vocab[a] * self.n + vocab[b] for a, b in pairs], np.uint64)
        ranks, factor = np.arange(len(pairs), dtype=np.int32), 0x9E3779B97F4A7C15
        bits = max(8, (4 * len(pairs)).bit_length())
        #: Tables of keys and ranks; what found its slot taken is in the next one.
        self.shift, self.tables = np.uint64(64 - bits), []
        while len(keys) or not self.tables:
            slots, first = np.unique((keys * np.uint64(factor)) >> self.shift, return_index=True)
            table, rank = np.full(1 << bits, _EMPTY), np.full(1 << bits, _NONE)
            table[slots], rank[slots] = keys[first], ranks[first]
            self.tables.append((np.uint64(factor), table, rank))
            keys, ranks, factor = np.delete(keys, first), np.delete(ranks, first), factor * 0xD1342543DE82EF95 % (1 << 64) | 1

    @classmethod
    def of(cls, path: str) -> Merges | None:
        """The merges of a tokenizer file; None where words must be left to the library."""
        with open(path, encoding="utf-8") as f:
            all_ = json.load(f)
        m, plain = all_["model"], {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if m.get("type") != "BPE" or all_.get("normalizer") or plain.items() - (all_.get("pre_tokenizer") or {}).items() or any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        byte = {c: b for b, c in AS_WRITTEN.items()}
        pairs = [tuple(p.split(" ")) if isinstance(p, str) else tuple(p) for p in m["merges"]]
        if any(c not in m["vocab"] for c in AS_WRITTEN.values()):
            return None
        for a, b in pairs:
            if a[-1] != AS_WRITTEN[0x20] and _kind(byte[a[-1]]) != _kind(byte[b[0]]) and _PART.fullmatch(bytes(byte[c] for c in a + b)):
                return None
        return cls(m["vocab"], pairs)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair, _NONE without one."""
        return self._found((a.astype(np.uint64) * np.uint64(self.n) + b.astype(np.uint64)).ravel(), 0).reshape(a.shape)

    def _found(self, keys: np.ndarray, level: int) -> np.ndarray:
        factor, table, rank = self.tables[level]
        slots = ((keys * factor) >> self.shift).astype(np.int64)
        there = table[slots]
        miss = there != keys
        out = rank[slots]
        out[miss] = _NONE
        if level + 1 < len(self.tables):
            more = np.flatnonzero(miss & (there != _EMPTY))
            if len(more):
                out[more] = self._found(keys[more], level + 1)
        return out

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words are data[starts : starts + sizes], with a space before where spaced. Returned are ids, and where in them those of each word begin and how many they are."""
        width = sizes + spaced
        order = np.argsort(width, kind="stable")
        ids, at, done = [], np.zeros(len(sizes), np.int64), 0
        count = np.zeros(len(sizes), np.int64)
        for i in range(0, len(order), _ROWS):
            rows = order[i : i + _ROWS]
            left = width[rows]
            w = int(left[-1])
            column = np.arange(w)
            tokens = self.of_byte[data[np.minimum((starts[rows] - spaced[rows])[:, None] + column, len(data) - 1)]]
            tokens[spaced[rows], 0] = self.of_byte[0x20]
            tokens[column >= left[:, None]] = self.n - 1
            ranks = self._ranks(tokens[:, :-1], tokens[:, 1:])
            while len(rows):
                w = tokens.shape[1]
                if w > 1:
                    p = ranks.argmin(1)
                    r = ranks[np.arange(len(rows)), p]
                    over = r == _NONE
                else:
                    over = np.ones(len(rows), bool)
                if over.any():
                    ended, n = rows[over], left[over]
                    ids.append(tokens[over][np.arange(w) < n[:, None]])
                    count[ended] = n
                    at[ended] = done + np.cumsum(n) - n
                    done += len(ids[-1])
                    if len(ended) == len(rows):
                        break
                    go = ~over
                    rows, left, tokens, ranks, p, r = rows[go], left[go], tokens[go], ranks[go], p[go], r[go]
                # every row loses one token
                line = np.arange(len(rows))
                keep = np.ones(tokens.shape, bool)
                keep[line, p + 1] = False
                tokens = tokens[keep].reshape(len(rows), w - 1)
                new = self.to[r]
                tokens[line, p] = new
                keep = np.ones(ranks.shape, bool)
                keep[line, p] = False
                ranks = ranks[keep].reshape(len(rows), w - 2)
                left = left - 1
                x = np.flatnonzero(p > 0)
                y = np.flatnonzero(p < w - 2)
                changed = self._ranks(np.concatenate([tokens[x, p[x] - 1], new[y]]), np.concatenate([new[x], tokens[y, p[y] + 1]]))
                ranks[x, p[x] - 1] = changed[: len(x)]
                ranks[y, p[y]] = changed[len(x) :]
        return np.concatenate(ids).astype(np.uint32) if ids else np.empty(0, np.uint32), at, count


def plain(words: pa.Array) -> np.ndarray:
    """Which words are merged here."""
    fits = pc.and_(pc.match_substring_regex(words, PLAIN), pc.less_equal(pc.binary_length(words), LONGEST))
    return np.asarray(fits)
