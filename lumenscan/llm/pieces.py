"""SentencePiece encoding and decoding by a Viterbi pass that common prefixes share.

A normalised text falls into marked words (a run of the space mark and what follows it), across which no piece of the
model reaches. The distinct words of a batch are sorted, which is a depth-first walk of their trie: the forward states
of the prefix a word has in common with the one before are kept, only the rest is computed.

The forward state of a position is the best segmentation of the prefix that ends there, by its last piece. For a
unigram model "best" is the greatest sum of scores. For a BPE model the segmentation that merging yields is wanted, not
the one of the greatest sum: a sequence of pieces is that of merging if and only if every two neighbours are what their
joint text merges to, so the state of a position is the one piece that may follow the state of where it begins. This
gives exactly the ids of the sentencepiece library (tests compare them); a plain sum of BPE scores would not.

One narrow pass; a worker remembers ``memo`` words. Edge cases: a null text has null ids, an empty one none. Characters
without a piece become byte pieces, or the unknown id where the model has no bytes. Whole texts, very long ones too, are read.
Repeated rows are encoded each on its own; an empty table gives no rows; null ids decode to a null text. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenscan.llm._common import text_chunks

MARK = "▁"
_WORDS = re.compile(rf"{MARK}*[^{MARK}]+|{MARK}+")
UNIGRAM, BPE = 1, 2


@dataclass(frozen=True)
class PieceOptions:
    model: str
    memo: int = 900_000
    memo_chars: int = 64
    #: Pairs of pieces whose merging is remembered.
    pairs: int = 1_000_000


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        v = shift = 0
        while True:
            c = b[at]
            at += 1
            v |= (c & 127) << shift
            if c < 128:
                return v
            shift += 7

    while at < len(b):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, b[at : at + n]
            at += n


class Model:
    """Pieces, scores and rules of a model file."""

    def __init__(self, path: str | None = None, proto: bytes | None = None):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path) if proto is None else sentencepiece.SentencePieceProcessor(model_proto=proto)
        sp, n = self.library, self.library.get_piece_size()
        spec = dict(_fields(dict(_fields(sp.serialized_model_proto()))[2]))
        self.kind = spec.get(3, UNIGRAM)
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in normal}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        #: Every end of a piece: what isn't one can't be the end of a longer piece.
        self.ends = {p[i:] for p in self.ids for i in range(len(p))}
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.least = min(self.score.values(), default=0.0) - 10.0
        self.raw: list[bytes] = [b""] * n
        for p, i in self.ids.items():
            self.raw[i] = p.encode()
        for v, i in self.bytes.items():
            self.raw[i] = bytes([v])
        self.raw[self.unknown] = " ⁇ ".encode()
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece of this model reaches across words")

    def normalised(self, text: str) -> str:
        return self.library.normalize(text)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the mark put before the first word."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


class Encoder(dict):
    """marked word -> little-endian uint32 ids; the dictionary is what is remembered."""

    def __init__(self, model: Model, o: PieceOptions):
        super().__init__()
        self.model, self.o = model, o
        self.follows: dict[tuple[str, str], bool] = {}

    # segmentation

    def _merged(self, text: str) -> list[str]:
        """What merging makes of a short text, one merge at a time: the definition."""
        parts, score = list(text), self.model.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: str, b: str) -> bool:
        if (v := self.follows.get((a, b))) is None:
            if len(self.follows) > self.o.pairs:
                self.follows.clear()
            v = self.follows[a, b] = self._merged(a + b) == ([a, b] if a else [b])
        return v

    def _extend_bpe(self, word: str, end: int, states: list) -> None:
        """Appends the state of word[:end]: (start, last piece)."""
        ids, ends, follows = self.model.ids, self.model.ends, self.follows
        fits = []
        for start in range(end - 1, -1, -1):
            piece = word[start:end]
            if piece in ids or start == end - 1:
                fits.append((start, piece))
            if piece not in ends:
                break
        while fits:
            start, piece = state = fits.pop()
            before = states[start]
            if before is not None:
                pair = (before[1], piece)
                if (v := follows.get(pair)) is None:
                    v = self._may_follow(*pair)
                if v:
                    states.append(state)
                    return
        states.append(None)

    def _extend_unigram(self, word: str, end: int, states: list) -> None:
        """Appends the state of word[:end]: (start, last piece, score)."""
        best, score = None, self.model.score
        for start in range(max(0, end - self.model.longest), end):
            piece = word[start:end]
            s = score.get(piece)
            if s is None and end - start == 1:
                s = self.model.least
            if s is not None and (best is None or states[start][2] + s > best[2]):
                best = (start, piece, states[start][2] + s)
        states.append(best)

    def learn(self, words: list[str]) -> None:
        """Segments words in sorted order, depth first through their trie."""
        extend = self._extend_bpe if self.model.kind == BPE else self._extend_unigram
        states: list = [(0, "", 0.0)]
        last = ""
        for word in sorted(words):
            same, most = 0, min(len(last), len(word), len(states) - 1)
            while same < most and last[same] == word[same]:
                same += 1
            del states[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                extend(word, end, states)
            last = word
            parts, at = [], len(word)
            while at:
                state = states[at]
                parts.append(state[1])
                at = state[0]
            self[word] = self._as_ids(parts[::-1])

    def _as_ids(self, parts: list[str]) -> bytes:
        m, out = self.model, []
        for p in parts:
            i = m.ids.get(p)
            if i is not None:
                out.append(i)
            elif m.bytes:
                out += [m.bytes[v] for v in p.encode()]
            elif not out or out[-1] != m.unknown or m.kind == BPE:
                out.append(m.unknown)
        return np.array(out, dtype="<u4").tobytes()

    def __call__(self, texts: list[str | None], normalised: bool = False) -> list[bytes | None]:
        words = [_WORDS.findall(t if normalised else self.model.normalised(t)) if t else [] for t in texts]
        if len(self) > self.o.memo:
            self.clear()
        missing = set().union(*words) - self.keys()
        self.learn(list(missing))
        out = [None if t is None else b"".join(map(self.__getitem__, ws)) for t, ws in zip(texts, words)]
        for w in missing:
            if len(w) > self.o.memo_chars:
                del self[w]
        return out


_encoders: dict[PieceOptions, Encoder] = {}


def encoder(o: PieceOptions) -> Encoder:
    """One a worker process, with what it remembers."""
    if o not in _encoders:
        _encoders[o] = Encoder(Model(o.model), o)
    return _encoders[o]


def encode_documents(docs: DataFrame, o: PieceOptions, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id and ids (list of int) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(o)
        for batch in batches:
            for b in text_chunks(batch, "text", 4 << 20):
                ids = to_ids(b.column("text").to_pylist())
                offsets = np.append(0, np.cumsum([len(x) // 4 if x is not None else 0 for x in ids]))
                values = np.frombuffer(b"".join(x for x in ids if x is not None), "<u4").astype(np.int32)
                mask = pa.array([x is None for x in ids], pa.bool_())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values), mask=mask)], names=["doc_id", "ids"])

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, o: PieceOptions) -> DataFrame:
    """doc_id and text of doc_id, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(o).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else model.decode(x) for x in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.mapInArrow(run, "doc_id long, text string")


def piece_table(docs: DataFrame, o: PieceOptions, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, ids_crc32 and whether the ids decode to the normalised text; null for a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder(o)
        model = to_ids.model
        for batch in batches:
            for b in text_chunks(batch, "text", 2 << 20):
                texts = b.column("text").to_pylist()
                texts = [None if t is None else model.normalised(t) if t else "" for t in texts]
                ids = to_ids(texts, True)
                back = [None if x is None else model.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                want = [None if t is None else t.replace(MARK, " ") for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64()),
                        pa.array([None if x is None else zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([None if t is None else x == (t[1:] if t.startswith(" ") else t) for x, t in zip(back, want)], pa.bool_()),
                    ],
                    names=["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    return docs.selectExpr(f"cast(`{key}` as long) doc_id", f"`{text}` text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")
