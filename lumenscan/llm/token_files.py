"""Token ids of documents as Parquet files with delta-encoded list columns.

Format: ``part-NNNNN.parquet`` files, each a range of documents in ascending doc_id order, with columns doc_id (long,
delta encoded), n_tokens (int) and ids (list of int32, elements DELTA_BINARY_PACKED, zstd). Row groups hold about
``group_tokens`` ids, page indexes are written, so a reader can select documents by doc_id and skip pages, and read
metadata columns without ids. ``manifest`` rows (one a file) carry the file's first position and counts.

Encoding: a text is cut where the byte-level pre-tokenizer always cuts (a run of non-space with the one space before
it, or white space), every distinct unit is encoded once by the tokenizers library and remembered by the worker, in a
memory of at most ``memo`` units; ids of a text are the ids of its units. A text that has the string of a special
token is encoded whole.

Scale: one range shuffle on (doc_id, hash of the text, a number of the row below 64), so that neither rows of one repeated
id nor equal rows land in one task. A task
holds one row group at a time. Files are written under a name of the attempt and renamed, so a lost executor or a
second attempt leaves whole files only. Only manifest rows, one a file, come to the driver.

Edge cases: a null text counts as empty and has the end id only. Rows without doc_id come first. Rows of one doc_id are
ordered by hash and text. An empty table gives no file and no row. Very long texts are encoded whole. Other columns, whatever their names, are
not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm._common import fresh_dir, text_chunks
from lumenscan.llm.merges import AS_WRITTEN, Merges, plain

#: White space as Unicode has it (Python's own \s has four control characters more).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNITS = re.compile(rf" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Texts with none of these have only single spaces and line ends between units.
_OTHER = re.compile(rf"[{_SPACE}]".replace(" ", "", 1).replace(r"\t-\r", r"\t\x0b-\r"))
_RUNS, _EDGE = ("  ", "\n\n", " \n", "\n "), ("", " ", "\n")
END_ID = 0


@dataclass(frozen=True)
class TokenFileOptions:
    tokenizer: str
    #: Units remembered by a worker between batches.
    memo: int = 900_000
    #: Units longer than this are encoded but not remembered.
    memo_chars: int = 64
    group_tokens: int = 1 << 20
    page_bytes: int = 1 << 17
    level: int = 3


class _Units(dict):
    """unit -> little-endian uint32 ids; before is what stands before every unit. What's missing is encoded and remembered."""

    def __init__(self, encode: Callable[[str], bytes], tokenize: Callable, before: str, most: int):
        super().__init__()
        self.encode, self.tokenize, self.before, self.most = encode, tokenize, before, most
        self.mark = "".join(AS_WRITTEN[ord(c)] for c in before)

    def __missing__(self, unit: str) -> bytes:
        if unit.isalpha() and (unit.isascii() or max(unit) < "\u0250"):
            # one piece of letters: straight to the model
            written = unit if unit.isascii() else unit.encode().decode("latin-1").translate(AS_WRITTEN)
            out = array("I", [t.id for t in self.tokenize(self.mark + written)]).tobytes()
        elif unit[-1:] in (".", ",") and (bare := unit[:-1]).isalpha() and (bare.isascii() or max(bare) < "\u0250"):
            # what follows a run of letters is a piece of its own
            return self[bare] + self.encode(unit[-1])
        else:
            out = self.encode(self.before + unit)
        if len(unit) <= self.most:
            self[unit] = out
        return out


class UnitEncoder:
    """texts -> little-endian uint32 ids, by units; what is remembered is two dictionaries, of units at the start of a text or line and of units after a space."""

    def __init__(self, o: TokenFileOptions):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(o.tokenizer)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.o, self.marks = o, {c: self._encode(c) for c in ".,"}
        parts = (lambda x: self.marks.get(x) or self._encode(x)), self.tokenizer.model.tokenize
        self.first, self.spaced = _Units(*parts, "", o.memo_chars), _Units(*parts, " ", o.memo_chars)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _units(self, text: str) -> bytes:
        """Ids of any text, unit by unit."""
        return b"".join(self.spaced[u[1:]] if len(u) > 1 and u[0] == " " and not u[1].isspace() else self.first[u] for u in UNITS.findall(text))

    def _whole(self, text: str) -> bytes | None:
        """Ids of a text that isn't simply words between single spaces and line ends; None if it is."""
        if any(x in text for x in self.special):
            return self._encode(text)
        if text[:1] in _EDGE or text[-1] in _EDGE or any(x in text for x in _RUNS) or _OTHER.search(text):
            return self._units(text)
        return None

    def units(self, words: pa.Array, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units (2 * word, + 1 without the space before), and where in them those of each begin and how many they are."""
        listed = words.to_pylist()
        known = [self.first[listed[u >> 1]] if u & 1 and listed[u >> 1] else self.spaced[listed[u >> 1]] if listed[u >> 1] else b"" for u in units.tolist()]
        lengths = np.fromiter((len(x) // 4 for x in known), np.int64, len(known))
        return np.frombuffer(b"".join(known), "<u4"), np.cumsum(lengths) - lengths, lengths

    def batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, each followed by end if there is one, and where each text's begin, with the end.

        The words of all texts are split and told apart by Arrow, each distinct one is looked up once, and ids are
        gathered by offsets. Between single spaces and line ends, what a unit is depends on nothing around it."""
        if len(self.first) + len(self.spaced) > self.o.memo:
            self.first.clear(), self.spaced.clear()
        listed = texts.to_pylist()
        odd = {i: ids for i, t in enumerate(listed) if (ids := self._whole(t)) is not None}
        if odd:
            texts = pa.array(["" if i in odd else t for i, t in enumerate(listed)], pa.large_string())
        n = len(listed)
        rows = pc.split_pattern(texts.cast(pa.large_string()), "\n")
        text_of = np.repeat(np.arange(n), np.asarray(rows.value_lengths()))
        words = pc.split_pattern(rows.flatten(), " ")
        sizes = np.asarray(words.value_lengths())
        coded = words.flatten().dictionary_encode()
        word = np.asarray(coded.indices).astype(np.int64)
        starts = np.append(0, np.cumsum(sizes))[:-1]  # of lines, in words; no line is without a word
        leads = np.zeros(len(word), bool)
        leads[starts] = True
        # a unit is 2 * word, + 1 at the start of a line; then come the line end, the end and the odd texts
        unit = 2 * word + leads
        used = np.zeros(2 * len(coded.dictionary), bool)
        used[unit] = True
        ids, begins, lengths = self.units(coded.dictionary, np.flatnonzero(used))
        more = [np.frombuffer(x, "<u4") for x in (self.first["\n"], b"" if end is None else np.array([end], "<u4").tobytes(), *odd.values())]
        number = np.full(len(used) + len(more), -1)
        number[: len(used)][used] = np.arange(len(lengths))
        line_end, after, first_odd = len(used), len(used) + 1, len(used) + 2
        number[len(used) :] = np.arange(len(lengths), len(lengths) + len(more))
        of_more = np.array([len(x) for x in more])
        begins, lengths = np.append(begins, len(ids) + np.cumsum(of_more) - of_more), np.append(lengths, of_more)
        ids = np.concatenate([ids, *more])
        # line ends before all lines of a text but the first, the end after its last word
        broken = np.append(False, text_of[1:] == text_of[:-1])
        breaks, ends = np.cumsum(broken), text_of
        line_of = np.repeat(np.arange(len(sizes)), sizes)
        sequence = np.full(len(word) + int(breaks[-1] if n else 0) + n, after)
        sequence[np.arange(len(word)) + breaks[line_of] + ends[line_of]] = unit
        sequence[(starts + breaks + ends - 1)[broken]] = line_end
        last = np.append(np.flatnonzero(np.diff(text_of)), len(sizes) - 1)[:n] if n else np.empty(0, int)
        at_end = (starts + sizes + breaks + ends)[last]
        sequence[at_end] = after
        for k, i in enumerate(odd):
            sequence[at_end[i] - 1] = first_odd + k
        sequence = number[sequence]
        counts = lengths[sequence]
        before = np.append(0, np.cumsum(counts))
        flat = ids[np.repeat(begins[sequence] - before[:-1], counts) + np.arange(before[-1])]
        return flat, before[np.append(0, at_end + 1)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        flat, ends = self.batch(pa.array(texts, pa.large_string()))
        return [flat[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:])]


class MergeEncoder(UnitEncoder):
    """A UnitEncoder with the same ids that merges plain words itself, all of a batch at once, instead of asking the library for each and remembering it."""

    def __init__(self, o: TokenFileOptions):
        super().__init__(o)
        self.merges = Merges.of(o.tokenizer)

    def units(self, words: pa.Array, units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.merges is None:
            return super().units(words, units)
        word, own = units >> 1, plain(words)[units >> 1]
        ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"\0", np.uint8)
        mine = word[own]
        ids, at, n = self.merges.encode(data, ends[mine], ends[mine + 1] - ends[mine], units[own] & 1 == 0)
        of_rest = word[~own]  # 2 * place, + 1 without the space before
        others, at_others, n_others = super().units(words.take(pa.array(of_rest)), 2 * np.arange(len(of_rest)) + (units[~own] & 1))
        begins, lengths = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        begins[own], lengths[own] = at, n
        begins[~own], lengths[~own] = len(ids) + at_others, n_others
        return np.concatenate([ids, others]), begins, lengths


_encoders: dict[tuple[type, TokenFileOptions], UnitEncoder] = {}


def encoder(o: TokenFileOptions, kind: type[UnitEncoder] = UnitEncoder) -> UnitEncoder:
    """One a worker process, with what it remembers."""
    if (kind, o) not in _encoders:
        _encoders[kind, o] = kind(o)
    return _encoders[kind, o]


_SCHEMA = pa.schema([pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.int32()))])


class _File:
    """Writes one part file, row group by row group."""

    def __init__(self, root: str, name: str, o: TokenFileOptions):
        self.fs, path = pafs.FileSystem.from_uri(root)
        self.fs.create_dir(path, recursive=True)
        self.name, self.o = name, o
        self.to, self.temporary = f"{path}/{name}", f"{path}/_{uuid.uuid4().hex}"
        self.writer, self.rows, self.ids = None, 0, 0
        self.held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        self.n_held = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.held.append((doc_ids, ids, np.diff(ends)))
        self.n_held += len(ids)
        if self.n_held >= self.o.group_tokens:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        if self.writer is None:
            self.writer = pq.ParquetWriter(
                self.fs.open_output_stream(self.temporary), _SCHEMA, version="2.6", data_page_version="2.0", compression="zstd", compression_level=self.o.level, use_dictionary=False, write_page_index=True, data_page_size=self.o.page_bytes,
                column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED", "ids.list.element": "DELTA_BINARY_PACKED"},
            )
        lengths = np.concatenate([n for _, _, n in self.held])
        values = np.concatenate([ids for _, ids, _ in self.held]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lengths)), pa.int32()), pa.array(values))
        self.writer.write_table(pa.table([pa.chunked_array([d for d, _, _ in self.held]), pa.array(lengths), lists], schema=_SCHEMA), row_group_size=len(lengths))
        self.rows, self.ids = self.rows + len(lengths), self.ids + len(values)
        self.held, self.n_held = [], 0

    def close(self) -> None:
        self.flush()
        if self.writer is not None:
            self.writer.close()
            self.writer = None
            self.fs.move(self.temporary, self.to)


def write_token_files(docs: DataFrame, o: TokenFileOptions, root: str, text: str = "text", key: str = "doc_id", encode: Callable | None = None) -> list[dict]:
    """Writes files of docs under root; returns the manifest: file, part, rows, n_ids, start."""
    ordered = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("salt", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "salt", F.pmod(F.monotonically_increasing_id(), F.lit(64))).sortWithinPartitions("doc_id", "salt", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out, to_ids = _File(root, f"part-{part:05d}.parquet", o), encoder(o)
        for batch in batches:
            for b in text_chunks(batch, "text", 8 << 20):
                out.add(b.column("doc_id"), *to_ids.batch(b.column("text"), END_ID))
        out.close()
        if out.rows:
            yield pa.RecordBatch.from_pydict({"file": [out.name], "part": [part], "rows": [out.rows], "n_ids": [out.ids]})

    manifest = sorted((r.asDict() for r in ordered.mapInArrow(run, "file string, part long, rows long, n_ids long").collect()), key=lambda r: r["part"])
    start = 0
    for r in manifest:
        r["start"] = start
        start += r["n_ids"]
    return manifest


def read_token_files(spark, root: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; row groups are read one at a time."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    files = spark.createDataFrame([(r["file"], r["start"], r["n_ids"]) for r in manifest], "file string, start long, n_ids long").repartition(len(manifest), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                fs, path = pafs.FileSystem.from_uri(root)
                with fs.open_input_file(f"{path}/{name}") as f:
                    for t in pq.ParquetFile(f).iter_batches(batch_size=1024):
                        lists = t.column("ids")
                        offsets = np.asarray(lists.offsets).astype(np.int64)
                        ids = np.asarray(lists.values).astype("<u4")
                        lengths = np.diff(offsets)
                        begins = start + np.append(0, np.cumsum(lengths)[:-1])
                        start += int(lengths.sum())
                        crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
                        yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array(begins, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(run, schema)


def token_table(docs: DataFrame, o: TokenFileOptions) -> DataFrame:
    """Writes token files of docs into the shared folder and reads their digests back."""
    root = fresh_dir(docs.sparkSession, "tokens")
    return read_token_files(docs.sparkSession, root, write_token_files(docs, o, root))
