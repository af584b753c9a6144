"""Best-fit packing of token ids of documents into bins of a fixed number of tokens, with conflicts.

Items go, longest first, into the bin of the least sufficient residual. Bins are ordered by residual; each residual has
the bitmap of its bins, each source and each duplicate cluster the bitmap of the bins that carry it. An item may share
no bin with one of its source or of its cluster. The successor search goes from the least sufficient residual upward
(per source, the number of its bins at every residual is kept, so residuals without a free bin are passed over at once)
until a residual has a compatible bin; the oldest such bin is taken; with none, a new bin is opened.

Documents are encoded with the byte-level tokenizer of token_files (plain words by arrays of merges, with the same ids)
and get its end id. One longer than a bin is cut into
pieces: full ones fill bins of their own, the rest is packed. The result are the bins themselves: the ids of each, in two
little-endian bytes (four for vocabularies over 65,536), and the pieces (document, number, offset in the document, offset
in the bin) that it holds.

The duplicate cluster of a document is column ``cluster`` where the caller names one (a component of near-duplicates,
say); else documents whose words are equal but for case are a cluster.

Scale: items are spread over shards of about ``shard_items`` by a hash of document, piece and place in the input, so a hot
source or cluster, or rows of one repeated id, are spread evenly and conflicts across shards can't happen. A shard is one
sorted stream; where one has 2 * ``shard_items`` items, what follows counts as the next shard, so a task's memory is that
of so many bins. The number of shards comes from the rows and bytes of the input; texts are encoded once and their ids
moved once. Nothing is collected or broadcast.

Edge cases: a null or empty text is one end id. A null source or cluster conflicts with nothing. Ties of length are
ordered by doc_id and piece. Repeated rows are items of their own, and conflict as copies. An empty table gives no bins.
Very long texts are packed whole. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.llm import token_files
from lumenscan.llm._common import text_chunks


@dataclass(frozen=True)
class PackingOptions:
    #: Path of a byte-level tokenizer file.
    tokenizer: str
    capacity: int = 2_048
    shard_items: int = 4_096
    #: Units of text, of those that the library encodes, a worker remembers, and bytes of text it encodes at once: more of either takes less time and more memory.
    memo: int = 600_000
    slice_bytes: int = 4 << 20


class BestFit:
    """Bins of one shard."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.fill: list[int] = []
        self.carried: list[list] = []
        #: Number and bitmap of the bins at each residual.
        self.total = np.zeros(capacity + 1, np.int32)
        self.at: dict[int, int] = {}
        #: By source: bitmap of its bins, and their number at each residual. By cluster: bitmap.
        self.of_source: dict[object, int] = {}
        self.count: dict[object, np.ndarray] = {}
        self.of_cluster: dict[object, int] = {}

    def _find(self, need: int, source: object, cluster: object) -> int | None:
        free = self.total[need:] if source not in self.count else self.total[need:] - self.count[source][need:]
        taken = self.of_source.get(source, 0) | self.of_cluster.get(cluster, 0)
        for r in np.flatnonzero(free):
            if bins := self.at[need + int(r)] & ~taken:
                return (bins & -bins).bit_length() - 1
        return None

    def add(self, length: int, source: object, cluster: object) -> tuple[int, int]:
        """Bin and offset of an item; None as source or cluster conflicts with nothing."""
        b = self._find(length, source, cluster) if length < self.capacity else None
        if b is None:
            b = len(self.fill)
            self.fill.append(0)
            self.carried.append([])
        else:
            self._move(b, -1)
        offset = self.fill[b]
        self.fill[b] += length
        if source is not None:
            self.carried[b].append(source)
            self.of_source[source] = self.of_source.get(source, 0) | 1 << b
            if source not in self.count:
                self.count[source] = np.zeros(self.capacity + 1, np.int32)
        if cluster is not None:
            self.of_cluster[cluster] = self.of_cluster.get(cluster, 0) | 1 << b
        self._move(b, 1)
        return b, offset

    def _move(self, b: int, by: int) -> None:
        r = self.capacity - self.fill[b]
        if r:
            self.at[r] = self.at.get(r, 0) ^ 1 << b
            self.total[r] += by
            for s in self.carried[b]:
                self.count[s][r] += by


def copies(texts: pa.Array) -> list[int | None]:
    """A hash of the words of each text in lower case, None without words."""
    words = [" ".join(t.lower().split()) for t in texts.to_pylist()]
    return [xxhash.xxh3_64_intdigest(w) - (1 << 63) if w else None for w in words]


_ITEMS = {"doc_id": pa.int64(), "piece": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "source": pa.string(), "cluster": pa.int64(), "salt": pa.int64(), "ids": pa.binary()}


def encoder(o: PackingOptions) -> token_files.UnitEncoder:
    """The worker's encoder."""
    return token_files.encoder(token_files.TokenFileOptions(o.tokenizer, memo=o.memo), token_files.MergeEncoder)


def items(docs: DataFrame, o: PackingOptions, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, source, cluster, salt (place in the input) and ids of every piece."""
    c = lambda name: F.col(f"`{name}`")
    narrow = docs.select(c(key).cast("long").alias("doc_id"), F.coalesce(c(text), F.lit("")).alias("text"), c(source).cast("string").alias("source"), (c(cluster).cast("long") if cluster else F.lit(None).cast("long")).alias("cluster"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, seen = encoder(o), 0
        size = 2 if to_ids.tokenizer.get_vocab_size() <= 1 << 16 else 4
        for batch in batches:
            for b in text_chunks(batch, "text", o.slice_bytes):
                ids, at = to_ids.batch(b.column("text"), token_files.END_ID)
                lengths = np.diff(at)
                n_pieces = -(-lengths // o.capacity)
                owner = np.repeat(np.arange(b.num_rows), n_pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
                start = piece * o.capacity
                n = np.minimum(lengths[owner] - start, o.capacity)
                flat = ids.astype(f"<u{size}")
                ends = np.append(0, np.cumsum(n * size)).astype(np.int32)  # pieces of a document follow each other
                of = b.column("cluster") if cluster else pa.array(copies(b.column("text")), pa.int64())
                take = lambda col: col.take(pa.array(owner))
                columns = [take(b.column("doc_id")), pa.array(piece), pa.array(start), pa.array(n), take(b.column("source")), take(of), pa.array((seen + owner) // 65_536), pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(ends), pa.py_buffer(flat)])]
                seen += b.num_rows
                yield pa.RecordBatch.from_arrays(columns, names=list(_ITEMS))

    return narrow.mapInArrow(run, "doc_id long, piece long, start long, n_tokens long, source string, cluster long, salt long, ids binary")


_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("bin_start", pa.int64())])


class _Bins:
    """The bins of one shard with what they hold."""

    def __init__(self, first: int, o: PackingOptions):
        self.fit, self.first, self.n = BestFit(o.capacity), first, 0
        self.held: list[list[tuple[dict, bytes]]] = []

    def add(self, doc_id, piece, start, n_tokens, source, cluster, ids: bytes) -> None:
        at, offset = self.fit.add(n_tokens, source, cluster)
        if at == len(self.held):
            self.held.append([])
        self.held[at].append(({"doc_id": doc_id, "piece": piece, "start": start, "n_tokens": n_tokens, "bin_start": offset}, ids))
        self.n += 1

    def batches(self) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(self.held), 512):
            part = self.held[i : i + 512]
            sizes = [sum(p["n_tokens"] for p, _ in held) for held in part]
            columns = [pa.array(range(self.first + i, self.first + i + len(part)), pa.int64()), pa.array(sizes, pa.int64()), pa.array([b"".join(x for _, x in held) for held in part], pa.binary()), pa.array([[p for p, _ in held] for held in part], pa.list_(_PIECE))]
            yield pa.RecordBatch.from_arrays(columns, names=["bin", "n_tokens", "ids", "pieces"])


def pack_items(rows: DataFrame, o: PackingOptions, shards: int) -> DataFrame:
    """bin (unique over all shards), n_tokens, ids and pieces of every bin of the rows of items()."""
    order = ["shard", F.desc("n_tokens"), "doc_id", "piece", "source", "cluster", "salt"]
    # a task takes eight shards at most, however large the input
    tasks = max(min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), -(-shards // 8))
    spread = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "salt"), F.lit(shards))).repartition(tasks, "shard").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for b in batches:
            for shard, *item in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "piece", "start", "n_tokens", "source", "cluster", "ids"))):
                if shard != now or bins.n == 2 * o.shard_items:
                    if bins is not None:
                        yield from bins.batches()
                    bins = _Bins((shard << 32) if shard != now else bins.first + len(bins.held), o)
                    now = shard
                bins.add(*item)
        if bins is not None:
            yield from bins.batches()

    return spread.mapInArrow(run, "bin long, n_tokens long, ids binary, pieces array<struct<doc_id:long,piece:long,start:long,n_tokens:long,bin_start:long>>")


def pack_documents(docs: DataFrame, o: PackingOptions, text: str = "text", key: str = "doc_id", source: str = "source", cluster: str | None = None) -> DataFrame:
    """bin, n_tokens, ids and pieces of the bins of all documents."""
    size = docs.agg(F.count("*").alias("rows"), F.sum(F.octet_length(F.col(f"`{text}`"))).alias("bytes")).first()
    expected = size["rows"] + (size["bytes"] or 0) // (3 * o.capacity)  # a token is about three bytes
    return pack_items(items(docs, o, text, key, source, cluster), o, max(1, -(-expected // o.shard_items)))


def piece_table(bins: DataFrame) -> DataFrame:
    """bin, bin_start, doc_id, piece, start, n_tokens and ids_crc32 (of the piece's ids as little-endian 32-bit integers) of every piece, read from the bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_chunks(whole, "ids", 4 << 20):
                held = b.column("pieces")
                p = {c: np.asarray(held.flatten().field(c)) for c in ("piece", "start", "n_tokens", "bin_start")}
                owner = np.repeat(np.arange(b.num_rows), np.asarray(held.value_lengths()))
                totals = b.column("n_tokens").to_pylist()
                ids = [np.frombuffer(x, f"<u{len(x) // n}").astype("<u4") for x, n in zip(b.column("ids").to_pylist(), totals)]
                crc = [zlib.crc32(ids[i][a : a + n]) for i, a, n in zip(owner.tolist(), p["bin_start"].tolist(), p["n_tokens"].tolist())]
                columns = [b.column("bin").take(pa.array(owner)), pa.array(p["bin_start"]), held.flatten().field("doc_id"), *(pa.array(p[c]) for c in ("piece", "start", "n_tokens")), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["bin", "bin_start", "doc_id", "piece", "start", "n_tokens", "ids_crc32"])

    return bins.select("bin", "n_tokens", "ids", "pieces").mapInArrow(run, "bin long, bin_start long, doc_id long, piece long, start long, n_tokens long, ids_crc32 long")
