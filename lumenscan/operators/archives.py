"""Archives in a tree: kinds by first bytes, members to a depth of 4, their texts, and a ledger of what wasn't read.

One narrow Arrow pass over file contents; sizes are bounded: MEMBER bytes of a member, ARCHIVE bytes of all of one
archive's members. What is over a bound, encrypted, broken or packed in another way is told in the ledger, not guessed at.
"""

from __future__ import annotations

import bz2
import io
import lzma
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.sources.tree import decoded

DEPTH, MEMBER, ARCHIVE = 4, 16 << 20, 64 << 20
#: Zip methods that are read: stored, deflated, bzip2, LZMA.
METHODS = {0, 8, 12, 14}
c, lit = F.col, F.lit


def kind_of(head: bytes, tail: bytes = b"") -> str | None:
    """zip, gzip, bzip2, xz, lzma, tar, or zip behind other bytes (its end record lies in tail)."""
    starts = [(b"PK\3\4", "zip"), (b"PK\5\6", "zip"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz"), (b"\x5d\0\0", "lzma")]
    found = next((kind for magic, kind in starts if head.startswith(magic)), None)
    if found is None and head[257:262] == b"ustar":
        found = "tar"
    return found or ("zip" if b"PK\5\6" in tail else None)


def archive_kind(content: Column) -> Column:
    """kind_of as SQL, by the first bytes, and for zip behind other bytes the last 64 KiB."""
    head = F.hex(F.substring(content, 1, 8))
    kinds = F.when(head.startswith("504B0304") | head.startswith("504B0506"), "zip").when(head.startswith("1F8B"), "gzip").when(head.startswith("425A68"), "bzip2").when(head.startswith("FD377A585A00"), "xz").when(head.startswith("5D0000"), "lzma")
    return kinds.when(F.substring(content, 258, 5) == F.encode(lit("ustar"), "UTF-8"), "tar").when(F.contains(F.right(F.hex(content), lit(2 * 65_557)), lit("504B0506")), "zip")


def unpacked(data: bytes, kind: str, most: int = MEMBER) -> tuple[bytes, bool]:
    """At most `most` bytes of compressed data of one or more streams, and whether that is all."""
    new = {"gzip": lambda: zlib.decompressobj(31), "bzip2": bz2.BZ2Decompressor, "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ), "lzma": lambda: lzma.LZMADecompressor(lzma.FORMAT_ALONE)}[kind]
    out = bytearray()
    while data:
        d = new()
        try:
            out += d.decompress(data, most + 1 - len(out))
        except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
            return bytes(out[:most]), False
        if len(out) > most or not d.eof:
            return bytes(out[:most]), False
        data = d.unused_data.lstrip(b"\0")
    return bytes(out), True


def members(data: bytes, kind: str) -> Iterator[tuple[str, bytes | None, bool]]:
    """(name, bytes or None, whole) of every member of one archive; a member that can't be read has no bytes."""
    if kind not in ("zip", "tar"):
        body, whole = unpacked(data, kind)
        yield "", body, whole
        return
    try:
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        if i.compress_type not in METHODS or i.flag_bits & 1:
                            yield i.filename, None, False
                            continue
                        try:
                            with z.open(i) as f:
                                body = f.read(MEMBER + 1)
                            yield i.filename, body[:MEMBER], len(body) <= MEMBER
                        except (zipfile.BadZipFile, zlib.error, OSError, EOFError, lzma.LZMAError, NotImplementedError, RuntimeError):
                            yield i.filename, None, False
        else:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
                for m in t:
                    if m.isfile():
                        body = t.extractfile(m).read(MEMBER + 1)
                        yield m.name, body[:MEMBER], len(body) <= MEMBER
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, RuntimeError, NotImplementedError):
        yield "", None, False


def walked(data: bytes, kind: str) -> tuple[list[tuple[str, bytes]], str]:
    """(path of names joined by !, bytes) of all members that are no archives, to DEPTH, and the outcome: read, not_fully_read or not_opened."""
    out, budget, whole, opened = [], ARCHIVE, True, False
    stack = [("", data, kind, 1)]
    while stack:
        path, body, k, depth = stack.pop()
        for name, inner, complete in members(body, k):
            whole = whole and complete
            if inner is None:
                continue
            opened = True
            budget -= len(inner)
            if budget < 0:
                return out, "not_fully_read"
            inner_kind = kind_of(inner[:512], inner[-65_557:])
            at = f"{path}!{name}" if name else path
            if inner_kind is None:
                out.append((at, inner))
            elif depth < DEPTH:
                stack.append((at, inner, inner_kind, depth + 1))
            else:
                whole = False
    return out, "not_opened" if not opened else "read" if whole else "not_fully_read"


def archive_members(files: DataFrame) -> DataFrame:
    """rel, path, size, text, outcome of the members of every archive of files(rel, content); the row without a path is the archive's own, with its outcome.

    outcome: read, not_fully_read, not_opened, read_nothing (no member held anything)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rel, content, kind in zip(*(b.column(x).to_pylist() for x in ("rel", "content", "kind"))):
                found, outcome = walked(content, kind)
                if outcome == "read" and not any(body for _, body in found):
                    outcome = "read_nothing"
                rows = [(rel, path, len(body), decoded(body), None) for path, body in found] + [(rel, None, len(content), None, outcome)]
                for i in range(0, len(rows), 64):
                    cols = list(zip(*rows[i : i + 64]))
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["rel", "path", "size", "text", "outcome"])

    k = files.where("content is not null").select("rel", "content", archive_kind(c("content")).alias("kind")).where("kind is not null")
    return k.mapInArrow(run, "rel string, path string, size long, text string, outcome string")


def outcomes(members_: DataFrame) -> DataFrame:
    """The ledger: rel, outcome of every archive."""
    return members_.where("path is null").select("rel", "outcome")


def member_texts(members_: DataFrame) -> DataFrame:
    """(rel, text) of members as files named archive!member, for any scanner of texts."""
    return members_.where("path is not null").select(F.concat("rel", "path").alias("rel"), "text")
