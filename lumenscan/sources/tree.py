"""Relations of files: a directory tree, or any table of texts seen as files (rel, content)."""

from __future__ import annotations

import codecs
import contextlib
import hashlib
import os
import re
import unicodedata
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKIPPED = ".git .hg .svn .tox .nox .venv venv env node_modules __pycache__ .mypy_cache .pytest_cache .ruff_cache build dist .eggs site-packages".split()
MOST_BYTES = 16 << 20


def read_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files(rel, size, content) of every regular file under root; rel in NFC. Content is null beyond most_bytes, and is only read where it is asked for. Symbolic links are followed by no one: local trees are walked by walk_tree()."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z]+:/*", "/")
    return files.select(nfc(path.substr(F.lit(len(base) + 1), F.length(path))).alias("rel"), F.col("length").alias("size"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("content"))


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def walk_tree(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """files(rel, size, content, sha256) of a local tree, read once each, and its links(rel, kind): symbolic links, and directories met again by device and inode. For trees of one machine: names are listed by the driver, contents read by tasks."""
    top, found, links, met = Path(root), [], [], set()
    stack = [top]
    while stack:
        for e in sorted(os.scandir(stack.pop()), key=lambda e: os.fsencode(e.name)):
            rel = unicodedata.normalize("NFC", os.path.relpath(e.path, top).replace(os.sep, "/"))
            if e.is_symlink():
                links.append((rel, "symlink"))
            elif e.is_dir(follow_symlinks=False):
                st = e.stat(follow_symlinks=False)
                if (st.st_dev, st.st_ino) in met:
                    links.append((rel, "directory"))
                else:
                    met.add((st.st_dev, st.st_ino))
                    stack.append(Path(e.path))
            elif e.is_file(follow_symlinks=False):
                found.append((rel, e.path, e.stat().st_size))

    def read(batches):
        for b in batches:
            content, digest = [], []
            for path, size in zip(b.column("path").to_pylist(), b.column("size").to_pylist()):
                with open(path, "rb") as f:
                    digest.append(hashlib.file_digest(f, "sha256").hexdigest())
                    f.seek(0)
                    data = f.read(most_bytes + 1) if size <= most_bytes else None
                if data is not None and hashlib.sha256(data).hexdigest() != digest[-1]:
                    raise ValueError(f"{path} changed while it was read")
                content.append(data)
            yield pa.RecordBatch.from_arrays([b.column("rel"), b.column("size"), pa.array(content, pa.binary()), pa.array(digest)], names=["rel", "size", "content", "sha256"])

    names = spark.createDataFrame(found, "rel string, path string, size long")
    return names.mapInArrow(read, "rel string, size long, content binary, sha256 string"), spark.createDataFrame(links, "rel string, kind string")


def changed(files: DataFrame, again: DataFrame) -> DataFrame:
    """rel of files (rel, sha256) whose second reading differs or is missing."""
    return files.join(again.select("rel", F.col("sha256").alias("now")), "rel", "left").where("now is null or now <> sha256").select("rel")


def stand_ins(files: DataFrame) -> DataFrame:
    """rel, target, why of small files that stand for a link: one line of path characters that names a file or folder of the tree, a skipped folder, or a path out of the tree. A bare word in a manifest is none."""
    text = F.trim(F.col("content").cast("string"))
    small = files.where((F.col("size") <= 1024) & (F.col("size") > 0)).select("rel", text.alias("text")).where(F.col("text").rlike(r"^[-./\w~+@]+$"))
    manifest = F.lower("rel").rlike(r"(^|/)([^/]*requirements[^/]*\.(txt|in)|pipfile|\.gitmodules)$")
    small = small.where(~manifest | F.col("text").contains("/"))
    folder = F.regexp_extract("rel", "^(.*/)?[^/]*$", 1)
    parts = F.filter(F.split(F.concat(folder, "text"), "/"), lambda p: ~p.isin("", "."))
    up = F.struct(F.array().cast("array<string>").alias("p"), F.lit(False).alias("out"))
    step = lambda a, p: F.struct(F.when(p != "..", F.concat(a["p"], F.array(p))).otherwise(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0)))).alias("p"), (a["out"] | ((p == "..") & (F.size(a["p"]) == 0))).alias("out"))
    s = small.select("rel", F.aggregate(parts, up, step).alias("t"), F.col("text").startswith("/").alias("rooted"))
    s = s.select("rel", F.array_join("t.p", "/").alias("target"), (F.col("t.out") | F.col("rooted")).alias("out"))
    names = F.split("rel", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, 1, i), "/"))
    known = files.select(F.explode(prefixes).alias("target")).distinct().withColumn("known", F.lit(True))
    why = F.when(F.col("out"), "out of the tree").when(F.col("known"), "a path of the tree").when(skipped_prefix(F.concat("target", F.lit("/x"))).isNotNull(), "a skipped folder")
    return s.join(known, "target", "left").select("rel", "target", why.alias("why")).where("why is not null and target <> rel")


def skipped_prefix(rel: Column) -> Column:
    """The first skipped directory of a path, or null."""
    parts = F.split(rel, "/")
    bad = lambda p: p.isin(*SKIPPED) | p.endswith(".egg-info")
    at = F.element_at(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: (i < F.size(parts)) & bad(F.get(parts, i - 1))), 1)
    inside = F.when(F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), bad), F.array_join(F.slice(parts, 1, at), "/"))
    name = F.element_at(parts, -1)
    return F.coalesce(inside, F.when((name == ".git") | name.startswith(".coverage"), rel))  # files that are skipped themselves


def read_and_skipped(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files to read, and the ledger (directory, n_files) of those in skipped directories, and of skipped files."""
    f = files.withColumn("skipped", skipped_prefix(F.col("rel")))
    return f.where("skipped is null").drop("skipped"), f.where("skipped is not null").groupBy(F.col("skipped").alias("directory")).agg(F.count("*").alias("n_files"))


def extension(rel: Column) -> Column:
    """The lower-case extension with its dot; '' without one; a trailing dot is none."""
    return F.lower(F.regexp_extract(rel, r"[^/](\.[^./]+)$", 1))


def files_by_extension(files: DataFrame) -> DataFrame:
    e = extension(F.col("rel"))
    return files.groupBy(F.when(e == "", "(no extension)").otherwise(e).alias("extension")).agg(F.count("*").alias("n_files"))


_MARKS = [(codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")]
_COOKIE = re.compile(rb"^[ \t\f]*#.*?coding[:=][ \t]*([-.\w]+)")


def decoded(content: bytes, python: bool = False) -> str:
    """Text of bytes: by byte order mark (the longest first), for Python by the coding line of its first two, else UTF-8; what can't be read is replaced. Line ends become LF."""
    coding = next((name for mark, name in _MARKS if content.startswith(mark)), None)
    if coding is None and python:
        m = next((m for line in content.split(b"\n", 2)[:2] if (m := _COOKIE.match(line))), None)
        with contextlib.suppress(LookupError):
            coding = codecs.lookup(m[1].decode()).name if m else None
    try:
        text = content.decode(coding or "utf-8", "replace")
    except (LookupError, ValueError, TypeError):  # a coding that isn't one of texts
        text = content.decode("utf-8", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def texts(files: DataFrame) -> DataFrame:
    """files(rel, content) -> (rel, text); one narrow pass."""

    def run(batches):
        for b in batches:
            rels = b.column("rel").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("rel"), pa.array([decoded(x, r.lower().endswith((".py", ".pyw"))) for r, x in zip(rels, b.column("content").to_pylist())], pa.string())], names=["rel", "text"])

    return files.where("content is not null").select("rel", "content").mapInArrow(run, "rel string, text string")


def lines(texts_: DataFrame) -> DataFrame:
    """(rel, text) -> (rel, line, text): a row a line; narrow."""
    return texts_.select("rel", F.posexplode(F.split("text", "\n")).alias("p", "text")).select("rel", (F.col("p") + 1).alias("line"), "text")


def table_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents, pages and conversations as (rel, text)."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat(F.lit("doc/"), "doc_id", F.lit(".txt")).alias("rel"), "text")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.concat(F.lit("page/"), "page_id", F.lit(".html")), "html")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.concat(F.lit("conv/"), "conv_id", F.lit("/"), "turn", F.lit(".txt")), "text")
    return d.union(p).union(c).where("text is not null")
