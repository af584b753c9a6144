"""Merkle trees over relations (RFC 9162 hashes): roots, inclusion proofs, tiles and fork detection, level by level.

A leaf is SHA-256(00 data), a node SHA-256(01 left right); a node without a sibling goes up as it is, which is the
tree of the RFC. Groups of a relation are folded all at once. Leaves are numbered by a range partitioning on (group,
order): a task numbers its own range, and the ranges' offsets, one row a group and range, are added; so one log of any
length is spread over all tasks. Then tiles of ``tile`` leaves are folded each in one row, level by level.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscan.sources.lineage import cut
from lumenscan.sources.lineage import numbered as number_rows

c, lit = F.col, F.lit
EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def leaf_hash(data: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(lit("00")), data), 256))


def node_hash(left: Column, right: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.unhex(lit("01")), left, right), 256))


def numbered(rows: DataFrame, group: list[str], order: list, data: Column) -> DataFrame:
    """group, idx (from 0 in order), hash of every leaf; ties of the order by their hash."""
    keys = [f"o{i}" for i in range(len(order))]
    r = rows.select(*group, *[(c(o) if isinstance(o, str) else o).alias(k) for o, k in zip(order, keys)], leaf_hash(data).alias("hash"))
    return number_rows(r, group, [*keys, "hash"]).select(*group, "idx", "hash")


def next_level(nodes: DataFrame, group: list[str]) -> DataFrame:
    half = F.expr("idx div 2")
    odd = c("idx") % 2
    pair = nodes.groupBy(*group, half.alias("idx")).agg(F.max(F.when(odd == 0, c("hash"))).alias("l"), F.max(F.when(odd == 1, c("hash"))).alias("r"))
    return pair.select(*group, "idx", F.when(c("r").isNull(), c("l")).otherwise(node_hash(c("l"), c("r"))).alias("hash"))


def roots_of_groups(rows: DataFrame, group: list[str], order: list, data: Column, tile: int = 4096) -> DataFrame:
    """group, size and root (hex) of every group.

    Leaves of one group are folded in SQL: tiles of `tile` leaves by an ordered array each (bounded), then a level of
    tiles, as often as the largest group asks for."""
    leaves = cut(numbered(rows, group, order, data))
    sizes = leaves.groupBy(*group).agg(F.count("*").alias("size"))
    nodes = leaves
    while True:
        nodes = nodes.groupBy(*group, F.expr(f"idx div {tile}").alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"]).alias("hs"))
        nodes = nodes.select(*group, c("t").alias("idx"), _fold(c("hs"), tile).alias("hash"))
        nodes = cut(nodes)
        if tile <= 1 or nodes.where("idx > 0").isEmpty():
            break
    return sizes.join(nodes, group).select(*group, "size", F.lower(F.hex("hash")).alias("root"))


def _fold(hashes: Column, most: int) -> Column:
    """The root over an array of hashes of at most `most`: pairs again and again."""
    out = hashes
    while most > 1:
        # the array is bound once a level
        step = lambda a: F.transform(F.sequence(lit(0), F.expr("0") + F.ceil(F.size(a) / 2).cast("int") - 1), lambda i: F.when(2 * i + 1 < F.size(a), node_hash(F.get(a, 2 * i), F.get(a, 2 * i + 1))).otherwise(F.get(a, 2 * i)))
        out = F.element_at(F.transform(F.array(out), step), 1)
        most = -(-most // 2)
    return F.get(out, lit(0))


def mth(leaves: list[bytes]) -> bytes:
    """Root over leaf hashes, by levels."""
    level = list(leaves)
    while len(level) > 1:
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


def _node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def inclusion_path(hashes: list[bytes], at: int) -> list[bytes]:
    """Siblings of leaf number at on its way to the root, from below; one proof on the driver."""
    siblings, level = [], list(hashes)
    while len(level) > 1:
        if at ^ 1 < len(level):
            siblings.append(level[at ^ 1])
        level = [_node(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        at //= 2
    return siblings


def _largest_power(n: int) -> int:
    """The largest power of two below n."""
    return 1 << ((n - 1).bit_length() - 1)


def consistency_path(hashes: list[bytes], old: int) -> list[bytes]:
    """Nodes that show the tree of the first old leaves to be a prefix of the whole (RFC 9162 2.1.4.1)."""
    if not 0 < old <= len(hashes):
        return []
    path, first, last, whole = [], 0, len(hashes), True
    while old != last - first:
        k = _largest_power(last - first)
        if old <= k:
            path.append(mth(hashes[first + k : last]))
            last = first + k
        else:
            path.append(mth(hashes[first : first + k]))
            first, old, whole = first + k, old - k, False
    return ([] if whole else [mth(hashes[first:last])]) + path[::-1]


def verify_consistency(old: int, new: int, old_root: bytes, new_root: bytes, path: list[bytes]) -> bool:
    """RFC 9162 2.1.4.2; a tree of no leaves is consistent with any, equal sizes need equal roots and no path."""
    if old > new or old < 0:
        return False
    if old == new:
        return not path and old_root == new_root
    if old == 0:
        return not path and old_root == hashlib.sha256(b"").digest()
    nodes = [old_root, *path] if old & (old - 1) == 0 else list(path)
    if not nodes:
        return False
    fn, sn = old - 1, new - 1
    while fn & 1:
        fn, sn = fn >> 1, sn >> 1
    fr = sr = nodes[0]
    for p in nodes[1:]:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            fr, sr = _node(p, fr), _node(p, sr)
            while fn and not fn & 1:
                fn, sn = fn >> 1, sn >> 1
        else:
            sr = _node(sr, p)
        fn, sn = fn >> 1, sn >> 1
    return sn == 0 and fr == old_root and sr == new_root


def verify_inclusion(leaf: bytes, index: int, size: int, path: list[bytes], root: bytes) -> bool:
    """RFC 9162 2.1.3.2."""
    if not 0 <= index < size:
        return False
    fn, sn, r = index, size - 1, leaf
    for p in path:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            r = hashlib.sha256(b"\x01" + p + r).digest()
            while not fn & 1 and fn:
                fn, sn = fn >> 1, sn >> 1
        else:
            r = hashlib.sha256(b"\x01" + r + p).digest()
        fn, sn = fn >> 1, sn >> 1
    return sn == 0 and r == root


def inclusion_proofs(rows: DataFrame, group: list[str], order: list, data: Column) -> DataFrame:
    """group, idx, level, sibling (hex) of every step of every leaf's proof, by joins on the tree's levels: level l of leaf i is node (i div 2**l) xor 1, where it exists."""
    leaves = cut(numbered(rows, group, order, data))
    level, n, out = leaves, 0, None
    while not level.where("idx > 0").isEmpty():
        sibling = level.select(*group, F.expr("idx ^ 1").alias("at"), F.lower(F.hex("hash")).alias("sibling"))
        steps = leaves.select(*group, "idx", F.shiftright("idx", n).alias("at")).join(sibling, [*group, "at"]).select(*group, "idx", lit(n).alias("level"), "sibling")
        out = steps if out is None else out.unionByName(steps)
        level, n = cut(next_level(level, group)), n + 1
    return out if out is not None else leaves.select(*group, "idx", lit(0).alias("level"), lit("").alias("sibling")).limit(0)


@F.pandas_udf(T.BooleanType())
def inclusion_holds(leaf: pd.Series, index: pd.Series, size: pd.Series, path: pd.Series, root: pd.Series) -> pd.Series:
    """Whether each proof (hex leaf, index, size, array of hex siblings, hex root) holds; null where any is null."""
    un = bytes.fromhex
    return pd.Series([None if x is None or p is None or r is None or pd.isna(i) or pd.isna(n) else verify_inclusion(un(x), int(i), int(n), [un(s) for s in p], un(r)) for x, i, n, p, r in zip(leaf, index, size, path, root)], dtype="object")


def entry_line(prefix: Column, report: Column, findings: Column) -> Column:
    """The line of a log entry: what it is, the report's digest and that of its findings."""
    return F.concat(prefix, lit(" "), report, lit(" "), findings, lit("\n"))


def tile_path(level: Column, index: Column, width: Column | None = None) -> Column:
    """Path of a tile: its index in groups of three digits, all but the last marked with x; .p/width where it isn't full (256)."""
    digits = index.cast("string")
    padded = F.lpad(digits, F.ceil(F.length(digits) / 3).cast("int") * 3, "0")
    groups = F.regexp_extract_all(padded, lit("[0-9]{3}"), lit(0))
    last = F.size(groups) - 1
    shown = F.array_join(F.transform(groups, lambda g, i: F.when(i < last, F.concat(lit("x"), g)).otherwise(g)), "/")
    part = lit("") if width is None else F.when(width % 256 != 0, F.concat(lit(".p/"), (width % 256).cast("string"))).otherwise("")
    return F.concat(lit("tile/"), level.cast("string"), lit("/"), shown, part)


def tiles(leaves: DataFrame, group: list[str], height: int = 8) -> DataFrame:
    """group, level, index, width, path, hashes (hex, joined) of the tiles of numbered leaves: a row holds 2**height hashes at most."""
    out, level, n = None, leaves, 0
    while True:
        hs = F.transform(F.array_sort(F.collect_list(F.struct("idx", "hash"))), lambda x: x["hash"])
        tile = cut(level.groupBy(*group, F.shiftright("idx", height).alias("index")).agg(hs.alias("hs")))
        shown = tile.select(*group, lit(n).alias("level"), "index", F.size("hs").alias("width"), F.array_join(F.transform("hs", lambda h: F.lower(F.hex(h))), "").alias("hashes"))
        shown = shown.withColumn("path", tile_path(c("level"), c("index"), c("width")))
        out = shown if out is None else out.unionByName(shown)
        full = tile.where(F.size("hs") == 1 << height)
        if full.isEmpty():
            return out
        level, n = full.select(*group, c("index").alias("idx"), _fold(c("hs"), 1 << height).alias("hash")), n + 1


def forks(checkpoints: DataFrame) -> DataFrame:
    """(origin, size) for which two different roots were signed."""
    return checkpoints.groupBy("origin", "size").agg(F.min("root").alias("root_a"), F.max("root").alias("root_b")).where("root_a <> root_b")
