"""Near-duplicate documents: a signature-coordinate inverted join, confirmed on full shingle sets.

1. Every text becomes a set of k-word shingles and a MinHash signature of ``coordinates`` values. Texts of one set (two
   64-bit sums over its hashes tell sets apart) form a class, represented by its smallest doc_id; from here on one row a
   class is worked on, so copies, however many, cost nothing.
2. Classes are posted under (coordinate, value) pairs. Two classes of similarity ``percent`` agree in ``least`` of the
   coordinates but for a chance of about 1e-6 (binomial tail at exactly the limit; far less above it), and a pair that
   does shares one of the first ``coordinates - least + 1`` pairs of either in any order that is the same for all: only
   this prefix is posted. The order is by frequency, rarest first, as a fixed number of counters tells it, so values that
   many documents share (a common passage) are mostly not posted at all.
3. Collisions are counted over the whole signature, posting list by posting list, with skips: the first class of a list
   takes every class that reaches ``least`` with it; these are not compared with each other any more. With what another
   leader took they are compared only where the leaders are near enough for it (the number of coordinates in which
   signatures differ is a metric), and only until one pair reaches ``least``. A list of n classes so gives n - 1 links at
   most. The components of these links are families: a pair that can be linked is of one family.
4. Each family is resolved on the full sets (exact integer comparison): classes that confirmed links join already aren't
   compared any more, so what a family gives is a forest of links, and only classes that stand alone meet all others.
   Its texts are moved once, however many of its pairs are compared.
5. Components of the confirmed links: alternating star steps. As a class is its smallest doc_id, so is a component.

Scale: a key, class or node of more than ``hot`` rows is counted by partial aggregation and joined by broadcast, all others
by shuffle. Lists longer than ``block`` are split into blocks that meet pairwise in tasks of their own; that work grows
with the square of a list of unlike classes, which rarest-first prefixes keep short. So are families of more than ``links``
classes or ``shingles`` shingles; there the work grows with the square only for classes that are linked with nothing.
Only texts of families are moved: a Bloom filter of 12 bits a class leaves the others where they are, unless it would take
more than ``bloom_bits``; then the join decides alone. Nothing of the corpus is collected.

Edge cases: null, empty or wordless texts have the empty set and are linked with nothing. Rows without a doc_id take no
part (component null, kept false; ``filter_documents`` keeps them). Rows of one doc_id are judged each by its text, and a
doc_id of which a row is kept is kept. Ties: the smallest doc_id represents. Very long texts are compared whole. An empty
table gives no rows. Extra columns, whatever their names, are ignored and pass through ``filter_documents``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm._common import P, aliased, at, dropped, joined_hot, text_chunks, written
from lumenscan.llm.components import components
from lumenscan.llm.shingles import MinHash, mix, shingle_sets


@dataclass(frozen=True)
class NearDupOptions:
    shingle: int = 5
    percent: int = 80
    coordinates: int = 64
    least: int = 36
    #: Classes of a posting list that one task holds at a time.
    block: int = 16_384
    #: Classes, and shingles in all, of a family that make a block in which links are confirmed.
    links: int = 2_048
    shingles: int = 1 << 20
    bloom_bits: int = 1 << 27
    #: Counters of posted values, and rows from which on a key is joined by broadcast.
    counters: int = 1 << 17
    hot: int = 1_000_000
    #: Dropped ids up to so many are broadcast by filter_documents (8 bytes each); more are joined by shuffle.
    broadcast_ids: int = 2_000_000


def signatures(docs: DataFrame, o: NearDupOptions, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n (set size), c1, c2 (identity of the set), sig (four bytes a coordinate; null if the set is empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(o.coordinates)
        for batch in batches:
            for b in text_chunks(batch, "text", 1 << 20):
                ns, ids, sig = [], [], []
                for s in shingle_sets(b.column("text"), o.shingle):
                    ns.append(len(s))
                    ids.append(mix(np.array([s.sum(), mix(s).sum()], np.uint64) + np.uint64(len(s))).view(np.int64))
                    sig.append(minhash(s).astype("<u4").tobytes() if len(s) else None)
                c = np.array(ids).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ns, pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(sig, pa.binary())], names=["doc_id", "n", "c1", "c2", "sig"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n long, c1 long, c2 long, sig binary")


# posting lists


def _groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Tables of whole groups of equal values of column, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(column))
        if held and np.asarray(held[-1].column(column))[-1] == k[0] == k[-1]:
            held.append(batch)
            continue
        cut = len(k) - int(np.argmax(k[::-1] != k[-1])) if k[0] != k[-1] else 0
        if not held and not cut:
            held = [batch]
        elif held and not cut:  # one group begins here and what is held is over
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, width)


def _reach(sig: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray, o: NearDupOptions) -> np.ndarray:
    """Which pairs of rows collide often enough and are of sizes that allow the similarity."""
    ok = np.zeros(len(i), dtype=bool)
    for a in range(0, len(i), 65_536):
        x, y = i[a : a + 65_536], j[a : a + 65_536]
        near = 100 * np.minimum(n[x], n[y]) >= o.percent * np.maximum(n[x], n[y])
        x, y, at = x[near], y[near], np.flatnonzero(near) + a
        ok[at[(sig[x] == sig[y]).sum(1) >= o.least]] = True
    return ok


def _crossing(sig: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray, o: NearDupOptions) -> tuple[int, int] | None:
    """A pair of a row of x and one of y that collide often enough, if there is one."""
    for part in np.array_split(x, -(-len(x) * len(y) // 65_536)):
        i, j = (v.ravel() for v in np.meshgrid(part, y, indexing="ij"))
        ok = _reach(sig, n, i, j, o)
        if ok.any():
            return int(i[np.argmax(ok)]), int(j[np.argmax(ok)])
    return None


def _stars(key: np.ndarray, n: np.ndarray, sig: np.ndarray, o: NearDupOptions) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that join what collides often enough, of all groups of equal key (rows sorted by key), with skips."""
    left = np.arange(len(key))
    leader = left.copy()
    out_a, out_b = [], []
    while len(left) > 1:
        k = key[left]
        first = np.append(True, k[1:] != k[:-1])
        lead = left[np.maximum.accumulate(np.where(first, np.arange(len(left)), 0))]
        i, j = lead[~first], left[~first]
        ok = _reach(sig, n, i, j, o)
        out_a.append(i[ok]), out_b.append(j[ok])
        leader[j[ok]] = i[ok]
        left = j[~ok]
    # what a star took in is compared with what is outside the star, if the leaders are near enough and nothing joins them yet
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    own, apart = leader == np.arange(len(key)), sig.shape[1] - o.least
    far = (sig != sig[leader]).sum(1)
    radius = np.zeros(len(key), np.int64)
    np.maximum.at(radius, leader, far)
    ends = np.append(starts[1:], len(key))
    n_leads = np.add.reduceat(own, starts, dtype=np.int64) if len(key) else starts
    several = (n_leads > 1) & (n_leads < ends - starts)
    for s, e in zip(starts[several], ends[several]):
        leads = s + np.flatnonzero(own[s:e])
        rows = s + np.argsort(leader[s:e], kind="stable")
        members = dict(zip(leads.tolist(), np.split(rows, np.flatnonzero(np.diff(leader[rows])) + 1)))
        root = np.arange(len(leads))
        for x, i in enumerate(leads.tolist()):
            for at in range(x + 1, len(leads), 65_536):
                some = np.arange(at, min(at + 65_536, len(leads)))
                some = some[root[some] != root[x]]
                between = (sig[leads[some]] != sig[i]).sum(1)
                near = between <= apart + radius[i] + radius[leads[some]]
                for y, d in zip(some[near].tolist(), between[near].tolist()):
                    if root[x] == root[y]:
                        continue
                    mine, others = members[i], members[int(leads[y])]
                    mine, others = mine[far[mine] + radius[leads[y]] + apart >= d], others[far[others] + radius[i] + apart >= d]
                    if len(mine) and len(others) and (pair := _crossing(sig, n, mine, others, o)):
                        out_a.append([pair[0]]), out_b.append([pair[1]])
                        root[root == root[y]] = root[x]
    return tuple(np.concatenate(x).astype(np.int64) if x else np.empty(0, np.int64) for x in (out_a, out_b))


def _tokens(sig: pa.Array, o: NearDupOptions) -> np.ndarray:
    """A 64-bit hash of every (coordinate, value) pair, a row a signature."""
    return mix((np.frombuffer(b"".join(sig.to_pylist()), "<u4").reshape(-1, o.coordinates).astype(np.uint64) << np.uint64(8)) + np.arange(o.coordinates, dtype=np.uint64))


def _counted(classes: DataFrame, o: NearDupOptions) -> np.ndarray:
    """Counters of the pairs of all classes, of a fixed number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(o.counters, np.int64)
        for b in batches:
            n += np.bincount((_tokens(b.column("sig"), o) % np.uint64(o.counters)).astype(np.int64).ravel(), minlength=o.counters)
        filled = np.flatnonzero(n)
        for i in range(0, len(filled), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(filled[i : i + 65_536].astype(np.int32)), pa.array(n[filled[i : i + 65_536]])], names=["at", "n"])

    got = classes.select("sig").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(o.counters, np.int64)
    out[np.asarray(got.column("at"))] = np.asarray(got.column("n"))
    return out


def _postings(classes: DataFrame, frequency, o: NearDupOptions) -> DataFrame:
    """(rep, key): the prefix of each class, its rarest pairs; frequency is the broadcast of _counted()."""
    posted = o.coordinates - o.least + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = _tokens(b.column("sig"), o)
            count = np.minimum(frequency.value[(t % np.uint64(o.counters)).astype(np.int64)], 2**31).astype(np.uint64)
            first = np.argsort((count << np.uint64(32)) | (t >> np.uint64(32)), axis=1, kind="stable")[:, :posted]
            keys = np.take_along_axis(t, first, 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column("rep")), posted)), pa.array(keys.ravel())], names=["rep", "key"])

    return classes.select("rep", "sig").mapInArrow(run, "rep long, key long")


def _low(classes: DataFrame, o: NearDupOptions) -> DataFrame:
    """rep, n and a byte a coordinate of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, -1, 4)[:, :, 0]
            yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("n"), pa.array([x.tobytes() for x in low], pa.binary())], names=["rep", "n", "sig"])

    return classes.select("rep", "n", "sig").mapInArrow(run, "rep long, n long, sig binary")


def _blocks(rows: DataFrame, key: str, parts: Column) -> DataFrame:
    """rows (rep, key), of which parts blocks a key are made: rep, side (its block) and the key of the block or pair of blocks in which a row is merged."""
    parts, mine = parts.cast("int"), F.pmod(F.xxhash64("rep"), parts).cast("int")
    several = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.xxhash64(key, F.least(p, mine), F.greatest(p, mine)))
    return rows.select("rep", mine.alias("side"), F.explode(F.when(parts > 1, several).otherwise(F.array(key))).alias("key"))


def _lists(postings: DataFrame, o: NearDupOptions) -> DataFrame:
    """Postings of keys that two classes or more have, with their number; counted by partial aggregation."""
    sizes = postings.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    return joined_hot(postings, sizes, ["key"], "size", o.hot)


def _merged(rows: DataFrame, o: NearDupOptions) -> DataFrame:
    """Candidate links (a, b) of rows (key, rep, n, sig)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "key"):
            key, n, rep = (np.asarray(t.column(c)) for c in ("key", "n", "rep"))
            i, j = _stars(key, n, _matrix(t.column("sig"), o.coordinates), o)
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    return rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "a long, b long").where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


# confirmation


def _positions(x, bits: int) -> list:
    return [F.pmod(F.xxhash64(x, F.lit(i)), F.lit(bits)) for i in range(3)]


def _bloom(ids: DataFrame, bits: int) -> np.ndarray:
    """Bit field of the ids (column id), built by partial aggregation."""
    at = ids.select(F.explode(F.array(*_positions("id", bits))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("bits")).toArrow()
    field = np.zeros(bits // 64, dtype=np.int64)
    if len(words):
        field[np.asarray(words.column("w"))] = np.asarray(words.column("bits"))
    return field.view(np.uint64)


def _texts_of(docs: DataFrame, ids: DataFrame, o: NearDupOptions, text: str, key: str) -> DataFrame:
    """rep and text of the documents that may be among ids (column id): all of them, and few others while the filter's size allows."""
    own = docs.select(F.col(key).cast("long").alias("rep"), F.col(text).alias("text")).where("rep is not null")
    bits = 1 << (12 * max(ids.count(), 64) - 1).bit_length()
    if bits > o.bloom_bits:
        return own
    shared = docs.sparkSession.sparkContext.broadcast(_bloom(ids, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for batch in batches:
            p = batch.column("through").flatten().to_numpy().astype(np.uint64).reshape(-1, 3)
            keep = ((field[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(1)
            yield batch.filter(pa.array(keep)).select(["rep", "text"])

    return own.select("rep", "text", F.array(*_positions("rep", bits)).alias("through")).mapInArrow(run, "rep long, text string")


def _resolved(docs: DataFrame, families: DataFrame, classes: DataFrame, o: NearDupOptions, text: str, key: str) -> DataFrame:
    """Links (a, b) that join what full sets similar enough join, within each family (node, root)."""
    members = written(families.withColumnRenamed("node", "rep").join(classes.select("rep", "n"), "rep").groupBy("rep", "root").agg(F.sum("n").alias("n")), "members")
    sizes = members.groupBy("root").agg(F.count("*").alias("many"), F.sum("n").alias("total"))
    parts = F.greatest(F.ceil(F.col("many") / F.lit(o.links)), F.ceil(F.col("total") / F.lit(o.shingles)))
    wanted = written(_blocks(joined_hot(members, sizes, ["root"], "many", o.hot), "root", parts), "wanted")
    found = _texts_of(docs, members.select(F.col("rep").alias("id")), o, text, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rep, side, sets = None, [], [], []
        for batch in batches:
            for part in text_chunks(batch, "text", 1 << 20):
                out: list[np.ndarray] = []
                for k, r, p, s in zip(*(part.column(c).to_pylist() for c in ("key", "rep", "side")), shingle_sets(part.column("text"), o.shingle)):
                    if k != now:
                        out.append(_joined(rep, side, sets, o))
                        now, rep, side, sets = k, [], [], []
                    if len(s) and not (rep and rep[-1] == r and np.array_equal(sets[-1], s)):
                        rep.append(r), side.append(p), sets.append(s)
                yield _pairs(out)
        yield _pairs([_joined(rep, side, sets, o)])

    rows = wanted.join(found, "rep").select("key", "side", "rep", "text")
    links = written(rows.repartition("key").sortWithinPartitions("key", "side", "rep").mapInArrow(run, "a long, b long"), "links")
    dropped(members, wanted)
    return links


def _pairs(parts: list[np.ndarray]) -> pa.RecordBatch:
    got = np.concatenate([np.empty((0, 2), np.int64), *parts])
    return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])


def _joined(rep: list[int], side: list[int], sets: list[np.ndarray], o: NearDupOptions) -> np.ndarray:
    """(least rep, rep) of every row but the first of each component of a group; of a pair of blocks, rows of one block aren't compared."""
    if len(sets) < 2:
        return np.empty((0, 2), np.int64)
    ids, own = np.unique(np.array(rep, np.int64), return_inverse=True)
    root, least = own.copy(), np.full(len(ids), len(ids))
    _forest(sets, root, np.array(side), o)
    np.minimum.at(least, root, own)
    got = np.unique(np.stack([ids[least[root]], ids[own]], 1), axis=0)
    return got[got[:, 0] != got[:, 1]]


def _forest(sets: list[np.ndarray], root: np.ndarray, side: np.ndarray, o: NearDupOptions) -> int:
    """Joins in root the rows whose sets are similar enough; gives the number of comparisons. What is joined already isn't compared."""
    sizes = np.array([len(s) for s in sets])
    starts = np.append(0, np.cumsum(sizes))
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    mark, compared = np.zeros(len(values), np.int32), 0
    for i in range(len(sets) - 1):
        left = np.arange(i + 1, len(sets))
        if side[0] != side[-1]:
            left = left[side[left] != side[i]]
        left = left[100 * np.minimum(sizes[left], sizes[i]) >= o.percent * np.maximum(sizes[left], sizes[i])]
        own, step = at[starts[i] : starts[i + 1]], 16
        mark[own] = 1
        while len(left := left[root[left] != root[i]]):
            some, left, step = left[:step], left[step:], 4 * step  # few at first: one of them may join many of the others
            a, e = starts[some[0]], starts[some[-1] + 1]
            if 3 * sizes[some].sum() > e - a:
                both = np.add.reduceat(mark[at[a:e]], starts[some[0] : some[-1] + 1] - a)[some - some[0]]
            else:
                ends = np.cumsum(sizes[some])
                each = np.arange(ends[-1]) + np.repeat(starts[some] - ends + sizes[some], sizes[some])
                both = np.add.reduceat(mark[at[each]], ends - sizes[some])
            compared += len(some)
            for j in some[100 * both >= o.percent * (sizes[i] + sizes[some] - both)].tolist():
                if root[j] != root[i]:
                    root[root == root[j]] = root[i]
        mark[own] = 0
    return compared


def near_duplicates(docs: DataFrame, o: NearDupOptions = NearDupOptions(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    sigs = written(signatures(docs, o, text, key), "signatures")
    some = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = written(sigs.where(some).groupBy("c1", "c2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    frequency = docs.sparkSession.sparkContext.broadcast(_counted(classes, o))
    postings = _postings(classes, frequency, o)
    lists = _blocks(_lists(postings, o), "key", F.ceil(F.col("size") / F.lit(o.block))).select("rep", "key")
    candidates = written(_merged(lists.join(_low(classes, o), "rep"), o), "candidates")
    families = components(candidates, o.hot)
    links = _resolved(docs, families, classes, o, text, key)
    found = components(links, o.hot)
    # a document alone with its text and without links is its own component: only the others are looked up
    labels = classes.select("c1", "c2", "rep", "many").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    labels = labels.where("many > 1 or root is not null").select("c1", "c2", "many", F.coalesce("root", "rep").alias("component"))
    with_set = joined_hot(sigs.where(some).select("doc_id", "n", "c1", "c2"), labels, ["c1", "c2"], "many", o.hot, "left").select("doc_id", "n", "component")
    dropped(classes, candidates, families, links, found)
    out = with_set.unionByName(sigs.where(~some).select("doc_id", "n", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def filter_documents(docs: DataFrame, o: NearDupOptions = NearDupOptions(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without the near-duplicates of a document of a smaller id: one document of each component stays."""
    inner = aliased(docs)
    text, key = at(docs, text), at(docs, key)
    verdict = near_duplicates(inner, o, text, key).where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"))
    gone = written(verdict.where("not kept").select(F.col("doc_id").alias(f"{P}gone")), "gone")
    side = F.broadcast(gone) if gone.count() <= o.broadcast_ids else gone
    return inner.join(side, inner[key].cast("long") == F.col(f"{P}gone"), "left_anti").toDF(*docs.columns)
