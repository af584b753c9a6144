"""Language identification by words first, backing off to shorter and shorter character n-grams.

A model has, per language, log10 relative frequencies of words and of character n-grams of every order from
``max_order`` down to 1. A word that any language knows is scored by the word table. An unseen word is scored by the
mean over its n-grams of the longest order of which the model knows one; an order a language lacks an n-gram of costs
``penalty``. A document's score is the mean over its words; the highest wins, ties go to the first name in order.

The model is fitted on a bounded sample of labelled rows (``sample_documents``); every language of the rows learned
from, every word and every n-gram of the sampled texts is in it. Words and n-grams are kept as sorted 64-bit hashes
beside one array of values, so a model takes 8 bytes and a float a language for each. Scoring is one narrow pass:
batches of texts go to Python workers, no shuffle, no key that could be hot. Only what a document says is used: its
language label, source and id never enter a prediction.

Edge cases: a null text or one without a letter gives ``und`` with score 0.0. Words are runs of letters (Unicode category
L, in training and in scoring), lower-cased; numerals such as superscripts are no letters. Without labelled rows the
model is empty and everything is ``und``. Repeated rows are scored each on its own; very long texts are read in whole,
in slices. Other columns, whatever their names, are not read and pass through ``filter_documents``.
"""

from __future__ import annotations

import functools
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenscan.llm._common import P, aliased, at, dropped, text_chunks, written
from lumenscan.llm.shingles import mix

UNDETERMINED = "und"


@functools.cache
def letters() -> re.Pattern:
    r"""Runs of \p{L}: what \w has, less the digits and less the numerals that are no letters."""
    not_letters = [c for c in range(sys.maxunicode + 1) if (x := chr(c)).isalnum() and not x.isdecimal() and unicodedata.category(x)[0] != "L"]
    ranges = np.split(np.array(not_letters), np.flatnonzero(np.diff(not_letters) > 1) + 1)
    return re.compile(r"[^\W\d_" + "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in ranges) + "]+")


@dataclass(frozen=True)
class LanguageIdOptions:
    #: The model is fitted on about so many labelled rows, chosen by a hash of their id; all if there are fewer.
    sample_documents: int = 20_000
    max_order: int = 5
    penalty: float = -7.0
    #: Words remembered by a worker between batches.
    memo: int = 200_000


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _letters_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in a row, as hashes, and where each word begins, with the end."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    return mix(codes + np.uint64(1)), np.append(0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words))))


def _letters_in(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """_letters_of the strings of an Arrow column without nulls."""
    col = col.cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    text = col.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes().decode() if len(col) else ""
    return _letters_of([text])[0], np.append(0, np.cumsum(np.asarray(pc.utf8_length(col)).astype(np.int64)))


def _windows(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n letters in a row."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = mix(out * _FACTOR + h[j : len(h) - n + 1 + j])
    return out


def hashes(words: list[str]) -> np.ndarray:
    """A 64-bit hash of each of words, none of them empty."""
    return _whole(*_letters_of(words))


def _whole(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = np.diff(ends)
    place = np.arange(len(h)) - np.repeat(ends[:-1], lengths)
    return mix(np.add.reduceat(mix(h + place.astype(np.uint64) * _FACTOR), ends[:-1]) + lengths.astype(np.uint64)) if len(lengths) else np.empty(0, np.uint64)


@dataclass
class LanguageModel:
    languages: list[str]
    #: by order (0: words): sorted hashes, and log10 frequencies, a row a hash, a column a language
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    options: LanguageIdOptions

    def _find(self, order: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of h the table knows, and their rows."""
        known, values = self.tables.get(order, (np.empty(0, np.uint64), np.empty((0, len(self.languages)), np.float32)))
        if not len(known):
            return np.zeros(len(h), bool), values
        i = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[i] == h
        return hit, values[i[hit]]

    def scores(self, words: list[str]) -> np.ndarray:
        """Scores of lower-case words, a row a word, a column a language."""
        out = np.full((len(words), len(self.languages)), self.options.penalty, dtype=np.float32)
        if not words:
            return out
        hit, rows = self._find(0, hashes(words))
        out[hit] = rows
        left = np.flatnonzero(~hit)
        for n in range(self.options.max_order, 0, -1):
            if not len(left):
                break
            marked = [f" {words[i]} " for i in left]
            h, ends = _letters_of(marked)
            owner = np.repeat(np.arange(len(left)), np.diff(ends))
            grams = _windows(h, n)
            inside = owner[: len(grams)] == owner[n - 1 :]
            hit, rows = self._find(n, grams[inside])
            of = owner[: len(grams)][inside][hit]
            count = np.bincount(of, minlength=len(left))
            some = count > 0
            sums = np.stack([np.bincount(of, weights=rows[:, k], minlength=len(left)) for k in range(len(self.languages))], 1)
            out[left[some]] = sums[some] / count[some, None]
            left = left[~some]
        return out


class WordScores:
    """What a worker remembers of one model: word -> row of scores, of at most options.memo words."""

    def __init__(self, model: LanguageModel):
        self.model, self.known = model, {}
        self.rows = np.empty((1024, len(model.languages)), dtype=np.float32)

    def learn(self, words: set[str]) -> None:
        """Makes sure that known and rows have all of words."""
        if len(self.known) > self.model.options.memo:
            self.known.clear()
        missing = list(words - self.known.keys())
        n, to = len(self.known), len(self.known) + len(missing)
        if to > len(self.rows):
            grown = np.empty((to + to // 4, self.rows.shape[1]), dtype=np.float32)
            grown[:n] = self.rows[:n]
            self.rows = grown
        for i in range(0, len(missing), 20_000):
            self.rows[n + i : n + i + 20_000][: len(missing) - i] = self.model.scores(missing[i : i + 20_000])
        self.known.update(zip(missing, range(n, to)))


#: A worker remembers the words of one model at a time.
_remembered: list[WordScores] = []


def _scores_of(model: LanguageModel) -> WordScores:
    if not _remembered or _remembered[0].model is not model:
        _remembered[:] = [WordScores(model)]
    return _remembered[0]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves the remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, options: LanguageIdOptions = LanguageIdOptions(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> LanguageModel:
    """A model of the rows of docs that have a language; the caller leaves out what mustn't be learned from."""
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not sizes:
        return LanguageModel([], {}, options)
    languages = sorted(sizes)
    if sum(sizes.values()) > options.sample_documents:
        # as many of each language: a rare one is not lost among the rows of a frequent one
        part = options.sample_documents / len(sizes)
        shares = F.from_json(F.lit(json.dumps({x: int(min(1.0, part / n) * 1e6) for x, n in sizes.items()})), "map<string,int>")
        rows = rows.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < shares[F.col("lang")])
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("g")).groupBy("lang", "g").agg(F.count("*").alias("n"))
    counted = written(words, "words")
    marked = F.concat(F.lit(" "), F.col("g"), F.lit(" "))
    orders = F.array(*[F.lit(n) for n in range(1, options.max_order + 1)])
    grams = (
        counted.select("lang", "n", marked.alias("w"), F.explode(orders).alias("o"))
        .where(F.length("w") >= F.col("o"))
        .select("lang", "n", "o", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - F.col("o") + 1), lambda i: F.col("w").substr(i, F.col("o")))).alias("g"))
        .groupBy("lang", "o", "g")
        .agg(F.sum("n").alias("n"))
    )
    got = counted.select("lang", F.lit(0).alias("o"), "g", "n").unionByName(grams).toArrow()
    column = np.asarray(pc.index_in(got.column("lang"), pa.array(languages)))
    order, n = np.asarray(got.column("o")), np.asarray(got.column("n")).astype(np.float64)
    tables = {}
    for o in range(options.max_order + 1):
        own = order == o
        totals = np.bincount(column[own], weights=n[own], minlength=len(languages))
        h, ends = _letters_in(got.column("g").filter(pa.array(own)).combine_chunks())
        known, at_row = np.unique(_windows(h, o)[ends[:-1]] if o else _whole(h, ends), return_inverse=True)
        values = np.full((len(known), len(languages)), options.penalty, dtype=np.float32)
        values[at_row, column[own]] = np.maximum(np.log10(n[own] / totals[column[own]]), options.penalty)
        if len(known):
            tables[o] = (known, values)
    dropped(counted)
    return LanguageModel(languages, tables, options)


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    if not model.languages:
        return names, scores
    words = letters()
    found = [words.findall(t.lower()) if t else [] for t in texts]
    memory = _scores_of(model)
    memory.learn(set().union(*found))
    for i, ws in enumerate(found):
        if ws:
            total = memory.rows[np.fromiter(map(memory.known.__getitem__, ws), np.int64, len(ws))].sum(0, dtype=np.float64) / len(ws)
            best = int(total.argmax())
            names[i] = model.languages[best]
            scores[i] = 1 / np.power(10.0, np.minimum(total - total[best], 0)).sum()
    return names, scores


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with the columns P + lang_pred and P + score."""
    schema = T.StructType([*docs.schema.fields, T.StructField(f"{P}lang_pred", T.StringType()), T.StructField(f"{P}score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for b in text_chunks(batch, text, 2 << 20):
                names, scores = score_texts(m, b.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, f"{P}lang_pred", f"{P}score"])

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, options: LanguageIdOptions = LanguageIdOptions()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the labelled ones that aren't held out."""
    model = fit(docs.where(~held_out()), options)
    narrow = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(narrow, model).select("doc_id", "held_out", F.col(f"{P}lang_pred").alias("lang_pred"), F.col(f"{P}score").alias("score"))


def filter_documents(docs: DataFrame, options: LanguageIdOptions = LanguageIdOptions(), min_score: float = 0.4) -> DataFrame:
    """The rows of docs whose language can be told: rejected are texts without a letter and those whose best language scores under min_score."""
    inner = aliased(docs)
    key, text, lang = (at(docs, c) for c in ("doc_id", "text", "lang"))
    model = fit(inner.where(~held_out(key)), options, text, lang, key)
    return predict(inner, model, text).where((F.col(f"{P}lang_pred") != UNDETERMINED) & (F.col(f"{P}score") >= min_score)).select(*inner.columns).toDF(*docs.columns)
