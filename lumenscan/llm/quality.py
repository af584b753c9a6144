"""Quality rules by distribution divergence (DataFrame functions only).

A document's histogram of character classes and its histogram of common words are compared with those of each
language by Jensen-Shannon distance (base 2, 0 to 1). The nearest language counts, for either histogram. References
are the summed histograms of all documents whose ``lang`` names the language. Documents too short for a histogram to
mean anything pass: each distance is only judged from a least size on.

Everything about a document is computed in its own row, so no text is shuffled and no key can be hot. The references
are one row a language, for every language that a document names; they reach the rows as one literal array.

Edge cases: a null or empty text has no words and fails the base rule (``n_words < 10``). With no labelled document
there is no reference and only the base rule judges. Repeated rows are judged each on its own. Other columns of the
input pass through ``filter_documents`` untouched, whatever their names. Very long texts are judged whole. Ties between
languages don't matter: only the distance to the nearest counts.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.llm._common import P, WORD, aliased, at, let, words_of, written

SYMBOLS = "[#*$%&|<>]"
#: Function words of several languages; their frequencies are measured, not assumed.
COMMON = {
    "en": "the of and to in is that it was for on with as be at by this are from or an not but which have he they you we his",
    "de": "der die und das den von mit sich des auf für ist im dem nicht ein eine als auch es zu an werden aus er hat dass sie nach wird",
    "fr": "le la les de des et du un une est que qui dans pour par sur au il pas plus ne se avec sont ce aux en elle ou son",
    "es": "el los las del una por con para su al lo como más pero sus no ya muy sin sobre este entre cuando ser también hasta desde nos todo",
    "it": "di che il della per non sono dei nel gli alla più si anche delle come",
    "pt": "os não uma dos mais ao das seu sua foi pelo ele pela isso quando são",
    "nl": "het een van dat niet zijn voor met aan ook maar naar bij door heeft deze",
}
VOCABULARY = sorted({w for ws in COMMON.values() for w in ws.split()})
#: Counted with regular expressions; white space, extra UTF-8 bytes and the rest complete the classes.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "punctuation": r"""[.,;:!?'"()\-]""", "symbol": SYMBOLS}


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    repeat_percent: int = 20
    window: int = 5
    #: Least size for each distance to be judged.
    min_chars_classes: int = 300
    min_words_common: int = 80
    max_class_distance: float = 0.20
    max_common_distance: float = 0.30


def _histograms(docs: DataFrame, text: str, lang: str | None, keep: list[str]) -> DataFrame:
    """keep plus working columns: words, n_words, word_chars, classes (array of counts), common (array of (vocabulary index, count))."""
    df = docs.select(*keep, F.col(text).alias(f"{P}text"), *([F.col(lang).alias(f"{P}lang")] if lang else []))
    df = df.withColumn(f"{P}words", words_of(F.col(f"{P}text")))
    w, t = F.col(f"{P}words"), F.col(f"{P}text")
    df = df.withColumns(
        {
            f"{P}n_words": F.size(w).cast("long"),
            f"{P}word_chars": F.length(F.array_join(w, "")).cast("long"),
            f"{P}n_chars": F.coalesce(F.length(t), F.lit(0)).cast("long"),
            f"{P}octets": F.coalesce(F.octet_length(t), F.lit(0)).cast("long"),
            f"{P}hits": F.filter(F.transform(w, F.lower), lambda x: x.isin(*VOCABULARY)),
            **{f"{P}{k}": F.coalesce(F.regexp_count(t, F.lit(r)), F.lit(0)).cast("long") for k, r in CLASSES.items()},
        }
    )
    n = {k: F.col(f"{P}{k}") for k in (*CLASSES, "n_chars", "word_chars", "octets")}
    space = n["n_chars"] - n["word_chars"]
    rest = n["word_chars"] - sum((n[k] for k in CLASSES), F.lit(0))
    index = F.create_map(*[x for i, v in enumerate(VOCABULARY) for x in (F.lit(v), F.lit(i))])
    common = let(F.col(f"{P}hits"), lambda h: F.transform(F.array_distinct(h), lambda v: F.struct(index[v].alias("i"), (F.size(h) - F.size(F.array_remove(h, v))).cast("long").alias("c"))))
    return df.withColumns({f"{P}classes": F.array(*[n[k] for k in CLASSES], space, n["octets"] - n["n_chars"], rest), f"{P}common": common})


def language_references(features: DataFrame, rules: QualityRules = QualityRules()) -> dict[str, dict[str, list[float]]]:
    """{language: {"classes": probabilities, "common": probabilities}} summed over all labelled rows of features(): one small row a language and bin."""
    f, lang = features.where(F.col(f"{P}lang").isNotNull()), f"{P}lang"
    bins = F.concat(F.col(f"{P}common"), F.transform(F.col(f"{P}classes"), lambda c, i: F.struct((-1 - i).alias("i"), c.alias("c"))), F.array(F.struct(F.lit(len(VOCABULARY)).alias("i"), F.col(f"{P}n_words").alias("c"))))
    sums = f.select(lang, F.explode(bins).alias("b")).groupBy(lang, F.col("b.i").alias("i")).agg(F.sum("b.c").alias("c"))
    got: dict[str, dict[int, int]] = {}
    for r in sums.where("c > 0").collect():
        got.setdefault(r[lang], {})[r["i"]] = r["c"]
    refs = {}
    for name, c in sorted(got.items()):
        words, total = c.get(len(VOCABULARY), 0), sum(v for i, v in c.items() if i < 0)
        if words and total:
            each = [c.get(i, 0) for i in range(len(VOCABULARY))]
            refs[name] = {"classes": [c.get(-1 - i, 0) / total for i in range(len(CLASSES) + 3)], "common": [x / words for x in [*each, words - sum(each)]]}
    return refs


def _literal(references: dict, kind: str) -> Column:
    """The references of one kind as a literal array of (q: probabilities, half: q/2 log q/2, base: distance of an empty histogram, squared)."""
    xlog = lambda x: x * math.log2(x) if x > 0 else 0.0
    rows = [{"q": r[kind], "half": [xlog(x / 2) for x in r[kind]], "base": sum(xlog(x) / 2 - xlog(x / 2) for x in r[kind])} for r in references.values()]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<q:array<double>,half:array<double>,base:double>>")


def _distance(counts: Column, total: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of a histogram from ref; counts has (bin, count) of the bins that aren't empty.

    H(m) - (H(p) + H(q)) / 2, as its value for an empty p plus what each bin of p changes."""

    def change(x: Column) -> Column:
        return let(x["c"] / total, lambda p: p * F.log2(p) / 2 - let((p + F.get(ref["q"], x["i"])) / 2, lambda m: m * F.log2(m)) + F.get(ref["half"], x["i"]))

    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(counts, ref["base"], lambda a, x: a + change(x))))


def _n_repeat(words: Column, window: int) -> Column:
    """Words in windows of the document that occur in it twice or more, the first included. Equal 64-bit hashes stand for equal windows."""

    def sorted_positions(hashes: Column) -> Column:
        return F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        n = F.size(s)
        same = lambda x, j: (j >= 0) & (j < n) & (F.get(s, j)["h"] == x["h"])
        return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"]))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-window).alias("last")), lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(window))).cast("long").alias("n"), i.alias("last")))["n"]

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - window), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))
    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(sorted_positions(h), lambda s: let(twice(s), covered))))
    return F.when(F.size(words) <= window, F.lit(0).cast("long")).otherwise(some)


def features(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs plus working columns (prefix P): lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, the histograms, sizes and base_failed."""
    df = _histograms(docs, text, lang, docs.columns)
    w, t, n = F.col(f"{P}words"), F.col(f"{P}text"), F.col(f"{P}n_words")
    lines = F.filter(F.coalesce(F.split(t, "\n"), F.array().cast("array<string>")), lambda x: x.rlike(WORD))
    df = df.withColumns(
        {
            f"{P}n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
            f"{P}n_repeat_words": let(w, lambda x: _n_repeat(x, rules.window)),
            f"{P}n_symbols": F.col(f"{P}symbol"),
        }
    )
    df = df.withColumn(f"{P}base_failed", (n < rules.min_words) | (100 * F.col(f"{P}n_repeat_words") > rules.repeat_percent * n))
    kept = ("lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "classes", "common", "n_chars", "octets")
    return df.select(*docs.columns, *[f"{P}{c}" for c in kept])


def judged(df: DataFrame, references: dict, rules: QualityRules = QualityRules()) -> DataFrame:
    """features() plus d_classes, d_common (distance to the nearest reference) and kept."""
    n = F.col(f"{P}n_words")
    total = F.greatest(F.lit(1), F.col(f"{P}octets")).cast("double")
    words = F.greatest(F.lit(1), n).cast("double")
    classes = F.filter(F.transform(F.col(f"{P}classes"), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["c"] > 0)
    other = F.aggregate(F.col(f"{P}common"), n, lambda a, x: a - x["c"])
    common = F.filter(F.concat(F.col(f"{P}common"), F.array(F.struct(F.lit(len(VOCABULARY)).alias("i"), other.alias("c")))), lambda x: x["c"] > 0)
    nearest = lambda counts, tot, k: let(counts, lambda c: F.least(F.array_min(F.transform(_literal(references, k), lambda r: _distance(c, tot, r))), F.lit(1.0))) if references else F.lit(0.0)
    df = df.withColumns({f"{P}d_classes": nearest(classes, total, "classes"), f"{P}d_common": nearest(common, words, "common")})
    far = ((F.col(f"{P}n_chars") >= rules.min_chars_classes) & (F.col(f"{P}d_classes") > rules.max_class_distance)) | (
        (n >= rules.min_words_common) & (F.col(f"{P}d_common") > rules.max_common_distance)
    )
    return df.withColumn(f"{P}kept", ~F.col(f"{P}base_failed") & ~far)


def assess(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """docs plus every working column. Texts are tokenised once: the features, with the columns of docs, are written to the shared folder, and the references and verdicts come from there."""
    f = written(features(docs, rules, text, lang), "quality")
    return judged(f, language_references(f, rules), rules)


def filter_documents(docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    inner = aliased(docs)
    return assess(inner, rules, at(docs, text), at(docs, lang)).where(f"{P}kept").select(*inner.columns).toDF(*docs.columns)


def quality_table(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document with its counts and verdict."""
    narrow = docs.select("doc_id", F.col("text").alias(f"{P}in_text"), F.col("lang").alias(f"{P}in_lang"))
    f = written(features(narrow, rules, f"{P}in_text", f"{P}in_lang").drop(f"{P}in_text", f"{P}in_lang"), "quality")
    j = judged(f, language_references(f, rules), rules)
    return j.select("doc_id", *[F.col(f"{P}{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])
