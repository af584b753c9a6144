"""Every operator on odd rows, empty tables and against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import LONG, PROSE

from lumenscan.llm import chat, components, html_text, langid, licenses, neardup, packing, pieces, quality, queries, shingles, token_files, topk

SF = "/root/testdata/sf0.001"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


# quality


def brute_repeat(words, k=5):
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    count, hit = Counter(grams), set()
    for i, g in enumerate(grams):
        if count[g] > 1:
            hit.update(range(i, i + k))
    return len(hit)


def test_quality_counts_on_odd_rows(odd_docs):
    rows = quality.quality_table(odd_docs).collect()
    texts = odd_docs.collect()
    assert len(rows) == len(texts)
    want = Counter()
    for r in texts:
        ws = SPLIT.findall(r.text or "")
        lines = [x for x in (r.text or "").split("\n") if SPLIT.search(x)]
        want[(r.doc_id, len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), brute_repeat(ws))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
    for r in rows:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_on_an_empty_table_and_passes_columns(no_docs, odd_docs):
    assert quality.quality_table(no_docs).count() == 0
    assert quality.filter_documents(no_docs).count() == 0
    assert quality.filter_documents(odd_docs).columns == odd_docs.columns


def test_quality_rejects_word_lists_and_symbols(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
    random.seed(3)
    common = "the of and to in is that it was for".split()
    prose = lambda: " ".join(random.choice(common) if random.random() < 0.45 else random.choice(words) + str(random.randrange(50)) for _ in range(150))
    good = [(i, prose(), "en") for i in range(30)]
    bad = [(100, " | ".join(random.choice(words) + str(random.randrange(999)) for _ in range(150)), "en"), (101, "### ".join(w + "$$$" for w in prose().split()), "en")]
    kept = {r.doc_id: r.kept for r in quality.quality_table(spark.createDataFrame(good + bad, "doc_id long, text string, lang string")).collect()}
    assert all(kept[i] for i, _, _ in good) and not kept[100] and not kept[101]


# language


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_language_id_ignores_labels_of_what_it_predicts(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, langid.identify(other).collect()))


def test_language_id_on_odd_rows(odd_docs, no_docs):
    rows = {r.doc_id: r for r in langid.identify(odd_docs).collect()}
    assert rows[3].lang_pred == rows[4].lang_pred == rows[5].lang_pred == rows[9].lang_pred == "und" and rows[3].score == 0.0
    assert rows[1].lang_pred in ("en", "de") and 0 <= rows[1].score <= 1
    assert langid.identify(no_docs).count() == 0
    assert langid.filter_documents(odd_docs).columns == odd_docs.columns


def test_unseen_words_back_off_to_shorter_grams(spark):
    docs = spark.createDataFrame([(1, "aba abab", "x"), (2, "cdc cdcd", "y")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert langid.score_texts(model, ["ababa", "dcdcd", "c", "zzz"])[0] == ["x", "y", "y", "x"]


# html


@pytest.mark.parametrize(
    "html, text",
    [
        (None, None),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("<ul><li>x<li>y<ol start=3><li>1<li>2</ol></ul>z", "- x\n- y\n  3. 1\n  4. 2\n\nz"),
        ("<table><tr><th>Name<th>N<tr><td>long name<td>3</table>", "Name       N\nlong name  3"),
        ("a<script>no('</p>')</script><style>x</style><!-- c --> b", "a b"),
        ("<div hidden>no</div><span style='display:none'>no</span>yes", "yes"),
        ("<pre>\n a\n   b</pre>", " a\n   b"),
        ("x &lt;b&gt; &amp; y<br>z", "x <b> & y\nz"),
        ("1 < 2 and <", "1 < 2 and <"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
    ],
)
def test_html_rendering(html, text):
    assert html_text.extract(html) == text


def test_html_of_any_depth_and_random_input():
    assert html_text.extract("<div>" * 20_000 + "deep") == "deep"
    random.seed(5)
    for _ in range(300):
        s = "".join(random.choice(["<", ">", "/", "p", "table", "td", "tr", "<li>", "</ul>", "<table>", "<td>", "a", " ", "&", "\"", "<!--"]) for _ in range(40))
        html_text.extract(s)


def test_html_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = html_text.extract_pages(pages).collect()
    assert len(rows) == pages.count() and all(r.text and "track(" not in r.text for r in rows)
    assert html_text.extract_pages(pages.limit(0)).count() == 0


# top-k


def brute_top_k(ids, x, queries_, k):
    out = []
    for q in queries_:
        s = sorted(((-int(x[q] @ x[j]), ids[j]) for j in range(len(ids)) if ids[j] != ids[q]))[:k]
        out += [(ids[q], r + 1, i, -v) for r, (v, i) in enumerate(s)]
    return out


@pytest.mark.parametrize("blocks", [(4096, 16384), (7, 60)])
def test_top_k_matches_brute_force(spark, blocks):
    r = np.random.default_rng(1)
    x = np.round(r.normal(size=(400, 8)) * 40).astype(int)  # many ties
    x[50] = x[51] = x[52]
    df = spark.createDataFrame([(i, [float(v) / 256 for v in row]) for i, row in enumerate(x.tolist())] + [(1000, None), (1050, [None] * 8), (1100, [float("nan")] * 8), (None, [0.0] * 8)], "vec_id long, embedding array<double>")
    o = topk.TopKOptions(query_block=blocks[0], candidate_block=blocks[1], leaf=8, cell_rows=blocks[1])
    got = sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0"), o).collect()))
    assert got == sorted(brute_top_k(list(range(400)), x, range(0, 400, 50), 5))


def test_top_k_with_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, -0.1]), (2, [3.0])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, df.where("vec_id % 50 = 0")).collect())) == [(0, 1, 1, 256 * 128)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_head_ends_without_its_end_tag():
    assert html_text.extract("<html><head><title>T</title><p>Hello<p>World") == "Hello\n\nWorld"
    assert html_text.extract("<head><meta charset=utf-8><style>x</style>\n<noscript><b>n</b></noscript>Text<div>more</div>") == "Text\nmore"
    assert html_text.extract("<head><template><p>no</p></template><title>T</title></head><body><p>yes") == "yes"
    assert html_text.extract("<head><title>T</title> only") == "only"


# licences


def brute_license(o, segment):
    words = licenses.normalised(segment)
    a = Counter(zip(words, words[1:]))
    best = None
    for name, text in sorted(o.templates):
        w = licenses.normalised(text)
        b = Counter(zip(w, w[1:]))
        if (n := sum(a.values()) + sum(b.values())) and (s := 2 * sum((a & b).values()) / n) >= o.min_score and (best is None or s > best[1]):
            best = (name, s)
    return best


def test_license_pruning_loses_nothing():
    o = licenses.LicenseOptions()
    scanner = licenses.Scanner(o)
    random.seed(2)
    for _, text in o.templates:
        for drop in (0.0, 0.05, 0.1, 0.3):
            s = " ".join(w for w in text.split() if random.random() >= drop)
            assert scanner.best(s) == brute_license(o, s)
    assert scanner.best("Released under the MIT License.")[0] == "MIT" and scanner.best("The cat sat under the mat.") is None


def test_license_scan_on_odd_rows(odd_docs, no_docs, spark):
    assert all(r.n_matches == 0 for r in licenses.scan_documents(odd_docs).collect())
    assert licenses.scan_documents(no_docs).count() == 0
    text = "Some words here.\nLicensed under the Apache License, Version 2.0.\nMore."
    r = licenses.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.licenses == ["Apache-2.0"] and text[r.matches[0].start : r.matches[0].end].startswith("Licensed")


def in_paragraphs(text, *ends):
    for e in ends:
        text = text.replace(e + " ", e + "\n\n")
    return text


def test_license_notices_inside_longer_texts():
    scanner = licenses.Scanner(licenses.LicenseOptions())
    mit = in_paragraphs(licenses._MIT, "conditions:", "Software.")
    prose = PROSE * 10
    text = f"MIT License\n\nCopyright (c) 2021 X\n\n{mit}\n\n{prose}"
    (name, score, start, end), = scanner.scan(text)
    assert name == "MIT" and score > 0.99 and text[start:end].startswith("Permission is") and text[start:end].endswith("IN THE SOFTWARE")
    text = "İ The tool is free. Released under the MIT License. See the docs."
    (name, score, start, end), = scanner.scan(text)
    assert (name, score, text[start:end]) == ("MIT", 1.0, "Released under the MIT License")
    for line in ("Copyright (c) 2021 X. Released under the MIT License.", "© 2021 X, Inc. All rights reserved. Released under the MIT License.", "Copyright 2021 X, released under the MIT License", "Released_under_the_MIT_License"):
        assert [f[0] for f in scanner.scan(line)] == ["MIT"], line
    for name in ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0", "Unlicense"):
        full = max((t for n, t in licenses.TEMPLATES if n == name), key=len)
        assert [f[0] for f in scanner.scan(prose + full + "\n" + prose)] == [name]
    assert [f[0] for f in scanner.scan(f"{prose} Licensed under CC BY-NC 4.0. {mit} Licensed under CC BY 4.0. {prose}")] == ["CC-BY-NC-4.0", "MIT", "CC-BY-4.0"]


def test_license_windows_equal_brute_force():
    """The best window of each template among all windows of all sizes."""
    short = tuple(t for t in licenses.TEMPLATES if len(t[1]) < 200)
    scanner = licenses.Scanner(licenses.LicenseOptions(templates=short))
    random.seed(3)
    for _ in range(60):
        words = PROSE.split()[:20]
        for _, t in random.choices(short, k=2):
            p = random.randrange(len(words))
            words[p:p] = [w for w in licenses.normalised(t) for _ in range(random.choices((0, 1, 2), (8, 87, 5))[0])]
        grams, got = list(zip(words, words[1:])), {}
        for score, t, i, j in scanner._candidates(words):
            own = scanner.bigrams[t]
            assert score == 2 * sum((Counter(grams[i:j]) & own).values()) / (j - i + sum(own.values()))
            got[t] = max(got.get(t, 0), score)
        want = {}
        for t, own in enumerate(scanner.bigrams):
            size = sum(own.values())
            s = max(2 * sum((Counter(grams[i:j]) & own).values()) / (j - i + size) for i in range(len(grams)) for j in range(i + 1, min(len(grams), i + 2 * size) + 1))
            if s >= 0.85:
                want[t] = s
        assert got == want


# chat


def chat_rows():
    random.seed(9)
    parts = ["<turn>", "</turn>", "\\", "\n", "a", "é😀", "</turn>\n", "<", "tur", "n>", "\\n", "### Assistant:"]
    rows = []
    for c in list(range(40)) + [None]:
        for t in range(random.randrange(1, 6)):
            rows.append((c, t, random.choice(["user", "assistant", "system", None, "o\nd<turn>"]), None if random.random() < 0.1 else "".join(random.choice(parts) for _ in range(random.randrange(9)))))
    rows += [(5, 0, "user", "tie"), (5, 0, "user", "tie")]
    return rows


def test_chat_round_trip(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_conversations(chat.with_control_conversation(df))).collect()}
    rows += [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    for c in {r[0] for r in rows}:
        own = sorted((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert got[c].n_turns == len(own)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == len({r[0] for r in rows})


def test_chat_parts_of_a_long_conversation(spark):
    df = spark.range(25_000).selectExpr("1L conv_id", "id turn", "'assistant' role", "concat('t', id) text")
    r = chat.conversation_digests(chat.format_conversations(df)).collect()
    assert len(r) == 1 and r[0].n_turns == 25_000 and r[0].loss_chars == sum(len(f"t{i}") for i in range(25_000))
    assert chat.format_conversations(df.limit(0)).count() == 0


# token files


def test_token_files_hold_the_library_ids(spark, odd_docs, no_docs, tmp_path):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    o = token_files.TokenFileOptions(queries.tokenizer_path("byte_bpe_50k.json"), group_tokens=5_000)
    t = Tokenizer.from_file(o.tokenizer)
    root = f"file://{tmp_path}/tokens"
    manifest = token_files.write_token_files(odd_docs, o, root)
    rows = sorted(token_files.read_token_files(spark, root, manifest).collect(), key=lambda r: r.start)
    want = {r.doc_id: [*t.encode(r.text or "", add_special_tokens=False).ids, 0] for r in odd_docs.collect()}
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda i: -1 if i is None else i)
    at = 0
    for r in rows:
        ids = np.array(want[r.doc_id], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    f = pq.ParquetFile(tmp_path / "tokens" / manifest[-1]["file"])
    c = f.metadata.row_group(0).column(2)
    assert "DELTA_BINARY_PACKED" in c.encodings and c.has_offset_index
    assert token_files.token_table(no_docs, o).count() == 0


def test_units_encode_as_the_whole_text():
    e = token_files.UnitEncoder(token_files.TokenFileOptions(queries.tokenizer_path("byte_bpe_50k.json"), memo=50))
    random.seed(1)
    parts = [*"ab 1'.,\n\t\r\x0b\x1c\x85\xa0é中ñ#", "'re", " '", "<|endoftext|>", "  ", "word.", " Über,"]
    for _ in range(3000):
        s = "".join(random.choice(parts) for _ in range(random.randrange(14)))
        assert np.frombuffer(e([s])[0], "<u4").tolist() == e.tokenizer.encode(s, add_special_tokens=False).ids, repr(s)


def test_plain_words_are_merged_as_the_library_does(tmp_path):
    import json

    path = queries.tokenizer_path("byte_bpe_50k.json")
    e = token_files.MergeEncoder(token_files.TokenFileOptions(path))
    random.seed(2)
    words = ["".join(random.choice("etaoinshrdluETAé") for _ in range(random.randrange(1, 14))) + random.choice(["", ".", ",", "***", "12", "-x"]) for _ in range(4000)]
    words += ["aaaaaaaaaaa", "zzzz", "ßÿɏ", "a" * 48, "11111a11", "#" * 30]
    texts = [" ".join(words[i : i + 40]) + "\n" + " ".join(words[i + 7 : i + 9]) + "x" for i in range(0, len(words), 40)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert {*e.first, *e.spaced} == {"\n"}  # the library was asked for no word
    odd = ["don't ‘stop’ " + "b" * 60, "a×b ÷ 中文 \x1c x", "<|endoftext|> a", "tab\there", "", " "]
    random.shuffle(words)
    odd += [f"{random.choice(odd)} {w}" for w in words[:200]]
    assert [np.frombuffer(x, "<u4").tolist() for x in e(odd)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    # a merge over the place where letters and digits meet: the library, which cuts there first, is asked for all
    j["model"]["vocab"]["a1"] = len(j["model"]["vocab"]) + 1
    j["model"]["merges"].append(["a", "1"])
    (tmp_path / "t.json").write_text(json.dumps(j), encoding="utf-8")
    over = token_files.MergeEncoder(token_files.TokenFileOptions(str(tmp_path / "t.json")))
    assert over.merges is None and [np.frombuffer(x, "<u4").tolist() for x in over(["a1 ba1c", "a1"])] == [over.tokenizer.encode(t, add_special_tokens=False).ids for t in ["a1 ba1c", "a1"]]


def test_packing_encodes_by_merges(odd_docs):
    o = packing.PackingOptions(queries.tokenizer_path("byte_bpe_50k.json"))
    assert packing.encoder(o).merges is not None and packing.encoder(o) is packing.encoder(o)


# near-duplicates


def brute_components(rows, k, percent=80):
    sets = {}
    for i, text in rows:
        w = SPLIT.findall((text or "").translate({a: a + 32 for a in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family_rows():
    random.seed(4)
    rows, n = [], 0
    for family in range(6):
        base = [f"w{random.randrange(5000)}" for _ in range(120)]
        for _ in range(random.choice([1, 2, 12, 40])):
            copy = list(base)
            for _ in range(random.randrange(0, 9)):
                copy[random.randrange(len(copy))] = f"x{random.randrange(10**6)}"
            rows.append((n, " ".join(copy)))
            n += 1
            if random.random() < 0.3:
                base = copy  # chains: far ends aren't similar, but linked
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(n + i, passage + " " + " ".join(f"u{i}q{j}" for j in range(150))) for i in range(30)]
    return rows + [(9000, None), (9001, ""), (9002, "Short One"), (9003, "short one"), (9004, "A b c"), (9005, rows[0][1].upper())]


@pytest.mark.parametrize("block", [16_384, 5])
def test_near_duplicates_match_brute_force(spark, block):
    rows = family_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in neardup.near_duplicates(df, neardup.NearDupOptions(shingle=4, block=block, links=8)).collect()}
    want = brute_components(rows, 4)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_near_duplicates_move_texts_of_a_family_once(spark, monkeypatch):
    """A large family in which most links fail: its texts used to be moved once for every pair that failed."""
    rnd, base = random.Random(5), [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"x{rnd.randrange(40)}" if rnd.random() < 0.04 else w for w in base)) for i in range(90)]
    moved, write = [], neardup.written
    monkeypatch.setattr(neardup, "written", lambda df, what: (out := write(df, what), moved.append(out.count()) if what == "wanted" else None)[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), neardup.NearDupOptions(shingle=4)).collect()}
    assert got == brute_components(rows, 4)
    assert 1 < len({c for _, c in got.values()}) < 90
    assert sum(moved) <= 90


def test_family_of_linked_classes_takes_few_comparisons():
    """The pipeline's stage of near-duplicates used to confirm about every pair of a family one by one."""
    o, rnd = neardup.NearDupOptions(), np.random.default_rng(8)
    base = np.arange(200, dtype=np.uint64)
    sets = [np.sort(np.append(rnd.choice(base, 188, replace=False), rnd.integers(1000, 10**6, 2, dtype=np.uint64))) for _ in range(300)]
    alone = np.arange(150, 350, dtype=np.uint64)
    root = np.arange(301)
    compared = neardup._forest([*sets, alone], root, np.zeros(301, int), o)
    assert len(set(root[:300])) == 1 and root[300] != root[0]
    assert compared < 10 * 301
    halves = neardup._joined(list(range(301)), [0] * 150 + [1] * 151, [*sets, alone], o)
    assert sorted(map(tuple, halves.tolist())) == [(0, i) for i in range(1, 300)]


def test_stars_that_are_near_give_one_link():
    """Two stars of one posting list whose members reach each other: used to give every pair of members."""
    o, rnd = neardup.NearDupOptions(), np.random.default_rng(3)
    a, b = rnd.integers(0, 256, (2, 64), dtype=np.uint8)
    middle = np.where(np.arange(64) < 32, a, b)
    at = lambda x, y: np.where(np.arange(64) < y, x, middle)
    sig = np.array([a, b, *(at(a, 36) for _ in range(20)), *(np.where(np.arange(64) >= 28, b, a) for _ in range(20))], np.uint8)
    i, j = neardup._stars(np.zeros(42, np.int64), np.full(42, 100), sig, o)
    assert len(i) == 41
    assert all((sig[x] == sig[y]).sum() >= o.least for x, y in zip(i, j))


def test_near_duplicates_on_odd_rows(odd_docs, no_docs):
    rows = neardup.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[2].component_id == 1 and by[8].component_id == 7 and by[3].n_shingles == 0 and by[None].component_id is None
    assert neardup.near_duplicates(no_docs).count() == 0
    kept = neardup.filter_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, None, 9, 10], key=str)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160)) and got[301] == 300


def test_shingle_hashes_separate_words_texts_and_case():
    a, b, c, d = shingles.shingle_sets(pa.array(["A bc d e f", "a bc d e f", "ab c d e f", None]), 4)
    assert (a == b).all() and not set(a) & set(c) - set(a[1:]) and len(d) == 0 and len(a) == 2


# packing


def test_best_fit_takes_the_tightest_compatible_bin():
    random.seed(6)
    fit, bins = packing.BestFit(64), []
    for _ in range(800):
        n, s, c = random.randrange(1, 65), random.choice(["hot", "hot", None, *"abcdefg"]), random.choice([None, *range(30)])
        fits = [(64 - sum(x[0] for x in b), i) for i, b in enumerate(bins) if n < 64 and 64 - sum(x[0] for x in b) >= n and not any(s is not None and s == x[1] or c is not None and c == x[2] for x in b)]
        want = min(fits)[1] if fits else len(bins)
        if want == len(bins):
            bins.append([])
        got, offset = fit.add(n, s, c)
        assert (got, offset) == (want, sum(x[0] for x in bins[want]))
        bins[want].append((n, s, c))


def test_packing_holds_all_tokens_and_conflicts(odd_docs, no_docs):
    from tokenizers import Tokenizer

    o = packing.PackingOptions(queries.tokenizer_path("byte_bpe_50k.json"), capacity=128, shard_items=8)
    t = Tokenizer.from_file(o.tokenizer)
    items = {(r.doc_id, r.piece): r for r in packing.items(odd_docs, o).collect()}
    bins = packing.pack_documents(odd_docs, o).collect()
    held = Counter()
    for b in bins:
        at = 0
        for p in b.pieces:
            assert p.bin_start == at and b.ids[2 * at : 2 * (at + p.n_tokens)] == items[p.doc_id, p.piece].ids
            at += p.n_tokens
            held[p.doc_id, p.piece] += 1
        assert at == b.n_tokens == len(b.ids) // 2 <= 128
        for what in ("source", "cluster"):
            seen = [v for p in b.pieces if (v := getattr(items[p.doc_id, p.piece], what)) is not None]
            assert len(seen) == len(set(seen))
    assert held == Counter((r.doc_id, r.piece) for r in packing.items(odd_docs, o).collect()) and len({b.bin for b in bins}) == len(bins)
    for r in odd_docs.collect():
        ids = b"".join(items[r.doc_id, n].ids for n in range(sum(k[0] == r.doc_id for k in items)))
        assert np.frombuffer(ids, "<u2").tolist() == [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
    assert packing.pack_documents(no_docs, o).count() == 0 and packing.piece_table(packing.pack_documents(no_docs, o)).count() == 0


def test_packing_keeps_near_duplicates_apart(spark):
    from pyspark.sql import functions as F

    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(w if j != i else "other" for j, w in enumerate(base)), f"s{i}") for i in range(20)] + [(100 + i, f"some text {i}", f"t{i}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    near = neardup.near_duplicates(docs).select("doc_id", F.col("component_id").alias("cluster"))
    o = packing.PackingOptions(queries.tokenizer_path("byte_bpe_50k.json"))
    bins = packing.pack_documents(docs.join(near, "doc_id"), o, cluster="cluster").collect()
    assert len(bins) == 20 and all(sum(p.doc_id < 100 for p in b.pieces) == 1 for b in bins)
    pieces_ = {(r.doc_id, r.piece): r for r in packing.piece_table(packing.pack_documents(docs, o)).collect()}
    own = {(r.doc_id, r.piece): r for r in packing.items(docs, o).collect()}
    assert {k: r.ids_crc32 for k, r in pieces_.items()} == {k: zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for k, r in own.items()}


# SentencePiece


def test_pieces_are_those_of_the_library(odd_docs, no_docs):
    o = pieces.PieceOptions(queries.tokenizer_path("piece_bpe_32k.model"))
    m = pieces.Model(o.model)
    e = pieces.Encoder(m, o)
    random.seed(1)
    parts = [*"abcdehtinsor  '.,\n\t12é中ñ😀▁\x00", "the", "ing", " and", "ion"]
    for _ in range(3000):
        s = "".join(random.choice(parts) for _ in range(random.randrange(16)))
        ids = np.frombuffer(e([s])[0], "<u4").tolist()
        assert ids == m.library.encode(s) and m.decode(ids) == m.library.decode(ids)
    rows = {r.doc_id: r for r in pieces.piece_table(odd_docs, o).collect()}
    assert rows[7].n_pieces == len(m.library.encode(LONG)) and rows[7].round_trip and rows[3].n_pieces is None and rows[4].n_pieces == 0
    encoded = pieces.encode_documents(odd_docs, o)
    assert {r.doc_id: r.text for r in pieces.decode_documents(encoded, o).collect()}[1] == PROSE * 2
    assert pieces.piece_table(no_docs, o).count() == 0


def test_unigram_viterbi_finds_the_greatest_sum():
    e = pieces.Encoder.__new__(pieces.Encoder)
    dict.__init__(e)

    class M:
        kind, longest, least, unknown, bytes = pieces.UNIGRAM, 3, -20.0, 0, {}
        score = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -3.9, "aba": -6.4, "bb": -9.0}
        ids = {p: i + 1 for i, p in enumerate(score)}

    e.model, e.o = M, pieces.PieceOptions("")

    def brute(w):
        if not w:
            return 0.0, []
        return max(((s + brute(w[len(p) :])[0], [p, *brute(w[len(p) :])[1]]) for p, s in M.score.items() if w.startswith(p)), key=lambda x: x[0])

    words = ["".join(random.choice("ab") for _ in range(n)) for n in range(1, 9) for _ in range(6)]
    e.learn(words)
    back = {v: k for k, v in M.ids.items()}
    for w in words:
        assert sum(M.score[back[i]] for i in np.frombuffer(e[w], "<u4").tolist()) == pytest.approx(brute(w)[0])


# pipeline


def test_pipeline_stages_take_effect(spark, odd_docs):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = c.keep_good_quality(spark, docs, SF)
    verdict = {r.doc_id: r.kept for r in quality.quality_table(docs).collect()}
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {i for i, k in verdict.items() if k}
    packed = c.run(spark, SF).collect()
    kept = {r.doc_id for r in packed}
    assert kept <= {i for i, k in verdict.items() if k}
    want = brute_components([(r.doc_id, r.text) for r in docs.collect() if verdict[r.doc_id]], 5)
    assert kept == {i for i, (_, root) in want.items() if i == root}
    for _, stage in c.STAGES:
        odd_docs = stage(spark, odd_docs, SF)
    assert odd_docs.count() > 0


def test_pipeline_packing_asks_the_library_for_no_plain_word(spark, monkeypatch):
    import corpus_pipeline as c

    docs, options, pack = spark.createDataFrame([(1, "some words", "a")], "doc_id long, text string, source string"), [], packing.pack_documents
    monkeypatch.setattr(packing, "pack_documents", lambda d, o: options.append(o) or pack(d, o))
    assert c.pack_bins(spark, docs, SF).count() == 1
    e = packing.encoder(options[0])
    for n in (100, 10_000):  # however many words there are
        e([" ".join(f"w{i}x{n}." for i in range(n))])
        assert {*e.first, *e.spaced} <= {"\n"}
