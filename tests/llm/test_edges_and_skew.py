"""Odd names, odd rows and skew: hot copies, hot keys, clustered vectors, and operators against plain restatements."""

import math
import random
import re
import unicodedata
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_operators import SF, brute_components

from lumenscan.llm import _common, chat, components, html_text, langid, licenses, neardup, packing, pieces, quality, queries, token_files, topk


@pytest.fixture(scope="session")
def named_docs(odd_docs):
    """odd_docs with dotted, quoted and working names."""
    return odd_docs.selectExpr("*", "1 AS `a.b`", "'x' AS `_ls_text`", "2 AS `_ls_gone`", "3 AS `_ls_0`", "4 AS `c d`", "5 AS bin", "6 AS shard")


@pytest.mark.parametrize("keep", [quality.filter_documents, langid.filter_documents, neardup.filter_documents])
def test_filters_pass_columns_of_any_name(named_docs, odd_docs, keep):
    got = keep(named_docs)
    assert got.columns == named_docs.columns
    assert sorted(got.select("doc_id", "text").collect(), key=str) == sorted(keep(odd_docs).select("doc_id", "text").collect(), key=str)


def test_operators_ignore_other_columns(named_docs, odd_docs, spark):
    t = queries.tokenizer_path("byte_bpe_50k.json")
    for f in (
        langid.identify,
        licenses.scan_documents,
        quality.quality_table,
        lambda d: pieces.piece_table(d, pieces.PieceOptions(queries.tokenizer_path("piece_bpe_32k.model"))),
        lambda d: token_files.token_table(d, token_files.TokenFileOptions(t)).drop("start"),
        lambda d: packing.piece_table(packing.pack_documents(d, packing.PackingOptions(t))).select("doc_id", "piece", "ids_crc32"),
        lambda d: html_text.extract_pages(d, "text", "doc_id"),
    ):
        assert sorted(map(str, f(named_docs).collect())) == sorted(map(str, f(odd_docs).collect()))
    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(120)], "vec_id long, embedding array<double>")
    w = v.selectExpr("*", "1 AS id", "2 AS v", "3 AS `a.b`", "4 AS length", "5 AS cell")
    assert sorted(topk.top_k(v, v.where("vec_id % 50 = 0")).collect()) == sorted(topk.top_k(w, w.where("vec_id % 50 = 0")).collect())
    c = spark.createDataFrame([(1, 0, "user", "x" * 3_000_000 + "<turn>"), (1, 1, "assistant", "y" * 3_000_000)], "conv_id long, turn long, role string, text string")
    d = c.selectExpr("*", "1 AS part", "2 AS formatted", "3 AS `a.b`")
    one, two = (chat.conversation_digests(chat.format_conversations(x)).collect() for x in (c, d))
    assert one == two and one[0].loss_chars == 3_000_000


def test_working_tables_go(spark):
    since = _common.mark()
    df = _common.written(spark.range(5).toDF("x"), "some")
    (path,) = _common._working[since:]
    assert df.count() == 5
    _common.clean(spark, since)
    assert path not in _common._working
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def test_a_cluster_needs_a_shared_folder():
    session = lambda master, **conf: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: conf.get(k.replace(".", "_"), d)), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        _common.shared_dir(session("spark://x"))
    assert _common.shared_dir(session("spark://x", spark_checkpoint_dir="hdfs://n/shared/")) == "hdfs://n/shared"
    assert _common.shared_dir(session("local[4]")).startswith("file:///")


def test_pieces_of_a_null_decode_to_a_null(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode_documents(df, pieces.PieceOptions(queries.tokenizer_path("piece_bpe_32k.model"))).collect()} == {1: None, 2: ""}


def test_equal_rows_are_spread_over_token_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("7L AS doc_id", "'the same words' AS text")
    o = token_files.TokenFileOptions(queries.tokenizer_path("byte_bpe_50k.json"))
    manifest = token_files.write_token_files(rows, o, f"file://{tmp_path}/t")
    assert sum(m["rows"] for m in manifest) == 4000 and len(manifest) > 1


# language


def brute_language(rows, text, max_order=5, penalty=-7.0):
    """Language and score by dictionaries."""

    def runs(s):
        out, now = [], ""
        for c in s.lower() + " ":
            if unicodedata.category(c)[0] == "L":
                now += c
            elif now:
                out.append(now)
                now = ""
        return out

    names = sorted({x for _, x in rows})
    counts = {o: {x: Counter() for x in names} for o in range(max_order + 1)}
    for t, x in rows:
        for w in runs(t):
            counts[0][x][w] += 1
            m = f" {w} "
            for o in range(1, max_order + 1):
                counts[o][x].update(m[i : i + o] for i in range(len(m) - o + 1))
    log = lambda o, x, g: max(math.log10(n / sum(counts[o][x].values())), penalty) if (n := counts[o][x][g]) else penalty
    known = lambda o, g: any(counts[o][x][g] for x in names)
    total, ws = dict.fromkeys(names, 0.0), runs(text)
    if not ws:
        return "und", 0.0
    for w in ws:
        if known(0, w):
            scores = {x: log(0, x, w) for x in names}
        else:
            m, scores = f" {w} ", dict.fromkeys(names, penalty)
            for o in range(max_order, 0, -1):
                hits = [g for i in range(len(m) - o + 1) if known(o, g := m[i : i + o])]
                if hits:
                    scores = {x: sum(log(o, x, g) for g in hits) / len(hits) for x in names}
                    break
        for x in names:
            total[x] += scores[x] / len(ws)
    best = max(names, key=lambda x: total[x])
    return best, 1 / sum(10 ** (total[x] - total[best]) for x in names)


def test_language_scores_equal_brute_force(spark):
    random.seed(8)
    draw = lambda alphabet, n: " ".join("".join(random.choice(alphabet) for _ in range(random.randrange(1, 8))) for _ in range(n))
    alphabets = {"x": "abcdeé", "y": "defghß", "z": "ghiÀЖ中"}
    rows = [(draw(a, 30), x) for x, a in alphabets.items() for _ in range(8)]
    model = langid.fit(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string"))
    assert model.languages == ["x", "y", "z"]
    texts = [draw(random.choice([*alphabets.values(), "abghЖqq1²½_"]), random.randrange(1, 9)) for _ in range(300)] + ["² ½ ⑤ 12", "Ⅷ", "a²b"]
    names, scores = langid.score_texts(model, texts)
    for t, name, score in zip(texts, names, scores):
        want = brute_language(rows, t)
        assert score == pytest.approx(want[1], rel=1e-4), t
        assert name == want[0] or want[1] < 0.51, t
    assert names[-3:-1] == ["und", "und"] and scores[-3] == 0 and names[-1] != "und"


def test_every_language_is_learned(spark):
    rows = [(i, " ".join(chr(0x4E00 + 50 * i + k) for k in range(20)), f"l{i:03}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert len(model.languages) == 150
    assert langid.score_texts(model, [t for _, t, _ in rows])[0] == [x for _, _, x in rows]


def test_quality_has_a_reference_of_every_language(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    random.seed(1)
    rows = [(i, " ".join(random.choice(words) for _ in range(100)), f"l{i % 80}") for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    f = quality.features(docs)
    assert len(quality.language_references(f)) == 80


# html


def random_page(depth, words, rng):
    """A well-formed page whose visible words are appended to words, in order."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(9) if depth else 0
        if kind <= 1:
            w = f"w{len(words)}"
            words.append(w)
            out.append(f" {w} ")
        elif kind == 2:
            out.append(f"<script>no{rng.random()}</script><!-- no --><style>no</style>")
        elif kind == 3:
            out.append(f"<p hidden>{random_page(0, [], rng)}</p>")
        elif kind == 4:
            cells = "".join(f"<tr>{''.join(f'<td colspan={chr(34)}{rng.choice(BAD)}{chr(34)}>{random_page(depth - 1, words, rng)}</td>' for _ in range(2))}</tr>" for _ in range(2))
            out.append(f"<table>{cells}</table>")
        elif kind == 5:
            out.append(f"<ul start='{rng.choice(BAD)}'>" + "".join(f"<li>{random_page(depth - 1, words, rng)}</li>" for _ in range(2)) + "</ul>")
        else:
            tag = rng.choice("div p section b i span h2 blockquote a".split())
            inner = random_page(depth - 1, words, rng) if tag not in ("p", "h2") else f" w{words.append(f'w{len(words)}') or len(words) - 1} "
            out.append(f"<{tag} {rng.choice(ODD)}>{inner}</{tag}>")
    return "".join(out)


BAD = ["1", "2", "²", "--3", "", "x", "9" * 5000, "-1", " 3 ", "1000000", "+2"]
ODD = ["a", "a=b", "style=color:red", "class='x y'", 'title="a > b"', "data-hidden=1", "x=²", "="]


def test_html_emits_all_visible_words_in_order():
    rng = random.Random(12)
    for _ in range(300):
        words = []
        page = random_page(5, words, rng)
        assert [w for w in html_text.extract(page).split() if re.fullmatch(r"w\d+", w)] == words, page


def test_html_odd_attributes_and_depth():
    assert html_text.extract('<ol start="--3"><li>a</ol>') == html_text.extract('<ol start="²"><li>a</ol>') == "1. a"
    assert html_text.extract('<ol start="-3"><li>a<li>b</ol>') == "-3. a\n-2. b"
    for span in ("²", "9" * 5000, "x", "0"):
        assert html_text.extract(f'<table><tr><td colspan="{span}">a<td>b</table>').split() == ["a", "b"]
    assert html_text.extract("<b>" * 600 + "<table><tr><td>a<td>b</table>") == "a  b"
    assert html_text.extract("<table><tr><td>" * 3000 + "deep") == "deep"
    assert len(html_text.extract("<ul><li>a" * 3000).split("\n")) == 3000
    assert html_text.extract("<table><tr><td>x<table><tr><td>in<td>n</table><td>y</table>") == "x in n  y"


def test_html_table_rows(spark):
    rows = [(1, None), (2, ""), (3, "<p>a"), (3, "<p>a"), (None, "<p>b")]
    pages = spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS `a.b`")
    assert sorted(map(tuple, html_text.extract_pages(pages).collect()), key=str) == sorted([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b")], key=str)


# top-k


def clustered(n, clusters=100, d=16, seed=3):
    r = np.random.default_rng(seed)
    return np.floor(r.normal(size=(clusters, d))[r.integers(0, clusters, n)] * 400 + r.normal(size=(n, d)) * 8)


def test_dual_tree_prunes_clusters_and_stays_exact():
    x, o = clustered(6000), topk.TopKOptions()
    ids, q = np.arange(6000), np.arange(0, 6000, 50)
    best = topk.dual_tree(x[q], q, x, ids, o)
    s = (x[q] @ x.T).astype(np.int64)
    for i, own in enumerate(q):
        order = [j for j in np.lexsort((ids, -s[i])) if j != own][:5]
        assert best.id[i].tolist() == order and best.score[i].tolist() == s[i][order].tolist()
    assert best.compared < 0.1 * len(q) * len(x)


def test_cover_tree_covers():
    x = clustered(3000)
    stack = [topk.cover_tree(x, 8, 3.0)]
    assert len(stack[0].children) > 1
    while stack:
        n = stack.pop()
        assert np.sqrt(((x[n.rows] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-6 and (x[n.rows] == n.centre).all(1).any()
        if n.children:
            assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
            c = np.array([c.centre for c in n.children])
            assert all(k.radius <= n.radius / 3.0 + 1e-6 for k in n.children)
            gap = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) + np.eye(len(c)) * 1e9
            assert gap.min() > n.radius / 3.0 - 1e-6
        stack += n.children


def test_cells_are_skipped_and_copies_cost_nothing(spark):
    x = clustered(4000) / 256
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, x[7].tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    o = topk.TopKOptions(cell_rows=100)
    assert topk.quantised(df, o).count() == 7000
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 50 = 0"), o).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, v = np.array([i for i, _ in rows]), np.floor(np.array([v for _, v in rows]) * 256)
    for own in ids[ids % 50 == 0]:
        s = (v @ v[np.flatnonzero(ids == own)[0]]).astype(np.int64)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != own][:5]
        assert sorted(got[own]) == [(k + 1, ids[j], s[j]) for k, j in enumerate(order)]


# near-duplicates


def test_one_text_repeated_and_a_hot_posting(spark):
    """A third of all rows one text, and a passage that makes hot postings, with hot keys taken apart from 500 rows on."""
    copies = spark.range(200_000).selectExpr("id AS doc_id", "'one and the same short text of some ten words or so' AS text")
    passage = " ".join(f"p{i}" for i in range(40))
    shared = spark.range(3000).selectExpr("1000000 + id AS doc_id", f"concat('{passage} ', array_join(transform(sequence(1, 50), i -> concat('u', id, 'q', i)), ' ')) AS text")
    o = neardup.NearDupOptions(hot=500)
    got = neardup.near_duplicates(copies.unionByName(shared), o)
    r = got.groupBy("component_id").count().where("count > 1").collect()
    assert [(x["component_id"], x["count"]) for x in r] == [(0, 200_000)]
    assert got.where("kept").count() == 3001


def test_components_of_a_hot_star(spark):
    links = spark.range(1, 5000).selectExpr("0L AS a", "id AS b").unionByName(spark.range(1, 50).selectExpr("4999L AS a", "10000 + id AS b"))
    assert [tuple(r) for r in components.components(links, hot=100).groupBy("root").count().collect()] == [(0, 5049)]


def test_planted_pairs_are_found(spark):
    """Recall over pairs of a similarity just above the limit, in documents that share a passage."""
    random.seed(11)
    passage, rows = [f"s{i}" for i in range(25)], []
    for i in range(400):
        own = [f"d{i}w{j}" for j in range(175)]
        near = list(own)
        for j in random.sample(range(175), 3):
            near[j] = f"x{i}y{j}"
        rows += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + near))]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {i: root for i, (_, root) in brute_components(rows[:200], 5).items()}
    assert {i: got[i] for i in want} == want
    assert sum(got[2 * i + 1] == 2 * i for i in range(400)) >= 399


def test_frequent_values_are_not_posted(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.range(2000).selectExpr("id AS doc_id", f"concat('{passage} ', array_join(transform(sequence(1, 90), i -> concat('u', id, 'q', i)), ' ')) AS text")
    o = neardup.NearDupOptions()
    classes = neardup.signatures(docs, o).selectExpr("doc_id AS rep", "n", "sig")
    frequency = spark.sparkContext.broadcast(neardup._counted(classes, o))
    longest = neardup._postings(classes, frequency, o).groupBy("key").count().agg(F.max("count")).first()[0]
    assert longest < 1000


# pipeline


def test_pipeline_language_stage_drops_what_has_no_language(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(10**6, "1 2 3 4 5 6 7 8 9 10 11 12 13", None, "s", 1), (10**6 + 1, None, "en", "s", 1), (10**6 + 2, "² ½ " * 20, "en", "s", 1)], docs.schema)
    kept = {r.doc_id for r in c.keep_known_language(spark, docs.unionByName(odd), SF).select("doc_id").collect()}
    assert not kept & {10**6, 10**6 + 1, 10**6 + 2}
    assert len(kept) > 0.95 * docs.count()


def test_pipeline_stages_take_columns_of_any_name(spark, named_docs):
    import corpus_pipeline as c

    docs = named_docs
    for _, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == named_docs.columns
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert kept and {r.doc_id for r in c.STAGES[-1][1](spark, docs, SF).collect()} == kept


def test_pipeline_deletes_what_it_worked_with(spark):
    import corpus_pipeline as c

    since = _common.mark()
    out = c.run(spark, SF)
    assert len(_common._working) <= since + 1 and out.count() > 0
