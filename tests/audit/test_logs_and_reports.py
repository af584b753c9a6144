"""Signing keys, logs, time stamps, sealed reports, statements, sinks, links and setup scripts."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from lumenscan.functions import log, signing, timestamps
from lumenscan.operators import archives, cbom, egress, keys, manifests, merkle, setup_scripts
from lumenscan.plans import reports, sinks
from lumenscan.sources import lineage, pyfacts, tree


def scan(spark, files):
    texts = spark.createDataFrame(list(files.items()), "rel string, text string")
    return texts, pyfacts.py_facts(texts)


# signatures


def test_a_leaf_is_spent_once(tmp_path):
    key = signing.SigningKey.create(tmp_path / "key.json", 2)
    first = key.sign(b"a")
    assert signing.verify(b"a", first, key.public_root) and not signing.verify(b"b", first) and not signing.verify(b"a", first, "0" * 64)
    again = signing.SigningKey.load(tmp_path / "key.json")
    assert again.public_root == key.public_root and again.next_index == 1
    second = again.sign(b"b")
    assert key.sign(b"c")["leaf_index"] == 2 and second["leaf_index"] == 1  # the file is what counts
    with pytest.raises(signing.SpentLeaf):
        again.sign(b"d", leaf=0)
    again.advance(4)
    with pytest.raises(signing.SpentLeaf):
        key.sign(b"e")
    with pytest.raises(FileExistsError):
        signing.SigningKey.create(tmp_path / "key.json", 2)
    os.link(tmp_path / "key.json", tmp_path / "other.json")
    with pytest.raises(ValueError):
        key.sign(b"f")


def test_malformed_signatures_don_t_hold():
    key = signing.SigningKey(2, seed=b"s" * 32)
    good = key.sign(b"m")
    assert signing.verify(b"m", good)
    for change in ({"height": 3}, {"leaf_index": 4}, {"leaf_index": True}, {"ots": good["ots"][:-1]}, {"auth_path": good["auth_path"][::-1]}, {"algorithm": "x"}, {"extra": 1}, {"public_root": good["public_root"].upper()}):
        assert not signing.verify(b"m", good | change), change
    assert not signing.verify(b"m", {k: v for k, v in good.items() if k != "height"}) and not signing.verify(b"m", None)


def test_trees_of_keys_are_made_by_tasks(spark):
    key = signing.SigningKey(3, seed=b"q" * 32)
    rows = sorted((r.idx, bytes(r.hash)) for r in signing.leaf_nodes(spark, key.seed, 3).collect())
    assert [h for _, h in rows] == key.tree[0]


# logs


def roots(n):
    return [merkle.mth([hashlib.sha256(b"\0%d" % i).digest() for i in range(m)]) for m in range(n + 1)]


def test_consistency_of_all_small_trees():
    leaves = [hashlib.sha256(b"\0%d" % i).digest() for i in range(20)]
    root = roots(20)
    for new in range(1, 21):
        for old in range(1, new + 1):
            path = merkle.consistency_path(leaves[:new], old) if old < new else []
            assert merkle.verify_consistency(old, new, root[old], root[new], path), (old, new)
            if old < new:
                assert not merkle.verify_consistency(old, new, root[old], root[new - 1], path)
                assert not merkle.verify_consistency(old, new, root[old - 1], root[new], path)
                assert not merkle.verify_consistency(old, new, root[old], root[new], [*path, b"x" * 32])
    assert merkle.verify_consistency(0, 5, root[0], root[5], []) and not merkle.verify_consistency(5, 4, root[5], root[4], [])


def test_log_append_proofs_and_forks(tmp_path):
    key = signing.SigningKey(4, seed=b"k" * 32)
    vkey = log.verifier_key("signer.example", key.public_root)
    assert log.read_verifier_key(vkey)[2] == key.public_root
    l = log.Log(tmp_path / "log", "log.example", vkey)
    lines = [log.entry(hashlib.sha256(b"f%d" % i).hexdigest(), hashlib.sha256(b"c%d" % i).hexdigest()) for i in range(300)]
    l.append(lines[:3], key, "signer.example")
    one = (tmp_path / "log/checkpoint").read_text()
    l.append(lines[3:], key, "signer.example")
    assert l.head() == (300, merkle.mth([log.leaf(x) for x in lines])) and l.intact()
    proof = l.proof(257)
    f, c = (hashlib.sha256(b"%s257" % x).hexdigest() for x in (b"f", b"c"))
    assert log.proof_holds(proof, f, c, vkey) is True and log.proof_holds(proof, c, f, vkey) is None
    assert log.proof_holds(proof | {"index": 3}, f, c, vkey) is False
    other = log.Log(tmp_path / "two", "log.example", vkey)
    other.append(lines[10:13], key, "signer.example")
    two = (tmp_path / "two/checkpoint").read_text()
    assert log.forked(one, two, vkey) is True and log.forked(one, one, vkey) is False and log.forked(one, proof["checkpoint"], vkey) is None
    tile = tmp_path / "log" / log.tile_name("entries", 0, 256)
    tile.write_bytes(tile.read_bytes().replace(lines[5], lines[6]))
    assert not l.intact()
    with pytest.raises(log.LogError):
        l.append(lines[:1], key, "signer.example")


@pytest.mark.parametrize("note", ["", "a\n", "a\n\n", "o\n3\nx\n\n- n AAAA\n", "o\n3\nx\n\n— n AAA\n", "o\t\n\n— n AAAA\n"])
def test_bad_notes(note):
    with pytest.raises(log.LogError):
        log.split_note(note)


def test_tile_names_and_sql_agree(spark):
    cases = [(0, 0, 256), (1, 1_234_067, 256), (2, 999, 5), (0, 1000, 255)]
    df = spark.createDataFrame(cases, "l int, i long, w int").select(merkle.tile_path(F.col("l"), F.col("i"), F.col("w")))
    assert [r[0] for r in df.collect()] == [log.tile_name(*x) for x in cases] and log.tile_name(1, 1_234_067, 256) == "tile/1/x001/x234/067"


def test_numbers_within_one_large_group(spark):
    df = spark.range(5000).selectExpr("'g' AS g", "(id * 7919) % 5000 AS v")
    rows = lineage.numbered(df.repartition(7), ["g"], ["v"]).collect()
    assert all(r.idx == r.v for r in rows) and len(rows) == 5000


# time stamps


def test_time_stamps():
    d = hashlib.sha256(b"x").digest()
    req, nonce = timestamps.request(d)
    assert timestamps.is_request(req) and not timestamps.stamps(req, d)
    for bare in (False, True):
        t = timestamps.token(d, nonce, bare=bare)
        assert timestamps.stamps(t, d, nonce) and not timestamps.stamps(t, d, nonce + 1) and not timestamps.stamps(t, b"y" * 32)
        assert timestamps.imprint_and_nonce(timestamps.token(d, None, bare=bare)) == (d, timestamps.NO_NONCE)
        assert not any(timestamps.stamps(t[:n], d, nonce) for n in range(len(t)))
    assert timestamps.integer(128) == b"\2\2\0\x80" and timestamps.integer(0) == b"\2\1\0" and timestamps.der(4, b"a" * 200)[:3] == b"\4\x81\xc8"
    assert timestamps.oid(timestamps.SHA256) == bytes.fromhex("0609608648016503040201")


# reports


def test_reports_are_sealed_read_and_attested():
    key = signing.SigningKey(2, seed=b"r" * 32)
    plain = {"tool": "keys", "verdict": "REVIEW", "findings": [{"file": "a|b", "line": 1}], "not_scanned": {}}
    signed, unsigned = reports.sealed(plain, key), reports.sealed(plain)
    assert reports.report_status(unsigned) == "UNSIGNED" and reports.report_status(signed) == "UNVERIFIED"
    assert reports.report_status(signed, key.public_root) == "ATTESTED" and reports.report_status(signed, "0" * 64) == "TAMPERED"
    assert reports.report_status(signed | {"verdict": "x"}) == "TAMPERED" and reports.report_status({k: v for k, v in signed.items() if k != "signature"}) == "TAMPERED"
    data = json.dumps(signed).encode()
    assert reports.read_report(data, "keys") == signed
    for bad in (b"\xef\xbb\xbf" + data, data.replace(b"REVIEW", b"CLEAN!"), b'{"tool": "keys", "tool": "keys"}', json.dumps(unsigned | {"tool": "x"}).encode()):
        with pytest.raises(ValueError):
            reports.read_report(bad, "keys")
    s = reports.statement("tree", signed["content_hash"], signed, "https://p.example.invalid/v1")
    ok = lambda x, root=None: reports.statement_status(x, "https://p.example.invalid/v1", root)
    assert ok(s, key.public_root) == "ATTESTED" and ok(s) == "UNVERIFIED"
    assert ok(s | {"more": 1}) == ok(s | {"predicate": s["predicate"] | {"verdict": "x"}}) == ok({k: v for k, v in s.items() if k != "signature"}) == "TAMPERED"
    u = reports.statement("tree", unsigned["content_hash"], unsigned, "https://p.example.invalid/v1")
    assert ok(u) == "UNSIGNED"


def test_csaf_ids_are_of_the_content():
    s = [{"cwe": 327, "primitive": "MD5", "sites": 2, "files": 1, "state": "in_triage"}]
    who = {"name": "p", "namespace": "https://p.example.invalid"}
    make = lambda rows, when: reports.csaf(rows, "tree", "d", who, when, reports.coverage_properties("BROKEN-CRYPTO", [f"f{i:02}" for i in range(25)]))
    a, b = make(s, "2026-01-01T00:00:00Z"), make(s, "2026-01-02T00:00:00Z")
    assert a["document"]["tracking"]["id"] == b["document"]["tracking"]["id"] != make([s[0] | {"sites": 3}], "2026-01-01T00:00:00Z")["document"]["tracking"]["id"]
    assert a["vulnerabilities"][0]["cwe"]["id"] == "CWE-327" and "f19" in a["document"]["notes"][0]["text"] and "f20" not in a["document"]["notes"][0]["text"]
    with pytest.raises(ValueError):
        make([], "x")


def test_reports_are_written_beside_inputs_only(tmp_path):
    (tmp_path / "tree").mkdir()
    r = {"tool": "keys", "findings": [{"file": "a|b", "line": 1}]}
    sinks.write_report(r, tmp_path / "out.json", [tmp_path / "tree"])
    assert json.loads((tmp_path / "out.json").read_text()) == r and "a\\|b" in (tmp_path / "out.md").read_text()
    for bad in (tmp_path / "tree/out.json", tmp_path / "tree"):
        with pytest.raises(ValueError):
            sinks.write_report(r, bad, [tmp_path / "tree"])


# trees, archives, scripts


def test_links_and_second_readings(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "é.txt").write_text("x")
    os.symlink("d", tmp_path / "s")
    files, links = tree.walk_tree(spark, str(tmp_path))
    assert [(r.rel, r.size, r.sha256) for r in files.collect()] == [("d/é.txt", 1, hashlib.sha256(b"x").hexdigest())]
    assert [tuple(r) for r in links.collect()] == [("s", "symlink")]
    first = lineage.cut(files.select("rel", "sha256"))
    (tmp_path / "d" / "é.txt").write_text("y")
    assert [r.rel for r in tree.changed(first, tree.walk_tree(spark, str(tmp_path))[0]).collect()] == ["d/é.txt"]


def test_archives_within_bounds():
    import gzip
    import io
    import tarfile

    to = io.BytesIO()
    with tarfile.open(fileobj=to, mode="w") as t:
        i = tarfile.TarInfo("a/b.txt")
        i.size = 3
        t.addfile(i, io.BytesIO(b"abc"))
    data = to.getvalue()
    assert archives.kind_of(data[:512]) == "tar" and archives.walked(data, "tar") == ([("!a/b.txt", b"abc")], "read")
    nested = data
    for _ in range(3):
        nested = gzip.compress(nested)
    assert archives.walked(nested, "gzip") == ([("!a/b.txt", b"abc")], "read")
    assert archives.walked(gzip.compress(nested), "gzip") == ([], "not_fully_read")
    assert archives.walked(b"PK\3\4broken", "zip") == ([], "not_opened")
    assert archives.unpacked(gzip.compress(b"a" * 100) + gzip.compress(b"b"), "gzip", 50) == (b"a" * 50, False)
    assert archives.unpacked(gzip.compress(b"a") + gzip.compress(b"b"), "gzip") == (b"ab", True)


@pytest.mark.parametrize(
    "script, want",
    [
        ("setup(install_requires=['a', 'b>=1'])", {("a", "required", ""), ("b>=1", "required", "")}),
        ("x = {'t': ['c']}\nsetup(extras_require=dict(x, u=['d']))", {("c", "optional", "t"), ("d", "optional", "u")}),
        ("r = []\nr.append('a')\nr.extend(['b'])\nsetup(install_requires=r)", {("a", "required", ""), ("b", "required", "")}),
        ("setup(**{'tests_require': 'a b'.split()})", {("a", "dev", ""), ("b", "dev", "")}),
        ("v = '1'\nsetup(install_requires=[f'a=={v}', 'b' if x else 'c'])", {("a==1", "required", ""), ("bc", "required", "")}),
        ("setup(install_requires=[x + '>=1' for x in ['a', 'b']])", {("a>=1", "required", ""), ("b>=1", "required", "")}),
        ("a = b\nb = a\nsetup(install_requires=a)", {("", "error", "")}),
        ("def f(:", {("", "error", "")}),
    ],
)
def test_setup_scripts(script, want):
    got = {(spec, scope, extra) for _, spec, scope, extra, _ in setup_scripts.requirements_of(script)}
    assert got == want


def test_named_requirement_files(spark):
    files = {"setup.py": "setup(install_requires=open('needs/base.txt').read().splitlines())", "needs/base.txt": "a==1\n# c\nb", "pyproject.toml": "[project]\nname='x'\n[tool.setuptools.dynamic]\ndependencies = {file = ['needs/dyn.txt']}\n", "needs/dyn.txt": "d", "p/requirements.txt": "-e ../lib\nfile:///x/y.whl\n./z[e] ; m\n--constr c.txt\n-r ../../out.txt"}
    texts, facts = scan(spark, files)
    assert {(r.file, r.name, r.scope) for r in setup_scripts.collected(texts, facts).collect()} == {("needs/base.txt", "a", "required"), ("needs/base.txt", "b", "required"), ("needs/dyn.txt", "d", "required")}
    assert {(r.line, r.path) for r in manifests.path_requirements(texts).collect()} == {(1, "../lib"), (2, "/x/y.whl"), (3, "./z")}
    assert {(r.line, r.to, r.constraint, r.in_tree) for r in manifests.includes(texts).collect()} == {(4, "p/c.txt", True, False), (5, None, False, False)}
    assert manifests.include_errors(texts).count() == 2
    notes = [r.note for r in manifests.unknown_fields(manifests.sbom(setup_scripts.collected(texts, facts)), texts).collect()]
    assert any("a local path" in n for n in notes) and any("exact version" in n for n in notes) and len(notes) >= 9


def test_long_include_chains(spark):
    files = {f"requirements-{i:03}.txt": f"-r requirements-{i + 1:03}.txt" for i in range(40)} | {"requirements-040.txt": "-r requirements-000.txt"}
    texts, _ = scan(spark, files)
    assert manifests.include_closure(texts, texts.where("rel = 'requirements-000.txt'")).count() == 41


def test_keys_of_json_and_notebooks(spark):
    jwk = {"kty": "EC", "d": "nWGxne_9WmC6hEr0kuwsxERJxWl7MmkZcDusAxyuf2A"}
    deep = jwk
    for _ in range(15):
        deep = {"x": [deep]}
    pem = "-----BEGIN EC PRIVATE KEY-----\nMIIEow" + "A1b" * 40 + "\n-----END EC PRIVATE KEY-----"
    book = {"nbformat": 4, "metadata": {}, "cells": [{"cell_type": "markdown", "source": pem}, {"cell_type": "code", "source": "API_TOKEN = 'x9-77aa-01'", "outputs": [{"data": {"text/plain": [pem]}}]}]}
    files = {"deep.json": json.dumps(deep), "two.json": '{"a": {"api_key": "9c1d-77aa"},\n "b": {"api_key": "9c1d-77aa"}}', "n.ipynb": json.dumps(book), "bad.json": "{", "public.json": json.dumps({"kty": "EC", "x": jwk["d"]})}
    texts, facts = scan(spark, files)
    got = {(r.file, r.line, r.kind) for r in keys.findings(texts.selectExpr("rel", "1L AS size", "cast(text AS binary) AS content"), texts, facts).collect()}
    assert got == {("deep.json", 1, "jwk"), ("two.json", 1, "literal-key"), ("two.json", 2, "literal-key"), ("n.ipynb", 1, "private-key"), ("n.ipynb", 2, "private-key"), ("n.ipynb", 2, "literal-key")}
    assert [r.verdict for r in keys.verdict(keys.findings(texts.selectExpr("rel", "1L AS size", "cast(text AS binary) AS content"), texts, facts), facts, texts).collect()] == ["REVIEW"]


def test_folded_and_derived_literals():
    facts = pyfacts.facts_of("a.py", "A = 'ab' * 3 + 'c'\nB = bytes.fromhex('aabbccdd').decode().strip()\nC = f'{x}' + 'a'\nD = 'x' * 99999\nE = hashlib.sha256(A.encode()).hexdigest()\nimport hashlib\nF = bytearray(16)\nG = 'abc'.encode().decode().strip().lower().upper().encode()")
    bound = {r["name"]: r["value"] for r in facts if r["kind"] == "bind"}
    assert bound == {"A": "abababc", "B": "aabbccdd"}
    assert {r["name"]: r["parent"] for r in facts if r["kind"] == "derive"} == {"E": "constant", "F": "zeros"}


def test_artifacts(spark):
    rows = [("a.so", b"\x7fELF\1\0"), ("b.txt", b"plain"), ("c.pkl", b"\x80\4x\0"), ("d.pyx", b"def f(): pass"), ("e.bin", b"text only"), ("f", b"PK\3\4\0")]
    df = spark.createDataFrame([(n, len(b), bytearray(b)) for n, b in rows], "rel string, size long, content binary")
    assert {r.file for r in egress.artifacts(df).collect()} == {"a.so", "c.pkl", "d.pyx", "f"}


def test_companion_outputs(spark):
    files = {"a.py": "import subprocess\nsubprocess.run(['sudo', 'mytool', 'x'])\nsubprocess.run(['curl', 'x'])\nx = 'rsa'\n", "b.js": "import z from 'zod';\nimport a from 'axios';\nconst f = require('node:fs');\nimport c from '@s/p/x';", ".github/workflows/ci.yml": "jobs:\n  - run: curl https://example.invalid\n    name: use wget\n", "x.rst": "t"}
    texts, facts = scan(spark, files)
    assert [tuple(r) for r in egress.unlisted_programs(facts).collect()] == [("mytool", 1)]
    assert {r.package for r in egress.unlisted_js_imports(texts).collect()} == {"zod", "@s/p"}
    assert {(r.line, r.kind) for r in egress.script_findings(texts).collect()} == {(2, "script-network-command"), (3, "script-network-word")}
    whole = texts.selectExpr("rel", "1L AS size", "cast(text AS binary) AS content")
    assert {(r.rel, r.why) for r in egress.files_not_read(whole, texts).collect()} == {("x.rst", "of no kind that is read")}
    assert {r.primitive for r in cbom.components(texts, facts).collect()} == {"RSA"}
    assert cbom.components(texts, facts, [hashlib.sha256(files["a.py"].encode()).hexdigest()]).count() == 0


def test_trees_and_counts(spark):
    files = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "rel string, content binary")
    d = reports.listing_digest(files)
    assert d == reports.listing_digest(files.orderBy(F.desc("rel"))) != reports.listing_digest(files.limit(1))
    a, b = {"target": "t", "tree_listing_digest": d}, {"target": "t", "tree_listing_digest": d}
    assert reports.of_one_tree(a, b) == (a, b)
    with pytest.raises(ValueError):
        reports.of_one_tree(a, b | {"tree_listing_digest": "x"})
    uses = spark.createDataFrame([("SAFE",), ("BROKEN",), ("SAFE",)], "quantum string")
    assert cbom.status_counts(uses).first().counts == {"SAFE": 2, "BROKEN": 1}
