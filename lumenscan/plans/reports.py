"""Findings as documents: SARIF, CycloneDX, VEX, CSAF and in-toto; digests, seals and statuses of reports.

Documents of many findings are rows of JSON, one a finding, so nothing gathers them in one task; plans.sinks writes them
into one file. What is small by nature (statements, statuses) is plain Python."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenscan.functions import signing
from lumenscan.operators import merkle
from lumenscan.sources.lineage import numbered

c, lit = F.col, F.lit
ENVELOPE = {"signature", "content_hash", "integrity_tag"}
NOT_REPRODUCIBLE = {"scanned_at_utc", "findings_digest", "signature_algorithm", "public_root", "parser_python", "subject"}


def canonical(report: dict) -> bytes:
    """Canonical JSON of a report without its envelope."""
    return json.dumps({k: v for k, v in report.items() if k not in ENVELOPE}, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()


def content_hash(report: dict) -> str:
    return hashlib.sha3_256(canonical(report)).hexdigest()


def findings_digest(report: dict) -> str:
    r = {k: v for k, v in report.items() if k not in NOT_REPRODUCIBLE}
    if isinstance(r.get("not_scanned"), dict):
        r["not_scanned"] = {k: v for k, v in r["not_scanned"].items() if k != "skipped_directories"}
    return hashlib.sha3_256(canonical(r)).hexdigest()


def uri(path: Column) -> Column:
    """Percent-encoded path: unreserved characters and / stay."""
    return F.regexp_replace(F.replace(F.url_encode(path), lit("%2F"), lit("/")), r"\+", "%20")


def occurrences(findings: DataFrame) -> DataFrame:
    """findings with n: which of the equal (kind, file, detail) a row is, by line."""
    return findings.withColumn("n", F.row_number().over(Window.partitionBy("kind", "file", "detail").orderBy("line")) - 1)


def fingerprint(kind: Column, file: Column, detail: Column, n: Column) -> Column:
    sep = lit("\u001f")
    return F.substring(F.sha2(F.concat(kind, sep, uri(file), sep, detail, sep, F.when(n > 0, F.concat(lit("#"), n.cast("string"))).otherwise("")), 256), 1, 32)


def sarif_results(findings: DataFrame) -> DataFrame:
    """file, line, kind, detail, n, result (JSON) of every finding: no task holds more than its own; a sink puts them into one file in order."""
    o = occurrences(findings)
    cell = c("file").endswith(".ipynb")
    region = F.struct(F.when((c("line") > 0) & ~cell, F.struct(c("line").alias("startLine"))).alias("region"), uri(c("file")).alias("u"))
    place = F.struct(F.struct(region["u"].alias("uri")).alias("artifactLocation"), region["region"].alias("region"))
    logical = F.when(cell & (c("line") > 0), F.array(F.struct(F.concat(lit("cell "), c("line").cast("string")).alias("name"), lit("notebookCell").alias("kind"))))
    result = F.struct(
        c("kind").alias("ruleId"),
        lit("warning").alias("level"),
        F.struct(c("detail").alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"), logical.alias("logicalLocations"))).alias("locations"),
        F.struct(fingerprint(c("kind"), c("file"), c("detail"), c("n")).alias("finding/v1")).alias("partialFingerprints"),
    )
    return o.select("file", "line", "kind", "detail", "n", F.to_json(result).alias("result"))


def sarif_frame(findings: DataFrame, tool: str, verdict: str = "") -> tuple[str, str]:
    """What stands before and after the results of a SARIF 2.1.0 document: the kinds found as rules, and whether the run went well."""
    kinds = sorted(r["kind"] for r in findings.select("kind").distinct().collect())  # one row a kind
    run = {"tool": {"driver": {"name": tool, "rules": [{"id": k} for k in kinds]}}, "invocations": [{"executionSuccessful": verdict != "NOT-ANALYSED"}], "results": []}
    head, _, tail = json.dumps({"version": "2.1.0", "runs": [run]}).partition('"results": [')
    return head + '"results": [', tail


def cbom_components(components: DataFrame) -> DataFrame:
    """file, line, primitive, quantum, component (JSON, CycloneDX 1.6) of every crypto use."""
    kinds = F.create_map(*[lit(x) for named in "rng=drbg kdf kem signature cipher=block-cipher mac hash".split() for x in (named.split("=")[0], named.split("=")[-1])])
    part = F.struct(
        lit("cryptographic-asset").alias("type"),
        F.substring(F.sha2(F.concat_ws("\u001f", "file", c("line").cast("string"), "primitive", "quantum"), 256), 1, 32).alias("bom-ref"),
        c("primitive").alias("name"),
        F.struct(lit("algorithm").alias("assetType"), F.struct(F.coalesce(F.try_element_at(kinds, F.when(c("quantum") != "WEAK-RNG", c("category"))), lit("other")).alias("primitive"), quantum_level(c("quantum")).alias("nistQuantumSecurityLevel")).alias("algorithmProperties")).alias("cryptoProperties"),
        F.struct(F.array(F.struct(uri(c("file")).alias("location"), F.when(c("line") > 0, c("line")).alias("line"))).alias("occurrences")).alias("evidence"),
        F.array(F.struct(lit("quantum-status").alias("name"), c("quantum").alias("value"))).alias("properties"),
    )
    return components.select("file", "line", "primitive", "quantum", F.to_json(part).alias("component"))


def quantum_level(status: Column) -> Column:
    """0 where a quantum computer breaks it or it is broken already; null where the status doesn't tell."""
    return F.when(status.isin("BROKEN", "VULNERABLE"), 0)


BOM_FRAME = ('{"version": 1, "specVersion": "1.6", "bomFormat": "CycloneDX", "components": [', "]}")


def bom_refs(components: DataFrame) -> DataFrame:
    """components with a unique bom_ref: the purl or name, with ~n from the second of its kind on. A purl of many files is numbered over all tasks."""
    base = F.when(c("purl") != "", c("purl")).otherwise(F.concat("ecosystem", lit(":"), "name"))
    n = numbered(components.withColumn("bom_base", base), ["bom_base"], ["file", "line", "spec", "scope", "extra"], "bom_n")
    return n.select(*components.columns, F.concat("bom_base", F.when(c("bom_n") > 0, F.concat(lit("~"), c("bom_n").cast("string"))).otherwise("")).alias("bom_ref"))


def sbom_components(components: DataFrame) -> DataFrame:
    """ecosystem, name, bom_ref, component (JSON, CycloneDX 1.6) of every component."""
    part = F.struct(lit("library").alias("type"), c("bom_ref").alias("bom-ref"), "name", F.when(c("version") != "", c("version")).alias("version"), F.when(c("purl") != "", c("purl")).alias("purl"), F.when(c("scope").isin("optional", "peer"), "optional").otherwise("required").alias("scope"))
    return bom_refs(components).select("ecosystem", "name", "bom_ref", F.to_json(part).alias("component"))


WEAKNESSES = {327: "Use of a Broken or Risky Cryptographic Algorithm", 338: "Use of Cryptographically Weak Pseudo-Random Number Generator (PRNG)", 798: "Use of Hard-coded Credentials"}


def vex(components: DataFrame, key_findings: DataFrame | None = None) -> DataFrame:
    """One statement a (weakness, primitive): number of sites and files; all in triage. Key findings, if there are any, are one statement of hard-coded credentials."""
    cwe = F.when(c("quantum").isin("BROKEN", "VULNERABLE"), 327).when(c("quantum") == "WEAK-RNG", 338)
    out = components.withColumn("cwe", cwe).where("cwe is not null").groupBy("cwe", "primitive").agg(F.count("*").alias("sites"), F.countDistinct("file").alias("files"))
    if key_findings is not None:
        keys = key_findings.agg(F.count("*").alias("sites"), F.countDistinct("file").alias("files")).where("sites > 0")
        out = out.unionByName(keys.select(lit(798).alias("cwe"), lit("credentials written into the tree").alias("primitive"), "sites", "files"))
    return out.withColumn("state", lit("in_triage"))


def coverage_properties(verdict: str, unparsed: list[str]) -> list[dict]:
    """Verdict and what wasn't parsed, the first twenty by name."""
    shown = sorted(unparsed)[:20]
    more = [{"name": "audit:not_parsed_more", "value": str(len(unparsed) - 20)}] if len(unparsed) > 20 else []
    return [{"name": "audit:verdict", "value": verdict}, *({"name": "audit:not_parsed", "value": x} for x in shown), *more]


def csaf(statements: list[dict], label: str, subject_digest: str, publisher: dict, when: str, coverage: list[dict] | None = None) -> dict:
    """A CSAF 2.0 document of VEX statements (rows of vex() as dictionaries; a few, one a weakness and primitive). when: an ISO time in UTC.

    The tracking id is of the content, not of the time. Without a statement there is nothing to state."""
    if not statements:
        raise ValueError("no statement to make")
    if not str(publisher.get("name") or "").strip() or not re.fullmatch(r"https?://\S+", publisher.get("namespace") or ""):
        raise ValueError("a publisher has a name and an http address")
    rows = sorted(statements, key=lambda s: (s["cwe"], s["primitive"]))
    basis = json.dumps([label, subject_digest, rows], sort_keys=True)
    tracking = hashlib.sha256(basis.encode()).hexdigest()[:16]
    told = [
        {
            "title": f"{s['primitive']}: {WEAKNESSES[s['cwe']]}",
            "cwe": {"id": f"CWE-{s['cwe']}", "name": WEAKNESSES[s["cwe"]]},
            "notes": [{"category": "description", "text": f"{s['sites']} sites in {s['files']} files; under_investigation"}],
            "product_status": {"under_investigation": ["tree"]},
        }
        for s in rows
    ]
    notes = [{"title": "Coverage", "category": "general", "text": "; ".join(f"{p['name']}: {p['value']}" for p in coverage or ())}] if coverage else []
    document = {
        "title": f"Weaknesses told of {label}", "notes": notes, "lang": "en", "csaf_version": "2.0", "category": "csaf_vex",
        "tracking": {"revision_history": [{"summary": "Issued.", "number": "1", "date": when}], "id": f"VEX-{tracking}", "version": "1", "status": "interim", **{f"{x}_release_date": when for x in ("current", "initial")}},
        "publisher": {"namespace": publisher["namespace"], "name": publisher["name"].strip(), "category": publisher.get("category", "other")},
    }
    return {"vulnerabilities": told, "document": document, "product_tree": {"full_product_names": [{"name": label, "product_id": "tree"}]}}


def read_report(data: bytes, kind: str | None = None) -> dict:
    """A report from its bytes; refused are a byte order mark, repeated keys, other kinds and an edited body."""
    if data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        raise ValueError("a byte order mark")

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    report = json.loads(data.decode(), object_pairs_hook=once)
    if not isinstance(report, dict) or (kind is not None and report.get("tool") != kind):
        raise ValueError("a report of another kind")
    if "content_hash" in report and report["content_hash"] != content_hash(report):
        raise ValueError("the body was edited")
    if "findings_digest" in report and report["findings_digest"] != findings_digest(report):
        raise ValueError("the findings were edited")
    return report


def sealed(report: dict, key: signing.SigningKey | None = None) -> dict:
    """report with its digests, signed if a key is given."""
    r = {k: v for k, v in report.items() if k not in ENVELOPE}
    if key is not None:
        r |= {"signature_algorithm": signing.ALGORITHM, "public_root": key.public_root}
    r["findings_digest"] = findings_digest(r)
    r["content_hash"] = content_hash(r)
    return r | ({"signature": key.sign(canonical(r))} if key is not None else {})


def listing_digest(files: DataFrame) -> str:
    """Digest of every file of a tree, by name and content (rel, content): the Merkle root over names in byte order."""
    data = F.concat(F.encode("rel", "UTF-8"), F.unhex(lit("00")), F.unhex(F.sha2("content", 256)))
    root = merkle.roots_of_groups(files.withColumn("tree", lit("")), ["tree"], [F.encode("rel", "UTF-8")], data).first()
    return root["root"] if root else merkle.EMPTY_ROOT


def of_one_tree(cbom_report: dict, key_report: dict) -> tuple[dict, dict]:
    """Both reports, if they are of one tree: label and listing digest are the same."""
    if any(cbom_report.get(k) != key_report.get(k) or not cbom_report.get(k) for k in ("target", "tree_listing_digest")):
        raise ValueError("the reports are of different trees")
    return cbom_report, key_report


def report_status(report: dict, root: str | None = None) -> str:
    """ATTESTED (signed by the root asked for), UNVERIFIED (signed, by whom wasn't asked), UNSIGNED or TAMPERED."""
    if report.get("content_hash") != content_hash(report) or report.get("findings_digest") != findings_digest(report):
        return "TAMPERED"
    sig = report.get("signature")
    if sig is None:
        return "TAMPERED" if report.get("public_root") else "UNSIGNED"
    same = isinstance(sig, dict) and sig.get("public_root") == report.get("public_root") and sig.get("algorithm") == report.get("signature_algorithm")
    if not same or not signing.verify(canonical(report), sig, root):
        return "TAMPERED"
    return "ATTESTED" if root else "UNVERIFIED"


STATEMENT = "https://in-toto.io/Statement/v1"
_PARTS = {"_type", "predicate", "predicateType", "signature", "subject"}


def statement(subject: str, digest: str, predicate: dict, kind: str) -> dict:
    """An in-toto statement over a report; a signed report's signature is a block of four beside it."""
    out = {"_type": STATEMENT, "predicateType": kind, "subject": [{"name": subject, "digest": {"sha3_256": digest}}]}
    out["predicate"] = {k: v for k, v in predicate.items() if k not in ENVELOPE}
    if sig := predicate.get("signature"):
        out["signature"] = {"algorithm": sig["algorithm"], "public_root": sig["public_root"], "value": sig, "note": "signs the canonical body of the report that the predicate is"}
    return out


def statement_status(s: object, kind: str, root: str | None = None) -> str:
    """The status of the report that a statement carries; anything that statement() doesn't write is TAMPERED."""
    if not isinstance(s, dict) or s.keys() - _PARTS or s.get("_type") != STATEMENT or s.get("predicateType") != kind:
        return "TAMPERED"
    predicate, sig, subject = s.get("predicate"), s.get("signature"), s.get("subject")
    if not isinstance(predicate, dict) or predicate.keys() & ENVELOPE or not isinstance(subject, list) or len(subject) != 1 or set(subject[0].get("digest", ())) != {"sha3_256"}:
        return "TAMPERED"
    if sig is not None and (not isinstance(sig, dict) or sig.keys() != {"algorithm", "note", "public_root", "value"} or not isinstance(sig["value"], dict) or any(sig[k] != sig["value"].get(k) for k in ("algorithm", "public_root"))):
        return "TAMPERED"
    report = predicate | {"content_hash": content_hash(predicate)} | ({"signature": sig["value"]} if sig else {})
    if subject[0]["digest"]["sha3_256"] != report["content_hash"]:
        return "TAMPERED"
    return report_status(report, root)
