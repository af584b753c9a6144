"""Declared dependencies: requirement lines, pyproject, package.json, Pipfile, setup.cfg, tox, conda, and the software bill of materials.

Line formats are SQL on (rel, line, text); structured ones become flat (section, key, value) rows in one Arrow pass."""

from __future__ import annotations

import configparser
import json
import re
import tomllib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.operators.egress import NETWORK
from lumenscan.sources.lineage import cut
from lumenscan.sources.pyfacts import py_facts
from lumenscan.sources.tree import lines

c, lit = F.col, F.lit
VCS = r"^(?i)(git|hg|svn|bzr)\+|^(https?|ftp|file)://|^git@"
EDITABLE = r"^(-e|--editable)[=\s]+"
_ALNUM = "[0-9a-zA-Z]"
NAME = rf"^({_ALNUM}(?:[-._0-9a-zA-Z]*{_ALNUM})?)\s*(?:\[[^]]*\])?\s*(?:[ #(;@~!=<>].*)?$"
SKIP = r"^\s*(#|$)"
CONFIGURATIONS = [".gitmodules", "pip.ini", "pip.conf", ".npmrc"]
UNREAD = "Pipfile.lock poetry.lock go.mod Cargo.toml pom.xml build.gradle Gemfile composer.json mix.exs pubspec.yaml Package.swift build.sbt project.clj DESCRIPTION".split()


#: Blocks of package.json with their scopes, and the option names of pip that may be abbreviated.
BLOCKS = {"peerDependencies": "peer", "optionalDependencies": "optional", "devDependencies": "dev", "dependencies": "required"}
PIP_OPTIONS = "config-settings constraint editable extra-index-url find-links global-option hash index-url no-binary no-index only-binary pre prefer-binary requirement require-hashes trusted-host use-feature".split()


def pip_option(word: Column) -> Column:
    """The long option of pip that a word spells or abbreviates unambiguously, or null; -r, -c, -e, -f and -i stand for theirs."""
    name = F.regexp_extract(word, r"^--([a-z-]+)", 1)
    fits = F.filter(F.array(*map(lit, PIP_OPTIONS)), lambda o: o.startswith(name))
    long = F.when(F.array_contains(F.array(*map(lit, PIP_OPTIONS)), name), name).when((name != "") & (F.size(fits) == 1), F.get(fits, lit(0)))
    short = F.create_map(*[lit(x) for x in ("r", "requirement", "c", "constraint", "e", "editable", "f", "find-links", "i", "index-url")])
    return F.coalesce(long, F.try_element_at(short, F.regexp_extract(word, "^-([rcefi])", 1)))


def _once(value: Column, body) -> Column:
    """body(value) as one step: filters above it don't copy the whole expression into generated code."""
    return F.get(F.transform(F.array(value), body), lit(0))


def manifest_kind(rel: Column) -> Column:
    name = F.lower(F.element_at(F.split(rel, "/"), -1))
    fixed = sorted({"setup.py", "setup.cfg", "tox.ini", "package.json", "pyproject.toml", "pipfile"} | set(CONFIGURATIONS))
    return (
        F.when(name.isin(*fixed), name)
        .when(name.isin("environment.yml", "environment.yaml"), "environment.yml")
        .when(name.rlike(r"^(.*[-_.])?(requirements|constraints)([-_.].*)?\.(txt|in)$") | F.lower(rel).rlike(r"(^|/)requirements/[^/]+\.(txt|in)$"), "requirements")
    )


def _requirement_name(spec: Column) -> Column:
    """The package a requirement line asks for; null for options, paths and comments."""
    s = F.regexp_replace(F.trim(spec), EDITABLE, "")
    egg = F.regexp_extract(s, r"[&#]egg=([-.\w]+)", 1)
    tail = F.regexp_replace(F.regexp_extract(F.regexp_replace(s, "#.*$", ""), r"([^/]+)/?$", 1), "@.*$", "")
    repository = F.when(s.rlike(r"^(?i)(git|hg|svn|bzr)\+"), F.regexp_replace(tail, r"\.git$", "")).when(F.lower(tail).endswith(".whl"), F.regexp_extract(tail, "^([^-]+)-", 1))
    plain = F.regexp_extract(F.trim(F.regexp_replace(s, "[#;].*$", "")), NAME, 1)
    out = F.when(s.rlike(r"^(#|-|$)"), None).when(s.rlike(VCS), F.when(egg != "", egg).otherwise(repository)).when(s.rlike(r"^[./~]|^[A-Za-z]:[\\/]"), None).otherwise(plain)
    return F.nullif(out, lit(""))


def _requirement_remote(spec: Column) -> Column:
    """Kind of the place a requirement line fetches from, or null."""
    s = F.regexp_replace(F.trim(spec), EDITABLE, "")
    body = F.regexp_replace(s, "[#;].*$", "")
    return (
        F.when(s.rlike(VCS), "vcs-requirement")
        .when(s.rlike(r"^(?i)(-[if]\S*|--(index-url|index|extra-index-url|extra\S*|find-links|find\S*|trusted-host|trusted\S*))(\s|=|$)"), "index-url")
        .when(body.rlike(r"(?i)@\s*file://(localhost)?/"), None)
        .when(body.rlike(r"(?i)@\s*(?:[a-z]+[+])?[a-z]+:/{2}"), "url-requirement")
    )


def requirement_name(spec: Column) -> Column:
    return _once(spec, _requirement_name)


def requirement_remote(spec: Column) -> Column:
    return _once(spec, _requirement_remote)


def pep440(version: Column) -> Column:
    return _once(version, _pep440)


def pinned_pypi(spec: Column) -> Column:
    """The version of an exact pin, else null."""
    v = F.regexp_replace(F.regexp_extract(spec, r"""={2,3}\s*([^]})"';,\s]+)""", 1), r"^[vV](\d)", "$1")
    return F.when(v.rlike(r"^[0-9][-_!+.a-zA-Z0-9]*$") & ~v.endswith("."), v)


def pinned_npm(version: Column) -> Column:
    v = F.regexp_replace(F.regexp_replace(F.trim(version), r"^=\s*", ""), r"^[vV](\d)", "$1")
    return F.when(v.rlike(r"^(?:(?:[1-9]\d*|0)(?:\.(?!$|[-+])|(?=$|[-+]))){3}(?:-[-.0-9a-zA-Z]+)?(?:[+][-.0-9a-zA-Z]+)?$"), v)


def file_scope(rel: Column) -> Column:
    low = F.lower(rel)
    return F.when(F.element_at(F.split(low, "/"), -1).contains("constraint"), "constraint").when(low.rlike(r"(^|[-./_])(bench|ci|dev(el(op)?)?|docs?|lint(ing)?|mypy|test(s|ing)?|typing)([-./_]|$)"), "dev").otherwise("required")


def pep503(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(name)), "[-_.]+", "-")


def logical_lines(texts: DataFrame) -> DataFrame:
    """(rel, line, text) with backslash continuations joined; the first line's number stays."""
    joined = texts.select("rel", F.regexp_replace("text", r"\\\n", "\u0001").alias("text"))
    l = joined.select("rel", F.posexplode(F.split("text", "\n")).alias("p", "text"))
    from pyspark.sql import Window

    extra = F.length("text") - F.length(F.replace("text", lit("\u0001"), lit("")))
    before = F.coalesce(F.sum(extra).over(Window.partitionBy("rel").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), lit(0))
    return l.select("rel", (c("p") + 1 + before).cast("int").alias("line"), F.replace("text", lit("\u0001"), lit(" ")).alias("text"))


def includes(texts: DataFrame) -> DataFrame:
    """rel, line, to, constraint, in_tree of every -r and -c line, however spelled; in_tree false where no file of the tree is meant."""
    l = logical_lines(texts.where(manifest_kind(c("rel")) == "requirements"))
    option = pip_option(F.ltrim("text"))
    target = F.regexp_extract("text", r"^\s*(?:--[a-z-]+(?:\s*=\s*|\s+)|-[rc]\s*)([^\s#]+)", 1)
    folder = F.regexp_extract("rel", "^(.*/)?[^/]*$", 1)
    found = l.select("rel", "line", option.alias("option"), _resolved(F.concat(folder, target)).alias("to"), target.alias("target")).where("option in ('requirement', 'constraint') and target <> ''")
    known = texts.select(c("rel").alias("to")).distinct().withColumn("known", lit(True))
    return found.join(known, "to", "left").select("rel", "line", "to", (c("option") == "constraint").alias("constraint"), c("known").isNotNull().alias("in_tree"))


def _resolved(path: Column) -> Column:
    """A path without . and .. parts; null if it leads out of the tree."""
    start = F.array().cast("array<string>")
    step = lambda a, p: F.when(a.isNull() | ((p == "..") & (F.size(a) == 0)), None).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.array_join(F.aggregate(F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), start, step), "/")


def include_closure(texts: DataFrame, start: DataFrame) -> DataFrame:
    """Files reached from start (rel) by -r and -c lines that name a file of the tree, however long the chain; cycles end it. A round a level, of the files met last."""
    edges = cut(includes(texts).where("in_tree and rel <> to").select("rel", "to").distinct())
    seen = last = cut(start.select("rel").distinct())
    while not last.isEmpty():
        last = cut(edges.join(last, "rel", "left_semi").select(c("to").alias("rel")).distinct().join(seen, "rel", "left_anti"))
        seen = cut(seen.unionByName(last))
    return seen


def include_errors(texts: DataFrame) -> DataFrame:
    """file, line, detail of includes that name no file of the tree."""
    return includes(texts).where("not in_tree").select(c("rel").alias("file"), "line", F.concat(lit("includes a file that isn't in the tree: "), F.coalesce("to", lit("outside"))).alias("detail"))


def path_requirements(texts: DataFrame) -> DataFrame:
    """rel, line, path of requirement lines that name a local path."""
    r = logical_lines(texts.where(manifest_kind(c("rel")) == "requirements")).where(~c("text").rlike(SKIP))
    s = F.regexp_replace(F.regexp_replace(F.trim("text"), EDITABLE, ""), r"\s+#.*$", "")
    local = F.regexp_extract(s, r"(?i)(?:^|@\s*)file:(?://(?:localhost)?)?(/[^\s;#]+)", 1)
    path = F.when(s.rlike(r"^(\.{1,2}([/\\]|$)|/|~|[A-Za-z]:[\\/])"), F.regexp_replace(s, r"(\[[^]]*\])?\s*(;.*)?$", "")).when(local != "", local).when(~s.rlike(VCS) & ~s.rlike("^-") & s.rlike(r"^[-\w.]+(/[-\w.]+)+/?$"), s)
    return r.select("rel", "line", path.alias("path")).where("path is not null")


def _structured(kind: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(section, key, value) of a manifest."""
    if kind == "package.json":
        j = json.loads(text)
        for block in [*BLOCKS, "scripts"]:
            for k, v in (j.get(block) or {}).items() if isinstance(j.get(block), dict) else ():
                if isinstance(v, str):
                    yield block, k, v
        for block in ("overrides", "resolutions"):
            stack = [j.get(block)]
            while stack:
                d = stack.pop()
                for k, v in d.items() if isinstance(d, dict) else ():
                    if isinstance(v, str):
                        yield block, k, v
                    stack.append(v)
    elif kind in ("pyproject.toml", "pipfile"):
        t = tomllib.loads(text)
        project = t.get("project") or {}
        yield "name", str(project.get("name") or ""), ""
        for x in project.get("dependencies") or ():
            yield "required", x, ""
        for extra, xs in (project.get("optional-dependencies") or {}).items():
            yield from (("optional:" + extra, x, "") for x in xs)
        yield from (("build", x, "") for x in (t.get("build-system") or {}).get("requires") or ())
        for field, scope in (("dependencies", "required"), ("optional-dependencies", "optional")):
            dynamic = (((t.get("tool") or {}).get("setuptools") or {}).get("dynamic") or {}).get(field) or {}
            for extra, entry in [("", dynamic)] if "file" in dynamic else dynamic.items():
                named = entry.get("file") if isinstance(entry, dict) else None
                yield from ((f"file:{scope}", x, extra) for x in ([named] if isinstance(named, str) else named or ()))
        yield from (("file:required", x, "") for x in ((((t.get("tool") or {}).get("hatch") or {}).get("metadata") or {}).get("hooks") or {}).get("requirements_txt", {}).get("files") or ())
        for env in (((t.get("tool") or {}).get("hatch") or {}).get("envs") or {}).values():
            yield from (("dev", x, "") for x in (*(env.get("dependencies") or ()), *(env.get("extra-dependencies") or ())) if isinstance(x, str))
        for table in ("dependencies", "pypi-dependencies"):
            for k, v in (((t.get("tool") or {}).get("pixi") or {}).get(table) or {}).items():
                yield ("conda" if table == "dependencies" else "required"), k + (v if isinstance(v, str) and v[:1] in "=<>!~" else ""), ""
        for group, xs in (t.get("dependency-groups") or {}).items():
            yield from (("dev", x, "") for x in xs if isinstance(x, str))
        tool = t.get("tool") or {}
        poetry = tool.get("poetry") or {}
        tables = [("required", poetry.get("dependencies")), ("dev", poetry.get("dev-dependencies")), *[("dev", (g or {}).get("dependencies")) for g in (poetry.get("group") or {}).values()], ("required", t.get("packages")), ("dev", t.get("dev-packages"))]
        for scope, d in tables:
            for k, v in (d or {}).items():
                if k != "python":
                    spec = v if isinstance(v, str) else (v or {}).get("version", "") if isinstance(v, dict) else ""
                    remote = next((v[x] for x in ("git", "url", "path") if x in v), "") if isinstance(v, dict) else ""
                    yield scope, f"{k} @ {remote}" if remote and "://" in str(remote) else k + (f"=={spec}" if re.fullmatch(r"\d[\w.]*", spec) and kind == "pipfile" else spec if spec[:1] in "=<>!~" else ""), str(remote)
        for s in [*(poetry.get("source") or ()), *(t.get("source") or ()), *((tool.get("uv") or {}).get("index") or ())]:
            if s.get("url") and "pypi.org" not in s["url"]:
                yield "index", s["url"], ""
        yield from (("dev", x, "") for x in (tool.get("uv") or {}).get("dev-dependencies") or ())
        for xs in ((tool.get("pdm") or {}).get("dev-dependencies") or {}).values():
            yield from (("dev", x, "") for x in xs)
    elif kind in ("setup.cfg", "tox.ini"):
        p = configparser.RawConfigParser(strict=False)
        p.read_string(text)
        if p.has_section("options"):
            yield from (("required", x.strip(), "") for x in p.get("options", "install_requires", fallback="").splitlines() if x.strip())
            yield from (("build", x.strip(), "") for x in p.get("options", "setup_requires", fallback="").splitlines() if x.strip())
        if p.has_section("options.extras_require"):
            for k, v in p.items("options.extras_require"):
                yield from (("optional:" + k, x.strip(), "") for x in v.splitlines() if x.strip())
        for s in p.sections():
            if s.startswith("testenv"):
                yield from (("dev", x.split(":", 1)[-1].strip(), "") for x in p.get(s, "deps", fallback="").splitlines() if x.strip() and not x.strip().startswith("-"))
    elif kind == "environment.yml":
        block, indent = "", 0
        for line in text.splitlines():
            if m := re.match(r"^(\w+):\s*$", line):
                block = m[1]
            elif m := re.match(r"^(\s*)-\s+(.*?)\s*$", line):
                item = m[2].strip("'\"")
                if block == "dependencies":
                    if item == "pip:":
                        indent = len(m[1])
                    elif indent and len(m[1]) > indent:
                        yield "pip", item, ""
                    else:
                        indent = 0
                        yield "conda", item, ""
                elif block == "channels" and "://" in item:
                    yield "index", item, ""


def entries(texts: DataFrame) -> DataFrame:
    """rel, kind, section, key, value, line of structured manifests; section `error` where one can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rel", "kind", "section", "key", "value", "line"]
        for b in batches:
            out = []
            for rel, kind, text in zip(*(b.column(x).to_pylist() for x in ("rel", "kind", "text"))):
                rows = text.split("\n")
                try:
                    for section, key, value in _structured(kind, text):
                        needle = re.split(r"[\s<>=!~\[;@]", key, maxsplit=1)[0] or key
                        out.append((rel, kind, section, key, value, next((i for i, x in enumerate(rows, 1) if needle and needle in x and not x.lstrip().startswith("#")), 1)))
                except (ValueError, TypeError, AttributeError, configparser.Error, RecursionError) as e:
                    out.append((rel, kind, "error", type(e).__name__, "", 1))
            cols = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in cols[:5]], pa.array(cols[5], pa.int32())], names=names)

    t = texts.withColumn("kind", manifest_kind(c("rel"))).where("kind not in ('requirements', 'setup.py', '.npmrc', 'pip.conf', 'pip.ini', '.gitmodules')")
    return t.select("rel", "kind", "text").mapInArrow(run, "rel string, kind string, section string, key string, value string, line int")


def declared(texts: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """file, line, name, spec, ecosystem, scope, extra, source of every declared dependency."""
    cols = ["file", "line", "name", "spec", "ecosystem", "scope", "extra", "source"]
    r = logical_lines(texts.where(manifest_kind(c("rel")) == "requirements")).where(~c("text").rlike(SKIP))
    spec = F.trim(F.regexp_replace(F.regexp_replace("text", r"(^|\s)#.*$", ""), r"\s--(hash|config-settings|global-option)[=\s].*$", ""))
    req = r.select(c("rel").alias("file"), "line", requirement_name(spec).alias("name"), spec.alias("spec"), lit("pypi").alias("ecosystem"), file_scope(c("rel")).alias("scope"), lit("").alias("extra"), lit("").alias("source"))
    e = entries(texts)
    own = e.where("section = 'name'").select("rel", pep503(c("key")).alias("own"))
    py = e.where("section in ('required', 'dev', 'build', 'pip') or section like 'optional:%'")
    extra = F.regexp_extract("section", "^optional:(.*)$", 1)
    scope = F.when(c("section").like("optional:%"), "optional").when(c("section") == "pip", "required").otherwise(c("section"))
    py = py.join(own, "rel", "left").select(c("rel").alias("file"), "line", requirement_name(c("key")).alias("name"), c("key").alias("spec"), lit("pypi").alias("ecosystem"), scope.alias("scope"), extra.alias("extra"), c("value").alias("source"), "own")
    py = py.where("own is null or own <> " + "regexp_replace(lower(trim(name)), '[-_.]+', '-')").select(*cols)
    blocks = F.create_map(*[lit(x) for pair in BLOCKS.items() for x in pair])
    js = e.where("kind = 'package.json' and section like '%ependencies'").select(c("rel").alias("file"), "line", c("key").alias("name"), c("value").alias("spec"), lit("npm").alias("ecosystem"), blocks[c("section")].alias("scope"), lit("").alias("extra"), lit("").alias("source"))
    conda = e.where("section = 'conda'").select(c("rel").alias("file"), "line", F.regexp_extract(F.regexp_replace("key", "^.*::", ""), r"^([A-Za-z0-9_.-]+)", 1).alias("name"), c("key").alias("spec"), lit("conda").alias("ecosystem"), lit("required").alias("scope"), lit("").alias("extra"), lit("").alias("source"))
    parts = [req, py, js, conda]
    if facts is not None:  # session.install(...) of a noxfile, once a name; of the facts of texts only those of noxfiles are made
        s = py_facts(texts.where(c("rel").rlike(r"(^|/)noxfile\.py$"))).where("kind = 'call' and name = 'install'")
        s = s.select("rel", "line", F.explode("args").alias("spec")).where("spec <> '' and spec not like '-%'")
        nox = s.groupBy(c("rel").alias("file"), requirement_name(c("spec")).alias("name")).agg(F.min(F.struct("line", "spec")).alias("f"))
        parts.append(nox.select("file", "f.line", "name", "f.spec", lit("pypi").alias("ecosystem"), lit("dev").alias("scope"), lit("").alias("extra"), lit("").alias("source")))
    return reduce(DataFrame.unionByName, parts).where("name is not null and name <> ''")


def remote_sources(texts: DataFrame) -> DataFrame:
    """file, line, kind, detail of places manifests fetch from."""
    r = logical_lines(texts.where(manifest_kind(c("rel")) == "requirements")).where(~c("text").rlike(SKIP))
    out = [r.select(c("rel").alias("file"), "line", requirement_remote(c("text")).alias("kind"), F.trim("text").alias("detail")).where("kind is not null")]
    e = entries(texts)
    out.append(e.where("section = 'index'").select(c("rel").alias("file"), "line", lit("index-url").alias("kind"), c("key").alias("detail")))
    out.append(e.where("kind = 'package.json' and section = 'scripts'").where(c("value").rlike(r"\b(curl|wget|npx|https?://\S+)")).select(c("rel").alias("file"), "line", lit("script-fetch").alias("kind"), c("value").alias("detail")))
    out.append(e.where("kind = 'package.json' and section <> 'scripts'").where(c("value").rlike(r"^(git(\+|://|hub:)|https?://|[\w-]+/[\w.-]+$)")).select(c("rel").alias("file"), "line", lit("npm-remote").alias("kind"), c("value").alias("detail")))
    conf = lines(texts.where(manifest_kind(c("rel")).isin(*CONFIGURATIONS)))
    url = F.regexp_extract("text", r"(?i)^\s*(?:@[\w-]+:)?(?:url|registry|index-url|extra-index-url|find-links)\s*=\s*(\S+)", 1)
    out.append(conf.where(url != "").select(c("rel").alias("file"), "line", lit("config-remote").alias("kind"), url.alias("detail")))
    return reduce(DataFrame.unionByName, out)


def network_dependencies(deps: DataFrame) -> DataFrame:
    """Declared dependencies whose name is a listed network package."""
    listed = sorted({m.split(".")[0].replace("_", "-").lower() for m in NETWORK})
    return deps.where(pep503(c("name")).isin(*listed)).select("file", "line", lit("declared-network-dependency").alias("kind"), c("name").alias("detail"))


def purl(name: Column, ecosystem: Column, spec: Column, version: Column, source: Column) -> Column:
    away = (source != "") | ((ecosystem == "pypi") & (F.coalesce(requirement_remote(spec), lit("")).isin("vcs-requirement", "url-requirement") | spec.rlike(r"(?i)@\s*file:"))) | ((ecosystem == "npm") & spec.rlike("[:/]"))
    at = F.when(version != "", F.concat(lit("@"), version)).otherwise("")
    npm = F.concat(lit("pkg:npm/"), F.regexp_replace(F.lower(name), "^@", "%40"), at)
    channel = F.regexp_extract(spec, r"^\s*([^:\s]+)::", 1)
    conda = F.concat(lit("pkg:conda/"), F.lower(F.trim(name)), at, F.when(channel != "", F.concat(lit("?channel="), channel)).otherwise(""))
    pypi = F.concat(lit("pkg:pypi/"), F.translate(F.lower(F.trim(name)), "_", "-"), at)
    return F.when(away, "").when(ecosystem == "npm", npm).when(ecosystem == "conda", conda).otherwise(pypi)


def _pep440(version: Column) -> Column:
    """The normal form of a version: case, v prefix, leading zeros, spellings of pre-, post- and development releases."""
    v = F.regexp_replace(F.lower(F.trim(version)), r"^v(?=\d)", "")
    v = F.regexp_replace(v, r"(^|[.!])0+(?=\d)", "$1")
    v = F.regexp_replace(v, r"[-_.]?(?:alpha|a)[-_.]?(\d+)", "a$1")
    v = F.regexp_replace(v, r"(\d)[-_.]?(?:beta|b)[-_.]?(\d+)", "$1b$2")
    v = F.regexp_replace(v, r"(\d)[-_.]?(?:preview|pre|rc|c)[-_.]?(\d+)", "$1rc$2")
    v = F.regexp_replace(v, r"[-_.]?(?:post|rev|r(?!c))[-_.]?(\d+)", ".post$1")
    v = F.regexp_replace(v, r"^([\d.]+)-(\d+)$", "$1.post$2")
    v = F.regexp_replace(v, r"[-_.]?dev$", ".dev0")
    return F.regexp_replace(v, r"[-_.]?dev[-_.]?(\d+)", ".dev$1")


def sbom(deps: DataFrame) -> DataFrame:
    """Components of what a product is made of: no development, build or constraint entries; one row a distinct component."""
    d = deps.where(~c("scope").isin("dev", "build", "constraint"))
    pin = F.coalesce(F.when(c("ecosystem") == "npm", pinned_npm(c("spec"))).otherwise(pinned_pypi(c("spec"))), lit(""))
    d = d.withColumn("version", pin)
    shown = F.when(c("ecosystem") == "pypi", pep440(c("version"))).otherwise(c("version"))
    return d.withColumns({"purl": purl(c("name"), c("ecosystem"), c("spec"), shown, c("source")), "version_status": F.when(c("version") == "", "unknown").otherwise("pinned")}).select("name", "ecosystem", "spec", "file", "line", "scope", "extra", "version", "purl", "version_status", *[lit("unknown").alias(x) for x in ("hash_status", "license_status", "producer_status")]).distinct()


def sbom_verdict(components: DataFrame, texts: DataFrame) -> DataFrame:
    name = F.element_at(F.split("rel", "/"), -1)
    unread = texts.agg(F.count_if(name.isin(*UNREAD) | name.rlike(r"\.(cs|fs)proj$")).alias("unread")).withColumn("one", lit(1))
    bad = entries(texts).agg(F.count_if(c("section") == "error").alias("errors")).withColumn("one", lit(1))
    n = components.agg(F.count("*").alias("components")).withColumn("one", lit(1))
    return n.join(unread, "one").join(bad, "one").select("components", "unread", "errors", F.when((c("unread") > 0) | (c("errors") > 0), "INCOMPLETE").when(c("components") > 0, "DECLARED").otherwise("EMPTY").alias("verdict"))


def unknown_fields(components: DataFrame, texts: DataFrame) -> DataFrame:
    """note: what a bill of materials of these components doesn't know, one row a note: constant fields, ranges, paths, unread manifests, errors."""
    fixed = components.sparkSession.createDataFrame([(f"{x}: not looked up",) for x in ("hash", "license", "producer", "transitive dependencies")], "note string")
    ranges = components.where("version_status = 'unknown'").agg(F.count("*").alias("n")).where("n > 0").select(F.concat(c("n").cast("string"), lit(" declared without an exact version")).alias("note"))
    paths = path_requirements(texts).select(F.concat("rel", lit(":"), c("line").cast("string"), lit(": a local path, "), "path").alias("note"))
    name = F.element_at(F.split("rel", "/"), -1)
    unread = texts.where(name.isin(*UNREAD) | name.rlike(r"\.(cs|fs)proj$")).select(F.concat("rel", lit(": of an ecosystem that isn't read")).alias("note"))
    errors = entries(texts).where("section = 'error'").select(F.concat("rel", lit(": can't be read ("), "key", lit(")")).alias("note"))
    missing = include_errors(texts).select(F.concat("file", lit(":"), c("line").cast("string"), lit(": "), "detail").alias("note"))
    return reduce(DataFrame.unionByName, [fixed, ranges, paths, unread, errors, missing])
