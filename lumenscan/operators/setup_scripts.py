"""What setup.py asks for: a bounded reading of the lists and dictionaries given to setup(), without running anything.

Names bound in the script, sums, products, subscripts, dict and list displays, comprehensions over literals, formatted
texts of known parts, conditions (both branches), and functions of one returned value are followed; what is computed from
a file gives the file's name, to be read as requirements. Depth, items and steps are bounded; at a bound an error row says so.
"""

from __future__ import annotations

import ast
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenscan.operators import manifests
from lumenscan.sources.pyfacts import folded

DEPTH, ITEMS, STEPS = 200, 10_000, 200_000
SCOPES = {"install_requires": "required", "requires": "required", "setup_requires": "build", "tests_require": "dev", "extras_require": "optional"}
c, lit = F.col, F.lit


class Bound(Exception):
    """A bound was reached."""


class FromFile:
    """A value read from a file of the tree."""

    def __init__(self, name: str):
        self.name = name


class Script:
    def __init__(self, tree: ast.Module):
        self.bound: dict[str, list[ast.AST]] = {}
        self.returns: dict[str, list[ast.AST]] = {}
        self.steps = 0
        for n in ast.walk(tree):
            if isinstance(n, ast.Assign):
                for t in n.targets:
                    if isinstance(t, ast.Name):
                        self.bound.setdefault(t.id, []).append(n.value)
                    elif isinstance(t, ast.Subscript) and isinstance(t.value, ast.Name):
                        self.bound.setdefault(t.value.id, []).append(ast.Dict([t.slice], [n.value]))
            elif isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name):
                self.bound.setdefault(n.target.id, []).append(n.value)
            elif isinstance(n, ast.FunctionDef):
                self.returns[n.name] = [r.value for r in ast.walk(n) if isinstance(r, ast.Return) and r.value is not None]
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in ("append", "extend", "update") and isinstance(n.func.value, ast.Name) and n.args:
                self.bound.setdefault(n.func.value.id, []).append(ast.List([n.args[0]], ast.Load()) if n.func.attr == "append" else n.args[0])

    def value(self, node: ast.AST, depth: int = 0, names: dict | None = None) -> object:
        """str, list, dict, FromFile or None (not known). Several bindings of a name are taken together."""
        self.steps += 1
        if depth > DEPTH or self.steps > STEPS:
            raise Bound
        go = lambda n: self.value(n, depth + 1, names)
        literal = folded(node)
        if isinstance(literal, str):
            return literal
        match node:
            case ast.List(elts=elts) | ast.Tuple(elts=elts) | ast.Set(elts=elts):
                out: list = []
                for e in elts:
                    v = go(e.value) if isinstance(e, ast.Starred) else go(e)
                    out += _listed(v) if isinstance(e, ast.Starred) else [v]
                    if len(out) > ITEMS:
                        raise Bound
                return out
            case ast.Dict(keys=keys, values=values):
                d: dict = {}
                for k, v in zip(keys, values):
                    if k is None:
                        inner = go(v)
                        d |= inner if isinstance(inner, dict) else {}
                    elif isinstance(name := go(k), str):
                        d[name] = go(v)
                return d
            case ast.Name(id=name):
                if names and name in names:
                    return names[name]
                return _together([go(v) for v in self.bound.get(name, ())])
            case ast.BinOp(op=ast.Add(), left=a, right=b):
                return _together([go(a), go(b)])
            case ast.IfExp(body=a, orelse=b):
                return _together([go(a), go(b)])
            case ast.BoolOp(values=values):
                return _together([go(v) for v in values])
            case ast.Subscript(value=v, slice=key):
                inner, k = go(v), go(key)
                return inner.get(k) if isinstance(inner, dict) and isinstance(k, str) else inner if isinstance(inner, FromFile) else None
            case ast.JoinedStr(values=values):
                parts = [go(v.value if isinstance(v, ast.FormattedValue) else v) for v in values]
                return "".join(parts) if all(isinstance(p, str) for p in parts) else None
            case ast.ListComp(elt=elt, generators=[g]) | ast.GeneratorExp(elt=elt, generators=[g]) | ast.SetComp(elt=elt, generators=[g]):
                source = go(g.iter)
                if isinstance(source, FromFile):
                    return source
                if isinstance(source, list) and isinstance(g.target, ast.Name):
                    return [self.value(elt, depth + 1, (names or {}) | {g.target.id: x}) for x in source]
                return None
            case ast.Call(func=f, args=args, keywords=keywords):
                name = f.attr if isinstance(f, ast.Attribute) else getattr(f, "id", "")
                if name in ("list", "tuple", "set", "sorted", "sum") and args:
                    v = go(args[0])
                    return sum((_listed(x) for x in _listed(v)), []) if name == "sum" else v
                if name == "dict":
                    return (_as_dict(go(args[0])) if args else {}) | {k.arg: go(k.value) for k in keywords if k.arg}
                if isinstance(f, ast.Attribute) and name in ("values", "items", "keys", "copy"):
                    inner = go(f.value)
                    return (list(inner) if name == "keys" else inner if name == "copy" else list(inner.values())) if isinstance(inner, dict) else inner
                if isinstance(f, ast.Attribute) and name in ("splitlines", "split", "read", "readlines", "strip", "format", "read_text"):
                    inner = go(f.value)
                    if isinstance(inner, str) and name in ("split", "splitlines"):
                        return [x.strip() for x in (inner.split(*[go(a) for a in args[:1] if isinstance(go(a), str)]) if name == "split" else inner.splitlines())]
                    return inner
                text = next((v for a in args if isinstance(v := go(a), str) and v.lower().endswith((".txt", ".in"))), None)
                if text is not None:
                    return FromFile(text)
                if name in self.returns:
                    return _together([go(v) for v in self.returns[name]])
                return next((v for a in args if isinstance(v := go(a), FromFile)), None)
        return None


def _listed(v: object) -> list:
    return v if isinstance(v, list) else [] if v is None else [v]


def _as_dict(v: object) -> dict:
    return v if isinstance(v, dict) else {}


def _together(values: list) -> object:
    """Dictionaries merged, else one list of everything; a single value as it is."""
    known = [v for v in values if v is not None]
    if len(known) < 2:
        return known[0] if known else None
    if all(isinstance(v, dict) for v in known):
        return {k: x for v in known for k, x in v.items()}
    if all(isinstance(v, str) for v in known):
        return "".join(known) if len(known) == 2 else known
    return [x for v in known for x in _listed(v)]


def requirements_of(text: str) -> list[tuple[int, str, str, str, str]]:
    """(line, spec, scope, extra, file) of what setup() is given; either a spec or the name of a file to read. Scope `error` at a bound or for a script that doesn't parse."""
    try:
        with warnings.catch_warnings(action="ignore"):
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(getattr(e, "lineno", None) or 1, "", "error", "", "")]
    script, out, lines = Script(tree), [], text.split("\n")

    def put(v: object, scope: str, extra: str, line: int) -> None:
        for x in _listed(v):
            if isinstance(x, FromFile):
                out.append((line, "", scope, extra, x.name))
            elif isinstance(x, str) and x.strip() and not x.lstrip().startswith("#"):
                spec = x.strip()
                out.append((next((i for i, t in enumerate(lines, 1) if spec in t and not t.lstrip().startswith("#")), line), spec, scope, extra, ""))
            elif isinstance(x, list):
                put(x, scope, extra, line)

    try:
        for n in ast.walk(tree):
            if isinstance(n, ast.Call) and getattr(n.func, "attr", getattr(n.func, "id", "")) == "setup":
                given = {k.arg: (k.value.lineno, script.value(k.value)) for k in n.keywords if k.arg}
                for k in n.keywords:
                    if k.arg is None:
                        given |= {a: (k.value.lineno, v) for a, v in _as_dict(script.value(k.value)).items()}
                for name, scope in SCOPES.items():
                    line, v = given.get(name, (0, None))
                    if isinstance(v, dict):
                        for extra, x in v.items():
                            put(x, scope, extra, line)
                    else:
                        put([v] if isinstance(v, (str, FromFile)) else v, scope, "", line)
    except (Bound, RecursionError):
        out.append((1, "", "error", "", ""))
    return out


def setup_py_rows(texts: DataFrame) -> DataFrame:
    """rel, line, spec, scope, extra, named of every setup.py; named is a file whose lines are meant, relative to the script."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(rel, *r) for rel, text in zip(b.column("rel").to_pylist(), b.column("text").to_pylist()) for r in requirements_of(text)]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.string(), pa.int32(), *[pa.string()] * 4))], names=["rel", "line", "spec", "scope", "extra", "named"])

    return texts.where(c("rel").rlike(r"(^|/)setup\.py$")).select("rel", "text").mapInArrow(run, "rel string, line int, spec string, scope string, extra string, named string")


def named_files(texts: DataFrame) -> DataFrame:
    """rel, to, scope, extra, in_tree: files that setup.py or pyproject.toml (dynamic dependencies) name as lists of requirements."""
    s = setup_py_rows(texts).where("named <> ''").select("rel", "named", "scope", "extra")
    e = manifests.entries(texts).where("section like 'file:%'").select("rel", c("key").alias("named"), F.substring_index("section", ":", -1).alias("scope"), c("value").alias("extra"))
    folder = F.regexp_extract("rel", "^(.*/)?[^/]*$", 1)
    found = s.unionByName(e).withColumn("to", manifests._resolved(F.concat(folder, "named"))).distinct()
    known = texts.select(c("rel").alias("to")).distinct().withColumn("known", lit(True))
    return found.join(known, "to", "left").select("rel", "to", "scope", "extra", c("known").isNotNull().alias("in_tree"))


def declared(texts: DataFrame) -> DataFrame:
    """file, line, name, spec, ecosystem, scope, extra, source of setup.py and of the files that manifests name, however those are called."""
    s = setup_py_rows(texts).where("spec <> ''").select(c("rel").alias("file"), "line", "spec", "scope", "extra")
    files = named_files(texts).where("in_tree")
    l = manifests.logical_lines(texts.join(files.select(c("to").alias("rel")).distinct(), "rel", "left_semi")).where(~c("text").rlike(manifests.SKIP) & ~F.ltrim("text").startswith("-"))
    t = l.withColumnRenamed("rel", "file").join(files.select(c("to").alias("file"), "scope", "extra"), "file").select("file", "line", F.trim(F.regexp_replace("text", r"(^|\s)#.*$", "")).alias("spec"), "scope", "extra")
    rows = s.unionByName(t).select("file", "line", manifests.requirement_name(c("spec")).alias("name"), "spec", lit("pypi").alias("ecosystem"), "scope", "extra", lit("").alias("source"))
    return rows.where("name is not null")


def collected(texts: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Every declared dependency of a tree. A requirements file that a manifest names has the scope it is named for, if that is a stronger one (required, then optional, build, dev, constraint)."""
    rank = F.create_map(*[lit(x) for n, s in enumerate(("required", "optional", "peer", "build", "dev", "constraint")) for x in (s, n)])
    named = named_files(texts).where("in_tree").select(c("to").alias("file"), c("scope").alias("named")).groupBy("file").agg(F.min_by("named", rank[c("named")]).alias("named"))
    every = manifests.declared(texts, facts).join(named, "file", "left")
    promoted = every.withColumn("scope", F.when(rank[c("named")] < rank[c("scope")], c("named")).otherwise(c("scope"))).drop("named")
    own = declared(texts)
    return promoted.unionByName(own.join(promoted.select("file", "line", "name").distinct(), ["file", "line", "name"], "left_anti").select(*promoted.columns)).distinct()
