"""Keys and credentials written into a tree: Python bindings, configuration lines, credential shapes, key files, JWKs."""

from __future__ import annotations

import base64
import itertools
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.functions import key_names as k
from lumenscan.functions.crypto_rules import literals_of
from lumenscan.operators import cbom
from lumenscan.sources.lineage import cut
from lumenscan.sources.pyfacts import is_python
from lumenscan.sources.tree import extension, lines

c, lit = F.col, F.lit
CONFIG = sorted([".toml", ".properties", ".ini", ".jwks", ".jwk", ".cfg", ".yml", ".yaml"])
KEY_FILES = [f"id_{x}" for x in ("ed25519", "ecdsa", "rsa", "dsa")] + [".netrc", ".htpasswd"]
KEY_SUFFIXES = [f".{x}" for x in "ppk kdbx keystore jks pfx p12 key pem".split()]
CONSTRUCTORS = sorted({"HMAC", "SecretBox", "SigningKey", "MerkleSigner", "Fernet"} | {f"AES{x}" for x in ("SIV", "OCB3", "GCM", "CCM")} | {"ChaCha20Poly1305"} | {f"{x}Serializer" for x in ("Timed", "URLSafe", "URLSafeTimed")} | {"TimestampSigner"})
#: Cipher modules, told by the name before .new; the last three take their key by keyword only.
CIPHERS = "AES ARC4 Blowfish CAST DES DES3 ChaCha20 ChaCha20_Poly1305 Salsa20".split()
_BY_KEYWORD = 99
_KEYED = "hmac.new:0:key hmac.digest:0:key hmac.HMAC:0:key hashlib.scrypt:0:password hashlib.pbkdf2_hmac:1:password hashlib.blake2b::key hashlib.blake2s::key jwt.decode:1:key jwt.encode:1:key itsdangerous.Signer:0:secret_key itsdangerous.TimestampSigner:0:secret_key itsdangerous.URLSafeSerializer:0:secret_key"
#: (module, function): position and keyword of the key
KEY_ARGUMENTS = {tuple(f.rsplit(".", 1)): (int(at) if at else _BY_KEYWORD, kw) for f, at, kw in (x.split(":") for x in _KEYED.split())}
KEY_ARGUMENTS |= {(x, "new"): (_BY_KEYWORD if n > 5 else 0, "key") for n, x in enumerate(CIPHERS)}
#: Functions that read or write the environment by name.
READERS, WRITERS = "environ.get environ.pop environ.setdefault getenv os.getenv".split(), "environ.setdefault os.putenv putenv".split()


#: Any shape of credentials: most texts hold none, and are done with this one.
ANY_SHAPE = "|".join(f"(?:{p})" for p in k.SHAPES.values())


def bindings(facts: DataFrame) -> DataFrame:
    """Literals bound to key-shaped names in Python, by any form of binding (one predicate over one fact kind)."""
    b = facts.where("kind = 'bind'")
    n, v = c("name"), c("value")
    plain = k.key_shaped(n, v) & ~k.address_like(v) & v.rlike("[A-Za-z0-9]")
    other = F.when(c("parent") == "environ", n.rlike(k.KEY_WORD)).otherwise(k.key_shaped(n, v)) & k.secret_like(v) & ~k.address_like(v)
    found = b.where(F.when(c("parent").isin("name", "default"), plain).otherwise(other))
    return found.select(c("rel").alias("file"), "line", lit("literal-key").alias("kind"), F.concat("name", lit(" is given a literal ("), "parent", lit(")")).alias("detail"))


def _of_call() -> Column:
    """Array of the findings of a call."""
    real, name = F.coalesce("real", lit("")), c("name")
    found = [F.when(name.isin(*CONSTRUCTORS) & (F.length(F.get("args", lit(0))) >= 4), F.struct(lit("key-constructor").alias("kind"), F.concat("name", lit("(literal)")).alias("detail")))]
    for (module, func), (at, kw) in KEY_ARGUMENTS.items():
        value = F.coalesce(F.try_element_at("kws", lit(kw)), F.when(~F.array_contains("uses", lit(kw)), F.get("args", lit(at))))
        own = (((c("root") if module in CIPHERS else real) == module) & (name == func)) | (F.coalesce("local", lit("")) == f"{module}.{func}")
        named = lit(False) if at == _BY_KEYWORD else F.try_element_at("kws", lit(kw)).isNull() & (c("level").bitwiseAND(1 << at) != 0)
        kind = F.when(named, "derived-from-constant").otherwise("literal-mac-key")
        found.append(F.when(own & (F.length(value) > 0), F.struct(kind.alias("kind"), lit(f"{module}.{func}: the key is a literal").alias("detail"))))
    variable, default = F.get("args", lit(0)), F.get("args", lit(1))
    env = F.substring_index(F.coalesce("value", lit("")), ".", -2).isin(*READERS, *WRITERS)
    found.append(F.when(env & k.has_key_word(variable) & k.secret_like(default) & ~k.address_like(default), F.struct(lit("literal-key").alias("kind"), F.concat(variable, lit(" has a literal default in the environment")).alias("detail"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def key_arguments(facts: DataFrame) -> DataFrame:
    """Literal key arguments of MAC, KDF, cipher and JWT calls, of key constructors, and defaults of the environment. A keyword beats a position; one projection over the calls."""
    return facts.where("kind = 'call'").select(c("rel").alias("file"), "line", F.explode(_of_call()).alias("f")).select("file", "line", "f.*")


def _asked() -> Column:
    """What an argument that is a name is the key of, or null."""
    own = lambda module, func: (((c("root") if module in CIPHERS else F.coalesce("real", lit(""))) == module) & (c("name") == func)) | (F.coalesce("local", lit("")) == f"{module}.{func}")
    asked = F.array(*[F.when(own(*of) & ((c("level") == at) | (c("parent") == kw)), lit(".".join(of))) for of, (at, kw) in KEY_ARGUMENTS.items()])
    return F.get(F.filter(asked, lambda x: x.isNotNull()), lit(0))


def relevant(facts: DataFrame) -> DataFrame:
    """The facts that key findings and their verdict are made of, computed and kept: findings() reads its facts in eight places, so a tree whose facts aren't kept is parsed eight times."""
    text = F.when(c("kind") == "word", c("name")).otherwise(c("value"))
    kept = (
        F.when(c("kind").isin("bind", "derive"), c("name").rlike(k.KEY_WORD))
        .when(c("kind") == "call", F.size(_of_call()) > 0)
        .when(c("kind") == "arg", _asked().isNotNull())
        .when(c("kind") == "output", c("value").contains("PRIVATE KEY") | c("value").rlike(MARKED) | text.rlike(ANY_SHAPE))
        .when((c("kind") == "magic") | ((c("kind") == "word") & (c("parent") == "string")), text.rlike(ANY_SHAPE))
        .otherwise(c("kind").isin("assign", "unparsed"))
    )
    return cut(facts.where(kept).select("rel", "kind", "line", "seq", "name", "root", "real", "parent", "local", "level", "args", "kws", "uses", "value", "scope"))


def nearest_keys(facts: DataFrame) -> DataFrame:
    """Key arguments that are names assigned more than once, if the last assignment before the call, in its function, is a literal: an as-of join on (file, function, name)."""
    a = facts.where("kind = 'arg'").select("rel", "line", "seq", c("value").alias("name"), "scope", _asked().alias("of")).where("of is not null")
    s = facts.where("kind = 'assign'").select(c("rel").alias("r"), c("line").alias("at"), c("name").alias("n"), c("scope").alias("s"), "value")
    before = a.join(s, (c("rel") == c("r")) & (c("name") == c("n")) & c("scope").eqNullSafe(c("s")) & (c("at") < c("line")))
    last = before.groupBy("rel", "line", "seq", "of").agg(F.max_by(F.struct("value"), "at").alias("last")).where("length(last.value) > 0")
    return last.select(c("rel").alias("file"), "line", lit("derived-from-constant").alias("kind"), F.concat("of", lit(": the key was last given a literal")).alias("detail"))


def derived_keys(facts: DataFrame) -> DataFrame:
    """Key-named values that the file makes from what it fixes itself: a hash of a literal, of a constant or of a parameter, or zero bytes."""
    d = facts.where("kind = 'derive'").where(k.has_key_word(c("name")))
    how = F.when(c("parent") == "zeros", " is zero bytes").when(c("parent") == "parameter", " is a hash of a parameter").otherwise(" is a hash of a fixed text")
    return d.select(c("rel").alias("file"), "line", lit("derived-from-constant").alias("kind"), F.concat("name", how).alias("detail"))


def literal_credentials(facts: DataFrame) -> DataFrame:
    """Provider credentials in string constants of Python, and in outputs and Markdown of notebooks; the first of a constant."""
    text = F.when(c("kind") == "word", c("name")).otherwise(c("value"))
    w = facts.where("(kind = 'word' and parent = 'string') or kind in ('output', 'magic')")
    return _credentials(w, text).select(c("rel").alias("file"), "line", lit("credential").alias("kind"), F.concat(lit("of the form "), "shape").alias("detail"))


def _credentials(df: DataFrame, text: Column) -> DataFrame:
    """df by the shapes that text has an unmasked credential of."""
    first = lambda p: F.get(F.filter(F.regexp_extract_all(text, lit(p), lit(0)), lambda m: ~m.rlike("[*Xx]{8,}")), lit(0))
    hits = F.array(*[F.when(first(p).isNotNull(), lit(s)) for s, p in k.SHAPES.items()])
    return df.where(text.rlike(ANY_SHAPE)).select("*", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("shape"))


def config_lines(texts: DataFrame) -> DataFrame:
    """name = value lines of .env and configuration files."""
    env = c("rel").rlike(r"(^|/)\.env(\.[^/]*)?$|\.env$")
    t = texts.where(env | extension(c("rel")).isin(*CONFIG))
    l = lines(t).where(~F.ltrim("text").rlike("^(#|;|//)"))
    name = F.when(env, F.regexp_extract("text", k.ENV_LINE, 1)).otherwise(F.regexp_extract("text", k.CONFIG_LINE, 1))
    value = F.when(env, F.regexp_extract("text", k.ENV_LINE, 2)).otherwise(F.regexp_extract("text", k.CONFIG_LINE, 2))
    l = l.select("rel", "line", name.alias("name"), F.regexp_replace(F.trim(value), """^['",]+|['",]+$""", "").alias("value"))
    n, v = c("name"), c("value")
    labels = c("rel").rlike(r"(?i)(^|/)(locale|locales|_locales|i18n|l10n|langs?|languages|translations)/|(^|/)(strings\.json|strings\.xml|messages\.json)$")
    bare = F.lower(n).isin("key", "token") & ~v.rlike(r"\d")
    field = v.isin(*"username user password passwd token secret apikey api_key access_token client_id client_secret".split()) & (n == F.lower(n)) & ~n.contains(v)
    ok = k.has_key_word(n) & (F.length(v) >= 8) & ~v.rlike(k.PLACEHOLDER) & ~v.rlike(k.NOT_SECRET) & ~v.contains("{{") & ~v.startswith("-----BEGIN") & ~labels & ~bare & ~field & ~k.is_mapping_key(n, v) & ~k.address_like(v)
    return l.where(ok).select(c("rel").alias("file"), "line", lit("literal-key").alias("kind"), F.concat("name", lit(" is assigned a value in a configuration file")).alias("detail"))


def assignments(texts: DataFrame) -> DataFrame:
    """name = "value" anywhere in prose or code: file, position in order, name, value of key-named, secret-like ones."""
    found = texts.select("rel", F.posexplode(F.regexp_extract_all("text", lit(k.ASSIGNMENT), lit(0))).alias("n", "m"))
    r = found.select(c("rel").alias("file"), "n", F.regexp_extract("m", k.ASSIGNMENT, 1).alias("name"), F.regexp_extract("m", k.ASSIGNMENT, 2).alias("value"))
    return r.where(k.has_key_word(c("name")) & k.secret_like(c("value")))


def credential_shapes(texts: DataFrame) -> DataFrame:
    """Strings of a provider's form, unless masked; unrolled over the shapes, so no join."""
    named = lambda s: lambda m: F.struct(lit(s).alias("shape"), m.alias("m"))  # noqa: E731 (a second parameter would be the index)
    here = lambda p: reduce(lambda a, b: a | b, [c("text").contains(x) for x in literals_of(p, cased=True)])  # noqa: E731 (most texts lack a shape's literals)
    every = lambda p: F.when(here(p), F.regexp_extract_all("text", lit(p), lit(0))).otherwise(F.array().cast("array<string>"))
    hits = F.concat(*[F.transform(every(p), named(s)) for s, p in k.SHAPES.items()])
    return texts.select(c("rel").alias("file"), F.explode(hits).alias("h")).where(~c("h.m").rlike("[*Xx]{8,}")).groupBy("file", c("h.shape").alias("shape")).agg(F.count("*").alias("n"))


def key_files(files: DataFrame) -> DataFrame:
    """Files that are keys by their name."""
    name = F.element_at(F.split("rel", "/"), -1)
    return files.where(F.lower(name).isin(*KEY_FILES) | extension(c("rel")).isin(*KEY_SUFFIXES)).select(c("rel").alias("file"), lit(0).alias("line"), lit("key-file").alias("kind"), lit("a key file by its name").alias("detail"))


def _likely(value: object) -> bool:
    return isinstance(value, str) and re.fullmatch("[-_0-9A-Za-z]{22,}=*", value) is not None and all(any(test(x) for x in value) for test in (str.islower, str.isupper, str.isdigit))


def _is_private_jwk(o: object) -> bool:
    return isinstance(o, dict) and "kty" in o and (_likely(o.get("d")) or (o["kty"] == "oct" and _likely(o.get("k"))))


def _walked(value: object, depth: int = 0) -> Iterator[tuple[object, object, int]]:
    """(key, value, depth) of everything inside value, to depth 32."""
    stack = [(None, value, depth)]
    while stack:
        key, v, d = stack.pop()
        yield key, v, d
        if d < 32:
            inner = v.items() if isinstance(v, dict) else ((key, x) for x in v) if isinstance(v, list) else ()
            stack += reversed([(a, b, d + 1) for a, b in inner])


def json_facts(texts: DataFrame) -> DataFrame:
    """rel, line, kind, name, value of JSON files: every string by its key (`value`), private JWKs (`jwk`) and signer key files (`signer`), one Arrow pass.

    The line is that of the n-th place where key and value stand together, for the n-th such pair. Files that don't parse give nothing."""

    def of(rel: str, text: str) -> list[tuple]:
        try:
            document = json.loads(text)
        except (ValueError, RecursionError):
            return []
        rows, seen = [], Counter()
        if isinstance(document, dict) and {"seed", "height", "next_index"} <= document.keys():
            rows.append((rel, 1, "signer", None, None))
        jwk = next((v for _, v, _ in _walked(document) if _is_private_jwk(v)), None)
        if jwk is not None:
            rows.append((rel, text.count("\n", 0, max(0, text.find(str(jwk.get("d") or jwk.get("k"))))) + 1, "jwk", None, None))
        for key, value, _ in _walked(document):
            if isinstance(key, str) and isinstance(value, str):
                pair = re.escape(json.dumps(key, ensure_ascii=False)) + r"\s*:\s*" + re.escape(json.dumps(value, ensure_ascii=False))
                at = next(itertools.islice((m.start() for m in re.finditer(pair, text)), seen[pair], None), 0) if len(seen) < 2000 else 0
                seen[pair] += 1
                rows.append((rel, text.count("\n", 0, at) + 1, "value", key, value))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string())
        for b in batches:
            rows = [r for rel, text in zip(b.column("rel").to_pylist(), b.column("text").to_pylist()) for r in of(rel, text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds)], names=["rel", "line", "kind", "name", "value"])

    return texts.where(extension(c("rel")).isin(".json", ".jwk", ".jwks", ".webmanifest")).select("rel", "text").mapInArrow(run, "rel string, line int, kind string, name string, value string")


def json_values(texts: DataFrame) -> DataFrame:
    """Key findings of JSON files: values under key-named keys, private JWKs, signer key files."""
    n, v = c("name"), F.trim("value")
    valued = (c("kind") == "value") & k.has_key_word(n) & (F.length(v) >= 8) & ~v.rlike(k.PLACEHOLDER) & ~v.rlike(k.NOT_SECRET) & ~v.contains("{{") & ~v.contains(" ") & ~k.is_mapping_key(n, v) & ~k.address_like(v)
    kind = F.when(valued, "literal-key").when(c("kind") == "jwk", "jwk").when(c("kind") == "signer", "signer-key-file")
    detail = F.when(valued, F.concat(n, lit(" is given a value in a JSON file"))).when(c("kind") == "jwk", "a private JSON Web Key").otherwise("a signing key with its seed")
    return json_facts(texts).select(c("rel").alias("file"), "line", kind.alias("kind"), detail.alias("detail")).where("kind is not null")


def jwks(texts: DataFrame) -> DataFrame:
    """Private JWKs in any other text: kty and a key-like d (or k of an oct key) of one object or paragraph, the first of a text."""
    value = r'''["']?\b(?:d|k)["']?\s*:\s*["']?([-_0-9A-Za-z]{22,})'''
    near = F.regexp_extract_all("text", lit(r"""(?s)\{(?:[^{}]|\{[^{}]*\})*\bkty\b(?:[^{}]|\{[^{}]*\})*\}"""), lit(0))
    blocks = F.concat(near, F.filter(F.split("text", r"\n\s*\n"), lambda p: p.rlike(r"\bkty\b") & ~p.contains("{")))
    private = F.filter(blocks, lambda o: o.rlike(r"\bd[\"']?\s*:") | o.rlike(r"\bkty[\"']?\s*:\s*[\"']?oct\b"))
    good = F.filter(F.transform(private, lambda o: F.regexp_extract(o, value, 1)), lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]"))
    line = F.expr(r"size(split(substr(text, 1, position(v in text) - 1), '\n'))")
    other = texts.where(c("text").contains("kty") & ~extension(c("rel")).isin(".json", ".jwk", ".jwks", ".webmanifest"))
    return other.select("rel", "text", F.get(good, lit(0)).alias("v")).where("v is not null").select(c("rel").alias("file"), line.cast("int").alias("line"), lit("jwk").alias("kind"), lit("a private JSON Web Key").alias("detail"))


def armour(texts: DataFrame) -> DataFrame:
    """Private-key armour, as it stands or base64-encoded once or twice (as in Kubernetes Secrets)."""
    plain = cbom.armour(texts).select(c("rel").alias("file"), "line", lit("private-key").alias("kind"), "detail").dropDuplicates(["file", "line"])
    return plain.unionByName(encoded_armour(texts))


def _stable(data: bytes) -> list[str]:
    """The base64 characters of data whatever stands around it, at each of the three offsets it can fall at."""
    return [base64.b64encode(b"\0" * n + data + b"\0\0").decode()[-(-n // 3) * 4 : (n + len(data)) // 3 * 4] for n in range(3)]


_ONCE = _stable(b"-----BEGIN")
MARKERS = _ONCE + [m for x in _ONCE for m in _stable(x.encode())]
_B64 = "[0-9/+a-zA-Z]"
#: What joins string literals or folded lines over a line end.
_JOINT = r"""['"]?[\t ]*[,+]?[\t ]*\\?\r?\n[\t ]*['"]?"""
_GLUE, _RUN = re.compile(_JOINT), re.compile(_B64 + "{40,}={0,2}")
_LINE = r"^[\t ]*" + _B64
_WRAPPED = re.compile("(?:" + _LINE + r"{16,}={0,2}[\t ]*\r?\n){2,}(?:" + _LINE[1:] + r"+={0,2}[\t ]*$)?", re.M)
_ARMOUR = re.compile("(-{5}BEGIN (?:[A-Z]+ )*PRIVATE KEY(?: BLOCK)?-{5})(.{0,400})", re.S)
_BODY = re.compile(cbom.ARMOUR_BODY)
#: Any marker as it stands, or over joints: one pass over a text that copies nothing. No marker has a character that a joint may begin with.
MARKED = "(?=[" + "".join(sorted({m[0] for m in MARKERS})) + "])(?:" + "|".join(f"(?:{_JOINT.replace('?', '?+').replace('*', '*+')})*+".join(m) for m in MARKERS) + ")"


def _runs(text: str) -> list[tuple[int, str]]:
    """Where base64 runs begin, and the runs: lines of nothing else joined, runs on one line, and runs of strings joined over lines."""
    found = []
    for m in _WRAPPED.finditer(text):
        pieces = m[0].split()
        end = next((n + 1 for n, x in enumerate(pieces) if x.endswith("=")), len(pieces))
        found.append((m.start(), "".join(pieces[:end])))
        if end == len(pieces) > 2 and len(pieces[-1]) < len(pieces[0]):
            found.append((m.start(), "".join(pieces[:-1])))
    found += [(m.start(), m[0]) for m in _RUN.finditer(text)]
    found += [(max(0, text.find(m[0][:16])), m[0]) for m in _RUN.finditer(_GLUE.sub("", text))]
    return [(at, run) for at, run in dict.fromkeys(found) if any(m in run for m in MARKERS)]


def decoded_armour(text: str, depth: int = 0) -> tuple[int, str] | None:
    """Offset and BEGIN line of the first private key in base64, encoded once or twice."""
    for at, run in _runs(text):
        run = run.rstrip("=")
        run = run[: len(run) - (len(run) % 4 == 1)]
        inner = base64.b64decode(run + "=" * (-len(run) % 4)).decode("utf-8", "replace").replace("\\n", "\n")
        for m in _ARMOUR.finditer(inner):
            if _BODY.search(m[2].split("-----END")[0]):
                return at, m[1]
        if depth == 0 and (twice := decoded_armour(inner, 1)):
            return at, twice[1]
    return None


def encoded_armour(texts: DataFrame) -> DataFrame:
    """The first base64-encoded private key of each text; only texts with a marker (over line joints too) leave the JVM."""
    def run(batches):
        for b in batches:
            found = [(rel, text.count("\n", 0, f[0]) + 1, "private-key", f"{f[1]} (base64-encoded)") for rel, text in zip(b.column("rel").to_pylist(), b.column("text").to_pylist()) if (f := decoded_armour(text))]
            yield pa.RecordBatch.from_arrays([pa.array([f[n] for f in found], t) for n, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.string()))], names=["file", "line", "kind", "detail"])

    return texts.where(c("text").rlike(MARKED)).select("rel", "text").mapInArrow(run, "file string, line int, kind string, detail string")


def notebook_armour(facts: DataFrame) -> DataFrame:
    """Private keys in outputs, Markdown and metadata of notebooks; the line is the cell's number."""
    o = facts.where("kind = 'output'").select(F.concat("rel", lit("\x1f"), c("line").cast("string"), lit("\x1f"), c("parent")).alias("rel"), c("value").alias("text"))
    part = F.split("file", "\x1f")
    return armour(o).select(F.get(part, lit(0)).alias("file"), F.get(part, lit(1)).cast("int").alias("line"), "kind", "detail")


def text_credentials(texts: DataFrame) -> DataFrame:
    """Provider credentials in files that aren't Python, by line."""
    l = lines(texts.where(f"not {is_python()}").where(c("text").rlike(ANY_SHAPE)))
    return _credentials(l, c("text")).select(c("rel").alias("file"), "line", lit("credential").alias("kind"), F.concat(lit("of the form "), "shape").alias("detail"))


def findings(files: DataFrame, texts: DataFrame, facts: DataFrame) -> DataFrame:
    """file, line, kind, detail and verdict of all key findings of a tree; every one is for review. facts may be those of relevant()."""
    parts = [bindings(facts), key_arguments(facts), nearest_keys(facts), derived_keys(facts), literal_credentials(facts), notebook_armour(facts), text_credentials(texts), config_lines(texts), json_values(texts), key_files(files), jwks(texts), armour(texts)]
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["file", "line", "kind", "detail"]).withColumn("verdict", lit("REVIEW"))


def verdict(found: DataFrame, facts: DataFrame, texts: DataFrame, archives: DataFrame | None = None) -> DataFrame:
    """One row: n_findings, n_read, n_not_parsed, n_not_opened, verdict. archives has a column outcome, a row an archive."""
    one = lambda df, *n: df.agg(*n).withColumn("one", lit(1))
    j = one(found, F.count("*").alias("n_findings")).join(one(texts, F.count("*").alias("n_read")), "one").join(one(facts, F.count_if(c("kind") == "unparsed").alias("n_not_parsed")), "one")
    j = j.join(one(archives, F.count_if(c("outcome") != "read").alias("n_not_opened")), "one") if archives is not None else j.withColumn("n_not_opened", lit(0).cast("long"))
    ladder = F.when((c("n_findings") > 0) | (c("n_not_parsed") > 0), "REVIEW").when(c("n_read") == 0, "NOT-ANALYSED").otherwise("NOTHING-FOUND")
    return j.select("n_findings", "n_read", "n_not_parsed", "n_not_opened", ladder.alias("verdict"))
