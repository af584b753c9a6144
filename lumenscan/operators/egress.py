"""Network reach: imports, calls, programs, pages and addresses that name another host.

Facts of Python files are judged once: one projection gives the array of the findings of a fact, so a tree is parsed once.
Lines of scripts, pages and JavaScript are judged the same way, each file kind in one narrow pass."""

from __future__ import annotations

import sys
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenscan.sources.pyfacts import is_python
from lumenscan.sources.tree import extension, lines

c, lit = F.col, F.lit
NETWORK = (
    "requests urllib3 httpcore httpx aiohttp webbrowser xmlrpc.client multiprocessing.connection multiprocessing.managers asyncore zmq redis pymongo psycopg2 pika kafka paho tornado openai anthropic huggingface_hub transformers wandb socket _socket http.client"
    " urllib.request stripe minio asyncpg ldap3 httplib2 fabric celery aiosmtplib selenium kubernetes sentry_sdk posthog ddtrace opentelemetry.exporter boto3 google.cloud rollbar websocket nntplib ftplib smtplib poplib imaplib telnetlib pyodbc cx_Oracle asyncssh paramiko motor"
).split()
DEPENDENCY = "h2 h11 hpack hyperframe wsproto".split()
LISTENER = "http.server socketserver wsgiref.simple_server smtpd".split()
PERIPHERAL = "bleak bluetooth bluepy pygatt simplepyble meshtastic zigpy can serial usb".split()
NATIVE = "ctypes cffi _winapi _posixsubprocess".split()
SHELLS = "bash cmd dash ksh powershell pwsh sh zsh".split()
#: Programs that start the program named after their own options.
WRAPPERS = "command doas env exec ionice nice nohup setsid stdbuf strace sudo time timeout watch xargs".split()
SPAWNS = "Popen call check_call check_output create_subprocess_exec execl execle execlp execv execve execvp execvpe getoutput popen run spawn spawnl spawnlp spawnv spawnvp startfile".split()
DYNAMIC = "importlib.__import__ importlib.import_module marshal.loads pickle.Unpickler pickle.load pickle.loads runpy.run_module runpy.run_path".split()
SCHEMES = "(?i)^(?:ftp|https?|wss?)://"
PROGRAMS = "curl wget nc ncat netcat socat ssh scp sftp rsync ftp telnet pip pip3 npm npx yarn pnpm docker podman xdg-open aria2c".split()
GIT_REMOTE = "push pull fetch clone ls-remote".split()
BUILDERS = "Request create_engine PoolManager Client AsyncClient Session ClientSession HTTPConnectionPool".split()
JS_PACKAGES = "axios got node-fetch undici ws nodemailer @sentry/node posthog-js @datadog/browser-rum mixpanel @segment/analytics-next @opentelemetry/api rollbar aws-sdk @aws-sdk/client-s3 @google-cloud/storage firebase http https net tls dgram".split()
URL = r"""(?i)\bhttps?://[^\s"'<>()]+"""


SCHEME = r"(?:[a-zA-Z][-+.0-9a-zA-Z]*:)?"


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute or protocol-relative address, without user, port and brackets."""
    h = F.lower(F.regexp_extract(url, rf"^{SCHEME}//(?:[^@?#/]*@)?(\[[^\]]*\]|[^:?#/]*)", 1))
    return F.regexp_replace(h, r"^\[|\]$", "")


def is_loopback(host: Column) -> Column:
    return host.rlike(r"^(localhost|.*\.localhost|127(\.\d{1,3}){3}|::1|0\.0\.0\.0)$")


def _foreign(url: Column) -> Column:
    return (host_of(url) != "") & ~is_loopback(host_of(url))


def _module_in(name: Column, modules: list[str]) -> Column:
    return name.rlike("^(" + "|".join(m.replace(".", r"\.") for m in modules) + r")(\.|$)")


def _one(kind: str, detail: Column, top: Column | None = None) -> Column:
    return F.struct(lit(kind).alias("kind"), detail.alias("detail"), (lit(None).cast("string") if top is None else top).alias("top"))


def _when(condition: Column, *findings: Column) -> Column:
    return F.when(condition, F.array(*findings))


def _joined(*arrays: Column) -> Column:
    return F.concat(*[F.coalesce(a, F.array().cast("array<struct<kind:string,detail:string,top:string>>")) for a in arrays])


def _basename(word: Column) -> Column:
    return F.lower(F.regexp_replace(F.element_at(F.split(F.translate(word, "\\", "/"), "/"), -1), r"(?i)\.exe$", ""))


def _unwrapped(argv: Column) -> Column:
    """argv without the wrappers before its program and their options, settings and numbers."""
    names = F.transform(argv, _basename)
    skipped = lambda i: F.get(names, i).isin(*WRAPPERS) | F.get(argv, i).rlike(r"^(-.*|[A-Za-z_]\w*=.*|[0-9.]+[smhd]?)$")
    first = F.element_at(F.filter(F.sequence(lit(0), F.size(argv) - 1), lambda i: ~skipped(i)), 1)
    return F.when((F.size(argv) > 0) & F.get(names, lit(0)).isin(*WRAPPERS) & first.isNotNull(), F.slice(argv, first + 1, F.size(argv))).otherwise(argv)


def _modules(module: Column) -> list[Column]:
    """Findings of an imported module."""
    detail, top = F.concat(lit("import "), module), F.element_at(F.split(module, r"\."), 1)
    kinds = [("network-import", _module_in(module, NETWORK)), ("network-dependency", _module_in(module, DEPENDENCY)), ("inbound-listener", _module_in(module, LISTENER)), ("peripheral-link", _module_in(module, PERIPHERAL) | module.rlike(r"^zigpy_\w")), ("native-call", _module_in(module, NATIVE))]
    return [F.when(found, _one(kind, detail, top)) for kind, found in kinds]


def _spelled(module: Column) -> Column:
    """The module a compatibility spelling stands for."""
    return F.regexp_replace(F.regexp_replace(module, r"^(six|future)\.moves\.", ""), "^http_client$", "http.client")


def python_findings(texts: DataFrame, facts: DataFrame, tree=lambda rel: lit("")) -> DataFrame:
    """file, line, kind, detail of Python files. A module at the root of a tree, or in its source folder, shadows a listed one; tree gives the tree of a path where the table holds several."""
    call, name, value = c("kind") == "call", c("name"), F.coalesce("value", lit(""))
    modules = F.when(c("kind") == "import", F.array(name)).when((c("kind") == "from") & (c("level") == 0), F.concat(F.array(name), F.transform("args", lambda a: F.concat(name, lit("."), a))))
    imported = F.flatten(F.transform(modules, lambda m: F.filter(F.array(*_modules(_spelled(m))), lambda x: x.isNotNull())))
    argv = _unwrapped(c("argv"))
    program = _basename(F.get(argv, lit(0)))
    shell = F.try_element_at("kws", lit("shell")).isin("1", "True") | value.isin("os.popen", "os.system", "subprocess.getoutput", "asyncio.create_subprocess_shell")
    script = program.isin(*SHELLS) & (F.exists(argv, lambda a: a.rlike("^[-/][a-z]*c$")) | (F.size(argv) > 1))
    addresses = F.filter(F.concat("args", F.map_values("kws")), lambda a: a.rlike(SCHEMES))
    url = F.get(addresses, lit(0))
    away, traced = call & _foreign(url), _module_in(F.coalesce("local", "real", lit("")), NETWORK)
    builds, fetches = name.isin(*BUILDERS), name.rlike("(?i)^(connect|delete|fetch|get|open|patch|post|put|request|urlopen)$")
    dynamic = ((c("parent") == "name") & name.isin("__import__", "compile", "eval", "exec")) | value.isin(*DYNAMIC)
    named = F.concat(name, lit("(...)"))
    spawned = call & (F.size(argv) > 0)
    listens = value.isin("asyncio.start_server", "logging.config.listen", "socket.create_server") | name.isin("create_server", "start_server", "start_unix_server")
    magic = c("kind") == "magic"
    found = _joined(
        imported,
        _when(call & F.coalesce(shell, lit(False)), _one("subprocess-shell", F.concat(name, lit(" runs a shell")))),
        _when(spawned & script, _one("subprocess-shell", F.concat(lit("starts "), program))),
        _when(spawned & program.isin(*PROGRAMS), _one("subprocess-net-binary", F.concat(lit("starts "), program))),
        _when(spawned & program.isin("python", "python3") & F.array_contains(argv, lit("pip")), _one("subprocess-net-binary", lit("starts pip"))),
        _when(spawned & (program == "git") & F.exists(argv, lambda a: a.isin(*GIT_REMOTE)), _one("git-remote", F.concat_ws(" ", argv))),
        _when(call & dynamic, _one("dynamic-exec", named)),
        _when(call & (c("parent") == "attribute") & name.isin("eval", "exec"), _one("method-named-exec", named)),
        _when(call & listens, _one("inbound-listener", named)),
        _when(away & builds, _one("network-target", url)),
        _when(call & (F.size(addresses) > 0) & is_loopback(host_of(url)), _one("loopback-call", url)),
        _when(away & traced & ~builds, _one("network-call", url)),
        _when(away & ~traced & ~builds & fetches, _one("unresolved-call", url)),
        _when(call & (value == "asyncio.open_connection"), _one("network-call", named)),
        _when(call & name.isin(*SPAWNS) & (F.coalesce("real", lit("")).isin("os", "pty", "subprocess")) & (F.size("args") > 0) & F.get("args", lit(0)).isNull() & F.coalesce(F.size("argv") <= 0, lit(True)), _one("unresolved-call", F.concat(name, lit(" starts a program that isn't written here")))),
        _when(magic & c("value").rlike("^(!|%%?(bash|script|sh|sx|system)\\b)"), _one("subprocess-shell", F.substring("value", 1, 80))),
        _when(magic & c("value").rlike(r"^[!%]%?\s*(pip|pip3|conda|mamba|uv)\b"), _one("subprocess-net-binary", F.substring("value", 1, 80))),
        _when(c("kind") == "unparsed", _one("unparseable-source", F.concat(lit("not parsed: "), "value"))),
    )
    rows = facts.where("kind in ('import', 'from', 'call', 'magic', 'unparsed')").select("rel", "line", F.explode(found).alias("f")).select(c("rel").alias("file"), "line", "f.kind", "f.detail", tree(c("rel")).alias("tree"), F.coalesce("f.top", F.concat(lit("/"), "rel")).alias("top"))
    part = F.split(F.regexp_replace(F.regexp_replace("rel", "^(src|lib|python)/", ""), r"(/__init__)?\.pyw?$", ""), "/")
    own = texts.where(is_python()).select(tree(c("rel")).alias("tree"), F.get(part, lit(0)).alias("top")).distinct()
    return rows.join(own, ["tree", "top"], "left_anti").select("file", "line", "kind", "detail").dropDuplicates()


TAG = r"(?is)<(a|audio|embed|iframe|image|img|input|link|object|script|source|track|use|video)\b[^>]*>"
ADDRESS_ATTRIBUTE = r"""(?is)[\s"'](data|href|poster|src|xlink:href)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
SET_ATTRIBUTE = r"""(?is)\s(srcset|imagesrcset)\s*=\s*("[^"]*"|'[^']*')"""
REFRESH = r"""(?is)<meta\b[^>]*\brefresh\b[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
CSS_URL = r"""(?is)\burl\(\s*["']?([^"')\s]+)"""
CSS_IMPORT = r"""(?is)@import\s+["']([^"']+)["']"""
IN_PAGE = r"""(?s)\b(fetch|sendBeacon|importScripts|location(?:\.href)?|location\.(?:assign|replace)|window\.open)\s*[=(]\s*["']([^"']+)["']"""


def page_addresses(texts: DataFrame) -> DataFrame:
    """file, tag, attribute, address of every address that markup names, in tags, styles, refreshes and scripts; narrow."""
    every = lambda text, p, n=0: F.regexp_extract_all(text, lit(p), lit(n))
    one = lambda tag, attribute, address: F.struct(tag.alias("tag"), attribute.alias("attribute"), F.replace(F.regexp_replace(address, """^["']|["']$""", ""), lit("&amp;"), lit("&")).alias("address"))
    fixed = lambda tag, attribute, p: F.transform(every("text", p, 1), lambda a: one(lit(tag), lit(attribute), a))

    def of_tag(m: Column) -> Column:
        tag = F.lower(F.regexp_extract(m, TAG, 1))
        plain = F.transform(every(m, ADDRESS_ATTRIBUTE), lambda x: one(tag, F.lower(F.regexp_extract(x, ADDRESS_ATTRIBUTE, 1)), F.regexp_extract(x, ADDRESS_ATTRIBUTE, 2)))
        sets = F.flatten(F.transform(every(m, SET_ATTRIBUTE, 2), lambda x: F.transform(F.split(F.regexp_replace(x, """^["']|["']$""", ""), r",\s+"), lambda y: one(tag, lit("srcset"), F.regexp_extract(y, r"^\s*(\S+)", 1)))))
        return F.concat(plain, sets)

    scripts = F.transform(every("text", IN_PAGE), lambda m: one(lit("script"), F.regexp_extract(m, IN_PAGE, 1), F.regexp_extract(m, IN_PAGE, 2)))
    found = F.concat(F.flatten(F.transform(every("text", TAG), of_tag)), fixed("meta", "refresh", REFRESH), fixed("style", "url", CSS_URL), fixed("style", "import", CSS_IMPORT), scripts)
    return texts.select(c("rel").alias("file"), F.explode(found).alias("m")).select("file", "m.*")


def page_findings(texts: DataFrame) -> DataFrame:
    """Addresses in pages that name another host: links apart from what a page loads."""
    a = page_addresses(texts.where(extension(c("rel")).isin(".html", ".htm", ".svg", ".vue", ".xhtml")))
    out = a.where(_foreign(c("address")))
    return out.groupBy("file", F.when(c("tag") == "a", "external-link").otherwise("html-external").alias("kind"), "address").agg(F.count("*").alias("n"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _of_lines(texts: DataFrame, found: Column, comment: str, within: str = "") -> DataFrame:
    """Findings of every line that is no comment; `within` are comments inside a line."""
    l = lines(texts).withColumn("text", F.regexp_replace("text", within, "") if within else c("text")).where(~F.ltrim("text").rlike(comment))
    return l.select(c("rel").alias("file"), "line", F.explode(found).alias("f")).select("file", "line", "f.kind", "f.detail")


def javascript_findings(texts: DataFrame) -> DataFrame:
    """Imports, calls, programs and addresses of JavaScript and TypeScript, by line; comments are left out."""
    code = c("text")
    package = F.regexp_replace(F.regexp_extract(code, r"""(?:from|require\(|import\(|import)\s*["']([^"'.][^"']*)["']""", 1), "^(node|npm):", "")
    url = F.filter(F.regexp_extract_all(code, lit(URL), lit(0)), lambda u: _foreign(u) & ~host_of(u).rlike(r"(^|\.)w3\.org$"))
    trimmed = _stripped(c("text"))
    found = _joined(
        _when(package.isin(*JS_PACKAGES), _one("network-import", package)),
        _when(code.rlike(r"\$\.ajax\s*\(|\bnavigator\.sendBeacon\s*\(|\b(axios(\.\w+)?|fetch)\s*\(|\b(https?|net|tls)\.(connect|get|request)\s*\(|new\s+(XMLHttpRequest|WebSocket|EventSource)\b"), _one("network-call", trimmed)),
        _when(code.rlike(r"\bchild_process\b|(^|[^.\w])(exec|execFile|spawn|fork)(Sync)?\s*\(\s*[\"'`]"), _one("subprocess-shell", trimmed)),
        _when(code.rlike(r"new\s+Function\s*\(|(^|[^.\w])eval\s*\("), _one("dynamic-exec", trimmed)),
        F.transform(url, lambda u: _one("external-url", u)),
    )
    return _of_lines(texts.where(extension(c("rel")).isin(".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".vue")), found, r"^(//|\*|/\*)", r"/\*[^\n]*?\*/")


def script_findings(texts: DataFrame) -> DataFrame:
    """Network programs where a command starts, else as a word, once a line; listeners; images of container files."""
    docker = c("rel").rlike(r"(?i)(^|/)(containerfile|dockerfile)[^/]*$")
    pipeline = c("rel").rlike(r"(?i)(^|/)(\.github/workflows/.*|\.circleci/.*|\.?gitlab-ci|\.travis|azure-pipelines|bitbucket-pipelines|appveyor|(docker-)?compose)\.ya?ml$|(^|/)(jenkinsfile|justfile|procfile|tox\.ini)$")
    is_script = extension(c("rel")).isin(".bash", ".bat", ".cmd", ".mk", ".ps1", ".sh") | c("rel").rlike(r"(?i)(^|/)makefile$") | docker | pipeline
    commands = F.transform(F.split("text", r"\|\||&&|[;|&(`]|\bthen\b|\bdo\b|\$\("), lambda s: F.regexp_replace(s, r"(?i)^\s*(?:-\s+)?(?:(?:run|script|command|before_script|after_script|commands)\s*[:=]\s*[|>]?\s*)?(?:RUN\s+|CMD\s+|@|-(?=\w)|(?:sudo|exec|env|nohup|time|command)\s+|[A-Za-z_]\w*=\S*\s+)*", ""))
    named = F.filter(commands, lambda s: F.lower(F.regexp_extract(s, r"^([\w.+-]+)", 1)).isin(*PROGRAMS) & ~s.rlike(r"\s--(help|version)\b"))
    program = F.lower(F.regexp_extract(F.get(named, lit(0)), r"^([\w.+-]+)", 1))
    word = F.get(F.array_intersect(F.split(F.lower("text"), r"[^\w.+-]+"), F.array(*map(lit, PROGRAMS))), lit(0))
    listens = c("text").rlike(r"(?i)\b(nc|ncat|netcat)\s+(-\w+\s+)*-\w*l|\bsocat\b.*\b(tcp|udp)[46]?-listen\b")
    image = F.regexp_extract("text", r"(?i)^\s*(?:FROM|COPY\s+--from=)\s*(?:--\S+\s+)*(\S+)", 1)
    found = _joined(
        _when(listens, _one("inbound-listener", _stripped(c("text")))),
        _when(~listens & program.isNotNull(), _one("script-network-command", program)),
        _when(~listens & program.isNull() & word.isNotNull(), _one("script-network-word", word)),
        _when(docker & (image != "") & (image != "scratch") & ~image.rlike("^[0-9]+$"), _one("declared-remote-source", image)),
    )
    return _of_lines(texts.where(is_script), found, "^(#|REM |::)")


def startup_findings(texts: DataFrame) -> DataFrame:
    """Import lines of .pth files and entries of .start files."""
    found = _joined(_when(F.ltrim("text").rlike(r"^import[ \t]") | (c("rel").rlike(r"\.start$") & (F.trim("text") != "")), _one("startup-exec", F.trim("text"))))
    return _of_lines(texts.where(c("rel").rlike(r"\.(pth|start)$")), found, "^#")


#: First bytes (hexadecimal) of what isn't analysed, by what it is.
ARTIFACTS = {"ELF program": "7F454C46", "Windows program": "4D5A", "Mach-O program": "CFFAEDFE", "Java class": "CAFEBABE", "WebAssembly": "0061736D", "zip archive": "504B0304", "gzip": "1F8B", "bzip2": "425A68", "xz": "FD377A585A00", "Zstandard": "28B52FFD", "pickle": "8004", "pickle 5": "8005", "pyc": "0D0A"}
ARTIFACT_SUFFIXES = [".a", ".bin", ".class", ".dll", ".dylib", ".egg", ".exe", ".jar", ".joblib", ".npy", ".npz", ".o", ".pickle", ".pkl", ".pt", ".pth.tar", ".pyc", ".pyd", ".pyx", ".so", ".wasm", ".whl"]


def artifacts(files: DataFrame) -> DataFrame:
    """unanalysed-artifact of files(rel, size, content) that are compiled, packed or pickled, by their first bytes or their name; small UTF-8 text is none, Cython always is."""
    head = F.hex(F.substring("content", 1, 8))
    magic = F.coalesce(*[F.when(head.startswith(m), lit(what)) for what, m in ARTIFACTS.items()])
    suffix = extension(c("rel")).isin(*ARTIFACT_SUFFIXES)
    text = (c("size") < 65_536) & F.is_valid_utf8(c("content").cast("string")) & ~F.contains(F.hex("content"), lit("00")) & (extension(c("rel")) != ".pyx")
    return files.where((magic.isNotNull() | suffix) & ~F.coalesce(text, lit(False))).select(c("rel").alias("file"), lit(0).alias("line"), lit("unanalysed-artifact").alias("kind"), F.coalesce(magic, extension(c("rel"))).alias("detail"))


def findings(texts: DataFrame, facts: DataFrame, files: DataFrame | None = None, deps: DataFrame | None = None, remotes: DataFrame | None = None) -> DataFrame:
    """file, line, kind, detail of everything; with files also artifacts, with deps and remotes what manifests declare."""
    pages = page_findings(texts).select("file", lit(0).alias("line"), "kind", c("address").alias("detail"))
    parts = [python_findings(texts, facts), pages, javascript_findings(texts), script_findings(texts), startup_findings(texts)]
    if files is not None:
        parts.append(artifacts(files))
    if deps is not None:
        listed = sorted({m.split(".")[0].replace("_", "-").lower() for m in NETWORK})
        name = F.regexp_replace(F.lower(F.trim("name")), "[-_.]+", "-")
        parts.append(deps.where(name.isin(*listed)).select("file", "line", lit("declared-network-dependency").alias("kind"), c("name").alias("detail")))
    if remotes is not None:
        parts.append(remotes.select("file", "line", lit("declared-remote-source").alias("kind"), "detail"))
    return reduce(DataFrame.unionByName, parts)


def verdict(found: DataFrame, texts: DataFrame) -> DataFrame:
    """One row: n_findings, n_read, verdict."""
    n = found.agg(F.count("*").alias("n_findings")).withColumn("one", lit(1))
    read = texts.agg(F.count("*").alias("n_read")).withColumn("one", lit(1))
    ladder = F.when(c("n_read") == 0, "NOT-ANALYSED").when(c("n_findings") > 0, "FINDINGS").otherwise("CLEAN")
    return n.join(read, "one").select("n_findings", "n_read", ladder.alias("verdict"))  # one row by one row


def unlisted_programs(facts: DataFrame) -> DataFrame:
    """program and number of files: programs started from Python that are on no list."""
    program = _basename(F.get(_unwrapped(c("argv")), lit(0)))
    known = sorted({*PROGRAMS, *SHELLS, *WRAPPERS, "git", "python", "python3"})
    seen = facts.where("kind = 'call' and size(argv) > 0 and (real in ('os', 'pty', 'subprocess') or value like 'asyncio.%')").select("rel", program.alias("program"))
    return seen.where((c("program") != "") & ~c("program").isin(*known)).groupBy("program").agg(F.countDistinct("rel").alias("n_files"))


def unlisted_js_imports(texts: DataFrame) -> DataFrame:
    """package and number of files: packages that JavaScript or TypeScript imports and that are on no list; node's own modules without a network are none."""
    own = "assert buffer child_process crypto events fs fs/promises module os path perf_hooks process querystring readline stream string_decoder timers url util v8 vm worker_threads zlib".split()
    name = F.regexp_replace(F.regexp_extract("text", r"""(?:from|require\(|import\(|import)\s*["']([^"'.][^"']*)["']""", 1), "^(node|npm):", "")
    package = F.regexp_extract(name, r"^(@[^/]+/[^/]+|[^/]+)", 1)
    l = lines(texts.where(extension(c("rel")).isin(".cjs", ".js", ".jsx", ".mjs", ".ts", ".tsx", ".vue"))).where(~F.ltrim("text").rlike(r"^(//|\*|/\*)"))
    return l.select("rel", name.alias("name"), package.alias("package")).where((c("package") != "") & ~c("name").isin(*JS_PACKAGES, *own) & ~c("package").isin(*JS_PACKAGES, *own)).groupBy("package").agg(F.countDistinct("rel").alias("n_files"))


def files_not_read(files: DataFrame, texts: DataFrame) -> DataFrame:
    """rel, why of files that no scanner reads: too large, or of no kind that is read."""
    kinds = extension(c("rel")).isin(".bash", ".bat", ".cfg", ".cjs", ".cmd", ".htm", ".html", ".ini", ".ipynb", ".js", ".json", ".jsx", ".mjs", ".mk", ".properties", ".ps1", ".pth", ".py", ".pyw", ".sh", ".svg", ".toml", ".ts", ".tsx", ".txt", ".vue", ".xhtml", ".yaml", ".yml")
    named = c("rel").rlike(r"(?i)(^|/)(makefile|dockerfile[^/]*|containerfile|jenkinsfile|justfile|procfile|pipfile|\.env[^/]*|\.npmrc|\.gitmodules)$")
    large = files.where("content is null").select("rel", lit("too large").alias("why"))
    return large.unionByName(files.where(c("content").isNotNull() & ~kinds & ~named).select("rel", lit("of no kind that is read").alias("why")))


def shadowed_imports(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """file, line, module of listed modules that the tree supplies itself."""
    module = F.when(c("kind") == "import", F.array("name")).when((c("kind") == "from") & (c("level") == 0), F.array("name"))
    seen = facts.where("kind in ('import', 'from')").select(c("rel").alias("file"), "line", F.explode(module).alias("module")).where(_module_in(c("module"), NETWORK))
    part = F.split(F.regexp_replace(F.regexp_replace("rel", "^(src|lib|python)/", ""), r"(/__init__)?\.pyw?$", ""), "/")
    own = texts.where(is_python()).select(F.get(part, lit(0)).alias("top")).distinct()
    return seen.withColumn("top", F.element_at(F.split("module", r"\."), 1)).join(own, "top", "left_semi").drop("top")


def unlisted_imports(texts: DataFrame, facts: DataFrame) -> DataFrame:
    """module and number of files: imported top-level modules on no list, of no standard library and not the tree's own."""
    top = F.element_at(F.split("name", r"\."), 1)
    seen = facts.where("kind = 'import' or (kind = 'from' and level = 0)").select(c("rel").alias("file"), top.alias("module")).distinct()
    listed = sorted({m.split(".")[0] for m in (*NETWORK, *DEPENDENCY, *LISTENER, *PERIPHERAL, *NATIVE)} | set(sys.stdlib_module_names))
    part = F.split(F.regexp_replace(F.regexp_replace("rel", "^(src|lib|python)/", ""), r"(/__init__)?\.pyw?$", ""), "/")
    own = texts.where(is_python()).select(F.get(part, lit(0)).alias("module")).distinct()
    return seen.where(~c("module").isin(*listed)).join(own, "module", "left_anti").groupBy("module").agg(F.count("*").alias("n_files"))
