"""Rows out of source texts: routes, endpoint calls, tables, migration findings, symbols.

Line-shaped rules are SQL functions over exploded lines; what needs a syntax tree or a scan
with state is an Arrow function over whole files (path, text)."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T

#: Fixed values of the migration rules.
REPEATABLE_VERBS = (
    "CREATE TABLE", "CREATE INDEX", "CREATE UNIQUE INDEX", "CREATE VIEW", "CREATE SEQUENCE", "CREATE TYPE", "CREATE SCHEMA",
    "DROP TABLE", "DROP INDEX", "DROP VIEW", "DROP SEQUENCE", "DROP TYPE", "DROP SCHEMA",
)
DESTRUCTIVE_VERBS = ("DROP TABLE", "DROP SCHEMA", "TRUNCATE")
#: Comment that lets a destructive statement pass.
OVERRIDE_COMMENT = "ALLOW_DESTRUCTIVE"


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) from 1; null texts have one empty line."""
    rows = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("at", "line"))
    return rows.select("path", (F.col("at") + 1).alias("line_no"), "line")


def table_references(files: DataFrame) -> DataFrame:
    """(path, table, operation, line_no): DDL in SQL files, table names of mapped models elsewhere."""
    # The patterns of statements and of models.
    name = r"(?:IF\s+(?:NOT\s+)?EXISTS\s+)?([A-Za-z0-9_.\"`]+)"
    ddl = {
        "CREATE": rf"(?i)\bCREATE\s+(?:UNLOGGED\s+|TEMP\s+|TEMPORARY\s+)?TABLE\s+{name}",
        "ALTER": rf"(?i)\bALTER\s+TABLE\s+(?:ONLY\s+)?{name}",
        "DROP": rf"(?i)\bDROP\s+TABLE\s+{name}",
        "REFERENCES": r"(?i)\bREFERENCES\s+([A-Za-z0-9_.\"`]+)\s*(?:\(|$)",
    }
    models = (
        r"(?i)__tablename__\s*=\s*[\"']([A-Za-z0-9_]+)[\"']", r"(?i)\b(?:pgTable|mysqlTable|sqliteTable)\s*\(\s*[\"']([A-Za-z0-9_]+)[\"']",
        r"(?i)@Entity\s*\(\s*[\"']([A-Za-z0-9_]+)[\"']", r"(?i)@@map\s*\(\s*[\"']([A-Za-z0-9_]+)[\"']",
    )
    rows, sql = file_lines(files), F.lower("path").endswith(".sql")
    code = F.regexp_replace("line", "--.*$", "")

    def found(where: Column, line: Column, pattern: str, operation: str) -> DataFrame:
        hits = rows.where(where).select("path", "line_no", F.explode(F.regexp_extract_all(line, F.lit(pattern), F.lit(1))).alias("name"))
        return hits.select("path", T.table_name(F.col("name")).alias("table"), F.lit(operation).alias("operation"), "line_no")

    parts = [found(sql, code, p, op) for op, p in ddl.items()] + [found(~sql, F.col("line"), p, "MODEL") for p in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.where(~F.upper("table").isin("IF", "ONLY"))


def lineage(references: DataFrame, table: str) -> DataFrame:
    """References to a table in order of path and line."""
    return references.where(F.col("table") == table).orderBy("path", "line_no", "operation")


def statements(files: DataFrame) -> DataFrame:
    """(path, first_line, statement): SQL statements without comments, in one pass per file."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, body in zip(pdf["path"], pdf["text"]):
                words, first = [], 0
                for n, line in enumerate((body or "").splitlines(), 1):
                    pieces = line.split("--", 1)[0].split(";")
                    for k, piece in enumerate(pieces):
                        if piece.strip():
                            first = first if words else n
                            words.append(" ".join(piece.split()))
                        if k < len(pieces) - 1 and words:
                            out.append((path, first, " ".join(words)))
                            words = []
                if words:
                    out.append((path, first, " ".join(words)))
            yield pd.DataFrame(out, columns=["path", "first_line", "statement"])

    return files.select("path", "text").mapInPandas(split, "path string, first_line long, statement string")


def migration_findings(files: DataFrame) -> DataFrame:
    """(path, line_no, severity, preview) of statements that fail when run twice or destroy data.

    A destructive statement is let pass by an override comment on one of the three lines
    before it."""
    upper = F.upper("statement")

    def has(words: tuple[str, ...]) -> Column:
        return upper.rlike("|".join(re.escape(w) for w in words))

    guarded = upper.contains("IF NOT EXISTS") | upper.contains("IF EXISTS")
    rows = statements(files).withColumn("preview", F.substring("statement", 1, 120))
    twice = rows.where(has(REPEATABLE_VERBS) & ~guarded).select("path", F.col("first_line").alias("line_no"), F.lit("NON_IDEMPOTENT").alias("severity"), "preview")
    overrides = file_lines(files).where(F.contains("line", F.lit(OVERRIDE_COMMENT))).select("path", F.explode(F.sequence(F.col("line_no") + 1, F.col("line_no") + 3)).alias("line_no"))
    destroys = rows.where(has(DESTRUCTIVE_VERBS)).select("path", F.col("first_line").alias("line_no"), F.lit("DESTRUCTIVE_UNGUARDED").alias("severity"), "preview")
    return twice.unionAll(destroys.join(overrides.distinct(), ["path", "line_no"], "left_anti").select(*twice.columns))


def api_routes(files: DataFrame) -> DataFrame:
    """(path, method, route, canonical, handler, line_no): decorated Python routes, with their
    router's prefix, and router calls of JavaScript."""
    prefix = F.regexp_replace(F.regexp_extract("text", r"(?is)APIRouter\s*\([^)]*prefix\s*=\s*[\"']([^\"']+)[\"']", 1), "/+$", "")
    rows = file_lines(files).join(files.select("path", prefix.alias("prefix")), "path")
    order = Window.partitionBy("path").orderBy("line_no").rowsBetween(1, 5)
    name = F.regexp_extract("line", r"(?i)(?:async\s+)?(?:def|fn)\s+([A-Za-z0-9_]+)\s*\(", 1)
    rows = rows.withColumn("next_def", F.first_value(F.when(name != "", name), F.lit(True)).over(order))
    # The names of routers and the verbs.
    python = r"(?i)@(?:app|router|api_router)\.(get|post|put|delete|patch|options|head)\s*\(\s*[\"']([^\"']*)[\"']"
    script = r"(?i)\b(?:app|router)\.(get|post|put|delete|patch|all)\s*\(\s*[\"']([^\"']+)[\"'](?:\s*,\s*([A-Za-z0-9_]+))?"
    decorated = rows.where(F.col("line").rlike(python))
    sub = F.regexp_extract("line", python, 2)
    slash = F.when((sub != "") & ~sub.startswith("/"), "/").otherwise("")
    a = decorated.select("path", F.upper(F.regexp_extract("line", python, 1)).alias("method"), F.concat("prefix", slash, sub).alias("route"), F.coalesce("next_def", F.lit("handler")).alias("handler"), "line_no")
    called = rows.where(F.col("line").rlike(script) & ~F.col("line").rlike(r"@(?:app|router|api_router)\."))
    given = F.regexp_extract("line", script, 3)
    b = called.select("path", F.upper(F.regexp_extract("line", script, 1)).alias("method"), F.regexp_extract("line", script, 2).alias("route"), F.when(given == "", "anonymousHandler").otherwise(given).alias("handler"), "line_no")
    return a.unionAll(b).withColumn("canonical", T.endpoint_path(F.col("route")))


def endpoint_consumers(files: DataFrame) -> DataFrame:
    """(path, method, raw, canonical, symbol, line_no): calls of endpoints in client code."""
    # The names of callers and of base addresses.
    quote = "[\"'`]"
    target = r"((?:/api/|https?://[^/'\"`]+/api/|\$\{(?:API_URL|NEXT_PUBLIC_API_URL|BASE_URL|API_BASE)\}/api/)[^\"'`\s]+)"
    fetch = rf"(?i)\b(?:fetch|resilientFetch|authFetch|customFetch|useSWR)\s*(?:<[^>]+>)?\s*\(\s*{quote}{target}{quote}"
    client = rf"(?i)\b(?:axios|apiClient|api|httpClient)\.(get|post|put|delete|patch)\s*(?:<[^>]+>)?\(\s*{quote}{target}{quote}"
    method = r"(?i)method\s*:\s*[\"'](GET|POST|PUT|DELETE|PATCH)[\"']"
    symbol = F.regexp_extract("line", r"(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|const)\s+([A-Za-z0-9_]+)", 1)
    order = Window.partitionBy("path").orderBy("line_no")
    rows = file_lines(files).withColumns(
        {
            "near": F.array_join(F.collect_list("line").over(order.rowsBetween(0, 4)), " "),
            "symbol": F.last_value(F.when(symbol != "", symbol), F.lit(True)).over(order.rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    stated = F.upper(F.regexp_extract("near", method, 1))
    a = rows.where(F.col("line").rlike(fetch)).select("path", F.when(stated == "", "GET").otherwise(stated).alias("method"), F.regexp_extract("line", fetch, 1).alias("raw"), "symbol", "line_no")
    b = rows.where(F.col("line").rlike(client)).select("path", F.upper(F.regexp_extract("line", client, 1)).alias("method"), F.regexp_extract("line", client, 2).alias("raw"), "symbol", "line_no")
    return a.unionAll(b).withColumn("canonical", T.endpoint_path(F.col("raw")))


_DECLARATION = re.compile(
    r"^\s*(?:export\s+|default\s+|pub(?:\([^)]*\))?\s+|public\s+|private\s+|static\s+|async\s+|abstract\s+)*"
    r"(function|func|fn|def|class|struct|enum|trait|interface|type|impl)\s+([A-Za-z_]\w*)"
)
_KINDS = {"function": "function", "func": "function", "fn": "function", "def": "function", "class": "class", "struct": "struct", "enum": "enum", "trait": "interface", "interface": "interface", "type": "type", "impl": "impl"}
_LANGUAGES = {"py": "python", "go": "go", "rs": "rust", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescriptreact", "jsx": "typescriptreact", "sql": "sql"}


def language_of(path: str) -> str:
    end = path.rsplit(".", 1)[-1].lower() if "." in path else "unknown"
    return _LANGUAGES.get(end, end)


def _block_end(lines: list[str], at: int) -> int:
    """Last line of a declaration: its closing brace, or the end of what is indented below it."""
    depth, opened = 0, False
    for k in range(at, len(lines)):
        bare = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*", "", lines[k])
        opened |= "{" in bare
        depth += bare.count("{") - bare.count("}")
        if opened and depth <= 0:
            return k + 1
        if not opened and (bare.rstrip().endswith((";", ":")) or k - at > 3):
            break
    indent = len(lines[at]) - len(lines[at].lstrip())
    end = at
    for k in range(at + 1, len(lines)):
        if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip()) <= indent:
            break
        end = k if lines[k].strip() else end
    return end + 1


def symbols_of(path: str, body: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Strategy and (name, kind, start, end) of declarations: a syntax tree for Python that parses, else line rules."""
    if language_of(path) == "python":
        try:
            tree = ast.parse(body)
            kinds = {ast.FunctionDef: "function", ast.AsyncFunctionDef: "function", ast.ClassDef: "class"}
            found = [(n.name, kinds[type(n)], n.lineno, n.end_lineno) for n in ast.walk(tree) if type(n) in kinds]
            return "syntax_tree", sorted(found, key=lambda s: s[2:])
        except (SyntaxError, ValueError, RecursionError):
            pass
    lines = body.splitlines()
    hits = ((k, m) for k, line in enumerate(lines) if (m := _DECLARATION.match(line)))
    return "heuristic", [(m[2], _KINDS[m[1]], k + 1, _block_end(lines, k)) for k, m in hits]


def symbols(files: DataFrame) -> DataFrame:
    """(path, language, strategy, name, kind, start_line, end_line) of declared symbols."""
    def rows(path: str, body: str) -> list[tuple]:
        strategy, found = symbols_of(path, body)
        return [(path, language_of(path), strategy, *s) for s in found]

    return _per_file(files, rows, "path string, language string, strategy string, name string, kind string, start_line int, end_line int")


def _per_file(files: DataFrame, rows: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, b in zip(pdf["path"], pdf["text"]) for r in rows(p or "", b or "")], columns=names)

    return files.select("path", "text").mapInPandas(run, schema)


_IMPORTS = (
    re.compile(r"^\s*from\s+([.\w]+)\s+import\b"), re.compile(r"^\s*import\s+([\w.]+)"),
    re.compile(r"""(?:from|require\(|import\()\s*["']([^"']+)["']"""), re.compile(r"^\s*(?:pub\s+)?mod\s+(\w+)\s*;"), re.compile(r"^\s*use\s+(?:crate::)?([\w:]+)"),
)


def dependency_hints(files: DataFrame) -> DataFrame:
    """(path, hint): what a file imports, as written, once each."""
    def rows(path: str, body: str) -> list[tuple]:
        found = dict.fromkeys(m[1] for line in body.splitlines() for p in _IMPORTS if (m := p.search(line)))
        return [(path, h) for h in found]

    return _per_file(files, rows, "path string, hint string")


def resolved_dependencies(hints: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): hints as stored paths: the last part of an import matches a file's stem, in
    the importer's folder first, then the shortest path."""
    stem = F.element_at(F.split(F.regexp_replace(F.regexp_replace("hint", r"\.(js|ts|tsx|jsx|py|rs)$", ""), "::", "/"), r"[./]"), -1)
    wanted = hints.select(F.col("path").alias("src"), stem.alias("stem")).where("stem <> ''")
    folder = F.regexp_replace("path", "[^/]*$", "")
    file_stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    target = F.when(file_stem.isin("mod", "index", "__init__"), F.element_at(F.split(F.concat(F.lit("/"), folder), "/"), -2)).otherwise(file_stem)
    known = files.select(F.col("path").alias("dst"), target.alias("stem"), folder.alias("dst_folder"))
    near = (F.regexp_replace("src", "[^/]*$", "") != F.col("dst_folder")).cast("int")
    rows = wanted.join(known, "stem").where("src <> dst").withColumn("key", F.struct(near, F.length("dst"), F.col("dst")))
    return rows.groupBy("src", "stem").agg(F.min_by("dst", "key").alias("dst")).select("src", "dst").distinct()


def _top_level(arguments: str) -> list[str]:
    depth, quote, parts, now = 0, "", [], []
    for c in arguments:
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'`":
            quote = c
        elif c in "([{<":
            depth += 1
        elif c in ")]}>":
            depth -= 1
        elif c == "," and depth == 0:
            parts.append("".join(now))
            now = []
            continue
        now.append(c)
    return [p.strip() for p in [*parts, "".join(now)] if p.strip()]


def call_arity(line: str, symbol: str) -> int | None:
    """Arguments of the first call of a symbol in a text; None if there is no call."""
    return next((n for _, n in calls(line, symbol)), None)


def calls(body: str, symbol: str) -> Iterator[tuple[int, int]]:
    """(where a call of a symbol begins, its number of arguments), for every call, over lines."""
    for m in re.finditer(rf"(?<![\w.]){re.escape(symbol)}\s*\(|(?<=\.){re.escape(symbol)}\s*\(", body):
        depth, quote, end = 1, "", len(body)
        for k in range(m.end(), len(body)):
            c = body[k]
            if quote:
                quote = "" if c == quote and body[k - 1] != "\\" else quote
            elif c in "\"'`":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
                if depth == 0:
                    end = k
                    break
        yield m.start(), len(_top_level(body[m.end() : end]))


def signature(line: str) -> dict | None:
    """Name, required and total parameters (self and this left out) and asynchrony of a declaration line."""
    m = re.search(r"(async\s+)?(?:def|fn|function|func)\s+(\w+)\s*(?:<[^>]*>)?\s*\((.*)\)", line)
    if not m:
        return None
    params = [p for p in _top_level(m[3]) if not re.match(r"(&?(mut\s+)?self|this)\b", p) and not p.startswith("*") and p not in ("/",)]
    optional = [p for p in params if "=" in p or re.match(r"\w+\?\s*:", p) or p.startswith("...")]
    return {"name": m[2], "required": len(params) - len(optional), "total": len(params), "is_async": bool(m[1])}


def patch_breakages(files: DataFrame, declaration: str) -> DataFrame:
    """(path, line_no, breakage): calls that a changed declaration breaks: too few or too many
    arguments, or no await for an asynchronous one."""
    new = signature(declaration)
    if not new:
        return files.sparkSession.createDataFrame([], "path string, line_no int, breakage string")
    declared = re.compile(r"\b(?:def|fn|function|func)\s+$")

    def rows(path: str, body: str) -> list[tuple]:
        out = []
        for at, n in calls(body, new["name"]):
            before = body[body.rfind("\n", 0, at) + 1 : at]
            if declared.search(before):
                continue
            k = body.count("\n", 0, at) + 1
            if n < new["required"]:
                out.append((path, k, "too_few_arguments"))
            elif n > new["total"]:
                out.append((path, k, "too_many_arguments"))
            elif new["is_async"] and not re.search(r"\bawait\s+[\w.]*$", before):
                out.append((path, k, "missing_await"))
        return out

    return _per_file(files, rows, "path string, line_no int, breakage string")


def contracts(files: DataFrame) -> DataFrame:
    """(key, path, name, kind, signature, start_line, end_line, doc): the declaration line of each
    symbol; key is the XXH64 (seed 0) of path and name."""
    import xxhash

    def rows(path: str, body: str) -> list[tuple]:
        lines = body.splitlines()
        out = []
        for name, kind, a, b in symbols_of(path, body)[1]:
            doc = next((x.strip().strip("\"'/#* ") for x in lines[a : a + 2] if x.strip().startswith(('"""', "'''", "///", "#"))), "")
            out.append((f"{xxhash.xxh64_hexdigest(f'{path}::{name}'.encode(), 0)}", path, name, kind, lines[a - 1].strip().rstrip("{:").rstrip(), a, b, doc))
        return out

    return _per_file(files, rows, "key string, path string, name string, kind string, signature string, start_line int, end_line int, doc string")


def skeletons(files: DataFrame) -> DataFrame:
    """(path, skeleton, tokens, skeleton_tokens): declaration lines with their indents, bodies left out."""
    def rows(path: str, body: str) -> list[tuple]:
        lines = body.splitlines()
        kept = [lines[s[2] - 1].rstrip() for s in symbols_of(path, body)[1]]
        skeleton = "\n".join(kept)
        return [(path, skeleton, len(body) // 4, len(skeleton) // 4)]

    return _per_file(files, rows, "path string, skeleton string, tokens long, skeleton_tokens long")


def diagnostics(files: DataFrame, most: int = 10) -> DataFrame:
    """(path, line_no, severity, message): syntax errors of Python, unbalanced brackets elsewhere,
    and queries inside loops; a report of at most ``most`` a file."""
    query = re.compile(r"\b(execute|query|fetch|find_one|requests?\.(get|post))\s*\(")

    def rows(path: str, body: str) -> list[tuple]:
        out, lines = [], body.splitlines()
        if language_of(path) == "python":
            try:
                ast.parse(body)
            except (SyntaxError, ValueError) as e:
                out.append((path, getattr(e, "lineno", None) or 1, "error", str(getattr(e, "msg", e))))
        elif body.count("{") != body.count("}"):
            out.append((path, len(lines), "error", "unbalanced braces"))
        for k, line in enumerate(lines):
            if re.match(r"\s*(for|while)\b", line):
                end = _block_end(lines, k)
                out += [(path, j + 1, "warning", "query inside a loop") for j in range(k + 1, end) if query.search(lines[j])]
        return list(dict.fromkeys(out))[:most]

    return _per_file(files, rows, "path string, line_no int, severity string, message string")


def symbol_sources(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path, wanted, name, start_line, end_line, source): the text of a symbol for each (path,
    wanted): of that name, else of that name but for case, else whose dotted end it is
    ("Class.method" finds method); of several the first. Symbols that aren't found have no row."""
    asked = wanted.groupBy("path").agg(F.collect_set("wanted").alias("wanted"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, body, names in zip(pdf["path"], pdf["text"], pdf["wanted"]):
                body = body or ""
                found, lines = symbols_of(path, body)[1], body.splitlines()
                for want in sorted(names):
                    last = want.rsplit(".", 1)[-1]
                    hit = next((s for key in (lambda n: n == want, lambda n: n.lower() == want.lower(), lambda n: n == last) for s in found if key(s[0])), None)
                    if hit:
                        out.append((path, want, hit[0], hit[2], hit[3], "\n".join(lines[hit[2] - 1 : hit[3]])))
            yield pd.DataFrame(out, columns=["path", "wanted", "name", "start_line", "end_line", "source"])

    schema = "path string, wanted string, name string, start_line int, end_line int, source string"
    return files.select("path", "text").join(asked, "path").mapInPandas(run, schema)


def replaced_symbols(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text, replaced): the texts of ``files`` after edits (path, wanted, code) that put new
    code in a symbol's lines; nothing is written to disk. Edits whose symbol isn't found are left
    out of ``replaced``; a file's edits are applied from its end, so that lines stay in place."""
    asked = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("wanted", "code"))).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, body, todo in zip(pdf["path"], pdf["text"], pdf["edits"]):
                lines, done = (body or "").splitlines(), 0
                found = symbols_of(path, body or "")[1]
                places = []
                for e in todo if todo is not None else ():
                    last = e["wanted"].rsplit(".", 1)[-1]
                    hit = next((s for key in (lambda n: n == e["wanted"], lambda n: n.lower() == e["wanted"].lower(), lambda n: n == last) for s in found if key(s[0])), None)
                    if hit:
                        places.append((hit[2], hit[3], e["code"]))
                for a, b, code in sorted(places, reverse=True):
                    lines[a - 1 : b] = code.splitlines()
                    done += 1
                out.append((path, "\n".join(lines) if done else body, done))
            yield pd.DataFrame(out, columns=["path", "text", "replaced"])

    return files.select("path", "text").join(asked, "path", "left").mapInPandas(run, "path string, text string, replaced int")


def directory_tree(files: DataFrame) -> DataFrame:
    """(folder, depth, files, below): each folder above a file, with the files right in it and below it."""
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("folder"), n.alias("depth"), (n == F.size(parts) - 1).cast("int").alias("own")))
    rows = files.where(F.size(parts) > 0).select(F.explode(folders).alias("f")).select("f.*")
    return rows.groupBy("folder", "depth").agg(F.sum("own").alias("files"), F.count("*").alias("below"))


def test_counts(outputs: DataFrame, column: str = "output") -> DataFrame:
    """Passed, failed and ignored tests in runner output (id, output); missing numbers are 0."""
    def number(pattern: str) -> Column:
        found = F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))
        return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int"))

    return outputs.select("id", number(r"(\d+) passed").alias("passed"), number(r"(\d+) (?:failed|error)").alias("failed"), number(r"(\d+) (?:ignored|skipped)").alias("ignored"))


def learnings(docs: DataFrame, column: str = "text") -> DataFrame:
    """(id, place, learning): bullets under a heading 'Key Learnings', until the next heading."""
    section = F.regexp_extract(F.col(column), r"(?ims)^#+\s*key learnings:?\s*\n(.*?)(?=^#|\z)", 1)
    rows = docs.select("id", F.posexplode(F.regexp_extract_all(section, F.lit(r"(?m)^\s*(?:[-*]|\d+[.)])\s+(.+)$"), F.lit(1))).alias("place", "learning"))
    return rows.select("id", (F.col("place") + 1).alias("place"), F.trim("learning").alias("learning")).where("learning <> ''")
