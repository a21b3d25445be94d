"""Sources and sinks: source trees, histories, Markdown memories, JSON bundles."""

from __future__ import annotations

import hashlib
import subprocess
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources import git

#: Names and endings that are never indexed.
LOCK_FILES = ("package-lock.json", "pnpm-lock.yaml", "yarn.lock", "cargo.lock", "poetry.lock", "composer.lock", "gemfile.lock")
BUNDLED = (".min.js", ".min.css", ".bundle.js", ".chunk.js", ".map")
DATA_ENDINGS = (".log", ".sqlite", ".sqlite3", ".db", ".csv", ".tsv", ".parquet", ".dump", ".bin", ".exe", ".dll", ".so", ".dylib", ".wasm")
NOISE_FOLDERS = (
    "target", "node_modules", ".git", ".svn", "__pycache__", "build", "dist", ".next", ".cache", "vendor", "bower_components", ".idea", ".vscode",
    ".venv", "venv", "env", ".tox", "scratch", ".supabase", ".gemini", ".turbo", "coverage", ".output", ".fastembed_cache", "cache", ".onnx",
)
MOST_BYTES = 5 * 1024 * 1024


def noise_decision(path: Column, length: Column, most: int = MOST_BYTES) -> Column:
    """Why a file isn't indexed, by the first rule that holds; 'Process' if it is."""
    low = F.lower(path)
    name = F.element_at(F.split(low, "/"), -1)

    def ends(endings: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for e in endings:
            out = out | name.endswith(e)
        return out

    folder = F.exists(F.split(low, "/"), lambda p: p.isin(*NOISE_FOLDERS))
    return F.when(folder, "NoiseDir").when(name.isin(*LOCK_FILES), "LockFile").when(ends(BUNDLED), "MinifiedOrBundle").when(ends(DATA_ENDINGS), "LargeOrBinaryData").when(length > most, "ExceedsSizeLimit").otherwise("Process")


#: Folder names that are ignored only outside a source root.
OUTSIDE_SOURCES = ("data", "temp")


def ignored(path: Column, patterns: list[str], outside: tuple[str, ...] = ()) -> Column:
    """Whether a path is under an ignore pattern: equal, below it, one of its folders or names, or
    by ending ('*.x'). Folders named in ``outside`` are ignored unless a 'src' folder is above them."""
    out = F.lit(False)
    for p in (p.strip().strip("/") for p in patterns):
        if not p or p.startswith("#"):
            continue
        if p.startswith("*."):
            out = out | path.endswith(p[1:])
        else:
            out = out | (path == p) | path.startswith(p + "/") | F.array_contains(F.split(path, "/"), p)
    for name in outside:
        at = F.array_position(F.split(path, "/"), name)
        source = F.array_position(F.split(path, "/"), "src")
        out = out | ((at > 0) & (at < F.size(F.split(path, "/"))) & ((source == 0) | (source > at)))
    return out


def scan(spark: SparkSession, root: str, patterns: list[str] = ()) -> DataFrame:
    """(path, length, modified, sha256, text) of a tree's files that are no noise.

    File sizes and names are filtered before any content is read into a row of its own."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = "^.*?" + "".join(c if c.isalnum() or c in "/_-" else "." for c in root.rstrip("/")) + "/"
    rows = raw.withColumn("rel", F.regexp_replace("path", base, ""))
    rows = rows.where((noise_decision(F.col("rel"), F.col("length")) == "Process") & ~ignored(F.col("rel"), list(patterns)))
    body = F.decode("content", "UTF-8")
    return rows.select(F.col("rel").alias("path"), "length", F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), body.alias("text"))


def file_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): Indexed, Unchanged or Deleted, by sha256."""
    joined = before.select("path", F.col("sha256").alias("old")).join(after.select("path", F.col("sha256").alias("new")), "path", "full_outer")
    state = F.when(F.col("new").isNull(), "Deleted").when(F.col("old") == F.col("new"), "Unchanged").otherwise("Indexed")
    return joined.select("path", state.alias("state"))


def stale_files(index: DataFrame, listed: DataFrame) -> DataFrame:
    """(path, state) of files whose index is out of date: Changed (another mtime), Added, Deleted.

    Both tables have path and modified: listing needs no content, so this is the cheap check
    that says whether a scan is due."""
    both = index.select("path", F.col("modified").alias("old")).join(listed.select("path", F.col("modified").alias("new")), "path", "full_outer")
    state = F.when(F.col("new").isNull(), "Deleted").when(F.col("old").isNull(), "Added").when(F.col("old") != F.col("new"), "Changed")
    return both.select("path", state.alias("state")).where("state is not null")


def refreshed(index: DataFrame, scanned: DataFrame, derived: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame], tuple[str, ...]]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The file index (path, sha256, ...) and the tables derived from it after a scan.

    ``derived`` maps a name to (rows, function that makes rows of changed files, path columns).
    Rows of deleted and changed files go, on either end; rows are made anew for added and
    changed files alone. An unchanged file costs a comparison of digests."""
    delta = file_delta(index, scanned)
    changed = delta.where("state = 'Indexed'").select("path")
    gone = delta.where("state <> 'Unchanged'").select("path")
    fresh = scanned.join(changed, "path", "left_semi")
    files = without_files(index, gone).unionByName(fresh.select(*index.columns))
    return files, {n: without_files(rows, gone, *columns).unionByName(make(fresh)) for n, (rows, make, columns) in derived.items()}


def without_files(rows: DataFrame, removed: DataFrame, *columns: str) -> DataFrame:
    """Rows of an index without removed paths, in any of the columns (both ends of edges)."""
    for c in columns or ("path",):
        rows = rows.join(removed.select(F.col("path").alias(c)), c, "left_anti")
    return rows


def git_history(spark: SparkSession, repository: str, most: int | None = None, revision: str = "HEAD") -> DataFrame:
    """History rows (commit, author, ts, subject, is_fix, file, insertions, deletions) of all
    commits below a revision, or of the newest ``most``; read by tasks (``sources.git``)."""
    git.register(spark)
    log = spark.read.format("git_log").option("path", repository).option("revision", revision)
    rows = (log.option("most", most) if most is not None else log).load()
    return rows.select("commit", "author", F.timestamp_seconds("at").alias("ts"), "subject", T.is_fix(F.col("subject")).alias("is_fix"), "file", "insertions", "deletions")


def parse_history(entries: DataFrame) -> DataFrame:
    """Log entries (one text per commit: header line, then numstat lines) as history rows."""
    head = F.split(F.split("entry", "\n")[0], "\x1f")
    rows = entries.select(head[0].alias("commit"), head[1].alias("author"), F.timestamp_seconds(head[2].try_cast("bigint")).alias("ts"), head[3].alias("subject"), F.explode(F.split("entry", "\n")).alias("line"))
    stat = F.split("line", "\t")
    rows = rows.where(F.col("line").rlike(r"^\d+\t\d+\t"))
    return rows.select("commit", "author", "ts", "subject", T.is_fix(F.col("subject")).alias("is_fix"), stat[2].alias("file"), stat[0].cast("long").alias("insertions"), stat[1].cast("long").alias("deletions"))


def _git(repository: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", repository, *arguments], capture_output=True, text=True, check=True).stdout


def git_diff(spark: SparkSession, repository: str, before: str, after: str = "HEAD") -> DataFrame:
    """(file, insertions, deletions) between two commits; binary files have nulls."""
    lines = [tuple(x.split("\t", 2)) for x in _git(repository, "diff", "--numstat", "--no-renames", before, after).splitlines()]
    rows = spark.createDataFrame(lines, "a string, d string, file string")
    return rows.select("file", F.col("a").try_cast("long").alias("insertions"), F.col("d").try_cast("long").alias("deletions"))


def git_blame(spark: SparkSession, repository: str, path: str, first: int = 1, last: int | None = None) -> DataFrame:
    """(line_no, commit, author, ts, line) of a file's lines from ``first`` to ``last``."""
    out, head = [], {}
    for x in _git(repository, "blame", "--line-porcelain", "-L", f"{first},{last or ''}", "--", path).splitlines():
        if x.startswith("\t"):
            out.append((int(head["number"]), head["commit"], head.get("author"), int(head.get("author-time", 0)), x[1:]))
        elif len(words := x.split(" ")) >= 3 and len(words[0]) == 40 and words[2].isdigit():
            head = {"commit": words[0], "number": words[2]}
        else:
            key, _, value = x.partition(" ")
            head[key] = value
    rows = spark.createDataFrame(out, "line_no int, commit string, author string, at long, line string")
    return rows.select("line_no", "commit", "author", F.timestamp_seconds("at").alias("ts"), "line")


def git_status(spark: SparkSession, repository: str) -> DataFrame:
    """(state, file) of changes that aren't committed."""
    rows = [(x[:2].strip(), x[3:]) for x in _git(repository, "status", "--porcelain").splitlines()]
    return spark.createDataFrame(rows, "state string, file string")


#: What a file at a folder's top says of it.
MARKERS = {"Cargo.toml": "rust", "package.json": "javascript", "pyproject.toml": "python", "setup.py": "python", "go.mod": "go", "pom.xml": "java", "Dockerfile": "service"}


def repository_roles(files: DataFrame) -> DataFrame:
    """(folder, roles): folders that hold a marker file, and what the markers say."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
    role = F.create_map(*[F.lit(x) for pair in MARKERS.items() for x in pair])[name]
    marked = files.select(folder.alias("folder"), role.alias("role")).where("role is not null")
    return marked.groupBy("folder").agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def markdown_memories(spark: SparkSession, root: str) -> DataFrame:
    """Memories from Markdown files with front matter."""
    return parse_memories(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("value").alias("text")))


def parse_memories(texts: DataFrame) -> DataFrame:
    """(id, kind, status, severity, title, applies_to, tags, body): front matter of 'key: value'
    lines, lists inline or as bullets; files without front matter give no row."""
    front = F.regexp_extract("text", r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?", 1)
    body = T.strip(F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", ""))

    def value(key: str) -> Column:
        return F.regexp_extract(front, rf"(?m)^{key}:[ \t]*[\"']?([^\n\"']*?)[\"']?[ \t]*$", 1)

    def listed(key: str) -> Column:
        inline = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\[([^\]]*)\]", 1)
        bullets = F.regexp_extract(front, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-[ \t]+[^\n]*\n?)+)", 1)
        items = F.when(inline != "", F.split(inline, ",")).otherwise(F.regexp_extract_all(bullets, F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), F.lit(1)))
        return F.filter(F.transform(items, lambda x: F.regexp_replace(F.trim(x), r"^[\"']|[\"']$", "")), lambda x: x != "")

    return texts.where(front != "").select(
        value("id").alias("id"), value("kind").alias("kind"), F.when(value("status") == "", "active").otherwise(value("status")).alias("status"),
        value("severity").alias("severity"), value("title").alias("title"), listed("applies_to").alias("applies_to"), listed("tags").alias("tags"), body.alias("body"),
    )


def memory_markdown(rows: DataFrame) -> DataFrame:
    """(id, markdown): memories as files with front matter, the inverse of ``parse_memories``."""
    def items(c: str) -> Column:
        return F.concat(F.lit(f"{c}: ["), F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), ", "), F.lit("]"))

    head = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c), F.lit(""))) for c in ("id", "kind", "status", "severity", "title")]
    return rows.select("id", F.concat_ws("\n", F.lit("---"), *head, items("applies_to"), items("tags"), F.lit("---"), F.coalesce("body", F.lit(""))).alias("markdown"))


def write_bundle(rows: DataFrame, path: str) -> str:
    """JSON lines and their digest: sha256 over the sorted digests of rows, free of file order."""
    packed = rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))
    packed.write.text(path)
    return bundle_digest(rows.sparkSession.read.text(path))


#: Rows that a group of the digest's tree holds, about.
DIGEST_ROWS = 4_000


def bundle_digest(lines: DataFrame) -> str:
    """The digest that ``write_bundle`` returned, computed from the written lines.

    A tree over hex prefixes, as deep as the number of rows asks for: rows' sha256 are sorted
    and hashed in groups of equal prefix, and groups by shorter prefixes, three digits at a
    time, so that no group grows with the bundle."""
    each = lines.select(F.sha2("value", 256).alias("h"))
    n, depth = lines.count(), 0
    while n > DIGEST_ROWS * 16**depth:
        depth += 1
    rows = each.select(F.substring("h", 1, depth).alias("b"), "h")
    while True:
        rows = rows.groupBy("b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
        if depth <= 3:
            break
        depth -= 3
        rows = rows.select(F.substring("b", 1, depth).alias("b"), F.concat("b", "h").alias("h"))
    return hashlib.sha256("".join(r["b"] + r["h"] for r in rows.orderBy("b").collect()).encode()).hexdigest()  # 4,096 rows at most


def read_bundle(spark: SparkSession, path: str, schema: str, digest: str) -> DataFrame:
    """Rows of a bundle; a wrong digest raises."""
    lines = spark.read.text(path)
    if bundle_digest(lines) != digest:
        raise ValueError("the bundle doesn't match its digest")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def merge_bundle(base: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Base and the incoming rows that equal none of it on the key columns (nulls equal nulls)."""
    on = None
    for k in keys:
        same = base[k].eqNullSafe(incoming[k])
        on = same if on is None else on & same
    return base.unionByName(incoming.join(base, on, "left_anti").dropDuplicates(keys), allowMissingColumns=True)
