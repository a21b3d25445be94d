"""Queries over source files, their parsers, and the incremental index."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import graph as G
from quern.operators import lexical as L
from quern.operators import parsers as P
from quern.plans.registry import query
from quern.plans.roles import SOURCES, sources
from quern.session import load
from quern.sources import readers as R
from quern.storage import new_folder

W = f"WITH {SOURCES}"
TABLES = """refs AS (
  SELECT path, 't' || (k % 50) AS "table", 'CREATE' AS operation, 2 AS line_no FROM sources WHERE k % 4 = 2
  UNION ALL SELECT path, 't' || (k % 7), 'REFERENCES', 2 FROM sources WHERE k % 4 = 2
  UNION ALL SELECT path, 'old_' || (k % 50), 'DROP', 4 FROM sources WHERE k % 4 = 2
  UNION ALL SELECT path, 't' || (k % 50), 'ALTER', 5 FROM sources WHERE k % 4 = 2
  UNION ALL SELECT path, 't' || (k % 50), 'MODEL', 10 FROM sources WHERE k % 4 = 0)"""


@query(f"{W}, {TABLES} SELECT * FROM refs")
def table_references(spark, d):
    return P.table_references(sources(spark, d))


@query(f"""{W}, {TABLES} SELECT * FROM refs WHERE "table" = 't4'""")
def table_lineage(spark, d):
    return P.lineage(P.table_references(sources(spark, d)), "t4")


@query(f"""{W} SELECT path, 2 AS line_no, 'NON_IDEMPOTENT' AS severity, 'CREATE TABLE s.t' || (k % 50) || ' (id int, o int REFERENCES t' || (k % 7) || '(id))' AS preview FROM sources WHERE k % 4 = 2 AND k % 3 <> 0
UNION ALL SELECT path, 4, 'DESTRUCTIVE_UNGUARDED', 'DROP TABLE IF EXISTS old_' || (k % 50) FROM sources WHERE k % 4 = 2 AND k % 5 <> 0""")
def migration_findings(spark, d):
    return P.migration_findings(sources(spark, d).where("k % 4 = 2"))


ROUTES = """routes AS (SELECT path, 'GET' AS method, '/api/m' || (k % 7) || '/items/{id}' AS route, '/api/m' || (k % 7) || '/items/:id' AS canonical, 'load' || k AS handler, 5 AS line_no FROM sources WHERE k % 4 = 0)"""
CONSUMERS = """consumers AS (SELECT path, 'POST' AS method, '/api/m' || ((k - 1) % 7) || '/items/{id}' AS raw, '/api/m' || ((k - 1) % 7) || '/items/:id' AS canonical, 'Page' || k AS symbol, 3 AS line_no FROM sources WHERE k % 4 = 1
  UNION ALL SELECT path, 'GET', '/api/m' || (k % 7) || '/list?page=2', '/api/m' || (k % 7) || '/list', 'Page' || k, 6 FROM sources WHERE k % 4 = 1)"""


@query(f"{W}, {ROUTES} SELECT * FROM routes")
def api_routes(spark, d):
    return P.api_routes(sources(spark, d))


@query(f"{W}, {CONSUMERS} SELECT * FROM consumers")
def endpoint_consumers(spark, d):
    return P.endpoint_consumers(sources(spark, d))


@query(f"{W}, {ROUTES}, {CONSUMERS} SELECT DISTINCT c.path AS src, r.path AS dst FROM consumers c JOIN routes r USING (canonical)")
def contract_edges(spark, d):
    files = sources(spark, d)
    routes = P.api_routes(files).select(F.col("canonical").alias("path"), F.col("path").alias("file"))
    return G.cross_edges(routes, P.endpoint_consumers(files).select(F.col("canonical").alias("path"), F.col("path").alias("file")))


@query(f"""{W}, {ROUTES}, {CONSUMERS} SELECT c.path || ':' || c.line_no AS id, canonical AS path, c.method, CASE WHEN canonical IN (SELECT canonical FROM routes) THEN 'METHOD_MISMATCH' ELSE 'ORPHAN' END AS drift FROM consumers c""")
def traced_contract_drift(spark, d):
    files = sources(spark, d)
    routes = P.api_routes(files).select(F.col("canonical").alias("path"), "method", F.lit(False).alias("tagged"))
    calls = P.endpoint_consumers(files).select(F.concat_ws(":", "path", "line_no").alias("id"), F.col("canonical").alias("path"), "method", F.lit(False).alias("tagged"))
    return G.contract_drift(routes, calls)


SYMBOLS = """symbols AS (
  SELECT k, path, 'python' AS language, 'syntax_tree' AS strategy, 'load' || k AS name, 'function' AS kind, 6 AS start_line, 7 AS end_line FROM sources WHERE k % 4 = 0
  UNION ALL SELECT k, path, 'python', 'syntax_tree', 'Model' || k, 'class', 9, 10 FROM sources WHERE k % 4 = 0
  UNION ALL SELECT k, path, 'typescriptreact', 'heuristic', 'Page' || k, 'function', 2, CASE WHEN k % 3 = 2 THEN 9 ELSE 8 END FROM sources WHERE k % 4 = 1)"""


@query(f"{W}, {SYMBOLS} SELECT path, language, strategy, name, kind, start_line, end_line FROM symbols")
def file_symbols(spark, d):
    return P.symbols(sources(spark, d))


@query(f"""{W}, {SYMBOLS} SELECT path, strategy, count(*) AS symbols FROM symbols GROUP BY path, strategy""")
def parse_strategies(spark, d):
    return P.symbols(sources(spark, d)).groupBy("path", "strategy").agg(F.count("*").alias("symbols"))


@query(f"""{W} SELECT path, 'os' AS hint FROM sources WHERE k % 4 = 0 UNION ALL SELECT path, 'm' || (k % 7) || '.part' || (k + 4) FROM sources WHERE k % 4 = 0
UNION ALL SELECT path, './part' || (k + 4) FROM sources WHERE k % 4 = 1""")
def dependency_hints(spark, d):
    return P.dependency_hints(sources(spark, d).where("k % 4 < 2"))


@query(f"{W} SELECT a.path AS src, b.path AS dst FROM sources a JOIN sources b ON b.k = a.k + 4 WHERE a.k % 4 < 2")
def resolved_dependencies(spark, d):
    files = sources(spark, d)
    return P.resolved_dependencies(P.dependency_hints(files), files)


@query(f"""{W} SELECT path, 7 AS line_no, CASE WHEN k % 3 = 0 THEN 'too_few_arguments' WHEN k % 3 = 2 THEN 'too_many_arguments' ELSE 'missing_await' END AS breakage FROM sources WHERE k % 4 = 1 AND NOT (k % 3 = 1 AND k % 2 = 1)
UNION ALL SELECT path, CASE WHEN k % 3 = 2 THEN 8 ELSE 7 END, 'too_few_arguments' FROM sources WHERE k % 4 = 1""")
def signature_breakages(spark, d):
    return P.patch_breakages(sources(spark, d), "async def loadAll(first, second):")


@query(f"""{W}, {SYMBOLS} SELECT path, coalesce(string_agg(CASE WHEN kind = 'class' THEN 'class ' || name || ':' WHEN language = 'python' THEN 'async def ' || name || '(a, b=1):' ELSE 'export function ' || name || '() {{' END, chr(10) ORDER BY start_line), '') AS skeleton,
length(any_value(text)) // 4 AS tokens, coalesce(sum(CASE WHEN kind = 'class' THEN 7 + length(name) WHEN language = 'python' THEN 20 + length(name) WHEN name IS NULL THEN 0 ELSE 20 + length(name) END) + greatest(count(name) - 1, 0), 0) // 4 AS skeleton_tokens
FROM sources LEFT JOIN symbols USING (k, path) GROUP BY path""")
def file_skeletons(spark, d):
    return P.skeletons(sources(spark, d))


@query(f"""{W} SELECT path, 'Model' || k AS name, 'class' AS kind, 'class Model' || k AS signature, 9 AS start_line FROM sources WHERE k % 4 = 0
UNION ALL SELECT path, 'load' || k, 'function', 'async def load' || k || '(a, b=1)', 6 FROM sources WHERE k % 4 = 0 UNION ALL SELECT path, 'Page' || k, 'function', 'export function Page' || k || '()', 2 FROM sources WHERE k % 4 = 1""")
def symbol_contracts(spark, d):
    return P.contracts(sources(spark, d)).select("path", "name", "kind", "signature", "start_line")


@query(f"""{W} SELECT path, 'app.LOAD' || k AS wanted, 6 AS start_line, 'async def load' || k || '(a, b=1):' || chr(10) || '    return query' || (k % 3) || '(a)' AS source FROM sources WHERE false
UNION ALL SELECT path, 'model' || k, 9, 'class Model' || k || ':' || chr(10) || '    __tablename__ = "t' || (k % 50) || '"' FROM sources WHERE k % 4 = 0
UNION ALL SELECT path, 'svc.load' || k, 6, 'async def load' || k || '(a, b=1):' || chr(10) || '    return query' || (k % 3) || '(a)' FROM sources WHERE k % 4 = 0""")
def extracted_symbols(spark, d):
    files = sources(spark, d)
    names = F.array(F.concat(F.lit("model"), "k"), F.concat(F.lit("svc.load"), "k"), F.lit("nothing"))
    return P.symbol_sources(files, files.where("k % 4 = 0").select("path", F.explode(names).alias("wanted"))).select("path", "wanted", "start_line", "source")


@query(f"""{W} SELECT path, CASE WHEN k % 4 = 0 THEN replace(text, 'class Model' || k || ':' || chr(10) || '    __tablename__ = "t' || (k % 50) || '"', 'class Gone:' || chr(10) || '    pass') ELSE text END AS text, CASE WHEN k % 4 = 0 THEN 1 ELSE 0 END AS replaced FROM sources""")
def replaced_symbols(spark, d):
    files = sources(spark, d)
    edits = files.select("path", F.concat(F.lit("Model"), "k").alias("wanted"), F.lit("class Gone:\\n    pass").alias("code"))
    return P.replaced_symbols(files, edits.withColumn("code", F.replace("code", F.lit("\\n"), F.lit("\n"))))


@query(f"""{W}, f AS (SELECT regexp_replace(path, '/[^/]*$', '') AS folder FROM sources), u AS (SELECT folder, 1 AS own FROM f UNION ALL SELECT '', 0 FROM f UNION ALL SELECT split_part(folder, '/', 1), 0 FROM f WHERE contains(folder, '/'))
SELECT folder, CASE WHEN folder = '' THEN 0 ELSE len(string_split(folder, '/')) END AS depth, CAST(sum(own) AS BIGINT) AS files, count(*) AS below FROM u GROUP BY folder""")
def directory_tree(spark, d):
    return P.directory_tree(sources(spark, d))


@query(f"{W} SELECT path, max(line_no) AS lines FROM (SELECT path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM sources) GROUP BY path")
def file_lines(spark, d):
    return P.file_lines(sources(spark, d)).groupBy("path").agg(F.max("line_no").cast("long").alias("lines"))


@query(f"{W} SELECT path AS id, CAST(k % 9 AS INT) AS passed, CAST(k % 3 AS INT) AS failed, CAST(k % 2 AS INT) AS ignored FROM sources WHERE k % 4 = 3")
def test_outcomes(spark, d):
    return P.test_counts(sources(spark, d).where("k % 4 = 3").select(F.col("path").alias("id"), F.col("text").alias("output")))


@query(f"{W} SELECT path AS id, 1 AS place, 'learned ' || k AS learning FROM sources WHERE k % 4 = 3 UNION ALL SELECT path, 2, 'also ' || (k % 7) FROM sources WHERE k % 4 = 3")
def key_learnings(spark, d):
    return P.learnings(sources(spark, d).where("k % 4 = 3").withColumnRenamed("path", "id"))


@query(f"{W} SELECT path FROM sources WHERE contains(path, 'part1') ORDER BY path LIMIT 30")
def completed_paths(spark, d):
    return L.complete_path(sources(spark, d), "part1", 30)


PATHS = """paths AS (SELECT k, CASE k % 9 WHEN 0 THEN 'src/a' || k || '.py' WHEN 1 THEN 'web/node_modules/x' || k || '.js' WHEN 2 THEN 'p' || k || '/yarn.lock' WHEN 3 THEN 'web/app' || k || '.min.js' WHEN 4 THEN 'x/d' || k || '.csv'
  WHEN 5 THEN 'src/big' || k || '.py' WHEN 6 THEN 'data/n' || k || '.py' WHEN 7 THEN 'app/src/data/n' || k || '.py' ELSE 'skip/me/n' || k || '.py' END AS path, CASE WHEN k % 9 = 5 THEN 6000000 ELSE 100 END AS length FROM k)"""


@query(f"""{W}, {PATHS} SELECT path, CASE k % 9 WHEN 1 THEN 'NoiseDir' WHEN 2 THEN 'LockFile' WHEN 3 THEN 'MinifiedOrBundle' WHEN 4 THEN 'LargeOrBinaryData' WHEN 5 THEN 'ExceedsSizeLimit' ELSE 'Process' END AS decision, k % 9 IN (6, 8) AS ignored FROM paths""")
def scan_decisions(spark, d):
    paths = load(spark, d, "part").select(F.col("p_partkey").alias("k"))
    case, length = PATHS[PATHS.index("CASE"):].split(" AS path, ")
    rows = paths.select(F.expr(case).alias("path"), F.expr(length.split(" AS length")[0]).alias("length"))
    return rows.select("path", R.noise_decision(F.col("path"), F.col("length")).alias("decision"), R.ignored(F.col("path"), ["# no", "skip/me"], R.OUTSIDE_SOURCES).alias("ignored"))


def _changed(files):
    """The next scan: some files changed, some gone."""
    return files.where("k % 13 <> 0").withColumn("text", F.when(F.col("k") % 10 == 0, F.concat(F.col("text"), F.lit("\n"), F.lit("def extra(): pass"))).otherwise(F.col("text")))


def _digested(files):
    return files.withColumn("sha256", F.sha2("text", 256))


@query(f"{W} SELECT path, CASE WHEN k % 13 = 0 THEN 'Deleted' WHEN k % 10 = 0 THEN 'Indexed' ELSE 'Unchanged' END AS state FROM sources")
def file_states(spark, d):
    files = sources(spark, d)
    return R.file_delta(_digested(files), _digested(_changed(files)))


@query(f"{W} SELECT path, CASE WHEN k % 13 = 0 THEN 'Deleted' ELSE 'Changed' END AS state FROM sources WHERE k % 13 = 0 OR k % 10 = 0")
def stale_index(spark, d):
    files = sources(spark, d)
    listed = _changed(files).select("path", F.when(F.col("k") % 10 == 0, 2).otherwise(1).alias("modified"))
    return R.stale_files(files.select("path", F.lit(1).alias("modified")), listed)


@query(f"""{W}, {SYMBOLS} SELECT path, name FROM symbols WHERE k % 13 <> 0 UNION ALL SELECT path, 'extra' FROM sources WHERE k % 4 = 0 AND k % 10 = 0 AND k % 13 <> 0""")
def refreshed_symbols(spark, d):
    files = sources(spark, d)
    made = lambda f: P.symbols(f).select("path", "name")
    old = made(files.where("k % 4 < 2"))
    scanned = _digested(_changed(files.where("k % 4 < 2")))
    _, derived = R.refreshed(_digested(files.where("k % 4 < 2")), scanned, {"symbols": (old, made, ("path",))})
    return derived["symbols"]


@query("""SELECT n_name AS name, n_regionkey AS region FROM nation WHERE n_regionkey <> 2 UNION SELECT n_name, n_regionkey FROM nation WHERE n_nationkey % 2 = 0""")
def merged_bundle(spark, d):
    n = load(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"), "n_nationkey")
    path = new_folder(spark, "bundle")
    digest = R.write_bundle(n.where("n_nationkey % 2 = 0").drop("n_nationkey"), path)
    return R.merge_bundle(n.where("region <> 2").drop("n_nationkey"), R.read_bundle(spark, path, "name string, region long", digest), ["name", "region"])


@query("""SELECT o_orderkey || '' AS commit, 'c' || o_custkey AS author, CASE WHEN o_orderkey % 3 = 0 THEN 'Fix: part' ELSE 'add part' END AS subject, o_orderkey % 3 = 0 AS is_fix, 'src/p' || l_partkey || '.py' AS file, CAST(l_quantity AS BIGINT) AS insertions, CAST(l_linenumber AS BIGINT) AS deletions
FROM orders JOIN lineitem ON l_orderkey = o_orderkey""")
def parsed_history(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", F.concat_ws("\t", F.col("l_quantity").cast("long").cast("string"), F.col("l_linenumber").cast("string"), F.concat(F.lit("src/p"), "l_partkey", F.lit(".py"))).alias("stat"))
    stats = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_list("stat"), "\n").alias("stats"))
    o = load(spark, d, "orders").join(stats, F.col("o_orderkey") == F.col("l_orderkey"))
    subject = F.when(F.col("o_orderkey") % 3 == 0, "Fix: part").otherwise("add part")
    head = F.concat_ws("\x1f", F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), "o_custkey"), F.lit("1700000000"), subject)
    return R.parse_history(o.select(F.concat(head, F.lit("\n\n-\t-\tlogo.png\n"), "stats").alias("entry"))).drop("ts")


@query("""SELECT 'p' || p_partkey AS id, 'rule' AS kind, 'active' AS status, p_brand AS severity, p_name AS title, [p_type, 'x/**'] AS applies_to, CASE WHEN p_partkey % 2 = 0 THEN [p_brand] ELSE []::VARCHAR[] END AS tags, p_name || chr(10) || p_type AS body FROM part""")
def memory_files(spark, d):
    p = load(spark, d, "part")
    tags = F.when(F.col("p_partkey") % 2 == 0, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    rows = p.select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.lit("rule").alias("kind"), F.lit("active").alias("status"), F.col("p_brand").alias("severity"), F.col("p_name").alias("title"),
        F.array("p_type", F.lit("x/**")).alias("applies_to"), tags.alias("tags"), F.concat_ws("\n", "p_name", "p_type").alias("body"),
    )
    return R.parse_memories(R.memory_markdown(rows).select(F.col("markdown").alias("text")))


@query("""WITH f AS (SELECT 'r' || (p_partkey % 20) AS folder, CASE p_size % 4 WHEN 0 THEN 'rust' WHEN 1 THEN 'python' WHEN 2 THEN 'service' END AS role FROM part)
SELECT folder, string_agg(DISTINCT role, ',' ORDER BY role) AS roles FROM f WHERE role IS NOT NULL GROUP BY folder""")
def repository_roles(spark, d):
    name = F.element_at(F.array(*map(F.lit, ("Cargo.toml", "setup.py", "Dockerfile", "a.txt"))), (F.col("p_size") % 4 + 1).cast("int"))
    return R.repository_roles(load(spark, d, "part").select(F.concat(F.lit("r"), F.col("p_partkey") % 20, F.lit("/"), name).alias("path")))
