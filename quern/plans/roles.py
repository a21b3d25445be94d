"""The input tables in the roles that the operators expect, as DataFrames and as SQL.

Orders are commits, parts are files, customers are authors, returned lines are fixes, events
are traces and search trees, documents are texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.session import load


def history(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = load(spark, d, "lineitem"), load(spark, d, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("commit"), F.col("o_custkey").alias("author"), F.col("l_partkey").alias("file"), F.col("l_quantity").alias("insertions"),
        F.col("l_linenumber").alias("deletions"), (F.col("l_returnflag") == "R").alias("is_fix"), F.col("l_shipdate").alias("ts"),
    )


HISTORY = """history AS (
  SELECT l_orderkey AS commit, o_custkey AS author, l_partkey AS file, l_quantity AS insertions, l_linenumber AS deletions,
         l_returnflag = 'R' AS is_fix, l_shipdate AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def edits(spark: SparkSession, d: str) -> DataFrame:
    """Files per commit; a line's part folded into 40 files, at any size, so that files recur."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), (F.col("l_partkey") % 40).alias("file"))


def part_edits(spark: SparkSession, d: str) -> DataFrame:
    """Files per commit; a line's part is a file, so that files grow with the data."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("file"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Two imports per part, by arithmetic on its key and size; weights in tenths."""
    part = load(spark, d, "part")
    n = part.agg(F.count("*").alias("n"))
    keyed = part.select("p_partkey", "p_size").crossJoin(F.broadcast(n))  # one row
    near, far = (F.col("p_partkey") * 13 + F.col("p_size")) % F.col("n") + 1, (F.col("p_partkey") * 29 + 7) % F.col("n") + 1
    src, weight = F.col("p_partkey").alias("src"), ((F.col("p_size") % 10 + 1) / 10).alias("weight")
    both = keyed.select(src, near.alias("dst"), weight).unionAll(keyed.select(src, far.alias("dst"), F.lit(0.5)))
    return both.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("weight"))


EDGES = """edges AS (
  SELECT src, dst, max(weight) AS weight FROM (
    SELECT p_partkey AS src, (p_partkey * 13 + p_size) % (SELECT count(*) FROM part) + 1 AS dst, (p_size % 10 + 1) / 10 AS weight FROM part
    UNION ALL SELECT p_partkey, (p_partkey * 29 + 7) % (SELECT count(*) FROM part) + 1, 0.5 FROM part) WHERE src <> dst GROUP BY src, dst)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Events as search trees: each user a trajectory, its k-th event a child of the (k/2)-th."""
    e = load(spark, d, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    k = e.withColumn("k", F.row_number().over(order)).withColumn("up", F.floor(F.col("k") / 2))
    parent = k.select(F.col("user_id").alias("pu"), F.col("k").alias("pk"), F.col("event_id").alias("parent_id"))
    rows = k.join(parent, (F.col("user_id") == F.col("pu")) & (F.col("up") == F.col("pk")), "left")
    v = F.floor("value").cast("long")
    return rows.select(
        F.col("user_id").alias("trajectory_id"), F.col("event_id").alias("id"), "parent_id", (F.length(F.bin("k")) - 1).cast("int").alias("depth"),
        (v * 30).alias("cost_tokens"), (v * 40).alias("latency_ms"), (v % 21 - 10).cast("double").alias("reward_score"), (v % 7 + 1).alias("visit_count"),
        ((v % 11) / 10).alias("value_estimate"), (F.col("event_type") == "purchase").alias("is_solution"), (F.col("event_type") == "error").alias("is_pruned"),
        (F.col("event_type") == "click").alias("recommended"), (v % 2 == 0).alias("followed"), F.col("ts").alias("created_at"), F.col("event_type").alias("note"), "k",
    )


NODES = """ranked_events AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, CAST(floor(value) AS BIGINT) AS v FROM events),
nodes AS (
  SELECT e.user_id AS trajectory_id, e.event_id AS id, p.event_id AS parent_id, length(bin(e.k)) - 1 AS depth, e.v * 30 AS cost_tokens, e.v * 40 AS latency_ms,
         CAST(e.v % 21 - 10 AS DOUBLE) AS reward_score, e.v % 7 + 1 AS visit_count, (e.v % 11) / 10 AS value_estimate, e.event_type = 'purchase' AS is_solution,
         e.event_type = 'error' AS is_pruned, e.event_type = 'click' AS recommended, e.v % 2 = 0 AS followed, e.ts AS created_at, e.k AS k
  FROM ranked_events e LEFT JOIN ranked_events p ON p.user_id = e.user_id AND p.k = e.k // 2)"""


def texts(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")


def files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: a path of container, module, folder and name."""
    p = load(spark, d, "part")
    group = F.element_at(F.array(*map(F.lit, ("crates", "apps", "src", "docs"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    inner = F.element_at(F.array(*map(F.lit, ("src", "model", "view", "api", "test"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    path = F.concat(group, F.lit("/m"), (F.col("p_size") % 7).cast("string"), F.lit("/"), inner, F.lit("/part"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return p.select(F.col("p_partkey").alias("node"), path.alias("path"), F.lower("p_brand").alias("language"), F.col("p_size").alias("functions"), (F.col("p_partkey") % 3).alias("lessons"), F.col("p_retailprice").alias("score"))


FILES = """files AS (
  SELECT p_partkey AS node, ['crates', 'apps', 'src', 'docs'][CAST(p_partkey % 4 + 1 AS INT)] || '/m' || (p_size % 7) || '/' ||
         ['src', 'model', 'view', 'api', 'test'][CAST(p_partkey % 5 + 1 AS INT)] || '/part' || p_partkey || '.py' AS path,
         lower(p_brand) AS language, p_size AS functions, p_partkey % 3 AS lessons, p_retailprice AS score FROM part)"""


#: Source files of four kinds, one per part: ``{x}`` is an expression over the part's number k.
#: They have no single quotes or backslashes, so that one SQL text serves both engines.
SOURCE_FILES = (
    (
        "svc/m{k % 7}/part{k}.py",
        """import os
from m{k % 7}.part{k + 4} import load{k + 4}
router = APIRouter(prefix="/api/m{k % 7}")

@router.get("/items/{{id}}")
async def load{k}(a, b=1):
    return query{k % 3}(a)

class Model{k}:
    __tablename__ = "t{k % 50}\"""",
    ),
    (
        "web/part{k}.tsx",
        """import {{ api }} from "./part{k + 4}"
export function Page{k}() {{
  fetch(`/api/m{(k - 1) % 7}/items/{{id}}`, {{
    method: "POST"
  }})
  axios.get("/api/m{k % 7}/list?page=2")
  {CASE WHEN k % 2 = 0 THEN '' ELSE 'await ' END}loadAll({CASE k % 3 WHEN 0 THEN '1' WHEN 1 THEN '1, f(2, 3)' ELSE '1,' || chr(10) || '    [2, 3], f(4)' END}); loadAll(1)
}}""",
    ),
    (
        "db/v{k}.sql",
        """-- part {k}; create table no(id)
CREATE TABLE {CASE WHEN k % 3 = 0 THEN 'IF NOT EXISTS ' ELSE '' END}s.t{k % 50} (id int, o int REFERENCES t{k % 7}(id));
-- {CASE WHEN k % 5 = 0 THEN 'ALLOW_DESTRUCTIVE' ELSE 'note' END}
DROP TABLE IF EXISTS old_{k % 50};
ALTER TABLE ONLY t{k % 50} ADD COLUMN c int;""",
    ),
    (
        "log/run{k}.txt",
        """{k % 9} passed, {k % 3} failed, {k % 2} skipped in 1s
# Key Learnings:
- learned {k}
1. also {k % 7}
# Next
- no""",
    ),
)


def _sql(template: str) -> str:
    """A template as an SQL expression of concatenated literals and casts."""
    out, literal, at = [], "", 0
    while at < len(template):
        c = template[at]
        if template[at : at + 2] in ("{{", "}}"):
            literal, at = literal + c, at + 2
        elif c == "{":
            end = template.index("}", at)
            out += [f"'{literal}'", f"CAST({template[at + 1 : end]} AS VARCHAR(200))"]
            literal, at = "", end + 1
        elif c == "\n":
            out += [f"'{literal}'", "chr(10)"]
            literal, at = "", at + 1
        else:
            literal, at = literal + c, at + 1
    return " || ".join(x for x in [*out, f"'{literal}'"] if x != "''")


SOURCE_PATH = "CASE k % 4 " + " ".join(f"WHEN {n} THEN {_sql(p)}" for n, (p, _) in enumerate(SOURCE_FILES)) + " END"
SOURCE_TEXT = "CASE k % 4 " + " ".join(f"WHEN {n} THEN {_sql(t)}" for n, (_, t) in enumerate(SOURCE_FILES)) + " END"
SOURCES = f"""k AS (SELECT p_partkey AS k, p_size AS size FROM part),
sources AS (SELECT k, {SOURCE_PATH} AS path, {SOURCE_TEXT} AS text FROM k)"""


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(k, path, text): parts as source files: services, pages, migrations and logs of test runs."""
    k = load(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return k.select("k", F.expr(SOURCE_PATH).alias("path"), F.expr(SOURCE_TEXT).alias("text"))
