"""Queries over texts: retrieval, similarity, normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import scores, text
from quern.operators import lexical as L
from quern.operators import state
from quern.operators import summaries as S
from quern.plans.indexes import FIELDS, path_index, text_index
from quern.plans.registry import query
from quern.plans.roles import FILES, files, texts
from quern.session import load, small_batches

QUERY = "the of that"
TOKENS = r"list_filter(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+'), lambda t: len(t) >= {})"


def toks(expr: str, least: int = 1) -> str:
    return TOKENS.format(f"coalesce({expr}, '')", least)


def bm25_sql(table: str = "documents") -> str:
    return f"""d AS (SELECT doc_id AS id, source, {toks('text')} AS t, {toks('source')} AS s FROM {table}),
f AS (SELECT id, source, len(t) + len(s) AS l, {', '.join(f"2.0 * len(list_filter(t, lambda x: x = '{w}')) + len(list_filter(s, lambda x: x = '{w}')) AS f{k}" for k, w in enumerate(QUERY.split()))} FROM d),
g AS (SELECT count(*) AS n, avg(l) AS m, {', '.join(f'count(*) FILTER (f{k} > 0) AS d{k}' for k in range(3))} FROM f),
scored AS (SELECT id, source, round({' + '.join(f'greatest(ln((n - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * l / m))' for k in range(3))}, 6) AS score
  FROM f, g WHERE f0 > 0 AND f1 > 0 AND f2 > 0)"""


BM25 = f"WITH {bm25_sql()}"


@query(f"{BM25} SELECT id, score FROM scored WHERE source <> 'src0' ORDER BY score DESC, id LIMIT 10")
def bm25_search(spark, d):
    return text_index(spark, d).bm25(QUERY, FIELDS, F.col("source") != "src0")


@query("SELECT doc_id AS id, 0.0::DOUBLE AS score FROM documents WHERE contains(lower(text), 'tione') OR contains(lower(source), 'tione') ORDER BY id DESC LIMIT 10")
def search_fallback(spark, d):
    return L.search(texts(spark, d), "tione", FIELDS)


def _points(column: str, chained: int, each: int, words=("m1", "part")) -> str:
    return f"CASE WHEN regexp_matches({column}, '{'.*'.join(words)}') THEN {chained} ELSE 0 END + " + " + ".join(f"CASE WHEN contains({column}, '{w}') THEN {each} ELSE 0 END" for w in words)


@query(f"""WITH {FILES}, s AS (SELECT node AS id, language AS name, {_points('lower(language)', 100, 15, ('brand', '13'))} + {_points('lower(path)', 50, 10, ('brand', '13'))} AS score,
CAST(contains(lower(language), 'brand') OR contains(lower(language), '13') AS INT) AS name_hit FROM files)
SELECT id, CAST(score AS INT) AS score, name_hit FROM s WHERE score > 0 ORDER BY score DESC, name_hit DESC, name, id LIMIT 20""")
def symbol_search(spark, d):
    return L.substring_scores(files(spark, d).withColumnRenamed("node", "id"), "brand 13", "language", "path")


@query(f"WITH {FILES} SELECT path FROM files WHERE contains(lower(path), 'part12') ORDER BY length(path), path LIMIT 20")
def files_by_keyword(spark, d):
    return L.find_by_keyword(files(spark, d), "part12")


@query(f"""WITH {FILES}, t AS (SELECT path, list_distinct({toks('path')}) AS p FROM files),
s AS (SELECT path, list_sum(list_transform(['crates', 'm3', 'part77'], lambda q: CASE WHEN list_contains(p, q) THEN 10
  WHEN len(q) >= 4 AND len(list_filter(p, lambda x: len(x) >= 4 AND (contains(x, q) OR contains(q, x)))) > 0 THEN 3 ELSE 0 END)) AS score FROM t)
SELECT path, CAST(score AS INT) AS score FROM s WHERE score > 0 ORDER BY score DESC, length(path), path LIMIT 20""")
def files_by_tokens(spark, d):
    found = path_index(spark, d).by_tokens("crates/m3 part77").withColumnRenamed("id", "path")
    return found.orderBy(F.desc("score"), F.length("path"), "path").limit(20)


@query(f"WITH {FILES} SELECT path, 4 AS tier FROM files WHERE ends_with(path, '/part77.py') ORDER BY length(path), path LIMIT 1")
def resolved_path(spark, d):
    return L.resolve_path(files(spark, d), "./part77.py", "/work")


LINES = r"""lines AS (SELECT doc_id AS id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS line_no FROM documents),
around AS (SELECT *, coalesce(lag(line) OVER w, '') AS before, coalesce(lead(line) OVER w, '') AS after FROM lines WINDOW w AS (PARTITION BY id ORDER BY line_no))"""


@query(f"WITH {LINES} SELECT id, line_no, line, before, after FROM around WHERE contains(line, 'tion.')")
def literal_search(spark, d):
    return L.search_literal(texts(spark, d), "tion.", 1)


@query(f"""WITH {LINES}, h AS (SELECT id, line_no, line, before, after, greatest(length(line) // 4 + 1, 1) AS c FROM around WHERE contains(line, 'tion.')),
s AS (SELECT *, sum(c) OVER (ORDER BY id, line_no ROWS UNBOUNDED PRECEDING) AS t FROM h) SELECT id, line_no, line, before, after FROM s WHERE t <= 2000""")
def literal_search_budget(spark, d):
    return L.search_literal(texts(spark, d), "tion.", 1, budget=2000)


@query(rf"""WITH {LINES} SELECT CASE WHEN regexp_matches(line, '\b(def|fn|class|struct|enum|trait|interface|function|func|type|const|let|var)\s+the\b') THEN 'definition'
WHEN regexp_matches(line, '^\s*(import|from|use|require|#include)\b') THEN 'import' ELSE 'call_or_usage' END AS kind, id, line_no, line FROM lines WHERE regexp_matches(line, '\bthe\b')""")
def symbol_references(spark, d):
    return L.references(texts(spark, d), "the")


@query(f"""WITH d AS (SELECT doc_id AS id, list_distinct({toks('text', 2)}) AS t, lower(coalesce(text, '')) AS x FROM documents), q AS (SELECT ['the', 'of', 'that'] AS q)
SELECT id, round(least(1.0, 0.75 * len(list_intersect(q, t)) / 3 + CASE WHEN contains(x, 'the of that') THEN 0.25 ELSE 0 END), 6)::DOUBLE AS score FROM d, q""")
def overlap_rerank(spark, d):
    return texts(spark, d).select("id", F.round(L.overlap_score(F.lit(QUERY), F.coalesce("text", F.lit(""))), 6).alias("score"))


RANKS = f"""{BM25}, lexical AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20)),
recent AS (SELECT id, row_number() OVER (ORDER BY id DESC) AS rank FROM (SELECT id FROM f ORDER BY id DESC LIMIT 20))"""


@query(f"{RANKS} SELECT id, round(sum(1.0 / (60 + rank)), 6)::DOUBLE AS score FROM (SELECT * FROM lexical UNION ALL SELECT * FROM recent) GROUP BY id ORDER BY score DESC, id LIMIT 10")
def rank_fusion(spark, d):
    docs = texts(spark, d)
    a = L.ranked(text_index(spark, d).bm25(QUERY, FIELDS, n=20), F.desc("score"), "id")
    b = L.ranked(docs.select("id").orderBy(F.desc("id")).limit(20), F.desc("id"))
    return L.fuse(a, b)


WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '\s+'), lambda w: strlen(w) > 3))"


PAIRS = rf"""m AS (SELECT doc_id AS id, {WORDS.format("coalesce(text, '')")} AS w, contains(lower(text), 'deprecated') OR contains(lower(text), 'obsoleto') OR contains(lower(text), 'antiguo') OR contains(lower(text), 'no usar') AS old FROM documents),
u AS (SELECT id, unnest(w) AS word FROM m), c AS (SELECT x.id AS a, y.id AS b, count(*) AS n FROM u x JOIN u y ON x.word = y.word AND x.id < y.id GROUP BY ALL),
pairs AS (SELECT a, b, n / (len(x.w) + len(y.w) - n) AS s, x.old AS oa, y.old AS ob FROM c JOIN m x ON x.id = a JOIN m y ON y.id = b)"""


@query(f"""WITH {PAIRS}, k AS (SELECT id, old, min(id) OVER (PARTITION BY list_sort(w), old) AS first FROM m WHERE len(w) > 0)
SELECT CASE WHEN oa AND NOT ob THEN b ELSE a END AS src, CASE WHEN oa AND NOT ob THEN a ELSE b END AS dst, CASE WHEN oa <> ob THEN 'supersedes' ELSE 'reinforces' END AS edge_type,
CASE WHEN oa <> ob THEN 1.0 ELSE round(s, 6) END::DOUBLE AS weight FROM pairs WHERE s >= 0.35 AND a IN (SELECT first FROM k) AND b IN (SELECT first FROM k)
UNION ALL SELECT first, id, 'reinforces', 1.0 FROM k WHERE id <> first""")
def auto_wired_memories(spark, d):
    m = texts(spark, d).select("id", F.lit("").alias("title"), F.col("text").alias("error_context"), F.lit("").alias("solution"))
    return L.wire_memories(m, 0.35)


@query(f"""WITH {PAIRS}, l AS (SELECT a AS id FROM pairs WHERE s >= 0.8 UNION ALL SELECT b FROM pairs WHERE s >= 0.8), n AS (SELECT id, count(*) AS n FROM l GROUP BY id)
SELECT m.id, min(m.id) OVER (PARTITION BY list_sort(w)) AS class_id, coalesce(n, 0) AS n_links FROM m LEFT JOIN n ON n.id = m.id WHERE len(w) > 0""")
def similar_texts(spark, d):
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.octet_length(w) > 3)
    return L.similar_rows(texts(spark, d), words, 0.8)


@query(f"""WITH b AS (SELECT doc_id AS id, coalesce(lang, '') AS category, list_sort({toks('text')}) AS bag FROM documents), t AS (SELECT id, category, unnest(bag) AS token FROM b), c AS (SELECT id, category, token, count(*) AS n FROM t GROUP BY ALL),
m AS (SELECT id, sqrt(sum(n * n)) AS norm FROM c GROUP BY id), p AS (SELECT a.id AS a, b.id AS b, sum(a.n * b.n) AS dot FROM c a JOIN c b ON a.category = b.category AND a.token = b.token AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a AS id, count(*) AS n FROM p JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE dot / (x.norm * y.norm) >= 0.88 - 1e-9 GROUP BY a)
SELECT b.id, min(b.id) OVER (PARTITION BY category, bag) AS class_id, coalesce(n, 0) AS n_links FROM b LEFT JOIN l ON l.id = b.id WHERE len(bag) > 0""")
def frequency_cosine(spark, d):
    return L.cosine_rows(texts(spark, d).withColumnRenamed("lang", "category"), 0.88)


@query("""WITH g AS (SELECT p_partkey AS id, ['critical', 'high', 'medium', 'low'][CAST(p_size % 4 + 1 AS INT)] AS severity, CASE WHEN p_size % 2 = 0 THEN 'active' ELSE 'resolved' END AS status, p_retailprice AS created_at,
CASE WHEN p_partkey % 3 = 0 THEN 'crates/**' WHEN p_partkey % 3 = 1 THEN 'src/*' ELSE 'part9.py' END AS pattern FROM part)
SELECT id, severity FROM g WHERE status = 'active' AND (pattern = 'crates/**' OR pattern = 'part9.py') ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, created_at DESC, id LIMIT 3""")
def top_gotchas(spark, d):
    p, s = load(spark, d, "part"), F.col("p_size")
    pattern = F.when(F.col("p_partkey") % 3 == 0, "crates/**").when(F.col("p_partkey") % 3 == 1, "src/*").otherwise("part9.py")
    severity = F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), (s % 4 + 1).cast("int"))
    g = p.select(F.col("p_partkey").alias("id"), severity.alias("severity"), F.when(s % 2 == 0, "active").otherwise("resolved").alias("status"), F.col("p_retailprice").alias("created_at"), F.array(pattern).alias("applies_to"))
    return L.gotchas_for("crates/m1/part9.py", g).select("id", "severity")


@query(r"""WITH l AS (SELECT doc_id AS id, unnest(string_split_regex(coalesce(text, ''), '\r?\n')) AS line, generate_subscripts(string_split_regex(coalesce(text, ''), '\r?\n'), 1) AS line_no FROM documents),
k AS (SELECT id, line_no, trim(line) AS line FROM l WHERE trim(line) <> ''), b AS (SELECT id, line_no, line || chr(10) || lead(line) OVER w AS block FROM k WINDOW w AS (PARTITION BY id ORDER BY line_no))
SELECT md5(block) AS block, count(*) AS copies, min(id) AS first_id FROM b WHERE block IS NOT NULL GROUP BY block HAVING count(*) > 1""")
def duplicate_blocks(spark, d):
    return L.duplicate_blocks(texts(spark, d), 2).select(F.md5("block").alias("block"), "copies", "first_id")


NOISE = r"""CASE WHEN length(t) < 15 THEN 'TOO_SHORT' WHEN length(t) > 2500 THEN 'TOO_LONG' WHEN starts_with(t, '|') OR (length(t) - length(replace(t, '|', '')) >= 3 AND contains(t, chr(10) || '|')) THEN 'MARKDOWN_TABLE'
WHEN starts_with(t, '```') OR (length(t) - length(replace(t, '```', ''))) / 3 >= 2 THEN 'CODE_BLOCK' WHEN contains(t, 'Traceback (most recent call last)') OR contains(t, 'at Object.<anonymous>') OR starts_with(t, 'File "') THEN 'STACK_TRACE'
WHEN contains(t, chr(27) || '[') THEN 'ANSI_ESCAPE' WHEN starts_with(t, '{') AND ends_with(t, '}') AND contains(t, ':') THEN 'RAW_JSON' ELSE 'CLEAN' END"""


@query(rf"WITH d AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS t FROM documents) SELECT id, {NOISE} AS noise_type FROM d")
def noise_router(spark, d):
    return texts(spark, d).select("id", text.noise_reason(F.col("text")).alias("noise_type"))


def _redact(expr: str) -> str:
    for pattern, mark in text.SECRET_PATTERNS + text.PATH_PATTERNS:
        quoted = pattern.replace("'", "''")
        expr = f"regexp_replace({expr}, '{quoted}', '{mark}', 'g')"
    return expr


@query(f"SELECT doc_id AS id, md5({_redact('text')}) AS digest, {_redact('text')} <> text AS changed FROM documents")
def redacted_texts(spark, d):
    clean = text.redact(F.col("text"))
    return texts(spark, d).select("id", F.md5(clean).alias("digest"), (clean != F.col("text")).alias("changed"))


@query("""WITH c AS (SELECT doc_id AS id, unnest(string_split(text, '')) AS c FROM documents), n AS (SELECT id, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL), t AS (SELECT id, sum(n) AS t FROM n GROUP BY id),
e AS (SELECT id, round(-sum(n / t * log2(n / t)), 6) + 0 AS entropy FROM n JOIN t USING (id) GROUP BY id) SELECT doc_id AS id, coalesce(entropy, 0.0) AS entropy FROM documents LEFT JOIN e ON e.id = doc_id""")
def token_entropy(spark, d):
    small_batches(spark)
    return texts(spark, d).select("id", F.round(text.entropy(F.col("text")), 6).alias("entropy"))


@query(r"""SELECT doc_id AS id, sha256(lower(trim(regexp_replace(coalesce(text, ''), '[ \t\n\r\f]+', ' ', 'g')))) AS normalized_hash,
regexp_replace(regexp_replace(lower(trim(source || ' ' || lang)), '[^a-z0-9/]+', '-', 'g'), '^-+|-+$', '', 'g') AS topic_key, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents""")
def normal_forms(spark, d):
    return texts(spark, d).select("id", text.normalized_hash(F.coalesce("text", F.lit(""))).alias("normalized_hash"), text.topic_key(F.concat_ws(" ", "source", "lang")).alias("topic_key"), text.token_estimate(F.col("text")).alias("tokens"))


@query(f"""WITH {FILES} SELECT path, CASE WHEN split_part(path, '/', 1) IN ('crates', 'apps') THEN split_part(path, '/', 2) WHEN split_part(path, '/', 1) = 'src' THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS module,
CASE WHEN split_part(path, '/', 1) IN ('crates', 'apps', 'src') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) ELSE split_part(path, '/', 1) END AS subsystem,
replace(replace(path, '/', '.'), '-', '_') AS tree_path FROM files""")
def path_classes(spark, d):
    p = F.col("path")
    return files(spark, d).select("path", text.module_of(p).alias("module"), text.subsystem_of(p).alias("subsystem"), text.tree_path(p).alias("tree_path"))


MODULE = "CASE WHEN split_part(path, '/', 1) IN ('crates', 'apps', 'src') THEN split_part(path, '/', 2) ELSE split_part(path, '/', 1) END"


@query(f"""WITH {FILES}, f AS (SELECT path, language, functions, node, {MODULE} AS module FROM files), e AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM f a JOIN f b ON b.node = a.node + 1 AND a.module <> b.module)
SELECT module, count(*) AS files, CAST(sum(functions) AS BIGINT) AS functions, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, coalesce(any_value(d), '') AS depends_on
FROM f LEFT JOIN (SELECT src, string_agg(dst, ',' ORDER BY dst) AS d FROM e GROUP BY src) x ON x.src = module GROUP BY module""")
def capability_map(spark, d):
    f = files(spark, d)
    functions = f.select("path", F.explode(F.sequence(F.lit(1), F.col("functions"))).alias("n"))
    nxt = f.select((F.col("node") - 1).alias("node"), F.col("path").alias("dst_path"))
    return S.capability_map(f, functions, f.select("node", F.col("path").alias("src_path")).join(nxt, "node"))


@query(f"""WITH {FILES}, x AS (SELECT path, CASE WHEN regexp_matches(path, 'test|spec') THEN 'verify' WHEN regexp_matches(path, 'schema|model|entity|type|interface') THEN 'contracts'
WHEN regexp_matches(path, 'page|view|component|ui|api|route') THEN 'surface' ELSE 'logic' END AS phase FROM files) SELECT phase, path FROM x""")
def context_phases(spark, d):
    return S.phases(files(spark, d))


@query(f"""WITH {FILES}, r AS (SELECT path, 4.0 * len(list_intersect(list_distinct({toks('path')}), ['model', 'm3'])) AS points, 'goal' AS reason FROM files
UNION ALL SELECT path, CASE WHEN node % 2 = 0 THEN 6 ELSE 4 END, 'impact' FROM files WHERE functions % 9 = 5 UNION ALL SELECT path, greatest(5, round(7 * (functions / 50))), 'semantic' FROM files WHERE functions > 47
UNION ALL SELECT path, 3, 'changed' FROM files WHERE lessons = 2)
SELECT path, sum(points)::DOUBLE AS score, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM r WHERE points > 0 GROUP BY path ORDER BY score DESC, path LIMIT 20""")
def candidate_files(spark, d):
    f = files(spark, d)
    impact = f.where("functions % 9 = 5").select("path", (F.col("node") % 2 + 1).alias("depth"))
    semantic = f.where("functions > 47").select("path", (F.col("functions") / 50).alias("similarity"))
    return S.candidate_files(f, "model m3", impact, semantic, f.where("lessons = 2").select("path"))


@query(f"""WITH {FILES} SELECT (SELECT count(*) FROM files WHERE contains(path, 'm3')) AS files, (SELECT CAST(sum(functions) AS BIGINT) FROM files WHERE contains(path, 'm3')) AS functions,
(SELECT coalesce(CAST(sum(functions) AS BIGINT), 0) FROM files WHERE contains(path, 'm3') AND lessons = 1) AS heuristic, (SELECT count(*) FROM files WHERE contains(path, 'm3') AND lessons > 0) AS lessons,
(SELECT count(*) FROM files WHERE contains(path, 'm3') AND lessons = 2) AS without_embedding, (SELECT count(*) FROM files WHERE contains(path, 'm3')) AS edges""")
def graph_summary(spark, d):
    f = files(spark, d)
    functions = f.select("path", F.when(F.col("lessons") == 1, "heuristic").otherwise("tree").alias("strategy"), F.explode(F.sequence(F.lit(1), F.col("functions"))).alias("n"))
    lessons = f.where("lessons > 0").select(F.col("path").alias("file_path"), F.when(F.col("lessons") == 1, "v").alias("embedding"))
    return S.graph_summary(f, functions, lessons, f.select(F.col("path").alias("src_path")), "m3")


@query("""WITH t AS (SELECT doc_id AS id, text FROM documents), w AS (SELECT id, CASE WHEN h AND NOT r THEN [0.30, 0.60, 0.10] WHEN r AND NOT h THEN [0.30, 0.10, 0.60] ELSE [0.40, 0.30, 0.30] END AS w FROM (
SELECT id, """ + " OR ".join(f"contains(lower(text), '{w}')" for w in text.HOTFIX_WORDS) + " AS h, " + " OR ".join(f"contains(lower(text), '{w}')" for w in text.REFACTOR_WORDS) + """ AS r FROM t))
SELECT id, w[1]::DOUBLE AS alpha, w[2]::DOUBLE AS beta, w[3]::DOUBLE AS gamma FROM w""")
def attention_weights(spark, d):
    return texts(spark, d).select("id", scores.attention(F.col("text")).alias("w")).select("id", "w.*")


@query(r"""SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(trim(regexp_extract(url, '^https?://[^/]+(.*)$', 1)), '[?#].*$', ''), '\$?\{[^}]+\}', ':id', 'g'), '/+$', '') AS canonical FROM pages""")
def canonical_endpoints(spark, d):
    p = load(spark, d, "pages")
    return p.select("page_id", "url", text.endpoint_path(F.regexp_extract("url", "^https?://[^/]+(.*)$", 1)).alias("canonical"))


@query("""WITH f AS (SELECT lower(trim(text)) AS k, min(item_id) AS id, arg_min(text, item_id) AS content FROM benchmark GROUP BY 1)
SELECT id, content, array_to_string(list_filter(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), lambda t: len(t) >= 4)[1:3], '-') AS topic, round(greatest(0.60, 0.95 - 0.05 * (row_number() OVER (ORDER BY id) - 1)), 2)::DOUBLE AS confidence FROM f""".replace("\\\\p", "\\p"))
def ranked_memories(spark, d):
    return state.first_mentions(load(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content")))
