"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import binfile, chat, codes, counts, lsh, media, mixing, packing, pages, phrases, quality, simhash, urls
from quern.session import load as load_table
from quern.session import small_batches
from quern.storage import materialize

VOCABULARY = "byte_bpe_50k.json"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """An input table, read for long texts."""
    small_batches(spark)
    return load_table(spark, sf_dir, table)


def vocabulary(name: str = VOCABULARY) -> str:
    """Where the public vocabulary file is; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tokenizer versions of op1: one vocabulary is that of op7 and op8, as ranks.
TOKENIZERS = {"byte-bpe-50k": "byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "byte_bpe_multi_50k.tiktoken"}


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after four batches: all documents
    inserted under two tokenizers, exact copies deleted (a text that a smaller id has too),
    the second tokenizer's counts revised to count an end id per document, and the first
    batch delivered again, which changes nothing."""
    counted = counts.token_counts(load(spark, sf_dir, "documents"), [vocabulary(f) for f in TOKENIZERS.values()])
    docs = materialize(counted, "counted")
    groups = docs.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1"), "copied")  # so that both sides of the join can be dealt anew
    copies = docs.join(groups, "digest").where("id > first")
    one, two = TOKENIZERS

    def under(rows: DataFrame, version: str) -> DataFrame:
        n = F.element_at("counts", list(TOKENIZERS).index(version) + 1)
        return rows.select("source", "lang", F.lit(version).alias("tokenizer"), n.alias("n_tokens"), (n + 1).alias("new_tokens"))

    ledger = counts.Ledger(spark)
    first = [counts.inserted(under(docs, one)), counts.inserted(under(docs, two))]
    ledger.commit("load", *first)
    ledger.commit("exact-copies", counts.deleted(under(copies, one)), counts.deleted(under(copies, two)))
    # A copy's revision is taken back with the copy: what its delete did not know of.
    change = counts.revised(under(docs, two))
    back = counts.revised(under(copies, two)).withColumn("n_tokens", -F.col("n_tokens"))
    ledger.commit("end-ids", change, back)
    ledger.commit("load", *first)
    return ledger.totals()


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = pages.extract(load(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = media.text_media(load(spark, sf_dir, "documents"))
    return media.features(media.tile_media(images))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh.near_duplicates(load(spark, sf_dir, "embeddings"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(load(spark, sf_dir, "documents"))
    return mixed.select(
        F.col("id").alias("doc_id"), "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit_on(docs, load(spark, sf_dir, "labels")))


def _packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, vocabulary())
    return packing.number(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


def op7_sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(load(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binfile.read_tokens(binfile.write_tokens(load(spark, sf_dir, "documents"), vocabulary()))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digests(chat.format_turns(turns)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


#: Rules of op11.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return urls.judge(load(spark, sf_dir, "pages"), rules)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(load(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.encode(load(spark, sf_dir, "embeddings"))


def chat_typed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's operator over typed parts: each turn is its text between an image whose size
    comes from the text's length and, in answers, a document of as many pages as the turn's number."""
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n, kind = F.length("text"), "type string, url string, width long, height long, text string, pages long"
    image = F.struct(F.lit("image").alias("type"), F.concat(F.lit("img/"), "conv_id").alias("url"), n.alias("width"), F.lit(56).alias("height"))
    text = F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))
    paper = F.struct(F.lit("document").alias("type"), (F.col("turn") + 1).alias("pages"))
    listed = [F.from_json(F.to_json(x), kind) for x in (image, text, paper)]
    parts = F.when(F.col("role") == "assistant", F.array(*listed)).otherwise(F.array(*listed[:2]))
    written = chat.format_turns(turns.withColumn("parts", F.to_json(parts)), "parts")
    return chat.digests(written).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "attachments", "expanded_tokens")


def _codes_sql(rounds: int = codes.ROUNDS) -> str:
    """op13 with its rounds written out."""
    nearest = """a{k} AS (
  SELECT v.vec_id, v.label, v.p, v.x, e, d FROM (
    SELECT v.vec_id, v.p, b.e, list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i]))) AS d
    FROM v JOIN b{k} b ON b.p = v.p) z JOIN v ON v.vec_id = z.vec_id AND v.p = z.p
  QUALIFY row_number() OVER (PARTITION BY v.vec_id, v.p ORDER BY d, e) = 1),"""
    book = """s{k} AS (
  SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, 1025)) AS i) WHERE i <= len(x) GROUP BY ALL),
b{next} AS (
  SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e),"""
    steps = [nearest.format(k=k) + "\n" + book.format(k=k, next=k + 1) for k in range(rounds)]
    return "\n".join(["""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 4096) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
v AS (
  SELECT vec_id, label, p, x[p * len(x) // 8 + 1:(p + 1) * len(x) // 8] AS x FROM q, (SELECT unnest(range(0, 8)) AS p)),
b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM v QUALIFY e < 16),""", *steps, nearest.format(k=rounds), f"""
h AS (
  SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds}),
c AS (
  SELECT vec_id, label, string_agg(lpad(lower(hex(e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM c, h"""])


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_html_extraction, op3_media_columns, op4_embedding_near_dedup, op5_source_mixing,
        op6_quality_classifier, op7_sequence_packing, op8_token_files, op9_simhash_near_dedup, op10_chat_formatting,
        op11_url_filters, op12_phrase_collocations, op13_vector_codes, chat_typed_parts,
    )
}

ORACLES = {
    # These pages hold their text in one article of headings and paragraphs.
    "op2_html_extraction": r"""
WITH a AS (
  SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '<article>(.*?)(?:</article>|$)', 1, 's'), '<br>', ' ') AS x FROM pages),
b AS (
  SELECT page_id, url, list_filter(list_transform(string_split_regex(x, '</?(?:h1|p)>'), lambda s: trim(regexp_replace(
    replace(regexp_replace(replace(replace(replace(regexp_replace(s, '<[^>]*(>|$)', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'), '&nbsp;', ' '),
    '\s+', ' ', 'g'))), lambda s: s <> '') AS l FROM a)
SELECT page_id, url, array_to_string(l, chr(10) || chr(10)) AS text, length(array_to_string(l, chr(10) || chr(10))) AS n_chars FROM b""",
    "op4_embedding_near_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
g AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_sum(list_transform(e, lambda x: x * x)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id""",
    "op10_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
f AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS body FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(length(role) + length(body) + 12 + 1 + 10 + 1) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op11_url_filters": r"""
WITH u AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(h, p, v))
SELECT page_id, host, path, h || p AS rule, coalesce(v, 'allow') AS verdict
FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1""",
    "op13_vector_codes": _codes_sql(),
    "op12_phrase_collocations": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM p),
t AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM w, (SELECT unnest(range(1, 5)) AS m)),
f AS (
  SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (
  SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (
  SELECT lang, phrase, a, w, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, k.k, x.f AS l, y.f AS r, CAST(CAST(2000000 AS HUGEINT) * k.a // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(w[1:k.k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(w[k.k + 1:], ' ')),
b AS (
  SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (
  SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS longer
  FROM c, (SELECT unnest(range(2, 4)) AS n) z, (SELECT unnest(range(1, 4)) AS i) y WHERE n < m AND i + n - 1 <= m GROUP BY ALL),
d AS (
  SELECT b.lang, b.phrase, a, l, r, score FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a),
o AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM d)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN t ON t.lang = o.lang WHERE rank <= 2000""",
    "chat_typed_parts": r"""
WITH t AS (
  SELECT conv_id, turn, role, role = 'assistant' AS answer, coalesce(text, '') AS text,
         '<|image_1|>' || coalesce(text, '') || CASE WHEN role = 'assistant' THEN '<|document_2|>' ELSE '' END AS body FROM conversations)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || body || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN answer THEN length(body) ELSE 0 END) AS BIGINT) AS loss_chars, CAST(sum(CASE WHEN answer THEN 2 ELSE 1 END) AS BIGINT) AS attachments,
       CAST(sum(2 * ceil(greatest(1, length(text)) / 28) + CASE WHEN answer THEN 256 * (turn + 1) ELSE 0 END) AS BIGINT) AS expanded_tokens
FROM t GROUP BY conv_id""",
}
