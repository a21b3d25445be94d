"""The classifier's held-out accuracy, the registered queries and the pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import queries, quality
from tests.llm.test_counts_mixing_chat import plain_targets
from tests.llm.test_dedup import grouped, plain_fingerprint
from tests.llm.test_jaccard import plain_shingles, similarity
from tests.oracle import compare, connect


def sample(n, seed=1):
    rng = random.Random(seed)
    syllables = "ba ke lo mi ru ta so ne vi du".split()

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))

    good = [" ".join(word() + rng.choice(["", "", ",", "."]) for _ in range(rng.randrange(5, 120))) for _ in range(n)]
    bad = [" ".join([w := word(), w, w, w + "***", w.upper() + "!!"] * rng.randrange(2, 20)) for _ in range(n)]
    return good + bad, [1] * n + [0] * n


def test_classifier_holds_on_new_texts():
    model = quality.fit(*sample(150))
    texts, labels = sample(100, seed=2)
    score = model.score(texts)
    assert ((score >= 0.5) == np.array(labels)).mean() >= 0.98
    loss = -np.mean(np.where(labels, np.log(score + 1e-9), np.log(1 - score + 1e-9)))
    assert loss < 0.2 and 0 <= model.score([None, ""])[0] <= 1


def test_fit_without_both_labels():
    assert quality.fit([], []).score(["a"])[0] == pytest.approx(0.5)
    assert quality.fit(["a", "b"], [1, 1]).score(["x"])[0] > 0.9


def test_sample_keeps_shares_and_bytes(rows, monkeypatch):
    texts, _ = sample(200)
    docs = rows("doc_id long, text string", *enumerate(texts), (9_000, "x" * 100_000))
    marks = rows("doc_id long, quality int", *[(k, int(k % 10 > 0)) for k in range(400)], (9_000, 0))
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda t, y: seen.update(texts=t, labels=y))
    for most in (60, 120, 400):
        quality.fit_on(docs, marks, most, most_bytes=200_000)
        assert len(seen["labels"]) <= most and 0.8 <= np.mean(seen["labels"]) <= 0.97 and all(len(t) < 50_000 for t in seen["texts"])
    quality.fit_on(docs, marks, 400, most_bytes=20_000)
    assert 10 < len(seen["texts"]) < 200 and sum(len(t.encode()) for t in seen["texts"]) <= 20_000


def test_shape_is_of_the_whole_word():
    assert quality.shape("a" * 100 + "9" + "中" * 500 + "!") == "a0a!"


def test_score_of_odd_rows(rows):
    texts, labels = sample(40)
    docs = rows("doc_id long, text string, score string", *[(k, t, "clash") for k, t in enumerate(texts)], (None, None, None), (0, texts[0], None), (7000, "x" * 100_000, None))
    marks = rows("doc_id long, quality int", *[(k, q) for k, q in enumerate(labels)], (None, 1), (3, None), (5, 0), (9999, 1))
    model = quality.fit_on(docs, marks, most_rows=60)
    got = quality.score(docs, model).collect()
    assert len(got) == 83 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert quality.keep_good(docs, model).columns == docs.columns
    assert quality.score(docs.where(F.lit(False)), model).count() == 0


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, sf_dir, con, name):
    compare(con, queries.ORACLES[name], queries.QUERIES[name](spark, sf_dir))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES) - {"op1_token_counts"}))
def test_queries_return_whole_tables(spark, sf_dir, name):
    table, key = ("pages", "page_id") if name.startswith("op2") else ("documents", "doc_id")
    ids = {r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect()}
    assert {r[0] for r in queries.QUERIES[name](spark, sf_dir).select(key).collect()} == ids


def test_quality_of_held_out_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = queries.QUERIES["op6_quality_classifier"](spark, sf_dir).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.good_quality(spark, docs, sf_dir)
    scores = {r.doc_id: r.predicted for r in queries.QUERIES["op6_quality_classifier"](spark, sf_dir).collect()}
    kept = good.collect()
    assert {r.doc_id for r in kept} == {k for k, p in scores.items() if p}
    ids, fps, sets = [r.doc_id for r in kept], [plain_fingerprint(r.text) for r in kept], [plain_shingles(r.text) for r in kept]
    want = grouped(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2 or similarity(sets[a], sets[b]) >= 0.8, ids)
    one = corpus_pipeline.no_near_copies(spark, good, sf_dir)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(want)) and one.columns == docs.columns
    mixed = corpus_pipeline.mixture(spark, one, sf_dir)
    times = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    sizes = {r.doc_id: (r.source, len(re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode()))) for r in one.collect()}
    per = {}
    for source, n in sizes.values():
        per[source] = per.get(source, 0) + n
    assert set(times) <= set(sizes) and max(times.values()) <= 2
    for source, target in plain_targets(per).items():
        taken = sum(times.get(k, 0) * n for k, (s, n) in sizes.items() if s == source)
        assert abs(taken - target) <= max(n for s, n in sizes.values() if s == source)
    assert times == {r.doc_id: r["count"] for r in corpus_pipeline.mixture(spark, one.repartition(5), sf_dir).groupBy("doc_id").count().collect()}
    packed = corpus_pipeline.packed(spark, mixed, sf_dir).groupBy("doc_id").agg(F.countDistinct("part", "doc_key").alias("n"))
    assert {r.doc_id: r.n for r in packed.collect()} == times


def test_stages_on_odd_rows(spark, sf_dir, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = rows(schema, (1, "a b c d", "en", "s", 7), (1, "a b c d", "en", "s", 7), (None, "a b c d", None, None, None), (None, "lone text of its own", None, None, None), (2, None, None, None, None), (3, "", None, None, 0), (4, "z " * 50_000, None, "s", 1))
    one = corpus_pipeline.no_near_copies(spark, docs, sf_dir)
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 2, 4]
    mixed = corpus_pipeline.mixture(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and all(mixed.where(f"doc_id = {k}").count() <= 2 for k in (2, 3, 4))
    equal = rows(schema, *[(None, "a b c", "en", "s", 5)] * 40, *[(7, "d e", "en", None, 3)] * 10)
    times = {r.source: r["count"] for r in corpus_pipeline.mixture(spark, equal, sf_dir).groupBy("source").count().collect()}
    goal = plain_targets({"s": 120, None: 20})
    assert abs(times["s"] * 3 - goal["s"]) <= 3 and abs(times[None] * 2 - goal[None]) <= 2
    empty = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
