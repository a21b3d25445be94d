"""The inverted index against the scan."""

import pytest
from pyspark.sql import functions as F

from quern.operators import lexical as L
from quern.operators.index import TextIndex
from quern.sources.versions import Versions

SCHEMA = "id long, title string, body string, lang string"
WEIGHTS = {"title": 2.0, "body": 1.0}


def documents(n=60, start=0):
    return [(k, f"note {k % 4}" if k % 5 else None, " ".join(["alpha"] * (k % 3) + ["beta"] * (k % 2) + ["x%d" % k]), "en" if k % 2 else "de") for k in range(start, start + n)]


def same(index, docs, query, keep=None):
    got = [(r.id, r.score) for r in index.bm25(query, WEIGHTS, keep, n=30).collect()]
    assert got == [(r.id, r.score) for r in L.bm25(docs, query, WEIGHTS, keep, n=30).collect()] and got


def test_index_equals_the_scan_through_changes(spark, rows, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", list(WEIGHTS), ["lang"], 4)
    assert index.bm25("alpha").count() == 0 and index.by_tokens("alpha").count() == 0 and index.merge() == 1
    index.add(rows(SCHEMA, *documents(40)))
    index.add(rows(SCHEMA, *documents(20, 40), (None, "t", "b", "en")).where("id is not null"))
    docs = rows(SCHEMA, *documents())
    for query in ("alpha", "alpha beta", "note beta alpha", "note 3"):
        same(index, docs, query)
    same(index, docs, "alpha", F.col("lang") == "de")
    index.delete(rows("id long", (3,), (4,), (4,), (None,), (999,)))
    index.update(rows(SCHEMA, (5, "alpha", "beta", "en"), (4, "alpha alpha", "back", "de"), (70, "", None, None)))
    changed = docs.where("id not in (3, 4, 5)").unionAll(rows(SCHEMA, (5, "alpha", "beta", "en"), (4, "alpha alpha", "back", "de"), (70, "", None, None)))
    for _ in range(2):
        for query in ("alpha", "alpha beta", "back"):
            same(index, changed, query, F.coalesce("lang", F.lit("")) != "fr")
        assert index.bm25("x3").count() == 0 and index.bm25("never").count() == 0 and index.bm25(" - ").count() == 0
        index.merge()
    state = index.versions.newest()[1]
    assert len(state["segments"]) == 1 and state["deleted"] == [] and state["documents"] == 60
    assert index.vacuum() > 3 and TextIndex(spark, f"{tmp_path}/i").bm25("back").count() == 1
    for bad in ([(1, "a", "b", "c"), (1, "a", "b", "c")], [(None, "a", "b", "c")]):
        with pytest.raises(ValueError):
            index.add(rows(SCHEMA, *bad))
    index.delete(changed.select("id"))
    assert index.bm25("alpha").count() == 0


def test_only_the_terms_folders_are_read(spark, rows, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/i", ["title", "body"], [], 16)
    index.add(rows(SCHEMA, *documents()))
    found = index.bm25("alpha", WEIGHTS)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(term" in plan or "EqualTo(term,alpha)" in plan
    files = index._postings(index.versions.newest()[1], ["alpha"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("bucket=")[1].split("/")[0] for r in files}) == 1


def test_tokens_equal_the_scan(spark, rows, tmp_path):
    paths = ["src/parser/tree.py", "src/parse/a.py", "docs/parsers.md", "x/y", "tree/tree.py", "lib/treehouse/par"]
    index = TextIndex(spark, f"{tmp_path}/i", ["path"])
    index.add(rows("id string, path string", *[(p, p) for p in paths]))
    for query in ("parser tree", "py", "parse", "zzz", "treehouses"):
        got = {(r.id, r.score) for r in index.by_tokens(query).collect()}
        assert got == {(r.path, r.score) for r in L.find_by_tokens(rows("path string", *[(p,) for p in paths]), query).collect()}


def test_a_lost_race_is_tried_again(spark, rows, tmp_path):
    a = Versions(spark, f"{tmp_path}/v")
    assert a.publish(1, {"n": 0}) and not a.publish(1, {"n": 5})
    seen = []

    def step(state):
        seen.append(state["n"])
        if len(seen) == 1:
            Versions(spark, f"{tmp_path}/v").publish(2, {"n": 10})
        return {"n": state["n"] + 1}

    assert a.change(step) == 3 and seen == [0, 10] and a.newest() == (3, {"n": 11}) and a.change(lambda s: None) == 3
    index = TextIndex(spark, f"{tmp_path}/i", ["title", "body"], ["lang"], 2)
    index.add(rows(SCHEMA, *documents(10)))
    other = TextIndex(spark, f"{tmp_path}/i")
    write = index._write

    def slow(*args):
        write(*args)
        other.add(rows(SCHEMA, *documents(10, 10)))
        other.delete(rows("id long", (1,)))
        index._write = write

    index.delete(rows("id long", (2,)))
    index._write = slow
    index.merge()  # another writer adds and deletes while it runs
    assert {r.id for r in index.bm25("note", n=99).collect()} == {k for k in range(20) if k % 5} - {1, 2}
