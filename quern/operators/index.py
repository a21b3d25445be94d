"""An inverted index: postings by term in segments, for searches that read only their terms.

A segment holds, for the documents of one ``add``, postings (term, id, length of the document,
frequency in each field) in folders by a hash of the term, sorted by term inside each file;
the terms with their document frequency; and the documents (id, length, stored columns). A
delete writes ids, which hide documents of older segments. ``merge`` rewrites all segments
as one. Each change is one new state (``Versions``), so searches see all of it or nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators.lexical import bm25_score, query_words
from quern.sources.versions import Versions

#: Tokens whose postings are in one file, and so sorted by one task.
FILE_TOKENS = 2_000_000


class TextIndex:
    """Documents by id over text columns ``fields``; ``stored`` columns can filter hits.

    An id is a document's key: a null id, or one that repeats within one ``add`` or ``update``,
    raises. Null texts are empty; a document without any token counts in the number and mean
    length of documents but is never found. Fields, stored columns and buckets are fixed by
    whoever creates the index; later openings take them from it."""

    def __init__(self, spark: SparkSession, folder: str, fields: list[str] | None = None, stored: list[str] = (), buckets: int = 64):
        self.spark, self.versions = spark, Versions(spark, folder)
        state = self.versions.newest()[1]
        if state is None:
            if not fields:
                raise ValueError("a new index needs its fields")
            empty = {"fields": list(fields), "stored": list(stored), "buckets": buckets, "segments": [], "deleted": [], "next": 1, "documents": 0, "length": 0}
            self.versions.publish(1, empty)
            state = self.versions.newest()[1]
        self.fields, self.stored, self.buckets = state["fields"], state["stored"], state["buckets"]

    # Writing

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, folder: str, tokens: int) -> None:
        root = f"{self.versions.folder}/{folder}"
        # A bucket is cut into files by id, as many as its tokens need, so that neither a bucket nor
        # a term of very many documents is one task's. A given number of partitions stays.
        parts = max(1, -(-tokens // (self.buckets * FILE_TOKENS)))
        tasks = max(1, min(self.buckets * parts, -(-2 * tokens // FILE_TOKENS)))
        part = F.pmod(F.xxhash64("id"), F.lit(parts))
        dealt = postings.withColumn("bucket", self._bucket(F.col("term"))).repartition(tasks, "bucket", part).sortWithinPartitions("bucket", "term", "id")
        dealt.write.partitionBy("bucket").parquet(f"{root}/postings")
        kept = self.spark.read.schema(dealt.schema).parquet(f"{root}/postings")
        terms = kept.groupBy("bucket", "term").agg(F.count("*").alias("documents"))
        terms.repartition(tasks, "bucket", F.pmod(F.hash("term"), F.lit(parts))).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{root}/terms")

    def _segment(self, docs: DataFrame) -> tuple[str, int, int, DataFrame] | None:
        """Folder, documents and length of a written segment, and its ids; None for no rows."""
        tokens = [text.tokens(F.coalesce(F.col(c), F.lit(""))) for c in self.fields]
        cut = docs.select("id", *self.stored, *[t.alias(f"t{k}") for k, t in enumerate(tokens)])
        length = reduce(Column.__add__, [F.size(f"t{k}") for k in range(len(tokens))]).cast("long").alias("length")
        listed = cut.select("id", length, *self.stored)
        folder = self.versions.new("segment")
        listed.write.parquet(f"{self.versions.folder}/{folder}/documents")
        written = self.spark.read.schema(listed.schema).parquet(f"{self.versions.folder}/{folder}/documents")
        n, ids, total = written.agg(F.count("*"), F.countDistinct("id"), F.sum("length")).first()
        if not n:
            return None
        if n != ids:
            raise ValueError("ids of an index are unique and not null")
        fields = F.array(*[F.struct(F.lit(k).alias("field"), F.col(f"t{k}").alias("tokens")) for k in range(len(tokens))])
        each = cut.select("id", length, F.explode(fields).alias("f")).select("id", "length", "f.field", F.explode("f.tokens").alias("term"))
        counts = [F.count(F.when(F.col("field") == k, 1)).cast("int").alias(f"f{k}") for k in range(len(tokens))]
        self._write(each.groupBy("term", "id", "length").agg(*counts), folder, total)
        return folder, n, total, written.select("id")

    def add(self, docs: DataFrame) -> int:
        """Adds documents (id, fields, stored columns) as a segment; ids must be new (else ``update``)."""
        made = self._segment(docs)
        return self.versions.change(lambda state: self._with(state, made)) if made else self.versions.newest()[0]

    @staticmethod
    def _with(state: dict, made: tuple) -> dict:
        folder, n, total, _ = made
        segment = {"folder": folder, "at": state["next"], "documents": n, "length": total}
        return state | {"segments": [*state["segments"], segment], "next": state["next"] + 1, "documents": state["documents"] + n, "length": state["length"] + total}

    def _without(self, state: dict, ids: DataFrame, folder: str) -> dict:
        """Hides ids (written in ``folder``) of the segments so far."""
        gone = self._documents(state).join(ids, "id", "left_semi").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        tomb = {"folder": folder, "before": state["next"]}
        return state | {"deleted": [*state["deleted"], tomb], "next": state["next"] + 1, "documents": state["documents"] - gone[0], "length": state["length"] - gone[1]}

    def _tombs(self, ids: DataFrame) -> tuple[DataFrame, str]:
        folder = self.versions.new("deleted")
        ids = ids.select("id").where("id is not null").distinct()
        ids.write.parquet(f"{self.versions.folder}/{folder}")
        return self.spark.read.schema(ids.schema).parquet(f"{self.versions.folder}/{folder}"), folder

    def delete(self, ids: DataFrame) -> int:
        """Removes documents by id; unknown ids change nothing."""
        stored, folder = self._tombs(ids)
        return self.versions.change(lambda state: self._without(state, stored, folder))

    def update(self, docs: DataFrame) -> int:
        """Adds documents in place of those of the same ids, in one change."""
        made = self._segment(docs)
        if not made:
            return self.versions.newest()[0]
        stored, folder = self._tombs(made[3])
        return self.versions.change(lambda state: self._with(self._without(state, stored, folder), made))

    def merge(self) -> int:
        """Rewrites all segments as one without deleted documents. Changes made meanwhile stay."""
        state = self.versions.newest()[1]
        if len(state["segments"]) < 2 and not state["deleted"]:
            return self.versions.newest()[0]
        folder, old = self.versions.new("segment"), [s["folder"] for s in state["segments"]]
        tombs = [t["folder"] for t in state["deleted"]]
        merged = []
        if state["documents"]:
            self._documents(state).write.parquet(f"{self.versions.folder}/{folder}/documents")
            self._write(self._postings(state), folder, state["length"])
            # It is as old as its newest part, so that later deletes hide its documents.
            merged = [{"folder": folder, "at": max(s["at"] for s in state["segments"]), "documents": state["documents"], "length": state["length"]}]

        def step(now: dict) -> dict | None:
            if any(f not in [s["folder"] for s in now["segments"]] for f in old):
                return None  # another merge was first
            left = [s for s in now["segments"] if s["folder"] not in old]
            return now | {"segments": [*merged, *left], "deleted": [t for t in now["deleted"] if t["folder"] not in tombs]}

        return self.versions.change(step)

    def vacuum(self) -> int:
        """Removes folders that the newest state doesn't name; only while nobody reads or writes."""
        state = self.versions.newest()[1]
        named = {x["folder"].split("/")[1] for x in [*state["segments"], *state["deleted"]]}
        gone = [n for n in self.versions.listed("data") if n not in named]
        self.versions.remove(*[f"data/{n}" for n in gone])
        return len(gone)

    # Reading

    def _read(self, state: dict, part: str) -> DataFrame:
        """A part of all segments with the segment's age in ``at``."""
        tables = [self.spark.read.parquet(f"{self.versions.folder}/{s['folder']}/{part}").withColumn("at", F.lit(s["at"])) for s in state["segments"]]
        return reduce(DataFrame.unionByName, tables)

    def _live(self, state: dict, rows: DataFrame) -> DataFrame:
        if state["deleted"]:
            tombs = [self.spark.read.parquet(f"{self.versions.folder}/{t['folder']}").select("id", F.lit(t["before"]).alias("before")) for t in state["deleted"]]
            tombs = reduce(DataFrame.unionAll, tombs).groupBy("id").agg(F.max("before").alias("before"))
            rows = rows.join(tombs.withColumnRenamed("id", "__gone"), (F.col("id") == F.col("__gone")) & (F.col("at") < F.col("before")), "left_anti")
        return rows.drop("at", "bucket")

    def _documents(self, state: dict) -> DataFrame:
        return self._live(state, self._read(state, "documents")) if state["segments"] else self.spark.createDataFrame([], "id long, length long")

    def _postings(self, state: dict, terms: list[str] | None = None) -> DataFrame:
        """Postings of these terms: only their buckets' folders are read, and of those the row
        groups that may hold the terms."""
        rows = self._read(state, "postings")
        if terms is not None:
            words = self.spark.range(1).select(F.explode(F.array(*map(F.lit, terms))).alias("t"))
            buckets = sorted({r[0] for r in words.select(self._bucket(F.col("t"))).collect()})  # one row a term of the query
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
        return self._live(state, rows)

    def bm25(self, query: str, weights: dict[str, float] | None = None, keep: Column | None = None, n: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(id, score) of documents that hold all terms of the query, best first, as ``lexical.bm25``;
        ``keep`` is over id and the stored columns, which are read only then."""
        state, terms = self.versions.newest()[1], query_words(query)
        if not terms or not state["documents"]:
            return self.spark.createDataFrame([], "id long, score double")
        by_field = [(weights or {}).get(c, 1.0) for c in self.fields]
        frequency = reduce(Column.__add__, [F.lit(float(w)) * F.col(f"f{k}") for k, w in enumerate(by_field)])
        rows = self._postings(state, terms).select("id", "length", "term", frequency.alias("f"))
        found = [F.col("term") == t for t in terms]
        # Of one row: the number of live documents of each term.
        stats = rows.agg(*[F.count(F.when(hit & (F.col("f") > 0), 1)).alias(f"df{k}") for k, hit in enumerate(found)])
        stats = stats.withColumns({"n_docs": F.lit(state["documents"]), "mean": F.lit(state["length"] / state["documents"])})
        hits = rows.groupBy("id", "length").agg(*[F.coalesce(F.max(F.when(hit, F.col("f"))), F.lit(0.0)).alias(f"f{k}") for k, hit in enumerate(found)])
        hits = hits.where(reduce(Column.__and__, [F.col(f"f{k}") > 0 for k in range(len(terms))]))
        if keep is not None:
            hits = hits.join(self._documents(state).where(keep).select("id"), "id", "left_semi")
        scored = hits.crossJoin(F.broadcast(stats)).select("id", F.round(bm25_score(len(terms), k1, b), 6).alias("score"))  # one row
        scored = scored.orderBy(F.desc("score"), "id")
        return scored.limit(n) if n else scored

    def terms(self) -> DataFrame:
        """(bucket, term): all terms of the segments; terms of deleted documents stay until a merge."""
        state = self.versions.newest()[1]
        return self._read(state, "terms").select("bucket", "term").distinct() if state["segments"] else self.spark.createDataFrame([], "bucket int, term string")

    def by_tokens(self, query: str, exact: int = 10, near: int = 3, least: int = 4) -> DataFrame:
        """(id, score): ``exact`` for each token of the query among a document's, ``near`` where one
        of a document's tokens and it contain each other (both of ``least`` characters or more).

        Near tokens are looked for among the terms, not the documents; then only the buckets of
        terms that matched are read, where those are few enough to be sent to all tasks."""
        state, words = self.versions.newest()[1], query_words(query)
        if not words or not state["segments"]:
            return self.spark.createDataFrame([], "id string, score int")
        q, t = F.col("q"), F.col("term")
        inside = (F.length(t) >= least) & (F.length(q) >= least) & (F.contains(t, q) | F.contains(q, t))
        matched = self.terms().select("bucket", "term", F.explode(F.array(*map(F.lit, words))).alias("q"))
        matched = matched.withColumn("points", F.when(t == q, exact).when(inside, near)).where("points is not null")
        rows = self._read(state, "postings").join(matched, ["bucket", "term"])
        rows = self._live(state, rows.select("id", "at", "q", "points"))
        return rows.groupBy("id", "q").agg(F.max("points").alias("points")).groupBy("id").agg(F.sum("points").cast("int").alias("score"))
