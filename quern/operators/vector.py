"""Vectors: deterministic embeddings, cosine search, re-ranking and redundancy."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text
from quern.storage import materialize, new_folder


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero or lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def similarity(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine(a, b), F.lit(0.0))))


def nearest(vectors: DataFrame, query: list[float], k: int = 10, least: float = 0.0, vec: str = "embedding") -> DataFrame:
    """(id, similarity) of the k nearest to one query vector, which travels as a literal."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select("id", F.round(similarity(F.col(vec), q), 6).alias("similarity"))
    return scored.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "id").limit(k)


#: Bytes of queries that every task gets at once; more are searched in several passes.
QUERY_BYTES = 64 << 20


def nearest_per_query(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, id, similarity, rank): exact k nearest for a stated set of queries.

    ``queries`` (query_id, embedding) go to every task in blocks of ``QUERY_BYTES``, a pass over
    the vectors for each. Each batch keeps its k best per query, and those meet by query."""
    schema = "query_id long, id long, similarity double"
    found, ids, rows, held = [], [], [], 0

    def search() -> DataFrame:
        shared = vectors.sparkSession.sparkContext.broadcast((np.array(ids), _unit(np.array(rows, np.float64))))

        def best(batches):
            ids, q = shared.value
            for pdf in batches:
                pdf = pdf[pdf["embedding"].notna()]
                if not len(pdf):
                    continue
                v, key = _unit(np.array(pdf["embedding"].tolist(), np.float64)), pdf["id"].to_numpy()
                tops, sims = [], []
                for a in range(0, len(q), 256):
                    sim = np.clip(q[a : a + 256] @ v.T, 0, 1).round(6)
                    top = np.lexsort((np.broadcast_to(key, sim.shape), -sim), axis=1)[:, :k]
                    tops.append(key[top])
                    sims.append(np.take_along_axis(sim, top, 1))
                tops, sims = np.concatenate(tops), np.concatenate(sims)
                yield pd.DataFrame({"query_id": np.repeat(ids, tops.shape[1]), "id": tops.reshape(-1), "similarity": sims.reshape(-1)})

        return vectors.select("id", "embedding").mapInPandas(best, schema)

    for r in queries.where("embedding is not null").select("query_id", "embedding").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        held += 8 * len(r[1])
        if held >= QUERY_BYTES:
            found.append(search())
            ids, rows, held = [], [], 0
    if ids:
        found.append(search())
    found = reduce(DataFrame.unionAll, found) if found else vectors.sparkSession.createDataFrame([], schema)
    place = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def _unit(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def hashed_cells(docs: DataFrame, dim: int = 384, column: str = "text") -> DataFrame:
    """(id, place, v): a count sketch of tokens (letters, digits, '_'). The first eight bytes
    of a token's sha256, little-endian, give its place modulo dim and, by bit 16, its sign;
    v is the sum of signs, 0 at place 0 for texts without tokens.
    Built-in functions only; one small group per document."""
    low = F.lower(F.coalesce(F.col(column), F.lit("")))
    # Dealt by document once: all groupings below hold the id, so none of them exchanges rows.
    listed = docs.select("id", F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)).alias("t")).repartition("id")
    tokens = listed.select("id", F.explode_outer("t").alias("token")).groupBy("id", "token").agg(F.count("*").alias("n"))
    tokens = tokens.withColumn("h", F.sha2("token", 256))

    def number(first: int) -> Column:
        """Four bytes of the digest, the last one first, as a number."""
        return F.conv(F.concat(*[F.substring("h", 2 * k + 1, 2) for k in reversed(range(first, first + 4))]), 16, 10).cast("long")

    place = F.pmod(F.pmod(number(4), F.lit(dim)) * ((1 << 32) % dim) + F.pmod(number(0), F.lit(dim)), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring("h", 6, 1), 16, 10).cast("int") % 2 == 0, F.col("n")).otherwise(-F.col("n"))
    cells = tokens.select("id", place.alias("place"), F.when(F.col("token").isNotNull(), sign).otherwise(0).alias("v"))
    return cells.groupBy("id", F.coalesce("place", F.lit(0)).alias("place")).agg(F.sum("v").alias("v"))


def hashed_values(docs: DataFrame, dim: int = 384, column: str = "text") -> DataFrame:
    """(id, place, value): the cells of ``hashed_embedding`` that are not zero, in double precision.
    Texts without tokens, or whose signs cancel out, have none."""
    cells = hashed_cells(docs, dim, column).where("v <> 0")
    per_doc = cells.groupBy("id").agg(F.collect_list(F.struct("place", "v")).alias("cells"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    return per_doc.select("id", "norm", F.inline("cells")).select("id", "place", (F.col("v") / F.col("norm")).alias("value"))


def hashed_embedding(docs: DataFrame, dim: int = 384, column: str = "text") -> DataFrame:
    """(id, embedding): the count sketch of ``hashed_cells``, dense and of unit length. Texts
    without tokens, or whose signs cancel out, are the first axis."""
    @F.pandas_udf("array<float>")
    def dense(places: pd.Series, sums: pd.Series) -> pd.Series:
        out = []
        for at, v in zip(places, sums):
            x = np.zeros(dim)
            x[at] = v
            norm = np.sqrt((x * x).sum())
            out.append((x / norm if norm > 0 else np.eye(1, dim)[0]).astype(np.float32))
        return pd.Series(out)

    cells = F.collect_list(F.struct("place", "v"))
    per_doc = hashed_cells(docs, dim, column).groupBy("id").agg(cells.alias("cells"))
    return per_doc.select("id", dense(F.col("cells.place"), F.col("cells.v")).alias("embedding"))


def diversify(candidates: DataFrame, by: str | None = None, most: float = 0.88) -> DataFrame:
    """Greedy redundancy filter of ranked candidates (rank, id, cosine, rerank, embedding):
    one whose cosine to a kept one is above ``most`` goes; score = 0.60 cosine + 0.40 rerank.

    Order matters, so each group of candidates (a query's, at most some hundred) is one fold."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "id"])
        unit, kept = _unit(np.array(pdf["embedding"].tolist(), np.float64)), []
        for k in range(len(pdf)):
            if not kept or (unit[kept] @ unit[k]).max() <= most:
                kept.append(k)
        out = pdf.iloc[kept]
        return pd.DataFrame({"group": out["group"], "id": out["id"], "score": (0.60 * out["cosine"] + 0.40 * out["rerank"]).round(6)})

    rows = candidates.withColumn("group", F.col(by) if by else F.lit(0).cast("long"))
    return rows.groupBy("group").applyInPandas(fold, "group long, id long, score double")


def redundant(vectors: DataFrame, least: float = 0.90) -> DataFrame:
    """(id, kept_id): greedy removal by id order: a vector whose cosine to an earlier kept one is
    ``least`` or more goes, and names the first such one. Ids are unique; rows with a null id or
    vector are left out.

    Near pairs come from a vector index by exact bounds. Who is kept is settled in rounds, one
    row a pair: a vector is kept once all earlier ones near it have gone, and goes once one of
    them is kept."""
    from quern.operators.vector_index import VectorIndex

    spark = vectors.sparkSession
    rows = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    index = VectorIndex(spark, new_folder(spark, "vector-index")).build(rows)
    pairs = index.within(rows.withColumnRenamed("id", "query_id"), least).where("id < query_id")
    open_ = materialize(pairs.select(F.col("query_id").alias("id"), F.col("id").alias("before")), "near")
    near, gone = open_, []
    while not open_.isEmpty():
        waiting = open_.select("id").distinct()
        # Earlier ones that wait for none are kept; whoever is near them goes.
        free = open_.join(waiting.withColumnRenamed("id", "before"), "before", "left_anti").select("id").distinct()
        gone.append(materialize(free, "gone"))
        later = open_.join(gone[-1], "id", "left_anti").join(gone[-1].withColumnRenamed("id", "before"), "before", "left_anti")
        open_ = materialize(later.select("id", "before"), "near")
    out = reduce(DataFrame.unionAll, gone) if gone else near.select("id").limit(0)
    kept = near.join(out, "id").join(out.withColumnRenamed("id", "before"), "before", "left_anti")
    return kept.groupBy("id").agg(F.min("before").alias("kept_id"))


BOUNDARY = 1e-5


def path_points(paths: DataFrame, dim: int = 16) -> DataFrame:
    """(path, point): a point of the Poincare ball per path. Each segment's XXH64 (seed 0) names
    two axes and two signs of a step whose length grows with depth; steps are added in the
    ball. Spark's own xxhash64 has another seed, hence the Arrow function."""
    import xxhash

    def inside(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x)
        return x * ((1 - BOUNDARY) / norm) if norm >= 1 - BOUNDARY else x

    def moved(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        uv, uu, vv = u @ v, u @ u, v @ v
        return inside(((1 + 2 * uv + vv) * u + (1 - uu) * v) / max(1 + 2 * uv + uu * vv, 1e-8))

    def point(path: str | None) -> list[float]:
        at = np.zeros(dim)
        segments = [s for s in (path or "").replace("\\", "/").split("/") if s not in ("", ".")]
        for depth, segment in enumerate(segments, 1):
            h = xxhash.xxh64_intdigest(segment.encode(), 0)
            size, step = np.tanh(0.35 * depth) * 0.45 / np.sqrt(2), np.zeros(dim)
            step[h % dim] += -size if h & 1 else size
            step[(h >> 16) % dim] += -size if h & 2 else size
            at = moved(at, inside(step))
        return at.tolist()

    @F.pandas_udf("array<double>")
    def points(s: pd.Series) -> pd.Series:
        return s.map(point)

    return paths.select("path", points("path").alias("point"))


def poincare_distance(a: Column, b: Column) -> Column:
    diff = F.zip_with(a, b, lambda x, y: x - y)
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * dot(diff, diff) / ((1 - dot(a, a)) * (1 - dot(b, b)))))
