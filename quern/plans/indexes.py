"""Indexes over the input tables, made once per application and folder of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators.index import TextIndex
from quern.operators.vector_index import VectorIndex
from quern.plans.roles import files, texts
from quern.session import load
from quern.storage import new_folder

#: Fields of the documents' index and their weights.
FIELDS = {"text": 2.0, "source": 1.0}
_made: dict[tuple, object] = {}


def kept(spark, d: str, kind: str, make):
    """An index of this application over a folder of tables, made at its first use."""
    key = (spark.sparkContext.applicationId, d, kind)
    index = _made.get(key)
    if index is None or not index.versions.numbers():
        index = _made[key] = make()
    return index


def text_index(spark, d: str) -> TextIndex:
    """All documents by text and source; the source is stored."""
    def make() -> TextIndex:
        index = TextIndex(spark, new_folder(spark, "text-index"), list(FIELDS), ["source"])
        index.add(texts(spark, d))
        return index

    return kept(spark, d, "texts", make)


def path_index(spark, d: str) -> TextIndex:
    """All files by their paths."""
    def make() -> TextIndex:
        index = TextIndex(spark, new_folder(spark, "path-index"), ["path"])
        index.add(files(spark, d).select(F.col("path").alias("id"), "path"))
        return index

    return kept(spark, d, "paths", make)


def vector_index(spark, d: str) -> VectorIndex:
    """All embeddings by their ids."""
    def make() -> VectorIndex:
        vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return VectorIndex(spark, new_folder(spark, "vector-index")).build(vectors)

    return kept(spark, d, "vectors", make)
