"""A training corpus from documents: quality, near-duplicates, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import jaccard, mixing, packing, quality
from quern.llm.queries import vocabulary
from quern.session import load, small_batches
from quern.storage import materialize, new_folder

#: The stages hold a trained classifier and a random mixture: SQL can't express them.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from ``labels``."""
    small_batches(spark)
    return quality.keep_good(docs, quality.fit_on(docs, load(spark, sf_dir, "labels")))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by op9's 2 bits or by five-word Jaccard similarity >= 0.8.

    It is the one with the smallest id, rows without an id coming last. Rows are told by id
    and text, so different texts that repeat an id, or have none, stand for themselves; of
    rows equal in both, one stays."""
    small_batches(spark)
    kept = materialize(jaccard.kept_rows(jaccard.near_groups(docs)), "kept")
    names = ["no_id", "id", *jaccard.TEXT_KEY]
    text = F.col("text").cast("string")
    known = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("no_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), *jaccard.text_key(text))
    alone = known.join(kept.where("n = 1"), names, "left_semi").select("row.*")
    # Rows that are equal in id and text: summed up before they are dealt, as they may be very many.
    equal = known.join(kept.where("n > 1"), names, "left_semi").groupBy(*names).agg(F.max_by("row", _digest("row", docs)).alias("row")).select("row.*")
    return alone.unionByName(equal)


def _digest(row: str, docs: DataFrame):
    """A hash of a row's plain columns."""
    plain = [f.name for f in docs.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(*[F.col(row)[c] for c in plain])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    A row's key is a hash of its columns: the mix draws by it, so that reruns agree whatever
    the files' layout, and its copies find their row by it. Rows that are equal in all columns
    are summed up and share what is taken of them."""
    small_batches(spark)
    whole = docs.select(F.struct("*").alias("row"))
    keyed = whole.withColumn("__key", _digest("row", docs))
    mixed = mixing.mix(keyed.select(F.col("__key"), F.col("row.text").alias("text"), F.col("row.source").alias("source")), "__key")
    taken = mixed.groupBy(F.col("id").alias("__key")).agg(F.count("*").alias("n"), F.sum("copies").alias("times"))
    taken = materialize(taken.where("times > 0"), "taken")
    alone = keyed.join(taken.where("n = 1"), "__key").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__k"))
    equal = keyed.join(taken.where("n > 1"), "__key").groupBy("__key", F.col("row.doc_id").alias("__id"))
    equal = equal.agg(F.count("*").alias("m"), F.max("n").alias("n"), F.max("times").alias("times"), F.first("row").alias("row"))
    share = F.round(F.col("times") * F.col("m") / F.col("n")).cast("long")  # all, unless two rows' hashes collide
    step = F.lit(10_000).cast("long")
    parts = equal.withColumn("share", share).where("share > 0").withColumn("begin", F.explode(F.sequence(F.lit(1).cast("long"), F.col("share"), step)))
    equal = parts.select("row", F.explode(F.sequence(F.col("begin"), F.least(F.col("begin") + step - 1, F.col("share")))).alias("__k"))
    return alone.unionAll(equal).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens; (part, doc_key) tells a document's copies apart."""
    small_batches(spark)
    pieces = packing.pack(docs, vocabulary())
    return packing.number(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).drop("local_sequence")


STAGES = [
    ("quality_classifier", good_quality),
    ("simhash_near_dedup", no_near_copies),
    ("source_mixing", mixture),
    ("sequence_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.parquet(f"{root}/{k}-{name}")
    return docs
