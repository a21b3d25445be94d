"""Token counts as delta-maintained rollups.

Changes are signed: an insert adds a document's count, a delete takes it away, a revision
does both. A batch is summed to one row per source, language and tokenizer version and
written to a folder of its own; it counts once a marker file named after the batch id says
which folder that is. The marker appears whole and by one atomic step that fails where the
name is taken, so a batch id commits once, whoever else writes and whenever a writer dies.
"""

from __future__ import annotations

import base64
import json
import os
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.tokens import local_path, ship
from quern.llm.workers import lean
from quern.storage import delete, new_folder

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


#: The cutting pattern that these vocabularies were made for: a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=8)
def _encoding(vocabulary: str):
    """The worker's encoder for a shipped file of ranks; workers are reused between tasks."""
    import tiktoken

    with open(local_path(vocabulary), "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, vocabularies: list[str], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, *keep, digest, counts): tokens of each whole text under each file of ranks, in order.

    Null and empty texts have no tokens; digest is the md5 of the text, null as empty. One row
    per row of ``docs``; other columns are not read."""
    names = [ship(docs.sparkSession, v) for v in vocabularies]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *[F.col(c).cast("string").alias(c) for c in keep], F.md5(text).alias("digest"), text.alias("__text"))
    passed = ["id", *keep, "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = [_encoding(n).encode_ordinary for n in names]
        for batch in batches:
            counts = [[len(e(t)) for e in encode] for t in batch.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*map(batch.column, passed), pa.array(counts, pa.list_(pa.int64()))], names=[*passed, "counts"])

    return rows.mapInArrow(lean(run), ", ".join(["id long", *(f"{c} string" for c in keep), "digest string", "counts array<long>"]))


def inserted(counts: DataFrame) -> DataFrame:
    """Signed changes for new documents; ``counts`` has the keys and ``n_tokens``."""
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deleted(counts: DataFrame) -> DataFrame:
    """Signed changes for documents that go; ``counts`` has what was added for them."""
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens").cast("long")).alias("n_tokens"))


def revised(counts: DataFrame) -> DataFrame:
    """Signed changes for documents counted anew: the keys, ``n_tokens`` and ``new_tokens``."""
    return counts.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col("new_tokens") - F.col("n_tokens")).cast("long").alias("n_tokens"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum(F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))


class Ledger:
    """Committed batches of summed changes in the shared folder.

    ``batches/<id>`` is a marker that holds the name of the batch's folder in ``data``;
    ``snapshots/<n>`` names a folder and the batches that are summed in it. Folders that no
    marker names don't count: a writer that dies, or loses a race, leaves only those.

    Nulls in a key are a value of their own. A null count counts as 0 tokens. Empty batches
    commit as empty; batch ids are any strings. Totals leave out keys whose documents and
    tokens have both come back to 0."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "token-counts")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path().getFileSystem(self._conf)

    def _path(self, *parts: str):
        return self._paths.Path("/".join((self.folder, *parts)))

    def _name(self, batch_id: str) -> str:
        return "id-" + "".join(c if c.isascii() and (c.isalnum() or c in "-") else f"_{ord(c):x}_" for c in str(batch_id))

    def _listed(self, kind: str) -> list[str]:
        path = self._path(kind)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _read(self, *parts: str) -> str:
        stream = self._fs.open(self._path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _publish(self, text: str, *parts: str) -> bool:
        """The file with this text, at once and whole; False if there is one of that name."""
        draft, target = self._path("drafts", uuid.uuid4().hex), self._path(*parts)
        self._fs.mkdirs(target.getParent())
        stream = self._fs.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self._fs.getUri().getScheme() == "file":  # whose rename checks and moves in two steps
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            context = self._paths.FileContext.getFileContext(self._fs.getUri(), self._conf)
            option = self.spark.sparkContext._gateway.new_array(getattr(self._paths, "Options$Rename"), 1)
            option[0] = getattr(self._paths, "Options$Rename").NONE
            context.rename(draft, target, option)
            return True
        except Exception:
            if not self._fs.exists(target):
                raise
            return False
        finally:
            self._fs.delete(draft, False)

    def committed(self, batch_id: str) -> bool:
        return self._fs.exists(self._path("batches", self._name(batch_id)))

    def commit(self, batch_id: str, *changes: DataFrame) -> bool:
        """Sums the changes and commits them under the id; False if it was committed before.

        Of writers with one id that race, one publishes its marker; the others' work is dropped."""
        if self.committed(batch_id):
            return False
        name = uuid.uuid4().hex
        data = f"{self.folder}/data/{name}"
        _summed(reduce(DataFrame.unionAll, changes)).write.parquet(data)
        if self._publish(name, "batches", self._name(batch_id)):
            return True
        delete(self.spark, data)
        return False

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the newest snapshot, the batches in it, and the folders that count."""
        numbers = [int(n) for n in self._listed("snapshots")]
        snapshot = json.loads(self._read("snapshots", f"{max(numbers):012d}")) if numbers else {"batches": [], "data": []}
        inside = set(snapshot["batches"])
        later = [n for n in self._listed("batches") if n not in inside]
        return max(numbers, default=0), [*snapshot["batches"], *later], [*snapshot["data"], *(self._read("batches", n) for n in later)]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        return self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/data/{n}" for n in folders])

    def compact(self) -> bool:
        """Sums all batches committed so far into one folder; False if another compaction won.

        Totals don't change, and batches committed meanwhile count beside the snapshot."""
        number, batches, folders = self._state()
        name = uuid.uuid4().hex
        _summed(self._rows(folders)).write.parquet(f"{self.folder}/data/{name}")
        return self._publish(json.dumps({"batches": batches, "data": [name]}), "snapshots", f"{number + 1:012d}")

    def vacuum(self) -> int:
        """Removes folders that no longer count and returns their number. Only while nobody
        reads or commits: a batch that is being written isn't named by a marker yet."""
        counted = set(self._state()[2])
        gone = [n for n in self._listed("data") if n not in counted]
        for n in gone:
            delete(self.spark, f"{self.folder}/data/{n}")
        return len(gone)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) over all committed batches."""
        return _summed(self._rows(self._state()[2])).where("n_docs <> 0 or n_tokens <> 0")
