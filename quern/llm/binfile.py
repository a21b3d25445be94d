"""Token ids as flat unsigned integer files with 64-bit document offsets.

A table of documents, in ascending id order, becomes shards of three files each:

* ``*.tokens``   ids, little-endian uint16 (vocabularies up to 65,536) or uint32
* ``*.offsets``  little-endian int64, one more than documents; entry k is where document k begins
* ``*.docs``     little-endian int64 document ids, then one byte per document, 1 where the id is null

and a manifest (Parquet) with a row per shard: file names, counts and, from prefix sums over
shards, ``token_base`` and ``doc_base``, which make offsets global. A task writes files under
names of its own attempt and they count only if the manifest lists them, so a lost executor
or a second attempt leaves at most files that nobody reads.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.tokens import encoder, ship
from quern.storage import materialize, new_folder

MANIFEST = "part int, stem string, dtype string, n_docs long, n_tokens long"
SUFFIXES = ("tokens", "offsets", "docs")
END_ID = 0


def _local(url: str) -> str | None:
    """Path of a URL on a mounted file system, else None."""
    parts = urlparse(url)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


@contextmanager
def _sink(url: str) -> Iterator:
    """A binary file that appears under its name only when it is whole."""
    if path := _local(url):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as file:
            yield file
        os.replace(part, path)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(url)
        store.create_dir(os.path.dirname(path))
        with store.open_output_stream(path) as file:
            yield file


@contextmanager
def mapped(url: str, dtype: str) -> Iterator:
    """The file as something to slice: a memory-mapped array on a mounted file system, else
    an object that reads the asked range from the store; nothing is copied to a local disk."""
    if path := _local(url):
        yield np.memmap(path, dtype, "r") if os.path.getsize(path) else np.empty(0, dtype)
    else:
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(url)
        with store.open_input_file(remote) as file:
            yield _Ranges(file, np.dtype(dtype))


class _Ranges:
    """Slices of a remote file of numbers."""

    def __init__(self, file: pa.NativeFile, dtype: np.dtype):
        self.file, self.dtype = file, dtype

    def __len__(self) -> int:
        return self.file.size() // self.dtype.itemsize

    def __getitem__(self, part: slice) -> np.ndarray:
        begin, end, _ = part.indices(len(self))
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(max(0, end - begin) * size, begin * size), self.dtype)


def write_tokens(docs: DataFrame, vocabulary: str, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents and returns the manifest.

    Each document is the ids of its whole text (null: empty) and an end id 0. Null document
    ids come first; rows of one id (or none) are ordered by a hash of their text, which also
    deals them to shards, so that no id makes a shard of its own size; repeated rows are
    written repeated; an empty table gives no shard. Only the two named columns are read.
    """
    folder, name = folder or new_folder(docs.sparkSession, "tokens"), ship(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, enc = TaskContext.get(), encoder(name)
        dtype = "<u2" if enc.vocabulary_size <= 1 << 16 else "<u4"
        end = np.array([END_ID], dtype).tobytes()
        stem = f"{folder}/shard-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        ids: list[int | None] = []
        offsets = [0]
        with _sink(f"{stem}.tokens") as file:
            for batch in batches:
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    tokens = np.frombuffer(enc.encode(text), "<u4")
                    file.write(tokens.astype(dtype).tobytes() + end)
                    ids.append(key)
                    offsets.append(offsets[-1] + len(tokens) + 1)
        with _sink(f"{stem}.offsets") as file:
            file.write(np.array(offsets, "<i8").tobytes())
        with _sink(f"{stem}.docs") as file:
            file.write(np.array([x or 0 for x in ids], "<i8").tobytes() + bytes(x is None for x in ids))
        if ids:
            row = [[context.partitionId()], [stem], [dtype], [len(ids)], [offsets[-1]]]
            yield pa.RecordBatch.from_pydict({c.split()[0]: v for c, v in zip(MANIFEST.split(", "), row)}, schema=SHARD)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange("id", "mark").sortWithinPartitions("id", "mark")
    shards = materialize(rows.mapInArrow(run, MANIFEST), "manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    return shards.select(
        "*", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("token_base"), F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base")
    )


SHARD = pa.schema([("part", pa.int32()), ("stem", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


#: Documents and ids that a reading task holds at once (a longer document is held whole).
SLICE_DOCS, SLICE_IDS = 20_000, 4_000_000


def read_tokens(manifest: DataFrame, tasks: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, from the memory-mapped files.

    start counts the ids of all documents before it; the crc32 is that of its ids as
    little-endian unsigned 32-bit integers, end id included. Shards are dealt to as many
    tasks as there are shards, unless ``tasks`` says otherwise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _documents(row)

    # A number that is given is kept: adaptive execution would put the few bytes of a manifest into one task.
    n = tasks or max(1, manifest.count())
    return manifest.repartition(n, F.xxhash64("part")).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _documents(row: dict) -> Iterator[pa.RecordBatch]:
    n, stem = row["n_docs"], row["stem"]
    with mapped(f"{stem}.offsets", "<i8") as offsets, mapped(f"{stem}.docs", "u1") as docs, mapped(f"{stem}.tokens", row["dtype"]) as tokens:
        at = 0
        while at < n:
            ends = np.array(offsets[at : min(n, at + SLICE_DOCS) + 1])
            count = max(1, int(np.searchsorted(ends, ends[0] + SLICE_IDS, "right")) - 1)
            ends = ends[: count + 1]
            held = tokens[int(ends[0]) : int(ends[-1])]
            place = (ends - ends[0]).tolist()
            crcs = [zlib.crc32(held[a:b].astype("<u4").tobytes()) for a, b in zip(place, place[1:])]
            ids = np.array(docs[8 * at : 8 * (at + count)]).view("<i8")
            null = np.array(docs[8 * n + at : 8 * n + at + count], bool)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=null), pa.array(ends[:-1] + row["token_base"]), pa.array(np.diff(ends)), pa.array(crcs, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )
            at += count
