"""Quality classifier: random-indexing word vectors and a two-layer network in numpy.

Every word gets a sparse random index vector, drawn from a seed by its hash bucket. A word's
vector is its index vector plus those of the words that stand near it in the fitting sample.
A document is the mean of its words' vectors beside the mean of its word shapes' vectors
("Aa", "A!", "a*"; a word that repeats the one before it has a shape of its own). A network
with one hidden layer maps that to a logit; a temperature fitted on labelled rows apart from
the network's own makes probabilities of it.

Fitting reads a bounded sample of labelled rows (``most_rows``, ``most_bytes``), drawn at the
labels' own shares at every size; scoring reads every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.workers import lean
from quern.storage import materialize

BUCKETS = 1 << 15
SHAPES = 1 << 10
WIDTH = 32
NONZERO = 4
REACH = 2
MOST_ROWS = 6_000
#: Bytes of sampled texts that the driver holds at most.
MOST_BYTES = 64 << 20
MOST_WORDS = 200_000
_RUN = re.compile(r"(.)\1+", re.S)


def shape(word: str) -> str:
    """Runs of capitals, small letters, digits and any other character, each written once."""
    kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word]
    return _RUN.sub(r"\1", "".join(kinds))


class _Codes(dict):
    """Word to bucket * SHAPES + shape; bounded, later words are worked out anew."""

    def __missing__(self, word: str) -> int:
        letters = "".join(c for c in word if c.isalnum()).lower() or word
        bucket = zlib.crc32(letters.encode("utf-8", "surrogatepass")) % BUCKETS
        form = 1 + zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % (SHAPES - 1)
        code = bucket * SHAPES + form
        if len(self) < MOST_WORDS and len(word) < 64:
            self[word] = code
        return code


_codes = _Codes()


def codes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and shape of each white-space separated word; shape 0 repeats the word before."""
    words = (text or "").split()
    code = np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))
    bucket, form = (code // SHAPES).astype(np.int32), (code % SHAPES).astype(np.int32)
    form[1:][code[1:] == code[:-1]] = 0
    return bucket, form


def index_vectors(rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse random vectors: for each row ``NONZERO`` places and their signs, +1 or -1."""
    rng = np.random.default_rng(seed)
    places = rng.random((rows, WIDTH)).argsort(axis=1)[:, :NONZERO]
    return places, rng.choice(np.array([-1.0, 1.0]), (rows, NONZERO))


def context_vectors(streams: list[np.ndarray], index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Index vectors plus the mean index vector of the neighbours seen within ``REACH`` words."""
    places, signs = index
    rows = len(places)
    total, seen = np.zeros(rows * WIDTH), np.zeros(rows)
    part: list[np.ndarray] = []
    for k, stream in enumerate(streams, 1):
        part.append(stream)
        if k < len(streams) and sum(map(len, part)) < 200_000:
            continue
        words = np.concatenate(part)
        text = np.repeat(np.arange(len(part)), [len(s) for s in part])
        part = []
        for reach in range(1, REACH + 1):
            same = text[:-reach] == text[reach:]
            left, right = words[:-reach][same], words[reach:][same]
            for word, neighbour in ((left, right), (right, left)):
                seen += np.bincount(word, minlength=rows)
                for j in range(NONZERO):
                    total += np.bincount(word * WIDTH + places[neighbour, j], signs[neighbour, j], rows * WIDTH)
    own = np.zeros((rows, WIDTH))
    np.put_along_axis(own, places, signs, 1)
    return (own + total.reshape(rows, WIDTH) / np.maximum(seen, 1)[:, None]).astype(np.float32)


@dataclass
class Model:
    """The fitted classifier; its size doesn't depend on the data (about 4 MB)."""

    words: np.ndarray
    shapes: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def pool(self, texts: list[str | None]) -> np.ndarray:
        return pool(texts, self.words, self.shapes)

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        hidden = np.tanh((pooled - self.centre) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that the label is 1."""
        return 1 / (1 + np.exp(-np.clip(self.logits(self.pool(texts)) / self.temperature, -40, 40)))


def pool(texts: list[str | None], words: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Mean word vector, mean shape vector, share of repeats and log length per text; empty texts: zeros."""
    out = np.zeros((len(texts), 2 * WIDTH + 2))
    for k, text in enumerate(texts):
        bucket, form = codes(text)
        if n := len(bucket):
            total = np.zeros(WIDTH)
            for a in range(0, n, 4096):
                total += words[bucket[a : a + 4096]].sum(axis=0)
            out[k, :WIDTH] = total / n
            kinds = np.bincount(form, minlength=SHAPES)
            out[k, WIDTH : 2 * WIDTH] = kinds @ shapes / n
            out[k, 2 * WIDTH] = kinds[0] / n
            out[k, 2 * WIDTH + 1] = np.log1p(n)
    return out


def fit(texts: list[str | None], labels: list[int], seed: int = 11, hidden: int = 24, epochs: int = 60) -> Model:
    """Fits vectors and network on four fifths of the rows and the temperature on the rest.

    Without rows of both labels the score is the share of label 1 (no rows: 0.5)."""
    y = np.array(labels, float)
    word_index, shape_index = index_vectors(BUCKETS, seed), index_vectors(SHAPES, seed + 1)
    streams = [codes(t) for t in texts]
    words = context_vectors([b for b, _ in streams], word_index)
    shapes = context_vectors([f for _, f in streams], shape_index)
    x = pool(texts, words, shapes)
    centre = x.mean(axis=0) if len(x) else np.zeros(2 * WIDTH + 2)
    scale = np.maximum(x.std(axis=0), 1e-3) if len(x) else np.ones(2 * WIDTH + 2)
    rng = np.random.default_rng(seed)
    w1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden))
    model = Model(words, shapes, centre, scale, w1, np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), 0.0, 1.0)
    if not len(y) or y.min() == y.max():
        model.w2[:] = 0
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        model.b2 = float(np.log(share / (1 - share)))
        return model
    order = rng.permutation(len(y))
    held, rows = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - centre) / scale
    params = [model.w1, model.b1, model.w2, np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // 64)):
            h = np.tanh(z[batch] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40))) - y[batch]) / len(batch)
            back = error[:, None] * params[2] * (1 - h * h)
            grads = [z[batch].T @ back + 1e-4 * params[0], back.sum(0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.005 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.b2 = float(params[3][0])
    if len(held):
        logits, truth = model.logits(x[held]), y[held]
        tries = np.exp(np.linspace(-1.5, 2.5, 161))
        losses = [np.mean(np.logaddexp(0, logits / t) - truth * logits / t) for t in tries]
        model.temperature = float(tries[int(np.argmin(losses))])
    return model


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3; ids of remainder 1 are held out."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def fit_on(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES) -> Model:
    """A model from at most ``most_rows`` labelled rows outside the held-out fold; which ones,
    a hash of the id decides, so that labels keep their shares whatever the table's size.

    Whole texts are taken in the hash's order while they fit in ``most_bytes``; a text that
    alone passes a quarter of that is left out. Labels that are null or contradict each other
    on one id are not used."""
    known = labels.where(f"{id_col} is not null and quality is not null").groupBy(id_col).agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    known = known.where("low = high").where(fold(id_col) != 1).select(F.col(id_col).alias("label_id"), F.col("low").alias("quality"))
    picked = known.withColumn("order", F.xxhash64("label_id")).orderBy("order", "label_id").limit(most_rows)
    # Bounded by most_rows: ids to the executors, texts to a small table.
    rows = docs.select(F.col(id_col).cast("long").alias("label_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.join(F.broadcast(picked), "label_id").groupBy("label_id", "quality", "order").agg(F.min("text").alias("text"))
    rows = materialize(rows.withColumn("bytes", F.coalesce(F.octet_length("text"), F.lit(0))), "labelled")
    sizes = sorted((r["order"], r["label_id"], r["bytes"]) for r in rows.select("order", "label_id", "bytes").collect())
    total, used = 0, []
    for _, key, n in sizes:
        if n <= most_bytes // 4:
            total += n
            if total > most_bytes:
                break
            used.append(key)
    wanted = set(used)
    some = rows if len(used) == len(sizes) else rows.where(F.col("label_id").isin(used))  # most_rows at most
    sample = sorted((r for r in some.collect() if r["label_id"] in wanted), key=lambda r: r["label_id"])
    return fit([r["text"] for r in sample], [r["quality"] for r in sample])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``.

    Null and empty texts get the score of a document without words; a null id is not held
    out; repeated rows get equal scores; only the id and text columns are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = shared.value.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], names=["doc_id", "held_out", "score"])
        _codes.clear()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(fold(id_col) == 1, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(lean(run), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.score(batch.column(text_col).to_pylist()) >= least))
        _codes.clear()

    return docs.mapInArrow(lean(run), docs.schema)
