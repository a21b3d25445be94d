"""Collocations: phrases that hold together, mined by sorting suffixes.

Every word of a piece starts a suffix, cut after ``max_n`` words. Suffixes are shuffled by
language and first word and sorted in reverse lexicographic order, so that all suffixes that
begin with the same words stand together and one stack counts every prefix: the open prefixes
of the newest suffix, each with the count so far. Equal suffixes of about a million words are
added up before the shuffle.

Two things are known from a count of single words before: words below the least frequency,
which can be in no candidate, end a suffix (a Bloom filter of bounded size tells them; what it
lets through costs rows, not results), and the few words above a share of all words get a
second, third and fourth word into the shuffle key, as long as all before are such words. The
counts of prefixes that consist of such words alone come from several tasks and are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.bits import bit_array, is_set
from quern.llm.workers import lean
from quern.storage import materialize

#: Words whose equal suffixes are added up at once, and their bytes (both may be passed by one text).
CHUNK = 1 << 20
CHUNK_BYTES = 64 << 20
#: Words of the corpus to a task that counts prefixes.
TASK_WORDS = 2_000_000
#: Suffixes that the stack takes at once, and shuffle keys of a chunk that are sent at once.
ROWS = 1 << 15
GROUPS = 1 << 12
#: Bits of the filter of frequent words at most (64 MB), and per word below that.
MOST_BITS = 1 << 29
BITS = 16
#: A word that is more than one in ``SHARE`` of all words, and more than ``LEAST_HOT``, lengthens the
#: shuffle key; there are fewer than ``SHARE`` such words.
SHARE = 2_000
LEAST_HOT = 10_000

_PIECES, _SPACES = b".,;:!?\n\x0b\x0c\r", b"\t"
_TABLE = bytes.maketrans(_PIECES + _SPACES + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"," * len(_PIECES) + b" " + b"abcdefghijklmnopqrstuvwxyz")


class _Ids(dict):
    """Words numbered as they come; 0 ends a piece."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return self[word]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, list[str]]]:
    """(words by id, ids, language of each, languages) of about ``CHUNK`` words of whole texts.

    A-Z are lower-cased; ids of 0 stand between pieces, and after each text."""
    ids, langs, parts, kinds, seen, size = _Ids({b",": 0}), {}, [], [], 0, 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text.translate(_TABLE).replace(b",", b" , ").split()
            words.append(b",")
            parts.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
            kinds.append(langs.setdefault(lang, len(langs)))
            seen, size = seen + len(words), size + len(text)
            if seen >= CHUNK or size >= CHUNK_BYTES:
                yield list(ids), np.concatenate(parts), np.repeat(kinds, [len(p) for p in parts]), list(langs)
                ids, langs, parts, kinds, seen, size = _Ids({b",": 0}), {}, [], [], 0, 0
    if parts:
        yield list(ids), np.concatenate(parts), np.repeat(kinds, [len(p) for p in parts]), list(langs)


def _begins(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows of the sorted columns differ from the row before."""
    fresh = np.ones(len(sorted_columns[0]), bool)
    if len(fresh):
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(fresh)


def _named(words: list[bytes], langs: list[str], word: np.ndarray, lang: np.ndarray) -> list[bytes]:
    """Words with their language behind a line feed, which no word holds."""
    ends = [b"\n" + x.encode() for x in langs]
    return [words[w] + ends[k] for w, k in zip(word.tolist(), lang.tolist())]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for words, ids, lang, langs in _chunks(batches):
        size = len(words)
        key, n = np.unique(lang[ids > 0] * size + ids[ids > 0], return_counts=True)
        for a in range(0, len(key), ROWS):
            k = key[a : a + ROWS]
            first = pa.array(_named(words, langs, k % size, k // size), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([first, pa.array(n[a : a + ROWS])], names=["first", "n"])


def _bloom_places(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes & np.uint64(size - 1), (hashes >> np.uint64(32)) & np.uint64(size - 1)


def _suffixes(max_n: int, frequent, hot):
    """Distinct suffixes of a chunk and their number, in a row for each first word (or longer key):
    a line has the other words, each and a space behind it (empty where the suffix has ended), and the number."""
    from xxhash import xxh64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, often = frequent.value, hot.value
        for words, ids, lang, langs in _chunks(batches):
            order = sorted(range(1, len(words)), key=words.__getitem__)
            words = [b"", *[words[k] for k in order]]
            rank = np.zeros(len(words), np.int64)
            rank[order] = np.arange(1, len(words))
            ids = rank[ids]
            # A word may be frequent in one language only.
            pair, at = np.unique(lang * len(words) + ids, return_inverse=True)
            names = _named(words, langs, pair % len(words), pair // len(words))
            one, two = _bloom_places(np.fromiter((xxh64_intdigest(x, seed=42) for x in names), np.uint64, len(names)), len(bits) * 64)
            keep = is_set(bits, one) & is_set(bits, two) & (pair % len(words) > 0)
            is_hot = np.fromiter((x in often for x in names), bool, len(names)) & keep
            here, is_hot = np.where(keep[at], ids, 0), is_hot[at]
            columns = [here]
            depth, all_hot = np.ones(len(ids), np.int64), is_hot
            for k in range(1, max_n):
                after = np.zeros_like(here)
                after[:-k] = here[k:]
                columns.append(np.where(columns[-1] > 0, after, 0))
                depth += all_hot
                later = np.zeros_like(all_hot)
                later[:-k] = is_hot[k:]
                all_hot = all_hot & later
            at = np.flatnonzero(here)
            sort = at[np.lexsort([*[c[at] for c in columns[::-1]], lang[at]])]
            columns = [c[sort] for c in columns]
            begins = _begins(lang[sort], *columns)
            n, depth = np.diff(np.append(begins, len(sort))), depth[sort[begins]]
            columns, lang = [c[begins] for c in columns], lang[sort[begins]]
            # A row for each shuffle key: its suffixes in lines.
            ahead = [np.where(depth > k, c, 0) for k, c in enumerate(columns)]
            edges = np.append(_begins(lang, *ahead), len(n))
            vocabulary = pa.array(words, pa.binary()).cast(pa.string())
            for a in range(0, len(edges) - 1, GROUPS):
                group = edges[a : a + GROUPS + 1]
                at, row = group[:-1], slice(group[0], group[-1])
                rest = [vocabulary.take(pa.array(c[row])) for c in columns[1:]]
                lines = pc.binary_join_element_wise(*rest, pa.array(n[row]).cast(pa.string()), " ")
                lines = pc.binary_join(pa.ListArray.from_arrays(pa.array((group - group[0]).astype(np.int32)), lines), "\n")
                key = pc.binary_join_element_wise(*[vocabulary.take(pa.array(c[at])) for c in ahead[1:]], " ")
                first = pa.array(_named(words, langs, columns[0][at], lang[at]), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([first, key, pa.array(depth[at].astype(np.int32)), lines], names=["first", "key", "depth", "lines"])

    return run


class _Stack:
    """The open prefixes of the newest suffix and their counts; sorted suffixes are pushed on."""

    def __init__(self, max_n: int, least: int):
        self.max_n, self.least = max_n, least
        self.words: list[str] = []
        self.counts = [0] * max_n

    def push(self, rows: pa.Table) -> Iterator[tuple[list[str], int, list[int]]]:
        """(first, phrase, number) of the prefixes that these suffixes close."""
        fields = pc.list_flatten(pc.split_pattern(rows.column("line").combine_chunks(), " "))
        places = np.arange(len(rows)) * self.max_n
        columns = [rows.column("first").combine_chunks(), *[fields.take(pa.array(places + k)) for k in range(self.max_n - 1)]]
        n, depth = fields.take(pa.array(places + self.max_n - 1)).cast(pa.int64()).to_numpy(), rows.column("depth").to_numpy()
        same = np.ones(len(n), bool)
        begin, last = [c[0].as_py() for c in columns], [c[-1].as_py() for c in columns]
        popped = []
        for k, column in enumerate(columns):
            same[1:] &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            goes_on = self.words[: k + 1] == begin[: k + 1]
            same[0] = goes_on
            if not goes_on and self.counts[k]:
                popped.append((self.words, k, self.counts[k], self.depth))
            edges = np.flatnonzero(~same)
            starts = np.concatenate([[0], edges]) if goes_on else edges
            sums = np.add.reduceat(n, starts)
            if goes_on:
                sums[0] += self.counts[k]
                if len(starts) > 1 and self.counts[k]:
                    popped.append((self.words, k, int(sums[0]), self.depth))
            closed = np.arange(int(goes_on), len(starts) - 1)
            there = pc.not_equal(column, "").to_numpy(zero_copy_only=False)
            closed = closed[there[starts[closed]] & ((sums[closed] >= self.least) | (depth[starts[closed]] > k + 1))]
            if len(closed):
                at = pa.array(starts[closed])
                yield k + 1, [c.take(at) for c in columns[: k + 1]], sums[closed]
            self.counts[k] = int(sums[-1]) if last[k] else 0
        self.words, self.depth = last, int(depth[-1])
        for row in popped:
            yield from self._pop(*row)

    def close(self) -> Iterator:
        for k, n in enumerate(self.counts):
            if n:
                yield from self._pop(self.words, k, n, self.depth)

    def _pop(self, words: list[str], k: int, n: int, depth: int) -> Iterator:
        if n >= self.least or depth > k + 1:
            yield k + 1, [pa.array([w]) for w in words[: k + 1]], np.array([n])


def _count_prefixes(max_n: int, least: int):
    """(first, phrase, words, n) of all prefixes that are whole and frequent, or counted in parts."""

    def batch(k: int, columns: list[pa.Array], n: np.ndarray) -> pa.RecordBatch:
        rest = pc.binary_join_element_wise(*columns[1:], " ") if k > 2 else columns[1] if k > 1 else pa.array([""] * len(n))
        return pa.RecordBatch.from_arrays([columns[0], rest, pa.array(np.full(len(n), k, np.int32)), pa.array(n)], names=["first", "rest", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, held = _Stack(max_n, least), []
        for rows in batches:
            if rows.num_rows:
                held.append(rows)
            if sum(b.num_rows for b in held) >= ROWS:
                for closed in stack.push(pa.Table.from_batches(held)):
                    yield batch(*closed)
                held = []
        if held:
            for closed in stack.push(pa.Table.from_batches(held)):
                yield batch(*closed)
        for closed in stack.close():
            yield batch(*closed)

    return run


def frequent_phrases(docs: DataFrame, max_n: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of up to ``max_n`` words that occur at least
    ``least`` times in their language, and (lang, n), the number of words of each.

    Null texts are empty, a null language is ``und``, empty texts give nothing, and repeated
    rows count each time. Other columns are not read."""
    spark = docs.sparkSession
    texts = docs.where(F.col(text_col).isNotNull()).select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("text"))
    words = texts.mapInArrow(lean(_word_counts), "first string, n long").groupBy("first").agg(F.sum("n").alias("n"))
    words = materialize(words, "words")
    lang = F.expr("substring(first, 2 + length(substring_index(first, '\\n', 1)))")
    totals = words.groupBy(lang.alias("lang")).agg(F.sum("n").alias("n"))
    counted = words.agg(F.sum("n"), F.count(F.when(F.col("n") >= least, 1))).first()
    size = 1 << min(MOST_BITS.bit_length() - 1, max(10, (BITS * counted[1]).bit_length()))
    often = words.where(F.col("n") >= least).select(F.xxhash64("first").alias("h"))
    mask = F.lit(size - 1).cast("long")
    bits = bit_array(often.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("position")), size)
    hot = words.where(F.col("n") > max(LEAST_HOT, (counted[0] or 0) // SHARE)).select("first").collect()  # fewer than SHARE rows
    shared = spark.sparkContext.broadcast(bits), spark.sparkContext.broadcast({r["first"].encode() for r in hot})
    suffixes = texts.mapInArrow(lean(_suffixes(max_n, *shared)), "first string, key string, depth int, lines string")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(counted[0] or 0) // TASK_WORDS))
    dealt = suffixes.repartition(tasks, "first", "key").select("first", "depth", F.explode(F.split("lines", "\n")).alias("line"))
    # Every word has a space behind it, so that equal words in front stand together in byte order.
    dealt = dealt.sortWithinPartitions(F.desc("first"), F.desc("line"))
    prefixes = dealt.mapInArrow(lean(_count_prefixes(max_n, least)), "first string, rest string, words int, n long")
    summed = prefixes.groupBy("first", "rest", "words").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    phrase = F.concat_ws(" ", F.substring_index("first", "\n", 1), F.when(F.col("words") > 1, F.col("rest")))
    return materialize(summed.select(lang.alias("lang"), phrase.alias("phrase"), "words", "f"), "phrases"), materialize(totals, "totals")


def collocations(docs: DataFrame, max_n: int = 4, least: int = 30, most: int = 2_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``most`` collocations.

    Texts lose the case of A-Z, are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and these into words
    at spaces and tabs. A candidate is a phrase of 2 to ``max_n`` words with a >= ``least``
    occurrences. Cut after its first k words it scores floor(2,000,000 a / (l + r)), l and r
    being what its two parts occur; its lowest score counts, of equal ones that of the least k.
    A candidate goes if a longer one, itself kept or not, holds its words in a row and occurs
    at least 0.8 times as often. Order: score, then a, both falling, then phrase by UTF-8 bytes.
    Products are decimals of up to 38 digits. An empty table gives no rows; for nulls and
    repeated rows see ``frequent_phrases``."""
    phrases, totals = frequent_phrases(docs, max_n, least, lang_col, text_col)
    whole = {c: F.col(c).cast("decimal(20,0)") for c in ("a", "l", "r", "longer")}
    candidates = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cut = candidates.select("*", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cut = cut.select("lang", "phrase", "a", "k", F.expr("array_join(slice(w, 1, k), ' ')").alias("left"), F.expr("array_join(slice(w, k + 1, words), ' ')").alias("right"))
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cut = cut.join(phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cut = cut.select("lang", "phrase", "k", "a", "l", "r")
    cut = cut.withColumn("score", F.call_function("div", whole["a"] * F.lit(2_000_000).cast("decimal(7,0)"), whole["l"] + whole["r"]))
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"))
    pieces = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))"
    inside = candidates.where("words >= 3").select("lang", F.explode(F.expr(pieces)).alias("phrase"), F.col("a").alias("longer"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (whole["longer"] * 100 < whole["a"] * 80))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # Each part of a language ranks its own first, so that no task sorts a whole language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
