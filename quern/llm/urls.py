"""URL rules by cascades of Bloom filters: exact membership without joins.

The first level of a cascade encodes the listed keys. The second encodes the keys of the
corpus that pass the first without being listed, the third the listed keys that pass the
second, and so on until a level lets nothing wrong through. A key of the corpus or the list
is judged by the first level that it fails: an even level (from 0) says "not listed", an odd
one "listed". The answer is exact for all keys that the cascade was built over, which is
the complete set of keys of the corpus; the filters alone travel to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.bits import bit_array, is_set
from quern.llm.workers import lean
from quern.storage import materialize

#: Bits per listed key of the first level (one key in 300 passes wrongly); every further level
#: lets about half through, at 2 bits a key and one hash.
FIRST_BITS, FIRST_HASHES = 12, 8
#: Bits that a level has at most (64 MB). A list that needs more is cut into parts by a hash
#: of the key, each with a cascade of its own, which are asked in turn.
MOST_BITS = 1 << 29


def _places(keys: list[bytes], level: int, hashes: int, size: int) -> np.ndarray:
    """(hashes, keys): bits of each key; every level hashes with a seed of its own."""
    from xxhash import xxh3_128_intdigest

    both = b"".join(xxh3_128_intdigest(k, seed=level + 1).to_bytes(16, "little") for k in keys)
    one, two = np.frombuffer(both, "<u8").reshape(-1, 2).T
    return np.stack([(one + np.uint64(i) * (two | np.uint64(1))) % np.uint64(size) for i in range(hashes)])


@dataclass
class Level:
    words: np.ndarray
    level: int
    hashes: int

    def passes(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, bool)
        return np.logical_and.reduce([is_set(self.words, p) for p in _places(keys, self.level, self.hashes, len(self.words) * 64)])


@dataclass
class Cascade:
    """Levels by part of the key space; ``part`` of a key is a hash of it."""

    parts: list[list[Level]]

    def part(self, keys: list[bytes]) -> np.ndarray:
        from xxhash import xxh3_64_intdigest

        if len(self.parts) == 1:
            return np.zeros(len(keys), int)
        return np.fromiter((xxh3_64_intdigest(k, seed=0) % len(self.parts) for k in keys), int, len(keys))

    def passes_first(self, keys: list[bytes]) -> np.ndarray:
        return self._by_part(keys, lambda levels, k: levels[0].passes(k))

    def holds(self, keys: list[bytes]) -> np.ndarray:
        """Which keys of those that the cascade was built over are listed."""
        return self._by_part(keys, self._descend)

    def _by_part(self, keys: list[bytes], ask) -> np.ndarray:
        part, out = self.part(keys), np.zeros(len(keys), bool)
        for p in np.unique(part):
            at = np.flatnonzero(part == p)
            out[at] = ask(self.parts[p], [keys[k] for k in at])
        return out

    @staticmethod
    def _descend(levels: list[Level], keys: list[bytes]) -> np.ndarray:
        out, at = np.full(len(keys), len(levels) % 2 == 1), np.arange(len(keys))
        for k, level in enumerate(levels):
            passed = level.passes([keys[i] for i in at])
            out[at[~passed]] = k % 2 == 1
            at = at[passed]
        return out


def _only(keys: DataFrame, test) -> DataFrame:
    """Distinct keys that pass ``test``, a function of a list of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(test(batch.column(0).to_pylist()), pa.bool_()))

    return keys.mapInArrow(lean(run), "key binary")


def _level(keys: DataFrame, n: int, level: int, most_bits: int) -> Level:
    """A Bloom filter of these ``n`` keys."""
    per_key, hashes = (FIRST_BITS, FIRST_HASHES) if level == 0 else (2, 1)
    size = min(most_bits, max(64, -(-n * per_key // 64) * 64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                places = _places(batch.column(0).to_pylist(), level, hashes, size)
                yield pa.RecordBatch.from_arrays([pa.array(places.reshape(-1).astype(np.int64))], names=["position"])

    return Level(bit_array(keys.mapInArrow(lean(run), "position long"), size), level, hashes)


def cascade(listed: DataFrame, universe: DataFrame, most_bits: int = MOST_BITS) -> Cascade:
    """A cascade that tells ``listed`` from all other keys of ``universe`` (column key, binary).

    Keys may repeat in either; null keys are left out. Building reads the universe once for
    the first level; later levels read only what the level before let through, which halves."""
    spark = listed.sparkSession
    listed = materialize(listed.where("key is not null").select("key").distinct(), "listed")
    n = listed.count()
    out = Cascade([[] for _ in range(max(1, -(-n * FIRST_BITS // most_bits)))])
    for p, levels in enumerate(out.parts):
        mine = materialize(_only(listed, lambda keys, p=p: out.part(keys) == p), "part") if len(out.parts) > 1 else listed
        levels.append(_level(mine, mine.count(), 0, most_bits))
    first = spark.sparkContext.broadcast(out)
    wrong = _only(universe.where("key is not null").select("key"), lambda keys: first.value.passes_first(keys))
    # Keys let through that no list holds: told by grouping, one row a key.
    tagged = wrong.distinct().withColumn("is_listed", F.lit(0)).unionAll(listed.withColumn("is_listed", F.lit(1)))
    wrong = materialize(tagged.groupBy("key").agg(F.max("is_listed").alias("is_listed")).where("is_listed = 0").select("key"), "passed")
    for p, levels in enumerate(out.parts):
        own = [materialize(_only(x, lambda keys, p=p: out.part(keys) == p), "part") if len(out.parts) > 1 else x for x in (listed, wrong)]
        k = 1
        while n := own[k % 2].count():
            levels.append(_level(own[k % 2], n, k, most_bits))
            newest = spark.sparkContext.broadcast(levels[-1])
            own[1 - k % 2] = materialize(_only(own[1 - k % 2], lambda keys, newest=newest: newest.value.passes(keys)), "passed")
            k += 1
    return out


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def split_rule(rule: Column) -> tuple[Column, Column]:
    """Host and path of a rule like ``example.net/en/``; a rule without ``/`` holds for all paths."""
    at = F.instr(rule, "/")
    return F.when(at > 0, F.substring(rule, F.lit(1), at - 1)).otherwise(rule), F.when(at > 0, F.substring(rule, at, F.length(rule))).otherwise("")


def _key(host_: str, path_: str) -> bytes:
    return f"{host_}\n{path_}".encode("utf-8", "surrogatepass")


def shapes(rules: DataFrame) -> dict[int, list[int]]:
    """Lengths of rules' paths by the number of dots in their hosts: what a url must be cut to.

    Small for any list that can be stored: k different lengths take k * k / 2 characters."""
    h, p = split_rule(F.col("rule"))
    found: dict[int, list[int]] = {}
    for dots, length in rules.select(F.length(h) - F.length(F.replace(h, F.lit("."))), F.length(p)).distinct().collect():
        found.setdefault(dots, []).append(length)
    return {d: sorted(ls) for d, ls in found.items()}


def _candidates(host_: str, path_: str, cuts: dict[int, list[int]]) -> Iterator[tuple[str, str]]:
    """Rules that would fit: the host or what is behind one of its dots, and a begin of the path."""
    dots = [-1, *[k for k, c in enumerate(host_) if c == "."]]
    for n, lengths in cuts.items():
        if n < len(dots):
            suffix = host_[dots[-1 - n] + 1 :]
            for length in lengths:
                if length > len(path_):
                    break
                yield suffix, path_[:length]


def _fitting(cuts: dict[int, list[int]], ask):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            yield from ask(batch, [list(_candidates(h, p, cuts)) for h, p in zip(hosts, paths)])

    return run


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """(id, host, path, rule, verdict) for each row of ``urls``.

    ``rules`` has rule (host, then path) and verdict (``block`` or ``allow``). A rule fits its
    host and all subdomains where the path of the url starts with the rule's; the longest
    that fits is told, of equally long ones that of the longest host, and its verdict; a url
    that no rule fits is ``allow``, with a null rule. Of a rule listed both ways, block counts. A null url, or one without ``://``, has an empty host
    and path, which only a rule of those would fit. Repeated rows stay rows of their own, ids
    may be null; other columns are not read; empty tables of urls or rules are fine.

    Keys are all rules that could fit some url, cut to the shapes that rules have. One cascade
    tells listed keys from all others, a second tells, among listed keys, those that block."""
    spark = urls.sparkSession
    table = urls.select(F.col(id_col), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    cuts = shapes(rules.where("rule is not null"))

    def keys(batch: pa.RecordBatch, found: list[list[tuple[str, str]]]) -> Iterator[pa.RecordBatch]:
        distinct = {x for row in found for x in row}
        yield pa.RecordBatch.from_arrays([pa.array([_key(*x) for x in distinct], pa.binary())], names=["key"])

    universe = table.select("host", "path").mapInArrow(lean(_fitting(cuts, keys)), "key binary")
    listed = rules.where("rule is not null").select(F.encode(F.concat_ws("\n", *split_rule(F.col("rule"))), "utf-8").alias("key"), "verdict")
    any_rule = cascade(listed, universe, most_bits)
    blocking = cascade(listed.where("verdict = 'block'"), listed, most_bits)
    shared = spark.sparkContext.broadcast((any_rule, blocking))

    def verdicts(batch: pa.RecordBatch, found: list[list[tuple[str, str]]]) -> Iterator[pa.RecordBatch]:
        any_rule, blocking = shared.value
        distinct = list({x for row in found for x in row})
        known = {x for x, yes in zip(distinct, any_rule.holds([_key(*x) for x in distinct])) if yes}
        rule = [max((x for x in row if x in known), key=lambda x: (len(x[0]) + len(x[1]), len(x[0])), default=None) for row in found]
        told = list(known)
        blocks = {x for x, yes in zip(told, blocking.holds([_key(*x) for x in told])) if yes}
        columns = [
            batch.column(0), batch.column("host"), batch.column("path"),
            pa.array([x and x[0] + x[1] for x in rule], pa.string()), pa.array(["block" if x in blocks else "allow" for x in rule], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[id_col, "host", "path", "rule", "verdict"])

    kind = table.schema[id_col].dataType.simpleString()
    return table.mapInArrow(lean(_fitting(cuts, verdicts)), f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
