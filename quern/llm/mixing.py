"""Mixing sources to target weights by pivotal dependent rounding.

A source's documents each start with the same expected number of copies, target / size of
the source. Whole copies are taken at once. What is left is a fraction per document; two
documents at a time, words move from one fraction to the other, in a random direction that
keeps both expectations and their sum of words, until one fraction is 0 or 1. Hashed
blocks of documents do this on their own and each hands one undecided document per source
to a reduction tree; the last one of a source is rounded
to the nearer end, so that a source misses its target by half a document at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.ordering import with_place
from quern.storage import materialize

BLOCK_ROWS = 2_000
FAN_IN = 16
#: Equal rows that one array numbers.
STEP = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(rows: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) for sized rows (source, size): ``share`` of all words by
    repeating weights, in code point order with null last; what would pass ``most`` times a
    source's words is shared anew.

    Sources may be many: they stay a table, ordered by ranges. The driver holds three sums a
    round, and every round fixes at least one more source at its most."""
    per = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = with_place(per, F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = materialize(per.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("cap")), "mix-sources")
    words = per.agg(F.sum("source_size")).first()[0] or 0
    left, open_weight, fixed = share * words, None, -1.0
    level = -1.0  # words per unit of weight; sources whose cap per weight is below it are at their most
    while True:
        at_most = F.col("cap") < F.col("weight") * level
        capped, open_weight, n = per.agg(F.sum(F.when(at_most, F.col("cap"))), F.sum(F.when(~at_most, F.col("weight"))), F.count_if(at_most)).first()
        left = share * words - (capped or 0.0)
        if n == fixed or not open_weight:
            break
        fixed, level = n, left / open_weight
    target = F.when(at_most, F.col("cap")).otherwise(F.lit(left) * F.col("weight") / F.lit(open_weight or 1.0))
    return per.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def pivot(fraction: np.ndarray, size: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds fractions pairwise, keeping sum(fraction * size); the index still undecided, or -1."""
    out = fraction.tolist()
    open_ = -1
    for k, (s, u) in enumerate(zip(size.tolist(), draw.tolist())):
        f = out[k]
        if f <= 0.0 or f >= 1.0:
            continue
        if open_ < 0:
            open_ = k
            continue
        g, t = out[open_], size[open_]
        up = min((1 - f) * s, g * t)
        down = min(f * s, (1 - g) * t)
        move = up if u * (up + down) < down else -down
        new_f, new_g = f + move / s, g - move / t
        # The side that reached its end is set exactly; rounding errors never leave both open.
        if move > 0:
            done_f = (1 - f) * s <= g * t
            new_f, new_g = (1.0, new_g) if done_f else (new_f, 0.0)
        else:
            done_f = f * s <= (1 - g) * t
            new_f, new_g = (0.0, new_g) if done_f else (new_f, 1.0)
        near = 1e-12
        new_f = round(new_f) if min(new_f, 1 - new_f) < near else new_f
        new_g = round(new_g) if min(new_g, 1 - new_g) < near else new_g
        out[k], out[open_] = new_f, new_g
        if 0.0 < new_f < 1.0:
            open_ = k
        elif not 0.0 < new_g < 1.0:
            open_ = -1
    return np.array(out), open_


def _draws(ids: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in [0, 1) from ids (splitmix64), the same in every run."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _round_block(rows: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Decides all rows of a block but one per source (column ``open``).

    Large documents go first, so that the one left open tends to be small."""
    rows = rows.sort_values(["size", "id", "copy"], ascending=[False, True, True], na_position="last").reset_index(drop=True)
    fraction, undecided = rows["fraction"].to_numpy(float).copy(), np.zeros(len(rows), bool)
    draw = _draws(rows["id"].fillna(-1).to_numpy(np.int64) + 1_000_003 * rows["copy"].to_numpy(np.int64), seed)
    kind = pd.factorize(rows["source"], use_na_sentinel=False)[0]
    order = np.argsort(kind, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
        done, open_ = pivot(fraction[at], rows["size"].to_numpy(float)[at], draw[at])
        fraction[at] = done
        if open_ >= 0:
            undecided[at[open_]] = True
    return rows.assign(fraction=fraction, open=undecided)


def _decide(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _round_block(rows, seed)

    return run


SCHEMA = "id long, source string, size long, source_size long, target double, whole int, fraction double, copy long, block long, open boolean"


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """(id, source, size, source_size, target, copies): how often the mix takes each row.

    size counts the words of the text (null: 0). A document of size 0 is taken as often as
    its source's ratio rounds down to, which adds no words. Null is a source of its own,
    last in order; null ids and repeated rows are decided each on its own; an empty table
    gives no rows. Only the id, text and source columns are read.

    Blocks are hashed by id, so that neither a hot source nor the order of files decides
    what meets; reruns give the same result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
    )
    rows = materialize(rows, "mix-sizes")
    plan = materialize(targets(rows, weights, share, most), "mix-targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = plan.select(F.col("source").alias("goal_source"), "source_size", "target", ratio.alias("ratio"))
    blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    # Rows that are alike in all that is read are told apart by a number, given by runs of STEP.
    rows = rows.groupBy("id", "source", "size").count()
    rows = rows.withColumn("begin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(STEP).cast("long"))))
    rows = rows.withColumn("copy", F.explode(F.sequence("begin", F.least(F.col("begin") + STEP, F.col("count")) - 1)))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    whole = F.floor("ratio").cast("int")
    rows = rows.select(
        "id", "source", "size", "source_size", "target", whole.alias("whole"),
        F.when(F.col("size") > 0, F.col("ratio") - whole).otherwise(0.0).alias("fraction"), "copy",
        F.pmod(F.xxhash64("id", "copy"), F.lit(blocks)).alias("block"), F.lit(False).alias("open"),
    )
    rows = materialize(rows.groupBy("block").applyInPandas(_decide(seed), SCHEMA), "mix-leaves")
    decided, undecided = [rows.where("not open")], rows.where("open")
    level = 0
    while blocks > 1:
        blocks, level = -(-blocks // FAN_IN), level + 1
        merged = undecided.withColumn("block", F.floor(F.col("block") / FAN_IN))
        done = materialize(merged.groupBy("source", "block").applyInPandas(_decide(seed + level), SCHEMA), "mix-tree")
        decided.append(done.where("not open"))
        undecided = done.where("open")

    decided.append(undecided)
    out = decided[0]
    for more in decided[1:]:
        out = out.unionAll(more)
    copies = (F.col("whole") + F.round("fraction").cast("int")).cast("int")
    return out.select("id", "source", "size", "source_size", "target", copies.alias("copies"))
