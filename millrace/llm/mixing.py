"""Mixing sources to target weights by fitting subset sums over document lengths.

Documents are counted by exact length for each source and one of SALTS or more parts of a
seeded hash.  For each source a plan says how many documents of each length to take: the same
share of every length for all but DP_WORDS of the budget, the largest lengths while more than that
is left by rounding, then a bounded-knapsack dynamic program over the lengths left for the
rest.  The documents of a
length are those first in a seeded order.  The plan is made from counts, one group for each
source, with one row for each length; documents meet it by a join on source, length and
part, so that neither a large source nor a frequent length lands in one task.

A null text has size 0 and takes no words; a null source is a source of its own, the last;
rows with equal ids count apart, and among equal ones it does not matter which is taken; an
empty table gives an empty result.  Columns of other names are kept as they are, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD_PATTERN, small_batches, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 20_240_601
#: Parts of a length's documents at least, and rows of all for each part.
SALTS, SALT_ROWS = 64, 1 << 20
#: Words that the dynamic program fits; what is above is taken by the largest lengths.
DP_WORDS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size -> and target: words shared by weight, none above `most` times its size.

    Sources are taken in the order of their limit by weight; those in front whose limit is
    within an even share of what is left reach it, the others share by weight.
    """
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    placed = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", weight)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    limit = F.col("source_size") * most
    left = (F.sum("source_size").over(all_rows) * share - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    level = placed.withColumn("limit", limit.cast("double")).withColumn("left", left).withColumn("row", F.row_number().over(order))
    level = level.withColumn("open", F.col("limit") > F.col("weight") * F.col("left"))
    level = level.withColumn("level", F.min_by(F.when(F.col("open"), F.col("left")), F.when(F.col("open"), F.col("row"))).over(all_rows))
    return level.select("source", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), "limit")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take, so that their words come as near to the budget as can be."""
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    take = np.array([int(c) * max(0, budget - DP_WORDS) // total for c in counts], np.int64)
    left = budget - int((take * sizes).sum())
    for k in np.argsort(-sizes, kind="stable"):
        if left <= DP_WORDS:
            break
        if sizes[k] > 0:
            more = min(int(counts[k] - take[k]), (left - DP_WORDS // 2) // int(sizes[k]))
            if more > 0:
                take[k], left = take[k] + more, left - more * int(sizes[k])
    rest = counts - take
    usable = [int(k) for k in np.argsort(sizes, kind="stable") if sizes[k] > 0 and rest[k] > 0]
    if not usable or left <= 0:
        return take
    # Sums up to `room` are bits of an integer; a sum above what is left counts if it is nearer.
    room = left + min(int(sizes[usable[0]]), max(left, DP_WORDS))
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for k in usable:
        size, most = int(sizes[k]), min(int(rest[k]), room // int(sizes[k]))
        part = 1
        while most > 0:
            n = min(part, most)
            steps.append((k, n, reach))
            reach |= (reach << (n * size)) & mask
            most, part = most - n, part * 2
        if reach >> left & 1:
            break
    near = next(s for d in range(room + 1) for s in (left - d, left + d) if s >= 0 and reach >> s & 1)
    for k, n, had in reversed(steps):
        if not had >> near & 1:
            take[k], near = take[k] + n, near - n * int(sizes[k])
    return take


def _plan(counts: pd.DataFrame) -> pd.DataFrame:
    sizes, n = counts["size"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, n = sizes[order], n[order]
    total, budget = int((sizes * n).sum()), int(round(float(counts["target"].iloc[0])))
    whole = budget // total if total else 0
    take = fit(sizes, n, budget - whole * total)
    return pd.DataFrame({"source": counts["source"].iloc[0], "size": sizes, "whole": whole, "take": take})


def _mixed(rows: DataFrame, weights, share: float, most: float, seed: int, order: list[str]) -> DataFrame:
    """rows (row, source, size and the columns of `order`) with source_size, target and copies."""
    small_batches(rows.sparkSession)
    salts = max(SALTS, rows.count() // SALT_ROWS)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(F.lit(seed + 1), *order), F.lit(salts)))
    counts = stored(rows.groupBy("source", "size", "salt").agg(F.count(F.lit(1)).alias("n")))
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    sources = stored(targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, most))
    same = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    aimed = by_size.join(sources, same(by_size, sources, "source")).select(by_size["source"], "size", "n", "target")
    plan = aimed.groupBy("source").applyInPandas(_plan, "source string, size long, whole long, take long")
    dealt = counts.join(plan, same(counts, plan, "source", "size")).select(counts["source"], counts["size"], "salt", "n", "whole", "take")
    running = F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    quota = F.greatest(F.lit(0), F.least("n", F.col("take") - running))
    dealt = dealt.select("source", "size", "salt", "whole", quota.alias("quota"))
    dealt = stored(dealt.join(sources, same(dealt, sources, "source")).select(dealt["source"], "size", "salt", "whole", "quota", "source_size", "target"))
    met = rows.join(dealt, same(rows, dealt, "source", "size", "salt")).select(*(rows[c] for c in rows.columns), "whole", "quota", "source_size", "target")
    place = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy(F.xxhash64(F.lit(seed), *order), *order))
    return met.withColumn("copies", F.col("whole") + (place <= F.col("quota")).cast("long"))


def _as_rows(docs: DataFrame, size: Column, order: tuple[Column, ...]) -> tuple[DataFrame, list[str]]:
    """The columns of docs as one, so that none clashes with those made here."""
    names = [f"o{k}" for k in range(len(order))]
    return docs.select(F.struct("*").alias("row"), F.col("source").alias("source"), size.alias("size"), *(c.alias(n) for c, n in zip(order, names, strict=True))), names


def mixed(docs: DataFrame, size: Column | None = None, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, order: tuple[Column, ...] | None = None) -> DataFrame:
    """docs with size, source_size, target (its source's) and copies, how often the mix takes it.

    `order` tells rows of a length apart, doc_id if not given.  Columns of docs that have the
    name of a column made here are replaced.
    """
    rows, names = _as_rows(docs, words_in(F.col("text")) if size is None else size, order or (F.col("doc_id"),))
    made = ("size", "source_size", "target", "copies")
    return _mixed(rows, weights, share, most, seed, names).select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in made), *made)


def taken(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of docs.

    Rows of a length are told apart by doc_id, then by their text.
    """
    rows, names = _as_rows(docs, words_in(F.col("text")), (F.col("doc_id"), F.xxhash64("text")))
    chosen = _mixed(rows, weights, share, most, seed, names).where("copies > 0")
    return chosen.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
