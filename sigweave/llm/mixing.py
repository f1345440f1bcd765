"""Mixing sources to target weights with Pareto order sampling.

Each source gets a target in words.  Inside a source every document gets an expected number of
copies; the whole part is taken for certain, and the fractions are sampled: documents are ranked by
the odds of a random number over the odds of their fraction, and taken in that order until the
source's remaining words are used up.  The sample's fixed size is therefore counted in words, the
unit in which the target is given.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigweave.llm.tables import WORD, added, cut, text_of

RESULT = ("size", "source_size", "target", "copies", "taken")
#: Documents ranked together, about; a source is split into as many ranges of the ranking as it needs.
RANGE = 20_000
#: How far a source may be off its target before the border is mended by more than one change.
OFF = 0.01


@dataclass(frozen=True)
class Mix:
    """``share`` of all words goes to the sources by ``weights``, repeated along the sources in order.

    No source and no document is taken more than ``most`` times over.  The expected copies of a
    document grow with its size to the power ``size_power`` (0: all documents of a source alike).
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: float = 2.0
    size_power: float = 0.5
    seed: int = 20_260


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def targets(sources: DataFrame, mix: Mix) -> DataFrame:
    """``(source, source_size)`` with ``target``: one row per source goes through one ordered window.

    Sources go by code point, null last.  A source whose share exceeds ``most`` times its size is
    filled to that; since the sources fill up in the order of size over weight, one pass over that
    order finds how many are full, and the others share what is left by weight.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("place") % len(mix.weights) + 1).cast("int"))
    rows = sources.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    rows = rows.withColumn("weight", weight).withColumn("limit", F.col("source_size") * F.lit(mix.most))
    order = Window.orderBy(F.col("limit") / F.col("weight"), F.col("place"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) * mix.share - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    onward = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = rows.withColumn("level", left / onward)
    open_ = F.col("limit") > F.col("level") * F.col("weight")
    level = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(whole)
    rows = rows.withColumn("level", level)
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", "documents", target.alias("target"))


def _expected(mix: Mix) -> Column:
    """Expected copies of a document; ``factor`` is null where every document is taken ``most`` times."""
    grown = F.col("factor") * F.pow(F.col("size").cast("double"), F.lit(mix.size_power))
    return F.when(F.col("size") == 0, 0.0).when(F.col("factor").isNull(), mix.most).otherwise(F.least(F.lit(mix.most), grown))


def factors(histogram: DataFrame, goals: DataFrame, mix: Mix) -> DataFrame:
    """Per source the factor that makes expected words equal the target, and what the whole copies leave.

    ``histogram`` has one row per source and size; sizes above some size are at the limit, and the
    largest size that is not fixes the factor.
    """
    rows = histogram.join(goals, histogram.source.eqNullSafe(goals.source)).drop(histogram.source).filter("size > 0")
    above = Window.partitionBy("source").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    below = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    power = F.pow(F.col("size").cast("double"), F.lit(mix.size_power))
    full = F.coalesce(F.sum(F.col("n") * F.col("size")).over(above), F.lit(0)) * F.lit(mix.most)
    rows = rows.withColumn("factor", (F.col("target") - full) / F.sum(F.col("n") * F.col("size") * power).over(below))
    fits = (F.col("factor") >= 0) & (F.col("factor") * power < mix.most)
    per = Window.partitionBy("source")
    rows = rows.withColumn("factor", F.max_by(F.when(fits, F.col("factor")), F.when(fits, F.col("size"))).over(per))
    expected = _expected(mix)
    part = expected - F.floor(expected)
    inside = (part > 0) & (part < 1)
    return rows.groupBy("source", "source_size", "target", "documents", "factor").agg(
        (F.col("target") - F.sum(F.floor(expected) * F.col("size") * F.col("n"))).alias("room"),
        F.round(F.sum(F.when(inside, -F.log(part / (1 - part)) * F.col("n"))) / F.sum(F.when(inside, F.col("n"))), 1).alias("centre"),
    )


def _nearest(sizes: np.ndarray, took: np.ndarray, short: float) -> tuple[float, np.ndarray]:
    """The change that leaves least missing: a row added, one left out, or both; and what is then missing."""
    inside, outside = np.flatnonzero(took), np.flatnonzero(~took)
    gone, come = np.append(sizes[inside], 0), np.append(sizes[outside], 0)  # 0: no row on this side
    order = np.argsort(come, kind="stable")
    wanted = short + gone
    right = np.minimum(np.searchsorted(come[order], wanted), len(order) - 1)
    at = np.concatenate([right, np.maximum(right - 1, 0)])
    left = np.tile(wanted, 2) - come[order[at]]
    best = int(np.argmin(np.abs(left)))
    out, into = best % len(gone), int(order[at[best]])
    after = took.copy()
    after[inside[out : out + 1]] = False
    after[outside[into : into + 1]] = True
    return float(left[best]), after


def _fill(rows: pd.DataFrame) -> pd.DataFrame:
    """Take in the order of the ranking, up to the border, with or without the row there.

    What is then missing or too much goes by the change that comes nearest, of two rows at most.  Only
    where a source is still off by more than ``OFF`` of its target, as a few long rows make it, are
    further changes made, while they help: so a source departs from the order by a few rows,
    whatever their number.
    """
    rows = rows.sort_values(["rank", "key", "tie"], kind="stable")
    sizes = rows["words"].to_numpy()
    until, room = sizes.cumsum(), float(rows["left"].iloc[0])
    n = int((until <= room).sum())
    ways = []
    for k in range(n, min(n + 1, len(sizes)) + 1):
        took, short = np.arange(len(sizes)) < k, room - (until[k - 1] if k else 0)
        ways += [(short, took), _nearest(sizes, took, short)]
    short, took = min(ways, key=lambda w: abs(w[0]))
    while abs(short) > OFF * rows["target"].iloc[0]:
        further, after = _nearest(sizes, took, short)
        if abs(further) >= abs(short):
            break
        short, took = further, after
    return rows.assign(took=took)[["key", "tie", "source", "took"]]


def mixed(
    docs: DataFrame, mix: Mix | None = None, key: str = "doc_id", source: str = "source", text: str = "text"
) -> DataFrame:
    """All rows with ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, copies counted).

    A null text has size 0 and is never taken; null is a source of its own, the last.  The random
    number is a hash of key, text and seed, so reruns agree; rows that repeat key, source and text
    are taken or left together.  No rows give no rows.  Columns named like a result are replaced.
    """
    mix = mix or Mix()
    base = docs.withColumns({
        "__key": F.col(key).cast("string"), "__source": F.col(source), "__size": words(text_of(text)),
        "__tie": F.xxhash64(F.lit(mix.seed), F.col(key), text_of(text)),
    })
    rows = base.select(F.col("__key").alias("key"), F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__tie").alias("tie"))
    rows = cut(rows, "sizes")
    histogram = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    per_source = cut(factors(histogram, targets(totals, mix), mix), "factors")

    def ranked(df: DataFrame) -> DataFrame:
        """With the sampling rank and its range; both are functions of the row and of its source."""
        df = df.join(per_source.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
        df = df.withColumn("expected", _expected(mix)).withColumn("whole", F.floor("expected"))
        df = df.withColumn("part", F.col("expected") - F.col("whole"))
        u = (F.pmod("tie", F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
        odds = F.log(u / (1 - u)) - F.log(F.col("part") / (1 - F.col("part")))
        df = df.withColumn("rank", F.when(F.col("part") > 0, odds))
        ranges = F.ceil(F.col("documents") / F.lit(float(RANGE)))
        place = 1 / (1 + F.exp(F.coalesce("centre", F.lit(0.0)) - F.col("rank")))
        return df.withColumn("range", F.when(F.col("rank").isNotNull(), F.least(ranges - 1, F.floor(place * ranges))))

    sums = ranked(rows).filter("rank is not null").groupBy("source", "room", "range").agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("until", F.sum("words").over(run)).filter(F.col("until") > F.col("room"))
    border = sums.groupBy("source").agg(
        F.min("range").alias("border"), F.min_by(F.col("room") - F.col("until") + F.col("words"), "range").alias("left")
    )
    border = cut(border.withColumnRenamed("source", "of"), "border")
    at_border = ranked(rows).join(border, (F.col("source").eqNullSafe(F.col("of"))) & (F.col("range") == F.col("border")))
    units = at_border.groupBy("key", "tie", "source", "rank", "left", "target").agg(F.sum("size").alias("words"))
    filled = units.groupBy("source").applyInPandas(
        _fill, f"key string, tie long, source {rows.schema['source'].dataType.simpleString()}, took boolean"
    )
    filled = cut(filled.filter("took").select(F.col("key").alias("k"), F.col("tie").alias("t"), F.col("source").alias("s")), "filled")

    named = base.select(
        F.struct(*added(docs)).alias("row"), F.col("__key").alias("key"), F.col("__source").alias("source"),
        F.col("__size").alias("size"), F.col("__tie").alias("tie"),
    )
    all_rows = ranked(named).join(border.drop("left"), F.col("source").eqNullSafe(F.col("of")), "left")
    at = F.coalesce(F.col("range") == F.col("border"), F.lit(False))
    by_range = F.col("rank").isNotNull() & F.coalesce(F.col("range") < F.col("border"), F.lit(True))
    sure = all_rows.filter(~at).withColumn("sampled", by_range.cast("int"))
    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("tie") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))
    edge = all_rows.filter(at).join(filled, same, "left").withColumn("sampled", F.col("t").isNotNull().cast("int"))
    out = sure.unionByName(edge.drop("k", "t", "s")).withColumn("copies", F.coalesce(F.col("whole"), F.lit(0)) + F.col("sampled"))
    return out.select(
        *[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in RESULT],
        F.col("size"), F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"),
        F.col("copies").cast("long").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"),
    )


def mixture(docs: DataFrame, mix: Mix | None = None, **names: str) -> DataFrame:
    """The mixture itself: each document as often as it is taken, columns as in ``docs``, and ``copy`` from 1.

    A column of ``docs`` named ``copy`` is replaced.
    """
    source = docs.withColumn("__row", F.struct(*added(docs)))
    rows = mixed(source, mix, **names).filter("copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return rows.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c != "copy"], "copy")
