"""Exact deduplication with a two-pass Bloom filter, in DataFrame functions only.

Pass one counts, per cell of a bit array of bounded size, how many texts fall into it; cells with
two or more become the filter.  Pass two tests each row against the filter: a row with a cell that
nobody shares has no copy and goes straight to the result, and only the others are grouped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigweave.llm.tables import added, cut, text_of

#: Cells for each row, and the most cells (2^27 bits: a filter of at most 16 MiB is broadcast).
CELLS_PER_ROW = 16
MAX_CELLS = 1 << 27
#: Cells in one row of the filter.
BLOCK = 32_768

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _cells(cells: int, text: Column) -> list[Column]:
    h = F.xxhash64(text)
    return [F.pmod(h, F.lit(cells)), F.pmod(F.xxhash64(h), F.lit(cells))]


def cell_count(rows: int) -> int:
    cells = BLOCK
    while cells < rows * CELLS_PER_ROW and cells < MAX_CELLS:
        cells *= 2
    return cells


def shared_cells(docs: DataFrame, cells: int, text: str = "text") -> DataFrame:
    """The filter, ``(block, bits)``: cells that at least two insertions hit.

    Only cell numbers travel, summed up in the map tasks first; the result has ``cells`` bits at most.
    """
    hit = docs.select(F.explode(F.array(*_cells(cells, text_of(text)))).alias("cell"))
    return (
        hit.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .groupBy(F.expr(f"cell div {BLOCK}").alias("block"))
        .agg(F.bitmap_construct_agg(F.expr(f"cell % {BLOCK}")).alias("bits"))
    )


def _is_set(bits: str, cell: str) -> Column:
    byte = F.expr(f"cast(conv(hex(substring({bits}, cast(({cell} % {BLOCK}) div 8 as int) + 1, 1)), 16, 10) as int)")
    return F.coalesce(F.getbit(byte, F.expr(f"cast({cell} % 8 as int)")) == 1, F.lit(False))


def _decided(docs: DataFrame, key: str, text: str) -> DataFrame:
    """All rows and columns, with the four results under names that begin with ``__``."""
    cells = cell_count(docs.count())
    shared = F.broadcast(shared_cells(docs, cells, text))
    one, two = _cells(cells, text_of(text))
    rows = docs.withColumns({"__one": one, "__two": two})
    for name in ("one", "two"):
        block = shared.select(F.col("block").alias(f"__{name}_block"), F.col("bits").alias(f"__{name}_bits"))
        rows = rows.join(block, F.expr(f"__{name} div {BLOCK}") == F.col(f"__{name}_block"), "left")
    repeated = _is_set("__one_bits", "__one") & _is_set("__two_bits", "__two")
    sha = F.sha2(text_of(text).cast("binary"), 256)
    rows = rows.select(*added(docs), sha.alias("__text_sha256"), repeated.alias("__repeated"))
    alone = rows.filter(~F.col("__repeated")).withColumns(
        {"__keep_id": F.col(key), "__group_size": F.lit(1).cast("long"), "__kept": F.lit(True)}
    )
    several = rows.filter("__repeated")
    groups = cut(
        several.groupBy("__text_sha256")
        .agg(F.max(key).alias("__keep_id"), F.count(F.lit(1)).alias("__group_size")),
        "exact",
    )
    # Written and read again, both sides meet by a plain shuffle, whose hot keys Spark splits.
    several = several.join(groups, "__text_sha256").withColumn("__kept", F.col(key).eqNullSafe(F.col("__keep_id")))
    return alone.unionByName(several)


def with_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Rows whose texts are identical form a group; the largest ``key`` stays (null is below all).
    A null text equals an empty one.  Several rows with one key and one text count singly in
    ``group_size`` and share their decision.  Columns of the input named like a result are replaced.
    """
    rows = _decided(docs, key, text)
    return rows.select(*added(docs, *RESULT), *[F.col(f"__{c}").alias(c) for c in RESULT])


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, one for each text, with the columns of ``docs`` as they are."""
    kept = _decided(docs, key, text).filter("__kept")
    same = ["__keep_id", "__text_sha256"]
    again = cut(
        kept.filter("__group_size > 1").groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select(*[F.col(c).alias(f"again{c}") for c in same]),
        "again",
    )
    if again.isEmpty():
        return kept.select(*added(docs))
    both = [kept[c].eqNullSafe(again[f"again{c}"]) for c in same]
    once = kept.join(again, both, "left_anti")
    first = kept.join(again, both, "left_semi").dropDuplicates(same)
    return once.unionByName(first).select(*added(docs))
