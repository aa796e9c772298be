"""As-of join: for each row the last row of another table before its time.

A window over each key's whole history would put a hot key into one task.  Here histories are cut into
slots of time (a day, a year): the last row of every (key, slot) is a plain aggregate, the value
carried into a slot comes from a window over that small table (one row per key and slot), and inside
a slot a window over its own rows finds what is newer than the carried value.  Both tables are
shuffled once, by key and slot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order of rows of one time: the carried value first, then left before right if only earlier rows count.
CARRIED, STRICT_LEFT, RIGHT, LOOSE_LEFT = 0, 1, 2, 3


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str],
              strict: bool = True, tie: str | None = None, slot: Callable[[Column], Column] = F.to_date) -> DataFrame:
    """``left`` with the ``values`` of the last ``right`` row of the same ``on`` columns whose
    ``right_time`` is before ``left_time`` (at or before it, if not ``strict``).

    Of right rows of one time the one with the largest ``tie`` counts (then the largest values).  Every left
    row stays, once; a NULL in its key or time finds nothing, as does a key without an earlier row (NULLs).
    Right rows with a NULL key or time are never found.  ``slot`` must not fall with time; a finer
    one cuts a hot key's history into smaller tasks.
    """
    keys = [f"_k{i}" for i in range(len(on))]
    none = F.lit(None)
    value_type = right.select(F.struct(*[F.col(c) for c in values]).alias("v")).schema["v"].dataType
    row_type = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("r")).schema["r"].dataType
    tie_type = right.schema[tie].dataType if tie else "int"

    def part(df: DataFrame, time: str, side: int, tie_col: Column, value: Column, row: Column) -> DataFrame:
        return df.select(*[F.col(c).alias(k) for c, k in zip(on, keys)], F.col(time).alias("_t"), slot(F.col(time)).alias("_s"),
                         F.lit(side).alias("_side"), tie_col.cast(tie_type).alias("_tie"), value.alias("_v"), row.alias("_row"))

    mine = part(left, left_time, STRICT_LEFT if strict else LOOSE_LEFT, none, none.cast(value_type),
                F.struct(*[F.col(f"`{c}`") for c in left.columns]))
    known = right.dropna(subset=[*on, right_time])
    theirs = part(known, right_time, RIGHT, F.col(tie) if tie else none, F.struct(*[F.col(c) for c in values]), none.cast(row_type))
    # the last right row of every slot, for slots with left rows as well
    newest = F.max(F.when(F.col("_side") == RIGHT, F.struct("_t", "_tie", "_v")))
    slots = mine.select(*keys, "_t", "_s", "_side", "_tie", "_v").unionByName(
        theirs.select(*keys, "_t", "_s", "_side", "_tie", "_v")).groupBy(*keys, "_s").agg(
        newest.alias("_last"), F.count_if(F.col("_side") != RIGHT).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = (slots.withColumn("_c", F.last("_last", ignorenulls=True).over(earlier)).where("_c is not null and _n > 0")
               .select(*keys, F.lit(None).cast(mine.schema["_t"].dataType).alias("_t"), "_s", F.lit(CARRIED).alias("_side"),
                       F.lit(None).cast(tie_type).alias("_tie"), F.col("_c._v").alias("_v"),
                       none.cast(row_type).alias("_row")))
    theirs = theirs.withColumn("_t", F.col("_t").cast(mine.schema["_t"].dataType))
    inside = Window.partitionBy(*keys, "_s").orderBy(F.col("_t").asc_nulls_first(), "_side", F.col("_tie").asc_nulls_first(),
                                                     "_v").rowsBetween(Window.unboundedPreceding, 0)
    # a struct is never NULL on the right, so the last one is the last row, whatever its values
    found = mine.unionByName(theirs).unionByName(carried).withColumn("_found", F.last("_v", ignorenulls=True).over(inside))
    return found.where(F.col("_row").isNotNull()).select(
        *[F.col(f"_row.`{c}`") for c in left.columns], *[F.col("_found").getField(c).alias(c) for c in values])
