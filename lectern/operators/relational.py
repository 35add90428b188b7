"""The relational pieces that the jobs share."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.stored import stored

#: Bits that monotonically_increasing_id gives to the place in a partition.
_PLACE = 33


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in order. An aggregate, so map tasks drop most repeats before the shuffle."""
    others = [k for k in df.columns if k not in keys]
    row = F.min_by(F.struct(*others), F.struct(*order)) if others else F.lit(None)
    return df.groupBy(*keys).agg(row.alias("_row")).select(*[k if k in keys else F.col(f"_row.{k}") for k in df.columns])


def worked_out(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with more columns, each worked out once a row: filters on them come after, where a plain projection has them copied into the filter."""
    return df.select("*", F.inline_outer(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def top_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def forward_filled(df: DataFrame, keys: list[str], order: list[str], column: str, into: str) -> DataFrame:
    """The last non-null value of column up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.last(column, ignorenulls=True).over(w))


def first_of_group(df: DataFrame, keys: list[str], order: list[str], group: Column, into: str) -> DataFrame:
    """True where the group differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_g", group).withColumn(into, ~F.col("_g").eqNullSafe(F.lag("_g").over(w)) | (F.row_number().over(w) == 1)).drop("_g")


def joined_text(order: Column, text: Column, separator: str = "\n") -> Column:
    """Aggregate: the group's texts in order, joined. Nulls are left out."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def distinct_in_order(values: Column) -> Column:
    """Different non-empty values of an array, in order."""
    return F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != "")))


def counts_and_flags(df: DataFrame, keys: list[str], counts: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """For each key how many rows a condition holds for, and whether it holds for any; a null condition doesn't hold."""
    return df.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in counts.items()), *(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in flags.items()))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from the columns of df."""
    held = {x.lower() for x in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


def sorted_parts(df: DataFrame, order: list[Column | str], part: str, at: str) -> DataFrame:
    """df sorted over all partitions, written, with the number of each row's partition and its place in it from 0.

    A range partitioning by the order, then a sort inside each partition. Equal keys meet in one partition, so a key
    that many rows have should be followed by one that tells them apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (held,) = unused(df, "n")
    spread = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(held, F.monotonically_increasing_id())
    return stored(spread.withColumns({part: F.shiftright(held, _PLACE), at: F.col(held).bitwiseAND((1 << _PLACE) - 1)}).drop(held), "sorted")


def _carried(rows: DataFrame, part: str, at: str, keys: list[str], near: str, far: str, over: Callable[[Column], Column]) -> DataFrame:
    """rows with ``far``: what ``over`` makes of each field of the struct near at the ends of the ranges before that end
    with the same key; null where no key goes on.

    near: what each row's key has come to up to it inside the range. Two rows a range are looked at.
    """
    (pos,) = unused(rows, "pos")
    fields = rows.schema[near].dataType.fieldNames()
    tail = rows.groupBy(part).agg(F.max_by(F.struct(*keys, near), at).alias(far)).select(part, *(F.col(f"{far}.{k}").alias(k) for k in keys), F.col(f"{far}.{near}").alias(far), F.lit(1).alias(pos))
    head = rows.where(F.col(at) == 0).select(part, *keys, F.lit(None).cast(rows.schema[near].dataType).alias(far), F.lit(0).alias(pos))
    before = Window.partitionBy(*keys).orderBy(part, pos).rowsBetween(Window.unboundedPreceding, -1)
    come = F.struct(*(over(F.col(f"{far}.{f}")).over(before).alias(f) for f in fields))
    carried = head.unionByName(tail).withColumn(far, come).where(F.col(pos) == 0).drop(pos)
    same = [F.col(f"l.{part}") == F.col(f"r.{part}"), *(F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys)]
    joined = rows.alias("l").join(F.broadcast(carried.alias("r")), reduce(Column.__and__, same), "left")
    return joined.select(*(F.col(f"l.`{c}`") for c in rows.columns), F.col(f"r.{far}"))


def ranked(df: DataFrame, order: list[Column | str], into: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Numbers the rows, or those of each key, from 1 in the given order, as a window would, without gathering them.

    The rows of earlier partitions are counted and added to the place in the own one; the only windows that aren't
    inside a partition run over one or two rows a partition. Rows that the order doesn't tell apart get following
    numbers in no set order; an empty df gives no rows.
    """
    part, at, near, far = unused(df, "part", "at", "near", "far")
    rows = sorted_parts(df, [*keys, *order], part, at)
    if keys:
        place = F.row_number().over(Window.partitionBy(part, *keys).orderBy(at)).cast("bigint")
        numbered = stored(rows.withColumn(near, F.struct(place.alias("n"))), "numbered")
        seen = _carried(numbered, part, at, keys, near, far, F.sum).withColumns({near: F.col(f"{near}.n"), far: F.col(f"{far}.n")})
    else:
        earlier = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
        counts = rows.groupBy(part).count().select(part, earlier.alias(far))
        seen = rows.join(F.broadcast(counts), part).withColumn(near, F.col(at) + 1)
    return seen.select(*(F.col(f"`{c}`") for c in df.columns if c != into), (F.col(near) + F.coalesce(F.col(far), F.lit(0))).alias(into))


def forward_filled_by_ranges(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column]) -> DataFrame:
    """``forward_filled`` of several values at once (name: value), for keys of any size: one with all rows is many tasks.

    Rows are sorted over all partitions; each range fills inside itself; the last values of the last key of a range are
    carried to where that key goes on. What is carried is two rows a range. Rows of a key should differ in the order.
    """
    part, at, near, far = unused(df, "part", "at", "near", "far")
    rows = sorted_parts(df, [*keys, *order], part, at)
    own = Window.partitionBy(part, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    fields = {f"v{i}": n for i, n in enumerate(values)}
    filled = stored(rows.withColumn(near, F.struct(*(F.last(v, ignorenulls=True).over(own).alias(f) for f, v in zip(fields, values.values())))), "filled")
    seen = _carried(filled, part, at, keys, near, far, lambda x: F.last(x, ignorenulls=True))
    return seen.select(*(F.col(f"`{c}`") for c in df.columns if c not in values), *(F.coalesce(f"{near}.{f}", f"{far}.{f}").alias(n) for f, n in fields.items()))


def first_of_group_by_ranges(df: DataFrame, keys: list[str], order: list[str], groups: dict[str, Column]) -> DataFrame:
    """``first_of_group`` for keys of any size and several groups at once (name: group): true where one differs from the row before.

    Each range looks at the row before inside itself; its first row looks at the last one of the range before.
    """
    part, at, now, last = unused(df, "part", "at", "now", "last")
    fields = F.struct(F.struct(*keys).alias("k"), F.struct(*(g.alias(f"g{i}") for i, g in enumerate(groups.values()))).alias("g"))
    rows = sorted_parts(df.withColumn(now, fields), [*keys, *order], part, at)
    ends = rows.groupBy(part).agg(F.max_by(now, at).alias(last))
    ends = ends.select(part, F.lag(last).over(Window.orderBy(part)).alias(last))  # a row a range
    before = F.coalesce(F.lag(now).over(Window.partitionBy(part).orderBy(at)), F.when(F.col(at) == 0, F.col(last)))
    seen = rows.join(F.broadcast(ends), part).withColumn(last, before)
    new_key = F.col(last).isNull() | ~F.col(f"{last}.k").eqNullSafe(F.col(f"{now}.k"))
    flags = {name: new_key | ~F.col(f"{last}.g.g{i}").eqNullSafe(F.col(f"{now}.g.g{i}")) for i, name in enumerate(groups)}
    return seen.withColumns(flags).select(*(F.col(f"`{c}`") for c in df.columns if c not in groups), *groups)
