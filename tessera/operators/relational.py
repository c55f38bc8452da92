"""Positional relational algebra on DataFrames.

Columns are addressed by position because a join keeps both sides' names, which may repeat. Each operator returns a lazy
DataFrame; nothing is collected. An order is only kept where a caller asks for one.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

#: Pairs of rows that a task of join_many makes, about; and the most tasks it asks for, which beyond that make more.
PAIRS_A_TASK, MOST_TASKS = 16_000_000, 10_000

JOINS = {"inner": "inner", "left_outer": "left", "right_outer": "right"}
Aggregate = Callable[[Column], Column]


def _checked(df: DataFrame, columns: Sequence[int]) -> None:
    if not columns:
        raise ValueError("at least one column is needed")
    if bad := [c for c in columns if not 0 <= c < len(df.columns)]:
        raise IndexError(f"no columns {bad} among {len(df.columns)}")


def _numbered(df: DataFrame, prefix: str = "c") -> DataFrame:
    """df with names that differ."""
    return df.toDF(*(f"__{prefix}{i}" for i in range(len(df.columns))))


def column(df: DataFrame, at: int) -> Column:
    """Column at a position, for predicates; names must differ (see with_unique_names)."""
    return F.col(f"`{df.columns[at]}`")


def with_unique_names(df: DataFrame) -> DataFrame:
    """Repeated names get their position appended."""
    seen: set[str] = set()
    names = []
    for i, c in enumerate(df.columns):
        names.append(f"{c}_{i}" if c.lower() in seen else c)
        seen.add(names[-1].lower())
    return df.toDF(*names)


def project(df: DataFrame, columns: Sequence[int], distinct: bool = False) -> DataFrame:
    _checked(df, columns)
    flat = _numbered(df).select(*(F.col(f"__c{i}").alias(f"__p{k}") for k, i in enumerate(columns)))
    return (flat.distinct() if distinct else flat).toDF(*(df.columns[i] for i in columns))


def project_first(df: DataFrame, columns: Sequence[int], position: str) -> DataFrame:
    """Distinct rows with the place of their first occurrence, for callers that keep an order in column position."""
    _checked(df, columns)
    names = [df.columns[i] for i in columns]
    return df.groupBy(*(F.col(f"`{n}`") for n in names)).agg(F.min(position).alias(position))


def with_position(df: DataFrame, name: str = "__pos") -> DataFrame:
    """df with the place of each row as it was read; of use right after a scan only."""
    return df.withColumn(name, F.monotonically_increasing_id())


def select(df: DataFrame, predicate: Column | Callable[[DataFrame], Column]) -> DataFrame:
    return df.filter(predicate(df) if callable(predicate) and not isinstance(predicate, Column) else predicate)


def select_rows(df: DataFrame, predicate: Callable[[tuple], bool]) -> DataFrame:
    """Rows for which an opaque function of the row's values holds. It runs in Python, a batch at a time; expressions are faster."""
    names = df.columns

    @F.pandas_udf("boolean")
    def keep(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(predicate(tuple(None if v is None or v != v else v for v in r))) for r in rows.itertuples(index=False, name=None)])

    return df.filter(keep(F.struct(*(F.col(f"`{c}`") for c in names))))


def join(left: DataFrame, right: DataFrame, left_columns: int | Sequence[int], right_columns: int | Sequence[int], how: str = "inner") -> DataFrame:
    """Equi-join on one or more pairs of columns; all columns of both sides, left first. Null keys match nothing."""
    if how not in JOINS:
        raise ValueError(f"how must be one of {', '.join(JOINS)}")
    ls, rs = ([x] if isinstance(x, int) else list(x) for x in (left_columns, right_columns))
    _checked(left, ls)
    _checked(right, rs)
    if len(ls) != len(rs):
        raise ValueError("both sides need as many key columns")
    a, b = _numbered(left, "l"), _numbered(right, "r")
    on = [F.col(f"__l{i}") == F.col(f"__r{j}") for i, j in zip(ls, rs, strict=True)]
    return a.join(b, on, JOINS[how]).toDF(*left.columns, *right.columns)


def join_many(left: DataFrame, right: DataFrame, left_columns: int | Sequence[int], right_columns: int | Sequence[int]) -> DataFrame:
    """As join, inner, for keys that repeat on both sides, where a few keys can hold most of the pairs.

    The pairs are counted first, by keys. More than a task makes are dealt out by their number, which the bytes of the sides
    don't show: a key with more than that has its rows of both sides cut into blocks by hash, each two of which meet in a task.
    Equalities that a later select adds become keys of the join too, and Spark then deals over spark.sql.shuffle.partitions tasks.
    """
    ls, rs = ([x] if isinstance(x, int) else list(x) for x in (left_columns, right_columns))
    plain = join(left, right, ls, rs)
    a, b = _numbered(left, "l"), _numbered(right, "r")
    keys = [f"__k{n}" for n in range(len(ls))]
    count = lambda df, at, name: df.groupBy(*(F.col(c).alias(k) for c, k in zip(at, keys, strict=True))).agg(F.count(F.lit(1)).alias(name))
    a_keys, b_keys = [f"__l{i}" for i in ls], [f"__r{j}" for j in rs]
    counts = count(a, a_keys, "__na").join(count(b, b_keys, "__nb"), keys).withColumn("__pairs", F.col("__na").cast("double") * F.col("__nb"))
    hot = F.when(F.col("__pairs") > PAIRS_A_TASK, F.struct(*keys, "__na", "__nb"))
    total, found = counts.agg(F.sum("__pairs"), F.collect_list(hot)).first()  # type: ignore[misc]  # fewer hot keys than tasks
    if (total or 0) <= PAIRS_A_TASK:
        return plain
    tasks, block = min(MOST_TASKS, math.ceil(total / PAIRS_A_TASK)), math.isqrt(PAIRS_A_TASK)
    cells: list[str] = []
    if found:
        cells = ["__i", "__j"]
        schema = T.StructType([*(T.StructField(k, left.schema[i].dataType) for k, i in zip(keys, ls, strict=True)), T.StructField("__na", T.LongType()), T.StructField("__nb", T.LongType())])
        sizes = F.broadcast(left.sparkSession.createDataFrame([tuple(r) for r in found], schema))
        a, b = _in_blocks(a, a_keys, sizes, keys, ("__na", "__nb"), cells, block), _in_blocks(b, b_keys, sizes, keys, ("__nb", "__na"), cells[::-1], block)
    # a number of partitions that is given is kept; others are merged until they have enough bytes
    a, b = a.repartition(tasks, *a_keys, *cells), b.repartition(tasks, *b_keys, *cells)
    on = [a[x] == b[y] for x, y in zip([*a_keys, *cells], [*b_keys, *cells], strict=True)]
    joined = a.join(b.hint("merge"), on)
    return joined.select(*(a[f"__l{i}"] for i in range(len(left.columns))), *(b[f"__r{i}"] for i in range(len(right.columns)))).toDF(*left.columns, *right.columns)


def _in_blocks(df: DataFrame, at: list[str], sizes: DataFrame, keys: list[str], counts: tuple[str, str], cells: list[str], block: int) -> DataFrame:
    """df with the cells of a grid of its own blocks, one for each row, and the other side's, all of them; cold keys have one."""
    own, other = (F.coalesce(F.ceil(F.col(c) / block), F.lit(1)) for c in counts)
    hashed = F.xxhash64(*(F.col(c) for c, kind in df.dtypes if "map<" not in kind))
    met = df.join(sizes, [F.col(c) == F.col(k) for c, k in zip(at, keys, strict=True)], "left")
    return met.select(*df.columns, F.pmod(hashed, own).alias(cells[0]), F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias(cells[1]))


def cross(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs of rows; for small tables."""
    return _numbered(left, "l").crossJoin(_numbered(right, "r")).toDF(*left.columns, *right.columns)


def order_by(df: DataFrame, column: int, ascending: bool = True, then: Sequence[int] = ()) -> DataFrame:
    """Nulls first ascending, last descending; `then` settles ties, ascending."""
    _checked(df, [column, *then])
    names = df.columns
    flat = _numbered(df)
    key = F.col(f"__c{column}")
    return flat.orderBy(key.asc_nulls_first() if ascending else key.desc_nulls_last(), *(F.col(f"__c{i}").asc_nulls_first() for i in then)).toDF(*names)


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 1:
        raise ValueError("n must be positive")
    return df.limit(n)


def rename(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.toDF(*names)


def group_by(df: DataFrame, columns: Sequence[int], aggregates: Sequence[tuple[int, Aggregate]]) -> DataFrame:
    """One row for each combination of values, null being one; then the aggregates, named as their columns."""
    _checked(df, columns)
    if not aggregates:
        raise ValueError("at least one aggregate is needed")
    _checked(df, [c for c, _ in aggregates])
    if len(set(columns)) < len(columns) or {c for c, _ in aggregates} & set(columns):
        raise ValueError("group columns must differ from each other and from aggregated ones")
    flat = _numbered(df)
    out = flat.groupBy(*(f"__c{i}" for i in columns)).agg(*(fn(F.col(f"__c{i}")).alias(f"__a{k}") for k, (i, fn) in enumerate(aggregates)))
    return out.toDF(*(df.columns[i] for i in columns), *(df.columns[i] for i, _ in aggregates))


# Aggregates for group_by; text columns are cast where a number is needed.


def count_rows(c: Column) -> Column:
    return F.count(F.lit(1))


def count_values(c: Column) -> Column:
    return F.count(c)


def total(c: Column) -> Column:
    return F.sum(c.try_cast("double"))


def integer_sum(c: Column) -> Column:
    return F.sum(c.try_cast("long"))


def integer_product(c: Column) -> Column:
    return F.product(c.try_cast("double")).cast("long")


def mean(digits: int = 2, null_as_zero: bool = False) -> Aggregate:
    """Rounded average; nulls are skipped, or count as zero."""

    def fn(c: Column) -> Column:
        c = c.try_cast("double")
        return F.round(F.avg(F.coalesce(c, F.lit(0.0)) if null_as_zero else c), digits)

    return fn


def maximum(c: Column) -> Column:
    return F.max(c.try_cast("double"))


def joined(separator: str = ", ") -> Aggregate:
    """Values in order, as one string."""
    return lambda c: F.array_join(F.array_sort(F.collect_list(c)), separator)


def top_with_ties(df: DataFrame, group: Sequence[str], value: str, label: str, separator: str = "; ") -> DataFrame:
    """For each group the greatest value and all labels that have it, in order: two aggregations, no window over a group."""
    best = df.groupBy(*group).agg(F.max(value).alias("__best"))
    tied = df.join(best, list(group)).where(F.col(value) == F.col("__best"))
    return tied.groupBy(*group).agg(F.max("__best").alias(value), F.array_join(F.array_sort(F.collect_set(label)), separator).alias(label))


def top_with_one(df: DataFrame, group: Sequence[str], value: str, label: str) -> DataFrame:
    """For each group the greatest value and one label that has it: the first in order, where SQL leaves the choice open."""
    best = F.max_by(F.col(label), F.col(value))
    tied = df.groupBy(*group, value).agg(F.min(label).alias(label))  # one row for each value, so that the pick is determined
    return tied.groupBy(*group).agg(F.max(value).alias(value), best.alias(label))


def opaque(fn: Callable[[pd.Series], object], kind: str) -> Aggregate:
    """An aggregate for group_by from any function of a group's values, nulls included. It runs in Python on a whole group at a
    time, so groups must fit in a task; prefer the aggregates above."""

    def aggregate(values: pd.Series) -> Any:
        return fn(values)

    return F.pandas_udf(aggregate, kind)  # type: ignore[call-overload,return-value]


def top_then_lookup(ranked: DataFrame, order: Sequence[Column], n: int, other: DataFrame, key: str) -> DataFrame:
    """The first n rows, then a join on a key that occurs exactly once in other: as the join first, but over n rows."""
    return ranked.orderBy(*order).limit(n).join(other, key)


def same_bag(a: DataFrame, b: DataFrame) -> bool:
    """Equal rows, with repetitions, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def numbered_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
