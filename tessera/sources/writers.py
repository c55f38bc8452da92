"""Sinks, and statistics of what they wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_index(postings: DataFrame, path: str, key: str = "term") -> None:
    """Postings as Parquet, ranged and sorted by key so that a lookup reads few row groups."""
    postings.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """Triples ranged and sorted by predicate and object, which pattern scans filter on."""
    triples.repartitionByRange("predicate", "object").sortWithinPartitions("predicate", "object").write.mode("overwrite").parquet(path)


def statistics(df: DataFrame) -> DataFrame:
    """(name, n, n_null, n_distinct, low, high) of each column, values as text: one pass and one row for each column."""
    made = [f for c in df.columns for f in (F.count(F.lit(1)), F.count_if(F.col(f"`{c}`").isNull()), F.count_distinct(F.col(f"`{c}`")), F.min(F.col(f"`{c}`")).cast("string"), F.max(F.col(f"`{c}`")).cast("string"))]
    fields = ("n", "n_null", "n_distinct", "low", "high")
    row = df.agg(*(f.alias(f"__{i}") for i, f in enumerate(made)))
    each = [F.struct(F.lit(c).alias("name"), *(F.col(f"__{5 * k + i}").alias(f) for i, f in enumerate(fields))) for k, c in enumerate(df.columns)]
    return row.select(F.inline(F.array(*each)))


def append_report(measures: DataFrame, path: str) -> None:
    measures.write.mode("append").parquet(path)


def shown(df: DataFrame, rows: int = 20, width: int = 32) -> str:
    """A table of text: nulls as `?`, values wider than width cut to width - 3 characters and `...`. Rows are limited on the cluster."""
    found = df.limit(rows).collect()
    cells = [[str(c) for c in df.columns], *[["?" if v is None else str(v) for v in r] for r in found]]
    cells = [[v if len(v) <= width else v[: width - 3] + "..." for v in r] for r in cells]
    sizes = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    line = lambda r: "| " + " | ".join(v.ljust(n) for v, n in zip(r, sizes, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (n + 2) for n in sizes) + "|", *map(line, cells[1:])])


def shape(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)
