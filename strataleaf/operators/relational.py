"""The joins, sets and ordered steps between files, snapshots and expectations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anti_merge(scan: DataFrame, extra: DataFrame, key: str, order: Sequence[str] = ()) -> DataFrame:
    """scan, and the rows of extra whose key it lacks; sorted, if an order is given. Null keys of extra are kept: they equal nothing."""
    new = extra.join(scan.select(key), key, "left_anti")
    out = scan.unionByName(new.select(*scan.columns))
    return out.orderBy(*order) if order else out


def union_distinct(*scans: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """The distinct rows of all scans; sorted, if an order is given, as lists of files are."""
    out = scans[0]
    for s in scans[1:]:
        out = out.union(s)
    return out.distinct().orderBy(*order) if order else out.distinct()


def snapshot_diff(before: DataFrame, after: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., before, after) where the value differs or is on one side only. Nulls equal nulls."""
    b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_a"))
    out = b.join(a, keys, "full_outer").where(~F.col("before").eqNullSafe(F.col("after")) | F.col("_a").isNull() | F.col("_b").isNull())
    return out.select(*keys, "before", "after")


def first_mismatch(diff: DataFrame, keys: list[str]) -> DataFrame:
    return diff.orderBy(*keys).limit(1)


def expected_minimums(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """expected (keys..., min_count) with the actual n, 0 where missing, and whether it suffices."""
    out = expected.join(actual, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select(*keys, "min_count", "n", (F.col("n") >= F.col("min_count")).alias("passed"))


def incomplete(sources: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Sources without an output; empty if all is done."""
    return sources.join(outputs.select(key), key, "left_anti")


def keep_first(rows: DataFrame, keys: list[str], order: list[str], unless: Column | None = None) -> DataFrame:
    """Of rows with equal keys the first in order; rows for which `unless` holds are never repeats."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = nth == 1
    return rows.withColumn("_nth", first if unless is None else first | unless).where("_nth").drop("_nth")


def fill_down(rows: DataFrame, flag: Column, name: str, partition: list[str], order: str) -> DataFrame:
    """rows with `name`: the last flag that isn't null up to and including the row; false before the first."""
    so_far = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(flag, ignorenulls=True).over(so_far), F.lit(False)))


def last_writer(rows: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """Per key the row that comes last in order: an aggregate with partial results before the shuffle."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def chunk_number(rows: DataFrame, order: str, partition: list[str], size: int = 10) -> DataFrame:
    """rows with `chunk`: batches of `size` in order, per partition."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*partition).orderBy(order)) - 1) / size))


def file_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """(the other columns, line_no, line): lines split at line feeds, one carriage return of each dropped, trimmed."""
    others = [c for c in files.columns if c != content]
    out = files.select(*others, F.posexplode(F.split(content, "\n", -1)).alias("line_no", "line"))
    return out.withColumn("line", F.trim(F.regexp_replace("line", r"^([^\r]*)\r", "$1"), F.lit(" \t\x0b\x0c\r\u00a0\ufeff")))


def summary(results: DataFrame, passed: str = "passed") -> DataFrame:
    """(total, passed, failed) of test results."""
    ok = F.count_if(F.coalesce(F.col(passed), F.lit(False)))
    return results.agg(F.count("*").alias("total"), ok.alias("passed"), (F.count("*") - ok).alias("failed"))


def distinct_in_order(rows: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Per group the distinct values in the order of their first arrival."""
    seen = F.array_sort(F.collect_list(F.struct(order, value)))
    return rows.groupBy(*by).agg(F.array_distinct(F.transform(seen, lambda x: x[value])).alias(name))


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """left with columns of its first match in right, by order; nulls without one. right is reduced to one row per key before the join."""
    first = right.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_first"))
    return left.join(first, key, "left").select(*left.columns, "_first.*")
