"""Results written out: tables, and one file per source for tools that expect files."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ast_documents(trees: DataFrame) -> DataFrame:
    """(relative_name, document): each tree (full_name, relative_name, ast_json) in its wrapper, as JSON text."""
    named = F.to_json(F.struct(F.col("full_name").alias("fullName"), F.col("relative_name").alias("relativeName")))
    return trees.select("relative_name", F.concat(F.substring(named, 1, F.length(named) - 1), F.lit(',"ast":'), "ast_json", F.lit("}")).alias("document"))


def typemap_documents(typemap: DataFrame) -> DataFrame:
    """(relative_name, document): offsets to types as JSON, by ascending offset; files without types have none. A repeated offset fails."""
    entries = F.array_sort(F.collect_list(F.struct("offset", "type")))
    return typemap.groupBy("relative_name").agg(F.to_json(F.map_from_entries(entries)).alias("document"))


def slices_document(slices: DataFrame, routes: DataFrame) -> DataFrame:
    """One row: {"config": {"routes": [...]}, "<source file>": {...}}. A source file named config keeps its own key beside it."""
    ordered = F.sort_array(F.collect_list(F.struct("file_ord", "line_no", "part", "method", "pattern", F.col("controller_method").alias("controllerMethod"))))
    told = F.transform(ordered, lambda x: F.struct(x["method"].alias("method"), x["pattern"].alias("pattern"), x["controllerMethod"].alias("controllerMethod")))
    r = routes.agg(F.to_json(F.struct(told.alias("routes"))).alias("config"))
    body = F.to_json(F.struct(F.col("source_file").alias("sourceFile"), "tags", F.col("used_types").alias("usedTypes"), "literals"))
    one = slices.where("source_file IS NOT NULL").select(F.concat(F.to_json(F.array("source_file")), F.lit("")).alias("k"), body.alias("v"))
    key = F.substring(F.col("k"), 2, F.length("k") - 2)
    s = one.agg(F.array_join(F.array_sort(F.collect_list(F.concat(key, F.lit(":"), "v"))), ",").alias("files"))
    return r.crossJoin(s).select(F.concat(F.lit('{"config":'), "config", F.when(F.col("files") != "", F.concat(F.lit(","), "files")).otherwise(""), F.lit("}")).alias("document"))


def export(documents: DataFrame, folder: str, suffix: str) -> int:
    """Write one file per row (relative_name, document) to a folder that all executors share; how many. Overwrites, so a repeated task does no harm."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["relative_name"], pdf["document"], strict=True):
                to = Path(folder) / f"{name}{suffix}"
                to.parent.mkdir(parents=True, exist_ok=True)
                to.write_text(text, encoding="utf-8")
            yield pd.DataFrame({"n": [len(pdf)]})

    return documents.select("relative_name", "document").mapInPandas(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n


def snapshot_or_compare(current: DataFrame, path: str, keys: list[str], value: str, update: bool = False) -> DataFrame | None:
    """Write a snapshot if there is none or update is set, and return None; else what differs from it."""
    from strataleaf.operators.relational import snapshot_diff

    spark = current.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if update or not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        current.write.mode("overwrite").parquet(path)
        return None
    return snapshot_diff(spark.read.parquet(path), current, keys, value)


def report_document(results: DataFrame) -> DataFrame:
    """One row, a report as JSON: {"summary": {total, passed, failed, passRate}, "results": [...]} of results (name, passed, ...), by name."""
    from strataleaf.operators.relational import summary

    ok = F.col("passed")
    rate = F.round(ok * 100 / F.greatest(F.col("total"), F.lit(1)), 2)
    head = summary(results).select(F.to_json(F.struct("total", "passed", "failed", rate.alias("passRate"))).alias("summary"))
    rest = results.agg(F.to_json(F.array_sort(F.collect_list(F.struct("name", *[c for c in results.columns if c != "name"])))).alias("results"))
    return head.crossJoin(rest).select(F.concat(F.lit('{"summary":'), "summary", F.lit(',"results":'), "results", F.lit("}")).alias("document"))


def report_lines(metrics: DataFrame, title: str) -> DataFrame:
    """(line_no, line): a report as text over one row of metrics: a title, a rule, and `name: value` of each column."""
    body = F.array(*[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in metrics.columns])
    lines = F.concat(F.array(F.lit(title), F.lit("=" * len(title))), body)
    return metrics.limit(1).select(F.posexplode(lines).alias("line_no", "line"))
