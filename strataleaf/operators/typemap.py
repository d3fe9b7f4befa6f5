"""Type facts: which of several types a position gets, and what a project's types look like."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.functions import typestrings as T
from strataleaf.functions.text import utf16_length


def arbitrate(candidates: DataFrame) -> DataFrame:
    """(relative_name, offset, type), one row per position, of candidates (relative_name, offset, type, seq, mode).

    The highest score wins, then the longest type in UTF-16 units, then the latest by seq. An
    'overwrite' candidate that isn't `any` replaces what came before and starts the race anew; only
    its successors compete. Negative and null offsets and rejected types take no part. One shuffle
    on the position, for the window and the aggregate share its partitioning.
    """
    over = F.coalesce(F.col("mode") == "overwrite", F.lit(False))
    valid = (F.col("offset") >= 0) & F.col("type").isNotNull() & (F.col("type") != "") & F.when(over, F.col("type") != "any").otherwise(~T.is_rejected(F.col("type")))
    position = Window.partitionBy("relative_name", "offset")
    since = F.max(F.when(over, F.col("seq"))).over(position)
    live = candidates.where(valid).withColumn("since", since).where("since IS NULL OR seq >= since")
    rank = F.struct(T.score(F.col("type")), utf16_length(F.col("type")), F.col("seq"))
    return live.groupBy("relative_name", "offset").agg(F.max_by("type", rank).alias("type"))


def project_metrics(typemap: DataFrame, by: str = "project") -> DataFrame:
    """Per project: entries, distinct types, a count of each class, and complex types."""
    named = typemap.withColumn("_class", T.classify(F.col("type")))
    counts = [F.count_if(F.col("_class") == c).alias(c) for c in T.CLASSES]
    out = named.groupBy(by).agg(F.count("*").alias("entries"), F.countDistinct("type").alias("unique_types"), *counts)
    return out.withColumn("complex_types", F.col("objectTypes") + F.col("functionTypes") + F.col("genericTypes") + F.col("unionTypes"))


def totals(metrics: DataFrame) -> DataFrame:
    """Sums over projects; unique_types is the sum of the projects' distinct counts."""
    return metrics.agg(*[F.sum(c).alias(c) for c in ("entries", "unique_types", *T.CLASSES, "complex_types")])


def throughput(metrics: DataFrame) -> DataFrame:
    """metrics (entries, source_bytes, millis) with entries per KB and per millisecond; divisors are at least 1."""
    rate = lambda n: F.round(F.col("entries") / F.greatest(n, F.lit(1)), 2)
    return metrics.withColumns({"entries_per_kb": rate(F.col("source_bytes") / 1024), "entries_per_ms": rate(F.col("millis"))})


def variable_metrics(variables: DataFrame) -> DataFrame:
    """One row over variables (type): total, inferred, any and the inference rate in percent. Each variable counts once."""
    kind = T.category(F.col("type"))
    out = variables.agg(F.count("*").alias("total"), F.count_if(kind != "any").alias("inferred"), F.count_if(kind == "any").alias("any_types"))
    return out.withColumn("inference_rate", F.when(F.col("total") > 0, F.round(F.col("inferred") * 100 / F.col("total"), 2)).otherwise(0.0))


def category_distribution(variables: DataFrame) -> DataFrame:
    """(category, n), most frequent first, then by name."""
    return variables.groupBy(T.category(F.col("type")).alias("category")).agg(F.count("*").alias("n")).where("category <> 'any'").orderBy(F.desc("n"), "category")


def top_types(types: DataFrame, n: int = 20, column: str = "type") -> DataFrame:
    """(type, n) of the n most frequent types; equal counts by name. A top-k, so no total sort."""
    return types.groupBy(F.col(column).alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(n)


def unresolved_ratio(typemap: DataFrame, *by: str) -> DataFrame:
    """Per group: entries, unresolved entries, and their ratio; of nothing 0."""
    bad = F.count_if(T.counts_as_unresolved(F.col("type")))
    return typemap.groupBy(*by).agg(F.count("*").alias("entries"), bad.alias("unresolved"), (bad / F.greatest(F.count("*"), F.lit(1))).alias("ratio"))


def at_offsets(nodes: DataFrame, typemap: DataFrame) -> DataFrame:
    """nodes with the type at their start, or null: an equi-join on file and offset."""
    there = typemap.select("relative_name", F.col("offset").alias("start"), "type")
    return nodes.join(there, ["relative_name", "start"], "left")
