"""What the operators share: tables, scratch tables, size-checked broadcasts, token counts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if its measured bytes stay below this; else the join shuffles.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; a cluster is refused, for
    executors there can't read the driver's disk.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="strataleaf-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def written(df: DataFrame, tag: str, also: Column | None = None) -> DataFrame:
    """df as a table in the shared folder, read again: computed once, its lineage cut.

    Its rows are counted while it is written, for small(); `also` is an aggregate taken on the way. Both
    are kept in _sl_seen.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataleaf-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), (F.max(F.lit(0)) if also is None else also).alias("also")).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sl_path, out._sl_seen = path, seen.get
    _made.append(path)
    return out


#: The scratch tables that this process has written.
_made: list[str] = []


def last_one_left(df: DataFrame, since: int) -> DataFrame:
    """df, a table that written() returned, with all scratch tables deleted that were made after the first `since` of made() but df's own."""
    for path in _made[since:]:
        if path != df._sl_path:
            _delete(df.sparkSession, path)
    _made[since:] = [df._sl_path]
    return df


def made() -> int:
    """How many scratch tables this process has written and not yet swept up."""
    return len(_made)


def spent(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that written() returned; nothing that still needs it may be computed later."""
    _delete(df.sparkSession, df._sl_path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def clean_up(spark: SparkSession) -> None:
    """Delete this application's scratch tables. Results that were not yet computed need them."""
    _delete(spark, f"{shared_dir(spark)}/strataleaf-{spark.sparkContext.applicationId}")


#: Bytes of a batch that goes to Python.
BATCH_BYTES = 8 << 20
_DEFAULT_BATCH = "67108864b"


def in_small_batches(df: DataFrame) -> DataFrame:
    """df itself; its session cuts batches for Python by bytes, at BATCH_BYTES, unless it was given a limit of its own.

    By Spark's defaults, long texts make batches that grow with them, on both sides.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == _DEFAULT_BATCH:
        conf.set(key, str(BATCH_BYTES))
    return df


def small(df: DataFrame, bytes_per_row: int, cap: int = BROADCAST_BYTES) -> DataFrame:
    """df, with a broadcast hint if its counted rows fit cap. df should be cheap to count: a written table, whose rows are known."""
    rows = getattr(df, "_sl_seen", {}).get("rows")
    return F.broadcast(df) if (df.count() if rows is None else rows) * bytes_per_row <= cap else df


def n_words(text: Column) -> Column:
    """Tokens of a text as maximal runs of anything but blank, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("long")


def n_words_sql(text: str) -> str:
    """n_words in DuckDB's SQL."""
    return f"CAST(COALESCE(len(regexp_extract_all({text}, '[^ \\t\\r\\n]+')), 0) AS BIGINT)"


def chunks(offsets, most: int, rows: int = 1 << 62):
    """Cut rows, given the offsets of their values, where a run of rows passes `most` values or `rows` rows: pairs of row numbers."""
    at, n = 0, len(offsets) - 1
    while at < n:
        # the last row that ends within `most` values of where this run begins, or the one row that is longer
        to = min(max(int(offsets.searchsorted(offsets[at] + most, "right")) - 1, at + 1), at + rows, n)
        yield at, to
        at = to
