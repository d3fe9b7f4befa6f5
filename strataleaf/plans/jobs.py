"""Whole jobs: from a source tree to tables."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataleaf.functions import paths, text
from strataleaf.operators import relational, slices, syntactic_types, tree, typemap
from strataleaf.operators.ejs import transformed
from strataleaf.sources import files, frontends, sinks


def prepared(source: DataFrame) -> DataFrame:
    """source files with what their front end is given: `kind`, `candidates` of components, `code` of templates and scripts."""
    kind = paths.dispatch(F.col("path"))
    component = F.when(kind == "component", text.parse_candidates(F.col("content")))
    code = F.coalesce(transformed(F.when(kind == "template", F.col("content"))), F.when(kind == "code", F.col("content")))
    return source.select("path", "rel_path", "length", kind.alias("kind"), component.alias("candidates"), code.alias("code"))


def scan_job(spark: SparkSession, root: str, output: str, kind: str = "script", chain: Sequence[tuple[str, frontends.FrontEnd]] = ()) -> None:
    """Scan a tree and write tables under output: prepared files; with a chain of parsers also trees, nodes and failures.

    Scripts that a tsconfig.json below root names are taken too, even where the scan leaves them out.
    """
    source = files.files_like(spark, root, "*.vue") if kind == "component" else files.source_files(spark, root)
    config = Path(root) / "tsconfig.json"
    if kind != "component" and config.is_file():
        named = files.configured_files(files.files_like(spark, root, "*"), files.read_tsconfig(config), root)
        source = relational.anti_merge(source, named, "path")
    prepared(source).write.mode("overwrite").parquet(f"{output}/prepared")
    if not chain:
        return
    ready = spark.read.parquet(f"{output}/prepared")
    code = frontends.parse(ready.where("kind <> 'component'").select("path", F.col("code").alias("content")), chain)
    parts = frontends.parse_components(ready.where("kind = 'component'"), chain)
    code.unionByName(parts).write.mode("overwrite").parquet(f"{output}/parsed")
    parsed = spark.read.parquet(f"{output}/parsed")
    named = parsed.where("result IS NOT NULL").select(F.col("path").alias("full_name"), paths.relative(F.col("path"), root).alias("relative_name"), F.col("result").alias("ast_json"))
    named.write.mode("overwrite").parquet(f"{output}/ast_documents")
    tree.nodes(spark.read.parquet(f"{output}/ast_documents")).write.mode("overwrite").parquet(f"{output}/ast_nodes")
    frontends.failures(parsed).write.mode("overwrite").parquet(f"{output}/failures")


def export_job(spark: SparkSession, output: str, types: bool = True) -> dict[str, int]:
    """One file per source, from the tables of a scan with a parser: its tree in its wrapper, .json, and with types its typemap, .typemap.

    output must be a folder that all executors share. How many files of each kind were written.
    """
    trees = spark.read.parquet(f"{output}/ast_documents")
    wrote = {".json": sinks.export(sinks.ast_documents(trees), output, ".json")}
    if types:
        type_job(syntactic_types.type_candidates(trees), output)
        wrote[".typemap"] = sinks.export(sinks.typemap_documents(spark.read.parquet(f"{output}/typemap")), output, ".typemap")
    return wrote


def type_job(candidates: DataFrame, output: str) -> None:
    """Type candidates to the typemap and its unresolved ratio per file."""
    spark = candidates.sparkSession
    typemap.arbitrate(candidates).write.mode("overwrite").parquet(f"{output}/typemap")
    typemap.unresolved_ratio(spark.read.parquet(f"{output}/typemap"), "relative_name").write.mode("overwrite").parquet(f"{output}/unresolved")


def slice_job(dumps: DataFrame, route_files: DataFrame, output: str) -> None:
    """Slices of compiler dumps (dump, file_ord, content) and routes of route files (file_ord, content), as tables.

    Of several dumps of one source file the last stays; a dump that names no source file stands for its own path.
    """
    found = slices.slices(relational.file_lines(dumps.select("dump", "content")))
    keyed = found.join(dumps.select("dump", "file_ord"), "dump").withColumn("source_file", F.coalesce("source_file", paths.slice_key(F.col("dump"))))
    relational.last_writer(keyed, "source_file", ["file_ord"], ["tags", "used_types", "literals"]).write.mode("overwrite").parquet(f"{output}/slices")
    slices.distinct_routes(slices.routes(relational.file_lines(route_files))).write.mode("overwrite").parquet(f"{output}/routes")


def slices_from_tree(spark: SparkSession, root: str, output: str, dump_command: Sequence[str], timeout: float | None = None) -> Path:
    """Slices of the compiled artefacts below root, dumped by a command, and of its route files: tables under output, and one document, slices.json."""
    found = files.artefacts(spark, root)
    dumped = frontends.command_on_paths(found["tasty"].select("path"), dump_command, timeout)
    dumped.write.mode("overwrite").parquet(f"{output}/dumped")
    dumped = spark.read.parquet(f"{output}/dumped")
    frontends.failures(dumped).write.mode("overwrite").parquet(f"{output}/failures")
    # the order of files, by path, decides which of several dumps of a source stays
    dumps = dumped.where("result IS NOT NULL").select(paths.relative(F.col("path"), root).alias("dump"), F.col("path").alias("file_ord"), F.col("result").alias("content"))
    slice_job(dumps, found["routes"].select(F.col("path").alias("file_ord"), "content"), output)
    document = sinks.slices_document(spark.read.parquet(f"{output}/slices"), spark.read.parquet(f"{output}/routes"))
    to = Path(output) / "slices.json"
    to.write_text(document.first().document, encoding="utf-8")  # one document for the whole project, as its readers expect
    return to
