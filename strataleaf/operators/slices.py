"""Usage slices: routes of web applications, and types and literals of compiler dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.operators.relational import fill_down, keep_first

METHODS = "DELETE GET HEAD OPTIONS PATCH POST PUT ->".split()
WILDCARD = "GET PATCH POST DELETE PUT".split()
#: Prefixes of used types and the tags they give.
TAG_RULES = {
    "database": ("play.db.", "slick.jdbc.", "slick.sql."),
    "framework": ("play.api.",),
    "framework-input": ("play.api.mvc.Request", "play.api.data.Form", "play.twirl.api"),
    "framework-output": ("play.api.mvc.Action", "play.api.mvc.Result", "play.twirl.api.Html"),
    "framework-route": ("play.api.routing.", "play.core.routing", "router.RoutesPrefix"),
}


def routes(lines: DataFrame) -> DataFrame:
    """(file_ord, line_no, part, method, pattern, controller_method) of route files' lines (file_ord, line_no, line).

    Comments, includes, static assets and lines that are no routes are left out; `->` stands for five
    methods. A route without a controller keeps a null one.
    """
    t = F.split(F.col("line"), r"\s+")
    parts = lines.where(~F.col("line").rlike("^[#+]")).select("file_ord", "line_no", t.alias("t")).where(F.size("t") >= 2)
    method, pattern = F.col("t")[0], F.col("t")[1]
    controller = F.substring_index(F.get("t", F.lit(2)), "(", 1)
    kept = (pattern != "/webjars") & F.upper(method).isin(*METHODS) & ~F.coalesce(controller, F.lit("")).startswith("webjars.")
    found = parts.where(kept).select("file_ord", "line_no", method.alias("m"), pattern.alias("pattern"), controller.alias("controller_method"))
    each = F.when(F.col("m") == "->", F.array(*map(F.lit, WILDCARD))).otherwise(F.array("m"))
    return found.select("file_ord", "line_no", F.posexplode(each).alias("part", "method"), "pattern", "controller_method")


def distinct_routes(found: DataFrame) -> DataFrame:
    """Of equal routes the first, over all files; routes with an empty or no controller are never repeats."""
    empty = F.coalesce(F.col("controller_method"), F.lit("")) == ""
    return keep_first(found, ["method", "pattern", "controller_method"], ["file_ord", "line_no", "part"], empty)


def literal(line: Column) -> Column:
    """What follows the last ': ', trimmed."""
    return F.trim(F.substring_index(line, ": ", -1))


def signature_types(line: Column) -> Column:
    """The types of the last signature on a line that count: longer than three and not of the standard library."""
    inside = F.substring_index(F.substring_index(line, " Signature(", -1), ") ", 1)
    bare = F.replace(F.replace(inside, F.lit("List("), F.lit("")), F.lit(")"), F.lit(""))
    names = F.transform(F.split(bare, ","), lambda t: F.trim(t))
    return F.filter(names, lambda t: (F.length(t) > 3) & ~t.rlike(r"^(java|javax\.inject|scala)\."))


def tags_of(types: Column) -> Column:
    """The tags that an array of types earns, sorted."""
    earned = []
    for tag, prefixes in sorted(TAG_RULES.items()):
        earned.append(F.when(_any_starts(types, prefixes), F.array(F.lit(tag))).otherwise(F.array().cast("array<string>")))
    return F.concat(*earned)


def _any_starts(types: Column, prefixes: tuple[str, ...]) -> Column:
    return F.exists(types, lambda t: _starts(t, prefixes))


def _starts(t: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | t.startswith(p)
    return out


def prefix_tags(types: DataFrame, rules: DataFrame, column: str) -> DataFrame:
    """types joined with rules (prefix, tag) by prefix. Spark broadcasts rules where their size is known to fit, as that of a fixed table is."""
    return types.join(rules, F.col(column).startswith(F.col("prefix")))


def slices(lines: DataFrame) -> DataFrame:
    """(dump, source_file, tags, used_types, literals) of compiler dumps' lines (dump, line_no, line).

    Sections turn two flags on and off: names, whose literals count, and trees, whose signatures do. A
    source path is armed by its marker and taken from the first line that fits, the marker's own included.
    One shuffle on the dump serves all windows and the aggregate.
    """
    line = F.col("line")
    used = lines.where((line != "") & ~line.startswith("---"))
    starts = lambda *ps: _starts(line, ps)
    names, trees, places = starts("Names ", "Names:"), starts("Trees ", "Trees:"), starts("Positions ", "positions:")
    used = fill_down(used, F.when(trees | places, False).when(names, True), "in_names", ["dump"], "line_no")
    used = fill_down(used, F.when(places, False).when(trees, True), "in_trees", ["dump"], "line_no")
    order = Window.partitionBy("dump").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    used = used.withColumn("armed", F.sum(F.contains(line, F.lit("source paths:")).cast("int")).over(order))
    path = F.when(F.contains(line, F.lit(" [")) & line.endswith("]"), F.replace(F.substring_index(line, " [", -1), F.lit("]"), F.lit("")))
    path = path.when(F.contains(line, F.lit(".scala")) & F.contains(line, F.lit(": ")), literal(line))
    facts = used.select(
        "dump",
        "line_no",
        "armed",
        F.when(F.col("in_names") & F.contains(line, F.lit(": ")), literal(line)).alias("lit"),
        F.when(F.col("in_trees") & F.contains(line, F.lit(" Signature(")), signature_types(line)).alias("sig"),
        F.when(F.col("armed") > 0, path).alias("path"),
    )
    facts = facts.withColumn("lit", F.when(F.length("lit") > 1, F.col("lit")))
    # the first path after the last arming that has one
    out = facts.groupBy("dump").agg(
        F.max_by("path", F.when(F.col("path").isNotNull(), F.struct("armed", -F.col("line_no")))).alias("source_file"),
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("lit").isNotNull(), F.struct("line_no", "lit")))), lambda x: x["lit"])).alias("literals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sig")))).alias("used_types"),
    )
    generated = F.when(F.contains(F.coalesce("source_file", F.lit("")), F.lit("target")), F.array(F.lit("generated"))).otherwise(F.array().cast("array<string>"))
    return out.select("dump", "source_file", F.array_sort(F.concat(tags_of(F.col("used_types")), generated)).alias("tags"), "used_types", "literals")


def scala_version(lines: DataFrame) -> DataFrame:
    """(project, version): the first Scala 3 version that a build file (project, line_no, line) names; no row if none does."""
    line = F.col("line")
    quoted = r'"(3\.[^"]+)"'
    cross = F.substring_index(line, "crossScalaVersions", -1)
    version = F.when(F.contains(line, F.lit("val ")) & F.contains(line, F.lit("scala")) & line.rlike(quoted), F.regexp_extract(line, quoted, 1)).when(
        F.contains(line, F.lit("crossScalaVersions")) & cross.rlike(quoted), F.regexp_extract(cross, quoted, 1)
    )
    found = lines.select("project", "line_no", version.alias("version")).where("version IS NOT NULL")
    return found.groupBy("project").agg(F.min_by("version", "line_no").alias("version"))
