"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

The filter is a table of 256-bit blocks (four longs). A URL's first hash picks its block and eight
5-bit fields of its second hash pick one bit in each of the block's eight 32-bit words, so a probe
reads one block. Blocks are built by a distributed bit_or. URLs that miss the filter are surely
not listed and go no further; possible hits are joined with the listed URLs themselves, which
removes the filter's false positives. All of it is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.llm.common import BROADCAST_BYTES, small, written

#: Bits of the filter per listed URL.
BITS = 16
#: What a listed URL counts in the size of a broadcast.
KEY_BYTES = 200
#: Query parameters that don't change the page.
TRACKING = "utm_[a-z_]+|ref|fbclid|gclid|sessionid"


def canonical(url: Column) -> Column:
    """A canonical form: no scheme, user, 'www.' or 'm.' in front, default port, fragment, tracking
    parameters, trailing slashes, or final '.html'; host in lower case; parameters sorted. Null stays null."""
    u = F.regexp_replace(F.trim(url), r"#.*", "")
    u = F.regexp_replace(u, r"^(?i:[a-z][a-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_extract(u, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^[^@]*@", ""), r":(80|443)?$", ""), r"^((www|m)\.)+", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^[^/?]*([^?]*)", 1), r"/+$", ""), r"\.html?$", "")
    query = F.regexp_extract(u, r"\?(.*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _hashes(key: Column, blocks: Column) -> tuple[Column, list[Column]]:
    """The block of a key and its four longs."""
    second = F.xxhash64(F.lit(1), key)
    fields = [F.shiftright(second, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(8)]
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, fields[2 * i]).bitwiseOR(F.call_function("shiftleft", one, fields[2 * i + 1] + 32)) for i in range(4)]
    return F.pmod(F.xxhash64(key), blocks), words


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0..w3) of the keys in listed.key; blocks without a key have no row."""
    block, words = _hashes(F.col("key"), F.lit(n_blocks).cast("long"))
    rows = listed.select(block.alias("block"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(4)])


def marked(pages: DataFrame, listed: DataFrame, url_col: str = "url", list_col: str = "url") -> DataFrame:
    """pages with canonical_url and a boolean `listed`: whether the canonical URL is that of a listed one.

    A null or blank URL, on either side, is never listed. Repeated rows, in either table, are marked
    each. An empty list lists nothing; an empty table gives an empty table. pages' own columns of the
    names canonical_url and listed are replaced.

    Where filter and list fit a broadcast, pages are read once and not moved. A longer list is met by the
    pages' canonical URLs alone: those that the filter passes are joined with it, and what is confirmed, a
    table as long as the listed URLs that pages have, marks the pages.
    """
    keys = listed.select(canonical(F.col(list_col)).alias("key")).where("key <> ''").distinct()
    keys = written(keys, "listed")
    n_blocks = max(1, -(-keys._sl_seen["rows"] * BITS // 256))
    blocks = written(bloom_blocks(keys, n_blocks), "bloom")
    probe = pages.drop("canonical_url", "listed").withColumn("canonical_url", canonical(F.col(url_col)))
    exact = keys.select(F.col("key").alias("_sl_key"))
    if keys._sl_seen["rows"] * KEY_BYTES <= BROADCAST_BYTES:
        tested = _tested(probe, F.broadcast(blocks), n_blocks)
        found = tested.join(F.broadcast(exact), F.when(F.col("_sl_hit"), F.col("canonical_url")) == F.col("_sl_key"), "left")
    else:
        narrow = _tested(probe.select("canonical_url"), small(blocks, 48), n_blocks).where("_sl_hit").select(F.col("canonical_url").alias("_sl_key")).distinct()
        confirmed = written(narrow.join(exact, "_sl_key"), "confirmed")
        found = probe.join(small(confirmed, KEY_BYTES), F.col("canonical_url") == F.col("_sl_key"), "left")
    return found.select(*probe.columns, F.col("_sl_key").isNotNull().alias("listed"))


def _tested(probe: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """probe with _sl_hit: whether the filter may hold canonical_url."""
    block, words = _hashes(F.col("canonical_url"), F.lit(n_blocks).cast("long"))
    renamed = blocks.select(F.col("block").alias("_sl_block"), *[F.col(f"w{i}").alias(f"_sl_w{i}") for i in range(4)])
    tested = probe.join(renamed, block == F.col("_sl_block"), "left")
    hit = F.coalesce(F.col("canonical_url") != "", F.lit(False))
    for i, w in enumerate(words):
        hit = hit & F.coalesce(F.col(f"_sl_w{i}").bitwiseAND(w) == w, F.lit(False))
    return tested.select(*probe.columns, hit.alias("_sl_hit"))


def filtered(pages: DataFrame, listed: DataFrame, url_col: str = "url", list_col: str = "url") -> DataFrame:
    """The rows of pages whose URL isn't listed, with the columns of pages."""
    return marked(pages, listed, url_col, list_col).where("NOT listed").select(*pages.columns)


def _canonical_sql(u: str) -> str:
    bare = rf"regexp_replace(regexp_replace(trim({u}), '#.*', ''), '^(?i:[a-z][a-z0-9+.-]*:)?//', '')"
    host = rf"lower(regexp_extract({bare}, '^([^/?]*)', 1))"
    host = rf"regexp_replace(regexp_replace(regexp_replace({host}, '^[^@]*@', ''), ':(80|443)?$', ''), '^((www|m)\.)+', '')"
    path = rf"regexp_replace(regexp_replace(regexp_extract({bare}, '^[^/?]*([^?]*)', 1), '/+$', ''), '\.html?$', '')"
    kept = rf"list_sort(list_filter(string_split(regexp_extract({bare}, '\?(.*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING})(=|$)')))"
    return f"{host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END"


#: The list of the query: a tenth of the pages' hosts paths, spelt as a list would have them, and hosts that no page has.
LIST_SQL = """
SELECT regexp_replace(url, '^https?://(www[.]|m[.])?', 'HTTP://www.') AS url FROM pages WHERE page_id % 10 = 3
UNION ALL SELECT 'https://absent.example.com/' || CAST(page_id AS STRING) AS url FROM pages WHERE page_id % 10 = 4
"""
#: The query in DuckDB's SQL.
SQL = f"""
WITH l AS ({LIST_SQL}), k AS (SELECT DISTINCT {_canonical_sql("url")} AS key FROM l),
p AS (SELECT page_id, {_canonical_sql("url")} AS canonical_url FROM pages)
SELECT page_id, canonical_url, key IS NOT NULL AS listed FROM p LEFT JOIN k ON canonical_url = key AND key <> ''
"""
