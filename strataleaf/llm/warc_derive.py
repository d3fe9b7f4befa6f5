"""WARC derivatives: from each response record a metadata and a plain-text conversion record.

A response record is parsed into its WARC headers, HTTP status line and headers, and payload. The
metadata record holds, as JSON, the source's WARC and HTTP headers, the title and the links; the
conversion record holds the page's text. Both name the response in WARC-Refers-To, each names the
other in WARC-Concurrent-To, both keep its target URI, date and payload digest, and each has
a digest of its own block. Record ids derive from the response's id, so a rebuilt record is the
same record. Everything is built-in expressions over one scan: no shuffle, no Python.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataleaf.functions.text import let

_CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def _uuid(c: Column) -> Column:
    h = F.md5(c)
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-"), h.substr(13, 4), F.lit("-"), h.substr(17, 4), F.lit("-"), h.substr(21, 12), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A serialised record; a header whose value is null is left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit(_CRLF)), F.lit("")) for k, v in headers]
    return F.concat(F.lit(f"WARC/1.1{_CRLF}"), *lines, F.lit(_CRLF), block, F.lit(_CRLF * 2))


def _sha(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record of each page (page_id, url, html), as a crawler would have written it. Null html is an empty payload."""
    html = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{_CRLF}Content-Type: text/html; charset=utf-8{_CRLF}Content-Length: "), F.octet_length(html).cast("string"), F.lit(_CRLF), F.lit(f"X-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(_CRLF * 2), html)
    headers = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", _uuid(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce("url", F.lit(""))))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", _sha(html)),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http).cast("string")),
    ]
    return pages.select("page_id", _record(headers, http).alias("record"))


def _head(record: Column) -> Column:
    return F.substring_index(record, _CRLF * 2, 1)


def _rest(whole: Column, head: Column) -> Column:
    """What follows the blank line after head; empty if there is none."""
    return F.when(F.length(whole) > F.length(head) + 4, whole.substr(F.length(head) + 5, F.length(whole))).otherwise("")


def _headers(head: Column) -> Column:
    """An array of (name, value) in their order, without the first line."""
    lines = F.filter(F.split(head, _CRLF), lambda x, i: (i > 0) & F.contains(x, F.lit(":")))
    return F.transform(lines, lambda x: F.struct(F.substring_index(x, ":", 1).alias("name"), F.ltrim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))


def _header(headers: Column, name: str) -> Column:
    """The first value of a header, or null."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), F.lit(0))["value"]


#: What isn't text: comments, and elements with all they hold, to the end of the page where they aren't closed. A head that isn't closed
#: ends where the body begins.
_DROP = r"(?is)<(?:!--.*?(?:-->|\z)|(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\z)|head\b[^>]*>.*?(?:</head\s*>|(<body\b)|\z))"
_BLOCKS = "p|div|br|hr|h[1-6]|li|ul|ol|tr|table|article|section|nav|header|footer|main|aside|pre|blockquote|form|dl|dt|dd|title|body"
#: Tags that end no line; what is left after them are tags that do.
_INLINE = rf"(?i)<(?!/?(?:{_BLOCKS})\b)[!/?a-z][^>]*>"
_BREAK = r"<[!/?a-zA-Z][^>]*>"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


#: Names that count without a semicolon too, longest first, and what may be a character reference in text.
_OPEN = "|".join(sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))
#: A reference as it follows an ampersand.
_REFERENCE = rf"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{0,30}};|(?:{_OPEN}))"
#: In attributes a name without semicolon counts only if the next character couldn't belong to it: ?a=1&copy=2 stays.
_IN_ATTRIBUTE = rf"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{0,30}};|(?:{_OPEN})(?![A-Za-z0-9=]))"
#: Numbers 128 to 159 mean the characters of windows-1252 that have those bytes.
_C1 = {str(b): c for b in range(128, 160) if (c := bytes([b]).decode("cp1252", "ignore"))}


def _names() -> Column:
    """Named references by their first two letters: the lookup in a map literal is a walk through its keys."""
    out: dict[str, dict[str, str]] = {}
    for k, v in html5.items():
        out.setdefault(k[:2], {})[k] = v.replace("\xa0", " ")
    return F.from_json(F.lit(json.dumps(out)), "map<string,map<string,string>>")


def _numbered(m: Column) -> Column:
    """The character of a numeric reference; U+FFFD for none, as HTML has it."""
    hexes, digits = F.regexp_extract(m, "^#[xX]0*([0-9a-fA-F]*)", 1), F.regexp_extract(m, "^#0*([0-9]*)", 1)
    number = F.when(m.rlike("^#[xX]"), F.when(F.length(hexes) <= 6, F.conv(hexes, 16, 10))).otherwise(F.when(F.length(digits) <= 7, digits))

    def character(n: Column) -> Column:
        bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        c1 = F.from_json(F.lit(json.dumps(_C1)), "map<string,string>")
        return (
            F.when(bad, F.lit("\ufffd"))
            .when(n == 0xA0, F.lit(" "))
            .when(n == 0xFEFF, F.lit("\ufeff"))  # alone it would be read as a byte order mark
            .otherwise(F.coalesce(F.when(n.between(128, 159), F.element_at(c1, n.cast("string"))), F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")))
        )

    return let(number.try_cast("int"), character)


def _decoded(c: Column, reference: str = _REFERENCE) -> Column:
    """Every character reference of HTML, in one pass: what a reference stands for is not read again. No-break spaces become blanks."""
    names = _names()

    def known(k: Column) -> Column:
        return F.try_element_at(F.try_element_at(names, k.substr(1, 2)), k)

    def named(k: Column) -> Column:
        # of an unknown name with a semicolon the longest beginning that needs none counts, but not in attributes
        start = F.regexp_extract(k, f"^({_OPEN})", 1) if reference == _REFERENCE else F.lit("")
        short = let(start, lambda x: F.when(x != "", F.concat(known(x), k.substr(F.length(x) + 1, F.length(k)))))
        return F.coalesce(known(k), short, F.concat(F.lit("&"), k))

    def piece(x: Column) -> Column:
        """What follows an ampersand."""
        found = F.regexp_extract(x, reference, 0)
        decoded = lambda m: F.when(m == "", F.lit("&")).when(m.startswith("#"), _numbered(m)).otherwise(named(m))
        return let(found, lambda m: F.concat(decoded(m), x.substr(F.length(m) + 1, F.length(x))))

    whole = F.transform(F.split(c, "&", -1), lambda x, i: F.when(i == 0, x).otherwise(piece(x)))
    return F.when(F.contains(c, F.lit("&")), F.array_join(whole, "")).otherwise(c)


def plain_text(html: Column) -> Column:
    """Text of a page: without comments, scripts, styles and head; block tags end lines; character references decoded; blanks collapsed."""
    c = F.regexp_replace(html, _DROP, "$2")
    c = F.regexp_replace(F.regexp_replace(c, _INLINE, ""), r"[ \t\r\n\f]+", " ")
    c = F.replace(F.regexp_replace(c, _BREAK, "\n"), F.lit(" \n"), F.lit("\n"))
    c = F.regexp_replace(c, r"\n[ \n]+", "\n")  # no group is repeated anywhere: Java takes a stack frame for each turn

    def tidy(t: Column) -> Column:
        # only blanks and line ends that were written as references are left
        loose = F.contains(t, F.lit(" \n")) | F.contains(t, F.lit("\n ")) | F.contains(t, F.lit("\n\n"))
        return F.trim(F.when(loose, F.regexp_replace(t, " *\n[ \n]*", "\n")).otherwise(t), F.lit(" \n"))

    return let(let(c, lambda t: _decoded(t)), tidy)


def derived(records: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Two rows per response of records (id, record): (id, warc_type, record_id, refers_to, concurrent_to,
    target_uri, warc_date, payload_digest, block_digest, block, record).

    A null, empty or malformed record, or one of another type, has no derivatives; so has one
    without a record id, for nothing could refer to it. A response without HTTP headers or payload has
    empty ones. Repeated records have equal derivatives. An empty table gives an empty table; other
    columns are ignored.
    """
    # invalid records are told apart by a null block after the explode: a filter before it would be
    # pushed down to where the record is made, and make it again for every condition
    a = records.select(F.col(id_col).alias("id"), F.col("record").alias("r"))
    a = a.select("id", _head(F.col("r")).alias("head"), "r").select("id", "head", _headers(F.col("head")).alias("warc"), _rest(F.col("r"), F.col("head")).alias("rest"))
    valid = F.col("head").startswith("WARC/1.") & (F.lower(_header(F.col("warc"), "WARC-Type")) == "response") & _header(F.col("warc"), "WARC-Record-ID").isNotNull()
    # a record ends with two line ends of its own
    a = a.select("id", "warc", valid.alias("valid"), F.when(F.endswith("rest", F.lit(_CRLF * 2)), F.col("rest").substr(F.lit(1), F.length("rest") - 4)).otherwise(F.col("rest")).alias("http"))
    a = a.select("id", "warc", "valid", "http", _head(F.col("http")).alias("hhead"))
    a = a.select("id", "warc", "valid", F.substring_index("hhead", _CRLF, 1).alias("status"), _headers(F.col("hhead")).alias("headers"), _rest(F.col("http"), F.col("hhead")).alias("html"))
    warc = F.col("warc")
    source, uri, date, digest = (_header(warc, h) for h in ("WARC-Record-ID", "WARC-Target-URI", "WARC-Date", "WARC-Payload-Digest"))
    title = F.trim(F.regexp_replace(_decoded(F.regexp_extract("html", _TITLE, 1)), r"[ \t\r\n\f]+", " "))
    links = F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda x: _decoded(x, _IN_ATTRIBUTE))
    meta = F.to_json(F.struct(warc.alias("warc_headers"), F.col("status").alias("http_status"), F.col("headers").alias("http_headers"), title.alias("title"), links.alias("links")))
    b = a.select(
        "id", source.alias("refers_to"), uri.alias("target_uri"), date.alias("warc_date"), digest.alias("payload_digest"),
        F.explode(F.array(
            F.struct(F.lit("metadata").alias("warc_type"), F.lit("conversion").alias("other"), F.lit("application/json").alias("kind"), F.when(F.col("valid"), meta).alias("block")),
            F.struct(F.lit("conversion").alias("warc_type"), F.lit("metadata").alias("other"), F.lit("text/plain; charset=utf-8").alias("kind"), F.when(F.col("valid"), plain_text(F.col("html"))).alias("block")),
        )).alias("d"),
    )
    b = b.where("d.block IS NOT NULL").select("*", "d.*", _uuid(F.concat("refers_to", F.lit(" "), "d.warc_type")).alias("record_id"), _uuid(F.concat("refers_to", F.lit(" "), "d.other")).alias("concurrent_to"), _sha(F.col("d.block")).alias("block_digest"))
    headers = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "kind")]
    record = _record([*((k, F.col(v)) for k, v in headers), ("Content-Length", F.octet_length("block").cast("string"))], F.col("block"))
    return b.select(F.col("id").alias(id_col), *[v for _, v in headers[:-1]], "block", record.alias("record"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _decoded_sql(c: str, attribute: bool = False) -> str:
    """Character references in DuckDB's SQL, piece by piece between ampersands."""
    number = lambda digits, base: f"list_reduce(list_prepend(0::DOUBLE, list_transform(string_split({digits}, ''), lambda c: (instr('0123456789abcdef', lower(c)) - 1)::DOUBLE)), lambda a, b: a * {base} + b)"
    hexes, digits = "regexp_extract(m, '[xX]([0-9a-fA-F]+)', 1)", "regexp_extract(m, '[0-9]+')"
    value = f"CASE WHEN lower(m[2]) = 'x' THEN {number(hexes, 16)} ELSE {number(digits, 10)} END"
    c1 = ", ".join(f"{k}: {_quoted(v)}" for k, v in _C1.items())
    character = f"list_transform([{value}], lambda n: CASE WHEN n = 0 OR n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) ELSE coalesce(map_extract(MAP {{{c1}}}, n::INTEGER)[1], chr(n::INTEGER)) END)[1]"
    # a name without semicolon is matched with the next character, where attributes need to see it
    more = "[A-Za-z0-9=]?" if attribute else ""
    reference = f"'^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]{{0,30}};|(?:{_OPEN}){more})'"
    known = "map_extract(entities, {})[1]"
    prefix = "''" if attribute else f"regexp_extract(m, '^(?:{_OPEN})')"
    named = f"coalesce({known.format('m')}, list_transform([{prefix}], lambda o: CASE WHEN o <> '' THEN {known.format('o')} || substr(m, len(o) + 1) END)[1], '&' || m)"
    piece = f"list_transform([regexp_extract(x, {reference})], lambda m: CASE WHEN m = '' THEN '&' WHEN m[1] = '#' THEN {character} ELSE {named} END || substr(x, len(m) + 1))[1]"
    split = f"string_split({c}, '&')"
    return f"replace({split}[1] || array_to_string(list_transform({split}[2:], lambda x: {piece}), ''), chr(160), ' ')"


def sql() -> str:
    """The query in DuckDB's SQL, from the pages themselves."""
    uuid = lambda c: f"('<urn:uuid:' || substr(md5({c}), 1, 8) || '-' || substr(md5({c}), 9, 4) || '-' || substr(md5({c}), 13, 4) || '-' || substr(md5({c}), 17, 4) || '-' || substr(md5({c}), 21, 12) || '>')"
    size = lambda c: f"CAST(strlen({c}) AS VARCHAR)"
    entities = f"map([{', '.join(map(_quoted, html5))}], [{', '.join(map(_quoted, html5.values()))}])"
    elements = "|".join(rf"<{x}\b[^>]*>.*?(?:</{x}\s*>|\z)" for x in ("script", "style", "noscript", "template"))
    text = rf"regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|{elements}|<head\b[^>]*>.*?(?:</head\s*>|(<body\b)|\z)', '\1', 'g')"
    # a block tag stands as chr(1) until other tags and white space are gone
    text = rf"regexp_replace(regexp_replace({text}, '(?i)</?(?:{_BLOCKS})\b[^>]*>', chr(1), 'g'), '<[!/?a-zA-Z][^>]*>', '', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, '[ \t\r\n\f]+', ' ', 'g'), ' *\x01[ \x01]*', chr(10), 'g')"
    text = rf"trim(regexp_replace({_decoded_sql(text)}, ' *\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"
    title = f"trim(regexp_replace({_decoded_sql(f'regexp_extract(html, {_quoted(_TITLE)}, 1)')}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"
    links = f"list_transform(regexp_extract_all(html, {_quoted(_LINK)}, 1), lambda l: {_decoded_sql('l', True)})"
    pair = lambda k, v: f"{{'name': '{k}', 'value': {v}}}"
    nl = "chr(13) || chr(10)"
    http = f"('HTTP/1.1 200 OK' || {nl} || 'Content-Type: text/html; charset=utf-8' || {nl} || 'Content-Length: ' || {size('html')} || {nl} || 'X-Page: ' || page_id || {nl} || {nl} || html)"
    warc = ", ".join([pair("WARC-Type", "'response'"), pair("WARC-Record-ID", "refers_to"), pair("WARC-Date", f"'{DATE}'"), pair("WARC-Target-URI", "url"), pair("WARC-Payload-Digest", "payload_digest"), pair("Content-Type", "'application/http; msgtype=response'"), pair("Content-Length", size(http))])
    headers = ", ".join([pair("Content-Type", "'text/html; charset=utf-8'"), pair("Content-Length", size("html")), pair("X-Page", "CAST(page_id AS VARCHAR)")])
    meta = f"CAST(to_json({{'warc_headers': [{warc}], 'http_status': 'HTTP/1.1 200 OK', 'http_headers': [{headers}], 'title': {title}, 'links': {links}}}) AS VARCHAR)"
    names = [("WARC-Type", "warc_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Concurrent-To", "concurrent_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "warc_date"), ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest")]
    record = " || ".join(f"'{k}: ' || {v} || {nl}" for k, v in names)
    return f"""
WITH names AS (SELECT {entities} AS entities), p AS (SELECT page_id, entities, url, coalesce(html, '') AS html, {uuid("(CAST(page_id AS VARCHAR) || ' ' || url)")} AS refers_to, 'sha256:' || sha256(coalesce(html, '')) AS payload_digest FROM pages, names),
d AS (SELECT page_id, refers_to, url AS target_uri, '{DATE}' AS warc_date, payload_digest, 'metadata' AS warc_type, 'conversion' AS other, 'application/json' AS kind, {meta} AS block FROM p
  UNION ALL SELECT page_id, refers_to, url, '{DATE}', payload_digest, 'conversion', 'metadata', 'text/plain; charset=utf-8', {text} FROM p),
i AS (SELECT *, {uuid("(refers_to || ' ' || warc_type)")} AS record_id, {uuid("(refers_to || ' ' || other)")} AS concurrent_to, 'sha256:' || sha256(block) AS block_digest FROM d)
SELECT page_id, {", ".join(v for _, v in names)}, block,
  'WARC/1.1' || {nl} || {record} || 'Content-Type: ' || kind || {nl} || 'Content-Length: ' || {size("block")} || {nl} || {nl} || block || {nl} || {nl} AS record
FROM i"""
