"""Text functions over embedded scripts: masking, extraction, cleaning, offsets.

All are built-in expressions. Offsets are UTF-16 code units, so a character beyond U+FFFF is
masked by two blanks and counts twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What JavaScript counts as white space, as the inside of a character class.
JS_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

COMMENT = r"(?s)<!--.*?-->"
STYLE_BLOCK = r"(?is)<style\b[^>]*>.*?</style>"
SCRIPT_BLOCK = r"(?is)<script\b[^>]*>.*?</script>"
SCRIPT_BODY = r"(?is)<script\b[^>]*>(.*?)</script>"
SCRIPT_TAG = r"(?i)</?script[^>]*>"
BR_TAG = r"(?i)</?br>"
BINDING = r"(?s):\[(.*?)\]"
PROPERTY = rf"[{JS_SPACE}][.:@]([a-zA-Z]*=)"
IMAGE = r"(?is)<img[^>].*? [^/]>"
TEMPLATE = r"(?i)(<template[^\n\r\x{2028}\x{2029}]*>)((?s:.*))(</template>)"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once, however often f uses it: chains of steps stay linear in size."""
    return F.transform(F.array(value), f)[0]


def replace_each(text: Column, pattern: str, f: Callable[[Column], Column]) -> Column:
    """Every match of pattern replaced by f(match): the gaps and the mapped matches, zipped."""

    def zipped(t: Column) -> Column:
        gaps = F.split(t, pattern, -1)
        mapped = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), f)
        return F.array_join(F.zip_with(gaps, mapped, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")

    return let(text, zipped)


def utf16_length(text: Column) -> Column:
    """Code units of UTF-16."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def mask(text: Column) -> Column:
    """All but line ends as blanks, one for each UTF-16 unit."""
    return F.regexp_replace(F.regexp_replace(text, r"[\x{10000}-\x{10FFFF}]", "  "), r"[^\r\n]", " ")


def mask_each(text: Column, pattern: str) -> Column:
    return replace_each(text, pattern, mask)


def mask_to_semicolon(text: Column, pattern: str) -> Column:
    """Matches masked, their last place taken by a semicolon: a statement ends there."""

    def f(m: Column) -> Column:
        masked = mask(m)
        return F.concat(masked.substr(F.lit(2), F.length(masked)), F.lit(";"))

    return replace_each(text, pattern, f)


def mask_comments(text: Column) -> Column:
    return mask_each(text, COMMENT)


def mask_styles(text: Column) -> Column:
    return mask_each(text, STYLE_BLOCK)


def mask_script_tags(text: Column) -> Column:
    return mask_to_semicolon(text, SCRIPT_TAG)


def mask_script_blocks(text: Column) -> Column:
    return mask_each(text, SCRIPT_BLOCK)


def mask_br(text: Column) -> Column:
    return mask_to_semicolon(text, BR_TAG)


def clean_component(text: Column, include_scripts: bool = True) -> Column:
    """A single-file component made parseable, with every offset kept: comments and styles masked, script
    tags (or whole scripts) masked, line breaks closed, bindings and prop prefixes blanked, images
    closed, and moustaches inside the outermost template opened."""
    return _cleaned(mask_styles(mask_comments(text)), include_scripts)


def _cleaned(c: Column, include_scripts: bool) -> Column:
    """The steps after comments and styles."""
    c = mask_script_tags(c) if include_scripts else mask_script_blocks(c)
    c = F.regexp_replace(mask_br(c), BINDING, "  $1 ")
    c = F.regexp_replace(c, PROPERTY, "  $1")
    c = replace_each(c, IMAGE, lambda m: F.when(m.endswith("  >"), F.concat(m.substr(F.lit(1), F.length(m) - 2), F.lit("/>"))).otherwise(m))

    def moustaches(m: Column) -> Column:
        body = F.regexp_extract(m, TEMPLATE, 2)
        body = F.replace(F.replace(body, F.lit("{{"), F.lit("{ ")), F.lit("}}"), F.lit(" }"))
        return F.concat(F.regexp_extract(m, TEMPLATE, 1), body, F.regexp_extract(m, TEMPLATE, 3))

    return replace_each(c, TEMPLATE, moustaches)


def has_ink(text: Column) -> Column:
    """Whether anything but white space is there."""
    return text.rlike(f"[^{JS_SPACE}]")


def script_bodies(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SCRIPT_BODY), F.lit(1))


def script_content(text: Column) -> Column:
    """The bodies of script blocks that aren't blank, joined by line ends."""
    return F.array_join(F.filter(script_bodies(text), has_ink), "\n")


def script_count(text: Column) -> Column:
    return F.size(script_bodies(text))


def virtual_source(text: Column) -> Column:
    """struct(source, has_script): everything masked but script bodies, which stay where they are."""

    def keep_body(m: Column) -> Column:
        opening = F.regexp_extract(m, r"^<[^>]*>", 0)
        body = m.substr(F.length(opening) + 1, F.length(m) - F.length(opening) - 9)
        return F.concat(mask(opening), body, F.lit(" " * 9))

    gaps = F.transform(F.split(text, SCRIPT_BLOCK, -1), mask)
    blocks = F.transform(F.regexp_extract_all(text, F.lit(SCRIPT_BLOCK), F.lit(0)), keep_body)
    source = F.array_join(F.zip_with(gaps, blocks, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.struct(source.alias("source"), F.exists(script_bodies(text), has_ink).alias("has_script"))


def parse_candidates(text: Column) -> Column:
    """An array of struct(pos, name, code): what a parser should try, in order; blank ones and repeats left out."""
    named = ("full", "combined", "template-only", "script-only")

    def build(bare: Column) -> Column:
        return let(_cleaned(bare, False), lambda template: let(script_content(text), lambda script: tries(_cleaned(bare, True), template, script)))

    def tries(full: Column, template: Column, script: Column) -> Column:
        combined = F.when(script != "", F.concat(script, F.lit("\n"), template)).otherwise(template)
        return F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), c.alias("code")) for i, (n, c) in enumerate(zip(named, (full, combined, template, script), strict=True))])

    return distinct_candidates(let(mask_styles(mask_comments(text)), build))


def distinct_candidates(candidates: Column) -> Column:
    """Without blank codes, and of equal codes the first."""
    inked = F.filter(candidates, lambda c: has_ink(c["code"]))
    return let(inked, lambda all_: F.filter(all_, lambda c: ~F.exists(all_, lambda o: (o["code"] == c["code"]) & (o["pos"] < c["pos"]))))


def nth_index(text: Column, needle: str, occurrence: int = 0) -> Column:
    """The offset, in UTF-16 units, of the nth match of needle (from 0, not overlapping); null if there is none."""
    parts = F.split(text, _literal(needle), -1)
    return let(parts, lambda p: F.when(F.size(p) > occurrence + 1, utf16_length(F.array_join(F.slice(p, 1, occurrence + 1), needle))))


def _literal(needle: str) -> str:
    return "\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def collapse_space(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    # a single blank is left alone, for most gaps are one
    other = JS_SPACE.replace(" ", "")
    return F.trim(F.regexp_replace(text, f"[{JS_SPACE}]{{2,}}|[{other}]", " "))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{JS_SPACE}]+|[{JS_SPACE}]+\z", "")


def source_text(content: Column) -> Column:
    """Bytes as text; bad bytes become U+FFFD, none fail."""
    return F.make_valid_utf8(content.cast("string"))
