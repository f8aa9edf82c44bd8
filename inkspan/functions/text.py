"""Cleaning rules as ``Column -> Column`` functions, so Catalyst fuses them into one projection.

White space, digits and letter case are Unicode-aware, as the rules' authors meant them: Java patterns carry ``(?U)``, and
U+001C to U+001F, which Java does not count as white space, are added by hand. Null stays null, empty stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: White space, inside a character class under (?U).
SPACE = r"\s\x1c-\x1f"
_EDGE = rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z"

# Characters that are replaced one to one, and those that are dropped.
SPECIAL_FROM = "\u00a0\u201c\u201d\u2018\u2019\u2013\u200b\u200c\u200d"
SPECIAL_TO = " \"\"''-"
#: Dashes that become two hyphens.
LONG_DASHES = ("\u2014", "\u2015")

# The patterns below decide results.
TABLE = r"(?is)<table[^>]*>(.*?)</table>"
ROW = r"(?is)<tr[^>]*>(.*?)</tr>"
CELL = r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"
TAG = r"<[^>]+>"
EMPTY_TAG = r"<[^>]+/>"
SCRIPT = r"(?is)<(script|style)[^>]*>.*?</\1>"
COMMENT = r"(?s)<!--.*?-->"
#: In this order.
XBRL = (
    r"(?is)<xbrli:context[^>]*>.*?</xbrli:context>",
    r"(?is)<xbrli:unit[^>]*>.*?</xbrli:unit>",
    r"(?i)<link:[^>]+xbrl[^>]*>",
    *(p for ns in ("us-gaap:", "dei:", "xbrli:", "xbrl:") for p in (rf"(?i)<{ns}[^>]+>", rf"(?i)</{ns}[^>]*>")),
)


def _sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    return _sub(c, _EDGE, "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the edges."""
    return strip(_sub(c, rf"(?U)[{SPACE}]+", " "))


def special_characters(c: Column) -> Column:
    c = F.translate(c, SPECIAL_FROM, SPECIAL_TO)
    for dash in LONG_DASHES:
        c = F.replace(c, F.lit(dash), F.lit("--"))
    return c


def serialise_tables(c: Column) -> Column:
    """Each table becomes its cells, spaces between them, a line for each row that has cells."""

    def table(inner: Column) -> Column:
        rows = F.transform(F.regexp_extract_all(inner, F.lit(ROW), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(CELL), F.lit(1)), lambda x: squeeze(_sub(x, TAG, ""))))
        lines = F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.array_join(r, " "))
        return F.when(F.size(lines) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")

    outside = F.split(c, TABLE, -1)
    inside = F.transform(F.regexp_extract_all(c, F.lit(TABLE), F.lit(1)), table)
    # there is one piece outside more than there are tables
    return F.array_join(F.zip_with(outside, inside, lambda o, i: F.concat(o, F.coalesce(i, F.lit("")))), "")


def count_tables(c: Column) -> Column:
    return F.regexp_count(c, F.lit(TABLE)).cast("long")


#: (pattern, which matches are removed), in order; each is applied to what the one before left.
HTML_STEPS = (SCRIPT, COMMENT, EMPTY_TAG, TAG)


def strip_markup(c: Column, steps: tuple[str, ...] = HTML_STEPS) -> Column:
    for p in steps:
        c = _sub(c, p, "")
    return c


def count_markup(c: Column, steps: tuple[str, ...] = HTML_STEPS) -> Column:
    """Matches removed in all steps together."""
    total = F.lit(0)
    for p in steps:
        total, c = total + F.regexp_count(c, F.lit(p)), _sub(c, p, "")
    return total.cast("long")


def strip_scripts(c: Column) -> Column:
    return strip_markup(c, (SCRIPT,))


def strip_comments(c: Column) -> Column:
    return strip_markup(c, (COMMENT,))


def strip_tags(c: Column) -> Column:
    return strip_markup(c, (EMPTY_TAG, TAG))


def strip_xbrl(c: Column) -> Column:
    # all patterns begin with '<', so most texts are left alone at the cost of one search
    return F.when(F.contains(c, F.lit("<")), strip_markup(c, XBRL)).otherwise(c)


def count_xbrl(c: Column) -> Column:
    """Matches removed in all steps together, each counted on what the steps before it left."""
    start = F.struct(c.alias("t"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, p: F.struct(F.regexp_replace(acc["t"], p, F.lit("")).alias("t"), (acc["n"] + F.regexp_count(acc["t"], p)).alias("n"))
    counted = F.aggregate(F.array(*[F.lit(p) for p in XBRL]), start, step, lambda acc: acc["n"])
    return F.when(F.contains(c, F.lit("<")), counted).otherwise(F.when(c.isNotNull(), F.lit(0).cast("long")))


def _heading(c: Column, word: str, number: str) -> Column:
    # A heading that follows a line gets a blank line, and its keyword twice: a known quirk that is kept, as results depend on it.
    c = _sub(c, rf"([^\n])\n({word} {number})", rf"$1\n\n{word} $2".replace(r"\n", "\n"))
    return _sub(c, rf"([^\n]){word} ({number})", f"$1\n{word} $2")


def part_headings(c: Column) -> Column:
    return _heading(c, "PART", "[IVX]+")


def item_headings(c: Column) -> Column:
    return _heading(c, "ITEM", "[0-9A-Z]+")


def headings(c: Column) -> Column:
    """PART, then ITEM headings. The rule for other section headings replaces them by themselves, so it is left out."""
    return item_headings(part_headings(c))


def whitespace(c: Column) -> Column:
    """Line ends, blank lines, ends of lines, runs of spaces, edges: in this order, so lines of spaces survive as blank ones."""
    c = _sub(c, r"\r\n?", "\n")
    c = _sub(c, r"\n{3,}", "\n\n")
    c = _sub(c, r"[ \t]+(?=\n|\z)", "")
    c = _sub(c, r" +", " ")
    return strip(c)


def artifacts(c: Column) -> Column:
    """Page lines, then lines of a number alone. Not stripped again."""
    c = _sub(c, r"(?iU)\nPage \d+ of \d+\n", "\n")
    return _sub(c, rf"(?U)\n[{SPACE}]*\d+[{SPACE}]*\n", "\n")


def dedup_hash(c: Column) -> Column:
    return F.sha2(squeeze(F.lower(strip(c))), 256)
