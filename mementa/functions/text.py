"""Text expressions: trimming, titles, markup and presentation formats."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mementa import constants as K
from mementa.functions.paths import _col, let


def trim_unicode(value: Column | str) -> Column:
    return F.regexp_replace(_col(value), r"(?U)^\s+|\s+$", "")


def first_line_title(text: Column | str, length: int = 80) -> Column:
    """First non-blank line, trimmed and cut; NULL when every line is blank.

    Starting at the first non-space character makes this one regex scan, with no array of lines.
    """
    line = F.regexp_extract(_col(text), r"(?U)\S[^\n]*", 0)
    return F.when(F.length(line) > 0, F.substring(trim_unicode(line), 1, length))


def title120(text: Column | str) -> Column:
    return F.substring(_col(text), 1, 120)


def strip_html(value: Column | str) -> Column:
    """Drop ``<...>`` (also an unclosed tail) and stray ``>``; entities stay as they are."""
    untagged = F.regexp_replace(_col(value), r"<[^>]*>?", "")
    return trim_unicode(F.replace(untagged, F.lit(">"), F.lit("")))


def href(tag: Column | str) -> Column:
    """Double-quoted href value; ``href`` wins over ``HREF``; an empty value is kept."""
    t = _col(tag)

    def value(marker: str) -> Column:
        pattern = f'(?s)^.*?{marker}="([^"]*)"'
        return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1))

    return F.when(t.contains('href="'), value("href")).otherwise(value("HREF"))


def json_region(text: Column | str) -> Column:
    """From the first opening to the last closing bracket; NULL when there is none."""
    region = F.regexp_extract(_col(text), r"(?s)[\[{].*[\]}]", 0)
    return F.when(F.length(region) > 0, region)


def xml_region(text: Column | str, root_tag: str) -> Column:
    """From the XML start to the last closing root tag, else to the last ``>``."""
    t = _col(text)
    start = F.coalesce(
        *[F.nullif(F.instr(t, marker), F.lit(0)) for marker in ("<?xml", f"<{root_tag}", "<")]
    )

    def cut(tail: Column) -> Column:
        def to_end(closed: Column) -> Column:
            opened = F.regexp_extract(tail, "(?s)^.*>", 0)
            return F.when(F.length(closed) > 0, closed).otherwise(F.nullif(opened, F.lit("")))

        return let(F.regexp_extract(tail, f"(?s)^.*</{root_tag}>", 0), to_end)

    return let(F.substr(t, start), cut)


def xml_unescape(value: Column | str) -> Column:
    """Resolve the five named and the numeric entities; NULL for an unknown one."""
    v = _col(value)
    tokens = F.regexp_extract_all(v, F.lit(r"(?s)&[^;&]*;|[^&]+|&"), F.lit(0))

    def code_point(digits: Column, base: int) -> Column:
        """The character of a number; NULL for zero, surrogates and what lies beyond Unicode."""
        short = F.regexp_replace(digits, "^0+", "")
        number = F.when(F.length(short).between(1, 7), F.conv(short, base, 10).cast("long"))
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(32)), 8, "0")), "UTF-32"))

    def resolve(token: Column) -> Column:
        return (
            F.when(~token.startswith("&"), token)
            .when(token == "&quot;", F.lit('"'))
            .when(token == "&lt;", F.lit("<"))
            .when(token == "&gt;", F.lit(">"))
            .when(token == "&apos;", F.lit("'"))
            .when(token == "&amp;", F.lit("&"))
            .when(
                token.rlike(r"^&#x[0-9a-fA-F]+;$"), code_point(F.regexp_extract(token, r"x([0-9a-fA-F]+)", 1), 16)
            )
            .when(token.rlike(r"^&#[0-9]+;$"), code_point(F.regexp_extract(token, r"([0-9]+)", 1), 10))
        )

    def joined(parts: Column) -> Column:
        return F.when(~F.exists(parts, lambda x: x.isNull()), F.array_join(parts, ""))

    return F.when(~v.contains("&"), v).otherwise(let(F.transform(tokens, resolve), joined))


def calendar_field(line: Column | str) -> tuple[Column, Column]:
    """(SUMMARY value, DTSTART value) of one calendar line, each NULL when absent."""
    t = _col(line)
    summary = F.when(t.startswith("SUMMARY:"), F.substr(t, F.lit(9)))
    start = F.when(
        t.startswith("DTSTART") & (F.instr(t, ":") > 0), F.substr(t, F.instr(t, ":") + 1)
    )
    return summary, start


def coverage_percent(covered: Column | str, total: Column | str) -> Column:
    return F.when(_col(total) == 0, F.lit(0.0)).otherwise(
        _col(covered).cast("double") / _col(total).cast("double") * 100.0
    )


def kib_to_bytes(text: Column | str) -> Column:
    """First word of a size listing in KiB to bytes, saturating; 0 when unreadable."""
    word = F.regexp_extract(_col(text), r"^\s*(\S+)", 1)
    kib = F.coalesce(F.when(word.rlike(r"^\+?[0-9]+$"), word.try_cast("decimal(38,0)")), F.lit(0))
    return F.least(kib * 1024, F.lit(2**63 - 1)).cast("long")


def format_bytes(size: Column | str) -> Column:
    """Binary unit ladder, by comparison rather than logarithms."""
    b = _col(size).cast("double")
    return (
        F.when(b.isNull() | F.isnan(b) | (b <= 0) | (b == float("inf")), F.lit("0 B"))
        .when(b < 1024, F.format_string("%.0f B", b))
        .when(b < 1024.0**2, F.format_string("%.1f KB", b / 1024.0))
        .when(b < 1024.0**3, F.format_string("%.1f MB", b / 1024.0**2))
        .when(b < 1024.0**4, F.format_string("%.1f GB", b / 1024.0**3))
        .otherwise(F.format_string("%.1f TB", b / 1024.0**4))
    )


def format_count(value: Column | str) -> Column:
    return F.format_number(_col(value), 0)


def format_date(unix_seconds: Column | str) -> Column:
    """Short date in UTC; a dash for absent or zero.  Works on dates, so no session time zone."""
    s = _col(unix_seconds)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(s / 86400).cast("int"))
    return F.when(F.coalesce(s, F.lit(0)) == 0, F.lit("—")).otherwise(F.date_format(day, "MMM d, yyyy"))


def category_label(category: Column | str) -> Column:
    label = F.lit(None).cast("string")
    for code, text in reversed(list(K.CATEGORY_LABELS.items())):
        label = F.when(_col(category) == code, F.lit(text)).otherwise(label)
    return F.coalesce(label, _col(category))
