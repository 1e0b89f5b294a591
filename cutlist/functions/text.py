"""Text and number formatting as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


# The characters that count as whitespace in Unicode text.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any script; ``trim`` alone would leave no-break blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def filled(text: Column, default: Column | str | None = None) -> Column:
    """``text`` stripped, or ``default`` where it is missing or blank."""
    value = F.nullif(strip(text), F.lit(""))
    if default is None:
        return value
    return F.coalesce(value, F.lit(default) if isinstance(default, str) else default)


def _plain_edges(text: Column) -> Column:
    visible = lambda char: F.ascii(char).between(33, 126)
    return visible(text) & visible(F.substring(text, -1, 1))


def strip_field(text: Column) -> Column:
    """``strip`` for short columns, which cost nothing to name twice: the search of the edges is left out where nothing is to go."""
    return F.when(_plain_edges(text), text).otherwise(strip(text))


def filled_field(text: Column) -> Column:
    """``filled`` for short columns, as ``strip_field``."""
    return F.when(_plain_edges(text), text).otherwise(filled(text))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def caption_text(text: Column) -> Column:
    """One-line caption: whitespace runs become one blank, blanks and hyphens go from both ends."""
    return F.btrim(F.regexp_replace(text, r"(?U)\s+", " "), F.lit(" -"))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.lit(list(words)), lambda word: F.contains(text, word))


def hits(text: Column, words: Sequence[str], weight: int, cap: int) -> Column:
    """Distinct ``words`` found in ``text`` times ``weight``, at most ``cap``."""
    found = F.size(F.filter(F.lit(list(words)), lambda word: F.contains(text, word)))
    return F.least(F.lit(cap), found * weight)


def cleaned(items: Column) -> Column:
    """Array items stripped, blanks and nulls dropped."""
    return F.filter(F.transform(items, strip), lambda x: x.isNotNull() & (x != ""))


def slug(text: Column, default: Column | str | None = None) -> Column:
    value = F.nullif(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "-"), F.lit("-")), F.lit(""))
    if default is None:
        return value
    return F.coalesce(value, F.lit(default) if isinstance(default, str) else default)


def clock(ms: Column) -> Column:
    """``MM:SS``, or ``HH:MM:SS`` from one hour on; half seconds go to the even second."""
    total = F.rint(F.greatest(ms, F.lit(0)) / 1000).cast("bigint")
    pair = lambda n: F.lpad(n.cast("string"), 2, "0")
    hours = F.floor(total / 3600)
    minutes, seconds = F.floor(total / 60) % 60, total % 60
    hour_text = F.when(hours < 100, pair(hours)).otherwise(hours.cast("string"))
    return F.when(hours > 0, F.concat_ws(":", hour_text, pair(minutes), pair(seconds))).otherwise(
        F.concat_ws(":", pair(minutes), pair(seconds))
    )


def seconds_text(ms: Column) -> Column:
    """Seconds with three decimals, written from whole milliseconds."""
    return F.concat(F.floor(ms / 1000).cast("string"), F.lit("."), F.lpad((ms % 1000).cast("string"), 3, "0"))


def padded(number: Column, width: int) -> Column:
    """Zero-padded to at least ``width``; ``lpad`` alone would cut longer numbers."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def language_code(locale: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.lower(F.split_part(locale, F.lit("-"), F.lit(1)))), F.lit("")), F.lit("en"))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def result_key(path: Column, signature: Column | None = None) -> Column:
    """File stem and ten hex digits of the path's SHA-1; with a signature it also tells settings apart."""
    source = path if signature is None else F.concat_ws("::", path, signature)
    return F.concat_ws("-", file_stem(path), F.substring(F.sha1(source), 1, 10))


def segment_digest(path: Column, start_ms: Column, end_ms: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", path, seconds_text(start_ms), seconds_text(end_ms))), 1, 12)


def day_text(day: Column) -> Column:
    return F.date_format(day, "yyyy.MM.dd")


def span_text(first: Column, last: Column) -> Column:
    """``a`` or ``a - b`` for a first and last date."""
    return F.when(first == last, day_text(first)).otherwise(F.concat_ws(" - ", day_text(first), day_text(last)))


def title_parts(label: Column) -> Column:
    """Title and subtitle of a card, cut at the first middle dot."""
    parts = F.split(label, "·", 2)
    return F.struct(
        strip(parts[0]).alias("title"),
        F.coalesce(strip(F.try_element_at(parts, F.lit(2))), F.lit("")).alias("subtitle"),
    )
