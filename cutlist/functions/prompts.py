"""Features of free-text editing prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutlist.functions.text import bind, collapse, contains_any, filled, span_text, strip

# Word lists, patterns and texts.
TONES = (
    ("cinematic", ("cinematic", "시네마틱", "영화처럼")),
    ("warm", ("warm", "따뜻", "포근")),
    ("playful", ("playful", "경쾌", "발랄")),
)
SLOW_WORDS = ("천천히", "여유", "linger", "generous")
BRISK_WORDS = ("빠르게", "fast-paced")
SLOW_PACING = "Favor slightly longer holds and gentle transitions."
BRISK_PACING = "Keep the pacing brisk while preserving chronological clarity."
SUMMARY_LINK = "\n\nUser prompt:\n"
RUNTIME_PHRASE = (
    r"(\d+\s*(?:~|-)\s*\d+\s*(?:분|minutes|min)|\d+\s*(?:시간|hours|hour)\s*\d*\s*(?:분|minutes|min)?"
    r"|\d+\s*(?:분|minutes|min))"
)
RANGE_MINUTES = r"(\d+)\s*(?:~|-)\s*(\d+)\s*(?:분|minutes|min)"
HOURS_MINUTES = r"(\d+)\s*(?:시간|hours|hour)\s*(\d+)\s*(?:분|minutes|min)"
HOURS = r"(\d+)\s*(?:시간|hours|hour)"
MINUTES = r"(\d+)\s*(?:분|minutes|min)"
FULL_DATES = (r"(\d{4})[.\-/](\d{1,2})[.\-/](\d{1,2})", r"(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일")
FULL_DATE_MARKS = ((), ("년",))
MONTH_DAY = r"(\d{1,2})\s*월\s*(\d{1,2})\s*일"
MONTH_DAY_MARKS = ("월", "일")
EXPLICIT_TITLES = (
    "(?:제목|타이틀|프로젝트명)\\s*[:：]\\s*[\"“']?([^\\n\"”']+)",
    "(?:title|project name)\\s*[:：]\\s*[\"“']?([^\\n\"”']+)",
)
REQUEST_ENDING = r"(로|으로)?\s*(편집|정리|요약|만들어)\s*해\s*줘\.?$"
PLEASE_ENDING = r"\s*please\s+(edit|make|turn).*$"
EDGE_MARKS = " .,-"
PLACE_PATTERNS = (
    r"([A-Za-z][A-Za-z0-9&'. -]{1,24}|[가-힣A-Za-z0-9]+(?:\s*[가-힣A-Za-z0-9]+){0,2})\s*(?:에서|으로|로)",
    r"([A-Za-z][A-Za-z0-9&'. -]{1,24}|[가-힣A-Za-z0-9]+(?:\s*[가-힣A-Za-z0-9]+){0,2})\s*(?:가족\s*)?(?:여행|브이로그)",
    r"(?:to|in)\s+([A-Za-z][A-Za-z0-9&'. -]{1,24})",
)
PLACE_AFTER = (("에서", "로"), ("여행", "브이로그"), ())
PLACE_RUN = r"[A-Za-z0-9가-힣&'.\s-]++"
# The last words of a reversed text: a match has at most 25 characters or three words, and one more, before its last word.
PLACE_REACH = r"^(?:\s*+\S++){1,17}\s*+"
PLACE_STOP_WORDS = (
    "가족", "여행", "브이로그", "영상", "장면", "공항", "숙소", "리조트", "호텔", "한국", "현지", "집",
)
PLACE_BAD_ENDING = (
    r"(하는|가는|오는|있는|같은|보내는|돌아오는|떠나는|출발해|도착해|따뜻한|따뜻하게|여유로운|즐거운)$"
)
PLACE_TRAVEL_ENDING = r"\s*(출발|도착|복귀|귀가)$"
PLACE_MAX = 24
SEASONS = ("연말", "연초", "겨울", "여름", "봄", "가을", "신혼여행")
GROUP_KIND, PLAIN_KIND = "그룹 여행", "여행"
GROUP_KIND_WORDS = ("가족", "family", "friends", "커플", "동행")
TITLE_MAX = 24
LINE_MIN, LINE_MAX = 2, 28
DEFAULT_TITLE = "여행 영상"

_I = "(?iU)"


def tone(prompt: Column, existing: Column | None = None) -> Column:
    # A whole text is lowered once, not for every word.
    found = bind(F.lower(prompt), lambda t: F.coalesce(*[F.when(contains_any(t, words), F.lit(label)) for label, words in TONES]))
    return found if existing is None else F.coalesce(filled(existing), found)


def pacing(prompt: Column, existing: Column | None = None) -> Column:
    found = bind(
        F.lower(prompt),
        lambda t: F.when(contains_any(t, SLOW_WORDS), F.lit(SLOW_PACING)).when(contains_any(t, BRISK_WORDS), F.lit(BRISK_PACING)),
    )
    return found if existing is None else F.coalesce(filled(existing), found)


def summary(prompt: Column, existing: Column) -> Column:
    """The prompt, after an existing summary if there is one."""
    text, before = filled(prompt), filled(existing)
    return F.when(text.isNull(), existing).otherwise(
        F.when(before.isNull(), text).otherwise(F.concat(before, F.lit(SUMMARY_LINK), text))
    )


def runtime_phrase(prompt: Column) -> Column:
    """First range, hours or minutes phrase; empty if there is none (R2)."""
    return strip(F.regexp_extract(prompt, _I + RUNTIME_PHRASE, 1))


def runtime_seconds(text: Column, default_minutes: int = 40) -> Column:
    """Mean of a range (at least 60 s), else hours and minutes, else hours, else minutes."""
    part = lambda pattern, group: F.nullif(F.regexp_extract(text, _I + pattern, group), F.lit("")).try_cast("bigint")
    mean = F.greatest(F.lit(60), (part(RANGE_MINUTES, 1) + part(RANGE_MINUTES, 2)) * 30)
    found = F.coalesce(
        F.when(text.rlike(_I + RANGE_MINUTES), mean),
        part(HOURS_MINUTES, 1) * 3600 + part(HOURS_MINUTES, 2) * 60,
        part(HOURS, 1) * 3600,
        part(MINUTES, 1) * 60,
    )
    # The phrase has all four patterns, so a text without it is searched once.
    return F.coalesce(F.when(text.rlike(_I + RUNTIME_PHRASE), found), F.lit(default_minutes * 60)).cast("bigint")


def target_seconds(target_runtime: Column, editorial: Column, default_minutes: int = 40) -> Column:
    """Runtime of the explicit hint, else of the whole editorial text."""
    return runtime_seconds(filled(target_runtime, F.coalesce(editorial, F.lit(""))), default_minutes)


def _date(year: Column, month: Column, day: Column) -> Column:
    two = lambda x: F.lpad(x, 2, "0")
    return F.when(year.cast("int") > 0, F.concat_ws("-", F.lpad(year, 4, "0"), two(month), two(day)).try_cast("date"))


def prompt_dates(prompt: Column, first: Column, last: Column) -> Column:
    """Dates named in the prompt.

    Full dates count if there are any. Else month and day take the year of the first or last clip date,
    whichever puts them between the two, else the earlier one.
    """
    def found(pattern: str, marks: tuple[str, ...] = ()) -> Column:
        every = F.regexp_extract_all(prompt, F.lit("(?U)" + pattern), F.lit(0))
        # A text without the marks that a pattern has is not searched.
        for mark in marks:
            every = F.when(F.contains(prompt, F.lit(mark)), every).otherwise(F.array().cast("array<string>"))
        return every

    def dates(pattern: str, marks: tuple[str, ...]) -> Column:
        part = lambda m, g: F.regexp_extract(m, "(?U)" + pattern, g)
        return F.transform(found(pattern, marks), lambda m: _date(part(m, 1), part(m, 2), part(m, 3)))

    named = F.array_compact(F.concat(*[dates(pattern, marks) for pattern, marks in zip(FULL_DATES, FULL_DATE_MARKS)]))

    def resolve(m: Column) -> Column:
        month, day = (F.regexp_extract(m, "(?U)" + MONTH_DAY, g) for g in (1, 2))
        years = F.array(F.year(first).cast("string"), F.year(last).cast("string"))
        options = F.array_compact(F.transform(years, lambda y: _date(y, month, day)))
        return F.coalesce(F.array_min(F.filter(options, lambda d: (d >= first) & (d <= last))), F.array_min(options))

    partial = F.array_compact(F.transform(found(MONTH_DAY, MONTH_DAY_MARKS), resolve))
    none = F.array().cast("array<date>")
    return F.coalesce(bind(named, lambda ds: F.when(F.size(ds) > 0, ds)), F.when(first.isNotNull(), partial), none)


def prompt_date_span(dates: Column) -> Column:
    return bind(
        dates, lambda ds: F.when(F.size(ds) > 0, span_text(F.array_min(ds), F.array_max(ds))).otherwise(F.lit(""))
    )


def clean_title(text: Column) -> Column:
    """One line without edge marks and without a closing request to edit."""
    line = F.btrim(collapse(text), F.lit(EDGE_MARKS))
    line = F.regexp_replace(line, "(?U)" + REQUEST_ENDING, "")
    return F.btrim(F.regexp_replace(line, _I + PLEASE_ENDING, ""), F.lit(EDGE_MARKS))


def explicit_title(prompt: Column) -> Column:
    """What follows ``title:``; empty if nothing does."""
    chain = F.lit("")
    for pattern in reversed(EXPLICIT_TITLES):
        chain = F.when(
            prompt.rlike(_I + pattern), clean_title(F.regexp_extract(prompt, _I + pattern, 1))
        ).otherwise(chain)
    return chain


def _place(match: Column) -> Column:
    last_word = lambda name: F.element_at(F.split(name, " "), -1)
    name = bind(
        clean_title(match),
        lambda t: F.when(t.rlike("[가-힣]") & F.contains(t, F.lit(" ")), last_word(t)).otherwise(t),
    )
    return strip(F.regexp_replace(name, "(?U)" + PLACE_TRAVEL_ENDING, ""))


def _matches(prompt: Column, pattern: str, after: tuple[str, ...] = ()) -> Column:
    """First group of every match of ``pattern``.

    A pattern that ends in one of the ``after`` words backtracks over each word before it. No match holds a
    character outside ``PLACE_RUN``, so only runs of those characters with such a word in them are searched, and of these
    no more than ``PLACE_REACH`` before each such word; a comma, which no match holds, stands for what is further away.
    """
    found = lambda text: F.regexp_extract_all(text, F.lit(_I + pattern), F.lit(1))
    if not after:
        return found(prompt)
    runs = F.filter(F.regexp_extract_all(prompt, F.lit("(?U)" + PLACE_RUN), F.lit(0)), lambda r: contains_any(r, after))
    ends = F.lit("(?s).*?(?:" + "|".join(after) + ")")

    def reached(part: Column) -> Column:
        tail = lambda t: F.reverse(F.regexp_extract(F.reverse(t), "(?U)" + PLACE_REACH, 0))
        return bind(tail(part), lambda t: F.when(F.length(t) < F.length(part), F.concat(F.lit(","), t)).otherwise(part))

    shortened = lambda run: F.array_join(F.transform(F.regexp_extract_all(run, ends, F.lit(0)), reached), "")
    near = F.flatten(F.transform(F.transform(runs, shortened), found))
    return F.when(contains_any(prompt, after), near).otherwise(F.array().cast("array<string>"))


def places(prompt: Column) -> Column:
    """Place names the prompt seems to mention, pattern by pattern, each once."""
    # Equal matches give equal places, so each is cleaned once.
    matches = F.array_distinct(F.concat(*[_matches(prompt, p, after) for p, after in zip(PLACE_PATTERNS, PLACE_AFTER)]))
    usable = lambda c: (
        (c != "") & ~c.isin(*PLACE_STOP_WORDS) & ~c.rlike(PLACE_BAD_ENDING) & (F.length(c) <= PLACE_MAX)
    )
    return F.array_distinct(F.filter(F.transform(matches, _place), usable))


def season(prompt: Column) -> Column:
    """First season word in list order that the prompt contains, else empty (R7). Hangul has no case."""
    found = [F.when(F.contains(prompt, F.lit(word)), F.lit(word)) for word in SEASONS]
    return F.coalesce(*found, F.lit(""))


def first_line(text: Column) -> Column:
    """First line that is not blank."""
    return strip(F.regexp_extract(text, r"(?U)\S[^\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*", 0))


def video_title(prompt: Column, summary_text: Column, description: Column, explicit: Column | None = None) -> Column:
    """Explicit title, else last place with kind and season, else a short first line, else a default.

    ``prompt`` and ``summary_text`` are columns that are stripped and not null; ``explicit`` is the prompt's
    ``explicit_title`` where it is a column already.
    """
    chosen = F.when(prompt != "", prompt).otherwise(summary_text)
    kind = F.when(contains_any(chosen, GROUP_KIND_WORDS), F.lit(GROUP_KIND)).otherwise(F.lit(PLAIN_KIND))

    def named(place: Column) -> Column:
        return bind(
            F.struct(F.concat_ws(" ", place, kind).alias("t"), season(chosen).alias("season")),
            lambda x: F.when((x["season"] != "") & ~F.contains(x["t"], x["season"]), F.concat_ws(" ", x["season"], x["t"])).otherwise(x["t"]),
        )

    def fits(line: Column) -> Column:
        return bind(line, lambda t: F.when(F.length(t).between(LINE_MIN, LINE_MAX), t))

    last = F.transform(F.slice(F.reverse(places(chosen)), 1, 1), named)
    return F.coalesce(
        bind(explicit_title(prompt) if explicit is None else explicit, lambda t: F.when(t != "", t)),
        F.get(F.filter(last, lambda t: F.length(t) <= TITLE_MAX), F.lit(0)),
        fits(clean_title(first_line(prompt))),
        fits(clean_title(first_line(summary_text))),
        filled(description),
        F.lit(DEFAULT_TITLE),
    )
