"""Keyword scoring of candidates.

Scores are whole thousandths and priorities whole hundred-thousandths, so sums are exact and equal in
every engine. Rounding is half up on the exact value (deviation: not half-even on a binary double).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlist.functions.briefs import editorial_text, must_include_terms, people_terms
from cutlist.functions.text import collapse, contains_any, filled, hits
from cutlist.lexicon import DEFAULT_LEXICON, WORDING, Lexicon, Wording
from cutlist.params import DEFAULTS, CutParams

FEATURES = ("importance", "fun", "people", "audio", "scenery", "food", "emotion", "transition", "duration_fit")

# Percent weights of the overall score and of the priority.
OVERALL_WEIGHTS = {
    "importance": 34, "fun": 16, "people": 12, "emotion": 12, "food": 8, "scenery": 8, "transition": 5, "audio": 3,
    "duration_fit": 2,
}
PRIORITY_WEIGHTS = {"importance": 35, "fun": 12, "emotion": 8}


def search_text() -> Column:
    """Excerpt, anchors and file name, lowered (P10)."""
    fields = ("excerpt", "route_phase", "story_anchor_label", "location_id", "location_id", "filename")
    return F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))


def anchor_text() -> Column:
    return F.coalesce(filled(F.col("story_anchor_label")), filled(F.col("route_phase")), F.lit(""))


def event_type(text: Column, anchor: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """First kind in list order with a word in the text or the anchor."""
    combined = F.lower(F.concat_ws(" ", anchor, text))
    kinds = [F.when(contains_any(combined, words), F.lit(kind)) for kind, words in lexicon.events]
    return F.coalesce(*kinds, F.lit(lexicon.default_event))


def people_in(text: Column, people: Column, lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Named people whose name or alias is in the text, in list order, then groups."""
    said = lambda word: F.contains(text, F.lower(word))
    named = F.transform(
        F.filter(people, lambda p: said(p["canonical"]) | F.exists(p["aliases"], said)), lambda p: p["canonical"]
    )
    named = F.coalesce(named, F.array().cast("array<string>"))
    groups = [
        F.when(contains_any(text, words) & ~F.array_contains(named, label), F.lit(label))
        for label, words in lexicon.groups
    ]
    return F.concat(named, F.array_compact(F.array(*groups)))


def summary_text(
    event: Column, people: Column, excerpt: Column, params: CutParams = DEFAULTS, wording: Wording = WORDING
) -> Column:
    """Event, people and the first characters of the excerpt on one line."""
    gist = F.substring(filled(collapse(excerpt), wording.no_speech), 1, params.summary_chars)
    who = F.when(F.size(people) > 0, F.array_join(people, ", ")).otherwise(F.lit(wording.no_people))
    return F.btrim(_template(wording.summary, {"event": event, "people": who, "gist": gist}))


def _template(pattern: str, values: Mapping[str, Column]) -> Column:
    """``pattern`` with each ``{name}`` replaced by a column."""
    parts, rest = [], pattern
    while rest:
        before, brace, after = rest.partition("{")
        parts.append(F.lit(before))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(values[name])
    return F.concat(*parts)


def brief_context(briefs: DataFrame) -> DataFrame:
    """What scoring needs of each brief, one row per project."""
    return briefs.select(
        "project_id",
        people_terms(F.col("people")).alias("_people_terms"),
        must_include_terms(F.col("editorial_brief.must_include")).alias("_must_include"),
        F.lower(editorial_text(F.col("editorial_brief"))).alias("_editorial"),
    )


def _thousandths(points: Column, per: int) -> Column:
    return F.floor((points + per // 2) / per).cast("int")


def feature_columns(lexicon: Lexicon = DEFAULT_LEXICON) -> dict[str, Column]:
    """Nine scores in thousandths.

    Reads ``_text``, ``_people``, ``route_phase``, ``duration_ms``, ``has_audio``, ``day_index``,
    ``total_days``, ``_must_include`` and ``_editorial``.
    """
    text, anchor = F.col("_text"), F.lower(F.coalesce(F.col("route_phase"), F.lit("")))
    editorial = F.coalesce(F.col("_editorial"), F.lit(""))
    points = lambda condition, value: F.when(condition, F.lit(value)).otherwise(F.lit(0))
    fun = F.lit(150) + hits(text, lexicon.laugh, 180, 550) + hits(text, lexicon.treat, 80, 220)
    food = hits(text, lexicon.meal, 250, 1000)
    importance = (
        F.lit(35000)
        + points(F.exists(F.col("_must_include"), lambda t: F.contains(text, t)), 35000)
        + points(anchor != "", 12000)
        + points((F.col("day_index") == 1) & contains_any(anchor, lexicon.opening_anchors), 18000)
        + points((F.col("day_index") == F.col("total_days")) & contains_any(anchor, lexicon.closing_anchors), 18000)
        + F.when(contains_any(editorial, lexicon.brief_meal), food * 18).otherwise(F.lit(0))
        + F.when(contains_any(editorial, lexicon.brief_reaction), fun * 14).otherwise(F.lit(0))
    )
    top = lambda value: F.least(F.lit(1000), value).cast("int")
    length = F.col("duration_ms")
    return {
        "importance": _thousandths(F.least(F.lit(100000), importance), 100),
        "fun": top(fun),
        "people": top(F.lit(220) + F.size("_people") * 260),
        "audio": F.when(F.coalesce(F.col("has_audio"), F.lit(False)), F.lit(1000)).otherwise(F.lit(250)),
        "scenery": top(F.lit(120) + hits(text, lexicon.scenery, 180, 680)),
        "food": top(food),
        "emotion": top(F.lit(100) + hits(text, lexicon.emotion, 200, 800)),
        "transition": top(hits(F.concat_ws(" ", text, anchor), lexicon.travel, 240, 1000)),
        "duration_fit": F.when(length.between(2500, 14000), F.lit(1000))
        .when(length > 22000, F.lit(450))
        .otherwise(F.lit(650)),
    }


def overall_score(features: str = "features") -> Column:
    points = sum((F.col(f"{features}.{name}") * weight for name, weight in OVERALL_WEIGHTS.items()), F.lit(0))
    return _thousandths(F.least(F.lit(100000), points), 100)


def priority_score(features: str = "features", overall: str = "overall") -> Column:
    """Hundred-thousandths."""
    points = F.col(overall).cast("bigint") * 100
    for name, weight in PRIORITY_WEIGHTS.items():
        points = points + F.col(f"{features}.{name}") * weight
    return points


def score_candidates(
    candidates: DataFrame,
    briefs: DataFrame,
    days: DataFrame | None = None,
    lexicon: Lexicon = DEFAULT_LEXICON,
    params: CutParams = DEFAULTS,
    wording: Wording = WORDING,
) -> DataFrame:
    """Event type, people, scores and summary of each candidate.

    ``days`` holds ``travel_day`` and ``total_days`` per project and date (``travel_days``); without it the
    candidates' own ``travel_day`` counts, where 0 or null reads as day 1.
    """
    if days is not None:
        numbered = candidates.drop("travel_day", "total_days").join(days, ["project_id", "date_key"], "left")
        index = F.col("travel_day")
    else:
        totals = candidates.groupBy("project_id").agg(F.max(F.coalesce("travel_day", F.lit(0))).alias("total_days"))
        numbered = candidates.join(totals, "project_id")
        index = F.greatest(F.lit(1), F.coalesce("travel_day", F.lit(1)))
    kept = [c for c in candidates.columns if c not in ("travel_day", "total_days")]
    return (
        numbered.join(brief_context(briefs), "project_id", "left")
        .withColumn("day_index", index)
        .withColumn("_must_include", F.coalesce("_must_include", F.array().cast("array<string>")))
        .withColumn("_text", search_text())
        .withColumn("_people", people_in(F.col("_text"), F.col("_people_terms"), lexicon))
        .withColumn("event_type", event_type(F.col("_text"), anchor_text(), lexicon))
        .withColumn("features", F.struct(*[v.alias(k) for k, v in feature_columns(lexicon).items()]))
        .withColumn("overall", overall_score())
        .withColumn("priority", priority_score())
        .withColumn(
            "summary", summary_text(F.col("event_type"), F.col("_people"), F.coalesce("excerpt", F.lit("")), params, wording)
        )
        .select(
            *kept, "travel_day", "total_days", F.col("_people").alias("people"), "event_type", "features", "overall",
            "priority", "summary",
        )
    )
