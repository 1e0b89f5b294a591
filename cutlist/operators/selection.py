"""Day budgets and the budgeted selection of candidates.

Ranked by priority, a candidate enters if it keeps the day within 118 % of its budget, and the day is
full once the budget is reached. A candidate of at most 18 % of the budget therefore always enters until
the day is full, so only longer ones can be skipped, and no more than six of those fit. Running sums place
the short ones. Of the long ones each slice keeps those that can enter at all (``greedy``), and one pass over these per
day finds who does: no day is ever held in one task, and nothing is run to find out what to run next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlist.functions.text import contains_any, filled
from cutlist.lexicon import DEFAULT_LEXICON, WORDING, Lexicon, Wording
from cutlist.operators.catalog import travel_days
from cutlist.operators.greedy import thinned
from cutlist.operators.ordered import SLICE, staged, with_order
from cutlist.operators.scoring import _template, anchor_text, search_text
from cutlist.params import DEFAULTS, CutParams

DAY = ["project_id", "date_key"]


def _length(duration: str = "duration_ms") -> Column:
    """Length toward the budget. An inverted segment counts as none (deviation; validation rejects it anyway)."""
    return F.greatest(F.col(duration), F.lit(0).cast("bigint"))


def day_budgets(candidates: DataFrame, targets: DataFrame, params: CutParams = DEFAULTS) -> DataFrame:
    """Share of each day in the project's content length, by the root of its total length.

    ``targets`` has ``project_id`` and ``target_s``. Budgets are rounded to whole milliseconds.
    """
    totals = candidates.groupBy(*DAY).agg(F.sum(_length()).alias("total_ms"))
    seconds = F.coalesce(F.nullif(F.col("total_ms"), F.lit(0)), F.lit(1000)) / 1000
    per_project = Window.partitionBy("project_id")
    cards = params.intro_ms + params.outro_ms + params.title_ms * F.col("n_days")
    target = F.greatest(F.lit(params.min_target_s), F.col("target_s"))
    return (
        totals.withColumn("weight", F.sqrt(seconds))
        .withColumn("n_days", F.count(F.lit(1)).over(per_project))
        .withColumn("_weights", F.sum("weight").over(per_project))
        .join(targets.select("project_id", "target_s"), "project_id", "left")
        .withColumn("target_s", F.coalesce("target_s", F.lit(params.default_minutes * 60)))
        .withColumn("overhead_s", F.rint(cards / 1000).cast("bigint"))
        .withColumn("content_s", F.greatest(F.lit(params.min_content_s).cast("bigint"), target - F.col("overhead_s")))
        .withColumn("share", F.col("weight") / F.col("_weights"))
        .withColumn("budget_ms", F.round(F.col("content_s") * 1000 * F.col("share")).cast("bigint"))
        .select(*DAY, "total_ms", "weight", "share", "n_days", "overhead_s", "content_s", "budget_ms")
    )


#: Slices of a day whose long candidates are thinned out together.
SLICES = 64


def _long_picks(longs: DataFrame, params: CutParams) -> DataFrame:
    """Per day the long candidates that enter, as an array of (rank, ms).

    ``before_ms`` has the length of the short ones before each, so a long one enters if it fits with these and
    with the long ones taken. Every long one is longer than the shortest length that may be skipped, which bounds
    how many enter.
    """
    over = params.overshoot_pct
    most = F.expr(f"budget_ms * {over} div 100 div (budget_ms * {max(over - 100, 0)} div 100 + 1)")
    limits = (
        longs.withColumn("need", F.col("before_ms") + F.col("ms"))
        .withColumn("most", F.greatest(most, F.lit(1).cast("bigint")))
        .withColumn("_block", F.floor(F.col(SLICE) / SLICES))
    )
    thin, schema = thinned("rank", "need", "most"), limits.schema
    left = limits.groupBy(*DAY, SLICE).applyInArrow(thin, schema).groupBy(*DAY, "_block").applyInArrow(thin, schema)
    entry = F.struct("rank", "ms", "before_ms", "budget_ms")
    none = F.array().cast("array<struct<rank:bigint,ms:bigint>>")

    def take(taken: Column, x: Column) -> Column:
        used = x["before_ms"] + taken["total"]
        fits = (used < x["budget_ms"]) & ((used + x["ms"]) * 100 <= x["budget_ms"] * over)
        picked = F.array_append(taken["picks"], F.struct(x["rank"].alias("rank"), x["ms"].alias("ms")))
        return F.when(fits, F.struct((taken["total"] + x["ms"]).alias("total"), picked.alias("picks"))).otherwise(taken)

    start = F.struct(F.lit(0).cast("bigint").alias("total"), none.alias("picks"))
    days = left.groupBy(*DAY).agg(F.array_sort(F.collect_list(entry)).alias("_longs"))
    return days.select(*DAY, F.aggregate("_longs", start, take)["picks"].alias("longs"))


def choose(
    candidates: DataFrame, budgets: DataFrame, params: CutParams = DEFAULTS, slices: int | None = None
) -> DataFrame:
    """Candidates that enter each day's budget, with their ``rank``.

    ``candidates`` has the day key, ``candidate_id``, ``priority``, ``source_utc``, ``start_ms`` and
    ``duration_ms``. Equal priorities go by time, start and id.
    """
    over = params.overshoot_pct
    if over < 100:
        raise ValueError(f"a day of {over} % of its budget is never full")
    ms = _length()
    narrow = candidates.select(*DAY, "candidate_id", "priority", "source_utc", "start_ms", ms.alias("ms")).join(
        budgets.select(*DAY, "budget_ms"), DAY
    )
    short = F.col("ms") * 100 <= F.col("budget_ms") * (over - 100)
    ordered = with_order(
        narrow,
        DAY,
        [F.col("priority").desc(), F.col("source_utc"), F.col("start_ms"), F.col("candidate_id")],
        "rank",
        {"short_ms": F.when(short, F.col("ms")).otherwise(F.lit(0).cast("bigint"))},
        slices,
    )
    # Read several times below, so the ordering is done once.
    ranked = staged(ordered.withColumn("before_ms", F.col("short_ms") - F.when(short, F.col("ms")).otherwise(F.lit(0))))

    heads = ranked.groupBy(*DAY).agg(
        F.max("rank").alias("n"),
        F.max(F.when(F.col("rank") == 1, F.col("ms"))).alias("head_ms"),
        F.max("budget_ms").alias("_budget"),
    )
    # A first pick that fills the day alone: with three or more candidates one more may follow, if it fits.
    full = heads.filter("head_ms >= _budget")
    pieces = ranked.select(*DAY, SLICE).distinct()
    second = (
        ranked.join(pieces.join(full.filter("n >= 3").select(*DAY, "head_ms"), DAY), [*DAY, SLICE])
        .filter(F.col("rank") > 1)
        .filter((F.col("head_ms") + F.col("ms")) * 100 <= F.col("budget_ms") * over)
        .groupBy(*DAY)
        .agg(F.min("rank").alias("second"))
    )
    longs = (
        ranked.filter(~short)
        .filter(F.col("before_ms") < F.col("budget_ms"))
        .filter((F.col("before_ms") + F.col("ms")) * 100 <= F.col("budget_ms") * over)
        .select(*DAY, SLICE, "rank", "ms", "before_ms", "budget_ms")
    )
    days = heads.select(*DAY, (F.col("head_ms") >= F.col("_budget")).alias("is_full")).join(second, DAY, "left")
    none = F.array().cast("array<struct<rank:bigint,ms:bigint>>")
    days = days.join(_long_picks(longs, params), DAY, "left").withColumn("longs", F.coalesce("longs", none))

    long_before = F.aggregate(
        F.filter("longs", lambda x: x["rank"] < F.col("rank")), F.lit(0).cast("bigint"), lambda t, x: t + x["ms"]
    )
    enters = (
        F.when(F.col("is_full"), (F.col("rank") == 1) | F.coalesce(F.col("rank") == F.col("second"), F.lit(False)))
        .when(short, F.col("before_ms") + long_before < F.col("budget_ms"))
        .otherwise(F.exists("longs", lambda x: x["rank"] == F.col("rank")))
    )
    return (
        ranked.join(pieces.join(days, DAY), [*DAY, SLICE])
        .filter(enters)
        .select(*DAY, "candidate_id", "rank", F.col("ms").alias("used_ms"))
    )


def infer_role(lexicon: Lexicon = DEFAULT_LEXICON) -> Column:
    """Opener, closer, meal, reaction, transition or moment, in that order."""
    anchor, text = F.lower(F.coalesce(F.col("route_phase"), F.lit(""))), search_text()
    return (
        F.when((F.col("travel_day") == 1) & (F.col("sequence_index") == 1), F.lit("opener"))
        .when(
            (F.col("travel_day") == F.col("total_days")) & (F.col("sequence_index") == F.col("n_selected")),
            F.lit("closer"),
        )
        .when(F.contains(anchor, F.lit("meal")) | contains_any(text, lexicon.role_meal), F.lit("meal"))
        .when(F.contains(anchor, F.lit("reaction")) | contains_any(text, lexicon.role_reaction), F.lit("reaction"))
        .when(contains_any(anchor, lexicon.role_transit_anchors), F.lit("transition"))
        .otherwise(F.lit("moment"))
    )


def selection_reason(params: CutParams = DEFAULTS, wording: Wording = WORDING) -> Column:
    """Why a segment was chosen: by role, else anchor, else people, else its summary (P20)."""
    anchor = anchor_text()
    people = F.coalesce(F.col("people"), F.array().cast("array<string>"))
    values = {
        "anchor": anchor,
        "event": F.coalesce(filled(F.col("event_type")), F.lit("scene")),
        "people": F.array_join(F.slice(people, 1, params.reason_people), ", "),
        "excerpt": F.substring(F.coalesce(F.col("excerpt"), F.lit("")), 1, params.reason_chars),
    }
    by_role = F.lit(None).cast("string")
    for role in ("meal", "reaction", "opener", "closer"):
        by_role = F.when(F.col("role") == role, _template(wording.reasons[role], values)).otherwise(by_role)
    return F.coalesce(
        by_role,
        F.when(anchor != "", _template(wording.reasons["anchor"], values)),
        F.when(F.size(people) > 0, _template(wording.reasons["people"], values)),
        filled(F.col("summary")),
        F.btrim(_template(wording.reasons["plain"], values)),
    )


def place_in_day(chosen: DataFrame, slices: int | None = None) -> DataFrame:
    """Order chosen candidates by time within their day and count them."""
    order = [F.col("source_utc"), F.col("start_ms"), F.col("end_ms"), F.col("candidate_id")]
    placed = with_order(chosen, DAY, order, "sequence_index", slices=slices)
    counts = placed.groupBy(*DAY).agg(F.max("sequence_index").alias("n_selected"))
    pieces = placed.select(*DAY, SLICE).distinct()
    return placed.join(pieces.join(counts, DAY), [*DAY, SLICE]).drop(SLICE)


def select_segments(
    candidates: DataFrame,
    targets: DataFrame,
    params: CutParams = DEFAULTS,
    lexicon: Lexicon = DEFAULT_LEXICON,
    wording: Wording = WORDING,
    slices: int | None = None,
) -> DataFrame:
    """Selection rows of every project (C4): one row per chosen candidate, numbered per day."""
    budgets = day_budgets(candidates, targets, params)
    picked = choose(candidates, budgets, params, slices).select("project_id", "candidate_id")
    rows = candidates.drop("travel_day", "total_days").join(picked, ["project_id", "candidate_id"], "left_semi")
    days = travel_days(candidates)
    return (
        place_in_day(rows, slices)
        .join(days, DAY)
        .withColumn("enabled", F.lit(True))
        .withColumn("role", infer_role(lexicon))
        .withColumn("reason", selection_reason(params, wording))
        .withColumn("day_label", F.concat(F.lit("Day "), F.col("travel_day").cast("string"), F.lit(" · "), F.col("date_key").cast("string")))
        .select(
            "project_id", "travel_day", "date_key", "day_label", "candidate_id", "clip_path", "start_ms", "end_ms",
            "sequence_index", "enabled", "role", "reason", "summary",
        )
    )
