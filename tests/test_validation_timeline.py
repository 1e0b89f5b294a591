"""Validation rules, timelines, chunks and edit lists."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cutlist.operators.timeline import (
    build_timeline,
    chapters,
    chunk_timeline,
    edit_list,
    missing_clips,
    number_chunks,
    plan_faults,
    sound_selections,
    timeline_summary,
)
from cutlist.operators.validate import SelectionError, validate_selection
from cutlist.schemas import SELECTION, TIMELINE_ITEM

CANDIDATES = "project_id bigint, candidate_id string, clip_path string, date_key string, start_ms bigint, end_ms bigint"


def pick(**fields):
    base = {
        "project_id": 1, "travel_day": 1, "date_key": "2024-01-01", "day_label": "", "candidate_id": "a", "clip_path": "/a",
        "start_ms": 1000, "end_ms": 3000, "sequence_index": 1, "enabled": True, "role": "moment", "reason": "r",
    }
    return {**base, **fields}


def check(spark, *picks, projects=None):
    known = [(1, c, f"/{c}", "2024-01-01", 1000, 3000) for c in "abcdef"]
    return validate_selection(spark.createDataFrame(list(picks), SELECTION), spark.createDataFrame(known, CANDIDATES), projects)


@pytest.mark.parametrize(
    "fields, rules",
    [
        ({}, []),
        ({"enabled": None}, []),
        ({"enabled": False, "role": ""}, []),
        ({"candidate_id": "zz"}, ["V2"]),
        ({"clip_path": "/b"}, ["V3"]),
        ({"date_key": "2024-01-02"}, ["V4"]),
        ({"date_key": " "}, []),
        ({"start_ms": 990, "end_ms": 3010}, []),
        ({"start_ms": 989}, ["V6"]),
        ({"end_ms": 3011}, ["V6"]),
        ({"end_ms": 1000}, ["V6"]),
        ({"start_ms": None}, ["V5"]),
        ({"role": "", "clip_path": "/x"}, ["V3", "V7"]),
        ({"reason": " "}, ["V7"]),
        ({"sequence_index": 2}, ["V8"]),
    ],
)
def test_rules(spark, fields, rules):
    valid, violations = check(spark, pick(**fields))
    assert sorted(r.rule for r in violations.collect()) == rules
    expected = 1 if fields.get("enabled", True) is not False and not rules else 0
    assert valid.count() == expected


def test_numbers_given_as_text(spark):
    text = SELECTION.simpleString()
    df = spark.createDataFrame([pick()], SELECTION).withColumn("start_ms", F.lit("x")).withColumn("end_ms", F.lit("3000"))
    known = spark.createDataFrame([(1, "a", "/a", "2024-01-01", 1000, 3000)], CANDIDATES)
    assert [r.rule for r in validate_selection(df, known)[1].collect()] == ["V5"] and text


@pytest.mark.parametrize("start, end, rules", [
    (1000.0, 3000.0, []), ("1000", "3000.0", []), ("1.0E3", 3e3, []), (None, 3000.0, ["V5"]), ("soon", "3000", ["V5"]), (float("nan"), 3000.0, ["V5"]),
])
def test_kinds_of_numbers(spark, start, end, rules):
    """Bounds held as double, as text, or not at all."""
    rows = spark.createDataFrame([pick()], SELECTION).withColumn("start_ms", F.lit(start)).withColumn("end_ms", F.lit(end))
    rows = rows.withColumn("sequence_index", F.col("sequence_index").cast("double"))
    valid, violations = validate_selection(rows, spark.createDataFrame([(1, "a", "/a", "2024-01-01", 1000, 3000)], CANDIDATES))
    assert [r.rule for r in violations.collect()] == rules
    assert [(r.start_ms, r.end_ms, r.sequence_index) for r in valid.collect()] == ([] if rules else [(1000, 3000, 1)])


def test_films_are_complete_or_not_made(spark):
    """A missing clip, a missing title and a fault of the selection each cost the whole film, and are told."""
    clips = spark.createDataFrame(
        [(p, c, c[1:] + ".mp4", datetime(2024, 1, 1, 9), True) for p in (1, 2, 3, 4) for c in ("/a", "/b") if (p, c) != (2, "/b")],
        "project_id bigint, clip_path string, filename string, start_local timestamp_ntz, has_audio boolean",
    )
    rows = [
        pick(project_id=p, candidate_id=c, clip_path=f"/{c}", sequence_index=n, role="" if (p, c) == (4, "b") else "moment")
        for p in (1, 2, 3, 4) for n, c in enumerate("ab", 1)
    ]
    known = [(p, c, f"/{c}", "2024-01-01", 1000, 3000) for p in (1, 2, 3, 4) for c in "ab"]
    valid, violations = validate_selection(spark.createDataFrame(rows, SELECTION), spark.createDataFrame(known, CANDIDATES))
    titles = spark.sql("select id as project_id, 'T' as title from range(1, 5) where id <> 3")
    faults = plan_faults(valid, violations, clips, titles)
    assert sorted((r.project_id, r.rule, r.detail) for r in faults.collect()) == [(2, "J9", "/b"), (3, "T1", ""), (4, "V7", "")]
    items = build_timeline(sound_selections(valid, faults), clips, titles)
    assert [(i.project_id, i.kind) for i in items.orderBy("pos").collect()] == [(1, k) for k in ("title", "title", "segment", "segment", "title")]


def test_sequence_must_be_contiguous(spark):
    ok = [pick(candidate_id=c, clip_path=f"/{c}", sequence_index=i) for i, c in enumerate("abc", 1)]
    assert check(spark, *ok)[1].count() == 0
    gap = check(spark, ok[0], pick(candidate_id="b", clip_path="/b", sequence_index=3))[1].first()
    assert (gap.rule, gap.detail) == ("V8", "1/3/2/2")
    twice = check(spark, ok[0], ok[1], pick(candidate_id="c", clip_path="/c", sequence_index=2))[1].first()
    assert (twice.rule, twice.detail) == ("V8", "1/2/2/3")


def test_projects_without_rows(spark):
    projects = spark.createDataFrame([(1,), (2,)], "project_id bigint")
    found = check(spark, pick(enabled=False), projects=projects)[1].collect()
    assert sorted((r.project_id, r.rule) for r in found) == [(1, "V9"), (2, "V11"), (2, "V9")]


def test_labels_and_fail_fast(spark):
    valid, _ = check(spark, pick(travel_day=4))
    assert valid.first().day_label == "Day 4"
    rows = spark.createDataFrame([pick(role="")], SELECTION)
    with pytest.raises(SelectionError, match="V7"):
        validate_selection(rows, spark.createDataFrame([(1, "a", "/a", "2024-01-01", 1000, 3000)], CANDIDATES), fail_fast=True)


def film(spark, titles="select 1L as project_id, 'T' as title"):
    clips = spark.createDataFrame(
        [(1, "/a", "a.mp4", datetime(2024, 1, 1, 9), True), (1, "/b", "b.mp4", datetime(2024, 1, 3, 9), False)],
        "project_id bigint, clip_path string, filename string, start_local timestamp_ntz, has_audio boolean",
    )
    rows = [
        pick(travel_day=2, day_label="Second", candidate_id="c", clip_path="/b", sequence_index=1, end_ms=6000),
        pick(travel_day=1, candidate_id="b", clip_path="/a", sequence_index=2, role="meal"),
        pick(travel_day=1, candidate_id="a", clip_path="/a", sequence_index=1),
        pick(travel_day=2, candidate_id="x", clip_path="/gone", sequence_index=2),
    ]
    selections = spark.createDataFrame(rows, SELECTION)
    assert [r.candidate_id for r in missing_clips(selections, clips).collect()] == ["x"]
    return build_timeline(selections, clips, spark.sql(titles))


def test_timeline(spark):
    got = [(r.pos, r.kind, r.label, r.cursor_ms, r.duration_ms) for r in film(spark).orderBy("pos").collect()]
    assert got == [
        (1, "title", "T · 2024.01.01 - 2024.01.03", 0, 3600),
        (2, "title", "Day 1", 3600, 2600),
        (3, "segment", "moment · a.mp4", 6200, 2000),
        (4, "segment", "meal · a.mp4", 8200, 2000),
        (5, "title", "Second", 10200, 2600),
        (6, "segment", "moment · b.mp4", 12800, 5000),
        (7, "title", "End of the trip · T", 17800, 2800),
    ]
    kept = [(r.filename, r.source_local, r.route_label, r.reason) for r in film(spark).orderBy("pos").collect()]
    assert kept[2] == ("a.mp4", datetime(2024, 1, 1, 9), "", pick()["reason"]) and kept[0] == ("", None, "", "")
    total = timeline_summary(film(spark)).first()
    assert (total.target_ms, total.n_items, total.n_segments) == (20600, 7, 3)


def test_given_date_span_and_chapters(spark):
    items = film(spark, "select 1L as project_id, 'T' as title, '2024.02.02' as date_span")
    assert items.orderBy("pos").first().label == "T · 2024.02.02"
    assert [(r.timecode, r.label) for r in chapters(items).orderBy("pos").collect()] == [
        ("00:00", "Intro"), ("00:04", "Day 1"), ("00:10", "Second"), ("00:18", "Outro"),
    ]


def item(pos, kind, label, ms=1000, project=1, **fields):
    return {"project_id": project, "pos": pos, "kind": kind, "label": label, "duration_ms": ms, **fields}


def test_chunks(spark):
    rows = [
        item(1, "segment", "Cold Open tease"), item(2, "segment", "x"), item(3, "title", "One · Two"), item(4, "segment", "y"),
        item(5, "title", " "), item(6, "title", "!!!"),
        item(1, "segment", "a", project=2), item(2, "segment", "b", None, project=2, start_ms=500, end_ms=1200),
        item(1, "segment", "p", project=3), item(2, "title", "Q", project=3),
    ]
    items = spark.createDataFrame(rows, TIMELINE_ITEM)
    titles = spark.createDataFrame([(1, "Film"), (2, ""), (3, "F")], "project_id bigint, title string")
    got = [
        (r.project_id, r.chunk_index, r.label, r.slug, r.n_items, r.target_ms, r.card_subtitle)
        for r in chunk_timeline(items, titles).orderBy("project_id", "chunk_index").collect()
    ]
    assert got == [
        (1, 1, "Cold Open", "cold-open", 2, 2000, ""),
        (1, 2, "One · Two", "one---two", 2, 2000, "Two"),
        (1, 3, "Chapter 2", "chapter-2", 1, 1000, ""),
        (1, 4, "!!!", "chapter-3", 1, 1000, ""),
        (2, 1, "Timeline", "timeline", 2, 1700, ""),
        (3, 1, "Prelude", "prelude", 1, 1000, ""),
        (3, 2, "Q", "q", 1, 1000, ""),
    ]
    numbers = {(r.project_id, r.pos): r.chunk_no for r in number_chunks(items).collect()}
    assert numbers[1, 2] == 0 and numbers[1, 4] == 1 and numbers[1, 6] == 3


def test_edit_list(spark):
    rows = [
        item(1, "title", "T", 900), item(2, "segment", "a", 2000, clip_path="/a", has_audio=True),
        item(3, "segment", "b", 50, clip_path="/b", has_audio=False), item(4, "segment", "a", 9000, clip_path="/a", has_audio=True),
        item(1, "title", "U", 100, project=2),
    ]
    got = [
        (r.project_id, r.input, r.input_index, r.video_fade_ms, r.video_fade_out_ms, r.audio, r.audio_fade_ms, r.audio_fade_out_ms, r.has_live_audio)
        for r in edit_list(spark.createDataFrame(rows, TIMELINE_ITEM)).orderBy("project_id", "pos").collect()
    ]
    assert got == [
        (1, "title_000", 0, 100, 800, "title", 0, 0, True),
        (1, "/a", 1, 150, 1850, "clip", 180, 1820, True),
        (1, "/b", 2, 100, 0, "silence", 0, 0, True),
        (1, "/a", 1, 240, 8760, "clip", 200, 8800, True),
        (2, "title_000", 0, 100, 0, "title", 0, 0, False),
    ]
