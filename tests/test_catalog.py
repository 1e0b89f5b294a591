"""Clip fields, time context and per-project facts."""

import random
from bisect import bisect_right
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from cutlist.functions import media
from cutlist.functions.briefs import brief_dimension, place_zones, replacement_rules
from cutlist.functions.text import file_name, filled, filled_field, strip, strip_field
from cutlist.functions.timekeys import day_key, filename_time, iso_instant, iso_wall_clock, known_zones, wall_clock
from cutlist.operators.anchors import disjoint
from cutlist.operators.catalog import (
    bisected,
    build_clips,
    date_spans,
    dominant_fps,
    probe_fields,
    rejected_anchors,
    rejected_probes,
    resolve_by_anchor_rows,
    resolve_time_context,
    time_contexts,
    travel_days,
)
from cutlist.schemas import BRIEF, PROBE_DOCUMENT, row, LONG, TEXT


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize(
    "text, want", [("0/0", 30.0), ("30/0", 30.0), ("30000/1001", 30000 / 1001), ("25", 25.0), ("", 30.0), (None, 30.0)]
)
def test_frame_rate(spark, text, want):
    assert one(spark, media.frame_rate(F.lit(text).cast("string"))).c0 == want


def test_times(spark):
    got = one(
        spark,
        iso_instant(F.lit("2024-03-01T10:00:00Z")),
        iso_instant(F.lit("2024-03-01T10:00:00.250+09:00")),
        iso_instant(F.lit("2024-03-01T10:00:00-0330")),
        iso_instant(F.lit("2024-03-01T10:00:00")),
        iso_instant(F.lit("yesterday")),
        iso_wall_clock(F.lit("2024-03-01T10:00:00+09:00")),
        filename_time(F.lit("VID_20240301_235959_1.mp4")),
        filename_time(F.lit("VID_20241301_235959.mp4")),
        filename_time(F.lit("20240301_235960.mp4")),
        filename_time(F.lit("clip.mp4")),
    )
    d = datetime
    assert list(got) == [
        d(2024, 3, 1, 10), d(2024, 3, 1, 1, 0, 0, 250000), d(2024, 3, 1, 13, 30), d(2024, 3, 1, 10), None,
        d(2024, 3, 1, 10), d(2024, 3, 1, 23, 59, 59), None, None, None,
    ]


@pytest.mark.parametrize(
    "local, hour, want",
    [("2024-03-02 03:59:59", 4, "2024-03-01"), ("2024-03-02 04:00:00", 4, "2024-03-02"), ("2024-03-02 00:00:00", -3, "2024-03-02")],
)
def test_day_key(spark, local, hour, want):
    assert str(one(spark, day_key(F.expr(f"timestamp_ntz'{local}'"), hour)).c0) == want


def test_wall_clock_over_a_clock_change(spark):
    start = datetime(2024, 3, 31, 0, 30)
    rows = [(start + timedelta(minutes=30 * i),) for i in range(6)]
    df = spark.createDataFrame(rows, "utc timestamp_ntz").withColumn("local", wall_clock(F.col("utc"), F.lit("Europe/Berlin")))
    for r in df.collect():
        want = r.utc.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo("Europe/Berlin")).replace(tzinfo=None)
        assert r.local == want


def test_results_do_not_depend_on_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        got = one(spark, iso_instant(F.lit("2024-03-01T10:00:00Z")), wall_clock(F.expr("timestamp_ntz'2024-03-31 01:30:00'"), F.lit("Europe/Berlin")))
        assert list(got) == [datetime(2024, 3, 1, 10), datetime(2024, 3, 31, 3, 30)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_unknown_zones_are_left_out(spark):
    zones = known_zones(spark)
    assert "Asia/Seoul" in zones and "Nowhere/Unknown" not in zones


ANCHORS = [
    {"starts_at": "2024-03-01T09:00:00+00:00", "ends_at": "2024-03-01T12:00:00", "timezone": "Asia/Seoul",
     "location_id": "a", "story_anchor_id": "s1", "label": "morning"},
    {"starts_at": "", "ends_at": None, "timezone": "UTC", "story_anchor_id": "never"},
    {"starts_at": "2024-03-01T11:00:00", "ends_at": "", "timezone": "", "location_id": "b", "story_anchor_id": "s2",
     "label": "rest"},
    {"starts_at": "", "ends_at": "2024-02-01T00:00:00", "timezone": "Not/AZone", "location_id": "c", "label": "before"},
]


def brief(**extra):
    return {
        "project_id": 1, "version": "3", "project": {"default_timezone": "Europe/Berlin"},
        "places": [{"id": "b", "timezone": "America/Lima"}, {"id": "b", "timezone": "Asia/Tokyo"}, {"id": "", "timezone": "UTC"}],
        "story_anchors": [{"id": "s1", "label": "old"}, {"id": "s1", "label": "Arrival"}, {"id": "s2", "label": " "}],
        "time_anchors": ANCHORS, **extra,
    }


def context(spark, brief_row, instants):
    clips = spark.createDataFrame([(1, i, t) for i, t in enumerate(instants)], "project_id bigint, n int, creation_utc timestamp_ntz")
    placed = resolve_time_context(clips, time_contexts(spark.createDataFrame([brief_row], BRIEF)))
    return [(r.timezone_name, r.location_id, r.route_phase, r.route_label) for r in placed.orderBy("n").collect()]


def test_unreadable_bounds_reject_the_anchor(spark):
    """A bound that is there but is no time does not count as open."""
    anchors = [
        {"starts_at": "soon", "ends_at": "2030-01-01T00:00:00", "location_id": "x"},
        {"starts_at": "2020-01-01T00:00:00", "ends_at": "2020-13-01", "location_id": "y"},
        {"starts_at": "2020-01-01T00:00:00", "location_id": "z"},
    ]
    frame = spark.createDataFrame([brief(time_anchors=anchors)], BRIEF)
    assert context(spark, brief(time_anchors=anchors), [datetime(2024, 5, 1)])[0][1] == "z"
    assert sorted(r.ordinal for r in rejected_anchors(frame).collect()) == [0, 1]


def test_time_context(spark):
    got = context(
        spark,
        brief(),
        [
            datetime(2024, 3, 1, 0, 0),  # 09:00 in Seoul, the first bound itself
            datetime(2024, 3, 1, 3, 0),  # 12:00 in Seoul, the last bound; the open one holds too but comes later
            datetime(2024, 3, 1, 3, 0, 1),
            datetime(2024, 1, 31, 23, 0),  # midnight in Berlin, where an unknown zone falls back to
            datetime(2024, 2, 10),
            None,
        ],
    )
    assert got == [
        ("Asia/Seoul", "a", "s1", "Arrival"),
        ("Asia/Seoul", "a", "s1", "Arrival"),
        ("Asia/Tokyo", "b", "s2", "rest"),
        ("Europe/Berlin", "c", "", "before"),
        ("Europe/Berlin", "", "", ""),
        ("Europe/Berlin", "", "", ""),
    ]


def test_time_context_equals_a_loop(spark):
    """Naive wall clocks in each anchor's zone, through the hours a clock change skips and repeats."""
    rng = random.Random(4)
    zones = ["Europe/Berlin", "America/New_York", "UTC"]
    day = datetime(2024, 10, 26)
    anchors = []
    for i in range(12):
        start = day + timedelta(minutes=30 * rng.randint(0, 120))
        bounds = [start, start + timedelta(minutes=30 * rng.randint(0, 12))]
        texts = [b.isoformat() if rng.random() > 0.1 else "" for b in bounds]
        anchors.append({"starts_at": texts[0], "ends_at": texts[1], "timezone": rng.choice(zones), "location_id": f"p{i}"})
    instants = [day + timedelta(minutes=15 * i) for i in range(0, 260)]

    def want(t):
        for a in anchors:
            local = t.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(a["timezone"])).replace(tzinfo=None)
            low, high = a["starts_at"], a["ends_at"]
            if not low and not high:
                continue
            if (not low or local >= datetime.fromisoformat(low)) and (not high or local <= datetime.fromisoformat(high)):
                return a["location_id"]
        return ""

    got = context(spark, brief(time_anchors=anchors), instants)
    assert [g[1] for g in got] == [want(t) for t in instants]


def test_disjoint_intervals_equal_a_search():
    rng = random.Random(8)
    for _ in range(300):
        some = lambda: None if rng.random() < 0.15 else rng.randint(0, 40)
        intervals = [(some(), some(), i) for i in range(rng.randint(0, 12))]
        rng.shuffle(intervals)
        breaks, firsts = disjoint(intervals)
        assert breaks == sorted(set(breaks)) and all(a != b for a, b in zip(firsts, firsts[1:]))
        for x in range(-2, 44):
            holding = [i for a, b, i in intervals if (a is None or a <= x) and (b is None or x <= b)]
            at = bisect_right(breaks, x)
            assert (firsts[at - 1] if at else -1) == min(holding, default=-1)


def test_a_clip_converts_its_instant_once_a_zone(spark):
    clips = spark.createDataFrame([(1, datetime(2024, 1, 1))], "project_id bigint, creation_utc timestamp_ntz")
    placed = resolve_time_context(clips, time_contexts(spark.createDataFrame([brief()], BRIEF)))
    plan = placed._jdf.queryExecution().optimizedPlan().toString()
    # Once in the plan, and not in a step of the search.
    assert plan.count("convert_timezone(") == 1
    assert "convert_timezone(" not in plan[plan.index("aggregate(") :]


def test_bisection_equals_a_search(spark):
    rows = [([3 * i for i in range(n)], v) for n in (0, 1, 2, 3, 4, 7, 8, 9, 24) for v in range(-1, 3 * n + 2)]
    df = spark.createDataFrame(rows, "rising array<bigint>, value bigint")
    got = df.select("rising", "value", bisected(F.col("rising"), F.col("value")).alias("at")).collect()
    assert [r["at"] for r in got] == [bisect_right(r["rising"], r["value"]) for r in got]


def test_many_anchors_in_one_brief(spark):
    rng = random.Random(6)
    day = datetime(2024, 1, 1)
    anchors = []
    for i in range(10_000):
        start = day + timedelta(minutes=rng.randint(0, 500_000))
        bounds = (start, start + timedelta(minutes=rng.randint(0, 300)))
        anchors.append({"starts_at": bounds[0].isoformat(), "ends_at": bounds[1].isoformat(), "timezone": rng.choice(["UTC", "Etc/GMT-9"]), "location_id": f"p{i}"})
    instants = [day + timedelta(minutes=rng.randint(0, 500_000)) for _ in range(300)]
    held = [(datetime.fromisoformat(a["starts_at"]), datetime.fromisoformat(a["ends_at"]), a["timezone"]) for a in anchors]

    def want(t):
        local = {"UTC": t, "Etc/GMT-9": t + timedelta(hours=9)}
        return next((f"p{i}" for i, (low, high, zone) in enumerate(held) if low <= local[zone] <= high), "")

    contexts = time_contexts(spark.createDataFrame([brief(time_anchors=anchors)], BRIEF))
    assert contexts.select(F.expr("forall(zones, z -> size(z.breaks) <= 20000)")).first()[0]
    got = context(spark, brief(time_anchors=anchors), instants)
    assert [g[1] for g in got] == [want(t) for t in instants]


def test_anchor_rows_equal_the_brief_however_they_are_sliced(spark):
    """Open bounds, long and empty intervals, equal bounds, instants at bounds, unknown zones; clips without a brief or time."""
    rng = random.Random(9)
    day = datetime(2024, 10, 26)
    briefs, rows = [], []
    for project in (1, 2):
        own = list(ANCHORS) if project == 1 else []
        for i in range(150):
            start = day + timedelta(minutes=10 * rng.randint(0, 400))
            bounds = [start, start + timedelta(minutes=rng.choice([-10, 0, 10, 60, 3000]))]
            texts = [b.isoformat() if rng.random() > 0.05 else "" for b in bounds]
            zone = rng.choice(["Europe/Berlin", "UTC", "", "Not/AZone"])
            own.append({"starts_at": texts[0], "ends_at": texts[1], "timezone": zone, "location_id": rng.choice(["b", f"p{i}"]), "story_anchor_id": "s1"})
        own.append({"starts_at": "soon", "ends_at": "2024-10-27T00:00:00", "timezone": "UTC", "location_id": "bad"})
        briefs.append(brief(project_id=project, time_anchors=own))
        rows += [(project, i, *(a.get(k) for k in ("starts_at", "ends_at", "timezone", "location_id", "story_anchor_id", "label"))) for i, a in enumerate(own)]
    shape = "project_id bigint, ordinal bigint, starts_at string, ends_at string, timezone string, location_id string, story_anchor_id string, label string"
    anchors, held = spark.createDataFrame(rows, shape), spark.createDataFrame(briefs, BRIEF)
    instants = [day + timedelta(minutes=10 * rng.randint(-5, 420)) for _ in range(150)] + [None, None, datetime(2020, 1, 1), datetime(2030, 1, 1)]
    clips = spark.createDataFrame([(p, i, t) for p in (1, 2, 3) for i, t in enumerate(instants)], "project_id bigint, n int, creation_utc timestamp_ntz")
    listed = lambda df: sorted(tuple(r) for r in df.drop("creation_utc").collect())
    want = listed(resolve_time_context(clips, time_contexts(held)))
    assert len(want) == 3 * len(instants) and len({r[3] for r in want}) > 5
    for size in (1, 7, 100_000):
        assert listed(resolve_by_anchor_rows(clips, held, anchors, slice_values=size)) == want


def probe(path, streams, fmt=None, length=1000):
    return {
        "project_id": 1, "path": path, "mtime": "2024-05-05 01:02:03", "length": length, "streams": streams,
        "format": fmt or {},
    }


def probes(spark, rows):
    shape = row(project_id=LONG, path=TEXT, mtime=TEXT, length=LONG)
    df = spark.createDataFrame(rows, type(shape)([*shape.fields, *PROBE_DOCUMENT.fields]))
    return df.withColumn("mtime_utc", F.col("mtime").cast("timestamp_ntz"))


def test_clip_fields(spark):
    video = {"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "", "r_frame_rate": "24000/1001"}
    rows = [
        probe("/v/20240301_101500.mp4", [{"codec_type": "audio"}, {**video, "duration": "2.5"}]),
        probe("/v/b.mp4", [{**video, "tags": {"rotate": "90"}}], {"duration": "0.0005", "size": "77"}),
        probe("/v/c.mp4", [{**video, "tags": {"rotate": "90"}, "side_data_list": [{}, {"rotation": 180}, {"rotation": 90}]}],
              {"duration": "10", "size": "5000000", "tags": {"creation_time": "2024-03-01T00:00:00Z"}}),
        probe("/v/d.mp4", [{"codec_type": "audio"}]),
        probe("/v/e.mp4", [{**video, "side_data_list": [{"rotation": -90}]}], {"duration": "10"}),
    ]
    df = probes(spark, rows)
    assert [r.path for r in rejected_probes(df).collect()] == ["/v/d.mp4"]
    got = {r.filename: r for r in build_clips(df, spark.createDataFrame([brief()], BRIEF), 4).collect()}
    a, b, c, e = (got[n] for n in ("20240301_101500.mp4", "b.mp4", "c.mp4", "e.mp4"))
    assert (a.duration_ms, a.has_audio, a.width, a.is_vertical, a.size_bytes) == (2500, True, 1920, False, 1000)
    assert round(a.fps, 3) == 23.976
    assert (a.timezone_name, a.start_local, a.start_utc) == ("Europe/Berlin", datetime(2024, 3, 1, 10, 15), datetime(2024, 3, 1, 9, 15))
    # No length counts as one millisecond.
    assert (b.width, b.height, b.is_vertical, b.size_bytes, b.bitrate_mbps) == (1080, 1920, True, 77, 0.616)
    assert (b.start_utc, b.start_local) == (datetime(2024, 5, 5, 1, 2, 3), datetime(2024, 5, 5, 3, 2, 3))
    assert str(b.date_key) == "2024-05-04"
    assert (c.width, c.bitrate_mbps, c.timezone_name, c.start_local) == (1920, 4.0, "Asia/Seoul", datetime(2024, 3, 1, 9))
    assert (e.width, e.has_audio) == (1080, False)


def test_streams_are_found_without_filters(spark):
    video = {"codec_type": "video", "width": 4, "height": 2}
    streams = [None, [], [None, {}], [{"codec_type": "audio"}], [None, {"width": 1}, video, {**video, "width": 9}], [video, {"codec_type": "audio"}]]
    df = probes(spark, [probe(f"/v/{i}.mp4", s) for i, s in enumerate(streams)])
    fields = probe_fields(df)
    assert {r.filename: (r.width, r.has_audio) for r in fields.collect()} == {"4.mp4": (4, False), "5.mp4": (4, True)}
    assert sorted(r.path for r in rejected_probes(df).collect()) == [f"/v/{i}.mp4" for i in range(4)]
    assert "filter(streams" not in fields._jdf.queryExecution().optimizedPlan().toString()


def test_short_ways_equal_the_long_ones(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "é", "\xa0a", "a\u3000", "~", "\x7f", "\x1fa!", "été", "90", " 90 ", "+90", "-90", "9x", "none", ".", "90.0", "٣", None]
    df = spark.createDataFrame([(t, ([], (t,))) for t in texts], "t string, video struct<side_data_list:array<struct<rotation:int>>,tags:struct<rotate:string>>")
    t = F.col("t")
    wrong = ~strip_field(t).eqNullSafe(strip(t)) | ~filled_field(t).eqNullSafe(filled(t))
    wrong |= media.rotation(F.col("video")) != F.coalesce(t.try_cast("int"), F.lit(0))
    assert df.filter(wrong).collect() == []
    paths = ["", "a", "/", "a/", "/a/b.mp4", "//", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.n for r in df.select(file_name(F.col("p")).alias("n")).collect()] == [p and p.split("/")[-1] for p in paths]


def test_probe_json_text(spark):
    text = '{"streams": [{"codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "25/1", "duration": "1"}], "format": {}}'
    df = spark.createDataFrame([(1, "/a.mp4", 5, text)], "project_id bigint, path string, length bigint, probe string")
    (r,) = probe_fields(df.withColumn("mtime_utc", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))).collect()
    assert (r.duration_ms, r.width, r.fps, r.size_bytes) == (1000, 4, 25.0, 5)


def test_dominant_fps(spark):
    t = datetime(2024, 1, 1)
    rows = [
        (1, 30.0, 1000, t, "b", "/b"), (1, 25.0, 2000, t, "c", "/c"), (1, 30.0, 1000, t + timedelta(1), "d", "/d"),
        (2, 29.9701, 10, t, "a", "/a"), (2, 29.9699, 10, t, "b", "/b"), (2, 50.0, 15, t, "0", "/0"),
    ]
    clips = spark.createDataFrame(rows, "project_id bigint, fps double, duration_ms bigint, start_utc timestamp_ntz, filename string, clip_path string")
    projects = spark.createDataFrame([(1,), (2,), (3,)], "project_id bigint")
    got = {r.project_id: r.fps for r in dominant_fps(clips, projects).collect()}
    assert got == {1: 30.0, 2: 29.97, 3: 29.97}


def test_days_and_spans(spark):
    rows = [(1, "2024-01-05"), (1, "2024-01-01"), (1, "2024-01-05"), (2, "2024-02-02")]
    clips = spark.createDataFrame(rows, "project_id bigint, date_key string").withColumn("start_local", F.to_timestamp_ntz("date_key"))
    got = sorted((r.project_id, r.date_key, r.travel_day, r.total_days) for r in travel_days(clips).collect())
    assert got == [(1, "2024-01-01", 1, 2), (1, "2024-01-05", 2, 2), (2, "2024-02-02", 1, 1)]
    assert {r.project_id: r.date_span for r in date_spans(clips).collect()} == {1: "2024.01.01 - 2024.01.05", 2: "2024.02.02"}


def test_brief_dimensions(spark):
    people = [{"name": "A", "aliases": ["x"]}, {"name": " "}, None, {"name": "B"}]
    rules = {"replacement_rules": [{"pattern": "a", "replacement": "b"}]}
    df = spark.createDataFrame([brief(people=people, transcription=rules)], BRIEF)
    assert [(r.ordinal, r.name) for r in brief_dimension(df, "people").orderBy("ordinal").collect()] == [(0, "A"), (3, "B")]
    assert brief_dimension(df, "time_anchors").count() == 4
    assert [(r.place_id, r.tz) for r in place_zones(df).collect()] == [("b", "Asia/Tokyo")]
    assert [(r.ordinal, r.pattern) for r in replacement_rules(df).collect()] == [(0, "a")]
