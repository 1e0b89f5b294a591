"""Prompt features and brief texts, with expectations worked out by hand or by Python's own regular expressions."""

import random
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from cutlist.functions import prompts as P
from cutlist.functions.briefs import brief_settings, editorial_text, must_include_terms, prompt_terms
from cutlist.functions.text import clock, language_code, padded, result_key, segment_digest, slug, title_parts
from cutlist.plans.jobs import prompt_features, prompted_briefs, target_lengths
from cutlist.schemas import BRIEF


def column(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.withColumn("x", expression(F.col("t"))).orderBy("i").collect()]


def test_runtime(spark):
    cases = {
        "about 30~50분 please": ("30~50분", 2400),
        "1 - 0 min": ("1 - 0 min", 60),
        "2시간 5분": ("2시간 5분", 7500),
        "2 Hours": ("2 Hours", 7200),
        "45 MINUTES or 2 hours": ("45 MINUTES", 7200),
        "7 min": ("7 min", 420),
        "soon": ("", 2400),
    }
    assert column(spark, cases, P.runtime_phrase) == [c[0] for c in cases.values()]
    assert column(spark, cases, P.runtime_seconds) == [c[1] for c in cases.values()]


def test_tone_pacing_season(spark):
    texts = ["A Warm, cinematic film", "포근한 여행, 천천히", "playful and FAST-PACED", "겨울 연말", "plain"]
    assert column(spark, texts, P.tone) == ["cinematic", "warm", "playful", None, None]
    assert column(spark, texts, P.pacing) == [None, P.SLOW_PACING, P.BRISK_PACING, None, None]
    assert column(spark, texts, P.season) == ["", "", "", "연말", ""]
    assert column(spark, texts, lambda t: P.tone(t, F.lit(" kept ")))[0] == "kept"


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-03-05 to 2024/3/9, 2024.13.01", "2024.03.05 - 2024.03.09"),
        ("2024년 5월 3일", "2024.05.03"),
        ("1월 3일", "2024.01.03"),  # in range for the second year only
        ("12월 30일 - 1월 2일", "2023.12.30 - 2024.01.02"),
        ("6월 1일", "2023.06.01"),  # out of range for both: the earlier year
        ("2월 30일", ""),
        ("0000-01-01", ""),
        ("none", ""),
    ],
)
def test_dates(spark, text, want):
    span = lambda t: P.prompt_date_span(P.prompt_dates(t, F.lit(date(2023, 12, 20)), F.lit(date(2024, 1, 10))))
    assert column(spark, [text], span) == [want]


def test_month_and_day_need_clip_dates(spark):
    none = F.lit(None).cast("date")
    assert column(spark, ["3월 3일", "2024-01-02"], lambda t: P.prompt_date_span(P.prompt_dates(t, none, none))) == ["", "2024.01.02"]


def test_titles(spark):
    cases = {
        "Title: My trip. please edit it": "My trip",
        "title: \nTrip two": "Trip two",  # blanks before the title may hold a line break
        "제목: 여름 기록 편집해줘": "여름 기록",
        "제주도에서 가족 여행": "제주도 그룹 여행",
        "겨울 부산 여행": "겨울 부산 여행",
        "A quiet walk": "A quiet walk",
        "x": "About",
        "\n\n  Second line  \nthird": "Second line",
    }
    title = lambda t: P.video_title(t, F.lit(""), F.lit("About"))
    got = dict(zip(cases, column(spark, cases, title)))
    assert got == cases
    assert column(spark, [""], lambda t: P.video_title(t, F.lit(""), F.lit(" "))) == [P.DEFAULT_TITLE]
    assert column(spark, [""], lambda t: P.video_title(t, F.lit("From the summary"), F.lit(""))) == ["From the summary"]


def search(text):
    """First groups of all matches, by Python's regular expressions over the whole text."""
    return [m for p in P.PLACE_PATTERNS for m in re.findall(p, text, flags=re.IGNORECASE)]


@pytest.mark.parametrize(
    "text",
    [
        "제주도에서 출발, 서울로 이동 가족 여행 부산 여행기",
        "trip to Sunny Bay, in Rome. 파리 브이로그",
        "Berlin으로 Old Town로 가는 여행",
        "a" * 200 + "로 b여행 / c 로",
        "한국 공항에서 현지  숙소로, 강릉 바다 여행\n속초\n여행",
    ],
)
def test_place_matches_equal_a_whole_text_search(spark, text):
    found = lambda t: F.concat(*[P._matches(t, p, after) for p, after in zip(P.PLACE_PATTERNS, P.PLACE_AFTER)])
    assert column(spark, [text], found) == [search(text)]


def test_far_words_are_not_searched_and_change_no_match(spark):
    """Runs longer than a match can reach, with place words far apart, next to each other and after wide gaps."""
    words = "서울 and b a1 가족 Sunny Bay 여행 부산에서 가족여행 제주로 x. 한옥마을 it's".split()
    rng = random.Random(3)
    gap = lambda: rng.choice([" ", "  ", "\n", "\u3000", "", "-", " " * 40])
    texts = ["".join(rng.choice(words[:6] if i % 3 else words) + gap() for i in range(rng.randint(1, 160))) for _ in range(60)]
    texts += ["w " * 300 + "to Sunny Bay 여행 " + "w " * 20 + "여행", "여행" + " a" * 17 + " 여행", "가" * 90 + "로 " * 40]
    for pattern, after in zip(P.PLACE_PATTERNS, P.PLACE_AFTER):
        whole = column(spark, texts, lambda t: F.regexp_extract_all(t, F.lit("(?iU)" + pattern), F.lit(1)))  # noqa: B023
        assert column(spark, texts, lambda t: P._matches(t, pattern, after)) == whole  # noqa: B023


def test_whole_texts_are_lowered_once(spark):
    text = spark.createDataFrame([("x",)], "t string")
    plan = lambda c: text.select(c.alias("x"))._jdf.queryExecution().analyzed().toString().count("lower(")
    assert [plan(f(F.col("t"))) for f in (P.tone, P.pacing, P.season)] == [1, 1, 0]


def test_places(spark):
    texts = ["여유로운 여행, 가족 여행, 제주도 여행, 제주도 여행", "부산출발로", "부산 출발로, 한국 공항에서", "to a place with a very long name that goes on"]
    assert column(spark, texts, P.places) == [["여유", "제주도"], ["부산"], [], ["a place with a very long"]]


def test_formats(spark):
    got = spark.createDataFrame([(500,), (1500,), (2500,), (3599500,), (3600000,), (-5,), (360000000,)], "ms bigint")
    assert [r.c for r in got.select(clock(F.col("ms")).alias("c")).collect()] == [
        "00:00", "00:02", "00:02", "01:00:00", "01:00:00", "00:00", "100:00:00",
    ]
    assert column(spark, ["ko-KR", "EN", "", " -x"], language_code) == ["ko", "en", "en", "en"]
    assert column(spark, ["Day 1 · A_b", "···", "여행 끝"], lambda t: slug(t, "none")) == ["day-1---a-b", "none", "여행-끝"]
    assert [tuple(x) for x in column(spark, ["A · b · c", " plain "], title_parts)] == [("A", "b · c"), ("plain", "")]
    assert column(spark, ["7", "1234"], lambda t: padded(t.cast("int"), 3)) == ["007", "1234"]
    assert column(spark, ["/a/b.c.mp4", "/a/.hidden"], lambda t: F.substring_index(result_key(t), "-", 1)) == ["b.c", ".hidden"]
    import hashlib

    want = hashlib.sha1(b"/a.mp4:0.650:12.005").hexdigest()[:12]
    assert column(spark, ["/a.mp4"], lambda t: segment_digest(t, F.lit(650), F.lit(12005))) == [want]


def briefs(spark, **editorial):
    return spark.createDataFrame([{"project_id": 1, "editorial_brief": editorial, "render": {"final_feedback": [" a ", ""]}}], BRIEF)


def test_brief_texts(spark):
    df = briefs(spark, summary=" s ", tone="", closer_guidance="c", must_include=[" Wow ", "", None], story_goals=["g", "h"])
    r = df.select(
        editorial_text(F.col("editorial_brief")).alias("text"),
        must_include_terms(F.col("editorial_brief.must_include")).alias("terms"),
        prompt_terms(df).alias("prompt_terms"),
    ).first()
    assert r.text == "summary: s\ncloser_guidance: c\nmust_include: Wow\nstory_goals: g; h"
    assert r.terms == ["wow"] and r.prompt_terms == []
    s = brief_settings(df).first()
    assert (s.default_timezone, s.preview_presets, s.selected_preset, s.final_render_mode, s.final_feedback) == (
        None, ["warm_family_vlog"], "warm_family_vlog", "chunked_direct_mp4", ["a"],
    )


def test_target_lengths(spark):
    assert target_lengths(briefs(spark, target_runtime="10분", summary="20 min")).first().target_s == 600
    assert target_lengths(briefs(spark, summary="about 20 min")).first().target_s == 1200
    assert target_lengths(briefs(spark)).first().target_s == 2400


def test_prompted_briefs(spark):
    prompt = spark.createDataFrame([(1, " warm, 20 min, linger ")], "project_id bigint, prompt string")
    r = prompted_briefs(briefs(spark, summary="S", target_runtime=" "), prompt).first().editorial_brief
    assert (r.summary, r.tone, r.target_runtime, r.pacing_guidance) == (
        "S\n\nUser prompt:\nwarm, 20 min, linger", "warm", "20 min", P.SLOW_PACING,
    )
    none = prompted_briefs(briefs(spark, summary="S"), prompt.filter("false")).first().editorial_brief
    assert (none.summary, none.tone) == ("S", None)


def test_prompt_features(spark):
    prompts = spark.createDataFrame([(1, "Title: T\n30-50 min on 2024-01-02", "kept")], "project_id bigint, prompt string, tone string")
    r = prompt_features(prompts).first()
    assert (r.tone, r.target_runtime, r.target_s, r.date_span, r.title) == ("kept", "30-50 min", 2400, "2024.01.02", "T")
