"""Corrections, taxonomies, stored results and presets."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cutlist.operators.corrections import Rules
from cutlist.operators.presets import preset_report, resolve_presets
from cutlist.operators.transcripts import (
    DEFAULT_TAXONOMY,
    correct_cues,
    curate_results,
    merge_taxonomy,
    rejected_rules,
    stored_or_default,
    taxonomies_with_default,
    taxonomy_signature,
    transcript_report,
    upsert_results,
    vocabulary_prompt,
    work_list,
)
from cutlist.schemas import BRIEF, CLIP_RESULT, TAXONOMY


def taxonomy(terms=(), rules=(), **extra):
    return {
        "project_id": 1, "terms": [{"canonical": c, "aliases": a} for c, a in terms],
        "replacement_rules": [{"pattern": p, "replacement": r} for p, r in rules], **extra,
    }


def loop(text, terms, rules):
    out = re.sub(r"\s+", " ", text).strip(" -")
    pairs = [(a.strip(), c) for c, aliases in terms for a in aliases if a.strip() and a.strip() != c]
    for alias, canonical in sorted(pairs, key=lambda p: -len(p[0])):
        out = out.replace(alias, canonical)
    for pattern, replacement in rules:
        if pattern.strip():
            out = re.sub(pattern.strip(), replacement.strip(), out)
    return out.replace("  ", " ").strip()


@pytest.mark.parametrize(
    "text",
    ["- ab  abc x\n", "price 5 $ and 7", "aab cab  bc", "   ", "어디가지? 우리집", "a-b -", "x    y"],
)
def test_corrections_equal_a_loop(spark, text):
    terms = [("ABC", ["abc", "ab "]), ("Z", ["bc", "Z", " "]), ("C", ["c"])]
    rules = [(r"(\d)\s*\$", r"$\1"), (" ", "_"), (r"우리집", "우리 집"), (r"a(A?)", r"\1\1"), (r"\?", "  ?  ")]
    cues = spark.createDataFrame([(1, text), (2, text)], "project_id bigint, text string")
    got = correct_cues(cues, spark.createDataFrame([taxonomy(terms, rules)], TAXONOMY)).orderBy("project_id").collect()
    assert got[0].text == loop(text, terms, rules)
    assert got[1].text == loop(text, [], []).replace("  ", " ") or got[1].text == re.sub(r"\s+", " ", text).strip(" -")


@pytest.mark.parametrize(
    "pattern, replacement",
    [
        (r"(?P<word>\w+)-(?P=word)", r"<\g<word>>"),
        (r"(\w)(\w)", r"<\2\1>"),
        (r"(\d+)", r"\g<1>0$"),
        (r"\s", r"\t"),
        (r"é.", r"\n"),
        (r"$", r"$1"),
    ],
)
def test_rule_dialect(spark, pattern, replacement):
    text = "ab-ab 12 é\u2028x 가나"
    cues = spark.createDataFrame([(1, text)], "project_id bigint, text string")
    got = correct_cues(cues, spark.createDataFrame([taxonomy(rules=[(pattern, replacement)])], TAXONOMY)).first().text
    assert got == loop(text, [], [(pattern, replacement)])


def test_automaton_passes_over_texts_without_aliases(spark):
    terms = [(f"Name{i}", [f"alias{i}", f"al {i}"]) for i in range(40)] + [("Name1 of", ["Name1"]), ("é", ["日本"])]
    rules = Rules(json.dumps({"aliases": [{"alias": a, "canonical": c} for c, x in terms for a in x]}))
    assert not rules.found("no such thing: alia, ali 4") and rules.found("x alias7") and rules.found("日本")
    texts = ["alias1 al 3", "none", "Name1", "日本 alias39alias3", None, ""]
    cues = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "project_id bigint, n int, text string")
    got = correct_cues(cues, spark.createDataFrame([taxonomy(terms)], TAXONOMY)).orderBy("n").collect()
    assert [r.text for r in got] == [None if t is None else loop(t, terms, []) for t in texts]


def test_bad_rules_cost_only_themselves(spark):
    """A broken rule of one project is told and left out; its other rules and all other projects go on."""
    bad = [("(", "x"), ("[a", "x"), ("a", r"\1"), ("a", r"\g<n>"), ("*", "x")]
    good = [(r"(?P<n>b)", r"<\g<n>>"), (r"\(c\)", r"\\d"), (r"(e)", r"\1\1")]
    own = [{**taxonomy(rules=[*bad, *good]), "project_id": 1}, {**taxonomy(rules=good), "project_id": 2}]
    frame = spark.createDataFrame(own, TAXONOMY)
    assert sorted(r.pattern for r in rejected_rules(frame).collect()) == sorted(p for p, _ in bad)
    cues = spark.createDataFrame([(1, "a b (c) e"), (2, "a b (c) e")], "project_id bigint, text string")
    assert {r.text for r in correct_cues(cues, frame).collect()} == {loop("a b (c) e", [], good)}


def results(spark, *rows):
    return spark.createDataFrame([{"project_id": 1, **r} for r in rows], CLIP_RESULT)


def cue(text):
    return [{"start": "0", "end": "1", "text": text}]


def test_curation_and_report(spark):
    stored = results(
        spark,
        {"clip_path": "/1.mp4", "provider": "cache", "transcript": cue(" hello\n")},
        {"clip_path": "/2.mp4", "provider": "cache", "transcript": []},
        {"clip_path": "/3.mp4", "provider": "asr", "transcript": cue(" - ")},
        {"clip_path": "/4.mp4", "provider": None, "transcript": None},
    )
    done = curate_results(stored, spark.createDataFrame([taxonomy([("HELLO", ["hello"])])], TAXONOMY))
    got = {r.clip_path: r for r in done.collect()}
    assert got["/1.mp4"].transcript[0].text == "HELLO"
    assert [got[f"/{i}.mp4"].transcript_status for i in (1, 2, 3, 4)] == ["ok", "empty", "empty", "empty"]
    report = transcript_report(done).first()
    assert (report.provider, report.clip_count, report.transcribed_clip_count, report.empty_transcript_count) == ("asr, cache", 4, 1, 3)
    assert transcript_report(results(spark, {"clip_path": "/4.mp4"})).first().provider == "cohere-local"


def test_an_empty_transcript_is_no_work(spark):
    shape = "project_id bigint, clip_path string, provider string, transcription_model string, speech_locale string, taxonomy_signature string"
    clips = spark.createDataFrame([(1, f"/{i}.mp4", "asr", "base", None, "sig") for i in range(7)], shape)
    made = {"provider": "asr", "transcription_model": "base", "taxonomy_signature": "sig", "transcript": []}
    stored = results(
        spark,
        {**made, "clip_path": "/0.mp4"},
        {**made, "clip_path": "/1.mp4", "taxonomy_signature": "old", "transcript": cue("a")},
        {**made, "clip_path": "/2.mp4", "transcript": None},
        {**made, "clip_path": "/4.mp4", "transcription_model": "large"},
        {**made, "clip_path": "/5.mp4", "speech_locale": "fr"},
        {**made, "clip_path": "/6.mp4", "provider": "other"},
    )
    assert sorted(r.clip_path for r in work_list(clips, stored).collect()) == [f"/{i}.mp4" for i in range(1, 7)]
    got = {r.clip_path: (r.filename, r.taxonomy_signature) for r in stored_or_default(clips, stored).collect()}
    assert got["/0.mp4"] == ("0.mp4", "sig") and got["/3.mp4"] == ("3.mp4", None)


def test_upsert(spark):
    stored = results(
        spark,
        {"clip_path": "/a.mp4", "filename": "a.mp4", "provider": "x", "speech_locale": "ko", "updated_at": "then"},
        {"clip_path": "/b.mp4", "filename": "b.mp4", "provider": "x", "updated_at": "then"},
    )
    patch = spark.createDataFrame(
        [(1, "/a.mp4", 1, "y", "en"), (1, "/a.mp4", 2, "z", None), (1, "/c.mp4", 1, "w", "fr")],
        "project_id bigint, clip_path string, patch_no int, provider string, speech_locale string",
    )
    got = {r.clip_path: (r.filename, r.provider, r.speech_locale, r.updated_at) for r in upsert_results(stored, patch, "now").collect()}
    assert got == {
        "/a.mp4": ("a.mp4", "z", None, "now"), "/b.mp4": ("b.mp4", "x", None, "then"), "/c.mp4": ("c.mp4", "w", "fr", "now"),
    }


def test_taxonomy_defaults_and_merge(spark):
    briefs = spark.createDataFrame(
        [
            {
                "project_id": p, "people": [{"name": "공항", "aliases": ["k"]}, {"name": "Mia", "aliases": [" mi ", ""]}],
                "places": [{"name": "Home", "aliases": ["Mia"]}], "story_anchors": [{"label": "L", "keywords": ["kw"]}],
                "transcription": {"prompt_terms": ["own", "kw"], "replacement_rules": [{"pattern": "p", "replacement": "r"}]},
            }
            for p in (1, 2)
        ],
        BRIEF,
    )
    own = spark.createDataFrame([taxonomy([("Mia", [])], [("q", "s")], prompt_terms=["own", " "], context="ctx")], TAXONOMY)
    full = taxonomies_with_default(briefs, own)
    merged = {r.project_id: r for r in merge_taxonomy(full, briefs).collect()}
    assert merged[1].prompt_terms == ["own", "공항", "k", "Mia", "mi", "Home", "L", "kw"]
    assert [t.canonical for t in merged[1].terms] == ["Mia", "공항"]
    assert [r.pattern for r in merged[1].replacement_rules] == ["q", "p"]
    assert merged[2].context == DEFAULT_TAXONOMY["context"]
    assert [t.canonical for t in merged[2].terms][-1] == "Mia" and len(merged[2].terms) == 13
    assert len(merged[2].replacement_rules) == 6
    prompts = {r.project_id: r.prompt for r in vocabulary_prompt(merge_taxonomy(full, briefs)).collect()}
    assert prompts[1] == "ctx Names and terms: own, 공항, k, Mia, mi, Home, L, kw."
    signatures = {r[0] for r in full.select(taxonomy_signature(full)).collect()}
    assert len(signatures) == 2 and all(re.fullmatch("[0-9a-f]{12}", s) for s in signatures)


def test_presets(spark):
    wanted = spark.createDataFrame(
        [(1, 0, " warm "), (1, 1, "resort"), (1, 2, "warm_family_vlog"), (1, 3, "sepia"), (2, 0, "refined_travel")],
        "project_id bigint, ordinal int, name string",
    )
    known, unknown = resolve_presets(wanted)
    assert sorted((r.project_id, r.ordinal, r.preset_id) for r in known.collect()) == [
        (1, 0, "warm_family_vlog"), (1, 1, "bright_resort"), (2, 0, "refined_travel"),
    ]
    assert [(r.project_id, r.name) for r in unknown.collect()] == [(1, "sepia")]
    briefs = spark.createDataFrame([{"project_id": 1, "render": {"preview_presets": ["resort", "refined"]}}, {"project_id": 2}], BRIEF)
    marked, unknown = preset_report(briefs)
    assert sorted((r.project_id, r.preset_id, r.is_selected) for r in marked.collect()) == [
        (1, "bright_resort", True), (1, "refined_travel", False), (2, "warm_family_vlog", True),
    ]
    assert unknown.count() == 0
