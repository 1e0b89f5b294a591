"""Readers and sinks over temporary folders, and the whole plan from files."""

import json

import pytest
from pyspark.sql import functions as F

from cutlist.functions.briefs import editorial_text
from cutlist.operators.transcripts import transcript_report
from cutlist.plans.jobs import plan
from cutlist.operators.validate import structure_rejects
from cutlist.sources import documents, readers, sink, writers


def dump(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")


def lines(path):
    """Data lines of a written folder per partition folder, in file order."""
    out = {}
    for part in sorted(path.rglob("part-*")):
        out.setdefault(part.parent.name, []).extend(part.read_text(encoding="utf-8").splitlines())
    return out


def test_media_listing(spark, tmp_path):
    for name in ("a.mp4", "b.MOV", "c.m4v", "d.Mp4", "e.txt", "sub/f.mp4"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"xyz")
    files = readers.list_media(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in files.collect()) == ["a.mp4", "b.MOV", "c.m4v"]
    assert {r.length for r in files.collect()} == {3}
    plan_text = files._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan_text.split("ReadSchema")[-1]


def test_clip_results(spark, tmp_path):
    dump(tmp_path, "1.json", {"project_id": 1, "clip_path": "/a", "transcript": [{"start": 0, "end": 1.5, "text": "x"}]})
    dump(tmp_path, "2.json", "[1, 2]")
    dump(tmp_path, "3.json", "{broken")
    dump(tmp_path, "4.json", {"project_id": 1, "clip_path": "/b", "transcript": [], "unknown": True})
    got = {r.clip_path: r.transcript for r in readers.read_clip_results(spark, str(tmp_path)).collect()}
    assert set(got) == {"/a", "/b"} and (got["/a"][0].start, got["/a"][0].end) == ("0", "1.5")


def test_rejects_are_the_rest(spark, tmp_path):
    from cutlist.schemas import CLIP_RESULT

    given = {
        "1": {"project_id": 1, "clip_path": "/a"}, "2": "[1, 2]", "3": "{broken", "4": {"unknown": True}, "5": {"project_id": "one"},
        "6": "7", "7": {"project_id": 2, "path": "/b", "streams": []}, "8": {},
    }
    for name, value in given.items():
        dump(tmp_path, f"{name}.json", value)
    for schema, read in ((CLIP_RESULT, readers.read_clip_results), (readers.PROBE_RECORD, lambda s, p: readers.read_probes(s, p, True))):
        bad = {r.path.rsplit("/", 1)[1][0]: r.reason for r in readers.rejected_documents(spark, str(tmp_path), schema).collect()}
        assert read(spark, str(tmp_path)).count() + len(bad) == len(given)
        assert [bad[n] for n in "23456"] == ["no object", "no object", "no known field", "a field does not fit", "no object"]
    bad = {r.path.rsplit("/", 1)[1][0] for r in readers.rejected_taxonomies(spark, str(tmp_path)).collect()}
    assert bad == {"2", "3", "6", "8"} and readers.read_taxonomies(spark, str(tmp_path)).count() == len(given) - 4


def test_briefs(spark, tmp_path):
    dump(tmp_path, "1.json", {"project_id": 1, "version": 3, "people": [{"name": "A"}, None]})
    dump(tmp_path, "2.json", {"project_id": 2, "version": 2})
    dump(tmp_path, "3.json", {"project_id": 3})
    dump(tmp_path, "4.json", {"project_id": 4, "version": 3, "people": "nobody"})
    dump(tmp_path, "5.json", {"project_id": 5, "version": "3", "editorial_brief": " All about food ", "time_anchors": [5, {"label": "x"}]})
    dump(tmp_path, "6.json", "{}")
    dump(tmp_path, "7.json", "[1, 2]")
    dump(tmp_path, "8.json", "{broken")
    dump(tmp_path, "9.json", {"version": 3})
    dump(tmp_path, "10.json", {
        "project_id": 10, "version": 3, "people": ["Ana", {"name": "Theo", "aliases": ["T", 7]}, 4],
        "transcription": {"replacement_rules": ["x", {"pattern": "a", "replacement": "b"}]}, "unknown": [1],
    })
    good, bad = readers.read_briefs(spark, str(tmp_path))
    rows = {r.project_id: r for r in good.collect()}
    assert sorted(rows) == [1, 4, 5, 10]
    assert [p.name for p in rows[1].people] == ["A"] and rows[4].people is None
    assert [(p.name, p.aliases) for p in rows[10].people] == [("Theo", ["T", "7"])]
    assert [r.pattern for r in rows[10].transcription.replacement_rules] == ["a"]
    assert [a.label for a in rows[5].time_anchors] == ["x"]
    texts = {r.project_id: r.text for r in good.select("project_id", editorial_text(F.col("editorial_brief")).alias("text")).collect()}
    assert texts[5] == "All about food"
    reasons = sorted((r.path.rsplit("/", 1)[1], r.project_id, r.reason) for r in bad.collect())
    assert reasons == [
        ("2.json", 2, "version 2"), ("3.json", 3, "version "), ("6.json", None, "version "), ("7.json", None, "not a brief"),
        ("8.json", None, "not a brief"), ("9.json", None, "no project_id"),
    ]


def test_selection_documents_with_wrong_structure(spark, tmp_path):
    item = {"candidate_id": " c1 ", "clip_path": "/a", "start": 1.5, "end": "3", "sequence_index": "1.5", "role": "moment", "reason": 7}
    dump(tmp_path, "1.json", {"project_id": 1, "project_title": "T", "days": [5, {"travel_day": 1, "selections": [None, "x", item]}]})
    dump(tmp_path, "2.json", {"project_id": 2, "days": {"travel_day": 1}})
    dump(tmp_path, "3.json", {"project_id": 3, "days": [{"travel_day": 1}, {"travel_day": 4, "selections": "none"}]})
    dump(tmp_path, "4.json", "[1, 2]")
    dump(tmp_path, "5.json", "{broken")
    dump(tmp_path, "6.json", {"project_id": 6})
    dump(tmp_path, "7.json", {"project_id": 7, "days": None})
    headers, rows, rejects = documents.read_selection_documents(spark, str(tmp_path))
    assert sorted((r.project_id, r.n_days) for r in headers.collect()) == [(1, 1), (6, 0)]
    (got,) = rows.collect()
    assert (got.candidate_id, got.travel_day, got.start_ms, got.end_ms, got.sequence_index) == ("c1", 1, 1500, 3000, "1.5")
    assert (got.enabled, got.reason, got.day_no, got.item_no) == (None, "7", 0, 0)
    told = [(r.path.rsplit("/", 1)[1], r.travel_day, r.reason) for r in rejects.collect()]
    assert sorted(told) == [
        ("2.json", 0, "days is no array"), ("3.json", 4, "selections is no array"), ("4.json", 0, "no object"),
        ("5.json", 0, "no object"), ("7.json", 0, "days is no array"),
    ]
    assert {(r.project_id, r.rule) for r in structure_rejects(rejects).collect()} == {(2, "V10"), (3, "V10"), (7, "V10"), (None, "V10")}


def test_candidate_documents(spark, tmp_path):
    entries = [{"candidate_id": "a", "start": 1, "end": 2.5}, {"candidate_id": ""}, 7, {"candidate_id": "b"}, {"candidate_id": "a", "start": "x"}]
    (tmp_path / "all.jsonl").write_text(
        "\n".join(json.dumps(d) for d in ({"project_id": 1, "candidates": entries, "candidate_count": 9}, {"project_id": 2, "candidates": {}}, [3]))
    )
    headers, rows, rejects = documents.read_candidate_documents(spark, str(tmp_path), multiline=False)
    assert [(r.project_id, r.candidate_count) for r in headers.collect()] == [(1, 9)]
    # The last entry of an id counts; a missing start is 0 and a missing end the start.
    assert sorted((r.candidate_id, r.ordinal, r.start_ms, r.end_ms) for r in rows.collect()) == [("a", 3, 0, 0), ("b", 2, 0, 0)]
    assert sorted(r.reason for r in rejects.collect()) == ["candidates is no array", "no object"]


def whole(folder):
    """Each project's document: its files one after the other."""
    return {
        int(f.name.split("=")[1]): json.loads("".join(p.read_text(encoding="utf-8") for p in sorted(f.glob("*.json"))))
        for f in folder.glob("project_id=*")
    }


SELECTED = (
    "project_id bigint, travel_day bigint, date_key string, day_label string, candidate_id string, clip_path string, start_ms bigint, "
    "end_ms bigint, sequence_index bigint, enabled boolean, role string, reason string"
)


def selected(spark, projects=3, days=4, each=9):
    rows = [
        (p, d, f"2024-03-0{d}", f"Day {d}", f"c{p}_{d}_{i}", "/a.mp4", 1500 * i, 1500 * i + 250, i, True, "moment", 'é "quoted"\n')
        for p in range(projects) for d in range(1, days + 1) for i in range(1, each + 1)
    ]
    return spark.createDataFrame(rows, SELECTED).repartition(5), rows


@pytest.mark.parametrize("slices", [1, 40])
def test_selection_documents_are_written_in_order(spark, tmp_path, slices):
    frame, rows = selected(spark)
    titles = spark.createDataFrame([(0, "Trip \"x\""), (1, "")], "project_id bigint, title string")
    writers.write_selection_documents(frame, titles, str(tmp_path), slices=slices)
    got = whole(tmp_path)
    assert set(got) == {0, 1, 2} and not list(tmp_path.glob("_run-*"))
    for p, document in got.items():
        assert list(document) == ["project_title", "selection_mode", "days"]
        assert (document["project_title"], document["selection_mode"]) == ({0: 'Trip "x"'}.get(p, ""), "auto")
        assert [(d["travel_day"], d["label"], d["date_key"]) for d in document["days"]] == [(d, f"Day {d}", f"2024-03-0{d}") for d in range(1, 5)]
        listed = [(s["candidate_id"], s["start"], s["end"], s["reason"]) for d in document["days"] for s in d["selections"]]
        assert listed == [(r[4], r[6] / 1000, r[7] / 1000, r[11]) for r in rows if r[0] == p]
    if slices > 1:
        assert max(len(list(f.glob("*.json"))) for f in tmp_path.glob("project_id=*")) > 3
    # Another run replaces the documents of its own projects only, and the documents read back are the selections.
    writers.write_selection_documents(frame.filter("project_id = 2 and travel_day < 3"), titles, str(tmp_path), "edited", slices)
    again = whole(tmp_path)
    assert again[0] == got[0] and (again[2]["selection_mode"], len(again[2]["days"])) == ("edited", 2)
    texts = spark.createDataFrame([(str(p), json.dumps({"project_id": p, **d})) for p, d in got.items()], "path string, value string")
    _, back, _ = documents.selection_documents(texts)
    assert {(r.project_id, r.candidate_id, r.start_ms, r.end_ms) for r in back.collect()} == {(r[0], r[4], r[6], r[7]) for r in rows}


@pytest.mark.parametrize("slices", [1, 30])
def test_transcript_documents_and_summary(spark, tmp_path, slices):
    from cutlist.schemas import CLIP_RESULT

    results = spark.createDataFrame(
        [
            {"project_id": p, "clip_path": f"/{p}/{i}.mp4", "filename": f"{i:02d}.mp4", "provider": f"asr-{i % 2}",
             "transcript": None if i == 3 else [{"start": "0", "end": "1.5", "text": f"word {i}"}] * (i % 3)}
            for p in (1, 2) for i in range(12)
        ],
        CLIP_RESULT,
    )
    settings = spark.createDataFrame(
        [(p, f"trip {p}", "ko", "base", "sig") for p in (1, 2, 9)],
        "project_id bigint, project string, speech_locale string, model string, taxonomy_signature string",
    )
    writers.write_transcript_documents(results, settings, str(tmp_path), slices)
    got = whole(tmp_path)
    assert list(got[1]) == ["project", "speech_locale", "provider", "model", "clips"] and got[9]["clips"] == []
    assert (got[2]["project"], got[2]["provider"], got[9]["provider"]) == ("trip 2", "asr-0, asr-1", "cohere-local")
    assert [c["filename"] for c in got[1]["clips"]] == [f"{i:02d}.mp4" for i in range(12)]
    assert [len(c["transcript"]) for c in got[1]["clips"]] == [0 if i == 3 else i % 3 for i in range(12)]
    heads = sink.read_headers(spark, str(tmp_path), "project string, provider string, model string, speech_locale string", "clips")
    assert sorted((r.project_id, r.project, r.model) for r in heads.collect()) == [(p, f"trip {p}", "base") for p in (1, 2, 9)]
    (row,) = writers.transcript_summary(results.filter("project_id = 1"), settings).collect()
    assert (row.model, row.speech_locale, row.taxonomy_signature, row.clip_count, row.empty_transcript_count) == ("base", "ko", "sig", 12, 4)


def test_a_failing_write_leaves_no_document(spark, tmp_path):
    frame, _ = selected(spark)
    titles = spark.createDataFrame([], "project_id bigint, title string")
    bad = frame.withColumn("reason", F.when(F.col("candidate_id") == "c1_2_5", F.raise_error(F.lit("lost"))).otherwise(F.col("reason")))
    with pytest.raises(Exception, match="lost"):
        writers.write_selection_documents(bad, titles, str(tmp_path), slices=6)
    assert not whole(tmp_path)


def write_inputs(folder):
    probes, results = [], []
    for project in (1, 2):
        for i in range(6):
            path = f"/raw/p{project}_{i}.mp4"
            probes.append(
                {
                    "project_id": project, "path": path, "mtime": "2024-05-01 00:00:00", "length": 9,
                    "streams": [{"codec_type": "video", "width": 16, "height": 9, "avg_frame_rate": "25/1"}, {"codec_type": "audio"}],
                    "format": {"duration": "40.0", "size": "100", "tags": {"creation_time": f"2024-05-0{1 + i // 2}T10:0{i}:00Z"}},
                }
            )
            cues = [{"start": 10 * k, "end": 10 * k + 3, "text": f"fun  food {i} {k}"} for k in range(3)] if i else []
            results.append({"project_id": project, "clip_path": path, "provider": "asr", "transcript": cues})
        dump(folder / "briefs", f"{project}.json", {
            "project_id": project, "version": 3, "project": {"default_timezone": "Asia/Seoul"},
            "editorial_brief": {"must_include": ["food 1"]},
            "time_anchors": [{"ends_at": "2024-05-01T23:00:00", "story_anchor_id": "airport", "label": "Out"}],
            "transcription": {"replacement_rules": [{"pattern": "fun\\s", "replacement": "fun"}]},
        })
    dump(folder / "probes", "all.json", "\n".join(json.dumps(p) for p in probes))
    dump(folder / "results", "all.json", "\n".join(json.dumps(r) for r in results))


def test_plan_from_files(spark, tmp_path):
    write_inputs(tmp_path)
    briefs, rejected = readers.read_briefs(spark, str(tmp_path / "briefs"))
    assert rejected.count() == 0
    prompts = spark.createDataFrame([(1, "Title: One\n10 min"), (2, "warm, 2 hours in Busan")], "project_id bigint, prompt string")
    taxonomies = readers.read_taxonomies(spark, str(tmp_path / "briefs")).filter("false")
    out = plan(
        readers.read_probes(spark, str(tmp_path / "probes")),
        readers.read_clip_results(spark, str(tmp_path / "results"), multiline=False),
        briefs,
        prompts,
        taxonomies,
    )
    assert out["clips"].count() == 12
    assert {r.fps for r in out["fps"].collect()} == {25.0}
    report = out["transcript_report"].orderBy("project_id").collect()
    assert [(r.clip_count, r.transcribed_clip_count, r.empty_transcript_count) for r in report] == [(6, 5, 1)] * 2
    candidates = out["candidates"].orderBy("project_id", "ordinal").collect()
    assert len(candidates) == 30 and [c.ordinal for c in candidates[:15]] == list(range(1, 16))
    assert candidates[0].excerpt == "funfood 1 0" and candidates[0].total_days == 3
    assert candidates[0].story_anchor_label == "Out"
    assert out["violations"].count() == 0
    titles = {r.project_id: (r.title, r.date_span) for r in out["titles"].collect()}
    assert titles == {1: ("One", ""), 2: ("Busan 여행", "")}
    items = out["timeline"].collect()
    total = {r.project_id: r.target_ms for r in out["timeline_summary"].collect()}
    assert total[1] == sum(i.duration_ms for i in items if i.project_id == 1)
    assert out["chunks"].filter("project_id = 2").count() == 5
    assert out["edit_list"].count() == len(items)

    base = tmp_path / "out"
    writers.write_clip_manifest(out["clips"], briefs.select("project_id", F.lit("UTC").alias("timezone")), str(base / "manifest"))
    names = [json.loads(x)["filename"] for x in lines(base / "manifest" / "clips")["project_id=1"]]
    assert names == [f"p1_{i}.mp4" for i in range(6)]
    assert json.loads(lines(base / "manifest" / "header")["project_id=2"][0])["clip_count"] == 6

    stored = readers.read_clip_results(spark, str(tmp_path / "results"), multiline=False)
    writers.write_transcripts(stored, transcript_report(stored), str(base / "transcripts"))
    assert len(lines(base / "transcripts" / "clips")["project_id=1"]) == 6

    writers.write_candidates(out["candidates"], briefs.select("project_id"), str(base / "candidates"))
    back = readers.read_table(spark, str(base / "candidates" / "candidates"), F.col("project_id") == 1)
    assert back.count() == 15
    assert {r.candidate_count for r in readers.read_table(spark, str(base / "candidates" / "header")).collect()} == {15}

    writers.write_cue_analysis(out["candidates"], str(base / "analysis"))
    scores = [json.loads(x) for x in lines(base / "analysis" / "cues")["project_id=1"]]
    by_day = {}
    for s in scores:
        by_day.setdefault(s["travel_day"], []).append(s["overall"])
    assert list(by_day) == [1, 2, 3] and all(v == sorted(v, reverse=True) for v in by_day.values())
    days = [json.loads(x) for x in lines(base / "analysis" / "days")["project_id=1"]]
    assert [(d["travel_day"], d["cue_count"]) for d in days] == [(1, 3), (2, 6), (3, 6)]

    writers.write_selection(out["selections"], str(base / "selection"))
    writers.write_timeline(out["timeline"], str(base / "timeline"))
    assert readers.read_table(spark, str(base / "timeline")).count() == len(items)
    writers.write_chapters(out["chapters"], str(base / "chapters"))
    text = lines(base / "chapters")["project_id=1"]
    assert text[0] == "00:00 Intro" and text[1].startswith("00:04 Day 1 · 2024-05-01") and text[-1].endswith("Outro")


def test_plan_can_fail_fast(spark):
    from cutlist.plans.jobs import build_candidates

    with pytest.raises(ValueError, match="day_mode"):
        write = spark.sql(
            "select 1L as project_id, '/a' as clip_path, 'a' as filename, 1000L as duration_ms, date'2024-01-01' as date_key, "
            "'' as location_id, '' as route_phase, '' as route_label, true as has_audio, timestamp_ntz'2024-01-01 00:00:00' as start_utc"
        )
        cues = spark.createDataFrame([], "project_id bigint, clip_path string, cue_no bigint, start_ms bigint, end_ms bigint, text string")
        from cutlist.schemas import BRIEF

        build_candidates(write, cues, spark.createDataFrame([], BRIEF), day_mode="other")
