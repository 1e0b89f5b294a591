"""The queries: each takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import adapters as A
from cutlist.functions import prompts as P
from cutlist.functions.briefs import brief_settings, editorial_text
from cutlist.functions.text import (
    language_code,
    result_key,
    segment_digest,
    slug,
    strip,
    title_parts,
)
from cutlist.functions.timekeys import day_key, epoch_ms, filename_time, iso_instant, wall_clock
from cutlist.operators import catalog, cues, presets, scoring, selection, timeline, transcripts, validate
from cutlist.operators.ordered import staged
from cutlist.plans.jobs import build_candidates, build_segments, prompt_features
from cutlist.sources import documents, sink, writers
from cutlist.sources.writers import cue_analysis

Query = Callable[[SparkSession, str], DataFrame]


def _text(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


# Cues and segments


def _cues(spark, sf, kind="conv"):
    return A.adapt(spark, sf, A.CUES_CONV if kind == "conv" else A.CUES_EVENTS)


def cue_normalize(spark, sf):
    return cues.normalize_cues(_cues(spark, sf)).select("project_id", "clip_path", "cue_no", "start_ms", "end_ms", "text")


def _session_rows(df):
    return df.select("project_id", "clip_path", "session_no", "start_ms", "end_ms", "n_cues", "excerpt")


def cue_groups(spark, sf):
    return _session_rows(cues.session_groups(cues.normalize_cues(_cues(spark, sf))))


def cue_groups_events(spark, sf):
    return _session_rows(cues.session_groups(cues.normalize_cues(_cues(spark, sf, "events"))))


def _merged_rows(df):
    return df.select("project_id", "clip_path", "group_index", "start_ms", "end_ms", "n_cues", "excerpt")


def cue_groups_merged(spark, sf):
    return _merged_rows(cues.cue_groups(_cues(spark, sf)))


def cue_groups_merged_events(spark, sf):
    return _merged_rows(cues.cue_groups(_cues(spark, sf, "events")))


def _segments(spark, sf):
    return build_segments(A.adapt(spark, sf, A.CLIPS_CONV), _cues(spark, sf), A.conv_briefs(spark, sf))


def cue_segments(spark, sf):
    return _segments(spark, sf).select(
        "project_id", "clip_path", "filename", "group_index", "ordinal", "start_ms", "end_ms", "duration_ms", "excerpt"
    )


def frame_plan(spark, sf):
    return cues.frame_plan(_segments(spark, sf)).select("project_id", "candidate_id", "frame_no", "at_ms")


def segment_key(spark, sf):
    return _segments(spark, sf).select(
        "project_id", "candidate_id", "digest", result_key(F.col("clip_path")).alias("result_key"),
        result_key(F.col("clip_path"), F.lit("sig1")).alias("cache_key"),
    )


def segment_digests(spark, sf):
    rows = _cues(spark, sf, "events")
    return rows.select(
        "project_id", "clip_path", "cue_no", segment_digest(F.col("clip_path"), F.col("start_ms"), F.col("end_ms")).alias("digest")
    )


# Catalog


def _clips(spark, sf):
    return catalog.build_clips(A.event_probes(spark, sf), A.anchor_briefs(spark, sf), 4)


def clip_catalog(spark, sf):
    return _clips(spark, sf).select(
        "project_id", "clip_path", "filename", "timezone_name", "duration_ms",
        F.col("width").cast("bigint").alias("width"), F.col("height").cast("bigint").alias("height"),
        F.round("fps", 3).alias("fps"), "has_audio", "size_bytes", "bitrate_mbps", "is_vertical",
        epoch_ms(F.col("start_utc")).alias("start_utc_ms"), epoch_ms(F.col("start_local")).alias("start_local_ms"),
        F.col("date_key").cast("string").alias("date_key"), "location_id", "route_phase", "route_label",
    )


def travel_day_key(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    stamp = F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("+02:00"))
    local = wall_clock(iso_instant(stamp), F.lit("Etc/GMT-9"))
    rows = events.select((F.col("user_id") % 10).alias("project_id"), "event_id", day_key(local, 4).alias("date_key"))
    days = catalog.travel_days(rows)
    return _text(rows.join(days, ["project_id", "date_key"]).select("project_id", "event_id", "date_key", "travel_day", "total_days"), "date_key")


def filename_times(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    plain = F.substring(F.regexp_replace(F.col("ts").cast("string"), "[-:]", ""), 1, 15)
    wrong = F.lit("20241340 250000")
    stamp = F.replace(F.when(F.col("event_id") % 7 == 3, wrong).otherwise(plain), F.lit(" "), F.lit("_"))
    name = F.concat(F.lit("VID_"), stamp, F.lit("-"), F.col("event_id").cast("string"), F.lit(".mp4"))
    return events.select("event_id", F.coalesce(epoch_ms(filename_time(name)), F.lit(-1)).alias("name_ms"))


def dominant_fps(spark, sf):
    return catalog.dominant_fps(_clips(spark, sf)).select("project_id", F.round("fps", 3).alias("fps"))


def date_span(spark, sf):
    spans = catalog.date_spans(_clips(spark, sf))
    return _text(spans, "first_date", "last_date")


def anchor_interval_join(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        (F.col("user_id") % 10).alias("project_id"), "event_id", F.col("ts").alias("creation_utc")
    )
    placed = catalog.resolve_time_context(events, catalog.time_contexts(A.anchor_briefs(spark, sf)))
    return placed.select("project_id", "event_id", "timezone_name", "location_id", "route_phase", "route_label")


def anchor_many(spark, sf):
    """As many anchors as clips, most of both in one project."""
    events = spark.read.parquet(f"{sf}/events.parquet").select(
        F.when(F.col("user_id") % 3 == 0, 1).otherwise(0).cast("bigint").alias("project_id"), "event_id", F.col("ts").alias("creation_utc")
    )
    placed = catalog.resolve_by_anchor_rows(events, *A.event_anchors(spark, sf))
    return placed.select("project_id", "event_id", "timezone_name", "location_id")


# Scoring


def _candidates(spark, sf):
    return build_candidates(
        A.adapt(spark, sf, A.CLIPS_CONV), _cues(spark, sf), A.conv_briefs(spark, sf), lexicon=A.text_lexicon()
    )


def _spoken(spark, sf):
    """Every turn as one search text, with its project's people and terms."""
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select(
        (F.col("conv_id") % 5).alias("project_id"), "conv_id", "turn", F.lower("text").alias("text")
    )
    return rows.join(scoring.brief_context(A.conv_briefs(spark, sf)), "project_id")


def event_type(spark, sf):
    kind = scoring.event_type(F.col("text"), F.lit(""), A.text_lexicon())
    return _spoken(spark, sf).select("conv_id", "turn", kind.alias("event_type"))


def people_terms(spark, sf):
    people = scoring.people_in(F.col("text"), F.col("_people_terms"), A.text_lexicon())
    wanted = F.exists("_must_include", lambda t: F.contains(F.col("text"), t))
    return _spoken(spark, sf).select(
        "conv_id", "turn", F.array_join(people, "|").alias("people"), F.size(people).cast("bigint").alias("n_people"),
        wanted.alias("has_must_include"),
    )


def feature_scores(spark, sf):
    return _candidates(spark, sf).select(
        "project_id", "candidate_id", "travel_day", "total_days",
        *[F.col(f"features.{f}").cast("bigint").alias(f) for f in scoring.FEATURES],
    )


def overall_priority(spark, sf):
    return _candidates(spark, sf).select(
        "project_id", "candidate_id", "event_type", F.array_join("people", "|").alias("people_found"),
        F.col("overall").cast("bigint").alias("overall"), "priority", "summary",
    )


def cue_analysis_by_day(spark, sf):
    days, rows = cue_analysis(_candidates(spark, sf))
    ranked = rows.join(days.select("project_id", "travel_day", "label", "cue_count"), ["project_id", "travel_day"])
    return ranked.select(
        "project_id", "travel_day", "label", "cue_count", "candidate_id", F.col("overall").cast("bigint").alias("overall"),
        "duration_ms",
    )


# Selection


def _pool(spark, sf):
    return (
        A.adapt(spark, sf, A.CAND_EVENTS)
        .withColumn("people", F.when(F.col("event_id") % 4 == 0, F.array(F.lit("Ana"), F.lit("Theo"))).otherwise(F.array().cast("array<string>")))
        .withColumn("summary", F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Scene "), F.col("event_type"))))
    )


def day_budgets(spark, sf):
    rows = selection.day_budgets(_pool(spark, sf), A.adapt(spark, sf, A.TARGETS))
    return _text(rows, "date_key").select(
        "project_id", "date_key", "total_ms", F.round("weight", 6).alias("weight"), F.round("share", 6).alias("share"),
        "n_days", "overhead_s", "content_s", "budget_ms",
    )


def _chosen(spark, sf):
    pool = _pool(spark, sf)
    return selection.choose(pool, selection.day_budgets(pool, A.adapt(spark, sf, A.TARGETS)))


def select_segments(spark, sf):
    return _text(_chosen(spark, sf), "date_key").select("project_id", "date_key", "candidate_id", "rank", "used_ms")


def _selected(spark, sf):
    return selection.select_segments(_pool(spark, sf), A.adapt(spark, sf, A.TARGETS))


def selection_roles(spark, sf):
    return _text(_selected(spark, sf), "date_key").select(
        "project_id", "travel_day", "date_key", "day_label", "candidate_id", "sequence_index", "role", "reason"
    )


def faulty_selection(spark, sf):
    """Every candidate selected once, numbered by id in its day, with faults planted by event number."""
    pool = _pool(spark, sf)
    placed = selection.place_in_day(pool).join(catalog.travel_days(pool), ["project_id", "date_key"])
    kind = F.col("event_id") % 17
    # Faults of the numbering only on odd days, so that the others have valid rows.
    kind = F.when(kind.isin(3, 7, 8, 14) & (F.col("travel_day") % 2 == 0), 0).otherwise(kind)
    start = F.col("start_ms").cast("string")
    return placed.select(
        "project_id",
        "travel_day",
        F.when(kind == 3, F.lit("2023-01-01")).otherwise(F.col("date_key").cast("string")).alias("date_key"),
        F.lit("").alias("day_label"),
        F.when(kind == 1, F.concat("candidate_id", F.lit("x"))).otherwise(F.col("candidate_id")).alias("candidate_id"),
        F.when(kind == 2, F.lit("/clips/other.mp4")).otherwise(F.col("clip_path")).alias("clip_path"),
        F.when(kind == 4, (F.col("start_ms") - 20).cast("string"))
        .when(kind == 9, (F.col("start_ms") - 10).cast("string"))
        .when(kind == 10, F.lit("soon"))
        .when(kind == 12, F.concat(start, F.lit(".0")))
        .when(kind == 13, F.col("start_ms").cast("double").cast("string"))
        .when(kind != 11, start)
        .alias("start_ms"),
        F.when(kind == 5, F.col("start_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(kind == 7, (F.col("sequence_index") + 1).cast("string"))
        .when(kind == 14, F.concat(F.col("sequence_index").cast("string"), F.lit(".5")))
        .otherwise(F.col("sequence_index").cast("string"))
        .alias("sequence_index"),
        (kind != 8).alias("enabled"),
        F.when(kind == 6, F.lit(" ")).otherwise(F.lit("moment")).alias("role"),
        F.lit("fits").alias("reason"),
    )


def validate_selection(spark, sf):
    projects = spark.read.parquet(f"{sf}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("project_id"))
    _, violations = validate.validate_selection(faulty_selection(spark, sf), _pool(spark, sf), projects)
    return violations


def valid_selection(spark, sf):
    valid, _ = validate.validate_selection(faulty_selection(spark, sf), _pool(spark, sf))
    return valid.select("project_id", "travel_day", "date_key", "day_label", "candidate_id", "start_ms", "end_ms", "sequence_index")


def _documents(spark, sf):
    return A.adapt(spark, sf, A.SELECTION_DOCUMENTS)


def selection_documents(spark, sf):
    _, rows, _ = documents.selection_documents(_documents(spark, sf))
    return rows.withColumn("sequence_index", F.col("sequence_index").cast("bigint"))


def selection_headers(spark, sf):
    return documents.selection_documents(_documents(spark, sf))[0]


def selection_rejects(spark, sf):
    """Documents of another shape, as rows of the report on selections."""
    return validate.structure_rejects(documents.selection_documents(_documents(spark, sf))[2])


def candidate_documents(spark, sf):
    _, rows, _ = documents.candidate_documents(A.adapt(spark, sf, A.CANDIDATE_DOCUMENTS))
    return rows


def document_selection_faults(spark, sf):
    """What is wrong with the selections in documents, by the candidates in documents."""
    # The report reads rows twice, and rejects come from the same texts: these are written once and parsed once for rows.
    _, rows, rejects = documents.selection_documents(staged(_documents(spark, sf)))
    _, candidates, _ = documents.candidate_documents(A.adapt(spark, sf, A.CANDIDATE_DOCUMENTS))
    _, violations = validate.validate_selection(staged(rows), candidates)
    return violations.unionByName(validate.structure_rejects(rejects)).groupBy("project_id", "rule").agg(F.count(F.lit(1)).alias("n"))


def _shared(spark) -> str:
    """A folder of this query's own in the session's checkpoint folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="checks-"))
    return f"{sc.getCheckpointDir()}/documents-{uuid.uuid4().hex}"


def written_selections(spark, sf):
    """Selection documents written project by project and read back: headers, days and selections."""
    path = _shared(spark)
    writers.write_selection_documents(staged(_selected(spark, sf)), A.adapt(spark, sf, A.TITLES), path)
    lines = sink.read_lines(spark, path)
    day = F.from_json("text", "travel_day bigint, candidate_id string, start double, end double")
    counts = lines.select("project_id", day.alias("_d")).groupBy("project_id").agg(
        F.count_if(F.col("_d.candidate_id").isNotNull()).alias("n_selections"),
        F.sum(F.round((F.col("_d.end") - F.col("_d.start")) * 1000).cast("bigint")).alias("total_ms"),
    )
    days = lines.filter(F.col("text").startswith('{"travel_day"')).groupBy("project_id").agg(F.count(F.lit(1)).alias("n_days"))
    heads = sink.read_headers(spark, path, "project_title string, selection_mode string", "days")
    return heads.join(counts, "project_id").join(days, "project_id")


def written_transcripts(spark, sf):
    """Transcript documents and their reports: the header of each project and what its clips hold."""
    path, results = _shared(spark), A.conv_results(spark, sf)
    settings = results.select(
        "project_id", F.concat(F.lit("Trip "), F.col("project_id").cast("string")).alias("project"), F.lit("ko").alias("speech_locale"),
        F.lit("base").alias("model"), F.lit("sig").alias("taxonomy_signature"),
    ).distinct()
    writers.write_transcript_documents(results, settings, path)
    clip = F.from_json("text", "clip_path string, transcript array<struct<text: string>>")
    clips = sink.read_lines(spark, path).select("project_id", clip.alias("_c")).filter("_c.clip_path is not null")
    counts = clips.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("n_clips"), F.sum(F.length(F.get("_c.transcript", F.lit(0))["text"])).alias("n_chars")
    )
    heads = sink.read_headers(spark, path, "project string, provider string, model string, speech_locale string", "clips")
    report = writers.transcript_summary(results, settings).select("project_id", "taxonomy_signature", "transcribed_clip_count", "empty_transcript_count")
    return heads.join(counts, "project_id").join(report, "project_id")


# Timeline


def _planned(spark, sf):
    """Selections with a fault in project 1, catalog without some clips of project 2, no title for project 3."""
    pool = _pool(spark, sf)
    picked = _selected(spark, sf)
    first = (F.col("project_id") == 1) & (F.col("sequence_index") == 1)
    picked = picked.withColumn("role", F.when(first, F.lit("")).otherwise(F.col("role")))
    clips = A.adapt(spark, sf, A.CLIPS_EVENTS).filter("not (project_id = 2 and clip_path like '%7.mp4')")
    titles = A.adapt(spark, sf, A.TITLES).filter("project_id <> 3")
    valid, violations = validate.validate_selection(picked, pool)
    return valid, timeline.plan_faults(valid, violations, clips, titles), clips, titles


def plan_faults(spark, sf):
    return _planned(spark, sf)[1]


def sound_items(spark, sf):
    valid, faults, clips, titles = _planned(spark, sf)
    return _text(timeline.build_timeline(timeline.sound_selections(valid, faults), clips, titles), "source_local")


def _timeline(spark, sf):
    return timeline.build_timeline(_selected(spark, sf), A.adapt(spark, sf, A.CLIPS_EVENTS), A.adapt(spark, sf, A.TITLES))


def timeline_items(spark, sf):
    return _text(_timeline(spark, sf), "source_local")


def timeline_totals(spark, sf):
    return timeline.timeline_summary(_timeline(spark, sf))


def chapters(spark, sf):
    return timeline.chapters(_timeline(spark, sf))


def timeline_chunks(spark, sf):
    return timeline.chunk_timeline(_timeline(spark, sf), A.adapt(spark, sf, A.TITLES))


def edit_list(spark, sf):
    return timeline.edit_list(_timeline(spark, sf))


# Transcripts

# Fixed rows: corrections for the given texts, in order.
TERMS = (("Rere", ("rere", "the", "e ")), ("TION", ("tion", "ation", "TION")), ("", ("zz",)))
RULES = ((r"eau(x)", r"EAU\1"), (r"\s+de\s+", " $de$ "), (" ", "x"), (r"(o)u", r"\1-\1"))
BAD_RULES = (("(", "x"), ("a", r"\2"))


def _corrections(spark, keys: DataFrame) -> DataFrame:
    terms = F.array(
        *[
            F.struct(F.lit(c).alias("canonical"), F.lit("word").alias("category"), F.array(*[F.lit(a) for a in aliases]).alias("aliases"))
            for c, aliases in TERMS
        ]
    )
    rules = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("replacement")) for p, r in RULES])
    # One project has a rule that is no pattern and one that names a group it does not have; both are left out.
    bad = F.array(*[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("replacement")) for p, r in BAD_RULES])
    own = F.when(F.col("project_id") == 1, F.concat(bad, rules)).otherwise(rules)
    none = [F.lit(None).cast("string").alias("context"), F.lit(None).cast("array<string>").alias("prompt_terms")]
    return keys.select("project_id", *none, terms.alias("terms"), own.alias("replacement_rules"))


def taxonomy_correct(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 10).alias("project_id"), "doc_id", "text")
    return transcripts.correct_cues(docs, _corrections(spark, docs.select("project_id").distinct())).select("doc_id", "text")


def curated_results(spark, sf):
    """Stored transcripts corrected; a cue of blanks and hyphens goes, and with the only one the clip is empty."""
    results = A.conv_results(spark, sf)
    turn = F.regexp_extract("clip_path", r"_(\d+)\.mp4", 1).cast("int")
    hollow = F.struct(F.lit("5").alias("start"), F.lit("6").alias("end"), F.lit(" -\n- ").alias("text"))
    again = F.transform("transcript", lambda c: c.withField("text", F.concat(F.lit("- the  "), c["text"], F.lit(" eaux -"))))
    planted = F.when(turn % 3 == 0, F.concat("transcript", F.array(hollow), again)).when(turn % 3 == 1, F.array(hollow)).otherwise(F.col("transcript"))
    done = transcripts.curate_results(results.withColumn("transcript", planted), _corrections(spark, results.select("project_id").distinct()))
    return done.select(
        "project_id", "clip_path", "transcript_status", F.size("transcript").cast("bigint").alias("n_cues"),
        F.array_join(F.transform("transcript", lambda c: c["text"]), "|").alias("texts"),
    )


def rejected_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") % 10).alias("project_id")).distinct()
    return transcripts.rejected_rules(_corrections(spark, docs))


def vocabulary(spark, sf):
    """Customers as projects: the default taxonomy and their brief's people, places and own terms."""
    customers = spark.read.parquet(f"{sf}/customer.parquet").withColumn("project_id", F.col("c_custkey"))
    name, place = F.col("c_name"), F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string"))
    briefs = A.as_briefs(
        customers.select(
            "project_id",
            F.array(F.struct(name.alias("name"), F.array(F.lower("c_name"), F.lit(" "), F.lit("공항")).alias("aliases"))).alias("people"),
            F.array(F.struct(place.alias("name"), F.array(F.lit("지도"), name).alias("aliases"))).alias("places"),
            F.array(F.struct(F.lit("Day out").alias("label"), F.array(place, F.col("c_mktsegment")).alias("keywords"))).alias("story_anchors"),
            F.struct(F.array(F.lit("own"), F.lit("own"), name).alias("prompt_terms")).alias("transcription"),
        )
    )
    none = spark.createDataFrame([], A.BRIEF).select("project_id")
    empty = none.selectExpr(
        "project_id", "'' as context", "array() as prompt_terms",
        "cast(array() as array<struct<canonical:string,category:string,aliases:array<string>>>) as terms",
        "cast(array() as array<struct<pattern:string,replacement:string>>) as replacement_rules",
    )
    own = transcripts.merge_taxonomy(transcripts.taxonomies_with_default(briefs, empty), briefs)
    return transcripts.vocabulary_prompt(own)


def transcript_report(spark, sf):
    return transcripts.transcript_report(A.conv_results(spark, sf))


def transcript_statuses(spark, sf):
    rows = A.conv_results(spark, sf)
    return rows.select(
        "project_id", "clip_path", transcripts.transcript_status(F.col("transcript")).alias("status"),
        language_code(F.col("speech_locale")).alias("language"),
    )


def result_upsert(spark, sf):
    rows = A.conv_results(spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    path = F.concat(F.lit("/clips/"), F.concat_ws("_", F.lit("conv"), F.col("conv_id") + F.when(F.col("turn") % 2 == 0, 0).otherwise(100000), "turn"), F.lit(".mp4"))
    patch = turns.select(
        (F.col("conv_id") % 5).alias("project_id"),
        path.alias("clip_path"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("patch_no"),
        "turn",
    ).select(
        "project_id",
        "clip_path",
        "patch_no",
        F.concat(F.lit("redo-"), F.col("patch_no").cast("string")).alias("provider"),
        F.when(F.col("turn") == 2, F.lit(None)).otherwise(F.lit("xx")).alias("speech_locale"),
    )
    merged = transcripts.upsert_results(rows, patch, "2024-02-02T00:00:00")
    return merged.select(
        "project_id", "clip_path", "filename", "provider", F.coalesce("speech_locale", F.lit("-")).alias("speech_locale"),
        F.coalesce("transcription_model", F.lit("-")).alias("transcription_model"), "updated_at",
    )


def work_list(spark, sf):
    rows = A.conv_results(spark, sf)
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(
        F.concat(F.lit("/clips/"), F.concat_ws("_", F.lit("conv"), "conv_id", "turn"), F.lit(".mp4")).alias("clip_path"), "conv_id", "turn"
    )
    # Wanted with another model or locale than stored, clips are work even if the taxonomy is the same.
    wanted = rows.join(turns, "clip_path").select(
        "project_id", "clip_path", "provider",
        F.when(F.col("turn") % 3 == 0, F.lit("large")).otherwise(F.col("transcription_model")).alias("transcription_model"),
        F.when(F.col("conv_id") % 7 == 0, F.lit("xx")).otherwise(F.col("speech_locale")).alias("speech_locale"),
        F.lit("sig2").alias("taxonomy_signature"),
    )
    return transcripts.work_list(wanted, rows).select("project_id", "clip_path")


# Presets and prompts


def preset_resolve(spark, sf):
    """Customers as projects: their market segment and account name a few presets, some of them unknown."""
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    names = F.array(
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(" warm ")).when(F.col("c_mktsegment") == "MACHINERY", F.lit("resort")).otherwise(F.lit("refined_travel")),
        F.when(F.col("c_nationkey") % 3 == 0, F.lit("warm_family_vlog")).when(F.col("c_nationkey") % 3 == 1, F.lit("teal_orange")).otherwise(F.lit("sepia")),
        F.lit("refined"),
    )
    wanted = customers.select(F.col("c_custkey").alias("project_id"), F.posexplode(names).alias("ordinal", "name"))
    known, unknown = presets.resolve_presets(wanted)
    marked = known.withColumn("known", F.lit(True)).unionByName(
        unknown.select(
            "project_id", "ordinal", F.col("name").alias("preset_id"), F.lit("").alias("label"), F.lit("").alias("category"),
            F.lit(False).alias("known"),
        )
    )
    return marked.withColumn("ordinal", F.col("ordinal").cast("bigint"))


def _customer_briefs(spark, sf):
    customers = spark.read.parquet(f"{sf}/customer.parquet")
    when = lambda test, value: F.when(test, F.lit(value)).otherwise(F.lit(""))
    even = F.col("c_custkey") % 2 == 0
    return A.as_briefs(
        customers.select(
            F.col("c_custkey").alias("project_id"),
            F.struct(
                F.concat(F.lit("  "), F.col("c_name"), F.lit(" ")).alias("summary"),
                when(even, "warm").alias("tone"),
                F.array(F.col("c_mktsegment"), F.lit(" "), F.lit(" beach ")).alias("must_include"),
                F.when(even, F.array(F.lit(""))).otherwise(F.array(F.lit("rain"), F.lit("crowds"))).alias("avoid"),
                when(~even, "food first").alias("meal_guidance"),
                F.when(F.col("c_nationkey") < 12, F.concat(F.col("c_nationkey").cast("string"), F.lit(" hours"))).otherwise(F.lit(" ")).alias("target_runtime"),
                F.lit("fade").alias("closer_guidance"),
            ).alias("editorial_brief"),
            F.struct(when(even, " UTC ").alias("default_timezone")).alias("project"),
            F.struct(
                F.when(F.col("c_nationkey") % 3 == 0, F.array(F.lit(" "), F.lit("resort"))).otherwise(F.array(F.lit(" "))).alias("preview_presets"),
                when(F.col("c_nationkey") % 2 == 0, "refined").alias("selected_preset"),
                F.array(F.lit(" softer "), F.lit("")).alias("final_feedback"),
            ).alias("render"),
        )
    )


def editorial_texts(spark, sf):
    return _customer_briefs(spark, sf).select("project_id", editorial_text(F.col("editorial_brief")).alias("editorial"))


def brief_defaults(spark, sf):
    return brief_settings(_customer_briefs(spark, sf)).select(
        "project_id", F.coalesce("default_timezone", F.lit("-")).alias("default_timezone"),
        F.array_join("preview_presets", "|").alias("preview_presets"), "selected_preset", "final_render_mode",
        F.array_join("final_feedback", "|").alias("final_feedback"),
    )


def _prompts(spark, sf):
    return A.adapt(spark, sf, A.PROMPTS)


def prompt_runtime(spark, sf):
    return _prompts(spark, sf).select(
        "project_id", P.runtime_phrase(F.col("prompt")).alias("phrase"), P.runtime_seconds(F.col("prompt")).alias("seconds")
    )


def prompt_tone(spark, sf):
    prompt = F.col("prompt")
    return _prompts(spark, sf).select(
        "project_id", F.coalesce(P.tone(prompt), F.lit("")).alias("tone"), F.coalesce(P.pacing(prompt), F.lit("")).alias("pacing"),
        P.season(prompt).alias("season"),
    )


def prompt_dates(spark, sf):
    dates = P.prompt_dates(F.col("prompt"), F.col("first_date"), F.col("last_date"))
    return _prompts(spark, sf).select("project_id", P.prompt_date_span(dates).alias("date_span"))


def prompt_places(spark, sf):
    return _prompts(spark, sf).select("project_id", F.array_join(P.places(F.col("prompt")), "|").alias("places"))


def prompt_title(spark, sf):
    prompt = F.col("prompt")
    rows = _prompts(spark, sf).withColumn("prompt", strip(prompt)).withColumn("explicit", P.explicit_title(prompt))
    return rows.select(
        "project_id", "explicit", P.video_title(prompt, F.lit(""), F.col("description"), F.col("explicit")).alias("title")
    )


def prompt_feature_rows(spark, sf):
    rows = _prompts(spark, sf)
    return prompt_features(rows.select("project_id", "prompt", "description"), rows)


def label_slugs(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    label = F.concat("url", F.lit(" · Étape ·"), F.col("page_id").cast("string"))
    return pages.select(
        "page_id", slug(label).alias("slug"), title_parts(label)["title"].alias("card_title"),
        title_parts(label)["subtitle"].alias("card_subtitle"),
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        cue_normalize, cue_groups, cue_groups_events, cue_groups_merged, cue_groups_merged_events, cue_segments,
        frame_plan, segment_key, segment_digests, clip_catalog, travel_day_key, filename_times, dominant_fps, date_span,
        anchor_interval_join, anchor_many, event_type, people_terms, feature_scores, overall_priority, cue_analysis_by_day,
        day_budgets, select_segments, selection_roles, validate_selection, valid_selection, selection_documents, selection_headers, selection_rejects, candidate_documents,
        document_selection_faults, written_selections, written_transcripts, plan_faults, sound_items, timeline_items,
        timeline_totals, chapters, timeline_chunks, edit_list, taxonomy_correct, curated_results, rejected_rules, vocabulary, transcript_report,
        transcript_statuses, result_upsert, work_list, preset_resolve, editorial_texts, brief_defaults, prompt_runtime,
        prompt_tone, prompt_dates, prompt_places, prompt_title, prompt_feature_rows, label_slugs,
    )
}
