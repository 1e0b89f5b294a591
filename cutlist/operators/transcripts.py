"""Transcript curation: taxonomies, corrections, stored results and their report."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cutlist.functions.briefs import people_terms, prompt_terms
from cutlist.functions.text import caption_text, cleaned, file_name, filled, strip
from cutlist.operators import corrections
from cutlist.schemas import TAXONOMY

# Fixed values.
DEFAULT_TAXONOMY = {
    "context": "한국어 여행 브이로그 전사입니다. 자막은 짧고 자연스럽게 유지합니다.",
    "prompt_terms": [
        "공항", "숙소", "리조트", "수영장", "해변", "아침식사", "조식", "체크인", "체크아웃", "출발", "도착", "지도", "짐", "여행",
    ],
    "terms": [
        {"canonical": "공항", "category": "travel", "aliases": []},
        {"canonical": "숙소", "category": "lodging", "aliases": []},
        {"canonical": "리조트", "category": "lodging", "aliases": []},
        {"canonical": "수영장", "category": "activity", "aliases": []},
        {"canonical": "해변", "category": "activity", "aliases": []},
        {"canonical": "아침식사", "category": "meal", "aliases": []},
        {"canonical": "조식", "category": "meal", "aliases": []},
        {"canonical": "체크인", "category": "travel", "aliases": []},
        {"canonical": "체크아웃", "category": "travel", "aliases": []},
        {"canonical": "출발", "category": "travel", "aliases": []},
        {"canonical": "도착", "category": "travel", "aliases": []},
        {"canonical": "지도", "category": "travel", "aliases": []},
    ],
    "replacement_rules": [
        {"pattern": "호치민", "replacement": "호찌민"},
        {"pattern": "하고싶", "replacement": "하고 싶"},
        {"pattern": "갔다올게요", "replacement": "갔다 올게요"},
        {"pattern": "어디가지\\?", "replacement": "어디 가지?"},
        {"pattern": "우리집", "replacement": "우리 집"},
    ],
}
DEFAULT_PROVIDER = "cohere-local"
STATUS_OK, STATUS_EMPTY = "ok", "empty"

_NO_TEXT = "array<string>"


def taxonomies_with_default(projects: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """Each project's own taxonomy, or the default one."""
    default = F.from_json(F.lit(json.dumps(DEFAULT_TAXONOMY)), StructType(TAXONOMY.fields[1:]))
    missing = projects.select("project_id").distinct().join(taxonomies, "project_id", "left_anti")
    return taxonomies.select(*TAXONOMY.fieldNames()).unionByName(
        missing.withColumn("_d", default).select("project_id", "_d.*")
    )


def merge_taxonomy(taxonomies: DataFrame, briefs: DataFrame) -> DataFrame:
    """Add a brief's people, terms and rules to the project's taxonomy.

    People are added unless the taxonomy already has their name; a name repeated within the brief stays.
    """
    extra = briefs.select(
        "project_id",
        people_terms(F.col("people")).alias("_people"),
        prompt_terms(briefs).alias("_prompt_terms"),
        F.col("transcription.replacement_rules").alias("_rules"),
    )
    empty = lambda c, name: F.coalesce(c, F.array().cast(TAXONOMY[name].dataType))
    known = F.transform(empty(F.col("terms"), "terms"), lambda t: F.coalesce(filled(t["canonical"]), F.lit("")))
    return taxonomies.join(extra, "project_id", "left").select(
        "project_id",
        "context",
        F.array_distinct(
            cleaned(F.concat(empty(F.col("prompt_terms"), "prompt_terms"), empty(F.col("_prompt_terms"), "prompt_terms")))
        ).alias("prompt_terms"),
        F.concat(
            empty(F.col("terms"), "terms"),
            empty(F.filter("_people", lambda p: ~F.array_contains(known, p["canonical"])), "terms"),
        ).alias("terms"),
        F.concat(
            empty(F.col("replacement_rules"), "replacement_rules"), empty(F.col("_rules"), "replacement_rules")
        ).alias("replacement_rules"),
    )


def alias_rules(terms: Column) -> Column:
    """Alias replacements, longest alias first, list order among equals."""
    per_term = F.transform(
        F.filter(terms, lambda t: filled(t["canonical"]).isNotNull()),
        lambda t: F.transform(
            F.filter(F.coalesce(cleaned(t["aliases"]), F.array().cast(_NO_TEXT)), lambda a: a != strip(t["canonical"])),
            lambda a: F.struct(a.alias("alias"), strip(t["canonical"]).alias("canonical")),
        ),
    )
    ranked = F.transform(
        F.flatten(per_term),
        lambda r, i: F.struct((-F.length(r["alias"])).alias("by"), i.alias("at"), r["alias"].alias("alias"), r["canonical"].alias("canonical")),
    )
    return F.array_sort(ranked)


def regex_rules(rules: Column) -> Column:
    """Rules with a pattern, stripped; a missing replacement is an empty one."""
    return F.transform(
        F.filter(rules, lambda r: filled(r["pattern"]).isNotNull()),
        lambda r: F.struct(strip(r["pattern"]).alias("pattern"), F.coalesce(strip(r["replacement"]), F.lit("")).alias("replacement")),
    )


def _own_rules(taxonomies: DataFrame) -> Column:
    return regex_rules(F.coalesce("replacement_rules", F.array().cast(TAXONOMY["replacement_rules"].dataType)))


def rejected_rules(taxonomies: DataFrame) -> DataFrame:
    """Rules that no correction uses, because the pattern or the replacement is not one: project and pattern."""
    every = taxonomies.select("project_id", F.explode(_own_rules(taxonomies)).alias("_rule"))
    usable = F.arrow_udf(corrections.usable, "boolean")
    return every.filter(~usable("_rule.pattern", "_rule.replacement")).select("project_id", F.col("_rule.pattern").alias("pattern"))


def _definitions(taxonomies: DataFrame, *more: Column) -> DataFrame:
    """A project's aliases and rules as one text, which tasks compile once."""
    terms = F.coalesce("terms", F.array().cast(TAXONOMY["terms"].dataType))
    aliases = F.transform(alias_rules(terms), lambda r: F.struct(r["alias"].alias("alias"), r["canonical"].alias("canonical")))
    return taxonomies.select(
        "project_id", F.to_json(F.struct(aliases.alias("aliases"), _own_rules(taxonomies).alias("rules"))).alias("_rules"), *more
    )


def _blanks(text: Column) -> Column:
    """One pass over double blanks, and none at the ends."""
    return strip(F.replace(text, F.lit("  "), F.lit(" ")))


def correct_cues(cues: DataFrame, taxonomies: DataFrame, text: str = "text") -> DataFrame:
    """Normalize and correct the text of each row by its project's taxonomy (P2, F11): aliases, then rules, then blanks."""
    plain = caption_text(F.col(text))
    joined = cues.withColumn(text, plain).join(_definitions(taxonomies), "project_id", "left")
    corrected = _blanks(F.arrow_udf(corrections.correct_texts, "string")(text, "_rules"))
    own = F.when(F.col("_rules").isNull(), F.col(text)).otherwise(corrected)
    return joined.withColumn(text, own).select(*cues.columns)


def curate_results(results: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """Correct the transcripts of stored results, drop emptied cues and set the status."""
    rules = _definitions(taxonomies, taxonomy_signature(taxonomies).alias("_signature"))
    plain = F.transform("transcript", lambda c: caption_text(c["text"]))
    joined = results.join(rules, "project_id", "left").withColumn("_texts", plain)
    corrected = F.transform(F.arrow_udf(corrections.correct_lists, "array<string>")("_texts", "_rules"), _blanks)
    texts = F.when(F.col("_rules").isNull(), F.col("_texts")).otherwise(corrected)
    fixed = F.zip_with("transcript", "_texts", lambda c, t: c.withField("text", t))
    return (
        joined.withColumn("_texts", texts)
        .withColumn("transcript", F.filter(fixed, lambda c: c["text"] != ""))
        .withColumn("transcript_status", transcript_status(F.col("transcript")))
        .withColumn("taxonomy_signature", F.coalesce("_signature", "taxonomy_signature"))
        .select(*results.columns)
    )


def transcript_status(transcript: Column) -> Column:
    return F.when(F.coalesce(F.size(transcript), F.lit(0)) > 0, F.lit(STATUS_OK)).otherwise(F.lit(STATUS_EMPTY))


def taxonomy_signature(taxonomies: DataFrame) -> Column:
    """Twelve hex digits that change with the taxonomy (F10; our own serialization)."""
    fields = [taxonomies[name] for name in ("context", "prompt_terms", "replacement_rules", "terms")]
    return F.substring(F.sha1(F.to_json(F.struct(*fields))), 1, 12)


def vocabulary_prompt(taxonomies: DataFrame, lead: str = "Names and terms: ") -> DataFrame:
    """Context and distinct terms as one line of text."""
    canonical = F.transform("terms", lambda t: t["canonical"])
    terms = F.array_distinct(
        cleaned(
            F.concat(F.coalesce("prompt_terms", F.array().cast(_NO_TEXT)), F.coalesce(canonical, F.array().cast(_NO_TEXT)))
        )
    )
    listed = F.when(F.size(terms) > 0, F.concat(F.lit(lead), F.array_join(terms, ", "), F.lit(".")))
    return taxonomies.select(
        "project_id", F.size(terms).cast("bigint").alias("n_terms"), F.concat_ws(" ", filled(F.col("context")), listed).alias("prompt")
    )


#: What a stored transcript was made with; another value in any of them makes it another transcript.
SIGNATURE = ("provider", "transcription_model", "speech_locale", "taxonomy_signature")


def work_list(clips: DataFrame, results: DataFrame, signature: Sequence[str] = SIGNATURE) -> DataFrame:
    """Clips without a stored result of the wanted signature; an empty transcript counts as stored.

    ``clips`` has the wanted values in the columns of ``signature``; nulls are equal to each other.
    """
    key = ("project_id", "clip_path", *signature)
    done = results.filter("transcript is not null").select(*[F.col(c).alias(f"_{c}") for c in key])
    same = [F.col(c) == F.col(f"_{c}") if c in key[:2] else F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return clips.join(done, same, "left_anti")


def stored_or_default(clips: DataFrame, results: DataFrame) -> DataFrame:
    """Stored result of each clip, or a row with path and file name only."""
    kept = [c for c in results.columns if c not in ("project_id", "clip_path", "filename")]
    mine = results.withColumnRenamed("filename", "_stored")
    return (
        clips.select("project_id", "clip_path")
        .join(mine, ["project_id", "clip_path"], "left")
        .withColumn("filename", F.coalesce("_stored", file_name(F.col("clip_path"))))
        .select("project_id", "clip_path", "filename", *kept)
    )


def upsert_results(
    results: DataFrame, patch: DataFrame, updated_at: Column | str, order: Sequence[str] = ("patch_no",)
) -> DataFrame:
    """Merge patches into stored results; the patch's columns win, even where they are null.

    Several patches of one clip apply in the order of ``order``, so the last one counts.
    """
    key = ["project_id", "clip_path"]
    fields = [c for c in patch.columns if c not in (*key, *order)]
    last = patch.groupBy(*key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_p"))
    stamp = F.lit(updated_at) if isinstance(updated_at, str) else updated_at
    joined = results.alias("o").join(last.alias("n"), key, "full_outer")
    patched = F.col("n._p").isNotNull()
    out = []
    for c in results.columns:
        if c in key:
            out.append(F.col(c))
        elif c == "filename":
            out.append(F.when(patched, file_name(F.col("clip_path"))).otherwise(F.col("o.filename")).alias(c))
        elif c == "updated_at":
            out.append(F.when(patched, stamp).otherwise(F.col("o.updated_at")).alias(c))
        elif c in fields:
            out.append(F.when(patched, F.col(f"n._p.{c}")).otherwise(F.col(f"o.{c}")).alias(c))
        else:
            out.append(F.col(f"o.{c}"))
    return joined.select(*out)


def transcript_report(results: DataFrame) -> DataFrame:
    """Clips, transcribed and empty ones, and the providers of each project."""
    per_clip = results.groupBy("project_id", "clip_path").agg(
        F.max(transcript_status(F.col("transcript")) == STATUS_OK).alias("_ok"), F.max("provider").alias("provider")
    )
    counts = per_clip.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("clip_count"), F.count_if("_ok").alias("transcribed_clip_count")
    )
    providers = (
        per_clip.select("project_id", filled(F.col("provider")).alias("provider"))
        .filter("provider is not null")
        .distinct()
        .groupBy("project_id")
        .agg(F.array_join(F.array_sort(F.collect_list("provider")), ", ").alias("provider"))
    )
    return counts.join(providers, "project_id", "left").select(
        "project_id",
        F.coalesce("provider", F.lit(DEFAULT_PROVIDER)).alias("provider"),
        "clip_count",
        "transcribed_clip_count",
        (F.col("clip_count") - F.col("transcribed_clip_count")).alias("empty_transcript_count"),
    )
