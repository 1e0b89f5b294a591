"""Mixing sources to target weights by Pareto order sampling.

Every source has a target number of words. The rate target / words splits into whole copies, which every
document of the source gets, and a remainder, for which a sample of fixed size in words is drawn: documents
are ranked by random odds over inclusion odds, ``(U / (1 - U)) / (p / (1 - p))``, and enter in that order until
the remainder's words are reached. Inclusion probabilities fall with the square root of a document's size and
add up to the remainder in expected words, so that a few very long documents do not decide a source's total.

All work is DataFrame functions. A source may hold any share of the rows, so nothing is ranked per source as
a whole: ranks are cut into ``2**16`` ranges per source whose words are summed on the map side, the range in
which the target is reached is found among these sums, and only its documents are put in exact order.

Defined cases: a null or blank text has size 0 and is taken 0 times. A null source is a source of its own,
last in order. Rows with equal ids are separate documents. An empty table gives an empty mix. Equal ranks are
ordered by id, size and text hash; rows equal in all of these are interchangeable. Columns of any other name
pass through; ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlist.llm.common import WORD, carried, kept, quoted, restored, staged

#: Weights of the sources in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is taken more often than this.
MOST_COPIES = 3
#: Ranges of ranks per source: bounds what is ordered exactly, changes no result.
RANGES = 1 << 16
ADDED = ("size", "source_size", "target", "copies", "taken")


def words(text: Column) -> Column:
    """Number of words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: float = MOST_COPIES) -> DataFrame:
    """``source``, ``source_size``, ``target`` from (source, source_size), one row per source.

    Targets share all words by weight. Where one is above ``most`` times its source, it stops there and the
    excess is shared by weight among the others. The level where that comes to rest is found in one ordered
    pass over ``cap / weight``: capped sources are those with the smallest ratio.
    """
    # One row per source, the table's own grain; the windows below see only these.
    nth = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    every = Window.partitionBy(F.lit(0))
    by_ratio = every.orderBy("_ratio", "_n")
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    flow = (
        sizes.withColumn("_n", F.row_number().over(nth) - 1)
        .withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * float(most))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(every).cast("double"))
        .withColumn("_before", F.sum("_cap").over(upto) - F.col("_cap"))
        .withColumn("_rest", F.sum("_w").over(every) - F.sum("_w").over(upto) + F.col("_w"))
        .withColumn("_level", (F.col("_all") - F.col("_before")) / F.col("_rest"))
    )
    # The level if this source and all after it stay under their caps; the first such source fixes it.
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_n", "_level"))).over(every)
    target = F.least("_cap", F.coalesce(level["_level"] * F.col("_w"), F.col("_cap")))
    return flow.select("source", "source_size", target.alias("target"))


def _plan(measured: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """One row per source: words, target, whole copies, the remainder's words and its inclusion scale.

    p = min(1, scale / sqrt(size)) adds up to the remainder in expected words. The sizes for which p is 1 are
    the smallest ones; the scale is the one that the first size outside them gives. The windows see one row per
    source and distinct size.
    """
    counts = staged(measured.groupBy(F.col("_origin").alias("source"), "size").agg(F.count("*").alias("documents")))
    sizes = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("documents")).alias("source_size"))
    rate = F.when(F.col("_words") > 0, F.col("_target") / F.col("_words")).otherwise(0.0)
    targets = (
        source_targets(sizes, weights, most)
        .toDF("_source", "_words", "_target")
        .withColumn("_whole", F.least(F.floor(rate + 1e-12), F.lit(most)).cast("long"))
        .withColumn("_remainder", F.greatest(F.col("_target") - F.col("_whole") * F.col("_words"), F.lit(0.0)))
    )
    whole = Window.partitionBy("_source")
    upto = whole.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own, root = F.col("size") * F.col("documents"), F.sqrt("size") * F.col("documents")
    left = F.col("_remainder") - F.sum(own).over(upto) + own
    scale = left / (F.sum(root).over(whole) - F.sum(root).over(upto) + root)
    scales = (
        targets.join(counts.where("size > 0"), F.col("_source").eqNullSafe(F.col("source")))
        .withColumn("_k", scale)
        .where(F.col("_k") <= F.sqrt("size"))
        .groupBy(F.col("_source").alias("_of"))
        .agg(F.min_by("_k", "size").alias("_scale"))
    )
    return targets.join(scales, F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")


def uniform(seed: int, doc_id: Column, digest: Column) -> Column:
    """A number in (0, 1) with 52 random bits from the MD5 of seed, id and text digest."""
    name = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), digest)
    bits = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def measure(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All that ``mix`` needs of a document beside its carried columns: _id, _origin, size and _digest."""
    value = quoted(text)
    return docs.select(
        *carried(kept(docs, None, ADDED)), quoted(doc_id).alias("_id"), quoted(source).alias("_origin"),
        words(value).alias("size"), F.md5(F.coalesce(value, F.lit("")).cast("binary")).alias("_digest"),
    )


def mix(
    measured: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    seed: int = 7,
    most: int = MOST_COPIES,
    ranges: int = RANGES,
    columns: Sequence[str] = (),
) -> DataFrame:
    """``columns``, the names of the carried ones, with size, source_size, target, copies and taken (words).

    ``copies`` says how often a document enters the mix; ``expand`` repeats the rows. ``measured``, or a stored
    selection of its columns, is read twice: once for sums by source and size, once for the decisions.
    """
    plan = staged(_plan(measured, weights, most))
    p = F.least(F.lit(1.0), F.col("_scale") / F.sqrt("size"))
    u = uniform(seed, F.col("_id"), F.col("_digest"))
    odds = F.when(p >= 1, 0.0).when(p <= 0, float("inf")).otherwise(u / (1 - u) * (1 - p) / p)
    ranked = (
        measured.join(plan, F.col("_origin").eqNullSafe(F.col("_source")))
        .withColumn("_rank", F.when(F.col("size") > 0, odds))
        # Odds in (0, inf) go to (0, 1): as even as the random numbers, so ranges hold like shares of a source.
        .withColumn("_range", F.least(F.floor(F.col("_rank") / (1 + F.col("_rank")) * ranges), F.lit(ranges - 1)))
        .withColumn("_range", F.when(F.col("_rank") == float("inf"), ranges - 1).otherwise(F.col("_range")))
    )
    by_range = Window.partitionBy("_source").orderBy("_range")
    sums = (
        ranked.where(F.col("_range").isNotNull() & (F.col("_remainder") > 0))
        .groupBy("_source", "_range")
        .agg(F.sum("size").alias("_in"), F.first("_remainder").alias("_goal"))
        .withColumn("_before", F.sum("_in").over(by_range) - F.col("_in"))
        .where((F.col("_before") < F.col("_goal")) & (F.col("_before") + F.col("_in") >= F.col("_goal")))
        .select(F.col("_source").alias("_s"), F.col("_range").alias("_at"), "_before")
    )
    marked = ranked.join(staged(sums), F.col("_source").eqNullSafe(F.col("_s")), "left")
    at = F.coalesce(F.col("_range") == F.col("_at"), F.lit(False))
    # Only the range in which a source reaches its target is ordered; all other rows are decided by their range.
    inside = Window.partitionBy("_source").orderBy("_rank", "_id", "size", "_digest")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        marked.where(at)
        .withColumn("_sum", F.col("_before") + F.sum("size").over(running))
        # The document that crosses the target enters if that comes closer to it.
        .withColumn("_one", (F.col("_sum") - F.col("_remainder") <= F.col("_remainder") - (F.col("_sum") - F.col("size"))).cast("long"))
        .drop("_sum")
    )
    below = (F.col("_range") < F.col("_at")) & (F.col("_remainder") > 0)
    rest = marked.where(~at).withColumn("_one", F.coalesce(below, F.lit(False)).cast("long"))
    copies = F.when(F.col("size") > 0, F.least(F.col("_whole") + F.col("_one"), F.lit(most))).otherwise(0)
    return rest.unionByName(edge).select(
        *restored(columns), "size", F.col("_words").alias("source_size"), F.round("_target", 6).alias("target"),
        copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"),
    )


def expand(mixed: DataFrame) -> DataFrame:
    """One row per copy that the mix takes, without the columns that ``mix`` has added."""
    times = F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))
    return mixed.select(*[quoted(c) for c in kept(mixed, None, ADDED)], times.alias("copies")).drop("copies")


def mixed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = 7, most: int = MOST_COPIES) -> DataFrame:
    """``docs`` with the mix's columns; its texts are read twice."""
    return mix(measure(docs), weights, seed, most, columns=kept(docs, None, ADDED))
