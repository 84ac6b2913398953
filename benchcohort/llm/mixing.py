"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size in words. A budget of words is shared out
in proportion to the weights; a source is clamped at ``max_epochs`` times its
size and what it cannot take is shared out again by weight until no source is
above its clamp. The fixpoint has a closed form: with sources in ascending
order of clamp / weight the clamped ones are a prefix, so one running sum over
the per-source rows (one row per source, never per document) gives the level.

Documents are then sampled without a sort of a whole source: each document
gets a place from a seeded hash, a source's places are cut into 4096 bins whose
sizes are aggregated, and a running sum over bins plus one inside a bin gives
every document the words placed before it. ``target = whole * size + rest``:
each document is taken ``whole`` times, and once more if its middle lies within
the first ``rest`` words. The outcome depends on ids and seed alone, so reruns
and lost executors change nothing, and a hot source is spread over its bins.

Defined results: null text has size 0; a null source is a source of its own,
after all others; sources without words have target 0; documents without words
are taken once more or not like any other and take 0 words; repeated rows are
separate documents; an empty table gives no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut_lineage

#: Weights by position of the source in code-point order, repeating.
WEIGHTS = (5, 2, 1)
SEED = "mix-1"
#: Hex digits of the seeded hash that name a bin: 16**3 bins a source.
BIN_DIGITS = 3


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """``sources(source_key, source, source_size)`` -> the same with ``target``.

    One row per source goes through the two windows here."""
    ranked = sources.withColumn("rank_", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank_") % len(weights) + 1).cast("int"))
    clamp = F.col("source_size") * F.lit(float(max_epochs))
    everything = W.partitionBy()
    ranked = (ranked.withColumn("weight_", weight).withColumn("clamp_", clamp)
              .withColumn("budget_", F.sum("source_size").over(everything) * F.lit(float(share)))
              .withColumn("all_weight_", F.sum("weight_").over(everything)))
    upto = W.orderBy(F.col("clamp_") / F.col("weight_"), "rank_").rowsBetween(W.unboundedPreceding, -1)
    # the level if exactly the sources before this one were clamped
    level = ((F.col("budget_") - F.coalesce(F.sum("clamp_").over(upto), F.lit(0.0)))
             / (F.col("all_weight_") - F.coalesce(F.sum("weight_").over(upto), F.lit(0.0))))
    ranked = ranked.withColumn("level_", level)
    is_open = F.col("level_") * F.col("weight_") < F.col("clamp_")
    # the first source that stays below its clamp fixes the level for all that follow
    ranked = ranked.withColumn("level_", F.min_by(F.when(is_open, F.col("level_")),
                                                  F.when(is_open, F.col("clamp_") / F.col("weight_"))).over(everything))
    target = F.when(F.col("level_").isNull() | (F.col("level_") * F.col("weight_") >= F.col("clamp_")), F.col("clamp_")) \
        .otherwise(F.col("level_") * F.col("weight_"))
    return ranked.select("source_key", "source_size", target.alias("target"))


def placed(docs: DataFrame, keep: Sequence[str], seed: str = SEED) -> DataFrame:
    """Ids, sizes and seeded places of all documents, plus the ``keep`` columns."""
    place = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    key = F.coalesce(F.concat(F.lit("v"), F.col("source")), F.lit(""))
    return docs.select(*keep, F.col("doc_id").alias("id_"), F.col("source").alias("src_"), key.alias("source_key"),
                       n_words(F.col("text")).alias("size"), place.alias("place_"))


def mix(docs: DataFrame, keep: Sequence[str] = ("doc_id",), weights: Sequence[float] = WEIGHTS, share: float = 1.5,
        max_epochs: float = 2.0, seed: str = SEED) -> DataFrame:
    """One row per document: ``keep``, size, source_size, target, copies, taken.

    ``docs`` has doc_id, source and text. ``share``: words of the mix as a
    multiple of all words. ``max_epochs``: clamp as a multiple of a source."""
    # sizes are counted once; the rows kept here carry no text
    rows = cut_lineage(placed(docs, keep, seed)).withColumn("bin_", F.substring("place_", 1, BIN_DIGITS))
    bins = rows.groupBy("source_key", "bin_").agg(F.sum("size").alias("bin_size_"), F.first("src_").alias("src_"))
    sources = bins.groupBy("source_key").agg(F.sum("bin_size_").alias("source_size"), F.first("src_").alias("source"))
    before = W.partitionBy("source_key").orderBy("bin_").rowsBetween(W.unboundedPreceding, -1)
    starts = bins.select("source_key", "bin_", F.coalesce(F.sum("bin_size_").over(before), F.lit(0)).alias("start_"))
    plan = starts.join(fill_targets(sources, weights, share, max_epochs), "source_key")
    inside = (W.partitionBy("source_key", "bin_").orderBy("place_", "id_", "size")
              .rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = rows.join(plan, ["source_key", "bin_"])
    middle = F.col("start_") + F.sum("size").over(inside) - F.col("size") / 2
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    joined = joined.withColumn("copies", (whole + F.when(middle <= rest, 1).otherwise(0)).cast("int"))
    # a source at its clamp has nothing left over, so no document passes max_epochs
    joined = joined.withColumn("copies", F.least("copies", F.ceil(F.lit(float(max_epochs))).cast("int")))
    return joined.select(*keep, "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
