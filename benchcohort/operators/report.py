"""Report selection and chart layout over a scorecard (F2, F6-F8, A14, J5-J7,
J12, W5, W6, P24). Inputs are aggregated scorecard rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exclude_models(sc: DataFrame, exclude: Sequence[str] | None) -> DataFrame:
    """Case-insensitive NOT IN; a None list means no filter (F2)."""
    if not exclude:
        return sc
    return sc.filter(~F.lower("Model").isin([m.lower() for m in exclude]))


def include_models(sc: DataFrame, include: Sequence[str] | None) -> DataFrame:
    if not include:
        return sc
    return sc.filter(F.lower("Model").isin([m.lower() for m in include]))


def report_rows(sc: DataFrame) -> DataFrame:
    """Base rows, best, best-in-family or latest improvement; drop superseded."""
    keep = ((F.col("Improve") == "") | (F.col("Best") == 1) | (F.col("BestMeta") == 1)
            | (F.col("Improve_Last") == 1))
    superseded = (F.col("Improve") != "") & (F.col("Improve_Last") == 0)
    return sc.filter(keep & ~superseded)


def floor_filter(sc: DataFrame, down_to: str, among: DataFrame | None = None) -> DataFrame:
    """Keep rows at or above the named model's Center in the same bench (F7, J5);
    the model is looked up in ``among``, a scorecard that may have more rows."""
    floor = (sc if among is None else among).filter(F.col("Model") == down_to).select("Bench", F.col("Center").alias("Min"))
    return sc.join(floor, "Bench").filter(F.col("Center") >= F.col("Min")).drop("Min")


def showing_counts(sc: DataFrame, reference_model: str = "o3") -> DataFrame:
    """Rows at or above the lowest of (reference model, best-in-family) per
    bench, labelled '(Showing k of m models)' (A14, J6)."""
    mins = (sc.filter((F.col("Model") == reference_model) | (F.col("BestMeta") == 1))
              .groupBy("Bench").agg(F.min("Center").alias("CenterMin")))
    flagged = (sc.join(mins, "Bench")
                 .withColumn("keep", F.when(F.col("Center") >= F.col("CenterMin"), 1).otherwise(0)))
    w = Window.partitionBy("Bench")
    shown = F.sum("keep").over(w)
    total = F.count(F.lit(1)).over(w)
    label = (F.when(shown == total, F.concat(F.lit("(Showing all "), total.cast("string"), F.lit(" models)")))
              .otherwise(F.concat(F.lit("(Showing "), shown.cast("string"), F.lit(" of "),
                                  total.cast("string"), F.lit(" models)"))))
    return flagged.withColumn("Showing", label).filter(F.col("keep") == 1).drop("keep", "CenterMin")


def best_improvement(sc: DataFrame, family: str) -> DataFrame:
    """Latest improvements of one family; per (Bench, Base) the best Center,
    ties kept; percent change against the base (J7, P24)."""
    focus = sc.filter(F.col("Model").contains(family) & (F.col("Improve_Last") == 1))
    w = Window.partitionBy("Bench", "Base")
    pct = F.try_divide(F.lit(100.0) * (F.col("Center") - F.col("Center_Base")), F.col("Center_Base"))
    return (focus.withColumn("_max", F.max("Center").over(w))
                 .filter(F.col("Center") == F.col("_max")).drop("_max")
                 .withColumn("Improve_Pct", F.when(F.col("Center_Base") == 0, None).otherwise(pct)))


@dataclass(frozen=True)
class ReportOptions:
    """What a report shows; None switches a filter off.

    ``bench``: patterns of benches; ``down_to``: a model whose Center is the floor of each
    bench, which takes the place of the bench and improvement rules; ``improvements``:
    Regular (no rule), All, Better or Worse; ``last_only``: without superseded
    improvements; ``top_only``: rows down to the reference model or the best of the family."""
    exclude: Sequence[str] | None = None
    bench: Sequence[str] | None = None
    down_to: str | None = None
    improvements: str = "All"
    last_only: bool = True
    include: Sequence[str] | None = None
    top_only: bool = True
    reference_model: str = "o3"


def bench_filter(sc: DataFrame, patterns: Sequence[str] | None) -> DataFrame:
    """Benches that any of the patterns occurs in."""
    return sc.filter(F.col("Bench").rlike("|".join(patterns))) if patterns else sc


def selected_rows(sc: DataFrame, options: ReportOptions) -> DataFrame:
    """The report's rows: exclusions, then either the floor or the bench and improvement
    rules, then superseded improvements and inclusions (F2, F3, F6-F8)."""
    rows = exclude_models(sc, options.exclude)
    if options.down_to is not None:
        rows = floor_filter(rows, options.down_to, sc)
    else:
        rows = bench_filter(rows, options.bench)
        if options.improvements != "Regular":
            rows = rows.filter((F.col("Improve") == "") | (F.col("Best") == 1) | (F.col("BestMeta") == 1) | (F.col("Improve_Last") == 1))
    if options.last_only:
        rows = rows.filter(~((F.col("Improve") != "") & (F.col("Improve_Last") == 0)))
    return include_models(rows, options.include)


CHART_COLUMNS = ("L95", "U95", "limits_not_ci", "Best", "Worse", "BestMeta", "Improve", "Center_Best")


def report_layout(sc: DataFrame, options: ReportOptions) -> DataFrame:
    """The default report as a chart-ready table (K3): selected rows, how many of each bench
    they are, positions, and everything that is drawn of a row."""
    rows = selected_rows(sc, options)
    if options.top_only:
        rows = showing_counts(rows, options.reference_model)
    else:
        rows = rows.withColumn("Showing", F.lit(None).cast("string"))
    return chart_layout(rows, CHART_COLUMNS, on_headers=("Showing",))


def overlay_markers(layout: DataFrame, sc: DataFrame, options: ReportOptions, best_only: bool = False) -> DataFrame:
    """Improvements on the rows of their base models (J12): all, or only those that are
    Better or Worse; with ``best_only`` the highest of each row, ties kept (J7)."""
    shown = sc.filter(F.col("Progress").isNotNull())
    if options.improvements in ("Better", "Worse"):
        shown = shown.filter(F.col("Progress") == options.improvements)
    if options.last_only:
        shown = shown.filter(F.col("Improve_Last") == 1)
    shown = shown.select("Bench", F.col("Base").alias("Model"), "Center", "Progress", "Improve_Label")
    out = layout.select("Bench", "Model", "y").join(shown, ["Bench", "Model"])
    if best_only:
        top = F.max("Center").over(Window.partitionBy("Bench", "Model"))
        out = out.withColumn("_top", top).filter(F.col("Center") == F.col("_top")).drop("_top")
    return out


def chart_layout(rows: DataFrame, carry: Sequence[str] = (), on_headers: Sequence[str] = ()) -> DataFrame:
    """Row positions for a chart: one header row per bench, then the bench's
    rows by Center; y counts down from the top (W5, K3). ``carry``: more columns
    of the rows; ``on_headers``: columns that are the same for a bench, shown on its
    header row alone.

    No global window over rows: bench sizes are aggregated first, the
    running offset is a window over one row per bench, and row numbers are
    assigned inside each bench partition.
    """
    sizes = rows.groupBy("Bench").agg(F.count(F.lit(1)).alias("cnt"), *[F.max(n).alias(n) for n in on_headers])
    running = Window.orderBy("Bench").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    offsets = (sizes.withColumn("off", F.sum(F.col("cnt") + 1).over(running) - (F.col("cnt") + 1))
                    .withColumn("total", F.sum(F.col("cnt") + 1).over(everything))
                    .select("Bench", "off", "total", *on_headers))
    types = dict(rows.dtypes)
    empty = lambda names: [F.lit(None).cast(types[n]).alias(n) for n in names]
    headers = offsets.select("Bench", F.lit(None).cast("string").alias("Model"),
                             F.lit(None).cast("double").alias("Center"), F.lit(1).alias("is_header"),
                             (F.col("total") - 1 - F.col("off")).cast("bigint").alias("y"), *empty(carry), *on_headers)
    in_bench = Window.partitionBy("Bench").orderBy(F.col("Center").desc_nulls_last(), F.col("Model"))
    body = (rows.select("Bench", "Model", "Center", *carry)
                .withColumn("i", F.row_number().over(in_bench))
                .join(offsets.drop(*on_headers), "Bench")
                .select("Bench", "Model", "Center", F.lit(0).alias("is_header"),
                        (F.col("total") - 1 - (F.col("off") + F.col("i"))).cast("bigint").alias("y"), *carry, *empty(on_headers)))
    return headers.unionByName(body)


def chart_layout_single(sc: DataFrame, model: str) -> DataFrame:
    """One model across benches: y = 1..n by ascending Center, plus one
    header row named after the model (W6)."""
    one = include_models(sc, [model]).select("Bench", "Model", "Center")
    w = Window.orderBy("Center", "Bench")  # one row per bench: bounded by the bench count
    body = one.withColumn("y", F.row_number().over(w).cast("bigint"))
    header = (one.groupBy().agg(F.min("Model").alias("Bench"), F.count(F.lit(1)).alias("cnt"))
                 .filter(F.col("cnt") > 0)
                 .select("Bench", F.lit(None).cast("string").alias("Model"),
                         F.lit(None).cast("double").alias("Center"), (F.col("cnt") + 1).cast("bigint").alias("y")))
    return body.unionByName(header)


def chart_overlay(layout: DataFrame, sc: DataFrame) -> DataFrame:
    """Improvement markers placed on their base model's row."""
    overlay = (sc.filter(F.col("Progress").isNotNull() & (F.col("Improve_Last") == 1))
                 .select("Bench", F.col("Base").alias("Model"), "Center", "Progress", "Improve_Label"))
    return layout.select("Bench", "Model", "y").join(overlay, ["Bench", "Model"])
