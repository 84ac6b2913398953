"""Descriptive statistics: exact quantiles at scale, 9-field summaries and
stat records (A4, A12, A16, F3-F5, F10, U5).

Exact quantiles are found by repeated histogram refinement: a pass counts
the values of each group by bins, the bins that hold the wanted ranks are the
next pass's range, and when few values are left in them those are counted one
by one. Counting combines in each task before its shuffle, so tied values
cost one count however many there are; nothing is sorted but the bins, and no
value column is shuffled or written.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exact import fixed_moments, mean_from_moments
from ..session import cut_lineage

SMALL_SIDE_BYTES = 32 << 20  # measured bytes under which a helper table is broadcast
LOG_BINS = 64  # bins of the first pass for each factor of e
BINS = 4096  # bins of a range in later passes
FEW = 20_000  # values in a range from which they are counted one by one


def table_bytes(df: DataFrame) -> int:
    """Size of the table's rows: the bytes of its strings and 8 for each other value."""
    strings = [F.coalesce(F.octet_length(F.col(f"`{n}`")), F.lit(0)) for n, t in df.dtypes if t == "string"]
    row = sum(strings, F.lit(16 + 8 * (len(df.columns) - len(strings))))
    return df.agg(F.sum(row)).first()[0] or 0


def checked_broadcast(df: DataFrame, most: int = SMALL_SIDE_BYTES) -> DataFrame:
    """Broadcast a helper table only after measuring it; otherwise leave the
    join strategy to AQE."""
    return F.broadcast(df) if table_bytes(df) <= most else df


def _first_bins(v: Column) -> Column:
    """Bins of equal width in the logarithm, in the order of the values (Java's log is monotonic)."""
    size = F.floor(F.log(F.abs(v)) * LOG_BINS) + F.lit(1 << 20)
    return F.when(F.isnan(v), F.lit(1 << 30)).when(v == 0, F.lit(0)).when(v > 0, F.when(v == float("inf"), F.lit(1 << 29)).otherwise(size)) \
        .otherwise(F.when(v == float("-inf"), F.lit(-(1 << 29))).otherwise(-size)).cast("bigint")


def _chosen(bins: DataFrame, targets: DataFrame) -> DataFrame:
    """The bin that holds each target's rank: (g, lo, rank, at, vlo, vhi, cnt), ``rank`` counted in the range."""
    earlier = Window.partitionBy("g", "lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("cnt").over(earlier), F.lit(0)))
    at = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("cnt"))
    return (targets.join(bins, (targets["g"].eqNullSafe(bins["g"])) & (targets["lo"].eqNullSafe(bins["lo"])))
            .filter(at).select(targets["g"], "asked", (F.col("rank") - F.col("before")).alias("rank"), "vlo", "vhi", "cnt"))


def values_at_ranks(d: DataFrame, ranks: DataFrame, first: DataFrame) -> DataFrame:
    """The values at the wanted 0-based ranks of each group, by refinement.

    ``d(g, v)`` are the rows, ``ranks(g, asked)`` the ranks, ``first(g, bin, cnt, vlo, vhi)``
    the counts of the first pass. Each further pass reads ``d`` once."""
    no_range = F.lit(None).cast("double").alias("lo")
    open_ = _chosen(first.select("g", no_range, "bin", "cnt", "vlo", "vhi"),
                    ranks.select("g", no_range, "asked", F.col("asked").alias("rank")))
    found = None
    while True:
        open_ = cut_lineage(open_)
        done = open_.filter("vlo = vhi").select("g", "asked", F.col("vlo").alias("v"))
        found = done if found is None else found.unionByName(done)
        open_ = open_.filter("vlo <> vhi")
        most = open_.agg(F.max("cnt")).first()[0]
        if most is None:
            return found
        ranges = checked_broadcast(open_.select("g", F.col("vlo").alias("lo"), F.col("vhi").alias("hi")).distinct())
        inside = d.join(ranges, d["g"].eqNullSafe(ranges["g"]) & d["v"].between(ranges["lo"], ranges["hi"])) \
            .select(d["g"], "v", "lo", "hi")
        if most <= FEW:  # so few values are their own bins
            place = F.col("v")
        else:
            width = F.col("hi") / 2 - F.col("lo") / 2  # halves: a difference could overflow
            place = F.when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1)).cast("double")) \
                .otherwise(F.col("v"))
        bins = inside.groupBy("g", "lo", place.alias("bin")).agg(
            F.count(F.lit(1)).alias("cnt"), F.min("v").alias("vlo"), F.max("v").alias("vhi"))
        open_ = _chosen(bins, open_.select("g", F.col("vlo").alias("lo"), "asked", "rank"))


def exact_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Type-7 quantiles per group: q = x[lo] + (x[hi] - x[lo]) * frac with
    h = (n - 1) p, lo = floor(h), hi = ceil(h) (0-based ranks). Nulls are left
    out; NaN comes last, as in Spark's order."""
    d = df.select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull())
    d = d.withColumn("v", F.when(F.col("v") == 0, F.lit(0.0)).otherwise(F.col("v")))  # one zero
    # groups x bins rows at most: 64 bins for each factor of e that the values span
    first = cut_lineage(d.groupBy("g", _first_bins(F.col("v")).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min("v").alias("vlo"), F.max("v").alias("vhi")))
    sizes = first.groupBy("g").agg(F.sum("cnt").alias("n"))
    targets = sizes.select("g", "n", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"))
    targets = (targets.withColumn("h", (F.col("n") - 1) * F.col("p"))
                      .withColumn("lo", F.floor("h").cast("bigint")).withColumn("hi", F.ceil("h").cast("bigint"))
                      .withColumn("frac", F.col("h") - F.col("lo")))
    targets = cut_lineage(targets)
    values = values_at_ranks(d, targets.select("g", F.explode(F.array("lo", "hi")).alias("asked")).distinct(), first)
    side = lambda x: values.select(F.col("g").alias(f"g_{x}"), F.col("asked").alias(f"at_{x}"), F.col("v").alias(f"v_{x}"))
    on = lambda x: F.col("g").eqNullSafe(F.col(f"g_{x}")) & (F.col(x) == F.col(f"at_{x}"))
    out = targets.join(side("lo"), on("lo")).join(side("hi"), on("hi"))
    same = F.col("v_lo") == F.col("v_hi")  # also infinite ones
    return out.select(F.col("g").alias(group), "n", "p",
                      F.when(same, F.col("v_lo")).otherwise(F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")).alias("q"))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str],
                descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Inclusive running sums of ``values`` within each ``keys`` group in
    ``order`` — without a window holding a whole group.

    Rows are range-partitioned by (keys, order), so a large group spans many
    partitions. Running sums are taken inside each (partition, group) block,
    block totals are offset by the totals of the group's earlier blocks (a
    small table: partitions x groups), and the offset is added back. ``order``
    values must be unique within a group (e.g. after aggregating by it).
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    o = F.col(order).desc() if descending else F.col(order).asc()
    ranged = cut_lineage(df.repartitionByRange(parts, *[F.col(k) for k in keys], o)
                           .withColumn("_pid", F.spark_partition_id()))
    inside = Window.partitionBy("_pid", *keys).orderBy(o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.select("*", *[F.sum(v).over(inside).alias(f"_in_{v}") for v in values])
    blocks = ranged.groupBy("_pid", *keys).agg(*[F.sum(v).alias(f"_blk_{v}") for v in values])
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    blocks = cut_lineage(blocks.select("_pid", *keys, *[
        F.coalesce(F.sum(f"_blk_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values]))
    out = ranged.join(checked_broadcast(blocks), ["_pid", *keys])
    return out.select(*df.columns, *[(F.col(f"_off_{v}") + F.col(f"_in_{v}")).alias(f"cum_{v}") for v in values])


def summary_record(x: Column, scale: int = 2) -> list[Column]:
    """count, sum, sum_squared, min, max, mean, variance, stddev (population),
    sums exact at 10^-scale resolution (A16)."""
    m = fixed_moments(x, "_m", scale)
    return m + [F.min(x).alias("min"), F.max(x).alias("max")]


def finish_summary(df: DataFrame, keys: Sequence[str], scale: int = 2) -> DataFrame:
    q = float(10 ** scale)
    n, s1, s2 = F.col("_m_n"), F.col("_m_s1"), F.col("_m_s2")
    mean = mean_from_moments(n, s1, scale)
    var = F.greatest((s2 / n - (s1 / n) * (s1 / n)) / F.lit(q * q), F.lit(0.0))
    return df.select(*keys, n.alias("count"), (s1 / q).alias("sum"), (s2 / (q * q)).alias("sum_squared"),
                     "min", "max", mean.alias("mean"), var.alias("variance"), F.sqrt(var).alias("stddev"))


def stat_records(items: DataFrame, keys: Sequence[str], metrics: dict[str, Column],
                 perturbation: Column | None, scale: int = 2) -> DataFrame:
    """Stat records shaped like the benchmark's stats files: one record per
    (keys, metric, perturbation) with a nested ``name`` struct."""
    pert = perturbation if perturbation is not None else F.lit(None).cast("string")
    stacked = items.select(*keys, pert.alias("_pert"), F.explode(F.array(*[
        F.struct(F.lit(name).alias("metric"), expr.cast("double").alias("x")) for name, expr in metrics.items()
    ])).alias("_s")).select(*keys, "_pert", "_s.metric", "_s.x")
    agg = stacked.groupBy(*keys, "metric", "_pert").agg(*summary_record(F.col("x"), scale))
    rec = finish_summary(agg, list(keys) + ["metric", "_pert"], scale)
    pstruct = F.when(F.col("_pert").isNull(), F.lit(None)).otherwise(F.struct(
        F.col("_pert").alias("name"), (F.col("_pert") == "robustness").alias("robustness"),
        (F.col("_pert") == "fairness").alias("fairness"), F.lit("worst").alias("computed_on")))
    name = F.struct(F.col("metric").alias("name"), F.lit("test").alias("split"), pstruct.alias("perturbation"))
    return rec.select(*keys, name.alias("name"), "count", "sum", "sum_squared", "min", "max", "mean",
                      "variance", "stddev")


def best_stat(records: DataFrame, keys: Sequence[str], metric_pattern: str = "exact_match|accuracy",
              perturbation: str = "robustness") -> DataFrame:
    """max(mean) over records whose metric name matches AND whose
    perturbation is the named one; groups with no match give null (A4)."""
    hit = F.col("name.name").rlike(metric_pattern) & (F.col("name.perturbation.name") == perturbation)
    return records.groupBy(*keys).agg(F.max(F.when(hit & F.col("mean").isNotNull(), F.col("mean"))).alias("val"),
                                      F.sum(F.when(hit, 1).otherwise(0)).alias("n_matched"))
