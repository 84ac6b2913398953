"""Bootstrap intervals as Spark aggregates.

Draws come from :mod:`benchcohort.functions.hashing` and
:mod:`benchcohort.functions.sampling`, so results depend only on (seed,
replicate, cell) and never on partitioning or task retries.

The units of a group are first collapsed to cells: a value and how many units
have it (null is a value too). A replicate mean needs only how often each cell
is drawn.

* **Multinomial (B1)** — exactly n draws with replacement per replicate, as
  the reference's ``sample(x, replace=TRUE)``. Values that at least ``LEAF``
  units share, and null, are leaves of their own; the other cells are dealt in
  order into leaves of at most 2 LEAF units. The n draws fall onto the leaves
  by conditional binomial draws along the binary digits of the leaf numbers,
  one draw for each pair of halves, whatever n is. A leaf of one value needs no
  more; within a leaf of several, each draw picks a unit.
* **Poisson (B2)** — every unit has an independent Poisson(1) weight per
  replicate, so a cell of c units has one Poisson(c) weight; the replicate mean
  is sum(w x) / sum(w).

So few-valued scores cost cells x R draws however many units there are, and no
unit is joined or copied R times by either. A task holds a group's leaves (one
for LEAF / 2 units at most) or the cells of a leaf.

Poisson weights are drawn in numpy, an array of units and replicates at a time
(:mod:`benchcohort.functions.draws`); a task adds them up, by cells and by units.

``form="rows"`` draws unit by unit instead: for B1, n x R draw rows joined to
the numbered units; for B2, a weight for each unit and replicate. The caller
names method and form; neither depends on the data's size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import draws
from ..functions.hashing import h, stream
from ..session import cut_lineage
from .stats import prefix_sums

PROBS = (0.5, 0.025, 0.975)
METHODS = ("multinomial", "poisson")
FORMS = ("cells", "rows")
LEAF = 32  # units from which a value is a leaf of its own
REPLICATE_BLOCK = 50  # replicates of a group that one row stands for until they are drawn
DRAW_BLOCK = 100_000  # draws of a replicate that one exploded row stands for


def _replicate_quantiles(reps: DataFrame, keys: Sequence[str], stat: str) -> DataFrame:
    """Type-7 percentiles of R replicate statistics per group: the R values
    of a group (bounded by R) are sorted once and the quantiles are read by
    position with linear interpolation."""
    vals = F.sort_array(F.collect_list(F.col(stat)))

    def q(p: float):
        h = (F.size("_v") - 1) * F.lit(p)
        lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
        v_lo, v_hi = F.get("_v", lo), F.get("_v", hi)  # null for a group without any replicate mean
        return v_lo + (v_hi - v_lo) * (h - lo)

    return (reps.groupBy(*keys).agg(vals.alias("_v"))
                .select(*keys, q(PROBS[0]).alias("Median"), q(PROBS[1]).alias("L95"), q(PROBS[2]).alias("U95"),
                        F.size("_v").cast("bigint").alias("R_used")))


def multinomial_replicates(units: DataFrame, keys: Sequence[str], order_key: str, value: str,
                           R: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Replicate means by exact resampling (B1), and the numbered units.

    Units are numbered 0..n-1 inside their group by ``order_key``; replicate
    r draws index pmod(stream(h(seed, r), k), n) for k = 0..n-1 (the draw
    depends on (r, k) only, as the reference re-seeds per group). A replicate's
    draws are dealt out in blocks of ``DRAW_BLOCK`` and joined back on (group,
    index), which spreads a hot group over many tasks.
    """
    numbered = prefix_sums(units.select(*keys, order_key, value).withColumn("_one", F.lit(1).cast("bigint")),
                           keys, order_key, ["_one"])
    indexed = cut_lineage(numbered.select(*keys, value, (F.col("cum__one") - 1).alias("_idx")))
    sizes = indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blocks = (sizes.select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(R - 1))).alias("r"))
                   .withColumn("_base", h(seed, F.col("r")))
                   .select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / DRAW_BLOCK))).alias("_b"))
                   .repartition(*keys, "r", "_b"))
    first = F.col("_b") * DRAW_BLOCK
    drawn = blocks.select(*keys, "r", "_base", "_n",
                          F.explode(F.sequence(first, F.least(first + DRAW_BLOCK, F.col("_n")) - 1)).alias("_k"))
    drawn = drawn.select(*keys, "r", F.pmod(stream(F.col("_base"), F.col("_k")), F.col("_n")).alias("_idx"))
    # Spark sizes an explode like its input, so the n * R draw rows look tiny to
    # the planner; the unit side is the one to hash.
    joined = drawn.join(indexed.hint("shuffle_hash"), list(keys) + ["_idx"])
    return joined.groupBy(*keys, "r").agg(F.avg(value).alias("rep_mean")), indexed


def poisson_replicates(units: DataFrame, keys: Sequence[str], unit_key: Sequence[Column], value: Column,
                       R: int, seed: int, scale: int = 1) -> DataFrame:
    """Replicate means by Poisson(1) weights (B2): each unit draws its weight in each replicate.

    ``value`` should be integral (e.g. cents) so sums are exact and
    order-independent; ``scale`` divides the result back."""
    base = units.select(*keys, h(seed, *unit_key).alias("_h"), value.cast("double").alias("_x"), F.lit(None).cast("bigint").alias("_c"))
    sums = _weighted_sums(base, keys, R)
    return sums.select(*keys, "r", (F.try_divide(F.col("s"), F.col("n")) / F.lit(float(scale))).alias("rep_mean"))


UNIT_BLOCK = 1024  # units whose weights in a few replicates are drawn at once: their streams stay in a core's cache
WEIGHT_BLOCK = 50  # replicates drawn at once
MOST_GROUPS = 500  # groups that a task adds up before it hands them on


def _add_weighted(h0: np.ndarray, x: np.ndarray, c: np.ndarray | None, R: int) -> np.ndarray:
    """R x 2: sums of w x and of w over the units of a group. Without counts ``c`` a unit draws a Poisson(1)
    weight; with them it is a cell, and draws the weight of c units."""
    out = np.zeros((R, 2))
    if c is not None:  # cells of one size side by side
        order = np.argsort(c, kind="stable")
        h0, x, c = h0[order], x[order], c[order]
    both = np.stack([x, np.ones_like(x)], axis=1)
    for u in range(0, len(x), UNIT_BLOCK):
        some = slice(u, u + UNIT_BLOCK)
        for r in range(0, R, WEIGHT_BLOCK):
            own = draws.stream(h0[some][None, :], np.arange(r, min(r + WEIGHT_BLOCK, R))[:, None])
            w = draws.poisson1(own).astype(float) if c is None else draws.poisson(c[some], own)
            out[r:r + WEIGHT_BLOCK] += w @ both[some]
    return out


def _weighted_sums(rows: DataFrame, keys: Sequence[str], R: int) -> DataFrame:
    """(keys, r, s, n): sums of w x (null if no x is known) and of w, for rows (keys, _h, _x, _c); ``_h`` is
    a row's stream. A task adds up its rows by group; nothing is copied for each replicate."""
    keys = list(keys)

    def handed_on(held):
        for key, (sums, known) in held.items():
            yield pa.RecordBatch.from_pydict({**{k: [v] for k, v in zip(keys, key)}, "_known": [known],
                                              "_s": [sums[:, 0].tolist()], "_w": [sums[:, 1].tolist()]}, schema=schema)

    def add(batches):
        held: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            codes = np.zeros(b.num_rows, dtype=np.int64) if not keys else \
                b.select(keys).to_pandas().groupby(keys, dropna=False, sort=False).ngroup().to_numpy()
            order = np.argsort(codes, kind="stable")
            bounds = [0, *(np.flatnonzero(np.diff(codes[order])) + 1), len(order)]
            h0 = b.column("_h").to_numpy(zero_copy_only=False).astype(np.uint32)
            x = b.column("_x").fill_null(0.0).to_numpy(zero_copy_only=False)
            valid = b.column("_x").is_valid().to_numpy(zero_copy_only=False)
            cells = b.column("_c").null_count < b.num_rows
            c = b.column("_c").to_numpy(zero_copy_only=False) if cells else None
            for i, j in zip(bounds, bounds[1:]):
                at = order[i:j]
                key = tuple(b.column(k)[int(at[0])].as_py() for k in keys)
                sums, known = held.get(key, (0.0, False))
                held[key] = (sums + _add_weighted(h0[at], x[at], c[at] if cells else None, R), known or bool(valid[at].any()))
            if len(held) > MOST_GROUPS:
                yield from handed_on(held)
                held = {}
        yield from handed_on(held)

    kinds = T.StructType([rows.schema[k] for k in keys] + [T.StructField("_known", T.BooleanType()), *[
        T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("_s", "_w")]])
    schema = to_arrow_schema(kinds)
    parts = rows.mapInArrow(add, kinds).select(*keys, "_known", F.posexplode(F.arrays_zip("_s", "_w")).alias("r", "x"))
    return (parts.groupBy(*keys, "r").agg(F.when(F.max("_known"), F.sum("x._s")).alias("s"), F.sum("x._w").alias("n")))


def _tasks(df: DataFrame) -> int:
    """Tasks for rows of few bytes and much work, which AQE would put into one."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def cells_of(units: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, c): how many units of a group have each value; null is one of them."""
    return units.groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))


def leaves_of(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, leaf, w, m, cells): a group's leaves, numbered from 0 in the order of their values.

    A cell's leaf is the LEAF units of the group, in order of value, that its first
    unit lies in, or the cell itself if it has that many or is null."""
    numbered = prefix_sums(cells, keys, "v", ["c"])
    alone = F.when(F.col("v").isNull(), 2).when(F.col("c") >= LEAF, 1).otherwise(0)
    leaves = (numbered.withColumn("slot", F.floor((F.col("cum_c") - F.col("c")) / LEAF)).withColumn("alone", alone)
              .groupBy(*keys, "slot", "alone")
              .agg(F.sum("c").alias("w"), F.count(F.lit(1)).alias("m"), F.sort_array(F.collect_list(F.struct("v", "c"))).alias("cells")))
    # null sorts first: its slot is the first one, before that slot's other leaves
    order = F.when(F.col("alone") == 2, -1).otherwise(F.col("slot") * 2 + F.col("alone"))
    return leaves.select(*keys, order.alias("place"), "w", "m", "cells")


def _bases(seed: int, block: int, size: int, R: int) -> np.ndarray:
    """The streams of a block's replicates, as ``h(seed, r)`` gives them."""
    return np.array([int(hashlib.md5(f"{seed}:{r}".encode()).hexdigest()[:8], 16)
                     for r in range(block * size, min((block + 1) * size, R))], dtype=np.uint32)


def _leaf_draws(keys: Sequence[str], R: int, seed: int, size: int, schema: pa.Schema):
    """Draws of a block of replicates of a group, for each of its rows (keys, leaves, block): a row for each leaf of
    several values with how often each replicate draws from it, and one (without a place) with what the others add up to."""
    def draw(batches):
        for b in batches:
            leaves, blocks = b.column("leaves"), b.column("block").to_pylist()
            at, cells = leaves.offsets.to_numpy(), leaves.values
            place, w = cells.field("place").to_pylist(), cells.field("w").to_numpy()
            single = cells.field("single").to_numpy(zero_copy_only=False)
            known = single & cells.field("v").is_valid().to_numpy(zero_copy_only=False)
            v = cells.field("v").fill_null(0.0).to_numpy(zero_copy_only=False)
            for row, block in enumerate(blocks):
                own = slice(at[row], at[row + 1])
                k = draws.multinomial(w[own], _bases(seed, block, size, R))
                some, several = k[:, known[own]], np.flatnonzero(~single[own])
                sums = np.where(some > 0, some * v[own][known[own]], 0.0).sum(axis=1)
                n = len(several)
                out = {x: [b.column(x)[row].as_py()] * (n + 1) for x in keys}
                yield pa.RecordBatch.from_pydict({
                    **out, "block": [block] * (n + 1), "place": [place[at[row] + i] for i in several] + [None],
                    "i": [*several.tolist(), None], "k": [*k[:, several].T.astype(np.int64).tolist(), None],
                    "s": [None] * n + [sums.tolist()], "n": [None] * n + [some.sum(axis=1).tolist()]}, schema=schema)
    return draw


def _leaf_sums(keys: Sequence[str], R: int, seed: int, size: int, schema: pa.Schema):
    """Sums of the units that replicates draw within leaves of several values, added up by group and block."""
    def handed_on(held):
        for (*key, block), (s, n) in held.items():
            yield pa.RecordBatch.from_pydict({**{x: [v] for x, v in zip(keys, key)}, "block": [block], "s": [s.tolist()], "n": [n.tolist()]},
                                             schema=schema)

    def add(batches):
        held, bases = {}, {}
        for b in batches:
            ks, values = b.column("k"), b.column("values")
            ka, kv, va, vv = ks.offsets.to_numpy(), ks.values.to_numpy(), values.offsets.to_numpy(), values.values.to_numpy()
            names = zip(*[b.column(x).to_pylist() for x in [*keys, "block"]])
            for row, (key, i) in enumerate(zip(names, b.column("i").to_pylist())):
                if key[-1] not in bases:
                    bases[key[-1]] = _bases(seed, key[-1], size, R)
                k = kv[ka[row]:ka[row + 1]]
                s, n = held.get(key, (0.0, 0.0))
                held[key] = (s + draws.picked_sums(vv[va[row]:va[row + 1]], k, bases[key[-1]], i), n + k.astype(float))
            if len(held) * size > MOST_GROUPS * 1000:
                yield from handed_on(held)
                held = {}
        yield from handed_on(held)
    return add


def multinomial_cells(units: DataFrame, keys: Sequence[str], value: str, R: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Replicate means by exact resampling of cells (B1), and the cells."""
    keys = list(keys)
    cells = cut_lineage(cells_of(units, keys, value))
    leaves = cut_lineage(leaves_of(cells, keys))
    # one row a group: its leaves, without the cells of those that have several
    one = F.struct("place", "w", F.when(F.col("m") == 1, F.col("cells")[0]["v"]).alias("v"), (F.col("m") == 1).alias("single"))
    groups = leaves.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("leaves"))
    size = REPLICATE_BLOCK
    blocks = (groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((R - 1) // size)))).repartition(_tasks(units), *keys, "block"))
    own = [groups.schema[x] for x in keys] + [T.StructField("block", T.IntegerType())]
    sums = [T.StructField(x, T.ArrayType(T.DoubleType())) for x in ("s", "n")]
    kinds = T.StructType([*own, leaves.schema["place"], T.StructField("i", T.LongType()), T.StructField("k", T.ArrayType(T.LongType())), *sums])
    drawn = cut_lineage(blocks.mapInArrow(_leaf_draws(keys, R, seed, size, to_arrow_schema(kinds)), kinds))
    # draws within leaves of several values: a block's replicates of a leaf meet its units in one row
    inside = F.flatten(F.transform("cells", lambda x: F.array_repeat(x["v"], x["c"].cast("int"))))
    held = (drawn.filter("place IS NOT NULL").select(*keys, "block", "place", "i", "k")
            .join(leaves.filter("m > 1").select(*keys, "place", inside.alias("values")), [*keys, "place"]))
    kinds = T.StructType([*own, *sums])
    parts = held.select(*keys, "block", "i", "k", "values").mapInArrow(_leaf_sums(keys, R, seed, size, to_arrow_schema(kinds)), kinds)
    total = (drawn.filter("place IS NULL").select(*keys, "block", "s", "n").unionByName(parts)
             .select(*keys, "block", F.posexplode(F.arrays_zip("s", "n")).alias("at", "x"))
             .groupBy(*keys, (F.col("block") * size + F.col("at")).alias("r")).agg(F.sum("x.s").alias("s"), F.sum("x.n").alias("n")))
    return total.select(*keys, "r", F.try_divide("s", "n").alias("rep_mean")), cells


def poisson_cells(units: DataFrame, keys: Sequence[str], value: str, R: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Replicate means by a Poisson(c) weight for each cell of c units (B2), and the cells."""
    keys = list(keys)
    cells = cut_lineage(cells_of(units, keys, value))
    base = h(seed, *[F.coalesce(F.col(k).cast("string"), F.lit("NA")) for k in keys], F.col("v").cast("decimal(38,6)"))
    rows = cells.filter("v IS NOT NULL").select(*keys, base.alias("_h"), F.col("v").alias("_x"), F.col("c").alias("_c"))
    total = _weighted_sums(rows.repartition(_tasks(units), *keys, "_x"), keys, R)
    return total.select(*keys, "r", F.try_divide("s", "n").alias("rep_mean")), cells


def _replicates(units: DataFrame, keys: Sequence[str], order_key: str, value: str, R: int, seed: int, method: str,
                form: str) -> tuple[DataFrame, DataFrame, str, Column]:
    """Replicate means by the named method and form; and materialised units or
    cells with their value column and weight, for the point estimate."""
    if method not in METHODS or form not in FORMS:
        raise ValueError(f"method must be one of {METHODS} and form one of {FORMS}")
    if form == "cells":
        reps, cells = (multinomial_cells if method == "multinomial" else poisson_cells)(units, keys, value, R, seed)
        return reps, cells, "v", F.col("c")
    if method == "multinomial":
        return *multinomial_replicates(units, keys, order_key, value, R, seed), value, F.lit(1)
    base = cut_lineage(units.select(*keys, order_key, value))
    reps = poisson_replicates(base.filter(F.col(value).isNotNull()), keys, [F.col(order_key)], F.col(value), R, seed)
    return reps, base, value, F.lit(1)


def bootstrap_distribution(units: DataFrame, keys: Sequence[str], order_key: str, value: str,
                           R: int, seed: int, method: str = "multinomial", form: str = "cells") -> DataFrame:
    """n = non-null count, Center = median of replicate means, 2.5/97.5 %
    limits. Nulls stay in the resampling population and are ignored in each
    replicate mean (the reference's ``mean(sample(x), na.rm=TRUE)``)."""
    reps, base, v, weight = _replicates(units, keys, order_key, value, R, seed, method, form)
    q = _replicate_quantiles(reps, keys, "rep_mean")
    n = base.groupBy(*keys).agg(F.coalesce(F.sum(F.when(F.col(v).isNotNull(), weight)), F.lit(0)).cast("bigint").alias("n"))
    return (n.join(q, list(keys))
             .select(*keys, "n", F.col("Median").alias("Center"), "L95", "U95"))


def bootstrap_mean_ci(units: DataFrame, keys: Sequence[str], order_key: str, value: str,
                      R: int, seed: int, method: str = "multinomial", form: str = "cells") -> DataFrame:
    """Nulls dropped first; Center = plain mean, limits from R replicate
    means; returns mean, lcl, ucl, n, R, seed."""
    clean = units.select(*keys, order_key, value).filter(F.col(value).isNotNull())
    reps, base, v, weight = _replicates(clean, keys, order_key, value, R, seed, method, form)
    q = _replicate_quantiles(reps, keys, "rep_mean")
    n = F.sum(weight).cast("bigint")
    point = base.groupBy(*keys).agg((F.sum(F.col(v) * weight) / n).alias("mean"), n.alias("n"))
    return (point.join(q, list(keys))
                 .select(*keys, "mean", F.col("L95").alias("lcl"), F.col("U95").alias("ucl"), "n",
                         F.lit(R).alias("R"), F.lit(seed).alias("seed")))


def poisson_summary(units: DataFrame, keys: Sequence[str], value: str, R: int, seed: int) -> DataFrame:
    """B2 on cells with its point estimate: n, mean, median and limits of the replicate means."""
    reps, cells = poisson_cells(units, keys, value, R, seed)
    n = F.sum(F.when(F.col("v").isNotNull(), F.col("c")))
    point = cells.groupBy(*keys).agg(n.alias("n"), (F.sum(F.col("v") * F.col("c")) / n).alias("mean"))
    return point.join(_replicate_quantiles(reps, keys, "rep_mean"), list(keys))


def poisson_units_summary(units: DataFrame, keys: Sequence[str], unit_key: Sequence[Column], value: Column, R: int, seed: int,
                          scale: int = 1) -> DataFrame:
    """B2 unit by unit with its point estimate. Units without a value count in n and in the weights."""
    reps = poisson_replicates(units, keys, unit_key, value, R, seed, scale)
    n = F.count(F.lit(1))
    point = units.select(*keys, value.alias("_x")).groupBy(*keys).agg(n.alias("n"), (F.sum("_x") / n / F.lit(float(scale))).alias("mean"))
    return point.join(_replicate_quantiles(reps, keys, "rep_mean"), list(keys))
