"""File sources and sinks on small fixtures written to a fresh folder."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from benchcohort.sources import files


def test_code_lists_from_text_lines(spark):
    folder = tempfile.mkdtemp(prefix="bc-text-")
    path = os.path.join(folder, "defs.txt")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("\n".join([
            "var ari = RX(rxcui='123', '456')",
            'var  x=rx( "789" ,\'123\')',
            "// var commented = rx('1')",
            "var y = DX('1')",
            "var z = rx ('55', '55')",
        ]) + "\n")
    got = sorted(tuple(r) for r in files.code_lists(spark.read.text(path)).collect())
    assert got == [("ari", "123"), ("ari", "456"), ("x", "123"), ("x", "789"), ("z", "55")]


def test_source_label_from_file_names(spark):
    names = ["/d/data_processed_northwind_sz_last5y.csv.gz", "/d/data_processed_acme_bp1.csv",
             "/d/data_processed_customer/part-00000.csv.gz"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    got = [r[0] for r in df.select(files.source_label(F.col("p"), {"Northwind": "N", "Acme": "A"})).collect()]
    assert got == ["N Sz Last5y", "A Bp1", "Customer"]


def test_tsv_round_trip_keeps_nulls_and_label_column(spark):
    out = tempfile.mkdtemp(prefix="bc-tsv-") + "/t"
    df = spark.createDataFrame([("a", 1, None), ("b", None, 2.5)], "name string, k int, v double")
    files.write_tsv(df, out, first_column="name", label="Source=all")
    back = files.read_delimited(spark, out, "`Source=all` STRING, k INT, v DOUBLE").drop("source_file")
    assert back.columns == ["Source=all", "k", "v"]
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1, None), ("b", None, 2.5)]


def test_newest_snapshot_picks_latest_name(spark):
    folder = tempfile.mkdtemp(prefix="bc-snap-")
    for i, name in enumerate(["x_20240101", "x_20240301", "x_20240201"]):
        spark.range(i + 1).write.parquet(f"{folder}/{name}")
    name, df = files.newest_snapshot(spark, folder, "x_")
    assert name == "x_20240301" and df.count() == 2


def test_stats_scan_skips_lookalike_files_and_reads_colon_paths(spark):
    root = tempfile.mkdtemp(prefix="bc-stats-")
    rec = ('[{"name": {"name": "exact_match", "split": "test", "perturbation": {"name": "robustness", '
           '"robustness": true, "fairness": false, "computed_on": "worst"}}, "count": 1, "sum": 0.9, '
           '"sum_squared": 0.81, "min": 0.9, "max": 0.9, "mean": 0.9, "variance": 0.0, "stddev": 0.0}]')
    folder = f"{root}/medhallu:model=prov_m-rag,model_deployment=prov_m-rag"
    files.write_text_file(spark, f"{folder}/stats.json", rec)
    files.write_text_file(spark, f"{folder}/instance_stats.json", '[{"x": 1}]')
    df = files.read_stat_files(spark, root)
    d = files.run_dir(F.col("file_path"))
    r = df.select(files.bench_from_dir(d).alias("b"), files.model_from_dir(d).alias("m"), "mean").collect()
    assert [tuple(x) for x in r] == [("medhallu", "m-rag", 0.9)]


def test_hot_year_lands_in_several_files(spark, tmp_path):
    """A year with most rows is split by its measured size; small years stay whole."""
    df = spark.range(0, 400_000, numPartitions=4).select(F.when(F.col("id") % 50 == 0, 2001).otherwise(2000).alias("year"),
                                                         F.md5(F.col("id").cast("string")).alias("x"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(1 << 20))
    try:
        files.write_partitioned(df, str(tmp_path / "t"), "year")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    count = {y: len(list((tmp_path / "t" / f"year={y}").glob("*.parquet"))) for y in (2000, 2001)}
    assert count[2000] > 3 and count[2001] <= 2
    assert spark.read.parquet(str(tmp_path / "t")).filter("year = 2000").count() == 392_000


def test_stat_file_writer_commits_whole_folders(spark, tmp_path):
    """Staged until the commit, nothing left of failed attempts; arrays of one and many records, odd names."""
    from benchcohort.sources.statfiles import DECOY, FILE, STAGING, StatFilesWriter
    root = tmp_path / "tree"
    writer = StatFilesWriter(f"file://{root}", decoy=True)
    rows = [("a:model=x_m,model_deployment=x_m", '{"n": 1}'), ("b c", '{"n": "é"}'), ("b c", '{"n": 3}')]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    assert not list(root.glob(f"*/{FILE}")) and lost.staged != kept.staged
    writer.commit([kept, None, writer.write(iter([]))])
    assert sorted(p.parent.name for p in root.glob(f"*/{FILE}")) == sorted({f for f, _ in rows})
    assert json.loads((root / "b c" / FILE).read_text()) == [{"n": "é"}, {"n": 3}]
    assert json.loads((root / "b c" / DECOY).read_text()) and not (root / STAGING).exists()
    writer.write(iter([("late", "{}")]))
    writer.abort([])
    assert not (root / STAGING).exists() and not (root / "late").exists()


def test_stat_files_round_trip_with_a_failing_task(spark, tmp_path):
    """All runs appear, or none."""
    records = spark.createDataFrame([("b1", "m1", 1.0), ("b1", "m1", 2.0), ("b2", "m1", 3.0)], "bench string, model string, mean double")
    name = F.struct(F.lit("acc").alias("name"), F.lit("test").alias("split"), F.lit(None).cast(
        "struct<name:string,robustness:boolean,fairness:boolean,computed_on:string>").alias("perturbation"))
    full = records.select("bench", "model", name.alias("name"), F.lit(1).cast("bigint").alias("count"),
                          *[F.col("mean").alias(c) for c in ("sum", "sum_squared", "min", "max", "mean", "variance", "stddev")])
    root = str(tmp_path / "ok")
    assert files.write_stat_files(spark, full, root, "bench", "model") == 2
    got = files.read_stat_files(spark, root)
    assert sorted((files_row["mean"]) for files_row in got.collect()) == [1.0, 2.0, 3.0]
    bad = full.withColumn("mean", F.when(F.col("bench") == "b2", F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("mean")))
    with pytest.raises(Exception, match="lost"):
        files.write_stat_files(spark, bad, str(tmp_path / "bad"), "bench", "model")
    assert not list((tmp_path / "bad").glob("*/stats.json"))
