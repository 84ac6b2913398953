"""Query of the periodic run detection. SQL cannot express it; its tests hold it against brute force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .periodic import collapse


def with_period(key: Column, text: Column) -> Column:
    """The text, made periodic from some word on in a tenth of the documents, by the checksum of their keys."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(words, a + 1, p), (F.floor((n - a) / p) + 1).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = collapse(docs.select("doc_id", with_period(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("back"), (-r.period).alias("q"))))
    line = lambda r: F.concat(r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"), F.lit("\n"))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("most"),
                        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")) \
        .select("doc_id", "n_runs", (-F.col("most.back")).alias("start"), F.col("most.length").alias("length"),
                (-F.col("most.q")).alias("period"), F.expr("1000 * most.length div -most.q").alias("exponent_milli"),
                "runs_sha256", "collapsed_sha256")
