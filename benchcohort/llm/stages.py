"""The operators as stages of the corpus pipeline.

A stage takes the documents that its predecessor kept and returns documents with
the same columns (the last one: tokens). Columns are handled by place under
neutral names, so extra columns may have any name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .mixing import mix
from .neardup import near_duplicates
from .q_bpe import TOKENIZER
from .q_classify import THRESHOLD, trained_quality
from .quality import keep_quality
from .substring import remove_repeats


def neutral(docs: DataFrame) -> DataFrame:
    """The same columns under names of our own."""
    return docs.toDF(*[f"c{k}_" for k in range(len(docs.columns))])


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_quality(docs, trained_quality(spark, docs, sf_dir), THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and all others."""
    names, plain = docs.columns, neutral(docs)
    found = near_duplicates(docs.select("doc_id", "text"))
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias("dropped_"))
    return plain.join(dropped, plain[names.index("doc_id")] == F.col("dropped_"), "left_anti").toDF(*names)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words under windows that an earlier document has.

    Texts that lose nothing keep their white space; n_chars follows the text."""
    names = docs.columns
    plain = neutral(docs).columns
    key, text = plain[names.index("doc_id")], plain[names.index("text")]
    keep = [c for c in plain if c != text]
    out = remove_repeats(docs.toDF(*plain), keep=keep, key=key, text=text, rejoin=False)
    columns = {text: F.col("kept")}
    if "n_chars" in names:
        size = plain[names.index("n_chars")]
        columns[size] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(size)).cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns.get(c, F.col(c)).alias(n) for c, n in zip(plain, names)])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Rows that share a doc_id are taken equally often."""
    taken = mix(docs.select("doc_id", "source", "text")).groupBy("doc_id").agg(F.max("copies").alias("copies_"))
    taken = taken.filter("copies_ > 0").select(F.col("doc_id").alias("taken_"), "copies_")
    names, plain = docs.columns, neutral(docs)
    rows = plain.join(taken, plain[names.index("doc_id")].eqNullSafe(F.col("taken_")))
    return rows.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select(*plain.columns).toDF(*names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document of the mix: doc_id, n_tokens, ids and a digest of the decoded text."""
    out = bpe_encode(docs, public_tokenizers.path(TOKENIZER))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
