"""URL filtering against dated lists: a temporal (as-of) list join.

A list log has one row per change: ``key`` (a domain, a host, or a host with
its first path segment, as ``host/segment``), ``verdict`` (``block``, ``allow``
or ``remove``), ``day`` and ``seq``. A change holds from its day until the next
change of the same key, so the log becomes validity intervals, half open and
disjoint within a key. A capture (url, day) is judged by the entry that was
active on its day; of several matching keys the most specific decides: a path
before a host, a longer host suffix before a shorter one.

Everything is DataFrame expressions. Captures are first reduced to distinct
(host, segment, day), so a host with a third of all captures costs its distinct
days and segments only; the join is an equi-join on the key with a day range,
which adaptive execution splits where a key is hot. Nothing is broadcast by
hint: the lists grow with the data.

Defined results: a null or unparsable url has null host and verdict ``none``;
captures with a null day match nothing; a key's changes on one day: the highest
``seq`` holds; null keys, verdicts or days in the log are ignored; repeated
captures get a row each; empty tables give verdict ``none`` (no list) or no
rows (no captures). Captures need not have unique ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A path entry outranks every host entry (host names have at most 127 labels).
PATH_RANK = 1000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; null when there is none."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(authority), r"^.*@", ""), r"(:[0-9]*)?$", "")
    host = F.regexp_replace(host, r"\.$", "")
    return F.when(host != "", host)


def segment_of(url: Column) -> Column:
    """First path segment, without query or fragment; empty when there is none."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*/([^/?#]*)", 1), F.lit(""))


def list_keys(host: Column, segment: Column) -> Column:
    """All keys that can match, most specific first, as (key, rank) structs."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    firsts = F.when(n > 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array(F.lit(1)))
    suffixes = F.transform(firsts, lambda i: F.struct(
        F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("rank")))
    path = F.struct(F.concat(host, F.lit("/"), segment).alias("key"), F.lit(PATH_RANK).alias("rank"))
    return F.when(segment != "", F.concat(F.array(path), suffixes)).otherwise(suffixes)


def validity(log: DataFrame) -> DataFrame:
    """The log as intervals: key, verdict, valid_from, valid_to (exclusive, null: still open)."""
    log = log.select("key", "verdict", "day", "seq").dropna(subset=["key", "verdict", "day"])
    nxt = F.lead("day").over(W.partitionBy("key").orderBy("day", "seq"))
    spans = log.select("key", "verdict", F.col("day").alias("valid_from"), nxt.alias("valid_to"))
    return spans.filter((F.col("verdict") != "remove")
                        & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from"))))


def temporal_list_join(captures: DataFrame, log: DataFrame, url: str = "url", day: str = "fetch_day") -> DataFrame:
    """``captures`` plus host, segment, list_key, valid_from and verdict (``block``, ``allow``, ``none``).

    Columns of ``captures`` keep their names; a result whose name is taken gets ``_`` behind it."""
    names = captures.columns
    plain = captures.toDF(*[f"c{k}_" for k in range(len(names))])
    at = lambda name: F.col(f"c{names.index(name)}_")
    sites = plain.withColumns({"host": host_of(at(url)), "segment": segment_of(at(url)), "day_": at(day)})
    on = ["host", "segment", "day_"]
    asked = sites.select(*on).dropna().distinct()
    keyed = asked.select(*on, F.explode(list_keys(F.col("host"), F.col("segment"))).alias("k_")) \
        .select(*on, F.col("k_.key").alias("key"), F.col("k_.rank").alias("rank_"))
    spans = validity(log)
    active = keyed.join(spans, "key").filter(
        (F.col("day_") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day_") < F.col("valid_to"))))
    best = active.groupBy(*on).agg(F.max_by(F.struct("key", "valid_from", "verdict"), "rank_").alias("best_"))
    out = sites.join(best, on, "left").select(
        *plain.columns, "host", "segment", F.col("best_.key").alias("list_key"), F.col("best_.valid_from").alias("valid_from"),
        F.coalesce(F.col("best_.verdict"), F.lit("none")).alias("verdict"))
    added: list[str] = []
    for name in ("host", "segment", "list_key", "valid_from", "verdict"):
        while name in names or name in added:
            name += "_"
        added.append(name)
    return out.toDF(*names, *added)
