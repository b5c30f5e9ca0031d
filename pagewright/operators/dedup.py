"""Greedy exact deduplication on (URL or content) in source order.

A record is kept unless its URL or its content was seen on an earlier kept record;
a dropped record registers neither.  Records whose URL and content are both unique
are kept at once.  The others are settled in rounds: an open record that comes
first in both its groups is kept, and open records that share a key with a kept one
are dropped; each round decides at least the first open record.

Defined cases: records without URL or content are left out (they are no records);
ties of the order go by the row's own hash; an empty table gives no rows; all other
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.session import cut


def _first_of(rows: DataFrame, key: str) -> DataFrame:
    """The smallest open order of every value of a key (partial aggregation, so a hot value moves few rows)."""
    return rows.groupBy(key).agg(F.min("_order").alias(f"_min_{key}"))


def kept_records(records: DataFrame, order: str = "source", url: str = "url", content: str = "content") -> DataFrame:
    """The rows that greedy deduplication keeps."""
    usable = records.where(F.col(url).isNotNull() & F.col(content).isNotNull())
    keyed = usable.withColumns({"_u": F.col(url), "_h": F.sha2(content, 256)})
    keyed = keyed.withColumn("_order", F.struct(F.col(order), F.xxhash64("_u", "_h")))
    keys = cut(keyed.select("_order", "_u", "_h").distinct())
    counts = keys.join(keys.groupBy("_u").agg(F.count("*").alias("n_u")), "_u").join(keys.groupBy("_h").agg(F.count("*").alias("n_h")), "_h")
    open_rows = cut(counts.where("n_u > 1 or n_h > 1").select("_order", "_u", "_h"))
    dropped = open_rows.select("_order").where("false")
    while not open_rows.isEmpty():
        ranked = open_rows.join(_first_of(open_rows, "_u"), "_u").join(_first_of(open_rows, "_h"), "_h")
        kept = cut(ranked.where("_order = _min__u and _order = _min__h").select("_order", "_u", "_h"))
        rest = open_rows.join(kept.select("_order"), "_order", "left_anti")
        marks_u, marks_h = kept.select("_u").distinct().withColumn("hit_u", F.lit(True)), kept.select("_h").distinct().withColumn("hit_h", F.lit(True))
        marked = cut(rest.join(marks_u, "_u", "left").join(marks_h, "_h", "left").withColumn("hit", F.coalesce("hit_u", F.lit(False)) | F.coalesce("hit_h", F.lit(False))).select("_order", "_u", "_h", "hit"))
        dropped = dropped.unionByName(marked.where("hit").select("_order"))
        open_rows = marked.where("not hit").drop("hit")
    return keyed.join(dropped.distinct(), "_order", "left_anti").dropDuplicates(["_order"]).drop("_u", "_h", "_order")
