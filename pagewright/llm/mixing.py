"""Mixing sources to target weights, by Pareto order sampling.

Sizes are tokens.  Every distinct text counts once (its smallest id stands for
it), in the source (trimmed, lower case) of that document.  The size of the
mixture is the largest at which every source reaches its share with no text used
more than ``max_repeats`` times (or a given size; then sources that can't reach
their share give all they may, and the shares reached say so).

A source of size T with budget B gives ``floor(B / T)`` whole copies of all its
texts.  The rest is drawn by Pareto order sampling: with inclusion probability p
proportional to a text's size, texts are ranked by ``(U / (1 - U)) / (p / (1 - p))``
for a hashed uniform U, and taken in that order until the rest of the budget is
used.  Texts with p of 1 or more are certain: they are taken first, and the rest of the
budget is spread over the others.  The order is cut by histograms of the ranks (a
fixed number of bins, summed by partial aggregation), each dividing the bin in which
the budget ends once more; only the last such bin, about ``1 / BINS ** LEVELS`` of a
source, is ordered exactly, so no source is ever sorted as a whole.

Defined cases: null, blank and empty texts, and sources without target, are left
out; targets of a source without texts are reported with share 0; ties of the
rank go by id; repeated rows of one id are one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.tokenizer import RANKS, with_sizes
from pagewright.session import cut

BINS, LEVELS = 4096, 2
#: Rows a source are sent to all tasks only if there are at most so many targets.
MOST_SOURCES = 100_000


def _uniform(seed: int):
    return (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sized_texts(documents: DataFrame, path: str = RANKS) -> DataFrame:
    """``(doc_id, source, tokens)`` of the distinct texts that have any token."""
    named = documents.select(F.col("doc_id"), F.lower(F.trim("source")).alias("source"), "text").where("doc_id is not null and source is not null and trim(text) <> ''")
    keyed = named.withColumns({"k1": F.xxhash64("text"), "k2": F.hex(F.substring(F.unhex(F.sha2("text", 256)), 1, 16))})
    first = keyed.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "source")).alias("d")).select("d.doc_id", "d.source")
    # sizes are used several times and cost far more than the few numbers of a text take
    return cut(with_sizes(named.select("doc_id", "text").dropDuplicates(["doc_id"]).join(first, "doc_id"), ["doc_id", "source"], "text", path).where("tokens > 0"))


def mixture(texts: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 1) -> DataFrame:
    """``(doc_id, source, tokens, copies)`` of the texts used; ``texts`` from :func:`sized_texts`."""
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0 and max_repeats >= 1")
    few = targets.count() <= MOST_SOURCES

    def narrow(rows: DataFrame) -> DataFrame:
        """Rows of one a source, as many as there are targets at most."""
        return F.broadcast(rows) if few else rows

    totals = texts.groupBy("source").agg(F.sum("tokens").alias("total"), F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("squares"), F.max("tokens").alias("largest"))
    plan = wanted.join(totals, "source")
    whole = plan.agg(F.min(F.col("total") * F.col("max_repeats") / F.col("target_share")).alias("size")).scalar() if size is None else F.lit(float(size))
    budget = F.least(F.col("target_share") * whole, (F.col("total") * F.col("max_repeats")).cast("double"))
    plan = (
        plan.withColumn("budget", budget)
        .withColumn("whole", F.floor(F.col("budget") / F.col("total") + 1e-9))
        .withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("whole") * F.col("total")))
        .withColumn("factor", F.col("rest") / F.col("squares"))
        .select("source", "whole", "rest", "factor")
    )
    used = texts.join(narrow(plan), "source")
    # p is proportional to size; sum of p * size is the rest of the budget.  Texts of p >= 1 are certain, which raises p of the others
    for _ in range(LEVELS):
        sure = used.where((F.col("factor") * F.col("tokens") >= 1) & (F.col("rest") > 0)).groupBy("source").agg(F.sum("tokens").alias("sure"))
        loose = used.where(F.col("factor") * F.col("tokens") < 1).groupBy("source").agg(F.sum(F.col("tokens").cast("double") * F.col("tokens")).alias("loose"))
        plan = plan.join(sure, "source", "left").join(loose, "source", "left").withColumn("factor", F.when(F.col("sure").isNull() | F.col("loose").isNull(), F.col("factor")).otherwise(F.greatest(F.lit(0.0), F.col("rest") - F.col("sure")) / F.col("loose"))).select("source", "whole", "rest", "factor")
        plan = cut(plan)
        used = texts.join(narrow(plan), "source")
    p = F.greatest(F.lit(1e-12), F.col("factor") * F.col("tokens"))
    u = _uniform(seed)
    odds = F.when(p >= 1, 0.0).otherwise((u / (1 - u)) / (p / (1 - F.least(p, F.lit(1 - 1e-12)))))
    ranked = cut(used.withColumn("order", odds / (1 + odds)))
    edges = _edges(ranked, narrow)
    placed = ranked.join(narrow(edges), "source", "left")
    taken = (F.col("rest") > 0) & (F.col("order") < F.col("low"))
    inside = placed.where(taken).select("doc_id")
    # the bin where the budget ends: a text is taken while the sum up to its middle is within the rest
    running = F.sum("tokens").over(Window.partitionBy("source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    edge = placed.where((F.col("rest") > 0) & (F.col("order") >= F.col("low")) & (F.col("order") < F.col("high"))).withColumn("upto", F.col("before") + running)
    drawn = inside.unionByName(edge.where(F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).select("doc_id")).withColumn("drawn", F.lit(1))
    copies = F.col("whole") + F.coalesce("drawn", F.lit(0))
    return ranked.join(drawn, "doc_id", "left").withColumn("copies", copies.cast("int")).where("copies > 0").select("doc_id", "source", "tokens", "copies")


def _edges(ranked: DataFrame, narrow: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(source, low, high, before)``: the range of orders in which each source's budget ends, and the tokens below it.
    Orders lie in [0, 1); a row a source throughout."""
    edges = cut(ranked.where("rest > 0").select("source").distinct().withColumns({"low": F.lit(0.0), "high": F.lit(1.0), "before": F.lit(0).cast("long")}))
    for _ in range(LEVELS):
        inside = ranked.where("rest > 0").join(narrow(edges), "source").where((F.col("order") >= F.col("low")) & (F.col("order") < F.col("high")))
        width = (F.col("high") - F.col("low")) / BINS
        counted = inside.withColumn("bin", F.least(F.lit(BINS - 1), F.floor((F.col("order") - F.col("low")) / width)).cast("int")).groupBy("source", "rest", "low", "high", "before", "bin").agg(F.sum("tokens").alias("t"))
        # at most BINS rows a source
        sofar = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        reached = counted.withColumn("sofar", F.col("before") + sofar).where(F.col("sofar") <= F.col("rest"))
        last = reached.groupBy("source", "low", "high").agg(F.max(F.struct("bin", "sofar")).alias("e"))
        start = F.col("low") + F.col("e.bin") * (F.col("high") - F.col("low")) / BINS
        end = F.when(F.col("e.bin") == BINS - 1, F.col("high")).otherwise(F.col("low") + (F.col("e.bin") + 1) * (F.col("high") - F.col("low")) / BINS)
        edges = cut(last.select("source", start.alias("low"), end.alias("high"), F.col("e.sofar").alias("before")))
    return edges


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, tokens, share, most_copies)`` of every target."""
    reached = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    total = reached.select(F.sum("tokens")).scalar()
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), "target_share", "max_repeats")
    return wanted.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
