"""Frequency of every distinct term: occurrences, records, and a mark (too rare / too common).

Last-seen counters: each task walks its records in order and keeps, per term,
the occurrences, the number of records and the ordinal of the last record that
had the term, so no set of records is ever held.  A record lies wholly inside
one task, so the tasks' counters add up exactly; a hash shuffle on the term
moves one small row per term and task, however hot the term.  The counters are
flushed when they hold ``max_terms`` terms, which bounds memory and changes no
sum.

The number of records is counted in the same pass: each flush gives a row without
term that says how many records it saw.

Defined cases: rows of null content are no records; an empty content is a
record without terms; repeated rows count each; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.visible import terms
from pagewright.session import cut, map_columns

MAX_TERMS = 300_000


def _flush(state: dict[str, list[int]], records: int) -> dict[str, list]:
    values = list(state.values())
    return {"term": [None, *state], "occ": [0, *(v[0] for v in values)], "recs": [records, *(v[1] for v in values)]}


def last_seen_counts(batches: Iterator[dict[str, list]], max_terms: int = MAX_TERMS) -> Iterator[dict[str, list]]:
    state: dict[str, list[int]] = {}
    record = flushed = 0
    for batch in batches:
        for content in batch["content"]:
            if content is None:
                continue
            record += 1
            for term in terms(content):
                seen = state.get(term)
                if seen is None:
                    state[term] = [1, 1, record]
                else:
                    seen[0] += 1
                    if seen[2] != record:
                        seen[1] += 1
                        seen[2] = record
            if len(state) >= max_terms:
                yield _flush(state, record - flushed)
                state, flushed = {}, record
    if record > flushed:
        yield _flush(state, record - flushed)


def counted(pages: DataFrame, text_col: str = "content") -> DataFrame:
    """``(term, occurrences, records)`` of every distinct term of the visible texts, and a row of null term with the number of records."""
    parts = map_columns(pages.select(F.col(text_col).alias("content")), ["content"], last_seen_counts, "term string, occ long, recs long")
    return parts.groupBy("term").agg(F.sum("occ").alias("occurrences"), F.sum("recs").alias("records"))


def term_frequencies(pages: DataFrame, text_col: str = "content") -> DataFrame:
    """``(term, occurrences, records)`` of every distinct term of the visible texts."""
    return counted(pages, text_col).where("term is not null")


def marked_terms(pages: DataFrame, text_col: str = "content", rare_below: int = 3, common_share: float = 0.4) -> DataFrame:
    """``(term, occurrences, records, marks)``; marks is an array of ``rare`` and/or ``common``
    (both only hold in collections of a few records), empty for useful terms."""
    # one row a term, read twice: the vocabulary is far smaller than the texts
    counts = cut(counted(pages, text_col))
    total = counts.where("term is null").agg(F.sum("records").alias("n")).scalar()
    rare = F.when(F.col("records") < rare_below, F.lit("rare"))
    common = F.when(F.col("records") > F.lit(common_share) * total, F.lit("common"))
    return counts.where("term is not null").withColumn("marks", F.array_compact(F.array(rare, common)))
