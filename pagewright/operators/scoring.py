"""Scores of many queries over the postings of their words, without a row for each query and document.

A row for every document that a query touches would be as many as queries times documents.  So the postings are spread
by document and packed into blocks (a row each: arrays by term), and every query is scored inside each block, by
additions into arrays.  What leaves a block are the query's best documents only, and of these only such as can be among
the best of all blocks: a first pass gives, for each query and block, the value and id at the places 1, 2, 4, ...; from
these follows a place in the order that enough documents of all blocks reach; ids belong to it, as texts that score alike
would all reach a mere value.

The order is that of the ranking: matched terms, then score to nine digits, then the smaller id.

Words in the documents' URLs lie in the blocks, too, so a head's scores have their bonus when they leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagewright.operators.postings import saturation
from pagewright.session import cut

HEADS = "kind bigint, doc_id bigint, matched int, score double, nano bigint"
_PLACES = "kind bigint, matched int, nano bigint, doc_id bigint, more bigint, reach bigint"
_BLOCK = "docs binary, lengths binary, starts binary, at binary, weighted binary"
#: Postings of a block, more or less, and the fewest for which another block is begun.
BLOCK_ROWS, LEAST_ROWS = 500_000, 50_000
#: Contributions are whole numbers of 2^-40, whose sum is the same in any order.
UNIT = float(1 << 40)


@dataclass(frozen=True)
class Kind:
    """One query: its number, its words (number of the term, weight, gain where the URL has it), how many of them a document must have, how many documents are wanted."""

    number: int
    words: list[tuple[int, float, float]]
    least: int
    reach: int


def _pack(terms: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's hits (doc_id, number, weighted, doc_len; the length is 0 for words of URLs) as one row of arrays, by term and document."""
    schema = to_arrow_schema(StructType.fromDDL(_BLOCK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if parts:
            doc_id, number, weighted, length = (np.concatenate(c) for c in zip(*parts))
            docs, at = np.unique(doc_id, return_inverse=True)
            lengths = np.zeros(len(docs), dtype=np.int64)
            lengths[at[length > 0]] = length[length > 0]
            order = np.lexsort((at, number))
            starts = np.searchsorted(number[order], np.arange(terms + 1))
            row = docs.astype(np.int64), lengths, starts.astype(np.int64), at[order].astype(np.int32), weighted[order].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in row], schema=schema)

    return run


def _best(matched: np.ndarray, nano: np.ndarray, reach: int) -> np.ndarray:
    """Where the best ``reach`` documents stand, in order; the documents are given by rising id."""
    if len(nano) > reach:
        at_least = np.cumsum(np.bincount(matched)[::-1])[::-1]
        level = int(np.flatnonzero(at_least >= reach)[-1])
        here = matched == level
        wanted = reach - (int(at_least[level + 1]) if level + 1 < len(at_least) else 0)
        last = np.partition(nano[here], -wanted)[-wanted]
        among = np.flatnonzero((matched > level) | (here & (nano >= last)))
    else:
        among = np.arange(len(nano))
    return among[np.lexsort((among, -nano[among], -matched[among]))][:reach]


def _scored(kinds: list[Kind], average: float, floors: dict[int, tuple[int, int, int]], named: int = 0) -> Callable:
    """For every block and query: (query, ids, matched, score in units, score in 1e-9, sum of the gains by the URL) of the best
    documents in order, without those below the query's floor.  ``named``: the number of the first term's hits in URLs, if there are any."""

    def run(block: dict[str, bytes]) -> Iterator[tuple[Kind, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        docs, lengths, starts = (np.frombuffer(block[name], dtype=np.int64) for name in ("docs", "lengths", "starts"))
        at, weighted = np.frombuffer(block["at"], dtype=np.int32), np.frombuffer(block["weighted"], dtype=np.float64)
        part = saturation(weighted, lengths[at], average) * UNIT
        total, count = np.zeros(len(docs), dtype=np.int64), np.zeros(len(docs), dtype=np.int32)
        inside = np.zeros(len(docs), dtype=np.float64)
        for kind in kinds:
            found = None
            for term, weight, _ in kind.words:
                span = slice(starts[term], starts[term + 1])
                found, gain = at[span], np.rint(weight * part[span]).astype(np.int64)
                if len(kind.words) > 1:
                    total[found] += gain
                    count[found] += 1
            if len(kind.words) > 1:
                touched = np.flatnonzero(count)
                found = touched if kind.least == 1 else touched[count[touched] >= kind.least]
                gain, matched = total[found], count[found]
                total[touched] = 0
                count[touched] = 0
            else:
                matched = np.ones(len(found), dtype=np.int32)
            nano = np.rint(gain * (1e9 / UNIT)).astype(np.int64)
            if kind.number in floors:
                level, least, last = floors[kind.number]
                keep = np.flatnonzero((matched > level) | ((matched == level) & ((nano > least) | ((nano == least) & (docs[found] <= last)))))
                found, matched, gain, nano = found[keep], matched[keep], gain[keep], nano[keep]
            if len(found):
                best = _best(matched, nano, kind.reach)
                spans = [(at[starts[named + term] : starts[named + term + 1]], more) for term, _, more in kind.words] if named else []
                for span, more in spans:
                    inside[span] += more
                yield kind, docs[found[best]], matched[best], gain[best], nano[best], inside[found[best]]
                for span, _ in spans:
                    inside[span] = 0

    return run


def _rows(blocks: DataFrame, scored: Callable, columns: Callable[..., tuple], ddl: str) -> DataFrame:
    """What ``columns`` makes of every block's and query's best documents."""
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                kept, size = [], 0
                block = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                for found in scored(block):
                    kept.append(columns(*found))
                    size += len(kept[-1][0])
                    if size >= 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*kept), schema)], schema=schema)
                        kept, size = [], 0
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), type=f.type) for c, f in zip(zip(*kept), schema)], schema=schema)

    return blocks.mapInArrow(run, ddl)


def _head_columns(boost: float) -> Callable[..., tuple]:
    def columns(kind: Kind, ids: np.ndarray, matched: np.ndarray, gain: np.ndarray, nano: np.ndarray, inside: np.ndarray) -> tuple:
        return np.full(len(ids), kind.number, dtype=np.int64), ids, matched, gain / UNIT + boost * inside, nano

    return columns


def _place_columns(kind: Kind, ids: np.ndarray, matched: np.ndarray, gain: np.ndarray, nano: np.ndarray, inside: np.ndarray) -> tuple:
    """The values and ids at the places 1, 2, 4, ... and at the last one, and how many places each stands for."""
    n = len(ids)
    places = np.array(sorted({*(1 << i for i in range(n.bit_length())), n}), dtype=np.int64)
    return np.full(len(places), kind.number, dtype=np.int64), matched[places - 1], nano[places - 1], ids[places - 1], np.diff(places, prepend=0), np.full(len(places), kind.reach, dtype=np.int64)


def _floors(blocks: DataFrame, kinds: list[Kind], average: float) -> dict[int, tuple[int, int, int]]:
    """For each query the first place in the order (matched, nano, id) known to be reached by as many documents as it wants; none if they are fewer."""
    places = _rows(blocks, _scored(kinds, average, {}), _place_columns, _PLACES)
    falling = Window.partitionBy("kind").orderBy(F.desc("matched"), F.desc("nano"), "doc_id")
    reached = places.withColumn("so_far", F.sum("more").over(falling)).where("so_far >= reach")
    first = F.max(F.struct("matched", "nano", (-F.col("doc_id")).alias("before")))
    return {r["kind"]: (r["v"]["matched"], r["v"]["nano"], -r["v"]["before"]) for r in reached.groupBy("kind").agg(first.alias("v")).collect()}


def heads(hits: DataFrame, rows: int, kinds: list[Kind], terms: int, average: float, named: DataFrame | None = None, boost: float = 0.0) -> DataFrame:
    """``(kind, doc_id, matched, score, nano)`` from ``hits`` (doc_id, number, weighted, doc_len; as many as ``rows``):
    of each query the best ``reach`` documents and some more; ``nano`` is the score in 1e-9.  With ``named`` (doc_id, number;
    the words in URLs) the score has ``boost`` times their gains added, which ``nano`` and the order leave out."""
    cores = hits.sparkSession.sparkContext.defaultParallelism
    n = max(-(-rows // BLOCK_ROWS), min(cores, -(-rows // LEAST_ROWS)), 1)
    if named is not None:
        hits = hits.unionByName(named.select("doc_id", (F.col("number") + terms).alias("number"), F.lit(0.0).alias("weighted"), F.lit(0).cast("long").alias("doc_len")))
    first = terms if named is not None else 0
    blocks = cut(hits.repartition(n, "doc_id").mapInArrow(_pack(terms + first), _BLOCK))
    floors = _floors(blocks, kinds, average) if n > 1 else {}
    return _rows(blocks, _scored(kinds, average, floors, first), _head_columns(boost), HEADS)
