"""Lines repeated across the documents of one site, found by content-defined chunks.

A page's normalised visible text (casefolded, without digits and white space) is
cut by a rolling hash over ``WINDOW`` bytes: a chunk ends where the hash falls
under a fixed share of its range.  The cuts depend on the local bytes only, so a
line carries the same chunks wherever it stands.  A line start is a cut as well,
because results are stated by line; README says why.

1. One pass over the pages gives each line its anchor (its smallest chunk hash), the hash
   of the whole line, page and number; it is written to the shared folder and read from there.
2. Pages per (site, anchor chunk) are counted, pre-aggregated before the shuffle; a line
   can only be repeated if its anchor is on at least ``least`` pages, since the same line
   has the same chunks wherever it stands.
3. Exact check of the lines that are left: distinct pages per (site, whole normalised line).

Defined cases: rows without url have no site and no repeated lines; null and
empty contents have none; several rows of one page id count as one page; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.url import site
from pagewright.functions.visible import visible_lines
from pagewright.session import cut, map_columns

WINDOW, SHORTEST, MEAN_BITS = 8, 16, 6
LEAST_LETTERS = 12
_DROPPED = re.compile(r"[\d\s]+")
_NO_LETTER = re.compile(r"[\W\d_]+")
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_TABLE = _mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = 0x9E3779B97F4A7C15 | 1


def normalise(line: str) -> str:
    return _DROPPED.sub("", line.casefold())


def letters(line: str) -> int:
    return len(_NO_LETTER.sub("", line)) if line.isascii() else sum(map(str.isalpha, line))


def chunks(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunk hashes of all lines in order, the line of each chunk, and each line's anchor.  No line is empty."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(b"".join(lines), dtype=np.uint8)
    offset = np.arange(len(data), dtype=np.int64) - np.repeat(start, size)
    g = _TABLE[data]
    rolling = g.copy()
    factor = 1
    for k in range(1, WINDOW):
        factor = factor * _STEP % 2**64
        rolling[k:] += np.where(offset[k:] >= k, g[:-k] * _U(factor), _U(0))
    ends = ((rolling >> _U(64 - MEAN_BITS)) == 0) & (offset + 1 >= SHORTEST)
    begins = offset == 0
    begins[1:] |= ends[:-1]
    first = np.flatnonzero(begins)
    owner = np.repeat(np.arange(len(lines)), size)[first]
    within = (np.arange(len(data), dtype=np.int64) - np.repeat(first, np.diff(np.append(first, len(data))))).astype(np.uint64)
    hashes = _mix(np.add.reduceat(_mix(g + within * _U(_STEP)), first))
    anchor = np.minimum.reduceat(hashes, np.searchsorted(owner, np.arange(len(lines))))
    return hashes, owner, anchor


def _lines(batches: Iterator[dict[str, list]]):
    """Lines with enough letters of up to 200 pages at a time: page position, page id, site, number, normalised bytes."""
    for batch in batches:
        for i in range(0, len(batch["page_id"]), 200):
            rows = []
            for k in range(i, min(i + 200, len(batch["page_id"]))):
                page_id, host = batch["page_id"][k], batch["site"][k]
                for number, line in enumerate(visible_lines(batch["content"][k])):
                    if len(line) >= LEAST_LETTERS and letters(line) >= LEAST_LETTERS:
                        rows.append((k, page_id, host, number, normalise(line).encode("utf-8", "surrogatepass")))
            if rows:
                yield rows


def _line_rows(batches: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
    for rows in _lines(batches):
        _, _, anchor = chunks([r[4] for r in rows])
        yield {
            "site": [r[2] for r in rows],
            "chunk": anchor.astype(np.int64),
            "line": np.array([xxhash.xxh3_64_intdigest(r[4]) for r in rows], dtype=np.uint64).astype(np.int64),
            "page_id": [r[1] for r in rows],
            "line_no": [r[3] for r in rows],
        }


def repeated_lines(pages: DataFrame, least: int = 5) -> DataFrame:
    """``(page_id, line_no)`` of every line on at least ``least`` pages of its site."""
    host = site(F.col("url"))
    source = pages.select("page_id", F.xxhash64(host).alias("site"), "content", host.alias("host")).where("host is not null and content is not null and page_id is not null").drop("host")
    lines = cut(map_columns(source, ["page_id", "site", "content"], _line_rows, "site long, chunk long, line long, page_id long, line_no int"))

    def often(rows: DataFrame, key: str) -> DataFrame:
        return rows.groupBy("site", key).agg(F.countDistinct("page_id").alias("n")).where(F.col("n") >= least).select("site", key)

    near = lines.join(often(lines, "chunk"), ["site", "chunk"], "left_semi").select("site", "line", "page_id", "line_no")
    return near.join(often(near, "line"), ["site", "line"], "left_semi").select("page_id", "line_no").distinct()


def without_lines(pages: DataFrame, found: DataFrame) -> DataFrame:
    """The pages with the found lines cut out of ``content``; all other columns and rows stay."""
    cuts = found.groupBy("page_id").agg(F.collect_list("line_no").alias("_cut_lines"))
    lines = F.filter(F.split("content", "\n", -1), lambda _, i: ~F.coalesce(F.array_contains("_cut_lines", i), F.lit(False)))
    return pages.join(cuts, "page_id", "left").withColumn("content", F.when(F.col("_cut_lines").isNull(), F.col("content")).otherwise(F.array_join(lines, "\n"))).select(*pages.columns)
