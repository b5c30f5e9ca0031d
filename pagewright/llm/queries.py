"""Queries of the training-data operators, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.furniture import fit_lines, main_content, snippet_verdicts
from pagewright.llm.lookalike import consistent_forms, reading_keys, same_reading_pairs
from pagewright.llm.mixing import mixture, shares, sized_texts
from pagewright.llm.mojibake import garbled_pages, restored_pages
from pagewright.llm.neardup import NearDuplicates
from pagewright.llm.residue import fit, residue_pages, residue_titles
from pagewright.llm.sitelines import repeated_lines, without_lines
from pagewright.llm.stuffing import page_profiles, stuffing_scores
from pagewright.llm.termfreq import marked_terms
from pagewright.llm.tokenizer import decoded, with_ids
from pagewright.session import cut
from pagewright.sources.tables import table, texts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return (table if name == "mix_targets" else texts)(spark, sf_dir, name)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_scores(spark, sf_dir).where("stuffed").select("page_id")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures behind p1_found, of every page with enough words."""
    pages = _table(spark, sf_dir, "corpus_pages")
    return stuffing_scores(cut(page_profiles(pages, fit_lines(pages)))).withColumnRenamed("id", "page_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_table(spark, sf_dir, "corpus_pages"))


def p2_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its repeated lines cut out."""
    pages = _table(spark, sf_dir, "corpus_pages").select("page_id", "url", "content")
    return without_lines(pages, repeated_lines(pages)).select("page_id", "content")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return garbled_pages(_table(spark, sf_dir, "corpus_pages")).select(F.col("id").alias("page_id"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled pages with their content restored as far as possible, and what was wrong."""
    restored = restored_pages(_table(spark, sf_dir, "corpus_pages")).where(F.size("kinds") > 0)
    return restored.select(F.col("id").alias("page_id"), "content", "kinds")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(_table(spark, sf_dir, "corpus_pages")).select("term", F.explode("marks").alias("mark"))


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its counts; ``mark`` is null for useful terms."""
    return marked_terms(_table(spark, sf_dir, "corpus_pages")).select("term", "occurrences", F.col("records").alias("pages"), F.get("marks", F.lit(0)).alias("mark"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "corpus_pages")
    model = fit_lines(pages)
    profiles = cut(page_profiles(pages, model))
    stuffed = stuffing_scores(profiles).where("stuffed").select("id")
    lines = profiles.select("id", "furniture").join(stuffed, "id", "left_anti").select(F.lit("page").alias("record_kind"), F.col("id").alias("record_id"), F.explode("furniture").alias("line_no"))
    dirty = snippet_verdicts(_table(spark, sf_dir, "search_results"), model).where("dirty")
    return lines.unionByName(dirty.select(F.lit("result").alias("record_kind"), F.col("id").alias("record_id"), F.lit(0).alias("line_no")))


def p5_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main body only."""
    pages = _table(spark, sf_dir, "corpus_pages")
    return main_content(pages, fit_lines(pages)).withColumnRenamed("id", "page_id")


def p5_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snippet, told clean or not by what the pages' lines have taught."""
    model = fit_lines(_table(spark, sf_dir, "corpus_pages"))
    return snippet_verdicts(_table(spark, sf_dir, "search_results"), model).select(F.col("id").alias("result_id"), (~F.col("dirty")).alias("clean"))


def _near(spark: SparkSession, sf_dir: str) -> NearDuplicates:
    """p6 is stated on sequences of three terms, of pages with at least 100 of them."""
    return NearDuplicates(_table(spark, sf_dir, "corpus_pages"), "page_id", "content", width=3, threshold=(4, 5), least=100)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = _near(spark, sf_dir)
    return near.pairs(near.links())


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: class of equal sets, links of the class, group; pages that can't take part stand alone."""
    near = _near(spark, sf_dir)
    return near.groups(near.links())


def _residue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Ids of the pages and of the results that are residue."""
    pages = _table(spark, sf_dir, "corpus_pages")
    lines = fit_lines(pages)
    model = fit(pages, lines)
    return residue_pages(pages, lines, model), residue_titles(_table(spark, sf_dir, "search_results"), model)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, results = _residue(spark, sf_dir)
    return pages.select(F.lit("page").alias("record_kind"), F.col("id").alias("record_id")).unionByName(results.select(F.lit("result").alias("record_kind"), F.col("id").alias("record_id")))


def p7_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages and results that are left when residue is taken out."""
    pages, results = _residue(spark, sf_dir)
    kept = [
        _table(spark, sf_dir, name).select(F.lit(kind).alias("record_kind"), F.col(key).alias("record_id"), "url").join(found.withColumnRenamed("id", "record_id"), "record_id", "left_anti").select("record_kind", "record_id", "url")
        for name, kind, key, found in (("corpus_pages", "page", "page_id", pages), ("search_results", "result", "result_id", results))
    ]
    return kept[0].unionByName(kept[1])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(_table(spark, sf_dir, "documents"))


def p8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text isn't what its ids decode to (none)."""
    documents = _table(spark, sf_dir, "documents")
    back = decoded(with_ids(documents)).withColumnRenamed("text", "back")
    return documents.select("doc_id", "text").join(back, "doc_id").where(~F.col("text").eqNullSafe(F.col("back"))).select("doc_id")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(sized_texts(_table(spark, sf_dir, "documents")), _table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shares(cut(p9_mix(spark, sf_dir)), _table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_reading_pairs(reading_keys(_table(spark, sf_dir, "documents")))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in its consistent form."""
    return consistent_forms(_table(spark, sf_dir, "documents")).select("doc_id", "form")


_QUERIES = (
    p1_found, p1_scores, p2_found, p2_cleaned, p3_found, p3_restored, p4_found, p4_terms, p5_found, p5_main, p5_snippets, p6_found, p6_groups, p7_found, p7_kept, p8_ids, p8_roundtrip, p9_mix, p9_shares, p10_found, p10_forms,
)
QUERIES = {f.__name__: f for f in _QUERIES}

# ---------------------------------------------------------------- SQL for the oracle

#: Terms of the visible text of a page; hidden parts, then tags, then the character references in use go.
ORACLES: dict[str, str] = {}
