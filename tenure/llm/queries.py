"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenure.llm import ball_search, content_sort, cosine_cells, decontaminate, line_dedup, metric_join, packing, pu_quality, secret_forest, site_templates, spelling_variants, token_counts, url_templates
from tenure.llm.common import fold_is_held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_templates.judge_urls(pages, depth=None).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = pu_quality.fit_on_labels(docs, labels)
    return pu_quality.score(docs, model).select("doc_id", fold_is_held_out("doc_id").alias("held_out"), "score", "predicted")


def op3_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return content_sort.mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return metric_join.link_documents(docs).select("doc_id", "n_shingles", "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", packing.words_in(F.col("text")).alias("n_tokens"))
    return packing.pack(docs, length=F.col("n_tokens"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs).select(
        "doc_id", "n_tokens", "n_sections", "n_crossing", F.transform("sections", lambda s: s["tokens"]).alias("section_tokens")
    )


def op9_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return site_templates.extract(pages).select("page_id", "url", F.col("main_text").alias("text"), "n_chars")


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    findings = secret_forest.scan(docs, training=~fold_is_held_out("doc_id"))
    return findings.select("doc_id", "start", "finding", "path", F.round("score", 6).alias("score"), "is_secret")


def op11_cosine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return cosine_cells.link_vectors(vectors).select("vec_id", "n_links", "component_id", "kept")


def op12_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return ball_search.search(docs, benchmark).select("item_id", "rank", "doc_id", "score")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spelling_variants.group_variants(docs).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_templates, op2_pu_quality, op3_content_sort, op4_metric_join, op5_line_dedup,
        op6_packing, op7_decontaminate, op8_token_counts, op9_site_templates, op10_secret_forest,
        op11_cosine_cells, op12_ball_search, op13_spelling_variants,
    )
}
