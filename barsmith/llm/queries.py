"""Registered queries of the training-data operators, each over its whole
table, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barsmith.llm import (forest, jaccard, langid, licenses, lines, mixing, repeats, reputation, revisits, templates,
                          topk, turntrie, whitening)
from barsmith.llm.common import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1 in turn and share 150% of all
    words, at most twice their own."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op2_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that five or more of them share."""
    return lines.digest_lines(table(spark, sf_dir, "documents"))


def op3_identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op4_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th vector with all others."""
    return topk.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The rules of op5.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
         ("block", "net/fr/")]


def op5_judge_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page allowed or blocked by rule or by its host's record.  A page's
    outcome is the label of the document whose number its url carries."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(reputation.parse_url(F.col("url"))[1], r"/(\d{1,18})(?!\d)", 1)
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("__doc"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    outcomes = pages.withColumn("__doc", F.when(number != "", number.cast("long"))).join(labels, "__doc")
    return reputation.judge(pages, outcomes, RULES).select("page_id", "host", "path", "rule", "verdict", "bad_low")


def op6_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisits of the log of a crawl of all pages, resolved."""
    out = revisits.resolve_revisits(revisits.crawl_log(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url_key", "ts", "refers_to", "resolution", F.col("headers")["date"].alias("date"),
                      F.col("headers")["content-type"].alias("content_type"),
                      F.col("headers")["cache-control"].alias("cache_control"), "payload_digest", "payload_length")


def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other names and numbers."""
    found = templates.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.max("windows").alias("windows"),
        F.max("reworded").alias("reworded"), F.min("dpos").alias("token"))


def op8_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in all documents: one row per occurrence."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.explode("licenses").alias("l")).select("doc_id", "l.*")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked by 4-word shingles at 85% or more."""
    return jaccard.near_classes(table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the bytes of strings of 400 bytes that occur twice."""
    return repeats.digest_repeats(table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return turntrie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors whitened on the first 16 components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every 20th vector."""
    found = forest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", "vec_id", "score")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_dedup_lines, op3_identify_language, op4_top_products,
                                op5_judge_hosts, op6_resolve_revisits,
                                op7_benchmark_leaks, op8_scan_licenses, op9_jaccard_join, op10_remove_repeats,
                                op11_conversation_trie, op12_whiten_embeddings, op13_nearest_vectors)}
SQL = {"op1_mix_sources": mixing.mix_sql(), "op2_dedup_lines": lines.lines_sql(),
       "op4_top_products": topk.top_sql(), "op6_resolve_revisits": revisits.revisits_sql(),
       "op11_conversation_trie": turntrie.trie_sql()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return f(spark, sf_dir)
        run.__name__, run.__doc__ = f.__name__, f.__doc__
        return run
    return {name: bind(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
