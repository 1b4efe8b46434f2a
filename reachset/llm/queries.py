"""Queries over the test tables, one per operator, with production parameters and whole tables."""

from __future__ import annotations

from . import decontaminate, hmm, licenses, line_dedup, mixing, ngram_join, quality, secrets, substrings, warc


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark, sf_dir):
    return decontaminate.leaks(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.dedup_digest(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_ngram_jaccard_join(spark, sf_dir):
    return ngram_join.join_digest(_documents(spark, sf_dir).select("doc_id", "text"))


def op4_quality_rules(spark, sf_dir):
    ledger = quality.build_ledger(_documents(spark, sf_dir).select("doc_id", "text"))
    return quality.apply_policy(ledger)


def op5_warc(spark, sf_dir):
    return warc.warc_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_source_mixing(spark, sf_dir):
    return mixing.mix_digest(_documents(spark, sf_dir).select("doc_id", "source", "text"))


def op7_substring_dedup(spark, sf_dir):
    return substrings.repeats_digest(_documents(spark, sf_dir).select("doc_id", "text"))


def op8_license_scan(spark, sf_dir):
    return licenses.license_digest(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_lm_scoring(spark, sf_dir):
    return hmm.score_documents(_documents(spark, sf_dir).select("doc_id", "text"))


def op10_secret_scan(spark, sf_dir):
    return secrets.secret_digest(_documents(spark, sf_dir).select("doc_id", "text"))


def queries():
    found = [op1_decontamination, op2_line_dedup, op3_ngram_jaccard_join, op4_quality_rules, op5_warc, op6_source_mixing, op7_substring_dedup, op8_license_scan, op9_lm_scoring, op10_secret_scan]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {
        "op1_decontamination": decontaminate.leaks_sql(),
        "op2_line_dedup": line_dedup.dedup_sql("documents"),
        "op3_ngram_jaccard_join": ngram_join.join_sql("documents"),
        "op4_quality_rules": quality.quality_sql("documents"),
        "op5_warc": warc.round_trip_sql("pages"),
        "op6_source_mixing": mixing.mix_sql("documents"),
        "op7_substring_dedup": substrings.repeats_sql("documents"),
    }
