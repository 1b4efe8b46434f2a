"""A corpus pipeline of five stages over ``documents``; each stage works on what its predecessor kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet to the shared folder and read
back as the next stage's docs. All stages but the last return the columns of ``documents``; other columns pass through them.
An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from reachset.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from reachset.llm.store import materialize


def quality_rules(spark, docs, sf_dir):
    """Drop the documents that the rules reject. A null or empty text has no words and goes; rows are told apart by id and text,
    so null and repeated ids are judged too and equal rows stay or go together."""
    key = F.xxhash64(F.col("doc_id"), F.col("text"))
    ledger = quality.build_ledger(docs.select(key.alias("doc_id"), "text"))
    kept = quality.apply_policy(ledger).filter("kept").select(F.col("doc_id").alias("kept_key")).distinct()
    return docs.join(kept, key == F.col("kept_key"), "left_semi")


def dedup_lines(spark, docs, sf_dir):
    """Take later copies of lines out of the texts; rows stay, also those whose text is empty then. Equal rows keep their lines."""
    return line_dedup.dedup_lines(docs)


def one_per_group(spark, docs, sf_dir):
    """Keep of each group of linked documents one: that with the smallest id, null last, then the smallest text hash. Documents
    without words are linked with nothing and stay."""
    return ngram_join.keep_one(docs)


def decontaminated(spark, docs, sf_dir):
    """Drop the documents that contain an item of the benchmark; an empty benchmark drops none."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark, docs, sf_dir):
    """The mix to target weights: its packed blocks with their words and the ids of the documents they come from. Documents
    without words are in no block; no documents give no blocks."""
    return mixing.mix_blocks(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_per_group),
    ("benchmark_decontamination", decontaminated),
    ("source_mixing", mixed),
]

#: The line join and the components need more than one statement that a SQL check could run in reasonable time.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries():
    return {"pipeline": run}


def oracle_sql():
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
