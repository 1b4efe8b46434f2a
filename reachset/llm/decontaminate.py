"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame operations only.

An item is contained in a document if the document holds at least 4/5 of the item's distinct 5-word shingles. Words are
runs of letters, digits and characters beyond ASCII, A-Z lowered, so punctuation and case hide nothing.

Items are partitioned by size, [2^k, 2^(k+1)) shingles. A partition keeps of each item the smallest shingle hashes (its
bottom sketch), 2 * floor(upper / 5) + 1 of them, or all if there are fewer. A document that contains the item lacks at
most floor(n / 5) of its shingles, so it holds at least sketch size - floor(n / 5) values of the sketch, which is one at
least: no contained item is missed, whatever the document's length. Candidates are verified with the shingles themselves.

An item of fewer than 5 words is one shingle of its own length; an item without words is never contained. Defined
results: a null text is empty; rows that are equal in id and text give one result; items are told apart by item_id and
text; empty tables give an empty result; other columns are ignored (``decontaminate`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

SHINGLE = 5
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Documents with a candidate up to which their keys are broadcast, so that only their texts move; beyond, the join shuffles.
BROADCAST_KEYS = 500_000
#: Sketch and shingle rows of the benchmark up to which they are broadcast; beyond, the joins shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, WORD_BREAK), lambda w: w != "")


def _hashes(words: Column, k: int) -> Column:
    """Hash of the k words from each place on."""
    at = F.transform(words, lambda w, i: F.xxhash64(F.lit(k), w, *[F.get(words, i + F.lit(j)) for j in range(1, k)]))
    return F.when(F.size(words) >= k, F.slice(at, F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<bigint>"))


def _strings(words: Column, k: int) -> Column:
    at = F.transform(words, lambda w, i: F.concat_ws(" ", w, *[F.get(words, i + F.lit(j)) for j in range(1, k)]))
    return F.when(F.size(words) >= k, F.array_distinct(F.slice(at, F.lit(1), F.size(words) - (k - 1)))).otherwise(F.array().cast("array<string>"))


def _by_length(lengths: list[int], k: Column, make) -> Column:
    out = make(lengths[-1])
    for x in lengths[:-1]:
        out = F.when(k == x, make(x)).otherwise(out)
    return out


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """key, item_id, k (words per shingle), shingles (texts), n (how many), sketch (smallest hashes), need (hits that a document must have)."""
    lengths = list(range(1, SHINGLE + 1))
    w = benchmark.select(F.col("item_id"), words_of(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    w = w.withColumn("k", F.least(F.lit(SHINGLE), F.size("w")))
    w = w.withColumn("shingles", _by_length(lengths, F.col("k"), lambda x: _strings(F.col("w"), x)))
    w = w.withColumn("hashes", F.array_sort(F.array_distinct(_by_length(lengths, F.col("k"), lambda x: _hashes(F.col("w"), x)))))
    n = F.size("shingles")
    part = F.floor(F.log2(n)).cast("int")
    upper = F.pow(F.lit(2.0), part + 1).cast("int") - 1
    keep = F.least(F.size("hashes"), 2 * F.floor(upper / 5).cast("int") + 1)
    return w.select(
        F.xxhash64("item_id", "w").alias("key"), "item_id", "k", "shingles", n.alias("n"), part.alias("part"), F.slice("hashes", F.lit(1), keep).alias("sketch"), (keep - F.floor(n / 5)).cast("int").alias("need")
    )


def _small(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def contained_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row_key, item_id, n_shingles, n_shared): items contained in documents; row_key is a hash of id and text."""
    items = benchmark_items(benchmark)
    facts = items.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0)), F.collect_set("k")).first()  # at most SHINGLE lengths
    small, lengths = facts[0] <= BROADCAST_ROWS, sorted(facts[1]) or [SHINGLE]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    sketch = items.select("key", "need", F.explode("sketch").alias("h"))
    hashes = F.concat(*[_hashes(F.col("w"), k) for k in lengths])
    seen = rows.select("row_key", words_of(F.col("text")).alias("w")).select("row_key", F.explode(hashes).alias("h"))
    hits = seen.join(_small(sketch, small), "h").groupBy("row_key", "key", "need").agg(F.count_distinct("h").alias("hits")).filter("hits >= need")
    wanted = materialize(hits.groupBy("row_key").agg(F.collect_set("key").alias("keys")), "leak-candidates")
    wanted = _small(wanted, wanted.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0] <= BROADCAST_KEYS)
    texts = rows.join(wanted, "row_key").dropDuplicates(["row_key"]).select("doc_id", "row_key", words_of(F.col("text")).alias("w"), "keys")
    texts = texts.select("doc_id", "row_key", "keys", *[_strings(F.col("w"), k).alias(f"s{k}") for k in lengths])
    pairs = texts.withColumn("key", F.explode("keys")).drop("keys").join(_small(items.select("key", "item_id", "k", "shingles", "n"), small), "key")
    own = _by_length(lengths, F.col("k"), lambda k: F.col(f"s{k}"))
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect(F.col("shingles"), own)))
    return pairs.filter(100 * F.col("n_shared") >= 80 * F.col("n")).select(
        "doc_id", "row_key", "item_id", F.col("n").cast("long").alias("n_shingles"), F.col("n_shared").cast("long").alias("n_shared")
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and contained item: doc_id, item_id, n_shingles, n_shared, containment."""
    found = contained_items(docs, benchmark).drop("row_key")
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows that contain an item."""
    bad = materialize(contained_items(docs, benchmark).select(F.col("row_key").alias("row_key__")).distinct(), "leaks")
    bad = _small(bad, bad.count() <= BROADCAST_KEYS)
    keyed = docs.withColumn("row_key__", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(bad, "row_key__", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def leaks_sql(table: str = "documents", benchmark: str = "benchmark") -> str:
    """DuckDB SQL for leaks, by comparing all shingles."""
    words = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    return f"""
WITH i AS (SELECT DISTINCT item_id, {words} AS w FROM {benchmark}),
k AS (SELECT item_id, w, least({SHINGLE}, len(w)) AS k FROM i WHERE len(w) > 0),
si AS (SELECT item_id, w, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')))) AS s FROM k),
n AS (SELECT item_id, w, count(*) AS n FROM si GROUP BY ALL),
d AS (SELECT DISTINCT doc_id, {words} AS w, text FROM {table}),
sd AS (SELECT doc_id, text, k, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' ')))) AS s
  FROM d, (SELECT DISTINCT k FROM k) kk WHERE len(w) >= k)
SELECT doc_id, item_id, n AS n_shingles, count(*) AS n_shared, count(*) / n AS containment
FROM sd JOIN si USING (k, s) JOIN n USING (item_id, w) GROUP BY doc_id, text, item_id, w, n HAVING 100 * count(*) >= 80 * n"""
