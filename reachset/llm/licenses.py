"""License scans by diagonal voting.

All rolling word k-grams of a text are hashed and joined to the positions of the same k-grams in the templates. A hit at
text position p and template position q votes for the diagonal p - q. Votes are added up per (document, template,
diagonal); neighbouring diagonals, which an inserted or lost word separates, are merged in bands of a bounded width, two
sets of bands that overlap by half. A band whose distinct template positions are enough goes on to the verification: the
longest chain of its hits that rises in the text and in the template, which is the span, must hold LEAST_SHARE of the
template's k-grams. A k-gram that the text repeats counts once. Hits are compared word by word, so a hash collision never
counts.

Defined results: a null or empty text has no words, no spans, empty labels and score 0; ids may be null or repeat (each row
is scanned on its own); an empty table gives an empty result; other columns of the input are ignored. The template table
is fixed in size, so it is broadcast.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .license_texts import TEXTS
from .store import materialize

K = 3
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that alone name a license (fixed values of the query's contract).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Width of a band of diagonals; share of a text template's k-grams that a span must hold.
BAND, LEAST_SHARE = 64, 0.5


def words_of(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, WORD_BREAK), lambda w: w != "")


def template_rows() -> list[tuple]:
    """(template, label, is_phrase, k-grams in the template, position, the k words)."""
    rows = []
    for i, (text, label, phrase) in enumerate([(t, la, True) for t, la in PHRASES.items()] + [(t, la, False) for la, t in TEXTS]):
        w = [x for x in re.split(WORD_BREAK, text.lower()) if x]
        rows += [(i, label, phrase, len(w) - K + 1, p, w[p : p + K]) for p in range(len(w) - K + 1)]
    return rows


def _gram_hash(w: list[Column]) -> Column:
    return F.xxhash64(*w)


def scan_hits(words: DataFrame) -> DataFrame:
    """k-gram hits of a table (row_id, words): row_id, pos, template, label, is_phrase, grams, tpos."""
    spark = words.sparkSession
    t = spark.createDataFrame(template_rows(), "template int, label string, is_phrase boolean, grams int, tpos int, gram array<string>")
    t = t.withColumn("h", _gram_hash([F.col("gram")[i] for i in range(K)]))
    hashed = F.transform(
        F.col("words"), lambda w, i: F.xxhash64(w, *[F.get(F.col("words"), i + F.lit(j)) for j in range(1, K)])
    )
    rows = words.filter(F.size("words") >= K).select("row_id", "words", F.posexplode(hashed).alias("pos", "h"))
    found = rows.join(F.broadcast(t), "h")
    same = F.slice(F.col("words"), F.col("pos") + 1, K) == F.col("gram")
    return found.filter(same).select("row_id", F.col("pos").cast("long").alias("pos"), "template", "label", "is_phrase", "grams", "tpos")


def longest_chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of (pos, tpos) that rises strictly in both."""
    ends: list[int] = []  # smallest last tpos of a chain of each length
    last: list[int] = []  # and the hit that ends it
    before = [-1] * len(hits)
    hits = sorted(hits, key=lambda h: (h[0], -h[1]))
    for i, (_, t) in enumerate(hits):
        at = bisect_left(ends, t)
        before[i] = last[at - 1] if at else -1
        ends[at : at + 1] = [t]
        last[at : at + 1] = [i]
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append(hits[i])
        i = before[i]
    return chain[::-1]


def _aligned(batches):
    """Bands of hits -> their longest chains: first and last text position, share of the template's k-grams."""
    for b in batches:
        chains = [longest_chain([(h["pos"], h["tpos"]) for h in hits]) for hits in b.column("hits").to_pylist()]
        share = [len(c) / g for c, g in zip(chains, b.column("grams").to_pylist())]
        first, end = (pa.array(x, pa.int64()) for x in ([c[0][0] for c in chains], [c[-1][0] + K for c in chains]))
        kept = ("row_id", "template", "label", "is_phrase")
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], first, end, pa.array(share)], names=[*kept, "first_word", "end_word", "share"])


def vote(hits: DataFrame) -> DataFrame:
    """Verified spans: row_id, template, label, is_phrase, first_word, end_word (exclusive), share.

    A phrase counts only where one diagonal holds all its k-grams; a text template where a chain of hits holds enough.
    """
    diagonal = F.col("pos") - F.col("tpos")
    votes = hits.filter("is_phrase").groupBy("row_id", "template", "label", "is_phrase", "grams", diagonal.alias("diagonal")).agg(F.count("*").alias("votes"))
    phrases = votes.filter(F.col("votes") == F.col("grams")).select(
        "row_id", "template", "label", "is_phrase", F.col("diagonal").alias("first_word"), (F.col("diagonal") + F.col("grams") + K - 1).alias("end_word"), F.lit(1.0).alias("share")
    )
    # every diagonal lies in a band of each of the two sets
    sets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor((diagonal + i * BAND // 2) / BAND).alias("band")) for i in (0, 1)]))
    banded = hits.filter(~F.col("is_phrase")).select("*", sets.alias("s")).select("*", "s.i", "s.band")
    key = ["row_id", "template", "label", "is_phrase", "grams", "i", "band"]
    held = banded.groupBy(*key, "tpos").agg(F.collect_list("pos").alias("at")).groupBy(*key).agg(F.count("*").alias("held"), F.collect_list(F.struct("tpos", "at")).alias("found"))
    held = held.filter(F.col("held") >= LEAST_SHARE * F.col("grams"))
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["at"], lambda p: F.struct(p.cast("int").alias("pos"), f["tpos"].alias("tpos")))))
    out = StructType(held.select("row_id", "template", "label", "is_phrase").schema.fields).add("first_word", "long").add("end_word", "long").add("share", "double")
    spans = held.select("row_id", "template", "label", "is_phrase", "grams", flat.alias("hits")).mapInArrow(_aligned, out).filter(F.col("share") >= LEAST_SHARE)
    return phrases.unionByName(spans.distinct())


def license_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, places and labels of the phrases, labels with those of the text templates, score.

    score is 1 where a phrase stands, else the best share of a template, else 0.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a row's key: its id and text together name the result, so repeated rows share one
    rows = docs.select("doc_id", t.alias("t")).select("doc_id", F.xxhash64("t").alias("th"), words_of(F.col("t")).alias("words"))
    keyed = rows.select(F.struct("doc_id", "th").alias("row_id"), "words")
    counted = rows.select("doc_id", "th", F.size("words").cast("long").alias("n_words"))
    hits = materialize(scan_hits(keyed).distinct(), "license-hits")  # repeated rows would vote twice; both kinds of votes read the hits
    spans = vote(hits)
    base = F.col("is_phrase")
    found = spans.groupBy("row_id").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"),
        F.min(F.when(base, F.col("first_word"))).alias("first_word"),
        F.max(F.when(base, F.col("first_word"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    found = found.select(F.col("row_id.doc_id").alias("f_id"), F.col("row_id.th").alias("f_th"), *[c for c in found.columns if c != "row_id"])
    joined = counted.join(found, counted["doc_id"].eqNullSafe(found["f_id"]) & (counted["th"] == found["f_th"]), "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
