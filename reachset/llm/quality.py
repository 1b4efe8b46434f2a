"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per failed rule; a policy is a
named, versioned mask over those bits, so changing a policy or asking what a rule costs never reads a text again.

Defined results: a null or empty text has no words and fails the length rule; null ids stay null; duplicate rows give
duplicate ledger rows; an empty table gives an empty ledger; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, pieces

#: Rules in bit order. Bits are never renumbered; new rules take the next bit.
RULES = ("too_short", "repeated_windows", "symbol_heavy", "shouting", "duplicate_lines", "odd_word_length", "too_long")
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version of the verdict: a document is rejected if any rule of the mask failed."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base-1", ("too_short", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("web-1", RULES), Policy("web-2", tuple(r for r in RULES if r != "too_long")), Policy("lenient-1", ("too_short", "repeated_windows", "symbol_heavy", "shouting")))}
#: Size alone is no fault: web-2 is web-1 without too_long.
DEFAULT = "web-2"

LEDGER = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper_words long, failed long"
)


def _repeat_words(codes: np.ndarray, width: int) -> int:
    """Words inside 3-word windows that occur at least twice in one text; width: size of the vocabulary."""
    n = len(codes) - 2
    if n < 2:
        return 0
    if width < 1 << 21:
        key = (codes[:n] << 42) | (codes[1 : n + 1] << 21) | codes[2:]
    else:
        _, own = np.unique(codes, return_inverse=True)  # a text has far fewer than 2^21 distinct words, or is split below
        key = (own[:n].astype(object) * (1 << 64) + own[1 : n + 1]) * (1 << 64) + own[2:] if own.max() >= 1 << 21 else (own[:n] << 42) | (own[1 : n + 1] << 21) | own[2:]
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[inverse] >= 2
    if not twice.any():
        return 0
    covered = np.zeros(len(codes), bool)
    covered[:n] |= twice
    covered[1 : n + 1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def _counts_by(owner: np.ndarray, weight: np.ndarray | None, n: int) -> np.ndarray:
    return np.bincount(owner, weights=weight, minlength=n).astype(np.int64)


def _measure(batches):
    schema = pa.schema([("doc_id", pa.int64())] + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")])
    for piece in pieces(batches, "text"):
        texts = pc.fill_null(piece.column("text"), "")
        n = piece.num_rows
        words = Words(texts, lower=False)
        lengths = pc.utf8_length(words.vocab).to_numpy(zero_copy_only=False).astype(np.int64)
        upper = pc.and_(pc.equal(words.vocab, pc.utf8_upper(words.vocab)), pc.not_equal(words.vocab, pc.utf8_lower(words.vocab))).to_numpy(zero_copy_only=False)
        upper = upper & (lengths > 1)
        owner = words.owner()
        repeat = np.fromiter((_repeat_words(words.codes[a:b], len(words.vocab)) for a, b in zip(words.offsets, words.offsets[1:])), np.int64, n)
        lines = pc.split_pattern(texts, "\n")
        line_owner = np.repeat(np.arange(n), pc.list_value_length(lines).to_numpy(zero_copy_only=False))
        coded = lines.flatten().dictionary_encode()
        has_word = pc.match_substring_regex(coded.dictionary, r"[^ \t-\r]").to_numpy(zero_copy_only=False) if len(coded.dictionary) else np.zeros(0, bool)
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        good = has_word[ids]
        pair = line_owner[good] * max(1, len(coded.dictionary)) + ids[good]
        _, first = np.unique(pair, return_index=True)
        n_lines = _counts_by(line_owner[good], None, n)
        distinct = _counts_by(line_owner[good][first], None, n)
        symbols = pc.count_substring_regex(texts, r"[#*$%&|<>]").to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id").cast(pa.int64())]
            + [pa.array(x, pa.int64()) for x in (np.diff(words.offsets), _counts_by(owner, lengths[words.codes], n), symbols, n_lines - distinct, repeat, n_lines, _counts_by(owner, upper[words.codes], n))],
            schema=schema,
        )


def _failed(rule: str) -> Column:
    n, c = F.col("n_words"), F.col
    return {
        "too_short": n < 50,
        "repeated_windows": 100 * c("n_repeat_words") > 50 * n,
        "symbol_heavy": 10 * c("n_symbols") > n,
        "shouting": 100 * c("n_upper_words") > 40 * n,
        "duplicate_lines": (c("n_lines") > 3) & (100 * c("n_dup_lines") > 40 * c("n_lines")),
        "odd_word_length": (c("word_chars") < 2 * n) | (c("word_chars") > 14 * n),
        "too_long": n > 1_000_000,
    }[rule]


def build_ledger(docs: DataFrame) -> DataFrame:
    """One row per document: the measurements and ``failed``, the bits of the rules that it fails. One scan, no shuffle."""
    measured = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_measure, LEDGER.rpartition(",")[0])
    bits = [F.when(_failed(r), F.lit(BIT[r])).otherwise(F.lit(0)) for r in RULES]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed", total.cast("long"))


def apply_policy(ledger: DataFrame, version: str = DEFAULT) -> DataFrame:
    """Add base_failed and kept under a policy version: pure bit tests on the ledger."""
    mask = POLICIES[version].mask
    return ledger.withColumn("base_failed", F.col("failed").bitwiseAND(F.lit(BASE.mask)) != 0).withColumn(
        "kept", ~F.col("base_failed") & (F.col("failed").bitwiseAND(F.lit(mask)) == 0)
    )


def ablations(ledger: DataFrame, version: str = "web-1") -> DataFrame:
    """Per rule of a policy (web-1 has all rules): documents failing it, documents that only it rejects, and documents kept without it.

    The ledger is first reduced to counts per bitmask (at most 2^rules rows), whatever its size.
    """
    mask = POLICIES[version].mask
    by_mask = ledger.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = [r for r in RULES if BIT[r] & mask]
    table = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in rules]))
    rows = by_mask.select("bits", "n", table.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return rows.groupBy("rule").agg(
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits").isin(0) | (F.col("bits") == F.col("bit")), F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def quality_sql(table: str) -> str:
    """DuckDB SQL for apply_policy(build_ledger(...)) under the default policy."""
    failed = {
        "too_short": "n_words < 50", "repeated_windows": "100 * n_repeat_words > 50 * n_words", "symbol_heavy": "10 * n_symbols > n_words", "shouting": "100 * n_upper_words > 40 * n_words",
        "duplicate_lines": "n_lines > 3 AND 100 * n_dup_lines > 40 * n_lines", "odd_word_length": "word_chars < 2 * n_words OR word_chars > 14 * n_words", "too_long": "n_words > 1000000",
    }
    bits = " + ".join(f"CASE WHEN {failed[r]} THEN {BIT[r]} ELSE 0 END" for r in RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS p, w FROM d WHERE len(w) > 2),
k AS (SELECT r, p, w[p:p + 2] AS s FROM g),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM k) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM twice) GROUP BY r),
l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS BIGINT) AS n_upper_words
  FROM d JOIN l USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, CAST({bits} AS BIGINT) AS failed FROM m)
SELECT *, failed & {BASE.mask} <> 0 AS base_failed, failed & {BASE.mask | POLICIES[DEFAULT].mask} = 0 AS kept FROM f"""
