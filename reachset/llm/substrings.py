"""Substring dedup by seed and extend.

1. Seeds. In every window of WINDOW words the smallest hash of its ANCHOR-word runs (the leftmost, if it occurs twice) is the
   window's anchor (winnowing), so equal windows have equal anchors at equal places. Neighbouring windows with one anchor
   place are one unit: the words that they cover.
2. Join. Units whose anchor occurs at other places too meet by their anchor. A task sends a unit that it holds more than
   once a single time, with its count. Units of an anchor that is very frequent are cut into single windows first and meet
   by the digest of their words, so no group gathers all the surroundings of a passage that a third of all texts hold.
3. Extension. From the seed on, the units of a group are told apart word by word to the right and to the left; two units
   match as far as they are still together. A window is repeated if its reach to the left and its reach to the right are
   shared by another unit, or if its unit occurs twice. Words themselves are compared, not hashes.
4. Neighbouring repeated windows run together into maximal repeats of WINDOW words or more, which are removed.

What is known of anchors reaches the tasks as two bitmaps of a fixed size; a bit shared by chance only sends a unit to a
join that it need not take part in. Units are recognised by 128-bit BLAKE2 digests of their words.

Words are compared as they are. Defined results: a null or empty text has no words and keeps the empty text; texts of fewer
than WINDOW words lose nothing; repeated rows repeat each other and lose all their windows; null ids are rows like any
other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import bitmap_of, test_bits
from .store import materialize
from .text import Hashed, Words, mix, pieces, rolling, signed

WINDOW = 35
ANCHOR = 8
#: Places of an anchor in a window; a unit's windows start this many words before the anchor's end of reach, at most.
PLACES = WINDOW - ANCHOR + 1
#: Places of an anchor beyond which its units are cut into single windows.
HOT = 20_000
#: Units that a task remembers, and units that are compared at once.
REMEMBERED, TOGETHER = 200_000, 50_000


def anchors_of(words: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Over the words of all texts in a row: the anchor of the window at each place, its place, and which windows lie within a text."""
    n = len(words.h) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    grams = rolling(words.h, ANCHOR)
    best, at = grams[:n].copy(), np.arange(n)
    for j in range(1, PLACES):
        lower = grams[j : j + n] < best
        best[lower] = grams[j : j + n][lower]
        at[lower] = np.flatnonzero(lower) + j
    inside = np.zeros(n + 1, np.int64)
    first, last = words.offsets[:-1], words.offsets[1:] - WINDOW + 1
    some = last > first
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    return best, at, np.cumsum(inside[:-1]) > 0


def units_of(words: Hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, place of the anchor, anchor) of every unit, by place."""
    best, at, inside = anchors_of(words)
    new = inside.copy()
    new[1:] &= ~(inside[:-1] & (at[1:] == at[:-1]))  # between texts lie WINDOW - 1 places outside any window
    first = np.flatnonzero(new)
    ends = np.flatnonzero(inside & ~np.append(inside[1:] & ~new[1:], False)) + 1
    return first, ends - first, at[first], best[first]


def _anchors(batches):
    """(anchor, n): places of each anchor in this task."""
    toks, counts, size = [], [], 0
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def fold():
        u, inverse = np.unique(np.concatenate(toks), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64))], schema=schema)

    for piece in pieces(batches, "text"):
        _, _, _, anchor = units_of(Hashed(piece.column("text"), lower=False))
        u, n = np.unique(anchor, return_counts=True)
        toks.append(u)
        counts.append(n)
        size += len(u)
        if size > 2_000_000:
            yield fold()
            toks, counts, size = [], [], 0
    if toks:
        yield fold()


UNIT = "key long, k1 long, k2 long, lo int, n int, words binary, times long, row_key binary, pos int"
_UNIT = pa.schema([("key", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("n", pa.int32()), ("words", pa.binary()), ("times", pa.int64()), ("row_key", pa.binary()), ("pos", pa.int32())])


def _units(repeated, hot):
    """Rows of two kinds: the places of units (row_key, pos), and the units themselves (words, times) as often as the task forgets them."""

    def run(batches):
        held: dict[bytes, list] = {}
        for piece in pieces(batches, "text"):
            words = Hashed(piece.column("text"), lower=False)
            first, n, at, anchor = units_of(words)
            own = test_bits(repeated.value, anchor)
            first, n, at, anchor = first[own], n[own], at[own], anchor[own]
            cut = test_bits(hot.value, anchor)
            if cut.any():  # one row per window of the units of frequent anchors
                times = np.where(cut, n, 1)
                step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                first, n, at, anchor, cut = np.repeat(first, times) + step, np.repeat(np.where(cut, 1, n), times), np.repeat(at, times), np.repeat(anchor, times), np.repeat(cut, times)
            text = np.searchsorted(words.offsets, first, side="right") - 1
            keys = piece.column("row_key").to_pylist()
            buf = words.buf.tobytes()
            a, b = words.starts[first], words.ends[first + n + WINDOW - 2] if len(first) else first
            lo = first - at
            digests = []
            for x, y, p, m, t, c in zip(a.tolist(), b.tolist(), lo.tolist(), n.tolist(), anchor.tolist(), cut.tolist()):
                covered = b" ".join(buf[x:y].split())
                d = hashlib.blake2b(covered, digest_size=16, person=b"%d" % p).digest()
                digests.append(d)
                seen = held.get(d)
                if seen is None:
                    held[d] = [int.from_bytes(d[:8], "little") if c else t, p, m, covered, 1]
                else:
                    seen[4] += 1
            k = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            none = pa.nulls(len(first))
            places = [k[:, 0], k[:, 1], [keys[t] for t in text.tolist()], (first - words.offsets[text]).astype(np.int32)]
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), pa.array(places[0]), pa.array(places[1]), none.cast(pa.int32()), none.cast(pa.int32()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(places[2], pa.binary()), pa.array(places[3])],
                schema=_UNIT,
            )
            if len(held) > REMEMBERED:
                yield from _told(held)
                held = {}
        yield from _told(held)

    return run


def _told(held: dict[bytes, list]):
    names = list(held.items())
    for c in range(0, len(names), 20_000):
        part = names[c : c + 20_000]
        k = np.frombuffer(b"".join(d for d, _ in part), np.int64).reshape(-1, 2)
        none = pa.nulls(len(part))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(np.array([v[0] for _, v in part], np.uint64))), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([v[1] for _, v in part], pa.int32()), pa.array([v[2] for _, v in part], pa.int32()),
                pa.array([v[3] for _, v in part], pa.binary()), pa.array([v[4] for _, v in part], pa.int64()), none.cast(pa.binary()), none.cast(pa.int32()),
            ],
            schema=_UNIT,
        )


def _classes(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """Number of each pair (a, b) among the distinct pairs; b is below width."""
    return pd.factorize(a * width + b)[0]


def repeated_mask(group: np.ndarray, lo: np.ndarray, n: np.ndarray, words: list[bytes], times: np.ndarray) -> np.ndarray:
    """For each unit the windows that are repeated, as bits from its first window on; units of a group have one anchor.

    lo: place of the first window, seen from the anchor (0 or below); n: windows; times: how often the unit occurs.
    """
    split = [w.split(b" ") for w in words]
    size = np.array([len(s) for s in split])
    codes, vocab = pd.factorize(np.array([w for s in split for w in s], object))
    start = np.cumsum(size) - size
    width = len(vocab) + 1  # the code beyond the vocabulary stands for no word

    def word(place: int) -> np.ndarray:
        """Code of each unit's word at a place, seen from the anchor."""
        at = place - lo
        there = (at >= 0) & (at < size)
        return np.where(there, codes[np.minimum(start + np.maximum(at, 0), len(codes) - 1)], width - 1)

    right = [pd.factorize(group)[0]]  # right[d]: units together up to place d
    for d in range(WINDOW):
        right.append(_classes(right[-1], word(d), width))
    left = [np.zeros(len(group), np.int64)]  # left[d]: units together from place -d on
    for d in range(1, PLACES):
        left.append(_classes(left[-1], word(-d), width))
    mask = np.zeros(len(group), np.int64)
    for back in range(PLACES):  # the window that starts back words before the anchor
        has = (lo <= -back) & (-back < lo + n)
        if not has.any():
            continue
        both = _classes(right[WINDOW - back][has], left[back][has], len(group) + 1)
        total = np.bincount(both, weights=times[has])
        mask[has] |= (total[both] > 1).astype(np.int64) << (-back - lo[has])
    return mask


def _extend(batches):
    """Masks of the units of whole groups; the last group of a run of rows waits for its rest."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def judged(t: pa.Table):
        k1, k2 = t.column("k1").to_numpy(), t.column("k2").to_numpy()
        order = np.lexsort((k2, k1, t.column("key").to_numpy()))
        new = np.append(True, (k1[order][1:] != k1[order][:-1]) | (k2[order][1:] != k2[order][:-1]))
        which = order[new]
        times = np.add.reduceat(t.column("times").to_numpy()[order], np.flatnonzero(new))
        key = t.column("key").to_numpy()[which]
        take = t.take(pa.array(which))
        lo, n = (take.column(c).to_numpy().astype(np.int64) for c in ("lo", "n"))
        mask = repeated_mask(key, lo, n, take.column("words").to_pylist(), times)
        some = np.flatnonzero(mask)
        return pa.RecordBatch.from_arrays([pa.array(k1[which][some]), pa.array(k2[which][some]), pa.array(mask[some].astype(np.int32))], names=["k1", "k2", "mask"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            t = pa.Table.from_batches(held)
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield judged(t.slice(0, cut))
            held, rows = t.slice(cut).to_batches(), 0 if cut else rows // 2
    if held:
        yield judged(pa.Table.from_batches(held))


def repeated_windows(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs(row_key, text) -> (row_key, found): place of the first window of a unit, and the mask of its repeated windows."""
    spark = docs.sparkSession
    counted = materialize(docs.select("text").mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1"), "anchors")
    repeated = spark.sparkContext.broadcast(bitmap_of(counted, F.col("anchor")))
    frequent = spark.sparkContext.broadcast(bitmap_of(counted.filter(F.col("n") > hot), F.col("anchor"), bits=1 << 23))
    units = materialize(docs.mapInArrow(_units(repeated, frequent), UNIT), "units")
    groups = units.filter("times is not null").select("key", "k1", "k2", "lo", "n", "words", "times").repartition("key").sortWithinPartitions("key")
    masks = materialize(groups.mapInArrow(_extend, "k1 long, k2 long, mask int"), "unit-masks")
    places = units.filter("row_key is not null").select("k1", "k2", "row_key", "pos")
    return places.join(masks, ["k1", "k2"]).groupBy("row_key").agg(F.collect_set(F.struct("pos", "mask")).alias("found"))


def _cut(batches):
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("repeats", spans_type)])
    for piece in pieces(batches, "text"):
        words = Words(piece.column("text"), lower=False)
        vocab = words.vocab.to_pylist()
        removed, digests, kept, repeats = [], [], [], []
        for i, found in enumerate(piece.column("found")):
            own = words.codes[words.offsets[i] : words.offsets[i + 1]]
            spans = []
            stay = own
            if found.is_valid:
                pos, mask = (found.values.field(c).to_numpy().astype(np.int64) for c in ("pos", "mask"))
                s = np.concatenate([pos[(mask >> j) & 1 == 1] + j for j in range(PLACES)])
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + WINDOW, -1)
                gone = np.cumsum(edge[:-1]) > 0
                stay = own[~gone]
                turn = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False]))))
                spans = [{"first": int(a), "end": int(b)} for a, b in zip(turn[::2], turn[1::2])]
            text = " ".join([vocab[c] for c in stay.tolist()])
            removed.append(len(own) - len(stay))
            digests.append(hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
            kept.append(text)
            repeats.append(spans)
        yield pa.RecordBatch.from_arrays(
            [piece.column("doc_id"), pa.array(np.diff(words.offsets)), pa.array(removed, pa.int64()), pa.array(digests), pa.array(kept, pa.string()), pa.array(repeats, spans_type)], schema=schema
        )


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a space) and repeats (word places first .. end - 1)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # equal rows share a key, and what is repeated in them
    digest = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"), 256)
    rows = rows.withColumn("row_key", F.substring(F.unhex(digest), 1, 16))
    found = repeated_windows(rows.select("row_key", "text"), hot)
    out = rows.join(found, "row_key", "left").select("doc_id", "text", "found")
    return out.mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, repeats array<struct<first:int,end:int>>")


def repeats_digest(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept", "repeats")


def repeats_sql(table: str) -> str:
    """DuckDB SQL for repeats_digest, over the word sequences of all windows."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}),
g AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS p, w FROM d WHERE len(w) >= {WINDOW}),
s AS (SELECT r, p, md5(array_to_string(w[p:p + {WINDOW - 1}], ' ')) AS s FROM g),
twice AS (SELECT s FROM s GROUP BY s HAVING count(*) > 1),
starts AS (SELECT r, p FROM s SEMI JOIN twice USING (s)),
gone AS (SELECT DISTINCT r, unnest(range(p, p + {WINDOW})) AS p FROM starts),
by_row AS (SELECT r, list(p) AS ps FROM gone GROUP BY r),
k AS (SELECT doc_id, w, coalesce(len(ps), 0) AS n_removed, ps, r FROM d LEFT JOIN by_row USING (r)),
flat AS (SELECT k.r, i, w[i] AS word FROM k, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) WHERE n_removed > 0),
kept AS (SELECT flat.r, string_agg(word, ' ' ORDER BY i) AS t FROM flat ANTI JOIN gone ON flat.r = gone.r AND flat.i = gone.p GROUP BY flat.r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
  sha256(CASE WHEN n_removed = 0 THEN array_to_string(w, ' ') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM k LEFT JOIN kept USING (r)"""
