"""Line dedup by an exact set-similarity join.

A line's tokens are its distinct words (A-Z lowered). Two lines match at a Jaccard similarity of 4/5 or more. A line is
removed if an earlier line, by (doc_id, line number), matches it; what is earlier and what matches is judged on the input.

1. Tokens are ordered by rarity: a table of BUCKETS counts over all lines, of a fixed size whatever the corpus, gives each
   token's frequency.
2. A line of n tokens offers its first floor(n / 5) + 1 tokens (prefix filter; below 4 tokens only equal sets match). In place
   of a token that is very frequent it offers the pairs of it with each later token of one place more: lines that first share
   a token share a second one within that reach, so a frequent token brings no long run of lines together. Lines that share
   an offer meet; length filter, positional filter and a signature of 128 bits (of long lines, 256), which
   bounds how many tokens two lines share, leave pairs that may match.
3. What such pairs connect meets under a hub, its smallest key, with its words, and is joined in order with a prefix index; a
   line's first match ends its search, so a group of copies costs a step each.

Equal sets are one class (by 128 bits of two hashes): only its first line takes part, and the other lines of the class go
without a join. Words are compared as 64-bit hashes.

Defined results: null and empty texts, and lines without words, lose nothing; rows that share an id are told apart by their
texts, and equal rows are one document; a null id comes after all others; an empty table gives an empty result; other
columns are kept where a whole table is returned. The digest has one row per id, over all rows that share it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import LINE_BITS, bitmap_of, test_bits
from .ngram_join import grouped
from .routing import in_blocks, needed_overlap, prefix_length
from .store import materialize, release
from .text import Hashed, list_array, mix, pieces, signed

BUCKETS = 1 << 21
PART = 1 << 14  # buckets in one row of the frequency table
#: Sets below this size match equal sets only.
LEAST = 4
#: Lines that share an offer are compared pair by pair up to this number; beyond it neighbours by size are taken together.
LONG_RUN = 16_384
#: Offers compared at once.
TOGETHER = 200_000
#: Occurrences of a token bucket from which its offers are pairs of tokens.
HOT = 200_000
#: Line sets that a task remembers as offered.
REMEMBERED = 500_000
#: Beyond this number of tokens a line has the longer signature as well, as 128 bits would fill up.
WHOLE = 128


class LineTokens:
    """Tokens of the lines of n texts: h and line of each, before repetitions within a line are dropped."""

    def __init__(self, texts: pa.Array):
        words = Hashed(texts, lower=True)
        self.line, self.owner, self.number = words.lines()
        self.h = words.h

    def ordered(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tokens (h, line), by line and within a line by rarity, then hash; rank: rarity of each bucket."""
        if len(self.owner) >= 1 << 22:  # the line does not fit beside the rest of a key
            order = np.lexsort((self.h, rank[_bucket(self.h)], self.line))
            h, line = self.h[order], self.line[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
            return h[new], line[new]
        top = self.h >> np.uint64(32)
        key = (self.line.astype(np.uint64) << np.uint64(42)) | (rank[_bucket(self.h)].astype(np.uint64) << np.uint64(32)) | top
        order = np.argsort(key)
        key, h = key[order], self.h[order]
        again = np.flatnonzero((key[1:] == key[:-1]) & (h[1:] != h[:-1]))
        for i in np.unique(key[again]) if len(again) else ():  # upper halves of the hashes agree: the lower ones decide
            a, b = np.searchsorted(key, [i, i + np.uint64(1)])
            h[a:b] = np.sort(h[a:b])
        line = (key >> np.uint64(42)).astype(np.int64)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        return h[new], line[new]


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 21)).astype(np.int64)


def _frequencies(batches):
    counts, held, size = np.zeros(BUCKETS, np.int64), [], 0
    for piece in pieces(batches, "text"):
        held.append(_bucket(LineTokens(piece.column("text")).h))
        size += len(held[-1])
        if size > 4_000_000:
            counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
            held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
    if counts.any():
        rows = np.minimum(counts, 2**32 - 1).astype(np.uint32).reshape(-1, PART)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array([x.tobytes() for x in rows], pa.binary())], names=["part", "counts"])


def _sum_parts(batches):
    for t in grouped(batches, ("part",)):
        total = np.zeros(PART, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.uint32)
        total = np.minimum(total, 2**32 - 1).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([t.column("part").combine_chunks()[:1], pa.array([total.tobytes()], pa.binary())], names=["part", "counts"])


def token_ranks(texts: DataFrame) -> np.ndarray:
    """Rarity of each token bucket, 0 (unseen) to 1023 (commonest), from the counts over all lines: 2 * BUCKETS bytes."""
    parts = texts.mapInArrow(_frequencies, "part long, counts binary").repartition("part").sortWithinPartitions("part")
    counts = np.zeros(BUCKETS, np.uint32)
    for r in parts.mapInArrow(_sum_parts, "part long, counts binary").toLocalIterator():
        counts[r["part"] * PART : (r["part"] + 1) * PART] = np.frombuffer(r["counts"], np.uint32)
    return (np.log2(counts.astype(float) + 1) * 31).astype(np.uint16)


LINE = "member long, row long, line_no int, k1 long, k2 long, n int, toks array<long>, places array<int>, mark long, mark2 long, more binary"


def _offered(h: np.ndarray, line: np.ndarray, start: np.ndarray, n: np.ndarray, fresh: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, key, place) of every offer of the fresh lines, by line; hot tells which of the tokens h are very frequent."""
    place = np.arange(len(line)) - start[line]
    reach = prefix_length(n)[line]
    early = fresh[line] & (place < reach)
    single = np.flatnonzero(early & ~hot)
    first = np.flatnonzero(early & hot)
    with_later = reach[first] - place[first]  # the places up to reach, that one included, behind this one
    with_later = np.minimum(with_later, n[line[first]] - 1 - place[first])
    a = np.repeat(first, with_later)
    b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(with_later) - with_later, with_later)
    with np.errstate(over="ignore"):
        key = np.concatenate([h[single], mix(h[a] * np.uint64(0x9E3779B97F4A7C15) + h[b])])
    at = np.concatenate([single, a])
    order = np.argsort(line[at], kind="stable")
    return line[at][order], key[order], place[at][order]


def _offers(shared, hot_from: int = HOT):
    hot_rank = math.log2(hot_from + 1) * 31
    schema = pa.schema([("member", pa.int64()), ("row", pa.int64()), ("line_no", pa.int32()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int32()), ("toks", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("mark", pa.int64()), ("mark2", pa.int64()), ("more", pa.binary())])

    def run(batches):
        rank, offered = shared.value, set()
        for piece in pieces(batches, "text"):
            t = LineTokens(piece.column("text"))
            h, line = t.ordered(rank)
            n = np.bincount(line, minlength=len(t.owner))
            start = np.cumsum(n) - n
            has = np.flatnonzero(n)
            with np.errstate(over="ignore"):
                k1 = np.add.reduceat(mix(h), start[has]) if len(has) else np.zeros(0, np.uint64)
                k2 = np.add.reduceat(mix(h ^ np.uint64(0x5851F42D4C957F2D)), start[has]) if len(has) else np.zeros(0, np.uint64)
            k1, k2 = signed(k1), signed(k2)
            # a set that this task has offered before is not offered again
            fresh = np.zeros(len(t.owner), bool)
            if len(offered) > REMEMBERED:
                offered.clear()
            for i, k, big in zip(has.tolist(), zip(k1.tolist(), k2.tolist()), (n[has] >= LEAST).tolist()):
                if big and k not in offered:
                    offered.add(k)
                    fresh[i] = True
            of_line, toks, places = _offered(h, line, start, n, fresh, rank[_bucket(h)] >= hot_rank)
            per_line = np.bincount(of_line, minlength=len(t.owner))[has]
            bits = np.zeros((len(t.owner), 4), np.uint64)
            covered = fresh[line]
            of, x = line[covered], h[covered] >> np.uint64(7)
            np.bitwise_or.at(bits, (of, ((x >> np.uint64(6)) & np.uint64(3)).astype(np.int64)), np.uint64(1) << (x & np.uint64(63)))
            mark = bits[:, :2] | bits[:, 2:]
            more = [b.tobytes() if long else None for b, long in zip(bits[has], (n[has] > WHOLE) & fresh[has])]
            ids, rows = piece.column("member").to_numpy(), piece.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[t.owner[has]]), pa.array(rows[t.owner[has]]), pa.array(t.number[has].astype(np.int32)), pa.array(k1), pa.array(k2), pa.array(n[has].astype(np.int32)),
                    list_array(signed(toks), per_line, pa.int64()), list_array(places.astype(np.int32), per_line, pa.int32()), pa.array(signed(mark[has, 0])), pa.array(signed(mark[has, 1])), pa.array(more, pa.binary()),
                ],
                schema=schema,
            )

    return run


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    up = parent[x]
    while (up != x).any():
        x, up = up, parent[up]
    return x


def _near_rows(t: pa.Table):
    """(hub, member) of the lines in sorted offer runs that may match another line of their run; possible pairs have a hub in common."""
    tok = t.column("tok").to_numpy()
    same = tok[1:] == tok[:-1]
    shared = np.append(same, False) | np.append(False, same) if len(tok) else np.zeros(0, bool)
    where = np.flatnonzero(shared)
    tok, key, n, place, mark, mark2 = tok[shared], *(t.column(c).to_numpy()[shared] for c in ("k1", "n", "place", "mark", "mark2"))
    order = np.lexsort((key, n, tok))
    # several tasks may offer a class
    new = np.ones(len(order), bool)
    new[1:] = (tok[order][1:] != tok[order][:-1]) | (key[order][1:] != key[order][:-1])
    order = order[new]
    tok, key, n, place, mark = tok[order], key[order], n[order].astype(np.int64), place[order].astype(np.int64), np.stack([mark[order], mark2[order]], axis=1).view(np.uint64)
    spare = n - np.bitwise_count(mark).sum(axis=1, dtype=np.int64)
    long = np.flatnonzero(n > WHOLE)
    more = np.frombuffer(b"".join(t.column("more").take(pa.array(where[order[long]])).to_pylist()), np.uint64).reshape(-1, 4)
    spare_long = n[long] - np.bitwise_count(more).sum(axis=1, dtype=np.int64)
    place_long = np.cumsum(n > WHOLE) - 1
    change = np.ones(len(tok), bool)
    change[1:] = tok[1:] != tok[:-1]
    cuts = np.flatnonzero(change)
    length = np.diff(np.append(cuts, len(tok)))
    run = np.repeat(np.arange(len(cuts)), length)
    parent = np.arange(len(tok))
    # in a run that is too long, whatever a chain of fitting sizes connects may match
    chained = np.flatnonzero((length[run][1:] > LONG_RUN) & (run[1:] == run[:-1]) & (5 * n[:-1] >= 4 * n[1:])) + 1
    head = np.arange(len(tok))
    head[chained] = 0
    parent = np.maximum.accumulate(head)
    open_ = np.flatnonzero(length[run] <= LONG_RUN)  # rows whose run may reach the next distance
    d = 0
    while len(open_):
        d += 1
        open_ = open_[open_ + d < len(tok)]
        open_ = open_[run[open_] == run[open_ + d]]
        open_ = open_[5 * n[open_] >= 4 * n[open_ + d]]  # sizes rise within a run
        if d & (d - 1) == 0 and d >= 16 and len(open_):  # runs that are joined already
            root = _find(parent, np.arange(len(tok)))
            low, high = np.minimum.reduceat(root, cuts), np.maximum.reduceat(root, cuts)
            open_ = open_[(low != high)[run[open_]]]
        a, b = open_, open_ + d
        need = needed_overlap(n[a], n[b])
        ok = np.minimum(n[a] - place[a], n[b] - place[b]) >= need
        a, b, need = a[ok], b[ok], need[ok]
        ok = np.bitwise_count(mark[a] & mark[b]).sum(axis=1, dtype=np.int64) + np.minimum(spare[a], spare[b]) >= need
        both = np.flatnonzero(ok & (n[a] > WHOLE))  # b is no smaller
        x, y = place_long[a[both]], place_long[b[both]]
        ok[both] = np.bitwise_count(more[x] & more[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare_long[x], spare_long[y]) >= need[both]
        a, b = a[ok], b[ok]
        ra, rb = _find(parent, a), _find(parent, b)
        for x, y in zip(ra[ra != rb].tolist(), rb[ra != rb].tolist()):
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            parent[max(x, y)] = min(x, y)
    root = _find(parent, np.arange(len(tok)))
    alive = np.bincount(root, minlength=len(tok))[root] > 1
    hub = np.full(len(tok), np.iinfo(np.int64).max)
    np.minimum.at(hub, root, key)
    found = np.unique(np.stack([hub[root][alive], key[alive]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["hub", "member"])


def _near(batches):
    """Whole offer runs at a time; the last run of the rows held waits for its rest."""
    held: list[pa.RecordBatch] = []
    rows, enough = 0, TOGETHER
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= enough:
            t = pa.Table.from_batches(held)
            tok = t.column("tok").to_numpy()
            cut = int(np.searchsorted(tok, tok[-1]))
            if cut:
                yield _near_rows(t.slice(0, cut))
            held = t.slice(cut).to_batches()
            rows -= cut
            enough = max(TOGETHER, 2 * rows)
    if held:
        yield _near_rows(pa.Table.from_batches(held))


def _changes(rows, keys: tuple[str, ...]) -> np.ndarray:
    """True where a row's keys differ from those of the row before; rows is not empty."""
    change = np.zeros(rows.num_rows, bool)
    change[0] = True
    for k in keys:
        c = rows.column(k).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return change


def _whole_groups(batches, keys: tuple[str, ...]):
    """Tables of whole groups from sorted batches; the last group of a batch waits for its rest."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        cut = int(np.flatnonzero(_changes(batch, keys))[-1])
        if cut == 0 and held and all(held[-1].column(k)[0] == batch.column(k)[0] for k in keys):
            held.append(batch)
            continue
        rows = pa.Table.from_batches([*held, batch.slice(0, cut)])
        if rows.num_rows:
            yield rows
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _late_rows(t: pa.Table, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (k1, k2) of the classes for which an earlier class of their group matches; t holds whole groups (hub, i, j)."""
    group = np.cumsum(_changes(t, ("hub", "i", "j")))
    order = np.lexsort((t.column("row").to_numpy(), t.column("line_no").to_numpy(), t.column("doc").to_numpy(), group))
    keys, second, group = t.column("k1").to_numpy()[order], t.column("k2").to_numpy()[order], group[order]
    h, line = LineTokens(t.column("line").combine_chunks().take(pa.array(order))).ordered(rank)
    # repeated rows bring a line twice
    first = np.lexsort((np.arange(len(keys)), second, keys, group))
    new = np.ones(len(first), bool)
    new[1:] = (keys[first][1:] != keys[first][:-1]) | (second[first][1:] != second[first][:-1]) | (group[first][1:] != group[first][:-1])
    ends = np.cumsum(np.bincount(line, minlength=len(keys)))
    ordered = h.tolist()
    index: dict[int, list[tuple[int, int]]] = {}
    sets: dict[int, set[int]] = {}
    late = []
    now = -1
    for x in np.sort(first[new]).tolist():
        if group[x] != now:
            now = group[x]
            index.clear()
            sets.clear()
        toks = ordered[ends[x - 1] if x else 0 : ends[x]]
        own, n = set(toks), len(toks)
        early = toks[: prefix_length(n)]
        tried: set[int] = set()
        match = False
        for place, tok in enumerate(early):
            for y, other in index.get(tok, ()):
                m = len(sets[y])
                if y in tried or 5 * min(n, m) < 4 * max(n, m):
                    continue
                need = needed_overlap(n, m)
                if min(n - place, m - other) < need:
                    continue
                tried.add(y)
                if len(own & sets[y]) >= need:
                    match = True
                    break
            if match:
                break
        sets[x] = own
        for place, tok in enumerate(early):
            index.setdefault(tok, []).append((x, place))
        if match:
            late.append(x)
    return keys[late], second[late]


def _late(shared):
    def run(batches):
        for t in _whole_groups(pieces(batches, "line"), ("hub", "i", "j")):
            k1, k2 = _late_rows(t, shared.value)
            if len(k1):
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2)], names=["k1", "k2"])

    return run


def _rows(docs: DataFrame) -> DataFrame:
    """member: the id, a null one after all others; row: a hash of the text, which tells rows of one id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("member"), F.xxhash64(text).alias("row"), text.alias("text"))


#: Odd factor below 2^32, so that its product with a line number fits in 63 bits.
SPREAD = 2654435761


def _line_key(row: Column, line_no: Column) -> Column:
    """The row's text hash and the line number in one number; see ``_lines_of``."""
    return row.bitwiseXOR(line_no.cast("long") * F.lit(SPREAD))


def _lines_of(shared):
    """The lines whose bit is set, with their places; of a long text only the few that are sought."""

    def run(batches):
        for piece in pieces(batches, "text"):
            texts = piece.column("text")
            n = piece.num_rows
            where = np.frombuffer(texts.buffers()[1], np.int32, n + 1, texts.offset * 4).astype(np.int64)
            buf = np.frombuffer(texts.buffers()[2], np.uint8, int(where[-1])) if where[-1] else np.zeros(0, np.uint8)
            feeds = np.flatnonzero(buf[where[0] : where[-1]] == 10) + where[0]
            per_text = np.searchsorted(feeds, where[1:]) - np.searchsorted(feeds, where[:-1])
            owner = np.repeat(np.arange(n), per_text + 1)
            first = np.cumsum(per_text + 1) - per_text - 1
            number = np.arange(len(owner)) - first[owner]
            # a line starts at its text's start or behind a feed, and ends at a feed or its text's end
            starts, ends = np.empty(len(owner), np.int64), np.empty(len(owner), np.int64)
            starts[number > 0], starts[first] = feeds + 1, where[:-1]
            ends[np.append(number[1:] > 0, False)], ends[first + per_text] = feeds, where[1:]
            row = piece.column("row").to_numpy()
            key = row[owner].view(np.uint64) ^ (number * SPREAD).view(np.uint64)
            at = np.flatnonzero(test_bits(shared.value, key))
            if len(at):
                lines = [buf[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(piece.column("member").to_numpy()[owner[at]]), pa.array(row[owner[at]]), pa.array(number[at].astype(np.int32)), pa.array(lines, pa.string())], names=["doc", "row", "line_no", "line"]
                )

    return run


def judge_lines(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(member, row, line_no, gone) for every line with a word; member is the id, the largest long for a null one."""
    spark = docs.sparkSession
    rows = _rows(docs)
    shared = spark.sparkContext.broadcast(token_ranks(rows.select("text")))
    lines = materialize(rows.mapInArrow(_offers(shared, hot), LINE), "lines")
    first = lines.groupBy("k1", "k2").agg(F.min(F.struct("member", "line_no", "row")).alias("f"), F.max("n").alias("n"), F.count("*").alias("times"))
    first = materialize(first.select("k1", "k2", F.col("f.member").alias("doc"), F.col("f.row").alias("row"), F.col("f.line_no").alias("line_no"), "n", "times"), "line-classes")
    offers = lines.filter(F.size("toks") > 0).select(F.explode(F.arrays_zip("toks", "places")).alias("o"), "k1", "n", "mark", "mark2", "more").select(F.col("o.toks").alias("tok"), "k1", "n", F.col("o.places").alias("place"), "mark", "mark2", "more")
    near = offers.repartition("tok").sortWithinPartitions("tok").mapInArrow(_near, "hub long, member long")
    near = materialize(near.distinct(), "line-near")
    wanted = near.select(F.col("member").alias("k1")).distinct().join(first.drop("times"), "k1")
    wanted = materialize(wanted, "line-wanted")
    tasks = in_blocks(near.join(wanted.withColumnRenamed("k1", "member"), "member"), "n").select("hub", "i", "j", F.col("member").alias("k1"), "k2", "doc", "row", "line_no")
    # single lines, not texts, are moved: of a long text only the few lines that may match
    bits = spark.sparkContext.broadcast(bitmap_of(wanted, _line_key(F.col("row"), F.col("line_no")), LINE_BITS))
    found = rows.mapInArrow(_lines_of(bits), "doc long, row long, line_no int, line string")
    tasks = tasks.hint("merge").join(found, ["doc", "row", "line_no"])  # no size bound: never broadcast
    tasks = tasks.select("hub", "i", "j", "k1", "k2", "doc", "row", "line_no", "line").repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    late = materialize(tasks.mapInArrow(_late(shared), "k1 long, k2 long").distinct(), "line-late")
    release(near, wanted)
    # a line goes if its class is late or has an earlier line; classes of one line that aren't late need no join
    heads = first.filter("times > 1").select("k1", "k2", F.col("doc").alias("d"), F.col("row").alias("r"), F.col("line_no").alias("l")).join(late.withColumn("late", F.lit(True)), ["k1", "k2"], "full")
    behind = (F.col("member") != F.col("d")) | (F.col("line_no") != F.col("l")) | (F.col("row") != F.col("r"))
    gone = F.coalesce("late", F.lit(False)) | F.coalesce(behind, F.lit(False))
    return lines.select("member", "row", "line_no", "k1", "k2").join(heads, ["k1", "k2"], "left").select("member", "row", "line_no", gone.alias("gone"))


def dedup_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_lines (lines with a word), n_removed, removed_lines (their numbers from 0, comma-joined)."""
    judged = judge_lines(docs)
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("member")).distinct()
    by_doc = judged.groupBy("member").agg(F.size(F.collect_set("line_no")).alias("n_lines"), F.array_sort(F.collect_set(F.when(F.col("gone"), F.col("line_no")))).alias("gone"))
    out = ids.join(by_doc, "member", "left")
    return out.select(
        F.when(F.col("member") < 2**63 - 1, F.col("member")).alias("doc_id"),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("gone", ","), F.lit("")).alias("removed_lines"),
    )


def _without(text: Column, gone: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains(gone, i))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the removed lines taken out of text; rows and columns stay."""
    gone = judge_lines(docs).filter("gone").groupBy(F.col("member").alias("member__"), F.col("row").alias("row__")).agg(F.collect_set("line_no").alias("gone__"))
    own = (F.coalesce(docs["doc_id"].cast("long"), F.lit(2**63 - 1)) == F.col("member__")) & (F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("row__"))
    out = docs.join(gone, own, "left")
    return out.withColumn("text", _without(docs["text"], F.col("gone__"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def dedup_sql(table: str) -> str:
    """DuckDB SQL for dedup_digest."""
    return f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {table}),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM d),
s AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'))) AS s FROM l),
w AS (SELECT * FROM s WHERE len(s) > 0),
c AS (SELECT s, row_number() OVER (ORDER BY min((doc_id, line_no))) AS id, min((doc_id, line_no)) AS f, len(s) AS n FROM w GROUP BY s),
t AS (SELECT id, n, unnest(s) AS tok FROM c),
df AS (SELECT tok, count(*) AS df FROM t GROUP BY tok),
r AS (SELECT id, n, tok, row_number() OVER (PARTITION BY id ORDER BY df, tok) AS place FROM t JOIN df USING (tok)),
p AS (SELECT * FROM r WHERE place <= n // 5 + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.tok = b.tok AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
late AS (SELECT DISTINCT b FROM pairs JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE 9 * len(list_intersect(x.s, y.s)) >= 4 * (x.n + y.n)),
gone AS (SELECT w.doc_id, w.line_no FROM w JOIN c ON w.s = c.s WHERE (w.doc_id, w.line_no) <> c.f OR c.id IN (SELECT b FROM late))
SELECT i.doc_id, (SELECT count(*) FROM w WHERE w.doc_id = i.doc_id) AS n_lines, count(g.line_no) AS n_removed,
  coalesce(string_agg(CAST(g.line_no AS VARCHAR), ',' ORDER BY g.line_no), '') AS removed_lines
FROM (SELECT DISTINCT doc_id FROM {table}) i LEFT JOIN gone g USING (doc_id) GROUP BY i.doc_id"""
