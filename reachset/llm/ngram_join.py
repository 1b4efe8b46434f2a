"""N-gram Jaccard join of documents with signature trees.

A document's set holds its distinct 5-word shingles (A-Z lowered); a text of fewer words is one shingle, a text without
words has the empty set and links with nothing. Two documents link at 100 * intersection >= 80 * union.

1. Documents with equal sets (by 128 bits of two hashes) form a class, and one row stands for it; classes, not rows, are routed.
2. Classes that may be similar meet under hubs (see ``routing``). Shingles that many documents hold come last in the
   token order, so a shared passage brings few unrelated documents together.
3. Under each hub a signature tree is built over the members' token bitmaps: a node holds the OR of the bitmaps below it,
   their range of sizes and their largest number of colliding tokens. A traversal of the tree against itself passes over
   pairs of nodes whose sizes don't fit or whose largest possible overlap is too small, and those already joined. Only
   members that are left with a possible partner go on, with their texts, to the exact comparison of all that may link,
   over the same kind of tree; it returns a spanning forest of the links, so a group of copies never becomes all pairs.
4. Connected components over the links give the classes of linked documents.

Shingles are compared as 64-bit hashes, texts are found again by 128 bits. Defined results: null text is empty; a null id takes part like any other, and a
component made only of null ids has a null component_id; repeated rows are linked copies; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitmap import only_members
from .components import components
from .routing import hubs_of, in_blocks, needed_overlap, prefix_length
from .store import materialize, release
from .text import Hashed, list_array, mix, pieces, rolling, signed

SHINGLE = 5
#: A shingle is counted as common in a task from LOCAL documents on; the COMMON most common ones come last in the order.
LOCAL, COMMON = 8, 131_072
LEAF, FAN = 8, 8
MAX_BITS = 1 << 14
#: Node pairs taken at once; each has FAN * FAN pairs below it.
STEP = 4096
#: Shingles of the texts that a block holds.
TEXT_WEIGHT = 1_000_000


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = Hashed(texts, lower=True)
    h = words.h
    grams = rolling(h, SHINGLE)
    out = []
    for a, b in zip(words.offsets, words.offsets[1:]):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(grams[a : b - SHINGLE + 1]))
        elif n:
            with np.errstate(over="ignore"):
                out.append(rolling(h[a:b], int(n)) + np.uint64(n))
        else:
            out.append(h[:0])
    return out


def _set_key(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(signed(np.array([mix(s).sum(dtype=np.uint64)]))[0]), int(signed(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)]))[0])


def _common(batches):
    """(tok, n): shingles that LOCAL or more documents of this task hold."""
    held, size = [], 0
    toks, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def fold():
        u, n = np.unique(np.concatenate(held), return_counts=True)
        more = n > 1  # a shingle seen once in a run of texts waits for no other
        u2, inverse = np.unique(np.concatenate([toks, u[more]]), return_inverse=True)
        return u2, np.bincount(inverse, weights=np.concatenate([counts, n[more]]), minlength=len(u2)).astype(np.int64)

    for piece in pieces(batches, "text"):
        sets = shingle_sets(piece.column("text"))
        held += sets
        size += sum(map(len, sets))
        if size > 3_000_000:
            toks, counts = fold()
            held, size = [], 0
    if held:
        toks, counts = fold()
    keep = counts >= LOCAL
    yield pa.RecordBatch.from_arrays([pa.array(signed(toks[keep]), pa.int64()), pa.array(counts[keep], pa.int64())], names=["tok", "n"])


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the most common shingles, COMMON at most. They only steer the order; results don't depend on them."""
    counted = materialize(texts.mapInArrow(_common, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n")), "common-shingles")
    sizes = {r["k"]: r["c"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("c")).collect()}
    k, kept = 64, 0
    while k > 0 and kept + sizes.get(k - 1, 0) <= COMMON:
        k -= 1
        kept += sizes.get(k, 0)
    return np.sort(counted.filter(F.floor(F.log2("n")) >= k).select("tok").toPandas()["tok"].to_numpy(np.int64).view(np.uint64))


PREFIX = "row_id long, doc_id long, t1 long, t2 long, n long, k1 long, k2 long, prefix array<long>, bits binary"


def _prefixes(common: np.ndarray):
    schema = pa.schema([(c, pa.int64()) for c in ("row_id", "doc_id", "t1", "t2", "n", "k1", "k2")] + [("prefix", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches):
        row_id = TaskContext.get().partitionId() << 36
        for piece in pieces(batches, "text"):
            sets = shingle_sets(piece.column("text"))
            keys = np.array([_set_key(s) for s in sets], np.int64).reshape(-1, 2)
            chosen = []
            for s in sets:
                p = int(prefix_length(len(s))) if len(s) else 0
                if len(common) and len(s):
                    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
                    late = common[at] == s
                    if late[: p + 1].any():
                        s = np.concatenate([s[~late], s[late]])
                chosen.append(s[:p])
            lens = np.array([len(c) for c in chosen], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row_id + np.arange(len(sets))), *[piece.column(c) for c in ("doc_id", "t1", "t2")], pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(keys[:, 0]), pa.array(keys[:, 1]),
                    list_array(signed(np.concatenate(chosen)), lens, pa.int64()), pa.array([token_bitmap(s, bitmap_width(len(s))).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                schema=schema,
            )
            row_id += len(sets)

    return run


def bitmap_width(n: int) -> int:
    """Bits of the bitmap of a set of n tokens: a power of two of at least n."""
    return max(64, 1 << (n - 1).bit_length())


def token_bitmap(s: np.ndarray, width: int) -> np.ndarray:
    row = np.zeros(width, bool)
    row[(s & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(row).view(np.uint64)


class Tree:
    """Signature tree over sets in a given order: their sizes n and their bitmaps, all of one width."""

    def __init__(self, n: np.ndarray, bits: np.ndarray):
        spare = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        # level 0: the sets; each further level holds the nodes over FAN (first LEAF) of the level below
        self.bits, self.low, self.high, self.spare, self.fan = [bits], [n], [n], [spare], []
        while len(self.low[-1]) > 1:
            fan = LEAF if len(self.low) == 1 else FAN
            cuts = np.arange(0, len(self.low[-1]), fan)
            self.fan.append(fan)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cuts, axis=0))
            self.low.append(np.minimum.reduceat(self.low[-1], cuts))
            self.high.append(np.maximum.reduceat(self.high[-1], cuts))
            self.spare.append(np.maximum.reduceat(self.spare[-1], cuts))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs of nodes of a level can hold two sets that link."""
        low, high, spare, bits = self.low[level], self.high[level], self.spare[level], self.bits[level]
        ok = (5 * high[a] >= 4 * low[b]) & (5 * high[b] >= 4 * low[a])
        at = np.flatnonzero(ok)
        for c in range(0, len(at), STEP):
            part = at[c : c + STEP]
            x, y = a[part], b[part]
            most = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(spare[x], spare[y])
            most = np.minimum(most, np.minimum(high[x], high[y]))
            ok[part] = most >= needed_overlap(low[x], low[y])
        return ok


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


class Forest:
    """Union-find over m items."""

    def __init__(self, m: int):
        self.parent = np.arange(m)

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, i: int, j: int) -> bool:
        x, y = self.find(i), self.find(j)
        self.parent[max(x, y)] = min(x, y)
        return x != y

    def roots(self) -> np.ndarray:
        p = self.parent
        while (p != p[p]).any():
            p = p[p]
        self.parent = p
        return p


def traverse(tree: Tree, forest: Forest, visit) -> None:
    """Dual traversal of the tree with itself: visit(i, j) for every pair that may link and isn't joined in the forest."""
    m, top = len(tree.low[0]), len(tree.low) - 1
    stack = [(top, np.array([0]), np.array([0]))]
    while stack:
        level, a, b = stack.pop()
        if len(a) > STEP:
            stack += [(level, a[c : c + STEP], b[c : c + STEP]) for c in range(0, len(a), STEP)]
            continue
        root = forest.roots()
        if level == 0:
            apart = (a < b) & (root[a] != root[b])
            a, b = a[apart], b[apart]
            keep = tree.may_link(0, a, b)
            for i, j in zip(a[keep].tolist(), b[keep].tolist()):
                visit(i, j)
            continue
        cuts = np.arange(0, m, int(np.prod(tree.fan[:level])))
        first, last = np.minimum.reduceat(root, cuts), np.maximum.reduceat(root, cuts)
        apart = (first[a] != last[a]) | (first[b] != last[b]) | (first[a] != first[b])
        a, b = a[apart], b[apart]
        keep = tree.may_link(level, a, b)
        a, b = a[keep], b[keep]
        if not len(a):
            continue
        fan, below = tree.fan[level - 1], len(tree.low[level - 1])
        ca = (a[:, None, None] * fan + np.arange(fan)[None, :, None] + np.zeros((1, 1, fan), np.int64)).ravel()
        cb = (b[:, None, None] * fan + np.arange(fan)[None, None, :] + np.zeros((1, fan, 1), np.int64)).ravel()
        real = (ca < below) & (cb < below) & (ca <= cb)
        stack.append((level - 1, ca[real], cb[real]))


def possible_groups(n: np.ndarray, bitmaps: list[bytes]) -> np.ndarray:
    """Label of each set; sets that may link, judged by sizes and bitmaps, have one label."""
    width = np.array([len(b) * 8 for b in bitmaps])
    forest = Forest(len(n))
    for w in np.unique(width):
        # sets whose sizes fit have equal or neighbouring widths; of the wider ones, those that fit a set of width w are folded
        own = np.flatnonzero((width == w) | ((width == 2 * w) & (4 * n <= 5 * w)))
        own = own[np.argsort(n[own], kind="stable")]
        if len(own) < 2:
            continue
        bits = np.zeros((len(own), w // 64), np.uint64)
        for r, i in enumerate(own):
            x = np.frombuffer(bitmaps[i], np.uint64)
            bits[r] = x if width[i] == w else x[: w // 64] | x[w // 64 :]
        tree = Tree(n[own], bits)
        local = Forest(len(own))
        for i in range(1, len(own)):  # neighbours by size, and the first of each run of fitting sizes
            if tree.may_link(0, np.array([i - 1]), np.array([i]))[0]:
                local.union(i - 1, i)
        traverse(tree, local, local.union)
        for r, root in zip(own.tolist(), local.roots().tolist()):
            forest.union(r, int(own[root]))
    return forest.roots()


def spanning_links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest of the links between sets (indices). Exact: a pair is passed over only if it can't link or is linked already."""
    m = len(sets)
    order = sorted(range(m), key=lambda i: (len(sets[i]), int(sets[i][0])))
    own = [sets[i] for i in order]
    forest = Forest(m)
    links: list[tuple[int, int]] = []

    def visit(i: int, j: int) -> None:
        if forest.find(i) == forest.find(j):
            return
        a, b = own[i], own[j]
        if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and _overlap(a, b) >= needed_overlap(len(a), len(b)):
            forest.union(i, j)
            links.append((order[i], order[j]))

    # neighbours in the order and the first set join most of a group of near copies at once
    for i in range(1, m):
        visit(i - 1, i)
        visit(0, i)
    if m > 2 and (forest.roots() != 0).any():
        n = np.array([len(s) for s in own])
        width = min(MAX_BITS, bitmap_width(2 * int(n.max())))
        traverse(Tree(n, np.stack([token_bitmap(s, width) for s in own])), forest, visit)
    return links


def grouped(batches, keys: tuple[str, ...]):
    """Runs of rows with equal keys from batches sorted by them; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = np.append(np.flatnonzero(change), batch.num_rows)
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _possible(batches):
    schema = pa.schema([("member", pa.int64()), ("part", pa.int64())])
    for t in grouped(batches, ("hub", "i", "j")):
        member = t.column("member").to_numpy()
        label = possible_groups(t.column("n").to_numpy(), t.column("bits").to_pylist())
        _, inverse, counts = np.unique(label, return_inverse=True, return_counts=True)
        keep = counts[inverse] > 1
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(member[keep]), pa.array(member[label[keep]])], schema=schema)


def _links(batches):
    for t in grouped(batches, ("hub", "i", "j")):
        sets, members, seen = [], [], set()
        for piece in pieces(t.to_batches(), "text"):
            for member, s in zip(piece.column("member").to_pylist(), shingle_sets(piece.column("text"))):
                if len(s) and member not in seen:  # several tasks may bring a text
                    seen.add(member)
                    sets.append(s)
                    members.append(member)
        if len(sets) > 1 and (found := spanning_links(sets)):
            yield pa.RecordBatch.from_arrays([pa.array([members[i] for i, _ in found], pa.int64()), pa.array([members[j] for _, j in found], pa.int64())], names=["a", "b"])


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and its 128 bits t1, t2."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return rows.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), "text")


def join_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links).

    members: per row doc_id, t1, t2, n, k1, k2; classes: per set k1, k2, member (its id), low (smallest doc_id), root (the class
    that stands for all linked ones); links: pairs of classes, a spanning forest of all.
    """
    rows = _rows(docs)
    common = common_shingles(rows.select("text"))
    prefix = materialize(rows.mapInArrow(_prefixes(common), PREFIX), "shingle-prefixes")
    sets = materialize(prefix.filter("n > 0").groupBy("k1", "k2").agg(F.min("row_id").alias("member"), F.min("doc_id").alias("low")), "shingle-classes")
    heads = prefix.join(sets.select(F.col("member").alias("row_id")), "row_id", "left_semi").drop("k1", "k2", "doc_id").withColumnRenamed("row_id", "member")
    heads = materialize(heads, "shingle-heads")
    sizes = heads.select("member", "n")
    hubs = materialize(hubs_of(heads.select("member", F.explode("prefix").alias("tok"))), "shingle-hubs")
    own = materialize(hubs.join(sizes, "member"), "shingle-routes")
    routed = in_blocks(own, "n").drop("n").join(heads.select("member", "n", "bits"), "member")
    near = routed.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j").select("hub", "i", "j", "member", "n", "bits")
    near = materialize(near.mapInArrow(_possible, "member long, part long").distinct(), "shingle-near")
    release(hubs, own)
    # members that may link, over all hubs, with each member's text once; the list has no size bound, so it is never broadcast
    loose = components(near.select(F.col("member").alias("a"), F.col("part").alias("b")))
    loose = materialize(loose.select(F.col("node").alias("member"), F.col("root").alias("hub")).join(heads.select("member", "n", "t1", "t2"), "member"), "shingle-loose")
    tasks = in_blocks(loose, "n", TEXT_WEIGHT).select("hub", "i", "j", "member", "t1", "t2")
    texts = only_members(rows.select("t1", "t2", "text"), loose, "t1", "t2", once=True)
    tasks = tasks.hint("merge").join(texts, ["t1", "t2"]).select("hub", "i", "j", "member", "text")
    tasks = tasks.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    links = materialize(tasks.mapInArrow(_links, "a long, b long").distinct(), "shingle-links")
    release(near, loose, heads)
    found = components(links)
    classes = sets.join(found, F.col("member") == F.col("node"), "left").select("k1", "k2", "member", "low", F.coalesce("root", "member").alias("root"))
    return prefix.select("doc_id", "t1", "t2", "n", "k1", "k2"), materialize(classes, "shingle-components"), links


def join_digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id linked to it, itself included)."""
    members, classes, _ = join_documents(docs)
    lowest = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    named = classes.join(lowest, "root").select("k1", "k2", "component_id")
    out = members.filter("n > 0").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(members.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of linked rows: that with the smallest id (null last), then the smallest text hash.

    Rows without words stay. Rows that are equal in id and text are linked copies too, and one of them stays.
    """
    members, classes, _ = join_documents(docs)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")
    rows = members.filter("n > 0").join(classes.select("k1", "k2", "root"), ["k1", "k2"])
    first = rows.groupBy("root").agg(F.min(place).alias("p")).select("p.doc_id", "p.t1", "p.t2")
    alike = members.filter("n > 0").groupBy("doc_id", "t1", "t2").agg(F.count("*").alias("times"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["t1"] == b["t1"]) & (a["t2"] == b["t2"])
    first = materialize(first.join(alike, same(first, alike)).select(first["doc_id"].alias("id__"), first["t1"].alias("t1__"), first["t2"].alias("t2__"), F.col("times").alias("times__")), "shingle-first")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.withColumn("u1__", F.xxhash64(text)).withColumn("u2__", F.xxhash64(F.lit(7), text))
    match = keyed["doc_id"].cast("long").eqNullSafe(F.col("id__")) & (F.col("u1__") == F.col("t1__")) & (F.col("u2__") == F.col("t2__"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    single = keyed.join(first.filter("times__ = 1"), match, "left_semi").select(*names)
    several = keyed.join(first.filter("times__ > 1"), match).dropDuplicates(["id__", "t1__", "t2__"]).select(*names)
    return single.unionByName(several).unionByName(docs.filter(~F.coalesce(docs["text"].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")))


def join_sql(table: str) -> str:
    """DuckDB SQL for join_digest; rows with equal shingle sets count as one in the pairs."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {table}),
g AS (SELECT doc_id, CASE WHEN len(w) >= {SHINGLE} THEN list_sort(list_distinct(list_transform(range(1, len(w) - {SHINGLE - 2}), lambda p: array_to_string(w[p:p + {SHINGLE - 1}], ' '))))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ') || chr(10) || len(w)] ELSE [] END AS s FROM d),
c AS MATERIALIZED (SELECT s, len(s) AS n, min(doc_id) AS id FROM g WHERE len(s) > 0 GROUP BY s),
t AS MATERIALIZED (SELECT id, n, unnest(s) AS sh FROM c),
o AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS m FROM t a JOIN t b ON a.sh = b.sh AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * m >= 80 * (na + nb - m)),
u AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
cc(id, k) USING KEY (id) AS (SELECT id, id FROM c UNION
  SELECT id, k FROM (SELECT u.b AS id, min(cc.k) AS k, any_value(r.k) AS old FROM cc JOIN u ON u.a = cc.id JOIN recurring.cc r ON r.id = u.b GROUP BY u.b) WHERE k < old)
SELECT g.doc_id, CAST(len(g.s) AS BIGINT) AS n_shingles, CASE WHEN len(g.s) = 0 THEN g.doc_id ELSE cc.k END AS component_id
FROM g LEFT JOIN c USING (s) LEFT JOIN cc ON cc.id = c.id"""
