"""Mixing sources to target weights.

Texts of a source are laid end to end and cut into blocks of BLOCK words (the last one may be shorter). The mix is a
sequence of output shards of SHARD_SLOTS slots; each draws the source counts for its slots. The draws are multinomial under
the condition that every source meets its quota: slot t of the mix falls to the source in whose range of quotas the place of
t under a pseudorandom permutation of all slots lies. The i-th slot that a source gets over all shards takes block
perm_e(i mod n) of the source's n blocks, e = i div n being the pass and perm_e the pseudorandom permutation of that source
and pass. Blocks are joined to texts by (source, block index).

A permutation is a Feistel network over a grid of a * b >= n places, keyed by seed, source and pass; places from n on are
walked through it again until they fall below n.

Targets: sources in code-point order, null last, weigh WEIGHTS in turn and share all words; a target stops at MOST times
the source's size and the excess is shared anew by weight among the others until none is above.

Defined results: null and empty texts have size 0 and take 0; a null source is a source of its own; null or repeated ids
are rows of their own, and rows equal in id and text are laid out one after the other; an empty table gives an empty result;
other columns are ignored. Reruns agree: nothing depends on partitioning or on random state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize

BLOCK = 64
WEIGHTS = (5, 2, 1)
MOST = 3
SHARD_SLOTS = 65_536
#: Documents per run of the layout, so that no window holds a whole source.
RUN_DOCS = 4096
#: Sources up to this number are broadcast; with more the joins shuffle.
BROADCAST_SOURCES = 50_000
#: Slots that one row of a shard's draw is cut into at most, so that no task lays out a whole shard alone.
CHUNK_SLOTS = 4096
#: Modulus of the round function (a Mersenne prime), its two factors, and the factors of the keys.
PRIME, FACTORS, KEYS = 2**31 - 1, (48_271, 69_621), (7919, 104_729, 1_299_709, 15_485_863)
ROUNDS = 4
#: Walks of a place through the permutation at most; the chance that one more is needed is below n ** (-WALKS / 2).
WALKS = 64
SEED = 17


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_id (from 1), n_docs, source_size, weight, target, n_blocks, quota.

    The repeated resharing has one outcome, found directly: with sources ordered by cap / weight, a source is capped if the
    level left after those before it would lift it above its cap. Windows here run over one row per source.
    """
    s = sized.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    s = s.withColumn("source_id", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    turn = (F.col("source_id") - 1) % len(WEIGHTS)
    weight = F.lit(WEIGHTS[-1])
    for i, w in list(enumerate(WEIGHTS))[:-1]:
        weight = F.when(turn == i, F.lit(w)).otherwise(weight)
    s = s.withColumn("weight", weight.cast("long")).withColumn("cap", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "source_id")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("place", F.row_number().over(order)).withColumn(
        "level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    )
    s = s.withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(everything)["level"]
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight")))
    n_blocks = F.ceil(F.col("source_size") / BLOCK).cast("long")
    quota = F.when(F.col("source_size") > 0, F.least(MOST * n_blocks, F.floor(F.col("target") * n_blocks / F.col("source_size") + 0.5).cast("long"))).otherwise(0)
    return s.select("source", "source_id", "n_docs", "source_size", "weight", "target", n_blocks.alias("n_blocks"), quota.cast("long").alias("quota"))


def _keys(source_id: Column, turn: Column) -> Column:
    """The rounds' keys of a source's permutation of one pass."""
    base = SEED * KEYS[0] + source_id * KEYS[1] + turn * KEYS[2]
    return F.array(*[(base + j * KEYS[3]) % PRIME for j in range(ROUNDS)])


def _feistel(x: Column, a: Column, b: Column, keys: Column) -> Column:
    """A bijection of 0 .. a * b - 1: the two coordinates of x are shifted in turn by a function of the other one."""

    def half(acc: Column, k: Column) -> Column:
        other = F.when(acc["turn"] == 0, acc["r"]).otherwise(acc["l"])
        t = (other + k) % PRIME
        by = ((t * t + FACTORS[0] * t) % PRIME * FACTORS[1] + k) % PRIME
        left = F.when(acc["turn"] == 0, (acc["l"] + by) % a).otherwise(acc["l"])
        right = F.when(acc["turn"] == 0, acc["r"]).otherwise((acc["r"] + by) % b)
        return F.struct(left.alias("l"), right.alias("r"), (1 - acc["turn"]).alias("turn"))

    start = F.struct(F.floor(x / b).cast("long").alias("l"), (x % b).alias("r"), F.lit(0).alias("turn"))
    return F.aggregate(keys, start, half, lambda acc: acc["l"] * b + acc["r"])


def permuted(x: Column, n: Column, source_id: Column, turn: Column) -> Column:
    """Place of x under the permutation of 0 .. n - 1 that belongs to a source and a pass."""
    a = F.ceil(F.sqrt(n)).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")
    keys = _keys(source_id, turn)

    def walk(y: Column) -> Column:
        return F.when(y < n, y).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), y, lambda z, _: F.when(z < n, z).otherwise(_feistel(z, a, b, keys))))

    walked = F.get(F.transform(F.array(_feistel(x, a, b, keys)), walk), 0)
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a place left its permutation's range")).cast("long"))


def draw_shards(sources: DataFrame, small: bool) -> DataFrame:
    """The draws: (shard, source_id, first, n): the source's slots first .. first + n - 1 stand in that shard."""
    spark = sources.sparkSession
    total, count = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    w = Window.orderBy("source_id").rowsBetween(Window.unboundedPreceding, 0)
    ranges = sources.filter("quota > 0").select("source_id", "quota", F.sum("quota").over(w).alias("hi")).withColumn("lo", F.col("hi") - F.col("quota"))
    width = max(1, -(-total // (4 * max(1, count))))
    # a draw falls into the range of a source; the ranges are found by an equi-join on their coarse cells
    cells = ranges.select("source_id", "lo", "hi", F.explode(F.sequence((F.col("lo") / width).cast("long"), ((F.col("hi") - 1) / width).cast("long"))).alias("cell"))
    cells = F.broadcast(cells) if small else cells
    long = lambda x: F.lit(x).cast("long")
    draws = spark.range(total).select((F.col("id") / SHARD_SLOTS).cast("long").alias("shard"), permuted(F.col("id"), long(max(1, total)), long(0), long(0)).alias("u"))
    drawn = draws.withColumn("cell", (F.col("u") / width).cast("long")).join(cells, "cell").filter("u >= lo and u < hi").groupBy("shard", "source_id").agg(F.count("*").alias("n"))
    by_shard = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return drawn.select("shard", "source_id", F.coalesce(F.sum("n").over(by_shard), F.lit(0)).cast("long").alias("first"), "n")


def slot_blocks(sources: DataFrame, shards: DataFrame, small: bool) -> DataFrame:
    """Every slot of the mix: shard, source_id, slot, block."""
    blocks = sources.select("source_id", "n_blocks")
    chunks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK_SLOTS).cast("long"))).alias("chunk")
    rows = shards.select("shard", "source_id", "first", "n", chunks).repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "source_id", "chunk")
    begin = F.col("first") + F.col("chunk") * CHUNK_SLOTS
    rows = rows.select("shard", "source_id", F.explode(F.sequence(begin, F.least(begin + CHUNK_SLOTS, F.col("first") + F.col("n")) - 1)).alias("slot"))
    rows = rows.join(F.broadcast(blocks) if small else blocks, "source_id")
    n, slot = F.col("n_blocks"), F.col("slot")
    return rows.select("shard", "source_id", "slot", permuted(slot % n, n, F.col("source_id"), F.floor(slot / n).cast("long")).alias("block"))


def lay_out(sized: DataFrame, sources: DataFrame, small: bool) -> DataFrame:
    """Per group of rows equal in id and text: doc_id, digest, size, copies, source_id, source_size, target and start, the place of the first word in its source.

    The sum over a source runs in two levels: runs of about RUN_DOCS documents, dealt by the digest, then within a run.
    """
    own = sources.select(F.col("source").alias("s"), "source_id", "source_size", "target", F.ceil(F.col("n_docs") / RUN_DOCS).cast("long").alias("runs"))
    alike = sized.groupBy("source", "doc_id", "digest", "size").agg(F.count("*").alias("copies"))
    rows = alike.join(F.broadcast(own) if small else own, alike["source"].eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("run", F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % F.col("runs"))
    before = Window.partitionBy("source_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("source_id", "run").agg(F.sum(F.col("size") * F.col("copies")).alias("run_size"))
    runs = runs.select("source_id", "run", F.coalesce(F.sum("run_size").over(before), F.lit(0)).alias("run_start"))
    inside = Window.partitionBy("source_id", "run").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0)))
    return rows.join(runs, ["source_id", "run"]).withColumn("start", (F.col("run_start") + F.col("inside")).cast("long")).drop("run", "runs", "inside", "run_start")


def _each_copy(laid: DataFrame) -> DataFrame:
    """A row for each of the equal rows, with its own start."""
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy")
    return laid.select("*", copy).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copy", "copies")


def _blocks(start: Column, size: Column) -> Column:
    """Indices of the blocks that a text of a size from a start on reaches into."""
    return F.sequence((start / BLOCK).cast("long"), ((start + size - 1) / BLOCK).cast("long"))


def _digest(doc_id: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text.cast("string"), F.lit("")))))


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan_mix(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, slots, laid): see ``source_targets``, ``slot_blocks`` and ``lay_out``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    sized = materialize(rows.select("doc_id", "source", size_of(F.col("text")).alias("size"), _digest(F.col("doc_id"), F.col("text")).alias("digest")), "mix-sizes")
    sources = materialize(source_targets(sized), "mix-sources")
    small = sources.count() <= BROADCAST_SOURCES
    return sources, slot_blocks(sources, draw_shards(sources, small), small), lay_out(sized, sources, small)


def mix_digest(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    _, slots, laid = plan_mix(docs)
    laid = _each_copy(laid)
    start, size, block = F.col("start"), F.col("size"), F.col("block")
    spread = laid.filter("size > 0").withColumn("block", F.explode(_blocks(start, size)))
    overlap = F.least(start + size, (block + 1) * BLOCK) - F.greatest(start, block * BLOCK)
    times = slots.groupBy("source_id", "block").agg(F.count("*").alias("times"))
    took = (
        spread.withColumn("overlap", overlap)
        .join(times, ["source_id", "block"], "left")
        .groupBy("doc_id", "size", "source_id", "source_size", "target", "start")
        .agg(F.sum(F.col("overlap") * F.coalesce("times", F.lit(0))).cast("long").alias("taken"))
    )
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    return took.select(*columns).unionByName(laid.filter("size = 0").withColumn("taken", F.lit(0).cast("long")).select(*columns))


def mix_blocks(docs: DataFrame) -> DataFrame:
    """The mix itself: shard, source, slot, block, n_tokens, doc_ids (of the texts in the block, in order) and text (its words joined by a space)."""
    sources, slots, laid = plan_mix(docs)
    laid = materialize(laid.filter("size > 0").select(F.col("doc_id").alias("id__"), F.col("digest").alias("digest__"), "source_id", "size", "copies", "start"), "mix-laid")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), text.alias("text"))
    own = sources.select(F.col("source").alias("s"), F.col("source_id").alias("sid"))
    rows = rows.join(F.broadcast(own) if sources.count() <= BROADCAST_SOURCES else own, rows["source"].eqNullSafe(F.col("s"))).withColumn("digest", _digest(F.col("doc_id"), F.col("text")))
    match = (F.col("digest") == F.col("digest__")) & (F.col("sid") == F.col("source_id")) & F.col("doc_id").eqNullSafe(F.col("id__"))
    found = rows.join(laid.filter("copies = 1"), match).select("doc_id", "source_id", "size", "start", "text")
    several = rows.join(laid.filter("copies > 1"), match).dropDuplicates(["digest", "sid", "id__"])  # of equal rows one stands for all
    found = found.unionByName(_each_copy(several).select("doc_id", "source_id", "size", "start", "text"))

    def pieces(w: Column) -> Column:
        def piece(b: Column) -> Column:
            first, end = F.greatest(F.col("start"), b * BLOCK), F.least(F.col("start") + F.col("size"), (b + 1) * BLOCK)
            # joined here, as an array of words is several times its text
            held = F.array_join(F.slice(w, (first - F.col("start") + 1).cast("int"), (end - first).cast("int")), " ")
            return F.struct(b.alias("block"), (first - b * BLOCK).cast("int").alias("at"), (end - first).cast("int").alias("n"), held.alias("words"))

        return F.transform(_blocks(F.col("start"), F.col("size")), piece)

    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = found.select("doc_id", "source_id", F.explode(F.get(F.transform(F.array(words), pieces), 0)).alias("p")).select("doc_id", "source_id", "p.*")
    packed = cut.groupBy("source_id", "block").agg(F.array_sort(F.collect_list(F.struct("at", "doc_id", "words"))).alias("ps"), F.sum("n").cast("int").alias("n_tokens"))  # a block holds BLOCK words
    packed = packed.select("source_id", "block", F.transform("ps", lambda p: p["doc_id"]).alias("doc_ids"), "n_tokens", F.array_join(F.transform("ps", lambda p: p["words"]), " ").alias("text"))
    names = sources.select("source_id", "source")
    names = F.broadcast(names) if sources.count() <= BROADCAST_SOURCES else names
    return slots.join(packed, ["source_id", "block"]).join(names, "source_id").select("shard", "source", "slot", "block", "n_tokens", "doc_ids", "text")


def mix_sql(table: str) -> str:
    """DuckDB SQL for mix_digest; the draws decide only the order of the mix, so the passes over the blocks suffice."""

    def by(x: str, j: int) -> str:
        k = f"(({SEED * KEYS[0] + j * KEYS[3]} + source_id * {KEYS[1]} + turn * {KEYS[2]}) % {PRIME})"
        t = f"(({x} + {k}) % {PRIME})"
        return f"(({t} * {t} + {FACTORS[0]} * {t}) % {PRIME} * {FACTORS[1]} + {k}) % {PRIME}"

    step = "SELECT source_id, turn, i, n, a, b, y // b AS l, y % b AS r FROM walk WHERE y >= n OR fresh"
    for j in range(ROUNDS):
        change = f"(l + {by('r', j)}) % a AS l, r" if j % 2 == 0 else f"l, (r + {by('l', j)}) % b AS r"
        step = f"SELECT source_id, turn, i, n, a, b, {change} FROM ({step})"
    return f"""
WITH RECURSIVE sized AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS digest, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM {table}),
src AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_id FROM src),
w AS (SELECT *, CASE (source_id - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, {MOST} * source_size AS cap FROM r),
lv AS (SELECT *, row_number() OVER o AS place, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source_id)),
fl AS (SELECT arg_min(level, place) FILTER (WHERE cap >= level * weight) AS flat FROM lv),
t AS (SELECT source, source_id, n_docs, source_size, CASE WHEN cap < level * weight THEN cap::DOUBLE ELSE flat * weight END AS target,
  CAST(ceil(source_size / {BLOCK}.0) AS BIGINT) AS n FROM lv, fl),
q AS (SELECT *, CASE WHEN source_size > 0 THEN least({MOST} * n, CAST(floor(target * n / source_size + 0.5) AS BIGINT)) ELSE 0 END AS quota FROM t),
slots AS (SELECT source_id, n, unnest(range(quota)) AS i FROM q WHERE quota > 0),
grid AS (SELECT source_id, n, i, i // n AS turn, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM slots),
walk AS (SELECT source_id, turn, i, n, a, (n + a - 1) // a AS b, i % n AS y, true AS fresh FROM grid
  UNION ALL SELECT source_id, turn, i, n, a, b, l * b + r AS y, false FROM ({step})),
blocks AS (SELECT source_id, y AS block FROM walk WHERE y < n AND NOT fresh),
times AS (SELECT source_id, block, count(*) AS times FROM blocks GROUP BY ALL),
laid AS (SELECT s.doc_id, s.size, q.source_id, q.source_size, q.target, coalesce(sum(s.size) OVER (PARTITION BY q.source_id
  ORDER BY CAST('0x' || s.digest[1:8] AS BIGINT) % CAST(ceil(q.n_docs / {RUN_DOCS}.0) AS BIGINT), s.doc_id NULLS FIRST, s.digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN q ON s.source IS NOT DISTINCT FROM q.source),
spread AS (SELECT *, unnest(range(CAST(start // {BLOCK} AS BIGINT), CAST((start + size - 1) // {BLOCK} AS BIGINT) + 1)) AS block FROM laid WHERE size > 0),
took AS (SELECT doc_id, size, source_size, target, start, spread.source_id, sum((least(start + size, (block + 1) * {BLOCK}) - greatest(start, block * {BLOCK})) * coalesce(times, 0)) AS taken
  FROM spread LEFT JOIN times USING (source_id, block) GROUP BY ALL)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken FROM took
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM laid WHERE size = 0"""
