"""Secret scans: pattern spans plus strings of high sliding-window entropy, all in JVM expressions.

Spans are (kind, start, end) in code points, end exclusive. Three kinds come from patterns (leftmost, non-overlapping per
kind); the kind ``entropy`` is added for candidate strings in which some window of WINDOW characters reaches the entropy
of its character class. Entropy spans that touch a pattern span or an allow-listed form are suppressed.

Defined results: a null or empty text has no spans; ids may be null or repeat, each row gets its own result; other columns
of the input are ignored; an empty table gives an empty result. No shuffle takes place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of one class are matched from their first character on, so a shorter run is passed over as a whole, as if matched and dropped.
#: kind -> (pattern; its first group is the value, and least code points of the value)
PATTERNS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    "access": (r"(AKIA[A-Z0-9]{16,})", 20),
    "hex": (r"([0-9a-f]{24,})", 24),
}
#: What a text must hold for a kind to be looked for; true wherever the pattern has a match that counts.
HINTS = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}", "entropy": r"[A-Za-z0-9+/_=-]{20}"}
WINDOW = 20
CANDIDATE = (r"([A-Za-z0-9+/_=-]{20,})", WINDOW)
#: Character classes in order of trial: (name, whole-string form, bits of entropy that a window must reach).
CLASSES = (
    ("hex", r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]+$", 3.0),
    ("upper", r"^(?=.*[0-9].*[0-9])(?=.*[A-Z])[A-Z0-9]+$", 3.3),
    ("mixed", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_=-]+$", 3.8),
    ("lower", r"^(?=.*[0-9].*[0-9].*[0-9])(?=.*[a-z])[a-z0-9_-]+$", 3.5),
)
#: Forms that look random and are none: placeholders, keyboard runs, UUIDs and paths of plain words.
ALLOWED = (
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx|0123456789|abcdefgh",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^/?([A-Za-z_-]+/)+[A-Za-z_-]*$",
)
#: Matches taken at once: Spark copies the state of an aggregate at every step, so long arrays are not carried along.
GATHER = 64
#: Characters of candidates by their place in the count array.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
SPAN = "array<struct<start:int,end:int,rank:int,kind:string,value:string>>"
RANK = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once; inside a lambda a plain column would be computed for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def _moved(s: Column, by: Column) -> Column:
    return F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["value"].alias("value"))


def _spans(text: Column, kind: str, pattern: str, least: int) -> Column:
    """All leftmost non-overlapping matches with their places.

    One pattern walks the text as gap, match, gap, match: the alternative with \\z lets the last gap end the walk at once,
    so a text is read once and no start is tried twice. Places are summed up within runs of GATHER matches, then over runs.
    """
    walk = rf"(?s)(.*?)(?:({pattern})|\z)"
    parts = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(walk), F.lit(i)).alias(n) for i, n in ((1, "gap"), (2, "hit"), (3, "value"))])
    parts = F.transform(parts, lambda x: F.struct(x["gap"].alias("0"), x["hit"].alias("1"), x["value"].alias("2")))
    none = F.from_json(F.lit("[]"), SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        end = start + F.length(x["1"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(RANK[kind]).alias("rank"), F.lit(kind).alias("kind"), x["2"].alias("value"))
        keep = (F.length(x["1"]) > 0) & (F.length(x["2"]) >= least)
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def runs(p: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / GATHER).cast("int"))
        return F.transform(first, lambda c: F.aggregate(F.slice(p, c * GATHER + 1, F.lit(GATHER)), start, step))

    def placed(found: Column) -> Column:
        before = lambda j: F.aggregate(F.slice(found, F.lit(1), j), F.lit(0), lambda acc, x: acc + x["at"])
        return F.flatten(F.transform(found, lambda x, j: _let(before(j), lambda by: F.transform(x["out"], lambda s: _moved(s, by)))))

    return F.when(text.rlike(HINTS[kind]), _let(_let(parts, runs), placed)).otherwise(none)


def _touches(c: Column, spans: Column) -> Column:
    """True if c overlaps one of spans, which are in order and don't overlap each other: binary search for the last one that starts before c ends."""

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        early = F.get(spans, mid)["start"] < c["end"]
        return F.when(acc["lo"] >= acc["hi"], acc).otherwise(F.struct(F.when(early, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(early, acc["hi"]).otherwise(mid).alias("hi")))

    n = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi")), halve, lambda acc: acc["lo"])
    return F.coalesce(F.get(spans, n - 1)["end"] > c["start"], F.lit(False))


def _clear_of(candidates: Column, kinds: list[Column]) -> Column:
    """Candidates that touch no span of any kind."""

    def clear(own: Column, kind: Column) -> Column:
        return F.when(F.size(own) > 0, _let(kind, lambda spans: F.filter(own, lambda c: ~_touches(c, spans)))).otherwise(own)

    for kind in kinds:
        candidates = clear(candidates, kind)
    return candidates


def _weight(n: Column) -> Column:
    """n log2 n, 0 at 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) of the windows of ``window`` characters of s (candidate characters, at least that many).

    The counts of the characters of a window and the sum of n log2 n over them are carried along: a step changes the counts
    of the character that leaves and of the one that enters. The string is split once, so the time is linear in its length.
    """
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    zero = F.array_repeat(F.lit(0), len(ALPHABET) + 1)
    first = F.aggregate(F.slice(codes, 1, window), zero, lambda n, c: F.transform(n, lambda x, i: F.when(i == c, x + 1).otherwise(x)))
    rest = F.greatest(F.size(codes) - window, F.lit(0))
    moves = F.arrays_zip(F.slice(codes, F.lit(1), rest).alias("out"), F.slice(codes, F.lit(window + 1), rest).alias("new"))

    def step(acc: Column, m: Column) -> Column:
        left, came = F.get(acc["n"], m["out"]), F.get(acc["n"], m["new"])
        total = acc["sum"] + _weight(left - 1) - _weight(left) + _weight(came + 1) - _weight(came)
        counts = F.transform(acc["n"], lambda x, i: F.when(i == m["out"], x - 1).when(i == m["new"], x + 1).otherwise(x))
        moved = F.struct(counts.alias("n"), total.alias("sum"), F.least(acc["low"], total).alias("low"))
        return F.when(m["out"] == m["new"], acc).otherwise(moved)

    def begin(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda acc, x: acc + _weight(x))
        return F.struct(n.alias("n"), total.alias("sum"), total.alias("low"))

    low = F.aggregate(moves, begin(first), step)["low"]
    return F.log2(F.lit(float(window))) - low / window


def _random_looking(value: Column) -> Column:
    need = F.lit(None).cast("double")
    for _, form, bits in reversed(CLASSES):
        need = F.when(value.rlike(form), F.lit(bits)).otherwise(need)
    allowed = F.lit(False)
    for form in ALLOWED:
        allowed = allowed | value.rlike(form)
    return F.coalesce(~allowed & need.isNotNull() & (max_window_entropy(value) >= need), F.lit(False))


def _text_of(spans: Column) -> Column:
    """kind:start:end by start, then kind in the order listed."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id and ``found``, the spans of every kind with their values (array of structs)."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), t.alias("t")).select(
        "doc_id", *[_spans(F.col("t"), k, p, n).alias(k) for k, (p, n) in PATTERNS.items()], _spans(F.col("t"), "entropy", *CANDIDATE).alias("candidates")
    )
    patterns = F.concat(*[F.col(k) for k in PATTERNS])
    base = base.withColumn("pattern_spans", patterns)
    base = base.withColumn("candidates", F.filter("candidates", lambda c: _random_looking(c["value"])))
    added = _clear_of(F.col("candidates"), [F.col(k) for k in PATTERNS])
    return base.select("doc_id", *PATTERNS, "pattern_spans", added.alias("entropy"))


def secret_digest(docs: DataFrame) -> DataFrame:
    """Counts per kind, digest of the pattern spans and the list of all spans, per document."""
    s = scan_secrets(docs)
    return s.select(
        F.col("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS],
        F.sha2(_text_of(F.col("pattern_spans")).cast("binary"), 256).alias("base_sha256"),
        _text_of(F.concat("pattern_spans", "entropy")).alias("spans"),
        F.size("entropy").cast("long").alias("n_entropy"),
    )
