"""LM scoring with a hidden Markov language model.

Latent states emit word classes: the OWN most frequent words are classes of their own, the others fall into hash classes, so
the emission table has a fixed size; within its class a word has its smoothed share of the training counts. The states start
far apart: for each of the ANCHORS most frequent words the class distribution of the texts that hold it is added up over all
training texts, and the states take those that lie farthest from each other (languages and kinds of text, mostly). Baum-Welch
then runs over all training texts until the likelihood gains less than TOLERANCE, ITERATIONS times at most: each task adds up
the expected counts of its texts, and only the sums per parameter leave the executors. Scaled forward recursion gives the exact likelihood of
a whole text; texts are cut into segments whose transfer matrices are computed side by side and then chained, which is the
same recursion in another order of multiplication.

Word counts stay distributed: words above a frequency threshold, chosen so that at most BIG_WORDS pass, are sent to the
tasks as a table; the others are looked up by a join.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text in the training rule;
repeated rows are scored one by one and counted one by one in training; with no training text every word is unknown; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngram_join import grouped
from .store import materialize
from .text import Hashed, list_array, pieces, signed

#: Words that are classes of their own, and hash classes for the others.
OWN, HASHED = 3584, 512
CLASSES = OWN + HASHED
END_CLASS = CLASSES
#: Hash given to the end token.
END = 0x0F7A3C5D9B1E2468
STATES = 6
ITERATIONS, TOLERANCE = 3, 1e-3
#: Frequent words whose surroundings the states may start from.
ANCHORS = 64
SEGMENT = 32
BIG_WORDS = 131_072


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


class Classes:
    """Class of a word by its hash: own holds the hashes of the words that are classes of their own, most frequent first."""

    def __init__(self, own: np.ndarray):
        order = np.argsort(own)
        self.sorted, self.number = own[order], order

    def __call__(self, h: np.ndarray) -> np.ndarray:
        out = OWN + (h >> np.uint64(55)).astype(np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == h, self.number[at], out)
        return out


def _count(batches):
    """(tok, n): counts of the words of the rows given, end tokens included."""
    toks, counts, held = [], [], 0
    schema = pa.schema([("tok", pa.int64()), ("n", pa.int64())])

    def merged():
        u, inverse = np.unique(np.concatenate(toks), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(signed(u)), pa.array(np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64))], schema=schema)

    for piece in pieces(batches, "text"):
        words = Coded(piece.column("text"))
        toks += [words.vocab, np.array([END], np.uint64)]
        counts += [np.bincount(words.codes, minlength=len(words.vocab)), np.array([piece.num_rows])]
        held += len(words.vocab)
        if held > 1_500_000:
            yield merged()
            toks, counts, held = [], [], 0
    if toks:
        yield merged()


class Coded:
    """Words of n texts as codes into their distinct hashes."""

    def __init__(self, texts: pa.Array):
        words = Hashed(texts, lower=True)
        codes, self.vocab = pd.factorize(words.h)
        self.codes, self.offsets, self.owner = codes.astype(np.int64), words.offsets, words.owner


class Segments:
    """Class sequences of n texts (end class last) as padded segments of SEGMENT tokens."""

    def __init__(self, words: Coded, word_class: np.ndarray):
        lens = np.diff(words.offsets) + 1
        n = len(lens)
        ends = np.cumsum(lens)
        cls = np.empty(int(ends[-1]), np.int64)
        is_end = np.zeros(len(cls), bool)
        is_end[ends - 1] = True
        cls[is_end] = END_CLASS
        cls[~is_end] = word_class[words.codes]
        self.count = -(-lens // SEGMENT)
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1]))
        total = int(self.count.sum())
        self.doc = np.repeat(np.arange(n), self.count)
        self.place = np.arange(total) - self.first[self.doc]
        starts = np.concatenate(([0], ends[:-1]))
        at = (starts[self.doc] + self.place * SEGMENT)[:, None] + np.arange(SEGMENT)
        self.valid = at < ends[self.doc][:, None]
        self.cls = np.where(self.valid, cls[np.minimum(at, len(cls) - 1)], END_CLASS + 1)
        order = np.argsort(self.place, kind="stable")
        cuts = np.searchsorted(self.place[order], np.arange(int(self.count.max()) + 1))
        self.by_place = [order[a:b] for a, b in zip(cuts, cuts[1:])]  # segments by their place in the text


class Model:
    """Transition matrix a (S, S) and emissions b (S, classes + end); texts start from equal state weights."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.a = a
        self.b = np.ascontiguousarray(np.vstack([b.T, np.ones((1, len(a)))]))  # by class; the last row is padding

    def transfer(self, s: Segments):
        """Matrix of each segment, scaled to sum 1, and the logarithm of its scale."""
        states, total = len(self.a), len(s.doc)
        m = np.broadcast_to(np.eye(states), (total, states, states)).copy()
        scale = np.zeros(total)
        for t in range(SEGMENT):
            live = s.valid[:, t]
            step = (m.reshape(-1, states) @ self.a).reshape(total, states, states) * self.b[s.cls[:, t]][:, None, :]
            if not live.all():
                step[~live] = m[~live]
            z = step.sum(axis=(1, 2))
            m = step / z[:, None, None]
            scale += np.log(z)
        return m, scale

    def chain(self, s: Segments, m: np.ndarray, scale: np.ndarray):
        """State weights before each segment and the log likelihood of each text."""
        states = len(self.a)
        before = np.empty((len(s.doc), states))
        ll = np.zeros(len(s.count))
        for j, own in enumerate(s.by_place):
            before[own] = 1 / states if j == 0 else after[s.doc[own]]
            v = np.einsum("ni,nij->nj", before[own], m[own])
            z = v.sum(axis=1)
            ll[s.doc[own]] += np.log(z) + scale[own]
            if j == 0:
                after = np.empty((len(s.count), states))
            after[s.doc[own]] = v / z[:, None]
        return before, ll

    def likelihood(self, s: Segments) -> np.ndarray:
        return self.chain(s, *self.transfer(s))[1]

    def expect(self, s: Segments):
        """Expected transition and emission counts of the texts, and their log likelihood."""
        states, total = len(self.a), len(s.doc)
        m, scale = self.transfer(s)
        before, ll = self.chain(s, m, scale)
        beta = np.ones((total, states))  # weights after each segment
        for j in range(len(s.by_place) - 2, -1, -1):
            nxt = s.by_place[j + 1]
            v = np.einsum("nij,nj->ni", m[nxt], beta[nxt])
            beta[nxt - 1] = v / v.sum(axis=1)[:, None]
        alpha = np.empty((SEGMENT + 1, total, states))
        alpha[0] = before
        for t in range(SEGMENT):
            v = (alpha[t] @ self.a) * self.b[s.cls[:, t]]
            v /= v.sum(axis=1)[:, None]
            alpha[t + 1] = np.where(s.valid[:, t][:, None], v, alpha[t])
        trans = np.zeros((states, states))
        gamma = np.empty((SEGMENT, total, states))
        for t in range(SEGMENT - 1, -1, -1):
            live = s.valid[:, t]
            g = alpha[t + 1] * beta
            gamma[t] = g / g.sum(axis=1)[:, None]
            eb = self.b[s.cls[:, t]] * beta
            back = eb @ self.a.T
            z = (alpha[t] * back).sum(axis=1)
            w = np.where(live, 1 / z, 0)[:, None]
            trans += self.a * (alpha[t].T @ (eb * w))
            beta = np.where(live[:, None], back / back.sum(axis=1)[:, None], beta)
        flat = s.cls.T.ravel()
        emit = np.stack([np.bincount(flat, weights=gamma[:, :, i].ravel(), minlength=CLASSES + 2)[: CLASSES + 1] for i in range(states)])
        return trans, emit, ll.sum()


def _surroundings(classes: Classes):
    """(anchor, sums): for each anchor class the class distributions, added up with a weight by length, of the texts that hold it."""

    def run(batches):
        sums = np.zeros((ANCHORS, CLASSES + 1))
        for piece in pieces(batches, "text"):
            words = Coded(piece.column("text"))
            cls, owner, size = classes(words.vocab)[words.codes], words.owner(), np.diff(words.offsets)
            for lo in range(0, piece.num_rows, 512):
                part = slice(words.offsets[lo], words.offsets[min(lo + 512, piece.num_rows)])
                counts = np.bincount((owner[part] - lo) * (CLASSES + 1) + cls[part], minlength=512 * (CLASSES + 1)).reshape(512, -1)
                n = size[lo : lo + 512]
                counts = counts[: len(n)] * (np.log1p(n) / np.maximum(n, 1))[:, None]
                sums += (counts[:, :ANCHORS] > 0).astype(float).T @ counts
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(ANCHORS)), pa.array([x.tobytes() for x in sums], pa.binary())], names=["anchor", "sums"])

    return run


def _added(batches):
    for t in grouped(batches, ("anchor",)):
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in t.column("sums"))
        yield pa.RecordBatch.from_arrays([t.column("anchor").combine_chunks()[:1], pa.array([total.tobytes()], pa.binary())], names=["anchor", "sums"])


def start_states(texts: DataFrame, classes: Classes, class_counts: np.ndarray) -> np.ndarray:
    """STATES class distributions that lie far apart; ANCHORS rows of CLASSES + 1 numbers reach the driver."""
    share = (class_counts + 0.5) / (class_counts + 0.5).sum()
    rows = texts.mapInArrow(_surroundings(classes), "anchor long, sums binary").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_added, "anchor long, sums binary").collect()
    table = [np.frombuffer(r["sums"], np.float64) for r in sorted(rows, key=lambda r: r["anchor"])]
    table = [t / t.sum() for t in table if t.sum() > 0]
    chosen: list[np.ndarray] = []
    while len(chosen) < STATES and table:
        near = [min(np.abs(t - c).sum() for c in chosen or [share]) for t in table]
        chosen.append(table.pop(int(np.argmax(np.round(near, 9)))))
    chosen += [share] * (STATES - len(chosen))
    tilt = 1 + 0.01 * np.cos(np.outer(np.arange(1, STATES + 1), np.arange(CLASSES + 1)))  # no two states are equal
    b = (0.8 * np.stack(chosen) + 0.2 * share) * tilt
    b[:, END_CLASS] = share[END_CLASS]
    return b / b.sum(axis=1)[:, None]


def start_model(b: np.ndarray) -> Model:
    """States tend to stay."""
    a = np.full((STATES, STATES), 0.1 / max(1, STATES - 1))
    np.fill_diagonal(a, 0.9 if STATES > 1 else 1.0)
    return Model(a, b)


def _expectations(model: Model, classes: Classes):
    def run(batches):
        trans, emit, ll = np.zeros((STATES, STATES)), np.zeros((STATES, CLASSES + 1)), 0.0
        for piece in pieces(batches, "text"):
            words = Coded(piece.column("text"))
            t, e, x = model.expect(Segments(words, classes(words.vocab)))
            trans, emit, ll = trans + t, emit + e, ll + x
        flat = np.concatenate([trans.ravel(), emit.ravel(), [ll]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    return run


def train(texts: DataFrame, classes: Classes, class_counts: np.ndarray, iterations: int = ITERATIONS) -> tuple[Model, list[float]]:
    """Baum-Welch over all rows of texts; the log likelihood before each update shows that it rises."""
    model, path = start_model(start_states(texts, classes, class_counts)), []
    for _ in range(iterations):
        sums = texts.mapInArrow(_expectations(model, classes), "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        if not len(sums):
            break
        flat = sums.set_index("i")["x"].sort_index().to_numpy()
        trans, emit, ll = flat[: STATES**2].reshape(STATES, STATES), flat[STATES**2 : -1].reshape(STATES, CLASSES + 1), flat[-1]
        path.append(float(ll))
        # every class keeps a little weight in every state, so that texts outside the training set have a likelihood
        floor = 0.01 * (class_counts + 0.5) / (class_counts + 0.5).sum()
        model = Model((trans + 0.1) / (trans + 0.1).sum(axis=1)[:, None], 0.99 * emit / np.maximum(emit.sum(axis=1), 1e-9)[:, None] + floor)
        if len(path) > 1 and path[-1] - path[-2] < TOLERANCE * abs(path[-2]):
            break
    return model, path


def _score(model: Model, classes: Classes, big_tok: np.ndarray, big_log: np.ndarray, class_log: np.ndarray):
    schema = pa.schema(
        [("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("logs", pa.float64()), ("rest", pa.float64()), ("tok", pa.list_(pa.int64())), ("tf", pa.list_(pa.int32()))]
    )

    def run(batches):
        uid = TaskContext.get().partitionId() << 36
        for piece in pieces(batches, "text"):
            n = piece.num_rows
            words = Coded(piece.column("text"))
            h = words.vocab
            cls = classes(h)
            ll = model.likelihood(Segments(words, cls)) / math.log(10)
            owner = words.owner()
            at = np.minimum(np.searchsorted(big_tok, h), max(0, len(big_tok) - 1))
            big = big_tok[at] == h if len(big_tok) else np.zeros(len(h), bool)
            logs = np.where(big, big_log[at] if len(big_log) else 0.0, 0.0)
            is_big = big[words.codes]
            rare_key = owner[~is_big] * max(1, len(h)) + words.codes[~is_big]
            u, tf = np.unique(rare_key, return_counts=True)
            per_doc = np.bincount(u // max(1, len(h)), minlength=n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(uid + np.arange(n)),
                    piece.column("doc_id"),
                    piece.column("held_out"),
                    pa.array(np.diff(words.offsets) + 1),
                    pa.array(np.bincount(owner[is_big], minlength=n).astype(np.int64)),
                    pa.array(np.bincount(owner, weights=logs[words.codes], minlength=n)),
                    pa.array(ll - np.bincount(owner, weights=class_log[cls][words.codes], minlength=n)),
                    list_array(signed(h[u % max(1, len(h))]), per_doc, pa.int64()),
                    list_array(tf.astype(np.int32), per_doc, pa.int32()),
                ],
                schema=schema,
            )
            uid += n

    return run


def word_counts(train_docs: DataFrame) -> DataFrame:
    """(tok, n) over the rows given: counts within tasks, then over all."""
    return train_docs.select("text").mapInArrow(_count, "tok long, n long").groupBy("tok").agg(F.sum("n").alias("n"))


def word_classes(counts: DataFrame) -> tuple[Classes, np.ndarray, np.ndarray]:
    """The classes, and the tokens and distinct words of each class and of the end token (last). OWN + HASHED + 1 rows reach the driver."""
    end = F.col("tok") == F.lit(END)
    top = counts.filter(~end).orderBy(F.desc("n"), "tok").limit(OWN).select("tok", "n").collect()
    own = np.array([r["tok"] for r in top], np.int64)
    n_class, v_class = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    n_class[: len(top)], v_class[: len(top)] = [r["n"] for r in top], 1
    others = counts.join(F.broadcast(counts.sparkSession.createDataFrame([(int(x),) for x in own], "tok long")), "tok", "left_anti")  # OWN rows
    cls = F.when(end, F.lit(END_CLASS)).otherwise(F.shiftrightunsigned("tok", 55) + OWN).cast("int")
    for r in others.groupBy(cls.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        n_class[r["c"]], v_class[r["c"]] = r["n"], r["v"]
    return Classes(own.view(np.uint64)), n_class, v_class


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on the rows outside the held-out fold and score every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    learn = rows.filter(~F.col("held_out")).select("text")
    counts = materialize(word_counts(learn), "lm-counts")
    classes, n_class, v_class = word_classes(counts)
    total, distinct = int(n_class.sum()), int(v_class.sum())
    model, _ = train(learn, classes, n_class)
    # the lowest power of two from which on at most BIG_WORDS words are counted that often
    sizes = {r["k"]: r["v"] for r in counts.groupBy(F.ceil(F.log2(F.col("n") + 1)).cast("int").alias("k")).agg(F.count("*").alias("v")).collect()}
    k, kept = 64, 0
    while k > 1 and kept + sizes.get(k - 1, 0) <= BIG_WORDS:
        k -= 1
        kept += sizes.get(k, 0)
    threshold = 1 << (k - 1)
    big = counts.filter(F.col("n") >= threshold).toPandas().astype({"tok": "int64", "n": "int64"})
    tok = big["tok"].to_numpy().view(np.uint64)
    order = np.argsort(tok)
    # in its own class a word has the whole weight; a hash class leaves some to unseen words
    class_log = np.log10(n_class + 0.5 * (v_class + 1))[:CLASSES]
    class_log[:OWN] = np.log10(n_class[:OWN] + 0.5)
    scorer = _score(model, classes, tok[order], np.log10(big["n"].to_numpy()[order] + 0.5), class_log)
    scored = materialize(
        rows.mapInArrow(scorer, "uid long, doc_id long, held_out boolean, n_tokens long, known long, logs double, rest double, tok array<long>, tf array<int>"), "lm-scored"
    )
    rare = scored.select("uid", F.explode(F.arrays_zip("tok", "tf")).alias("r")).select("uid", F.col("r.tok").alias("tok"), F.col("r.tf").alias("tf"))
    found = rare.join(counts.filter(F.col("n") < threshold), "tok", "left")
    log = F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    added = found.groupBy("uid").agg(F.sum(F.col("tf") * log).alias("more_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("tf")).otherwise(0)).alias("more_known"))
    out = scored.drop("tok", "tf").join(added, "uid", "left")
    end_n = int(n_class[END_CLASS])
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + (1 if end_n else 0)).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (logs + math.log10(end_n + 0.5) - F.col("n_tokens") * math.log10(total + 0.5 * (distinct + 1))).alias("base_score"),
        (F.col("rest") + logs).alias("score"),
    )


def base_sql(table: str) -> str:
    """DuckDB SQL for the columns of score_documents that don't depend on the hidden states (tests join it to them).

    DuckDB has no crc32, so the fold comes from a table ``folds`` (doc_id, held_out)."""
    return f"""
WITH w AS (SELECT doc_id, held_out, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), chr(10))) AS w
  FROM {table} JOIN folds USING (doc_id)),
c AS (SELECT w, count(*) AS c FROM w WHERE NOT held_out GROUP BY w),
s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(s.n) AS train_tokens,
  sum(log10((coalesce(c.c, 0) + 0.5) / (s.n + 0.5 * (s.v + 1)))) AS base_score
FROM w LEFT JOIN c USING (w), s GROUP BY doc_id"""
