"""Routing for exact set-similarity joins.

Two sets with Jaccard similarity of at least 4/5 share a token among the first floor(n / 5) + 1 tokens of each, whatever the
global token order (prefix filter). All members that share a prefix token go to the token's hub, its smallest member; so
both sets of every similar pair meet under some hub, and a cluster whose members share many tokens meets under few. A hub
with more members than a task should hold is cut into blocks, and every pair of its blocks meets in a task of its own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weight (tokens of the members) up to which a hub is one block.
BLOCK_WEIGHT = 4_000_000


def prefix_length(n: np.ndarray | int):
    """Tokens of a set of size n of which a similar set must hold one."""
    return n - (4 * n + 4) // 5 + 1


def needed_overlap(a, b):
    """Least intersection size of sets of a and b tokens at 100 * intersection >= 80 * union."""
    return (4 * (a + b) + 8) // 9


def hubs_of(tokens: DataFrame) -> DataFrame:
    """tokens(tok, member) -> distinct (hub, member), for tokens with two members or more.

    Minimum and maximum tell whether a token is shared; both are combined before the shuffle, so a token that very many
    members hold costs a row a task. The join back is an equi-join that adaptive execution may split at such a token.
    """
    shared = tokens.groupBy("tok").agg(F.min("member").alias("hub"), F.max("member").alias("last")).filter("hub < last").select("tok", "hub")
    return tokens.join(shared, "tok").select("hub", "member").distinct()


def in_blocks(members: DataFrame, weight: str, most: int = BLOCK_WEIGHT) -> DataFrame:
    """members(hub, member, weight, ...) with the task (hub, i, j) of each row: one task per hub, or per pair of its blocks."""
    load = members.groupBy("hub").agg(F.sum(weight).alias("load"), F.count("*").alias("n")).filter("n > 1")
    rows = members.join(load.select("hub", F.ceil(F.col("load") / most).cast("int").alias("blocks")), "hub")
    block = F.pmod(F.xxhash64("member", F.lit(5)), F.col("blocks")).cast("int")
    rows = rows.withColumn("block", block)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")),
    )
    return rows.withColumn("p", F.explode(pairs)).withColumn("i", F.col("p.i")).withColumn("j", F.col("p.j")).drop("p", "blocks", "block")
