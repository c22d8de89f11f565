"""Token dictionary and integer encoding of token sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from charterloom.plans.materialize import materialize
from charterloom.sources.tables import numbered

#: A dictionary of at most so many rows is broadcast; larger ones join by shuffle.
BROADCAST_ROWS = 500_000
HEAVY_PART = 10_000


def token_dictionary(tokens: DataFrame, column: str = "tokens") -> DataFrame:
    """(token, token_id): ranks of the sorted distinct tokens from 0 on; null and empty tokens have none."""
    distinct = tokens.select(F.explode(column).alias("token")).where("token <> ''").distinct()
    return numbered(distinct, ["token"], "token_id").select("token", F.col("token_id").cast("int").alias("token_id"))


def encode(tokens: DataFrame, dictionary: DataFrame, keys: list[str], column: str = "tokens") -> DataFrame:
    """(keys, ids ARRAY<INT>): token ids in order; tokens outside the dictionary vanish, rows without tokens stay with an empty list.

    A small dictionary is broadcast.  Of a larger one the tokens that make up
    more than one of ``HEAVY_PART`` occurrences are, which are at most
    ``HEAVY_PART``; the others join by shuffle, where no key is hot any more.
    """
    exploded = tokens.select(*keys, F.posexplode(column).alias("pos", "token"))
    if dictionary.count() <= BROADCAST_ROWS:
        found = exploded.join(F.broadcast(dictionary), "token")
    else:
        counts = materialize(exploded.groupBy("token").agg(F.count("*").alias("n")), "occurrences")
        every = counts.agg(F.sum("n")).first()[0] or 0
        heavy = F.broadcast(counts.where(F.col("n") * HEAVY_PART > every).select("token", F.lit(True).alias("heavy")).join(dictionary, "token", "left"))
        told = exploded.join(heavy, "token", "left")
        rest = told.where("heavy is null").drop("heavy", "token_id").join(dictionary, "token")
        found = told.where("token_id is not null").drop("heavy").unionByName(rest)
    rows = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "token_id"))).alias("x"))
    ids = F.coalesce(F.col("x.token_id"), F.array().cast("array<int>"))
    return tokens.select(*keys).join(rows, keys, "left").select(*keys, ids.alias("ids"))
