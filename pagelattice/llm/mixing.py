"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length; everything that is decided is decided on these counts. A source's budget
is its weight's share of the total; without weights and total these are its tokens to the power POWER and all tokens. First every length gives the same share of its documents, rounded up or down in
seeded order; what is left of the budget, little more than the longest document, is filled by a bounded-knapsack dynamic program over the documents that remain: the largest sum of lengths that doesn't
exceed the budget, with no more documents of a length than there are. Of each length the documents with the least seeded hashes
are taken.

The counts of a source are one group: their number is bounded by the longest document, not by the corpus. The chosen documents are
found in one pass over the texts by comparing with the last taken hash of their source and length, so texts aren't shuffled.

The token length is an argument: by default the number of runs of characters other than blanks, tabs and line ends.

Defined cases: rows that share source and doc_id are one item, taken or left together, its length their sum; a null doc_id is an item
as well; null sources and sources of no weight give nothing; null and empty texts have length 0 and are never taken; equal hashes are
ordered by doc_id; extra columns pass through, whatever their names; repeated rows are taken or left together; an empty table gives an
empty table; a very long text only counts by its length; a source with less than its share of the total gives all it has. With weights but no total
the scarcest source bounds the mix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, maybe_broadcast
from . import hashing

#: Weights without a list of weights: each source's share of the tokens to this power, so a hot source counts for less.
POWER = 0.7
SEED = 17


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \n\t\r]+")), F.lit(0)).cast("long")


def shares(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int) -> np.ndarray:
    """Of each length the budget's share of its documents, rounded up or down as a seeded hash falls beside the fraction, within the budget."""
    total = int((lengths * counts).sum())
    exact = counts * (budget / total)
    take = np.array([int(c) * budget // total for c in counts], np.int64)
    left = budget - int((take * lengths).sum())
    u = hashing.mix(lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) / 2.0**64
    for i in np.argsort(u - (exact - take), kind="stable"):
        if lengths[i] > left:
            break
        if take[i] < counts[i]:
            take[i] += 1
            left -= int(lengths[i])
    return take


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many documents of each length: their tokens are as many as can be without exceeding the budget, near the same share of every length.

    Equal shares leave somewhat more than the longest document to the program. If it can't fill that, the shares leave more, in the end
    all, so that no other choice has more tokens.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    out = np.zeros(len(lengths), np.int64)
    good = np.flatnonzero((lengths > 0) & (counts > 0))
    size, have = lengths[good], counts[good]
    if budget <= 0 or not len(good):
        return out
    if int((size * have).sum()) <= budget:
        out[good] = have
        return out
    open_ = budget % int(np.gcd.reduce(size))  # no choice fills that
    slack = int(size.max())
    while True:
        near = max(0, budget - slack)
        take = shares(size, have, near, seed)
        left = budget - int((take * size).sum())
        add, got = subset_sum(size, have - take, left)
        if got == left - open_ or not near:
            out[good] = take + add
            return out
        slack *= 4


def subset_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """(number of each length, their sum): the largest sum within the budget, by a bounded-knapsack program over bits of an integer."""
    lengths = np.asarray(lengths, np.int64)
    some = lengths[(lengths > 0) & (np.asarray(counts) > 0)]
    unit = int(np.gcd.reduce(some)) if len(some) else 1
    lengths, budget = lengths // unit, budget // unit
    full = (1 << budget + 1) - 1
    reach, steps = 1, []
    for i in np.argsort(-np.asarray(lengths), kind="stable"):
        n, length = int(min(counts[i], budget // lengths[i] if lengths[i] > 0 else 0)), int(lengths[i])
        part = 1
        while n > 0:  # binary parts of the count
            k = min(part, n)
            steps.append((int(i), k, reach))
            reach |= reach << k * length & full
            n -= k
            part *= 2
        if reach >> budget & 1:
            break
    best = reach.bit_length() - 1
    out, at = np.zeros(len(lengths), np.int64), best
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            out[i] += k
            at -= k * int(lengths[i])
    return out, best * unit


def items(docs: DataFrame, length: Column | None = None) -> DataFrame:
    """(source, doc_id, length, copies)."""
    n = tokens(F.col("text")) if length is None else length
    return docs.where("source is not null").select("source", "doc_id", n.alias("length")).groupBy("source", "doc_id").agg(F.sum("length").cast("long").alias("length"), F.count("*").alias("copies"))


def budgets(counts: DataFrame, weights: dict[str, float] | None, total: int | None, power: float = POWER) -> DataFrame:
    """(source, tokens, weight, budget BIGINT). Without weights, the total is by default all tokens, and a source short of its share gives all it has. Given weights without a total: the largest mix of which no source lacks its share."""
    have = counts.groupBy("source").agg(F.sum(F.col("length") * F.col("n")).alias("tokens")).where("tokens > 0")
    if weights is None:
        have = have.withColumn("w", F.pow("tokens", F.lit(power)))
    else:
        rows = [(k, float(v)) for k, v in weights.items() if v > 0]
        weighed = F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in rows)), F.array(*(F.lit(v) for _, v in rows)))) if rows else None
        w = have.sparkSession.range(1).select(weighed.alias("source", "w")) if rows else have.select("source", F.lit(0.0).alias("w")).where("false")
        have = have.join(F.broadcast(w), "source")  # as many rows as the caller named
    all_ = have.agg(F.sum("w").alias("sum_w"), F.min(F.col("tokens") / F.col("w")).alias("least"), F.sum("tokens").alias("all"))
    have = have.crossJoin(all_).withColumn("weight", F.col("w") / F.col("sum_w"))
    whole = F.lit(float(total)) if total is not None else F.col("all") if weights is None else None
    budget = F.floor(F.col("least") * F.col("w") + 1e-6) if whole is None else F.floor(whole * F.col("weight") + 1e-6)
    return have.select("source", "tokens", "weight", F.least(budget.cast("long"), F.col("tokens")).alias("budget"))


def plan(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, length: Column | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(items, takes (source, length, take) with take > 0)."""
    its = cut(items(docs, length), "items")
    counts = its.where("length > 0").groupBy("source", "length").agg(F.count("*").alias("n"))
    counts = cut(counts, "counts")
    work = counts.join(budgets(counts, weights, total), "source")

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("length")
        g["take"] = fit(g.length.to_numpy(), g.n.to_numpy(), int(g.budget.iloc[0]), seed)
        return g[["source", "length", "take"]]

    return its, work.groupBy("source").applyInPandas(one, f"source {counts.schema['source'].dataType.simpleString()}, length long, take long").where("take > 0")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, length: Column | None = None, seed: int = SEED) -> DataFrame:
    """The chosen rows of docs, all columns."""
    its, takes = plan(docs, weights, total, length, seed)
    h = F.xxhash64("doc_id", F.lit(seed)).alias("h")
    ranked = its.where("length > 0").select("source", "length", "doc_id", "copies", h).join(maybe_broadcast(takes), ["source", "length"])
    # the last taken (hash, doc_id) of each source and length
    from pyspark.sql.window import Window

    w = Window.partitionBy("source", "length").orderBy("h", F.col("doc_id").asc_nulls_first())
    taken = ranked.withColumn("k", F.row_number().over(w)).where("k <= take")
    last = cut(taken.groupBy("source", "length").agg(F.max(F.struct("h", "doc_id")).alias("__last")), "last")
    n = tokens(F.col("text")) if length is None else length
    mine = docs.withColumn("__n", n).withColumn("__h", F.struct(F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.col("doc_id").alias("doc_id")))
    cuts = maybe_broadcast(last.select(F.col("source").alias("__source"), F.col("length").alias("__length"), "__last"))
    repeated = its.where("copies > 1")
    single = mine
    if not repeated.isEmpty():
        # rows of items of several rows aren't decided by their own length
        many = cut(repeated.select(F.col("source").alias("__s"), F.col("doc_id").alias("__d")), "repeated")
        chosen = cut(taken.where("copies > 1").select(F.col("source").alias("__s"), F.col("doc_id").alias("__d")), "chosen")
        same = (F.col("source") == F.col("__s")) & F.col("doc_id").eqNullSafe(F.col("__d"))
        single = mine.join(maybe_broadcast(many), same, "left_anti")
        several = docs.join(maybe_broadcast(chosen), same, "left_semi")
    out = single.join(cuts, (F.col("source") == F.col("__source")) & (F.col("__n") == F.col("__length")) & (F.col("__h") <= F.col("__last")), "left_semi").select(*docs.columns)
    return out.unionByName(several) if single is not mine else out


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    """The documents of a mix of as many tokens as there are in which a source's weight is its share of the tokens to the power 0.7; a source that has less gives all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "source", "lang", tokens(F.col("text")).alias("n_tokens"))
