"""Mixing sources to target weights: subset-sum budget fitting over counts by exact length.

Every document has a size in words. Sources get targets by weight, capped at a number of repeats of what they
hold; whole repeats cover most of a target, and the rest is fitted exactly: documents are counted per (source,
length), a proportional share of each length is taken, and a bounded-knapsack table over the remaining budget
finds which lengths close the gap, from below or above. Which documents of a length are taken follows a seeded hash.

Defined cases: a null text has size 0, a null source is a source of its own and comes last; documents of size 0
get the source's whole repeats and no more; repeated rows count one by one; an empty table gives an empty result.
The number of distinct sources is bounded by `max_sources` (one summary row each comes to the driver); everything
else stays distributed. A (source, length) group may hold any share of all rows: it is cut into `BINS` by a hash of id and
text, so that rows without an id or with the same one spread too, and rows are ranked within their bin only. Only rows with
the same id and the same text share a mark: which of them are taken is open, how many of them is not.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, forget, keep, packed, settle, table

BINS = 4096
#: Budgets up to this many words are closed by the knapsack table; larger ones are first reduced greedily.
TABLE_BUDGET = 1 << 16
#: Distinct lengths that enter the knapsack table.
TABLE_LENGTHS = 512


def words_in(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float,
                   repeats: float) -> dict[str | None, float]:
    """Target per source: `share` of all words by weight, none above `repeats` times its own size; what is cut
    off is dealt again by weight among the others until none is above."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    limit = {s: repeats * n for s, n in order}
    target = {s: 0.0 for s, _ in order}
    free, rest = [s for s, _ in order], share * sum(n for _, n in order)
    while free and rest > 0:
        total = sum(weight[s] for s in free)
        given = {s: target[s] + rest * weight[s] / total for s in free}
        over = [s for s in free if given[s] > limit[s]]
        rest = math.fsum(given[s] - limit[s] for s in over)
        target |= given | {s: float(limit[s]) for s in over}
        free = [s for s in free if s not in set(over)]
        if not over:
            break
    return target


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length to take so that their sizes sum to the budget, or as near as the table
    finds. Starts from an even share of every length, so that the choice follows the source's own mix."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    budget = max(0, min(budget, total))
    if not total or not budget:
        return [0] * len(lengths)
    taken = [c * budget // total if n else 0 for n, c in zip(lengths, counts, strict=True)]
    rest = budget - sum(n * x for n, x in zip(lengths, taken, strict=True))
    by_fraction = sorted(range(len(lengths)), key=lambda i: (-(counts[i] * budget % total), lengths[i]))
    for i in by_fraction:
        if rest <= TABLE_BUDGET:
            break
        if 0 < lengths[i] <= rest and taken[i] < counts[i]:
            taken[i] += 1
            rest -= lengths[i]
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest <= TABLE_BUDGET or not lengths[i]:
            break
        more = min(counts[i] - taken[i], (rest - 1) // lengths[i])
        taken[i] += more
        rest -= more * lengths[i]
    items = []
    for i in sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= 2 * rest and taken[i] < counts[i]),
                    key=lambda i: lengths[i])[:TABLE_LENGTHS]:
        left, step = min(counts[i] - taken[i], 2 * rest // lengths[i]), 1
        while left:
            items.append((i, min(step, left)))
            left -= min(step, left)
            step *= 2
    full, reach, layers = (1 << 2 * rest + 1) - 1, 1, []
    for i, n in items:
        layers.append(reach)
        reach |= (reach << lengths[i] * n) & full
    below = (reach & ((1 << rest + 1) - 1)).bit_length() - 1
    over = reach >> rest
    above = rest + (over & -over).bit_length() - 1 if over else below
    at = above if above - rest < rest - below else below
    for (i, n), before in zip(reversed(items), reversed(layers), strict=True):
        if not before >> at & 1:
            taken[i] += n
            at -= lengths[i] * n
    return taken


def mix(docs: DataFrame, *, size: Column | None = None, salt: Column | None = None, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
        repeats: int = 2, seed: int = 7, max_sources: int = 100_000) -> DataFrame:
    """(row, size, source_size, target, times): every input row with the number of times the mix takes it. size, salt:
    words and hash of the text, for callers that have them already."""
    spark = docs.sparkSession
    rows = docs.select(packed(docs).alias("row"), F.col("source").cast("string").alias("source"),
                       F.col("doc_id").alias("id"), (words_in() if size is None else size).alias("size"),
                       (F.xxhash64("text") if salt is None else salt).alias("salt"))
    mark = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "salt", F.lit(seed))
    rows = rows.select("row", "source", "size", mark.alias("mark"))
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    rows = rows.select("row", named.alias("name"), "size", "mark", F.pmod("mark", F.lit(BINS)).alias("bin"))
    bins = keep(rows.groupBy("name", "size", "bin").agg(F.count("*").alias("n")))

    totals = bins.groupBy("name").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("words")).limit(max_sources + 1).collect()
    if len(totals) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    words = {r["name"][1:] if r["name"] else None: r["words"] for r in totals}
    target = source_targets(list(words.items()), weights, share, repeats)
    goals = spark.createDataFrame(
        [("" if s is None else f"={s}", words[s], target[s], _whole(target[s], words[s], repeats),
          round(target[s] - _whole(target[s], words[s], repeats) * words[s])) for s in words],
        "name string, source_size long, target double, whole long, budget long")

    lengths = bins.groupBy("name", "size").agg(F.sum("n").alias("n")).join(F.broadcast(goals.select("name", "budget")), "name")
    extra = lengths.groupBy("name").applyInPandas(_fit, "name string, size long, extra long")
    until = F.sum("n").over(Window.partitionBy("name", "size").orderBy("bin")
                            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    plan = (bins.withColumn("until", until).join(extra, ["name", "size"])
            .select("name", "size", "bin", "n",
                    F.greatest(F.lit(0), F.least("n", F.col("extra") - F.col("until") + F.col("n"))).alias("pick"))
            .join(F.broadcast(goals.drop("budget")), "name"))
    plan = keep(plan)
    forget(bins)

    rank = F.row_number().over(Window.partitionBy("name", "size", "bin").orderBy("mark"))
    return rows.join(plan, ["name", "size", "bin"]).withColumn("rank", rank).select(
        "row", "size", "source_size", "target", (F.col("whole") + (F.col("rank") <= F.col("pick")).cast("long")).alias("times"))


def _whole(target: float, words: int, repeats: int) -> int:
    return min(repeats, math.floor(target / words)) if words else 0


def _fit(part: pd.DataFrame) -> pd.DataFrame:
    settle()
    part = part.sort_values("size")
    extra = fit_lengths([int(x) for x in part["size"]], [int(x) for x in part["n"]], int(part["budget"].iloc[0]))
    return pd.DataFrame({"name": part["name"], "size": part["size"], "extra": extra})


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' rows, each as often as the mix takes it."""
    return (mix(docs, **options).where("times > 0")
            .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("turn")).select("row.*"))


def op9_length_count_mix(spark, folder):
    """Production parameters: weights 3, 1, 2 repeating, 150 % of all words, at most two repeats."""
    docs = table(spark, folder, "documents").select("doc_id", "source", words_in().alias("size"), F.xxhash64("text").alias("salt"))
    sized = keep(docs)
    return mix(sized, size=F.col("size"), salt=F.col("salt")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))
