"""Chat formatting: cumulative-snapshot collapse, then rendering.

A logger that stores a conversation after every turn leaves snapshots: conversations that are prefixes of longer
ones. The turns of a conversation, in order, get a rolling hash per prefix (two 64-bit words, position-tagged turn
hashes folded by exclusive or). A conversation whose whole hash equals a proper prefix of another, of the same
length, is a snapshot and goes by an anti-join; identical conversations keep the smallest id. What stays is
rendered.

Defined cases: rows without conversation id belong to no conversation and are left out; a null role reads as
"unknown", a null text as empty; repeated rows of a conversation count once; equal turn numbers are ordered by role
and text, null turns come first; an empty table gives an empty result. A conversation is one output text, so its
turns meet in one row; nothing wider than a conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, table

UNKNOWN_ROLE = "unknown"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, role, text, at, n, a, b): every turn with its place, its conversation's length and the hash of the
    prefix that ends with it."""
    clean = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", F.col("turn").alias("turn"), F.coalesce("role", F.lit(UNKNOWN_ROLE)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = clean.withColumn("at", F.row_number().over(order)).withColumn(
        "n", F.count("*").over(Window.partitionBy("conv_id")).cast("int"))
    for name, seed in (("a", 11), ("b", 29)):
        placed = placed.withColumn(name, F.bit_xor(F.xxhash64(F.lit(seed), "at", "role", "text")).over(so_far))
    return placed.select("conv_id", "role", "text", "at", "n", "a", "b")


def maximal(prefixes: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): the conversations that prefix no longer one; copies counts identical ones."""
    whole = (prefixes.where("at = n").groupBy("a", "b", "n")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")))
    inner = prefixes.where("at < n").select("a", "b", F.col("at").alias("n")).distinct()
    return whole.join(inner, ["a", "b", "n"], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns"), "copies")


def render(turns: DataFrame, chosen: DataFrame, *, opening: str = "<|im_start|>", closing: str = "<|im_end|>\n") -> DataFrame:
    """chosen with `rendered`: one text per conversation, each turn as opening, role, line break, text, closing."""
    piece = F.concat(F.lit(opening), "role", F.lit("\n"), "text", F.lit(closing))
    texts = (turns.join(chosen.select("conv_id"), "conv_id", "left_semi")
             .groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", piece.alias("piece")))).alias("pieces"))
             .select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("rendered")))
    return chosen.join(texts, "conv_id")


def collapse_and_render(turns: DataFrame, **marks) -> DataFrame:
    """(conv_id, n_turns, copies, rendered) of the maximal conversations."""
    prefixes = keep(prefix_hashes(turns))
    return render(prefixes, maximal(prefixes), **marks)


def op6_snapshot_collapse(spark, folder):
    return collapse_and_render(table(spark, folder, "conversations")).select(
        "conv_id", F.col("n_turns").cast("long").alias("n_turns"), "copies",
        F.sha2("rendered", 256).alias("rendered_sha256"))


OP6_SQL = """
WITH clean AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
               FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM clean),
grown AS (SELECT conv_id, place, count(*) OVER (PARTITION BY conv_id) AS n,
                 string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '')
                     OVER (PARTITION BY conv_id ORDER BY place) AS rendered FROM placed),
whole AS (SELECT min(conv_id) AS conv_id, n, rendered, count(*) AS copies FROM grown WHERE place = n GROUP BY n, rendered)
SELECT conv_id, n AS n_turns, copies, sha256(rendered) AS rendered_sha256 FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM grown g WHERE g.place < g.n AND g.place = w.n AND g.rendered = w.rendered)
"""
