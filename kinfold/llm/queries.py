"""Registered queries of the training-data problems: each over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from .canon import look_alike_pairs
from .components import connected_groups
from .incremental import found_repeats
from .leaks import leaked_items
from .nearest import nearest_pairs
from .packing import pack, pack_documents
from .survivor import best_of_group
from .topn import top_n_per_group


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return found_repeats(table(spark, d, "migration_manifest"), table(spark, d, "incoming_manifest"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return connected_groups(table(spark, d, "manifest_row")).withColumnRenamed("node", "source_path")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return best_of_group(table(spark, d, "migration_manifest"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "migration_manifest"), 3)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest_pairs(table(spark, d, "migration_manifest"))


def p7_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), table(spark, d, "token_budget"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """What packing must keep, over lengths in characters, which SQL can count too: pieces, their sum, none too full, few containers."""
    texts = table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n_tokens"))
    budgets = table(spark, d, "token_budget")
    placed = pack(texts, budgets)
    boxes = placed.groupBy("budget_id", "container_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n_tokens").alias("filled"), F.countDistinct("slot").alias("slots"))
    limits = budgets.select("budget_id", F.col("capacity_tokens").alias("capacity"))
    full = boxes.join(limits, "budget_id").groupBy("budget_id").agg(
        F.sum("pieces").alias("pieces"), F.sum("filled").alias("characters"), F.count_if(F.col("filled") > F.col("capacity")).alias("too_full"),
        F.sum(F.col("pieces") - F.col("slots")).alias("shared_slots"), F.count(F.lit(1)).alias("boxes"), F.max("capacity").alias("capacity"),
    )
    return full.select("budget_id", "pieces", "characters", "too_full", "shared_slots", (F.col("boxes") <= 1.02 * F.ceil(F.col("characters") / F.col("capacity")) + 1).alias("within_2_percent"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_pairs(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p4_found, p5_found, p6_found, p7_pack, p7_kept, p8_found, p9_found)}
