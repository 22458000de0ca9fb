"""The manifest as a table: writing, loading, decisions and outcomes as pure functions of it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import align_manifest
from . import review
from .select import best_per_group, load_order


def write_manifest(rows: DataFrame, path: str) -> None:
    """Replaces the table at path as a whole: written beside it first, then moved into place, so a failed write leaves the old one."""
    spark = rows.sparkSession
    p = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    try:
        rows.write.parquet(new)
        if fs.exists(p(path)):
            fs.rename(p(path), p(old))
        fs.rename(p(new), p(path))
        fs.delete(p(old), True)
    finally:
        fs.delete(p(new), True)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return align_manifest(spark.read.parquet(path))


def open_manifest(rows: DataFrame) -> DataFrame:
    """Rows in review in load order, numbered by group."""
    return review.load(align_manifest(rows)).orderBy(*load_order())


def update(rows: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with the named columns replaced where changes (source_path and those columns) has a value that is not NULL.

    Of several changes of one path the greatest row counts, so the result does not depend on order.
    """
    new = changes.groupBy("source_path").agg(F.max(F.struct(*columns)).alias("_n"))
    joined = rows.join(new, "source_path", "left")
    return joined.select(*[F.coalesce(F.col("_n")[c], F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def set_decisions(rows: DataFrame, changes: DataFrame) -> DataFrame:
    return update(rows, changes, ["user_decision"])


def set_locks(rows: DataFrame, changes: DataFrame) -> DataFrame:
    return update(rows, changes, ["is_locked"])


def set_outcomes(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcomes by path (source_path, outcome); executed is 1 for deleted rows and 0 for others that changed."""
    marked = changes.withColumn("executed", (F.col("outcome") == "deleted").cast("int"))
    return update(rows, marked, ["outcome", "executed"])


def dismiss(rows: DataFrame, paths: DataFrame) -> DataFrame:
    return set_outcomes(rows, paths.select("source_path").withColumn("outcome", F.lit("ignored")))


def aggressive_deletes(rows: DataFrame) -> DataFrame:
    """(source_path) of scored duplicates that are not their group's best; those of low confidence are spared. match_confidence may be absent."""
    keep = best_per_group(rows).select("source_path")
    sure = F.lit(True) if "match_confidence" not in rows.columns else ~F.col("match_confidence").eqNullSafe(F.lit("low"))
    some = rows.where(F.col("group_id").isNotNull() & F.col("score").isNotNull() & F.col("action").isin("EXACT", "REVIEW_DUPLICATE") & sure)
    return some.join(keep, "source_path", "left_anti").select("source_path")


def auto_select(rows: DataFrame, aggressive: bool = False) -> DataFrame:
    """The rows with each group's best one kept: no decision, locked, action KEEP; on request the surer duplicates decided as delete."""
    keep = best_per_group(rows).select("source_path").distinct().withColumn("_keep", F.lit(True))
    out = rows.join(keep, "source_path", "left")
    if aggressive:
        out = out.join(aggressive_deletes(rows).distinct().withColumn("_drop", F.lit(True)), "source_path", "left")
    else:
        out = out.withColumn("_drop", F.lit(None).cast("boolean"))
    new = {
        "user_decision": F.when(F.col("_keep"), "").when(F.col("_drop"), "delete").otherwise(F.col("user_decision")),
        "is_locked": F.when(F.col("_keep"), F.lit(1).cast(dict(rows.dtypes)["is_locked"])).otherwise(F.col("is_locked")),
        "action": F.when(F.col("_keep"), "KEEP").otherwise(F.col("action")),
    }
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def decide(rows: DataFrame, paths: DataFrame, decision: str, locked_rows: str = "unlocked_only") -> DataFrame:
    """A decision on paths that respects locks: unlocked_only leaves locked rows, unlock decides and unlocks them, cancel changes nothing if one is locked.

    __lock__ and __unlock__ set the lock instead.
    """
    hit = rows.join(paths.select("source_path").distinct().withColumn("_hit", F.lit(True)), "source_path", "left")
    is_hit, locked = F.coalesce("_hit", F.lit(False)), F.coalesce(F.col("is_locked").cast("int"), F.lit(0)) != 0
    kind = dict(rows.dtypes)["is_locked"]
    new_lock, new_decision = F.col("is_locked"), F.col("user_decision")
    if decision in ("__lock__", "__unlock__"):
        new_lock = F.when(is_hit, F.lit(int(decision == "__lock__")).cast(kind)).otherwise(F.col("is_locked"))
    elif locked_rows == "cancel" and not hit.where(is_hit & locked).isEmpty():
        return rows
    elif locked_rows == "unlock":
        new_lock = F.when(is_hit, F.lit(0).cast(kind)).otherwise(F.col("is_locked"))
        new_decision = F.when(is_hit, decision).otherwise(F.col("user_decision"))
    else:
        new_decision = F.when(is_hit & ~locked, decision).otherwise(F.col("user_decision"))
    new = {"is_locked": new_lock, "user_decision": new_decision}
    return hit.select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def _within(rows: DataFrame, scope: DataFrame | None) -> DataFrame:
    """Adds _in: whether the row's path is in the scope (source_path; None: all are)."""
    if scope is None:
        return rows.withColumn("_in", F.lit(True))
    hit = rows.join(scope.select("source_path").distinct().withColumn("_hit", F.lit(True)), "source_path", "left")
    return hit.withColumn("_in", F.coalesce("_hit", F.lit(False))).drop("_hit")


def _locked() -> Column:
    return F.coalesce(F.col("is_locked").cast("int"), F.lit(0)) != 0


def lock_gate(rows: DataFrame, verdict: str, scope: DataFrame | None = None) -> DataFrame:
    """What becomes of locked rows decided as delete before the decisions are executed.

    unlock: they lose the lock, so they go with the others. clear: they lose the decision and keep the lock. cancel: nothing
    changes. Rows outside the scope, and rows of other decisions, are left as they are.
    """
    if verdict not in ("unlock", "clear", "cancel"):
        raise ValueError(f"unknown verdict {verdict}")
    if verdict == "cancel":
        return rows
    hit = F.col("_in") & _locked() & F.col("user_decision").eqNullSafe("delete")
    zero = F.lit(0).cast(dict(rows.dtypes)["is_locked"])
    new = {"is_locked": F.when(hit, zero).otherwise(F.col("is_locked"))} if verdict == "unlock" else {"user_decision": F.when(hit, "").otherwise(F.col("user_decision"))}
    return _within(rows, scope).select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def execute(rows: DataFrame, scope: DataFrame | None = None, verdict: str | None = None) -> DataFrame:
    """Outcomes of the decisions within the scope (source_path; None: all): delete gives deleted, ignore gives ignored. Files are not touched.

    Locked rows decided as delete meet the lock gate: unlock and clear as in `lock_gate`, cancel changes nothing at all if there is
    one, and without a verdict they are spared. The lock does not stop ignore.
    """
    doomed = F.col("user_decision").eqNullSafe("delete")
    if verdict == "cancel" and not _within(rows, scope).where(F.col("_in") & doomed & _locked()).isEmpty():
        return rows
    gated = rows if verdict is None else lock_gate(rows, verdict, scope)
    gone, passed = F.col("_in") & doomed & ~_locked(), F.col("_in") & F.col("user_decision").eqNullSafe("ignore")
    new = {
        "outcome": F.when(gone, "deleted").when(passed, "ignored").otherwise(F.col("outcome")),
        "executed": F.when(gone, F.lit(1)).when(passed, F.lit(0)).otherwise(F.col("executed")),
    }
    return _within(gated, scope).select(*[new[c].alias(c) if c in new else F.col(c) for c in rows.columns])


def delete_paths(rows: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """(source_path) of the delete plan: the selected paths (default: those decided as delete) without those of locked rows.

    Selected paths that the manifest does not know stay in the plan. `delete_plan` counts locked rows as selected all the same.
    """
    chosen = rows.where(F.col("user_decision") == "delete") if selected is None else selected
    return without_locked(chosen.select("source_path").distinct(), rows)


def without_locked(paths: DataFrame, rows: DataFrame) -> DataFrame:
    """The paths without those of a locked row."""
    return paths.join(rows.where(_locked()).select("source_path").distinct(), "source_path", "left_anti")


def prune_singles(rows: DataFrame, policy: str = "always", locked_rows: str = "unlocked_only", plain: bool = True, actioned: bool = True, group: str = "group_id") -> DataFrame:
    """The rows with those alone in their group dismissed, by policy.

    never: none. always: plain ones and ones with a decision. ask: those of the two kinds that were agreed to. Locked ones go only
    with locked_rows unlock, whatever the policy; unlocked_only and cancel leave them, and only them.
    """
    from .review import single_rows

    if policy not in ("never", "always", "ask") or locked_rows not in ("unlocked_only", "unlock", "cancel"):
        raise ValueError(f"unknown policy {policy} or {locked_rows}")
    if policy == "never":
        return rows
    kinds = [k for k, yes in (("plain", plain or policy == "always"), ("actioned", actioned or policy == "always"), ("locked", locked_rows == "unlock")) if yes]
    return dismiss(rows, single_rows(rows, group).where(F.col("kind").isin(kinds)))


def export_decisions(rows: DataFrame, changes: DataFrame, path: str, source: str | None = None) -> None:
    """Writes the manifest with changed decisions (source_path, user_decision) to a copy at another path.

    The table the rows were read from (source) is not changed; a path equal to it raises ValueError.
    """
    if source is not None and path.rstrip("/") == source.rstrip("/"):
        raise ValueError("the copy needs a path of its own")
    write_manifest(set_decisions(rows, changes), path)


def write_audit(results: DataFrame, path: str) -> None:
    """GroupNumber, FilePath, Success (0 or 1), Reason as CSV files with a header; rows of unknown paths are group 0."""
    results.select(
        F.coalesce("group_number", F.lit(0)).alias("GroupNumber"), F.col("source_path").alias("FilePath"), F.col("success").cast("int").alias("Success"), F.col("reason").alias("Reason")
    ).write.mode("overwrite").option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
