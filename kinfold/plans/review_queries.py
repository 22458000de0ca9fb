"""Queries of selection, review, decisions, table handling, scalar functions and metadata; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels as L
from ..functions import paths as P
from ..operators import manifest as M
from ..operators import metadata as X
from ..operators import review as R
from ..operators import select as S
from ..runtime import Scratch, table
from ..schema import align_manifest
from ..sources import files
from .fixtures import MANIFEST_SQL, MEDIA_SQL, dated_manifest, manifest, media

QUERIES: dict = {}
SQL: dict[str, str] = {}
W = f"WITH {MANIFEST_SQL}"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


VISIBLE = f"""{W}, shown AS (SELECT * FROM manifest WHERE coalesce(outcome, '') = ''),
kept AS (SELECT *, dense_rank() OVER (ORDER BY group_id) AS group_number FROM (SELECT * FROM shown WHERE group_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY group_id) >= 2))"""
NAME = "regexp_extract(source_path, '([^/]*)$', 1)"
FOLDER = "regexp_replace(source_path, '/?[^/]*$', '') || '/'"
PIXELS = "coalesce(pixel_width, 0)::BIGINT * coalesce(pixel_height, 0)"
TIER = "CASE WHEN coalesce(action, '') IN ('KEEP', 'UNDATED', '') THEN 1 WHEN action = 'EXACT' THEN 2 WHEN action = 'REVIEW_DUPLICATE' THEN 3 ELSE 4 END"


# -- loading and review ---------------------------------------------------------------------------------------


@query(f"{VISIBLE} SELECT id, group_number FROM kept")
def s8_load(spark, d):
    return M.open_manifest(manifest(spark, d)).select("id", "group_number")


@query(f"{VISIBLE} SELECT id FROM kept")
def a8_survivors(spark, d):
    return R.survivors(R.visible(manifest(spark, d))).select("id")


@query(f"{VISIBLE} SELECT DISTINCT group_id, group_number FROM kept")
def w6_group_numbers(spark, d):
    return R.load(manifest(spark, d)).select("group_id", "group_number").distinct()


@query(f"{W} SELECT id FROM manifest WHERE coalesce(outcome, '') = ''")
def pr10_visible(spark, d):
    return R.visible(manifest(spark, d)).select("id")


@query(f"""{VISIBLE} SELECT group_number, source_path AS file_path, {FOLDER} AS folder_path, coalesce(action, '') AS action, coalesce(user_decision, '') AS user_decision,
coalesce(file_size_bytes, 0) AS file_size_bytes, pixel_width, pixel_height, hamming_distance, phash, score, coalesce(is_locked, 0) <> 0 AS is_locked FROM kept""")
def pr9_photo_records(spark, d):
    return R.photo_records(R.load(manifest(spark, d))).drop("creation_date", "shot_date", "capture_date")


@query(f"""{W} SELECT action, "rows", round("rows" * 100.0::DOUBLE / sum("rows") OVER (), 1) AS percent FROM (
SELECT CASE WHEN coalesce(action, '') IN ('EXACT', 'REVIEW_DUPLICATE', 'UNDATED', 'KEEP', '') THEN coalesce(action, '') ELSE 'other' END AS action, count(*) AS "rows" FROM manifest GROUP BY 1)""")
def a4_action_histogram(spark, d):
    return R.action_histogram(manifest(spark, d))


@query(f"{W} SELECT count(DISTINCT group_id) AS groups, count(group_id) AS grouped_rows, count(*) - count(group_id) AS isolated_rows FROM manifest")
def a5_group_summary(spark, d):
    return R.group_summary(manifest(spark, d))


@query(f"""{W} SELECT group_id, min(CASE user_decision WHEN 'delete' THEN 1 WHEN 'keep' THEN 2 WHEN 'ignore' THEN 4 ELSE 3 END) AS decision_rank,
max(CAST(coalesce(is_locked, 0) <> 0 AS INT)) AS locked, min(lower({NAME})) AS first_name, min(lower({FOLDER})) AS first_folder, max(coalesce(file_size_bytes, 0)) AS largest, count(*) AS members,
coalesce(min(epoch_us(creation_date) // 1000000), 0) AS created, coalesce(min(epoch_us(shot_date) // 1000000), 0) AS shot, max({PIXELS}) AS pixels, coalesce(max(score), -1) AS score
FROM manifest WHERE group_id IS NOT NULL GROUP BY group_id""")
def a6_group_rollup(spark, d):
    return R.group_rollup(manifest(spark, d))


@query()
def a6_group_rollup_all_dates(spark, d):
    return R.group_rollup(dated_manifest(spark, d))


@query(f"{W} SELECT *, total = selected AS is_full_delete FROM (SELECT group_id, count(*) AS total, count_if(user_decision = 'delete') AS selected FROM manifest WHERE group_id IS NOT NULL GROUP BY 1)")
def a7_delete_plan(spark, d):
    return R.delete_plan(manifest(spark, d))


@query(f"{W} SELECT group_id FROM manifest WHERE group_id IS NOT NULL GROUP BY 1 HAVING count(*) = count_if(user_decision = 'delete')")
def pr17_full_deletes(spark, d):
    return R.delete_plan(manifest(spark, d)).where("is_full_delete").select("group_id")


@query(f"{W} SELECT count_if(coalesce(user_decision, '') <> '') AS decided, count_if(user_decision = 'delete') AS deletes, 0::BIGINT AS hidden_deletes FROM manifest")
def a10_counters(spark, d):
    return R.counters(manifest(spark, d))


@query(f"{W} SELECT count_if(user_decision = 'ignore') AS decided, 0::BIGINT AS deletes, count_if(user_decision = 'delete') AS hidden_deletes FROM manifest")
def a12_hidden_deletes(spark, d):
    return R.counters(manifest(spark, d), "ignore")


@query(f"{W} SELECT group_id FROM manifest WHERE group_id IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(user_decision, '') = 'delete')")
def a13_complete_deletes(spark, d):
    return R.complete_deletes(manifest(spark, d))


@query(f"""{W} SELECT source_path, CASE WHEN coalesce(is_locked, 0) <> 0 THEN 'locked' WHEN user_decision <> '' THEN 'actioned' ELSE 'plain' END AS kind FROM manifest
WHERE group_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY group_id) = 1""")
def a14_single_rows(spark, d):
    return R.single_rows(manifest(spark, d))


@query(f"{VISIBLE} SELECT count(DISTINCT group_id) AS groups, count(*) AS grouped_rows, (SELECT count(*) FROM shown) - count(*) AS isolated_rows FROM kept")
def a19_baseline(spark, d):
    return R.baseline(manifest(spark, d))


@query(f"{VISIBLE} SELECT greatest((SELECT count(*) FROM shown) - count(*), 0) AS isolated_rows FROM kept")
def s11_isolated(spark, d):
    return R.isolated_count(manifest(spark, d))


_REF = f"""refs AS (SELECT group_id, source_path AS ref_path, phash AS ref_hash FROM manifest WHERE group_id IS NOT NULL AND {TIER} IN (1, 4)
QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC NULLS LAST, source_path, phash NULLS FIRST) = 1)"""


@query(f"{W}, {_REF} SELECT group_id, ref_path AS source_path, ref_hash AS phash FROM refs")
def w4_reference(spark, d):
    return R.reference_of_group(manifest(spark, d))


_HEX = "CASE WHEN regexp_matches({0}, '^[0-9a-fA-F]{{16}}$') THEN CAST('0x' || {0} AS UBIGINT) END"
_DIST = f"bit_count(xor({_HEX.format('m.phash')}, {_HEX.format('ref_hash')}))"


def _percent(x: str) -> str:
    return f"CAST(CAST(round_even((64 - {x}) / 64.0 * 100, 0) AS INT) AS VARCHAR) || '%'"


@query(f"""{W}, {_REF}, met AS (SELECT m.*, ref_path, {_DIST} AS dist FROM manifest m LEFT JOIN refs USING (group_id))
SELECT id, CASE WHEN action = 'EXACT' THEN '100%' WHEN action = 'REVIEW_DUPLICATE' THEN coalesce({_percent('coalesce(dist, hamming_distance)')}, 'near-dup') WHEN ref_path = source_path THEN 'Ref'
WHEN dist IS NOT NULL THEN replace({_percent('dist')}, '%', '*%') ELSE '—' END AS similarity FROM met""")
def f10_similarity_labels(spark, d):
    return R.similarity_labels(manifest(spark, d)).select("id", "similarity")


@query(f"""{W}, h AS (SELECT id, group_id, {_HEX.format('phash')} AS h FROM manifest WHERE group_id IS NOT NULL), u AS (SELECT * FROM h WHERE h IS NOT NULL)
SELECT u.id, (SELECT v.id FROM u v WHERE v.group_id = u.group_id AND v.id <> u.id ORDER BY bit_count(xor(u.h, v.h)), v.id LIMIT 1) AS nearest FROM u""")
def j11_nearest_member(spark, d):
    return R.nearest_member(manifest(spark, d))


@query(f"{W}, {_REF} SELECT id, CAST({_DIST} AS INT) AS distance FROM manifest m JOIN refs USING (group_id)")
def j12_distance_to_reference(spark, d):
    m = manifest(spark, d)
    ref = R.reference_of_group(m).select("group_id", F.col("phash").alias("r"))
    return m.join(ref, "group_id").select("id", L.hamming(F.col("phash"), F.col("r")).alias("distance"))


@query(f"{W} SELECT id FROM manifest WHERE user_decision = 'delete'")
def pr14_of_decision(spark, d):
    return R.of_decision(manifest(spark, d), "delete").select("id")


@query(f"{W} SELECT id FROM manifest WHERE group_id IN (SELECT group_id FROM manifest WHERE user_decision <> '')")
def pr15_decided_groups(spark, d):
    return R.decided_groups(manifest(spark, d)).select("id")


@query(f"{W} SELECT id FROM manifest WHERE group_id IN (SELECT group_id FROM manifest WHERE source_path IN (SELECT source_path FROM manifest_row))")
def pr16_whole_groups(spark, d):
    return R.whole_groups(manifest(spark, d), table(spark, d, "manifest_row")).select("id")


@query(f"{W} SELECT DISTINCT source_path FROM manifest WHERE action = 'KEEP' AND source_path <> ''")
def pr18_keeper_paths(spark, d):
    return R.keeper_paths(manifest(spark, d))


@query(f"{W} SELECT count(*) > 0 AS found FROM manifest WHERE user_decision <> '' AND source_path IN (SELECT source_path FROM manifest_row)")
def pr19_any_decided(spark, d):
    return R.any_decided(manifest(spark, d), table(spark, d, "manifest_row"))


@query(f"{VISIBLE} SELECT match_id, coalesce(min(group_number), 0) AS group_number FROM manifest_row r LEFT JOIN kept k USING (source_path) GROUP BY 1")
def j9_group_of_path(spark, d):
    known = R.load(manifest(spark, d)).groupBy("source_path").agg(F.min("group_number").alias("group_number"))
    return R.group_of_path(table(spark, d, "manifest_row").select("match_id", "source_path"), known).select("match_id", "group_number")


@query(f"{W} SELECT id, source_path IN (SELECT source_path FROM manifest_row WHERE source_path IS NOT NULL) AS known FROM manifest WHERE source_path IS NOT NULL")
def j10_known_paths(spark, d):
    m, paths = manifest(spark, d).where("source_path is not null"), table(spark, d, "manifest_row")
    return R.known_paths(m, paths).select("id", F.lit(True).alias("known")).unionByName(R.known_paths(m, paths, known=False).select("id", F.lit(False).alias("known")))


# -- selection ------------------------------------------------------------------------------------------------


@query(f"{W} SELECT group_id, source_path FROM manifest WHERE group_id IS NOT NULL AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, source_path) = 1")
def w1_best_per_group(spark, d):
    return S.best_per_group(manifest(spark, d))


@query(f"{W} SELECT DISTINCT source_path FROM manifest WHERE group_id IS NOT NULL AND file_size_bytes IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY file_size_bytes, source_path) <= 2")
def w2_smallest_two(spark, d):
    return S.rank_in_group(manifest(spark, d), "Size (Bytes)", 2, descending=False).select("source_path").distinct()


@query(f"{W} SELECT DISTINCT group_id, source_path, value FROM (SELECT group_id, source_path, score AS value FROM manifest WHERE group_id IS NOT NULL AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, source_path) <= 3)")
def w3_top_three_scores(spark, d):
    return S.rank_in_group(manifest(spark, d), "Score", 3).select("group_id", "source_path", "value").distinct()


@query(f"""{W} SELECT DISTINCT source_path FROM manifest WHERE group_id IS NOT NULL AND score IS NOT NULL AND action IN ('EXACT', 'REVIEW_DUPLICATE') AND source_path NOT IN (
SELECT source_path FROM manifest WHERE group_id IS NOT NULL AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, source_path) = 1)""")
def w7_aggressive_deletes(spark, d):
    return M.aggressive_deletes(manifest(spark, d)).distinct()


@query(f"{W} SELECT id FROM manifest WHERE score >= 0.5")
def w8_threshold(spark, d):
    return S.by_threshold(manifest(spark, d), "Score", ">=", "0.5").select("id")


@query(f"{W} SELECT id FROM manifest WHERE shot_date < TIMESTAMP '2020-01-01'")
def w8_date_threshold(spark, d):
    return S.by_threshold(manifest(spark, d), "Shot Date", "<", "2020-01-01").select("id")


@query()
def w8_date_threshold_all_dates(spark, d):
    return S.by_threshold(dated_manifest(spark, d), "Shot Date", "<", "2020-01-01").select("id")


@query(f"{W} SELECT id FROM manifest WHERE regexp_matches({NAME}, '(?i)^img_\\d+')")
def w9_regex(spark, d):
    return S.by_pattern(manifest(spark, d), "File Name", r"^img_\d+").select("id")


@query(f"{W} SELECT id FROM manifest WHERE hamming_distance <= 4")
def w10_pattern_language(spark, d):
    return S.select(manifest(spark, d), "Similarity", "__cmp__:<=:4").select("id")


@query(f"{W} SELECT id FROM manifest WHERE contains(lower({FOLDER}), 'whatsapp images')")
def w11_simple_operators(spark, d):
    return S.select(manifest(spark, d), "Folder", S.simple_pattern("contains", "WhatsApp Images")).select("id")


@query(f"{W} SELECT count_if(ends_with(lower({NAME}), '.heic')) AS matched, count(*) AS total, (SELECT list(n ORDER BY n) FROM (SELECT {NAME} AS n FROM manifest WHERE ends_with(lower({NAME}), '.heic') ORDER BY n LIMIT 50)) AS samples FROM manifest")
def a15_match_statistics(spark, d):
    return S.match_statistics(manifest(spark, d), "File Name", r"\.heic$")


@query(f"{W} SELECT id, row_number() OVER (ORDER BY group_id NULLS LAST, {TIER}, id) AS place FROM manifest")
def o1_load_order(spark, d):
    rows = manifest(spark, d).select("id", "group_id", S.tier(F.col("action")).alias("t"))
    return _places(rows, [F.col("group_id").asc_nulls_last(), F.col("t"), F.col("id")])


def _places(rows, order):
    """Row numbers of a global order without one task for all: sorted by range, counted per partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", F.monotonically_increasing_id().alias("m"))
    held = Scratch(rows.sparkSession, "places").keep(at)
    part, inside = F.shiftright("m", 33), F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = held.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    before = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    return held.select("id", part.alias("p"), inside.alias("i")).join(F.broadcast(before), "p").select("id", (F.col("i") + F.col("b") + 1).alias("place"))


@query(f"{W} SELECT id, row_number() OVER (ORDER BY coalesce(score, 0) DESC, coalesce(source_path, ''), id) AS place FROM manifest")
def o2_multi_key_sort(spark, d):
    rows = manifest(spark, d)
    return _places(rows, [*S.sort_keys(rows, [("score", False), ("source_path", True)]), F.col("id")])


@query(f"{W} SELECT id, row_number() OVER (ORDER BY coalesce(score, 0) DESC, coalesce(file_size_bytes, 0), id) AS place FROM manifest")
def o3_score_first(spark, d):
    rows = manifest(spark, d)
    return _places(rows, [*S.sort_keys(rows, S.with_score_first([("file_size_bytes", True)])), F.col("id")])


@query(f"{W} SELECT id, row_number() OVER (ORDER BY lower(source_path), id) AS place FROM manifest")
def o4_header_sort(spark, d):
    rows = manifest(spark, d)
    return _places(rows, [*S.header_order(rows, "source_path"), F.col("id")])


@query(f"{W} SELECT id FROM manifest QUALIFY source_label IS DISTINCT FROM 'jdrive' OR row_number() OVER (PARTITION BY source_label ORDER BY id) <= 100")
def o6_limit_per_source(spark, d):
    return S.limit_per_source(manifest(spark, d), {"jdrive": 100}).select("id")


_DEVICE = "CASE WHEN starts_with(replace(source_path, chr(92), '/'), '//') THEN upper(split_part(replace(source_path, chr(92), '/'), '/', 3)) ELSE '' END"


@query(f"""{W}, dev AS (SELECT id, {_DEVICE} AS dev FROM manifest), first AS (SELECT dev, min(id) AS f FROM dev GROUP BY 1)
SELECT id FROM (SELECT id, f, row_number() OVER (PARTITION BY dev ORDER BY id) AS r FROM dev JOIN first USING (dev)) ORDER BY r, f LIMIT 60""")
def o7_stratified_sample(spark, d):
    return S.stratified(manifest(spark, d), 60).select("id")


@query(f"{W} SELECT id, CASE WHEN pixel_width > 0 AND pixel_height > 0 THEN pixel_width || '*' || pixel_height ELSE '' END AS resolution, CASE WHEN pixel_width > 0 AND pixel_height > 0 AND pixel_width > pixel_height THEN 0 WHEN pixel_width > 0 AND pixel_height > 0 AND pixel_width < pixel_height THEN 2 ELSE 1 END AS aspect FROM manifest")
def o8_aspect(spark, d):
    text = L.resolution_text(F.col("pixel_width"), F.col("pixel_height"))
    return manifest(spark, d).select("id", text.alias("resolution"), L.aspect_bucket(text).alias("aspect"))


# -- decisions ------------------------------------------------------------------------------------------------

_NEW = "new AS (SELECT source_path, max(CASE WHEN match_confidence = 'high' THEN 'delete' ELSE 'ignore' END) AS d FROM manifest_row GROUP BY 1)"


def _changes(spark, d):
    return table(spark, d, "manifest_row").select("source_path", F.when(F.col("match_confidence") == "high", "delete").otherwise("ignore").alias("user_decision"))


@query(f"{W}, {_NEW} SELECT id, coalesce(d, user_decision) AS user_decision FROM manifest LEFT JOIN new USING (source_path)")
def d1_set_decisions(spark, d):
    return M.set_decisions(manifest(spark, d), _changes(spark, d)).select("id", "user_decision")


@query(f"{W} SELECT id, CASE WHEN source_path IN (SELECT source_path FROM manifest_row) THEN 1 ELSE is_locked END AS is_locked FROM manifest")
def d2_set_locks(spark, d):
    return M.set_locks(manifest(spark, d), _changes(spark, d).select("source_path", F.lit(1).alias("is_locked"))).select("id", "is_locked")


@query(f"{W}, {_NEW} SELECT id, CASE d WHEN 'delete' THEN 'deleted' WHEN 'ignore' THEN 'ignored' ELSE outcome END AS outcome, CASE d WHEN 'delete' THEN 1 WHEN 'ignore' THEN 0 ELSE executed END AS executed FROM manifest LEFT JOIN new USING (source_path)")
def d4_set_outcomes(spark, d):
    # 'ignored' sorts after 'deleted' as 'ignore' does after 'delete': the same change wins.
    c = _changes(spark, d).select("source_path", F.when(F.col("user_decision") == "delete", "deleted").otherwise("ignored").alias("outcome"))
    return M.set_outcomes(manifest(spark, d), c).select("id", "outcome", "executed")


@query(f"{W} SELECT id, CASE WHEN source_path IN (SELECT source_path FROM manifest_row) THEN 'ignored' ELSE outcome END AS outcome FROM manifest")
def d5_dismiss(spark, d):
    return M.dismiss(manifest(spark, d), table(spark, d, "manifest_row")).select("id", "outcome")


@query(f"""{W}, best AS (SELECT source_path FROM manifest WHERE group_id IS NOT NULL AND score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, source_path) = 1),
doomed AS (SELECT source_path FROM manifest WHERE group_id IS NOT NULL AND score IS NOT NULL AND action IN ('EXACT', 'REVIEW_DUPLICATE') AND source_path NOT IN (FROM best))
SELECT id, CASE WHEN source_path IN (FROM best) THEN 'KEEP' ELSE action END AS action, CASE WHEN source_path IN (FROM best) THEN '' WHEN source_path IN (FROM doomed) THEN 'delete' ELSE user_decision END AS user_decision,
CASE WHEN source_path IN (FROM best) THEN 1 ELSE is_locked END AS is_locked FROM manifest""")
def d6_auto_select(spark, d):
    return M.auto_select(manifest(spark, d), aggressive=True).select("id", "action", "user_decision", "is_locked")


@query(f"{W} SELECT id, CASE WHEN source_path IN (SELECT source_path FROM manifest_row) AND coalesce(is_locked, 0) = 0 THEN 'delete' ELSE user_decision END AS user_decision FROM manifest")
def d7_decide_unlocked(spark, d):
    return M.decide(manifest(spark, d), table(spark, d, "manifest_row"), "delete").select("id", "user_decision")


@query(f"{W} SELECT id, CASE WHEN source_path IN (SELECT source_path FROM manifest_row) THEN 0 ELSE is_locked END AS is_locked, CASE WHEN source_path IN (SELECT source_path FROM manifest_row) THEN 'delete' ELSE user_decision END AS user_decision FROM manifest")
def d8_decide_and_unlock(spark, d):
    return M.decide(manifest(spark, d), table(spark, d, "manifest_row"), "delete", "unlock").select("id", "is_locked", "user_decision")


@query(f"{W} SELECT id, CASE WHEN user_decision = 'delete' AND coalesce(is_locked, 0) = 0 THEN 'deleted' WHEN user_decision = 'ignore' THEN 'ignored' ELSE outcome END AS outcome FROM manifest")
def d9_execute(spark, d):
    return M.execute(manifest(spark, d)).select("id", "outcome")


_SCOPE = "source_path IN (SELECT source_path FROM manifest_row WHERE source_path IS NOT NULL)"


@query(f"{W} SELECT id, CASE WHEN NOT {_SCOPE} THEN outcome WHEN user_decision = 'delete' THEN 'deleted' WHEN user_decision = 'ignore' THEN 'ignored' ELSE outcome END AS outcome FROM manifest")
def d9_execute_unlocked_in_scope(spark, d):
    return M.execute(manifest(spark, d), table(spark, d, "manifest_row"), "unlock").select("id", "outcome")


@query(f"{W} SELECT id, user_decision, is_locked, outcome FROM manifest")
def d9_execute_cancelled(spark, d):
    # One locked row decided as delete is planted, so that the gate has something to ask about.
    m = manifest(spark, d)
    first = F.col("id") == m.agg(F.min("id")).first()[0]
    planted = m.withColumns({
        "old": F.struct("user_decision", "is_locked"), "user_decision": F.when(first, "delete").otherwise(F.col("user_decision")), "is_locked": F.when(first, 1).otherwise(F.col("is_locked")),
    })
    return M.execute(planted, None, "cancel").select("id", "old.user_decision", "old.is_locked", "outcome")


@query(f"{W} SELECT id, is_locked, CASE WHEN {_SCOPE} AND user_decision = 'delete' AND coalesce(is_locked, 0) <> 0 THEN '' ELSE user_decision END AS user_decision FROM manifest")
def d8_gate_clears(spark, d):
    return M.lock_gate(manifest(spark, d), "clear", table(spark, d, "manifest_row")).select("id", "is_locked", "user_decision")


@query(f"{W} SELECT id, CASE WHEN {_SCOPE} AND user_decision = 'delete' AND coalesce(is_locked, 0) <> 0 THEN 0 ELSE is_locked END AS is_locked, user_decision FROM manifest")
def d8_gate_unlocks(spark, d):
    return M.lock_gate(manifest(spark, d), "unlock", table(spark, d, "manifest_row")).select("id", "is_locked", "user_decision")


@query(f"{W} SELECT DISTINCT source_path FROM manifest WHERE user_decision = 'delete' AND source_path NOT IN (SELECT source_path FROM manifest WHERE coalesce(is_locked, 0) <> 0 AND source_path IS NOT NULL)")
def d10_delete_paths(spark, d):
    return M.delete_paths(manifest(spark, d))


@query(f"{W} SELECT group_id FROM manifest WHERE group_id IS NOT NULL AND {_SCOPE} GROUP BY 1 HAVING count(*) = count_if(user_decision = 'delete')")
def a13_complete_deletes_in_scope(spark, d):
    return R.complete_deletes(manifest(spark, d), scope=table(spark, d, "manifest_row"))


@query(f"{W}, rest AS (SELECT * FROM manifest WHERE source_path NOT IN (SELECT source_path FROM manifest_row WHERE source_path IS NOT NULL)) SELECT id FROM rest WHERE group_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY group_id) >= 2")
def u4_without_paths(spark, d):
    return R.without_paths(manifest(spark, d), table(spark, d, "manifest_row"), prune_singles=True).select("id")


@query(f"{W} SELECT id FROM manifest WHERE group_id IS DISTINCT FROM (SELECT max(group_id) FROM manifest)")
def u5_without_group(spark, d):
    m = manifest(spark, d)
    last = m.agg(F.max("group_id").alias("last"))
    return m.join(last, ~m["group_id"].eqNullSafe(last["last"])).select("id")


@query(f"{W} SELECT DISTINCT source_path FROM manifest WHERE user_decision = 'delete' INTERSECT SELECT source_path FROM manifest_row")
def u3_filter_and_selection(spark, d):
    return R.in_both(R.of_decision(manifest(spark, d), "delete"), table(spark, d, "manifest_row"))


@query(f"{W} SELECT source_path, 'old' AS origin FROM manifest UNION ALL SELECT source_path, 'new' FROM incoming_manifest")
def u2_union_of_sources(spark, d):
    return R.union_of_sources({"old": manifest(spark, d), "new": table(spark, d, "incoming_manifest")})


@query("SELECT source_path AS a, duplicate_of AS b FROM manifest_row UNION ALL SELECT duplicate_of, source_path FROM manifest_row")
def u1_edge_bag(spark, d):
    return R.edge_bag(table(spark, d, "manifest_row"))


# -- the table ------------------------------------------------------------------------------------------------


@query(f"{W} SELECT id, source_path, CASE WHEN action = 'MOVE' THEN '' ELSE action END AS action, '' AS outcome, 0 AS is_locked FROM manifest")
def s12_align_schema(spark, d):
    old = manifest(spark, d).drop("outcome", "is_locked").withColumn("dest_path", F.lit("x"))
    return align_manifest(old).select("id", "source_path", "action", "outcome", "is_locked")


@query(f"{W} SELECT id, source_path, group_id, score FROM manifest")
def s7_write_and_read(spark, d):
    at = f"{Scratch(spark, 'sink').root}/manifest"
    M.write_manifest(manifest(spark, d), at)
    return M.read_manifest(spark, at).select("id", "source_path", "group_id", "score")


@query(f"{VISIBLE} SELECT CAST(coalesce(min(group_number), 0) AS VARCHAR) AS \"GroupNumber\", source_path AS \"FilePath\", '1' AS \"Success\" FROM manifest_row r LEFT JOIN kept k USING (source_path) WHERE source_path <> '' GROUP BY source_path, match_id")
def s10_audit(spark, d):
    known = R.load(manifest(spark, d)).groupBy("source_path").agg(F.min("group_number").alias("group_number"))
    done = R.group_of_path(table(spark, d, "manifest_row").select("source_path").where("source_path <> ''"), known)
    at = f"{Scratch(spark, 'audit').root}/audit"
    M.write_audit(done.withColumns({"success": F.lit(True), "reason": F.lit("")}), at)
    return spark.read.option("header", True).csv(at).select("GroupNumber", "FilePath", "Success")


@query(f"{W} SELECT id, CASE WHEN {_SCOPE} THEN 'ignore' ELSE user_decision END AS user_decision FROM manifest")
def s9_export_copy(spark, d):
    at = f"{Scratch(spark, 'export').root}/copy"
    changes = table(spark, d, "manifest_row").select("source_path", F.lit("ignore").alias("user_decision")).where("source_path is not null")
    M.export_decisions(manifest(spark, d), changes, at, source=f"{d}/migration_manifest.parquet")
    return M.read_manifest(spark, at).select("id", "user_decision")


@query()
def s1_scan_sources(spark, d):
    return files.scan_sources(spark, {"data": d}, media_only=False).select("ord", "source_label", P.basename(F.col("path")).alias("name"), "size", "unsafe_name")


@query()
def s4_read_stage(spark, d):
    return files.read_stage(files.scan_sources(spark, {"data": d}, media_only=False)).select(P.basename(F.col("path")).alias("name"), "file_type", "sha256", "error")


# -- scalar functions -----------------------------------------------------------------------------------------

_EXT = "lower(regexp_extract(regexp_extract(path, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1))"


@query(f"WITH {MEDIA_SQL} SELECT ord, {_EXT} AS ext, {_EXT} IN ('jpg', 'jpeg', 'heic', 'heif', 'png', 'gif', 'webp', 'tif', 'tiff', 'dng', 'cr2', 'cr3', 'nef', 'arw', 'raf', 'rw2', 'mp4', 'm4v', 'avi', 'mov') AS media, {_EXT} IN ('mp4', 'mov', 'm4v', 'avi') AS video, file_type, regexp_replace(path, '/?[^/]*$', '') AS parent FROM media")
def f16_path_parts(spark, d):
    p = F.col("path")
    return media(spark, d).select("ord", P.suffix(p).alias("ext"), P.is_media(p).alias("media"), P.is_video(p).alias("video"), "file_type", P.parent(p).alias("parent"))


@query(f"WITH {MEDIA_SQL} SELECT ord, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\\.[^.]+$', '\\1') AS stem, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '[.\\s]$') AS unsafe, lower(regexp_extract(path, '([^/]*)$', 1)) IN ('thumbs.db', 'desktop.ini', 'failed_inserting_exif.txt', '.ds_store') AS skipped, list_has_any(string_split(lower(regexp_replace(path, '/?[^/]*$', '')), '/'), ['$recycle.bin', 'system volume information', '.trashes', '.trash']) AS trashed FROM media")
def pr2_name_filters(spark, d):
    p = F.col("path")
    return media(spark, d).select("ord", P.stem(p).alias("stem"), P.has_unsafe_name(p).alias("unsafe"), P.is_skipped_name(p).alias("skipped"), P.in_skipped_directory(p).alias("trashed"))


_CLEAN = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]+$', '\1')"


@query(rf"WITH {MEDIA_SQL}, s AS (SELECT ord, {_CLEAN} || CASE WHEN ord % 3 = 0 THEN '-edited' ELSE '' END || CASE WHEN ord % 2 = 0 THEN '(7)' ELSE '' END AS stem FROM media) SELECT ord, regexp_replace(stem, '\(\d+\)$', '') AS base_stem, TRY_CAST(nullif(regexp_extract(stem, '\((\d+)\)$', 1), '') AS INT) AS number, ord % 3 = 0 AS is_edited, regexp_replace(regexp_replace(stem, '\(\d+\)$', ''), '-edited$', '') AS clean_stem FROM s")
def f6_filename_grammar(spark, d):
    stem = F.concat(P.stem(F.col("path")), F.when(F.col("ord") % 3 == 0, "-edited").otherwise(""), F.when(F.col("ord") % 2 == 0, "(7)").otherwise(""), F.lit(".jpg"))
    return media(spark, d).select("ord", stem.alias("n")).select("ord", *[c.alias(k) for k, c in P.name_parts(F.col("n")).items()])


@query(f"{W} SELECT id, CASE WHEN hamming_distance IS NULL THEN 'near-dup' ELSE {_percent('hamming_distance')} END AS percent FROM manifest")
def f9_similarity_percent(spark, d):
    return manifest(spark, d).select("id", L.similarity_percent(F.col("hamming_distance")).alias("percent"))


@query(f"{W} SELECT id, CASE WHEN score IS NULL THEN '—' ELSE format('{{:.2f}}', score) END AS text FROM manifest")
def f11_score_text(spark, d):
    return manifest(spark, d).select("id", L.score_text(F.col("score")).alias("text"))


@query(r"SELECT id, TRY_STRPTIME(CASE WHEN regexp_matches(substr(trim(shot_date), 1, 19), '^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$') AND NOT starts_with(trim(shot_date), '0000:') THEN substr(trim(shot_date), 1, 19) END, '%Y:%m:%d %H:%M:%S') AS taken FROM migration_manifest")
def f7_exif_date(spark, d):
    return table(spark, d, "migration_manifest").select("id", L.exif_date(F.col("shot_date")).alias("taken"))


@query(f"{W} SELECT id, {_DEVICE.replace('upper(', chr(39) + chr(92) * 2 + chr(39) + ' || upper(')} AS device FROM manifest")
def f19_device_key(spark, d):
    return manifest(spark, d).select("id", P.device_key(F.col("source_path")).alias("device"))


@query(f"{W} SELECT id, sha1(source_path || '|' || file_size_bytes) AS key FROM manifest")
def f20_cache_key(spark, d):
    return manifest(spark, d).select("id", L.cache_key(F.col("source_path"), F.col("file_size_bytes")).alias("key"))


@query(f"""{W} SELECT id, CASE WHEN file_size_bytes IS NULL THEN '--:--' WHEN file_size_bytes // 1000 >= 3600 THEN printf('%02d:%02d:%02d', file_size_bytes // 3600000, file_size_bytes // 60000 % 60, file_size_bytes // 1000 % 60)
ELSE printf('%02d:%02d', file_size_bytes // 60000, file_size_bytes // 1000 % 60) END AS duration FROM manifest""")
def f26_duration_text(spark, d):
    return manifest(spark, d).select("id", L.duration_text(F.col("file_size_bytes")).alias("duration"))


@query(f"""{W}, s AS (SELECT id, exif_tag_count / nullif(pixel_width / 1000.0::DOUBLE, 0) AS s FROM manifest) SELECT id, CASE WHEN s IS NULL OR s <= 0 THEN '—' WHEN s < 1 THEN '<1s' WHEN s < 60 THEN '~' || CAST(floor(s) AS BIGINT) || 's'
ELSE printf('~%dm %02ds', CAST(floor(s) AS BIGINT) // 60, CAST(floor(s) AS BIGINT) % 60) END AS eta FROM s""")
def f25_eta_text(spark, d):
    return manifest(spark, d).select("id", L.eta_text(F.col("exif_tag_count"), F.col("pixel_width") / 1000.0).alias("eta"))


# -- metadata -------------------------------------------------------------------------------------------------


def _tool_output(spark, d):
    """The manifest's dates and counts as a metadata tool would report them: one JSON array a source, with a status line after it."""
    m = table(spark, d, "migration_manifest").where("source_path is not null")
    one = m.groupBy("source_path").agg(F.min(F.struct("id", "shot_date", "creation_date", "gps_present", "exif_tag_count")).alias("r"))
    tags = F.struct(
        F.col("source_path").alias("SourceFile"), F.col("r.shot_date").alias("EXIF:DateTimeOriginal"), F.col("r.creation_date").alias("QuickTime:CreateDate"),
        F.when(F.col("r.gps_present") == 1, "1.5").alias("EXIF:GPSLatitude"), F.col("r.exif_tag_count").cast("string").alias("XMP:Rating"),
    )
    return one.select(F.concat(F.lit("["), F.to_json(tags), F.lit("]\n    1 image files read\n")).alias("output"))


_TOOL = r"""tool AS (SELECT source_path, shot_date, creation_date, gps_present, exif_tag_count FROM migration_manifest WHERE source_path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_path ORDER BY id) = 1),
dated AS (SELECT *, TRY_STRPTIME(CASE WHEN regexp_matches(substr(trim(shot_date), 1, 19), '^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$') AND NOT starts_with(trim(shot_date), '0000:') THEN substr(trim(shot_date), 1, 19) END, '%Y:%m:%d %H:%M:%S') AS a,
TRY_STRPTIME(CASE WHEN regexp_matches(substr(trim(creation_date), 1, 19), '^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$') AND NOT starts_with(trim(creation_date), '0000:') THEN substr(trim(creation_date), 1, 19) END, '%Y:%m:%d %H:%M:%S') AS b FROM tool)"""


@query(rf"""WITH {_TOOL} SELECT i.id, coalesce(a, b) AS exif_date, CASE WHEN a IS NOT NULL THEN 'EXIF:DateTimeOriginal' WHEN b IS NOT NULL THEN 'QuickTime:CreateDate' END AS exif_date_tag,
CASE WHEN d.source_path IS NOT NULL THEN (shot_date IS NOT NULL)::INT + (creation_date IS NOT NULL)::INT + coalesce(gps_present = 1, false)::INT + (exif_tag_count IS NOT NULL)::INT END AS exif_tag_count,
CASE WHEN d.source_path IS NOT NULL THEN coalesce(gps_present = 1, false) END AS gps_present, exif_tag_count AS xmp_rating, CASE WHEN d.source_path IS NULL THEN 'no record' END AS error
FROM (SELECT id, source_path FROM migration_manifest UNION ALL SELECT id, source_path FROM incoming_manifest) i LEFT JOIN dated d USING (source_path)""")
def j1_metadata_bind(spark, d):
    both = table(spark, d, "migration_manifest").select("id", "source_path").unionByName(table(spark, d, "incoming_manifest").select("id", "source_path"))
    found = X.extracts(both.select(F.col("source_path").alias("path")).distinct(), X.tool_records(_tool_output(spark, d)))
    return both.join(found, F.col("source_path").eqNullSafe(F.col("path")), "left").select("id", "exif_date", "exif_date_tag", "exif_tag_count", "gps_present", "xmp_rating", "error")


@query(f"WITH {_TOOL} SELECT count(coalesce(a, b)) AS dates, count_if(coalesce(gps_present = 1, false)) AS places FROM dated")
def a18_coverage(spark, d):
    records = X.tool_records(_tool_output(spark, d))
    return X.coverage(X.extracts(records.select(F.col("SourceFile").alias("path")), records))


_PARTIALS = """parts AS (SELECT source_path AS path, id AS seq, CASE WHEN id % 3 = 0 THEN 'rawpy' WHEN id % 3 = 1 THEN 'exiftool' ELSE 'pil' END AS tool, pixel_width, pixel_height,
CASE WHEN id % 4 <> 0 THEN exif_tag_count END AS exif_tag_count, gps_present = 1 AS gps_present FROM migration_manifest WHERE source_path IS NOT NULL)"""


@query(f"""WITH {_PARTIALS} SELECT path, arg_min(pixel_width, (CASE WHEN tool = 'rawpy' THEN 0 ELSE 1 END, seq)) FILTER (pixel_width IS NOT NULL) AS pixel_width,
arg_min(exif_tag_count, seq) FILTER (exif_tag_count IS NOT NULL) AS exif_tag_count, arg_min(gps_present, seq) FILTER (gps_present IS NOT NULL) AS gps_present, list_sort(list_distinct(list(tool))) AS extracted_by FROM parts GROUP BY path""")
def a9_merge_extracts(spark, d):
    i = F.col("id")
    m = table(spark, d, "migration_manifest").where("source_path is not null")
    tool = F.when(i % 3 == 0, "rawpy").when(i % 3 == 1, "exiftool").otherwise("pil")
    parts = m.select(
        F.col("source_path").alias("path"), i.alias("seq"), F.array(tool).alias("extracted_by"), F.array().cast(T.ArrayType(T.StringType())).alias("errors"), F.lit("").alias("file_type"),
        "pixel_width", "pixel_height", F.lit(None).cast("timestamp_ntz").alias("exif_date"), F.lit(None).cast("string").alias("exif_date_tag"),
        F.when(i % 4 != 0, F.col("exif_tag_count")).alias("exif_tag_count"), (F.col("gps_present") == 1).alias("gps_present"), F.lit(None).cast("boolean").alias("xmp_derived"),
    )
    return X.merge_extracts(parts).select("path", "pixel_width", "exif_tag_count", "gps_present", "extracted_by")


@query(f"{W}, found AS (SELECT source_path, max(file_size_bytes) AS s, max(pixel_width) AS w FROM incoming_manifest GROUP BY 1) SELECT id, coalesce(s, file_size_bytes) AS file_size_bytes, coalesce(pixel_width, w) AS pixel_width FROM manifest LEFT JOIN found USING (source_path)")
def j2_backfill(spark, d):
    found = table(spark, d, "incoming_manifest").groupBy(F.col("source_path").alias("path")).agg(F.max("file_size_bytes").alias("file_size_bytes"), F.max("pixel_width").alias("pixel_width"))
    rows = manifest(spark, d).withColumnRenamed("source_path", "path")
    return X.backfill(rows, found, ["file_size_bytes"], ["pixel_width"]).select("id", "file_size_bytes", "pixel_width")

