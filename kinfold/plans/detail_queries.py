"""Queries of single gates, fields and counts, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import paths as P
from ..functions.tuning import knee
from ..operators import classify as C
from ..operators import manifest as M
from ..operators import metadata as X
from ..operators import review as R
from ..operators import score as K
from ..operators import select as S
from ..runtime import table
from ..sources import files
from .fixtures import CLASSIFY_SQL, MANIFEST_SQL, MEDIA_SQL, dated_manifest, manifest, media
from .review_queries import _TOOL, _tool_output
from .scan_queries import _SCORE_SQL, _open, _ranked

QUERIES: dict = {}
SQL: dict[str, str] = {}
W = f"WITH {MANIFEST_SQL}"
MD = f"WITH {MEDIA_SQL}"
CL = f"WITH {MEDIA_SQL}, {CLASSIFY_SQL}"
HASH = "CASE WHEN regexp_matches({0}, '^[0-9a-fA-F]{{16}}$') THEN CAST('0x' || {0} AS UBIGINT) END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"{MD} SELECT ord FROM media WHERE file_type <> 'skip'")
def pr1_media_files(spark, d):
    return media(spark, d).where(P.is_media(F.col("path"))).select("ord")


@query(f"{MD} SELECT ord, list_has_any(string_split(lower(regexp_replace(path, '/?[^/]*$', '')), '/'), ['$recycle.bin', 'system volume information', '.trashes', '.trash']) AS skipped FROM media")
def pr3_skipped_directories(spark, d):
    return media(spark, d).select("ord", P.in_skipped_directory(F.col("path")).alias("skipped"))


@query()
def pr4_symlinks(spark, d):
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d).select(F.regexp_replace("path", "^file:/+", "/").alias("path"))
    return found.select("path", files.through_link(F.col("path"), d).alias("linked"))


@query(f"{MD} SELECT ord, regexp_matches(regexp_extract(path, '([^/]*)$', 1), '[.\\s]$') AS unsafe FROM media")
def pr5_unsafe_names(spark, d):
    return media(spark, d).select("ord", P.has_unsafe_name(F.col("path")).alias("unsafe"))


@query(f"{MD} SELECT ord FROM media WHERE file_type IN ('jpeg', 'heic', 'png', 'webp') AND phash IS NULL")
def pr6_not_decoded(spark, d):
    return files.split_decoded(media(spark, d))[1].select("ord")


@query(f"{MD} SELECT ord FROM media WHERE pixel_width IS NULL OR pixel_height IS NULL OR least(pixel_width, pixel_height) >= 128")
def pr8_large_enough(spark, d):
    return media(spark, d).where(C.side_ok(F.col("pixel_width"), F.col("pixel_height"), 128)).select("ord")


@query(f"{CL} SELECT ord FROM cand")
def pr11_candidates(spark, d):
    return _open(spark, d)[1].select("ord")


@query(f"""{W} SELECT id, regexp_extract(source_path, '([^/]*)$', 1) AS name, regexp_replace(source_path, '/?[^/]*$', '') || '/' AS folder, user_decision AS decision,
CASE WHEN coalesce(is_locked, 0) <> 0 THEN 'Locked' ELSE '' END AS lock, CASE WHEN pixel_width <> 0 AND pixel_height <> 0 THEN pixel_width || '×' || pixel_height END AS resolution, CAST(file_size_bytes AS VARCHAR) AS size,
CASE WHEN isnan(score) THEN 'nan' WHEN isinf(score) THEN CASE WHEN score > 0 THEN 'inf' ELSE '-inf' END ELSE regexp_replace(regexp_replace(CAST(score AS VARCHAR), '^(-?[0-9]+)$', '\\1.0'), 'e([-+])([0-9])$', 'e\\10\\2') END AS score,
CASE WHEN shot_date = date_trunc('second', shot_date) THEN strftime(shot_date, '%Y-%m-%d %H:%M:%S') ELSE strftime(shot_date, '%Y-%m-%d %H:%M:%S.%f') END AS shot FROM manifest""")
def pr12_text_fields(spark, d):
    names = {"name": "File Name", "folder": "Folder", "decision": "Action", "lock": "Lock", "resolution": "Resolution", "size": "Size (Bytes)", "score": "Score", "shot": "Shot Date"}
    return manifest(spark, d).select("id", *[S.text_field(f).alias(n) for n, f in names.items()])


def _numbers(manifest):
    names = {"size": "Size (Bytes)", "similarity": "Similarity", "score": "Score", "shot": "Shot Date"}
    rows = S.with_number(manifest, "Group Count", "members")
    return rows.select("id", *[S.numeric_field(f).alias(n) for n, f in names.items()], "members")


@query(f"{W} SELECT id, CAST(file_size_bytes AS DOUBLE) AS size, CAST(hamming_distance AS DOUBLE) AS similarity, score, epoch_us(shot_date) / 1000000.0::DOUBLE AS shot, CAST(count(*) OVER (PARTITION BY group_id) AS DOUBLE) AS members FROM manifest")
def pr13_numeric_fields(spark, d):
    return _numbers(manifest(spark, d))


@query()
def pr13_numeric_fields_all_dates(spark, d):
    return _numbers(dated_manifest(spark, d))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def f1_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query(f"""WITH h AS (SELECT event_id, ['FFD8FF', '89504E470D0A1A0A', '474946383961', '524946460000000057454250', '000000006674797068656963', '00000000667479706D703432', '000000006674797071742020', '00'][event_id % 8 + 1] AS head FROM events)
SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'jpeg' WHEN 1 THEN 'png' WHEN 2 THEN 'gif' WHEN 3 THEN 'webp' WHEN 4 THEN 'heic' WHEN 5 THEN 'mp4' WHEN 6 THEN 'mov' END AS kind FROM h""")
def f5_magic_type(spark, d):
    heads = ["FFD8FF", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "000000006674797068656963", "00000000667479706D703432", "000000006674797071742020", "00"]
    content = F.unhex(F.get(F.array(*[F.lit(h) for h in heads]), (F.col("event_id") % 8).cast("int")))
    return table(spark, d, "events").select("event_id", P.magic_type(content).alias("kind"))


@query(f"{CL} SELECT e.ord, CAST(bit_count(xor({HASH.format('r.dhash')}, {HASH.format('k.dhash')})) AS INT) AS bits FROM exact e JOIN ranked r USING (ord) JOIN ranked k ON k.path = e.keeper")
def f8_hamming_to_keeper(spark, d):
    rows = _ranked(spark, d)
    kept = rows.select(F.col("path").alias("keeper"), F.col("dhash").alias("k"))
    return C.exact_copies(rows).join(rows.select("ord", "dhash"), "ord").join(kept, "keeper").select("ord", L.hamming(F.col("dhash"), F.col("k")).alias("bits"))


@query(f"{CL} SELECT ord, vote FROM (SELECT e.ord, CASE WHEN r.dhash IS NULL OR k.dhash IS NULL OR NOT regexp_matches(r.dhash, '^[0-9a-f]{{16}}$') OR NOT regexp_matches(k.dhash, '^[0-9a-f]{{16}}$') THEN 'unknown' WHEN bit_count(xor({HASH.format('r.dhash')}, {HASH.format('k.dhash')})) <= 10 THEN 'agree' ELSE 'disagree' END AS vote FROM exact e JOIN ranked r USING (ord) JOIN ranked k ON k.path = e.keeper)")
def j7_second_hash_vote(spark, d):
    rows = _ranked(spark, d)
    kept = rows.select(F.col("path").alias("keeper"), F.col("dhash").alias("k"))
    return C.exact_copies(rows).join(rows.select("ord", "dhash"), "ord").join(kept, "keeper").select("ord", C.dhash_vote(F.col("dhash"), F.col("k"), 10).alias("vote"))


_SQUARE = " + ".join(f"pow(CAST(split_part(r.mean_color, ',', {i}) AS DOUBLE) - CAST(split_part(k.mean_color, ',', {i}) AS DOUBLE), 2)" for i in (1, 2, 3))


@query(f"{CL} SELECT e.ord, coalesce(sqrt({_SQUARE}) <= 30, true) AS alike FROM exact e JOIN ranked r USING (ord) JOIN ranked k ON k.path = e.keeper")
def j6_colour_gate(spark, d):
    rows = _ranked(spark, d)
    kept = rows.select(F.col("path").alias("keeper"), F.col("mean_color").alias("k"))
    return C.exact_copies(rows).join(rows.select("ord", "mean_color"), "ord").join(kept, "keeper").select("ord", C.colour_ok(F.col("mean_color"), F.col("k"), 30.0).alias("alike"))


@query(f"{_SCORE_SQL} SELECT id, video AND heic_peer AS passenger, CAST(d8 AS DOUBLE) AS live_photo FROM scored WHERE video OR ext IN ('heic', 'heif')")
def j8_film_and_picture_peers(spark, d):
    rows = K.dimensions(manifest(spark, d).where("group_id is not null"))
    return rows.where(P.suffix(F.col("source_path")).isin("heic", "heif", "mov", "mp4", "avi")).select("id", "passenger", F.col("d_live_photo").alias("live_photo"))


@query(rf"WITH {_TOOL} SELECT source_path AS path, coalesce(a, b) AS taken, CASE WHEN a IS NOT NULL THEN 'EXIF:DateTimeOriginal' WHEN b IS NOT NULL THEN 'QuickTime:CreateDate' END AS tag FROM dated")
def f12_date_chain(spark, d):
    when, which = X.first_date(F.col("tags"))
    return X.tool_records(_tool_output(spark, d)).select(F.col("SourceFile").alias("path"), when.alias("taken"), which.alias("tag"))


@query(rf"WITH {_TOOL} SELECT source_path AS path, (shot_date IS NOT NULL)::INT + (creation_date IS NOT NULL)::INT + coalesce(gps_present = 1, false)::INT + (exif_tag_count IS NOT NULL)::INT AS tags, coalesce(gps_present = 1, false) AS place, exif_tag_count AS rating FROM tool")
def a16_tag_census(spark, d):
    tags = F.col("tags")
    rows = X.tool_records(_tool_output(spark, d))
    return rows.select(F.col("SourceFile").alias("path"), X.tag_count(tags).alias("tags"), X.any_tag(tags, X.GPS_TAGS).alias("place"), L.rating(tags["XMP:Rating"]).alias("rating"))


@query("SELECT path, list_sort(list_distinct(list(source_label))) AS labels FROM (SELECT source_path AS path, source_label FROM migration_manifest WHERE source_path IS NOT NULL AND source_label IS NOT NULL) GROUP BY 1")
def u6_provenance(spark, d):
    return R.provenance(table(spark, d, "migration_manifest"))


@query(f"{W} SELECT DISTINCT source_path FROM manifest WHERE user_decision = 'delete' EXCEPT SELECT source_path FROM manifest WHERE coalesce(is_locked, 0) <> 0")
def u7_plan_without_locked(spark, d):
    m = manifest(spark, d)
    return M.without_locked(m.where("user_decision = 'delete'").select("source_path").distinct(), m)


@query(f"{W} SELECT id, CASE WHEN source_path = (SELECT min(source_path) FROM manifest) THEN 'ignore' ELSE user_decision END AS user_decision FROM manifest")
def d3_single_decision(spark, d):
    m = manifest(spark, d)
    change = m.agg(F.min("source_path").alias("source_path")).withColumn("user_decision", F.lit("ignore"))
    return M.set_decisions(m, change).select("id", "user_decision")


def _singles(which: str) -> str:
    return f"""{W}, ones AS (SELECT source_path, coalesce(is_locked, 0) <> 0 AS locked, coalesce(user_decision, '') <> '' AS actioned FROM manifest WHERE group_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY group_id) = 1)
SELECT id, CASE WHEN source_path IN (SELECT source_path FROM ones WHERE {which}) THEN 'ignored' ELSE outcome END AS outcome FROM manifest"""


@query(_singles("NOT locked"))
def d11_prune_singles(spark, d):
    return M.prune_singles(manifest(spark, d)).select("id", "outcome")


@query(_singles("locked OR NOT actioned"))
def d11_prune_plain_and_unlocked(spark, d):
    return M.prune_singles(manifest(spark, d), "ask", "unlock", actioned=False).select("id", "outcome")


@query(f"{W} SELECT count_if(user_decision = 'delete') AS decided, count_if(user_decision = 'delete') AS deletes, 0::BIGINT AS hidden_deletes FROM manifest")
def a11_counters_of_a_decision(spark, d):
    return R.counters(manifest(spark, d), "delete")


@query("""WITH rate AS (SELECT user_id AS device, CAST(pow(2, event_id % 4) AS INT) AS concurrency, max(value) AS rate FROM events GROUP BY 1, 2),
paired AS (SELECT *, lead(concurrency) OVER w AS next, lead(rate) OVER w AS faster FROM rate WINDOW w AS (PARTITION BY device ORDER BY concurrency)),
marked AS (SELECT *, NOT max(coalesce(next <> 2 * concurrency, true)) OVER (PARTITION BY device ORDER BY concurrency) AS inside FROM paired),
judged AS (SELECT *, inside AND NOT coalesce(rate > 0 AND faster > 0, false) AS bad FROM marked),
found AS (SELECT device, min(concurrency) FILTER (bad) AS b, min(concurrency) FILTER (inside AND NOT bad AND faster / rate - 1 < 0.15) AS f, max(next) FILTER (inside) AS m FROM judged GROUP BY 1)
SELECT device, CASE WHEN f < coalesce(b, 99) THEN f WHEN b IS NULL THEN m END AS knee FROM found""")
def f21_knee(spark, d):
    e = table(spark, d, "events")
    step = F.pow(F.lit(2.0), F.col("event_id") % 4).cast("int")
    rates = e.select(F.col("user_id").alias("device"), step.alias("concurrency"), F.col("value").alias("rate"))
    return knee(rates)


@query(f"{W} SELECT DISTINCT name FROM (SELECT regexp_extract(source_path, '([^/]*)$', 1) AS name FROM manifest) WHERE contains(lower(name), 'img') ORDER BY name LIMIT 50")
def o5_preview(spark, d):
    names = S.by_pattern(manifest(spark, d), "File Name", "img").select(P.basename(F.col("source_path")).alias("name")).distinct()
    return names.orderBy("name").limit(50)


@query(f"{W} SELECT id, file_type FROM (SELECT id, lower(regexp_extract(regexp_extract(source_path, '([^/]*)$', 1), '^.+\\.([^.]+)$', 1)) IN ('mp4', 'mov', 'm4v', 'avi') AS file_type FROM manifest)")
def f28_is_video(spark, d):
    return manifest(spark, d).select("id", P.is_video(F.col("source_path")).alias("file_type"))
