"""Queries of classification, similarity, components, scoring; with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import classify as C
from ..operators import manifest as M
from ..operators import score as K
from ..operators import similarity as J
from ..operators.components import components
from ..operators.select import best_per_group
from ..runtime import Scratch
from .fixtures import CLASSIFY_SQL, MANIFEST_SQL, MEDIA_SQL, dated_manifest, dated_media, manifest, media

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_M = f"WITH {MEDIA_SQL}"
_C = f"WITH {MEDIA_SQL}, {CLASSIFY_SQL}"
_T = C.Thresholds()


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    return C.source_priority(media(spark, d))


@query(f"{_M} SELECT DISTINCT source_label, prio FROM ranked")
def c0_source_priority(spark, d):
    return _ranked(spark, d).select("source_label", F.col("prio").cast("bigint").alias("prio")).distinct()


@query(f"{_M} SELECT sha256, count(*) AS files FROM media GROUP BY 1 HAVING count(*) > 1")
def a1_content_groups(spark, d):
    return media(spark, d).groupBy("sha256").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


@query(f"{_C} SELECT phash, count(*) AS files FROM cand GROUP BY 1 HAVING count(*) > 1")
def a2_hash_groups(spark, d):
    rows = _ranked(spark, d)
    exact = C.exact_copies(rows)
    return rows.join(exact, "ord", "left_anti").where(C.candidates(rows, _T)).groupBy("phash").agg(F.count(F.lit(1)).alias("files")).where("files > 1")


@query(f"{_M} SELECT phash, CAST(max(CAST(file_type = 'raw' AS INT)) AS INT) AS raw, count_if(file_type IN ('heic', 'jpeg', 'png', 'gif', 'webp')) AS lossy FROM media WHERE phash IS NOT NULL GROUP BY 1")
def a3_raw_and_lossy(spark, d):
    m = media(spark, d).where("phash is not null")
    return m.groupBy("phash").agg(F.max((F.col("file_type") == "raw").cast("int")).alias("raw"), F.count_if(F.col("file_type").isin(*C.FORMAT_RANK)).alias("lossy"))


@query(f"{_C} SELECT ord, keeper FROM exact")
def c1_exact_content(spark, d):
    return C.exact_copies(_ranked(spark, d))


def _open(spark, d):
    scratch = Scratch(spark, "open", "zstd")
    held = scratch.keep(media(spark, d).select("ord", "path", "source_label", "file_type", "sha256", "phash", "dhash", "mean_color", "pixel_width", "pixel_height"))
    rows = C.source_priority(held, keep=scratch.keep)
    scratch.settle()
    return rows, rows.join(C.exact_copies(rows, "ord"), "ord", "left_anti").where(C.candidates(rows, _T)), held


def _unlike(spark, d):
    """The candidates that are copies neither by content nor by format."""
    scratch = Scratch(spark, "unlike", "zstd")
    _, kept, read = _open(spark, d)
    held = scratch.keep(kept.select("ord", "path", "prio", "file_type", "phash", "dhash", "mean_color"))
    out = scratch.keep(held.join(C.format_copies(held, _T, "ord"), "ord", "left_anti").drop("file_type"))
    for x in (read, held):
        scratch.drop(x)
    scratch.settle()
    return out


@query(f"{_C} SELECT ord, keeper, keeper_type, vote FROM formats")
def c2_exact_format(spark, d):
    return C.format_copies(_open(spark, d)[1], _T)


@query(f"{_C} SELECT ord, keeper, CAST(bits AS INT) AS bits, vote FROM near")
def c3_near_duplicates(spark, d):
    return C.near_copies_of_classes(*C.near_classes(_unlike(spark, d), _T))


@query(f"{_C} SELECT i, j, CAST(bits AS INT) AS bits, vote FROM pairs")
def j5_similarity_join(spark, d):
    return C.gated_pairs(_unlike(spark, d), _T).select("i", "j", "bits", "vote")


@query(f"{_M}, v AS (SELECT DISTINCT h FROM media WHERE h IS NOT NULL) SELECT printf('%016x', least(a.h, b.h)) AS a, printf('%016x', greatest(a.h, b.h)) AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS bits FROM v a JOIN v b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 6")
def g2_hash_neighbours(spark, d):
    v = media(spark, d).select(labels.hex_hash(F.col("phash")).alias("h")).where("h is not null").distinct()
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return J.hash_value_pairs(v, 6).select(F.least(text("a"), text("b")).alias("a"), F.greatest(text("a"), text("b")).alias("b"), "bits")


_LABELS = """labelled AS (
  SELECT ord, keeper, 'EXACT' AS action, NULL::INT AS bits, 'high' AS conf FROM exact
  UNION ALL SELECT ord, keeper, 'EXACT', 0, CASE WHEN vote = 'agree' THEN 'high' ELSE 'low' END FROM formats
  UNION ALL SELECT ord, keeper, 'REVIEW_DUPLICATE', bits, CASE WHEN vote = 'agree' THEN 'high' ELSE 'low' END FROM near
)"""


@query(f"{_C}, {_LABELS} SELECT r.ord, coalesce(l.action, CASE WHEN exif_date IS NULL THEN 'UNDATED' ELSE '' END) AS action, keeper AS duplicate_of, CAST(bits AS INT) AS hamming_distance, conf AS match_confidence FROM ranked r LEFT JOIN labelled l USING (ord)")
def c4_labels(spark, d):
    return C.classify(media(spark, d), groups=False).select("ord", "action", "duplicate_of", "hamming_distance", "match_confidence")


@query()
def c4_labels_all_dates(spark, d):
    return C.classify(dated_media(spark, d), groups=False).select("ord", "action", "duplicate_of", "hamming_distance", "match_confidence")


_NAME = "regexp_extract({}, '([^/]*)$', 1)"


@query(f"""{_C} SELECT r.ord, coalesce('exact duplicate of ' || {_NAME.format("e.keeper")}, 'format duplicate of ' || {_NAME.format("f.keeper")} || ' (' || r.file_type || ' vs ' || f.keeper_type || ')',
'near-duplicate (hamming=' || n.bits || ') of ' || {_NAME.format("n.keeper")}, CASE WHEN exif_date IS NULL THEN 'no EXIF DateTimeOriginal' ELSE 'unique' END) AS reason
FROM ranked r LEFT JOIN exact e USING (ord) LEFT JOIN formats f USING (ord) LEFT JOIN near n USING (ord)""")
def c6_reasons(spark, d):
    return C.classify(media(spark, d), groups=False).select("ord", "reason")


_STEM = r"""named AS (
  SELECT path, h, regexp_replace(path, '/?[^/]*$', '') AS dir, regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)\.[^.]+$', '\1') AS stem FROM media
), numbered AS (
  SELECT *, regexp_extract(stem, '(?s)^.*\((\d+)\)$', 1) AS n, CASE WHEN regexp_matches(stem, '(?s)^.*\(\d+\)$') THEN regexp_replace(stem, '\(\d+\)$', '') ELSE stem END AS base FROM named
), plain AS (
  SELECT * FROM numbered WHERE NOT (ends_with(base, '-已編輯') OR ends_with(base, '(已編輯)') OR ends_with(base, '-edited') OR ends_with(base, '-Edit') OR ends_with(base, '_edited') OR ends_with(base, ' edited'))
), stems AS (
  SELECT a.path AS src, b.path AS dst FROM plain a JOIN plain b ON a.dir = b.dir AND a.base = b.base AND a.n = b.n AND a.path < b.path
  WHERE coalesce(bit_count(xor(a.h, b.h)) <= 10, true)
)"""


def _with_twins(media):
    """Each picture with a film of its name beside it, without a hash, and a raw one with the hash turned round."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    some = media.select("path", "phash")
    film = some.select(F.concat(base, F.lit(".twin-film")).alias("path"), F.lit(None).cast("string").alias("phash"))
    return Scratch(media.sparkSession, "twins").keep(some.unionByName(film.distinct()).unionByName(some.groupBy(F.concat(base, F.lit(".twin-raw")).alias("path")).agg(F.reverse(F.min("phash")).alias("phash"))))


_TWINS = r"""twins AS (
  SELECT path, h FROM media UNION ALL SELECT DISTINCT regexp_replace(path, '\.[^./]*$', '') || '.twin-film', NULL FROM media
  UNION ALL SELECT regexp_replace(path, '\.[^./]*$', '') || '.twin-raw', CAST('0x' || reverse(min(phash)) AS UBIGINT) FROM media GROUP BY 1
)"""


@query(f"{_M}, {_TWINS}, {_STEM.replace('FROM media', 'FROM twins')} SELECT src, dst FROM stems")
def j3_stem_pairs(spark, d):
    return C.stem_pairs(_with_twins(media(spark, d)), _T)


@query(f"""{_M.replace("WITH ", "WITH RECURSIVE ", 1)}, {_TWINS}, {_STEM.replace('FROM media', 'FROM twins')}, ends AS (SELECT src AS a, dst AS b FROM stems UNION SELECT dst, src FROM stems),
walk(node, c) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM ends GROUP BY a UNION SELECT e.b, min(w.c) FROM walk w JOIN ends e ON e.a = w.node JOIN recurring.walk old ON old.node = e.b WHERE w.c < old.c GROUP BY e.b)
SELECT node AS path, c AS cluster FROM walk""")
def j4_pair_clusters(spark, d):
    return C.pair_clusters(_with_twins(media(spark, d)), _T)


_GROUPS = f"""{_LABELS}, {_STEM}, edges AS (
  SELECT r.path AS a, l.keeper AS b FROM ranked r JOIN labelled l USING (ord) UNION SELECT path_i, path_j FROM pairs UNION SELECT src, dst FROM stems
), two AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(node, component) USING KEY (node) AS (
  SELECT a, min(least(a, b)) FROM two GROUP BY a
  UNION
  SELECT e.b, min(r.component) FROM reach r JOIN two e ON e.a = r.node JOIN recurring.reach o ON o.node = e.b WHERE r.component < o.component GROUP BY e.b
)"""
_CR = _C.replace("WITH ", "WITH RECURSIVE ", 1)


@query(f"{_CR}, {_GROUPS} SELECT node AS path, component AS group_id FROM reach")
def g1_components(spark, d):
    return C.duplicate_groups(media(spark, d), _T)


@query(f"{_C}, {_LABELS} SELECT r.path AS src, l.keeper AS dst FROM ranked r JOIN labelled l USING (ord) UNION ALL SELECT path_i, path_j FROM pairs")
def c5_edges(spark, d):
    rows = C.classify(media(spark, d), groups=False)
    return rows.where("duplicate_of is not null").select(F.col("path").alias("src"), F.col("duplicate_of").alias("dst")).unionByName(
        C.near_pairs(_unlike(spark, d), _T).select(F.col("path_i").alias("src"), F.col("path_j").alias("dst"))
    )


@query(r"""WITH RECURSIVE links AS (SELECT source_path AS a, duplicate_of AS b FROM manifest_row WHERE source_path <> duplicate_of), two AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, component) USING KEY (node) AS (SELECT a, min(least(a, b)) FROM two GROUP BY a UNION
  SELECT e.b, min(r.component) FROM reach r JOIN two e ON e.a = r.node JOIN recurring.reach o ON o.node = e.b WHERE r.component < o.component GROUP BY e.b)
SELECT node, component FROM reach""")
def g1_components_of_matches(spark, d):
    from ..runtime import table

    return components(table(spark, d, "manifest_row"), "source_path", "duplicate_of")


@query(f"{_C} SELECT e.ord, round(sqrt(pow(CAST(split_part(r.mean_color, ',', 1) AS INT) - CAST(split_part(k.mean_color, ',', 1) AS INT), 2) + pow(CAST(split_part(r.mean_color, ',', 2) AS INT) - CAST(split_part(k.mean_color, ',', 2) AS INT), 2) + pow(CAST(split_part(r.mean_color, ',', 3) AS INT) - CAST(split_part(k.mean_color, ',', 3) AS INT), 2)), 6) AS distance FROM exact e JOIN ranked r USING (ord) JOIN ranked k ON k.path = e.keeper")
def f14_colour_distance(spark, d):
    rows = _ranked(spark, d)
    kept = rows.select(F.col("path").alias("keeper"), F.col("mean_color").alias("k"))
    met = C.exact_copies(rows).join(rows.select("ord", "mean_color"), "ord").join(kept, "keeper")
    return met.select("ord", F.round(labels.colour_distance(F.col("mean_color"), F.col("k")), 6).alias("distance"))


@query(f"{_M} SELECT ord, coalesce(bit_count(h) BETWEEN 4 AND 60, true) AS textured, pixel_width IS NULL OR pixel_height IS NULL OR (pixel_width >= 128 AND pixel_height >= 128) AS large FROM media")
def pr7_entropy_and_size_gates(spark, d):
    m = media(spark, d)
    return m.select("ord", C.entropy_ok(F.col("phash"), 4).alias("textured"), C.side_ok(F.col("pixel_width"), F.col("pixel_height"), 128).alias("large"))


_SCORE_SQL = rf"""WITH {MANIFEST_SQL}, base AS (
  SELECT *, lower(regexp_extract(regexp_extract(source_path, '([^/]*)$', 1), '^.+\.([^.]+)$', 1)) AS ext, regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '(.)\.[^.]+$', '\1') AS stem,
    regexp_replace(source_path, '/?[^/]*$', '') AS dir, CASE WHEN pixel_width > 0 AND pixel_height > 0 THEN CAST(pixel_width AS BIGINT) * pixel_height END AS px
  FROM manifest WHERE group_id IS NOT NULL
), peers AS (
  SELECT *, min(px) OVER g AS plo, max(px) OVER g AS phi, min(file_size_bytes) OVER g AS slo, max(file_size_bytes) OVER g AS shi,
    max(ext IN ('heic', 'heif')) OVER s AS heic_peer, max(ext IN ('mov', 'mp4', 'avi')) OVER s AS video_peer, ext IN ('mov', 'mp4', 'avi') AS video
  FROM base WINDOW g AS (PARTITION BY group_id), s AS (PARTITION BY group_id, lower(stem), lower(dir))
), dims AS (
  SELECT *, CASE WHEN px IS NULL THEN 0 WHEN plo = phi THEN 1 ELSE CAST(px - plo AS DOUBLE) / CAST(phi - plo AS DOUBLE) END AS d1,
    CASE WHEN file_size_bytes IS NULL THEN 0 WHEN slo = shi THEN 1 ELSE CAST(file_size_bytes - slo AS DOUBLE) / CAST(shi - slo AS DOUBLE) END AS d2,
    CASE WHEN exif_tag_count IS NULL THEN 0 ELSE least(exif_tag_count / CAST(CASE WHEN video THEN 9 ELSE 16 END AS DOUBLE), 1) END AS d3,
    CASE WHEN shot_date IS NULL THEN 0 WHEN mtime IS NOT NULL AND abs(epoch_us(shot_date) - epoch_us(mtime)) < 2000000 THEN 0.3::DOUBLE ELSE 1 END AS d4,
    CASE WHEN coalesce(gps_present, 0) <> 0 THEN 1 ELSE 0 END AS d5,
    CAST(regexp_matches(stem, '(?i)(^|[^A-Za-z])copy([^A-Za-z]|$)') AS INT) + CAST(regexp_matches(stem, '\(\d+\)') AS INT) + CAST(regexp_matches(stem, '(?i)(^|[^A-Za-z])edited?([^A-Za-z]|$)') AS INT)
      + CAST(regexp_matches(stem, '(?i)(^|[^A-Za-z])thumb(nail)?([^A-Za-z]|$)') AS INT) + CAST(regexp_matches(stem, '(?i)(^|[^A-Za-z])compressed([^A-Za-z]|$)') AS INT)
      + CAST(regexp_matches(stem, '(?i)(^|[^A-Za-z])screenshot([^A-Za-z]|$)') AS INT) AS hits,
    len(list_filter(string_split(lower(dir), '/'), lambda x: regexp_matches(x, 'downloads|whatsapp|screenshot|recycle\.bin|trash|temp|tmp|telegram|instagram|messenger'))) AS folders,
    CASE WHEN ext IN ('heic', 'heif') AND NOT video_peer THEN 0.5::DOUBLE ELSE 1 END AS d8,
    CASE WHEN ext IN ('nef', 'cr2', 'cr3', 'arw', 'dng', 'orf', 'rw2', 'raf') THEN 0 WHEN ext IN ('tiff', 'tif') THEN 0.05 WHEN ext IN ('heic', 'heif') THEN 0.1 WHEN ext = 'png' THEN 0.12
      WHEN ext = 'webp' THEN 0.18 WHEN ext = 'gif' THEN 0.35 ELSE 0.2 END AS penalty
  FROM peers
), scored AS (
  SELECT *, CASE WHEN NOT (video AND heic_peer) THEN greatest(0, least(1, 0.25::DOUBLE * d1 + 0.05::DOUBLE * d2 + 0.2::DOUBLE * d3 + 0.15::DOUBLE * d4 + 0.08::DOUBLE * d5
    + 0.12::DOUBLE * greatest(0, 1 - 0.3::DOUBLE * hits) + 0.08::DOUBLE * greatest(0, 1 - 0.25::DOUBLE * folders) + 0.07::DOUBLE * d8 - penalty::DOUBLE
    - CASE WHEN coalesce(xmp_derived, 0) <> 0 THEN 0.3::DOUBLE ELSE 0 END)) END AS new_score
  FROM dims
)"""


@query(f"{_SCORE_SQL} SELECT id, round(new_score, 6) AS score FROM scored UNION ALL SELECT id, NULL FROM manifest WHERE group_id IS NULL")
def k12_scores(spark, d):
    return K.score_rows(manifest(spark, d)).select("id", F.round("score", 6).alias("score"))


@query()
def k12_scores_all_dates(spark, d):
    return K.score_rows(dated_manifest(spark, d)).select("id", F.round("score", 6).alias("score"))


def _dimensions(manifest):
    rows = K.dimensions(manifest.where("group_id is not null"))
    six = lambda c: F.round(f"d_{c}", 6).alias(c)
    return rows.select("id", *[six(c) for c in K.WEIGHTS], "format_penalty", "passenger")


@query(f"{_SCORE_SQL} SELECT id, round(d1, 6) AS resolution, round(d2, 6) AS file_size, round(d3, 6) AS exif_complete, CAST(d4 AS DOUBLE) AS date_prov, CAST(d5 AS DOUBLE) AS gps, round(greatest(0, 1 - 0.3::DOUBLE * hits), 6) AS filename, round(greatest(0, 1 - 0.25::DOUBLE * folders), 6) AS path, CAST(d8 AS DOUBLE) AS live_photo, CAST(penalty AS DOUBLE) AS format_penalty, video AND heic_peer AS passenger FROM scored")
def k1_dimensions(spark, d):
    return _dimensions(manifest(spark, d))


@query()
def k1_dimensions_all_dates(spark, d):
    return _dimensions(dated_manifest(spark, d))


@query(f"{_SCORE_SQL} SELECT group_id, source_path FROM (SELECT group_id, source_path, row_number() OVER (PARTITION BY group_id ORDER BY round(new_score, 9) DESC, source_path) AS n FROM scored WHERE new_score IS NOT NULL) WHERE n = 1")
def k13_rescore_keepers(spark, d):
    rescored = K.score_rows(manifest(spark, d)).withColumn("score", F.round("score", 9))
    return best_per_group(rescored)


@query()
def k13_rescore_keepers_all_dates(spark, d):
    rescored = K.score_rows(dated_manifest(spark, d)).withColumn("score", F.round("score", 9))
    return best_per_group(rescored)


def _decided(media):
    """Classify, group, score, choose keepers: one table from fingerprints to decisions.

    Rows of a group are scored and chosen by their ord and component, with what scores look at; names are joined at the end.
    """
    absent = {"mtime": "timestamp_ntz", "exif_tag_count": "int", "gps_present": "int", "xmp_derived": "int"}
    rows, labels, linked = C.passes(media, _T)
    scratch = Scratch(media.sparkSession, "flagship", "zstd")
    members = scratch.keep(
        rows.join(linked, "ord").select(
            F.col("ord").alias("id"), F.col("path").alias("source_path"), F.col("component").alias("group_id"), "file_size_bytes", "pixel_width", "pixel_height",
            F.col("exif_date").alias("shot_date"), *[F.col(c) if c in rows.columns else F.lit(None).cast(k).alias(c) for c, k in absent.items()],
        )
    )
    names = scratch.keep(members.groupBy(F.col("group_id").alias("component")).agg(F.min("source_path").alias("group_id")))
    scores = scratch.keep(K.score_rows(members).select("id", F.round("score", 9).alias("score")))
    label = labels.select(F.col("ord").alias("id"), "action", F.col("conf").alias("match_confidence"))
    choice = members.select("id", "source_path", "group_id").join(scores, "id").join(label, "id", "left")
    choice = scratch.keep(choice.withColumns({"user_decision": F.lit(""), "is_locked": F.lit(0)}))
    scratch.drop(members)
    scratch.drop(scores)
    scratch.settle()
    chosen = M.auto_select(choice, aggressive=True).select(F.col("id").alias("ord"), F.col("group_id").alias("component"), (F.col("action") == "KEEP").alias("kept"), "score", "user_decision", "is_locked")
    chosen = scratch.keep(chosen)
    scratch.drop(choice)
    said = chosen.join(names, "component").drop("component").join(C.said_of(rows, labels), "ord", "left")
    return rows.select("ord", "path", "file_type", "exif_date").join(said, "ord", "left").select(
        F.col("ord").alias("id"), F.col("path").alias("source_path"), "group_id", F.when(F.col("kept"), "KEEP").otherwise(C.action()).alias("action"), F.col("bits").alias("hamming_distance"),
        C.reason().alias("reason"), F.round("score", 6).alias("score"), F.coalesce("user_decision", F.lit("")).alias("user_decision"), F.coalesce("is_locked", F.lit(0)).alias("is_locked"),
    )


def flagship(spark, d):
    """From fingerprints to decisions, with the manifest's dates in every notation."""
    return _decided(dated_media(spark, d))


@query(f"""{_CR}, {_GROUPS}, manifest AS (
  SELECT r.ord AS id, r.path AS source_path, coalesce(l.action, CASE WHEN exif_date IS NULL THEN 'UNDATED' ELSE '' END) AS action, CAST(l.bits AS INT) AS hamming_distance, g.component AS group_id, l.conf AS match_confidence,
    CASE WHEN r.file_size_bytes > 0 THEN r.file_size_bytes END AS file_size_bytes, r.pixel_width, r.pixel_height, r.exif_date AS shot_date, NULL::TIMESTAMP AS mtime, NULL::INT AS exif_tag_count, NULL::INT AS gps_present, NULL::INT AS xmp_derived
  FROM ranked r LEFT JOIN labelled l USING (ord) LEFT JOIN reach g ON g.node = r.path
), {_SCORE_SQL.split(MANIFEST_SQL + ", ", 1)[1]}, best AS (
  SELECT id FROM scored WHERE new_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY round(new_score, 9) DESC, source_path) = 1
), doomed AS (
  SELECT id FROM scored WHERE new_score IS NOT NULL AND action IN ('EXACT', 'REVIEW_DUPLICATE') AND match_confidence IS DISTINCT FROM 'low' AND id NOT IN (FROM best)
) SELECT m.id, m.source_path, m.group_id, CASE WHEN id IN (FROM best) THEN 'KEEP' ELSE m.action END AS action, m.hamming_distance, round(s.new_score, 6) AS score,
  CASE WHEN id IN (FROM doomed) THEN 'delete' ELSE '' END AS user_decision, CASE WHEN id IN (FROM best) THEN 1 ELSE 0 END AS is_locked
FROM manifest m LEFT JOIN (SELECT id, new_score FROM scored) s USING (id)""")
def flagship_one_date(spark, d):
    return _decided(media(spark, d)).drop("reason")


QUERIES["flagship"] = flagship
