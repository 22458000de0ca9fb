"""What the similarity join and the passes built on it must not write: changed words, paths beside pairs, wide joins that run again."""

import gc
import random
import time

import pytest
from pyspark.sql import functions as F

from kinfold.operators import classify as C
from kinfold.operators import similarity
from kinfold.operators.similarity import hash_value_pairs
from kinfold.plans import scan_queries
from kinfold.runtime import Scratch


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_are_found_without_shuffling_changed_words(spark):
    values = spark.range(300).select(F.xxhash64("id").alias("h"))
    text = plan(hash_value_pairs(values, 10))
    assert "Generate" not in text and "Exchange" not in text


@pytest.mark.parametrize("radius", [3, 10])
def test_blocks_and_pieces_of_any_size_give_all_pairs(spark, radius, monkeypatch):
    rng = random.Random(radius)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    base = [rng.getrandbits(64) for _ in range(8)]
    values = {signed(h ^ sum(1 << b for b in rng.sample(range(64), n))) for h in base for n in range(12)}
    frame = spark.createDataFrame([(v,) for v in values], "h long")
    want = sorted(map(tuple, hash_value_pairs(frame, radius, "brute").collect()))
    monkeypatch.setattr(similarity, "BLOCK", 40)
    looked_up = similarity._look_up
    def small(held, blocks, r):
        similarity.CHUNK = 8
        return looked_up(held, blocks, r)
    monkeypatch.setattr(similarity, "_look_up", small)
    monkeypatch.setattr(similarity, "CHUNK", 8)
    got = sorted(map(tuple, hash_value_pairs(frame, radius).collect()))
    assert got == want and len(want) > 30


def _frame(spark, n=40):
    rng = random.Random(n)
    rows = [(i, f"p{i:03}", i % 3, f"{0x0123456789abcdef ^ rng.getrandbits(6):016x}", rng.choice([None, "1,1,1"]), None) for i in range(n)]
    return spark.createDataFrame(rows, "ord long, path string, prio int, phash string, mean_color string, dhash string")


def test_pairs_meet_without_paths(spark):
    frame = _frame(spark)
    slim, full = C.gated_pairs(frame, C.Thresholds()), C.near_pairs(frame, C.Thresholds())
    assert not [c for c in slim.columns if "path" in c]
    got = sorted(map(tuple, full.select("i", "j", "bits", "path_i", "path_j").collect()))
    assert got == sorted((r.i, r.j, r.bits, f"p{r.i:03}", f"p{r.j:03}") for r in slim.collect()) and got


def test_labels_without_groups_link_nothing(spark, monkeypatch):
    rows = _frame(spark).select("ord", "path", F.lit("a").alias("source_label"), F.lit("jpeg").alias("file_type"), F.col("path").alias("sha256"), "phash", "dhash", "mean_color", F.lit(None).cast("int").alias("pixel_width"), F.lit(None).cast("int").alias("pixel_height"), F.lit(None).cast("timestamp_ntz").alias("exif_date"))
    full = C.classify(rows)
    monkeypatch.setattr(C, "components", None)
    slim = C.classify(rows, groups=False)
    assert "group_id" not in slim.columns and sorted(map(tuple, slim.collect())) == sorted(map(tuple, full.drop("group_id").collect()))


def _media(spark):
    return _frame(spark).select("ord", "path", F.lit("a").alias("source_label"), F.lit("jpeg").alias("file_type"), F.col("path").alias("sha256"), "phash", "dhash", "mean_color", F.lit(200).alias("pixel_width"), F.lit(200).alias("pixel_height"), F.lit(9).cast("long").alias("file_size_bytes"), F.lit(None).cast("timestamp_ntz").alias("exif_date"))


def test_shuffle_files_go_with_their_step(spark):
    held = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in (held.getAllFiles().apply(i).getName() for i in range(held.getAllFiles().size())) if f.startswith("shuffle_")}
    gc.disable()
    try:
        before = files()
        Scratch(spark, "test").keep(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
        end = time.time() + 5
        while files() - before and time.time() < end:
            time.sleep(0.1)
        assert not files() - before
    finally:
        gc.enable()


def test_groups_are_scored_by_ord_and_component(spark, monkeypatch):
    seen, score = [], scan_queries.K.score_rows
    monkeypatch.setattr(scan_queries.K, "score_rows", lambda rows: seen.append(rows) or score(rows))
    got = scan_queries._decided(_media(spark)).collect()
    assert dict(seen[0].dtypes)["group_id"] == "bigint" and not {"reason", "source_label", "phash"} & set(seen[0].columns)
    want = {r.ord: r for r in C.classify(_media(spark)).collect()}
    assert {r.id: (r.group_id, r.reason, r.hamming_distance) for r in got} == {k: (r.group_id, r.reason, r.hamming_distance) for k, r in want.items()}
    assert all(r.action == ("KEEP" if r.is_locked else want[r.id].action) for r in got) and any(r.is_locked for r in got)


def test_groups_alone_need_no_keepers(spark, monkeypatch):
    want = sorted((r.path, r.group_id) for r in C.classify(_media(spark)).where("group_id is not null").collect())
    monkeypatch.setattr(C, "said_of", None)
    assert sorted(map(tuple, C.duplicate_groups(_media(spark)).collect())) == want and want


@pytest.mark.parametrize("run", [lambda spark: C.classify(_media(spark), groups=False)])
def test_rows_are_written_before_their_labels_are_ranked(spark, monkeypatch, run):
    written, keep = [], Scratch.keep
    monkeypatch.setattr(Scratch, "keep", lambda self, df: written.append(df.columns) or keep(self, df))
    monkeypatch.setattr(scan_queries, "media", lambda spark, d: _media(spark))
    run(spark)
    assert "prio" not in written[0] and written[1] == ["source_label", "prio"]


def test_names_are_cut_once_a_row(spark, tmp_path):
    names = ["/d/a.jpg", "/d/a.mov", "/d/a(1).jpg", "/d/a(1).mov", "/d/a-edited.jpg", "/d/a-edited(2).mov", "/d/b(2).gif", "/d/b(02).png", "/e/a.jpg", "c.jpg", "c.mov", "/d/.x", "/d/.x.jpg", "/d/n(99999999999).jpg", "/d/n.png"]
    spark.createDataFrame(list(enumerate(names)), "ord long, path string").withColumn("phash", F.lit(None).cast("string")).write.parquet(str(tmp_path / "rows"))
    pairs = C.stem_pairs(spark.read.parquet(str(tmp_path / "rows")), C.Thresholds(), "ord")
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("regexp_") < 120
    want = [("/d/a.jpg", "/d/a.mov"), ("/d/a(1).jpg", "/d/a(1).mov"), ("/d/b(2).gif", "/d/b(02).png"), ("c.jpg", "c.mov"), ("/d/.x", "/d/.x.jpg"), ("/d/n(99999999999).jpg", "/d/n.png")]
    assert sorted((names[r.src], names[r.dst]) for r in pairs.collect()) == sorted(want)
