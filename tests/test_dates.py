import datetime

import pytest

import __spark_entry__ as entry
from kinfold.plans.fixtures import dated_manifest
from kinfold.schema import MANIFEST

# (shot date, mtime): with one in UTC at 2019-06-30 22:00:00, but in the last two rows.
DATES = [
    ("2019:07-01", None), ("2019:07:01 00:00:00", "2019-06-30T22:00:01Z"), ("2019-06-30T22:00:00.000Z", "1561932000"), ("01/07/2019 00:00:00", None),
    ("1561932000", "2021-01-01T00:00:00Z"), ("2019-07-01T00:00:00", None), ("2021:07:01 00:00:00", None), (None, "2019:07:01 00:00:00"),
]
READ = {2, 3, 4, 5, 6}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("dates"))
    rows = []
    for i, (shot, mtime) in enumerate(DATES, 1):
        base = {"id": i, "source_path": f"/d/f{i}.jpg", "source_label": "home", "action": "", "source_hash": f"{i % 4:064x}", "group_id": "g", "file_size_bytes": 10, "executed": 0,
                "exif_tag_count": 8, "gps_present": 1, "xmp_derived": 0, "is_locked": 0, "user_decision": "", "outcome": "", "shot_date": shot, "creation_date": shot, "mtime": mtime}
        rows.append(tuple(base.get(n) for n, _, _ in MANIFEST))
    spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t, _ in MANIFEST)).write.parquet(f"{at}/migration_manifest.parquet")
    spark.createDataFrame([("home", "Europe/Berlin", "DMY")], "source_label string, time_zone string, date_order string").write.parquet(f"{at}/scan_source.parquet")
    return at


def got(spark, folder, name):
    return entry.queries()[name](spark, folder).collect()


def test_dates_of_every_notation(spark, folder):
    at = {r.id: r for r in dated_manifest(spark, folder).collect()}
    assert len(at) == len(DATES)
    assert {i for i, r in at.items() if r.shot_date == datetime.datetime(2019, 6, 30, 22)} == READ
    assert at[7].shot_date == datetime.datetime(2021, 6, 30, 22) and at[8].mtime == datetime.datetime(2019, 6, 30, 22) and at[1].shot_date is at[8].shot_date is None


def test_queries_see_them(spark, folder):
    assert {r.id for r in got(spark, folder, "w8_date_threshold_all_dates")} == READ
    assert {r.id for r in got(spark, folder, "pr13_numeric_fields_all_dates") if r.shot == 1561932000} == READ
    assert [(r.created, r.shot) for r in got(spark, folder, "a6_group_rollup_all_dates")] == [(1561932000, 1561932000)]
    assert {r.id: r.date_prov for r in got(spark, folder, "k1_dimensions_all_dates")} == {1: 0, 2: 0.3, 3: 0.3, 4: 1, 5: 1, 6: 1, 7: 1, 8: 0}
    scores = {r.id: r.score for r in got(spark, folder, "k12_scores_all_dates")}
    assert scores[4] - scores[1] == pytest.approx(0.15) and scores[2] - scores[1] == pytest.approx(0.045)
    assert [r.source_path for r in got(spark, folder, "k13_rescore_keepers_all_dates")] == ["/d/f4.jpg"]
    assert {r.ord for r in got(spark, folder, "c4_labels_all_dates") if r.action == "UNDATED"} == {1}


def test_flagship_has_the_real_metadata(spark, folder):
    rows = {r.id: r for r in got(spark, folder, "flagship")}
    assert rows[1].group_id == rows[5].group_id
    # A date of its own counts 0.15, tags 0.2 of half the tags, a place 0.08.
    assert rows[5].score - rows[1].score == pytest.approx(0.15)
    # Resolution unknown, size alone equal, no live photo: 0.05 + 0.1 + 0.08 + 0.12 + 0.08 + 0.07 - 0.2.
    assert rows[1].score == pytest.approx(0.3)
