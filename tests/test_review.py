import math
import random

import pytest
from pyspark.sql import functions as F

from kinfold.functions import labels as L
from kinfold.functions import paths as P
from kinfold.functions.hashes import digest, usable_hash
from kinfold.operators import manifest as M
from kinfold.operators import metadata as X
from kinfold.operators import review as R
from kinfold.operators import score as K
from kinfold.operators import select as S
from kinfold.runtime import Scratch
from kinfold.schema import MANIFEST, align_manifest
from kinfold.sources import files
from kinfold.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def row(i, group="g", action="", decision="", score=None, size=10, locked=0, outcome="", **more):
    base = {n: None for n, _, _ in MANIFEST} | {"id": i, "source_path": f"/d/f{i}.jpg", "source_label": "a", "action": action, "group_id": group, "user_decision": decision, "score": score,
                                               "file_size_bytes": size, "is_locked": locked, "outcome": outcome, "executed": 0, "gps_present": 0, "xmp_derived": 0}
    return tuple((base | more)[n] for n, _, _ in MANIFEST)


def frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(f"{n} {t}" for n, t, _ in MANIFEST))


# -- scalars --------------------------------------------------------------------------------------------------


def test_path_functions(spark):
    cases = ["/a/b/IMG.JPG", "x.tar.gz", "/a/.hidden", "noext", "/a/b.", "", "/top"]
    rows = spark.createDataFrame([(c,) for c in cases], "p string").select("p", P.suffix(F.col("p")).alias("s"), P.stem(F.col("p")).alias("t"), P.parent(F.col("p")).alias("d"), P.file_type(F.col("p")).alias("f")).collect()
    got = {r.p: (r.s, r.t, r.d, r.f) for r in rows}
    assert got["/a/b/IMG.JPG"] == ("jpg", "IMG", "/a/b", "jpeg")
    assert got["x.tar.gz"][:3] == ("gz", "x.tar", "")
    assert got["/a/.hidden"][:2] == ("", ".hidden") and got["noext"][:2] == ("", "noext") and got[""] == ("", "", "", "skip") and got["/top"][2] == ""


def test_name_grammar(spark):
    want = {"IMG(1).jpg": ("IMG", 1, False, "IMG"), "IMG-edited(2).jpg": ("IMG-edited", 2, True, "IMG"), "IMG_edited.jpg": ("IMG_edited", None, True, "IMG"), "IMG-EDITED.jpg": ("IMG-EDITED", None, False, "IMG-EDITED"),
            "a(b).jpg": ("a(b)", None, False, "a(b)"), "圖-已編輯.heic": ("圖-已編輯", None, True, "圖"), "a(1)(2).jpg": ("a(1)", 2, False, "a(1)")}
    rows = spark.createDataFrame([(n,) for n in want], "n string").select("n", *[c.alias(k) for k, c in P.name_parts(F.col("n")).items()]).collect()
    assert {r.n: (r.base_stem, r.number, r.is_edited, r.clean_stem) for r in rows} == want


def test_skips_devices_and_magic(spark):
    assert one(spark, P.in_skipped_directory(F.lit("/r/$RECYCLE.BIN/x/a.jpg"), "/r/")) and not one(spark, P.in_skipped_directory(F.lit("/trash/.trash2/a.jpg")))
    assert not one(spark, P.in_skipped_directory(F.lit("/.trash/a.jpg"), "/.trash/"))
    assert [one(spark, P.device_key(F.lit(p))) for p in ("c:\\x", "\\\\nas\\s\\x", "//nas/s", "/mnt/x")] == ["C:", "\\\\NAS", "\\\\NAS", ""]
    heads = {b"\xff\xd8\xff\xe0": "jpeg", b"\x89PNG\r\n\x1a\n0000": "png", b"GIF89a": "gif", b"RIFF0000WEBPxx": "webp", b"0000ftypheic": "heic", b"0000ftypM4V ": "mp4", b"0000ftypqt  ": "mov", b"": None, b"text": None}
    for h, kind in heads.items():
        assert one(spark, P.magic_type(F.lit(h))) == kind


def test_texts(spark):
    rng = random.Random(0)
    scores = [0.865, 0.615, 0.125, 0.375, 1.0, 0.005, 0.995, 0.0, *[round(rng.random(), rng.choice([2, 3, 4])) for _ in range(300)], *[rng.random() for _ in range(100)]]
    rows = spark.createDataFrame([(s,) for s in scores], "s double").select("s", L.score_text(F.col("s")).alias("t")).collect()
    assert [r.t for r in rows if r.s > 0.002] == [f"{r.s:.2f}" for r in rows if r.s > 0.002]
    assert one(spark, L.score_text(F.lit(None).cast("double"))) == "—"
    assert [one(spark, L.similarity_percent(F.lit(d))) for d in (0, 24, 10, 64)] == [f"{round((64 - d) / 64 * 100)}%" for d in (0, 24, 10, 64)]
    assert [one(spark, L.duration_text(F.lit(x))) for x in (-1, 0, 61_999, 3_600_000, 360_000_000)] == ["--:--", "00:00", "01:01", "01:00:00", "100:00:00"]
    assert [one(spark, L.eta_text(F.lit(a), F.lit(b))) for a, b in ((1, 0.0), (0, 1.0), (1, 2.0), (59, 1.0), (125, 1.0), (7325, 1.0))] == ["—", "—", "<1s", "~59s", "~2m 05s", "~2h 02m"]
    assert [one(spark, L.aspect_bucket(F.lit(x))) for x in ("3*2", "2*3", "2*2", "", "x")] == [0, 2, 1, 1, 1]
    assert str(one(spark, L.exif_date(F.lit(" 2020:02:29 10:00:00.5+09:00")))) == "2020-02-29 10:00:00"
    assert [one(spark, L.exif_date(F.lit(x))) for x in ("", "-", "0000:00:00 00:00:00", "2021:02:29 10:00:00", "2020-02-29 10:00:00")] == [None] * 5


def test_hashes(spark):
    assert one(spark, L.hamming(F.lit("ffffffffffffffff"), F.lit("7fffffffffffffff"))) == 1
    assert one(spark, L.hamming(F.lit("zz"), F.lit("7fffffffffffffff"))) is None
    assert one(spark, usable_hash(F.lit("0x8000000000000007"))) == -(2**63) + 7 and one(spark, usable_hash(F.lit("8000000000000003"))) is None
    assert one(spark, digest(F.lit("\tSHA256:" + "AB" * 32 + " "))) == "ab" * 32 and one(spark, digest(F.lit("ab" * 31))) is None


def test_thresholds():
    assert L.parse_threshold("1970-01-02", True) == 86400 and L.parse_threshold(" 5 ") == 5 and L.parse_threshold("", True) is None and L.parse_threshold("1970-01-02") is None
    assert L.parse_threshold("1970-01-01T00:00:10", True) == 10 and L.parse_threshold("7", True) == 7


# -- score ----------------------------------------------------------------------------------------------------


def test_scores(spark):
    data = [
        row(1, source_path="/d/a.heic", pixel_width=4000, pixel_height=3000, exif_tag_count=16, gps_present=1), row(2, source_path="/d/A.mov", size=99),
        row(3, source_path="/WhatsApp/temp/b copy(1).jpg", pixel_width=400, pixel_height=300, size=None), row(4, group=None), row(5, "other", size=0),
    ]
    got = {r.id: r.score for r in K.score_rows(frame(spark, data)).collect()}
    assert got[2] is None and got[4] is None
    assert got[1] == pytest.approx(0.25 + 0.05 * 0 + 0.20 + 0 + 0.08 + 0.12 + 0.08 + 0.07 - 0.10)
    assert got[3] == pytest.approx(max(0, 0.12 * 0.4 + 0.08 * 0.5 + 0.07 - 0.2))
    with pytest.raises(ValueError):
        K.check_weights(K.WEIGHTS | {"gps": 0.5})
    with pytest.raises(ValueError):
        K.check_weights({"gps": 1.0})
    assert K.score_rows(frame(spark, [])).collect() == []


# -- selection ------------------------------------------------------------------------------------------------


def test_rank_and_threshold(spark):
    data = frame(spark, [row(1, score=0.5), row(2, score=0.5), row(3, score=0.9), row(4), row(5, None, score=1.0), row(6, "h", score=math.nan)])
    assert sorted(map(tuple, S.best_per_group(data).collect())) == [("g", "/d/f3.jpg")]
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(S.rank_in_group(data, "Score", 2)) == [1, 3] and ids(S.rank_in_group(data, "Score", 2, descending=False)) == [1, 2]
    assert ids(S.rank_in_group(data, "Score", 0)) == [] and ids(S.rank_in_group(data, "No Field", 3)) == []
    assert ids(S.select(data, "Score", "__cmp__:>=:0.5")) == [1, 2, 3, 5] and ids(S.select(data, "Score", "__top_n__:1:asc")) == [1]
    assert ids(S.select(data, "Group Count", "__cmp__:==:4")) == [1, 2, 3, 4]
    assert ids(S.by_threshold(data, "Score", "~", "1")) == [] and ids(S.by_threshold(data, "Score", ">", "x")) == []
    for bad in ("__cmp__:>", "__cmp__:~:1", "__top_n__:x:asc", "__top_n__:1:up", ""):
        with pytest.raises(ValueError):
            S.select(data, "Score", bad)


def test_patterns(spark):
    data = frame(spark, [row(1, source_path="/Fotos/É.jpg", decision="delete"), row(2, source_path="/x/a+b.jpg", locked=1), row(3)])
    ids = lambda f, p: sorted(r.id for r in S.select(data, f, p).collect())
    assert ids("File Name", "é") == [1] and ids("Action", "^$") == [2, 3] and ids("Lock", "locked") == [2] and ids("Similarity", ".*") == []
    assert ids("File Name", S.simple_pattern("contains", "a+b")) == [2] and ids("Folder", S.simple_pattern("starts_with", "/fotos")) == [1]
    for op in ("contains", "starts_with", "ends_with", "exact"):
        for text in ("a.b", "x y", "$^", "\\d", "(1)"):
            assert S.read_simple_pattern(S.simple_pattern(op, text)) == (op, text)
    assert S.simple_pattern("contains", "") == "" and S.simple_pattern("exact", "") == "^$" and S.read_simple_pattern("a.*") is None
    r = S.match_statistics(data, "File Name", "jpg").first()
    assert (r.matched, r.total, len(r.samples)) == (3, 3, 3)


def test_sorting(spark):
    data = frame(spark, [row(1, score=0.1, source_path="b"), row(2, source_path="C"), row(3, score=0.1, source_path="a")])
    ids = lambda o: [r.id for r in data.orderBy(*o).collect()]
    assert ids(S.sort_keys(data, [("score", False), ("source_path", False)])) == [1, 3, 2]
    assert ids(S.sort_keys(data, [("score", False), ("source_path", False)], legacy_text=True)) == [3, 1, 2]
    assert ids(S.header_order(data, "source_path")) == [3, 1, 2] and ids([*S.header_order(data, "score"), F.col("id")]) == [2, 1, 3]
    assert S.with_score_first([("id", True)])[0] == ("score", False) and S.with_score_first([("score", True)]) == [("score", True)]


# -- review ---------------------------------------------------------------------------------------------------


def test_load_and_counts(spark):
    data = frame(spark, [row(1, "b"), row(2, "b"), row(3, "a"), row(4, "a", outcome="deleted"), row(5, "c", action="EXACT"), row(6, "c"), row(7, None)])
    assert [(r.id, r.group_number) for r in M.open_manifest(data).collect()] == [(1, 1), (2, 1), (6, 2), (5, 2)]
    assert tuple(R.baseline(data).first()) == (2, 4, 2) and R.isolated_count(data).first()[0] == 2
    empty = frame(spark, [])
    assert tuple(R.baseline(empty).first()) == (0, 0, 0) and M.open_manifest(empty).collect() == [] and R.isolated_count(empty).first()[0] == 0


def test_reference_and_labels(spark):
    h = "f0f0f0f0f0f0f0f0"
    data = frame(spark, [row(1, action="EXACT", score=0.9), row(2, score=0.2, phash=h), row(3, action="KEEP", score=0.3, phash=h), row(4, action="REVIEW_DUPLICATE", phash="f0f0f0f0f0f0f0f1"),
                         row(5, action="REVIEW_DUPLICATE", hamming_distance=24), row(6, action="odd"), row(7, "e", action="EXACT")])
    assert [tuple(r)[:2] for r in R.reference_of_group(data).collect()] == [("g", "/d/f3.jpg")]
    got = {r.id: r.similarity for r in R.similarity_labels(data).collect()}
    assert got == {1: "100%", 2: "100*%", 3: "Ref", 4: "98%", 5: "62%", 6: "—", 7: "100%"}


def test_nearest_member(spark):
    rng = random.Random(3)
    data = [row(i, rng.choice("ab"), phash=rng.choice([None, f"{rng.choice([0xF0F0, 0xF0F1, 0xFF00FF]):016x}"])) for i in range(40)]
    want = {}
    for r in data:
        near = [((int(r[5], 16) ^ int(o[5], 16)).bit_count(), o[0]) for o in data if r[5] and o[5] and o[0] != r[0] and o[7] == r[7]]
        if near:
            want[r[0]] = min(near)[1]
    assert {r.id: r.nearest for r in R.nearest_member(frame(spark, data), small=3).collect()} == want
    assert {r.id: r.nearest for r in R.nearest_member(frame(spark, data)).collect()} == want


# -- decisions ------------------------------------------------------------------------------------------------


def test_decisions_and_outcomes(spark):
    data = frame(spark, [row(1, decision="delete"), row(2, decision="delete", locked=1), row(3, decision="ignore"), row(4)])
    by = lambda df, c: {r.id: r[c] for r in df.collect()}
    assert by(M.execute(data), "outcome") == {1: "deleted", 2: "", 3: "ignored", 4: ""} and by(M.execute(data), "executed")[1] == 1
    scope = spark.createDataFrame([("/d/f3.jpg",)], "source_path string")
    assert by(M.execute(data, scope), "outcome") == {1: "", 2: "", 3: "ignored", 4: ""}
    all_ = data.select("source_path")
    assert by(M.decide(data, all_, "x"), "user_decision") == {1: "x", 2: "delete", 3: "x", 4: "x"}
    assert by(M.decide(data, all_, "x", "cancel"), "user_decision")[1] == "delete"
    assert by(M.decide(data, all_, "x", "unlock"), "is_locked") == dict.fromkeys([1, 2, 3, 4], 0)
    assert by(M.decide(data, all_, "__lock__"), "is_locked") == dict.fromkeys([1, 2, 3, 4], 1)
    assert by(M.dismiss(data, scope), "outcome")[3] == "ignored"
    twice = spark.createDataFrame([("/d/f4.jpg", "a"), ("/d/f4.jpg", "b"), ("/none", "c")], "source_path string, user_decision string")
    assert by(M.set_decisions(data, twice), "user_decision")[4] == "b" and M.set_decisions(data, twice).count() == 4


def test_auto_select(spark):
    data = frame(spark, [row(1, action="EXACT", score=0.9), row(2, action="EXACT", score=0.1), row(3, score=0.1), row(4, action="EXACT"), row(5, None, score=1.0)])
    got = {r.id: (r.action, r.user_decision, r.is_locked) for r in M.auto_select(data, aggressive=True).collect()}
    assert got == {1: ("KEEP", "", 1), 2: ("EXACT", "delete", 0), 3: ("", "", 0), 4: ("EXACT", "", 0), 5: ("", "", 0)}
    low = data.withColumn("match_confidence", F.when(F.col("id") == 2, "low"))
    assert M.aggressive_deletes(low).collect() == []


def test_table(spark):
    root = Scratch(spark, "test").root
    data = frame(spark, [row(1), row(2)])
    M.write_manifest(data, f"{root}/m")
    M.write_manifest(data.where("id = 1"), f"{root}/m")
    assert [r.id for r in M.read_manifest(spark, f"{root}/m").collect()] == [1]
    with pytest.raises(Exception):  # noqa: B017
        M.write_manifest(data.withColumn("id", F.raise_error(F.lit("no"))), f"{root}/m")
    assert M.read_manifest(spark, f"{root}/m").count() == 1
    old = data.drop("outcome", "is_locked", "user_decision").withColumns({"action": F.lit("MOVE"), "dest_path": F.lit("x"), "own": F.lit(1)})
    new = align_manifest(old)
    assert new.columns == [n for n, _, _ in MANIFEST] + ["own"] and align_manifest(new).collect() == new.collect()
    assert {(r.action, r.outcome, r.is_locked, r.user_decision) for r in new.collect()} == {("", "", 0, "")}


# -- metadata, files, streams ---------------------------------------------------------------------------------


def test_tool_output(spark):
    text = 'warning [x\n[{"SourceFile":"a","EXIF:DateTimeOriginal":"0000:00:00 00:00:00","XMP:CreateDate":"2020:01:02 03:04:05","EXIF:GPSLatitude":1.5,"XMP:Rating":"4"},{"SourceFile":"b"}]\n 2 files read'
    rows = spark.createDataFrame([(text[11:],), ("garbage",), (None,), ("[{broken",)], "output string")
    got = {r.path: r for r in X.extracts(spark.createDataFrame([("a",), ("b",), ("c",)], "path string"), X.tool_records(rows)).collect()}
    assert (got["a"].exif_date_tag, got["a"].gps_present, got["a"].xmp_rating, got["a"].exif_tag_count) == ("XMP:CreateDate", True, 4, 3)
    assert got["b"].exif_tag_count == 0 and got["b"].error is None and got["c"].error == "no record"


def test_merge_extracts(spark):
    schema = "path string, seq int, extracted_by array<string>, errors array<string>, file_type string, pixel_width int, pixel_height int, exif_date string, exif_date_tag string, exif_tag_count int, gps_present boolean, xmp_derived boolean"
    rows = [("p", 1, ["pil"], ["e1"], "", 10, 20, "d1", "t1", None, False, None), ("p", 2, ["rawpy"], None, "raw", 30, 40, None, None, 5, True, None), ("p", 3, ["exiftool"], ["e3"], "heic", None, None, "d3", "t3", 6, None, True)]
    r = X.merge_extracts(spark.createDataFrame(rows, schema)).first()
    assert (r.file_type, r.pixel_width, r.pixel_height, r.exif_date, r.exif_date_tag, r.exif_tag_count, r.gps_present, r.xmp_derived) == ("raw", 30, 40, "d3", "t3", 5, False, True)
    assert r.extracted_by == ["exiftool", "pil", "rawpy"] and r.errors == ["e1", "e3"]


def test_backfill(spark):
    rows = spark.createDataFrame([("a", 1, None), ("b", 2, 5)], "path string, x int, y int")
    found = spark.createDataFrame([("a", 9, 8), ("b", None, 7)], "path string, x int, y int")
    assert sorted(map(tuple, X.backfill(rows, found, ["x"], ["y"]).collect())) == [("a", 9, 8), ("b", 2, 5)]


def test_scan(spark, tmp_path):
    for name, content in {"b.jpg": b"\xff\xd8x", "a.PNG": b"GIF89a", "note.txt": b"x", "Thumbs.db": b"x", "sub/c.jpg": b"\xff\xd8x", "sub/.Trashes/d.jpg": b"y", "odd.jpg.": b"z"}.items():
        p = tmp_path / "one" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "e.heic").write_bytes(b"0000ftypheic")
    roots = {"x": str(tmp_path / "one"), "y": str(tmp_path / "two")}
    got = files.scan_sources(spark, roots, content=True).collect()
    assert sorted((r.source_label, r.path.rsplit("/", 1)[1], r.file_type) for r in got) == [("x", "a.PNG", "gif"), ("x", "b.jpg", "jpeg"), ("x", "c.jpg", "jpeg"), ("y", "e.heic", "heic")]
    assert files.scan_sources(spark, roots, recursive={"x": False}).count() == 3 and files.scan_sources(spark, roots, limit=1).count() == 2
    hashed = files.read_stage(files.scan_sources(spark, roots, content=True))
    assert hashed.select("sha256").distinct().count() == 3
    with pytest.raises(Exception):  # noqa: B017
        files.scan_sources(spark, {"z": str(tmp_path / "none")}).count()


def test_stream_appends_once(spark, tmp_path):
    source, target, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    schema = "path string, phash string"
    for part in ([("a", "1"), ("b", "2")], [("b", "9"), ("c", "3")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        for _ in range(2):
            ingest.append_fingerprints(spark.readStream.schema(schema).parquet(source), target, check).awaitTermination()
    assert sorted(map(tuple, ingest.fingerprints(spark, target).collect())) == [("a", "1"), ("b", "2"), ("c", "3")]


DECIDED = "source_path string, group_id string, user_decision string, is_locked int, outcome string, executed int"
ROWS = [
    ("a", "1", "delete", 1, None, None), ("b", "1", "delete", 0, None, None), ("c", "1", "ignore", 1, None, None), ("d", "2", "delete", 1, "", 0), ("e", "2", None, None, None, None), ("f", None, "delete", None, None, None),
    ("g", "3", "", 0, None, None), ("h", "4", "delete", 0, None, None), ("i", "5", "keep", 1, None, None),
]


def by_path(df, *columns):
    return {r.source_path: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_lock_gate_and_execution(spark):
    rows, scope = spark.createDataFrame(ROWS, DECIDED), spark.createDataFrame([("a",), ("b",), ("c",), (None,), ("zz",)], "source_path string")
    old = by_path(rows, "user_decision", "is_locked")
    assert by_path(M.lock_gate(rows, "clear", scope), "user_decision", "is_locked") == old | {"a": ("", 1)}
    assert by_path(M.lock_gate(rows, "unlock"), "user_decision", "is_locked") == old | {"a": ("delete", 0), "d": ("delete", 0)}
    assert by_path(M.lock_gate(rows, "cancel"), "user_decision", "is_locked") == old
    before = by_path(rows, "outcome")
    assert by_path(M.execute(rows), "outcome") == before | {"b": "deleted", "c": "ignored", "f": "deleted", "h": "deleted"}
    assert by_path(M.execute(rows, scope, "unlock"), "outcome") == before | {"a": "deleted", "b": "deleted", "c": "ignored"}
    assert by_path(M.execute(rows, scope, "clear"), "outcome") == before | {"b": "deleted", "c": "ignored"}
    assert by_path(M.execute(rows, scope, "cancel"), "outcome") == before
    free = spark.createDataFrame([("b",), ("c",)], "source_path string")
    assert by_path(M.execute(rows, free, "cancel"), "outcome") == before | {"b": "deleted", "c": "ignored"}
    assert {r.source_path for r in M.delete_paths(rows).collect()} == {"b", "f", "h"}
    assert {r.source_path for r in M.delete_paths(rows, scope).collect()} == {"b", "zz", None}
    plan = {r.group_id: (r.total, r.selected, r.is_full_delete) for r in R.delete_plan(rows).collect()}
    assert plan == {"1": (3, 2, False), "2": (2, 1, False), "3": (1, 0, False), "4": (1, 1, True), "5": (1, 0, False)}
    assert [r.group_id for r in R.complete_deletes(rows).collect()] == ["4"]
    two = spark.createDataFrame([("a",), ("b",), ("e",)], "source_path string")
    assert [r.group_id for r in R.complete_deletes(rows, scope=two).collect()] == ["1"]
    with pytest.raises(ValueError):
        M.lock_gate(rows, "maybe")


def test_pruning_of_single_rows(spark):
    rows = spark.createDataFrame(ROWS, DECIDED)
    gone = lambda *a, **k: {r.source_path for r in M.prune_singles(rows, *a, **k).where("outcome = 'ignored'").collect()}
    assert gone() == {"g", "h"} and gone("never", "unlock") == set() and gone("always", "unlock", plain=False) == {"g", "h", "i"}
    assert gone("ask", actioned=False) == {"g"} and gone("ask", "unlock", plain=False, actioned=False) == {"i"} and gone("ask", "cancel") == {"g", "h"}


def test_fields_as_text(spark):
    values = [0.0005, 0.00001234, 5.0, 0.0, -0.00025, 12345678.5, 1e15, 1e16, 1.5e22, 123456789012.0, 0.1, 1e-5, float("nan"), float("inf"), None]
    rows = spark.createDataFrame([(v,) for v in values], "score double")
    assert [r[0] for r in rows.select(S.text_field("Score")).collect()] == [None if v is None else str(v) for v in values]
    dates = spark.createDataFrame([("2020-01-02 03:04:05.25",), ("2020-01-02 03:04:05",), (None,)], "d string").select(F.col("d").cast("timestamp_ntz").alias("shot_date"))
    assert [r[0] for r in dates.select(S.text_field("Shot Date")).collect()] == ["2020-01-02 03:04:05.250000", "2020-01-02 03:04:05", None]


def test_exports_leave_the_source_alone(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, DECIDED)
    with pytest.raises(ValueError):
        M.export_decisions(rows, rows, f"{tmp_path}/a/", source=f"{tmp_path}/a")
