import hashlib
import os

import __spark_entry__ as entry
from kinfold.operators.classify import classify, pair_clusters
from kinfold.runtime import Scratch
from kinfold.sources import files


def test_what_links_lead_to_is_left_out(spark, tmp_path):
    out, real = tmp_path / "out", tmp_path / "real"
    for at in (out / "deep", real / "a" / "b"):
        at.mkdir(parents=True)
    for at in (out / "o.jpg", out / "deep" / "p.jpg", real / "x.jpg", real / "a" / "b" / "y.jpg"):
        at.write_bytes(b"\xff\xd8\xff")
    os.symlink(out, real / "a" / "way")
    os.symlink(out / "o.jpg", real / "z.jpg")
    root = tmp_path / "root"
    os.symlink(real, root)
    want = [f"{root}/a/b/y.jpg", f"{root}/x.jpg"]
    assert sorted(r.path for r in files.scan_sources(spark, {"s": str(root)}).collect()) == want
    assert sorted(r.path for r in files.scan_sources(spark, {"s": f"file:{root}/"}, content=True).collect()) == want
    seen = {r.path: r.linked for r in entry.queries()["pr4_symlinks"](spark, str(root)).collect()}
    assert sorted(p for p, linked in seen.items() if not linked) == want and seen[f"{root}/a/way/deep/p.jpg"] and seen[f"{root}/z.jpg"]


def test_scan_to_classes(spark, tmp_path):
    """Planted files, from the scan to their classes, with what must come out spelled out."""
    jpeg, heic, tiff = b"\xff\xd8\xff", b"\0\0\0\x18ftypheic", b"II*\0"
    planted = {
        "one/a.jpg": jpeg + b"same", "one/b.jpg": jpeg + b"same", "one/c.heic": heic + b"1", "one/d.jpg": jpeg + b"2", "one/e.jpg": jpeg + b"3", "one/IMG_1.jpg": jpeg + b"4", "one/IMG_1.dng": tiff + b"5",
        "one/wrong.tif": jpeg + b"6", "one/right.tif": tiff + b"7", "one/note.txt": b"x", "one/deep/film.mp4": b"\0\0\0\x18ftypisom", "two/a.jpg": jpeg + b"same", "two/lost.jpg": jpeg + b"8",
    }
    for name, content in planted.items():
        at = tmp_path / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(content)
    os.symlink(tmp_path / "one" / "d.jpg", tmp_path / "two" / "link.jpg")
    found = Scratch(spark, "scan").keep(files.scan_sources(spark, {"x": str(tmp_path / "one"), "y": str(tmp_path / "two")}))
    short = lambda p: p[len(str(tmp_path)) + 1 :]
    assert [short(r.path) for r in found.orderBy("ord").collect()] == sorted(n for n in planted if n != "one/note.txt" and n[:3] == "one") + ["two/a.jpg", "two/lost.jpg"]
    assert sorted(r.ord for r in found.collect()) == list(range(12))
    (tmp_path / "two" / "lost.jpg").unlink()
    read, unread = files.split_read(Scratch(spark, "read").keep(files.read_stage(found)))
    assert [(short(r.path), r.sha256, r.error.split(":")[0]) for r in unread.collect()] == [("two/lost.jpg", None, "FileNotFoundError")]
    kinds = {short(r.path): (r.file_type, r.sha256) for r in read.collect()}
    assert kinds == {n: (kinds[n][0], hashlib.sha256(c).hexdigest()) for n, c in planted.items() if n not in ("one/note.txt", "two/lost.jpg")}
    assert {n: k for n, (k, _) in kinds.items() if n.endswith("tif")} == {"one/wrong.tif": "jpeg", "one/right.tif": "raw"}
    h = {"one/c.heic": "f0f0f0f0f0f0f0f0", "one/d.jpg": "f0f0f0f0f0f0f0f0", "one/e.jpg": "f0f0f0f0f0f0f0f3", "one/a.jpg": "0123456789abcdef"}
    hashes = spark.createDataFrame([(f"{tmp_path}/{n}", v, 500, 500) for n, v in h.items()], "path string, phash string, pixel_width int, pixel_height int")
    rows = {short(r.path): r for r in classify(files.media_records(read, hashes)).collect()}
    got = {n: (r.action, r.duplicate_of and short(r.duplicate_of), r.group_id and short(r.group_id)) for n, r in rows.items()}
    a, c, i = "one/a.jpg", "one/c.heic", "one/IMG_1.dng"
    assert got == {
        a: ("UNDATED", None, a), "one/b.jpg": ("EXACT", a, a), "two/a.jpg": ("EXACT", a, a), c: ("UNDATED", None, c), "one/d.jpg": ("EXACT", c, c), "one/e.jpg": ("REVIEW_DUPLICATE", c, c),
        i: ("UNDATED", None, i), "one/IMG_1.jpg": ("UNDATED", None, i), "one/wrong.tif": ("UNDATED", None, None), "one/right.tif": ("UNDATED", None, None), "one/deep/film.mp4": ("UNDATED", None, None),
    }
    assert rows["one/d.jpg"].reason == "format duplicate of c.heic (jpeg vs heic)"
    clusters = {short(r.path): short(r.cluster) for r in pair_clusters(files.media_records(read, hashes)).collect()}
    assert clusters == {i: i, "one/IMG_1.jpg": i}
