"""Operators, sources, sinks and streams on small inputs."""

import hashlib
import io
import json
import os
import zipfile
import zlib
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.functions import boxes, text
from fieldbook.operators import clean, curate, dedup, frames, lineage, match, metrics, split, validate, vectors, views
from fieldbook.plans import publish
from fieldbook.sources import exports, files, sheets, slides
from fieldbook.streaming import append


def value(spark, column, **cells):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]) if cells else spark.range(1)
    return frame.select(column).first()[0]


@pytest.mark.parametrize(
    ("given", "wanted"),
    [("a//b/./c", "a/b/c"), ("../x", "../x"), ("/../x", "/x"), ("a/../../b", "../b"), ("a\\b", "a/b"), ("", "."), ("/", "/")],
)
def test_paths(spark, given, wanted):
    assert value(spark, text.normal_path(F.col("p")), p=given) == wanted


def test_text_functions(spark):
    assert value(spark, text.site(F.col("p")), p="site 007") == "SITE 7"
    assert value(spark, text.camera_of_path(F.col("p")), p="SITE 1/cam b/x.jpg") == "CAM B"
    assert value(spark, text.file_type(F.col("p")), p="x.MP4") == "VIDEO"
    assert value(spark, text.clean_date(F.col("p")), p="13/2/2020") == "2020-02-13"
    assert value(spark, text.clean_date(F.col("p")), p="not a date") == ""
    assert value(spark, text.slug(F.col("p")), p="SubCenter ArcFace_v2") == "sub-center-arc-face-v2"
    assert value(spark, text.embedding_field(F.col("p")), p="hf-hub:a/b-c") == "embeddings_a_b_c"
    assert value(spark, text.drive_id(F.col("p")), p="https://x/folders/Ab_1-?q") == "Ab_1-"
    assert value(spark, text.stable_id(F.lit("v1"), F.col("p")), p="a") == hashlib.sha256(b"v1\0a").hexdigest()[:24]
    assert value(spark, text.labelled_field(F.col("p"), "nome", ["data"]), p="NOME:  a\n b data: x") == "a b"


@pytest.mark.parametrize(
    ("box", "fine"),
    [([0.2, 0.2, 0.5, 0.5], True), ([0.0, 0.0, 1.0, 1.0], True), ([0.6, 0.0, 0.5, 0.1], False), ([-0.1, 0.0, 0.1, 0.1], False), ([0.1, 0.1, 0.1], False), ([float("nan"), 0.0, 0.1, 0.1], False), (None, False)],
)
def test_box_rule(spark, box, fine):
    got = spark.createDataFrame([(box,)], "b array<double>").select(boxes.box_error(F.col("b"))).first()[0]
    assert (got is None) == fine


def test_crop_box(spark):
    got = value(spark, boxes.crop_box(F.lit(10.0), F.lit(10.0), F.lit(90.0), F.lit(40.0), F.lit(100), F.lit(50)))
    assert got == pytest.approx([0.1, 0.2, 0.8, 0.6])
    assert value(spark, boxes.crop_box(F.lit(9.0), F.lit(1.0), F.lit(9.0), F.lit(4.0), F.lit(100), F.lit(50))) is None


def test_detection_filters_tag_null_and_bad(spark):
    d = lambda c, w, h: {"id": "d", "label": "x", "confidence": c, "bounding_box": [0.0, 0.0, w, h]}
    rows = spark.createDataFrame([(1, None, []), (2, [d(0.9, 0.5, 0.5)], []), (3, [d(0.9, 0.5, 0.5)] * 2, []), (4, [d(0.4, 0.5, 0.5)], []), (5, [d(0.9, 1.0, 1.0)], [])], f"sample_id int, detections {boxes.DETECTIONS}, tags array<string>")
    tagged = {r.sample_id: r.tags for r in views.tag_by_quality(views.tag_by_count(rows, "detections"), "detections", 0.5, 0.01, 0.9).collect()}
    assert tagged == {1: ["filter_count"], 2: [], 3: ["filter_count"], 4: ["filter_quality"], 5: ["filter_quality"]}


@pytest.mark.parametrize(("fps", "n", "rates", "wanted"), [(10.0, 20, (2.0, 1.0, 0.5), [0, 5, 10]), (10.0, 20, (2.0, 0.5, 0.0), [0]), (0.0, 20, (2.0, 1.0, 0.5), []), (10.0, 0, (2.0, 1.0, 0.5), []), (10.0, 5, (2.0, 1.0, 0.5), [0]), (2.0, 9, (0.0, 1.0, 1.0), [2, 4, 6, 8])])
def test_frame_numbers(spark, fps, n, rates, wanted):
    assert value(spark, frames.frame_numbers(F.lit(fps), F.lit(n), *rates)) == wanted


def test_greedy_leaders_follow_the_loop(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 6))
    x[10] = x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    leader, want = [], {}
    for i in range(len(x)):
        first = next((j for j in leader if unit[i] @ unit[j] >= 0.6), None)
        want[i] = first
        if first is None:
            leader.append(i)
    got = {r.id: r.duplicate_of for r in dedup.greedy_leaders(spark.createDataFrame(rows, "id long, vector array<double>"), 0.6).collect()}
    assert got == want


def brute_metrics(x, y):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    aps, firsts, by = [], [], {}
    for q in range(len(x)):
        s = np.round(unit @ unit[q], 12)
        order = [g for g in np.lexsort((np.arange(len(x)), -s)) if g != q]
        hits = [r + 1 for r, g in enumerate(order) if y[g] == y[q]]
        if hits:
            ap = np.mean([(k + 1) / r for k, r in enumerate(hits)])
            aps.append(ap)
            firsts.append(hits[0])
            by.setdefault(y[q], []).append(ap)
    return np.mean(aps), np.mean([np.mean(v) for v in by.values()]), {k: np.mean([f <= k for f in firsts]) for k in (1, 5)}


def test_retrieval_metrics_over_many_blocks(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(90, 5)), rng.integers(0, 12, 90)
    frame = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(90)], "id long, label int, vector array<double>")
    got = metrics.retrieval_metrics(frame, block=17).first()
    mean, balanced, cmc = brute_metrics(x, y)
    assert (got.map, got.identity_balanced_map, got.cmc_1, got.cmc_5) == pytest.approx((mean, balanced, cmc[1], cmc[5]))
    lone = spark.createDataFrame([(i, i, [1.0 * (k == i) for k in range(5)]) for i in range(5)], "id long, label int, vector array<double>")
    assert metrics.retrieval_metrics(lone).first().n_queries == 0
    assert metrics.cmc_all_queries(lone, (1, 3)).first()[:] == (0.0, 0.0)


def test_losses(spark):
    logits = F.array(F.lit(10.0), F.lit(0.0), F.lit(0.0))
    assert value(spark, metrics.cross_entropy(logits, F.lit(0))) == pytest.approx(np.log(1 + 2 * np.exp(-10)))
    assert value(spark, metrics.focal_loss(logits, F.lit(0), 0.0)) == pytest.approx(np.log(1 + 2 * np.exp(-10)))
    with pytest.raises(ValueError):
        metrics.build_loss("unknown")
    one_class = spark.createDataFrame([(0, i, 0, [float(i), 1.0]) for i in range(4)], "batch long, id long, label int, vector array<double>")
    assert metrics.triplet_loss(one_class, mining="hard").first().loss == 0


def test_splits_keep_their_promises(spark):
    rows = spark.createDataFrame([(i, i // 8 if i < 160 else None) for i in range(170)], "sample_id int, who int")
    closed = split.closed_set_split(rows, "who")
    assert closed.where("who IS NULL AND closed_set_split IS NOT NULL").count() == 0
    assert closed.where("closed_set_split = 'train'").select("who").distinct().count() == 20
    opened = split.open_set_split(rows, "who").where("who IS NOT NULL")
    kinds = opened.groupBy("who").agg(F.collect_set("open_set_split").alias("s")).collect()
    assert sum(set(r.s) == {"train"} for r in kinds) >= 12 and sum("train" not in r.s for r in kinds) >= 4
    with pytest.raises(ValueError):
        split.closed_set_split(rows, "who", ratios=(0.5, 0.1, 0.1))
    batches = split.pk_batches(rows.where("who IS NOT NULL"), "who", 3, 4, "sample_id").groupBy("batch").agg(F.count_distinct("who").alias("p"), F.count("*").alias("n")).collect()
    assert len(batches) == 6 and all((b.p, b.n) == (3, 12) for b in batches)
    with pytest.raises(ValueError):
        split.pk_batches(rows, "who", 30, 4, "sample_id")


CANDIDATE = "candidate_id string, kind string, identity string, filename string, source_ids array<string>, source_path string, relative_path string, filenames array<string>, site string"
TERMINAL = "terminal_id int, identity string, source_id string, source_path string, relative_path string, filename string"


def test_lineage_precedence_and_ambiguity(spark):
    c = [("e1", "export", "A", "f1", ["s1"], None, None, ["f1"], "x"), ("m1", "manifest", "A", "f1", [], None, None, ["f1"], "y"), ("e2", "export", "B", "f2", ["s2"], None, "r2", ["f2"], "z"), ("e3", "export", "B", "f2", ["s2"], None, "r2", ["f2"], "z"), ("e4", "export", None, "f4", [], "p4", None, ["f4"], "w")]
    t = [(1, "A", "s1", None, None, None), (2, "A", None, None, None, "f1"), (3, None, "s2", None, "nope", None), (4, "Q", "s1", None, None, None), (5, None, "none", "p4", None, None), (6, None, None, None, None, "zz")]
    got = {r.terminal_id: (r.lineage_status, r.lineage_match_method, r.site) for r in lineage.enrich(spark.createDataFrame(t, TERMINAL), spark.createDataFrame(c, CANDIDATE), ["site"]).collect()}
    assert got == {1: ("matched", "source_id", "x"), 2: ("matched", "unique_filename", "x"), 3: ("ambiguous", None, None), 4: ("ambiguous", None, None), 5: ("matched", "normalized_source_filepath", "w"), 6: ("missing", None, None)}


def test_fuzzy_matching(spark):
    listing = spark.createDataFrame([(p,) for p in ["SITE 1/CAM A/IMG_0001.jpg", "SITE 1/CAM B/IMG_0002.jpg", "SITE 2/CAM A/other.mp4"]], "path string")
    missing = spark.createDataFrame([(1, "img_0001.JPG", "SITE 1", "CAM A"), (2, "IMG_0001.png", "SITE 1", "CAM A"), (3, "IMG-0002.jpg", "SITE 1", "CAM B"), (4, "unrelated.txt", "SITE 9", None)], "row_id long, target string, site string, cam string")
    got = {r.row_id: r for r in match.match_missing(missing, listing, 0.95, 0.8).collect()}
    assert (got[1].method, got[1].score, got[1].outcome) == ("exact_name", 1.0, "applied")
    assert (got[2].method, got[2].score) == ("exact_stem", 0.99)
    assert got[3].path == "SITE 1/CAM B/IMG_0002.jpg" and got[3].score == pytest.approx(SequenceMatcher(None, "img-0002.jpg", "img_0002.jpg").ratio()) and got[3].outcome == "suggested"
    assert got[4].outcome == "unresolved" and got[4].path is None


def test_fuzzy_matching_of_all_files(spark):
    """Against brute force over all names: other sites, null sites, and names that begin differently."""
    import random

    draw = random.Random(5)
    names = sorted({"".join(draw.choice("abIMG_01") for _ in range(draw.randint(6, 12))) + draw.choice([".jpg", ".mp4"]) for _ in range(120)})
    paths = [f"SITE {i % 4}/CAM {'AB'[i % 2]}/{n}" for i, n in enumerate(names)] + ["SITE 1/CAM A/IMG_7777.jpg"]
    targets = ["MG_7777.jpg"] + ["".join(c for c in n if draw.random() > 0.1) for n in names[::4]]
    rows = [(i, w, draw.choice([None, "SITE 1", "SITE 9"]), None) for i, w in enumerate(targets)]
    missing = spark.createDataFrame(rows, "row_id long, target string, site string, cam string")
    got = {r.row_id: r for r in match.match_missing(missing, spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got[0].path == "SITE 1/CAM A/IMG_7777.jpg" and got[0].outcome == "applied"
    for i, w, _, _ in rows:
        if got[i].method in ("fuzzy", None):
            best = max(SequenceMatcher(None, w.lower(), p.split("/")[-1].lower()).ratio() for p in paths)
            assert got[i].score == (pytest.approx(best) if best >= 0.8 else 0.0)


def test_exact_names_in_several_sites(spark):
    """The row's own site and camera win over the first path, for names and for stems."""
    listing = spark.createDataFrame([(f"SITE {s}/CAM {c}/IMG_0001.jpg",) for s in (1, 2, 3) for c in "AB"] + [("IMG_0001.jpg",)], "path string")
    missing = spark.createDataFrame([(1, "IMG_0001.jpg", "SITE 2", "CAM B"), (2, "img_0001.png", "SITE 3", "CAM A"), (3, "IMG_0001.jpg", None, None)], "row_id long, target string, site string, cam string")
    got = {r.row_id: r.path for r in match.match_missing(missing, listing).collect()}
    assert got == {1: "SITE 2/CAM B/IMG_0001.jpg", 2: "SITE 3/CAM A/IMG_0001.jpg", 3: "IMG_0001.jpg"}


def test_sheet_cleaning(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("CAMERA TRAP SITE;JAGUAR ID;CAM;Files Name;DATE;TIME;NOTES/ ERRORS\nsite 1;F1;a;x.mp4 and y.jpg;1/31/2020;10:00:00;n\nsite 1;?;b;z.jpg;;;\n;;;;;;\nsite 1;F1;a;x.mp4;;;\n")
    sheet = sheets.read_sheet(spark, str(tmp_path / "labels.csv"))
    assert len(sheet.columns) == 7
    numbered = clean.numbered_in_order(sheet.withColumn("o", F.monotonically_increasing_id()), "o", "row").drop("o")
    rows = {(r["Files Name"], r["JAGUAR ID"], r["CAMERA TRAP SITE"], r["CAM"]) for r in clean.clean_sheet(numbered, "row").collect()}
    assert rows == {("x.mp4", "F1", "SITE 1", "CAM A"), ("y.jpg", "F1", "SITE 1", "CAM A"), ("z.jpg", "U1", "SITE 1", "CAM B")}
    with pytest.raises(ValueError, match="CAM"):
        clean.check_columns(sheet.drop("CAM"))
    named = sheets.normalise_headers(sheet, {"site": ["Site", "Camera-Trap Site"], "none": ["x"]})
    assert named.first()[:] == ("site 1", None)


def test_exports_and_files(spark, tmp_path):
    samples = [{"_id": {"$oid": f"{k:024d}"}, "filepath": f"/x/data/{n}", "jaguar_id": w, "bboxes_body": {"detections": [{"id": "1", "label": "l", "confidence": 0.5, "bounding_box": [0, 0, 0.5, 0.5]}]}, "tags": ["t"]} for k, (n, w) in enumerate([("b.png", " F1 "), ("a.png", None)])]
    (tmp_path / "samples.json").write_text(json.dumps({"samples": samples}, indent=1))
    read = exports.read_export(spark, str(tmp_path))
    records = {r.relative_path: (r.source_id, r.identity, r.bboxes_body[0].bounding_box) for r in exports.terminal_records(read).collect()}
    assert records == {"data/b.png": (f"{0:024d}", "F1", [0, 0, 0.5, 0.5]), "data/a.png": (f"{1:024d}", None, [0, 0, 0.5, 0.5])}
    loose = exports.read_loose(spark, str(tmp_path))
    assert exports.union_sources([exports.export_candidates(loose, "/x"), exports.export_candidates(loose, "/x", 1)]).count() == 4
    assert exports.source_hash(spark, str(tmp_path)) == hashlib.sha256((tmp_path / "samples.json").read_bytes()).hexdigest()
    assert exports.load_dataset(spark, "export", str(tmp_path)).count() == 1
    tree = tmp_path / "images/train/cat"
    tree.mkdir(parents=True)
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    whole = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (7).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes(5)) + chunk(b"IEND", b"")
    (tree / "1.png").write_bytes(whole)
    (tree / "2.PNG").write_bytes(whole[:-6])
    (tree / "notes.txt").write_text("x")
    assert {r[:] for r in files.image_folder(spark, str(tmp_path / "images")).collect()} == {("train/cat/1.png", "train", "cat"), ("train/cat/2.PNG", "train", "cat")}
    got = {r.path.rsplit("/", 1)[1]: r for r in files.integrity(spark, str(tree)).collect()}
    assert (got["1.png"].width, got["1.png"].height, got["1.png"].sha256) == (7, 5, hashlib.sha256(whole).hexdigest())
    assert {k: r.readable for k, r in got.items()} == {"1.png": True, "2.PNG": False, "notes.txt": True}
    assert files.list_media(spark, str(tmp_path / "images")).count() == 2


def deck():
    out = io.BytesIO()
    p, a, r = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", f'<s xmlns:p="{p}"><p:pic/></s>')
        z.writestr("ppt/slides/slide2.xml", f'<s xmlns:p="{p}" xmlns:a="{a}" xmlns:r="{r}"><a:p><a:t>NOME: x</a:t></a:p><p:pic><a:blip r:embed="i1"/><a:srcRect l="10000" t="20000" r="10000" b="20000"/></p:pic></s>')
        z.writestr("ppt/slides/_rels/slide2.xml.rels", '<R><r Id="i1" Target="../media/image1.png"/></R>')
        z.writestr("ppt/media/image1.png", b"bytes")
    return out.getvalue()


def test_slides(spark, tmp_path):
    (tmp_path / "d.pptx").write_bytes(deck())
    (tmp_path / "broken.pptx").write_bytes(b"no deck")
    read = slides.read_slides(spark, str(tmp_path))
    assert [r.error.split(":")[0] for r in read.where("error IS NOT NULL").collect()] == ["BadZipFile"]
    r = read.where("error IS NULL").collect()
    from fieldbook.plans import ingest

    rows, told, broken = ingest.ingest_slides(spark, str(tmp_path))
    assert rows.count() == 1 and told.first()[:] == (1, 1, 0) and broken.count() == 1
    assert len(r) == 1 and (r[0].name, r[0].text, r[0].crop_left, r[0].crop_top, r[0].sha1) == ("slide_002_img_01.png", "NOME: x", 0.1, 0.2, hashlib.sha1(b"bytes").hexdigest())


def test_slide_rows(spark):
    rows = spark.createDataFrame([(1, "NUMBER ID: Açaí? (old)\nSITE: 007 SEX: Female adult DATAS: OBS: seen 3/4/2020"), (2, "NOME: b NAME: c PONTO: 12 SEX: ? DATAS: 2021-05-06"), (3, "nothing")], "slide int, text string")
    got = {r.slide: (r.identity, r.site, r.sex, r.date, r.SIGHTING_ID) for r in clean.slide_rows(rows, "slide").collect()}
    assert got == {1: ("ACAI", "SITE 7", "F", "2020-03-04", "PP1"), 2: ("C", "SITE 12", "?", "2021-05-06", "PP2"), 3: (None, None, "", "", "PP3")}


def test_manifests(spark, tmp_path):
    (tmp_path / "pptx_split.csv").write_text("\ufeffID,Jaguar ID,File Path,Dataset Path,Lat\ns1, F1 ,a\\b.jpg,set,1.5\ns1,F1,a\\b.jpg,set,x\n")
    (tmp_path / "exp").mkdir()
    (tmp_path / "exp/samples.json").write_text(json.dumps({"samples": [{"_id": {"$oid": "s1"}, "filepath": "data/b.jpg", "jaguar_id": "F1"}]}))
    (tmp_path / "exp/metadata.json").write_text("{}")
    got = exports.load_candidates(spark, [str(tmp_path / "exp")], [str(tmp_path / "pptx_split.csv")])
    rows = got.where("kind = 'manifest'").collect()
    assert len({r.candidate_id for r in rows}) == 2 and got.count() == 3
    assert {(r.identity, r.source_path, r.filename, r.source_type, r.latitude_value) for r in rows} == {("F1", "set/a/b.jpg", "b.jpg", "pptx", 1.5), ("F1", "set/a/b.jpg", "b.jpg", "pptx", None)}
    assert exports.find_export_root(spark, str(tmp_path)).endswith("/exp")


def test_publish_is_staged(spark, tmp_path):
    target, frame = str(tmp_path / "snap"), spark.range(5).withColumnRenamed("id", "k")
    assert publish.publish(frame, target, publish.same_rows(5, "k")) is None
    with pytest.raises(FileExistsError):
        publish.publish(frame, target, publish.same_rows(5, "k"))
    with pytest.raises(ValueError):
        publish.publish(frame.limit(3), target, publish.same_rows(5, "k"), replace=True)
    assert publish.published(spark, target).count() == 5
    retired = publish.publish(spark.range(7).withColumnRenamed("id", "k"), target, publish.same_rows(7, "k"), replace=True)
    assert publish.published(spark, target).count() == 7 and spark.read.parquet(retired).count() == 5
    with publish.leased(spark, target):  # a second writer
        with pytest.raises(FileExistsError):
            publish.publish(frame, target, publish.same_rows(5, "k"), replace=True)
    assert publish.published(spark, target).count() == 7
    publish.acquire(spark, target, 3600).give_back()
    report = publish.snapshot_run(frame, target, "k", str(tmp_path / "reports"), dry_run=True)
    assert report.phase == "audit" and json.loads((tmp_path / "reports/latest.json").read_text())["counts"] == {"rows": 5}
    with pytest.raises(FileExistsError):
        publish.snapshot_run(frame, target, "k", str(tmp_path / "reports"), dry_run=False)
    assert "FileExistsError" in json.loads((tmp_path / "reports/latest.json").read_text())["failure"]


def test_append_stream_is_idempotent(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    frame = lambda rows: spark.createDataFrame(rows, "path string, sha1 string, n int")
    frame([("a", "1", 1), ("a", "2", 2), ("b", "1", 3), ("c", "3", 4)]).coalesce(1).write.parquet(str(source))
    for _ in range(2):
        stream = spark.readStream.schema("path string, sha1 string, n int").parquet(str(source))
        append.append_stream(stream, str(target), ["path", "sha1"], "n", str(tmp_path / "check")).awaitTermination()
        assert sorted(r.n for r in spark.read.parquet(str(target)).collect()) == [1, 4]
        frame([("a", "9", 5), ("d", "3", 6)]).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema("path string, sha1 string, n int").parquet(str(source))
    frame([("e", "5", 7)]).write.mode("append").parquet(str(source))
    append.append_stream(stream, str(target), ["path", "sha1"], "n", str(tmp_path / "check")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(target)).collect()) == [1, 4, 7]


def test_validation_collects_everything(spark):
    rows = spark.createDataFrame([(1, "h1", " ", True), (2, "h1", "x", True), (3, "h3", None, False)], "k int, sha256 string, who string, readable boolean")
    kept, errors, told = validate.validate(rows, "k", validate.identity_rules("who"), {"sha256": "content"}, "readable")
    assert kept.count() == 2 and sorted(r.k for r in errors.collect()) == [1, 1, 2, 3] and told.first()[:] == (4, 3)
    with pytest.raises(ValueError):
        validate.require_none(errors, "rows")
    assert validate.same_multiset(rows, rows).count() == 0
    assert validate.count_error(rows, 4).count() == 1


def test_a_dead_writer_blocks_nobody_and_a_late_one_cannot_publish(spark, tmp_path):
    target, frame = str(tmp_path / "snap"), spark.range(5).withColumnRenamed("id", "k")
    late = publish.acquire(spark, target, seconds=0.0, owner="late")  # dies, or sleeps, without giving its lease back
    publish.publish(frame, target, publish.same_rows(5, "k"))
    now = publish.current(spark, target)
    with pytest.raises(RuntimeError):
        publish.point(late, "version-late")
    with pytest.raises(RuntimeError):
        late.renew()
    late.give_back()  # changes nothing
    # Even one that passed the check before it fell asleep makes a pointer that nobody follows.
    assert publish._create(spark, f"{target}/CURRENT-{late.number:012d}", "version-late")
    assert publish.current(spark, target) == now and publish.published(spark, target).count() == 5
    first = publish.acquire(spark, target, seconds=60.0)
    assert first.number == late.number + 2
    with pytest.raises(FileExistsError):
        publish.publish(frame, target, publish.same_rows(5, "k"), replace=True)
    first.give_back()
    publish.publish(frame.limit(2), target, publish.same_rows(2, "k"), replace=True)
    assert publish.published(spark, target).count() == 2


def test_of_two_writers_one_gets_the_lease(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    def take(_):
        try:
            return publish.acquire(spark, str(tmp_path / "t"), 60.0).number
        except FileExistsError:
            return None

    with ThreadPoolExecutor(6) as pool:
        assert sorted(filter(None, pool.map(take, range(6)))) == [1]


def test_curation_counts(spark):
    schema = f"path string, sha256 string, identity string, compatible boolean, bboxes_body {boxes.DETECTIONS}, tags array<string>"
    d = [{"id": "1", "label": "x", "confidence": 1.0, "bounding_box": [0.0, 0.0, 1.0, 1.0]}]
    source = spark.createDataFrame([("a", "1", "F11", True, d, []), ("b", "1", "F11", True, d, []), ("false", "2", None, True, d, []), ("review", "3", "F14", True, d, []), ("clip", "4", None, True, d, [])], schema)
    policy = spark.createDataFrame([("false", "false_positive", None, None), ("review", "review", "blurred", None), ("clip", "clip", None, [0.0, 0.0, 0.5, 0.5])], "path string, action string, reason string, box array<double>")
    decisions, made = curate.plan(source, policy, "v1", {"source": 5, "kept": 3, "dropped_duplicates": 1})
    assert {(r.path, r.reason) for r in decisions.where("decision = 'drop'").collect()} == {("b", "exact_content_duplicate"), ("false", "confirmed_false_positive")}
    got = {r.path: (r.review_status, r.bboxes_body and r.bboxes_body[0].bounding_box[2]) for r in made.collect()}
    assert got == {"a": (None, 1.0), "review": ("pending", None), "clip": (None, 0.5)}
    with pytest.raises(ValueError):
        curate.plan(source, policy, "v1", {"kept": 4})


def test_curation_settles_groups_before_the_policy(spark):
    """A false positive takes its group with it, a valid annotation comes first, and actions on dropped copies are errors."""
    schema = f"path string, sha256 string, identity string, compatible boolean, bboxes_body {boxes.DETECTIONS}, tags array<string>"
    d, bad = ([{"id": "1", "label": "x", "confidence": 1.0, "bounding_box": [0.0, 0.0, w, 1.0]}] for w in (1.0, 2.0))
    rows = [("a", "1", None, True, d, []), ("a2", "1", None, True, d, []), ("b", "2", "F1", True, bad, []), ("b2", "2", None, False, d, []), ("c", "3", None, True, d, []), ("c2", "3", "F2", True, d, []), ("e", "4", None, False, d, []), ("e2", "4", None, True, d, [])]
    source, said = spark.createDataFrame(rows, schema), "path string, action string, reason string, box array<double>"
    told = lambda policy: {r.path: (r.decision, r.reason, r.keep_path) for r in curate.decide(source, spark.createDataFrame(policy, said)).collect()}
    got = told([("a", "false_positive", None, None), ("c", "review", "blurred", None)])
    assert got["a"] == ("drop", "confirmed_false_positive", "a") and got["a2"] == ("drop", "exact_content_duplicate", "a")
    assert got["b"][0] == "drop" and got["b2"] == ("keep", None, "b2") and got["c"] == ("drop", "exact_content_duplicate", "c2") and got["e2"][0] == "keep"
    for path, action in (("c", "review"), ("a2", "false_positive"), ("b", "clip")):
        policy = spark.createDataFrame([(path, action, "r", [0.0, 0.0, 0.5, 0.5])], said)
        assert curate.action_errors(curate.decide(source, policy)).collect()[0][:] == (path, f"{action} was not applied")
        with pytest.raises(ValueError, match="actions"):
            curate.plan(source, policy, "v1")
    with pytest.raises(ValueError, match="annotations"):
        curate.plan(source.where("path = 'b'"), spark.createDataFrame([], said), "v1")
    with pytest.raises(ValueError, match="identities"):
        curate.plan(source.withColumn("identity", F.col("path")), spark.createDataFrame([], said), "v1")


def test_vectors(spark):
    ids = spark.range(200)
    made = vectors.random_units(ids, 8)
    assert made.where(F.abs(vectors.norm(F.col("embedding")) - 1) > 1e-5).count() == 0
    assert made.agg(F.abs(F.avg(F.get("embedding", F.lit(0))))).first()[0] < 0.1
    x = np.array([1.5, -2.0], "<f4")
    frame = spark.createDataFrame([(x.tolist(),), (None,)], "v array<float>")
    assert [r[0] for r in frame.select(vectors.checksum(F.col("v"))).collect()] == [hashlib.sha256(x.tobytes()).hexdigest(), None]
    records = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, embedding array<double>")
    assert vectors.population_errors(records, 1, spark.createDataFrame([(2,)], "id long")).count() == 0
    assert vectors.population_errors(records, 2, spark.createDataFrame([(1,)], "id long")).count() == 3


def test_masks(spark):
    from fieldbook.functions import masks

    mask = np.zeros((4, 8), np.uint8)
    mask[1:3, 2:6] = 1
    coded = masks.encode(mask)
    given = [coded, json.dumps({"$binary": {"base64": coded}}), json.dumps(mask.tolist()), "", None, "[]", "[[2]]", "junk"]
    got = [r[0] for r in spark.createDataFrame([(g,) for g in given], "m string").coalesce(1).select(masks.shape(F.col("m"))).collect()]
    assert [g.pixels for g in got] == [8, 8, 8, None, None, None, None, None]
    assert got[0].box == [0.25, 0.25, 0.5, 0.5]
    both = masks.union([(mask, [0, 0, 1, 1]), (np.ones((1, 1), np.uint8), [0.5, 0.5, 0.5, 0.5])], 4, 8)
    assert both.sum() == 8 + 8 - 2
    assert masks.composite(np.full((4, 8, 3), 9, np.uint8), mask).sum() == 8 * 27
    with pytest.raises(ValueError):
        masks.composite(mask, mask, "other")


def test_inference_collects_errors(spark):
    def load():
        def model(values):
            if any(v < 0 for v in values):
                raise RuntimeError("negative")
            return [[v, 1.0] for v in values]

        return model

    rows = spark.createDataFrame([(i, float(i) if i != 5 else -1.0) for i in range(9)] + [(9, None)], "id long, x double")
    from fieldbook.operators import inference

    got = {r.id: (r.embedding, r.error) for r in inference.infer(rows, load, "id", "x", 4).collect()}
    assert got[3] == ([3.0, 1.0], None) and got[5] == (None, "RuntimeError: negative") and got[9] == (None, "no payload")


def test_whole_runs(spark, tmp_path):
    from fieldbook.plans import ingest, snapshot

    folder = tmp_path / "sites/SITE 1/CAM A"
    folder.mkdir(parents=True)
    for name in ("test.mp4", "other.mp4"):
        (folder / name).write_bytes(b"x")
    (tmp_path / "labels.csv").write_text("CAMERA TRAP SITE;JAGUAR ID;CAM;Files Name\nSITE 1;F1;A;Test.MP4\nSITE 1;?;A;gone.jpg\n")
    report = ingest.ingest(spark, str(tmp_path / "sites"), str(tmp_path / "labels.csv"), str(tmp_path / "out"), dry_run=False)
    assert (report["rows"], report["cleaned"], report["outcomes"], report["unlabelled"]) == (2, 2, {"applied": 1, "unresolved": 1}, 1)
    rng = np.random.default_rng(0)
    d = [{"id": "1", "label": "x", "confidence": 1.0, "bounding_box": [0.0, 0.0, 0.5, 0.5]}]
    rows = [(i, d, [], i // 10, rng.normal(size=4).tolist()) for i in range(60)]
    samples = spark.createDataFrame(rows, f"sample_id long, detections {boxes.DETECTIONS}, tags array<string>, label int, vector array<double>")
    made = ingest.process(samples, ingest.Processing(similarity=0.95))
    assert made.count() == 60 and made.where("split IS NULL").count() == 0
    counts = ingest.export(made, str(tmp_path / "variants"))
    assert counts["master"] == 60 and counts["not_segmented"] == 0 and counts["segmented"] == 60
    assert ingest.evaluate(made, "train", 9).count() == 2
    records = spark.createDataFrame([("p", "F1", "h", "matched", False, "x")], "filepath string, resolved_identity string, sha256 string, lineage_status string, review_required boolean, latitude string")
    rows = snapshot.snapshot_rows(records)
    assert rows.columns == snapshot.schema().names and rows.first().latitude is None
    assert {r.error for r in snapshot.snapshot_errors(rows).collect()} == {"size_bytes is missing", "width is missing", "height is missing", "annotations are missing"}
    assert snapshot.metadata(rows, "jaguar_id") == {"n_samples": 1, "n_classes": 1, "splits": {}}


def test_lineage_of_exports(spark, tmp_path):
    """Ids under any of their names, other spellings of fields, absolute paths below and outside the export, nested and blank values."""
    samples = [
        {"_id": {"$oid": "a"}, "source-id": "b", "ID": "", "filepath": f"{tmp_path}/data/1.png", "Site": " north ", "SIGHTING_ID": "S1", "jaguar_id": "F1"},
        {"SAMPLE_ID": "c", "filepath": "/far/2.png", "camera": {"x": 1}, "site": ["no"], "camera trap site": "south", "Raw_File_Path": None},
        {"filepath": "data\\3.png", "source_media_path": "raw/3.AVI", "raw_data_path": "/base", "original_file_name": "three.png", "longitude": -1.5},
        {"filepath": " "},
    ]
    (tmp_path / "samples.json").write_text(json.dumps({"samples": samples}))
    got = {r.candidate_id: r for r in exports.export_candidates(exports.read_loose(spark, str(tmp_path)), str(tmp_path)).collect()}
    a, b, c, d = (got[f"export0-{i}"] for i in range(4))
    assert (a.source_ids, a.relative_path, a.source_path, a.site, a.sighting_id, a.identity) == (["a", "b"], "data/1.png", f"{tmp_path}/data/1.png", "north", "S1", "F1")
    assert (b.source_ids, b.relative_path, b.source_path, b.site, b.filename) == (["c"], None, "/far/2.png", "south", "2.png")
    assert (c.relative_path, c.source_path, c.filename, c.longitude, c.filenames) == ("data/3.png", "/base/raw/3.AVI", "three.png", "-1.5", ["three.png", "3.AVI", "3.png"])
    assert (d.relative_path, d.source_path, d.source_ids, d.filename) == (None, None, [], None)
    terminal = spark.createDataFrame([(1, None, None, "/base/raw/3.AVI", None, None), (2, "F1", "b", None, None, None)], TERMINAL)
    told = lineage.enrich(terminal, exports.load_candidates(spark, [str(tmp_path)], []), ["site", "longitude"]).collect()
    assert {(r.terminal_id, r.lineage_status, r.site, r.longitude) for r in told} == {(1, "matched", None, "-1.5"), (2, "matched", "north", None)}


def test_greedy_leaders_settle_in_rounds(spark, monkeypatch):
    """The rounds give what the loop gives, also over a chain."""
    monkeypatch.setattr(dedup, "SETTLED_AT_ONCE", 3)
    rng = np.random.default_rng(5)
    edges = {(i, i + 1) for i in range(12)} | {tuple(sorted(map(int, rng.choice(40, 2, replace=False)))) for _ in range(60)}
    want = {}
    for i in sorted({x for e in edges for x in e}):
        want[i] = not any(want.get(a, False) for a, b in edges if b == i)
    got = {r.id: r.leads for r in dedup._settle(spark.createDataFrame(sorted(edges), "a long, b long")).collect()}
    assert got == want


def test_large_labels_fill_several_blocks(spark):
    rng = np.random.default_rng(2)
    x, y = np.round(rng.normal(size=(150, 4)), 1), np.where(rng.random(150) < 0.6, 0, rng.integers(1, 9, 150))
    frame = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(150)], "id long, label int, vector array<double>")
    got = metrics.retrieval_metrics(frame, block=20).first()
    mean, balanced, cmc = brute_metrics(x, y)
    assert (got.map, got.identity_balanced_map, got.cmc_1, got.cmc_5) == pytest.approx((mean, balanced, cmc[1], cmc[5]))


def test_process_samples_frames_and_embeds(spark):
    from fieldbook.plans import ingest

    samples = spark.createDataFrame([("a", "x.jpg", [], "F1", [1.0, 0.0]), ("b", "y.jpg", [], "F1", None)], "sample_id string, filepath string, tags array<string>, label string, vector array<double>").withColumn("detections", F.lit(None).cast(boxes.DETECTIONS))
    videos = spark.createDataFrame([(7, "v.mp4", 10.0, 10, "F2")], "sample_id long, filepath string, fps double, frame_count int, label string")

    def load():
        return lambda paths: [[0.0, 1.0] if p.startswith("frames") else [1.0, 0.01] for p in paths]

    got = {r.sample_id: r for r in ingest.process(samples, ingest.Processing(similarity=0.9), videos, load).collect()}
    assert set(got) == {"a", "b", "7-0", "7-5"}
    assert (got["b"].is_duplicate, got["b"].duplicate_of) == (True, "a") and got["7-5"].duplicate_of == "7-0" and not got["a"].is_duplicate


def test_curated_exports_guard_their_source(spark, tmp_path):
    d = [{"id": "1", "label": "x", "confidence": 1.0, "bounding_box": [0.0, 0.0, 1.0, 1.0]}]
    schema = f"path string, sha256 string, identity string, compatible boolean, bboxes_body {boxes.DETECTIONS}, tags array<string>"
    source = spark.createDataFrame([("a", "1", "F11", True, d, []), ("b", "1", "F11", True, d, []), ("c", "2", None, True, d, [])], schema)
    policy = spark.createDataFrame([], "path string, action string, reason string, box array<double>")
    decisions, made = curate.plan(source, policy, "v1")
    told = publish.curated_export(decisions, made, str(tmp_path / "t"), "v1", lambda: "h")
    assert told["kept"] == 2
    first = publish.current(spark, str(tmp_path / "t"))
    assert json.loads(publish.read_text(spark, f"{first}/metadata.json")) == {"samples": 2, "source_sha256": "h", "version": "v1"}
    changing = iter("xy")
    with pytest.raises(RuntimeError):
        publish.curated_export(decisions, made, str(tmp_path / "t"), "v2", lambda: next(changing))
    assert publish.current(spark, str(tmp_path / "t")) == first


def test_records(spark):
    from fieldbook.operators import records

    raw, made = spark.createDataFrame([("a",), ("b",), ("b",)], "path string"), spark.createDataFrame([("a",), ("b",), ("c",)], "path string")
    assert {(r.path, r.error) for r in records.one_to_one_errors(raw, made).collect()} == {("b", "not unique"), ("c", "not in the source")}
    assert value(spark, records.media_path(F.col("p"), "/root/x"), p="../etc") is None
    assert value(spark, records.media_path(F.col("p"), "/root/x"), p="a/../b") == "/root/x/b"
    listing = spark.createDataFrame([("sites/SITE 1/CAM A/T.mp4",)], "path string")
    rows = spark.createDataFrame([("t.MP4", "SITE 9", "CAM A"), ("t.avi", None, None), ("n.jpg", "SITE 2", "CAM B"), ("n.mp4", "SITE 2", "CAM B"), ("m.jpg", None, None)], "file string, site string, cam string")
    got = {r.file: r.expected_path for r in records.expected_path(rows, listing, "file", "site", "cam").collect()}
    assert got == {"t.MP4": "sites/SITE 1/CAM A/T.mp4", "t.avi": "sites/SITE 1/CAM A/T.mp4", "n.jpg": "sites/SITE 2/ID PHOTOS/n.jpg", "n.mp4": "sites/SITE 2/CAM B/n.mp4", "m.jpg": None}


def test_without_the_training_data_subpackage(tmp_path):
    """The entry module and its queries load where the llm folder and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "fieldbook", tmp_path / "fieldbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    run = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert run.returncode == 0, run.stderr
