"""Operators beyond the registered queries: files, images, archives, regions, matching, log, stream, inference."""

import io
import json
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import evaluation, financial, matching, regions
from tallyforge.operators.tracking import RunLog, runs
from tallyforge.plans import inference
from tallyforge.sources import files, images
from tallyforge.streaming import receipts


def png(w, h):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IEND", b"")


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(4, 3))
    (tmp_path / "b.PNG").write_bytes(png(4, 3))
    (tmp_path / "c.jpg").write_bytes(b"broken")
    (tmp_path / "e.txt").write_bytes(b"text")
    found = files.scan_images(spark, str(tmp_path)).select("path", "length", "content")
    found = found.unionAll(spark.createDataFrame([("/x/d.bmp", 0, bytearray(b""))], found.schema))
    rows = {r["path"][-5:]: r for r in images.validate(found).collect()}
    assert set(rows) == {"a.png", "b.PNG", "c.jpg", "d.bmp"}
    assert rows["a.png"]["valid"] and rows["a.png"]["width"] == 4 and rows["b.PNG"]["is_duplicate"]
    assert rows["c.jpg"]["errors"] == ["corrupt_image"] and rows["d.bmp"]["errors"] == ["empty_file"]
    stats = images.statistics(images.validate(found))
    assert stats.first()["valid"] == 2
    with pytest.raises(ValueError):
        images.quality_gate(stats)
    done = {r["path"][-5:]: r for r in images.preprocess(found, {"grow": lambda b: (b + b"x", {}), "check": lambda b: (b[10:] and b, {})}).collect()}
    assert done["a.png"]["status"] == "success"
    assert images.resized(200, 100, 50) == (50, 25) and images.resized(20, 10, 50) == (20, 10)
    assert images.order_points([(9, 9), (0, 0), (9, 0), (0, 9)]) == [(0, 0), (9, 0), (9, 9), (0, 9)]


def test_unzip(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("in/a.txt", "hello")
        z.writestr("../evil.txt", "bad")
    df = spark.createDataFrame([("x.zip", bytearray(buf.getvalue())), ("y.zip", bytearray(b"no"))], "path string, content binary")
    rows = {(r["path"], r["member"]): r for r in files.unzip(df).collect()}
    assert bytes(rows["x.zip", "in/a.txt"]["content"]) == b"hello"
    assert rows["x.zip", "../evil.txt"]["error"] == "unsafe_member" and rows["x.zip", "../evil.txt"]["content"] is None
    assert rows["y.zip", None]["error"] == "BadZipFile"


def test_json_documents(spark, tmp_path):
    good = {"store_name": "A", "date": "2024-01-05", "items": [], "total_amount": "Rs 1,200.50", "overall_confidence": 0.9, "reliability": "high", "review_required": False, "metadata": {"receipt_id": "r1"}, "_validation": {"status": "passed"}}
    for name, doc in {"a": good, "b": good | {"metadata": {"receipt_id": "r2"}, "total_amount": True}, "c": {"store_name": "C"}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
    (tmp_path / "d.json").write_text("[1, 2")
    (tmp_path / "manifest.json").write_text("{}")
    docs = files.scan_documents(spark, str(tmp_path), ["manifest.json"])
    assert docs.where("load_failed").count() == 1
    rows = {r["receipt_id"]: r for r in financial.decided(files.financial_input(docs)).collect()}
    assert rows["r1"]["included"] and float(rows["r1"]["total"]) == 1200.5
    assert "schema_invalid" in rows["r2"]["errors"] and not rows["r2"]["included"]
    assert rows["c"]["primary_reason"] == "validation_status_missing" and "missing_required_field:date" in rows["c"]["errors"]
    permissive = files.scan_json(spark, str(tmp_path), spark.createDataFrame([], "store_name string").schema, ["manifest.json"])
    got = {(r["store_name"], r["_corrupt"]) for r in permissive.collect()}
    assert {n for n, c in got if c is None} == {"A", "C"} and {c for n, c in got if n is None} == {"[1, 2"}
    rows = spark.createDataFrame([(1, '{"store_name": "A"}'), (2, "[1]"), (3, "broken {"), (4, None), (5, '{"store_name": 3}')], "id int, raw string")
    got = {r["id"]: (r["store_name"], r["_corrupt"]) for r in files.parsed(rows, "raw", spark.createDataFrame([], "store_name string").schema).collect()}
    assert got == {1: ("A", None), 2: (None, "[1]"), 3: (None, "broken {"), 4: (None, None), 5: ("3", None)}


def test_region_shapes(spark):
    box = "[[0,0],[4,0],[4,2],[0,2]]"
    raws = [(1, f'{{"dt_polys": [{box}], "rec_texts": ["TEA 5.00", "x"], "rec_scores": [0.9]}}'), (2, f'{{"ocr": [{{"text": "A", "confidence": 0.8, "bbox": {box}}}]}}'), (3, f'[[{box}, ["B", 0.7]]]'), (4, "broken")]
    df = spark.createDataFrame(raws, "receipt_id int, raw string").withColumn("regions", regions.from_json(F.col("raw")))
    got = {r["receipt_id"]: r["regions"] for r in df.collect()}
    assert [x["text"] for x in got[1]] == ["TEA 5.00", "x"] and got[1][1]["confidence"] == 0.0
    assert got[2][0]["text"] == "A" and got[3][0]["text"] == "B" and got[4] is None
    res = {r["receipt_id"]: r for r in regions.results(df).collect()}
    assert res[1]["text_region_count"] == 1 and res[4]["status"] == "failed"
    clean = {r["receipt_id"]: r for r in regions.cleaned(regions.results(df)).collect()}
    assert clean[1]["cleaned_full_text"] == "TEA 5.00" and clean[4]["status"] == "failed"


def brute(w):
    from itertools import permutations

    n, m = len(w), len(w[0])
    if n > m:
        return brute([list(c) for c in zip(*w)])
    return max(sum(w[i][p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_assignment_is_optimal():
    rng = random.Random(1)
    for _ in range(60):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        w = [[rng.choice((0.0, round(rng.random(), 2))) for _ in range(m)] for _ in range(n)]
        pairs = matching.assign(w)
        assert len({i for i, _ in pairs}) == len(pairs) == len({j for _, j in pairs})
        assert sum(w[i][j] for i, j in pairs) == pytest.approx(brute(w))
    assert matching.assign([]) == []
    assert matching.greedy([(0.9, 0, 0), (0.95, 0, 1), (0.8, 1, 1)]) == [(0, 1)]


def test_contested_items_against_exhaustive_search(spark):
    """Receipts of items that claim each other: matched pairs weigh as much as any assignment can, and the greedy order often less."""
    rng = random.Random(8)
    names = ["abcdefghij", "abcdefghix", "abcdefghxy", "abcdefgxij", "abcdexghij", "zbcdefghij", "", "Straße 1234", "STRASSE 1234"]
    pred = [(r, i, rng.choice(names), 1.0) for r in range(120) for i in range(rng.randint(1, 5))]
    truth = [(r, i, rng.choice(names), rng.choice((1.0, 1.0, None))) for r in range(120) for i in range(rng.randint(1, 5))]
    schema = "receipt_id int, pos int, name string, price double"
    pairs = matching.candidate_pairs(spark.createDataFrame(pred, schema), spark.createDataFrame(truth, schema)).cache()
    weight = {(r["receipt_id"], r["pred_pos"], r["truth_pos"]): r["similarity"] + 0.01 for r in pairs.collect()}
    assert not any(n == "" for r, i, n, _ in pred for k in weight if k[:2] == (r, i))
    assert any("Straße 1234" in (p[2], t[2]) and p[2] != t[2] for p in pred for t in truth if (p[0], p[1], t[1]) in weight and p[0] == t[0])
    totals = {}
    for method in ("optimal", "greedy"):
        got = [tuple(r) for r in matching.matches(pairs, method=method).collect()]
        assert all(g in weight for g in got) and len({g[:2] for g in got}) == len(got) == len({(g[0], g[2]) for g in got})
        totals[method] = {r: sum(weight[g] for g in got if g[0] == r) for r in range(120)}
    for r in range(120):
        w = [[weight.get((r, i, j), 0.0) for j in range(5)] for i in range(5)]
        assert totals["optimal"][r] == pytest.approx(brute(w))
    assert sum(totals["optimal"][r] > totals["greedy"][r] + 1e-9 for r in range(120)) >= 3


def test_hot_keys_meet_salted(spark):
    """A key with a third of all rows, a null key and plain ones: every row keeps its values and gets the right flag."""
    from tallyforge.operators import dedup

    rows = [("hot" if i % 3 == 0 else None if i % 3 == 1 and i < 200 else f"k{i % 400}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "key string, n int")
    count = {k: sum(x == k for x, _ in rows) for k in {k for k, _ in rows}}
    got = dedup.flag_repeats(df, "key")
    assert got.columns == ["key", "n", "duplicate"]
    assert sorted((r["n"], r["key"], r["duplicate"]) for r in got.collect() if r["key"]) == sorted((n, k, count[k] > 1) for k, n in rows if k)
    assert {(r["n"], r["duplicate"]) for r in got.collect() if r["key"] is None} == {(n, True) for k, n in rows if k is None}
    copies = {r["n"]: (r["first"], r["is_duplicate"]) for r in dedup.first_with_hash(df, "key", "n").collect()}
    least = {k: min(n for x, n in rows if x == k) for k in count}
    assert copies == {n: (least[k], n != least[k]) for k, n in rows}
    assert dedup.flag_repeats(df.limit(0), "key").count() == 0 and dedup.first_with_hash(df.limit(0), "key", "n").count() == 0


def test_ranks_are_those_of_a_sort(spark):
    rng = random.Random(2)
    rows = [(f"K{i}", rng.choice(("A", "b", None, "C")), round(rng.choice((5.0, 7.5, rng.random() * 100)), 2)) for i in range(500)]
    df = spark.createDataFrame(rows, "store_key string, store_name string, spend double").withColumn("spend", F.col("spend").cast("decimal(18,2)"))
    got = {r["store_key"]: r["rank"] for r in financial.ranked(df).collect()}
    order = sorted(rows, key=lambda r: (-r[2], r[1] is not None, (r[1] or "").lower(), r[0]))
    assert got == {r[0]: i for i, r in enumerate(order, 1)}
    assert financial.ranked(df.limit(0)).count() == 0 and [r["rank"] for r in financial.ranked(df.limit(1)).collect()] == [1]


def test_calibration_error_is_not_rounded_before_the_sum(spark):
    rows = [(0.10004 + 0.000001 * i, i % 7 == 0) for i in range(3000)] + [(0.9, True), (None, True), (0.5, None)]
    df = spark.createDataFrame(rows, "confidence double, correct boolean")
    got = evaluation.calibration_error(df).first()
    low = [(c, bool(y)) for c, y in rows[:3000]]
    want = (3000 * abs(sum(c for c, _ in low) / 3000 - sum(y for _, y in low) / 3000) + abs(0.9 - 1)) / 3001
    assert got["receipts"] == 3001 and got["expected_calibration_error"] == round(want, 4)
    means = {r["metric"]: r for r in evaluation.receipt_means(spark.createDataFrame([(1.0, None), (0.5, None), (0.25, None)], "f1 double, cer double"), ["f1", "cer"]).collect()}
    assert (means["f1"]["receipts"], means["f1"]["median"], means["cer"]["receipts"], means["cer"]["mean"]) == (3, 0.5, 0, None)


def test_matches_mixed(spark):
    rows = [(1, 0, 0, 0.9), (1, 0, 1, 0.95), (1, 1, 1, 0.9), (2, 0, 0, 0.8), (3, 5, 6, 1.0)]
    pairs = spark.createDataFrame(rows, "receipt_id int, pred_pos int, truth_pos int, similarity double")
    assert {tuple(r) for r in matching.matches(pairs).collect()} == {(1, 0, 0), (1, 1, 1), (2, 0, 0), (3, 5, 6)}
    assert matching.matches(pairs.limit(0)).count() == 0


def test_tri_state(spark):
    p = spark.createDataFrame([(1, "A", "2024-01-01", "5"), (2, None, None, None), (4, "x", None, "1"), (4, "y", None, "1")], "receipt_id int, store_name string, date string, total_amount string")
    t = spark.createDataFrame([(1, " a ", "01/01/2024", "5.005"), (2, "B", None, "2"), (3, "C", None, None)], "receipt_id int, store_name string, date string, total_amount string")
    rows = {r["receipt_id"]: r for r in evaluation.fields(evaluation.align(p, t)).collect()}
    assert rows[1]["required_fields_all_correct"] is True
    assert rows[2]["store_correct"] is False and rows[2]["date_correct"] is None and rows[2]["required_fields_all_correct"] is None
    assert rows[3]["prediction_status"] == "missing" and rows[3]["store_correct"] is False
    assert rows[4]["prediction_status"] == "duplicate" and rows[4]["store_correct"] is None


def test_run_log(spark, tmp_path):
    with RunLog(spark, str(tmp_path / "log"), "first") as log:
        log.log_params({"depth": 3, "api_token": "abc", "nested": {"db": [{"Access-Key": "x", "n": float("nan")}], "k": (1, 2)}})
        log.log_metrics({"f1": 0.5, "bad": float("nan")})
    with pytest.raises(RuntimeError), RunLog(spark, str(tmp_path / "log"), "second"):
        raise RuntimeError
    rows = runs(spark, str(tmp_path / "log")).collect()
    assert sorted(r["status"] for r in rows) == ["failed", "success"]
    first = next(r for r in rows if r["status"] == "success")
    assert json.loads(first["params"].pop("nested")) == {"db": [{"Access-Key": "***", "n": None}], "k": [1, 2]}
    assert first["params"] == {"depth": "3", "api_token": "***"} and first["metrics"] == {"f1": 0.5}


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "ts": "2024-01-01T00:00:00"}\n{"id": "1", "ts": "2024-01-01T00:01:00"}\n{"id": "2", "ts": "2024-01-01T00:02:00"}\n')
    stream = receipts.documents(spark, str(tmp_path / "in"), "id string, ts timestamp")
    q = receipts.run_available(receipts.keep_first(stream, "id", "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1.5), ("r2", None)], "receipt_id string, total double")
    files.write_csv(df, str(tmp_path / "csv"), single=True)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    files.write_json(df, str(tmp_path / "json"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_json(df, str(tmp_path / "json"), overwrite=False)
    files.write_documents(df, str(tmp_path / "docs"), buckets=4)
    assert spark.read.json(str(tmp_path / "docs")).count() == 2


def test_inference(spark):
    lines = ["STORE: Corner Shop", "DATE 05/01/2024", "TEA 2x10.00", "TOTAL 10.00"]
    out = inference.predict_one(spark, "r1", [{"text": t, "confidence": 0.95, "bbox": [[0, 30 * i], [9, 30 * i], [9, 30 * i + 9], [0, 30 * i + 9]]} for i, t in enumerate(lines)])
    assert out["status"] == "success" and out["prediction"]["total_amount"] == 10.0
    assert out["prediction"]["items"][0]["name"] == "TEA"
    empty = inference.predict_one(spark, "r2", [])
    assert empty["review_required"]


@pytest.mark.parametrize("name", ["a.jpg", "a.JPEG", "a.png", "a.bmp", "a.tif", "a.tiff", "a.webp"])
def test_upload_accepted(name):
    inference.check_upload(name, b"x")


@pytest.mark.parametrize(("name", "body"), [("malware.exe", b"x"), ("a.pdf", b"x"), ("a.txt", b"x"), ("a.csv", b"x"), ("a.zip", b"x"), ("noending", b"x"), ("receipt.jpg", b"")])
def test_upload_rejected(name, body):
    with pytest.raises(ValueError):
        inference.check_upload(name, body)


def test_documents_from_lines(spark):
    from tallyforge.plans.inference import from_lines

    rows = [("a", "2.json", ["Later Shop", "TOTAL 2.00"]), ("a", "1.json", ["Corner Shop", "DATE 05/01/2024", "TEA 3.50", "TOTAL", "3.50"]), (None, None, ["Other Shop", "TOTAL 1.00"])]
    got = {r["receipt_id"]: r for r in from_lines(spark.createDataFrame(rows, "receipt_id string, source_file string, lines array<string>")).collect()}
    assert len(got) == 2 and got["a"]["store_name"] == "Corner Shop" and got["a"]["metadata"]["item_sum"] == 3.5
    assert got["a"]["fields"]["total_amount"]["evidence"] == "global_partial_match"
    assert got[None]["store_name"] == "Other Shop" and got[None]["_validation"]["errors"] == ["receipt_id_missing"]
