"""Literal cases of ranges, extraction, jobs, sources and user functions."""

import json
import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import ranges
from quire.functions.ranges import lenient_pages, strict_pages
from quire.functions.ranking import number_rows, page_block
from quire.operators import aggregates, extraction, joins, selection, transitions, userfuncs, windows
from quire.sources.lines import batch_result_lines, map_provider_page, parse_api_log, write_request_lines
from quire.sources.tables import page_metadata_scan
from quire.sources.uploads import ingest_files, validate_uploads
from quire.templates import TEMPLATES, template_catalogue, template_schema


@pytest.mark.parametrize(
    ("spec", "total", "pages"),
    [
        ("2, 4-5", 5, [2, 4, 5]), ("1, nope", 5, None), ("5-3", 5, [3, 4, 5]), ("", 2, [1, 2]), (" * ", 2, [1, 2]),
        ("ALL", 2, [1, 2]), ("1,,2", 5, None), ("0", 5, None), ("4-6", 5, None), ("9" * 30, 5, None), ("1 - 2", 5, [1, 2]),
        ("+1", 5, None), (None, 2, [1, 2]),
    ],
)
def test_strict_ranges(spark, spec, total, pages):
    row = spark.createDataFrame([(spec, total)], "spec string, total int")
    assert row.select(strict_pages(F.col("spec"), F.col("total")).alias("p")).first()["p"] == pages
    if spec is not None:
        userfuncs.register_page_range(spark)
        rows = spark.sql("SELECT p.page_number FROM {r} r, LATERAL page_range(r.spec, r.total) p", r=row).collect()
        assert [r[0] for r in rows] == (pages or [])


@pytest.mark.parametrize(
    ("spec", "total", "pages"),
    [
        ("1-3,5,10-12", None, [1, 2, 3, 5, 10, 11, 12]), ("all", 4, [1, 2, 3, 4]), ("0, -1, 2-1, 100", 5, [1, 2]),
        ("nope", 5, None), ("", 5, None), ("3-" + "9" * 30, 5, [3, 4, 5]), ("0-2", 5, [1, 2]), ("9" * 30, 5, None),
    ],
)
def test_lenient_ranges(spark, spec, total, pages):
    row = spark.createDataFrame([(spec, total)], "spec string, total int")
    assert row.select(lenient_pages(F.col("spec"), F.col("total")).alias("p")).first()["p"] == pages


def test_numbering_matches_sorting_under_skew(spark):
    rng = random.Random(1)
    rows = list({(rng.choice(["hot"] * 8 + ["a", "b"]), rng.randint(-500, 30000)) for _ in range(3000)})
    df = spark.createDataFrame(rows, "k string, page int")
    for newest in (False, True):
        order = F.desc("page") if newest else F.asc("page")
        got = number_rows(df, ["k"], page_block(F.col("page"), 64), [order], "n", newest_first=newest).collect()
        groups = defaultdict(list)
        for k, page in rows:
            groups[k].append(page)
        want = {(k, p): i for k, ps in groups.items() for i, p in enumerate(sorted(ps, reverse=newest), 1)}
        assert {(r["k"], r["page"]): r["n"] for r in got} == want


def test_numbering_keeps_null_keys_and_buckets(spark):
    rows = [(None, 5), (None, None), ("a", None), ("a", 3), ("a", 4000)]
    df = spark.createDataFrame(rows, "k string, page int")
    got = number_rows(df, ["k"], page_block(F.col("page"), 64), [F.asc("page")], "n").collect()
    assert {(r["k"], r["page"]): r["n"] for r in got} == {
        (None, None): 1, (None, 5): 2, ("a", None): 1, ("a", 3): 2, ("a", 4000): 3
    }


def test_ewma_matches_the_fold(spark):
    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else "cold", i, rng.choice([0.0, -1.0, 1.5, 2.5, 9.0])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at int, v double")
    got = aggregates.latency_ewma(df, "k", "v", page_block(F.col("at"), 16), [F.desc("at")]).collect()
    for row in got:
        state = None
        for k, _, v in rows:
            if k == row["k"] and v > 0:
                state = v if state is None else state * 0.8 + v * 0.2
        assert row["ewma"] == pytest.approx(state)


def test_page_lists_in_blocks(spark):
    rows = [(1, p, ("approved", "needs_review", "unreviewed")[p % 3]) for p in range(1, 11)]
    pages = spark.createDataFrame(rows, "document_id int, page_number int, review_status string")
    got = aggregates.document_page_lists(pages, block=4).orderBy("block").collect()
    assert [p for r in got for p in r["completed_pages"]] == list(range(1, 11))
    assert [p for r in got for p in r["approved_pages"]] == [3, 6, 9]
    assert max(len(r["completed_pages"]) for r in got) == 4


RECEIPT = {
    "merchant_name": "Corner Shop", "currency": "MYR", "total_amount": 10.6, "payment_method": " ",
    "purchased_items": [{"description": "Tea", "quantity": 2, "unit_price": "5.3", "amount": 10.6}],
    "review_notes": ["Check", "check", ""], "unknown": 1,
}


def normalized(spark, template, *payloads):
    rows = [(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "id int, annotation string")
    parsed = extraction.parse_annotation(df)
    return extraction.normalize_extraction(parsed, template).select("id", "data", "error").orderBy("id")


def test_receipt_normalises_and_exports(spark):
    done = normalized(spark, "receipt", RECEIPT)
    row = done.first()
    assert row["error"] is None
    data = row["data"].asDict(recursive=True)
    assert data["document_type"] == "receipt" and data["total_amount"] == 10.6 and data["payment_method"] is None
    assert data["purchased_items"] == [{"description": "Tea", "quantity": 2.0, "unit_price": 5.3, "amount": 10.6}]
    assert data["review_notes"] == ["Check"]
    lines = [r["line"] for r in extraction.extraction_csv_rows(done.select("id", "data"), "receipt").orderBy("seq").collect()]
    assert lines[:2] == ["field,value", "Merchant,Corner Shop"]
    assert "Total,10.6" in lines and lines[-1] == "Tea,2.0,5.3,10.6" and lines[-3] == "Purchased items"


def test_quotation_keeps_codes_and_amounts(spark):
    quote = {"quotation_number": "Q-1042", "quoted_items": [{"item_code": "0042", "amount": 216}]}
    data = normalized(spark, "quotation", quote).first()["data"]
    assert (data["quotation_number"], data["quoted_items"][0]["item_code"], data["quoted_items"][0]["amount"]) == ("Q-1042", "0042", 216.0)


def test_resume_lists(spark):
    data = normalized(spark, "resume", {"skills": ["Python", "python", "", "SQL"], "languages": None}).first()["data"]
    assert data["skills"] == ["Python", "SQL"] and data["languages"] == [] and data["experience"] == []


def test_extraction_errors(spark):
    cases = [
        ([1], "invalid structured extraction"), ("", "no structured extraction"), (None, "no structured extraction"), ("{", "not valid JSON"),
        ({"total_amount": True}, "Amounts must be numbers"), ({"total_amount": "x"}, "Amounts must be numbers"),
        ({"total_amount": {"a": 1}}, "Amounts must be numbers"),
        ({"total_amount": 1e12}, "Amount is outside the supported range"), ({"total_amount": "NaN"}, "Amount is outside the supported range"),
        ({"purchased_items": "x"}, "Repeated fields must be lists"), ({"purchased_items": "[1]"}, "Repeated fields must be lists"),
        ({"review_notes": {"a": 1}}, "Repeated fields must be lists"), ({"purchased_items": [5]}, "Structured sections must be objects"),
        ({"purchased_items": ["{}"]}, "Structured sections must be objects"), ({"purchased_items": [{"amount": False}]}, "Amounts must be numbers"),
        ({"total_amount": ""}, None), ({"total_amount": None}, None), ({"purchased_items": [None]}, None), ({}, None),
    ]
    rows = normalized(spark, "receipt", *[c[0] for c in cases]).collect()
    assert [r["error"] for r in rows] == [c[1] for c in cases]
    assert all((r["data"] is None) == (r["error"] is not None) for r in rows)
    assert rows[-2]["data"]["purchased_items"] == [None]


def test_long_lists_and_texts_stay_whole(spark):
    data = normalized(spark, "receipt", {"merchant_name": "x" * 5000, "purchased_items": [{"amount": i} for i in range(600)]}).first()["data"]
    assert len(data["merchant_name"]) == 5000 and len(data["purchased_items"]) == 600


def test_amounts_by_form(spark):
    for text, amount in (("5d", None), ("7f", None), ("NaN", None), ("0x1", None), (" 1e2 ", 100.0), ("-.5", -0.5), ("3.", 3.0)):
        row = normalized(spark, "receipt", {"total_amount": text}).first()
        assert (row["data"] and row["data"]["total_amount"]) == amount and (row["error"] is None) == (amount is not None)


def test_log_lines_with_repeated_keys_and_many_pairs(spark):
    many = " ".join(f"k{i}=v{i}" for i in range(50_000))
    lines = [("[2026-08-14 10:00:00] a | x=1 y=a=b x=2",), (f"[2026-08-14 10:00:00] b | {many}",), ("[2026-08-14 10:00:00] c | name=my report pages=3",)]
    got = {r.event: r for r in parse_api_log(spark.createDataFrame(lines, "value string")).collect()}
    assert got["a"].extra == {"x": "2", "y": "a=b"} and len(got["b"].extra) == 50_000
    assert got["c"].extra is None and got["c"].detail == "name=my report pages=3"


def test_number_text(spark):
    values = [10.6, 216.0, 0.0, -3.25, 123456789.125, 1e-05, 1.5e-05, 999999999999.0, 0.0001]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", extraction.number_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in rows] == [repr(v) for v in values]


def test_csv_quoting(spark):
    rows = spark.createDataFrame([('a"b',), ("x,y",), (None,), ("plain",)], "v string")
    assert [r[0] for r in rows.select(extraction.csv_cell(F.col("v"))).collect()] == ['"a""b"', '"x,y"', "", "plain"]


def test_templates(spark):
    counts = {t.id: (len(t.scalars), [len(g.fields) for g in t.tables]) for t in TEMPLATES.values()}
    assert counts == {"invoice": (13, [5]), "receipt": (11, [4]), "quotation": (18, [8]), "resume": (9, [6, 5, 3, 3, 3, 2])}
    assert template_schema("invoice")["line_items"].dataType.elementType["amount"].dataType.simpleString() == "double"
    assert template_catalogue(spark).where("template = 'resume' and group_kind = 'list'").count() == 2


def test_claims_and_releases(spark):
    claims = spark.createDataFrame([(1, 1, "a", 5), (1, 1, "b", 4), (1, 2, "a", 6)], "document_id int, page_number int, owner_token string, at int")
    keys = ["document_id", "page_number"]
    won = {(r["document_id"], r["page_number"], r["owner_token"]): r["outcome"] for r in windows.resolve_claims(claims, keys, ["at", "owner_token"]).collect()}
    assert won == {(1, 1, "a"): "duplicate_claim", (1, 1, "b"): "won", (1, 2, "a"): "won"}
    left = windows.release_claims(claims, claims.where("owner_token = 'b'"), keys)
    assert left.count() == 2


def test_edit_of_approved_page_resets_review(spark):
    schema = "document_id int, page_number int, source_markdown string, markdown string, preprocessing_json string, confidence_score double"
    old = spark.createDataFrame([(1, 1, "src", "text", "{}", 0.9, "approved", "t")], schema + ", review_status string, reviewed_at string")
    edit = spark.createDataFrame([(1, 1, None, "edited", None, None)], schema)
    row = transitions.upsert_pages(old, edit).first()
    assert (row["source_markdown"], row["markdown"], row["preprocessing_json"], row["confidence_score"]) == ("src", "edited", "{}", 0.9)
    assert (row["review_status"], row["reviewed_at"]) == ("unreviewed", None)
    ocr = spark.createDataFrame([(1, 1, "new", " \n", None, None)], schema)
    row = transitions.upsert_pages(old, ocr).first()
    assert (row["source_markdown"], row["preprocessing_json"], row["confidence_score"], row["review_status"]) == ("new", None, None, "needs_review")


def test_error_order(spark):
    cases = [(429, "", "rate_limited"), (500, "rate limit hit", "rate_limited"), (503, "timeout", "upstream_503"),
             (404, "connection reset", "transient_network"), (404, "no", "request_404"), (None, "odd", "ocr_error"), (None, None, "ocr_error")]
    df = spark.createDataFrame([(i, c, m) for i, (c, m, _) in enumerate(cases)], "i int, status_code int, error string")
    rows = transitions.classify_errors(df).orderBy("i").collect()
    assert [r["error_code"] for r in rows] == [c[2] for c in cases]
    assert [r["retryable"] for r in rows] == [True, True, True, True, False, False, False]


def test_cancelled_pages_do_not_fail_a_job_but_are_retried(spark):
    pages = spark.createDataFrame([(1, 1, "completed"), (1, 2, "cancelled"), (2, 1, "running"), (3, 1, "failed")], "job_id int, page_number int, status string")
    done = {r["job_id"]: (r["status"], r["error"]) for r in aggregates.finalize_jobs(pages).collect()}
    assert done == {1: ("completed", None), 3: ("failed", "1 page(s) failed")}
    jobs = spark.createDataFrame([(1, "completed"), (2, "running"), (3, "failed")], "job_id int, status string")
    assert {(r[0], r[1]) for r in transitions.retry_failed(jobs, pages).collect()} == {(1, 2), (3, 1)}


def test_out_of_order_batch_lines(spark, tmp_path):
    ok = lambda i, md, score: json.dumps({"custom_id": i, "response": {"status_code": 200, "body": {"pages": [
        {"markdown": md, "images": [{"id": "a", "image_base64": "x"}, {"id": "b"}], "confidence_scores": {"average_page_confidence_score": score}}]}}})
    output = [ok("2", "two", 1.4), "", ok("1", "one", "abc"), json.dumps({"custom_id": "3", "response": {"status_code": 500, "body": {"m": "x" * 600}}}),
              json.dumps({"custom_id": "5", "response": {"status_code": 404}}), json.dumps({"custom_id": "6", "response": {"status_code": 200, "body": {"pages": []}}})]
    (tmp_path / "out.jsonl").write_text("\n".join(output))
    (tmp_path / "err.jsonl").write_text(json.dumps({"custom_id": "4", "error": "bad"}) + "\n")
    rows = batch_result_lines(spark, str(tmp_path / "out.jsonl"), str(tmp_path / "err.jsonl"))
    got = {r["custom_id"]: r for r in map_provider_page(rows).collect()}
    assert (got["1"]["markdown"], got["2"]["markdown"], got["2"]["confidence"], got["1"]["confidence"]) == ("one", "two", 1.0, None)
    assert [i["id"] for i in got["1"]["images"]] == ["a"]
    assert got["3"]["error"].startswith("{\"m\"") and len(got["3"]["error"]) == 608
    assert (got["4"]["error"], got["5"]["error"], got["6"]["markdown"], got["6"]["error"]) == ("bad", "HTTP 404", "", None)


def test_request_lines_are_written(spark, tmp_path):
    lines = spark.createDataFrame([("1", '{"a":1}')], "custom_id string, value string")
    write_request_lines(lines, str(tmp_path / "req"))
    assert spark.read.text(str(tmp_path / "req")).first()["value"] == '{"a":1}'


def test_log_line(spark):
    lines = spark.createDataFrame([("[2026-08-14 10:00:00] ocr.process:ok | pages=3 type=pdf",), ("noise",), ("[2026-08-14 10:00:00] x | why | a=b",)], "value string")
    rows = parse_api_log(lines).collect()
    assert len(rows) == 2
    assert (rows[0]["event"], rows[0]["detail"], rows[0]["extra"]) == ("ocr.process:ok", None, {"pages": "3", "type": "pdf"})
    assert (rows[1]["detail"], rows[1]["extra"]) == ("why", {"a": "b"})


def png(gray: np.ndarray) -> bytes:
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    height, width = gray.shape
    raw = b"".join(b"\0" + row.tobytes() for row in gray.astype(np.uint8))
    header = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture
def uploads(tmp_path):
    rng = np.random.default_rng(3)
    white = png(np.full((600, 420), 255))
    files = {"white.png": white, "copy.png": white, "large.png": png(np.full((2000, 1600), 255)),
             "noise.png": png(rng.integers(0, 256, (300, 300))), "doc.pdf": b"%PDF-1.7 stub", "fake.png": b"just text", "empty.png": b"", "notes.txt": b"x"}
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_uploads_are_scanned_and_judged(spark, uploads):
    files = ingest_files(spark, str(uploads))
    rows = {r["name"]: r for r in files.collect()}
    assert set(rows) == {"white.png", "copy.png", "large.png", "noise.png", "doc.pdf", "fake.png"}
    assert rows["white.png"]["sha256"] == rows["copy.png"]["sha256"] and rows["doc.pdf"]["is_pdf"]
    judged = {r["name"]: (r["accepted"], r["mime_type"], r["reason"]) for r in validate_uploads(files.select("name", "content")).collect()}
    assert judged["doc.pdf"] == (True, "application/pdf", None)
    assert judged["fake.png"] == (False, None, "not a readable image")


def test_image_metrics_and_plan(spark, uploads):
    images = spark.read.format("image").option("dropInvalid", "true").load(str(uploads)).withColumn("name", F.regexp_extract("image.origin", r"([^/]+)$", 1))
    measured = userfuncs.image_metrics(images.where("name like '%.png'"))
    rows = {r["name"]: r for r in userfuncs.scan_repair_plan(userfuncs.scan_quality(measured)).collect()}
    assert (rows["white.png"]["contrast"], rows["white.png"]["noise"], rows["white.png"]["upscale_factor"]) == (0.0, 0.0, pytest.approx(1200 / 420, abs=1e-6))
    assert rows["large.png"]["upscale_factor"] is None and rows["large.png"]["quality"] == pytest.approx(0.2)
    assert rows["noise.png"]["denoise"] and rows["noise.png"]["contrast"] > 200 and not rows["noise.png"]["sharpen"]


def test_page_function_isolates_and_retries(spark):
    pages = spark.createDataFrame([(1, 1, "ok"), (1, 2, "bad"), (1, 3, "slow")], "document_id int, page_number int, markdown string")

    def fn(document, page, text):
        if text == "bad":
            raise ValueError("no")
        if text == "slow":
            raise TimeoutError("late")
        return text.upper()

    rows = {r["page_number"]: r for r in userfuncs.process_pages(pages, fn, lambda e: isinstance(e, TimeoutError)).collect()}
    assert (rows[1]["result"], rows[1]["attempts"]) == ("OK", 1)
    assert (rows[2]["error"], rows[2]["attempts"]) == ("no", 1)
    assert (rows[3]["error"], rows[3]["attempts"]) == ("late", 3)


def test_batches_survive_chunk_borders(spark):
    """Arrow chunks smaller than a batch must not split what the function sees."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        rows = [(j, p, 0, "queued", str(p)) for j in (1, 2) for p in range(1, 22)]
        pages = spark.createDataFrame(rows, "job_id int, page_number int, priority int, status string, markdown string")
        got = userfuncs.process_batches(pages, lambda numbers, texts: {n: f"{len(numbers)}" for n in numbers}, size=8).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == 42
    assert {(r["batch_number"], r["result"]) for r in got} == {(0, "8"), (1, "8"), (2, "5")}


def test_requested_pages_reject_whole_key(spark):
    parts = spark.createDataFrame([(1, 1, 2, 5), (1, 2, 3, 5), (2, 1, 2, 5), (2, 4, 6, 5)], "spec_id int, first int, last int, total_pages int")
    assert sorted(r["page_number"] for r in selection.requested_pages(parts).collect()) == [1, 2, 3]


def test_repeated_upload_reuses_the_stored_document(spark):
    schema = "document_id int, session_id string, checksum string"
    existing = spark.createDataFrame([(1, "s", "a"), (2, "t", "b")], schema)
    incoming = spark.createDataFrame([(5, "s", "a"), (6, "s", "b"), (7, "s", "b"), (8, "s", None)], schema)
    got = {r["document_id"]: (r["stored_id"], r["duplicate"]) for r in joins.find_duplicate_upload(incoming, existing).collect()}
    assert got == {5: (1, True), 6: (6, False), 7: (6, True), 8: (8, False)}


def test_forced_run_takes_every_page(spark):
    documents = spark.createDataFrame([(1, 3, 2)], "document_id int, num_pages int, start_page int")
    pages = spark.createDataFrame([(1, 3)], "document_id int, page_number int")
    normal = selection.pages_to_run(documents, pages).orderBy("run_class", "page_number").collect()
    assert [r["page_number"] for r in normal] == [2, 1]
    assert selection.pages_to_run(documents, pages, force=True).count() == 3


def test_metadata_scan_never_reads_content(spark, tmp_path):
    spark.createDataFrame([(1, bytearray(b"x"))], "document_id int, content binary").write.parquet(str(tmp_path / "d"))
    plan = page_metadata_scan(spark.read.parquet(str(tmp_path / "d")))._jdf.queryExecution().executedPlan().toString()
    assert "document_id" in plan and "content" not in plan


def test_last_writer_wins_in_upserts(spark):
    old = spark.createDataFrame(
        [(1, 1, "s0", "m0", "p0", 0.5, "approved", "t0")],
        "document_id int, page_number int, source_markdown string, markdown string, preprocessing_json string, "
        "confidence_score double, review_status string, reviewed_at string",
    )
    new = spark.createDataFrame(
        [(1, 1, "s1", "m1", "p1", 0.9, 1), (1, 1, None, "edit", None, None, 2), (2, 1, None, "a", None, None, 1), (2, 1, None, "b", None, None, 3)],
        "document_id int, page_number int, source_markdown string, markdown string, preprocessing_json string, confidence_score double, at int",
    )
    got = {r.document_id: r for r in transitions.upsert_pages(old, new, "at").collect()}
    assert (got[1].markdown, got[1].confidence_score, got[1].source_markdown, got[1].review_status) == ("edit", 0.9, "s1", "unreviewed")
    assert got[2].markdown == "b" and len(got) == 2
    reviews = spark.createDataFrame([(1, 1, "approved", "t1"), (1, 1, "needs_review", "t2"), (1, 1, "odd", "t3")], "document_id int, page_number int, status string, at string")
    rows = transitions.apply_reviews(old, reviews).collect()
    assert [(r.review_status, r.reviewed_at) for r in rows] == [("needs_review", None)]
    made = spark.createDataFrame(
        [(1, "p", "x", 1, "draft", "m", 1), (1, "p", "y", 1, "approved", "m", 2)],
        "document_id int, profile string, data_json string, schema_version int, status string, model string, at int",
    )
    none = spark.createDataFrame([], "document_id int, profile string, data_json string, schema_version int, status string, model string, reviewed_at int, created_at int")
    rows = transitions.upsert_extractions(none, made).collect()
    assert [(r.data_json, r.created_at, r.reviewed_at) for r in rows] == [("y", 1, 2)]


def test_only_live_jobs_end_and_marks_carry_mode_and_code(spark):
    pages = spark.createDataFrame([("a", "completed"), ("b", "failed"), ("c", "running")], "job_id string, status string")
    jobs = spark.createDataFrame([("a", "cancelled"), ("b", "running"), ("c", "running")], "job_id string, status string")
    got = aggregates.finalize_jobs(pages, jobs, F.lit("now")).collect()
    assert [(r.job_id, r.status, r.finished_at) for r in got] == [("b", "failed", "now")]
    stored = spark.createDataFrame(
        [("a", 1, "queued", None, None, 0, None, None, 1000, None, "realtime", None)],
        "job_id string, page_number int, status string, error string, duration_ms long, attempts int, started_at int, finished_at int, "
        "priority int, error_code string, processing_mode string, remote_batch_id string",
    )
    events = spark.createDataFrame(
        [("a", 1, "running", None, None, 1, 1, None, "batch", "r1"), ("a", 1, "failed", "bad", 5, 2, 2, "upstream_503", None, None)],
        "job_id string, page_number int, status string, error string, duration_ms long, ts int, event_id int, error_code string, "
        "processing_mode string, remote_batch_id string",
    )
    row = transitions.mark_pages(stored, events).first()
    assert (row.status, row.priority, row.error_code, row.processing_mode, row.remote_batch_id) == ("failed", 0, "upstream_503", "batch", "r1")


def test_page_runs_cost_the_parts_of_a_spec(spark):
    """A thousand million pages are one interval; merged intervals equal sets of numbers."""
    one = spark.createDataFrame([("1-1000000000", 2_000_000_000), ("7, 1-2000000000,5-9", 2_000_000_000)], "spec string, total int")
    got = one.select(ranges.strict_runs(F.col("spec"), F.col("total")).alias("r")).collect()
    assert [[tuple(x) for x in r.r] for r in got] == [[(1, 1_000_000_000)], [(1, 2_000_000_000)]]
    rng = random.Random(4)
    specs = [", ".join(f"{rng.randint(0, 30)}" if rng.random() < 0.4 else f"{rng.randint(0, 30)}-{rng.randint(0, 30)}" for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(s, 25) for s in specs], "spec string, total int").select(
        "spec", ranges.strict_pages(F.col("spec"), F.col("total")).alias("strict"), ranges.lenient_pages(F.col("spec"), F.col("total")).alias("lenient")
    )
    for row in rows.collect():
        bounds = [sorted(map(int, p.split("-")[:: max(1, p.count("-"))])) for p in row.spec.split(", ")]
        pages = {n for b in bounds for n in range(b[0], b[-1] + 1)}
        assert row.strict == (sorted(pages) if pages <= set(range(1, 26)) else None)
        assert row.lenient == (sorted(pages & set(range(1, 26))) or None)
    long = ranges.explode_runs(spark.createDataFrame([(1,)], "k int"), F.expr("array(named_struct('first', 3L, 'last', 10000L), named_struct('first', 20000L, 'last', 20001L))"))
    assert long.agg(F.count("*"), F.countDistinct("page_number"), F.min("page_number"), F.max("page_number")).first()[:] == (10000, 10000, 3, 20001)


def test_extraction_tasks_grow_with_rows(spark):
    """Rows are dealt by their number, so a task of a large table is no longer than that of a small one."""
    from quire.session import spread_rows

    few, many = (spread_rows(spark.range(n), n, "id", each=100).rdd.getNumPartitions() for n in (100, 40_000))
    assert many == 400 and few == spark.sparkContext.defaultParallelism


def test_computed_values_are_projected(spark):
    """A lambda function inside a generator would be interpreted as a whole."""
    from quire.functions.binding import computed

    df = computed(spark.range(3), "v", F.transform(F.sequence(F.lit(0), F.col("id")), lambda x: x + 1))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert not any("lambdafunction" in line for line in plan.splitlines() if "Generate" in line)
    assert [(r.id, r.v) for r in df.orderBy("id").collect()] == [(0, [1]), (1, [1, 2]), (2, [1, 2, 3])]


def test_repeated_sections_that_are_no_lists(spark):
    """Null counts as absent; entries are judged by their JSON kind."""
    given = ["null", "[]", '"x"', "{}", "[null]", "[1]", '["{}"]', "[{}]", '[{"quantity": true}]', '[{"quantity": 10}]']
    rows = [(i, f' \n{{"line_items": {g}}}') for i, g in enumerate(given)]
    read = extraction.parse_annotation(spark.createDataFrame(rows, "document_id int, annotation string"))
    got = {r.document_id: r.error for r in extraction.normalize_extraction(read, "invoice").collect()}
    lists, sections, amounts = "Repeated fields must be lists", "Structured sections must be objects", "Amounts must be numbers"
    assert [got[i] for i in range(10)] == [None, None, lists, lists, None, sections, sections, None, amounts, None]


def test_stored_postings_fill_files_by_their_number(spark, tmp_path, monkeypatch):
    """However few files are asked for, each holds about FILE_POSTINGS; nulls have no tokens, and postings are the text's."""
    from quire.operators import search

    monkeypatch.setattr(search, "FILE_POSTINGS", 100)
    rows = [(d, 1, None if d % 9 == 0 else "Été b%d b%d the" % (d % 5, d)) for d in range(300)]
    pages = spark.createDataFrame(rows, "document_id bigint, page_number int, markdown string")
    search.write_index(pages, str(tmp_path / "i"), files=2)
    assert len(list((tmp_path / "i/postings").glob("*.parquet"))) > 5
    postings, size = search.read_index(spark, str(tmp_path / "i"))
    got = sorted((r.token, r.document_id, r.tf, r.dl) for r in postings.collect())
    want = []
    for d, _, text in rows:
        words = text.lower().replace("é", "e").split() if text else []
        want += [(w, d, words.count(w), 4) for w in set(words)]
    assert got == sorted(want)
    whole = size.collect()[0]
    assert (whole.n_pages, whole.avg_length) == (300, 4.0)
    assert search.counted_tokens(pages).where("dl IS NULL AND tokens IS NULL").count() == sum(t is None for _, _, t in rows)
