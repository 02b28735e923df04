import json

import pytest

from pricebench.operators import quality
from pricebench.operators.enrich import enrich_lines
from pricebench.operators.quality import (
    accept_bill, batch_summary, batch_values, discard_bill, extract_json, invoice_lines, judge_documents, run_log,
    run_report, to_process, validate_invoices,
)

PART = {"part_name": "HEADLAMP RH (Original)", "part_number": "T81110-02M40", "qty": 1, "unit_cost": 350,
        "total_cost": 350, "grade": "OEM Genuine", "unit_basis": "each"}
COVER = {"part_name": "FR BUMPER COVER", "part_number": "T52119-02M50", "qty": 1, "unit_cost": 200, "total_cost": 200,
         "grade": "Unknown", "unit_basis": "each"}
GOOD = {"supplier_name": "Good Auto", "bill_no": "MG-1001", "bill_date": "12/03/2025", "make": "Toyota",
        "model": "Corolla", "doc_type": "Tax Invoice", "gst_treatment": "excl", "parts_subtotal": 550,
        "gst_amount": 49.5, "invoice_total": 599.5, "parts": [PART, COVER]}


def docs(spark, *texts):
    rows = [(f"f{i}.pdf", t if isinstance(t, str) else json.dumps(t), 1000, 200) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "file_name string, text string, input_tokens long, output_tokens long")


def check(spark, *texts):
    return validate_invoices(extract_json(docs(spark, *texts))).orderBy("file_name").collect()


def test_validation(spark):
    lean = {**GOOD, "parts": [{k: COVER[k] for k in ("part_name", "part_number", "qty", "total_cost")}]}
    good, empty, coerced, free, prose, missing, lean_ = check(
        spark, GOOD, {"supplier_name": "X", "parts": []},
        {**GOOD, "gst_treatment": "maybe", "parts": [{**PART, "grade": "Genuine-ish", "unit_basis": "dozen"}]},
        {**GOOD, "parts": [{"part_name": "THING", "part_number": "", "qty": 1, "unit_cost": 0, "total_cost": 0}]},
        "not an object", {**GOOD, "parts": "x"}, lean)
    assert good.errors == [] and good.warnings == [] and len(good.invoice.parts) == 2
    assert any("empty" in e for e in empty.errors) and empty.invoice is None
    assert (coerced.invoice.gst_treatment, coerced.invoice.parts[0].grade, coerced.invoice.parts[0].unit_basis) == (
        "unknown", "Unknown", "each")
    assert len(coerced.warnings) == 3 and coerced.errors == []
    assert "no price" in free.errors[0]
    assert prose.errors == ["response is not a JSON object"]
    assert missing.errors == ["parts is missing or not an array"]
    assert lean_.errors == [] and lean_.warnings == []
    p = lean_.invoice.parts[0]
    assert (p.grade, p.unit_basis, p.unit_cost) == ("Unknown", "each", 0)


def test_amounts_missing_null_and_text(spark):
    base = {k: v for k, v in GOOD.items() if k not in ("gst_amount",)}
    missing, null, text = check(spark, base, {**GOOD, "gst_amount": None},
                                {**GOOD, "gst_amount": "12.5", "parts": [{**PART, "qty": "2", "unit_cost": -1, "total_cost": "x"}]})
    assert missing.warnings == ["gst_amount is not a number — set to 0"] and null.warnings == []
    assert text.invoice is None and len(text.warnings) == 2
    assert [w.split(": ")[1] for w in text.warnings] == ["unit_cost invalid — set to 0", "total_cost invalid — set to 0"]


def test_json_is_found_in_prose(spark):
    rows = extract_json(docs(spark, '```json\n{"a":1}\n```', 'Here: {"a":{"b":2}} thanks', "no json here", "{broken")).orderBy("file_name")
    got = [r.j for r in rows.selectExpr("to_json(doc) j").collect()]
    assert got == ['{"a":1}', '{"a":{"b":2}}', None, None]


def chain(spark):
    short = {**GOOD, "bill_no": "MG-1002", "parts": [PART]}
    return docs(spark, GOOD, {**GOOD, "supplier_name": " good AUTO "}, short, "the model rambled with no json",
                {**GOOD, "bill_no": "", "parts_subtotal": 0, "invoice_total": 0}, {**GOOD, "bill_no": ""})


def test_decision_chain(spark):
    judged = judge_documents(chain(spark)).cache()
    rows = {r.file_name: r for r in judged.collect()}
    assert [rows[f"f{i}.pdf"].status for i in range(6)] == ["done", "duplicate", "review", "failed", "done", "done"]
    assert rows["f2.pdf"].review_reason == ("extracted lines sum S$350 but printed parts subtotal is S$550 (diff S$-200)"
                                            " — lines may be missing or misread")
    assert "f0.pdf" in rows["f1.pdf"].error and rows["f4.pdf"].rec_ok is None and rows["f0.pdf"].rec_ok is True
    lines = enrich_lines(invoice_lines(judged)).cache()
    assert lines.count() == 2 + 1 + 2 + 2
    held = lines.where("review").collect()
    assert len(held) == 1 and held[0].bill_no == "MG-1002" and held[0].src == "ocr"
    report = run_report(judged, 1.5, 2.0).first()
    assert (report.files_total, report.done, report.review, report.duplicate, report.failed) == (6, 3, 1, 1, 1)
    assert (report.part_rows_exported, report.input_tokens, report.estimated_cost) == (7, 6000, 0.01)
    log = {r.file: r for r in run_log(judged).collect()}
    assert (log["f2.pdf"].reconciliation, log["f4.pdf"].reconciliation, log["f3.pdf"].lines) == ("MISMATCH", "nothing printed to check", None)
    summary = batch_summary(lines, "src").first()
    assert (summary.lines, summary.suppliers, summary.makes, summary.bills) == (7, 1, 1, 2)
    assert batch_values(lines, "src").count() == 4
    accepted = accept_bill(lines, "Good Auto", "MG-1002")
    assert accepted.where("review").count() == 0
    assert discard_bill(lines, "Good Auto", "MG-1002").count() == 6


def test_stored_bills_block(spark):
    stored = spark.createDataFrame([("GOOD AUTO", "mg-1001", "old.pdf")], "supplier string, bill_no string, file_name string")
    row = judge_documents(docs(spark, GOOD), stored).first()
    assert row.status == "duplicate" and "old.pdf" in row.error


def test_what_is_left_to_read(spark):
    found = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10), ("d", 99)], "sha256 string, length long")
    log = spark.createDataFrame([("a", "done"), ("b", "failed")], "sha256 string, status string")
    fresh, large = to_process(found, log, max_bytes=50)
    assert [r.sha256 for r in fresh.orderBy("sha256").collect()] == ["c"]
    assert [(r.sha256, r.status) for r in large.collect()] == [("d", "failed")]
    assert to_process(found, log, retry_failed=True, max_bytes=50)[0].count() == 2


def test_a_document_is_read_once(spark):
    odd = {"supplier_name": 1.5, "bill_no": None, "bill_date": True, "make": ["a"], "model": {"b": 1}, "gst_amount": None, "invoice_total": "abc", "parts": [
        {"part_name": 12, "part_number": None, "qty": "2", "unit_cost": True, "total_cost": 1.5, "grade": ["a"], "unit_basis": {"a": 1}},
        {"part_name": "b", "qty": -1, "unit_cost": "", "total_cost": " 7 "}, {"part_number": "c", "qty": [1], "unit_cost": {}, "total_cost": "1d", "x": 0}]}
    parts = check(spark, {**odd, "parts": odd["parts"][:2]}, odd, {**odd, "parts": [5, None, "x", [1], {}]}, {**odd, "parts": {"a": 1}}, json.dumps([odd]))
    got = parts[0].invoice
    assert (got.supplier_name, got.bill_no, got.bill_date, got.make, got.model, got.gst_amount, got.invoice_total) == ("1.5", "", "true", '["a"]', '{"b":1}', 0.0, 0.0)
    assert [(p.part_name, p.part_number, p.qty, p.unit_cost, p.total_cost, p.grade, p.unit_basis) for p in got.parts] == [
        ("12", "", 2.0, 1.0, 1.5, "Unknown", "each"), ("b", "", 1.0, 0.0, 7.0, "Unknown", "each")]
    assert parts[1].errors == ['parts[2] "c": no price at all (unit_cost and total_cost both 0)'] and len(parts[2].errors) == 10
    assert parts[3].errors == ["parts is missing or not an array"] and parts[4].errors == parts[1].errors
    plan = validate_invoices(extract_json(docs(spark, GOOD)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(doc#") == 1


@pytest.mark.parametrize("twice", [False, True])
def test_texts_are_shuffled_only_if_a_document_is_listed_twice(spark, monkeypatch, twice):
    plans = []
    monkeypatch.setattr(quality, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df.cache())
    listed = docs(spark, GOOD, "no json", {**GOOD, "bill_no": "other"})
    judged = judge_documents(listed.unionByName(listed.where("file_name <> 'f0.pdf'")) if twice else listed)
    assert {r.file_name: r.status for r in judged.collect()} == {"f0.pdf": "done", "f1.pdf": "failed", "f2.pdf": "done"} and judged.count() == 3
    assert "Exchange" not in plans[0] and len(plans) == 1 + twice and "document" in judged.columns
