"""Texts of very many spans: results as in plain Python, in time that grows with the text."""

import re

from lakewarden.llm import pii, secret_scan

MANY = 100_000


def test_pii_of_many_spans(spark):
    text = "".join(f"é{i} mail u{i}@example.org, " for i in range(MANY))
    ibans = "GB82 WEST 1234 5698 7654 32; " * 20_000
    found = {r["doc_id"]: r for r in pii.find_pii(spark.createDataFrame([(1, text), (2, ibans), (3, None)], "doc_id long, text string")).collect()}
    assert [(s["start"], s["end"]) for s in found[1]["email"]] == [m.span() for m in re.finditer(r"u\d+@example\.org", text)]
    assert {s["score"] for s in found[1]["email"]} == {1.0}
    assert [(s["start"], s["end"]) for s in found[2]["iban"]] == [(29 * i, 29 * i + 27) for i in range(20_000)]
    assert all(not found[3][k] for k in pii.KINDS)


def test_context_is_read_on_both_sides(spark):
    cases = [("x" * 5000 + f" {w} " + "7" * 0 + "a@b.c" + f" {v} " + "é" * 300, score) for w, v, score in (("mail", "-", 1.0), ("-", "contact", 1.0), ("-", "-", 0.8))]
    cases += [("mail " + "é" * 48 + " a@b.c", 0.8), ("a@b.c " + "é" * 48 + " mail", 0.8)]
    found = pii.find_pii(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["email"][0]["score"] for r in found} == {i: s for i, (_, s) in enumerate(cases)}


def test_redaction_of_many_spans(spark):
    text = "".join(f"é{i} password=hunter{i:07d}x " for i in range(MANY))
    plain = "no secret here"
    df = spark.createDataFrame([(1, text), (2, plain), (3, None), (None, text)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    assert clean == {1: re.sub(r"password=\w+", "[secret]", text), 2: plain, 3: None, None: re.sub(r"password=\w+", "[secret]", text)}
    assert secret_scan.masked("abcdef", [{"start": 1, "stop": 3}, {"start": 2, "stop": 5}, {"start": 5, "stop": 6}], "*") == "a**"
