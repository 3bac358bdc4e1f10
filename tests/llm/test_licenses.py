"""Labels that the voting adds, held to an alignment of every template at every place in plain Python."""

import difflib
import re

from lakewarden.llm import license_scan
from lakewarden.llm.license_scan import GRAM, MIN_OWN, MIN_SIMILARITY, PHRASES, TEMPLATES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def grams(sequence):
    return [tuple(sequence[i: i + GRAM]) for i in range(len(sequence) - GRAM + 1)]


OWNERS: dict = {}
for _label, _text in TEMPLATES:
    for _g in grams(words(_text)):
        OWNERS.setdefault(_g, set()).add(_label)


def aligned(text):
    """Best label of each place where a template fits, from windows of the template's length at every word."""
    w, found = words(text), []
    have = set(grams(w))
    for label, template in TEMPLATES:
        t = words(template)
        own = [g for g in grams(t) if OWNERS[g] == {label}]
        if sum(g in have for g in own) < max(1, MIN_OWN * len(own)):
            continue
        for at in range(max(1, len(w) - len(t) + 1)):
            window = w[at: at + len(t)]
            if sum(g in set(grams(window)) for g in own) >= max(1, MIN_OWN * len(own)):
                ratio = difflib.SequenceMatcher(None, t, window, autojunk=False).ratio()
                if ratio >= MIN_SIMILARITY:
                    found.append((ratio, at, at + len(t), label))
    kept = []
    for span in sorted(found, reverse=True):
        if all(k[3] == span[3] or k[2] <= span[1] or span[2] <= k[1] for k in kept):
            kept.append(span)
    return {s[3] for s in kept}


def base(text):
    joined = f" {' '.join(words(text))} "
    return {label for phrase, label in PHRASES if f" {phrase} " in joined}


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in license_scan.scan(df).collect()}


def test_every_template_gives_its_label_alone(spark):
    texts = [text for _, text in TEMPLATES] + [f"word here {text} and more after" for _, text in TEMPLATES]
    wanted = [{label} | base(text) for label, text in TEMPLATES] * 2
    assert labels(spark, texts) == dict(enumerate(wanted))


def test_shared_openings_give_no_label(spark):
    texts = [
        "This work is licensed under", "This work is licensed under the terms of its authors.", "This work is licensed under the GNU Free Documentation License, version 3.",
        "This work is licensed under a Creative Commons license.", "free software: you can redistribute it and/or modify it under the terms of the", "", None,
        "This work is licensed under the GNU General Public License, version 3.",
        "This work is licensed under CC BY 4.0. This work is licensed under the GNU General Public License, version 3.",
        "This work is, as said, licensed under a Creative Commons Attribution ShareAlike 4.0 International public License.",
    ]
    found = labels(spark, texts)
    assert [found[i] for i in range(len(texts))] == [set()] * 7 + [{"gpl"}, {"cc-by", "gpl"}, {"cc-by-sa"}]


def test_labels_against_alignment(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: set(filter(None, r["labels"].split(","))) for r in license_scan.scan(docs).collect()}
    assert found == {i: base(t) | aligned(t) for i, t in rows.items()}
