import re

from sylva.llm import license_scan as L


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w = words(text)
    places = []
    for phrase, label in L.BASE.items():
        p = phrase.split()
        places += [(k, label) for k in range(len(w) - len(p) + 1) if w[k : k + len(p)] == p]
    return len(w), places


def brute_found(text):
    joined = " " + " ".join(words(text)) + " "
    kept = []
    for r in L.rules():
        if f" {r.keyword}" in joined and (r.form or f" {r.keyword}") in joined:
            own = []
            for m in re.finditer(f" (?:{r.pattern})(?= )", joined):
                s = joined[: m.start()].count(" ")
                own.append((s, s + m[0].count(" "), r.label))
            kept += [(s, e, label) for s, e, label in own if all(e <= s2 or e2 <= s for s2, e2, _ in kept)]
    return kept


def brute_labels(text):
    return [label for _, _, label in brute_found(text)]


def check(rows, texts):
    for r in rows:
        n, places = brute_base(texts[r.doc_id])
        at = [p for p, _ in places]
        assert (r.n_words, r.n_base) == (n, len(places)), texts[r.doc_id]
        assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
        base = {b for _, b in places}
        assert r.base_labels == ",".join(sorted(base))
        assert r.labels == ",".join(sorted(base | set(brute_labels(texts[r.doc_id])))), texts[r.doc_id]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


ODD = [
    None,
    "",
    "...",
    "CC BY cc-by CC  BY-NC 4.0. cc by cc by",
    "This work is licensed under the GNU General Public License, version 3.",
    "All rights reserved. all RIGHTS\nreserved Copyright (c) 2021 Foo Bar Inc. All rights reserved.",
    "Licensed under the Apache License, Version 2.0. See the MIT License for details; dual licensed under the BSD 3-Clause and",
    "SPDX-License-Identifier: LGPL-2.1 or later; Creative Commons Attribution-ShareAlike 4.0",
    "ünïcode General Public License é all rights reservedx cc byz",
    "all rights reserved " * 200,
    "GNU Lesser General Public License version 1, the Affero General Public License v3 or General Public License 2",
    "a) licensed under the MIT License version 2 clause BSD license 3 clause; subject to the terms of the Ruby license",
    "the Mozilla\u212a Public License; MOZ\u0130LLA public license; \u0130sc license; MIT l\u0130cense",
    "Copyright 2020 all rights reserved " * 300,
    "copyright 2020 gpl license 2 " * 3000,
]


def test_odd_texts(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    check(L.scan(docs).collect(), dict(enumerate(ODD)))


def test_detections_stay_by_priority(spark):
    docs = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    for r in L.detections(docs).collect():
        assert [(d.s, d.e, d.label) for d in r.found] == brute_found(ODD[r.doc_id])
    # What is suppressed itself suppresses nothing: the first crosses the second, which crosses the third.
    assert brute_labels("gpl license version 2 mit license") == ["gpl", "mit"]


def test_documents(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = L.op6_license_rules(spark, sf).collect()
    assert len(rows) == len(texts)
    check(rows, texts)


def test_rules():
    rules = L.rules()
    assert len(rules) > 200 and not any("{name}" in r.pattern or "{version}" in r.pattern for r in rules)
    for r in rules:
        re.compile(r.pattern)


def test_empty_table_and_repeated_rows(spark):
    assert L.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "cc by", 5)] * 2, "doc_id long, text string, labels int")
    assert [r.labels for r in L.scan(docs).collect()] == ["cc-by", "cc-by"]


def test_against_sql(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(L.oracle())
    columns = [d[0] for d in cursor.description]
    got = L.op6_license_rules(spark, sf)
    assert sorted(columns) == sorted(got.columns)
    rows = got.select(*columns).collect()
    assert sorted(tuple(map(str, r)) for r in rows) == sorted(tuple(map(str, r)) for r in cursor.fetchall())
