"""URL lists and licenses on small cases."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from headwind.llm import licenses, urllists


def judged(spark, captures, entries):
    c = spark.createDataFrame(captures, "id int, url string, fetched date, blocked string, day string")
    e = spark.createDataFrame(entries, "list string, pattern string, day date, action string")
    return {r["row"]["id"]: (r["blocked"], r["n_active"], r["pattern"]) for r in urllists.judge_captures(c, e).collect()}


def test_hosts_and_patterns(spark):
    urls = ["http://User@WWW.a.Example.com:80/x/y/?q#f", "https://example.com", "ftp://e.com./a//b/c/d", "no url", None, "http:///path", "https://x.org?q=/a"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [(r[0], r[1]) for r in df.select(urllists.host_of(F.col("u")), urllists.covering_patterns(F.col("u"))).collect()]
    assert got[0] == ("www.a.example.com", ["www.a.example.com", "a.example.com", "example.com", "www.a.example.com/x", "www.a.example.com/x/y"])
    assert got[1] == ("example.com", ["example.com"]) and got[2] == ("e.com", ["e.com", "e.com/a", "e.com/a/b", "e.com/a/b/c"])
    assert got[3] == got[4] == got[5] == (None, []) and got[6] == ("x.org", ["x.org"])


def test_as_of(spark):
    d = lambda m, k: date(2024, m, k)
    entries = [("spam", "Example.com", d(1, 10), "add"), ("spam", "example.com", d(3, 5), "remove"), ("spam", "example.com", d(9, 1), "add"), ("bad", "a.example.com/x/", d(2, 1), "add"), ("bad", "gone.org", d(2, 1), "add"), ("bad", "gone.org", d(2, 1), "remove"), (None, "q.org", d(1, 1), "add"), ("bad", "q.org", None, "add"), ("bad", "q.org", d(1, 1), "other")]
    urls = [("http://example.com/", d(1, 9)), ("http://example.com/", d(1, 10)), ("http://sub.example.com/p", d(3, 4)), ("http://sub.example.com/p", d(3, 5)), ("http://example.com/", d(12, 31)), ("http://a.example.com/x/y", d(2, 1)), ("http://a.example.com/xy", d(2, 1)), ("http://gone.org/", d(2, 2)), ("http://q.org", d(5, 5)), (None, d(1, 1)), ("http://example.com/", None), ("http://notexample.com/", d(1, 20))]
    got = judged(spark, [(i, u, f, "x", "y") for i, (u, f) in enumerate(urls)], entries)
    want = [(False, 0, None), (True, 1, "example.com"), (True, 1, "example.com"), (False, 0, None), (True, 1, "example.com"), (True, 2, "a.example.com/x"), (True, 1, "example.com"), (False, 0, None), (False, 0, None), (False, 0, None), (False, 0, None), (False, 0, None)]
    assert [got[i] for i in range(len(urls))] == want


def test_deep_and_mixed_case_paths(spark):
    entries = [("a", "Example.com/a/b/c/d", date(2024, 1, 1), "add"), ("a", "Example.COM/Download", date(2024, 1, 1), "add"), ("b", "example.com/A/b/c/D/e/f/", date(2024, 1, 1), "add")]
    urls = ["http://EXAMPLE.com/a/b/c/d/e", "http://example.com/a/b/c/D", "http://example.com/Download", "http://example.com/download", "http://example.com/A/b/c/D/e/f?q", "http://example.com/a/b/c"]
    got = judged(spark, [(i, u, date(2024, 5, 1), "x", "y") for i, u in enumerate(urls)], entries)
    assert [got[i][2] for i in range(len(urls))] == ["example.com/a/b/c/d", None, "example.com/Download", None, "example.com/A/b/c/D/e/f", None]


def test_addresses_stand_whole(spark):
    entries = [("a", "3.4", date(2024, 1, 1), "add"), ("a", "10.0.0.7", date(2024, 1, 1), "add"), ("a", "[2001:db8::1]", date(2024, 1, 1), "add"), ("a", "4.com", date(2024, 1, 1), "add")]
    urls = ["http://1.2.3.4/", "http://10.0.0.7:8080/x", "http://[2001:DB8::1]:80/y", "http://1.2.3.4.com/", "http://[2001:db8::2]/"]
    got = judged(spark, [(i, u, date(2024, 5, 1), "x", "y") for i, u in enumerate(urls)], entries)
    assert [got[i][2] for i in range(len(urls))] == [None, "10.0.0.7", "[2001:db8::1]", "4.com", None]


def test_times_of_day_long_urls_and_hot_keys(spark):
    from datetime import datetime

    deep = "/".join(["p"] * 300)
    entries = spark.createDataFrame([("a", "Example.com", datetime(2024, 1, 5, 15), "add"), ("a", "example.com", datetime(2024, 1, 5, 18), "remove"), ("b", f"example.com/{deep}", datetime(2024, 1, 1), "add"), ("c", None, None, None)], "list string, pattern string, day timestamp, action string")
    times = [datetime(2024, 1, 5, h, m) for h, m in ((9, 0), (15, 0), (17, 59), (18, 0))]
    rows = [(i, "http://example.com/", t, "x") for i, t in enumerate(times)] + [(4, f"http://example.com/{deep}/q" + "r" * 50_000, times[0], "x"), (5, None, None, None)]
    # One page at one time makes up most of the rows, one host all of them.
    rows += [(10 + i, "http://example.com/hot", times[1], "x") for i in range(300)] + [(1000 + i, f"http://example.com/{i}", times[2], "x") for i in range(300)]
    made = urllists.judge_captures(spark.createDataFrame(rows, "id int, url string, fetched timestamp, hot string").repartition(4), entries)
    got = {r["row"]["id"]: (r["blocked"], r["pattern"] and r["pattern"][:13]) for r in made.collect()}
    assert [got[i] for i in range(6)] == [(False, None), (True, "example.com"), (True, "example.com"), (False, None), (True, "example.com/p"), (False, None)]
    assert len(got) == len(rows) and all(got[i][0] for i in got if i >= 10)


def test_repeated_and_empty(spark):
    rows = [(1, "http://example.com/", date(2024, 5, 1), "x", "y")] * 3
    e = spark.createDataFrame([("s", "example.com", date(2024, 1, 1), "add")], "list string, pattern string, day date, action string")
    c = spark.createDataFrame(rows, "id int, url string, fetched date, blocked string, day string")
    assert [r["blocked"] for r in urllists.judge_captures(c, e).collect()] == [True] * 3
    assert [r["blocked"] for r in urllists.judge_captures(c, e.limit(0)).collect()] == [False] * 3
    assert urllists.judge_captures(c.limit(0), e).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train_licenses(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_licenses_of_documents(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    truth = F.when(F.contains("text", F.lit("CC BY-NC 4.0")), "cc-by-nc").when(F.contains("text", F.lit("General Public License, version 3")), "gpl-3.0").when(F.contains("text", F.lit("Apache License, Version 2.0")), "apache-2.0").when(F.contains("text", F.lit("MIT License")), "mit")
    found = licenses.scan_licenses(docs, model).join(docs.select("doc_id", truth.alias("truth")), "doc_id")
    rows = found.select("truth", F.transform(F.filter("licenses", lambda x: x["confirmed"]), lambda x: x["family"]).alias("f")).collect()
    right = sum(set(r["f"]) == ({r["truth"]} - {None}) for r in rows)
    assert right >= 0.999 * len(rows) and sum(r["truth"] is not None for r in rows) > 100


def test_paragraphs(spark, model):
    text = "First line.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software.\nHe has a license to drive in public.\nLicensed under the Apache License, Version 2.0"
    rows = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    got = {r["doc_id"]: [(x["paragraph"], x["family"], x["confirmed"]) for x in r["licenses"]] for r in licenses.scan_licenses(rows, model).collect()}
    assert got == {1: [(2, "mit", True), (4, "apache-2.0", True)], 2: [], 3: []}


def test_held_out_variants(model):
    import numpy as np

    rng, right, n = np.random.default_rng(77), 0, 0
    for family, notices in licenses.NOTICES.items():
        for t in notices:
            for v in licenses._variants(t, rng, 12):
                data = np.frombuffer(v.encode(), np.uint8)
                found = model.scan(data, np.array([0, len(data)]))[0]
                right += [x["family"] for x in found] == [family]
                n += 1
    assert right > 0.9 * n
    for t in licenses.OTHERS:
        data = np.frombuffer(t.encode(), np.uint8)
        assert not any(x["confirmed"] for x in model.scan(data, np.array([0, len(data)]))[0])


def test_wrapped_notices_and_several_licenses(model):
    import numpy as np

    gpl = "This program is free software: you can redistribute it and/or modify\n{0}it under the terms of the GNU General Public License as published by\n{0}the Free Software Foundation, either version 3 of the License, or\n{0}(at your option) any later version."

    def found(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return [(x["paragraph"], x["family"]) for x in model.scan(data, np.array([0, len(data)]))[0] if x["confirmed"]]

    assert found("A title.\n\n" + gpl.format("") + "\n\nMore.") == [(2, "gpl-3.0")]
    assert found("/*\n * " + gpl.format(" * ") + "\n */\nint main() {}\nint x;\n") == [(1, "gpl-3.0")]
    mit = "Permission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\nassociated documentation files."
    assert [f for _, f in found(mit)] == ["mit"]
    assert sorted(f for _, f in found("Licensed under the MIT License or the Apache License, Version 2.0.")) == ["apache-2.0", "mit"]
    assert found("The driver must carry\na valid license at all times.\nYou may not use this\nservice without permission.") == []


def _found(model, text):
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return [(x["family"], x["confirmed"]) for x in model.scan(data, np.array([0, len(data)]))[0]]


def test_licenses_of_no_family_are_unknown(model):
    isc = "Released under the ISC license. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
    eclipse = "This program and the accompanying materials are made available\nunder the terms of the Eclipse Public License 2.0 which is available at\nhttps://www.eclipse.org/legal/epl-2.0/"
    for text in (isc, eclipse, "Licensed under the Foo Public License, version 7.", "Released under the Ruby License."):
        assert _found(model, text) == [("unknown", False)], text
    assert ("mit", True) in _found(model, "Released under the ISC license or the MIT License.")
    assert _found(model, "This work is licensed under the GNU General\nPublic License, version 3.") == [("gpl-3.0", True)]
    assert not any(sure for _, sure in _found(model, "Released under the license of the foundation."))


def test_probabilities_are_calibrated():
    """Of rows that the model was not trained on - left-out notices, licenses, variants - confidence is near the share that is right."""
    from collections import Counter

    import numpy as np
    import pyarrow.parquet as pq

    blank, found = licenses._untrained(), Counter()
    for batch in licenses._plain_paragraphs(iter(pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).to_batches()), blank):
        for features, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found[tuple(features)] += n
    keys = sorted(found)
    model, (z, y, weight) = licenses.fit_licenses(blank, [np.array(k) for k in keys], np.array([found[k] for k in keys], float))
    z = z / model.temperature
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    sure, right = p.max(1), p.argmax(1) == y
    bins = np.minimum((sure * 10).astype(int), 9)
    off = sum(weight[bins == k].sum() / weight.sum() * abs(np.average(sure[bins == k], weights=weight[bins == k]) - np.average(right[bins == k], weights=weight[bins == k])) for k in np.unique(bins))
    assert off < 0.09 and 0.2 < model.temperature < 5
    # No other temperature makes the labels likelier.
    assert licenses.calibrate(z, y, weight) == pytest.approx(1, abs=0.06)


def test_regression_against_plain_steps():
    """_fit against gradient descent written out, on a small problem."""
    import numpy as np

    rng = np.random.default_rng(5)
    x = (rng.random((60, 5)) < 0.4).astype(np.float32)
    y = np.where(x[:, 0] > 0, 1, np.where(x[:, 1] > 0, 2, 0))
    w, b = licenses._fit(x, y, np.ones(60), 3, ridge=0.05)
    v, c = np.zeros((5, 3)), np.zeros(3)
    for _ in range(20_000):
        z = x @ v + c
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (p - np.eye(3)[y]) / 60
        v, c = v - 0.5 * (x.T @ e + 0.05 * v), c - 0.5 * e.sum(0)
    assert np.abs(w - v).max() < 0.02
