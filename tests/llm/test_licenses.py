"""Rules, gate and suppression against a plain Python scan."""

import re

from pyspark.sql import functions as F

from codelake.llm import licenses as L

TEXTS = [
    None, "", " \n ", "no words of law here", "Licensed under the Apache License, Version 2.0. MIT LICENSE mit license",
    "SPDX-License-Identifier: GPL-3.0-only\nThis work is licensed under the GNU General Public License, version 3. CC BY-NC 4.0",
    "GNU general  public\tlicense version 2 or at your option any later version", "xmit license mit licensex", "mit-license", "mit license mit license mit license",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "released under the Mozilla Public License 2.0 and the BSD 3-Clause License",
    "é ü apache license é", "cc by cc by cc by", "All rights reserved. " * 400, "word " * 30000 + "apache license",
    "available under the terms of the Creative Commons Attribution Share Alike 4.0 International license", "the unlicense; public domain dedication", "LİCENSE mİt license",
]


def plain(text):
    low = "".join(c.lower() if c < "\x80" else c for c in text or "")
    words = re.findall(L.WORD, low)
    joined = " " + " ".join(words) + " "
    at = {}
    for k in range(len(joined)):
        if joined[k] == " ":
            at[k + 1] = len(at)
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        for m in re.finditer(rf"(?<= )(?={phrase} )", joined):
            starts.append(at[m.start()])
            labels.add(label)
    found = []
    for k, rule in enumerate(L.signatures()):
        if rule.keyword in words:
            for m in re.finditer(rule.pattern, joined):
                found.append((at[m.start()], -at[m.end() + 1], rule.priority, k, rule.label, rule.score))
    kept, reach = [], 0
    for d in sorted(found):
        if -d[1] > reach:
            reach = -d[1]
            kept.append(d)
    all_labels = labels | {d[4] for d in kept}
    score = max([d[5] for d in kept], default=0.5 if starts else 0.0)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(all_labels)), score,
            [(d[0], -d[1], d[4]) for d in kept])


def test_every_text(spark):
    rows = list(enumerate(TEXTS)) + [(4, TEXTS[4])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("Score", F.lit("old"))
    for r in L.scan_licenses(df).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(d.start, d.end, d.label) for d in r.detections])
        assert got == plain(r.text), r.doc_id
    assert L.scan_licenses(df).count() == len(rows)
    assert L.scan_licenses(df.limit(0)).count() == 0


def test_rules_are_many_ordered_and_gated():
    rules = L.signatures()
    assert len(rules) > 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    for r in rules:
        assert re.compile(r.pattern)
        assert r.keyword in r.pattern


def test_priority_between_equal_intervals(spark):
    rules = [L.Signature(1, "x", "(?<= )(?:x y)(?= )", "late", 0.5), L.Signature(0, "x", "(?<= )(?:x y)(?= )", "early", 0.4), L.Signature(0, "y", "(?<= )(?:y)(?= )", "inner", 1.0), L.Signature(5, "y", "(?<= )(?:y z)(?= )", "across", 0.3)]
    row = L.scan_licenses(spark.createDataFrame([("x y z",)], "text string"), rules=rules).collect()[0]
    assert [d.label for d in row.detections] == ["early", "across"]
