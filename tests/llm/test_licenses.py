import random
import re

from gridloom.llm import licenses

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, labels int, score string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base(text):
    words = WORD.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        if at:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def labels(text, table):
    text, found = text or "", []
    for r in table:
        if any(k in lower(text) for k in r["keyword"]):
            found += [(r, m.start(), m.end()) for m in re.finditer(r["regex"], text, re.A)]
    kept = []
    for r, a, b in found:
        if not any(c <= a and d >= b and (s["priority"], d - c, -s["at"]) > (r["priority"], b - a, -r["at"]) for s, c, d in found):
            kept.append(r)
    return {r["label"] for r in kept}, max((r["confidence"] for r in kept), default=0.0)


def texts():
    rng = random.Random(4)
    fixed = [
        None, "", "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "ein Text mit Licht",
        "This work is licensed under the GNU General Public License, version 3.", "CC BY-NC 4.0 and CC-BY 4.0", "All rights, reserved. ALL RIGHTS RESERVED", "all rightsreserved",
        "é all rights reservedé", "日cc by", "cc by cc by", "SPDX-License-Identifier: GPL-2.0-or-later", "General\nPublic\tLicense", "(c) Copyright 2020 all rights reserved " * 40,
        "BSD 3-Clause License", "dedicated to the public domain", "general public licence", "😀 all rights reserved 😀 cc by", "mit license " * 3,
    ]
    words = ["all", "rights", "reserved", "CC", "by", "General", "public", "license", "x", "é", "-", ".", "gnu", "Version 3", "apache", "MIT"]
    return fixed + [" ".join(rng.choices(words, k=rng.randint(1, 50))) for _ in range(150)]


def test_scan_matches_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, None, None, 1, 1, "s") for i, t in enumerate(data)], SCHEMA)
    table = licenses.rules()
    assert len(table) >= 250 and [r["priority"] for r in table] == sorted((r["priority"] for r in table), reverse=True)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, t in enumerate(data):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), repr(t)
        own, confidence = labels(t, table)
        had = set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(own | had)), repr(t)
        assert r.score == max(confidence, licenses.BASE_SCORE if had else 0.0)
    assert got[2].labels == "apache-2.0" and got[3].labels == "mit" and got[4].labels == "" and got[5].labels == "gpl,gpl-3.0"
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_needs_no_shuffle_or_python(spark):
    docs = spark.createDataFrame([(1, "x", None, None, 1, 1, "s")], SCHEMA)
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_wrapped_and_hyphenated_notices_are_tried(spark):
    table = licenses.rules()
    assert all(k.isalnum() for r in table for k in r["keyword"])
    names = [re.sub(r"\(\?:([^()|]*)[^()]*\)\??", r"\1", name).replace("[cs]", "c").replace("?", "").replace("[.]", ".") for _, name, _ in licenses.LICENSES]
    notices = ["Permission is hereby granted, free of charge, to any person", "Permission to use, copy, modify, and/or distribute this software", "is in the public domain", *names]
    joints = (" ", "\n# ", "-", "  ", "\n * ")
    data = [j.join(n.split()) for n in notices for j in joints]
    data.append("you may use this file\n# only under the\n# MIT License")
    docs = spark.createDataFrame([(i, t, None, None, 1, 1, "s") for i, t in enumerate(data)], SCHEMA)
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(docs).collect()}
    free = [r | {"keyword": [""]} for r in table]
    for i, t in enumerate(data):
        own, confidence = labels(t, free)
        assert own and own <= set(got[i][0].split(",")) and got[i][1] >= confidence, repr(t)
        first = got[i - i % len(joints)][0]
        if i < len(data) - 1:
            assert set(filter(None, first.split(","))) <= set(got[i][0].split(",")), (repr(t), first)
    assert got[len(data) - 1] == ("mit", 0.95)


def test_every_sentence_finds_its_rule(spark):
    table = licenses.rules()
    assert len(licenses.NOTICES) + len(licenses.NAMED) + len(licenses.LICENSES) >= 250
    plain = lambda body: re.sub(r"\[(.)[^]]*\]", r"\1", re.sub(r"[()?:]|s:[.]\{[^}]*\}", "", re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)[?]?", r"\1", body.replace("(?s:.{0,120})", " x ").replace("(?s:.{0,160})", " x ").replace("(?s:.{0,80})", " x ").replace("(?s:.{0,60})", " x "))))
    bodies = [(r[0], plain(r[1])) for r in (*licenses.NOTICES, *licenses.NAMED) if "{2}" not in r[1]]
    data = [j.join(b.split()) for _, b in bodies for j in (" ", "\n// ")]
    docs = spark.createDataFrame([(i, t, None, None, 1, 1, "s") for i, t in enumerate(data)], SCHEMA)
    got = {r.doc_id: (set(r.labels.split(",")), r.score) for r in licenses.scan(docs).collect()}
    free = [r | {"keyword": [""]} for r in table]
    for i, t in enumerate(data):
        own, confidence = labels(t, free)
        assert own, t
        assert own <= got[i][0] and got[i][1] >= confidence, t


def test_many_mentions_in_one_text(spark):
    text = "under the MIT License and the Apache License 2.0, " * 8000
    docs = spark.createDataFrame([(1, text, None, None, 1, 1, "s")], SCHEMA)
    r = licenses.scan(docs).collect()[0]
    assert r.labels == "apache-2.0,mit" and len(r.detections) == 16_000
