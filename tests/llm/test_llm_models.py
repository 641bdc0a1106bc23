"""Trained operators: held-out accuracy, counts against plain code, edge cases."""

import random
import re
import textwrap

import numpy as np
import pytest

from cueframe.llm import language, licenses, quality, toxicity
from cueframe.llm.entry import op1_license_scan, op2_toxicity, op6_language_id, op7_quality_rules

SF = "/root/testdata/sf0.01"
EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "a few plain words"), (None, "a few plain words"), (4, "w " * 200000)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in EDGES], "doc_id long, text string, _line string, lang string")


# Language


def test_language_accuracy(spark, docs):
    """Trained on half of the texts, right on the other half."""
    rows = docs.where("text is not null and lang is not null").select("text", "lang", "doc_id").collect()
    model = language.train([(r["text"], r["lang"]) for r in rows if r["doc_id"] % 2][:800])
    held = docs.where("doc_id % 2 = 0 and lang is not null and length(text) > 40")
    found = language.identify(held.withColumnRenamed("lang", "truth"), model)
    joined = found.join(held.selectExpr("doc_id", "lang as truth"), "doc_id")
    right, n = joined.selectExpr("avg(cast(lang = truth as double))", "count(*)").first()
    assert n > 200 and right > 0.97


def test_language_whole_table(spark, docs):
    found = op6_language_id(spark, SF)
    assert found.count() == docs.count()
    assert found.where("accepted").count() > 0.8 * docs.count()


def test_language_evidence(spark):
    """A short text goes by its host's prior, and a declaration by what it is worth."""
    model = language.train([("the house and the garden of the king", "en"), ("das haus und der garten des koenigs", "de")] * 5)
    rows = [(i, "das haus und der garten des koenigs", "a.shop.de", "de") for i in range(50)] + [(i, "the house and the garden of the king", "b.shop.com", "en") for i in range(50, 100)]
    rows += [(200, "zz", "a.shop.de", None), (201, "zz", "b.shop.com", None), (202, "zz", "c.shop.de", None), (203, "zz", None, "de"), (204, "zz", None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, host string, said string")
    got = {r["doc_id"]: r["lang"] for r in language.identify(df, model, host=df["host"], declared=df["said"]).collect()}
    assert [got[i] for i in range(200, 205)] == ["de", "en", "de", "de", "en"]


def test_language_edges(spark, edges):
    model = language.train([("the house and the garden", "en"), ("das haus und der garten", "de")])
    got = language.identify(edges, model).collect()
    assert len(got) == len(EDGES)
    assert all(r["lang"] is None and not r["accepted"] for r in got if r["doc_id"] in (1, 2, 3))
    assert language.identify(edges.limit(0), model).count() == 0
    assert not any(r["accepted"] for r in language.identify(edges, language.train([])).collect())
    clash = edges.withColumnRenamed("_line", "_row")
    kept = language.accepted(clash, model)
    assert kept.columns == clash.columns and {r["_row"] for r in kept.collect()} <= {"x"}
    assert kept.where("doc_id in (1, 2, 3)").count() == 0


# Quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_quality_counts(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = op7_quality_rules(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, chars, symbols, dups, repeats = plain_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dups, repeats)
        failed = n < 20 or 100 * repeats > 30 * n
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_labels(spark):
    """The labels, which no rule has seen, agree."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").select("doc_id", "quality").distinct().withColumnRenamed("quality", "label")
    judged = op7_quality_rules(spark, SF).where("not base_failed").join(labels, "doc_id")
    right, n = judged.selectExpr("avg(cast(kept = (label = 1) as double))", "count(*)").first()
    assert n > 300 and right > 0.98


def test_votes_recovered():
    """Planted accuracies: the posterior tells the planted classes apart."""
    rng = np.random.default_rng(7)
    good = rng.random(20000) < 0.8
    votes = np.where(good[:, None], 2, np.where(rng.random((20000, 4)) < 0.8, 0, 2))
    votes = np.where(rng.random((20000, 4)) < 0.2, 1, votes)
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    said = quality.fit_votes(patterns, counts.astype(float))[which.ravel()] >= 0.5
    assert (said == good).mean() > 0.98


def votes_of(judged):
    return np.array(judged.select(*[v.alias(k) for k, v in quality.rules().items()]).collect())


def test_quality_verdict_needs_no_bound(docs):
    """Whatever bound is put on false alarms, the verdicts are the same; and
    they are not those of a filter that every rule must pass."""
    votes = votes_of(quality.features(docs))
    patterns, which, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    said = [quality.fit_votes(patterns, counts.astype(float), false_alarm=b)[which.ravel()] >= 0.5 for b in (None, 0.3, 0.1, 0.02, 0.002)]
    assert all((s == said[0]).all() for s in said)
    doubted = (votes == 0).any(axis=1)
    assert (said[0] & doubted).any() and (~said[0] & doubted).any() and said[0][~doubted].all()


def test_quality_conflicts(spark, docs):
    """One rule's bad vote is outvoted; three are not."""
    base = docs.where("length(text) > 900 and doc_id % 3 = 0").select("doc_id", "text")
    prose = [" ".join(f"word{(i * 7 + j * 5) % 89}" + "." * (j % 12 == 11) for j in range(80)) for i in range(20)]
    shouted = [(10**6 + i, t.upper()) for i, t in enumerate(prose)]
    noise = [(2 * 10**6 + i, " ".join(w + "***" for w in t.split(" "))) for i, t in enumerate(prose)]
    judged = quality.judge(base.unionByName(spark.createDataFrame(shouted + noise, "doc_id long, text string")))
    got = {r["doc_id"]: r["kept"] for r in judged.where("doc_id >= 1000000").collect()}
    assert all(got[i] for i, _ in shouted) and not any(got[i] for i, _ in noise)
    assert ((votes_of(judged.where("doc_id between 1000000 and 1999999")) == 0).sum(axis=1) == 1).all()


def test_quality_edges(edges):
    got = quality.judge(edges).collect()
    assert len(got) == len(EDGES)
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert quality.judge(edges.limit(0)).count() == 0


# Toxicity


def test_toxicity_held_out(spark):
    large = SF.replace("0.01", "0.1")
    labels = spark.read.parquet(f"{large}/labels.parquet").where("toxic is not null").select("doc_id", "toxic").distinct()
    rows = spark.read.parquet(f"{large}/documents.parquet").join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    rows.sort(key=lambda r: r["doc_id"])
    fit, held = rows[::2], rows[1::2]
    model = toxicity.fit([r["text"] for r in fit], [r["toxic"] for r in fit])
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == toxicity.GRADES - 1
    df = spark.createDataFrame([(r["doc_id"], r["text"]) for r in held], "doc_id long, text string")
    got = {r["doc_id"]: r["severity"] for r in toxicity.severity(df, model).collect()}
    yes, no = [got[r["doc_id"]] for r in held if r["toxic"]], [got[r["doc_id"]] for r in held if not r["toxic"]]
    assert yes and no
    assert np.mean([(a > b) + (a == b) / 2 for a in yes for b in no]) > 0.9


def test_toxicity_whole_table(spark, docs):
    found = op2_toxicity(spark, SF)
    assert found.count() == docs.count()
    assert found.where("severity < 0 or severity > 3 or p_toxic is null").count() == 0


def test_toxicity_edges(edges):
    rng = random.Random(2)
    texts = ["you are vile filth " * rng.randint(1, 4) + "today" for _ in range(40)] + ["what a calm and pleasant day today" for _ in range(40)]
    model = toxicity.fit(texts, [1] * 40 + [0] * 40)
    got = toxicity.severity(edges, model).collect()
    assert len(got) == len(EDGES)
    assert len({r["severity"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.severity(edges.limit(0), model).count() == 0
    assert toxicity.severity(edges, toxicity.fit([], [])).count() == len(EDGES)


# Licences


@pytest.fixture(scope="module")
def licences(spark, docs):
    return licenses.train(spark, docs)


def test_licences_found(spark, licences):
    """Notices inside documents are named; plain talk of licences is not."""
    rows = []
    for family, notices in licenses.NOTICES.items():
        rows += [(len(rows) + i, family, f"Some words come before.\n{n}\nand after it") for i, n in enumerate(notices)]
    plain = [(1000 + i, None, f"first line\n{o}") for i, o in enumerate(licenses.OTHERS)]
    df = spark.createDataFrame(rows + plain, "doc_id long, truth string, text string")
    got = licenses.scan(df, licences).join(df.select("doc_id", "truth"), "doc_id").collect()
    hits = [r for r in got if r["truth"] and r["paragraph"] == 1]
    assert len(hits) >= 0.9 * len(rows) and all(r["family"] == r["truth"] and r["confirmed"] for r in hits)
    assert [r for r in got if r["truth"] is None and r["confirmed"]] == []


def plain_grams(text):
    words = re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", text.lower())
    return set(words) | {" ".join(p) for p in zip(words, words[1:], strict=False)}


def plain_scan(texts, model, threshold=0.5, least=0.7):
    """The same by loops: every line, and every run of lines with an anchor."""
    anchors = set(model.anchors(threshold))
    shapes = [(f, plain_grams(t)) for _, f, t in licenses.templates()]

    def judge(text):
        held = plain_grams(text)
        known = [model.weights[g] for g in held if g in model.weights]
        z = [(sum(w[k] for w in known) + b) / model.temperature for k, b in enumerate(model.bias)]
        p = max(z) if not known else np.exp(max(z)) / (1 + np.exp(z).sum())
        if not known or p < threshold:
            return None
        family = model.families[z.index(max(z))]
        match = {f: max(((len(held & g) / len(g), len(held & g)) for o, g in shapes if (o == family) == f and held & g), default=(0.0, 0)) for f in (True, False)}
        reach = max((len(held & g) for o, g in shapes if o == family and len(held & g) / len(g) >= least), default=0)
        return family, round(float(p), 6), round(match[True][0], 6), match[True][0] >= least and match[True] >= match[False], reach

    out = []
    for doc, text in texts:
        lines = (text or "").split("\n") if text is not None else []
        hit = [bool(anchors & set(re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", x.lower()))) for x in lines]
        kept = [any(hit[max(i - 1, 0) : i + 2]) and bool(re.search(r"\S", x, re.ASCII)) for i, x in enumerate(lines)]
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and kept[end]:
                end += 1
            held = [i for i in range(at, end) if hit[i]]
            alone = [(i, judge(lines[i])) for i in held]
            whole = judge(" ".join(lines[held[0] : held[-1] + 1])) if len(held) > 1 else None
            score = lambda r: (0, 0) if r is None else (1 + r[3], r[4] if r[3] else 0)
            others = {r[0] for _, r in alone if r and r[3]} - {whole[0] if whole else None}
            if score(whole) > max((score(r) for _, r in alone), default=(0, 0)) and not others:
                out.append((doc, held[0], held[-1] - held[0] + 1, *whole[:4]))
            else:
                out += [(doc, i, 1, *r[:4]) for i, r in alone if r]
            at = max(end, at + 1)
    return sorted(out)


def test_licences_against_loops(spark, docs, licences):
    extra = [(10**6 + i, t) for i, t in enumerate((
        "x\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\nother words",
        "Licensed under MIT.\nLicensed under Apache-2.0.", "Licensed under MIT.\n\nLicensed under MIT.\nLicensed under MIT.", "the\n" * 300 + "under the GNU General Public\nLicense, version 3",
        "Licensed under the Eclipse Public License, version 2.0.", "", None, "MIT " * 100000,
    ))]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = [(r["doc_id"], r["paragraph"], r["n_lines"], r["family"], round(r["probability"], 6), round(r["template_match"], 6), r["confirmed"]) for r in licenses.scan(rows, licences).collect()]
    assert sorted(got) == plain_scan([(r["doc_id"], r["text"]) for r in rows.collect()], licences)


def test_licences_held_out(spark, licences):
    """Phrasings, foreign licences and plain talk that the model was not fitted
    on: families are right, what is outside them is unknown and never
    confirmed, and probabilities are as good as they say."""
    _, held = licenses.lessons()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df, licences).collect()}
    said = [got[i]["family"] if i in got else licenses.UNKNOWN for i in range(len(held))]
    right = [s == f for s, (_, f) in zip(said, held, strict=True)]
    assert np.mean(right) > 0.95
    assert not any(r["confirmed"] for i, r in got.items() if held[i][1] != r["family"])
    sure = [(r["probability"], r["family"] == held[i][1]) for i, r in got.items()]
    assert abs(np.mean([p for p, _ in sure]) - np.mean([ok for _, ok in sure])) < 0.05
    others = ("Licensed under the Eclipse Public License, version 2.0.", "ISC License", "Licensed under the Boost Software License.", "Licensed under EUPL-1.2", "Artistic License 2.0")
    foreign = licenses.scan(spark.createDataFrame(list(enumerate(others)), "doc_id long, text string"), licences)
    assert foreign.where("confirmed").count() == 0


def test_licences_wrapped(spark, licences):
    """Notices wrapped over lines are seen whole."""
    cases = {
        "mit": "intro\nPermission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\n\nend",
        "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
        "gpl": "This program is distributed under the GNU General\nPublic License, version 3",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases.values())], "doc_id long, text string")
    got = {r["doc_id"]: (r["family"], r["confirmed"]) for r in licenses.scan(df, licences).collect()}
    assert got == {i: (f, True) for i, f in enumerate(cases)}


#: The usual notices, to be wrapped.
NOTICES = {
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
}


def test_licences_at_any_width(spark, licences):
    """A notice is one row of its family, however it is wrapped; neighbouring lines of two licences are two."""
    rows = [(f, "intro\n\n" + "\n".join(textwrap.wrap(text, width)) + "\n\nend") for f, text in NOTICES.items() for width in (60, 70, 80)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id string, text string"), licences).collect()
    assert sorted((r["doc_id"], r["family"], r["paragraph"], r["confirmed"]) for r in got) == sorted((f, f, 2, True) for f, _ in rows)
    two = [("Licensed under MIT.\nLicensed under Apache-2.0.", [0, 1]), ("Licensed under MIT.\nsome talk\nabout things\nReleased under the Apache License, Version 2.0", [0, 3])]
    for text, places in two:
        found = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), licences).collect()
        assert sorted((r["paragraph"], r["family"]) for r in found) == list(zip(places, ("mit", "apache"), strict=True))


def test_licences_whole_table(spark, docs):
    """Lines that name a licence in so many words are found, with few others."""
    got = {(r["doc_id"], r["paragraph"]) for r in op1_license_scan(spark, SF).where("confirmed").collect()}
    said = {(r["doc_id"], i) for r in docs.collect() for i, line in enumerate((r["text"] or "").split("\n")) if re.search(r"(?i)SPDX-License-Identifier|\blicensed under\b|released under the", line)}
    assert len(said & got) >= 0.95 * len(said)


def test_licences_edges(spark, edges, licences):
    assert licenses.scan(edges, licences).count() == 0
    assert licenses.scan(edges.limit(0), licences).count() == 0
    twice = spark.createDataFrame([(None, "Released under the MIT License.", 1)] * 2, "doc_id long, text string, family int")
    assert [(r["doc_id"], r["paragraph"], r["family"]) for r in licenses.scan(twice, licences).collect()] == [(None, 0, "mit")] * 2


def test_page_language(spark, tmp_path):
    """Pages are judged by their declaration and the suffix of their address besides their text."""
    from cueframe.llm.entry import op6_page_language

    english, german = "the house and the garden of the king", "das haus und der garten des koenigs"
    docs = [(i, english if i % 2 else german, "en" if i % 2 else "de") for i in range(40)]
    rows = [(i, f"https://a{i}.example.{'uk' if i % 2 else 'de'}/", f"<html lang='{'en' if i % 2 else 'de'}-XX'><style>p {{}}</style><p>{english if i % 2 else german}") for i in range(40)]
    rows += [(100, None, "<html lang=en><p>xq"), (101, None, "<html lang=de><p>xq"), (102, "https://new.example.de/", "<p>xq"), (103, "https://new.example.uk/", "<p>xq"), (104, "u", None), (105, None, "")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["lang"] for r in op6_page_language(spark, str(tmp_path)).collect()}
    assert got == {i: "en" if i % 2 else "de" for i in range(40)} | {100: "en", 101: "de", 102: "de", 103: "en", 104: None, 105: None}
