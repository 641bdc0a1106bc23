"""Licence scans of paragraphs: a trained classifier confirmed by templates.

A sparse logistic regression over word n-grams names the licence family of a
paragraph or says "unknown", as it does of licences outside its families; its
probabilities are calibrated on phrasings and licences that it was not fitted
on; a comparison with templates of all families confirms the prediction.  A
paragraph is a line, or neighbouring lines that speak of licences: notices are
often wrapped.  The path from documents to result is DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueframe.llm.common import cut, lowest

UNKNOWN = "unknown"
#: Usual one-line notices of each family.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the AGPL, version 3 or later.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License.",
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Released under the GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Released under the LGPL, version 3 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "Licensed under the MIT license.",
        "Licensed under MIT.",
        "Released under MIT terms.",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "public-domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.",
        "This work is dedicated to the public domain.",
    ),
}
#: What each family is called.
NAMES: dict[str, tuple[str, ...]] = {
    "agpl": ("GNU Affero General Public License", "GNU AGPL v3", "AGPLv3", "AGPL-3.0", "Affero GPL"),
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "2-clause BSD license", "BSD-style license"),
    "cc-by": ("CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial License"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License", "GNU GPL v3", "GNU GPL", "GPLv3", "GPL-3.0", "GPL version 2", "GPLv2"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL v3", "LGPLv3", "LGPL-2.1", "LGPL version 2.1"),
    "mit": ("MIT License", "MIT licence", "Expat License", "MIT-style license"),
    "mpl": ("Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0", "MPL-2.0"),
    "public-domain": ("CC0 1.0", "CC0 1.0 Universal", "Unlicense", "CC0 public domain dedication"),
}
#: Licences outside the families; those of the second row calibrate.
FOREIGN = (
    "Eclipse Public License 2.0", "ISC License", "Boost Software License 1.0", "European Union Public Licence, version 1.2", "zlib License", "Common Development and Distribution License", "Open Software License 3.0",
    "commercial license", "proprietary license", "end user license agreement", "Business Source License 1.1", "Python Software Foundation License", "SIL Open Font License, version 1.1", "EPL-2.0", "BSL-1.0", "EUPL-1.2",
)
FOREIGN_HELD = ("Artistic License 2.0", "Microsoft Public License", "PHP License, version 3.01", "Academic Free License 3.0", "Server Side Public License", "Elastic License 2.0", "PostgreSQL License", "Open Database License 1.0", "MS-PL", "OSL-3.0")
#: How texts grant a licence; the second row calibrates.
PHRASES = (
    "Released under the {}.", "Licensed under the {}.", "Licensed under {}.", "This program is licensed under the {}.", "This work is licensed under a {}.", "This project is available under the {}.",
    "Distributed under the terms of the {}.", "The code is covered by the {}.", "You may use this software under the {}.", "License: {}", "Published under {}.", "{}", "It is free software under the {}, see the file for details.",
    "SPDX-License-Identifier: {}",
)
PHRASES_HELD = ("Provided under the {}.", "This file is subject to the {}.", "All sources are made available under {}.", "Copyright 2020 the authors, {}.", "The library is governed by the terms of the {}.")
#: Paragraphs that speak of licences, or with their words, and grant none; the second row calibrates.
OTHERS = (
    "You need a driving license to rent a car in this state.",
    "The license fee is due every year and covers public television.",
    "He released a new version of the song in the spring.",
    "The public library is open under new terms from Monday.",
    "All rights reserved.",
    "Please read the terms of service before you use this website.",
    "The general asked the public for patience, and the work went on.",
    "She studied physics at MIT and wrote code for the Apache helicopter.",
    "The source of the river lies in the mountains, free of charge to visit.",
    "This work was supported by a grant from the national science foundation.",
    "A copy of this form must be signed and returned with the documentation.",
    "They granted him permission to use the file under some conditions.",
    "The MIT team met the Mozilla team, and GNU tools were shown to the public.",
    "An Apache chief spoke at the Creative Commons meeting in Boston.",
    "Version 2.0 of the map covers the common land of the parish.",
    "The domain of the function is public knowledge.",
    "BSD systems were common at the time, and so were Apache servers.",
)
OTHERS_HELD = (
    "His pilot's license was issued under the old rules.",
    "The MIT campus is open to the public under certain terms.",
    "The Apache web server and BSD systems run most of the sites.",
    "Version 3 of the program was released in May under a new name.",
    "The work of the foundation is free and open to everyone.",
    "The general public may copy the map for their own use.",
)
WORDS = r"[a-z0-9]+(?:\.[0-9]+)*"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORDS})"), F.lit(1))


def grams(words: Column) -> Column:
    """Distinct words and word pairs."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


@dataclass(frozen=True)
class LicenceModel:
    """Weights of the n-grams for each family, less those of "unknown"."""

    families: tuple[str, ...]
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    common: frozenset[str] = frozenset()

    def anchors(self, threshold: float) -> list[str]:
        """Words one of which stands in every paragraph that may reach
        ``threshold``: the n-grams left over cannot lift any family to it.
        Words common in plain paragraphs are taken last."""
        # A family as likely as that has this log-odds against "unknown" alone.
        need = math.log(threshold / (1 - threshold)) * self.temperature - 1e-9
        left = sorted((not set(g.split()) - self.common, -max(w), g) for g, w in self.weights.items() if max(w) > 0)
        words: set[str] = set()
        while left:
            rest = [sum(max(self.weights[g][k], 0.0) for _, _, g in left) + b for k, b in enumerate(self.bias)]
            if max(rest) < need:
                break
            word = max(left[0][2].split(), key=lambda w: (w not in self.common, len(w), w))
            words.add(word)
            left = [x for x in left if word not in x[2].split()]
        return sorted(words)


def _variants(notice: str) -> list[str]:
    """A notice, and the notice without each of its words."""
    words = notice.split()
    return [notice, *(" ".join(words[:i] + words[i + 1 :]) for i in range(len(words)) if len(words) > 3), f"{notice} See the file for details.", f"Copyright 2020 the authors. {notice}"]


def lessons() -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(paragraph, family) pairs to fit on, and others to calibrate on: these
    have phrasings, foreign licences and plain paragraphs of their own."""
    fit = [(p.format(n), f) for f, names in NAMES.items() for n in names for p in PHRASES]
    fit += [(v, f) for f, notices in NOTICES.items() for n in notices for v in _variants(n) if not v.startswith("Copyright")]
    fit += [(p.format(n), UNKNOWN) for n in FOREIGN for p in PHRASES] + [(v, UNKNOWN) for o in OTHERS for v in _variants(o)]
    held = [(p.format(n), f) for f, names in NAMES.items() for n in names for p in PHRASES_HELD]
    held += [(f"Copyright 2020 the authors. {n}", f) for f, notices in NOTICES.items() for n in notices]
    held += [(p.format(n), UNKNOWN) for n in FOREIGN_HELD for p in (*PHRASES, *PHRASES_HELD)] + [(v, UNKNOWN) for o in OTHERS_HELD for v in _variants(o)]
    return fit, held


def train(spark, corpus: DataFrame | None = None, text_col: str = "text", id_col: str = "doc_id", sample: int = 1000, reg: float = 0.0001) -> LicenceModel:
    """Fit on ``lessons`` and, as negatives, one line each of at most
    ``sample`` documents, those whose id hashes lowest, if it names no licence;
    every fourth of these calibrates."""
    fit, held = lessons()
    data = spark.createDataFrame([(*x, True, False) for x in fit] + [(*x, True, True) for x in held], "line string, family string, own boolean, held boolean")
    if corpus is not None:
        lines = F.split(F.col(text_col).cast("string"), "\n")
        h = F.xxhash64(F.col(id_col), F.lit(1))
        picked = corpus.select(h.alias("h"), F.get(lines, F.pmod(h, F.greatest(F.size(lines), F.lit(1))).cast("int")).alias("line")).where("line is not null")
        plain = lowest(picked, "h", sample).where("not lower(line) rlike 'licen[cs]e|copyright|gpl|domain'")
        data = data.unionByName(plain.select("line", F.lit(UNKNOWN).alias("family"), F.lit(False).alias("own"), (F.pmod("h", F.lit(4)) == 0).alias("held")))
    families = (UNKNOWN, *sorted(NOTICES))
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    # A few thousand short rows: one partition, so that each step of the optimiser is one small task.
    data = data.select(grams(tokens(F.col("line"))).alias("grams"), label.alias("label"), "own", "held").coalesce(1).persist()
    plain = data.where("not own")
    least = 0.005 * plain.count()
    common = frozenset(r["g"] for r in plain.select(F.explode("grams").alias("g")).groupBy("g").count().where(F.col("count") >= least).where("not g like '% %'").collect())
    # N-grams of common words alone name no licence.
    vocabulary = [r["g"] for r in data.where("label > 0 and not held").select(F.explode("grams").alias("g")).distinct().orderBy("g").collect() if set(r["g"].split()) - common]
    counts = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="x", minTF=1.0)
    known = counts.transform(data)
    learner = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=reg, elasticNetParam=1.0, maxIter=100, standardization=False)
    model = learner.fit(known.where("not held"))
    rest = [(list(r["rawPrediction"]), int(r["label"])) for r in model.transform(known.where("held")).select("rawPrediction", "label").collect()]
    data.unpersist()

    def loss(t: float) -> float:
        total = 0.0
        for raw, k in rest:
            top = max(raw)
            total += math.log(sum(math.exp((x - top) / t) for x in raw)) - (raw[k] - top) / t
        return total

    temperature = min((0.25 * 1.1**i for i in range(40)), key=loss)
    matrix, bias = model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist()
    weights = {}
    for j, gram in enumerate(vocabulary):
        own = tuple(matrix[k][j] - matrix[0][j] for k in range(1, len(families)))
        if any(own):
            weights[gram] = own
    return LicenceModel(families[1:], weights, tuple(b - bias[0] for b in bias[1:]), temperature, common)


def templates() -> list[tuple[int, str, str]]:
    """(number, family, text): the notices and names of the families, and the
    names of foreign licences under "unknown"."""
    texts = [(f, n) for f, ns in NOTICES.items() for n in ns] + [(f, n) for f, ns in NAMES.items() for n in ns] + [(UNKNOWN, n) for n in (*FOREIGN, *FOREIGN_HELD)]
    return [(i, f, n) for i, (f, n) in enumerate(texts)]


def scan(
    docs: DataFrame, model: LicenceModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, least_match: float = 0.7
) -> DataFrame:
    """``(id, paragraph, n_lines, family, probability, template_match, confirmed)``:
    a row per paragraph whose family is at least ``threshold`` likely.

    ``paragraph`` is the number of its first line.  A line with an anchor word
    of the model is a paragraph, and so are such lines with no blank line and
    two others at most between each, joined by spaces: together they are
    reported, in place of each, where none of them is found, or none confirmed
    but the whole is, or the whole holds more of a template of its family than
    any and none is confirmed as another family.
    ``template_match`` is the share of the n-grams of the family's closest
    template that the paragraph holds; ``confirmed`` says that it reaches
    ``least_match`` and that no other family, nor any licence outside the
    families, has a closer template.  Null, empty and blank texts have no
    paragraphs; a tie goes to the first family in code order; repeated rows
    come back repeated; an empty table gives no rows; other columns are not
    read.  Each distinct paragraph is scored once, so a notice on a third of
    all documents is scored once too.
    """
    spark = docs.sparkSession
    anchors = model.anchors(threshold)
    held = F.array(*[F.lit(a) for a in anchors]) if anchors else F.array().cast("array<string>")
    # Rows are numbered before their lines are laid out, and before the checkpoint that all later steps read.
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"))
    told = F.transform(F.split("_text", "\n"), lambda line, i: F.struct(i.alias("_at"), line.alias("_line"), F.arrays_overlap(tokens(line), held).alias("_held")))
    near = lambda x: F.exists(F.slice("_ls", F.greatest(x["_at"], F.lit(1)), F.when(x["_at"] > 0, 3).otherwise(2)), lambda y: y["_held"])
    lines = rows.select("_id", "_row", told.alias("_ls")).select("_id", "_row", F.inline(F.filter("_ls", lambda x: near(x) & x["_line"].rlike(r"\S"))))
    lines = cut(lines)
    island = F.col("_at") - F.row_number().over(Window.partitionBy("_row").orderBy("_at"))
    placed = lines.withColumn("_run", island)
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_line", "_held")))
    runs = placed.groupBy("_row", "_run").agg(F.first("_id").alias("_id"), ordered.alias("ls"))
    # From the first line with an anchor word to the last.
    places = F.filter(F.transform("ls", lambda x, i: F.when(x["_held"], i)), lambda i: i.isNotNull())
    runs = runs.withColumn("first", F.array_min(places)).withColumn("last", F.array_max(places)).where("last > first")
    runs = runs.withColumn("ls", F.slice("ls", F.col("first") + 1, F.col("last") - F.col("first") + 1))
    runs = runs.select("_id", "_row", "_run", F.col("ls")[0]["_at"].alias("_at"), F.size("ls").alias("_n"), F.array_join(F.transform("ls", lambda x: x["_line"]), " ").alias("_line"))
    # What stands alone; then lines of a run, and the run itself.
    parts = cut(placed.where("_held").select("_id", "_row", "_run", "_at", F.lit(1).alias("_n"), "_line").unionByName(runs))
    each = parts.select("_line").distinct().select("_line", F.explode(grams(tokens(F.col("_line")))).alias("gram"))
    # Vocabulary and templates are fixed in number, whatever the corpus: broadcast.
    names = [f"s{k}" for k in range(len(model.families))]
    weights = spark.createDataFrame([(g, *w) for g, w in model.weights.items()], "gram string, " + ", ".join(f"{n} double" for n in names))
    scored = each.join(F.broadcast(weights), "gram").groupBy("_line").agg(*[F.sum(n).alias(n) for n in names])
    logits = [(F.col(n) + F.lit(b)) / F.lit(model.temperature) for n, b in zip(names, model.bias, strict=True)]
    scored = scored.select("_line", F.array(*logits).alias("_z")).withColumn("_top", F.array_max("_z"))
    mass = sum((F.exp(F.col("_z")[k] - F.col("_top")) for k in range(len(names))), F.exp(-F.col("_top")))
    family = F.element_at(F.array(*[F.lit(f) for f in model.families]), F.array_position("_z", F.col("_top")).cast("int"))
    scored = scored.select("_line", family.alias("family"), (1 / mass).alias("probability")).where(F.col("probability") >= threshold)
    shapes = spark.createDataFrame(templates(), "notice int, of string, text string").select("notice", "of", grams(tokens(F.col("text"))).alias("g"))
    shapes = shapes.select("notice", "of", F.size("g").alias("n"), F.explode("g").alias("gram"))
    scored = cut(scored)
    named = scored.select("_line", "family", F.explode(grams(tokens(F.col("_line")))).alias("gram"))
    hits = named.join(F.broadcast(shapes), "gram").groupBy("_line", "family", "of", "notice").agg((F.count("*") / F.max("n")).alias("match"), F.count("*").alias("held"))
    # Of equal shares the template that holds more is closer.
    close = lambda which: F.max(F.when(which, F.struct("match", "held")))
    own = F.col("of") == F.col("family")
    reach = F.max(F.when(own & (F.col("match") >= least_match), F.col("held")))
    best = hits.groupBy("_line", "family").agg(close(own).alias("own"), close(~own).alias("other"), reach.alias("reach"))
    found = scored.join(best, ["_line", "family"], "left")
    match = F.coalesce("own.match", F.lit(0.0))
    closest = F.col("other").isNull() | (F.col("own") >= F.col("other"))
    found = found.select("_line", "family", "probability", match.alias("template_match"), F.coalesce((match >= least_match) & closest, F.lit(False)).alias("confirmed"), F.coalesce("reach", F.lit(0)).alias("reach"))
    out = parts.join(found, "_line")
    run = Window.partitionBy("_row", "_run")
    single = F.col("_n") == 1
    # Found, or confirmed, and then by how much of a template: the run has to
    # do better than each line, and not to hide that lines are of several families.
    rank = F.struct((F.col("confirmed").cast("int") + 1).alias("rank"), F.when(F.col("confirmed"), F.col("reach")).otherwise(0).alias("reach"))
    none = F.struct(F.lit(0).alias("rank"), F.lit(0).cast("long").alias("reach"))
    out = out.withColumn("_lines", F.coalesce(F.max(F.when(single, rank)).over(run), none)).withColumn("_whole", F.coalesce(F.max(F.when(~single, rank)).over(run), none))
    out = out.withColumn("_families", F.collect_set(F.when(single & F.col("confirmed"), F.col("family"))).over(run)).withColumn("_family", F.max(F.when(~single, F.col("family"))).over(run))
    better = (F.col("_whole") > F.col("_lines")) & ~F.exists("_families", lambda f: f != F.col("_family"))
    out = out.where(single != better)
    return out.select(F.col("_id").alias(id_col), F.col("_at").alias("paragraph"), F.col("_n").alias("n_lines"), "family", "probability", "template_match", "confirmed")
