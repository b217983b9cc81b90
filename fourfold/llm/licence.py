"""Licence scan: an n-gram classifier over lines and passages of lines, confirmed by templates; DataFrame functions only."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fourfold.llm.common import cut, text_of
from fourfold.llm.linear import fit_softmax

#: Customary licence notices, by family.
TEMPLATES = {
    "apache": ["Apache License, Version 2.0", "License: Apache-2.0", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["MIT License", "License: MIT", "Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.", "Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3.", "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Released under the BSD 3-Clause License.", "Licensed under the BSD 2-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "SPDX-License-Identifier: BSD-3-Clause"],
    "mpl": ["Mozilla Public License, version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "isc": ["ISC License", "Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC-SA 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.", "This work is dedicated to the public domain under the Creative Commons CC0 license.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission of the publisher.", "Copyright 2020 Example Inc. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."],
}
#: Sentences with the same words that grant nothing.
OTHERS = ["He lost his driver's license last week.", "A fishing license is required at the lake.", "The general public was not admitted.", "They used source material without permission.", "The software crashed when copying files.", "Its license plate was found in the work shed.", "The apache helicopter landed free of charge.", "The foundation published the conditions of its warranty.", "The version of events in the file was public knowledge."]

#: Paragraphs, and documents they come from, that ``sample_paragraphs`` takes at most; the operator counts over all lines instead.
SAMPLE_PARAGRAPHS, SAMPLE_DOCS = 2_000, 200
VARIANTS = 12
#: Share of ordinary paragraphs below which a gram is left out of the unknown class, and synthetic paragraphs of that class.
RARE, DRAWN = 1e-4, 1_500
#: Word pairs of templates from which on a paragraph is notice-like.
NOTICE = 3
#: Share of held-out unknown paragraphs that may score above the calibrated threshold.
FALSE_RATE = 0.002
#: Share of a template's word pairs that a paragraph must hold.
CONFIRM = 0.6
#: Runs of non-blank lines, within which a notice may be wrapped.
BLANK = r"\n(?:[\x09-\x0D\x20]*\n)+"
TOKEN = r"[a-z0-9]+"


@dataclass
class Licences:
    families: list[str]
    grams: list[str]  # words and pairs of neighbours that hold a telling word
    weights: np.ndarray  # (grams, families): against the unknown class
    bias: np.ndarray
    scale: float  # calibration of all margins
    threshold: float
    telling: list[str]


def stride() -> int:
    """Words of the longest passage that holds a template's pairs at a density of ``CONFIRM``: blocks
    of twice as many, one every ``stride`` words, hold each such passage whole."""
    return math.ceil(max(len(re.findall(TOKEN, t)) for own in TEMPLATES.values() for t in own) / CONFIRM)


def _grams(text: str) -> list[str]:
    words = re.findall(TOKEN, text.translate({k: k + 32 for k in range(65, 91)}))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def known_grams() -> set[str]:
    return {g for own in TEMPLATES.values() for t in own for g in _grams(t)}


def template_pairs() -> list[list[str]]:
    return [sorted({g for g in _grams(t) if " " in g}) for own in TEMPLATES.values() for t in own]


def notice_like(grams: set[str]) -> bool:
    """As ``ordinary_counts`` has it: NOTICE known pairs, or CONFIRM of a template's."""
    known = {g for own in template_pairs() for g in own}
    return len(grams & known) >= NOTICE or any(own and len(grams & set(own)) >= CONFIRM * len(own) for own in template_pairs())


def fit(paragraphs: list[str], seed: int = 7) -> Licences:
    """``fit_counts`` on the paragraphs that are not notice-like."""
    known = known_grams()
    plain = [g for g in (known & set(_grams(p)) for p in paragraphs) if not notice_like(g)]
    return fit_counts(dict(Counter(g for own in plain for g in own)), len(plain), seed)


def fit_counts(counts: dict[str, int], n: int, seed: int = 7) -> Licences:
    """Train on template variants (words dropped, known words added) and on the unknown class.

    counts: in how many of n ordinary paragraphs each template gram lies. The
    unknown class has each of these grams alone and paragraphs drawn by their
    rates. Half of its rows and of the variants calibrate: a scale for all
    margins, then the probability above which a family is named at all.

    ``telling`` are the words without which no paragraph can reach probability
    0.5: all grams of the other words together leave every family's margin
    below 0. The most frequent words are left out first.
    """
    rng = np.random.default_rng(seed)
    families = list(TEMPLATES)
    useful = sorted(known_grams())
    place = {g: k for k, g in enumerate(useful)}
    rate = np.array([counts.get(g, 0) / max(n, 1) for g in useful])
    words_only = [k for k, g in enumerate(useful) if " " not in g]

    def drawn(where: list[int]) -> list[str]:
        return [useful[k] for k in np.array(where)[rng.random(len(where)) < rate[where]]]

    rows, marks, half = [], [], []
    for k, family in enumerate(families):
        for template in TEMPLATES[family]:
            words = template.split()
            for v in range(VARIANTS):
                kept = [w for w in words if v == 0 or rng.random() > 0.08]
                rows.append({*_grams(" ".join(kept)), *(drawn(words_only) if v % 2 else [])})
                marks.append(k)
                half.append(v % 2)
    seen = [{g, *g.split()} for g, r in zip(useful, rate, strict=True) if r >= RARE]
    for n_row, own in enumerate([set(_grams(t)) for t in OTHERS * 6] + [g for g in seen for _ in range(2)] + [set(drawn(list(range(len(useful))))) for _ in range(DRAWN if n else 0)]):
        rows.append(own)
        marks.append(len(families))
        half.append(n_row % 2)
    x = np.zeros((len(rows), len(useful)))
    for row, own in enumerate(rows):
        x[row, [place[g] for g in own & place.keys()]] = 1.0
    y, half = np.array(marks), np.array(half)
    w, b = fit_softmax(x[half == 0], y[half == 0], len(families) + 1, steps=300, rate=2.0)
    weights, bias = w[:, :-1] - w[:, -1:], b[:-1] - b[-1]
    weights[np.abs(weights) < 0.02] = 0.0  # sparse
    margin = x @ weights + bias
    held = half == 1

    def probability(scale: float) -> np.ndarray:
        z = np.hstack([margin[held] * scale, np.zeros((held.sum(), 1))])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    loss = lambda s: -np.log(np.maximum(probability(s)[np.arange(held.sum()), y[held]], 1e-12)).mean()
    scale = min((0.25 * 1.25**k for k in range(20)), key=loss)
    unknown = probability(scale)[y[held] == len(families)][:, :-1].max(axis=1)
    threshold = max(0.5, float(np.quantile(unknown, 1 - FALSE_RATE)) if len(unknown) else 0.5)
    return Licences(families, useful, weights, bias, float(scale), threshold, _telling(useful, rate, weights, bias))


def _telling(grams: list[str], rate: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> list[str]:
    gain = np.maximum(weights, 0.0)
    parts = [g.split() for g in grams]
    of: dict[str, list[int]] = {}
    for k, own in enumerate(parts):
        for w in set(own):
            of.setdefault(w, []).append(k)
    plain: set[str] = set()
    reach = bias.copy()
    for k in sorted((k for k, own in enumerate(parts) if len(own) == 1), key=lambda k: (-rate[k], gain[k].max(), grams[k])):
        word = grams[k]
        more = reach + gain[[j for j in of[word] if set(parts[j]) <= plain | {word}]].sum(axis=0)
        if (more < 0).all():
            plain.add(word)
            reach = more
    return sorted({g for g in grams if " " not in g} - plain)


def sample_paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[str]:
    """Lines of a bounded sample of documents, in the order of a hash of the id."""
    some = docs.select(F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.slice(F.split(text_of(text_col), "\n"), 1, 50).alias("p")).orderBy("h").limit(SAMPLE_DOCS)
    lines = some.select("h", F.posexplode("p").alias("n", "line")).where("length(line) > 0").select("h", "n", F.substring("line", 1, 400).alias("line")).orderBy("h", "n").limit(SAMPLE_PARAGRAPHS)
    return [r.line for r in lines.collect()]


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda p: p != "")


def _tokens(text: Column) -> Column:
    return F.filter(F.split(lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _pairs(words: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 2, F.lit(0))), lambda j: F.concat_ws(" ", F.get(words, j), F.get(words, j + 1)))


def ordinary_counts(docs: DataFrame, text_col: str = "text") -> tuple[dict[str, int], int]:
    """Over all lines that are not notice-like: how many hold each template gram, and how many there are."""
    known = sorted(known_grams())
    lines = docs.select(F.explode(_lines(text_of(text_col))).alias("line")).select(_tokens(F.col("line")).alias("w"))
    grams = lines.select(F.array_distinct(F.filter(F.concat("w", _pairs(F.col("w"))), lambda g: g.isin(known))).alias("g"))
    # templates of few pairs: with fewer than NOTICE known pairs no other one can be held by CONFIRM
    short = [own for own in template_pairs() if own and CONFIRM * len(own) < NOTICE]
    held = [sum((F.array_contains("g", g).cast("int") for g in own), F.lit(0)) >= CONFIRM * len(own) for own in short]
    n_pairs = F.size(F.filter("g", lambda g: g.contains(" ")))
    notice = F.when(n_pairs == 0, False).when(n_pairs >= NOTICE, True).otherwise(reduce(lambda a, b: a | b, held))
    # no filter on g: pushed below, it would compute g once for each mention
    plain = grams.select(F.explode(F.when(notice, F.array().cast("array<string>")).otherwise(F.concat("g", F.array(F.lit(""))))).alias("gram"))  # the empty gram counts the lines
    found = {r["gram"]: r["count"] for r in plain.groupBy("gram").count().collect()}
    return found, found.pop("", 0)


def lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licence_scan(docs: DataFrame, model: Licences | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence families named in each document's paragraphs: its lines, and passages of several lines.

    Without one of the model's telling words no paragraph can score above the
    unknown class, whatever else it holds; such paragraphs, and documents of
    nothing else, are judged unknown by that test. Without a ``model`` one is
    trained on counts over all lines, and the share of ordinary lines above its
    threshold is held to ``FALSE_RATE`` over all of them. For the rest, grams are joined with the model's weights, whose number the templates
    fix, and summed by paragraph; calibrated probabilities choose a family or
    unknown, and a template of that family must lie in the paragraph by
    ``CONFIRM`` of its word pairs.

    Wrapped notices: in each run of non-blank lines, the words of the lines that
    no template confirms alone are judged again in blocks of ``2 * stride()``
    words, the same way.

    Returns doc_id, n_paragraphs, n_confirmed, n_unconfirmed, families (sorted,
    comma-joined), best_family and best_probability (null without a confirmed
    one). Null and empty texts have no paragraphs. Repeated rows are each scanned.
    """
    spark = docs.sparkSession
    ordinary = None
    if model is None:
        counts, ordinary = ordinary_counts(docs, text_col)
        model = fit_counts(counts, ordinary)
        model.threshold = 0.5  # until all lines are scored
    k = len(model.families)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    telling = F.array(*map(F.lit, model.telling)).cast("array<string>")
    found = F.arrays_overlap(F.split(lower(F.col("text")), "[^a-z0-9]+"), telling)
    flagged = cut(rows.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_paragraphs"), F.when(found, F.split("text", BLANK)).alias("runs")).withColumn("tag", F.monotonically_increasing_id()))
    runs = flagged.where("runs is not null").select("tag", F.posexplode("runs").alias("run", "body"))
    single = runs.select("tag", "run", F.posexplode(_lines(F.col("body"))).alias("n", "line")).select("tag", "run", "n", _tokens(F.col("line")).alias("w"))
    weights = spark.createDataFrame([(g, [float(x) for x in row]) for g, row in zip(model.grams, model.weights, strict=True)] or [("", [0.0] * k)], "gram string, weight array<double>")
    parts = [(f, f"{f}{j}", g, float(len(own))) for f in model.families for j, t in enumerate(TEMPLATES[f]) for own in [sorted({g for g in _grams(t) if " " in g})] for g in own]
    templates = spark.createDataFrame(parts, "family string, template string, gram string, size double")
    key = ["tag", "run", "n"]

    def judge(para: DataFrame) -> DataFrame:
        """Named paragraphs with family and probability; cover is null where no template confirms."""
        every = F.concat("w", _pairs(F.col("w")))
        grams = cut(para.where(F.arrays_overlap("w", telling)).select(*key, F.explode(F.array_distinct(F.filter(every, lambda g: g.isin(model.grams)))).alias("gram")))
        sums = grams.join(F.broadcast(weights), "gram").groupBy(*key).agg(F.count_if(F.col("gram").contains(" ")).alias("n_pairs"), *[F.sum(F.col("weight")[j]).alias(f"m{j}") for j in range(k)])
        margins = F.array(*[(F.col(f"m{j}") + F.lit(float(model.bias[j]))) * F.lit(model.scale) for j in range(k)])
        top = F.greatest(F.lit(0.0), F.array_max("z"))
        total = F.aggregate("z", F.exp(-top), lambda a, z: a + F.exp(z - top))
        named = sums.select(*key, "n_pairs", margins.alias("z")).withColumn("best", F.array_position("z", F.array_max("z")).cast("int")).withColumn("p", F.exp(F.array_max("z") - top) / total)
        names = F.array(*map(F.lit, model.families))
        named = named.where(F.col("p") >= model.threshold).select(*key, "n_pairs", "p", F.element_at(names, F.col("best")).alias("family"))
        shared = grams.join(F.broadcast(templates), "gram").groupBy(*key, "family", "template", "size").agg(F.count(F.lit(1)).alias("shared"))
        confirmed = shared.groupBy(*key, "family").agg(F.max(F.col("shared") / F.col("size")).alias("cover")).where(F.col("cover") >= CONFIRM)
        return cut(named.join(confirmed, [*key, "family"], "left"))

    alone = judge(single)
    if ordinary is not None:
        plain = alone.where((F.col("n_pairs") < NOTICE) & F.col("cover").isNull())
        above, allowed = plain.count(), FALSE_RATE * ordinary
        if above > allowed:
            model.threshold = plain.agg(F.percentile_approx("p", 1 - allowed / above, 1_000_000)).first()[0]
            alone = alone.where(F.col("p") >= model.threshold)
    # blocks of the words of a run's other lines
    done = alone.where("cover is not null").groupBy("tag", "run").agg(F.collect_set("n").alias("done"))
    left = runs.where(F.size(_lines(F.col("body"))) > 1).join(done, ["tag", "run"], "left").withColumn("done", F.coalesce("done", F.array().cast("array<int>")))
    rest = F.filter(_lines(F.col("body")), lambda p, j: ~F.array_contains("done", j))
    wrapped = left.where(F.size(rest) > 1).select("tag", "run", _tokens(F.concat_ws("\n", rest)).alias("w")).where(F.arrays_overlap("w", telling))
    size = stride()
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / F.lit(size)).cast("int") - 2, F.lit(0)))
    blocks = wrapped.select("tag", "run", F.explode(F.transform(starts, lambda b: F.struct(b.alias("n"), F.slice("w", b * size + 1, 2 * size).alias("w")))).alias("b")).select("tag", "run", "b.n", "b.w")
    passages = judge(blocks).where("cover is not null")
    judged = alone.withColumn("line", F.lit(True)).unionByName(passages.withColumn("line", F.lit(False)))
    sure = F.col("cover").isNotNull()
    # blocks overlap: a run's passages count as one paragraph a family, and lines named for it are part of it
    by_run = judged.groupBy("tag", "run", "family").agg(F.count_if(F.col("line") & sure).alias("own"), F.count_if(~sure).alias("parts"), F.max(~F.col("line")).alias("joint"), F.max(F.when(sure, F.col("p"))).alias("p"))
    some = F.col("p").isNotNull()
    best = F.max(F.when(some, F.struct("p", "family")))
    by_doc = by_run.groupBy("tag").agg(F.sum(F.col("own") + F.col("joint").cast("int")).alias("n_confirmed"), F.sum(F.when(F.col("joint"), 0).otherwise(F.col("parts"))).alias("n_unconfirmed"), F.concat_ws(",", F.array_sort(F.collect_set(F.when(some, F.col("family"))))).alias("families"), best.alias("best"))
    out = flagged.drop("runs").join(by_doc, "tag", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_confirmed", zero).alias("n_confirmed"), F.coalesce("n_unconfirmed", zero).alias("n_unconfirmed"), F.coalesce("families", F.lit("")).alias("families"), F.col("best.family").alias("best_family"), F.col("best.p").alias("best_probability"))


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return licence_scan(docs)
