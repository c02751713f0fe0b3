"""Licence scan: a trained paragraph classifier with an unknown class, confirmed by templates.

Paragraphs are lines with a word, and passages that run over neighbouring lines. Features are the words and word pairs of a paragraph. A multinomial logistic regression with
a mostly L1 penalty tells licence families and ``unknown`` apart; its temperature and the least probability that counts are
set on held-out rows. A family that the model names is confirmed when a template of it is contained in the paragraph, unless
the paragraph holds a word that tells another licence (``BARRED``), lacks the one that tells this licence (``REQUIRED``), or says
that the licence does not hold (``DENIED``).

Training rows come from the templates, each varied by a rule, and from paragraphs of the corpus that carry no licence word, at
most ``UNKNOWN_ROWS`` of them. The model is a table of at most ``VOCABULARY`` features, which is broadcast. Paragraphs in which no
feature can lift a family above unknown are not scored; that is a bound from the weights, so the model would name none of them.

A sentence wrapped at any width is found as well: where a line of a block (lines with a word, none without between them) and
the words that follow it hold a template together, the stretch of words that begins in the line, ends behind it and holds most
of the template is scored like a paragraph, and counts for the line it begins in. It is named only for that template's family.

Null and empty texts have no paragraphs and no families. Repeated rows are scanned each. Only the key and the text are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talkmill.functions.rows import each
from talkmill.llm.common import located, stored, text_or_empty

UNKNOWN = "unknown"
#: Rows of the corpus in training, features of the model, least share of a template's features in a paragraph.
UNKNOWN_ROWS, VOCABULARY, CONTAINED = 2000, 4096, 0.7
#: Held-out precision that the least probability must reach.
PRECISION = 0.99
WORD = r"[a-z0-9][a-z0-9.+-]*[a-z0-9+]|[a-z0-9]"

TEMPLATES = {
    "apache": [
        "licensed under the apache license version 2.0",
        "this file is licensed to you under the apache license version 2.0 you may not use this file except in compliance with the license",
        "spdx-license-identifier apache-2.0",
        "released under the apache license 2.0",
    ],
    "mit": [
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "this project is licensed under the terms of the mit license",
        "spdx-license-identifier mit",
    ],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "use of this source code is governed by a bsd-style license",
        "released under the 3-clause bsd license",
        "released under the 2-clause bsd license",
        "spdx-license-identifier bsd-3-clause",
        "spdx-license-identifier bsd-2-clause",
    ],
    "gpl": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "licensed under the gnu gpl version 2 or later",
        "spdx-license-identifier gpl-3.0-or-later",
    ],
    "agpl": [
        "licensed under the gnu affero general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "spdx-license-identifier agpl-3.0-or-later",
    ],
    "lgpl": [
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it under the terms of the gnu lesser general public license",
        "spdx-license-identifier lgpl-2.1-only",
    ],
    "mpl": [
        "this source code form is subject to the terms of the mozilla public license version 2.0",
        "released under the mozilla public license 2.0",
        "spdx-license-identifier mpl-2.0",
    ],
    "epl": [
        "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0",
        "released under the eclipse public license 2.0",
        "spdx-license-identifier epl-2.0",
    ],
    "isc": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "released under the isc license",
        "spdx-license-identifier isc",
    ],
    "cc-by": [
        "this work is licensed under a creative commons attribution 4.0 international license",
        "licensed under cc by 4.0",
        "available under the creative commons attribution license",
    ],
    "cc-by-sa": [
        "this work is licensed under a creative commons attribution sharealike 4.0 international license",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "licensed under cc by-sa 4.0",
    ],
    "cc-by-nc": [
        "this work is licensed under a creative commons attribution noncommercial 4.0 international license",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "licensed under cc by-nc 4.0",
    ],
    "cc-by-nd": [
        "this work is licensed under a creative commons attribution noderivatives 4.0 international license",
        "this work is licensed under a creative commons attribution-noderivatives 4.0 international license",
        "licensed under cc by-nd 4.0",
    ],
    "cc-by-nc-sa": [
        "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license",
        "this work is licensed under a creative commons attribution-noncommercial-sharealike 4.0 international license",
        "licensed under cc by-nc-sa 4.0",
    ],
    "cc0": [
        "to the extent possible under law the author has waived all copyright and related rights to this work",
        "dedicated to the public domain under cc0 1.0",
    ],
    "proprietary": [
        "all rights reserved",
        "proprietary and confidential",
        "all rights reserved no part of this publication may be reproduced without prior written permission of the publisher",
        "proprietary and confidential unauthorized copying of this file is strictly prohibited",
    ],
}
#: Words that a paragraph of a family does not hold: they tell it from a licence whose text differs in little else.
BARRED = {
    "gpl": ["affero", "agpl", "lesser", "lgpl"], "agpl": ["lesser"], "lgpl": ["affero"], "mit": ["isc"], "isc": ["mit"],
    "cc-by": [
        "sharealike", "noncommercial", "noderivatives", "by-sa", "by-nc", "by-nd", "by-nc-sa", "attribution-sharealike",
        "attribution-noncommercial", "attribution-noderivatives", "attribution-noncommercial-sharealike",
    ],
    "cc-by-sa": ["noncommercial", "noderivatives", "by-nc-sa"], "cc-by-nc": ["sharealike", "noderivatives", "by-nc-sa", "attribution-noncommercial-sharealike"],
    "cc-by-nd": ["noncommercial", "sharealike"], "cc-by-nc-sa": ["noderivatives"],
}
#: Of these, a paragraph of the family holds one.
REQUIRED = {
    "apache": ["apache", "apache-2.0"], "agpl": ["affero", "agpl-3.0-or-later"], "lgpl": ["lesser", "lgpl-2.1-only"], "mpl": ["mozilla", "mpl-2.0"],
    "epl": ["eclipse", "epl-2.0"], "cc-by-sa": ["sharealike", "by-sa", "attribution-sharealike"],
    "cc-by-nc": ["noncommercial", "by-nc", "attribution-noncommercial"], "cc-by-nd": ["noderivatives", "by-nd", "attribution-noderivatives"],
    "cc-by-nc-sa": ["by-nc-sa", "attribution-noncommercial-sharealike", "noncommercial sharealike"],
}
#: Word pairs by which a paragraph says that a licence does not hold.
DENIED = ["not licensed", "not released", "not available", "not under", "not governed", "not subject", "not covered", "no longer"]
#: Sentences around the same words that name no licence.
OTHERS = [
    "the driver needs a license before the trip", "the general public was invited to the work of the foundation",
    "version 2.0 was released under pressure", "he was granted free entry to the software conference",
    "terms of the contract are the following conditions", "a file is a copy of this text", "the work is done in common",
    "this license plate was found under the car", "the museum is open to the public at no charge",
    "we may use the source of the river", "notice of the meeting without modification", "a creative work by an unknown author",
]
BEFORE = ["", "note", "copyright 2021 the authors", "this page is part of the archive", "see below"]
AFTER = ["", "see the license file for details", "https example.org license", "thank you for reading"]


def grams_of(words: Column) -> Column:
    """Distinct words and neighbouring word pairs of a list of words."""
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, pairs))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def grams(text: Column) -> Column:
    """The same for a text."""
    return grams_of(words_of(text))


def variations(sentence: str) -> list[str]:
    """A sentence with words around it, without single words, and twice; always the same list."""
    words = sentence.split()
    cuts = [" ".join(words[:k] + words[k + 1:]) for k in range(len(words))] if len(words) > 5 else []
    framed = [f"{b} {sentence} {a}".strip() for b in BEFORE for a in AFTER]
    return framed + cuts + [f"{sentence}. {sentence}."]


@dataclass(frozen=True)
class Model:
    """Families with unknown at the last place, a weight per family for each feature, and the calibration."""

    families: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    temperature: float
    least: float
    common: dict[str, int]

    def cue_words(self) -> list[str]:
        """Words of which a paragraph must hold one to be given a family.

        For each family, features are left out, common ones first, as long as all of them together could not lift the family
        above unknown. A paragraph without any other feature is unknown; of each other feature the least common word is kept.
        """
        strong = set()
        for k in range(len(self.families) - 1):
            gap = self.intercepts[-1] - self.intercepts[k]
            lifts = {g: w[k] - w[-1] for g, w in self.weights.items() if w[k] > w[-1]}
            for g in sorted(lifts, key=lambda g: (-self.common.get(g, 0), lifts[g])):
                gap -= lifts[g]
                if gap <= 1e-3:
                    strong.add(g)
        return sorted({min(g.split(" "), key=lambda w: (self.common.get(w, 0), -len(w))) for g in strong})


def training_rows(spark: SparkSession, docs: DataFrame, text: str = "text", limit: int = UNKNOWN_ROWS) -> DataFrame:
    """family, text: varied templates, other sentences, and at most ``limit`` paragraphs of the corpus without a licence word.

    The paragraphs come from the ``limit`` distinct texts with the smallest hashes of all documents, and are the ``limit`` distinct
    ones with the smallest hashes among theirs; so they are the same however the documents lie in files.
    """
    named = [(f, v) for f, ts in TEMPLATES.items() for t in ts for v in variations(t)]
    named += [(UNKNOWN, v) for o in OTHERS for v in variations(o)]
    rows = spark.createDataFrame(named, "family string, text string")
    body = text_or_empty(text)
    hashed = docs.select(F.xxhash64(body).alias("h"), body.alias("text"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    taken = hashed.filter(F.col("h") <= F.lit(chosen).cast("bigint")).dropDuplicates(["h"])
    lines = taken.select(F.explode(F.split("text", "\n")).alias("text")).filter(
        F.col("text").rlike(r"[^\x20\x09-\x0D]") & ~F.lower("text").rlike(r"licen[sc]e|licensed|copyright|spdx|rights reserved|public domain|cc0|gpl")
    )
    sample = lines.distinct().orderBy(F.xxhash64("text"), "text").limit(limit)
    return rows.unionByName(sample.select(F.lit(UNKNOWN).alias("family"), "text"))


def train(spark: SparkSession, docs: DataFrame, text: str = "text") -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizer

    rows = stored(training_rows(spark, docs, text).withColumn("grams", grams(F.col("text"))), "licence-rows")
    families = [*TEMPLATES, UNKNOWN]
    number = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")).cast("double") - 1
    rows = rows.withColumn("label", number).withColumn("held_out", F.pmod(F.xxhash64("text"), F.lit(5)) == 0)
    counter = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=3, binary=True).fit(rows.filter(~F.col("held_out")))
    made = counter.transform(rows)
    fit = LogisticRegression(family="multinomial", regParam=0.0005, elasticNetParam=0.9, maxIter=60).fit(made.filter(~F.col("held_out")))
    matrix = fit.coefficientMatrix.toArray()
    weights = {g: [round(float(x), 6) for x in matrix[:, k]] for k, g in enumerate(counter.vocabulary) if abs(matrix[:, k]).max() > 1e-6}
    intercepts = [round(float(x), 6) for x in fit.interceptVector.toArray()]
    held = made.filter("held_out").select("label", "grams").collect()  # bounded like the training rows
    scored = []
    for r in held:
        s = list(intercepts)
        for g in r["grams"]:
            if g in weights:
                s = [a + b for a, b in zip(s, weights[g])]
        scored.append((int(r["label"]), s))

    def probabilities(s: list[float], t: float) -> list[float]:
        e = [math.exp((x - max(s)) / t) for x in s]
        return [x / sum(e) for x in e]

    loss = lambda t: -sum(math.log(max(1e-12, probabilities(s, t)[y])) for y, s in scored)
    temperature = min((k / 10 for k in range(2, 41)), key=loss)
    named = sorted(((max(p), p.index(max(p)) == y) for y, s in scored for p in [probabilities(s, temperature)] if p.index(max(p)) != len(families) - 1), reverse=True)
    least, right = 1.0, 0
    for k, (p, ok) in enumerate(named, 1):
        right += ok
        if right >= PRECISION * k:
            least = p
    asked = {w for g in weights for w in [g, *g.split(" ")]}
    seen = rows.filter(F.col("family") == UNKNOWN).select(F.explode("grams").alias("g")).filter(F.col("g").isin(sorted(asked))).groupBy("g").count()
    common = {r["g"]: r["count"] for r in seen.collect()}  # at most three for each feature
    model = Model(families, weights, intercepts, temperature, max(least, 0.5), common)
    if max(intercepts[:-1]) >= intercepts[-1]:
        raise ValueError("unknown does not have the largest intercept")
    return model


@dataclass(frozen=True)
class Shape:
    """A template: its family, its number of words, its features, and some of them of which any text that contains it holds one."""

    family: str
    size: int
    grams: list[str]

    @property
    def rare(self) -> list[str]:
        """More features than a text may lack, so at least one is in it: word pairs, long ones first."""
        lacking = len(self.grams) - math.ceil(CONTAINED * len(self.grams) - 1e-9)
        return sorted(self.grams, key=lambda g: (" " not in g, -len(g), g))[:lacking + 1]


def template_shapes(spark: SparkSession) -> list[Shape]:
    named = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, template string")
    words = words_of(F.col("template"))
    return [Shape(r["family"], r["size"], r["grams"]) for r in named.select("family", F.size(words).alias("size"), grams_of(words).alias("grams")).collect()]


#: Words beside a template's own that a stretch may hold, such as the comment marks of its lines; no more than it has itself.
SLACK = 8


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def wrapped(lines: Column, at: Column, shapes: list[Shape]) -> Column:
    """asked, grams: stretches of words that begin in line ``at`` (from 0), end behind it, and contain a template of ``asked``.

    A template has fewer words than ``reach``, and each further line of a block has one at least. So only the last words of
    the line, the lines behind it and their first words are looked at, and no stretch is missed at any width of lines."""
    reach = max(s.size for s in shapes) + SLACK
    kind = "array<struct<asked:string,grams:array<string>>>"
    none = F.array().cast(kind)

    def more(acc: Column, x: Column) -> Column:
        joined = lambda w: F.struct(F.slice(F.concat(acc["words"], w), 1, reach).alias("words"), (F.size(w) > 0).alias("open"))
        return F.when(acc["open"] & (F.size(acc["words"]) < reach), let(words_of(x["line"]), joined)).otherwise(acc)

    start = F.struct(F.array().cast("array<string>").alias("words"), F.lit(True).alias("open"))
    behind = F.aggregate(F.slice(lines, at + 2, reach), start, more, lambda acc: acc["words"])
    table = F.array(*[F.struct(F.lit(s.family).alias("family"), F.lit(s.size).alias("size"), F.array(*map(F.lit, s.grams)).alias("grams")) for s in shapes])
    rare = F.array(*map(F.lit, sorted({g for s in shapes for g in s.rare})))
    share = lambda t, g: F.size(F.array_intersect(t["grams"], g)) / F.size(t["grams"])

    def best(t: Column, first: Column, both: Column) -> Column:
        """The stretch that holds most of the template, the first of equal ones."""
        size = t["size"] + F.least(F.lit(SLACK), t["size"])
        begins = F.sequence(F.greatest(F.lit(0), F.size(first) - size + 1), F.size(first) - 1)
        stretch = lambda o: let(grams_of(F.slice(both, o + 1, size)), lambda g: F.struct(share(t, g).alias("share"), (-o).alias("o"), g.alias("grams")))
        return F.struct(t["family"].alias("asked"), F.array_max(F.transform(begins, stretch)).alias("best"))

    def found(first: Column, both: Column, g: Column) -> Column:
        near = F.filter(table, lambda t: share(t, g) >= CONTAINED)
        hits = F.filter(F.transform(near, lambda t: best(t, first, both)), lambda x: x["best"]["share"] >= CONTAINED)
        return F.when(F.arrays_overlap(g, rare), F.transform(hits, lambda x: F.struct(x["asked"].alias("asked"), x["best"]["grams"].alias("grams")))).otherwise(none)

    def looked(first: Column, rest: Column) -> Column:
        inner = let(F.concat(first, rest), lambda both: let(grams_of(both), lambda g: found(first, both, g)))
        return F.when((F.size(first) > 0) & (F.size(rest) > 0), inner).otherwise(none)

    def last(words: Column) -> Column:
        return F.slice(words, F.greatest(F.size(words) - reach + 1, F.lit(1)), reach)

    return let(last(words_of(F.element_at(lines, at + 1)["line"])), lambda first: let(behind, lambda rest: looked(first, rest)))


def scan(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, file, row, paragraph (line number), family, probability, contained, confirmed: the paragraphs the model gives a family.

    ``paragraph`` is the line in which it begins; a line may have a row of its own and rows of passages."""
    spark = docs.sparkSession
    n = len(model.families)
    shapes = template_shapes(spark)
    of_templates = sorted({g for r in shapes for g in r.grams} | {w for ws in [*BARRED.values(), *REQUIRED.values()] for w in ws} | set(DENIED))
    number = {g: k for k, g in enumerate(of_templates)}
    # Features of the model and of the templates; what only a template has weighs nothing.
    known = [(g, number.get(g), *model.weights.get(g, [0.0] * n)) for g in sorted({*model.weights, *of_templates})]
    table = spark.createDataFrame(known, "gram string, number int, " + ", ".join(f"w{k} double" for k in range(n)))
    words = model.cue_words()
    pattern = "(?<![a-z0-9])(?:" + "|".join(map(re.escape, words)) + ")(?![a-z0-9])" if words else "(?!)"
    rows = located(docs.select(key, text)).select(F.col(key).alias("key"), F.col("__file").alias("file"), F.col("__row").alias("row"), text_or_empty(text).alias("text"))
    marked = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("line"), F.lower(x).rlike(pattern).alias("cue")))
    rows = each(rows, F.array(marked), "one", "lines", "key", "file", "row").filter(F.exists("lines", lambda x: x["cue"]))
    # Only stretches with a cue can be named, so lines without one in them or in the lines that they reach are left out.
    reach = max(s.size for s in shapes) + SLACK
    near = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda at: F.exists(F.slice("lines", at + 1, reach + 1), lambda x: x["cue"]))
    near = each(rows, near, "n", "paragraph", "key", "file", "row", "lines")
    alone = lambda x: F.when(x["cue"], F.array(F.struct(F.lit(None).cast("string").alias("asked"), grams(x["line"]).alias("grams"))))
    both = F.concat(F.coalesce(alone(F.element_at("lines", F.col("paragraph") + 1)), F.array().cast("array<struct<asked:string,grams:array<string>>>")), wrapped(F.col("lines"), F.col("paragraph"), shapes))
    paragraphs = each(near, both, "part", "x", "key", "file", "row", "paragraph").select("key", "file", "row", "paragraph", "part", "x.asked", "x.grams")
    place = ["key", "file", "row", "paragraph", "part", "asked"]
    hits = paragraphs.select(*place, F.explode("grams").alias("gram")).join(F.broadcast(table), "gram")
    sums = hits.groupBy(*place).agg(*[(F.sum(f"w{k}") + F.lit(model.intercepts[k])).alias(f"s{k}") for k in range(n)], F.collect_set("number").alias("numbers"))
    top = F.greatest(*[F.col(f"s{k}") for k in range(n)])
    total = sum((F.exp((F.col(f"s{k}") - top) / model.temperature) for k in range(1, n)), F.exp((F.col("s0") - top) / model.temperature))
    best = F.array(*[F.struct(F.col(f"s{k}").alias("s"), F.lit(model.families[k]).alias("family")) for k in range(n)])
    named = sums.select(*place, "numbers", F.array_max(best)["family"].alias("family"), (1 / total).alias("probability")).filter(
        (F.col("family") != UNKNOWN) & (F.col("probability") >= model.least) & F.coalesce(F.col("asked") == F.col("family"), F.lit(True))
    )
    by_family = [
        (
            f, [[number[g] for g in r.grams] for r in shapes if r.family == f], [number[g] for g in [*BARRED.get(f, []), *DENIED]],
            [number[g] for g in REQUIRED.get(f, [])],
        )
        for f in TEMPLATES
    ]
    shapes = spark.createDataFrame(by_family, "family string, templates array<array<int>>, against array<int>, required array<int>")
    told = ~F.arrays_overlap("numbers", "against") & ((F.size("required") == 0) | F.arrays_overlap("numbers", "required"))
    share = F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("numbers"))) / F.size(t))
    compared = named.join(F.broadcast(shapes), "family").withColumn("contained", F.array_max(share))
    return compared.select(
        "key", "file", "row", "paragraph", "family", "probability", "contained",
        ((F.col("contained") >= CONTAINED) & told).alias("confirmed"),
    )


def families(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_paragraphs (named ones), families (confirmed, in order): one row per document."""
    placed = located(docs.select(key, text))
    found = scan(placed, model, key, text).groupBy("file", "row").agg(
        F.size(F.collect_set("paragraph")).cast("bigint").alias("n"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families")
    )
    rows = placed.select(key, F.col("__file").alias("file"), F.col("__row").alias("row"))
    return rows.join(stored(found, "licences"), ["file", "row"], "left").select(
        key, F.coalesce("n", F.lit(0).cast("bigint")).alias("n_paragraphs"),
        F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"),
    )
