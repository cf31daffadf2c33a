"""License scans: a trained paragraph classifier, with DataFrame functions on all paths over documents.

A multinomial logistic regression over sparse word 1- and 2-grams tells licence families and an unknown class
apart. It is trained by this module on variants of the notices below (words dropped, foreign words around
them) against prose: other uses of the same words, and paragraphs of at most about SAMPLE documents of the
corpus (by text hash; a documented bound). Small weights are cut to 0. A temperature and the least
probability that counts as known are calibrated on variants and prose kept from training. A prediction is
confirmed by comparison with the family's templates: the share of a template's 2-grams that the paragraph
has, or the share of the paragraph's 2-grams that a template has, must reach CONFIRM.

Every n-gram of the model holds a cue: a word of the notices that at most COMMON of all documents use outside
lines about licences, or the rarest word of a notice that has no such word. A paragraph can only reach a family if the weights of its n-grams outweigh the unknown class. ANCHORS are
chosen so that all other n-grams together cannot: texts without an anchor need no scoring. The bound is
exact, so it drops no paragraph that the classifier would report.

Lines that hold half of a template are notices by themselves. The lines left between them and between blank
lines are paragraphs, which a notice may fill by several lines; its span goes from the first to the last line
with CONFIRM of its 2-grams (the word before it included) in the family's templates. What is then left counts if a line is itself part of a
template. A paragraph has one family; of equally likely ones the first as listed. A null text is empty, a very
long one is read whole. Documents are known by doc_id and text hash; rows that agree in both get equal results.
An empty table gives no row (the model is then trained on its own prose). Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled, text_or_empty, written

#: Licence families and notices that name them.
NOTICES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "This software is distributed under the terms of the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "GPL": ("This work is licensed under the GNU General Public License, version 3.", "Released under the GNU GPL version 2 or later.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    "LGPL": ("Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU LGPL version 3.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."),
    "AGPL": ("Licensed under the GNU Affero General Public License, version 3.", "Released under the GNU AGPL version 3."),
    "MPL": ("This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License, Version 2.0."),
    "BSD": ("Licensed under the BSD 3-Clause License.", "Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Released under CC BY 3.0."),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Released under CC BY-NC-SA 4.0."),
    "CC0": ("Released under CC0 1.0.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal dedication."),
    "Proprietary": ("Copyright the authors. All rights reserved.", "All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission of the publisher."),
}
#: Prose that shares words with notices.
PROSE = (
    "A driving license is needed to rent a car.", "The teacher was licensed last year and works in public schools.", "He asked for permission to use the software of the library.",
    "The general public was invited to the foundation.", "The apache helicopter landed near the village.", "She studied at MIT for three years.", "The version of the story that was published in the source is not free.",
    "The warranty of the engine ended.", "The conditions of the permit were met.", "They released the film under a new title.", "All of the commons were attributed to the creative director.",
    "Under the terms of the agreement the work is done by others.", "Copy the file to the library and modify it.", "The rights of the person were reserved for later.", "The public domain of the town lies under the hill.",
)
FAMILIES = (*NOTICES, "unknown")
UNKNOWN = len(NOTICES)
SAMPLE, CONFIRM, SMALL, SHRINK = 100, 0.5, 0.05, 0.001
COMMON = 0.01
ABOUT = "licen[cs]e|copyright|rights reserved|public domain"
_SPLIT = r"[^a-z0-9]+"


def grams(text: str) -> set[str]:
    words = [w for w in re.split(_SPLIT, text.lower()) if w]
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Classifier:
    features: list[str]
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float
    least: float
    anchors: list[str]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        at = {f: i for i, f in enumerate(self.features)}
        z = np.array([self.bias + sum((self.weights[at[g]] for g in grams(t) if g in at), np.zeros(len(FAMILIES))) for t in texts]) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _examples(prose: list[str], rng: np.random.Generator, n: int) -> tuple[list[str], np.ndarray]:
    texts, labels = [], []
    filler = [w for p in (*prose[:400], *PROSE) for w in p.split()] or ["word"]
    around = lambda: " ".join(rng.choice(filler, rng.integers(0, 8)))
    for k, notices in enumerate(NOTICES.values()):
        for _ in range(n):
            words = str(rng.choice(notices)).split()
            kept = [w for w in words if rng.random() > 0.06] if len(words) > 8 else words
            texts.append(f"{around()} {' '.join(kept)} {around()}" if rng.random() < 0.5 else " ".join(kept))
            labels.append(k)
    for _ in range(4 * n):
        texts.append(str(rng.choice(PROSE)) + " " + around())
    texts += [str(x) for x in rng.choice(prose, min(len(prose), 8 * n), replace=False)] if prose else []
    return texts, np.array(labels + [UNKNOWN] * (len(texts) - len(labels)))


def train(prose: list[str], n: int = 60, steps: int = 300, seed: int = 11, uses: dict[str, float] | None = None) -> Classifier:
    """uses: shares of documents that use the notices' words (by default 1 for the words of the prose). Gradient descent with momentum and soft thresholding (an L1 penalty keeps the weights sparse)."""
    rng = np.random.default_rng(seed)
    texts, labels = _examples(prose, rng, n)
    held_texts, held_labels = _examples(prose, rng, n // 2)
    cues = cue_words(dict.fromkeys(_words(prose), 1.0) if uses is None else uses)
    known = sorted(g for x in (*NOTICES.values(), PROSE) for t in x for g in grams(t) if cues & {*g.split()})
    known = list(dict.fromkeys(known))
    at = {g: i for i, g in enumerate(known)}
    x = np.zeros((len(texts), len(known)))
    for i, t in enumerate(texts):
        x[i, [at[g] for g in grams(t) if g in at]] = 1
    y = np.eye(len(FAMILIES))[labels]
    w, b, v, vb = np.zeros((len(known), len(FAMILIES))), np.zeros(len(FAMILIES)), 0.0, 0.0
    for _ in range(steps):
        z = np.einsum("ij,jk->ik", x, w, optimize=True) + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = p / p.sum(axis=1, keepdims=True) - y
        v = 0.9 * v - 2.0 * np.einsum("ij,ik->jk", x, g, optimize=True) / len(x)
        vb = 0.9 * vb - 2.0 * g.mean(axis=0)
        w, b = w + v, b + vb
        w = np.sign(w) * np.maximum(np.abs(w) - SHRINK, 0)
    w[np.abs(w) < SMALL] = 0
    c = Classifier(known, w, b, 1.0, 0.5, [])
    # The temperature of the least loss on held-out examples, then the probability above which none of the
    # prose lies.
    losses = []
    for t in (0.5, 0.7, 1.0, 1.4, 2.0):
        c.temperature = t
        losses.append((-np.log(c.probabilities(held_texts)[np.arange(len(held_texts)), held_labels] + 1e-12).mean(), t))
    c.temperature = min(losses)[1]
    prose_p = c.probabilities([t for t, k in zip(held_texts, held_labels, strict=True) if k == UNKNOWN])[:, :UNKNOWN].max(axis=1)
    c.least = float(np.clip(prose_p.max() + 0.05, 0.5, 0.9))
    # Anchors: n-grams taken by weight until the others cannot lift any family over the unknown class.
    margin = w[:, :UNKNOWN] - w[:, [UNKNOWN]]
    best = np.maximum(margin, 0).max(axis=1)
    start, order = (b[:UNKNOWN] - b[UNKNOWN]), np.argsort(-best, kind="stable")
    chosen = np.zeros(len(known), bool)
    for i in order:
        if (start + np.maximum(margin[~chosen], 0).sum(axis=0) <= 0).all():
            break
        chosen[i] = True
    c.anchors = sorted({w for i in np.flatnonzero(chosen) for w in [next(w for w in known[i].split() if w in cues)]})
    return c


def _words(texts: Iterable[str]) -> list[str]:
    return [w for t in texts for w in re.split(_SPLIT, t.lower()) if w]


def cue_words(uses: dict[str, float]) -> set[str]:
    """Words of the notices that few documents use: every n-gram of the model holds one, which keeps the
    anchors rare. Each notice has one."""
    own = _words(PROSE)
    common = {w for w in own if own.count(w) > 1} | {w for w, share in uses.items() if share > COMMON}
    cues = {w for x in NOTICES.values() for w in _words(x) if len(w) > 1 and not w.isdigit()} - common
    for notice in (t for x in NOTICES.values() for t in x):
        if not cues & {*_words([notice])}:
            cues.add(min(_words([notice]), key=lambda w: (uses.get(w, 0.0), own.count(w), w)))
    return cues


def word_uses(docs: DataFrame) -> dict[str, float]:
    """For each word of the notices the share of all documents that use it outside lines about licences."""
    t = F.lower(text_or_empty())
    t = F.when(t.rlike(ABOUT), F.regexp_replace(t, f"(?m)^.*(?:{ABOUT}).*$", "")).otherwise(t)
    listed = F.array(*[F.lit(w) for w in sorted({w for x in NOTICES.values() for w in _words(x)})])
    found = F.array_append(F.array_intersect(F.split(t, _SPLIT), listed), F.lit(""))  # "": all documents
    n = {r["w"]: r["n"] for r in docs.select(F.explode(found).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: k / n[""] for w, k in n.items() if w}


def prose_sample(docs: DataFrame) -> list[str]:
    """Lines of about SAMPLE documents, chosen by text hash, that are not about licences."""
    rows = sampled(docs.select(text_or_empty().alias("text")), SAMPLE, "text").collect()
    rows = sorted(rows, key=lambda r: r["text"])
    return [x for r in rows for x in r["text"].split("\n") if x.strip() and not re.search(f"(?i){ABOUT}", x)]


def _pairs(words: Column) -> Column:
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(words, i + 1)))


def _two(*templates: str) -> Column:
    return F.array(*[F.lit(g) for g in sorted({g for t in templates for g in grams(t)}) if " " in g])


def _of_family(value: Callable[[tuple[str, ...]], Column], otherwise: Column) -> Column:
    for family, notices in NOTICES.items():
        otherwise = F.when(F.col("family") == family, value(notices)).otherwise(otherwise)
    return otherwise


def paragraphs(docs: DataFrame, model: Classifier) -> DataFrame:
    """(id, hash, start, end, family, probability, confirmed, part) of all lines that reach a family."""
    d = docs.withColumn("low", F.lower("text"))
    some = lambda text: _any(text, model.anchors)
    # One pass over a text's lines keeps those with an anchor and where they start; only these leave the row.
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,line:string>>").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        found = F.array_append(acc["found"], F.struct(acc["at"].alias("start"), line.alias("line")))
        return F.struct((acc["at"] + F.length(line) + 1).alias("at"), F.when(some(F.lower(line)), found).otherwise(acc["found"]).alias("found"))

    lines = F.aggregate(F.split("text", "\n", -1), none, step, lambda acc: acc["found"])
    p = d.where(some(F.col("low"))).select("id", "hash", F.explode(lines).alias("x")).select("id", "hash", "x.start", "x.line").dropDuplicates(["id", "hash", "start"])
    return scored(p.withColumn("end", F.col("start") + F.length("line")), model)


def scored(p: DataFrame, model: Classifier) -> DataFrame:
    """Those of (id, hash, start, end, line) that reach a family: confirmed if they hold a template, part if
    a template holds them."""
    words = F.filter(F.split(F.lower("line"), _SPLIT), lambda x: x != "")
    p = p.withColumn("words", words)
    p = written(p.withColumn("grams", F.array_distinct(F.concat("words", _pairs(F.col("words"))))).drop("words"), "paragraphs")
    spark = p.sparkSession
    used = [i for i in range(len(model.features)) if model.weights[i].any()]
    listed = json.dumps([{"gram": model.features[i], "w": [float(x) for x in model.weights[i]]} for i in used])
    weights = spark.range(1).select(F.explode(F.from_json(F.lit(listed), "array<struct<gram:string,w:array<double>>>")).alias("x")).select("x.*")
    key = ["id", "hash", "start", "end"]
    sums = p.select(*key, F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram").groupBy(*key)
    # At most as many weights as the notices have n-grams: a bounded table.
    z = sums.agg(*[F.sum(F.col("w")[k]).alias(f"z{k}") for k in range(len(FAMILIES))])
    z = p.join(z, key, "left")
    logits = F.array(*[(F.lit(float(b)) + F.coalesce(f"z{k}", F.lit(0.0))) / model.temperature for k, b in enumerate(model.bias)])
    z = z.withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    z = z.withColumn("mass", F.aggregate("logits", F.lit(0.0), lambda acc, x: acc + F.exp(x - F.col("top"))))
    families = F.array(*[F.lit(f) for f in FAMILIES])
    best = F.array_max(F.transform(F.slice("logits", 1, UNKNOWN), lambda x, i: F.struct(x.alias("logit"), (-i).alias("i"))))
    z = z.withColumn("best", best).withColumn("probability", F.exp(F.col("best.logit") - F.col("top")) / F.col("mass"))
    z = z.where(F.col("probability") >= model.least).withColumn("family", F.element_at(families, 1 - F.col("best.i")))
    z = z.withColumn("two", F.filter("grams", lambda x: F.contains(x, F.lit(" "))))
    both = lambda t: F.size(F.array_intersect("two", _two(t)))
    like = _of_family(lambda notices: F.greatest(*[both(t) / F.size(_two(t)) for t in notices], F.lit(0.0)), F.lit(0.0))
    part = _of_family(lambda notices: F.greatest(*[both(t) for t in notices], F.lit(0)), F.lit(0)) / F.greatest(F.size("two"), F.lit(1))
    return z.select(*key, "family", "probability", (like >= CONFIRM).alias("confirmed"), (part >= CONFIRM).alias("part"))


def wrapped(docs: DataFrame, lines: DataFrame, model: Classifier) -> DataFrame:
    """(id, hash, start, end, family, from, to) of the paragraphs of several lines that are notices: the
    notice's span, and the paragraph's. lines: what `paragraphs` gives, whose confirmed lines part paragraphs."""
    own = lines.where("confirmed").groupBy("id", "hash").agg(F.collect_set("start").alias("own"))
    d = docs.where(_any(F.lower("text"), model.anchors)).dropDuplicates(["id", "hash"]).join(own, ["id", "hash"], "left")
    d = d.withColumn("own", F.coalesce("own", F.array().cast("array<int>")))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int,lines:int>>").alias("runs"))

    def step(acc: Column, line: Column, own: Column) -> Column:
        end, runs = acc["at"] + F.length(line), acc["runs"]
        last = F.try_element_at(runs, F.lit(-1))
        more = F.coalesce(last["to"] + 1 == acc["at"], F.lit(False))
        run = F.struct(F.when(more, last["from"]).otherwise(acc["at"]).alias("from"), end.alias("to"), (F.when(more, last["lines"]).otherwise(0) + 1).alias("lines"))
        runs = F.when(F.array_contains(own, acc["at"]) | ~line.rlike(r"\S"), runs).otherwise(F.array_append(F.when(more, F.slice(runs, 1, F.size(runs) - 1)).otherwise(runs), run))
        return F.struct((end + 1).alias("at"), runs.alias("runs"))

    runs = F.aggregate(F.split("text", "\n", -1), none, lambda acc, line: step(acc, line, F.col("own")), lambda acc: acc["runs"])
    p = d.select("id", "hash", "text", F.explode(F.filter(runs, lambda x: x["lines"] > 1)).alias("x"))
    p = p.select("id", "hash", F.col("x.from").alias("start"), F.col("x.to").alias("end"), F.expr("substring(text, x.from + 1, x.to - x.from)").alias("line"))
    p = written(p.where(_any(F.lower("line"), model.anchors)), "runs")
    p = p.join(scored(p, model).where("confirmed or part").select("id", "hash", "start", "end", "family"), ["id", "hash", "start", "end"])
    p = p.withColumn("known", _of_family(lambda notices: _two(*notices), F.array().cast("array<string>")))

    def trim(acc: Column, line: Column, known: Column) -> Column:
        words = F.filter(F.concat(F.array(acc["word"]), F.split(F.lower(line), _SPLIT)), lambda x: x != "")
        two = F.array_distinct(_pairs(words))
        hit = (F.size(two) > 0) & (F.size(F.array_intersect(two, known)) >= CONFIRM * F.size(two))
        end = acc["at"] + F.length(line)
        return F.struct((end + 1).alias("at"), F.when(hit, F.coalesce(acc["a"], acc["at"])).otherwise(acc["a"]).alias("a"), F.when(hit, end).otherwise(acc["b"]).alias("b"), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")).alias("word"))

    nothing = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("a"), F.lit(None).cast("int").alias("b"), F.lit("").alias("word"))
    p = p.withColumn("span", F.aggregate(F.split("line", "\n", -1), nothing, lambda acc, line: trim(acc, line, F.col("known"))))
    start, end = F.col("start") + F.coalesce("span.a", F.lit(0)), F.coalesce(F.col("start") + F.col("span.b"), F.col("end"))
    return p.select("id", "hash", start.alias("start"), end.alias("end"), "family", F.col("start").alias("from"), F.col("end").alias("to"))


def _any(text: Column, words: list[str]) -> Column:
    """Whether a lower-case text has one of the words."""
    if not words:
        return F.lit(False)
    return F.regexp_like(text, F.lit(f"(?<![a-z0-9])(?:{'|'.join(words)})(?![a-z0-9])"))


def license_spans(docs: DataFrame, model: Classifier | None = None) -> DataFrame:
    """doc_id, n_licenses, families and spans (family:start:end, code points) of confirmed paragraphs, and
    n_unconfirmed: paragraphs that reach a family but no template."""
    model = model or train(prose_sample(docs), uses=word_uses(docs))
    t = text_or_empty()
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64(t).alias("hash"), t.alias("text"))
    p = written(paragraphs(d, model), "lines")
    w = written(wrapped(d, p, model), "wrapped")
    inside = w.groupBy("id", "hash").agg(F.collect_list(F.struct("from", "to")).alias("w"))
    p = p.join(inside, ["id", "hash"], "left")
    taken = F.coalesce(F.exists("w", lambda x: (x["from"] <= F.col("start")) & (F.col("end") <= x["to"])), F.lit(False))
    p = p.where(F.col("confirmed") | ~taken).select("id", "hash", "start", "end", "family", (F.col("confirmed") | F.col("part")).alias("confirmed"))
    p = p.unionByName(w.select("id", "hash", "start", "end", "family", F.lit(True).alias("confirmed")))
    found = p.groupBy("id", "hash").agg(
        F.array_sort(F.collect_list(F.when(F.col("confirmed"), F.struct("start", "end", "family")))).alias("found"), F.count_if(~F.col("confirmed")).alias("n_unconfirmed")
    )
    out = d.select("doc_id", "id", "hash").join(written(found, "licences"), ["id", "hash"], "left")
    none = F.array().cast("array<struct<start:int,end:int,family:string>>")
    out = out.withColumn("found", F.coalesce("found", none))
    return out.select(
        "doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["family"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.coalesce("n_unconfirmed", F.lit(0)).cast("long").alias("n_unconfirmed"),
    )
