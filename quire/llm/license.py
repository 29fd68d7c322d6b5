"""License scan: a sparse logistic regression over word n-grams of paragraphs, in DataFrame functions only.

A paragraph ends at a blank line (marks of comments don't count) or at a line break behind the end of a sentence, so a
notice wrapped over lines is one paragraph. Words of capitals only keep their case (`MIT` is not `mit`), all others are
lower-cased; the features are the words and word pairs of a paragraph.

Classes are the licence families, `unknown` (a notice of another licence) and other text. The model scores paragraphs
that hold one of CUES, in any case; any other paragraph has no feature and is other text. Weights are fitted on the driver, by
proximal gradient steps with an L1 penalty, to generated notices (OPENERS x names in three casings, TEMPLATES, alone and
within corpus text), notices and opening sentences of licences outside the families, and up to NEGATIVES different corpus
paragraphs that hold a cue and aren't notices (`looks_like_notice`). These are the confusing ones, as German prose with
`mit` once was. The driver gets the n-grams they share with the notices, never texts.

Templates are the names and opening sentences of the families, as sets of word pairs. A paragraph that holds a whole
template gives its family a prior: BOOST-fold steps are added to its logit, as many as fit the left-out rows best.

Calibration: in FOLDS rounds the names of one fold, a fold of the outside licences and one of the negatives are left
out of the fit; from the logits of left-out rows come the prior, the temperature and the bar, the least probability that
gives a family to at most 2 % of notices of licences the model has never seen. The final fit takes all rows. A paragraph
that isn't other text is `unknown` unless its best family's probability reaches the bar and at least CONFIRM of the word
pairs of one of the family's templates occur in it. A name of one word confirms nothing unless an opener's word stands
before it or `licensed` behind it, and `the` before it confirms without giving a prior.

Plan: two scans, each with a search for CUES; no shuffle but the hashes of paragraphs with a cue, no Python.

Edge cases: null or empty text has no paragraph; repeated rows are returned as often as they come; rows without doc_id
keep it null; an empty corpus leaves the generated rows; very long texts are scored whole; of equal logits the family
first in order wins; other columns are not read.
"""

from __future__ import annotations

import json
import re
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NEGATIVES, ROUNDS, RATE, LASSO, CONFIRM, FOLDS, UNSEEN, SEED = 2_000, 240, 2.0, 1e-4, 0.5, 4, 0.02, 3
#: Priors that calibration chooses from, as logits.
BOOSTS = (0.0, 1.0, 2.0, 3.0, 4.0, 6.0, 8.0)

#: Public names of licences.
NAMES = {
    "apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 license"),
    "mit": ("MIT License", "the MIT license", "MIT", "MIT/Expat License"),
    "gpl-3.0": ("GNU General Public License, version 3", "GNU GPL v3", "GPL-3.0-or-later", "GPLv3"),
    "gpl-2.0": ("GNU General Public License, version 2", "GNU GPL v2", "GPL-2.0-only", "GPLv2"),
    "lgpl": ("GNU Lesser General Public License", "GNU LGPL v2.1", "LGPL-3.0", "LGPLv3"),
    "agpl-3.0": ("GNU Affero General Public License", "AGPL-3.0", "GNU AGPL v3", "AGPLv3"),
    "mpl-2.0": ("Mozilla Public License, v. 2.0", "MPL-2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "bsd": ("BSD 3-Clause License", "BSD license", "BSD-2-Clause", "New BSD License", "BSD"),
    "cc-by": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0", "Creative Commons Attribution License"),
    "cc-by-sa": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 License", "CC-BY-SA-3.0", "CC BY-SA", "Creative Commons Attribution-ShareAlike License"),
    "cc-by-nc": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 License", "CC-BY-NC-4.0", "CC BY-NC", "Creative Commons Attribution-NonCommercial License"),
    "cc0": ("CC0 1.0 Universal", "CC0 Public Domain Dedication", "CC0-1.0", "the public domain under CC0"),
    "all-rights-reserved": ("All rights reserved", "All rights are reserved", "All rights reserved by the authors", "All other rights reserved"),
}
#: Public opening sentences of licence texts.
TEMPLATES = {
    "apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",),
    "lgpl": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl-3.0": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file",),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
}
#: Public names of licences outside the families, for the class `unknown` and its calibration.
OUTSIDE = ("ISC License", "zlib License", "Eclipse Public License 2.0", "Boost Software License 1.0", "Artistic License 2.0", "European Union Public Licence 1.2", "SIL Open Font License 1.1", "Microsoft Public License", "Open Database License", "Academic Free License v3.0", "Common Development and Distribution License", "PostgreSQL License", "Python Software Foundation License", "Universal Permissive License", "Mulan Permissive Software License v2", "Acme Community License", "Zorbat Research License", "Foo Bar Evaluation License", "Standard Corpus Licence", "Example Data Use License 3", "Open Data Commons Attribution License", "Open Government Licence", "Unlicense", "Blue Oak Model License 1.0.0")
#: Public opening sentences of licences outside the families.
OUTSIDE_TEXTS = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted",
    "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
)
OPENERS = ("Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}.", "This file is available under the {}.", "Published under {}", "License: {}", "SPDX-License-Identifier: {}", "{}", "Copyright 2021 the authors, {}", "The text may be used under {}.", "Use of this software is governed by the {}.", "Content is available under the {}.", "The code is {} licensed.")
#: Ordinary sentences with cues.
ORDINARY = ("the driver lost his license after the accident", "copyright law in the public domain of science", "a license to operate the plant was granted by the city", "the redistribution of land among the poor", "the Apache and the Mozilla teams met at MIT", "permission is needed to enter the building", "this version is available under the counter", "a book published under her own name", "the album was released under the title of the work", "the state is governed by the law", "GNU is an antelope", "the fishing licence of version 2 and part 3", "creative commons of the village", "all licenses were revoked", "BSD and GPL are words of this text", "the rights reserved for members of the house")
#: Parts of lower-cased text, and of text as it is, without one of which a paragraph is other text; a generated notice
#: with none isn't used.
CUES = ("licen", "gpl", "bsd", "mpl 1", "mpl-1", "mpl 2", "mpl-2", "cc by", "cc-by", "cc0", "apache", "redistribut", "hereby granted", "reserved", "public domain", "unencumbered", "permitted to copy", "express or implied", "under mit", "the mit", "identifier mit", "identifier: mit", "mit/expat")
CASED = ("MIT", "MPL")
FAMILIES = sorted(NAMES)
UNKNOWN, OTHER = len(FAMILIES), len(FAMILIES) + 1
#: Where a paragraph ends (Java and the regex module).
BREAK = r"\n(?:(?<=[.!?][\"')\]*!$%&]{0,4}[ \t\r]{0,2}\n)|(?:[ \t\r#*/;-]*\n)+)"
_WORD = re.compile("[A-Za-z0-9]+")
_UPPER = re.compile("[A-Z][A-Z0-9]+\\Z")


def words(text: str) -> list[str]:
    """The words of ASCII letters and digits; those of at least two capitals or digits keep their case."""
    return [w if _UPPER.match(w) else w.lower() for w in _WORD.findall(text)]


def grams(text: str) -> set[str]:
    """Words and word pairs of a paragraph."""
    w = words(text)
    return {*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))}


def _words(paragraph):
    """words() as a column expression."""
    return F.transform(F.regexp_extract_all(paragraph, F.lit("([A-Za-z0-9]+)"), F.lit(1)), lambda x: F.when(x.rlike("^[A-Z][A-Z0-9]+$"), x).otherwise(F.lower(x)))


def _grams(w):
    """grams(), with repeats, of a column of words."""
    n = F.size(w)
    pairs = F.when(n > 1, F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(1))), F.slice(w, 2, F.greatest(n - 1, F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def _with(rows, keep: list[str], **more):
    """An array of structs with the kept fields and further ones."""
    return F.transform(rows, lambda s: F.struct(*(s[c].alias(c) for c in keep), *(f(s).alias(c) for c, f in more.items())))


def cued(text: str) -> bool:
    low = text.lower()
    return any(c in low for c in CUES) or any(c in text for c in CASED)


def _cued(x):
    any_of = lambda y, cues: reduce(lambda a, b: a | b, (y.contains(c) for c in cues))
    return any_of(x, CASED) | F.exists(F.array(F.lower(x)), lambda low: any_of(low, CUES))  # lowered once, not for each cue


def _clear(name: str) -> bool:
    """Whether a name can stand alone: two words, or letters and digits in one."""
    w = words(name)
    return len(w) > 1 or bool(re.search("[0-9]", name))


def templates() -> dict[str, list[list[str]]]:
    """Per family lists of lower-cased word pairs; a share of one list confirms the family."""
    out = {}
    for f in FAMILIES:
        lists = []
        for t in (*NAMES[f], *TEMPLATES.get(f, ())):
            w = [x.lower() for x in words(t)]
            if w[0] == "the":
                w = w[1:]
            if len(w) > 1:
                lists.append(sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}))
            elif _clear(t):
                lists.append(w)
            else:
                before = [words(o.split("{")[0])[-1].lower() for o in OPENERS if not o.startswith("{") and not o.endswith("{} licensed.")]
                lists += [*([f"{b} {w[0]}"] for b in before), [f"{w[0]} licensed"]]
        unique = []
        for x in lists:
            if x not in unique:
                unique.append(x)
        out[f] = unique
    return out


def strong(lists: list[list[str]]) -> list[list[str]]:
    """Those of a family's lists that give a prior when all of one is there."""
    return [x for x in lists if len(x) > 1 or not x[0].startswith("the ")]


def match(found: set[str], lists: list[list[str]]) -> float:
    """The largest share of one of the lists in the lower-cased n-grams found."""
    low = {x.lower() for x in found}
    return max(sum(x in low for x in t) / len(t) for t in lists)


def looks_like_notice(found: set[str], known: dict[str, list[list[str]]]) -> bool:
    """Whether a corpus paragraph's n-grams confirm a family fully or open as a licence notice does."""
    full = any(match(found, lists) >= 0.99 for lists in known.values())
    # "licensed under", "license identifier" and the like leave no doubt; a lone "license" does.
    opened = {"licensed under", "licenced under", "license identifier", "hereby granted"} & {x.lower() for x in found}
    return bool(full or opened)


def notices() -> list[tuple[str, int, int]]:
    """(text, class, fold) of the generated notices in several casings; templates have fold -1."""
    out = []
    for c, names in [*((FAMILIES.index(f), NAMES[f]) for f in FAMILIES), *((UNKNOWN, (n,)) for n in OUTSIDE)]:
        for k, n in enumerate(names):
            fold = (k if c != UNKNOWN else OUTSIDE.index(n)) % FOLDS
            for i, o in enumerate(OPENERS):
                if o == "{}" and not _clear(n):
                    continue
                out.append((t := o.format(n), c, fold))
                if i % 3 != 2:
                    out.append(((str.upper, str.lower)[i % 3](t), c, fold))
    for c, fold, t in [*((FAMILIES.index(f), -1, t) for f, ts in TEMPLATES.items() for t in ts), *((UNKNOWN, i % FOLDS, t) for i, t in enumerate(OUTSIDE_TEXTS))]:
        w = t.split()
        out += [(x, c, fold) for x in (t, t.upper(), " ".join(w[: len(w) * 2 // 3]), " ".join(w[len(w) // 3 :]))] * 4
    return [x for x in out if cued(x[0])]


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Sparse:
    """Rows of ones at the given columns; a column of its own behind the last keeps every row from being empty."""

    def __init__(self, rows: list[list[int]], columns: int):
        rows = [[*r, columns] for r in rows]
        sizes = np.array([len(r) for r in rows])
        self.shape, self.rows = (len(rows), columns), rows
        self.at = np.concatenate([np.array(r) for r in rows])
        self.starts = np.cumsum(sizes) - sizes
        order = np.argsort(self.at, kind="stable")
        self.of = np.repeat(np.arange(len(rows)), sizes)[order]
        self.present, self.firsts = np.unique(self.at[order], return_index=True)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.vstack([w, np.zeros((1, w.shape[1]), w.dtype)])[self.at], self.starts)

    def transposed_times(self, e: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[1] + 1, e.shape[1]), e.dtype)
        out[self.present] = np.add.reduceat(e[self.of], self.firsts)
        return out[:-1]

    def __getitem__(self, some: np.ndarray) -> Sparse:
        return Sparse([self.rows[i][:-1] for i in np.flatnonzero(some)], self.shape[1])


def _fit(x: Sparse, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts by accelerated proximal gradient steps; classes weigh alike, other text as all families."""
    k = OTHER + 1
    share = np.ones(k)
    share[UNKNOWN], share[OTHER] = 3, len(FAMILIES)
    s = (share / np.maximum(np.bincount(y, minlength=k), 1))[y]
    s = (s / s.sum()).astype(np.float32)
    w, b = np.zeros((x.shape[1], k), np.float32), np.zeros(k, np.float32)
    b[OTHER] = 1
    gold = np.eye(k, dtype=np.float32)[y]
    past_w, past_b = w, b
    for r in range(ROUNDS):
        m = r / (r + 3)
        vw, vb = w + m * (w - past_w), b + m * (b - past_b)
        e = ((_softmax(x.times(vw) + vb) - gold) * s[:, None]).astype(np.float32)
        past_w, past_b = w, b
        w = vw - RATE * x.transposed_times(e)
        w = np.sign(w) * np.maximum(np.abs(w) - RATE * LASSO, 0)
        b = vb - RATE * e.sum(axis=0)
    return w, b


class Model:
    """Weights of the kept n-grams (columns: families, unknown, other), intercepts, temperature and bar."""

    def __init__(self, negatives: list[set[str]]):
        """negatives: n-grams of corpus paragraphs, at least those that notices have too."""
        self.templates = templates()
        rng = np.random.default_rng(SEED)
        made = [(grams(t), c, f) for t, c, f in notices()]
        number = vocabulary()
        plain = [grams(t) & number.keys() for t in ORDINARY]
        context = [*(set(n) & number.keys() for n in negatives), *plain]
        rows = [(g, c, f) for g, c, f in made] + [(g | context[rng.integers(len(context))], c, f) for g, c, f in made]
        rows += [(g, OTHER, i % FOLDS) for i, g in enumerate(context)] + [(g, OTHER, -1) for g in plain]
        x = Sparse([sorted(number[g] for g in r[0]) for r in rows], len(number))
        y, fold = (np.array([r[i] for r in rows]) for i in (1, 2))
        z = np.zeros((len(rows), OTHER + 1))
        for f in range(FOLDS):
            w, b = _fit(x[fold != f], y[fold != f])
            z[fold == f] = x[fold == f].times(w) + b
        held = fold >= 0
        whole = np.array([self.whole(r[0]) for r in rows], float)[held]
        z, yh = z[held], y[held]
        weight = 1 / np.bincount(yh, minlength=OTHER + 1)[yh]  # classes weigh alike
        loss = lambda b, c: -(weight * np.log(_softmax((z + b * whole) / c)[np.arange(len(yh)), yh] + 1e-12)).sum()
        _, self.boost, self.temperature = min((loss(b, c), b, float(c)) for b in BOOSTS for c in np.linspace(0.5, 4, 36))
        z = z + self.boost * whole
        p = _softmax(z / self.temperature)
        at = p.argmax(axis=1)
        self.held_accuracy = float((at == yh)[yh < OTHER].mean())
        wrong = np.sort(p[yh == UNKNOWN, :UNKNOWN].max(axis=1) * (at[yh == UNKNOWN] < UNKNOWN))
        self.bar = max(float(wrong[int(np.ceil((1 - UNSEEN) * len(wrong))) - 1]) + 1e-9, 0.3)
        w, b = _fit(x, y)
        self.intercepts = b.astype(float).tolist()
        self.weights = {g: [round(float(v), 5) for v in w[i]] for g, i in number.items() if np.abs(w[i]).max() > 0}

    def whole(self, found: set[str]) -> list[bool]:
        """By class, whether a paragraph of these n-grams holds a whole template that gives a prior."""
        low = {x.lower() for x in found}
        return [*(any(low.issuperset(x) for x in strong(self.templates[f])) for f in FAMILIES), False, False]


def vocabulary() -> dict[str, int]:
    """The n-grams of the generated notices, numbered."""
    return {g: i for i, g in enumerate(sorted(set().union(*(grams(t) for t, _, _ in notices()))))}


def paragraphs(text):
    """The paragraphs of a text column; none for null or empty text."""
    return F.when(F.length(text) > 0, F.split(text, BREAK)).otherwise(F.array().cast("array<string>"))


def train(documents: DataFrame) -> Model:
    """A model with negatives from up to NEGATIVES different corpus paragraphs with a cue, those with the smallest hash."""
    text = F.col("text").cast("string")
    known = F.from_json(F.lit(json.dumps(sorted(vocabulary()))), "array<string>")
    cued = documents.filter(_cued(text)).select(F.explode(F.filter(paragraphs(text), _cued)).alias("p"))
    cued = cued.select(F.xxhash64("p").alias("h"), _words(F.col("p")).alias("w"))
    cued = cued.select("h", F.array_sort(F.array_intersect(_grams(F.col("w")), known)).alias("g"))
    rows = cued.dropDuplicates(["h"]).orderBy("h", "g").limit(NEGATIVES).collect()
    lists, seen = templates(), {}
    for r in rows:
        if not looks_like_notice(found := set(r["g"]), lists):
            seen[r["h"]] = found
    return Model(list(seen.values()))


def scan(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_licenses, families, licenses (paragraph, family, probability, match) for every row."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = model or train(docs)
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    weights = literal(model.weights, "map<string,array<double>>")
    known = literal([*model.weights], "array<string>")
    compared = literal(sorted({p for lists in model.templates.values() for t in lists for p in t}), "array<string>")
    lists = literal(model.templates, "map<string,array<array<string>>>")
    priors = literal([strong(model.templates[f]) for f in FAMILIES], "array<array<array<string>>>")
    start = F.array(*(F.lit(float(b)) for b in model.intercepts))
    none = F.array(*(F.lit(0.0) for _ in model.intercepts))
    names = F.array(*map(F.lit, [*FAMILIES, "unknown", "other"]))

    def logits(g):
        return F.aggregate(g, start, lambda acc, x: F.zip_with(acc, F.coalesce(F.element_at(weights, x), none), lambda a, b: a + b))

    # one step at a time, so that nothing is computed twice
    cued = F.when(_cued(F.col("text")), F.filter(F.col("all"), _cued)).otherwise(F.array().cast("array<string>"))
    step = F.transform(cued, lambda x: F.struct(x.alias("paragraph"), _words(x).alias("w")))
    step = _with(step, ["paragraph"], w=lambda s: _grams(s["w"]))
    step = _with(step, ["paragraph"], g=lambda s: F.array_intersect(s["w"], known), t=lambda s: F.array_intersect(F.transform(s["w"], F.lower), compared))
    step = _with(step, ["paragraph", "t"], z=lambda s: logits(s["g"]), whole=lambda s: F.transform(priors, lambda own: F.exists(own, lambda x: F.size(F.array_except(x, s["t"])) == 0)))
    step = _with(step, ["paragraph", "t"], z=lambda s: F.zip_with(s["z"], s["whole"], lambda z, w: z + F.when(w, F.lit(model.boost)).otherwise(F.lit(0.0))))
    step = _with(step, ["paragraph", "t", "z"], top=lambda s: F.array_max(s["z"]))
    step = F.filter(step, lambda s: s["top"] > F.element_at(s["z"], -1))
    step = _with(step, ["paragraph", "t", "z", "top"], best=lambda s: F.array_max(F.slice(s["z"], 1, UNKNOWN)))
    step = _with(
        step, ["paragraph", "t", "top", "best"],
        family=lambda s: F.element_at(names, F.array_position(s["z"], s["best"]).cast("int")),
        probability=lambda s: F.exp((s["best"] - s["top"]) / model.temperature) / F.aggregate(s["z"], F.lit(0.0), lambda a, z: a + F.exp((z - s["top"]) / model.temperature)),
    )
    step = _with(step, ["paragraph", "top", "best", "family", "probability"], match=lambda s: F.array_max(F.transform(F.element_at(lists, s["family"]), lambda t: F.size(F.array_intersect(s["t"], t)) / F.size(t))))
    step = F.transform(step, lambda s: F.struct(s["paragraph"].alias("paragraph"), F.when((s["best"] == s["top"]) & (s["probability"] >= model.bar) & (s["match"] >= CONFIRM), s["family"]).otherwise("unknown").alias("family"), s["probability"].alias("probability"), s["match"].alias("match")))
    out = docs.select("doc_id", "text", paragraphs(F.col("text")).alias("all")).select("doc_id", F.size("all").cast("long").alias("n_paragraphs"), step.alias("licenses"))
    return out.select("doc_id", "n_paragraphs", F.size("licenses").cast("long").alias("n_licenses"), F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda s: s["family"]))), ",").alias("families"), "licenses")
