"""License scan: paragraph classifier over sparse word n-grams, confirmed by template comparison. All in SQL functions.

Lines with an anchor word are scored alone and, as notices are wrapped, in windows of the words
around them in their paragraph (the run of non-blank lines; a line of comment marks only is blank).
A softmax regression over words and word pairs gives a family, with an unknown class whose bias is
calibrated on held-back paragraphs; the family stands if the window holds enough of the words of one
of its templates. SPDX identifiers are looked up, not scored. Weights are trained here on varied copies of the
templates and on other text, made sparse by a bound per class, and looked up in a map literal.
Anchor words are derived from the templates, so that no text without one can be confirmed: lines
without them need no scores.
"""

from __future__ import annotations

import json
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices of licence families.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Licensed under CC0 1.0 Universal public domain dedication.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License."],
    "AGPL": ["This program is licensed under the GNU Affero General Public License, version 3.", "You can redistribute it under the terms of the GNU Affero General Public License."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "This project is licensed under the terms of the MIT license."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Proprietary": ["Copyright. All rights reserved.", "This document is proprietary and confidential. Unauthorized copying is strictly prohibited."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense."],
}
FAMILIES = sorted(TEMPLATES)
UNKNOWN = "unknown"
#: What makes a line that no family explains an unknown licence.
MENTION = r"(?i)\b(?:licen[cs]e[ds]?|unlicense|copyright|redistribut\w*|permission|public domain|all rights reserved|creative commons|proprietary|unencumbered|cc0|spdx\w*)\b"
#: Bound of the training paragraphs, of kept weights per class (321 of 1,071 grams stay; of 900 other paragraphs 99.2 % are
#: right with them and 99.1 % with all), the share of template words that confirms, and the least probability.
PARAGRAPHS, WEIGHTS, CONFIRM, CERTAIN = 3000, 40, 0.6, 0.5
WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
#: Words too frequent to look for, where a template leaves the choice (one of them in German).
COMMON = frozenset("a all and any are as at be by for form from in is it mit of or that the this to under use was with without you".split())
#: Words that windows take before and after an anchored line. The longest template has 27 words.
AROUND = (0, 16, 32, 48)
#: SPDX identifiers (small letters) of each family, and a tag with its expression.
SPDX = {
    "Apache-2.0": "apache-2\\.0", "BSD": "bsd-[1234]-clause.*", "CC-BY": "cc-by-[0-9.]+", "CC-BY-NC": "cc-by-nc-[0-9.]+", "CC-BY-SA": "cc-by-sa-[0-9.]+", "CC0": "cc0-1\\.0", "GPL-2.0": "gpl-2\\.0(?:\\+|-only|-or-later)?",
    "GPL-3.0": "gpl-3\\.0(?:\\+|-only|-or-later)?", "LGPL": "lgpl-[0-9.]+(?:\\+|-only|-or-later)?", "AGPL": "agpl-[0-9.]+(?:\\+|-only|-or-later)?", "ISC": "isc", "MIT": "mit", "MPL-2.0": "mpl-2\\.0.*", "Proprietary": "licenseref-proprietary.*", "Unlicense": "unlicense",
}
SPDX_ID = r"[A-Za-z0-9](?:[A-Za-z0-9.+:-]*[A-Za-z0-9+])?"
SPDX_TAG = rf"(?i)SPDX-License-Identifier:\s*(\(*{SPDX_ID}\)*(?:\s+(?:AND|OR|WITH)\s+\(*{SPDX_ID}\)*)*)"


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), text))


def grams_of(words: list[str]) -> list[str]:
    return sorted({*words, *map(" ".join, zip(words, words[1:]))})


def training(n: int = PARAGRAPHS, seed: int = 5) -> list[tuple[list[str], int]]:
    """Varied copies of templates, and other paragraphs (class len(FAMILIES)), some with licence words."""
    rng = random.Random(seed)
    syllables = "an be co de er fi gra hol in ka lo mer no os pre qui ra sen ti und ver".split()
    odd = ["driver's license renewal office", "the license plate was lost", "a licensed doctor and permission slip", "no permission to enter", "copyright law lecture notes", "license to operate heavy machinery",
           "under the terms of the agreement", "licensed under a different version of the rules", "fishing license version", "public library and general public", "released in the spring", "the apache helicopter", "mit students released a song"]
    noise = lambda k: ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(0, k))]
    out = []
    for i in range(n):
        if i % 3 == 0:
            text = noise(40) + (words_of(rng.choice(odd)) if rng.random() < 0.6 else []) + noise(20)
            out.append((text, len(FAMILIES)))
            continue
        k = rng.randrange(len(FAMILIES))
        text = words_of(rng.choice(TEMPLATES[FAMILIES[k]]))
        if len(text) > 12 and rng.random() < 0.4:
            text = text[: rng.randint(10, len(text))]
        out.append((noise(12) + text + noise(12), k))
    return out


@lru_cache(1)
def weights() -> tuple[dict[str, list[float]], list[float]]:
    """Sparse gram weights per class and the biases, the unknown one calibrated on held-back paragraphs."""
    rows = training()
    k = len(FAMILIES) + 1
    count: dict[str, int] = {}
    for text, _ in rows:
        for g in grams_of(text):
            count[g] = count.get(g, 0) + 1
    vocab = {g: i for i, g in enumerate(sorted(g for g, n in count.items() if n >= 8))}
    x = np.zeros((len(rows), len(vocab)), np.float32)
    for r, (text, _) in enumerate(rows):
        for g in grams_of(text):
            if g in vocab:
                x[r, vocab[g]] = 1
    y = np.array([c for _, c in rows])
    cut = len(rows) * 4 // 5
    xt, target = x[:cut], np.eye(k, dtype=np.float32)[y[:cut]]
    w, b = np.zeros((len(vocab), k), np.float32), np.zeros(k, np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(200):
        z = xt @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        gw, gb = xt.T @ (p - target) / cut + 1e-4 * w, (p - target).mean(0)
        mw, mb = 0.9 * mw + gw, 0.9 * mb + gb
        w, b = w - 2.0 * mw, b - 2.0 * mb
    keep = sorted({int(i) for c in range(k) for i in np.argsort(-np.abs(w[:, c]))[:WEIGHTS]})
    names = sorted(vocab, key=vocab.get)
    sparse = {names[i]: [round(float(v), 4) for v in w[i]] for i in keep}
    held, want = x[cut:][:, keep] @ w[keep] + b, y[cut:]
    best, shift = -1.0, 0.0
    for s in np.arange(-2, 6, 0.25):  # the shift of the unknown class that errs least
        z = held.copy()
        z[:, -1] += s
        right = float((z.argmax(1) == want).mean())
        if right >= best:
            best, shift = right, float(s)
    b[-1] += shift
    return sparse, [round(float(v), 4) for v in b]


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def anchors() -> list[str]:
    """Words of which every text that a template can confirm holds at least one.

    A text needs ``CONFIRM`` of a template's words, so it cannot lack as many of them as are listed
    here for that template; the longest words outside of ``COMMON`` are taken.
    """
    out = set()
    for texts in TEMPLATES.values():
        for words in (sorted(set(words_of(t)), key=lambda w: (w in COMMON, -len(w), w)) for t in texts):
            out.update(words[: len(words) - math.ceil(CONFIRM * len(words) - 1e-9) + 1])
    return sorted(out)


#: How mentions begin, in small letters.
STEMS = ("licence", "license", "unlicense", "copyright", "redistribut", "permission", "public", "all rights", "creative", "proprietary", "unencumbered", "cc0", "spdx")


def any_of(words: list[str]) -> str:
    """A pattern of the words as a tree of their letters, so that a place tries one branch a letter."""
    rest: dict[str, list[str]] = {}
    for w in words:
        rest.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + any_of(r) for c, r in sorted(rest.items()) if c]
    if not parts:
        return ""
    return (f"(?:{'|'.join(parts)})" if len(parts) > 1 or "" in rest else parts[0]) + ("?" if "" in rest else "")


def classify(docs: DataFrame, text: str = "text", into: str = "licenses") -> DataFrame:
    """Adds ``into``: array of ``line`` (from 0), ``family``, ``score`` for each confirmed licence notice.

    A notice wrapped over several lines of a paragraph comes out once, at its first anchored line; an
    SPDX tag comes out once for each identifier. ``unknown`` is given to a line that mentions licences
    if in it, and around it, no family is certain and confirmed; other lines are not listed. A window
    counts for a line only if the line adds words of the template. Entries rise by line, those of a
    line by family. Null or empty text: an empty array; a text of any length is scanned whole;
    repeated rows are each classified; equal probabilities: the first family by name. Empty table: no
    rows. Columns of any name stay; only ``into`` is added.
    """
    sparse, bias = weights()
    k = len(FAMILIES)
    table = "map_from_entries(from_json(" + quoted(json.dumps([{"key": g, "value": v} for g, v in sparse.items()])) + ", 'array<struct<key string, value array<double>>>'))"
    groups = [[sorted(set(words_of(x))) for x in TEMPLATES[f]] for f in FAMILIES]
    templates = "from_json(" + quoted(json.dumps(groups)) + ", 'array<array<array<string>>>')"
    start = "array(" + ", ".join(f"{v}D" for v in bias) + ")"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    words = lambda line: f"regexp_extract_all(lower({line}), '[a-z0-9.]*[a-z0-9]', 0)"
    grams = "array_distinct(concat(ws, transform(slice(ws, 1, greatest(size(ws) - 1, 0)), (w, i) -> concat(w, ' ', ws[i + 1]))))"
    logits = f"aggregate(filter({grams}, g -> map_contains_key(model, g)), {start}, (a, g) -> zip_with(a, element_at(model, g), (x, y) -> x + y))"
    soft = "transform(z, v -> exp(v - array_max(z)) / aggregate(z, 0D, (a, x) -> a + exp(x - array_max(z))))"
    share = lambda ws, of: f"array_max(transform({of}, tpl -> size(array_intersect(tpl, {ws})) / CAST(size(tpl) AS DOUBLE)))"
    names = "array(" + ", ".join(map(quoted, FAMILIES)) + ")"
    # family (k: unknown), score and share of the template of the words ``ws``
    sure = f"best < {k} AND p[best] >= {CERTAIN}D AND like >= {CONFIRM}D"
    verdict = f"named_struct('family', IF({sure}, best, {k}), 'score', round(array_max(p), 6), 'like', IF({sure}, like, 0D))"
    like = f"IF(best < {k}, {share('ws', 'known[best]')}, 0D)"
    score = let(logits, "z", let(soft, "p", let("CAST(array_position(p, array_max(p)) - 1 AS INT)", "best", let(like, "like", verdict))))

    # the words before and after line n in its paragraph, the nearest first and last
    most = AROUND[-1]
    blank = lambda y: f"NOT ({y} RLIKE '[\\\\p{{L}}\\\\p{{N}}]')"
    run = lambda near: let(near, "ls", let(f"CAST(array_position(transform(ls, y -> {blank('y')}), true) AS INT)", "e", "IF(e = 0, ls, slice(ls, 1, e - 1))"))
    earlier = f"flatten(transform(reverse({run(f'reverse(slice(lines, greatest(n - {most}, 0) + 1, least(n, {most})))')}), y -> {words('y')}))"
    later = f"flatten(transform({run(f'slice(lines, n + 2, {most})')}, y -> {words('y')}))"
    pairs = "array(" + ", ".join(f"named_struct('x', {x}, 'y', {y})" for x in AROUND for y in AROUND if x + y) + ")"
    cut = "named_struct('b', slice(b, greatest(size(b) - q.x, 0) + 1, least(q.x, size(b))), 'a', slice(a, 1, q.y))"
    windows = f"filter(array_distinct(transform({pairs}, q -> {cut})), v -> size(v.b) + size(v.a) > 0)"
    # a window stands if the line adds to it, and it holds more of the template than the line alone
    gain = "named_struct('like', IF(r.like > without, r.like, 0D), 'short', -size(ws), 'score', r.score, 'family', r.family)"
    without = f"IF(r.family < {k}, {share('rest', 'known[r.family]')}, 1D)"
    judged = let("concat(v.b, own, v.a)", "ws", let(score, "r", let("concat(v.b, v.a)", "rest", let(without, "without", gain))))
    scored = f"transform({windows}, v -> {judged})"
    most_like = let("concat(b, own, a)", "ws", share("ws", "flatten(known)"))
    wide = f"IF({most_like} >= {CONFIRM}D AND {most_like} > alone.like, array_max({scored}), NULL)"
    plain = "named_struct('family', alone.family, 'score', alone.score, 'wide', false)"
    chosen = let(wide, "w", f"IF(w.like > alone.like, named_struct('family', w.family, 'score', w.score, 'wide', true), {plain})")
    around = let(earlier, "b", let(later, "a", chosen))
    one = let(words("line"), "own", let(let("own", "ws", score), "alone", f"IF(alone.like >= 1D, {plain}, {around})"))

    spdx = "CASE " + " ".join(f"WHEN id RLIKE {quoted('^(?:' + SPDX[f] + ')$')} THEN {i}" for i, f in enumerate(FAMILIES)) + f" ELSE {k} END"
    expression = f"regexp_replace(regexp_extract(line, {quoted(SPDX_TAG)}, 1), {quoted(r'(?i)\s+WITH\s+' + SPDX_ID)}, '')"
    ids = f"filter(regexp_extract_all(lower({expression}), {quoted(SPDX_ID)}, 0), id -> id NOT IN ('and', 'or'))"
    tagged = f"transform(array_distinct(transform({ids}, id -> {spdx})), f -> named_struct('family', f, 'score', 1D, 'wide', false))"
    each = f"transform(IF(line RLIKE {quoted(SPDX_TAG)}, {tagged}, array({one})), r -> named_struct('line', n, 'family', r.family, 'score', r.score, 'wide', r.wide))"
    pattern = quoted(rf"(?<![a-z0-9.]){any_of(anchors())}(?![a-z0-9])")
    anchored = f"filter(transform(lines, (line, n) -> named_struct('line', line, 'n', n)), x -> lower(x.line) RLIKE {pattern} OR x.line RLIKE {quoted(MENTION)})"
    found = f"flatten(transform({anchored}, x -> filter({let('x.line', 'line', let('x.n', 'n', each))}, r -> r.family < {k} OR x.line RLIKE {quoted(MENTION)})))"
    # of the windows that found one family in one paragraph the first stays; paragraphs are numbered by a search among blank lines
    blanks = f"filter(transform(lines, (y, n) -> IF({blank('y')}, n, -1)), n -> n >= 0)"
    half = "(a.lo + a.hi) DIV 2"
    step = f"IF(a.lo < a.hi, IF(bs[{half}] < x.line, named_struct('lo', CAST({half} + 1 AS INT), 'hi', a.hi), named_struct('lo', a.lo, 'hi', CAST({half} AS INT))), a)"
    paragraph = f"aggregate(sequence(0, CAST(log2(size(bs) + 1) AS INT) + 1), named_struct('lo', 0, 'hi', size(bs)), (a, i) -> {step}, a -> a.lo)"
    wides = f"array_sort(transform(filter(all, x -> x.wide), x -> named_struct('paragraph', {paragraph}, 'family', x.family, 'line', x.line, 'score', x.score)))"
    firsts = "filter(wides, (x, i) -> i = 0 OR wides[i - 1].paragraph <> x.paragraph OR wides[i - 1].family <> x.family)"
    bare = lambda x: f"transform({x}, x -> named_struct('line', x.line, 'family', x.family, 'score', x.score))"
    single = let(blanks, "bs", let(wides, "wides", f"array_sort(concat({bare('filter(all, x -> NOT x.wide)')}, {bare(firsts)}))"))
    named = f"transform({single}, x -> named_struct('line', x.line, 'family', IF(x.family < {k}, {names}[x.family], '{UNKNOWN}'), 'score', x.score))"
    whole = let("split(t, '\\\\n')", "lines", let(found, "all", named))
    any_line = f"lower(t) RLIKE {quoted('(?<![a-z0-9])(?:' + any_of(sorted({*anchors(), *STEMS})) + ')')}"  # one search passes over other texts
    bound = let(f"coalesce(`{text}`, '')", "t", f"IF({any_line}, {let(table, 'model', let(templates, 'known', whole))}, array())")
    return docs.withColumn(into, F.expr(bound))


def license_report(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row: ``key``, licence paragraphs, sorted families joined by ``|``, unknown mentions, top score.

    Nulls, ties, repeated rows, long texts and the empty table as in ``classify``; other columns are ignored, whatever their names.
    """
    found = F.col("licenses")
    known = F.filter(found, lambda x: x["family"] != UNKNOWN)
    return classify(docs.select(key, text), text).select(
        key,
        F.size(known).cast("bigint").alias("n_license_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(known, lambda x: x["family"]))), "|").alias("families"),
        F.size(F.filter(found, lambda x: x["family"] == UNKNOWN)).cast("bigint").alias("n_unknown"),
        F.array_max(F.transform(known, lambda x: x["score"])).alias("top_score"),
    )
