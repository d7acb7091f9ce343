"""License scans by a trained paragraph classifier.

Paragraphs (lines, and the stretch of consecutive lines over which a notice is wrapped) are scored by multinomial logistic
regression on the presence of word n-grams of license notices, learned from variants of the notices and from paragraphs
of the corpus. Beside the families there is a class for notices of any other license, unknown, learned from those of
licenses outside the list, and one for all other text. A temperature calibrates the probabilities; it is fitted on what
the model was not trained on: variants, whole notices left out in turn, licenses of no family left out in turn, and
paragraphs of the corpus. A prediction is confirmed by how many of the word pairs of one of the license's notices the
paragraph has, and of those pairs that no other license has; other licenses are named beside it if their notices are
there as well, in pairs that the first ones do not account for. An unknown license is never confirmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headwind.llm import kernel as K
from headwind.llm.folds import bounded_sample
from headwind.llm.workers import mapped

#: Documents whose paragraphs stand for anything else at most; variants of a notice; words of an n-gram at most; the
#: part of a notice's word pairs that confirms a prediction; the probability below which a paragraph is unknown.
MOST_DOCS, VARIANTS, LONGEST, CONFIRM, CERTAIN, FOLDS, SEED = 2_000, 60, 3, 0.5, 0.5, 3, 5

# Short notices by which texts usually name their license.
NOTICES = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
        "Apache License Version 2.0, January 2004",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "The MIT License (MIT)",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Released under the GPL version 3.",
        "Licensed under GPLv3.",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "Licensed under GPLv2.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Released under the LGPL.",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal.",
        "This work is dedicated to the public domain.",
    ),
}
# Notices of licenses of no family above, one tuple for each license.
FOREIGN = (
    ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License, version 2.0."),
    ("Distributed under the Boost Software License, Version 1.0.", "Released under the Boost license."),
    ("This software is provided as-is, without any express or implied warranty, under the zlib license.", "Licensed under the zlib License."),
    ("Licensed under the European Union Public Licence, version 1.2.", "Licensed under the EUPL."),
    ("This work is licensed under the Artistic License 2.0.", "Released under the Artistic License."),
    ("The contents of this file are subject to the terms of the Common Development and Distribution License.", "Licensed under the CDDL, version 1.0."),
    ("This Font Software is licensed under the SIL Open Font License, Version 1.1.",),
    ("Licensed under the Microsoft Public License.", "Released under the MS-PL."),
    ("This software is licensed under the PostgreSQL License.",),
    ("Licensed under the Open Software License version 3.0.",),
    ("This database is made available under the Open Database License.",),
    ("Licensed under the Python Software Foundation License.", "Released under the PSF license."),
    ("Released under the University of Illinois Open Source License.",),
)
# Sentences that share words with notices and are none.
OTHERS = (
    "All rights reserved.",
    "This page is about the public and its work.",
    "The driver must carry a valid license at all times.",
    "You may not use this service without permission.",
    "A new version was released under the old name.",
    "General terms and conditions of use apply.",
    "The software is free for any person with a license.",
    "Copyright 2020 by the author.",
    "Published under the terms of our agreement, version 2.",
    "The work of the foundation is public.",
)
UNKNOWN, NONE = "unknown", "none"


def _words(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = K.spans(data, np.array([0, len(data)]), K.ALNUM)
    return K.word_hashes(data, starts, ends)


def _grams(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, segments) of the n-grams of 1 to LONGEST words in each segment."""
    _, left = K.place(at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    hashes, owners = [], []
    for k in range(1, LONGEST + 1):
        keep = left >= k
        hashes.append(K.mix(K.gram_hashes(words, k) + K.U64(k))[keep])
        owners.append(owner[keep])
    return np.concatenate(hashes), np.concatenate(owners)


def _pairs(words: np.ndarray) -> frozenset[int]:
    return frozenset(K.gram_hashes(words, 2)[: max(len(words) - 1, 0)].tolist())


@dataclass
class LicenseModel:
    """keys: feature hashes in order; weights (features, classes): families, UNKNOWN and NONE; notices: pairs by class."""

    families: list[str]
    keys: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray
    temperature: float
    notices: dict[str, list[frozenset[int]]]

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> K.U64(44)).astype(np.int64)] = True
        # Pairs of all notices, and which each notice has; pairs of a class that no other has.
        classes = [*self.families, UNKNOWN]
        self.templates = [(f, x) for f in classes for x in self.notices[f]]
        every = {f: frozenset().union(*self.notices[f]) for f in classes}
        self.alone = {f: every[f].difference(*[every[g] for g in classes if g != f]) for f in classes}
        self.pairs = np.array(sorted(frozenset().union(*every.values())), np.uint64)
        self.has = np.array([[x in t for x in self.pairs.tolist()] for _, t in self.templates])
        self.marks = np.array([[x in self.alone[f] for x in self.pairs.tolist()] for f, _ in self.templates]) & self.has

    def hits(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(segments, features) of a batch, each pair once."""
        hashes, owner = _grams(words, at)
        maybe = np.flatnonzero(self.seen[(hashes >> K.U64(44)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        is_ = self.keys[i] == hashes[maybe]
        pairs = np.unique(owner[maybe[is_]] * len(self.keys) + i[is_])
        return pairs // len(self.keys), pairs % len(self.keys)

    def probabilities(self, segments: np.ndarray, features: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Of the classes for the segments `which`, in order."""
        z = np.zeros((len(which), len(self.intercept)))
        row = np.searchsorted(which, segments)
        ok = (row < len(which)) & (which[np.minimum(row, len(which) - 1)] == segments) if len(which) else np.zeros(len(segments), bool)
        for c in range(z.shape[1]):
            z[:, c] = np.bincount(row[ok], self.weights[features[ok], c], minlength=len(which)) + self.intercept[c]
        z /= self.temperature
        z = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return z / z.sum(1, keepdims=True)

    def confirms(self, own: frozenset[int], family: str) -> bool:
        """Whether these word pairs have CONFIRM of those of one of the family's notices, and of its own among them; of a
        notice without pairs of its own they must have all."""
        for x in self.notices[family]:
            marks = x & self.alone[family]
            if len(own & x) >= (CONFIRM * len(x) if marks else len(x)) and len(own & marks) >= CONFIRM * len(marks):
                return True
        return False

    def named(self, own: frozenset[int], p: np.ndarray) -> list[tuple[str, float, float, bool]]:
        """(family, probability, containment, confirmed) of a paragraph with these word pairs and probabilities of the classes."""
        if 1 - p[-1] < CERTAIN:
            return []
        classes = [*self.families, UNKNOWN]
        share = {f: max(len(own & x) / len(x) for x in self.notices[f]) for f in classes}
        order = sorted(range(len(self.families)), key=lambda c: (-share[self.families[c]], c))
        # Without one likely enough among the classes the license is unknown.
        best = int(p[:-1].argmax()) if p[:-1].max() >= CERTAIN else len(self.families)
        out, known = [], set()
        for c in [best, *(c for c in order if c != best)]:
            f = classes[c]
            sure = f != UNKNOWN and self.confirms(own, f)
            there = any((own & x & self.alone[f] or x <= own) and (2 * len((own & x) - known) >= len(x) or (x <= own and x - known)) for x in self.notices[f])
            if c == best or (sure and there):
                out.append((f, float(p[c]), share[f], sure))
                if sure:
                    known |= set().union(*[x for x in self.notices[f] if len(own & x) >= CONFIRM * len(x)])
        if len(out) > 1 and out[0][0] == UNKNOWN and not any(own & x & self.alone[UNKNOWN] for x in self.notices[UNKNOWN]):
            out = out[1:]  # what made it look unknown is the families that were confirmed
        return out

    def wrapped(self, words: np.ndarray, at: np.ndarray, docs: np.ndarray) -> list[tuple[int, int]]:
        """(first, past) words of stretches over lines without a blank one that hold a notice; docs: that of each line."""
        line = np.repeat(np.arange(len(at) - 1), np.diff(at))
        if len(line) < 2:
            return []
        broken = (np.diff(line) > 1) | (np.diff(docs[line]) != 0)
        run = np.concatenate([[0], np.cumsum(broken)])
        edges = np.flatnonzero(np.concatenate([[True], broken]))
        several = line[np.append(edges[1:], len(line)) - 1] > line[edges]
        hashes = K.gram_hashes(words, 2)[: len(line) - 1]
        i = np.minimum(np.searchsorted(self.pairs, hashes), len(self.pairs) - 1)
        places = np.flatnonzero((self.pairs[i] == hashes) & ~broken & several[run[:-1]])
        which, of = i[places], run[places]
        runs, pairs = np.divmod(np.unique(of * len(self.pairs) + which), len(self.pairs))
        kinds, runs = np.unique(runs, return_inverse=True)
        found = []
        for t, (_, x) in enumerate(self.templates):
            marked = bool(self.marks[t].any())
            least = CONFIRM * len(x) if marked else len(x)
            enough = np.bincount(runs, self.has[t, pairs], len(kinds)) >= least
            if marked:
                enough &= np.bincount(runs, self.marks[t, pairs], len(kinds)) > 0
            for r in kinds[enough].tolist():
                lo, hi = np.searchsorted(of, [r, r + 1])
                mine = lo + np.flatnonzero(self.has[t, which[lo:hi]])
                where, what = places[mine], which[mine].tolist()
                # Twice the notice's words hold it wherever it is wrapped, whatever stands before each line.
                past = np.searchsorted(where, where + 2 * (len(x) + 1)).tolist()
                k = 0
                while k < len(what):
                    if past[k] - k < least or len(set(what[k : past[k]])) < least:
                        k += 1
                        continue
                    k = max(range(k, past[k]), key=lambda m: (len(set(what[m : past[m]])), -m))
                    found.append((int(where[k]), int(where[past[k] - 1]) + 2))
                    k = past[k]
        merged: list[tuple[int, int]] = []
        for lo, hi in sorted(found):
            if merged and lo < merged[-1][1]:
                merged[-1] = (merged[-1][0], max(hi, merged[-1][1]))
            else:
                merged.append((lo, hi))
        return [(lo, hi) for lo, hi in merged if line[lo] < line[hi - 1]]

    def scan(self, data: np.ndarray, offs: np.ndarray) -> list[list[dict]]:
        """For each document the paragraphs with a license: paragraph, family, probability, containment, confirmed.

        A notice over several lines is named at its first one, in place of what its lines alone leave unconfirmed.
        """
        ends = np.flatnonzero(data == 0x0A)
        cuts = np.union1d(offs, ends)
        starts, stops, at = K.spans(data, cuts, K.ALNUM)
        words = K.word_hashes(data, starts, stops)
        segments, features = self.hits(words, at)
        out: list[list[dict]] = [[] for _ in range(len(offs) - 1)]
        docs = np.searchsorted(offs, cuts[:-1], side="right") - 1

        def entry(s: int, family: str, probability: float, share: float, sure: bool) -> dict:
            paragraph = int(np.searchsorted(ends, cuts[s], side="right") - np.searchsorted(ends, offs[docs[s]]))
            return {"paragraph": paragraph, "family": family, "probability": probability, "containment": share, "confirmed": sure}

        which, n = np.unique(segments, return_counts=True)
        which = which[n >= 2]  # one word of a notice says nothing
        p = self.probabilities(segments, features, which)
        lines: dict[int, list[dict]] = {}
        for r in np.flatnonzero(1 - p[:, -1] >= CERTAIN).tolist() if len(which) else []:
            s = int(which[r])
            lines[s] = [entry(s, *x) for x in self.named(_pairs(words[at[s] : at[s + 1]]), p[r])]
        spans = self.wrapped(words, at, docs)
        if spans:
            own_at = np.concatenate([[0], np.cumsum([hi - lo for lo, hi in spans])])
            p = self.probabilities(*self.hits(np.concatenate([words[lo:hi] for lo, hi in spans]), own_at), np.arange(len(spans)))
            for r, (lo, hi) in enumerate(spans):
                s, e = (int(x) for x in np.searchsorted(at, [lo, hi - 1], side="right") - 1)
                here = {x["family"] for k in range(s, e + 1) for x in lines.get(k, []) if x["confirmed"]}
                whole = [entry(s, *x) for x in self.named(_pairs(words[lo:hi]), p[r])]
                sure = [x for x in whole if x["confirmed"]]
                if sure or (not here and any(x["family"] == UNKNOWN for x in whole)):
                    for k in range(s, e + 1):
                        if k in lines:
                            lines[k] = [x for x in lines[k] if x["confirmed"]]
                    lines.setdefault(s, []).extend(x for x in sure or whole if x["family"] not in here)
        for s in sorted(lines):
            out[int(docs[s])].extend(lines[s])
        return out


def _variants(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """The text and variants with words left out, noise around, and other case."""
    words, out = text.split(), [text]
    before = ("", "Copyright (c) 2021 the authors.", "Note:", "This file:", "(c) 2019.", "SPDX:")
    after = ("", "All rights reserved.", "See the file for details.", "Thanks.", "See above.")
    for _ in range(n - 1):
        kept = [w for w in words if rng.random() > 0.12 or len(words) < 5]
        made = f"{before[rng.integers(len(before))]} {' '.join(kept)} {after[rng.integers(len(after))]}"
        out.append(made.upper() if rng.random() < 0.1 else made.lower() if rng.random() < 0.2 else made)
    return out


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, classes: int, ridge: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by gradient steps with momentum."""
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    goal = np.zeros((len(x), classes), np.float32)
    goal[np.arange(len(x)), y] = 1.0
    weight = (weight / weight.sum()).astype(np.float32)
    vw, vb, rate = np.zeros_like(w), np.zeros_like(b), np.float32(2.0)
    for _ in range(250):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        error = (p - goal) * weight[:, None]
        vw, vb = np.float32(0.9) * vw - rate * (x.T @ error + np.float32(ridge) * w), np.float32(0.9) * vb - rate * error.sum(0)
        w, b = w + vw, b + vb
    return w.astype(float), b.astype(float)


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature under which the labels y are likeliest, given the classes' scores z of rows not trained on."""
    scales = np.geomspace(0.2, 5, 60)

    def loss(t: float) -> float:
        q = z / t
        q = q - q.max(1, keepdims=True)
        return float(np.average(np.log(np.exp(q).sum(1)) - q[np.arange(len(q)), y], weights=weight))

    return float(scales[np.argmin([loss(t) for t in scales])])


def _sources(families: list[str]) -> list[tuple[str, int, int]]:
    """(text, class, fold): notices of a family are left out in turn, and so are whole licenses of no family."""
    out = [(t, c, i % FOLDS) for c, f in enumerate(families) for i, t in enumerate(NOTICES[f])]
    out += [(t, len(families), i % FOLDS) for i, own in enumerate(FOREIGN) for t in own]
    return out + [(t, len(families) + 1, i % FOLDS) for i, t in enumerate(OTHERS)]


def _untrained() -> LicenseModel:
    """The classes, their notices and n-grams, without weights."""
    families = sorted(NOTICES)
    notices = {f: [_pairs(_words(t)) for t in NOTICES[f]] for f in families} | {UNKNOWN: [_pairs(_words(t)) for own in FOREIGN for t in own]}
    originals = [_words(t) for t, c, _ in _sources(families) if c <= len(families)]
    keys = np.unique(np.concatenate([_grams(w, np.array([0, len(w)]))[0] for w in originals]))
    return LicenseModel(families, keys, np.zeros((len(keys), len(families) + 2)), np.zeros(len(families) + 2), 1.0, notices)


def _plain_paragraphs(batches: Iterator[pa.RecordBatch], own: LicenseModel) -> Iterator[pa.RecordBatch]:
    """(features, n) of the lines that are no notices, for batches of texts."""
    all_pairs = [x for _, x in own.templates]
    for batch in batches:
        found: dict[tuple[int, ...], int] = {}
        for _, _, data, offs in K.text_batches(batch.column(0)):
            cuts = np.union1d(offs, np.flatnonzero(data == 0x0A))
            starts, stops, at = K.spans(data, cuts, K.ALNUM)
            words = K.word_hashes(data, starts, stops)
            segments, features = own.hits(words, at)
            edges = np.searchsorted(segments, np.arange(len(cuts)))
            plain = np.diff(at) > 0
            for lo, hi in own.wrapped(words, at, np.searchsorted(offs, cuts[:-1], side="right") - 1):
                s, e = np.searchsorted(at, [lo, hi - 1], side="right") - 1
                plain[s : e + 1] = False
            for s in np.flatnonzero(plain).tolist():
                key = tuple(features[edges[s] : edges[s + 1]].tolist())
                if len(key) > 3:
                    has = _pairs(words[at[s] : at[s + 1]])
                    if any(3 * len(has & x) >= len(x) for x in all_pairs):
                        continue
                found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in found], pa.list_(pa.int32())), pa.array(list(found.values()), pa.int64())], names=["features", "n"])


def fit_licenses(blank: LicenseModel, features: list[np.ndarray], n: np.ndarray, seed: int = SEED) -> tuple[LicenseModel, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A model from variants of all notices and sentences, and from paragraphs of other text with the features, n of each.

    Also what the temperature was fitted on: scores of rows that were not trained on, their classes and weights.
    """
    families, rng = blank.families, np.random.default_rng(seed)
    rows = [(v, c, fold, turn) for t, c, fold in _sources(families) for turn, v in enumerate(_variants(t, rng, VARIANTS))]
    x = np.zeros((len(rows) + len(features), len(blank.keys)), np.float32)
    for i, (t, *_) in enumerate(rows):
        w = _words(t)
        x[i, blank.hits(w, np.array([0, len(w)]))[1]] = 1.0
    for i, f in enumerate(features):
        x[len(rows) + i, np.asarray(f, np.int64)] = 1.0
    y = np.array([r[1] for r in rows] + [len(families) + 1] * len(features))
    weight = np.ones(len(y))
    if len(features):
        weight[len(rows) :] = n / n.sum() * len(rows)
    fold = np.concatenate([[r[2] for r in rows], rng.integers(0, FOLDS, len(features))]).astype(int)
    late = np.zeros(len(y), bool)
    late[: len(rows)] = [r[3] >= VARIANTS - VARIANTS // 5 for r in rows]
    z, at = [], []
    for k in range(FOLDS):
        # Trained without fold k and without the last fifth of the other variants; those are what it is asked about.
        out = fold == k
        w, b = _fit(x[~out & ~late], y[~out & ~late], weight[~out & ~late], len(families) + 2)
        for ask in (out, ~out & late):
            z.append(x[ask] @ w + b)
            at.append(np.flatnonzero(ask))
    z, at = np.concatenate(z), np.concatenate(at)
    w, b = _fit(x, y, weight, len(families) + 2)
    asked = (z, y[at], weight[at])
    return LicenseModel(families, blank.keys, w, b, calibrate(*asked), blank.notices), asked


def train_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_docs: int = MOST_DOCS, seed: int = SEED) -> LicenseModel:
    """A model from variants of NOTICES, FOREIGN and OTHERS, and the paragraphs of about most_docs documents, chosen by a hash.

    Paragraphs of the corpus that have a third or more of a notice's word pairs, and lines of wrapped notices, are left out,
    as they may be notices. Null texts are left out; without documents the sentences of OTHERS stand alone for other text;
    repeated paragraphs weigh as often as they occur.
    """
    blank = _untrained()
    shared = docs.sparkSession.sparkContext.broadcast(blank)
    known = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id")).where("text is not null")
    some = bounded_sample(known, most_docs, F.struct("doc_id", "text")).select("text")
    others = mapped(some, lambda it: _plain_paragraphs(it, shared.value), "features array<int>, n bigint").groupBy("features").agg(F.sum("n").alias("n")).toPandas()
    others = others.assign(key=[tuple(x) for x in others["features"]]).sort_values("key", kind="stable")
    return fit_licenses(blank, others["features"].tolist(), others["n"].to_numpy(float), seed)[0]


def scan_licenses(docs: DataFrame, model: LicenseModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, licenses) of every row: the paragraphs (lines from 0) that name licenses, each with family, probability, the largest
    part of a notice's word pairs that it has, and whether that confirms it.

    A null text or one without such a paragraph has an empty array; repeated rows are each scanned; whole texts are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = "array<struct<paragraph:int,family:string,probability:double,containment:double,confirmed:boolean>>"
    arrow = pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("containment", pa.float64()), ("confirmed", pa.bool_())]))

    def run(batches):
        for batch in batches:
            found = [x for _, _, data, offs in K.text_batches(batch.column(1)) for x in shared.value.scan(data, offs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, arrow)], names=["doc_id", "licenses"])

    return mapped(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, licenses {kind}")
