"""Licence scans: a trained paragraph classifier and template comparison.

A paragraph is a line with the lines that continue it: those that start with a small
letter, or with capitals after capitals, where the line before doesn't end a sentence,
and any after a line whose last 40 characters end none.
Paragraphs with a marker word are turned into word unigrams and bigrams; a multinomial
logistic regression with sparse weights gives each licence family a score;
probabilities are calibrated by a temperature that is fitted on sentences whose frames
and parts were kept out of training; `unknown` is a class of its own, and a family whose
calibrated probability is below THRESHOLD becomes unknown too.

A family is confirmed by its TEMPLATES, official names and texts that the classifier
isn't trained on as such: by one whose n-grams the paragraph has, or one that has those
of the paragraph, in a share of OVERLAP or more.

Training runs on the driver over the fixed phrases below, a few hundred short
examples whatever the input. Scanning is DataFrame operations only: the weights are
a table of bounded size that is broadcast, weights are whole numbers (SCALE-ths),
so sums don't depend on the order of rows.

Defined results: a null or empty text has no paragraphs; a paragraph without a
marker isn't a candidate; a candidate none of whose n-grams was seen in training
is scored by the intercepts; repeated rows are judged one by one; equal scores go
to the family that comes first by name. Other columns aren't read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Weights are multiples of 1 / SCALE.
SCALE = 1 << 20
#: Least calibrated probability of a family.
THRESHOLD = 0.5
#: Least share of a template's n-grams that are in the paragraph, or of the paragraph's
#: n-grams that are in the template, SHARED of them at least.
OVERLAP, SHARED = 0.6, 3
UNKNOWN = "unknown"
#: Words, and runs of words of the licences themselves, without which a paragraph is no
#: candidate. Every training paragraph of a family has one.
MARKERS = (
    r"(?i)licen[sc]|copyright|permission|warrant|redistribut|public domain|creative commons|\b[al]?gpl|\bgnu\b|\bmpl\b|mozilla public|\bapache\b|\bbsd\b|\bcc[ -]by|\bcc0|liab"
    r"|free software foundation|software distributed under|law or agreed|use this file except|with or without|following (?:conditions|disclaimer)|endorse or promote|appropriate credit|provide a link to|remix, transform|must distribute your|associated a work with|should have received a"
    r"|hereby granted|distribute this software|obtaining a copy|documentation files|without limitation the rights|merge, publish|substantial portions|software is provided|express or implied|source code form|can obtain one at|under the terms of the"
)
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: The end of a line that goes on in the next one.
WRAPPED = r"(?<=[^.!?:;\s])[ \t]*\n[ \t]*(?=[a-z])|(?<=[A-Z][A-Z,])[ \t]*\n[ \t]*(?=[A-Z][A-Z])|(?<=[^.!?:;\n]{40}[A-Za-z,])\n(?=[A-Z])"

#: Names of the licence families as notices use them.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL", "AGPL-3.0", "GNU AGPL"],
    "apache": ["Apache License", "Apache License, Version 2.0", "Apache-2.0", "Apache 2.0 license", "Apache Software License"],
    "bsd": ["BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "New BSD License", "Simplified BSD License"],
    "cc-by": ["Creative Commons Attribution License", "CC BY 4.0", "CC-BY 3.0", "Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Creative Commons Attribution-NonCommercial License", "CC BY-NC 4.0", "CC BY-NC 2.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0"],
    "cc-by-sa": ["Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC-BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0": ["CC0 1.0", "Creative Commons Zero", "CC0 1.0 Universal public domain dedication", "CC0"],
    "gpl": ["GNU General Public License", "GNU GPL", "GPLv3", "GPL", "GNU General Public License, version 3", "GPL-2.0"],
    "isc": ["ISC License", "ISC license terms"],
    "lgpl": ["GNU Lesser General Public License", "GNU LGPL", "LGPL", "LGPL-2.1", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT license", "The MIT License", "MIT/X11 license", "Expat License"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, version 2.0", "MPL 2.0", "MPL-2.0"],
}
#: Sentences in which such names stand; the last ones are for calibration.
CALIBRATING = 5
FRAMES = [
    "{}", "Released under the {}.", "Licensed under {}.", "Licensed under the {}.", "This work is licensed under the {}.", "This work is licensed under {}.",
    "Distributed under the terms of the {}.", "This program is free software; it is distributed under the {}.", "This file is available under the {}.",
    "SPDX-License-Identifier: {}", "License: {}", "The code is published under the {}.", "All content is under {} unless noted otherwise.", "See the {} for details.",
]
#: Sentences of the licences themselves.
SENTENCES = {
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "cc-by": ["You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "cc-by-nc": ["You may not use the material for commercial purposes under this license."],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc0": ["The person who associated a work with this deed has dedicated the work to the public domain by waiving all rights to the work worldwide under copyright law."],
    "gpl": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"],
    "agpl": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    UNKNOWN: [
        "All rights reserved. Copyright 2020.", "Copyright (c) 2019 the authors", "The driver showed a license to the officer.", "He was granted permission to leave early.",
        "A fishing licence is needed on the lake.", "The warranty of the car covers two years.", "No liability is accepted for lost luggage.", "She obtained her medical license in 1990.",
        "The permission of the owner is required.", "Licensed premises open until midnight.", "This product is licensed under a commercial agreement.", "Proprietary license. Do not distribute.",
        "The court held the company liable for damages.", "License plates were checked at the gate.", "Under the licence the firm may sell alcohol.", "The copyright of the photographs belongs to the museum.",
        "Released under the custom license of the firm.", "Licensed under terms that the vendor sets.", "This work is licensed under a private agreement.", "Warranty void if opened.",
        "Distributed under the terms of the sales contract.", "A general public notice was published.", "The mozilla of the story is a lizard under the stone.", "See the manual for details about the license key.",
    ],
}


#: Official short texts and names of the licences that confirm a family.
TEMPLATES = {
    "agpl": ["GNU Affero General Public License", "AGPL", "AGPL-3.0", "You should have received a copy of the GNU Affero General Public License along with this program.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "apache": ["Apache License", "Apache-2.0", "Apache 2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Apache Software License"],
    "bsd": ["BSD License", "BSD-3-Clause", "BSD-2-Clause", "BSD 3-Clause License", "BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."],
    "cc-by": ["CC BY 4.0", "CC-BY", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution License", "You must give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial", "You may not use the material for commercial purposes."],
    "cc-by-sa": ["CC BY-SA 4.0", "CC-BY-SA 4.0", "Creative Commons Attribution-ShareAlike", "If you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "cc0": ["CC0", "CC0 1.0 Universal", "Creative Commons Zero", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law."],
    "gpl": ["GNU General Public License", "GNU GPL", "GPL", "GPLv3", "GPL-2.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program."],
    "isc": ["ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "lgpl": ["GNU Lesser General Public License", "GNU Library General Public License", "GNU LGPL", "LGPL", "LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."],
    "mit": ["MIT License", "Expat License", "MIT/X11", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mpl": ["Mozilla Public License", "MPL 2.0", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
}


def normal_words(text: str) -> list[str]:
    """Lower-cased words; digits count as zero."""
    return re.findall(WORD, re.sub(r"[0-9]+", "0", text.lower()), re.ASCII)


def grams(words: list[str]) -> list[str]:
    """Distinct unigrams and bigrams."""
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


def examples() -> list[tuple[str, str, bool]]:
    """(family, paragraph, whether it is for calibration): names in frames; sentences, whole
    and in overlapping parts as pieces of them occur. Frames and sentences for calibration
    occur in no other example."""
    out = [(family, frame.format(name), i >= len(FRAMES) - CALIBRATING) for family, names in sorted(NAMES.items()) for name in names for i, frame in enumerate(FRAMES)]
    for family, sentences in sorted(SENTENCES.items()):
        for i, s in enumerate(sentences):
            words, apart = s.split(), i % 4 == 3
            out.append((family, s, apart))
            if len(words) > 12:
                third = len(words) // 3
                out += [(family, " ".join(words[a:b]), apart) for a, b in ((0, 2 * third), (third, None), (0, third), (third, 2 * third), (2 * third, None))]
    return out


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[int]]  # n-gram -> a weight for each family
    intercepts: list[int]
    temperature: float
    losses: tuple[float, float]  # mean log loss on the calibration sentences, before and after
    templates: list[tuple[str, set[str]]]  # family, n-grams


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rounds: int = 600, rate: float = 1.0, ridge: float = 1e-3, least: float = 0.02) -> Model:
    """Logistic regression over the fixed examples; weights under `least` are dropped."""
    data = examples()
    families = sorted({f for f, *_ in data})
    sets = [grams(normal_words(p)) for _, p, _ in data]
    features = {g: i for i, g in enumerate(sorted({g for s in sets for g in s}))}
    x = np.zeros((len(data), len(features)))
    for i, s in enumerate(sets):
        x[i, [features[g] for g in s]] = 1
    y = np.array([families.index(f) for f, *_ in data])
    kept_out = np.array([apart for *_, apart in data])

    def fit(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        share = 1 / np.maximum(np.bincount(ys, minlength=len(families)), 1)[ys]
        share /= share.sum()
        w, b = np.zeros((xs.shape[1], len(families))), np.zeros(len(families))
        onehot = np.eye(len(families))[ys]
        for _ in range(rounds):
            slope = (_softmax(xs @ w + b) - onehot) * share[:, None]
            w -= rate * (xs.T @ slope + ridge * w)
            b -= rate * slope.sum(axis=0)
        return w, b

    w, b = fit(x[~kept_out], y[~kept_out])
    z = x[kept_out] @ w + b
    grid = np.geomspace(0.05, 20, 120)
    loss = lambda t: float(-np.log(_softmax(z / t)[np.arange(len(z)), y[kept_out]] + 1e-12).mean())
    temperature = float(min(grid, key=loss))
    w, b = fit(x, y)
    whole = np.round(w * SCALE).astype(int)
    whole[np.abs(w) < least] = 0
    weights = {g: whole[i].tolist() for g, i in features.items() if whole[i].any()}
    templates = [(f, set(grams(normal_words(t)))) for f, ts in sorted(TEMPLATES.items()) for t in ts]
    return Model(families, weights, np.round(b * SCALE).astype(int).tolist(), temperature, (loss(1.0), loss(temperature)), templates)


def weight_table(spark: SparkSession, model: Model) -> DataFrame:
    """(gram, w array<bigint>, t array<int>): weights and templates of each known n-gram."""
    zero = [0] * len(model.families)
    of: dict[str, list[int]] = {}
    for i, (_, own) in enumerate(model.templates):
        for g in own:
            of.setdefault(g, []).append(i)
    rows = [(g, model.weights.get(g, zero), of.get(g, [])) for g in sorted(set(model.weights) | set(of))]
    return spark.createDataFrame(rows, "gram string, w array<bigint>, t array<int>")


def words_of(paragraph: Column) -> Column:
    """normal_words() as an expression; characters outside ASCII separate words."""
    plain = F.regexp_replace(F.lower(paragraph), "[0-9]+", "0")
    return F.regexp_extract_all(plain, F.lit(f"({WORD})"), 1)


def grams_of(words: Column) -> Column:
    """grams() as an expression."""
    pairs = F.transform(F.arrays_zip(words, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))), lambda z: F.concat_ws(" ", z["0"], z["1"]))
    return F.array_distinct(F.concat(words, F.slice(pairs, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0)))))


def paragraphs(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, para, paragraph, family, probability, overlap, confirmed): every
    candidate paragraph, and one row with a null paragraph for a document without.

    `key` names the row of docs, `para` counts its candidates from 0.
    """
    text = F.col(text_col)
    marked = F.when(text.rlike(MARKERS), F.filter(F.split(F.regexp_replace(text, WRAPPED, " "), "\n"), lambda p: p.rlike(MARKERS)))
    base = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("id"), marked.alias("marked"))
    rows = base.select("key", "id", F.posexplode_outer("marked").alias("para", "paragraph"))
    # words are cut once, before they are used several times
    rows = rows.withColumn("grams", F.when(F.col("paragraph").isNotNull(), grams_of(words_of(F.col("paragraph")))))
    rows = rows.select("key", "id", "para", "paragraph", F.size(F.coalesce("grams", F.array())).alias("n"), F.explode_outer("grams").alias("gram"))
    k = len(model.families)
    scored = rows.join(F.broadcast(weight_table(docs.sparkSession, model)), "gram", "left")
    sums = scored.groupBy("key", "id", "para").agg(
        F.first("paragraph").alias("paragraph"),
        F.first("n").alias("n"),
        *[F.coalesce(F.sum(F.get("w", F.lit(c))), F.lit(0)).alias(f"w{c}") for c in range(k)],
        F.flatten(F.collect_list("t")).alias("hits"),
    )
    scores = F.array(*[F.struct((F.col(f"w{c}") + model.intercepts[c]).alias("z"), F.lit(-c).alias("first")) for c in range(k)])
    best = sums.withColumn("best", F.array_max(scores))
    beta = 1.0 / (SCALE * model.temperature)
    total = sum((F.exp((F.col(f"w{c}") + model.intercepts[c] - F.col("best.z")) * beta) for c in range(k)), F.lit(0.0))
    best = best.withColumn("probability", F.round(1 / total, 6))
    name = F.get(F.array(*[F.lit(f) for f in model.families]), -F.col("best.first"))
    family = F.when(F.col("probability") >= THRESHOLD, name).otherwise(UNKNOWN)
    own = [[F.struct(F.lit(i).alias("t"), F.lit(len(g)).alias("size")) for i, (f, g) in enumerate(model.templates) if f == family_] for family_ in model.families]
    kind = "array<struct<t:int,size:int>>"
    mine = F.get(F.array(*[F.array(*x).cast(kind) for x in own]), -F.col("best.first"))
    shared = F.transform(mine, lambda x: F.struct(F.size(F.filter("hits", lambda h: h == x["t"])).alias("n"), x["size"].alias("size")))
    share = F.transform(shared, lambda x: F.greatest(x["n"] / x["size"], F.when(x["n"] >= SHARED, x["n"] / F.greatest("n", F.lit(1))).otherwise(0.0)))
    overlap = F.round(F.coalesce(F.array_max(share), F.lit(0.0)), 6)
    out = best.select("key", "id", "para", "paragraph", family.alias("family"), "probability", overlap.alias("overlap"))
    some = F.col("paragraph").isNotNull()
    return out.select(
        "key", "id", "para", "paragraph", *[F.when(some, F.col(c)).alias(c) for c in ("family", "probability", "overlap")],
        F.when(some, (F.col("family") != UNKNOWN) & (F.col("overlap") >= OVERLAP)).alias("confirmed"),
    )


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_candidates, n_confirmed, n_unconfirmed, n_unknown, families) for every row of docs."""
    named = F.col("family") != UNKNOWN
    return paragraphs(docs, model, id_col, text_col).groupBy("key", "id").agg(
        F.count("paragraph").alias("n_candidates"),
        F.count_if("confirmed").alias("n_confirmed"),
        F.count_if(named & ~F.col("confirmed")).alias("n_unconfirmed"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
    ).drop("key").withColumnRenamed("id", id_col)
