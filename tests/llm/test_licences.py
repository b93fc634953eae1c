import math
import re

import pytest

from tidewater.llm import licences


@pytest.fixture(scope="module")
def model():
    return licences.train()


def brute(text, model):
    out = []
    for p in re.sub(licences.WRAPPED, " ", text or "").split("\n"):
        if not re.search(licences.MARKERS, p):
            continue
        g = licences.grams(licences.normal_words(p))
        z = [b + sum(model.weights[x][c] for x in g if x in model.weights) for c, b in enumerate(model.intercepts)]
        best = max(range(len(z)), key=lambda c: (z[c], -c))
        prob = 1 / sum(math.exp((v - z[best]) / (licences.SCALE * model.temperature)) for v in z)
        family = model.families[best] if round(prob, 6) >= licences.THRESHOLD else licences.UNKNOWN
        shared = [(sum(x in own for x in g), len(own)) for f, own in model.templates if f == model.families[best]]
        overlap = max((max(n / size, n / max(1, len(g)) if n >= licences.SHARED else 0) for n, size in shared), default=0)
        out.append((p, family, family != licences.UNKNOWN and round(overlap, 6) >= licences.OVERLAP))
    return out


TEXTS = {
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Licensed under the Apache License, Version 2.0.": "apache",
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-SA 2.5": "cc-by-sa",
    "released under the mozilla public license version 2.0": "mpl",
    "distributed under the GNU Lesser General Public License": "lgpl",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "Redistribution and use in source and binary forms are permitted": "bsd",
    "Then the sailor lost his fishing license near the bay": "",
    "The warranty of the boat is a question of liability": "",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation": "lgpl",
    "The software was released for rent under the general licence of the city": "",
}


def test_families(spark, model):
    docs = spark.createDataFrame([(i, f"Some words.\n{t}\nMore words", "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, family string")
    got = {r.doc_id: r.families for r in licences.scan(docs, model).collect()}
    assert got == dict(enumerate(TEXTS.values()))


def test_matches_plain_python(spark, model):
    rows = [*TEXTS, None, "", "\n\n", "license", "LICENSE\nlicence é license\n\nliability", "copyright " * 3000, "ſ license K", "x license.y-z 2.0.1 gpl", "\n".join(TEXTS), list(TEXTS)[0]]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(rows)] + [(None, rows[0], "x", 1), (0, rows[0], "x", 1)], "doc_id long, text string, families string, n int")
    got = licences.paragraphs(docs, model).filter("paragraph is not null").collect()
    want = [(str(i), *x) for i, t in [*enumerate(rows), (None, rows[0]), (0, rows[0])] for x in brute(t, model)]
    assert sorted((str(r.id), r.paragraph, r.family, r.confirmed) for r in got) == sorted(want)
    assert licences.scan(docs, model).count() == len(rows) + 2


#: Notices in words that no example has, and bodies as files have them: family and text.
NOTICES = ["Copyright 2021 A. Writer. Usage is governed by the {}, a copy of which is in the file COPYING.", "{} applies to every file of this folder, see the copyright notice.", "You can use and share the pictures freely (licence: {})", "Made available to everybody; license terms are those of {} or later"]
UNSEEN_NAMES = {"apache": "Apache License 2.0", "bsd": "BSD 2-Clause license", "cc-by": "CC BY 2.0", "cc-by-nc": "CC BY-NC 3.0", "cc-by-sa": "CC BY-SA 3.0", "cc0": "CC0 1.0 dedication", "gpl": "GNU General Public License v2", "lgpl": "GNU LGPL v3", "agpl": "AGPL v3", "mit": "MIT licence", "mpl": "Mozilla Public License 1.1", "isc": "ISC License"}
BODIES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:",
    "isc": "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "gpl": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
}
OTHERS = ["The tenant needs a licence from the landlord to keep a dog.", "All permissions are granted by the head of the department.", "Copyright infringement was the claim of the singer.", "The liability of the carrier is limited by the treaty.", "Two apaches rode along the river.", "This software is licensed, not sold, to the customer named on the invoice.", "Warranty claims go to the shop.", "No part of this book may be copied without permission of the publisher."]


def test_unseen_notices_and_bodies(spark, model):
    """Accuracy and calibration on words that training doesn't have; the README has the figures."""
    rows = [(f, n.format(name)) for f, name in UNSEEN_NAMES.items() for n in NOTICES] + list(BODIES.items()) + [(licences.UNKNOWN, t) for t in OTHERS]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r.id: r for r in licences.paragraphs(docs, model).filter("para = 0").collect()}
    right = [got[i].family == f for i, (f, _) in enumerate(rows) if i in got]
    p = [got[i].probability for i in range(len(rows)) if i in got]
    bins = {}
    for ok, x in zip(right, p, strict=True):
        bins.setdefault(min(int(x * 5), 4), []).append((ok, x))
    error = sum(abs(sum(ok - x for ok, x in b)) for b in bins.values()) / len(p)
    print("candidates", len(got), "of", len(rows), "accuracy", sum(right) / len(right), "calibration error", error, "temperature", model.temperature, "losses", model.losses)
    print([(rows[i][1][:60], rows[i][0], got[i].family, got[i].probability) for i in got if got[i].family != rows[i][0]])
    missed = [t for i, (f, t) in enumerate(rows) if i not in got and f != licences.UNKNOWN]
    assert missed == []
    assert sum(right) / len(right) >= 0.9 and error < 0.2
    # "MIT licence" is no official name, so no template confirms it
    assert [rows[i] for i in got if rows[i][0] not in (licences.UNKNOWN, "mit") and not got[i].confirmed] == []


def test_calibrated_and_sparse(model):
    assert 0.06 < model.temperature < 19 and model.losses[1] <= model.losses[0]
    assert all(any(w) for w in model.weights.values())
    assert sum(w != 0 for ws in model.weights.values() for w in ws) < 0.9 * len(model.weights) * len(model.families)
    trained = {p for _, p, _ in licences.examples()}
    kept = {p for _, p, apart in licences.examples() if apart}
    assert kept and kept < trained and len([1 for _, p, apart in licences.examples() if not apart and p in kept]) == 0


def test_empty_and_native(spark, model):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = licences.scan(docs, model)
    assert out.collect() == []
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_training_paragraph_of_a_family_is_a_candidate(spark, model):
    known = [p for f, p, _ in licences.examples() if f != licences.UNKNOWN]
    docs = spark.createDataFrame(list(enumerate(known)), "doc_id long, text string")
    none = [known[r.doc_id] for r in licences.scan(docs, model).filter("n_candidates = 0").collect()]
    assert none == []
