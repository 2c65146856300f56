"""Licence scans: a classifier of paragraphs, confirmed by templates.

The model is a multinomial logistic regression on the presence of word 1- and 2-grams, trained here on the notices
below, on variants of them (words left out, prose around them) and on prose that only sounds alike. A paragraph
without any of STEMS has no features and is no licence; that holds in training too, so the cheap search for stems
that comes first never changes an answer. In turn a fifth of the notices, with all their variants, is kept out of
training; on these, which the model hasn't seen, a temperature is fitted to the probabilities, and the probability
of a family that REFUSED of prose and of notices of no family stay below is the border of the unknown class. The model
used is trained on all notices. A family also has to be confirmed by one of its notices, most of whose 2-grams must be there.

A line with a stem, or at whose end a stem is broken, is scored alone and in all windows of the lines around it, up
to a blank one and as far as the longest notice may reach. So notices wrapped over lines are confirmed too. A window
counts if it shows more of the notice than the lines before and the lines after do without this one.

Scoring joins the few paragraphs' n-grams to the weights, a table whose size the notices fix. All of it is
built-in functions; texts aren't shuffled.
"""

from __future__ import annotations

import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.scratch import stash
from marlstone.llm.text import SPACES

STEMS = ("licen", "lizen", "copyright", "rights reserved", "warrant", "public domain", "redistribut", "permission is", "creative commons", "cc by", "cc-by", "cc0", "gnu ", "spdx", "droits r", "droit d", "domaine public", "rechte vorbehalten", "urheberrecht", "gemeinfrei", "derechos reservados", "derechos de autor", "dominio p", "se concede permiso")
#: A stem of several words with a line break, and marks of comments, in it.
BROKEN = "|".join(x.strip().replace(" ", "[^a-z0-9\n]*\n[^a-z0-9\n]*") + ("[^a-z0-9\n]*\n" if x.endswith(" ") else "") for x in STEMS if " " in x)

NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Publié sous licence MIT.",
        "Veröffentlicht unter der MIT-Lizenz.",
        "Publicado bajo la licencia MIT.",
        "Licensed under the MIT License. See LICENSE in the project root for details.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction.",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Released under the ISC License.",
        "Licensed under the ISC license.",
        "SPDX-License-Identifier: ISC",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "This project is licensed under the terms of the Apache 2.0 license.",
        "Distribué sous la licence Apache, version 2.0.",
        "Lizenziert unter der Apache-Lizenz, Version 2.0.",
        "Distribuido bajo la licencia Apache, versión 2.0.",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "This project is licensed under the terms of the BSD license.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "Licensed under the GPL version 2 or later.",
        "Released under the GPL v3 license.",
        "Distribué sous la licence publique générale GNU, version 3.",
        "Lizenziert unter der GNU General Public License, Version 3.",
        "Distribuido bajo la licencia pública general de GNU, versión 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You can redistribute this library and/or modify it under the terms of the GNU Lesser General Public License.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "Licensed under the LGPL version 3 or later.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "Released under the AGPL v3 license.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License. If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0.",
        "Released under the Mozilla Public License 2.0.",
        "Licensed under the MPL 2.0 license.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "Mis à disposition selon les termes de la licence Creative Commons Attribution 4.0 International.",
        "Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.",
        "Esta obra está bajo una licencia Creative Commons Atribución 4.0 Internacional.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use and redistribution provided that the original author and source are credited.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
        "Content is available under CC BY-SA 3.0 unless otherwise noted.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under the Creative Commons Attribution-NonCommercial License for non commercial use.",
        "Content is available under CC BY-NC 3.0 unless otherwise noted.",
    ],
    "CC0": [
        "Released into the public domain under CC0 1.0.",
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, dedicated by its authors to the public domain, in source code form or as a compiled binary.",
        "Dedicated to the public domain under the Creative Commons Zero license.",
        "Cette œuvre est dans le domaine public.",
        "Dieses Werk ist gemeinfrei.",
        "Esta obra está en el dominio público.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Tous droits réservés.",
        "Alle Rechte vorbehalten.",
        "Todos los derechos reservados.",
        "Copyright 2020 Example Corporation. All rights reserved.",
        "Confidential and proprietary. All rights reserved by the company.",
        "Unauthorized copying or redistribution of this file, via any medium, is strictly prohibited. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the copyright holder. All rights reserved.",
    ],
}
#: Notices of no family here: examples of the unknown class.
OTHERS = [
    "Licensed under the terms of the house licence of the publisher.",
    "Distributed under the Artistic License 2.0.",
    "This font is licensed under the SIL Open Font License, version 1.1.",
    "Licensed under the European Union Public Licence.",
    "Released under the Eclipse Public License.",
    "You may use this data under the terms of the custom data license agreement.",
    "Distributed under the zlib license.",
    "Licensed under the Boost Software License, version 1.0.",
    "This database is made available under the Open Database License.",
    "By downloading this product you accept the end user license agreement.",
    "The licensee may install one copy under the terms of this agreement.",
    "Distribué sous la licence CeCILL.",
    "Lizenziert unter der Lizenz des Verlages.",
    "Publicado bajo la licencia de la editorial.",
    "Usage is governed by a licence between the museum and the visitor.",
    "Released under the terms of a licence that the authors grant on request.",
]
#: Prose that has stems and is no notice.
ALIKE = [
    "The driver showed an expired license and a copyright notice about something else.",
    "He lost his fishing licence last year near the river.",
    "The warrant was signed by the judge in the morning.",
    "Permission is what she asked for before the walk.",
    "The gnu crossed the plain with its herd.",
    "These songs may be in the public domain one day, people say.",
    "A new license plate for the car costs more than the old one.",
    "The state redistributed the land among the farmers.",
    "Copyright law was the topic of the lecture.",
    "Nothing warrants such a price for a used machine.",
    "The licensed plumber came on Monday with two tables reserved for lunch.",
    "The rights reserved for members were discussed at length.",
    "The kettle came with a warranty of two years that nobody read.",
    "They argued over the copyright of a song for most of the evening.",
    "Wealth was redistributed by taxes after the war.",
    "Her driving license and a map lay on the seat.",
    "The pub had lost its licence to sell beer after ten.",
    "His mistake was to think that old letters are in the public domain.",
    "The search warrant named a house that had burnt down years before.",
    "She earned her pilot licence at the age of seventeen.",
    "Il a perdu sa licence de pêche et son droit de vote.",
    "Une licence de taxi coûte cher dans cette ville.",
    "Das Urheberrecht war das Thema der Vorlesung.",
    "Ohne Lizenz darf der Trainer nicht auf den Platz.",
    "Perdió su licencia de pesca el año pasado.",
    "La licencia de obras tarda varios meses.",
]
FILLER = "the of and that here is in a to was with for they we on at day river table word stone when over under green much".split()

#: Variants made of each example, parts that take turns in being kept out of training, and the share of a notice's 2-grams that confirms it.
VARIANTS, FOLDS, CONFIRM, SEED = 6, 5, 0.6, 11
#: The share of prose and of notices of no family, all of which training hasn't seen, that should be given no family.
REFUSED = 0.95
NONE, UNKNOWN = "none", "unknown"


def ngrams(text: str) -> list[str]:
    """Distinct 1- and 2-grams of a paragraph's words; none without a stem. The same as _ngrams in Spark."""
    low = text.lower()
    if not any(s in low for s in STEMS):
        return []
    w = re.findall("[a-z0-9]+", low)
    return sorted(set(w) | {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _variants(text: str, rng: random.Random) -> list[str]:
    out = [text]
    while len(out) < VARIANTS:
        words = [w for w in text.split() if rng.random() > 0.08]
        around = lambda: " ".join(rng.choices(FILLER, k=rng.choice((0, 0, 3, 12))))
        out.append(f"{around()} {' '.join(words)} {around()}".strip())
    return out


class Model:
    """accuracy, precision, coverage: on notices that training hasn't seen, the share of right classes, of right families among
    those given (probability above `least`, before templates confirm them), and of notices of a family that are given one.
    """

    def __init__(self):
        rng = random.Random(SEED)
        self.classes = [NONE, UNKNOWN, *NOTICES]
        groups = [(NONE, ALIKE), (UNKNOWN, OTHERS), *NOTICES.items()]
        # whole notices are kept out, with all their variants
        rows = [(k, i % FOLDS, t) for k, xs in groups for i, x in enumerate(xs) for t in _variants(x, rng) if ngrams(t)]
        y, fold = np.array([self.classes.index(k) for k, _, _ in rows]), np.array([f for _, f, _ in rows])
        scores = np.zeros((len(rows), len(self.classes)))
        for f in range(FOLDS):
            self._train([t for _, g, t in rows if g != f], y[fold != f])
            scores[fold == f] = self.matrix([t for _, g, t in rows if g == f]) @ self.weights + self.bias
        loss = lambda t: -np.log(self.softmax(scores / t)[np.arange(len(y)), y] + 1e-12).mean()
        self.temperature = min((t / 20 for t in range(5, 161)), key=loss)
        p = self.softmax(scores / self.temperature)
        best, sure = p.argmax(axis=1), p[:, 2:].max(axis=1)
        self.least = float(np.quantile(sure[y < 2], REFUSED, method="higher"))
        given = (best > 1) & (sure > self.least)
        self.accuracy, self.precision, self.coverage = float((best == y).mean()), float((best == y)[given].mean()), float(given[y > 1].mean())
        self._train([t for _, _, t in rows], y)

    def _train(self, texts: list[str], y: np.ndarray) -> None:
        self.features = sorted({g for x in texts for g in ngrams(x)})
        self.index = {g: i for i, g in enumerate(self.features)}
        self.weights, self.bias = self._fit(self.matrix(texts), y)

    def matrix(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.features)), np.float32)
        for i, t in enumerate(texts):
            out[i, [self.index[g] for g in ngrams(t) if g in self.index]] = 1
        return out

    @staticmethod
    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, steps: int = 150, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
        hot = np.eye(len(self.classes), dtype=np.float32)[y]
        w, b = np.zeros((x.shape[1], len(self.classes)), np.float32), np.zeros(len(self.classes), np.float32)
        vw, vb, xt = np.zeros_like(w), np.zeros_like(b), np.ascontiguousarray(x.T)
        for _ in range(steps):
            g = (self.softmax(x @ w + b) - hot) / np.float32(len(y))
            vw, vb = np.float32(0.9) * vw - (xt @ g + np.float32(penalty) * w), np.float32(0.9) * vb - g.sum(axis=0)
            w, b = w + vw, b + vb
        return w.astype(np.float64).round(6), b.astype(np.float64).round(6)

    def predict(self, text: str) -> tuple[str, float]:
        """(class, its calibrated probability); a family with no more than `least` is unknown."""
        if not ngrams(text):
            return NONE, 1.0
        p = self.softmax((self.matrix([text]) @ self.weights + self.bias) / self.temperature)[0]
        k = int(p.argmax())
        return (self.classes[k] if k < 2 or p[k] > self.least else UNKNOWN), float(p[k])


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


def _pairs(text: str) -> set[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return {f"{a} {b}" for a, b in zip(w, w[1:], strict=False)}


#: Words of the longest notice.
LONGEST = max(len(re.findall("[a-z0-9]+", x.lower())) for xs in NOTICES.values() for x in xs)


def _has_stem(low: Column) -> Column:
    out = F.lit(False)
    for s in STEMS:
        out |= F.contains(low, F.lit(s))
    return out


def _ngrams(low: Column) -> Column:
    w = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    two = F.filter(F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat_ws(" ", a, F.coalesce(b, F.lit("")))), lambda x: ~F.endswith(x, F.lit(" ")))
    return F.array_distinct(F.concat(w, two))


def _local(spark: SparkSession, **columns: list) -> DataFrame:
    """A small table that is part of the plan."""
    return spark.createDataFrame(pa.table(columns))


def _around(p: Column, back: Column, ahead: Column) -> Column:
    """Windows (a, b, text) of a lines before and b after p; a or b -1: all lines before alone, or all after."""
    text = lambda *parts: F.array_join(F.concat(*parts), " ")
    reach = lambda x: F.filter(F.sequence(F.lit(0), F.size(x)), lambda n: F.size(F.split(F.array_join(F.slice(x, F.lit(1), F.greatest(n - 1, F.lit(0))), " "), " ")) <= LONGEST)
    window = lambda a, b, t: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), t.alias("text"))
    part = lambda x, n: F.slice(x, F.lit(1), n)
    all_of = F.flatten(F.transform(reach(back), lambda a: F.transform(reach(ahead), lambda b: window(a, b, F.when(a + b == 0, p).otherwise(text(F.reverse(part(back, a)), F.array(p), part(ahead, b)))))))
    return F.concat(all_of, F.array(window(F.lit(-1), F.lit(0), text(F.reverse(back))), window(F.lit(0), F.lit(-1), text(ahead))))


def license_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows id, hash (of the text), line, family, probability, confirmed: lines that aren't of class none.

    Lines are numbered from 0; of a notice wrapped over lines those with a stem, or with its start, are given. Null
    and empty texts have none, and no rows give no rows; rows that repeat give one row each line. Null keys stay null.
    A text of any length is searched whole. Of equally good windows the one with fewer lines before decides, of
    equally probable classes the first. Other columns are ignored, whatever their names.
    """
    spark, m = docs.sparkSession, model()
    low = F.lower("t")
    found = docs.select(docs[key].alias("id"), F.xxhash64(docs[text]).alias("hash"), docs[text].alias("t")).where(_has_stem(low) | F.rlike(low, F.lit(BROKEN)))
    found = found.select("id", "hash", F.split(low, "\n").alias("ls"))
    ls, n = F.col("ls"), F.size("ls")
    broken = lambda i: F.rlike(F.concat(ls[i], F.lit("\n"), F.coalesce(F.get(ls, i + 1), F.lit(""))), F.lit(BROKEN))
    words = lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0))
    first = lambda x: F.array_join(F.slice(words(x), F.lit(1), F.lit(LONGEST)), " ")
    last = lambda x: F.array_join(F.reverse(F.slice(F.reverse(words(x)), F.lit(1), F.lit(LONGEST))), " ")
    unbroken = lambda x: F.slice(x, F.lit(1), F.coalesce(F.nullif(F.array_position(x, F.lit("")), F.lit(0).cast("long")).cast("int") - 1, F.size(x)))
    before = lambda i: F.reverse(F.slice(ls, F.greatest(i - LONGEST, F.lit(0)) + 1, F.least(i, F.lit(LONGEST))))
    after = lambda i: F.slice(ls, i + 2, F.lit(LONGEST))
    at = F.filter(F.sequence(F.lit(0), n - 1), lambda i: _has_stem(ls[i]) | broken(i))
    context = F.transform(at, lambda i: F.struct(i.alias("line"), ls[i].alias("p"), unbroken(F.transform(before(i), last)).alias("back"), unbroken(F.transform(after(i), first)).alias("ahead")))
    line = found.select("id", "hash", F.explode(context).alias("x")).select("id", "hash", "x.*")
    line = stash(line.dropDuplicates(["id", "hash", "line"]).withColumn("uid", F.monotonically_increasing_id()), "paragraphs")
    place = ["uid", "a", "b"]
    window = line.select("uid", F.explode(_around(F.col("p"), F.col("back"), F.col("ahead"))).alias("x")).select("uid", "x.*")
    grams = window.select(*place, F.explode(_ngrams(F.col("text"))).alias("g"))

    k = len(m.classes)
    weights = _local(spark, f=m.features, w=m.weights.tolist())
    scored = grams.join(F.broadcast(weights), F.col("g") == F.col("f")).groupBy(*place).agg(*(F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(k)))
    scored = window.where((F.col("a") >= 0) & (F.col("b") >= 0) & _has_stem(F.col("text"))).select(*place).join(scored, place, "left")
    scores = F.array(*((F.coalesce(f"s{i}", F.lit(0.0)) + float(m.bias[i])) / m.temperature for i in range(k)))
    scored = scored.select(*place, scores.alias("s")).withColumn("top", F.array_max("s"))
    scored = scored.withColumn("at", F.array_position("s", F.col("top")).cast("int"))
    total = F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    scored = scored.withColumn("probability", 1 / total).withColumn("family", F.element_at(F.array(*map(F.lit, m.classes)), F.col("at")))

    notices = [(f, i, g, len(_pairs(x))) for f, xs in NOTICES.items() for i, x in enumerate(xs) for g in sorted(_pairs(x))]
    table = _local(spark, **dict(zip(("nf", "ni", "ng", "nn"), map(list, zip(*notices, strict=True)), strict=True)))
    share = grams.join(F.broadcast(table), F.col("g") == F.col("ng")).groupBy(*place, "nf", "ni").agg((F.count("*") / F.max("nn")).alias("share"))
    share = share.groupBy(*place, "nf").agg(F.max("share").alias("share")).withColumnRenamed("nf", "family")
    without = share.where((F.col("a") < 0) | (F.col("b") < 0)).groupBy("uid", "family").agg(F.max("share").alias("without"))
    out = scored.join(share, [*place, "family"], "left").join(without, ["uid", "family"], "left")
    alone, zero = (F.col("a") == 0) & (F.col("b") == 0), F.lit(0.0)
    sure = ~F.col("family").isin(NONE, UNKNOWN) & (F.col("probability") > m.least) & (F.coalesce("share", zero) >= CONFIRM)
    out = out.withColumn("sure", sure).where(alone | (F.col("sure") & (F.col("share") > F.coalesce("without", zero))))
    best = F.struct("sure", F.when(F.col("sure"), F.col("share")).otherwise(zero), -F.col("a") - F.col("b"), "probability", "family", "a")
    out = line.select("uid", "id", "hash", "line").join(out.groupBy("uid").agg(F.max_by(F.struct("family", "probability", "sure"), best).alias("x")), "uid").select("id", "hash", "line", "x.*")
    family = F.when(F.col("sure") | F.col("family").isin(NONE, UNKNOWN), F.col("family")).otherwise(F.lit(UNKNOWN))
    return out.where(F.col("family") != NONE).select("id", "hash", "line", family.alias("family"), "probability", F.col("sure").alias("confirmed"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_paragraphs (lines that aren't blank), n_license, n_unknown, families (confirmed ones)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = license_paragraphs(docs).groupBy("id", "hash").agg(
        F.count("*").alias("n_license"),
        F.count(F.when(~F.col("confirmed"), 1)).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
    )
    hits = stash(hits, "licences")  # the files' size tells the join whether it may broadcast
    blank = lambda x: F.btrim(x, F.lit(SPACES)) == ""
    lines = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: ~blank(x))).cast("long")
    mine = docs.select("doc_id", F.xxhash64("text").alias("h"), lines.alias("n_paragraphs"))
    out = mine.join(hits, mine["doc_id"].eqNullSafe(hits["id"]) & (mine["h"] == hits["hash"]), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_paragraphs", F.coalesce("n_license", zero).alias("n_license"), F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))
