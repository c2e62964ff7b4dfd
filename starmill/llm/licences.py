"""Licence scans: a trained paragraph classifier and a comparison with templates (operator 10)."""

from __future__ import annotations

import random
from itertools import product

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starmill.llm.common import constant_array, kept, read

# Customary notices of licence families, and the texts or headers that their publishers ask for.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "SPDX-License-Identifier: Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "mit": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.", "SPDX-License-Identifier: MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "bsd": ["Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc_by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc_by_sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc_by_nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}
# Notices of no family above, which teach the unknown class.
OTHERS = [
    "Licensed under the terms of the agreement between the parties.", "This work is licensed under a proprietary license.", "Released under our own license.", "All rights reserved.", "Copyright by the authors.",
    "See the license file for details.", "Permission is granted to members only.", "This software is subject to the terms of use of the vendor.", "Redistribution is not permitted.", "Licensed to the public by the publisher.",
    "Licensed under the Eclipse Public License, version 2.0.", "Released under the zlib License.", "This software is distributed under the Boost Software License.", "Licensed under the Artistic License 2.0.", "SPDX-License-Identifier: ISC",
]
# Notices of licences near some of the families above, whose differing words the family's templates don't have.
SIBLINGS = {
    ("gpl", "lgpl"): ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "This work is licensed under the GNU Free Documentation License, version 1.3."],
    ("cc_by", "cc_by_sa", "cc_by_nc"): ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    ("apache",): ["Licensed under the Apache License, Version 1.1."],
}
# Notices in other words than those above, and of licences that are not among them. They calibrate, and teach nothing.
CALIBRATION = [
    ("apache", "This project is available under the Apache License 2.0, see the file for the License text."), ("apache", "Distributed under the Apache License, Version 2.0"), ("mit", "The code is made available under the terms of the MIT License"), ("mit", "MIT License, free of charge to any person"),
    ("gpl", "You may redistribute this under the GNU General Public License version 2 or later"), ("gpl", "Covered by the GNU General Public License, version 3"), ("lgpl", "Linked code is under the GNU Lesser General Public License"), ("bsd", "Use in source and binary forms is permitted under the BSD License"),
    ("mpl", "Files here are subject to the Mozilla Public License, version 2.0"), ("cc_by", "Text is available under a Creative Commons Attribution 4.0 License"), ("cc_by_sa", "Text is available under the Creative Commons Attribution-ShareAlike License"), ("cc_by_nc", "For use under CC BY-NC 4.0 only"),
    ("unknown", "Licensed under the European Union Public Licence"), ("unknown", "This is released under the Do What You Want Public License"), ("unknown", "SPDX-License-Identifier: Unlicense"), ("unknown", "Distributed under the terms of the Common Development and Distribution License"),
    ("unknown", "Use of this material is governed by a license of the company"), ("unknown", "This software is licensed, not sold"), ("unknown", "Licensed under the Open Software License version 3.0"), ("unknown", "Copyright held by the owner, used with permission"),
]
NONE, UNKNOWN = "none", "unknown"
FAMILIES = [*NOTICES, UNKNOWN, NONE]
#: Buckets of word n-grams; documents and lines of the corpus that teach `none`, at most; variants of each notice.
BUCKETS, SAMPLE_DOCS, SAMPLE, VARIANTS = 4096, 1000, 3000, 12
#: Share of a template's word triples that confirms a family, the least calibrated probability of one, and the grid of the calibration's factor.
CONFIRMED, LEAST, FACTORS = 0.5, 0.25, (0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0)
#: Share of the evidence a licence needs that a line must have to be part of a paragraph of several lines.
PART = 0.3
WORDS = r"[\p{L}\p{N}]+"


def let(value: Column, then) -> Column:  # noqa: ANN001
    """then(value), where value is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def ngrams(line: Column, telling: Column | None = None) -> Column:
    """Distinct buckets of the words and of the pairs of neighbours of a line, in lower case; if `telling` is given, those where it holds 1 alone."""
    some = (lambda grams: grams) if telling is None else (lambda grams: F.filter(grams, lambda b: F.get(telling, b) > 0))
    words = F.transform(F.regexp_extract_all(F.lower(line), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))
    pairs = lambda h: F.transform(F.slice(h, F.lit(2), F.greatest(F.size(h) - 1, F.lit(0))), lambda w, i: F.xxhash64(F.get(h, i), w))
    return let(words, lambda h: F.array_distinct(some(F.transform(F.concat(h, pairs(h)), lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")))))


def triples(line: Column) -> Column:
    """Hashes of the distinct runs of three words of a line; of a shorter one all its words."""
    words = F.transform(F.regexp_extract_all(F.lower(line), F.lit(WORDS), F.lit(0)), lambda w: F.xxhash64(w))
    runs = lambda h: F.when(F.size(h) < 3, F.array(F.hash(h).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2))))
    return F.array_distinct(let(words, runs))


def rows(spark: SparkSession, values: list[tuple], names: list[str]) -> DataFrame:
    """A small table of constants."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names, strict=True)]) for row in values]
    return spark.range(1).select(F.explode(F.array(*structs)).alias("row")).select("row.*")


def taught_notices(variants: int) -> list[tuple[str, int, int]]:
    """(text, label, 0) of each notice and of variants of it without some words or with words around, and (text, label, 1) of the calibration's."""
    chance, out = random.Random(3), []
    around = ["", "this file is ", "note: ", "the code here is "]
    for label, name in enumerate(FAMILIES[:-1]):
        for text, k in product(NOTICES.get(name, [*OTHERS, *[t for texts in SIBLINGS.values() for t in texts]]), range(variants)):
            words = text.split(" ")
            some = [w for w in words if len(words) < 8 or chance.random() > 0.04 * k / variants * 4]
            out.append(((around[k % 4] if k else "") + " ".join(some), label, 0))
    return out + [(text, FAMILIES.index(name), 1) for name, text in CALIBRATION]


def plain_lines(docs: DataFrame, n_docs: int = SAMPLE_DOCS, n_lines: int = SAMPLE) -> DataFrame:
    """line and least (its hash) of at most `n_lines` lines without the words of any licence notice, from about `n_docs` documents of least text hash.

    The bound on the hash follows from the number of documents, so the rest of the corpus drops out where it is read.
    """
    hint = r"(?i)licen[cs]|copyright|permission|rights reserved|redistribut|spdx|creative commons"
    share = min(1.0, n_docs / max(1, docs.count()))
    some = docs.where(F.col("text").isNotNull() & (F.shiftrightunsigned(F.xxhash64("text"), 11) < int(share * 2**53)))
    lines = some.select(F.explode(F.split("text", "\n", -1)).alias("line")).where((F.col("line") != "") & ~F.col("line").rlike(hint))
    return lines.select(F.xxhash64("line").alias("least"), "line").distinct().orderBy("least", "line").limit(n_lines)


def _adder(weights: Column):  # noqa: ANN202
    return lambda total, bucket: total + F.get(weights, bucket)


def train(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Weights (families x buckets) and intercepts of a sparse multinomial logistic regression, calibrated.

    It learns from the notices with their variants and from `sample` lines of the corpus at most, which are class none (see plain_lines).
    A factor on all logits, the best of a grid, calibrates the probabilities: on notices in other words, on licences that taught nothing,
    and on a fifth of the lines that is held out.
    """
    spark = docs.sparkSession
    plain = plain_lines(docs, n_lines=sample)
    plain = plain.select("line", F.lit(len(FAMILIES) - 1).alias("label"), (F.pmod("least", F.lit(5)) == 4).cast("int").alias("held"))
    taught = rows(spark, taught_notices(VARIANTS), ["line", "label", "held"]).union(plain)
    taught = taught.select("label", "held", F.transform(ngrams(F.col("line")), lambda b: b.cast("string")).alias("grams"))
    taught = taught.where(F.size("grams") > 0)
    vectors = CountVectorizerModel.from_vocabulary([str(b) for b in range(BUCKETS)], "grams", "features")
    taught = kept(vectors.transform(taught).select("label", "held", "features").repartition(4), "taught")
    model = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.5, family="multinomial", standardization=False).fit(taught.where("held = 0"))
    weights, biases = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    raw = model.transform(taught.where("held = 1")).select(F.col("label").cast("int").alias("label"), "rawPrediction").collect()  # a fifth of the bounded sample
    logits, labels = np.array([r["rawPrediction"].toArray() for r in raw]), np.array([r["label"] for r in raw])

    def loss(f: float) -> float:
        z = f * logits
        return float(np.mean(np.log(np.exp(z - z.max(1, keepdims=True)).sum(1)) + z.max(1) - z[np.arange(len(z)), labels]))

    best = min(FACTORS, key=loss)
    return weights * best, biases * best


def runs_of_lines(text: Column, grams, evidence, start: float) -> Column:  # noqa: ANN001
    """The parts of a text that may be a licence: arrays (paragraph: place of the first line, lines) of neighbouring lines with some evidence each, of one line with enough."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: let(grams(x), lambda g: F.struct(i.alias("at"), x.alias("line"), g.alias("grams"), evidence(g).alias("e"))))
    some = F.filter(lines, lambda x: x["e"] >= -start * PART - 1e-6)
    none = F.array().cast("array<struct<paragraph:int,lines:array<struct<at:int,line:string,grams:array<int>,e:double>>>>")

    def add(runs: Column, x: Column) -> Column:
        last = F.get(runs, F.size(runs) - 1)
        joins = F.coalesce(last["paragraph"] + F.size(last["lines"]) == x["at"], F.lit(False))
        longer = F.array(F.struct(last["paragraph"].alias("paragraph"), F.concat(last["lines"], F.array(x)).alias("lines")))
        return F.when(joins, F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), longer)).otherwise(F.concat(runs, F.array(F.struct(x["at"].alias("paragraph"), F.array(x).alias("lines")))))

    return F.filter(F.aggregate(some, none, add), lambda r: (F.size(r["lines"]) > 1) | (F.get(r["lines"], F.lit(0))["e"] >= -start - 1e-6))


def segments(scores: Column, n: int, change: float) -> Column:
    """Pieces (at, n, family: its number) of lines that belong together: of all ways to give each line one of n families the one of the largest sum, where each change of the family costs `change`. scores: (at, of: the line's score by family)."""
    begin = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda f: F.struct(F.get(F.get(scores, F.lit(0))["of"], f).alias("sum"), F.array(F.struct(F.lit(0).alias("at"), f.alias("family"))).alias("pieces")))

    def add(state: Column, x: Column) -> Column:
        def best(top: Column) -> Column:
            stay = lambda own, f: F.struct((own["sum"] + F.get(x["of"], f)).alias("sum"), own["pieces"].alias("pieces"))
            turn = lambda f: F.struct((top["sum"] - change + F.get(x["of"], f)).alias("sum"), F.concat(top["pieces"], F.array(F.struct(x["at"].alias("at"), f.alias("family")))).alias("pieces"))
            return F.transform(state, lambda own, f: F.when(own["sum"] >= top["sum"] - change, stay(own, f)).otherwise(turn(f)))

        return let(F.array_max(state), best)

    found = F.aggregate(F.slice(scores, F.lit(2), F.greatest(F.size(scores) - 1, F.lit(0))), begin, add, lambda state: F.array_max(state)["pieces"])
    ends = lambda p, k: F.coalesce(F.get(found, k + 1)["at"], F.size(scores))
    return F.transform(found, lambda p, k: F.struct(p["at"].alias("at"), (ends(p, k) - p["at"]).alias("n"), p["family"].alias("family")))


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """One row per licence paragraph: doc_id, paragraph (place of its first line), n_lines, family, probability, similarity, confirmed.

    A paragraph is a line, or lies in a run of neighbouring lines that each have some words of a licence, as notices are wrapped. Marks of comments are no words and change nothing. The classifier scores every line, and
    the run as a whole, and cuts it where the family of the evidence changes (see segments). Pieces come where more families are confirmed in them than in single lines or the whole run (or as many of several, some of
    them wrapped), else the run where it is confirmed and no line by itself is, else the lines. What the classifier takes
    for a licence is compared with its family's templates: the best share of a template's word triples that it holds. family is `unknown` where the
    classifier says so, where that share is below CONFIRMED or the probability below LEAST, or where of a licence nearby (SIBLINGS) the run holds a larger share than of the family. Before the families' logits comes their common bound: per
    n-gram the largest weight of any family over that of `none`, so lines below it can't be a licence. n-grams that weigh nothing in any family are left out of all sums, and what has neither a line that the classifier takes for a licence nor, in
    several lines, a triple of a template goes before anything else is worked out: none of its lines, pieces or itself could come.

    Null and empty texts have no paragraphs to find. Repeated rows are scanned each on its own; a null doc_id is kept. An empty table
    gives no rows. Other columns are not read.
    """
    weights, biases = model or train(docs)
    weights, biases = np.round(weights, 3), np.round(biases, 3)
    bound, start = constant_array((weights[:-1] - weights[-1]).max(0), 3), float((biases[:-1] - biases[-1]).max())
    telling = constant_array(weights.any(0), 0)
    grams_of = lambda line: ngrams(line, telling)
    logits = lambda grams: F.array(*[F.aggregate(grams, F.lit(float(b)), _adder(constant_array(w, 3))) for w, b in zip(weights, biases, strict=True)])
    found = docs.select("doc_id", runs_of_lines(F.col("text"), grams_of, lambda grams: F.aggregate(grams, F.lit(0.0), _adder(bound)), start).alias("runs"))
    found = found.select("doc_id", F.explode_outer("runs").alias("run")).where(F.col("run").isNotNull())
    found = kept(found.select("doc_id", "run.paragraph", F.transform("run.lines", lambda x: x["line"]).alias("lines"), F.transform("run.lines", lambda x: x["grams"]).alias("grams")), "hits")
    templates = rows(docs.sparkSession, [(f, t) for f, texts in [*NOTICES.items(), *[(f"near {f}", texts) for some, texts in SIBLINGS.items() for f in some]] for t in texts], ["family", "template"]).select("family", triples(F.col("template")).alias("wanted")).collect()
    of_family = F.create_map(*[c for f in dict.fromkeys(r["family"] for r in templates) for c in (F.lit(f), F.array(*[F.lit(r["wanted"]) for r in templates if r["family"] == f]))])
    names = F.array(*[F.lit(f) for f in FAMILIES])

    # the first of the largest logits is the guess, and `none` comes last
    guessed = F.exists("grams", lambda g: let(logits(g), lambda z: F.array_position(z, F.array_max(z)) < len(FAMILIES)))
    of_any = F.array(*[F.lit(x) for x in sorted({x for r in templates for x in r["wanted"]})])
    found = found.where(guessed | ((F.size("lines") > 1) & F.arrays_overlap(triples(F.array_join("lines", " ")), of_any)))
    found = found.withColumn("run", triples(F.array_join("lines", " ")))

    def judged(text: Column, at: Column, n_lines: Column, family: Column | None = None) -> Column:
        """The classifier's guess and its probability, and how near the text is to templates of `family` (the guess by default); 0 where its run is nearer to a licence nearby."""
        share = lambda own, name: F.array_max(F.transform(F.element_at(of_family, name), lambda t: F.size(F.array_intersect(t, own)) / F.size(t)))
        other = lambda name: F.coalesce(share(F.col("run"), F.concat(F.lit("near "), name)), F.lit(0.0))
        near = lambda name: F.when(other(name) > share(F.col("run"), name), 0.0).otherwise(let(triples(text), lambda own: share(own, name)))

        def told(z: Column) -> Column:
            top = F.array_max(z)
            guess = F.element_at(names, F.array_position(z, top).cast("int"))
            wanted = guess if family is None else family
            of = top if family is None else F.element_at(z, F.array_position(names, family).cast("int"))
            probability = F.exp(of - top) / F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp(x - top))
            return F.struct(at.cast("long").alias("paragraph"), n_lines.cast("long").alias("n_lines"), wanted.alias("guess"), probability.alias("probability"), F.when(~wanted.isin(NONE, UNKNOWN), near(wanted)).otherwise(0.0).alias("similarity"))

        return let(let(grams_of(text), logits), told)

    kind = "array<struct<paragraph:bigint,n_lines:bigint,guess:string,probability:double,similarity:double>>"
    many, nothing = F.size("lines") > 1, F.array().cast(kind)
    one = F.transform("lines", lambda x, i: judged(x, F.col("paragraph") + i, F.lit(1)))
    found = found.select("*", one.alias("one"), F.when(many, F.array(judged(F.array_join("lines", " "), F.col("paragraph"), F.size("lines")))).otherwise(nothing).alias("whole"))

    over = [constant_array(w - weights[-1], 3) for w in weights[:-1]]
    scores = F.transform("lines", lambda x, i: F.struct(i.alias("at"), let(grams_of(x), lambda grams: F.array(*[F.aggregate(grams, F.lit(0.0), _adder(w)) for w in over])).alias("of")))
    pieces = segments(F.col("scores"), len(over), max(-start, 1.0))

    def span(piece: Column) -> Column:
        return judged(F.array_join(F.slice("lines", piece["at"] + 1, piece["n"]), " "), F.col("paragraph") + piece["at"], piece["n"], F.element_at(names, piece["family"] + 1))

    found = found.withColumn("scores", F.when(many, scores)).withColumn("spans", F.when(many, F.transform(pieces, span)).otherwise(nothing))
    licences, sure = (lambda x: x["guess"] != NONE), (lambda x: (x["similarity"] >= CONFIRMED) & (x["probability"] >= LEAST))
    distinct = lambda name: F.size(F.array_distinct(F.transform(F.filter(name, sure), lambda x: x["guess"])))
    several = (distinct("spans") > F.greatest(distinct("one"), distinct("whole"))) | ((distinct("spans") > 1) & (distinct("spans") >= distinct("one")) & F.exists("spans", lambda x: sure(x) & (x["n_lines"] > 1)))
    told = F.when(several, F.filter("spans", sure)).when((distinct("whole") > 0) & (distinct("one") == 0), F.filter("whole", licences)).otherwise(F.filter("one", licences))
    told = found.select("doc_id", F.explode(told).alias("p")).select("doc_id", "p.*")
    confirmed = (F.col("similarity") >= CONFIRMED) & (F.col("probability") >= LEAST)
    return told.select("doc_id", "paragraph", "n_lines", F.when(confirmed, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", confirmed.alias("confirmed"))


def op10_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
