"""License scans: phrases, and license texts found by diagonal voting of word k-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, lower_ascii, window_hashes, with_row_id

#: Everything but ASCII letters and digits and all characters beyond ASCII separates words.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases of the base scan with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices and text openings of public licenses that the templates are made of.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        "an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following.",
    ],
    "bsd-3": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-nc-nd": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-NC-ND 4.0.",
    ],
    "cc-by-nc-sa": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ],
    "cc-by-nd": [
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "Licensed under CC BY-ND 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "cc0": [
        "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights "
        "to this software to the public domain worldwide. This software is distributed without any warranty.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "This work is licensed under the GNU General Public License, version 3.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
        "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your "
        "option) any later version.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The "
        "above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software.",
        "Released under the MIT License.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means.",
    ],
}

#: Words of a k-gram.
K = 4
#: Diagonals this close belong to one occurrence: words were put in or left out between them.
GAP = 3
#: Share of a template's words that an occurrence has to cover, and of the words in k-grams of no other label.
LEAST_COVER = 0.5


def license_words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS), "")


def template_grams(spark: SparkSession, templates: dict[str, list[str]], k: int) -> DataFrame:
    """``(gram, template, label, at, run, n, own, n_own)``: each k-gram of each template with its place and words.

    own says that no other label has the gram; n_own counts the template's words in such grams.
    """
    rows = [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(text).alias("text"))
            for i, (label, text) in enumerate((x, t) for x in sorted(templates) for t in templates[x])]
    one = spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    one = one.select("template", "label", license_words(F.col("text")).alias("w"))
    grams = one.select("template", "label", F.size("w").alias("n"), "w", F.posexplode(window_hashes(F.col("w"), k)).alias("at", "gram")).select(
        "gram", "template", "label", "at", "n", F.slice("w", F.col("at") + 1, k).alias("run"))
    alike = Window.partitionBy("gram")
    grams = grams.withColumn("own", F.min("label").over(alike) == F.max("label").over(alike))
    places = F.collect_list(F.when(F.col("own"), F.col("at"))).over(Window.partitionBy("template"))
    return grams.withColumn("n_own", _covered(places, k))


def _covered(places: Column, k: int) -> Column:
    """How many words the k-grams at these places cover."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + k - 1)))))


def _phrase_facts(words: Column, phrases: dict[str, str]) -> list[Column]:
    # every word has its own pair of blanks, so neighbouring places of a phrase do not share a character
    padded = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        mark = " " + phrase.replace(" ", "  ") + " "
        has = padded.contains(mark)

        def word_number(head: Column) -> Column:  # words in whole padded words
            return ((F.char_length(head) - F.char_length(F.translate(head, " ", ""))) / 2).cast("long")

        counts.append(F.when(has, F.size(F.split(padded, mark, -1)) - 1).otherwise(0))
        firsts.append(F.when(has, word_number(F.substring_index(padded, mark, 1))))
        lasts.append(F.when(has, word_number(F.substring_index(padded, mark, -1))))
        labels.append(F.when(has, F.lit(label)))
    n = len(phrases)
    after = [F.when(x.isNotNull(), F.size(words) - x - len(p.split())) for x, p in zip(lasts, phrases)]
    total = sum((c.cast("long") for c in counts[1:]), counts[0].cast("long"))
    return [total.alias("n_base"), (F.least(*firsts) if n > 1 else firsts[0]).alias("first_word"),
            (F.greatest(*after) if n > 1 else after[0]).cast("long").alias("last_word"),
            F.array_compact(F.array(*labels)).alias("base_labels")]


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None,
         k: int = K, gap: int = GAP, least_cover: float = LEAST_COVER, id_col: str = "doc_id",
         text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents, spans) of a stored table.

    documents: ``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, a row for
    each row of ``docs``. Base labels come from the phrases; the method adds the labels of templates of
    which a verified span covers at least ``least_cover``, of all words and of those in k-grams that no other
    label has: words that notices of several licenses begin with name none of them. score is the largest
    covered share, 1 where a phrase stands. spans: ``(doc_id, row, label, template, first_word, last_word, votes, cover)``.
    Null and empty texts have no words, labels '' and score 0; repeated rows are scanned alike; rows with
    null ids stay; other columns are ignored; no rows give no rows. Texts of any length are scanned whole, in time
    that grows with their length. A label of a variant (cc-by-sa) does not bring the one of its base (cc-by) along.

    Diagonal voting: every k-gram of every text meets the templates' k-grams (a few hundred rows made of
    the parameter); a hit votes for its diagonal, the offset of text to template. Neighbouring
    diagonals join into one occurrence, and so do the parts of one that follow each other in text and
    template, with no more words between them than the template has: longer insertions cut a notice into
    such parts. Hits count only if their words agree, not just their hashes.
    """
    phrases, templates = phrases or PHRASES, TEMPLATES if templates is None else templates
    row = fresh(docs, "row")
    own = with_row_id(docs, row).select(row, F.col(id_col).alias("doc_id"), license_words(F.col(text_col)).alias("words"))
    facts = own.select(row, "doc_id", F.size("words").cast("long").alias("n_words"), *_phrase_facts(F.col("words"), phrases))

    known = template_grams(docs.sparkSession, templates, k)
    # the templates' hashes (some hundred, made of the parameter) stand in the plan: only k-grams that a template has leave a
    # row, each with its own words, so work is linear in the length of a text
    wanted = [r["gram"] for r in known.select("gram").distinct().collect()]
    words = F.col("words")
    places = F.filter(F.transform(window_hashes(words, k), lambda h, i: F.struct(i.alias("place"), h.alias("g"))), lambda x: x["g"].isin(wanted))
    hits = F.transform(places, lambda x: F.struct(x["place"].alias("place"), x["g"].alias("g"), F.slice(words, x["place"] + 1, k).alias("own_run")))
    met = own.select(row, "doc_id", F.inline(hits)).join(F.broadcast(known), F.col("g") == F.col("gram")).where(F.col("own_run") == F.col("run"))
    diagonal = F.col("place") - F.col("at")
    key = [row, "template"]
    lines = met.groupBy(*key, diagonal.alias("diagonal")).agg(
        F.first("doc_id").alias("doc_id"), F.first("label").alias("label"), F.first("n").alias("n"),
        F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("votes"),
        F.min("at").alias("low_at"), F.max("at").alias("high_at"), F.first("n_own").alias("n_own"),
        F.collect_set("at").alias("places"), F.collect_set(F.when(F.col("own"), F.col("at"))).alias("owned"))  # at most the template's length
    # an occurrence: diagonals within ``gap`` of the one before
    order = Window.partitionBy(*key).orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(order) > gap).cast("int")
    runs = lines.withColumn("run_no", F.sum(F.coalesce(opens, F.lit(0))).over(order))

    def together(parts: DataFrame, number: str) -> DataFrame:
        def union(name: str) -> Column:
            return F.array_distinct(F.flatten(F.collect_list(name))).alias(name)

        return parts.groupBy(*key, number).agg(
            *[F.first(c).alias(c) for c in ("doc_id", "label", "n", "n_own")], F.min("low").alias("low"), F.max("high").alias("high"),
            F.min("low_at").alias("low_at"), F.max("high_at").alias("high_at"), F.sum("votes").alias("votes"), union("places"), union("owned")).drop(number)

    # parts in text order: each is held against the one before it that reaches farthest; one inside another stays alone
    parts, text = together(runs, "run_no"), Window.partitionBy(*key).orderBy("low", F.col("high").desc(), "low_at")
    before = F.max(F.struct("high", "high_at")).over(text.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("before", before).withColumn("inside", F.coalesce(F.col("high") <= F.col("before.high"), F.lit(False)))
    follows = (F.col("low_at") > F.col("before.high_at")) & (F.col("low") - F.col("before.high") - k <= F.col("n"))
    parts = parts.withColumn("opens", (~F.col("inside") & ~F.coalesce(follows, F.lit(False))).cast("int"))
    number = F.struct(F.sum("opens").over(text), F.when(F.col("inside"), F.row_number().over(text)))
    spans = together(parts.withColumn("part_no", number), "part_no")
    cover = _covered(F.col("places"), k) / F.col("n")
    own_cover = F.try_divide(_covered(F.col("owned"), k), F.col("n_own"))
    spans = spans.withColumn("cover", cover).where((F.col("cover") >= least_cover) & (own_cover >= least_cover)).select(
        "doc_id", row, "template", "label", F.col("low").alias("first_word"), (F.col("high") + k - 1).alias("last_word"), "votes", "cover")
    found = spans.groupBy(F.col(row).alias("r")).agg(F.collect_set("label").alias("added"), F.max("cover").alias("cover"))
    out = facts.join(found, F.col(row) == F.col("r"), "left")
    none = F.array().cast("array<string>")

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("base_labels")).alias("base_labels"),
        joined(F.concat("base_labels", F.coalesce("added", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("cover", F.lit(0.0))).alias("score")), spans
