"""Licence scan: MinHash bands over overlapping windows propose, shingle containment decides.

Template and text are sequences of words of letters and digits; a shingle is three of them. For
every length class of templates a text is cut into windows of ``2 * step`` words, one every
``step`` words, where ``step`` is at least the template's length: any occurrence lies whole in
one window. Of a window only the shingles that occur in some template count, and windows without
any cannot match. ``BANDS`` single-row MinHash bands lead from windows to templates of their
class. As a window can hold much besides a short notice, templates are looked up by shingles too: by
one of the shingles that it must have, or else by so many that a match has one of them. No match is missed.

A template matches a window that holds at least ``CONTAINED`` percent of its shingles, and all
shingles of the phrases that tell it from its relatives (version, ShareAlike, Lesser ...).
A notice of a licence without its version has a name of its own (``GPL``, ``LGPL``, ``AGPL``);
one with a version has both names.

The templates are a fixed list of bounded size, so their tables travel to the texts; texts are
read once and never shuffled, only the places of template shingles are.

Defined results:

* null or empty text, or text without template shingles: no rows;
* several windows with the same best containment: the first one gives the place;
* repeated rows of a document: one row per id and licence, its best match; a null id is an id;
* empty table: no rows; extra columns are not read; whole texts are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import let

WIDTH = 3
BANDS = 32
CONTAINED = 80
LEAST_STEP = 8

# Notices and passages of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("reserved", "All rights reserved."),
)


def _gnu():
    for name, word, versions in (
        ("GPL", "GNU General", {"2": "June 1991", "3": "29 June 2007"}),
        ("LGPL", "GNU Lesser General", {"2.1": "February 1999", "3": "29 June 2007"}),
        ("AGPL", "GNU Affero General", {"3": "19 November 2007"}),
    ):
        terms = f"under the terms of the {word} Public License as published by the Free Software Foundation"
        subject = "library" if name == "LGPL" else "program"
        yield name, f"This {subject} is free software: you can redistribute it and/or modify it {terms}", f"terms of the {word} Public License"
        for version, date in versions.items():
            full, known = f"{name}-{version if '.' in version else version + '.0'}", f"{word} Public License version {version}"
            yield full, f"This work is licensed under the {known}.", known
            yield full, f"{known}, {date}", known
            yield (full, f"is free software: you can redistribute it and/or modify it {terms}, either version {version} of the License",
                   f"terms of the {word} Public License", f"version {version} of the License")


def _creative_commons():
    parts = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    spelled = {"ShareAlike": "Share-Alike", "NonCommercial": "Non-Commercial", "NoDerivatives": "NoDerivs"}
    for code in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        long = [parts[p] for p in code.split("-")]
        for version, area in (("4.0", "International"), ("3.0", "Unported")):
            yield f"CC-{code}-{version}", f"Licensed under CC {code} {version}.", f"CC {code} {version}"
            for name in sorted({"-".join(long), "-".join(spelled.get(x, x) for x in long)}):
                yield (f"CC-{code}-{version}", f"This work is licensed under a Creative Commons {name} {version} {area} License.",
                       f"Commons {name} {version}")


# The templates above with the phrases that must be there word for word, and further licences.
DECIDING = {
    "Licensed under the Apache License, Version 2.0.": "Apache License Version 2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GNU General Public License version 3",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "Mozilla Public License v 2.0",
    "Licensed under CC BY 4.0.": "CC BY 4.0",
    "Licensed under CC BY-SA 4.0.": "CC BY-SA 4.0",
    "Licensed under CC BY-NC 4.0.": "CC BY-NC 4.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "Commons Attribution 4.0",
}
CATALOGUE = tuple(dict.fromkeys((
    *((name, text, *([DECIDING[text]] if text in DECIDING else [])) for name, text in TEMPLATES if not text.startswith("This program is free")),
    *_gnu(), *_creative_commons(),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004", "Apache License Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License.", "BSD 2 Clause"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License.", "BSD 3 Clause"),
    ("BSD-3-Clause", "the names of its contributors may be used to endorse or promote products derived from this software without specific prior "
                     "written permission"),
    ("ISC", "Licensed under the ISC License.", "the ISC License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
            "that the above copyright notice and this permission notice appear in all copies", "hereby granted provided that the above"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE "
             "SOFTWARE IS PROVIDED \"AS IS\"", "hereby granted the software"),
    *((f"EPL-{v}", text, f"Eclipse Public License {how}{v}") for v in ("1.0", "2.0") for how in ("", "v", "v ", "version ") for text in (
        f"made available under the terms of the Eclipse Public License {how}{v}", f"Licensed under the Eclipse Public License {how}{v}")),
    *((f"EPL-{v}", f"Eclipse Public License v {v}", f"Eclipse Public License v {v}") for v in ("1.0", "2.0")),
    *((f"MPL-{v}", text, f"Mozilla Public License {how}{v}") for v in ("1.1", "2.0") for how in ("", "version ") for text in (
        f"Mozilla Public License {how}{v}",)),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
                  "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "CC0 1.0 Universal", "CC0 1.0 Universal"),
)))
SPLIT = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split(r"[^A-Za-z0-9]+", text.lower()) if w]


def step_of(n_words: int) -> int:
    """Distance of the windows for templates of that length: a power of two."""
    step = LEAST_STEP
    while step < n_words:
        step *= 2
    return step


def text_words(text: Column) -> Column:
    """Words of letters and digits; letters A-Z count as a-z."""
    return F.transform(F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != ""), lambda w: F.lower(w))


def shingle_hashes(tokens: Column) -> Column:
    """``ARRAY<BIGINT>``: a hash per run of three words, in order."""
    return let(tokens, lambda ws: F.transform(
        F.slice(ws, WIDTH, F.size(ws)), lambda w, i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), w)
    ))


def signature(shingles: Column) -> Column:
    """``ARRAY<BIGINT>``: one MinHash per band."""
    return F.array(*[F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(band)))) for band in range(BANDS)])


def templates(spark, listed=CATALOGUE, contained: int = CONTAINED) -> DataFrame:
    """``template, license, step, known, must, sought``: the distinct shingle hashes of each template,
    those that a match cannot lack, and some of which it has at least one."""
    rows = [
        (i, name, step_of(len(ws)), ws, [template_words(d) for d in deciding])
        for i, (name, text, *deciding) in enumerate(listed) if len(ws := template_words(text)) >= WIDTH
    ]
    made = spark.createDataFrame(rows, "template INT, license STRING, step INT, words ARRAY<STRING>, phrases ARRAY<ARRAY<STRING>>")
    hashed = made.select(
        "template", "license", "step", F.array_distinct(shingle_hashes(F.col("words"))).alias("known"),
        F.array_distinct(F.flatten(F.transform("phrases", shingle_hashes))).alias("must"),
    )
    lacking = F.floor(F.size("known") * (100 - contained) / 100).cast("int")
    sought = F.when(F.size("must") > 0, F.slice("must", 1, 1)).otherwise(F.slice("known", F.lit(1), lacking + 1))
    return hashed.withColumn("sought", sought)


def windows(documents: DataFrame, table: DataFrame) -> DataFrame:
    """``doc_id, row_key, step, place, found``: template shingles of every window that has any."""
    known = sorted({h for r in table.select("known").collect() for h in r["known"]})
    steps = sorted({r["step"] for r in table.select("step").distinct().collect()})
    text = F.col("text").cast("string")
    placed = F.transform(shingle_hashes(text_words(text)), lambda h, i: F.struct(i.alias("i"), h.alias("h")))
    anchors = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("row_key"),
        F.filter(placed, lambda x: x["h"].isin(known)).alias("anchors"),
    ).where(F.size("anchors") > 0)
    each = anchors.select("doc_id", "row_key", F.explode("anchors").alias("a")).select(
        "doc_id", "row_key", F.col("a.i").alias("i"), F.col("a.h").alias("h"),
        F.explode(F.array(*map(F.lit, steps))).alias("step"),
    )
    # a window is named by the step it begins at; each place lies in two
    begins = F.floor(F.col("i") / F.col("step")).cast("int")
    each = each.withColumn("window", F.explode(F.filter(F.array(begins - 1, begins), lambda w: w >= 0)))
    inside = F.col("i") + WIDTH <= (F.col("window") + 2) * F.col("step")
    return each.where(inside).groupBy("doc_id", "row_key", "step", "window").agg(
        F.collect_set("h").alias("found")
    ).withColumn("place", F.col("window") * F.col("step")).drop("window")


def keys(shingles: Column, sought: Column) -> Column:
    """``ARRAY<STRUCT<band, value>>``: bands of all shingles, and the sought ones themselves as band -1."""
    bands = F.transform(signature(shingles), lambda v, i: F.struct(i.alias("band"), v.alias("value")))
    return F.concat(bands, F.transform(sought, lambda s: F.struct(F.lit(-1).alias("band"), s.alias("value"))))


def matches(documents: DataFrame, listed=CATALOGUE, contained: int = CONTAINED) -> DataFrame:
    """``doc_id, license, containment, place`` of ``documents(doc_id, text)``.

    ``containment`` is the best share of a template's shingles, ``place`` the first word of the
    first window that has it.
    """
    table = templates(documents.sparkSession, listed, contained)
    banded = table.select("template", F.col("step").alias("t_step"), F.inline(keys(F.col("known"), F.col("sought"))))
    found = windows(documents, table).select("*", F.inline(keys(F.col("found"), F.col("found"))))
    met = found.join(
        F.broadcast(banded.select("band", "value", "template", "t_step")),
        (found["band"] == banded["band"]) & (found["value"] == banded["value"]) & (found["step"] == banded["t_step"]),
    ).select("doc_id", "row_key", "step", "place", "found", "template").dropDuplicates(["doc_id", "row_key", "step", "place", "template"])
    checked = met.join(F.broadcast(table.select("template", "license", "known", "must")), "template")
    decided = F.size(F.array_except("must", "found")) == 0
    share = F.size(F.array_intersect("found", "known")) / F.size("known")
    best = checked.withColumn("containment", share).where(
        decided & (F.col("containment") >= contained / 100))
    return best.groupBy("doc_id", "license").agg(
        F.max(F.struct(F.col("containment"), (-F.col("place")).alias("back"))).alias("b")
    ).select("doc_id", "license", F.col("b.containment").alias("containment"), (-F.col("b.back")).cast("bigint").alias("place"))


def oracle(listed=TEMPLATES, contained: int = CONTAINED) -> str:
    """The same rows in SQL, by comparing every window with every template of its class."""
    rows = []
    for i, (name, text) in enumerate(listed):
        ws = template_words(text)
        for s in sorted({" ".join(ws[k:k + WIDTH]) for k in range(len(ws) - WIDTH + 1)}):
            rows.append(f"({i}, '{name}', {step_of(len(ws))}, '{s}')")
    return f"""
WITH t(template, license, step, s) AS (VALUES {', '.join(rows)}),
n AS (SELECT template, count(*) AS size FROM t GROUP BY template),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, ws, unnest(range(len(ws) - {WIDTH - 1})) AS i FROM w WHERE len(ws) >= {WIDTH}),
a AS (SELECT doc_id, i, lower(ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3]) AS s FROM g),
h AS (SELECT a.doc_id, a.i, t.template, t.license, t.step, a.s FROM a JOIN t USING (s)),
p AS (
  SELECT *, i // step AS b FROM h UNION ALL SELECT *, i // step - 1 AS b FROM h WHERE i // step >= 1),
c AS (
  SELECT doc_id, license, template, b * step AS place, count(DISTINCT s) AS hits FROM p
  WHERE i + {WIDTH} <= (b + 2) * step GROUP BY ALL),
m AS (SELECT doc_id, license, place, hits / size AS containment FROM c JOIN n USING (template) WHERE hits / size >= {contained / 100})
SELECT doc_id, license, max(containment) AS containment,
  CAST(arg_min(place, (-containment, place)) AS BIGINT) AS place FROM m GROUP BY doc_id, license
"""
