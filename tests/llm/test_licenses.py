import re

import duckdb

from folioflow.llm import licenses

TEXTS = [
    None, "", "two words", "Released under the MIT License.", "x " * 40 + "RELEASED under the mit license!" + " y" * 40,
    "All rights reserved. " * 30, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    "(the Software), to deal in the Software without any restriction",
    "redistribution and use in source and binary forms with changes is permitted", "rights reserved all", "released under the license MIT",
    "É all rights\nreserved ñ", "word " * 5000 + "This work is licensed under the GNU General Public License, version 3.",
]


def test_matches_equal_the_windows_compared_one_by_one(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame([(*r, 1, "w") for r in rows], "doc_id BIGINT, text STRING, step INT, window STRING")
    got = sorted(tuple(r) for r in licenses.matches(docs).select("doc_id", "license", "containment", "place").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.execute(f"SELECT doc_id, license, containment, place FROM ({licenses.oracle()})").fetchall())
    assert got == want
    found = {(i, name) for i, name, *_ in got}
    assert {(3, "MIT"), (4, "MIT"), (5, "reserved"), (6, "CC-BY-NC-4.0"), (6, "Apache-2.0"), (7, "MIT"), (11, "reserved"), (12, "GPL-3.0")} <= found
    assert not {i for i, _ in found} & {0, 1, 2, 8, 9, 10}


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, TEXTS[3]), (1, TEXTS[3]), (None, TEXTS[3])], "doc_id BIGINT, text STRING")
    assert sorted(str(r["doc_id"]) for r in licenses.matches(docs).collect()) == ["1", "None"]
    assert licenses.matches(docs.limit(0)).count() == 0


def test_an_occurrence_lies_whole_in_a_window():
    for _, text in licenses.TEMPLATES:
        n = len(licenses.template_words(text))
        step = licenses.step_of(n)
        assert all(any(w * step <= at and at + n <= (w + 2) * step for w in range(40)) for at in range(100))
    assert all(re.fullmatch("[ -~]+", text) for _, text in licenses.TEMPLATES)


def test_relatives_are_told_apart(spark):
    gnu = "you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation"
    cc = "This work is licensed under a Creative Commons {} International License"
    wanted = {
        cc.format("Attribution-NonCommercial-NoDerivatives 4.0"): {"CC-BY-NC-ND-4.0"},
        cc.format("Attribution-ShareAlike 4.0"): {"CC-BY-SA-4.0"}, cc.format("Attribution 4.0"): {"CC-BY-4.0"},
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0"},
        "This work is licensed under the GNU General Public License, version 3.": {"GPL-3.0"},
        "This work is licensed under the GNU Lesser General Public License, version 3.": {"LGPL-3.0"},
        f"This library is free software; {gnu.format('Lesser General')}; either version 2.1 of the License": {"LGPL", "LGPL-2.1"},
        f"This program is free software: {gnu.format('General')}; either version 2 of the License": {"GPL", "GPL-2.0"},
        f"Foo is free software: {gnu.format('Affero General')}, either version 3 of the License": {"AGPL", "AGPL-3.0"},
        f"This program is free software: {gnu.format('General')}.": {"GPL"},
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007": {"GPL-3.0"},
        "are made available under the terms of the Eclipse Public License v2.0": {"EPL-2.0"},
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies.": {"ISC"},
        "This is free and unencumbered software released into the public domain.": {"Unlicense"},
    }
    rows = list(enumerate(wanted))
    got = {}
    for r in licenses.matches(spark.createDataFrame(rows, "doc_id BIGINT, text STRING")).collect():
        got.setdefault(r.doc_id, set()).add(r.license)
    assert {text: got.get(i, set()) for i, text in rows} == wanted


def test_a_short_notice_among_much_else_is_found(spark):
    others = [(f"L{i}", " ".join(f"w{i}x{k}" for k in range(6))) for i in range(300)]
    short = [(f"S{i}", f"a{i} b{i} c{i}") for i in range(300)]
    rows = [(i, f"{others[i][1]} {short[i][1]} {others[i - 1][1]}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert licenses.matches(docs, (*short, *others)).where("license LIKE 'S%'").count() == len(short)
