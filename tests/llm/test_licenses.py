import math
import re
from collections import Counter

from pyspark.sql import functions as F

from candidata.llm import licenses
from candidata.llm.queries import QUERIES
from odd_data import SMALL, documents, empty, odd  # noqa: F401


def brute(files, threshold=0.7):
    """(own, similarity) of each (path, text), every unit against every template."""
    df = Counter(t for _, text in files for t in set(licenses.python_terms(text or "")))
    idf = lambda t: math.log((1 + len(files)) / (1 + df[t]))

    def vector(text):
        v = {t: n * idf(t) for t, n in Counter(licenses.python_terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()} if norm else {}

    templates = [(name, vector(text)) for name, text in licenses.TEMPLATES]
    found = []
    for path, text in files:
        name = (path or "").rsplit("/", 1)[-1].lower()
        lines = []
        for x in (text or "").split("\n"):
            about = re.search(r"^[^a-z]*copyright (\(c\)|\u00a9|[0-9])", x.lower())
            lines.append(x if not about else "copyright all rights reserved" if "all rights reserved" in x.lower() else "copyright")
        units = ["\n".join(lines[i : i + n]) for n in licenses.HEADER_LINES for i in range(max(1, len(lines) - n + 1))]
        units += ["\n".join(lines)] if name in ("license", "licence", "copying", "license.txt") else []
        told = []
        for unit in set(units):
            v = vector(unit)
            scores = [(round(sum(w * v.get(t, 0) for t, w in tv.items()), 9), -k, n) for k, (n, tv) in enumerate(templates)]
            best = max(scores)
            other = max((c for c, _, n in scores if n != best[2]), default=0)
            if best[0] >= max(threshold, other + 0.01):
                told.append((best[2] not in licenses.YIELDING, *best))
        found.append((max(told)[3], round(max(told)[1], 6)) if told else (None, None))
    return found


def inherit(files, own):
    notices = {}
    for (path, _), (name, s) in zip(files, own):
        if name and path and path.rsplit("/", 1)[-1].lower() in ("license", "licence", "copying", "license.txt"):
            d = path.rpartition("/")[0]
            notices[d] = min(notices.get(d, (0, "", "")), (-s, path, name))
    found = []
    for (path, _), (name, _) in zip(files, own):
        d = None if path is None else path.rpartition("/")[0]
        while name is None and d is not None:
            if d in notices:
                name = notices[d][2]
            d = d.rpartition("/")[0] if d else None
        found.append(name)
    return found


def check(df):
    rows = licenses.scan(df).collect()
    assert len(rows) == df.count()
    files = [(r["path"], r["text"]) for r in df.select("path", "text").collect()]
    own = brute(files)
    expected = sorted(map(repr, zip(files, [o[0] for o in own], inherit(files, own))))
    assert sorted(repr(((r["path"], r["text"]), r["own_license"], r["license"])) for r in rows) == expected
    return rows


def test_tree(spark):
    mit = licenses.MIT
    files = [
        ("LICENSE", "Licensed under CC BY-NC 4.0"), ("a/x.py", "code"), ("a/b/LICENSE.txt", mit + " extra"), ("a/b/c/d/y.py", "more code\nand so on"),
        ("a/b/z.py", "# Licensed under the Apache License, Version 2.0\nx = 1"), ("a/b/w.py", "the license of the version is under way"),
        ("e/COPYING", "nothing of the kind"), ("e/f.py", ""), (None, None), (None, "Released under the MIT License"), ("e/g/LICENSE", None),
        ("a/b/LICENSE", "This work is licensed under the GNU General Public License,\nversion 3"), ("a/x.py", "code"), ("top.py", None),
    ]
    df = spark.createDataFrame([(p, t, "x", "y") for p, t in files], "path string, text string, license string, term string")
    rows = {r["path"]: r for r in check(df)}
    assert rows["a/x.py"]["license"] == "CC-BY-NC-4.0" and rows["a/x.py"]["license_from"] == ""
    assert rows["a/b/c/d/y.py"]["license_from"] == "a/b" and rows["a/b/z.py"]["own_license"] == "Apache-2.0"


GPL_NOTICE = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
LGPL_NOTICE = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
MIT_TEXT = """MIT License

Copyright (c) 2021 Some Holder

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD_TEXT = """Copyright (c) 2019, The Holders. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

* Redistributions of source code must retain the above copyright notice, this
  list of conditions and the following disclaimer.
* Redistributions in binary form must reproduce the above copyright notice,
  this list of conditions and the following disclaimer in the documentation
  and/or other materials provided with the distribution."""
BSD_NAME = """
* Neither the name of the copyright holder nor the names of its
  contributors may be used to endorse or promote products derived from
  this software without specific prior written permission."""
APACHE_NOTICE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//     http://www.apache.org/licenses/LICENSE-2.0"""
CASES = {
    GPL_NOTICE: "GPL-3.0", GPL_NOTICE.replace("version 3", "version 2"): "GPL-2.0", GPL_NOTICE.replace("General", "Affero General"): "AGPL-3.0",
    LGPL_NOTICE: "LGPL-2.1", "GNU Lesser General Public License, version 2.1": "LGPL-2.1", MIT_TEXT: "MIT", APACHE_NOTICE: "Apache-2.0",
    BSD_TEXT: "BSD-2-Clause", BSD_TEXT + BSD_NAME: "BSD-3-Clause", "Copyright (c) 2024, Foo Project Contributors. All rights reserved.": "proprietary",
    "SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0", "// SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0", "Copyright 2020 Somebody": None, "the general public may copy this": None,
    "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this": "MPL-2.0",
}


def test_real_headers(spark, documents):
    """Wrapped notices and whole licence texts among other lines, weighed over all documents."""
    prose = [r["text"] for r in documents.filter("text IS NOT NULL").limit(len(CASES)).collect()]
    files = [(f"src/f{i}.c", f"#!/bin/sh\n\n{case}\n\nimport x\n{prose[i][:300]}") for i, case in enumerate(CASES)]
    own = spark.createDataFrame(files, "path string, text string")
    others = documents.select(F.concat(F.lit("docs/"), "doc_id").alias("path"), "text")
    rows = {r["path"]: r["own_license"] for r in licenses.scan(own.union(others)).filter("path LIKE 'src/%'").collect()}
    wrong = {case[:60]: (rows[path], name) for (path, _), (case, name) in zip(files, CASES.items()) if rows[path] != name}
    assert wrong == {}


def test_documents_and_odd_rows(documents, odd, empty):
    i = F.coalesce("doc_id", F.lit(0))
    name = F.when(i % 3 == 0, "LICENSE").otherwise(F.concat(i, F.lit(".txt")))
    for df in (documents, odd):
        check(df.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("none")), "lang", name)))
    assert licenses.scan(empty.withColumn("path", F.lit("a"))).collect() == []


def test_query(spark, documents):
    rows = QUERIES["op10_license_scan"](spark, SMALL).collect()
    assert len(rows) == documents.count()
    text = dict(documents.select("doc_id", "text").collect())
    for r in rows:
        assert (r["own_license"] is not None) == any(
            x.strip(". ").lower() in (
                "licensed under the apache license, version 2.0", "released under the mit license", "licensed under cc by-nc 4.0",
                "this work is licensed under the gnu general public license, version 3", "all rights reserved",
            )
            for x in text[r["doc_id"]].split("\n")
        )
