"""License scans: TF-IDF cosine of headers and licence files to templates, inherited by directory.

Native: built-in functions, aggregates and joins only.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candidata.cluster import written
from candidata.functions.binding import bind
from candidata.llm.common import without

#: Notices, titles and texts of public licences.
GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by "
    "the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution."
)
BSD_NAME = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)
ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
APACHE = (
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
)
MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/."
)
UNLICENSE = "This is free and unencumbered software released into the public domain."
AGPL, LGPL, GPL = "Affero General Public License", "Lesser General Public License", "General Public License"
TEMPLATES = (
    ("AGPL-3.0", GNU.format(AGPL, "3")),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License"),
    ("Apache-2.0", APACHE),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", BSD),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", BSD + " " + BSD_NAME),
    ("BSD-3-Clause", BSD_NAME),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("GPL-2.0", GNU.format(GPL, "2")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"),
    ("GPL-3.0", GNU.format(GPL, "3")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("ISC", ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("LGPL-2.1", GNU.format(LGPL, "2.1")),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", GNU.format(LGPL, "3")),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", MIT),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", MPL),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", UNLICENSE),
    ("proprietary", "All rights reserved"),
    ("proprietary", "Copyright. All rights reserved"),
)

#: Licences that yield to any other found beside them: their words stand in other licences, too.
YIELDING = ("proprietary", "BSD-2-Clause")
#: Lines of the headers that are compared.
HEADER_LINES = (1, 2, 4, 8)
#: A line that names a holder, who is no part of the licence: what is left of it.
HOLDER, HOLDER_ALL = r"^[^a-z]*copyright (\(c\)|©|[0-9])", "all rights reserved"

RESULTS = ("own_license", "similarity", "license", "license_from")


def terms_of(text: Column) -> Column:
    """Lower-case terms: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def python_terms(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def without_holder(line: Column) -> Column:
    """The line, or what a line about a copyright says apart from year and holder."""
    low = F.lower(line)
    kept = F.when(low.contains(HOLDER_ALL), f"copyright {HOLDER_ALL}").otherwise("copyright")
    return F.when(low.rlike(HOLDER), kept).otherwise(line)


def weigh(templates: Sequence[tuple[str, str]], idf: dict[str, float], threshold: float) -> tuple[list[tuple], list[str]]:
    """(term, weights) with the weight of a term in the unit vector of every template, and the terms one of
    which a text must have to reach the threshold with some template: the heaviest, until the others' length is below it.
    """
    vectors, needed = {}, set()
    for number, (_, text) in enumerate(templates):
        weights = {t: n * idf[t] for t, n in Counter(python_terms(text)).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        rest = 1.0
        for t, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            vectors.setdefault(t, [0.0] * len(templates))[number] = w / norm
            if rest >= (threshold - 1e-9) ** 2:
                needed.add(t)
            rest -= (w / norm) ** 2
    return list(vectors.items()), sorted(needed)


def scan(
    docs: DataFrame,
    path: str = "path",
    text: str = "text",
    licence_name: str = r"(?i)^(licen[cs]e|copying)(\.[a-z]+)?$",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.7,
    margin: float = 0.01,
) -> DataFrame:
    """Add own_license, similarity, license and license_from to every file.

    Units are the headers, which are all runs of `HEADER_LINES` neighbouring lines, and the whole text of a
    licence file (by its file name). Lines about a copyright are read without year and holder. A
    unit's vector has its terms by count times ln((1 + documents) / (1 + documents with the
    term)), counted over all documents. A unit tells a licence if the cosine of its best template reaches
    the threshold and is `margin` above that of every other licence. own_license is that of the most similar unit,
    one of `YIELDING` only where no unit tells another. A file without one takes the license of the nearest
    directory above, its own first, that has a licence file with one; of several the most similar, then the
    first by name. license_from is `header`, `file`, the directory, or null.

    Only units with one of the templates' heaviest terms can reach the threshold; only their
    terms are joined with the counts. The templates are a fixed list, so the few terms the
    driver reads, and the table of their weights, are bounded by it. Inheritance joins distinct
    directories with their ancestors, so a large directory costs one row.

    Null and empty texts have no license of their own. Very long texts give a few units per line. A null path is a
    file in no directory. Equal rows get equal results. Columns with the name of a result are replaced, others
    passed on. Templates of equal cosine: the first in the list. An empty table gives an empty result.
    """
    docs = without(docs, *RESULTS)
    rows = docs.select(
        F.col(path).alias("__path"), F.xxhash64(text).alias("__text"), F.col(text).alias("text"), name_of(F.col(path)).alias("name")
    )
    counts = rows.select(F.explode(F.array_distinct(terms_of(F.col("text")))).alias("term"))
    counts = written(counts.groupBy("term").agg(F.count("*").alias("n")), "terms")
    n_docs = docs.count()
    vocabulary = sorted({t for _, x in templates for t in python_terms(x)})
    known = {r["term"]: r["n"] for r in counts.filter(F.col("term").isin(vocabulary)).collect()}
    idf = {t: math.log((1 + n_docs) / (1 + known.get(t, 0))) for t in vocabulary}
    weights, needed = weigh(templates, idf, threshold)

    keys = ["__path", "__text", "place"]
    needle = F.array(*[F.lit(t) for t in needed])
    lines = F.transform(F.split("text", "\n"), lambda x: terms_of(without_holder(x)))
    headers = rows.select("__path", "__text", header_units(lines, needle)).filter("place IS NOT NULL")
    whole = rows.filter(F.col("name").rlike(licence_name)).select(
        "__path", "__text", F.lit(-1).cast("bigint").alias("place"), F.flatten(lines).alias("terms")
    )
    units = headers.union(whole.filter(F.arrays_overlap("terms", needle))).distinct()
    terms = units.select(*keys, F.explode("terms").alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))
    tf_idf = F.col("tf") * F.log((F.lit(1.0) + n_docs) / (1 + F.col("n")))
    terms = terms.join(counts, "term").withColumn("w", tf_idf)
    table = docs.sparkSession.createDataFrame(weights, "term string, weights array<double>")
    terms = terms.join(table, "term", "left")
    dots = [F.coalesce(F.sum(F.get("weights", F.lit(k)) * F.col("w")), F.lit(0.0)) for k in range(len(templates))]
    scored = terms.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.array(*dots).alias("dots"))
    licences = F.array(*[F.lit(name) for name, _ in templates])

    def told(cosines: Column) -> Column:
        """The best template with its licence, and the cosine of the best of another licence."""
        each = F.transform(cosines, lambda c, k: F.struct(c.alias("cosine"), (-k).alias("k"), F.get(licences, k).alias("name")))

        def beside(listed: Column) -> Column:
            best = F.array_max(listed)
            others = F.transform(F.filter(listed, lambda x: x["name"] != best["name"]), lambda x: x["cosine"])
            return F.struct(
                (~best["name"].isin(*YIELDING)).alias("strong"), F.round(best["cosine"], 9).alias("cosine"),
                best["k"].alias("k"), best["name"].alias("name"), F.coalesce(F.array_max(others), F.lit(0.0)).alias("other"),
            )

        return bind(each, beside)

    scored = scored.filter("norm > 0")
    cosines = F.transform("dots", lambda d: F.round(d / F.col("norm"), 9))
    scored = scored.select("__path", "__text", bind(cosines, told).alias("unit"))
    clear = F.col("unit.cosine") >= F.greatest(F.lit(threshold), F.col("unit.other") + margin)
    own = scored.filter(clear).groupBy("__path", "__text").agg(F.max("unit").alias("best")).select(
        F.col("__path").alias("__p"),
        F.col("__text").alias("__t"),
        F.col("best.name").alias("own_license"),
        F.round(F.col("best.cosine"), 6).alias("similarity"),
    )
    own = written(own, "licenses")

    notices = own.filter(name_of(F.col("__p")).rlike(licence_name)).withColumn("dir", directory_of(F.col("__p")))
    first = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("__p").alias("p"), F.col("own_license").alias("name")))
    notices = notices.groupBy("dir").agg(first["name"].alias("of_dir"))
    dirs = docs.select(directory_of(F.col(path)).alias("__dir")).filter("__dir IS NOT NULL").distinct()
    above = dirs.select("__dir", F.posexplode(ancestors(F.col("__dir"))).alias("up", "dir"))
    nearest = above.join(notices, "dir").groupBy("__dir").agg(F.min(F.struct("up", "dir", "of_dir")).alias("near"))
    nearest = nearest.select(F.col("__dir").alias("__d"), F.col("near.dir").alias("__from"), F.col("near.of_dir").alias("__of"))

    found = docs.withColumn("__hash", F.xxhash64(text)).withColumn("__dir", directory_of(F.col(path)))
    found = found.join(own, F.col(path).eqNullSafe(F.col("__p")) & (F.col("__hash") == F.col("__t")), "left")
    found = found.join(nearest, F.col("__dir") == F.col("__d"), "left")
    itself = F.when(F.coalesce(name_of(F.col(path)), F.lit("")).rlike(licence_name), "file").otherwise("header")
    return (
        found.withColumn("license", F.coalesce("own_license", "__of"))
        .withColumn("license_from", F.when(F.col("own_license").isNotNull(), itself).otherwise(F.col("__from")))
        .drop("__hash", "__dir", "__p", "__t", "__d", "__from", "__of")
    )


def header_units(lines: Column, needle: Column) -> Column:
    """(place, terms) of the runs of lines that have one of the needed terms.

    Texts without such a line are not looked at further; runs begin at most seven lines before one.
    """
    step = max(HEADER_LINES)

    def runs(each: Column) -> Column:
        hits = F.transform(each, lambda x: F.arrays_overlap(x, needle))

        def around(i: Column) -> Column:
            near = F.exists(F.slice(hits, i + 1, step), lambda h: h)
            units = [
                F.when(
                    F.exists(F.slice(hits, i + 1, n), lambda h: h) & ((i + n <= F.size(each)) | (i == 0)),
                    F.struct((i.cast("bigint") * (step + 1) + n).alias("place"), F.flatten(F.slice(each, i + 1, n)).alias("terms")),
                )
                for n in HEADER_LINES
            ]
            return F.when(near, F.array_compact(F.array(*units)))

        found = F.transform(F.sequence(F.lit(0), F.size(each) - 1), around)
        return F.when(F.exists(hits, lambda h: h), F.flatten(F.filter(found, lambda x: x.isNotNull())))

    return F.inline_outer(bind(lines, runs))


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory_of(path: Column) -> Column:
    """All before the last slash; empty for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory, the one above, ... and the top, which is empty."""
    parts = F.split(directory, "/")
    up = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), F.size(parts) - k), "/")
    )
    return F.when(directory == "", F.array(F.lit(""))).otherwise(F.concat(up, F.array(F.lit(""))))
