"""Licence notices in documents by MinHash over overlapping text windows (native columns only).

Templates are filed by size: a template of m shingles belongs to the class of
the next power of two S >= m, whose windows are 2S shingles long and start
every S, so that any place of S shingles lies inside one window. A window that
holds a template whole then has a Jaccard similarity of at least 1/4 with it
(m > S/2), one that holds 80 % of it at least 0.8/4.2. With 32 bands of one
MinHash value the two share a band with probability 1 - (3/4)^32 > 0.9998 and
1 - (1 - 0.8/4.2)^32 > 0.998. Retrieved pairs are verified by the exact share
of the template's shingles inside the window.

Notices are shorter than five words at times, so shingles here have three.
Only windows that hold a shingle of some template are hashed: no other window
can share a minimum with one.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

SHINGLE = 3
BANDS = 32
MIN_CONTAINMENT = 0.8

# Notices, titles and telling clauses as the licences word them. Where two licences differ in a name or
# a version only, the passage is short enough that the difference takes it below MIN_CONTAINMENT.
_PASSAGES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "under the Apache License, Version 2.0"),
    ("apache-2.0", "Apache License Version 2.0, January 2004"),
    ("apache-2.0", "you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met:"),
    ("bsd-3-clause", "nor the names of its contributors may be used to endorse or promote products derived from "
                     "this software without specific prior written permission"),
    ("gpl", "terms of the GNU General Public License as published"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-2.0", "GNU General Public License Version 2, June 1991"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("gpl-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("lgpl", "terms of the GNU Lesser General Public License as published"),
    ("lgpl", "terms of the GNU Library General Public License as published"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "Lesser General Public License, version 3"),
    ("agpl", "terms of the GNU Affero General Public License as published"),
    ("agpl-3.0", "Affero General Public License, version 3"),
    ("mpl-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl-2.0", "Mozilla Public License, version 2.0"),
    ("epl-1.0", "Eclipse Public License - v 1.0"),
    ("epl-2.0", "Eclipse Public License - v 2.0"),
    ("epl-2.0", "terms of the Eclipse Public License 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "under the ISC License"),
    ("0bsd", "BSD Zero Clause License"),
    ("0bsd", "Zero-Clause BSD"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original "
             "software"),
    ("bsl-1.0", "Boost Software License - Version 1.0"),
    ("bsl-1.0", "obtaining a copy of the software and accompanying documentation covered by this license"),
    ("busl-1.1", "Business Source License 1.1"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("wtfpl", "Do What The Fuck You Want To Public License"),
    ("artistic-2.0", "The Artistic License 2.0"),
    ("cc0-1.0", "CC0 1.0 Universal"),
    ("cc0-1.0", "creativecommons.org/publicdomain/zero/1.0"),
    ("cc-pdm-1.0", "creativecommons.org/publicdomain/mark/1.0"),
    ("gfdl", "terms of the GNU Free Documentation License"),
    ("odbl-1.0", "Open Database License (ODbL) v1.0"),
    ("odbl-1.0", "under the Open Database License"),
    ("ofl-1.1", "SIL Open Font License, Version 1.1"),
    ("mit", "The MIT License (MIT)"),
    ("mit", "MIT License Copyright (c)"),
    ("mit", "under the MIT License"),
)
_SPDX = ("MIT", "MIT-0", "ISC", "0BSD", "Zlib", "Unlicense", "WTFPL", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause",
         "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-1.1", "MPL-2.0", "EPL-1.0",
         "EPL-2.0", "EUPL-1.2", "BSL-1.0", "BUSL-1.1", "Artistic-2.0", "CC0-1.0", "ODbL-1.0", "OFL-1.1")
_CC = {"by": "Attribution", "by-sa": "Attribution-ShareAlike", "by-nd": "Attribution-NoDerivatives",
       "by-nc": "Attribution-NonCommercial", "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
       "by-nc-nd": "Attribution-NonCommercial-NoDerivatives"}


def _creative_commons():
    """Name, short name (also that of SPDX tags) and address of every licence and version."""
    for kind, name in _CC.items():
        for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            word = name if version == "4.0" else name.replace("NoDerivatives", "NoDerivs")
            for text in (f"Commons {word} {version}", f"CC {kind} {version}", f"licenses/{kind}/{version}"):
                yield f"cc-{kind}-{version}", text


TEMPLATES = (
    *_PASSAGES, *_creative_commons(), *((i.lower(), f"SPDX-License-Identifier: {i}") for i in _SPDX),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction"),
)


def _tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    body = F.regexp_replace(F.lower(c), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"[^\p{L}\p{N}]+"))


def _shingles(t: str) -> Column:
    return F.expr(f"case when size({t}) >= {SHINGLE} then transform(sequence(0, size({t}) - {SHINGLE}), "
                  f"i -> xxhash64(" + ", ".join(f"{t}[i + {j}]" for j in range(SHINGLE)) + ")) else array() end")


def _bands(h: str) -> Column:
    """Array of (band, value): the minimum of each of the hash functions."""
    def band(k: int) -> Column:
        return F.struct(F.lit(k).alias("band"),
                        F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(k)))).alias("value"))

    return F.array(*[band(k) for k in range(BANDS)])


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, licence, h, m, size): distinct shingle hashes and window class of every template."""
    rows = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(templates)],
                                 "template int, licence string, text string")
    rows = rows.withColumn("_w", _tokens(F.col("text"))).withColumn("h", F.array_distinct(_shingles("_w")))
    m = F.size("h")
    return rows.where(m > 0).select("template", "licence", "h", m.alias("m"),
                                    F.pow(F.lit(2), F.ceil(F.log2(m))).cast("int").alias("size"))


def find_licences(docs: DataFrame, templates=TEMPLATES, min_containment: float = MIN_CONTAINMENT) -> DataFrame:
    """Licence notices in every document.

    Returns one row per (doc_id, licence): doc_id, licence, containment (of the
    best window, 6 digits), first_word (number of the first word, from 0, of the
    first window that holds it), n_windows. Null and short texts have none;
    repeated rows are merged with the row they repeat; an empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    # the templates are a parameter of the job: a few thousand numbers at most
    table = template_table(spark, templates).collect()
    known = sorted({h for r in table for h in r["h"]})
    sizes = sorted({r["size"] for r in table})
    t = docs.select("doc_id", text_or_empty("text").alias("_t"))
    t = t.withColumn("_w", _tokens(F.col("_t"))).withColumn("_h", _shingles("_w"))
    t = t.withColumn("_at", F.filter(F.transform("_h", lambda h, i: F.when(h.isin(known), i)),
                                     lambda i: i.isNotNull()))
    # no filter here: pushed below the projections it would evaluate them once per element
    t = materialize(t.select("doc_id", F.when(F.size("_at") > 0, F.col("_h")).alias("_h"), "_at"), "notices")
    t = t.where("_h is not null")
    # every window that holds one of those places, for every class
    def windows(s: int) -> Column:
        return F.array_distinct(F.flatten(F.transform("_at", lambda i: F.transform(
            F.sequence(F.greatest(F.floor(i / F.lit(s)) - 1, F.lit(0)), F.floor(i / F.lit(s))),
            lambda w: F.struct(F.lit(s).alias("size"), w.alias("window"))))))

    numbers = F.flatten(F.array(*[windows(s) for s in sizes]))
    w = t.select("doc_id", "_h", F.explode(numbers).alias("_n")).select(
        "doc_id", "_n.size", "_n.window",
        F.expr("slice(_h, cast(_n.window * _n.size + 1 as int), 2 * _n.size)").alias("wh"))
    values = w.select("doc_id", "size", "window", "wh", F.explode(_bands("wh")).alias("_b")).select(
        "doc_id", "size", "window", "wh", "_b.band", "_b.value")
    index = template_table(spark, templates).select("template", "licence", "h", "m", "size",
                                                    F.explode(_bands("h")).alias("_b")).select(
        "template", "licence", "h", "m", "size", "_b.band", "_b.value")
    # the index has BANDS rows per template of the parameter
    found = values.join(F.broadcast(index), ["size", "band", "value"])
    share = F.size(F.array_intersect("wh", "h")) / F.col("m")
    found = found.withColumn("share", share).where(F.col("share") >= min_containment)
    return found.groupBy("doc_id", "licence").agg(
        F.round(F.max("share"), 6).alias("containment"),
        F.min(F.col("window") * F.col("size")).cast("long").alias("first_word"),
        F.countDistinct("size", "window").alias("n_windows"))
