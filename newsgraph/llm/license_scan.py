"""Operator 9, licence scans: known licence sentences, and the sequences that make a licence.

A text is cut into sentences, once with line ends as borders and once with line ends as blanks
(licence texts are often wrapped). Normalised sentences map to identifiers, identifiers in text
order are matched against ordered rules, longest first. Foreign sentences break a rule: no more
than ``gap`` of them may stand between two of its sentences (numbers of a list count as
sentences); lines that only state a copyright do not count. It is one projection over the
documents: no join, no shuffle. DataFrame functions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from newsgraph.functions.plan import once

# Sentences of published licences and of their usual notices, by identifier.
SENTENCES = {
    "mit-notice": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT", "The MIT License", "MIT License"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'],
    "mit-keep": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "mit-warranty": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'],
    "apache-notice": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License 2.0", "This project is licensed under the Apache License, Version 2.0"],
    "apache-file": ['Licensed under the Apache License, Version 2.0 (the "License")'],
    "apache-use": ["you may not use this file except in compliance with the License"],
    "apache-basis": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'],
    "gpl3-notice": ["This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only", "Released under the GPLv3"],
    "gpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2-later": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
                 "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "lgpl21-later": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "lgpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "lgpl-hope": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "agpl3-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "epl2-notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "Eclipse Public License - v 2.0"],
    "zlib-asis": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-liable": ["In no event will the authors be held liable for any damages arising from the use of this software"],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
    "bsl-notice": ["Distributed under the Boost Software License, Version 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "bsl-grant": ['Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-define": ['"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document'],
    "apache-grant": ["Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-names": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd2-notice": ["SPDX-License-Identifier: BSD-2-Clause"],
    "bsd3-notice": ["SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD 3-Clause License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "mpl-notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-nc-notice": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-notice": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-notice": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc0-notice": ["Licensed under CC0 1.0", "SPDX-License-Identifier: CC0-1.0"],
    "unlicense": ["This is free and unencumbered software released into the public domain"],
    "reserved": ["All rights reserved"],
}
# Licences that texts name by their short identifier, besides those above.
SPDX = ["GPL-2.0-only", "GPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later",
        "AGPL-3.0-only", "AGPL-3.0-or-later", "EPL-2.0", "Zlib", "BSL-1.0", "ISC", "0BSD", "Unlicense", "CC-BY-4.0", "CC-BY-SA-4.0"]
# Rules in their order of precedence, longest sequences first.
RULES = [
    ("MIT", ["mit-grant", "mit-keep", "mit-warranty"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-file", "apache-use", "apache-basis"]),
    ("Apache-2.0", ["apache-file", "apache-use"]),
    ("GPL-2.0-or-later", ["gpl2-later", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl3-later", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl21-later", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-later", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-later", "gpl-hope"]),
    ("Zlib", ["zlib-asis", "zlib-liable", "zlib-grant"]),
    ("Apache-2.0", ["apache-terms", "apache-define"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-file"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("BSD-2-Clause", ["bsd2-notice"]),
    ("BSD-3-Clause", ["bsd3-notice"]),
    ("ISC", ["isc-grant"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("Unlicense", ["unlicense"]),
    ("LGPL-2.1-or-later", ["lgpl21-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("BSL-1.0", ["bsl-notice"]),
    ("Apache-2.0", ["apache-grant"]),
    *[(name, [f"spdx-{name}"]) for name in SPDX],
]
#: Foreign sentences that may stand between two sentences of a rule.
GAP = 3

#: Borders of sentences besides line ends, or in place of them a blank line.
LINES, WRAPPED = r"[.!?]+[ \t\r\n]+|\n", r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n"


def normal(sentence: str) -> str:
    return re.sub("[^A-Za-z0-9]+", " ", sentence).strip(" ").lower()


def identifiers() -> dict[str, str]:
    """Normalised sentence to identifier; a known sentence that a text cuts counts by its longest part."""
    out = {normal(f"SPDX-License-Identifier: {name}"): f"spdx-{name}" for name in SPDX}
    for name, sentences in SENTENCES.items():
        for sentence in sentences:
            parts = re.split(LINES, sentence)
            out[normal(max(parts, key=len))] = name
    return out


#: What stands for a holder's name in a sentence, and a statement of copyright.
HOLDER = r"^neither the name of .{1,200} nor the names of (its|their) contributors "
NAMED = "neither the name of the copyright holder nor the names of its contributors "
NAMES = normal(SENTENCES["bsd-names"][0])
COPYRIGHT = r"^(c |copyright ).*[0-9]{4}"


def rule_pattern(gap: int, rules=RULES) -> str:
    """Any rule, in order of precedence: its identifiers in angle brackets, up to ``gap`` question marks between two."""
    return "|".join((r"\?{0,%d}" % gap).join(f"<{name}>" for name in names) for _, names in rules)


def sequences(rules=RULES) -> dict[str, str]:
    """The bracketed identifiers of a rule to its licence."""
    return {"".join(f"<{name}>" for name in names): licence for licence, names in rules}


def _known(text: Column, borders: str) -> Column:
    """Per sentence, in text order: its identifier in brackets, ``?`` if foreign, empty for a statement of copyright."""
    known = identifiers()
    table = F.create_map(*[F.lit(x) for k, v in known.items() for x in (k, f"<{v}>")])
    cut = F.transform(F.split(text, borders), lambda s: F.lower(
        F.btrim(F.regexp_replace(s, "[^A-Za-z0-9]+", " "), F.lit(" "))))

    def name(s):
        # a hash lookup for all, the linear one of a map for known sentences only
        return (F.when(s.isin(list(known)), F.try_element_at(table, s))
                .when(s.startswith("neither the name of ") & (F.regexp_replace(s, HOLDER, NAMED) == NAMES), "<bsd-names>")
                .when((s.startswith("copyright ") | s.startswith("c ")) & s.rlike(COPYRIGHT), "").otherwise("?"))
    return F.transform(F.filter(cut, lambda s: s != ""), name)


def license_scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """``docs`` with n_sentences, n_known and licenses (array, sorted, each once).

    Sentences are counted with line ends as borders. A null or empty text has none. Columns of
    these names are replaced; all rows stay, repeated ones and those without an id too.
    """
    docs = docs.drop("n_sentences", "n_known", "licenses")
    own = docs.columns
    licence = F.create_map(*[F.lit(x) for pair in sequences().items() for x in pair])
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*own, once(_known(text, LINES)).alias("_lines"), once(_known(text, WRAPPED)).alias("_wrapped"))
    matched = lambda c: F.transform(
        F.regexp_extract_all(F.array_join(c, ""), F.lit(f"({rule_pattern(gap)})"), F.lit(1)),
        lambda s: licence[F.replace(s, F.lit("?"), F.lit(""))])
    return found.select(
        *own, F.size("_lines").cast("long").alias("n_sentences"),
        F.size(F.filter("_lines", lambda s: s.startswith("<"))).cast("long").alias("n_known"),
        F.array_sort(F.array_distinct(F.array_union(matched("_lines"), matched("_wrapped")))).alias("licenses"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_sentences, n_known, n_licenses, licenses (comma-joined)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).select(
        "doc_id", "n_sentences", "n_known", F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses", ",").alias("licenses"))


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(f'<{v}>')})" for k, v in identifiers().items())
    rules = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in sequences().items())
    pattern = rule_pattern(GAP)
    return rf"""
WITH known(sentence, name) AS (VALUES {known}),
rules(seq, licence) AS (VALUES {rules}),
cut AS (
  SELECT doc_id, 'lines' AS kind, regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \t\r\n]+|\n') AS parts FROM documents
  UNION ALL
  SELECT doc_id, 'wrapped', regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \t\r\n]+|\n[ \t\r]*\n') FROM documents),
sentences AS (
  SELECT doc_id, kind, pos, lower(trim(regexp_replace(part, '[^A-Za-z0-9]+', ' ', 'g'), ' ')) AS sentence
  FROM (SELECT doc_id, kind, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut)),
counted AS (
  SELECT doc_id, kind, count(*) FILTER (s.sentence <> '') AS n, count(name) AS hits,
         string_agg(coalesce(name, CASE WHEN regexp_matches(s.sentence, '{COPYRIGHT}') THEN '' ELSE '?' END), '' ORDER BY pos)
             FILTER (s.sentence <> '') AS seq
  FROM (SELECT * REPLACE (regexp_replace(sentence, '{HOLDER}', '{NAMED}') AS sentence) FROM sentences) s
  LEFT JOIN known k ON s.sentence = k.sentence GROUP BY doc_id, kind),
found AS (
  SELECT DISTINCT doc_id, licence
  FROM (SELECT doc_id, replace(unnest(regexp_extract_all(seq, '{pattern}')), '?', '') AS seq FROM counted) JOIN rules USING (seq)),
listed AS (SELECT doc_id, count(*) AS n, string_agg(licence, ',' ORDER BY licence) AS licenses FROM found GROUP BY doc_id)
SELECT c.doc_id, c.n AS n_sentences, c.hits AS n_known, coalesce(l.n, 0) AS n_licenses, coalesce(licenses, '') AS licenses
FROM counted c LEFT JOIN listed l USING (doc_id) WHERE kind = 'lines'
"""


#: The same for DuckDB.
LICENSE_SCAN_SQL = _sql()
