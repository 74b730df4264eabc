"""Licence recognition by sentences, with DataFrame functions only.

A text is normalised (lower case, runs of anything but letters and digits become one blank) and cut at line ends and sentence
ends; runs of parts that make up known licence sentences are found, so a sentence may be wrapped, in comment marks, or hold a
sentence end inside; the identifiers found, in text order, are matched against ordered rules.  A rule is a sequence of identifiers that must follow one another in the text's sequence; the
first rules are the most specific, and what a rule has matched is not seen by later ones.

All of it is per row: no shuffle, no broadcast beyond the fixed tables below, and no Python on the executors.  Every known
sentence holds one of ``TRIGGERS``, so texts without any are settled by a substring test.

A null or empty text has no sentence and no licence.  Sentences that match nothing are left out of the sequence; repeated
ones stay.  Texts of any length are read whole; repeated rows give equal rows; an empty table gives none; other columns travel along.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and sentence.  Licence texts are public; SPDX names are used for the licences.
SENTENCES = [
    ("mit_ref", "Released under the MIT License."),
    ("mit_ref", "Licensed under the MIT License."),
    ("mit_ref", "This project is licensed under the MIT License."),
    ("mit_ref", "The MIT License (MIT)"),
    ("mit_ref", "MIT License"),
    ("mit_grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit_notice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("as_is", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    ("apache2_ref", "Licensed under the Apache License, Version 2.0."),
    ("apache2_ref", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("apache2_ref", "Released under the Apache License, Version 2.0."),
    ("apache2_comply", "you may not use this file except in compliance with the License."),
    ("apache2_copy", "You may obtain a copy of the License at"),
    ("apache2_as_is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl3_ref", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl3_ref", "Released under the GNU General Public License, version 3."),
    ("gpl2_ref", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl_free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl_hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd_grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd_source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd_binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd_names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("cc_by4_ref", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc_by_sa4_ref", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("mpl2_ref", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all_rights", "All rights reserved."),
    ("gpl2_free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("lgpl21_free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("lgpl3_free", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl3_free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("agpl3_free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl_hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("isc_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc_grant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd0_grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("unlicense_free", "This is free and unencumbered software released into the public domain."),
    ("cc0_waiver", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("cc0_waiver", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    ("zlib_grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("bsl1_ref", "Distributed under the Boost Software License, Version 1.0."),
]
#: Identifier, licence and names; each name follows each of ``LEADS``, with ``the`` or without.
NAMES = [
    ("mit_ref", "MIT", ["MIT", "MIT License"]),
    ("apache2_ref", "Apache-2.0", ["Apache 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache License, Version 2.0"]),
    ("gpl3_later_ref", "GPL-3.0-or-later", ["GPL 3.0 or later", "GNU GPL v3 or later", "GPLv3 or later", "GNU General Public License, version 3 or later", "GNU General Public License v3.0 or later"]),
    ("gpl3_ref", "GPL-3.0-only", ["GPL 3.0", "GPL 3.0 only", "GPLv3", "GPL v3", "GNU GPL v3", "GNU GPLv3", "GNU General Public License, version 3", "GNU General Public License v3.0"]),
    ("gpl2_later_ref", "GPL-2.0-or-later", ["GPL 2.0 or later", "GNU GPL v2 or later", "GPLv2 or later", "GNU General Public License, version 2 or later", "GNU General Public License v2.0 or later"]),
    ("gpl2_ref", "GPL-2.0-only", ["GPL 2.0", "GPL 2.0 only", "GPLv2", "GPL v2", "GNU GPL v2", "GNU GPLv2", "GNU General Public License, version 2", "GNU General Public License v2.0"]),
    ("lgpl3_later_ref", "LGPL-3.0-or-later", ["LGPL 3.0 or later", "LGPLv3 or later", "GNU Lesser General Public License, version 3 or later"]),
    ("lgpl3_ref", "LGPL-3.0-only", ["LGPL 3.0", "LGPL 3.0 only", "LGPLv3", "GNU LGPLv3", "GNU LGPL v3", "GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0"]),
    ("lgpl21_later_ref", "LGPL-2.1-or-later", ["LGPL 2.1 or later", "LGPLv2.1 or later", "GNU Lesser General Public License, version 2.1 or later"]),
    ("lgpl21_ref", "LGPL-2.1-only", ["LGPL 2.1", "LGPL 2.1 only", "LGPLv2.1", "GNU LGPL v2.1", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1"]),
    ("agpl3_later_ref", "AGPL-3.0-or-later", ["AGPL 3.0 or later", "AGPLv3 or later", "GNU Affero General Public License, version 3 or later"]),
    ("agpl3_ref", "AGPL-3.0-only", ["AGPL 3.0", "AGPL 3.0 only", "AGPLv3", "GNU AGPLv3", "GNU AGPL v3", "GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0"]),
    ("bsd3_ref", "BSD-3-Clause", ["BSD 3 Clause", "BSD 3 Clause License", "3 Clause BSD License", "New BSD License"]),
    ("bsd2_ref", "BSD-2-Clause", ["BSD 2 Clause", "BSD 2 Clause License", "2 Clause BSD License", "Simplified BSD License"]),
    ("bsd0_ref", "0BSD", ["0BSD", "0BSD License", "BSD Zero Clause License"]),
    ("isc_ref", "ISC", ["ISC", "ISC License"]),
    ("mpl2_ref", "MPL-2.0", ["MPL 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0"]),
    ("epl2_ref", "EPL-2.0", ["EPL 2.0", "Eclipse Public License 2.0", "Eclipse Public License, v. 2.0", "Eclipse Public License, version 2.0"]),
    ("bsl1_ref", "BSL-1.0", ["BSL 1.0", "Boost Software License 1.0", "Boost Software License, Version 1.0"]),
    ("zlib_ref", "Zlib", ["Zlib", "zlib License"]),
    ("unlicense_ref", "Unlicense", ["Unlicense"]),
    ("cc0_ref", "CC0-1.0", ["CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License"]),
    *[
        (f"cc_{code.lower().replace('-', '_')}{v}_ref", f"CC-{code}-{v}.0", [f"CC {code} {v}.0", f"CC {code} {v}.0 License", *(f"{a}Creative Commons {words} {v}.0 {kind}{end}" for a in ("", "a ") for kind in kinds for end in ("", " License"))])
        for v, kinds in ((4, ("International",)), (3, ("Unported",)))
        for code, words in (
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
            ("BY-ND", "Attribution-NoDerivatives"), ("BY-SA", "Attribution-ShareAlike"), ("BY", "Attribution"),
        )
    ],
]
LEADS = (
    "Licensed under", "Released under", "Distributed under", "Available under", "License:", "SPDX-License-Identifier:",
    *(f"This {what} is licensed under" for what in ("work", "project", "software", "program", "code", "file", "document", "content")),
)
#: Licence and the sequence of identifiers it takes, most specific first.
RULES = [
    ("MIT", ["mit_grant", "mit_notice", "as_is"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["apache2_ref", "apache2_comply", "apache2_copy", "apache2_as_is"]),
    ("Apache-2.0", ["apache2_ref", "apache2_comply"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope"]),
    ("GPL-2.0-or-later", ["gpl2_free", "gpl_hope"]),
    ("LGPL-2.1-or-later", ["lgpl21_free", "gpl_hope"]),
    ("LGPL-3.0-or-later", ["lgpl3_free", "gpl_hope"]),
    ("AGPL-3.0-or-later", ["agpl3_free", "gpl_hope"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("LGPL-2.1-or-later", ["lgpl21_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("ISC", ["isc_grant"]),
    ("0BSD", ["bsd0_grant"]),
    ("Zlib", ["zlib_grant"]),
    ("Unlicense", ["unlicense_free"]),
    ("CC0-1.0", ["cc0_waiver"]),
    *[(licence, [name]) for name, licence, _ in NAMES],
    ("Proprietary", ["all_rights"]),
]
TRIGGERS = ("licen", "permi", "warrant", "redistribut", "copyright", "rights", "unencumbered", "distributed", "released", "available")
#: Within a line, a sentence ends at . ! ? ; : with a blank behind it; a pointer to a file, as in `` - see the LICENSE file``, is another sentence.
END = "[.!?;:] "
POINTER = "[ ,]*[-\u2013\u2014,(] *(?=see )"
#: The third BSD clause names the holder or an organisation, in any words; it is known with these.
NAMED = ("neither[ \\n]the[ \\n]name[ \\n]of[ \\n](?:[a-z0-9]+[ \\n]){1,16}?nor[ \\n]the[ \\n]names[ \\n]of", "neither the name of the copyright holder nor the names of")


def normal(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def known() -> dict[str, str]:
    """Normalised sentence to identifier."""
    out: dict[str, str] = {}
    named = [(name, f"{lead} {the}{n}") for name, _, names in NAMES for n in names for lead in LEADS for the in (("",) if lead.endswith(":") else ("", "the "))]
    for name, sentence in SENTENCES + named:
        key = normal(sentence)
        if not any(t in key for t in TRIGGERS):
            raise ValueError(f"no trigger in {sentence!r}")
        out[key] = name
    return out


def spread(sentences: list[str]) -> str:
    """A regular expression for normalised sentences, the longest first, whose words may stand on several lines."""
    tree: dict = {}
    for s in sentences:
        node = tree
        for word in s.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def after(node: dict) -> str:
        if "" not in node:
            return "[ \\n]" + write(node)
        return "(?=\\n)" if len(node) == 1 else "(?:[ \\n]" + write(node) + "|(?=\\n))"

    def write(node: dict) -> str:
        ways = [word + after(node[word]) for word in node if word]
        return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"

    return "(?<=\\n)" + write(tree)


def _parts(c: Column) -> Column:
    """Normalised text in which every line end and sentence end is one line feed, also at both ends.

    Comment marks go with the rest of the signs; those that are words go at the start of a line.
    """
    c = F.regexp_replace(F.lower(c), r"(?m)^[ \t]*(?:dnl|rem|c)(?=[ \t\r\n]|\z)", "")
    c = F.regexp_replace(c, "(?<=[0-9])\\+", " or later")  # the + of GPL-2.0+ must not be lost
    c = F.regexp_replace(F.regexp_replace(c, f"{END}|{POINTER}", "\n"), "[^a-z0-9\n]+", " ")
    c = F.regexp_replace(F.concat(F.lit("\n"), c, F.lit("\n")), " *\n[ \n]*", "\n")
    return F.regexp_replace(c, f"(?<=\n){NAMED[0]}", NAMED[1])


def sentence_ids(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order; an empty array if there are none.

    A sentence starts and ends at line ends or sentence ends; between, it may hold any of them, so it is found when wrapped.
    Where two start at the same place the longer one counts.
    """
    keys = known()
    table = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in keys.items())), F.lit(","), F.lit(":"))
    hits = F.regexp_extract_all(_parts(text), F.lit(spread(list(keys))), F.lit(0))
    ids = F.transform(hits, lambda s: F.element_at(table, F.translate(s, "\n", " ")))
    low = F.lower(text)
    any_trigger = low.contains(TRIGGERS[0])
    for t in TRIGGERS[1:]:
        any_trigger = any_trigger | low.contains(t)
    return F.when(F.coalesce(any_trigger, F.lit(False)), ids).otherwise(F.array().cast("array<string>"))


def apply_rules(sequence: Column) -> Column:
    """Licences of ``,id,,id,...``: each rule in turn, its matches taken out.  Every identifier has commas of its own, so matches side by
    side are all found."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{i}," for i in ids)).alias("ids")) for name, ids in RULES])
    step = lambda s, r: F.when(s["left"].contains(r["ids"]), F.struct(F.replace(s["left"], r["ids"], F.lit(",-,")).alias("left"), F.array_append(s["found"], r["name"]).alias("found"))).otherwise(s)
    none = F.array().cast("array<string>")
    found = F.aggregate(rules, F.struct(sequence.alias("left"), none.alias("found")), step, lambda s: s["found"])
    return F.when(sequence == "", none).otherwise(F.array_distinct(found))


def recognise(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``license_sentences array<string>`` and ``licenses array<string>``; columns of these names are replaced."""
    docs = docs.drop("license_sentences", "licenses")
    out = docs.withColumn("license_sentences", sentence_ids(F.col(text)))
    sequence = F.array_join(F.transform("license_sentences", lambda i: F.concat(F.lit(","), i, F.lit(","))), "")
    return out.withColumn("licenses", apply_rules(sequence))


def oracle_sql() -> str:
    """The same over ``documents`` in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in known().items())
    norm = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'), ' ')"
    steps, found, seq = [], [], "s0"
    for i, (name, ids) in enumerate(RULES):
        pattern = quote("".join(f"<{x}>" for x in ids))
        found.append(f"CASE WHEN contains(s{i}, {pattern}) THEN {quote(name)} END")
        steps.append(f"r{i + 1} AS (SELECT *, replace(s{i}, {pattern}, '<>') AS s{i + 1} FROM r{i})")
        seq = f"r{i + 1}"
    return f"""WITH known(k, id) AS (VALUES {values}),
lines AS (SELECT row, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT row_number() OVER () AS row, doc_id, string_split(text, chr(10)) AS ls FROM documents)),
whole AS (SELECT row, doc_id, ln, 0 AS sn, id, line FROM lines LEFT JOIN known ON k = {norm('line')}),
parts AS (SELECT row, ln, unnest(ss) AS s, generate_subscripts(ss, 1) AS sn FROM (SELECT row, ln, regexp_split_to_array(line, '{END}') AS ss FROM whole WHERE id IS NULL)),
ids AS (SELECT row, ln, sn, id FROM whole WHERE id IS NOT NULL UNION ALL SELECT row, ln, sn, known.id FROM parts JOIN known ON k = {norm('s')}),
seqs AS (SELECT row, count(*) AS n, string_agg(id, ',' ORDER BY ln, sn) AS ids, string_agg('<' || id || '>', '' ORDER BY ln, sn) AS marked FROM ids GROUP BY row),
r0 AS (SELECT doc_id, coalesce(n, 0)::BIGINT AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(marked, '') AS s0 FROM (SELECT row_number() OVER () AS row, doc_id FROM documents) LEFT JOIN seqs USING (row)),
{', '.join(steps)},
f AS (SELECT doc_id, n_sentences, sentence_ids, list_filter([{', '.join(found)}], lambda x: x IS NOT NULL) AS l FROM {seq})
SELECT doc_id, n_sentences, sentence_ids, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS licenses FROM f"""


def digests(recognised: DataFrame) -> DataFrame:
    return recognised.select("doc_id", F.size("license_sentences").cast("long").alias("n_sentences"), F.array_join("license_sentences", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))
