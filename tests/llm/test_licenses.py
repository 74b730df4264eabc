"""Licence lines and the licences expected of them, written apart from the tables of ``licenses``."""

import textwrap

import pytest

from reelquery.llm import licenses

EXPECTED = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.": "CC-BY-NC-ND-4.0",
    "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License.": "CC-BY-NC-SA-3.0",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.": "CC-BY-4.0",
    "Licensed under the ISC License.": "ISC",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.": "ISC",
    "Released under the GNU Lesser General Public License, version 2.1.": "LGPL-2.1-only",
    "Licensed under the GNU Affero General Public License v3.0": "AGPL-3.0-only",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "Released under CC0 1.0 Universal": "CC0-1.0",
    "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    " * SPDX-License-Identifier: LGPL-3.0-or-later": "LGPL-3.0-or-later",
    "/* SPDX-License-Identifier: GPL-2.0+ */": "GPL-2.0-or-later",
    "SPDX-License-Identifier: BSD-3-Clause": "BSD-3-Clause",
    "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0",
    "Released under the MIT License.": "MIT",
    "License: MPL 2.0": "MPL-2.0",
    "Licensed under nothing that is known.": None,
}


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["licenses"] for r in licenses.recognise(rows).orderBy("doc_id").collect()]


def test_expected_lines(spark):
    assert found(spark, EXPECTED) == [[x] if x else [] for x in EXPECTED.values()]


def test_sentences_have_one_identifier_each():
    named = [(licenses.normal(s), n) for n, s in licenses.SENTENCES]
    assert all(licenses.known()[k] == n for k, n in named)
    assert {n for _, ids in licenses.RULES for n in ids} >= {n for n, _, _ in licenses.NAMES}


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def test_wrapped_headers(spark):
    headers = {"MIT": MIT, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL, "BSD-2-Clause": BSD, "MPL-2.0": MPL}
    texts, expected = [], []
    for licence, text in headers.items():
        for mark, end in (("", "\n"), (" * ", "\n"), ("// ", "\r\n"), ("# ", "\n"), ("dnl ", "\n"), ("C     ", "\n")):
            for width in (30, 72, 10_000):
                lines = [x for par in text.split("\n\n") for x in [*textwrap.wrap(par, width), ""]]
                texts.append(end.join(["first line", *(mark + x for x in lines), "last line"]))
                expected.append([licence])
    assert found(spark, texts) == expected


def test_parts_of_sentences_are_not_sentences(spark):
    texts = ["Unlike the MIT License this asks for\nmore.", "Released under the MIT License\nfor some", "released under the MIT Licenses", "MIT License, all rights reserved by us"]
    assert found(spark, texts) == [[], ["MIT"], [], []]


NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_rules_side_by_side(spark):
    bsd3 = BSD + "\n\n3. " + NAMES + "\n"
    texts = [bsd3, bsd3 * 2, bsd3 * 5, MIT + "\n" + MIT, BSD + "\n" + bsd3, GPL + "\n" + GPL + "\n" + MIT]
    assert found(spark, texts) == [["BSD-3-Clause"]] * 3 + [["MIT"], ["BSD-3-Clause", "BSD-2-Clause"], ["MIT", "GPL-3.0-or-later"]]


def test_very_long_text(spark):
    words = "lorem ipsum dolor sit amet. " * 60_000
    assert found(spark, [words + "\n" + MIT + "\n" + words, words, "license " * 200_000]) == [["MIT"], [], []]


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""


@pytest.mark.parametrize("names", ["Example Inc.", "the copyright holder", "the University of Somewhere, Department 7,", "<organization>", "wrapped\n * over two\n * lines"])
def test_third_clause_with_any_name(spark, names):
    third = f"3. Neither the name of {names} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    df = spark.createDataFrame([(1, BSD + third), (2, BSD), (3, third), (4, "Neither the name of the " + "very " * 40 + "long")], "doc_id long, text string")
    got = {r["doc_id"]: r["licenses"] for r in licenses.recognise(df).collect()}
    assert got == {1: ["BSD-3-Clause"], 2: ["BSD-2-Clause"], 3: [], 4: []}


@pytest.mark.parametrize("end", [" - see the LICENSE file for details", " \u2013 see the [LICENSE](LICENSE.md) file for details.", " (see LICENSE)", ", see LICENSE.txt"])
def test_a_pointer_to_the_licence_file(spark, end):
    df = spark.createDataFrame([(1, f"This project is licensed under the MIT License{end}\n")], "doc_id long, text string")
    assert licenses.recognise(df).first()["licenses"] == ["MIT"]
