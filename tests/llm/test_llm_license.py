"""License scan on held-out wordings and on the given lines."""

import random
import textwrap
import time

import pytest

from veladura.llm import license_scan as ls
from veladura.llm.queries import QUERIES

#: The licence lines of the given documents.
GIVEN = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
}


@pytest.fixture(scope="module")
def scanner():
    return ls.Scanner(ls.fit_licenses(["Some words of no weight stand here.", "of the and to in"]))


def test_held_out_variants(scanner):
    chance, right, total = random.Random(99), 0, 0
    for family, texts in ls.TEMPLATES.items():
        for t in texts:
            for _ in range(10):
                judged = scanner.judge(" ".join(ls._variant(ls.words_of(t), chance)))
                right += judged is not None and judged[0] == family
                total += 1
    assert right / total > 0.85


def test_ordinary_sentences_are_no_licence(scanner):
    for text in (*ls.NEGATIVES, "", "license", "She lost her driving license under the bridge."):
        assert scanner.judge(text) is None or scanner.judge(text)[0] == "unknown"
    assert sum(scanner.judge(t) is not None for t in ls.NEGATIVES) <= 2


def test_notices(scanner):
    assert scanner.judge("Copyright 2020 X. Licensed under the MIT License.")[0] == "MIT"
    found = scanner.scan("Words.\nReleased under the MIT License.\nMore words.\n\nLicensed under CC BY-NC 4.0.")
    assert [(f["family"], f["start"], f["end"]) for f in found] == [
        ("MIT", 7, 38), ("CC-BY-NC-4.0", 52, 80),
    ]
    wrapped = ls.TEMPLATES["BSD-3-Clause"][2].replace(" and ", "\nand ")
    assert {f["family"] for f in scanner.scan(wrapped)} <= {"BSD-3-Clause", "unknown"}


GNU = (
    "This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2} as "
    "published by the Free Software Foundation{3} either version {4} of the License, or any later version."
)

NEIGHBOURS = {
    GNU.format("program", ":", "Affero General Public License", ",", "3"): "AGPL-3.0",
    GNU.format("program", ":", "General Public License", ",", "3"): "GPL-3.0",
    GNU.format("program", ";", "General Public License", ";", "2"): "GPL-2.0",
    GNU.format("program", ";", "General Public License", ";", "1"): "unknown",
    GNU.format("library", ";", "Lesser General Public License", ";", "2.1"): "LGPL-2.1",
    GNU.format("library", ";", "Lesser General Public License", ";", "3"): "LGPL-3.0",
    GNU.format("library", ";", "Library General Public License", ";", "2"): "unknown",
    "This work is licensed under the GNU Free Documentation License, version 3.": "unknown",
    "Licensed under the Apache License, Version 1.1.": "unknown",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under the Mozilla Public License, version 1.1.": "unknown",
    "Licensed under the Eclipse Public License, version 1.0.": "EPL-1.0",
    "Licensed under the Eclipse Public License, version 2.0.": "EPL-2.0",
    "Licensed under CC BY-NC-SA 4.0.": "unknown",
    "Licensed under CC BY 3.0.": "unknown",
    "Licensed under the BSD 2-Clause License.": "BSD-2-Clause",
    "Licensed under the zlib License.": "Zlib",
    "Licensed under the ISC License.": "ISC",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met": "unknown",
}


@pytest.mark.parametrize("notice", NEIGHBOURS)
def test_neighbouring_licences_are_told_apart(scanner, notice):
    judged = scanner.judge(notice)
    assert judged is not None and judged[0] == NEIGHBOURS[notice]


FORMS = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "# SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0",
    "SPDX-License-Identifier: (Apache-2.0 OR MIT)": "Apache-2.0 OR MIT",
    "/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */": "GPL-2.0",
    "SPDX-License-Identifier: LicenseRef-Own": "unknown",
    "MIT License": "MIT",
    "The MIT License (MIT)": "MIT",
    "License: MIT": "MIT",
    "License: BSD-3-Clause": "BSD-3-Clause",
    "Apache License\nVersion 2.0, January 2004": "Apache-2.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0",
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999": "LGPL-2.1",
    "This tool is licensed under GPLv3.": "GPL-3.0",
    "licensed under GPLv3": "GPL-3.0",
    "The Artistic License 2.0": "Artistic-2.0",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": "Apache-2.0 OR MIT",
    "This code is not licensed under the MIT License.": "unknown",
    "The tool is no longer released under the MIT License.": "unknown",
    "It isn't licensed under the Apache License, Version 2.0.": "unknown",
}


@pytest.mark.parametrize("text", FORMS)
def test_short_several_and_negated_forms(scanner, text):
    found = scanner.scan(f"Some words.\n\n{text}\n\nMore words.")
    sure = {f["family"] for f in found} - ({"unknown"} if FORMS[text] != "unknown" else set())
    assert sure == {FORMS[text]}


def test_mentions_are_no_notices(scanner):
    for text in ("We compared the MIT License with all the others in class today.", "MIT is in Cambridge.",
                 "Version 2.0 was released under the new name.", "The license: it is long."):
        assert not {f["family"] for f in scanner.scan(text)} - {"unknown"}, text


def test_several_families_of_a_document(spark, scanner):
    rows = [(1, "x\nSPDX-License-Identifier: Apache-2.0 OR MIT\ny"), (2, "This is not licensed under the MIT License.")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = {r.doc_id: (r.license, r.families) for r in ls.scan_licenses(df, scanner.model).collect()}
    assert out == {1: ("MIT", ["Apache-2.0", "MIT"]), 2: ("unknown", [])}


def test_very_long_paragraph(scanner):
    began = time.time()
    scanner.scan("licensed under the terms of the word " * 60_000)
    assert time.time() - began < 20


def test_every_template_bears_a_mark_of_its_family_alone(scanner):
    for family, texts in ls.TEMPLATES.items():
        for t in texts:
            assert [f for f in ls.MARKS if scanner.distinct(f, ls.words_of(t))] == [family], t


def wrapped_notices():
    for family, texts in ls.TEMPLATES.items():
        for t in texts:
            for width in (70, 75, 80):
                lines = textwrap.wrap(t, width)
                if len(lines) > 1:
                    yield family, "\n".join(lines)
                    yield family, "\n".join(f" * {line}" for line in lines)


def test_wrapped_notices_are_confirmed(scanner):
    notices = list(wrapped_notices())
    assert {family for family, _ in notices} == set(ls.TEMPLATES)
    for family, notice in notices:
        found = scanner.scan(f"Some words.\n\n{notice}\n\nMore words.")
        assert {f["family"] for f in found} - {"unknown"} == {family}, notice
        named = any(scanner.named(family, ls.words_of(line)) for line in notice.split("\n"))
        if not named:  # by one of its lines
            assert [(f["family"], f["start"], f["end"]) for f in found] == [(family, 13, 13 + len(notice))]


def test_confirmed_line_leaves_the_rest_of_its_block(scanner):
    notice = "\n".join(textwrap.wrap(ls.TEMPLATES["GPL-3.0"][1], 75))
    found = scanner.scan(f"Released under the MIT License.\n{notice}")
    assert [(f["family"], f["start"]) for f in found] == [("MIT", 0), ("GPL-3.0", 32)]


def test_odd_rows(spark, scanner):
    mit = "Released under the MIT License."
    rows = [(1, mit, "x"), (1, mit, "x"), (None, mit, "y"), (2, None, "z"), (3, "", "z"), (4, "w " * 90_000, "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, license string")
    out = ls.scan_licenses(df, scanner.model)
    assert sorted((str(r.doc_id), str(r.license), r.n_found) for r in out.collect()) == [
        ("1", "MIT", 1), ("1", "MIT", 1), ("2", "None", 0), ("3", "None", 0), ("4", "None", 0), ("None", "MIT", 1),
    ]
    assert ls.scan_licenses(df.limit(0), scanner.model).isEmpty()
    assert ls.corpus_negatives(df.limit(0)) == []


def test_query_finds_every_given_line(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op2_license_scan"](spark, sf_dir).collect():
        want = sorted({f for line, f in GIVEN.items() if line in texts[r.doc_id].split("\n")})
        assert (r.families.split(",") if r.families else []) == want
        assert (r.license is None) == (not want)
