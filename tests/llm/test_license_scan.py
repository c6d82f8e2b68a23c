import re

from tidemark.llm.license_scan import HEADINGS, NAMES, RULES, SENTENCES, SUBJECTS, VERBS, scan


def plain(text):
    """Sentence by sentence, rule by rule."""
    text = "".join(c.lower() if c.isascii() else c for c in text or "")
    heads = {" ".join(s.rstrip("*").split()[:2]) for s in SENTENCES} | {f"{v} under" for v in VERBS[:2]} | {f"{x} is" for x in SUBJECTS}
    cuts, start = [], 0
    for m in re.finditer(r"[.!?:;](?=\s|\Z)|\n", text):
        rest = text[m.end() :]
        if m[0] != "\n" or re.match(r"[ \t\r]*\n", rest) or any(re.sub(r"^[ \t#*/-]*", "", rest).startswith(h) for h in heads):
            cuts.append(text[start : m.start()])
            start = m.end()
    ids = []
    for s in [*cuts, text[start:]]:
        s = re.sub(r"\.(?![^\W_])", " ", s)
        s = " ".join("".join(c if c.isalnum() or c in ".+" else " " for c in s).split())
        for known, name in [*SENTENCES.items(), *HEADINGS.items()]:
            if s == known or (known.endswith("*") and s.startswith(known[:-1])):
                ids.append(name)
                break
        else:
            for subject in ("", *(f"{x} is " for x in SUBJECTS)):
                for verb in VERBS:
                    for name in NAMES:
                        for article in ("", "the ", "a ", "an "):
                            if s in (f"{subject}{verb} under {article}{name}", f"{subject}{verb} under the terms of {article}{name}"):
                                ids.append(NAMES[name])
    left, found = list(ids), []
    for name, sequence in RULES:
        i = 0
        while i <= len(left) - len(sequence):
            if tuple(left[i : i + len(sequence)]) == sequence:
                left[i : i + len(sequence)] = [None]
                found.append(name)
            i += 1
    return ids, list(dict.fromkeys(found)), sum(x is not None for x in left)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use. The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING.
"""


def test_rules(spark, odd, documents, none, same):
    texts = [MIT, MIT.replace("THE SOFTWARE IS", "Licensed under CC BY 4.0.\nTHE SOFTWARE IS"), "Released under the MIT License.", "My tool\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "released under\nthe MIT license", "x Released under the MIT License", (MIT + "\n") * 3, None, ""]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in scan(made).collect()}
    assert [got[i] for i in range(9)] == [["MIT"], ["CC-BY-4.0"], ["MIT"], ["MIT", "Apache-2.0"], ["MIT"], [], ["MIT"], [], []]
    for docs in (made, odd, documents):
        same([(r.doc_id, r.sentence_ids, r.licenses, r.n_unknown) for r in scan(docs).collect()], [(r.doc_id, *plain(r.text)) for r in docs.collect()])
    assert scan(none).count() == 0
    assert sum(bool(r.licenses) for r in scan(documents).collect()) > 0


GPL = """# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{1} either version {2} of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
#
# You should have received a copy of the GNU General Public License
# along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """# Licensed under the Apache License, Version 2.0
# (the "License"); you may not use this file except in compliance with the License.
"""


def test_notices_as_they_are_published(spark):
    texts = ["# Licensed under the MIT License\nimport os\n", "// Licensed under the Apache License, Version 2.0\r\nCopyright 2020 X", GPL.format(":", ",", 3), GPL.format(";", ";", 2), APACHE, "x released under the MIT License\nimport os"]
    got = {r.doc_id: (r.licenses, r.n_unknown) for r in scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: (["MIT"], 0), 1: (["Apache-2.0"], 0), 2: (["GPL-3.0-or-later"], 0), 3: (["GPL-2.0-or-later"], 0), 4: (["Apache-2.0"], 1), 5: ([], 0)}


LGPL = """/* This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 *
 * This library is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
 * Lesser General Public License for more details.
 *
 * You should have received a copy of the GNU Lesser General Public
 * License along with this library; if not, write to the
 * Free Software Foundation.
 */
"""
AGPL = GPL.replace("GNU General", "GNU Affero General").format(":", ",", 3)
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""
EPL = "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://example.org/"


def test_further_licences(spark, same):
    texts = [LGPL, AGPL, ISC, ZLIB, EPL, "Licensed under CC0 1.0.", "# Licensed under the Mozilla Public License 2.0\nx = 1", "Licensed under the BSD 3-Clause License.", "in no event will the authors be here"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = scan(made).collect()
    got = {r.doc_id: (r.licenses, r.n_unknown) for r in rows}
    assert got == {0: (["LGPL-2.1-or-later"], 0), 1: (["AGPL-3.0-or-later"], 0), 2: (["ISC"], 0), 3: (["Zlib"], 0), 4: (["EPL-2.0"], 0), 5: (["CC0-1.0"], 0), 6: (["MPL-2.0"], 0), 7: (["BSD-3-Clause"], 0), 8: ([], 0)}


def test_notices_headings_and_declarations(spark):
    cases = {
        "# SPDX-License-Identifier: MIT\nimport os": ["MIT"],
        "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\nint x;": ["MIT", "Apache-2.0"],
        "// SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 AND ISC": ["GPL-2.0-or-later", "ISC"],
        "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0+"],
        "Distributed under the MIT License.": ["MIT"],
        "MIT License\n\nCopyright (c) 2020 X": ["MIT"],
        "Released under the Apache License 2.0.": ["Apache-2.0"],
        "Licensed under the GNU General Public License v3.0.": ["GPL-3.0-only"],
        "This project is licensed under GPLv3": ["GPL-3.0-only"],
        "name = x\nLicense: BSD-3-Clause\nVersion: 1": ["BSD-3-Clause"],
        '  "license": "MIT",': ["MIT"],
        "License: ask us": [],
        "                Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n   TERMS": ["Apache-2.0"],
        "    GNU GENERAL PUBLIC LICENSE\n       Version 3, 29 June 2007\n\n Copyright": ["GPL-3.0-only"],
        "This work is licensed under a Creative Commons Attribution 4.0 International License.": ["CC-BY-4.0"],
        "# Available under the terms of the BSD 2-Clause License\nimport os": ["BSD-2-Clause"],
        "the committee was licensed under the old law": [],
    }
    made = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "doc_id long, text string")
    rows = {r.doc_id: r for r in scan(made).collect()}
    for i, (text, want) in enumerate(cases.items()):
        assert rows[i].licenses == want, (text, rows[i])
        assert rows[i].n_unknown == 0
    one = scan(spark.createDataFrame([(1, "SPDX-License-Identifier: LicenseRef-own")], "doc_id long, text string")).first()
    assert (one.licenses, one.n_unknown) == ([], 1)
