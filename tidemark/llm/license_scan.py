"""Licence recognition by sentence rules.

A text is cut into sentences, and each is normalised: A-Z lowered, everything
but letters, digits, dots inside words and plus signs made one space. A
sentence that is in the table of licence sentences, or has one of its openings,
gets its identifier; so does a notice ("licensed under ..." and the like) of a
listed name, and each licence of an SPDX or ``License:`` line. Other sentences
get none. The sequence of identifiers of a
document, in order, is held against the licence rules in order: a rule is a
sequence that must occur with nothing between; the first rules take their
identifiers away from later ones. Identifiers that no rule takes are reported
as unknown. Only DataFrame functions are used and nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence texts and notices, with
# their identifiers. A trailing * stands for any ending.
SENTENCES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction*": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitKeep",
    "the software is provided as is without warranty of any kind express or implied*": "MitAsIs",
    "licensed under the apache license version 2.0 the license": "ApacheHeader2",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at*": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis*": "ApacheAsIs",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GplGrant3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GplGrant2Plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplNoWarrantyWhole",
    # The same as the colons and semicolons of the published notices cut them.
    "this program is free software": "GplFree",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GplTerms3Plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GplTerms2Plus",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "GplTerms",
    "either version 3 of the license or at your option any later version": "GplLater3",
    "either version 2 of the license or at your option any later version": "GplLater2",
    "this program is distributed in the hope that it will be useful but without any warranty": "GplNoWarranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "GplNoImplied",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license*": "GplReceived",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met*": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of*": "BsdNoEndorse",
    "this software is provided by the copyright holders and contributors as is*": "BsdAsIs",
    "this source code form is subject to the terms of the mozilla public license v": "MplNotice2",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "this library is free software": "LgplFree",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "LgplTerms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "LgplTerms3Plus",
    "either version 2.1 of the license or at your option any later version": "LgplLater21",
    "see the gnu lesser general public license for more details": "LgplSee",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AgplTerms3Plus",
    "see the gnu affero general public license for more details": "AgplSee",
    "this library is distributed in the hope that it will be useful but without any warranty": "LgplNoWarranty",
    "you should have received a copy of the gnu lesser general public license*": "LgplReceived",
    "you should have received a copy of the gnu affero general public license*": "AgplReceived",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "the software is provided as is and the author disclaims all warranties*": "IscAsIs",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiable",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0*": "EplNotice2",
}
# Headings of licence texts. They are sentences, but lines that begin
# like them do not end the sentence before.
HEADINGS = {
    "apache license version 2.0 january 2004*": "ApacheHeading2",
    "gnu general public license version 3 29 june 2007*": "GplHeading3",
    "gnu general public license version 2 june 1991*": "GplHeading2",
    "mit license": "MitHeading",
    "the mit license": "MitHeading",
    "the mit license mit": "MitHeading",
    "bsd 3 clause license": "BsdHeading3",
    "bsd 2 clause license": "BsdHeading2",
    "isc license": "IscHeading",
    "mozilla public license version 2.0": "MplHeading2",
}
# Names of licences in notices, normalised, with their identifiers.
NAMES = {
    "mit license": "MitNotice",
    "mit": "MitNotice",
    "apache license version 2.0": "ApacheNotice2",
    "apache license v2.0": "ApacheNotice2",
    "apache license 2.0": "ApacheNotice2",
    "apache 2.0 license": "ApacheNotice2",
    "apache 2.0": "ApacheNotice2",
    "gnu general public license version 3": "GplNotice3",
    "gnu general public license version 3.0": "GplNotice3",
    "gnu general public license v3": "GplNotice3",
    "gnu general public license v3.0": "GplNotice3",
    "gnu gpl v3": "GplNotice3",
    "gnu gplv3": "GplNotice3",
    "gplv3": "GplNotice3",
    "gpl v3": "GplNotice3",
    "gpl 3.0": "GplNotice3",
    "gnu general public license version 2": "GplNotice2",
    "gnu general public license version 2.0": "GplNotice2",
    "gnu general public license v2": "GplNotice2",
    "gnu general public license v2.0": "GplNotice2",
    "gplv2": "GplNotice2",
    "gpl v2": "GplNotice2",
    "gpl 2.0": "GplNotice2",
    "gnu lesser general public license version 3": "LgplNotice3",
    "gnu lesser general public license v3.0": "LgplNotice3",
    "lgplv3": "LgplNotice3",
    "gnu affero general public license version 3": "AgplNotice3",
    "gnu affero general public license v3.0": "AgplNotice3",
    "agplv3": "AgplNotice3",
    "bsd 3 clause license": "BsdNotice3",
    "bsd 3 clause": "BsdNotice3",
    "3 clause bsd license": "BsdNotice3",
    "bsd 2 clause license": "BsdNotice2",
    "bsd 2 clause": "BsdNotice2",
    "2 clause bsd license": "BsdNotice2",
    "isc license": "IscNotice",
    "mozilla public license 2.0": "MplName2",
    "mozilla public license version 2.0": "MplName2",
    "mpl 2.0": "MplName2",
    "cc0 1.0": "Cc0",
    "cc by nc 4.0": "CcByNc4",
    "cc by 4.0": "CcBy4",
    "cc by sa 4.0": "CcBySa4",
    "creative commons attribution 4.0 international license": "CcBy4",
    "creative commons attribution sharealike 4.0 international license": "CcBySa4",
    "creative commons attribution noncommercial 4.0 international license": "CcByNc4",
    "unlicense": "UnlicenseNotice",
}
# What notices say before the name.
VERBS = ("released", "licensed", "distributed", "published", "available", "provided")
SUBJECTS = ("this project", "this work", "this software", "this library", "this program", "this code", "this file", "this repository")
# SPDX identifiers.
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+",
    "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "BSD-2-Clause", "BSD-3-Clause", "ISC", "Zlib", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense", "BSL-1.0", "0BSD", "WTFPL",
)
#: Licence rules, in order: the licence, and the identifiers in sequence.
RULES = (
    ("MIT", ("MitGrant", "MitKeep", "MitAsIs")),
    ("MIT", ("MitNotice",)),
    ("Apache-2.0", ("ApacheHeader2", "ApacheComply", "ApacheCopy", "ApacheAsIs")),
    ("Apache-2.0", ("ApacheHeader2",)),
    ("Apache-2.0", ("ApacheNotice2",)),
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms3Plus", "GplNoWarranty", "GplNoImplied", "AgplSee", "AgplReceived")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "LgplLater21", "LgplNoWarranty", "GplNoImplied", "LgplSee", "LgplReceived")),
    ("AGPL-3.0-or-later", ("GplFree", "AgplTerms3Plus")),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplTerms3Plus")),
    ("LGPL-3.0-or-later", ("LgplFree", "LgplTerms", "GplLater3")),
    ("LGPL-2.1-or-later", ("LgplFree", "LgplTerms", "LgplLater21")),
    ("GPL-3.0-or-later", ("GplGrant3Plus", "GplNoWarrantyWhole", "GplSee", "GplReceived")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms3Plus", "GplNoWarranty", "GplNoImplied", "GplSee", "GplReceived")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "GplLater3", "GplNoWarranty", "GplNoImplied", "GplSee", "GplReceived")),
    ("GPL-3.0-or-later", ("GplGrant3Plus",)),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms3Plus")),
    ("GPL-3.0-or-later", ("GplFree", "GplTerms", "GplLater3")),
    ("GPL-2.0-or-later", ("GplGrant2Plus", "GplNoWarrantyWhole", "GplSee", "GplReceived")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms2Plus", "GplNoWarranty", "GplNoImplied", "GplSee", "GplReceived")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "GplLater2", "GplNoWarranty", "GplNoImplied", "GplSee", "GplReceived")),
    ("GPL-2.0-or-later", ("GplGrant2Plus",)),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms2Plus")),
    ("GPL-2.0-or-later", ("GplFree", "GplTerms", "GplLater2")),
    ("GPL-3.0-only", ("GplNotice3",)),
    ("GPL-2.0-only", ("GplNotice2",)),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdNoEndorse", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("MPL-2.0", ("MplNotice2",)),
    ("Unlicense", ("Unlicense",)),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("ISC", ("IscNotice",)),
    ("Zlib", ("ZlibAsIs", "ZlibLiable", "ZlibGrant")),
    ("EPL-2.0", ("EplNotice2",)),
    ("CC0-1.0", ("Cc0",)),
    ("BSD-3-Clause", ("BsdNotice3",)),
    ("BSD-2-Clause", ("BsdNotice2",)),
    ("MPL-2.0", ("MplName2",)),
    ("LGPL-3.0-only", ("LgplNotice3",)),
    ("AGPL-3.0-only", ("AgplNotice3",)),
    ("Unlicense", ("UnlicenseNotice",)),
    ("MIT", ("MitHeading",)),
    ("Apache-2.0", ("ApacheHeading2",)),
    ("GPL-3.0-only", ("GplHeading3",)),
    ("GPL-2.0-only", ("GplHeading2",)),
    ("BSD-3-Clause", ("BsdHeading3",)),
    ("BSD-2-Clause", ("BsdHeading2",)),
    ("ISC", ("IscHeading",)),
    ("MPL-2.0", ("MplHeading2",)),
    *((name, (f"Spdx-{name}",)) for name in SPDX),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_UNDER = "under (?:the terms of )?(?:(?:the|a|an) )?"
_NOTICE = rf"^(?:(?:{'|'.join(SUBJECTS)}) is )?(?:{'|'.join(VERBS)}) {_UNDER}"
_SPDX = "spdx license identifier "
_DECLARED = "license declared "


def _lookup(table: dict[str, str], key):
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def _identifiers(sentence, sentences: dict[str, str]):
    """The identifiers of a normalised sentence, as an array."""
    known = {**HEADINGS, **sentences}
    found = _lookup({k: v for k, v in known.items() if not k.endswith("*")}, sentence)
    for opening, name in [(k[:-1], v) for k, v in known.items() if k.endswith("*")]:
        found = F.coalesce(found, F.when(sentence.startswith(opening), F.lit(name)))
    notice = F.when(sentence.rlike(_NOTICE), _lookup(NAMES, F.regexp_replace(sentence, _NOTICE, "")))
    spdx = {re.sub(r"[^a-z0-9.+]", " ", x.lower()): f"Spdx-{x}" for x in SPDX}
    parts = F.split(F.regexp_replace(F.regexp_replace(sentence, f"^(?:{_SPDX}|{_DECLARED})", ""), r" with .*?(?= (?:or|and) (?!later)|$)", ""), " (?:or|and) (?!later)")
    named = F.transform(parts, lambda p: F.coalesce(_lookup(spdx, p), F.when(sentence.startswith(_SPDX), F.lit("Spdx-other"))))
    plain = F.array_compact(F.array(F.coalesce(found, notice)))
    return F.when(sentence.startswith(_SPDX) | sentence.startswith(_DECLARED), F.array_compact(named)).otherwise(plain)


def _whole_at_line_end(sentences: dict[str, str]) -> str:
    """A pattern of the known whole sentences that stand before a line break,
    where no longer known sentence goes on behind it."""
    gap = r"[^\p{L}\p{N}.+]+"
    words = lambda s: gap.join(re.escape(w) for w in s.split())
    exact = sorted((s for s in sentences if not s.endswith("*")), key=len, reverse=True)
    each = []
    for s in exact:
        on = [words(t.rstrip("*")[len(s) + 1 :]) for t in sentences if t.startswith(s + " ")]
        each.append(words(s) + (f"(?!{gap}(?:{'|'.join(on)}))" if on else ""))
    names = "|".join(words(s) for s in sorted(NAMES, key=len, reverse=True))
    under = f"under{gap}(?:the{gap}terms{gap}of{gap})?(?:(?:the|a|an){gap})?"
    each.append(f"(?:{'|'.join(VERBS)}){gap}{under}(?:{names})(?!{gap}the{gap}license)")
    return rf"(?<![\p{{L}}\p{{N}}])((?:{'|'.join(each)})[^\p{{L}}\p{{N}}.+\n]*)\n"


def scan(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """One row per row of ``docs``: doc_id, sentence_ids (identifiers in order),
    licenses (in order of the rules, each once) and n_unknown.

    ``docs`` needs doc_id and text. A null or empty text has no sentences. A
    licence that occurs several times is named once. A sentence may run over
    line breaks; an empty line ends it, and so does the line break behind a known
    sentence.
    """
    opening = "|".join(sorted({" ".join(s.rstrip("*").split()[:2]) for s in sentences} | {f"{v} under" for v in VERBS[:2]} | {f"{x} is" for x in SUBJECTS}))
    ends = rf"[.!?:;](?=\s|\z)|\n[ \t\r]*\n|\n(?=[ \t#*/-]*(?:{opening}))"
    lowered = F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)
    # Lines that declare a licence are sentences of their own.
    lowered = F.regexp_replace(lowered, r"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]+)", f"\n\n{_SPDX}$1\n\n")
    lowered = F.regexp_replace(lowered, r"(?m)^[ \t#*/;]*[\"']?license[\"']?[ \t]*[:=][ \t]*[\"']?([a-z0-9.+() \t-]+)[\"']?[ \t,;\r]*$", f"\n\n{_DECLARED}$1\n\n")
    # An empty line behind each known sentence that ends with its line.
    lowered = F.regexp_replace(lowered, _whole_at_line_end(sentences), "$1\n\n")
    # Only sentences that have the longest word of a licence sentence need be normalised.
    hints = sorted({max(re.findall("[a-z]+", s), key=len) for s in [*sentences, *HEADINGS]} | {f"{v} under" for v in VERBS} | {_SPDX.strip(), _DECLARED.strip()})
    likely = F.filter(F.split(lowered, ends), lambda s: s.rlike("|".join(h.replace(" ", r"[^\p{L}\p{N}.+]+") for h in hints)))
    normal = F.transform(likely, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"\.(?![\p{L}\p{N}])|[^\p{L}\p{N}.+]", " "), " +", " ")))
    ids = F.flatten(F.transform(normal, lambda s: _identifiers(s, sentences)))
    rows = docs.select("doc_id", ids.alias("sentence_ids"))
    # Each identifier between separators of its own, so that sequences next to each other both match.
    left = F.array_join(F.transform("sentence_ids", lambda x: F.concat(F.lit(";"), x, F.lit(";"))), "")
    rows = rows.withColumn("_left", left)
    # A rule of one identifier that no later sequence has takes what is left, by one lookup.
    last = {x: i for i, (_, sequence) in enumerate(rules) if len(sequence) > 1 for x in sequence}
    single = {}
    for i, (_, (x, *more)) in enumerate(rules):
        if not more and last.get(x, -1) < i:
            single.setdefault(x, str(i))
    chain = [i for i, (_, sequence) in enumerate(rules) if len(sequence) > 1 or single.get(sequence[0]) != str(i)]
    for i in chain:
        pattern = "".join(f";{x};" for x in rules[i][1])
        taken = F.replace(F.col("_left"), F.lit(pattern), F.lit("|"))
        rows = rows.withColumns({f"_rule{i}": F.when(F.contains("_left", F.lit(pattern)), F.lit(i)), "_left": taken})
    left = F.filter(F.split("_left", r"[;|]+"), lambda x: x != "")
    alone = F.transform(left, lambda x: _lookup(single, x).cast("int"))
    by_rule = F.array_sort(F.array_compact(F.concat(F.array(*[F.col(f"_rule{i}") for i in chain]).cast("array<int>"), alone)))
    named = F.array_distinct(F.transform(by_rule, lambda i: F.element_at(F.array(*[F.lit(name) for name, _ in rules]), i + 1)))
    unknown = F.size(F.filter(alone, lambda x: x.isNull())).cast("long")
    return rows.select("doc_id", "sentence_ids", named.alias("licenses"), unknown.alias("n_unknown"))
