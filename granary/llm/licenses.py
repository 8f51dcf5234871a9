"""License scans by sentence rules, with DataFrame functions only.

A text is cut into sentences three times: where a sentence ends or a line is empty (license texts are wrapped at any
word); at every line break as well (notices stand on lines of their own); and, for texts in comments, on one line or in
lists, without the comment marks that begin lines, at colons and semicolons, around copyright lines, and before known
beginnings. There SPDX expressions count by their parts. Sentences are normalised to lower-case words. Known ones have
identifiers; short ones that name a license as notices, titles and SPDX lines do (NOTICE, TITLE, SPDX_LINE, with names
built by ``license_names``) have that of the license; all others vanish. Each of the three sequences of identifiers is matched against ordered rules: a rule holds
if its identifiers occur in its order, other ones between them allowed. For each license the first rule that holds counts.
The SQL of the query states the first two sequences.

Only texts that hold one of a few words, or words that notices have, go through the sentences at all; every known sentence
has such words, so nothing is missed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licenses and notices, normalised.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license",
    "mit-spdx": "spdx license identifier mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice-kept": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-spdx": "spdx license identifier apache 2 0",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-spdx": "spdx license identifier gpl 3 0 only",
    "gpl3-spdx-later": "spdx license identifier gpl 3 0 or later",
    "gpl2-spdx": "spdx license identifier gpl 2 0 only",
    "gpl2-spdx-later": "spdx license identifier gpl 2 0 or later",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-useful": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd2-spdx": "spdx license identifier bsd 2 clause",
    "bsd3-spdx": "spdx license identifier bsd 3 clause",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-spdx": "spdx license identifier isc",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-spdx": "spdx license identifier mpl 2 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa-work": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc-work": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc0-spdx": "spdx license identifier cc0 1 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl-useful": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "agpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "apache-title": "apache license version 2 0 january 2004 http www apache org licenses",
    "mpl2-title": "mozilla public license version 2 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "bsl-notice": "distributed under the boost software license version 1 0",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "artistic2-title": "the artistic license 2 0",
    "lgpl21-spdx": "spdx license identifier lgpl 2 1 only",
    "lgpl21-spdx-later": "spdx license identifier lgpl 2 1 or later",
    "lgpl3-spdx": "spdx license identifier lgpl 3 0 only",
    "lgpl3-spdx-later": "spdx license identifier lgpl 3 0 or later",
    "agpl3-spdx": "spdx license identifier agpl 3 0 only",
    "agpl3-spdx-later": "spdx license identifier agpl 3 0 or later",
    "epl2-spdx": "spdx license identifier epl 2 0",
    "bsl-spdx": "spdx license identifier bsl 1 0",
    "zlib-spdx": "spdx license identifier zlib",
    "artistic2-spdx": "spdx license identifier artistic 2 0",
}

# What licenses are called. Names are built from families, versions and words that may follow.
_SHORT_NAMES = {
    "MIT": ["mit", "expat"],
    "BSD-3-Clause": ["bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd"],
    "BSD-2-Clause": ["bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd"],
    "ISC": ["isc"],
    "Zlib": ["zlib", "zlib libpng"],
    "PostgreSQL": ["postgresql"],
    "PSF-2.0": ["psf", "python software foundation", "psf 2 0", "python software foundation license version 2"],
    "WTFPL": ["wtfpl", "do what the fuck you want to public"],
    "Unlicense": ["unlicense", "the unlicense"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal"],
}
#: License, its long and short names, and versions as they are written (the first one also stands in the identifier).
_VERSIONED = [
    ("GPL", ["gnu general public license", "gnu gpl", "gpl"], {"2.0": ["2 0", "2"], "3.0": ["3 0", "3"]}),
    ("LGPL", ["gnu lesser general public license", "gnu lgpl", "lgpl"], {"2.1": ["2 1"], "3.0": ["3 0", "3"]}),
    ("AGPL", ["gnu affero general public license", "gnu agpl", "agpl"], {"3.0": ["3 0", "3"]}),
    ("Apache", ["apache license", "apache software license", "apache"], {"2.0": ["2 0", "2"]}),
    ("MPL", ["mozilla public license", "mpl"], {"2.0": ["2 0"], "1.1": ["1 1"]}),
    ("EPL", ["eclipse public license", "epl"], {"2.0": ["2 0"], "1.0": ["1 0"]}),
    ("OFL", ["sil open font license", "open font license", "ofl"], {"1.1": ["1 1"]}),
    ("BSL", ["boost software license", "bsl"], {"1.0": ["1 0"]}),
    ("Artistic", ["artistic license", "artistic"], {"2.0": ["2 0"]}),
]
_CC_TERMS = {"BY": "attribution", "SA": "sharealike", "NC": "noncommercial", "ND": "noderivatives"}
_CC_KINDS, _CC_VERSIONS = ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"], ["2.0", "2.5", "3.0", "4.0"]


def license_names() -> dict[str, str]:
    """Normalised names of licenses, without "license" at the end and "the" at the beginning, and what they name."""
    out = {name: license for license, names in _SHORT_NAMES.items() for name in names}
    for family, names, versions in _VERSIONED:
        for version, written in versions.items():
            for name in names:
                for v in written:
                    out |= {f"{name} {lead}{v}": f"{family}-{version}" for lead in ("", "v", "v ", "version ")}
                    if name.endswith(("gpl", "mpl", "epl")):
                        out[f"{name}v{v}"] = f"{family}-{version}"
    for kind in _CC_KINDS:
        terms = kind.split("-")
        for version in _CC_VERSIONS:
            v, license = version.replace(".", " "), f"CC-{kind}-{version}"
            out[f"cc {' '.join(terms).lower()} {v}"] = license
            words = " ".join(_CC_TERMS[t] for t in terms)
            for spelled in {words, words.replace("sharealike", "share alike").replace("noderivatives", "no derivatives").replace("noncommercial", "non commercial")}:
                out |= {f"creative commons {spelled} {v}{tail}": license for tail in ("", " international", " unported", " generic")}
    return out


#: A notice is known by what follows these words; an SPDX line and a title by themselves.
NOTICE = (
    r"^(?:(?:this|the|all) (?:[a-z]+ ){0,2}?(?:is |are |may be )|it is |and |is )?(?:dual |also )?"
    r"(?:(?:licensed|distributed|released|available|published|provided|redistributed) under|(?:covered|governed) by|licen[cs]e(?: is)?) "
    r"(?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?(.+?)(?: public)?(?: licen[cs]e)?(?: only| or later| or any later version| or at your option any later version)?$"
)
TITLE = r"^(?:the )?(.+?)(?: public)?(?: licen[cs]e)?$"
SPDX_LINE = r"^spdx license identifier (.+?)(?: only| or later)?$"
#: Notices that may have none of WORDS.
NOTICE_WORDS = r"\b(?:distributed|released|available|published|provided|redistributed|covered|governed)[\x20\x09-\x0D]+(?:under|by)\b|\bcc0\b|\bcreative\s+commons\b"
#: Characters that a normalised notice has at most.
LONGEST_NOTICE = 200
#: A title is a name with one of these words, so that a word like "mit" or "isc" alone is none.
TITLE_WORD = r"licen[cs]e|universal$|international$|unported$|generic$"


#: Words of which every other known sentence has one.
WORDS = ("license", "permission", "copyright", "warranty", "licensed", "redistribution", "unencumbered")

# Rules in order, (license, rule, identifiers in order).
RULES = [
    ("MIT", "text", ["mit-grant", "mit-notice-kept", "as-is"]),
    ("MIT", "notice", ["mit-notice"]),
    ("MIT", "notice", ["mit-licensed"]),
    ("MIT", "notice", ["mit-spdx"]),
    ("MIT", "title", ["mit-title"]),
    ("Apache-2.0", "header", ["apache-header", "apache-comply"]),
    ("Apache-2.0", "header", ["apache-comply", "apache-as-is"]),
    ("Apache-2.0", "notice", ["apache-notice"]),
    ("Apache-2.0", "notice", ["apache-spdx"]),
    ("GPL-3.0", "header", ["gpl-free", "gpl-useful"]),
    ("GPL-3.0", "notice", ["gpl3-notice"]),
    ("GPL-3.0", "notice", ["gpl3-spdx"]),
    ("GPL-3.0", "notice", ["gpl3-spdx-later"]),
    ("GPL-2.0", "header", ["gpl2-free", "gpl-useful"]),
    ("GPL-2.0", "notice", ["gpl2-spdx"]),
    ("GPL-2.0", "notice", ["gpl2-spdx-later"]),
    ("BSD-3-Clause", "text", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-3-Clause", "notice", ["bsd3-spdx"]),
    ("BSD-2-Clause", "text", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", "notice", ["bsd2-spdx"]),
    ("ISC", "text", ["isc-grant"]),
    ("ISC", "notice", ["isc-spdx"]),
    ("MPL-2.0", "notice", ["mpl2-notice"]),
    ("MPL-2.0", "notice", ["mpl2-spdx"]),
    ("CC-BY-4.0", "notice", ["cc-by-notice"]),
    ("CC-BY-4.0", "notice", ["cc-by-work"]),
    ("CC-BY-SA-4.0", "notice", ["cc-by-sa-notice"]),
    ("CC-BY-SA-4.0", "notice", ["cc-by-sa-work"]),
    ("CC-BY-NC-4.0", "notice", ["cc-by-nc-notice"]),
    ("CC-BY-NC-4.0", "notice", ["cc-by-nc-work"]),
    ("CC0-1.0", "notice", ["cc0-spdx"]),
    ("Unlicense", "text", ["unlicense-free"]),
    ("LGPL-2.1", "header", ["lgpl21-free", "lgpl-useful"]),
    ("LGPL-2.1", "notice", ["lgpl21-spdx"]),
    ("LGPL-2.1", "notice", ["lgpl21-spdx-later"]),
    ("LGPL-2.1", "title", ["lgpl21-title"]),
    ("LGPL-3.0", "header", ["lgpl3-free", "gpl-useful"]),
    ("LGPL-3.0", "notice", ["lgpl3-spdx"]),
    ("LGPL-3.0", "notice", ["lgpl3-spdx-later"]),
    ("LGPL-3.0", "title", ["lgpl3-title"]),
    ("AGPL-3.0", "header", ["agpl3-free", "gpl-useful"]),
    ("AGPL-3.0", "notice", ["agpl3-spdx"]),
    ("AGPL-3.0", "notice", ["agpl3-spdx-later"]),
    ("AGPL-3.0", "title", ["agpl3-title"]),
    ("GPL-3.0", "title", ["gpl3-title"]),
    ("GPL-2.0", "title", ["gpl2-title"]),
    ("Apache-2.0", "title", ["apache-title"]),
    ("MPL-2.0", "title", ["mpl2-title"]),
    ("EPL-2.0", "notice", ["epl2-notice"]),
    ("EPL-2.0", "notice", ["epl2-spdx"]),
    ("BSL-1.0", "text", ["bsl-grant"]),
    ("BSL-1.0", "notice", ["bsl-notice"]),
    ("BSL-1.0", "notice", ["bsl-spdx"]),
    ("Zlib", "text", ["zlib-as-is", "zlib-grant"]),
    ("Zlib", "notice", ["zlib-spdx"]),
    ("Artistic-2.0", "notice", ["artistic2-spdx"]),
    ("Artistic-2.0", "title", ["artistic2-title"]),
]
#: Names as notices, titles and SPDX lines leave them: without "public" and "license" at the end.
NAMES = {}
for _name, _license in license_names().items():
    for _end in (" public license", " license", " public"):
        _name = _name.removesuffix(_end)
    NAMES.setdefault(_name, _license)
RULES += [(_license, kind, [f"{_license}~{kind}"]) for _license in dict.fromkeys(NAMES.values()) for kind in ("notice", "spdx", "title")]
#: Licenses whose rule is part of another license's: not reported beside it.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}

_QUOTES = "“”‘’"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ends of sentences, with wrapped lines and with every line for itself.
WRAPPED = r"""[.!?]+["')]*[\x20\x09-\x0D]+|\n[\x20\x09-\x0D]*\n"""
BY_LINE = r"""[.!?]+["')]*[\x20\x09-\x0D]+|\n"""
#: Ends once a text is laid out.
LAID_OUT = WRAPPED + r"""|(?<!spdx-license-identifier)[:;]["')]*[\x20\x09-\x0D]+"""
#: Beginnings of known sentences that may follow other words without an end between them.
STARTS = [
    "permission is hereby granted,? free of charge",
    "permission to use,? copy,? modify",
    "redistribution and use in source and binary forms",
    "redistributions of source code must",
    "redistributions in binary form must",
    "neither the name of",
    "the above copyright notice and this permission notice shall",
    "the software is provided",
    r"licensed under the apache license,? version 2\.0,? \(the",
    "unless required by applicable law",
    r"this program is free software[:;,]? you can",
    "this program is distributed in the hope",
    r"this library is free software[:;,]? you can",
    "this library is distributed in the hope",
    r"permission is granted to anyone to use this software",
    "this is free and unencumbered software",
]
#: How a lower-cased text is laid out, in order: (pattern, replacement).
LAYOUT = [
    # comment marks that begin lines
    (r"(?m)^[\x20\t]*(?:/\*+/?|\*+/?|//+!?|#+|;+|--+|%+|<!--|dnl\b|rem\b)[\x20\t]*", ""),
    # colons, semicolons and points within known sentences
    (r"\b(free\s+software|foundation|warranty)[:;](?=\s+(?:you\s+can|either\s+version|without\s+even)\b)", "$1"),
    (r"\bv\.(?=\s*[0-9])", "v "),
    (r"(?m)(spdx-license-identifier:.*)$", "\n\n$1\n\n"),
    (r"(?m)^([\x20\t]*(?:copyright[\x20\t]+(?:\(c\)|©|[0-9]{4})|(?:\(c\)|©)[\x20\t]+(?:copyright|[0-9]{4})).*)$", "\n\n$1\n\n"),
    (r"\b(?=(?:" + "|".join(STARTS).replace(" ", r"\s+") + "))", "\n\n"),
]
#: An SPDX line and what joins the parts of its expression.
SPDX, SPDX_JOINS = "spdx-license-identifier:", r"[\x20\x09()]+(?:or|and|with)[\x20\x09()]+"
#: What separates the words of a normalised sentence.
BETWEEN = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def ordered_pattern(identifiers: list[str]) -> str:
    """Matches ``,a,b,c,`` sequences that hold the identifiers in order."""
    return "," + ",(.*,)?".join(identifiers) + ","


def _identifiers(pieces: Column) -> Column:
    """The identifiers of the known sentences among the pieces, in order, as ``,a,b,``; ``,`` if there are none."""
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    named = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    sentences = F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, BETWEEN, " ")))

    def by_name(s: Column, pattern: str, kind: str) -> Column:
        return F.concat(F.try_element_at(named, F.regexp_extract(s, pattern, 1)), F.lit(f"~{kind}"))

    def identifier(s: Column) -> Column:
        """The sentence's own identifier, or that of the license it names; long sentences name none that way."""
        title = F.when(s.rlike(TITLE_WORD), by_name(s, TITLE, "title"))
        named_ = F.when(s.startswith("spdx "), by_name(s, SPDX_LINE, "spdx")).otherwise(F.coalesce(by_name(s, NOTICE, "notice"), title))
        return F.coalesce(F.try_element_at(known, s), F.when(F.length(s) <= LONGEST_NOTICE, named_))

    names = F.filter(F.transform(sentences, identifier), lambda n: n.isNotNull())
    return F.concat(F.lit(","), F.array_join(F.transform(names, lambda n: F.concat(n, F.lit(","))), ""))


def _laid_out(text: Column) -> Column:
    """The pieces of a lower-cased text that has been laid out; an SPDX expression is a piece per part."""
    for pattern, replacement in LAYOUT:
        text = F.regexp_replace(text, pattern, replacement)

    def parts(s: Column) -> Column:
        ids = F.split(F.substring(s, len(SPDX) + 1, F.length(s)), SPDX_JOINS)
        return F.when(s.startswith(SPDX), F.transform(ids, lambda i: F.concat(F.lit(SPDX), i))).otherwise(F.array(s))

    return F.flatten(F.transform(F.split(text, LAID_OUT), parts))


def _first_rules(held: list[tuple[str, str, Column]]) -> Column:
    """array of ``license:rule``, the first rule that holds of each license, in the order of the rules."""
    out, by_license = [], {}
    for name, rule, holds in held:
        by_license.setdefault(name, []).append((rule, holds))
    for name, rules in by_license.items():
        first = F.coalesce(*[F.when(holds, F.lit(f"{name}:{rule}")) for rule, holds in rules])
        if name in PART_OF:
            first = F.when(~_any([holds for _, holds in by_license[PART_OF[name]]]), first)
        out.append(first)
    return F.array_compact(F.array(*out))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, n_sentences (known ones, of the sequence that has the most), sentences (their identifiers in order, comma-joined), licenses (comma-joined, in the order of the rules) and rules
    (license:rule, likewise).

    Null and empty texts have none; repeated rows are scanned each; very long texts are scanned whole; an empty table
    gives an empty result; other columns are ignored.
    """
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER + _QUOTES, _LOWER + " " * len(_QUOTES))
    # split into jobs of a few columns, so that each is evaluated once per row
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    worth = _any([F.col("text").contains(w) for w in WORDS]) | F.col("text").rlike(NOTICE_WORDS)
    cuts = {"by_line": F.split("text", BY_LINE), "wrapped": F.split("text", WRAPPED), "laid_out": _laid_out(F.col("text"))}
    ids = F.struct(*[_identifiers(pieces).alias(c) for c, pieces in cuts.items()])
    found = rows.select("doc_id", F.when(worth, ids).alias("ids"))
    found = found.select("doc_id", *[F.coalesce(F.col(f"ids.{c}"), F.lit(",")).alias(c) for c in cuts])
    held = []
    for name, rule, identifiers in RULES:
        pattern = ordered_pattern(identifiers)
        held.append((name, rule, _any([F.col(c).rlike(pattern) for c in cuts])))
    size = {c: F.size(F.split(c, ",")) - 2 for c in cuts}
    most = F.greatest(*size.values())
    longer = F.coalesce(*[F.when(size[c] == most, F.col(c)) for c in cuts])
    some = most > 0
    rules = F.when(some, _first_rules(held)).otherwise(F.array().cast("array<string>"))
    found = found.select(
        "doc_id",
        most.cast("long").alias("n_sentences"),
        F.trim(longer, F.lit(",")).alias("sentences"),
        rules.alias("rules"),
    )
    return found.select(
        "doc_id",
        "n_sentences",
        "sentences",
        F.array_join(F.transform("rules", lambda r: F.substring_index(r, ":", 1)), ",").alias("licenses"),
        F.array_join("rules", ",").alias("rules"),
    )
