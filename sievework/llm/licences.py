"""License scans: ordered signature rules over a text's words.

A rule is a regular expression over the text's words (A-Z lower-cased, joined
by single blanks), a label, a priority and the keywords of which one must occur
before the expression is tried. There are signatures written by hand (sentences
of licence texts and of their headers), identifiers behind a tag, and notices
made from families of licences (names, versions, forms of notice), about a
thousand in all. Detections are resolved in order of priority: one that lies
within a detection of higher priority is suppressed, by one sweep. The base
phrases of the contract are rules of the highest priority class that nothing
suppresses and that suppress nothing.

Null and empty texts have no words and no detections, score 0. Of detections of
one rule those further left come first, rules are never equal in priority. A
very long text is a slice of its own; time grows in proportion to its length
and to n log n of its detections. Rows that repeat are scanned each, an empty
table gives no rows. Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbits as tb
from .common import mapped

#: Fixed by contract: phrase, label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Families: label, names (as words), versions ("" for none), keywords that every match holds.
FAMILIES = (
    ("gnu lgpl", ("gnu lesser general public license", "gnu library general public license", "lesser general public license", "gnu lgpl", "lgpl"), ("2", "2 0", "2 1", "3", "3 0", ""), ("lesser", "library", "lgpl")),
    ("gnu agpl", ("gnu affero general public license", "affero general public license", "gnu agpl", "agpl"), ("1", "3", "3 0", ""), ("affero", "agpl")),
    ("gnu gpl", ("gnu general public license", "general public license", "gnu gpl", "gpl"), ("1", "2", "2 0", "3", "3 0", ""), ("general", "gpl")),
    ("gnu fdl", ("gnu free documentation license", "free documentation license", "gfdl"), ("1 1", "1 2", "1 3", ""), ("documentation", "gfdl")),
    ("apache", ("apache software license", "apache license", "asl"), ("1 0", "1 1", "2", "2 0", ""), ("apache", "asl")),
    ("mit", ("mit license", "mit x11 license", "expat license", "x11 license"), ("",), ("mit", "expat", "x11")),
    ("bsd 2 clause", ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license"), ("",), ("bsd", "freebsd")),
    ("bsd 3 clause", ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"), ("",), ("bsd",)),
    ("bsd 4 clause", ("bsd 4 clause license", "4 clause bsd license", "original bsd license"), ("",), ("bsd",)),
    ("bsd", ("bsd license", "bsd style license"), ("",), ("bsd",)),
    ("isc", ("isc license",), ("",), ("isc",)),
    ("mozilla", ("mozilla public license", "mpl"), ("1 0", "1 1", "2", "2 0", ""), ("mozilla", "mpl")),
    ("eclipse", ("eclipse public license", "epl"), ("1 0", "2 0", ""), ("eclipse", "epl")),
    ("eupl", ("european union public licence", "european union public license", "eupl"), ("1 1", "1 2", ""), ("european", "eupl")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1", ""), ("distribution", "cddl")),
    ("cpl", ("common public license",), ("1 0", ""), ("common",)),
    ("artistic", ("artistic license", "perl artistic license"), ("1 0", "2 0", ""), ("artistic",)),
    ("boost", ("boost software license", "bsl"), ("1 0", ""), ("boost", "bsl")),
    ("zlib", ("zlib license", "zlib libpng license"), ("",), ("zlib",)),
    ("unlicense", ("the unlicense", "unlicense"), ("",), ("unlicense",)),
    ("wtfpl", ("wtfpl",), ("2", ""), ("wtfpl",)),
    ("python", ("python software foundation license", "psf license"), ("2", ""), ("python", "psf")),
    ("openssl", ("openssl license",), ("",), ("openssl",)),
    ("postgresql", ("postgresql license",), ("",), ("postgresql",)),
    ("ofl", ("sil open font license", "open font license", "ofl"), ("1 0", "1 1", ""), ("font", "ofl")),
    ("odbl", ("open database license", "odbl"), ("1 0", ""), ("database", "odbl")),
    ("cc0", ("creative commons zero", "cc0"), ("1 0", ""), ("zero", "cc0")),
    *(
        (f"cc {kind}".strip(), (f"cc {kind}", f"creative commons {long}"), ("1 0", "2 0", "2 5", "3 0", "4 0", ""), ("cc", "commons"))
        for kind, long in (
            ("by nc nd", "attribution noncommercial noderivatives"), ("by nc sa", "attribution noncommercial sharealike"), ("by nc", "attribution noncommercial"),
            ("by nd", "attribution noderivatives"), ("by sa", "attribution sharealike"), ("by", "attribution"),
        )
    ),
)
#: Identifiers behind a tag, as words: what the tag's licence is called here. Fixed values of the identifier list.
IDENTIFIERS = {
    "mit": "mit", "mit 0": "mit 0", "x11": "mit", "isc": "isc", "0bsd": "bsd 0 clause", "bsd 1 clause": "bsd 1 clause", "bsd 2 clause": "bsd 2 clause", "bsd 2 clause patent": "bsd 2 clause patent",
    "bsd 3 clause": "bsd 3 clause", "bsd 3 clause clear": "bsd 3 clause clear", "bsd 4 clause": "bsd 4 clause", "bsd": "bsd", "apache": "apache", "apache 1 0": "apache 1 0", "apache 1 1": "apache 1 1", "apache 2": "apache 2",
    "apache 2 0": "apache 2 0", "gpl": "gnu gpl", "gpl 1 0": "gnu gpl 1 0", "gpl 2 0": "gnu gpl 2 0", "gpl 3 0": "gnu gpl 3 0", "gplv2": "gnu gpl 2", "gplv3": "gnu gpl 3", "lgpl": "gnu lgpl", "lgpl 2 0": "gnu lgpl 2 0", "lgpl 2 1": "gnu lgpl 2 1",
    "lgpl 3 0": "gnu lgpl 3 0", "agpl": "gnu agpl", "agpl 1 0": "gnu agpl 1 0", "agpl 3 0": "gnu agpl 3 0", "gfdl 1 1": "gnu fdl 1 1", "gfdl 1 2": "gnu fdl 1 2", "gfdl 1 3": "gnu fdl 1 3", "mpl 1 0": "mozilla 1 0", "mpl 1 1": "mozilla 1 1", "mpl 2 0": "mozilla 2 0",
    "epl 1 0": "eclipse 1 0", "epl 2 0": "eclipse 2 0", "eupl 1 1": "eupl 1 1", "eupl 1 2": "eupl 1 2", "cddl 1 0": "cddl 1 0", "cddl 1 1": "cddl 1 1", "cpl 1 0": "cpl 1 0", "artistic 1 0": "artistic 1 0", "artistic 2 0": "artistic 2 0", "bsl 1 0": "boost 1 0",
    "zlib": "zlib", "libpng": "zlib", "unlicense": "unlicense", "wtfpl": "wtfpl", "psf 2 0": "python 2 0", "python 2 0": "python 2 0", "openssl": "openssl", "postgresql": "postgresql", "ofl 1 0": "ofl 1 0", "ofl 1 1": "ofl 1 1", "odbl 1 0": "odbl 1 0",
    "cc0 1 0": "cc0 1 0", "cc by 3 0": "cc by 3 0", "cc by 4 0": "cc by 4 0", "cc by sa 3 0": "cc by sa 3 0", "cc by sa 4 0": "cc by sa 4 0", "cc by nc 4 0": "cc by nc 4 0", "cc by nd 4 0": "cc by nd 4 0", "cc by nc sa 4 0": "cc by nc sa 4 0", "cc by nc nd 4 0": "cc by nc nd 4 0",
    "ncsa": "ncsa", "upl 1 0": "upl 1 0", "ms pl": "ms pl", "ms rl": "ms rl", "afl 3 0": "afl 3 0", "osl 3 0": "osl 3 0", "blueoak 1 0 0": "blueoak 1 0 0", "mulanpsl 2 0": "mulan psl 2 0", "busl 1 1": "busl 1 1", "elastic 2 0": "elastic 2 0", "sspl 1 0": "sspl 1 0",
}
#: Forms of notice around a name: how sure they make a detection.
NOTICES = (
    (r"(?:licen[cs]ed|released|distributed|published|available) under (?:the )?(?:terms of )?(?:the )?{}", 1.0),
    (r"licen[cs]e {}", 0.9),
    (r"{}", 0.6),
)
#: Signatures written by hand: label, expression, a keyword that every match holds, sureness. Sentences of licence texts and headers.
SIGNATURES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "obtaining", 1.0),
    ("mit", r"to deal in the software without restriction including without limitation", "restriction", 1.0),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions", "substantial", 1.0),
    ("mit", r"(?:released|licensed|distributed) under (?:the )?mit(?: x11)? licen[cs]e", "mit", 1.0),
    ("mit", r"mit licensed", "licensed", 0.9),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 1.0),
    ("isc", r"permission to use copy modify and distribute this software for any purpose with or without fee", "permission", 1.0),
    ("isc", r"loss of use data or profits whether in an action of contract negligence or other tortious action", "tortious", 0.9),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution", 1.0),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution", 0.9),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions", 1.0),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions", 1.0),
    ("bsd 3 clause", r"neither the name of (?:the )?(?:\w+ ){1,8}nor the names of (?:its|the) contributors may be used to endorse", "endorse", 1.0),
    ("bsd 3 clause", r"may be used to endorse or promote products derived from this software without specific prior written permission", "endorse", 0.9),
    ("bsd 4 clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "advertising", 1.0),
    ("bsd", r"this software is provided by the (?:copyright holders|regents|authors?) and contributors as is", "contributors", 0.9),
    ("bsd", r"use of this source code is governed by a bsd(?: style)? licen[cs]e", "bsd", 1.0),
    ("bsd 2 clause", r"(?:simplified|2 clause) bsd", "bsd", 0.8),
    ("bsd 3 clause", r"(?:modified|new|revised|3 clause) bsd", "bsd", 0.8),
    ("bsd 4 clause", r"(?:original|4 clause) bsd", "bsd", 0.8),
    ("apache 2 0", r"licensed under the apache licen[cs]e version 2 0 the license", "apache", 1.0),
    ("apache 2 0", r"you may not use this file except in compliance with the license", "compliance", 1.0),
    ("apache 2 0", r"you may obtain a copy of the license at", "obtain", 0.8),
    ("apache 2 0", r"unless required by applicable law or agreed to in writing software distributed under the license", "applicable", 1.0),
    ("apache 2 0", r"see the license for the specific language governing permissions and limitations", "governing", 1.0),
    ("apache 2 0", r"(?:www )?apache org licenses license 2 0", "apache", 1.0),
    ("apache 2 0", r"licensed to the apache software foundation asf under one or more contributor license agreements", "apache", 1.0),
    ("apache 1 1", r"this product includes software developed by the apache software foundation", "apache", 0.9),
    ("apache", r"grant of patent license subject to the terms and conditions of this license", "patent", 0.8),
    ("gnu gpl", r"free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "redistribute", 1.0),
    ("gnu gpl", r"free software you can redistribute it and or modify", "redistribute", 0.8),
    ("gnu gpl 2", r"either version 2 of the license or at your option any later version", "version", 1.0),
    ("gnu gpl 3", r"either version 3 of the license or at your option any later version", "version", 1.0),
    ("gnu gpl 2", r"version 2 of the gnu general public licen[cs]e", "general", 1.0),
    ("gnu gpl 3", r"version 3 of the gnu general public licen[cs]e", "general", 1.0),
    ("gnu gpl", r"you should have received a copy of the gnu general public licen[cs]e", "received", 1.0),
    ("gnu gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e", "merchantability", 1.0),
    ("gnu gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document", "verbatim", 0.9),
    ("gnu gpl", r"the licenses for most software (?:and other practical works )?are designed to take away your freedom", "freedom", 1.0),
    ("gnu gpl 2", r"51 franklin st(?:reet)? fifth floor boston", "franklin", 0.6),
    ("gnu gpl", r"gplv?[23](?: or later)?", ("gpl2", "gpl3", "gplv2", "gplv3"), 0.8),
    ("gnu gpl", r"(?:www )?gnu org licenses gpl(?: \d \d)?(?: html| txt)?", "gnu", 1.0),
    ("gnu gpl", r"dual licensed under the gpl", "gpl", 0.9),
    ("gnu lgpl", r"under the terms of the gnu (?:lesser|library) general public licen[cs]e", "gnu", 1.0),
    ("gnu lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", "received", 1.0),
    ("gnu lgpl", r"(?:www )?gnu org licenses lgpl(?: \d \d)?(?: html| txt)?", "gnu", 1.0),
    ("gnu lgpl", r"this library is free software you can redistribute it", "library", 0.9),
    ("gnu lgpl", r"lgplv?[23](?: 1)?", ("lgpl2", "lgpl3", "lgplv2", "lgplv3"), 0.8),
    ("gnu agpl", r"under the terms of the gnu affero general public licen[cs]e", "affero", 1.0),
    ("gnu agpl", r"you should have received a copy of the gnu affero general public licen[cs]e", "affero", 1.0),
    ("gnu agpl", r"users interacting with it remotely through a computer network", "remotely", 1.0),
    ("gnu agpl 3", r"agplv?3", ("agpl3", "agplv3"), 0.8),
    ("gnu fdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", "documentation", 1.0),
    ("gnu fdl", r"with no invariant sections no front cover texts and no back cover texts", "invariant", 1.0),
    ("mozilla 2 0", r"this source code form is subject to the terms of the mozilla public licen[cs]e v 2 0", "mozilla", 1.0),
    ("mozilla 2 0", r"if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", 1.0),
    ("mozilla 1 1", r"the contents of this file are subject to the mozilla public licen[cs]e version 1 1", "mozilla", 1.0),
    ("mozilla", r"(?:www )?mozilla org mpl(?: \d \d)?", "mozilla", 0.9),
    ("eclipse 1 0", r"made available under the terms of the eclipse public licen[cs]e v ?1 0", "eclipse", 1.0),
    ("eclipse 2 0", r"made available under the terms of the eclipse public licen[cs]e v ?2 0", "eclipse", 1.0),
    ("eclipse", r"(?:www )?eclipse org legal epl v\d+(?: html)?", "eclipse", 1.0),
    ("eclipse 2 0", r"(?:www )?eclipse org legal epl 2 0", "eclipse", 1.0),
    ("eupl", r"licen[cs]ed under the eupl", "eupl", 1.0),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution licen[cs]e", "development", 1.0),
    ("cpl", r"made available under the terms of the common public licen[cs]e", "common", 1.0),
    ("artistic", r"this is free software you can redistribute it and or modify it under the same terms as perl", "perl", 1.0),
    ("artistic", r"same terms as perl itself", "perl", 0.9),
    ("artistic 2 0", r"(?:www )?perlfoundation org artistic licen[cs]e 2 0", "artistic", 1.0),
    ("boost 1 0", r"distributed under the boost software licen[cs]e version 1 0", "boost", 1.0),
    ("boost 1 0", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "organization", 1.0),
    ("boost 1 0", r"boost org license 1 0 txt", "boost", 1.0),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable", "warranty", 1.0),
    ("zlib", r"the origin of this software must not be misrepresented", "misrepresented", 1.0),
    ("zlib", r"altered source versions must be plainly marked as such", "plainly", 1.0),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 1.0),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "compile", 1.0),
    ("unlicense", r"unlicense org", "unlicense", 0.9),
    ("wtfpl", r"do what the f\w+ you want to public licen[cs]e", "want", 1.0),
    ("python", r"python software foundation licen[cs]e agreement", "python", 1.0),
    ("openssl", r"this product includes software developed by the openssl project", "openssl", 1.0),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee", "documentation", 0.9),
    ("ofl 1 1", r"this font software is licensed under the sil open font licen[cs]e version 1 1", "font", 1.0),
    ("ofl", r"scripts sil org ofl", "ofl", 1.0),
    ("odbl", r"this database is made available under the open database licen[cs]e", "database", 1.0),
    ("odbl", r"opendatacommons org licenses odbl(?: 1 0)?", "odbl", 1.0),
    ("cc0", r"to the extent possible under law (?:\w+ ){1,12}has waived all copyright", "waived", 1.0),
    ("cc0 1 0", r"creativecommons org publicdomain zero 1 0", "publicdomain", 1.0),
    ("public domain", r"creativecommons org publicdomain mark 1 0", "publicdomain", 1.0),
    *((f"cc {kind} {v}", rf"creativecommons org licenses {kind} {v}", "creativecommons", 1.0) for kind in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("2 0", "2 5", "3 0", "4 0")),
    ("cc by sa", r"text is available under the creative commons attribution sharealike licen[cs]e", "creative", 1.0),
    ("cc", r"licen[cs]ed under (?:a |the )?creative commons(?: licen[cs]e)?", "creative", 0.8),
    ("cc", r"some rights reserved", "some", 0.6),
    ("ncsa", r"university of illinois (?:ncsa )?open source licen[cs]e", "illinois", 1.0),
    ("upl", r"universal permissive licen[cs]e", "permissive", 1.0),
    ("ms pl", r"microsoft public licen[cs]e", "microsoft", 1.0),
    ("ms rl", r"microsoft reciprocal licen[cs]e", "reciprocal", 1.0),
    ("afl", r"academic free licen[cs]e", "academic", 1.0),
    ("osl", r"open software licen[cs]e", "software", 0.9),
    ("mulan psl", r"mulan permissive software licen[cs]e", "mulan", 1.0),
    ("busl", r"business source licen[cs]e", "business", 1.0),
    ("elastic", r"elastic licen[cs]e(?: 2 0)?", "elastic", 0.8),
    ("sspl", r"server side public licen[cs]e", "server", 1.0),
    ("jpl", r"java(?: platform)? research licen[cs]e", "java", 0.9),
    ("ibm", r"ibm public licen[cs]e", "ibm", 1.0),
    ("nasa", r"nasa open source agreement", "nasa", 1.0),
    ("vim", r"vim licen[cs]e", "vim", 0.9),
    ("php", r"this source file is subject to version 3 0?1? ?of the php licen[cs]e", "php", 1.0),
    ("php", r"php licen[cs]e", "php", 0.8),
    ("ruby", r"same (?:terms|licen[cs]e) as ruby", "ruby", 0.9),
    ("beerware", r"the beer ware licen[cs]e", "beer", 1.0),
    ("json", r"the software shall be used for good not evil", "evil", 1.0),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", "w3c", 1.0),
    ("proprietary", r"proprietary and confidential", "proprietary", 0.9),
    ("proprietary", r"confidential and proprietary", "proprietary", 0.9),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|distribution|reproduction)", ("unauthorized", "unauthorised"), 0.8),
    ("proprietary", r"may not be (?:copied|reproduced|distributed)(?: or \w+)? without (?:the )?(?:express |prior )*written (?:permission|consent)", "written", 0.9),
    ("proprietary", r"trade secrets? of", ("secret", "secrets"), 0.6),
    ("proprietary", r"for internal use only", "internal", 0.7),
    ("evaluation", r"for evaluation purposes only", "evaluation", 0.7),
    ("non commercial", r"for (?:personal|educational|academic|research)(?: and non commercial)? use only", "only", 0.6),
    ("non commercial", r"free for non commercial use", "commercial", 0.7),
    ("public domain", r"(?:released|dedicated|placed|donated) (?:in|into|to) the public domain", "domain", 1.0),
    ("public domain", r"(?:in|into|to) the public domain", "domain", 0.8),
    ("public domain", r"this work is not subject to copyright protection", "copyright", 0.8),
    ("copyright", r"all rights reserved", "rights", 0.5),
    ("copyright", r"tous droits rÃ©servÃ©s", "droits", 0.5),
    ("copyright", r"alle rechte vorbehalten", "vorbehalten", 0.5),
    ("copyright", r"todos los derechos reservados", "derechos", 0.5),
    ("copyright", r"copyright (?:c )?(?:\d{4} )?\w+", "copyright", 0.4),
    ("warranty", r"provided as is without warranty", "warranty", 0.7),
    ("warranty", r"this software is provided as is", "provided", 0.6),
    ("warranty", r"in no event shall the (?:authors?|copyright holders?)(?: or (?:authors?|copyright holders?|contributors))* be liable", "liable", 0.7),
)


class Rule:
    def __init__(self, label: str, pattern: str, keywords: tuple[str, ...], sure: float, priority: int, base: bool = False):
        self.label, self.sure, self.priority, self.base = label, sure, priority, base
        self.keywords = tuple(k.encode() for k in keywords)
        self.find = re.compile(rb"(?<![^ ])(?:" + pattern.encode("latin-1") + rb")(?![^ ])").finditer


def rules() -> list[Rule]:
    """All rules in order of priority: base phrases, sentences written by hand of full sureness, tagged identifiers (longer ones first), notices
    of families by form (longer versions first), and then the other sentences."""
    out = [Rule(label, phrase, tuple(phrase.split()[:1]), 1.0, 0, True) for phrase, label in BASE]
    one = lambda k: (k,) if isinstance(k, str) else k
    add = lambda *rule: out.append(Rule(*rule, len(out)))
    for label, pattern, keywords, sure in SIGNATURES:
        if sure == 1.0:
            add(label, pattern, one(keywords), sure)
    for name in sorted(IDENTIFIERS, key=lambda x: (-len(x), x)):
        add(IDENTIFIERS[name], rf"(?:spdx )?licen[cs]e (?:identifier |id |type |name )?{name}(?: only| or later)?", ("license", "licence"), 0.9)
    for (notice, sure), (label, names, versions, keywords) in product(NOTICES, FAMILIES):
        for name, version in product(names, sorted(versions, key=len, reverse=True)):
            said = name.replace("license", "licen[cs]e").replace("licence", "licen[cs]e")
            body = rf"{said}(?: version| v)? v?{version}" if version else said
            add(f"{label} {version}".strip() if version else label, notice.format(body), keywords, sure)
    for label, pattern, keywords, sure in SIGNATURES:
        if sure < 1.0:
            add(label, pattern, one(keywords), sure)
    return out


class _Reach:
    """Of intervals by their start: the furthest end among those that start no later than a place."""

    def __init__(self, starts: list[int]):
        self.starts = sorted(set(starts))
        self.end = [-1] * (len(self.starts) + 1)

    def add(self, start: int, end: int) -> None:
        i = bisect_left(self.starts, start) + 1
        while i < len(self.end):
            self.end[i] = max(self.end[i], end)
            i += i & -i

    def upto(self, start: int) -> int:
        i, best = bisect_right(self.starts, start), -1
        while i:
            best = max(best, self.end[i])
            i -= i & -i
        return best


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that no detection of higher priority contains; base detections all stay."""
    kept, reach = [x for x in found if x[2].base], _Reach([a for a, _, _ in found])
    for a, b, rule in sorted((x for x in found if not x[2].base), key=lambda x: (x[2].priority, x[0], x[1])):
        if reach.upto(a) < b:
            kept.append((a, b, rule))
            reach.add(a, b)
    return sorted(kept, key=lambda x: (x[0], x[1], x[2].priority))


class Scanner:
    def __init__(self):
        self.rules = rules()
        self.by_key: dict[bytes, list[Rule]] = {}
        for r in self.rules:
            for k in r.keywords:
                self.by_key.setdefault(k, []).append(r)
        #: Word hashes of the keywords, for a first test of all words of a slice at once.
        self.hashes = np.sort(np.array([tb.word_hashes(np.frombuffer(k, np.uint8), np.array([0]), np.array([len(k)]))[0] for k in self.by_key], np.uint64))

    def scan(self, words: list[bytes]) -> list[tuple[int, int, Rule]]:
        """(first word, end word, rule) of the resolved detections in a text's words."""
        near = set()
        have = set(words)
        for k, rs in self.by_key.items():
            if k in have:
                near.update(rs)
        if not near:
            return []
        text = b" ".join(words)
        at = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
        found = []
        for r in near:
            for m in r.find(text):
                found.append((int(np.searchsorted(at, m.start())), int(np.searchsorted(at, m.end() + 1)), r))
        return resolve(found)


_KINDS = {
    "n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(), "base_labels": pa.string(),
    "labels": pa.string(), "score": pa.float64(), "detections": pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])),
}
_SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long>>"


def _scan(batches):
    scanner = Scanner()
    for batch in batches:
        cols: dict[str, list] = {k: [] for k in _KINDS}
        for part in tb.parts(batch.column(1)):
            part.words(tb.ALNUM)
            h, w = part.hashes(), part.w
            key = np.searchsorted(scanner.hashes, h)
            key = scanner.hashes[np.minimum(key, len(scanner.hashes) - 1)] == h  # words that are keywords
            held = np.add.reduceat(np.concatenate([key, [False]]).astype(np.int64), w[:-1]) * (np.diff(w) > 0)
            for i in range(part.n):
                a, b = int(w[i]), int(w[i + 1])
                found = []
                if held[i]:
                    lo, hi = int(part.first[i]), int(part.last[i])
                    raw = part.buf[lo:hi].tobytes()
                    found = scanner.scan([raw[s:e] for s, e in zip((part.starts[a:b] - lo).tolist(), (part.ends[a:b] - lo).tolist(), strict=True)])
                base = [x for x in found if x[2].base]
                cols["n_words"].append(b - a)
                cols["n_base"].append(len(base))
                cols["first_word"].append(min((x[0] for x in base), default=None))
                cols["last_word"].append(max((x[0] for x in base), default=None))
                cols["base_labels"].append(",".join(sorted({x[2].label for x in base})))
                cols["labels"].append(",".join(sorted({x[2].label for x in found})))
                cols["score"].append(max((x[2].sure for x in found), default=0.0))
                cols["detections"].append([{"label": r.label, "start": s, "end": e} for s, e, r in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(cols[k], t) for k, t in _KINDS.items())], names=["doc_id", *_KINDS])


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections (word spans) for each row of ``docs``."""
    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), _scan, _SCHEMA)
