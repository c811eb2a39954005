"""License signatures: names, versions and sentences, as ordered rules built from parameters.

Rules match canonical text: lower-case words between single spaces. ``gate`` holds
literals that every match contains, so a rule whose literals a text lacks is never
tried. A higher priority is a more specific statement.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    pattern: str
    gate: list[str]
    priority: int


NAME, GRANT, VERSION, EXACT = 1, 2, 3, 4
#: How sure a detection of each priority is.
CONFIDENCE = {NAME: 0.6, GRANT: 0.75, VERSION: 0.9, EXACT: 0.98}

# Label, words of the name as a pattern, a literal of every match, versions, other identifiers.
FAMILIES = [
    ("mit", r"(?:mit|expat|x11) license", "license", "", "mit"),
    ("mit-0", r"mit no attribution(?: license)?", "mit no attribution", "", "mit 0"),
    ("apache", r"apache(?: software)? license", "apache", "1.0 1.1 2.0", "apache {}"),
    ("gpl", r"(?:gnu )?general public license", "general public license", "1.0 2.0 3.0", "gpl {}"),
    ("gpl", r"(?:gnu )?gpl", "gpl", "1.0 2.0 3.0", ""),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license", "general public license", "2.0 2.1 3.0", "lgpl {}"),
    ("lgpl", r"(?:gnu )?lgpl", "lgpl", "2.0 2.1 3.0", ""),
    ("agpl", r"(?:gnu )?affero general public license", "affero general public license", "1.0 3.0", "agpl {}"),
    ("agpl", r"(?:gnu )?agpl", "agpl", "1.0 3.0", ""),
    ("gfdl", r"(?:gnu )?free documentation license", "free documentation license", "1.1 1.2 1.3", "gfdl {}"),
    ("bsd-2-clause", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd|two clause bsd)(?: license)?", "bsd", "", "bsd 2 clause"),
    ("bsd-3-clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)(?: license)?", "bsd", "", "bsd 3 clause"),
    ("bsd-4-clause", r"(?:original bsd|bsd 4 clause|4 clause bsd|four clause bsd)(?: license)?", "bsd", "", "bsd 4 clause"),
    ("bsd", r"bsd(?: style)? license", "bsd", "", "0bsd"),
    ("isc", r"isc license", "isc license", "", "isc"),
    ("mpl", r"mozilla public license", "mozilla public license", "1.0 1.1 2.0", "mpl {}"),
    ("epl", r"eclipse public license", "eclipse public license", "1.0 2.0", "epl {}"),
    ("cddl", r"common development and distribution license", "common development and distribution license", "1.0 1.1", "cddl {}"),
    ("cpl", r"common public license", "common public license", "1.0", "cpl {}"),
    ("ipl", r"ibm public license", "ibm public license", "1.0", "ipl {}"),
    ("eupl", r"european union public licen[cs]e", "european union public", "1.0 1.1 1.2", "eupl {}"),
    ("cecill", r"cecill(?: free software license)?(?: agreement)?", "cecill", "1.0 1.1 2.0 2.1", "cecill {}"),
    ("artistic", r"(?:perl )?artistic license", "artistic license", "1.0 2.0", "artistic {}"),
    ("zlib", r"zlib(?: libpng)? license", "zlib", "", "zlib"),
    ("boost", r"boost software license", "boost software license", "1.0", "bsl {}"),
    ("ms-pl", r"microsoft public license", "microsoft public license", "", "ms pl"),
    ("ms-rl", r"microsoft reciprocal license", "microsoft reciprocal license", "", "ms rl"),
    ("afl", r"academic free license", "academic free license", "1.1 1.2 2.0 2.1 3.0", "afl {}"),
    ("osl", r"open software license", "open software license", "1.0 1.1 2.0 2.1 3.0", "osl {}"),
    ("ofl", r"(?:sil )?open font license", "open font license", "1.0 1.1", "ofl {}"),
    ("odbl", r"(?:open data commons )?open database license", "open database license", "1.0", "odbl {}"),
    ("odc-by", r"open data commons attribution license", "open data commons attribution license", "1.0", "odc by {}"),
    ("pddl", r"(?:open data commons )?public domain dedication and license", "public domain dedication and license", "1.0", "pddl {}"),
    ("psf", r"(?:python software foundation|python|psf) license", "license", "2.0", "psf {}"),
    ("php", r"php license", "php license", "3.0 3.01", "php {}"),
    ("ruby", r"ruby license", "ruby license", "", "ruby"),
    ("vim", r"vim license", "vim license", "", "vim"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public license)", "", "1.0 2.0", "wtfpl"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", "", "unlicense"),
    ("qpl", r"q public license", "q public license", "1.0", "qpl {}"),
    ("npl", r"netscape public license", "netscape public license", "1.0 1.1", "npl {}"),
    ("spl", r"sun public license", "sun public license", "1.0", "spl {}"),
    ("apsl", r"apple public source license", "apple public source license", "1.0 1.1 1.2 2.0", "apsl {}"),
    ("upl", r"universal permissive license", "universal permissive license", "1.0", "upl {}"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? license", "ncsa", "", "ncsa"),
    ("sspl", r"server side public license", "server side public license", "1.0", "sspl {}"),
    ("elastic", r"elastic license", "elastic license", "1.0 2.0", "elastic {}"),
    ("busl", r"business source license", "business source license", "1.1", "busl {}"),
    ("polyform-nc", r"polyform noncommercial license", "polyform noncommercial license", "1.0", "polyform noncommercial {}"),
    ("openrail", r"(?:creativeml |bigscience )?open ?rail(?: m)?(?: license)?", "rail", "", "openrail"),
    ("llama", r"llama [23] community license", "community license", "", "llama"),
    ("cc0", r"(?:cc0|creative commons zero)", "", "1.0", "cc0 {}"),
]
# Clauses of the attribution licenses, as label and as words.
CC_CLAUSES = [("by", "by", "attribution"), ("by-sa", "by sa", "attribution share ?alike"), ("by-nc", "by nc", "attribution non ?commercial"),
              ("by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"), ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
              ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?")]
CC_VERSIONS = "1.0 2.0 2.5 3.0 4.0"
# Sentences of license texts.
SENTENCES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", EXACT),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", EXACT),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", EXACT),
    ("bsd-3-clause", "neither the name of .{1,80}? nor the names of its contributors", EXACT),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software", EXACT),
    ("gpl", "this program is free software you can redistribute it and or modify it", EXACT),
    ("lgpl", "this library is free software you can redistribute it and or modify it", EXACT),
    ("apache-2.0", "you may not use this file except in compliance with the license", EXACT),
    ("apache-2.0", "http www apache org licenses license 2 0", EXACT),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", EXACT),
    ("unlicense", "this is free and unencumbered software released into the public domain", EXACT),
    ("zlib", "this software is provided as is without any express or implied warranty", EXACT),
    ("boost", "permission is hereby granted free of charge to any person or organization", EXACT),
    ("wtfpl", "you just do what the fuck you want to", EXACT),
    ("cc0", "to the extent possible under law .{1,80}? waived all copyright", EXACT),
    ("all-rights-reserved", "all rights reserved", GRANT),
    ("all-rights-reserved", "(?:alle rechte vorbehalten|tous droits reserves|todos los derechos reservados)", GRANT),
    ("public-domain", "(?:released into|dedicated to|placed in|in) the public domain", GRANT),
    ("copyright-notice", "copyright (?:c )?(?:19|20)[0-9]{2}", NAME),
    ("warranty-disclaimer", "(?:is )?provided as is without warranty of any kind", NAME),
    ("proprietary", "(?:proprietary|confidential) and (?:proprietary|confidential)", NAME),
    ("proprietary", "may not be (?:reproduced|copied|redistributed) without (?:prior )?(?:written )?permission", GRANT),
    ("noncommercial", "for non ?commercial use only", GRANT),
    ("license-reference", "see (?:the )?licen[cs]e file", NAME),
    ("license-reference", "dual licensed", NAME),
]
SENTENCE_GATES = {
    "all rights reserved": "all rights reserved", "(?:alle": "", "(?:released into": "public domain", "copyright (?:c": "copyright",
    "(?:is )?provided": "without warranty", "(?:proprietary|": "proprietary", "may not be": "may not be", "for non": "use only",
    "see (?:the": "see ", "neither the name": "neither the name of", "to the extent": "to the extent possible under law",
}


def version_words(version: str) -> str:
    """``2.0`` is written 2, 2 0, v2 or version 2 0."""
    whole, _, part = version.partition(".")
    tail = "(?: 0)?" if part == "0" else f" {part}"
    return rf"(?: version| v| ver)? ?v?{whole}{tail}"


def family_rules(label: str, name: str, gate: str, versions: str, spdx: str) -> list[Rule]:
    gates = [gate] if gate else []
    verbs = r"(?:licensed|released|distributed|published|provided|available|covered) (?:under|by|according to)"
    terms = r"(?: the)?(?: terms(?: and conditions)? of(?: the)?)?(?: gnu)?"
    rules = [Rule(label, name, gates, NAME), Rule(label, f"{verbs}{terms} {name}", gates, GRANT)]
    head = "spdx license identifier "
    if spdx and "{}" not in spdx:
        rules.append(Rule(label, head + spdx, ["spdx license identifier"], EXACT))
    for version in versions.split():
        exact, words = f"{label}-{version}", version_words(version)
        rules.append(Rule(exact, name + words, gates, VERSION))
        rules.append(Rule(f"{exact}-or-later", rf"{name}{words} or (?:\(?at your option\)? )?(?:any )?later(?: version)?", [*gates, "later"], EXACT))
        rules.append(Rule(exact, f"{verbs}{terms} {name}{words}", gates, EXACT))
        if "{}" in spdx:
            rules.append(Rule(exact, head + spdx.format(version.replace(".", " ")), ["spdx license identifier"], EXACT))
    return rules


def build() -> list[Rule]:
    rules = [r for family in FAMILIES for r in family_rules(*family)]
    for label, short, long in CC_CLAUSES:
        rules += family_rules(f"cc-{label}", f"cc {short}", f"cc {short}", CC_VERSIONS, f"cc {short} {{}}")
        rules += family_rules(f"cc-{label}", f"creative commons {long}(?: international| unported)?(?: license)?", "creative commons", CC_VERSIONS, "")
    for label, sentence, priority in SENTENCES:
        gate = next((g for start, g in SENTENCE_GATES.items() if sentence.startswith(start)), sentence)
        rules.append(Rule(label, sentence, [gate] if gate else [], priority))
    return rules


RULES = build()
#: A text that holds none of these holds no match of any rule.
HINTS = ["licen", "gpl", "bsd", "cecill", "wtf", "rail", "cc0", "cc by", "creative commons", "spdx", "rights reserved", "rechte", "droits",
         "derechos", "public domain", "copyright", "warranty", "proprietary", "permission", "redistribut", "advertising", "neither the name",
         "free software", "possible under law", "commercial", "mit no attribution", "do what the"]
