"""Ordered signature rules for licenses: hand-written patterns over words, repeated by rule for names and versions."""

from __future__ import annotations

from dataclasses import dataclass

#: Base phrases and their labels. Their places are always counted.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Families with versions: label, keyword, names by preference, versions, SPDX stem.
VERSIONED = (
    ("gpl", "gpl", ("gnu gpl", "gpl"), ("1.0", "2.0", "3.0"), "gpl"),
    ("gpl", "gnu", ("gnu general public license",), ("1.0", "2.0", "3.0"), None),
    ("lgpl", "lgpl", ("gnu lgpl", "lgpl"), ("2.0", "2.1", "3.0"), "lgpl"),
    ("lgpl", "lesser", ("gnu lesser general public license", "lesser general public license"), ("2.0", "2.1", "3.0"), None),
    ("agpl", "agpl", ("gnu agpl", "agpl"), ("1.0", "3.0"), "agpl"),
    ("agpl", "affero", ("gnu affero general public license", "affero general public license"), ("1.0", "3.0"), None),
    ("gfdl", "gfdl", ("gnu fdl", "gfdl"), ("1.1", "1.2", "1.3"), "gfdl"),
    ("gfdl", "documentation", ("gnu free documentation license",), ("1.1", "1.2", "1.3"), None),
    ("apache", "apache", ("apache software license", "apache license", "apache"), ("1.0", "1.1", "2.0"), "apache"),
    ("mpl", "mpl", ("mpl",), ("1.0", "1.1", "2.0"), "mpl"),
    ("mpl", "mozilla", ("mozilla public license",), ("1.0", "1.1", "2.0"), None),
    ("epl", "eclipse", ("eclipse public license",), ("1.0", "2.0"), "epl"),
    ("cddl", "cddl", ("cddl",), ("1.0", "1.1"), "cddl"),
    ("eupl", "eupl", ("eupl", "european union public licence eupl"), ("1.0", "1.1", "1.2"), "eupl"),
    ("osl", "open", ("open software license",), ("1.0", "2.0", "2.1", "3.0"), "osl"),
    ("afl", "academic", ("academic free license",), ("1.1", "1.2", "2.0", "2.1", "3.0"), "afl"),
    ("artistic", "artistic", ("artistic license",), ("1.0", "2.0"), "artistic"),
    ("bsl", "boost", ("boost software license",), ("1.0",), "bsl"),
    ("ofl", "ofl", ("sil open font license", "ofl"), ("1.0", "1.1"), "ofl"),
    ("sspl", "sspl", ("server side public license", "sspl"), ("1.0",), "sspl"),
    ("elastic", "elastic", ("elastic license",), ("2.0",), "elastic"),
    ("busl", "business", ("business source license",), ("1.1",), "busl"),
    ("cc-by-nc-sa", "cc", ("cc by nc sa",), ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc by nc sa"),
    ("cc-by-nc-nd", "cc", ("cc by nc nd",), ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc by nc nd"),
    ("cc-by-nc", "cc", ("cc by nc",), ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc by nc"),
    ("cc-by-nd", "cc", ("cc by nd",), ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc by nd"),
    ("cc-by-sa", "cc", ("cc by sa",), ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc by sa"),
    ("cc-by", "cc", ("cc by",), ("1.0", "2.0", "2.5", "3.0", "4.0"), "cc by"),
    ("cc-by-nc-sa", "creative", ("creative commons attribution noncommercial sharealike", "creative commons attribution non commercial share alike"), ("2.0", "2.5", "3.0", "4.0"), None),
    ("cc-by-nc-nd", "creative", ("creative commons attribution noncommercial noderivatives", "creative commons attribution non commercial no derivatives"), ("2.0", "2.5", "3.0", "4.0"), None),
    ("cc-by-nc", "creative", ("creative commons attribution noncommercial", "creative commons attribution non commercial"), ("2.0", "2.5", "3.0", "4.0"), None),
    ("cc-by-nd", "creative", ("creative commons attribution noderivatives", "creative commons attribution no derivatives"), ("2.0", "2.5", "3.0", "4.0"), None),
    ("cc-by-sa", "creative", ("creative commons attribution sharealike", "creative commons attribution share alike"), ("2.0", "2.5", "3.0", "4.0"), None),
    ("cc-by", "creative", ("creative commons attribution",), ("2.0", "2.5", "3.0", "4.0"), None),
)
#: Licenses without versions: label, keyword, names, SPDX words.
PLAIN = (
    ("mit", "mit", ("mit license", "mit licence"), "mit"),
    ("mit-x11", "x11", ("x11 license",), "x11"),
    ("bsd-2-clause", "bsd", ("bsd 2 clause", "2 clause bsd", "simplified bsd license"), "bsd 2 clause"),
    ("bsd-3-clause", "bsd", ("bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license"), "bsd 3 clause"),
    ("bsd-4-clause", "bsd", ("bsd 4 clause", "4 clause bsd", "original bsd license"), "bsd 4 clause"),
    ("bsd", "bsd", ("bsd license", "bsd licence"), "0bsd"),
    ("isc", "isc", ("isc license",), "isc"),
    ("cc0-1.0", "cc0", ("cc0 1 0", "cc0"), "cc0 1 0"),
    ("unlicense", "unlicense", ("the unlicense",), "unlicense"),
    ("wtfpl", "wtfpl", ("wtfpl",), "wtfpl"),
    ("zlib", "zlib", ("zlib license", "zlib libpng license"), "zlib"),
    ("psf-2.0", "python", ("python software foundation license",), "psf 2 0"),
    ("postgresql", "postgresql", ("postgresql license",), "postgresql"),
    ("ruby", "ruby", ("ruby license",), "ruby"),
    ("openssl", "openssl", ("openssl license",), "openssl"),
    ("vim", "vim", ("vim license",), "vim"),
    ("ncsa", "ncsa", ("university of illinois ncsa open source license", "ncsa open source license"), "ncsa"),
    ("ms-pl", "microsoft", ("microsoft public license",), "ms pl"),
    ("ms-rl", "microsoft", ("microsoft reciprocal license",), "ms rl"),
    ("beerware", "beerware", ("beerware license", "beer ware license"), "beerware"),
    ("upl-1.0", "universal", ("universal permissive license",), "upl 1 0"),
    ("public-domain", "domain", ("released into the public domain", "dedicated to the public domain", "in the public domain"), None),
    ("all-rights-reserved", "reserved", ("all rights reserved",), None),
)
#: Sentences of license bodies: label, keyword, words as a pattern.
BODIES = (
    ("mit", "granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", "shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software"),
    ("apache-2.0", "warranties", "distributed on an as is basis without warranties or conditions of any kind"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("gpl", "redistribute", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "redistribute", "this library is free software you can redistribute it and or modify it"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck", "do what the fuck you want to"),
    ("bsl-1.0", "machine", "in the form of machine executable object code generated by a source language processor"),
)
#: Certainty of the kinds of rules.
NOTICE, TAG, BODY, VERSION, NAME = 1.0, 0.98, 0.95, 0.9, 0.75


@dataclass(frozen=True)
class Rule:
    """A pattern over text in which each word stands between two blanks of its own.

    Every match holds the word ``keyword`` and the words ``literal``, so a text without them needs no look at the pattern.
    """

    label: str
    keyword: str
    literal: str
    pattern: str
    certainty: float


def words(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


TAG_WORDS = words("spdx license identifier")


def gate(keyword: str, name: str) -> str:
    """The family's keyword where the name has it, else the name's longest word: every match must hold it."""
    return keyword if keyword in name.split() else max(name.split(), key=len)


def _versions(version: str) -> str:
    """3.0 is also written 3; 2.1 is not."""
    major, minor = version.split(".")
    return f" {major} (?: 0 )?" if minor == "0" else f" {major}  {minor} "


def build_rules() -> tuple[Rule, ...]:
    """All rules in order of priority: notices, tags, bodies, versioned names, bare names. Within a kind, as listed."""
    notices, tags, bodies, versions, names = [], [], [], [], []
    lead = "(?: licensed | released | distributed | available )(?: under )(?: the | a )?(?: terms  of  the )?"
    filler = "(?: license | licence )?(?: version | v )?"
    for label, keyword, family, numbers, spdx in VERSIONED:
        for number in sorted(numbers, reverse=True):
            for name in family:
                versions.append(Rule(f"{label}-{number}", gate(keyword, name), words(name), words(name) + filler + _versions(number), VERSION))
                notices.append(Rule(f"{label}-{number}", gate(keyword, name), words(name), lead + words(name) + filler + _versions(number), NOTICE))
            if spdx:
                tags.append(Rule(f"{label}-{number}", "spdx", TAG_WORDS, TAG_WORDS + words(spdx) + _versions(number) + "(?: only | or  later )?", TAG))
        for name in family:
            names.append(Rule(label, gate(keyword, name), words(name), words(name), NAME))
    for label, keyword, family, spdx in PLAIN:
        for name in family:
            notices.append(Rule(label, gate(keyword, name), words(name), lead + words(name), NOTICE))
            names.append(Rule(label, gate(keyword, name), words(name), words(name), NAME))
        if spdx:
            tags.append(Rule(label, "spdx", TAG_WORDS, TAG_WORDS + words(spdx), TAG))
    for label, keyword, sentence in BODIES:
        bodies.append(Rule(label, keyword, words(sentence), words(sentence), BODY))
    return (*notices, *tags, *bodies, *versions, *names)


RULES = build_rules()
