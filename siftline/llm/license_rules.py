"""Signature rules for license notices, written over lower-case words joined by single spaces.

Every license is a line of the table below; the forms in which a notice names
it are the templates.  A rule is one template with one license.
"""

from __future__ import annotations

from dataclasses import dataclass

# Label, gate word, name as a pattern over words, identifier as words.
LICENSES = [
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? (?:v ?)?2(?: 0)?", "apache 2 0"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? 1 1", "apache 1 1"),
    ("apache", "apache", r"apache(?: software)? license", "apache"),
    ("mit", "mit", r"mit(?: x11)?(?: style)? licen[sc]e", "mit"),
    ("mit", "expat", r"expat licen[sc]e", "expat"),
    ("mit-0", "mit", r"mit no attribution(?: license)?", "mit 0"),
    ("x11", "x11", r"x11(?: consortium)? license", "x11"),
    ("isc", "isc", r"isc license", "isc"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)(?: license)?", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", r"(?:bsd 4 clause|4 clause bsd|original bsd)(?: license)?", "bsd 4 clause"),
    ("0bsd", "0bsd", r"0bsd(?: license)?", "0bsd"),
    ("0bsd", "zero", r"(?:zero clause bsd|bsd zero clause)(?: license)?", "bsd zero clause"),
    ("bsd", "bsd", r"bsd(?: style)? license", "bsd"),
    ("bsd", "berkeley", r"berkeley software distribution license", "berkeley"),
    ("gpl-1.0", "general", r"(?:gnu )?general public licen[sc]e(?: version| v)? 1(?: 0)?", "gpl 1 0"),
    ("gpl-2.0", "general", r"(?:gnu )?general public licen[sc]e(?: version| v)? 2(?: 0)?", "gpl 2 0"),
    ("gpl-3.0", "general", r"(?:gnu )?general public licen[sc]e(?: version| v)? 3(?: 0)?", "gpl 3 0"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: license)?(?: version| v)? (?:v ?)?2(?: 0)?", "gplv2"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: license)?(?: version| v)? (?:v ?)?3(?: 0)?", "gplv3"),
    ("gpl", "gpl", r"gnu gpl(?: license)?", "gpl"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1", "lgpl 2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public licen[sc]e(?: version| v)? 3(?: 0)?", "lgpl 3 0"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public licen[sc]e(?: version| v)?(?: 2(?: 0)?)?", "lgpl 2 0"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e", "lgpl"),
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public licen[sc]e(?: version| v)?(?: 3(?: 0)?)?", "agpl 3 0"),
    ("gfdl-1.3", "documentation", r"(?:gnu )?free documentation license(?: version| v)? 1 3", "gfdl 1 3"),
    ("gfdl-1.2", "documentation", r"(?:gnu )?free documentation license(?: version| v)? 1 2", "gfdl 1 2"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation license", "gfdl"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: version| v)? 1 1", "mpl 1 1"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: version| v)? 2(?: 0)?", "mpl 2 0"),
    ("mpl", "mozilla", r"mozilla public license", "mpl"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version| v)? 1(?: 0)?", "epl 1 0"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v)? 2(?: 0)?", "epl 2 0"),
    ("cddl-1.0", "cddl", r"cddl(?: version| v)?(?: 1(?: 0)?)?", "cddl 1 0"),
    ("cddl-1.0", "distribution", r"common development and distribution license(?: version| v)?(?: 1(?: 0)?)?", "cddl"),
    ("cpl-1.0", "common", r"common public license(?: version| v)?(?: 1(?: 0)?)?", "cpl 1 0"),
    ("eupl-1.2", "eupl", r"eupl(?: version| v)?(?: 1 2)?", "eupl 1 2"),
    ("eupl", "european", r"european union public licen[sc]e", "eupl"),
    ("artistic-2.0", "artistic", r"artistic license(?: version| v)? 2(?: 0)?", "artistic 2 0"),
    ("artistic-1.0", "artistic", r"artistic license(?: version| v)? 1(?: 0)?", "artistic 1 0"),
    ("bsl-1.0", "boost", r"boost software license(?: version| v)?(?: 1(?: 0)?)?", "bsl 1 0"),
    ("busl-1.1", "business", r"business source license(?: version| v)?(?: 1 1)?", "busl 1 1"),
    ("sspl-1.0", "server", r"server side public license(?: version| v)?(?: 1(?: 0)?)?", "sspl 1 0"),
    ("zlib", "zlib", r"zlib(?: libpng)? license", "zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", "wtfpl"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa open source license", "ncsa"),
    ("psf-2.0", "python", r"python(?: software foundation)? license(?: version| v)?(?: 2(?: 0)?)?", "psf 2 0"),
    ("postgresql", "postgresql", r"postgresql licen[sc]e", "postgresql"),
    ("ofl-1.1", "sil", r"sil open font license(?: version| v)?(?: 1 1)?", "ofl 1 1"),
    ("odbl-1.0", "database", r"open database license(?: version| v)?(?: 1(?: 0)?)?", "odbl 1 0"),
    ("odc-by-1.0", "commons", r"open data commons attribution license(?: version| v)?(?: 1(?: 0)?)?", "odc by 1 0"),
    ("cc0-1.0", "cc0", r"cc0(?: version| v)?(?: 1(?: 0)?)?(?: universal)?", "cc0 1 0"),
    ("cc-by-4.0", "cc", r"cc by 4(?: 0)?", "cc by 4 0"),
    ("cc-by-3.0", "cc", r"cc by 3(?: 0)?", "cc by 3 0"),
    ("cc-by-2.0", "cc", r"cc by 2 [05]", "cc by 2 0"),
    ("cc-by-sa-4.0", "cc", r"cc by sa 4(?: 0)?", "cc by sa 4 0"),
    ("cc-by-sa-3.0", "cc", r"cc by sa 3(?: 0)?", "cc by sa 3 0"),
    ("cc-by-sa", "cc", r"cc by sa", "cc by sa"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4(?: 0)?", "cc by nc 4 0"),
    ("cc-by-nc-3.0", "cc", r"cc by nc 3(?: 0)?", "cc by nc 3 0"),
    ("cc-by-nc", "cc", r"cc by nc", "cc by nc"),
    ("cc-by-nd-4.0", "cc", r"cc by nd 4(?: 0)?", "cc by nd 4 0"),
    ("cc-by-nd", "cc", r"cc by nd", "cc by nd"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa 4(?: 0)?", "cc by nc sa 4 0"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa", "cc by nc sa"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd 4(?: 0)?", "cc by nc nd 4 0"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd", "cc by nc nd"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: \d 0)?(?: international)?", "creative commons by nc sa"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: \d 0)?(?: international)?", "creative commons by nc nd"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: \d 0)?(?: international)?", "creative commons by sa"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: \d 0)?(?: international)?", "creative commons by nc"),
    ("cc-by", "creative", r"creative commons attribution(?: \d 0)?(?: international)?", "creative commons by"),
    ("cc", "creative", r"creative commons licen[sc]e", "creative commons"),
    ("public-domain", "domain", r"public domain(?: dedication)?", "public domain"),
    ("openrail-m", "openrail", r"(?:bigscience )?openrail m?(?: license)?", "openrail m"),
    ("ms-pl", "microsoft", r"microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", r"microsoft reciprocal license", "ms rl"),
]
GRANT = r"(?:licen[sc]ed|released|distributed|published|provided|available|redistributed|covered)"

#: Order is priority: what an earlier template finds hides what later ones find inside it.  Name, pattern, gate (None: the license's), score.
TEMPLATES = [
    ("identifier", r"spdx license identifier {id}", "spdx", 1.0),
    ("grant", GRANT + r"(?: \w+)? under(?: the)?(?: terms of)?(?: the)? {name}(?: license)?(?: international)?", None, 0.95),
    ("terms", r"(?:terms|conditions|provisions) of the {name}", None, 0.9),
    ("declared", r"licen[sc]e(?:d| is| type| name)?(?: the)? {name}", None, 0.85),
    ("name", r"{name}", None, 0.7),
]

# Notices without a named license.
NOTICES = [
    ("reserved", "rights", r"(?:all|some|no) rights (?:are )?reserved", 0.9),
    ("copyright", "copyright", r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)?", 0.6),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.9),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution|use) (?:of this \w+ )?is (?:strictly )?prohibited", 0.9),
    ("warranty", "warranty", r"without (?:any )?warranty of any kind", 0.5),
    ("warranty", "warranties", r"without warranties or conditions of any kind", 0.5),
    ("permissive", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("permissive", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 0.9),
    ("non-commercial", "noncommercial", r"for noncommercial (?:use|purposes) only", 0.7),
    ("non-commercial", "commercial", r"(?:non|not for) commercial (?:use|purposes)(?: only)?", 0.7),
]

# Phrases that are always reported.
BASE = [("cc-by", "cc", "cc by"), ("gpl", "general", "general public license"), ("reserved", "reserved", "all rights reserved")]
BASE_SCORE = 0.6


@dataclass(frozen=True)
class Rule:
    order: int
    label: str
    gate: str
    pattern: str
    score: float
    base: bool = False


def rules() -> list[Rule]:
    """All rules in order of priority."""
    out: list[tuple[str, str, str, float, bool]] = []
    for _, pattern, gate, score in TEMPLATES:
        for label, own, name, identifier in LICENSES:
            out.append((label, gate or own, pattern.replace("{name}", name).replace("{id}", identifier), score, False))
    out += [(label, gate, pattern, score, False) for label, gate, pattern, score in NOTICES]
    out += [(label, gate, pattern, BASE_SCORE, True) for label, gate, pattern in BASE]
    return [Rule(i, *x) for i, x in enumerate(out)]
