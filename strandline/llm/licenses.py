"""Licence scans: ordered signature rules with keyword gates, priorities and containment suppression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.text import laid, let, lower_ascii

#: Phrases whose words must stand consecutively, and the label of each.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: What isn't part of a word: ASCII but digits and lower-case letters.
_GAP = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_GAP_ANY_CASE = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: label: (words of which one must occur, how its name reads in normalised words, SPDX words, whether the name speaks for itself)
NAMES: dict[str, tuple[str, str, str, bool]] = {
    "mit": ("mit|expat", "(?:mit|expat|mit x11)", "mit", False),
    "apache-2": ("apache", "apache(?: software)?(?: license)?(?: version)? (?:v)?2(?: 0)?", "apache 2(?: 0)?", False),
    "apache-1.1": ("apache", "apache(?: software)?(?: license)?(?: version)? (?:v)?1 1", "apache 1 1", False),
    "gpl-3": ("gpl|general", "(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v)?3(?: 0)?", "gpl 3 0(?: only| or later)?", False),
    "gpl-2": ("gpl|general", "(?:gnu )?(?:general public license|gpl)(?: as published by the free software foundation)?(?: either)?(?: version)? (?:v)?2(?: 0)?", "gpl 2 0(?: only| or later)?", False),
    "lgpl-3": ("lgpl|lesser", "(?:gnu )?(?:lesser general public license|lgpl)(?: version)? (?:v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?", False),
    "lgpl-2.1": ("lgpl|lesser", "(?:gnu )?(?:lesser general public license|lgpl)(?: version)? (?:v)?2 1", "lgpl 2 1(?: only| or later)?", False),
    "agpl-3": ("affero", "(?:gnu )?affero general public license(?: version)? (?:v)?3(?: 0)?", "agpl 3 0(?: only| or later)?", True),
    "bsd-2-clause": ("bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", True),
    "bsd-3-clause": ("bsd", "(?:modified bsd|new bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", True),
    "bsd-4-clause": ("bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause", True),
    "isc": ("isc", "isc", "isc", False),
    "mpl-2": ("mozilla", "mozilla public license(?: version)?(?: v)? 2(?: 0)?", "mpl 2 0", True),
    "mpl-1.1": ("mozilla", "mozilla public license(?: version)?(?: v)? 1 1", "mpl 1 1", True),
    "epl-2": ("eclipse", "eclipse public license(?: version)?(?: v)? 2(?: 0)?", "epl 2 0", True),
    "epl-1": ("eclipse", "eclipse public license(?: version)?(?: v)? 1(?: 0)?", "epl 1 0", True),
    "cddl-1": ("development", "common development and distribution license(?: version)?(?: 1(?: 0)?)?", "cddl 1 0", True),
    "cpl-1": ("common", "common public license(?: version)?(?: 1(?: 0)?)?", "cpl 1 0", True),
    "eupl-1.2": ("european", "european union public licence(?: version)?(?: v)?(?: 1 2)?", "eupl 1 2", True),
    "artistic-2": ("artistic", "artistic license(?: version)? 2(?: 0)?", "artistic 2 0", True),
    "artistic-1": ("artistic", "artistic license(?: version)? 1(?: 0)?", "artistic 1 0", True),
    "zlib": ("zlib", "zlib(?: libpng)?", "zlib", False),
    "boost-1": ("boost", "boost software license(?: version)?(?: 1(?: 0)?)?", "bsl 1 0", True),
    "unlicense": ("unlicense", "unlicense", "unlicense", True),
    "wtfpl": ("wtfpl", "wtfpl", "wtfpl", True),
    "postgresql": ("postgresql", "postgresql", "postgresql", False),
    "python-2": ("python", "python software foundation(?: license)?(?: version)?(?: 2)?", "python 2 0", False),
    "ruby": ("ruby", "ruby", "ruby", False),
    "php-3": ("php", "php(?: license)?(?: version)? 3(?: 0\\d?)?", "php 3 0\\d?", False),
    "openssl": ("openssl", "openssl", "openssl", False),
    "ofl-1.1": ("open", "(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1", True),
    "upl-1": ("universal", "universal permissive license(?: version)?(?: v)?(?: 1 0)?", "upl 1 0", True),
    "bsl-1.1": ("business", "business source license(?: version)?(?: 1 1)?", "busl 1 1", True),
    "sspl-1": ("server", "server side public license(?: version)?(?: v)?(?: 1)?", "sspl 1 0", True),
    "odbl-1": ("database", "open database license(?: version)?(?: v)?(?: 1 0)?", "odbl 1 0", True),
    "cdla-permissive": ("community", "community data license agreement permissive(?: version)?(?: \\d \\d)?", "cdla permissive \\d \\d", True),
    "cc0-1": ("cc0", "(?:creative commons )?cc0(?: 1 0)?(?: universal)?", "cc0 1 0", True),
    "cc-by": ("cc|attribution", "(?:cc by|creative commons attribution)(?: [1-4] \\d)?(?: international)?(?! (?:nc|sa|nd|noncommercial|sharealike|noderivatives))", "cc by [1-4] \\d", True),
    "cc-by-sa": ("cc|attribution", "(?:cc by sa|creative commons attribution share ?alike)(?: [1-4] \\d)?(?: international)?", "cc by sa [1-4] \\d", True),
    "cc-by-nd": ("cc|attribution", "(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s)(?: [1-4] \\d)?", "cc by nd [1-4] \\d", True),
    "cc-by-nc": ("cc|attribution", "(?:cc by nc|creative commons attribution non ?commercial)(?: [1-4] \\d)?(?: international)?(?! (?:sa|nd))", "cc by nc [1-4] \\d", True),
    "cc-by-nc-sa": ("cc|attribution", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: [1-4] \\d)?", "cc by nc sa [1-4] \\d", True),
    "cc-by-nc-nd": ("cc|attribution", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s)(?: [1-4] \\d)?", "cc by nc nd [1-4] \\d", True),
    "public-domain": ("domain", "(?:the )?public domain", "public domain", False),
    "proprietary": ("rights", "all rights reserved", "proprietary", True),
}

#: The forms of a notice around a name: what comes first outranks what comes later; {n} the name, {s} its SPDX words.
FORMS: list[tuple[int, str]] = [
    (1, "spdx license identifier {s}"),
    (1, "(?:licensed|released|distributed|available|provided|published|redistributed|offered) under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?(?:gnu )?{n}(?: licen[sc]e)?(?: version \\d(?: \\d)?)?"),
    (1, "(?:dedicated|released|placed|committed) (?:in ?to|to|in) {n}"),
    (2, "under (?:the )?(?:terms (?:and conditions )?of (?:the )?)?{n} licen[sc]e"),
    (2, "{n} licen[sc]e(?:d)?"),
    (3, "licen[sc]e(?:d)?(?: is| as| type| name)? {n}"),
]
#: Signatures written out: priority, label, words of which one must occur, and how the words of a text, header or address read.
SIGNATURES: list[tuple[int, str, str, str]] = [
    (1, "mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    (1, "mit", "notice", "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions"),
    (2, "mit", "warranty", "the software is provided as is without warranty of any kind express or implied"),
    (2, "mit", "liable", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    (1, "isc", "hereby", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    (2, "isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    (1, "bsd", "redistribution", "redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?"),
    (2, "bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    (2, "bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    (1, "bsd-3-clause", "endorse", "neither the names? of (?:[^ ]+ ){1,12}?nor the names of (?:its|their|any) contributors may be used to endorse or promote"),
    (1, "bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    (2, "bsd", "disclaimed", "this software is provided by the (?:copyright holders? and contributors|regents and contributors|author) as is and any express or implied warranties (?:[^ ]+ ){1,20}?are disclaimed"),
    (3, "bsd", "bsd", "bsd (?:style |like |type )?licen[sc]ed?"),
    (3, "bsd", "bsd", "under (?:the )?(?:terms of the )?bsd"),
    (2, "bsd-2-clause", "freebsd", "free ?bsd licen[sc]e"),
    (2, "0bsd", "0bsd|zero", "(?:0bsd|bsd zero clause|zero clause bsd)"),
    (1, "apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance"),
    (2, "apache-2", "apache", "(?:http |https )?(?:www )?apache org licenses license 2 0"),
    (2, "apache-2", "asl|apache2|apachev2", "(?:asl 2(?: 0)?|apachev?2(?: 0)?)"),
    (2, "apache-2", "unless", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    (1, "gpl-2", "general", "under the terms of the gnu general public license(?: as published by the free software foundation)? (?:either )?version 2"),
    (1, "gpl-3", "general", "under the terms of the gnu general public license(?: as published by the free software foundation)? (?:either )?version 3"),
    (1, "lgpl-2.1", "lesser", "under the terms of the gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 2 1"),
    (1, "lgpl-3", "lesser", "under the terms of the gnu lesser general public license(?: as published by the free software foundation)? (?:either )?version 3"),
    (1, "lgpl-2", "library", "under the terms of the gnu library general public license(?: as published by the free software foundation)?"),
    (1, "agpl-3", "affero", "under the terms of the gnu affero general public license(?: as published by the free software foundation)?"),
    (2, "gpl", "general", "you should have received a copy of the gnu general public license"),
    (2, "lgpl", "lesser", "you should have received a copy of the gnu lesser general public license"),
    (2, "agpl-3", "affero", "you should have received a copy of the gnu affero general public license"),
    (2, "gpl-3", "gplv3|gpl3", "gplv?3(?: 0)?(?: only| or later)?"),
    (2, "gpl-2", "gplv2|gpl2", "gplv?2(?: 0)?(?: only| or later)?"),
    (2, "lgpl-3", "lgplv3|lgpl3", "lgplv?3(?: 0)?(?: only| or later)?"),
    (2, "lgpl-2.1", "lgplv2|lgpl2", "lgplv?2 1(?: only| or later)?"),
    (2, "lgpl-2", "lgplv2|lgpl2", "lgplv?2(?: 0)?(?! 1)"),
    (2, "agpl-3", "agplv3|agpl3", "agplv?3(?: 0)?(?: only| or later)?"),
    (3, "agpl-3", "agpl", "(?:gnu )?agpl"),
    (3, "gpl", "gpl", "(?:gnu gpl|gpl licen[sc]ed?|under (?:the )?(?:terms of the )?(?:gnu )?gpl)"),
    (3, "lgpl", "lgpl", "(?:gnu lgpl|lgpl licen[sc]ed?|under (?:the )?(?:terms of the )?(?:gnu )?lgpl)"),
    (3, "gpl", "general", "(?:the )?gnu general public license"),
    (3, "lgpl", "lesser", "(?:the )?gnu lesser general public license"),
    (2, "gpl", "copyleft", "(?:strong )?copyleft licen[sc]e"),
    (2, "gfdl", "documentation", "gnu free documentation license(?: version 1 \\d)?"),
    (3, "gfdl", "gfdl", "gfdl"),
    (2, "eupl-1.2", "eupl", "(?:under (?:the )?(?:terms of the )?)?eupl(?: v ?1 2| version 1 2| 1 2)?"),
    (2, "eupl-1.2", "european", "european union public licen[sc]e"),
    (1, "mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    (1, "mpl-2", "mpl", "if a copy of the mpl was not distributed with this file"),
    (1, "mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    (2, "mpl-2", "mpl|mplv2", "(?:mpl 2 0|mplv2|mpl v2)"),
    (3, "mpl", "mozilla", "mozilla public license"),
    (1, "epl-2", "eclipse", "accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0"),
    (1, "epl-1", "eclipse", "accompanying materials are made available under the terms of the eclipse public license (?:v |version )?1 0"),
    (2, "epl-2", "epl", "epl (?:v ?)?2 0"),
    (2, "epl-1", "epl", "epl (?:v ?)?1 0"),
    (1, "cddl-1", "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    (3, "cddl-1", "cddl", "cddl(?: 1 0| v1)? licen[sc]e"),
    (1, "zlib", "liable", "provided as is without any express or implied warranty in no event will the authors be held liable"),
    (1, "zlib", "altered", "altered source versions must be plainly marked as such"),
    (1, "zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    (1, "boost-1", "boost", "distributed under the boost software license"),
    (2, "boost-1", "boost", "(?:www )?boost org license 1 0 txt"),
    (1, "unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    (1, "unlicense", "anyone", "anyone is free to copy modify publish use compile sell or distribute this software"),
    (1, "unlicense", "dedicate", "dedicate any and all copyright interest in the software to the public domain"),
    (2, "unlicense", "unlicense", "(?:http |https )?unlicense org"),
    (1, "wtfpl", "want", "do what the f[a-z]+ you want to public license"),
    (2, "perl", "perl", "under the same terms as perl(?: itself)?"),
    (2, "artistic-1", "artistic", "(?:the )?(?:perl )?artistic license"),
    (1, "python-2", "psf|python", "(?:psf license agreement for python|python software foundation license)"),
    (1, "openssl", "openssl", "this product includes software developed by the openssl project"),
    (1, "ofl-1.1", "font", "this font software is licensed under the sil open font license"),
    (2, "ofl-1.1", "scripts|openfontlicense", "(?:scripts sil org ofl|openfontlicense org)"),
    (1, "cc-by", "creative", "licensed under a creative commons attribution (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    (1, "cc-by-sa", "creative", "licensed under a creative commons attribution share ?alike (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    (1, "cc-by-nc", "creative", "licensed under a creative commons attribution non ?commercial (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    (1, "cc-by-nd", "creative", "licensed under a creative commons attribution no ?deriv(?:ative)?s (?:[1-4] \\d )?(?:international |unported |generic )?license"),
    (2, "cc-by", "creativecommons", "creativecommons org licenses by(?! nc| sa| nd)(?: [1-4] \\d)?"),
    (2, "cc-by-sa", "creativecommons", "creativecommons org licenses by sa(?: [1-4] \\d)?"),
    (2, "cc-by-nd", "creativecommons", "creativecommons org licenses by nd(?: [1-4] \\d)?"),
    (2, "cc-by-nc", "creativecommons", "creativecommons org licenses by nc(?! sa| nd)(?: [1-4] \\d)?"),
    (2, "cc-by-nc-sa", "creativecommons", "creativecommons org licenses by nc sa(?: [1-4] \\d)?"),
    (2, "cc-by-nc-nd", "creativecommons", "creativecommons org licenses by nc nd(?: [1-4] \\d)?"),
    (2, "cc0-1", "creativecommons", "creativecommons org publicdomain zero(?: 1 0)?"),
    (1, "cc0-1", "waived", "to the extent possible under law (?:[^ ]+ ){1,8}?(?:has|have) waived all copyright"),
    (2, "public-domain", "creativecommons", "creativecommons org publicdomain mark(?: 1 0)?"),
    (3, "public-domain", "domain", "public domain (?:mark|dedication|work|software)"),
    (3, "public-domain", "rights", "no rights reserved"),
    (3, "some-rights-reserved", "rights", "some rights reserved"),
    (2, "proprietary", "permission|consent", "(?:may|must) not be (?:copied|reproduced|distributed|used|modified|published)(?: or (?:copied|reproduced|distributed|used|modified|published))* without (?:the )?(?:express )?(?:prior )?(?:written )?(?:permission|consent)"),
    (2, "proprietary", "part", "no part of this (?:publication|document|work|book|site|website) may be reproduced"),
    (2, "proprietary", "confidential", "(?:proprietary and confidential|confidential and proprietary)"),
    (2, "proprietary", "prohibited", "unauthori[sz]ed (?:copying|reproduction|distribution|use|redistribution) (?:of this (?:file|software|document|material) )?(?:via any medium )?is (?:strictly )?prohibited"),
    (2, "proprietary", "user", "end user licen[sc]e agreement"),
    (2, "proprietary", "commercial", "(?:under a commercial licen[sc]e|commercial licen[sc]e (?:is )?required)"),
    (2, "elastic-2", "elastic", "elastic license(?: 2 0| v2)?"),
    (2, "commons-clause", "commons", "commons clause (?:license )?(?:condition|restriction|v1)"),
    (2, "polyform", "polyform", "polyform (?:noncommercial|small business|shield|strict|internal use|free trial) license"),
    (2, "hippocratic", "hippocratic", "hippocratic license"),
    (1, "json", "evil", "the software shall be used for good not evil"),
    (2, "beerware", "beerware|beer", "(?:beerware|the beer ware) license"),
    (2, "ms-pl", "microsoft|ms", "(?:microsoft public license|ms pl license)"),
    (2, "ms-rl", "microsoft|ms", "(?:microsoft reciprocal license|ms rl license)"),
    (2, "afl-3", "academic", "academic free license(?: version)?(?: v)?(?: 3 0)?"),
    (2, "osl-3", "open", "open software license(?: version)?(?: v)?(?: 3 0)?"),
    (2, "blueoak-1", "blue", "blue oak model license(?: 1 0 0)?"),
    (2, "ncsa", "ncsa", "(?:university of illinois )?ncsa open source license"),
    (2, "w3c", "w3c", "w3c (?:software notice and|software and document) license"),
    (2, "x11", "x11", "x11 license"),
    (2, "vim", "vim", "vim license"),
    (2, "ipl-1", "ibm", "ibm public license(?: version)?(?: 1 0)?"),
    (2, "qpl-1", "q", "q public license(?: version)?(?: 1 0)?"),
    (2, "sleepycat", "sleepycat", "sleepycat license"),
    (2, "nasa-1.3", "nasa", "nasa open source agreement(?: 1 3)?"),
    (2, "cecill", "cecill", "cecill(?: [abc])?(?: (?:version )?[12](?: [01])?)? licen[sc]e"),
    (2, "mulan-2", "mulan", "mulan (?:psl|permissive software license)(?: v ?2| version 2)?"),
    (2, "ogl", "government", "open government licen[sc]e(?: v ?[123](?: 0)?)?"),
    (2, "odc-by", "commons", "open data commons attribution licen[sc]e"),
    (2, "pddl", "commons", "open data commons public domain dedication and licen[sc]e"),
    (2, "cdla-sharing", "community", "community data license agreement sharing(?: version \\d \\d)?"),
    (2, "llama", "llama", "llama (?:\\d (?:\\d )?)?community license"),
    (2, "openrail", "rail|openrail", "(?:bigscience|bigcode|creativeml) (?:open ?)?rail m? ?licen[sc]e"),
    (2, "apsl-2", "apple", "apple public source license(?: version)?(?: 2 0)?"),
    (2, "ecl-2", "educational", "educational community license(?: version)?(?: 2 0)?"),
    (2, "ntp", "hereby", "permission to use copy modify and distribute this software and its documentation for any purpose (?:with or )?without fee is hereby granted"),
    (2, "tcl", "hereby", "the authors hereby grant permission to use copy modify distribute and license this software"),
]

#: A name that speaks for itself is a rule of its own.
ALONE = (3, "{n}")
CONFIDENCE = {1: 1.0, 2: 0.8, 3: 0.5}

#: Of the texts that hold a gate word those without any of these hold no signature: words of names and forms, and how the other forms begin.
PREFILTER = (
    "(?i)licen[sc]|spdx|public[^0-9a-z]+domain|rights[^0-9a-z]+reserved|cc0|wtfpl|attribution|bsd|cc[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+by"
    "|hereby|redistribut|copyright|gpl|gfdl|eupl|(?<![a-z])(?:mpl|epl|asl|perl|psf|sil)(?![a-z])|mplv2|0bsd|zero|apache|disclaim|advertis|endorse|misrepresent|plainly|unencumbered|anyone|dedicat|openssl|openfont|unauthori|reproduced|confidential|(?:permission|consent)|commons|evil|mulan|nasa|boost|warrant|to[^0-9a-z]+the[^0-9a-z]+extent"
    f"|(?:released|distributed|available|provided|published|offered){_GAP_ANY_CASE}under|(?:dedicated|released|placed|committed){_GAP_ANY_CASE}(?:in|to)"
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    gate: str
    pattern: str


def rules() -> list[Rule]:
    """The ordered rules: every form of every name, and the signatures, under word limits."""
    made = []
    for label, (word, name, spdx, alone) in NAMES.items():
        for priority, form in [*FORMS, *([ALONE] if alone else [])]:
            gate = "spdx" if "{s}" in form else word
            made.append(Rule(label, priority, gate, "(?<= )" + form.format(n=f"(?:{name})", s=f"(?:{spdx})") + "(?= )"))
    made += [Rule(label, priority, gate, f"(?<= ){pattern}(?= )") for priority, label, gate, pattern in SIGNATURES]
    return sorted(made, key=lambda r: r.priority)


def _gates(table: list[Rule]) -> list[str]:
    """The words of which a text holds one if it holds a signature or a base phrase."""
    found = {w for r in table for w in r.gate.split("|")}
    return sorted(found.union(*[phrase.split() for phrase in BASE if not found & set(phrase.split())]))


def _word_spans(norm: Column, rule: Column) -> Column:
    """Detections of a rule in ' w0 w1 ... ': (first word, minus the end, priority, order, label)."""
    hits = F.regexp_extract_all(norm, rule["pattern"], F.lit(0))
    none = F.array().cast("array<struct<first:int,stop:int,priority:int,n:int,label:string>>")
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(norm, rule["pattern"], -1), 1, F.size(found))
        at = laid(F.zip_with(gaps, found, lambda g, h: F.struct(blanks(g).alias("g"), blanks(h).alias("h"))))
        return F.transform(at, lambda x: F.struct((x["start"] - 1).alias("first"), (-x["stop"]).alias("stop"), rule["priority"].alias("priority"), rule["n"].alias("n"), rule["label"].alias("label")))

    return let(hits, lambda found: F.when(F.size(found) == 0, none).otherwise(placed(found)))


def _surviving(found: Column) -> Column:
    """Labels and best priority of detections that none of the same or a higher priority contains.

    In order of start, longest first, a detection lies within an earlier one if it ends no later than
    the furthest end so far; the furthest ends are kept by priority, so one pass decides.
    """
    start = F.struct(F.lit(0).alias("m1"), F.lit(0).alias("m2"), F.lit(0).alias("m3"), F.lit(9).alias("best"), F.array().cast("array<string>").alias("labels"))

    def step(acc: Column, x: Column) -> Column:
        stop, p = -x["stop"], x["priority"]
        reach = F.when(p == 1, acc["m1"]).when(p == 2, acc["m2"]).otherwise(acc["m3"])
        stays = reach < stop
        return F.struct(
            F.when(p <= 1, F.greatest(acc["m1"], stop)).otherwise(acc["m1"]).alias("m1"),
            F.when(p <= 2, F.greatest(acc["m2"], stop)).otherwise(acc["m2"]).alias("m2"),
            F.greatest(acc["m3"], stop).alias("m3"),
            F.when(stays, F.least(acc["best"], p)).otherwise(acc["best"]).alias("best"),
            F.when(stays, F.array_union(acc["labels"], F.array(x["label"]))).otherwise(acc["labels"]).alias("labels"),
        )

    return F.aggregate(F.sort_array(found), start, step)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    Words are runs of digits, a-z and non-ASCII of the text with A-Z lowered; null counts as empty.
    The base places count wherever the phrases stand; they stay whatever the rules say. Texts that hold a gate word, looked up
    among their words, and then a keyword are tried against the rules whose own gate word they hold; labels of detections that aren't
    contained in one of the same or a higher priority (by words, the earlier rule where equal) are added. score is
    the confidence of the best of them. All is done row by row: no shuffle, repeated rows repeat.
    """
    every = rules()
    table = F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.array(*[F.lit(w) for w in r.gate.split("|")]).alias("gate"), F.lit(r.pattern).alias("pattern"), F.lit(i).alias("n")) for i, r in enumerate(every)])
    raw = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.split(lower_ascii(raw), _GAP, -1)
    count = F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - (F.element_at(pieces, -1) == "").cast("int")
    n_words = F.greatest(F.when(raw == "", F.lit(0)).otherwise(count), F.lit(0)).cast("long")
    held = F.array_intersect(F.array(*[F.lit(w) for w in _gates(every)]), pieces)
    worded = docs.select("doc_id", "text", n_words.alias("n_words"), held.alias("held"))
    norm = F.when((F.size("held") > 0) & raw.rlike(PREFILTER), F.concat(F.lit(" "), F.btrim(F.regexp_replace(lower_ascii(raw), _GAP, " ")), F.lit(" ")))
    first = worded.select("doc_id", "n_words", "held", norm.alias("norm"))
    gated = F.filter(table, lambda r: F.arrays_overlap(r["gate"], F.col("held")))
    found = F.when(F.col("norm").isNotNull(), F.flatten(F.transform(gated, lambda r: _word_spans(F.col("norm"), r))))
    places = []
    for phrase, label in BASE.items():
        parts = F.when(F.col("norm").isNotNull(), F.split(F.col("norm"), f"(?<= ){phrase}(?= )", -1))
        places.append((label, len(phrase.split()), parts))
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    hits = [F.coalesce(F.size(parts) - 1, F.lit(0)) for _, _, parts in places]
    firsts = [F.when(F.size(parts) > 1, blanks(F.element_at(parts, 1)) - 1) for _, _, parts in places]
    lasts = [F.when(F.size(parts) > 1, F.col("n_words") - (blanks(F.element_at(parts, -1)) - 1) - n) for _, n, parts in places]
    base = F.array_compact(F.array(*[F.when(F.size(parts) > 1, F.lit(label)) for label, _, parts in places]))
    second = first.select(
        "doc_id", "n_words",
        sum(hits[1:], hits[0]).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(base).alias("base"),
        F.when(F.col("norm").isNotNull(), _surviving(found)).alias("more"),
    )
    labels = F.array_sort(F.array_union("base", F.coalesce(F.col("more.labels"), F.array().cast("array<string>"))))
    best = F.least(F.coalesce(F.col("more.best"), F.lit(9)), F.when(F.size("base") > 0, F.lit(2)).otherwise(F.lit(9)))
    score = F.when(best == 1, F.lit(CONFIDENCE[1])).when(best == 2, F.lit(CONFIDENCE[2])).when(best == 3, F.lit(CONFIDENCE[3])).otherwise(F.lit(0.0))
    return second.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
