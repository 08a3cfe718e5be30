"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. Rules are regular expressions over the words (a blank is the
gap between two words), each with a label, a priority (1: names a license and its version, or quotes its text; 2: names
a license; 3: a hint) and a keyword: words that stand consecutively in whatever it matches. Keywords gate the rules in two steps. The words of
a text are intersected with the keywords' anchors (the longest word of each); most texts hold none and are done. In the
others the keywords of the anchors found are searched for, and only rules whose keyword occurs are tried. A rule's matches are spans of words.

Overlapping detections are resolved by priority and containment: a span goes if a span of the same or a stronger priority
contains it (of equal spans, that of the earlier rule stays). Whatever contains a span sorts before it by start
and falling end, so one pass with the farthest ends so far decides; it is made in chunks, and costs time in
proportion to the spans. Detections of the three base phrases are always reported beside what is left.

All is one projection of built-in functions: no row leaves its task, nothing is shuffled, and the rules (a fixed table) are a literal of
the plan.

Cases: null and blank texts have no words, no label and score 0. Repeated rows come back each; a null id is kept. Extra columns
are ignored. An empty table gives no row. Texts are scanned whole, however long.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Score by the strongest priority that is left.
SCORES = {1: 1.0, 2: 0.7, 3: 0.4}
CHUNK = 64
#: What parts words, when A-Z is lower-cased.
_PARTS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_MARK = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Base phrases: fixed by the contract of the query.
BASE = [("cc-by", "cc by", "cc by"), ("gpl", "general public license", "general public license"), ("reserved", "all rights reserved", "all rights reserved")]

_V = "(version |ver |release |v |v)?"
_LATER = "( or( at your option)?( any)?( later| newer| higher)( versions?)?| at your option any later version| or above| and later| plus)"

# family, label, long name (keyword, pattern), short name (keyword, pattern), versions
_FAMILIES = [
    ("gpl", ("general public license", "(gnu )?general public license"), ("gpl", "(gnu )?gpl"), ("1.0", "2.0", "3.0"), True),
    ("lgpl", ("general public license", "(gnu )?(lesser|library) general public license"), ("lgpl", "(gnu )?lgpl"), ("2.0", "2.1", "3.0"), True),
    ("agpl", ("affero general public license", "(gnu )?affero general public license"), ("agpl", "(gnu )?agpl"), ("1.0", "3.0"), True),
    ("gfdl", ("free documentation license", "(gnu )?free documentation license"), ("gfdl", "(gnu )?gfdl"), ("1.1", "1.2", "1.3"), True),
    ("apache", ("apache", "apache (software )?license"), ("apache", "apache"), ("1.0", "1.1", "2.0"), False),
    ("mpl", ("mozilla public license", "mozilla public license"), ("mpl", "mpl"), ("1.0", "1.1", "2.0"), True),
    ("epl", ("eclipse public license", "eclipse public license"), ("epl", "epl"), ("1.0", "2.0"), False),
    ("cddl", ("common development and distribution license", "common development and distribution license"), ("cddl", "cddl"), ("1.0", "1.1"), False),
    ("eupl", ("european union public license", "european union public license"), ("eupl", "eupl"), ("1.0", "1.1", "1.2"), True),
    ("osl", ("open software license", "open software license"), ("osl", "osl"), ("1.0", "2.0", "2.1", "3.0"), False),
    ("afl", ("academic free license", "academic free license"), ("afl", "afl"), ("1.1", "1.2", "2.0", "2.1", "3.0"), False),
    ("artistic", ("artistic license", "(the )?artistic license"), ("artistic", "perl artistic|artistic"), ("1.0", "2.0"), False),
    ("cpl", ("common public license", "common public license"), ("cpl", "cpl"), ("1.0",), False),
    ("lppl", ("project public license", "latex project public license"), ("lppl", "lppl"), ("1.0", "1.1", "1.2", "1.3"), True),
    ("ofl", ("open font license", "(sil )?open font license"), ("ofl", "(sil )?ofl"), ("1.0", "1.1"), False),
    ("boost", ("boost software license", "boost software license"), ("bsl", "boost bsl|bsl"), ("1.0",), False),
    ("zpl", ("zope public license", "zope public license"), ("zpl", "zpl"), ("1.1", "2.0", "2.1"), False),
    ("odbl", ("open database license", "open database license"), ("odbl", "odbl"), ("1.0",), False),
    ("cecill", ("cecill", "cecill (free software )?license( agreement)?"), ("cecill", "cecill( b| c)?"), ("1.0", "1.1", "2.0", "2.1"), False),
    ("python", ("python software foundation license", "python software foundation license"), ("psfl", "psfl"), ("2.0",), False),
    ("php", ("php license", "(the )?php license"), ("php license", "php license"), ("3.0", "3.01"), False),
    ("sspl", ("server side public license", "server side public license"), ("sspl", "sspl"), ("1.0",), False),
    ("busl", ("business source license", "business source license"), ("busl", "busl"), ("1.0", "1.1"), False),
    ("elastic", ("elastic license", "elastic license"), ("elastic license", "elastic license"), ("1.0", "2.0"), False),
    ("ecl", ("educational community license", "educational community license"), ("ecl", "ecl"), ("1.0", "2.0"), False),
    ("upl", ("universal permissive license", "universal permissive license"), ("upl", "upl"), ("1.0",), False),
    ("blueoak", ("blue oak model license", "blue oak model license"), ("blueoak", "blueoak"), ("1.0.0",), False),
]

# terms of the creative commons licenses: label, the short name's words, the long name's words
_CC = [
    ("by", "by", "attribution"),
    ("by-sa", "by sa", "attribution share ?alike"),
    ("by-nd", "by nd", "attribution no ?deriv(ative|s)( works)?"),
    ("by-nc", "by nc", "attribution non ?commercial"),
    ("by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(ative|s)( works)?"),
]
_CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# label, priority, keyword, pattern
_RULES = [
    ("cc0-1.0", 1, "cc0", "cc0( 1 0)?( universal)?"),
    ("cc0-1.0", 1, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("cc0-1.0", 1, "creative commons", "creative commons (cc0|zero)( 1 0)?( universal)?( public domain dedication)?"),
    ("public-domain", 2, "creativecommons", "creativecommons org publicdomain mark 1 0"),
    ("creative-commons", 2, "creative commons", "creative commons( public)? licen[cs]es?"),
    ("creative-commons", 3, "creativecommons", "creativecommons org( licen[cs]es)?"),
    ("mit", 1, "mit", "(the )?mit( x11| expat)? license"),
    ("mit", 1, "mit licence", "(the )?mit licence"),
    ("mit", 1, "licensed under", "(dual )?licensed under( the)? mit"),
    ("mit", 1, "opensource org", "opensource org licenses mit( license)?( php| html)?"),
    ("mit", 1, "expat license", "expat license"),
    ("mit", 1, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 2, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 2, "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("x11", 1, "x consortium", "x consortium shall not be used in advertising"),
    ("x11", 2, "x11 license", "x11 license"),
    ("isc", 1, "isc license", "(the )?isc license"),
    ("isc", 1, "for any purpose", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice"),
    ("0bsd", 1, "0bsd", "0bsd"),
    ("0bsd", 1, "zero clause bsd", "zero clause bsd( license)?"),
    ("0bsd", 2, "for any purpose", "permission to use copy modify and( or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd-2-clause", 1, "bsd", "bsd 2 clause( license)?"),
    ("bsd-2-clause", 1, "bsd", "(2|two) clause bsd( license)?"),
    ("bsd-2-clause", 1, "bsd", "(simplified|freebsd) bsd( license)?"),
    ("bsd-3-clause", 1, "bsd", "bsd 3 clause( license)?"),
    ("bsd-3-clause", 1, "bsd", "(3|three) clause bsd( license)?"),
    ("bsd-3-clause", 1, "bsd", "(new|modified|revised) bsd( license)?"),
    ("bsd-4-clause", 1, "bsd", "bsd 4 clause( license)?"),
    ("bsd-4-clause", 1, "bsd", "(4|four) clause bsd( license)?"),
    ("bsd-4-clause", 1, "bsd", "(original|old) bsd( license)?"),
    ("bsd", 2, "bsd", "(the )?bsd( style)? licen[cs]e"),
    ("bsd", 2, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 1, "endorse or promote", "neither the names? of .{1,200}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", 1, "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", 1, "apache", "apache org licenses license 2 0( txt| html)?"),
    ("apache-1.1", 1, "apache", "apache org licenses license 1 1( txt| html)?"),
    ("apache-2.0", 1, "except in compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", 2, "required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache", 2, "apache", "apache (software )?license"),
    ("gpl", 2, "free software", "this (program|file|package) is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 3, "free software", "this (program|file|package|software) is free software"),
    ("lgpl", 2, "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license"),
    ("gpl", 2, "gpl", "(gnu )?gpl( license)?"),
    ("lgpl", 2, "lgpl", "(gnu )?lgpl( license)?"),
    ("agpl", 2, "agpl", "(gnu )?agpl( license)?"),
    ("gpl", 2, "general public license", "gnu general public license"),
    ("lgpl", 2, "general public license", "(gnu )?(lesser|library) general public license"),
    ("agpl", 2, "affero general public license", "(gnu )?affero general public license"),
    ("gfdl", 2, "free documentation license", "(gnu )?free documentation license"),
    ("gpl-classpath", 1, "classpath exception", "(with( the)? )?classpath exception"),
    ("gcc-exception", 1, "runtime library exception", "gcc runtime library exception"),
    ("gpl-linking-exception", 1, "linking exception", "(with( a| the)? )?(static |dynamic )?linking exception"),
    ("bison-exception", 1, "bison", "(with( the)? )?bison exception"),
    ("font-exception", 1, "font exception", "(with( the)? )?font exception"),
    ("llvm-exception", 1, "llvm", "(with )?llvm exceptions?"),
    ("mpl", 2, "mozilla public license", "mozilla public license"),
    ("mpl-2.0", 1, "mozilla org", "mozilla org mpl 2 0"),
    ("mpl-1.1", 1, "mozilla org", "mozilla org mpl 1 1"),
    ("epl", 2, "eclipse public license", "eclipse public license"),
    ("cddl", 2, "common development and distribution license", "common development and distribution license"),
    ("eupl", 2, "european union public license", "european union public license"),
    ("artistic", 2, "artistic license", "(perl )?artistic license"),
    ("perl", 1, "same terms as perl", "under the same terms as perl( itself)?"),
    ("ofl", 2, "open font license", "(sil )?open font license"),
    ("boost", 2, "boost software license", "boost software license"),
    ("zlib", 1, "zlib", "(the )?zlib( libpng)? license"),
    ("zlib", 1, "held liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 2, "altered source versions", "altered source versions must be plainly marked as such"),
    ("libpng", 1, "libpng license", "(the )?libpng license"),
    ("unlicense", 1, "unlicense", "(the )?unlicense"),
    ("unlicense", 1, "unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", 1, "wtfpl", "wtfpl"),
    ("wtfpl", 1, "public license", "do what the f[a-z]{1,4} you want to public license"),
    ("beerware", 1, "beer ware license", "(the )?beer ware license"),
    ("postgresql", 1, "postgresql license", "postgresql license"),
    ("ncsa", 1, "ncsa", "(university of illinois )?ncsa( open source)? license"),
    ("openssl", 1, "openssl license", "openssl license"),
    ("ssleay", 1, "ssleay license", "(original )?ssleay license"),
    ("vim", 1, "vim license", "vim license"),
    ("ruby", 1, "ruby license", "ruby license"),
    ("curl", 1, "curl license", "curl license"),
    ("json", 1, "used for good not evil", "the software shall be used for good not evil"),
    ("ms-pl", 1, "microsoft public license", "microsoft public license( ms pl)?"),
    ("ms-rl", 1, "microsoft reciprocal license", "microsoft reciprocal license( ms rl)?"),
    ("ibm-pl", 1, "ibm public license", "ibm public license( version)?( 1 0)?"),
    ("npl", 1, "netscape public license", "netscape public license( version)?( 1 [01])?"),
    ("qpl", 1, "q public license", "q public license( version)?( 1 0)?"),
    ("w3c", 1, "w3c", "w3c( software)?( notice and)? license"),
    ("sleepycat", 1, "sleepycat license", "sleepycat license"),
    ("watcom", 1, "watcom public license", "sybase open watcom public license( 1 0)?"),
    ("intel", 2, "intel open source license", "intel open source license"),
    ("nasa", 1, "nasa open source agreement", "nasa open source agreement( 1 3)?"),
    ("odc-by", 1, "open data commons attribution", "open data commons attribution( license)?( v?1 0)?"),
    ("pddl", 1, "public domain dedication and license", "public domain dedication and license( v?1 0)?"),
    ("ogl-uk", 1, "open government", "open government licen[cs]e( v?[123] 0)?"),
    ("cdla-permissive", 1, "community data license agreement", "community data license agreement permissive( version)?( [12] 0)?"),
    ("cdla-sharing", 1, "community data license agreement", "community data license agreement sharing( version)?( 1 0)?"),
    ("openrail", 1, "openrail", "(bigscience |creativeml )?openrail( m)?( license)?"),
    ("commons-clause", 1, "commons clause", "commons clause( license condition)?( v?1 0)?"),
    ("public-domain", 2, "public domain", "(released|placed|dedicated|donated) (in|into|to) the public domain"),
    ("public-domain", 2, "public domain", "(is|are) in the public domain"),
    ("public-domain", 3, "public domain", "public domain (work|works|dedication|notice|mark)"),
    ("proprietary", 1, "proprietary", "(confidential and proprietary|proprietary and confidential)( information)?"),
    ("proprietary", 2, "no part of this", "no part of this (publication|book|document|work|file|report|website|site) may be (reproduced|copied|stored)"),
    ("proprietary", 2, "reproduced", "may not be reproduced( distributed)?( or)?( transmitted| distributed| copied)?( in any form)?( without( the)?( prior)?( written)? (permission|consent))?"),
    ("proprietary", 2, "strictly prohibited", "unauthori[sz]ed (copying|use|reproduction|distribution|duplication)( or distribution| or use| or duplication)?( of this [a-z]+)?( via any medium)? is strictly prohibited"),
    ("proprietary", 2, "written permission", "without( the)?( express| prior)?( express| prior)? written permission"),
    ("proprietary", 2, "redistribution is prohibited", "redistribution is prohibited"),
    ("non-commercial", 2, "use only", "for non ?commercial use only"),
    ("non-commercial", 2, "commercial purposes", "for non commercial purposes( only)?"),
    ("non-commercial", 2, "noncommercial purposes", "for noncommercial purposes( only)?"),
    ("non-commercial", 2, "commercial use", "(no commercial use|commercial use is (not permitted|prohibited|forbidden))( is permitted| is allowed)?"),
    ("research-only", 2, "use only", "for (academic|research)( and educational| and academic| or educational)?( research)? use only"),
    ("research-only", 2, "purposes only", "for (academic|research)( and educational| and academic| or educational)?( research)? purposes only"),
    ("evaluation-only", 2, "evaluation purposes", "for evaluation purposes only"),
    ("personal-use", 2, "personal use", "for (your )?personal use only"),
    ("eula", 2, "user license agreement", "end user license agreement"),
    ("as-is", 3, "provided as is", "(is |are )?provided as is( and)?( without( any)?( express or implied)?( warranty| warranties)( of any kind)?)?"),
    ("as-is", 3, "without warranty", "without warranty of any kind( express or implied)?"),
    ("as-is", 3, "without any warranty", "without any warranty"),
    ("copyright", 3, "copyright", "copyright (c |© |by )?©?[0-9]{4}( [0-9]{4})?"),
    ("copyright", 3, "copyright", "copyright (c|©)"),
    ("copyright", 3, "©", "© [0-9]{4}( [0-9]{4})?"),
    ("licensed", 3, "licensed under", "(this [a-z]+ is )?(dual )?licensed under( the)?( terms of)?( the)?"),
    ("licensed", 3, "released under", "released under( the)?( terms of)?( the)? [a-z0-9]+( [a-z0-9]+)? licen[cs]e"),
    ("licensed", 3, "distributed under", "distributed under( the)?( terms of)?( the)? [a-z0-9]+( [a-z0-9]+)? licen[cs]e"),
    ("licensed", 3, "license agreement", "(subject to|governed by|see) the license agreement"),
    ("licensed", 3, "license file", "(see|in) the license file"),
    ("licensed", 3, "under license", "(used|reproduced|distributed) under license( from)?"),
]

# identifiers in "SPDX-License-Identifier: ..."
_SPDX = "mit isc zlib unlicense wtfpl 0bsd bsd-2-clause bsd-3-clause bsd-4-clause apache-1.1 apache-2.0 mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 eupl-1.2 artistic-2.0 osl-3.0 afl-3.0 ofl-1.1 cc0-1.0 postgresql ncsa openssl python-2.0 sspl-1.0 busl-1.1 gpl-1.0-only gpl-1.0-or-later gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later".split()


def _version(text: str) -> str:
    """The words of a version: ``2.0`` is also written 2."""
    parts = text.split(".")
    return f"{parts[0]}( 0)?" if parts[1:] == ["0"] else " ".join(parts)


def _family(label: str, long: tuple[str, str], short: tuple[str, str], versions: tuple[str, ...], later: bool) -> Iterator[tuple[str, int, str, str]]:
    """A license with versions: by its name, by its short form, and with the version in front."""
    for version in versions:
        v, name, brief = _version(version), f"({long[1]})", f"({short[1]})"
        # a short form alone is no proof: its version is written in full or marked as one
        full, marked = " ".join(version.split(".")), _V.rstrip("?")
        forms = [(long[0], f"(the )?{name} {_V}{v}"), (long[0], f"(version |v |v){v} of the {name}"), (short[0], f"{brief} {_V}{full}"), (short[0], f"{brief} {marked}{v}")]
        if "|" not in short[1] and " " not in short[0]:
            forms += [(f"{short[0]}{mark}{v.split('(')[0].split()[0]}", f"{brief}{mark}{v}") for mark in ("v", "")]  # one word: gplv2
        for keyword, form in forms:
            yield f"{label}-{version}", 1, keyword, form + "( only)?"
            if later:
                yield f"{label}-{version}-or-later", 1, keyword, form + _LATER


def _commons() -> Iterator[tuple[str, int, str, str]]:
    for name, brief, long in _CC:
        forms = [("cc by", f"cc {brief}"), ("creative commons", f"creative commons {long}"), ("creativecommons", f"creativecommons org licenses {brief}")]
        for keyword, form in forms:
            yield f"cc-{name}", 2, keyword, form
            for version in _CC_VERSIONS:
                yield f"cc-{name}-{version}", 1, keyword, form + f"( license)? {_V}{' '.join(version.split('.'))}( international| unported| generic)?"


def rules() -> list[tuple[str, int, str, str, bool]]:
    """(label, priority, keyword, pattern, is it a base phrase) in their order."""
    own = [*(r for f in _FAMILIES for r in _family(*f)), *_commons(), *_RULES]
    own += [(i, 1, "spdx license identifier", "spdx license identifier " + " ".join(w for part in i.split("-") for w in part.split("."))) for i in _SPDX]
    base = {(label, pattern) for label, _, pattern in BASE}
    own = sorted((r for r in own if (r[0], r[3]) not in base), key=lambda r: r[1])
    return [(label, 2, keyword, pattern, True) for label, keyword, pattern in BASE] + [(*r, False) for r in own]


def compiled(pattern: str) -> str:
    """The expression over padded words: each word has a blank on either side, so words meet at two."""
    return f" ({pattern.replace(' ?', '(  )?').replace(' ', '  ').replace('(    )?', '(  )?')}) "


def words_of(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns and ``w``, the words of a text."""
    # one pass lowers A-Z and blanks what parts words
    bare = docs.select(*keep, F.trim(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER + _PARTS, _LOWER + " " * len(_PARTS))).alias("bare"))
    return bare.select(*keep, F.when(F.col("bare") == "", F.array().cast("array<string>")).otherwise(F.split("bare", " +")).alias("w"))


def count(words: Column) -> Column:
    """How many words a piece of the padded text has."""
    return ((F.octet_length(words) - F.octet_length(F.replace(words, F.lit(" "), F.lit("")))) / 2).cast("int")


_RULE = "array<struct<rule:int,label:string,priority:int,keyword:string,pattern:string,base:boolean>>"
_SPAN = ("start", "minus", "priority", "rule", "label", "base")


def anchor(keyword: str) -> str:
    return max(keyword.split(), key=len)


def detections(w: Column, words: Column) -> Column:
    """All matches of all rules whose keyword occurs, as sorted structs: start, minus (the negative end), priority, rule, label, base.

    ``w`` are the words; ``words`` are the same in one text, each between two blanks of its own."""
    table = [{"rule": i, "label": r[0], "priority": r[1], "keyword": r[2], "pattern": compiled(r[3]), "base": r[4]} for i, r in enumerate(rules())]
    keys = sorted({r["keyword"] for r in table})
    known = F.from_json(F.lit(json.dumps([{"keyword": k, "anchor": anchor(k), "phrase": f" {k.replace(' ', '  ')} "} for k in keys])), "array<struct<keyword:string,anchor:string,phrase:string>>")
    every, none = F.from_json(F.lit(json.dumps(table)), _RULE), F.array().cast(_RULE)
    anchors = F.array_intersect(w, F.array(*(F.lit(a) for a in sorted({anchor(k) for k in keys}))))
    held = lambda x: F.transform(F.filter(known, lambda k: F.array_contains(x, k["anchor"]) & F.contains(words, k["phrase"])), lambda k: k["keyword"])
    once = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  computes c once
    tried = once(anchors, lambda x: F.when(F.size(x) == 0, none).otherwise(once(held(x), lambda p: F.filter(every, lambda r: F.array_contains(p, r["keyword"])))))
    found = F.transform(tried, lambda r: F.struct(r.alias("r"), F.regexp_extract_all(words, r["pattern"], F.lit(0)).alias("found")))
    found = F.filter(found, lambda h: F.size(h["found"]) > 0)

    def spans(h: Column) -> Column:
        marked = F.split(F.regexp_replace(words, h["r"]["pattern"], F.lit(f" {_MARK}$1 ")), "  ")
        starts = F.array_compact(F.transform(marked, lambda w, i: F.when(F.contains(w, F.lit(_MARK)), i)))
        return F.zip_with(starts, h["found"], lambda s, f: F.struct(s.alias("start"), (-(s + count(f))).alias("minus"), *(h["r"][k].alias(k) for k in _SPAN[2:])))

    return F.sort_array(F.flatten(F.transform(found, spans)))


def unsuppressed(spans: Column) -> Column:
    """The spans that no span before them in the order, of the same or a stronger priority, contains."""
    levels = F.array(*(F.lit(p) for p in SCORES))
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(spans) / CHUNK).cast("int") - 1), lambda c: F.slice(spans, c * CHUNK + 1, F.lit(CHUNK)))
    far = lambda ch, p: F.coalesce(F.array_max(F.transform(F.filter(ch, lambda x: x["priority"] <= p), lambda x: -x["minus"])), F.lit(-1))
    nothing = F.array_repeat(F.lit(-1), len(SCORES))
    tops = F.transform(chunks, lambda ch: F.transform(levels, lambda p: far(ch, p)))
    before = F.aggregate(tops, F.array(nothing), lambda done, t: F.concat(done, F.array(F.zip_with(F.element_at(done, -1), t, lambda a, b: F.greatest(a, b)))))

    def left(pair: Column) -> Column:
        ch, reach = pair["ch"], pair["reach"]
        inside = lambda x, i: F.exists(F.slice(ch, F.lit(1), i), lambda e: (e["priority"] <= x["priority"]) & (e["minus"] <= x["minus"]))
        return F.filter(ch, lambda x, i: ~((F.get(reach, x["priority"] - 1) >= -x["minus"]) | inside(x, i)))

    pairs = F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda ch, b: F.struct(ch.alias("ch"), b.alias("reach")))
    return F.when(F.size(spans) == 0, spans).otherwise(F.flatten(F.transform(pairs, left)))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, found (all detections), kept (those left after suppression); a detection holds start, minus, priority, rule, label, base."""
    w = F.col("w")
    words = F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" "))
    found = words_of(docs, "text", "doc_id").select("doc_id", F.size(w).cast("long").alias("n_words"), detections(w, words).alias("found"))
    return found.select("doc_id", "n_words", "found", unsuppressed(F.col("found")).alias("kept"))


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of each document."""
    base = F.filter("found", lambda x: x["base"])
    told = scan(docs).select("doc_id", "n_words", base.alias("base"), "kept")
    names = lambda c: F.array_sort(F.array_distinct(c))
    strongest = F.array_min("kept.priority")
    score = F.coalesce(*(F.when(strongest == p, F.lit(s)) for p, s in SCORES.items()), F.lit(0.0))
    return told.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        F.array_join(names(F.col("base.label")), ",").alias("base_labels"), F.array_join(names(F.concat("base.label", "kept.label")), ",").alias("labels"), score.alias("score"))
