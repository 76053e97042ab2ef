"""License detection by ordered signature rules, native.

A text becomes its lower-cased words joined by single spaces. Keywords found in it, in one pass with an
expression that is their prefix tree, gate the rules: regular expressions over the words, each with a priority, a relevance and a label. All
matches are found; a detection whose interval lies within that of one of the same or a higher
priority goes. Three base phrases are counted apart from the rules and always keep their labels.

Null texts are empty: no words, no labels, score 0. All work is within the row, so very long
texts, repeated rows and empty tables need nothing special; ties between detections go by place, then length, priority and
label. Other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICE, NAME, TAG, MENTION = 4, 3, 2, 1
_RELEVANCE = {NOTICE: 1.0, NAME: 0.9, TAG: 0.8, MENTION: 0.4}
_V = r"(?:version |v ?)?"
_GRANT = r"(?:licensed|released|distributed|available|published|provided|covered) (?:under|by) (?:the )?(?:terms of the )?"

#: Families: label, keyword, name, versions as written in words.
_VERSIONED = [
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", "general public", r"(?:gnu )?(?:lesser|library) general public licen[sc]e", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[sc]e", ("1 0", "3 0", "1", "3")),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("apache", " apache ", r"apache(?: software)? licen[sc]e", ("1 0", "1 1", "2 0", "2")),
    ("mpl", "mozilla", r"mozilla public licen[sc]e", ("1 0", "1 1", "2 0")),
    ("epl", " eclipse public", r"eclipse public licen[sc]e", ("1 0", "2 0")),
    ("cpl", "common public", r"common public licen[sc]e", ("0 5", "1 0")),
    ("cddl", "common development", r"common development and distribution licen[sc]e", ("1 0", "1 1")),
    ("eupl", "european union", r"european union public licen[sc]e", ("1 0", "1 1", "1 2")),
    ("osl", "open software", r"open software licen[sc]e", ("1 0", "2 0", "2 1", "3 0")),
    ("afl", "academic free", r"academic free licen[sc]e", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("artistic", "artistic licen", r"artistic licen[sc]e", ("1 0", "2 0")),
    ("bsl", "boost", r"boost software licen[sc]e", ("1 0",)),
    ("ofl", "open font", r"(?:sil )?open font licen[sc]e", ("1 0", "1 1")),
    ("lppl", "latex", r"latex project public licen[sc]e", ("1 0", "1 1", "1 2", "1 3")),
    ("python", "python software", r"python software foundation licen[sc]e", ("2 0", "2")),
    ("apsl", "apple public", r"apple public source licen[sc]e", ("1 0", "1 1", "1 2", "2 0")),
    ("ms-pl", "microsoft", r"microsoft public licen[sc]e", ("1 0",)),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[sc]e", ("1 0",)),
    ("cecill", "cecill", r"cecill(?: free software)? licen[sc]e", ("1 0", "1 1", "2 0", "2 1")),
    ("odbl", "open database", r"open database licen[sc]e", ("1 0",)),
    ("odc-by", "open data commons", r"open data commons attribution licen[sc]e", ("1 0",)),
    ("cdla", "community data", r"community data licen[sc]e agreement", ("1 0", "2 0")),
    ("openrail", "licen", r"(?:creativeml )?open ?rail(?: m)? licen[sc]e", ("1 0",)),
    ("zpl", " zope ", r"zope public licen[sc]e", ("1 1", "2 0", "2 1")),
    ("w3c", " w3c software", r"w3c software(?: notice and)? licen[sc]e", ("1 0",)),
    ("sspl", "server side", r"server side public licen[sc]e", ("1",)),
    ("elastic", "elastic licen", r"elastic licen[sc]e", ("1", "2", "2 0")),
    ("busl", "business source", r"business source licen[sc]e", ("1 0", "1 1")),
    ("nasa", " nasa open", r"nasa open source agreement", ("1 3",)),
    ("qpl", " q public", r"q public licen[sc]e", ("1 0",)),
    ("ipl", " ibm public", r"ibm public licen[sc]e", ("1 0",)),
    ("upl", "universal permissive", r"universal permissive licen[sc]e", ("1 0",)),
    ("mulan", " mulan ", r"mulan (?:permissive|public) software licen[sc]e", ("1", "2")),
]
#: Short names: family, short name in words, versions. The version may be part of the word (gplv3).
_SHORT = [
    ("gpl", "gpl", ("1 0", "2 0", "3 0", "1", "2", "3")),
    ("lgpl", "lgpl", ("2 0", "2 1", "3 0", "2", "3")),
    ("agpl", "agpl", ("1 0", "3 0", "1", "3")),
    ("gfdl", "gfdl", ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("1 0", "1 1", "2 0", "2")),
    ("apache", "asl", ("1 1", "2 0")),
    ("mpl", "mpl", ("1 0", "1 1", "2 0", "2")),
    ("epl", "epl", ("1 0", "2 0", "1", "2")),
    ("cddl", "cddl", ("1 0", "1 1")),
    ("eupl", "eupl", ("1 0", "1 1", "1 2")),
    ("osl", "osl", ("2 0", "2 1", "3 0")),
    ("afl", "afl", ("2 0", "2 1", "3 0")),
    ("artistic", "artistic", ("1 0", "2 0")),
    ("bsl", "bsl", ("1 0",)),
    ("ofl", "ofl", ("1 0", "1 1")),
    ("lppl", "lppl", ("1 2", "1 3")),
    ("cecill", "cecill", ("1 0", "2 0", "2 1")),
    ("odbl", "odbl", ("1 0",)),
    ("sspl", "sspl", ("1 0", "1")),
    ("busl", "busl", ("1 0", "1 1")),
    ("zpl", "zpl", ("2 0", "2 1")),
]
#: Licenses without versions: label, keyword, name.
_PLAIN = [
    ("mit", " mit licen", r"(?:the )?mit licen[sc]e"),
    ("mit", " expat licen", r"expat licen[sc]e"),
    ("isc", " isc licen", r"isc licen[sc]e"),
    ("zlib", " zlib ", r"zlib(?: libpng)? licen[sc]e"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "what the fuck", r"do what the fuck you want to public licen[sc]e"),
    ("bsd-2-clause", "licen", r"(?:simplified bsd|freebsd|(?:2|two) clause bsd|bsd (?:2|two) clause) licen[sc]e"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|revised|modified) bsd|(?:3|three) clause bsd|bsd (?:3|three) clause) licen[sc]e"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|(?:4|four) clause bsd|bsd (?:4|four) clause) licen[sc]e"),
    ("bsd-0-clause", "bsd", r"(?:zero|0) clause bsd licen[sc]e"),
    ("bsd", " bsd licen", r"bsd licen[sc]e"),
    ("postgresql", " postgresql licen", r"postgresql licen[sc]e"),
    ("openssl", " openssl licen", r"openssl licen[sc]e"),
    ("php", " php licen", r"php licen[sc]e"),
    ("ruby", " ruby licen", r"ruby licen[sc]e"),
    ("vim", " vim licen", r"vim licen[sc]e"),
    ("beerware", "beerware", r"beerware licen[sc]e"),
    ("cc0", " cc0 ", r"cc0(?: 1 0)?(?: universal)?"),
    ("pddl", "public domain dedication", r"public domain dedication and licen[sc]e"),
    ("llama", " llama ", r"llama(?: 2| 3)? community licen[sc]e"),
    ("bsd-2-clause", "bsd", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|revised|modified) bsd)"),
    ("bsd-4-clause", "bsd", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)"),
    ("mit", " mit", r"(?:mit licensed|mit x11|mit style licen[sc]e)"),
    ("bsd", " bsd", r"(?:bsd licensed|bsd style licen[sc]e)"),
    ("isc", " isc licensed", r"isc licensed"),
    ("ms-pl", " ms pl", r"ms pl"),
    ("ms-rl", " ms rl", r"ms rl"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("curl", " curl licen", r"curl licen[sc]e"),
    ("libpng", " libpng licen", r"libpng licen[sc]e"),
    ("freetype", "freetype", r"freetype (?:project )?licen[sc]e"),
    ("ijg", "independent jpeg", r"independent jpeg group(?: s)? (?:licen[sc]e|software)"),
    ("unicode", " unicode licen", r"unicode licen[sc]e(?: agreement)?"),
    ("icu", " icu licen", r"icu licen[sc]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[sc]e"),
    ("perl", "perl", r"(?:same terms as perl|perl artistic licen[sc]e)"),
    ("blueoak", "blue oak", r"blue oak model licen[sc]e"),
    ("polyform", "polyform", r"polyform (?:noncommercial|small business|strict|shield|perimeter) licen[sc]e"),
    ("commons-clause", "commons clause", r"commons clause"),
    ("fair-source", "fair source", r"fair source licen[sc]e"),
    ("json", "json licen", r"(?:the )?json licen[sc]e"),
]
#: Creative Commons: label, short name in words, long name.
_CC = [
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
]
#: Notices and wordings: label, keyword, priority, expression.
_NOTICES = [
    ("mit", "permission is hereby granted", NOTICE, r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use", NOTICE, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", NOTICE, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", NOTICE, r"neither the name of (?:\S+ ){1,12}?nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials", NOTICE, r"all advertising materials mentioning features or use of this software"),
    ("zlib", "provided as is", NOTICE, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("apache-2.0", "apache", NOTICE, r"licensed under the apache licen[sc]e version 2 0 the license you may not use this file"),
    ("mpl-2.0", "mozilla", NOTICE, r"this source code form is subject to the terms of the mozilla public licen[sc]e v ?2 0"),
    ("gpl", "free software", NOTICE, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "free software", NOTICE, r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("gpl-2.0-or-later", "either version", NOTICE, r"either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0-or-later", "either version", NOTICE, r"either version 3 of the licen[sc]e or at your option any later version"),
    ("warranty-disclaimer", "merchantability", TAG, r"without (?:even )?(?:the implied )?warranty (?:\S+ ){0,6}?merchantability"),
    ("unlicense", "public domain", NOTICE, r"this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", NAME, r"(?:released|placed|dedicated|donated) (?:in|into|to) the public domain"),
    ("public-domain", "public domain", MENTION, r"public domain"),
    ("bsl-1.0", "boost", NOTICE, r"distributed under the boost software licen[sc]e version 1 0"),
    ("ofl-1.1", "open font", NOTICE, r"this font software is licensed under the sil open font licen[sc]e version 1 1"),
    ("wtfpl", "everyone is permitted", NOTICE, r"everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document and changing it is allowed"),
    ("beerware", " beer ", NOTICE, r"you can buy me a beer in return"),
    ("reserved", "rights reserved", NAME, r"all rights reserved"),
    ("reserved", "rights reserved", MENTION, r"(?:some|no) rights reserved"),
    ("proprietary", "proprietary", NAME, r"proprietary and confidential"),
    ("proprietary", "confidential", MENTION, r"confidential information of"),
    ("proprietary", "unauthorized copying", NOTICE, r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("copyright", "copyright", TAG, r"copyright (?:c )?(?:19|20)\d\d(?: (?:19|20)\d\d)*"),
    ("copyright", "copyright", MENTION, r"copyright notice"),
    ("permission-required", "permission", TAG, r"may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior )?(?:written )?permission"),
    ("personal-use", "personal use", TAG, r"for personal use only"),
    ("non-commercial", "commercial use", TAG, r"(?:not for|no) commercial use"),
    ("education", "educational", TAG, r"for educational (?:use|purposes) only"),
    ("license-mention", " under ", MENTION, r"(?:licensed|released|distributed) under"),
    ("license-mention", "licen", MENTION, r"see (?:the )?licen[sc]e(?: file)?"),
    ("license-mention", "licen", MENTION, r"end user licen[sc]e agreement"),
    ("license-mention", "licen", MENTION, r"terms of (?:the|this) licen[sc]e"),
    ("license-mention", "open source", MENTION, r"open source licen[sc]e"),
    ("terms", " terms ", MENTION, r"terms (?:of (?:use|service)|and conditions)"),
    ("apache-2.0", "apache org licen", TAG, r"apache org licen[sc]es licen[sc]e 2 0"),
    ("mpl-2.0", "mozilla org mpl", TAG, r"mozilla org mpl 2 0"),
    ("gpl", "gnu org licen", MENTION, r"gnu org licen[sc]es(?: gpl(?: [23] 0)?)?"),
    ("lgpl", "lesser", NOTICE, r"you should have received a copy of the gnu lesser general public licen[sc]e"),
    ("gpl", "general public", NOTICE, r"you should have received a copy of the gnu general public licen[sc]e"),
    ("agpl", "affero", NOTICE, r"under the terms of the gnu affero general public licen[sc]e"),
    ("mit", "above copyright notice and this permission", NOTICE, r"the above copyright notice and this permission notice (?:\S+ ){0,4}?shall be included in all copies"),
    ("bsd", "redistributions of source code", NOTICE, r"redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions in binary form", NOTICE, r"redistributions in binary form must reproduce the above copyright notice"),
    ("apache-2.0", "unless required by applicable law", NOTICE, r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis"),
    ("zlib", "altered source versions", NOTICE, r"altered source versions must be plainly marked as such"),
    ("bsl-1.0", "machine executable object code", NOTICE, r"solely in the form of machine executable object code generated by a source language processor"),
    ("cc0", "waived all copyright", NOTICE, r"waived all copyright and related or neighboring rights"),
    ("cc", "creative commons", NAME, r"licensed under a creative commons"),
    ("unlicense", "anyone is free", NOTICE, r"anyone is free to copy modify publish use compile sell or distribute this software"),
    ("gpl-linking-exception", "exception", TAG, r"as a special exception (?:\S+ ){0,30}?link"),
    ("classpath-exception", "classpath", TAG, r"classpath exception"),
    ("dual-license", " licensed", TAG, r"(?:dual|tri|multi) licensed"),
    ("no-derivatives", "derivative", TAG, r"no derivative works"),
    ("attribution", "attribution", MENTION, r"attribution (?:is )?required"),
    ("royalty-free", "royalty", TAG, r"(?:perpetual )?(?:worldwide )?(?:non exclusive )?(?:no charge )?royalty free"),
    ("proprietary", "internal use", NAME, r"for internal use only"),
    ("proprietary", "trade secret", TAG, r"trade secrets? of"),
    ("reserved", "reserves all rights", NAME, r"reserves all rights"),
    ("copyright", "copyright", TAG, r"copyrighted (?:material|work|by)"),
    ("copyright", "copyright", TAG, r"protected by copyright(?: law| laws)?"),
    ("evaluation", "evaluation", TAG, r"for evaluation purposes only"),
    ("research-use", "research", TAG, r"for (?:non commercial )?research (?:purposes|use) only"),
]


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, expression over words) in order. A keyword begins a word of whatever its rule matches."""
    return [(label, keyword.lstrip(), p, e) for label, keyword, p, e in _rules()]


def tree(keywords: Iterable[str]) -> str:
    """An expression for the longest of some keywords, as their prefix tree."""
    by: dict[str, list[str]] = {}
    for k in sorted(set(keywords)):
        by.setdefault(k[:1], []).append(k[1:])
    end = by.pop("", None) is not None
    parts = [re.escape(c) + tree(rest) for c, rest in by.items()]
    if not parts:
        return ""
    return f"(?:{'|'.join(parts)}){'?' * end}" if end or len(parts) > 1 else parts[0]


def _rules() -> list[tuple[str, str, int, str]]:
    out: list[tuple[str, str, int, str]] = list(_NOTICES)
    for label, keyword, name, versions in _VERSIONED:
        for v in versions:
            tag = f"{label}-{v.replace(' ', '.')}"
            out.append((tag, keyword, NAME, f"{name} {_V}{v}"))
            out.append((f"{tag}-or-later", keyword, NOTICE, f"{name} {_V}{v} or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"))
        out.append((label, keyword, TAG, f"{_GRANT}{name}"))
        out.append((label, keyword, MENTION, name))
    for family, short, versions in _SHORT:
        for v in versions:
            tag = f"{family}-{v.replace(' ', '.')}"
            out.append((tag, f" {short}", NAME, f"(?:gnu )?{short} ?v? ?{v}(?: only)?"))
            out.append((f"{tag}-or-later", f" {short}", NOTICE, f"(?:gnu )?{short} ?v? ?{v} or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"))
        if short not in ("apache", "artistic", "asl"):
            out.append((family, f" {short}", MENTION, f"(?:gnu )?{short}"))
    for label, keyword, name in _PLAIN:
        out.append((label, keyword, NAME, f"{_GRANT}{name}"))
        out.append((label, keyword, MENTION if name.endswith("unlicense") else TAG, name))
    for label, short, long in _CC:
        for v in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            out.append((f"{label}-{v.replace(' ', '.')}", "cc by", NAME, f"cc {short} {v}(?: international| unported| generic)?"))
        out.append((label, "cc by", TAG, f"cc {short}"))
        out.append((label, "creative commons", NAME, f"creative commons {long}(?: \\d \\d)?(?: international| unported| generic)?(?: licen[sc]e)?"))
        out.append((label, "creativecommons", TAG, f"creativecommons org licen[sc]es {short} \\d \\d"))
    out.append(("cc", "creative commons", MENTION, "creative commons"))
    out.append(("cc0", "creativecommons", TAG, "creativecommons org publicdomain zero 1 0"))
    for x in ("mit", "isc", "zlib", "unlicense", "apache 2 0", "mpl 2 0", "bsd 2 clause", "bsd 3 clause", "gpl 2 0 only", "gpl 2 0 or later", "gpl 3 0 only", "gpl 3 0 or later", "lgpl 2 1 only", "lgpl 2 1 or later", "lgpl 3 0 only", "lgpl 3 0 or later", "agpl 3 0 only", "agpl 3 0 or later", "epl 2 0", "cc0 1 0", "cc by 4 0", "cc by sa 4 0", "bsl 1 0", "artistic 2 0", "ofl 1 1", "0bsd"):
        label = x
        for v in ("1 0", "1 1", "2 0", "2 1", "3 0", "4 0"):
            label = label.replace(v, v.replace(" ", "."))
        out.append((label.replace(" ", "-"), "spdx", NOTICE, f"spdx license identifier {x}"))
    return out


def words_of(text: Column) -> Column:
    """Lower-cased words, each with a space before it, and one at the end; a single space if there are none."""
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")))


def _n(text: Column) -> Column:
    """Words in a part that has a space before each word."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _spans(norm: Column, rule: Column) -> Column:
    """array<struct<start, end, priority, label, relevance>> of one rule's matches; end is the last word's number."""
    rest, hits = F.split(norm, rule["regex"], -1), F.regexp_extract_all(norm, rule["regex"], F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,priority:int,label:string,relevance:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + _n(x["rest"])
        end = begin + _n(x["hit"])
        found = F.struct(begin.alias("start"), (end - 1).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"), rule["relevance"].alias("relevance"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(found)).alias("out"))

    pairs = F.transform(hits, lambda hit, k: F.struct(rest[k].alias("rest"), hit.alias("hit")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _kept(spans: Column) -> Column:
    """Drop each span that lies in another of the same or a higher priority; equal ones but the first go too."""
    order = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], (-s["end"]).alias("less"), (-s["priority"]).alias("low"), s["label"], s["relevance"]))), lambda s: F.struct(s["start"].alias("start"), (-s["less"]).alias("end"), (-s["low"]).alias("priority"), s["label"].alias("label"), s["relevance"].alias("relevance")))
    kind = "array<struct<start:int,end:int,priority:int,label:string,relevance:double>>"
    zero = F.struct(F.array(*[F.lit(-1)] * 5).alias("reach"), F.array().cast(kind).alias("out"))

    def step(acc: Column, s: Column) -> Column:
        hidden = F.array_max(F.slice(acc["reach"], s["priority"] + 1, 5 - s["priority"])) >= s["end"]
        reach = F.transform(acc["reach"], lambda r, k: F.when(k == s["priority"], F.greatest(r, s["end"])).otherwise(r))
        return F.when(hidden, acc).otherwise(F.struct(reach.alias("reach"), F.concat(acc["out"], F.array(s)).alias("out")))

    return F.aggregate(order, zero, step, lambda acc: acc["out"])


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, norm, detections: array of the spans that stay, of every row of ``docs`` (doc_id, text)."""
    table = rules()
    literal = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(f" (?:{e})(?= )").alias("regex"), F.lit(p).alias("priority"), F.lit(label).alias("label"), F.lit(_RELEVANCE[p]).alias("relevance")) for label, k, p, e in table])
    keywords = list(dict.fromkeys(r[1] for r in table))
    row = docs.select("doc_id", words_of(F.col("text")).alias("norm"))
    # the longest keyword at each word; those that it begins with are there too
    longest = F.array_distinct(F.regexp_extract_all("norm", F.lit(f" (?=({tree(keywords)}))"), F.lit(1)))
    row = row.withColumn("longest", longest)
    found = F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.exists("longest", lambda x: F.startswith(x, k)))
    row = row.withColumn("found", F.when(F.size("longest") > 0, found).otherwise(F.array().cast("array<string>")))
    spans = F.flatten(F.transform(F.filter(literal, lambda r: F.array_contains("found", r["keyword"])), lambda r: _spans(F.col("norm"), r)))
    empty = F.array().cast("array<struct<start:int,end:int,priority:int,label:string,relevance:double>>")
    return row.select("doc_id", "norm", F.when(F.size("found") > 0, _kept(spans)).otherwise(empty).alias("detections"))


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score from the output of ``scan``."""
    row = scanned.withColumn("n_words", (_n(F.col("norm")) - 1).cast("long"))
    found = []
    for phrase, label in BASE.items():
        head, tail = phrase.split(" ", 1)
        parts = F.split("norm", f" {head}(?= {tail} )", -1)
        last = F.col("n_words") + 1 - _n(F.element_at(parts, -1)) - 1
        one = F.struct((F.size(parts) - 1).cast("long").alias("n"), _n(parts[0]).cast("long").alias("first"), last.cast("long").alias("last"), F.lit(label).alias("label"))
        found.append(F.when(F.contains(F.col("norm"), F.lit(f" {phrase} ")), F.array(one)).otherwise(F.array().cast("array<struct<n:bigint,first:bigint,last:bigint,label:string>>")))
    row = row.withColumn("base", F.concat(*found))
    own = F.transform("detections", lambda s: s["label"])
    return row.select(
        "doc_id",
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda a, b: a + b["n"]).alias("n_base"),
        F.array_min(F.transform("base", lambda b: b["first"])).alias("first_word"),
        F.array_max(F.transform("base", lambda b: b["last"])).alias("last_word"),
        F.array_join(F.array_sort(F.transform("base", lambda b: b["label"])), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.transform("base", lambda b: b["label"]), own))), ",").alias("labels"),
        F.coalesce(F.greatest(F.array_max(F.transform("detections", lambda s: s["relevance"])), F.when(F.size("base") > 0, F.lit(_RELEVANCE[NAME]))), F.lit(0.0)).alias("score"),
    )
