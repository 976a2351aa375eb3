"""License scans by ordered signature rules, with DataFrame functions only.

A gate made of the rules' keywords looks at every text; texts that pass are brought to plain words,
and each rule whose own keyword occurs there is matched.  Keywords are words that every match of their
rule has, so neither step hides a match.  A detection is suppressed when it lies inside a detection of
the same or a better priority.  All of it stays in the row: no shuffle, and no row meets another.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, functions as F

from opsweave.llm.common import LOWER, UPPER

#: Runs of ASCII letters, digits and anything beyond ASCII are words.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BASE_WEIGHT = 0.6

# Families of licenses as (label, name in words as a regex, short identifier in words, versions).
FAMILIES = (
    ("0bsd", "zero clause bsd", "0bsd", ()),
    ("afl", "academic free", "afl", ("1 1", "1 2", "2 0", "2 1", "3 0")),
    ("agpl", "(?:gnu )?affero general public", "agpl", ("1 0", "3 0", "3")),
    ("apache", "apache(?: software)?", "apache", ("1 0", "1 1", "2 0", "2")),
    ("apple", "apple public source", "apsl", ("1 0", "1 1", "1 2", "2 0")),
    ("artistic", "(?:clarified )?artistic", "artistic", ("1 0", "2 0")),
    ("beerware", "beer ?ware", "beerware", ()),
    ("blueoak", "blue oak model", "blueoak", ("1 0 0",)),
    ("boost", "boost software", "bsl", ("1 0",)),
    ("bsd", "(?:modified |simplified |new |revised |original )?bsd", "bsd", ()),
    ("bsd-2", "(?:bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause", ()),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause", ()),
    ("bsd-4", "(?:bsd 4 clause|4 clause bsd|four clause bsd)", "bsd 4 clause", ()),
    ("busl", "business source", "busl", ("1 1",)),
    ("cc-by", "(?:cc by|creative commons attribution)", "cc by", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)", "cc by nc", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:s|atives))", "cc by nc nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)", "cc by nc sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv(?:s|atives))", "cc by nd", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)", "cc by sa", ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", "(?:cc0|creative commons zero)", "cc0", ("1 0",)),
    ("cddl", "common development and distribution", "cddl", ("1 0", "1 1")),
    ("cecill", "cecill", "cecill", ("1 0", "2 0", "2 1")),
    ("cpl", "common public", "cpl", ("1 0",)),
    ("ecl", "educational community", "ecl", ("1 0", "2 0")),
    ("elastic", "elastic", "elastic", ("2 0",)),
    ("epl", "eclipse public", "epl", ("1 0", "2 0")),
    ("eupl", "european union public", "eupl", ("1 0", "1 1", "1 2")),
    ("fsl", "functional source", "fsl", ("1 0", "1 1")),
    ("gfdl", "(?:gnu )?free documentation", "gfdl", ("1 1", "1 2", "1 3")),
    ("gpl", "(?:gnu )?general public", "gpl", ("1 0", "1", "2 0", "2", "3 0", "3")),
    ("hpnd", "historical permission notice and disclaimer", "hpnd", ()),
    ("ijg", "independent jpeg group", "ijg", ()),
    ("intel", "intel open source", "intel", ()),
    ("ipl", "ibm public", "ipl", ("1 0",)),
    ("isc", "isc", "isc", ()),
    ("json", "json", "json", ()),
    ("lgpl", "(?:gnu )?(?:lesser|library) general public", "lgpl", ("2 0", "2", "2 1", "3 0", "3")),
    ("llama", "llama (?:[23] )?community", "llama", ("2", "3")),
    ("lpl", "lucent public", "lpl", ("1 0", "1 02")),
    ("lppl", "latex project public", "lppl", ("1 0", "1 1", "1 2", "1 3a", "1 3c")),
    ("mit", "(?:the )?mit(?: x11| expat)?", "mit", ()),
    ("mit-0", "mit no attribution", "mit 0", ()),
    ("mpl", "mozilla public", "mpl", ("1 0", "1 1", "2 0", "2")),
    ("ms-pl", "microsoft public", "ms pl", ()),
    ("ms-rl", "microsoft reciprocal", "ms rl", ()),
    ("mulan", "mulan p(?:ermissive s|s)l", "mulanpsl", ("1 0", "2 0")),
    ("ncsa", "(?:university of illinois )?ncsa(?: open source)?", "ncsa", ()),
    ("odbl", "open (?:data commons open )?database", "odbl", ("1 0",)),
    ("ofl", "(?:sil )?open font", "ofl", ("1 0", "1 1")),
    ("openrail", "(?:creativeml )?open ?rail(?: m)?", "openrail", ()),
    ("openssl", "openssl", "openssl", ()),
    ("osl", "open software", "osl", ("1 0", "1 1", "2 0", "2 1", "3 0")),
    ("pddl", "public domain dedication and", "pddl", ("1 0",)),
    ("php", "php", "php", ("3 0", "3 01")),
    ("polyform", "polyform (?:noncommercial|shield|small business|strict|perimeter)", "polyform", ("1 0 0",)),
    ("postgresql", "postgresql", "postgresql", ()),
    ("psf", "python software foundation", "psf", ("2 0", "2")),
    ("qpl", "q public", "qpl", ("1 0",)),
    ("rpl", "reciprocal public", "rpl", ("1 1", "1 5")),
    ("ruby", "ruby", "ruby", ()),
    ("sleepycat", "sleepycat", "sleepycat", ()),
    ("sspl", "server side public", "sspl", ("1 0", "1")),
    ("unicode", "unicode", "unicode", ()),
    ("unlicense", "(?:the )?unlicense", "unlicense", ()),
    ("upl", "universal permissive", "upl", ("1 0",)),
    ("vim", "vim", "vim", ()),
    ("w3c", "w3c(?: software)?(?: notice and)?", "w3c", ()),
    ("wtfpl", "do what the fuck you want to public", "wtfpl", ("1", "2")),
    ("x11", "x11", "x11", ()),
    ("zlib", "zlib(?: libpng)?", "zlib", ()),
    ("zpl", "zope public", "zpl", ("1 1", "2 0", "2 1")),
)
# Sentences of license texts and headers: (label, regex in words).  Groups stand between whole words.
TEXTS = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("ncsa", "files the software to deal with the software without restriction"),
    ("x11", r"except as contained in this notice the name of (?:\S+ ){1,8}shall not be used in advertising"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("upl", "to any person obtaining a copy of this software associated documentation and or data"),
    ("unicode", "any person obtaining a copy of (?:the unicode )?data files and any associated documentation"),
    ("isc", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("hpnd", "distribute (?:and sell )?this software and its documentation for any purpose (?:and )?(?:is hereby granted without fee|without fee is hereby granted)"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties"),
    ("bsd-3", r"neither the name of (?:\S+ ){1,12}nor the names of (?:its|their|any) contributors may be used to endorse or promote products derived from this software"),
    ("bsd-4", "all advertising materials mentioning features or use of this software must display the following (?:acknowledgement|acknowledgment)"),
    ("apache-1.1", "products derived from this software may not be called apache nor may apache appear in their name"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-1", "the gnu general public license as published by the free software foundation (?:inc )?(?:either )?version 1"),
    ("gpl-2", "the gnu general public license as published by the free software foundation (?:inc )?(?:either )?version 2"),
    ("gpl-3", "the gnu general public license as published by the free software foundation (?:inc )?(?:either )?version 3"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl", "you should have received a copy of the gnu general public license along with this program"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1", "the gnu (?:lesser|library) general public license as published by the free software foundation (?:inc )?(?:either )?version 2 1"),
    ("lgpl-2", "the gnu (?:lesser|library) general public license as published by the free software foundation (?:inc )?(?:either )?version 2"),
    ("lgpl-3", "the gnu (?:lesser|library) general public license as published by the free software foundation (?:inc )?(?:either )?version 3"),
    ("lgpl-3", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by"),
    ("agpl-3", "the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gnu", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("epl-1.0", "made available under the terms of the eclipse public license v1 0 which accompanies this distribution"),
    ("epl-2.0", "made available under the terms of the eclipse public license (?:v )?2 0"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc0", r"to the extent possible under law (?:\S+ ){1,12}waived all copyright and related or neighboring rights"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc-by-sa", "if you remix transform or build upon the material you must distribute your contributions under the same license as the original"),
    ("cc-by-nd", "if you remix transform or build upon the material you may not distribute the modified material"),
    ("cc-by-nc", "you may not use the material for commercial purposes"),
    ("artistic-1.0", "the copyright holder maintains some semblance of artistic control over the development of the package"),
    ("artistic-2.0", "this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("psf", "psf hereby grants licensee a nonexclusive royalty free world wide license"),
    ("php", "products derived from this software may not be called php nor may php appear in their name"),
    ("ofl", "the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ofl", "the fonts and derivatives however cannot be released under any other type of license"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("json", "the software shall be used for good not evil"),
    ("vim", "there are no restrictions on distributing unmodified copies of vim"),
    ("lppl", "this work may be distributed and or modified under the conditions of the latex project public license"),
    ("cecill", "this agreement is a free software license agreement that is the result of discussions between its authors"),
    ("w3c", "this work is being provided by the copyright holders under the following license"),
    ("ms-pl", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("mulan", "each contributor hereby grants to you a perpetual worldwide royalty free non exclusive irrevocable copyright license"),
    ("sspl", "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl", "the right to copy modify create derivative works redistribute and make non production use of the licensed work"),
    ("elastic-2.0", "you may not provide the software to third parties as a hosted or managed service"),
    ("polyform", "the licensor grants you a copyright license for the software to do everything you might do with the software that would otherwise infringe"),
    ("blueoak", "each contributor licenses you to do everything with this software that would otherwise infringe"),
    ("llama", "the terms and conditions for use reproduction distribution and modification of the llama materials"),
    ("openrail", "use based restrictions as referenced in"),
    ("ijg", "this software is based in part on the work of the independent jpeg group"),
    ("sleepycat", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
)
# Notices that name no license: (label, regex in words, keyword).
NOTICES = (
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
    ("copyright", r"copyright (?:c |by )?(?:19|20)\d\d", "copyright"),
    ("public-domain", "(?:released|placed|dedicated|given) (?:in ?to|to|in) the public domain", "public domain"),
    ("public-domain", "this (?:work|file|code|text|document|software) is in the public domain", "public domain"),
    ("proprietary", "(?:proprietary and confidential|confidential and proprietary)", "proprietary and confidential|confidential and proprietary"),
    ("proprietary", "(?:unauthori[sz]ed (?:copying|use|distribution)|may not be (?:copied|reproduced|redistributed))", "unauthori|may not be "),
)


@dataclass(frozen=True)
class Rule:
    """A signature: smaller ``priority`` wins.  Each match has one of the ``keyword``'s alternatives, and
    one of the ``gate``'s ('': the keyword's) at the start of a word: both must be there before
    ``pattern`` is tried."""

    label: str
    pattern: str
    keyword: str
    priority: int
    weight: float
    gate: str = ""


def _texts(name: str) -> list[str]:
    """Every text that a name's pattern matches; it has groups, sets and '?' only."""
    found = re.search(r"\(\?:([^()]*)\)(\??)|\[([^]]*)\](\??)|([^()])\?", name)
    if not found:
        return [name]
    group, maybe, letters, maybe_one, letter = found.groups()
    choices = [letter, ""] if letter else (list(letters) if group is None else group.split("|")) + [""] * bool(maybe or maybe_one)
    return [text for c in choices for text in _texts(name[: found.start()] + c + name[found.end() :])]


def _keywords(*names: str) -> str:
    """The texts of the names, parted by '|', without those that hold another from the start of a word."""
    texts = dict.fromkeys(text for name in names for text in _texts(name))
    return "|".join(t for t in texts if not any(o != t and f" {o}" in f" {t}" for o in texts))


def _literal(pattern: str) -> str:
    """The longest run of words outside of a pattern's groups."""
    return max(re.split(r"\(\?:[^()]*\)(?:\?|\{[^}]*\})?", pattern), key=len).strip()


def rules() -> list[Rule]:
    """All signatures in order: identifiers, license texts, names with version, grants, bare names, notices."""
    found = []
    verb = r"(?:licen[sc]ed|released|distributed|published|provided|available|issued|offered|covered|shared) (?:only )?(?:under|by|with) "
    verbs = _keywords(verb)
    grant = verb + r"(?:the )?(?:terms (?:of|and conditions of) )?(?:the )?(?:an? )?"
    for label, name, short, versions in FAMILIES:
        either = f"(?:{name}|{short})"
        key = _keywords(name, short)
        ending = "(?: public)?(?: licen[sc]e)?"
        found.append(Rule(label, f"spdx licen[sc]e identifier {short}(?: [0-9]+)*(?: only| or later)?", _keywords(short), 1, 1.0, "spdx licen"))
        found.append(Rule(label, f"{grant}{either}{ending}", key, 3, 0.9, verbs))
        found.append(Rule(label, f"{name} licen[sc]e", _keywords(name), 4, 0.7, "licen"))
        for version in versions:
            number = f"{version}(?: or (?:any )?later(?: version)?)?"
            found.append(Rule(f"{label}-{version.replace(' ', '.')}", f"{either}{ending} (?:version |v |v)?{number}", key, 2, 0.95))
    for label, pattern in TEXTS:
        found.append(Rule(label, pattern, _literal(pattern), 1, 0.98))
    for label, pattern, key in NOTICES:
        found.append(Rule(label, pattern, key, 5, 0.5))
    return found


PRIORITIES = 5


def _trie(texts: list[str]) -> str:
    """A regex for the start of any of the texts, which shares their beginnings; spaces match any gap."""
    root: dict = {}
    for text in texts:
        node = root
        for letter in text:
            node = node.setdefault(letter, {})
        node[""] = {}

    def write(node: dict) -> str:
        if "" in node:
            return ""  # a text ends here: longer ones add nothing
        parts = [(BETWEEN if letter == " " else re.escape(letter)) + write(after) for letter, after in node.items()]
        return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"

    return write(root)


def _passes_gate(text: Column, signatures: list[Rule]) -> Column:
    """Whether some rule's gate stands at the start of a word, with anything between words."""
    keys = [phrase for phrase, _ in PHRASES] + [key.rstrip() for r in signatures for key in (r.gate or r.keyword).split("|")]
    return F.rlike(F.lower(text), F.lit(f"(?<!{WORD[:-1]}){_trie(keys)}"))


def _count_words(text: Column) -> Column:
    """How many words there are: parts between runs of anything else, but for empty ends."""

    def inner(parts: Column) -> Column:
        first = (F.get(parts, F.lit(0)) == "").cast("long")
        last = ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("long")
        return F.size(parts).cast("long") - first - last

    return _let(F.split(text, BETWEEN), inner)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _phrase_places(words: Column, phrase: str) -> Column:
    """Starts of the places where the phrase's words stand consecutively."""
    parts = phrase.split()
    last = F.size(words) - F.lit(len(parts))
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))

    def here(i: Column) -> Column:
        match = F.get(words, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            match = match & (F.get(words, i + k) == part)
        return match

    return F.filter(starts, here)


_MARK = "\x01"


def _rule_places(plain: Column, pattern: Column) -> Column:
    """(start, end) in words of each match in plain text: matches are marked, then counted by word."""
    marked = F.split(F.regexp_replace(plain, pattern, F.lit(f"{_MARK}$0")), " ")
    starts = F.filter(F.transform(marked, lambda w, i: F.when(w.startswith(_MARK), i - 1).otherwise(F.lit(-1))), lambda i: i >= 0)
    sizes = F.transform(F.regexp_extract_all(plain, pattern, F.lit(0)), lambda m: F.size(F.split(m, " ")))
    return F.zip_with(starts, sizes, lambda s, n: F.struct(s.alias("start"), (s + n).alias("end")))


def _detections(plain: Column, table: Column) -> Column:
    """(start, -end, priority, label, weight) of all rules' matches, in this order; ``table`` holds the
    rules by gate."""

    def some(keys: Column) -> Column:
        return F.exists(keys, lambda k: F.contains(plain, k))

    near = F.flatten(F.transform(F.filter(table, lambda g: some(g["gate"])), lambda g: g["rules"]))
    hits = F.filter(near, lambda r: some(r["keyword"]) & F.rlike(plain, r["pattern"]))
    places = F.transform(
        hits,
        lambda r: F.transform(
            _rule_places(plain, r["pattern"]),
            lambda p: F.struct(p["start"].alias("start"), (-p["end"]).alias("neg_end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight")),
        ),
    )
    return F.array_sort(F.flatten(places))


def _unsuppressed(detections: Column) -> Column:
    """Labels and greatest weight of detections that lie in no earlier one of their priority or better.

    Detections come by start, the longest first, so one pass with the furthest end for each priority
    finds containment.
    """
    names = [f"far_{k}" for k in range(1, PRIORITIES + 1)]
    zero = F.struct(*[F.lit(-1).alias(n) for n in names], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("weight"))

    def step(state: Column, found: Column) -> Column:
        end = -found["neg_end"]
        # far_k is the furthest end among priorities up to k.
        far = F.lit(-1)
        for k, name in enumerate(names, 1):
            far = F.when(found["priority"] == k, state[name]).otherwise(far)
        alone = far < end
        return F.struct(
            *[F.when(found["priority"] <= k, F.greatest(state[n], end)).otherwise(state[n]).alias(n) for k, n in enumerate(names, 1)],
            F.when(alone, F.array_union(state["labels"], F.array(found["label"]))).otherwise(state["labels"]).alias("labels"),
            F.when(alone, F.greatest(state["weight"], found["weight"])).otherwise(state["weight"]).alias("weight"),
        )

    return F.aggregate(detections, zero, step)


def _scan(text: Column, table: Column) -> Column:
    lowered = F.translate(text, UPPER, LOWER)

    def of_words(words: Column) -> Column:
        plain = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
        base = [_phrase_places(words, phrase) for phrase, _ in PHRASES]
        return _let(
            F.struct(F.struct(*[b.alias(label) for b, (_, label) in zip(base, PHRASES)]).alias("base"), _let(plain, lambda p: _unsuppressed(_detections(p, table))).alias("found")),
            of_places,
        )

    def of_places(x: Column) -> Column:
        base = x["base"]
        starts = F.concat(*[base[label] for _, label in PHRASES])
        base_labels = F.filter(F.array(*[F.when(F.size(base[label]) > 0, F.lit(label)) for _, label in PHRASES]), lambda v: v.isNotNull())
        labels = F.array_sort(F.array_union(base_labels, x["found"]["labels"]))
        return F.struct(
            F.size(starts).cast("long").alias("n_base"),
            F.array_min(starts).cast("long").alias("first_word"),
            F.array_max(starts).cast("long").alias("last_word"),
            F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
            F.array_join(labels, ",").alias("labels"),
            F.greatest(x["found"]["weight"], F.when(F.size(starts) > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0))).alias("score"),
        )

    return _let(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), of_words)


def scan(df: DataFrame, id_col: str = "doc_id", text: str = "text", signatures: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    A-Z is lower-cased and words are runs of ASCII letters, digits and characters beyond ASCII.  A
    null text counts as empty: no words, no labels, score 0.  Repeated rows give repeated results; an
    empty table gives none.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    kind = "array<struct<gate:array<string>,rules:array<struct<label:string,pattern:string,keyword:array<string>,priority:int,weight:double>>>>"
    signatures = signatures or rules()
    groups: dict[str, list[dict]] = {}
    for r in signatures:
        # Matches start and end at a space of the plain text, which they do not take.
        row = asdict(r) | {"pattern": f"(?<= )(?:{r.pattern})(?= )", "keyword": r.keyword.split("|")}
        groups.setdefault(r.gate or r.keyword, []).append(row)
    table = F.from_json(F.lit(json.dumps([{"gate": [f" {k}" for k in gate.split("|")], "rules": found} for gate, found in groups.items()])), kind)
    nothing = F.struct(
        F.lit(0).cast("long").alias("n_base"),
        F.lit(None).cast("long").alias("first_word"),
        F.lit(None).cast("long").alias("last_word"),
        F.lit("").alias("base_labels"),
        F.lit("").alias("labels"),
        F.lit(0.0).alias("score"),
    )
    found = F.when(_passes_gate(body, signatures), _scan(body, table)).otherwise(nothing)
    scanned = df.select(F.col(id_col).alias("doc_id"), _count_words(body).alias("n_words"), found.alias("found"))
    return scanned.select("doc_id", "n_words", "found.*")
