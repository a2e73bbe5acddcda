"""License scan by ordered signature rules (operator 3).

The rules are regexes over a text's words, gated by a keyword prefilter: an automaton finds the keywords
that occur, and only their rules run. Detections that overlap are resolved by priority and containment:
in order of priority, then length, a detection stands unless a standing one contains it or a standing
one of higher priority overlaps it. Base phrases are counted at every place and are never suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrid.llm.common import text_function

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Licences as (label, name in words, other names; versions). Patterns are regex over single-spaced words.
LICENSES = (
    ("apache", "apache (?:software )?license", "asl|apache", "1 0|1 1|2 0|2"),
    ("mit", "mit license", "expat license|x11 license|mit", ""),
    ("bsd", "bsd license", "bsd [23] clause(?: license)?|(?:new|modified|simplified|revised) bsd license|berkeley software distribution", ""),
    ("isc", "isc license", "internet systems consortium license", ""),
    ("gpl", "gnu general public license", "gnu gpl|gplv?[23]?", "1|2|3|2 0|3 0"),
    ("lgpl", "gnu (?:lesser|library) general public license", "gnu lgpl|lgplv?[23]?", "2|2 0|2 1|3|3 0"),
    ("agpl", "(?:gnu )?affero general public license", "gnu agpl|agplv?[13]?", "1|3|3 0"),
    ("fdl", "gnu free documentation license", "gnu fdl|gfdl", "1 1|1 2|1 3"),
    ("mpl", "mozilla public license", "mplv?2?", "1 0|1 1|2 0"),
    ("epl", "eclipse public license", "eplv?[12]?", "1 0|2 0"),
    ("cpl", "common public license", "cpl", "1 0"),
    ("cddl", "common development and distribution license", "cddl", "1 0|1 1"),
    ("eupl", "european union public licen[cs]e", "eupl", "1 0|1 1|1 2"),
    ("osl", "open software license", "osl", "1 0|2 0|2 1|3 0"),
    ("afl", "academic free license", "afl", "1 1|1 2|2 0|2 1|3 0"),
    ("artistic", "artistic license", "perl artistic", "1 0|2 0"),
    ("zlib", "zlib license", "zlib libpng license", ""),
    ("boost", "boost software license", "bsl 1 0", "1 0"),
    ("unlicense", "the unlicense", "unlicense", ""),
    ("wtfpl", "do what the fuck you want to public license", "wtfpl", "1|2"),
    ("cc0", "creative commons zero", "cc0|creative commons public domain dedication", "1 0"),
    ("cc-by", "creative commons attribution(?: license)?", "cc by", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: license)?", "cc by sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: license)?", "cc by nc", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: license)?", "cc by nd", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: license)?", "cc by nc sa", "1 0|2 0|2 5|3 0|4 0"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: license)?", "cc by nc nd", "1 0|2 0|2 5|3 0|4 0"),
    ("odbl", "open database license", "odbl", "1 0"),
    ("odc-by", "open data commons attribution license", "odc by", "1 0"),
    ("pddl", "public domain dedication and license", "pddl", "1 0"),
    ("ofl", "sil open font license", "open font license|ofl", "1 0|1 1"),
    ("psf", "python software foundation license", "psf license", "2|2 0"),
    ("ruby", "ruby license", "license of ruby", ""),
    ("php", "php license", "", "3 0|3 01"),
    ("postgresql", "postgresql license", "postgres license", ""),
    ("openssl", "openssl license", "ssleay license", ""),
    ("ms-pl", "microsoft public license", "ms pl", ""),
    ("ms-rl", "microsoft reciprocal license", "ms rl", ""),
    ("apsl", "apple public source license", "apsl", "1 0|1 1|1 2|2 0"),
    ("ncsa", "university of illinois ncsa open source license", "ncsa license|uiuc license", ""),
    ("vim", "vim license", "", ""),
    ("w3c", "w3c software notice and license", "w3c license", ""),
    ("beerware", "beer ?ware license", "buy me a beer in return", ""),
    ("json", "json license", "shall be used for good not evil", ""),
    ("upl", "universal permissive license", "upl", "1 0"),
    ("ecl", "educational community license", "ecl", "1 0|2 0"),
    ("qpl", "q public license", "qpl", "1 0"),
    ("sissl", "sun industry standards source license", "sissl", "1 1|1 2"),
    ("npl", "netscape public license", "npl", "1 0|1 1"),
    ("ipl", "ibm public license", "", "1 0"),
    ("sspl", "server side public license", "sspl", "1|1 0"),
    ("busl", "business source license", "busl", "1 0|1 1"),
    ("elastic", "elastic license", "", "1 0|2 0"),
    ("commons-clause", "commons clause", "", "1 0"),
    ("polyform", "polyform (?:noncommercial|small business|shield|strict|perimeter) license", "", "1 0 0"),
    ("cecill", "cecill(?: [abc])? (?:free software )?license", "cecill", "1 0|1 1|2 0|2 1"),
    ("mulan", "mulan permissive software license", "mulan psl", "1|2"),
    ("blue-oak", "blue oak model license", "", "1 0 0"),
    ("openrail", "(?:creative ml )?open ?rail(?: m| s| d)?(?: license)?", "responsible ai license", ""),
)

#: Sentences that stand for a licence by themselves: (label, keyword, pattern).
SENTENCES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification"),
    ("bsd", "neither the name", "neither the name of .{1,80}? nor the names of its contributors"),
    ("apache", "licensed under the apache", "licensed under the apache license version 2 0 the license you may not use this file"),
    ("gpl", "free software foundation", "(?:redistribute it and or modify it|either version \\d) .{0,60}?published by the free software foundation"),
    ("gpl", "any later version", "(?:redistribute it and or modify it|either version \\d) .{0,60}?any later version"),
    ("zlib", "provided as is without any express", "provided as is without any express or implied warranty in no event"),
    ("unlicense", "released into the public domain", "free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:in|into|to|is) the public domain"),
    ("cc0", "waived all copyright", "waived all copyright and related or neighboring rights"),
    ("proprietary", "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this (?:file|document|work)"),
    ("proprietary", "may not be reproduced", "may not be reproduced .{0,60}?without (?:the )?(?:prior )?(?:written )?permission"),
    ("copyright", "copyright", "copyright (?:c )?(?:19|20)\\d\\d"),
    ("mit", "and this permission notice", "the above copyright notice and this permission notice (?:shall|must) be included in all copies"),
    ("mit", "without warranty of any kind", "the software is provided as is without warranty of any kind express or implied"),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the (?:above )?copyright notice"),
    ("bsd", "by the copyright holders and contributors", "this software is provided by the copyright holders and contributors as is"),
    ("bsd", "all advertising materials", "all advertising materials mentioning features or use of this software"),
    ("apache", "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", "grant of copyright license", "grant of copyright license subject to the terms and conditions"),
    ("gpl", "without even the implied warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl", "you should have received a copy", "you should have received a copy of the gnu (?:lesser |library |affero )?general public license"),
    ("lgpl", "lesser general public license as published", "gnu lesser general public license as published by"),
    ("agpl", "affero general public license as published", "gnu affero general public license as published by"),
    ("fdl", "under the terms of the gnu free documentation", "modify this document under the terms of the gnu free documentation license"),
    ("mpl", "subject to the terms of the mozilla", "source code form is subject to the terms of the mozilla public license"),
    ("epl", "under the terms of the eclipse", "made available under the terms of the eclipse public license"),
    ("cddl", "subject to the terms of the common development", "subject to the terms of the common development and distribution license"),
    ("zlib", "altered source versions", "altered source versions must be plainly marked as such"),
    ("zlib", "the origin of this software", "the origin of this software must not be misrepresented"),
    ("boost", "under the boost software license", "distributed under the boost software license"),
    ("boost", "machine executable object code", "machine executable object code generated by a source language processor"),
    ("unlicense", "anyone is free to copy", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "you just do what the", "you just do what the fuck you want to"),
    ("ofl", "reserved font name", "with reserved font names?"),
    ("ofl", "under the sil open font license", "licensed under the sil open font license"),
    ("cc-by-sa", "creative commons attribution share", "creative commons attribution share ?alike"),
    ("cc-by-nc", "creative commons attribution non", "creative commons attribution non ?commercial"),
    ("cc-by-nd", "creative commons attribution no", "creative commons attribution no ?deriv(?:s|atives)"),
    ("cc0", "dedicated the work to the public domain", "has dedicated the work to the public domain"),
    ("odbl", "under the open database license", "made available under the open database license"),
    ("openssl", "for use in the openssl toolkit", "software developed by the openssl project for use in the openssl toolkit"),
    ("php", "this product includes php", "this product includes php software"),
    ("mit", "except as contained in this notice", "except as contained in this notice the names? of"),
    ("ms-pl", "under the microsoft public license", "licensed under the microsoft public license"),
    ("noncommercial", "non commercial use only", "for (?:personal )?non commercial use only"),
    ("noncommercial", "personal and non commercial use", "for (?:your )?personal and non commercial use"),
    ("proprietary", "for internal use only", "for internal use only"),
    ("proprietary", "no part of this", "no part of this (?:publication|book|document|work|website) may be (?:reproduced|copied|used|distributed)"),
    ("proprietary", "licensed not sold", "(?:is|are) licensed not sold"),
    ("proprietary", "not reverse engineer", "(?:may|shall|must) not reverse engineer"),
    ("proprietary", "trade secrets", "contains? (?:confidential |proprietary |valuable ){0,2}trade secrets"),
    ("copyright", "copyrighted material", "(?:contains|is|uses) copyrighted material"),
    ("copyright", "used with permission", "used with permission(?: of)?"),
    ("noai", "text and data mining", "text and data mining .{0,60}?(?:reserved|prohibited|permitted)"),
    ("noai", "to train machine learning", "to train machine learning (?:models|systems|algorithms)"),
    ("noai", "not be used to train", "(?:may|must|shall) not be used to train"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int  # smaller goes first
    weight: float


def keyword_of(pattern: str) -> str:
    """The longest run of plain words that every match of the pattern holds."""
    text = re.sub(r"\[[^\]]*\]", "\0", pattern)
    while (cutter := re.sub(r"\((?:\?:)?[^()]*\)[?*]?", "\0", text)) != text:
        text = cutter
    text = re.sub(r".[?*]|\.\{[^}]*\}\??|\\d|[.\\]", "\0", text)
    return max((x.strip() for x in re.split("\0", text)), key=len)


def build_rules() -> list[Rule]:
    """All rules in order: identifier tags, versioned names, sentences, names, short names."""
    rules = []
    for label, name, others, versions in LICENSES:
        alternatives = [x for x in _split(others) if x]
        spdx = label.replace("-", " ")
        rules.append(Rule(label, "spdx", rf"spdx license identifier {spdx}(?: [0-9]+)*(?: only| or later)?", 0, 1.0))
        for v in _split(versions):
            if v:
                rules.append(Rule(f"{label}-{v.replace(' ', '.')}", keyword_of(name), rf"{name} (?:version |v ?)?{v}(?: only| or later)?", 1, 0.95))
        rules.append(Rule(label, keyword_of(name), name, 3, 0.8))
        for x in alternatives:
            for form in (rf"(?:licensed|released|distributed|available) under (?:the )?(?:terms of (?:the )?)?{x}", rf"{x} licensed?"):
                rules.append(Rule(label, keyword_of(x) or "licen", form, 4, 0.7))
            if keyword_of(x):
                rules.append(Rule(label, keyword_of(x), rf"{x} (?:or (?:any )?(?:later|newer)(?: versions?)?|only)", 4, 0.7))
    rules += [Rule(label, keyword, pattern, 2, 0.9 if label != "copyright" else 0.4) for label, keyword, pattern in SENTENCES]
    return sorted(rules, key=lambda r: r.priority)


def _split(text: str) -> list[str]:
    """Parts between bars that stand outside brackets."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if c == "|" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


class Scanner:
    def __init__(self) -> None:
        self.rules = [(r, re.compile(rf"(?<= ){r.pattern}(?= )")) for r in build_rules()]
        by_keyword: dict[str, list[int]] = {}
        for k, (r, _) in enumerate(self.rules):
            by_keyword.setdefault(r.keyword, []).append(k)
        self.automaton = ahocorasick.Automaton()
        for word, at in by_keyword.items():
            self.automaton.add_word(word, tuple(at))
        self.automaton.make_automaton()
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in BASE]

    def words(self, text: str | None) -> bytes:
        """The words in lower case, each between single spaces."""
        parts = (text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()
        return b" " + b" ".join(parts) + b" " if parts else b" "

    def base_places(self, line: bytes) -> tuple[list[int], set[str]]:
        places, labels = [], set()
        for phrase, label in self.base:
            at, word, seen = line.find(phrase), 0, 0
            while at >= 0:
                word += line.count(b" ", seen, at)
                seen = at
                places.append(word)
                labels.add(label)
                at = line.find(phrase, at + 1)
        return places, labels

    def detections(self, line: str) -> list[tuple[int, int, str, float]]:
        """Standing detections (start, end, label, weight) of the ordered rules, in order of start."""
        run = sorted({k for _, at in self.automaton.iter(line) for k in at})
        levels: dict[int, list[tuple]] = {}
        for k in run:
            r, pattern = self.rules[k]
            levels.setdefault(r.priority, []).extend((m.start(), -m.end(), r.label, r.weight) for m in pattern.finditer(line))
        standing: list[tuple] = []
        taken: tuple[list[int], list[int]] = [], []  # starts and ends of the parts that earlier levels took, in order
        for priority in sorted(levels):
            kept, reach = [], -1
            for start, end, label, weight in sorted(levels[priority]):  # a detection that holds another comes before it
                end = -end
                k = bisect_left(taken[1], start + 1)
                if (k == len(taken[0]) or taken[0][k] >= end) and end > reach:
                    kept.append((start, end, label, weight))
                    reach = end
            standing += kept
            taken = merged([*zip(*taken, strict=True), *(x[:2] for x in kept)])
        return sorted(standing)

    def scan(self, text: str | None) -> tuple:
        line = self.words(text)
        n_words = line.count(b" ") - 1 if len(line) > 1 else 0
        places, base = self.base_places(line)
        shown = line.decode("utf-8", "surrogatepass")
        found = self.detections(shown) if n_words else []
        labels = base | {x[2] for x in found}
        miss = 0.5 if base else 1.0
        for *_, weight in found:
            miss *= 1 - weight
        blanks = [m.start() for m in BLANK.finditer(shown)] if found else []
        spans = [{"label": x[2], "start": bisect_left(blanks, x[0]) - 1, "end": bisect_left(blanks, x[1]), "weight": x[3]} for x in found]
        first, last = (min(places), max(places)) if places else (None, None)
        return n_words, len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 - miss, spans


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts that spans cover, in order; spans that only touch stay apart."""
    starts, ends = [], []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


BLANK = re.compile(" ")
#: Bytes of words stay, A-Z in lower case; the others separate words.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

RESULT = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label:string,start:long,end:long,weight:double>>"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and the columns of RESULT.

    Detections give the words [start, end) of each standing match. Containment suppresses detections of the method
    among each other; base labels are told from all their places and always stay, so "GNU General Public License v3.0" has
    gpl beside gpl-3.0. A null text counts as empty: no words, no labels (empty strings), null first and last word,
    score 0. Texts are read whole, in time proportional to their length. Of detections that tie in priority and length
    the first stands. Repeated rows and null ids stay; an empty table gives an empty one; other columns are ignored,
    whatever their names.
    """

    def setup():
        scanner = Scanner()
        return lambda texts: list(zip(*map(scanner.scan, texts), strict=True)) or [[]] * 8

    return df.select(F.col(id_col), text_function(RESULT, setup)(F.col(text_col)).alias("x")).select(id_col, "x.*")
