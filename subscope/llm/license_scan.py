"""Licence scans by sentence rules.

1. A text is cut into sentences: at ., ;, ! or ? before white space, at : before a line break
   and at lines that are blank but for comment signs; any other line break is a soft wrap, so wrapped headers come together again.
2. Sentences with a word of licence language are normalised (comment signs, quotes, case,
   spacing, "licence") and mapped to identifiers of known licence sentences. A sentence that
   is not known as a whole is cut into the known ones that its runs of whole lines hold,
   longest first; a line of copyright or an address ends with its line. Every other stretch of
   lines with licence language is the identifier "?".
3. The sequence of identifiers is matched against ordered rules: for each rule in turn every
   place where its identifiers follow each other is taken and used up. What no rule takes is
   counted as unmatched.

Sentences are mapped once per distinct text and task. Defined results: a null or empty text
has no licence; repeated rows are scanned one by one; a licence found twice has two matches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subscope.llm.common import keyed

UNMATCHED = "?"
#: sentences that may stand anywhere in a licence; they are left out of the sequence
PASSING = ("copyright", "address")
#: normalised sentences remembered at once by a task
CACHE = 100_000
#: lines of a run that is tried: more than the words of any known sentence, if each had a line
RUN = 64

# every sentence of SENTENCES that is not in PASSING holds one of these; words may be parted by a soft wrap
_LANGUAGE = re.compile(r"licen[sc]|copyright|spdx|warrant|permission|redistribut|merchantab|liab|unencumbered|public[\s*#/;%-]+domain"
                       r"|creative[\s*#/;%-]+commons|\bcc0|\bcc[\s*#/;%-]+by\b|\bmpl\b", re.I)
_END = re.compile(r"(?<![ \t]v)[.;!?](?=\s)|:(?=[ \t\r]*\n)|\n[ \t\r]*(?:[*#/;%-]+[ \t\r]*)?\n")
_COMMENT = re.compile(r"^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--+|<!--|%+|\.\.)[ \t]?", re.M)
_SIGN = re.compile(r"[\"'`“”‘’(),*<>/]|-->")

# Known licence sentences, normalised as _normal does; fixed values. (identifier, pattern)
SENTENCES = [
    ("spdx", r"spdx-license-identifier: (?P<of>[a-z0-9.+-]+)"),
    ("address", r"(?:see )?https?:.*"),
    ("copyright", r"(?:portions )?copyright\b.*|all rights reserved"),
    ("ccby", r"(?:this work is |released |is )?(?:licensed |released |available )?under (?:the |a )?(?:cc|creative commons)[ -](?P<of>by(?:[ -](?:nc|nd|sa))*)[ -]?(?:license )?v?(?P<version>[1-4]\.0)(?: (?:international|unported))?(?: license)?"),
    ("cc0", r"(?:this work is |released )?(?:licensed |dedicated |released )?(?:under|to) (?:the )?(?:cc0|creative commons zero).*"),
    ("mit.short", r"(?:this (?:work|project|software|file|code) is )?(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit license"),
    ("mit.grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*"),
    ("mit.notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("asis.mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("liability.mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability.*"),
    ("isc.grant", r"permission to use copy modify and ?or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc.asis", r"the software is provided as is and the author disclaims all warranties.*"),
    ("isc.liability", r"in no event shall the author be liable for any special direct indirect or consequential damages.*"),
    ("bsd.short", r"(?:licensed|released|distributed|available) under (?:the |a )?(?:terms of the )?(?P<of>[23]|two|three)[ -]clause bsd license|(?:licensed|released|distributed) under (?:the )?bsd (?P<clauses>[23])[ -]clause license"),
    ("bsd.may", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd.source", r"(?:1\. )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd.binary", r"(?:2\. )?redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and ?or other materials provided with the distribution"),
    ("bsd.names", r"(?:3\. )?neither the name of .* nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd.asis", r"this software is provided by the .* as is and any express or implied warranties.* are disclaimed"),
    ("bsd.liability", r"in no event shall the .* be liable for any direct indirect incidental special exemplary or consequential damages.*"),
    ("apache.under", r"(?:this (?:work|project|file|software) is )?licensed under the apache license,? ?version (?P<version>[12]\.[01]) ?(?:the license)?"),
    ("apache.unless.use", r"you may not use this file except in compliance with the license"),
    ("apache.copy", r"you may obtain a copy of the license at(?: https?:? ?www\.apache\.org ?licenses ?license-2\.0)?"),
    ("apache.asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache.see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("gpl.short", r"(?:this (?:work|project|program|software|file) is )?(?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?gnu (?P<of>lesser |affero )?general public license,? ?(?:version |v)(?P<version>[123](?:\.[01])?)(?P<later> or (?:at your option )?any later version)?"),
    ("gpl.terms", r"(?:.{1,80} is free software:? )?you can redistribute it and ?or modify it under the terms of the gnu (?P<of>lesser |affero )?general public license as published by the free software foundation(?: either version (?P<version>[123](?:\.[01])?) of the license or at your option any later version)?"),
    ("gpl.version", r"either version (?P<version>[123](?:\.[01])?) of the license or at your option any later version"),
    ("gpl.hope", r"(?:this program|.{1,60}) is distributed in the hope that it will be useful but without any warranty"),
    ("gpl.implied", r"without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl.details", r"see the gnu (?:lesser |affero )?general public license for more details"),
    ("gpl.received", r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with .*"),
    ("mpl.terms", r"this source code form is subject to the terms of the mozilla public license,? ?v\. ?(?P<version>[12]\.[01])"),
    ("mpl.copy", r"if a copy of the mpl was not distributed with this file you can obtain one at .*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
]

#: sentences that may go on after what is known of them
OPEN = {name for name, pattern in SENTENCES if pattern.endswith(".*")}

# Ordered licence rules; fixed values. A part is an identifier, or one that may be missing ("?" at its end).
RULES = [
    ("spdx:{of}", ["spdx"]),
    ("MIT", ["mit.grant", "mit.notice", "asis.mit", "liability.mit?"]),
    ("ISC", ["isc.grant", "isc.asis", "isc.liability?"]),
    ("BSD-3-Clause", ["bsd.may", "bsd.source", "bsd.binary", "bsd.names", "bsd.asis", "bsd.liability?"]),
    ("BSD-2-Clause", ["bsd.may", "bsd.source", "bsd.binary", "bsd.asis", "bsd.liability?"]),
    ("Apache-{version}", ["apache.under", "apache.unless.use", "apache.copy", "apache.asis", "apache.see?"]),
    ("{of}GPL-{version}-or-later", ["gpl.terms", "gpl.version?", "gpl.hope?", "gpl.implied?", "gpl.details?", "gpl.received?"]),
    ("MPL-{version}", ["mpl.terms", "mpl.copy?"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-{version}", ["apache.under"]),
    ("{of}GPL-{version}{later}", ["gpl.short"]),
    ("MIT", ["mit.short"]),
    ("BSD-{of}{clauses}-Clause", ["bsd.short"]),
    ("CC-{of}-{version}", ["ccby"]),
    ("CC0-1.0", ["cc0"]),
]

# fixed values
_WRITTEN = {"lesser ": "L", "affero ": "A", "two": "2", "three": "3"}


def _normal(sentence: str) -> str:
    text = _SIGN.sub(" ", _COMMENT.sub("", sentence).lower()).replace("licence", "license")
    text = " ".join(text.split())
    return text.strip(" .;:!?-=_")


class Sentences:
    """Sentence of licence language -> identifiers and captured values of its parts."""

    def __init__(self):
        self.known = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
        self.seen: dict[str, list[tuple[int, int, str, dict[str, str]]]] = {}

    def __call__(self, sentence: str) -> list[tuple[int, int, str, dict[str, str]]]:
        """(start, end, identifier, captured values) of the known sentences in it, by place, and of its
        other parts of licence language; places are in characters of ``sentence``."""
        if sentence not in self.seen:
            if len(self.seen) >= CACHE:
                self.seen.clear()
            self.seen[sentence] = self._identify(sentence)
        return self.seen[sentence]

    def _identify(self, sentence: str) -> list[tuple[int, int, str, dict[str, str]]]:
        whole = self._match(sentence)
        if whole and ("\n" not in sentence.strip() or whole[0] not in PASSING and not self._swallows(whole[0], sentence)):
            return [(0, len(sentence), *whole)]
        # runs of whole lines, longest first; what a run takes splits the lines. A line of copyright
        # or an address ends with the line, so it is looked for among the lines that are left
        at, places = 0, []
        for line in sentence.split("\n"):
            places.append((at, at + len(line)))
            at += len(line) + 1
        free, found = [True] * len(places), []
        begun = [(first, known) for first in range(len(places)) if (known := self._begun(
            sentence[places[first][0]:places[min(first + RUN, len(places)) - 1][1]]))]
        for size in range(min(len(places), RUN), 0, -1):
            for first, some in begun:
                if first + size > len(places):
                    break
                start, end = places[first][0], places[first + size - 1][1]
                if all(free[first:first + size]) and _LANGUAGE.search(sentence, start, end):
                    known = self._match(sentence[start:end], some)
                    if known and (size == 1 or known[0] not in PASSING and not self._swallows(known[0], sentence[start:end])):
                        found.append((start, end, *known))
                        free[first:first + size] = [False] * size
        first = 0
        while first < len(places):
            last = first
            while free[first] and last + 1 < len(places) and free[last + 1]:
                last += 1
            start, end = places[first][0], places[last][1]
            if free[first] and _LANGUAGE.search(sentence, start, end):
                found.append((start, end, UNMATCHED, {}))
            first = last + 1
        return sorted(found, key=lambda part: part[0])

    def _swallows(self, name: str, part: str) -> bool:
        """Whether the open end of a known sentence has taken lines that are known themselves, in runs of
        at most RUN lines: longer ones are never looked for on their own either."""
        if name not in OPEN:
            return False
        lines = part.strip().split("\n")
        for first in range(1, len(lines)):
            some = self._begun("\n".join(lines[first:first + RUN]))
            for last in range(first + 1, min(first + RUN, len(lines)) + 1) if some else ():
                run = "\n".join(lines[first:last])
                known = self._match(run, some) if _LANGUAGE.search(run) else None
                if known and known[0] != "address":
                    return True
        return False

    def _begun(self, part: str) -> list[tuple[str, re.Pattern]]:
        """The known sentences that some beginning of ``part`` can be: each line is looked at once."""
        text = _normal(part)
        return [known for known in self.known if known[1].match(text)]

    def _match(self, sentence: str, some: list[tuple[str, re.Pattern]] | None = None) -> tuple[str, dict[str, str]] | None:
        text = _normal(sentence)
        for name, pattern in self.known if some is None else some:
            m = pattern.fullmatch(text)
            if m:
                return name, {k: v for k, v in m.groupdict().items() if v}
        return None


def licence_sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences that hold a word of licence language, in order."""
    at = 0
    while word := _LANGUAGE.search(text, at):
        start = at
        # the sentence starts after the last end before the word; ends lie between here and the word
        for end in _END.finditer(text, at, min(len(text), word.end() + 1)):
            if end.end() <= word.start():
                start = end.end()
        stop = _END.search(text, word.end())
        at = stop.end() if stop else len(text)
        yield start, at


def match_rules(found: list[tuple[str, dict[str, str]]]) -> list[tuple[str, int, int]]:
    """(licence, first, last) places in the sequence ``found``, by place."""
    free, matches = [True] * len(found), []
    for licence, parts in RULES:
        for first in range(len(found)):
            at, values = first, {}
            for part in parts:
                name = part.rstrip("?")
                if at < len(found) and free[at] and found[at][0] == name:
                    values |= found[at][1]
                    at += 1
                elif not part.endswith("?"):
                    at = -1
                    break
            if at > first:
                free[first:at] = [False] * (at - first)
                values = {k: _WRITTEN.get(v, v) for k, v in values.items()}
                values["later"] = "-or-later" if "later" in values else "-only"
                values = {"of": "", "clauses": "", "version": ""} | values
                if licence.startswith("CC-"):
                    values["of"] = values["of"].upper().replace(" ", "-")
                if licence.endswith("{later}") and "." not in values["version"]:
                    values["version"] += ".0"
                elif licence.endswith("or-later") and "." not in values["version"]:
                    values["version"] += ".0"
                matches.append((licence.format(**values), first, at - 1))
    return sorted(matches, key=lambda m: m[1])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, matches array<struct<license, start, end>> (places in the text, in
    characters), n_sentences (known licence sentences), n_unmatched (licence language no rule takes)."""
    docs = keyed(df, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Sentences()
        kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out, known, open_ = [], [], []
            for text in batch.column(1).to_pylist():
                every = [((start + a, start + b), (name, values)) for start, end in licence_sentences(text)
                         for a, b, name, values in identify(text[start:end])]
                spans = [span for span, (name, _) in every if name not in PASSING]
                found = [sentence for _, sentence in every if sentence[0] not in PASSING]
                matches = match_rules(found)
                taken = sum(last - first + 1 for _, first, last in matches)
                out.append([{"license": m, "start": spans[a][0], "end": spans[b][1]} for m, a, b in matches])
                known.append(sum(name != UNMATCHED for _, (name, _) in every))
                open_.append(len(found) - taken)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, kind), pa.array(known, pa.int64()), pa.array(open_, pa.int64())],
                ["doc_id", "matches", "n_sentences", "n_unmatched"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, matches array<struct<license: string, start: long, end: long>>, "
                                "n_sentences long, n_unmatched long")


def licences(scanned: DataFrame) -> DataFrame:
    """One row per match: doc_id, license, start, end."""
    return scanned.select("doc_id", F.inline("matches"))
