"""Licence scans by sentence rules.

A text is cut into sentences and lines, each is normalised, and known licence sentences get their identifiers. A line that
is unknown alone, or that goes on, is tried together with the lines after it up to the end of its sentence or paragraph,
so wrapped texts and comment blocks read like unwrapped ones. Unknown sentences between known ones leave a gap mark, the
numbers of lists do not. The sequence of identifiers is then matched against ordered licence rules: at each
place the first rule whose sequence stands there wins and uses its sentences up. Texts that hold no word that every
sentence rule needs are passed over without cutting, which changes nothing in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

# Licence sentences, normalised, as patterns over a whole sentence.
SENTENCES = [
    ("spdx", r"spdx license identifier (?P<spdx>[a-z0-9.+ -]+)"),
    ("gpl_work", r"(?:this (?:work|program|file|software) is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public license(?: as published by the free software foundation)?(?: (?:version|v) ?(?P<gpl>[0-9.]+))?(?P<later> or (?:\(?at your option\)? )?any later version)?.*"),
    ("lgpl_work", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu (?:lesser|library) general public license(?: version ?(?P<lgpl>[0-9.]+))?.*"),
    ("agpl_work", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu affero general public license(?: version ?(?P<agpl>[0-9.]+))?.*"),
    ("gpl_redistribute", r"this (?:program|library|file) is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation (?:either )?version (?P<gplr>[0-9.]+) of the license(?P<later2> or at your option any later version)?"),
    ("gpl_hope", r"this (?:program|library|file) is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl_see", r"see the gnu (?:lesser |affero )?general public license for more details"),
    ("gpl_received", r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this (?:program|library|file).*"),
    ("apache_work", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?apache license,? ?(?:version |v)?(?P<apache>[0-9.]+)?(?: the license)?"),
    ("apache_not_use", r"you may not use this file except in compliance with the license"),
    ("apache_obtain", r"you may obtain a copy of the license at.*"),
    ("apache_asis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache_see", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mit_work", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:mit|expat) licen[sc]e.*"),
    ("mit_title", r"(?:the )?mit license(?: mit)?"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*"),
    ("mit_notice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit_asis", r"the software is provided as is without warranty of any kind express or implied.*"),
    ("mit_liable", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability.*"),
    ("bsd_work", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:(?P<bsd>[234]) clause |new |simplified |revised )?bsd (?:(?P<bsd2>[234]) clause )?licen[sc]e.*"),
    ("bsd_redistribution", r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met.*"),
    ("bsd_source", r"(?:\d )?redistributions of source code must retain the above copyright notice.*"),
    ("bsd_binary", r"(?:\d )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsd_endorse", r"(?:\d )?neither the name of .* may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd_asis", r"this software is provided by the (?:copyright holders|regents|author).* as is and any express or implied warranties.*"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl_subject", r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? ?(?P<mpl>[0-9.]+)"),
    ("mpl_work", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:the )?(?:terms of the )?mozilla public license(?: version ?(?P<mpl2>[0-9.]+))?.*"),
    ("cc_work", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:a |the )?(?:terms of the )?(?:cc|creative commons) ?(?P<cc>by(?: (?:nc|nd|sa))*|zero|0)(?: licen[sc]e)?(?: (?P<ccv>[0-9]\.[0-9]))?(?: (?:international|unported))?(?: licen[sc]e)?"),
    ("cc_attribution", r"(?:this \w+ is )?(?:licensed|released|distributed) under (?:a |the )?creative commons attribution(?P<ccnc> noncommercial| non commercial)?(?P<ccnd> noderivatives| noderivs)?(?P<ccsa> sharealike| share alike)?(?: (?P<ccv2>[0-9]\.[0-9]))?.*"),
    ("public_domain", r"this (?:\w+ )?is (?:free and unencumbered software released into|in|dedicated to) the public domain"),
    ("unlicense_anyone", r"anyone is free to copy modify publish use compile sell or distribute this software.*"),
    ("wtfpl", r".*do what the fuck you want to public license.*"),
    ("copyright", r"(?:copyright|\(c\)|©)(?: \(c\)| ©)? (?:(?:19|20)[0-9]{2}.*|.*(?:19|20)[0-9]{2}).*"),
    ("reserved", r"all rights reserved"),
]
#: Ordered: the first rule that stands at a place wins. "?" after an identifier: may be absent.
RULES = [
    ("Apache", ["apache_work", "apache_not_use?", "apache_obtain?", "apache_asis?", "apache_see?"]),
    ("GPL", ["gpl_redistribute", "gpl_hope?", "gpl_see?", "gpl_received?"]),
    ("MIT", ["mit_title?", "copyright?", "reserved?", "mit_grant", "mit_notice?", "mit_asis?", "mit_liable?"]),
    ("BSD-3-Clause", ["copyright?", "reserved?", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_asis?"]),
    ("BSD-2-Clause", ["copyright?", "reserved?", "bsd_redistribution", "bsd_source", "bsd_binary", "bsd_asis?"]),
    ("ISC", ["copyright?", "isc_grant"]),
    ("Unlicense", ["public_domain", "unlicense_anyone"]),
    ("AGPL", ["agpl_work"]),
    ("LGPL", ["lgpl_work"]),
    ("GPL", ["gpl_work"]),
    ("MIT", ["mit_work"]),
    ("MIT", ["mit_title"]),
    ("BSD", ["bsd_work"]),
    ("MPL", ["mpl_subject"]),
    ("MPL", ["mpl_work"]),
    ("CC", ["cc_work"]),
    ("CC", ["cc_attribution"]),
    ("SPDX", ["spdx"]),
    ("Public-Domain", ["public_domain"]),
    ("WTFPL", ["wtfpl"]),
    ("All-Rights-Reserved", ["copyright?", "reserved"]),
    ("Copyright", ["copyright"]),
]
#: Every sentence rule needs one of these.
_NEEDED = re.compile(r"licen[sc]e|licensed|redistribut|permission|copyright|warrant|rights\W+reserved|public\W+domain|\(c\)|©|released\W+under|distributed\W+under|in\W+no\W+event|without\W+restriction|anyone\W+is\W+free|do\W+what\W+the|compliance")
_CUT = re.compile(r"\n+|(?<=[^.!?\s][.;])\s+")
#: Beginnings of sentence rules: lines from which others are joined; those whose rules have no bounded head.
_START = re.compile(r"(?:\d )?(?:(?:spdx|this|licensed|released|distributed|see|you|unless|the|mit|permission|in|redistributions?|neither|anyone|all|copyright)\b|\(c\)|©)|.*\bdo(?: what\b.*)?$")
_UNBOUNDED = re.compile(r"(?:\d )?neither the name of |copyright\b|\(c\)|©")
_UNBOUNDED_END = re.compile(r"(?:19|20)[0-9]{2}|permission$")
#: Every other rule's sentence, or what it asks of its beginning, is shorter.
HEAD_CHARS = 600
#: A list's number or letter.
_ITEM = re.compile(r"\W*(?:[0-9]{1,2}|[a-zA-Z]|[ivx]{1,4})?[\W_]*")
#: Identifiers of one line.
ONE_LINE = frozenset(["spdx", "copyright", "reserved"])
_NOISE = re.compile(r"[^a-z0-9.+()©]+")
_RULES = [(name, re.compile(pattern)) for name, pattern in SENTENCES]
_PATTERN = dict(_RULES)
GAP = "-"


def normalised(sentence: str) -> str:
    """Lower case, one space between words, no punctuation but dots inside versions."""
    t = _NOISE.sub(" ", sentence.lower()).replace("(c)", "\x00").replace("(", "").replace(")", "").replace("\x00", "(c)")
    return " ".join(w.strip(".") for w in t.split() if w.strip("."))


def identify(sentence: str) -> tuple[str, dict[str, str]] | None:
    """The identifier of a normalised sentence and what its pattern captured."""
    for name, pattern in _RULES:
        if m := pattern.fullmatch(sentence):
            return name, {k: v for k, v in m.groupdict().items() if v}
    return None


def _name(base: str, got: dict[str, str]) -> str:
    version = next((got[k].strip(".") for k in ("gpl", "gplr", "lgpl", "agpl", "apache", "mpl", "mpl2", "ccv", "ccv2") if k in got), "")
    if base == "CC":
        kind = got["cc"] if "cc" in got else "by" + "".join(f" {k[2:]}" for k in ("ccnc", "ccnd", "ccsa") if k in got)
        base = "CC0" if kind in ("zero", "0") else "CC-" + kind.upper().replace(" ", "-")
    elif base == "BSD" and ("bsd" in got or "bsd2" in got):
        return f"BSD-{got.get('bsd') or got.get('bsd2')}-Clause"
    elif base == "SPDX":
        return "SPDX:" + got["spdx"].strip().replace(" ", "-")
    later = "-or-later" if "later" in got or "later2" in got else ""
    return base + (f"-{version}" if version else "") + later


def match_rules(ids: list[tuple[str, dict[str, str]]]) -> list[str]:
    """Licences of a sequence of identifiers, in order."""
    out, at = [], 0
    while at < len(ids):
        for base, wanted in RULES:
            k, got = at, {}
            for w in wanted:
                if k < len(ids) and ids[k][0] == w.rstrip("?"):
                    got |= ids[k][1]
                    k += 1
                elif not w.endswith("?"):
                    break
            else:
                if k > at:
                    out.append(_name(base, got))
                    at = k
                    break
        else:
            at += 1
    return out


def sentences_of(text: str) -> Iterator[tuple[str, dict[str, str]]]:
    """Identifiers of a text's sentences in order, with one gap mark for unknown sentences between."""
    lines, goes_on, at = [], [], 0
    for m in _CUT.finditer(text):
        lines.append(text[at : m.start()])
        goes_on.append(m[0].count("\n") < 2 and not lines[-1].rstrip().endswith((".", "!", "?")))
        at = m.end()
    lines.append(text[at:])
    goes_on.append(False)
    kept: dict[int, str] = {}
    seen: dict[int, tuple[str, dict[str, str], int, str] | None] = {}

    def plain(k: int) -> str:
        if k not in kept:
            kept[k] = "" if _ITEM.fullmatch(lines[k]) else normalised(lines[k])
        return kept[k]

    def begun(i: int) -> tuple[str, dict[str, str], int, str] | None:
        """The shortest known run of lines from one on: identifier, captures, the line after it, its text."""
        if i not in seen:
            seen[i] = None
            joined, k = plain(i), i
            if joined and _NEEDED.search(lines[i].lower()) and (found := identify(joined)):
                seen[i] = *found, i + 1, joined
            elif goes_on[i] and _START.match(joined):
                endless = _UNBOUNDED.match(joined)
                while goes_on[k] and plain(k + 1):
                    k += 1
                    joined += " " + plain(k)
                    endless = endless or _UNBOUNDED.match(joined)
                    if len(joined) > HEAD_CHARS + len(plain(k)):
                        if not endless:
                            break
                        if not _UNBOUNDED_END.search(plain(k)):
                            continue
                    if _NEEDED.search(joined) and (found := identify(joined)):
                        seen[i] = *found, k + 1, joined
                        break
        return seen[i]

    gap, i = False, 0
    while i < len(lines):
        if found := begun(i):
            name, got, i, joined = found
            k, tail = i, _PATTERN[name].pattern.endswith(".*")
            while name not in ONE_LINE and goes_on[k - 1] and plain(k) and not begun(k) and (tail or len(joined) <= HEAD_CHARS):
                k += 1
                if len(joined) <= HEAD_CHARS:
                    joined += " " + plain(k - 1)
                    if m := _PATTERN[name].fullmatch(joined):
                        got, i = {g: v for g, v in m.groupdict().items() if v}, k
                else:
                    i = k
            yield name, got
            gap = False
            continue
        if plain(i) and not gap:
            yield GAP, {}
            gap = True
        i += 1


def scan_text(text: str | None) -> tuple[list[str], list[str]]:
    """(licences in order, sentence identifiers in order) of a whole text."""
    if not text or not _NEEDED.search(text.lower()):
        return [], []
    ids = list(sentences_of(text))
    return match_rules(ids), [i for i, _ in ids if i != GAP]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_licences, licences, sentences): one row per row of docs; comma-joined, in text order, repeats included.

    Null and empty texts have none. Ids may be null or repeated. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [scan_text(x.as_py()) for x in b.column(1)]
            cols = pa.array([len(a) for a, _ in found], pa.int64()), pa.array([",".join(a) for a, _ in found], pa.string()), pa.array([",".join(s) for _, s in found], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], [id_col, "n_licences", "licences", "sentences"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))
    return picked.mapInArrow(rows, f"`{id_col}` {kind}, n_licences bigint, licences string, sentences string")
