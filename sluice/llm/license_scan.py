"""License scan: ordered signature rules over the words of whole texts.

A rule is a regular expression with a label, a weight and the keywords of which one must be among
the text's words before the expression is tried.  Rules come in order of priority; a detection whose interval
lies inside that of an accepted rule of higher priority is dropped, so "gnu lesser general public license"
is not also reported as the shorter notices inside it.

Words are the runs of characters outside ASCII punctuation and blanks after A-Z became a-z.  Base phrases are counted
wherever their words stand consecutively, whatever the rules say; their labels always stay.
NULL and empty texts have no words and no labels; score is 0 for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from sluice.llm.base import Sender, query, rows, table, text_bytes

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label; names a notice may use (regular expressions over words); keywords.
LICENSES = [
    ("agpl-3.0", r"(?:gnu )?affero general public license|agpl", "affero agpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public license|lgpl", "lesser library lgpl"),
    ("gfdl", r"(?:gnu )?free documentation license|gfdl", "documentation gfdl"),
    ("gpl-3.0", r"(?:gnu )?general public license (?:version |v ?)?3|gplv3|gpl (?:version |v ?)?3", "general gplv3 gpl"),
    ("gpl-2.0", r"(?:gnu )?general public license (?:version |v ?)?2|gplv2|gpl (?:version |v ?)?2", "general gplv2 gpl"),
    ("gpl", r"(?:gnu )?general public license|gpl", "general gpl"),
    ("apache-2.0", r"apache (?:software )?license,? (?:version |v ?)?2(?: 0)?|apache 2 0|asl 2 0", "apache asl"),
    ("apache-1.1", r"apache (?:software )?license (?:version |v ?)?1 1|apache 1 1", "apache"),
    ("apache", r"apache (?:software )?license", "apache"),
    ("mit", r"mit license|expat license|mit x11 license|x11 license", "mit expat x11"),
    ("mit-0", r"mit no attribution|mit 0", "mit"),
    ("bsd-4-clause", r"(?:4|four) clause bsd(?: license)?|bsd 4 clause|original bsd license", "bsd"),
    ("bsd-3-clause", r"(?:3|three) clause bsd(?: license)?|bsd 3 clause|new bsd license|modified bsd license", "bsd"),
    ("bsd-2-clause", r"(?:2|two) clause bsd(?: license)?|bsd 2 clause|simplified bsd license|freebsd license", "bsd freebsd"),
    ("0bsd", r"zero clause bsd|0bsd", "bsd 0bsd"),
    ("bsd", r"bsd license|berkeley software distribution license", "bsd berkeley"),
    ("mpl-2.0", r"mozilla public license (?:version |v ?)?2(?: 0)?|mpl 2 0", "mozilla mpl"),
    ("mpl-1.1", r"mozilla public license (?:version |v ?)?1 1|mpl 1 1", "mozilla mpl"),
    ("mpl", r"mozilla public license", "mozilla"),
    ("epl-2.0", r"eclipse public license (?:version |v ?)?2(?: 0)?|epl 2 0", "eclipse epl"),
    ("epl-1.0", r"eclipse public license(?: (?:version |v ?)?1(?: 0)?)?|epl 1 0", "eclipse epl"),
    ("cddl-1.0", r"common development and distribution license|cddl", "distribution cddl"),
    ("cpl-1.0", r"common public license", "common"),
    ("eupl-1.2", r"european union public licen[cs]e|eupl", "european eupl"),
    ("isc", r"isc license|internet systems consortium license", "isc consortium"),
    ("zlib", r"zlib license|zlib libpng license", "zlib"),
    ("libpng", r"(?:png reference library|libpng) license", "png libpng"),
    ("bsl-1.0", r"boost software license", "boost"),
    ("busl-1.1", r"business source license", "business"),
    ("sspl-1.0", r"server side public license|sspl", "server sspl"),
    ("elastic-2.0", r"elastic license(?: 2 0)?", "elastic"),
    ("artistic-2.0", r"artistic license (?:version |v ?)?2(?: 0)?", "artistic"),
    ("artistic-1.0", r"artistic license", "artistic"),
    ("perl", r"same terms as perl(?: itself)?", "perl"),
    ("python-2.0", r"python software foundation license|psf license", "python psf"),
    ("php-3.01", r"php license", "php"),
    ("ruby", r"ruby license", "ruby"),
    ("w3c", r"w3c software (?:notice and )?license", "w3c"),
    ("unlicense", r"the unlicense|unlicense org", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public license|wtfpl", "wtfpl fuck"),
    ("ofl-1.1", r"(?:sil )?open font license|ofl 1 1", "font ofl"),
    ("odbl-1.0", r"open database license|odbl", "database odbl"),
    ("odc-by", r"open data commons attribution license|odc by", "commons odc"),
    ("pddl-1.0", r"public domain dedication and license|pddl", "dedication pddl"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?|creative commons zero", "cc0 zero"),
    ("cc-by-nc-nd", r"cc by nc nd(?: \d 0)?|creative commons attribution non ?commercial no ?deriv(?:atives|s)", "cc creative"),
    ("cc-by-nc-sa", r"cc by nc sa(?: \d 0)?|creative commons attribution non ?commercial share ?alike", "cc creative"),
    ("cc-by-nc", r"cc by nc(?: \d 0)?|creative commons attribution non ?commercial", "cc creative"),
    ("cc-by-nd", r"cc by nd(?: \d 0)?|creative commons attribution no ?deriv(?:atives|s)", "cc creative"),
    ("cc-by-sa", r"cc by sa(?: \d 0)?|creative commons attribution share ?alike", "cc creative"),
    ("cc-by-4.0", r"cc by 4 0|creative commons attribution 4 0(?: international)?", "cc creative"),
    ("cc-by-3.0", r"cc by 3 0|creative commons attribution 3 0(?: unported)?", "cc creative"),
    ("cc-by", r"cc by|creative commons attribution", "cc creative"),
    ("ms-pl", r"microsoft public license|ms pl", "microsoft ms"),
    ("ms-rl", r"microsoft reciprocal license|ms rl", "microsoft ms"),
    ("osl-3.0", r"open software license", "open"),
    ("afl-3.0", r"academic free license", "academic"),
    ("ecl-2.0", r"educational community license", "educational"),
    ("ncsa", r"university of illinois ncsa open source license|ncsa license", "ncsa"),
    ("upl-1.0", r"universal permissive license", "permissive"),
    ("vim", r"vim license", "vim"),
    ("openssl", r"openssl license|openssl toolkit", "openssl"),
    ("curl", r"curl license", "curl"),
    ("postgresql", r"postgresql license", "postgresql"),
    ("json", r"json license|software shall be used for good not evil", "json evil"),
    ("beerware", r"beer ?ware license", "beer beerware"),
    ("cecill", r"cecill(?: (?:a|b|c))?(?: license)?", "cecill"),
    ("llama", r"llama (?:\d )?community license", "llama"),
    ("openrail", r"open ?rail(?: m)?|responsible ai license", "openrail rail responsible"),
    ("proprietary", r"all rights reserved(?: worldwide)?|proprietary and confidential", "rights proprietary"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "domain"),
]

# How a name is used in a notice, from the surest form down; {n} stands for the name.
FORMS = [
    (r"spdx license identifier (?:{n})", 1.0),
    (r"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n})", 0.95),
    (r"(?:subject to|in accordance with|governed by|under) (?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:{n})", 0.85),
    (r"(?:see|read|copy of) (?:the )?(?:full )?(?:{n})", 0.8),
    (r"(?:{n})", 0.6),
]

# Sentences of the license texts themselves: label, expression, keywords, weight.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "permission", 0.95),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", "permission", 0.95),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", "redistribution", 0.9),
    ("bsd-3-clause", r"neither the name of .{1,80}? nor the names of its contributors", "neither", 0.9),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software", "advertising", 0.9),
    ("gpl", r"this program is free software you can redistribute it and or modify it", "redistribute", 0.9),
    ("gpl", r"this program is distributed in the hope that it will be useful but without any warranty", "hope", 0.85),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", "library", 0.9),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance", 0.9),
    ("apache-2.0", r"apache org licenses license 2 0", "apache", 0.95),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public license", "mozilla", 0.95),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", "express", 0.85),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining", "permission", 0.95),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered", 0.95),
    ("wtfpl", r"you just do what the fuck you want to", "fuck", 0.9),
    ("cc0-1.0", r"creativecommons org publicdomain zero", "creativecommons", 0.95),
    ("cc-by", r"creativecommons org licenses by(?! )", "creativecommons", 0.8),
    ("cc-by-4.0", r"creativecommons org licenses by 4 0", "creativecommons", 0.95),
    ("cc-by-sa", r"creativecommons org licenses by sa", "creativecommons", 0.95),
    ("cc-by-nc", r"creativecommons org licenses by nc", "creativecommons", 0.9),
]

_OTHER = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122 or 65 <= c <= 90))
_FOLD = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                  ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
                  ("detections", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()),
                                                     ("words", pa.int64()), ("weight", pa.float64())])))])
_OUT_DDL = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
            "score double, detections array<struct<label string, first_word long, words long, weight double>>")


@lru_cache(1)
def rules() -> tuple[list[tuple], frozenset[bytes]]:
    """(label, expression, keywords, weight) by falling priority, and all keywords."""
    listed = [(label, text, words, weight) for label, text, words, weight in SENTENCES]
    for form, weight in FORMS:
        for label, name, words in LICENSES:
            if form is FORMS[0][0]:
                # Labels are written like SPDX identifiers.
                name, words = f"{name}|{re.sub('[-.]', ' ', label)}(?: only| or later)?", f"{words} spdx"
            listed.append((label, form.replace("{n}", name), words, weight))
    made = [(label, re.compile(rb"(?<![^ ])(?:" + text.encode() + rb")(?![^ ])"), frozenset(words.encode().split()), weight)
            for label, text, words, weight in listed]
    return made, frozenset().union(*(m[2] for m in made))


def base_places(line: bytes) -> list[tuple[int, str]]:
    """(start word, label) of every place of a base phrase; ``line``: words joined by one space."""
    found = []
    padded = b" " + line + b" "
    for phrase, label in BASE.items():
        wanted = b" " + phrase.encode() + b" "
        at = padded.find(wanted)
        while at >= 0:
            found.append((padded.count(b" ", 0, at), label))
            at = padded.find(wanted, at + 1)
    return found


def detect(line: bytes, words: list[bytes]) -> list[tuple[int, int, str, float]]:
    """(start byte, end byte, label, weight) of the rules' detections that no accepted one contains."""
    made, keys = rules()
    present = keys.intersection(words)
    if not present:
        return []
    accepted: list[tuple[int, int, str, float]] = []
    for label, expression, keywords, weight in made:
        if keywords.isdisjoint(present):
            continue
        for hit in expression.finditer(line):
            a, b = hit.span()
            if not any(x <= a and b <= y for x, y, _, _ in accepted):
                accepted.append((a, b, label, weight))
    return accepted


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    send = Sender(_OUT)
    for doc_id, text in rows(batches):
        words = text.translate(_FOLD).split()
        line = b" ".join(words)
        base = base_places(line)
        found = detect(line, words)
        named = sorted({label for _, label in base})
        doubt = 1.0
        for _, _, _, weight in found:
            doubt *= 1.0 - weight
        for _ in named if not found else ():
            doubt *= 0.4
        starts = [at for at, _ in base]
        spans = [{"label": x, "first_word": line.count(b" ", 0, a), "words": line.count(b" ", a, b) + 1, "weight": w}
                 for a, b, x, w in sorted(found)]
        row = (doc_id, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(named),
               ",".join(sorted({*named, *(x for _, _, x, _ in found)})), min(1.0, max(0.0, 1.0 - doubt)), spans)
        if send.add(row):
            yield send.take()
    yield send.take()


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), with the detections as spans of words."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("text")).mapInArrow(_scan, _OUT_DDL)


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
