"""License scans: ordered signature rules behind a keyword prefilter.

A text becomes its words (A-Z lower-cased; runs of digits, lower-case letters and characters beyond ASCII)
joined by single spaces. Each rule is a regular expression over that form and is filed under words one of which it
cannot do without, spellings joined with a version (``agplv3``) among them; a text runs only the rules of words
it holds. Every match is an interval of words. Matches
are taken in order of priority, and a match that lies inside one of a better priority, or inside a longer one
of its own, is suppressed; of equal intervals the first label stays.

Null and empty texts have no words and no labels. Rows never meet: repeated rows get equal results and null
ids pass through; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from boxlake.llm.common import LOWER, UPPER, slices

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, LOWER)

#: phrases whose places are counted as they are: fixed values
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Rule:
    label: str
    kind: str
    pattern: str
    keyword: str
    priority: int
    confidence: float


# family: (label, how its name is written as a pattern over words, a word that each spelling holds)
_NAMES = [
    ("mit", "mit|expat", None), ("apache-2", "(?:apache|apache software)(?: license)?(?: version)?(?: v)? ?2(?: 0)?", "apache"),
    ("apache-1.1", "apache(?: software)? license(?: version)? 1 1", "apache"), ("apache-1.0", "apache(?: software)? license(?: version)? 1 0", "apache"),
    ("gpl-3", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?", None), ("gpl-3", "gplv3", "gplv3"),
    ("gpl-2", "(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?", None), ("gpl-2", "gplv2", "gplv2"),
    ("gpl-1", "(?:gnu )?general public license version 1(?: 0)?", "general"), ("agpl-3", "(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", "affero"),
    ("agpl-3", "agpl ?v?3(?: 0)?", None), ("lgpl-3", "(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?", "lesser"),
    ("lgpl-2.1", "(?:gnu )?lesser general public license(?: version| v)? ?2 1", "lesser"), ("lgpl-2.1", "lgpl ?v?2 1", None),
    ("lgpl-2", "(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?", "library"), ("bsd-2", "(?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)", None),
    ("bsd-3", "(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)", "bsd"), ("bsd-4", "(?:bsd 4 clause|4 clause bsd|original bsd)", "bsd"),
    ("bsd-0", "(?:0bsd|zero clause bsd|bsd zero clause)", None), ("mpl-2", "(?:mozilla public license(?: version)?|mpl) ?v?2 0", None),
    ("mpl-1.1", "(?:mozilla public license(?: version)?|mpl) ?v?1 1", None), ("epl-2", "(?:eclipse public license(?: version)?|epl) ?v?2(?: 0)?", None),
    ("epl-1", "(?:eclipse public license(?: version)?|epl) ?v?1(?: 0)?", None), ("cddl-1", "(?:common development and distribution license(?: version)?|cddl) ?v?1(?: [01])?", None),
    ("cc0-1", "(?:cc0|creative commons zero)(?: 1 0)?", None), ("cc-by-nc-nd", "(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv\\w*)(?: 4 0| 3 0| 2 5| 2 0)?", None),
    ("cc-by-nc-sa", "(?:cc by nc sa|creative commons attribution non ?commercial share ?alike)(?: 4 0| 3 0| 2 5| 2 0)?", None),
    ("cc-by-nc", "(?:cc by nc|creative commons attribution non ?commercial)(?: 4 0| 3 0| 2 5| 2 0)?", None),
    ("cc-by-nd", "(?:cc by nd|creative commons attribution no ?deriv\\w*)(?: 4 0| 3 0| 2 5| 2 0)?", None),
    ("cc-by-sa", "(?:cc by sa|creative commons attribution share ?alike)(?: 4 0| 3 0| 2 5| 2 0)?", None),
    ("cc-by", "(?:cc by|creative commons attribution)(?: 4 0| 3 0| 2 5| 2 0)", None), ("isc", "isc", None), ("zlib", "zlib(?: libpng)?", "zlib"),
    ("unlicense", "unlicense", "unlicense"), ("wtfpl", "(?:wtfpl|do what the fuck you want to public license)", None),
    ("artistic-2", "artistic(?: license)?(?: version)? 2 0", "artistic"), ("artistic-1", "artistic(?: license)?(?: version)? 1 0", "artistic"),
    ("boost-1", "(?:boost software license(?: version)?|bsl) 1 0", None), ("python-2", "(?:python software foundation license|psf license)(?: version)?(?: 2)?", None),
    ("postgresql", "postgresql license", "postgresql"), ("openssl", "openssl license", "openssl"), ("ruby", "ruby license", "ruby"),
    ("php-3", "php license(?: version)? 3(?: 0\\d?)?", "php"), ("eupl-1.2", "(?:european union public licen[cs]e(?: version)?|eupl) ?v?1 2", None),
    ("osl-3", "open software license(?: version)? 3 0", "open"), ("ms-pl", "(?:microsoft public license|ms pl)", None),
    ("ncsa", "university of illinois ncsa open source license", "ncsa"), ("ofl-1.1", "(?:sil open font license(?: version)?|ofl) 1 1", None),
    ("gfdl-1.3", "(?:gnu free documentation license(?: version)?|gfdl) ?v?1 3", None), ("odbl-1", "(?:open database license|odbl)(?: 1 0)?", None),
    ("public-domain", "public domain", "domain"), ("proprietary", "(?:proprietary|commercial) license", None),
]
# sentence around a name: (kind, before, after, priority, confidence)
_FRAMES = [
    ("spdx", "spdx license identifier ", "", 1, 1.0),
    ("grant", "(?:this (?:work|software|program|file|code|project|document|content) is )?(?:licensed|released|distributed|published|available|provided) (?:under|with|by) (?:the )?(?:terms of (?:the )?)?(?:conditions of (?:the )?)?", "(?: (?:license|licence))?", 2, 0.95),
    ("terms", "under the terms (?:and conditions )?of (?:the )?", "(?: (?:license|licence))?", 3, 0.9),
    ("under", "under (?:the |an? )?", "(?: (?:license|licence))?", 4, 0.85),
    ("subject", "(?:subject to|governed by|covered by|see) (?:the )?", " (?:license|licence)", 5, 0.8),
    ("tagged", "(?:license|licence|licensed|licenses) ", "", 6, 0.7),
    ("named", "(?:the )?", " (?:license|licence)", 7, 0.6),
]
_BARE = {"cc-by-nc-nd", "cc-by-nc-sa", "cc-by-nc", "cc-by-sa", "cc-by-nd", "cc0-1", "gpl-3", "gpl-2", "lgpl-3", "agpl-3", "apache-2", "mpl-2"}
_TEXTS = [  # sentences from license bodies and notices
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "hereby"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "lesser"),
    ("apache-2", "you may not use this file except in compliance with the license", "compliance"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "authors"),
    ("boost-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "organization"),
    ("all-rights-reserved", "all rights reserved", "reserved"), ("gpl", "gnu general public license", "gnu"),
    ("lgpl", "gnu lesser general public license", "lesser"), ("agpl", "gnu affero general public license", "affero"),
]


def _keywords(pattern: str, fixed: str | None) -> list[str]:
    """Words one of which any match holds: the given one, or one literal word of each alternative, and each of
    them joined with a version where the pattern takes that."""
    words, name = [fixed] if fixed else _literals(pattern), re.compile(f"(?:{pattern})")
    tails = ["", *(f" {d}" for d in range(10))]
    return words + [f"{w}{v}{d}" for w in dict.fromkeys(words) for v in ("", "v") for d in range(10)
                    if any(name.fullmatch(f"{w}{v}{d}{t}") for t in tails)]


def _literals(pattern: str) -> list[str]:
    """One literal word of each alternative."""
    body = pattern
    inner = re.match(r"^(?:\(\?:gnu \)\?)?\(\?:(.*?)\)(?=$| |\(|\?)", pattern)
    if inner and "|" in inner[1]:
        body = inner[1]
    words = []
    for alternative in body.split("|"):
        plain = re.sub(r"\(\?:[^()]*\)\?|\\\w.?|.\?", " ", alternative)
        found = [w for w in re.findall(r"[a-z0-9]{2,}", plain) if w not in {"license", "public", "version", "open", "software"}]
        words.append(max(found, key=len) if found else re.findall(r"[a-z0-9]+", alternative)[0])
    return words


def build_rules() -> list[Rule]:
    """Phrases first, then body sentences, then every name in every frame; a lower priority number wins."""
    rules = [Rule(label, "phrase", phrase, phrase.split()[-2] if label != "cc-by-nc" else "nc", 0, 0.9)
             for phrase, label in BASE_PHRASES.items()]
    rules += [Rule(label, "text", text, keyword, *((1, 0.95) if len(text.split()) > 5 else (9, 0.5))) for label, text, keyword in _TEXTS]
    for label, name, fixed in _NAMES:
        frames = _FRAMES + ([("bare", "", "", 8, 0.5)] if label in _BARE else [])
        for keyword in dict.fromkeys(_keywords(name, fixed)):
            rules += [Rule(label, kind, f"{before}(?:{name}){after}", keyword, priority, confidence)
                      for kind, before, after, priority, confidence in frames]
    return rules


RULES = build_rules()


class Scanner:
    """Compiled rules by keyword."""

    def __init__(self, rules: Sequence[Rule] = RULES):
        self.by_word: dict[str, list[tuple[Rule, re.Pattern]]] = {}
        compiled = {p: re.compile(f"(?<![^ ])(?:{p})(?![^ ])") for p in dict.fromkeys(r.pattern for r in rules)}
        for r in rules:
            self.by_word.setdefault(r.keyword, []).append((r, compiled[r.pattern]))
        self.phrases = [(f" {p} ", label) for p, label in BASE_PHRASES.items()]

    def base(self, words: list[str]) -> list[tuple[int, str]]:
        """(first word, label) of every place of a base phrase."""
        text, found = f" {' '.join(words)} ", []
        for phrase, label in self.phrases:
            at = text.find(phrase)
            while at >= 0:
                found.append((text.count(" ", 0, at), label))
                at = text.find(phrase, at + 1)
        return sorted(found)

    def detect(self, words: list[str]) -> list[tuple[int, int, Rule]]:
        """Matches that survive, as (first word, end word, rule) in order of place."""
        rules = [x for w in self.by_word.keys() & set(words) for x in self.by_word[w]]
        if not rules:
            return []
        text = " ".join(words)
        found = [(m.start(), m.end(), r) for r, p in rules for m in p.finditer(text)]
        taken: list[tuple[int, int, Rule]] = []
        for priority in sorted({r.priority for _, _, r in found}):
            # ends of taken matches, so far by start: a match lies inside one of them if the largest is not before its end
            starts = sorted((a, b) for a, b, _ in taken)
            reach = list(accumulate((b for _, b in starts), max))
            starts, furthest = [a for a, _ in starts], -1
            for a, b, r in sorted((x for x in found if x[2].priority == priority),
                                  key=lambda x: (x[0], -x[1], x[2].label, x[2].pattern)):
                k = bisect_right(starts, a)
                if b > furthest and not (k and reach[k - 1] >= b):
                    taken.append((a, b, r))
                    furthest = b
        return sorted(((text.count(" ", 0, a), text.count(" ", 0, b) + 1, r) for a, b, r in taken), key=lambda x: (x[0], x[1], x[2].label))


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(_LOWER))


DETECTION = StructType([StructField("first", LongType()), StructField("end", LongType()), StructField("label", StringType()),
                        StructField("kind", StringType()), StructField("confidence", DoubleType())])


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """Columns ``keep`` with n_words, base (places of base phrases) and detections (word intervals that survive)."""
    chosen = docs.select(*keep, F.col(text).alias("_text"))
    place = StructType([StructField("first", LongType()), StructField("label", StringType())])
    schema = StructType([chosen.schema[i] for i in range(len(keep))] + [
        StructField("n_words", LongType()), StructField("base", ArrayType(place)), StructField("detections", ArrayType(DETECTION))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        bases = pa.list_(pa.struct([("first", pa.int64()), ("label", pa.string())]))
        spans = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("kind", pa.string()), ("confidence", pa.float64())]))
        for b in slices(batches, "_text"):
            all_words = [words_of(t or "") for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                *b.columns[:len(keep)], pa.array([len(w) for w in all_words], pa.int64()),
                pa.array([[{"first": i, "label": x} for i, x in scanner.base(w)] for w in all_words], bases),
                pa.array([[{"first": i, "end": j, "label": r.label, "kind": r.kind, "confidence": r.confidence}
                           for i, j, r in scanner.detect(w)] for w in all_words], spans),
            ], [*keep, "n_words", "base", "detections"])

    return chosen.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: counts, first and last place, labels, and the highest confidence as score."""
    places = F.col("base.first")
    mine, theirs = F.col("base.label"), F.col("detections.label")
    listed = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return scan(docs).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"), listed(mine).alias("base_labels"), listed(F.concat(mine, theirs)).alias("labels"),
        F.greatest(F.coalesce(F.array_max("detections.confidence"), F.lit(0.0)),
                   F.when(F.size("base") > 0, 0.9).otherwise(0.0)).alias("score"))
