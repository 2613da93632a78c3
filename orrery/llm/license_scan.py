"""Licence scans: fuzzy search for short notices.

Each notice may have up to a bounded number of edits (EDIT_SHARE of its letters). It is split into one
more piece than that, so that by the pigeonhole principle a text with the notice has one of the pieces
exactly. An Aho-Corasick automaton over all pieces finds those seeds in one pass over the words,
lower-cased and joined by single spaces; around each seed the regex library matches the notice with the bounded
number of errors and reports the best span and its edits, so the work at a seed is bounded. Before that, exact phrases give the base labels.

Edge cases: null or empty text has no words, no labels and score 0; a text of one huge word is one word;
repeated rows are scanned each; null ids stay null; places of a phrase that overlap all count; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from orrery.llm.common import arrow_map
from orrery.llm.decontam import words_of

#: Phrases and the labels that they give (fixed values of the contract).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices, as words, and the labels that they give.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache",
    "released under the mit license": "mit",
    "licensed under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "licensed under the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the mozilla public license": "mpl",
    "subject to the terms of the mozilla public license": "mpl",
    "eclipse public license": "epl",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under a creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
    "proprietary and confidential": "proprietary",
}
#: Edits allowed for each letter of a notice, and the shortest piece that may be a seed.
EDIT_SHARE, LEAST_PIECE = 1 / 10, 7


def _pieces(notice: str, edits: int) -> list[str]:
    """notice split into edits + 1 pieces of nearly equal length."""
    n = edits + 1
    cuts = [len(notice) * i // n for i in range(n + 1)]
    return [notice[a:b] for a, b in zip(cuts, cuts[1:])]


class Scanner:
    def __init__(self, notices: dict[str, str] | None = None, phrases: dict[str, str] | None = None):
        self.phrases = [(f" {p} ", label, p.count(" ") + 1) for p, label in (PHRASES if phrases is None else phrases).items()]
        self.notices, seeds = [], {}
        for notice, label in (NOTICES if notices is None else notices).items():
            edits = max(1, int(len(notice) * EDIT_SHARE))
            while len(notice) // (edits + 1) < LEAST_PIECE and edits:
                edits -= 1
            k, at = len(self.notices), 0
            pattern = regex.compile(rf"(?b)\b(?:{regex.escape(notice)}){{e<={edits}}}\b")
            self.notices.append((notice, label, edits, pattern))
            for p in _pieces(notice, edits):
                seeds.setdefault(p, []).append((k, at))
                at += len(p)
        self.automaton = ahocorasick.Automaton()
        for p, where in seeds.items():
            self.automaton.add_word(p, (len(p), where))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        if not words:
            return {"n_words": 0, "base": [], "spans": []}
        flat = b" ".join(words).decode()
        starts = list(accumulate((len(w) + 1 for w in flat.split(" ")), initial=0))[:-1]  # of the words
        padded = f" {flat} "
        base = []
        for phrase, label, _ in self.phrases:
            at = padded.find(phrase)
            while at >= 0:
                base.append((bisect_left(starts, at), label))
                at = padded.find(phrase, at + 1)
        # Where a notice may begin by one of its pieces. Places that no more than its edits part are searched as one.
        places: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(flat):
            for k, at in where:
                places.setdefault(k, []).append(end + 1 - size - at)
        spans = []
        for k, found in places.items():
            notice, label, edits, pattern = self.notices[k]
            found.sort()
            first = last = found[0]
            for place in (*found[1:], None):
                if place is not None and place <= first + 2 * edits:
                    last = place
                    continue
                if first == last and padded.startswith(f" {notice} ", first):  # nothing to look for
                    a = bisect_left(starts, first)
                    spans.append((a, a + notice.count(" ") + 1, label, 0, 1.0))
                    first = last = place
                    continue
                low, high = max(0, first - edits - 1), min(len(flat), last + len(notice) + edits + 1)
                first = last = place
                if m := pattern.search(flat, low, high):
                    s, e = m.span()
                    s, e = s + len(m.group()) - len(m.group().lstrip()), e - len(m.group()) + len(m.group().rstrip())
                    if (s and flat[s - 1] != " ") or (e < len(flat) and flat[e] != " "):  # the window's end isn't a word's
                        continue
                    errors = sum(m.fuzzy_counts)
                    spans.append((bisect_right(starts, s) - 1, bisect_right(starts, e - 1), label, errors, 1 - errors / len(notice)))
        return {"n_words": len(words), "base": sorted(base), "spans": _best(sorted(set(spans)))}


def _best(spans: list[tuple]) -> list[tuple]:
    """spans (sorted) without those with edits that lie within a span, at least as long, that has fewer."""
    out = []
    ends: dict[int, int] = {}  # for each number of edits, the furthest end of spans that start here or before
    i = 0
    while i < len(spans):
        j = i
        while j < len(spans) and spans[j][0] == spans[i][0]:
            ends[spans[j][3]] = max(ends.get(spans[j][3], 0), spans[j][1])
            j += 1
        for s in spans[i:j]:
            if not any(edits < s[3] and end >= s[1] for edits, end in ends.items()):
                out.append(s)
        i = j
    return out


_SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<first:long,end:long,label:string,edits:long,similarity:double>>"
)


@functools.cache
def _scanner() -> Scanner:
    return Scanner()


def _batch(b: pa.RecordBatch) -> pa.RecordBatch:
    scanner = _scanner()
    rows = []
    for t in b.column("text").to_pylist():
        r = scanner.scan(t)
        base, spans = r["base"], r["spans"]
        mine = sorted({x for _, x in base})
        rows.append((
            r["n_words"], len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(mine),
            ",".join(sorted({*mine, *(s[2] for s in spans)})), 1.0 if base else max((s[4] for s in spans), default=0.0),
            [dict(zip(("first", "end", "label", "edits", "similarity"), s)) for s in spans],
        ))
    kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("similarity", pa.float64())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """Base places and labels, the notices found with their word spans and edits, and a score, of every row of docs (doc_id, text).

    score: 1 where a phrase stands exactly, else the similarity of the best notice, else 0.
    """
    return arrow_map(docs.select("doc_id", "text"), _batch, _SCHEMA)
