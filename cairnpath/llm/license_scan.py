"""License scans with a positional index of rare tokens.

Templates are notices and whole texts of licences; every word of them is indexed with its places. Of the words that a file
shares with a template, those with the highest IDF in the scanned corpus are looked up: each place proposes where in the
file the template would start. Where enough rare words agree, within some words' drift, the template is laid on the file:
its mandatory key phrases must stand word for word near their places, and most of its other words must be there too. So a
changed name or a left-out sentence does no harm, and a key phrase by itself is no licence.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnpath.llm.common import whole

#: Rare words that are looked up, their share that must agree on a place, the share of a template's words that must be there, and by how many words a place may be off for each ten of the template.
RARE, AGREE, COVER, DRIFT = 6, 0.6, 0.75, 1
#: Phrases that are always looked for, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Label, wording of a notice or licence, and its mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license", ["the mit license"]),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge", "sublicense and or sell copies of the software"],
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    (
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["apache license version 2 0", "unless required by applicable law or agreed to in writing"],
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        ["gnu general public license as published by the free software foundation"],
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        ["redistribution and use in source and binary forms", "must retain the above copyright notice"],
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ["mozilla public license v 2 0"]),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ["use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented",
        ["the origin of this software must not be misrepresented"],
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software released into the public domain"]),
    ("proprietary", "proprietary and confidential unauthorized copying of this file is strictly prohibited", ["unauthorized copying of this file"]),
]
#: Bytes that part words become spaces, A-Z lower case.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES).split()


def _vocabulary() -> set[bytes]:
    return {w.encode() for _, wording, _ in TEMPLATES for w in wording.split()}


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known, seen, n = _vocabulary(), Counter(), 0
    for batch in batches:
        for text in batch.column(0):
            seen.update(known.intersection(words(text.as_py())))
            n += 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in seen)]), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])


def document_frequencies(docs: DataFrame) -> dict[str, int]:
    """In how many rows each template word stands, and under the empty word the number of rows; as many entries as templates have words."""
    counts = docs.select(whole("text").alias("text")).mapInArrow(_document_counts, "word string, n long")
    return {w: n for w, n in counts.groupBy("word").agg(F.sum("n")).collect()}


class Template:
    """One wording: its words with their places, rarest first, and its key phrases with theirs."""

    def __init__(self, label: str, wording: str, keys: list[str], idf: dict[bytes, float]):
        self.label, self.words = label, [w.encode() for w in wording.split()]
        self.places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(self.words):
            self.places[w].append(i)
        self.rarest = sorted(self.places, key=lambda w: (-idf[w], w))
        self.counts = Counter(self.words)
        phrases = [[w.encode() for w in key.split()] for key in keys]
        self.keys = [(p, next(i for i in range(len(self.words)) if self.words[i : i + len(p)] == p)) for p in phrases]
        self.must = {w for p in phrases for w in p}
        self.drift = len(self.words) // 10 * DRIFT

    def starts(self, places: dict[bytes, list[int]]) -> list[int]:
        """Where in a file the template may start, given the places of the file's words: where its rarest words agree."""
        rare = [w for w in self.rarest if w in places][:RARE]
        need = max(1, math.ceil(AGREE * len(rare)))
        votes = sorted((i - o, k) for k, w in enumerate(rare) for o in self.places[w] for i in places[w])
        out, agreed, low = [], Counter(), 0
        for start, k in votes:
            agreed[k] += 1
            while votes[low][0] < start - 2 * self.drift:
                agreed[votes[low][1]] -= 1
                low += 1
            if sum(n > 0 for n in agreed.values()) >= need and (not out or (votes[low][0] + start) // 2 > out[-1]):
                out.append((votes[low][0] + start) // 2)
        return out

    def laid(self, found: list[bytes], start: int) -> float:
        """The share of the template's words that a file has about a place; 0 without its key phrases."""
        for phrase, at in self.keys:
            n, first = len(phrase), start + at
            if not any(found[i : i + n] == phrase for i in range(max(0, first - self.drift), first + self.drift + 1)):
                return 0.0
        here = Counter(found[max(0, start - self.drift) : max(0, start + len(self.words) + self.drift)])
        return sum(min(n, here[w]) for w, n in self.counts.items()) / len(self.words)


class Index:
    """The templates, with the IDF of their words, and the phrases that are always looked for."""

    def __init__(self, frequencies: dict[str, int]):
        n = frequencies.get("", 0)
        idf = {w: math.log((n + 1) / (frequencies.get(w.decode(), 0) + 1)) for w in _vocabulary()}
        self.templates = [Template(*t, idf) for t in TEMPLATES]
        self.vocabulary = frozenset(idf)
        self.base = [([w.encode() for w in phrase.split()], label) for phrase, label in BASE.items()]
        #: The word of each base phrase that is looked for, and its place in it.
        self.anchors = {b"cc": (0, 0), b"public": (1, 1), b"rights": (2, 1)}

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score."""
        found = words(text)
        shared = self.vocabulary.intersection(found)
        likely = [t for t in self.templates if t.must <= shared]
        looked = (self.anchors.keys() & shared).union(*(t.places.keys() & shared for t in likely))
        places: dict[bytes, list[int]] = defaultdict(list)
        if looked:
            for i, w in enumerate(found):
                if w in looked:
                    places[w].append(i)
        starts, base = [], set()
        for w in self.anchors.keys() & shared:
            (phrase, label), ahead = self.base[self.anchors[w][0]], self.anchors[w][1]
            hits = [i - ahead for i in places[w] if i >= ahead and found[i - ahead : i - ahead + len(phrase)] == phrase]
            if hits:
                starts += hits
                base.add(label)
        labels, score = set(base), 1.0 if base else 0.0
        for t in likely:
            best = 0.0
            for start in t.starts({w: places[w] for w in t.places.keys() & shared}):
                best = max(best, t.laid(found, start))
                if best == 1.0:
                    break
            if best >= COVER:
                labels.add(t.label)
                score = max(score, best)
        return len(found), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null counts as the empty text, which has no words and no labels. score is the share of the best template's words that
    stand about their places, 1 with a base phrase, 0 without any label. Repeated rows are repeated; an empty table gives no
    rows; further columns are ignored.
    """
    frequencies = document_frequencies(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(frequencies)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            rows = [index.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), whole("text").alias("text")).mapInArrow(run, SCHEMA)
