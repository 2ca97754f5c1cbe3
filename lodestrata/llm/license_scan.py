"""License scans by a positional index of rare tokens.

Templates are word sequences. An inverted index maps each template's rarest words (highest inverse
document frequency, counted over every document of the corpus) and the rarest of its first key phrase to
their positions in it. In a file each place of the latter proposes an alignment, which is verified:
every mandatory key phrase of the template must stand there word for word. This alone decides, so
that edits elsewhere in a notice don't hide it. The template's other indexed words are then met by
relative position, rarest first: each that stands a few words off its place at most shifts the
alignment for those that follow, as edits do, and counts as support. Of the template's words those
that stand about where the shifted alignment has them are its coverage, which is the score. A
template whose words are its only key phrase is matched exactly, at all places.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm.common import short, table

#: Words of an ASCII-lowered UTF-8 text: digits, letters and everything beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Rarest words of a template that the index holds.
INDEXED_WORDS = 8
#: Words by which a longer template's parts may be shifted against each other.
SLACK = 4


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    phrases: tuple[str, ...]
    base: bool = False


#: Phrases whose every place counts.
BASE = (
    Template("cc-by", "cc by", ("cc by",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("reserved", "all rights reserved", ("all rights reserved",), True),
)
#: Notices in common use, each with the phrases that must be there.
NOTICES = (
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    Template("gnu-gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", ("permission to use copy modify and or distribute this software",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("permission is hereby granted free of charge",)),
    Template("mpl", "subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("unlicense", "free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Headers and bodies as they stand in files, longer than a line.
BODIES = (
    Template("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("terms of the gnu affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("you may not use this file except in compliance with the license",)),
    Template("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("any person or organization obtaining a copy of the software",)),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form must reproduce the above copyright notice",)),
    Template("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", ("dedicated the work to the public domain",)),
    Template("gnu-gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("terms of the gnu general public license",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", ("terms of the gnu lesser general public license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", ("to deal in the software without restriction",)),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ("if a copy of the mpl was not distributed with this file",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ("the authors be held liable for any damages arising from the use of this software",)),
)
TEMPLATES = BASE + NOTICES + BODIES


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered; null and empty texts have none."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class PositionalIndex:
    """Postings of rare words: word -> [(template, position, rank of rarity in the template)]."""

    def __init__(self, templates: Sequence[Template], idf: Mapping[bytes, float], indexed: int = INDEXED_WORDS) -> None:
        self.templates = list(templates)
        self.words = [words_of(t.words) for t in templates]
        self.rare: list[list[bytes]] = []
        self.at: list[dict[bytes, list[int]]] = []
        self.phrases = []
        self.anchor: list[tuple[bytes, int]] = []
        for t, words in zip(self.templates, self.words, strict=True):
            ranked = sorted(set(words), key=lambda w: (-idf.get(w, math.inf), w))
            self.rare.append(ranked[:indexed])
            places = defaultdict(list)
            for i, w in enumerate(words):
                places[w].append(i)
            self.at.append(dict(places))
            keys = []
            for phrase in t.phrases:
                key = words_of(phrase)
                start = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
                keys.append((start, key))
            self.phrases.append(keys)
            start, key = keys[0]
            i = min(range(len(key)), key=lambda i: ranked.index(key[i]))
            self.anchor.append((key[i], start + i))
            if key[i] not in self.rare[-1]:
                self.rare[-1].append(key[i])
        self.vocabulary = frozenset(w for rare in self.rare for w in rare)

    def scan(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """Verified places: (template, start word, coverage)."""
        present = self.vocabulary.intersection(words)
        if not present:
            return []
        postings = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                postings[w].append(i)
        found = []
        for k, rare in enumerate(self.rare):
            own = [w for w in rare if w in present]
            if not own or self.templates[k].base and len(own) < len(rare):
                continue
            found += self._base(k, own, postings, words) if self.templates[k].base else self._notice(k, own, postings, words)
        return found

    def _base(self, k: int, own: list[bytes], postings: Mapping[bytes, list[int]], words: list[bytes]) -> list[tuple[int, int, float]]:
        starts = None
        for w in own:
            here = {p - t for p in postings[w] for t in self.at[k][w]}
            starts = here if starts is None else starts & here
            if not starts:
                return []
        size = len(self.words[k])
        return [(k, s, 1.0) for s in sorted(starts) if s >= 0 and words[s : s + size] == self.words[k]]

    def _notice(self, k: int, own: list[bytes], postings: Mapping[bytes, list[int]], words: list[bytes]) -> list[tuple[int, int, float]]:
        word, offset = self.anchor[k]
        (first, key), *others = self.phrases[k]
        starts = [s for p in postings.get(word, ()) if (s := p - offset) + first >= 0 and words[s + first : s + first + len(key)] == key]
        starts = [s for s in starts if all(any(words[p : p + len(key)] == key for d in range(-SLACK, SLACK + 1) if (p := s + at + d) >= 0) for at, key in others)]
        if not starts:
            return []
        found = []
        for s in starts:
            shifts = self._shifts(k, s, own, postings)
            found.append((k, max(0, s), self._coverage(k, s, shifts, words)))
        return found

    def _shifts(self, k: int, start: int, own: list[bytes], postings: Mapping[bytes, list[int]]) -> list[tuple[int, int]]:
        """(position in the template, shift there) of its indexed words found near their places, by position.

        Words are met rarest first; each is looked for around where the nearest word met so far puts it.
        """
        (first, key), *_ = self.phrases[k]
        met = [(first, 0), (first + len(key) - 1, 0)]
        for w in own:
            for t in self.at[k][w]:
                shift = min(met, key=lambda m: abs(m[0] - t))[1]
                held, place = postings[w], start + t + shift
                i = bisect.bisect_left(held, place - SLACK)
                near = [p for p in held[i : i + 2 * SLACK + 1] if p <= place + SLACK]
                if near:
                    met.append((t, min(near, key=lambda p: abs(p - place)) - start - t))
        return sorted(met)

    def _coverage(self, k: int, start: int, shifts: list[tuple[int, int]], words: list[bytes]) -> float:
        """Share of the template's words that stand within the slack of their shifted places, each place used once."""
        own, used, at, hits = self.words[k], set(), 0, 0
        for t, w in enumerate(own):
            while at + 1 < len(shifts) and shifts[at + 1][0] <= t:
                at += 1
            place = start + t + shifts[at][1]
            for p in sorted(range(max(0, place - SLACK), min(len(words), place + SLACK + 1)), key=lambda p: abs(p - place)):
                if p not in used and words[p] == w:
                    used.add(p)
                    hits += 1
                    break
        return hits / len(own)


def word_idf(docs: DataFrame, templates: Sequence[Template] = TEMPLATES, text_col: str = "text") -> dict[bytes, float]:
    """Inverse document frequency of the templates' words over all of ``docs``.

    What comes to the driver has at most one row for each distinct word of the templates.
    """
    vocabulary = frozenset(w for t in templates for w in words_of(t.words))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        n = 0
        for batch in short(batches):
            n += len(batch)
            for text in batch["text"]:
                seen.update(vocabulary.intersection(words_of(text)))
        yield pd.DataFrame({"word": ["", *(w.decode() for w in seen)], "n": [n, *seen.values()]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    df = {r.word: r.n for r in counted.toLocalIterator()}
    total = df.pop("", 0)
    return {w: math.log((total + 1) / (df.get(w.decode(), 0) + 0.5)) for w in vocabulary}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, idf: Mapping[bytes, float] | None = None) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, matches, score.

    ``matches`` is an array of struct(label, base, start, coverage), ordered by start; ``score`` is
    the best coverage, 0 without matches. Null and empty texts have no words; null ids stay null;
    repeated rows give repeated results; an empty table gives none; other columns are ignored.
    """
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(PositionalIndex(templates, word_idf(docs, templates, text_col) if idf is None else idf))
    kind = dict(docs.dtypes)[id_col]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = index.value
        for batch in short(batches):
            n, matches, score = [], [], []
            for text in batch["text"]:
                words = words_of(text)
                found = sorted(((s, ix.templates[k].label, ix.templates[k].base, c) for k, s, c in ix.scan(words)), key=lambda x: (x[0], x[1], not x[2]))
                n.append(len(words))
                matches.append([{"label": label, "base": base, "start": s, "coverage": c} for s, label, base, c in found])
                score.append(max((m[3] for m in found), default=0.0))
            yield pd.DataFrame({id_col: batch["id"], "n_words": n, "matches": matches, "score": score})

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(scan, f"`{id_col}` {kind}, n_words long, matches array<struct<label:string,base:boolean,start:long,coverage:double>>, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m["base"])
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        "score",
    )
