"""Licence scan by a positional index of rare words.

Licence templates are indexed by word and position. Of each template's words that a file holds, those with the highest
inverse document frequency (counted over the whole table) are looked up; every occurrence votes for (template, file
position minus template position). So many are looked up that a place with enough of the template's words can't go
without votes. Places with enough votes are compared with the template word by word, and a template counts if enough of
its words stand there and its mandatory phrase does.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases whose every place is reported, with their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Well-known licence notices and their mandatory phrases (words in lower case).
TEMPLATES = {
    "apache-2.0": [("licensed under the apache license version 2.0", "apache license"), (
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at", "apache license")],
    "mit": [("released under the mit license", "mit license"), ("licensed under the mit license", "mit license"), (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge")],
    "bsd": [(
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met", "redistribution and use in source and binary forms")],
    "gpl-3.0": [("this work is licensed under the gnu general public license version 3", "general public license"), (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 3 of the license", "general public license")],
    "gpl-2.0": [(
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation either version 2 of the license", "general public license")],
    "mpl-2.0": [("this source code form is subject to the terms of the mozilla public license v 2.0", "mozilla public license")],
    "cc-by-nc": [("licensed under cc by nc 4.0", "cc by nc")],
    "cc-by-sa": [("licensed under cc by sa 4.0", "cc by sa")],
    "isc": [("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee")],
}
#: Different words of a template that are looked up at least, if the file holds them.
RARE = 12
#: Share of a template's words that must stand at the place found.
LEAST = 0.8
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER) if text and not text.isascii() else (text or "").lower())


def phrase_places(words: list[str], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(start, label) of every place where a phrase's words stand, ordered."""
    found = []
    for phrase, label in phrases.items():
        parts = phrase.split()
        at = -1
        while True:
            try:
                at = words.index(parts[0], at + 1)
            except ValueError:
                break
            if words[at : at + len(parts)] == parts:
                found.append((at, label))
    return sorted(found)


class Index:
    """Word -> positions by template, with weights that say how rare a word is in the documents."""

    def __init__(self, templates: dict, weight: dict[str, float]):
        self.templates = []
        self.vocabulary: set[str] = set()
        for label, notices in templates.items():
            for notice, key in notices:
                words = words_of(notice)
                positions: dict[str, list[int]] = defaultdict(list)
                for position, word in enumerate(words):
                    positions[word].append(position)
                rarest = sorted(positions, key=lambda w: (-weight.get(w, 0.0), w))
                # words that may differ where a template counts
                spare = max((m for m in range(len(words)) if (len(words) - m) / len(words) >= LEAST), default=-1)
                self.templates.append((label, words, words_of(key), [(w, positions[w]) for w in rarest], spare))
                self.vocabulary.update(words)

    def matches(self, words: list[str]) -> dict[str, float]:
        """Label -> share of the template's words found at its best place, for templates that count."""
        held: dict[str, list[int]] = defaultdict(list)
        vocabulary = self.vocabulary
        for i, w in enumerate(words):
            if w in vocabulary:
                held[w].append(i)
        out: dict[str, float] = {}
        for label, notice, key, rarest, spare in self.templates:
            # a template whose mandatory phrase can't be there needs no look-up
            if not held.keys() >= set(key):
                continue
            left = spare - sum(len(positions) for w, positions in rarest if w not in held)
            if left < 0:
                continue
            votes: Counter = Counter()
            asked = 0
            for k, (w, positions) in enumerate((w, p) for w, p in rarest if w in held):
                if k >= RARE and asked > left:
                    break
                asked += len(positions)
                votes.update(i - position for position in positions for i in held[w])
            for start, n in votes.items():
                if n < asked - left:  # more words differ than may
                    continue
                low = max(0, start - 3)
                around = words[low : max(0, start) + len(notice) + 3]
                if not phrase_places(around, {" ".join(key): label}):
                    continue
                there = words[max(0, start) : max(0, start + len(notice))]
                share = sum(a == b for a, b in zip(notice, [""] * -start + there)) / len(notice)
                if share >= LEAST and share > out.get(label, 0.0):
                    out[label] = share
        return out


def licence_word_weights(texts: DataFrame, templates: dict = TEMPLATES) -> dict[str, float]:
    """Inverse document frequency over all rows of each word that a template has (a fixed, small set of words)."""
    vocabulary = {w for notices in templates.values() for notice, _ in notices for w in words_of(notice)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = Counter(), 0
        for batch in batches:
            for text in batch["text"]:
                rows += 1
                seen.update(vocabulary.intersection(words_of(text)))
        yield pd.DataFrame({"word": ["", *seen], "n": [rows, *seen.values()]}).astype({"n": "int64"})

    counts = texts.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counts.collect()}
    rows = found.pop("", 0)
    return {w: math.log((rows + 1) / (found.get(w, 0) + 1)) for w in vocabulary}


def license_scan(
    docs: DataFrame, text: str = "text", templates: dict = TEMPLATES, phrases: dict[str, str] = PHRASES, carry: list[str] | None = None
) -> DataFrame:
    """Words, phrase places and licence labels of every row, beside the columns of ``carry`` (all by default).

    ``n_words``, ``n_base`` (places of phrases), ``first_word`` and ``last_word`` (their smallest and largest start, or
    null), ``base_labels``, ``labels`` (templates' too) and ``score``: the best share of a template's words found (1.0
    if only phrases are). Null and empty texts have no words, no labels and score 0. Repeated rows get equal results;
    columns with the added names are left out.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "_r")
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    weights = licence_word_weights(docs.select(F.col(text).alias("text")), templates)
    kind = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(templates, weights)
        for batch in batches:
            rows = []
            for content in batch:
                words = words_of(content)
                places = phrase_places(words, phrases)
                base = {label for _, label in places}
                more = index.matches(words)
                score = max([*more.values(), 1.0 if base else 0.0])
                rows.append((
                    len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(sorted(base)), ",".join(sorted(base | set(more))), score,
                ))
            out = pd.DataFrame(rows, columns=[part.split()[0] for part in kind.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64", "n_words": "int64", "n_base": "int64"})

    scanned = docs.select(*rest, F.pandas_udf(scan, kind)(F.coalesce(F.col(text), F.lit(""))).alias("_r"))
    return scanned.select(*rest, "_r.*")
