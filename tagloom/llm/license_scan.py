"""Licence scan: positional index of rare licence words, verified by key phrases.

The document frequencies of all licence words are counted over the whole corpus.
Every template is filed under its rarest words with their positions. A text that
holds enough of a template's index words looks up all their places; each (word
position in the text, word position in the template) gives a start of the template
in the text, and starts on which several words agree are candidates. What other
licence words the text holds makes no difference. A candidate counts if its
mandatory phrases stand in the text. Exact phrases are found the same way: the
rarest word of the phrase is the anchor and the words around every anchor are
compared.

Everything after the count is worked out inside one row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import ascii_lower, plain_words, whole

RARE_PER_TEMPLATE = 8
TOLERANCE = 3


@dataclass(frozen=True)
class Phrase:
    label: str
    text: str

    @property
    def words(self) -> list[str]:
        return self.text.split()


@dataclass(frozen=True)
class Template:
    """``keys``: phrases that all have to stand in the text."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()


# The phrases and labels that the query has to report.
BASE_PHRASES = (
    Phrase("mit", "under the mit license"),
    Phrase("apache-2", "apache license version 2"),
    Phrase("cc-by-nc", "cc by nc"),
)
# Opening words of common licence notices.
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy "
             "of this software and associated documentation files to deal in the software "
             "without restriction", ("permission is hereby granted free of charge",)),
    Template("apache-2", "licensed under the apache license version 2 0 you may not use this file "
             "except in compliance with the license", ("apache license", "version 2")),
    Template("bsd", "redistribution and use in source and binary forms with or without "
             "modification are permitted provided that the following conditions are met",
             ("redistribution and use in source and binary forms",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3",
             ("gnu general public license", "version 3")),
    Template("gpl-2", "this program is licensed under the gnu general public license version 2",
             ("gnu general public license", "version 2")),
    Template("lgpl", "licensed under the gnu lesser general public license version",
             ("gnu lesser general public license",)),
    Template("agpl-3", "licensed under the gnu affero general public license version 3",
             ("gnu affero general public license",)),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public "
             "license v 2 0", ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any "
             "purpose with or without fee is hereby granted",
             ("permission to use copy modify and or distribute this software",)),
    Template("cc-by-nc", "licensed under creative commons attribution noncommercial",
             ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "licensed under creative commons attribution sharealike",
             ("creative commons attribution sharealike",)),
    Template("cc-by", "licensed under a creative commons attribution license",
             ("creative commons attribution",)),
    Template("cc0", "dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("free and unencumbered software",)),
)


def document_frequencies(words: DataFrame, vocabulary: Sequence[str]) -> dict[str, int]:
    """Texts per licence word; as many numbers as the vocabulary has words."""
    found = words.select(F.explode(F.array_distinct(
        F.filter(F.col("words"), lambda w: w.isin(list(vocabulary)))
    )).alias("word"))
    rows = found.groupBy("word").agg(F.count("*").alias("n")).collect()
    return {w: 0 for w in vocabulary} | {r["word"]: r["n"] for r in rows}


def _phrase_starts(phrase: Phrase, seen: dict[str, int]) -> Column:
    """Sorted starts of the phrase in ``words``, found through its rarest word."""
    own = phrase.words
    at = min(range(len(own)), key=lambda i: (seen[own[i]], i))
    wanted = F.array(*map(F.lit, own))
    anchors = F.filter(F.col("hits"), lambda h: h["word"] == own[at])
    return F.filter(
        F.transform(anchors, lambda h: h["at"] - at),
        lambda s: (s >= 0) & (F.slice(F.col("words"), s + 1, len(own)) == wanted),
    )


def _anchor(phrase: Phrase, seen: dict[str, int]) -> str:
    return min(phrase.words, key=lambda w: (seen[w], phrase.words.index(w)))


def _rarest(template: Template, seen: dict[str, int], count: int) -> list[str]:
    first = {w: i for i, w in reversed(list(enumerate(template.words)))}
    return sorted(first, key=lambda w: (seen[w], first[w]))[:count]


def _enough(indexed: list[str], min_coverage: float) -> int:
    """The least number of index words that reaches the coverage."""
    return next(
        (n for n in range(len(indexed) + 1) if n / len(indexed) >= min_coverage), len(indexed) + 1
    )


def _coverage(template: Template, indexed: list[str], enough: int) -> Column:
    """Share of the template's indexed words that stand at one agreed start.

    Places that differ by no more than the tolerance agree, so a few words put in
    or left out do not hide a notice. The words around every start are looked at,
    so the work grows with the number of index words in the text. Texts that hold
    fewer than ``enough`` of them get 0.
    """
    places: dict[str, list[int]] = {}
    for i, word in enumerate(template.words):
        if word in indexed:
            places.setdefault(word, []).append(i)

    def agrees(start: Column, word: str) -> Column:
        def near(place: int) -> Column:
            first = F.greatest(start + (place - TOLERANCE), F.lit(0))
            behind = F.greatest(start + (place + TOLERANCE + 1), F.lit(0))
            return F.array_contains(F.slice("words", first + 1, behind - first), word)

        return reduce(lambda a, b: a | b, map(near, places[word])).cast("int")

    starts = F.array_distinct(F.flatten(F.array(*(
        F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - place)
        for word, own in places.items() for place in own
    ))))
    agreeing = F.transform(
        starts, lambda s: reduce(lambda a, b: a + b, (agrees(s, word) for word in places))
    )
    present = F.size(F.array_intersect("own_words", F.array(*map(F.lit, indexed))))
    return F.when(
        present >= enough, F.coalesce(F.array_max(agreeing), F.lit(0)) / F.lit(len(indexed))
    ).otherwise(F.lit(0.0))


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    phrases: Sequence[Phrase] = BASE_PHRASES,
    templates: Sequence[Template] = TEMPLATES,
    min_coverage: float = 0.5,
) -> DataFrame:
    """One row per text: words, places of the phrases, labels and a score.

    ``score`` is 1 where a phrase stands, else the best share of agreeing rare
    words of a verified template, halved if only unverified ones agree. A null or
    empty text has no words, no label and score 0. Repeated rows are scanned
    each; other columns are not read.
    """
    words = docs.select(
        F.col(id_col).alias("doc_id"),
        plain_words(ascii_lower(whole(text))).alias("words"),
    )
    vocabulary = sorted({w for t in (*phrases, *templates) for w in t.words})
    seen = document_frequencies(words, vocabulary)
    indexed = {t: _rarest(t, seen, RARE_PER_TEMPLATE) for t in templates}
    looked_up = {w for own in indexed.values() for w in own} | {_anchor(p, seen) for p in phrases}

    hits = words.withColumn("hits", F.filter(
        F.transform(F.col("words"), lambda w, i: F.when(
            w.isin(sorted(looked_up)), F.struct(w.alias("word"), i.alias("at")))),
        lambda h: h.isNotNull(),
    ))
    found = hits.withColumn("own_words", F.array_distinct("hits.word"))
    starts = [
        F.when(F.size("hits") > 0, _phrase_starts(p, seen)).otherwise(F.array().cast("array<int>"))
        for p in phrases
    ]
    placed = found.select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.array(*starts).alias("starts"),
        F.when(F.size("hits") > 0, F.array(*(
            F.struct(
                F.lit(t.label).alias("label"),
                _coverage(t, indexed[t], _enough(indexed[t], min_coverage)).alias("share"),
                reduce(lambda a, b: a & b, (
                    F.contains(
                        F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")),
                        F.lit(f" {key} "),
                    ) for key in t.keys
                )).alias("verified"),
            ) for t in templates
        ))).alias("notices"),
    )
    places = F.flatten("starts")
    base = F.filter(
        F.array(*(F.when(F.size(F.col("starts")[i]) > 0, F.lit(p.label))
                  for i, p in enumerate(phrases))),
        lambda label: label.isNotNull(),
    )
    agreed = F.filter(F.coalesce("notices", F.array().cast(
        "array<struct<label:string,share:double,verified:boolean>>"
    )), lambda n: n["share"] >= min_coverage)
    verified = F.filter("agreed", lambda n: n["verified"])
    named = placed.withColumn("base", base).withColumn("agreed", agreed)
    return named.select(
        "doc_id",
        "n_words",
        F.size(places).cast("bigint").alias("n_base"),
        F.array_min(places).cast("bigint").alias("first_word"),
        F.array_max(places).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(
            "base", F.transform(verified, lambda n: n["label"])
        )), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(
            F.array_max(F.transform(verified, lambda n: n["share"])),
            F.array_max(F.transform("agreed", lambda n: n["share"] / 2)),
            F.lit(0.0),
        )).alias("score"),
    )
