"""Proposals: prompts for a model, a model hook, and an offline lexicon."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.config import LINES_PER_REPLY, MAX_TEXT_CHARS, TAGS_PER_SNIPPET, Profile
from tagloom.functions.text import (
    combine_passes,
    parse_reply,
    truncate_text,
    words,
)

# Words looked at first, per wanted name. Only speed depends on it.
HEAD_PER_NAME = 8

Reply = Callable[[list[str]], list[str]]


@dataclass(frozen=True)
class Facet:
    """One aspect to tag: its number fixes the order of the passes."""

    number: int
    template: str


def facet_prompts(
    documents: DataFrame, facets: Sequence[Facet], limit: int = MAX_TEXT_CHARS
) -> DataFrame:
    """``id, facet, prompt``: one prompt per document and facet."""
    choices = F.array(*[
        F.struct(F.lit(f.number).alias("facet"), F.lit(f.template).alias("template"))
        for f in facets
    ])
    return (
        documents.select("id", truncate_text(F.col("text"), limit).alias("shown"))
        .select("id", "shown", F.inline(choices))
        .select("id", "facet", F.concat("template", "shown").alias("prompt"))
    )


def propose_with_model(
    prompts: DataFrame, load: Callable[[], Reply]
) -> DataFrame:
    """``id, facet, reply, error`` from a user-supplied batch model.

    ``load`` runs once per task and returns a function from prompts to replies.
    If a batch fails its prompts are tried one by one, and what still fails
    keeps its message in ``error`` with a NULL reply.
    """

    # everything the tasks need is nested, so that executors only need pandas
    def ask_one(model: Reply, prompt: str) -> tuple[str | None, str | None]:
        try:
            return model([prompt])[0], None
        except Exception as error:
            return None, str(error)

    def ask(model: Reply, asked: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            answers = list(model(asked))
        except Exception:
            answers = []
        if len(answers) == len(asked):
            return [(reply, None) for reply in answers]
        return [ask_one(model, prompt) for prompt in asked]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            answers = ask(model, list(frame["prompt"]))
            yield pd.DataFrame({
                "id": frame["id"],
                "facet": frame["facet"],
                "reply": pd.Series([a[0] for a in answers], index=frame.index, dtype=object),
                "error": pd.Series([a[1] for a in answers], index=frame.index, dtype=object),
            })

    return prompts.select("id", "facet", "prompt").mapInPandas(
        run, "id string, facet int, reply string, error string"
    )


def proposals_from_replies(
    replies: DataFrame, facet_numbers: Iterable[int], profile: Profile
) -> DataFrame:
    """``id, names, error, failed`` from ``id, facet, reply, error``.

    Facets are combined in the given order; one that failed adds no names. The
    first error of a snippet, by facet, is kept; ``failed`` says that no facet
    answered. A snippet has one row per facet, so the lists here are as short as
    the facet list.
    """
    passes = replies.select(
        "id", "error",
        F.struct("facet", parse_reply(F.col("reply"), profile).alias("tags")).alias("part"),
        F.when(F.col("error").isNotNull(), F.struct("facet", "error")).alias("failure"),
    )
    per_snippet = passes.groupBy("id").agg(
        F.collect_list("part").alias("parts"), F.min("failure").alias("failure"),
        F.bool_and(F.col("failure").isNotNull()).alias("failed"),
    )
    names = combine_passes(*[_pass_tags("parts", n) for n in facet_numbers])
    return per_snippet.select(
        "id", names.alias("names"), F.col("failure.error").alias("error"), "failed"
    )


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _pass_tags(parts: str, number: int) -> Column:
    of_facet = F.filter(parts, lambda p: p["facet"] == number)
    tags = F.flatten(F.transform(of_facet, lambda p: F.coalesce(p["tags"], _no_names())))
    return tags


def ranked_words(documents: DataFrame) -> DataFrame:
    """``id, terms``: distinct words by descending count, then word, joined by spaces.

    Works inside the row: Spark lower-cases the text and leaves runs of letters, so
    workers only split at spaces and count. A null text has null terms.
    """
    letters = F.regexp_replace(F.lower("text"), r"\P{L}+", " ")

    # nested, so that executors only need pandas
    def rank(text: str | None) -> str | None:
        if text is None:
            return None
        hits = Counter(text.split())
        # equal counts keep the order of the words, also in reverse
        return " ".join(sorted(sorted(hits), key=hits.__getitem__, reverse=True))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({
                "id": frame["id"],
                "terms": pd.Series(
                    [rank(text) for text in frame["letters"]], index=frame.index, dtype=object
                ),
            })

    return documents.select("id", letters.alias("letters")).mapInPandas(
        run, "id string, terms string"
    )


def lexicon_counts(documents: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``id, facet, term, hits`` over the whole text of every document.

    ``lexicon`` is ``term, facet``; repeated rows count once. Words meet the lexicon
    first, so only its own are exchanged, already summed by each task. Spark broadcasts
    the lexicon if it is small and splits skewed terms otherwise.
    """
    found = documents.select("id", F.explode(words(F.col("text"))).alias("term")).join(
        lexicon.select("term", "facet").distinct(), "term"
    )
    return found.groupBy("id", "facet", "term").agg(F.count("*").alias("hits"))


def propose_with_lexicon(
    documents: DataFrame,
    lexicon: DataFrame,
    facet_numbers: Sequence[int],
    per_facet: int = LINES_PER_REPLY,
    limit: int = TAGS_PER_SNIPPET,
) -> DataFrame:
    """``id, names``: the most frequent terms of each facet, facets in order.

    All facets of a document are gathered in one step; the list holds each of
    the document's distinct terms once. Documents without a hit have no row.
    """
    entry = F.struct("facet", (-F.col("hits")).alias("rank"), "term")
    ranked = (
        lexicon_counts(documents, lexicon).groupBy("id")
        .agg(F.sort_array(F.collect_list(entry)).alias("ranked"))
    )
    passes = [
        F.transform(
            F.slice(F.filter("ranked", lambda e: e["facet"] == n), 1, per_facet),
            lambda e: e["term"],
        )
        for n in facet_numbers
    ]
    return ranked.select("id", combine_passes(*passes, limit=limit).alias("names"))


def top_terms(
    documents: DataFrame, profile: Profile, n: int = LINES_PER_REPLY
) -> DataFrame:
    """``id, names``: the ``n`` most frequent valid words, ties by word.

    A document is one row and is worked on alone. Documents without a valid word
    have no row.
    """
    def valid(term: Column) -> Column:
        return (term != "") & term.rlike(profile.valid)

    def first_valid(terms: Column) -> Column:
        return F.slice(F.filter(terms, valid), 1, n)

    ranked = ranked_words(documents).select("id", F.split("terms", " ").alias("terms"))
    # the first words are mostly enough; if not, all are looked at
    found = first_valid(F.slice("terms", 1, HEAD_PER_NAME * n))
    names = F.when(F.size(found) == n, found).otherwise(first_valid(F.col("terms")))
    return ranked.where(F.exists("terms", valid)).select("id", names.alias("names"))


def explode_names(proposals: DataFrame) -> DataFrame:
    """``id, idx, name`` with a 1-based place per name."""
    return proposals.select("id", F.posexplode("names").alias("pos", "name")).select(
        "id", (F.col("pos") + 1).alias("idx"), "name"
    )
