"""Classifying text by word lists.  Matching is by substring on lower-cased text.

A text is searched once: :func:`found` gives the patterns it holds.  Every
classifier then works on that short list, so several classifiers can share it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalbook import fixed_values as fv
from signalbook.functions.values import first_items, half_up, once


def words(*lists: Iterable[str]) -> list[str]:
    """Distinct patterns of several lists, in order."""
    return list(dict.fromkeys(p for one in lists for p in one))


def _literal(patterns: Iterable[str]) -> Column:
    return F.array(*[F.lit(p) for p in patterns])


def found(text: Column, patterns: Iterable[str]) -> Column:
    """The patterns that occur in the text."""
    known = _literal(words(patterns))
    return once(
        F.lower(F.coalesce(text, F.lit(""))),
        lambda t: F.filter(known, lambda p: F.contains(t, p)),
    )


def hits(matched: Column, patterns: Iterable[str]) -> Column:
    """How many of these patterns are among the matched ones."""
    return F.size(F.array_intersect(matched, _literal(words(patterns))))


def groups_hit(matched: Column, groups: Sequence[Iterable[str]]) -> Column:
    """Position of the group of every matched pattern, once per pattern and group."""
    places: dict[str, list[int]] = {}
    for i, patterns in enumerate(groups):
        for p in words(patterns):
            places.setdefault(p, []).append(i)
    table = F.create_map(
        *[x for p, at in places.items() for x in (F.lit(p), F.array(*[F.lit(i) for i in at]))]
    )
    none = F.array().cast("array<int>")
    return F.flatten(F.transform(matched, lambda p: F.coalesce(F.try_element_at(table, p), none)))


# --- sentiment ------------------------------------------------------------------


def sentiment_of(
    matched: Column,
    positive: Sequence[str] = fv.POSITIVE_WORDS,
    negative: Sequence[str] = fv.NEGATIVE_WORDS,
) -> Column:
    """Struct of label, confidence and score (share of positive hits, 0.5 if none)."""

    def judged(share: Column) -> Column:
        label = F.when(share > 0.6, "positive").when(share < 0.4, "negative").otherwise("neutral")
        confidence = (
            F.when(share.isNull(), F.lit(0.5))
            .when(share > 0.6, F.least(F.lit(0.95), 0.6 + share * 0.35))
            .when(share < 0.4, F.least(F.lit(0.95), 0.6 + (1 - share) * 0.35))
            .otherwise(F.lit(0.65))
        )
        return F.struct(
            label.alias("label"),
            half_up(confidence, 2).alias("confidence"),
            half_up(F.coalesce(share, F.lit(0.5)), 3).alias("score"),
        )

    good, bad = hits(matched, positive), hits(matched, negative)
    return once(F.try_divide(good.cast("double"), good + bad), judged)


def sentiment(
    text: Column,
    positive: Sequence[str] = fv.POSITIVE_WORDS,
    negative: Sequence[str] = fv.NEGATIVE_WORDS,
) -> Column:
    return once(found(text, words(positive, negative)), lambda m: sentiment_of(m, positive, negative))


# --- severity --------------------------------------------------------------------


def severity_of(
    matched: Column, keywords: Mapping[str, Sequence[str]] = fv.SEVERITY_KEYWORDS
) -> Column:
    """Struct of the first level with any keyword and its confidence."""
    levels = _literal(keywords)
    first = F.array_min(groups_hit(matched, list(keywords.values())))
    return once(
        first,
        lambda i: F.struct(
            F.coalesce(F.get(levels, i), F.lit("medium")).alias("level"),
            F.when(i.isNotNull(), fv.FIELD_CONFIDENCE["severity_found"])
            .otherwise(fv.FIELD_CONFIDENCE["severity_default"])
            .alias("confidence"),
        ),
    )


def severity(text: Column, keywords: Mapping[str, Sequence[str]] = fv.SEVERITY_KEYWORDS) -> Column:
    return once(found(text, words(*keywords.values())), lambda m: severity_of(m, keywords))


# --- topics ------------------------------------------------------------------------


def topics_of(
    matched: Column, patterns: Mapping[str, Sequence[str]] = fv.TOPIC_PATTERNS, keep: int | None = None
) -> Column:
    """The topics, in table order, that have any pattern in the text (``keep``: the first only)."""
    names = _literal(patterns)
    hit = F.sort_array(F.array_distinct(groups_hit(matched, list(patterns.values()))))
    return F.transform(first_items(hit, keep), lambda i: F.get(names, i))


def topics(
    text: Column, patterns: Mapping[str, Sequence[str]] = fv.TOPIC_PATTERNS, keep: int | None = None
) -> Column:
    return once(found(text, words(*patterns.values())), lambda m: topics_of(m, patterns, keep))


def category(topic_list: Column) -> Column:
    """First topic, or ``general``."""
    return F.coalesce(F.try_element_at(topic_list, F.lit(1)), F.lit("general"))


# --- issue taxonomy --------------------------------------------------------------------


def _class_patterns(taxonomy: Mapping[str, Mapping[str, Sequence[str]]]) -> list[str]:
    return words(*[ps for subs in taxonomy.values() for ps in subs.values()])


def issue_words(taxonomy: Mapping[str, Mapping[str, Sequence[str]]] = fv.ISSUE_TAXONOMY) -> list[str]:
    """All words of the taxonomy, for :func:`found`."""
    return _class_patterns(taxonomy)


def issue_class_of(
    matched: Column, taxonomy: Mapping[str, Mapping[str, Sequence[str]]] = fv.ISSUE_TAXONOMY
) -> Column:
    """Struct of category, subcategory and confidence of the class with most hits.

    Equal counts go to the class that stands first in the taxonomy.
    """
    classes = [(c, s, ps) for c, subs in taxonomy.items() for s, ps in subs.items()]
    categories = _literal(c for c, _, _ in classes)
    subcategories = _literal(s for _, s, _ in classes)

    def ranked(places: Column) -> Column:
        return F.array_max(
            F.transform(
                F.array_distinct(places),
                lambda i: F.struct(
                    F.size(F.filter(places, lambda p: p == i)).alias("hits"), (-i).alias("place")
                ),
            )
        )

    best = once(groups_hit(matched, [ps for _, _, ps in classes]), ranked)
    return once(
        best,
        lambda b: F.struct(
            F.coalesce(F.get(categories, -b.place), F.lit("GENERAL")).alias("category"),
            F.coalesce(F.get(subcategories, -b.place), F.lit("OTHER")).alias("subcategory"),
            F.when(b.hits > 0, half_up(F.least(F.lit(0.95), 0.65 + b.hits * 0.1), 2))
            .otherwise(0.4)
            .alias("confidence"),
        ),
    )


def issue_class(
    text: Column, taxonomy: Mapping[str, Mapping[str, Sequence[str]]] = fv.ISSUE_TAXONOMY
) -> Column:
    return once(found(text, _class_patterns(taxonomy)), lambda m: issue_class_of(m, taxonomy))


def vocabulary(
    positive: Sequence[str],
    negative: Sequence[str],
    topic_patterns: Mapping[str, Sequence[str]],
    taxonomy: Mapping[str, Mapping[str, Sequence[str]]] = fv.ISSUE_TAXONOMY,
    keywords: Mapping[str, Sequence[str]] = fv.SEVERITY_KEYWORDS,
) -> list[str]:
    """All patterns of all classifiers, for one shared search."""
    return words(
        positive, negative, *keywords.values(), *topic_patterns.values(), _class_patterns(taxonomy)
    )
