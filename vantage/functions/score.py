"""Topic classification and photo score."""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions.text import trim_all


def _quote(phrase: str) -> str:
    return phrase.replace("-", r"\-").replace("&", r"\&")


def _phrase_rounds() -> list[str]:
    """Patterns that together report every topic phrase starting at each word.

    One zero-width pass finds one phrase per starting point, so a phrase that
    opens with another whole phrase ("craft fair" with "craft") goes to a later
    pass. Within a pass the alternatives are grouped by first letter.
    """
    phrases = sorted({p for _, terms in vocab.TOPICS for p in terms})
    level: dict[str, int] = {}
    for phrase in phrases:  # sorted: every opening phrase comes before its extensions
        opened_by = [
            p for p in level if phrase.startswith(p) and not phrase[len(p)].isalnum()
        ]
        level[phrase] = 1 + max((level[p] for p in opened_by), default=-1)
    patterns = []
    for n in range(max(level.values()) + 1):
        chosen = [p for p in phrases if level[p] == n]
        branches = [
            first + "(?:" + "|".join(_quote(p[1:]) for p in rest) + ")"
            for first, rest in groupby(chosen, key=lambda p: p[0])
        ]
        patterns.append(rf"(?<![a-z0-9])(?=((?:{'|'.join(branches)}))(?![a-z0-9]))")
    return patterns


def topic_phrases(text: Column) -> Column:
    """Distinct topic phrases a text mentions as whole words."""
    low = F.lower(text)
    found = [F.regexp_extract_all(low, F.lit(p), 1) for p in _phrase_rounds()]
    return F.array_distinct(F.concat(*found))


def topic_scores(title_hits: Column, body_hits: Column) -> list[Column]:
    """Per topic: ten points a phrase in the title, one for a phrase only in the body."""
    body_only = F.array_except(body_hits, title_hits)
    scores = []
    for _, terms in vocab.TOPICS:
        wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
        scores.append(
            F.size(F.array_intersect(title_hits, wanted)) * 10
            + F.size(F.array_intersect(body_only, wanted))
        )
    return scores


def best_topic(scores: list[Column]) -> Column:
    """Highest score, earliest topic on ties, null when nothing scored."""
    ranked = F.array_max(F.array(*[
        F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("category"))
        for i, (s, (name, _)) in enumerate(zip(scores, vocab.TOPICS))
    ]))
    return F.when(ranked["score"] > 0, ranked["category"])


def classify_hits(title_hits: Column, body_hits: Column, supplied: Column) -> Column:
    kept = trim_all(F.coalesce(supplied, F.lit("")))
    informative = F.when(~F.lower(kept).isin(vocab.UNINFORMATIVE_CATEGORIES), kept)
    return F.coalesce(
        best_topic(topic_scores(title_hits, body_hits)), informative, F.lit(vocab.GENERAL_CATEGORY)
    )


def body_text(title: Column, description: Column, chars: int | None) -> Column:
    body = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")))
    return F.substring(body, 1, chars) if chars else body


def with_category(
    df, title: str = "title", description: str = "description", supplied: str | None = None,
    chars: int | None = None, name: str = "category",
):
    """Add the category; ``chars`` limits how much of the text counts (None: all of it)."""
    hits = df.withColumns({
        "_title_hits": topic_phrases(F.col(title)),
        "_body_hits": topic_phrases(body_text(F.col(title), F.col(description), chars)),
    })
    given = F.col(supplied) if supplied else F.lit("")
    category = classify_hits(F.col("_title_hits"), F.col("_body_hits"), given)
    return hits.withColumn(name, category).drop("_title_hits", "_body_hits")


def photo_score(
    title: Column, description: Column, category: Column, image_url: Column, is_online: Column,
    chars: int | None = None,
) -> Column:
    """0..100: how much a photographer would want to be there."""
    text = body_text(title, description, chars)
    score = F.lit(10)
    for pattern, weight in vocab.PHOTO_KEYWORDS:
        hit = text.rlike(rf"(?i)(?<!\w)(?:{pattern})(?!\w)")
        score = score + F.when(hit, weight).otherwise(0)
    low = F.lower(F.coalesce(category, F.lit("")))
    by_category = F.coalesce(
        *[F.when(F.contains(low, F.lit(key)), F.lit(w)) for key, w in vocab.PHOTO_CATEGORY_SCORES],
        F.lit(0),
    )
    image = F.when(F.coalesce(image_url, F.lit("")) != "", 5).otherwise(0)
    total = F.greatest(F.lit(0), F.least(F.lit(100), score + by_category + image))
    return F.when(F.coalesce(is_online, F.lit(False)), 0).otherwise(total).cast("int")
