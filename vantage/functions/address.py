"""Postal address functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions import let
from vantage.functions.text import SPACE, squeeze, trim_all, unshout


def _known(component: Column, words: list[str]) -> Column:
    return F.lower(trim_all(component)).isin(words)


def is_country(component: Column) -> Column:
    return _known(component, vocab.COUNTRIES)


def is_region(component: Column) -> Column:
    return _known(component, vocab.REGIONS)


def is_postcode(component: Column) -> Column:
    text = trim_all(component)
    first, *rest = [text.rlike(p) for p in vocab.POSTCODE_PATTERNS]
    for test in rest:
        first = first | test
    return first


def is_placeholder(text: Column) -> Column:
    return F.lower(text).isin(vocab.PLACEHOLDER_ADDRESSES)


def expand_region(component: Column, default_region: Column) -> Column:
    """Complete a strict prefix of the region that local addresses use."""
    text = trim_all(component)
    short = (
        (default_region != "")
        & (F.length(text) < F.length(default_region))
        & F.startswith(F.upper(default_region), F.upper(text))
    )
    return F.when(short, default_region).otherwise(text)


def strip_region_and_postcode(component: Column) -> Column:
    """Drop trailing region and postcode words, always leaving one word."""
    words = F.split(squeeze(component), " ")
    tail = lambda w: is_region(w) | is_postcode(w)

    def shorten(left: Column, _step: Column) -> Column:
        n = F.size(left)
        last = F.element_at(left, -1)
        last_two = F.concat_ws(" ", F.try_element_at(left, F.lit(-2)), last)
        cut = F.when((n > 1) & tail(last), n - 1).when((n > 2) & tail(last_two), n - 2).otherwise(n)
        return F.slice(left, F.lit(1), cut)

    steps = F.sequence(F.lit(1), F.size(words))
    return F.array_join(F.aggregate(steps, words, shorten), " ")


def locality_of(address: Column) -> Column:
    """The town an address names, '' when it names none."""
    parts = F.filter(F.transform(F.split(address, ","), squeeze), lambda p: p != "")
    bare = F.transform(parts, strip_region_and_postcode)
    real = F.filter(bare, lambda p: (p != "") & ~is_region(p) & ~is_postcode(p) & ~is_country(p))
    street = rf"(?i)(?<!\w)({'|'.join(vocab.STREET_WORDS)})$"
    named = lambda last: F.when(
        last.isNull() | last.rlike("^[0-9]") | last.rlike(street), "").otherwise(last)
    return let(F.try_element_at(real, F.lit(-1)), named)


def _spelled_out(part: Column, earlier: Column) -> Column:
    """Whether ``part`` occurs in ``earlier`` as whole words, ignoring ASCII case."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(part, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    before = F.when(part.rlike("^[A-Za-z0-9_]"), r"(?<!\w)").otherwise(r"(?<=\w)")
    after = F.when(part.rlike("[A-Za-z0-9_]$"), r"(?!\w)").otherwise(r"(?=\w)")
    # The plain containment test keeps most rows away from a per-row pattern.
    return F.contains(F.lower(earlier), F.lower(part)) & F.rlike(
        earlier, F.concat(F.lit("(?i)"), before, quoted, after)
    )


def clean_address(address: Column, default_region: Column) -> Column:
    """Distinct components of an address, cut after the country."""
    parts = F.transform(F.split(address, ","), lambda p: unshout(squeeze(p)))
    parts = F.transform(F.filter(parts, lambda p: p != ""), lambda p: expand_region(p, default_region))
    parts = F.filter(parts, lambda p: ~is_placeholder(p))

    def keep(kept: Column, part: Column) -> Column:
        repeated = F.exists(kept, lambda k: F.lower(k) == F.lower(part))
        inside = F.exists(
            kept,
            lambda k: (k.rlike("[0-9]") | (k != strip_region_and_postcode(k))) & _spelled_out(part, k),
        )
        return F.when(repeated | inside, kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), keep)

    def cut_after_country(kept: Column) -> Column:
        country_at = F.array_position(F.transform(kept, is_country), F.lit(True)).cast("int")
        upto = F.when(country_at > 0, country_at).otherwise(F.size(kept))
        return F.array_join(F.slice(kept, F.lit(1), upto), ", ")

    return let(kept, cut_after_country)


def valid_address(address: Column, default_region: Column) -> Column:
    """Cleaned address, '' when the source only had a placeholder."""
    cleaned = clean_address(F.coalesce(address, F.lit("")), default_region)
    return let(cleaned, lambda c: F.when(is_placeholder(c), "").otherwise(c))


def place_label(venue: Column, locality: Column) -> Column:
    """Heading an event files under: venue, or locality when the venue is a street number."""
    name = trim_all(F.coalesce(venue, F.lit("")))
    numbered = trim_all(F.substring_index(name, ",", 1)).rlike("^[0-9]")
    fallback = F.when(F.coalesce(locality, F.lit("")) != "", locality).otherwise(name)
    return F.when((name != "") & ~numbered, name).otherwise(trim_all(fallback))


def region_tokens(address: Column) -> Column:
    """Upper-cased region words an address contains."""
    words = F.split(address, rf"(?:,|{SPACE})+")
    return F.transform(F.filter(words, lambda w: (F.length(w) >= 2) & is_region(w)), F.upper)
