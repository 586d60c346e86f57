"""Text column functions: folding, keys, cleaning, links."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage import vocab

# Whitespace beyond the ASCII set that java.util.regex calls \s.
WIDE_SPACE = "   -     　﻿"
SPACE = rf"[\s{WIDE_SPACE}]"


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def trim_all(c: Column) -> Column:
    """Trim every kind of whitespace, not just the space character."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(trim_all(c), rf"{SPACE}+", " ")


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Compatibility decomposition of every character that leads to a-z or 0-9.

    Returns the one-to-one part as translate() arguments (combining marks sit
    at the end of the first one, so they are deleted) and the rest as a map.
    """
    single_from, single_to, multi = [], [], {}
    for code in range(0x80, 0x20000):
        ch = chr(code)
        if 0x300 <= code <= 0x36F or not ch.isprintable():
            continue
        plain = "".join(
            p for p in unicodedata.normalize("NFKD", ch) if not 0x300 <= ord(p) <= 0x36F
        )
        if plain == ch or not any(p in "abcdefghijklmnopqrstuvwxyz0123456789" for p in plain):
            continue
        if len(plain) == 1:
            single_from.append(ch)
            single_to.append(plain)
        else:
            multi[ch] = plain
    marks = "".join(chr(c) for c in range(0x300, 0x370))
    return "".join(single_from) + marks, "".join(single_to), multi


def fold_accents(c: Column) -> Column:
    """Lower-case and reduce to base letters (compatibility decomposition)."""
    source, target, multi = _fold_tables()
    low = F.translate(F.lower(c), source, target)
    table = F.str_to_map(F.lit("\n".join(f"{a}\t{b}" for a, b in multi.items())), F.lit("\n"), F.lit("\t"))
    spelled = F.array_join(
        F.transform(F.split(low, ""), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), ""
    )
    # Few texts hold anything beyond ASCII once single characters are replaced.
    return F.when(low.rlike(r"[^\x00-\x7f]"), spelled).otherwise(low)


def _plain_words(c: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(fold_accents(c), "[^a-z0-9]+", " ")), " ")


def title_key(title: Column) -> Column:
    """Comparable form of a title: folded words without stopwords."""
    stop = [w for w in vocab.TITLE_STOPWORDS if w.isalnum()]
    words = F.filter(_plain_words(title), lambda w: (w != "") & ~w.isin(stop))
    return F.array_join(words, " ")


def venue_words(name: Column) -> Column:
    """Distinguishing words of a venue name, sorted, repeats kept."""
    head = F.substring_index(name, ",", 1)
    head = F.regexp_replace(head, rf"{SPACE}+-{SPACE}+[A-Z]{{2,8}}{SPACE}*$", "")
    head = F.regexp_replace(head, rf"{SPACE}*\([^)]*\){SPACE}*$", "")
    head = F.regexp_replace(head, rf"(?i){SPACE}+s/s{SPACE}*$", "")
    drop = vocab.VENUE_GENERIC_WORDS + vocab.VENUE_NOISE_WORDS
    return F.array_sort(F.filter(_plain_words(head), lambda w: (w != "") & ~w.isin(drop)))


def unshout(text: Column) -> Column:
    """Capitalise words of more than three letters when no lower-case letter exists."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\p{L}[\p{L}'’]*|[^\p{L}]+)"), 0)
    calm = F.transform(
        pieces,
        lambda p: F.when(
            p.rlike(r"^\p{L}") & (F.length(p) > 3),
            F.concat(F.substring(p, 1, 1), F.lower(p.substr(F.lit(2), F.length(p)))),
        ).otherwise(p),
    )
    return F.when(text.rlike("[a-z]"), text).otherwise(F.array_join(calm, ""))


def _decode_entity(token: Column) -> Column:
    body = F.substring_index(token.substr(F.lit(2), F.length(token)), ";", 1)
    hex_digits = F.regexp_extract(body, "^#[xX]([0-9a-fA-F]+)$", 1)
    dec_digits = F.regexp_extract(body, "^#([0-9]+)", 1)
    digits = F.when(hex_digits != "", F.regexp_replace(hex_digits, "^0+", "")).otherwise(
        F.regexp_replace(dec_digits, "^0+", "")
    )
    # Seven digits hold every code point; anything longer is out of range anyway.
    short = F.length(digits).between(1, 7)
    as_hex = F.conv(digits, 16, 10).try_cast("bigint")
    code = F.when(short, F.when(hex_digits != "", as_hex).otherwise(digits.try_cast("bigint")))
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    named = F.create_map(*[F.lit(x) for pair in vocab.ENTITIES.items() for x in pair])
    return (
        F.when(body.startswith("#"), F.when(code.between(1, 0x10FFFF), char))
        .otherwise(F.try_element_at(named, F.lower(body)))
    )


def decode_entities(text: Column) -> Column:
    """Replace named and numeric character entities; unknown ones stay as written."""
    tokens = F.regexp_extract_all(
        text, F.lit("(&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&)"), 0
    )
    decoded = F.transform(
        tokens,
        lambda t: F.when(
            t.startswith("&") & t.endswith(";") & (F.length(t) > 2),
            F.coalesce(_decode_entity(t), t),
        ).otherwise(t),
    )
    return F.when(F.contains(text, F.lit("&")), F.array_join(decoded, "")).otherwise(text)


def clean_description(text: Column) -> Column:
    """Scraped markup to plain text with paragraph breaks."""
    out = decode_entities(empty_if_null(text))
    for pattern, replacement in [
        (r"(?s)<!--.*?-->", ""),
        (r"(?i)<(?:br|hr)\s*/?>", "\n"),
        (r"(?i)</(?:p|div|li|tr|h[1-6]|blockquote)>", "\n\n"),
        (r"<[^>]*>", ""),
        (r"(?:\\r)?\\n", "\n"),
        (r"\\t", " "),
        (rf"[^\S\n{WIDE_SPACE}]+|[{WIDE_SPACE}]+", " "),
        (r" +", " "),
        (r" *\n *", "\n"),
        (r"\n{3,}", "\n\n"),
    ]:
        out = F.regexp_replace(out, pattern, replacement)
    return trim_all(out)


def slug(name: Column) -> Column:
    dashed = F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-")
    return F.coalesce(null_if_blank(F.regexp_replace(dashed, "^-|-$", "")), F.lit("area"))


def mentions(haystack: Column, needle: str) -> Column:
    """Case-insensitive substring search, blank needle matches everything."""
    wanted = needle.strip().lower()
    return F.contains(F.lower(haystack), F.lit(wanted)) if wanted else F.lit(True)


# --- links ---------------------------------------------------------------------


def host_of(url: Column) -> Column:
    """Lower-case host without a leading www., null for unusable URLs."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return null_if_blank(F.regexp_replace(host, r"^www\.", ""))


def urls_in(text: Column) -> Column:
    """Every URL in a text, trailing punctuation trimmed, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(rf"""https?://[^\s{WIDE_SPACE}"'<>)\]]+"""), 0)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]]+$", "")))


def social_profile(url: Column) -> Column:
    """struct(network, handle) of an organiser profile link, null for anything else."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    network = F.coalesce(
        *[F.when(host.rlike(pattern), F.lit(name)) for pattern, name in vocab.SOCIAL_NETWORKS]
    )
    segments = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")
    handle = F.try_url_decode(F.replace(F.try_element_at(segments, F.lit(1)), F.lit("+"), F.lit("%2B")))
    handle = trim_all(F.regexp_replace(handle, "^@", ""))
    usable = (
        network.isNotNull()
        & ~F.lower(handle).isin(vocab.PERMALINK_SEGMENTS)
        & handle.rlike("^[A-Za-z0-9._-]{2,}$")
    )
    return F.when(usable, F.struct(network.alias("network"), handle.alias("handle")))


def plain_number(n: Column) -> Column:
    """A number's digits without an exponent: the shortest decimal that stands for it."""
    exact = n.cast("string")
    written = F.regexp_replace(n.cast("decimal(38,18)").cast("string"), r"(\.\d*?)0+$", "$1")
    return F.when(F.contains(exact, F.lit("E")), F.regexp_replace(written, r"\.$", ".0")).otherwise(exact)
