"""schema.org events embedded in web pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions.astro import computed_once
from vantage.functions.text import WIDE_SPACE
from vantage.functions.times import iso, parse_time
from vantage.operators.validate import Area, inside_any_area
from vantage.sources.ticketing import RAW_COLUMNS, leading_number, number_text

BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
MAX_DEPTH = 6
#: Every character that ``trim_all`` takes as whitespace.
SPACES = "".join(c for c in map(chr, range(0x10000)) if re.match(rf"[ \t\n\x0b\f\r{WIDE_SPACE}]", c))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _field(v: Column, key: str) -> Column:
    return _get(v, f'$["{key}"]', "variant")


def _as_string(v: Column) -> Column:
    """Text of a JSON string, null for every other kind of value."""
    return F.when(F.schema_of_variant(v) == "STRING", v.try_cast("string"))


def _as_array(v: Column) -> Column:
    """Items of a JSON array, null for every other kind of value."""
    return _get(v, "$", "array<variant>")


def _fields(v: Column, keys: tuple[str, ...]) -> Column:
    """struct<key: variant> of the named fields of an object, all in one pass over it; null for every other kind of value."""
    return _get(v, "$", "struct<" + ", ".join(f"`{k}`: variant" for k in keys) + ">")


#: What a listing reads of its node.
EVENT_FIELDS = (
    "@type", "name", "url", "startDate", "endDate", "location", "offers", "description", "eventAttendanceMode", "image")


def _node(path: Column, v: Column) -> Column:
    """A value of the walk: its items if it is an array, all its fields that are ever looked at if it is an object."""
    return F.struct(path.alias("path"), _as_array(v).alias("items"), _fields(v, (*EVENT_FIELDS, *vocab.STRUCTURED_CHILD_KEYS)).alias("own"))


def _children(node: Column) -> Column:
    """Nodes one level down: array items, or the nested-event fields of an object."""
    items = F.transform(node["items"], lambda x, i: F.struct(i.alias("i"), x.alias("v")))
    fields = F.filter(
        F.array(*[
            F.struct(F.lit(i).alias("i"), node["own"][key].alias("v")) for i, key in enumerate(vocab.STRUCTURED_CHILD_KEYS)
        ]),
        lambda c: c["v"].isNotNull(),
    )
    return F.transform(F.coalesce(items, fields), lambda c: _node(F.concat(node["path"], F.array(c["i"])), c["v"]))


def _opened(v: Column) -> Column:
    """array<variant>: the items of a list in order, with lists inside it opened at any depth; null for other values.

    A round opens one level. There are at most as many levels as opening brackets, and rounds after the last list is
    open cost nothing.
    """
    text = F.to_json(v)
    brackets = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))
    is_list = lambda x: _as_array(x).isNotNull()

    def one_level(state: Column, _: Column) -> Column:
        items = state["items"]
        wider = F.flatten(F.transform(items, lambda x: F.coalesce(_as_array(x), F.array(x))))
        return F.when(~state["more"], state).when(
            F.exists(items, is_list), F.struct(wider.alias("items"), F.lit(True).alias("more"))
        ).otherwise(F.struct(items.alias("items"), F.lit(False).alias("more")))

    start = F.struct(_as_array(v).alias("items"), F.lit(True).alias("more"))
    return F.when(is_list(v), F.aggregate(F.sequence(F.lit(1), brackets), start, one_level, lambda s: s["items"]))


def _innermost_first(v: Column) -> Column:
    """The first item of a list, of its first item where that is a list, and so on; other values as they are."""
    text = F.to_json(v)
    brackets = F.length(text) - F.length(F.replace(text, F.lit("["), F.lit("")))
    first = F.aggregate(
        F.sequence(F.lit(1), brackets), v, lambda s, _: F.coalesce(F.try_element_at(_as_array(s), F.lit(1)), s))
    return F.when(_as_array(v).isNotNull(), first).otherwise(v)


def _is_event(kind: Column) -> Column:
    """Whether a node's ``@type`` is that of an event, or a list that has one."""
    def known(t: Column) -> Column:
        return F.regexp_replace(t, "^https?://schema\\.org/", "").isin(vocab.STRUCTURED_EVENT_TYPES)

    many = F.exists(_opened(kind), lambda t: F.coalesce(known(_as_string(t)), F.lit(False)))
    return F.coalesce(known(_as_string(kind)), many, F.lit(False))


def _first_string(v: Column) -> Column:
    """A string, the url, name or @id of an object, or the first of these in a list that isn't empty."""
    def own(x: Column) -> Column:
        return F.coalesce(_as_string(x), *[_as_string(_field(x, k)) for k in ("url", "name", "@id")])

    found = F.filter(F.transform(_opened(v), own), lambda s: F.coalesce(s, F.lit("")) != "")
    return F.coalesce(own(v), F.try_element_at(found, F.lit(1)))


def _number(v: Column) -> Column:
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)")
    return F.coalesce(F.when(numeric, v.try_cast("double")), leading_number(_as_string(v)))


def _block_value(text: Column) -> Column:
    """The value of a block's JSON, which may end with a semicolon; null if it is none or no event type stands in it.

    A name may also be written with escapes, so a text with one is always parsed.
    """
    names = [t for t in vocab.STRUCTURED_EVENT_TYPES if not any(o != t and o in t for o in vocab.STRUCTURED_EVENT_TYPES)]
    bare = F.btrim(text, F.lit(SPACES))
    whole = F.when(bare.endswith(";"), F.left(bare, F.length(bare) - 1)).otherwise(bare)
    return F.when(text.rlike("|".join(names) + r"|\\u"), F.try_parse_json(whole))


def structured_nodes(pages: DataFrame) -> DataFrame:
    """Rows of (page_url, html) with ``_nodes``: array<struct<path, own>> of the event nodes of a page with their fields.

    A path begins with the number of its block, so ordered paths are the order of the document. The walk is a chain of
    row-local projections, one per level: a page is parsed once, a node is read once, and nothing is shuffled.
    """
    blocks = F.regexp_extract_all("html", F.lit(BLOCK), 1)
    roots = F.transform(blocks, lambda text, i: F.struct(F.array(i).alias("path"), _block_value(text).alias("v")))
    level = pages.select("page_url", F.filter(roots, lambda r: r["v"].isNotNull()).alias("_level"))
    level = level.select("page_url", F.transform("_level", lambda r: _node(r["path"], r["v"])).alias("_level"))
    found = []
    for n in range(MAX_DEPTH + 1):
        typed = F.transform(
            F.filter("_level", lambda x: x["own"]["@type"].isNotNull()),
            lambda x: F.struct(x["path"].alias("path"), F.struct(*[x["own"][k].alias(k) for k in EVENT_FIELDS]).alias("own")))
        below = [F.flatten(F.transform("_level", _children)).alias("_level")] if n < MAX_DEPTH else []
        level = level.select("page_url", *found, typed.alias(f"_found{n}"), *below)
        found.append(f"_found{n}")
    events = F.filter(F.concat(*found), lambda x: _is_event(x["own"]["@type"]))
    return computed_once(level, _nodes=events).select("page_url", "_nodes")


def _firsts(pages: DataFrame) -> DataFrame:
    """(page_url, own, title, source_id, start): the fields of the named and dated nodes of a page, the first of each id.

    All within the row of the page; no page meets another.
    """
    nodes = computed_once(structured_nodes(pages), _order=F.array_sort(
        F.transform("_nodes", lambda n, i: F.struct(n["path"].alias("path"), i.alias("i")))))
    read = F.transform("_order", lambda o: F.get("_nodes", o["i"])["own"])
    texts = F.transform(read, lambda x: F.struct(
        x.alias("own"), _first_string(x["name"]).alias("title"),
        F.coalesce(_first_string(x["url"]), "page_url").alias("source_id"), _as_string(x["startDate"]).alias("start")))
    dated = F.transform(texts, lambda t: F.struct(
        t["own"].alias("own"), t["title"].alias("title"), t["source_id"].alias("source_id"), parse_time(t["start"]).alias("start")))
    valid = computed_once(nodes, _valid=F.filter(
        dated, lambda e: (F.coalesce(e["title"], F.lit("")) != "") & e["start"].isNotNull()))
    ranked = computed_once(valid, _ids=F.array_sort(
        F.transform("_valid", lambda e, i: F.struct(e["source_id"].alias("id"), i.alias("i")))))
    kept = F.filter("_ids", lambda x, i: (i == 0) | (F.get("_ids", i - 1)["id"] != x["id"]))
    return ranked.select(
        "page_url", F.inline(F.transform(kept, lambda x: F.get("_valid", x["i"]))))


def page_events(pages: DataFrame) -> DataFrame:
    """Raw listings of (page_url, html), the first of each id per row of ``pages``."""
    own = F.col("own")
    offers = own["offers"]
    # Every value used more than once is an attribute of its own.
    nodes = computed_once(
        _firsts(pages), _loc=_innermost_first(own["location"]), _kind=_as_string(own["@type"]),
        _end=parse_time(_as_string(own["endDate"])),
        _price=_number(_field(F.coalesce(F.try_element_at(_as_array(offers), F.lit(1)), offers), "price")),
    )
    loc = F.col("_loc")
    address = _field(loc, "address")
    parts = F.concat_ws(", ", *[
        _as_string(_field(address, k)) for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode")
    ])
    category = F.regexp_replace(F.coalesce("_kind", F.lit("Event")), "Event$", "")
    mode = F.coalesce(_first_string(own["eventAttendanceMode"]), F.lit(""))
    price_text = F.when(F.col("_price") == 0, "Free").when(
        F.col("_price").isNotNull(), F.concat(F.lit("from "), number_text(F.col("_price")))
    )
    geo = _field(loc, "geo")
    listing = {
        "source": F.lit("websearch"), "source_id": F.col("source_id"), "title": F.col("title"),
        "description": F.coalesce(_as_string(own["description"]), F.lit("")),
        "start_time": iso(F.col("start")), "end_time": iso(F.col("_end")),
        "venue_name": F.coalesce(_as_string(loc), _as_string(_field(loc, "name")), F.lit("")),
        # Without address fields the joined parts are empty.
        "address": F.coalesce(_as_string(address), parts, F.lit("")),
        "lat": _number(_field(geo, "latitude")), "lng": _number(_field(geo, "longitude")),
        "url": F.col("source_id"), "image_url": F.coalesce(_first_string(own["image"]), F.lit("")),
        "category": F.coalesce(F.when(category != "", category), F.lit("Event")),
        "price_text": F.coalesce(price_text, F.lit("")), "is_online": mode.rlike("(?i)OnlineEventAttendanceMode"),
    }
    return nodes.select("page_url", "source_id", *[listing[c].alias(c) for c in RAW_COLUMNS if c != "source_id"])


def nearby_only(raw: DataFrame, area: Area) -> DataFrame:
    """Drop listings whose coordinates lie clearly outside the searched area."""
    lat, lng = F.col("lat"), F.col("lng")
    return raw.filter(lat.isNull() | lng.isNull() | inside_any_area(lat, lng, [area]))
