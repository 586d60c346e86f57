"""One spelling per venue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions.address import is_country, is_postcode, is_region
from vantage.functions.text import squeeze, trim_all, venue_words
from vantage.operators.components import connected_components


def spelling_counts(events: DataFrame) -> DataFrame:
    return (
        events.filter(F.col("venue_name") != "").groupBy(F.col("venue_name").alias("name"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )


def _town_words(text: Column) -> Column:
    words = F.split(squeeze(F.regexp_replace(F.lower(text), r"[^a-z\s]", " ")), " ")
    usable = F.filter(
        words,
        lambda w: (F.length(w) > 2) & ~is_region(w) & ~is_country(w) & ~w.isin(vocab.REGION_NAME_WORDS),
    )
    return F.when(is_region(text) | is_country(text), F.array().cast("array<string>")).otherwise(usable)


def late_components(addresses: DataFrame, column: str = "address", at_least: int = 3) -> DataFrame:
    """Address components after the first that look like towns, with how often they occur."""
    parts = F.filter(F.transform(F.split(F.col(column), ","), trim_all), lambda p: p != "")
    # slice() would fail on an empty array with a start beyond its size.
    tail = F.filter(parts, lambda _p, i: i > 0)
    town = F.filter(
        tail,
        lambda p: ~p.rlike("[0-9]") & (F.size(F.split(squeeze(p), " ")) <= 3)
        & ~is_region(p) & ~is_country(p) & ~is_postcode(p),
    )
    return (
        addresses.select(F.explode(town).alias("part")).groupBy(F.lower("part").alias("part"))
        .agg(F.count(F.lit(1)).alias("uses")).filter(F.col("uses") >= at_least)
    )


def localities(area_names: list[str], addresses: DataFrame, column: str = "address") -> DataFrame:
    """Distinct words (word) that name towns: from areas and from repeated address components."""
    from_addresses = late_components(addresses, column).select(F.explode(_town_words(F.col("part"))).alias("word"))
    spark = addresses.sparkSession
    names = spark.createDataFrame([(n,) for n in area_names], "name string")
    from_areas = names.select(F.explode(_town_words(F.col("name"))).alias("word"))
    return from_addresses.unionByName(from_areas).distinct()


def _nodes(keys: DataFrame, towns: DataFrame) -> DataFrame:
    """Per key: its distinct words split into core words and town words."""
    known = towns.select(F.lower("word").alias("word")).distinct().withColumn("_town", F.lit(True))
    split = (
        keys.withColumn("word", F.explode(F.array_distinct("words"))).drop("words")
        .join(known, "word", "left")
    )
    # A name has few words, so these lists are short.
    return split.groupBy("key", "n_words").agg(
        F.array_sort(F.collect_list(F.when(F.col("_town").isNull(), F.col("word")))).alias("core"),
        F.array_sort(F.collect_list(F.when(F.col("_town"), F.col("word")))).alias("towns"),
    ).withColumn("word_set", F.array_join(F.array_sort(F.concat("core", "towns")), " "))


def absorb_edges(nodes: DataFrame) -> DataFrame:
    """(a, b): key a is key b said without some of its town words.

    The core words agree and a's town words are fewer of b's. A key without
    town words meets the longer ones on the core; any other meets them on the
    core and its first town word, which each of them lists once.
    """
    core = F.array_join("core", " ")
    a = nodes.select(F.col("key").alias("a"), F.col("n_words").alias("_an"), core.alias("_core"), F.col("towns").alias("_atowns"),
                     F.coalesce(F.try_element_at("towns", F.lit(1)), F.lit("")).alias("_town"))
    meets = F.explode(F.concat(F.array(F.lit("")), F.array_distinct("towns")))
    b = nodes.filter(F.size("towns") > 0).select(
        F.col("key").alias("b"), F.col("n_words").alias("_bn"), core.alias("_core"), F.col("towns").alias("_btowns"), meets.alias("_town"))
    return b.join(a, ["_core", "_town"]).filter(
        (F.size(F.array_except("_atowns", "_btowns")) == 0)
        & (F.size("_atowns") < F.size("_btowns")) & (F.col("_an") <= F.col("_bn"))
    ).select("a", "b")


def canonical_names(names: DataFrame, towns: DataFrame) -> DataFrame:
    """(name, canonical) for every spelling that gives way to another.

    ``names`` has (name, uses), ``towns`` has (word). Clusters are transitive;
    the most used spelling wins, then the shorter, then the alphabetically first.
    """
    named = (
        names.filter(trim_all(F.col("name")) != "").withColumn("words", venue_words(F.col("name")))
        .filter(F.size("words") > 0)
        .withColumns({"key": F.array_join("words", " "), "n_words": F.size("words")})
    )
    keys = named.select("key", "n_words", "words").dropDuplicates(["key"])
    parts = connected_components(absorb_edges(_nodes(keys, towns)))
    clustered = named.join(parts.withColumnRenamed("node", "key"), "key", "left").select(
        "name", "uses", F.coalesce("component", "key").alias("component")
    )
    preference = F.struct(-F.col("uses"), F.length("name"), F.collate("name", "UNICODE"))
    winners = clustered.groupBy("component").agg(
        F.min_by("name", preference).alias("canonical"), F.count(F.lit(1)).alias("_n")
    ).filter(F.col("_n") > 1)
    return (
        clustered.join(winners, "component").filter(F.col("name") != F.col("canonical"))
        .select("name", "canonical")
    )


def rewrite_venues(events: DataFrame, canonical: DataFrame) -> DataFrame:
    """Replace every superseded spelling."""
    mapping = canonical.select(F.col("name").alias("venue_name"), "canonical")
    return (
        events.join(mapping, "venue_name", "left")
        .withColumn("venue_name", F.coalesce("canonical", "venue_name")).drop("canonical")
        .select(*events.columns)
    )
