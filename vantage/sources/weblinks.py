"""Candidate result pages for structured-event extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions.text import host_of


def candidate_pages(links: DataFrame, per_query: int | None = None, extra_skipped: DataFrame | None = None) -> DataFrame:
    """Pages to read from (query_pos, link_pos, url): the first ``per_query`` links of each query (None: all), each page once.

    ``link_pos`` is zero-based within its query. Deny-listed hosts and their
    subdomains go; a table of further hosts (host) is removed with an
    anti-join on every parent domain.
    """
    head = links if per_query is None else links.filter(F.col("link_pos") < per_query)
    head = head.withColumn("host", host_of(F.col("url")))
    suffixes = "|".join(h.replace(".", r"\.") for h in vocab.SKIPPED_HOSTS)
    kept = head.filter(F.col("host").isNotNull() & ~F.col("host").rlike(rf"(^|\.)({suffixes})$"))
    if extra_skipped is not None:
        labels = F.split("host", r"\.")
        parents = F.transform(
            F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
        )
        hit = kept.select("host").distinct().withColumn("_parent", F.explode(parents)).join(
            extra_skipped.select(F.col("host").alias("_parent")), "_parent", "left_semi"
        ).select("host").distinct()
        kept = kept.join(hit, "host", "left_anti")
    page = F.substring_index("url", "#", 1)
    return kept.withColumn("page_url", page).groupBy("page_url").agg(
        F.min(F.struct("query_pos", "link_pos")).alias("_first"), F.first("host").alias("host")
    ).select("page_url", "host", "_first.query_pos", "_first.link_pos")
