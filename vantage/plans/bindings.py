"""Domain tables derived from the generic test tables.

Each derivation is plain SQL arithmetic over a whole table, written once for
Spark and once for the checking engine (the *_SQL constants hold the latter as
common table expressions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantage import vocab
from vantage.operators.dedupe import event_key, group_id
from vantage.operators.merged import with_group
from vantage.operators.validate import Area

TZ = "Australia/Sydney"
# The zone is eleven hours ahead of UTC on every date the derived data uses.
TZ_HOURS = 11
AS_OF = "2024-01-31 12:00:00"
LISTING_AS_OF = "2024-02-12 06:00:00"
AREAS = [Area("Kelso", -33.4193, 149.5775, 2.5), Area("Orange", -33.39, 149.54, 2.0)]
HOME = (-33.4193, 149.5775)
GRID_AREAS = [("Area 0", "area-0", 150.0, 300.0), ("Area 1", "area-1", 200.0, 300.0), ("Area 2", "area-2", 100.0, 250.0)]
BOX = {"south": -33.45, "west": 149.53, "north": -33.38, "east": 149.63}

VENUE_SPELLINGS = [
    "Royal Hotel", "Royal Hotel Kelso", "The Royal Hotel", "Showground", "Showground Orange", "",
    "12 HIGH STREET, Kelso", "City Library (upper floor)",
]
TOWNS = ["Kelso", "Orange", "Robin Hill", ""]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the test tables; zone-less times are read as UTC instants."""
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    zoneless = [c for c, kind in rows.dtypes if kind == "timestamp_ntz"]
    rows = rows.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else rows
    # The test tables are one file of one row group, which is one task; a table of many files is read as it lies.
    if name in ("documents", "pages", "customer", "orders") and len(rows.inputFiles()) == 1:
        return rows.repartition(spark.sparkContext.defaultParallelism)
    return rows


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def listing_as_of():
    return F.lit(LISTING_AS_OF).cast("timestamp")


# --- observations -------------------------------------------------------------------

_SOURCE = """CASE event_type WHEN 'error' THEN 'waze-jam' WHEN 'purchase' THEN 'waze-alert' ELSE 'google-popular' END"""


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """(obs_id, run_id, ts, area, source, kind, lat, lon, weight, meta) from the event stream."""
    base = table(spark, sf, "events").selectExpr(
        "event_id AS obs_id", "date_trunc('HOUR', ts) AS ts", "concat('area-', user_id % 3) AS area",
        f"{_SOURCE} AS source", "user_id", "event_id",
        "CAST(get_json_object(props, '$.k') AS INT) AS k",
        "CASE WHEN event_id % 3 <> 0 THEN CAST(least(100D, floor(value)) AS INT) END AS live",
        "CAST(-33.46D + (event_id * 37 % 900) / 10000D AS DOUBLE) AS lat",
        "CAST(149.52D + (event_id * 53 % 1200) / 10000D AS DOUBLE) AS lon",
    )
    popular = F.col("source") == "google-popular"
    meta = F.when(popular, F.to_json(F.struct(
        F.concat(F.lit("venue "), F.col("user_id")).alias("name"), "live", F.col("k").alias("typical")
    ))).otherwise(F.to_json(F.struct(
        F.concat(F.lit("street "), F.col("user_id") % 20).alias("street"), (F.col("k") * 10).alias("lengthM"),
        (F.col("k") * 5).alias("delaySec"),
        F.when(F.col("source") == "waze-alert", F.lit("HAZARD")).alias("type"),
    )))
    weight = F.when(popular, F.coalesce("live", "k") / 100.0).otherwise((F.col("k") + 1) / 100.0)
    kind = F.when(popular, F.when(F.col("live").isNotNull(), "live").otherwise("typical")).when(
        F.col("source") == "waze-jam", F.concat(F.lit("level-"), F.col("k") % 6)).otherwise("HAZARD_ON_ROAD")
    return base.select(
        "obs_id", F.unix_seconds("ts").alias("run_id"), "ts", "area", "source", kind.alias("kind"), "lat", "lon",
        weight.alias("weight"), meta.alias("meta"),
    )


OBS_SQL = f"""obs0 AS (
  SELECT event_id AS obs_id, date_trunc('hour', ts) AS ts, 'area-' || (user_id % 3) AS area, {_SOURCE} AS source,
    user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
    CASE WHEN event_id % 3 <> 0 THEN CAST(least(100, floor(value)) AS INTEGER) END AS live,
    -33.46::DOUBLE + (event_id * 37 % 900)::DOUBLE / 10000 AS lat,
    149.52::DOUBLE + (event_id * 53 % 1200)::DOUBLE / 10000 AS lon
  FROM events),
obs AS (
  SELECT *, epoch(ts)::BIGINT AS run_id,
    CASE WHEN source = 'google-popular' THEN 'venue ' || user_id END AS name,
    CASE WHEN source <> 'google-popular' THEN 'street ' || (user_id % 20) END AS street,
    CASE WHEN source = 'google-popular' THEN 'venue ' || user_id ELSE 'street ' || (user_id % 20) END AS label,
    CASE WHEN source = 'google-popular' THEN coalesce(live, k)::DOUBLE / 100 ELSE (k + 1)::DOUBLE / 100 END AS weight,
    CASE WHEN source = 'google-popular' THEN CASE WHEN live IS NOT NULL THEN 'live' ELSE 'typical' END
         WHEN source = 'waze-jam' THEN 'level-' || (k % 6) ELSE 'HAZARD_ON_ROAD' END AS kind,
    ts + INTERVAL {TZ_HOURS} HOUR AS local_ts
  FROM obs0),
readings AS (
  SELECT obs_id, area, name, ts, local_ts, live, k AS typical, weight FROM obs WHERE source = 'google-popular')"""


def grid_areas(spark: SparkSession) -> DataFrame:
    """The configured areas of the density pass."""
    rows = [(n, s, (-33.45, 149.53, -33.38, 149.63), c, k) for n, s, c, k in GRID_AREAS]
    return spark.createDataFrame(
        rows, "name string, slug string, bbox struct<south:double,west:double,north:double,east:double>, "
              "cell_metres double, kernel_metres double",
    )


GRID_SQL = "areas AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{n}', '{s}', -33.45::DOUBLE, 149.53::DOUBLE, -33.38::DOUBLE, 149.63::DOUBLE, {c}::DOUBLE, {k}::DOUBLE)"
    for n, s, c, k in GRID_AREAS
) + """) t(name, slug, south, west, north, east, cell, kernel)),
sized AS (
  SELECT *, cell / 111320::DOUBLE AS d_lat,
    cell / (111320::DOUBLE * cos(radians((south + north) / 2))) AS d_lon FROM areas),
grids AS (
  SELECT *, greatest(1, ceil((north - south) / d_lat))::BIGINT AS n_rows,
    greatest(1, ceil((east - west) / d_lon))::BIGINT AS n_cols FROM sized)"""


# --- venues ---------------------------------------------------------------------------


def venues(spark: SparkSession, sf: str) -> DataFrame:
    """(area, cid, name, kgmid, lat, lon, term, profile, barren_streak) from customers."""
    base = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    hours = F.sequence(F.lit(8), F.lit(20))
    by_day = F.map_from_arrays(
        F.array(*[F.lit(d) for d in vocab.DAY_NAMES]),
        F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.map_from_arrays(
            hours, F.transform(hours, lambda h: ((F.col("c_custkey") * 7 + d * 13 + h * 11) % 101).cast("int")))),
    )
    profile = F.when(F.col("c_custkey") % 4 != 0, F.struct(
        F.lit("Saturday").alias("busiest_day"), F.lit(6).alias("busiest_day_index"), F.lit(12).alias("busiest_hour"),
        F.lit(90).alias("busiest_peak"), F.lit("Monday").alias("quietest_day"),
        F.array(F.lit("Saturday"), F.lit("Sunday")).alias("open_days"), by_day.alias("by_day"),
    ))
    return base.select(
        F.concat(F.lit("area-"), F.col("c_custkey") % 3).alias("area"), F.col("c_custkey").cast("string").alias("cid"),
        F.concat(F.lit("venue "), F.col("c_custkey")).alias("name"),
        F.concat(F.lit("/m/"), F.col("c_custkey")).alias("kgmid"),
        F.expr("CAST(-33.46D + (c_custkey * 37 % 900) / 10000D AS DOUBLE)").alias("lat"),
        F.expr("CAST(149.52D + (c_custkey * 53 % 1200) / 10000D AS DOUBLE)").alias("lon"),
        F.col("n_name").alias("term"), profile.alias("profile"), (F.col("c_custkey") % 30).cast("int").alias("barren_streak"),
        F.col("c_custkey").alias("pos"),
    )


VENUE_SQL = """venues AS (
  SELECT 'area-' || (c_custkey % 3) AS area, c_custkey::VARCHAR AS cid, 'venue ' || c_custkey AS name,
    -33.46::DOUBLE + (c_custkey * 37 % 900)::DOUBLE / 10000 AS lat,
    149.52::DOUBLE + (c_custkey * 53 % 1200)::DOUBLE / 10000 AS lon,
    n_name AS term, c_custkey % 4 <> 0 AS has_profile, (c_custkey % 30)::INTEGER AS barren_streak, c_custkey AS pos
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


# --- listings ---------------------------------------------------------------------------


def _pick(values: list[str], index: str) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_ADDRESS = (
    "CASE WHEN doc_id % 11 = 0 THEN 'TBA' ELSE concat(doc_id % 90 + 1, ' HIGH STREET, ', "
    + _pick(TOWNS, "doc_id % 4")
    + ", ', NS', CASE WHEN doc_id % 3 = 0 THEN 'W 2795' ELSE ', 2795' END, "
    "CASE WHEN doc_id % 5 = 0 THEN ', Australia, Orange' ELSE '' END) END"
)
_LISTING_FIELDS = f"""
  {_pick(VENUE_SPELLINGS, 'doc_id % 8')} AS venue_name, {_ADDRESS} AS address,
  concat('https://', source, '.example.org/e/', doc_id) AS url,
  CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('https://img.example.org/', doc_id % 10, '.jpg') END AS image_url,
  CASE WHEN doc_id % 6 = 0 THEN 'Music / Rock' WHEN doc_id % 6 = 1 THEN 'Other' ELSE '' END AS category,
  CASE WHEN doc_id % 3 = 0 THEN 'Free' ELSE '' END AS price_text, doc_id % 10 = 0 AS is_online,
  doc_id % 9 = 0 AS starred, doc_id % 17 = 0 AS hidden,
  CASE WHEN doc_id % 50 = 1 THEN concat('m', doc_id % 4) ELSE '' END AS manual_group"""


def listings(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows from the documents: the title is the opening words, the description the whole text."""
    # The first eight words, where there are as many, give the same six as the whole text without splitting all of it.
    head = F.regexp_extract("text", r"^\s*+(?:\S++\s++){7}\S", 0)
    titled = table(spark, sf, "documents").withColumn("_head", F.coalesce(F.nullif(head, F.lit("")), F.col("text"))).withColumn(
        "title", F.expr(r"concat_ws(' ', slice(split(regexp_replace(_head, '^\\s+|\\s+$', ''), '\\s+'), 1, 6))")
    ).drop("_head")
    rows = titled.selectExpr(
        "doc_id + 1 AS id", "source", "CAST(doc_id AS STRING) AS source_id", "title", "text AS description",
        "timestamp_seconds(unix_seconds(timestamp'2024-02-01') + (length(title) % 40) * 86400 + (doc_id % 24) * 3600) AS start_ts",
        "CASE WHEN doc_id % 5 <> 0 THEN CAST(-33.46D + (doc_id * 37 % 900) / 10000D AS DOUBLE) END AS lat",
        "CASE WHEN doc_id % 5 <> 0 THEN CAST(149.52D + (doc_id * 53 % 1200) / 10000D AS DOUBLE) END AS lng",
        "doc_id", *[x.strip() for x in _split_fields(_LISTING_FIELDS)],
    )
    end = F.col("start_ts") + F.make_dt_interval(hours=(F.col("doc_id") % 700 - 10).cast("int"))
    return rows.withColumns({
        "end_ts": F.when(F.col("doc_id") % 7 != 0, end), "photo_score": (F.col("doc_id") * 7 % 101).cast("double"),
        "archived": F.lit(False), "archived_at": F.lit(None).cast("timestamp"), "geocode_tried": F.lit(False),
        "dedupe_group": F.lit(""), "last_seen_at": F.lit("2024-02-01").cast("timestamp"),
    }).drop("doc_id")


def _split_fields(text: str) -> list[str]:
    """Split a select list on commas outside parentheses and CASE bodies."""
    out, depth, start, i = [], 0, 0, 0
    while i < len(text):
        word = text[i:i + 5].upper()
        if text[i] == "(" or word.startswith("CASE "):
            depth += 1
        elif text[i] == ")" or (word.startswith("END") and not text[i - 1].isalnum() and not text[i + 3:i + 4].isalnum()):
            depth -= 1
        elif text[i] == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
        i += 1
    return [*out, text[start:]]


LISTING_SQL = r"""titled AS (
  SELECT *, array_to_string((regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'))[1:6], ' ') AS title
  FROM documents),
listing AS (
  SELECT doc_id + 1 AS id, doc_id, source, doc_id::VARCHAR AS source_id, title, text AS description,
    TIMESTAMP '2024-02-01' + to_seconds((length(title) % 40) * 86400 + (doc_id % 24) * 3600) AS start_ts,
    CASE WHEN doc_id % 7 <> 0 THEN TIMESTAMP '2024-02-01'
      + to_seconds((length(title) % 40) * 86400 + (doc_id % 24 + doc_id % 700 - 10) * 3600) END AS end_ts,
    CASE WHEN doc_id % 5 <> 0 THEN -33.46::DOUBLE + (doc_id * 37 % 900)::DOUBLE / 10000 END AS lat,
    CASE WHEN doc_id % 5 <> 0 THEN 149.52::DOUBLE + (doc_id * 53 % 1200)::DOUBLE / 10000 END AS lng,
    (doc_id * 7 % 101)::DOUBLE AS photo_score,""" + _LISTING_FIELDS + """
  FROM titled)"""

TITLE_KEY_SQL = (
    "array_to_string(list_filter(string_split(regexp_replace(strip_accents(lower({0})), '[^a-z0-9]+', ' ', 'g'), ' '),"
    " lambda w: w <> '' AND w NOT IN ('the','a','an','at','of','in','on','and','with','presents','live','tour','show')), ' ')"
)
GROUPED_SQL = LISTING_SQL + f""",
keyed AS (SELECT *, {TITLE_KEY_SQL.format('title')} || '|' || strftime(start_ts, '%Y-%m-%d') AS dkey FROM listing),
grouped AS (
  SELECT *, CASE WHEN manual_group <> '' THEN manual_group ELSE substr(sha1(dkey || '#0'), 1, 16) END AS group_key FROM keyed)"""


def grouped_listings(spark: SparkSession, sf: str) -> DataFrame:
    """Listings grouped by title and date alone, as if none had a position."""
    rows = listings(spark, sf)
    return with_group(rows.withColumn(
        "dedupe_group", group_id(event_key(F.col("title"), F.col("start_ts")), F.lit(0))
    ))


def haversine_sql(lat1: str, lng1: str, lat2: str, lng2: str, radius: str = "6371") -> str:
    return (
        f"(2 * {radius} * asin(sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * "
        f"cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))))"
    )
