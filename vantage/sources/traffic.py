"""Traffic feed responses to observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vantage.functions.geo import haversine_m, in_box
from vantage.functions.shoot import alert_weight, jam_severity
from vantage.functions.times import half_up
from vantage.operators.merge import first_per_key

POINT = "struct<x:double,y:double>"
SAMPLES = "array<struct<k:bigint,lat:double,lon:double>>"
FEED_SCHEMA = f"""
pass_id string, response_no int,
jams array<struct<uuid:string,id:bigint,level:int,delay:int,length:double,speedKMH:double,
  street:string,city:string,line:array<{POINT}>>>,
alerts array<struct<uuid:string,id:bigint,type:string,subtype:string,reliability:double,nThumbsUp:int,
  street:string,city:string,reportDescription:string,pubMillis:bigint,location:{POINT}>>,
users array<struct<uuid:string,id:string,speed:double,speedKMH:double,x:double,y:double,
  location:struct<x:double,y:double,latitude:double,longitude:double>>>
"""


def _segments(line: Column) -> Column:
    """The stretches between neighbouring points of an array<struct<lat,lon>>, each with its metres."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda p, q: F.struct(
        p["lat"].alias("lat0"), p["lon"].alias("lon0"), q["lat"].alias("lat"), q["lon"].alias("lon"),
        haversine_m(p["lat"], p["lon"], q["lat"], q["lon"]).alias("metres")))


def line_samples(line: Column, spacing: float) -> Column:
    """Points every ``spacing`` metres along a line, its first point included: array<struct<k,lat,lon>>.

    One pass over the array carries the distance so far; a stretch gives the whole multiples of the spacing that lie in it.
    """
    def on(upto: Column, s: Column) -> Column:
        first, last = (F.floor(upto / spacing) + 1).cast("bigint"), F.floor((upto + s["metres"]) / spacing).cast("bigint")
        share = lambda k: (k * spacing - upto) / s["metres"]
        return F.when((s["metres"] > 0) & (last >= first), F.transform(F.sequence(first, last), lambda k: F.struct(
            k.alias("k"), (s["lat0"] + (s["lat"] - s["lat0"]) * share(k)).alias("lat"), (s["lon0"] + (s["lon"] - s["lon0"]) * share(k)).alias("lon"))))

    start = F.array(F.struct(F.lit(0).cast("bigint").alias("k"), F.get(line, F.lit(0))["lat"].alias("lat"), F.get(line, F.lit(0))["lon"].alias("lon")))
    none = F.array().cast(SAMPLES)
    walked = F.aggregate(
        _segments(line), F.struct(F.lit(0.0).alias("upto"), start.cast(SAMPLES).alias("found")),
        lambda acc, s: F.struct((acc["upto"] + s["metres"]).alias("upto"), F.concat(acc["found"], F.coalesce(on(acc["upto"], s).cast(SAMPLES), none)).alias("found")),
        lambda acc: acc["found"])
    return F.when(F.size(line) > 0, walked).otherwise(none)


def line_metres(line: Column) -> Column:
    return F.aggregate(_segments(line), F.lit(0.0), lambda acc, s: acc + s["metres"])


def _lines(points: DataFrame, key: list[str]) -> DataFrame:
    """One row a line, its points with positions in order; a line is one record of a feed."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    return points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).groupBy(*key).agg(own.alias("line"))


def sample_lines(points: DataFrame, key: list[str], spacing: float) -> DataFrame:
    """(key, k, lat, lon): ``line_samples`` of lines given as points (key, pos, lat, lon)."""
    return _lines(points, key).select(*key, F.inline(line_samples(F.col("line"), spacing)))


def line_lengths(points: DataFrame, key: list[str]) -> DataFrame:
    return _lines(points, key).select(*key, line_metres(F.col("line")).alias("length_m"))


def _exploded(feed: DataFrame, kind: str) -> DataFrame:
    return feed.select("pass_id", "response_no", F.posexplode(kind).alias("pos", "item")).select(
        "pass_id", "response_no", "pos", "item.*"
    )


def unique_jams(feed: DataFrame) -> DataFrame:
    """First jam of each key in a pass; a first sighting without a line still counts as seen."""
    rows = _exploded(feed, "jams").withColumn(
        "item_key", F.coalesce("uuid", F.col("id").cast("string"), F.lit("undefined"))
    )
    return first_per_key(rows, ["pass_id", "item_key"], ["response_no", "pos"]).filter(
        F.coalesce(F.size("line"), F.lit(0)) > 0
    )


def unique_alerts(feed: DataFrame, box: Column) -> DataFrame:
    rows = _exploded(feed, "alerts").withColumn(
        "item_key", F.coalesce("uuid", F.col("id").cast("string"), F.lit("undefined"))
    )
    return first_per_key(rows, ["pass_id", "item_key"], ["response_no", "pos"]).filter(
        F.coalesce(in_box(box, F.col("location.y"), F.col("location.x")), F.lit(False))
    )


def unique_users(feed: DataFrame, box: Column) -> DataFrame:
    """First sighting of each driver; drivers without any id are all kept."""
    rows = _exploded(feed, "users").withColumn("_id", F.coalesce("uuid", "id", F.lit("")))
    nameless = F.concat_ws("/", F.lit("#"), "response_no", "pos")
    rows = rows.withColumn("item_key", F.when(F.col("_id") != "", F.concat(F.lit("="), "_id")).otherwise(nameless))
    first = first_per_key(rows, ["pass_id", "item_key"], ["response_no", "pos"])
    # A location object decides alone; only without one do the flat fields count.
    nested = F.col("location").isNotNull()
    lat = F.when(nested, F.coalesce("location.y", "location.latitude")).otherwise(F.col("y"))
    lon = F.when(nested, F.coalesce("location.x", "location.longitude")).otherwise(F.col("x"))
    speed = F.coalesce(F.col("speedKMH"), F.col("speed") * 3.6)
    return first.withColumns({"lat": lat, "lon": lon, "speed_kmh": speed}).filter(
        F.coalesce(in_box(box, F.col("lat"), F.col("lon")), F.lit(False))
    )


def _meta(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def feed_observations(feed: DataFrame, box: Column, spacing: float = 100.0, stationary_boost: float = 1.5) -> DataFrame:
    """Weighted observations (pass_id, source, kind, lat, lon, weight, meta) of every pass."""
    jams = unique_jams(feed)
    known = F.filter("line", lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    lines = jams.withColumn("line", F.transform(known, lambda p: F.struct(p["y"].alias("lat"), p["x"].alias("lon"))))
    jam_rows = lines.select(
        "pass_id", F.lit("waze-jam").alias("source"), F.concat(F.lit("level-"), F.coalesce("level", F.lit(0)).cast("string")).alias("kind"),
        jam_severity(F.col("level"), F.col("delay")).alias("weight"),
        _meta(street=F.col("street"), city=F.col("city"), speedKmh=F.col("speedKMH"), delaySec=F.col("delay"),
              lengthM=half_up(F.coalesce(F.col("length"), line_metres(F.col("line"))))).alias("meta"),
        F.inline(line_samples(F.col("line"), spacing)),
    ).filter(in_box(box, F.col("lat"), F.col("lon"))).select("pass_id", "source", "kind", "lat", "lon", "weight", "meta")
    subtype = F.when(F.col("subtype") != "", F.col("subtype"))
    kind_of = F.when(F.col("type") != "", F.col("type"))
    reported = F.when(
        F.col("pubMillis") != 0,
        F.date_format(F.timestamp_millis("pubMillis"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"),
    )
    alert_rows = unique_alerts(feed, box).select(
        "pass_id", F.lit("waze-alert").alias("source"), F.coalesce(subtype, kind_of, F.lit("UNKNOWN")).alias("kind"),
        F.col("location.y").alias("lat"), F.col("location.x").alias("lon"),
        alert_weight(F.col("type"), F.col("reliability")).alias("weight"),
        _meta(type=F.col("type"), subtype=F.col("subtype"), street=F.col("street"), city=F.col("city"),
              description=F.col("reportDescription"), reportedAt=reported, reliability=F.col("reliability"),
              thumbsUp=F.coalesce("nThumbsUp", F.lit(0))).alias("meta"),
    )
    parked = F.coalesce(F.col("speed_kmh") < 5, F.lit(False))
    user_rows = unique_users(feed, box).select(
        "pass_id", F.lit("waze-users").alias("source"), F.when(parked, "stationary").otherwise("moving").alias("kind"),
        "lat", "lon", F.when(parked, stationary_boost).otherwise(1.0).alias("weight"),
        _meta(speedKmh=half_up(F.col("speed_kmh"))).alias("meta"),
    )
    return jam_rows.unionByName(alert_rows).unionByName(user_rows)


def pass_counters(feed: DataFrame, box: Column) -> DataFrame:
    """Unique jams, alerts in the box and users in the box per pass."""
    count = lambda df, n: df.groupBy("pass_id").agg(F.count(F.lit(1)).alias(n))
    passes = feed.select("pass_id").distinct()
    for df, n in ((unique_jams(feed), "jams"), (unique_alerts(feed, box), "alerts"), (unique_users(feed, box), "users")):
        passes = passes.join(count(df, n), "pass_id", "left")
    return passes.fillna(0, ["jams", "alerts", "users"])


# --- snapshot -----------------------------------------------------------------------


def newest_pass(observations: DataFrame, as_of: Column, max_age_hours: int, sources: list[str]) -> DataFrame:
    """Rows of the newest traffic pass per area, if it is recent enough."""
    recent = observations.filter(
        F.col("source").isin(sources) & (F.col("ts") >= as_of - F.make_dt_interval(hours=F.lit(max_age_hours)))
    )
    return recent.join(recent.groupBy("area").agg(F.max("ts").alias("ts")), ["area", "ts"])


def snapshot_reports(latest: DataFrame) -> DataFrame:
    """Alerts, and one marker per jam (its first stored point). Expects parsed meta."""
    jams = latest.filter(F.col("source") == "waze-jam").withColumn("jam_key", F.concat_ws(
        "|", F.coalesce(F.col("meta.street"), F.lit("")), F.coalesce(F.col("meta.lengthM").cast("string"), F.lit("")),
        F.coalesce(F.col("meta.delaySec").cast("string"), F.lit("")),
    ))
    first = jams.groupBy("area", "ts", "jam_key").agg(
        F.min_by(F.struct("obs_id", "kind", "lat", "lon", "meta"), "obs_id").alias("r")
    ).select("area", "ts", F.lit("JAM").alias("kind"), F.coalesce("r.meta.type", F.lit("JAM")).alias("type"),
             "r.obs_id", "r.lat", "r.lon", "r.meta")
    alerts = latest.filter(F.col("source") == "waze-alert").select(
        "area", "ts", F.coalesce("kind", F.lit("UNKNOWN")).alias("kind"), F.col("meta.type").alias("type"),
        "obs_id", "lat", "lon", "meta",
    )
    return first.unionByName(alerts).select(
        "area", "ts", "obs_id", "kind", "type", "lat", "lon", "meta.street", "meta.description", "meta.reportedAt",
        "meta.delaySec", "meta.lengthM",
    )


def snapshot_drivers(latest: DataFrame) -> DataFrame:
    return latest.filter(F.col("source") == "waze-users").select(
        "area", "ts", "obs_id", "lat", "lon", (F.col("kind") == "stationary").alias("stationary")
    )
