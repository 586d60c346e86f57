"""Registered queries over density observations and venues."""

from __future__ import annotations

from pyspark.sql import functions as F

from vantage.functions import geo, shoot, times
from vantage.operators import grid, readings as rd, venue_life
from vantage.operators.ranking import sorted_positions
from vantage.plans import bindings as b
from vantage.plans.light_sql import dead_sql, label_sql, light_sql, score_sql, sun_sql, surge_sql, why_sql
from vantage.plans.registry import query, time_sql, time_text
from vantage.sources import observations as ob
from vantage.streaming import jobs

AS_OF = f"TIMESTAMP '{b.AS_OF}'"
DOW = "dayofweek(local_ts)"


def _readings(spark, sf):
    return rd.busyness(ob.parse_meta(b.observations(spark, sf)))


# --- scans and counts --------------------------------------------------------------------


@query("a11_scan_observations", f"""
WITH {b.OBS_SQL}
SELECT area, source, count(*) AS n, {time_sql('min(ts)')} AS first_ts, round(avg(weight), 4) AS avg_weight
FROM obs WHERE ts >= {AS_OF} - INTERVAL 20 DAY AND source IN ('google-popular', 'waze-jam')
  AND dayofweek(local_ts) IN (0, 6) GROUP BY ALL""")
def scan(spark, sf):
    rows = ob.scan_observations(
        b.observations(spark, sf), since=b.as_of() - F.make_dt_interval(days=F.lit(20)),
        sources=["google-popular", "waze-jam"], days_of_week=[0, 6], tz=b.TZ,
    )
    return rows.groupBy("area", "source").agg(
        F.count(F.lit(1)).alias("n"), time_text(F.min("ts")).alias("first_ts"), F.round(F.avg("weight"), 4).alias("avg_weight"))


@query("b11_b12_box_by_local_hour", f"""
WITH {b.OBS_SQL}
SELECT dayofweek(local_ts)::INTEGER AS dow, hour(local_ts)::INTEGER AS hour, count(*) AS n FROM obs
WHERE lat BETWEEN -33.45 AND -33.38 AND lon BETWEEN 149.53 AND 149.63 GROUP BY ALL""")
def box_hours(spark, sf):
    box = F.struct(*[F.lit(v).alias(k) for k, v in b.BOX.items()])
    obs = b.observations(spark, sf).filter(geo.in_box(box, F.col("lat"), F.col("lon")))
    return obs.groupBy(times.local_weekday(F.col("ts"), b.TZ).alias("dow"),
                       times.local_hour(F.col("ts"), b.TZ).alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@query("d9_observations_per_pass", f"""
WITH {b.OBS_SQL} SELECT run_id, source, count(*) AS observations FROM obs GROUP BY ALL""")
def per_pass(spark, sf):
    return ob.per_pass_source(b.observations(spark, sf))


@query("d11_snapshots", f"WITH {b.OBS_SQL} SELECT area, count(DISTINCT ts) AS snapshots FROM obs GROUP BY area")
def snapshots(spark, sf):
    return ob.snapshots(b.observations(spark, sf))


@query("e13_last_run", f"""
WITH {b.OBS_SQL}, runs AS (SELECT area, run_id, ts, count(*) || ' rows' AS summary FROM obs GROUP BY ALL)
SELECT area, {time_sql('max(ts)')} AS ts, max(run_id) AS run_id, arg_max(summary, ts) AS summary FROM runs GROUP BY area""")
def last_run(spark, sf):
    runs = b.observations(spark, sf).groupBy("area", "run_id", "ts").agg(
        F.concat(F.count(F.lit(1)).cast("string"), F.lit(" rows")).alias("summary"))
    return ob.last_run(runs).withColumn("ts", time_text(F.col("ts")))


# --- latest readings ------------------------------------------------------------------------

_LATEST = """latest AS (
  SELECT * FROM readings QUALIFY row_number() OVER (PARTITION BY area, name ORDER BY ts DESC, obs_id) = 1)"""


@query("e1_latest_reading", f"""
WITH {b.OBS_SQL}, {_LATEST}
SELECT area, name, obs_id, {time_sql('ts')} AS ts, live, typical FROM latest""")
def latest(spark, sf):
    return rd.latest_readings(_readings(spark, sf)).select(
        "area", "name", "obs_id", time_text(F.col("ts")).alias("ts"), "live", "typical")


@query("i3_latest", f"""
WITH {b.OBS_SQL}, {_LATEST}
SELECT area, name, {time_sql('ts')} AS ts, live, typical FROM latest""")
def latest_streamed(spark, sf):
    return jobs.latest_per_venue(_readings(spark, sf)).select("area", "name", time_text(F.col("ts")).alias("ts"), "live", "typical")


_VENUE_NOW = f"""{b.OBS_SQL}, {b.VENUE_SQL}, {_LATEST},
joined AS (
  SELECT v.area, v.cid, v.name, v.lat, v.lon, l.live, l.typical, coalesce(l.weight, 0) AS score, l.ts,
    coalesce(l.ts, {AS_OF}) AS seen FROM venues v LEFT JOIN latest l USING (area, name)),
{sun_sql('joined', 'seen', 'lat', 'lon')},
lit AS (SELECT *, {light_sql(f"hour(seen + INTERVAL {b.TZ_HOURS} HOUR)")} AS light, coalesce(live, typical) AS busy FROM sun),
now AS (SELECT *, {score_sql('busy', 'typical', 'light')} AS s FROM lit)"""


def _venue_now(spark, sf):
    return rd.venue_readings(b.venues(spark, sf), _readings(spark, sf), b.as_of(), b.TZ)


@query("c1_venue_readings", f"""
WITH {_VENUE_NOW}
SELECT area, cid, name, live, typical, round(score, 4) AS score, {time_sql('ts')} AS observed_at, light,
  CASE WHEN busy IS NULL THEN 0 ELSE round(s, 4) END AS shoot_score,
  CASE WHEN busy IS NULL THEN 'Unknown' ELSE {label_sql('s')} END AS shoot_label,
  CASE WHEN busy IS NULL THEN 'no reading'
    ELSE {why_sql('busy', 'typical', 'light', '(live IS NULL AND typical IS NOT NULL)')} END AS why,
  CASE WHEN busy IS NOT NULL THEN {surge_sql('busy', 'typical')} END AS surge
FROM now""")
def venue_readings(spark, sf):
    return _venue_now(spark, sf).select(
        "area", "cid", "name", "live", "typical", F.round("score", 4).alias("score"),
        time_text(F.col("observed_at")).alias("observed_at"), "shoot.light", F.round("shoot.score", 4).alias("shoot_score"),
        F.col("shoot.label").alias("shoot_label"), "shoot.why", "shoot.surge")


@query("f5_busiest_first", f"""
WITH {b.OBS_SQL}, {b.VENUE_SQL}, {_LATEST}
SELECT cid, name, live, typical,
  row_number() OVER (ORDER BY CASE WHEN live IS NOT NULL THEN 0 WHEN typical IS NOT NULL THEN 1 ELSE 2 END, coalesce(live, typical, 0) DESC, area, cid) - 1 AS position
FROM venues LEFT JOIN latest USING (area, name)""")
def busiest(spark, sf):
    rows = b.venues(spark, sf).join(rd.latest_readings(_readings(spark, sf)), ["area", "name"], "left")
    return sorted_positions(rd.busiest_first(rows).select("cid", "name", "live", "typical"))


@query("f6_best_to_shoot", f"""
WITH {_VENUE_NOW}
SELECT cid, name, row_number() OVER (ORDER BY CASE WHEN busy IS NULL THEN 0 ELSE round(s, 9) END DESC, name, area, cid) - 1 AS position FROM now""")
def best_to_shoot(spark, sf):
    return sorted_positions(rd.best_to_shoot(_venue_now(spark, sf)).select("cid", "name"))


@query("f9_readings_by_score", f"""
WITH {_VENUE_NOW} SELECT area, cid, row_number() OVER (ORDER BY score DESC, area, cid) - 1 AS position FROM now""")
def readings_by_score(spark, sf):
    return sorted_positions(rd.by_score(_venue_now(spark, sf)).select("area", "cid"))


@query("f8_live_now_top10", f"""
WITH {b.OBS_SQL}, {b.VENUE_SQL}, {_LATEST}
SELECT area, name, live, typical, CASE WHEN live > typical THEN '↑' WHEN live < typical THEN '↓'
  WHEN live = typical THEN '·' END AS versus
FROM venues JOIN latest USING (area, name) WHERE live IS NOT NULL ORDER BY live DESC, area, name LIMIT 10""")
def live_now(spark, sf):
    rows = b.venues(spark, sf).join(rd.latest_readings(_readings(spark, sf)), ["area", "name"])
    return rd.live_now(rows).select("area", "name", "live", "typical",
                                    shoot.versus_typical(F.col("live"), F.col("typical")).alias("versus"))


@query("b16_venue_name_search", f"""
WITH {b.VENUE_SQL} SELECT area, count(*) AS venues FROM venues WHERE contains(lower(name), 'venue 1') GROUP BY area""")
def name_search(spark, sf):
    return rd.venue_named(b.venues(spark, sf), "Venue 1").groupBy("area").agg(F.count(F.lit(1)).alias("venues"))


# --- histories ---------------------------------------------------------------------------------


_HOURLY = f"""
WITH {b.OBS_SQL}
SELECT area, name, dayofweek(local_ts)::INTEGER AS dow, hour(local_ts)::INTEGER AS hour,
  floor(avg(live) + 0.5)::INTEGER AS avg_live, count(*) AS samples
FROM readings WHERE live IS NOT NULL GROUP BY ALL"""


@query("d7_hourly_pattern", _HOURLY)
def hourly(spark, sf):
    return rd.hourly_pattern(_readings(spark, sf), b.TZ)


@query("i7_folded_hours", _HOURLY)
def folded_hours(spark, sf):
    return jobs.fold_hours(jobs.quarter_sums(_readings(spark, sf)), b.TZ)


@query("e17_trailing_baseline", f"""
WITH {b.OBS_SQL}, hourly AS (
  SELECT area, name, floor(epoch(ts) / 3600)::BIGINT AS hour, sum(live)::BIGINT AS total, count(*) AS n
  FROM readings WHERE live IS NOT NULL AND ts IS NOT NULL GROUP BY ALL),
beside AS (
  SELECT h.area, h.name, h.hour, floor(h.total / h.n::DOUBLE + 0.5)::INTEGER AS live, h.n AS samples,
    floor(sum(g.total) / sum(g.n)::DOUBLE + 0.5)::INTEGER AS usual, coalesce(sum(g.n), 0)::BIGINT AS usual_samples
  FROM hourly h LEFT JOIN hourly g ON g.area = h.area AND g.name = h.name AND g.hour BETWEEN h.hour - 24 * 28 AND h.hour - 1
  GROUP BY h.area, h.name, h.hour, h.total, h.n)
SELECT *, {surge_sql('live', 'usual')} AS surge, {dead_sql('live', 'usual')} AS dead FROM beside""")
def trailing(spark, sf):
    return rd.trailing_baseline(_readings(spark, sf))


@query("d8_daily_coverage", f"""
WITH {b.OBS_SQL}, {b.VENUE_SQL}, week AS (SELECT DISTINCT area, cid, name, d AS dow FROM venues, range(7) t(d)),
counted AS (SELECT area, name, {DOW} AS dow, count(*) AS readings, count(live) AS live FROM readings GROUP BY ALL)
SELECT area, cid, name, dow::INTEGER AS dow, coalesce(readings, 0) AS readings, coalesce(live, 0) AS live
FROM week LEFT JOIN counted USING (area, name, dow)""")
def coverage(spark, sf):
    return rd.daily_coverage(_readings(spark, sf), b.venues(spark, sf), b.TZ)


@query("f10_recent_readings", f"""
WITH {b.OBS_SQL}
SELECT area, name, row_number() OVER w AS position, {time_sql('ts')} AS ts, live, typical FROM readings
WINDOW w AS (PARTITION BY area, name ORDER BY ts DESC, obs_id DESC) QUALIFY row_number() OVER w <= 8""")
def recent(spark, sf):
    return rd.recent_readings(_readings(spark, sf)).select(
        "area", "name", "position", time_text(F.col("ts")).alias("ts"), "live", "typical")


_WEEK = f"""week AS (SELECT area, cid, name, lat, lon, pos, has_profile, {AS_OF} + to_days(d::INTEGER) AS seen,
  dayofweek({AS_OF} + INTERVAL {b.TZ_HOURS} HOUR + to_days(d::INTEGER)) AS dow FROM venues, range(7) t(d))"""


@query("h22_week_light", f"""
WITH {b.VENUE_SQL}, {_WEEK}, {sun_sql('week', 'seen', 'lat', 'lon')}
SELECT cid, dow::INTEGER AS dow, h::INTEGER AS hour, {light_sql('h')} AS light FROM sun, range(24) t(h)""")
def week_light(spark, sf):
    light = rd.week_light(b.venues(spark, sf), b.as_of(), b.TZ)
    return light.select("cid", "dow", F.posexplode("light_by_hour").alias("hour", "light"))


_WINDOWS = f"""{b.VENUE_SQL}, {_WEEK}, {sun_sql('week', 'seen', 'lat', 'lon')},
curve AS (SELECT area, cid, name, dow, h AS hour, ((pos * 7 + dow * 13 + h * 11) % 101)::INTEGER AS pct,
  {light_sql('h')} AS light FROM sun, range(8, 21) t(h) WHERE has_profile),
scored AS (SELECT *, {score_sql('pct', 'NULL::INTEGER', 'light')} AS s FROM curve),
best AS (SELECT area, cid, name, dow, max(s) AS top FROM scored GROUP BY ALL),
best_hour AS (SELECT area, cid, name, dow, top, min(hour) AS best_hour FROM scored JOIN best USING (area, cid, name, dow)
  WHERE s = top GROUP BY ALL),
near AS (SELECT scored.*, best_hour, top, hour - row_number() OVER (PARTITION BY cid, dow ORDER BY hour) AS island
  FROM scored JOIN best_hour USING (area, cid, name, dow) WHERE s >= top - 0.08::DOUBLE),
chosen AS (SELECT cid, dow, island FROM near WHERE hour = best_hour),
windows AS (SELECT area, cid, name, dow, min(hour) AS from_hour, max(hour) AS to_hour, any_value(top) AS top
  FROM near JOIN chosen USING (cid, dow, island) GROUP BY ALL HAVING any_value(top) > 0.2::DOUBLE)"""


@query("e9_best_windows", f"""
WITH {_WINDOWS}
SELECT cid, dow::INTEGER AS dow, from_hour::INTEGER AS from_hour, to_hour::INTEGER AS to_hour,
  round(top, 4) AS score, {label_sql('top')} AS label FROM windows""")
def windows(spark, sf):
    best = rd.best_windows(b.venues(spark, sf), b.as_of(), b.TZ).filter(F.col("best").isNotNull())
    return best.select("cid", "dow", "best.from_hour", "best.to_hour", F.round("best.score", 4).alias("score"), "best.label")


@query("c2_history_summary", f"""
WITH {b.OBS_SQL}, {_WINDOWS},
recent AS (SELECT * FROM readings WHERE ts >= {AS_OF} - INTERVAL 14 DAY),
days7 AS (SELECT DISTINCT area, cid, name, d AS dow FROM venues, range(7) t(d)),
counted AS (SELECT area, name, {DOW} AS dow, count(*) AS readings, count(live) AS live FROM recent GROUP BY ALL)
SELECT area, cid, name, dow::INTEGER AS dow, coalesce(readings, 0) AS readings, coalesce(live, 0) AS live,
  from_hour::INTEGER AS from_hour, to_hour::INTEGER AS to_hour
FROM days7 LEFT JOIN counted USING (area, name, dow) LEFT JOIN windows USING (area, cid, dow)""")
def history(spark, sf):
    parts = rd.venue_history(b.venues(spark, sf), _readings(spark, sf), b.as_of(), b.TZ)
    return parts["summary"].select("area", "cid", "name", "dow", "readings", "live", "best.from_hour", "best.to_hour")


@query("b19_verdict_now", f"""
WITH {b.OBS_SQL}, {b.VENUE_SQL}, {_WEEK}, {sun_sql('week', 'seen', 'lat', 'lon')},
fresh AS (SELECT * FROM readings WHERE ts >= TIMESTAMP '2024-01-17 12:00:00' AND name IN (SELECT name FROM venues)
  QUALIFY row_number() OVER (PARTITION BY area, name ORDER BY ts DESC, obs_id DESC) = 1),
lit AS (SELECT f.*, s.cid, coalesce(f.live, f.typical) AS busy, {light_sql('hour(f.local_ts)')} AS light
  FROM fresh f JOIN sun s ON s.area = f.area AND s.name = f.name AND s.dow = dayofweek(f.local_ts))
SELECT area, cid, name, {time_sql('ts')} AS ts,
  CASE WHEN TIMESTAMP '2024-01-31 12:00:00' - ts < INTERVAL 2 HOUR THEN round({score_sql('busy', 'typical', 'light')}, 4) END AS score
FROM lit""")
def verdict_now(spark, sf):
    parts = rd.venue_history(b.venues(spark, sf), _readings(spark, sf), b.as_of(), b.TZ)
    return parts["now"].select("area", "cid", "name", time_text(F.col("ts")).alias("ts"), F.round("now.score", 4).alias("score"))


# --- heat grid -------------------------------------------------------------------------------------

_CELLS = f"""{b.OBS_SQL}, {b.GRID_SQL},
located AS (
  SELECT o.*, g.*, floor((o.lat - south) / d_lat)::BIGINT AS gr, floor((o.lon - west) / d_lon)::BIGINT AS gc
  FROM obs o JOIN grids g ON o.area = g.slug),
inside AS (SELECT * FROM located WHERE gr BETWEEN 0 AND n_rows - 1 AND gc BETWEEN 0 AND n_cols - 1),
offsets AS (SELECT a.range AS dr, c.range AS dc FROM range(-3, 4) a, range(-3, 4) c),
hits AS (
  SELECT area, gr + dr AS r, gc + dc AS c, source, label, obs_id, weight,
    weight * exp(-(pow(sqrt((dr * dr + dc * dc)::DOUBLE) * cell, 2)) / (2 * pow(greatest(kernel / 3, cell / 2), 2))) AS w
  FROM inside, offsets
  WHERE sqrt((dr * dr + dc * dc)::DOUBLE) * cell <= kernel
    AND gr + dr BETWEEN 0 AND n_rows - 1 AND gc + dc BETWEEN 0 AND n_cols - 1),
layers AS (SELECT area, r, c, source, sum(w) AS raw FROM hits GROUP BY ALL),
cells AS (SELECT area, r, c, round(sum(raw), 9) AS raw FROM layers GROUP BY ALL HAVING round(sum(raw), 9) > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY raw) - 1 AS i,
  count(*) OVER (PARTITION BY area) AS n FROM cells),
scales AS (SELECT area, n, raw AS scale FROM ranked
  WHERE i = least(n - 1, greatest(0, floor((n - 1) * 0.97::DOUBLE + 0.5))))"""


def _located(spark, sf):
    obs = ob.parse_meta(b.observations(spark, sf)).withColumn("label", F.coalesce("meta.name", "meta.street"))
    return grid.locate(obs.select("area", "obs_id", "source", "lat", "lon", "weight", "label"), b.grid_areas(spark))


@query("d12_density_by_source", f"""
WITH {_CELLS} SELECT area, r, c, source, round(raw, 3) AS raw FROM layers""")
def density(spark, sf):
    return grid.density_by_source(_located(spark, sf)).withColumn("raw", F.round("raw", 3))


@query("d13_normalised_cells", f"""
WITH {_CELLS}
SELECT area, r, c, round(raw, 3) AS raw, round(least(raw / scale, 1), 4) AS score, round(scale, 4) AS scale
FROM cells JOIN scales USING (area)""")
def normalised(spark, sf):
    return grid.heat_grid(_located(spark, sf)).select("area", "r", "c", "raw", "score", F.round("scale", 4).alias("scale"))


@query("f9_cells_by_score", f"""
WITH {_CELLS}
SELECT area, r, c, row_number() OVER (ORDER BY round(least(raw / scale, 1), 4) DESC, area, r, c) - 1 AS position
FROM cells JOIN scales USING (area)""")
def cells_by_score(spark, sf):
    return sorted_positions(grid.by_score(grid.heat_grid(_located(spark, sf))).select("area", "r", "c"))


@query("e5_cell_labels", f"""
WITH {_CELLS}
SELECT area, r, c, arg_min(label, {{'w': -w, 'o': obs_id}}) AS top_name FROM hits WHERE w > 0 AND label <> '' GROUP BY ALL""")
def labels(spark, sf):
    return grid.cell_labels(_located(spark, sf))


@query("a16_features", f"""
WITH {_CELLS}, scored AS (SELECT area, r, c, round(raw, 3) AS raw, round(least(raw / scale, 1), 4) AS score FROM cells JOIN scales USING (area))
SELECT area, r, c, raw, score, round(south + r * d_lat, 6) AS south, round(west + (c + 1) * d_lon, 6) AS east
FROM scored JOIN grids ON area = slug""")
def features(spark, sf):
    areas = b.grid_areas(spark)
    rows = grid.cell_features(grid.heat_grid(_located(spark, sf)), areas)
    parsed = F.from_json("feature", "properties struct<score:double,raw:double>, geometry struct<coordinates:array<array<array<double>>>>")
    sized = areas.select(F.col("slug").alias("area"), "bbox", geo.grid_of(F.col("bbox"), F.col("cell_metres")).alias("g"))
    corner = lambda i, j: F.element_at(F.element_at(F.element_at("f.geometry.coordinates", 1), i), j)
    at = rows.withColumn("f", parsed).join(sized, "area").withColumns({
        "_south": corner(1, 2), "_west": corner(1, 1), "_east": corner(2, 1)})
    return at.select(
        "area", F.round((F.col("_south") - F.col("bbox.south")) / F.col("g.d_lat")).cast("bigint").alias("r"),
        F.round((F.col("_west") - F.col("bbox.west")) / F.col("g.d_lon")).cast("bigint").alias("c"), "f.properties.raw",
        "f.properties.score", F.round("_south", 6).alias("south"), F.round("_east", 6).alias("east"))


@query("a16_grid_metadata", f"""
WITH {_CELLS}, c2 AS (SELECT area, count(*) AS observations, count(DISTINCT ts) AS snapshots FROM obs GROUP BY area)
SELECT area, name AS area_name, 'all history - ' || snapshots || ' snapshots' AS label, observations, snapshots,
  round(scale, 4) AS "normaliseScale" FROM c2 JOIN scales USING (area) JOIN areas ON area = slug""")
def metadata(spark, sf):
    meta = grid.grid_metadata(b.observations(spark, sf), grid.heat_grid(_located(spark, sf)), b.grid_areas(spark), b.as_of(), None)
    return meta.select("area", "area_name", "label", "observations", "snapshots", "normaliseScale")


@query("h33_cell_colours", f"""
WITH {_CELLS}, s AS (SELECT area, r, c, round(least(raw / scale, 1), 4) * 5 AS t FROM cells JOIN scales USING (area)),
stops AS (SELECT [13, 106, 177, 225, 252, 240] AS rr, [8, 0, 42, 100, 166, 249] AS gg, [135, 168, 144, 98, 54, 33] AS bb),
ramp AS (SELECT *, least(floor(t), 4)::INTEGER AS i, t - least(floor(t), 4) AS f FROM s, stops)
SELECT area, r, c, '#' || lpad(lower(to_hex(floor(rr[i + 1] + (rr[i + 2] - rr[i + 1]) * f + 0.5)::INTEGER)), 2, '0')
  || lpad(lower(to_hex(floor(gg[i + 1] + (gg[i + 2] - gg[i + 1]) * f + 0.5)::INTEGER)), 2, '0')
  || lpad(lower(to_hex(floor(bb[i + 1] + (bb[i + 2] - bb[i + 1]) * f + 0.5)::INTEGER)), 2, '0') AS colour FROM ramp""")
def colours(spark, sf):
    return grid.heat_grid(_located(spark, sf)).select("area", "r", "c", shoot.ramp_colour(F.col("score")).alias("colour"))


# --- venues ------------------------------------------------------------------------------------------


@query("d10_area_summary", f"""
WITH {b.VENUE_SQL}, {b.GRID_SQL}
SELECT slug, a.name, count(cid) AS venues, count(*) FILTER (has_profile) AS with_profile
FROM areas a LEFT JOIN venues v ON v.area = a.slug GROUP BY ALL""")
def area_summary(spark, sf):
    return rd.area_summary(b.grid_areas(spark), b.venues(spark, sf))


@query("d25_venues_watched", f"WITH {b.VENUE_SQL} SELECT count(*) AS watched FROM venues")
def watched(spark, sf):
    return rd.area_summary(b.grid_areas(spark), b.venues(spark, sf)).agg(F.sum("venues").alias("watched"))


@query("d20_venues_per_term", f"WITH {b.VENUE_SQL} SELECT area, term, count(*) AS venues FROM venues GROUP BY ALL")
def per_term(spark, sf):
    return venue_life.venues_per_term(b.venues(spark, sf))


@query("e7_round_robin", f"""
WITH {b.VENUE_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY area, term ORDER BY pos) AS turn,
  min(pos) OVER (PARTITION BY area, term) AS term_pos FROM venues)
SELECT area, cid, term FROM t QUALIFY row_number() OVER (PARTITION BY area ORDER BY turn, term_pos) <= 30""")
def round_robin(spark, sf):
    return venue_life.round_robin(b.venues(spark, sf), 30, group=["area"]).select("area", "cid", "term")


@query("e8_choose_venues", f"""
WITH {b.VENUE_SQL},
linked AS (SELECT cid, term, pos FROM venues WHERE term = 'NATION_5' AND pos % 4 = 0),
pinned AS (SELECT cid, term, pos FROM venues WHERE term IN ('NATION_3', 'NATION_7')
  QUALIFY row_number() OVER (PARTITION BY term ORDER BY pos) <= 2),
rest AS (SELECT cid, term, pos, row_number() OVER (PARTITION BY term ORDER BY pos) AS turn,
  min(pos) OVER (PARTITION BY term) AS term_pos FROM venues WHERE cid NOT IN (SELECT cid FROM pinned UNION ALL SELECT cid FROM linked))
SELECT cid, term FROM linked UNION ALL SELECT cid, term FROM pinned UNION ALL
(SELECT cid, term FROM rest ORDER BY turn, term_pos LIMIT (SELECT greatest(0, 60 - count(*) - (SELECT count(*) FROM linked)) FROM pinned))""")
def choose(spark, sf):
    found = b.venues(spark, sf).select("cid", "term", "pos")
    return venue_life.choose_venues(found, found.filter("term = 'NATION_5' and pos % 4 = 0"), ["NATION_3", "NATION_7"], 60).select("cid", "term")


@query("f12_pinned_first", f"""
WITH {b.VENUE_SQL}, p AS (SELECT cid, pos, CASE WHEN term = 'NATION_5' THEN 'pinned link' ELSE term END AS term FROM venues)
SELECT cid, term FROM p ORDER BY (term = 'pinned link') DESC, pos LIMIT 30""")
def pinned(spark, sf):
    term = F.when(F.col("term") == "NATION_5", venue_life.PINNED_LINK).otherwise(F.col("term"))
    return venue_life.pinned_first(b.venues(spark, sf).withColumn("term", term), 30).select("cid", "term")


@query("e18_polling_cost", f"""
WITH {b.VENUE_SQL}, w AS (SELECT area, CASE WHEN barren_streak < 3 OR barren_streak % 24 = 0 THEN 13000 ELSE 3500 END AS wait FROM venues)
SELECT area, count(*) AS venues, count(*) FILTER (wait < 13000) AS quick_checked,
  floor(sum(4000 + wait / 2) / 60000 + 0.5)::BIGINT AS minutes FROM w GROUP BY area""")
def polling(spark, sf):
    return venue_life.polling_cost(b.venues(spark, sf))


@query("e6_barren_streaks", """
WITH checks AS (SELECT 'area-' || (user_id % 3) AS area, user_id::VARCHAR AS cid, event_id AS check_id,
  event_type = 'purchase' AS saw FROM events),
hit AS (SELECT area, cid, max(check_id) FILTER (saw) AS h FROM checks GROUP BY ALL)
SELECT area, cid, (count(*) FILTER (NOT saw AND (h IS NULL OR check_id > h)))::INTEGER AS barren_streak
FROM checks JOIN hit USING (area, cid) GROUP BY ALL""")
def streaks(spark, sf):
    checks = b.table(spark, sf, "events").select(
        F.concat(F.lit("area-"), F.col("user_id") % 3).alias("area"), F.col("user_id").cast("string").alias("cid"),
        F.col("event_id").alias("check_id"), (F.col("event_type") == "purchase").alias("saw_panel"))
    return venue_life.barren_streaks(checks)
