"""Registered queries over event listings."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions import address as ad, score, text
from vantage.operators import actions, calendar, clean, dedupe, merge, merged, place, validate, venues, views
from vantage.operators.ranking import sorted_positions
from vantage.plans import bindings as b
from vantage.plans.bindings import GROUPED_SQL, LISTING_SQL, TITLE_KEY_SQL, haversine_sql
from vantage.plans.registry import query, time_sql, time_text
from vantage.session import checkpointed

NOW = f"TIMESTAMP '{b.LISTING_AS_OF}'"


def _sub(template: str, expr: str) -> str:
    return template.replace("{0}", expr)


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# --- keys and text --------------------------------------------------------------------------


@query("h1_title_keys", f"WITH {LISTING_SQL} SELECT id, {_sub(TITLE_KEY_SQL, 'title')} AS title_key, {_sub(TITLE_KEY_SQL, 'description')} AS text_key FROM listing")
def title_keys(spark, sf):
    return b.listings(spark, sf).select("id", text.title_key(F.col("title")).alias("title_key"), text.title_key(F.col("description")).alias("text_key"))


_VENUE_KEY = (
    "array_to_string(list_sort(list_filter(string_split(regexp_replace(strip_accents(lower("
    "regexp_replace(regexp_replace(split_part({0}, ',', 1), '\\s+-\\s+[A-Z]{2,8}\\s*$', ''), '\\s*\\([^)]*\\)\\s*$', ''))),"
    " '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ("
    + _quoted(vocab.VENUE_GENERIC_WORDS + vocab.VENUE_NOISE_WORDS) + "))), ' ')"
)


@query("h2_venue_keys", f"""
WITH {LISTING_SQL}, names AS (SELECT venue_name AS name FROM listing UNION SELECT p_name FROM part UNION SELECT title FROM listing)
SELECT name, {_sub(_VENUE_KEY, 'name')} AS venue_key FROM names""")
def venue_keys(spark, sf):
    rows = b.listings(spark, sf)
    names = rows.select(F.col("venue_name").alias("name")).union(b.table(spark, sf, "part").select("p_name")).union(
        rows.select("title")).distinct()
    return names.select("name", F.array_join(text.venue_words(F.col("name")), " ").alias("venue_key"))


_UNSHOUT = (
    "CASE WHEN regexp_matches({0}, '[a-z]') THEN {0} ELSE array_to_string(list_transform("
    "regexp_extract_all({0}, '([\\pL][\\pL''’]*|[^\\pL]+)'), lambda x: CASE WHEN regexp_matches(x, '^\\pL') AND length(x) > 3"
    " THEN x[1] || lower(x[2:]) ELSE x END), '') END"
)


@query("h3_unshouted", f"""
WITH {LISTING_SQL}, t AS (SELECT id, address, upper(replace(title, 'ß', 'ss')) AS loud FROM listing)
SELECT id, {_sub(_UNSHOUT, 'address')} AS address, {_sub(_UNSHOUT, 'loud')} AS title FROM t""")
def unshouted(spark, sf):
    return b.listings(spark, sf).select(
        "id", text.unshout(F.col("address")).alias("address"), text.unshout(F.upper(F.replace("title", F.lit("ß"), F.lit("ss")))).alias("title"))


_ENTITY = "CASE x " + " ".join(
    f"WHEN '&{k};' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in vocab.ENTITIES.items()
) + " WHEN '&#39;' THEN '''' ELSE x END"
_DECODED = f"array_to_string(list_transform(regexp_extract_all({{0}}, '&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);|[^&]+|&'), lambda x: {_ENTITY}), '')"


def _cleaned_sql(expr: str) -> str:
    for pattern, to, flags in [
        ("<!--.*?-->", "''", "gs"), ("<(?:br|hr)\\s*/?>", "chr(10)", "gi"),
        ("</(?:p|div|li|tr|h[1-6]|blockquote)>", "chr(10) || chr(10)", "gi"), ("<[^>]*>", "''", "g"),
        ("(?:\\\\r)?\\\\n", "chr(10)", "g"), ("\\\\t", "' '", "g"), ("[\\t\\r\\f\\x0b \\x{00a0}]+", "' '", "g"),
        (" *\\n *", "chr(10)", "g"), ("\\n{3,}", "chr(10) || chr(10)", "g"), ("^\\s+|\\s+$", "''", "g"),
    ]:
        expr = f"regexp_replace({expr}, '{pattern}', {to}, '{flags}')"
    return expr


@query("h11_clean_descriptions", f"""
WITH bodies AS (SELECT 'page' AS kind, page_id AS id, html AS body FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents),
decoded AS (SELECT kind, id, {_sub(_DECODED, 'body')} AS body FROM bodies)
SELECT kind, id, {_cleaned_sql('body')} AS plain FROM decoded""")
def cleaned(spark, sf):
    bodies = b.table(spark, sf, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("body")).unionByName(
        b.table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")))
    return bodies.select("kind", "id", text.clean_description(F.col("body")).alias("plain"))


# --- addresses -----------------------------------------------------------------------------------

_REGION = "lower({0}) IN (" + _quoted(vocab.REGIONS) + ")"
_COUNTRY = "lower({0}) IN (" + _quoted(vocab.COUNTRIES) + ")"
_POSTCODE = "(" + " OR ".join("regexp_matches({0}, '" + p + "')" for p in vocab.POSTCODE_PATTERNS) + ")"
_PLACEHOLDER = "lower({0}) IN (" + _quoted(vocab.PLACEHOLDER_ADDRESSES) + ")"
_STRIP = (
    "regexp_replace({0}, '( (?:" + "|".join(sorted(vocab.REGIONS, key=len, reverse=True))
    + "|[0-9]{3,6}(?:-[0-9]{4})?))+$', '', 'i')"
)


def _clean_sql(source: str, column: str, region: str, out: str) -> str:
    """CTEs that clean ``column`` of ``source`` into table ``out`` (id, clean)."""
    raw = f"regexp_replace(trim(u.part), '\\s+', ' ', 'g')"
    return f"""{out}_p AS (
  SELECT id, u.pos, {_sub(_UNSHOUT, raw)} AS part FROM {source},
    LATERAL (SELECT unnest(string_split({column}, ',')) AS part, generate_subscripts(string_split({column}, ','), 1) AS pos) u
  WHERE trim(u.part) <> ''),
{out}_e AS (
  SELECT id, pos, CASE WHEN {region} <> '' AND length(part) < length({region}) AND starts_with(upper({region}), upper(part))
    THEN {region} ELSE part END AS part FROM {out}_p),
{out}_f AS (SELECT * FROM {out}_e WHERE NOT {_sub(_PLACEHOLDER, 'part')}),
{out}_k AS (
  SELECT * FROM {out}_f a WHERE NOT EXISTS (SELECT 1 FROM {out}_f k WHERE k.id = a.id AND k.pos < a.pos AND (
    lower(k.part) = lower(a.part) OR ((regexp_matches(k.part, '[0-9]') OR k.part <> {_sub(_STRIP, 'k.part')})
      AND regexp_matches(k.part, '(?i)\\b' || regexp_escape(a.part) || '\\b'))))),
{out}_c AS (SELECT id, min(pos) AS cut FROM {out}_k WHERE {_sub(_COUNTRY, 'part')} GROUP BY id),
{out} AS (
  SELECT s.id, coalesce(string_agg(k.part, ', ' ORDER BY k.pos) FILTER (c.cut IS NULL OR k.pos <= c.cut), '') AS clean
  FROM {source} s LEFT JOIN {out}_k k ON k.id = s.id LEFT JOIN {out}_c c ON c.id = s.id GROUP BY s.id)"""


_REGION_COUNT_SQL = f"""tokens AS (SELECT upper(w) AS region FROM listing, unnest(regexp_split_to_array(address, '[,\\s]+')) t(w)
  WHERE length(w) >= 2 AND {_sub(_REGION, 'w')}),
region AS (SELECT coalesce((SELECT region FROM tokens GROUP BY region ORDER BY count(*) DESC, region LIMIT 1), '') AS r)"""


@query("d4_region_counts", f"""
WITH {LISTING_SQL}, {_REGION_COUNT_SQL}
SELECT region, count(*) AS uses, any_value(r) AS default_region FROM tokens, region GROUP BY region""")
def regions(spark, sf):
    rows = b.listings(spark, sf)
    return clean.region_counts(rows).withColumn("default_region", clean.default_region(rows))


@query("h4_clean_addresses", f"""
WITH {LISTING_SQL}, {_REGION_COUNT_SQL}, src AS (SELECT id, address, r FROM listing, region),
src2 AS (SELECT id, address, r FROM src), {_clean_sql('src2', 'address', "'NSW'", 'addr')}
SELECT id, clean AS address FROM addr""")
def clean_addresses(spark, sf):
    return b.listings(spark, sf).select("id", ad.clean_address(F.col("address"), F.lit("NSW")).alias("address"))


@query("b20_repair_rows", f"""
WITH {LISTING_SQL}, {_REGION_COUNT_SQL}, dr AS MATERIALIZED (SELECT r FROM region),
{_clean_sql('listing', 'address', '(SELECT r FROM dr)', 'addr')}, {_clean_sql('listing', 'venue_name', '(SELECT r FROM dr)', 'ven')},
fixed AS (SELECT l.source, l.venue_name, l.address, v.clean AS venue2, CASE WHEN {_sub(_PLACEHOLDER, 'a.clean')} THEN '' ELSE a.clean END AS address2,
  l.description, {_cleaned_sql(_sub(_DECODED, 'l.description'))} AS description2
  FROM listing l JOIN addr a USING (id) JOIN ven v USING (id))
SELECT source, count(*) AS n, count(*) FILTER (venue_name <> venue2 OR address <> address2 OR description <> description2) AS changed,
  count(DISTINCT venue2) AS venues, count(DISTINCT address2) AS addresses FROM fixed GROUP BY source""")
def repair(spark, sf):
    rows = clean.clean_rows(b.listings(spark, sf), description_chars=None)
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("changed"),
        F.count_distinct("venue_name").alias("venues"), F.count_distinct("address").alias("addresses"))


_LOCALITY = """(SELECT CASE WHEN regexp_matches(p, '^[0-9]') OR regexp_matches(p, '(?i)\\b(""" + "|".join(vocab.STREET_WORDS) + """)$') THEN '' ELSE p END
  FROM (SELECT """ + _sub(_STRIP, "trim(part)") + """ AS p, pos FROM (SELECT unnest(string_split({0}, ',')) AS part,
    generate_subscripts(string_split({0}, ','), 1) AS pos)) WHERE p <> '' AND NOT """ + _sub(_REGION, "p") + " AND NOT " + _sub(_COUNTRY, "p") + """
    AND NOT """ + _sub(_POSTCODE, "p") + " ORDER BY pos DESC LIMIT 1)"


@query("h9_localities", f"""
WITH {LISTING_SQL} SELECT id, coalesce({_sub(_LOCALITY, 'address')}, '') AS locality FROM listing""")
def locality(spark, sf):
    return b.listings(spark, sf).select("id", ad.locality_of(F.col("address")).alias("locality"))


_TOWNS = f"""parts AS (
  SELECT trim(part) AS part, row_number() OVER (PARTITION BY id ORDER BY pos) AS n FROM listing,
    LATERAL (SELECT unnest(string_split(address, ',')) AS part, generate_subscripts(string_split(address, ','), 1) AS pos) u WHERE trim(part) <> ''),
towns AS (
SELECT lower(part) AS part, count(*) AS uses FROM parts WHERE n > 1 AND NOT regexp_matches(part, '[0-9]')
  AND len(regexp_split_to_array(part, '\\s+')) <= 3 AND NOT {_sub(_REGION, 'part')} AND NOT {_sub(_COUNTRY, 'part')}
GROUP BY lower(part) HAVING count(*) >= 3)"""


@query("d6_town_components", f"WITH {LISTING_SQL}, {_TOWNS} SELECT * FROM towns")
def towns(spark, sf):
    return venues.late_components(b.listings(spark, sf))


_AREA_NAMES = ["Bathurst", "Orange NSW", "Blue Mountains, Australia"]


@query("d6_locality_words", f"""
WITH {LISTING_SQL}, {_TOWNS}, names AS (SELECT part FROM towns UNION ALL SELECT unnest({_AREA_NAMES!r})),
words AS (SELECT DISTINCT unnest(string_split_regex(trim(regexp_replace(lower(part), '[^a-z\\s]', ' ', 'g')), '\\s+')) AS word FROM names
  WHERE NOT {_sub(_REGION, 'part')} AND NOT {_sub(_COUNTRY, 'part')})
SELECT word FROM words WHERE len(word) > 2 AND NOT {_sub(_REGION, 'word')} AND NOT {_sub(_COUNTRY, 'word')}
  AND NOT list_contains({list(vocab.REGION_NAME_WORDS)!r}, word)""")
def locality_words(spark, sf):
    return venues.localities(_AREA_NAMES, b.listings(spark, sf))


# --- venue spellings ---------------------------------------------------------------------------------

_ADJECTIVES = "(SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part)"
_SPELLINGS = """spellings AS (SELECT p_name AS name, count(*) AS uses FROM part GROUP BY p_name
  UNION ALL SELECT split_part(p_name, ' ', 2), count(*) FROM part WHERE contains(p_name, ' ') GROUP BY 1)"""


def _spellings(spark, sf):
    part = b.table(spark, sf, "part")
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    return part.groupBy(F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("uses")).unionByName(
        part.filter(F.contains("p_name", F.lit(" "))).groupBy(noun.alias("name")).agg(F.count(F.lit(1)).alias("uses")))


def _adjectives(spark, sf):
    return b.table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).distinct()


@query("d5_spelling_counts", f"""
WITH {LISTING_SQL} SELECT venue_name AS name, count(*) AS uses FROM listing WHERE venue_name <> '' GROUP BY venue_name""")
def spelling_counts(spark, sf):
    return venues.spelling_counts(b.listings(spark, sf))


_CANONICAL = f"""{_SPELLINGS}, adj AS {_ADJECTIVES},
words AS (SELECT name, uses, unnest(string_split(name, ' ')) AS word FROM spellings),
cores AS (SELECT name, any_value(uses) AS uses, coalesce(string_agg(word, ' ' ORDER BY word) FILTER (word NOT IN (SELECT word FROM adj)), '') AS core
  FROM words GROUP BY name),
winners AS (SELECT core, arg_min(name, {{'u': -uses, 'l': length(name), 'n': name}}) AS canonical, count(*) AS n FROM cores GROUP BY core HAVING count(*) > 1),
mapping AS (SELECT name, canonical FROM cores JOIN winners USING (core) WHERE name <> canonical)"""


@query("e12_canonical_names", f"WITH {_CANONICAL} SELECT name, canonical FROM mapping")
def canonical(spark, sf):
    return venues.canonical_names(_spellings(spark, sf), _adjectives(spark, sf))


@query("c3_rewritten_venues", f"""
WITH {_CANONICAL} SELECT coalesce(canonical, p_name) AS venue_name, count(*) AS events FROM part LEFT JOIN mapping ON p_name = name GROUP BY ALL""")
def rewritten(spark, sf):
    events = b.table(spark, sf, "part").select(F.col("p_name").alias("venue_name"))
    mapping = venues.canonical_names(_spellings(spark, sf), _adjectives(spark, sf))
    return venues.rewrite_venues(events, mapping).groupBy("venue_name").agg(F.count(F.lit(1)).alias("events"))


# --- classification and score ----------------------------------------------------------------------------

_PHRASES = "phrases AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', '{p}')" for i, (name, terms) in enumerate(vocab.TOPICS) for p in dict.fromkeys(terms)
) + ") t(topic, category, phrase))"
_TEXTS = """texts AS (SELECT 'd' || doc_id AS id, title, text AS body FROM titled
  UNION ALL SELECT 'v' || id, venue_name || ' ' || title, description FROM listing
  UNION ALL SELECT 'p' || page_id, url, html FROM pages)"""


def _hit(hay: str) -> str:
    return f"(contains({hay}, phrase) AND regexp_matches({hay}, '(^|[^a-z0-9])' || phrase || '([^a-z0-9]|$)'))"


_CLASSIFIED = f"""{_PHRASES}, low AS (SELECT id, title, lower(title) AS head, lower(title || ' ' || body) AS hay FROM texts),
points AS (SELECT id, topic, category, sum(CASE WHEN {_hit('head')} THEN 10 WHEN {_hit('hay')} THEN 1 ELSE 0 END) AS score
  FROM low, phrases GROUP BY ALL),
best AS (SELECT id, arg_max(category, score * 100 - topic) AS category FROM points WHERE score > 0 GROUP BY id)"""


def _texts(spark, sf):
    rows = b.listings(spark, sf)
    docs = rows.select(F.concat(F.lit("d"), F.col("id") - 1).alias("id"), "title", F.col("description").alias("body"))
    named = rows.select(F.concat(F.lit("v"), F.col("id")).alias("id"), F.concat_ws(" ", "venue_name", "title").alias("title"), F.col("description").alias("body"))
    pages = b.table(spark, sf, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("id"), F.col("url").alias("title"), F.col("html").alias("body"))
    return docs.unionByName(named).unionByName(pages)


@query("h13_classified", f"""
WITH {LISTING_SQL}, {_TEXTS}, {_CLASSIFIED}
SELECT low.id, coalesce(category, 'Event') AS category FROM low LEFT JOIN best USING (id)""")
def classified(spark, sf):
    return score.with_category(_texts(spark, sf), "title", "body", chars=None).select("id", "category")


@query("h14_reclassified", f"""
WITH {LISTING_SQL}, texts AS (SELECT id, title, description AS body FROM listing), {_CLASSIFIED},
now AS (SELECT l.category AS old, coalesce(b.category, 'Event') AS category FROM listing l LEFT JOIN best b USING (id))
SELECT category, count(*) AS n, count(*) FILTER (old <> category) AS changed FROM now GROUP BY category""")
def reclassified(spark, sf):
    rows = b.listings(spark, sf).withColumn("old", F.col("category"))
    return clean.reclassify(rows, chars=None).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") != F.col("category")).alias("changed"))


_PHOTO = " + ".join(
    f"CASE WHEN regexp_matches(hay, '(?i)\\b(?:{p.replace(chr(39), chr(39) * 2)})\\b') THEN {w} ELSE 0 END" for p, w in vocab.PHOTO_KEYWORDS
)
_PHOTO_CATEGORY = "CASE " + " ".join(f"WHEN contains(lower(category), '{k}') THEN {w}" for k, w in vocab.PHOTO_CATEGORY_SCORES) + " ELSE 0 END"


@query("h15_photo_scores", f"""
WITH {LISTING_SQL}, t AS (SELECT *, title || ' ' || description AS hay FROM listing)
SELECT id, CASE WHEN is_online THEN 0 ELSE greatest(0, least(100, 10 + {_PHOTO} + {_PHOTO_CATEGORY}
  + CASE WHEN image_url <> '' THEN 5 ELSE 0 END)) END::INTEGER AS photo_score FROM t""")
def photo_scores(spark, sf):
    c = F.col
    return b.listings(spark, sf).select("id", score.photo_score(
        c("title"), c("description"), c("category"), c("image_url"), c("is_online"), chars=None).alias("photo_score"))


# --- validation and archive -----------------------------------------------------------------------------

_RAW = """raw AS (SELECT id, source, lat, lng, CASE WHEN id % 13 = 0 THEN 'next Saturday'
  ELSE strftime(start_ts + to_days((id % 5 * 110 - 5)::INTEGER), '%Y-%m-%dT%H:%M:%SZ') END AS start_time,
  CASE WHEN id % 13 <> 0 THEN start_ts + to_days((id % 5 * 110 - 5)::INTEGER) END AS start_ts, end_ts + to_days((id % 5 * 110 - 5)::INTEGER) AS end_ts FROM listing)"""
_KM = "least(" + ", ".join(haversine_sql(f"{a.lat}::DOUBLE", f"{a.lng}::DOUBLE", "lat", "lng") for a in b.AREAS) + ")"
_NEAR = "(" + " OR ".join(
    f"{haversine_sql(f'{a.lat}::DOUBLE', f'{a.lng}::DOUBLE', 'lat', 'lng')} <= {a.radius_km * 1.5}::DOUBLE" for a in b.AREAS) + ")"
_CHECKED = f"""{_RAW}, checked AS (SELECT *,
  CASE WHEN start_ts IS NULL THEN 'no parsable start time'
    WHEN start_ts < {NOW} - INTERVAL 36 HOUR THEN 'start ' || strftime(start_ts, '%Y-%m-%d') || ' is in the past'
    WHEN start_ts > {NOW} + INTERVAL 400 DAY THEN 'start ' || strftime(start_ts, '%Y-%m-%d') || ' is beyond the horizon' ELSE '' END AS date_reason,
  CASE WHEN end_ts > start_ts AND end_ts <= start_ts + INTERVAL 21 DAY THEN end_ts END AS good_end,
  CASE WHEN lat IS NULL OR {_NEAR} THEN '' ELSE floor({_KM} + 0.5)::BIGINT || ' km outside every area' END AS place_reason FROM raw)"""


def _raw(spark, sf):
    shift = F.make_dt_interval(days=(F.col("id") % 5 * 110 - 5).cast("int"))
    stamp = lambda c: F.date_format(F.col(c) + shift, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return b.listings(spark, sf).select(
        "id", "source", "lat", "lng", F.when(F.col("id") % 13 == 0, "next Saturday").otherwise(stamp("start_ts")).alias("start_time"),
        stamp("end_ts").alias("end_time"))


@query("b1_checked_dates", f"""
WITH {LISTING_SQL}, {_CHECKED} SELECT id, date_reason, {time_sql('good_end')} AS end_ts FROM checked""")
def checked_dates(spark, sf):
    return validate.check_dates(_raw(spark, sf), b.listing_as_of()).select("id", "date_reason", time_text(F.col("end_ts")).alias("end_ts"))


@query("b2_checked_places", f"WITH {LISTING_SQL}, {_CHECKED} SELECT id, place_reason FROM checked")
def checked_places(spark, sf):
    return validate.check_location(_raw(spark, sf), b.AREAS).select("id", "place_reason")


@query("c6_areas_within", f"""
WITH {LISTING_SQL}, circles AS (SELECT c_name AS name, -33.46::DOUBLE + (c_custkey * 37 % 900)::DOUBLE / 10000 AS alat,
  149.52::DOUBLE + (c_custkey * 53 % 1200)::DOUBLE / 10000 AS alng, (c_custkey % 10)::DOUBLE / 20 AS radius FROM customer)
SELECT name AS area, count(*) AS listings FROM listing, circles
WHERE lat IS NOT NULL AND {haversine_sql('alat', 'alng', 'lat', 'lng')} <= radius * 1.5::DOUBLE GROUP BY name""")
def areas_within(spark, sf):
    circles = b.table(spark, sf, "customer").selectExpr(
        "c_name AS name", "CAST(-33.46D + (c_custkey * 37 % 900) / 10000D AS DOUBLE) AS lat",
        "CAST(149.52D + (c_custkey * 53 % 1200) / 10000D AS DOUBLE) AS lng", "(c_custkey % 10) / 20D AS radius_km")
    return validate.points_per_area(b.listings(spark, sf), circles, bin_deg=0.01).withColumnRenamed("n", "listings")


@query("d23_dropped_by_reason", f"""
WITH {LISTING_SQL}, {_CHECKED}, r AS (SELECT source, CASE WHEN date_reason <> '' THEN date_reason ELSE place_reason END AS reason FROM checked)
SELECT source, CASE WHEN reason LIKE '%in the past' THEN 'past' WHEN reason LIKE '%beyond the horizon' THEN 'horizon'
  WHEN reason LIKE '%outside every area' THEN 'outside' ELSE 'no start' END AS reason_kind, count(*) AS dropped
FROM r WHERE reason <> '' GROUP BY ALL""")
def dropped(spark, sf):
    return validate.dropped_by_reason(validate.split_valid(_raw(spark, sf), b.listing_as_of(), b.AREAS)[1])


_REPAIRED = """repaired AS (SELECT * REPLACE (CASE WHEN end_ts > start_ts AND end_ts <= start_ts + INTERVAL 21 DAY THEN end_ts END AS end_ts) FROM listing)"""


@query("b3_repaired_dates", f"WITH {LISTING_SQL}, {_REPAIRED} SELECT id, {time_sql('end_ts')} AS end_ts FROM repaired")
def repaired_dates(spark, sf):
    return validate.repair_dates(b.listings(spark, sf)).select("id", time_text(F.col("end_ts")).alias("end_ts"))


@query("b5_archived", f"""
WITH {LISTING_SQL}, {_REPAIRED}
SELECT id, coalesce(end_ts, start_ts) < {NOW} - INTERVAL 24 HOUR AS archived,
  CASE WHEN coalesce(end_ts, start_ts) < {NOW} - INTERVAL 24 HOUR THEN {time_sql(NOW)} END AS archived_at FROM repaired""")
def archived(spark, sf):
    rows = validate.archive_past(validate.repair_dates(b.listings(spark, sf)), b.listing_as_of())
    return rows.select("id", "archived", time_text(F.col("archived_at")).alias("archived_at"))


@query("b6_purged", f"""
WITH {LISTING_SQL}, {_REPAIRED}, a AS (SELECT *, coalesce(end_ts, start_ts) < TIMESTAMP '2026-02-20 00:00:00' - INTERVAL 24 HOUR AS archived FROM repaired)
SELECT starred, archived, count(*) AS kept FROM a
WHERE NOT (archived AND NOT starred AND coalesce(end_ts, start_ts) < TIMESTAMP '2026-02-20 00:00:00' - INTERVAL 730 DAY) GROUP BY ALL""")
def purged(spark, sf):
    later = F.lit("2026-02-20").cast("timestamp")
    rows = validate.archive_past(validate.repair_dates(b.listings(spark, sf)), later)
    return validate.purge_archived(rows, later).groupBy("starred", "archived").agg(F.count(F.lit(1)).alias("kept"))


# --- merges ----------------------------------------------------------------------------------------------


@query("a13_event_upsert", f"""
WITH {LISTING_SQL},
incoming AS (
  SELECT source, source_id, title, 'updated ' || description AS description, start_ts, end_ts, NULL::DOUBLE AS lat, 1 AS seq FROM listing
  UNION ALL SELECT source, source_id, title, 'final ' || description, start_ts, end_ts, -33.4::DOUBLE, 2 FROM listing WHERE starred
  UNION ALL SELECT 'bench', item_id::VARCHAR, text, text, TIMESTAMP '2024-03-01', NULL, NULL, 1 FROM benchmark),
fresh AS (SELECT * FROM incoming QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY seq DESC) = 1),
stored AS (SELECT * FROM listing UNION ALL BY NAME SELECT 1000000 + page_id AS id, 'web' AS source, page_id::VARCHAR AS source_id, url AS title,
  html AS description, TIMESTAMP '2024-03-02' AS start_ts, false AS starred FROM pages),
top AS (SELECT max(id) AS m FROM stored),
unseen AS (SELECT f.source, f.source_id, row_number() OVER (ORDER BY f.seq, f.source, f.source_id) + m AS new_id
  FROM fresh f ANTI JOIN stored s ON s.source = f.source AND s.source_id = f.source_id, top)
SELECT coalesce(s.id, u.new_id)::BIGINT AS id, coalesce(s.source, f.source) AS source, coalesce(s.source_id, f.source_id) AS source_id,
  CASE WHEN f.source IS NULL THEN s.title ELSE f.title END AS title, md5(CASE WHEN f.source IS NULL THEN s.description ELSE f.description END) AS description_md5,
  CASE WHEN f.source IS NULL THEN s.lat ELSE coalesce(f.lat, s.lat) END AS lat, coalesce(s.starred, false) AS starred
FROM stored s FULL JOIN fresh f ON s.source = f.source AND s.source_id = f.source_id
LEFT JOIN unseen u ON u.source = f.source AND u.source_id = f.source_id""")
def upsert(spark, sf):
    rows = b.listings(spark, sf)
    no_time, no_pos = F.lit(None).cast("timestamp"), F.lit(None).cast("double")
    pages = b.table(spark, sf, "pages").select(
        (F.col("page_id") + 1000000).alias("id"), F.lit("web").alias("source"), F.col("page_id").cast("string").alias("source_id"),
        F.col("url").alias("title"), F.col("html").alias("description"), F.lit("2024-03-02").cast("timestamp").alias("start_ts"),
        F.lit(False).alias("starred"))
    stored = rows.unionByName(pages, allowMissingColumns=True)
    resent = rows.withColumns({"description": F.concat(F.lit("updated "), "description"), "lat": no_pos, "seq": F.lit(1)})
    again = rows.filter("starred").withColumns(
        {"description": F.concat(F.lit("final "), "description"), "lat": F.lit(-33.4), "seq": F.lit(2)})
    extra = b.table(spark, sf, "benchmark").select(
        F.lit("bench").alias("source"), F.col("item_id").cast("string").alias("source_id"), F.col("text").alias("title"),
        F.col("text").alias("description"), F.lit("2024-03-01").cast("timestamp").alias("start_ts"), no_time.alias("end_ts"),
        F.lit(1).alias("seq"))
    incoming = resent.unionByName(again).unionByName(extra, allowMissingColumns=True)
    out = merge.upsert_events(stored, incoming, ["seq"], title_chars=None, description_chars=None)
    return out.select("id", "source", "source_id", "title", F.md5("description").alias("description_md5"), "lat", "starred")


@query("a14_venue_upsert", f"""
WITH {b.VENUE_SQL}, fresh AS (SELECT 'area-' || (s_suppkey % 3) AS area, s_suppkey::VARCHAR AS cid, s_name AS name FROM supplier
  UNION ALL SELECT 'area-0', 's' || s_suppkey, s_name FROM supplier)
SELECT coalesce(v.area, f.area) AS area, coalesce(v.cid, f.cid) AS cid, CASE WHEN f.cid IS NULL THEN v.name ELSE f.name END AS name,
  coalesce(v.has_profile, false) AS has_profile FROM venues v FULL JOIN fresh f ON v.area = f.area AND v.cid = f.cid""")
def venue_upsert(spark, sf):
    stored = b.venues(spark, sf)
    out = merge.upsert_venues(stored, _supplier_venues(spark, sf, stored))
    return out.select("area", "cid", "name", F.col("profile").isNotNull().alias("has_profile"))


def _supplier_venues(spark, sf, stored):
    supplier = b.table(spark, sf, "supplier")
    rows = supplier.select(F.concat(F.lit("area-"), F.col("s_suppkey") % 3).alias("area"), F.col("s_suppkey").cast("string").alias("cid"),
                           F.col("s_name").alias("name"))
    more = supplier.select(F.lit("area-0").alias("area"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("cid"), F.col("s_name").alias("name"))
    empty = stored.limit(0).drop("pos", "barren_streak")
    return empty.unionByName(rows.unionByName(more), allowMissingColumns=True)


@query("a15_replaced_venues", f"""
WITH {b.VENUE_SQL}, fresh AS (SELECT 'area-' || (s_suppkey % 3) AS area, s_suppkey::VARCHAR AS cid, s_name AS name FROM supplier
  UNION ALL SELECT 'area-0', 's' || s_suppkey, s_name FROM supplier)
SELECT f.area, f.cid, f.name, coalesce(v.has_profile, false) AS has_profile FROM fresh f LEFT JOIN venues v ON v.area = f.area AND v.cid = f.cid""")
def replaced(spark, sf):
    stored = b.venues(spark, sf)
    out = merge.replace_venues(stored, _supplier_venues(spark, sf, stored))
    return out.select("area", "cid", "name", F.col("profile").isNotNull().alias("has_profile"))


@query("c9_departed_venues", f"""
WITH {b.VENUE_SQL}, fresh AS (SELECT 'area-' || (s_suppkey % 3) AS area, s_suppkey::VARCHAR AS cid FROM supplier)
SELECT v.area, v.cid FROM venues v ANTI JOIN fresh f ON v.area = f.area AND v.cid = f.cid""")
def departed(spark, sf):
    stored = b.venues(spark, sf)
    return merge.departed_venues(stored, _supplier_venues(spark, sf, stored)).select("area", "cid")


# --- groups -----------------------------------------------------------------------------------------------


_DISTANCE = haversine_sql("x.lat", "x.lng", "p.lat", "p.lng")


@query("e16_duplicate_groups", f"""
WITH RECURSIVE {LISTING_SQL},
k AS (SELECT id, lat, lng, {_sub(TITLE_KEY_SQL, 'title')} || '|' || strftime(start_ts, '%Y-%m-%d') AS dkey FROM listing),
points AS (SELECT dkey, lat, lng, min(id) AS id FROM k WHERE lat IS NOT NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY dkey ORDER BY id) AS n FROM points),
walk AS (
  SELECT dkey, n, id AS founder, [{{'lat': lat, 'lng': lng, 'f': id}}] AS members FROM p WHERE n = 1
  UNION ALL
  SELECT dkey, n, founder, list_append(before, {{'lat': lat, 'lng': lng, 'f': founder}}) FROM (
    SELECT p.dkey, p.n, p.lat, p.lng, w.members AS before, coalesce(list_min(list_filter(
      list_distinct(list_transform(w.members, lambda x: x.f)),
      lambda g: len(list_filter(w.members, lambda x: x.f = g AND {_DISTANCE} > 0.3)) = 0)), p.id) AS founder
    FROM walk w JOIN p ON p.dkey = w.dkey AND p.n = w.n + 1)),
clusters AS (SELECT dkey, founder, row_number() OVER (PARTITION BY dkey ORDER BY founder) - 1 AS i FROM (SELECT DISTINCT dkey, founder FROM walk)),
placed AS (SELECT p.dkey, p.lat, p.lng, c.i FROM p JOIN walk w ON w.dkey = p.dkey AND w.n = p.n JOIN clusters c ON c.dkey = p.dkey AND c.founder = w.founder)
SELECT k.id, substr(sha1(k.dkey || '#' || coalesce(placed.i, 0)), 1, 16) AS dedupe_group
FROM k LEFT JOIN placed ON placed.dkey = k.dkey AND placed.lat = k.lat AND placed.lng = k.lng""")
def duplicate_groups(spark, sf):
    return dedupe.assign_groups(b.listings(spark, sf)).select("id", "dedupe_group")


def _first_sql(column: str, present: str) -> str:
    return f"arg_min({column}, {{'s': start_ts, 'i': id}}) FILTER ({present})"


_HEADS = f"""{GROUPED_SQL},
days AS (SELECT group_key, start_ts::DATE AS day, count(*) AS n, min(start_ts) AS first FROM grouped GROUP BY ALL),
agreed AS (SELECT group_key, first AS start_ts FROM days QUALIFY row_number() OVER (PARTITION BY group_key ORDER BY n DESC, day) = 1),
heads0 AS (SELECT group_key, """ + ", ".join(
    f"coalesce({_first_sql(c, c + chr(60) + chr(62) + chr(39) * 2)}, '') AS {c}" for c in
    ("title", "venue_name", "address", "category", "price_text", "url")
) + f""", coalesce({_first_sql('image_url', "image_url <> ''")}, '') AS cover, {_first_sql('end_ts', 'end_ts IS NOT NULL')} AS end_ts,
  {_first_sql('lat', 'lat IS NOT NULL')} AS lat, {_first_sql('lng', 'lng IS NOT NULL')} AS lng,
  coalesce(arg_min(description, {{'n': -length(description), 's': start_ts, 'i': id}}), '') AS description,
  bool_and(is_online) AS is_online, bool_or(starred) AS starred, bool_or(hidden) AS hidden, max(photo_score) AS photo_score,
  arg_min(manual_group <> '', {{'s': start_ts, 'i': id}}) AS manual, count(*) AS member_count,
  string_agg(DISTINCT source, ',' ORDER BY source) AS source_names FROM grouped GROUP BY group_key),
heads1 AS (SELECT *, coalesce({_sub(_LOCALITY, 'address')}, '') AS by_address, coalesce({_sub(_LOCALITY, 'venue_name')}, '') AS by_venue FROM heads0),
heads AS (SELECT heads1.*, agreed.start_ts, CASE WHEN by_address <> '' THEN by_address ELSE by_venue END AS locality FROM heads1 JOIN agreed USING (group_key))"""


def _heads(spark, sf):
    return merged.merged_heads(b.grouped_listings(spark, sf))


@query("d1_merged_events", f"""
WITH {_HEADS}
SELECT group_key, title, md5(description) AS description_md5, {time_sql('start_ts')} AS start_ts, {time_sql('end_ts')} AS end_ts, venue_name,
  address, locality, lat, lng, cover, category, price_text, url, is_online, photo_score, starred, hidden, source_names, manual, member_count FROM heads""")
def merged_events(spark, sf):
    return _heads(spark, sf).withColumns({
        "description_md5": F.md5("description"), "start_ts": time_text(F.col("start_ts")), "end_ts": time_text(F.col("end_ts")),
        "source_names": F.array_join("source_names", ",")}).drop("description")


@query("d2_consensus_start", f"WITH {_HEADS} SELECT group_key, {time_sql('start_ts')} AS start_ts FROM agreed")
def consensus(spark, sf):
    return _heads(spark, sf).select("group_key", time_text(F.col("start_ts")).alias("start_ts"))


@query("d1_members", f"WITH {GROUPED_SQL} SELECT group_key, id, source, url FROM grouped")
def members(spark, sf):
    return merged.merged_members(b.grouped_listings(spark, sf)).select("group_key", "id", "source", "url")


@query("e15_member_positions", f"""
WITH {GROUPED_SQL} SELECT group_key, id, row_number() OVER (PARTITION BY group_key ORDER BY start_ts, id) - 1 AS position FROM grouped""")
def member_positions(spark, sf):
    return merged.member_positions(b.grouped_listings(spark, sf)).select("group_key", "id", "position")


@query("d3_group_images", f"""
WITH {GROUPED_SQL}
SELECT group_key, image_url, arg_min(id, {{'s': start_ts, 'i': id}}) AS first_id FROM grouped WHERE image_url <> '' GROUP BY ALL""")
def images(spark, sf):
    return merged.merged_images(b.grouped_listings(spark, sf)).drop("first_start_ts")


@query("c7_group_rows", f"""
WITH {GROUPED_SQL}, wanted AS (SELECT DISTINCT group_key FROM grouped JOIN labels USING (doc_id) WHERE quality = 1)
SELECT id FROM grouped SEMI JOIN wanted USING (group_key)""")
def group_rows(spark, sf):
    rows = b.grouped_listings(spark, sf)
    good = b.table(spark, sf, "labels").filter("quality = 1").select((F.col("doc_id") + 1).alias("id"))
    return merged.group_rows(rows, rows.join(good, "id")).select("id")


@query("j1_starred_groups", f"""
WITH {GROUPED_SQL}, wanted AS (SELECT DISTINCT group_key FROM grouped JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT id, hidden OR group_key IN (SELECT group_key FROM wanted) AS hidden FROM grouped""")
def starred(spark, sf):
    rows = b.grouped_listings(spark, sf)
    toxic = b.table(spark, sf, "labels").filter("toxic = 1").select((F.col("doc_id") + 1).alias("id"))
    flags = actions.set_flag(rows, rows.join(toxic, "id"), "hidden", True)
    return actions.apply_actions(rows, flags).select("id", "hidden")


_REQUESTS = """requests AS (SELECT DISTINCT doc_id // 4 AS request_id, group_key FROM grouped JOIN labels USING (doc_id)),
behind AS (SELECT DISTINCT request_id, id FROM grouped JOIN requests USING (group_key)),
slices AS (SELECT request_id, id // 65536 AS slice, count(*) AS n, sha1(string_agg(id, ',' ORDER BY id)) AS part FROM behind GROUP BY ALL),
named AS (SELECT request_id, 'm' || substr(sha1(string_agg(part, ',' ORDER BY slice)), 1, 15) AS manual_group FROM slices GROUP BY request_id HAVING sum(n) >= 2)"""


def _requests(spark, sf, rows):
    labelled = b.table(spark, sf, "labels").select((F.col("doc_id") + 1).alias("id"))
    return rows.join(labelled, "id").select(F.floor((F.col("id") - 1) / 4).alias("request_id"), "group_key").distinct()


@query("j2_h36_manual_merges", f"""
WITH {GROUPED_SQL}, {_REQUESTS} SELECT id, arg_max(manual_group, request_id) AS manual_group FROM behind JOIN named USING (request_id) GROUP BY id""")
def manual_merges(spark, sf):
    rows = b.grouped_listings(spark, sf)
    return actions.merge_groups(rows, _requests(spark, sf, rows))


@query("j2_refused_merges", f"""
WITH {GROUPED_SQL}, {_REQUESTS}
SELECT request_id, 'Merging needs at least two distinct events' AS error FROM behind GROUP BY request_id HAVING count(*) < 2""")
def refused(spark, sf):
    rows = b.grouped_listings(spark, sf)
    return actions.refused_merges(rows, _requests(spark, sf, rows))


@query("j2_unmerged", f"""
WITH {GROUPED_SQL} SELECT id, '' AS manual_group FROM grouped WHERE manual_group IN ('m1', 'm3')""")
def unmerged(spark, sf):
    rows = b.grouped_listings(spark, sf)
    chosen = rows.filter(F.col("manual_group").isin("m1", "m3")).select("group_key")
    return actions.unmerge_groups(rows, chosen)


# --- views ------------------------------------------------------------------------------------------------

LOCAL = f"start_ts + INTERVAL {b.TZ_HOURS} HOUR"


@query("b7_b8_b9_filtered", f"""
WITH {_HEADS}
SELECT group_key, 'weekend' AS chip FROM heads WHERE NOT hidden AND NOT is_online
  AND start_ts >= TIMESTAMP '2024-02-16 13:00:00' AND start_ts < TIMESTAMP '2024-02-18 13:00:00'
UNION ALL SELECT group_key, 'month' FROM heads WHERE starred AND NOT hidden AND NOT is_online
  AND start_ts >= TIMESTAMP '2024-02-11 13:00:00' AND start_ts < TIMESTAMP '2024-03-11 13:00:00'
UNION ALL SELECT group_key, 'search' FROM heads WHERE contains(lower(title || ' ' || venue_name || ' ' || description), 'hotel')
  AND contains(',' || source_names || ',', ',src1,')""")
def filtered(spark, sf):
    heads, now = _heads(spark, sf), b.listing_as_of()
    runs = {
        "weekend": views.Filters(chip="weekend"), "month": views.Filters(chip="month", starred_only=True),
        "search": views.Filters(search=" HOTEL", source="src1", hide_online=False, show_hidden=True),
    }
    out = None
    for chip, f in runs.items():
        part = views.apply_filters(heads, f, now, b.TZ).select("group_key", F.lit(chip).alias("chip"))
        out = part if out is None else out.unionByName(part)
    return out


@query("b10_feed_events", f"""
WITH {_HEADS} SELECT group_key FROM heads WHERE NOT hidden AND starred AND start_ts <= {NOW} + INTERVAL 7 DAY""")
def feed(spark, sf):
    return views.feed_events(_heads(spark, sf), b.listing_as_of(), starred_only=True, n_days=7).select("group_key")


@query("f7_b14_shortlist", f"""
WITH {_HEADS}, s AS (SELECT * FROM heads WHERE starred AND NOT hidden AND start_ts >= {NOW} - INTERVAL 1 HOUR)
SELECT group_key, title, (SELECT count(*) FROM s) AS shortlisted, greatest(0, (SELECT count(*) FROM s) - 8) AS overflow
FROM s ORDER BY start_ts, group_key LIMIT 8""")
def shortlist(spark, sf):
    return views.top_shortlist(_heads(spark, sf), b.listing_as_of()).select("group_key", "title", "shortlisted", "overflow")


@query("b15_agenda", f"""
WITH {_HEADS} SELECT strftime({LOCAL}, '%Y-%m-%d') AS day, group_key FROM heads WHERE NOT hidden AND start_ts >= {NOW} - INTERVAL 1 HOUR""")
def agenda(spark, sf):
    rows = calendar.agenda(calendar.visible(_heads(spark, sf)), b.listing_as_of(), b.TZ)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "group_key")


@query("d17_categories", f"WITH {_HEADS} SELECT DISTINCT category FROM heads WHERE category <> '' ORDER BY category")
def categories(spark, sf):
    return views.categories(_heads(spark, sf))


_PLACE = """places AS (SELECT *, CASE WHEN venue_name <> '' AND NOT regexp_matches(trim(split_part(venue_name, ',', 1)), '^[0-9]')
  THEN venue_name WHEN locality <> '' THEN locality ELSE venue_name END AS place FROM heads)"""


@query("d18_h16_events_per_place", f"""
WITH {_HEADS}, {_PLACE} SELECT place, count(*) AS events, {time_sql('min(start_ts)')} AS first_start FROM places GROUP BY place""")
def per_place(spark, sf):
    return views.per_place(_heads(spark, sf)).withColumn("first_start", time_text(F.col("first_start")))


_MONTH = f"""month_days AS (SELECT d::DATE AS day FROM range(DATE '2024-01-28', DATE '2024-03-10', INTERVAL 1 DAY) t(d)),
dated AS (SELECT *, ({LOCAL})::DATE AS day FROM heads WHERE NOT hidden),
firsts AS (SELECT day, string_agg(title, '|' ORDER BY n) AS titles FROM
  (SELECT day, title, row_number() OVER (PARTITION BY day ORDER BY start_ts, group_key) AS n FROM dated) WHERE n <= 3 GROUP BY day),
per_day AS (SELECT day, count(*) AS events FROM dated GROUP BY day)"""


@query("d19_month_grid", f"""
WITH {_HEADS}, {_MONTH}
SELECT strftime(m.day, '%Y-%m-%d') AS day, coalesce(events, 0) AS events, greatest(0, coalesce(events, 0) - 3) AS more, titles
FROM month_days m LEFT JOIN per_day USING (day) LEFT JOIN firsts USING (day)""")
def month_grid(spark, sf):
    rows = calendar.month_grid(calendar.visible(_heads(spark, sf)), date(2024, 2, 12), b.TZ)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "events", "more", F.array_join("titles", "|").alias("titles"))


@query("d19_week_grid", f"""
WITH {_HEADS}, week_days AS (SELECT DATE '2024-02-11' + i::INTEGER AS day FROM range(7) t(i)),
dated AS (SELECT *, CAST(start_ts + INTERVAL {b.TZ_HOURS} HOUR AS DATE) AS day FROM heads WHERE NOT hidden),
per_day AS (SELECT day, count(*) AS events FROM dated GROUP BY day),
firsts AS (SELECT day, string_agg(title, '|' ORDER BY start_ts, group_key) AS titles FROM
  (SELECT * FROM dated QUALIFY row_number() OVER (PARTITION BY day ORDER BY start_ts, group_key) <= 5) GROUP BY day)
SELECT strftime(w.day, '%Y-%m-%d') AS day, coalesce(events, 0) AS events, greatest(0, coalesce(events, 0) - 5) AS more, titles
FROM week_days w LEFT JOIN per_day USING (day) LEFT JOIN firsts USING (day)""")
def week_grid(spark, sf):
    rows = calendar.week_grid(calendar.visible(_heads(spark, sf)), date(2024, 2, 14), b.TZ, shown=5)
    return rows.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "events", "more", F.array_join("titles", "|").alias("titles"))


@query("d19_orders_per_day", """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, count(*) AS events FROM orders GROUP BY ALL""")
def orders_per_day(spark, sf):
    rows = b.table(spark, sf, "orders").select(F.col("o_orderdate").alias("start_ts"))
    return calendar.per_day(rows, "UTC").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_DISTANCE = haversine_sql(f"{b.HOME[0]}::DOUBLE", f"{b.HOME[1]}::DOUBLE", "lat", "lng")


@query("f1_f2_f3_f4_orderings", f"""
WITH {_HEADS}, {_PLACE}
SELECT 'photo' AS sort, group_key, row_number() OVER (ORDER BY photo_score DESC, start_ts, group_key) - 1 AS position FROM heads
UNION ALL SELECT 'distance', group_key, row_number() OVER (ORDER BY round({_DISTANCE}, 6) NULLS LAST, group_key) - 1 FROM heads
UNION ALL SELECT 'place', group_key, row_number() OVER (ORDER BY place = '', lower(strip_accents(place)), start_ts, group_key) - 1 FROM places
UNION ALL SELECT 'date', group_key, row_number() OVER (ORDER BY start_ts DESC, group_key) - 1 FROM heads""")
def orderings(spark, sf):
    heads = checkpointed(_heads(spark, sf).select("group_key", "photo_score", "start_ts", "venue_name", "locality", "lat", "lng"))
    sorts = {"photo": views.by_photo_score(heads), "distance": views.by_distance(heads, *b.HOME), "place": views.by_place(heads),
             "date": views.by_date(heads, newest_first=True)}
    parts = [sorted_positions(x.select("group_key")).select(F.lit(k).alias("sort"), "group_key", "position") for k, x in sorts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("c5_events_at_venues", f"""
WITH {_HEADS}, {b.VENUE_SQL}
SELECT v.cid, count(*) AS events FROM heads h JOIN venues v ON NOT h.hidden AND (
  (h.venue_name <> '' AND lower(h.venue_name) = lower(v.name)) OR (abs(h.lat - v.lat) < 0.0012::DOUBLE AND abs(h.lng - v.lon) < 0.0012::DOUBLE))
GROUP BY v.cid""")
def at_venues(spark, sf):
    return views.events_per_venue(_heads(spark, sf), b.venues(spark, sf))


@query("h34_links", f"""
WITH {_HEADS}, told AS (SELECT group_key, regexp_replace(u, '[.,;:!?)\\]]+$', '') AS url FROM heads,
  unnest(regexp_extract_all(description, 'https?://[^\\s"''<>)\\]]+')) t(u)),
both_ AS (SELECT group_key, url, true AS s FROM grouped WHERE url <> '' UNION ALL SELECT group_key, url, false FROM told)
SELECT group_key, url, bool_or(s) AS from_source FROM both_ GROUP BY ALL""")
def links(spark, sf):
    rows = b.grouped_listings(spark, sf)
    return views.event_links(merged.merged_heads(rows), merged.merged_members(rows)).select("group_key", "url", "from_source")


# --- placement ------------------------------------------------------------------------------------------------

_CANDIDATES = """asked AS (SELECT DISTINCT venue_name, address FROM listing WHERE lat IS NULL AND (venue_name <> '' OR address <> '')),
spots AS (SELECT venue_name, address,
  CASE WHEN address = '' THEN [] WHEN contains(lower(address), 'kelso') OR contains(lower(address), 'orange') THEN [address]
    ELSE [address || ', Kelso', address || ', Orange'] END
  || CASE WHEN venue_name = '' THEN [] WHEN contains(lower(venue_name), 'kelso') OR contains(lower(venue_name), 'orange') THEN [venue_name]
    ELSE [venue_name || ', Kelso', venue_name || ', Orange'] END
  || CASE WHEN venue_name <> '' AND address <> '' THEN [venue_name || ', ' || address] ELSE [] END
  || CASE WHEN contains(venue_name, ',') THEN [split_part(venue_name, ',', 1)] ELSE [] END AS qs FROM asked),
numbered AS (SELECT venue_name, address, lower(q) AS query, n FROM spots, LATERAL (SELECT unnest(qs) AS q, generate_subscripts(qs, 1) AS n) u
  QUALIFY row_number() OVER (PARTITION BY venue_name, address, q ORDER BY n) = 1),
queries AS (SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY venue_name, address ORDER BY n) <= 4),
gazetteer AS (SELECT lower(address) AS query, min(doc_id) AS k FROM listing WHERE address <> '' GROUP BY 1),
answers AS (SELECT query, CASE WHEN k % 2 = 0 THEN NULL ELSE -33.41::DOUBLE + (k % 7)::DOUBLE / 1000 END AS hit_lat FROM gazetteer),
hits AS (SELECT venue_name, address, min(hit_lat) FILTER (hit_lat IS NOT NULL) AS lat, count(*) FILTER (a.query IS NULL) AS unknown
  FROM (SELECT * FROM queries q LEFT JOIN answers a ON a.query = q.query QUALIFY true) a GROUP BY ALL)"""


@query("c4_e14_placed_events", """
WITH """ + LISTING_SQL + ", " + _CANDIDATES.replace(
    "SELECT * FROM queries q LEFT JOIN answers a ON a.query = q.query QUALIFY true",
    "SELECT q.venue_name, q.address, q.n, a.query, a.hit_lat FROM queries q LEFT JOIN answers a ON a.query = q.query",
).replace("min(hit_lat) FILTER (hit_lat IS NOT NULL) AS lat", "arg_min(hit_lat, n) FILTER (hit_lat IS NOT NULL) AS lat") + """
SELECT l.id, round(h.lat, 6) AS lat, h.lat IS NULL AND coalesce(h.unknown, 0) > 0 AS pending
FROM listing l LEFT JOIN hits h ON h.venue_name = l.venue_name AND h.address = l.address
WHERE l.lat IS NULL AND (l.venue_name <> '' OR l.address <> '')""")
def placed(spark, sf):
    rows = b.listings(spark, sf)
    k = F.col("k")
    hit = lambda lat, lng: F.struct(F.lit("x").alias("display_name"), lat.alias("lat"), lng.alias("lng"))
    away = hit(F.lit(51.5), F.lit(-0.1))
    inside = hit(F.lit(-33.41) + (k % 7) / 1000.0, F.lit(149.57))
    gazetteer = rows.filter(F.col("address") != "").groupBy(F.lower("address").alias("query")).agg(F.min(F.col("id") - 1).alias("k"))
    gazetteer = gazetteer.select("query", F.when(k % 2 == 0, F.array(away)).otherwise(F.array(away, inside)).alias("hits"))
    out = place.place_events(place.placement_backlog(rows), gazetteer, b.AREAS)
    return out.select("id", F.round("lat", 6).alias("lat"), "pending")


@query("f11_placement_backlog", f"""
WITH {LISTING_SQL} SELECT id FROM listing WHERE lat IS NULL AND (venue_name <> '' OR address <> '') ORDER BY start_ts, id LIMIT 60""")
def backlog(spark, sf):
    return place.placement_backlog(b.listings(spark, sf), 60).select("id")
