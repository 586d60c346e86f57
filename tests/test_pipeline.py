"""Streaming equals batch, tables survive versions, and the whole listing pipeline runs."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vantage.operators import event_store, merge, readings as rd, validate, venue_life
from vantage.plans import bindings as b
from vantage.plans.curate import refresh
from vantage.sinks import geojson, ics
from vantage.sources import calendar_feed, observations as ob, places, structured, ticketing
from vantage.streaming import jobs

SF = "/root/testdata/sf0.001"
READING = "obs_id bigint, area string, name string, ts timestamp, live int, typical int, weight double"


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Readings split into one file per day, in time order."""
    root = tmp_path_factory.mktemp("landing")
    rows = rd.busyness(ob.parse_meta(b.observations(spark, SF)))
    rows.withColumn("day", F.to_date("ts")).repartition("day").sortWithinPartitions("ts").write.partitionBy("day").parquet(f"{root}/readings")
    return root, rows


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def memory(spark, df, name, mode, checkpoint):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    drain(query)
    return spark.table(name)


def test_latest_per_venue(spark, landed, tmp_path):
    root, rows = landed
    stream = jobs.read_landing(spark, f"{root}/readings", READING, files_per_batch=10)
    out = memory(spark, jobs.latest_per_venue(stream), "latest", "complete", f"{tmp_path}/c")
    batch = rd.latest_readings(rows)
    assert {tuple(r) for r in out.select("area", "name", "ts", "live", "typical").collect()} == {
        tuple(r) for r in batch.select("area", "name", "ts", "live", "typical").collect()}


def test_hourly_sums_fold_to_pattern(spark, landed, tmp_path):
    root, rows = landed
    stream = jobs.read_landing(spark, f"{root}/readings", READING)
    quarters = memory(spark, jobs.quarter_sums(stream), "quarters", "complete", f"{tmp_path}/c").cache()
    for tz in (b.TZ, "Australia/Adelaide", "Asia/Kathmandu"):
        assert {tuple(r) for r in jobs.fold_hours(quarters, tz).collect()} == {tuple(r) for r in rd.hourly_pattern(rows, tz).collect()}


def test_append_and_scan(spark, landed, tmp_path):
    root, rows = landed
    stream = jobs.read_landing(spark, f"{root}/readings", READING, files_per_batch=7)
    drain(jobs.append_observations(stream, f"{tmp_path}/t", f"{tmp_path}/c"))
    table = spark.read.parquet(f"{tmp_path}/t")
    assert table.count() == rows.count()
    since = F.lit("2024-01-20").cast("timestamp")
    part = ob.scan_observations(table, area="area-1", since=since)
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(area" in plan and "obs_date" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert part.count() == rows.filter((F.col("area") == "area-1") & (F.col("ts") >= since)).count()


def test_appended_passes_read_back(spark, tmp_path):
    """Two passes of one table, appended apart, are the table again, whatever their areas are called."""
    rows = b.observations(spark, SF).withColumn("area", F.when(F.col("obs_id") % 5 == 0, "007").otherwise(F.col("area")))
    for k in range(2):
        half = rows.filter(F.col("obs_id") % 2 == k)
        run = half.groupBy("area").agg(F.lit(k).alias("run_id"), F.max("ts").alias("ts"), F.lit("s").alias("summary"))
        ob.append_pass(half, run, f"{tmp_path}/history")
    back = ob.read_observations(spark, f"{tmp_path}/history")
    assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
    assert dict(back.dtypes)["area"] == "string" and {r.obs_date == r.ts.date() for r in back.collect()} == {True}
    runs = spark.read.parquet(f"{tmp_path}/history/density_run")
    assert {r.run_id for r in ob.last_run(runs).collect()} <= {0, 1} and runs.count() == 2 * rows.select("area").distinct().count()


def test_unique_sightings(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(f"p{i // 10}", "jam", f"k{i % 4}", t + timedelta(minutes=i)) for i in range(40)], "pass_id string, kind string, key string, ts timestamp")
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.read_landing(spark, f"{tmp_path}/in", "pass_id string, kind string, key string, ts timestamp")
    out = memory(spark, jobs.unique_sightings(stream, ["pass_id", "kind", "key"]), "sightings", "append", f"{tmp_path}/c")
    assert out.count() == 16


def streaks(spark, path, lateness):
    schema = "area string, cid string, ts timestamp, check_id bigint, saw_panel boolean"
    stream = jobs.read_landing(spark, f"{path}/in", schema, files_per_batch=1)
    seen = {}

    def keep(batch, _epoch):
        seen.update({(r.area, r.cid): r.barren_streak for r in batch.collect()})

    drain(jobs.barren_streaks(stream, lateness).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start())
    return seen


def test_barren_streaks(spark, tmp_path):
    checks = b.table(spark, SF, "events").select(
        F.concat(F.lit("area-"), F.col("user_id") % 3).alias("area"), F.col("user_id").cast("string").alias("cid"),
        F.timestamp_seconds(F.col("event_id") * 60).alias("ts"), F.col("event_id").alias("check_id"), (F.col("event_type") == "purchase").alias("saw_panel"))
    for part in (2, 0, 3, 1, 2):  # out of order, and one part twice
        checks.filter(F.floor(F.col("check_id") / 250) == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert streaks(spark, tmp_path, "2 days") == {(r.area, r.cid): r.barren_streak for r in venue_life.barren_streaks(checks).collect()}


def test_barren_streak_state_is_bounded_by_lateness(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("a", "v", t + timedelta(hours=i), i, False) for i in range(300)] + [("a", "w", t + timedelta(hours=i), i, i == 120) for i in range(300)]
    schema = "area string, cid string, ts timestamp, check_id bigint, saw_panel boolean"
    for lo in range(0, 300, 50):
        # Each part has the last rows of the one before again, in falling order.
        part = sorted((r for r in rows if lo - 5 <= r[3] < lo + 50), key=lambda r: -r[3])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([("a", "v", t, 0, True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # too late to count
    assert streaks(spark, tmp_path, "12 hours") == {("a", "v"): 300, ("a", "w"): 179}
    kept = spark.read.format("statestore").option("stateVarName", "open").load(f"{tmp_path}/c").groupBy("key").count().collect()
    assert len(kept) == 2 and max(r["count"] for r in kept) <= 50 + 13


def event_rows(spark, keys, seq, title):
    row = {c: None for c in merge.CONTENT}
    rows = [tuple({**row, "title": f"{title} {k}", "last_seen_at": datetime(2024, 1, seq)}[c] for c in merge.CONTENT) for k in keys]
    types = {"start_ts": "timestamp", "end_ts": "timestamp", "last_seen_at": "timestamp", "lat": "double", "lng": "double", "is_online": "boolean", "photo_score": "int"}
    return spark.createDataFrame([("s", str(k), *r, seq) for k, r in zip(keys, rows)], "source string, source_id string, " + ", ".join(f"{c} {types.get(c, 'string')}" for c in merge.CONTENT) + ", seq int")


def data_files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.glob("bucket=*/*.parquet")}


def test_bucketed_upsert_touches_few_buckets(spark, tmp_path):
    table = tmp_path / "events"
    first = event_rows(spark, range(2000), 1, "old")
    assert len(event_store.upsert_batch(first, 0, str(table), ["seq"], 64)) == 64
    read = lambda: {(r.source_id, r.id, r.title) for r in event_store.read_events(spark, str(table), event_store.stored_schema(first)).collect()}
    before, files = read(), data_files(table)
    stored = event_store._folder(spark, str(table), event_store.stored_schema(first), "bucket")
    old = spark.createDataFrame(stored.collect(), stored.schema)
    assert sorted(i for _, i, _ in before) == list(range(1, 2001))
    batch = event_rows(spark, [*range(5), *range(5000, 5005)], 2, "new")
    touched = event_store.upsert_batch(batch, 1, str(table), ["seq"], 64)
    after, written = read(), data_files(table)
    changed = {name.split("/")[0] for name, _ in set(files.items()) ^ set(written.items())}
    assert len(touched) <= 10 and changed == {f"bucket={x}" for x in touched}
    ids = {s: i for s, i, _ in before}
    assert after == {(s, i, f"new {s}" if int(s) < 5 else t) for s, i, t in before} | {(str(k), 2001 + n, f"new {k}") for n, k in enumerate(range(5000, 5005))}
    # The same batch again; then as if it had been cut short after the journal, with three buckets still to do.
    event_store.upsert_batch(batch, 1, str(table), ["seq"], 64)
    assert read() == after
    event_store._replace(old.filter(F.col("bucket").isin(touched[:3])), str(table), "bucket")
    assert read() != after
    event_store.upsert_batch(batch, 1, str(table), ["seq"], 64)
    assert read() == after
    more = event_rows(spark, [7000, 3], 3, "third")
    event_store.upsert_batch(more, 2, str(table), ["seq"], 64)
    now = {s: (i, t) for s, i, t in read()}
    assert now["7000"] == (2006, "third 7000") and now["3"] == (ids["3"], "third 3") and len(now) == 2006
    assert event_store.upsert_batch(more.limit(0), 3, str(table), ["seq"], 64) == [] and len(read()) == 2006


def test_stream_upsert(spark, tmp_path):
    rows = b.listings(spark, SF).select(*merge.EVENT_KEY, *merge.CONTENT).withColumn("seq", F.lit(1))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    schema = rows.schema.simpleString()[7:-1].replace(":", " ")
    for _ in range(2):
        rows.withColumns({"title": F.concat(F.lit("new "), "title"), "seq": F.lit(2)}).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_landing(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    drain(jobs.upsert_stream(stream, f"{tmp_path}/events", f"{tmp_path}/c", ["seq"], buckets=8))
    table = event_store.read_events(spark, f"{tmp_path}/events", event_store.stored_schema(rows))
    n = rows.count()
    assert table.count() == n and table.filter(F.startswith("title", F.lit("new "))).count() == n
    assert table.agg(F.count_distinct("id"), F.min("id"), F.max("id")).first()[:] == (n, 1, n)


def test_stream_validation(spark, tmp_path):
    rows = b.listings(spark, SF)
    raw = rows.select("source", "source_id", "title", "lat", "lng", F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_time"), F.lit("x").alias("end_time"))
    raw.write.parquet(f"{tmp_path}/raw")
    stream = jobs.read_landing(spark, f"{tmp_path}/raw", raw.schema.simpleString()[7:-1].replace(":", " "))
    drain(jobs.validate_stream(stream, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/c2", b.AREAS, as_of=b.listing_as_of()))
    good, bad = validate.split_valid(raw, b.listing_as_of(), b.AREAS)
    assert spark.read.parquet(f"{tmp_path}/ok").count() == good.count() and spark.read.parquet(f"{tmp_path}/bad").count() == bad.count()


def test_late_listings_reach_the_rejects_through_the_watermark(spark, tmp_path):
    """Listings start a little before or after they are fetched; files land out of order. A loop keeps the same clock."""
    t, area = datetime(2024, 3, 1), b.AREAS[0]
    parts = [[(f"s{i % 3}", f"{n}-{i}", t + timedelta(hours=seen), t + timedelta(hours=seen + 7 * i - 90)) for i in range(30)] for n, seen in enumerate((0, 60, 20, 200, 190))]
    schema = "source string, source_id string, title string, lat double, lng double, start_time string, end_time string, fetched_at timestamp"
    want, clock = {}, datetime.min
    for part in parts:
        rows = [(s, i, "t", area.lat, area.lng, start.strftime("%Y-%m-%dT%H:%M:%SZ"), "", seen) for s, i, seen, start in part]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        clock = max([clock, *(seen for _, _, seen, _ in part)])
        for s, i, _, start in part:
            want[i] = start < clock - timedelta(hours=36)
    stream = jobs.read_landing(spark, f"{tmp_path}/in", schema, files_per_batch=1)
    for _ in range(2):  # a second run finds nothing new
        drain(jobs.validate_stream(stream, f"{tmp_path}/ok", f"{tmp_path}/bad", f"{tmp_path}/c", b.AREAS, event_time="fetched_at"))
    good, bad = spark.read.parquet(f"{tmp_path}/ok"), spark.read.parquet(f"{tmp_path}/bad")
    assert {r.source_id for r in bad.collect()} == {i for i, late in want.items() if late}
    assert good.count() + bad.count() == len(want)
    counts = {r.source: r.dropped for r in validate.dropped_by_reason(bad).filter("reason_kind = 'past'").collect()}
    assert counts == {s: sum(want[i] for part in parts for x, i, *_ in part if x == s) for s in ("s0", "s1", "s2")}


def test_snapshot_keeps_newest_pass(spark, tmp_path):
    t = datetime(2024, 1, 1)
    for hour, areas in ((1, "ab"), (3, "a"), (2, "ab")):
        spark.createDataFrame([(a, t + timedelta(hours=hour), hour * 10 + i) for a in areas for i in range(3)], "area string, ts timestamp, obs_id bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.read_landing(spark, f"{tmp_path}/in", "area string, ts timestamp, obs_id bigint", files_per_batch=1)
    drain(jobs.snapshot_stream(stream, f"{tmp_path}/snap", f"{tmp_path}/c"))
    rows = {(r.area, r.ts.hour) for r in merge.read_current(spark, f"{tmp_path}/snap").collect()}
    assert rows == {("a", 3), ("b", 2)} and merge.read_current(spark, f"{tmp_path}/snap").count() == 6


def test_structured_events_nested_and_malformed(spark):
    deep = {"@type": "Event", "name": "Deep", "startDate": "2026-01-01", "url": "u-deep"}
    for _ in range(3):
        deep = {"item": [deep]}
    too_deep = {"@graph": [deep]}
    block = lambda x: f'<script type="application/ld+json">{x if isinstance(x, str) else json.dumps(x)}</script>'
    html = block("{oops") + block(json.dumps(deep) + " ; ") + block(too_deep) + block([
        {"@type": "https://schema.org/MusicEvent", "name": {"name": "Obj"}, "startDate": "2026-02-02T10:00:00+10:00", "location": "Park", "offers": {"price": 12.5}},
        {"@type": "Event", "name": "No date"}, {"@type": "Event", "name": 5, "startDate": "2026-01-01"}])
    rows = {r.title: r for r in structured.page_events(spark.createDataFrame([("http://p", html)], "page_url string, html string")).collect()}
    # Depth six is the last one read: the list inside the third item is at depth six, its event at seven inside @graph.
    assert set(rows) == {"Deep", "Obj"}
    obj = rows["Obj"]
    assert (obj.source_id, obj.start_time, obj.venue_name, obj.price_text, obj.category) == ("http://p", "2026-02-02T00:00:00.000Z", "Park", "from 12.5", "https://schema.org/Music")


def test_structured_lists_of_any_depth(spark):
    def inside(x, depth):
        for _ in range(depth):
            x = [x]
        return x

    event = lambda **more: {"@type": "Event", "startDate": "2026-03-01", **more}
    nodes = [
        event(name=inside("Nine", 9), url=[[], [["", {"@id": ""}], [{"@id": "u1"}]]], location=inside({"name": "Hall"}, 7)),
        event(name="no second listing of an id", url="u1"),
        event(**{"@type": inside("Festival", 5)}, name=["", ["", ["Wide"]], "Later"], url="u2", location=[[], "Not this"]),
        event(name=inside([], 6), url="u3"), event(name=[None, 4, [True, []]], url="u4"),
        event(name='Quoted [[["', url='u5 ["[', image=[['["', "x"]]),
        event(name="not a time", startDate="soon", url="u6"), event(name="a time", url="u6"),
        event(name=[[f"n{i}"] for i in range(3000)], url="u7"),
    ]
    block = lambda x: f'<script type="application/ld+json">{json.dumps(x)}</script>'
    pages = [("http://a", block(nodes[:4]) + block(nodes[4:])), ("http://b", block([event(name="B", url="u1")])), ("http://c", None), ("http://d", "")]
    rows = structured.page_events(spark.createDataFrame(pages, "page_url string, html string")).collect()
    assert {(r.page_url, r.source_id, r.title, r.venue_name, r.image_url) for r in rows} == {
        ("http://a", "u1", "Nine", "Hall", ""), ("http://a", "u2", "Wide", "", ""), ("http://a", "u5 [\"[", 'Quoted [[["', "", '["'),
        ("http://a", "u6", "a time", "", ""), ("http://a", "u7", "n0", "", ""), ("http://b", "u1", "B", "", "")}


def test_structured_pages_need_no_shuffle(spark):
    plan = structured.page_events(spark.createDataFrame([("u", "h")], "page_url string, html string"))._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan.split("== Physical Plan ==")[1]


def test_structured_blocks_of_odd_spelling(spark):
    event = '{"@type": "%s", "name": "%s", "startDate": "2026-03-01", "url": "%s"}'
    block = lambda x: f'<script type="application/ld+json">{x}</script>'
    html = "".join(map(block, [
        "\u00a0\ufeff" + event % ("Event", "Spaced", "u1") + " ;\u2003\n", event % (r"\u0045vent", "Escaped", "u2"), event % ("Festival", "Fest", "u3") + ";;",
        event % ("WebPage", "No event", "u4"), event % ("NoEvent", "Unknown type", "u5"), '"Event"', '["Event", 3, null, {"@type": null}]', "", ";",
        '{"subEvent": null, "item": [[%s], {"@graph": %s}]}' % (event % ("Event", "In lists", "u6"), event % ("Event", "In graph", "u7"))]))
    rows = structured.page_events(spark.createDataFrame([("http://a", html)], "page_url string, html string")).collect()
    assert [(r.source_id, r.title) for r in rows] == [("u1", "Spaced"), ("u2", "Escaped"), ("u3", "Fest"), ("u6", "In lists"), ("u7", "In graph")]


def test_structured_nodes_are_read_once(spark):
    """A node is opened by one read of its items and one of its fields, not by a read of each field it may have."""
    plan = structured.structured_nodes(spark.createDataFrame([("u", "h")], "page_url string, html string"))._jdf.queryExecution().optimizedPlan().toString()
    walk = plan.split("inline(")[1].split("Project", 1)[1]
    assert walk.count("try_variant_get(") <= 2 * (structured.MAX_DEPTH + 1)


def test_ticket_pages_from_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_embedded": {"events": [{"id": "1", "name": "N", "dates": {"start": {"localDate": "2026-01-02"}}}, {"id": "2", "name": "M"}]}}))
    (row,) = ticketing.ticketmaster_events(ticketing.read_pages(spark, str(tmp_path), ticketing.TICKETMASTER_SCHEMA.replace("\n", " "))).collect()
    assert (row.source_id, row.start_time, row.venue_name, row.price_text, row.address) == ("1", "2026-01-02T12:00:00", "", "", "")


def test_calendar_feed_files(spark, tmp_path):
    (tmp_path / "f.ics").write_bytes("BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nDTSTART;TZID=Australia/Sydney:20260115T100000\r\nSUMMARY:A\\, b\\nc\r\n d\r\nEND:VEVENT\r\nEND:VCALENDAR\r\n".encode())
    feeds = calendar_feed.read_feeds(spark, str(tmp_path)).withColumn("feed_name", F.lit("F"))
    (row,) = calendar_feed.calendar_events(feeds, F.lit("2026-01-01").cast("timestamp")).collect()
    assert (row.title, row.start_time, row.venue_name) == ("A, b\ncd", "2026-01-14T23:00:00.000Z", "F")


def test_discovered_venues(spark):
    link = "https://www.google.com/maps/place/Mount+Panorama/data=!1s0xa1:0xb2!3d{}!4d149.55!16s%2Fm%2F0abc?x"
    rows = [("a", "pub", 0, 1, link.format("-33.44")), ("a", "cafe", 1, 0, link.format("-33.44")), ("a", "cafe", 1, 1, link.format("-30.0").replace("0xb2", "0xb3")), ("a", "cafe", 1, 2, "https://x")]
    boxes = spark.createDataFrame([("a", (-33.46, 149.52, -33.37, 149.64))], "slug string, bbox struct<south:double,west:double,north:double,east:double>")
    (row,) = places.discovered_venues(spark.createDataFrame(rows, "area string, term string, term_pos int, link_pos int, href string"), boxes).collect()
    assert (row.name, row.cid, row.term, row.kgmid) == ("Mount Panorama", "0xa1:0xb2", "pub", "/m/0abc")


def test_calendar_feed_durations_repeats_and_horizon(spark):
    event = lambda uid, start, rest: f"BEGIN:VEVENT\r\nUID:{uid}\r\nDTSTART:{start}\r\n{rest}\r\nEND:VEVENT\r\n"
    text = "BEGIN:VCALENDAR\r\n" + event("a", "20260901T100000Z", "SUMMARY:first") + event("b", "20260901T100000Z", "DURATION:P1DT2H30M") + event(
        "a", "20260902T100000Z", "SUMMARY:last\r\nDURATION:PT90S") + event("c", "20270302T110000Z", "DTEND:20270302T120000Z") + event("d", "20270304T000000Z", "X:1")
    feeds = spark.createDataFrame([("u", "F", text)], "feed_url string, feed_name string, text string")
    rows = {r.source_id[9:]: r for r in calendar_feed.calendar_events(feeds, F.lit("2026-08-31 12:00:00").cast("timestamp")).collect()}
    assert {k: r.end_time for k, r in rows.items()} == {
        "a": "2026-09-02T10:01:30.000Z", "b": "2026-09-02T12:30:00.000Z", "c": "2027-03-02T12:00:00.000Z"}
    assert rows["a"].title == "last"


def test_calendar_text(spark, tmp_path):
    t = datetime(2026, 8, 22)
    rows = [("g1", "é" * 90, "A cruise; with punctuation, and\na newline." + "x" * 600, t, None, "Mount Panorama", "Bathurst, NSW", "", -33.4, 149.5, "https://e.org/1"),
            ("g2", "B", "", t, t + timedelta(hours=1), "", "", "", None, None, "")]
    df = spark.createDataFrame(rows, "group_key string, title string, description string, start_ts timestamp, end_ts timestamp, venue_name string, address string, category string, lat double, lng double, url string")
    def texts(entries):
        files = {}
        for r in sorted(ics.calendar_lines(ics.calendar_rows(entries, "category", title="Cal — é"), "category").collect(), key=lambda r: (r.month, r.position)):
            assert r.position == files.setdefault(r.month, []).__len__() and r.part == (0 if not r.position else 2 if r.text.startswith("END:VCAL") else 1)
            files[r.month].append(r.text)
        return {month: "".join(x) for month, x in files.items()}

    (text,) = texts(ics.entry(df, F.lit(t))).values()
    assert text.endswith("END:VCALENDAR\r\n") and "\n" not in text.replace("\r\n", "") and "METHOD" not in text
    assert all(len(line.encode()) <= 75 for line in text.split("\r\n")) and "�" not in text
    flat = text.replace("\r\n ", "")
    assert "SUMMARY:" + "é" * 90 in flat and "A cruise\\; with punctuation\\, and\\na newline." in flat and "DTEND:20260822T020000Z" in flat
    assert "X-WR-CALNAME:Cal — é\r\n" in flat and "\r\nNAME:Cal — é\r\n" in flat
    later = ics.entry(df.unionByName(df.withColumns({"start_ts": F.lit(datetime(2026, 9, 1)), "group_key": F.concat("group_key", F.lit("x"))})), F.lit(t))
    split = texts(later)
    assert sorted(split) == ["2026-08", "2026-09"] and split["2026-08"] == text
    ics.write_calendars(ics.calendar_rows(later, "category", title="Cal — é"), "category", f"{tmp_path}/cal")
    written = {p.name: b"".join(x.read_bytes() for x in sorted(p.glob("*.txt"))) for p in (tmp_path / "cal").glob("*/*")}
    assert written == {f"month={m}": x.encode() for m, x in split.items()}
    # A month with many events is written by several tasks, evenly, and reads as before.
    many = spark.range(4000).select(F.col("id").cast("string").alias("group_key"), F.concat(F.lit("event "), F.col("id") * 7 % 4000).alias("title"), F.timestamp_seconds(F.lit(1_787_000_000) + F.col("id") * 31 % 4000).alias("start_ts"))
    busy = ics.entry(many.withColumns({c: F.lit("x") for c in ("description", "venue_name", "address", "category", "url")}).withColumns({"end_ts": F.lit(None).cast("timestamp"), "lat": F.lit(1.5), "lng": F.lit(2.5)}), F.lit(t))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # this little text would be one partition
    try:
        ics.write_calendars(ics.calendar_rows(busy, "category"), "category", f"{tmp_path}/busy")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "busy/category=x/month=2026-08").glob("*.txt"))
    sizes = [p.stat().st_size for p in parts]
    assert len(parts) > 1 and max(sizes) < 0.6 * sum(sizes)
    whole = b"".join(p.read_bytes() for p in parts).decode()
    starts = [line for line in whole.split("\r\n") if line.startswith("DTSTART")]
    assert starts == sorted(starts) and len(starts) == 4000 and whole.startswith("BEGIN:VCALENDAR") and whole.endswith("END:VCALENDAR\r\n")
    geojson.write_features(spark.createDataFrame([("a", 0.5, "{}")], "area string, score double, feature string"),
                           spark.createDataFrame([("a", "x")], "area string, label string"), f"{tmp_path}/geo")
    assert spark.read.text(f"{tmp_path}/geo/features").first().value == "{}"


def test_refresh_pipeline(spark):
    rows = b.listings(spark, SF)
    raw = rows.select("source", "source_id", "title", "description", F.date_format("start_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_time"),
                      F.date_format("end_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("end_time"), "venue_name", "address", "lat", "lng", "url", "image_url", "category", "price_text", "is_online", F.lit(1).alias("seq"))
    gazetteer = spark.createDataFrame([(q, [("x", -33.42, 149.57)]) for q in ("royal hotel kelso", "royal hotel, kelso", "the royal hotel, kelso")], "query string, hits array<struct<display_name:string,lat:double,lng:double>>")
    events, rejected = refresh(raw, rows.limit(0), gazetteer, b.AREAS, b.listing_as_of(), ["seq"])
    events = events.cache()
    assert events.count() + rejected.count() == raw.count()
    assert events.filter("dedupe_group = ''").count() == 0 and events.agg(F.count_distinct("id")).first()[0] == events.count()
    # One of the three spellings is left, and its unplaced listings got the gazetteer's position.
    hotels = events.filter(F.contains("venue_name", F.lit("Royal Hotel")))
    assert hotels.select("venue_name").distinct().count() == 1 and hotels.filter("lat = -33.42").count() > 0
    again, _ = refresh(raw, events, gazetteer, b.AREAS, b.listing_as_of(), ["seq"])
    key = lambda df: {(r.source, r.source_id): (r.id, r.dedupe_group) for r in df.collect()}
    assert key(again) == key(events)
