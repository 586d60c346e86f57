"""Operators against plain loops on small random data."""

import hashlib
import itertools
import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vantage.operators import actions, clean, components, dedupe, grid, merge, merged, place, ranking, readings, validate, venue_life, venues, views
from vantage.sources import traffic

UTC = "yyyy-MM-dd HH:mm:ss"


def km(a, b):
    (la, lo), (lb, lob) = a, b
    x = math.sin(math.radians(lb - la) / 2) ** 2 + math.cos(math.radians(la)) * math.cos(math.radians(lb)) * math.sin(math.radians(lob - lo) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(x))


def greedy(rows):
    """rows: (id, title, day, lat, lng) -> id -> group, taken in id order."""
    keys = {}
    for i, title, day, lat, lng in sorted(rows):
        groups = keys.setdefault(f"{title}|{day}", [])
        for g in groups:
            if all(lat is None or o[0] is None or km((lat, lng), o) <= 0.3 for _, o in g):
                g.append((i, (lat, lng)))
                break
        else:
            groups.append([(i, (lat, lng))])
    return {
        i: hashlib.sha1(f"{k}#{n}".encode()).hexdigest()[:16] for k, gs in keys.items() for n, g in enumerate(gs) for i, _ in g
    }


@pytest.mark.parametrize("row_limit, tile", [(64, 0.02), (1, 0.006), (1, 0.02)])
def test_duplicate_groups_follow_the_sequential_rule(spark, row_limit, tile):
    rnd = random.Random(row_limit * 7 + int(tile * 1000))
    rows = []
    for i in range(1, 500):
        # One key holds a third of all rows, on a dense patch of several tiles.
        title = "hot market" if rnd.random() < 0.35 else rnd.choice(["jazz", "rodeo", "fete", ""])
        where = (None, None) if rnd.random() < 0.15 else (-33.4 + rnd.randrange(60) / 4000, 149.5 + rnd.randrange(60) / 4000)
        rows.append((i, title, rnd.choice(["2024-02-01", "2024-02-02"]), *where))
    rows += [(600, "edge", "2024-02-01", 0.0, 179.9999), (601, "edge", "2024-02-01", 0.0, -179.9999), (602, "edge", "2024-02-01", 0.0, 179.99)]
    df = spark.createDataFrame([(i, t, datetime.fromisoformat(d), la, lo) for i, t, d, la, lo in rows],
                               "id bigint, title string, start_ts timestamp, lat double, lng double")
    got = {r.id: r.dedupe_group for r in dedupe.assign_groups(df, tile, row_limit).collect()}
    assert got == greedy(rows)


def test_ranks(spark):
    rnd = random.Random(3)
    rows = [("hot" if rnd.random() < 0.5 else rnd.choice("ab"), i, float(rnd.choice([rnd.random() * 1000, 5.0, 0.0]))) for i in rnd.sample(range(10**7), 400)]
    df = spark.createDataFrame(rows, "k string, id bigint, v double")
    by_key = {k: sorted(r[1] for r in rows if r[0] == k) for k in {r[0] for r in rows}}
    for r in ranking.rank_by_id(df, ["k"], "id", "pos", shift=18).collect():
        assert by_key[r.k].index(r.id) == r.pos
    for r in ranking.nearest_rank(df, ["k"], "v", grid.scale_index(), "scale").collect():
        vals = sorted(v for k, _, v in rows if k == r.k and v > 0)
        assert r.scale == vals[min(len(vals) - 1, math.floor(0.97 * (len(vals) - 1) + 0.5))] and r.n == len(vals)
    order = [r.id for r in ranking.ordered_positions(df, ["v", "id"], "pos", 7).orderBy("pos").collect()]
    assert order == [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]


def test_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    parent = {n: n for e in edges for n in e}
    for _ in range(80):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {n: parent[n] for n in linked}


def spellings_by_loop(names, towns):
    """All-pairs form of the spelling rule on word lists."""
    keys = {n: sorted(n.split()) for n, _ in names}
    group = {n: {n} for n in keys}

    def absorbs(a, b):
        extra = [w for w in b if w not in a]
        return a and len(a) <= len(b) and all(w in b for w in a) and extra and all(w in towns for w in extra)

    for a, b in itertools.permutations(keys, 2):
        if keys[a] == keys[b] or absorbs(keys[a], keys[b]):
            both = group[a] | group[b]
            for n in both:
                group[n] = both
    uses = dict(names)
    out = {}
    for n, g in group.items():
        best = min(g, key=lambda x: (-uses[x], len(x), x))
        if best != n:
            out[n] = best
    return out


def test_venue_spellings(spark):
    rnd = random.Random(8)
    towns = {"kelso", "orange", "bathurst", "lithgow"}
    words = ["hall", "arena", "royal", *towns]
    names = {" ".join(rnd.choices(words, k=rnd.randint(1, 4))): rnd.randint(1, 4) for _ in range(150)}
    df = spark.createDataFrame(list(names.items()), "name string, uses bigint")
    got = {r.name: r.canonical for r in venues.canonical_names(df, spark.createDataFrame([(t,) for t in towns], "word string")).collect()}
    assert got == spellings_by_loop(list(names.items()), towns)


def test_venue_with_ten_town_words(spark):
    towns = [f"town{chr(97 + i)}" for i in range(10)]
    names = [("Royal Hall " + " ".join(towns), 1), ("Royal Hall", 5), ("Royal Hall " + " ".join(towns[3:5]), 2), ("Other Hall " + towns[0], 1)]
    got = {r.name: r.canonical for r in venues.canonical_names(
        spark.createDataFrame(names, "name string, uses bigint"), spark.createDataFrame([(t,) for t in towns], "word string")).collect()}
    assert got == {names[0][0]: "Royal Hall", names[2][0]: "Royal Hall"}


def test_many_areas_and_none(spark):
    spots = spark.createDataFrame([(-10.0, 100.0 + 299 * 0.1), (60.0, 10.0), (None, None)], "lat double, lng double")
    many = [validate.Area(f"A{i}", -10.0, 100.0 + i * 0.1, 5.0) for i in range(300)]
    assert [r.place_reason == "" for r in validate.check_location(spots, many).collect()] == [True, False, True]
    assert [r.place_reason for r in validate.check_location(spots, []).collect()] == ["outside every area"] * 2 + [""]


def test_known_venue_spellings(spark):
    names = [("Mount Panorama Circuit", 5), ("Mount Panorama", 4), ("Mount Panorama Bathurst", 2), ("Mount Panorama, Bathurst", 2), ("Panorama Bathurst", 2),
             ("Mount Panorama Motor Racing Circuit", 1), ("Mount Panorama Racing Circuit, Bathurst, NSW, Australia", 1), ("Rydges Mount Panorama", 1),
             ("Bathurst RSL Club", 4), ("Penrith RSL Club", 2), ("Penrith RSL", 1), ("Orange Showground", 1), ("Orange Showground s/s", 1), ("Bathurst Showground", 3)]
    towns = venues.localities(["Bathurst", "Orange NSW", "Penrith NSW"], spark.createDataFrame(
        [("1 Short St, Kelso, NSW, 2795",), ("2 Long St, Kelso, NSW, 2795",), ("3 Wide St, Kelso, NSW, 2795",)], "address string"))
    assert {r.word for r in towns.collect()} == {"bathurst", "orange", "penrith", "kelso"}
    got = {r.name: r.canonical for r in venues.canonical_names(spark.createDataFrame(names, "name string, uses bigint"), towns).collect()}
    assert {n for n, c in got.items() if c == "Mount Panorama Circuit"} == {n for n, _ in names[1:7]}
    assert got["Penrith RSL"] == "Penrith RSL Club" and got["Orange Showground s/s"] == "Orange Showground"
    assert not {"Rydges Mount Panorama", "Bathurst RSL Club", "Bathurst Showground", "Orange Showground"} & set(got)


def test_default_region(spark):
    cases = {"NSW": ["1 A St, Bathurst NSW 2795", "2 B St, Orange NSW 2800"], "NS": ["12 Barrington St, Halifax NS B3J 1Z1", "5 Spring Rd, Halifax NS"],
             "CO": ["100 Larimer St, Denver CO 80202"], "": ["somewhere unhelpful"], "ACT": ["a, ACT", "b, WA"]}
    for expect, rows in cases.items():
        df = spark.createDataFrame([(r,) for r in rows], "address string")
        assert df.limit(1).select(clean.default_region(df).alias("r")).first().r == expect


def test_heat_grid(spark):
    rnd = random.Random(9)
    box = (-33.42, 149.55, -33.40, 149.57)
    areas = spark.createDataFrame([("A", "a", box, 150.0, 300.0)], "name string, slug string, bbox struct<south:double,west:double,north:double,east:double>, cell_metres double, kernel_metres double")
    obs = [("a", i, rnd.choice("xy"), box[0] + rnd.uniform(-.002, .022), box[1] + rnd.uniform(-.002, .022), rnd.choice([0.0, .3, .9]), rnd.choice(["p", "q", "", None])) for i in range(200)]
    df = spark.createDataFrame(obs, "area string, obs_id bigint, source string, lat double, lon double, weight double, label string")
    d_lat, d_lon = 150 / 111320, 150 / (111320 * math.cos(math.radians((box[0] + box[2]) / 2)))
    rows, cols = math.ceil((box[2] - box[0]) / d_lat), math.ceil((box[3] - box[1]) / d_lon)
    total, label = {}, {}
    for _, i, src, lat, lon, w, name in obs:
        r0, c0 = math.floor((lat - box[0]) / d_lat), math.floor((lon - box[1]) / d_lon)
        if not (0 <= r0 < rows and 0 <= c0 < cols):
            continue
        for dr, dc in itertools.product(range(-2, 3), repeat=2):
            dist = math.hypot(dr, dc) * 150
            cell = (r0 + dr, c0 + dc)
            if dist <= 300 and 0 <= cell[0] < rows and 0 <= cell[1] < cols:
                part = w * math.exp(-dist * dist / (2 * 100 * 100))
                total[cell] = total.get(cell, 0) + part
                if name and part > label.get(cell, (0, None))[0]:
                    label[cell] = (part, name)
    got = {(r.r, r.c): r for r in grid.heat_grid(grid.locate(df, areas)).collect()}
    assert set(got) == {c for c, v in total.items() if v > 0}
    for cell, r in got.items():
        assert abs(r.raw - total[cell]) < 6e-4 and (r.top_name == label[cell][1] if cell in label else r.top_name is None)
        assert abs(sum(r.breakdown.values()) - total[cell]) < 2e-3


def test_sampled_lines(spark):
    rnd = random.Random(2)
    lines = {k: [(-33.4 + rnd.randrange(40) / 5000, 149.5 + rnd.randrange(40) / 5000) for _ in range(rnd.randint(1, 8))] for k in range(40)}
    lines[1] = [lines[1][0]] * 3
    df = spark.createDataFrame([(k, i, *p) for k, ps in lines.items() for i, p in enumerate(ps)], "k_ int, pos int, lat double, lon double")
    got = {}
    for r in traffic.sample_lines(df, ["k_"], 100.0).orderBy("k_", "k").collect():
        got.setdefault(r.k_, []).append((r.lat, r.lon))
    for k, ps in lines.items():
        out, carry = [ps[0]], 0.0
        for a, b in zip(ps, ps[1:]):
            seg, d = km(a, b) * 1000, 100 - carry
            while seg and d <= seg:
                out.append((a[0] + (b[0] - a[0]) * d / seg, a[1] + (b[1] - a[1]) * d / seg))
                d += 100
            carry = (carry + seg) % 100
        assert len(got[k]) == len(out) and all(abs(x - y) < 1e-7 for p, q in zip(got[k], out) for x, y in zip(p, q))


def test_traffic_feed(spark):
    feed = spark.createDataFrame([
        ("p", n, [(None if n else "jam-1", None, 4, 240, 900.0, 12.0, "Great Western Hwy", "Bathurst",
                   [(149.57, -33.418), (149.576, -33.4185), (149.58, -33.419)])][: 1 if n == 0 else 0] or [("jam-1", None, 4, 240, 900.0, 12.0, "Great Western Hwy", "Bathurst", [])],
         [("alert-1", None, "POLICE", "POLICE_VISIBLE", 8.0, 3, "Conrod Straight", "Bathurst", None, 1755000000000, (149.554, -33.452)),
          ("alert-out", None, "ACCIDENT", None, 9.0, None, None, None, None, None, (151.2093, -33.8688))],
         [("user-moving", None, None, 48.0, None, None, (149.5775, -33.4193, None, None)), ("user-parked", None, None, 0.0, None, None, (149.5781, -33.4201, None, None)),
          ("user-nowhere", None, None, None, None, None, None), (None, "", 10.0, None, 149.58, -33.42, None)])
        for n in (0, 1)], traffic.FEED_SCHEMA.replace("\n", " "))
    box = F.struct(F.lit(-33.46).alias("south"), F.lit(149.52).alias("west"), F.lit(-33.37).alias("north"), F.lit(149.64).alias("east"))
    rows = traffic.feed_observations(feed, box).collect()
    jams = [r for r in rows if r.source == "waze-jam"]
    assert len(jams) >= 8 and {r.kind for r in jams} == {"level-4"} and all('"street":"Great Western Hwy"' in r.meta for r in jams)
    (alert,) = [r for r in rows if r.source == "waze-alert"]
    assert alert.kind == "POLICE_VISIBLE" and abs(alert.weight - 0.36) < 1e-9 and (alert.lat, alert.lon) == (-33.452, 149.554)
    # Two identified drivers once each, the nameless one in both responses.
    assert sorted(r.weight for r in rows if r.source == "waze-users") == [1.0, 1.0, 1.0, 1.5]
    counts = traffic.pass_counters(feed, box).first()
    assert (counts.jams, counts.alerts, counts.users) == (1, 1, 4)


def test_dates_and_places(spark):
    now = F.lit("2026-08-20 00:00:00").cast("timestamp")
    rows = [("2025-08-22T12:00:00.000Z", None), ("2026-08-19T20:00:00Z", None), ("2028-01-01T00:00:00Z", None), ("2026-08-22T00:00:00Z", "2026-10-23T15:00:00Z"),
            ("2026-08-22T00:00:00Z", "2026-08-22T05:00:00Z"), ("2026-08-22T09:00:00Z", "2026-08-22T08:00:00Z"), ("next Saturday", None), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, start_time string, end_time string")
    got = validate.check_dates(df, now).orderBy("i").collect()
    assert "past" in got[0].date_reason and got[1].date_reason == "" and "horizon" in got[2].date_reason
    assert [g.end_ts for g in got[3:6]] == [None, datetime(2026, 8, 22, 5), None] and got[6].date_reason == got[7].date_reason == "no parsable start time"
    spots = spark.createDataFrame([(-33.42, 149.58), (-31.95, 115.86), (None, None)], "lat double, lng double")
    reasons = [r.place_reason for r in validate.check_location(spots, [validate.Area("B", -33.4193, 149.5775, 50.0)]).collect()]
    assert reasons[0] == reasons[2] == "" and reasons[1].endswith("km outside every area")


def test_areas_within_matches_all_pairs(spark):
    rnd = random.Random(8)
    pts = [(i, rnd.uniform(-89.9, 89.9), rnd.choice([rnd.uniform(-180, 180), 179.99, -179.99])) for i in range(300)]
    areas = [(f"a{j}", rnd.uniform(-89, 89), rnd.choice([rnd.uniform(-180, 180), 179.9]), rnd.uniform(10, 900)) for j in range(30)]
    got = {(r.id, r.area) for r in validate.areas_within(
        spark.createDataFrame(pts, "id int, lat double, lng double"), spark.createDataFrame(areas, "name string, lat double, lng double, radius_km double"), "id", bin_deg=2.0).collect()}
    assert got == {(i, n) for i, la, lo in pts for n, ala, alo, r in areas if km((la, lo), (ala, alo)) <= r * 1.5}


def test_round_robin(spark):
    rnd = random.Random(4)
    rows = [(i, "t0" if rnd.random() < 0.5 else rnd.choice(["t1", "t2", "t3"])) for i in range(60)]
    queues = {}
    for i, t in rows:
        queues.setdefault(t, []).append(i)
    order = [q[n] for n in range(60) for q in queues.values() if n < len(q)]
    df = spark.createDataFrame(rows, "pos int, term string")
    for limit in (1, 7, 40, 100):
        assert {r.pos for r in venue_life.round_robin(df, limit).collect()} == set(order[:limit])


def test_upsert_keeps_state_and_position(spark):
    t = datetime(2024, 1, 1)
    cols = "id bigint, source string, source_id string, title string, description string, start_ts timestamp, end_ts timestamp, venue_name string, address string, lat double, lng double, url string, image_url string, category string, price_text string, is_online boolean, photo_score double, last_seen_at timestamp, starred boolean, hidden boolean, dedupe_group string, manual_group string, archived boolean, archived_at timestamp, geocode_tried boolean"
    base = lambda sid, title, lat: ("s", sid, title, "", t, None, "", "", lat, lat, "", "", "", "", False, 0.0, t)
    old = spark.createDataFrame([(7, *base("a", "old", 1.0), True, True, "g", "m", True, t, True), (9, *base("b", "kept", 2.0), False, False, "", "", False, None, False)], cols)
    new = spark.createDataFrame([(*base("a", "n" * 400, None), 1), (*base("c", "first", 3.0), 1), (*base("c", "last", 3.0), 2)],
                                ", ".join(c for c in cols.split(", ")[1:18]) + ", seq int")
    for strict in (False, True):
        rows = {r.source_id: r for r in merge.upsert_events(old, new, ["seq"], strict, title_chars=300).collect()}
        a = rows["a"]
        assert a.id == 7 and a.title == "n" * 300 and a.starred and a.archived and a.manual_group == "m" and a.lat == (None if strict else 1.0)
        assert {len(r.title) for r in merge.upsert_events(old, new, ["seq"], strict).collect() if r.source_id == "a"} == {400}
        assert rows["b"].title == "kept" and rows["c"].title == "last" and rows["c"].id == 10 and rows["c"].archived is False


def test_merged_group_of_blank_fields_and_member_order(spark):
    t = datetime(2024, 1, 1)
    rows = [(i, "s", "", "d" * (i % 3), t + timedelta(days=i % 2), None, "", "", None, float(i) if i > 3 else None, "", "x.jpg" if i > 2 else "", "", "", i != 9, i == 5, False, 1.0 * i, "", "g" if i < 9 else "h") for i in range(10)]
    df = merged.with_group(spark.createDataFrame(rows, "id bigint, source string, title string, description string, start_ts timestamp, end_ts timestamp, venue_name string, address string, lat double, lng double, url string, image_url string, category string, price_text string, is_online boolean, starred boolean, hidden boolean, photo_score double, manual_group string, dedupe_group string"))
    heads = {r.group_key: r for r in merged.merged_heads(df).collect()}
    g = heads["g"]
    assert (g.title, g.description, g.lat, g.lng, g.member_count, g.starred, g.is_online) == ("", "dd", None, 4.0, 9, True, True)
    order = [(r.group_key, r.id) for r in sorted(merged.member_positions(df).collect(), key=lambda r: (r.group_key, r.position))]
    assert order == [("g", i) for i in (0, 2, 4, 6, 8, 1, 3, 5, 7)] + [("h", 9)] and not heads["h"].is_online


def test_manual_merge_is_idempotent(spark):
    df = merged.with_group(spark.createDataFrame([(1, "", "a"), (2, "", "b"), (3, "", "b"), (4, "", "c")], "id bigint, manual_group string, dedupe_group string"))
    ask = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "request_id int, group_key string")
    marks = actions.merge_groups(df, ask)
    name = "m" + hashlib.sha1(hashlib.sha1(b"1,2,3").hexdigest().encode()).hexdigest()[:15]
    assert {r.id: r.manual_group for r in marks.collect()} == {1: name, 2: name, 3: name}
    far = merged.with_group(spark.createDataFrame([(1, "", "a"), (70000, "", "b")], "id bigint, manual_group string, dedupe_group string"))
    parts = ",".join(hashlib.sha1(x).hexdigest() for x in (b"1", b"70000"))
    assert {r.manual_group for r in actions.merge_groups(far, ask).collect()} == {"m" + hashlib.sha1(parts.encode()).hexdigest()[:15]}
    again = merged.with_group(actions.apply_actions(df, marks))
    ask2 = spark.createDataFrame([(1, name)], "request_id int, group_key string")
    assert {r.manual_group for r in actions.merge_groups(again, ask2).collect()} == {name}
    assert [r.request_id for r in actions.refused_merges(df, ask).collect()] == [2]
    split = actions.unmerge_groups(again, ask2.select("group_key"))
    assert split.count() == 3 and {r.manual_group for r in actions.apply_actions(again, split).collect()} == {""}


def test_geocode_candidates(evaluate):
    got = evaluate(lambda v, a: place.geocode_candidates(v, a, ["Bathurst, NSW", "Orange"]), [
        ("Royal Hotel", "1 High St, Bathurst"), ("Hall, Bathurst, NSW", ""), ("", "169 College Road"), ("", "")], "v string, a string")
    assert got[0] == ["1 High St, Bathurst", "Royal Hotel, Bathurst, NSW", "Royal Hotel, Orange", "Royal Hotel, 1 High St, Bathurst"]
    assert got[1] == ["Hall, Bathurst, NSW", "Hall"] and got[2] == ["169 College Road, Bathurst, NSW", "169 College Road, Orange"] and got[3] == []


def test_place_order_ignores_case_and_accents(spark):
    t = datetime(2024, 1, 1)
    df = spark.createDataFrame([(v, "", t) for v in ["Zoo", "école", "Eagle", "", "arena"]], "venue_name string, locality string, start_ts timestamp")
    assert [r.place for r in views.by_place(df).collect()] == ["arena", "Eagle", "école", "Zoo", ""]


def test_trailing_baseline_with_ties_and_gaps(spark):
    rng, t0 = random.Random(4), datetime(2024, 3, 1)
    rows = [(i, rng.choice("ab"), rng.choice(["x", "x", "x", "y"]), t0 + timedelta(minutes=rng.randrange(90 * 24 * 60) // 7 * 7),
             rng.choice([None, rng.randrange(101), rng.randrange(20)])) for i in range(1500)]
    rows += [(5000 + i, "a", "alone", t0 + timedelta(days=d), v) for i, (d, v) in enumerate([(0, 50), (28, 90), (28, 90), (57, 10), (85, 3)])]
    rows += rows[:50] + [(9000, "a", "x", None, 5)]
    got = readings.trailing_baseline(spark.createDataFrame(rows, "obs_id long, area string, name string, ts timestamp, live int")).collect()
    # Hours from the session's own reading of the wall clock: only differences matter here.
    live = [(a, n, int((t - t0).total_seconds() // 3600), v) for _, a, n, t, v in rows if t is not None and v is not None]
    first = min(r["hour"] for r in got) - min(h for _, _, h, _ in live)
    keys = {x[:3] for x in live}
    assert len(got) == len(keys)
    for r in got:
        key = (r["area"], r["name"], r["hour"] - first)
        now = [v for a, n, h, v in live if (a, n, h) == key]
        past = [v for a, n, h, v in live if (a, n) == key[:2] and key[2] - 24 * 28 <= h < key[2]]
        usual = math.floor(sum(past) / len(past) + 0.5) if past else None
        busy = math.floor(sum(now) / len(now) + 0.5)
        assert (r["live"], r["samples"], r["usual"], r["usual_samples"]) == (busy, len(now), usual, len(past))
        assert r["surge"] == bool(past and usual >= 5 and busy >= usual * 1.4 and busy - usual >= 12)
        assert r["dead"] == bool(past and usual >= 25 and busy <= usual * 0.5)
    alone = {(r["live"], r["usual"], r["surge"], r["dead"]) for r in got if r["name"] == "alone"}
    assert alone == {(50, None, False, False), (90, 50, True, False), (10, None, False, False), (3, 10, False, False)}


def test_merges_do_not_multiply_requests_by_listings(spark):
    ids = [(i, "m1" if i % 2 else "", f"d{i % 7}") for i in range(0, 300_000, 1500)] + [(None, "", "d0"), (3000, "", "d0")]
    df = merged.with_group(spark.createDataFrame(ids, "id bigint, manual_group string, dedupe_group string"))
    ask = [(r, g) for r in range(40) for g in ("d0", f"d{r % 7}", f"gone{r}")] + [(90, "gone"), (91, f"d{1}")]
    got = {r.id: r.manual_group for r in actions.merge_groups(df, spark.createDataFrame(ask, "request_id int, group_key string")).collect()}
    groups = {}
    for i, m, d in ids:
        groups.setdefault(m or d, []).append(i)
    want, refused = {}, set()
    for r in sorted({r for r, _ in ask}):
        rows = [i for g in {g for q, g in ask if q == r} for i in groups.get(g, [])]
        if len({i for i in rows if i is not None}) < 2:
            refused.add(r)
        if len(rows) >= 2:
            slices = {}
            for i in rows:
                slices.setdefault(-1 if i is None else i >> 16, []).append(i)
            parts = [hashlib.sha1(",".join(str(i) for i in sorted(x for x in v if x is not None)).encode()).hexdigest() for _, v in sorted(slices.items())]
            want |= {i: "m" + hashlib.sha1(",".join(parts).encode()).hexdigest()[:15] for i in rows}
    assert got == want
    found = actions.refused_merges(df, spark.createDataFrame(ask, "request_id int, group_key string"))
    assert {r.request_id for r in found.collect()} == refused
    # Nothing that is joined grows with requests times listings: many requests for one large group stay small.
    many = merged.with_group(spark.range(20_000).selectExpr("id", "'m1' AS manual_group", "'' AS dedupe_group"))
    every = spark.range(20_000).selectExpr("id AS request_id", "'m1' AS group_key")
    assert actions.merge_groups(many, every).select("manual_group").distinct().count() == 1
    assert actions.refused_merges(many, every).count() == 0


def test_points_per_area_counts_pairs_without_listing_them(spark):
    points = spark.createDataFrame([(i, None if i % 9 == 0 else -33.4 + (i % 5) / 100, 149.5 + (i % 3) / 100) for i in range(200)], "id long, lat double, lng double")
    areas = spark.createDataFrame([(f"a{i % 30}" if i % 11 else None, -33.4 + (i % 4) / 100, 149.5, (i % 3) / 1.0) for i in range(60)],
                                  "name string, lat double, lng double, radius_km double")
    want = {r["area"]: r["count"] for r in validate.areas_within(points, areas, "id", bin_deg=0.01).groupBy("area").count().collect()}
    assert {r["area"]: r["n"] for r in validate.points_per_area(points, areas, bin_deg=0.01).collect()} == want
    # As many pairs as rows squared, yet one position and one circle.
    many = spark.range(50_000).selectExpr("id", "-33.4D AS lat", "149.5D AS lng")
    same = spark.range(50_000).selectExpr("CAST(id AS STRING) AS name", "-33.4D AS lat", "149.5D AS lng", "1D AS radius_km")
    assert validate.points_per_area(many, same, bin_deg=0.01).filter("n = 50000").count() == 50_000


def test_events_per_venue_counts_pairs_without_listing_them(spark):
    events = spark.createDataFrame([
        (f"g{i}", i % 7 == 0, ["", "Hall", "HALL", "Pub", None][i % 5], None if i % 4 == 0 else -33.4 + (i % 3) / 1000, 149.5) for i in range(120)],
        "group_key string, hidden boolean, venue_name string, lat double, lng double")
    venues = spark.createDataFrame([
        (f"area-{i % 2}", str(i % 6), ["hall", "Pub", "Bar", None][i % 4], -33.4 + (i % 5) / 1000 if i % 8 else None, 149.5) for i in range(24)],
        "area string, cid string, name string, lat double, lon double")
    want = {r["cid"]: r["count"] for r in views.events_at_venues(events, venues).groupBy("cid").count().collect()}
    assert want and {r["cid"]: r["events"] for r in views.events_per_venue(events, venues).collect()} == want
    many = spark.range(50_000).selectExpr("CAST(id AS STRING) AS group_key", "false AS hidden", "'Hall' AS venue_name", "-33.4D AS lat", "149.5D AS lng")
    same = spark.range(50_000).selectExpr("'area-0' AS area", "CAST(id AS STRING) AS cid", "'hall' AS name", "-33.4D AS lat", "149.5D AS lon")
    assert views.events_per_venue(many, same).filter("events = 50000").count() == 50_000


def test_cell_labels_only_compare_the_heaviest_weights(spark):
    rng = random.Random(4)
    rows = [("a", i, rng.choice([None, "", "x", "y", f"z{i}"]), rng.choice([0.0, 0.25, 0.5, 0.5, 1.0]), rng.randrange(5), rng.randrange(5)) for i in range(300)]
    located = spark.createDataFrame(rows, "area string, obs_id long, label string, weight double, row long, col long").selectExpr(
        "*", "150D AS cell_metres", "300D AS kernel_metres", "named_struct('n_rows', 5L, 'n_cols', 5L) AS g")
    want = {}
    for r in range(5):
        for c in range(5):
            hits = []
            for _, i, label, w, y, x in rows:
                far = math.hypot(r - y, c - x) * 150
                if label and w > 0 and far <= 300:
                    hits.append((-w * math.exp(-far * far / (2 * 100 * 100)), i, label))
            want[r, c] = min(hits)[2]
    assert {(x.r, x.c): x.top_name for x in grid.cell_labels(located).collect()} == want
    # Labels join what numbers alone have chosen, ahead of the kernel.
    assert "LeftSemi" in grid.cell_labels(located)._jdf.queryExecution().toString()
