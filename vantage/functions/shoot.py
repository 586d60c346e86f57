"""Crowd curve, verdicts, best windows and colour ramps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vantage import vocab
from vantage.functions import let
from vantage.functions.times import half_up

WINDOW_TOLERANCE = 0.08
WINDOW_FLOOR = 0.2


def crowd_score(busy: Column) -> Column:
    """Piecewise-linear desirability of a busyness percentage."""
    p = F.greatest(F.lit(0.0), F.least(F.lit(100.0), busy.cast("double")))
    curve = vocab.CROWD_CURVE
    out = F.lit(curve[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(curve, curve[1:]))):
        out = F.when(p <= x1, F.lit(y0) + (p - x0) * (y1 - y0) / (x1 - x0)).otherwise(out)
    return F.when(busy.isNotNull(), out)


def light_factor(light: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.LIGHT_FACTORS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, light), F.lit(1.0))


def verdict_label(score: Column) -> Column:
    out = F.lit("Dead")
    for floor, name in reversed(vocab.VERDICT_LABELS):
        out = F.when(score >= floor, name).otherwise(out)
    return out


def crowd_note(busy: Column) -> Column:
    out = F.lit(vocab.CROWD_NOTE_FULL)
    for below, note in reversed(vocab.CROWD_NOTES):
        out = F.when(busy < below, note).otherwise(out)
    return out


def is_surge(busy: Column, typical: Column) -> Column:
    return F.coalesce((typical >= 5) & (busy >= typical * 1.4) & (busy - typical >= 12), F.lit(False))


def is_dead(busy: Column, typical: Column) -> Column:
    return F.coalesce((typical >= 25) & (busy <= typical * 0.5), F.lit(False))


def raw_score(busy: Column, typical: Column, light: Column) -> Column:
    score = (
        crowd_score(busy) * light_factor(light)
        + F.when(is_surge(busy, typical), 0.12).otherwise(0.0)
        - F.when(is_dead(busy, typical), 0.08).otherwise(0.0)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def _curve_at(percent: int) -> float:
    for (x0, y0), (x1, y1) in zip(vocab.CROWD_CURVE, vocab.CROWD_CURVE[1:]):
        if percent <= x1:
            return y0 + (percent - x0) * (y1 - y0) / (x1 - x0)
    return vocab.CROWD_CURVE[-1][1]


def profile_score(percent: Column, light: Column) -> Column:
    """raw_score of a whole percentage without a typical value, as a table lookup.

    Light enough to run inside a lambda over the hours of a weekly profile.
    """
    curve = F.array(*[F.lit(_curve_at(p)) for p in range(101)])
    at = F.get(curve, F.greatest(F.lit(0), F.least(F.lit(100), percent)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), at * light_factor(light)))


def verdict(busy: Column, typical: Column, light: Column, estimated: Column) -> Column:
    """struct(score, label, why, light, surge, estimated); Unknown without a reading."""
    score = raw_score(busy, typical, light)
    notes = F.create_map(*[F.lit(x) for pair in vocab.LIGHT_NOTES.items() for x in pair])
    percent = typical.cast("string")
    change = F.when(
        is_surge(busy, typical),
        F.concat(F.lit("busier than usual for the time ("), percent, F.lit("% typical)")),
    ).when(is_dead(busy, typical), F.concat(F.lit("quieter than usual ("), percent, F.lit("% typical)")))
    crowd = F.concat(
        crowd_note(busy), F.when(F.coalesce(estimated, F.lit(False)), ", going by a normal week").otherwise("")
    )
    why = F.concat_ws(" · ", crowd, change, F.try_element_at(notes, light))
    known = busy.isNotNull()
    return F.struct(
        F.when(known, score).otherwise(0.0).alias("score"),
        F.when(known, verdict_label(score)).otherwise("Unknown").alias("label"),
        F.when(known, why).otherwise("no reading").alias("why"),
        light.alias("light"),
        F.when(known, is_surge(busy, typical)).alias("surge"),
        F.when(known, estimated).alias("estimated"),
    )


def best_window(hours: Column, scores: Column) -> Column:
    """Contiguous hours around the best one whose score is within the tolerance.

    ``hours`` lists distinct whole hours, ``scores`` their scores. Works inside
    the row: the window ends where the first non-qualifying hour lies on each
    side of the best hour.
    """
    pairs = F.arrays_zip(hours.alias("h"), scores.alias("s"))
    # Highest score first, then earliest hour.
    best = F.array_min(F.transform(
        pairs, lambda p: F.struct((-p["s"]).alias("neg"), p["h"].alias("hour"))
    ))

    def around(found: Column) -> Column:
        score, hour = -found["neg"], found["hour"]
        near = F.transform(F.filter(pairs, lambda p: p["s"] >= score - WINDOW_TOLERANCE), lambda p: p["h"])
        gaps = F.array_except(F.sequence(F.array_min(hours) - 1, F.array_max(hours) + 1), near)
        return F.when(
            score > WINDOW_FLOOR,
            F.struct(
                (F.array_max(F.filter(gaps, lambda h: h < hour)) + 1).alias("from_hour"),
                (F.array_min(F.filter(gaps, lambda h: h > hour)) - 1).alias("to_hour"),
                score.alias("score"), verdict_label(score).alias("label"),
            ),
        )

    return let(best, around)


def ramp_colour(score: Column, ramp: str = "grid") -> Column:
    """#rrggbb along a six-stop ramp."""
    stops = vocab.COLOUR_STOPS[ramp]
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) * (len(stops) - 1)
    i = F.least(F.floor(t), F.lit(len(stops) - 2)).cast("int")
    channels = []
    for k in (1, 3, 5):
        levels = F.array(*[F.lit(int(s[k:k + 2], 16)) for s in stops])
        a, b = F.get(levels, i), F.get(levels, i + 1)
        channels.append(F.lpad(F.lower(F.hex(half_up(a + (b - a) * (t - i)))), 2, "0"))
    return F.concat(F.lit("#"), *channels)


def jam_severity(level: Column, delay: Column) -> Column:
    by_level = F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(level, F.lit(0)))) / 5.0
    by_delay = F.least(F.greatest(F.coalesce(delay, F.lit(0)), F.lit(0)) / 600.0, F.lit(1.0))
    return F.when(delay == -1, 1.0).otherwise(F.greatest(by_level, by_delay))


def alert_weight(kind: Column, reliability: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in vocab.ALERT_WEIGHTS.items() for x in pair])
    base = F.coalesce(F.try_element_at(table, kind), F.lit(0.3))
    trust = F.least(F.coalesce(reliability, F.lit(5.0)) / 10.0, F.lit(1.0)) * 0.5 + 0.5
    return base * trust


def panel_wait_ms(streak: Column, full_ms: int, short_ms: int = 3500, patience: int = 3, reprobe: int = 24) -> Column:
    """Wait for a busyness panel: full patience unless it has come up empty for a while."""
    n = F.coalesce(streak, F.lit(0))
    return F.when((n < patience) | (n % reprobe == 0), full_ms).otherwise(short_ms)


def cloud_note(percent: Column) -> Column:
    return (
        F.when(percent.isNull(), "").when(percent < 15, "clear — flat sky")
        .when(percent < 40, "some cloud — good").when(percent < 75, "broken cloud — best")
        .otherwise("overcast — soft light")
    )


def versus_typical(live: Column, typical: Column) -> Column:
    return F.when(live > typical, "↑").when(live < typical, "↓").when(live == typical, "·")
