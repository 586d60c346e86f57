"""SQL forms of the sun, light and verdict formulas, for checking."""

from __future__ import annotations

from vantage import vocab
from vantage.plans.bindings import TZ_HOURS


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def crowd_sql(busy: str) -> str:
    p = f"greatest(0::DOUBLE, least(100::DOUBLE, ({busy})::DOUBLE))"
    arms = []
    for (x0, y0), (x1, y1) in zip(vocab.CROWD_CURVE, vocab.CROWD_CURVE[1:]):
        arms.append(f"WHEN {p} <= {x1} THEN {_d(y0)} + ({p} - {x0}) * {_d(y1 - y0)} / {x1 - x0}")
    return "CASE WHEN (" + busy + ") IS NULL THEN NULL " + " ".join(arms) + f" ELSE {_d(0.48)} END"


def surge_sql(busy: str, typical: str) -> str:
    return f"coalesce({typical} >= 5 AND {busy} >= {typical} * 1.4::DOUBLE AND {busy} - {typical} >= 12, false)"


def dead_sql(busy: str, typical: str) -> str:
    return f"coalesce({typical} >= 25 AND {busy} <= {typical} * 0.5::DOUBLE, false)"


def score_sql(busy: str, typical: str, light: str) -> str:
    factor = "CASE " + light + " " + " ".join(f"WHEN '{k}' THEN {_d(v)}" for k, v in vocab.LIGHT_FACTORS.items()) \
        + " ELSE 1::DOUBLE END"
    return (
        f"greatest(0::DOUBLE, least(1::DOUBLE, ({crowd_sql(busy)}) * ({factor})"
        f" + CASE WHEN {surge_sql(busy, typical)} THEN 0.12::DOUBLE ELSE 0 END"
        f" - CASE WHEN {dead_sql(busy, typical)} THEN 0.08::DOUBLE ELSE 0 END))"
    )


def label_sql(score: str) -> str:
    return "CASE " + " ".join(f"WHEN {score} >= {_d(f)} THEN '{n}'" for f, n in vocab.VERDICT_LABELS) + " ELSE 'Dead' END"


def note_sql(busy: str) -> str:
    return "CASE " + " ".join(f"WHEN {busy} < {b} THEN '{n}'" for b, n in vocab.CROWD_NOTES) \
        + f" ELSE '{vocab.CROWD_NOTE_FULL}' END"


def why_sql(busy: str, typical: str, light: str, estimated: str) -> str:
    light_note = "CASE " + light + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in vocab.LIGHT_NOTES.items()) + " END"
    return (
        f"concat_ws(' · ', ({note_sql(busy)}) || CASE WHEN {estimated} THEN ', going by a normal week' ELSE '' END,"
        f" CASE WHEN {surge_sql(busy, typical)} THEN 'busier than usual for the time (' || {typical} || '% typical)'"
        f" WHEN {dead_sql(busy, typical)} THEN 'quieter than usual (' || {typical} || '% typical)' END, {light_note})"
    )


def sun_sql(source: str, ts: str, lat: str, lon: str, name: str = "sun") -> str:
    """CTE chain that adds the eight crossing times to ``source``."""
    def arc(deg: float) -> str:
        cos_omega = f"((sin(radians({_d(deg)})) - sin(radians({lat})) * sin(decl)) / (cos(radians({lat})) * cos(decl)))"
        return f"CASE WHEN {cos_omega} BETWEEN -1 AND 1 THEN degrees(acos({cos_omega})) / 360 END"

    def at(arc_name: str, sign: str) -> str:
        return (f"make_timestamp_ms(trunc((transit {sign} {arc_name} - 2440587.5::DOUBLE) * 86400000::DOUBLE)::BIGINT)")

    noon = f"(floor(epoch_ms({ts}) / 86400000::DOUBLE + 2440587.5::DOUBLE - 2451545::DOUBLE - 0.0009::DOUBLE + {lon} / 360 + 0.5::DOUBLE) + 0.0009::DOUBLE - {lon} / 360)"
    return f"""{name}_a AS (SELECT *, {noon} AS noon FROM {source}),
{name}_b AS (SELECT *, radians((357.5291::DOUBLE + noon * 0.98560028::DOUBLE) % 360) AS m FROM {name}_a),
{name}_c AS (SELECT *, radians(((357.5291::DOUBLE + noon * 0.98560028::DOUBLE) % 360 + (sin(m) * 1.9148::DOUBLE
  + sin(m * 2) * 0.02::DOUBLE + sin(m * 3) * 0.0003::DOUBLE) + 180 + 102.9372::DOUBLE) % 360) AS lam FROM {name}_b),
{name}_d AS (SELECT *, noon + 2451545::DOUBLE + sin(m) * 0.0053::DOUBLE - sin(lam * 2) * 0.0069::DOUBLE AS transit,
  asin(sin(lam) * sin(radians(23.44::DOUBLE))) AS decl FROM {name}_c),
{name}_e AS (SELECT *, {arc(-0.833)} AS arc_h, {arc(6.0)} AS arc_g, {arc(-6.0)} AS arc_b FROM {name}_d),
{name} AS (SELECT *, {at('arc_h', '-')} AS rise, {at('arc_h', '+')} AS sets, {at('arc_g', '-')} AS g_rise,
  {at('arc_g', '+')} AS g_set, {at('arc_b', '-')} AS b_rise, {at('arc_b', '+')} AS b_set FROM {name}_e)"""


def light_sql(hour: str) -> str:
    clock = lambda t: (
        f"(hour({t} + INTERVAL {TZ_HOURS} HOUR) + minute({t} + INTERVAL {TZ_HOURS} HOUR) / 60::DOUBLE)"
    )
    mid = f"({hour} + 0.5::DOUBLE)"
    inside = lambda a, b: f"coalesce({mid} BETWEEN {clock(a)} AND {clock(b)}, false)"
    return (
        f"CASE WHEN {inside('rise', 'g_rise')} OR {inside('g_set', 'sets')} THEN 'golden'"
        f" WHEN {inside('b_rise', 'rise')} OR {inside('sets', 'b_set')} THEN 'blue'"
        f" WHEN rise IS NULL OR {inside('rise', 'sets')} THEN 'day' ELSE 'night' END"
    )
