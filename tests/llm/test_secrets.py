"""The secret scan against its patterns applied to whole texts."""

import random
import re

from pyspark.sql import functions as F

import __spark_entry__ as entry
from vantage.llm.secrets import base62_crc, find_secrets, redact, redacted, secrets

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(k, m.start(), m.end()) for k, (p, good) in BASE.items() for m in p.finditer(text or "") if good(m)]
    return sorted(found, key=lambda x: (x[1], list(BASE).index(x[0])))


def made(seed):
    rng = random.Random(seed)
    parts = ["password", "PassWd", "secret", "token", "API_KEY", "apikey", "=", ": ", " ", "\"", "'", "AKIA", "ABCDEF0123456789", "abcdef0123456789", "x9.-/", "é", "ſecret", "\n", "toKen=", "short"]
    return ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)] + ["", None, "token = token: abcdefg", "AKIAAKIA" + "A" * 20, "a" * 23, "a" * 24, "ſecret=abcdefgh"]


def test_base_kinds_against_whole_patterns():
    for text in made(1):
        assert [s[:3] for s in find_secrets(text) if s[0] in BASE] == brute(text)


def test_checksums_decide():
    body = "0aZ" * 10
    good, bad = f"ghp_{body}{base62_crc(body)}", f"ghp_{body}000000"
    assert [s[:3] for s in find_secrets(f"é {good} and {bad} npm_{body}{base62_crc(body)}")] == [("forge", 2, 42), ("package", 88, 128)]
    assert find_secrets("x" + good) == find_secrets(good + "a") == []


def test_query_and_rows(spark):
    texts = made(2)[-300:]
    frame = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)] + [(None, "token=abcdefgh", "n")], "doc_id long, text string, spans string")
    rows = {r["doc_id"]: [tuple(s)[:3] for s in r["spans"]] for r in secrets(frame).collect()}
    assert len(rows) == len(texts) + 1
    assert all([s for s in rows[i] if s[0] in BASE] == brute(t) for i, t in enumerate(texts))
    assert secrets(frame.limit(0)).collect() == []


def test_redaction_keeps_rows_and_columns(spark):
    frame = spark.createDataFrame([("token = abc123456 end", 1, "a"), (None, 2, None), ("clean", None, "c")], "text string, doc_id long, _row string")
    got = redacted(frame)
    assert got.schema == frame.schema
    assert [r["text"] for r in got.orderBy(F.col("doc_id").asc_nulls_last()).collect()] == ["token = <secret> end", None, "clean"]
    assert redact("ab", []) == "ab"


def test_registered(spark):
    row = entry.queries()["op1_secret_scan"](spark, "/root/testdata/sf0.001").orderBy("doc_id").first()
    assert list(row.asDict()) == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
