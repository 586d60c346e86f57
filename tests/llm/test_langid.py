"""Language identification: held-out accuracy, backoff and edges."""

import math
import random
import zlib

import regex

import __spark_entry__ as entry
from vantage.llm import langid


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = entry.queries()["op7_language_id"](spark, sf).collect()
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_model_sees_no_held_out_row(spark):
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "held words only", "zz") if i in ids else (i, "plain words here", "aa") for i in range(60)] + [(None, "x y", "qq"), (90, None, "rr"), (91, "x", None)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["aa"] and "held" not in model.index[0]


def test_backoff_and_edges(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["strasse", "mann", "und"] if i % 2 else ["street", "man", "and"], k=8)), "de" if i % 2 else "en", "n") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(frame)
    assert model.predict("STRASSEN")[0] == "de" and model.predict("streets")[0] == "en"
    assert model.predict(None) == model.predict("") == model.predict("12 !?") == ("und", 0.0)
    assert model.predict("漢字") == ("de", 0.5)
    texts = spark.createDataFrame([(1, None), (2, "und"), (2, "und"), (None, "man")], "doc_id long, text string")
    assert sorted((r[0] or 0, r[1]) for r in langid.languages(texts, model).collect()) == [(0, "en"), (1, "und"), (2, "de"), (2, "de")]
    kept = langid.recognised(frame.unionByName(frame.limit(1).selectExpr("doc_id", "cast(null as string) text", "lang", "score")), model)
    assert kept.schema == frame.schema and kept.count() == 200
    nothing = langid.fit(frame.limit(0))
    assert langid.languages(texts, nothing).select("lang_pred").distinct().collect()[0][0] == "und"


def plain(model, text):
    """One word at a time, with dictionaries."""
    first, at = 0, []
    for own in model.index:
        at.append({g: first + i for i, g in enumerate(own)})
        first += len(own)
    total = [0.0] * len(model.langs)
    words = [w for w in regex.findall(r"[\p{L}\p{M}]+", text.lower()) if regex.search(r"\p{L}", w)]
    for w in words:
        rows = [at[0][w]] if w in at[0] else next((r for n in range(langid.LONGEST, 0, -1) if (r := [at[n][g] for g in langid.grams(w, n) if g in at[n]])), [])
        for k in range(len(total)):
            total[k] += sum(model.logs[r][k] for r in rows) / max(len(rows), 1)
    if not words:
        return "und", 0.0
    share = [math.exp(x - max(total)) for x in total]
    return model.langs[share.index(max(share))], max(share) / sum(share)


def test_against_plain_scorer(spark):
    rng = random.Random(3)
    kinds = {"hi": ["\u0939\u093f\u0928\u094d\u0926\u0940", "\u0928\u092e\u0938\u094d\u0924\u0947", "\u0915\u093f\u0924\u093e\u092c"], "fr": ["été", "naïve", "œuvre", "garçon"], "zh": ["漢字", "仮名文", "𠀀字"], "en": ["street", "island", "a", "o'clock"]}
    rows = [(i, " ".join(rng.choices(kinds[la], k=9)) + " 12 ½", la) for i, la in enumerate(list(kinds) * 60)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "\u0939\u093f\u0928\u094d\u0926\u0940" in model.index[0]
    letters = [*"abcdeéœïgstrla", *"\u0939\u093f\u0928\u094d", "漢", "𠀀", "½", "²", "\u0301", " ", "-", "X", "É"]
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(300)] + [" ".join(rng.choices(sum(kinds.values(), []), k=5)) for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.languages(frame, model).collect():
        lang, score = plain(model, texts[r["doc_id"]])
        assert abs(score - r["score"]) < 1e-9 and (r["lang_pred"] == lang or score < 0.51)
    assert model.predict("½ ² ①") == model.predict("\u0301 \u0302") == ("und", 0.0)


def test_long_text(spark):
    model = langid.fit(spark.createDataFrame([(i, "street mann"[:6] if i % 2 else "mann und", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string"))
    text = " ".join(f"street{i % 1000}" for i in range(600_000))
    assert model.predict(text)[0] == "en"
