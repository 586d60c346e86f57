"""The pipeline against a plain version of every stage, and its edges."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import number, times
from vantage.llm import decontaminate, langid
from vantage.llm.mixing import SEED
from vantage.llm.secrets import find_secrets, redact

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(4)
    words = {"en": [f"the{i}" for i in range(300)], "de": [f"der{i}" for i in range(300)]}
    letters = {k: ["".join(chr(97 + int(c)) if c.isdigit() else c for c in w) for w in v] for k, v in words.items()}
    items = [(k, " ".join(f"item{chr(97 + k)}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(30))) for k in range(8)]
    docs = []
    for i in range(240):
        lang = rng.choice(["en", "en", "de"])
        text = " ".join(rng.choices(letters[lang], k=rng.randrange(6, 60)))
        if i % 7 == 0 and docs:
            text = rng.choice(docs)[1] or ""
        if i % 11 == 0:
            text += " more here"
        if i % 13 == 0:
            text += " " + items[i % 8][1]
        if i % 17 == 0:
            text += " token = abcdef123456"
        if i % 29 == 0:
            text = rng.choice([None, "", "123 !!"])
        docs.append((i, text, lang, f"s{min(rng.randrange(9), 4)}", len(text or "")))
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def test_run_against_plain_stages(spark, tables):
    folder, docs, items = tables
    model = langid.fit(spark.createDataFrame(docs, COLUMNS))
    rows = [r for r in docs if (p := model.predict(r[1]))[0] != langid.UNKNOWN and p[1] >= 0.5]
    assert 200 < len(rows) < len(docs)
    classes = brute([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if classes[r[0]][1] == r[0]]
    leaking = set()
    for r in rows:
        own = decontaminate.text_words(r[1])
        for k, text in items:
            for p in decontaminate.passages(k, text):
                if any(own[s:s + len(p.words)] == p.words for s in range(len(own))):
                    leaking.add(r[0])
    assert leaking
    rows = [r for r in rows if r[0] not in leaking]
    rows = [(r[0], redact(r[1], [dict(zip(("kind", "start", "end", "value_start"), s, strict=True)) for s in find_secrets(r[1])]), *r[2:]) for r in rows]
    assert any("<secret>" in r[1] for r in rows)
    sizes = Counter(r[3] for r in rows)
    roots = sum(n**0.5 for n in sizes.values())
    want = Counter({r: times(sizes[r[3]] ** 0.5 / roots * len(rows) / sizes[r[3]], number(SEED, r[0])) for r in rows})
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "replica", "place"]
    assert Counter(tuple(r)[:5] for r in got.collect()) == +want


def test_stages_keep_columns_and_take_edges(spark, tables):
    folder, docs, _ = tables
    odd = [(None, "null id the words", "en", None, None), (1, None, None, None, None), (500, "a", "en", "s0", 1), (500, "a", "en", "s0", 1)]
    frame = spark.createDataFrame([(*r, "keep", 1) for r in docs[:60] + odd], COLUMNS + ", component_id string, _row int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, folder).schema == frame.schema, name
        assert stage(spark, frame.limit(0), folder).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, frame, folder).columns == [*frame.columns, "replica", "place"]
    one = corpus_pipeline.STAGES[1][1](spark, frame, folder).filter("doc_id = 500 or doc_id is null").collect()
    assert sorted(str(r["doc_id"]) for r in one) == ["500", "None"]
