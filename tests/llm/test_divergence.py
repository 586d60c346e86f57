"""Source divergence against whole-number arithmetic term by term."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from vantage.llm import divergence


def plain(rows, least):
    rows = [(text or "", lang or "", source or "") for _, text, lang, source in rows]
    words = [[re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, *_ in rows]
    seen, n, out = defaultdict(Counter), defaultdict(Counter), []
    for (_, lang, source), found in zip(rows, words):
        seen[lang].update(set(found))
        n[lang, source].update(found)
    for lang in {x[1] for x in rows}:
        kept = [w for w, c in seen[lang].items() if c >= least]
        groups = {s: c for (a, s), c in n.items() if a == lang}
        groups[None] = sum(groups.values(), Counter())
        total = {s: sum(c[w] for w in kept) for s, c in groups.items()}
        p = {s: {w: 1 + 10**9 * (c[w] + 5) // (total[s] + 5 * len(kept)) for w in kept} for s, c in groups.items()}
        for s in groups:
            if s is None:
                continue
            pairs = [(o, sum(abs(p[s][w] - p[o][w]) for w in kept)) for o in groups if o not in (s, None)]
            terms = [(w, p[s][w] - p[None][w]) for w in kept if groups[s][w] and p[s][w] > p[None][w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, divergence.TOP)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def got(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, n int")
    return sorted(tuple(r) for r in divergence.audit(frame).collect())


@pytest.mark.parametrize("block,tile", [(2048, 128), (8, 3)])
def test_against_plain_counts(spark, monkeypatch, block, tile):
    monkeypatch.setattr(divergence, "LEAST", 4)
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "TILE", tile)
    rng = random.Random(block)
    words = [f"{a}{b}" for a in ("Zu", "É", "été", "q", "ß漢") for b in "abcdefghij"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(30))) + "\n3x_Y-z\x7f", rng.choice(["en", "de", None, ""]), rng.choice([None, "", "a\0b", *"opqrstuv"])) for i in range(250)]
    rows += [(900, None, "en", "only null"), (901, "12 34 !?", "xx", "no words"), (902, None, "xx", None), (903, "lone", "yy", "one"), (None, "qa qb", "en", "o"), (1, "qa qb", "en", "o"), (1, "qa qb", "en", "o")]
    rows += [(904, "longword " * 100_000, "en", "p")] + [(905 + i, "same words here", "en", "hot") for i in range(300)]
    assert got(spark, rows) == plain(rows, 4)


def test_empty(spark):
    assert got(spark, []) == []


def test_equal_subtrees_are_one_node():
    levels = divergence.segment_trees(np.array([[0, 0, 0, 0, 1, 2, 0, 0], [1, 2, 0, 0, 0, 0, 0, 0]]))
    assert [len(kinds) for kinds, _ in levels] == [3, 2, 2, 2]
    big = np.array([10**14])
    assert divergence._shares(np.array([10**13]), big, 7)[0] == 1 + 10**9 * (10**13 + 5) // (10**14 + 35)
