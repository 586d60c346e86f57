"""Quality rules against plain counting and exact quantiles of the sketch's rounded values."""

import random
import re
from collections import Counter

from vantage.llm import quality


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    again = {j for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(lines))


def test_counts():
    rng = random.Random(1)
    parts = ["a", "bé", "c#", "<d>", " ", "  ", "\n", "\t", "\x0b", "\x85", "\xa0", "\x1c", "e f g ", "e f g "]
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randrange(40)))
        assert quality.counts(text) == plain_counts(text)
    assert quality.counts(None) == (0,) * 6


def rounded(v):
    shift = max(v.bit_length() - 6, 0)
    return v >> shift << shift


def test_limits_and_verdicts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", None])
        words = [rng.choice("abcdefgh") * rng.randrange(1, 9) + str(rng.randrange(400)) for _ in range(rng.choice([30, 60, 80]))]
        for _ in range(rng.choice([0] * 20 + [1, 30])):
            words[rng.randrange(len(words))] = "###"
        rows.append((i, "\n".join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9)), lang, source, 5))
    rows += [(900, None, "en", "a", 5), (901, "", None, None, 5)]
    got = {r["doc_id"]: r for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")).collect()}
    measured = {r[0]: (plain_counts(r[1]), r[2], r[3]) for r in rows}
    base = {i: c[0] < 50 or 100 * c[4] > 50 * c[0] for i, (c, _, _) in measured.items()}
    place = dict(zip(quality.COUNTS, range(6), strict=True))

    def rate(c, k):
        over, under, _ = quality.RATES[k]
        return c[place[over]] * 1000 // max(c[place[under]], 1)

    def limit(k, member):
        values = sorted(rounded(rate(c, k)) for i, (c, la, so) in measured.items() if not base[i] and member(la, so))
        q = [values[-(-len(values) * n // 4) - 1] for n in (1, 2, 3)] if values else None
        return len(values), q and q[1] + max(quality.SPREADS * (q[2] - q[0]), quality.RATES[k][2])

    for i, (c, la, so) in measured.items():
        r = got[i]
        assert tuple(r[x] for x in quality.COUNTS) == c and r["base_failed"] == base[i]
        if base[i]:
            assert not r["kept"]
            continue
        over = []
        for k in quality.RATES:
            for member in (lambda a, b: (a, b) == (la, so), lambda a, b: a == la, lambda a, b: True):
                n, high = limit(k, member)
                if n >= quality.LEAST_GROUP:
                    break
            if rate(c, k) > high:
                over.append(k)
        assert r["reasons"] == over and r["kept"] == (not over)
    assert sum(r["kept"] for r in got.values()) and any(r["reasons"] for r in got.values())


def test_empty(spark):
    assert quality.judged(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).collect() == []
