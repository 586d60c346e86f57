"""Decontamination against planted passages and against a search of every window without the latent space."""

import random
import time

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from vantage.llm import decontaminate as d

WORDS = [f"{a}{b}{c}" for a in ("ba", "ko", "ri", "tu") for b in ("na", "so", "le", "mi") for c in ("", "dan", "fe", "gor")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + (str(rng.randrange(300)) if rng.random() < 0.5 else "") for _ in range(n)).capitalize() + "."


def planted(seed=1):
    rng = random.Random(seed)
    items = [(k, " ".join(sentence(rng, 9) for _ in range(rng.choice([2, 3, 5])))) for k in range(30)]
    docs, truth = [], set()
    for i in range(300):
        parts = [sentence(rng, rng.randrange(3, 20)) for _ in range(rng.randrange(1, 12))]
        if i % 3 == 0:
            k = rng.randrange(30)
            words = items[k][1].split(" ")
            if i % 2:  # a paraphrase: some words replaced, added or left out
                words = [rng.choice(WORDS) if rng.random() < 0.08 else w for w in words if rng.random() > 0.04]
            parts.insert(rng.randrange(len(parts) + 1), " ".join(words).upper() if i % 4 == 0 else " ".join(words))
            truth.add((i, k))
        docs.append((i, " ".join(parts)))
    return docs, items, truth


def pairs(frame):
    return {(r["doc_id"], r["item_id"]) for r in frame.collect()}


def test_planted_passages(spark):
    docs, items, truth = planted()
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got, every = pairs(d.leaks(docs, items)), pairs(d.leaks(docs, items, cosine=-2.0))  # the second decides all windows
    assert got <= every <= truth
    assert {x for x in truth if x[0] % 2 == 0} <= got
    assert len(got) >= 0.95 * len(every) >= 0.9 * len(truth)


def test_clean_rows_stay(spark):
    docs, items, _ = planted(2)
    rows = [(t, i, "x") for i, t in docs] + [(None, 900, "n"), ("", 901, None), ("short", None, "y")]
    frame, bench = spark.createDataFrame(rows, "text string, doc_id long, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    leaking = {i for i, _ in pairs(d.leaks(frame, bench))}
    kept = d.decontaminated(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in frame.collect() if r["doc_id"] not in leaking)


def test_empty_sides_nulls_and_repeats(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "x"), (3, ""), (4, "é")], "item_id long, text string")
    assert d.leaks(none, bench).collect() == []
    docs = spark.createDataFrame([(5, "zero One, two three four five six seven eight nine ten!")] * 2 + [(6, None), (7, "")], "doc_id long, text string")
    assert d.leaks(docs, none.withColumnRenamed("doc_id", "item_id")).collect() == []
    assert [tuple(r) for r in d.leaks(docs, bench).collect()] == [(5, 1, 1.0)] * 2


def test_common_subsequence():
    rng = random.Random(4)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert d.common_subsequence(d.masks(a), len(a), b) == table[-1][-1]


def test_fragments_at_every_offset(spark):
    rng = random.Random(5)
    docs, items, _ = planted(3)
    docs = docs[1::3]  # those without a planted item
    long = [" ".join(sentence(rng, 12) for _ in range(5)) for _ in range(2)]
    items += [(100 + k, t) for k, t in enumerate(long)]
    truth, words = set(), [t.split(" ") for t in long]
    for k in range(2):
        for size in (24, 34):
            for i in range(60 - size + 1):
                docs.append((1000 * (k + 1) + 100 * (size == 34) + i, f"{sentence(rng, 17)} {' '.join(words[k][i:i + size])} {sentence(rng, 17)}"))
                truth.add((docs[-1][0], 100 + k))
    docs, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert pairs(d.leaks(docs, items, cosine=-2.0)) == truth
    assert pairs(d.leaks(docs, items)) == truth


def test_recall_of_paraphrases():
    """15 to 19 of a passage's 24 words kept, with the answer, in a latent space of random directions: nearly all that the
    word check calls leaks are looked at."""
    rng = random.Random(6)
    table = np.random.default_rng(6).normal(size=(d.TERMS, d.RANK)).astype(np.float32)
    some = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [f"{some(14)}. {some(10)}." for _ in range(60)]
    shelves = d.prepared(table, [p for k, t in enumerate(items) for p in d.passages(k, t)])
    for kept in range(15, 20):
        got = every = 0
        for k, item in enumerate(items):
            words = item.split(" ")
            for j in rng.sample(range(14), 24 - kept):
                words[j] = some(1)
            raw = np.frombuffer(f"{some(rng.randrange(20, 40))} {' '.join(words)} {some(30)}".encode(), np.uint8)
            h, first = d.hashed_words(raw, np.array([0, len(raw)]))
            got += k in d.search(h, first, table, shelves)[0]
            every += k in d.search(h, first, table, shelves, -2.0)[0]
        assert every == 60 and got >= 0.9 * every, (kept, got)


def plain_leaks(docs, items):
    """Every run of 24 words of every item against every stretch of every text, with plain lists."""
    fold = lambda t: pc.utf8_lower(pa.scalar(t)).as_py().replace("ς", "σ")
    split = lambda t: regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}\p{N}])+", fold(t))

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    found = set()
    for k, item in items:
        words = split(item)
        for i, text in docs:
            own = split(text)
            if len(words) < 8:
                if own == words if len(words) < 4 else any(own[j:j + len(words)] == words for j in range(len(own))):
                    found.add((i, k))
                continue
            for p in {tuple(words[j:j + 24]) for j in range(max(1, len(words) - 23))}:
                if set(p) & set(own) and any(common(p, own[j:j + 30]) >= 0.75 * len(p) for j in range(0, max(1, len(own) - 23), 2)):
                    found.add((i, k))
                    break
    return found


def test_against_plain_lists(spark):
    """Verbatim fragments, scripts, quotes and short items; no answer decides here, so only the strong rule counts."""
    rng = random.Random(9)
    docs, items, _ = planted(9)
    docs, items = docs[1::9], items[:6]
    greek = " ".join(rng.choice(["ΛΟΓΟΣ", "ΑΝΘΡΩΠΟΣ", "ΘΕΟΣ", "ΚΑΙ", "ΤΟΥ"]) + str(k % 7) for k in range(30))
    chinese = "".join(chr(0x4E00 + 37 * k % 900) for k in range(60))
    items += [(200, greek), (201, chinese), (202, "“" + "” “".join(f"quoted{k}" for k in range(12)) + "”"), (203, "yes"), (204, "the answer is no"), (205, "six words that must stand together")]
    docs += [(5000, f"x y {greek.lower()} z"), (5001, f"前文{chinese}后文"), (5002, "say " + " ".join(f"quoted{k}" for k in range(12))), (5003, "yes it is"), (5004, "Yes!"),
             (5005, "the one answer that is not a no is yes"), (5006, "and the answer is no."), (5007, "six odd words that must not stand so together"), (5008, "… six words that must stand together")]
    got = pairs(d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == plain_leaks(docs, items)
    assert {(5000, 200), (5001, 201), (5002, 202), (5004, 203), (5006, 204), (5008, 205)} <= got


def test_long_text_and_item(spark):
    rng = random.Random(10)
    long = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(reversed(long)))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(long[30_000:30_040])), (2, " ".join(f"w{rng.randrange(5000)}" for _ in range(8_000)))], "item_id long, text string")
    assert pairs(d.leaks(docs, items)) == {(1, 1)}


def test_passages_share_what_their_item_has():
    own = d.passages(1, " ".join(f"w{k}" for k in range(200)) + ". " + " ".join(f"end{k}" for k in range(30)))
    assert len(own) > 40 and len({id(p.answer_masks) for p in own}) == 1 and own[0].answer_masks == d.masks(own[0].answer)


def some_words(seed, sizes):
    h = np.random.default_rng(seed).integers(0, 2**64, sum(sizes), np.uint64)
    return h, np.concatenate(([0], np.cumsum(sizes)))


def test_sketches_hold_every_passage():
    sizes = [0, 1, 24, 25, 100, 0]
    h, first = some_words(7, sizes)
    h[30:40] = h[30]
    rows = d.BASIS_ROWS + d.SCALE_ROWS
    sums, df, want = np.zeros(rows * d.TERMS, np.int32), np.zeros(d.TERMS, np.int64), np.zeros((rows, d.TERMS), np.int64)
    assert d.add_passages(sums, df, h, first) == sum(-(-s // 24) for s in sizes)
    counts = np.zeros(d.TERMS, np.int64)
    for lo, hi in zip(first, first[1:]):
        for i in range(lo, hi, 24):
            words = h[i:min(i + 24, hi)]
            term = sorted(set(d.terms(words).tolist()))
            counts[term] += 1
            for k in range(8):
                r = int(d.mix(np.array([np.bitwise_xor.reduce(words) + np.uint64(k + 1)]))[0])
                want[(r >> 8) % d.BASIS_ROWS if k < 4 else d.BASIS_ROWS + (r >> 8) % d.SCALE_ROWS, term] += r % 2 * 2 - 1
    assert (df == counts).all() and (sums.reshape(rows, -1) == want).all()
    assert d.add_passages(sums, df, *some_words(0, [0, 0])) == 0


def test_sums_are_added_in_their_own_type():
    """Narrow sums cost no more than wide ones, where signs of another type took over ten times as long."""
    words = some_words(8, [200_000])

    def seconds(dtype):
        sums, df, took = np.zeros((d.BASIS_ROWS + d.SCALE_ROWS) * d.TERMS, dtype), np.zeros(d.TERMS, np.int64), []
        for _ in range(3):
            begin = time.process_time()
            d.add_passages(sums, df, *words)
            took.append(time.process_time() - begin)
        return min(took)

    assert seconds(np.int32) < 3 * seconds(np.int64)
