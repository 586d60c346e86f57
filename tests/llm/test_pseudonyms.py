"""Pseudonyms: permutations, formats, validation and linkage."""

import datetime
import random
import time

from vantage.llm import pseudonyms as p

KEY = b"k"


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        assert sorted(p.permuted(i, size, KEY, "t") for i in range(size)) == list(range(size))
    assert [p.permuted(i, 1000, KEY, "t") for i in range(20)] != [p.permuted(i, 1000, b"other", "t") for i in range(20)]


def test_formats_stay_valid():
    cases = {
        "card": "4111 1111-1111 1111", "phone": "+1 (017) 555-7713", "ssn": "123-45-6789", "ipv4": "97.51.17.173",
        "date": "2024-02-29", "iban": "DE89 3704 0044 0532 0130 00", "email": "Anna.72@mail3.example.com"}
    for kind, value in cases.items():
        [(k, lo, hi, new)] = p.replacements(f"é {value}, x", KEY)
        assert (k, lo, hi) == (kind, 2, 2 + len(value)) and new != value
        if kind not in ("ipv4",):
            assert [c if not c.isalnum() else "x" for c in new] == [c if not c.isalnum() else "x" for c in value]
        assert [x[0] for x in p.replacements(new, KEY)] == [kind]  # still valid
    assert p.date("29/02/2024", KEY)[2] == "/" and datetime.date.fromisoformat(p.date("1999-12-31", KEY))
    assert p.email("Anna.72@mail3.example.com", KEY).split("@")[1] == "mail3.example.com"


def test_distinct_values_stay_distinct():
    assert len({p.ssn(f"123-45-{i:04d}", KEY) for i in range(1, 2000)}) == 1999
    assert len({p.date(f"{1900 + i // 12}-{i % 12 + 1:02d}-15", KEY) for i in range(1200)}) == 1200
    assert len({p.email(f"a{i}@x.org", KEY) for i in range(100)}) == 100


def test_invalid_values_stay():
    for text in ("4111 1111 1111 1112", "1234567890123", "000-12-3456", "256.1.1.1", "1.2.3.04", "2023-02-29", "31/31/2020", "DE00 3704 0044 0532 0130 00", "1.2.3.4.5", "a@b", "12345", None, "", "0000000000000000"):
        assert p.replacements(text, KEY) == [], text


def test_values_with_something_behind_or_before():
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    cases = [("card", v, text) for v in (card, card.replace(" ", ""), card.replace(" ", "-")) for text in (
        "{} 12/25", "{} 12/25 123", "{} 123.", "{}-123", "pay {} 737, x", "12/25 {} 123", "{}  12", "17 {}", "1234 {}")]
    cases += [("iban", v, text) for v in (iban, iban.replace(" ", "")) for text in ("{} EUR", "{} EUR 12.50", "{} BIC GEBABEBB", "{} PAID", "AB13 {} OK", "{} 4111")]
    for kind, value, text in cases:
        assert [(k, text.format(value)[lo:hi]) for k, lo, hi, _ in p.replacements(text.format(value), KEY)] == [(kind, value)], text.format(value)
    both = p.replacements(f"{iban} {card} 12/25 {card} 123", KEY)
    assert [(k, hi - lo) for k, lo, hi, _ in both] == [("iban", 19), ("card", 19), ("card", 19)]


def test_rows_of_cards():
    card = "4111 1111 1111 1111"
    assert [x[0] for x in p.replacements(" ".join([card] * 2), KEY)] == ["card"] * 2
    for value in ("378282246310005", "3782 822463 10005", "30569309025904", "3056-930902-5904", "5555-5555-5555-4444", "6011 1111 1111 1117", "4222222222222"):
        [(kind, lo, hi, new)] = p.replacements(f"no {value}, x", KEY)
        assert kind == "card" and hi - lo == len(value) and p.issued(p.digits_of(new)) and [x[0] for x in p.replacements(new, KEY)] == ["card"]


def test_plain_numbers_stay():
    rng = random.Random(3)
    short = [" ".join(str(rng.randrange(10, 1000)) for _ in range(12)) for _ in range(1000)]
    single = [" ".join(str(rng.randrange(10)) for _ in range(40)) for _ in range(300)]
    tables = [" ".join(f"{rng.randrange(10_000):04d}" for _ in range(30)) for _ in range(300)]
    amounts = [f"{rng.randrange(10**6)} {rng.randrange(10**6)}-{rng.randrange(10**5)} {rng.randrange(10**9)}" for _ in range(1000)]
    assert sum(bool([x for x in p.replacements(t, KEY) if x[0] in ("card", "iban")]) for t in short + single + amounts) == 0
    assert sum(bool(p.replacements(t, KEY)) for t in tables) < 20  # two chances in a row of thirty groups, not twenty-seven
    codes = [" ".join(rng.choice(["DE", "FR", "AB", "GB"]) + f"{rng.randrange(100):02d}" for _ in range(8)) for _ in range(500)]
    assert sum(bool(p.replacements(t, KEY)) for t in codes) < 5


def test_long_texts_take_time_in_proportion():
    line = "2024-02-29 97.51.17.173 a.b@example.com 4111 1111 1111 1111 DE89 3704 0044 0532 0130 00 x%y%z 555-123-4567 "
    def took(n):
        start = time.perf_counter()
        assert len(p.replacements(line * n, KEY)) == 6 * n
        return time.perf_counter() - start
    took(50)
    assert took(4000) < 20 * took(400) + 1
    start = time.perf_counter()
    assert p.replacements("7 a%b-" * 300_000 + "1111 " * 300_000, KEY) == []
    assert time.perf_counter() - start < 30


def plain_values(text):
    """Values by trying every span of a text, without patterns: kinds that carry check digits only."""
    out, i = [], 0
    word = lambda c: c.isalnum() or c == "_"
    while i < len(text):
        for j in range(min(len(text), i + 23), i + 12, -1):
            t = text[i:j]
            shape = "".join("9" if c in "0123456789" else "s" if c in " -" else "x" for c in t)
            parts = [len(x) for x in shape.split("s")]
            if "x" in shape or not t[0].isdigit() or not t[-1].isdigit() or parts not in ([4, 4, 4, 4], [4, 4, 4, 4, 3], [4, 6, 5], [4, 6, 4], [len(t)]):
                continue
            d = [int(c) for c in t if c.isdigit()]
            odd, even = d[-1::-2], d[-2::-2]
            if (sum(odd) + sum(x * 2 - 9 * (x > 4) for x in even)) % 10 or not p.issued("".join(map(str, d))):
                continue
            behind = text[j:j + 6] + "    "
            code = behind[0] == "-" and any(behind[1:n].isdigit() and not word(behind[n]) for n in (4, 5))
            if (i and (word(text[i - 1]) or text[i - 1] in ".+-")) or word(behind[0]) or (behind[0] == "-" and not code):
                continue
            out.append((i, j))
            i = j - 1
            break
        i += 1
    return out


def test_cards_against_all_spans():
    rng = random.Random(8)
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice([13, 14, 15, 16, 16, 16, 19])
            body = rng.choice(["4", "51", "34", "36", "62", "7", "99"])
            body += "".join(rng.choices("0123456789", k=n - 1 - len(body)))
            d = body + str((p.luhn(body) + (rng.random() < 0.3)) % 10)
            sep = rng.choice(["", " ", "-"])
            cut = [4, 10] if n in (14, 15) else [4, 8, 12, 16]
            parts.append(sep.join(d[a:b] for a, b in zip([0, *cut], [*cut, n], strict=True) if a < n) if n != 13 else d)
        text = rng.choice([", ", " é ", "\n|"]).join(parts)
        assert [(lo, hi) for k, lo, hi, _ in p.replacements(text, KEY) if k == "card"] == plain_values(text), text


def test_rows(spark):
    rows = [(1, "ip 97.51.17.173 end", "a"), (2, "see 97.51.17.173!", "b"), (2, "see 97.51.17.173!", "b"), (3, None, "c"), (None, "", None)]
    got = p.pseudonymised(spark.createDataFrame(rows, "doc_id long, text string, spans string"), KEY).collect()
    assert len(got) == 5
    new = p.ipv4("97.51.17.173", KEY)
    assert sorted(r["text"] or "" for r in got) == ["", "", f"ip {new} end", f"see {new}!", f"see {new}!"]
    assert [r["text"] for r in got if r["doc_id"] == 3] == [None]
    assert p.pseudonymised(spark.createDataFrame([], "doc_id long, text string"), KEY).collect() == []
