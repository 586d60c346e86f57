"""Personal data: validated numbers and dates keyed-permuted within their format by a Feistel network."""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
KINDS = ("email", "iban", "card", "phone", "ssn", "ipv4", "date")

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
LETTERS = "abcdefghijklmnopqrstuvwxyz"

PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", re.A),
    "phone": re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-]|\.\d)", re.A),
    "ssn": re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)", re.A),
    "ipv4": re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", re.A),
    "date": re.compile(r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\w-]|\.\d)", re.A),
}

#: First digits of card issuers, lowest and highest, with the lengths of their numbers.
ISSUERS = (
    ("4", "4", (13, 16, 19)),
    ("51", "55", (16,)),
    ("2221", "2720", (16,)),
    ("34", "34", (15,)),
    ("37", "37", (15,)),
    ("300", "305", (14,)),
    ("36", "36", (14,)),
    ("38", "39", (14,)),
    ("6011", "6011", (16, 19)),
    ("644", "659", (16, 19)),
    ("3528", "3589", (16, 19)),
    ("62", "62", (16, 17, 18, 19)),
)

#: Length of a bank account number by its country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def permuted(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): a balanced Feistel network over enough bits, walked until it is in range."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            seen = hashlib.blake2b(f"{tweak}:{size}:{i}:{right}".encode(), key=key[:64], digest_size=16).digest()
            left, right = right, left ^ (int.from_bytes(seen, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def refilled(shape: str, symbols: str, chosen: Callable[[str], bool]) -> str:
    """``shape`` with its chosen characters replaced by ``symbols`` in turn: separators stay where they are."""
    it = iter(symbols)
    return "".join(next(it) if chosen(c) else c for c in shape)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def is_digit(c: str) -> bool:
    return c in "0123456789"


def issued(digits: str) -> bool:
    """Whether an issuer gives out card numbers with these first digits and this length."""
    return any(len(digits) in sizes and lo <= digits[:len(lo)] <= hi for lo, hi, sizes in ISSUERS)


def card(text: str, key: bytes) -> str | None:
    """Another number with a valid check digit that some issuer gives out."""
    d = digits_of(text)
    if not issued(d) or luhn(d[:-1]) != int(d[-1]):
        return None
    n, size = int(d[:-1]), 10 ** (len(d) - 1)
    while True:  # walking on keeps it a permutation of the valid numbers
        n = permuted(n, size, key, "card")
        body = str(n).zfill(len(d) - 1)
        if issued(body + "0"):
            return refilled(text, body + str(luhn(body)), is_digit)


def iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def iban(text: str, key: bytes) -> str | None:
    code = text.replace(" ", "")
    if len(code) != IBAN_LENGTH.get(code[:2]) or iban_rest(code) != 1:
        return None
    account = code[4:]
    d = digits_of(account)
    if not d:
        return None
    account = refilled(account, str(permuted(int(d), 10 ** len(d), key, f"iban{code[:2]}")).zfill(len(d)), is_digit)
    check = 98 - iban_rest(code[:2] + "00" + account)
    return refilled(text, f"{code[:2]}{check:02d}{account}", lambda c: c != " ")


def phone(text: str, key: bytes) -> str | None:
    """The ten digits after the country code, which stays."""
    d = digits_of(text)
    code, own = d[:-10], d[-10:]
    return refilled(text, code + str(permuted(int(own), 10**10, key, "phone")).zfill(10), is_digit)


def valid_ssn(n: int) -> bool:
    area, group, serial = n // 10**6, n // 10**4 % 100, n % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(text: str, key: bytes) -> str | None:
    n = int(digits_of(text))
    if not valid_ssn(n):
        return None
    n = permuted(n, 10**9, key, "ssn")
    while not valid_ssn(n):  # walking on keeps it a permutation of the valid numbers
        n = permuted(n, 10**9, key, "ssn")
    return refilled(text, f"{n:09d}", is_digit)


def ipv4(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    n = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ipv4")
    return ".".join(map(str, n.to_bytes(4, "big")))


def date(text: str, key: bytes) -> str | None:
    """Real days of the years 1900 to 2099; a slashed day is read day first, or month first if it must be."""
    first = text[:4].isdigit()
    parts = [int(x) for x in re.split(r"[./-]", text)]
    orders = [(0, 1, 2)] if first else [(2, 1, 0), (2, 0, 1)] if "/" in text else [(2, 1, 0)]
    for order in orders:
        try:
            day = datetime.date(*[parts[i] for i in order]).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            to = datetime.date.fromordinal(FIRST_DAY + permuted(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date"))
            new = [0, 0, 0]
            for i, x in zip(order, (to.year, to.month, to.day), strict=True):
                new[i] = x
            return refilled(text, "".join(f"{x:04d}" if x > 31 else f"{x:02d}" for x in new), is_digit)
    return None


def email(text: str, key: bytes) -> str:
    """Letters of the local part among letters (each keeps its case), digits among digits; the host stays."""
    local, host = text.rsplit("@", 1)
    letters, d = "".join(c.lower() for c in local if c.isalpha()), digits_of(local)
    n = 0
    for c in letters:
        n = n * 26 + LETTERS.index(c)
    tweak = f"email:{host.lower()}:{len(letters)}:{len(d)}"
    # Letters and digits are one number, so that equal letters with other digits don't look alike.
    value = permuted(n * 10 ** len(d) + int(d or 0), 26 ** len(letters) * 10 ** len(d), key, tweak)
    n, rest = divmod(value, 10 ** len(d))
    out = []
    for _ in letters:
        n, r = divmod(n, 26)
        out.append(LETTERS[r])
    new = refilled(local, "".join(reversed(out)), str.isalpha)
    new = refilled(new, str(rest).zfill(len(d)) if d else "", is_digit)
    return "".join(c.upper() if o.isupper() else c for c, o in zip(new, local, strict=True)) + "@" + host


PERMUTE: dict[str, Callable[[str, bytes], str | None]] = {
    "email": email, "iban": iban, "card": card, "phone": phone, "ssn": ssn, "ipv4": ipv4, "date": date}

MAYBE = re.compile(r"[0-9@]")

#: Where a card number may begin, and its usual layouts; a code of three or four digits may stand behind a dash.
CARD_START = re.compile(r"(?<![\w.+-])\d{4}(?=[ -]?\d)", re.A)
CARD_LAYOUTS = [re.compile(layout + r"(?!\w|\.\d|-(?!\d{3,4}(?!\w)))", re.A) for layout in (
    r"\d{13,19}", r"\d{4}(?:[ -]\d{4}){3}[ -]\d{3}", r"\d{4}(?:[ -]\d{4}){3}", r"\d{4}[ -]\d{6}[ -]\d{5}", r"\d{4}[ -]\d{6}[ -]\d{4}")]
FOUR_BEFORE = re.compile(r"(?:\W|^)\d{4}[ -]$", re.A)
FOUR_BEHIND = re.compile(r"[ -]\d{4}(?!\w)", re.A)

IBAN_START = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?= ?[A-Z0-9])", re.A)
IBAN_LAYOUT = {n: re.compile(rf"(?:[A-Z0-9]{{{n}}}|[A-Z0-9]{{4}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}{f' [A-Z0-9]{{{n % 4}}}' if n % 4 else ''})(?!\w)", re.A)
               for n in set(IBAN_LENGTH.values())}


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Spans laid out like card numbers. In a row of groups of four digits only those at its ends count, so tables of numbers stay."""
    for m in CARD_START.finditer(text):
        lo = m.start()
        inside = FOUR_BEFORE.search(text[max(0, lo - 6):lo])
        for layout in CARD_LAYOUTS:
            c = layout.match(text, lo)
            if c and not (inside and FOUR_BEHIND.match(text, c.end())):
                yield c.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans with a country's letters and length, unspaced or in groups of four."""
    for m in IBAN_START.finditer(text):
        size = IBAN_LENGTH.get(m[0][:2])
        if size and (c := IBAN_LAYOUT[size].match(text, m.start())):
            yield c.span()


def candidates(kind: str, text: str) -> Iterator[tuple[int, int]]:
    if kind in PATTERNS:
        return (m.span() for m in PATTERNS[kind].finditer(text))
    return cards(text) if kind == "card" else ibans(text)


def replacements(text: str | None, key: bytes) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of validated values, leftmost first; of overlapping ones the first kind listed wins.

    Time grows in proportion to the text: every candidate is held against its two neighbours among the values found.
    """
    if not text or not MAYBE.search(text):
        return []
    out: list[tuple[str, int, int, str]] = []
    starts: list[int] = []
    for kind in KINDS:
        fresh, end = [], 0
        for lo, hi in candidates(kind, text):
            i = bisect_left(starts, lo)
            free = lo >= end and (i == len(starts) or hi <= starts[i]) and (i == 0 or out[i - 1][2] <= lo)
            if free and (new := PERMUTE[kind](text[lo:hi], key)) is not None:
                fresh.append((kind, lo, hi, new))
                end = hi
        if fresh:
            out = sorted(out + fresh, key=lambda x: x[1])
            starts = [x[1] for x in out]
    return out


def pseudonymised(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, spans): every row's whole text with pseudonyms in place, and what was replaced where.

    Equal values get equal pseudonyms in every document, so they stay linked; the key alone undoes that. A null text
    stays null, repeated rows are replaced alike, other columns are left out. Offsets count code points of the original text.
    Card numbers need an issuer's first digits and length, account numbers their country's length, besides the check digits.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for t in b.column(1).to_pylist():
                found, at, parts = replacements(t, key), 0, []
                for _, lo, hi, new in found:
                    parts += [t[at:lo], new]
                    at = hi
                texts.append("".join([*parts, t[at:]]) if found else t)
                spans.append([{"kind": k, "start": lo, "end": hi} for k, lo, hi, _ in found])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))], ["doc_id", "text", "spans"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(scan, f"doc_id {kind}, text string, spans array<struct<kind:string,start:int,end:int>>")
