"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Each validated value is mapped by a keyed permutation of the set of all values of its format:
a Feistel network over the format's index, walked until the result is in the set again. Equal
values get equal pseudonyms in every document and every task, without any table of them; the
key's owner can reverse the mapping.
"""

from __future__ import annotations

import datetime as dt
import functools
import hashlib
import re
import string
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 8
#: Key for tests and for the query; production passes its own.
DEMO_KEY = b"jobloom demonstration key"
#: Pseudonyms that a task remembers before it starts anew.
MEMO = 100_000


def permute(x: int, size: int, key: bytes, domain: str, inverse: bool = False) -> int:
    """Keyed permutation of range(size): a Feistel network, repeated until inside the range."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    tag = f"{domain}:{size:x}:".encode()
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)

    def turn(i: int, v: int) -> int:
        digest = hashlib.blake2b(tag + b"%d:" % i + v.to_bytes(width), key=key[:64]).digest()
        return int.from_bytes(digest if width <= 64 else hashlib.shake_256(digest).digest(width)) & mask

    while True:
        left, right = x >> half, x & mask
        for i in order:
            left, right = (right ^ turn(i, left), left) if inverse else (right, left ^ turn(i, right))
        x = left << half | right
        if x < size:
            return x


def moved(x: int, size: int, key: bytes, domain: str, inverse: bool = False) -> int:
    """Keyed permutation of range(size) that moves every element: one long cycle, in an order that the key decides."""
    if size < 2:
        return x
    place = permute(x, size, key, domain, inverse=True)
    return permute((place + (-1 if inverse else 1)) % size, size, key, domain)


def luhn_digit(body: str) -> str:
    """The check digit for a string of digits."""
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """shape with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


def _digits(text: str, key: bytes, domain: str, inverse: bool) -> str:
    """A string of decimal digits of the same length."""
    return str(moved(int(text), 10 ** len(text), key, f"{domain}{len(text)}", inverse)).zfill(len(text))


def card(text: str, key: bytes, inverse: bool = False) -> str | None:
    """13 to 19 digits with a valid Luhn digit -> others, also valid; separators stay."""
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = _digits(d[:-1], key, "card", inverse)
    return _refill(text, body + luhn_digit(body))


def iban(text: str, key: bytes, inverse: bool = False) -> str | None:
    """Country and check digits, then 11 to 30 letters or digits: valid mod 97 before and after."""
    flat = text.replace(" ", "")

    def rest(x: str) -> int:
        return int("".join(str(int(c, 36)) for c in x)) % 97

    if rest(flat[4:] + flat[:4]) != 1:
        return None
    country, body = flat[:2], flat[4:]
    at = [i for i, c in enumerate(body) if c.isdigit()]
    new = list(body)
    if at:
        for i, c in zip(at, _digits("".join(body[i] for i in at), key, "iban" + country, inverse), strict=True):
            new[i] = c
    body = "".join(new) if at else _letters(body, key, "iban" + country, inverse)
    flat = f"{country}{98 - rest(body + country + '00'):02d}{body}"
    it = iter(flat)
    return re.sub(r"[^ ]", lambda _: next(it), text)


def ssn(text: str, key: bytes, inverse: bool = False) -> str | None:
    """Three, two and four digits, no group all zero, area neither 666 nor from 900 on."""
    a, b, c = map(int, text.split("-"))
    if not (0 < a < 900 and a != 666 and b and c):
        return None
    x = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    x = moved(x, 898 * 99 * 9999, key, "ssn", inverse)
    x, c = divmod(x, 9999)
    a, b = divmod(x, 99)
    a += 1
    return f"{a + (a >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


#: Country codes of two digits. 1 and 7 have one, all others three.
TWO_DIGIT_CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
HOME_CODE = "1"


def phone(text: str, key: bytes, inverse: bool = False) -> str | None:
    """A country code, which stays, and 7 to 14 digits; without a code it is that of North America.

    Equal numbers link however they are spelled, with the code or, there, without it.
    """
    d = re.sub(r"\D", "", text)
    code = "" if text[0] != "+" else d[:1] if d[:1] in ("1", "7") else d[:2] if d[:2] in TWO_DIGIT_CODES else d[:3]
    own = d[len(code) :]
    if not 7 <= len(own) <= 14:
        return None
    return _refill(text, code + _digits(own, key, "phone+" + (code or HOME_CODE), inverse))


def ipv4(text: str, key: bytes, inverse: bool = False) -> str | None:
    """Four numbers up to 255, without leading zeros."""
    parts = text.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = moved(int.from_bytes(bytes(map(int, parts))), 1 << 32, key, "ipv4", inverse)
    return ".".join(map(str, x.to_bytes(4)))


#: Dates are permuted among the days of these years.
FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def date(text: str, key: bytes, inverse: bool = False) -> str | None:
    """A real day of 1900 to 2099: year first, or year last (day before month; else month before day).

    Equal days link within one of the three orders, whatever the separator, and not from one to another.
    """
    sep = re.search(r"\D", text)[0]
    parts = text.split(sep)
    orders = ["ymd"] if len(parts[0]) == 4 else ["dmy", "mdy"]
    for order in orders:
        v = dict(zip(order, map(int, parts), strict=True))
        try:
            x = dt.date(v["y"], v["m"], v["d"]).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= x < DAYS:
            return None
        # a day that both orders could read stays among those, so that it reads back alike
        def ambiguous(d: dt.date) -> bool:
            return d.day <= 12

        while True:
            x = moved(x, DAYS, key, "date" + order, inverse)
            day = dt.date.fromordinal(FIRST_DAY + x)
            if order != "mdy" or not ambiguous(day):
                break
        of = {"y": f"{day.year:04d}", "m": f"{day.month:02d}", "d": f"{day.day:02d}"}
        return sep.join(of[c] for c in order)
    return None


@functools.cache
def _class(c: str) -> str:
    """The characters that one may become: of its kind and near it in Unicode; empty where it stays."""
    if c.isascii():
        return next((x for x in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in x), "")
    low, kind = ord(c) & ~0x3F, unicodedata.category(c)
    near = "".join(x for x in map(chr, range(low, low + 64)) if unicodedata.category(x) == kind and unicodedata.normalize("NFC", x) == x)
    return near if c.isalnum() and c in near else ""


def _letters(text: str, key: bytes, domain: str, inverse: bool) -> str | None:
    """Letters and digits are permuted among strings of the same classes; other characters stay. None where nothing can change."""
    size, x, classes = 1, 0, [_class(c) for c in text]
    for c, among in zip(text, classes, strict=True):
        if among:
            size, x = size * len(among), x * len(among) + among.index(c)
    if size < 2:
        return None
    x = moved(x, size, key, domain + "".join(among[:1] or c for c, among in zip(text, classes, strict=True)), inverse)
    out = []
    for c, among in zip(reversed(text), reversed(classes), strict=True):
        if among:
            x, d = divmod(x, len(among))
            c = among[d]
        out.append(c)
    return "".join(reversed(out))


#: Characters of a local part that are permuted together; it may have any number of them.
LOCAL_PART = 64


def email(text: str, key: bytes, inverse: bool = False) -> str | None:
    """The local part is permuted, letters among letters and digits among digits; the domain stays."""
    local, _, host = text.rpartition("@")
    parts = [local[i : i + LOCAL_PART] for i in range(0, len(local), LOCAL_PART)]
    new = [_letters(x, key, f"email{i or ''}", inverse) for i, x in enumerate(parts)]
    return None if not any(new) else "".join(y or x for x, y in zip(parts, new, strict=True)) + f"@{host}"


def secret(text: str, key: bytes, inverse: bool = False) -> str | None:
    """Hexadecimal keys of 32 digits or more, of one case, with a digit and a letter."""
    if text.isdigit() or text.isalpha():
        return None
    new = f"{moved(int(text, 16), 16 ** len(text), key, 'hex%d' % len(text), inverse):0{len(text)}x}"
    return new.upper() if text.isupper() else new


#: Kind -> what may be one, and the function that validates and maps it. The first that is valid at a place counts.
KINDS: dict[str, tuple[str, Callable[[str, bytes, bool], str | None]]] = {
    "email": (r"(?<![\w.+%-])[^\W_][\w.+%'-]*@(?:[^\W_](?:[^\W_]|-){0,62}\.){1,8}[^\W\d_]{2,24}(?![\w-])", email),
    "secret": (r"(?<!\w)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?!\w)", secret),
    "iban": (r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", iban),
    "ipv4": (r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", ipv4),
    "date": (r"(?<![\w./-])(?:\d{4}(?P<s>[-/.])\d{2}(?P=s)\d{2}|\d{2}(?P<t>[-/.])\d{2}(?P=t)\d{4})(?!(?!T\d)\w|[-/.]\d)", date),
    "ssn": (r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)", ssn),
    "card": (r"(?:(?<![\w.+-])|(?<=\d-))\d(?:[ -]?\d){12,18}(?!\w|\.\d)", card),
    "phone": (r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", phone),
}
PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, (p, _) in KINDS.items()))
ALONE = {k: re.compile(p) for k, (p, _) in KINDS.items()}
NEEDED = re.compile(r"[\d@]")
#: Digits of the groups that cards are printed in, besides a single group.
LAYOUTS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), (4, 4, 4, 1), (4, 4, 4, 2), (4, 4, 4, 3), (4, 4, 4, 4, 1), (4, 4, 4, 4, 2), (4, 4, 4, 4, 3), (6, 13)}
#: Characters of an IBAN, by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27,
    "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: A year after a telephone number that is long enough without it.
YEAR = re.compile(r" (?:19|20)\d\d$")
GROUP, FIRST = re.compile(r"\w+"), re.compile(r"\W*\w+")


def _printed(text: str) -> list[int]:
    """Where a card in one of the printed layouts may end, the shortest first: text after it is a CVV or a date."""
    groups = list(GROUP.finditer(text))
    sizes = tuple(len(g[0]) for g in groups)
    return [g.end() for i, g in enumerate(groups, 1) if (i == 1 and 13 <= sizes[0] <= 19) or sizes[:i] in LAYOUTS]


def _ends(kind: str, text: str) -> list[int]:
    """Ends of what may be the value within a candidate, in the order of trial: it may have swallowed what follows."""
    if kind not in ("card", "iban", "phone"):
        return [len(text)]
    edges = [g.end() for g in GROUP.finditer(text)][::-1]
    if kind == "iban":
        edges = [e for e in edges if e == len(text) or len(text[:e].replace(" ", "")) >= 15]
        return sorted(edges, key=lambda e: len(text[:e].replace(" ", "")) != IBAN_LENGTH.get(text[:2]))
    if kind == "phone":
        year = YEAR.search(text)
        return edges[1:] + edges[:1] if year and len(re.sub(r"\D", "", text[: year.start()])) >= 10 else edges
    # groups of no printed layout are no card by chance as often, so a part of them has to begin like a bank's
    printed = _printed(text)
    return printed + [e for e in edges if e not in printed and (e == len(text) or text[0] in "23456")]


def _mapped(kind: str, text: str, key: bytes) -> str | None:
    """The pseudonym of a value in whatever digits it is written: validated as ASCII digits, and written in its own again."""
    zero = next((ord(c) - unicodedata.decimal(c) for c in text if c.isdecimal()), 48)
    if zero == 48 or kind in ("email", "secret", "iban"):
        return KINDS[kind][1](text, key, False)
    new = KINDS[kind][1]("".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text), key, False)
    return new and "".join(chr(zero + int(c)) if c in string.digits else c for c in new)


def _valid(kind: str, text: str, key: bytes) -> tuple[int, str] | None:
    """The length and the pseudonym of the valid value that a candidate begins with."""
    for end in _ends(kind, text):
        if (new := _mapped(kind, text[:end], key)) is not None:
            return end, new
    return None


def _printed_card(text: str, at: int) -> bool:
    """Whether a valid card in a printed layout begins at a place of text."""
    m = ALONE["card"].match(text, at)
    return bool(m) and any(_mapped("card", m[0][:e], b"") for e in _printed(m[0]))


def _card_inside(text: str, start: int, stop: int) -> bool:
    """Whether such a card begins at a later group of text[start:stop]; it may go on past stop."""
    return any(_printed_card(text, g.start()) for g in list(GROUP.finditer(text, start, stop))[1:])


def _before_others(text: str, start: int, stop: int) -> int:
    """stop, or where a valid value of another kind begins in a phone number's candidate, without the separator.

    The first such place counts that leaves a valid number before it, or else the first.
    """
    cuts = []
    for g in list(GROUP.finditer(text, start, stop))[1:]:
        for kind, pattern in ALONE.items():
            if kind == "card":
                other = _printed_card(text, g.start())
            else:
                other = kind != "phone" and (m := pattern.match(text, g.start())) and _valid(kind, m[0], b"")
            if other:
                cuts.append(start + len(text[start : g.start()].rstrip(" .-(")))
                break
    return next((c for c in cuts if _mapped("phone", text[start:c], b"")), (cuts or [stop])[0])


def pseudonymise(text: str | None, key: bytes, memo: dict | None = None) -> tuple[str | None, list[tuple[str, str]]]:
    """The text with every validated value replaced, and (kind, pseudonym) of each in order.

    Where a candidate isn't valid as a whole, its beginnings that end with a group are tried, then
    the other kinds at that place; the search goes on after its first group.
    """
    if not text or not NEEDED.search(text):
        return text, []
    memo = {} if memo is None else memo
    found: list[tuple[str, str]] = []

    def value(kind: str, start: int, old: str) -> tuple[int, str] | None:
        if (kind, old) not in memo:
            if len(memo) >= MEMO:
                memo.clear()
            memo[kind, old] = _valid(kind, old, key)
        got = memo[kind, old]
        # digits before a card, and some of its own, may be valid by chance
        if got and kind == "card" and got[0] not in _printed(old) and _card_inside(text, start, start + got[0]):
            return None
        return got

    parts, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        start = m.start()
        for kind, pattern in ALONE.items():
            if one := pattern.match(text, start):
                stop = _before_others(text, start, one.end()) if kind == "phone" else one.end()
                if got := value(kind, start, text[start:stop]):
                    break
        else:
            got = None
        if got:
            parts += [text[done:start], got[1]]
            found.append((kind, got[1]))
            done = at = start + got[0]
        else:
            at = FIRST.match(text, start).end()
    return "".join([*parts, text[done:]]), found


def pii_pseudonyms(df: DataFrame, key: bytes = DEMO_KEY, text_col: str = "text") -> DataFrame:
    """df with its texts pseudonymised and pii, the array of (kind, pseudonym) found in each.

    Texts are read whole. A null or empty text stays as it is and has an empty array; equal rows
    have equal results. A value that is reported has changed. Values that fail
    validation (a wrong check digit, a day that doesn't exist) stay as they are. Other columns
    pass through; a column named pii is replaced. An empty df gives no rows. No shuffle.
    """
    rest = [c for c in df.columns if c != "pii"]
    at = rest.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            texts, lists = [], []
            for x in batch.column(at):
                text, found = pseudonymise(x.as_py(), key, memo)
                texts.append(text)
                lists.append([{"kind": k, "pseudonym": v} for k, v in found])
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lists, kind)], [*batch.schema.names, "pii"])

    plain = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in rest))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{types}, pii array<struct<kind: string, pseudonym: string>>")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents pseudonymised: the text, the number of values replaced, and what they became."""
    got = pii_pseudonyms(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", F.size("pii").cast("bigint").alias("n_replaced"), "text", "pii")
