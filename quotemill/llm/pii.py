"""Format-preserving pseudonyms for personal data.

A value is found by its form and accepted only if it is valid: payment cards by their check digit, IBANs by
their remainder, social security numbers, IPv4 addresses and dates by their ranges, phone numbers by their
number of digits; e-mail addresses and assigned secrets by form alone. An accepted value is read as a number,
permuted under a key by a Feistel network over exactly the numbers of its format, and written back in the same
format: separators, letter case, country code and number of digits stay (of an IPv4 address, its four parts), and so does validity (check digits are
worked out again; a result outside the valid range is permuted again). Equal values get equal pseudonyms
in all documents, different ones different pseudonyms, and none keeps its value.

Only the local part of an address is permuted, and letter case does not matter for the link.

* null text: null, nothing found; * empty text: as it is; * very long text: scanned once per kind; * repeated
rows: each rewritten alike; * empty table: empty result; * other columns stay, whatever their names.
Where two findings overlap, the kind that stands first in ``KINDS`` wins.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.llm.common import map_batches, replace_batches

KEY_CONF = "spark.quotemill.pseudonymKey"
TEST_KEY = "a key for tests only"
ROUNDS = 10
# Alphabets in which a character stays: digits, plain letters, Latin-1 letters.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ")
PLACE = {c: (alphabet, i) for alphabet in ALPHABETS for i, c in enumerate(alphabet)}


class Permuter:
    """A keyed permutation without fixed points of the numbers below ``left * right``."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def term(self, tweak: bytes, turn: int, value: int, size: int) -> int:
        data = b"%s|%d|%d" % (tweak, turn, value)
        wide = b"".join(hashlib.blake2b(data + b"|%d" % k, key=self.key).digest() for k in range(size.bit_length() // 384 + 1))
        return int.from_bytes(wide, "big") % size

    def feistel(self, value: int, left: int, right: int, tweak: bytes, back: bool = False) -> int:
        a, b = divmod(value, right)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if turn % 2:
                b = (b + sign * self.term(tweak, turn, a, right)) % right
            else:
                a = (a + sign * self.term(tweak, turn, b, left)) % left
        return a * right + b

    def __call__(self, value: int, left: int, right: int, tweak: str) -> int:
        """The number that follows ``value`` in the order that the Feistel network makes: one cycle through all."""
        raw = tweak.encode()
        step = (self.feistel(value, left, right, raw) + 1) % (left * right)
        return self.feistel(step, left, right, raw, back=True)

    def symbols(self, text: str, tweak: str) -> str:
        """Permute the letters and digits of ``text``; case and all other characters stay."""
        spots = [(i, PLACE[c.lower()]) for i, c in enumerate(text) if c.lower() in PLACE]
        radix = [len(alphabet) for _, (alphabet, _) in spots]
        if not spots:
            return text
        half = len(spots) // 2
        number = 0
        for size, (_, (_, digit)) in zip(radix, spots, strict=True):
            number = number * size + digit
        form = "".join(alphabet[0] for _, (alphabet, _) in spots)
        number = self(number, prod(radix[:half]), prod(radix[half:]), f"{tweak}|{form}")
        out = list(text)
        for i, (alphabet, _) in reversed(spots):
            number, digit = divmod(number, len(alphabet))
            out[i] = alphabet[digit].upper() if text[i] != text[i].lower() else alphabet[digit]
        return "".join(out)

    def digits(self, text: str, tweak: str) -> str:
        """As ``symbols``, for digits alone."""
        spots = [i for i, c in enumerate(text) if c in ALPHABETS[0]]
        new = self.symbols("".join(text[i] for i in spots), tweak)
        out = list(text)
        for i, c in zip(spots, new, strict=True):
            out[i] = c
        return "".join(out)


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in ALPHABETS[0])


def luhn(digits: str) -> int:
    """Zero for a number that ends in its right check digit."""
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def fill(form: str, symbols: str) -> str:
    """``form`` with its letters and digits replaced in turn."""
    turn = iter(symbols)
    return "".join(next(turn) if c.isalnum() else c for c in form)


def card_ok(text: str) -> bool:
    digits = digits_of(text)
    return 13 <= len(digits) <= 19 and luhn(digits) == 0 and len(set(digits)) > 1


def card(text: str, permute: Permuter) -> str:
    body = permute.symbols(digits_of(text)[:-1], "card")
    while len(set(body)) == 1:
        body = permute.symbols(body, "card")
    return fill(text, body + str(-luhn(body + "0") % 10))


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban_ok(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and iban_remainder(plain) == 1


def iban(text: str, permute: Permuter) -> str:
    plain = text.replace(" ", "")
    body = permute.symbols(plain[4:], "iban " + plain[:2])
    check = 98 - iban_remainder(plain[:2] + "00" + body)
    return fill(text, f"{plain[:2]}{check:02d}{body}")


def ssn_ok(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def ssn(text: str, permute: Permuter) -> str:
    text = permute.digits(text, "ssn")
    while not ssn_ok(text):
        text = permute.digits(text, "ssn")
    return text


def phone_ok(text: str) -> bool:
    return 10 <= len(digits_of(text)) <= 15


def phone(text: str, permute: Permuter) -> str:
    country = re.match(r"\+\d{1,3}(?=\D)|", text).end()
    return text[:country] + permute.digits(text[country:], "phone " + text[:country])


def ip_ok(text: str) -> bool:
    return all(int(part) < 256 and str(int(part)) == part for part in text.split("."))


def ip(text: str, permute: Permuter) -> str:
    value = permute(int.from_bytes(bytes(map(int, text.split(".")))), 1 << 16, 1 << 16, "ip")
    return ".".join(map(str, value.to_bytes(4)))


FIRST_DAY, DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()


def date_form(text: str) -> str | None:
    """The format of a valid date; a day first where day and month could be either."""
    for form in ("%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y"):
        try:
            day = dt.datetime.strptime(text, form).date()
        except ValueError:
            continue
        if 0 <= day.toordinal() - FIRST_DAY < DAYS and day.strftime(form) == text:
            return form
    return None


def date(text: str, permute: Permuter) -> str:
    form = date_form(text)
    day = dt.datetime.strptime(text, form).date().toordinal() - FIRST_DAY
    while True:  # again if the number is no day, or its text would be read in another format
        day = permute(day, 256, 288, "date")
        if day < DAYS and date_form(new := dt.date.fromordinal(FIRST_DAY + day).strftime(form)) == form:
            return new


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    valid: Callable[[str], bool]
    pseudonym: Callable[[str, Permuter], str]


NEVER = lambda text: True
KINDS = (
    Kind(
        "secret",
        re.compile(
            r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)["']?\s*[=:]\s*["']?([\w+/.-]{8,}=*)"""
        ),
        NEVER,
        lambda text, permute: permute.symbols(text, "secret"),
    ),
    Kind(
        "email",
        re.compile(r"(?<![\w.+%-])([\w+%-][\w.+%-]*)@[\w-]+(?:\.[\w-]+)+"),
        NEVER,
        lambda text, permute: permute.symbols(text, "email"),
    ),
    Kind("iban", re.compile(r"(?<!\w)([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"), iban_ok, iban),
    Kind("card", re.compile(r"(?<![\w.-])(\d{13,19}|\d{4}([ -])\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![\w-]|\.\d)"), card_ok, card),
    Kind("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])"), ssn_ok, ssn),
    Kind(
        "phone",
        re.compile(
            r"(?<![\w+])((?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}[ .-]\d{4}|(?:\+?1[ .-])?\d{3}[.-]\d{3}[.-]\d{4}"
            r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,12})(?![\w-])"
        ),
        phone_ok,
        phone,
    ),
    Kind("ip", re.compile(r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?!\w|\.\d)"), ip_ok, ip),
    Kind(
        "date",
        re.compile(r"(?<![\w./-])(\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}([./-])\d{2}\2\d{4})(?!\w|[./-]\d)"),
        lambda text: date_form(text) is not None,
        date,
    ),
)
HINT = re.compile(r"[0-9@=:]")


def find(text: str) -> list[tuple[int, int, Kind]]:
    """Spans that hold personal data, in order, none overlapping another."""
    if not text or not HINT.search(text):
        return []
    found: list[tuple[int, int, Kind]] = []
    for kind in KINDS:
        at, new = 0, []  # matches of a kind and what earlier kinds found are both in order
        for match in kind.pattern.finditer(text):
            start, stop = match.span(1)
            while at < len(found) and found[at][1] <= start:
                at += 1
            if kind.valid(match[1]) and (at == len(found) or stop <= found[at][0]):
                new.append((start, stop, kind))
        if new:
            found = sorted(found + new, key=lambda f: f[0])
    return found


def rewrite(text: str, permute: Permuter) -> tuple[str, list[tuple[int, int, Kind]]]:
    found, out, at = find(text), [], 0
    for start, stop, kind in found:
        out += (text[at:start], kind.pseudonym(text[start:stop], permute))
        at = stop
    return ("".join(out) + text[at:] if found else text), found


def key_of(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_CONF, TEST_KEY).encode()


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with the text rewritten, all else as it was."""

    def setup():
        permute = Permuter(key)
        return lambda texts: [text if text is None else rewrite(text, permute)[0] for text in texts]

    return replace_batches(docs, "text", setup)


def findings(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, spans``: the rewritten text and what was found, by character offsets in the old text (only an IPv4 address may change its length)."""
    spans = "array<struct<kind: string, start: int, stop: int>>"

    def setup():
        permute = Permuter(key)

        def work(ids, texts):
            new = [(text, []) if text is None else rewrite(text, permute) for text in texts]
            marks = [[{"kind": k.name, "start": a, "stop": b} for a, b, k in found] for _, found in new]
            return ids, [text for text, _ in new], marks

        return work

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), setup, f"doc_id long, text string, spans {spans}")


def query(docs: DataFrame) -> DataFrame:
    return findings(docs, key_of(docs.sparkSession))
