"""Format-preserving pseudonyms for personal values, by keyed Feistel permutations.

A value counts if it is valid, not only if it looks right: card numbers by their check digit, bank
accounts by theirs, telephone and social security numbers by their reserved ranges, addresses of
machines by theirs, dates by the calendar. A valid value is permuted among all valid values of its
format: the same value gives the same pseudonym in every document, two values never share one, and
separators, lengths and check digits stay right. Mail addresses and secrets are permuted letter for
letter within the same classes of characters. No character is taken twice: where a secret holds another
value, that value is changed as it is anywhere, and the rest of the secret around it. Cards and accounts are looked for in whole runs of numbers
and capitals, from each group of characters to each end, so that what stands beside a value does not hide it.

Defined results: a null text stays null and an empty one empty; repeated rows are changed alike; a
text without values is returned as it is.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import lean

ROUNDS = 8
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DIGITS, UPPER, LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Shapes of the values that are looked for.
CARDS = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,}(?![\w-]|\.\d)")
ISSUED = re.compile(
    r"4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]|2[2-7])\d{14}|3[47]\d{13}|3(?:0[0-5]|[689]\d)\d{11}|(?:6\d|35)\d{14,17}")
IBANS = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,}(?!\w)")
IBAN_START = re.compile(r"(?<!\w)[A-Z]{2}\d{2}")
# Length of an account number by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27,
    "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28,
    "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23,
    "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25,
    "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18,
    "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33,
    "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25, "SV": 28,
    "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)")
ABROAD = re.compile(r"(?<![\w+])\+[2-9]\d{0,2}(?:[ ./-]?\(?\d{1,5}\)?){2,6}(?!\w)")
IPV4 = re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)")
ISO_DATE = re.compile(r"(?<![\w-])(?P<y>\d{4})-(?P<m>\d{2})-(?P<d>\d{2})(?![\w-])")
DOT_DATE = re.compile(r"(?<![\w.])(?P<d>\d{2})\.(?P<m>\d{2})\.(?P<y>\d{4})(?![\w]|\.\d)")
SLASH_DATE = re.compile(r"(?<![\w/])(?P<m>\d{2})/(?P<d>\d{2})/(?P<y>\d{4})(?![\w/])")
MAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
KEY = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})(?![A-Za-z0-9])")
ASSIGNED = re.compile(
    r"(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s*[:=]\s*[\"']?(?P<v>[A-Za-z0-9+/_.-]{6,})")


class Feistel:
    """Keyed permutation of 0 .. size-1, by cycle walking inside the next product of two powers of two."""

    def __init__(self, key: bytes, tweak: str, size: int):
        bits = max(2, (size - 1).bit_length())
        self.size, self.low = size, bits // 2
        self.high = bits - self.low
        self.mac = hmac.new(key, f"{tweak}|{size}".encode(), "sha256")

    def _mix(self, turn: int, value: int) -> int:
        mac = self.mac.copy()
        mac.update(turn.to_bytes(1, "big") + value.to_bytes(40, "big"))
        return int.from_bytes(mac.digest() * 2, "big")

    def __call__(self, value: int) -> int:
        while True:
            left, right = value >> self.low, value & ((1 << self.low) - 1)
            for turn in range(0, ROUNDS, 2):  # each half in turn is masked by the other
                left ^= self._mix(turn, right) & ((1 << self.high) - 1)
                right ^= self._mix(turn + 1, left) & ((1 << self.low) - 1)
            value = left << self.low | right
            if value < self.size:
                return value


def refill(shape: str, chars: Iterator[str], replaced: Callable[[str], bool]) -> str:
    return "".join(next(chars) if replaced(c) else c for c in shape)


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = sum(sum(divmod(int(d) * (2 if k % 2 == 0 else 1), 10)) for k, d in enumerate(reversed(digits)))
    return -total % 10


def mod97(account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account)) % 97


def free(taken: set[int], start: int, end: int) -> Iterator[tuple[int, int]]:
    """Runs of places that are not taken."""
    for is_taken, run in groupby(range(start, end), taken.__contains__):
        if not is_taken:
            places = list(run)
            yield places[0], places[-1] + 1


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key
        self.permutation = lru_cache(maxsize=4096)(lambda kind, size: Feistel(self.key, kind, size))
        self.kinds = [("key", KEY, self.secret), ("secret", ASSIGNED, self.secret), ("email", MAIL, self.mail),
                      ("iban", IBANS, self.iban), ("card", CARDS, self.card), ("ssn", SSN, self.ssn),
                      ("phone", PHONE, self.phone), ("phone", ABROAD, self.abroad), ("ip", IPV4, self.ip),
                      ("date", ISO_DATE, self.date), ("date", DOT_DATE, self.date), ("date", SLASH_DATE, self.date)]

    def digits(self, kind: str, value: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        """Digits permuted among all strings of their length that are valid."""
        permute, size = self.permutation(kind, 10 ** len(value)), len(value)
        while True:
            value = str(permute(int(value))).zfill(size)
            if valid(value):
                return value

    def letters(self, kind: str, value: str) -> str:
        """Each letter or digit replaced by one of its class, all of them permuted as one number."""
        bases = [DIGITS if c in DIGITS else UPPER if c in UPPER else LOWER if c in LOWER else c for c in value]
        number, size = 0, 1
        for c, base in zip(value, bases):
            number, size = number * len(base) + base.index(c), size * len(base)
        if size < 2 or size.bit_length() > 300:  # long ones in halves
            half = len(value) // 2
            return value if size < 2 else self.letters(kind, value[:half]) + self.letters(kind, value[half:])
        number, out = self.permutation(f"{kind}|{''.join(b[0] for b in bases)}", size)(number), []
        for base in reversed(bases):
            number, k = divmod(number, len(base))
            out.append(base[k])
        return "".join(reversed(out))

    def secret(self, m: re.Match) -> str:
        if "v" not in m.re.groupindex:
            value, cut = m[0], 4  # the first characters tell the kind of key
            return value[:cut] + self.letters("secret", value[cut:])
        start = m.start("v") - m.start()
        return m[0][:start] + self.letters("secret", m["v"])

    def mail(self, m: re.Match) -> str:
        """The name and the first label of the host; what follows is kept."""
        name, host = m[0].split("@")
        first, dot, rest = host.partition(".")
        if "." not in rest:  # the label under a top level stays as well
            return self.letters("mail", name) + "@" + host
        mixed = self.letters("mail", f"{name}@{first}")
        return mixed + dot + rest

    def ibans(self, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        """Places of possible accounts in a run, those of their country's length first."""
        out = []
        for m in IBAN_START.finditer(text, lo, hi):
            known, n = IBAN_LENGTH.get(m[0][:2]), 0
            for at in range(m.start(), hi):
                n += text[at] != " "
                if n > 34:
                    break
                if n >= 15 and text[at] != " " and (at + 1 == hi or text[at + 1] == " "):
                    if n == known or known is None or (m.start(), at + 1) == (lo, hi):
                        out.append((n != known, m.start(), -n, at + 1))
        return [(start, end) for _, start, _, end in sorted(out)]

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self.letters("iban", plain[4:])
        check = 98 - mod97(body + plain[:2] + "00")
        return refill(value, iter(plain[:2] + f"{check:02d}" + body), str.isalnum)

    def cards(self, text: str, lo: int, hi: int) -> list[tuple[int, int]]:
        """Places of possible cards in a run: those an issuer gives out first, then those parted as cards
        are, then the longest. A card has one kind of separator."""
        groups = [m.span() for m in re.compile("[0-9]+").finditer(text, lo, hi)]
        out = []
        for k, (start, _) in enumerate(groups):
            plain, sizes, signs = "", [], set()
            for j, (first, end) in enumerate(groups[k:], k):
                if sizes:
                    signs.add(text[groups[j - 1][1] : first])
                plain, sizes = plain + text[first:end], [*sizes, end - first]
                if len(plain) > 19 or len(signs) > 1:
                    break
                issued = ISSUED.fullmatch(plain) is not None
                usual = len(sizes) == 1 or set(sizes[:-1]) == {4} and sizes[-1] <= 4 or sizes[:2] == [4, 6]
                # numbers of few digits in a row are a table rather than a card
                if len(plain) >= 13 and (min(sizes) >= (2 if issued else 3) or (start, end) == (lo, hi)):
                    out.append((not issued, not usual, -len(plain), start, end))
        return [(start, end) for _, _, _, start, end in sorted(out)]

    def card(self, value: str) -> str | None:
        plain = re.sub(r"\D", "", value)
        if luhn(plain[:-1]) != int(plain[-1]) or len(set(plain)) == 1:
            return None
        body = plain[0] + self.digits("card", plain[1:-1])
        return refill(value, iter(body + str(luhn(body))), str.isdigit)

    def ssn(self, m: re.Match) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        plain = m[0].replace("-", "")
        return refill(m[0], iter(self.digits("ssn", plain, valid)), str.isdigit) if valid(plain) else None

    def phone(self, m: re.Match) -> str | None:
        valid = lambda d: d[0] >= "2" and d[3] >= "2"
        plain = re.sub(r"\D", "", m[0])
        head, body = plain[:-10], plain[-10:]
        return refill(m[0], iter(head + self.digits("phone", body, valid)), str.isdigit) if valid(body) else None

    def abroad(self, m: re.Match) -> str | None:
        plain = re.sub(r"\D", "", m[0])
        if not 8 <= len(plain) <= 15:
            return None
        return refill(m[0], iter(plain[:2] + self.digits(f"abroad{plain[:2]}", plain[2:])), str.isdigit)

    def ip(self, m: re.Match) -> str | None:
        """Permuted among the addresses whose four numbers have as many digits."""
        parts = m[0].split(".")
        valid = lambda p: 0 < p[0] < 224 and p[0] != 127
        ranges = [((0, 10), (10, 90), (100, 156))[len(p) - 1] for p in parts]
        if any(int(p) > 255 or str(int(p)) != p for p in parts) or not valid([int(p) for p in parts]):
            return None
        number, size = 0, 1
        for part, (least, count) in zip(parts, ranges):
            number, size = number * count + int(part) - least, size * count
        permute = self.permutation(f"ip{[least for least, _ in ranges]}", size)
        while True:
            number, new = permute(number), []
            rest = number
            for least, count in reversed(ranges):
                rest, k = divmod(rest, count)
                new.append(least + k)
            if valid(new[::-1]):
                return ".".join(map(str, new[::-1]))

    def date(self, m: re.Match) -> str | None:
        """With slashes the month is first, or the day where that is no date."""
        dates = [("y", "m", "d"), ("y", "d", "m")] if m.re is SLASH_DATE else [("y", "m", "d")]
        for names in dates:
            try:
                old = date(*[int(m[name]) for name in names])
                break
            except ValueError:
                continue
        else:
            return None
        if not FIRST_DAY <= old <= LAST_DAY:
            return None
        permute = self.permutation("date", (LAST_DAY - FIRST_DAY).days + 1)
        number = permute((old - FIRST_DAY).days)
        while names != dates[0] and (FIRST_DAY + timedelta(days=number)).day <= 12:  # stays day-first
            number = permute(number)
        new = FIRST_DAY + timedelta(days=number)
        out = list(m[0])
        for name, value in zip(names, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")):
            out[m.start(name) - m.start() : m.end(name) - m.start()] = value
        return "".join(out)

    def replace(self, text: str) -> tuple[str, list[dict]]:
        """The text with pseudonyms, and what was replaced: kind, start and end (the same in both texts)."""
        digit = re.search("[0-9]", text) is not None
        may = {"email": "@" in text, "secret": "=" in text or ":" in text,
               "key": any(sign in text for sign in ("AKIA", "sk-", "xox", "_"))}
        found: list[tuple[int, int, str, str]] = []
        taken: set[int] = set()
        runs = {"iban": self.ibans, "card": self.cards}
        for kind, pattern, change in self.kinds:
            if not may.get(kind, digit):  # a character the pattern needs is not there
                continue
            for m in pattern.finditer(text):
                if kind in runs:
                    for start, end in runs[kind](text, *m.span()):
                        if taken.isdisjoint(range(start, end)) and (new := change(text[start:end])) is not None:
                            found.append((start, end, kind, new))
                            taken.update(range(start, end))
                    continue
                if not taken.isdisjoint(range(*m.span())):
                    if kind == "secret":  # another value stands in it: what is left of it is a secret still
                        for start, end in free(taken, *m.span("v")):
                            found.append((start, end, kind, self.letters("secret", text[start:end])))
                            taken.update(range(start, end))
                    continue
                new = change(m)
                if new is not None:
                    found.append((m.start(), m.end(), kind, new))
                    taken.update(range(m.start(), m.end()))
        found.sort()
        out, at = [], 0
        for start, end, _, new in found:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), [{"kind": k, "start": s, "end": e} for s, e, k, _ in found]


def pseudonymised(text: Column, key: bytes) -> Column:
    """Struct of the new ``text`` and of what was ``found`` in the old one."""
    @F.arrow_udf("struct<text: string, found: array<struct<kind: string, start: int, end: int>>>")
    @lean
    def replace_values(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = Pseudonyms(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            texts, found = [], []
            for value in batch:
                new, places = names.replace(value.as_py()) if value.is_valid else (None, [])
                texts.append(new)
                found.append(places)
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(found, kind)], names=["text", "found"])

    return replace_values(text)


def pseudonyms(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and found of every document."""
    return docs.select("doc_id", pseudonymised(F.col("text"), key).alias("p")).select(
        "doc_id", F.col("p.text").alias("text"), F.size("p.found").cast("long").alias("n_found"),
        F.col("p.found").alias("found"))
