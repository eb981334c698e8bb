"""Private values to keyed pseudonyms of the same format: Feistel permutations of the values of each format."""

from __future__ import annotations

import re
from bisect import bisect_left
from datetime import date, timedelta
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
DIGITS, LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"
HEX, CAPITALS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<access>(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    r"|(?P<secret>(?<![0-9A-Za-z])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,64}(?![0-9A-Za-z]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
    r"|(?P<iso>(?<!\d)\d{4}-\d{2}-\d{2}(?!\d))"
    r"|(?P<day>(?<![\d./])\d{1,2}(?P<mark>[./])\d{1,2}(?P=mark)\d{4}(?![\d./]))"
    r"|(?P<ip>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<!\d)(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))"
    r"|(?P<intl>(?<![\w+])\+[1-9](?:[ .-]?(?:\(\d{1,4}\)|\d)){4,14}(?!\d))"
    r"|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<wide>[ -])\d{6}(?P=wide)\d{5})(?!\d))")

IBAN_LENGTHS = {country: int(length) for length, countries in {
    "15": "NO", "16": "BE", "18": "DK FI FK FO GL NL SD", "19": "MK SI", "20": "AT BA EE KZ LT LU MN XK", "21": "CH HR LI LV",
    "22": "BG BH CR DE GB GE IE ME RS VA", "23": "AE GI IL IQ OM SO TL", "24": "AD CZ ES MD PK RO SA SE SK TN VG",
    "25": "LY PT ST", "26": "IS TR", "27": "BI DJ FR GR IT MC MR SM", "28": "AL AZ BY CY DO GT HU LB NI PL SV",
    "29": "BR EG PS QA UA", "30": "JO KW MU YE", "31": "MT SC", "32": "LC", "33": "RU"}.items() for country in countries.split()}

COUNTRY_CODES = set("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 "
                    "91 92 93 94 95 98".split())  # all others have three digits
NUMBER_LENGTHS = {"1": 10, "7": 10, "27": 9, "30": 10, "31": 9, "33": 9, "34": 9, "40": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9,
                  "52": 10, "61": 9, "90": 10, "91": 10, "351": 9, "420": 9, "421": 9}  # digits behind the code, where nearly all have as many

TRUNK = re.compile(r"[ .-]?\(0\)")

KINDS = [k for k in PATTERN.groupindex if k not in ("mark", "gap", "wide")]


class Permutation:
    """Keyed permutations of range(n): balanced Feistel rounds over the next even number of bits, walked into range."""

    def __init__(self, key: bytes, rounds: int = 10):
        self.key, self.rounds = key, rounds
        self.cached = lru_cache(100_000)(self._permuted)

    def __call__(self, kind: str, n: int, value: int) -> int:
        return self.cached(kind, n, value)

    def _round(self, kind: str, n: int, r: int, half: int, x: int) -> int:
        data = f"{kind}|{n}|{r}|{x}".encode()
        return int.from_bytes(blake2b(data, key=self.key, digest_size=32).digest(), "little") & ((1 << half) - 1)

    def _permuted(self, kind: str, n: int, value: int) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in range(self.rounds):
                left, right = right, left ^ self._round(kind, n, r, half, right)
            value = left << half | right
            if value < n:
                return value

    def inverse(self, kind: str, n: int, value: int) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for r in reversed(range(self.rounds)):
                left, right = right ^ self._round(kind, n, r, half, left), left
            value = left << half | right
            if value < n:
                return value


def _alphabet(c: str) -> str:
    return next((a for a in (DIGITS, LETTERS, CAPITALS) if c in a), c)


def permuted_text(kind: str, value: str, permute, alphabet=_alphabet) -> str:
    """A value of the same format: each digit stays a digit, each letter a letter of its case, all else as it is."""
    sets = [alphabet(c) for c in value]
    number, total = 0, 1
    for c, s in zip(value, sets):
        number, total = number * len(s) + s.index(c), total * len(s)
    if total == 1:
        return value
    shape = "".join("0" if s == DIGITS else s[:1] for s in sets)
    n = permute(f"{kind}:{shape}", total, number)
    out = []
    for s in reversed(sets):
        n, k = divmod(n, len(s))
        out.append(s[k])
    return "".join(reversed(out))


def luhn_digit(digits: str) -> str:
    """The check digit that makes ``digits`` + check digit pass."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _refill(shape: str, characters: str) -> str:
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _date(year: int, month: int, day: int) -> date | None:
    try:
        found = date(year, month, day)
    except ValueError:
        return None
    return found if FIRST_DAY <= found <= LAST_DAY else None


_DAYS = [FIRST_DAY + timedelta(i) for i in range((LAST_DAY - FIRST_DAY).days + 1)]
DAYS = {late: [d for d in _DAYS if (d.day > 12) == late] for late in (False, True)}


def _moved(found: date, permute) -> date:
    """Another date; behind the 12th of a month only if ``found`` is, so that a day/month date stays one and can go back."""
    days = DAYS[found.day > 12]
    return days[permute(f"date{int(found.day > 12)}", len(days), bisect_left(days, found))]


def _country_code(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in COUNTRY_CODES), digits[:3])


def _intl(value: str, permute) -> str | None:
    """The pseudonym of a number with + and country code, which stays as a (0) behind it does."""
    plain = "".join(c for c in value if c.isdigit())
    code, i, seen = _country_code(plain), 0, 0
    while seen < len(code):
        i, seen = i + 1, seen + value[i].isdigit()
    trunk = TRUNK.match(value, i)
    i = trunk.end() if trunk else i
    rest = "".join(c for c in value[i:] if c.isdigit())
    if not 8 <= len(code + rest) <= 15:
        return None
    kind = "phone" if code == "1" and len(rest) == 10 else f"phone{code}"
    return value[:i] + _refill(value[i:], permuted_text(kind, rest, permute))


def pseudonym(kind: str, value: str, permute) -> str | None:
    """The pseudonym of a value, or None if it is not valid in its format.

    Equal values have equal pseudonyms in any spelling of separators. Dates with slashes are month/day, and day/month where
    that is not a day; the order stays. Pseudonyms are valid in turn (check digits,
    octets, calendar days from 1900 to 2099).
    """
    plain = "".join(c for c in value if c.isalnum())
    if kind == "card":
        if luhn_digit(plain[:-1]) != plain[-1] or len(set(plain)) == 1:
            return None
        body = permuted_text("card", plain[:-1], permute)
        return _refill(value, body + luhn_digit(body))
    if kind == "iban":
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        account = permuted_text(f"iban{plain[:2]}", plain[4:], permute)
        return _refill(value, plain[:2] + iban_check(plain[:2], account) + account)
    if kind == "phone":
        return _refill(value, plain[:-10] + permuted_text("phone", plain[-10:], permute))
    if kind == "intl":
        return _intl(value, permute)
    if kind == "ssn":
        area, group, serial = int(plain[:3]), int(plain[3:5]), int(plain[5:])
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        n = permute("ssn", 898 * 99 * 9999, (area * 99 + group - 1) * 9999 + serial - 1)
        rest, serial = divmod(n, 9999)
        area, group = divmod(rest, 99)
        area += 1
        return _refill(value, f"{area + (area >= 666):03d}{group + 1:02d}{serial + 1:04d}")
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in value.split(".")):
            return None
        n = permute("ip", 1 << 32, int.from_bytes(bytes(octets), "big"))
        return ".".join(str(b) for b in n.to_bytes(4, "big"))
    if kind == "iso":
        found = _date(int(value[:4]), int(value[5:7]), int(value[8:]))
        return found and _moved(found, permute).isoformat()
    if kind == "day":
        mark = "." if "." in value else "/"
        a, b, year = (int(x) for x in value.split(mark))
        by_month = mark == "/" and _date(year, a, b)  # 12/31/1999, else 31.12.1999 or 31/12/1999
        found = by_month or _date(year, b, a)
        if found is None:
            return None
        to = _moved(found, permute)
        first, second = (to.month, to.day) if by_month else (to.day, to.month)
        return f"{first:02d}{mark}{second:02d}{mark}{to.year:04d}"
    if kind == "access":
        return value[:4] + permuted_text("access", value[4:], permute, lambda c: CAPITALS + DIGITS)
    if kind == "secret":
        return permuted_text("secret", value, permute, lambda c: HEX)
    if kind == "email":
        local, _, host = value.partition("@")
        return permuted_text("email", local, permute) + "@" + host
    raise ValueError(kind)


def _iban(value: str, permute) -> tuple[str, str] | None:
    """The IBAN that a match begins with, and its pseudonym.

    A match runs on into capitals and digits behind the IBAN. Tried are the beginnings that end before a blank or with the
    match: the one of the country's length, then the whole, and for countries not in the table all, the longest first.
    """
    ends = [i for i, c in enumerate(value) if c == " "] + [len(value)]
    length = IBAN_LENGTHS.get(value[:2])
    tried = [e for e in ends if e - value.count(" ", 0, e) == length] + [len(value)] if length else ends[::-1]
    for end in tried:
        new = pseudonym("iban", value[:end], permute)
        if new is not None:
            return value[:end], new
    return None


def _number(value: str, behind, permute) -> tuple[str, str] | None:
    """The telephone number that a match begins with, and its pseudonym.

    A match runs on into digits behind the number. It ends where it has the country's number of digits, at a blank or the
    match's end, else before a blank with a valid value of another kind ``behind`` it.
    """
    def digits(end):
        return "".join(c for c in value[:end].replace("(0)", "") if c.isdigit())

    blanks, code = [i for i, c in enumerate(value) if c == " "], _country_code(digits(None))
    fits = (e for e in blanks + [len(value)] if len(digits(e)) - len(code) == NUMBER_LENGTHS.get(code))
    value = value[:next(fits, None) or next((e for e in blanks if behind(e + 1)), None)]
    new = pseudonym("intl", value, permute)
    return new and (value, new)


def pseudonymise(text: str, permute) -> tuple[str, int]:
    """The text with every valid value replaced, and how many were."""
    def valid_at(place):
        other = PATTERN.match(text, place)
        kind = other and next(k for k in KINDS if other.group(k) is not None)
        return kind not in (None, "phone") and pseudonym(kind, other.group(), permute) is not None

    if not any(c in text for c in "@0123456789"):
        return text, 0
    out, done, start, found = [], 0, 0, 0
    while match := PATTERN.search(text, start):
        kind = next(k for k in KINDS if match.group(k) is not None)
        value = match.group()
        if kind == "iban":
            value, new = _iban(value, permute) or (value, None)
        elif kind == "intl":
            value, new = _number(value, lambda i: valid_at(match.start() + i), permute) or (value, None)
        else:
            new = pseudonym(kind, value, permute)
        if new is None:  # other values may begin inside the match
            start = match.start() + 1
            continue
        out += [text[done:match.start()], new]
        done = start = match.start() + len(value)
        found += 1
    return "".join(out) + text[done:], found


def pseudonymised(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with private values in ``text`` replaced by keyed pseudonyms, and ``n_values`` replaced ones.

    Card numbers (Luhn), IBANs (check digits), social security numbers, telephone numbers, IPv4 addresses, dates, e-mail
    names, access keys and hexadecimal secrets are found in whole texts; numbers that are not valid in their format
    stay. Telephone numbers are 3-3-4 digits with separators, or + and country code with 8 to 15 digits in all; others
    (5551234567, 0044 20 7946 0958, 020 7946 0958) stay. Dates are numeric, from 1900 to 2099. Each is permuted within its format under ``key``, so equal values stay equal across documents and whoever
    has the key can go back. Null stays null with 0 values; empty texts, repeated rows and other columns are left as they
    are. Rows are rewritten one by one without a shuffle.
    """
    names = docs.columns
    kept = [c for c in names if c != text]
    rows = docs.select(F.col(text).alias("t"), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("s")
                       if kept else F.lit(None).cast("int").alias("s"))
    kind = rows.schema["s"].dataType.simpleString()
    found = rows.mapInArrow(_arrow(key), f"t string, s {kind}, n long")
    out = {c: F.col(f"s.c{i}").alias(c) for i, c in enumerate(kept)} | {text: F.col("t").alias(text)}
    return found.select(*[out[c] for c in names], F.col("n").alias("n_values"))


def _arrow(key: bytes):
    def run(batches):
        permute = Permutation(key)
        for batch in batches:
            done = [(None, 0) if t is None else pseudonymise(t, permute) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in done], pa.string()), batch.column("s"), pa.array([n for _, n in done], pa.int64())],
                names=["t", "s", "n"])
    return run
