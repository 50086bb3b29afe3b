"""Format-preserving Feistel pseudonyms for personal data.

Validated values are replaced by a keyed permutation of all values of their
format, so equal values get equal pseudonyms in every document and different
ones different pseudonyms:

* card numbers (13 to 19 digits that pass the Luhn check; separators stay): the
  digits before the check digit are permuted, the check digit is made anew;
* IBANs (mod 97 holds; words that follow are not taken in): letters and digits
  of the account part, check digits anew;
* telephone numbers (+ and 8 to 15 digits, or three groups of a North American
  number, a 1 before them or not): the digits after the country code. A North
  American number is one value in all its spellings, with code 1 or without;
* US social security numbers and IPv4 addresses (not after a word for a
  version): within the valid values of their form;
* dates (year, month, day, or day, month, year, or month, day, year where the day is
  over 12): within their century and their class: a month of one or two digits, a
  day of one digit, up to 12, or over. So padding and order stay as they are,
  different dates stay different, and a date is linked over all its forms.
  Years of two digits (d/m/y) are a form of their own, not linked to the others;
* e-mail addresses: letters and digits of all but the last label; upper and lower
  case are one value, and capitals stay where they are;
* secrets (key, token, secret or password, = or :, then a value; access key ids):
  letters and digits, in blocks of BLOCK characters.

The permutation is a Feistel network over [0, n) with HMAC-SHA256 rounds, walked
until it lands inside the format. Text around values does not change. A value
that would map to itself is walked on once more, so none stays as it was, unless
its class has no other value. Whoever has the key can undo it, so none is built in:
give one, or let session_key() take it from the session's settings.

What is left in clear: numbers that fail their check, e-mail local parts beyond 64
characters, years 0, dates of two-digit years written with dots or dashes.

Null text stays null, an empty one empty. Null and repeated ids and repeated
rows are rows of their own; other columns pass through unchanged (a column of
the report whose name is taken gets an underscore before it). An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import hmac
import re
import secrets
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .storage import small_batches

#: The session's setting that holds the key.
KEY_SETTING = "spark.seawake.pseudonyms.key"
ROUNDS = 8
#: Characters that are permuted at once.
BLOCK = 64
# Country codes of telephone numbers of one and two digits (ITU-T E.164); the others have three.
CODES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Characters of an IBAN by country (ISO 13616 registry); others may have any length from 15 to 34.
IBAN_LENGTHS = {c: n for n, cs in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for c in cs.split()}
_session_keys: dict[str, bytes] = {}
KINDS = ("email", "secret", "iban", "phone", "date", "ip", "ssn", "card")


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's settings name; without one, a random key that lasts as long as the application."""
    named = spark.conf.get(KEY_SETTING, None)
    if named:
        return named.encode()
    return _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def _round(key: bytes, tweak: bytes, i: int, x: int, size: int) -> int:
    data = tweak + b"|%d|" % i + x.to_bytes((x.bit_length() + 7) // 8 or 1, "big")
    out = hmac.new(key, data, hashlib.sha256).digest()
    while len(out) * 8 < size.bit_length() + 64:
        out += hmac.new(key, out, hashlib.sha256).digest()
    return int.from_bytes(out, "big") % size


def permute(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of [0, n), or its inverse: an unbalanced Feistel network on a * b >= n, walked into range."""
    if n < 2:
        return x
    a = 1 << ((n - 1).bit_length() + 1) // 2
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        if back:
            for i in range(ROUNDS - 2, -1, -2):
                right = (right - _round(key, tweak, i + 1, left, b)) % b
                left = (left - _round(key, tweak, i, right, a)) % a
        else:
            for i in range(0, ROUNDS, 2):
                left = (left + _round(key, tweak, i, right, a)) % a
                right = (right + _round(key, tweak, i + 1, left, b)) % b
        x = left * b + right
        if x < n:
            return x


def changed(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation without fixed points: into permuted order, a keyed step on, and back by the inverse."""
    if n < 2:
        return x
    step = 1 + _round(key, tweak + b"|step", 0, n, n - 1)
    return permute((permute(x, n, key, tweak) + step) % n, n, key, tweak, back=True)


def _symbols(text: str, hexadecimal: bool = False) -> list[tuple[str, str]]:
    """(character, its alphabet) of what may change."""
    out = []
    for c in text:
        for alphabet in ("0123456789abcdef" if hexadecimal else "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            if c in alphabet:
                out.append((c, alphabet))
                break
        else:
            out.append((c, ""))
    return out


def scramble(text: str, key: bytes, tweak: bytes, hexadecimal: bool = False) -> str:
    """Permute text among all texts with the same pattern of digits and letters, a block at a time."""
    return "".join(_scrambled(text[lo : lo + BLOCK], key, tweak + b"|%d" % lo if lo else tweak, hexadecimal) for lo in range(0, len(text), BLOCK))


def _scrambled(text: str, key: bytes, tweak: bytes, hexadecimal: bool) -> str:
    symbols = _symbols(text, hexadecimal)
    x, n = 0, 1
    for c, alphabet in symbols:
        if alphabet:
            x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
    pattern = "".join(a[-1] if a else c for c, a in symbols)
    y = changed(x, n, key, tweak + b"|" + pattern.encode())
    out = []
    for c, alphabet in reversed(symbols):
        if alphabet:
            y, at = divmod(y, len(alphabet))
            c = alphabet[at]
        out.append(c)
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """Sum modulo 10 of a number with its check digit."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def _refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
        return None
    body = scramble(digits[:-1], key, b"card")
    return _refill(m[0], body + str(-luhn(body + "0") % 10))


def _shorter(form: str) -> Iterator[str]:
    """form, then what is left of it as its last groups are taken off."""
    yield form
    for gap in reversed([x.start() for x in re.finditer(r"(?<=[A-Z0-9)])[ .-]", form)]):
        yield form[:gap]


def _iban(m: re.Match, key: bytes) -> tuple[str, str] | None:
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    for form in _shorter(m[0]):  # the last groups may be words that follow
        value = form.replace(" ", "")
        if len(value) != IBAN_LENGTHS.get(value[:2], len(value)) or not 15 <= len(value) <= 34 or number(value[4:] + value[:4]) % 97 != 1:
            continue
        body = scramble(value[4:], key, b"iban" + value[:2].encode())
        new = value[:2] + f"{98 - number(body + value[:2] + '00') % 97:02d}" + body
        rest = iter(new)
        return form, "".join(c if c == " " else next(rest) for c in form)
    return None


def _national(digits: str, code: str, key: bytes) -> str:
    """Pseudonym of a number without its country code; a valid North American number stays one."""
    if code == "1" and len(digits) == 10 and digits[0] > "1" and digits[3] > "1":
        n = int(digits)
        area, office, line = n // 10**7 - 200, n // 10**4 % 1000 - 200, n % 10**4
        y, line = divmod(changed((area * 800 + office) * 10**4 + line, 800 * 800 * 10**4, key, b"phone1"), 10**4)
        return f"{y // 800 + 200}{y % 800 + 200}{line:04d}"
    return scramble(digits, key, b"phone" + code.encode())


def _phone(m: re.Match, key: bytes) -> tuple[str, str] | None:
    for form in _shorter(m[0]):
        digits = re.sub(r"\D", "", form)
        if not form.startswith("+"):
            code, shown = "1", len(digits) == 11
        elif not 8 <= len(digits) <= 15:
            continue
        else:
            code, shown = next((c for c in CODES if digits.startswith(c)), digits[:3]), True
        rest = digits[len(code) :] if shown else digits
        return form, _refill(form, (code if shown else "") + _national(rest, code, key))
    return None


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if any(p > 255 for p in parts) or _VERSION.search(m.string[max(0, m.start() - 12) : m.start()]):
        return None
    y = changed(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, y.to_bytes(4, "big")))


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    if area in (0, 666) or area > 899 or not group or not serial:
        return None
    at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    y = changed(at, 898 * 99 * 9999, key, b"ssn")
    y, serial = divmod(y, 9999)
    area, group = divmod(y, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


_classes: dict[tuple, list[tuple[int, int, int]]] = {}


def _class(y: int, mo: int, d: int) -> tuple:
    """What a pseudonym shares with its date: century, width of the month, and whether the day has one digit, could be a month, or neither."""
    return y // 100, mo > 9, (d > 9) + (d > 12)


def _dates(century: int) -> None:
    day, end = datetime.date(max(1, century * 100), 1, 1), century * 100 + 99
    while day.year <= end:
        _classes.setdefault(_class(day.year, day.month, day.day), []).append((day.year, day.month, day.day))
        if (day.year, day.month, day.day) == (9999, 12, 31):
            break
        day += datetime.timedelta(1)


def _date(m: re.Match, key: bytes) -> str | None:
    a, mark, b, c = m["a"], m["mark"], m["b"], m["c"]
    year_first = len(a) == 4
    if year_first == (len(c) == 4) and not (mark == "/" and len(a) < 3 and len(c) == 2):
        return None
    y, mo, d = (int(a), int(b), int(c)) if year_first else (int(c), int(b), int(a))
    month_first = not year_first and mo > 12 >= d
    if month_first:
        mo, d = d, mo
    short = not year_first and len(c) == 2
    y += 2000 * short
    try:
        datetime.date(y, mo, d)
    except ValueError:
        return None
    of = _class(y, mo, d)
    if of not in _classes:
        _dates(of[0])
    same = _classes[of]
    tweak = b"date%d|%d|%d|%d" % (short, *of)
    y, mo, d = same[changed(bisect.bisect_left(same, (y, mo, d)), len(same), key, tweak)]
    new = (f"{y:04d}", mo, d) if year_first else (mo, d) if month_first else (d, mo)
    parts = [x if isinstance(x, str) else f"{x:0{len(old)}d}" for x, old in zip(new, (a, b, c), strict=False)]
    return mark.join(parts if year_first else [*parts, f"{y % 100:02d}" if short else f"{y:04d}"])


def _email(m: re.Match, key: bytes) -> str | None:
    head, last = m[0].rsplit(".", 1)
    new = scramble(head.lower(), key, b"email")
    return "".join(x.upper() if old.isupper() else x for x, old in zip(new, head, strict=True)) + f".{last}"


def _secret(m: re.Match, key: bytes) -> str | None:
    kind = next(k for k in ("value", "bare", "id") if m[k] is not None)
    value, at = m[kind], m.start(kind) - m.start()
    if len(set(value)) < 4:
        return None
    return m[0][:at] + scramble(value, key, b"secret", bool(re.fullmatch(r"[0-9a-f]+", value))) + m[0][at + len(value) :]


#: Where an address may end before its @, and what follows it.
_LOCAL, _DOMAIN = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}\Z"), re.compile(r"@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,9}\.[A-Za-z]{2,63}")
_SECRET = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key)[\"']?\s{0,9}[:=]\s{0,9}(?:(?P<quote>[\"'])(?P<value>[A-Za-z0-9+/=_.-]{8,})(?P=quote)|(?P<bare>(?=[A-Za-z_+/=-]{0,255}\d)[A-Za-z0-9+/=_-]{8,}))|(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<id>[A-Z0-9]{16})(?![A-Za-z0-9])")
#: What begins with a digit, a plus or a country code is looked at only where a digit stands.
_NUMBER = re.compile(
    r"(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.+-])(?:1[ .-])?(?:[2-9]\d{2}[ .-]|\([2-9]\d{2}\)[ .-]?)[2-9]\d{2}[ .-]\d{4}(?![\w-]))"
    r"|(?<!\d)(?P<date>(?P<a>\d{4}|\d{1,2})(?P<mark>[-/.])(?P<b>\d{1,2})(?P=mark)(?P<c>\d{4}|\d{1,2}))(?![\d]|[./-]\d)"
    r"|(?<![\d.])(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\d|\.\d)"
    r"|(?<![\d-])(?P<ssn>\d{3}-\d{2}-\d{4})(?![\d-])"
    r"|(?<!\d)(?P<card>\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}(?P<gap2>[ -])\d{6}(?P=gap2)\d{4,5})(?!\d)"
)
_DIGIT = re.compile(r"\d")
_VERSION = re.compile(r"(?i)\b(?:v|ver|vers|version|release|rev|revision|build)[.:]?\s?\Z")


class _Addresses:
    """search() as of a pattern, in time that a long run of letters does not square."""

    @staticmethod
    def search(text: str, at: int = 0) -> re.Match | None:
        sign = text.find("@", at)
        while sign >= 0:
            after = _DOMAIN.match(text, sign)
            before = after and _LOCAL.search(text[max(at, sign - 64) : sign])
            if before:
                return _WHOLE.match(text, sign - len(before[0]), after.end())
            sign = text.find("@", sign + 1)
        return None


_WHOLE = re.compile(r"(?s).+")
_MAKERS: dict[str, Callable] = {"iban": _iban, "phone": _phone, "date": _date, "ip": _ip, "ssn": _ssn, "card": _card}


def pseudonymize(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many of each kind."""
    counts: dict[str, int] = {}

    def put(kind: str, make: Callable) -> Callable:
        def one(m: re.Match) -> tuple[str, str]:
            """The value, which may end before the match does, and its pseudonym; twice the match if there is no value."""
            name = kind or next(k for k in _MAKERS if m[k] is not None)
            new = (make or _MAKERS[name])(m, key)
            if new is None:
                return m[0], m[0]
            counts[name] = counts.get(name, 0) + 1
            return new if isinstance(new, tuple) else (m[0], new)

        return one

    # Each pass leaves alone what an earlier one has made.
    parts = [(text, True)]
    for kind, pattern, make, mark in (("email", _Addresses, _email, "@"), ("secret", _SECRET, _secret, "secret"), ("", _NUMBER, None, "")):
        if mark == "@" and "@" not in text or len(mark) > 1 and "=" not in text and ":" not in text and "AKIA" not in text and "ASIA" not in text:
            continue
        after = []
        for part, free in parts:
            if not free or (not mark and not _DIGIT.search(part)):
                after.append((part, free))
                continue
            at, one = 0, put(kind, make)
            m = pattern.search(part)
            while m:
                old, new = one(m)
                if new != old:
                    after += [(part[at : m.start()], True), (new, False)]
                    at = m.start() + len(old)
                m = pattern.search(part, at if new != old else m.start() + 1)
            after.append((part[at:], True))
        parts = after
    return "".join(p for p, _ in parts), counts


def _masked(key: bytes, report: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text in batch["text"].to_pylist():
                new, n = (None, {}) if text is None else pseudonymize(text, key)
                texts.append(new)
                counts.append(n)
            columns = [x if c != "text" else pa.array(texts, pa.string()) for c, x in zip(batch.schema.names, batch.columns, strict=True)]
            if report:
                columns += [pa.array([n.get(k, 0) for n in counts], pa.int32()) for k in KINDS]
            yield pa.record_batch(columns, names=[*batch.schema.names, *report])

    return run


def pseudonymize_documents(docs: DataFrame, key: bytes, report: bool = False) -> DataFrame:
    """docs with pseudonyms in text; report adds the number of values of each kind (n_email, ...)."""
    if not key:
        raise ValueError("pseudonyms need a key")
    small_batches(docs.sparkSession)
    have, names = {c.lower() for c in docs.columns}, []
    for k in KINDS if report else ():
        name = f"n_{k}"
        while name in have:
            name = f"_{name}"
        names.append(name)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + "".join(f", {n} int" for n in names)
    return docs.mapInArrow(_masked(key, names), schema)
