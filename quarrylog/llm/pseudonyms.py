"""Format-preserving pseudonyms for personal data and secrets.

Values that a pattern finds and a rule confirms (check digits, calendar, number
ranges) are replaced by others of the same format: a keyed Feistel network
permutes the numbers of that format, and walks on until the result obeys the
format's rules again. Equal values get equal pseudonyms in every document, so
records stay linked; whoever holds the key can undo it (``reverse=True``).

Kinds: private key blocks, assigned secrets, access keys, e-mail addresses,
IBANs (mod 97), payment cards (Luhn), IPv4 addresses, social security numbers,
phone numbers and dates. Separators, letter case and lengths are kept. Numbers
that fail their rule stay as they are.

Texts are read a fixed number of times, however many keywords, key block lines or
signs they hold, so that time grows with their length.

Null texts stay null and empty ones empty; all other columns, ids and repeated
rows are carried through.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
#: Characters permuted as one number.
PIECE = 256
DIGITS, LOWER, UPPER, HEX_LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdef"
EPOCH, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

#: Values of bounded length, and keys that end where their characters do.
PATTERN = re.compile(
    r"(?P<access>(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![\w.,/-])(?:[0-9]{4}(?P<d1>[-/.])[0-9]{1,2}(?P=d1)[0-9]{1,2}|[0-9]{1,2}(?P<d2>[-/.])[0-9]{1,2}(?P=d2)[0-9]{4})(?!(?![Tt][0-9]{2})[\w/-]|[.,][0-9]))"
    r"|(?P<ip>(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9]))"
    r"|(?P<ssn>(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w-]))"
    r"|(?P<card>(?<![\w-])(?:[0-9]{13,19}|[0-9]{4}(?P<c1>[ -])[0-9]{4}(?P=c1)[0-9]{4}(?P=c1)[0-9]{1,7}|[0-9]{4}(?P<c2>[ -])[0-9]{6}(?P=c2)[0-9]{4,5})(?![\w]|-[0-9]))",
    re.DOTALL,
)
BEGIN, END = (re.compile(rf"-----{m} ([A-Z ]*PRIVATE KEY)-----") for m in ("BEGIN", "END"))
KEYWORD = re.compile(r"secret|token|passw(?:or)?d|api[_-]?key|access[_-]?key", re.IGNORECASE)
NAME_REST, ASSIGNS = re.compile(r"\w*"), re.compile(r"[\"']?\s*[:=]\s*")
QUOTED, BARE = re.compile(r"([\"'])([^\"'\s]{6,})\1"), re.compile(r"[A-Za-z0-9_+/=.-]*")
LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN, TOP, AFTER = re.compile(r"[A-Za-z0-9.-]*"), re.compile(r"[A-Za-z]{2,}"), re.compile(r"[\w@]")
#: Without one of these a text holds nothing that PATTERN finds.
HINT = re.compile(r"[0-9@]|PRIVATE KEY|AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza|(?i:secret|token|passw|key)")


def blocks(text: str) -> Iterator[tuple[int, int, int]]:
    """Where private key blocks begin and end: from each opening line to the first closing line of its label."""
    ends: dict[str, list[tuple[int, int]]] = {}
    for m in END.finditer(text):
        ends.setdefault(m[1], []).append(m.span())
    for m in BEGIN.finditer(text) if ends else ():
        found = ends.get(m[1], [])
        i = bisect_left(found, (m.end(), 0))
        if i < len(found):
            yield m.start(), m.start(), found[i][1]


def emails(text: str) -> Iterator[tuple[int, int, int]]:
    """Where e-mail addresses begin and end: each @ is looked at once, between those next to it."""
    before, at = 0, text.find("@")
    while at >= 0:
        local = text[before:at]
        local = local[len(local.rstrip(LOCAL)) :].lstrip("._%+-")
        run = DOMAIN.match(text, at + 1)
        if local and run.end() > at + 1 and (end := domain_end(text, at + 1, run.end())):
            yield at - len(local), at - len(local), end
        before, at = at + 1, text.find("@", at + 1)


def domain_end(text: str, begin: int, end: int) -> int | None:
    """The end of the longest host name (labels and a top-level domain of letters) that begins here."""
    place, best = begin, None
    for i, label in enumerate(text[begin:end].split(".")):
        if i and (m := TOP.match(label)):
            after = place + m.end()
            if m.end() < len(label) and label[m.end()] == "-" or m.end() == len(label) and not AFTER.match(text, after):
                best = after
        if not label or label[0] == "-" or label[-1] == "-":
            break
        place += len(label) + 1
    return best


def assigned_values(text: str) -> Iterator[tuple[int, int, int]]:
    """Names that hold a keyword and are given a value: where they begin, and the value. Each name and each run of value characters is read once."""
    name_end = run_end = -1
    digit = -1  # the last digit of the run
    for m in KEYWORD.finditer(text):
        if m.end() <= name_end:
            continue
        name_end = NAME_REST.match(text, m.end()).end()
        mark = ASSIGNS.match(text, name_end)
        if not mark:
            continue
        at = mark.end()
        if q := QUOTED.match(text, at):
            yield m.start(), *q.span(2)
            continue
        if at >= run_end:
            run_end = BARE.match(text, at).end()
            digit = max((text.rfind(d, at, run_end) for d in DIGITS), default=-1)
        if digit >= at:
            end = at + len(text[at:run_end].rstrip(".-"))
            if end - at >= 8:
                yield m.start(), at, end


class Feistel:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, bound: int) -> int:
        size = (bound.bit_length() + 64) // 8 + 1
        data = tweak + b"|%d|%d" % (i, value)
        out, n = b"", 0
        while len(out) < size:
            out += hashlib.blake2b(data, key=self.key, salt=b"%d" % n).digest()
            n += 1
        return int.from_bytes(out[:size], "big") % bound

    def permute(self, value: int, bound: int, tweak: str, fits: Callable[[int], bool] | None = None, reverse: bool = False) -> int:
        """The value's image (or preimage) below ``bound``, among the numbers that ``fits`` accepts."""
        if bound < 2:
            return value
        a = math.isqrt(bound - 1) + 1
        b = -(-bound // a)
        t = f"{tweak}|{bound}".encode()
        while True:
            left, right = divmod(value, b)
            for i in reversed(range(ROUNDS)) if reverse else range(ROUNDS):
                sign = -1 if reverse else 1
                if i % 2:
                    right = (right + sign * self._round(t, i, left, b)) % b
                else:
                    left = (left + sign * self._round(t, i, right, a)) % a
            value = left * b + right
            if value < bound and (fits is None or fits(value)):
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that completes a number."""
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in shape)


class Pseudonyms:
    """Replaces what PATTERN finds in a text."""

    def __init__(self, key: bytes, reverse: bool = False):
        self.feistel, self.reverse = Feistel(key), reverse
        self.known: dict[tuple[str, str], str | None] = {}

    def _permute(self, value: int, bound: int, tweak: str, fits=None) -> int:
        return self.feistel.permute(value, bound, tweak, fits, self.reverse)

    def letters(self, text: str, tweak: str, fold: bool = False) -> str:
        """Permute letters and digits among those of their class; other characters stay.

        With fold, letter case is put aside first and restored afterwards. Longer texts
        than PIECE are permuted piece by piece, each by its own number.
        """
        if len(text) > PIECE:
            return "".join(self.letters(text[i : i + PIECE], f"{tweak}|{i}", fold) for i in range(0, len(text), PIECE))
        plain = text.lower() if fold else text
        small = HEX_LETTERS if len(plain) >= 16 and all(c in DIGITS or c in HEX_LETTERS for c in plain) else LOWER
        classes = [DIGITS if c in DIGITS else small if c in LOWER else UPPER if c in UPPER else None for c in plain]
        value, bound = 0, 1
        for c, k in zip(plain, classes, strict=True):
            if k:
                value, bound = value * len(k) + k.index(c), bound * len(k)
        shape = "".join(k[0] if k else c for c, k in zip(plain, classes, strict=True))
        value, out = self._permute(value, bound, f"{tweak}|{shape}"), []
        for c, k in zip(reversed(plain), reversed(classes), strict=True):
            if k:
                value, i = divmod(value, len(k))
                out.append(k[i])
            else:
                out.append(c)
        out.reverse()
        return "".join(o.upper() if fold and c.isupper() else o for o, c in zip(out, text, strict=True))

    def email(self, text: str) -> str:
        local, _, domain = text.partition("@")
        label, dot, rest = domain.partition(".")
        return f"{self.letters(local, 'local|' + rest.lower(), True)}@{self.letters(label, 'label|' + rest.lower(), True)}{dot}{rest}"

    def card(self, text: str) -> str | None:
        digits = re.sub("[ -]", "", text)
        body, n = digits[:-1], len(digits) - 1
        if luhn_digit(body) != digits[-1] or len(set(digits)) == 1:
            return None
        low = 10 ** (n - 1)
        fits = (lambda v: v >= low) if body[0] != "0" else None
        new = str(self._permute(int(body), 10**n, "card", fits)).zfill(n)
        return refill(text, new + luhn_digit(new))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self.letters(plain[4:], "iban|" + plain[:2])
        new = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(new) for c in text)

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        value = self._permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        def valid(v: int) -> bool:
            area, group, serial = v // 1_000_000, v // 10_000 % 100, v % 10_000
            return 0 < area < 900 and area != 666 and group > 0 and serial > 0

        value = int(text.replace("-", ""))
        return refill(text, f"{self._permute(value, 10**9, 'ssn', valid):09d}") if valid(value) else None

    def phone(self, text: str) -> str | None:
        m = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
        kept = m.end() if m else 1 if text[0] == "+" else 0
        rest = re.sub("[^0-9]", "", text[kept:])
        if not 6 <= len(rest) <= 14:
            return None
        n, low = len(rest), 10 ** (len(rest) - 1)
        fits = (lambda v: v >= low) if rest[0] != "0" else (lambda v: v < low)
        return text[:kept] + refill(text[kept:], f"{self._permute(int(rest), 10**n, 'phone|' + text[:kept], fits):0{n}d}")

    def date(self, text: str) -> str | None:
        a, mark, b, _, c = re.match(r"([0-9]+)(\D)([0-9]+)(\D)([0-9]+)", text).groups()
        year_first = len(a) == 4
        orders = [(a, b, c)] if year_first else [(c, b, a), (c, a, b)]  # day first, or month first if that fails
        for i, (y, m, d) in enumerate(orders):
            try:
                day = datetime.date(int(y), int(m), int(d)).toordinal() - EPOCH
            except ValueError:
                continue
            if not 0 <= day < DAYS:
                return None
            wide = len(a) + len(b) + len(c) == 8

            def fits(v: int, i: int = i, wide: bool = wide) -> bool:
                """Same widths, and still read in the same order."""
                t = datetime.date.fromordinal(EPOCH + v)
                return (i == 0 or t.day > 12) and (wide or shape(t, i) == (len(a), len(b), len(c)))

            def shape(t: datetime.date, i: int) -> tuple[int, int, int]:
                m, d = len(str(t.month)), len(str(t.day))
                return (4, m, d) if year_first else (d, m, 4) if i == 0 else (m, d, 4)

            if not fits(day):
                fits = lambda v, i=i: i == 0 or datetime.date.fromordinal(EPOCH + v).day > 12
            t = datetime.date.fromordinal(EPOCH + self._permute(day, DAYS, f"date|{i}|{wide or (len(a), len(b), len(c))}", fits))
            y, m, d = f"{t.year:04d}", f"{t.month:0{2 if wide else 1}d}", f"{t.day:0{2 if wide else 1}d}"
            return mark.join([y, m, d] if year_first else [d, m, y] if i == 0 else [m, d, y])
        return None

    def access(self, text: str) -> str:
        n = next(len(p) for p in (re.match(r"AKIA|ASIA|gh[pousr]_|sk-|xox[abprs]-|AIza", text)[0],))
        return text[:n] + self.letters(text[n:], "access|" + text[:n])

    def block(self, text: str) -> str:
        head, body, tail = re.match(r"(-----BEGIN [A-Z ]+-----)(.*)(-----END [A-Z ]+-----)$", text, re.DOTALL).groups()
        return head + "".join(p if p.isspace() else self.letters(p, "block") for p in re.split(r"(\s+)", body)) + tail

    def one(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value; None if it fails its kind's rule."""
        if (kind, text) not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[kind, text] = getattr(self, kind)(text)
        return self.known[kind, text]

    def assigned(self, text: str) -> str:
        return self.letters(text, "assigned")

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind."""
        found: dict[str, int] = {}
        if not HINT.search(text):
            return text, found

        special = [(begin, order, kind, span) for order, (kind, find) in enumerate(FINDERS) for begin, *span in find(text)]
        special.sort()
        out, done, i, m = [], 0, 0, PATTERN.search(text)
        while m or i < len(special):
            # the leftmost first; at one place a block or an address goes before an access key, and that before an assigned value
            if i < len(special) and (m is None or special[i][0] < m.start() or special[i][0] == m.start() and special[i][1] < 2):
                begin, _, kind, (first, end) = special[i]
                i += 1
                if begin < done:
                    continue
                new = self.one(kind, text[first:end])
            else:
                kind, (first, end) = m.lastgroup, m.span()
                new = self.one(kind, text[first:end])
                while new is None and kind == "iban" and (blank := text.rfind(" ", first, end)) > 0:
                    end = blank  # words that follow may be no part of it
                    new = self.one(kind, text[first:end])
                if new is None:  # fails its rule: other values may begin within it
                    m = PATTERN.search(text, first + 1)
                    continue
            out += [text[done:first], new]
            done = end
            found[kind] = found.get(kind, 0) + 1
            if m and m.start() < done:
                m = PATTERN.search(text, done)
        return "".join([*out, text[done:]]), found


FINDERS = (("block", blocks), ("email", emails), ("assigned", assigned_values))


def pseudonymise(docs: DataFrame, key: str, reverse: bool = False, found: str | None = None) -> DataFrame:
    """docs with its column text rewritten under a secret key.

    ``found`` names a further column: a JSON object of the numbers by kind. It takes
    the place of a column of docs with that name.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    if found:
        docs = docs.select(*(f"`{c}`" for c in docs.columns if c.lower() != found.lower()))
    names = docs.columns
    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + (f", `{found}` string" if found else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pseudonyms(key.encode(), reverse)
        for big in batches:
            for i in range(0, big.num_rows, 500):
                batch = big.slice(i, 500)
                at = names.index("text")
                done = [work.replace(t) if t is not None else (None, {}) for t in batch.column(at).to_pylist()]
                cols = list(batch.columns)
                cols[at] = pa.array([t for t, _ in done], pa.string())
                if found:
                    cols.append(pa.array([json.dumps(n, sort_keys=True) for _, n in done], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, found] if found else names)

    return docs.mapInArrow(run, kinds)
