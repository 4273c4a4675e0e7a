"""Personal data: format-preserving Feistel pseudonyms.

Found and replaced, each keeping its punctuation and kind and, but for named months and the parts of IPv4 addresses, its
length:

* card numbers: 13 to 19 digits (blanks or hyphens between groups) that pass the Luhn check; where further digits follow,
  a part of them in the usual groups (4-4-4-4, 4-4-4-4-3, 4-6-5, 4-6-4);
* telephone numbers: ``+`` and 7 to 15 digits, a bracketed area code and at least 10 digits in all, or the North American
  groups 3-3-4 with one separator;
* IPv4 addresses with four parts of 0 to 255;
* dates: year first or year last with a real calendar day between 1900 and 2099, before a time of day too, and days
  with an English month name (``12 March 2024``, ``Mar 12, 2024``);
* IBANs that pass the mod-97 check;
* US social security numbers ``ddd-dd-dddd`` of an assigned range;
* e-mail addresses (local part and host are permuted; the top-level domain stays);
* secrets: access-key ids of the form AKIA + 16, and hexadecimal strings of 32 or more characters.

A value is brought to a canonical form (its digits, its day number, its bytes), permuted by a keyed balanced Feistel
network over exactly the set of valid values of its format (cycle walking re-enters the set), and written back
into the original punctuation. So equal values get equal pseudonyms across documents, however they were spaced,
different values never collide, no value stays as it is, and the holder of the key can invert the mapping.

The key is a parameter. Queries and the pipeline take it from the session's setting ``KEY_SETTING``; where that is unset
they make a random one and set it, so pseudonyms are linked within the session and nobody else can invert them.

Each text is rewritten in its own task; nothing is shuffled and nothing but the key is shared.

Defined results: a null text stays null and an empty one empty, with no findings; rows are rewritten one by one, so
repeated rows stay repeated; texts of any length are rewritten whole; other columns pass through ``pseudonymize``.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
import secrets
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scrubline.llm import common, worker
from scrubline.sources.tables import spread

ROUNDS = 8
KEY_SETTING = "spark.scrubline.pseudonym.key"

_DATE_LOW = datetime.date(1900, 1, 1).toordinal()
_DATE_HIGH = datetime.date(2099, 12, 31).toordinal()
LETTERS, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn_ok(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn_digit(digits[:-1]) == digits[-1]


def iban_check(country: str, body: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country) + '00') % 97:02d}"


class Permuter:
    """Keyed permutations of integer ranges and of strings over alphabets."""

    def __init__(self, key: bytes):
        self.key = key
        self.memo: dict[tuple, str] = {}

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        data = tweak + bytes([i]) + half.to_bytes((bits + 7) // 8 or 1, "big")
        digest = hashlib.blake2b(data, key=self.key[:64], digest_size=min(64, (bits + 7) // 8 + 8)).digest()
        return int.from_bytes(digest, "big") & ((1 << bits) - 1)

    def integer(self, value: int, size: int, tweak: str, inverse: bool = False) -> int:
        """A permutation of range(size): a balanced Feistel network over the next even number of bits, walked until
        it falls inside the range."""
        if size <= 1:
            return value
        bits = ((size - 1).bit_length() + 1) // 2
        mask = (1 << bits) - 1
        label = f"{tweak}:{size}".encode()
        while True:
            left, right = value >> bits, value & mask
            for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
                if inverse:
                    left, right = right ^ self._round(label, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(label, i, right, bits)
            value = (left << bits) | right
            if value < size:
                return value

    def moved(self, value: int, size: int, tweak: str, inverse: bool = False) -> int:
        """A permutation of range(size) that leaves no value in its place: a keyed shift between integer() and its
        inverse."""
        if size <= 1:
            return value
        digest = hashlib.blake2b(f"shift:{tweak}:{size}".encode(), key=self.key[:64], digest_size=32).digest()
        shift = 1 + int.from_bytes(digest, "big") % (size - 1)
        inner = self.integer(value, size, tweak)
        return self.integer((inner + (-shift if inverse else shift)) % size, size, tweak, inverse=True)

    def string(self, text: str, tweak: str) -> str:
        """Letters for letters (case kept), digits for digits, all else as it is."""
        value, size = 0, 1
        for c in text:
            a = LETTERS if c.lower() in LETTERS else DIGITS if c in DIGITS else ""
            if a:
                value, size = value * len(a) + a.index(c.lower()), size * len(a)
        if size == 1:
            return text
        shape = "".join("a" if c.lower() in LETTERS else "0" if c in DIGITS else c for c in text)
        value = self.moved(value, size, f"{tweak}|{shape}")
        out = []
        for c in reversed(text):
            a = LETTERS if c.lower() in LETTERS else DIGITS if c in DIGITS else ""
            if a:
                value, k = divmod(value, len(a))
                out.append(a[k].upper() if c.isupper() else a[k])
            else:
                out.append(c)
        return "".join(reversed(out))


def _refill(original: str, digits: str) -> str:
    """Puts digits into the digit places of original."""
    it = iter(digits)
    return "".join(next(it) if c in DIGITS else c for c in original)


def _only_digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


#: Lengths of the digit groups that card numbers are printed in. Fixed values.
CARD_GROUPS = ((4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4))


def card_parts(m: str) -> list[str]:
    """What else of a run of digit groups could be a card: its first groups, if they are printed as cards are."""
    groups = [(g.start(), g.end()) for g in re.finditer("[0-9]+", m)]
    lengths = tuple(b - a for a, b in groups)
    parts = [m[: groups[len(usual) - 1][1]] for usual in CARD_GROUPS if lengths[: len(usual)] == usual and len(lengths) > len(usual)]
    return sorted(parts, key=len, reverse=True) + ([m[: groups[0][1]]] if len(lengths) > 1 and 13 <= lengths[0] <= 19 else [])


def card(p: Permuter, m: str) -> str | None:
    d = _only_digits(m)
    if not luhn_ok(d):
        return None
    payload = str(p.moved(int(d[:-1]), 10 ** (len(d) - 1), "card")).zfill(len(d) - 1)
    return _refill(m, payload + luhn_digit(payload))


def phone_parts(m: str) -> list[str]:
    """A short group after a long one is the next number in the text, not the end of this one."""
    cut = re.fullmatch("(.*[0-9]{5})[ .-][0-9]{1,2}", m)
    return [cut[1]] if cut else []


def phone(p: Permuter, m: str) -> str | None:
    d = _only_digits(m)
    if not (7 <= len(d) <= 15 and (m[0] == "+" or "(" in m and len(d) >= 10)) or phone_parts(m):
        return None
    keep = 1 if m[0] == "+" else 0  # the leading country digit stays, so the number remains one of its region
    return _refill(m, d[:keep] + str(p.moved(int(d[keep:]), 10 ** (len(d) - keep), f"phone{d[:keep]}")).zfill(len(d) - keep))


def local_phone(p: Permuter, m: str) -> str | None:
    return _refill(m, str(p.moved(int(_only_digits(m)), 10**10, "local phone")).zfill(10))


def ipv4(p: Permuter, m: str) -> str | None:
    parts = [int(x) for x in m.split(".")]
    if max(parts) > 255:
        return None
    v = p.moved(int.from_bytes(bytes(parts), "big"), 1 << 32, "ipv4")
    return ".".join(map(str, v.to_bytes(4, "big")))


def date(p: Permuter, m: str) -> str | None:
    a, sep, b, _, c = re.split("([-/.])", m)
    if len(a) == 4:
        order = "ymd"
    else:
        order = "mdy" if int(a) <= 12 and sep == "/" else "dmy"
    try:
        day = datetime.date(**{{"y": "year", "m": "month", "d": "day"}[k]: int(v) for k, v in zip(order, (a, b, c), strict=True)}).toordinal()
    except ValueError:
        return None
    if not _DATE_LOW <= day <= _DATE_HIGH:
        return None
    new = datetime.date.fromordinal(p.moved(day - _DATE_LOW, _DATE_HIGH - _DATE_LOW + 1, "date") + _DATE_LOW)
    if order == "mdy" and len(a) < 2 or order != "mdy" and min(len(b), len(c) if len(a) == 4 else len(a)) < 2:
        fill = lambda v: str(v)  # noqa: E731  one-digit parts were written without a zero
    else:
        fill = lambda v: f"{v:02d}"
    named = {"y": f"{new.year:04d}", "m": fill(new.month), "d": fill(new.day)}
    return sep.join(named[k] for k in order)


#: Fixed values.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
_MONTH = "|".join(f"{name}|{name[:3]}" for name in MONTHS)
_NAMED = re.compile(rf"(?:(?P<d1>[0-9]{{1,2}}) )?(?P<m>{_MONTH})\.? (?:(?P<d2>[0-9]{{1,2}}),? )?(?P<y>[0-9]{{4}})")


def named_date(p: Permuter, m: str) -> str | None:
    got = _NAMED.fullmatch(m)
    month = next(i for i, name in enumerate(MONTHS) if name[:3] == got["m"][:3])
    which = "d1" if got["d1"] else "d2"
    try:
        day = datetime.date(int(got["y"]), month + 1, int(got[which])).toordinal()
    except ValueError:
        return None
    if not _DATE_LOW <= day <= _DATE_HIGH:
        return None
    new = datetime.date.fromordinal(p.moved(day - _DATE_LOW, _DATE_HIGH - _DATE_LOW + 1, "date") + _DATE_LOW)
    name = MONTHS[new.month - 1]
    values = {which: f"{new.day:02d}" if got[which][0] == "0" else str(new.day), "m": name[:3] if len(got["m"]) == 3 and got["m"] != "May" else name, "y": str(new.year)}
    for group in sorted(values, key=got.start, reverse=True):
        m = m[: got.start(group)] + values[group] + m[got.end(group) :]
    return m


def iban_parts(m: str) -> list[str]:
    """The same without its last groups: what follows an IBAN can look like more of it."""
    ends = [x.start() for x in re.finditer(" ", m)]
    return [m[:e] for e in reversed(ends) if e >= 15]


def iban(p: Permuter, m: str) -> str | None:
    s = m.replace(" ", "")
    if not 15 <= len(s) <= 34 or iban_check(s[:2], s[4:]) != s[2:4]:
        return None
    body = p.string(s[4:], f"iban{s[:2]}")
    it = iter(s[:2] + iban_check(s[:2], body) + body)
    return "".join(" " if c == " " else next(it) for c in m)


def ssn(p: Permuter, m: str) -> str | None:
    a, b, c = (int(x) for x in m.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    v = p.moved((areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999, "ssn")
    v, c = divmod(v, 9999)
    a, b = divmod(v, 99)
    return f"{areas[a]:03d}-{b + 1:02d}-{c + 1:04d}"


def email(p: Permuter, m: str) -> str | None:
    local, host = m.rsplit("@", 1)
    name, top = host.rsplit(".", 1)
    return f"{p.string(local, 'mail')}@{p.string(name, 'host')}.{top}"


def access_key(p: Permuter, m: str) -> str | None:
    return m[:4] + p.string(m[4:], "access")


def secret(p: Permuter, m: str) -> str | None:
    v = p.moved(int(m, 16), 16 ** len(m), "hex")
    out = f"{v:0{len(m)}x}"
    return out.upper() if m.upper() == m and m.lower() != m else out


#: kind, pattern, handler, in order of precedence where two kinds could start at one place. Fixed values.
KINDS = (
    ("email", r"(?<![\w.+-])[\w+-]+(?:\.[\w+-]+)*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])", email),
    ("access_key", r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])", access_key),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", iban),
    ("secret", r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])", secret),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", ipv4),
    ("date", r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?=T[0-9]{2}:|(?![\w/-]|\.[0-9]))", date),
    ("named_date", rf"(?<![\w])(?:[0-9]{{1,2}} (?:{_MONTH})\.?|(?:{_MONTH})\.? [0-9]{{1,2}},?) [0-9]{{4}}(?![\w])", named_date),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", ssn),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![\w])|(?<![\w+])\+[0-9](?:[ .-]?[0-9]){6,14}(?![\w])", phone),
    ("local_phone", r"(?<![\w.+-])[2-9][0-9]{2}([ .-])[2-9][0-9]{2}\1[0-9]{4}(?![\w-]|\.[0-9])", local_phone),
    ("card", r"(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![\w])", card),
)
KIND_NAMES = tuple(k for k, _, _ in KINDS)
_PATTERNS = [(k, re.compile(p), f) for k, p, f in KINDS]
#: What is tried where a match is not valid as a whole, and where the search goes on if nothing is.
_PARTS = {"card": card_parts, "phone": phone_parts, "iban": iban_parts}
_MONTH_STARTS = tuple(name[:3] for name in MONTHS)
_NEXT_GROUP = re.compile(r"[^\w][\w+(]")
#: A text without any of these has no finding: one cheap pass lets most texts go at once.
_TRIGGER = re.compile(r"@|[0-9][0-9 ./()\-]{5}|AKIA|[0-9A-Fa-f]{32}|[A-Z]{2}[0-9]{2}[ A-Z0-9]")


class Rewriter:
    def __init__(self, key: bytes):
        self.permuter = Permuter(hmac.new(key, b"pseudonyms", hashlib.sha256).digest())
        self.cached = lru_cache(maxsize=100_000)(self._one)

    def _one(self, kind: int, value: str) -> str | None:
        return _PATTERNS[kind][2](self.permuter, value)

    def __call__(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        named = bool(text) and any(m in text for m in _MONTH_STARTS)
        if not text or not named and not _TRIGGER.search(text):
            return text, {}
        spans: list[tuple[int, int, int, str]] = []
        for k, (kind, pattern, _) in enumerate(_PATTERNS):
            parts_of, m = _PARTS.get(kind), pattern.search(text) if named or kind != "named_date" else None
            while m:
                start, end = m.span()
                for value in (m[0], *(parts_of(m[0]) if parts_of else ())):
                    new = self.cached(k, value)
                    if new is not None:
                        end = start + len(value)
                        spans.append((start, k, end, new))
                        break
                else:
                    group = _NEXT_GROUP.search(text, start + 1, end) if parts_of else None
                    end = group.start() + 1 if group else end
                m = pattern.search(text, end)
        spans.sort()
        parts, at, counts = [], 0, {}
        for start, k, end, new in spans:
            if start >= at:
                parts += text[at:start], new
                at = end
                counts[KIND_NAMES[k]] = counts.get(KIND_NAMES[k], 0) + 1
        return "".join(parts) + text[at:], counts


def session_key(spark: SparkSession) -> bytes:
    """The key of KEY_SETTING; where it is unset, a random one, which is set then."""
    if not spark.conf.get(KEY_SETTING, ""):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """docs with rewritten text; all columns and rows are kept."""

    def run(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
        rewrite = worker.held(("pseudonyms", key), lambda: Rewriter(key))
        for batch in batches:
            field = batch.schema.field(at)
            yield batch.set_column(at, field, pa.array([rewrite(t.as_py())[0] for t in batch.column(at)], field.type))

    return common.map_rows(spread(docs), run, at="text")


_FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((f"n_{k}", pa.int64()) for k in KIND_NAMES), ("n_replaced", pa.int64())])
FOUND = "doc_id long, text string, " + "".join(f"n_{k} long, " for k in KIND_NAMES) + "n_replaced long"


def pseudonymize_report(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, rewritten text, findings by kind) of each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewrite = worker.held(("pseudonyms", key), lambda: Rewriter(key))
        for batch in batches:
            rows = []
            for d, t in zip(batch.column(0), batch.column(1), strict=True):
                text, counts = rewrite(t.as_py())
                rows.append({"doc_id": d.as_py(), "text": text, "n_replaced": sum(counts.values())} | {f"n_{k}": counts.get(k, 0) for k in KIND_NAMES})
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND)

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, FOUND)


def op7_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymize_report(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))
