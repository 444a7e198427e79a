"""Format-preserving pseudonyms for personal data.

Candidates are found by pattern and kept only if they are valid: card numbers
by their check digit, dates by the calendar, addresses by their ranges. A valid
value becomes a number below the size of its format and is permuted by a keyed
Feistel network, walking the cycle until the result lies in the format again.
The result keeps length, separators and validity. The permutation depends on
the key and the kind only, so equal values get equal pseudonyms in all
documents, and different values different ones.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect, insort
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerlens.llm.common import bounded_batches, given_back

ROUNDS = 8
LOWER, UPPER, DIGIT, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
SECRET_BLOCK = 200  # characters of a secret that are permuted together
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size - 1."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask, width = (1 << half) - 1, (half + 7) // 8
    label = tweak.encode() + b"/" + size.to_bytes((size.bit_length() + 7) // 8, "big")
    while True:
        left, right = value >> half, value & mask
        for i in range(ROUNDS):
            out = b""
            while len(out) < width:
                out += hashlib.blake2b(label + bytes([i, len(out) // 64]) + right.to_bytes(width, "big"), key=key, digest_size=min(64, width + 1)).digest()
            left, right = right, left ^ (int.from_bytes(out[:width], "big") & mask)
        value = left << half | right
        if value < size:
            return value


def permute(alphabets: list[str], chars: str, key: bytes, tweak: str) -> str:
    """Permutes a string whose i-th character is taken from ``alphabets[i]`` (mixed-radix number)."""
    value, size = 0, 1
    for a, c in zip(alphabets, chars, strict=True):
        value, size = value * len(a) + a.index(c), size * len(a)
    if size == 1:
        return chars
    value, out = feistel(value, size, key, tweak), []
    for a in reversed(alphabets):
        value, k = divmod(value, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def refill(shape: str, chars: str) -> str:
    """Puts ``chars`` in place of the digits of ``shape``."""
    it = iter(chars)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def luhn_digit(digits: str) -> str:
    """The check digit that follows these digits."""
    total = sum(d if i % 2 else (2 * d - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def _card(value: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[0] + permute([DIGIT] * (len(digits) - 2), digits[1:-1], key, "card")
    return refill(value, body + luhn_digit(body))


#: How cards are written: the digits of each group.
CARD_GROUPS = {(4, 4, 4, 4), (8, 8), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3), *((n,) for n in range(13, 20))}
MOST_GROUPS = max(map(len, CARD_GROUPS))
#: Issuers: first digits (from, to) and lengths.
ISSUERS = [("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)),
           ("644", "659", (16, 19)), ("3528", "3589", (16, 19)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("62", "62", (16, 17, 18, 19))]
#: A word like these near an unusually grouped number says that it is a card.
CARD_WORD = re.compile(r"(?i)\b(?:cards?|credit|debit|visa|master ?card|amex|american express|discover|karten?|kreditkarten?|kartennummer|cartes?|tarjetas?|cc|pan)\b")
WORD_BEFORE, WORD_AFTER = 40, 20


def issued(digits: str) -> bool:
    """Whether a known issuer gives out numbers of these first digits and this length."""
    return any(low <= digits[: len(low)] <= high and len(digits) in lengths for low, high, lengths in ISSUERS)


def _cards(m: re.Match, key: bytes, free, written_as_card: bool) -> list[tuple[int, int, str]]:
    """(start, end, pseudonym) of the cards in a run of digit groups, which may hold other numbers as well.

    ``written_as_card``: the parts between group borders that are grouped as cards
    are. A part of a longer run must be an issuer's, and no group of four beside four
    groups of four may be left over, as it is in a list of such numbers. Else: parts in
    any groups that are an issuer's and have a word for cards nearby. The longer and then
    the earlier part goes first.
    """
    text, first, last = m.string, m.start(), m.end()
    near = [bool(CARD_WORD.search(text[max(0, first - WORD_BEFORE) : first])), bool(CARD_WORD.search(text[last : last + WORD_AFTER]))]
    if not (written_as_card or any(near)):
        return []
    groups = [(first + g.start(), first + g.end()) for g in re.finditer(r"\d+", m[0])]
    sizes = [b - a for a, b in groups]
    parts = []
    for i in range(len(groups)):
        # a word for cards lies outside the run, so only parts at its ends can have one nearby
        if not written_as_card and WORD_BEFORE < groups[i][0] - first and groups[i][0] < last - WORD_AFTER - 40:
            continue
        digits = 0
        for j in range(i, len(groups)):
            digits += sizes[j]
            if digits > 19 or (written_as_card and j - i >= MOST_GROUPS):
                break
            if digits >= 13 and (tuple(sizes[i : j + 1]) in CARD_GROUPS) == written_as_card:
                parts.append((j - i + 1 < len(groups), -digits, i, j))
    found: dict[tuple[int, int], str] = {}
    used: set[int] = set()
    for inner, _, i, j in sorted(parts):
        start, end = groups[i][0], groups[j][1]
        if not used.isdisjoint(range(i, j + 1)) or not free(start, end) or (new := _card(m.string[start:end], key)) is None:
            continue
        if (inner or not written_as_card) and not issued(re.sub(r"\D", "", m.string[start:end])):
            continue
        if not written_as_card and not CARD_WORD.search(m.string[max(0, start - WORD_BEFORE) : start]) and not CARD_WORD.search(m.string[end : end + WORD_AFTER]):
            continue
        found[i, j] = new
        used.update(range(i, j + 1))
    while written_as_card:  # a part that goes leaves its groups over beside the next
        gone = [(i, j) for i, j in found if set(sizes[i : j + 1]) == {4} and any(0 <= k < len(groups) and k not in used and sizes[k] == 4 for k in (i - 1, j + 1))]
        if not gone:
            break
        for i, j in gone:
            del found[i, j]
            used.difference_update(range(i, j + 1))
    return [(groups[i][0], groups[j][1], new) for (i, j), new in found.items()]


def _phone(m: re.Match, key: bytes) -> str | None:
    code, rest = m["code"] or "", m[0][len(m["code"] or "") :]
    digits = re.sub(r"\D", "", rest)
    if code in ("", "+1"):  # ten digits; area and exchange start with 2 to 9
        if len(digits) != 10 or digits[0] < "2" or digits[3] < "2":
            return None
        alphabets = [DIGIT[2:] if i in (0, 3) else DIGIT for i in range(10)]
    else:
        if not 6 <= len(digits) <= 12:
            return None
        alphabets = [DIGIT] * len(digits)
    return code + refill(rest, permute(alphabets, digits, key, "phone"))


def _ssn(m: re.Match, key: bytes) -> str | None:
    def valid(a: str, g: str, s: str) -> bool:
        return a not in ("000", "666") and a < "900" and g != "00" and s != "0000"

    value = m[0].replace("-", "")
    if not valid(value[:3], value[3:5], value[5:]):
        return None
    while True:  # walks the cycle to the next valid number
        value = permute([DIGIT] * 9, value, key, "ssn")
        if valid(value[:3], value[3:5], value[5:]):
            return refill(m[0], value)


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = int(ipaddress.IPv4Address(m[0]))
    if not ipaddress.IPv4Address(value).is_global:
        return None
    while True:
        value = feistel(value, 1 << 32, key, "ip")
        if ipaddress.IPv4Address(value).is_global:
            return str(ipaddress.IPv4Address(value))


def _date(m: re.Match, key: bytes) -> str | None:
    """Year first, or day and month first: month/day with a slash, day.month and day-month else.

    Where that is no date, the other order of day and month is taken, and the result is one that is a
    date in that order only.
    """
    part = [int(x) for x in re.findall(r"\d+", m[0])]
    sep = re.findall(r"\D", m[0])[0]
    if len(re.findall(r"\d+", m[0])[0]) == 4:
        orders = [(0, 1, 2)]
    else:
        orders = [(2, 0, 1), (2, 1, 0)] if sep == "/" else [(2, 1, 0), (2, 0, 1)]
    for order in orders:
        try:
            day = dt.date(*(part[i] for i in order)).toordinal()
            break
        except ValueError:
            pass
    else:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    while True:  # walks the cycle to the next date that is read in this order
        day = FIRST_DAY + feistel(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, "date")
        new = dt.date.fromordinal(day)
        if order == orders[0] or new.day > 12:
            break
    shown = {order[0]: f"{new.year:04d}", order[1]: f"{new.month:02d}", order[2]: f"{new.day:02d}"}
    return sep.join(shown[i] for i in range(3))


def _letters(text: str) -> list[str]:
    return [next((a for a in (DIGIT, LOWER, UPPER) if c in a), c) for c in text]


def _email(m: re.Match, key: bytes) -> str | None:
    """Letters and digits of the address permuted, but for the last label of the domain."""
    body, dot, top = m[0].rpartition(".")
    return permute(_letters(body), body, key, "email") + dot + top


def _iban(m: re.Match, key: bytes) -> str | None:
    plain = m[0].replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = permute(_letters(plain[4:]), plain[4:], key, "iban")
    new = iter(plain[:2] + f"{98 - number(account + plain[:2] + '00') % 97:02d}" + account)
    return "".join(c if c == " " else next(new) for c in m[0])


def _secret(m: re.Match, key: bytes) -> str | None:
    """A long value given to a name such as token or api_key: letters and digits permuted."""
    value = m["value"]
    if not re.search(r"\d", value):
        return None
    alphabets = [HEX] * len(value) if re.fullmatch(r"[0-9a-f]+", value) else _letters(value)
    n = -(-len(value) // SECRET_BLOCK)  # blocks of nearly equal length, each with a tweak of its own
    cuts = [len(value) * i // n for i in range(n + 1)]
    blocks = enumerate(zip(cuts[:-1], cuts[1:], strict=True))
    return "".join(permute(alphabets[a:b], value[a:b], key, f"secret/{i}" if i else "secret") for i, (a, b) in blocks)


#: All digit groups that follow each other.
DIGIT_RUN = re.compile(r"(?<![\d.-])\d(?:[ -]?\d){12,}(?!\d|[.-]\d)")

#: Kind, pattern and rule, in the order of precedence where matches overlap.
RULES = [
    ("email", re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![\w-])"), _email),
    ("secret", re.compile(r"(?i:\b(?:[a-z_]*token|[a-z_]*secret|api_?key|access_?key|password)\b[\"']?\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_+/-]{16,})"), _secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("card", DIGIT_RUN, partial(_cards, written_as_card=True)),
    # a phone needs a country code, brackets around the area code, or the 3-3-4 form
    ("phone", re.compile(r"(?<![\w+.-])(?P<code>\+1)(?:[ .-]?\(\d{3}\)[ .-]?|[ .-]?\d{3}[ .-]?)\d{3}[ .-]?\d{4}(?![\w-]|\.\d)"), _phone),
    ("phone", re.compile(r"(?<![\w+.-])(?P<code>)(?:\(\d{3}\) ?|\d{3}([.-])(?=\d{3}\2))\d{3}[.-]\d{4}(?![\w-]|\.\d)"), _phone),
    ("phone", re.compile(r"(?<![\w+.-])(?P<code>\+[2-9]\d{0,2})[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\w-]|\.\d)"), _phone),
    ("ip", re.compile(r"(?<![\w.-])\d{1,3}(?:\.\d{1,3}){3}(?![\w-]|\.\d)"), _ip),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    ("date", re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w/-]|\.\d)"), _date),
    # cards in unusual groups, where no other kind was found
    ("card", DIGIT_RUN, partial(_cards, written_as_card=False)),
]
TRIGGER = re.compile(r"[0-9@]")


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the valid values of a text, in order, without overlaps."""
    if not TRIGGER.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []

    def free(start: int, end: int) -> bool:
        at = bisect(taken, (start,))
        return (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0])

    for kind, pattern, rule in RULES:
        for m in pattern.finditer(text):
            if pattern is DIGIT_RUN:
                for a, b, new in rule(m, key, free):
                    insort(taken, (a, b, kind, new))
                continue
            start, end = m.span("value") if "value" in pattern.groupindex else m.span()
            if not free(start, end):
                continue
            if (new := rule(m, key)) is not None:
                insort(taken, (start, end, kind, new))
    return taken


def replace(text: str, found: list[tuple[int, int, str, str]]) -> str:
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]])


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """The same rows and columns with personal data replaced in ``text_col``.

    ``found_col`` adds an array of (kind, start, length, pseudonym), with the
    place in the original text; it replaces a column of that name. A null text
    stays null with a null array; a text without a digit or @ is unchanged. Texts
    of any length are searched whole, in time that grows as they do; repeated rows are
    changed alike; an empty table gives no rows.
    """
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType()), T.StructField("pseudonym", T.StringType())])
    rows = docs.drop(found_col) if found_col else docs
    schema = T.StructType([*rows.schema.fields, *([T.StructField(found_col, T.ArrayType(item))] if found_col else [])])
    at = rows.columns.index(text_col)
    arrow_item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            found = [None if t is None else find(t, secret) for t in texts]
            columns = list(batch.columns)
            new = [t if not f else replace(t, f) for t, f in zip(texts, found, strict=True)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if found_col:
                items = [None if f is None else [{"kind": k, "start": a, "length": b - a, "pseudonym": p} for a, b, k, p in f] for f in found]
                columns.append(pa.array(items, arrow_item))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(given_back(run), schema)
