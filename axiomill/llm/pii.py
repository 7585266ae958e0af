"""Personal data: Aho-Corasick anchors, expanded and validated by local parsers.

One automaton holds every anchor: at-signs, plus signs, digits, schemes and identifier cues. A single pass over a
text yields the anchors in order, and each anchor wakes the parser of its kind, which reads outwards from the
anchor, fixes the boundaries and validates the result. No parser looks at text without an anchor.

Kinds: email, ip, card and phone (their rules are given in BASE_RULES), and two that the cues add: `address`, a web address
that names a person (mailto:, tel:, or user information before the host), and `account`, an account or identity
number after a cue word, checked by its check digits where its format has them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import readable

#: The order of kinds among spans that start together.
KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
#: What the four base parsers accept, as patterns (the parsers are tested against them).
BASE_RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SCHEMES = ("mailto:", "tel:", "://")
CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "compte", "cuenta")

_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _email(t: str, at: int, floor: int) -> tuple[int, int, bool] | None:
    lo = at
    while lo > floor and t[lo - 1] in _LOCAL:
        lo -= 1
    if lo == at:
        return None
    n, hi, dots, end = len(t), at + 1, 0, 0
    while True:
        start = hi
        while hi < n and t[hi] in _LABEL:
            hi += 1
        if hi == start:
            break
        end = hi
        dots += 1
        if hi < n and t[hi] == ".":
            hi += 1
        else:
            break
    return (lo, end, True) if dots >= 2 else None


def _ip(t: str, at: int) -> tuple[int, int, bool] | None:
    n, hi, parts = len(t), at, []
    for k in range(4):
        start = hi
        while hi < n and t[hi] in _DIGITS:
            hi += 1
        if hi == start:
            return None
        parts.append(t[start:hi])
        if k < 3:
            if hi >= n or t[hi] != ".":
                return None
            hi += 1
    return at, hi, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def _card(t: str, at: int) -> tuple[int, int, bool] | None:
    n, hi = len(t), at + 1
    digits = [t[at]]
    while hi < n:
        if t[hi] in _DIGITS:
            digits.append(t[hi])
            hi += 1
        elif t[hi] in " -" and hi + 1 < n and t[hi + 1] in _DIGITS:
            digits.append(t[hi + 1])
            hi += 2
        else:
            break
    if len(digits) < 2:
        return None
    return at, hi, 14 <= len(digits) <= 19 and _luhn("".join(digits))


def _phone(t: str, at: int) -> tuple[int, int, bool] | None:
    n = len(t)
    if at + 1 >= n or t[at + 1] not in _DIGITS:
        return None
    hi = at + 2
    while hi < n and t[hi] in _PHONE:
        hi += 1
    while hi > at + 3 and t[hi - 1] not in _DIGITS:
        hi -= 1
    if hi <= at + 3 or t[hi - 1] not in _DIGITS:
        return None
    return at, hi, 10 <= sum(c in _DIGITS for c in t[at:hi]) <= 15


class _Run:
    """The run of address characters that anchors stand in. Where its signs are is looked up once, however many anchors it has."""

    def __init__(self, t: str):
        self.t, self.end, self.cut = t, 0, 0

    def reach(self, at: int) -> int:
        """The end of an address that begins at `at`, without the punctuation after it; anchors come in order."""
        if at >= self.end:
            stop = _URL_STOP.search(self.t, at)
            self.end = self.cut = stop.start() if stop else len(self.t)
            while self.cut > at and self.t[self.cut - 1] in ".,;:!?)]":
                self.cut -= 1
            self.digits, self.ats, self.stops = ([m.start() for m in p.finditer(self.t, at, self.end)] for p in (_DIGIT, _AT, _AUTHORITY_STOP))
            self.hosts: dict[int, bool] = {}
        return max(at, self.cut)

    def digits_in(self, lo: int, hi: int) -> int:
        return max(0, bisect_left(self.digits, hi) - bisect_left(self.digits, lo))

    def host_after(self, at: int) -> bool:
        """Whether labels joined by a dot follow the at-sign."""
        if at not in self.hosts:
            self.hosts[at] = bool(_HOST.match(self.t, at + 1, self.cut))
        return self.hosts[at]


def _address(run: _Run, at: int, scheme: str) -> tuple[int, int] | None:
    t, start, hi = run.t, at + len(scheme), run.reach(at)
    if scheme == "tel:":
        return (at, hi) if run.digits_in(start, hi) >= 7 else None
    first = bisect_left(run.ats, start)
    if scheme == "mailto:":
        sign = run.ats[first] if first < len(run.ats) else hi
        return (at, hi) if start < sign < hi and t[sign - 1] in _LOCAL and run.host_after(sign) else None
    lo = at
    while lo > 0 and t[lo - 1] in _ALNUM:
        lo -= 1
    stop = bisect_left(run.stops, start)
    end = min(hi, run.stops[stop]) if stop < len(run.stops) else hi
    last = bisect_left(run.ats, end) - 1  # the last at-sign of the authority
    return (lo, hi) if lo < at and last >= first and run.ats[last] > start and t.find(".", run.ats[last] + 1, end) >= 0 else None


def _account(t: str, end: int, cue: str) -> tuple[int, int] | None:
    """The identifier after a cue that ends at `end`: letters and digits with single spaces or hyphens."""
    if end - len(cue) > 0 and t[end - len(cue) - 1] in _ALNUM or end < len(t) and t[end] in _ALNUM:
        return None
    m = _AFTER_CUE.match(t, end)
    if not m:
        return None
    start, n, hi = m.end(), len(t), m.end()
    while hi < n and (t[hi] in _ALNUM or t[hi] in " -" and hi + 1 < n and t[hi + 1] in _DIGITS):
        hi += 1
    plain = re.sub(r"[ -]", "", t[start:hi]).upper()
    digits = sum(c in _DIGITS for c in plain)
    if cue == "iban":
        ok = 15 <= len(plain) <= 34 and plain[:2].isalpha() and _iban(plain)
    elif cue == "ssn":
        ok = digits == len(plain) == 9 and plain[:3] not in ("000", "666") and plain[3:5] != "00" and plain[5:] != "0000"
    elif cue == "passport":
        ok = 6 <= len(plain) <= 9 and digits >= 5
    else:
        ok = 6 <= len(plain) <= 20 and digits >= max(6, len(plain) - 4)
    return (start, hi) if ok else None


_URL_STOP = re.compile(r"[ \t\r\n\f\v<>\"'`|{}\\^]")
_DIGIT, _AT, _AUTHORITY_STOP = re.compile("[0-9]"), re.compile("@"), re.compile("[/?#]")
_HOST = re.compile(r"[A-Za-z0-9-]+\.[A-Za-z0-9-]")
_AFTER_CUE = re.compile(r"(?:\x20?(?:number|no\.?|nr\.?|id|#))?\x20?[:=#]?\x20?(?=[A-Za-z0-9])", re.I | re.A)
_AUTOMATON = None


def automaton():
    """The automaton of all anchors; a cue stands in lower case, in capitals and with a first capital."""
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for c in "@+0123456789":
            made.add_word(c, (c, c))
        for word in (*SCHEMES, *CUES):
            for form in {word, word.upper(), word.capitalize()}:
                made.add_word(form, ("scheme" if word in SCHEMES else "cue", word))
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def find(text: str | None) -> list[tuple[int, str, int]]:
    """All spans of a text as (start, kind, end) in code points, by start, then by kind as in KINDS."""
    if not text:
        return []
    spans: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)

    def take(kind: int, got: tuple | None) -> None:
        if got is None or got[0] < done[kind]:
            return
        done[kind] = got[1]
        if len(got) == 2 or got[2]:
            spans.append((got[0], kind, got[1]))

    run, here = -2, _Run(text)  # the last index of the digits in hand
    for end, (kind, word) in automaton().iter(text):
        if kind == "@":
            take(0, _email(text, end, done[0]))
        elif kind == "+":
            if end >= done[3]:
                take(3, _phone(text, end))
        elif kind == "scheme":
            if end + 1 - len(word) >= done[4]:
                take(4, _address(here, end + 1 - len(word), word))
        elif kind == "cue":
            take(5, _account(text, end + 1, word))
        else:
            if end >= done[2]:
                take(2, _card(text, end))
            if end != run + 1 and end >= done[1]:
                take(1, _ip(text, end))
            run = end
    spans.sort()
    return [(lo, KINDS[k], hi) for lo, k, hi in spans]


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_address long, n_account long"


def scan_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs, with the personal data of its whole text; a map without any shuffle.

    A null text counts as empty, a null key stays null, repeated rows are answered one by one, other columns
    are not read. Texts of any length are held one Arrow batch at a time and read in time linear in their length.
    Empty tables give empty results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for value in batch.column(1).to_pylist():
                spans = find(value)
                said = [f"{k}:{lo}:{hi}" for lo, k, hi in spans]
                base = ",".join(x for x, (_, k, _) in zip(said, spans, strict=True) if k in BASE)
                kinds = [k for _, k, _ in spans]
                row = [*(kinds.count(k) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), kinds.count("address"), kinds.count("account")]
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[key].cast("long").alias("doc_id"), readable(docs[text]).alias("text")).mapInArrow(run, SCHEMA)
