import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from axiomill.llm import pii

from .helpers import docs, none, odd


def brute(text):
    found = []
    for kind, pattern in pii.BASE_RULES.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), pii.KINDS.index(kind), m.end()))
    return [(lo, pii.KINDS[k], hi) for lo, k, hi in sorted(found)]


def luhn(digits):
    double = [int(c) for c in digits[-2::-2]]
    return (sum(int(c) for c in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in double)) % 10 == 0


pieces = st.sampled_from(["@", ".", "-", "+", "1", "12", "255", "256", "0", "00", "a", "b@c.d", " ", "(", ")", "4111 1111 1111 1111", "+1 (319) 555-5132", "é", "%", "10.0.0.1", "😀", "a@b", "++", "49927398716"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(pieces, max_size=14).map("".join))
def test_base_spans_are_those_of_the_patterns(text):
    assert [s for s in pii.find(text) if s[1] in pii.BASE] == brute(text)


def test_cues_and_schemes_add_spans():
    text = "IBAN: DE89 3704 0044 0532 0130 00, mailto:bob@x.org http://u:p@ho.st/x account no 12345678 ssn 078-05-1120 http://plain.example/x accounting 12345678"
    kinds = [(k, text[lo:hi]) for lo, k, hi in pii.find(text) if k not in pii.BASE]
    assert kinds == [("account", "DE89 3704 0044 0532 0130 00"), ("address", "mailto:bob@x.org"), ("address", "http://u:p@ho.st/x"), ("account", "12345678"), ("account", "078-05-1120")]


def test_operator(spark):
    got = {r.doc_id: r for r in pii.scan_personal_data(docs(spark, ["é write to a.b@c.org", None, "call +1 (319) 555-5132"])).collect()}
    assert got[0].spans == "email:11:20" and got[0].base_sha256 == hashlib.sha256(b"email:11:20").hexdigest()
    assert got[1].spans == "" and got[2].n_phone == 1
    assert pii.scan_personal_data(odd(spark)).count() == 12
    assert pii.scan_personal_data(none(spark)).collect() == []


def address_of(t, at, scheme):
    """The rule of addresses without anything kept between anchors."""
    hi = re.compile(r"[^ \t\r\n\f\v<>\"'`|{}\\^]*").match(t, at).end()
    while hi > at and t[hi - 1] in ".,;:!?)]":
        hi -= 1
    body = t[at + len(scheme) : hi]
    if scheme == "tel:":
        return (at, hi) if len(re.findall("[0-9]", body)) >= 7 else None
    if scheme == "mailto:":
        return (at, hi) if re.match(r"[^@]*[A-Za-z0-9._%+-]@[A-Za-z0-9-]+\.[A-Za-z0-9-]", body) else None
    lo = re.search(r"[A-Za-z0-9]*$", t[:at]).start()
    user, sign, host = re.split(r"[/?#]", body, maxsplit=1)[0].rpartition("@")
    return (lo, hi) if lo < at and user and sign and "." in host else None


def addresses(t):
    out, done = [], 0
    for m in re.finditer(r"(?=(mailto:|tel:|://|MAILTO:|TEL:|Mailto:|Tel:))", t):
        got = address_of(t, m.start(), m.group(1).lower())
        if got and got[0] >= done:
            out.append(got)
            done = got[1]
    return out


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(["mailto:", "tel:", "://", "http://", "TEL:", "a", "@", "b.c", "1234567", "12", ".", "/", "?", " ", ")", ":", "é", "u:p@h.i"]), max_size=14).map("".join))
def test_addresses_are_those_of_the_rule(text):
    assert [(lo, hi) for lo, k, hi in pii.find(text) if k == "address"] == addresses(text)


def test_a_megabyte_of_anchors_takes_seconds():
    for piece in ("mailto:", "a://", "tel:", "@a.", "+1", "1.1.1.", "iban ", "4 ", "a@b.c,", "tel:1", "mailto:x@", "x://u@"):
        began = time.time()
        pii.find(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece
