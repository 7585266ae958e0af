"""Secret scan in DataFrame functions alone: fixed patterns, and sliding-window entropy over candidate strings.

Positions come from splitting: the pieces between the matches of a pattern and the matches themselves alternate,
so running sums of their lengths are the boundaries, in code points. The sums are taken by doubling, so many matches cost little more each.

Entropy: a candidate is a run of token characters outside the assignments. A window of WINDOW characters slides over it, for each character class
whose alphabet covers the window. The counts are the characters of a string, one place per symbol; a step replaces one place for the character that
comes in and one for the character that goes out, and with them the sum of c * log2(c), from which the window's Shannon entropy
follows; nothing is counted anew. A candidate whose windows reach the entropy of its class is a secret of kind `entropy`, unless the
allow-list knows its form or it is a base span already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base kinds in order, pattern, and the least length of what is named in the comment.
ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6  # of group 1
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 and more in all; a shorter run holds no longer one
HEX = r"[0-9a-f]{24,}"  # whole runs, as none is cut
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Forms that look random and are none: one letter case without digits (words), digits alone, UUIDs, paths.
ALLOWED = (r"^[A-Za-z]?[a-z]+$", r"^[A-Z]+$", r"^[0-9-]+$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"^[A-Za-z=_/+-]+$", r"^(.)\1+$")
#: Candidates that are base spans of kinds hex and access as they are; assignments are blanked before.
KNOWN = (rf"^{HEX}$", rf"^{ACCESS}$")
WINDOW = 20
#: Classes in order, alphabet, least entropy in bits of a window of 20 (the most that 20 characters reach is 4.32).
CLASSES = (("hex", "0123456789abcdef", 2.9), ("alnum", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3.3), ("base64", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.5))
KINDS = ("assign", "access", "hex", "entropy")


def _running_sums(values: Column) -> Column:
    """Inclusive running sums of an array, by doubling the reach."""
    reaches = F.filter(F.array(*(F.lit(1 << i) for i in range(31))), lambda s: s < F.size(values))
    shifted = lambda acc, s: F.concat(F.array_repeat(F.lit(0), s), F.slice(acc, F.lit(1), F.size(acc) - s))
    return F.aggregate(reaches, values, lambda acc, s: F.zip_with(acc, shifted(acc, s), lambda a, b: a + b))


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.length(p) + F.length(h))
    spans = F.zip_with(hits, _running_sums(lengths), lambda h, end: F.struct((end - F.length(h)).alias("start"), end.alias("end"), h.alias("hit")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string>>"))


def without_assignments(text: Column) -> Column:
    """The text with blanks in place of its assignments, so the rest keeps its positions."""
    pieces, hits = F.split(text, ASSIGN, -1), F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(0))
    blank = lambda h: F.when(F.length(F.regexp_extract(h, ASSIGN, 1)) >= ASSIGN_LEAST, F.repeat(F.lit(" "), F.length(h))).otherwise(h)
    return F.array_join(F.zip_with(pieces, hits, lambda p, h: F.concat(p, F.coalesce(blank(h), F.lit("")))), "")


def _plogp(c: Column) -> Column:
    """c * log2(c) for counts of a window, looked up."""
    import math

    return F.get(F.array(*(F.lit(n * math.log2(n) if n else 0.0) for n in range(WINDOW + 2))), c)


def window_entropy(text: Column, alphabet: str) -> Column:
    """The highest Shannon entropy, in bits, of a window of `text` that holds characters of the alphabet alone (null: none does)."""
    import math

    other = len(alphabet) + 1  # the place of what is outside the alphabet
    chars = F.slice(F.split(text, ""), 1, F.length(text))  # without the empty string at the end
    places = F.transform(chars, lambda c: F.coalesce(F.nullif(F.instr(F.lit(alphabet), c), F.lit(0)), F.lit(other)))
    leaving = F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), places), 1, F.size(places))
    steps = F.zip_with(places, leaving, lambda a, b: F.struct(a.alias("into"), b.alias("out")))
    start = F.struct(F.lit("A" * other).alias("n"), F.lit(0).alias("seen"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("best"))
    count = lambda n, place: F.ascii(F.substring(n, place, F.lit(1))) - ord("A")
    put = lambda n, place, c: F.overlay(n, F.char(c + ord("A")), place, F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        into, out = x["into"], x["out"]
        c_in = count(acc["n"], into)
        moved_in = put(acc["n"], into, c_in + 1)
        c_out = count(moved_in, out)
        counts = F.when(out < 0, moved_in).otherwise(put(moved_in, out, c_out - 1))
        plus = acc["sum"] + F.when(into < other, _plogp(c_in + 1) - _plogp(c_in)).otherwise(0.0)
        total = plus - F.when((out > 0) & (out < other), _plogp(c_out) - _plogp(c_out - 1)).otherwise(0.0)
        seen = acc["seen"] + 1
        full = (seen >= WINDOW) & (count(counts, F.lit(other)) == 0)
        bits = F.lit(math.log2(WINDOW)) - total / WINDOW
        return F.struct(counts.alias("n"), seen.alias("seen"), total.alias("sum"), F.when(full, F.greatest(acc["best"], bits)).otherwise(acc["best"]).alias("best"))

    return F.aggregate(steps, start, step, lambda acc: acc["best"])


def _said(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("said")))


def _joined(*parts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.concat(*parts)), lambda s: s["said"]), ",")


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: counts, digest of the base spans, and all spans of the whole text; a map without a shuffle.

    What a base span covers is not told again as an entropy span. A null text counts as empty, null keys stay null, repeated
    rows are answered one by one, other columns are not read, empty tables give empty results.
    """
    t = F.col("text")
    found = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("text"))
    found = found.select("doc_id", "text", located(t, ASSIGN).alias("hits"))
    found = found.select("doc_id", "text", "hits", F.when(F.size("hits") > 0, without_assignments(t)).otherwise(t).alias("rest"))
    found = found.select(
        "doc_id",
        F.filter("hits", lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= ASSIGN_LEAST).alias("assign"),
        located(t, ACCESS).alias("access"),
        located(t, HEX).alias("hex"),
        F.filter(located(F.col("rest"), CANDIDATE), lambda s: ~s["hit"].rlike("|".join((*ALLOWED, *KNOWN)))).alias("candidate"),
    )
    strong = lambda s: F.lit(False) if not CLASSES else _any([window_entropy(s["hit"], a) >= least for _, a, least in CLASSES])
    found = found.withColumn("entropy", F.filter("candidate", strong))
    base = [_said(k, F.col(k)) for k in KINDS[:3]]
    return found.select("doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]), F.sha2(_joined(*base).cast("binary"), 256).alias("base_sha256"), _joined(*base, _said("entropy", F.col("entropy"))).alias("spans"), F.size("entropy").cast("long").alias("n_entropy"))


def _any(tests: list[Column]) -> Column:
    out = F.coalesce(tests[0], F.lit(False))
    for x in tests[1:]:
        out = out | F.coalesce(x, F.lit(False))
    return out
