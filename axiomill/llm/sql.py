"""SQL for DuckDB over the same tables, for what it can tell of the operators."""

from __future__ import annotations

from .secrets import ASSIGN

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _base_spans(kinds: list[tuple[str, str, str]]) -> str:
    """Counts and digest of the spans of (kind, pattern, test of a match {x}): positions from the pieces between matches."""
    found = ", ".join(f"regexp_extract_all(t, {_quoted(p)}) AS h{i}, string_split_regex(t, {_quoted(p)}) AS p{i}" for i, (_, p, _) in enumerate(kinds))
    length = lambda c, to: f"coalesce(list_sum(list_transform({c}[1:{to}], lambda y: length(y))), 0)::BIGINT"
    spans = ", ".join(
        f"list_filter(list_transform(range(1, len(h{i}) + 1), lambda j: {{'s': {length(f'p{i}', 'j')} + {length(f'h{i}', 'j - 1')}, 'k': {i}, 'x': h{i}[j]}}), lambda e: {test.replace('{x}', 'e.x')}) AS s{i}"
        for i, (_, _, test) in enumerate(kinds)
    )
    names = ", ".join(_quoted(k) for k, _, _ in kinds)
    told = f"list_transform(list_sort({' || '.join(f's{i}' for i in range(len(kinds)))}), lambda e: [{names}][e.k + 1] || ':' || e.s || ':' || (e.s + length(e.x)))"
    counts = ", ".join(f"len(s{i})::BIGINT AS n_{k}" for i, (k, _, _) in enumerate(kinds))
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {found} FROM d), s AS (SELECT doc_id, {spans} FROM f) SELECT doc_id, {counts}, sha256(array_to_string({told}, ',')) AS base_sha256 FROM s"


_DIGITS = "regexp_replace({x}, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, place: CASE WHEN place % 2 = 1 THEN c::INT ELSE 2 * c::INT - 9 * (c::INT > 4)::INT END)) % 10 = 0"
PII = _base_spans(
    [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "length({x}) > 0"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split({x}, '.'), lambda n: length(ltrim(n, '0')) > 3 OR coalesce(try_cast(n AS HUGEINT), 256) > 255)) = 0"),
        ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
    ]
)
#: Runs of hexadecimal digits stand in every word, so only long enough ones are split off; no shorter match hides a longer one.
SECRETS = _base_spans([("assign", ASSIGN, f"length(regexp_extract({{x}}, {_quoted(ASSIGN)}, 1)) >= 6"), ("access", "AKIA[A-Z0-9]{16,}", "length({x}) >= 20"), ("hex", "[0-9a-f]{24,}", "length({x}) >= 24")])

_HOST = rf"translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
_RULES = [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("net/es/", "block"), ("net/fr/", "block"), ("com/", "allow")]


def _by_rule(of) -> str:
    """The longest rule's answer."""
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    return "CASE " + " ".join(f"WHEN {fits(rule)} THEN '{of(rule, said)}'" for rule, said in _RULES) + " END"


URL_RULES = f"""WITH u AS (SELECT page_id, {_HOST} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)
SELECT page_id, host, path, {_by_rule(lambda r, s: r)} AS rule, {_by_rule(lambda r, s: s)} AS ruled FROM u"""

EDITED = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, length(t) // 2 AS half, coalesce(lead(t) OVER (ORDER BY doc_id DESC), first_value(t) OVER (ORDER BY doc_id DESC)) AS after FROM d)
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - half) || substr(after, 1, half)) AS edited_sha256 FROM n"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
CONTAMINATION = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
a AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n)),
m AS (SELECT doc_id, n, i, item FROM a JOIN p USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

SIZES = "SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size, 'bytes' AS law, NULL::INTEGER AS grown_shard FROM documents"
SHARDS = "SELECT count(*) AS rows, sum(strlen(coalesce(text, '')) + 16)::BIGINT AS bytes, true AS gapless, true AS even FROM documents"

#: CRC-32 of a short text: bytes in, eight shifts each.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
lambda r, b: list_reduce(list_prepend(xor(r, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda q, z: xor(q >> 1, 3988292384::BIGINT * (q & 1)))), 4294967295::BIGINT)"""
HELD_OUT = f"SELECT doc_id, {_CRC} % 3 = 1 AS held_out, true AS sound FROM documents"

#: Earliest deadline first, slot by slot, with natural shares as weights: it holds where no source has more than a quarter of all rows.
SCHEDULE = """WITH RECURSIVE c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
a AS (SELECT list(source ORDER BY source) AS names, list(n ORDER BY source) AS n, sum(n)::BIGINT AS total FROM c),
s AS (SELECT -1::BIGINT AS slot, list_transform(n, lambda x: 0::BIGINT) AS begun, NULL::STRUCT(due BIGINT, s BIGINT, i BIGINT, release BIGINT) AS pick FROM a UNION ALL
SELECT t, list_transform(begun, lambda b, j: b + (j = chosen.s)::BIGINT), chosen FROM (
  SELECT begun, t, list_sort(list_filter(open, lambda o: o.release <= t))[1] AS chosen FROM (
    SELECT begun, open, greatest(slot + 1, list_min(list_transform(open, lambda o: o.release))) AS t FROM (
      SELECT slot, begun, list_filter(list_transform(begun, lambda b, j: {'due': -((-(b + 1) * total) // n[j]), 's': j, 'i': b, 'release': b * total // n[j]}), lambda o: o.i * 16 < n[o.s]) AS open FROM s, a) WHERE len(open) > 0)))
SELECT names[pick.s] AS source, pick.i AS block, pick.release AS release, pick.due AS deadline, slot, least(16, n[pick.s] - 16 * pick.i) AS rows FROM s, a WHERE pick IS NOT NULL"""

#: Strings of 100 bytes by their 128-bit digests; what is kept are the pieces between the runs of repeated ones.
SUBSTRINGS = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
g AS (SELECT doc_id, i, md5_number(t[i + 1:i + 100]) AS h FROM (SELECT doc_id, t, unnest(range(octet_length(t) - 99)) AS i FROM d)),
f AS (SELECT h, min((doc_id, i)) AS k FROM g GROUP BY h HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM g JOIN f USING (h) WHERE (doc_id, i) <> k),
b AS (SELECT doc_id, i, i > coalesce(lag(i) OVER w + 100, -1) AS begins FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
n AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
s AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM n GROUP BY doc_id, run),
p AS (SELECT doc_id, lag(e, 1, 0) OVER w AS s, s AS e FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY s) UNION ALL SELECT doc_id, max(e), NULL FROM s GROUP BY doc_id),
q AS (SELECT doc_id, string_agg(hex(t[p.s + 1:coalesce(p.e, octet_length(t))]), '' ORDER BY p.s) AS kept FROM p JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, hex(t)))) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id) LEFT JOIN q USING (doc_id)"""

#: The five primes of XXH64.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_WORD = 1 << 64


def _wide(n: int) -> str:
    return f"{n % _WORD}::UHUGEINT"


def _mod(x: str) -> str:
    return f"(({x}) % {_WORD}::UHUGEINT)"


def _turn(x: str, by: int) -> str:
    """x turned left by some bits: a product's low and high half."""
    return f"(({x}) * {_wide(1 << by)} % {_WORD}::UHUGEINT + ({x}) * {_wide(1 << by)} // {_WORD}::UHUGEINT)"


def _times(x: str, prime: int) -> str:
    return _mod(f"({x}) * {_wide(PRIMES[prime - 1])}")


def _round(acc: str, lane: str) -> str:
    return _times(_turn(_mod(f"{acc} + {_times(lane, 2)}"), 31), 1)


def _lane(at: str, size: int) -> str:
    """The little-endian number in `size` bytes of b after the first `at`."""
    return "('0x' || " + " || ".join(f"hex(b[{at} + {k}:{at} + {k}])" for k in range(size, 0, -1)) + ")::UBIGINT::UHUGEINT"


def _xxh64(source: str, seed: int) -> str:
    """Common table expressions that end in xx(s, h): the XXH64 of each text s of the source's UTF-8 bytes."""
    merged = lambda h, v: _mod(f"{_times(f'xor({h}, {_round(_wide(0), v)})', 1)} + {_wide(PRIMES[3])}")
    starts = (seed + PRIMES[0] + PRIMES[1], seed + PRIMES[1], seed, seed - PRIMES[0])
    stripes = ", ".join(f"list_reduce(list_transform(range(n // 32), lambda i: {_lane(f'32 * i + {8 * k}', 8)}), lambda v, x: {_round('v', 'x')}, {_wide(start)}) AS v{k}" for k, start in enumerate(starts))
    whole = _mod(" + ".join(_turn(f"v{k}", by) for k, by in enumerate((1, 7, 12, 18))))
    last = _round(_wide(0), "x")
    eight = _mod(f"{_times(_turn(f'xor(h, {last})', 27), 1)} + {_wide(PRIMES[3])}")
    tail = _times(_lane("n // 8 * 8", 4), 1)
    four = _mod(f"{_times(_turn(f'xor(h, {tail})', 23), 2)} + {_wide(PRIMES[2])}")
    one = _times(_turn(f"xor(h, {_times('x', 5)})", 11), 1)
    return f"""x0 AS (SELECT s, encode(s) AS b, octet_length(encode(s)) AS n FROM {source}),
x1 AS (SELECT *, {stripes} FROM x0 WHERE n >= 32),
x2 AS (SELECT s, b, n, v1, v2, v3, {merged(whole, 'v0')} AS h FROM x1),
x3 AS (SELECT s, b, n, v2, v3, {merged('h', 'v1')} AS h FROM x2), x4 AS (SELECT s, b, n, v3, {merged('h', 'v2')} AS h FROM x3), x5 AS (SELECT s, b, n, {merged('h', 'v3')} AS h FROM x4),
x6 AS (SELECT s, b, n, {_mod('h + n::UHUGEINT')} AS h FROM (SELECT * FROM x5 UNION ALL SELECT s, b, n, {_wide(seed + PRIMES[4])} FROM x0 WHERE n < 32)),
x7 AS (SELECT s, b, n, list_reduce(list_transform(range(n % 32 // 8), lambda i: {_lane('n // 32 * 32 + 8 * i', 8)}), lambda h, x: {eight}, h) AS h FROM x6),
x8 AS (SELECT s, b, n, CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h FROM x7),
x9 AS (SELECT s, list_reduce(list_transform(range(n % 4), lambda i: {_lane('n // 4 * 4 + i', 1)}), lambda h, x: {one}, h) AS h FROM x8),
xa AS (SELECT s, {_times(f'xor(h, h // {_wide(1 << 33)})', 2)} AS h FROM x9), xb AS (SELECT s, {_times(f'xor(h, h // {_wide(1 << 29)})', 3)} AS h FROM xa),
xx AS (SELECT s, xor(h, h // {_wide(1 << 32)})::UBIGINT AS h FROM xb)"""


#: All distinct fingerprints are compared, and links followed from node to node.
SIMHASH = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + least(3, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)),
u AS (SELECT DISTINCT s FROM g), {_xxh64('u', 42)},
o AS (SELECT doc_id, bit, 2 * sum(c * (h >> bit & 1)) > sum(c) AS one FROM (SELECT doc_id, h, count(*) AS c FROM g JOIN xx USING (s) GROUP BY doc_id, h), range(64) z(bit) GROUP BY doc_id, bit),
f AS (SELECT doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN (SELECT doc_id, sum(one::INT * (1::UBIGINT << bit))::UBIGINT AS fp FROM o GROUP BY doc_id) USING (doc_id)),
m AS (SELECT fp, min(doc_id) AS node FROM f GROUP BY fp),
l AS (SELECT x.node AS x, y.node AS y FROM m x JOIN m y ON bit_count(xor(x.fp, y.fp)) <= 2),
r AS (SELECT node AS x, node AS y FROM m UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM f JOIN m USING (fp) JOIN (SELECT x AS node, min(y) AS component_id FROM r GROUP BY x) USING (node)"""

#: Equal words n / 4 words apart at most, as islands of neighbours; those with a shorter period go.
RUNS = rf"""WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_CRC} AS h FROM documents),
a AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS again, h // 10 % 8 AS k, CASE WHEN len(w) > 0 THEN h // 10 % len(w) ELSE 0 END AS a FROM h),
u AS (SELECT doc_id, n, i, CASE WHEN again AND i >= a THEN w[a + (i - a) % (1 + (n - a) // (3 + k)) + 1] ELSE w[i + 1] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM a)),
e AS (SELECT x.doc_id, y.i - x.i AS p, x.i AS i FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
l AS (SELECT doc_id, p, min(i) AS s, count(*) + p AS len FROM (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e) GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT * FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.doc_id = l.doc_id AND o.p < l.p AND l.p % o.p = 0 AND o.s <= l.s AND o.s + o.len >= l.s + l.len)),
x AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + len)) AS i FROM r),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM u ANTI JOIN x USING (doc_id, i) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || p || chr(10), '' ORDER BY s, p) AS told, min((-len, s, p)) AS top FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top[2] AS start, (-top[1])::BIGINT AS length, top[3] AS period, (1000 * -top[1] // top[3])::BIGINT AS exponent_milli, sha256(coalesce(told, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM a LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id)"""

_TERMS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY term, docs),
g AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM g WHERE score > 0 QUALIFY rank <= 50"""

SQL = {
    "op12_harmonic_runs": RUNS,
    "op13_window_search": SEARCH,
    "op5_fm_decontaminate": CONTAMINATION,
    "op7_simhash": SIMHASH,
    "op8_pfp_substrings": SUBSTRINGS,
    "told_pii": PII,
    "told_secrets": SECRETS,
    "told_url_rules": URL_RULES,
    "told_edited_texts": EDITED,
    "told_sizes": SIZES,
    "told_shards": SHARDS,
    "told_held_out": HELD_OUT,
    "told_toxic_held_out": HELD_OUT,
    "told_schedule": SCHEDULE,
}
