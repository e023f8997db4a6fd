"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_if_null

#: The kinds in the order that breaks ties. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]

#: Fixed patterns. Possessive quantifiers and the look-behinds only spare retries that can't
#: match, so that a text of any length takes linear time: a run of local-part characters has to be
#: entered at its start, or where the last match ended (\G). Runs of fewer than 14 digits are no
#: matches of card, since its check would drop them.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{18,64})(?![A-Za-z0-9])",
}
#: A span's score before its context, and the words nearby that raise it.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "secret": 0.5}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "secret": "password|passwd|secret|token|api.?key|akia",
}
#: How many items a step of a running sum takes at once, and the code points of a text's blocks.
GROUP, BLOCK = 128, 4096
#: Code points before a span that count as its context, what a context word adds, and the least
#: score of a kind outside the base ones.
NEAR, BOOST, LEAST = 40, 0.2, 0.6


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves the remainder 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(code < 65, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda part: F.length(F.ltrim(part, F.lit("0"))) <= F.when(F.ltrim(part, F.lit("0")) <= "255", 3).otherwise(2))
    if kind == "card":
        return F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(10, 15)
    if kind == "iban":
        return _shortened(m).isNotNull()
    if kind == "secret":
        return m.rlike("[0-9]")
    return F.lit(True)


#: A cheap test that a text can hold a match at all.
HINT = {"email": "@", "ip": ".", "phone": "+"}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(items: Column, value: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """An array of structs (x, before): each item and what join makes of the values of all earlier ones, 0 at first.

    Arrays can only grow by a copy. So items go by groups: the groups' totals are run through
    first, then each group from its own start, and copies stay short.
    """

    def scan(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(xs, first, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def run(every: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / GROUP).cast("int")), lambda g: F.slice(every, g * GROUP + 1, F.lit(GROUP)))

        def within(parts: Column) -> Column:
            totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: join(acc, value(x))))
            starts = scan(totals, F.lit(0))
            return F.flatten(F.zip_with(parts, starts, lambda part, start: F.zip_with(part, scan(F.transform(part, value), start), lambda x, at: F.struct(x.alias("x"), at.alias("before")))))

        return F.when(F.size(every) > 0, bound(groups, within)).otherwise(F.array())

    return bound(items, run)


def _shortened(m: Column) -> Column:
    """The longest beginning of an IBAN's match, up to a blank or its end, that passes the check; null if none does."""
    ends = F.filter(F.sequence(F.length(m), F.lit(15), F.lit(-1)), lambda i: (i == F.length(m)) | (F.substring(m, i + 1, F.lit(1)) == " "))
    whole = lambda i: F.replace(F.substring(m, F.lit(1), i), F.lit(" "), F.lit(""))
    return F.get(F.filter(ends, lambda i: (F.length(whole(i)) >= 15) & mod97(whole(i))), F.lit(0))


def _spans(kind: str, text: Column) -> Column:
    """The confirmed spans of a kind, with their scores.

    The pieces between the matches, and the matches, give every match's place; the pieces and the
    matches come from the same scan order, so the i-th match follows the i-th piece.
    """
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    # Places are needed only where the text has a match; `split` is not run elsewhere.
    pieces = F.slice(F.split(text, PATTERNS[kind], -1), F.lit(1), F.size(found))
    lengths = F.zip_with(pieces, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("len"), m.alias("m"), F.right(p, F.lit(NEAR)).alias("near")))
    placed = running(lengths, lambda x: x["gap"] + x["len"], lambda a, b: a + b)
    valid = F.filter(placed, lambda s: _valid(kind, s["x"]["m"]))
    near = lambda s: F.lower(F.concat(s["x"]["near"], s["x"]["m"] if kind == "secret" else F.lit("")))
    score = lambda s: F.lit(PRIOR[kind]) + F.when(near(s).rlike(CONTEXT[kind]), BOOST).otherwise(0.0)
    size = lambda s: _shortened(s["x"]["m"]) if kind == "iban" else s["x"]["len"]
    start = lambda s: s["before"] + s["x"]["gap"]
    scored = F.transform(valid, lambda s: F.struct(start(s).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (start(s) + size(s)).alias("end"), F.least(F.lit(1.0), score(s)).alias("score")))
    if kind not in BASE:
        scored = F.filter(scored, lambda s: s["score"] >= LEAST)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,score:double>>")
    hint = F.contains(text, F.lit(HINT[kind])) if kind in HINT else F.lit(True)
    return F.when(hint & text.rlike(PATTERNS[kind]), scored).otherwise(none)


def find(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The spans of personal data in every whole text.

    docs: doc_id, text; columns named in keep are passed through, others are dropped. Base kinds
    keep every match that passes its check, whatever its context; the kinds iban and secret are
    added where the score, with the context words before the span, reaches LEAST; an iban ends where
    the longest beginning of its match passes the check. Time is linear in a text's length but for
    copies of running sums, which a text of a million matches doesn't notice.

    Returns doc_id, keep, text and pii: array of (start, kind, end, score) sorted by start, then
    kind; places in code points, end exclusive. Kinds may overlap. Null texts count as empty and
    have no spans; an empty table gives no rows; repeated rows are treated each by itself.
    """
    text = blank_if_null("text")
    rows = docs.select("doc_id", *keep, text.alias("text"))
    spans = [_spans(k, F.col("text")) for k in KINDS]
    return rows.withColumn("pii", F.array_sort(F.concat(*spans)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: int):
    return lambda s: s["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    base = F.filter("pii", lambda s: s["kind"] < len(BASE))
    counts = [F.size(F.filter("pii", _is(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("pii")).alias("spans"))


def _within(block: Column, first: Column, last: Column) -> Column:
    start = F.greatest(first, F.lit(0))
    return F.substring(block, start + 1, F.least(last, F.lit(BLOCK)) - start)


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, n_chars recounted.

    Overlapping spans: the one that starts first (then by kind) is replaced, later ones that start
    inside it only extend what is cut. The columns of docs stay as they are otherwise; null texts
    stay null, repeated rows are treated each by itself, an empty table gives no rows.
    """
    keep = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    found = find(docs.withColumn("_had_text", F.col("text").isNotNull()), (*keep, "_had_text"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")

    def cut(blocks: Column) -> Column:
        def part(first: Column, last: Column) -> Column:
            """The code points from first to before last; blocks spare a walk from the text's start."""
            inside = F.transform(F.sequence(F.floor(first / BLOCK).cast("int"), F.floor((last - 1) / BLOCK).cast("int")), lambda i: _within(F.get(blocks, i), first - i * BLOCK, last - i * BLOCK))
            return F.when(last > first, F.array_join(inside, "")).otherwise("")

        def fill(spans: Column) -> Column:
            fresh = F.filter(spans, lambda s: s["x"]["start"] >= s["before"])
            pieces = F.transform(fresh, lambda s: F.concat(part(s["before"], s["x"]["start"]), F.element_at(names, s["x"]["kind"] + 1)))
            return F.concat(F.array_join(pieces, ""), part(F.array_max(F.transform(spans, lambda s: s["x"]["end"])), F.length(text)))

        return bound(running(F.col("pii"), lambda s: s["end"], F.greatest), fill)

    clean = bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)
    redacted = found.withColumn("text", F.when(F.size("pii") > 0, clean).otherwise(text))
    if "n_chars" in docs.columns:
        redacted = redacted.withColumn("n_chars", F.when(F.size("pii") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    redacted = redacted.withColumn("text", F.when(F.col("_had_text"), F.col("text")))
    return redacted.select(*docs.columns)


def _sql_spans(kind: str, pattern: str, valid: str) -> str:
    return f"""
{kind}_m AS (SELECT doc_id, text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM docs),
{kind} AS (
  SELECT doc_id, '{kind}' AS kind, s, s + length(m) AS e, {KINDS.index(kind)} AS k, m, before
  FROM (SELECT doc_id, ms[i] AS m, ps[i] AS before, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
        FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM {kind}_m))
  WHERE {valid})"""


_LUHN = (
    "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(m, '[^0-9]', '', 'g')) + 1), "
    "lambda i: CASE WHEN i % 2 = 1 THEN d(m, i) WHEN d(m, i) > 4 THEN 2 * d(m, i) - 9 ELSE 2 * d(m, i) END)) % 10 = 0"
).replace("d(m, i)", "substr(reverse(regexp_replace(m, '[^0-9]', '', 'g')), i, 1)::INT")
#: The kinds in DuckDB: its patterns have no look-around, so what the added kinds look at is in a check.
ORACLE = (
    "WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(
        [
            _sql_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
            _sql_spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(p) < 19 AND p::BIGINT <= 255))"),
            _sql_spans("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN),
            _sql_spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 10 AND 15"),
            _sql_spans("secret", r"\b(?:AKIA[0-9A-Z]{16}|[0-9a-f]{18,64})\b", "regexp_matches(m, '[0-9]') AND regexp_matches(lower(right(before, 40) || m), 'password|passwd|secret|token|api.?key|akia')"),
        ]
    )
    + """
, every AS (SELECT doc_id, kind, s, e, k FROM email UNION ALL SELECT doc_id, kind, s, e, k FROM ip UNION ALL SELECT doc_id, kind, s, e, k FROM card
  UNION ALL SELECT doc_id, kind, s, e, k FROM phone UNION ALL SELECT doc_id, kind, s, e, k FROM secret),
joined AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_email, count(*) FILTER (k = 1) AS n_ip, count(*) FILTER (k = 2) AS n_card, count(*) FILTER (k = 3) AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN joined USING (doc_id)"""
)
