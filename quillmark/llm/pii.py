"""Personal data by pattern, checksum and context (operator 10), in DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod 97 for IBANs, parts of
at most 255 for addresses, digit counts for phones), and words close by, before or after, adjust their score.

Kinds: the base kinds ``email ip card phone`` are decided by pattern and checksum alone; their score
only says how sure a span is. ``iban`` (mod 97, the country's own length) and ``ssn`` (three-two-four digits) are added; an
``ssn`` has no checksum, so a context word must lift it over KEEP. Spans count code points, end
exclusive, leftmost and non-overlapping within a kind; kinds may overlap each other.

Every pattern is written so that it can't backtrack over a long run (possessive quantifiers, and a
start only where no longer match starts before), and finds exactly what the plain pattern finds. Positions are
summed in blocks and context is cut from pieces of the text, so that a very long text with very many matches costs little more than its length.

Null texts count as empty: no spans. An empty table gives no rows. Ties don't arise; repeated rows
give repeated results. Columns named like an output are replaced, others pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.shared import before_each, documents, let, sums_before

#: What a span of each kind looks like. A match starts where no run of its first class
#: reaches further back, or where the last match ended (\G).
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Length of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def _ibans() -> str:
    """The countries of each length, each with as many letters and digits as its length asks for."""
    by: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by.setdefault(n, []).append(country)
    return "(?:" + "|".join(rf"(?:{'|'.join(c)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(by.items())) + ")"


IBAN = rf"(?<![A-Za-z0-9]){_ibans()}(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BYTE_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
#: Words that make a kind likelier when one begins within CONTEXT characters before the span, or within as many after it.
WORDS = {
    "email": "e-?mail|contact|write to|courriel|correo",
    "ip": "ip|host|server|address|login",
    "card": "card|visa|mastercard|amex|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax|t[ée]l[ée]phone|telefon",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id|taxpayer",
}
CONTEXT = 48
#: Code points of a piece of a text, from which context is cut.
PIECE = 4096
#: Score of a confirmed span without and with a context word; an added kind stays from KEEP on.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.4}
LIFT, KEEP = 0.3, 0.6
BASE, KINDS = ("email", "ip", "card", "phone"), ("email", "ip", "card", "phone", "iban", "ssn")


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.filter(F.split(F.reverse(number), ""), lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int") / 10).cast("int") + 2 * d.cast("int") % 10))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's check digits hold: moved to the end, letters as 10 to 35, the number is 1 modulo 97."""
    flat = F.regexp_replace(iban, " ", "")
    moved = F.filter(F.split(F.concat(flat.substr(F.lit(5), F.length(flat)), flat.substr(1, 4)), ""), lambda c: c != "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda a, c: F.when(value(c) < 10, a * 10 + value(c)).otherwise(a * 100 + value(c)) % 97) == 1


#: kind: (pattern, what a text with a match must contain at least, confirmation of a match)
RULES = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda v: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), lambda v: v.rlike(BYTE_PARTS)),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda v: F.when(F.length(digits(v)).between(13, 19), luhn(digits(v))).otherwise(False)),
    "phone": (PHONE, lambda t: t.contains("+"), lambda v: F.length(digits(v)).between(9, 15)),
    "iban": (IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), lambda v: mod97(v)),
    "ssn": (SSN, lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$")),
}
SPAN = "struct<kind:string,start:int,end:int,score:double>"


def near(pieces: Column, start: Column, end: Column, kind: str) -> Column:
    """Whether a context word of the kind begins close to the span. ``pieces``: the text in pieces of PIECE code points."""

    def part(first: Column) -> Column:
        """CONTEXT code points from ``first``, counted from 0, which may begin before the text."""
        at = F.greatest(first, F.lit(0))
        k = F.floor(at / PIECE).cast("int")
        both = F.concat(F.coalesce(F.get(pieces, k), F.lit("")), F.coalesce(F.get(pieces, k + 1), F.lit("")))
        return F.lower(F.substr(both, at % PIECE + 1, F.lit(CONTEXT) - (at - first)))

    word = lambda text: text.rlike(rf"(?:^|[^a-z])(?:{WORDS[kind]})")
    return word(part(start - CONTEXT)) | word(part(end))


def spans_of(text: Column, kind: str) -> Column:
    """array<SPAN> of one kind. The text is cut at the matches; lengths of cuts and matches add up to the positions."""
    pattern, may, holds = RULES[kind]
    cuts, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = lambda x: F.transform(x, lambda m: m["gap"] + F.length(m["value"]))

    def placed(both: Column) -> Column:
        put = F.zip_with(both, sums_before(lengths(both)), lambda m, before: F.struct((before + m["gap"]).alias("start"), (before + m["gap"] + F.length(m["value"])).alias("end"), m["value"].alias("value")))
        return F.filter(put, lambda s: holds(s["value"]))

    def scored(spans: Column) -> Column:
        of = lambda pieces: F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.least(F.lit(1.0), F.lit(PRIOR[kind]) + F.when(near(pieces, s["start"], s["end"], kind), LIFT).otherwise(0.0)).alias("score")))
        return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), of)).otherwise(none)

    none = F.array().cast(f"array<{SPAN}>")
    # There is one more cut than matches: what follows the last one.
    both = F.filter(F.zip_with(cuts, matches, lambda c, m: F.struct(F.length(c).alias("gap"), m.alias("value"))), lambda x: x["value"].isNotNull())
    found = let(let(both, placed), scored)
    kept = found if kind in BASE else F.filter(found, lambda s: s["score"] >= KEEP)
    return F.when(may(text), kept).otherwise(none)


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """df with ``out`` array<SPAN>: spans by kind as in KINDS, then by start."""
    rest = [F.col(c) for c in df.columns if c != out]
    whole = df.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("__pii_text"))
    each = whole.select(*rest, *[spans_of(F.col("__pii_text"), k).alias(f"__pii_{k}") for k in KINDS])
    return each.select(*rest, F.concat(*[F.col(f"__pii_{k}") for k in KINDS]).alias(out))


def redact(df: DataFrame, text: str = "text", spans: str = "pii") -> DataFrame:
    """df with the spans of ``text`` replaced by [KIND]; overlapping spans go together, under the first one's kind.

    Spans that overlap are merged from the left; then what is kept before each merged span is cut out of the text's pieces.
    """
    ordered = F.sort_array(F.transform(F.col(spans), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def merged(own: Column) -> Column:
        """(start, kind, from): spans that begin no earlier than all before them end, with where the kept text before each begins; last the text's end."""

        def heads(reach: Column) -> Column:
            each = F.zip_with(own, reach, lambda s, r: F.when(s["start"] >= r, F.struct(s["start"].alias("start"), s["kind"].alias("kind"), r.alias("from"))))
            rest = F.struct(F.length(F.col(text)).alias("start"), F.lit(None).cast("string").alias("kind"), F.array_max(F.transform(own, lambda s: s["end"])).alias("from"))
            return F.concat(F.filter(each, lambda x: x.isNotNull()), F.array(rest))

        return let(before_each(F.transform(own, lambda s: s["end"]), lambda a, b: F.greatest(a, b)), heads)

    def cleaned(pieces: Column) -> Column:
        kept = lambda a, b: F.concat_ws("", F.transform(F.sequence(F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")), lambda k: F.coalesce(F.substr(F.get(pieces, k), F.greatest(a - k * PIECE, F.lit(0)) + 1, F.least(b - k * PIECE, F.lit(PIECE)) - F.greatest(a - k * PIECE, F.lit(0))), F.lit(""))))
        return F.concat_ws("", F.transform(let(ordered, merged), lambda s: F.concat(kept(s["from"], s["start"]), F.when(s["kind"].isNull(), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))))

    whole = let(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), cleaned)
    return df.withColumn(text, F.when(F.size(spans) > 0, whole).otherwise(F.col(text)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pii")
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k))
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[count(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.coalesce(F.array_max(F.transform("pii", lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def _plain(kind: str) -> str:
    """A kind's pattern without look-around and possessive marks, which DuckDB's linear-time engine needs none of."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+){3}",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": PHONE,
        "iban": _ibans(),
        "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    }
    return plain[kind]


_EACH = "SELECT doc_id, t, '{k}' AS kind, {n} AS o, {prior}::DOUBLE AS prior, '{words}' AS words, regexp_extract_all(t, '{p}') AS v, string_split_regex(t, '{p}') AS g FROM d"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_EACH.format(k=k, n=n, prior=PRIOR[k], words=WORDS[k], p=_plain(k)) for n, k in enumerate(KINDS))}),
s AS (SELECT doc_id, t, kind, o, prior, words, v[i] AS x, g[i] AS gap, g[i + 1] AS rest, list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda y: length(y))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m WHERE len(v) > 0)),
n AS (SELECT *, start + length(x) AS stop, regexp_replace(x, '[^0-9]', '', 'g') AS digits, least(1.0, prior + CASE WHEN regexp_matches(lower(substr(t, greatest(start - {CONTEXT}, 0)::BIGINT + 1, least(start, {CONTEXT})::BIGINT)), '(?:^|[^a-z])(?:' || words || ')')
    OR regexp_matches(lower(substr(t, (start + length(x))::BIGINT + 1, {CONTEXT})), '(?:^|[^a-z])(?:' || words || ')') THEN {LIFT} ELSE 0 END)::DOUBLE AS score FROM s),
k AS (SELECT * FROM n WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(x, '.'), lambda y: coalesce(try_cast(y AS HUGEINT) <= 255, false)))
  WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN reverse(digits)[i]::INT ELSE (2 * reverse(digits)[i]::INT) // 10 + (2 * reverse(digits)[i]::INT) % 10 END)) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
  WHEN 'iban' THEN NOT regexp_matches(right(gap, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(rest, 1), '[A-Za-z0-9]')
    AND list_reduce(list_transform(string_split(substr(replace(x, ' ', ''), 5) || left(x, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, b: CASE WHEN b < 10 THEN a * 10 + b ELSE a * 100 + b END % 97, 0) = 1
  ELSE NOT regexp_matches(right(gap, 1), '[0-9-]') AND NOT regexp_matches(left(rest, 1), '[0-9-]') AND NOT regexp_matches(x, '^(?:000|666|9)|-00-|-0000$') END
  AND (o < {len(BASE)} OR score >= {KEEP})),
w AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in BASE)}, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) FILTER (o < {len(BASE)}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY o, start) AS spans, max(score) AS top FROM k GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{b}, 0)::BIGINT AS n_{b}" for b in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(top, 0.0)::DOUBLE AS top_score FROM d LEFT JOIN w USING (doc_id)
"""
