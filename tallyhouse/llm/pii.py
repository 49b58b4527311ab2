"""Personal data in text: patterns propose, checksums confirm, context scores (DataFrame functions only).

A pattern's matches come from ``regexp_extract_all`` and the text between them from ``split``; the
running lengths of both, block by block, give each match's offsets in code points. The patterns are written with
possessive quantifiers and look-behinds, so that the time is linear in the length of a text; they
match exactly what the plain patterns of the same kind match.

Defined results: a null text is empty and has no spans; repeated rows each get their result; an empty
table gives an empty result; further columns are kept. The time grows in proportion to a text's length and matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The countries of the published registry of account numbers (ISO 13616), each with the length of its numbers.
ACCOUNT_LENGTHS = """
AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18
FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20
LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24
SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30
""".split()


def _account_pattern() -> str:
    """Account numbers by the length of their country, in one piece or in groups of four, in either case."""
    forms = []
    for size in sorted({int(one[2:]) for one in ACCOUNT_LENGTHS}):
        codes = "|".join(one[:2] for one in ACCOUNT_LENGTHS if int(one[2:]) == size)
        fours, rest = divmod(size - 4, 4)
        grouped = rf"(?:\x20[A-Z0-9]{{4}}){{{fours}}}" + (rf"\x20[A-Z0-9]{{{rest}}}" if rest else "")
        forms.append(rf"(?:{codes})[0-9]{{2}}(?:[A-Z0-9]{{{size - 4}}}|{grouped})")
    return rf"(?<![A-Za-z0-9])(?i:{'|'.join(forms)})(?![A-Za-z0-9])"


#: The pattern of each kind, in the order in which kinds sort at one place.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": _account_pattern(),
}
#: A character that every match of the kind holds: a text without it is not searched.
_MUST_HOLD = {"email": "@", "phone": "+"}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Words that raise a span's score when they stand within ``CONTEXT`` code points of it.
CONTEXT_WORDS = {
    "email": "mail|contact|write",
    "ip": r"\bip\b|address|host|server",
    "card": "card|visa|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|transfer",
}
CONTEXT = 40
#: Proposals whose spans are put in line at once; blocks are joined after.
BLOCK = 256
BASE_SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9}


def luhn_ok(digits: Column) -> Column:
    """Luhn check of a string of digits."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 1, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v) % 10 == 0


def mod97_ok(account: Column) -> Column:
    """Mod-97 check of an account number without spaces (letters count as 10 to 35)."""
    turned = F.concat(F.substring(account, 5, 100), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        # Leading zeros aside, a part of more than three digits is above 255.
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")).between(0, 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn_ok(digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97_ok(F.upper(F.regexp_replace(value, " ", "")))
    return F.lit(True)


def _proposals(kind: str, text: Column) -> tuple[Column, Column]:
    """The kind's matches in a text, and the texts between them (one more)."""
    must = text.contains(_MUST_HOLD[kind]) if kind in _MUST_HOLD else text.rlike("[0-9]")
    none = F.lit([]).cast("array<string>")
    return F.when(must, F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))).otherwise(none), F.when(must, F.split(text, PATTERNS[kind], -1)).otherwise(none)


def _judged(kind: str, pairs: Column) -> Column:
    """array<struct<skip, size, ok, score>> of pairs (gap, value, after): lengths, the check's result and the score by context.

    Context is ``CONTEXT`` code points on either side, read from the gaps and over one neighbouring match.
    """

    def one(p: Column, i: Column) -> Column:
        past, coming = F.get(pairs, i - 1), F.get(pairs, i + 1)
        tail, head = (lambda x: F.right(x, F.lit(CONTEXT))), (lambda x: F.left(x, F.lit(CONTEXT)))
        before = tail(F.concat_ws("", tail(past["gap"]), tail(past["value"]), tail(p["gap"])))
        behind = head(F.concat_ws("", head(p["after"]), head(coming["value"]), head(coming["after"])))
        near = F.lower(F.concat(before, F.lit("\n"), behind)).rlike(CONTEXT_WORDS[kind])
        ok = _valid(kind, p["value"])
        score = F.when(ok, F.least(F.lit(1.0), F.lit(BASE_SCORE[kind]) + F.when(near, F.lit(0.2)).otherwise(F.lit(0.0))))
        return F.struct(F.length(p["gap"]).alias("skip"), F.length(p["value"]).alias("size"), ok.alias("ok"), score.alias("score"))

    return F.transform(pairs, one)


def _blocks_of(judged: Column) -> Column:
    """array<struct<at, out>>: the length of each block of ``BLOCK`` proposals, and its confirmed spans from the block's begin."""
    empty = F.lit([]).cast("array<struct<start:int,end:int,score:double>>")

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["skip"]
        span = F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["score"].alias("score"))
        return F.struct((start + p["size"]).alias("at"), F.when(p["ok"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    return F.when(F.size(judged) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(judged) - 1) / BLOCK).cast("int")), lambda g: F.aggregate(F.slice(judged, g * BLOCK + 1, BLOCK), first, step)))


def _joined(kind: str, rank: int, blocks: Column) -> Column:
    """array<struct<start, rank, kind, end, score>> of all blocks of a text."""
    begins = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<int>").alias("all")), lambda a, g: F.struct((a["at"] + g["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
    moved = F.zip_with(blocks, begins, lambda g, at: F.transform(g["out"], lambda s: F.struct((s["start"] + at).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (s["end"] + at).alias("end"), s["score"].alias("score"))))
    none = F.lit([]).cast("array<struct<start:int,rank:int,kind:string,end:int,score:double>>")
    return F.coalesce(F.flatten(moved), none)


def find_spans(docs: DataFrame, name: str = "pii") -> DataFrame:
    """``docs`` and column ``name``: array<struct<start, rank, kind, end, score>> by start, then kind.

    Offsets are code points, the end exclusive. Matches that fail their check are dropped and not retried. A column of
    ``docs`` of that name is replaced. The steps are separate projections, so that no array is made twice.
    """
    docs = docs.drop(name)
    kept = [F.col(c) for c in docs.columns]
    text = F.coalesce(F.col("text"), F.lit(""))
    column = lambda step, kind: f"__pii_{step}_{kind}"
    now = docs.select(*kept, *[x.alias(column(step, kind)) for kind in PATTERNS for step, x in zip(("found", "between"), _proposals(kind, text), strict=True)])

    def paired(kind: str) -> Column:
        found, between = F.col(column("found", kind)), F.col(column("between", kind))
        gaps = F.zip_with(F.slice(between, 1, F.size(found)), F.slice(between, 2, F.size(found)), lambda x, y: F.struct(x.alias("gap"), y.alias("after")))
        return F.zip_with(gaps, found, lambda g, m: F.struct(g["gap"].alias("gap"), g["after"].alias("after"), m.alias("value")))

    steps = (("pairs", paired), ("judged", lambda kind: _judged(kind, F.col(column("pairs", kind)))), ("blocks", lambda kind: _blocks_of(F.col(column("judged", kind)))))
    for step, made in steps:
        now = now.select(*kept, *[made(kind).alias(column(step, kind)) for kind in PATTERNS])
    return now.select(*kept, F.array_sort(F.concat(*[_joined(kind, rank, F.col(column("blocks", kind))) for rank, kind in enumerate(PATTERNS)])).alias(name))


def redact(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """``docs`` with every span of at least ``least_score`` replaced by ``<KIND>``; overlapping spans yield to the first."""
    found = find_spans(docs, "__pii_spans")
    text = F.coalesce(F.col("text"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = lambda a, b: F.substring(text, a + 1, b - a)
    folded = F.aggregate(
        F.filter("__pii_spans", lambda s: s["score"] >= least_score),
        start,
        lambda a, s: F.when(s["start"] >= a["at"], F.struct(s["end"].alias("at"), F.concat(a["out"], cut(a["at"], s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))).otherwise(a),
    )
    done = found.withColumn("__r", folded)
    return done.withColumn("text", F.when(F.col("text").isNull(), None).otherwise(F.concat("__r.out", F.substring(text, F.col("__r.at") + 1, F.length(text))))).drop("__r", "__pii_spans")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans and all spans as text, from ``find_spans``."""
    named = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(named(base), 256).alias("base_sha256"),
        named(F.col("pii")).alias("spans"),
        count("iban").alias("n_iban"),
        F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"),
    )
