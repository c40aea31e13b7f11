r"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans.  Several labelers (the strict pattern, checks of form,
gazetteers, context words, borders) vote on every span or abstain.
Expectation-maximisation over the counts of vote patterns estimates how far each
labeler can be trusted, after Dawid and Skene (1979); the resulting soft labels
train a naive Bayes classifier on features of the span, which decides on what the
strict patterns don't already cover.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import settle

KINDS = ("email", "ip", "card", "phone")

# Strict patterns.  Possessive loops and the looks behind leave the leftmost matches as they
# are; they keep long runs without a match from being tried again at every character.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns: written-out addresses, dotted card numbers, numbers without a plus sign.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,63}\x20?(?:[\[({]dot[\])}]|\.)\x20?[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "card": r"(?<![0-9.])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9./])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}

ENDINGS = "com org net edu gov io info biz de fr es it uk us eu nl ch at be pt pl br mx jp cn in ca au".split()
CALLING_CODES = "1 7 20 27 30 31 32 33 34 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 61 62 64 65 81 82 86 90 91".split()
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(ip|host|server|address|adresse|login|from)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(phone|tel|call|fax|mobile|cell|whatsapp|telefon|téléphone|teléfono)\b",
}
AGAINST = r"(?i)(\b(version|isbn|issn|doi|ref|order|build|serial|no|nr|id|sha|sku)\b|=|#|/|\$)[\x20:.]*$"
LABELERS = ("pattern", "form", "gazetteer", "context", "border")
#: Characters of context before a span.
CONTEXT = 24
THRESHOLD = 0.5


def _hits(text: Column, pattern: str) -> Column:
    """All matches from left to right as structs of begin, end (code points) and text.

    The pieces between matches and the matches alternate, so their lengths add up
    to the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    empty = F.array().cast("array<struct<begin:int,end:int,hit:string>>")

    def add(done: Column, pair: Column) -> Column:
        begin = done["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["hit"])
        span = F.struct(begin.alias("begin"), end.alias("end"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(done["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("spans"))
    return F.aggregate(pairs, start, add, lambda done: done["spans"])


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit fits."""
    def value(digit: Column, place: Column) -> Column:
        d = digit.cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(place % 2 == 1, doubled).otherwise(d)

    figures = F.filter(F.split(F.reverse(digits), ""), lambda d: d != "")
    return F.aggregate(F.transform(figures, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def _octets_fit(hit: Column) -> Column:
    parts = F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))


def fits(kind: str, hit: Column) -> Column:
    """The checks that a match of the strict pattern must pass."""
    digits = _digits(hit)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _octets_fit(hit)
    if kind == "card":
        return F.length(digits).between(14, 19) & luhn(digits)
    return F.length(digits).between(10, 15)


def _vote(yes: Column, no: Column | None = None) -> Column:
    """1, -1 or 0 (abstains); without ``no`` it never abstains."""
    against = ~yes if no is None else no
    return F.when(yes, F.lit(1)).when(against, F.lit(-1)).otherwise(F.lit(0))


def _votes(kind: str, span: Column, text: Column, strict: bool) -> Column:
    hit, digits = span["hit"], _digits(span["hit"])
    before = F.substring(text, F.greatest(span["begin"] - CONTEXT + 1, F.lit(1)), F.least(span["begin"], F.lit(CONTEXT)))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    if kind == "email":
        form = F.length(hit).between(6, 80)
        known = F.lower(F.regexp_extract(hit, r"([A-Za-z]+)$", 1)).isin(ENDINGS)
    elif kind == "ip":
        form = _octets_fit(hit)
        known = ~hit.rlike(r"^(0|127|255)\.")
    elif kind == "card":
        form = luhn(digits)
        known = digits.rlike("^[3-6]")
    else:
        form = F.length(digits).between(10, 15)
        known = digits.rlike("^(" + "|".join(CALLING_CODES) + ")") if strict else ~digits.rlike("^[01]")
    return F.array(
        F.lit(1 if strict else 0),
        _vote(form),
        _vote(known),
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST)),
        _vote(~F.coalesce(before.rlike(r"[A-Za-z0-9_]$"), F.lit(False)) & ~F.coalesce(after.rlike(r"[A-Za-z0-9_]"), F.lit(False))),
    ).cast("array<int>")


def _features(kind: str, span: Column, text: Column) -> Column:
    hit = span["hit"]
    digits = F.length(_digits(hit))
    before = F.substring(text, F.greatest(span["begin"], F.lit(1)), F.least(span["begin"], F.lit(1)))
    after = F.substring(text, span["end"] + 1, F.lit(1))

    def sort_of(c: Column) -> Column:
        return (
            F.when(F.coalesce(F.length(c), F.lit(0)) == 0, "edge").when(c.rlike(r"\s"), "space").when(c.rlike(r"[0-9]"), "digit")
            .when(c.rlike(r"[A-Za-z]"), "letter").otherwise("sign")
        )

    named = {
        "digits": F.least(digits, F.lit(20)).cast("string"),
        "length": F.least(F.floor(F.length(hit) / 4), F.lit(12)).cast("string"),
        "before": sort_of(before),
        "after": sort_of(after),
        "signs": F.substring(F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(hit, r"[A-Za-z0-9]", ""), ""))), ""), 1, 6),
    }
    return F.array(*[F.concat(F.lit(f"{kind} {n} "), F.regexp_replace(v, r"[^\x20-\x7E]", "?")) for n, v in named.items()])


def candidate_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id`` and ``spans``: every proposed span with its votes and features; no text but the spans' is kept."""
    body = F.coalesce(docs[text], F.lit(""))
    narrow = docs.select(docs[doc_id].alias("doc_id"), body.alias("_text"))
    text_ = F.col("_text")
    numeric = text_.rlike("[0-9]")
    gates = {
        ("email", True): text_.contains("@"), ("ip", True): numeric, ("card", True): numeric, ("phone", True): text_.contains("+"),
        ("email", False): text_.rlike(r"[\[({]at[\])}]"), ("card", False): numeric, ("phone", False): numeric,
    }
    none = "array<struct<begin:int,kind_no:int,end:int,strict:boolean,votes:array<int>,features:array<string>>>"

    def proposed(kind: str, strict: bool) -> Column:
        hits = _hits(text_, (STRICT if strict else WIDE)[kind])
        hits = F.filter(hits, lambda s: fits(kind, s["hit"])) if strict else hits
        return F.transform(
            hits,
            lambda s: F.struct(
                s["begin"].alias("begin"), F.lit(KINDS.index(kind)).alias("kind_no"), s["end"].alias("end"), F.lit(strict).alias("strict"),
                _votes(kind, s, text_, strict).alias("votes"), _features(kind, s, text_).alias("features"),
            ),
        )

    lists = [F.when(gate, proposed(*which)).otherwise(F.array().cast(none)) for which, gate in gates.items()]
    return narrow.select("doc_id", F.array_sort(F.concat(*lists)).alias("spans"))


def estimate(patterns: Sequence[tuple[Sequence[int], int]], rounds: int = 100) -> dict[tuple[int, ...], float]:
    """Probability that a span is personal data, for every vote pattern, by expectation-maximisation.

    ``patterns`` are distinct vote tuples with their numbers of spans, at most 3 to
    the number of labelers.  Every labeler starts, and is held by prior counts, as
    one that is right four times in five.
    """
    places = len(patterns[0][0]) if patterns else 0
    values = (-1, 0, 1)
    prior = {1: {-1: 0.1, 0: 0.1, 1: 0.8}, 0: {-1: 0.8, 0: 0.1, 1: 0.1}}
    chance = {c: [dict(prior[c]) for _ in range(places)] for c in (0, 1)}
    share, soft = 0.5, {}
    for _ in range(rounds):
        before = dict(soft)
        for votes, _n in patterns:
            log = {
                c: math.log(share if c else 1 - share) + sum(math.log(chance[c][k][v]) for k, v in enumerate(votes)) for c in (0, 1)
            }
            soft[tuple(votes)] = 1 / (1 + math.exp(min(700, log[0] - log[1])))
        total = sum(n for _, n in patterns)
        share = (sum(n * soft[tuple(v)] for v, n in patterns) + 5) / (total + 10)
        for c in (0, 1):
            weights = {tuple(v): n * (soft[tuple(v)] if c else 1 - soft[tuple(v)]) for v, n in patterns}
            mass = sum(weights.values())
            for k in range(places):
                for value in values:
                    got = sum(w for v, w in weights.items() if v[k] == value)
                    chance[c][k][value] = (got + 20 * prior[c][value]) / (mass + 20)
        if before and max(abs(soft[k] - before[k]) for k in soft) < 1e-9:
            break
    return soft


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``base`` and ``spans``, arrays of (begin, kind_no, end) by begin and kind.

    ``base`` holds the strict matches that pass their checks: leftmost and not
    overlapping within a kind, in code points with the end outside.  ``spans`` adds
    the wider candidates that the classifier accepts and that overlap no base
    span.  Null and empty texts have none; repeated rows are read one by one; an
    empty table gives an empty result.

    Spans are settled once, without texts.  What reaches the driver is one row per
    vote pattern (at most 3 to the 5) and one per feature value, which are
    bucketed; all spans of all documents count in both.
    """
    found = settle(candidate_spans(docs, doc_id, text))
    spans = found.select(F.explode("spans").alias("s"))
    patterns = [(tuple(r[0]), r[1]) for r in spans.groupBy("s.votes").agg(F.count(F.lit(1))).collect()]
    soft = estimate(patterns)
    if not soft:
        return _chosen(found, F.lit(False))
    label = F.lit(0.0)
    for votes, p in soft.items():
        label = F.when(F.col("s.votes") == F.array(*[F.lit(v) for v in votes]), F.lit(p)).otherwise(label)
    rows = spans.withColumn("p", label)
    yes, no = rows.agg(F.sum("p"), F.sum(1 - F.col("p"))).first()
    counts = rows.select("p", F.explode("s.features").alias("f")).groupBy("f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no"))
    table = counts.collect()
    kinds = len(table) + 1
    logs = {r["f"]: math.log((r["yes"] + 1) / (yes + kinds)) - math.log((r["no"] + 1) / (no + kinds)) for r in table}
    weights = F.create_map(*[F.lit(x) for pair in sorted(logs.items()) for x in pair])
    offset = math.log((yes + 1) / (no + 1))
    limit = math.log(threshold / (1 - threshold))
    return _chosen(found, lambda s: F.aggregate(s["features"], F.lit(offset), lambda a, f: a + F.coalesce(weights[f], F.lit(0.0))) >= limit)


def _chosen(found: DataFrame, accepts) -> DataFrame:
    base = F.filter("spans", lambda s: s["strict"])
    clear = lambda s: ~F.exists("base", lambda b: (b["begin"] < s["end"]) & (s["begin"] < b["end"]))
    extra = F.filter("spans", lambda s: ~s["strict"] & clear(s) & (accepts(s) if callable(accepts) else accepts))
    both = found.withColumn("base", base).withColumn("spans", F.array_sort(F.concat("base", extra)))
    plain = lambda s: F.struct(s["begin"].alias("begin"), s["kind_no"].alias("kind_no"), s["end"].alias("end"))
    return both.select("doc_id", F.transform("base", plain).alias("base"), F.transform("spans", plain).alias("spans"))


def as_text(spans: str) -> Column:
    """``kind:begin:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["begin"], s["end"])
    return F.array_join(F.transform(spans, one), ",")


def n_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind_no"] == KINDS.index(kind))).cast("long")
