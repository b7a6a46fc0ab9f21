"""Personal data by weak supervision: labelers vote, expectation maximisation weighs them, a classifier decides.

Candidates are spans of loose patterns. On each, labelers vote for, against or not at all: the strict pattern with its
checksum or ranges, a gazetteer (top-level domains, issuers, dialling and country codes, reserved networks), the words
before the span, and the characters around it. How often each pattern of votes occurs is counted over the corpus; that
table has a fixed number of rows. EM on it gives each labeler's reliability and each pattern's chance to be personal
data, and these soft labels train a logistic classifier on votes and shape. Spans of the strict patterns always stay;
the classifier adds others.

All work on texts is DataFrame functions; the driver sees the table of counts only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import free_name
from tidemark.llm.spans import bound, cut_blocks, matches, part, rendered, running, sha, unblocked

#: the order of kinds in results; the first four are the strict ones
KINDS = ("email", "ip", "card", "phone", "email_spelled", "iban", "national_id", "phone_local")

#: fixed values: patterns of the candidates, and a string each match holds. Strict kinds are those of the contract, with
#: possessive repeats and a look-behind where that changes no match, so that long runs take linear time
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "email_spelled": (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(](?:at|AT)[\])]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?[\[(](?:dot|DOT)[\])]\x20?[A-Za-z0-9-]{1,63}+)++", None),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", None),
    "national_id": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-"),
    "phone_local": (r"(?<![0-9A-Za-z+.(-])\(?0[0-9]{1,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,4}(?![0-9])", None),
}
#: fixed values: gazetteers
TOP_DOMAINS = "com org net edu gov info io de fr es uk it nl at ch eu us ca mx ar co br pl se".split()
DIALLING = "1 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 61 64 81 86 90 91 351 352 353 358 420".split()
IBAN_COUNTRIES = "AD AT BE CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM".split()
#: fixed values: words before a span that speak for or against
FOR_WORDS = {
    "email": "mail|contact|kontakt|correo|courriel|write to|reach", "ip": r"\bip\b|host|server|address|adresse|client|login",
    "card": "card|karte|tarjeta|carte|visa|master|credit|payment", "phone": "tel|phone|call|mobil|handy|fax|contact|kontakt",
    "iban": "iban|account|konto|cuenta|compte|bank", "national_id": "ssn|social|insurance|tax id",
}
AGAINST_WORDS = r"version|release|isbn|issn|page|seite|chapter|section|figure|order no|serial|build|article|part no"


@dataclass(frozen=True)
class Model:
    """Weights of (kind, feature, value), and what EM found: chances of votes by labeler and truth."""

    weights: dict[str, float]
    reliability: dict[str, float]


LABELERS = ("pattern", "gazetteer", "context", "edges")
#: where a candidate counts as personal data
DECIDE = 0.5


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    doubled = F.transform(F.sequence(F.lit(0), F.length(digits) - 1), lambda i: F.substr(digits, i + 1, F.lit(1)).cast("int") * (F.lit(1) + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.floor(x / 10).cast("int") + x % 10) % 10 == 0


def _strict(kind: str, value: Column) -> Column:
    """Whether a match of the loose pattern is one of the strict kind."""
    n = F.length(_digits(value))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(value)).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(kind == "email")


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column) -> Column:
    value, before = s["value"], F.lower(s["before"])
    n = F.length(_digits(value))
    base = {"email_spelled": "email", "phone_local": "phone"}.get(kind, kind)
    strict = _strict(kind, value)
    if kind == "iban":  # the letters' values and the check digits would be a strict test; lengths are a fair one
        strict = F.length(F.regexp_replace(value, " ", "")).between(15, 31)
    elif kind == "national_id":
        strict = ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")
    elif kind == "email_spelled":
        strict = value.rlike(r"[\[(](?:dot|DOT)[\])]")
    elif kind == "phone_local":
        strict = n.between(9, 12)
    if base == "email":
        known = F.lower(F.regexp_extract(value, "([A-Za-z0-9-]+)$", 1)).isin(TOP_DOMAINS)
    elif base == "ip":
        known = ~value.rlike(r"^(?:0|127|22[4-9]|23[0-9]|24[0-9]|25[0-5])\.") & ~value.rlike(r"^0[0-9]")
    elif base == "card":
        known = _digits(value).rlike("^[3-6]")
    elif kind == "phone":
        known = value.rlike(rf"^\+(?:{'|'.join(DIALLING)})")
    elif base == "iban":
        known = F.substring(value, 1, 2).isin(IBAN_COUNTRIES)
    else:
        known = F.lit(None).cast("boolean")
    edge = F.substr(s["before"], F.length(s["before"]), F.lit(1)).rlike("[A-Za-z0-9]") | s["after"].rlike("[A-Za-z0-9]")
    return F.struct(
        _vote(strict, ~strict).alias("pattern"), _vote(known, ~known).alias("gazetteer"),
        _vote(before.rlike(FOR_WORDS[base]), before.rlike(AGAINST_WORDS)).alias("context"), _vote(~edge, edge).alias("edges"),
        F.least(F.floor(F.length(value) / 4), F.lit(8)).cast("int").alias("size"),
    )


def _candidate(kind: str, rank: int):
    def of(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            (_strict(kind, s["value"]) if rank < 4 else F.lit(False)).alias("base"), _votes(kind, s).alias("votes"),
        )

    return of


def candidates(text: Column) -> Column:
    """All candidate spans: array of (start, rank, end, kind, base, value, votes)."""
    # what every match of these kinds holds
    numbers = text.rlike("[0-9][ .-]?[0-9]")
    spelled = text.rlike(r"(?i)[\[(]at[\])]")
    out = []
    for rank, kind in enumerate(KINDS):
        pattern, needs = PATTERNS[kind]
        found = matches(text, pattern, needs)
        if kind not in ("email", "phone"):
            found = F.when(spelled if kind == "email_spelled" else numbers, found).otherwise(F.expr(_NO_SPANS))
        out.append(F.transform(found, _candidate(kind, rank)))
    return F.concat(*out)


_NO_SPANS = "cast(array() as array<struct<start: long, end: long, value: string, before: string, after: string>>)"


def count_votes(docs: DataFrame, text_col: str = "text") -> list[dict]:
    """How often each pattern of votes occurs for each kind: at most kinds * 3 ** labelers * sizes rows."""
    each = docs.select(F.explode(candidates(F.coalesce(F.col(text_col), F.lit("")))).alias("c"))
    names = [*LABELERS, "size"]
    counted = each.groupBy("c.kind", "c.base", *(F.col(f"c.votes.{n}").alias(n) for n in names)).agg(F.count("*").alias("n"))
    return [r.asDict() for r in counted.collect()]


def fit(rows: list[dict], rounds: int = 40, steps: int = 200) -> Model:
    """EM over the vote patterns, then a logistic classifier on its soft labels."""
    rows = sorted(rows, key=lambda r: tuple(str(r[k]) for k in ("kind", "base", *LABELERS, "size")))
    chance = {(name, vote, truth): (0.7 if vote * (1 if truth else -1) > 0 else 0.1 if vote else 0.2) for name in LABELERS for vote in (-1, 0, 1) for truth in (0, 1)}
    prior = dict.fromkeys(KINDS, 0.5)
    soft = [0.5] * len(rows)
    for _ in range(rounds):
        for i, r in enumerate(rows):
            yes = math.log(prior[r["kind"]]) + sum(math.log(chance[name, r[name], 1]) for name in LABELERS)
            no = math.log(1 - prior[r["kind"]]) + sum(math.log(chance[name, r[name], 0]) for name in LABELERS)
            # what passes a checksum or full pattern is known
            soft[i] = 0.99 if r["base"] else 1 / (1 + math.exp(min(50, max(-50, no - yes))))
        for kind in KINDS:
            own = [(r["n"], q) for r, q in zip(rows, soft, strict=True) if r["kind"] == kind]
            prior[kind] = min(0.95, max(0.05, (1 + sum(n * q for n, q in own)) / (2 + sum(n for n, _ in own))))
        for name in LABELERS:
            for truth in (0, 1):
                weight = {v: 1.0 for v in (-1, 0, 1)}
                for r, q in zip(rows, soft, strict=True):
                    weight[r[name]] += r["n"] * (q if truth else 1 - q)
                for v, w in weight.items():
                    chance[name, v, truth] = w / sum(weight.values())
    weights: dict[str, float] = {}
    total = sum(r["n"] for r in rows) or 1
    for step in range(steps):
        slope: dict[str, float] = {}
        for r, q in zip(rows, soft, strict=True):
            active = _features(r)
            p = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in active)))
            for f in active:
                slope[f] = slope.get(f, 0.0) + r["n"] / total * (q - p)
        for f, g in slope.items():
            weights[f] = weights.get(f, 0.0) * 0.999 + 4.0 * g / (1 + step / steps)
    return Model(weights, {f"{name}:{'right' if v * (2 * t - 1) > 0 else 'wrong'}:{t}": chance[name, v, t] for name in LABELERS for v in (-1, 1) for t in (0, 1)})


def _features(row: dict) -> list[str]:
    return [f"kind={row['kind']}", *(f"{name}={row[name]}" for name in LABELERS), f"size={row['kind']}:{row['size']}"]


def decided(found: Column, model: Model) -> Column:
    """The candidates that are kept: strict ones, and others the classifier takes for personal data."""
    table = F.create_map(*(F.lit(x) for f, w in sorted(model.weights.items()) for x in (f, float(w)))) if model.weights else F.expr("cast(map() as map<string, double>)")

    def weight(name: Column) -> Column:
        return F.coalesce(F.try_element_at(table, name), F.lit(0.0))

    def logit(c: Column) -> Column:
        votes = c["votes"]
        parts = [F.concat(F.lit("kind="), c["kind"]), *(F.concat(F.lit(f"{n}="), votes[n].cast("string")) for n in LABELERS), F.concat(F.lit("size="), c["kind"], F.lit(":"), votes["size"].cast("string"))]
        out = weight(parts[0])
        for part in parts[1:]:
            out = out + weight(part)
        return out

    bar = math.log(DECIDE / (1 - DECIDE))
    kept = F.filter(found, lambda c: c["base"] | (logit(c) >= bar))
    # where spans overlap, strict ones and then the kinds listed first prevail over added ones
    return unblocked(kept, len(KINDS))


def _short(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["base"].alias("base")))


_NONE = "cast(array() as array<struct<start: long, rank: int, end: long, kind: string, base: boolean>>)"


def find(docs: DataFrame, model: Model | None = None, *, text_col: str = "text", name: str = "pii") -> DataFrame:
    """The input's columns and `pii`, the spans (start, rank, end, kind, base) in order; code points, ends exclusive.

    A null or empty text has none. Without a model one is fitted on all texts first. An input column of that name is
    replaced.
    """
    model = model or fit(count_votes(docs, text_col))
    every = docs.withColumn(name, candidates(F.coalesce(F.col(text_col), F.lit(""))))
    return every.withColumn(name, F.when(F.size(name) > 0, F.array_sort(_short(decided(F.col(name), model)))).otherwise(F.expr(_NONE)))


def digest(found: DataFrame) -> DataFrame:
    """Counts by strict kind, the digest of the strict spans, and all spans, for each row of `find`."""
    base = F.filter("pii", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS[:4]), sha(rendered(base)).alias("base_sha256"), rendered(F.col("pii")).alias("spans"))


def redact(docs: DataFrame, model: Model | None = None, *, text_col: str = "text") -> DataFrame:
    """The input with each span's text replaced by its kind in brackets; spans that overlap are replaced as one.

    A null text stays null. `n_chars`, if there, is the new length.
    """
    text, name = F.col(text_col), free_name(docs, "pii")

    def replaced(x: Column) -> Column:
        # up to where the text is done with before each span; one that begins there or later stands for itself
        def told(s: Column, i: Column) -> Column:
            done = F.coalesce(F.get(x["ends"], i - 1), F.lit(0))
            return F.when(s["start"] < done, "").otherwise(F.concat(part(x["blocks"], done, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))

        tail = part(x["blocks"], F.element_at(x["ends"], -1), F.length(text).cast("long"))
        return F.concat(F.array_join(F.transform(x["spans"], told), ""), tail)

    ends = running(F.transform(F.col(name), lambda s: s["end"]), F.greatest)
    pieces = bound(F.struct(F.col(name).alias("spans"), ends.alias("ends"), cut_blocks(text).alias("blocks")), replaced)
    out = find(docs, model, text_col=text_col, name=name).withColumn(text_col, F.when(F.size(name) > 0, pieces).otherwise(text)).drop(name)
    return out.withColumn("n_chars", F.length(text_col).cast("long")) if "n_chars" in docs.columns else out
