"""Secrets in texts, and who else has them: ownership frequency over the corpus.

Candidates are spans of known shapes. The hash of each candidate's value is counted over the corpus: in how many
documents (repositories) and with how many owners it stands. What many owners have is a copied example; what one owner
alone has, and looks random, looks live. Spans of the strict patterns always stay; of the loose ones only those that
look live do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.spans import matches, rendered, sha, unblocked
from tidemark.session import materialize

#: the order of kinds in results; the first three are the strict ones
KINDS = ("assign", "access", "hex", "prefixed", "bearer", "private_key", "random")

#: white space between the lines of a key, also as escapes of a string
_GAP = r"(?:\s|\\[nr])"
#: a header, PEM fields, the lines of the key, a last short line, and the end
_PRIVATE_KEY = (
    r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"
    rf"(?:{_GAP}++[A-Za-z-]{{1,20}}:\x20[A-Za-z0-9,\x20-]++(?={_GAP}))*+(?:{_GAP}*+[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"(?:{_GAP}*+[A-Za-z0-9+/=]++(?={_GAP}*+-----END ))?+(?:{_GAP}*+-----END [A-Z ]{{0,20}}PRIVATE KEY-----)?+"
)
_ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]++)"
#: fixed values: patterns of the candidates, and a string each match holds
PATTERNS = {
    "assign": (_ASSIGN, None),
    "access": (r"AKIA[A-Z0-9]{16,}+", "AKIA"),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", None),
    "prefixed": (r"(?<![A-Za-z0-9_])(?:ghp_|gho_|github_pat_|glpat-|sk_live_|rk_live_|sk-|xox[abp]-|AIza|npm_)[A-Za-z0-9_-]{16,}+", None),
    "bearer": (r"(?<![A-Za-z])(?:Bearer|bearer)\x20+[A-Za-z0-9._~+/=-]{16,}+", "earer"),
    "private_key": (_PRIVATE_KEY, "PRIVATE KEY"),
    "random": (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+", None),
}
#: characters that the shortest header of a private key has
HEADER = len("-----BEGIN PRIVATE KEY-----")
#: a value that this many owners or more have is an example that was copied
COPIED_OWNERS = 3
#: different characters that a loose candidate needs at least, as a share of its length, and in all
MIXED = 12


def _value(kind: str, found: Column) -> Column:
    if kind == "assign":
        return F.regexp_extract(found, _ASSIGN, 1)
    if kind == "bearer":
        return F.regexp_replace(found, r"^\w+\x20+", "")
    if kind == "private_key":  # one key, however its lines are broken
        return F.regexp_replace(found, rf"{_GAP}++|-----END .*+", "")
    return found


def _strict(kind: str, value: Column) -> Column:
    return F.length(value) >= 6 if kind == "assign" else F.lit(kind in KINDS[:3])


def _random(value: Column) -> Column:
    """Letters of both cases and digits in a long word: no word of a language looks so."""
    kinds = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9]")
    return kinds & (F.size(F.array_distinct(F.split(value, ""))) >= MIXED)


def _candidate(kind: str, rank: int):
    def of(s: Column) -> Column:
        value = _value(kind, s["value"])
        return F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), _strict(kind, value).alias("base"),
            F.sha2(value, 256).alias("hash"), (F.lit(kind in ("prefixed", "private_key")) | _random(value)).alias("random"),
        )

    return of


def candidates(text: Column) -> Column:
    """All candidate spans: array of (start, rank, end, kind, base, hash); strict assigns that are too short are left out."""
    # runs of 24 characters and more are rare; without one, or a key word, there is nothing to search for
    long_run = text.rlike("[A-Za-z0-9+/_=-]{24}")
    out = []
    for rank, kind in enumerate(KINDS):
        pattern, needs = PATTERNS[kind]
        found = matches(text, pattern, needs)
        if kind in ("hex", "random"):
            found = F.when(long_run, found).otherwise(F.expr("cast(array() as array<struct<start: long, end: long, value: string, before: string, after: string>>)"))
        each = F.transform(found, _candidate(kind, rank))
        out.append(F.filter(each, lambda c: c["base"]) if rank < 3 else F.filter(each, lambda c: c["random"]))
    return F.concat(*out)


def ownership(spread: DataFrame) -> DataFrame:
    """(hash, n_documents, n_owners) from rows (hash, owner, document); repeated rows count once.

    Counted in steps, each with sums made before the shuffle, so that a value that all have meets in no task. Rows
    without an owner share one.
    """
    once = spread.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), "document").distinct()
    by_owner = once.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_documents"), F.count("*").alias("n_owners"))


def scan(docs: DataFrame, *, id_col: str = "doc_id", owner_col: str = "source", text_col: str = "text") -> DataFrame:
    """(row, doc_id, secrets) of every row; a secret is (start, rank, end, kind, base, n_documents, n_owners, verdict).

    The verdict is `copied` where COPIED_OWNERS or more have the value, else `live`, however many documents of one owner
    hold it. A null or empty text has none, and a null id stays; a repeated row with the same
    id is one document.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"),
        candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("found"),
    )
    kept = materialize(rows, "secrets")
    each = kept.where(F.size("found") > 0).select("row", "doc_id", "owner", F.explode("found").alias("c"))
    known = ownership(each.select(F.col("c.hash").alias("hash"), "owner", F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.col("row"))).alias("document")))
    judged = each.withColumn("hash", F.col("c.hash")).join(known, "hash").withColumn("verdict", F.when(F.col("n_owners") >= COPIED_OWNERS, "copied").otherwise("live"))
    judged = judged.where(F.col("c.base") | (F.col("verdict") == "live"))
    secret = F.struct(*(F.col(f"c.{x}").alias(x) for x in ("start", "rank", "end", "kind", "base")), "n_documents", "n_owners", "verdict")
    by_row = judged.groupBy("row").agg(F.collect_list(secret).alias("secrets"))
    kind = by_row.schema["secrets"].dataType.simpleString()
    # where spans overlap, strict ones and then the kinds listed first prevail over others
    # a key is hidden by what covers its header, not by what looks strict in its lines
    def until(s: Column) -> Column:
        return F.when(s["kind"] == "private_key", F.least(s["end"], s["start"] + HEADER)).otherwise(s["end"])

    lone = F.array_sort(unblocked(F.col("secrets"), len(KINDS), until))
    return kept.select("row", "doc_id").join(by_row, "row", "left").withColumn("secrets", F.coalesce(lone, F.expr(f"cast(array() as {kind})")))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by strict kind, the digest of the strict spans, all spans, and how many look live or copied."""
    def short(spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    def count(field: str, value: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s[field] == value)).cast("long").alias(f"n_{value}")

    base = F.filter("secrets", lambda s: s["base"])
    return scanned.select(
        "doc_id", *(count("kind", k) for k in KINDS[:3]), sha(rendered(short(base))).alias("base_sha256"), rendered(short(F.col("secrets"))).alias("spans"),
        *(count("verdict", v) for v in ("live", "copied")),
    )
