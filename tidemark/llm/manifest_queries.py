"""The registered query of the Merkle manifest and its SQL."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import manifest
from tidemark.llm.cluster import read_table

#: one row in so many, by its id's checksum, is tampered with
TAMPERED = 5
#: levels below and above the subroots that the SQL spells out: 16^6 leaves
SQL_LEVELS = 6


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, subroot and root, the digest of its proof, and the root its (partly tampered) leaf folds to."""
    docs = read_table(spark, sf_dir, "documents")
    lower = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0, lower).otherwise(F.col("text"))
    offered = manifest.leaf_digest([changed if f == "text" else F.col(f) for f in manifest.FIELDS])
    rows = manifest.manifest(docs, also={"offered": offered})
    folded = rows.withColumn("proof_sha256", manifest.proof_digest(F.col("path"))).withColumn("folded_root", manifest.fold(F.col("offered"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql() -> str:
    """Level by level: `base` holds the leaves; each run's slots are joined in order by string_agg."""
    def field(name: str) -> str:
        return f"coalesce(octet_length(encode(CAST({name} AS VARCHAR)))::VARCHAR || ':' || CAST({name} AS VARCHAR), '-')"

    others = [field(f) for f in manifest.FIELDS if f != "text"]
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    bits = "list_reduce([reg, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    parts = [f"""
crc AS (
  SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295::UBIGINT, [unicode(c)::UBIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
    lambda reg0, byte: {bits.replace("[reg,", "[xor(reg0, byte),").replace("0, 0,", "0::UBIGINT, 0,")}), 4294967295::UBIGINT) AS crc
  FROM documents WHERE doc_id IS NOT NULL),
hashed AS (
  SELECT doc_id, source, sha256({' || '.join([*others, field('text')])}) AS leaf,
    sha256({' || '.join(others)} || CASE WHEN crc % {TAMPERED} = 0 THEN {field(lower)} ELSE {field('text')} END) AS offered
  FROM documents LEFT JOIN crc USING (doc_id)),
base AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, coalesce(source, '') AS s, source IS NOT NULL AS h FROM hashed),
a0 AS (SELECT h, s, pos, count(*) OVER (PARTITION BY h, s) AS n, leaf AS d FROM base)"""]

    def levels(prefix: str, keys: str) -> None:
        for i in range(SQL_LEVELS):
            parts.append(f"""
{prefix}{i + 1} AS (
  SELECT {keys}, pos // {manifest.FANOUT} AS pos, CAST(ceil(max(n) / {manifest.FANOUT}) AS BIGINT) AS n,
    CASE WHEN max(n) = 1 THEN max(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {prefix}{i} GROUP BY {keys}, pos // {manifest.FANOUT})""")

    levels("a", "h, s")
    parts.append(f"""
tops AS (SELECT h, s, d AS subroot FROM a{SQL_LEVELS}),
b0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY h, s) - 1 AS pos, count(*) OVER () AS n, subroot AS d FROM tops)""")
    levels("b", "g")
    parts.append(f"""
ranked AS (SELECT h, s, subroot, row_number() OVER (ORDER BY h, s) - 1 AS top FROM tops),
placed AS (SELECT b.*, r.subroot, r.top, (SELECT d FROM b{SQL_LEVELS}) AS root FROM base b JOIN ranked r USING (h, s))""")
    # the state of a leaf on its way up: what it folds to, and the siblings met so far
    parts.append("""
u0 AS (SELECT *, offered AS f, '' AS sib FROM placed)""")
    step = 0
    for prefix, keys, at in (("a", "h, s", "pos"), ("b", "g", "top")):
        match = "x.h = u.h AND x.s = u.s" if prefix == "a" else "x.g = 0"
        for i in range(SQL_LEVELS):
            size = manifest.FANOUT ** i
            own = f"u.{at} // {size}"
            parts.append(f"""
k{step} AS (SELECT {keys}, pos // {manifest.FANOUT} AS run, max(n) AS n, list(d ORDER BY pos) AS ds FROM {prefix}{i} GROUP BY {keys}, pos // {manifest.FANOUT}),
u{step + 1} AS (
  SELECT u.* EXCLUDE (f, sib),
    CASE WHEN x.n = 1 THEN f ELSE sha256(array_to_string(x.ds[1:({own}) % {manifest.FANOUT}], '') || f || array_to_string(x.ds[({own}) % {manifest.FANOUT} + 2:], '')) END AS f,
    CASE WHEN x.n = 1 THEN sib ELSE sib || array_to_string(x.ds[1:({own}) % {manifest.FANOUT}], '') || array_to_string(x.ds[({own}) % {manifest.FANOUT} + 2:], '') END AS sib
  FROM u{step} u JOIN k{step} x ON {match} AND x.run = ({own}) // {manifest.FANOUT})""")
            step += 1
    return "WITH " + ",".join(parts) + f"""
SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, f AS folded_root, f = root AS verified FROM u{step}"""


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLES = {"op12_merkle_manifest": _sql()}
