"""Licence scan by canonical digest: a whole text, or a whole line of it, is normalised and
its digest is hash-joined to the digests of known licence texts.

Normalising: lower case, copyright lines dropped, equivalent spellings made one, everything
but a-z and 0-9 made single spaces. A unit is only normalised if it holds a word that every
known text holds one of, which cannot lose a match. The table of known digests is built from
the lists in ``license_texts`` (a fixed size), so it may be broadcast; the SQL has the same
texts, digests and patterns.

Nulls and ties: a null text is empty and matches nothing. Rows that agree in id and text are
one document; a null id is an id like others. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import KNOWN, WHOLE
from .shared import read

#: Spellings that count as one, as patterns over lower-case text.
SPELLINGS = [
    ("licence", "license"), ("licencing", "licensing"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"),
    ("non-commercial", "noncommercial"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("copyright owner", "copyright holder"), ("merchantibility", "merchantability"), ("whilst", "while"),
]
#: Lines that name holders after a sign, with or without a year. A sign alone, "(c) You must",
#: may begin a list's item and needs a year.
HOLDER_LINE = "(^|\\n)[^a-z0-9\\n]*(copyright ?(\\(c\\)|©)|copyright [0-9]|\\(c\\) [0-9]|©)[^\\n]*"
#: Each known text holds one of these after normalising; so do the spellings it stands for.
ANCHORS = "(?i)licen|permission|redistribution|rights"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), HOLDER_LINE, "\n")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def digest(text: Column, anchored: bool = True) -> Column:
    """md5 of the canonical text; ``anchored``: null where it cannot be one of the known texts."""
    found = F.md5(canonical(text).cast("binary"))
    return F.when(F.regexp_like(text, F.lit(ANCHORS)), found) if anchored else found


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """Digest and name of every known text; the first name in order where texts agree."""
    rows = spark.createDataFrame(list((KNOWN if texts is None else texts).items()), "license string, known_text string")
    return rows.groupBy(F.md5(canonical(F.col("known_text")).cast("binary")).alias("digest")).agg(F.min("license").alias("license"))


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, text_license (of the whole text), line_licenses (names found in lines, sorted,
    joined by commas) and n_license_lines of every document. ``texts``: look for these (by
    name) in place of the known ones; every unit is then normalised, as they may be any text."""
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    possible = F.regexp_like("text", F.lit(ANCHORS)) if texts is None else F.lit(True)
    lines = F.when(possible, F.concat(F.array(F.struct(F.lit(True).alias("whole"), F.col("text").alias("unit"))), F.transform(F.split("text", "\n"), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("unit")))))
    units = own.select("doc_id", F.xxhash64("text").alias("text_key"), F.explode_outer(lines).alias("u"))
    units = units.select("doc_id", "text_key", "u.whole", digest(F.col("u.unit"), texts is None).alias("digest"))
    names = known(docs.sparkSession, texts)
    if texts is None:  # of longer texts only digests are held
        names = names.unionByName(docs.sparkSession.createDataFrame([(d, k) for k, own in WHOLE.items() for d in own], "digest string, license string"))
    hits = units.join(F.broadcast(names), "digest", "left")
    found = hits.groupBy("doc_id", "text_key").agg(
        F.max(F.when(F.col("whole"), F.col("license"))).alias("text_license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license")))), ",").alias("line_licenses"),
        F.count(F.when(~F.col("whole"), F.col("license"))).alias("n_license_lines"),
    )
    return found.drop("text_key")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{HOLDER_LINE}', chr(10), 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, '{old}', '{new}')"
    return f"md5(trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g')))"


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


SQL = f"""
WITH known(digest, license) AS (SELECT {_sql_canonical('t')} AS digest, min(license) AS license FROM (VALUES {', '.join(f'({_sql_text(k)}, {_sql_text(v)})' for k, v in KNOWN.items())}) AS k(license, t) GROUP BY 1 UNION ALL VALUES {', '.join(f'({_sql_text(x)}, {_sql_text(k)})' for k, own in WHOLE.items() for x in own)}),
d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT doc_id, text, true AS whole, text AS unit FROM d UNION ALL SELECT doc_id, text, false, unnest(string_split(text, chr(10))) FROM d),
h AS (SELECT u.doc_id, u.text, whole, license FROM u LEFT JOIN known ON known.digest = {_sql_canonical('u.unit')})
SELECT doc_id, max(license) FILTER (WHERE whole) AS text_license,
  coalesce(string_agg(DISTINCT license, ',' ORDER BY license) FILTER (WHERE NOT whole AND license IS NOT NULL), '') AS line_licenses,
  count(license) FILTER (WHERE NOT whole) AS n_license_lines
FROM h GROUP BY doc_id, text
"""
