"""License scans by canonical digest lookup.

A whole text is brought to a canonical form and its SHA-256 is looked up among
those of known licences with one hash join. The canonical form:

* A-Z lower-cased;
* lines that only name a copyright holder, and lines that only say all rights are reserved, left out;
* everything but letters and digits made one space, the ends trimmed;
* equivalent spellings replaced by one of them, http for https.

All steps are DataFrame expressions; texts are never joined, only digests.
The known licences are files of this package (one row each, so broadcast); a
table of one's own, of any size, can be given instead.

Defined results: null is the empty text; texts that nothing is left of have
no digest and match nothing; if several licences have one digest, the first
by name is given; repeated rows agree; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from capaflow.llm.common import kept_beside
from capaflow.llm.fingerprints import ASCII_LOWER, ASCII_UPPER

HOLDER_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright[ \t]*(?:\(c\)|©|:|<|\[|[0-9]{4})|\(c\)|©)[^\n]*"
RESERVED_LINE = r"(?m)^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
BETWEEN = r"[^\p{L}\p{N}]+"

# Equivalent spellings (British or split, then the one used here), after punctuation is gone.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"),
    ("licenced", "licensed"), ("maximise", "maximize"),
    ("modelled", "modeled"), ("modelling", "modeling"), ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"),
    ("organise", "organize"), ("per cent", "percent"), ("practise", "practice"), ("programme", "program"),
    ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
)


def canonical(text: Column) -> Column:
    """Canonical form of a text column."""
    low = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_LOWER)
    low = F.regexp_replace(F.regexp_replace(low, HOLDER_LINE, ""), RESERVED_LINE, "")
    low = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, BETWEEN, " ")), F.lit(" "))
    low = reduce(lambda c, s: F.replace(c, F.lit(f" {s[0]} "), F.lit(f" {s[1]} ")), SPELLINGS, low)
    return F.trim(low)


def digest(text: Column) -> Column:
    form = canonical(text)
    return F.when(form != "", F.sha2(form.cast("binary"), 256))


def known_texts() -> list[tuple[str, str]]:
    """(licence, text) of the package's licence files."""
    found = [(f.name.removesuffix(".txt"), f.read_text("utf-8"))
             for f in files("capaflow.llm").joinpath("licence_texts").iterdir() if f.name.endswith(".txt")]
    return sorted(found)


def known_licences(spark: SparkSession) -> DataFrame:
    """(licence, text): one row per file of the package."""
    return spark.createDataFrame(known_texts(), "licence string, text string")


def scan(docs: DataFrame, known: DataFrame | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the kept columns, digest and licence (null if the whole text is none that is known)."""
    keep = kept_beside(keep, ("digest", "licence"))
    own = known is None
    known = known_licences(docs.sparkSession) if own else known
    table = (known.select("licence", digest(F.col("text")).alias("digest")).where("digest is not null")
             .groupBy("digest").agg(F.min("licence").alias("licence")))
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], digest(F.col(f"`{text}`")).alias("digest"))
    return (rows.join(F.broadcast(table) if own else table, "digest", "left")
            .select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "digest", "licence"))


def oracle_sql() -> str:
    """The scan of ``documents`` in DuckDB SQL, licence texts included."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(n)}, {quote(t)})" for n, t in known_texts())
    form = f"translate(coalesce(t, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')"
    for pattern in (HOLDER_LINE, RESERVED_LINE):
        form = f"regexp_replace({form}, {quote(pattern)}, '', 'g')"
    form = f"' ' || trim(regexp_replace({form}, {quote(BETWEEN)}, ' ', 'g')) || ' '"
    for a, b in SPELLINGS:
        form = f"replace({form}, ' {a} ', ' {b} ')"
    return f"""
        WITH known(licence, t) AS (VALUES {known}),
        texts AS (SELECT licence, NULL::BIGINT AS doc_id, t FROM known UNION ALL SELECT NULL, doc_id, text FROM documents),
        forms AS (SELECT licence, doc_id, trim({form}) AS form FROM texts),
        digests AS (SELECT licence, doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM forms),
        found AS (SELECT digest, min(licence) AS licence FROM digests WHERE licence IS NOT NULL GROUP BY 1)
        SELECT d.doc_id, d.digest, f.licence FROM digests d LEFT JOIN found f USING (digest) WHERE d.licence IS NULL"""
