"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame expressions only.

A sketch is the ascending array of the ``k`` least distinct 64-bit hashes of a
text's shingles. Sketches of parts merge into the sketch of the whole; two
sketches estimate resemblance and containment of their sets, one estimates the
number of distinct shingles. Up to ``k`` distinct shingles all of it is exact.

Defined results: white space separates words, A-Z is lower-cased; a text of
fewer words than a shingle has all its words as one; without words (or null) the
sketch is empty. Two empty sketches have likeness 1, an empty and another 0.
Repeated rows have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from capaflow.llm.common import SEPARATOR_PATTERN, staged

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SKETCH_SIZE = 128
SHINGLE_WORDS = 5
#: Half the range of the hashes, to place them between 0 and 1.
_HALF = 2.0**63


def with_sketch(df: DataFrame, text: str, out: str, k: int = SKETCH_SIZE, words: int = SHINGLE_WORDS) -> DataFrame:
    """``df`` with the sketch of a text column. Words are hashed once, shingles from the words' hashes.

    The steps are columns of their own: an array used inside a lambda must
    be computed before it, not once per element.
    """
    w, n = f"_w_{out}", f"_n_{out}"
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    hashes = F.transform(F.filter(F.split(lower, SEPARATOR_PATTERN), lambda x: x != ""), lambda x: F.xxhash64(x))
    df = df.withColumn(w, hashes).withColumn(n, F.size(w))
    index = F.sequence(F.lit(1), F.col(n) - F.lit(words - 1))
    full = F.transform(index, lambda i: F.xxhash64(*[F.element_at(F.col(w), i + j) for j in range(words)]))
    shingles = (F.when(F.col(n) >= words, full).when(F.col(n) > 0, F.array(F.xxhash64(F.col(w), F.col(n))))
                .otherwise(F.expr("cast(array() as array<bigint>)")))
    return df.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop(w, n)


def merged(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Sketch of the union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, key: list[str], sketch: str, k: int = SKETCH_SIZE) -> DataFrame:
    """Sketch of all rows of a key: the k least distinct hashes, found by hash, so that a hot key is spread."""
    each = df.select(*key, F.explode(sketch).alias("_h")).distinct()
    salt = F.pmod(F.xxhash64("_h"), F.lit(64))
    for group in ([*key, salt.alias("_salt")], key):
        part = each.groupBy(*group).agg(F.slice(F.sort_array(F.collect_set("_h")), 1, k).alias(sketch))
        each = part.select(*key, F.explode(sketch).alias("_h"))
    return part.select(*key, sketch)


def resemblance(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Share of the union's sketch that is in both sketches."""
    union = merged(a, b, k)
    both = F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_count(a: Column, k: int = SKETCH_SIZE) -> Column:
    """Number of distinct shingles: exact below k, else from the place of the k-th hash."""
    place = (F.element_at(a, -1).cast("double") + F.lit(_HALF)) / F.lit(2 * _HALF)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = SKETCH_SIZE) -> Column:
    """Share of a's shingles that are in b."""
    common = resemblance(a, b, k) * distinct_count(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), common / distinct_count(a, k)))


def packed(a: Column) -> Column:
    """A sketch as text: its hashes as 8 bytes each, base64."""
    return F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def with_next(docs: DataFrame, doc_id: str, text: str, carry, bucket_rows: int = 1000, most_buckets: int = 8192) -> DataFrame:
    """Rows (id, text, ..., next_*) with the values of the next document by ascending id, the last one's being the first.

    Ids are cut into buckets at quantiles, texts move once to their bucket,
    and a copy of the next bucket's first document ends each. No task sees more
    than its buckets. Null ids come first; equal ids follow each other by a hash of the text.
    ``carry(df)`` adds columns to be carried along; it runs after the move.
    """
    low = F.lit(-(2**63))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.withColumn("o", F.coalesce("id", low)).withColumn("tie", F.xxhash64("text"))
    ids = rows.select("o")
    n = min(most_buckets, max(1, ids.count() // bucket_rows))
    cuts = sorted(set(ids.select(F.col("o").cast("double")).approxQuantile("o", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    bucket = _place(F.col("o").cast("double"), cuts)
    rows = rows.withColumn("bucket", bucket)
    firsts = staged(rows.groupBy("bucket").agg(F.min(F.struct("o", "tie")).alias("f")), "fingerprint-firsts")
    order = Window.orderBy("bucket")
    before = F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(Window.partitionBy()))
    firsts = firsts.select("bucket", "f.o", "f.tie", before.alias("before"))
    ghosts = (rows.join(firsts, (rows.bucket == firsts.bucket) & (rows.o == firsts.o) & (rows.tie == firsts.tie))
              .select(rows.o, rows.tie, rows.text, firsts.before.alias("bucket")).dropDuplicates(["bucket"]))
    every = rows.withColumn("ghost", F.lit(False)).unionByName(
        ghosts.withColumn("ghost", F.lit(True)), allowMissingColumns=True)
    every = carry(every.repartition("bucket"))
    names = [c for c in every.columns if c not in ("id", "o", "tie", "bucket", "ghost")]
    ahead = Window.partitionBy("bucket").orderBy("ghost", "o", "tie")
    return (every.select("*", *[F.lead(c).over(ahead).alias(f"next_{c}") for c in names])
            .where("not ghost").drop("o", "tie", "bucket", "ghost"))


def _place(value: Column, cuts: list[float], step: int = 64) -> Column:
    """Number of sorted cuts not above the value, found among every ``step``-th first."""
    if not cuts:
        return F.lit(0)

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda c: c <= value))

    fine = F.array(*[F.lit(c) for c in cuts])
    coarse = below(F.array(*[F.lit(c) for c in cuts[::step]]))
    inside = F.slice(fine, (coarse - 1) * step + 2, step - 1) if len(cuts) > 1 else None
    rest = F.when((coarse - 1) * step + 2 <= len(cuts), below(inside)).otherwise(F.lit(0)) if len(cuts) > 1 else F.lit(0)
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * step + 1 + rest)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = SKETCH_SIZE) -> DataFrame:
    """Per document its sketch, that of its edited text (second half from the next document) and their likeness."""
    df = with_next(docs, doc_id, text, lambda d: with_sketch(d, "text", "sketch", k))
    own, other = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("n_chars", F.length(own).cast("long"))
    df = df.withColumn("edited", F.concat(F.substring(own, F.lit(1), (F.col("n_chars") - half).cast("int")),
                                          F.substring(other, F.lit(1), half)))
    df = with_sketch(df.drop("text", "next_text"), "edited", "edited_sketch", k)
    return df.select("id", "n_chars", "edited", "sketch", "edited_sketch", "next_sketch",
                     resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                     resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
