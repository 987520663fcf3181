"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one table of ``slots`` rows; column l of a row is the bit
of language l. Adding an n-gram for a language sets its bit in ``probes``
rows; AND-ing those rows of an n-gram gives, in one step, the bitmask of all
languages that contain it. A text's n-grams are looked up, hits are counted
per language (popcounts), the share expected from false positives is taken
off, and the language with the most hits left wins.

Fit: n-grams are counted over every labelled training text (whole texts,
partial counts in the tasks, one shuffle). A language keeps the n-grams that
make up at least ``min_share`` of its n-grams and at least ``ratio`` of the
n-gram's largest share in any language. So it has at most 1 / min_share of
them, whatever the input's size: that bounds what the driver gathers and what
is broadcast.

Defined results: null or empty texts and texts without a letter are ``und``
with score 0; a text with letters but no known n-gram gets the language with
the most training text, score 0; ties go to the language first by code point;
with no labelled row at all every text is ``und``. Rows are scored one by one,
so repeated rows agree. Only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capaflow.llm.common import exactly, in_batches, kept_beside, splitmix

UNDETERMINED = "und"
PIECE_CHARS = 1 << 20
HELD_COUNTS = 2_000_000  # distinct n-grams a task holds before it passes them on

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams (three code points packed in 63 bits) of lower-cased texts with
    runs of other characters as one space, each text as if between spaces; the
    row of each trigram; whether each row has a letter."""
    joined = "\0" + "\0".join(t.replace("\0", " ") for t in texts) + "\0"
    code = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = code == 0
    letter = _letter_table()[code]
    gap = ~letter
    code = np.where(letter, code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = letter[1:] | edge[1:] | ~gap[:-1]
    code, edge, letter = code[keep], edge[keep], letter[keep]
    keep = letter | edge | ~np.append(edge[1:], True)  # a gap before the edge is the edge's
    code, edge, letter = code[keep].astype(np.uint64), edge[keep], letter[keep]
    row = np.cumsum(edge) - 1
    has_letter = np.bincount(row[letter], minlength=len(texts) + 1)[:len(texts)] > 0
    gram = code[:-2] << np.uint64(42) | code[1:-1] << np.uint64(21) | code[2:]
    good = ~edge[1:-1] & (letter[:-2] | letter[1:-1] | letter[2:])
    return gram[good], row[1:-1][good], has_letter


def _runs(values: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of runs of about PIECE_CHARS characters; null is empty."""
    out, size, first = [], 0, 0
    for k, v in enumerate(values):
        t = v.as_py() or ""
        out.append(t)
        size += len(t)
        if size >= PIECE_CHARS:
            yield first, out
            out, size, first = [], 0, k + 1
    if out:
        yield first, out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    gram, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return gram, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)


def gram_counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, n): occurrences of each trigram in all texts of each language."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def out() -> Iterator[pa.RecordBatch]:
            for name, parts in held.items():
                gram, n = _added(parts)
                for lo in range(0, len(gram), 100_000):
                    g = gram[lo:lo + 100_000].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(g), pa.string()), pa.array(g), pa.array(n[lo:lo + 100_000])],
                        names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, texts in _runs(batch.column(0)):
                by_lang = defaultdict(list)
                for t, name in zip(texts, names[first:], strict=False):
                    by_lang[name].append(t)
                for name, own in by_lang.items():
                    gram, n = np.unique(text_grams(own)[0], return_counts=True)
                    held[name].append((gram, n))
                    if len(held[name]) >= 16:
                        held[name] = [_added(held[name])]
            if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_COUNTS:
                yield from out()
        yield from out()

    rows = docs.where(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    return (in_batches(exactly(rows, text, lang), work, "lang string, gram long, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


@dataclass
class Filters:
    """Bit-sliced Bloom filters: ``table[slot, word]`` holds the language bits."""

    languages: list[str]
    table: np.ndarray
    probes: int
    false_positive: np.ndarray  # per language, from the bits that are set
    fallback: int

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """Language bitmask (words of 64 bits) of every n-gram."""
        slots = np.uint64(len(self.table) - 1)
        h = splitmix(gram)
        step = splitmix(h) | np.uint64(1)
        mask = self.table[h & slots]
        with np.errstate(over="ignore"):
            for k in range(1, self.probes):
                mask &= self.table[(h + np.uint64(k) * step) & slots]
        return mask

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and share of n-grams explained, of every text."""
        gram, row, has_letter = text_grams(texts)
        n = np.bincount(row, minlength=len(texts))[:len(texts)]
        hits = np.zeros((len(texts), max(1, len(self.languages))))
        if len(gram) and self.languages:
            mask = self.masks(gram)
            for k in range(len(self.languages)):
                bit = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                hits[:, k] = np.bincount(row, bit, minlength=len(texts))[:len(texts)]
            f = self.false_positive
            hits = np.maximum(0.0, (hits - n[:, None] * f) / (1 - f))
        best = np.argmax(hits, axis=1)
        most, total = hits.max(axis=1), hits.sum(axis=1)
        best = np.where(most > 0, best, self.fallback)
        score = np.divide(most, total, out=np.zeros(len(texts)), where=total > 0)
        known = np.clip(np.divide(most, n, out=np.zeros(len(texts)), where=n > 0), 0, 1)
        names = [self.languages[b] if ok and self.languages else UNDETERMINED
                 for b, ok in zip(best, has_letter, strict=True)]
        if not self.languages:
            return names, np.zeros(len(texts)), np.zeros(len(texts))
        return names, np.where(has_letter, score, 0.0), np.where(has_letter, known, 0.0)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = 1e-4, ratio: float = 0.25,
        probes: int = 4, bits_per_gram: int = 16) -> Filters:
    """Filters learnt from all labelled rows of ``docs``."""
    counts = gram_counts(docs, text, lang)
    counts = counts.join(counts.groupBy("lang").agg(F.sum("n").alias("total")), "lang")
    rows = counts.where(F.col("n") >= F.col("total") * min_share).select("lang", "gram", "n", "total").toArrow()
    names = np.array(rows.column("lang").to_pylist(), dtype=object)
    languages = sorted(set(names))
    gram = rows.column("gram").to_numpy().view(np.uint64)
    n, total = rows.column("n").to_numpy(), rows.column("total").to_numpy()
    share = n / np.maximum(total, 1)
    which, at = np.unique(gram, return_inverse=True)
    top = np.zeros(len(which))
    np.maximum.at(top, at, share)
    kept = share >= ratio * top[at]
    lang_no = np.array([languages.index(x) for x in names], dtype=np.int64) if len(names) else np.zeros(0, np.int64)
    gram, lang_no = gram[kept], lang_no[kept]
    most = int(np.bincount(lang_no, minlength=1).max()) if len(lang_no) else 1
    slots = 1 << max(10, (most * bits_per_gram - 1).bit_length())
    table = np.zeros((slots, max(1, -(-len(languages) // 64))), np.uint64)
    h = splitmix(gram)
    step = splitmix(h) | np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(probes):
            np.bitwise_or.at(table, ((h + np.uint64(k) * step) & np.uint64(slots - 1), lang_no // 64),
                             np.uint64(1) << (lang_no % 64).astype(np.uint64))
    fill = np.array([np.count_nonzero(table[:, k // 64] >> np.uint64(k % 64) & np.uint64(1)) / slots
                     for k in range(len(languages))])
    sizes = {x: t for x, t in zip(names, total, strict=True)}
    fallback = max(range(len(languages)), key=lambda k: (sizes[languages[k]], -k), default=0)
    return Filters(languages, table, probes, fill ** probes, fallback)


def predict(docs: DataFrame, filters: Filters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row the kept columns, lang_pred, score (the winner's share of all languages'
    corrected hits) and explained (its share of the text's n-grams)."""
    results = ("lang_pred", "score", "explained")
    keep = kept_beside(keep, results)
    shared = docs.sparkSession.sparkContext.broadcast(filters)
    rows = docs.select(F.col(f"`{text}`").alias("_text"), *[F.col(f"`{c}`") for c in keep])
    fields = [f"`{c}` {t}" for c, t in rows.dtypes[1:]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for first, texts in _runs(batch.column(0)):
                names, score, known = own.score(texts)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(texts)) for c in batch.columns[1:]), pa.array(names, pa.string()),
                     pa.array(score), pa.array(known)], names=[*keep, *results])

    return in_batches(rows, work, ", ".join([*fields, "lang_pred string, score double, explained double"]))
