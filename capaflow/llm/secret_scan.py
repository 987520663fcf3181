"""Secret scanning with a trigram inverted index, in DataFrame expressions only.

From each rule's regular expression a Boolean query over trigrams is derived:
every match must contain certain literal characters, so a text without their
trigrams cannot match. The index holds postings (trigram, text) for the
trigrams that the queries name; a text stands for itself by a 128-bit key, so
copies share postings. Postings are intersected per text, the rules whose
query holds become its candidates, and the regular expression verifies them on
the text itself. Rules without a mandatory trigram scan every text.

Case is folded in index and queries, which only adds candidates.

A span is ``kind:start:end`` in code points, end exclusive. Matches of a rule
are leftmost and do not overlap; a match whose checked group is shorter than
``least`` is dropped after matching. Defined results: null is the empty text,
without spans; repeated rows have equal results; extra columns are
carried only if named.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from capaflow.llm.common import kept_beside, staged


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0   # whose length is checked
    least: int = 0


# The three base kinds, in this order.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    # runs are maximal, so the length can be part of the pattern
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Widely published token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES


# --- trigram queries -----------------------------------------------------------------
# A query is True (no condition), a trigram, ("and", parts) or ("or", parts).
def _both(op: str, parts: list):
    """The parts under one operator, without parts that others make needless."""
    parts = [p for p in parts if not (op == "and" and p is True)]
    if op == "or" and True in parts:
        return True
    parts = {x for p in parts for x in (p[1] if isinstance(p, tuple) and p[0] == op else [p])}
    if op == "or":
        terms = {p: {p} if isinstance(p, str) else set(p[1]) for p in parts}
        parts = {p for p in parts if not any(terms[o] < terms[p] for o in parts)}
    parts = sorted(parts, key=str)
    return True if not parts and op == "and" else parts[0] if len(parts) == 1 else (op, tuple(parts))


def _trigrams_of(literals: set[str] | None):
    """Any of the literals occurs whole: the trigrams of one of them do."""
    if not literals:
        return True
    return _both("or", [_both("and", [s[k:k + 3] for k in range(len(s) - 2)]) for s in literals])


def _expand(items, limit: int = 32):
    """For a parsed sequence: the finite set of strings it stands for (None if not finite or too many), and its query."""
    run: set[str] | None = {""}  # literals that end here
    exact, query = True, []

    def close():
        nonlocal run, exact
        if run is not None and run != {""}:
            query.append(_trigrams_of(run))
        run, exact = {""}, False

    for op, arg in items:
        own, sub = None, True
        if op is C.LITERAL:
            own = {chr(arg).lower()}
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg):
            own = {chr(v).lower() for _, v in arg}
        elif op is C.SUBPATTERN:
            own, sub = _expand(arg[-1], limit)
        elif op is C.BRANCH:
            found = [_expand(x, limit) for x in arg[1]]
            own = set().union(*(s for s, _ in found)) if all(s is not None for s, _ in found) else None
            sub = _both("or", [q if s is None else _both("and", [q, _trigrams_of(s)]) for s, q in found])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg
            s, q = _expand(inner, limit)
            if s is not None and high is not C.MAXREPEAT and high <= 8:
                own = {"".join(x) for n in range(low, high + 1) for x in product(s, repeat=n)} if len(s) ** high <= limit else None
            if own is None and low and s is not None:
                close()
                query.append(_trigrams_of({"".join(x) for x in product(s, repeat=min(low, 3))}) if len(s) ** min(low, 3) <= limit else True)
            elif own is None and low:
                sub = q
        if own is not None and len(run) * len(own) <= limit:
            run = {a + b for a in run for b in own}
        else:
            close()
            if own is not None:
                run = own
            query.append(sub)
    if exact:
        return run, True
    query.append(_trigrams_of(run if run != {""} else None))
    return None, _both("and", query)


def trigram_query(pattern: str):
    """Boolean trigram query that every text with a match fulfils."""
    literals, query = _expand(_parser.parse(pattern))
    return _both("and", [query, _trigrams_of(literals)])


def _named(query) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_named, query[1]))


def _holds(query, has) -> Column:
    if isinstance(query, str):
        return has(query)
    parts = [_holds(q, has) for q in query[1]]
    return reduce((lambda a, b: a & b) if query[0] == "and" else (lambda a, b: a | b), parts)


# --- index ----------------------------------------------------------------------------
def text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _any_of(trigrams: list[str]) -> str:
    """Expression that finds every place where one of the trigrams starts, by their first characters."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(re.escape(t[1:]))
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items())) + "))"


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """Inverted index (trigram number, h1, h2) of the named trigrams over column ``text``, from one pass over each text."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_any_of(trigrams)), 1))
    number = F.array_position(F.array(*[F.lit(t) for t in trigrams]), F.col("found")) - 1
    return (texts.select(*text_keys(F.col("text")), F.explode(found).alias("found"))
            .select(number.cast("int").alias("trigram"), "h1", "h2"))


def candidates(index: DataFrame, queries: list, trigrams: list[str]) -> DataFrame:
    """(h1, h2, mask): texts in the intersections of the queries' postings; bit k stands for query k."""
    words = -(-len(trigrams) // 63)
    bits = [F.bit_or(F.when(F.floor(F.col("trigram") / 63) == w, F.expr(f"shiftleft(1L, cast(trigram % 63 as int))"))
                     .otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]
    number = {t: k for k, t in enumerate(trigrams)}

    def has(t: str) -> Column:
        k = number[t]
        return F.col(f"w{k // 63}").bitwiseAND(F.lit(1 << k % 63)) != 0

    mask = reduce(lambda a, b: a + b, [F.when(_holds(q, has), F.lit(1 << k)).otherwise(F.lit(0)) for k, q in enumerate(queries)])
    return index.groupBy("h1", "h2").agg(*bits).select("h1", "h2", mask.cast("long").alias("mask")).where("mask > 0")


# --- verification ------------------------------------------------------------------------
def rule_spans(text: str, rule: Rule, number: int) -> Column:
    """Array of (start, kind number, end) of a rule's matches in a text column.

    The pieces between the matches and the matches themselves, from two
    passes of the expression, add up to the places.
    """
    empty = F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint>>)")
    pattern = F.lit(rule.pattern)
    gaps = F.split(F.col(text), rule.pattern, -1)
    parts = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(F.col(text), pattern, 0).alias("m"),
                         F.regexp_extract_all(F.col(text), pattern, rule.group).alias("v"))
    start = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))

    def add(acc: Column, p: Column) -> Column:
        s = acc["at"] + F.length(p["g"])
        e = s + F.coalesce(F.length(p["m"]), F.lit(0))
        keep = p["m"].isNotNull() & (F.length(p["v"]) >= rule.least)
        return F.struct(e.cast("long").alias("at"), F.when(keep, F.concat(acc["out"], F.array(F.struct(
            s.cast("long").alias("s"), F.lit(number).alias("k"), e.cast("long").alias("e"))))).otherwise(acc["out"]).alias("out"))

    return F.when(F.col(text).rlike(rule.pattern), F.aggregate(parts, start, add, lambda acc: acc["out"])).otherwise(empty)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row the kept columns, ``_text`` and ``_spans``: all spans (s, k, e) in order."""
    keep = kept_beside(keep, ("_text", "_spans"))
    rows = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
                       *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    queries = [(k, q) for k, r in enumerate(rules) if (q := trigram_query(r.pattern)) is not True]
    trigrams = sorted(set().union(*(_named(q) for _, q in queries)))
    asked = {k: n for n, (k, _) in enumerate(queries)}
    if queries:
        found = staged(candidates(postings(rows.select("text"), trigrams), [q for _, q in queries], trigrams), "secret-candidates")
        rows = rows.select("*", *text_keys(F.col("text"))).join(found, ["h1", "h2"], "left").drop("h1", "h2")
    empty = F.expr("cast(array() as array<struct<s:bigint,k:int,e:bigint>>)")
    spans = [F.when(F.col("mask").bitwiseAND(F.lit(1 << asked[k])) != 0, rule_spans("text", r, k)).otherwise(empty)
             if k in asked else rule_spans("text", r, k) for k, r in enumerate(rules)]
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias("_text"),
                       F.sort_array(F.concat(*spans)).alias("_spans"))


def named(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", F.element_at(kinds, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch covered by spans replaced by a mark.

    The pieces between the stretches are cut out of the text once and joined once; no prefix is built again for a span.
    """
    piece = F.expr("cast(array() as array<string>)")
    start = F.struct(F.lit(0).cast("long").alias("at"), piece.alias("out"))

    def cut(acc: Column, length: Column) -> Column:
        return F.array_append(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), length.cast("int")))

    def add(acc: Column, x: Column) -> Column:
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"),
                        F.when(x["s"] >= acc["at"], cut(acc, x["s"] - acc["at"])).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(spans, start, add, lambda acc: F.array_join(cut(acc, F.length(text) - acc["at"]), mark))
    return F.when(F.size(spans) > 0, done).otherwise(text)
