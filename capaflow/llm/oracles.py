"""DuckDB SQL of the queries that SQL can express on small tables, written from their contracts."""

from __future__ import annotations

from capaflow.llm import licence_scan
from capaflow.llm.chat_format import NAME
from capaflow.llm.common import WORD_PATTERN
from capaflow.llm.fingerprints import ASCII_LOWER, ASCII_UPPER
from capaflow.llm.lexical_search import TERM_PATTERN
from capaflow.llm.secret_scan import BASE_RULES, RULES

_COMPONENTS = """
        reach(node, label) AS (SELECT rep, rep FROM classes UNION
            SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.node),
        component AS (SELECT node, min(label) AS component_id FROM reach GROUP BY 1)"""

NEAR_DEDUP = f"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '{WORD_PATTERN}') AS w FROM documents),
        sets AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 2 THEN w
            ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS s FROM words),
        classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
        items AS (SELECT rep, n, unnest(s) AS x FROM classes),
        rare AS (SELECT x, count(*) AS df FROM items GROUP BY 1),
        -- sets of 80% resemblance share one of the rarest fifth (and one more) of either
        prefix AS (SELECT rep, x FROM items JOIN rare USING (x)
            QUALIFY row_number() OVER (PARTITION BY rep ORDER BY df, x) <= n - (8 * n + 9) // 10 + 1),
        pairs AS (SELECT DISTINCT p.rep AS a, q.rep AS b FROM prefix p JOIN prefix q USING (x) WHERE p.rep < q.rep),
        checked AS (SELECT a, b, len(list_intersect(c.s, d.s)) AS k, c.n + d.n AS total
            FROM pairs JOIN classes c ON c.rep = a JOIN classes d ON d.rep = b WHERE 10 * least(c.n, d.n) >= 8 * greatest(c.n, d.n)),
        linked AS (SELECT a, b FROM checked WHERE 100 * k >= 80 * (total - k)),
        edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),{_COMPONENTS}
        SELECT doc_id, len(sets.s) AS n_shingles, coalesce(component_id, doc_id) AS component_id,
            coalesce(component_id, doc_id) = doc_id AS kept
        FROM sets LEFT JOIN classes ON classes.s = sets.s LEFT JOIN component ON node = rep"""

EMBEDDINGS = f"""
        WITH RECURSIVE classes AS (SELECT vec_id AS rep, embedding::DOUBLE[] AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        linked AS (SELECT p.rep AS a, q.rep AS b FROM classes p JOIN classes q ON p.rep < q.rep AND len(p.e) = len(q.e)
            WHERE list_cosine_similarity(p.e, q.e) >= 0.9),
        edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),{_COMPONENTS}
        SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, coalesce(component_id, vec_id) AS component_id,
            coalesce(component_id, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN component ON node = vec_id"""


def _secrets() -> str:
    found = []
    for k, rule in enumerate(RULES):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        found.append(f"""
            SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, s, s + length(m) AS e FROM (
                SELECT doc_id, m[i] AS m, v[i] AS v, (coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0)
                    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
                FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (
                    SELECT doc_id, string_split_regex(text, {pattern}) AS g, regexp_extract_all(text, {pattern}) AS m,
                        regexp_extract_all(text, {pattern}, {rule.group}) AS v FROM documents
                    WHERE regexp_matches(text, {pattern}))))
            WHERE length(v) >= {rule.least}""")
    base = len(BASE_RULES)
    joined = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE_RULES))
    return f"""
        WITH found AS ({" UNION ALL ".join(found)})
        SELECT doc_id, {counts}, sha256({joined} FILTER (k < {base}), '')) AS base_sha256, {joined}, '') AS spans
        FROM documents LEFT JOIN found USING (doc_id) GROUP BY doc_id"""


RANKED_SEARCH = f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
                translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '{TERM_PATTERN}') AS w FROM documents),
        size AS (SELECT count(*) FILTER (len(w) > 0) AS n, sum(len(w))::BIGINT AS l FROM d),
        held AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
        asked AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
                translate(text, '{ASCII_UPPER}', '{ASCII_LOWER}'), '{TERM_PATTERN}')) AS t FROM benchmark) GROUP BY 1, 2),
        weights AS (SELECT t, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM held, size GROUP BY t, n),
        scores AS (SELECT item_id, r, sum(times * weights.w * ((1000000000 * tf) // (1000 * tf
                + 8 * (100 - 75 + (75 * len(d.w) * n) // l))))::BIGINT AS score
            FROM asked JOIN weights USING (t) JOIN held USING (t) JOIN d USING (r), size GROUP BY 1, 2),
        best AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM scores JOIN d USING (r) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10"""

CHAT_FORMAT = f"""
        WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
        written AS (SELECT *, CASE WHEN regexp_full_match(role, '[0-9A-Za-z_]+') THEN role ELSE '=' || hex(role) END AS name,
            regexp_replace(regexp_replace(text, '#(\\\\*)## ({NAME}): ', '#\\\\\\1## \\2: ', 'g'), '<(\\\\*)/turn>', '<\\\\\\1/turn>', 'g') AS body FROM turns),
        whole AS (SELECT conv_id, count(*) AS n_turns,
            string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
            coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '') AS loss,
            string_agg('### ' || name || ': ' || body || '</turn>', chr(10)) AS formatted FROM written GROUP BY 1)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
            length(formatted) AS formatted_chars FROM whole"""

HARD_NEGATIVES = """
        WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        a AS (SELECT DISTINCT * FROM r WHERE vec_id % 100 = 0),
        scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
            FROM a JOIN r ON len(a.v) = len(r.v)),
        positive AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same AND vec_id <> anchor_id
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        negative AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank,
                vec_id AS negative_id, positive_score, score AS negative_score
            FROM positive JOIN scored USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
        SELECT * FROM negative WHERE rank <= 10"""


ORACLES: dict[str, str] = {
    "op1_licences": licence_scan.oracle_sql(),
    "op5_minmax_near_dedup": NEAR_DEDUP,
    "op7_secrets": _secrets(),
    "op10_embedding_dedup": EMBEDDINGS,
    "op11_ranked_search": RANKED_SEARCH,
    "op12_chat_format": CHAT_FORMAT,
    "op13_hard_negatives": HARD_NEGATIVES,
}
