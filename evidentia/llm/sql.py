"""DuckDB SQL of the operators that SQL can express, written apart from them."""

from __future__ import annotations

# The line rules' phrases and menu words, as in quality.
from .quality import BOILERPLATE, MARK_EVERY, MARKS, MENU

SPACE = r"[\x20\x09-\x0D]"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fails(x: str, wrapped: str) -> str:
    low = f"lower(trim({x}))"
    n_words = f"len({WORDS.format(low)})"
    n_parts = f"len(regexp_split_to_array({low}, '\\s[|»›>·•/]\\s'))"
    terminal = """'[.!?…:;。！？]["''”’»)\\]*_#$%&|<>]*$'"""
    boilerplate = f"(length({low}) <= 200 AND regexp_matches({low}, {q(BOILERPLATE)}))"
    menu = f"(regexp_matches({low}, {q(f'^({MENU})$')}) OR ({n_parts} >= 3 AND {n_words} <= 2 * {n_parts} AND {n_words} <= 12 AND NOT regexp_matches({low}, {terminal})))"
    return f"({boilerplate} OR {menu} OR ({n_words} >= 3 AND NOT regexp_matches({low}, '[.!?…:;。！？]') AND NOT {wrapped}))"


QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS words FROM documents),
    split_ AS (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM d),
    ordered AS (SELECT doc_id, i, l[i] AS line, sum(CASE WHEN regexp_matches(l[i], '[^\\x20\\x09-\\x0D]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM split_),
    paragraphs AS (SELECT doc_id, p, sum(length(line) + 1) - 1 AS n, sum(length(line) - length(regexp_replace(line, '[{MARKS}]', '', 'g'))) AS marks, max(length(trim(line))) AS longest FROM ordered GROUP BY ALL),
    lines AS (SELECT doc_id, line, {MARK_EVERY} * marks >= n AND 2 * length(trim(line)) >= longest AS wrapped FROM ordered JOIN paragraphs USING (doc_id, p)),
    dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    clean AS (SELECT doc_id, sum(length(regexp_replace(line, '{SPACE}+', '', 'g'))) AS kept_chars FROM lines WHERE NOT (regexp_matches(line, '[^\\x20\\x09-\\x0D]') AND {_fails('line', 'wrapped')}) GROUP BY 1),
    w AS (SELECT doc_id, i, words[i:i + 4] AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(len(words) - 3, 1))) AS i)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM w) WHERE c > 1),
    cover AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS j) GROUP BY 1),
    m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{SPACE}+', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(kept_chars, 0) AS kept_chars
          FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN cover USING (doc_id) LEFT JOIN clean USING (doc_id)),
    v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 1 - kept_chars / CAST(word_chars AS DOUBLE) ELSE 0 END AS lost FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost <= 0.5 AS kept, floor(lost * 1e6 + 0.5) / 1e6 AS lost_share FROM v"""

NEAR = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w] ELSE list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) END) AS g FROM d)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT u, v FROM pairs JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
    both_ AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
    reach AS (SELECT u AS node, v AS other FROM both_ UNION SELECT r.node, b.v FROM reach r JOIN both_ b ON r.other = b.u),
    least AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON node = d.doc_id"""

REPEATS = """WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
    w AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS k FROM d, LATERAL (SELECT unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i)),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
    e AS (SELECT doc_id, i, CASE WHEN i <= coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 200 THEN 0 ELSE 1 END AS new FROM r),
    g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM e),
    spans AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY ALL),
    gaps AS (SELECT s.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY b) AS ends FROM spans s GROUP BY 1),
    kept AS (SELECT doc_id, h, n_removed, n_spans, CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda j:
        substr(h, CASE WHEN j = 0 THEN 1 ELSE 2 * ends[j] + 1 END, (CASE WHEN j = n_spans THEN length(h) // 2 ELSE starts[j + 1] END - CASE WHEN j = 0 THEN 0 ELSE ends[j] END) * 2)), '') END AS rest
        FROM d LEFT JOIN gaps USING (doc_id))
    SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept"""


#: The exact neighbours. A query reads ann.NEAREST lists at least, which at sf0.01 are more than there are.
NEIGHBOURS = """WITH pairs AS (SELECT a.vec_id AS query_id, b.vec_id, sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1),
        lambda i: (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)) * (CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))))) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""

SHARE = "1 + (1000000000 * CAST({c} + 5 AS HUGEINT)) // ({n} + 5 * {v})"
AUDIT = f"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 30),
    g AS (SELECT DISTINCT lang, source FROM d),
    l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY 1),
    c AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY ALL),
    x AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, k.c AS lc FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
    n AS (SELECT lang, source, sum(c) AS n FROM x GROUP BY ALL),
    p AS (SELECT x.lang, x.source, term, c, {SHARE.format(c="c", n="n.n", v="l.v")} AS p, {SHARE.format(c="lc", n="l.n", v="l.v")} AS q FROM x JOIN n USING (lang, source) JOIN l USING (lang)),
    s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50"""

VECTORS = """WITH RECURSIVE u AS MATERIALIZED (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.93 END),
    n AS (SELECT u, count(*) AS n FROM links GROUP BY 1),
    reach AS (SELECT u AS node, v AS other FROM links UNION SELECT r.node, l.v FROM reach r JOIN links l ON r.other = l.u),
    least AS (SELECT node, least(node, min(other)) AS c FROM reach GROUP BY node)
    SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, vec_id = coalesce(c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN least ON node = vec_id"""


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": AUDIT, "op12_embedding_near_duplicates": VECTORS, "op1_quality_rules": QUALITY, "op3_near_duplicates": NEAR, "op5_nearest_neighbours": NEIGHBOURS, "op10_suffix_array": REPEATS}
