"""DuckDB SQL of the registered queries, written apart from the operators."""

from __future__ import annotations

from ..config import EVIDENCE_ONLY, LATIN, RULES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def six(x: str, name: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6 AS {name}"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z]+|[0-9]+(?:\\.[0-9]+)?%?')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> '')"


def edges(x: str) -> str:
    return f"list_concat({x}[1:3], {x}[greatest(len({x}) - 2, 1):len({x})])"


def compact(x: str) -> str:
    return f"length(regexp_replace({x}, '\\s+', '', 'g'))"


def chapter(x: str) -> str:
    match = " OR ".join(f"regexp_matches(x, {q(p)})" for p in LATIN.chapters)
    return f"list_filter({x}[1:12], lambda x: length(x) <= 60 AND ({match}))[1]"


def printed(x: str) -> str:
    one = "coalesce(" + ", ".join(f"CASE WHEN try_cast(regexp_extract(x, {q(p)}, 1) AS INT) > 0 THEN try_cast(regexp_extract(x, {q(p)}, 1) AS INT) END" for p in LATIN.printed) + ")"
    return f"list_filter(list_transform({edges(x)}, lambda x: {one}), lambda x: x IS NOT NULL)[1]"


def numbers(x: str) -> str:
    plain = "regexp_replace(regexp_replace(x, ',', '', 'g'), '%$', '')"
    cut = f"CASE WHEN contains({plain}, '.') THEN regexp_replace(regexp_replace({plain}, '0+$', ''), '\\.$', '') ELSE {plain} END"
    return f"list_transform(regexp_extract_all({x}, '-?[0-9][0-9,]*(?:\\.[0-9]+)?%?'), lambda x: regexp_replace({cut}, '^(-?)0+([0-9])', '\\1\\2') || CASE WHEN x LIKE '%\\%' ESCAPE '\\' THEN '%' ELSE '' END)"


def loose(x: str) -> str:
    return f"lower(regexp_replace({x}, '(?:\\s|[,，。；;：:（）()「」“”\"''])+', '', 'g'))"


def quote(text: str, terms: str, most: int) -> str:
    whole = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    places = f"list_sort(list_filter(list_transform({terms}, lambda t: {{'n': -length(t), 'at': instr({whole}, t) - 1}}), lambda p: p.at >= 0))"
    end = f"least(length({whole}), greatest(0, coalesce({places}[1].at, 0) - {most // 4}) + {most})"
    return f"""CASE WHEN length({whole}) <= {most} THEN {whole} ELSE
        CASE WHEN greatest(0, {end} - {most}) > 0 THEN '…' ELSE '' END || trim(substring({whole}, greatest(0, {end} - {most}) + 1, {end} - greatest(0, {end} - {most})))
        || CASE WHEN {end} < length({whole}) THEN '…' ELSE '' END END"""


def salient(x: str) -> str:
    stop = ", ".join(map(q, LATIN.ignored))
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) BETWEEN 2 AND 4 AND t NOT IN ({stop}) AND NOT regexp_full_match(t, '[0-9]+')))"


PAGES = "pages AS (SELECT doc_id, source AS document_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pdf_page, text, lang FROM documents)"


def margins(ratio: float) -> str:
    return f"""{PAGES}, each AS (SELECT DISTINCT document_id, pdf_page, unnest({edges(lines('text'))}) AS line FROM pages),
    counts AS (SELECT document_id, line, count(*) AS pages FROM each WHERE length(line) BETWEEN 2 AND 80 AND NOT regexp_full_match(line, '[0-9]+') GROUP BY ALL),
    size AS (SELECT document_id, greatest(3, CAST(round_even(count(*) * {ratio}, 0) AS BIGINT)) AS threshold FROM pages GROUP BY 1),
    margin AS (SELECT document_id, line, pages, threshold FROM counts JOIN size USING (document_id) WHERE pages >= threshold)"""


def without(ratio: float) -> str:
    return f"""{margins(ratio)}, lists AS (SELECT document_id, list(line) AS m FROM margin GROUP BY 1),
    clean AS (SELECT p.*, list_filter({lines('p.text')}, lambda x: NOT list_contains(coalesce(m, []), x)) AS kept FROM pages p LEFT JOIN lists USING (document_id))"""


CHAPTERED = f"""{PAGES}, chaptered AS (SELECT doc_id, document_id, pdf_page, text,
    coalesce(last_value({chapter(lines('text'))} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pdf_page ROWS UNBOUNDED PRECEDING), 'unknown') AS chapter FROM pages)"""
PARSED = f"""{without(0.3)}, parsed AS (SELECT doc_id, document_id, pdf_page, array_to_string(kept, chr(10)) AS text, {compact("array_to_string(kept, chr(10))")} AS char_count,
    {printed(lines('text'))} AS printed_page,
    coalesce(last_value({chapter('kept')} IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pdf_page ROWS UNBOUNDED PRECEDING), 'unknown') AS chapter,
    CASE WHEN trim(text) = '' THEN ['empty_page'] WHEN {compact("array_to_string(kept, chr(10))")} < 50 THEN ['short_page'] ELSE [] END AS flags FROM clean)"""
FIXED = f"""{CHAPTERED}, p AS (SELECT document_id, pdf_page, chapter, trim(text, ' ' || chr(10)) AS t FROM chaptered WHERE trim(text, ' ' || chr(10)) <> ''),
    o AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY document_id ORDER BY pdf_page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p),
    c AS (SELECT document_id, string_agg(t, chr(10) || chr(10) ORDER BY pdf_page) AS corpus, max(a + length(t)) AS n FROM o GROUP BY 1),
    w AS (SELECT document_id, corpus, unnest(range(0, greatest(0, CAST(ceil((n - 800) / 650.0) AS BIGINT)) + 1)) AS k FROM c),
    x AS (SELECT document_id, k, trim(substr(corpus, CAST(k * 650 + 1 AS BIGINT), 800), ' ' || chr(10)) AS text FROM w),
    g AS (SELECT x.document_id, x.k, list(o.pdf_page ORDER BY o.pdf_page) AS pages, list(o.chapter ORDER BY o.pdf_page) FILTER (o.chapter <> 'unknown') AS named
          FROM x JOIN o ON x.document_id = o.document_id AND o.a < x.k * 650 + 800 AND o.a + length(o.t) > x.k * 650 GROUP BY ALL),
    f AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY k) - 1 AS i, text, pages, coalesce(named[1], 'unknown') AS chapter, len(list_distinct(coalesce(named, []))) AS n_chapters
          FROM x JOIN g USING (document_id, k) WHERE text <> ''),
    fixed AS (SELECT document_id, i, document_id || '_baseline_' || lpad(CAST(i AS VARCHAR), 5, '0') AS chunk_id, text, {compact('text')} AS char_count, pages, chapter, n_chapters FROM f)"""
STRIP = "' ' || chr(9) || chr(10) || chr(13)"
UNIT, TARGET, MOST, CARRY = 400, 700, 1000, 120
#: Units step by step: lines into units, sentences into parts, parts into slices.
UNITS = f"""{CHAPTERED}, ll AS MATERIALIZED (SELECT document_id, pdf_page, chapter, i, trim(l[i], {STRIP}) AS line
        FROM (SELECT *, string_split(trim(text, {STRIP}), chr(10)) AS l, unnest(range(1, len(string_split(trim(text, {STRIP}), chr(10))) + 1)) AS i FROM chaptered)),
    lk AS MATERIALIZED (SELECT *, CASE WHEN line = '' THEN 0 WHEN length(line) <= 80 AND regexp_matches(line, {q(LATIN.heading)}) THEN 1 ELSE 2 END AS kind, regexp_matches(line, '[.!?;]$') AS ends FROM ll),
    lw AS (SELECT document_id, pdf_page, i, line, ends, 1 AS u, length(line) AS size, kind FROM lk WHERE i = 1
        UNION ALL SELECT k.document_id, k.pdf_page, k.i, k.line, k.ends,
            CASE WHEN k.kind < 2 OR w.kind < 2 OR (w.ends AND w.size >= {UNIT // 2}) OR w.size + length(k.line) > {UNIT} THEN w.u + 1 ELSE w.u END,
            CASE WHEN k.kind < 2 OR w.kind < 2 OR (w.ends AND w.size >= {UNIT // 2}) OR w.size + length(k.line) > {UNIT} THEN length(k.line) ELSE w.size + length(k.line) END, k.kind
        FROM lw w JOIN lk k ON k.document_id = w.document_id AND k.pdf_page = w.pdf_page AND k.i = w.i + 1),
    lu AS MATERIALIZED (SELECT document_id, pdf_page, u, min(kind) AS kind, string_agg(line, chr(10) ORDER BY i) AS text FROM lw WHERE kind > 0 GROUP BY ALL),
    ls AS (SELECT document_id, pdf_page, u, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?;]*[.!?;]|[^.!?;]+'), lambda x: trim(x, {STRIP})), lambda x: x <> '') AS parts FROM lu WHERE kind = 2),
    sk AS MATERIALIZED (SELECT document_id, pdf_page, u, parts[j] AS part, j FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS j FROM ls WHERE len(parts) > 1)),
    sw AS (SELECT document_id, pdf_page, u, j, part, 1 AS g, length(part) AS size FROM sk WHERE j = 1
        UNION ALL SELECT k.document_id, k.pdf_page, k.u, k.j, k.part, CASE WHEN w.size + length(k.part) > {UNIT} THEN w.g + 1 ELSE w.g END, CASE WHEN w.size + length(k.part) > {UNIT} THEN length(k.part) ELSE w.size + length(k.part) END
        FROM sw w JOIN sk k ON k.document_id = w.document_id AND k.pdf_page = w.pdf_page AND k.u = w.u AND k.j = w.j + 1),
    sg AS (SELECT document_id, pdf_page, u, g, string_agg(part, '' ORDER BY j) AS text FROM sw GROUP BY ALL UNION ALL SELECT document_id, pdf_page, u, 0, text FROM ls WHERE len(parts) < 2),
    sl AS (SELECT document_id, pdf_page, u, g, k, substr(text, CAST(k * {UNIT} + 1 AS BIGINT), {UNIT}) AS text FROM (SELECT *, unnest(range(0, CAST(ceil(length(text) / {UNIT}.0) AS BIGINT))) AS k FROM sg)
        UNION ALL SELECT document_id, pdf_page, u, 0, 0, text FROM lu WHERE kind = 1),
    runs AS (SELECT *, sum(turn) OVER (PARTITION BY document_id ORDER BY pdf_page, u, g, k ROWS UNBOUNDED PRECEDING) AS run FROM (
        SELECT sl.*, chapter, CASE WHEN chapter = lag(chapter) OVER (PARTITION BY sl.document_id ORDER BY sl.pdf_page, u, g, k) THEN 0 ELSE 1 END AS turn FROM sl JOIN chaptered USING (document_id, pdf_page)
        WHERE trim(sl.text, {STRIP}) <> '')),
    placed AS (SELECT *, row_number() OVER w AS j, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS t FROM runs WINDOW w AS (PARTITION BY document_id, run ORDER BY pdf_page, u, g, k)),
    carried AS MATERIALIZED (SELECT a.*, least(a.j, (SELECT min(b.j) FROM placed b WHERE b.document_id = a.document_id AND b.run = a.run AND b.j <= a.j AND a.t - b.t + length(b.text) <= {CARRY})) AS o FROM placed a),
    units AS MATERIALIZED (SELECT a.document_id, a.run, a.j, a.t, length(a.text) AS n, a.chapter, a.pdf_page, a.text, coalesce(a.o, a.j) AS o, b.t - length(b.text) AS ot
        FROM carried a JOIN placed b ON b.document_id = a.document_id AND b.run = a.run AND b.j = coalesce(a.o, a.j))"""
#: Chunks, unit by unit: b is where the open chunk begins, bt the characters before it; e1 and e2 are the ends of chunks that a unit closes.
STRUCTURED = f"""{UNITS}, pw AS (
        SELECT document_id, run, j, o, ot, CAST(NULL AS BIGINT) AS b1, CAST(NULL AS BIGINT) AS e1, CAST(1 AS BIGINT) AS b2, CASE WHEN n >= {TARGET} THEN j END AS e2,
            CASE WHEN n >= {TARGET} THEN greatest(1, o) ELSE 1 END AS b, CASE WHEN n >= {TARGET} THEN greatest(0, ot) ELSE 0 END AS bt, n < {TARGET} AS fresh FROM units WHERE j = 1
        UNION ALL SELECT document_id, run, j, o, ot, b1, e1, b2, e2, CASE WHEN e2 IS NULL THEN b2 ELSE greatest(b2, o) END, CASE WHEN e2 IS NULL THEN bt ELSE greatest(bt, ot) END, e2 IS NULL FROM (
            SELECT *, CASE WHEN t - bt + 2 * (j - b2) >= {TARGET} THEN j END AS e2 FROM (
                SELECT u.document_id, u.run, u.j, u.o, u.ot, u.t, CASE WHEN over THEN w.b END AS b1, CASE WHEN over THEN w.j END AS e1,
                    CASE WHEN over THEN greatest(w.b, w.o) ELSE w.b END AS b2, CASE WHEN over THEN greatest(w.bt, w.ot) ELSE w.bt END AS bt
                FROM (SELECT w.*, u.j AS nj, w.fresh AND u.t - w.bt + 2 * (u.j - w.b) > {MOST} AS over FROM pw w JOIN units u ON u.document_id = w.document_id AND u.run = w.run AND u.j = w.j + 1) w
                JOIN units u ON u.document_id = w.document_id AND u.run = w.run AND u.j = w.nj))),
    ranges AS (SELECT document_id, run, b1 AS b, e1 AS e FROM pw WHERE e1 IS NOT NULL UNION ALL SELECT document_id, run, b2, e2 FROM pw WHERE e2 IS NOT NULL
        UNION ALL SELECT document_id, run, b, j FROM pw WHERE fresh AND (document_id, run, j) IN (SELECT (document_id, run, max(j)) FROM units GROUP BY document_id, run)),
    sc AS (SELECT r.document_id, r.run, r.e, any_value(u.chapter) AS chapter, trim(string_agg(u.text, chr(10) || chr(10) ORDER BY u.j), {STRIP}) AS text, list_sort(list_distinct(list(u.pdf_page))) AS pages
        FROM ranges r JOIN units u ON u.document_id = r.document_id AND u.run = r.run AND u.j BETWEEN r.b AND r.e GROUP BY ALL),
    structured AS MATERIALIZED (SELECT *, i AS chunk_index, document_id || '_structured_' || lpad(CAST(i AS VARCHAR), 5, '0') AS chunk_id, {compact('text')} AS char_count
        FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY run, e) - 1 AS i FROM sc)),
    natural_ AS (SELECT document_id, count(*) AS chunk_count, count(*) FILTER (len(pages) > 1) AS cross_page, CAST(0 AS BIGINT) AS cross_chapter, min(char_count) AS min_chars, max(char_count) AS max_chars,
        CAST(sum(char_count) AS BIGINT) AS sum_chars, round_even(avg(char_count), 2) AS mean_chars, arg_min(chunk_id, i) AS first_chunk, arg_max(chunk_id, i) AS last_chunk, count(*) FILTER (regexp_matches(text, {q(LATIN.natural_end)})) AS natural_endings FROM structured GROUP BY 1)"""
CHANGE = "CASE WHEN f.{0} <> 0 THEN round_even((s.{0} - f.{0}) / CAST(f.{0} AS DOUBLE), 4) ELSE CAST(0 AS DOUBLE) END AS {1}"
REPORTED = "upper(document_id) AS company, lpad(CAST(length(document_id) AS VARCHAR), 6, '0') AS stock_code, CAST(length(document_id) + 2000 AS INT) AS report_year"
LANG = "['en', 'de', 'fr', 'es'][CAST(item_id % 4 + 1 AS BIGINT)]"


def bm25(k: int, name: str, question: str = "text", by: bool = False, source: str = "benchmark") -> str:
    g, on = (", lang", "USING (token, lang)") if by else ("", "USING (token)")
    lang = f", {LANG} AS lang" if by else ""
    stats = "JOIN stats USING (lang)" if by else "CROSS JOIN stats"
    group = "GROUP BY lang" if by else ""
    return f"""asked AS (SELECT query_id, token{g}, count(*) AS qf FROM (SELECT item_id AS query_id{lang}, unnest({tokens(question)}) AS token FROM {source}) GROUP BY ALL),
    docs AS (SELECT doc_id AS chunk_id{g}, {tokens('text')} AS toks, len({tokens('text')}) AS length FROM documents),
    stats AS (SELECT {'lang, ' if by else ''}count(*) AS n_docs, avg(length) AS avgdl FROM docs {group}),
    post AS (SELECT chunk_id, length, token{g}, count(*) AS tf FROM (SELECT chunk_id, length{g}, unnest(toks) AS token FROM docs) GROUP BY ALL),
    df AS (SELECT token{g}, count(*) AS df FROM post GROUP BY ALL),
    scored AS (SELECT query_id, chunk_id, sum(qf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / greatest(avgdl, 1)))) AS score
               FROM asked JOIN post {on} JOIN df {on} {stats} GROUP BY ALL),
    {name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, chunk_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {k})"""


def cosine(k: int, name: str = "cos", by: bool = False) -> str:
    g, on, asked = (", lang", "USING (token, lang)", f", {LANG} AS lang") if by else ("", "USING (token)", "")
    return f"""ct AS (SELECT chunk_id, token{g}, count(*) AS n FROM (SELECT doc_id AS chunk_id{g}, unnest({tokens('text')}) AS token FROM documents) GROUP BY ALL),
    qt AS (SELECT query_id, token{g}, count(*) AS m FROM (SELECT item_id AS query_id{asked}, unnest({tokens('text')}) AS token FROM benchmark) GROUP BY ALL),
    cn AS (SELECT chunk_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS nc FROM ct GROUP BY 1), qn AS (SELECT query_id, sqrt(CAST(sum(m * m) AS DOUBLE)) AS nq FROM qt GROUP BY 1),
    cp AS (SELECT query_id, chunk_id, sum(n * m) AS p FROM ct JOIN qt {on} GROUP BY query_id, chunk_id),
    {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, chunk_id) AS rank
        FROM (SELECT query_id, chunk_id, p / (nc * nq) AS score FROM cp JOIN cn USING (chunk_id) JOIN qn USING (query_id))) WHERE rank <= {k})"""


def expanded(x: str) -> str:
    parts = [f"CASE WHEN contains({x}, {q(a)}) AND NOT contains({x}, {q(f)}) THEN {q(f)} END" for a, f in LATIN.aliases.items()]
    parts += [f"CASE WHEN contains({x}, {q(c)}) AND NOT contains({x}, {q(p)}) THEN {q(p)} END" for c, ps in LATIN.components.items() for p in ps]
    parts.append(f"CASE WHEN contains({x}, {q(LATIN.proposal)}) AND contains({x}, {q(LATIN.dividend)}) THEN regexp_extract({x}, {q(LATIN.year_in_query)}, 1) || {q(LATIN.plan_suffix)} END")
    return f"concat_ws(' ', {x}, {', '.join(parts)})"


def meaningful(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda t: length(t) >= 2 AND NOT regexp_full_match(t, '[0-9]+')))"


def pool(by: bool = False) -> str:
    return f"""questions AS (SELECT item_id, text, {expanded('text')} AS expanded FROM benchmark), {cosine(120, by=by)}, {bm25(120, 'bm', 'expanded', by=by, source='questions')},
    merged AS (SELECT coalesce(c.query_id, b.query_id) AS query_id, coalesce(c.chunk_id, b.chunk_id) AS chunk_id, c.rank AS vector_rank, b.rank AS bm25_rank,
        coalesce(CAST(0.25 AS DOUBLE) / (10 + c.rank), 0) + coalesce(CAST(1.0 AS DOUBLE) / (10 + b.rank), 0) AS rrf_score FROM cos c FULL JOIN bm b ON c.query_id = b.query_id AND c.chunk_id = b.chunk_id),
    fused AS (SELECT * REPLACE (floor(rrf_score * 1e8 + 0.5) / 1e8 AS rrf_score), row_number() OVER (PARTITION BY query_id ORDER BY floor(merged.rrf_score * 1e12 + 0.5) / 1e12 DESC, chunk_id) AS rank FROM merged)"""


POOL = pool()


def _phrase() -> str:
    formals = ", ".join(f"CASE WHEN {q(f)} = query OR contains(expanded, {q(f)}) THEN {q(f)} END" for f in LATIN.aliases.values() if len(f) >= 2)
    phrases = f"list_filter([CASE WHEN length(query) >= 2 THEN query END, {formals}], lambda p: p IS NOT NULL)"
    return f"len(list_filter({phrases}, lambda p: contains(text, p))) / CAST(greatest(len({phrases}), 1) AS DOUBLE)"


def _numeric() -> str:
    near = "regexp_matches(text, '(?s)' || regexp_escape(t) || '.{0,49}[0-9]') OR regexp_matches(text, '(?s)[0-9].{0,19}' || regexp_escape(t)) OR regexp_matches(t, '[0-9]')"
    gate = f"regexp_matches(query, {q(LATIN.numeric_outer)}) AND regexp_matches(query, {q(LATIN.numeric_inner)})"
    return f"CASE WHEN NOT ({gate} AND regexp_matches(text, '[0-9]')) THEN 0.0 WHEN len(list_filter(terms, lambda t: length(t) >= 3 AND contains(text, t) AND ({near}))) > 0 THEN 1.0 ELSE 0.0 END"


def _multi() -> str:
    asked = {t: f"contains(expanded, {q(t)})" for t in LATIN.terms}
    for alias, formal in LATIN.aliases.items():
        asked[formal] = f"({asked[formal]} OR contains(query, {q(alias)}))" if formal in asked else f"contains(query, {q(alias)})"
    n = " + ".join(f"CAST({c} AS INT)" for c in asked.values())
    hit = " + ".join(f"CAST({c} AND contains(text, {q(t)}) AS INT)" for t, c in asked.items())
    parts = [f"CASE WHEN contains(query, {q(c)}) THEN ({' + '.join(f'CAST(contains(text, {q(p)}) AS INT)' for p in ps)}) / CAST({len(ps)} AS DOUBLE) ELSE 0 END" for c, ps in LATIN.components.items()]
    return f"greatest(CASE WHEN ({n}) > 0 THEN ({hit}) / CAST({n} AS DOUBLE) ELSE 0 END, {', '.join(parts)})"


def _intent() -> str:
    signals = ", ".join(f"CASE WHEN regexp_matches(query, {q(a)}) THEN CAST(regexp_matches(text, {q(b)}) AS INT) END" for a, b in LATIN.intents)
    wrong = f"regexp_matches(query, {q(LATIN.intent_proposal)}) AND regexp_matches(text, {q(LATIN.plan_done)})"
    return f"CASE WHEN {wrong} THEN CAST(-1 AS DOUBLE) ELSE coalesce(list_avg(list_filter([{signals}], lambda x: x IS NOT NULL)), 0) END"


def features(pool: str = POOL) -> str:
    weight = "list_sum(list_transform({}, lambda t: length(t) * length(t)))"
    covered = f"CASE WHEN len(terms) > 0 THEN coalesce({weight.format('list_filter(terms, lambda t: contains(text, t))')}, 0) / CAST({weight.format('terms')} AS DOUBLE) ELSE 0 END"
    return f"""{pool}, rows AS (SELECT f.*, u.text AS query, u.expanded, {meaningful('u.expanded')} AS terms, d.text FROM fused f JOIN questions u ON u.item_id = f.query_id JOIN documents d ON d.doc_id = f.chunk_id),
    featured AS (SELECT query_id, chunk_id, rank AS pre_rerank_rank, rrf_score, text, query, {covered} AS term_coverage, {_phrase()} AS phrase_score, {_numeric()} AS numeric_score, {_multi()} AS multi_metric_score, {_intent()} AS intent_alignment_score FROM rows),
    rescored AS (SELECT *, floor((1.0 * rrf_score + CAST(0.08 AS DOUBLE) * term_coverage + CAST(0.12 AS DOUBLE) * phrase_score + CAST(0.04 AS DOUBLE) * numeric_score + CAST(0.12 AS DOUBLE) * multi_metric_score + CAST(0.12 AS DOUBLE) * intent_alignment_score) * 1e8 + 0.5) / 1e8 AS rerank_score FROM featured),
    reranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, chunk_id) AS rank FROM rescored)"""


def cited(where: str = "true") -> str:
    return f"""{features()}, hits AS (SELECT * FROM reranked WHERE rank <= 5 AND {where}),
    near AS (SELECT *, first_value(rerank_score) OVER (PARTITION BY query_id ORDER BY rank) AS best, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS lead_ FROM hits),
    kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_id FROM near WHERE lead_ = 1 OR best <= 0 OR rerank_score >= best * CAST(0.7 AS DOUBLE)),
    cited AS (SELECT query_id, citation_id, chunk_id, rerank_score, {quote('text', salient('query'), 800)} AS quote FROM kept WHERE citation_id <= 5)"""


ANSWER = f"{q(EVIDENCE_ONLY)} || chr(10) || chr(10) || string_agg('[E' || citation_id || '] ' || quote, chr(10) || chr(10) ORDER BY citation_id)"
GOLD = "gold AS (SELECT b.item_id AS query_id, list(d.doc_id) AS gold FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1)"
METHODS = f"""{features()}, {GOLD}, lists AS (
    SELECT query_id, 'vector' AS method, vector_rank AS rank, chunk_id FROM fused WHERE vector_rank IS NOT NULL UNION ALL SELECT query_id, 'bm25', bm25_rank, chunk_id FROM fused WHERE bm25_rank IS NOT NULL
    UNION ALL SELECT query_id, 'hybrid_rrf', rank, chunk_id FROM fused UNION ALL SELECT query_id, 'hybrid_rerank', rank, chunk_id FROM reranked),
    firsts AS (SELECT g.query_id, m.method, (SELECT min(l.rank) FROM lists l WHERE l.query_id = g.query_id AND l.method = m.method AND l.rank <= 5 AND list_contains(g.gold, l.chunk_id)) AS first_rank
        FROM gold g CROSS JOIN (SELECT DISTINCT method FROM lists) m),
    table_ AS (SELECT method, count(*) AS questions, avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END) AS recall_at_3, avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(coalesce(1.0 / first_rank, 0)) AS mrr FROM firsts GROUP BY 1)"""
ASKED = "asked_documents AS (SELECT doc_id, d.text, coalesce(b.text, '') AS reference FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT greatest(count(*), 1) FROM benchmark))"
CASES = f"""{ASKED}, base AS (SELECT doc_id AS query_id, ['answered', 'refused', 'error', 'evidence_only'][CAST(doc_id % 4 + 1 AS BIGINT)] AS status, reference AS ref, text AS ans,
    [doc_id % 7] AS gold, [doc_id % 5, doc_id % 3] AS got, (doc_id % 13) / 4.0 AS seconds FROM asked_documents),
    marked AS (SELECT *, {numbers('ref')} AS want, {numbers('ans')} AS have, list_has_any(gold, got) AS page_hit FROM base),
    scored AS (SELECT *, CASE WHEN len(want) > 0 THEN len(list_filter(want, lambda n: list_contains(have, n))) / CAST(len(want) AS DOUBLE) END AS number_recall FROM marked),
    cases AS (SELECT *, status = 'answered' AND page_hit AND CASE WHEN len(want) > 0 THEN number_recall = 1.0 ELSE contains({loose('ans')}, {loose('ref')}) END AS proxy FROM scored)"""


def search(table: str, by: bool) -> str:
    on = "AND v.label = u.label" if by else ""
    dot = "list_dot_product(CAST({}.embedding AS DOUBLE[]), CAST({}.embedding AS DOUBLE[]))"
    score = f"{dot.format('v', 'u')} / (sqrt({dot.format('v', 'v')}) * sqrt({dot.format('u', 'u')}))"
    return f"""SELECT query_id, rank, chunk_id, {six('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e9 + 0.5) / 1e9 DESC, chunk_id) AS rank
        FROM (SELECT u.vec_id AS query_id, v.vec_id AS chunk_id, {score} AS score FROM {table} u JOIN {table} v ON u.vec_id % 20 = 0 {on})) WHERE rank <= 5"""


def oracle_sql() -> dict[str, str]:
    hits = "SELECT query_id, rank, chunk_id, " + six("score", "score")
    names = ("term_coverage", "phrase_score", "numeric_score", "multi_metric_score", "intent_alignment_score")
    contiguous = """SELECT document_id, min(pdf_page) AS first_page, max(pdf_page) AS last_page, count(*) AS page_rows, count(DISTINCT pdf_page) AS distinct_pages,
        min(pdf_page) = 1 AND max(pdf_page) = count(*) AND count(DISTINCT pdf_page) = count(*) AS contiguous"""
    rules = q("\n".join(RULES) + "\n\n问题：")
    prompts = f"""WITH {cited()}, p AS (SELECT query_id, {rules} || any_value(b.text) || chr(10) || chr(10) || string_agg('[E' || citation_id || '] ' || chr(10) || chr(10) || quote, chr(10) || chr(10) ORDER BY citation_id) || chr(10) AS prompt
            FROM cited JOIN benchmark b ON item_id = query_id GROUP BY 1)"""
    return {
        "compact_chars": f"SELECT doc_id, {compact('text')} AS compact_chars FROM documents",
        "normalized_text": f"SELECT doc_id, len({lines('text')}) AS n_lines, md5(array_to_string({lines('text')}, chr(10))) AS text_md5 FROM documents",
        "margin_lines": f"WITH {margins(0.02)} SELECT document_id, line, pages, threshold FROM margin",
        "margin_removed_pages": f"WITH {without(0.02)} SELECT doc_id, len(kept) AS n_lines, md5(array_to_string(kept, chr(10))) AS lines_md5 FROM clean",
        "printed_page": f"WITH d AS (SELECT doc_id, {lines("regexp_replace(text, '[a-zA-Z.,]+', '', 'g')")} AS l FROM documents) SELECT doc_id, {printed('l')} AS printed_page FROM d",
        "chapter_fill": f"WITH {CHAPTERED} SELECT document_id, pdf_page, chapter FROM chaptered",
        "unit_context_fill": """SELECT conv_id AS document_id, turn AS pdf_page, last_value(CASE WHEN regexp_extract(text, 'the ([a-z]+)', 1) <> '' THEN 'unit ' || regexp_extract(text, 'the ([a-z]+)', 1) END IGNORE NULLS)
            OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS unit_context FROM conversations""",
        "page_quality_flags": f"WITH {PARSED} SELECT doc_id, char_count, array_to_string(flags, ',') AS flags FROM parsed",
        "flag_histogram": f"WITH {PARSED} SELECT flag, count(*) AS pages FROM (SELECT unnest(flags) AS flag FROM parsed) GROUP BY 1",
        "parse_quality": f"""WITH {PARSED} SELECT document_id, count(*) AS page_count, CAST(sum(char_count) AS BIGINT) AS total_chars, round_even(avg(char_count), 2) AS mean_chars, count(printed_page) AS pages_with_printed_page,
            count(*) FILTER (chapter <> 'unknown') AS pages_with_chapter, count(*) FILTER (len(flags) > 0) AS flagged_pages, min(pdf_page) FILTER (len(flags) > 0) AS first_flagged_page FROM parsed GROUP BY 1""",
        "audit_samples": f"""WITH {PARSED}, a AS (SELECT document_id, 0 AS p, 'cover' AS category, 1 AS pdf_page FROM parsed GROUP BY 1
            UNION ALL SELECT document_id, 1, 'table_of_contents', min(pdf_page) FROM parsed WHERE starts_with(ltrim(text), 'The') AND (length(text) - length(replace(text, 'th', ''))) / 2 >= 4 GROUP BY 1
            UNION ALL SELECT document_id, 2, 'financial_table', min(pdf_page) FROM parsed WHERE contains(text, 'Apache License') OR contains(text, 'MIT License') GROUP BY 1),
            b AS (SELECT document_id, 3, 'body_text', arg_max(pdf_page, {{'m': list_sum(list_transform(string_split(text, chr(10)), lambda x: length(x))) / CAST(len(string_split(text, chr(10))) AS DOUBLE), 'q': -pdf_page}}) FROM parsed
                WHERE len(flags) = 0 AND char_count BETWEEN 700 AND 2000 AND contains(chapter, 'License') AND NOT contains(text, 'token') AND NOT contains(text, '@')
                AND NOT EXISTS (SELECT 1 FROM a WHERE a.document_id = parsed.document_id AND a.pdf_page = parsed.pdf_page) GROUP BY 1),
            e AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT document_id, 4, 'flagged_page', pdf_page FROM parsed WHERE len(flags) > 0)
            SELECT document_id, arg_min(category, p) AS category, pdf_page FROM e GROUP BY document_id, pdf_page""",
        "page_contiguity": f"WITH {PAGES} {contiguous} FROM pages GROUP BY 1",
        "turn_contiguity": f"{contiguous} FROM (SELECT conv_id AS document_id, turn + 1 AS pdf_page FROM conversations) GROUP BY 1",
        "duplicate_ids": "SELECT l_orderkey AS key, count(*) AS times FROM lineitem GROUP BY 1 HAVING count(*) > 1",
        "fingerprint": "SELECT page_id, octet_length(encode(html)) AS length, sha256(html) AS file_hash FROM pages",
        "registration_check": f"""WITH {PAGES}, n AS (SELECT document_id, count(*) AS page_count FROM pages GROUP BY 1),
            s AS (SELECT document_id, page_count, string_agg(text, chr(10) ORDER BY pdf_page) AS sample FROM pages JOIN n USING (document_id) WHERE pdf_page - 1 IN (0, 1, 2, page_count // 2, page_count - 1) GROUP BY ALL),
            m AS (SELECT *, list_filter(['the', 'der', 'License'], lambda k: NOT contains(sample, k)) AS missing FROM s)
            SELECT document_id, page_count, {compact('sample')} AS sample_chars, {compact('sample')} >= 200 AS is_text, array_to_string(missing, ',') AS missing, {compact('sample')} >= 200 AND len(missing) = 0 AS accepted FROM m""",
        "registered_manifest": """SELECT CAST(d.doc_id AS VARCHAR) AS document_id, coalesce(CAST(l.quality + 1 AS VARCHAR), '') AS page_count, CASE WHEN l.doc_id IS NOT NULL THEN 'pending' ELSE 'parsed' END AS parse_status
            FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "lifecycle_gate": """WITH s AS (SELECT doc_id, ['pending', 'parsed', 'audited', 'baseline_chunked', 'structured_chunked'][CAST(doc_id % 5 + 1 AS BIGINT)] AS status FROM documents)
            SELECT doc_id, status, status = 'pending' AS parse, status IN ('parsed', 'audited', 'baseline_chunked') AS audit, status IN ('audited', 'baseline_chunked') AS fixed_chunks,
            status IN ('baseline_chunked', 'structured_chunked') AS structured_chunks, CASE status WHEN 'pending' THEN 'parsed' WHEN 'parsed' THEN 'audited' WHEN 'audited' THEN 'baseline_chunked'
            WHEN 'baseline_chunked' THEN 'structured_chunked' ELSE 'retrieval_quality_accepted' END AS next_status FROM s""",
        "fixed_chunks": f"WITH {FIXED} SELECT chunk_id, char_count, md5(text) AS text_md5, array_to_string(pages, ',') AS pages, chapter, n_chapters FROM fixed",
        "fixed_chunk_quality": f"""WITH {FIXED} SELECT document_id, count(*) AS chunk_count, count(*) FILTER (len(pages) > 1) AS cross_page, count(*) FILTER (n_chapters > 1) AS cross_chapter, min(char_count) AS min_chars,
            max(char_count) AS max_chars, CAST(sum(char_count) AS BIGINT) AS sum_chars, round_even(avg(char_count), 2) AS mean_chars, arg_min(chunk_id, i) AS first_chunk, arg_max(chunk_id, i) AS last_chunk FROM fixed GROUP BY 1""",
        "structured_chunks": f"WITH RECURSIVE {STRUCTURED} SELECT chunk_id, char_count, md5(text) AS text_md5, array_to_string(pages, ',') AS pages, chapter FROM structured",
        "structured_quality": f"WITH RECURSIVE {STRUCTURED} SELECT *, round_even(natural_endings / CAST(chunk_count AS DOUBLE), 4) AS natural_rate FROM natural_",
        "strategy_delta": f"""WITH RECURSIVE {STRUCTURED}, {FIXED.split("AS chapter FROM pages), ", 1)[1]},
            fq AS (SELECT document_id, count(*) AS chunk_count, count(*) FILTER (len(pages) > 1) AS cross_page, count(*) FILTER (n_chapters > 1) AS cross_chapter FROM fixed GROUP BY 1)
            SELECT document_id, {CHANGE.format('chunk_count', 'chunk_change')}, {CHANGE.format('cross_page', 'cross_page_change')}, s.cross_chapter - f.cross_chapter AS cross_chapter_change FROM fq f JOIN natural_ s USING (document_id)""",
        "printed_pages": f"""WITH RECURSIVE {STRUCTURED} SELECT chunk_id, 'chapter_paragraph' AS strategy, CAST(pages[1] AS INT) AS pdf_page_start, CAST(pages[-1] AS INT) AS pdf_page_end,
            array_to_string(list_transform(pages, lambda p: p + 4), ',') AS printed_pages, CAST(length(document_id) + 2000 AS INT) AS report_year FROM structured""",
        "parse_driver": f"WITH {PAGES} SELECT document_id, CAST(count(*) AS VARCHAR) AS page_count, 'parsed' AS parse_status, count(*) || ' pages parsed' AS notes FROM pages GROUP BY 1",
        "chunk_driver": f"WITH {FIXED} SELECT document_id, '' AS page_count, 'baseline_chunked' AS parse_status, count(*) || ' chunks' AS notes FROM fixed GROUP BY 1",
        "chunk_metadata": f"""WITH {FIXED} SELECT chunk_id, document_id, {REPORTED}, 'annual' AS report_type, 'fixed_char' AS strategy, chapter, CAST(pages[1] AS INT) AS pdf_page_start, CAST(pages[-1] AS INT) AS pdf_page_end,
            '[' || array_to_string(pages, ', ') || ']' AS pdf_pages_json, document_id || '.pdf' AS source_file, 'https://example.com/' || document_id AS source_url FROM fixed""",
        "index_build": f"""WITH {FIXED} SELECT document_id, 'annual_reports_baseline_hashed_ngrams_64' AS collection, 'baseline' AS strategy, 'hashed_ngrams_64' AS embedder, 64 AS dimensions, count(*) AS indexed_chunks,
            CAST((SELECT count(*) FROM fixed) AS BIGINT) AS total_chunks FROM fixed GROUP BY 1""",
        "token_stats": f"SELECT lang, count(*) AS n_docs, CAST(sum(len({tokens('text')})) AS BIGINT) AS total_tokens, {six(f'avg(len({tokens('text')}))', 'avgdl')} FROM documents GROUP BY 1",
        "bm25_top5": f"WITH {bm25(5, 'top')} {hits} FROM top",
        "bm25_top5_filtered": f"WITH {bm25(5, 'top', by=True)} {hits} FROM top",
        "token_cosine_top5": f"WITH {cosine(5)} {hits} FROM cos",
        "vector_top5": search("embeddings", False),
        "vector_top5_filtered": search("embeddings", True),
        "vector_index_recall": """SELECT count(*) AS questions, CAST(count(*) * least(5, (SELECT count(*) FROM embeddings)) AS BIGINT) AS hits, true AS recall_reached
            FROM embeddings WHERE vec_id % 20 = 0""",
        "index_upsert": "SELECT CAST(label AS VARCHAR) AS document_id, count(*) AS vectors, min(len(embedding)) AS dimensions, max(len(embedding)) AS most_dimensions FROM embeddings GROUP BY 1",
        "rrf": f"WITH {POOL} SELECT query_id, rank, chunk_id, vector_rank, bm25_rank, {six('rrf_score', 'rrf_score')} FROM fused",
        "expand_query": f"SELECT item_id AS query_id, {expanded('text')} AS expanded, len({meaningful(expanded('text'))}) AS n_terms FROM benchmark",
        "rerank_features": f"WITH {features()} SELECT query_id, chunk_id, pre_rerank_rank, {', '.join(six(n, n) for n in names)} FROM featured",
        "hybrid_top5": f"WITH {features()} SELECT query_id, rank, chunk_id, pre_rerank_rank, {six('rerank_score', 'rerank_score')} FROM reranked WHERE rank <= 5",
        "hybrid_top5_filtered": f"WITH {features(pool(True))} SELECT query_id, rank, chunk_id, pre_rerank_rank, {six('rerank_score', 'rerank_score')} FROM reranked WHERE rank <= 5",
        "hit_projection": f"""WITH {bm25(5, 'top')} SELECT query_id, rank, chunk_id, {six('score', 'score')}, upper(source) AS company, lang AS stock_code, CAST(doc_id % 7 + 2000 AS INT) AS report_year, 'unknown' AS chapter,
            CAST(doc_id + 1 AS INT) AS pdf_page_start, CAST(doc_id + 2 AS INT) AS pdf_page_end, (doc_id + 1) || ',' || (doc_id + 2) AS pdf_pages, source || '.pdf' AS source_file, 'https://example.com/' || source AS source_url,
            md5(text) AS text FROM top JOIN documents ON doc_id = chunk_id""",
        "scope_gate": f"SELECT doc_id, regexp_matches(text, {q('|'.join(LATIN.advice))}) AS refused FROM documents",
        "evidence_gate": f"""WITH {features()}, m AS (SELECT query_id, max(term_coverage) AS c FROM reranked WHERE rank <= 5 GROUP BY 1)
            SELECT item_id AS query_id, {six('coalesce(c, 0)', 'max_coverage')}, CASE WHEN c IS NULL THEN 'no_retrieval_results' WHEN c < 0.5 THEN 'low_evidence_relevance' END AS refusal_reason FROM benchmark LEFT JOIN m ON query_id = item_id""",
        "citations": f"WITH {cited()} SELECT query_id, citation_id, chunk_id, quote, {six('rerank_score', 'retrieval_score')} FROM cited",
        "quote_window": f"WITH {ASKED} SELECT doc_id, {quote('text', salient('reference'), 800)} AS quote FROM asked_documents",
        "evidence_answer": f"WITH {cited()} SELECT query_id, {ANSWER} AS answer FROM cited GROUP BY 1",
        "prompt": f"""{prompts} SELECT query_id, md5(prompt) AS prompt_md5, length(prompt) AS length FROM p""",
        "generated_answers": f"""{prompts} SELECT query_id,
            CASE WHEN length(prompt) % 5 <> 0 THEN length(prompt) || ' characters [E1]' END AS answer, CASE WHEN length(prompt) % 5 = 0 THEN 'TimeoutError: no reply' END AS error FROM p""",
        "citation_validate": f"""WITH {cited()}, v AS (SELECT DISTINCT query_id FROM cited) SELECT query_id, ['answered', 'error', 'error', 'refused'][CAST(query_id % 4 + 1 AS BIGINT)] AS status,
            [NULL, 'unknown_citation', 'no_citation', 'generator_evidence_insufficient'][CAST(query_id % 4 + 1 AS BIGINT)] AS problem, ['1', '1,9', '', ''][CAST(query_id % 4 + 1 AS BIGINT)] AS cited FROM v""",
        "answers": f"""WITH {cited()}, m AS (SELECT query_id, max(term_coverage) AS c FROM reranked WHERE rank <= 5 GROUP BY 1), t AS (SELECT query_id, {ANSWER} AS answer FROM cited GROUP BY 1),
            s AS (SELECT item_id AS query_id, CASE WHEN regexp_matches(b.text, {q('|'.join(LATIN.advice))}) THEN 'out_of_scope' WHEN c IS NULL THEN 'no_retrieval_results' WHEN c < 0.08 THEN 'low_evidence_relevance' END AS refusal_reason
                FROM benchmark b LEFT JOIN m ON query_id = item_id)
            SELECT query_id, CASE WHEN refusal_reason IS NULL THEN 'evidence_only' ELSE 'refused' END AS status, refusal_reason, CASE WHEN refusal_reason IS NULL THEN md5(answer) END AS answer_md5 FROM s LEFT JOIN t USING (query_id)""",
        "evidence_pages": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS VARCHAR) WHEN 1 THEN array_to_string(range(doc_id, doc_id + 3), ',')
            WHEN 2 THEN CASE WHEN doc_id < 7 THEN doc_id || ',7' WHEN doc_id = 7 THEN '7' ELSE '7,' || doc_id END END AS pages FROM documents""",
        "first_rank": f"WITH {METHODS} SELECT query_id, method, first_rank FROM firsts",
        "method_compare": f"WITH {METHODS} SELECT method, questions, {', '.join(six(c, c) for c in ('recall_at_3', 'recall_at_5', 'mrr'))}, {six("recall_at_5 - (SELECT recall_at_5 FROM table_ WHERE method = 'vector')", 'lift')} FROM table_",
        "single_method": f"""WITH {bm25(10, 'top')}, {GOLD}, r AS (SELECT g.query_id, (SELECT min(rank) FROM top t WHERE t.query_id = g.query_id AND list_contains(g.gold, t.chunk_id)) AS first_rank FROM gold g)
            SELECT 'bm25' AS method, count(*) AS questions, {six('avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END)', 'recall_at_3')}, {six('avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END)', 'recall_at_5')},
            {six('avg(coalesce(1.0 / first_rank, 0))', 'mrr')} FROM r""",
        "acceptance": f"WITH {METHODS} SELECT coalesce(bool_or(recall_at_5 >= 0.8), false) AS accepted, {six('max(recall_at_5)', 'best_recall')} FROM table_",
        "number_norm": f"SELECT doc_id, array_to_string({numbers('text')}, '|') AS numbers FROM documents",
        "answer_case": f"WITH {CASES} SELECT query_id, status, page_hit, {six('number_recall', 'number_recall')}, proxy FROM cases",
        "answer_summary": f"""WITH {CASES}, done AS (SELECT * FROM cases WHERE status <> 'error'), numeric_ AS (SELECT * FROM done WHERE number_recall IS NOT NULL)
            SELECT (SELECT count(*) FROM cases) AS cases, count(*) AS completed, count(*) FILTER (status = 'answered') AS answered, count(*) FILTER (status = 'refused') AS refused,
            (SELECT count(*) FROM cases WHERE status = 'error') AS errors, (SELECT count(*) FROM cases WHERE status = 'error' OR NOT proxy) AS failures,
            {six('count(*) FILTER (page_hit) / greatest(count(*), 1)', 'page_hit_rate')}, (SELECT {six('count(*) FILTER (number_recall = 1) / greatest(count(*), 1)', 'r')} FROM numeric_) AS full_recall_rate,
            {six('avg(number_recall)', 'mean_number_recall')}, {six('count(*) FILTER (proxy) / greatest(count(*), 1)', 'proxy_rate')},
            {six('avg(seconds)', 'mean_seconds')}, {six('median(seconds)', 'median_seconds')}, {six('max(seconds)', 'max_seconds')} FROM done""",
        "answer_failures": f"WITH {CASES} SELECT query_id, status FROM cases WHERE status = 'error' OR NOT proxy",
        "event_medians": f"SELECT event_type, count(value) AS n, {six('median(value)', 'median')} FROM events GROUP BY 1",
        "retrieval_misses": f"WITH {METHODS} SELECT method, query_id FROM firsts WHERE coalesce(first_rank, 6) > 5",
        "flagged_pages": f"WITH {PARSED} SELECT document_id, pdf_page, array_to_string(flags, ',') AS flags, char_count FROM parsed WHERE len(flags) > 0",
        "bm25_index_top5": f"WITH {bm25(5, 'top')} {hits} FROM top",
        "bm25_index_top5_filtered": f"WITH {bm25(5, 'top', by=True)} {hits} FROM top",
        "evaluation_round": f"""WITH {CASES}, kept AS (SELECT doc_id FROM labels WHERE quality <> 0), made AS (SELECT c.*, query_id % 11 = 0 AS none, query_id % 6 = 0 AS broken FROM cases c WHERE query_id NOT IN (SELECT doc_id FROM kept))
            SELECT doc_id AS query_id, 'answered' AS status, true AS page_hit, CAST(1 AS DOUBLE) AS number_recall, true AS proxy, CAST(0.5 AS DOUBLE) AS seconds, CAST(NULL AS VARCHAR) AS error FROM kept JOIN documents USING (doc_id)
            UNION ALL SELECT query_id, CASE WHEN none OR broken THEN 'error' ELSE 'answered' END, NOT (none OR broken) AND page_hit, CASE WHEN NOT (none OR broken) THEN floor(number_recall * 1e6 + 0.5) / 1e6 END,
            NOT (none OR broken) AND page_hit AND CASE WHEN len(want) > 0 THEN number_recall = 1.0 ELSE contains({loose('ans')}, {loose('ref')}) END, CASE WHEN NOT none THEN CAST(seconds AS DOUBLE) END,
            CASE WHEN none THEN 'no result' WHEN broken THEN 'refused connection' END FROM made""",
        "resume_pending": "SELECT doc_id AS query_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality <> 0)",
    }
