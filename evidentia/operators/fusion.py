"""Query expansion, reciprocal rank fusion, and reranking by lexical rules.

What depends on the question alone is computed once for each question, then joined to its hits; the
dictionaries become literals of the expressions. Where a question's terms stand in a text, and which
of those places have a number near, is found in one pass over each candidate (``placed``): terms are
rows' values, so as expressions they would be patterns compiled for every row and term.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LATIN, Lexicon, RetrievalConfig
from ..functions import text as X
from ..sources.scratch import stored
from .blocks import rounded, slices
from .lexical import bm25, index, token_cosine


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def expand(query: Column, lexicon: Lexicon = LATIN) -> Column:
    """The query, formal names of its aliases, components of its concepts, and the plan of a proposed dividend."""
    more = [F.when(query.contains(alias) & ~query.contains(formal), F.lit(formal)) for alias, formal in lexicon.aliases.items()]
    more += [F.when(query.contains(concept) & ~query.contains(part), F.lit(part)) for concept, parts in lexicon.components.items() for part in parts]
    year = F.regexp_extract(query, lexicon.year_in_query, 1)
    more.append(F.when(query.contains(lexicon.proposal) & query.contains(lexicon.dividend), F.concat(year, F.lit(lexicon.plan_suffix))))
    return F.concat_ws(" ", query, *more)


#: How far from a term a number may begin before it, and end after it.
BEFORE, AFTER = 20, 50


def near_number(text: str, terms: list[str]) -> bool:
    """Whether a term of three or more characters has a digit from BEFORE in front of to AFTER behind one of its places, or in itself."""
    digits = [m.start() for m in re.finditer("[0-9]", text)]
    for term in terms:
        if len(term) < 3:
            continue
        at = text.find(term)
        if at >= 0 and re.search("[0-9]", term):
            return True
        while at >= 0:
            i = bisect_left(digits, at - BEFORE)
            if i < len(digits) and digits[i] < at + len(term) + AFTER:
                return True
            at = text.find(term, at + 1)
    return False


def placed(rows: DataFrame) -> DataFrame:
    """Adds term_coverage, the share of the terms in the text weighted by the square of their length, and numeric_score, 1 where
    ``_numeric`` holds and a term in the text has a number near. Null text has no term; without terms both are 0."""
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.drop("_numeric").dtypes) + ", term_coverage double, numeric_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            covered, numeric = [], []
            for text, terms, wanted in zip(*(batch.column(c).to_pylist() for c in ("text", "terms", "_numeric")), strict=True):
                text, terms = text or "", terms or []
                found = [t for t in terms if t in text]
                whole = sum(len(t) ** 2 for t in terms)
                covered.append(sum(len(t) ** 2 for t in found) / whole if whole else 0.0)
                numeric.append(1.0 if wanted and near_number(text, found) else 0.0)
            kept = [c for c in batch.schema.names if c != "_numeric"]
            yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(covered, pa.float64()), pa.array(numeric, pa.float64())], [*kept, "term_coverage", "numeric_score"])

    return rows.mapInArrow(run, schema)


def share(present: list[Column]) -> Column:
    return sum((p.cast("int") for p in present), F.lit(0)) / float(len(present)) if present else F.lit(0.0)


def phrase_score(query: Column, expanded: Column, text: Column, lexicon: Lexicon = LATIN) -> Column:
    """Share of the phrases (the query, and formal names in its expansion) that the text has."""
    formals = [F.when((F.lit(formal) == query) | expanded.contains(formal), F.lit(formal)) for formal in lexicon.aliases.values() if len(formal) >= 2]
    phrases = F.array_compact(F.array(F.when(F.length(query) >= 2, query), *formals))
    return F.size(F.filter(phrases, lambda p: text.contains(p))) / F.greatest(F.size(phrases), F.lit(1))


def numeric_question(query: Column, text: Column, lexicon: Lexicon = LATIN) -> Column:
    """Whether a question asks for a number and the text has any."""
    return query.rlike(lexicon.numeric_outer) & query.rlike(lexicon.numeric_inner) & text.rlike("[0-9]")


def multi_metric_score(query: Column, expanded: Column, text: Column, lexicon: Lexicon = LATIN) -> Column:
    """The better of: share of the requested terms present, and the best share of a concept's components."""
    formals = dict.fromkeys(lexicon.aliases.values())
    asked = {t: expanded.contains(t) for t in lexicon.terms}
    for formal in formals:
        by_alias = any_of(query.contains(a) for a, f in lexicon.aliases.items() if f == formal)
        asked[formal] = asked[formal] | by_alias if formal in asked else by_alias
    n = sum((c.cast("int") for c in asked.values()), F.lit(0))
    hit = sum(((c & text.contains(t)).cast("int") for t, c in asked.items()), F.lit(0))
    requested = F.when(n > 0, hit / n).otherwise(F.lit(0.0))
    concepts = [F.when(query.contains(c), share([text.contains(p) for p in parts])).otherwise(F.lit(0.0)) for c, parts in lexicon.components.items()]
    return F.greatest(requested, F.lit(0.0), *concepts)


def intent_score(query: Column, text: Column, lexicon: Lexicon = LATIN) -> Column:
    """Mean of the signals that apply; -1 where a proposal question meets another year's or a finished plan."""
    year = F.regexp_extract(query, lexicon.year_in_query, 1)
    years = F.regexp_extract_all(text, F.lit(lexicon.plan_years), F.lit(1))
    other_year = (year != "") & (F.size(years) > 0) & ~F.array_contains(years, year)
    wrong = query.rlike(lexicon.intent_proposal) & (other_year | text.rlike(lexicon.plan_done))
    signals = F.array_compact(F.array(*(F.when(query.rlike(asked), text.rlike(needed).cast("double")) for asked, needed in lexicon.intents)))
    mean = F.when(F.size(signals) > 0, F.aggregate(signals, F.lit(0.0), lambda s, v: s + v) / F.size(signals)).otherwise(F.lit(0.0))
    return F.when(wrong, F.lit(-1.0)).otherwise(mean)


def rrf(vector: DataFrame, lexical: DataFrame, rrf_k: int = 10, vector_weight: float = 0.25, bm25_weight: float = 1.0) -> DataFrame:
    """query_id, rank, chunk_id, rrf_score and both branches' ranks and scores: a full outer join of two rankings."""
    v = vector.select("query_id", "chunk_id", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    w = lexical.select("query_id", "chunk_id", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    both = v.join(w, ["query_id", "chunk_id"], "full_outer")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(rrf_k) + F.col(rank)), F.lit(0.0))
    both = both.withColumn("rrf_score", part(vector_weight, "vector_rank") + part(bm25_weight, "bm25_rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc(rounded(F.col("rrf_score"), 12)), "chunk_id")
    fused = both.withColumn("rank", F.row_number().over(order)).withColumn("rrf_score", rounded(F.col("rrf_score"), 8))  # ranked before it is rounded
    return fused.withColumn("score", F.col("rrf_score"))


def features(questions: DataFrame, lexicon: Lexicon = LATIN) -> DataFrame:
    """query_id, query, expanded, terms: what reranking needs of a question, once."""
    out = questions.select("query_id", "query", expand(F.col("query"), lexicon).alias("expanded"))
    return out.withColumn("terms", X.meaningful(F.col("expanded")))


def rerank(hits: DataFrame, questions: DataFrame, chunks: DataFrame, config: RetrievalConfig | None = None, lexicon: Lexicon = LATIN) -> DataFrame:
    """The hits in a new order, with the features that made it. Text is joined to the candidates alone."""
    config = config or RetrievalConfig()
    q, e, text = (F.col(c) for c in ("query", "expanded", "text"))
    rows = hits.join(features(questions, lexicon), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    rows = placed(rows.withColumn("_numeric", numeric_question(q, text, lexicon))).withColumns({
        "phrase_score": phrase_score(q, e, text, lexicon),
        "multi_metric_score": multi_metric_score(q, e, text, lexicon), "intent_alignment_score": intent_score(q, text, lexicon),
    })
    total = (
        config.rrf_weight * F.col("rrf_score") + config.coverage_weight * F.col("term_coverage") + config.phrase_weight * F.col("phrase_score")
        + config.numeric_weight * F.col("numeric_score") + config.phrase_weight * F.col("multi_metric_score") + config.phrase_weight * F.col("intent_alignment_score")
    )
    rows = rows.withColumn("rerank_score", rounded(total, 8)).withColumn("pre_rerank_rank", F.col("rank"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).withColumn("score", F.col("rerank_score")).drop("expanded", "terms")


def hybrid(chunks: DataFrame, questions: DataFrame, vector_search=None, config: RetrievalConfig | None = None, lexicon: Lexicon = LATIN, reranked: bool = True, by: list[str] | None = None) -> DataFrame:
    """Vector hits of the question as asked, BM25 hits of its expansion, fused, reranked, and cut.

    vector_search(questions, k, by) -> hits is the injected vector branch; without it, token counts are compared.
    Both branches filter by the columns ``by``, on which a question and a chunk have to agree.
    """
    config = config or RetrievalConfig()
    table = index(chunks, by)
    search = vector_search or (lambda q, k, by: token_cosine(chunks, q, k, by, table))
    asked = questions.withColumn("query", expand(F.col("query"), lexicon))
    lexical = bm25(chunks, asked, config.candidate_pool, config.k1, config.b, by, table)
    fused = stored(rrf(search(questions, config.candidate_pool, by), lexical, config.rrf_k, config.vector_weight, config.bm25_weight), "fused")
    out = rerank(fused, questions, chunks, config, lexicon) if reranked else fused
    return out.filter(F.col("rank") <= config.top_k)
