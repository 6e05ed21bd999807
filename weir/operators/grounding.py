"""Claims of a completion against the chunks of its context, and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.functions import similarity as S, text as T
from weir.operators.decision import result

LEXICAL_GATE = 0.8
NLI = "struct<entailment:double,contradiction:double,neutral:double>"


def _best(words: Column, tokens: Column, chunks: Column) -> Column:
    scored = F.transform(tokens, lambda t, i: F.struct(S.recall(words, t).alias("overlap"), (-i).alias("back")))

    def best(top: Column) -> Column:
        return F.struct(
            F.coalesce(top["overlap"], F.lit(0.0)).alias("overlap"),
            (-top["back"]).alias("index"),
            F.coalesce(F.when(top.isNotNull(), F.try_element_at(chunks, 1 - top["back"])), F.lit("")).alias("chunk"),
        )

    return T.let(F.array_max(scored), best)


def best_chunk(claim: Column, chunks: Column) -> Column:
    """struct<overlap, index, chunk> of the first chunk with the most of the claim's words; overlap 0.0 and "" without chunks."""
    return _best(T.tokens(claim), F.transform(chunks, T.tokens), chunks)


def aligned(completion: Column, context: Column) -> Column:
    """array<struct<claim, n_words, overlap, index, chunk>> of the claims, in order; every text is cut into words once."""
    def one(tokens: Column):
        def claim(c: Column) -> Column:
            def of(words: Column) -> Column:
                return T.let(
                    _best(words, tokens, context),
                    lambda b: F.struct(c.alias("claim"), F.size(words).alias("n_words"), b["overlap"].alias("overlap"), b["index"].alias("index"), b["chunk"].alias("chunk")),
                )

            return T.let(T.tokens(c), of)

        return claim

    return T.let(F.transform(context, T.tokens), lambda tokens: F.transform(T.claims(completion), one(tokens)))


def align(requests: DataFrame, completion: str = "completion_text", context: str = "retrieved_context") -> DataFrame:
    """A row for each claim: claim_index, claim, overlap, chunk_index, chunk; other columns kept."""
    rows = requests.select("*", F.posexplode(aligned(F.col(completion), F.col(context))).alias("claim_index", "_b"))
    return rows.select(*requests.columns, "claim_index", "_b.claim", "_b.overlap", F.col("_b.index").alias("chunk_index"), "_b.chunk")


def lexical(claim: Column, ascii_edges: bool = False) -> Column:
    """The lexical comparison of an aligned claim with its chunk; ascii_edges as in T.negated."""
    return S.nli_of(claim["n_words"], claim["overlap"], T.negated(claim["claim"], ascii_edges) != T.negated(claim["chunk"], ascii_edges))


def grounding_scores(completion: Column, context: Column, ascii_edges: bool = False) -> Column:
    """array<double>: the grounding of each claim, in order: 1.0 from the lexical gate on, else by the lexical comparison."""
    return F.transform(aligned(completion, context), lambda c: F.when(c["overlap"] >= LEXICAL_GATE, 1.0).otherwise(S.grounding(lexical(c, ascii_edges))))


def model_pairs(claims: Column) -> Column:
    """array<struct<context, claim>> of the aligned claims that a model has to judge."""
    return F.transform(F.filter(claims, lambda c: c["overlap"] < LEXICAL_GATE), lambda c: F.struct(c["chunk"].alias("context"), c["claim"].alias("claim")))


def model_grounding(claims: Column, judged: Column) -> Column:
    """array<double> of the aligned claims from a model's array<NLI> on model_pairs, put back in order."""
    def place(i: Column) -> Column:
        return F.size(F.filter(F.slice(claims, F.lit(1), i + 1), lambda c: c["overlap"] < LEXICAL_GATE))

    return F.transform(claims, lambda c, i: F.when(c["overlap"] >= LEXICAL_GATE, 1.0).otherwise(S.grounding(F.try_element_at(judged, place(i)))))


def grounding_summary(scores: Column, early_exit: Column, least: Column) -> Column:
    """struct<score, passed, evaluated>: the first claim below early_exit decides, else the mean (1.0 without claims)."""
    def of(s: Column) -> Column:
        at = F.array_position(F.transform(s, lambda x: x < early_exit), True)
        mean = F.when(F.size(s) == 0, 1.0).otherwise(F.aggregate(s, F.lit(0.0), lambda a, x: a + x) / F.size(s))
        score = F.when(at > 0, F.try_element_at(s, at.cast("int"))).otherwise(mean)
        return F.struct(
            score.alias("score"), ((at == 0) & (mean >= least)).alias("passed"),
            F.when(at > 0, at.cast("int")).otherwise(F.size(s)).alias("evaluated"),
        )

    return T.let(scores, of)


def grounding_guard(found: Column, action: Column, fallback: Column) -> Column:
    """From a column of grounding_summary."""
    bad = ~found["passed"]
    return result(
        "rag_hallucination_engine", "POST", ~bad, found["score"], F.when(bad, F.upper(action)).otherwise("ALLOW"),
        F.when(bad, "LOW_GROUNDING_HALLUCINATION"), F.when(bad, F.concat(F.lit("Grounding score "), F.round(found["score"], 3).cast("string"))),
        F.when(bad, fallback),
    )


def rerank_context(chunks: Column, scores: Column, least: Column, top_k: Column) -> Column:
    """Chunks with a score of `least` or more, best first, at most top_k; the best one if none reaches it."""
    ranked = F.array_sort(F.zip_with(F.transform(scores, lambda s, i: F.struct((-s).alias("neg"), i.alias("at"))), chunks, lambda s, c: F.struct(s["neg"], s["at"], c.alias("chunk"))))

    def of(r: Column) -> Column:
        good = F.filter(r, lambda x: -x["neg"] >= least)
        kept = F.when(F.size(good) > 0, good).otherwise(F.slice(r, 1, 1))
        return F.transform(F.slice(kept, F.lit(1), F.coalesce(top_k, F.greatest(F.size(kept), F.lit(1)))), lambda x: x["chunk"])

    return T.let(ranked, of)


def cited(completion: Column, context: Column) -> Column:
    """array<struct<citation, score, chunk_index>>: each citation with its best chunk (the first of equals; 0.0 and null without chunks)."""
    def against(features: Column):
        def one(c: Column) -> Column:
            def of(own: Column) -> Column:
                scored = F.transform(features, lambda f, i: F.struct(S.citation_match(own, f).alias("score"), (-i).alias("back")))
                return T.let(
                    F.array_max(scored), lambda t: F.struct(c.alias("citation"), F.coalesce(t["score"], F.lit(0.0)).alias("score"), (-t["back"]).alias("chunk_index"))
                )

            return T.let(S.citation_features(c["claim"]), of)

        return one

    return T.let(F.transform(context, S.citation_features), lambda f: F.transform(T.citations(completion), against(f)))


def cited_by_model(completion: Column, similarity) -> Column:
    """As cited(), similarity(claims) giving array<array<double>>: each claim's scores of all chunks."""
    def of(found: Column) -> Column:
        scores = similarity(F.transform(found, lambda c: c["claim"]))

        def best(c: Column, row: Column) -> Column:
            top = F.array_max(F.transform(row, lambda s, i: F.struct(s.alias("score"), (-i).alias("back"))))
            return T.let(top, lambda t: F.struct(c.alias("citation"), F.coalesce(t["score"], F.lit(0.0)).alias("score"), (-t["back"]).alias("chunk_index")))

        return F.zip_with(found, scores, best)

    return of(T.citations(completion))


def citation_scores(requests: DataFrame, completion: str = "completion_text", context: str = "retrieved_context") -> DataFrame:
    """A row for each citation: citation_index, citation, score and chunk_index."""
    rows = requests.where(F.col(completion).isNotNull()).select("*", F.posexplode(cited(F.col(completion), F.col(context))).alias("citation_index", "_c"))
    return rows.select(*requests.columns, "citation_index", "_c.citation", "_c.score", "_c.chunk_index")


def citation_summary(found: Column, fail: Column, average: Column) -> Column:
    """struct<score, passed, n> of cited(): the first citation below fail decides, else the mean; null score and passed without citations."""
    def of(scores: Column) -> Column:
        first = F.try_element_at(F.filter(scores, lambda s: s < fail), F.lit(1))
        mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s) / F.size(scores)
        none = F.size(scores) == 0
        return F.struct(
            F.when(~none, F.coalesce(first, mean)).alias("score"), (none | (first.isNull() & (mean >= average))).alias("passed"), F.size(scores).alias("n"),
        )

    return T.let(F.transform(found, lambda c: c["score"]), of)


def citation_guard(found: Column, action: Column) -> Column:
    """From a column of citation_summary."""
    bad = ~found["passed"]
    return result(
        "citation_grounding_guard", "POST", ~bad, found["score"], F.when(bad, F.upper(action)).otherwise("ALLOW"),
        F.when(bad, "LOW_GROUNDING_HALLUCINATION"), F.when(bad, F.concat(F.lit("Citation similarity "), F.round(found["score"], 3).cast("string"))),
    )
