"""Similarity of sets, texts and vectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from weir.functions import patterns as P, text as T


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)).cast("double")


def dice(a: Column, b: Column) -> Column:
    n = F.size(a) + F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * common(a, b) / n)


def recall(a: Column, b: Column) -> Column:
    """Share of a that is in b; 0.0 if a is empty."""
    return F.when(F.size(a) == 0, 0.0).otherwise(common(b, a) / F.size(a))  # array_intersect hashes its second array, mostly the shorter here


def jaccard(a: Column, b: Column) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common(a, b) / n)


def citation_features(text: Column) -> Column:
    return F.struct(T.bigrams(text).alias("bigrams"), T.content_words(text).alias("words"))


def citation_match(claim: Column, chunk: Column) -> Column:
    """0.6 of the bigram Dice coefficient and 0.4 of the claim's content words found in the chunk, of their citation_features."""
    return 0.6 * dice(claim["bigrams"], chunk["bigrams"]) + 0.4 * recall(claim["words"], chunk["words"])


def citation_score(claim: Column, chunk: Column) -> Column:
    return T.let(F.struct(citation_features(claim).alias("a"), citation_features(chunk).alias("b")), lambda x: citation_match(x["a"], x["b"]))


def reasoning_score(a: Column, b: Column) -> Column:
    """Half the bigram Dice coefficient and half the Jaccard similarity of content words."""
    def features(text: Column) -> Column:
        return F.struct(T.bigrams(text).alias("bigrams"), T.content_words(text, P.REASONING_STOPWORDS).alias("words"))

    def score(x: Column) -> Column:
        return 0.5 * dice(x["a"]["bigrams"], x["b"]["bigrams"]) + 0.5 * jaccard(x["a"]["words"], x["b"]["words"])

    return T.let(F.struct(features(a).alias("a"), features(b).alias("b")), score)


def nli_of(n_words: Column, overlap: Column, mismatch: Column) -> Column:
    """struct<entailment, contradiction, neutral> from a claim's number of words, their share in the context, and unmatched negation."""
    against = F.when(mismatch & (overlap < 0.4), 0.35).otherwise(0.0)
    entails = F.greatest(F.lit(0.0), F.least(F.lit(1.0), overlap * 1.25) - against)
    empty = n_words == 0
    e, c = F.when(empty, 0.5).otherwise(entails), F.when(empty, 0.0).otherwise(against)
    n = F.when(empty, 0.5).otherwise(F.greatest(F.lit(0.0), 1.0 - entails - against))
    return F.struct(e.alias("entailment"), c.alias("contradiction"), n.alias("neutral"))


def lexical_nli(context: Column, claim: Column) -> Column:
    def compared(words: Column) -> Column:
        return nli_of(F.size(words), recall(words, T.tokens(context)), T.negated(claim) != T.negated(context))

    return T.let(T.tokens(claim), compared)


def grounding(nli: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), nli["entailment"] - nli["contradiction"]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    return T.let(F.greatest(norm(v), F.lit(1e-12)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-12))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(v: Column) -> Column:
    def scaled(shifted: Column) -> Column:
        total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
        return T.let(total, lambda t: F.transform(shifted, lambda x: x / t))

    return T.let(T.let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m))), scaled)


def token_entropy(top: Column) -> Column:
    """Entropy of alternatives' log-probabilities, clipped to [-20, 0] and made to sum to one."""
    def entropy(p: Column) -> Column:
        def of(total: Column) -> Column:
            return F.aggregate(p, F.lit(0.0), lambda s, x: s - x / total * F.log(x / total + 1e-12))

        return T.let(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) + 1e-12, of)

    return F.coalesce(T.let(F.transform(top, lambda x: F.exp(F.greatest(F.lit(-20.0), F.least(F.lit(0.0), x)))), entropy), F.lit(0.0))
