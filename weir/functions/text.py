"""Text columns. Patterns run with Unicode classes, so that word characters and boundaries agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from weir.functions import patterns as P

WORDS = r"[\p{L}\p{N}_]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def once(value: Column) -> Column:
    """value as it is; the planner, which may not move what isn't deterministic, computes it where it stands, not in filters above."""
    return F.when(F.spark_partition_id() >= 0, value)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(f"(?iU){pattern}"), F.lit(False))


def rule_hits(text: Column, rules: list[tuple[str, float, str]]) -> Column:
    """array<struct<score, reason>> of the rules that the text matches."""
    hit = [F.when(matches(text, p), F.struct(F.lit(float(s)).alias("score"), F.lit(r).alias("reason"))) for p, s, r in rules]
    return F.filter(F.array(*hit), lambda h: h.isNotNull())


def max_score(hits: Column) -> Column:
    """The highest score, 0.0 without a hit."""
    return F.coalesce(F.array_max(F.transform(hits, lambda h: h["score"])), F.lit(0.0))


def reasons(hits: Column) -> Column:
    """Distinct reasons in order, as an array."""
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["reason"])))


def tokens(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0)))


def word_list(text: Column) -> Column:
    """Lower-case words, punctuation as spaces, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def content_words(text: Column, stop: list[str] = P.STOPWORDS, least: int = 3) -> Column:
    """Distinct words of `least` characters or more that are no stop words."""
    kept = F.array_except(tokens(text), F.array(*map(F.lit, stop)))
    return F.filter(kept, lambda w: F.length(w) >= least)


def bigrams(text: Column) -> Column:
    """Distinct pairs of adjacent characters, lower case; none below two characters."""
    def pairs(c: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(c[i - 1], c[i])))

    low = F.lower(text)
    return F.when(F.length(low) < 2, F.array().cast("array<string>")).otherwise(let(F.split(low, ""), pairs))


def word_count(text: Column) -> Column:
    """Words between white space; 0 for none."""
    cut = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.coalesce(cut, F.lit("")) == "", 0).otherwise(F.size(F.split(cut, " ")))


def claims(text: Column) -> Column:
    """Sentences and lines of three words or more, list marks removed; the whole text if there is none."""
    plain = F.regexp_replace(text, r"(?m)^\s*[-*#]+\s*", "")
    cut = F.transform(F.split(plain, r"(?<=[.!?])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    kept = F.filter(cut, lambda s: word_count(s) >= 3)
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(F.coalesce(whole, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.when(F.size(kept) > 0, kept).otherwise(F.array(whole))
    )


def negated(text: Column, ascii_edges: bool = False) -> Column:
    """Whether a word of negation is in the text. ascii_edges: letters beyond ASCII end a word, as in RE2, so "noítaga" has "no"."""
    if not ascii_edges:
        return matches(text, P.NEGATION)
    words = P.NEGATION.removeprefix(r"\b").removesuffix(r"\b").replace("s", "[sſ]")  # all that RE2 takes for the letters without regard to case
    return F.coalesce(text.rlike(rf"(?<![A-Za-z0-9_])(?i:{words})(?![A-Za-z0-9_])"), F.lit(False))


def has_citations(text: Column) -> Column:
    """Whether any citation marker is in the text."""
    return F.coalesce(text.rlike("|".join(f"(?i:{p[4:]})" if p.startswith("(?i)") else f"(?:{p})" for _, p in P.CITATIONS)), F.lit(False))


def is_multi_reference(citation: Column) -> Column:
    """Whether a citation names several sources, as [1, 2]."""
    return (citation["kind"] == "numeric") & citation["value"].contains(",")


def _preceding(before: Column) -> Column:
    """The last sentence of three words or more, or all that stands before; its last 300 characters."""
    sentences = F.transform(F.split(before, r"(?U)(?<=[.!?])\s+"), strip)
    return F.right(F.coalesce(F.try_element_at(F.filter(sentences, lambda s: word_count(s) >= 3), F.lit(-1)), before), F.lit(300))


CITATION = "array<struct<position:int,marker:string,kind:string,value:string,claim:string>>"


def citations(text: Column) -> Column:
    """The citation markers of a text in order of position; a marker within 3 characters of one of a pattern before it gives way.

    The text between matches of a pattern gives their places, as for personal data. Markers with nothing before them are left out.
    """
    found = []
    for kind, pattern in P.CITATIONS:
        java = f"(?U){pattern}"
        markers, values = (F.regexp_extract_all(text, F.lit(java), F.lit(k)) for k in (0, 1))

        def place(gaps: Column, markers: Column = markers, values: Column = values, kind: str = kind) -> Column:
            def one(marker: Column, i: Column) -> Column:
                at = F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(markers, F.lit(1), i), ""))
                before = strip(F.substring(text, F.lit(1), at))
                return F.struct(
                    at.alias("position"), marker.alias("marker"), F.lit(kind).alias("kind"), strip(values[i]).alias("value"),
                    F.when(before != "", _preceding(before)).alias("claim"),
                )

            return F.transform(markers, one)

        found.append(F.when(F.size(markers) > 0, let(F.split(text, java, -1), place)).otherwise(F.array().cast(CITATION)))

    def keep(kept: Column, c: Column) -> Column:
        taken = c["claim"].isNull() | F.exists(kept, lambda k: F.abs(k["position"] - c["position"]) < 3)
        return F.when(taken, kept).otherwise(F.concat(kept, F.array(c)))

    return F.array_sort(F.aggregate(F.flatten(F.array(*found)), F.array().cast(CITATION), keep))


def swap_identities(text: Column) -> Column:
    """The text with identity terms replaced one after another; null if that changes nothing."""
    out = text
    for a, b in P.SWAPS:
        out = F.regexp_replace(out, rf"(?iU)\b{a}\b", b)
    return F.when(out != text, out)


def reasoning_text(given: Column, response: Column, completion: Column) -> Column:
    """The caller's reasoning, else the response's, else what stands between thinking tags; null for none."""
    inline = F.trim(F.array_join(F.transform(F.regexp_extract_all(completion, F.lit(P.THINKING), F.lit(1)), F.trim), " "))
    return F.coalesce(*[F.when(F.trim(c) != "", F.trim(c)) for c in (given, response, inline)])


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def judge_json(text: Column) -> Column:
    """A judge's reply as a variant; backticks and the letters of "json" around it removed."""
    return F.try_parse_json(F.btrim(text, F.lit("`json\n ")))
