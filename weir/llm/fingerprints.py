"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's weighted terms are its five-word shingles (lower-cased runs of letters and digits;
a text of one to four words is a single shingle) with their counts as weights. A term of weight w is w units, and each
unit, told apart by its number from 1 to w, is dealt by a hash to one of 2 ** SLOT_BITS slots, so that a slot holds its even share of the
text's whole weight, however it is spread over terms. Within a slot a term weighs as many units as it has there and gets the gamma-based sample
of consistent weighted sampling: r, c ~ Gamma(2, 1), beta ~ U(0, 1),
t = floor(ln w / r + beta), ln a = ln c - r (t - beta + 1); the slot keeps (term, t) of the
least a. Two texts agree in a slot with probability equal to the generalised Jaccard similarity of their weights there.

Why the share of agreeing slots, among those that either text fills, estimates the similarity of the whole: units 1 to min(w, v) of a term
are dealt alike in both texts, so the slots' minima and maxima add up to those of the whole. The union's units are dealt at
random, so a slot that got m of them has m J of the common ones in expectation, whatever m: each filled
slot agrees with probability J, the generalised Jaccard similarity.

Nulls: a null text counts as empty. Texts without words have an empty fingerprint and
likeness 1.0 to each other, 0.0 to others. Equal texts have equal fingerprints. Rows with
equal doc_id are ordered by text; null doc_id sorts last, by a hash of the text. An empty table gives an empty result.
A text of any length is one row's work, its memory in proportion to its words.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SLOT_BITS = 8
ID_BITS = 16
SHINGLE = 5
#: Bits of a sample's a in the key that slots are sorted by.
A_BITS = 63 - SLOT_BITS - ID_BITS


def _let(value: str, name: str, body: str) -> str:
    """SQL that binds value to name once in body; a lambda over a one-element array."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _unit(bits: str) -> str:
    return f"((({bits}) + 0.5D) / 4294967296D)"


#: c of a term x: Gamma(2, 1) as the negative logarithm of two uniforms, the halves of one hash.
_C = f"(-ln({_unit('shiftrightunsigned(xxhash64(x, 11L), 32)')} * {_unit('xxhash64(x, 11L) & 4294967295L')}))"
#: r (1 - beta) and r beta are independent unit exponentials, so two uniforms give both r and beta.
_U1 = _unit("shiftrightunsigned(x, 32)")
_U2 = _unit("shiftrightunsigned(xxhash64(x, 23L), 32)")


def _pack(a: str, identity: str) -> str:
    """A sortable long: slot of x, then the sample's a (below 64, as c is below 46 and u1 at most 1), then the identity of (term, t)."""
    return (
        f"(shiftleft(x & {2**SLOT_BITS - 1}L, {63 - SLOT_BITS}) | shiftleft(floor({a} * {2 ** (A_BITS - 6)}D), {ID_BITS}) "
        f"| ({identity} & {2**ID_BITS - 1}L))"
    )


def signature(name: str) -> Column:
    """array<int> for the string column called name: slot and sample identity of each filled slot, by slot."""
    words = f"array_remove(split(lower(`{name}`), '[^\\\\p{{L}}\\\\p{{N}}]+'), '')"
    grams = ", ".join(f"w[i + {k}]" for k in range(SHINGLE))
    shingles = _let(
        words,
        "w",
        f"case when size(w) = 0 then cast(array() as array<bigint>) "
        f"when size(w) < {SHINGLE} then array(xxhash64(array_join(w, ' '))) "
        f"else transform(sequence(0, size(w) - {SHINGLE}), i -> xxhash64({grams})) end",
    )
    # Units beyond a term's first: in sorted shingles o, occurrence k of a term goes to the slot that a hash of (term, k) names.
    start = "filter(sequence(0, size(more) - 1), i -> if(i = 0, true, more[i] <> more[i - 1]))"
    count = "if(j + 1 < size(st), st[j + 1], size(more)) - p"
    low = 2**SLOT_BITS - 1
    own = f"if(v = (x & {low}L), x, (xxhash64(x, v, 7L) & {-low - 1}L) | v)"  # the term's hash for that slot, its last bits the slot
    spread = _let(f"xxhash64(x, cast(k as bigint)) & {low}L", "v", own)
    units = _let(start, "st", f"flatten(transform(st, (p, j) -> {_let('more[p]', 'x', f'transform(sequence(2, 1 + {count}), k -> {spread})')}))")
    later = _let("sort_array(g)", "o", "filter(o, (v, i) -> if(i = 0, false, v = o[i - 1]))")
    beyond = _let(later, "more", f"concat(e, {units})")
    shingles = _let(shingles, "g", _let("array_distinct(g)", "e", f"if(size(e) = size(g), g, {beyond})"))
    # Weight 1: t = 0 and a = c u1. Any weight: t = floor(ln w / r + beta), a = c u1 exp(-r t).
    once = _pack(f"{_C} * {_U1}", f"shiftright(x, {SLOT_BITS})")
    e1, e2 = f"(-ln({_U1}))", f"(-ln({_U2}))"
    t = f"floor((ln(cast(n as double)) + {e2}) / ({e1} + {e2}))"
    ident = f"if(t = 0, shiftright(x, {SLOT_BITS}), xxhash64(x, t))"
    many = _let(t, "t", _pack(f"{_C} * {_U1} * exp(-({e1} + {e2}) * t)", ident))
    # Units of a term that share a slot: more holds all but the first of each, sorted; st where each starts in it.
    recur = _let(start, "st", f"transform(st, (p, j) -> {_let('more[p]', 'x', _let(f'1 + {count}', 'n', many))})")
    more = _let("sort_array(s)", "o", "filter(o, (v, i) -> if(i = 0, false, v = o[i - 1]))")
    weighted = _let(more, "more", f"concat(transform(array_except(d, more), x -> {once}), {recur})")
    samples = f"if(size(d) = size(s), transform(d, x -> {once}), {weighted})"
    slot = f"shiftright({{}}, {63 - SLOT_BITS})"
    first = f"filter(q, (v, i) -> if(i = 0, true, {slot.format('v')} <> {slot.format('q[i - 1]')}))"
    ints = f"transform({first}, v -> cast(shiftleft({slot.format('v')}, {ID_BITS}) | (v & {2**ID_BITS - 1}L) as int))"
    filled = _let("array_distinct(s)", "d", _let(f"sort_array({samples})", "q", ints))
    return F.expr(_let(shingles, "s", f"if(size(s) = 0, cast(array() as array<int>), {filled})"))


def likeness(a: str, b: str) -> Column:
    """Share of agreeing slots among those that either signature fills; 1.0 if neither fills any."""
    slots = F.size(
        F.array_union(
            F.transform(a, lambda v: F.shiftright(v, ID_BITS)), F.transform(b, lambda v: F.shiftright(v, ID_BITS))
        )
    )
    same = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(slots == 0, 1.0).otherwise(same / slots)


def as_hex(name: str) -> Column:
    return F.array_join(F.transform(name, lambda v: F.lpad(F.lower(F.hex(v)), (SLOT_BITS + ID_BITS) // 4, "0")), "")


def with_next(docs: DataFrame, order: str, carried: list[str], buckets: int) -> DataFrame:
    """Add next_<c> for each carried column: the value in the next row by descending order, the last row getting the first's.

    Rows are dealt into buckets between quantiles of the order column, which are values that
    occur; the row that opens a bucket is also sent to the bucket before it, so one shuffle
    and a window within each bucket suffice and no task sees all rows. Rows without a value follow, by descending
    hash of the first carried column, in buckets that are ranges of that hash.
    """
    key, text = F.col(order), F.col(carried[0])
    cut = docs.agg(
        F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10000).alias("cuts"),
        F.max(order).alias("top"),
    ).first()
    cuts = sorted({*(cut["cuts"] or []), *([] if cut["top"] is None else [cut["top"]])}, reverse=True)
    mark = F.xxhash64(text)
    none = docs.where(key.isNull()).select(mark.alias("h")).groupBy(F.floor(F.col("h").cast("double") / 2.0**64 * buckets)).agg(F.max("h").alias("h"))
    marks = sorted((r["h"] for r in none.collect()), reverse=True)

    def values(held: list[int]) -> Column:
        return F.array(*[F.lit(c).cast("bigint") for c in held]) if held else F.array().cast("array<bigint>")

    # Buckets 1 to len(cuts) are from cuts[b - 1], which opens them, down to just above cuts[b]; then those without a value.
    bounds, last = F.when(key.isNull(), values(marks)).otherwise(values(cuts)), len(cuts) + len(marks)
    at = F.coalesce(key.cast("bigint"), mark)
    bucket = F.when(key.isNull(), len(cuts)).otherwise(0) + F.size(F.filter(bounds, lambda c: c >= at))
    before = F.when(F.array_contains(bounds, at), F.when(bucket == 1, last).otherwise(bucket - 1))
    sent = docs.withColumn("_at", F.explode(F.array(F.struct(bucket.alias("b"), F.lit(0).alias("ghost")), F.struct(before.alias("b"), F.lit(1).alias("ghost")))))
    sent = sent.where("_at.b is not null").select("*", "_at.b", "_at.ghost").drop("_at")
    w = Window.partitionBy("b").orderBy("ghost", key.desc_nulls_last(), F.when(key.isNull(), mark).desc(), text)
    for c in carried:
        sent = sent.withColumn(f"next_{c}", F.lead(c).over(w))
    return sent.where("ghost = 0").drop("b", "ghost")


def fingerprints(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprint each text and its edited text (its last third replaced from the next document's start)."""
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("sig", signature("text"))
    pairs = with_next(own, "doc_id", ["text", "sig"], buckets)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(
        F.col("text").substr(F.lit(1), F.length("text") - third), F.col("next_text").substr(F.lit(1), third)
    )
    pairs = pairs.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "sig", "next_sig", edited.alias("edited"))
    pairs = pairs.withColumn("edited_sig", signature("edited"))
    return pairs.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_hex("sig").alias("fingerprint"),
        as_hex("edited_sig").alias("edited_fingerprint"),
        likeness("sig", "edited_sig").alias("near_edited"),
        likeness("sig", "next_sig").alias("near_next"),
    )
