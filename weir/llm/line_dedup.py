"""Line dedup by site-relative frequency, in DataFrame functions only.

A page's lines are its text split at newlines. For each host, a line's frequency is the
number of the host's pages that contain it divided by the host's pages; lines above `ratio`
and on at least `min_pages` pages are boilerplate there and are dropped from its pages.
Blank lines never count as boilerplate.

Passages are lines of over `min_words` words on at least `min_pages` pages of the whole corpus, whatever their hosts.
They are for pages of which copies have gone already; a copied page's lines would all count as passages.

Nulls: a null host is a host of its own; a null text has no lines and stays null. A line that
recurs within one page counts once for it. Repeated rows count as pages of their own. An
empty table gives an empty result. A page of any length is handled whole, within its row. All other columns pass
through, whatever their names, but for n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weir.llm.shared import materialize

RATIO, MIN_PAGES, PASSAGE_WORDS = 0.05, 3, 50
#: A per-host list of at most this many bytes in all is broadcast; more are joined by host with hot hosts dealt over SALTS.
BROADCAST_BYTES, SALTS = 8 << 20, 64


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def _lines(text) -> Column:
    return F.split(F.col(text), "\n", -1)


def _free(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def boilerplate(pages: DataFrame, text: str, host: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, keys): each host's boilerplate line keys. At most (lines a page) / ratio for a host."""
    named = pages.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    total = named.groupBy("host").agg(F.count("*").alias("pages"))
    seen = (
        named.select("host", F.explode(F.array_distinct(_lines("text"))).alias("line"))
        .where(F.trim("line") != "")
        .select("host", _key(F.col("line")).alias("key"))
        .groupBy("host", "key")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= min_pages)
    )
    often = seen.join(total, seen["host"].eqNullSafe(total["host"])).where(F.col("n") > ratio * F.col("pages"))
    return often.select(seen["host"], "key").groupBy("host").agg(F.collect_list("key").alias("keys"))


def drop_boilerplate(
    pages: DataFrame, text: str = "text", host: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, length: str | None = None
) -> DataFrame:
    """pages with text cleaned, and the columns n_lines and n_dropped, which replace any of these names.

    With length, the columns stay as they are, but the one of that name has the length of each text that lost lines.
    """
    found = materialize(boilerplate(pages, text, host, ratio, min_pages), "boilerplate")
    small = (found.select(F.sum(16 * F.size("keys") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    pages = pages if length else pages.drop("n_lines", "n_dropped")
    of, keys, salt = _free(pages, "host_of_keys", "line_keys", "salt")
    found = found.select(F.col("host").alias(of), F.col("keys").alias(keys))
    own = pages[f"`{host}`"].eqNullSafe(found[of])
    if small:
        joined = pages.join(F.broadcast(found), own, "left")
    else:
        salted = found.withColumn(salt, F.explode(F.array(*map(F.lit, range(SALTS)))))
        joined = pages.join(salted, own & (F.pmod(F.xxhash64(pages[f"`{text}`"]), F.lit(SALTS)) == F.col(salt)), "left").drop(salt)
    lines = _lines(f"`{text}`")
    kept = F.filter(lines, lambda v: ~F.array_contains(keys, _key(v)))
    n = F.coalesce(F.when(F.col(f"`{text}`").isNotNull(), F.size(lines)), F.lit(0))
    left = F.when(F.col(keys).isNull() | F.col(f"`{text}`").isNull(), n).otherwise(F.size(kept))
    cut = F.when(F.col(keys).isNull(), F.col(f"`{text}`")).otherwise(F.array_join(kept, "\n"))
    if length:
        return joined.withColumns({length: _length(F.col(f"`{length}`"), n > left, cut), text: cut}).drop(of, keys)
    return joined.withColumns({"n_lines": n.cast("bigint"), "n_dropped": (n - left).cast("bigint"), text: cut}).drop(of, keys)


def _length(old: Column, changed: Column, text: Column) -> Column:
    return F.when(changed, F.length(text).cast("bigint")).otherwise(old)


def drop_passages(
    pages: DataFrame, text: str = "text", min_words: int = PASSAGE_WORDS, min_pages: int = MIN_PAGES, length: str | None = None
) -> DataFrame:
    """pages with text without passages, and the column n_dropped, which replaces any of that name; length as in drop_boilerplate."""
    pages = pages if length else pages.drop("n_dropped")
    page, keys = _free(pages, "page_key", "line_keys")
    own = F.col(f"`{text}`")
    long = F.filter(F.array_distinct(_lines("text")), lambda v: F.size(F.split(F.trim(v), r"\s+")) > min_words)
    lines = pages.select(_key(own).alias("page"), own.alias("text")).select("page", F.explode(F.transform(long, _key)).alias("key"))
    lines = materialize(lines, "long_lines")
    often = materialize(lines.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages).select("key"), "passages")
    found = lines.join(often, "key").groupBy("page").agg(F.collect_set("key").alias("keys"))
    found = materialize(found.select(F.col("page").alias(page), F.col("keys").alias(keys)), "passage_pages")
    joined = pages.withColumn(page, _key(own)).join(found, page, "left")
    kept = F.filter(_lines(f"`{text}`"), lambda v: ~F.array_contains(keys, _key(v)))
    n = F.when(F.col(keys).isNull(), 0).otherwise(F.size(_lines(f"`{text}`")) - F.size(kept)).cast("bigint")
    cut = F.when(F.col(keys).isNull(), own).otherwise(F.array_join(kept, "\n"))
    made = {length: _length(F.col(f"`{length}`"), n > 0, cut)} if length else {"n_dropped": n}
    return joined.withColumns(made | {text: cut}).drop(page, keys)
