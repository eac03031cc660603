"""Splitting oversized items at natural boundaries, with overlap, in SQL expressions alone.

One regular expression cuts an item into cores. Its alternatives stand in order of boundary strength
(end of the item, blank line, line end, sentence end, white space, any character), each with a bounded
quantifier that consumes as much as the limit allows; below a third of the limit the next weaker boundary
is tried instead. A core with more words than its share is cut again by words, with the same order of
boundaries. Each piece but the first starts a few characters before its core: the offset that a lookback
expression finds in the text before it, at the start of a word where there is one.

Tokens of a text: the larger of characters / 4 and words * 1.35, each rounded up, a word being a run
without ASCII white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^ \t\n\x0B\f\r]+"


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD))


def token_estimate(c: Column) -> Column:
    """Tokens of a text; null for null, 0 for the empty text."""
    return F.greatest(F.ceil(F.length(c) / 4), F.ceil(n_words(c) * F.lit(1.35))).cast("int")


def limits(tokens: int) -> tuple[int, int]:
    """The most characters and the most words that a text of so many tokens can have."""
    return 4 * tokens, tokens * 20 // 27


def exceeds(c: Column, max_tokens: int) -> Column:
    """Whether a text has more tokens; words are counted only where characters don't decide."""
    chars, words = limits(max_tokens)
    return (F.length(c) > chars) | ((F.length(c) > 2 * words) & (n_words(c) > words))


#: Boundaries from strong to weak, as lookbehinds.
BOUNDARIES = [r"(?<=\n\n|\n\r\n|\r\r)", r"(?<=\n|\r(?!\n))", r"(?<=[.!?;][\"')\]]?\s|[。！？；])", r"(?<=\s)"]


def by_characters(most: int) -> str:
    least = max(1, most // 3)
    strong = [f".{{{least},{most}}}{b}" for b in BOUNDARIES[:-1]]
    return "(?s)" + "|".join([rf".{{1,{most}}}\z", *strong, f".{{1,{most}}}{BOUNDARIES[-1]}", f".{{1,{most}}}"])


def by_words(most: int) -> str:
    least = max(1, most // 3)
    word = r"(?:\S++\s*+)"
    strong = [rf"\s*+{word}{{{least},{most}}}{b}" for b in BOUNDARIES[:-1]]
    return "(?s)" + "|".join([rf"\s*+{word}{{1,{most}}}\z", *strong, rf"\s*+{word}{{1,{most}}}", r"\s+"])


def split(items: DataFrame, key: list[str], text: str, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """Pieces of the items above the limit: ``key``, ``chunk_index``, ``start``, ``overlap``, ``content``, ``token_estimate``.

    Every piece has at most ``max_tokens`` tokens. Its first ``overlap`` characters are the last ones of
    the piece before it: as many whole words as ``overlap_tokens`` tokens hold, or part of a word longer
    than that. What follows the overlap are the cores, which together are the item, unchanged. ``start``
    is the offset of the piece in the item, in characters. An overlap of one token holds no word, so it is none.

    Row by row, without a shuffle: rows repeated in the input are repeated in the result. Items within the
    limit, empty and null ones give no rows. Needs ``overlap_tokens < max_tokens``. Further columns are
    dropped, whatever their names.
    """
    if not 0 <= overlap_tokens < max_tokens or max_tokens < 2:
        raise ValueError("the limit must be 2 at least, as a word has two tokens, and the overlap smaller")
    chars, words = limits(max_tokens)
    back_chars, back_words = limits(overlap_tokens)
    core_chars, core_words = max(1, chars - back_chars), max(1, words - back_words)

    again = lambda core: F.when(
        (F.length(core) > 2 * core_words) & (n_words(core) > core_words), F.regexp_extract_all(core, F.lit(by_words(core_words)), F.lit(0))
    ).otherwise(F.array(core))
    cores = F.flatten(F.transform(F.regexp_extract_all(F.col("__t"), F.lit(by_characters(core_chars)), F.lit(0)), again))
    rows = items.where(exceeds(F.col(text), max_tokens)).select(*key, F.col(text).alias("__t")).withColumn("__cores", cores)
    # element_at of an empty array is an error under ANSI rules, so the sums begin with a zero
    ends = F.aggregate(F.col("__cores"), F.array(F.lit(0)), lambda a, c: F.array_append(a, F.element_at(a, -1) + F.length(c)))
    rows = rows.withColumn("__at", ends).select(*key, "__t", F.posexplode(F.arrays_zip(F.col("__cores").alias("c"), F.slice("__at", 1, F.size("__cores")).alias("s"))).alias("chunk_index", "__p"))

    start, core = F.col("__p.s"), F.col("__p.c")
    if back_words:
        # one character more than the overlap may have shows whether the first word in it is whole
        window = F.substring(F.col("__t"), F.greatest(start - back_chars, F.lit(1)), F.least(start, F.lit(back_chars + 1)))
        whole = F.regexp_extract(window, rf"(?s)(?<=\s)(?:\S++\s*+){{1,{back_words}}}\z", 0)
        from_start = F.regexp_extract(window, rf"(?s)\A\s*+(?:\S++\s*+){{1,{back_words}}}\z", 0)
        overlap = F.when(start == 0, 0).when((start <= back_chars) & (from_start != ""), F.length(from_start)).when(whole != "", F.length(whole)).otherwise(F.least(start, F.lit(back_chars)))
    else:
        overlap = F.lit(0)
    rows = rows.select(*key, "chunk_index", "__t", start.alias("__s"), F.length(core).alias("__n"), overlap.cast("int").alias("overlap"))
    content = F.substring(F.col("__t"), F.col("__s") - F.col("overlap") + 1, F.col("__n") + F.col("overlap"))
    rows = rows.select(*key, "chunk_index", (F.col("__s") - F.col("overlap")).alias("start"), "overlap", content.alias("content"))
    return rows.withColumn("token_estimate", token_estimate(F.col("content")))
