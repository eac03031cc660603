"""Text measures of retrieval, as expressions that stay in the JVM."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and weights of scoring; fixed values.
STOP = ["the", "and", "for", "with", "that", "this", "from", "what", "how", "why", "was", "were", "are", "you", "your", "into", "each", "like"]
RECALL_STOP = ["what", "the", "this", "that", "with", "from", "your", "does", "user"]
SIGNATURE_STOP = ["seed", "memory", "records", "production", "behavior", "detail", "signal", "scope", "coverage"]
WEIGHTS = {w: 2.0 for w in ("architecture", "pgvector", "postgresql", "supabase", "runtime", "planner")} | {
    w: 1.6 for w in ("memory", "memories", "source", "sources", "graph", "relationship", "relationships", "events")
}


def token_estimate(c: Column) -> Column:
    """The larger of characters / 4 and words * 1.35, each rounded up, 1 at least; 0 for null and blank texts."""
    words = F.size(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "))
    n = F.greatest(F.lit(1), F.ceil(F.length(c) / 4).cast("int"), F.ceil(words * F.lit(1.35)).cast("int"))
    return F.when(c.isNull() | (F.trim(F.regexp_replace(c, r"\s+", " ")) == ""), F.lit(0)).otherwise(n)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def terms(c: Column, stop: list[str] = STOP) -> Column:
    """Different terms of a text: lower-case runs of letters and digits, of three characters and more, without stop words."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+")
    return F.array_distinct(F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(stop)))


def query_terms(query: str | None, stop: list[str] = STOP) -> list[str]:
    return list(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", (query or "").lower()) if len(t) > 2 and t not in stop))


def lexical_score(query: str, c: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """The share of the query's term weight that stands in a text, 0 to 1."""
    qs = query_terms(query)
    if not qs:
        return F.lit(0.0)
    own, total = terms(c), float(sum(weights.get(q, 1.0) for q in qs))
    hit = sum((F.when(F.array_contains(own, q), F.lit(weights.get(q, 1.0))).otherwise(F.lit(0.0)) for q in qs), F.lit(0.0))
    return F.least(F.lit(1.0), hit / F.lit(total))


def lexical_boost(query: str | None, c: Column) -> Column:
    """1 plus the share of the query's terms in a text."""
    qs = query_terms(query, RECALL_STOP)
    if not qs:
        return F.lit(1.0)
    own = terms(c, RECALL_STOP)
    n = sum((F.array_contains(own, q).cast("int") for q in qs), F.lit(0))
    return F.lit(1.0) + F.least(F.lit(1.0), n / F.lit(float(len(qs))))


def fulltext_rank(query: str, c: Column) -> tuple[Column, Column]:
    """Whether a text has all terms of a query, and a rank: term frequency by the logarithm of length.

    An approximation of database full-text search: no stemming, no cover density.
    """
    qs = query_terms(query)
    words = F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda t: F.length(t) > 2)
    own = terms(c)
    match = F.lit(bool(qs))
    for q in qs:
        match = match & F.array_contains(own, q)
    tf = F.size(F.filter(words, lambda t: t.isin(qs) if qs else F.lit(False)))
    return match, tf / (F.lit(1.0) + F.log(F.lit(1.0) + F.size(words)))


def signature(c: Column) -> Column:
    """The first ten terms in order, without numbers and words that say little: near-duplicates share it."""
    kept = F.filter(terms(c), lambda t: ~t.rlike(r"^\d+$") & ~t.isin(SIGNATURE_STOP))
    return F.array_join(F.slice(F.array_sort(kept), 1, 10), " ")


def repetition_ratio(c: Column) -> Column:
    """The share of sentences (of 40 characters and more, numbers aside) that stand more than once; 0 below three."""
    sentences = F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?<=[.!?])\s+")
    plain = F.transform(sentences, lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", ""), r"[^a-z0-9]+", " ")))
    kept = F.array_sort(F.filter(plain, lambda s: F.length(s) >= 40))
    # one pass over the sorted sentences: the one before, how often it stood so far, how many stand repeatedly
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("repeated"), F.lit(0).alias("n"))

    def step(acc: Column, s: Column) -> Column:
        again = s == acc["last"]
        run = F.when(again, acc["run"] + 1).otherwise(F.lit(1))
        more = F.when(again, F.when(acc["run"] == 1, F.lit(2)).otherwise(F.lit(1))).otherwise(F.lit(0))
        return F.struct(s.alias("last"), run.alias("run"), (acc["repeated"] + more).alias("repeated"), (acc["n"] + 1).alias("n"))

    ratio = F.aggregate(kept, start, step, lambda acc: F.when(acc["n"] < 3, F.lit(0.0)).otherwise(acc["repeated"] / acc["n"]))
    return F.when(F.size(sentences) < 3, F.lit(0.0)).otherwise(ratio)


# -- chunks and extracts: folds over arrays, in the JVM --------------------------------------------------------


def estimate(text: str | None) -> int:
    """``token_estimate`` of one text."""
    if not text or not text.strip():
        return 0
    return max(1, math.ceil(len(text) / 4), math.ceil(len(text.split()) * 1.35))


def _size(chars: Column, words: Column) -> Column:
    """Tokens of a text by its characters and words."""
    return F.greatest(F.lit(1), F.ceil(chars / 4).cast("int"), F.ceil(words * F.lit(1.35)).cast("int"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _measured(parts: Column) -> Column:
    """Texts that aren't blank, stripped, each with its characters and words: sums of these measure texts put together."""
    kept = F.filter(F.transform(parts, _strip), lambda p: p != "")
    return F.transform(kept, lambda p: F.struct(p.alias("text"), F.length(p).alias("chars"), F.size(F.split(p, r"\s+")).alias("words")))


def _gather(parts: Column, between: str, most: int) -> Column:
    """Measured parts put together to texts: a part that would bring the open text above ``most`` opens the next one."""
    gap = len(between)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("chars"), F.lit(0).alias("words"))

    def step(acc: Column, p: Column) -> Column:
        alone = acc["words"] == 0
        chars = F.when(alone, p["chars"]).otherwise(acc["chars"] + gap + p["chars"])
        words = acc["words"] + p["words"]
        over = ~alone & (_size(chars, words) > most)
        closed = F.when(over, F.array_append(acc["done"], acc["text"])).otherwise(acc["done"])
        text = F.when(over | alone, p["text"]).otherwise(F.concat(acc["text"], F.lit(between), p["text"]))
        return F.struct(closed.alias("done"), text.alias("text"), F.when(over, p["chars"]).otherwise(chars).alias("chars"), F.when(over, p["words"]).otherwise(words).alias("words"))

    return F.aggregate(parts, start, step, lambda acc: F.when(acc["words"] > 0, F.array_append(acc["done"], acc["text"])).otherwise(acc["done"]))


def chunk_array(content: Column, target: int = 450, most: int = 650) -> Column:
    """The chunks of a text, in order: paragraphs gathered until a chunk has ``target`` tokens.

    A paragraph that would bring the open chunk above ``most`` closes it, and is gathered line by line instead. Null,
    empty and blank texts have no chunks; a single line above ``most`` stays whole.
    """
    gap = len("\n\n")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("chars"), F.lit(0).alias("words"))

    def step(acc: Column, p: Column) -> Column:
        alone = acc["words"] == 0
        chars = F.when(alone, p["chars"]).otherwise(acc["chars"] + gap + p["chars"])
        words = acc["words"] + p["words"]
        tokens = _size(chars, words)
        text = F.when(alone, p["text"]).otherwise(F.concat(acc["text"], F.lit("\n\n"), p["text"]))
        by_line = ~alone & (tokens > most)
        open_ = ~by_line & (tokens < target)
        done = (
            F.when(by_line, F.concat(acc["done"], F.array(acc["text"]), _gather(_measured(F.split(p["text"], r"\R")), "\n", most)))
            .when(open_, acc["done"])
            .otherwise(F.array_append(acc["done"], text))
        )
        keep = lambda c, empty: F.when(open_, c).otherwise(F.lit(empty))
        return F.struct(done.alias("done"), keep(text, "").alias("text"), keep(chars, 0).alias("chars"), keep(words, 0).alias("words"))

    paragraphs = _measured(F.split(F.coalesce(content, F.lit("")), r"\R\s*\R"))
    return F.aggregate(paragraphs, start, step, lambda acc: F.when(acc["words"] > 0, F.array_append(acc["done"], acc["text"])).otherwise(acc["done"]))


def chunks(sources: DataFrame, key: str, content: str) -> DataFrame:
    """Chunks of each source: ``source_id``, ``chunk_index``, ``id``, ``content``, ``token_estimate``, ``content_hash``."""
    rows = sources.select(F.col(key).cast("string").alias("source_id"), F.posexplode(chunk_array(F.col(content))).alias("chunk_index", "content"))
    return rows.select(
        "source_id", "chunk_index", F.concat_ws("-chunk-", "source_id", "chunk_index").alias("id"), "content", token_estimate(F.col("content")).alias("token_estimate"), content_hash(F.col("content")).alias("content_hash")
    )


MARK = "\n[compressed extract]"


def compress(content: Column, most: Column, query: str | None) -> Column:
    """An extract of a text of about ``most`` tokens, with a mark at its end; a text within them is left as it is.

    The extract has the first line and the lines with a term of the query (all lines if it has no terms), up to the one
    that fills the budget; it is cut by 15 % at a time until it fits or has 80 characters. Blank texts give the empty one.
    """
    wanted = query_terms(query, [])
    lines = _measured(F.split(content, r"\R"))
    mine = (lambda p: F.arrays_overlap(terms(p["text"], []), F.array(*[F.lit(w) for w in wanted]))) if wanted else (lambda p: F.lit(True))
    kept = F.concat(F.slice(lines, 1, 1), F.filter(F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines))), mine))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("chars"), F.lit(0).alias("words"))

    def take(acc: Column, p: Column) -> Column:
        first = acc["words"] == 0
        enough = ~first & (_size(acc["chars"], acc["words"]) >= most)
        longer = F.struct(
            F.when(first, p["text"]).otherwise(F.concat(acc["text"], F.lit("\n"), p["text"])).alias("text"),
            F.when(first, p["chars"]).otherwise(acc["chars"] + 1 + p["chars"]).alias("chars"),
            (acc["words"] + p["words"]).alias("words"),
        )
        return F.when(enough, acc).otherwise(longer)

    text = F.aggregate(kept, start, take, lambda acc: acc["text"])

    def shrink(short: Column, _: Column) -> Column:
        return F.when((token_estimate(short) > most) & (F.length(short) > 80), F.substr(short, F.lit(1), F.floor(F.length(short) * 0.85).cast("int"))).otherwise(short)

    # 0.85^60 brings a text of a million characters below 80
    short = F.aggregate(F.sequence(F.lit(1), F.lit(60)), text, shrink)
    return F.when(content.isNull() | (_strip(content) == ""), F.lit("")).when(token_estimate(content) <= most, content).otherwise(F.concat(_strip(short), F.lit(MARK)))


def embed_text(text: str | None, dims: int = 64) -> list[float]:
    """A deterministic embedding by signed feature hashing, of length 1; zeros for a blank text."""
    v = np.zeros(dims)
    for t in re.findall(r"[a-z0-9]+", (text or "").lower()):
        h = int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "big")
        v[h % dims] += 1.0 if h >> 63 else -1.0
    n = float(np.linalg.norm(v))
    return (v / n).tolist() if n else v.tolist()


def embed(df: DataFrame, text: str, dims: int = 64, provider: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """``df`` with ``embedding``; equal texts are embedded once, null and blank ones as zeros.

    ``provider`` embeds a batch of texts and is sent to the workers; without one, texts are embedded by feature hashing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            made = provider(texts) if provider else [embed_text(t, dims) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float32()))], ["__text", "embedding"])

    once = df.select(F.col(text).alias("__text")).where(F.col("__text").rlike(r"\S")).distinct().mapInArrow(run, "__text string, embedding array<float>")
    zero = F.array(*[F.lit(0.0).cast("float")] * dims)
    return df.join(once, df[text] == once["__text"], "left").drop("__text").withColumn("embedding", F.coalesce("embedding", zero))
