"""Queries of the text operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import once, settled, shared_dir, spread, table
from . import bpe, merkle, mojibake, names, packing, pii, secrets, splitting


def _limit(spark: SparkSession, d: str, name: str) -> tuple[int, int]:
    """A row of the table of limits, which has a fixed number of rows."""
    r = table(spark, d, "token_limits").where(F.col("limit_name") == name).select("max_tokens", "overlap_tokens").first()
    return r.max_tokens, r.overlap_tokens


def _contents(spark: SparkSession, d: str, id_name: str = "id", python: bool = False) -> DataFrame:
    """Contents of sources and context_chunks under one name, as they stand; ``python``: for work in Python."""
    one = lambda t: table(spark, d, t).select(F.lit(t).alias("table_name"), F.col("id").alias(id_name), "content")
    return spread(one("sources").unionByName(one("context_chunks"))) if python else one("sources").unionByName(one("context_chunks"))


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, set[str]]:
    """All texts in which persons' data stands, and the given names of the tables of entities and nicknames."""
    shared_dir(spark)
    one = lambda t, c: table(spark, d, t).select(F.lit(t).alias("table_name"), F.col("id").alias("row_id"), F.col(c).alias("content"))
    texts = spread(one("sources", "content").unionByName(one("context_chunks", "content")).unionByName(one("chat_results", "answer")).where("row_id IS NOT NULL"))
    lexicon = names.lexicon_of(table(spark, d, "entities").where("name IS NOT NULL").groupBy("id").agg(F.min("name").alias("name")), table(spark, d, "nicknames"))
    return texts, lexicon.given | set(lexicon.full)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    texts, given = _texts(spark, d)
    texts = settled(texts, ["table_name", "row_id"], "content")
    return pii.find(texts, ["table_name", "row_id"], "content", given).select("table_name", "row_id", "kind").distinct()


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts, given = _texts(spark, d)
    return pii.find(once(texts, ["table_name", "row_id"], "content"), ["table_name", "row_id"], "content", given, placeholders=True)


def p2_unchanged(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text stands as it was where nothing was replaced, and else keeps all that is outside its placeholders."""
    texts, _ = _texts(spark, d)
    before = once(texts, ["table_name", "row_id"], "content")
    both = before.join(p2_redacted(spark, d), ["table_name", "row_id"], "left")
    parts = F.split("redacted", r"\[(?:EMAIL|PHONE|ID_NUMBER|ADDRESS|NAME)\]")
    # all parts between placeholders stand in the text, in their order
    at = F.aggregate(parts, F.lit(1), lambda i, p: F.when((i == 0) | (p == ""), i).otherwise(F.when(F.call_function("locate", p, F.col("content"), i) == 0, F.lit(0)).otherwise(F.call_function("locate", p, F.col("content"), i) + F.length(p))))
    ok = F.when(F.col("content").isNull(), F.col("redacted").isNull()).otherwise((F.col("redacted") == F.col("content")) | (at > 0))
    return both.select("table_name", "row_id", F.coalesce(ok, F.lit(False)).alias("kept"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    most, overlap = _limit(spark, d, "split_item")
    rows = _contents(spark, d, "item_id").where(splitting.exceeds(F.col("content"), most) & F.col("item_id").isNotNull())
    return splitting.split(once(rows, ["table_name", "item_id"], "content"), ["table_name", "item_id"], "content", most, overlap)


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each item, without their overlaps, make its text, and whether all fit the limit and begin with
    what the one before ends with."""
    most, overlap = _limit(spark, d, "split_item")
    texts = once(_contents(spark, d, "item_id").where(splitting.exceeds(F.col("content"), most) & F.col("item_id").isNotNull()), ["table_name", "item_id"], "content")
    # the pieces of an item are as long as its text
    piece = F.struct("chunk_index", F.col("content").alias("piece"), "overlap", "token_estimate")
    pieces = p3_pieces(spark, d).groupBy("table_name", "item_id").agg(F.array_sort(F.collect_list(piece)).alias("ps"))
    made = F.array_join(F.transform("ps", lambda p: F.substr(p["piece"], p["overlap"] + 1)), "")
    both = texts.join(pieces, ["table_name", "item_id"], "left")
    return both.select("table_name", "item_id", F.coalesce(made == F.col("content"), F.lit(False)).alias("restored"), F.coalesce(F.forall("ps", lambda p: p["token_estimate"] <= most), F.lit(False)).alias("fits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    most, overlap = _limit(spark, d, "split_item")
    pieces = splitting.split(_contents(spark, d, "item_id").where("item_id IS NOT NULL"), ["table_name", "item_id"], "content", most, overlap)
    return pieces.where("chunk_index = 0").select("table_name", "item_id").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    return names.links(table(spark, d, "entities"), table(spark, d, "nicknames"))


def p4_members(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    return names.resolve(table(spark, d, "entities"), table(spark, d, "nicknames"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    return secrets.scan(table(spark, d, "project_files"), table(spark, d, "sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    return secrets.scan(table(spark, d, "project_files"), table(spark, d, "sources"), redacted=False).select("source_id", "line_no").distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return merkle.copies(_contents(spark, d, python=True))


def p6_kept(spark: SparkSession, d: str) -> DataFrame:
    return merkle.collapse(_contents(spark, d, python=True))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_documents(spark, d), "doc_id", "text")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _limit(spark, d, "pack_document")
    shared_dir(spark)
    sizes = bpe.encode(_documents(spark, d), "doc_id", "text", counts_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens", capacity)


def p8_placed(spark: SparkSession, d: str) -> DataFrame:
    """Whether the pieces of each document make it up without gap, only those above the capacity are split, and none of
    its containers holds more than the capacity."""
    capacity, _ = _limit(spark, d, "pack_document")
    placed = p8_containers(spark, d).checkpoint()
    used = placed.where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"))
    rows = placed.join(used, "container", "left").withColumn("used", F.when(F.col("n_tokens") > 0, F.col("used")).otherwise(F.lit(0)))
    by = rows.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("k"), F.max(F.col("start") + F.col("n_tokens")).alias("end"), F.max("piece").alias("last"), F.max("used").alias("used"))
    sizes = bpe.encode(_documents(spark, d), "doc_id", "text", counts_only=True).groupBy("doc_id").agg(F.max("n_tokens").alias("size"))
    whole = (F.col("n") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("last") + 1 == F.col("k")) & (F.col("k") == F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)))
    return sizes.join(by, "doc_id", "left").select("doc_id", F.coalesce(whole, F.lit(False)).alias("whole"), F.coalesce(F.col("used") <= capacity, F.lit(False)).alias("fits"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    capacity, _ = _limit(spark, d, "pack_document")
    by = p8_containers(spark, d).where("n_tokens > 0").groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("n_items"))
    return by.agg(
        F.count(F.lit(1)).alias("n_containers"), F.ceil(F.sum("used") / capacity).alias("least_containers"), F.sum("used").alias("n_tokens"), F.sum("n_items").alias("n_items"), F.max("used").alias("fullest"), (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill")
    )


def p9_repaired(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    return mojibake.repair(_documents(spark, d), "doc_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    shared_dir(spark)
    return mojibake.find(_documents(spark, d), "doc_id", "text")


QUERIES = {
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p2_unchanged": p2_unchanged,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_members": p4_members,
    "p5_found": p5_found,
    "p5_values": p5_values,
    "p6_found": p6_found,
    "p6_kept": p6_kept,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_placed": p8_placed,
    "p9_found": p9_found,
    "p9_repaired": p9_repaired,
}

_OVER = r"""greatest(ceil(length(content) / 4.0), ceil(len(list_filter(regexp_split_to_array(content, '[ \t\n\x0B\f\r]+'), lambda w: w <> '')) * 1.35))
 > (SELECT max_tokens FROM token_limits WHERE limit_name = 'split_item')"""

ORACLE = {
    "p3_found": f"""
SELECT DISTINCT 'sources' AS table_name, id AS item_id FROM sources WHERE id IS NOT NULL AND {_OVER}
UNION SELECT DISTINCT 'context_chunks', id FROM context_chunks WHERE id IS NOT NULL AND {_OVER}""",
    "p3_restored": f"""
SELECT DISTINCT 'sources' AS table_name, id AS item_id, true AS restored, true AS fits FROM sources WHERE id IS NOT NULL AND {_OVER}
UNION SELECT DISTINCT 'context_chunks', id, true, true FROM context_chunks WHERE id IS NOT NULL AND {_OVER}""",
    "p8_placed": "SELECT DISTINCT doc_id, true AS whole, true AS fits FROM documents",
    "p2_unchanged": """
SELECT DISTINCT 'sources' AS table_name, id AS row_id, true AS kept FROM sources WHERE id IS NOT NULL
UNION SELECT DISTINCT 'context_chunks', id, true FROM context_chunks WHERE id IS NOT NULL
UNION SELECT DISTINCT 'chat_results', id, true FROM chat_results WHERE id IS NOT NULL""",
}
