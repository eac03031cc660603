"""Copies that differ only in formatting, by digests of nested records built from the leaves up.

A leaf is normalised to its letters and digits, case aside. Fields of an object stand in no order, so
their digests are sorted before the object's own is taken; the items of a list keep theirs. A text that
is a set of fields (a JSON object, or lines or parts with distinct keys and a value each) has a root digest
of that kind; every text also has one as a single leaf. Records with a root digest in common are copies,
and so are copies of copies; each is then compared in full with the first record of its digest.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, checked_broadcast, once, shared_dir, ship

_OTHER = re.compile(r"[\W_]+")
_LINE = re.compile(r"\s*([^:=\n]+?)\s*[:=]\s*(\S.*?)\s*$")
_PART = re.compile(r"\s*([^:=;\n]+?)\s*=\s*(\S[^=]*?)\s*$", re.S)


def leaf(s: str) -> str:
    """Letters and digits of a text in their order, case aside."""
    if not s.isascii():
        s = unicodedata.normalize("NFC", s)
    return _OTHER.sub("", s.casefold())


class _Fields(list):
    """Fields of a JSON object as they stand, keys repeated or not."""


def fields(text: str) -> list[tuple[str, object]] | None:
    """The fields of a text that is a set of fields, else None."""
    t = text.strip()
    if t.startswith("{") and t.endswith("}"):
        try:
            found = json.loads(t, object_pairs_hook=_Fields, parse_int=str, parse_float=str, parse_constant=str, strict=False)
        except (ValueError, RecursionError):
            return None
        return list(found)
    lines = [x for x in t.splitlines() if x.strip()]
    if len(lines) == 1 and ";" in t:
        got = [_PART.match(x) for x in t.split(";") if x.strip()]
    else:
        got = [_LINE.match(x) for x in lines]
    if len(got) < 2 or not all(got):
        return None
    return [(m[1], m[2]) for m in got]  # type: ignore[index]


def canonical(node: object) -> str | None:
    """The full normal form of a node; None where an object has keys twice, or none, or a field without value."""
    if isinstance(node, _Fields):
        parts = []
        for k, v in node:
            value = canonical(v)
            if value is None:
                return None
            parts.append(f"{leaf(k)}\x01{value}")
        if not parts or len({p.partition("\x01")[0] for p in parts}) < len(parts):
            return None
        return "\x02" + "\x03".join(sorted(parts)) + "\x04"
    if isinstance(node, list):
        items = [canonical(v) for v in node]
        return None if None in items else "\x05" + "\x03".join(items) + "\x06"  # type: ignore[arg-type]
    return leaf(node if isinstance(node, str) else json.dumps(node))


def _hash(kind: bytes, data: bytes) -> bytes:
    return blake2b(data, digest_size=16, person=kind).digest()


def root_digest(node: object) -> bytes | None:
    """The digest of a node from its children's; None as in ``canonical``."""
    if isinstance(node, _Fields):
        children, keys = [], set()
        for k, v in node:
            below, name = root_digest(v), leaf(k)
            if below is None or name in keys:
                return None
            keys.add(name)
            children.append(_hash(b"field", name.encode("utf-8", "surrogatepass") + b"\0" + below))
        return _hash(b"object", b"".join(sorted(children))) if children else None
    if isinstance(node, list):
        items = [root_digest(v) for v in node]
        return None if None in items else _hash(b"list", b"".join(items))  # type: ignore[arg-type]
    return _hash(b"leaf", leaf(node if isinstance(node, str) else json.dumps(node)).encode("utf-8", "surrogatepass"))


def _set_of_fields(text: str) -> _Fields | None:
    found = fields(text)
    if found is None or not all(leaf(v) if isinstance(v, str) else True for _, v in found):
        return None
    return _Fields(found)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        as_leaf, as_fields = [], []
        for t in b.column(2).to_pylist():
            as_leaf.append(root_digest(t).hex())  # type: ignore[union-attr]
            node = _set_of_fields(t)
            d = None if node is None else root_digest(node)
            as_fields.append(None if d is None else d.hex())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(as_leaf, pa.string()), pa.array(as_fields, pa.string())], ["table_name", "id", "l", "f"])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = b.column(4).to_pylist()
        plain = [leaf(t) for t in texts]
        nodes = [_set_of_fields(t) for t in texts]
        ordered = [None if n is None else canonical(n) for n in nodes]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(plain, pa.string()), pa.array(ordered, pa.string())], ["table_name", "id", "l", "f", "plain", "ordered"])


def _components(pairs: DataFrame) -> DataFrame:
    """For each digest ``l`` of the pairs (table_name, l, f): the smallest ``f`` that is linked with it, over any number of steps."""
    state = pairs.withColumn("label", F.col("f")).checkpoint()
    while True:
        by_l = state.groupBy("table_name", "l").agg(F.min("label").alias("m"))
        step = state.join(by_l, ["table_name", "l"])
        by_f = step.groupBy("table_name", "f").agg(F.min("m").alias("m2"))
        new = step.join(by_f, ["table_name", "f"]).select("table_name", "l", "f", F.col("m2").alias("label"), (F.col("m2") != F.col("label")).alias("moved")).checkpoint()
        if not new.where("moved").limit(1).count():
            return new.groupBy("table_name", "l").agg(F.min("label").alias("key"))
        state = new.drop("moved")


#: Rows of a group with more than so many meet its first record in several tasks, one for each so many.
HOT = 100_000


def _with_first(rows: DataFrame, firsts: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join of rows with one row for each group, ``firsts``, of which ``__n`` tells how large the group is.

    Only the rows of hot groups are spread, and only the firsts of these are copied. There are at most as many hot groups
    as ``HOT`` goes into the number of rows.
    """
    salts = F.ceil(F.col("__n") / HOT).cast("int")
    hot, _ = checked_broadcast(firsts.where(F.col("__n") > HOT).select(*on, salts.alias("__salts")))
    left = rows.join(hot, on, "left").withColumn("__s", F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("__salts")).cast("int"))).drop("__salts")
    right = firsts.withColumn("__s", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__n")
    return left.join(right, [*on, "__s"], how).drop("__s")


def copies(records: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """All copies: ``table_name``, ``kept_id``, ``copy_id``, ``kept_id`` being the smallest id of the copies.

    ``records`` has table_name, id and content; copies are found within a table. Rows repeated under one id
    count once (the smallest content stands for them). Rows with null content or null id are no records;
    contents without any letter or digit are copies of each other. Further columns are ignored. An empty
    table gives no rows.

    A row carries two digests through the shuffles, never its text; only rows with a digest in common are
    read again for the comparison. Groups are aggregated before they are shuffled, and rows of a hot group
    meet its first record in several tasks.
    """
    spark = records.sparkSession
    shared_dir(spark)
    ship(spark)
    records = once(records.where("id IS NOT NULL AND content IS NOT NULL"), ["table_name", "id"], "content", broadcast_bytes)
    nodes = records.mapInArrow(_digests, "table_name string, id string, l string, f string").checkpoint()
    # only digests that stand more than once are joined back; all other rows have their key already
    by_l = nodes.groupBy("table_name", "l").agg(F.min("f").alias("f0"), (F.min("f") != F.max("f")).alias("mixed"), F.count(F.lit(1)).alias("__n")).where("__n > 1").checkpoint()
    if by_l.where("mixed").limit(1).count():
        keys = _components(nodes.where("f IS NOT NULL").select("table_name", "l", "f").distinct())
        # every digest of fields takes part, as a mixed one may link several
        own = nodes.groupBy("table_name", "l").agg(F.count(F.lit(1)).alias("__n")).join(keys, ["table_name", "l"], "left").select("table_name", "l", F.coalesce("key", "l").alias("key"), "__n")
        keyed = _with_first(nodes, own, ["table_name", "l"])
    else:
        keyed = _with_first(nodes, by_l.select("table_name", "l", "f0", "__n"), ["table_name", "l"], "left").withColumn("key", F.coalesce("f0", "f", "l")).drop("f0")
    keyed = keyed.checkpoint()
    groups = keyed.groupBy("table_name", "key").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    members = _with_first(keyed, groups, ["table_name", "key"]).checkpoint()

    small, _ = checked_broadcast(members.select("table_name", "id", "l", "f"), broadcast_bytes)
    again = records.join(small, ["table_name", "id"]).select("table_name", "id", "l", "f", "content")
    forms = again.mapInArrow(_forms, "table_name string, id string, l string, f string, plain string, ordered string").checkpoint()
    first_l = forms.groupBy("table_name", "l").agg(F.min_by("plain", "id").alias("p0"), F.count(F.lit(1)).alias("__n"))
    first_f = forms.where("f IS NOT NULL").groupBy("table_name", "f").agg(F.min_by("ordered", "id").alias("o0"), F.count(F.lit(1)).alias("__n"))
    same_l = _with_first(forms, first_l, ["table_name", "l"]).where(F.col("plain") == F.col("p0")).select("table_name", "id")
    same_f = _with_first(forms.where("f IS NOT NULL"), first_f, ["table_name", "f"]).where(F.col("ordered") == F.col("o0")).select("table_name", "id")
    # a row that differs from the first record under every digest is no copy after all
    confirmed = same_l.union(same_f).distinct()
    return (
        members.where("id <> kept_id").join(confirmed, ["table_name", "id"], "left_semi").select("table_name", "kept_id", F.col("id").alias("copy_id"))
    )


def collapse(records: DataFrame) -> DataFrame:
    """One row for each record that is left: ``table_name``, ``kept_id``, ``n_copies`` (1 if it has no other)."""
    ids = records.where("id IS NOT NULL AND content IS NOT NULL").select("table_name", "id").distinct()
    found = copies(records).checkpoint()
    counted = found.groupBy("table_name", F.col("kept_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    kept = ids.join(found.select("table_name", F.col("copy_id").alias("id")), ["table_name", "id"], "left_anti")
    return kept.join(counted, ["table_name", "id"], "left").select("table_name", F.col("id").alias("kept_id"), (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
