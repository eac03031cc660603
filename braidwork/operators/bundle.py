"""Context bundles: planning by mode, packing into a token budget, formatting for a model."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import compress, token_estimate
from .retrieval import clamp

# Model profiles: window in tokens, format, price of a token; fixed values.
PROFILES = {
    "small-context-model": (8000, "markdown", 0.000001),
    "medium-context-model": (32000, "xml", 0.000002),
    "large-context-model": (128000, "xml", 0.000003),
    "local-model": (16000, "markdown", 0.0),
    "custom-model": (64000, "json", 0.0),
}
NOTICE = "Use this context only when relevant. Do not invent missing facts."


def profile(name: str | None) -> tuple[int, str, float]:
    return PROFILES.get((name or "").lower(), PROFILES["medium-context-model"])


def mode_multiplier(kind: Column, source_type: Column, source_name: Column, mode: str | None) -> Column:
    """How a mode weighs a result: logs, configuration, code, memories and so on."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    t, st, sn = low(kind), low(source_type), low(source_name)
    log = st.contains("log") | sn.contains("log")
    conf = st.contains("config") | sn.endswith(".yml") | sn.endswith(".yaml") | sn.endswith(".properties") | sn.endswith(".env")
    m = (mode or "general").strip().lower() or "general"
    one = F.lit(1.0)
    if m == "debugging":
        return F.when(log, 1.45).when(conf, 1.30).when(t == "event", 1.20).otherwise(one)
    if m == "coding":
        return F.when(st == "code", 1.35).when(conf, 1.15).when(log, 0.72).otherwise(one)
    if m == "planning":
        return F.when(t.isin("memory", "relationship", "event"), 1.18).when(log, 0.55).otherwise(one)
    if m == "research":
        return F.when(st.isin("document", "note") | (t == "entity"), 1.18).when(log, 0.65).otherwise(one)
    return F.when(log, 0.45 if m in ("summary", "general") else 0.55).otherwise(one)


def plan_mode(df: DataFrame, mode: str | None) -> DataFrame:
    """Results with scores and reasons as a mode weighs them."""
    m = mode_multiplier(F.col("type"), F.col("source_type"), F.col("source_name"), mode)
    name = (mode or "general").strip().lower() or "general"
    why = F.when(F.abs(m - 1.0) < 0.001, F.col("reason")).otherwise(F.concat("reason", F.lit("; "), F.when(m > 1, F.lit("boosted")).otherwise(F.lit("lowered")), F.lit(f" for {name} mode")))
    return df.withColumns({"final_score": clamp(F.col("final_score") * m), "reason": why})


#: Results below this score are left out; long ones below the other are shortened.
LEAST, SHORTEN_BELOW, LONG = 0.10, 0.45, 180


def pack(df: DataFrame, budget: int, query: str, query_id: str | None = None, candidates: int = 500) -> DataFrame:
    """The results (id, type, content, token_estimate, final_score, perhaps reason) of each query that fit its budget of
    tokens, 256 at least: with ``content``, ``token_estimate`` and ``decision`` as packed, and ``position``.

    The best result of each type comes first, then the others by score. Each takes what room is left: whole, or as an
    extract if it overflows or is long and weak. Retrieval hands on at most ``candidates`` results a query, the best.
    Repeated ids are results of their own. Null contents are empty. Without rows, nothing is packed.
    """
    qid, reason = query_id or "__q", ["reason"] if "reason" in df.columns else []
    rows = df if query_id else df.withColumn("__q", F.lit(0))
    rows = rows.where(F.col("final_score") >= LEAST)
    if query_id:
        rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("final_score"), "id"))
        rows = rows.withColumn("__rank", rank).where(F.col("__rank") <= candidates)
    else:
        rows = rows.orderBy(F.desc("final_score"), "id").limit(candidates)
    lead = F.row_number().over(Window.partitionBy(qid, "type").orderBy(F.desc("final_score"), "id"))
    known = F.when(F.col("token_estimate") > 0, F.col("token_estimate")).otherwise(token_estimate(F.col("content")))
    item = F.struct((F.col("__lead") > 1).alias("later"), (-F.col("final_score")).alias("weak"), "id", "type", F.coalesce("content", F.lit("")).alias("content"), F.coalesce(known, F.lit(0)).cast("int").alias("n"), *reason)
    listed = rows.withColumn("__lead", lead).groupBy(qid).agg(F.array_sort(F.collect_list(item)).alias("items"))
    room = max(256, budget)
    extra = ", reason string" if reason else ""
    empty = F.array().cast(f"array<struct<id:{dict(df.dtypes)['id']}, type:string, content:string, token_estimate:int, final_score:double, decision:string{extra.replace('reason ', 'reason:')}>>")

    def add(acc: Column, r: Column) -> Column:
        left = F.lit(room) - acc["used"]
        whole = (r["n"] <= left) & ~((r["weak"] > -SHORTEN_BELOW) & (r["n"] > LONG))
        short = compress(r["content"], F.least(F.greatest(F.lit(80), left), F.greatest(F.lit(120), F.floor(r["n"] / 2).cast("int"))), query)
        packed = F.when(whole, F.struct(r["content"].alias("content"), r["n"].alias("n"), F.lit("FULL").alias("how"))).otherwise(
            F.struct(short.alias("content"), token_estimate(short).alias("n"), F.lit("COMPRESSED_SUMMARY").alias("how"))
        )
        more = [r["reason"].alias("reason")] if reason else []
        out = F.struct(r["id"].alias("id"), r["type"].alias("type"), packed["content"].alias("content"), packed["n"].alias("token_estimate"), (-r["weak"]).alias("final_score"), packed["how"].alias("decision"), *more)
        return F.when((left > 0) & (packed["n"] <= left), F.struct((acc["used"] + packed["n"]).alias("used"), F.array_append(acc["out"], out).alias("out"))).otherwise(acc)

    filled = F.aggregate("items", F.struct(F.lit(0).alias("used"), empty.alias("out")), add, lambda acc: acc["out"])
    shown = F.array_sort(filled, lambda x, y: F.when(x["final_score"] > y["final_score"], -1).when(x["final_score"] < y["final_score"], 1).otherwise(0))
    out = listed.select(qid, F.posexplode(shown).alias("p", "r")).select(qid, "r.*", (F.col("p") + 1).alias("position"))
    return out if query_id else out.drop("__q")


def item_type(kind: Column, decision: Column) -> Column:
    full = F.when(kind == "SOURCE_CHUNK", "FULL_CHUNK").when(kind.isin("MEMORY", "ENTITY", "RELATIONSHIP", "EVENT"), F.concat(F.lit("FULL_"), kind)).otherwise("FULL_CONTEXT")
    return F.when(decision == "FULL", full).otherwise("COMPRESSED_SUMMARY")


def staleness(fresh: Column) -> Column:
    return F.when(fresh >= 0.35, F.lit("VALID")).otherwise(F.lit("STALE"))


def format_rows(rows: list[dict], query: str, mode: str, style: str) -> str:
    """A bundle as text: sections, tagged items or one JSON object."""
    score = lambda r: f"{r['final_score']:.3f}"
    if style == "json":
        items = [{"type": r["type"], "score": float(score(r)), "reason": r.get("reason", ""), "content": r["content"]} for r in rows]
        return json.dumps({"query": query, "mode": mode, "items": items, "instructions": NOTICE}, indent=2, ensure_ascii=False)
    if style == "xml":
        esc = lambda t: (t or "").replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        body = "".join(f'    <item type="{esc(r["type"])}" score="{score(r)}">\n      <reason>{esc(r.get("reason"))}</reason>\n      <content>{esc(r["content"])}</content>\n    </item>\n' for r in rows)
        return f"<context_bundle>\n  <query>{esc(query)}</query>\n  <mode>{esc(mode)}</mode>\n  <items>\n{body}  </items>\n  <instructions>{NOTICE}</instructions>\n</context_bundle>"
    out = f"# Context Bundle\n\nQuery: {query}\nMode: {mode}\n\n{NOTICE}\n\n"
    named = {"Memories": lambda t: t == "MEMORY", "Sources": lambda t: t == "SOURCE_CHUNK", "Other Context": lambda t: t not in ("MEMORY", "SOURCE_CHUNK")}
    for title, mine in named.items():
        items = [f"- Score: {score(r)}; Reason: {r.get('reason', '')}\n{r['content']}\n\n" for r in rows if mine(r["type"])]
        out += f"## {title}\n" + ("".join(items) or "No selected items.\n\n")
    return out


def build(df: DataFrame, query: str, mode: str | None, budget: int, model: str | None = None) -> DataFrame:
    """One row: the formatted bundle of the packed results, its tokens and its cost. A bundle fits a model's window, so it is bounded."""
    window, style, price = profile(model)
    rows = pack(plan_mode(df, mode), min(max(256, budget), window), query)
    m = (mode or "general").strip().lower() or "general"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf.sort_values("position").to_dict("records")
        n = int(sum(r["token_estimate"] for r in items))
        return pd.DataFrame({"bundle": [format_rows(items, query, m, style)], "n_items": [len(items)], "tokens": [n], "cost": [n * price]})

    return rows.withColumn("__b", F.lit(1)).groupBy("__b").applyInPandas(run, "bundle string, n_items int, tokens int, cost double")


def explain_items(items: DataFrame) -> DataFrame:
    return items.orderBy(F.desc("final_score"), "created_at")
