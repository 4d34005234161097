"""Context assembly: hits are packed into a token budget, ordered, cited and rendered.

The packing is greedy and depends on what was taken before, so it is a fold
over a query's hits. Their number is bounded by the top-k before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.ids import text_hash
from lodestone.functions.tokens import estimate_tokens


def item_text(key: Column, source: Column, text: Column) -> Column:
    head = F.concat(F.lit("["), key, F.lit("]"), F.when(source.isNotNull(), F.concat(F.lit(" source: "), source)).otherwise(""))
    return F.concat(head, F.lit("\n"), text)


def packed(hits: DataFrame, budget: int = 4000, preamble: str = "", deduplicate: bool = True, compatibility: bool = True, measure: Callable[[Column], Column] = estimate_tokens) -> DataFrame:
    """(query_id, id, score, source, text, ...) with dropped: null, duplicate or token_budget; detail; and cost.

    By score, then id: an item that does not fit is passed over, not the end; a
    text equals those taken, not those passed over. ``measure``: tokens of a text, see ``tokens.measured``.
    """
    if budget <= 0:
        raise ValueError("the budget must be positive")
    cost = measure(item_text(F.lit("0"), F.col("source"), F.col("text")))
    rows = hits.withColumns({"cost": cost, "_hash": text_hash(F.col("text"), compatibility)})
    names = [c for c in rows.columns if c != "query_id"]
    rows = rows.withColumn("_preamble", measure(F.lit(preamble)))

    def by_score(x: Column, y: Column) -> Column:
        return F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["id"] < y["id"], -1).when(x["id"] > y["id"], 1).otherwise(0)

    start = F.struct(
        F.col("_preamble").alias("used"),
        F.array().cast("array<string>").alias("seen"),
        F.array().cast("array<struct<dropped:string,left:int>>").alias("out"),
    )

    def take(acc: Column, x: Column) -> Column:
        again = F.lit(deduplicate) & F.array_contains(acc["seen"], x["_hash"])
        why = F.when(again, "duplicate").when(acc["used"] + x["cost"] > budget, "token_budget")
        row = F.struct(why.alias("dropped"), (F.lit(budget) - acc["used"]).alias("left"))
        return F.struct(
            F.when(why.isNull(), acc["used"] + x["cost"]).otherwise(acc["used"]).alias("used"),
            F.when(why.isNull(), F.concat(acc["seen"], F.array(x["_hash"]))).otherwise(acc["seen"]).alias("seen"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        )

    # the whole hit goes through the fold, so a repeated id is met once for each hit
    sorted_hits = rows.groupBy("query_id").agg(F.first("_preamble").alias("_preamble"), F.array_sort(F.collect_list(F.struct(*names)), by_score).alias("items"))
    fates = sorted_hits.withColumn("fates", F.aggregate("items", start, take, lambda acc: acc["out"]))
    both = F.zip_with("items", "fates", lambda x, f: F.struct(*[x[n].alias(n) for n in names], f["dropped"].alias("dropped"), f["left"].alias("left")))
    out = fates.select("query_id", F.inline(both))
    detail = F.when(F.col("dropped") == "duplicate", "the same text is in already").when(F.col("dropped") == "token_budget", F.concat(F.col("cost").cast("string"), F.lit(" tokens, "), F.col("left").cast("string"), F.lit(" left")))
    return out.withColumn("detail", detail).select(*hits.columns, "cost", "dropped", "detail")


ORDERINGS = ("relevance", "document_order", "relevance_with_edges")


def all_orders(items: DataFrame, names: tuple[str, ...] = ORDERINGS) -> DataFrame:
    """Items (query_id, id, score, document_id, index) with their position in the prompt, from 0, by each ordering, in columns of their names.

    The items are dealt by query_id once, for all orderings.
    """
    own = Window.partitionBy("query_id")
    by_score = F.row_number().over(own.orderBy(F.desc("score"), "id")) - 1
    rows = items.withColumns({"_place": by_score, "_n": F.count(F.lit(1)).over(own)})
    # the strongest first, the next last, and so on inwards
    edge = F.when(F.col("_place") % 2 == 0, F.col("_place") / 2).otherwise(F.col("_n") - 1 - (F.col("_place") - 1) / 2)
    places = {"relevance": F.col("_place"), "document_order": F.row_number().over(own.orderBy("document_id", "index", "id")) - 1, "relevance_with_edges": edge.cast("int")}
    return rows.withColumns({n: places[n] for n in names}).drop("_place", "_n")


def ordered(items: DataFrame, ordering: str = "relevance") -> DataFrame:
    """Items with their position in the prompt, from 0."""
    if ordering not in ORDERINGS:
        raise ValueError(f"unknown ordering {ordering!r}")
    return all_orders(items, (ordering,)).withColumnRenamed(ordering, "position")


def cited(items: DataFrame, style: str = "numeric") -> DataFrame:
    """Items with citation_key: the position from 1, or source#index."""
    key = (F.col("position") + 1).cast("string") if style == "numeric" else F.concat_ws("#", F.coalesce("source", F.col("document_id").cast("string")), F.col("index").cast("string"))
    return items.withColumn("citation_key", key)


def rendered(items: DataFrame, queries: DataFrame, preamble: str = "") -> DataFrame:
    """(query_id, context) for every query; one without items says so."""
    text = item_text(F.col("citation_key"), F.col("source"), F.col("text"))
    bodies = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", text.alias("item")))).alias("items"))
    rows = queries.select("query_id").join(bodies, "query_id", "left")
    body = F.array_join(F.transform("items", lambda x: x["item"]), "\n\n")
    nothing = F.lit(f"{preamble}\n\n(no passages were retrieved)" if preamble else "")
    inner = F.when(F.col("items").isNull(), nothing).otherwise(F.concat(F.lit(f"{preamble}\n\n" if preamble else ""), body))
    return rows.select("query_id", F.concat(F.lit("<retrieved_context>\n"), inner, F.lit("\n</retrieved_context>")).alias("context"))


def citations(items: DataFrame) -> DataFrame:
    return items.select("query_id", "citation_key", F.col("id").alias("chunk_id"), "document_id", "source")
