"""PII sanitisation with information-theoretic disclosure.

Addresses, numbers and the like are found by patterns; they are the protected
entities. The corpus then says which terms reveal them. With p(e) the share of
documents that hold entity e, and p(e|t) the share of those with term t that
hold e near t, the term tells log2(p(e|t) / p(e)) bits of the -log2 p(e) bits
that the entity has. Where it tells more than a share ``disclosure`` of them, in
at least ``support`` different texts, all places of the term in documents with
that entity are spans too, to be generalised to a label or removed. So any word
that is in few other documents tells of what it stands beside, be it a name or not.

Everything is built-in expressions and joins; no text leaves the JVM. Patterns
are written with possessive quantifiers, so that long runs neither recurse nor
backtrack, and match the same strings as their plain forms.

Defined results: a null text is empty; rows are documents, so copies count in
p(e) and p(e|t) but not in the support; an entity's places in a text count once,
with the terms near any of them, words that reach beyond the context left out;
spans of terms that touch a base span are none; very long texts are scanned
whole; further columns are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import written

#: Fixed values of the query's contract: kinds in order.
KINDS = ["email", "ip", "card", "phone"]
TERM = len(KINDS)
LABELS = [*KINDS, "term"]

#: (pattern, a substring or pattern that any match has)
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD_BREAK = r"[^\p{L}\p{N}]+"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    """The check of a kind beyond its pattern."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def spans_of(text: Column, pattern: Column, kind: int, ok) -> Column:
    """The matches of a pattern that are ``ok``, with their places in code points (end exclusive).

    What lies between the matches and the matches themselves, in turn, give all
    places by a running sum.
    """
    parts = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)), lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("m"), F.length(m).alias("size"), F.when(m.isNotNull(), ok(m)).alias("ok")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["size"], F.lit(0))
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["m"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["ok"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step, lambda acc: acc["spans"])


def base_spans(text: Column) -> Column:
    """All base spans by kind, then start."""
    none = F.array().cast(SPAN)
    there = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    return F.concat(*[F.when(there[k], spans_of(text, F.lit(PATTERNS[k]), n, lambda m, k=k: valid(k, m))).otherwise(none) for n, k in enumerate(KINDS)])


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, LABELS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def found_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, spans, text, key) of every row, written; text and its key only where there are spans."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("text")).withColumn("spans", base_spans(F.col("text")))
    some = F.size("spans") > 0
    return written(rows.select("doc_id", "spans", F.when(some, F.col("text")).alias("text"), F.when(some, F.md5(F.col("text").cast("binary"))).alias("key")), "pii_found")


def terms_in(text: Column) -> Column:
    """The distinct terms of a text: lower-case words of three characters or more that aren't numbers."""
    return F.filter(F.array_distinct(F.split(F.lower(text), WORD_BREAK)), lambda w: (F.length(w) >= 3) & ~w.rlike("^[0-9]+$"))


def entity_of(span: Column) -> Column:
    """The entity that a span names: its kind and its text in lower case."""
    return F.concat_ws(":", span["kind"].cast("string"), F.lower(span["value"]))


def words_near(context: int) -> Column:
    """What stands within ``context`` characters before and after span ``s`` of ``text``; words that reach further are left out."""
    before = F.expr(f"substring(text, greatest(s.start - {context + 1}, 0) + 1, least(s.start, {context + 1}))")
    after = F.expr(f"substring(text, s.end + 1, {context + 1})")
    # one character more was taken: if it is a word's, that word is cut
    before = F.when(F.length(before) > context, F.regexp_replace(before, r"^[\p{L}\p{N}]+", "")).otherwise(before)
    after = F.when(F.length(after) > context, F.regexp_replace(after, r"[\p{L}\p{N}]+$", "")).otherwise(after)
    return F.concat_ws(" ", before, after)


def telling_terms(documents: DataFrame, found: DataFrame, context: int, support: int, disclosure: float, broadcast_rows: int) -> DataFrame:
    """(entity, term): the terms that tell at least a share ``disclosure`` of an entity's information."""
    n = documents.count()
    held = found.where("key is not null").select("doc_id", "key", "text", F.explode("spans").alias("s"))
    # one row for each entity, text and term, of all places of the entity: copies are one text, and count as documents
    held = held.select("key", entity_of(F.col("s")).alias("entity"), F.explode_outer(terms_in(words_near(context))).alias("term"))
    each = written(held.distinct(), "pii_contexts")
    rows = found.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"))
    count = [F.sum("n_rows"), F.count(F.lit(1)).alias("texts")]
    entities = each.select("entity", "key").distinct().join(rows, "key").groupBy("entity").agg(count[0].alias("n_e"), count[1]).where(F.col("texts") >= support)
    pairs = each.where("term is not null").join(rows, "key").groupBy("entity", "term").agg(count[0].alias("n_te"), count[1])
    pairs = written(pairs.where(F.col("texts") >= support).join(entities.select("entity", "n_e"), "entity"), "pii_pairs")
    candidates = pairs.select("term").distinct()
    small = candidates.limit(broadcast_rows + 1).count() <= broadcast_rows
    side = F.broadcast(candidates) if small else candidates
    words = documents.select(F.explode(terms_in(F.coalesce("text", F.lit("")))).alias("term"))
    totals = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(side, "term")
    bits = F.log2(F.least(F.col("n_te") / F.col("n_t"), F.lit(1.0)) * n / F.col("n_e"))
    return written(pairs.join(totals, "term").where((F.col("n_e") < n) & (bits >= disclosure * F.log2(n / F.col("n_e")))).select("entity", "term"), "pii_telling")


def term_spans(found: DataFrame, telling: DataFrame, broadcast_rows: int, salts: int = 16) -> DataFrame:
    """(key, term_spans) of the texts in which terms tell of an entity that they hold.

    A text meets terms by its own words and not by its entities, of which one may
    have very many texts and terms. A term tells of few entities: each of them
    stands beside a share of its occurrences, (n_e / n) ** (1 - disclosure) or more.
    """
    one = found.where("key is not null").groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans"))
    own = one.select("key", F.explode(terms_in(F.col("text"))).alias("term"))
    if telling.limit(broadcast_rows + 1).count() <= broadcast_rows:
        told = own.join(F.broadcast(telling), "term")
    else:
        # a term that very many texts hold is dealt to as many tasks as there are salts
        salted = telling.select("*", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        told = own.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")).join(salted, ["term", "salt"])
    held = one.select("key", F.explode(F.array_distinct(F.transform("spans", entity_of))).alias("entity"))
    met = told.join(held, ["key", "entity"], "left_semi")
    terms = written(met.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms")), "pii_terms")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("terms", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    hit = one.join(terms, "key").select("key", "spans", spans_of(F.col("text"), pattern, TERM, lambda m: F.lit(True)).alias("more"))
    apart = F.filter("more", lambda x: ~F.exists("spans", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return written(hit.select("key", apart.alias("term_spans")), "pii_term_spans")


def all_spans(documents: DataFrame, context: int = 100, support: int = 3, disclosure: float = 0.8, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_id, spans, term_spans, text) of every row of ``documents`` (doc_id, text); text only where there are spans."""
    plain = documents.select("doc_id", "text")
    found = found_spans(plain)
    more = term_spans(found, telling_terms(plain, found, context, support, disclosure, broadcast_rows), broadcast_rows)
    none = F.array().cast(SPAN)
    without = found.where("key is null").select("doc_id", "spans", none.alias("term_spans"), "text")
    held = found.where("key is not null").join(more, "key", "left")
    return without.unionByName(held.select("doc_id", "spans", F.coalesce("term_spans", none).alias("term_spans"), "text"))


def sanitised(spans: DataFrame, remove_terms: bool = False) -> DataFrame:
    """(doc_id, text) of the rows of ``all_spans`` that have spans: each span is replaced by its kind in brackets, terms by nothing if asked.

    Where spans of different kinds overlap, the one that begins first, or else is longer, is replaced, and the rest of the other is left out.
    """
    labels = F.array(*[F.lit("" if remove_terms and k == "term" else f"[{k.upper()}]") for k in LABELS])
    every = F.array_sort(F.transform(F.concat("spans", "term_spans"), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["end"]
        gap = F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        label = F.when(s["start"] >= acc["at"], F.get(labels, s["kind"])).otherwise("")
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.concat(acc["out"], gap, label).alias("out"))

    text = F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return spans.where("text is not null").select("doc_id", text.alias("text"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256, spans and n_term of every document."""
    rows = all_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return rows.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("spans", "term_spans")).alias("spans"),
        F.size("term_spans").cast("bigint").alias("n_term"),
    )
