"""Quality rules: a threshold table compiled into one projection.

A rule compares a measure with a share of another: ``100 * part`` must be at
least (or at most) ``percent * whole``. All measures, all rules and the verdict
are built-in expressions over the text of one row, so a scan, a projection and
nothing else is run: no shuffle and no user functions.

Defined results: a null text is empty; a text without words fails the first
rule; rows are judged one by one, so repeated rows get equal verdicts; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.shared import unused

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
CAPITALS = r"\p{Lu}+"
LETTERS = r"\p{L}+"

#: Frequent function words of four languages.
STOP_WORDS = (
    "the of and to a in is that it for was on with as by be this are at from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als "
    "de la le et les un du une que pour est dans qui par sur pas au avec "
    "el y los se las del por con no una su para al es lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``100 * part`` at least (``least``) or at most ``percent * whole``."""

    name: str
    part: str
    whole: str
    percent: int
    least: bool = False

    def fails(self) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole) * self.percent
        return part < whole if self.least else part > whole


#: The rules of the contract, which decide ``base_failed``.
BASE_RULES = [
    Rule("few_words", "n_words", "one", 5000, least=True),
    Rule("repeated_words", "n_repeat_words", "n_words", 50),
]

#: The table of the method: length, symbols, letters, stop words and lines.
RULES = [
    Rule("many_words", "n_words", "one", 100_000 * 100),
    Rule("short_words", "word_chars", "n_words", 250, least=True),
    Rule("long_words", "word_chars", "n_words", 1200),
    Rule("symbols", "n_symbols", "n_words", 10),
    Rule("capitals", "n_capitals", "n_letters", 40),
    Rule("letters", "n_letters", "word_chars", 50, least=True),
    Rule("stop_words", "n_stop_words", "n_words", 1, least=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
    Rule("dotted_lines", "n_dotted_lines", "n_lines", 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", 90),
]


def tail(array: Column) -> Column:
    return F.slice(array, F.lit(2), F.greatest(F.size(array) - 1, F.lit(0)))


def repeated_windows(df: DataFrame, grams: str, ordered: str, twice: str, places: str) -> DataFrame:
    """``df`` with ``places``: where the windows begin that are found more than once (null: there are none).

    ``grams`` has a hash for each window. Sorting the hashes brings equal ones
    together. The few that are found twice are then looked for; where they are
    many, the hashes are sorted with their places instead. Each step is a column
    of its own, so that nothing is computed twice.
    """
    g, few = F.col(grams), 64
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(g)))
    df = df.withColumn(twice, F.array_distinct(F.array_compact(F.zip_with(ordered, tail(F.col(ordered)), lambda a, b: F.when(a == b, a)))))
    placed = F.when(F.size(twice) > few, F.array_sort(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn(ordered, placed)
    pairs = F.zip_with(ordered, tail(F.col(ordered)), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    found = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.array_contains(F.col(twice), F.get(g, i)))
    return df.withColumn(places, F.when(F.size(twice) > few, F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))).when(F.size(twice) > 0, found))


def covered_words(places: Column) -> Column:
    """How many words windows of three at these ascending places cover: three each, less what the place before has covered."""
    steps = F.zip_with(places, tail(places), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda total, x: total + x), F.lit(0))


def measured(df: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``df`` with a column for each measure, and the columns' names by measure."""
    names = "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_letters n_stop_words n_dotted_lines n_bullet_lines one".split()
    helpers = ["t", "words", "lines", "grams", "ordered", "twice", "places"]
    at = dict(zip(names + helpers, unused(df, *names, *helpers), strict=True))
    c = {k: F.col(v) for k, v in at.items()}
    df = df.withColumn(at["t"], F.coalesce(F.col(text), F.lit("")))
    df = df.withColumns(
        {
            at["words"]: F.filter(F.split(c["t"], SPACE), lambda w: w != ""),
            at["lines"]: F.filter(F.split(c["t"], "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    df = df.withColumn(
        at["grams"],
        F.when(F.size(c["words"]) >= 3, F.transform(F.sequence(F.lit(0), F.size(c["words"]) - 3), lambda i: F.xxhash64(F.get(c["words"], i), F.get(c["words"], i + 1), F.get(c["words"], i + 2)))).otherwise(F.array().cast("array<bigint>")),
    )
    df = repeated_windows(df, at["grams"], at["ordered"], at["twice"], at["places"])
    long = lambda x: x.cast("bigint")
    df = df.withColumns(
        {
            at["n_words"]: long(F.size(c["words"])),
            at["word_chars"]: long(F.length(F.regexp_replace(c["t"], SPACE, ""))),
            at["n_symbols"]: long(F.length(c["t"]) - F.length(F.regexp_replace(c["t"], SYMBOLS, ""))),
            at["n_dup_lines"]: long(F.size(c["lines"]) - F.size(F.array_distinct(c["lines"]))),
            at["n_repeat_words"]: long(covered_words(c["places"])),
            at["n_lines"]: long(F.size(c["lines"])),
            at["n_capitals"]: long(F.length(c["t"]) - F.length(F.regexp_replace(c["t"], CAPITALS, ""))),
            at["n_letters"]: long(F.length(c["t"]) - F.length(F.regexp_replace(c["t"], LETTERS, ""))),
            at["n_stop_words"]: long(F.size(F.filter(c["words"], lambda w: w.isin(*STOP_WORDS)))),
            at["n_dotted_lines"]: long(F.size(F.filter(c["lines"], lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$")))),
            at["n_bullet_lines"]: long(F.size(F.filter(c["lines"], lambda x: x.rlike(r"^[\x20\x09-\x0D]*[•●*-][\x20\x09-\x0D]")))),
            at["one"]: F.lit(1).cast("bigint"),
        }
    )
    return df.drop(*(at[x] for x in helpers)), {k: at[k] for k in names}


def renamed(rules: list[Rule], at: dict[str, str]) -> list[Rule]:
    return [Rule(r.name, at[r.part], at[r.whole], r.percent, r.least) for r in rules]


def judge(df: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE_RULES) -> DataFrame:
    """``df`` with the measures, base_failed, kept and the names of the failed rules (failed_rules).

    New columns get underscores in front where ``df`` has their names.
    """
    out, at = measured(df)
    base_failed, kept, failed = unused(out, "base_failed", "kept", "failed_rules")
    named = lambda rs: F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in renamed(rs, at)]))
    any_base = F.lit(False)
    for r in renamed(base, at):
        any_base = any_base | r.fails()
    out = out.withColumns({base_failed: any_base, failed: named(base + rules)})
    return out.withColumn(kept, F.size(failed) == 0).drop(at["one"])


def keep_good(documents: DataFrame, rules: list[Rule] = RULES, base: list[Rule] = BASE_RULES) -> DataFrame:
    """The rows of ``documents`` that no rule rejects, with the same columns.

    A filter is pushed below deterministic projections by writing their
    expressions into it, which would compute each measure once for every use.
    The row number, which the filter refers to, keeps it above them.
    """
    judged = judge(documents, rules, base)
    kept = judged.columns[-1]
    (number,) = unused(judged, "number")
    numbered = judged.withColumn(number, F.monotonically_increasing_id())
    return numbered.where(F.col(kept) & (F.col(number) >= 0)).select(*documents.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdicts of every document."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules")
    )


def sql_of(rules: list[Rule]) -> str:
    return ", ".join(f"CASE WHEN 100 * {r.part} {'<' if r.least else '>'} {r.percent} * {r.whole} THEN '{r.name}' END" for r in rules)


OP4_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS n_capitals,
    length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')) AS n_letters,
    len(list_filter(words, lambda x: x IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS n_stop_words,
    len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|\x{{2026}})[\x20\x09-\x0D]*$'))) AS n_dotted_lines,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[\x{{2022}}\x{{25cf}}*-][\x20\x09-\x0D]'))) AS n_bullet_lines,
    1 AS one
  FROM w LEFT JOIN rep USING (doc_id)
), v AS (
  SELECT *, concat_ws(',', {sql_of(BASE_RULES)}) AS base_names, concat_ws(',', {sql_of(BASE_RULES + RULES)}) AS failed_rules FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_names <> '' AS base_failed, failed_rules = '' AS kept, failed_rules FROM v
"""
