"""Guards: row-wise checks of texts, as Columns that give action, reason and replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.ids import WHITE_SPACE

ACTIONS = ("allow", "flag", "redact", "block", "retry")
REFUSAL = "I can't answer that."
#: Phrasings common in published injection attempts.
INJECTION_PATTERNS = (
    r"\bignore\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier)\s+(instructions|prompts?|rules)",
    r"\bdisregard\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier|system)\b",
    r"\bforget\s+(everything|all)\s+(you|that)\b",
    r"\byou\s+are\s+now\s+(a|an|the|in)\b",
    r"\b(reveal|print|show|repeat|output)\s+(your|the)\s+(system\s+)?(prompt|instructions)",
    r"\bact\s+as\s+(if\s+you\s+are\s+)?(an?\s+)?(unrestricted|jailbroken|developer\s+mode)",
    r"<\s*/?\s*(system|assistant)\s*>",
    r"\bBEGIN\s+(SYSTEM|ADMIN)\s+(PROMPT|INSTRUCTIONS)\b",
)
#: Fixed value: shapes of well-known credentials.
CREDENTIAL = r"(sk-[A-Za-z0-9_-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{30,}|xox[bp]-[A-Za-z0-9-]{10,})"
#: Words that don't ground a claim.
STOP_WORDS = "a an and are as at be by can do does for from has have how i in is it its of on or our that the their there this to was were what when where which who will with you".split()
#: Where sentences end, and how passages are cited.
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
CITATION = r"\[([^\[\]\n]{1,40})\]"
CITATIONS_ALONE = r"^(\[[^\[\]\n]{1,40}\]\s*[.!?]?\s*)+$"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, f"^{WHITE_SPACE}+|{WHITE_SPACE}+$", "")


def result(guard: str, failed: Column, action: str, reason: str | Column, evidence: Column | None = None, replacement: Column | None = None) -> Column:
    if action not in ACTIONS:
        raise ValueError(f"unknown action {action!r}")
    text = lambda c: F.when(failed, c) if c is not None else F.lit(None).cast("string")
    return F.struct(
        F.lit(guard).alias("guard"),
        F.when(failed, F.lit(action)).otherwise("allow").alias("action"),
        F.when(failed, reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"),
        text(evidence).alias("evidence"),
        text(replacement if action == "redact" else None).alias("replacement"),
    )


def injection_matches(text: Column, patterns: tuple[str, ...] = INJECTION_PATTERNS) -> Column:
    """The indexes of the patterns that match."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in enumerate(patterns)]))


def injection(text: Column, action: str = "flag", patterns: tuple[str, ...] = INJECTION_PATTERNS) -> Column:
    redacted = text
    for p in patterns:
        redacted = F.regexp_replace(redacted, f"(?i){p}", "[removed]")
    evidence = F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in patterns])
    return result("injection", F.size(injection_matches(text, patterns)) > 0, action, "looks like an injected instruction", evidence, redacted)


def input_shape(text: Column, action: str = "block", least: int = 1, most: int = 4000) -> Column:
    bare = stripped(F.coalesce(text, F.lit("")))
    size = F.length(bare)
    return result("input_shape", ~size.between(least, most), action, F.when(size < least, "too_short").otherwise("too_long"), size.cast("string"), F.substring(bare, 1, most))


def has_secret(text: Column) -> Column:
    return text.rlike(CREDENTIAL)


#: Endings of key names that hold secrets.
SECRET_KEY = r"^\s*-?\s*([\w.-]*(?:api_key|apikey|secret|secret_key|password|passwd|token))\s*:\s*(.+?)\s*$"
SAFE_VALUE = r"""^(["']?)(\$\{env:[^}]+\}|null|~|""|''|)\1$"""


def literal_secret(line: Column) -> Column:
    """A configuration line that gives a secret's value itself, or holds a credential."""
    plain = F.split(line, "#", 2)[0]
    value = F.regexp_extract(plain, f"(?i){SECRET_KEY}", 2)
    return plain.rlike(f"(?i){SECRET_KEY}") & ~value.rlike(SAFE_VALUE) | has_secret(plain)


def is_json_object(text: Column) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def has_fields(text: Column, fields: dict[str, str]) -> Column:
    """Whether a text is a JSON object with a value of the given SQL type for each field."""
    value = F.try_parse_json(text)
    out = is_json_object(text)
    for name, kind in fields.items():
        out = out & F.try_variant_get(value, f"$['{name}']", kind).isNotNull()
    return F.coalesce(out, F.lit(False))


def schema_guard(text: Column, action: str = "block", fields: dict[str, str] | None = None) -> Column:
    """An answer must be a JSON object and, where fields are given, have them."""
    fields = fields or {}
    reason = F.when(F.try_parse_json(text).isNull(), "invalid_json").when(~is_json_object(text), "not_an_object").otherwise("schema_mismatch")
    return result("schema", ~has_fields(text, fields), action, reason)


def repaired(replies: Column, fields: dict[str, str]) -> Column:
    """Of a model's replies in order (the first, and its repairs): the first that has the fields, and how many were needed; null if none has."""
    tried = F.transform(replies, lambda r, n: F.struct(r.alias("text"), (n + 1).alias("attempts"), has_fields(r, fields).alias("ok")))
    good = F.get(F.filter(tried, lambda t: t["ok"]), F.lit(0))
    return F.when(good.isNotNull(), F.struct(good["text"].alias("text"), good["attempts"].alias("attempts")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def claims(text: Column, least_words: int = 4) -> Column:
    """The sentences of an answer with enough words; citations after a full stop go to the sentence before."""
    parts = F.filter(F.transform(F.split(text, SENTENCE_END), stripped), lambda p: p != "")

    def add(done: Column, part: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat_ws(" ", last, part)))
        return F.when((F.size(done) > 0) & part.rlike(CITATIONS_ALONE), joined).otherwise(F.concat(done, F.array(part)))

    merged = F.aggregate(parts, F.array().cast("array<string>"), add)
    return F.filter(merged, lambda c: F.size(words(c)) >= least_words)


def stems(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(words(text), lambda w: ~w.isin(*STOP_WORDS)), lambda w: F.substring(w, 1, 6)))


def supported(claim: Column, passages: Column, least_overlap: float = 0.5) -> Column:
    """Whether a claim cites passages (a map by citation key) that hold enough of its words."""
    keys = F.filter(F.regexp_extract_all(claim, F.lit(CITATION), F.lit(1)), lambda k: F.map_contains_key(passages, k))
    own = stems(F.regexp_replace(claim, CITATION, " "))
    cited = F.array_distinct(F.flatten(F.transform(keys, lambda k: stems(F.element_at(passages, k)))))
    share = F.size(F.array_intersect(own, cited)) / F.size(own)
    return (F.size(keys) > 0) & (F.size(own) > 0) & F.coalesce(share >= least_overlap, F.lit(False))


def groundedness(answer: Column, passages: Column, least_words: int = 4, least_overlap: float = 0.5) -> Column:
    """The share of supported claims; 1 without claims."""
    found = claims(answer, least_words)
    good = F.filter(found, lambda c: supported(c, passages, least_overlap))
    return F.when(F.size(found) == 0, 1.0).otherwise(F.size(good) / F.size(found))


def groundedness_guard(answer: Column, passages: Column, action: str = "flag", least: float = 0.7, answered: Column | None = None) -> Column:
    """An answer needs enough supported claims. One that is not ``answered`` (abstained, or blocked by another guard) makes none, and is let through."""
    kept = F.array_join(F.filter(claims(answer), lambda c: supported(c, passages)), " ")
    share = groundedness(answer, passages)
    failed = share < least if answered is None else F.coalesce(answered, F.lit(True)) & (share < least)
    return result("groundedness", failed, action, "too few claims are supported", share.cast("string"), kept)


def degradations(results: list[Column]) -> Column:
    """guard_<action>:<guard>:<reason> of each result that did something, up to the first that blocks."""
    note = lambda r: F.when(r["action"] != "allow", F.concat_ws(":", F.concat(F.lit("guard_"), r["action"]), r["guard"], r["reason"]))
    out, open_ = [], F.lit(True)
    for r in results:
        out.append(F.when(open_, note(r)))
        open_ = open_ & ~r["action"].isin("block", "retry")
    return F.array_compact(F.array(*out))


def guarded(answer: Column, citations: Column, results: list[Column]) -> Column:
    """(text, blocked, citations, degradations): a refusal has no citations."""
    blocked = F.lit(False)
    for r in results:
        blocked = blocked | r["action"].isin("block", "retry")
    none = F.slice(citations, 1, 0)
    return F.struct(applied(answer, results).alias("text"), blocked.alias("blocked"), F.when(blocked, none).otherwise(citations).alias("citations"), degradations(results).alias("degradations"))


def admitted(query: Column, results: list[Column]) -> Column:
    """An input after its guards: redactions replace it, a block is an error; retry does not hold it up."""
    out = query
    for r in results:
        out = F.when(r["action"] == "block", F.raise_error(F.concat(F.lit("blocked by "), r["guard"], F.lit(": "), r["reason"]))).when(r["action"] == "redact", r["replacement"]).otherwise(out)
    return out


def regenerated(first: Column, second: Column, checks) -> Column:
    """The reply that counts, of a first one and of one that was asked for after it: the second if any check of the first says retry.

    ``checks`` makes the results of a reply; what is returned is to be guarded by
    them again, where retry blocks.
    """
    again = F.lit(False)
    for r in checks(first):
        again = again | (r["action"] == "retry")
    return F.when(again, second).otherwise(first)


def applied(answer: Column, results: list[Column]) -> Column:
    """The answer after its guards, in order: the first block or retry gives the refusal, redactions replace the text."""
    out = answer
    for r in reversed(results):
        out = F.when(r["action"].isin("block", "retry"), REFUSAL).when(r["action"] == "redact", r["replacement"]).otherwise(out)
    return out
