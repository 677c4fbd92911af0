"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: its measurement stays as a column
and its failure as one bit of ``failure_bits``. A policy is a version and a
mask over those bits, so applying another version, or asking what each rule
costs alone, reads the ledger and never the texts again.

A null text counts as an empty one: no words, all measurements 0, and the
minimum-words rule fails. Repeated rows and ties are judged row by row; other
columns pass through, and an input column named like a measurement is replaced.
Everything is built-in expressions inside one row, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table

#: Fixed values of the contract.
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

_WORDS = "_words"
_WINDOWS = "_windows"
_REPEATS = "_repeats"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


@dataclass(frozen=True)
class Rule:
    """A rule fails where its predicate over the measurements holds."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Policy:
    """A version and the rules it enforces."""

    version: str
    rules: tuple[str, ...]


def rules() -> tuple[Rule, ...]:
    """The rule set; the position of a rule is its bit. New rules go to the end."""
    words, chars = F.col("n_words"), F.col("word_chars")
    return (
        Rule("few_words", words < 50),
        Rule("repeated_windows", F.col("n_repeat_words") * 100 > words * 50),
        Rule("symbols", F.col("n_symbols") * 10 > words),
        Rule("capitals", F.col("n_upper") * 10 > chars * 4),
        Rule("repeated_lines", F.col("n_dup_lines") * 2 > F.col("n_lines")),
        Rule("word_length", (chars < words * 2) | (chars > words * 15)),
    )


BASE_RULES = ("few_words", "repeated_windows")
POLICIES = (
    Policy("base", BASE_RULES),
    Policy("v1", ("few_words", "repeated_windows", "symbols", "capitals")),
    Policy("v2", ("few_words", "repeated_windows", "symbols", "capitals", "repeated_lines", "word_length")),
)
CURRENT = POLICIES[-1]


def measure(df: DataFrame, text: str = "text", names: tuple[str, ...] = MEASURES) -> DataFrame:
    """Add the named measurements of ``text``: any of ``MEASURES`` and ``n_distinct``, its
    distinct words. What is not named is not computed."""
    columns = df.columns
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(WHITE))
    words = F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(
        F.split(trimmed, r"[\x20\x09-\x0D]+")
    )
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.btrim(x, F.lit(WHITE))) > 0)
    stripped = F.translate(body, WHITE, "")
    df = df.withColumns({_WORDS: words, "_lines": lines, "_stripped": stripped})
    # The hash of each three-word window beside its place, in hash order: windows
    # that occur twice stand next to each other.
    w = F.col(_WORDS)
    windows = F.transform(
        F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
        lambda a, i: F.struct(F.xxhash64(a, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )
    df = df.withColumn(_WINDOWS, F.sort_array(windows))
    s = F.col(_WINDOWS)
    places = F.transform(
        s,
        lambda x, k: F.when(
            (F.get(s, k + 1)["h"] == x["h"]) | (F.get(s, k - 1)["h"] == x["h"]), x["i"]
        ),
    )
    df = df.withColumn(_REPEATS, F.sort_array(F.filter(places, lambda x: x.isNotNull())))
    p = F.col(_REPEATS)
    covered = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
    dense = F.col("_stripped")
    measures = {
        "n_words": F.size(w),
        "word_chars": F.length(dense),
        "n_symbols": F.length(dense) - F.length(F.translate(dense, SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.aggregate(covered, F.lit(0), lambda a, x: a + x),
        "n_lines": F.size("_lines"),
        "n_upper": F.regexp_count(dense, F.lit(r"\p{Lu}")),
        "n_distinct": F.size(F.array_distinct(w)),
    }
    measures = {name: measures[name] for name in names}
    # One generated row per row: a filter on a measurement then stays above it and
    # does not evaluate the arrays again.
    one = F.array(F.struct(*[c.cast("long").alias(name) for name, c in measures.items()]))
    kept = [c for c in columns if c not in measures]
    return df.select(*kept, F.inline(one))


def rule_ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failure_bits`` of every row."""
    bits = [
        F.when(rule.fails, F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        for k, rule in enumerate(rules())
    ]
    return measure(df, text).withColumn("failure_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask_of(names: tuple[str, ...]) -> int:
    place = {rule.name: k for k, rule in enumerate(rules())}
    return sum(1 << place[n] for n in names)


def passes(policy: Policy, bits: str = "failure_bits") -> Column:
    """Whether a ledger row fails none of the policy's rules."""
    return F.col(bits).bitwiseAND(F.lit(mask_of(policy.rules)).cast("long")) == 0


def ablations(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES) -> DataFrame:
    """For every policy and each of its rules: rows kept, rows kept without the
    rule, and rows that the rule alone rejects. Rows first shrink to one count
    per bit pattern, so the rest works on at most two to the number of rules rows.
    """
    place = {rule.name: k for k, rule in enumerate(rules())}
    wanted = [
        F.struct(
            F.lit(p.version).alias("version"),
            F.lit(r).alias("rule"),
            F.lit(mask_of(p.rules)).cast("long").alias("policy_mask"),
            F.lit(1 << place[r]).cast("long").alias("rule_bit"),
        )
        for p in policies
        for r in p.rules
    ]
    patterns = ledger.groupBy("failure_bits").agg(F.count("*").alias("n"))
    hit = F.col("failure_bits").bitwiseAND(F.col("policy_mask"))
    return (
        patterns.select("failure_bits", "n", F.inline(F.array(*wanted)))
        .groupBy("version", "rule")
        .agg(
            F.sum(F.when(hit == 0, F.col("n")).otherwise(0)).alias("n_kept"),
            F.sum(F.when((hit == 0) | (hit == F.col("rule_bit")), F.col("n")).otherwise(0)).alias(
                "n_kept_without"
            ),
            F.sum(F.when(hit == F.col("rule_bit"), F.col("n")).otherwise(0)).alias("n_rejected_alone"),
        )
    )


_SQL = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents),
g as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as tri
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
r as (
  select doc_id, i from g
  qualify count(*) over (partition by doc_id, tri) > 1),
c as (
  select doc_id, count(distinct j) as n_repeat_words
  from (select doc_id, unnest([i, i + 1, i + 2]) as j from r) group by doc_id),
m as (
  select d.doc_id, len(w)::bigint as n_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(l)::bigint as n_lines,
    len(regexp_extract_all(t, '\p{Lu}'))::bigint as n_upper
  from d left join c using (doc_id)),
f as (
  select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint
    + 4 * (10 * n_symbols > n_words)::bigint + 8 * (10 * n_upper > 4 * word_chars)::bigint
    + 16 * (2 * n_dup_lines > n_lines)::bigint
    + 32 * (word_chars < 2 * n_words or word_chars > 15 * n_words)::bigint as failure_bits
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (failure_bits & 3) <> 0 as base_failed, failure_bits = 0 as kept, failure_bits
from f
"""


@query("op4_quality_rules", _SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document, its base failure and the current verdict."""
    base = Policy("base", BASE_RULES)
    return rule_ledger(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~passes(base)).alias("base_failed"),
        (passes(base) & passes(CURRENT)).alias("kept"),
        "failure_bits",
    )
