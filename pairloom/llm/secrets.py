"""Secret scans with an incremental blob ledger.

Every version of a file is named by the digest of its content (its blob). The
ledger remembers which blobs were scanned under which rule versions and what was
found; a scan reads the texts of unseen pairs only, once per blob however many
paths hold it, and the findings are joined back to all paths.

Null is the empty blob. Repeated rows are paths of their own; ties cannot occur,
as spans are ordered by place and kind. An empty table or ledger is fine. Only
the named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table
from pairloom.llm.spans import found, places, written

_FINDINGS = "array<struct<start:bigint,place:int,kind:string,stop:bigint,rule:string>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds candidates; those with ``least`` characters in ``group`` count.

    A new ``version`` makes every blob unseen for this rule. ``hint`` is a string
    without which a text cannot match.
    """

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hint: str | None = None

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: The base rules come first; the order of kinds breaks ties of place.
RULES = (
    Rule(
        "assign",
        1,
        r"""(?=[pstaPSTA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18, "AKIA"),
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{16,}", 0, 16),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", hint="PRIVATE KEY-----"),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", hint="gh"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", hint="xox"),
    Rule("signed_token", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}", hint="eyJ"),
)
BASE_KINDS = ("assign", "access", "hex")


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _kept(spans: Column, place: int, rule: Rule) -> Column:
    """The spans long enough for the rule, as findings."""

    def counts(s: Column) -> Column:
        part = F.regexp_extract(s["hit"], rule.pattern, rule.group) if rule.group else s["hit"]
        return F.length(part) >= rule.least

    def finding(s: Column) -> Column:
        return F.struct(
            s["start"].alias("start"),
            F.lit(place).alias("place"),
            F.lit(rule.kind).alias("kind"),
            s["stop"].alias("stop"),
            F.lit(rule.name).alias("rule"),
        )

    return F.transform(F.filter(spans, counts), finding)


def scan(texts: DataFrame, rules: tuple[Rule, ...], seen: str | None = None) -> DataFrame:
    """``blob, scanned, findings`` of the rows of ``blob, text``; rule names in the
    array column ``seen`` are not run again."""
    body = F.coalesce(F.col("text"), F.lit(""))
    run = {}
    for k, rule in enumerate(rules):
        may = F.lit(True) if rule.hint is None else F.contains(body, F.lit(rule.hint))
        if seen:
            may = may & ~F.array_contains(seen, rule.name)
        run[f"_hits{k}"] = F.when(may, found(body, rule.pattern)).otherwise(F.array().cast("array<string>"))
    hits = texts.withColumns(run)
    findings = [_kept(places(body, r.pattern, F.col(f"_hits{k}")), k, r) for k, r in enumerate(rules)]
    names = F.array(*[F.lit(r.name) for r in rules])
    return hits.select(
        "blob",
        (F.array_except(names, F.col(seen)) if seen else names).alias("scanned"),
        F.sort_array(F.flatten(F.array(*findings))).alias("findings"),
    )


def scan_unseen(
    versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """New ledger rows for the blobs among ``path, text`` that are not yet scanned
    under all ``rules``. Append them to the ledger.

    One row of each blob, the one of the smallest path, gives the text.
    """
    named = versions.select("path", blob_of(F.col("text")).alias("blob"))
    wanted = named.groupBy("blob").agg(F.min("path").alias("path"))
    seen = None
    if ledger is not None:
        seen = "seen"
        known = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("scanned"))).alias("seen"))
        wanted = wanted.join(known, "blob", "left").withColumn(
            "seen", F.coalesce("seen", F.array().cast("array<string>"))
        )
        names = F.array(*[F.lit(r.name) for r in rules])
        wanted = wanted.where(F.size(F.array_except(names, "seen")) > 0)
    texts = versions.select("path", "text").alias("v").join(
        wanted.alias("w"),
        F.col("v.path").eqNullSafe(F.col("w.path")) & (blob_of(F.col("v.text")) == F.col("w.blob")),
    )
    kept = ["w.blob", "v.text"] + (["w.seen"] if seen else [])
    return scan(texts.select(*kept), rules, seen)


def findings_by_path(
    versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``path, findings`` of every row of ``versions``, from all ledger rows of its
    blob; what earlier versions of a rule found does not count."""
    names = [r.name for r in rules]
    merged = ledger.groupBy("blob").agg(F.flatten(F.collect_set("findings")).alias("findings"))
    merged = merged.withColumn(
        "findings", F.sort_array(F.array_distinct(F.filter("findings", lambda f: f["rule"].isin(names))))
    )
    return (
        versions.select("path", blob_of(F.col("text")).alias("blob"))
        .join(merged, "blob", "left")
        .select("path", "blob", F.coalesce("findings", F.array().cast(_FINDINGS)).alias("findings"))
    )


@query("op6_secret_ledger")
def op6_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: a first scan of all blobs, joined back to all documents."""
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    report = findings_by_path(versions, scan_unseen(versions))
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE_KINDS))

    def n(kind: str) -> Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return report.select(
        F.col("path").alias("doc_id"),
        *[n(k) for k in BASE_KINDS],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("findings")).alias("spans"),
    )
