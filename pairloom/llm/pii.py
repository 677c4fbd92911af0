"""Personal data: high-recall generators, boosted trees, calibrated thresholds.

Generators propose overlapping spans. The base generators carry their own check
(dotted numbers, check digits, digit counts); what passes is redacted in any
case. The others propose what those checks miss, such as two card numbers in one
run of digits. Boosted trees over format and context features, fitted on all
proposals with the base verdicts as labels, score every proposal; per kind,
the lowest score at which held-out proposals reach the wanted precision selects
further spans. Proposals with equal features and label are one row with their number
as its weight, so the trees see every proposal and the rows grow with what differs.

Null and empty texts have no spans. Repeated rows are scored each; equal scores
fall back to place and kind. An empty table, or proposals without both classes,
add nothing to the base spans. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.catalog import query, table
from pairloom.llm.spans import found, places, written
from pairloom.runtime import stage

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
CONTEXT = 24
SEED = 11


@dataclass(frozen=True)
class Generator:
    """Proposes the matches of ``pattern`` in a cleaned text of the same length."""

    kind: str
    pattern: str
    source: str
    hint: str
    base: bool


# In "_mail" a dot that no domain character follows is "_"; in "_digits" a space
# or hyphen that is not between two digits is "x". Lengths stay, so places do, and
# the patterns below are plain runs: no group repeats, no start is tried twice.
GENERATORS = (
    Generator(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*+",
        "_mail",
        "@",
        True,
    ),
    Generator("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "_text", "[0-9]", True),
    Generator("card", r"[0-9][0-9 -]++", "_digits", "[0-9]", True),
    Generator("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "_text", r"\+[0-9]", True),
    Generator("card", r"(?<![0-9])[0-9]{13,19}(?![0-9])", "_text", "[0-9]{13}", False),
    Generator("card", r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}(?![0-9])", "_text", "[0-9]{4}[ -]", False),
    Generator("phone", r"(?<![0-9])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", "_text", "[0-9]{4}", False),
    Generator(
        "email", r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}\.[A-Za-z]{2,24}", "_text", r"[(\[]at[)\]]", False
    ),
)

FEATURES = (
    "f_kind", "f_length", "f_digits", "f_letters", "f_separators", "f_at", "f_plus", "f_dots",
    "f_check_digit", "f_octets", "f_left_word", "f_left_digit", "f_right_digit", "f_cue",
)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def check_digit(digits: Column) -> Column:
    """Whether the Luhn sum of up to 19 digits is a multiple of ten."""
    places_ = F.split(F.reverse(digits), "(?!^)(?!$)")
    values = F.transform(
        places_,
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            F.get(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), d.cast("int"))
        ),
    )
    return F.when(
        F.length(digits).between(1, 19), F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0
    ).otherwise(False)


def octets(hit: Column) -> Column:
    """Whether all numbers between the dots are at most 255."""
    number = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(
        F.split(hit, r"\."),
        lambda p: (F.length(number(p)) <= 3) & number(p).try_cast("int").between(0, 255),
    )


def base_check(kind: Column, hit: Column) -> Column:
    """The base rule's own verdict on a match of a base generator."""
    d = digits_of(hit)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.coalesce(octets(hit), F.lit(False)))
        .when(kind == "card", F.length(d).between(16, 19) & check_digit(d))
        .otherwise(F.length(d).between(8, 15))
    )


def _proposed(spans: Column, generator: Generator) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(
            F.lit(generator.kind).alias("kind"),
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            F.lit(generator.base).alias("base"),
        ),
    )


def propose(docs: DataFrame, generators: tuple[Generator, ...] = GENERATORS) -> DataFrame:
    """``row, kind, start, stop, hit, left, right, base`` of every proposal in the
    rows of ``row, text``. Only texts with a digit or an at sign are taken apart."""
    body = F.col("text")
    docs = docs.where(body.rlike("[0-9@]|[(\\[]at[)\\]]")).select(
        "row",
        body.alias("_text"),
        F.when(F.contains(body, F.lit("@")), F.regexp_replace(body, r"\.(?![A-Za-z0-9-])", "_"))
        .otherwise("")
        .alias("_mail"),
        F.when(body.rlike("[0-9]"), F.regexp_replace(body, r"[ -](?![0-9])|(?<![0-9])[ -]", "x"))
        .otherwise("")
        .alias("_digits"),
    )
    none = F.array().cast("array<string>")
    docs = docs.withColumns(
        {
            f"_hits{k}": F.when(F.col("_text").rlike(g.hint), found(F.col(g.source), g.pattern)).otherwise(none)
            for k, g in enumerate(generators)
        }
    )
    docs = docs.where(" or ".join(f"size(_hits{k}) > 0" for k in range(len(generators))))
    spans = [
        _proposed(places(F.col(g.source), g.pattern, F.col(f"_hits{k}")), g)
        for k, g in enumerate(generators)
    ]
    docs = docs.select("row", "_text", F.explode(F.flatten(F.array(*spans))).alias("s"))
    start, stop = F.col("s.start"), F.col("s.stop")
    hit = F.substring("_text", (start + 1).cast("int"), (stop - start).cast("int"))
    docs = docs.select(
        "row",
        "s.*",
        hit.alias("hit"),
        F.substring(
            "_text", F.greatest(start - CONTEXT, F.lit(0)).cast("int") + 1, F.least(start, F.lit(CONTEXT)).cast("int")
        ).alias("left"),
        F.substring("_text", stop.cast("int") + 1, F.lit(1)).alias("right"),
    )
    return docs.withColumn("base", F.col("base") & base_check(F.col("kind"), F.col("hit")))


def with_features(proposals: DataFrame) -> DataFrame:
    """Format and context of every proposal as numbers."""
    hit, left, right = F.col("hit"), F.lower("left"), F.col("right")
    n = lambda pattern: F.length(F.regexp_replace(hit, f"[^{pattern}]", ""))
    cue = r"(tel|phone|call|fax|mobile|card|visa|account|mail|contact|addr)[a-z]*[^a-z0-9]*$"
    features = (
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")),
        F.length(hit),
        n("0-9"),
        n("A-Za-z"),
        n(r"\x20().\-"),
        n("@"),
        n("+"),
        n("."),
        check_digit(digits_of(hit)),
        F.coalesce(F.when(F.col("kind") == "ip", octets(hit)), F.lit(False)),
        left.rlike("[a-z]$"),
        left.rlike("[0-9]$"),
        right.rlike("[0-9]"),
        left.rlike(cue),
    )
    return proposals.withColumns({name: f.cast("double") for name, f in zip(FEATURES, features)})


def fit_scorer(proposals: DataFrame, sample_rows: int | None = None):
    """The fitted trees and the threshold of each kind, or None without two classes.

    All proposals count, or with ``sample_rows`` those of lowest seeded hash. A label
    says whether a base verdict covers exactly this span. Every fifth proposal by hash is
    held out for the thresholds: the lowest score from which on the wanted precision holds.
    """
    order = F.xxhash64(F.lit(SEED), "row", "kind", "start", "stop")
    proposals = proposals.withColumn("order", order)
    if sample_rows is not None:
        proposals = proposals.orderBy("order", "row", "kind", "start", "stop", "base").limit(sample_rows)
    held = (F.pmod("order", F.lit(5)) == 0).alias("held")
    key = ["kind", *FEATURES, "label", "held"]
    cells = stage(
        proposals.select("kind", *FEATURES, F.col("base").cast("double").alias("label"), held)
        .groupBy(*key)
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .orderBy(*key),
        "pii-cells",
    )
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    fitting = vectors.transform(cells.where("not held")).select("features", "label", "n")
    classes = fitting.agg(F.min("label"), F.max("label")).first()
    if classes[0] is None or classes[0] == classes[1]:
        return None
    trees = GBTClassifier(maxIter=8, maxDepth=4, seed=SEED, stepSize=0.3, weightCol="n").fit(fitting)
    # The trees give few scores, so what a kind's window orders does not grow with the proposals.
    scores = (
        _scored(trees, vectors, cells.where("held"))
        .groupBy("kind", "score")
        .agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("hits"))
    )
    above = Window.partitionBy("kind").orderBy(F.desc("score")).rangeBetween(Window.unboundedPreceding, 0)
    precision = F.sum("hits").over(above) / F.sum("n").over(above)
    reached = scores.withColumn("precision", precision).where(F.col("precision") >= PRECISION)
    thresholds = {r["kind"]: r["t"] for r in reached.groupBy("kind").agg(F.min("score").alias("t")).collect()}
    return trees, vectors, thresholds


def _scored(trees, vectors: VectorAssembler, rows: DataFrame) -> DataFrame:
    out = trees.transform(vectors.transform(rows))
    return out.withColumn("score", vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def redactions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sample_rows: int | None = None) -> DataFrame:
    """``doc_id, base, spans`` of every row: the base spans and all selected spans,
    each ``array<struct<place, start, stop, kind>>``, by kind and start.

    Added spans overlap no base span and no added span of a higher place in order.
    """
    key = [F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    rows = docs.select(*key).withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("version")))
    # Generators overlap: a span is one proposal, and a base one if any says so.
    spans = with_features(propose(rows.select("row", "text")))
    proposals = stage(
        spans.groupBy("row", "kind", "start", "stop", *FEATURES).agg(F.max("base").alias("base")), "pii-proposals"
    )
    fitted = fit_scorer(proposals, sample_rows)
    place = (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int").alias("place")
    span = F.struct(place, "start", "stop", "kind")
    base = proposals.where("base").select("row", span.alias("span"), F.lit(True).alias("base"), F.lit(1.0).alias("score"))
    if fitted:
        trees, vectors, thresholds = fitted
        cut = F.lit(2.0)
        for kind, least in sorted(thresholds.items()):
            cut = F.when(F.col("kind") == kind, F.lit(least)).otherwise(cut)
        added = _scored(trees, vectors, proposals.where("not base")).where(F.col("score") >= cut)
        base = base.unionByName(added.select("row", span.alias("span"), F.lit(False).alias("base"), "score"))
    # A document's spans are as many as its text holds; they meet in its row.
    one = F.struct(
        F.col("span.start").alias("start"), F.col("span.stop").alias("stop"), "span", F.col("score")
    )
    grouped = base.groupBy("row").agg(
        F.collect_set(F.when(F.col("base"), F.col("span"))).alias("base"),
        F.collect_set(F.when(~F.col("base"), one)).alias("more"),
    )
    free = F.filter(
        "more",
        lambda m: ~F.exists("base", lambda b: (b["start"] < m["stop"]) & (m["start"] < b["stop"])),
    )
    apart = F.aggregate(
        F.sort_array(free),
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda acc, m: F.when(m["start"] < acc["at"], acc).otherwise(
            F.struct(m["stop"].alias("at"), F.concat(acc["out"], F.array(m["span"])).alias("out"))
        ),
        lambda acc: acc["out"],
    )
    grouped = grouped.select(
        "row", F.sort_array("base").alias("base"), F.sort_array(F.concat("base", apart)).alias("spans")
    )
    empty = F.array().cast(_SPANS)
    return (
        rows.select("doc_id", "row")
        .alias("d")
        .join(grouped.alias("g"), F.col("d.row").eqNullSafe(F.col("g.row")), "left")
        .select(
            "d.doc_id", F.coalesce("g.base", empty).alias("base"), F.coalesce("g.spans", empty).alias("spans")
        )
    )


_SPANS = "array<struct<place:int,start:bigint,stop:bigint,kind:string>>"


@query("op5_pii_boosting")
def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found_ = redactions(table(spark, sf_dir, "documents"))

    def n(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found_.select(
        "doc_id",
        *[n(k) for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
    )
