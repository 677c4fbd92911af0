"""Array, sequence and JSON-cell expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import strip

# Standard residue letters, and the letters that are allowed but
# reported as ambiguous.
STANDARD_ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
AMBIGUOUS_LETTERS = "BXZJUO"


def composition(col: Column, alphabet: str = STANDARD_ALPHABET) -> Column:
    """Share of each alphabet letter among all alphabet letters.

    Null when the text has none of them, which the caller reports as an error.
    """
    def shares(text: Column) -> Column:
        kept = F.length(text)
        counts = F.array(*[kept - F.length(F.replace(text, F.lit(ch), F.lit(""))) for ch in alphabet])
        return F.transform(counts, lambda n: n / kept.cast("double"))

    # The one-element array binds the cleaned text, so it is computed once.
    letters = F.regexp_replace(F.upper(col), f"[^{alphabet}]+", "")
    bound = F.transform(F.array(letters), lambda t: F.when(F.length(t) > 0, shares(t)))
    return F.element_at(bound, 1)


def window_starts(length: Column, size: int, stride: int) -> Column:
    """Zero-based starts at a fixed stride; the last window reaches the end."""
    if size <= 0 or not 0 < stride <= size:
        raise ValueError("need 0 < stride <= size")
    steps = F.greatest(F.lit(0), F.ceil((length - F.lit(size)) / F.lit(float(stride)))).cast("int")
    return F.when(length > 0, F.sequence(F.lit(0), steps * F.lit(stride), F.lit(stride)))


def explode_windows(df: DataFrame, col: str, size: int, stride: int) -> DataFrame:
    """One row per window: window_index, window_start, window_text, is_last."""
    starts = window_starts(F.length(col), size, stride)
    rows = df.select("*", F.posexplode(starts).alias("window_index", "window_start"))
    return rows.select(
        "*",
        F.substr(F.col(col), F.col("window_start") + 1, F.lit(size)).alias("window_text"),
        (F.col("window_start") + size >= F.length(col)).alias("is_last"),
    )


def json_map_checks(col: Column, min_keys: int = 2, placeholder: str = "REPLACE") -> Column:
    """struct of the checks on a JSON object cell of text values."""
    parsed = F.from_json(col, "map<string,string>")
    values = F.transform(F.map_values(parsed), lambda v: F.coalesce(strip(v), F.lit("")))
    keys = F.transform(F.map_keys(parsed), strip)
    bad = lambda v: (v == "") | F.upper(v).contains(placeholder)
    flags = {
        "enough_keys": F.size(keys) >= min_keys,
        "values_filled": ~F.exists(values, bad) & ~F.exists(keys, lambda k: k == ""),
        "keys_distinct": F.size(F.array_distinct(keys)) == F.size(keys),
        "values_differ": F.size(F.array_distinct(values)) >= 2,
    }
    parsed_ok = parsed.isNotNull()
    return F.struct(
        parsed_ok.alias("parsed"),
        *[F.coalesce(parsed_ok & f, F.lit(False)).alias(n) for n, f in flags.items()],
    )


def symmetric_features(a: Column, b: Column, len_a: Column, len_b: Column) -> Column:
    """Swap-invariant features: mean, absolute difference and product of the
    vectors, then mean and difference of log lengths and the length ratio."""
    log_a, log_b = F.log1p(len_a.cast("double")), F.log1p(len_b.cast("double"))
    lengths = F.array(
        (log_a + log_b) / 2,
        F.abs(log_a - log_b),
        F.least(len_a, len_b).cast("double") / F.greatest(len_a, len_b),
    )
    wide = lambda v: F.transform(v, lambda x: x.cast("double"))
    a, b = wide(a), wide(b)
    return F.concat(
        F.zip_with(a, b, lambda x, y: (x + y) / 2),
        F.zip_with(a, b, lambda x, y: F.abs(x - y)),
        F.zip_with(a, b, lambda x, y: x * y),
        lengths,
    )
