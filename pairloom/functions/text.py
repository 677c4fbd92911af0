"""String clean-up and identifier extraction."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The identifier shapes the operators must recognise.
TERM_PATTERN = r"MI:\d{4}"
PUBLICATION_PATTERN = r"(?i)pubmed:(\d+)"
ISOFORM_PATTERN = r"^([A-Z0-9]{6,10})-(\d+)$"
DIGEST_PATTERN = r"^[0-9a-f]{64}$"

# Fixed value: every character that counts as whitespace at the ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(col: Column) -> Column:
    """Remove leading and trailing whitespace of any kind, not spaces only.

    Trimming a character set is slow per cell, so only cells with whitespace
    at an end are trimmed.
    """
    ragged = F.substring(col, 1, 1).isin(*WHITESPACE) | F.substring(col, -1, 1).isin(*WHITESPACE)
    return F.when(ragged, F.btrim(col, F.lit(WHITESPACE))).otherwise(col)


def blank_to_null(col: Column) -> Column:
    cleaned = strip(col)
    return F.when(cleaned != "", cleaned)


def strip_all(df: DataFrame, optional: Iterable[str] = ()) -> DataFrame:
    """Strip every string column; a blank in an ``optional`` column is null."""
    optional = set(optional)
    cleaned = []
    for name, kind in df.dtypes:
        col = F.col(name)
        if kind == "string":
            col = blank_to_null(col) if name in optional else strip(col)
        cleaned.append(col.alias(name))
    return df.select(*cleaned)


def is_digest(col: Column) -> Column:
    return F.coalesce(F.lower(strip(col)).rlike(DIGEST_PATTERN), F.lit(False))


def terms(col: Column, pattern: str = TERM_PATTERN) -> Column:
    """Sorted distinct ontology terms found anywhere in the cell."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(f"({pattern})"), 1)
    return F.array_sort(F.array_distinct(found))


def single_term(col: Column, pattern: str = TERM_PATTERN) -> Column:
    """The term when the cell names exactly one, otherwise blank."""
    found = terms(col, pattern)
    return F.when(F.size(found) == 1, F.element_at(found, 1)).otherwise(F.lit(""))


def publication_ids(col: Column, pattern: str = PUBLICATION_PATTERN, prefix: str = "PMID:") -> Column:
    """``PMID:1;PMID:22``: distinct ids in string order."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), 1)
    ordered = F.array_sort(F.array_distinct(found))
    return F.array_join(F.transform(ordered, lambda v: F.concat(F.lit(prefix), v)), ";")


def split_namespace(col: Column) -> Column:
    """First ``|`` token of ``ns:id`` as struct<namespace, identifier>."""
    token = F.substring_index(strip(col), "|", 1)
    colon = F.instr(token, ":")
    rest = strip(F.substr(token, colon + 1))
    return F.struct(
        F.when(colon == 0, F.lit("unknown"))
        .otherwise(F.lower(F.substring_index(token, ":", 1)))
        .alias("namespace"),
        F.when(colon == 0, token).otherwise(rest).alias("identifier"),
    )


def isoform_parts(col: Column, pattern: str = ISOFORM_PATTERN) -> Column:
    """struct<base_id, isoform_specific, status> of an accession."""
    isoform = col.rlike(pattern)
    return F.struct(
        F.when(isoform, F.regexp_extract(col, pattern, 1)).otherwise(col).alias("base_id"),
        isoform.alias("isoform_specific"),
        F.when(isoform, F.lit("quarantine_isoform_specific"))
        .otherwise(F.lit("mapping_candidate"))
        .alias("status"),
    )


def strip_version(col: Column, pattern: str) -> Column:
    """Id without its trailing ``.n``; null when the id part has another shape."""
    shape = rf"^({pattern})(\.\d+)?$"
    return F.when(col.rlike(shape), F.regexp_extract(col, shape, 1))


def group_ids(col: Column, pattern: str) -> Column:
    """Sorted distinct uppercase group ids; group 1 of ``pattern`` is the id."""
    found = F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(pattern), 1)
    return F.array_sort(F.array_distinct(F.transform(found, F.upper)))
