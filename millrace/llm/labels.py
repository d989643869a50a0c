"""Common spelling of source, language and domain labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.llm.languages import label_code

UNKNOWN = "unknown"


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))


def source_label(c: Column) -> Column:
    """Lower case, blanks and underscores as hyphens; missing or empty is ``unknown``."""
    name = F.regexp_replace(_bare(c), r"[\s_]+", "-")
    return F.when(name.isNull() | name.isin("", "none", "n/a"), UNKNOWN).otherwise(name)


def domain_label(c: Column) -> Column:
    """Lower case without a ``topic:`` prefix; missing or empty is ``unknown``."""
    name = F.regexp_replace(_bare(c), r"^topic:\s*", "")
    return F.when(name.isNull() | name.isin("", "none", "n/a"), UNKNOWN).otherwise(name)


def lang_label(c: Column) -> Column:
    """Two-letter code; a label that names no single language is ``unknown``."""
    return F.coalesce(label_code(c), F.lit(UNKNOWN))
