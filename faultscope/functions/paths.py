"""Machine paths in captured text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def scrub_paths(text: Column, prefixes: dict[str, str]) -> Column:
    """Replace literal prefixes by their placeholders, longest prefix first, so
    that a folder inside another is not left half rewritten."""
    out = text
    for prefix in sorted((p for p in prefixes if p and p != "/"), key=len, reverse=True):
        out = F.replace(out, F.lit(prefix), F.lit(prefixes[prefix]))
    return out


def find_machine_paths(text: Column) -> Column:
    """array<string> of home-directory paths left in a text."""
    pattern = r"(?U)(?:/Users/|/home/)[^\s,)'\"\]]+"
    return F.when(text.contains("/Users/") | text.contains("/home/"),
                  F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
                  ).otherwise(F.array().cast("array<string>"))
