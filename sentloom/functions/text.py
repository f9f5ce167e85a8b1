"""Column expressions that turn text into words. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python's str.split() takes as white space; Java's \s lacks most of it.
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def words(text: Column | str) -> Column:
    """Words of a text as Python's split() gives them; a null text has none."""
    return F.array_remove(F.split(F.coalesce(_col(text), F.lit("")), WHITESPACE), "")


def custom_words(text: Column | str, how: Callable) -> Column:
    """Words by a callable: of Column to Column, which stays in the JVM, else of str to list of str, as an Arrow UDF."""
    column = _col(text)
    try:
        out = how(column)
    except (TypeError, AttributeError, ValueError):
        out = None
    if isinstance(out, Column):
        return out
    return F.udf(lambda t: [] if t is None else list(how(t)), T.ArrayType(T.StringType()), useArrow=True)(column)


def benchmark_words(text: Column | str) -> Column:
    """The evaluation corpus's preparation: lower-case words with a letter or digit, no outer `";.:()` quotes, n't as not, parts at hyphens."""
    low = F.regexp_replace(F.lower(F.coalesce(_col(text), F.lit(""))), "n't\\b", " not")
    parts = F.flatten(F.transform(words(low), lambda w: F.split(w, "-")))
    bare = F.transform(parts, lambda w: F.regexp_replace(w, "^[\"';.:()`,!?]+|[\"';.:()`,!?]+$", ""))
    return F.filter(bare, lambda w: w.rlike("[\\p{L}\\p{N}]"))


def with_words(df: DataFrame, text: str = "text", index: str | None = None, how: Callable | None = None) -> DataFrame:
    """Rows (idx, words) of a table of texts. index: an existing integer column, which may repeat."""
    made = words(text) if how is None else custom_words(text, how)
    if index is None:
        raise ValueError("an index column is needed; sources.corpus.from_list numbers a list")
    return df.select(F.col(index).cast("long").alias("idx"), made.alias("words"))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
