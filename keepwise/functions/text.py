"""String helpers as JVM column expressions (no Python per row)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# A finite decimal or scientific number, or an infinity; anything else is "not a number".
NUMBER_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind (not only spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def to_number(c: Column) -> Column:
    """Text to DOUBLE; blank, ``nan`` and non-numbers become NULL.

    The regex guard keeps Spark-only spellings such as ``1.0d`` out, and
    ``try_cast`` never raises under ANSI mode.
    """
    s = strip(c.cast("string"))
    return F.when(s.rlike(NUMBER_RE), s.try_cast("double"))


def title_case(c: Column) -> Column:
    """Title case where every letter after a non-letter starts a word.

    ``initcap`` only starts words after spaces; here ``Month-to-month`` becomes
    ``Month-To-Month`` and ``4g`` becomes ``4G``.
    """
    chars = F.split(F.lower(c), "")
    out = F.transform(
        chars,
        lambda ch, i: F.when(i == 0, F.upper(ch))
        .when(~F.get(chars, i - 1).rlike(r"\p{L}"), F.upper(ch))
        .otherwise(ch),
    )
    return F.array_join(out, "")


def humanize_feature(c: Column) -> Column:
    """Readable label for an encoded feature name.

    Drops a leading ``num__`` and then a leading ``cat__``, turns underscores into
    spaces, trims and title-cases; an empty result falls back to the input.
    """
    s = strip(c)
    s = F.regexp_replace(s, r"^num__", "")
    s = F.regexp_replace(s, r"^cat__", "")
    s = strip(F.regexp_replace(s, "_", " "))
    return F.when(F.length(s) > 0, title_case(s)).otherwise(c)


def hint_key(c: Column) -> Column:
    """Lower-case and drop spaces, hyphens and underscores."""
    return F.translate(F.lower(c), " -_", "")


def fill(template: str, values: dict[str, Column]) -> Column:
    """A sentence with its ``{name}`` placeholders replaced by string columns."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*[values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p])


def fill_sql(template: str, values: dict[str, str]) -> str:
    """The same as a SQL expression."""
    parts = re.split(r"\{(\w+)\}", template)
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    return " || ".join(values[p] if i % 2 else quoted(p) for i, p in enumerate(parts) if i % 2 or p)
