"""The key that a written user hash stands for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may stand before a label, and the label.
LABEL = r"""^[\s\p{Z}\p{Ps}\p{Pi}\p{Pf}"'`<]*([a-z0-9]+[:=_/]|0x)"""


def user_key(value: Column | str) -> Column:
    """Lower case, one leading label dropped, then all but a-z and 0-9 dropped; null where nothing is left.

    A label is a run of letters and digits closed by one of ``: = _ /``, or ``0x``, possibly after blanks, quotes or
    opening brackets. Hashes that are clean already, nearly all, skip the replacements.
    """
    value = F.col(value) if isinstance(value, str) else value
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), LABEL, ""), "[^a-z0-9]", "")
    return F.when(value.rlike("^(?!0x)[a-z0-9]+\\z"), value).otherwise(F.nullif(bare, F.lit("")))


def user_key_sql(value: str) -> str:
    """The same as DuckDB SQL."""
    label = LABEL.replace("'", "''")
    return f"nullif(regexp_replace(regexp_replace(lower({value}), '{label}', ''), '[^a-z0-9]', '', 'g'), '')"
