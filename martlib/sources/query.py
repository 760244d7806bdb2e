"""Parameterised SQL over the star schema's views."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# A quoted literal or name, a comment, or a %s marker outside all of them.
_MARKER = re.compile(
    r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|%s""", re.DOTALL
)


def run_query(
    spark: SparkSession, sql: str, params: Sequence | Mapping | None = None
) -> DataFrame:
    """A lazy DataFrame for ``sql``.

    Positional parameters bind to ``?`` or ``%s`` markers, a mapping to ``:name`` markers.
    ``%s`` inside quotes, backticks or a comment is left alone.
    """
    if params is None:
        return spark.sql(sql)
    if isinstance(params, Mapping):
        return spark.sql(sql, args=dict(params))
    text = _MARKER.sub(lambda m: "?" if m.group() == "%s" else m.group(), sql)
    return spark.sql(text, args=list(params))
