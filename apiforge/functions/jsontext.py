"""JSON text assembly helpers (Column -> Column).

The parameter schema has a scalar-or-list ``type`` and an absent-or-null
``default``, which ``to_json`` of a struct cannot express, so the text is
assembled with ``concat`` and ``to_json`` is only used to escape strings.
Separators follow the default JSON dump style of the original files
(``", "`` between items, ``": "`` after keys).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quote(s: Column) -> Column:
    """A JSON string literal for ``s`` (null stays null)."""
    j = F.to_json(F.array(s))
    return F.when(s.isNotNull(), F.substr(j, F.lit(2), F.length(j) - 2))


def obj(*pairs: tuple) -> Column:
    """``{"k": v, ...}`` from (key, json-text column) pairs; a null value
    column drops the member (absent, not null)."""
    members = [F.when(v.isNotNull(), F.concat(F.lit('"' + k + '": '), v)) for k, v in pairs]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def array_text(items: Column) -> Column:
    """``[a, b]`` from an array of json-text elements."""
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
