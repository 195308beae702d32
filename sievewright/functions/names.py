"""Column-name rules: reader-level duplicate names, tidy names, aliases, collisions."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Short spellings and the names the rest of the library expects.
COLUMN_ALIASES = {
    "src_ip": "source_ip",
    "dst_ip": "destination_ip",
    "src_port": "source_port",
    "dst_port": "destination_port",
}


def mangle_header(fields: Iterable[str]) -> list[str]:
    """Give repeated header fields a ``.1``, ``.2`` suffix and empty ones a position name."""
    taken: set[str] = set()
    names = []
    for position, field in enumerate(fields):
        base = field if field != "" else f"Unnamed: {position}"
        name, copy = base, 0
        while name in taken:
            copy += 1
            name = f"{base}.{copy}"
        taken.add(name)
        names.append(name)
    return names


def tidy_name(raw: str) -> str:
    """Lower-case word characters joined by single underscores."""
    return re.sub(r"[\W_]+", "_", raw.strip().lower()).strip("_")


def tidy_names(raw: Iterable[str], aliases: dict[str, str] | None = None) -> list[str]:
    """Tidy every name, apply aliases, and number later copies ``x_1``, ``x_2``."""
    aliases = COLUMN_ALIASES if aliases is None else aliases
    taken: set[str] = set()
    names = []
    for item in raw:
        base = tidy_name(item)
        base = aliases.get(base, base)
        name, copy = base, 0
        while name in taken:
            copy += 1
            name = f"{base}_{copy}"
        taken.add(name)
        names.append(name)
    return names


def normalise_columns(df: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Rename all columns at once; a metadata-only change."""
    return df.toDF(*tidy_names(df.columns, aliases))


def numeric_columns(
    df: DataFrame, exclude: Iterable[str] = (), first: int | None = None
) -> list[str]:
    """Numeric columns in schema order, optionally only the first few."""
    skip = set(exclude)
    names = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in skip
    ]
    return names[:first]
