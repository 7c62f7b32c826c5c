"""Column-name normalisation (SRC10) and identifier safety (SRC11)."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame

_NON_ALNUM = re.compile(r"[^a-z0-9]+")
_IDENTIFIER = re.compile(r"^[A-Z][A-Z0-9_]*$")


def snake_case(name: str) -> str:
    """Trim, lower-case, turn each non-alphanumeric run into ``_``, strip ``_``."""
    return _NON_ALNUM.sub("_", name.strip().lower()).strip("_")


def normalize_column_names(df: DataFrame) -> DataFrame:
    """Rename every column to snake_case; a name clash is an error."""
    names = [snake_case(c) for c in df.columns]
    clashes = sorted({n for n in names if names.count(n) > 1})
    if clashes:
        raise ValueError(f"column names clash after normalisation: {', '.join(clashes)}")
    return df.toDF(*names)


def validate_identifier(value: str) -> str:
    """Upper-cased, trimmed identifier; letters, digits and ``_`` only,
    starting with a letter.  Guards table and schema names before they are
    placed into SQL text."""
    cleaned = value.upper().strip()
    if not _IDENTIFIER.match(cleaned):
        raise ValueError(f"Unsafe identifier: {value!r}")
    return cleaned


def quoted(*names: str) -> str:
    """Checked names as a back-quoted, dotted identifier of Spark SQL."""
    return ".".join(f"`{validate_identifier(n).lower()}`" for n in names)


def pick_columns(stored: Iterable[str], wanted: Iterable[str] | None, source: str) -> list[str]:
    """The stored columns to read: those that are wanted, in that order and by
    their snake_case names, or all by name.  Wanting only columns that are not
    there is an error."""
    by_name = {snake_case(c): c for c in stored}
    if wanted is None:
        return [by_name[n] for n in sorted(by_name)]
    chosen = [by_name[n] for n in map(snake_case, wanted) if n in by_name]
    if not chosen:
        raise ValueError(f"{source} has none of the wanted columns")
    return chosen


def check_tables(wanted: Iterable[str], there: Iterable[str], source: str) -> Mapping[str, str]:
    """Stored name of each wanted table, whatever the letter case; names all
    that are not there."""
    by_name = {t.lower(): t for t in there}
    absent = [t for t in wanted if t.lower() not in by_name]
    if absent:
        raise RuntimeError(f"{source} lacks the tables {', '.join(sorted(absent))}")
    return {t: by_name[t.lower()] for t in wanted}
