"""Sort orders of the ranked table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import STANDARD_ORDER

# A leading number as a browser's number parser reads it.
_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def standard_order(
    lead: str | None = None, ascending: bool = True, tiebreak: Sequence[str] = ("id",)
) -> list[Column]:
    """The standard order, optionally led by one column; nulls always come last."""
    rest = [F.col(c).desc_nulls_last() for c in STANDARD_ORDER if c != lead]
    if lead is not None:
        first = F.col(lead)
        rest.insert(0, first.asc_nulls_last() if ascending else first.desc_nulls_last())
    return rest + [F.col(c).asc_nulls_last() for c in tiebreak]


LOCALE = "UNICODE"  # the root collation, in which accents and case decide last


def typed_keys(
    levels: Sequence[tuple[str, bool]], fold_case: bool = True, collation: str = LOCALE
) -> list[tuple[str, Column, bool]]:
    """The keys of ``typed_order``, most significant first: (a name to store it by, value, ascending)."""
    keys = []
    for name, ascending in levels:
        text = F.trim(F.col(name).cast("string"))
        number = F.regexp_extract(text, _NUMBER, 1).try_cast("double")
        sorted_as = F.collate(F.lower(text) if fold_case else text, collation)
        kind = F.when(number.isNotNull(), 1).when(sorted_as < F.collate(F.lit("0"), collation), 0)
        kind = F.when(text.isNotNull(), F.coalesce(kind, F.lit(2)))
        for part, key in (("kind", kind), ("number", number), ("text", F.when(number.isNull(), sorted_as))):
            keys.append((f"_{name}_{part}", key, ascending))
    return keys


def _directed(key: Column, ascending: bool) -> Column:
    return key.asc_nulls_last() if ascending else key.desc_nulls_last()


def typed_order(levels: Sequence[tuple[str, bool]], fold_case: bool = True, collation: str = LOCALE) -> list[Column]:
    """Multi-level order of text cells: numbers by value, texts as the locale sorts them.

    Two cells that start with a number compare by it and are equal if it is equal, whatever follows. Any other
    two compare as texts, so numbers stand after texts that start with a sign and before those that start with
    a letter. Nulls come last.
    """
    return [_directed(key, ascending) for _, key, ascending in typed_keys(levels, fold_case, collation)]


def stored_order(
    df: DataFrame, levels: Sequence[tuple[str, bool]], fold_case: bool = True, collation: str = LOCALE
) -> tuple[DataFrame, list[Column]]:
    """The rows with the keys of ``typed_order`` as columns, and the order by them.

    A sort evaluates its expressions at every comparison; stored keys are computed once a row.
    """
    keys = typed_keys(levels, fold_case, collation)
    return df.withColumns({name: key for name, key, _ in keys}), [_directed(F.col(name), up) for name, _, up in keys]


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of an order, without sorting the whole table."""
    return df.orderBy(*order).limit(n)
