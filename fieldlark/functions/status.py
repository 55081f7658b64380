"""Red List codes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# fixed values: rank of a code, most threatened first
RANK = {"CR": 0, "EN": 1, "VU": 2, "NT": 3, "LC": 4, "DD": 5, "NE": 6}
UNRANKED = 999
THREATENED = ["CR", "EN", "VU", "NT"]

# fixed values: display names
LABEL = {
    "EX": "Extinct",
    "EW": "Extinct in the Wild",
    "CR": "Critically Endangered",
    "EN": "Endangered",
    "VU": "Vulnerable",
    "NT": "Near Threatened",
    "LC": "Least Concern",
    "DD": "Data Deficient",
    "NE": "Not Evaluated",
}


def lookup(key: Column, table: dict) -> Column:
    """Value of *key* in a small constant table, NULL when it is not there."""
    entries = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(entries, key)


def status_rank(status: Column) -> Column:
    return F.coalesce(lookup(status, RANK), F.lit(UNRANKED))


def status_of_rank(rank: Column) -> Column:
    return lookup(rank, {rank_: code for code, rank_ in RANK.items()})


def status_label(status: Column) -> Column:
    return lookup(status, LABEL)


def is_threatened(status: Column) -> Column:
    return status.isin(THREATENED)


def clean_status(raw: Column) -> Column:
    """Upper-case, trimmed, and NULL unless it is one of the ranked codes."""
    code = F.upper(F.trim(raw))
    return F.when(code.isin(list(RANK)), code)
