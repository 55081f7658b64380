"""Month sets and migration classes.

A set of months is held as a bit mask (bit m for month m). ``bit_or`` over it is
a fixed-width aggregate: it combines map-side in a code-generated hash
aggregate, where a collected set would need an object buffer per group.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from fieldlark.functions.status import lookup

# fixed values: core months and the coverage from which a species is resident
SUMMER = [5, 6, 7]
WINTER = [12, 1, 2]
RESIDENT_MONTHS = 9

# fixed values: months in which a migration class is expected
PRESENT_MONTHS = {
    "SummerVisitor": [4, 5, 6, 7, 8, 9],
    "WinterVisitor": [10, 11, 12, 1, 2, 3],
    "PassageMigrant": [3, 4, 5, 9, 10],
}

# fixed values: display labels
LABEL = {
    "Resident": "🏠 Resident",
    "SummerVisitor": "☀️  Summer visitor",
    "WinterVisitor": "❄️  Winter visitor",
    "PassageMigrant": "🌊 Passage migrant",
    "PartialMigrant": "↔️  Partial migrant",
    "Unknown": "❓ Unknown",
}


def _mask(months: list[int]) -> int:
    return sum(1 << m for m in months)


def month_bit(month: Column) -> Column:
    # shiftleft takes a literal distance only, so the twelve bits are a lookup
    return F.get(F.array(*[F.lit(1 << m) for m in range(13)]), month)


def month_mask(date: Column) -> Column:
    """Aggregate: the set of months in which *date* falls, as a mask."""
    return F.bit_or(month_bit(F.month(date)))


def mask_months(mask: Column) -> Column:
    """The months of a mask as an ascending array."""
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(1 << m) != 0, F.lit(m)) for m in range(1, 13)]))


def months_mask(months: Column) -> Column:
    """Mask of an array of months."""
    return F.aggregate(months, F.lit(0), lambda acc, m: acc.bitwiseOR(month_bit(m)))


def migration_class(mask: Column) -> Column:
    mask = F.coalesce(mask, F.lit(0))
    summer = mask.bitwiseAND(_mask(SUMMER)) != 0
    winter = mask.bitwiseAND(_mask(WINTER)) != 0
    return (
        F.when(mask == 0, "Unknown")
        .when(F.bit_count(mask) >= RESIDENT_MONTHS, "Resident")
        .when(summer & winter, "PartialMigrant")
        .when(summer, "SummerVisitor")
        .when(winter, "WinterVisitor")
        .otherwise("PassageMigrant")
    )


def is_likely_present(status: Column, month: Column) -> Column:
    """Whether a class is expected in *month*; classes without a season always are."""
    expected = F.lit(None).cast("boolean")
    for name, months in PRESENT_MONTHS.items():
        expected = F.when(status == name, month.isin(months)).otherwise(expected)
    return F.coalesce(expected, F.lit(True))


def migration_label(status: Column) -> Column:
    return F.coalesce(lookup(status, LABEL), status)


def month_of_text(date_text: Column) -> Column:
    """Month of an ISO date held as text, NULL when the text is not one."""
    return F.month(date_text.try_cast("date"))
