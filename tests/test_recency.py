"""The newest observations from the newest months."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from fieldlark import KnowledgeGraph
from fieldlark.operators import recency
from tests.conftest import sighting_facts, species_facts, two_species
from tests.test_plans import plan


@pytest.mark.parametrize("limit, keep, want", [
    (1, 1, [202405]), (3, 1, [202405]), (4, 1, [202405, 202403]), (3, 3, [202405, 202403, 202401]), (99, 1, [202405, 202403, 202401, 202312]),
])
def test_months_needed(limit, keep, want):
    counts = {202401: 50, 202405: 3, 202403: 2, 202312: 1}
    asked = []

    def found(months):
        asked.append(months)
        return min(limit, sum(counts[m] for m in months) // keep)

    assert recency.months_needed(counts, limit, found) == want
    assert all(a == want[:len(a)] for a in asked)


@pytest.fixture(scope="module")
def both(spark, triples, tmp_path_factory):
    facts = two_species() + species_facts("none", "Nulla avis", "None", "Ingen", None, "F", "O", "LC")
    for i in range(60):
        day = dt.date(2020, 1, 15) + dt.timedelta(days=31 * i)
        facts += sighting_facts("robi" if i % 9 == 0 else "euwoo1", str(100 + i), str(day) if i % 13 else None, i, 55.0, 12.0, "x")
    plain = KnowledgeGraph(triples(sorted(set(facts), key=repr)))
    folder = str(tmp_path_factory.mktemp("kg") / "g")
    plain.save(folder)
    return plain, KnowledgeGraph.load(spark, folder)


@pytest.mark.parametrize("name, limit", [(None, 1), (None, 7), (None, 500), ("robin", 2), ("robin", 50), ("rouge", 3), ("none", 5), ("zzz", 5)])
def test_same_as_without_months(both, name, limit):
    plain, stored = both
    assert sorted(map(tuple, stored.recent_observations(name, limit=limit).collect()), key=repr) == sorted(
        map(tuple, plain.recent_observations(name, limit=limit).collect()), key=repr)


def test_other_months_are_not_opened(both):
    _, stored = both
    text = plan(stored.recent_observations(limit=2))
    assert any("month" in x and "202" in x for x in re.findall(r"PartitionFilters: \[(.*?)\]\n", text))
    assert len(stored.months) > 50
