from __future__ import annotations

import pytest

from fieldlark.model import vocab as v
from fieldlark.model.types import TRIPLE
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.session import build_session, small_table


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def iri(s, p, o):
    return (s, p, o, "iri", "", "")


def text(s, p, o, lang="", datatype=""):
    return (s, p, str(o), "literal", lang, datatype)


def species_facts(code, sci, en, da, fr, family, order, status):
    node = V.taxon(f"species/{code}")
    facts = [
        iri(node, v.TYPE, V.term("Species")), text(node, v.SCIENTIFIC_NAME, sci), text(node, V.term("commonNameEn"), en),
        text(node, V.term("commonNameDa"), da, "da"), text(node, V.term("eBirdCode"), code),
        text(node, v.FAMILY, family), text(node, v.ORDER, order), text(node, V.term("conservationStatus"), status),
        iri(node, V.parent_taxon, V.taxon(f"family/{family}")),
        iri(V.taxon(f"family/{family}"), v.TYPE, V.term("Family")),
        text(V.taxon(f"family/{family}"), v.SCIENTIFIC_NAME, family),
        iri(V.taxon(f"family/{family}"), V.parent_taxon, V.taxon(f"order/{order}")),
        iri(V.taxon(f"order/{order}"), v.TYPE, V.term("Order")),
        text(V.taxon(f"order/{order}"), v.SCIENTIFIC_NAME, order),
    ]
    if fr:
        facts.append(text(node, V.term("commonNameFr"), fr, "fr"))
    return facts


def sighting_facts(code, key, date, count, lat, lon, locality):
    node, obs, loc = V.taxon(f"species/{code}"), V.observation(key), V.location(key)
    facts = [
        iri(node, V.has_observation, obs), iri(obs, v.TYPE, V.term("Observation")),
        iri(obs, V.term("observedAt"), loc), iri(loc, v.TYPE, V.term("Location")),
        text(loc, V.term("latitude"), lat, datatype=v.DECIMAL), text(loc, V.term("longitude"), lon, datatype=v.DECIMAL),
        text(loc, V.term("locality"), locality),
    ]
    if date:
        facts.append(text(obs, V.term("observedOn"), date, datatype=v.DATE))
    if count is not None:
        facts.append(text(obs, V.term("individualCount"), count, datatype=v.INTEGER))
    return facts


def two_species():
    """A robin seen in Copenhagen and a woodpecker seen in Aarhus."""
    return [
        *species_facts("robi", "Erithacus rubecula", "European Robin", "Rødhals", "Rouge-gorge familier",
                       "Muscicapidae", "Passeriformes", "LC"),
        *species_facts("euwoo1", "Dendrocopos major", "Great Spotted Woodpecker", "Stor Flagspætte", None,
                       "Picidae", "Piciformes", "LC"),
        *sighting_facts("robi", "1", "2024-04-10", 2, 55.694, 12.554, "Nørrebro, Copenhagen"),
        *sighting_facts("euwoo1", "2", "2024-03-20", 1, 56.163, 10.204, "Aarhus"),
    ]


@pytest.fixture(scope="session")
def triples(spark):
    def make(rows):
        return small_table(spark, rows, TRIPLE)
    return make


def rows(df, *columns):
    """Rows as a sorted list of tuples (or of values for one column)."""
    picked = df.select(*columns) if columns else df
    out = [tuple(r) for r in picked.collect()]
    return sorted((r[0] if len(r) == 1 else r for r in out), key=repr)
