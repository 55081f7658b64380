"""Changes of a reasoned graph against a full run over the changed triples."""

from __future__ import annotations

import random

import pytest

from fieldlark.model import vocab as v
from fieldlark.model.ontology import ontology_triples
from fieldlark.model.types import TRIPLE, TRIPLE_COLUMNS
from fieldlark.model.vocab import DEFAULT as V
from fieldlark.operators import joins
from fieldlark.plans.incremental import load_parts, save_parts, update
from fieldlark.plans.reasoning import run_reasoner
from tests.conftest import iri, sighting_facts, text, two_species


def graph(spark, rows):
    return spark.createDataFrame(sorted(set(rows)), TRIPLE)


def sets(parts):
    return [sorted(tuple(r) for r in part.select(*TRIPLE_COLUMNS).collect()) for part in parts]


@pytest.fixture(scope="module")
def base(spark):
    """Rows of a small graph, and its reasoned parts."""
    rows = [
        *[tuple(r) for r in ontology_triples(spark, V).select(*TRIPLE_COLUMNS).collect()], *two_species(),
        *chain("a", "b", "c", "d"), *chain("b", "x", "d"), *chain("p", "q"),
        same("robi", "http://x/robi"), same("euwoo1", "http://x/hub"), same("robi", "http://x/hub"),
        text("http://x/hub", V.term("habitat"), "forest"),
    ]
    return rows, run_reasoner(graph(spark, rows), V).parts


def chain(*names):
    return [iri(V.taxon(a), V.parent_taxon, V.taxon(b)) for a, b in zip(names, names[1:])]


def same(code, other):
    return iri(V.taxon(f"species/{code}"), v.SAME_AS, other)


ROBI, WOOD = V.taxon("species/robi"), V.taxon("species/euwoo1")
CHANGES = {
    "nothing": ([], []),
    "links that join two chains": ([*chain("d", "p"), *chain("q", "z")], []),
    "a cycle": (chain("d", "a"), []),
    "a link with another way round": ([], chain("b", "c")),
    "a link without": ([], chain("a", "b")),
    "a link that stays inferred": (chain("a", "c"), []),
    "an asserted one that is inferred too": (chain("a", "c"), chain("c", "d")),
    "sightings": (sighting_facts("robi", "9", "2024-07-01", 1, 55.0, 12.0, "x"), []),
    "a date less": ([], [text(V.observation("1"), V.term("observedOn"), "2024-04-10", datatype=v.DATE)]),
    "a status": ([text(ROBI, V.term("migrationStatus"), "Resident")], []),
    "a month that stays inferred": ([text(ROBI, V.term("typicallyPresentInMonth"), "4", datatype=v.INTEGER)], []),
    "a type less": ([], [iri(WOOD, v.TYPE, V.term("Species"))]),
    "a property less": ([], [text(ROBI, V.term("eBirdCode"), "robi")]),
    "a same-as link": ([same("euwoo1", "http://x/new")], []),
    "a same-as link less": ([], [same("robi", "http://x/hub")]),
    "a shared value less": ([], [text("http://x/hub", V.term("habitat"), "forest")]),
    "a subclass": ([iri(V.term("Taxon"), v.SUBCLASS_OF, V.term("Thing"))], []),
    "a subclass less": ([], [iri(V.term("Species"), v.SUBCLASS_OF, V.term("Taxon"))]),
    "a lesser domain": ([iri(V.term("habitat"), v.DOMAIN, V.term("Area"))], []),
    "a domain less": ([], [iri(V.term("latitude"), v.DOMAIN, V.term("Location"))]),
    "both at once": ([same("robi", "http://x/z"), *chain("x", "y")], [same("robi", "http://x/robi"), *chain("x", "d")]),
    "not there, there already": (chain("a", "b"), chain("no", "such")),
}


GROUPS = [
    ["links that join two chains", "a link with another way round", "sightings", "a date less", "a shared value less", "nothing"],
    ["a same-as link less", "a lesser domain", "a subclass", "a month that stays inferred", "a link that stays inferred", "both at once"],
    ["a domain less", "a subclass less", "a type less", "an asserted one that is inferred too", "a status", "a property less",
     "a same-as link", "a link without", "a cycle", "not there, there already"],
]


@pytest.mark.parametrize("names", GROUPS, ids=["first", "second", "third"])
def test_a_change_equals_a_full_run(spark, base, names):
    """Part by part, and what is reported as changed."""
    rows, parts = base
    added = {t for name in names for t in CHANGES[name][0]}
    removed = {t for name in names for t in CHANGES[name][1]}
    got = update(parts, graph(spark, added), graph(spark, removed), V)
    want = sets(run_reasoner(graph(spark, (set(rows) - removed) | added), V).parts)
    assert sets(got.parts) == want
    assert [tuple(r) for r in got.changes.orderBy("step").select("n_gone", "n_new").collect()] == [
        (len(set(a) - set(b)), len(set(b) - set(a))) for a, b in zip(sets(parts), want)]


def test_what_is_removed_and_added_stays(spark, base):
    rows, parts = base
    same_one = graph(spark, chain("a", "b"))
    got = update(parts, same_one, same_one, V)
    assert got.changes.where("n_gone > 0 or n_new > 0").isEmpty() and sets(got.parts)[0] == sorted(set(rows))


def test_changes_one_after_another_and_stored_parts(spark, base, tmp_path):
    rows, parts = base
    draw, now = random.Random(3), set(rows)
    pool = sorted(set(rows) | set(chain("d", "p", "a")) | {same("robi", "http://x/q"), same("euwoo1", "http://x/robi")})
    for step in range(2):
        added, removed = draw.sample(pool, 5), draw.sample(sorted(now), 6)
        parts = update(parts, graph(spark, added), graph(spark, removed), V).parts
        now = (now - set(removed)) | set(added)
        save_parts(parts, str(tmp_path / f"{step}"))
        parts = load_parts(spark, str(tmp_path / f"{step}"))
    assert sets(parts) == sets(run_reasoner(graph(spark, now), V).parts)


def test_the_graph_is_not_shuffled(spark, base, tmp_path):
    """What is read of the graph is joined with the change where it is scanned."""
    _, parts = base
    save_parts(parts, str(tmp_path / "g"))
    stored = load_parts(spark, str(tmp_path / "g"))
    got = update(stored, graph(spark, chain("d", "p")), graph(spark, [same("robi", "http://x/hub")]), V)
    plan = got.triples._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_a_change_of_many_rows(spark, base, monkeypatch):
    """With no table few enough to be sent: every join of the change goes by filter and shuffle."""
    monkeypatch.setattr(joins, "SENT_ROWS", 0)
    rows, _ = base
    added, removed = [*chain("d", "p"), same("robi", "http://x/new")], [*chain("a", "b"), same("euwoo1", "http://x/hub")]
    less = [r for r in rows if r not in set(added)]
    updated = update(run_reasoner(graph(spark, less), V).parts, graph(spark, added), graph(spark, removed), V)
    fresh = run_reasoner(graph(spark, [r for r in {*less, *added} if r not in set(removed)]), V)
    assert sets(updated.parts) == sets(fresh.parts)


def test_only_predicates_of_the_change_are_compared(spark, base, tmp_path):
    """Triples of other predicates are passed on, and what types nothing in doubt is not read."""
    from pyspark.sql import functions as F
    from fieldlark.plans import incremental

    _, parts = base
    gone = incremental.cut_lineage(parts[0].where(F.col("p") == v.SAME_AS).limit(1), "gone")
    rest = incremental.without(parts[0], gone)
    assert sorted(map(tuple, rest.collect())) == sorted(set(map(tuple, parts[0].collect())) - set(map(tuple, gone.collect())))
    plan = rest._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]  # the executed one only
    assert "Union" in plan and plan.count("LeftAnti") == 1
    table = spark.createDataFrame([("seen", "Observation"), ("named", "Taxon"), ("above", "Taxon")], "p string, domain string")
    doubt = spark.createDataFrame([("a", "Taxon"), ("b", "Genus")], "s string, o string")
    used = spark.createDataFrame([("x", "seen"), ("y", "named"), ("z", "above")], "s string, p string")
    assert sorted(r.s for r in used.where(incremental.terms(table, "p", "domain", doubt)).collect()) == ["y", "z"]
