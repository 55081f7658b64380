"""Relational primitives over the triple table (s, p, o, o_kind, o_lang, o_datatype)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from fieldlark.model import vocab as v
from fieldlark.model.types import TRIPLE_COLUMNS
from fieldlark.operators.grouping import distinct_rows
from fieldlark.operators.joins import spread_join
from fieldlark.session import cut_lineage


class Fact(NamedTuple):
    """One triple to be made from each row; dropped where subject or object is NULL."""

    subject: Column
    predicate: str
    object: Column
    kind: str = "literal"
    lang: str = ""
    datatype: str = ""


def link(subject: Column, predicate: str, target: Column) -> Fact:
    return Fact(subject, predicate, target, "iri")


def has_type(subject: Column, cls: str) -> Fact:
    # a NULL subject yields no type triple
    return Fact(subject, v.TYPE, F.lit(cls), "iri")


def to_triples(df: DataFrame, facts: list[Fact]) -> DataFrame:
    """Wide rows to triples in one pass over *df*; not yet distinct."""
    rows = [
        F.struct(
            f.subject.alias("s"), F.lit(f.predicate).alias("p"), f.object.cast("string").alias("o"),
            F.lit(f.kind).alias("o_kind"), F.lit(f.lang).alias("o_lang"), F.lit(f.datatype).alias("o_datatype"),
        )
        for f in facts
    ]
    return (
        df.select(F.explode(F.array(*rows)).alias("t"))
        .select(*[F.col(f"t.{c}").alias(c) for c in TRIPLE_COLUMNS])
        .where(F.col("s").isNotNull() & F.col("o").isNotNull())
    )


# -- patterns ---------------------------------------------------------------

def scan(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that match the given positions; a fixed predicate prunes file partitions."""
    for name, value in (("p", p), ("s", s), ("o", o)):
        if value is not None:
            triples = triples.where(F.col(name) == F.lit(value))
    return triples


def pattern(triples: DataFrame, subject: str, predicate: str, obj: str) -> DataFrame:
    """Bindings of ``?subject predicate ?obj`` as a two-column table."""
    return scan(triples, p=predicate).select(F.col("s").alias(subject), F.col("o").alias(obj))


def instances(triples: DataFrame, cls: str, subject: str) -> DataFrame:
    """Bindings of ``?subject a cls``."""
    return scan(triples, p=v.TYPE, o=cls).select(F.col("s").alias(subject)).distinct()


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        raise ValueError("the two sides share no variable")
    return shared


def match_all(*bindings: DataFrame) -> DataFrame:
    """Conjunction of patterns: inner join on the shared variables, left to right.

    Put the pattern with the busiest keys first; its hot keys can be split.
    """
    return reduce(lambda a, b: spread_join(a, b, shared_columns(a, b)), bindings)


class Pattern(NamedTuple):
    """One triple pattern; a text that starts with ``?`` is a variable."""

    subject: str
    predicate: str
    object: str

    @property
    def variables(self) -> list[str]:
        return list(dict.fromkeys(part[1:] for part in (self.subject, self.object) if part.startswith("?")))

    def bindings(self, triples: DataFrame) -> DataFrame:
        """Bindings of the variables; repeated where triples differ in kind, language or data type only."""
        fixed = {name: part for name, part in zip("so", (self.subject, self.object)) if not part.startswith("?")}
        rows = scan(triples, p=self.predicate, **fixed)
        if self.subject == self.object:
            rows = rows.where("s = o")
        named = {part[1:]: F.col(name).alias(part[1:]) for name, part in zip("so", (self.subject, self.object)) if part.startswith("?")}
        return rows.select(*named.values())


def predicate_counts(triples: DataFrame) -> dict[str, int]:
    """Triples per predicate; one number for each predicate of the graph."""
    return {r.p: r["count"] for r in triples.groupBy("p").count().collect()}


def join_tree(patterns: list[Pattern], sizes: list[int]) -> list[tuple[int, int]] | None:
    """(ear, witness) indices in the order in which ears are cut off, the largest first; the last witness is the root.

    An ear shares with the patterns that are left only variables of its witness. None if patterns go round in a circle
    or fall apart.
    """
    left, cut = set(range(len(patterns))), []
    while len(left) > 1:
        found = None
        for ear in sorted(left, key=lambda i: (-sizes[i], i)):
            others = left - {ear}
            shared = set(patterns[ear].variables) & {x for i in others for x in patterns[i].variables}
            witness = [i for i in others if shared and shared <= set(patterns[i].variables)]
            if witness:
                found = ear, min(witness, key=lambda i: (sizes[i], i))
                break
        if found is None:
            return None
        left.discard(found[0])
        cut.append(found)
    return cut


def reduced(bindings: list[DataFrame], tree: list[tuple[int, int]]) -> list[DataFrame]:
    """The bindings without any row that is in no result.

    What the smallest pattern, the root, selects is first handed down the tree, so every table is cut down before it
    is compared with others; semi-joins up the tree and down again then leave rows of results only.
    """
    tables = list(bindings)
    for ear, witness in reversed(tree):
        tables[ear] = cut_lineage(exists(tables[ear], tables[witness]), "reduced")
    for ear, witness in tree:
        tables[witness] = cut_lineage(exists(tables[witness], tables[ear]), "reduced")
    for ear, witness in reversed(tree):
        tables[ear] = cut_lineage(exists(tables[ear], tables[witness]), "reduced")
    return [table.distinct() for table in tables]


def match_patterns(triples: DataFrame, patterns: list[Pattern], counts: dict[str, int] | None = None) -> DataFrame:
    """Distinct bindings of all variables for which every pattern holds.

    The order is chosen from the number of triples per predicate (*counts*, else they are counted). Patterns without
    a circle are first reduced by semi-joins along their join tree, so that the joins that follow shuffle only rows of
    the result; circular ones are joined from the smallest on along shared variables. Patterns must hang together.
    """
    counts = predicate_counts(triples) if counts is None else counts
    # a fixed node selects: such a pattern counts as smaller than any without one
    fixed = [not (p.subject.startswith("?") and p.object.startswith("?")) for p in patterns]
    sizes = [counts.get(p.predicate, 0) // (1 << 20 if f else 1) for p, f in zip(patterns, fixed)]
    tables = [p.bindings(triples) for p in patterns]
    tree = join_tree(patterns, sizes)
    if tree is not None:
        tables = reduced(tables, tree)  # distinct
        order = [tree[-1][1], *[ear for ear, _ in reversed(tree)]] if tree else [0]
    else:
        tables = [table.distinct() for table in tables]
        todo = sorted(range(len(patterns)), key=lambda i: (sizes[i], i))
        order, seen = [todo.pop(0)], set()
        while todo:
            seen |= set(patterns[order[-1]].variables)
            order.append(todo.pop(next((k for k, i in enumerate(todo) if seen & set(patterns[i].variables)), 0)))
    return match_all(*[tables[i] for i in order])


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left outer join on the shared variables; *right* may itself contain optionals."""
    return spread_join(left, right, shared_columns(left, right), "left")


def values(bindings: DataFrame, inline: DataFrame) -> DataFrame:
    """Keep the bindings listed in *inline*."""
    return spread_join(bindings, inline.distinct(), shared_columns(bindings, inline))


def exists(bindings: DataFrame, other: DataFrame) -> DataFrame:
    """Bindings for which *other* has a match. *other* is made distinct before it is joined."""
    on = shared_columns(bindings, other)
    return spread_join(bindings, other.select(*on).distinct(), on, "left_semi")


def not_exists(bindings: DataFrame, other: DataFrame) -> DataFrame:
    on = shared_columns(bindings, other)
    return spread_join(bindings, other.select(*on).distinct(), on, "left_anti")


def top(bindings: DataFrame, n: int, *order: Column) -> DataFrame:
    """Sort and limit; give a total order for a repeatable result."""
    return bindings.orderBy(*order).limit(n)


def count_distinct(bindings: DataFrame, column: str, alias: str = "n") -> DataFrame:
    return bindings.agg(F.count_distinct(column).alias(alias))


def count_by(bindings: DataFrame, *columns: str, alias: str = "n") -> DataFrame:
    return bindings.groupBy(*columns).agg(F.count(F.lit(1)).alias(alias))


def is_canonical(species: Column, vocab: v.Vocab = v.DEFAULT) -> Column:
    """Whether a node was minted here rather than linked through owl:sameAs."""
    return species.startswith(vocab.canonical_species)


def numeric_between(value: Column, low: float, high: float) -> Column:
    """Closed range over a number held as text; text that is no number never matches."""
    return value.try_cast("double").between(low, high)


# -- whole graphs -----------------------------------------------------------

def union_graphs(*graphs: DataFrame) -> DataFrame:
    """Set union of graphs; a table that is given twice is read once."""
    once = {id(graph): graph for graph in graphs}.values()
    return distinct_rows(reduce(lambda a, b: a.unionByName(b), once))


def without(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """The graph without the triples that match the given positions."""
    hit = F.lit(True)
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            hit = hit & (F.col(name) == F.lit(value))
    return triples.where(~hit)


def replace_values(triples: DataFrame, new: DataFrame) -> DataFrame:
    """Drop every (s, p, *) that *new* has a value for, then add *new*."""
    keys = new.select("s", "p").distinct()
    return triples.join(keys, ["s", "p"], "left_anti").unionByName(new).distinct()


def missing_from(triples: DataFrame, new: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """The distinct triples of *new* that the graph does not hold yet.

    *predicates* are those of *new*, where its plan does not show them: only they are read.
    """
    if predicates is not None:
        triples = triples.where(F.col("p").isin(predicates))
    return distinct_rows(new.select(*TRIPLE_COLUMNS)).join(triples, TRIPLE_COLUMNS, "left_anti")


# -- subject-wise views -----------------------------------------------------

def first_value(triples: DataFrame, predicate: str, alias: str) -> DataFrame:
    """One value per subject: the least one, so that the choice is repeatable."""
    return scan(triples, p=predicate).groupBy("s").agg(F.min("o").alias(alias))


def entity_table(triples: DataFrame, columns: dict[str, str], cls: str | None = None) -> DataFrame:
    """One row per subject with a column per predicate (the least value of each).

    A single shuffle on the subject, whatever the number of columns. Ask for the columns
    that are used: every one of them is a predicate to read.
    """
    wanted = list(columns.values())
    keep = F.col("p").isin(wanted)
    if cls is not None:
        keep = keep | ((F.col("p") == v.TYPE) & (F.col("o") == F.lit(cls)))
    picked = [F.min(F.when(F.col("p") == p, F.col("o"))).alias(name) for name, p in columns.items()]
    is_member = F.max(F.col("p") == v.TYPE).alias("_member")
    table = triples.where(keep).groupBy("s").agg(*picked, is_member)
    if cls is not None:
        table = table.where("_member")
    return table.drop("_member")


def merge_records(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """All rows of *right* with the columns of *left* added; on shared columns *right* wins."""
    both = [c for c in left.columns if c in right.columns and c != key]
    renamed = left.select(*[F.col(c).alias(f"_{c}" if c in both else c) for c in left.columns])
    merged = spread_join(right, renamed, key, "left")
    for c in both:
        merged = merged.withColumn(c, F.coalesce(F.col(c), F.col(f"_{c}"))).drop(f"_{c}")
    return merged
