"""Whole-graph plans: build from landed files, enrich, and the query facade."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from fieldlark.model import vocab as v
from fieldlark.model.ontology import ontology_triples
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.functions import curve
from fieldlark.operators import enrichment, extracts, intervals, queries, recency, trigrams
from fieldlark.operators.grouping import distinct_rows
from fieldlark.operators.inference import parent_edges
from fieldlark.operators.occurrences import capped_newest_first, occurrence_triples
from fieldlark.operators.taxonomy import localized_name_triples, name_index, species_nodes, taxonomy_facts
from fieldlark.operators.triples import entity_table, instances, optional, pattern, scan, union_graphs
from fieldlark.sources import graph_files


def species_predicates(vocab: Vocab = DEFAULT) -> dict[str, str]:
    """Columns of the species table and the predicates they are read from."""
    return {
        "scientific_name": v.SCIENTIFIC_NAME,
        "common_name_en": vocab.term("commonNameEn"),
        "common_name_da": vocab.term("commonNameDa"),
        "common_name_fr": vocab.term("commonNameFr"),
        "ebird_code": vocab.term("eBirdCode"),
        "family": v.FAMILY,
        "order_name": v.ORDER,
        "thumbnail": vocab.term("thumbnailUrl"),
        "range_map": vocab.term("rangeMapUrl"),
        "mass_grams": vocab.term("massGrams"),
        "wingspan_mm": vocab.term("wingspanMm"),
        "status": vocab.term("conservationStatus"),
        "migration_status": vocab.term("migrationStatus"),
    }


def species_table(triples: DataFrame, vocab: Vocab = DEFAULT, columns: list[str] | None = None) -> DataFrame:
    """Typed species rows of a graph; an attribute with several values shows the least.

    *columns* are those wanted; only their predicates are read.
    """
    predicates = species_predicates(vocab)
    wanted = {c: predicates[c] for c in (predicates if columns is None else columns)}
    table = entity_table(triples, wanted, vocab.term("Species"))
    numbers = {c: F.col(c).try_cast("double") for c in ("mass_grams", "wingspan_mm") if c in wanted}
    return table.withColumnRenamed("s", "species").withColumns(numbers)


def searchable_names(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Every name of every species, several per language where there are, with its folded forms."""
    kinds = {p: c for c, p in species_predicates(vocab).items() if c in queries.NAMES}
    kind = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    names = triples.where(F.col("p").isin(list(kinds))).select(
        F.col("s").alias("species"), F.element_at(kind, F.col("p")).alias("kind"), F.col("o").alias("name")).distinct()
    return queries.name_table(names.join(instances(triples, vocab.term("Species"), "species"), "species", "left_semi"))


def rank_table(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """(species, rank, value) of all families and orders a species is given, with the value in lower case."""
    rank = F.when(F.col("p") == v.FAMILY, "family").otherwise("order_name")
    return triples.where(F.col("p").isin(v.FAMILY, v.ORDER)).select(
        F.col("s").alias("species"), rank.alias("rank"), F.col("o").alias("value"), F.lower("o").alias("lower")).distinct()


def with_rank(species: DataFrame, ranks: DataFrame, rank: str, part: str) -> DataFrame:
    """Species one of whose families (or orders) contains *part*, with that value in the column *rank*."""
    hits = ranks.where((F.col("rank") == rank) & F.col("lower").contains(F.lower(F.lit(part))))
    return species.drop(rank).join(hits.groupBy("species").agg(F.min("value").alias(rank)), "species")


def species_names(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Every (species, scientific_name) pair of a graph."""
    return pattern(triples, "species", v.SCIENTIFIC_NAME, "scientific_name").join(
        instances(triples, vocab.term("Species"), "species"), "species", "left_semi")


def habitat_table(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    return pattern(triples, "species", vocab.term("habitat"), "habitat")


def month_table(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    months = pattern(triples, "species", vocab.term("typicallyPresentInMonth"), "month")
    return months.withColumn("month", F.col("month").try_cast("int"))


def observation_table(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Typed observation rows of a graph, one per (species, observation) link.

    Details and places are gathered with one shuffle each before they are joined. A task reads few of the values of
    one observation or place, so the values are shuffled as they are: picking some before would only sort them.
    """
    def gathered(columns: dict[str, str], key: str) -> DataFrame:
        wanted = triples.where(F.col("p").isin(list(columns.values()))).repartition("s")
        return entity_table(wanted, columns).withColumnRenamed("s", key)

    links = distinct_rows(pattern(triples, "species", vocab.has_observation, "obs_id"))
    details = gathered({
        "observed_on": vocab.term("observedOn"), "individual_count": vocab.term("individualCount"),
        "loc_id": vocab.term("observedAt")}, "obs_id")
    places = gathered({
        "lat": vocab.term("latitude"), "lon": vocab.term("longitude"), "locality": vocab.term("locality")}, "loc_id")
    rows = optional(links, optional(details, places))
    return rows.select(
        "obs_id", "species", F.substring("observed_on", 1, 10).try_cast("date").alias("observed_on"),
        F.col("individual_count").try_cast("bigint").alias("individual_count"), "loc_id",
        F.col("lat").try_cast("double").alias("lat"), F.col("lon").try_cast("double").alias("lon"), "locality")


def taxon_table(triples: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Taxa as nested intervals over the direct parent links; a graph whose links were closed gives the same table."""
    return intervals.interval_labels(intervals.direct_edges(parent_edges(triples, vocab))).labels


def build_graph(
    taxonomy: DataFrame, localized: dict[str, DataFrame], occurrences: DataFrame,
    max_records: int | None = None, vocab: Vocab = DEFAULT,
) -> DataFrame:
    """Ontology, taxonomy, localized names and occurrences as one set of triples.

    All occurrences are taken, unless *max_records* asks for the newest ones only.
    """
    names = [localized_name_triples(rows, locale, vocab) for locale, rows in localized.items()]
    index = name_index(species_nodes(taxonomy, vocab))
    sample = occurrences if max_records is None else capped_newest_first(occurrences, max_records)
    return union_graphs(
        ontology_triples(taxonomy.sparkSession, vocab), taxonomy_facts(taxonomy, "en", vocab), *names,
        occurrence_triples(sample, index, vocab))


def enrich_with_traits(triples: DataFrame, bindings: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Triples offered by trait bindings for the species of a graph."""
    index = name_index(species_names(triples, vocab))
    return enrichment.trait_triples(
        enrichment.fold_traits(bindings), enrichment.trait_values(bindings), index, vocab)


def enrich_with_pictures(triples: DataFrame, bindings: DataFrame, vocab: Vocab = DEFAULT) -> DataFrame:
    """Triples offered by picture bindings, matched through the slug of the English name."""
    slugs = enrichment.slug_index(enrichment.name_pairs(triples, vocab))
    index = name_index(species_names(triples, vocab))
    return enrichment.picture_triples(enrichment.fold_pictures(bindings, slugs), index, vocab)


def enrich_with_assessments(
    triples: DataFrame, lookups: DataFrame, assessments: DataFrame, limit: int = 0, vocab: Vocab = DEFAULT,
) -> DataFrame:
    """Triples offered by Red List assessments; *limit* keeps the first names only, 0 all."""
    index = name_index(species_names(triples, vocab))
    wanted = enrichment.first_names(index, limit).select(F.col("scientific_name").alias("name"))
    chosen = enrichment.latest_assessment(lookups.join(wanted, "name", "left_semi"))
    named = enrichment.flatten_assessment(assessments).join(chosen, "assessment_id", "inner")
    return enrichment.assessment_triples(named, index, vocab)


@dataclass(frozen=True)
class KnowledgeGraph:
    """A graph and its query catalogue. Every method returns a lazy DataFrame.

    ``save`` stores typed tables beside the triples; a graph that was loaded with them
    answers queries from their files. Otherwise they are derived from the triples.
    """

    triples: DataFrame
    vocab: Vocab = field(default=DEFAULT)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    index: trigrams.TrigramIndex | None = None
    months: dict[int, int] = field(default_factory=dict)  # stored observations of each month
    is_distinct: bool = False  # no triple is there twice, so that saving need not look for copies

    @classmethod
    def load(
        cls, spark: SparkSession, path: str, vocab: Vocab = DEFAULT, form: str = "saved", strict: bool = True,
        tables: Iterable[str] | None = None,
    ) -> KnowledgeGraph:
        """Graph of a folder. *form* says what the folder holds: ``saved`` (by ``save``), ``parquet`` (triples by
        predicate, by ``write_graph``) or ``ntriples``; lines that do not parse are an error unless *strict* is off.
        *tables* are the typed tables that were saved, if not all were; others are derived from the triples."""
        if form == "ntriples":
            return cls(graph_files.read_ntriples(spark, path, strict), vocab, is_distinct=True)
        if form == "parquet":
            return cls(graph_files.read_graph(spark, path), vocab)
        if form != "saved":
            raise ValueError(f"no such form of a graph: {form}")
        wanted = _known(tables)
        triples = graph_files.read_graph(spark, f"{path}/triples")
        index = trigrams.TrigramIndex.load(spark, path) if "names" in wanted else None
        opened = {name: spark.read.parquet(f"{path}/{name}") for name in wanted - {"names", "species", "observations"}}
        # a table by bucket or month may have no file to read the schema from
        by_bucket = T.StructType([*species_table(triples, vocab).schema.fields, T.StructField("bucket", T.IntegerType())])
        by_month = T.StructType([*observation_table(triples, vocab).schema.fields, T.StructField("cell", T.LongType()),
                                 T.StructField("month", T.IntegerType())])
        months: dict[int, int] = {}
        if index is not None:
            opened["names"] = index.names
        if "species" in wanted:
            opened["species"] = spark.read.schema(by_bucket).parquet(f"{path}/species")
        if "observations" in wanted:
            opened["observations"] = spark.read.schema(by_month).parquet(f"{path}/observations")
            months = {r.month: r.n for r in recency.read_counts(spark, path).collect()}  # one number a month
        return cls(triples, vocab, opened, index, months, is_distinct=True)

    def save(self, path: str, tables: Iterable[str] | None = None) -> None:
        """Write the triples by predicate, the typed tables that the queries read, and the index of names.

        The triples are written first and the tables derived from the files; *tables* names those to write, else all.
        """
        graph_files.write_graph(self.triples, f"{path}/triples", self.is_distinct)
        stored = graph_files.read_graph(self.triples.sparkSession, f"{path}/triples")
        KnowledgeGraph(stored, self.vocab).save_tables(path, tables)

    def save_tables(self, path: str, tables: Iterable[str] | None = None) -> None:
        """Write typed tables, all or these, to new folders beside the triples.

        Observations lie in a folder per month, so that the newest are read alone, and are ordered along a curve
        through the places, so that a search around a point skips row groups on both axes; taxa in the order of their
        intervals; species and names by bucket, which is what a name search looks up.
        """
        wanted = _known(tables)
        if wanted & {"names", "species"}:  # both by the same buckets, whichever is written first
            species = instances(self.triples, self.vocab.term("Species"), "species").count()
            buckets = trigrams.bucket_count(len(queries.NAMES) * species)
        if "names" in wanted:
            trigrams.write_index(self.table("names"), path, buckets)
        if "species" in wanted:
            trigrams.write_by_bucket(self.table("species"), buckets, ["family", "species"], f"{path}/species")
        if "observations" in wanted:
            recency.write_by_month(
                self.table("observations").withColumn("cell", curve.z_key(F.col("lat"), F.col("lon"))), ["cell", "obs_id"], path)
        for name in wanted - {"names", "species", "observations"}:
            table = self.table(name)
            table = table.repartitionByRange("lo").sortWithinPartitions("lo") if name == "taxa" else table
            table.write.parquet(f"{path}/{name}")

    def table(self, name: str) -> DataFrame:
        """A typed table, stored or derived: species, observations, names, ranks, habitats, months or taxa."""
        return self.tables[name] if name in self.tables else TABLES[name](self.triples, self.vocab)

    def add(self, *graphs: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(union_graphs(self.triples, *graphs), self.vocab)

    def species(self, *columns: str) -> DataFrame:
        """Species with the given attributes, or all."""
        if "species" in self.tables or not columns:
            table = self.table("species").drop("bucket")
            return table.select("species", *columns) if columns else table
        return species_table(self.triples, self.vocab, list(columns))

    def observations(self) -> DataFrame:
        return self.table("observations")

    def find_species_by_name(self, name: str, fold: str = "compat", limit: int | None = None) -> DataFrame:
        return queries.find_species_by_name(
            self.table("species"), self.table("habitats"), name, fold, limit, self.table("names"), self._found(name, fold))

    def _found(self, name: str | None, fold: str = "compat", kinds: list[str] | None = None) -> trigrams.Found | None:
        """What the stored index finds for a name; None without an index."""
        return self.index.find(name, fold, kinds) if self.index is not None and name else None

    def list_observed_species(self) -> DataFrame:
        links = pattern(self.triples, "species", self.vocab.has_observation, "obs_id")
        return queries.list_observed_species(self.species(*queries.NAMES), links, self.vocab)

    list_danish_species = list_observed_species

    def species_by_family(self, family: str) -> DataFrame:
        """Species one of whose families contains *family*."""
        columns = ["scientific_name", "common_name_en", "common_name_da", "ebird_code", "thumbnail"]
        found = with_rank(self.species(*columns), self.table("ranks"), "family", family)
        return queries.species_by_family(found, family)

    def species_by_order(self, order: str) -> DataFrame:
        """Species one of whose orders contains *order*."""
        columns = ["scientific_name", "common_name_en", "family"]
        found = with_rank(self.species(*columns), self.table("ranks"), "order_name", order)
        return queries.species_by_order(found, order)

    def recent_observations(self, name: str | None = None, fold: str = "compat", limit: int | None = None) -> DataFrame:
        """The newest observations; with a limit and stored months, of as many of the newest months as it takes."""
        species, found = self.species(*queries.NAMES), self._found(name, fold)

        def newest(observations: DataFrame) -> DataFrame:
            return queries.recent_observations(
                species, observations, name, fold, limit, self.vocab, self.table("names"), found)

        if limit is None or not self.months:
            return newest(self.observations())
        wanted = recency.months_needed(
            self.months, limit, lambda months: newest(recency.of_months(self.observations(), months)).count())
        return newest(recency.of_months(self.observations(), wanted))

    recent_danish_observations = recent_observations

    def nearby_watch(self, **place: float) -> DataFrame:
        return queries.nearby_watch(
            self.species(*queries.NAMES, "status"), self.observations(), vocab=self.vocab, **place)

    def currently_present(self, month: int | None = None) -> DataFrame:
        columns = [*queries.NAMES, "ebird_code", "status", "migration_status"]
        return queries.currently_present(self.species(*columns), self.table("months"), month, self.vocab)

    def observations_for_map(
        self, species_filter: str | None = None, family_filter: str | None = None, order_filter: str | None = None,
        ordered: bool = True,
    ) -> DataFrame:
        species = self.species(*queries.NAMES, "status")
        for rank, part in (("family", family_filter), ("order_name", order_filter)):
            if part:
                species = with_rank(species, self.table("ranks"), rank, part)
        return queries.observations_for_map(
            species, self.observations(), species_filter, vocab=self.vocab, ordered=ordered, names=self.table("names"),
            found=self._found(species_filter, "full", queries.MAP_NAMES))

    def taxonomy_summary(self) -> DataFrame:
        types = scan(self.triples, p=v.TYPE).select("s", F.col("o").alias("class"))
        return queries.taxonomy_summary(types, self.vocab)

    def taxonomy_network(
        self, family_filter: str | None = None, order_filter: str | None = None) -> tuple[DataFrame, DataFrame]:
        """Node and edge tables of the taxonomy of observed species."""
        links = pattern(self.triples, "species", self.vocab.has_observation, "obs_id")
        kept = extracts.network_species(self.species(), links, family_filter, order_filter)
        edges = extracts.network_edges_of(self.triples, kept, self.vocab)
        return extracts.taxonomy_nodes(kept, edges, self.triples, self.vocab), edges

    def taxa_below(self, taxon: str) -> DataFrame:
        """Everything below a taxon, by one range filter on the stored intervals."""
        taxa = self.table("taxa")
        return intervals.below(taxa, intervals.interval_of(taxa, taxon))

    def ancestors(self, taxon: str) -> DataFrame:
        """What a taxon belongs to, the highest first."""
        taxa = self.table("taxa")
        return intervals.above(taxa, intervals.interval_of(taxa, taxon)).orderBy("depth")

    def observed_below(self) -> DataFrame:
        """Taxa with the number of observed species at or below each (``n_below``)."""
        links = pattern(self.triples, "node", self.vocab.has_observation, "obs_id")
        return intervals.counts_below(self.table("taxa"), links)

    def capped(self, rows: DataFrame, order: list[Column], limit: int = extracts.RESULT_LIMIT) -> DataFrame:
        return extracts.result_text(extracts.result_cap(rows, order, limit))


# typed tables that are stored with a graph
TABLES = {
    "species": species_table,
    "observations": observation_table,
    "names": searchable_names,
    "ranks": rank_table,
    "habitats": habitat_table,
    "months": month_table,
    "taxa": taxon_table,
}


def _known(tables: Iterable[str] | None) -> set[str]:
    """These tables, or all; an error for a name that no table has."""
    wanted = set(TABLES if tables is None else tables)
    if wanted - TABLES.keys():
        raise ValueError(f"no such tables: {sorted(wanted - TABLES.keys())}")
    return wanted
