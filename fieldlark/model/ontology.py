"""The ontology as small tables and as triples.

These are the only tables in the library that are broadcast by hint: their size
is fixed by the text below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlark.model import vocab as v
from fieldlark.model.types import TRIPLE
from fieldlark.model.vocab import DEFAULT, Vocab
from fieldlark.session import small_table

# fixed values: classes with their superclass ('' for none)
CLASSES = [
    ("Taxon", "", "Any taxonomic unit."),
    ("Order", "Taxon", "A group of related families."),
    ("Family", "Taxon", "A group of related genera."),
    ("Genus", "Taxon", "A group of closely related species."),
    ("Species", "Taxon", "A single species."),
    ("Observation", "", "One sighting of a species at a place and time."),
    ("Location", "", "The point at which a sighting was made."),
]

# fixed values: property, domain, range
OBJECT_PROPERTIES = [
    ("parentTaxon", "Taxon", "Taxon"),
    ("hasObservation", "Species", "Observation"),
    ("observedAt", "Observation", "Location"),
]
DATATYPE_PROPERTIES = [
    ("eBirdCode", "Species", "string"),
    ("gbifKey", "Taxon", "integer"),
    ("taxonOrder", "Taxon", "decimal"),
    ("dwc:scientificName", "Taxon", "string"),
    ("dwc:order", "Taxon", "string"),
    ("dwc:family", "Taxon", "string"),
    ("dwc:genus", "Taxon", "string"),
    ("commonNameEn", "Taxon", "string"),
    ("commonNameDa", "Taxon", "string"),
    ("commonNameFr", "Taxon", "string"),
    ("conservationStatus", "Species", "string"),
    ("migrationStatus", "Species", "string"),
    ("typicallyPresentInMonth", "Species", "integer"),
    ("massGrams", "Species", "decimal"),
    ("wingspanMm", "Species", "decimal"),
    ("habitat", "Species", "string"),
    ("range", "Species", "string"),
    ("dielCycle", "Species", "string"),
    ("thumbnailUrl", "Species", "anyURI"),
    ("rangeMapUrl", "Species", "anyURI"),
    ("iucnCategory", "Species", "string"),
    ("populationTrend", "Species", "string"),
    ("iucnHabitat", "Species", "string"),
    ("threat", "Species", "string"),
    ("movementPattern", "Species", "string"),
    ("system", "Species", "string"),
    ("observedOn", "Observation", "date"),
    ("individualCount", "Observation", "integer"),
    ("recordedBy", "Observation", "string"),
    ("latitude", "Location", "decimal"),
    ("longitude", "Location", "decimal"),
    ("locality", "Location", "string"),
]


def property_iri(name: str, vocab: Vocab) -> str:
    return v.DWC + name[4:] if name.startswith("dwc:") else vocab.term(name)


def classes(spark: SparkSession, vocab: Vocab = DEFAULT) -> DataFrame:
    rows = [(vocab.term(name), name, comment) for name, _, comment in CLASSES]
    return small_table(spark, rows, "class string, label string, comment string")


def subclass_of(spark: SparkSession, vocab: Vocab = DEFAULT) -> DataFrame:
    rows = [(vocab.term(name), vocab.term(parent)) for name, parent, _ in CLASSES if parent]
    return small_table(spark, rows, "sub string, sup string")


def properties(spark: SparkSession, vocab: Vocab = DEFAULT) -> DataFrame:
    rows = [
        (property_iri(name, vocab), "object", vocab.term(domain), vocab.term(range_))
        for name, domain, range_ in OBJECT_PROPERTIES
    ] + [
        (property_iri(name, vocab), "datatype", vocab.term(domain), v.XSD + range_)
        for name, domain, range_ in DATATYPE_PROPERTIES
    ]
    return small_table(spark, rows, "prop string, kind string, domain string, range string")


def ontology_triples(spark: SparkSession, vocab: Vocab = DEFAULT) -> DataFrame:
    """The declarations as triples: three per class, one per subclass edge, five per property."""
    rows = []

    def iri(s, p, o):
        rows.append((s, p, o, "iri", "", ""))

    def text(s, p, o):
        rows.append((s, p, o, "literal", "", ""))

    for name, parent, comment in CLASSES:
        node = vocab.term(name)
        iri(node, v.TYPE, v.OWL + "Class")
        text(node, v.LABEL, name)
        text(node, v.COMMENT, comment)
        if parent:
            iri(node, v.SUBCLASS_OF, vocab.term(parent))
    for kind, props in (("Object", OBJECT_PROPERTIES), ("Datatype", DATATYPE_PROPERTIES)):
        for name, domain, range_ in props:
            node = property_iri(name, vocab)
            iri(node, v.TYPE, f"{v.OWL}{kind}Property")
            text(node, v.LABEL, name.removeprefix("dwc:"))
            text(node, v.COMMENT, f"{name.removeprefix('dwc:')} of a {domain.lower()}")
            iri(node, v.DOMAIN, vocab.term(domain))
            iri(node, v.RANGE, vocab.term(range_) if kind == "Object" else v.XSD + range_)
    return small_table(spark, rows, TRIPLE)
