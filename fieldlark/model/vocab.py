"""IRIs. The base address is a parameter: pass the one your graph was written with."""

from __future__ import annotations

from dataclasses import dataclass

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
DWC = "http://rs.tdwg.org/dwc/terms/"

# fixed values: external identifier namespaces
EBIRD_SPECIES = "https://ebird.org/species/"
GBIF_SPECIES = "https://www.gbif.org/species/"
WIKIDATA_ENTITY = "http://www.wikidata.org/entity/"
DBPEDIA_RESOURCE = "http://dbpedia.org/resource/"
COMMONS_FILE = "http://commons.wikimedia.org/wiki/Special:FilePath/"

TYPE = RDF + "type"
LABEL = RDFS + "label"
COMMENT = RDFS + "comment"
DOMAIN = RDFS + "domain"
RANGE = RDFS + "range"
SUBCLASS_OF = RDFS + "subClassOf"
SAME_AS = OWL + "sameAs"

SCIENTIFIC_NAME = DWC + "scientificName"
ORDER = DWC + "order"
FAMILY = DWC + "family"
GENUS = DWC + "genus"

INTEGER = XSD + "integer"
DECIMAL = XSD + "decimal"
DATE = XSD + "date"
STRING = XSD + "string"
ANY_URI = XSD + "anyURI"


@dataclass(frozen=True)
class Vocab:
    """Namespaces below one base address."""

    base: str = "https://example.org/fieldlark/"

    def term(self, name: str) -> str:
        return f"{self.base}ontology/{name}"

    def taxon(self, path: str = "") -> str:
        return f"{self.base}taxon/{path}"

    def observation(self, key: str = "") -> str:
        return f"{self.base}observation/{key}"

    def location(self, key: str = "") -> str:
        return f"{self.base}location/{key}"

    @property
    def canonical_species(self) -> str:
        """Prefix of species nodes minted here, as opposed to linked external ones."""
        return self.taxon("species/")

    @property
    def parent_taxon(self) -> str:
        return self.term("parentTaxon")

    @property
    def has_observation(self) -> str:
        return self.term("hasObservation")


DEFAULT = Vocab()
