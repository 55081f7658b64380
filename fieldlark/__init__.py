"""Spark-native analytics for taxonomic knowledge graphs and field observations."""

from fieldlark.model.vocab import Vocab
from fieldlark.plans.graph import KnowledgeGraph

__all__ = ["KnowledgeGraph", "Vocab"]
