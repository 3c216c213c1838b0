"""Training-data operators: one module per operator, each with its registered query."""

from creditspark.llm.registry import ORACLES, QUERIES
from creditspark.llm import (  # noqa: F401
    best_fit_packing, decontamination, html_consensus, jaccard_join, language_model, lexical_search, personal_data, phrase_mining, quality_fertility,
    rendezvous_sharding, suffix_dedup, toxicity_ordinal, url_vocabulary)

__all__ = ["ORACLES", "QUERIES"]
