"""fieldbook: curation, lineage, deduplication and retrieval analytics for labelled media collections, as Spark plans."""
