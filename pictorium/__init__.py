"""Catalogue search and curation for described media, as Spark jobs over DataFrames."""
