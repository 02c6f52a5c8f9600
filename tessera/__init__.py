"""Tessera: entity resolution and analytics as Spark plans.

functions: column expressions. operators: DataFrame to DataFrame. sources: reading and writing. plans: whole
pipelines and the catalogue of queries. streaming: the same operators on streams.
"""
