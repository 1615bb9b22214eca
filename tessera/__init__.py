"""tessera: a Spark-first relational data layer.

Typed models, an immutable query builder that lowers to one DataFrame, relations that load as nested columns, and
versioned copy-on-write tables with transactions.
"""
