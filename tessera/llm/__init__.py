"""Training-data operators: packing, URL filters, mixing, exact and approximate vector search,
sharding, substring / near-duplicate / suffix deduplication and toxicity scoring.

Every operator reads only the columns it names, so extra input columns (whatever their names) are
ignored; each module's docstring states what nulls, empty texts, ties, repeated rows and empty
tables give.  Nothing else in the library imports this subpackage.
"""
