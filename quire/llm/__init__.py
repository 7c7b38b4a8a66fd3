"""Training-data operators: packing, dedup, encoding, classifiers, filters.

One module per operator, each with the operator's general interface and the
registered query built on it; ``registry`` lists the queries and their SQL.
"""
