"""quire: full-text search and text analytics over a book corpus, on Spark.

Everything is a plain function ``DataFrame -> DataFrame`` built from the
DataFrame API, so Catalyst plans it and the same code runs locally or on a
cluster.

Subpackages:

- ``sources``   reading the catalogue, whole-text files, the driver tables; sinks
- ``functions`` column expressions: tokeniser, analysers, formatting helpers
- ``operators`` paragraphs, analysis, postings, matching, ranking, headlines,
                mentions, graph, statistics, data-quality checks
- ``plans``     end-to-end jobs: search, discovery, corpus build
- ``streaming`` append-only query log and incremental book ingest
"""

__version__ = "0.1.0"
