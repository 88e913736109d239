"""apiforge: mining function-call data from code corpora and curating synthetic
samples, as DataFrame operators on Spark.

Subpackages: ``sources`` (readers, writers, corpus assembly), ``functions``
(Column expressions: signatures, JSON text, prompt texts), ``operators``
(scan, as-of lookup, resolution, sites, catalog, tree, requests, completion,
curation), ``plans`` (end-to-end stages and the checked queries),
``streaming`` (incremental collection).
"""

__version__ = "0.1.0"
