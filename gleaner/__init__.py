"""gleaner: document triage analytics on Spark.

Feed discovery (url normalisation, seen suppression, relevance scoring, best per
url, source-capped top-k), article extraction from HTML, model-output recovery
and normalisation, digest reporting, and seen-url state in batch or streaming.
Every operator is DataFrame -> DataFrame built from Catalyst expressions.

Modules: ``functions`` (column builders and fixed values), ``operators``
(relational operators), ``sources`` / ``sinks`` (files and tables),
``streaming`` (Structured Streaming jobs), ``plans`` (registered queries).
"""

__version__ = "0.1.0"
