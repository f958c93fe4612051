"""leadflow: sales-funnel and booking analytics as Spark DataFrame jobs.

Sub-packages
------------
functions   Column helpers (date/number coercion, safe division, key hashing)
            and the derived-metric registry.
sources     Readers for landed API pages and snapshot files.
operators   Transformations, joins, KPI reports, analytics, windows, key rules.
sinks       Snapshot and export writers.
streaming   Structured Streaming jobs over a request log.
plans       Fixture tables derived from the test data and the query registry.
"""

__version__ = "0.1.0"
