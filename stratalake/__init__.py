"""stratalake: relational tables and API responses to business marts, as Spark jobs.

Layers: landing (raw snapshots) -> bronze (latest row per key) -> silver
(dimensions) -> gold (marts), followed by data-quality checks.
"""
