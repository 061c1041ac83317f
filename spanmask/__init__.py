"""spanmask: personal-data detection and pseudonymisation as PySpark jobs.

Entry points: ``sources.files.read_documents`` (ingest), ``plans.scan.scan``
(detection + resolution), ``plans.publish.publish`` / ``save_outputs``
(registry, codes, rewriting, outputs), ``operators.review`` (decisions),
``streaming.scan_stream`` (incremental scan).
"""

__version__ = "0.1.0"
