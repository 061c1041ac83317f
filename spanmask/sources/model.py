"""External model findings computed next to the text.

``attach_model_findings`` runs a user detector inside ``mapInPandas``; its
findings become a ``findings`` array column on the document row, which
``plans.scan.scan`` consumes in place — no join, no text shuffle.  The
findings-table route (``scan(..., findings=table)``) remains for findings
produced elsewhere.
"""
from __future__ import annotations

from typing import Callable, Iterable

from pyspark.sql import DataFrame

from ..operators.detect import FINDING_STRUCT
from ..session import ship_package

# detector(texts) -> for every text, an iterable of (label, start, end, score or None)
Detector = Callable[[list], Iterable[Iterable[tuple]]]

_MODELS: dict = {}


def loaded(key: str, factory: Callable[[], Detector]) -> Detector:
    """The detector of ``key``, built at its first use in this process."""
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def attach_model_findings(docs: DataFrame, factory: Callable[[], Detector], key: str) -> DataFrame:
    """(doc_id, file, text, findings) with the detector's findings in model order.

    ``key`` names the model and its version; a Python worker builds each key's
    detector once, however many tasks it runs.
    """
    ship_package(docs.sparkSession)
    base = docs.select("doc_id", "file", "text")
    schema = f"doc_id bigint, file string, text string, findings array<{FINDING_STRUCT}>"

    def run(batches):
        from spanmask.sources.model import loaded as of_worker     # the worker's module, not a copy of this one
        detect = of_worker(key, factory)
        for pdf in batches:
            found = detect(pdf["text"].fillna("").tolist())
            pdf = pdf.copy()
            pdf["findings"] = [[{"label": lab, "start": int(s), "end": int(e),
                                 "score": None if sc is None else float(sc), "seq": i}
                                for i, (lab, s, e, sc) in enumerate(items)] for items in found]
            yield pdf

    return base.mapInPandas(run, schema)
