"""A user detector attached with mapInPandas feeds the scan without a join."""
import re
import sys

from pyspark import cloudpickle

from spanmask.plans.scan import scan
from spanmask.sources.model import attach_model_findings


def name_detector():
    pat = re.compile(r"\b(Mario Rossi|Luca Bianchi)\b")

    def detect(texts):
        return [[("private_person", m.start(), m.end(), 0.9) for m in pat.finditer(t)]
                + [("account_number", 0, 4, 0.1)] for t in texts]
    return detect


def test_model_findings_inline(spark, docs_df):
    cloudpickle.register_pickle_by_value(sys.modules[__name__])   # workers cannot import the test module
    d = docs_df([(1, "a.txt", "Caro Mario Rossi, scrivi a info@example.com"), (2, "b.txt", "Luca Bianchi")])
    with_model = attach_model_findings(d, name_detector, "names-1")
    got = sorted((r.doc_id, r.label, r.text, r.start, r.end, r.source)
                 for r in scan(with_model, min_score=0.2).collect())
    assert got == [(1, "private_email", "info@example.com", 27, 43, "regex"),
                   (1, "private_person", "Mario Rossi", 5, 16, "opf"),
                   (2, "private_person", "Luca Bianchi", 0, 12, "opf")]


def test_model_is_built_once_per_worker(spark, docs_df, tmp_path):
    """Sixteen tasks build at most as many detectors as there are Python workers."""
    import os
    folder = str(tmp_path)

    def factory():
        import uuid
        with open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w"):
            pass
        return lambda texts: [[] for _ in texts]

    d = docs_df([(i, "a.txt", "x") for i in range(64)]).repartition(16)
    attach_model_findings(d, factory, f"counted-{folder}").count()
    d.repartition(16).transform(lambda x: attach_model_findings(x, factory, f"counted-{folder}")).write.format("noop").mode("overwrite").save()
    built = os.listdir(folder)
    assert 0 < len(built) <= spark.sparkContext.defaultParallelism
    assert len({b.split("-")[0] for b in built}) == len(built)
