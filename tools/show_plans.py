"""Print the formatted physical plans of the headline jobs (scan, publish) for a scale factor."""
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanmask.plans.publish import publish  # noqa: E402
from spanmask.plans.scan import scan  # noqa: E402
from spanmask.session import local_session  # noqa: E402
from spanmask.sources import corpus  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    docs = corpus.documents(spark, sf)
    spans = scan(docs)
    print("== scan ==")
    spans.explain("formatted")
    texts, registry, coded = publish(docs, spans)
    print("== registry ==")
    registry.explain("formatted")
    print("== rewrite ==")
    texts.explain("formatted")


if __name__ == "__main__":
    main()
