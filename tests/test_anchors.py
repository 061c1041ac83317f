"""Manual terms and the leak check by shared anchors, against plain search."""
import random

from pyspark.sql import functions as F

from spanmask.operators import anchors
from spanmask.operators.review import manual_term_spans
from spanmask.sinks.writers import leak_check


def every_place(text, term):
    return [i for i in range(len(text) - len(term) + 1) if text.startswith(term, i)]


def test_occurrences_against_plain_search(spark):
    """Terms of every length, overlapping themselves, across pieces, longer than pieces, beyond the text's ends."""
    random.seed(2)
    texts = ["", "a", "aaaa", "é漢😀" * 300] + ["".join(random.choice("ab é😀") for _ in range(random.choice([5, 255, 256, 257, 1500]))) for _ in range(12)]
    terms = {"a", "aa", "😀", "é漢", "a" * 9, "漢😀é漢", "z", "é漢😀" * 200, "é漢😀" * 300, "é漢😀" * 301}
    for t in texts:
        for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 250, 256, 257, 600):
            if len(t) >= n:
                i = random.randrange(len(t) - n + 1)
                terms |= {t[i:i + n], t[i:i + n - 1] + "z", t[-n:], t[:n]}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, None), (1, "a")], "key long, text string")
    got = sorted((r.key, r.term, r.start) for r in anchors.occurrences(rows, spark.createDataFrame([(t,) for t in terms] + [("",)], "term string")).collect())
    assert got == sorted((i, t, p) for i, x in enumerate(texts) for t in terms for p in every_place(x, t))


def test_terms_with_one_beginning_have_anchors_of_their_own(spark):
    terms = spark.createDataFrame([(f"Rossi Mario {i:04d}",) for i in range(8000)], "term string")
    at = anchors.anchors(terms)
    assert at.count() == 8000
    assert at.groupBy("gram").count().agg(F.max("count")).first()[0] <= 10


def test_rows_that_repeat_an_id_keep_their_own_text(spark, docs_df):
    docs = docs_df([(1, "f", "uno due"), (1, "f", "due uno"), (1, "f", "due uno"), (2, "g", None)])
    terms = spark.createDataFrame([("uno", "private_person"), ("uno", "private_id"), (" due ", "private_person"), ("", "private_id")], "term string, label string")
    got = sorted(tuple(r) for r in manual_term_spans(docs, terms).select("doc_id", "text", "label", "start", "end").collect())
    each = [(1, "due", "private_person", 0, 3), (1, "due", "private_person", 4, 7)]
    each += [(1, "uno", label, a, a + 3) for label in ("private_id", "private_person") for a in (0, 4)]
    assert got == sorted(each)
    assert manual_term_spans(docs, terms.limit(0)).count() == 0 and manual_term_spans(docs.limit(0), terms).count() == 0


def test_leak_check_of_many_values(spark, spans_df):
    texts = spark.createDataFrame([(1, "x" + " ".join(f"v{i:05d}" for i in range(0, 10_000, 2))), (2, "aaa"), (3, ""), (4, None)], "doc_id long, redacted_text string")
    spans = spans_df([(1, "f", "private_id", f"v{i:05d}", 0, 6, None, True, "", "regex") for i in range(10_000)]
                     + [(d, "f", "private_id", v, 0, 1, None, r, "", "regex") for d in (2, 3, 4) for v, r in (("aa", True), ("a", True), ("aaa", False), ("b", True), ("", True))])
    left = sorted(tuple(r) for r in leak_check(texts, spans).collect())
    assert left == sorted([(1, f"v{i:05d}") for i in range(0, 10_000, 2)] + [(2, "a"), (2, "aa")])
