"""The pipeline's removal of copies and of contaminated texts moves texts as little as it can."""
from spanmask.llm import decontam
from spanmask.llm.exact_dedup import drop_copies

SCHEMA = "doc_id long, text string, lang string"
ROWS = [(1, "a b c", "x"), (2, "abc", "y"), (2, "a  b c", "z"), (2, "other", "o"), (None, "a b  c ", "n"), (None, "alone", "n"), (None, "alone", "n"),
        (5, None, "e"), (4, " ", "e"), (4, "\n\t", "f"), (7, "last", "l")]


def _left(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_texts_are_dealt_once(spark):
    keep = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        docs = spark.createDataFrame(ROWS, SCHEMA)
        left = drop_copies(docs)
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2              # the texts' and the dropped rows'
        # of equal texts the longest row stays, then the smallest id, null last
        assert _left(left) == sorted(map(repr, [ROWS[4], ROWS[3], ROWS[5], ROWS[9], ROWS[10]]))
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)


def test_contaminated_texts_are_known_by_short_digests(spark, monkeypatch):
    written = {}
    plain = decontam.materialize
    monkeypatch.setattr(decontam, "materialize", lambda df, name: written.setdefault(name, plain(df, name)))
    item = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, "zero " + item + " nine"), (1, "clean text of the same id"), (None, item), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item)], "item_id long, text string")
    assert _left(decontam.drop_contaminated(docs, items, null_ids=True)) == sorted(map(repr, [(1, "clean text of the same id"), (3, None), (4, "")]))
    assert len(decontam.drop_contaminated(docs, items).where("doc_id is null").collect()) == 1
    assert [len(r[0]) for r in written["contaminated"].collect()] == [16, 16]
