"""Pages of the review table equal slices of the whole sort."""
import pytest

from spanmask.operators.review import review_page, review_sort

ROWS = [(i, None if i % 5 == 0 else f"f{i % 3}", i % 2 == 0, None if i % 4 == 0 else 0.1 * (i % 7)) for i in range(1, 24)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("column", ["file", "redact", "confidence"])
def test_pages_are_slices_of_the_sort(spark, column, descending):
    s = spark.createDataFrame(ROWS, "idx long, file string, will_redact boolean, score double")
    whole = [r["idx"] for r in review_sort(s, column, descending).orderBy("pos").collect()]
    got, last = [], None
    while True:
        rows = review_page(s, column, 5, last, descending).collect()
        got += [r["idx"] for r in rows]
        if len(rows) < 5:
            break
        last = rows[-1]
    assert got == whole


def test_no_rows(spark):
    s = spark.createDataFrame([], "idx long, file string, will_redact boolean, score double")
    assert review_page(s, "file", 5).collect() == []
