"""Case folding on every code point, exceptions as a table."""
from pyspark.sql import functions as F

from spanmask.functions.text import fold
from spanmask.plans.scan import scan


def test_fold_equals_casefold_on_every_code_point(spark):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = ["".join(map(chr, points[i:i + 500])) for i in range(0, len(points), 500)] + ["", "ASCII only", "ΑΣ ΑΣ", "ẞ", "İI"]
    rows += [chr(c) for c in points if len(chr(c).casefold()) > 1]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", fold(F.col("t")).alias("f")).collect()
    assert [r.t for r in got if r.f != r.t.casefold()] == []
    assert spark.createDataFrame([(None,)], "t string").select(fold(F.col("t"))).first()[0] is None


def test_many_exceptions(spark, docs_df):
    docs = docs_df([(1, "f", "Azienda: STRASSE  Öl | Cliente: Ditta Rossi | Vendor: Kept Srl"), (2, "f", "a@b.it +39 333 1234567")])
    terms = spark.range(200_000).select(F.concat(F.lit("term "), F.col("id")).alias("x")) \
        .unionByName(spark.createDataFrame([("straße öl",), (" DITTA\trossi ",), ("3331234567",), (None,), ("  ",)], "x string"))
    got = {r.text: r.will_redact for r in scan(docs, exclusions=terms).collect()}
    assert got == {"STRASSE  Öl": False, "Ditta Rossi": False, "Kept Srl": True, "a@b.it": True, "+39 333 1234567": False}
    assert all(r.will_redact for r in scan(docs, exclusions=terms.limit(0)).collect())
