"""Document collections derived by Spark from the given tables.

* ``documents`` -> (doc_id, file, text); the file name is the zero-padded id so
  file order equals id order.
* ``forms`` -> one rendered supplier form per ``supplier`` row; it carries
  every rule (VAT, tax code, IBAN, e-mail, phone, context field, address).
  The SQL is plain enough to run unchanged in Spark SQL and DuckDB.
* ``form_findings`` -> synthetic model findings over ``forms`` (overlaps on
  purpose, scores derived from keys) standing in for an external model.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, names=TABLES) -> None:
    for n in names:
        table(spark, sf_dir, n).createOrReplaceTempView(n)


DOC_FILE_SQL = "concat('doc_', lpad(cast(doc_id as string), cast(greatest(9, length(cast(doc_id as string))) as int), '0'), '.txt')"

# n_chars (= length(text)) is carried so length-based routing can read it without the text
DOCS_SQL = f"select doc_id, {DOC_FILE_SQL} as file, text, n_chars from documents"

# FIXED VALUES: the rendered form corpus (same text in Spark SQL and DuckDB)
FORMS_SQL = """
with k as (select s_suppkey, s_name, n_name, lpad(cast((s_suppkey*104729+1234567)%10000000000 as string),10,'0') b, lpad(cast(s_suppkey as string),12,'0') acct
           from supplier join nation on s_nationkey=n_nationkey),
v as (select *, concat(b, cast((10-(cast(substr(b,1,1) as int)+cast(substr(b,3,1) as int)+cast(substr(b,5,1) as int)+cast(substr(b,7,1) as int)+cast(substr(b,9,1) as int)+(case when cast(substr(b,2,1) as int)*2>9 then cast(substr(b,2,1) as int)*2-9 else cast(substr(b,2,1) as int)*2 end)+(case when cast(substr(b,4,1) as int)*2>9 then cast(substr(b,4,1) as int)*2-9 else cast(substr(b,4,1) as int)*2 end)+(case when cast(substr(b,6,1) as int)*2>9 then cast(substr(b,6,1) as int)*2-9 else cast(substr(b,6,1) as int)*2 end)+(case when cast(substr(b,8,1) as int)*2>9 then cast(substr(b,8,1) as int)*2-9 else cast(substr(b,8,1) as int)*2 end)+(case when cast(substr(b,10,1) as int)*2>9 then cast(substr(b,10,1) as int)*2-9 else cast(substr(b,10,1) as int)*2 end))%10 + case when s_suppkey%5=4 then 1 else 0 end)%10 as string)) vat,
  lpad(cast(98 - cast(concat('330542811101',acct,'182900') as decimal(38,0)) % 97 as string),2,'0') ck from k)
select s_suppkey as doc_id, concat('form_',lpad(cast(s_suppkey as string),cast(greatest(6,length(cast(s_suppkey as string))) as int),'0'),'.txt') as file,
 concat('Supplier: ', s_name, ' | VAT number: ', vat, chr(10), 'IBAN: IT', ck, 'X0542811101', acct, chr(10),
  'Tax ID: ', case when s_suppkey%3=0 then 'RSSMRA85T10A562S' else 'RSSMRA85T10A562T' end, chr(10),
  'Email: ', case when s_suppkey%2=0 then 'INFO' else 'info' end, cast(s_suppkey%7 as string), '@example.com', chr(10),
  'Phone: +39 333 ', lpad(cast(s_suppkey%40 as string),7,'0'), chr(10), 'Address: Via ', n_name, ' ', cast(s_suppkey%90+1 as string), ', Torino') as text from v
"""

# Synthetic model findings over forms (label, start, end, score, seq):
#  seq 0  person over the supplier name, extended by the separator " |" (trimmed away)
#  seq 1  vat_number alias over "VAT number: <digits>" (loses to the rule span)
#  seq 2  address over "Via <nation> <n>, Torino" (refined to the street part)
#  seq 3  low-score location over "Torino" (dropped by a min score of 0.2 when score < 0.2)
# Offsets are 0-based; instr() is 1-based in both engines.
FINDINGS_SQL = """
select doc_id, 'private_person' as label, cast(instr(text, 'Supplier#') - 1 as int) as f_start,
       cast(instr(text, ' | VAT') + 2 as int) as f_end, cast((doc_id % 10) / 10.0 + 0.05 as double) as score, 0 as seq
from forms
union all
select doc_id, 'vat_number', cast(instr(text, 'VAT number') - 1 as int), cast(instr(text, 'VAT number') + 22 as int),
       cast(0.9 as double), 1 from forms
union all
select doc_id, 'private_address', cast(instr(text, 'Via ') - 1 as int), cast(length(text) as int),
       cast(case when doc_id % 4 = 0 then null else 0.75 end as double), 2 from forms
union all
select doc_id, 'private_location', cast(length(text) - 6 as int), cast(length(text) as int),
       cast((doc_id % 5) / 20.0 as double), 3 from forms
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(DOCS_SQL)


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, ["supplier", "nation"])
    df = spark.sql(FORMS_SQL)
    df.createOrReplaceTempView("forms")
    return df


def form_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms(spark, sf_dir)
    return spark.sql(FINDINGS_SQL).withColumnRenamed("f_start", "start").withColumnRenamed("f_end", "end")
