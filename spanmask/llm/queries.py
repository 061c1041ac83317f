"""Registered queries of the subpackage: ``QUERIES[name] = (callable(spark, sf_dir), DuckDB SQL or None)``."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from .common import table, table_path

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = (run, sql)
        return run
    return deco


WARC_SQL = r"""
with h as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
d as (select page_id, payload_bytes,
             list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(hex, 1 + 5 * cast(floor(i / 4) as int), 5))::bigint >> cast(15 - 5 * (i % 4) as int)) & 31)::int, 1)), 'string_agg', '') as payload_digest
      from h),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from d)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from f
"""


@query("op5_warc_revisits", WARC_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives
    path = table_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Fixed values of the query's contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

URL_SQL = r"""
with u as (select page_id, coalesce(url, '') as url from pages),
s as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from u),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from s),
r(host, path, verdict) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                                  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select h.page_id, r.host || r.path as rule, r.verdict,
             row_number() over (partition by h.page_id order by length(r.host || r.path) desc) as k
      from h join r on (h.host = r.host or ends_with(h.host, '.' || r.host)) and starts_with(h.path, r.path))
select h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from h left join m on h.page_id = m.page_id and m.k = 1
"""


@query("op6_url_filter", URL_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "rule string, verdict string"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_digests, tokenizer_path, write_tokens
    path = table_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_digests(spark, path)


EXACT_SQL = r"""
with n as (select doc_id, length(coalesce(text, '')) as n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm from documents),
g as (select norm, first(doc_id order by n desc, doc_id) as keep_id, count(*) as group_size from n group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(norm) as text_sha256 from n join g using (norm)
"""


@query("op10_exact_dedup", EXACT_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


CONTAINED_SQL = r"""
with dw as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
iw as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark),
ds as (select distinct doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as s from dw),
its as (select distinct item_id, unnest(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i+4], ' '))) as s from iw),
n as (select item_id, count(*) as n_shingles from its group by item_id),
c as (select doc_id, item_id, count(*) as n_shared from ds join its using (s) group by all)
select doc_id, item_id, cast(n_shingles as int) as n_shingles, cast(n_shared as int) as n_shared, n_shared / n_shingles as containment
from c join n using (item_id) where 100 * n_shared >= 75 * n_shingles
"""


@query("op2_decontamination", CONTAINED_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_near_duplicates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op1_suffix_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")


@query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepieces import encode_digests, vocabulary_path
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary_path())


@query("op11_word_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_bpe import decode, digests, encode
    return digests(decode(encode(table(spark, sf_dir, "documents"))))


RANKED_SQL = r"""
with t as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
p as (select doc_id, term, count(*) as tf from t group by all),
d as (select doc_id, cast(sum(tf) as bigint) as n from p group by all),
c as (select count(*) as cn, cast(sum(n) as bigint) as cl from d),
m as (select doc_id, 75 + ((25 * n * cn) // cl) as m from d, c),
q as (select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
qt as (select item_id, term, count(*) as qf from q group by all),
w as (select term, cast(floor(1000 * ln((2 * cn + 2)::double / (2 * df + 1)::double)) as bigint) as w
      from (select term, count(*) as df from p where term in (select term from qt) group by all), c),
s as (select item_id, doc_id, cast(sum(qf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score
      from qt join w using (term) join p using (term) join m using (doc_id) group by all),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, score from r where rank <= 20
"""


@query("op12_ranked_search", RANKED_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SPELLING_SQL = r"""
with recursive k as (select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as tab),
r as (select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as run from documents),
u as (select doc_id, run, count(*) as n from r group by all),
x as (select run, n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as hx from u),
y as (select run, n, xor(4294967295, list_reduce(list_transform(range(0, length(hx) // 2), lambda i: ('0x' || substr(hx, 1 + 2 * i::int, 2))::bigint),
             lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)]), 4294967295)) as h from x, k),
z as (select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from y),
w as (select word, cast(sum(n) as bigint) as n from z where length(word) >= 6 group by word having sum(n) >= 5),
g as (select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as rest from w, lateral (select unnest(range(length(word))) as i)),
p as (select distinct a.word, b.word as other, b.n as m from g a join g b on a.rest = b.rest and a.i = b.i and a.word <> b.word
      union select distinct g.word, w.word, w.n from g join w on g.rest = w.word
      union select distinct w.word, g.word, g.n from g join w on g.rest = w.word),
b as (select word, count(*) as n_near, first(other order by m desc, other) as best, max(m) as m from p group by word),
f as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then best end as form, case when m >= 5 * n then m end as form_n from w left join b using (word)),
t(word, root) as (select word, word from f where form is null union all select f.word, t.root from f join t on f.form = t.word)
select word, form, root, n, cast(n_near as bigint) as n_near, cast(form_n as bigint) as form_n from f join t using (word)
"""


@query("op13_spelling_variants", SPELLING_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_forms
    return spelling_forms(table(spark, sf_dir, "documents"))
