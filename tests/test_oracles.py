"""Every registered query against its DuckDB oracle on the smallest fixture."""
import math

import duckdb
import pytest

import __spark_entry__ as E
from spanmask.sources.corpus import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["detect_email", "detect_vat", "detect_tax_code", "detect_iban", "detect_phone", "valid_tax_code",
        "detect_context_org", "regex_greedy", "detect_all", "entity_registry", "merge_intervals",
        "island_representative", "redact_text", "redact_documents", "manual_add", "rebuild_codes",
        "render_sheets", "render_csv_rows", "occurrence_index", "leak_check", "run_log", "profile_payload",
        "review_sort", "placeholders", "unsupported_sample", "trim_bounds", "refine_address", "read_text_ladder", "ingest_errors", "overlap_pairs",
        "row_context", "format_cells", "assemble_docx_parts", "manual_terms", "review_pages", "user_rule", "user_detector"]


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if hasattr(v, "item"):
        return _norm(v.item())
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    sp = E.queries()[name](spark, SF).toPandas()
    dk = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    cols = sorted(sp.columns)
    a = sorted(tuple(_norm(x) for x in r) for r in sp[cols].itertuples(index=False, name=None))
    b = sorted(tuple(_norm(x) for x in r) for r in dk[cols].itertuples(index=False, name=None))
    assert a == b
