"""Semantic edge cases of detection, resolution, numbering and rewriting."""
from pyspark.sql import functions as F

from spanmask.operators.detect import DEFAULT_RULES

from spanmask.operators.redact import redact_documents
from spanmask.operators.registry import entity_registry
from spanmask.operators.resolve import islands
from spanmask.plans.publish import publish
from spanmask.plans.scan import scan
from spanmask.queries import QUERIES


def _spans(docs_df, text, **kw):
    return [(r.label, r.text, r.start, r.end, r.source, r.will_redact)
            for r in scan(docs_df([(1, "a.txt", text)]), **kw).orderBy("start").collect()]


def test_iban_swallows_following_whitespace(spark, docs_df):
    text = "IBAN IT60X0542811101000000123456 pagato"
    s = _spans(docs_df, text)
    assert s == [("private_id", "IT60X0542811101000000123456", 5, 33, "regex", True)]
    texts, _, _ = publish(docs_df([(1, "a.txt", text)]), scan(docs_df([(1, "a.txt", text)])))
    assert texts.collect()[0].redacted_text == "IBAN [ID_1]pagato"


def test_context_value_cut_and_separator_quirks(spark, docs_df):
    assert _spans(docs_df, "client-side code")[0][1] == "side code"
    s = _spans(docs_df, "Supplier:\nVAT number: 01")
    assert s[0][1] == "VAT number: 01"


def test_phone_checksum_fallback_and_earlier_start(spark, docs_df):
    assert _spans(docs_df, "tel 01114601007")[0][:2] == ("private_phone", "01114601007")
    s = _spans(docs_df, "+39 01114601006")
    assert [(x[0], x[1]) for x in s] == [("private_phone", "+39 01114601006")]


def test_regex_vs_context_tie_keeps_longer(spark, docs_df):
    # context value "01114601006 x" (13 chars) beats the 11-digit id it covers
    s = _spans(docs_df, "Cliente: 01114601006 x")
    assert [(x[0], x[1]) for x in s] == [("private_organization", "01114601006 x")]


def test_touching_intervals_are_not_merged(spark, spans_df):
    sp = spans_df([(1, "a", "private_person", "ab", 0, 2, None, True, "", "opf"),
                   (1, "a", "private_person", "cd", 2, 4, None, True, "", "opf"),
                   (1, "a", "private_person", "c", 3, 5, None, True, "", "opf")])
    got = sorted((r.start, r.island) for r in islands(sp).collect())
    assert got == [(0, 0), (2, 2), (3, 2)]


def test_phone_normalisation_drops_country_code(spark, spans_df):
    sp = spans_df([(1, "a", "private_phone", "+39 333 1234567", 0, 15, None, True, "", "regex"),
                   (2, "b", "private_phone", "333 1234567", 0, 11, None, True, "", "regex")])
    assert entity_registry(sp).count() == 1


def test_exclusion_only_clears_the_flag(spark, docs_df):
    s = _spans(docs_df, "mail INFO@example.com", exclusions=["info@EXAMPLE.com"])
    assert s == [("private_email", "INFO@example.com", 5, 21, "regex", False)]


def test_unselected_span_still_competes(spark, docs_df):
    s = _spans(docs_df, "P.IVA 01114601006", labels=["private_phone"])
    assert s == [("private_id", "01114601006", 6, 17, "regex", False)]


def test_empty_text_and_non_bmp_offsets(spark, docs_df):
    assert _spans(docs_df, "") == []
    s = _spans(docs_df, "\U0001F600 x a.b@c.it")
    assert s[0][2:4] == (4, 12)
    d = docs_df([(1, "a", "\U0001F600 x a.b@c.it [PERSON_1]")])
    texts, _, _ = publish(d, scan(d))
    assert texts.collect()[0].redacted_text == "\U0001F600 x [EMAIL_1] [PERSON_1]"


def test_numbering_follows_file_order_not_input_order(spark, spans_df):
    sp = spans_df([(2, "b.txt", "private_email", "x@y.it", 0, 6, None, True, "", "regex"),
                   (1, "a.txt", "private_email", "z@y.it", 5, 11, None, True, "", "regex"),
                   (1, "a.txt", "private_person", "Anna", 0, 4, 0.9, True, "", "opf")])
    reg = {r.text: (r.entity_id, r.placeholder) for r in entity_registry(sp).collect()}
    assert reg == {"Anna": (1, "PERSON_1"), "z@y.it": (2, "EMAIL_1"), "x@y.it": (3, "EMAIL_2")}


def test_merged_island_uses_best_rank_code(spark, spans_df, docs_df):
    docs = docs_df([(1, "a", "Mario Rossi Srl")])
    sp = spans_df([(1, "a", "private_person", "Mario Rossi", 0, 11, 0.9, True, "PERSON_1", "opf"),
                   (1, "a", "private_organization", "Rossi Srl", 6, 15, None, True, "ORGANIZATION_1", "context")])
    assert redact_documents(docs, sp).collect()[0].redacted_text == "[ORGANIZATION_1]"


def test_two_pass_numbering_equals_window(spark):
    from spanmask.operators.registry import first_occurrences, number_two_pass, number_window
    from spanmask.sources import corpus
    sp = scan(corpus.forms(spark, "/root/testdata/sf0.01"))
    ents = first_occurrences(sp)
    want = sorted(map(tuple, number_window(ents).select("entity_id", "placeholder", "label", "normalized").collect()))
    for n in (1, 3, 8):
        got = sorted(map(tuple, number_two_pass(ents, n).select("entity_id", "placeholder", "label",
                                                                "normalized").collect()))
        assert got == want


def test_flagship_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns == ["doc_id", "redacted_text", "n_redactions"]
    assert df.count() >= 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert "redact_documents" in QUERIES


def test_islands_resolve_like_whole_documents(spark):
    """Resolution by island equals one fold over all candidates of a document."""
    from spanmask.operators.resolve import resolve_df
    from spanmask.operators.spans import explode_array
    from spanmask.plans.scan import candidate_arrays, findings_per_doc
    from spanmask.queries import MIN_SCORE
    from spanmask.sources import corpus
    forms = corpus.forms(spark, "/root/testdata/sf0.01")
    findings = corpus.form_findings(spark, "/root/testdata/sf0.01")
    big = forms.groupBy((F.col("doc_id") % 3).alias("doc_id")).agg(
        F.concat_ws("\n", F.array_sort(F.collect_list("text"))).alias("text")).withColumn("file", F.lit("big.txt"))
    cols = ["doc_id", "label", "text", "start", "end", "score", "source"]
    for docs, f in ((big, None), (forms, findings)):
        d = docs if f is None else docs.join(findings_per_doc(f), "doc_id", "left")
        cand = candidate_arrays(d, f is not None, MIN_SCORE, DEFAULT_RULES, True)
        whole = explode_array(resolve_df(cand, ["doc_id"]), F.col("spans"), ["doc_id"]).select("doc_id", "s.*")
        a = sorted(map(str, whole.select(*cols).collect()))
        b = sorted(map(str, scan(docs, findings=f, min_score=MIN_SCORE).select(*cols).collect()))
        assert len(a) > 300 and a == b


def test_islands_against_brute_force(spark, spans_df):
    import random
    rnd = random.Random(7)
    rows = sorted((st := rnd.randrange(0, 5000), st + rnd.randrange(1, 60)) for _ in range(400))
    want, reach, first = [], -1, None
    for a, b in rows:
        first = a if a >= reach else first
        reach = max(reach, b)
        want.append((a, b, first))
    sp = spans_df([(1, "a", "private_person", "x", a, b, None, True, "", "opf") for a, b in rows])
    assert sorted((r.start, r.end, r.island) for r in islands(sp).collect()) == sorted(want)


def test_overlapping_pairs_against_brute_force(spark):
    import random
    from spanmask.operators.resolve import overlapping_pairs
    rnd = random.Random(3)
    rows = [(d, st := rnd.randrange(0, 3000), st + rnd.randrange(1, 700), "l", i) for d in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, start int, end int, label string, rule_idx int")
    got = sorted((r.doc_id, r.a_start, r.a_end, r.b_start, r.b_end) for r in overlapping_pairs(df).collect())
    want = sorted((p[0], p[1], p[2], q[1], q[2]) for p in rows for q in rows
                  if p[0] == q[0] and max(p[1], q[1]) < min(p[2], q[2]) and (p[1], p[2], p[4]) < (q[1], q[2], q[4]))
    assert got == want


def test_running_sums(spark):
    from spanmask.functions.matches import running_sums
    df = spark.createDataFrame([([],), ([5],), (list(range(1000)),)], "v array<int>")
    for r in df.select("v", running_sums(F.col("v")).alias("s")).collect():
        total, want = 0, []
        for x in r.v:
            total += x
            want.append(total)
        assert r.s == want


def test_ids_above_the_pad_width_stay_apart(spark):
    from spanmask.sources.corpus import DOC_FILE_SQL
    df = spark.range(10**10, 10**10 + 20).withColumnRenamed("id", "doc_id")
    assert df.select(F.expr(DOC_FILE_SQL)).distinct().count() == 20


def test_exclusions_fold_like_texts(spark, docs_df):
    d = docs_df([(1, "a.txt", "Cliente: ΑΛΦΑΣ SA\nCliente: Işık Ltd\nCliente: ACME Ltd\nCliente: Straße GmbH\nCliente: Rossi Srl")])
    ex = ["ΑΛΦΑς SA", "Işık Ltd", "acme  LTD", "STRASSE gmbh"]
    assert [r.text for r in scan(d, exclusions=ex).where("will_redact").collect()] == ["Rossi Srl"]


def test_rewrite_of_long_texts(spark):
    import random
    from spanmask.operators.redact import rewrite
    rnd = random.Random(5)
    text = "".join(rnd.choice("abé😀") for _ in range(3000))
    cuts = sorted(rnd.sample(range(3001), 80))
    ivs = [(a, b, f"[{i}]") for i, (a, b) in enumerate(zip(cuts[::2], cuts[1::2]))]
    df = spark.createDataFrame([(text, ivs), (text, []), (text, None), (text, [(0, 3000, "[X]")])], "t string, ivs array<struct<start:int,end:int,ph:string>>")
    want, at = "", 0
    for a, b, p in ivs:
        want, at = want + text[at:a] + p, b
    assert [r[0] for r in df.select(rewrite(F.col("t"), F.col("ivs"))).collect()] == [want + text[at:], text, text, "[X]"]


def test_preview_reads_one_document(spark, spans_df, docs_df):
    from spanmask.operators.redact import preview
    docs = docs_df([(1, "a.txt", "abcdef"), (2, "b.txt", "abcdef")])
    spans = spans_df([(i, "x", "private_person", "cd", 2, 4, None, True, f"PERSON_{i}", "opf") for i in (1, 2)])
    assert [r.redacted_text for r in preview(docs, spans, 2).collect()] == ["ab[PERSON_2]ef"]


def test_manual_terms_report_and_strip(spark, docs_df, spans_df):
    from spanmask.operators.review import manual_add
    docs = docs_df([(1, "a.txt", "uno due uno")])
    terms = spark.createDataFrame([(" uno ", "private_person"), ("tre", "private_person"), ("  ", "private_id")], "term string, label string")
    spans, counts = manual_add(spans_df([(1, "a.txt", "private_person", "uno", 0, 3, None, True, "", "opf")]), docs, terms)
    assert {(r.term, r.added) for r in counts.collect()} == {("uno", 1), ("tre", 0)}
    assert sorted((r.start, r.code) for r in spans.collect()) == [(0, "PERSON_1"), (8, "PERSON_1")]


def test_manual_terms_against_find(spark, docs_df):
    """Long, overlapping and many terms; 200,000 of them are no limit."""
    import random
    from spanmask.operators.review import manual_term_spans
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("ab cé") for _ in range(n)) for n in (0, 3, 700)] + ["a" * 300, "x" * 63 + "needle" + "y" * 200]
    terms = ["a", "aa", "ab", "aab ", "a" * 70, "é", "needle" + "y" * 100, "x" * 60 + "nee", "absent", "aXa"] + [f"none{i}" for i in range(200_000)]
    want = []
    for d, t in enumerate(texts):
        for term in {x.strip() for x in terms}:
            at = t.find(term)
            while at >= 0:
                want.append((d, at, at + len(term), term))
                at = t.find(term, at + len(term))
    df = spark.createDataFrame([(x, "l") for x in terms], "term string, label string")
    got = manual_term_spans(docs_df([(d, "f", t) for d, t in enumerate(texts)]), df)
    assert sorted((r.doc_id, r.start, r.end, r.text) for r in got.collect()) == sorted(want)


def test_street_refinement_takes_next_letter(spark, docs_df):
    d = docs_df([(1, "a.txt", "Sede: Via Roma 12 Torino")])
    f = spark.createDataFrame([(1, "private_address", 6, 24, 0.9, 0)],
                              "doc_id long, label string, start int, end int, score double, seq int")
    s = [(r.label, r.text, r.start, r.end) for r in scan(d, findings=f).where(F.col("source") == "opf").collect()]
    assert s == [("private_address", "Via Roma 12 T", 6, 19)]


def test_context_value_limits(spark, docs_df):
    long_name = "A" * 130
    s = _spans(docs_df, f"Cliente: {long_name}")
    assert s[0][1] == "A" * 120
    s = _spans(docs_df, "Azienda = Rossi Spa; altro")
    assert s[0][1] == "Rossi Spa"


def test_kept_spans_get_no_code(spark, spans_df, docs_df):
    d = docs_df([(1, "a.txt", "Mario Rossi incontra Luca Bianchi")])
    sp = spans_df([(1, "a.txt", "private_person", "Mario Rossi", 0, 11, 0.95, True, "", "opf"),
                   (1, "a.txt", "private_person", "Luca Bianchi", 21, 33, 0.95, False, "STALE_1", "opf")])
    texts, reg, coded = publish(d, sp)
    codes = {r.text: r.code for r in coded.collect()}
    assert codes == {"Mario Rossi": "PERSON_1", "Luca Bianchi": ""}
    assert texts.collect()[0].redacted_text == "[PERSON_1] incontra Luca Bianchi"


def test_manual_terms_non_overlapping_and_literal(spark, docs_df):
    from spanmask.operators.review import manual_term_spans
    d = docs_df([(1, "a.txt", "aaaa a.b a+b a.b"), (2, "b.txt", "nothing here")])
    t = spark.createDataFrame([("aa", "private_person"), ("a.b", "private_id"), ("a+b", "private_id")],
                              "term string, label string")
    got = sorted((r.doc_id, r.text, r.start, r.end) for r in manual_term_spans(d, t).collect())
    assert got == [(1, "a+b", 9, 12), (1, "a.b", 5, 8), (1, "a.b", 13, 16), (1, "aa", 0, 2), (1, "aa", 2, 4)]


def test_exclusion_by_normalised_entity(spark, docs_df):
    s = _spans(docs_df, "chiama +39 333 1234567 oppure 011 7654321", exclusions=["3331234567"])
    assert [(x[1], x[5]) for x in s] == [("+39 333 1234567", False), ("011 7654321", True)]


def test_registry_stable_under_shuffled_input(spark):
    from spanmask.sources import corpus
    sp = scan(corpus.forms(spark, "/root/testdata/sf0.01"))
    cols = ["entity_id", "placeholder", "label", "normalized"]
    a = sorted(map(tuple, entity_registry(sp).select(*cols).collect()))
    shuffled = sp.repartition(7).orderBy(F.rand(3))
    b = sorted(map(tuple, entity_registry(shuffled).select(*cols).collect()))
    assert a == b
