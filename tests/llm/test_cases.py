"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns, and each operator's own turns."""
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_queries import brute_components, brute_repeats, shingles

from spanmask.llm import common, decontam, exact_dedup, near_dup, quality, sentencepieces, suffix_dedup, tokens, toxicity, url_filter, warc
from spanmask.session import ship_package

SCHEMA = "doc_id long, text string, lang string, key string, node string, n long, rule string, part int"
LONG = " ".join(f"w{i}" for i in range(30_000))
ROWS = [(1, "a b c d e f g"), (2, None), (3, ""), (4, " \t\n"), (5, "A  b c d e f g"), (5, "A  b c d e f g"), (6, LONG), (7, "x"), (8, "x"),
        (9, "é 漢字 😀 ü"), (None, "a b c d e f g"), (10, LONG + " tail")]


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame([(d, t, "l", "k", "n", 1, "r", 0) for d, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    ship_package(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "x"), (1, 0, 1, "x"), (6, 0, 0, None), (None, 1, 1, ""), (99, 1, 0, "")],
                                 "doc_id long, quality int, toxic int, text string")


def test_empty_tables(spark, empty, labels, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    rules = spark.createDataFrame([("org/", "allow")], "rule string, verdict string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert near_dup.near_duplicates(empty).count() == 0
    assert suffix_dedup.remove_repeats(empty).count() == 0
    assert quality.quality_scores(empty, labels).count() == 0
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert decontam.contaminated(empty, items).count() == 0
    assert sentencepieces.encode(empty, sentencepieces.vocabulary_path()).count() == 0
    assert url_filter.judge_urls(pages, rules).count() == 0
    warc.write_archives(pages, f"{tmp_path}/w")
    assert warc.read_archives(spark, f"{tmp_path}/w").count() == 0
    tokens.write_tokens(empty, f"{tmp_path}/t", tokens.tokenizer_path())
    assert tokens.token_digests(spark, f"{tmp_path}/t").count() == 0


def test_no_items_no_rules_no_labels(spark, docs):
    assert decontam.contaminated(docs, spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    got = url_filter.judge_urls(pages, spark.createDataFrame([], "rule string, verdict string")).collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [("a.org", "/", None, "allow")]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.toxicity_scores(docs, none).collect()} == {0.0}


def test_exact_dedup_cases(docs):
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(docs).collect())
    assert [x[1:] for x in got] == [
        (1, 2, True), (4, 3, False), (4, 3, False), (4, 3, True), (5, 2, True), (5, 2, True), (6, 1, True), (7, 2, True), (7, 2, False),
        (9, 1, True), (10, 1, True), (1, 2, False)]
    assert sorted(r.doc_id for r in exact_dedup.drop_copies(docs.where("doc_id is not null")).collect()) == [1, 4, 5, 6, 7, 9, 10]


def test_exact_dedup_with_colliding_fingerprints(docs):
    """Any fingerprint gives the same result; this one calls all chunks of one length equal."""
    keys = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    weak = exact_dedup.exact_dedup(docs, fingerprint=lambda c: F.length(c).cast("long")).select(keys)
    strong = exact_dedup.exact_dedup(docs).select(keys)
    assert sorted(map(str, weak.collect())) == sorted(map(str, strong.collect()))


def test_chunks_give_the_text_back(spark):
    random.seed(4)
    texts = ["".join(random.choice("abc漢😀") for _ in range(n)) for n in (0, 1, 191, 192, 193, 5000)] + ["ab" * 5000, "a" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", F.array_join(exact_dedup.chunks(F.col("t")), "").alias("back"), F.size(exact_dedup.chunks(F.col("t"))).alias("n")).collect()
    assert all(r.t == r.back for r in rows) and max(r.n for r in rows) >= 5


def test_near_duplicate_cases(spark, docs):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect()}
    assert got[(1, 3)] == (1, True) and got[(5, 3)] == (1, False) and got[(None, 3)] == (1, False)
    assert got[(2, 0)] == (2, True) and got[(3, 0)] == (3, True) and got[(4, 0)] == (4, True)
    assert got[(7, 1)] == (7, True) and got[(8, 1)] == (7, False) and got[(10, 29_997)] == (6, False)


def test_near_duplicate_families(spark):
    """Chains, small sets and a family whose members are near a common text but not near each other."""
    random.seed(8)
    ship_package(spark)
    base = [f"b{i}" for i in range(120)]
    rows, d = [], 100
    for _ in range(40):
        w = list(base)
        for i in random.sample(range(120), 3):
            w[i] = f"x{random.random()}"
        rows.append((d, " ".join(w)))
        d += 1
    rows.append((d, " ".join(base)))
    for n in range(1, 45):
        w = [f"s{n}_{i}" for i in range(n)]
        rows += [(1000 + 3 * n, " ".join(w)), (1001 + 3 * n, " ".join(w + ["more"])), (1002 + 3 * n, " ".join(w[1:]))]
    chain = [f"c{i}" for i in range(400)]
    rows += [(2000 + i, " ".join(chain[i * 12:i * 12 + 120])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == brute_components(rows)


def test_suffix_dedup_cases(spark, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got[2] == (0, 0, 0) and got[7] == (1, 0, 0) and got[6][1] == 0 and got[10] == (len(LONG) + 5, len(LONG), 1)


def test_suffix_dedup_of_repeated_ids(spark):
    ship_package(spark)
    random.seed(5)
    passage = "".join(random.choice("abcdefgh ") for _ in range(301))
    rows = [(1, "aaa short"), (1, passage), (2, "x" + passage), (None, passage[:150]), (None, "other"), (3, "tail " + passage[50:]), (3, "tail " + passage[50:]), (1, None)]
    order = sorted(set((d is not None, d or 0, hashlib.sha256((t or "").encode()).hexdigest(), (t or "").encode()) for d, t in rows))
    by_row = dict(zip([x[1:3] for x in order], brute_repeats([x[3] for x in order])))
    want = [(d, *by_row[d or 0, hashlib.sha256((t or "").encode()).hexdigest()]) for d, t in rows]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).drop("removed").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_suffix_dedup_on_mixtures(spark, batches):
    random.seed(batches)
    ship_package(spark)
    base = ["".join(random.choice("abcdefé ") for _ in range(random.randint(50, 600))) for _ in range(12)]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(random.randint(1, 4)):
            s = random.choice(base)
            t += s[random.randint(0, len(s) // 2):random.randint(len(s) // 2, len(s))] + "ab" * random.choice([0, 0, 90])
        texts.append(t)
    texts += ["a" * 1000, "a" * 150, texts[0], texts[0] * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, batches=batches).collect()}
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts])))


def test_decontamination_cases(spark):
    item = " ".join(f"t{i}" for i in range(20))                                    # 16 shingles, 12 needed
    rows = [(1, "lead " * 5000 + item.upper() + " tail"), (2, " ".join(item.split()[:16])), (3, " ".join(item.split()[:15])),
            (4, "one two"), (5, "zero one two"), (None, item), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0)).withColumn("shingles", F.lit(0))
    items = spark.createDataFrame([(1, item), (2, "ONE  two"), (3, None), (4, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shingles, r.n_shared) for r in decontam.contaminated(docs, items).collect()}
    assert got == {(d, i): (16, n) for d, n in ((1, 16), (2, 12), (None, 16)) for i in (1, 4)} | {(4, 2): (1, 1)}
    assert sorted(r.doc_id or 0 for r in decontam.drop_contaminated(docs, items).collect()) == [0, 3, 5, 6, 7]


def test_url_cases(spark):
    rules = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/es/", "allow"), ("a.b.c/x", "block")]
    urls = [(1, "http://WWW.Example.ORG/es/1?q#f"), (2, "http://example.org"), (3, None), (4, "no scheme/es/"), (5, "x://a.b.c/xyz"),
            (6, "x://z.a.b.c/x"), (7, "x://b.c/x"), (8, "https://borg/"), (9, "a://b://c.org/"), (10, "http://example.org/ES/"), (10, "http://example.org/ES/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit("x")).withColumn("host", F.lit("y"))
    r = spark.createDataFrame(rules, "rule string, verdict string")
    want = [(1, "www.example.org", "/es/1", "example.org/es/", "block"), (2, "example.org", "", None, "allow"), (3, "", "", None, "allow"),
            (4, "", "", None, "allow"), (5, "a.b.c", "/xyz", "a.b.c/x", "block"), (6, "z.a.b.c", "/x", "a.b.c/x", "block"), (7, "b.c", "/x", None, "allow"),
            (8, "borg", "/", None, "allow"), (9, "b:", "//c.org/", None, "allow"), (10, "example.org", "/ES/", "org/", "allow")]
    for keys in (2_000_000, 1):                                                     # one pass, and one per shard
        assert sorted({tuple(x) for x in url_filter.judge_urls(pages, r, max_keys=keys).collect()}) == want


def test_cascade_is_exact(spark):
    marked = common.materialize(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 37 == 0).alias("listed")), "marked")
    levels = url_filter.build_cascade(marked)
    assert len(levels) > 1
    assert marked.where(url_filter.member(levels, F.col("key")) != F.col("listed")).count() == 0


def test_warc_cases(spark, tmp_path):
    pages = [(3, "u3", "same"), (1, "http://a/\r\nx", "same"), (2, None, None), (4, "u4", ""), (5, "u5", "é\r\n\r\nWARC/1.1\r\n\r\n"), (6, "u6", "\r\n"),
             (7, "u7", "\r\n\r\n\r\n"), (8, "u8", "x" * 200_000), (3, "u3", "same"), (None, "n", "same"), (None, "m", "only null")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("first", F.lit(1))
    warc.write_archives(df, f"{tmp_path}/w")
    rows = warc.read_archives(spark, f"{tmp_path}/w").collect()
    got = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to, bytes(r.payload)) for r in rows}
    assert len(rows) == len(pages)
    assert got[(1, 4)] == ("response", None, b"same") and got[(3, 4)] == ("revisit", 1, b"") and got[(None, 4)] == ("revisit", 1, b"")
    assert got[(2, 0)] == ("response", None, b"") and got[(4, 0)] == ("revisit", 2, b"") and got[(None, 9)] == ("response", None, b"only null")
    for d, _, html in pages[4:8]:
        assert got[(d, len(html.encode()))] == ("response", None, html.encode())
    warc.write_archives(df, f"{tmp_path}/v", min_bytes=5)
    assert {r.record_type for r in warc.read_archives(spark, f"{tmp_path}/v").where("payload_bytes < 5").collect()} == {"response"}


def test_warc_payloads_that_end_in_crlf(spark, tmp_path):
    """One record a file, all files read by one task."""
    pages = [(i, f"u{i}", f"page {i}" + end) for i, end in enumerate(["\r\n", "", "\r\n\r\n", "\r\n\r\n\r\n", "\n", "\r", "\r\n", "x"])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    warc.write_archives(df, f"{tmp_path}/w", records_per_file=1)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        read = warc.read_archives(spark, f"{tmp_path}/w")
        assert read.rdd.getNumPartitions() == 1
        assert {(r.page_id, bytes(r.payload).decode()) for r in read.collect()} == {(i, html) for i, _, html in pages}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    with pytest.raises(ValueError):
        list(warc._records([b"junk", b"WARC/1.1"]))
    with pytest.raises(ValueError):
        list(warc._records([b"WARC/1.1\r\nContent-Length: 50", b"short"]))


def test_tokens_cases(spark, docs, tmp_path):
    for encoding in ("dictionary", "delta"):
        path = f"{tmp_path}/{encoding}"
        tokens.write_tokens(docs, path, tokens.tokenizer_path(), encoding=encoding)
        rows = tokens.token_digests(spark, path).collect()
        assert len(rows) == len(ROWS) and sum(r.n_tokens for r in rows) == max(r.start + r.n_tokens for r in rows)
        assert {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {1}
        index = tokens.read_index(spark, path)
        assert {(r.doc_id, r.start) for r in index.collect() if r.doc_id != 5} == {(r.doc_id, r.start) for r in rows if r.doc_id != 5}
        assert sorted(r.doc_id for r in tokens.read_tokens(spark, path, 5, 7).select("doc_id").collect()) == [5, 5, 6, 7]


def test_tokens_of_mixed_scripts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    from spanmask.llm.hashing import text_parts
    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    random.seed(5)
    bits = ["a", "B", "é", " ", "  ", "\n", "\r\n", "\t", ".", ",", "'", "'s", "n't", "\u2019", "\u00a0", "\u3000", "\u2003", "漢", "😀", "1", "22", "!!",
            "\x1c", "\x85", "\u200b", "_", "the", " The", "Ω", "٣", "<|endoftext|>", "\x00"]
    texts = ["".join(random.choice(bits) for _ in range(random.randint(0, 25))) for _ in range(4000)]
    got = [x for _, buf, off in text_parts(pa.array(texts)) for x in tokens.encode_parts(buf, off, tokens.tokenizer_path())]
    assert [np.frombuffer(x, np.int32).tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_tokens_added_to_the_vocabulary(spark, tmp_path):
    from tokenizers import Tokenizer
    ship_package(spark)
    t = Tokenizer.from_file(tokens.tokenizer_path())
    texts = ["a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x\n", "", "<|endof", "text|>", "<|<|endoftext|>|>", "no end", "é <|endoftext|>漢"]
    tokens.write_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), f"{tmp_path}/t", tokens.tokenizer_path())
    got = {r.doc_id: list(r.ids) for r in tokens.read_tokens(spark, f"{tmp_path}/t").collect()}
    assert got == {d: t.encode(x, add_special_tokens=False).ids + [tokens.END_ID] for d, x in enumerate(texts)}


def test_sentencepiece_round_trip(spark, docs):
    path = sentencepieces.vocabulary_path()
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(20, "x" * 5000), (21, "a    b\n\n\tc   "), (22, " lead"), (23, "\x00é\u0301")], "doc_id long, text string"))
    back = {(r.doc_id, r.text) for r in sentencepieces.decode(sentencepieces.encode(more, path), path).collect()}
    assert back == {(r.doc_id, r.text or "") for r in more.collect()}


def test_lattice_equals_the_recurrence(spark):
    ship_package(spark)
    v, random_ = sentencepieces.vocabulary(sentencepieces.vocabulary_path()), random.Random(2)
    words = {"".join(random_.choice("▁theraionsé漢ق") for _ in range(random_.randint(2, 30))) for _ in range(300)} | {"▁▁▁▁the", "\n\n"}
    got = sentencepieces.lattice(spark.createDataFrame([(w,) for w in words], "segment string"), sentencepieces.vocabulary_path()).collect()
    assert {r.segment: v.spelled(r.segment, r.ids) for r in got} == {w: v.path_ids(w) for w in words}


def thue_morse(n, swap=False):
    """Words that polynomial hashes modulo a power of two cannot tell from their complements."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def plain_pieces(text, names, score, byte, longest):
    """Viterbi over a whole text, without cutting it; the earliest start on ties."""
    t = "▁" + text.replace(" ", "▁") if text else ""
    best = [(0, 0, [])]
    for e in range(1, len(t) + 1):
        options = []
        for s in range(max(0, e - longest), e):
            i = names.get(t[s:e])
            if i is not None:
                options.append((best[s][0] + score[i], -s, [i]))
            elif e - s == 1:
                options.append((best[s][0] + min(score.values()) - 10, -s, [byte[b] for b in t[s:e].encode()]))
        best.append(max(options, key=lambda o: o[:2]))
    out, e = [], len(t)
    while e:
        out.append(best[e][2])
        e = -best[e][1]
    return [i for part in reversed(out) for i in part]


def test_pieces_equal_a_plain_viterbi(spark, docs):
    import sentencepiece
    path = sentencepieces.vocabulary_path()
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    names, score = {sp.id_to_piece(i): i for i in plain}, {i: int(sp.get_score(i)) for i in plain}
    byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    texts = [r.text for r in docs.collect() if r.text and len(r.text) < 3000][:40] + [thue_morse(1024), thue_morse(1024, True), "漢字とقلم and 𝄞 " * 9, None, ""]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, "two null ids"), (None, "other text")]
    got = sentencepieces.encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    want = [(d, plain_pieces(t or "", names, score, byte, max(map(len, names)))) for d, t in rows]
    assert sorted(map(repr, [(r.doc_id, list(r.ids)) for r in got])) == sorted(map(repr, want))


def test_words_that_collide_in_polynomial_hashes(spark):
    rows = [(d, " ".join([thue_morse(n, d % 2), "and", "five", "words", "alike", "here"])) for d, n in enumerate([1024, 1024, 4096, 4096, 8192, 8192])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(df).collect()} == {(d, d) for d, _ in rows}
    path = sentencepieces.vocabulary_path()
    assert sorted(tuple(r) for r in sentencepieces.decode(sentencepieces.encode(df, path), path).collect()) == rows


def test_written_tables_restore_the_session(spark):
    before = spark.conf.get(common.CLEANUP)
    t = common.materialize(spark.range(1000).groupBy("id").count(), "counts")
    assert t.count() == 1000 and spark.conf.get(common.CLEANUP) == before


def test_scores_of_odd_rows(docs, labels):
    for scores in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        rows = scores.collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)


def test_label_model_weighs_families():
    """Ten copies of one voter count about as much as one; posteriors follow the better voters."""
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.1).astype(float)
    good = [(rng.random(4000) < np.where(y > 0, 0.6, 0.002)) for _ in range(5)]
    family = rng.random(4000) < np.where(y > 0, 0.2, 0.15)
    v = np.stack([*good, *[family] * 10], axis=1).astype(float)
    p, rate, weight = toxicity.label_model(np.hstack([v, y[:, None]]), y)
    assert weight[5:15].sum() < 1.2 and weight[:5].min() > 0.8
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.97


def test_stages_tell_rows_with_one_id_apart(spark):
    ship_package(spark)
    one, two, three, four = (" ".join(f"{c}{i}" for i in range(30)) for c in "abcd")
    rows = [(None, one), (None, two), (None, one), (1, three), (2, three), (2, four), (2, four)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted([one, two, three, four])
    assert sorted(r.text for r in exact_dedup.drop_copies(df).collect()) == want
    assert sorted(r.text for r in near_dup.keep_one(df).collect()) == want
    items = spark.createDataFrame([(1, two), (2, three)], "item_id long, text string")
    clean = decontam.drop_contaminated(df, items, null_ids=True).collect()
    assert sorted(r.text for r in clean) == sorted([one, one, four, four])


def test_near_duplicates_among_mosaics(spark):
    """Documents of 7 of 18 passages: keys have many members and different hubs, and a similar pair can be no hub's."""
    ship_package(spark)
    rnd, rows = random.Random(1), []
    passages = [[f"p{i}_{j}" for j in range(12)] for i in range(18)]
    for d in range(1500):
        w = [x for i in rnd.sample(range(18), 7) for x in passages[i]]
        rows += [(2 * d, " ".join(w + [f"o{d}_{j}" for j in range(7)])), (2 * d + 1, " ".join(w + [f"f{d}_{j}" for j in range(7)]))]
    sets = [shingles(t) for _, t in rows]
    assert all(100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets[::2], sets[1::2]))
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [d for d in range(0, 3000, 2) if got[d] != got[d + 1]] == []
