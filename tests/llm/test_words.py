"""Operators 11 to 13 against the library, SQL and brute force, with their edge cases."""
import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as E
from spanmask.llm import ranked_search, spelling, word_bpe, words
from spanmask.session import ship_package

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, ids string, word string, n long, row string, term string, query long, shard int, score double, rank string"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(word_bpe.vocabulary_path())
    t.no_padding()
    t.no_truncation()
    return t


@pytest.fixture(scope="module")
def rows():
    return duckdb.sql(f"select doc_id, text from read_parquet('{SF}/documents.parquet')").fetchall()


@pytest.fixture(scope="module")
def make(spark):
    ship_package(spark)
    return lambda rows: spark.createDataFrame([(d, t, "i", "w", 1, "r", "t", 2, 3, 0.5, "k") for d, t in rows], CLASHING)


@pytest.mark.parametrize("name", ["op12_ranked_search", "op13_spelling_variants"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_matches_sql(spark, name, sf):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from read_parquet('/root/testdata/{sf}/{t}.parquet')")
    got = E.queries()[name](spark, f"/root/testdata/{sf}")
    want = c.execute(E.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_word_bpe_matches_the_library(spark, library, rows):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = E.queries()["op11_word_bpe"](spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


PARTS = ["a", "A", "in", "th", "the", "aaaa", "hhh", "'s", "'S", "'LL", "İ", "ß", "ẞ", "é", "é", "×", "÷", "ﬁ", "漢字", "😀", " ", "\n", "\u0085", "\xa0", "​", "\x1c",
         "\x00", "\x7f", "12", "Ⅻ", "٣", "²", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "_", "-", "̸", "≠", "ǅ", "Σ", "ΑΣ"]


def test_word_bpe_on_mixed_scripts(library):
    random.seed(3)
    path = word_bpe.vocabulary_path()
    for _ in range(4000):
        s = "".join(random.choice(PARTS) for _ in range(random.randint(0, 14)))
        ids = np.frombuffer(word_bpe.encoder(path).encode(s.encode()), np.int32)
        assert ids.tolist() == library.encode(s, add_special_tokens=False).ids, s
        assert word_bpe.decode_ids(ids, path).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 70_001, "ab" * 40_000, "thein" * 20_000 + "é" * 9_999, "ha" * 33_000 + " " + "x" * 5])
def test_word_bpe_words_longer_than_a_block(library, text):
    ids = np.frombuffer(word_bpe.encoder(word_bpe.vocabulary_path()).encode(text.encode()), np.int32)
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(30))
def test_backtracking_equals_merging_in_rank_order(seed):
    """Small random merge models, in which tokens that never come out and dead ends are common."""
    rng = random.Random(seed)
    vocab = {c + e: i for i, (c, e) in enumerate((c, e) for e in ("", "$") for c in "abc")}
    merges = []
    while len(merges) < 25:
        a, b = rng.choice([t for t in vocab if not t.endswith("$")]), rng.choice(list(vocab))
        if a + b not in vocab and len(a + b) < 8:
            vocab[a + b] = len(vocab)
            merges.append([a, b])
    model = word_bpe.Merges(vocab, merges, "$")
    rank = {tuple(m): i for i, m in enumerate(merges)}
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        parts = [*w[:-1], w[-1] + "$"]
        while True:
            known = [(rank[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in rank]
            if not known:
                break
            _, i = min(known)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        assert model.encode(w) == [vocab[p] for p in parts], w


CASES = [(1, "the quick fox"), (2, None), (3, ""), (4, " \t\n"), (5, "the quick fox"), (5, "the quick fox"), (None, "Quick"), (7, "quick " * 50_000), (8, "漢字 ñandú")]


def test_word_bpe_cases(spark, make, library):
    out = word_bpe.decode(word_bpe.encode(make(CASES)))
    got = sorted((str(r.doc_id), r.ids, r.text) for r in out.collect())
    want = []
    for d, t in CASES:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((str(d), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert word_bpe.digests(word_bpe.decode(word_bpe.encode(make([])))).count() == 0
    null = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in word_bpe.decode(null).collect()] == [(1, [], "")]


def test_slices_keep_words_whole():
    text = b" ".join(b"w%d" % i for i in range(1000)) + b"\t" + b"x" * 500
    for size in (1, 7, 100, 10_000):
        parts = list(words.slices(text, size))
        assert b"".join(parts) == text and [w for p in parts for w in p.split()] == text.split()


def scores(docs, queries, top=20):
    """Plain scoring of every document for every query, in input order of ties after doc_id."""
    import math
    term = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tf = [collections.Counter(term.findall((t or "").translate(low))) for _, t in docs]
    df = collections.Counter(x for f in tf for x in f)
    n, total = sum(map(bool, tf)), sum(sum(f.values()) for f in tf)
    out = []
    for item, q in queries:
        found = []
        for k, ((d, _), f) in enumerate(zip(docs, tf)):
            s = 0
            for x in term.findall((q or "").translate(low)):
                if f[x]:
                    m = 75 + 25 * sum(f.values()) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * f[x] // (1000 * f[x] + 12 * m))
            if s:
                found.append((-s, d is not None, d or 0, k, d))
        out += [(item, r + 1, x[4], -x[0]) for r, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def test_ranked_search_cases(spark, make):
    schema = "item_id long, text string, query string, term string, score int"
    queries = [(1, "quick fox fox"), (2, None), (3, ""), (4, "nothing like it"), (5, "ÑANDÚ ñandú the"), (5, "THE"), (None, "fox")]
    items = spark.createDataFrame([(i, t, "q", "t", 0) for i, t in queries], schema)
    docs = make(CASES).coalesce(1)
    got = ranked_search.ranked_search(docs, items)
    assert sorted(map(tuple, got.collect()), key=repr) == scores(CASES, queries)
    assert ranked_search.ranked_search(make([]), items).count() == 0
    assert ranked_search.ranked_search(docs, items.limit(0)).count() == 0
    assert ranked_search.ranked_search(make([(1, None), (2, "..")]), items).count() == 0


def test_ranked_search_ties_blocks_and_shards(spark, make, monkeypatch):
    """Many equal scores at the border of the result, over several shards and several blocks of queries."""
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(30)]
    docs = [(random.randrange(200), " ".join(random.choices(vocabulary, range(30, 0, -1), k=random.choice([3, 3, 8, 40])))) for _ in range(300)] + [(900, "w1 w2 w3")] * 60
    docs = list({(d, t): None for d, t in docs}) + [(900, "w1 w2 w3")] * 30        # repeated rows have one place each
    queries = [(i, " ".join(random.choices(vocabulary, k=random.choice([1, 4, 25])))) for i in range(12)]
    items = spark.createDataFrame(queries, "item_id long, text string")
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 37)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)
    got = ranked_search.ranked_search(make(docs), items, top=7)
    assert sorted(map(tuple, got.collect()), key=repr) == scores(docs, queries, 7)


@pytest.mark.parametrize("seed", range(20))
def test_intervals_close_on_the_exact_best(seed):
    rng = np.random.default_rng(seed)
    n, k, lists = 400, 5, 6
    entries = [(d, int(rng.integers(1, 30) * 10 ** rng.integers(0, 3)), t) for t in range(lists) for d in rng.choice(n, rng.integers(1, n), replace=False)]
    doc, impact, of = (np.array(x) for x in zip(*entries))
    total = np.bincount(doc, impact, n).astype(int)
    top = np.array([impact[of == t].max() for t in range(lists)])
    found, score = ranked_search.resolve(doc, impact, of, top, n, k)
    kth = np.sort(total)[-k]
    assert set(np.flatnonzero(total >= max(kth, 1))) <= set(found) and (total[found] == score).all()


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def test_near_pairs_against_all_pairs(spark):
    """Words over few letters, so that repeats, shifted chunks and several keys a pair are common."""
    random.seed(7)
    vocabulary = sorted({"".join(random.choice("aabé") for _ in range(random.randint(6, 9))) for _ in range(500)})
    df = spark.createDataFrame([(w, 5) for w in vocabulary], "word string, n long")
    got = [frozenset((r.a, r.b)) for r in spelling.near_pairs(df).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in vocabulary for b in vocabulary if near(a, b)}


def test_spelling_cases(make):
    rows = [(1, "kitten " * 625), (2, "Kittén " * 125), (3, "kittéñ " * 25 + "kittéññ " * 5), (None, "kitxen " * 5), (4, None), (5, ""), (6, "short abcdeé"), (7, "x" * 300_000)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_forms(make(rows), drop_every=1 << 40).collect()}
    assert got == {"kitten": (None, "kitten", 625, 2, None), "kittén": ("kitten", "kitten", 125, 2, 625), "kittéñ": ("kittén", "kitten", 25, 2, 125),
                   "kittéññ": ("kittéñ", "kitten", 5, 1, 25), "kitxen": ("kitten", "kitten", 5, 1, 625)}
    assert spelling.spelling_forms(make([])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_forms(make([]), min_length=5)


def test_misspelt_runs(make):
    """The share of runs that lose a code point, by document and run; a null id is the empty text."""
    rows = [(d, "Straße ÉTAGÈRE abcdefgh zzzzzzzz " * 3) for d in [None, *range(200)]] + [(5, "abcdefgh")]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = collections.Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 7 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            want[w] += 1
    got = spelling.word_counts(make(rows), drop_every=7)
    assert {r.word: r.n for r in got.collect()} == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5}


def test_starts_are_places_in_the_files(spark, make, tmp_path):
    """Rows of one id stand in the files as their starts say."""
    from spanmask.llm import tokens
    rows = [(d, f"text {i} " * (i % 7)) for i, d in enumerate([3, None, 1, 3, 3, 2] * 12)]
    tokens.write_tokens(make(rows), f"{tmp_path}/t", tokens.tokenizer_path())
    files = spark.read.parquet(f"{tmp_path}/t").orderBy("part", "pos").collect()
    flat = [i for r in files for i in r.ids]
    index = tokens.read_index(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [(r.part, r.pos) for r in index] == [(r.part, r.pos) for r in files]
    for r, f in zip(index, files):
        assert flat[r.start:r.start + r.n_tokens] == f.ids and f.ids[-1] == 2
    digests = tokens.token_digests(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [(r.start, r.ids_crc32) for r in digests] == [(r.start, zlib.crc32(np.array(f.ids, "<u4").tobytes())) for r, f in zip(index, files)]
    assert [r.doc_id for r in files] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d or 0))
