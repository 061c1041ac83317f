"""Registered queries against their DuckDB SQL, brute force, exact round trips or held-out accuracy."""
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as E
from spanmask.llm import sentencepieces as SP
from spanmask.llm.tokens import tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select doc_id, text from documents order by doc_id").fetchall()


def name_of(n):
    return next(k for k in E.queries() if k.startswith(f"op{n}_"))


def norm(v):
    return "∅" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("n", [2, 5, 6, 10])
def test_matches_sql(spark, con, n):
    df = E.queries()[name_of(n)](spark, SF)
    got = con.execute(E.oracle_sql()[name_of(n)])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    order = sorted(cols)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in order) for r in got.fetchall())
    assert sorted(tuple(norm(x) for x in r) for r in df.select(order).collect()) == want


def brute_repeats(texts, length=100):
    seen, out = set(), []
    for t in texts:
        cover = np.zeros(len(t) + 1, int)
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            if w in seen:
                cover[p:p + length] = 1
            seen.add(w)
        on = cover[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        kept = np.frombuffer(t, np.uint8)[~on].tobytes()
        out.append((len(t), int(on.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, docs):
    want = dict(zip([d for d, _ in docs], brute_repeats([(t or "").encode() for _, t in docs])))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in E.queries()[name_of(1)](spark, SF).collect()}
    assert got == want
    assert any(v[1] for v in want.values())


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    """doc_id -> (set size, component) by comparing all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    where, root = collections.defaultdict(list), list(range(len(sets)))
    for i, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in {(a, b) for v in where.values() for a in v for b in v if a < b}:
        both = len(sets[a][1] & sets[b][1])
        if 100 * both >= 75 * len(sets[a][1] | sets[b][1]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def test_near_duplicates(spark, docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in E.queries()[name_of(8)](spark, SF).collect()}
    assert got == brute_components(docs)


def test_token_files(spark, docs):
    from tokenizers import Tokenizer
    t, start, want = Tokenizer.from_file(tokenizer_path()), 0, {}
    for d, x in docs:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[d] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in E.queries()[name_of(9)](spark, SF).collect()} == want


def test_sentencepiece(spark, docs):
    v, want = SP.vocabulary(SP.vocabulary_path()), {}
    for d, x in docs:
        ids = [i for s in v.segments([x])[0] for i in (v.own(s) or v.path_ids(s))]
        want[d] = (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), hashlib.sha256((x or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_pieces, r.ids_crc32, r.decoded_sha256) for r in E.queries()[name_of(7)](spark, SF).collect()} == want


def test_sentencepiece_agrees_with_the_library(docs):
    """The library's own lattice over the same pieces and scores, word by word."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb
    m = pb.ModelProto()
    with open(SP.vocabulary_path(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1                       # the lattice instead of merges
    lib = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    v = SP.vocabulary(SP.vocabulary_path())
    for w in {w for _, x in docs[:60] for w in x.split(" ")} - {""}:
        ids = [i for s in v.segments([w])[0] for i in (v.own(s) or v.path_ids(s))]
        assert b"".join(v.raw[i] for i in ids).decode().replace("▁", " ")[1:] == w
        if any(i in v.byte for i in ids) or ids[0] == v.pieces["▁"][0]:
            continue                                    # the library's sums lose units beside scores of -1e9
        total = lambda pieces: sum(int(lib.get_score(lib.piece_to_id(p))) for p in pieces)
        assert total(lib.id_to_piece(i) for i in ids) == total(lib.nbest_encode_as_pieces(w, 2)[0])       # paths may tie


def held_out_scores(spark, name, label, mod, rest):
    sf = "/root/testdata/sf0.1"
    labels = dict(duckdb.sql(f"select doc_id, {label} from '{sf}/labels.parquet'").fetchall())
    rows = E.queries()[name](spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) and 0 <= r.score <= 1 for r in rows)
    return [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]


def test_toxicity_on_held_out_rows(spark):
    x = held_out_scores(spark, name_of(3), "toxic", 4, 2)
    found, wrong, all_ = sum(p and y for p, y in x), sum(p and not y for p, y in x), sum(y for _, y in x)
    assert found / all_ > 0.7 and wrong / len(x) < 0.01


def test_quality_on_held_out_rows(spark):
    x = held_out_scores(spark, name_of(4), "quality", 3, 1)
    assert sum(p == y for p, y in x) / len(x) > 0.98
    assert sum(p for p, y in x if y) / sum(y for _, y in x) > 0.99          # clean documents stay


def test_pipeline(spark, con, docs):
    """All stages against plain Python; the quality verdicts are taken from the operator's scores."""
    import corpus_pipeline
    good = {r.doc_id for r in E.queries()[name_of(4)](spark, SF).collect() if r.predicted}
    left = [(d, t) for d, t in docs if d in good]
    best = {}
    for d, t in left:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0)), (-len(t or ""), d))
    left = [(d, t) for d, t in left if d in {d for _, d in best.values()}]
    comp = brute_components(left)
    left = [(d, t) for d, t in left if comp[d][1] == d]
    items = [s for s in (shingles(t) for (t,) in con.execute("select text from benchmark").fetchall()) if s]
    left = [(d, t) for d, t in left if not any(100 * len(s & shingles(t)) >= 75 * len(s) for s in items)]
    v = SP.vocabulary(SP.vocabulary_path())
    want = {d: [i for s in v.segments([t])[0] for i in (v.own(s) or v.path_ids(s))] for d, t in left}
    got = {r.doc_id: (r.n_pieces, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in want.items()}
