"""Operator 1: records of a hot key are taken window by window only where blocks share their cores."""
import random

from test_queries import brute_repeats

from spanmask.llm import suffix_dedup
from spanmask.session import ship_package


def _removed_and_windows(spark, monkeypatch, texts):
    written, plain = {}, suffix_dedup.materialize

    def kept(df, name):
        written[name] = plain(df, name)
        return written[name]

    monkeypatch.setattr(suffix_dedup, "materialize", kept)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(df, batches=1).collect()}
    return got, written["blocks"].count(), written["windows"].count()


def test_blocks_that_share_no_core_make_no_windows(spark, monkeypatch):
    ship_package(spark)
    random.seed(3)
    noise = lambda n: "".join(random.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(60)                                              # too short to be removed
    texts = [noise(120) + passage + noise(120) for _ in range(300)]
    got, blocks, windows = _removed_and_windows(spark, monkeypatch, texts)
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts])))
    assert blocks > 300 and windows == 0


def test_windows_of_a_hot_key_cut_at_all_places(spark, monkeypatch):
    ship_package(spark)
    random.seed(4)
    noise = lambda n: "".join(random.choice("abcdefghijklmnop ") for _ in range(n))
    passage = noise(160)
    texts = []
    for _ in range(300):
        a = random.randint(0, 70)
        texts.append(noise(random.randint(0, 90)) + passage[a:a + random.randint(60, 160)] + noise(random.randint(0, 90)))
    got, blocks, windows = _removed_and_windows(spark, monkeypatch, texts)
    assert got == dict(enumerate(brute_repeats([t.encode() for t in texts])))
    assert blocks and windows and any(v[1] for v in got.values())
