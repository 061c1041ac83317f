"""Byte-pair encoding of whole texts by backtracking, and decoding by an offset table.

A text is cut at white space and added tokens, each distinct chunk is normalised
and pre-tokenised once, and each distinct word is encoded once: an Aho-Corasick
automaton over the vocabulary finds all tokens that begin at each place; the
longest one that is compatible with the token before it is taken, and a place
where none is compatible is a dead end, given up for good.  Two tokens are
compatible if no merge of lower rank would have joined pieces across their
border; answers are kept in a table by pair.  A run of tokens in which all
neighbours are compatible is the one that merging in rank order gives, so a
place is visited once, and the time is linear in the text.

Decoding gathers the tokens' strings from one blob by an offset table and joins
them by a space, as a tokenizer without a decoder does.

Cases: null and empty texts have no ids and decode to the empty text; an added
token of the tokenizer that a text holds is its own id; texts are cut into
slices, so a long one takes no more memory than its ids; rows are taken one by
one, so null and repeated ids, ties and repeated rows stay as they are; an
empty table gives no rows; other columns are ignored, whatever their names.
"""
from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import tokenizer_path
from .words import lists, slices, strings, texts_of

END = "\0"                      # stands for the word-end mark; byte-level words hold no such character
CACHE, LONG = 250_000, 256      # chunks and pieces kept at hand; longer ones are not
PAIRS = 2_000_000
BLOCK = 1 << 15
SLICE_IDS = 1 << 18
#: Chunks of these characters are their own normal form; the pieces are the pre-tokenizer's, for lower-cased text of them.
_LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    return tokenizer_path(name)


class Merges:
    """Vocabulary, automaton and pair table of a merge model with a word-end mark."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], mark: str):
        import ahocorasick
        size = max(vocab.values()) + 1
        self.rank: dict[tuple[int, int], int] = {}
        self.left, self.right, self.born = [-1] * size, [-1] * size, [-1] * size
        usable = {i for t, i in vocab.items() if len(t.removesuffix(mark)) == 1}
        for r, (a, b) in enumerate(merges):
            x, y, t = vocab[a], vocab[b], vocab[a + b]
            if self.born[t] >= 0 or r <= max(self.born[x], self.born[y]):
                raise ValueError("each token must come from one merge, later than those of its parts")
            self.rank[x, y], self.left[t], self.right[t], self.born[t] = r, x, y, r
        self.size = [0] * size
        self.table: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.longest = 1
        for t, i in sorted(vocab.items(), key=lambda e: self.born[e[1]]):
            text = t.removesuffix(mark) + END if t.endswith(mark) and t != mark else t
            self.size[i] = len(text)
            # a token that its own text does not merge into can never come out
            if i not in usable and self.left[i] in usable and self.right[i] in usable and self._apart(self.left[i], self.right[i], self.born[i]):
                usable.add(i)
            if i in usable:
                self.automaton.add_word(text, (i, len(text)))
                self.longest = max(self.longest, len(text))
        self.automaton.make_automaton()

    def _apart(self, a: int, b: int, until: int) -> bool:
        """No merge of rank below ``until`` joins a piece at the end of ``a`` with one at the beginning of ``b``.

        The pieces at the border are those of the two derivations; a piece lasts
        until its own merge, on the left also where that merge has the same rank
        (equal pairs merge from the left).
        """
        x, x_dies = a, until
        while x >= 0:
            y, y_dies = b, until
            while y >= 0:
                r = self.rank.get((x, y))
                if r is not None and r < x_dies and r <= y_dies and r < until:
                    return False
                y_dies, y = self.born[y], self.left[y]
            x_dies, x = self.born[x], self.right[x]
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` can stand behind ``a``; the answer goes into the pair table."""
        if len(self.table) > PAIRS:
            self.table.clear()
        found = self.table[a << 32 | b] = self._apart(a, b, 1 << 62)
        return found

    def _begins(self, text: str, first: int, last: int) -> list[list[int]]:
        """For each place of ``first .. last`` the tokens that begin there, shortest first."""
        out: list[list[int]] = [[] for _ in range(first, last)]
        shift, width = 1 - first, last - first
        for end, (t, size) in self.automaton.iter(text, first, min(len(text), last + self.longest)):
            at = end - size + shift
            if at < width:
                out[at].append(t)
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of one byte-level word."""
        text = word + END
        n, size, table = len(text), self.size, self.table
        out: list[int] = []
        picks: list[int] = []
        dead: set[int] = set()
        base = width = 0                                # the block of places whose tokens are at hand
        at, pick, before = 0, -2, -1
        while at < n:
            if not base <= at < base + width:
                base = at // BLOCK * BLOCK
                width = min(n - base, BLOCK)
                block = self._begins(text, base, base + width)
            here = block[at - base]
            if pick == -2:
                pick = len(here) - 1
            while pick >= 0:
                t = here[pick]
                if at + size[t] not in dead:
                    if before < 0:
                        break
                    good = table.get(before << 32 | t)
                    if good or good is None and self.compatible(before, t):
                        break
                pick -= 1
            if pick >= 0:
                out.append(t)
                picks.append(pick)
                at, pick, before = at + size[t], -2, t
            else:
                if not out:
                    raise ValueError("a character is not in the vocabulary")
                dead.add(at)
                at -= size[out.pop()]
                pick, before = picks.pop() - 1, out[-1] if out else -1
        return out


class Encoder:
    """Packed ids of chunks (runs without ASCII white space), with the library's own normaliser and pre-tokenizer."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        if model["type"] != "BPE" or model["dropout"] or model["continuing_subword_prefix"] or not model["end_of_word_suffix"] or model["ignore_merges"]:
            raise ValueError("a merge model with a word-end mark is expected")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only added tokens that stand for their literal text are handled")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        library = Tokenizer.from_file(path)
        self.normalise, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.pattern = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + b")") if self.added else None
        if any(self.cut(chr(i))[0][0] != chr(i) for i in range(0x21, 0x7F)):
            raise ValueError("a byte-level pre-tokenizer is expected")
        self.pieces, self.new, self.old = {}, {}, {}

    def _piece(self, w: str) -> bytes:
        """Ids of a piece of plain text; its byte-level form is the pre-tokenizer's."""
        ids = self.pieces.get(w)
        if ids is None:
            ids = array("i", self.merges.encode(w if w.isascii() else self.cut(w)[0][0])).tobytes()
            if len(w) < LONG:
                if len(self.pieces) > CACHE:
                    self.pieces.clear()
                self.pieces[w] = ids
        return ids

    def _plain(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _LATIN.fullmatch(text):
            return b"".join(map(self._piece, _PIECES.findall(text.lower())))
        return b"".join(array("i", self.merges.encode(w)).tobytes() for w, _ in self.cut(self.normalise(text)))

    def _chunk(self, chunk: bytes) -> bytes:
        if self.pattern and self.pattern.search(chunk):
            return b"".join(array("i", [self.added[p]]).tobytes() if p in self.added else self._plain(p) for p in self.pattern.split(chunk) if p)
        return self._plain(chunk)

    def encode(self, text: bytes) -> bytes:
        """Packed 32-bit ids of a whole text."""
        out = []
        for part in slices(text):
            chunks = part.split()
            if len(self.new) > CACHE:
                self.old, self.new = self.new, {}
            new, old, long = self.new, self.old, []
            for c in set(chunks).difference(new):
                ids = old.get(c)
                new[c] = self._chunk(c) if ids is None else ids
                if len(c) > LONG:
                    long.append(c)
            out += map(new.__getitem__, chunks)
            for c in long:
                del new[c]
        return b"".join(out)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def decode_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' strings, each with a space behind it, in one blob, and where each begins (one more at the end)."""
    spec = json.loads(open(path, encoding="utf-8").read())
    if spec["decoder"] is not None:
        raise ValueError("a tokenizer without a decoder is expected")
    tokens = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    texts = [(tokens[i] + " ").encode() if i in tokens else b"" for i in range(max(tokens) + 1)]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """Text of one document's ids."""
    blob, at = decode_table(path)
    out = []
    for i in range(0, len(ids), SLICE_IDS):
        some = ids[i:i + SLICE_IDS]
        n = at[some + 1] - at[some]
        total = np.cumsum(n)
        if len(n):
            out.append(blob[np.repeat(at[some] - (total - n), n) + np.arange(total[-1])].tobytes())
    return b"".join(out)[:-1]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of every row."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, texts in texts_of(b):
                packed = [encoder(path).encode(t) for t in texts]
                ids = lists(pa.array(np.frombuffer(b"".join(packed), np.int32)), [len(p) // 4 for p in packed])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, len(texts)), ids], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text of every row of ids; null ids decode to the empty text."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            off, flat = np.asarray(ids.offsets), np.asarray(ids.values)
            some: list[bytes] = []
            first = size = 0
            for i in range(len(ids) + 1):
                if i == len(ids) or size > 8 << 20:
                    if some:
                        yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(some)), ids.slice(first, len(some)), strings(some)],
                                                         ["doc_id", "ids", "text"])
                    some, first, size = [], i, 0
                if i < len(ids):
                    some.append(decode_ids(flat[off[i]:off[i + 1]], path))
                    size += len(some[-1])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(ids_col, F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                          F.sha2(F.col("text"), 256).alias("decoded_sha256"))
