"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

Each word is a row of symbols; leaf i of the tree holds the merge rank of symbols i and i+1, every
inner node the smaller (rank, position) below it, so the root is the leftmost merge of lowest rank.
A merge links the neighbours and updates three leaves in O(log n), until the root holds no rank. A word
of n bytes so costs O(n log n), however long it is.

Texts are prepared as the tokenizer file says (NFC, white space dropped, lower case, splits, bytes as
letters). Texts of Latin letters take a fast path in Python; any other character goes through the
library's own normaliser and splitter, so that its Unicode tables decide. Special tokens are cut out of
the raw text first, as in the library.

Edge cases: null text counts as empty (0 tokens, decodes to ""); the digest columns of empty texts are
the SHA-256 of nothing; repeated rows are encoded each; very long words are encoded whole, by the tree; of equal ranks the leftmost
pair merges first; further columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from keelson.llm.common import map_chunks

NONE = 1 << 62
CACHE = 400_000
PLAIN = re.compile("[^\x00-ɏ‐-‧]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b) if b in keep else chr(256 + extra))
        extra += b not in keep
    return out


class PairTree:
    """Segment tree over adjacent pairs; keys are rank * width + position, so ties go to the left."""

    __slots__ = ("after", "before", "merges", "size", "symbols", "tree")

    def __init__(self, symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]):
        n = len(symbols)
        self.symbols, self.merges = symbols, merges
        self.after, self.before = [*range(1, n), -1], [-1, *range(n - 1)]
        self.size = size = 1 << max(1, (n - 1).bit_length())
        self.tree = tree = [NONE] * (2 * size)
        for i in range(n - 1):
            if m := merges.get((symbols[i], symbols[i + 1])):
                tree[size + i] = m[0] * size + i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def put(self, at: int, key: int) -> None:
        tree, i = self.tree, self.size + at
        tree[i] = key
        while i > 1:
            a, b = tree[i], tree[i ^ 1]
            i >>= 1
            low = a if a < b else b
            if tree[i] == low:
                return
            tree[i] = low

    def rank(self, at: int) -> int:
        nxt = self.after[at]
        m = self.merges.get((self.symbols[at], self.symbols[nxt])) if nxt >= 0 else None
        return m[0] * self.size + at if m else NONE

    def run(self) -> list[int]:
        symbols, after, before = self.symbols, self.after, self.before
        while (top := self.tree[1]) != NONE:
            i = top % self.size
            j = after[i]
            symbols[i] = self.merges[symbols[i], symbols[j]][1]
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            symbols[j] = -1
            self.put(j, NONE)
            self.put(i, self.rank(i))
            if (h := before[i]) >= 0:
                self.put(h, self.rank(h))
        out, i = [], 0
        while i >= 0:
            out.append(symbols[i])
            i = after[i]
        return out


class WordBpe:
    """Encoder and decoder for a `tokenizers` file of the word BPE kind (word ends, byte-level letters)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.letters = byte_letters()
        self.inner = [self.vocab.get(x) for x in self.letters]
        self.last = [self.vocab.get(x + self.end) for x in self.letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cache: dict[str, list[int]] = {}
        self.path = path
        self.unletter = {x: b for b, x in enumerate(self.letters)}
        self._library = None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list[bytes | str]:
        """Words of a text without special tokens."""
        if PLAIN.search(text):
            lib = self.library()
            parts = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
            return [bytes(map(self.unletter.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in parts]
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return self.split.findall(text.lower())

    def encode_word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogateescape")
        symbols = [s for b in data[:-1] if (s := self.inner[b]) is not None]
        if (s := self.last[data[-1]]) is not None:
            symbols.append(s)
        return PairTree(symbols, self.merges).run() if len(symbols) > 1 else symbols

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        cache = self.cache
        for part in self.cut.split(text) if self.cut and "<|" in text else (text,):
            if part in self.special:
                out.append(self.special[part])
                continue
            for w in self.words(part):
                ids = cache.get(w)
                if ids is None:
                    ids = self.encode_word(w)
                    if len(w) <= 64:
                        if len(cache) >= CACHE:
                            cache.clear()
                        cache[w] = ids
                out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Pieces joined by one blank: the file names no decoder, and special tokens stay."""
        return " ".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode_decode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256; with_ids adds the token ids and the decoded text."""

    def run(rows: dict[str, list]) -> dict:
        bpe = tokenizer(vocabulary)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        ids = [bpe.encode(t) for t in rows["text"]]
        decoded = [bpe.decode(x) for x in ids]
        out = {id_col: rows["id"], "n_tokens": [len(x) for x in ids], "ids_sha256": [sha(" ".join(map(str, x))) for x in ids], "decoded_sha256": [sha(x) for x in decoded]}
        return out | ({"ids": ids, "decoded": decoded} if with_ids else {})

    schema = f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded string" * with_ids
    return map_chunks(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), run, schema)
