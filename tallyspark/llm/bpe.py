"""Byte-level BPE encoding and decoding by traversal of a prefix-sharing trie.

The distinct words of a block of texts go into a trie of their UTF-8 bytes. A depth-first walk gives each
node the last token of the encoding of the node's prefix: the one vocabulary token that is a suffix of the
prefix and whose join with the encoding before it is left alone by the merges. A word's ids follow by
stepping back through the last tokens on its path, so a prefix shared by many words is encoded once.

Defined results: a null text counts as empty; an empty text has no ids and decodes to "". The strings of added
special tokens inside a text become their ids, as in the tokenizers library; other text never does.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import map_slices, ship, table

#: Words whose encodings a worker keeps at most; beyond that it starts again, which costs time, not results.
CACHE = 500_000
#: Longer words are walked by themselves, as their trie nodes would be shared by nothing else.
LONG = 200

# The split of the byte-level pre-tokenizer, for texts whose characters are all in Latin-1, where its classes are
# these ranges; for other texts the library's own pre-tokenizer gives the words.
_L = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
_N = "0-9²³¹¼-¾"
_S = "\t\n\x0b\x0c\r \x85\xa0"
_LATIN = re.compile(
    f"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)


def _alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if printable, else the next free code point from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    free = 256
    for b in range(256):
        if b not in out.values():
            out[chr(free)] = b
            free += 1
    return out


class Encoder:
    """Encodes and decodes with the vocabulary of a tokenizers JSON file, given as its bytes."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        letters = _alphabet()
        model = spec["model"]
        as_bytes = {s: bytes(letters[c] for c in s) for s in model["vocab"]}
        self.ids = {as_bytes[s]: i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        #: when a token is made (its merge's rank, -1 for a byte), of what two, and what a pair makes at which rank
        self.made = [-1] * size
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right = self.ids[as_bytes[a]], self.ids[as_bytes[b]]
            whole = self.ids[as_bytes[a] + as_bytes[b]]
            self.joined.setdefault((left, right), rank)
            if self.halves[whole] is None and len(self.bytes_of[whole]) > 1:
                self.halves[whole], self.made[whole] = (left, right), rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        self.grow()
        self.splitter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._library = None

    # -- words -------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self._library is None:
                from tokenizers.pre_tokenizers import ByteLevel

                self._library = ByteLevel(add_prefix_space=False, use_regex=True)
            return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]
        return _LATIN.findall(text)

    # -- the trie ----------------------------------------------------------------------------------------

    def stable(self, left: int, right: int) -> bool:
        """Whether the merges leave two adjacent tokens as they are.

        Played backwards from the end: undo whichever of the two was made last, and see whether the pair that
        then meets at the border would have been merged before the undone merge took place.
        """
        known = self.fits.get((left, right))
        if known is not None:
            return known
        a, b, until, answer = left, right, 1 << 60, True
        while True:
            rank = self.joined.get((a, b))
            # a merge at the border wins over one to its right of the same rank, not over one to its left
            if rank is not None and rank < until:
                answer = False
                break
            if self.made[a] < 0 and self.made[b] < 0:
                break
            if self.made[a] > self.made[b]:
                until, a = self.made[a], self.halves[a][1]
            elif self.made[a] < self.made[b]:
                until, b = self.made[b] + 1, self.halves[b][0]
            else:  # the same token twice: of equal merges the left one goes first
                until, b = self.made[b] + 1, self.halves[b][0]
        if len(self.fits) > CACHE:
            self.fits.clear()
        self.fits[(left, right)] = answer
        return answer

    def grow(self) -> None:
        """The suffix automaton of the vocabulary: after any bytes, the longest token that they end with, then the next."""
        edge, token, order = {}, [-1], [0]
        for b, i in self.ids.items():
            at = 0
            for byte in b:
                key = at << 8 | byte
                at = edge.get(key)
                if at is None:
                    at = edge[key] = len(token)
                    token.append(-1)
            token[at] = i
        below: list[list[tuple[int, int]]] = [[] for _ in token]
        for key, to in edge.items():
            below[key >> 8].append((key & 255, to))
        fail, nearest = [0] * len(token), [0] * len(token)
        for at in order:
            nearest[at] = at if token[at] >= 0 else nearest[fail[at]]
            for byte, to in below[at]:
                back = fail[at]
                while at and back and back << 8 | byte not in edge:
                    back = fail[back]
                fail[to] = edge.get(back << 8 | byte, 0) if at else 0
                order.append(to)
        self.edge, self.fail, self.nearest, self.token = edge, fail, nearest, token
        self.size = list(map(len, self.bytes_of))

    def step(self, state: int, byte: int) -> int:
        at = state
        while (to := self.edge.get(at << 8 | byte)) is None:
            if not at:
                return 0
            at = self.fail[at]
        if at != state and len(self.edge) < 4 * CACHE:
            self.edge[state << 8 | byte] = to
        return to

    def last_token(self, state: int, end: int, last: list[int]) -> int:
        """The last token of the encoding of a path's first `end` bytes; last has those of all shorter prefixes."""
        at, fits = self.nearest[state], self.fits
        while at:
            token = self.token[at]
            start = end - self.size[token]
            if start == 0:
                return token
            known = fits.get((last[start], token))
            if known or known is None and self.stable(last[start], token):
                return token
            at = self.nearest[self.fail[at]]
        raise ValueError("the vocabulary lacks a byte")

    def back(self, path: bytes, last: list[int]) -> tuple[int, ...]:
        out, end = [], len(path)
        while end:
            out.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return tuple(reversed(out))

    def learn(self, words: set[str]) -> None:
        """Encode words into the cache by one walk of their trie."""
        if len(self.cache) + len(words) > CACHE:
            self.cache.clear()
        root: dict = {}
        for word in words:
            path = word.encode()
            if len(path) > LONG:
                last, state = [-1], 0
                for end, byte in enumerate(path, 1):
                    state = self.step(state, byte)
                    last.append(self.last_token(state, end, last))
                self.cache[word] = self.back(path, last)
                continue
            node = root
            for byte in path:
                below = node.get(byte)
                if below is None:
                    below = node[byte] = {}
                node = below
            node[-1] = word
        last = [-1] * (LONG + 1)
        cache, edge, size = self.cache, self.edge, self.size
        stack = [(0, 0, root)]
        while stack:
            depth, state, node = stack.pop()
            if depth:
                last[depth] = self.last_token(state, depth, last)
            depth += 1
            for key, below in node.items():
                if key >= 0:
                    to = edge.get(state << 8 | key)
                    stack.append((depth, self.step(state, key) if to is None else to, below))
                else:
                    out, end = [], depth - 1
                    while end:
                        out.append(token := last[end])
                        end -= size[token]
                    out.reverse()
                    cache[below] = tuple(out)

    # -- texts -------------------------------------------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        cut: list[list] = []
        for text in texts:
            text = text or ""
            if self.splitter is not None and (marks := self.splitter.findall(text)):
                parts = self.splitter.split(text)
                got = [self.words(p) if k % 2 == 0 else self.special[p] for k, p in enumerate(parts)]
            else:
                marks, got = [], [self.words(text)]
            cut.append(got)
        new = set().union(*(part for got in cut for part in got if isinstance(part, list)))
        fresh = new.difference(self.cache.keys())
        if fresh:
            if len(self.cache) + len(fresh) > CACHE:
                fresh = new  # the cache starts again
            self.learn(fresh)
        get = self.cache.__getitem__
        return [
            list(chain.from_iterable(map(get, got[0])))
            if len(got) == 1
            else [i for part in got for i in ([part] if isinstance(part, int) else chain.from_iterable(map(get, part)))]
            for got in cut
        ]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(source: bytes) -> Encoder:
    return Encoder(source)


_BY_KEY: dict[str, Encoder] = {}


def worker_encoder(source) -> Encoder:
    """The encoder of a broadcast (key, file bytes) pair, kept for all tasks of a Python worker."""
    key, data = source.value
    if key not in _BY_KEY:
        _BY_KEY[key] = Encoder(data)
        gc.freeze()  # the vocabulary makes no cycles; looking for them takes longer than encoding
    return _BY_KEY[key]


_LIBRARY: dict[str, Callable[[str], np.ndarray]] = {}
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def worker_library(source) -> Callable[[str], np.ndarray]:
    """A library's encoder of the same vocabulary, text to ids, for operators that want ids and no more.

    It takes tokens by rank, so ids must rise with the merges; for other vocabularies the trie encodes.
    """
    key, data = source.value
    if key not in _LIBRARY:
        own = Encoder(data)
        rising = [i for i, made in sorted(enumerate(own.made), key=lambda x: x[1]) if made >= 0]
        if rising == sorted(rising) and all(i < rising[0] for b, i in own.ids.items() if len(b) == 1):
            import tiktoken

            # own is let go; where the library gives up it is made again
            library = tiktoken.Encoding("own", pat_str=_SPLIT, mergeable_ranks=own.ids, special_tokens=own.special)

            def by_library(text: str) -> np.ndarray:
                try:
                    return library.encode_to_numpy(text, allowed_special="all")
                except ValueError:  # its pattern gives up on very long runs of blanks
                    return np.array(encoder(data).encode_batch([text])[0], np.uint32)

            _LIBRARY[key] = by_library
        else:
            _LIBRARY[key] = lambda text: np.array(own.encode_batch([text])[0], np.uint32)
    return _LIBRARY[key]


def broadcast_vocabulary(spark: SparkSession, path: str):
    """A vocabulary file is of fixed size (a few MB), whatever the corpus."""
    with open(path, "rb") as f:
        data = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(data).hexdigest(), data))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids array<int>: the whole text's tokens. Rows keep their number; null text: no ids."""
    spark = df.sparkSession
    ship(spark)
    source = broadcast_vocabulary(spark, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = worker_encoder(source).encode_batch(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col), F.col(text_col)), run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text: what the ids stand for; bytes that aren't UTF-8 become U+FFFD. Null ids: empty."""
    spark = df.sparkSession
    ship(spark)
    source = broadcast_vocabulary(spark, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = worker_encoder(source)
        texts = [enc.decode(x or []) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col), F.col(ids_col)), run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def digest(df: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: an encoding and decoding round trip, without moving the ids."""
    spark = df.sparkSession
    ship(spark)
    source = broadcast_vocabulary(spark, vocabulary)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        enc = worker_encoder(source)
        number = _numbers(len(enc.bytes_of)).__getitem__
        n, a, b = [], [], []
        for ids in enc.encode_batch(batch.column(1).to_pylist()):
            n.append(len(ids))
            a.append(hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest())
            b.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return map_slices(
        df.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", 512
    )


@functools.lru_cache(maxsize=2)
def _numbers(n: int) -> list[str]:
    return [str(i) for i in range(n)]


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), default_vocabulary())
