"""BPE encoding and decoding with a public tokenizer's vocabulary.

A word's merges are found with a segment tree over the ranks of its adjacent pairs: the root
names the leftmost pair of lowest rank, a merge changes at most three leaves,
each in logarithmic time, and the word is done when the root has no mergeable pair.
Every new word of two symbols or more goes through a tree: the trees of short words side by side,
a step of all of them at a time.  What is kept of a word are only its finished tokens.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_NONE = 1 << 60  # key of a pair that no merge joins
_PLACE = 1 << 32  # a pair's key is its rank times this, plus its place: the least key is the leftmost of lowest rank
#: Words of up to so many pairs share an array of trees, one row a word; a longer word has a tree of its own.
WIDEST = 64
#: Words that are merged side by side, texts (of up to so many characters together) whose new words are collected for that, and pieces whose tokens a
#: worker keeps in each of two generations: what the later one lacks is taken over from the earlier one.
ROWS, TEXTS, CHARS, RECENT = 8192, 1000, 4_000_000, 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    to = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [to[b] for b in range(256)]


class PairTrees:
    """Binary segment trees of pair keys, one row a word; node 1 is the root, nodes `leaves` and up are the pairs."""

    def __init__(self, keys: np.ndarray):
        rows, self.leaves = keys.shape
        self.nodes = np.full((rows, 2 * self.leaves), _NONE, np.int64)
        self.nodes[:, self.leaves :] = keys
        at = self.leaves
        while at > 1:
            at //= 2
            np.minimum(self.nodes[:, 2 * at : 4 * at : 2], self.nodes[:, 2 * at + 1 : 4 * at : 2], out=self.nodes[:, at : 2 * at])

    def put(self, row: np.ndarray, at: np.ndarray, key: np.ndarray | int) -> None:
        """Set one pair in each of these rows, and the nodes above it."""
        nodes, flat = self.nodes.reshape(-1), row * (2 * self.leaves)
        at = at + self.leaves
        nodes[flat + at] = key
        for _ in range(self.leaves.bit_length() - 1):
            at >>= 1
            nodes[flat + at] = np.minimum(nodes[flat + 2 * at], nodes[flat + 2 * at + 1])

    def lowest(self) -> np.ndarray:
        """Each row's key of the leftmost pair of lowest rank, _NONE if none can be merged."""
        return self.nodes[:, 1]


class PairTree:
    """Binary segment tree of the pair ranks of one word (_NONE: not mergeable)."""

    def __init__(self, ranks: list[int]):
        n = self.n = len(ranks)
        self.nodes = nodes = [_NONE] * n + [_NONE if r == _NONE else r * _PLACE + i for i, r in enumerate(ranks)]
        for i in range(n - 1, 0, -1):
            nodes[i] = min(nodes[2 * i], nodes[2 * i + 1])

    def put(self, at: int, rank: int) -> None:
        nodes, i = self.nodes, at + self.n
        nodes[i] = _NONE if rank == _NONE else rank * _PLACE + at
        while i > 1:
            i >>= 1
            least = min(nodes[2 * i], nodes[2 * i + 1])
            if nodes[i] == least:
                return
            nodes[i] = least

    def lowest(self) -> int:
        """Key of the leftmost pair of lowest rank, _NONE if none can be merged."""
        return self.nodes[1]

    def leftmost_lowest(self) -> int:
        """Its place, -1 if there is none."""
        return -1 if self.nodes[1] == _NONE else self.nodes[1] % _PLACE


class WordBpe:
    """Encoder and decoder of one tokenizer file (BPE with byte alphabet and word-end suffix)."""

    def __init__(self, spec: dict):
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(vocab[a], vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = np.array([vocab[a + b] for a, b in pairs])
        order = sorted(self.ranks)
        self.codes, self.code_ranks = np.array([a << 32 | b for a, b in order]), np.array([self.ranks[p] for p in order])
        self.added = added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (vocab | added).items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.word_pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.inner, self.last = (np.array([vocab[c + end] for c in byte_alphabet()]) for end in ("", suffix))
        self.trees = 0  # words that went through a tree
        self.strings = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.pieces: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}

    def normalise(self, text: str) -> str:
        # White space of any kind only parts words, so it needn't be made uniform.
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        # Character by character, without the rule for a final sigma.
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def _keys(self, a: np.ndarray, b: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Keys of pairs of symbols; -1 is no symbol."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (a >= 0), self.code_ranks[at] * _PLACE + place, _NONE)

    def _merge_rows(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, filled up with -1, with the last column empty; merged symbols, -1 where one is gone."""
        width = symbols.shape[1] - 1  # the last column stands for what is beyond either end
        place = np.arange(width)
        left, right = np.tile(np.arange(-1, width), (len(symbols), 1)), np.tile(np.arange(1, width + 2), (len(symbols), 1))
        right[:, width - 1 :] = width
        trees = PairTrees(self._keys(symbols[:, :-1], symbols[:, 1:], place))
        while len(row := np.flatnonzero((least := trees.lowest()) != _NONE)):
            i = least[row] % _PLACE
            j, before = right[row, i], left[row, i]
            after = right[row, j]
            new = self.merged[least[row] // _PLACE]
            symbols[row, j] = -1
            symbols[row, i] = new
            right[row, i] = after
            left[row, after] = i
            trees.put(row, j, _NONE)
            trees.put(row, i, self._keys(new, symbols[row, after], i))
            some = before >= 0
            trees.put(row[some], before[some], self._keys(symbols[row, before], new, before)[some])
        return symbols

    def _merge_one(self, symbols: list[int]) -> list[int]:
        n, find = len(symbols), self.ranks.get
        rank = lambda i, j: find((symbols[i], symbols[j]), _NONE)
        tree = PairTree([rank(i, i + 1) for i in range(n - 1)])
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while (least := tree.lowest()) != _NONE:
            i = least % _PLACE
            j, before, after = right[i], left[i], right[right[i]]
            symbols[i], symbols[j] = int(self.merged[least // _PLACE]), -1
            right[i] = after
            if j < n - 1:
                tree.put(j, _NONE)
            if after < n:
                left[after] = i
            tree.put(i, rank(i, after) if after < n else _NONE)
            if before >= 0:
                tree.put(before, rank(before, i))
        return [x for x in symbols if x >= 0]

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Tokens of each word (not empty) as 32-bit integers."""
        out: dict[str, bytes] = {}
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for word in words:
            data = word.encode("utf-8", "surrogatepass")
            if len(data) == 1:
                out[word] = self.last[data[0]].astype(np.int32).tobytes()
            elif len(data) <= WIDEST:
                classes.setdefault(1 << (len(data) - 1).bit_length(), []).append((word, data))
            else:
                self.trees += 1
                symbols = np.frombuffer(data, np.uint8)
                out[word] = array("i", self._merge_one([*self.inner[symbols[:-1]].tolist(), int(self.last[symbols[-1]])])).tobytes()
        for width, all_ in classes.items():
            for at in range(0, len(all_), ROWS):
                part = all_[at : at + ROWS]
                self.trees += len(part)
                size = np.array([len(d) for _, d in part])
                owner, flat = np.repeat(np.arange(len(part)), size), np.frombuffer(b"".join([d for _, d in part]), np.uint8)
                ends = np.cumsum(size)
                place = np.arange(len(flat)) - np.repeat(ends - size, size)
                symbols = np.full((len(part), width + 1), -1, np.int64)
                symbols[owner, place] = self.inner[flat]
                symbols[np.arange(len(part)), size - 1] = self.last[flat[ends - 1]]
                symbols = self._merge_rows(symbols)
                stays = symbols >= 0
                tokens, stop = symbols[stays].astype(np.int32).tobytes(), (4 * np.cumsum(stays.sum(1))).tolist()
                out |= {word: tokens[a:b] for (word, _), a, b in zip(part, [0, *stop], stop, strict=False)}
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Add pieces without white space to those whose tokens are known."""
        find, normalise = self.word_pattern.findall, self.normalise
        plain: dict[str, list[str]] = {}
        special: dict[str, list[str | bytes]] = {}
        for piece in pieces:
            if self.specials is None or not self.specials.search(piece):
                plain[piece] = find(normalise(piece))
                continue
            at, part = 0, special.setdefault(piece, [])
            for m in self.specials.finditer(piece):
                part += [*find(normalise(piece[at : m.start()])), self.added[m.group()].to_bytes(4, sys.byteorder)]
                at = m.end()
            part += find(normalise(piece[at:]))
        words = set(chain.from_iterable(plain.values())) | {w for part in special.values() for w in part if isinstance(w, str)}
        tokens = self.encode_words(words)
        known = self.pieces
        for piece, part in plain.items():
            known[piece] = tokens[part[0]] if len(part) == 1 else b"".join([tokens[w] for w in part])
        for piece, part in special.items():
            known[piece] = b"".join([tokens[w] if isinstance(w, str) else w for w in part])

    def code(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """Tokens of each text as 32-bit integers, and decoded.  White space, which no word or special token holds, parts texts into pieces."""
        split = [t.split() if not _CONTROL.search(t) else _PIECE.findall(t) for t in texts]
        if len(self.pieces) > RECENT:
            self.earlier, self.pieces = self.pieces, {}
        earlier, new = self.earlier, []
        for piece in set(chain.from_iterable(split)).difference(self.pieces):
            tokens = earlier.get(piece)
            if tokens is None:
                new.append(piece)
            else:
                self.pieces[piece] = tokens
        self._learn(new)
        known = self.pieces.__getitem__
        coded = [b"".join(map(known, s)) for s in split]
        return [(c, self._decoded(c)) for c in coded]

    def _decoded(self, coded: bytes) -> str:
        return " ".join(map(self.strings.__getitem__, np.frombuffer(coded, np.int32).tolist()))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.code([text])[0][0], np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by spaces, as a file without a decoder prescribes; unknown ids are left out."""
        return " ".join(t for t in map(self.token.get, ids) if t is not None)


#: str.split() also parts at these, which are no white space in a tokenizer's patterns.
_CONTROL = re.compile("[\x1c-\x1f]")
_PIECE = regex.compile(r"\P{White_Space}+")


def load_tokenizer(spark: SparkSession, path: str) -> Broadcast:
    """Broadcast the parts of a tokenizer file (a few MB, fixed by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"]["pretokenizers"]
    if spec["model"]["type"] != "BPE" or spec["decoder"] is not None or [p["type"] for p in pre] != ["Split", "ByteLevel"]:
        raise ValueError(f"{path}: not a BPE file of the kind that is known here")
    return spark.sparkContext.broadcast(spec)


_open: list[tuple[dict, WordBpe]] = []


def _of(spec: Broadcast) -> WordBpe:
    """The worker's WordBpe of the tokenizer it used last."""
    if not _open or _open[0][0] is not spec.value:
        _open[:] = [(spec.value, WordBpe(spec.value))]
    return _open[0][1]


def _ids(coded: list[bytes]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(c) // 4 for c in coded)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(coded), np.int32)))


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """Texts, null as empty, some at a time."""
    some: list[str] = []
    chars = 0
    for t in texts:
        text = t.as_py() or ""
        some.append(text)
        chars += len(text)
        if len(some) >= TEXTS or chars >= CHARS:
            yield some
            some, chars = [], 0
    if some:
        yield some


def bpe_code(spec: Broadcast, text: Column) -> Column:
    """struct<ids array<int>, decoded string> of a text, read once; null counts as empty and gives no ids and the empty text."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def code(texts: pa.Array) -> pa.Array:
        out = []
        for some in _slices(texts):
            coded = _of(spec).code(some)
            out.append(pa.StructArray.from_arrays([_ids([c[0] for c in coded]), pa.array([c[1] for c in coded], pa.string())], ["ids", "decoded"]))
        return pa.concat_arrays(out) if out else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.string())]))

    return code(text)


def _coded_batches(spec: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For batches of an id and a text, those of the id, tokens and decoded text: a batch for some texts at a time, so that neither the worker nor the executor holds a whole batch's results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for some in _slices(batch.column(1)):
                coded = _of(spec).code(some)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), _ids([c[0] for c in coded]), pa.array([c[1] for c in coded], pa.string())], ["doc_id", "ids", "decoded"])
                at += len(some)
        pa.default_memory_pool().release_unused()

    return run


def bpe_encode(spec: Broadcast, text: Column) -> Column:
    """array<int> of token ids; null counts as empty and gives an empty array.  Any length is encoded whole."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([_ids([c[0] for c in _of(spec).code(some)]) for some in _slices(texts)] or [pa.array([], pa.list_(pa.int32()))])

    return encode(text)


def bpe_decode(spec: Broadcast, ids: Column) -> Column:
    """Text of token ids; null or empty gives the empty text."""

    @F.arrow_udf("string")
    def decode(arrays: pa.Array) -> pa.Array:
        bpe = _of(spec)
        return pa.array([bpe.decode(a.values.to_numpy(zero_copy_only=False).tolist() if a.is_valid else ()) for a in arrays], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row of docs, in one pass that codes each text once, without a shuffle.

    Null text counts as empty; null and repeated ids are rows like any other; other
    columns are not read; an empty table gives an empty result.
    """
    spec = load_tokenizer(docs.sparkSession, tokenizer)
    return docs.select(F.col(id_col).alias("doc_id"), bpe_code(spec, F.col(text_col)).alias("c")).select("doc_id", "c.ids", "c.decoded")


def encode_sliced(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows and columns of encode_documents, from workers that return some texts at a time: for wide results that are written whole."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_coded_batches(load_tokenizer(docs.sparkSession, tokenizer)), f"doc_id {kind}, ids array<int>, decoded string")
