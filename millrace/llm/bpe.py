"""BPE encoding and decoding by speculation and verification.

A word's encoding is guessed by greedy longest match over the vocabulary.  A sequence of
tokens is what merging by rank yields exactly when every adjacent pair of its tokens is
what merging yields for the pair alone, so all adjacent pairs of all guesses of a batch are
tested together with numpy; only the words with a failing pair are merged step by step.

Texts are taken whole.  A null or empty text has no ids and decodes to an empty text.  The
rows are independent: repeated rows give repeated results, and extra columns stay as they
are unless they have the name of an output column, which is replaced.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import common

#: Bytes that the encodings which a task keeps may take, of runs and of words, unless more is given; it starts anew beyond.
CACHE_BYTES = 12_000_000
#: What a kept string and its ids take besides their characters.
ENTRY_BYTES = 190
#: Longer runs and words are encoded and not kept.
LONGEST_KEPT = 64
#: Words of more letters are merged with a heap; for shorter ones a look at all pairs is faster.
SHORT = 48
#: Bytes of text that are encoded at once.
SLICE_BYTES = 500_000
_FAR = np.int64(1) << 60
_NEVER = 1 << 60
_UNUSUAL_SPACE = regex.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b], spare = chr(spare), spare + 1
    return [letters[b] for b in range(256)]


class WordCodec:
    """Encoder and decoder of one vocabulary file with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = 1 + max([*self.vocab.values(), *self.special.values()])
        names = [""] * self.size
        for name, k in chain(self.vocab.items(), self.special.items()):
            names[k] = name
        self.names = pa.array(names, pa.large_string())
        self.letters = _byte_letters()
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((self.vocab[left], self.vocab[right]), (rank, self.vocab[left + right]))
        self._prepare()
        self.room = CACHE_BYTES
        self.forget()

    # -- exact merging, the slow way

    def spelled(self, word: str) -> str:
        """The letters of a word's bytes; the mark of a word's end is not among them."""
        return word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])

    def letter_ids(self, letters: str) -> list[int]:
        vocab = self.vocab
        return [*(vocab[c] for c in letters[:-1]), vocab[letters[-1] + self.end]]

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the pair of lowest rank, the leftmost of equals, until no pair is left.

        In a long word possible merges wait in a heap and tokens are linked: n log n steps.
        """
        n, merges, none = len(ids), self.merges, (_NEVER, 0)
        if n <= SHORT:
            ids = list(ids)
            ranks = [merges.get(p, none)[0] for p in zip(ids, ids[1:], strict=False)]
            while ranks and (best := min(ranks)) != _NEVER:
                k = ranks.index(best)
                ids[k : k + 2] = [merges[ids[k], ids[k + 1]][1]]
                del ranks[k]
                if k:
                    ranks[k - 1] = merges.get((ids[k - 1], ids[k]), none)[0]
                if k < len(ranks):
                    ranks[k] = merges.get((ids[k], ids[k + 1]), none)[0]
            return ids
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(found[0], k) for k, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := merges.get(pair))]
        heapify(waiting)
        while waiting:
            rank, k = heappop(waiting)
            if ids[k] < 0 or (right := after[k]) >= n:
                continue
            found = merges.get((ids[k], ids[right]))
            if found is None or found[0] != rank:
                continue  # the pair that waited is no more
            ids[k], ids[right] = found[1], -1
            after[k] = after[right]
            if after[k] < n:
                before[after[k]] = k
                if more := merges.get((ids[k], ids[after[k]])):
                    heappush(waiting, (more[0], k))
            if (left := before[k]) >= 0 and (more := merges.get((ids[left], ids[k]))):
                heappush(waiting, (more[0], left))
        return [x for x in ids if x >= 0]

    # -- tables of the verification

    def _prepare(self) -> None:
        """Each token's last merge, and the tokens along its left and right edge.

        A token that merging its own letters doesn't give is never proposed.
        """
        split: dict[int, tuple[int, int, int]] = {}
        for (left, right), (rank, whole) in self.merges.items():
            if whole not in split or rank < split[whole][2]:
                split[whole] = (left, right, rank)
        self.proper = np.zeros(self.size, bool)
        right_edge, left_edge = {}, {}
        ordered = sorted(self.vocab.values(), key=lambda k: split[k][2] if k in split else -1)
        for k in ordered:
            edge_r, edge_l = [(k, int(_FAR))], [(k, int(_FAR))]
            if k in split:
                left, right, rank = split[k]
                edge_r += [(right, rank), *right_edge[right][1:]]
                edge_l += [(left, rank), *left_edge[left][1:]]
                self.proper[k] = self.proper[left] and self.proper[right] and not any(
                    (x, y) in self.merges and self.merges[x, y][0] < min(p, rank) and self.merges[x, y][0] <= min(q, rank)
                    for i, (x, p) in enumerate(right_edge[left])
                    for j, (y, q) in enumerate(left_edge[right])
                    if i or j
                )
            else:
                self.proper[k] = True
            right_edge[k], left_edge[k] = edge_r, edge_l
        depth = max(map(len, chain(right_edge.values(), left_edge.values())))
        self.edge = np.full((2, depth, self.size), -1, np.int64)
        self.until = np.full((2, depth, self.size), -1, np.int64)
        for side, edges in enumerate((right_edge, left_edge)):
            for k, edge in edges.items():
                for d, (token, rank) in enumerate(edge):
                    self.edge[side, d, k], self.until[side, d, k] = token, rank
        keys = np.array([x * self.size + y for x, y in self.merges], np.int64)
        ranks = np.array([rank for rank, _ in self.merges.values()], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = np.append(keys[order], _FAR), np.append(ranks[order], _FAR)
        #: Tokens that may be proposed by their string, the longest of all and of each first two letters.
        self.proposed = {name: k for name, k in self.vocab.items() if self.proper[k] or k not in split}
        self.longest = max(len(name.removesuffix(self.end)) for name in self.proposed)
        self.reach: dict[str, int] = {}
        for name in self.proposed:
            if not name.endswith(self.end):
                self.reach[name[:2]] = max(len(name), self.reach.get(name[:2], 1))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the letters of each pair of tokens gives back that pair.

        It doesn't if some token x on the left one's right edge and some y on the right one's
        left edge form a merge that comes before x and y go into larger tokens; of equal
        ranks the leftmost merge comes first.
        """
        good = np.ones(len(left), bool)
        for d in range(self.edge.shape[1]):
            x, x_until = self.edge[0, d, left], self.until[0, d, left]
            if not (x >= 0).any():
                break
            for e in range(self.edge.shape[1]):
                y, y_until = self.edge[1, e, right], self.until[1, e, right]
                there = (x >= 0) & (y >= 0)
                if not there.any():
                    break
                key = np.where(there, x * self.size + y, -1)
                at = np.searchsorted(self.pair_keys, key)
                rank = np.where(self.pair_keys[at] == key, self.pair_ranks[at], _FAR)
                good &= ~((rank < x_until) & (rank <= y_until) & (rank < _FAR))
        return good

    # -- encoding

    def guess(self, letters: str) -> list[int]:
        """Greedy longest match from the left."""
        found, at, n, whole = [], 0, len(letters), letters + self.end
        proposed, reach = self.proposed, self.reach
        while at < n:
            k = proposed.get(whole[at:]) if n - at <= self.longest else None
            if k is not None:
                found.append(k)
                break
            for end in range(min(n - 1, at + reach.get(whole[at : at + 2], 1)), at, -1):
                k = proposed.get(whole[at:end])
                if k is not None:
                    break
            found.append(k)
            at = end
        return found

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word: guess all, test all adjacent pairs at once, merge what fails."""
        letters = [self.spelled(w) for w in words]
        guesses = [self.guess(x) for x in letters]
        flat = np.fromiter(chain.from_iterable(guesses), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        inside = owner[:-1] == owner[1:]
        left, right, owner = flat[:-1][inside], flat[1:][inside], owner[:-1][inside]
        for k in np.unique(owner[~self.compatible(left, right)]).tolist():
            guesses[k] = self.merge(self.letter_ids(letters[k]))
        return guesses

    def normal(self, text: str) -> str:
        """NFC, then each character's own lower case (no final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, chunk: str) -> list[str | int]:
        """The words of a run without white space; special tokens as their ids."""
        if self.specials is None or "<" not in chunk:
            return self.words.findall(self.normal(chunk))
        parts = self.specials.split(chunk)
        return [x for k, p in enumerate(parts) for x in ([self.special[p]] if k % 2 else self.words.findall(self.normal(p)))]

    def forget(self) -> None:
        """Keep no encodings; a task does so at its end, so that a worker's next task has the memory."""
        self.kept: dict[str, bytes] = {}
        self.kept_words: dict[str, bytes] = {}
        self.bytes_kept = [0, 0]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Encode runs that aren't kept yet; those that are too long to keep are given back."""
        pieces = {c: self.pieces(c) for c in chunks}
        words = {p for ps in pieces.values() for p in ps if isinstance(p, str)}
        if self.bytes_kept[1] > self.room:
            self.kept_words, self.bytes_kept[1] = {}, 0
        kept, here, out = self.kept_words, {}, {}
        if new := [w for w in words if w not in kept]:
            for w, ids in zip(new, self.encode_words(new), strict=True):
                (kept if len(w) <= LONGEST_KEPT else here)[w] = made = array("i", ids).tobytes()
                self.bytes_kept[1] += (len(w) + len(made) + ENTRY_BYTES) * (len(w) <= LONGEST_KEPT)
        for c, ps in pieces.items():
            made = b"".join([kept.get(p) or here[p] if isinstance(p, str) else array("i", [p]).tobytes() for p in ps])
            if len(c) <= LONGEST_KEPT:
                self.kept[c] = made
                self.bytes_kept[0] += len(c) + len(made) + ENTRY_BYTES
            else:
                out[c] = made
        return out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and the offsets of the texts."""
        split = [[] if not t else t.split() if not _UNUSUAL_SPACE.search(t) else regex.split(r"[^\S\x1c-\x1f]+", t) for t in texts]
        if self.bytes_kept[0] > self.room:
            self.kept, self.bytes_kept[0] = {}, 0
        long = self.learn(new) if (new := set().union(*split) - self.kept.keys()) else {}
        find = self.kept.__getitem__ if not long else lambda c: long[c] if c in long else self.kept[c]
        parts = [b"".join(map(find, s)) for s in split]
        return np.frombuffer(b"".join(parts), np.int32), np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Token strings joined by a space, as a vocabulary without a decoder has it."""
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.names.take(pa.array(ids)))
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


_codecs: dict[str, WordCodec] = {}


def codec(path: str) -> WordCodec:
    """The codec of a vocabulary file, made once in each worker."""
    if path not in _codecs:
        _codecs[path] = WordCodec(path)
        common.give_back()  # what reading the file took
    return _codecs[path]


def with_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    names = {f.name.lower() for f in fields}
    return T.StructType([*(f for f in schema.fields if f.name.lower() not in names), *fields])


def encode_decode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded", room: int = CACHE_BYTES) -> DataFrame:
    """docs with the ids (array<int>) of column `text` and, if asked for, their decoded text; room: as CACHE_BYTES."""
    common.small_batches(docs.sparkSession)
    fields = [T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)]
    if decoded:
        fields.append(T.StructField(decoded, T.StringType(), False))
    schema = with_columns(docs.schema, *fields)
    keep = schema.names[: len(schema.names) - len(fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        coder.room = room
        try:
            for batch in batches:
                column = batch.column(batch.schema.get_field_index(text))
                sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
                for a, b in common.byte_slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), SLICE_BYTES):
                    found, at = coder.encode(column.slice(a, b - a).to_pylist())
                    rest = batch.slice(a, b - a).select(keep)
                    made = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(found))]
                    if decoded:
                        made.append(coder.decode(found, at).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([*rest.columns, *made], names=schema.names)
        finally:
            coder.forget()
            common.give_back()

    return docs.mapInArrow(run, schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """frame with the text of its column of ids; null ids decode to an empty text."""
    schema = with_columns(frame.schema, T.StructField(decoded, T.StringType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            at = np.concatenate([[0], np.cumsum([len(x or ()) for x in lists])])
            flat = np.fromiter(chain.from_iterable(x or () for x in lists), np.int32)
            yield pa.RecordBatch.from_arrays([*batch.select(schema.names[:-1]).columns, coder.decode(flat, at).cast(pa.string())], names=schema.names)

    return frame.mapInArrow(common.giving_back(run), schema)
