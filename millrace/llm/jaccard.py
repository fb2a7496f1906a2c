"""N-gram Jaccard join with PartEnum signatures.

A document's set is its distinct 5-word shingles.  Documents of equal sets form a class.
Two sets of sizes m <= n with a Jaccard similarity of s or more differ in at most
(1 - s) / (1 + s) * (m + n) elements and have m >= s n.  Sizes are cut into bands; a set
signs for its own band and, if a partner of it may be there, for the next one.  A band has
a bound k on the differing elements.  Its scheme parts the domain of shingles into n1
partitions, each into N2 cells; as n1 > k / (K2 + 1), some partition has at most K2
differing elements, so at least N2 - K2 of its cells agree.  A signature is the hash of
the elements in one subset of N2 - K2 cells, and all subsets are enumerated.

A subset without elements would be a signature of any set, so it gives none.  The bound
then still holds if more than k / (K2 + 1) partitions of one of the two sets have elements
in every subset.  Two sets differ in no more elements once some shingles are left out of
all sets, so those of very common passages (COMMON) are left out at first.  Sets for which
the condition fails then sign with all elements too, and those for which it fails again
also by the prefix rule: all of their n - ceil(s n) + 1 smallest hashes, of which similar
sets share one.

Signatures travel packed, by bucket, one row for each chunk of documents and bucket, so
that a bucket's rows are few; a signature that a chunk has more than LOCAL times is known
to be shared, and all but LOCAL of its holders go past the buckets.  Only signatures that
two classes share are kept, and only of classes that share as many as every similar partner
would.  Such a class is compared with the most central holder of most of its signatures.
Classes that still share signatures across components are then compared if they share one
of their first elements, common ones last, so that no link between components is lost.  A
comparison counts the shared shingles of two whole sets.

Shingles are known by hashes of 64 bits, sets by 128.  Signatures name a class by the first 64
of these; where two classes share them, both are taken to hold the signatures of either, and
whole sets decide.  Links are between numbers of classes, which no two share.

A null or empty text, or one without words, has an empty set and links with nothing; it is
a component of its own.  Rows of equal doc_id count as equal documents where their texts
are equal; otherwise each text is a member under that id.  A null doc_id links as any other
and is the smallest.  Columns that the join does not name are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm.common import connected_components, stored

SHINGLE = 5
#: Cells of a partition, and how many of them may differ.
N2, K2 = 2, 1
#: Subsets that one element is in.
SPOILT = comb(N2 - 1, N2 - K2 - 1)
#: Partitions beyond those that the bound needs, to make up for empty subsets.
SLACK = 0.18
BAND = 1.7
#: Signatures of a chunk of documents, and in a bucket.
CHUNK_SIGNATURES = 800_000
BUCKET_SIGNATURES = 1_500_000
LOCAL = 4
#: A shingle is common if this share of a chunk's sets has it, and COMMON_SETS of them;
#: the MOST_COMMON of these go to all executors.  Which are taken changes no result.
COMMON = 0.002
COMMON_SETS = 4
MOST_COMMON = 20_000


@dataclass(frozen=True)
class Scheme:
    """Signatures of sets for a least similarity."""

    least: Fraction = Fraction(4, 5)

    @cached_property
    def starts(self) -> np.ndarray:
        """The smallest size of each band."""
        out = [1]
        while out[-1] < 1 << 40:
            out.append(max(out[-1] + 1, int(out[-1] * BAND)))
        return np.array(out, np.int64)

    def bound(self, band: np.ndarray) -> np.ndarray:
        """The most elements in which two similar sets of a band differ."""
        top = self.starts[band + 1] - 1
        return 2 * top * (self.least.denominator - self.least.numerator) // (self.least.denominator + self.least.numerator)

    def partitions(self, band: np.ndarray) -> np.ndarray:
        need = self.bound(band) // (K2 + 1) + 1
        return need + np.ceil(need * SLACK).astype(np.int64) + 1

    def sign(self, sizes: np.ndarray, elements: np.ndarray, common_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(set number, signature, tag) of sets given one after another; sizes are at least 1.

        A tag is a kind of signature (level, own band or next) and, times 8, how many
        signatures of that kind every similar partner shares that meets this set there.
        """
        owner = np.repeat(np.arange(len(sizes)), sizes)
        own = np.searchsorted(self.starts, sizes, side="right") - 1
        # a larger partner has at most size / least elements
        up = sizes * self.least.denominator // self.least.numerator >= self.starts[own + 1]
        sets, bands = np.concatenate([np.arange(len(sizes)), np.flatnonzero(up)]), np.concatenate([own, own[up] + 1])
        found = []
        for level in (0, 1):
            left = np.ones(len(elements), bool)
            if level == 0 and common_ is not None and len(common_):
                left = common_[np.minimum(np.searchsorted(common_, elements), len(common_) - 1)] != elements
            if level == 0 or len(sets):
                # number the (set, band) pairs, and take each pair's elements
                rows, values, tags, bad = [], [], [], []
                for of_band in (0, 1):
                    mine = np.flatnonzero((bands == own[sets]) if of_band == 0 else (bands != own[sets]))
                    number = np.full(len(sizes), -1, np.int64)
                    number[sets[mine]] = np.arange(len(mine))
                    chosen = left & (number[owner] >= 0)
                    r, v, b = self._by_partitions(number[owner[chosen]], elements[chosen], len(mine), bands[mine], level)
                    size = sizes[sets[mine]]
                    total = size + size * self.least.denominator // self.least.numerator
                    differ = np.minimum(self.bound(bands[mine]), total * (self.least.denominator - self.least.numerator) // (self.least.denominator + self.least.numerator))
                    need = np.maximum(1, np.bincount(r, minlength=len(mine)) - differ * SPOILT)
                    rows.append(sets[mine][r])
                    values.append(v)
                    tags.append(np.minimum(need[r], 4000) * 8 + level * 2 + of_band)
                    bad.append(mine[b])
                found.append((np.concatenate(rows), np.concatenate(values), np.concatenate(tags)))
                again = np.sort(np.concatenate(bad))
                sets, bands = sets[again], bands[again]
        if len(sets):
            found.append(self._by_prefix(sizes, elements, np.unique(sets)))
        return tuple(np.concatenate([f[j] for f in found]) for j in range(3))

    def _by_partitions(self, owner, elements, sets, band, level):
        n1, need = self.partitions(band), self.bound(band) // (K2 + 1) + 1
        cells = n1 * N2
        base = np.concatenate([[0], np.cumsum(cells)])
        draw = common.mix64(elements ^ common.seeds(41, 2)[level])
        # a cell by the high half of the hash, in proportion to the number of cells
        cell = base[owner] + ((draw >> np.uint64(32)) * cells[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, mixed = cell[order], common.mix64(elements[order] + common.seeds(42, 2)[level])
        total, count = np.zeros(base[-1], np.uint64), np.bincount(cell, minlength=base[-1])
        if len(cell):
            first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            total[cell[first]] = np.add.reduceat(mixed, first)
        total, count = total.reshape(-1, N2), count.reshape(-1, N2)
        set_of = np.repeat(np.arange(sets), n1)
        part = np.arange(len(set_of)) - np.repeat(base[:-1] // N2, n1)
        salt = common.mix64((part.astype(np.uint64) << np.uint64(20)) + band[set_of].astype(np.uint64) * np.uint64(1 << 52))
        whole = np.ones(len(set_of), bool)
        rows, values = [], []
        with np.errstate(over="ignore"):
            for number, subset in enumerate(combinations(range(N2), N2 - K2)):
                filled = count[:, subset].sum(axis=1) > 0
                whole &= filled
                value = common.mix64(total[:, subset].sum(axis=1, dtype=np.uint64) + salt + np.uint64(number))
                rows.append(set_of[filled])
                values.append(value[filled])
        good = np.bincount(set_of[whole], minlength=sets)
        differ = self.bound(band) > 0  # else only equal sets are similar, and they are one class
        keep = [differ[r] for r in rows]
        rows, values = np.concatenate([r[k] for r, k in zip(rows, keep, strict=True)]), np.concatenate([v[k] for v, k in zip(values, keep, strict=True)])
        return rows, values, np.flatnonzero((good < need) & differ)

    def _by_prefix(self, sizes, elements, chosen):
        at = np.concatenate([[0], np.cumsum(sizes)])
        rows, values = [], []
        for k in chosen:
            n = int(sizes[k])
            prefix = n - -(-n * self.least.numerator // self.least.denominator) + 1
            own = np.sort(elements[at[k] : at[k + 1]])[:prefix]
            rows.append(np.full(len(own), k))
            values.append(common.mix64(own + common.seeds(43, 1)[0]))
        rows = np.concatenate(rows)
        return rows, np.concatenate(values), np.full(len(rows), 8 + 4)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def set_keys(elements: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set, its class."""
    with np.errstate(over="ignore"):
        pair = [common.mix64(elements ^ common.seeds(44, 2)[j]).sum(dtype=np.uint64) for j in (0, 1)]
        pair = common.mix64(np.array(pair, np.uint64) + np.uint64(len(elements)))
    return int(pair.view(np.int64)[0]), int(pair.view(np.int64)[1])


def text_key(text: Column) -> Column:
    """What tells the texts of one id apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sets_of(docs: DataFrame, text: str = "text", k: int = SHINGLE) -> DataFrame:
    """doc_id, text_key, n_shingles, key (two longs) of each row's set; and rows of n_shingles -1 with a frequent shingle and its count in a chunk."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(ids: pa.Array, texts: pa.Array, sizes, a, b) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([ids, texts, *(pa.array(x, pa.int64()) for x in (sizes, a, b))], names=["doc_id", "text_key", "n_shingles", "key", "key2"])

        def frequent(sets: dict) -> pa.RecordBatch:
            value, count = np.unique(np.concatenate([*sets.values(), np.zeros(0, np.uint64)]), return_counts=True)
            often = count >= max(COMMON_SETS, COMMON * len(sets))
            n = int(often.sum())
            return rows(pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), np.full(n, -1), _signed(value[often]), count[often])

        distinct: dict = {}
        weight = 0
        for batch in batches:
            sizes, keys = [], []
            for _, found in common.text_shingles(batch.column(1), k):
                sizes.append(len(found))
                keys.append(set_keys(found))
                if keys[-1] not in distinct:
                    distinct[keys[-1]] = found
                    weight += len(found)
                if weight > CHUNK_SIGNATURES:
                    yield frequent(distinct)
                    distinct, weight = {}, 0
            yield rows(batch.column(0), batch.column(2), sizes, [x[0] for x in keys], [x[1] for x in keys])
        yield frequent(distinct)

    return docs.select(F.col("doc_id").cast("long"), text, text_key(F.col(text))).mapInArrow(common.giving_back(run), "doc_id long, text_key binary, n_shingles long, key long, key2 long")


def shared_signatures(docs: DataFrame, buckets: int, common_shingles: np.ndarray, text: str = "text", k: int = SHINGLE, scheme: Scheme | None = None) -> DataFrame:
    """signature, key, tag: the classes that hold each signature that more than one class holds."""
    scheme = scheme or Scheme()
    common.small_batches(docs.sparkSession)

    shingles = docs.sparkSession.sparkContext.broadcast(np.sort(common_shingles))

    def packed(rows: np.ndarray, values: np.ndarray, tags: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        """A row for each bucket: signatures (five bytes each), holders by place, tags, and the holders' keys."""
        order = np.argsort(values, kind="stable")
        value, row, tag = values[order], rows[order], tags[order]
        start = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
        length = np.diff(np.append(start, len(value)))
        place = np.arange(len(value)) - np.repeat(start, length)
        out: dict[str, list] = {"bucket": [], "known": [], "signatures": [], "places": [], "tags": [], "keys": []}
        for known, chosen in ((0, place < LOCAL), (1, place >= LOCAL)):
            # Of a signature's holders in a chunk all but LOCAL go past the run search.
            v, c, t = value[chosen], row[chosen], tag[chosen]
            bucket = ((v >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            by = np.lexsort((c, bucket))
            v, c, t, bucket = v[by], c[by], t[by], bucket[by]
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(v) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut, len(v))[1:], strict=True):
                held, at = np.unique(c[a:b], return_inverse=True)
                out["bucket"].append(int(bucket[a]))
                out["known"].append(known)
                out["signatures"].append(v[a:b].view(np.uint8).reshape(-1, 8)[:, :5].tobytes())
                out["places"].append(at.astype(np.uint16 if len(held) <= 1 << 16 else np.uint32).tobytes())
                out["tags"].append(t[a:b].astype(np.uint16).tobytes())
                out["keys"].append(keys[held].tobytes())
        kinds = {"bucket": pa.int64(), "known": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array(x, kinds.get(n, pa.binary())) for n, x in out.items()], names=list(out))

    def unpacked(batch: pa.RecordBatch, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        column = lambda k, kind: np.frombuffer(batch.column(k)[j].as_buffer(), kind)
        short = column(2, np.uint8).reshape(-1, 5)
        value = np.zeros((len(short), 8), np.uint8)
        value[:, :5] = short
        value = value.view(np.uint64).ravel() + (np.uint64(batch.column(0)[j].as_py()) << np.uint64(40))
        keys = column(5, np.int64)
        return value, keys[column(3, np.uint16 if len(keys) <= 1 << 16 else np.uint32)], column(4, np.uint16)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: list[np.ndarray] = []
        seen: set[int] = set()
        keys: list[int] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets], np.int64)
            own = np.array(keys, np.int64)
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
            for a, b in common.byte_slices(np.concatenate([[0], np.cumsum(sizes)]), 400_000):
                rows, values, tags = scheme.sign(sizes[a:b], np.concatenate(sets[a:b]), shingles.value)
                parts.append((rows + a, values, tags))
            return packed(*(np.concatenate([p[j] for p in parts]) for j in range(3)), own)

        for batch in batches:
            for _, found in common.text_shingles(batch.column(0), k):
                if len(found):
                    key = set_keys(found)[0]
                    if key not in seen:
                        seen.add(key)
                        keys.append(key)
                        sets.append(found)
                        weight += len(found)
                if weight > CHUNK_SIGNATURES:
                    yield flush()
                    sets, keys, weight = [], [], 0
                    seen.clear()
        if sets:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(value: np.ndarray, key: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(_signed(value)), pa.array(key), pa.array(tag.astype(np.int32))], names=["signature", "key", "tag"])

        def shared(parts: list) -> pa.RecordBatch:
            value, key, tag = (np.concatenate([p[j] for p in parts]) for j in range(3))
            order = np.lexsort((tag, key, value))
            value, key, tag = value[order], key[order], tag[order]
            fresh = np.concatenate([[True], (value[1:] != value[:-1]) | (key[1:] != key[:-1])])
            value, key, tag = value[fresh], key[fresh], tag[fresh]
            start = np.concatenate([[True], value[1:] != value[:-1]])
            alone = start & np.concatenate([start[1:], [True]])
            return rows(value[~alone], key[~alone], tag[~alone])

        at, parts = None, []
        for batch in batches:
            for j in range(batch.num_rows):
                part = unpacked(batch, j)
                if batch.column(1)[j].as_py():
                    yield rows(*part)
                    continue
                if batch.column(0)[j].as_py() != at and parts:
                    yield shared(parts)
                    parts = []
                at = batch.column(0)[j].as_py()
                parts.append(part)
        if parts:
            yield shared(parts)

    chunks = docs.select(text).mapInArrow(common.giving_back(sign), "bucket long, known int, signatures binary, places binary, tags binary, keys binary")
    dealt = chunks.repartition(max(1, min(buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 4))), "bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(common.giving_back(meet), "signature long, key long, tag int")


def parity_sketch(elements: np.ndarray) -> bytes:
    """Bits of twice as many cells as elements or more: whether a cell has an odd number of them."""
    bits = max(256, 1 << int(2 * len(elements)).bit_length())
    odd = np.bincount((common.mix64(elements) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_difference(x: bytes, y: bytes) -> int:
    """In how many elements two sets differ at least, by their sketches; the longer one is folded."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar.

    Sketches drop those that differ in too many elements for certain; whole sets decide.
    """
    up, down = least.numerator, least.denominator

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            most = (down - up) * total // (down + up)
            x, y = batch.column(4), batch.column(5)
            keep = [least_difference(x[j].as_py(), y[j].as_py()) <= most[j] for j in range(batch.num_rows)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, n, s: sets.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("sketch").alias(s))
    near = pairs.join(side("a", "m", "s"), "a").join(side("b", "n", "t"), "b").select("a", "b", "m", "n", "s", "t")
    near = stored(near.mapInArrow(common.giving_back(possible), "a long, b long").distinct())
    left = sets.select(F.col("cls").alias("a"), F.col("elements").alias("x"))
    right = sets.select(F.col("cls").alias("b"), F.col("elements").alias("y"))
    met = near.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("x", "y"))
    return met.where(both * down >= (F.size("x") + F.size("y") - both) * up).select("a", "b").distinct()


def _enough(held: DataFrame) -> DataFrame:
    """Rows of classes that have as many signatures of a kind as every similar partner shares."""
    kind = Window.partitionBy("cls", "tag")
    return held.withColumn("n_", F.count(F.lit(1)).over(kind)).where("n_ * 8 >= tag - tag % 8").drop("n_")


def _promising(held: DataFrame, component: DataFrame | None = None) -> DataFrame:
    """Rows of held (signature, cls, tag) that may bring a link between different components.

    A signature counts if its holders are in more than one component (each class is one
    where none are given).
    """
    placed = held.withColumn("component", F.col("cls"))
    if component is not None:
        placed = held.join(component.withColumnRenamed("node", "cls"), "cls", "left").select("signature", "cls", "tag", F.coalesce("component", "cls").alias("component"))
    mixed = placed.groupBy("signature").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("signature")
    return _enough(placed.join(mixed, "signature").select("signature", "cls", "tag"))


def _across(sets: DataFrame, often: np.ndarray, least: Fraction) -> DataFrame:
    """Pairs (a, b) of classes in different components that may be similar, by elements they share.

    A set's elements are ordered by hash, those in `often` (from rare to frequent) last.
    Where the first element that two similar sets share is at places i and j, both still
    have as many elements from there as the sets must share; a join on elements with that
    condition finds every pair and next to no other, however large a group of copies is.
    """
    up, down = least.numerator, least.denominator
    by_value = np.argsort(often)
    spark = sets.sparkSession
    known = spark.sparkContext.broadcast((often[by_value], by_value + 1))

    def fronts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, rank = known.value
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], []]
            for j in range(batch.num_rows):
                own = np.sort(batch.column(2)[j].values.to_numpy())
                n = len(own)
                if len(value):
                    at = np.minimum(np.searchsorted(value, own), len(value) - 1)
                    own = own[np.argsort(np.where(value[at] == own, rank[at], 0), kind="stable")]
                own = own[: n - -(-n * up // down) + 1]
                for column, x in zip(out, (batch.column(0)[j].as_py(), batch.column(1)[j].as_py(), n), strict=False):
                    column.append(np.full(len(own), x))
                out[3].append(np.arange(len(own)))
                out[4].append(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64)) for x in out], names=["cls", "component", "n", "place", "element"])

    tokens = stored(sets.select("cls", "component", "elements").mapInArrow(common.giving_back(fronts), "cls long, component long, n long, place long, element long"))
    met = tokens.groupBy("element").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("element")
    tokens = stored(tokens.join(met, "element"))
    x, y = tokens.alias("x"), tokens.alias("y")
    # both >= s / (1 + s) * (m + n), in whole numbers
    enough = lambda left: left * (up + down) >= (F.col("x.n") + F.col("y.n")) * up
    close = (F.col("x.element") == F.col("y.element")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.component") != F.col("y.component"))
    close &= enough(F.col("x.n") - F.col("x.place")) & enough(F.col("y.n") - F.col("y.place"))
    return x.join(y, close).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()


def component_ids(docs: DataFrame, text: str = "text", k: int = SHINGLE, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links reach, for each row."""
    return groups(docs, text, k, least).select("doc_id", "n_shingles", "component_id")


def groups(docs: DataFrame, text: str = "text", k: int = SHINGLE, least: Fraction = Fraction(4, 5)) -> DataFrame:
    """As component_ids, and text_key and component, a number of the component of the row's text (null without shingles)."""
    scheme = Scheme(least)
    counted = stored(sets_of(docs, text, k))
    members = counted.where("n_shingles >= 0")
    often = counted.where("n_shingles = -1").groupBy("key").agg(F.sum("key2").alias("sets")).orderBy(F.desc("sets"), "key").limit(MOST_COMMON)
    shingles = np.array([r.key for r in often.collect()], np.int64).view(np.uint64)
    total = members.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = min(1 << 23, int(total * 0.7 / BUCKET_SIGNATURES) + 1)
    # A class is numbered by its smallest document, nulls first; empty sets are in no class.
    number = F.coalesce(F.min("doc_id"), F.lit(-(1 << 63)))
    has_null = F.max(F.col("doc_id").isNull().cast("int"))
    doc = F.when(has_null == 1, F.lit(-(1 << 63))).otherwise(number).alias("doc")
    classes = stored(members.where("n_shingles > 0").groupBy("key", "key2").agg(doc).withColumn("cls", F.monotonically_increasing_id()))
    signed = stored(shared_signatures(docs, buckets, shingles, text, k, scheme).withColumnRenamed("key", "cls"))
    common.release(docs.sparkSession)
    named = _promising(_enough(signed)).withColumnRenamed("cls", "key")
    held = stored(named.join(classes.select("key", "cls"), "key").select("signature", "cls", "tag"))
    common.discard(signed)
    needed = held.select("cls").distinct()

    # The whole sets of the classes that hold a shared signature, from one document of each.
    chosen = classes.join(needed, "cls").select("cls", "key", "key2", "doc")
    texts = docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), text).join(chosen.select("doc", "key", "key2", "cls"), "doc")
    same_text = Window.partitionBy("doc", "cls", F.xxhash64(text)).orderBy("cls")
    texts = texts.withColumn("copy", F.row_number().over(same_text)).where("copy = 1").select("cls", "key", "key2", text)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, key, key2 = (batch.column(j).to_pylist() for j in range(3))
            for part in range(0, batch.num_rows, 200):
                own, sets, sketches = [], [], []
                for row, found in common.text_shingles(batch.column(3).slice(part, 200), k):
                    # a document id may stand for several texts
                    if set_keys(found) == (key[part + row], key2[part + row]):
                        own.append(cls[part + row])
                        sets.append(_signed(found))
                        sketches.append(parity_sketch(found))
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                columns = [pa.array(own, pa.int64()), pa.array(np.diff(at).astype(np.int64)), pa.array(sketches, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "sketch", "elements"])

    sets = stored(texts.mapInArrow(common.giving_back(whole), "cls long, n long, sketch binary, elements array<long>"))
    common.release(docs.sparkSession)
    low, high = F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")

    # Each class with the holder that leads most of its signatures: the one whose own
    # signatures have most holders, which is the centre of its copies.
    sizes = held.groupBy("signature").agg(F.count(F.lit(1)).alias("holders"))
    popular = held.join(sizes, "signature").groupBy("cls").agg(F.sum("holders").alias("weight"))
    centres = held.join(popular, "cls").groupBy("signature").agg(F.max_by("cls", F.struct("weight", "cls")).alias("other"))
    led = held.join(centres, "signature").where("cls <> other").groupBy("cls", "other").count()
    star = led.groupBy("cls").agg(F.max_by("other", F.struct("count", "other")).alias("other"))
    tried = stored(star.select(F.least("cls", "other").alias("a"), F.greatest("cls", "other").alias("b")).distinct())
    common.release(docs.sparkSession)
    links = stored(_verified(tried, sets, least))
    common.release(docs.sparkSession)

    # What is left: holders of signatures that are in different components so far.
    component = connected_components(links)
    rest = _promising(held, component).select("cls").distinct()
    placed = rest.join(component.withColumnRenamed("node", "cls"), "cls", "left").select("cls", F.coalesce("component", "cls").alias("component"))
    pairs = _across(placed.join(sets, "cls"), shingles[::-1].view(np.int64), least).join(tried, ["a", "b"], "left_anti")
    links = stored(links.union(_verified(pairs, sets, least)))

    component = connected_components(links)
    labelled = classes.join(component.withColumnRenamed("node", "cls"), "cls", "left").select("key", "key2", "doc", F.coalesce("component", "cls").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("doc").alias("component_id"))
    by_class = labelled.join(smallest, "component").select("key", "key2", "component", "component_id")
    out = members.join(by_class, ["key", "key2"], "left")
    own = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.nullif("component_id", F.lit(-(1 << 63))))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), "text_key", "component")
