"""Quality classifier: supervised subword embeddings.

A text's features are its words and the character n-grams inside each word and its edges,
hashed to BUCKETS.  Each bucket has a learned vector; a document's vector is the average
over all its features, and a softmax layer over it gives the probability of each label.
Vectors and layer are trained together by stochastic gradient descent in numpy on the
driver, on a bounded sample: the SAMPLE labelled documents of each label whose hashed id is
smallest, labels being read only where crc32 of the id modulo 5 is not 0.  Executors count the
features of these; the driver gets the counts, in order of the hashed id while they are
no more than SAMPLE_FEATURES together, and no text.

With two labels the difference of the logits is an average over features of one number a
bucket, so scoring needs one table of BUCKETS floats (1 MB, whatever the input), and every
whole text is scored in one pass without a shuffle.

A null or empty text has no features and gets the probability of the bias alone.  A null
id counts as held out.  Labels, languages, sources and ids are no inputs of a score.
Repeated rows get repeated scores.  An id with labels of both kinds, or null, is not learned;
of an id's different texts the one of smallest hash is.  Columns of other names stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import common

BUCKETS = 1 << 18
DIM = 16
GRAMS = (2, 3, 4)
#: Labelled documents of each label that the model is trained on, at most.
SAMPLE = 2_500
#: Distinct features of all these documents together that the driver takes, at most (6 bytes each).
SAMPLE_FEATURES = 16_000_000
#: Bytes of text whose features are made at once; they take some hundred times as much memory.
FEATURE_BYTES = 250_000
EPOCHS = 6
RATE = 0.5
#: A document's gradient is spread over thousands of features; this much larger are their steps.
BOOST = 8.0
FOLDS = 5
CUT = 0.3
SEED = 11


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all features, row after row, and the rows' offsets."""
    rows = len(offsets) - 1
    start, end, first = common.word_spans(data, offsets)
    words = common.word_hashes(data, start, end)
    # All texts with a space around each, so that no n-gram spans two of them.
    row_of = np.repeat(np.arange(rows), np.diff(offsets))
    flat = np.full(len(data) + rows + 1, 32, np.uint64)
    flat[np.arange(len(data)) + row_of + 1] = data
    solid = ~common._IS_SPACE[flat.astype(np.uint8)]
    owner = np.full(len(flat), 0, np.int64)
    owner[np.arange(len(data)) + row_of + 1] = row_of
    parts, owners = [(words % np.uint64(BUCKETS)).astype(np.int32)], [np.repeat(np.arange(rows), np.diff(first))]
    weight = common.seeds(77, max(GRAMS, default=1))
    for n in GRAMS:
        count = len(flat) - n + 1
        if count <= 0:
            continue
        inner = np.ones(count, bool)
        for j in range(1, n - 1):
            inner &= solid[j : j + count]
        if n == 2:
            inner = solid[:count] | solid[1 : 1 + count]
        at = np.flatnonzero(inner)
        # a gram belongs to the row of a character in it that is not a space
        row = owner[at + 1] if n > 2 else np.where(solid[at], owner[at], owner[at + 1])
        with np.errstate(over="ignore"):
            value = sum((flat[at + j] * weight[j] for j in range(n)), np.full(len(at), np.uint64(n)))
            parts.append((common.mix64(value) % np.uint64(BUCKETS)).astype(np.int32))
        owners.append(row)
    value, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner.astype(np.int32), kind="stable")
    return value[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))]).astype(np.int64)


def row_sums(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """For each text the average over its features of table[feature]; 0 without features."""
    data, offsets = common.text_buffers(column)
    out = np.zeros(len(offsets) - 1)
    for a, b in common.byte_slices(offsets, FEATURE_BYTES):
        value, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        found, n = table[value], np.diff(at)
        for k in np.flatnonzero(n):  # each row's own sum, so that equal texts get equal scores
            out[a + k] = found[at[k] : at[k + 1]].sum(dtype=np.float64) / n[k]
    return out


def bags(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct features and their shares of all its features."""
    data, offsets = common.text_buffers(column)
    for a, b in common.byte_slices(offsets, FEATURE_BYTES):
        value, at = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for k in range(b - a):
            ids, counts = np.unique(value[at[k] : at[k + 1]], return_counts=True)
            yield ids, (counts / max(1, counts.sum())).astype(np.float32)


def train(found: list[tuple[np.ndarray, np.ndarray]], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Train on the features of whole texts (`bags`); the table of logit differences by bucket, and the bias."""
    if not found or len(set(labels)) < 2:
        share = (sum(labels) + 1) / (len(labels) + 2)
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    y = np.asarray(labels)
    share = np.bincount(y, minlength=2) / len(y)
    total, done = epochs * len(found), 0
    for _ in range(epochs):
        for k in rng.permutation(len(found)):
            ids, weights = found[k]
            step = rate * (1 - done / total) * 0.5 / share[y[k]]
            done += 1
            hidden = weights @ vectors[ids] if len(ids) else np.zeros(DIM, np.float32)
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y[k]] -= 1
            back = layer.T @ p
            layer -= (step * 0.5) * np.outer(p, hidden)
            bias -= (step * 0.05) * p
            if len(ids):
                vectors[ids] -= (step * BOOST) * weights[:, None] * back
    table = vectors @ (layer[1] - layer[0])
    return table.astype(np.float32), float(bias[1] - bias[0])


def sample(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> DataFrame:
    """doc_id, text and label_ of at most `most` documents of each label that are not held out."""
    value = F.col(label).cast("int")
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(value).alias("label_"), F.max(value).alias("other_")).where("label_ = other_").drop("other_")
    picked = None
    for k in (0, 1):
        part = known.where(F.col("label_") == k).orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "label_").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, float]:
    """`train` on the features of the sample, which executors count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(bags(batch.column(2)))
            bytes_of = [pa.array([x[k].tobytes() for x in made], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x[0]) for x in made], pa.int64()), *bytes_of], names=["doc_id", "label_", "n", "ids", "shares"])

    chosen = sample(docs, labels, label, most).select(F.col("doc_id").cast("string").alias("doc_id"), "label_", "text")
    counted = common.stored(chosen.mapInArrow(common.giving_back(count), "doc_id string, label_ int, n long, ids binary, shares binary"))
    sizes = counted.select(F.xxhash64(F.lit(SEED), "doc_id").alias("draw"), "doc_id", "n").orderBy("draw", "doc_id").collect()
    last = int(np.searchsorted(np.cumsum([r.n for r in sizes]), SAMPLE_FEATURES, side="right"))
    taken = {r.doc_id for r in sizes[:last]}
    found, known, r = {}, {}, None
    for r in counted.toLocalIterator():
        if r.doc_id in taken:
            found[r.doc_id] = np.frombuffer(r.ids, np.int32), np.frombuffer(r.shares, np.float32)
            known[r.doc_id] = r.label_
    order = sorted(found)
    model = train([found[k] for k in order], [known[k] for k in order])
    del sizes, taken, found, known, r
    common.give_back()  # the driver has other work after this
    return model


def scored(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, cut: float = CUT) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 if score >= cut, else 0)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    table, bias = learned(docs, labels, label, most)
    model = spark.sparkContext.broadcast((table, bias))
    base = docs.select(*(c for c in docs.columns if c.lower() not in ("held_out", "score", "predicted")), held_out(F.col("doc_id")).alias("held_out"))
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = model.value
        for batch in batches:
            logit = row_sums(batch.column(batch.schema.get_field_index("text")), table) + bias
            score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            made = [pa.array(score), pa.array((score >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=schema.names)

    return base.mapInArrow(common.giving_back(run), schema)
