"""Token counts: an exact histogram of encoded lengths and its suffix sums.

Documents are encoded whole and counted by their number of tokens; everything else follows
from the histogram, which has one row for each length that occurs.  Suffix sums over it say
for every context limit how many documents reach it, the tokens kept when texts are cut at
it, and the quantiles.  They are summed within blocks of BLOCK lengths, then over blocks.

A null or empty text has 0 tokens.  Repeated rows count as often as they are, other columns
are ignored, an empty table has an empty histogram.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import common

BLOCK = 1024
_encodings: dict = {}


def encoding(path: str, pattern: str):
    """The encoding of a file of ranks, made once in each worker."""
    import tiktoken

    if path not in _encodings:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _encodings[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def lengths(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """n_tokens of each document."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path, pattern).encode_ordinary
        for batch in batches:
            found = np.fromiter((len(encode(t)) if t else 0 for t in map(pa.StringScalar.as_py, batch.column(0))), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["n_tokens"])

    return docs.select(text).mapInArrow(common.giving_back(run), "n_tokens long")


def histogram(n_tokens: DataFrame) -> DataFrame:
    """For each length: n_docs; docs and tokens at or above it; tokens kept by a limit of that length."""
    counted = common.stored(n_tokens.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = counted.groupBy(F.floor(F.col("n_tokens") / BLOCK).alias("block")).agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_after") for c in "dt"), F.sum("t").over(every).alias("all_tokens"), F.sum("d").over(every).alias("all_docs"))
    own = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).join(blocks, "block")
    docs_from, tokens_from = F.sum("n_docs").over(own) + F.col("d_after"), F.sum(tokens).over(own) + F.col("t_after")
    return rows.select("n_tokens", "n_docs", docs_from.alias("docs_from"), tokens_from.alias("tokens_from"), "all_tokens", "all_docs").select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        (F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from")).alias("tokens_within"),
        ((F.col("all_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
    )


def at_limits(hist: DataFrame, limits: Sequence[int]) -> DataFrame:
    """For each context limit: tokens kept, documents cut, tokens cut off; one pass over the histogram."""
    each = [
        F.struct(
            F.lit(int(x)).cast("long").alias("context"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("n_docs")), F.lit(0)).alias("tokens_within"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > x, F.col("n_docs"))), F.lit(0)).alias("docs_cut"),
            F.coalesce(F.sum(F.greatest(F.col("n_tokens") - int(x), F.lit(0)) * F.col("n_docs")), F.lit(0)).alias("tokens_cut"),
        )
        for x in limits
    ]
    return hist.agg(F.array(*each).alias("rows")).select(F.inline("rows"))


def quantiles(hist: DataFrame, shares: Sequence[float]) -> DataFrame:
    """For each share the smallest length that at least this share of documents doesn't exceed."""
    each = [F.struct(F.lit(float(q)).alias("share"), F.min(F.when(F.col("share_up_to") >= q, F.col("n_tokens"))).alias("n_tokens")) for q in shares]
    return hist.agg(F.array(*each).alias("rows")).select(F.inline("rows"))
