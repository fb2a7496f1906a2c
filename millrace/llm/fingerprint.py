"""Document fingerprints by consistent weighted sampling, with DataFrame functions only.

A document's terms are its words, weighted by their number.  For each of SAMPLES functions
every term draws r and c from Gamma(2, 1) and b from [0, 1) by its hash; a weight w gives
t = floor(ln w / r + b) and ln a = ln c - r (t - b) - r, and the sample is the (term, t) of
the smallest a.  Two documents agree in a sample with a probability of their generalised
Jaccard similarity, the sum of smaller by the sum of larger weights.

A Gamma(2, 1) draw is minus the logarithm of a product of two uniform draws, and all uniform
draws of a term and function are bits of one hash of 64.  ln a in fixed point and a hash of
(term, t) share one long, so that a sample is a minimum of longs, held in place by the
aggregation.  A text and its edited text share most terms: a term is drawn for once, with
its weights in both.

A null or empty text, or one without words, has the empty word as its only term.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
GROUP = 8
SEPARATORS = " \t\n\x0b\f\r"
#: Characters that a bucket of neighbouring documents gets, and the most buckets; beyond that they get larger.
BUCKET_CHARS = 1_000_000
MOST_BUCKETS = 20_000
#: Sampled documents for each bucket, whose ids set the bounds of buckets.
SAMPLED = 16
_FIXED, _SHIFT, _LOW = float(1 << 22), 32, (1 << 32) - 1
_NULL = -(1 << 63)


def words(text: Column) -> Column:
    """The words of a text; one empty word if there is none."""
    return F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS)), "[\\x20\\x09-\\x0D]+")


def uniform(h: Column, at: int, bits: int) -> Column:
    """Some bits of a hash as a number between 0 and 1, neither included."""
    return (F.shiftrightunsigned(h, at).bitwiseAND(F.lit((1 << bits) - 1)) + F.lit(0.5)) * F.lit(2.0**-bits)


def draws(h: Column) -> tuple[Column, Column, Column]:
    """r and ln c, of Gamma(2, 1), and b, uniform, by a hash of 64 bits."""
    r = -F.log(uniform(h, 0, 10) * uniform(h, 10, 10))
    ln_c = F.log(-F.log(uniform(h, 20, 15) * uniform(h, 35, 15)))
    return r, ln_c, uniform(h, 50, 14)


def signatures(weights: DataFrame, keys: list[str], logs: dict[str, str], samples: int = SAMPLES) -> DataFrame:
    """keys, and for each (name, column) of logs a signature array<long> of that name.

    Rows are (keys, term, logarithms of weights, null where a term isn't there); each is dealt
    to the groups of GROUP functions, which keeps compiled methods small.
    """
    names = range(GROUP)
    rows = weights.select(*keys, "term", *logs.values(), F.explode(F.sequence(F.lit(0), F.lit(-(-samples // GROUP) - 1))).alias("group_"))
    step = rows.select("*", *(F.xxhash64(F.col("group_") * GROUP + k, "term").alias(f"h{k}") for k in names))
    drawn = {k: draws(F.col(f"h{k}")) for k in names}
    step = step.select(*keys, "group_", "term", *logs.values(), *(x.alias(f"{n}{k}") for k in names for n, x in zip("rcb", drawn[k], strict=True)))

    def packed(k: int, log: str) -> Column:
        r, ln_c, b = (F.col(f"{x}{k}") for x in "rcb")
        t = F.floor(F.col(log) / r + b)
        ln_a = ln_c - r * (t - b) - r
        return F.shiftleft(F.floor((ln_a + 200.0) * _FIXED), _SHIFT).bitwiseOR(F.col("term").bitwiseXOR(F.shiftleft(t, 20)).bitwiseAND(F.lit(_LOW)))

    found = step.groupBy(*keys, "group_").agg(*(F.min(packed(k, log)).alias(f"{name}{k}") for name, log in logs.items() for k in names))
    parts = [F.array(*(F.col(f"{name}{k}").bitwiseAND(F.lit(_LOW)) for k in names)).alias(name) for name in logs]
    whole = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("group_", *parts))).alias("parts"))
    joined = lambda name: F.slice(F.flatten(F.transform("parts", lambda p: p[name])), 1, samples)
    return whole.select(*keys, *(joined(name).alias(name) for name in logs))


def as_text(signature: Column) -> Column:
    """A signature as lower-case hexadecimal digits, eight for a sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples in which two signatures agree."""
    same = F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda n, x: n + x) / F.size(a)


def _log(n: Column) -> Column:
    return F.when(n > 0, F.log(n.cast("double")))


def fingerprints(docs: DataFrame, keys: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """keys and signature of each row; keys should tell rows apart."""
    terms = docs.select(*keys, F.explode(words(F.col(text))).alias("word")).select(*keys, F.xxhash64("word").alias("term"))
    weighed = terms.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n")).select(*keys, "term", _log(F.col("n")).alias("ln_w"))
    return signatures(weighed, keys, {"signature": "ln_w"}, samples)


def _order(text: Column) -> Column:
    """The first seven bytes of a text as a number, which is in the order of texts."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")


def neighbour_buckets(docs: DataFrame, text: str = "text") -> tuple[DataFrame, int]:
    """Rows of docs (doc_id, text) with bucket and helper.

    Buckets are ranges of (doc_id, start of the text) of about BUCKET_CHARS characters, bounded by
    those of sampled documents; which are sampled changes no result.  The first documents of a
    bucket come once more as helper rows at the end of the one before, the first of all at
    the end of the last, so that every document's successor is in its own bucket.
    """
    placed = docs.withColumn("at", F.coalesce("doc_id", F.lit(_NULL))).withColumn("at2", _order(F.col(text)))
    weight = F.length(text) + 100
    place = F.col("at").cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(18,0)") + F.col("at2").cast("decimal(18,0)")
    total = placed.agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("chars"), F.min(place).alias("first")).first()
    if not total.n:
        return docs.withColumn("bucket", F.lit(0)).withColumn("helper", F.lit(0)), 1
    wanted = min(MOST_BUCKETS, -(-total.chars // BUCKET_CHARS))
    bounds: list[tuple[int, int]] = []
    if wanted > 1:
        share = min(1.0, SAMPLED * wanted / total.n)
        found = placed.sample(share, seed=1).select("at", "at2", weight.alias("chars")).toPandas().sort_values(["at", "at2"])
        if len(found):
            step = np.floor(found["chars"].cumsum().to_numpy() * wanted / max(1, int(found["chars"].sum())) - 1e-9)
            starts = found[np.concatenate([[False], step[1:] != step[:-1]])]
            bounds = sorted({(int(a), int(b)) for a, b in zip(starts["at"], starts["at2"], strict=True)})
    first = divmod(int(total.first), 1 << 56)
    bounds = [x for x in bounds if x > first]
    firsts = [first, *bounds]
    array = lambda values: F.lit(np.array(values, np.int64))
    ids, starts = array([x[0] for x in firsts]), array([x[1] for x in firsts])
    # binary search for the last first document that is not after this one
    steps = [1 << k for k in reversed(range(len(firsts).bit_length()))]
    reaches = lambda k: (F.get(ids, k) < F.col("at")) | ((F.get(ids, k) == F.col("at")) & (F.get(starts, k) <= F.col("at2")))
    search = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda k, step: F.when(reaches(k + step), k + step).otherwise(k))
    rows = placed.withColumn("bucket", search)
    begins = (F.get(ids, F.col("bucket")) == F.col("at")) & (F.get(starts, F.col("bucket")) == F.col("at2"))
    at = lambda b, helper: F.struct(b.cast("int").alias("bucket"), F.lit(helper).alias("helper"))
    none = F.array().cast("array<struct<bucket:int,helper:int>>")
    before = F.when(begins & (F.col("bucket") > 0), F.array(at(F.col("bucket") - 1, 1))).otherwise(none)
    around = F.when(begins & (F.col("bucket") == 0), F.array(at(F.lit(len(firsts) - 1), 2))).otherwise(none)
    rows = rows.withColumn("place", F.explode(F.concat(F.array(at(F.col("bucket"), 0)), before, around)))
    return rows.select("doc_id", text, F.col("place.bucket").alias("bucket"), F.col("place.helper").alias("helper")), len(firsts)


def with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each document of docs (doc_id, text) and of its edited text, and their likeness.

    The edited text has the last half replaced by the first characters of the next document
    by doc_id (nulls first, equal ids by text).  One shuffle of the texts by range of ids
    serves the order, the words and the signatures.
    """
    rows, buckets = neighbour_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    dealt = rows.repartition(max(buckets, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) if buckets > 1 else 1), "bucket")
    order = Window.partitionBy("bucket").orderBy("helper", F.col("doc_id").asc_nulls_first(), "text")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half))
    paired = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("place", F.row_number().over(order))
    paired = paired.withColumn("edited", F.when(F.col("helper") == 0, edited))
    keys = ["bucket", "place", "helper", "doc_id", "n_chars", "sha"]
    own = [n.cast("long").alias("n_chars"), F.unhex(F.sha2(F.col("edited").cast("binary"), 256)).alias("sha")]
    variant = lambda k, t: F.struct(F.lit(k).alias("edit"), t.alias("text"))
    both = F.when(F.col("helper") == 0, F.array(variant(0, F.col("text")), variant(1, F.col("edited")))).otherwise(F.array(variant(0, F.col("text"))))
    texts = paired.select("bucket", "place", "helper", "doc_id", *own, F.explode(both).alias("v")).select(*keys, "v.edit", words(F.col("v.text")).alias("words"))
    terms = texts.select(*keys, "edit", F.explode("words").alias("word")).select(*keys, "edit", F.xxhash64("word").alias("term"))
    weighed = terms.groupBy(*keys, "term").agg(F.sum(1 - F.col("edit")).alias("n"), F.sum("edit").alias("m"))
    weighed = weighed.select(*keys, "term", _log(F.col("n")).alias("ln_w"), _log(F.col("m")).alias("ln_e"))
    signed = signatures(weighed, keys, {"signature": "ln_w", "edited_signature": "ln_e"}, samples)
    along = Window.partitionBy("bucket").orderBy("place")
    met = signed.withColumn("next_signature", F.lead("signature").over(along))
    return met.where("helper = 0").select("doc_id", "n_chars", "sha", "signature", "edited_signature", "next_signature")
