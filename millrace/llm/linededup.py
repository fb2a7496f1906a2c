"""Line dedup by content-defined chunks of lines, with DataFrame functions only.

Each line is hashed; a rolling hash over the last WINDOW line hashes ends a chunk wherever
it is a multiple of DIVISOR, so boundaries move with the content when lines are inserted or
removed.  Of chunks of two or more lines that occur more than once in the whole table, the
first (by doc_id, nulls first, then by place) stays; the others are removed if their bytes
are equal to the first one's.

A null text stays null.  An empty text has one empty line and is never removed, as single
lines aren't.  Rows of equal id and text count as one document and stay as often as they
are; they are known by 128 bits of a digest of both.  A document may lose all its lines; its text
is then empty and removed_lines says so.  Columns of other names are kept as they are, whatever their
names; n_lines and removed_lines of the input are replaced.

Chunks meet by digest with one row for each repeated digest, in a join that adaptive execution
can split.  The bytes of a chunk that occurs more than PACKET times are compared in several
parts, each with a copy of the first.  Texts are shuffled by document, twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

WINDOW = 2
DIVISOR = 3
FACTOR = 31
LEAST_LINES = 2
#: Occurrences of a chunk that one part compares with the first.
PACKET = 2_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def chunks_of(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """The chunks (start, len) of a text's lines."""

    def bounded(hashes: Column) -> Column:
        def ends(i: Column) -> Column:
            rolling = sum((F.coalesce(F.get(hashes, i - j), F.lit(0)) * FACTOR**j for j in range(window)), F.lit(0))
            return (i == F.size(hashes) - 1) | (rolling % divisor == 0)

        def made(at: Column) -> Column:
            start = lambda k: F.coalesce(F.get(at, k - 1) + 1, F.lit(0))
            return F.transform(at, lambda e, k: F.struct(start(k).alias("start"), (e - start(k) + 1).alias("len")))

        return _let(F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), ends), made)

    return _let(F.transform(lines_of(text), line_hash), bounded)


def _part(lines: Column, chunk: Column) -> Column:
    return F.array_join(F.slice(lines, chunk["start"] + 1, chunk["len"]), "\n")


def deduped(docs: DataFrame, text: str = "text", window: int = WINDOW, divisor: int = DIVISOR, least: int = LEAST_LINES) -> DataFrame:
    """docs with repeated chunks taken out of `text`, and n_lines and removed_lines."""
    # the columns of docs travel as one, so that none clashes with those made here
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col(text))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("doc"), F.col(text).alias("whole"), F.unhex(F.md5(identity.cast("binary"))).alias("key"))
    long_chunks = F.filter(chunks_of(F.col("whole"), window, divisor), lambda c: c["len"] >= least)
    digest = lambda lines: F.transform(long_chunks, lambda c: F.struct(F.unhex(F.md5(_part(lines, c).cast("binary"))).alias("digest"), c["start"].alias("start"), c["len"].alias("len")))
    found = rows.where(F.instr("whole", "\n") > 0).select("key", "doc", F.explode(_let(lines_of(F.col("whole")), digest)).alias("c")).select("key", "doc", "c.*")
    found = stored(found)
    place = F.struct("doc", "key", "start")
    repeated = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    marked = found.join(repeated, "digest").select("key", F.struct("digest", "start", "len", "n", place.eqNullSafe(F.col("first")).alias("is_first")).alias("mark"))
    # Equal rows have equal marks.
    by_doc = marked.groupBy("key").agg(F.collect_set("mark").alias("marks"))
    parts = lambda lines: F.transform("marks", lambda m: F.struct(*(m[c].alias(c) for c in ("digest", "start", "len", "n", "is_first")), _part(lines, m).alias("part")))
    texts = rows.select("key", "whole").join(by_doc, "key").select("key", F.explode(_let(lines_of(F.col("whole")), parts)).alias("m")).select("key", "m.*")
    texts = stored(texts.withColumn("packets", F.ceil(F.col("n") / PACKET).cast("int")).drop("n"))
    originals = texts.where("is_first").dropDuplicates(["digest"]).select("digest", F.explode(F.expr("sequence(0, packets - 1)")).alias("packet"), F.col("part").alias("original"))
    others = texts.where("NOT is_first").withColumn("packet", F.pmod(F.xxhash64("key", "start"), "packets").cast("int"))
    equal = others.join(originals, ["digest", "packet"]).where("part = original")
    removed = equal.groupBy("key").agg(F.collect_set(F.struct("start", "len")).alias("removed"))
    inside = lambda i: F.exists("removed", lambda r: (i >= r["start"]) & (i < r["start"] + r["len"]))
    kept = _let(lines_of(F.col("whole")), lambda lines: F.array_join(F.filter(lines, lambda _, i: ~inside(i)), "\n"))
    gone = F.coalesce(F.aggregate("removed", F.lit(0), lambda n, r: n + r["len"]), F.lit(0)).cast("long")
    out = rows.join(removed, "key", "left")
    return out.select(
        *(F.when(F.col("removed").isNull(), F.col("whole")).otherwise(kept).alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in ("n_lines", "removed_lines")),
        F.when(F.col("whole").isNull(), 0).otherwise(F.size(lines_of(F.col("whole")))).cast("long").alias("n_lines"),
        gone.alias("removed_lines"),
    )


#: DuckDB SQL for doc_id, n_lines, removed_lines and text, where ids are unique.
SQL = f"""
WITH numbered AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), hashed AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM numbered
), ended AS (
  SELECT *, (h + {FACTOR} * lag(h, 1, 0) OVER w) % {DIVISOR} = 0 AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), chunked AS (
  SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM ended
), chunks AS (
  SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS part FROM chunked GROUP BY doc_id, no
), gone AS (
  SELECT doc_id, no FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, no) AS place FROM chunks WHERE n >= {LEAST_LINES}) WHERE place > 1
)
SELECT c.doc_id, count(*) AS n_lines, count(g.no) AS removed_lines,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (g.no IS NULL), '') AS text
FROM chunked c LEFT JOIN gone g ON c.doc_id = g.doc_id AND c.no = g.no GROUP BY c.doc_id"""
