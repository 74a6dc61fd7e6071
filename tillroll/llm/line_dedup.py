"""Line dedup across documents (operator 11), DataFrame functions only.

Texts are split at ``\\n``.  A line's key is the line without the white space
``[\\x20\\x09-\\x0D]`` at both ends, A-Z in lower case; it travels as two
independent 64-bit hashes.  Keys of at least ``min_chars`` code points that
stand in at least ``min_docs`` documents lose all their lines but those of the
document with the largest id; what stays is joined by ``\\n`` in its old order.

Every document has a salt, a part of its id's hash.  A key's documents are
counted for each salt first and the counts are added up; the verdict goes back
to the salts in which the key stands.  So a line that a third of all documents
share is spread over SALTS tasks on each way, and only hashes and positions
travel; a text moves once, to meet its own list of dropped positions.

Defined results: a null or empty text is one empty line; a document is its id,
so rows with one id (null is an id too, the smallest) count once and keep or
lose a key together; equal rows are kept apart in the result; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import documents
from tillroll.session import materialize

MIN_CHARS, MIN_DOCS = 40, 5
SALTS = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line stripped, A-Z in lower case (``lower`` does that, and faster,
    where every character is one byte)."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def two_hashes(value: Column, prefix: str) -> dict[str, Column]:
    """Two 64-bit hashes with different seeds."""
    return {f"{prefix}1": F.xxhash64(value), f"{prefix}2": F.xxhash64(F.lit(7), value)}


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumns(two_hashes(F.col("text"), "t"))


def long_lines(rows: DataFrame, min_chars: int) -> DataFrame:
    """(salt, doc_id, t1, t2, k1, k2, pos): the lines whose key is long enough."""
    lines = rows.select("doc_id", "t1", "t2", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.filter(F.char_length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    return (keyed.filter(F.char_length("key") >= min_chars).withColumns(two_hashes(F.col("key"), "k"))
            .select(F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"), "doc_id", "t1", "t2", "k1", "k2", "pos"))


def common_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(salt, k1, k2, last): the keys of enough documents, a row for each salt
    that has one, with the largest id."""
    key = ["k1", "k2"]
    by_salt = (lines.select("salt", *key, "doc_id").distinct().groupBy("salt", *key)
               .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last")))
    total = by_salt.groupBy(*key).agg(F.sum("n").alias("n"), F.max("last").alias("last")).filter(F.col("n") >= min_docs)
    return by_salt.select("salt", *key).join(total.select(*key, "last"), key)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text, n_lines, dropped): each document's remaining text, its
    number of lines before, and the dropped lines' positions (from 0)."""
    rows = _rows(docs)
    lines = materialize(long_lines(rows, min_chars), "long-lines")
    gone = (
        lines.join(common_keys(lines, min_docs), ["salt", "k1", "k2"])
        .filter(~F.col("doc_id").eqNullSafe(F.col("last")))
        .groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
        .select(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "dropped")
    )
    met = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    split = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped"))
    return met.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n")).alias("text"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with split as (
    select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
),
lines as (
    select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from split
),
keyed as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from lines
),
common as (
    select key, max(doc_id) as last from keyed
    where length(key) >= 40 group by key having count(distinct doc_id) >= 5
),
judged as (
    select k.doc_id, k.line, k.pos, c.key is not null and k.doc_id <> c.last as dropped
    from keyed k left join common c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
from judged group by doc_id
"""
