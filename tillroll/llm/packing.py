"""Packing by power-of-two decomposition (operator 1).

Every document's ids (with one end id) are cut into pieces of the largest
length first: as many pieces of ``max_len`` as fit, then the binary digits of
the rest.  A piece is a sequence of its own, so no sequence crosses documents
and, as every length is a power of two, none needs padding.  Sequences of equal
length form a bucket; ``bucket_sequences`` numbers them.

Defined results: a null or empty text has only the end id (one piece of length
1); null ids of documents are kept; repeated rows give their pieces again,
under other sequence ids; an empty table gives no pieces; other columns of the
input are ignored, whatever their names.  A document may have any length: its
pieces are cut in the task that reads its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import documents, texts
from tillroll.llm.word_tokens import WordIds

MAX_LEN = 2048
END_ID = 1
#: Each bucket is numbered in so many independent slots.
SLOTS = 4096

#: Texts of a batch are encoded so many characters at a time.
STEP_CHARS = 4_000_000


def piece_lengths(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of ``n`` tokens: powers of two, longest first."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(max_len.bit_length() - 1, -1, -1) if rest >> b & 1]


def _steps(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    """Runs of rows of a batch of about STEP_CHARS characters."""
    start, run, chars = 0, [], 0
    for t in texts(batch):
        run.append(t)
        chars += len(t)
        if chars >= STEP_CHARS:
            yield start, run
            start, run, chars = start + len(run), [], 0
    if run:
        yield start, run


def pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
           max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens), a row per piece; ``ids`` are
    little-endian unsigned 32-bit integers.  ``max_len`` is a power of two."""
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                     ("ids", pa.binary()), ("doc_tokens", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer_path)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for first, run in _steps(batch):
                ids, at = encoder.encode(run)
                # room for the end id behind each document
                whole = np.full(len(ids) + len(run), end_id, np.uint32)
                n = np.diff(at) + 1
                ends = np.cumsum(n)
                whole[np.delete(np.arange(len(whole)), ends - 1)] = ids
                raw = whole.astype("<u4").tobytes()
                cols: tuple[list, ...] = ([], [], [], [], [])
                for k, (count, end) in enumerate(zip(n.tolist(), ends.tolist(), strict=True)):
                    start, base = 0, end - count
                    for length in piece_lengths(count, max_len):
                        a = (base + start) * 4
                        for col, v in zip(cols, (doc_ids[first + k], start, length, raw[a:a + 4 * length], count), strict=True):
                            col.append(v)
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long")


def bucket_sequences(found: DataFrame, slots: int = SLOTS, max_len: int = MAX_LEN) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (0: a sequence is one piece).  Equal
    lengths form a bucket, dealt into ``slots`` slots by a hash of the piece;
    a sequence's number follows from its rank in its slot, so the shuffle needs
    no count of anything beforehand and no bucket meets in one task."""
    bits = F.lit(max_len.bit_length())
    bucket = F.log2("length").cast("int")
    slot = F.pmod(F.xxhash64("doc_id", "start"), F.lit(slots))
    rank = F.row_number().over(Window.partitionBy("_bucket", "_slot").orderBy(
        F.col("doc_id").asc_nulls_first(), "start", "doc_tokens"))
    return (
        found.withColumn("_bucket", bucket).withColumn("_slot", slot)
        .withColumn("sequence_id", (((rank - 1) * bits + F.col("_bucket")) * F.lit(slots) + F.col("_slot")).cast("long"))
        .withColumn("offset", F.lit(0).cast("long"))
        .drop("_bucket", "_slot")
    )


def packed_digests(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with the CRC-32 of their ids in place of the ids."""
    import public_tokenizers

    cut = pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    # the digest comes before the shuffle, which then moves no ids
    return bucket_sequences(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op1_pow2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(documents(spark, sf_dir))
