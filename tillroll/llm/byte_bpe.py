"""Byte-level BPE encoding and decoding by a global distinct-word shuffle
(operator 5).

1. Every text is exploded into its pre-tokens, the matches of the vocabulary's
   pattern.  Within a block (the texts of a task, about BLOCK_CHARS characters
   at a time) each distinct pre-token gets a number, frequent ones the small
   numbers, and a document becomes the list of its pre-tokens' numbers, by
   position.
2. The blocks' distinct pre-tokens are shuffled by a hash of the pre-token, so
   that all copies of one meet, and each distinct one is encoded once, by the
   merge ranks.
3. The ids go back to the blocks that asked (a join on the block), where each
   document puts its ids together by position.
4. Decoding joins the ids with the table of token bytes, which has a row per
   rank of the vocabulary, and puts the bytes together by position.

A pre-token is shuffled once per block, never once per occurrence, so a frequent
one is not a hot key.  Numbers and words travel in packed rows.

The texts are read twice, once for the words and once for the positions, so
the input must be a plan that gives the same partitions each time: a table's
scan is; anything else is written to a table first (``stable=False``).

Defined results: a null text is an empty one (no ids); null ids of documents
and repeated rows stay; an empty table gives no rows; ids without a token are
an error; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import RaggedTable, Symbols, documents, ragged_take
from tillroll.session import materialize

#: A block is closed when it has so many characters.
BLOCK_CHARS = 16_000_000
#: Bytes of ids in a batch that goes back to Spark.
BATCH_BYTES = 2_000_000
#: A white-space run in which splitting at spaces would cut a match.
RUNS = regex.compile(r"\s \s|\s $")
#: White space besides space and line feed.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def has_runs(text: str) -> bool:
    """``RUNS.search``, behind cheaper looks for two white spaces in a row."""
    return ("  " in text or " \n" in text or "\n " in text or OTHER_SPACE.search(text) is not None) and (
        RUNS.search(text) is not None)


# ------------------------------------------------------------- vocabulary

@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def encode_word(path: str, pattern: str, word: str) -> list[int]:
    """Ids of one pre-token: the merges of its bytes, the pattern isn't used."""
    raw = word.encode()
    own = ranks(path).get(raw)
    return [own] if own is not None else encoding(path, pattern)._encode_single_piece(raw)


@lru_cache(maxsize=2)
def token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token bytes by id, flat, and their offsets."""
    by_id = {i: b for b, i in ranks(path).items()}
    rows = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
    return (np.frombuffer(b"".join(rows), np.uint8),
            np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))


def token_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(id, bytes), a row per rank: the table that decoding joins."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks(path).items()], "id long, bytes binary")


# ------------------------------------------------------------- pre-tokens

#: Marks that are a match of their own behind letters.
MARKS = tuple(".,;:!?")


class Block:
    """The distinct pre-tokens of some texts, and the texts as their numbers;
    ``pattern`` is the vocabulary's.

    Texts are first split at single spaces, where no match can cross, into
    segments; a distinct segment is matched against the pattern once."""

    def __init__(self, pattern: str) -> None:
        self.pattern = regex.compile(pattern)
        self.segments = Symbols()
        self.words = Symbols()
        self.parts = RaggedTable(np.int64)
        self.docs: list[tuple[int | None, np.ndarray]] = []
        self.chars = 0
        self.content = xxhash.xxh3_64()

    def _pieces(self, segment: str) -> list[str]:
        """The pattern's matches in a segment.  Letters behind at most one space
        are one match, with one mark behind them two; that needs no search."""
        letters = segment[1:] if segment[:1] == " " else segment
        if letters.isalpha():
            return [segment]
        if letters[-1:] in MARKS and letters[:-1].isalpha():
            return [segment[:-1], segment[-1]]
        return self.pattern.findall(segment)

    def _cut(self) -> None:
        number = self.words.__getitem__
        self.parts.extend([[number(w) for w in self._pieces(s)] for s in self.segments.take_fresh()])

    def add(self, doc_id: int | None, text: str) -> None:
        self.chars += len(text)
        self.content.update(b"%d %d " % (-1 if doc_id is None else doc_id, len(text)))
        self.content.update(text.encode())
        if has_runs(text):
            segments = self.pattern.findall(text)
        else:
            first, *rest = text.split(" ")
            segments = [first, *[" " + s for s in rest]]
        self.docs.append((doc_id, self.segments.number(segments).astype(np.int32)))

    def name(self) -> int:
        return self.content.intdigest() - (1 << 63)

    def close(self) -> tuple[list[str], Iterator[tuple[int | None, np.ndarray]]]:
        """Distinct pre-tokens, frequent ones first, and each document's
        numbers."""
        self._cut()
        uses = np.bincount(np.concatenate([d for _, d in self.docs]), minlength=len(self.segments)) if self.docs else np.zeros(0)
        count = np.bincount(self.parts.flat, weights=np.repeat(uses, np.diff(self.parts.offsets)), minlength=len(self.words))
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.parts.flat = rank[self.parts.flat]
        words = list(self.words)
        return [words[i] for i in order], ((i, self.parts.take(d.astype(np.int64))[0]) for i, d in self.docs)


def blocks(batches: Iterator[pa.RecordBatch], pattern: str) -> Iterator[tuple[int, Block]]:
    """The task's blocks, each under a hash of its content (blocks of equal
    content have the same words and ids, so they may share a name)."""
    block = Block(pattern)
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            block.add(doc_id.as_py(), text.as_py() or "")
            if block.chars >= BLOCK_CHARS:
                yield block.name(), block
                block = Block(pattern)
    if block.docs:
        yield block.name(), block


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    planes = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def pack_words(words: list[str]) -> bytes:
    raw = [w.encode() for w in words]
    return zlib.compress(np.array([len(words), *map(len, raw)], "<u4").tobytes() + b"".join(raw), 1)


def unpack_words(data: bytes) -> list[str]:
    raw = zlib.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    lengths = np.frombuffer(raw, "<u4", n, 4).astype(np.int64)
    ends = np.cumsum(lengths) + 4 * (n + 1)
    return [raw[a:b].decode() for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]


# --------------------------------------------------------------- operator

def _block_words(docs: DataFrame, pattern: str, parts: int) -> DataFrame:
    """(part, block, places, words): the distinct pre-tokens of each block,
    dealt by hash into ``parts`` parts."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("places", pa.binary()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches, pattern):
            words, _ = block.close()
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(part[order])) + 1, [len(order)]]) if len(order) else [0]
            cols: list[list] = [[], [], [], []]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                at = order[a:b]
                for col, v in zip(cols, (int(part[at[0]]), number, pack(at), pack_words([words[i] for i in at])), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return docs.mapInArrow(run, "part long, block long, places binary, words binary")


def _encode_words(words: DataFrame, path: str, pattern: str) -> DataFrame:
    """(block, places, lengths, ids): each distinct pre-token of a partition is
    encoded once; rows of one part are in one partition."""
    schema = pa.schema([("block", pa.int64()), ("places", pa.binary()), ("lengths", pa.binary()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        part = None
        for batch in batches:
            for p, block, places, packed in zip(*(batch.column(i) for i in range(4)), strict=True):
                if p.as_py() != part:  # rows are sorted by part
                    known, part = {}, p.as_py()
                rows = []
                for w in unpack_words(packed.as_py()):
                    ids = known.get(w)
                    if ids is None:
                        ids = known[w] = encode_word(path, pattern, w)
                    rows.append(ids)
                flat = np.fromiter((x for r in rows for x in r), np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.as_py()], pa.int64()), pa.array([places.as_py()], pa.binary()),
                    pa.array([pack(np.array([len(r) for r in rows]))], pa.binary()), pa.array([pack(flat)], pa.binary())], schema=schema)

    return words.mapInArrow(run, "block long, places binary, lengths binary, ids binary")


def _positions(docs: DataFrame, pattern: str) -> DataFrame:
    """(block, doc_id, numbers): a row per document."""
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("numbers", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks(batches, pattern):
            _, found = block.close()
            while part := [(i, pack(n)) for i, n in islice(found, 256)]:
                yield pa.RecordBatch.from_arrays([
                    pa.array([number] * len(part), pa.int64()), pa.array([i for i, _ in part], pa.int64()),
                    pa.array([n for _, n in part], pa.binary())], schema=schema)

    return docs.mapInArrow(run, "block long, doc_id long, numbers binary")


def _asked(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, stable: bool) -> DataFrame:
    """(block, doc_id, kind, places, lengths, ids), by block: first the rows
    with its words' ids (kind 0), then its documents (kind 1)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not stable:
        rows = materialize(rows, "texts")
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = _block_words(rows, pattern, parts).repartition("part").sortWithinPartitions("part")
    empty = F.lit(None).cast("binary")
    both = _encode_words(words, path, pattern).select(
        "block", F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("kind"), "places", "lengths", "ids").unionByName(
        _positions(rows, pattern).select("block", "doc_id", F.lit(1).alias("kind"), F.col("numbers").alias("places"),
                                         empty.alias("lengths"), empty.alias("ids")))
    return both.repartition("block").sortWithinPartitions("block", "kind")


ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's ids by position, from its block's table."""
    block, got, table = None, [], None
    cols: list[list] = [[], [], []]
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ENCODED, strict=True)], schema=ENCODED)

    for batch in batches:
        for b, doc_id, kind, places, lengths, ids in zip(*(batch.column(i) for i in range(6)), strict=True):
            if b.as_py() != block:
                block, got, table = b.as_py(), [], None
            if kind.as_py() == 0:
                got.append((unpack(places.as_py()), unpack(lengths.as_py()), unpack(ids.as_py())))
                continue
            if table is None:
                table, got = _table(got), []
            found, _ = ragged_take(*table, unpack(places.as_py()))
            for col, v in zip(cols, (doc_id.as_py(), len(found), found.astype("<u4").tobytes()), strict=True):
                col.append(v)
            size += 4 * len(found) + 64
            if size >= BATCH_BYTES:
                yield out()
                cols, size = [[], [], []], 0
    if cols[0]:
        yield out()


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Add the bytes of each row's ids, a take from the table of token bytes."""
    flat, offsets = token_table(path)
    for batch in batches:
        for part in (batch.slice(a, 256) for a in range(0, batch.num_rows, 256)):
            out = []
            for x in part.column("ids"):
                ids = np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64)
                if len(ids) and ids.max() >= len(offsets) - 1:
                    raise ValueError("an id has no token")
                out.append(ragged_take(flat, offsets, ids)[0].tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           stable: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids), ``ids`` little-endian unsigned 32-bit integers,
    a row per row of ``docs``."""
    return _asked(docs, path, pattern, id_col, text_col, stable).mapInArrow(
        _reassemble, "doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
               stable: bool = True) -> DataFrame:
    """``decode(encode(docs))`` in one pass of the tasks' Python."""
    return _asked(docs, path, pattern, id_col, text_col, stable).mapInArrow(
        lambda batches: _decode(_reassemble(batches), path), "doc_id long, n_tokens long, ids binary, decoded binary")


def _table(got: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a block's pre-tokens by number, flat, and their offsets."""
    places = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.int64)
    lengths = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
    flat = np.concatenate([g[2] for g in got]) if got else np.zeros(0, np.int64)
    numbers, order = np.unique(places, return_index=True)
    if not np.array_equal(numbers, np.arange(len(numbers))):
        raise ValueError("a block's pre-tokens are not all there: its texts were not partitioned alike both times")
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    ids, offsets = ragged_take(flat, starts, order)
    return ids.astype(np.uint32), offsets


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``decoded``, the bytes of ``ids``.  The token-byte table has a row
    per rank of the vocabulary, so each task holds it and joins a document's
    ids with it in one take."""
    schema = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes) + ", decoded binary"
    return encoded.mapInArrow(lambda batches: _decode(batches, path), schema)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    found = round_trip(documents(spark, sf_dir), path, pattern)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


