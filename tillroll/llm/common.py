"""Small helpers shared by the corpus operators.

Numpy helpers work inside one Arrow batch; nothing here sees more than one
batch of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.sources.tables import read_table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``docs.mapInArrow`` to rows of the same columns, whatever their names."""
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def ragged_take(flat: np.ndarray, offsets: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``flat[offsets[i]:offsets[i + 1]]`` for ``i`` in
    ``idx``; also return the offsets of the slices in the result."""
    lens = offsets[idx + 1] - offsets[idx]
    out = np.zeros(len(idx) + 1, np.int64)
    np.cumsum(lens, out=out[1:])
    pos = np.arange(out[-1], dtype=np.int64) + np.repeat(offsets[idx] - out[:-1], lens)
    return flat[pos], out


class Symbols(dict):
    """Numbers strings in the order in which they are first seen.  ``fresh``
    lists the strings numbered since the last ``take_fresh``."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []
        self.chars = 0

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.fresh.append(word)
        self.chars += len(word)
        return i

    def take_fresh(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh

    def number(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class RaggedTable:
    """Growing table: row ``i`` is a short integer array, kept flat."""

    def __init__(self, dtype=np.uint32) -> None:
        self.flat = np.zeros(0, dtype)
        self.offsets = np.zeros(1, np.int64)

    def extend(self, rows: list) -> None:
        if not rows:
            return
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        fresh = np.fromiter((x for row in rows for x in row), self.flat.dtype, int(lens.sum()))
        self.flat = np.concatenate([self.flat, fresh])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lens)])

    def extend_flat(self, fresh: np.ndarray, lens: np.ndarray) -> None:
        self.flat = np.concatenate([self.flat, fresh.astype(self.flat.dtype)])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lens)])

    def take(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged_take(self.flat, self.offsets, idx)


def texts(batch: pa.RecordBatch, column: int = 1) -> Iterator[str]:
    """The texts of a batch, a null as the empty text."""
    for x in batch.column(column):
        yield x.as_py() or ""
