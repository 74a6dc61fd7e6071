"""Token counts by a compiled finite-state transducer (operator 4).

The tokenizer is compiled into a deterministic transducer.  Its input is the
text's characters; its state is the word that is open (the empty word at the
start and after white space).  A character of a word leads to the longer open
word and emits nothing; white space leads back to the start and emits the
number of tokens of the word that it closes.  States are compiled when they
are first met: the count on a closing transition is the length of the
library's own encoding of the word, asked once per word and kept in a table of
bounded size.  A text with \\x1c-\\x1f goes to the library whole.

A chunk of text is a map from the state before it to the state after it and
the count emitted.  Because white space forgets the open word, that map has a
finite form, ``(head, count, tail)``: the characters that lengthen the open
word, the tokens of the words that lie wholly inside, and the word left open.
Maps compose associatively, so the chunks of a text are mapped independently
and their maps are composed in pairs, inside the row's task.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated
rows and null ids stay as they are; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm.common import Symbols, documents, texts
from tillroll.llm.word_tokens import CACHE_CHARS, CACHE_WORDS, NOT_SPACE, library_ids

#: Characters of a chunk.
CHUNK = 1 << 14
LIMIT = 2048


@dataclass(frozen=True)
class ChunkMap:
    """``closed`` is false while no white space was met: then the map only
    lengthens the open word by ``head``."""

    head: str
    count: int = 0
    tail: str = ""
    closed: bool = False


IDENTITY = ChunkMap("")


class CountTransducer:
    """Closing transitions annotated with the tokens that they emit."""

    def __init__(self, path: str) -> None:
        self.path = path
        self._clear()

    def _clear(self) -> None:
        self.words, self.emits = Symbols(), np.zeros(0, np.int64)

    def compile(self) -> None:
        """Annotate the closing transitions met since the last call."""
        fresh = self.words.take_fresh()
        if fresh:
            counts = np.fromiter(map(len, library_ids(self.path, fresh)), np.int64, len(fresh))
            self.emits = np.concatenate([self.emits, counts])

    def close(self, word: str) -> int:
        """Tokens emitted when ``word`` is closed."""
        if not word:
            return 0
        i = self.words[word]
        self.compile()
        return int(self.emits[i])

    def maps(self, chunks: list[str]) -> list[ChunkMap]:
        """The state map of each chunk."""
        if len(self.words) > CACHE_WORDS or self.words.chars > CACHE_CHARS:
            self._clear()
        shapes, inner = [], []
        for chunk in chunks:
            words = chunk.split()
            if not words:
                shapes.append(("", "", bool(chunk)))
                inner.append(np.zeros(0, np.int64))
                continue
            opens = not chunk[0].isspace()
            stays = not chunk[-1].isspace()
            if len(words) == 1 and opens and stays:
                shapes.append((words[0], "", False))
                words = []
            else:
                shapes.append((words[0] if opens else "", words[-1] if stays else "", True))
                words = words[int(opens):len(words) - int(stays)]
            inner.append(self.words.number(words))
        self.compile()
        ends = np.cumsum([0] + [len(x) for x in inner])
        running = np.concatenate([[0], np.cumsum(self.emits[np.concatenate(inner)])]) if inner else np.zeros(1, np.int64)
        counts = running[ends[1:]] - running[ends[:-1]]
        return [ChunkMap(h, int(c), t, closed) for (h, t, closed), c in zip(shapes, counts, strict=True)]

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if not a.closed and not b.closed:
            return ChunkMap(a.head + b.head)
        if not a.closed:
            return ChunkMap(a.head + b.head, b.count, b.tail, True)
        if not b.closed:
            return ChunkMap(a.head, a.count, a.tail + b.head, True)
        return ChunkMap(a.head, a.count + self.close(a.tail + b.head) + b.count, b.tail, True)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: pairs are composed, the scan of the pairs is
        taken, and the prefixes between them are filled in; the compositions
        of one level don't depend on each other."""
        if len(maps) < 2:
            return maps
        pairs = [self.compose(maps[i], maps[i + 1]) for i in range(0, len(maps) - 1, 2)]
        done = self.scan(pairs)
        out = [maps[0]]
        for i in range(1, len(maps)):
            out.append(done[i // 2] if i % 2 else self.compose(done[i // 2 - 1], maps[i]))
        return out

    def reduce(self, maps: list[ChunkMap]) -> ChunkMap:
        """The map of all chunks, by pairs; no prefix is kept."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i:i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def total(self, m: ChunkMap) -> int:
        """Tokens of a text with the map ``m``, from the start state to the
        end, which closes the open word."""
        return self.close(m.head) + (m.count + self.close(m.tail) if m.closed else 0)

    def counts(self, whole: list[str]) -> list[int]:
        """Tokens of each text."""
        chunks, texts_of = [], []
        odd: dict[int, int] = {}
        for i, t in enumerate(whole):
            if any(c in t for c in NOT_SPACE):  # white space in Python only
                odd[i] = len(library_ids(self.path, [t])[0])
                t = ""
            cut = [t[a:a + CHUNK] for a in range(0, len(t), CHUNK)]
            texts_of.append(len(cut))
            chunks += cut
        maps, at, out = self.maps(chunks), 0, []
        for i, n in enumerate(texts_of):
            out.append(odd[i] if i in odd else self.total(self.reduce(maps[at:at + n])) if n else 0)
            at += n
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit), a row per row of ``docs``.
    Each text is counted in the task that reads it; nothing is shuffled."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = CountTransducer(tokenizer_path)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                whole = list(texts(part))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(t.encode()) for t in whole], pa.int64()),
                    pa.array(transducer.counts(whole), pa.int64())], schema=out)

    found = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
