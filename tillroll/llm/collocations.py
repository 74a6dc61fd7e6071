"""Phrase collocations (operator 13), mined by Toivonen's sampling.

Texts (A-Z in lower case) are cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those into words ``[^\\x20\\x09]+``; a phrase is one to three neighbouring words
of a piece, counted for each language.  A phrase can only be frequent if the
shorter phrases in it are.

1. A sample of the documents (one in SAMPLE, by hash) proposes words and word
   pairs: those that it holds SAMPLE_COUNT times.  The threshold is lower than
   the sample's share of ``min_count``, so most frequent phrases are proposed.
2. A pass over all documents counts the proposed phrases and their negative
   border exactly: every phrase that isn't proposed but whose shorter phrases
   all are (each word is one, as it has none).
3. Frequent border phrases are failures of the sample.  They join the proposed
   ones, and a further pass counts the phrases that are now proposed or border
   and weren't before.  That ends when no frequent phrase lies outside, so the
   counts are exact and complete whatever the sample was; there are at most
   three passes, as phrases have three words at most.

What is proposed goes to the tasks as two bitmaps of fixed size (WORD_BITS,
PAIR_BITS), which hold a bit for the hash of each proposed phrase.  A bit that
two phrases share only lets a pass count more phrases than it must.  A task
cuts a run of texts of one language into words in arrays, counts by sorting
packed word numbers, and hands over the run's distinct phrases with their
counts, packed into a row for each bucket of phrases (by hash); buckets are
shuffled and added up.  A frequent phrase has an entry for each run, not for
each place where it stands.

Long texts are worked through in chunks that carry two words over their cut.

Defined results: a null text is empty, a null language ``und``; repeated rows
count as often as they stand; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.session import materialize
from tillroll.sources.tables import read_table

MIN_COUNT, TOP = 10, 2000
SAMPLE, SAMPLE_COUNT = 16, 2
WORD_BITS, PAIR_BITS = 1 << 24, 1 << 26
SALTS = 64
#: Bytes of a chunk of a long text, of the texts of a run; entries at once.
CHUNK, HELD, ENTRIES_AT_ONCE = 4 << 20, 8 << 20, 250_000
#: A word's number in a packed phrase.
BITS = 21

#: Buckets of phrases for each shuffle partition; a task adds up one at a time.
BUCKETS = 2
PACKED = pa.ipc.IpcWriteOptions(compression="lz4")
ENTRIES = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def _table() -> bytes:
    t = list(range(256))
    t[ord("A"):ord("Z") + 1] = range(ord("a"), ord("z") + 1)
    for c in b".,;:!?\n\x0b\x0c\r":
        t[c] = 10
    t[9] = 32
    return bytes(t)


LOWER_AND_CUT = _table()


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = zlib.crc32(lang.encode())
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two words' hashes, in this order."""
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class Proposed:
    """The bitmaps of proposed words and pairs."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray) -> None:
        self.words, self.pairs = words, pairs

    @classmethod
    def none(cls) -> Proposed:
        return cls(np.zeros(WORD_BITS // 8, np.uint8), np.zeros(PAIR_BITS // 8, np.uint8))


def chunks(text: bytes) -> Iterator[tuple[bytes, int]]:
    """A long text in chunks, cut between words, and how many words each repeats
    from the end of the one before: two, or those of the open piece."""
    at, carry = 0, b""
    while at < len(text):
        end = len(text)
        if end - at > CHUNK:
            end = max(text.rfind(b"\n", at, at + CHUNK), text.rfind(b" ", at, at + CHUNK)) + 1
            if end <= at:  # a word longer than a chunk ends it
                ends = [x for x in (text.find(b"\n", at + CHUNK), text.find(b" ", at + CHUNK)) if x >= 0]
                end = min(ends) + 1 if ends else len(text)
        chunk = carry + text[at:end]
        yield chunk, len(carry.split())
        last = chunk[chunk.rfind(b"\n") + 1:].rsplit(None, 2)[-2:]
        carry = b"".join(w + b" " for w in last)
        at = end


class Run:
    """The words of some texts of one language, cut from their bytes in arrays:
    the distinct words, each word's number and the piece that it stands in."""

    def __init__(self, lang: str, text: bytes, carried: int = 0) -> None:
        raw = np.frombuffer(text, np.uint8)
        cut = raw == 10
        inside = ~(cut | (raw == 32))
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        offsets = np.zeros(len(starts) + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
        coded = words.dictionary_encode()
        self.lang, self.words, self.carried = lang, coded.dictionary, carried
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.hashes = word_hashes(lang, self.words.to_pylist())
        piece = np.cumsum(cut, dtype=np.int32)[starts]
        #: where two, three neighbours stand in one piece and the last is new here
        self.pairs = piece[1:] == piece[:-1]
        self.triples = self.pairs[1:] & self.pairs[:-1]
        self.pairs[:max(carried - 1, 0)] = False


def distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes.sort()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.diff(np.append(starts, len(codes)))


class Counter:
    """Counts the phrases of one task run by run: words if ``words``, longer
    ones whose parts are in ``new`` but not all in ``old`` (no ``new``: pairs of
    any words, no triples)."""

    def __init__(self, words: bool, new: Proposed | None, old: Proposed | None, buckets: int = 1) -> None:
        self.count_words, self.new, self.old, self.buckets = words, new, old, buckets
        self.waiting: dict[str, list[bytes]] = {}
        self.size: dict[str, int] = {}
        self.found: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        self.n_found = 0

    def add(self, lang: str, text: str) -> Iterator[pa.RecordBatch]:
        raw = text.encode().translate(LOWER_AND_CUT)
        if len(raw) > CHUNK:
            for chunk, carried in chunks(raw):
                yield from self.count(Run(lang, chunk, carried))
            return
        self.waiting.setdefault(lang, []).append(raw)
        self.size[lang] = self.size.get(lang, 0) + len(raw) + 1
        if sum(self.size.values()) >= HELD:
            yield from self.one_run(max(self.size, key=self.size.get))

    def one_run(self, lang: str) -> Iterator[pa.RecordBatch]:
        del self.size[lang]
        yield from self.count(Run(lang, b"\n".join(self.waiting.pop(lang))))

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang in list(self.waiting):
            yield from self.one_run(lang)
        yield from self.packed()

    def count(self, run: Run) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, entries) for each bucket that has phrases: those whose
        hash falls there, with their counts."""
        ids, h = run.ids, run.hashes
        if self.count_words and len(ids) > run.carried:
            # all words of the language, with an empty phrase
            yield from self.keep(run, pa.array([b""]), np.array([len(ids) - run.carried]), np.zeros(1, np.int64))
            yield from self.entries(run, 0, *distinct(ids[run.carried:].copy()))
        pairs, triples = run.pairs, None
        if self.new is not None and len(ids):
            ok = has(self.new.words, h)[ids]
            pairs = pairs & ok[1:] & ok[:-1]
            of_pair = pair_hash(h[ids[:-1]], h[ids[1:]])
            inside = has(self.new.pairs, of_pair)
            triples = run.triples & inside[1:] & inside[:-1]
            if self.old is not None:
                ok = has(self.old.words, h)[ids]
                pairs &= ~(ok[1:] & ok[:-1])
                inside = has(self.old.pairs, of_pair)
                triples &= ~(inside[1:] & inside[:-1])
        at = np.flatnonzero(pairs)
        yield from self.entries(run, 1, *distinct((ids[at] << BITS) | ids[at + 1]))
        if triples is not None:
            at = np.flatnonzero(triples)
            yield from self.entries(run, 2, *distinct((ids[at] << 2 * BITS) | (ids[at + 1] << BITS) | ids[at + 2]))

    def entries(self, run: Run, size: int, codes: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(codes), ENTRIES_AT_ONCE):
            c = codes[s:s + ENTRIES_AT_ONCE]
            parts = [(c >> BITS * k) & ((1 << BITS) - 1) for k in range(size, -1, -1)]
            bucket = reduce(pair_hash, [run.hashes[x] for x in parts])
            x = [run.words.take(pa.array(q)) for q in parts]
            phrase = pc.binary_join_element_wise(*x, b" ") if size else x[0]
            yield from self.keep(run, phrase, counts[s:s + ENTRIES_AT_ONCE], (bucket % np.uint64(self.buckets)).astype(np.int64))

    def keep(self, run: Run, phrases: pa.Array, counts: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.found.append((pa.array([run.lang]).take(pa.array(np.zeros(len(phrases), np.int8))), phrases, counts, bucket))
        self.n_found += len(phrases)
        if self.n_found >= ENTRIES_AT_ONCE:
            yield from self.packed()

    def packed(self) -> Iterator[pa.RecordBatch]:
        if not self.found:
            return
        langs, phrases, counts, buckets = zip(*self.found, strict=True)
        self.found, self.n_found = [], 0
        bucket = np.concatenate(buckets)
        order = np.argsort(bucket, kind="stable")
        columns = [pa.concat_arrays(langs), pa.concat_arrays(phrases), pa.array(np.concatenate(counts), pa.int64())]
        ordered = pa.record_batch(columns, schema=ENTRIES).take(pa.array(order))
        found, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts, len(order))
        rows = []
        for s, e in zip(ends, ends[1:], strict=False):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, ENTRIES, options=PACKED) as out:
                out.write_batch(ordered.slice(s, e - s))
            rows.append(sink.getvalue().to_pybytes())
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(rows, pa.binary())], names=["bucket", "entries"])
        del columns, ordered, rows
        pa.default_memory_pool().release_unused()


def added_up(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Sum the counts of each bucket's phrases; its rows follow each other.
    Rows (lang, phrase, n) of those with ``least``, and the languages' numbers
    of words."""
    def out(blobs: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables(pa.ipc.open_stream(x).read_all() for x in blobs)
        table = table.group_by(["lang", "phrase"], use_threads=False).aggregate([("n", "sum")])
        table = table.filter(pc.or_(pc.equal(table["phrase"], b""), pc.greater_equal(table["n_sum"], least)))
        yield from pa.table({"lang": table["lang"], "phrase": table["phrase"].cast(pa.string()), "n": table["n_sum"]}).to_batches()
        del table
        pa.default_memory_pool().release_unused()

    bucket, blobs = None, []
    for batch in batches:
        for b, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != bucket and blobs:
                yield from out(blobs)
                blobs = []
            bucket = b
            blobs.append(x.as_buffer())
    if blobs:
        yield from out(blobs)


def count(docs: DataFrame, least: int, words: bool, new: Broadcast | None, old: Broadcast | None) -> DataFrame:
    """(lang, phrase, n), the sums over all of ``docs(lang, text)`` that reach
    ``least``, and the languages' numbers of words, with an empty phrase.  There
    are BUCKETS buckets for each shuffle partition."""
    buckets = BUCKETS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(words, new.value if new else None, old.value if old else None, buckets)
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                yield from counter.add(lang.as_py(), text.as_py())
        yield from counter.flush()

    parts = docs.select("lang", "text").mapInArrow(run, "bucket long, entries binary")
    return parts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        lambda batches: added_up(batches, least), "lang string, phrase string, n long")


def n_words(phrase: Column) -> Column:
    return F.when(phrase == "", 0).otherwise(F.octet_length(phrase) - F.octet_length(F.replace(phrase, F.lit(" "), F.lit(""))) + 1)


def bits_of(phrases: DataFrame) -> DataFrame:
    """(pair, at, bits): the words of the bitmaps that ``phrases(lang, phrase)``
    of one or two words set."""
    n_words_bits, n_pairs_bits = WORD_BITS, PAIR_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair, places = [], []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = word_hashes(lang, phrase.encode().split(b" "))
                pair.append(len(h) == 2)
                places.append(int(h[0]) & (n_words_bits - 1) if len(h) == 1 else
                              int(pair_hash(h[:1], h[1:])[0]) & (n_pairs_bits - 1))
            yield pa.record_batch([pa.array(pair, pa.bool_()), pa.array(places, pa.int64())], names=["pair", "place"])

    found = phrases.select("lang", "phrase").mapInArrow(run, "pair boolean, place long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    return found.groupBy("pair", F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits"))


def extended(old: Proposed, phrases: DataFrame) -> tuple[Proposed, int]:
    """``old`` with the bits of ``phrases``, and how many bits are new.  At most
    (WORD_BITS + PAIR_BITS) / 64 rows reach the driver, whatever the corpus."""
    new = Proposed(old.words.copy(), old.pairs.copy())
    found = bits_of(phrases).toArrow()
    for pair, bitmap in ((False, new.words), (True, new.pairs)):
        mine = found.filter(pc.equal(found["pair"], pair))
        at = mine["at"].to_numpy()
        bitmap.view(np.uint64)[at] |= mine["bits"].to_numpy().view(np.uint64)
    gained = sum(int(np.bitwise_count(b.view(np.uint64)).sum() - np.bitwise_count(a.view(np.uint64)).sum())
                 for a, b in ((old.words, new.words), (old.pairs, new.pairs)))
    return new, gained


def frequent_phrases(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(lang, phrase, n) of all phrases of one to three words that stand
    ``min_count`` times, and a row with an empty phrase and the number of all
    words for each language."""
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       F.pmod(F.xxhash64("doc_id", "text"), F.lit(SAMPLE)).alias("part"))
    sample = materialize(count(rows.filter("part = 0"), SAMPLE_COUNT, True, None, None), "sampled-phrases")
    proposed, _ = extended(Proposed.none(), sample.filter("phrase != ''"))
    passes, old, gained = [], None, 1
    while gained:
        new = spark.sparkContext.broadcast(proposed)
        found = materialize(count(rows, min_count, not passes, new, old), "frequent-phrases")
        passes.append(found)
        short = found.filter((F.col("phrase") != "") & (n_words(F.col("phrase")) < 3))
        proposed, gained = extended(proposed, short)
        old = new
    return reduce(DataFrame.unionByName, passes)


# ------------------------------------------------------------------- scores

def _cuts(phrase: Column) -> Column:
    """(k, l, r): the parts of each cut of a phrase."""
    w = F.split(phrase, " ")
    join = lambda a, n: F.array_join(F.slice(w, F.lit(a), F.lit(n)), " ")
    one = F.struct(F.lit(1).alias("k"), join(1, 1).alias("l"), join(2, 2).alias("r"))
    two = F.struct(F.lit(2).alias("k"), join(1, 2).alias("l"), join(3, 1).alias("r"))
    return F.when(F.size(w) == 2, F.array(one)).otherwise(F.array(one, two))


def _big(c: Column | str) -> Column:
    """Exact below 10^16 occurrences, an error beyond."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(16,0)")


def score(a: str, left: str, right: str) -> Column:
    over = _big(a) * _big(a) * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", over, _big(left) * _big(right))


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases of two and three words, by
    the cut that scores lowest."""
    cuts = counts.filter(n_words(F.col("phrase")) >= 2).select("lang", "phrase", F.col("n").alias("a"), F.explode(_cuts(F.col("phrase"))).alias("cut"))
    asked = cuts.select("lang", "phrase", "a", "cut.k", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("cut.l").alias("part")), F.struct(F.lit(1).alias("side"), F.col("cut.r").alias("part")))).alias("x"))
    asked = asked.select("lang", "phrase", "a", "k", "x.side", "x.part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).cast("int").alias("salt"))
    # a common word is part of many phrases: its count goes to the salts that ask
    known = asked.select("lang", "part", "salt").distinct().join(
        counts.select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part")), ["lang", "part"])
    sides = asked.join(known, ["lang", "part", "salt"]).groupBy("lang", "phrase", "a", "k").agg(
        F.max(F.when(F.col("side") == 0, F.col("of_part"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("of_part"))).alias("r"))
    return sides.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score("a", "l", "r").alias("score"), "k", "l", "r")).alias("low")).select(
        "lang", "phrase", "a", "low.l", "low.r", "low.score")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases
    that no longer candidate covers."""
    counts = frequent_phrases(docs, min_count)
    found = scored(counts)
    triple = F.split("phrase", " ")
    covers = (
        counts.filter(n_words(F.col("phrase")) == 3)
        .select("lang", "n", F.explode(F.array(F.array_join(F.slice(triple, 1, 2), " "), F.array_join(F.slice(triple, 2, 2), " "))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    )
    left = found.join(covers, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * 50))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parted = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    totals = counts.filter(F.col("phrase") == "").select("lang", F.col("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]))


ORACLE_SQL = """
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?' || chr(10) || chr(11) || chr(12) || chr(13) || ']')) as piece
    from documents
),
words as (
    select lang, list_filter(string_split_regex(piece, '[ ' || chr(9) || ']+'), lambda x: x <> '') as w from pieces
),
phrases as (
    select lang, 1 as size, unnest(w) as phrase from words
    union all
    select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from words where len(w) > 1
    union all
    select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from words where len(w) > 2
),
counts as (select lang, size, phrase, count(*) as f from phrases group by all),
totals as (select lang, cast(sum(f) as bigint) as n from counts where size = 1 group by lang),
split as (select *, string_split(phrase, ' ') as w from counts where size > 1 and f >= 10),
cuts as (
    select lang, size, phrase, f as a, 1 as k, w[1] as lft, array_to_string(w[2:], ' ') as rgt from split
    union all
    select lang, size, phrase, f, 2, array_to_string(w[:2], ' '), w[3] from split where size = 3
),
scored as (
    select c.lang, c.size, c.phrase, c.a, c.k, x.f as l, y.f as r,
           (1000000::hugeint * c.a * c.a) // (x.f::hugeint * y.f) as score
    from cuts c join counts x on x.lang = c.lang and x.phrase = c.lft join counts y on y.lang = c.lang and y.phrase = c.rgt
),
lowest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
),
longer as (
    select lang, f, unnest([array_to_string(w[:2], ' '), array_to_string(w[2:], ' ')]) as phrase from split where size = 3
),
covers as (select lang, phrase, max(f) as f from longer group by all),
kept as (
    select o.* from lowest o left join covers c on c.lang = o.lang and c.phrase = o.phrase and o.size = 2
    where c.f is null or 100 * c.f < 50 * o.a
),
ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, cast(r.score as bigint) as score
from ranked r join totals t using (lang) where r.rank <= 2000
"""
