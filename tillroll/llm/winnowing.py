"""Document fingerprints by winnowing (operator 10), DataFrame functions only.

Every ``k`` consecutive code points of a text are a k-gram; its hash is the low
33 bits of its XXH64, as a signed number.  In each window of ``window`` consecutive hashes the
smallest is selected, the rightmost of equal ones, with its position.  So any
two texts that share ``window + k - 1`` code points in a row share a selected
hash.  A text of fewer than ``k`` code points is one gram, an empty text has
none; fewer hashes than a window are one window.

A hash and its position travel as one long, ``hash * 2^31 + (2^31 - 1 -
position)``: the smallest long is the smallest hash at its rightmost place.
Windows' minima are taken by doubling: of 2, 4, 8 ... neighbours, each step the
smaller of two arrays, one shifted against the other.

The edited text of a document is its first half (rounded up) followed by the
next document's beginning.  Selection is local, so the selection of the edited
text is put together from the windows inside the first half, those inside the
next document's beginning, and those across the seam, which is a string of less
than ``2 * (window + k)`` code points.

The next document is found inside blocks of ascending ids: the ids' approximate
quantiles (a bounded array) cut the order into blocks, texts are moved once, to
their block, and only the first document of each block is handed to the block
before it.

Defined results: a null text is an empty one (no selection, the fingerprint of
the empty selection); a null id comes before every other; rows with the same id
follow each other by text; the only document is its own next one; an empty
table gives no rows; two empty selections are alike (1.0), an empty and another
are not (0.0); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.llm.common import documents

K, WINDOW = 16, 8
#: Blocks of ascending ids for each shuffle partition.
BLOCKS_PER_PARTITION = 4
PLACES = 1 << 31


def gram_hashes(text: Column, k: int = K) -> Column:
    """The packed (hash, position) of every k-gram."""
    grams = F.when(F.char_length(text) >= k, F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))."), F.lit(1))) \
        .when(F.char_length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.transform(grams, lambda g, i: F.shiftleft(F.xxhash64(g), 31).bitwiseOR(F.lit(PLACES - 1) - i))


def with_minima(rows: DataFrame, packed: str, into: str, window: int = WINDOW) -> DataFrame:
    """Add the smallest of each window of neighbours in ``packed``, each once
    and in order (a minimum stays the choice of neighbouring windows); a short
    array is one window."""
    n = F.size(packed)
    out, width = rows.withColumn(into, F.col(packed)), 1
    while width < window:
        step = min(width, window - width)
        width += step
        # beyond the end there is nothing, which ``least`` passes over
        out = out.withColumn(into, F.zip_with(F.col(into), F.slice(F.col(into), F.lit(step + 1), F.size(into)),
                                                 lambda a, b: F.least(a, b)))
    return out.withColumn(into, F.array_distinct(
        F.when(n > window, F.slice(F.col(into), F.lit(1), F.greatest(n - (window - 1), F.lit(1))))
        .when(n > 0, F.array(F.array_min(packed))).otherwise(F.col(packed))))


def hash_of(m: Column) -> Column:
    return F.shiftright(m, 31)


def position_of(m: Column) -> Column:
    return F.lit(PLACES - 1) - m.bitwiseAND(PLACES - 1).cast("int")


def inside(selected: Column, chars: Column, k: int = K, window: int = WINDOW) -> Column:
    """Of a text's selection what its first ``chars`` code points select: the
    choices whose first window ends there.  A choice's first window is the one
    that it enters as the smallest, or the one that its predecessor has left."""
    before = lambda i: F.get(selected, i - 1)
    last = chars - (window + k - 2)  # windows begin before this place
    return F.filter(selected, lambda m, i: F.when(i == 0, F.lit(0)).when(
        m < before(i), position_of(m) - (window - 1)).otherwise(position_of(before(i)) + 1) < last)


def hashes(selected: Column) -> Column:
    """The sorted distinct hashes of packed minima."""
    return F.sort_array(F.array_distinct(F.transform(selected, hash_of)))


def winnow(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, hashes, positions): the selection of each text, in order."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return _selected(rows, "text", "m", k, window).select(
        "doc_id", F.transform("m", hash_of).alias("hashes"), F.transform("m", position_of).alias("positions"))


def block_cuts(ids: DataFrame) -> list[int]:
    """Bounds between blocks of about equal numbers of ids: the ids' quantiles,
    BLOCKS_PER_PARTITION for each shuffle partition of the session."""
    n = max(16, BLOCKS_PER_PARTITION * int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q")).first()["q"]
    return sorted(set(cuts or []))


def with_block(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """Add ``block``, the number of bounds below ``doc_id`` (null: 0), found by
    bisection."""
    out = rows.withColumn("block", F.lit(0))
    if not cuts:
        return out
    bounds, step = F.lit(cuts).cast("array<bigint>"), 1 << (len(cuts).bit_length() - 1)
    while step:
        # past the end F.get is null, which counts as not below
        out = out.withColumn("block", F.col("block") + F.when(
            F.get(bounds, F.col("block") + (step - 1)) < F.col("doc_id"), step).otherwise(0))
        step //= 2
    return out


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def _selected(rows: DataFrame, text: str, into: str, k: int, window: int) -> DataFrame:
    return with_minima(rows.withColumn("packed", gram_hashes(F.col(text), k)), "packed", into, window).drop("packed")


def next_of_blocks(rows: DataFrame, k: int, window: int) -> DataFrame:
    """(block, follow, follow_selected): the first document behind each block,
    a row per block."""
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    least = rows.groupBy("block").agg(F.min(key).alias("first"))
    firsts = (rows.join(F.broadcast(least.withColumnRenamed("block", "_b")), (F.col("_b") == F.col("block")) & (key == F.col("first")))
              .groupBy("block").agg(F.min("text").alias("text")))
    turn = Window.orderBy("block")  # at most a row per block
    follow = firsts.select("block", F.coalesce(
        F.lead("text").over(turn), F.first("text").over(turn)).alias("follow"))
    return _selected(follow, "follow", "follow_selected", k, window)


def edited_likeness(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, hashes, edited_hashes, next_hashes)."""
    reach = window + k - 2  # code points of a window, less one
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_block(plain, block_cuts(plain))
    here = Window.partitionBy("block").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    own = _selected(rows.repartition("block"), "text", "selected", k, window)
    late = F.col("next_text").isNull()
    seen = (
        own.withColumn("next_text", F.lead("text").over(here)).withColumn("next_selected", F.lead("selected").over(here))
        .join(next_of_blocks(rows, k, window), "block")
        .withColumn("next_selected", F.when(late, F.col("follow_selected")).otherwise(F.col("next_selected")))
        .withColumn("next_text", F.coalesce("next_text", "follow"))
        .drop("follow", "follow_selected")
    )
    half = F.floor(F.col("n_chars") / 2).cast("int")
    joined = (
        seen.withColumn("n_chars", F.char_length("text"))
        .withColumn("kept", F.substring(F.col("text"), F.lit(1), F.col("n_chars") - half))
        .withColumn("given", F.substring(F.col("next_text"), F.lit(1), half))
        .withColumn("n_kept", F.col("n_chars") - half).withColumn("n_given", F.char_length("given"))
        .withColumn("edited_sha256", F.sha2(F.concat("kept", "given"), 256))
        .withColumn("seam", F.concat(F.right(F.col("kept"), F.lit(reach)), F.left(F.col("given"), F.lit(reach))))
        .drop("text", "next_text", "kept", "given")
        # windows across the seam; a seam without one is the whole edited text
        # if that is short, else the end of a text to which nothing was added
        .withColumn("packed", F.when(
            (F.char_length("seam") > reach) | (F.col("n_kept") + F.col("n_given") <= reach),
            gram_hashes(F.col("seam"), k)).otherwise(F.array().cast("array<bigint>")))
    )
    joined = with_minima(joined, "packed", "minima", window)

    edited = F.concat(inside(F.col("selected"), F.col("n_kept"), k, window),
                      inside(F.col("next_selected"), F.col("n_given"), k, window), F.col("minima"))
    return joined.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", hashes(F.col("selected")).alias("hashes"),
        hashes(edited).alias("edited_hashes"), hashes(F.col("next_selected")).alias("next_hashes"))


def digest(found: Column) -> Column:
    """The fingerprint of a set of hashes as text."""
    return F.sha2(F.array_join(F.transform(found, lambda h: h.cast("string")), ","), 256)


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_likeness(documents(spark, sf_dir))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", digest(F.col("hashes")).alias("fingerprint"),
        digest(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"))
