"""URL filter by host word segmentation (operator 2).

1. Rules (a host with its subdomains and the beginning of a path) decide first;
   the longest fitting rule wins.
2. Host labels are split into words: a unigram model over the separate words of
   all urls (those that hyphens or digits part in host labels, and path words)
   and a published vocabulary's words, by rank, gives each substring a
   probability, and Viterbi finds the likeliest split of each distinct run of
   letters.
3. A multinomial naive Bayes model scores the words of host and path.  Its
   training labels come from the stated words of unwanted sites, as the tables
   hold none: a url whose segmented host has one that says enough alone, or two
   others, is an example of "block", any other of "allow"; the counts cover all
   urls.  So words that keep such company weigh too.

Words are counted and looked up by joins on distinct words, labels and hosts,
never per occurrence, so neither a frequent word nor a hot host is a hot key
but for the last join (page to host), where a host's one row is copied to SALTS
salts.  The naive Bayes table has a row per hash bucket of words, a fixed size.

Defined results: a null url, or one without ``://``, has an empty host and path
and, without words, the verdict of the prior; a null page_id and repeated rows
stay; an empty table gives no rows; other columns are ignored.  Labels longer
than any host name are cut by the same rule; words longer than MAX_WORD are not
in the unigram model and cost their length.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.session import materialize
from tillroll.sources.tables import read_table

#: The contract's rules: (verdict, host, beginning of the path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Words of unwanted sites.
UNWANTED = ("ads adult bet bets betting casino cheap dating farm free gambling loan loans lottery pill pills poker porn "
            "replica sex slots spam track tracker tracking viagra win xxx").split()
#: More words that host names are made of.
KNOWN = ("com net org www blog book cloud daily data digital example forum health home info life live mail media mobile music net news "
         "online shop store tech time travel tube web wiki world").split()
#: Those of UNWANTED that clean hosts hardly have.
TELLING = "adult betting casino gambling poker porn sex spam viagra xxx".split()
#: Weight of a word's occurrences in the urls (a logarithm) beside its listed
#: weight; a parted name may be joined words itself, however often it is seen.
SEEN = 1e-4
#: A letter of an unknown word costs so much (a logarithm).
LETTER = math.log(3)
MAX_WORD = 20
SALTS = 32
BUCKETS = 1 << 16


# -------------------------------------------------------------- url parts

def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host_col: Column, path_col: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as text (host, then path) and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host_col == h) | host_col.endswith("." + h)) & path_col.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


# ----------------------------------------------------------- segmentation

def vocabulary() -> dict[str, float]:
    """Weights of the whole words of at least three letters of a published
    vocabulary, one over the rank, and 1 for the last; a stated word that it
    lacks weighs as its last."""
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    last = max(ranks.values())
    weights = {w[:-4]: last / max(1, r) for w, r in ranks.items() if w.endswith("</w>") and re.fullmatch("[a-z]{3,}", w[:-4])}
    return dict.fromkeys([*UNWANTED, *KNOWN], 1.0) | weights


def unigrams(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, n): weights of the words of every url's host and path, and of the
    vocabulary.  ``hosts(host, n)`` and ``paths(path, n)`` are distinct, with
    counts; a word weighs as the logarithm of its count, so that a joined name
    that is seen often doesn't outweigh the words that it is made of."""
    # a label that is one run of letters may be several words, so it is no word
    parted = hosts.select(F.explode(F.split("host", "[.]")).alias("label"), "n").select(
        words(F.col("label")).alias("w"), "n").filter(F.size("w") > 1)
    seen = parted.select(F.explode("w").alias("word"), "n").unionByName(
        paths.select(F.explode(words(F.col("path"))).alias("word"), "n"))
    listed = hosts.sparkSession.createDataFrame(list(vocabulary().items()), "word string, listed double")
    return (seen.withColumn("listed", F.lit(0.0)).unionByName(listed.withColumn("n", F.lit(0).cast("long")))
            .filter(F.length("word") <= MAX_WORD).groupBy("word")
            .agg((SEEN * F.log1p(F.sum("n")) + F.sum("listed")).alias("n")))


def viterbi(label: str, pieces: dict[str, float], total: float) -> list[str]:
    """The likeliest split of ``label``: known words by their weights, an
    unknown one costs LETTER more with each letter."""
    n = len(label)
    best = [0.0] + [-math.inf] * n
    back = [0] * (n + 1)
    unknown = [math.log(0.1 / total) - k * LETTER for k in range(n + 1)]
    for end in range(1, n + 1):
        for start in range(max(0, end - MAX_WORD), end):
            c = pieces.get(label[start:end])
            p = best[start] + max(math.log(c / total) if c else -math.inf, unknown[end - start])
            if p > best[end]:
                best[end], back[end] = p, start
        if end > MAX_WORD and best[end] == -math.inf:
            best[end], back[end] = best[end - 1] + unknown[1], end - 1
    out, end = [], n
    while end:
        out.append(label[back[end]:end])
        end = back[end]
    return out[::-1]


def segment_labels(labels: DataFrame, model: DataFrame) -> DataFrame:
    """(label, split) of distinct ``labels(label)``: substrings are joined with
    the unigram model (label, piece, count), and a label's pieces meet again."""
    total = float(model.agg(F.sum("n")).first()[0] or 1)
    n = F.length("label")
    starts = labels.filter(n > 0).select("label", F.explode(F.sequence(F.lit(1), n)).alias("a"))
    pieces = starts.select("label", F.explode(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(MAX_WORD), n - F.col("a") + 1)),
        lambda k: F.substring(F.col("label"), F.col("a"), k))).alias("word")).distinct()
    known = pieces.join(model, "word").groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("known"))
    schema = pa.schema([("label", pa.string()), ("split", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [viterbi(label.as_py(), dict(known.as_py() or []), total)
                     for label, known in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, schema.field(1).type)], schema=schema)

    return labels.filter(n > 0).join(known, "label", "left").select("label", "known").mapInArrow(
        run, "label string, split array<string>")


# ------------------------------------------------------------ naive Bayes

def bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def listed(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def fit_bayes(tokens: DataFrame) -> tuple[dict[int, float], float]:
    """From ``tokens(host_words, path_words, blocked)``: the log odds of each
    hash bucket of words (add-one smoothing; at most BUCKETS entries) and of
    the prior.  Counts are summed on the executors."""
    docs = {r["blocked"]: r["count"] for r in tokens.groupBy("blocked").count().collect()}  # two rows
    prior = math.log((docs.get(True, 0) + 1) / (docs.get(False, 0) + 1))
    counts = (
        tokens.select("blocked", F.explode(F.concat("host_words", "path_words")).alias("word"))
        .groupBy(bucket(F.col("word")).alias("bucket"))
        .agg(F.count_if("blocked").alias("bad"), F.count_if(~F.col("blocked")).alias("good"))
    ).collect()
    bad, good = (sum(r[x] for r in counts) + len(counts) + 1 for x in ("bad", "good"))
    return {r["bucket"]: math.log((r["bad"] + 1) / (r["good"] + 1)) + math.log(good / bad) for r in counts}, prior


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_words, block_odds), a row per
    row of ``pages(page_id, url)``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parts = rows.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))).drop("url")
    hosts = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    paths = parts.groupBy("path").agg(F.count(F.lit(1)).alias("n"))

    names = hosts.select("host", F.posexplode(words(F.col("host"))).alias("place", "label"))
    splits = segment_labels(names.select("label").distinct(), unigrams(hosts, paths))
    spoken = names.join(splits, "label").groupBy("host").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "split"))), lambda s: s["split"])).alias("host_words"))
    by_host = (hosts.select("host").join(spoken, "host", "left")
               .withColumn("host_words", F.coalesce("host_words", F.array().cast("array<string>")))
               .withColumn("blocked", F.arrays_overlap("host_words", listed(TELLING))
                           | (F.size(F.array_intersect("host_words", listed(UNWANTED))) > 1)))

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = by_host.select("host", "host_words", "blocked", salts.alias("salt"))
    known = parts.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int")).join(
        salted, ["host", "salt"]).drop("salt").withColumn("path_words", words(F.col("path")))

    known = materialize(known, "urls")  # counted, then scored
    table, prior = fit_bayes(known)
    sent = pages.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()),
                        ("host_words", pa.list_(pa.string())), ("block_odds", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [prior + sum(sent.value.get(b, 0.0) for b in x.as_py()) for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(scores, pa.float64())], schema=schema)

    scored = known.select("page_id", "host", "path", "host_words", F.transform(
        F.concat("host_words", "path_words"), bucket).alias("buckets")).mapInArrow(
        run, "page_id long, host string, path string, host_words array<string>, block_odds double")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                         "host_words", "block_odds")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages", ["page_id", "url"])).select(
        "page_id", "host", "path", "rule", "verdict", "block_odds")
