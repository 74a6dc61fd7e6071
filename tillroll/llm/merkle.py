"""Merkle manifest of a dataset (operator 12).

A row's leaf is the SHA-256 of its fields, each with its length.  A source's
leaves stand in ascending order of doc_id, and every three neighbours become
their hash until one node is left, the subroot; subroots in the order of their
sources become the root the same way.

Where a leaf stands is not found by sorting the leaves.  A source's doc_ids are
a bitmap of 64-id words of which only words with a bit are stored (``bit_or``
of the ids' bits, so partial words of all tasks merge).  Popcounts of the words
are summed up in a directory of four levels, each window of which has at most
65,536 entries whatever the ids are.  A rank query joins a leaf to its word:
ids before the word, plus the bits of the word below the id's own.

Levels are reduced in slot arrays: BLOCK = 3^STEP neighbouring places of a
source are one array, keyed by (source, place / BLOCK), and give STEP levels
at once.  So a tree of n leaves takes log_729(n) shuffles, each of a few bytes
a node, and no group is larger than a block, also for a source with all rows.
Proofs come down the same way: a block's siblings above it are found once, then
handed to its own places.

Defined results: a null field is ``-``; a null source comes first and is a
group of its own; a null doc_id comes before every other and isn't tampered
with; rows with one doc_id stand in the order of their leaves; equal rows take
places one after the other; a source of one leaf has it as its subroot, one
source's subroot is the root; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillroll.operators.ordering import with_position
from tillroll.session import materialize
from tillroll.sources.tables import read_table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
RUN, STEP = 3, 6
BLOCK = RUN**STEP
#: A hot word's leaves (a repeated or null id) are joined in so many parts.
SALTS = 64
#: Bits of a word's number that each level of the directory drops.
LEVELS = (10, 16, 16)


def sha(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def leaf_hash(**changed: Column) -> Column:
    parts = []
    for name in FIELDS:
        value = changed.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return sha(*parts)


def leaves(docs: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, bent, copies): distinct leaves of each source; ``bent``
    is the leaf after the tampering (null: not tampered with).  ``g`` is the
    source in a form that is never null and sorts alike."""
    text = F.col("text").cast("string")
    bent = F.when((F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.contains(text, F.lit("\n")),
                  leaf_hash(text=F.replace(text, F.lit("\n"), F.lit(""))))
    rows = docs.select(F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("g"),
                       F.col("doc_id").cast("long").alias("doc_id"), leaf_hash().alias("leaf"), bent.alias("bent"))
    return rows.groupBy("g", "doc_id", "leaf", "bent").agg(F.count(F.lit(1)).alias("copies"))


# ------------------------------------------------------------- bitmap ranks

def _word(key: Column) -> tuple[Column, Column]:
    """The number of the key's word, in the order of signed keys (null: -1),
    and the key's bit in it."""
    flipped = key.bitwiseXOR(F.lit(-(1 << 63)))
    return (F.coalesce(F.shiftrightunsigned(flipped, 6), F.lit(-1)).cast("long"),
            F.coalesce(key.bitwiseAND(63), F.lit(0)).cast("int"))


def _shifted(bits: int, at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(bits).cast("long"), at)


def bitmap_index(rows: DataFrame, group: Sequence[str]) -> DataFrame:
    """The stored words of ``rows(group, w, bit, n)``: bits, more (what bits
    with n above 1 add), before (the n of all smaller words of the group) and
    total (of the group)."""
    g = list(group)
    words = materialize(
        rows.groupBy(*g, "w", "bit").agg(F.sum("n").alias("n")).groupBy(*g, "w")
        .agg(F.bit_or(_shifted(1, F.col("bit"))).alias("bits"), F.sum("n").alias("n"),
             F.collect_list(F.when(F.col("n") > 1, F.struct("bit", (F.col("n") - 1).alias("n")))).alias("more")), "bitmap-words")
    # a directory: counts of a node's children, summed up in their order
    nodes, of, found = words.select(*g, "w", "n").withColumnRenamed("w", "k0"), "k0", words.withColumnRenamed("w", "k0")
    for depth, bits in enumerate((*LEVELS, None)):
        up = f"k{depth + 1}"
        nodes = nodes.withColumn(up, F.shiftright(of, bits) if bits else F.lit(0))
        over = Window.partitionBy(*g, up)
        upto = over.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
        here = nodes.select(*g, of, *([up] if bits else []), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias(f"before{depth}"),
                            *([] if bits else [F.sum("n").over(over).alias("total")]))
        found = found.join(here, [*g, of])
        if bits:
            nodes, of = nodes.groupBy(*g, up).agg(F.sum("n").alias("n")), up
    before = reduce(lambda a, b: a + b, [F.col(f"before{d}") for d in range(len(LEVELS) + 1)])
    return found.select(*g, F.col("k0").alias("w"), "bits", "more", before.alias("before"), "total")


def with_rank(rows: DataFrame, group: Sequence[str], key: Column) -> DataFrame:
    """Add ``rank``, the copies in the group whose key is smaller, ``alike``,
    those with the same key, and ``total``."""
    g = list(group)
    w, bit = _word(key)
    placed = rows.withColumns({"w": w, "bit": bit, "salt": F.pmod(F.xxhash64("leaf"), F.lit(SALTS)).cast("int")})
    index = bitmap_index(placed.select(*g, "w", "bit", F.col("copies").alias("n")), g)
    salted = placed.select(*g, "w", "salt").distinct().join(index, [*g, "w"])
    extra = lambda cond: F.aggregate(F.filter("more", cond), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    below = F.bit_count(F.col("bits").bitwiseAND(F.bitwise_not(_shifted(-1, F.col("bit")))))
    return placed.join(salted, [*g, "w", "salt"]).select(
        *rows.columns, "total", (F.col("before") + below + extra(lambda x: x["bit"] < F.col("bit"))).alias("rank"),
        (extra(lambda x: x["bit"] == F.col("bit")) + 1).alias("alike"))


def with_place(found: DataFrame) -> DataFrame:
    """Add ``place`` (from 0, the first of the row's copies) and ``total`` to
    the distinct leaves: the rank of the id, among leaves of one id the rank of
    the leaf."""
    ranked = materialize(with_rank(found, ["g"], F.col("doc_id")), "ranked-leaves")
    alone = ranked.filter(F.col("alike") == F.col("copies")).withColumnRenamed("rank", "place").drop("alike")
    tied = ranked.filter(F.col("alike") > F.col("copies")).drop("alike").withColumnsRenamed({"rank": "first", "total": "of_group"})
    if tied.isEmpty():
        return alone
    tied = tied.withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    start = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")  # leaves that share 60 bits are few
    among = with_rank(tied, ["g", "id"], start)
    last = Window.partitionBy("g", "id", start).orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    among = among.withColumn("place", F.col("first") + F.col("rank") + F.coalesce(F.sum("copies").over(last), F.lit(0)))
    return alone.unionByName(among.drop("total").withColumnRenamed("of_group", "total").select(*alone.columns))


# -------------------------------------------------------------- slot arrays

def _runs(a: Column) -> Column:
    """The hash of every RUN neighbours."""
    starts = F.sequence(F.lit(1), F.size(a), F.lit(RUN))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(a, i, F.lit(RUN)), ""), 256))


def _levels(nodes: Column, rows: DataFrame, step: int) -> DataFrame:
    """Add a0 ... aSTEP: the block's nodes, then those of each level above, as
    long as the tree has levels."""
    out = rows.withColumn("a0", nodes).withColumn("left_over", F.ceil(F.col("total") / F.lit(float(BLOCK**step))).cast("long"))
    for k in range(STEP):
        a = F.col(f"a{k}")
        out = out.withColumn(f"a{k + 1}", F.when(F.col("left_over") > RUN**k, _runs(a)).otherwise(a))
    return out


def _siblings(at: Column) -> Column:
    """The siblings at each level of the node in slot ``at``: those left and
    those right of it, as text."""
    found = []
    for k in range(STEP):
        a, i = F.col(f"a{k}"), F.floor(at / RUN**k).cast("int")
        own = i % RUN
        found.append(F.when(F.col("left_over") > RUN**k, F.struct(
            F.array_join(F.slice(a, i - own + 1, own), "").alias("left"),
            F.array_join(F.slice(a, i + 2, F.lit(RUN - 1) - own), "").alias("right"))))
    return F.array_compact(F.array(*found))


def build(rows: DataFrame, label: str) -> list[DataFrame]:
    """Reduce ``rows(g, place, copies, total, item)``, item a struct with the
    text ``node``, to one node for each g.  Table k of the result holds the
    blocks of the k-th step: (g, block, total, items, node)."""
    first = F.floor(F.col("place") / BLOCK)
    spread = rows.withColumn("block", F.explode(F.sequence(first, F.floor((F.col("place") + F.col("copies") - 1) / BLOCK))))
    lo = F.greatest(F.col("place"), F.col("block") * BLOCK)
    hi = F.least(F.col("place") + F.col("copies"), (F.col("block") + 1) * BLOCK)
    grouped = spread.groupBy("g", "block").agg(F.max("total").alias("total"), F.sort_array(F.collect_list(
        F.struct((lo - F.col("block") * BLOCK).alias("slot"), (hi - lo).cast("int").alias("times"), "item"))).alias("slots"))
    items = F.flatten(F.transform("slots", lambda x: F.array_repeat(x["item"], x["times"])))
    tables, most = [], 0
    while True:
        filled = _levels(F.transform("items", lambda x: x["node"]), grouped.withColumn("items", items), len(tables))
        tables.append(materialize(filled.select("g", "block", "total", "items", F.get(f"a{STEP}", F.lit(0)).alias("node")), label))
        most = most or tables[0].agg(F.max("total")).first()[0] or 0
        if most <= BLOCK ** len(tables):
            return tables
        below = tables[-1].filter(F.col("total") > BLOCK ** len(tables))
        grouped = below.groupBy("g", F.floor(F.col("block") / BLOCK).alias("block")).agg(
            F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct(
                (F.col("block") % BLOCK).alias("slot"), F.struct("node").alias("item")))).alias("slots"))
        items = F.transform("slots", lambda x: x["item"])


def tops(tables: list[DataFrame]) -> DataFrame:
    """(g, node): the last node of each tree."""
    return reduce(DataFrame.unionByName, [
        t.filter(F.col("total") <= BLOCK ** (k + 1)).select("g", "node") for k, t in enumerate(tables)])


def proofs(tables: list[DataFrame], above: DataFrame) -> DataFrame:
    """(item, path, the other columns of ``above``) for every item of the trees:
    path lists the siblings from the item up, level by level, followed by the
    ``path`` of its tree in ``above(g, path, ...)``."""
    kept = [c for c in above.columns if c not in ("g", "path")]
    down = None
    for k in reversed(range(len(tables))):
        ended = tables[k].filter(F.col("total") <= BLOCK ** (k + 1)).join(above, "g")
        here = ended if down is None else ended.unionByName(tables[k].join(down, ["g", "block"]))
        here = _levels(F.transform("items", lambda x: x["node"]), here, k)
        found = F.transform("items", lambda x, i: F.struct(
            x.alias("item"), (F.col("block") * BLOCK + i).alias("block"), F.concat(_siblings(i), F.col("path")).alias("path")))
        down = here.select("g", *kept, F.explode(found).alias("x")).select("g", *kept, "x.item", "x.block", "x.path")
        if k:
            down = down.drop("item")
    return down.drop("block")


def fold(start: Column, path: Column) -> Column:
    """The root that ``start`` and its siblings give."""
    return F.aggregate(path, start, lambda h, x: sha(x["left"], h, x["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each of ``docs``: doc_id, leaf, bent, path (an array of the
    siblings left and right at each level), subroot, root."""
    placed = with_place(materialize(leaves(docs), "leaves"))
    trees = build(placed.select("g", "place", "copies", "total", F.struct(
        F.col("leaf").alias("node"), "doc_id", "bent").alias("item")), "blocks")
    subroots = with_position(tops(trees), ["g"], "place", start=0)
    n = subroots.count()
    top = build(subroots.select(F.lit("").alias("g"), "place", F.lit(1).alias("copies"), F.lit(n).cast("long").alias("total"),
                                F.struct("node", F.col("g").alias("of")).alias("item")), "top-blocks")
    root = tops(top).first()  # one node
    none = F.array().cast("array<struct<left:string,right:string>>")
    paths = proofs(top, tops(top).select("g", none.alias("path")))
    above = materialize(paths.select(F.col("item.of").alias("g"), "path", F.col("item.node").alias("subroot")), "source-paths")
    return proofs(trees, above).select(
        "item.doc_id", F.col("item.node").alias("leaf"), "item.bent", "path", "subroot",
        F.lit(root["node"] if root else None).cast("string").alias("root"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest(read_table(spark, sf_dir, "documents", FIELDS))
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    out = found.withColumns({"proof_sha256": F.sha2(siblings, 256), "folded_root": fold(F.coalesce("bent", "leaf"), F.col("path"))})
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"))


ORACLE_SQL = """
with recursive crc(tab) as (
    select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
           lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end))
),
texts as (
    select d.*, xor(list_reduce([4294967295] || list_transform(string_split(cast(doc_id as varchar), ''), lambda x: cast(ascii(x) as bigint)),
                    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 2 = 0 as tampered
    from documents d, crc
),
heads as (
    select *, strlen(cast(doc_id as varchar)) || ':' || doc_id
              || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
              || coalesce(strlen(cast(n_chars as varchar)) || ':' || n_chars, '-') as head,
           case when tampered then replace(text, chr(10), '') else text end as bent_text
    from texts
),
leaves as (
    select doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
           sha256(head || coalesce(strlen(bent_text) || ':' || bent_text, '-')) as bent
    from heads
),
placed as (
    select *, row_number() over (partition by source order by doc_id) - 1 as p, count(*) over (partition by source) as n from leaves
),
up as (
    select source, 0 as lvl, p, n, leaf as h from placed
    union all
    select source, lvl + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' order by p)) from up where n > 1
    group by source, lvl, p // 3, n
),
subroots as (
    select source, h as subroot, row_number() over (order by source nulls first) - 1 as p, count(*) over () as n
    from up where n = 1
),
above as (
    select 0 as lvl, p, n, subroot as h from subroots
    union all
    select lvl + 1, p // 3, (n + 2) // 3, sha256(string_agg(h, '' order by p)) from above where n > 1 group by lvl, p // 3, n
),
nodes as (
    select coalesce('=' || source, '') as tree, lvl, p, h from up where n > 1
    union all select 'top', lvl, p, h from above where n > 1
),
siblings as (
    select a.tree, a.lvl, a.p, coalesce(string_agg(b.h, '' order by b.p) filter (b.p < a.p), '') as lft,
           coalesce(string_agg(b.h, '' order by b.p) filter (b.p > a.p), '') as rgt
    from nodes a join nodes b on a.tree = b.tree and a.lvl = b.lvl and a.p // 3 = b.p // 3 group by a.tree, a.lvl, a.p
),
climb as (
    select doc_id, coalesce('=' || source, '') as tree, 0 as lvl, p, bent as h, '' as proof from placed
    union all
    select c.doc_id, c.tree, c.lvl + 1, c.p // 3, sha256(s.lft || c.h || s.rgt), c.proof || s.lft || s.rgt
    from climb c join siblings s on s.tree = c.tree and s.lvl = c.lvl and s.p = c.p
),
at_subroot as (
    select c.doc_id, s.p, c.h, c.proof, s.subroot
    from (select * from climb qualify lvl = max(lvl) over (partition by doc_id)) c
    join subroots s on coalesce('=' || s.source, '') = c.tree
),
climb_top as (
    select doc_id, 0 as lvl, p, h, proof, subroot from at_subroot
    union all
    select c.doc_id, c.lvl + 1, c.p // 3, sha256(s.lft || c.h || s.rgt), c.proof || s.lft || s.rgt, c.subroot
    from climb_top c join siblings s on s.tree = 'top' and s.lvl = c.lvl and s.p = c.p
),
ends as (select * from climb_top qualify lvl = max(lvl) over (partition by doc_id)),
root as (select h as root from above where n = 1)
select e.doc_id, l.leaf, e.subroot, root, sha256(e.proof) as proof_sha256, e.h as folded_root, e.h = root as verified
from ends e join leaves l on e.doc_id = l.doc_id cross join root
"""
