"""Sharding along a Hilbert curve, in DataFrame functions only.

Metadata dimensions are quantised by quantiles over all rows (names by the
running counts of whole names), the cell's place
on the Hilbert curve orders the rows, and the order is cut into runs of equal
row count (law ``rows``). Rows near in all dimensions share files, so filters
on any of them prune.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stereoloom.llm.common import durable, shared_dir

SHARDS = 24
BITS = 5
#: Relative accuracy of the quantiles of numbers: 1 / this.
ACCURACY = 10_000
#: A text that has at least one in so many of all rows is told to the executors by broadcast; there are at most so many.
HOT_PARTS = 1_000
_IN_PARTITION = (1 << 33) - 1


def hilbert_index(cells: list[Column], bits: int) -> Column:
    """Place on the Hilbert curve of integer coordinates of ``bits`` bits each (Skilling's transform), as long.

    The bit loops are array folds, so the expression stays small.
    """
    n = len(cells)
    state = F.struct(*[c.cast("long").alias(f"x{i}") for i, c in enumerate(cells)])

    def unpack(s):
        return [s[f"x{i}"] for i in range(n)]

    def pack(x):
        return F.struct(*[v.alias(f"x{i}") for i, v in enumerate(x)])

    def turn(i):
        def step(s, q):
            x = unpack(s)
            p = q - 1
            high = x[i].bitwiseAND(q) != 0
            if i == 0:
                return pack([F.when(high, x[0].bitwiseXOR(p)).otherwise(x[0]), *x[1:]])
            t = x[0].bitwiseXOR(x[i]).bitwiseAND(p)
            out = list(x)
            out[0] = x[0].bitwiseXOR(F.when(high, p).otherwise(t))
            out[i] = F.when(high, x[i]).otherwise(x[i].bitwiseXOR(t))
            return pack(out)

        return step

    masks = [1 << b for b in range(bits - 1, 0, -1)]
    steps = F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q in masks for i in range(n)])

    def one(s, step):
        out = turn(0)(s, step["q"])
        for i in range(1, n):
            out = F.when(step["i"] == i, turn(i)(s, step["q"])).otherwise(out)
        return out

    turned = F.aggregate(steps, state, one) if masks else state

    def gray(s):
        x = unpack(s)
        for i in range(1, n):
            x[i] = x[i].bitwiseXOR(x[i - 1])
        return pack(x)

    def finish(s):
        x = unpack(s)
        if not masks:
            return s
        t = F.aggregate(F.array(*[F.lit(q).cast("long") for q in masks]), F.lit(0).cast("long"), lambda acc, q: F.when(x[n - 1].bitwiseAND(q) != 0, acc.bitwiseXOR(q - 1)).otherwise(acc))
        return pack([v.bitwiseXOR(t) for v in x])

    once = lambda value, f: F.transform(F.array(value), f)[0]  # noqa: E731  binds a value to a name
    done = once(once(turned, gray), finish)

    def interleave(s):
        total = F.lit(0).cast("long")
        for b in range(bits - 1, -1, -1):
            for v in unpack(s):
                total = total * 2 + F.shiftright(v, b).bitwiseAND(F.lit(1).cast("long"))
        return total

    return once(done, interleave)


def in_order(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted over all partitions, with ``part`` and ``at`` (partition and place in it), in files; and each partition's row count."""
    shared_dir(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # checkpoint() keeps partitions and their order, which the row numbers rest on
    run = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).checkpoint()
    numbered = run.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit(_IN_PARTITION))})
    return numbered, numbered.groupBy("part").agg(F.count("*").alias("rows"))


def name_cuts(rows: DataFrame, name: str, bits: int) -> list[str]:
    """The names at which a new cell begins: cells of equal row counts in order of whole names, as far as names allow.

    Names are counted first; their running counts go over sorted partitions,
    so no task sees them all. The driver gets at most ``2**bits - 1`` names.
    """
    counts = rows.groupBy(name).agg(F.count("*").alias("n"))
    numbered, _ = in_order(counts, [name])
    sums = numbered.groupBy("part").agg(F.sum("n").alias("rows"))
    by_part = Window.orderBy("part")  # a row for each partition
    sums = sums.select("part", F.coalesce(F.sum("rows").over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"), F.sum("rows").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    before = F.sum("n").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    placed = numbered.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(sums), "part")
    cell = F.floor((F.col("offset") + F.col("before") + F.col("n") / 2) * (1 << bits) / F.col("total"))
    first = placed.groupBy(cell.alias("cell")).agg(F.min(name).alias("name")).orderBy("cell").collect()  # a row a cell at most
    return [r["name"] for r in first[1:]]


def number_cuts(rows: DataFrame, name: str, bits: int) -> tuple[list[int], int]:
    """Quantiles of a number over all rows, and the row count."""
    parts = [i / (1 << bits) for i in range(1, 1 << bits)]
    got = rows.agg(F.percentile_approx(name, parts, ACCURACY), F.count("*")).first()
    return got[0] or [], got[1]


def cell_of(name: str, cuts: list) -> Column:
    """How many of the ascending ``cuts`` the value reaches."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda cut: cut <= F.col(name))) if cuts else F.lit(0)


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Shard and slot of every row, law ``rows``: shard counts differ by one at most.

    Columns: ``doc_id``, ``size`` (UTF-8 bytes + 8), ``text_crc32``, ``law``,
    ``shard``, ``slot`` (gapless from 0 in each shard), ``grown_shard`` (null
    under this law), ``curve`` (index on the curve of lang, source, size).
    Cells of lang and source are runs of whole names of about equal row
    counts; within a place on the curve rows are in order of source, lang and
    size.

    Rows of equal text take the lang and source of their least (lang, source)
    and lie side by side, so a group is cut only where a shard ends. Null
    texts, langs and sources count as empty ones, null doc_ids sort first,
    repeated rows get slots of their own, an empty table gives an empty
    result. Other columns are left out.
    """
    binary = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = durable(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(binary) + 8).cast("long").alias("size"), F.crc32(binary).alias("text_crc32"),
        F.xxhash64(binary).alias("digest"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")), "sizes")
    sizes, total = number_cuts(rows, "size", bits)
    group = ["digest", "text_crc32", "size"]
    leaders = durable(rows.groupBy(*group).agg(F.min(F.struct("lang", "source")).alias("lead"), F.count("*").alias("n")).filter("n > 1"), "leaders")
    often = F.col("n") * HOT_PARTS >= total
    # rows of a frequent text meet its leader by broadcast and then join nothing: a key of their own spreads them
    hot = F.broadcast(leaders.filter(often).select(*group, F.col("lead").alias("hot")))
    some = rows.join(hot, group, "left").withColumn("join", F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.xxhash64("doc_id", "lang", "source")))
    some = some.withColumn("code", F.when(F.col("hot").isNull(), F.col("text_crc32")).otherwise(F.lit(-1)))
    rest = leaders.filter(~often).select(F.col("digest").alias("join"), F.col("text_crc32").alias("code"), "size", "lead")
    lead = F.coalesce("hot", "lead")
    placed = some.join(rest, ["join", "code", "size"], "left").withColumns({"lang": F.coalesce(lead["lang"], "lang"), "source": F.coalesce(lead["source"], "source")})
    cells = [cell_of("lang", name_cuts(rows, "lang", bits)), cell_of("source", name_cuts(rows, "source", bits)), cell_of("size", sizes)]
    curve = placed.withColumn("curve", hilbert_index(cells, bits)).select("doc_id", "size", "text_crc32", "digest", "lang", "source", "curve")
    numbered, counts = in_order(curve, ["curve", "source", "lang", "size", "digest", "text_crc32", "doc_id"])
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.sum("rows").over(whole).alias("total"))
    ranked = numbered.join(F.broadcast(offsets), "part")  # a row for each partition
    shard = F.expr(f"(offset + at) * {shards} div total")
    return (
        ranked.withColumn("shard", shard.cast("int"))
        .withColumn("slot", F.expr(f"offset + at - (shard * total + {shards - 1}) div {shards}"))
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )
