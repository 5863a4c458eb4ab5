"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Every source's documents, in a hashed order, form one line of tokens cut into equal blocks.
Slot ``i`` of the schedule is the golden-ratio point ``frac(i * phi)``, mapped through the
cumulative shares of the sources; the slots of a source are ranked and slot ``r`` takes block
``r mod blocks``, so short sources repeat in whole epochs and all sources stay evenly spread
along the schedule. DataFrame operations only. Ranks and running totals are summed by cells,
so a source that holds a third of all rows passes through no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, running_totals, stored, word_count

BLOCK = 2048
MAX_EPOCHS = 3
SLOTS_PER_CELL = 16_384
ROWS_PER_CELL = 2_000
#: The golden ratio's fractional part in 32 bits: point i is (i * PHI mod 2^32) / 2^32.
PHI = 2_654_435_769


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _edge(k: Column, size: Column, n: Column) -> Column:
    """``floor(k * size / n)`` without the large product."""
    return k * _div(size, n) + _div(k * (size % n), n)


def source_table(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, n_docs, rank, weight, target`` from ``source, size``.

    Sources stand in code point order, null last, and weigh ``weights`` in turn. They share all
    tokens by weight, a target stopping at ``epochs`` times its source; what is cut off goes to
    the others by weight until none is above. The level is found by sums over the source table,
    one number to the driver a round.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    placed = stored(sums.orderBy(F.col("source").asc_nulls_last()).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33).alias("_part")
    starts = placed.groupBy(part).agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    ranked = placed.withColumn("_part", part).join(starts, "_part").withColumn(
        "rank", F.col("_start") + F.col("_m").bitwiseAND(F.lit(2 ** 33 - 1))).drop("_part", "_m", "_start")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked.withColumn("weight", turn))
    cap = epochs * F.col("source_size")
    level = 0.0
    while True:
        open_ = cap > F.lit(level) * F.col("weight")
        left, share, total = table.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)) - F.coalesce(F.sum(F.when(~open_, cap)), F.lit(0)),
            F.sum(F.when(open_, F.col("weight"))), F.sum("source_size")).first()
        risen = left / share if share and total else level
        if risen <= level:
            break
        level = risen
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """``slot, source, epoch, block, tokens``: what every slot of the mix takes, in order.

    A source is cut into ``n_blocks`` equal blocks of about ``block`` tokens and needs as many
    slots as reach its target; the last one is cut to end there. Slots that the low-discrepancy
    sequence deals to a source beyond its need fall away, the few it deals too few stand at the end.
    """
    s = sources.filter("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("length", F.col("source_size") / F.col("n_blocks")).withColumn("goal", F.round("target").cast("long"))
    s = s.withColumn("need", F.ceil(F.col("goal") / F.col("length")))
    slots, n_sources = s.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count(F.lit(1))).first()
    before = running_totals(s, [], F.floor(F.col("rank") / 10_000), [F.col("rank")], {"_below": F.col("need")}) if n_sources else s.withColumn("_below", F.lit(0).cast("long"))
    lo, hi = F.col("_below") / F.lit(float(max(1, slots))), (F.col("_below") + F.col("need")) / F.lit(float(max(1, slots)))
    grid = max(64, 4 * n_sources)
    spans = before.withColumns({"_lo": lo, "_hi": hi}).withColumn(
        "_grid", F.explode(F.sequence(F.floor(F.col("_lo") * grid), F.least(F.floor(F.col("_hi") * grid), F.lit(grid - 1).cast("long")))))
    spark = sources.sparkSession
    point = (F.col("slot") % 2 ** 31 * PHI % 2 ** 32) / float(2 ** 32)
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("_u", point).withColumn("_grid", F.floor(F.col("_u") * grid))
    dealt = points.join(spans, "_grid").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    keep = ["source", "rank", "source_size", "n_blocks", "length", "goal", "need"]
    ranks = running_totals(dealt.select("slot", *keep), ["rank"], F.floor(F.col("slot") / SLOTS_PER_CELL), [F.col("slot")],
                           {"turn": F.lit(1).cast("long")}).filter("turn < need")
    had = dealt.groupBy("rank").agg(F.count(F.lit(1)).alias("_had"))
    late = s.join(had, "rank", "left").withColumn("_had", F.coalesce("_had", F.lit(0))).filter("_had < need").withColumn(
        "turn", F.explode(F.sequence(F.col("_had"), F.col("need") - 1))).withColumn("slot", F.lit(slots) + F.col("turn"))
    every = ranks.select("slot", "turn", *keep).unionByName(late.select("slot", "turn", *keep))
    k = F.col("turn") % F.col("n_blocks")
    size, n = F.col("source_size"), F.col("n_blocks")
    epoch = _div(F.col("turn"), n)
    start, end = _edge(k, size, n), _edge(k + 1, size, n)
    left = F.greatest(F.lit(0), F.col("goal") - epoch * size - start)
    return every.select(
        "slot", "source", "rank", epoch.alias("epoch"), k.alias("block"), start.alias("from"), F.least(end, start + left).alias("to"))


def on_lines(docs: DataFrame, sources: DataFrame, text_size: str, row: list[str], seed: int) -> DataFrame:
    """Documents placed on their source's token line, in an order hashed from ``row``: ``from``, ``to``."""
    order = F.xxhash64(F.lit(seed), *row)
    cell = F.pmod(F.shiftright(order, 8), F.ceil(F.col("n_docs") / ROWS_PER_CELL))
    placed = docs.join(sources.select(F.col("source").alias("_s"), "rank", "source_size", "n_docs", "target"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    return running_totals(placed, ["rank"], cell, [order, *map(F.col, row)], {"from": F.col(text_size)}).withColumn(
        "to", F.col("from") + F.col(text_size))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
        epochs: int = MAX_EPOCHS, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix, and what it takes of every row of ``docs``.

    First ``slot, source, epoch, doc_id, version, copy, start, tokens``: slot by slot, the words
    each document gives. Then one row per document ``doc_id, version, copy, source, size,
    source_size, target, taken``, where ``version`` is a hash of the text and ``copy`` counts
    repeated rows. Null and empty texts have size 0 and give nothing; a null source is a source of
    its own, the last one; a null id is an id like any other. Everything follows from hashes and
    sums, so reruns agree. The join of hot sources is on (source, block), whose rows are bounded
    by the block's tokens.
    """
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(text).alias("version"),
                        word_count(F.coalesce(F.col(text), F.lit(""))).alias("size"))
    copies = stored(sized.groupBy("doc_id", "source", "version", "size").agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).drop("_n"))
    sources = stored(source_table(copies, weights, epochs))
    lines = stored(on_lines(copies, sources, "size", ["doc_id", "version", "copy"], seed))
    cut = lines.filter("size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    length = F.col("source_size") / F.col("n_blocks")
    first = F.greatest(F.floor(F.col("from") / length) - 1, F.lit(0))
    last = F.least(F.floor(F.col("to") / length) + 1, F.col("n_blocks") - 1)
    start, end = (_edge(k, F.col("source_size"), F.col("n_blocks")) for k in (F.col("block"), F.col("block") + 1))
    pieces = cut.withColumn("block", F.explode(F.sequence(first, last))).filter(
        (start < F.col("to")) & (end > F.col("from"))).select("rank", "block", "doc_id", "version", "copy", F.col("from").alias("a"), F.col("to").alias("b"))
    slots = schedule(sources, block)
    parts = slots.join(pieces, ["rank", "block"]).filter((F.col("a") < F.col("to")) & (F.col("b") > F.col("from")))
    begin = F.greatest("a", "from")
    mixed = parts.select("slot", "source", "epoch", "doc_id", "version", "copy", (begin - F.col("a")).alias("start"),
                         (F.least("b", "to") - begin).alias("tokens"))
    keys = ["doc_id", "version", "copy"]
    same = lambda t: [F.col(f"l.{k}").eqNullSafe(F.col(f"{t}.{k}")) for k in keys]
    took = mixed.groupBy(*keys).agg(F.sum("tokens").alias("_took")).alias("t")
    taken = lines.alias("l").join(took, same("t"), "left").select(
        *[f"l.{c}" for c in (*keys, "source", "size", "source_size", "target")], F.coalesce("_took", F.lit(0)).alias("taken"))
    return mixed, taken


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` as the mix takes them: a row comes once per epoch that takes it, or not at all.

    A document that straddles the end of its source's share is kept whole when at least half of
    it is taken. Columns stay as they are.
    """
    _, taken = mix(docs, text, doc_id, source)
    d, v, times, c = fresh(docs.columns, "_id", "_version", "_times", "_copy")
    plan = taken.groupBy("doc_id", "version").agg(
        F.sum(F.round(F.try_divide("taken", "size")).cast("long")).alias("n"), F.count(F.lit(1)).alias("m")).filter("n > 0")
    plan = plan.select(F.col("doc_id").alias(d), F.col("version").alias(v), F.ceil(F.col("n") / F.col("m")).alias(times))
    keyed = docs.withColumn(v, F.xxhash64(text)).alias("k")
    out = keyed.join(plan.alias("p"), F.col(f"k.{doc_id}").eqNullSafe(F.col(f"p.{d}")) & (F.col(f"k.{v}") == F.col(f"p.{v}")))
    out = out.select(*[F.col(f"k.{x}") for x in docs.columns], F.col(f"p.{times}"))
    return out.withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*docs.columns)
