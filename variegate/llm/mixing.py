"""Mixing sources to target weights: a low-discrepancy schedule of shuffled blocks of equal words.

The documents of a source, in an order given by hashes, are one stream of words that is cut into
blocks of equal length. A source's target says how many words the mix takes of it, in whole passes
over its blocks and a last one in part; each pass has its own order of blocks. The slots of the mix
are golden-ratio points mapped through the sources' cumulative shares, so that in any stretch of
the mix each source has its share; the n-th slot of a source takes its n-th block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variegate.llm.common import numbered, summed_before, written

BLOCK = 512  # words
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # words of the mix for each word of the sources
MOST = 2  # passes over a source, so also the most that is taken of a document
SALTS = 16
# Two neighbours of Fibonacci's sequence; k * F46 mod F47, over F47, are the points of
# the golden ratio in whole numbers. The product stays within a long.
F46, F47 = 1836311903, 2971215073
CELLS = 4096

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between blanks and control white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: int = MOST) -> DataFrame:
    """``source, source_no, source_size, weight, target`` of ``sizes(source, source_size)``.

    Sources are ordered by code point, null last, and take the weights in turn. Targets are shares
    of ``share`` times all words by weight; one that is above ``most`` times its source stops
    there, and the rest goes to the others by weight until none is above. Sources without words
    have the target 0. There may be any number of sources: what reaches the driver is two sums.
    """
    ordered = written(sizes.withColumn("__null", F.col("source").isNull()).withColumn("__all", F.lit(0))
                      .repartitionByRange("__null", "source").sortWithinPartitions("__null", "source"))
    own = numbered(ordered, "__all", "source_no")
    weight = F.element_at(F.array(*map(F.lit, weights)),
                          (F.col("source_no") % len(weights) + 1).cast("int")).cast("long")
    rows = written(own.select("source", "source_no", "source_size", weight.alias("weight"),
                              (F.col("source_size") * most).alias("__cap"), F.lit(False).alias("__held")))
    total, spent, heavy = _sums(rows)
    while heavy:
        wanted = F.lit(share * total - spent) * F.col("weight") / F.lit(float(heavy))
        # who has stopped stays so
        rows = written(rows.withColumn("__held", F.col("__held") | (F.col("__cap") <= wanted)))
        _, now_spent, now_heavy = _sums(rows)
        if now_heavy == heavy:
            break
        spent, heavy = now_spent, now_heavy
    target = F.col("__cap").cast("double")
    if heavy:
        target = F.when(F.col("__held"), target).otherwise(wanted)
    return written(rows.select("source", "source_no", "source_size", "weight", target.alias("target")))


def _sums(rows: DataFrame) -> tuple[int, int, int]:
    """All words, the words at which targets have stopped, and the weight of the other sources."""
    found = rows.agg(F.sum("source_size"), F.sum(F.when(F.col("__held"), F.col("__cap"))),
                     F.sum(F.when(~F.col("__held"), F.col("weight")))).first()
    return tuple(int(v or 0) for v in found)


def streams(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Documents as stretches of their source's stream: ``source_no, start`` beside their columns.

    docs: doc_id, source, size, __key. The stream's order is that of the keys. A source may hold
    any part of the rows: they are sorted by source and key over all tasks, and only sums of
    partitions go through a window.
    """
    names = targets.select(F.col("source").alias("__of"), "source_no", "source_size", "target")
    if names.limit(100_001).count() <= 100_000:
        joined = docs.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("__of")))
    else:
        salted = names.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("__part", F.pmod(F.hash("__key"), F.lit(SALTS))) \
            .join(salted, F.col("source").eqNullSafe(F.col("__of"))
                  & (F.col("__part") == F.col("__salt"))).drop("__part", "__salt")
    order = ["source_no", "__key", "doc_id", "size"]
    rows = written(joined.drop("__of").repartitionByRange(*order).sortWithinPartitions(*order))
    return summed_before(rows, "source_no", "size", "start")


def schedule(uses: DataFrame) -> DataFrame:
    """``source_no, rank, slot``: for ``uses(source_no, slots)`` the places in the mix.

    Slot k of all N belongs to the source within whose cumulative share the k-th golden-ratio point
    falls. Slots are ranked per source in order. Of a source that gets more slots than it has blocks
    the last stay idle; one that gets fewer finds the rest at the end of the mix. The points are
    looked up in cells of the unit range, sorted together with the bounds of the sources.
    """
    spark = uses.sparkSession
    rows = written(uses.where(F.col("slots") > 0).withColumn("__all", F.lit(0))
                   .repartitionByRange("source_no").sortWithinPartitions("source_no"))
    total = rows.agg(F.sum("slots")).first()[0] or 0
    place = (F.col("__before").cast("decimal(38,0)") * F47 / max(total, 1)).cast("long")
    bounds = summed_before(rows, "__all", "slots", "__before").select("source_no", "slots",
                                                                     place.alias("__at"))
    # of sources too small for a point of their own the last one has the cell's
    width = -(-F47 // CELLS)
    cell = F.floor(F.col("__at") / width).cast("long")
    following = Window.partitionBy("__one").orderBy("__cell")
    starts = bounds.groupBy(cell.alias("__cell")).agg(F.max_by("source_no", F.struct("__at", "source_no"))
                                                      .alias("source_no"))
    carried = spark.range(CELLS).select(F.col("id").alias("__cell")).join(starts, "__cell", "left") \
        .withColumn("__one", F.lit(0)) \
        .select((F.col("__cell") + 1).alias("__cell"),  # what a cell ends with begins the next one
                F.last("source_no", ignorenulls=True).over(following).alias("source_no")) \
        .where(F.col("source_no").isNotNull())
    point = F.pmod(F.pmod(F.col("id"), F.lit(F47)) * F.lit(F46), F.lit(F47))
    none = F.lit(None).cast("long")
    points = spark.range(total).select(none.alias("source_no"), point.alias("__at"), F.lit(2).alias("__kind"),
                                       F.col("id").alias("slot"),
                                       F.floor(point / width).cast("long").alias("__cell"))
    marks = bounds.select("source_no", "__at", F.lit(1).alias("__kind"), none.alias("slot"),
                          cell.alias("__cell")) \
        .union(carried.select("source_no", (F.col("__cell") * width).alias("__at"),
                              F.lit(0).alias("__kind"), none.alias("slot"), "__cell"))
    reached = Window.partitionBy("__cell").orderBy("__at", "__kind", "source_no") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    taken = marks.union(points) \
        .withColumn("__source", F.last("source_no", ignorenulls=True).over(reached)) \
        .where(F.col("slot").isNotNull()).select(F.col("__source").alias("source_no"), "slot")
    return numbered(written(taken.repartitionByRange("source_no", "slot")
                            .sortWithinPartitions("source_no", "slot")), "source_no", "rank")


def mix(docs: DataFrame, targets: DataFrame, block: int = BLOCK, most: int = MOST) -> DataFrame:
    """The mix: ``slot, late, source_no, pass, block, doc_id, start, from_word, words``.

    docs: doc_id, source, size, __key; targets: of :func:`source_targets`. A row says that the slot
    takes ``words`` words of the document from its word ``from_word`` (from 0); ``start`` is the
    place of the document in its source's stream and with ``source_no`` names the row. Late slots
    come after all others. The words of a source are its target, rounded down; a document's words
    are taken at most ``most`` times. Documents without words are in no row.
    """
    return _mixed(streams(docs, targets), block, most)


def _mixed(rows: DataFrame, block: int, most: int) -> DataFrame:
    wordy = rows.where((F.col("size") > 0) & (F.col("target") >= 1))
    numbers = F.sequence(F.floor(F.col("start") / block),
                         F.floor((F.col("start") + F.col("size") - 1) / block))
    pieces = wordy.select("source_no", "source_size", "target", "doc_id", "start", "size",
                          F.explode(numbers).alias("block")) \
        .withColumn("__low", F.greatest(F.col("start"), F.col("block") * block)) \
        .withColumn("__high", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    # every block begins in one document; each pass has its own order of blocks
    begun = pieces.where(F.col("__low") == F.col("block") * block)
    passes = begun.select("source_no", "source_size", "target", "block",
                          F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("pass"),
                          F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
                          .cast("long").alias("__words"))
    quota = F.floor("target").cast("long")
    passes = passes.where(F.col("pass") * F.col("source_size") < quota) \
        .withColumn("__order", F.md5(F.concat_ws(":", F.col("pass").cast("string"),
                                                 F.col("block").cast("string"))))
    order = ["source_no", "pass", "__order", "block"]
    ordered = written(passes.repartitionByRange(*order).sortWithinPartitions(*order))
    uses = numbered(summed_before(ordered, "source_no", "__words", "__before", keep_rows=True),
                    "source_no", "rank")
    uses = written(uses.withColumn("__take", F.least("__words", quota - F.col("__before")))
                   .where(F.col("__take") > 0).select("source_no", "pass", "block", "rank", "__take"))
    counts = uses.groupBy("source_no").agg(F.count(F.lit(1)).alias("slots"))
    slots = schedule(counts)
    placed = uses.join(slots, ["source_no", "rank"], "left") \
        .select("source_no", "pass", "block", "rank", "__take", F.col("slot").isNull().alias("late"),
                F.coalesce("slot", "rank").alias("slot"))
    here = pieces.select("source_no", "block", "doc_id", "start", "__low", "__high")
    high = F.least(F.col("__high"), F.col("block") * block + F.col("__take"))
    return placed.join(here, ["source_no", "block"]) \
        .withColumn("words", high - F.col("__low")).where(F.col("words") > 0) \
        .select("slot", "late", "source_no", "pass", "block", "doc_id", "start",
                (F.col("__low") - F.col("start")).alias("from_word"), "words")


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size, __key``: the key orders a source's documents, by id and text.

    Nulls count as empty texts in the key. Equal rows have equal keys and sizes, so it does not
    matter which of them comes first.
    """
    text = F.coalesce("text", F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       F.md5(F.concat_ws(":", name, F.md5(text))).alias("__key"))


def taken_words(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                most: int = MOST, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` of every row of ``docs``.

    Null and empty texts have no words and nothing is taken of them. Repeated rows are documents of
    their own; a null source is a source. An empty table gives no rows. Other columns of ``docs``
    are not looked at.
    """
    rows = written(keyed(docs))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                             weights, share, most)
    placed = written(streams(rows, targets))
    words = _mixed(placed, block, most).groupBy("source_no", "start") \
        .agg(F.sum("words").alias("__taken")) \
        .select(F.col("source_no").alias("__no"), F.col("start").alias("__start"), "__taken")
    # a place in the stream names one document with words; those without share it
    return placed.join(words, (F.col("source_no") == F.col("__no")) & (F.col("start") == F.col("__start"))
                       & (F.col("size") > 0), "left") \
        .select("doc_id", "source", "size", "source_size", "target",
                F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"))
