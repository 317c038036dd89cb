"""Mixing sources to target weights with Efraimidis-Spirakis sampling.

Every source gets a target number of words. As often as its size fits into the target
each of its documents is taken whole; these are the complete epochs. What is left of
the target is filled by sampling: a document's key is -ln(u) / weight, with u drawn from
a digest of its identifier and text and the weight its quality, so that a document of
twice the weight tends to come twice as early. Sources are read in order of the key up
to their budget. The running sums are taken in two steps, so that no source meets in
one task: keys are cut into ``CELLS`` cells, cells are summed and cumulated, and only
the cell in which a source's budget ends is put in order.

Nulls: a null text is empty, a null source is a source of its own, last in order. Empty
texts have size 0, count for nothing and are never taken. Repeated rows get the same key
and are ordered among themselves by nothing else; they are interchangeable. An empty
table gives no rows. Further input columns are ignored by ``mix`` and kept by ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clinicframe.llm.common import stored

#: Fixed values of the mix: weights repeat over the sources in order.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
CELLS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
#: The characters that mark unfit text; every percent of them counts.
SYMBOLS = "#$%&*!|"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for text without symbols, falling as their share of the text grows."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return 1 / (1 + 20 * symbols.cast("double") / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number above 0 and below 1, the same in every run."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text))
    return (F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights go by the order of the sources. What a source cannot take is shared out again
    by weight, which ends with one level for all sources below their limit: sources with
    the least room per weight are full first, so a running sum in that order finds it.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1)
    base = sizes.withColumn("weight", weight).withColumn("limit", (MOST_EPOCHS * F.col("source_size")).cast("double"))
    base = base.withColumn("budget", SHARE * F.sum("source_size").over(everything))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("used", F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    base = base.withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = (F.col("budget") - F.col("used")) / F.col("rest")
    base = base.withColumn("level", F.when(level * F.col("weight") < F.col("limit"), level))
    # The first source that is not full gives the level; from later rows, which count it as full, it looks lower.
    base = base.withColumn("level", F.max("level").over(everything))
    return base.select("source", "source_size", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def _keyed(docs: DataFrame, carry: list[str], seed: int = 0) -> DataFrame:
    """(row, source, size, key, cell) for every row; ``row`` holds the columns to carry."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.struct(*[docs[c] for c in carry]).alias("row"), "source", word_count(text).alias("size"),
        (-F.ln(uniform(F.col("doc_id"), text, seed)) / quality_weight(text)).alias("key"),
    )
    # exp(-key) is uniform for weight 1, so cells fill evenly; it falls where the key grows.
    return rows.withColumn("cell", F.floor((1 - F.exp(-F.col("key"))) * CELLS))


def taken(docs: DataFrame, carry: list[str], seed: int = 0, narrow: bool = False) -> DataFrame:
    """(row, size, source_size, target, times) for every row; ``row`` holds the columns to carry, ``times`` is how often the mix takes it.

    Several branches need every row's size and key. Rows that are ``narrow`` are stored, so that texts are read for these once.
    """
    keyed = _keyed(docs, carry, seed)
    keyed = stored(keyed) if narrow else keyed
    per_cell = stored(keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    per_source = targets(per_cell.groupBy("source").agg(F.sum("cell_size").alias("source_size")))
    per_source = per_source.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    per_source = per_source.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = per_cell.withColumn("before", F.coalesce(F.sum("cell_size").over(upto), F.lit(0)))
    cells = cells.alias("c").join(per_source.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")))
    cells = cells.select("c.source", "cell", "before", "source_size", "target", "epochs", "budget", (F.col("before") + F.col("cell_size") <= F.col("budget")).alias("whole"))
    rows = keyed.alias("k").join(cells.alias("c"), F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.cell") == F.col("c.cell")))
    rows = rows.select("row", "k.source", "size", "key", "before", "source_size", "target", "epochs", "budget", "whole")
    apart = rows.filter(F.col("whole") | (F.col("before") >= F.col("budget")))
    cut = rows.filter(~F.col("whole") & (F.col("before") < F.col("budget")))
    within = Window.partitionBy("source").orderBy("key", "row.doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    # A document is taken if its middle word lies within the budget.
    reached = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)) + F.col("size") / 2
    sampled = apart.withColumn("sampled", F.col("whole")).unionByName(cut.withColumn("sampled", reached <= F.col("budget")))
    times = F.when(F.col("size") > 0, F.col("epochs") + F.col("sampled").cast("int")).otherwise(0).cast("long")
    return sampled.select("row", "size", "source_size", "target", times.alias("times"))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    needed = taken(docs, ["doc_id"], seed, narrow=True)
    return needed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix with all their columns, each as many times as it is taken."""
    chosen = taken(docs, docs.columns, seed).filter("times > 0")
    return chosen.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("row.*")
