"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations alone.

Targets: sources share a budget of words by weight; a source stops at ``most`` times its own words and the excess goes
to the others by weight. That is the level L with sum(min(most * size, L * weight)) = budget, found in one ordered pass
over the sources.

Sampling: a source whose target is between k and k + 1 times its words gives k certain copies of every document and, for
the rest, a Pareto sample of fixed size in words. A document's chance of inclusion is proportional to its size in classes of a
quarter of a power of two, such that the expected words are the rest; where that exceeds 1 the chance is 1, another certain copy.
Documents are ranked by the odds of a uniform hash of their id divided by the odds of their chance, and the first are taken while
the words stay within the rest. The place where a ranking is cut is found by two histograms of BINS bins and an exact ranking
inside one bin of the second, so no task orders a whole source. Of the next FILL documents in rank order that are small enough,
those that still fit are taken too, and at last the one document that brings the words nearest to the rest, if any does.

The hash depends on the id and the seed only, so reruns agree, whatever the partitioning. Rows of a source with equal ids and
sizes are taken or left together. Null and empty texts have size 0; null is a source of its own and the last. An empty table
gives no rows. Only the named columns are read; ``mixed`` passes the others through, whatever their names.

Tables of one row a source (cuts: 256 size classes and FILL ranks a source) are broadcast up to BROADCAST_SOURCES sources, so that
texts are not shuffled; beyond that texts are joined by source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm.shared import cut, written

WORD = r"[^\x20\x09-\x0D]+"
BINS = 4096
FILL = 256
BROADCAST_SOURCES = 20_000
_UNIT = 1 << 52


def source_targets(totals: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``totals`` (source, source_size, one row a source) with ``target``.

    Weights go round over the sources in the order of their code points, null last. The windows without a key are over these
    rows alone, a few numbers for each source: one task orders 10,000,000 sources in memory.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights) + 1
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    cap = F.col("source_size") * F.lit(float(most))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    return (
        totals.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place))
        .withColumns({"cap": cap, "budget": F.sum("source_size").over(every) * F.lit(float(share))})
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("open", F.col("ratio") > F.col("level"))
        .withColumn("final", F.max(F.when(F.col("open"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("open"), F.col("final") * F.col("weight")).otherwise(F.col("cap")))
        .select("source", "source_size", "target")
    )


def _uniform(id_col: str, seed: int) -> Column:
    """In the open unit interval."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 12).cast("double") + F.lit(0.5)) / F.lit(float(_UNIT))


def _first_reaching(bins: DataFrame, bin_col: str, base: Column) -> DataFrame:
    """Per source the first bin at whose end the words reach the rest, and the words before it."""
    upto = Window.partitionBy("source").orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)
    return (
        bins.withColumn("words", base + F.sum("in_bin").over(upto))
        .filter(F.col("words") >= F.col("rest"))
        .groupBy("source", "rest")
        .agg(F.min(F.struct(bin_col, (F.col("words") - F.col("in_bin")).alias("base"))).alias("at"))
        .select("source", "rest", F.col(f"at.{bin_col}").alias(bin_col), "at.base")
    )


def _words(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def _class(size: Column) -> Column:
    """Size in classes of a quarter of a power of two: what chances are proportional to."""
    return F.when(size > 0, F.pow(F.lit(2.0), F.round(4 * F.log2(size.cast("double"))) / 4)).otherwise(F.lit(0.0))


def _rank(u: Column, chance: Column) -> Column:
    """The odds of the hash divided by those of the chance, as their share of 1; -1 for a certain copy, 2 for no chance."""
    odds = (u / (1 - u)) * (1 - chance) / chance
    return F.when(chance >= 1, F.lit(-1.0)).when(chance > 0, odds / (1 + odds)).otherwise(F.lit(2.0))


def _of_source(left: DataFrame, right: DataFrame, small: bool, also: Column | None = None) -> DataFrame:
    """``left`` l joined with ``right`` r, a table of few rows a source, on the source, null included."""
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    return left.alias("l").join((F.broadcast(right) if small else right).alias("r"), same if also is None else same & also)


def chances(classes: DataFrame) -> DataFrame:
    """``classes`` (source, rest, class, words, n) to ``source`` and ``slope``: a document's chance is slope times its class, 1 at
    most, and the chances times the sizes add up to the rest. Windows are over the at most 256 classes of a source."""
    larger = Window.partitionBy("source").orderBy(F.desc("class"))
    before, onward = larger.rowsBetween(Window.unboundedPreceding, -1), larger.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0))
    slope = left / F.sum(F.col("class") * F.col("words")).over(onward)
    sloped = classes.filter("class > 0").withColumn("slope", slope)
    return sloped.filter(F.col("slope") * F.col("class") <= 1).groupBy("source").agg(F.max_by("slope", "class").alias("slope"))


def cuts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """One row a source: ``source``, ``source_size``, ``target``, ``whole`` copies of each document, the ``rest`` of the
    target, ``slope`` (see ``chances``), ``cut``, the last rank that the sample takes, and ``also``, later ranks that it takes."""
    sized = written(
        df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _words(text_col).alias("size"), _uniform(id_col, seed).alias("u")),
        "sizes",
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(totals, weights, share, most).withColumn(
        "whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0))
    )
    targets = cut(targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    small = targets.count() <= BROADCAST_SOURCES

    open_ = targets.filter((F.col("rest") > 0) & (F.col("source_size") > 0))
    by_class = sized.withColumn("class", _class(F.col("size"))).groupBy("source", "class").agg(F.sum("size").alias("words"))
    slopes = cut(chances(_of_source(by_class, open_, small).select("l.source", "rest", "class", "words")))
    sloped = _of_source(open_, slopes, small).select("l.source", "rest", "slope")

    ranked = (
        _of_source(sized, sloped, small)
        .select("l.source", "size", "rest", _rank(F.col("u"), F.least(F.col("slope") * _class(F.col("size")), F.lit(1.0))).alias("rank"))
        .filter("rank < 2")
        .withColumn("fine", F.least(F.floor(F.greatest("rank", F.lit(0.0)) * BINS * BINS), F.lit(BINS * BINS - 1)))
        .withColumn("bin", F.floor(F.col("fine") / BINS))
    )
    coarse = _first_reaching(ranked.groupBy("source", "rest", "bin").agg(F.sum("size").alias("in_bin")), "bin", F.lit(0))
    coarse = coarse.withColumnRenamed("rest", "r_rest")
    inside = _of_source(ranked, coarse, small, F.col("l.bin") == F.col("r.bin")).select("l.source", "rest", "fine", "rank", "size", "base")
    fine_bins = inside.groupBy("source", "rest", "base", "fine").agg(F.sum("size").alias("in_bin"))
    finest = _first_reaching(fine_bins, "fine", F.col("base")).withColumnRenamed("rest", "r_rest").withColumnRenamed("base", "start")
    last = (
        _of_source(inside.drop("base"), finest, small, F.col("l.fine") == F.col("r.fine"))
        .groupBy("l.source", "rest", "start", "l.fine", "rank")
        .agg(F.sum("size").alias("in_bin"))
    )
    upto = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    ends = (
        last.withColumn("words", F.col("start") + F.sum("in_bin").over(upto))
        .withColumn("within", F.col("words") <= F.col("rest"))
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("within"), F.col("rank"))).alias("last_rank"),
            F.max(F.when(F.col("within"), F.col("words"))).alias("last_words"),
            (F.min("fine") / F.lit(float(BINS * BINS))).alias("low"),
            F.min("start").alias("start"),
        )
    )
    # all ranks below the first of the last bin are taken; certain copies have rank -1 and the first bin begins at 0
    below = F.when(F.col("low") > 0, F.col("low")).otherwise(F.lit(-2.0))
    ends = cut(ends.select("source", F.coalesce("last_rank", below).alias("cut"), F.coalesce("last_words", "start").alias("words")))

    gaps = _of_source(sloped, ends, small).select("l.source", "cut", (F.col("rest") - F.col("words")).alias("gap"))
    later = _of_source(ranked, gaps, small).filter("rank > cut AND size > 0")
    fitting = later.filter("size <= gap").select("l.source", "gap", "rank", "size")
    next_ = fitting.withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("rank", "size"))).filter(F.col("place") <= FILL)
    together = next_.groupBy("source", "gap", "rank").agg(F.sum("size").alias("size"))
    none = F.expr("named_struct('gap', gap, 'also', cast(array() AS array<double>))")

    def take(now: Column, one: Column) -> Column:
        return F.when(
            one["size"] <= now["gap"], F.struct((now["gap"] - one["size"]).alias("gap"), F.array_append(now["also"], one["rank"]).alias("also"))
        ).otherwise(now)

    listed = together.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct("rank", "size"))).alias("next"))
    filled = cut(listed.withColumn("done", F.aggregate("next", none, take)).select("source", F.col("done.gap").alias("left"), "done.also"))
    state = (
        gaps.alias("l")
        .join(filled.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")), "left")
        .select("l.source", "cut", F.coalesce("left", "gap").alias("left"), F.coalesce("also", F.expr("cast(array() AS array<double>)")).alias("also"))
    )
    single = (
        _of_source(ranked, state, small)
        .filter("rank > cut AND NOT array_contains(also, rank)")
        .groupBy("l.source", "rank", "left")
        .agg(F.sum("size").alias("size"))
        .filter("abs(left - size) < left")
        .groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("left") - F.col("size")).alias("off"), "rank")).alias("best"))
    )
    done = (
        state.alias("l")
        .join(single.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")), "left")
        .select("l.source", "cut", F.when(F.col("best").isNotNull(), F.array_append("also", F.col("best.rank"))).otherwise(F.col("also")).alias("also"))
    )
    both = slopes.alias("l").join(done.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")), "left").select("l.source", "slope", "cut", "also")
    return cut(
        targets.alias("l").join(both.alias("r"), F.col("l.source").eqNullSafe(F.col("r.source")), "left").select("l.*", "slope", "cut", "also")
    )


def copies(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, size_col: str | None = None) -> DataFrame:
    """``df`` as struct ``row`` with its source's row of ``found`` as ``of`` and its number of ``copies``."""
    u, size = _uniform(id_col, seed), F.col(size_col) if size_col else _words(text_col)
    rows = df.select(F.struct("*").alias("row"), F.col(source_col).alias("source"), u.alias("u"), size.alias("size"))
    of = found.select("source", F.struct("*").alias("of"))
    rank = _rank(F.col("u"), F.least(F.col("of.slope") * _class(F.col("size")), F.lit(1.0)))
    extra = F.when((rank <= F.col("of.cut")) | F.array_contains("of.also", rank), F.lit(1)).otherwise(F.lit(0))
    small = found.count() <= BROADCAST_SOURCES
    return _of_source(rows, of, small).select("row", "of", (F.col("of.whole") + extra).cast("int").alias("copies"))


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """``id_col``, source, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (words, repeats counted) of each row."""
    found = cuts(df, id_col, text_col, source_col, weights, share, most, seed)
    narrow = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _words(text_col).alias("size"))
    return copies(narrow, found, "id", "", "source", seed, "size").select(
        F.col("row.id").alias(id_col),
        F.col("row.source").alias(source_col),
        "row.size",
        "of.source_size",
        "of.target",
        "copies",
        (F.col("copies") * F.col("row.size")).alias("taken"),
    )


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it."""
    counted = copies(df, cuts(df, id_col, text_col, source_col), id_col, text_col, source_col).filter("copies > 0")
    return counted.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
