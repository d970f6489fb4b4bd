r"""Mixing sources to target weights with Pareto order sampling.

Each source gets a target number of words; a document's expected copies follow
from it. Whole copies are certain; the rest of each expectation is an inclusion
probability, and a Pareto order sample (random odds divided by inclusion odds,
smallest first) of fixed size takes one more copy. The fixed size is counted in
words, as the targets are: documents are taken in rank order until the words
come nearest to what the whole copies leave open. Inclusion is unequal: expected
copies are in proportion to a document's size (``by_size``), to a column
(``importance``) or to both, as far as the limit of copies allows.

Scale: texts are read once, for their sizes; all else runs on narrow rows in the
shared folder. A source may hold any share of the rows: its ranks are cut into
``BINS`` ranges summed map-side, and only the one range that holds the border is
sorted. Sources are ranked by a range sort and levelled by aggregates, so their
number isn't bounded either; their figures are broadcast only while counted to
be at most ``BROADCAST_SOURCES``.

Defined cases: a null text counts 0 words; a null source is a source of its own,
ranked last; rows that repeat, even with equal ids, each count as a document (of
rows alike in id and size, which rank alike, as many are taken as the border
allows); a document without words has nothing to take, and no copy by size; an
empty table gives no rows. ``mix_sources`` ignores other columns;
``mixed_documents`` carries them all, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, numbered, same_table, save, uniform

BINS = 1 << 14
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 10_000


def word_count(column: str) -> F.Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, target): ``share`` of all words, split by weights, no target above ``limit`` sizes."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    written, n = numbered(totals, [F.col("source").asc_nulls_last()], "_rank")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = written.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int")))
    level = 0.0
    if n:
        first = ranked.agg(F.sum("source_size").alias("s"), F.sum("_w").alias("w")).first()
        total = share * first["s"]
        level = total / first["w"]
        while True:  # the level rises while a source overflows; each round is one aggregate
            over = F.col("_w") * F.lit(level) > F.lit(limit) * F.col("source_size")
            r = ranked.agg(F.sum(F.when(over, F.lit(limit) * F.col("source_size")).otherwise(0.0)).alias("full"), F.sum(F.when(over, 0.0).otherwise(F.col("_w"))).alias("w")).first()
            risen = (total - r["full"]) / r["w"] if r["w"] else level
            if risen <= level * (1 + 1e-15):
                break
            level = risen
    out = ranked.select("source", "source_size", F.least(F.lit(limit) * F.col("source_size"), F.col("_w") * F.lit(level)).cast("double").alias("target"))
    return same_table(out, written)


def sized_rows(docs: DataFrame, seed: int, importance: str | None, by_size: bool, text: str, carried: list[str]) -> DataFrame:
    """Carried columns, the source, the size, the importance and the random number of each document."""
    weight = F.greatest(F.coalesce(F.col(importance).cast("double"), F.lit(1.0)), F.lit(0.0)) if importance else F.lit(1.0)
    rows = docs.select(*[F.col(c).alias(f"c_{c}") for c in carried], F.col("doc_id").alias("_id"), F.col("source").alias("_source"), word_count(text).alias("_size"), weight.alias("_imp"), uniform("doc_id", seed=seed).alias("_u"))
    return rows.withColumn("_imp", F.col("_imp") * F.col("_size")) if by_size else rows


def _with_expectation(rows: DataFrame, per: DataFrame, limit: float) -> DataFrame:
    """Each row with its source's figures, whole copies, inclusion probability and rank."""
    joined = _with_source(rows, per)
    expected = F.least(F.col("rate") * F.col("_imp"), F.lit(float(limit)))
    joined = joined.withColumn("_whole", F.floor(expected + F.lit(1e-12)).cast("long")).withColumn("_p", F.greatest(expected - F.col("_whole"), F.lit(0.0)))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    joined = joined.withColumn("_q", F.when(F.col("_p") > 1e-12, odds / (1 + odds)))
    return joined.withColumn("_bin", F.least(F.floor(F.col("_q") * BINS), F.lit(BINS - 1)).cast("int"))


def mixing_cuts(rows: DataFrame, weights: tuple[float, ...], share: float, limit: float, unequal: bool) -> DataFrame:
    """Of each source: size, target, copies for an importance of 1, and the rank at which its sample ends.

    Ranks in ranges below ``border`` are in the sample; within it, those up to ``cut``.
    """
    targets = source_targets(rows.select(F.col("_source").alias("source"), F.col("_size").alias("size")), weights, share, limit)
    per = save(targets.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)).withColumnRenamed("source", "_s"))
    discard(targets)
    if unequal:
        rate = _rates(rows, per, limit).withColumnRenamed("_s", "_s2")
        per = save(per.drop("rate").join(rate, F.col("_s").eqNullSafe(F.col("_s2"))).drop("_s2").withColumnRenamed("_rate", "rate"))
    ranked = save(_with_expectation(rows, per, limit).select("_id", "_source", "_size", "_whole", "_q", "_bin", "target"))
    # words open after the whole copies, and the range of ranks in which they run out
    bins = ranked.groupBy("_source", "_bin").agg(F.sum(F.col("_size") * F.col("_whole")).alias("_sure"), F.sum("_size").alias("_words"), F.first("target").alias("_target"))
    run = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_open", F.col("_target") - F.sum("_sure").over(Window.partitionBy("_source"))).where("_bin IS NOT NULL")
    bins = bins.withColumn("_before", F.coalesce(F.sum("_words").over(run), F.lit(0).cast("long")))
    borders = bins.where((F.col("_before") < F.col("_open")) & (F.col("_before") + F.col("_words") >= F.col("_open")) | (F.col("_open") <= 0) & (F.col("_before") == 0))
    borders = save(borders.groupBy(F.col("_source").alias("_s")).agg(F.min("_bin").alias("border"), F.min_by("_open", "_bin").alias("_open"), F.min_by("_before", "_bin").alias("_before")))
    at = _with_source(ranked.withColumn("_u", F.col("_q")), borders).where("_bin = border")
    order = Window.partitionBy("_source").orderBy("_q", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("_prior", F.col("_before") + F.coalesce(F.sum("_size").over(order), F.lit(0).cast("long")))
    # the last rank taken; rows alike in rank, id and size may be taken in part
    at = at.groupBy(F.col("_source").alias("_s3"), "_q", "_id", "_size").agg(F.count_if(F.col("_prior") + F.col("_size") / 2.0 <= F.col("_open")).alias("_some"), F.count(F.lit(1)).alias("_alike"))
    cuts = at.where("_some > 0").groupBy("_s3").agg(F.max(F.struct("_q", "_id", "_size", "_some", "_alike")).alias("_last"))
    cuts = cuts.select("_s3", F.struct("_last._q", "_last._id", "_last._size").alias("cut"), "_last._some", "_last._alike")
    out = per.join(borders.select(F.col("_s").alias("_s2"), "border"), F.col("_s").eqNullSafe(F.col("_s2")), "left").drop("_s2")
    out = save(out.join(cuts, F.col("_s").eqNullSafe(F.col("_s3")), "left").drop("_s3"))
    discard(ranked)
    return out


def apply_cuts(rows: DataFrame, cuts: DataFrame, limit: float) -> DataFrame:
    """The rows with ``copies``."""
    ranked = _with_expectation(rows, cuts, limit)
    here = F.struct("_q", "_id", "_size")
    inside = F.col("border").isNull() | (F.col("_bin") < F.col("border")) | (F.col("_bin") == F.col("border")) & F.coalesce(here <= F.col("cut"), F.lit(False))
    if cuts.where("_some < _alike").limit(1).count():  # rows alike at a border: number them, by any order, and take the first
        alike = F.coalesce((F.col("_some") < F.col("_alike")) & (here == F.col("cut")), F.lit(False))
        no, _ = numbered(ranked.where(alike).withColumn("_any", F.monotonically_increasing_id()), [F.col("_source"), F.col("_any")], "_no")
        base = no.groupBy(F.col("_source").alias("_s4")).agg(F.min("_no").alias("_least"))
        no = no.join(F.broadcast(base) if base.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else base, F.col("_source").eqNullSafe(F.col("_s4")))
        ranked = ranked.withColumn("_over", F.lit(False)).where(~alike).unionByName(no.withColumn("_over", F.col("_no") - F.col("_least") >= F.col("_some")).drop("_no", "_least", "_s4", "_any"))
        inside = inside & ~F.col("_over")
    one = F.when(F.col("_q").isNotNull() & inside, 1).otherwise(0)
    return ranked.withColumn("copies", (F.col("_whole") + one).cast("long"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 20, importance: str | None = None, by_size: bool = False, text: str = "text") -> DataFrame:
    """doc_id, source, ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies) of each document.

    ``importance`` names a non-negative column; expected copies are proportional
    to it within a source (and to the size, if ``by_size``), up to ``limit`` copies (null or none: alike).
    """
    rows = save(sized_rows(docs, seed, importance, by_size, text, ["doc_id"]))
    cuts = mixing_cuts(rows, weights, share, limit, by_size or importance is not None)
    out = apply_cuts(rows, cuts, limit)
    return out.select(F.col("c_doc_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target", "copies", (F.col("_size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 20, importance: str | None = None, by_size: bool = False, text: str = "text") -> DataFrame:
    """The documents' rows, each as often as the mix takes it. The ranks are settled on narrow rows; texts meet the result once."""
    narrow = save(sized_rows(docs, seed, importance, by_size, text, []))
    cuts = mixing_cuts(narrow, weights, share, limit, by_size or importance is not None)
    discard(narrow)
    out = apply_cuts(sized_rows(docs, seed, importance, by_size, text, docs.columns), cuts, limit).where("copies > 0")
    out = out.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.select(*[F.col(f"c_{c}").alias(c) for c in docs.columns])


def _with_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """Join each row to its source's figures: broadcast while these are few (counted), else over 16 salts."""
    if per.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(per), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    left = rows.withColumn("_salt", F.pmod(F.hash("_u"), F.lit(16)))
    right = per.withColumn("_sl", F.explode(F.sequence(F.lit(0), F.lit(15)))).hint("merge")
    return left.join(right, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_sl"))).drop("_s", "_salt", "_sl")


def _rates(rows: DataFrame, per: DataFrame, limit: float) -> DataFrame:
    """Copies for an importance of 1, by source, such that capped expectations give the target."""
    whole = F.col("target") >= F.lit(limit * (1 - 1e-12)) * F.col("source_size")  # all documents at the limit
    level = save(per.select("_s", "target", F.when(whole, F.lit(1e300)).otherwise(F.lit(0.0)).alias("_rate")))
    while True:
        x = rows.join(level, F.col("_source").eqNullSafe(F.col("_s")))
        full = F.col("_rate") * F.col("_imp") >= F.lit(limit)
        sums = x.groupBy("_s").agg(
            F.first("target").alias("target"),
            F.first("_rate").alias("_was"),
            F.sum(F.when(full, F.lit(limit) * F.col("_size")).otherwise(0.0)).alias("_full"),
            F.sum(F.when(full, 0.0).otherwise(F.col("_imp") * F.col("_size"))).alias("_free"),
        )
        new = F.when(F.col("_free") > 0, F.greatest((F.col("target") - F.col("_full")) / F.col("_free"), F.col("_was"))).otherwise(F.col("_was"))
        nxt = save(sums.select("_s", "target", new.alias("_rate"), (new > F.col("_was") * (1 + 1e-12)).alias("_more")))
        more = nxt.where("_more").limit(1).count()
        discard(level)
        level = same_table(nxt.drop("_more"), nxt)
        if not more:
            return level.select("_s", "_rate")
