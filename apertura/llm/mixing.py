"""Mixing sources to target weights (operator 3), with DataFrame functions only.

Every document gets a hash-random key. Its leading digits are the range it is sorted into within its
source, so that running sums of word counts need no source in one task: sums of whole ranges come first,
then the running sum within a range. A source is cut at its exact budget of words; where the budget
exceeds the source, whole epochs come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from apertura.llm.shared import word_count

#: Weights of the sources in code-point order, repeating; how often a source may be repeated.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 7


def order_key(seed: int = SEED) -> Column:
    """A hash-random key, as text, of a document's id and text."""
    one = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), one(F.col("doc_id")), F.md5(F.coalesce(F.col("text"), F.lit("")))))


def source_key(source: Column) -> Column:
    """The source as a join key that is never null."""
    return F.when(source.isNull(), "n").otherwise(F.concat(F.lit("v"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """``__source, __has`` (a row for each source) with ``__weight`` and ``__target`` in words.

    The shares of all words by weight, none above ``most`` times its source; the excess goes to the others
    by weight until none is above. In order of that bound by weight, the bounded sources come first, so
    running sums find the level at which the others share what is left.
    """
    rank = F.row_number().over(Window.orderBy(F.substring("__source", 1, 1) == "n", "__source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    by_bound = Window.orderBy(F.col("__bound") / F.col("__weight"), "__source")
    before, rest = by_bound.rowsBetween(Window.unboundedPreceding, -1), by_bound.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (F.sum("__has").over(everything) - F.coalesce(F.sum("__bound").over(before), F.lit(0))) / F.sum("__weight").over(rest)
    return (
        sizes.withColumn("__weight", weight.cast("long"))
        .withColumn("__bound", F.col("__has") * most)
        .withColumn("__level", level)
        .withColumn("__free", F.col("__bound") / F.col("__weight") > F.col("__level"))
        .withColumn("__level", F.max(F.when(F.col("__free"), F.col("__level"))).over(everything))
        .select(
            "__source", "__has", "__weight",
            F.when(F.col("__free"), F.col("__level") * F.col("__weight")).otherwise(F.col("__bound").cast("double")).alias("__target"),
        )
    )


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken``, the words that the mix takes.

    The words of a source's documents add up to its target, rounded: one document of a source may be taken
    in part. A null or blank text has size 0 and is never taken; a null source is a source. Documents with
    the same id and text have the same key and follow each other in any order. Very long texts are counted
    whole. An empty table gives an empty result. Input columns with the names of the new ones are replaced,
    all others are kept. Sources, one row each, are ranked in one task.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    keyed = docs.select("doc_id", word_count(F.col("text")).alias("size"), source_key(F.col("source")).alias("__source"), order_key(seed).alias("__key"), F.struct(*names).alias("__row"))
    keyed = keyed.withColumn("__range", F.substring("__key", 1, 3))
    ranges = keyed.groupBy("__source", "__range").agg(F.sum("size").alias("__sum"))
    aim = targets(ranges.groupBy("__source").agg(F.sum("__sum").alias("__has")), weights, most)
    before = Window.partitionBy("__source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0))).join(aim, "__source").drop("__sum")
    within = Window.partitionBy("__source", "__range").orderBy("__key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    budget = F.floor(F.col("__target") + 0.5)
    epochs = F.when(F.col("__has") > 0, F.floor(budget / F.col("__has"))).otherwise(0)
    left = budget - epochs * F.col("__has") - (F.col("__before") + F.sum("size").over(within) - F.col("size"))
    taken = epochs * F.col("size") + F.least(F.greatest(left, F.lit(0)), F.col("size"))
    whole = keyed.join(offsets, ["__source", "__range"]).withColumn("__taken", taken.cast("long"))
    return whole.select(*[F.col("__row")[c].alias(c) for c in names], "size", F.col("__has").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"))


def mix_digest(docs: DataFrame) -> DataFrame:
    return mixed(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: a document once for each epoch, begun ones whole."""
    names = docs.columns
    packed = docs.select("doc_id", "text", "source", F.struct(*names).alias("row"))
    copies = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    out = mixed(packed).select("row", F.explode(F.array_repeat(F.lit(1), copies)))
    return out.select(*[F.col("row")[c].alias(c) for c in names])


MIX_SQL = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
         md5('7:' || coalesce(cast(doc_id as varchar), '-') || ':' || md5(coalesce(text, ''))) as k
  from documents),
s as (
  select source, cast(sum(size) as bigint) as has,
         [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
  from d group by source),
l as (
  select *, 3 * has as bound,
         (sum(has) over () - coalesce(sum(3 * has) over (order by 3 * has / weight, source is null, source
            rows between unbounded preceding and 1 preceding), 0))
         / sum(weight) over (order by 3 * has / weight, source is null, source rows between current row and unbounded following) as level
  from s),
t as (
  select source, has, case when bound / weight > level
           then (max(case when bound / weight > level then level end) over ()) * weight
           else cast(bound as double) end as target
  from l),
r as (
  select d.doc_id, d.size, t.has, t.target, cast(floor(t.target + 0.5) as bigint) as budget,
         cast(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows unbounded preceding) as bigint) - d.size as before
  from d join t on d.source is not distinct from t.source)
select doc_id, cast(size as bigint) as size, has as source_size, target,
       cast(case when has = 0 then 0 else
         (budget // has) * size + least(greatest(budget - (budget // has) * has - before, 0), size) end as bigint) as taken
from r
"""
