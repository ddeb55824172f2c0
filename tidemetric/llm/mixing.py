"""Mixing sources to target weights by Efraimidis-Spirakis sampling, JVM-side only.

Every document gets the exponential key ``-ln(u) / w`` (u from a hash of its id, w its
quality weight): the documents with the smallest keys are a weighted sample without
replacement. Per source, complete epochs come first; the rest of the token budget is
filled in key order by prefix sums, and the document at the edge gives the words that
are left. Prefix sums run in two levels: rows are dealt by (source, key) into ranges of equal
numbers of rows, whatever the weights are; the few range totals are accumulated, and only
rows of one source and range meet in a task. Rows of one key (ids that are null or repeat)
are told apart by their size, a hash of their text and last a row number, so they spread
over ranges too. Reruns agree, as nothing is random: rows that differ in their row number
alone are exact copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemetric.llm.common import cut, stored, table

WORD = r"[^\x20\x09-\x0D]+"
EPOCHS = 3
#: About how many rows one range holds, and so one task sorts.
ROWS_PER_RANGE = 100_000
# Source weights, repeating, and the symbols whose share lowers a document's quality weight.
WEIGHTS = (1, 2, 3)
SYMBOLS = "!|&%$#*"
LEAST_WEIGHT = 0.05


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """Falls from 1 to 0.05 as symbols reach a fifth of the text; 1 for null and empty texts."""
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1 - 5.0 * F.try_divide(symbols, F.length(text))), F.lit(1.0))


def exponential_key(doc_id: Column, weight: Column) -> Column:
    u = (F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.ln(u) / weight


def source_targets(sizes: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Targets per source from ``nul, src, source_size``, one row a source.

    Targets share the sum of all sizes by weight and stop at ``epochs`` times their own
    source's size; the excess is shared again. That is a water level: the target is
    ``least(cap, level * weight)``, and with sources in order of cap / weight the level is
    the largest of (sum - caps before) / (weights from here on).
    """
    order = Window.orderBy("nul", "src")
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights)) + 1)
    named = sizes.select("*", weight.alias("w"), (F.col("source_size") * epochs).cast("double").alias("cap"))
    rising = Window.orderBy(F.col("cap") / F.col("w"), "nul", "src")
    level = named.select(
        "*",
        F.sum("source_size").over(Window.partitionBy()).alias("total"),
        F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("caps"),
        F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("rest"),
    )
    top = F.max((F.col("total") - F.col("caps")) / F.col("rest")).over(Window.partitionBy())
    return level.select("nul", "src", "source_size", F.round(F.least(F.col("cap"), top * F.col("w")), 6).alias("target"))


ORDER = ("key", "doc_id", "size", "tie", "row")


def key_ranges(sized: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``sized`` with ``range``: rows in order of source and ``ORDER``, cut into ranges of about equal rows.

    Spark's range partitioning takes its bounds from the data, so a range does not grow
    with the share of a source, a weight or an id.
    """
    ranges = max(1, -(-sized.count() // rows_per_range))
    return cut(sized.repartitionByRange(ranges, "nul", "src", *ORDER).withColumn("range", F.spark_partition_id()))


def mix_sources(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, rows_per_range: int = ROWS_PER_RANGE, keep: tuple[str, ...] = (), quality: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) and the columns ``keep`` for every row of ``docs``.

    ``quality`` is the documents' weight, above 0; without it, ``quality_weight`` of the
    text. A null text has size 0 and a null source is a source of its own, the last. Rows
    that repeat a doc_id, or have none, count each and stand next to each other in key
    order. An empty table gives no rows; sources of size 0 take nothing. A text of any
    length is one row of a few numbers here.
    """
    text = F.col("text")
    weight = quality_weight(text) if quality is None else quality.cast("double")
    sized = cut(
        docs.select(
            "doc_id",
            F.col("source").isNull().alias("nul"),
            F.coalesce(F.col("source"), F.lit("")).alias("src"),
            word_count(text).alias("size"),
            exponential_key(F.col("doc_id"), weight).alias("key"),
            F.xxhash64(text).alias("tie"),
            F.monotonically_increasing_id().alias("row"),
            *keep,
        )
    )
    sources = cut(sized.groupBy("nul", "src").agg(F.sum("size").alias("source_size")))
    target = source_targets(sources, weights, epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    complete = F.coalesce(F.try_divide(budget, F.col("source_size")).cast("long"), F.lit(0)).cast("long")
    plan = target.select("nul", "src", "source_size", "target", complete.alias("complete"), (budget - complete * F.col("source_size")).alias("rest"))

    ranged = key_ranges(sized, rows_per_range)
    totals = ranged.groupBy("nul", "src", "range").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("nul", "src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("nul", "src", "range", F.coalesce(earlier, F.lit(0)).alias("start")).join(plan, ["nul", "src"])
    within = F.sum("size").over(Window.partitionBy("nul", "src", "range").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1))
    placed = ranged.withColumn("within", F.coalesce(within, F.lit(0))).join(starts, ["nul", "src", "range"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start") - F.col("within")))
    return placed.select(
        "doc_id",
        F.when(~F.col("nul"), F.col("src")).alias("source"),
        "size",
        "source_size",
        "target",
        (F.col("complete") * F.col("size") + part).cast("long").alias("taken"),
        *keep,
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes words of, with the words taken.

    Rows are told apart by a row number that is written with them, as ids may be null or
    repeat: each row has its own words and what the mix takes of it.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "mixing")
    mixed = mix_sources(rows, keep=("__row",)).filter("taken > 0").select("__row", F.col("size").alias("n_words"), "taken")
    return rows.join(mixed, "__row").drop("__row")


SQL = f"""
with sized as (
  select row_number() over () as r, doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
    -ln((('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint::double + 0.5) / {float(1 << 48)!r})
      / coalesce(case when length(text) > 0 then greatest({LEAST_WEIGHT}, 1 - 5.0 * (length(text) - length(translate(text, '{SYMBOLS}', ''))) / length(text)) end, 1.0) as key
  from documents),
sources as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as n from sized group by source),
named as (select source, source_size, (n % 3 + 1)::double as w, 3.0 * source_size as cap, sum(source_size) over () as total from sources),
level as (
  select *, (total - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as up from named),
targets as (select source, source_size, round(least(cap, (select max(up) from level) * w), 6)::double as target from level),
plan as (
  select *, floor(target + 0.5)::bigint as budget, case when source_size > 0 then floor(floor(target + 0.5) / source_size)::bigint else 0 end as complete from targets),
placed as (
  select s.doc_id, s.size, p.source_size, p.target, p.complete, p.budget - p.complete * p.source_size as rest,
    coalesce(sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size, s.r rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join plan p on s.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size, target, (complete * size + greatest(0, least(size, rest - before)))::bigint as taken from placed"""
