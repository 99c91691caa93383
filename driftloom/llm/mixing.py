"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. Its documents are expected ``target / source size`` times each: the whole part are
certain copies, the rest is an inclusion probability. Documents are ranked by the odds of a random number over the odds
of their inclusion, and one more copy is taken in that order until the source's target is met. The random number is a
hash of the document's id (of its text, where it has no id) and a seed, so a rerun or a lost executor changes nothing, and
documents without an id are drawn each on its own.

No source is ever ranked as a whole: ranks are cut into buckets, sums per bucket find the one where the target is
reached, and only the rows of that bucket are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.text import WORD, column
from driftloom.session import settle

#: Buckets of a source's ranks; only the one in which the target is reached is sorted.
BUCKETS = 4096
MOST_COPIES = 3
#: With ``by_size`` documents are favoured by size / (size + HALF_SIZE): short ones are less likely to get the extra copy.
HALF_SIZE = 100.0
WEIGHTS = (5, 2, 1)


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the key."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """Adds ``target`` to one row per source (``source``, ``source_size``).

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight. Sorted by size per weight, the
    sources that stop come first, so the shares of the others follow from running sums.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    by_limit = Window.orderBy((most * F.col("source_size")) / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    share = weighed.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum(most * F.col("source_size")).over(by_limit.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("stopped"),
        F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing)).alias("open_weight"),
    ).withColumn("free", most * F.col("source_size") * F.col("open_weight") >= (F.col("total") - F.col("stopped")) * F.col("weight"))
    first = Window.partitionBy()
    left = F.min(F.when(F.col("free"), F.struct("stopped", "open_weight"))).over(first)
    return share.withColumn("left", left).select(
        "source",
        "source_size",
        F.least(
            (most * F.col("source_size")).cast("double"),
            F.coalesce((F.col("total") - F.col("left.stopped")) * F.col("weight") / F.col("left.open_weight"), F.lit(0.0)),
        ).alias("target"),
    )


def measured(df: DataFrame, id_col: str, text_col: str, source_col: str, odds_col: str | None, by_size: bool, *more: Column) -> DataFrame:
    words = F.coalesce(F.regexp_count(column(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    given = F.coalesce(column(odds_col).cast("double"), F.lit(1.0)) if odds_col else F.lit(1.0)
    favour = given * words / (words + F.lit(HALF_SIZE)) if by_size else given
    draw = F.coalesce(column(id_col).cast("string"), F.md5(F.coalesce(column(text_col), F.lit(""))))
    return df.select(
        column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), words.alias("size"), favour.alias("favour"), draw.alias("draw"), *more
    )


def ranked(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Rows with their source's plan, their rank and its bucket; without a rank a document can't get an extra copy."""
    p = F.least(F.col("p"), F.lit(1 - 1e-12))
    u = uniform(F.col("draw"), seed)
    odds = u / (1 - u) / (p / (1 - p) * F.col("favour"))
    return (
        rows.join(plan, rows["source"].eqNullSafe(plan["source"]))
        .drop(plan["source"])
        .withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds))
        .withColumn("bucket", F.floor(F.col("rank") / (1 + F.col("rank")) * BUCKETS).cast("int"))
    )


def planned(rows: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """One row per source: target, certain copies, inclusion probability of one more, words left for it, and the bucket
    of ranks in which these are reached (null: the whole source fits) with the words of the buckets before it."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = (
        source_targets(sources, weights, most)
        .withColumn("certain", F.floor(share).cast("long"))
        .withColumn("p", share - F.col("certain"))
        .withColumn("wanted", F.col("target") - F.col("certain") * F.col("source_size"))
    )
    plan = settle(plan)
    sums = ranked(rows, plan, seed).filter("rank is not null").groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("wanted").alias("wanted"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")  # at most BUCKETS rows a source
    edges = (
        sums.withColumn("before", before)
        .filter((F.col("before") <= F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
        .groupBy(F.col("source").alias("of"))
        .agg(F.min("bucket").alias("edge"), F.min("before").alias("before"))
    )
    return settle(plan.join(edges, plan["source"].eqNullSafe(edges["of"]), "left").drop("of"))


def with_copies(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    placed = ranked(rows, plan, seed)
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", "draw")
    running = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    near = placed.filter(F.col("bucket") == F.col("edge")).withColumn("extra", (F.col("before") + running + F.col("size") / 2 <= F.col("wanted")).cast("long"))
    rest = placed.filter(~F.coalesce(F.col("bucket") == F.col("edge"), F.lit(False))).withColumn(
        "extra", F.when(F.col("rank").isNull(), 0).when(F.col("edge").isNull(), 1).otherwise((F.col("bucket") < F.col("edge")).cast("long")).cast("long")
    )
    copies = F.when(F.col("size") > 0, F.col("certain") + F.col("extra")).otherwise(0).cast("long")
    return rest.unionByName(near).withColumn("copies", copies)


def mix_sources(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1, odds_col: str | None = None, by_size: bool = False,
) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies`` and ``taken`` (words), one row for each input row.

    Documents of a source differ in their inclusion odds by ``odds_col`` (optional, positive; null counts as 1) and, with
    ``by_size``, by their size (``HALF_SIZE``); else they are equally likely. A null text has no words; null is a
    source of its own; documents without words get no copy. Rows of one id, and rows of one text without an id, have one random number. An empty table gives an empty result.
    """
    rows = settle(measured(df, id_col, text_col, source_col, odds_col, by_size))
    found = with_copies(rows, planned(rows, weights, most, seed), seed)
    return found.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1, odds_col: str | None = None, by_size: bool = False,
) -> DataFrame:
    """The rows of ``df``, each as often as ``mix_sources`` takes it. Texts stay where they are but for those at the edge."""
    columns = (id_col, text_col, source_col, odds_col, by_size)
    plan = planned(settle(measured(df, *columns)), weights, most, seed)
    whole = measured(df, *columns, F.struct(*[column(c) for c in df.columns]).alias("row"))
    taken = with_copies(whole, plan, seed).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return taken.select("row.*")


SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS name, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), w AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stopped,
    sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM s
), f AS (
  SELECT arg_min(stopped, stopped) AS stopped, arg_min(open_weight, stopped) AS open_weight FROM w
  WHERE 3 * source_size * open_weight >= (total - stopped) * weight
), t AS (
  SELECT w.source, source_size, least((3 * source_size)::DOUBLE, coalesce((total - f.stopped) * weight / f.open_weight, 0)) AS target FROM w LEFT JOIN f ON true
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS certain FROM t
), q AS (
  SELECT d.doc_id, d.size, d.name, p.*, CASE WHEN source_size > 0 THEN target / source_size - certain ELSE 0 END AS p,
    target - certain * source_size AS wanted,
    (('0x' || substr(md5('1:' || coalesce(d.doc_id::VARCHAR, d.name)), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), r AS (
  SELECT *, CASE WHEN p > 0 AND size > 0 THEN sum(CASE WHEN size > 0 THEN size ELSE 0 END) OVER (
      PARTITION BY source ORDER BY size = 0, u / (1 - u) / (least(p, 1 - 1e-12::DOUBLE) / (1 - least(p, 1 - 1e-12::DOUBLE)) * (size / (size + {HALF_SIZE}::DOUBLE))), doc_id, size, name ROWS UNBOUNDED PRECEDING
    ) - size + size / 2 <= wanted ELSE false END AS extra FROM q
)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN (certain + extra::BIGINT) * size ELSE 0 END)::BIGINT AS taken FROM r
"""
