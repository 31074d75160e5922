"""Mixing sources to target weights by repeating documents.

Words are summed for each source, targets follow from the sources' weights, and a source's
repetition rate is target / size. A document is emitted floor(rate) times and once more if its
hashed draw falls below the rate's fraction. Draws come in SEEDS seeded families; each source
takes the seed whose copies come nearest to its target, which keeps the few very long documents
of a source from carrying it away. All draws are functions of the id, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basalt.llm.common import saved

SEEDS = 64
PRIME = 2147483647
#: More sources than this are joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def multipliers() -> list[int]:
    """The multiplier of each seed's draws: powers of a generator modulo PRIME."""
    return [pow(48271, k + 1, PRIME) for k in range(SEEDS)]


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(id_: Column, seed: Column) -> Column:
    """A number in [0, 1) for an id and a seed."""
    h = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("long")
    factor = F.element_at(F.array(*map(F.lit, map(int, multipliers()))).cast("array<long>"), (seed + 1).cast("int"))
    return F.pmod((F.pmod(h, F.lit(PRIME - 1)) + 1) * factor, F.lit(PRIME)).cast("double") / float(PRIME)


def with_sources(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """rows (with a column `source_`) joined to their sources, nulls to the null source."""
    sources = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return rows.join(sources, rows["source_"].eqNullSafe(sources["s_source"])).drop("s_source")


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """s_source, source_size, target: what each source gives to the mix, from rows source_, size_.

    Weights repeat over the sources in order of code point, null last. A source gives at most
    `most` times its size; sources in order of size by weight reach that limit first, so running
    sums tell who does, and the others share what is left by weight. These windows read one row a
    source.
    """
    per = sizes.groupBy("source_").agg(F.sum("size_").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source_").asc_nulls_last())) - 1
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    order = Window.orderBy((F.col("source_size") * most / F.col("w")), F.col("source_").asc_nulls_last())
    before = F.coalesce(F.sum(F.col("source_size") * most).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(whole) - before) / rest)
    per = per.withColumn("full", F.col("source_size") * most / F.col("w") < F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    target = F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(level * F.col("w"))
    return per.select(F.col("source_").alias("s_source"), "source_size", target.alias("target"))


def mix_plan(sizes: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """s_source, source_size, target, copies, part, seed for each source; and how many sources.
    sizes: id_, source_, size_."""
    per = targets(sizes, weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = saved(per.withColumn("rate", rate).select("s_source", "source_size", "target", F.floor("rate").alias("copies"), (F.col("rate") - F.floor("rate")).alias("part")), "mix-targets")
    n = per.count()
    drawn = with_sources(sizes, per, n).select("source_", "id_", "size_", "part", "copies", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("seed"))
    extra = F.sum(F.when(draw(F.col("id_"), F.col("seed")) < F.col("part"), F.col("size_")).otherwise(0))
    per_seed = drawn.groupBy("source_", "seed", "copies", "source_size", "target").agg(extra.alias("extra"))
    off = F.abs(F.col("copies") * F.col("source_size") + F.col("extra") - F.col("target"))
    chosen = per_seed.groupBy("source_").agg(F.min(F.struct(off.alias("off"), "seed"))["seed"].alias("seed"))
    plan = per.join(chosen, per["s_source"].eqNullSafe(chosen["source_"])).select("s_source", "source_size", "target", "copies", "part", "seed")
    return saved(plan, "mix-plan"), n


def narrow(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id_"), F.col(source_col).alias("source_"), size_of(F.col(text_col)).alias("size_"))


def repeats(id_: Column) -> Column:
    return F.col("copies") + F.when(draw(id_, F.col("seed")) < F.col("part"), 1).otherwise(0)


def taken(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each input row: the id, its size in words, source_size, target (its source's) and
    taken (the words the mix takes of it, repeats counted).

    Null texts have size 0; a null source is a source; null ids share one draw and repeated rows
    draw alike; an empty table gives an empty one; other columns are ignored. Sources without words
    have target 0. Targets add up to all sizes unless limits forbid.
    """
    sizes = saved(narrow(docs, id_col, text_col, source_col), "sizes")
    plan, n = mix_plan(sizes, weights, most)
    out = with_sources(sizes, plan, n)
    return out.select(F.col("id_").alias(id_col), F.col("size_").alias("size"), "source_size", "target", (F.col("size_") * repeats(F.col("id_"))).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as the mix takes it. Cases as in taken()."""
    sizes = saved(narrow(docs, id_col, text_col, source_col), "sizes")
    plan, n = mix_plan(sizes, weights, most)
    plan = plan.select("s_source", F.struct("copies", "part", "seed").alias("plan_"))
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"), F.col(source_col).alias("source_"), F.col(id_col).alias("id_"))
    joined = with_sources(named, plan, n).select("row_", "id_", "plan_.*")
    copies = joined.select("row_", F.explode(F.array_repeat(F.lit(0), repeats(F.col("id_")).cast("int"))))
    return copies.select("row_.*")


SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h
  FROM documents),
per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::DOUBLE AS w
  FROM sizes GROUP BY source),
running AS (
  SELECT *, ((sum(source_size) OVER ())::BIGINT
             - coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / w, source ASC NULLS LAST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
            / sum(w) OVER (ORDER BY source_size * 3 / w, source ASC NULLS LAST
                           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM per),
capped AS (SELECT *, source_size * 3 / w < level AS is_full FROM running),
targets AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN (source_size * 3)::DOUBLE
              ELSE max(CASE WHEN NOT is_full THEN level END) OVER () * w END AS target
  FROM capped),
rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate FROM targets),
parts AS (SELECT *, floor(rate)::BIGINT AS copies, rate - floor(rate) AS part FROM rates),
factors AS (
  SELECT unnest({multipliers()}) AS factor, unnest(range({SEEDS})) AS seed),
draws AS (
  SELECT s.doc_id, s.source, s.size, f.seed,
         CASE WHEN (((s.h % {PRIME - 1} + 1) * f.factor) % {PRIME})::DOUBLE / {PRIME}.0::DOUBLE < p.part THEN 1 ELSE 0 END AS one_more
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source, factors f),
sums AS (
  SELECT d.source, d.seed, abs(p.copies * p.source_size + sum(d.size * d.one_more)::BIGINT - p.target) AS off
  FROM draws d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
  GROUP BY d.source, d.seed, p.copies, p.source_size, p.target),
chosen AS (SELECT source, seed FROM sums QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1)
SELECT d.doc_id, d.size, p.source_size, p.target, (d.size * (p.copies + d.one_more))::BIGINT AS taken
FROM draws d JOIN chosen c ON d.source IS NOT DISTINCT FROM c.source AND d.seed = c.seed
JOIN parts p ON d.source IS NOT DISTINCT FROM p.source
"""
