"""Mixing sources to target weights by temperature.

A source's weight is its token share to a power, normalised. The exponent is bisected until the weights' entropy
reaches a target, or until no source is repeated more than a limit allows. The weights are then realised within a token
budget: a source's quota gives whole epochs of all its documents and a part of one more, which takes documents in the
order of a hash (a fixed permutation of the source) until the quota is met.

The permutation is never sorted as a whole. Its blocks, equal parts of the hash range, are summed; the prefix sums tell
in which block the quota is met, and only that block is ordered. So each source comes down to the epochs, a cut-off hash and
how many of the rows with just that hash are drawn; documents are then drawn without a shuffle, each copy with a place in the
mix's permutation. Rows that repeat id and text share their hash; where the cut-off falls on them, they are numbered task by task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ampline.llm.common import Stored, stored_alone, table

#: Blocks of a source's permutation, and of the mix.
BLOCKS = 1 << 12
#: Interior exponents tried in one pass over the sources: four bisections at once.
SECTIONS = 16
#: Sources up to which their table is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 100_000


@dataclass(frozen=True)
class MixConfig:
    #: Entropy to reach, as a share of the greatest possible (the logarithm of the number of sources).
    entropy: float = 0.97
    #: Times that a source may be repeated within the budget.
    repeats: float = 3.0
    #: Tokens to draw, as a multiple of all tokens.
    budget: float = 1.0
    seed: int = 7
    #: Passes over the sources; each narrows the exponent's range 16 times.
    passes: int = 6


def with_tokens(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """``docs`` with ampline_tokens (words), ampline_source and ampline_hash; null text has no tokens, null source is one source."""
    words = F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long")
    place = F.xxhash64(F.lit(config.seed), "doc_id", "text")
    return docs.withColumns({"ampline_tokens": words, "ampline_source": F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))), "ampline_hash": place})


def _block(at: str) -> F.Column:
    """The block of a 64-bit hash."""
    return F.shiftright(F.col(at), 52) + BLOCKS // 2


def exponent(sources: DataFrame, total: int, config: MixConfig) -> float:
    """The exponent in [0, 1] nearest to 1 with the target entropy, or the least one that keeps to the repeat limit if that is greater."""
    share = F.col("tokens") / F.lit(total)

    def measures(a: float) -> list:
        power = F.pow(share, F.lit(a))
        return [F.sum(power), F.sum(power * F.log(share)) * a, F.max(power / F.col("tokens"))]

    def search(good) -> float:
        """The greatest exponent of those below which ``good`` holds, by sections of [0, 1]."""
        low, high = 0.0, 1.0
        for _ in range(config.passes):
            grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
            row = sources.agg(F.count("*"), *[x.alias(f"m{i}") for i, x in enumerate(y for a in grid for y in measures(a))]).first()
            n, values = row[0], row[1:]
            holds = [good(n, *values[3 * k : 3 * k + 3]) for k in range(SECTIONS + 1)]
            if all(holds):
                return high
            if not holds[0]:
                return low
            first = holds.index(False)
            low, high = grid[first - 1], grid[first]
        return low

    import math

    # entropy falls and the largest number of repeats falls as the exponent grows
    by_entropy = search(lambda n, z, zlog, most: math.log(z) - zlog / z >= config.entropy * math.log(n) - 1e-12)
    by_repeats = search(lambda n, z, zlog, most: config.budget * total * most / z > config.repeats)
    return max(by_entropy, by_repeats + (1 / SECTIONS**config.passes if by_repeats > 0 else 0.0))


def mix_plan(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """A row per source with tokens: mix_source, tokens, weight, quota, epochs, cutoff (null: no part of an epoch), at_cutoff (rows drawn of those at the cut-off)."""
    return stored_alone(lambda: _plan(docs, config), "mix-plan").df


def _plan(docs: DataFrame, config: MixConfig) -> DataFrame:
    rows = with_tokens(docs.select("doc_id", "text", "source"), config)
    parts = rows.select(F.col("ampline_source").alias("mix_source"), F.col("ampline_tokens").alias("mix_tokens"), F.col("ampline_hash").alias("mix_hash")).withColumn("block", _block("mix_hash"))
    light = Stored(parts, "mix-rows").df
    blocks = Stored(light.groupBy("mix_source", "block").agg(F.sum("mix_tokens").alias("tokens")), "mix-blocks").df
    sources = Stored(blocks.groupBy("mix_source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0"), "mix-sources").df
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return sources.selectExpr("mix_source", "tokens", "0D weight", "0L quota", "0L epochs", "cast(null as long) cutoff", "0L at_cutoff")
    a = exponent(sources, total, config)
    power = F.pow(F.col("tokens") / F.lit(total), F.lit(a))
    z = sources.agg(F.sum(power)).first()[0]
    weighted = sources.withColumn("weight", power / F.lit(z)).withColumn("quota", F.floor(F.col("weight") * F.lit(config.budget * total)).cast("long"))
    epochs = Stored(weighted.withColumn("epochs", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens")), "mix-weights").df

    up_to = Window.partitionBy("mix_source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = blocks.withColumn("through", F.sum("tokens").over(up_to))
    met = epochs.where("rest > 0").join(summed, "mix_source").where(summed.through >= F.col("rest")).groupBy("mix_source").agg(
        F.min_by(F.struct("block", (F.col("rest") - F.col("through") + summed.tokens).alias("left")), "block").alias("at")
    )
    last = Stored(met.select("mix_source", "at.block", "at.left"), "mix-last").df
    # rows of one hash repeat each other and have the same tokens; they are one row here
    inside = light.join(last, ["mix_source", "block"]).groupBy("mix_source", "left", "mix_hash").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("rows"))
    before = Window.partitionBy("mix_source").orderBy("mix_hash").rowsBetween(Window.unboundedPreceding, -1)
    within = inside.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0))).where("before < left")
    some = F.expr("least(rows, ((left - before) * rows + tokens - 1) div tokens)")
    cut = within.where("tokens > 0").groupBy("mix_source").agg(F.max_by(F.struct(F.col("mix_hash").alias("cutoff"), some.alias("at_cutoff")), "mix_hash").alias("at"))
    return epochs.join(cut, "mix_source", "left").select("mix_source", "tokens", "weight", "quota", "epochs", "at.cutoff", F.coalesce("at.at_cutoff", F.lit(0)).alias("at_cutoff"))


#: What ``draw`` adds to each row, and what ``mix`` calls it.
DRAWN = {"ampline_tokens": "mix_tokens", "ampline_epoch": "mix_epoch", "ampline_block": "mix_block", "ampline_place": "mix_place"}


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ampline_nth, from 1 within ampline_source: by task that stored them, and in a task by their order there."""
    kept = Stored(rows.withColumn("ampline_nth", F.monotonically_increasing_id()), "mix-ties").df
    task = F.shiftright("ampline_nth", 33)
    counts = kept.groupBy("ampline_source", task.alias("ampline_task")).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("ampline_source").orderBy("ampline_task").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("ampline_source").alias("ampline_s"), F.col("ampline_task").alias("ampline_t"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ampline_before"))
    own = F.row_number().over(Window.partitionBy("ampline_source", task).orderBy("ampline_nth"))
    ranked = kept.withColumn("ampline_own", own).join(before, (F.col("ampline_source") == F.col("ampline_s")) & (task == F.col("ampline_t")))
    return ranked.withColumn("ampline_nth", F.col("ampline_before") + F.col("ampline_own")).drop("ampline_s", "ampline_t", "ampline_before", "ampline_own")


def draw(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """As ``mix``; what it adds has private names, so that no column of ``docs`` is replaced."""
    plan = mix_plan(docs, config).select(F.col("mix_source").alias("ampline_of"), "epochs", "cutoff", "at_cutoff")
    few = plan.count() <= BROADCAST_SOURCES
    plan = plan.select("ampline_of", F.struct("epochs", "cutoff", "at_cutoff").alias("ampline_plan"))
    rows = with_tokens(docs, config)
    drawn = rows.join(F.broadcast(plan) if few else plan, F.col("ampline_source") == F.col("ampline_of"))
    at = F.coalesce(F.col("ampline_hash") == F.col("ampline_plan.cutoff"), F.lit(False))
    once = F.when(F.col("ampline_hash") < F.col("ampline_plan.cutoff"), 1).otherwise(0)
    held = _numbered(drawn.where(at))
    tied = held.withColumn("ampline_times", F.col("ampline_plan.epochs") + F.when(F.col("ampline_nth") <= F.col("ampline_plan.at_cutoff"), 1).otherwise(0)).drop("ampline_nth")
    drawn = drawn.where(~at).withColumn("ampline_times", F.col("ampline_plan.epochs") + once).unionByName(tied)
    copies = drawn.where("ampline_times > 0").withColumn("ampline_epoch", F.explode(F.expr("sequence(0L, ampline_times - 1)")))
    placed = copies.withColumn("ampline_place", F.xxhash64(F.lit(config.seed + 1), "ampline_hash", "ampline_epoch")).withColumn("ampline_block", _block("ampline_place"))
    return placed.select(*docs.columns, *DRAWN)


def mix(docs: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The drawn rows: each row of ``docs`` as often as the plan says, with mix_tokens, mix_epoch, mix_block and mix_place.

    mix_block and then mix_place order the mix: every block holds a like share of each source. A source's tokens exceed
    its quota by less than one document; rows that repeat each other are drawn one by one. Rows of a source
    without tokens are not drawn. A null source is a source of its own; a null doc_id is an id; an empty table gives no
    rows. Further columns stay; one that is called as one of the four is replaced.
    """
    return draw(docs.drop(*DRAWN.values()), config).withColumnsRenamed(DRAWN)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")
