"""Mixing sources to target weights by temperature, with built-in functions only.

The weight of a source is its share of all tokens to the power of an exponent between 0 (all sources
alike) and 1 (as they are), normalised. The exponent is the largest at which the weights reach the target
entropy, but no smaller than the repetition limit allows: the source that would be repeated most often must
stay within it. Both are found by bisection on a grid of 2^-20.

The weights are realised by whole documents. The documents of a source are dealt into blocks by a hash, and
each epoch of each source puts the blocks in a random order of its own (``block_order``), until the source's budget
is met; the last block is cut at the document that meets it. Running sums go over blocks first and then inside the one block
that is cut, so a source that holds a third of all rows is spread over as many tasks as it has blocks.

Tokens are words parted by white space, and one for a text without words, so every row can be drawn; a null
text counts as one without words. Rows without a source form a source of their own. Rows that repeat with
their id stand next to each other in a block and are drawn separately. Extra columns are kept by ``mix`` and
not read by ``plan``. An empty table has no sources and gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.quality_rules import WORD
from shelfmark.session import materialize, scratch_path

#: Share of the largest possible entropy (all sources alike) that the mixture should reach.
TARGET_ENTROPY = 0.98
#: Times that a document may be drawn on average.
REPEAT_LIMIT = 2.0
#: Documents that a block holds on average.
BLOCK_ROWS = 4096
SEED = 20240101

#: Steps of the exponent: a power of the number of candidates that one pass tries.
STEPS = 1 << 20
_TRIED = 32


def tokens_of(text: Column) -> Column:
    return F.greatest(F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)), F.lit(1)).cast("long")


def source_sizes(rows: DataFrame) -> DataFrame:
    """``source, n_docs, n_tokens`` of rows with a source and tokens."""
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
    )


def _tried(sizes: DataFrame, exponents: list[int], total: int) -> dict[int, tuple[float, float]]:
    """For each exponent ``k / STEPS``: the entropy of the weights, and how often the most repeated
    source is drawn while the least repeated one is drawn once. One pass over the sources."""
    k = F.explode(F.array(*(F.lit(x) for x in exponents)))
    power = F.pow(F.col("n_tokens") / F.lit(float(total)), F.col("k") / F.lit(float(STEPS)))
    found = (
        sizes.select("n_tokens", k.alias("k"))
        .select("k", power.alias("p"), (power / F.col("n_tokens")).alias("pull"))
        .groupBy("k")
        .agg(
            (F.log(F.sum("p")) - F.sum(F.col("p") * F.log("p")) / F.sum("p")).alias("entropy"),
            (F.max("pull") / F.min("pull")).alias("repeats"),
        )
    )
    return {r["k"]: (r["entropy"], r["repeats"]) for r in found.collect()}


def exponent(sizes: DataFrame, target_entropy: float, repeat_limit: float) -> int:
    """The exponent in steps of ``1 / STEPS``.

    The largest step whose entropy is enough, and the smallest whose repetition is within the limit;
    the larger of the two. Both bounds fall together, each pass cutting their ranges into 32 parts.
    """
    told = sizes.agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()[0]
    if not told["n"]:
        return STEPS
    enough = target_entropy * math.log(told["n"]) - 1e-12
    spread_at, repeated_at, width = 0, 0, STEPS
    start = _tried(sizes, [0], told["t"])[0]
    too_often = start[1] > repeat_limit
    while width > 1:
        width //= _TRIED
        grid = [
            low + i * width
            for low in {spread_at, repeated_at}
            for i in range(1, _TRIED + 1)
            if low + i * width <= STEPS
        ]
        found = _tried(sizes, sorted(set(grid)), told["t"])
        last = spread_at + _TRIED * width
        spread_at = max([spread_at, *(k for k, v in found.items() if k <= last and v[0] >= enough)])
        last = repeated_at + _TRIED * width
        over = [k for k, v in found.items() if k <= last and v[1] > repeat_limit]
        repeated_at = max([repeated_at, *over]) if too_often else 0
    return max(spread_at, repeated_at + 1 if too_often else 0)


def _keys(docs: DataFrame, seed: int) -> DataFrame:
    """Own columns of ``docs``: tokens, and a hash that deals and orders the rows of a source."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.withColumn("__tokens", tokens_of(F.col("text"))).withColumn("__key", key)


def _block(key: Column, n_blocks: Column) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("long"), n_blocks)


def block_order(source: Column, epoch: Column, block: Column, seed: int) -> Column:
    """What the blocks of a source are sorted by in an epoch: a permutation of its own for each."""
    source = F.coalesce(source.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), source, epoch.cast("string"), block.cast("string")).cast("binary"))


def decisions(
    rows: DataFrame, target_entropy: float, repeat_limit: float, budget: int | None, seed: int
) -> DataFrame:
    """``source, block, n_blocks, epochs, taken, cut, epoch, start``: what holds for the rows of each block.

    ``rows`` has source, n_tokens and key. Every row is drawn ``epochs`` times, and once more if its
    block is ``taken`` and its key not above ``cut`` (null: the whole block). ``epoch`` is the last that the block
    is drawn in, from 0, and ``start`` the number of the source's tokens before it there, earlier epochs included;
    both are null for a block that is not drawn.
    """
    sizes = materialize(source_sizes(rows))
    steps = exponent(sizes, target_entropy, repeat_limit)
    told = sizes.agg(F.sum("n_tokens").alias("t")).collect()[0]["t"] or 1
    power = F.pow(F.col("n_tokens") / F.lit(float(told)), F.lit(steps / STEPS))
    weights = sizes.withColumn("power", power)
    sums = weights.agg(
        F.sum("power").alias("all"), F.max(F.col("n_tokens") / F.col("power")).alias("once")
    ).collect()[0]
    # drawing each source once at least takes the largest of tokens / weight
    scale = sums["once"] if budget is None else float(budget) / (sums["all"] or 1.0)
    plan = weights.select(
        "source",
        F.ceil(F.col("n_docs") / F.lit(BLOCK_ROWS)).alias("n_blocks"),
        F.col("n_tokens").alias("of"),
        F.floor(F.col("power") * F.lit(scale) + 0.5).cast("long").alias("budget"),
    ).select(
        "source", "n_blocks", "budget",
        "of", F.expr("budget div of").alias("epochs"), F.expr("budget % of").alias("rest"),
    )
    placed = rows.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("block", _block(F.col("key"), F.col("n_blocks")))
    blocks = placed.groupBy("source", "block", "n_blocks", "of", "epochs", "rest").agg(
        F.sum("n_tokens").alias("in_block")
    )

    def before(epoch: Column) -> Column:
        order = block_order(F.col("source"), epoch, F.col("block"), seed)
        earlier = Window.partitionBy("source").orderBy(order, "block").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("in_block").over(earlier), F.lit(0))

    # the epoch that the budget cuts, and the whole one before it
    blocks = blocks.withColumn("before", before(F.col("epochs"))).withColumn("whole", before(F.col("epochs") - 1))
    blocks = blocks.withColumn("taken", F.col("before") < F.col("rest")).withColumn(
        "is_cut", F.col("taken") & (F.col("before") + F.col("in_block") > F.col("rest"))
    )
    last = F.when(F.col("taken"), F.col("epochs")).when(F.col("epochs") > 0, F.col("epochs") - 1)
    start = last * F.col("of") + F.when(F.col("taken"), F.col("before")).otherwise(F.col("whole"))
    blocks = materialize(blocks.withColumn("epoch", last).withColumn("start", start))
    cut = blocks.filter("is_cut").select(
        F.col("source").alias("s"), F.col("block").alias("b"), (F.col("rest") - F.col("before")).alias("left")
    )
    inside = placed.join(cut, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")))
    running = Window.partitionBy("source", "block").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    # the row that meets the budget is the last one taken
    cuts = (
        inside.withColumn("before", F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
        .filter(F.col("before") < F.col("left"))
        .groupBy(F.col("source").alias("s"), F.col("block").alias("b"))
        .agg(F.max("key").alias("cut"))
    )
    return blocks.join(
        cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left"
    ).select("source", "block", "n_blocks", "epochs", "taken", "cut", "epoch", "start")


def draws(
    docs: DataFrame, into: str = "draws", target_entropy: float = TARGET_ENTROPY,
    repeat_limit: float = REPEAT_LIMIT, budget: int | None = None, seed: int = SEED,
) -> DataFrame:
    """``docs`` (with doc_id, text and source) and how often each row is drawn.

    Without a budget in tokens, the smallest one is used under which every document is drawn at least
    once. With a smaller one, documents of sources over their budget are drawn less often or not at all. Next to
    ``into`` come its tokens, block, and the block's ``epoch`` and ``start`` as in ``decisions``, under names that begin
    with ``into``; columns of ``docs`` with these names are replaced.
    Runs small jobs at once: those that find the exponent and the blocks to cut.
    """
    spark = docs.sparkSession
    made = {f"__{c}": f"{into}_{c}" for c in ("tokens", "at", "epoch", "start")} | {"__at": f"{into}_block"}
    columns = [c for c in docs.columns if c not in (into, *made.values())]
    keyed = _keys(docs, seed)
    path = scratch_path(spark, "mixing")
    keyed.select("source", F.col("__tokens").alias("n_tokens"), F.col("__key").alias("key")).write.parquet(path)
    told = materialize(decisions(spark.read.parquet(path), target_entropy, repeat_limit, budget, seed))
    blocks = told.select(F.col("source").alias("__s"), *(F.col(c).alias(f"__{c}") for c in told.columns[1:]))
    sources = blocks.select("__s", "__n_blocks").distinct()
    placed = keyed.join(
        sources.select(F.col("__s").alias("__of"), F.col("__n_blocks").alias("__n")),
        F.col("source").eqNullSafe(F.col("__of")),
    ).withColumn("__at", _block(F.col("__key"), F.col("__n")))
    joined = placed.join(
        blocks, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__at") == F.col("__block"))
    )
    more = F.col("__taken") & (F.col("__cut").isNull() | (F.col("__key") <= F.col("__cut")))
    return joined.select(
        *columns,
        (F.col("__epochs") + F.when(more, 1).otherwise(0)).cast("long").alias(into),
        *made,
    ).withColumnsRenamed(made)


def mix(docs: DataFrame, epoch: str | None = None, order: str | None = None, **options) -> DataFrame:
    """The mixture: each row as often as it is drawn, with the columns of ``docs``.

    ``epoch`` and ``order`` name columns to add: the epoch of a copy, from 0, and what its block is sorted by there.
    Sorted by source, epoch and order, the copies stand as the permutations have them.
    """
    drawn = draws(docs, "__draws", **options).filter("__draws > 0")
    copies = drawn.withColumn("__copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__draws") - 1)))
    place = block_order(F.col("source"), F.col("__copy"), F.col("__draws_block"), options.get("seed", SEED))
    added = {name: c.alias(name) for name, c in ((epoch, F.col("__copy")), (order, place)) if name}
    return copies.select(*[c for c in docs.columns if c not in added], *added.values())
