"""Mixing sources by temperature, in DataFrame functions only.

A source with token share p gets the weight p^a / sum p^a. The exponent a in [0, 1] is bisected: the largest one
whose weights reach a target entropy (a share of the highest, that of equal weights), or, with a limit on repetition, the
smallest one under which no source is repeated more than so many times within the token budget. Weights times budget
are the sources' token budgets. Each source's documents are dealt into blocks by a hash; each pass over a source is a
new permutation of its blocks, and blocks are taken until the source's budget is met.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clearwell.llm.blocks import stored

#: Tokens of a block.
BLOCK_TOKENS = 4096
#: Halvings of the exponent's interval: SWEEPS times BITS.
SWEEPS, BITS = 5, 6
#: Pieces of a permutation within which running sums are taken.
PIECES = 4096


def token_count(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def _measure(shares: DataFrame, low: float, width: float, budget: float) -> list[tuple[int, float, float]]:
    """For the 2^BITS - 1 exponents inside (low, low + width): their number, entropy and most repeats. Summed in the engine."""
    steps = 2**BITS
    grid = shares.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps - 1))))
    grid = grid.withColumn("w", F.exp((F.lit(low) + F.col("i") * F.lit(width / steps)) * F.log("share")))
    sums = grid.groupBy("i").agg(
        F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.max(F.col("w") * F.lit(budget) / F.col("tokens")).alias("r"))
    return sorted((r.i, r.h, r.repeats) for r in sums.select("i", (F.log("z") - F.col("wl") / F.col("z")).alias("h"), (F.col("r") / F.col("z")).alias("repeats")).collect())


def temperature(shares: DataFrame, entropy_share: float | None, max_repeats: float | None, budget: float) -> float:
    """The exponent, bisected in sweeps: each sweep looks at the inner points of BITS halvings at once.

    Lower exponents are flatter: entropy rises and so does the repetition of small sources. The entropy target is met by
    the largest exponent that reaches it (1 if the shares themselves do); a repetition limit raises the exponent
    to the smallest that keeps it (1 if none does).
    """
    n, h, repeats = shares.agg(
        F.count("*"), -F.sum(F.col("share") * F.log("share")), F.max(F.lit(budget) * F.col("share") / F.col("tokens"))).first()
    if not n:
        return 1.0

    def bisect(fits) -> tuple[float, float]:
        """(low, high) around the place where ``fits`` turns from true to false as the exponent grows."""
        low, width = 0.0, 1.0
        for _ in range(SWEEPS):
            good = sum(fits(x) for x in _measure(shares, low, width, budget))
            low, width = low + good * width / 2**BITS, width / 2**BITS
        return low, low + width

    exponent = 1.0
    if entropy_share is not None and h < (target := log(n) * entropy_share):
        exponent = bisect(lambda x: x[1] >= target)[0]
    if max_repeats is not None:
        exponent = max(exponent, 1.0 if repeats > max_repeats else bisect(lambda x: x[2] > max_repeats)[1])
    return exponent




def _perm(*cols: Column | str) -> Column:
    """A place in a permutation, the same in any engine with md5."""
    return F.substring(F.md5(F.concat_ws("/", *cols)), 1, 15)


def mix_sources(
    docs: DataFrame, budget_tokens: int | None = None, entropy_share: float | None = 0.98, max_repeats: float | None = 4.0,
    block_tokens: int = BLOCK_TOKENS, seed: str = "mix",
) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) to the mixture's plan: a row for each document and pass in which it is taken.

    Columns: doc_id, source, n_tokens, weight (of the source), pass (from 0), block, place. ``place`` is the share of the
    source's budget that is spent before the block; read in its order, the mixture holds every source at its weight
    throughout. A block is taken in a pass if the budget is not yet met when its turn comes, so a source exceeds its budget by
    less than one block. The default budget is the number of tokens in ``docs``.

    A null source is a source of its own. Documents without tokens are in no block and so not in the plan. Documents with
    a null doc_id share a block of their source; repeated rows are taken as often as they stand there. Other columns
    are ignored; an empty table gives an empty plan. Jobs run when this is called.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       token_count(F.col("text").cast("string")).alias("n_tokens"))
    rows = stored(rows.where("n_tokens > 0").withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))), "mix-tokens")
    sizes = stored(rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens")), "mix-sizes")
    total = sizes.agg(F.sum("tokens")).first()[0] or 0
    budget = float(total if budget_tokens is None else budget_tokens)
    shares = stored(sizes.select("key", "tokens", (F.col("tokens") / F.lit(float(max(1, total)))).alias("share")).coalesce(1), "mix-shares")
    a = temperature(shares, entropy_share, max_repeats, budget)
    powered = shares.withColumn("w", F.exp(F.lit(a) * F.log("share")))
    z = powered.agg(F.sum("w")).first()[0] or 1.0
    budgets = powered.select(
        "key", "tokens", F.round(F.col("w") / F.lit(z), 9).alias("weight"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(float(block_tokens)))).cast("long").alias("n_blocks"))
    budgets = stored(budgets.withColumn("budget", F.ceil(F.round(F.col("weight") * F.lit(budget), 3)).cast("long")), "mix-budgets")

    # sources are few next to documents, yet not bounded: the join is left to Spark, which splits a hot source
    dealt = rows.join(budgets.select("key", "weight", "n_blocks"), "key")
    bucket = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long") % F.col("n_blocks")
    dealt = dealt.select("key", "doc_id", "source", "n_tokens", "weight", bucket.alias("block"))
    blocks = stored(dealt.groupBy("key", "block").agg(F.sum("n_tokens").alias("tokens")), "mix-blocks")
    taken = _taken(blocks, budgets, seed)
    return dealt.join(taken, ["key", "block"]).select(
        "doc_id", "source", "n_tokens", "weight", F.col("turn").alias("pass"), "block", "place")


def _taken(blocks: DataFrame, budgets: DataFrame, seed: str) -> DataFrame:
    """(key, block, turn, place) of the blocks taken. Whole passes are taken without any order; only the last one is summed up."""
    joined = blocks.join(budgets.select("key", "budget", F.col("tokens").alias("all_tokens")), "key")
    turns = joined.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(budget - 1) div all_tokens")))).where("budget > 0")
    turns = turns.withColumn("perm", _perm(F.lit(seed), "key", F.col("turn").cast("string"), F.col("block").cast("string")))
    # running sums in two steps: over the pieces of a permutation, then inside each piece
    turns = turns.withColumn("piece", F.conv(F.substring("perm", 1, 3), 16, 10).cast("int") % PIECES)
    piece = turns.groupBy("key", "turn", "piece").agg(F.sum("tokens").alias("piece_tokens"))
    over = Window.partitionBy("key", "turn").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    piece = piece.withColumn("before_piece", F.coalesce(F.sum("piece_tokens").over(over), F.lit(0))).drop("piece_tokens")
    inside = Window.partitionBy("key", "turn", "piece").orderBy("perm", "block").rowsBetween(Window.unboundedPreceding, -1)
    summed = turns.join(piece, ["key", "turn", "piece"]).withColumn("inner", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    before = F.col("turn") * F.col("all_tokens") + F.col("before_piece") + F.col("inner")
    return summed.withColumn("before", before).where("before < budget").select(
        "key", "block", "turn", F.round(F.col("before") / F.col("budget"), 9).alias("place"))
