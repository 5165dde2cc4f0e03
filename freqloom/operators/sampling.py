"""Random samples of spectra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freqloom.functions.scalar import hypergeometric_draw_text, uniform_text
from freqloom.operators.ordering import with_global_index
from freqloom.operators.spectrum import Spectrum

# Children of a node when SNPs are dealt to batches.
SPLIT = 64


def bootstrap_draws(spectrum: Spectrum, n_replicates: int, seed: int = 0, uniform: str | None = None) -> DataFrame:
    """``(replicate, slot, block)``: as many blocks as there are, drawn with replacement, for each replicate.

    Blocks are given ordinals 0..n-1; slot k of a replicate takes the block whose ordinal its hash selects. ``uniform`` may
    give the SQL text of another number in [0, 1) over the columns replicate and slot.
    """
    uniform = uniform or uniform_text("replicate", "slot", str(int(seed)))
    labels = spectrum.renumbered_labels()
    slots = labels.selectExpr("ordinal as slot", "n_blocks", f"explode(sequence(0L, {n_replicates - 1}L)) as replicate")
    drawn = slots.selectExpr(
        "replicate", "slot", f"bigint(floor({uniform} * n_blocks)) as ordinal"
    )
    return drawn.join(labels.select("ordinal", "block"), "ordinal").select("replicate", "slot", "block")


def bootstrap(spectrum: Spectrum, n_replicates: int, seed: int = 0) -> DataFrame:
    """``(replicate, slot, anc, der, cnt)``: every replicate's spectrum with its slots as blocks, in one job."""
    draws = bootstrap_draws(spectrum, n_replicates, seed)
    return draws.join(spectrum.df, "block").select("replicate", "slot", "anc", "der", "cnt")


def bootstrap_of_draws(spectrum: Spectrum, draws: DataFrame) -> DataFrame:
    """``(replicate, anc, der, cnt)`` for given ``draws(replicate, block)``, a row for each block drawn."""
    times = draws.groupBy("replicate", "block").agg(F.count(F.lit(1)).alias("times"))
    return times.join(spectrum.df, "block").groupBy("replicate", "anc", "der").agg(F.expr("sum(times * cnt)").alias("cnt"))


def bootstrap_totals(spectrum: Spectrum, n_replicates: int, seed: int = 0) -> DataFrame:
    """``(replicate, anc, der, cnt)``: replicates with their blocks combined.

    Draws are first counted per (replicate, block), so a block drawn often is joined once.
    """
    weights = bootstrap_draws(spectrum, n_replicates, seed).groupBy("replicate", "block").agg(
        F.count(F.lit(1)).alias("times")
    )
    joined = weights.join(spectrum.df, "block")
    return joined.groupBy("replicate", "anc", "der").agg(F.expr("sum(times * cnt)").alias("cnt"))


def _shares_text(total: str, colours: str, key: str, seed: int) -> str:
    """How many of ``total`` things drawn without replacement have each colour: an array as long as ``colours``."""
    draw = hypergeometric_draw_text("x.u", "x.size", "x.k", "x.n")
    facts = f"named_struct('u', {uniform_text(key, 'i', str(seed))}, 'size', v.size, 'k', element_at({colours}, i), 'n', v.n)"
    one = f"transform(transform(array({facts}), x -> named_struct('k', x.k, 'got', {draw})), y -> named_struct('size', v.size - y.k, 'n', v.n - y.got, 'out', array_append(v.out, y.got)))[0]"
    start = f"named_struct('size', aggregate({colours}, 0L, (t, c) -> t + c), 'n', {total}, 'out', cast(array() as array<bigint>))"
    return f"aggregate(sequence(1, size({colours})), {start}, (v, i) -> {one}, v -> v.out)"


def minibatches(spectrum: Spectrum, n_batches: int, seed: int = 0) -> DataFrame:
    """``(batch, anc, der, cnt)``: the SNPs, told apart, dealt at random into batches whose sizes differ by at most one.

    No row stands for a single SNP. Configurations are numbered and form a tree of SPLIT children a node; each node knows how
    many of its SNPs are in each batch, and deals them to its children by multivariate hypergeometric draws, which is what a
    shuffle of all SNPs does. From level to level a row is a node and its vector of batches, so that the last level has
    configurations times batches. Draws are hashes of node, batch and seed. Fractional counts are cut to whole SNPs.
    """
    counted = spectrum.combined().df.selectExpr("anc", "der", "bigint(cnt) as times").where("times > 0")
    leaves = with_global_index(counted, ["anc", "der"], ["anc", "der", "times"]).withColumnRenamed("row_index", "node")
    n_configs = (leaves.agg(F.max("node")).first()[0] or 0) + 1
    depth = 1
    while SPLIT**depth < n_configs:
        depth += 1
    whole = leaves.agg(F.coalesce(F.sum("times"), F.lit(0)).alias("n"))
    sizes = f"transform(sequence(0, {n_batches - 1}), b -> n div {n_batches} + if(b < n % {n_batches}, 1L, 0L))"
    nodes = whole.selectExpr("0L as node", f"{sizes} as shares")
    for level in range(depth - 1, -1, -1):
        children = leaves.groupBy((F.floor(F.col("node") / SPLIT**level)).alias("child")).agg(F.sum("times").alias("n"))
        # At most SPLIT children of a node come together.
        families = children.groupBy(F.floor(F.col("child") / SPLIT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "n"))).alias("children"))
        vector = _shares_text("c.n", "acc.rest", f"c.child, {level}", int(seed))
        step = (
            f"transform(array({vector}), z -> named_struct('rest', zip_with(acc.rest, z, (p, q) -> p - q),"
            " 'out', array_append(acc.out, named_struct('node', c.child, 'shares', z))))[0]"
        )
        start = "named_struct('rest', shares, 'out', cast(array() as array<struct<node: bigint, shares: array<bigint>>>))"
        nodes = families.join(nodes, "node").selectExpr(f"inline(aggregate(children, {start}, (acc, c) -> {step}, acc -> acc.out))")
    dealt = leaves.join(nodes, "node").selectExpr("anc", "der", "posexplode(shares) as (batch, share)").where("share > 0")
    return dealt.selectExpr("bigint(batch) as batch", "anc", "der", "double(share) as cnt")
