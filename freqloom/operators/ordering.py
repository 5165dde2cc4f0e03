"""Exact global row positions without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freqloom.session import cut_lineage

# monotonically_increasing_id keeps the partition number above this many low bits.
ROW_BITS = 33
# Rows that one task sorts where their number is known, and those below which a further task isn't worth while.
PARTITION_ROWS, FEW_ROWS = 1 << 19, 1 << 14


def partitions_for(spark: SparkSession, rows: int) -> int:
    """How many partitions so many rows are dealt over: one for each core, more where that would be too many rows a task."""
    return max(1, -(-rows // PARTITION_ROWS), min(spark.sparkContext.defaultParallelism, rows // FEW_ROWS))


def with_global_index(df: DataFrame, order: Sequence[str | Column], keep: Sequence[str], rows: int | None = None) -> DataFrame:
    """``keep`` columns plus ``row_index`` (0-based rank by ``order``) and ``row_total``.

    One range shuffle spreads the rows evenly: a tie-breaker splits even a key that repeats without end, and full ties
    are interchangeable. The sorted partitions are fixed in the checkpoint folder, so partition numbers and row
    numbers can be read twice: once for one size per partition (a table of as many rows as there are partitions),
    once for the rows themselves. The per-partition offsets are joined back by broadcast. ``rows`` is the size of ``df`` where
    it is known: the number of partitions then follows it, so that what a task sorts, and what later steps hold of such a
    partition, doesn't grow with the data. Otherwise it is left to the session.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    names = [f"_key{i}" for i in range(len(order))]
    keyed = df.select(*keep, *[c.alias(n) for c, n in zip(order, names)], F.monotonically_increasing_id().alias("_tie"))
    parts = [] if rows is None else [partitions_for(df.sparkSession, rows)]
    ranged = keyed.repartitionByRange(*parts, *names, "_tie").sortWithinPartitions(*names, "_tie").select(*keep)
    fixed = cut_lineage(ranged)

    tagged = fixed.withColumn("_place", F.monotonically_increasing_id()).withColumn(
        "_part", F.shiftright("_place", ROW_BITS)
    )
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(everything).alias("row_total"),
    )
    low_bits = F.col("_place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return tagged.join(F.broadcast(offsets), "_part").select(
        *keep, (F.col("_offset") + low_bits).alias("row_index"), "row_total"
    )


# Bins per power of two of the position, at least; more blocks than half of it have more bins.
RESOLUTION = 256
# Positions nearer to zero than this power of two share a bin, those beyond FARTHEST too.
NEAREST, FARTHEST = -40, 1e300
# A histogram of up to this many rows (some 40 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000
# Bins to be read again are named one by one in the filter up to this many, beyond it by their joint range per chromosome.
NAMED_BINS = 128
_CHROM = "if(chrom_id is null, '0', concat('1', chrom_id))"
_NO_POSITION, _NAN_POSITION = -(1 << 62), 1 << 62


def resolution_for(n_blocks: int) -> int:
    """Bins per power of two: a power of two itself, such that few rows lie in bins that hold a block boundary."""
    return max(RESOLUTION, 1 << (2 * n_blocks - 1).bit_length())


def bin_text(resolution: int) -> str:
    """The bin of a position: its power of two and the linear part within. Bins depend on no data, so counts of parts add up.

    Where ``log2`` is off by one next to a power of two, the linear part makes up for it.
    """
    size = f"least(abs(position), {FARTHEST!r}D)"
    power = f"floor(log2({size}))"
    inside = f"({power} - {NEAREST}) * {resolution}L + floor(({size} / power(2D, {power}) - 1D) * {resolution})"
    return (
        f"case when position is null then {_NO_POSITION}L when isnan(position) then {_NAN_POSITION}L"
        f" when {size} < {2.0**NEAREST!r}D then 0L else bigint(sign(position)) * (1L + {inside}) end"
    )


def bin_range(number: int, resolution: int) -> tuple[float, float]:
    """A closed range of positions that holds a bin's; a little wider than the bin."""
    if number == 0:
        return -(2.0**NEAREST), 2.0**NEAREST
    power, step = divmod(abs(number) - 1, resolution)
    unit = 2.0 ** (power + NEAREST)
    low, high = unit * (1 + step / resolution) * (1 - 1e-9), unit * (1 + (step + 1) / resolution) * (1 + 1e-9)
    high = float("inf") if high >= FARTHEST else high
    return (low, high) if number > 0 else (-high, -low)


def position_histogram(sites: DataFrame, resolution: int = RESOLUTION) -> DataFrame:
    """``(chrom, bin, n)``: how many sites lie in each bin. Reads two columns; histograms of parts of the data add up."""
    return sites.selectExpr(f"{_CHROM} as chrom", f"{bin_text(resolution)} as bin").groupBy("chrom", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )


def coarser(histogram: DataFrame, resolution: int, wanted: int) -> DataFrame:
    """A histogram of ``resolution`` bins per power of two as one of ``wanted``; both are powers of two."""
    steps = resolution // wanted
    number = f"case when bin = 0 or abs(bin) >= {_NAN_POSITION}L then bin else bigint(sign(bin)) * ((abs(bin) - 1) div {steps} + 1) end"
    return histogram.selectExpr("chrom", f"{number} as bin", "n").groupBy("chrom", "bin").agg(F.sum("n").alias("n"))


def _cut_filter(cuts: list, resolution: int) -> Column:
    """A condition on chromosome and position that all rows of the ``cuts`` meet and that a source can apply by itself."""
    by_chrom: dict[str, list[int]] = {}
    for c in cuts:
        by_chrom.setdefault(c.chrom, []).append(c.bin)
    conditions = []
    for chrom, bins in sorted(by_chrom.items()):
        here = F.col("chrom_id") == F.lit(chrom[1:]) if chrom != "0" else F.col("chrom_id").isNull()
        real = [bin_range(b, resolution) for b in sorted(bins) if abs(b) < _NAN_POSITION]
        if len(cuts) > NAMED_BINS and real:
            real = [(real[0][0], real[-1][1])]
        places = [F.col("position").between(*r) for r in real]
        places += [F.col("position").isNull()] * (_NO_POSITION in bins) + [F.isnan("position")] * (_NAN_POSITION in bins)
        conditions.append(here & reduce(Column.__or__, places))
    return reduce(Column.__or__, conditions) if conditions else F.lit(False)


def _has_plain_columns(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether these columns are the source's own, so that the source can apply a filter on them."""
    plan = df.select(*names)._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    own = {leaves.apply(i).output().apply(j).exprId().toString() for i in range(leaves.size()) for j in range(leaves.apply(i).output().size())}
    return all(plan.output().apply(i).exprId().toString() in own for i in range(plan.output().size()))


def cut_rows(sites: DataFrame, cuts: list, resolution: int) -> DataFrame:
    """The rows of the ``cuts``' bins with ``chrom`` and ``bin``.

    Where chromosome and position are columns of the source, it is given the ranges as a filter, to skip files and row groups.
    Where they are computed it can't, and a filter would compute them once for each range; then the bin alone decides.
    """
    names = F.broadcast(sites.sparkSession.createDataFrame([(c.chrom, c.bin) for c in cuts], "chrom string, bin bigint"))
    near = sites.where(_cut_filter(cuts, resolution)) if _has_plain_columns(sites, ["chrom_id", "position"]) else sites
    binned = near.selectExpr("chrom_id", "position", "anc", "der", f"{_CHROM} as chrom", f"{bin_text(resolution)} as bin")
    return binned.join(names, ["chrom", "bin"], "left_semi")


def with_blocks(sites: DataFrame, n_blocks: int, histogram: DataFrame | None = None) -> DataFrame:
    """``anc``, ``der`` and ``block`` = floor(rank / (rows / n_blocks)), rows ranked by chromosome, position, configuration.

    A full sort is not needed to know a row's block. A histogram over (chromosome, position bin) gives the rank at which each
    bin starts, so every bin that lies inside one block is settled by a join with that small table: those rows are read from
    the source when the result is, and fixed nowhere. Only bins that hold a block boundary, at most one per boundary, are
    read a second time, by a filter on chromosome and position, and ranked exactly; a bin that holds much of the data is safe,
    because that ranking splits even repeated keys. A missing chromosome sorts before all names, a missing position before all
    positions of its chromosome, and NaN after them.

    Calling this runs the jobs for the histogram, which alone is fixed, and for the rows ranked. ``histogram`` may be given
    where it is stored (:func:`position_histogram` at ``resolution_for(n_blocks)``). The source must give the same rows each
    time; rows of the bins ranked that come and go are an error.
    """
    order = ["chrom_id", "position", "anc", "der"]
    resolution = resolution_for(n_blocks)
    sizes = position_histogram(sites, resolution) if histogram is None else histogram
    # Start ranks in two levels: bins inside their chromosome, then one row per chromosome.
    sizes = cut_lineage(sizes.groupBy("chrom", "bin").agg(F.sum("n").alias("n")))
    inside = sizes.selectExpr("chrom", "bin", "n", "sum(n) over (partition by chrom order by bin) - n as start_inside")
    chroms = sizes.groupBy("chrom").agg(F.sum("n").alias("m")).selectExpr(
        "chrom", "sum(m) over (order by chrom) - m as start_chrom", "sum(m) over () as total"
    )
    spans = inside.join(chroms, "chrom").selectExpr(
        "chrom", "bin", "n", "start_chrom + start_inside as start", f"total / {float(n_blocks)}D as span"
    ).selectExpr(
        "chrom", "bin", "start", "span", "n", "bigint(floor(start / span)) as block",
        "floor(start / span) <> floor((start + n - 1) / span) as cut",
    )
    # At most one row per block boundary.
    cuts = spans.where("cut").selectExpr("chrom", "bin", "n", "span", "start").collect()
    lookup = spans.where("not cut").select("chrom", "bin", "block")
    if sizes.count() <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    binned = sites.selectExpr(*order, f"{_CHROM} as chrom", f"{bin_text(resolution)} as bin")
    settled = binned.join(lookup, ["chrom", "bin"]).select("anc", "der", "block")
    if not cuts:
        return settled

    # Ranks among the rows of cut bins, shifted to where each bin starts.
    before, shifts = 0, []
    for c in sorted(cuts, key=lambda c: c.start):
        shifts.append((c.chrom, c.bin, c.span, c.start - before))
        before += c.n
    names = F.broadcast(sites.sparkSession.createDataFrame(shifts, "chrom string, bin bigint, span double, shift bigint"))
    ranked = with_global_index(cut_rows(sites, cuts, resolution), order, ["chrom", "bin", "anc", "der"], before)
    first = ranked.select("row_total").first()
    if (0 if first is None else first.row_total) != before:
        raise ValueError("the sites changed between two reads; write them to a table first")
    exact = ranked.join(names, ["chrom", "bin"]).selectExpr("anc", "der", "bigint(floor((row_index + shift) / span)) as block")
    return settled.unionByName(exact)
