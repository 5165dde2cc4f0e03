"""Restriction of records to genome intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Width of the finest bins, and how many of them make one of the next level; the last level is one bin.
BIN_WIDTH, BIN_STEP, BIN_LEVELS = 16384, 8, 6


def region_length(bed: DataFrame) -> DataFrame:
    """One row: summed interval lengths; overlapping intervals count twice."""
    return bed.selectExpr("double(coalesce(sum(end_pos - start_pos), 0)) as length")


def _level_text(start: str, end: str, bin_width: int) -> str:
    """The finest level at which one bin holds all of [start, end); the last level, of one bin, holds everything."""
    cases = []
    for level in range(BIN_LEVELS):
        width = bin_width * BIN_STEP**level
        cases.append(f"when floor({start} / {width}) = floor(({end} - 1) / {width}) then {level}")
    return f"case {' '.join(cases)} else {BIN_LEVELS} end"


def _bin_of(place: str, bin_width: int) -> str:
    """The bin of a place at the level in the column ``_level``."""
    cases = " ".join(f"when {level} then bigint(floor({place} / {bin_width * BIN_STEP**level}))" for level in range(BIN_LEVELS))
    return f"case _level {cases} else 0L end"


def within_regions(
    records: DataFrame, bed: DataFrame, ref_length: str = "1", bin_width: int = BIN_WIDTH, count: str | None = None
) -> DataFrame:
    """Records (``chrom_id``, 1-based ``position``) once for each interval of ``bed`` that they overlap.

    With ``count``, each record that overlaps some interval is given once, with the number of these intervals in a column of that
    name: no pair is formed, so the cost goes with records and intervals, however much they overlap.

    A record covers ``ref_length`` reference bases. Bins are nested: an interval has one row, in the finest bin that holds all
    of it, however long it is. A record looks up the bins that it touches at each level that intervals have (one for a single
    base), and both sides are joined on (chromosome, level, bin), so a pair meets once. The levels present, at most seven
    numbers, are asked from ``bed`` first. The join needs no hint: its strategy, and the splitting of a hot bin, follow the
    measured sizes. Empty intervals and rows without a chromosome or place match nothing.
    """
    regions = bed.where("end_pos > start_pos").selectExpr("chrom_id", "bigint(start_pos) as _bed_start", "bigint(end_pos) as _bed_end")
    if count is not None:
        return _counted(records, regions, ref_length, count)
    regions = regions.withColumn("_level", F.expr(_level_text("_bed_start", "_bed_end", bin_width)))
    levels = sorted(r["_level"] for r in regions.select("_level").distinct().collect())
    regions = regions.withColumn("_bin", F.expr(_bin_of("_bed_start", bin_width)))
    spans = records.selectExpr(
        "*", "bigint(position) - 1 as _start", f"bigint(position) - 1 + {ref_length} as _end",
        f"explode(cast(array({', '.join(map(str, levels))}) as array<int>)) as _level",
    ).selectExpr("*", f"explode(sequence({_bin_of('_start', bin_width)}, {_bin_of('greatest(_end - 1, _start)', bin_width)})) as _bin")
    joined = spans.join(regions, ["chrom_id", "_level", "_bin"]).where("_start < _bed_end and _end > _bed_start")
    return joined.select(*records.columns)


# Places in a bin, and bins in one of the next level, when places are ranked; no window has more rows than that.
RANK_WIDTH = 1 << 14


def _counted(records: DataFrame, regions: DataFrame, ref_length: str, count: str) -> DataFrame:
    """Records with how many intervals they overlap: those that begin before a record's end less those that end by its start.

    A record that covers less than no base covers none. Only distinct places are ranked.
    """
    spans = records.selectExpr("*", "bigint(position) - 1 as _start").selectExpr(
        "*", f"greatest(_start, bigint(_start + {ref_length})) - if(_start + {ref_length} is null, null, 1L) as _last"
    )
    ends = "inline(array(struct('begin' as _side, {} as _place), struct('end' as _side, {} as _place)))"
    marks = regions.selectExpr("chrom_id", ends.format("_bed_start", "_bed_end"), "1L as _n")
    asked = spans.selectExpr("chrom_id", ends.format("_last", "_start"), "0L as _n")
    upto = _running(marks.unionAll(asked).where("chrom_id is not null and _place is not null"))
    begun = upto.where("_side = 'begin'").selectExpr("chrom_id", "_place as _last", "_upto as _begun")
    over = upto.where("_side = 'end'").selectExpr("chrom_id", "_place as _start", "_upto as _over")
    found = spans.join(begun, ["chrom_id", "_last"]).join(over, ["chrom_id", "_start"]).where("_begun > _over")
    return found.select(*records.columns, (F.col("_begun") - F.col("_over")).alias(count))


def _running(marks: DataFrame) -> DataFrame:
    """``(chrom_id, _side, _place, _upto)``: the sum of ``_n`` up to each place, by sums inside nested bins."""
    side = ["chrom_id", "_side"]
    places = marks.groupBy(*side, "_place").agg(F.sum("_n").alias("_n")).selectExpr(
        "*", f"floor(_place / {RANK_WIDTH}) as _bin", f"floor(_place / {RANK_WIDTH**2}) as _far"
    )

    def before(df: DataFrame, keys: list[str], at: str) -> DataFrame:
        along = Window.partitionBy(*side, *keys).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn("_sum", F.sum("_n").over(along))

    bins = places.groupBy(*side, "_far", "_bin").agg(F.sum("_n").alias("_n"))
    fars = bins.groupBy(*side, "_far").agg(F.sum("_n").alias("_n"))
    in_far = before(bins, ["_far"], "_bin").selectExpr(*side, "_far", "_bin", "_sum - _n as _in_far")
    by_far = before(fars, [], "_far").selectExpr(*side, "_far", "_sum - _n as _by_far")
    within = before(places, ["_far", "_bin"], "_place").drop("_n")
    return within.join(in_far, [*side, "_far", "_bin"]).join(by_far, [*side, "_far"]).selectExpr(
        *side, "_place", "_sum + _in_far + _by_far as _upto"
    )
