"""SNP-level tables: one row per site with its allele configuration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freqloom.functions.configs import is_polymorphic, pick
from freqloom.functions.scalar import hypergeometric_draw_text, uniform_text
from freqloom.operators.checksums import keys_that_differ, rows_that_differ
from freqloom.operators.ordering import partitions_for, with_blocks, with_global_index
from freqloom.operators.spectrum import Spectrum

# Consecutive rows looked at together when runs are found.
RUN_BUCKET = 1 << 20
# Equal sites spelled out from one row.
COPY_RUN = 1 << 8
SITE = ("chrom_id", "position", "anc", "der")
ACCOUNTING = "length DOUBLE, n_read BIGINT, n_excluded BIGINT"


def accounting(spark: SparkSession, length: float | None, n_read: int | None, n_excluded: int) -> DataFrame:
    """One-row table of data length (null = unknown) and read / excluded SNP counts."""
    return spark.createDataFrame(
        [(None if length is None else float(length), n_read, n_excluded)], schema=ACCOUNTING
    )


@dataclass(frozen=True)
class SiteTable:
    """``df(chrom_id STRING, position DOUBLE, anc ARRAY<INT>, der ARRAY<INT>)`` and its metadata.

    ``book`` is the one-row accounting table; it stays lazy so that reading a VCF remains one plan.
    """

    df: DataFrame
    pops: tuple[str, ...]
    book: DataFrame
    non_ascertained: tuple[str, ...] = ()
    folded: bool = False
    sampled_n: tuple[int, ...] | None = field(default=None)

    @classmethod
    def from_counts(
        cls,
        df: DataFrame,
        pops: Sequence[str],
        ancestral: Sequence[str],
        derived: Sequence[str],
        chrom_id: str = "chrom_id",
        position: str = "position",
        length: float | None = None,
        folded: bool = False,
        sampled_n: Sequence[int] | None = None,
    ) -> SiteTable:
        """Site table from any table with one ancestral and one derived count column per population."""
        if not len(pops) == len(ancestral) == len(derived):
            raise ValueError("one ancestral and one derived column per population")
        sites = df.selectExpr(
            f"string({chrom_id}) as chrom_id", f"double({position}) as position",
            "array(" + ", ".join(f"int({c})" for c in ancestral) + ") as anc",
            "array(" + ", ".join(f"int({c})" for c in derived) + ") as der",
        )
        book = sites.agg(
            F.lit(length).cast("double").alias("length"),
            F.count(F.lit(1)).alias("n_read"),
            F.lit(0).cast("bigint").alias("n_excluded"),
        )
        return cls(sites, tuple(pops), book, (), folded, None if sampled_n is None else tuple(sampled_n))

    @property
    def ascertained_indices(self) -> list[int]:
        return [i for i, p in enumerate(self.pops) if p not in self.non_ascertained]

    def excluded_fraction(self) -> DataFrame:
        """``p_excluded`` and the length that remains after excluded SNPs; null where nothing is known."""
        p = F.try_divide(F.col("n_excluded").cast("double"), (F.col("n_read") + F.col("n_excluded")).cast("double"))
        return self.book.select(p.alias("p_excluded"), (F.col("length") * (F.lit(1.0) - p)).alias("effective_length"))

    def subset_populations(
        self, populations: Sequence[str], non_ascertained: Sequence[str] | None = None
    ) -> SiteTable:
        """Keep and reorder populations; a projection of the count arrays, no shuffle."""
        keep = [self.pops.index(p) for p in populations]
        if non_ascertained is None:
            non_ascertained = [p for p in self.non_ascertained if p in populations]
        df = self.df.withColumns({"anc": pick("anc", keep), "der": pick("der", keep)})
        n = None if self.sampled_n is None else tuple(self.sampled_n[i] for i in keep)
        return replace(self, df=df, pops=tuple(populations), non_ascertained=tuple(non_ascertained), sampled_n=n)

    def where(self, condition: Column | str) -> SiteTable:
        """Row filter; metadata is kept as it was."""
        return replace(self, df=self.df.where(condition), sampled_n=None)

    def polymorphic(self) -> SiteTable:
        """Only sites that show both alleles among the ascertained populations."""
        return replace(self, df=self.df.where(is_polymorphic(self.ascertained_indices)))

    def config_counts(self) -> DataFrame:
        """Distinct configurations and how many sites show each."""
        return self.df.groupBy("anc", "der").agg(F.count(F.lit(1)).alias("n_sites"))

    def site_counts(self) -> DataFrame:
        """``(chrom_id, position, anc, der, n)``: distinct sites and how many rows show each.

        Hardly any two sites are equal, so a task holds nearly all that it reads: the number of partitions follows the rows of
        the accounting, or a count where it has none. Rows are dealt by site and by the partition they come from, which splits
        a site that repeats without end, and their counts once more by site.
        """
        session, read = self.df.sparkSession, self.book.first().n_read
        parts = max(partitions_for(session, self.df.count() if read is None else read), session.sparkContext.defaultParallelism)
        dealt = self.df.select(*SITE, F.spark_partition_id().alias("_from")).repartition(parts, *SITE, "_from")
        counted = dealt.groupBy(*SITE, "_from").agg(F.count(F.lit(1)).alias("n"))
        return counted.repartition(parts, *SITE).groupBy(*SITE).agg(F.sum("n").alias("n"))

    @classmethod
    def concatenate(cls, tables: Sequence[SiteTable]) -> SiteTable:
        """Union of datasets with the same populations, order and ascertainment."""
        first = tables[0]
        if any((t.pops, set(t.non_ascertained)) != (first.pops, set(first.non_ascertained)) for t in tables):
            raise ValueError("tables differ in their populations, their order or their ascertainment")
        df, books = first.df, first.book
        for t in tables[1:]:
            df, books = df.unionByName(t.df), books.unionByName(t.book)
        book = books.agg(
            F.when(F.count(F.lit(1)) == F.count("length"), F.sum("length")).alias("length"),
            F.sum("n_read").alias("n_read"),
            F.sum("n_excluded").alias("n_excluded"),
        )
        sizes = {t.sampled_n for t in tables}
        n = first.sampled_n if len(sizes) == 1 else None
        return cls(df, first.pops, book, first.non_ascertained, any(t.folded for t in tables), n)

    def differences(self, other: SiteTable) -> DataFrame:
        """Sites that only one of two tables has, with the side; empty when the rows are equal.

        Checksums per chromosome tell where the tables differ; only those chromosomes' rows are compared. Calling this runs
        the job of the checksums.
        """
        return rows_that_differ(self.df, other.df, "chrom_id", SITE)

    def equals(self, other: SiteTable) -> bool:
        """Same sites, populations, folding and accounting; the sites by their checksums, without a shuffle of rows."""
        same = (self.pops, self.folded) == (other.pops, other.folded)
        return same and self.book.first() == other.book.first() and not keys_that_differ(self.df, other.df, "chrom_id", SITE).take(1)

    def sorted(self) -> DataFrame:
        """Rows by chromosome (as text), position and configuration; a range shuffle, meant for writing.

        A tie-breaker lets full ties go to several partitions.
        """
        return self.df.withColumn("_tie", F.monotonically_increasing_id()).orderBy(*SITE, "_tie").drop("_tie")

    def down_sample(
        self, targets: dict[str, int], seed: int = 0, uniform: Callable[[int], str] | None = None, distinct: bool = False
    ) -> SiteTable:
        """Draw without replacement at most ``targets[pop]`` alleles per site.

        Each site draws its ancestral count from the hypergeometric distribution, by one uniform number for each population:
        a hash of chromosome, position, configuration, the number of the site among those that agree in all of these,
        population and ``seed``. Sites that repeat, as sites without a position often do, so draw independently, and the
        result is the same for any partitioning. Equal sites are counted by one aggregation and spelled out again, in pieces
        where they are many; a table known to have no equal sites goes without it by ``distinct``. ``uniform`` may give the
        SQL text of another number in [0, 1) for the i-th population, over the columns chrom_id, position, anc, der, copy.
        """
        uniform = uniform or (lambda i: uniform_text("draw", str(i)))
        wanted = {self.pops.index(p): n for p, n in targets.items()}
        copies = self.df.withColumn("copy", F.lit(0).cast("bigint")) if distinct else _numbered_copies(self.df)
        drawn = copies.withColumn("draw", F.xxhash64(*SITE, "copy", F.lit(int(seed))))
        # What a draw names often are columns of their own, in doubles, so that the compiled methods stay small.
        drawn = drawn.withColumns({f"u{i}": F.expr(uniform(i)) for i in wanted}).withColumns(
            {f"size{i}": F.expr(f"double(anc[{i}] + der[{i}])") for i in wanted} | {f"hits{i}": F.expr(f"double(anc[{i}])") for i in wanted}
        )
        for i, n in wanted.items():
            got = hypergeometric_draw_text(f"u{i}", f"size{i}", f"hits{i}", str(n))
            drawn = drawn.withColumn(f"got{i}", F.expr(f"case when size{i} > {n} then int({got}) end"))
        new_anc, new_der = (
            [f"coalesce({f'got{i}' if side == 'anc' else f'{wanted[i]} - got{i}'}, {side}[{i}])" if i in wanted else f"{side}[{i}]" for i in range(len(self.pops))]
            for side in ("anc", "der")
        )
        df = drawn.selectExpr("chrom_id", "position", f"array({', '.join(new_anc)}) as anc", f"array({', '.join(new_der)}) as der")
        return replace(self, df=df, sampled_n=None)

    def spectrum_of_counts(self, counted: DataFrame) -> Spectrum:
        """Spectrum of this table's sites from their counts ``(block, anc, der, cnt)`` by any kind of block."""
        kept = counted.where(is_polymorphic(self.ascertained_indices))
        summed = kept.groupBy("block", "anc", "der").agg(F.sum("cnt").cast("double").alias("cnt"))
        out = Spectrum(
            summed, self.pops, self.excluded_fraction().select(F.col("effective_length").alias("length")),
            self.non_ascertained, False, self.sampled_n,
        )
        return out.fold() if self.folded else out

    def spectrum_of_rows(self, blocked: DataFrame) -> Spectrum:
        """The same from one row ``(block, anc, der)`` per site."""
        return self.spectrum_of_counts(blocked.withColumn("cnt", F.lit(1).cast("bigint")))

    def extract_blocks(self, n_blocks: int) -> Spectrum:
        """Spectrum per block of (nearly) equal numbers of consecutive sites, counted before the polymorphism filter."""
        return self.spectrum_of_rows(with_blocks(self.df, n_blocks))

    def p_missing(self) -> DataFrame:
        """``(pop, p_missing)`` of the polymorphic sites, from their configuration counts: one aggregation, no blocks."""
        return self.spectrum_of_rows(self.df.withColumn("block", F.lit(0).cast("bigint"))).p_missing()

    def extract_by_chromosome(self) -> Spectrum:
        """Spectrum per chromosome; blocks are numbered in chromosome (text) order.

        For a table stored in sorted order this equals one block per run of equal chromosome ids.
        """
        counted = self.spectrum_of_rows(self.df.withColumn("block", F.col("chrom_id")))
        return counted.renumbered()

    def extract_by_runs(self, stored_order: str) -> Spectrum:
        """Spectrum per run of consecutive equal chromosome ids, rows taken in ``stored_order``.

        Rows are ranked in sorted partitions of bounded size. A run starts where the row before has another chromosome:
        inside buckets of consecutive rows a window sees it, and the first row of a bucket takes the last chromosome of the
        one before from a table of one row per bucket.
        """
        kept = self.df.where(is_polymorphic(self.ascertained_indices))
        indexed = with_global_index(kept, [stored_order], ["chrom_id", "anc", "der"], kept.count()).withColumn("_bucket", F.floor(F.col("row_index") / RUN_BUCKET))
        order = Window.partitionBy("_bucket").orderBy("row_index")
        changes = indexed.withColumn("_first", F.col("row_index") % RUN_BUCKET == 0).withColumn(
            "_start", ~F.col("_first") & ~F.col("chrom_id").eqNullSafe(F.lag("chrom_id").over(order))
        ).withColumn("_inside", F.count(F.when(F.col("_start"), 1)).over(order))
        ends = indexed.groupBy("_bucket").agg(
            F.min_by(F.struct("chrom_id"), "row_index").alias("head"), F.max_by(F.struct("chrom_id"), "row_index").alias("tail")
        )
        inner = changes.groupBy("_bucket").agg(F.max("_inside").alias("_starts"))
        along = Window.orderBy("_bucket")
        offsets = ends.join(inner, "_bucket").withColumn(
            "_opens", ~F.col("head.chrom_id").eqNullSafe(F.lag("tail").over(along)["chrom_id"])
        ).withColumn("_opens", F.coalesce(F.lag("tail").over(along).isNull() | F.col("_opens"), F.lit(True)).cast("bigint"))
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        offsets = offsets.select(
            "_bucket", (F.coalesce(F.sum(F.col("_starts") + F.col("_opens")).over(before), F.lit(0)) + F.col("_opens")).alias("_before")
        )
        runs = changes.join(offsets, "_bucket").withColumn("block", F.col("_before") + F.col("_inside") - 1)
        return self.spectrum_of_rows(runs.select("anc", "der", "block"))


def _numbered_copies(df: DataFrame) -> DataFrame:
    """Sites with ``copy``, their number among the sites equal to them; up to COPY_RUN of them are spelled out in place.

    More come in runs that are dealt over a fixed number of partitions: a run is a few bytes whatever it spells out, so
    adaptive execution, which goes by bytes, would put all of them into one task.
    """
    counted = df.groupBy(*SITE).agg(F.count(F.lit(1)).alias("n"))
    session = df.sparkSession
    tasks = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
    few = counted.where(f"n <= {COPY_RUN}").selectExpr(*SITE, "explode(sequence(0L, n - 1)) as copy")
    runs = counted.where(f"n > {COPY_RUN}").selectExpr(*SITE, "n", f"explode(sequence(0L, (n - 1) div {COPY_RUN})) as run")
    many = runs.repartition(tasks, *SITE, "run").selectExpr(
        *SITE, f"explode(sequence(run * {COPY_RUN}, least(n, (run + 1) * {COPY_RUN}) - 1)) as copy"
    )
    return few.unionByName(many)
