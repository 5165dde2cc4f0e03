"""Sites, configurations, blocks and spectra."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.views import (
    CONFIG, CONFIG_BIGINT, LONG_SQL, N_BLOCKS, POLY, POPS, SAMPLED_N, SFS_SQL, SITES_SQL, TOTAL_SQL,
    blocks, combined, key_sql, sites, spread, table,
)
from freqloom.functions.configs import config_key, is_complete, parse_key
from freqloom.operators.checksums import keys_that_differ
from freqloom.operators.dictionary import store_new, stored
from freqloom.operators.sites import SITE, SiteTable
from freqloom.operators.spectrum import Spectrum, full_configs
from freqloom.session import ensure_checkpoint_dir


@query("p1_subset_snps", f"""with {SITES_SQL}
 select chrom_id, position, concat(d_anc, ',', d_der, chr(9), a_anc, ',', a_der) as config, count(*) as n
 from sites group by all""")
def subset_snps(spark, sf):
    """Populations d, a in that order, with repeats counted."""
    t = sites(spark, sf).subset_populations(["d", "a"])
    return t.df.groupBy("chrom_id", "position", config_key().alias("config")).agg(F.count(F.lit(1)).alias("n"))


@query("p2_subset_sfs", f"""with {SFS_SQL}
 select block, cast(c_anc as bigint) as c_anc, cast(c_der as bigint) as c_der, cast(a_anc as bigint) as a_anc,
        cast(a_der as bigint) as a_der, sum(cnt) as cnt
 from sfs where a_anc + c_anc > 0 and a_der + c_der > 0 group by all""")
def subset_sfs(spark, sf):
    s = blocks(spark, sf).subset_populations(["c", "a"])
    return spread(s.df, "block", "cnt", pops=("c", "a"))


@query("p2_subset_sfs_ascertained", f"""with {SFS_SQL}
 select block, cast(b_anc as bigint) as b_anc, cast(b_der as bigint) as b_der, cast(d_anc as bigint) as d_anc,
        cast(d_der as bigint) as d_der, sum(cnt) as cnt
 from sfs where b_anc > 0 and b_der > 0 group by all""")
def subset_sfs_ascertained(spark, sf):
    """d kept but not used to decide which configurations are polymorphic."""
    s = blocks(spark, sf).subset_populations(["b", "d"], non_ascertained=["d"])
    return spread(s.df, "block", "cnt", pops=("b", "d"))


@query("p3_polymorphic", f"""with {SITES_SQL} select chrom_id, {CONFIG_BIGINT}, count(*) as n_sites
 from sites where {POLY} group by all""")
def polymorphic(spark, sf):
    t = sites(spark, sf).polymorphic()
    return spread(t.df.groupBy("chrom_id", "anc", "der").agg(F.count(F.lit(1)).alias("n_sites")), "chrom_id", "n_sites")


@query("p4_ascertained_sites", f"""with {SITES_SQL} select chrom_id, count(*) as n_sites
 from sites where a_anc + b_anc > 0 and a_der + b_der > 0 group by all""")
def ascertained_sites(spark, sf):
    """Sites polymorphic in a and b; c and d are carried along without being ascertained."""
    t = sites(spark, sf).subset_populations(POPS, non_ascertained=["c", "d"]).polymorphic()
    return t.df.groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n_sites"))


@query("p5_filter_sites", f"""with {SITES_SQL} select {CONFIG_BIGINT}, count(*) as n_sites
 from sites where chrom_id = 'chr2' and position >= 10000 group by all""")
def filter_sites(spark, sf):
    t = sites(spark, sf).where((F.col("chrom_id") == "chr2") & (F.col("position") >= 10000))
    return spread(t.config_counts(), "n_sites")


@query("p6_subset_configs", f"""with {SFS_SQL} select block, {CONFIG_BIGINT}, cnt
 from sfs where c_anc + c_der = 4 and d_der = 1""")
def subset_configs(spark, sf):
    s = blocks(spark, sf)
    wanted = s.configs().where("anc[2] + der[2] = 4 and der[3] = 1")
    return spread(s.subset_configs(wanted).df, "block", "cnt")


@query("p7_point_access", f"""with {TOTAL_SQL}, ranked_configs as (
 select *, row_number() over (order by [a_anc+a_der, b_anc+b_der, c_anc+c_der, d_anc+d_der],
   least([a_anc, b_anc, c_anc, d_anc], [a_der, b_der, c_der, d_der]), [a_anc, b_anc, c_anc, d_anc]) - 1 as config_id from tot)
 select config_id, {CONFIG_BIGINT} from ranked_configs where config_id = 17""")
def point_access(spark, sf):
    return spread(combined(spark, sf).dictionary().where("config_id = 17"), "config_id")


@query("p8_fold", f"""with {SFS_SQL}, sw as (select *, [a_anc, b_anc, c_anc, d_anc] < [a_der, b_der, c_der, d_der] as s from sfs)
 select block, {", ".join(f"cast(case when s then {p}_der else {p}_anc end as bigint) as {p}_anc, cast(case when s then {p}_anc else {p}_der end as bigint) as {p}_der" for p in POPS)},
   sum(cnt) as cnt from sw group by all""")
def fold(spark, sf):
    return spread(blocks(spark, sf).fold().df, "block", "cnt")


@query("p9_config_key", f"""with {TOTAL_SQL} select {key_sql()} as config, {CONFIG_BIGINT}, cnt from tot""")
def config_text(spark, sf):
    """To text and back."""
    text = combined(spark, sf).df.select(config_key().alias("config"), "cnt")
    anc, der = parse_key("config")
    return spread(text.withColumns({"anc": anc, "der": der}), "config", "cnt")


@query("p10_violations", f"""with {TOTAL_SQL}, v as (select
   count(*) filter (a_anc+a_der > 4 or b_anc+b_der > 4 or c_anc+c_der > 3 or d_anc+d_der > 2) as big,
   count(*) filter (not (c_anc > 0 and c_der > 0)) as mono from tot)
 select u.rule, cast(u.n_bad as bigint) as n_bad from v, lateral (values ('no_ascertained_population', 0),
   ('config_exceeds_sampled_n', big), ('fewer_than_two_ascertained_alleles', 0),
   ('monomorphic_when_ascertained', mono)) as u(rule, n_bad)""")
def violations(spark, sf):
    """Rules checked with a too small c and only c ascertained, so that two of them are broken."""
    s = combined(spark, sf)
    broken = Spectrum(s.df, POPS, s.meta, ("a", "b", "d"), False, (4, 4, 3, 2))
    return broken.violations()


@query("p11_sampled_n", f"""with {TOTAL_SQL} select
   (select bool_or(a_anc+a_der <> 4 or b_anc+b_der <> 4 or c_anc+c_der <> 4 or d_anc+d_der <> 2) from tot) as declared_missing,
   (select bool_or(a_anc+a_der <> 6 or b_anc+b_der <> 6 or c_anc+c_der <> 6 or d_anc+d_der <> 2) from tot) as larger_missing,
   (select bool_or(false) from tot where c_anc + c_der = 4) as complete_missing""")
def sampled_n_override(spark, sf):
    """Missing-data flag under three sample sizes and subsets."""
    s = combined(spark, sf)
    complete = Spectrum(s.df.where("anc[2] + der[2] = 4"), POPS, s.meta, (), False, SAMPLED_N)
    one = lambda t, name: t.has_missing_data().select(F.col("has_missing_data").alias(name), F.lit(1).alias("k"))
    return (
        one(s, "declared_missing")
        .join(one(s.with_sampled_n((6, 6, 6, 2)), "larger_missing"), "k")
        .join(one(complete, "complete_missing"), "k").drop("k")
    )


@query("u1_concatenate", f"""with {SITES_SQL}, u as (select * from sites where chrom_id in ('chr1', 'chr3', 'chr5')
   union all select * from sites where chrom_id in ('chr2', 'chr4', 'chr1'))
 select chrom_id, position, {CONFIG_BIGINT}, count(*) as n from u group by all""")
def concatenate(spark, sf):
    t = sites(spark, sf)
    both = SiteTable.concatenate([t.where("chrom_id in ('chr1', 'chr3', 'chr5')"), t.where("chrom_id in ('chr2', 'chr4', 'chr1')")])
    counted = both.sorted().groupBy("chrom_id", "position", "anc", "der").agg(F.count(F.lit(1)).alias("n"))
    return spread(counted, "chrom_id", "position", "n")


@query("u1_concatenate_book", """with b as (select count(*) as n from lineitem)
 select cast(null as double) as length_any_unknown, cast(300000 as double) as length_known, 2 * n as n_read, cast(0 as bigint) as n_excluded from b""")
def concatenate_book(spark, sf):
    """Lengths add up and are unknown as soon as one is."""
    t = sites(spark, sf)
    known = lambda v: SiteTable(t.df, t.pops, t.book.withColumn("length", F.lit(float(v))))
    unknown = SiteTable.concatenate([known(1e5), t]).book.select(F.col("length").alias("length_any_unknown"), F.lit(1).alias("k"))
    full = SiteTable.concatenate([known(1e5), known(2e5)]).book.select(
        F.col("length").alias("length_known"), "n_read", "n_excluded", F.lit(1).alias("k")
    )
    return unknown.join(full, "k").drop("k")


SIMILAR_SQL = f"""{TOTAL_SQL}, ranked_configs as (
 select *, row_number() over (order by [a_anc+a_der, b_anc+b_der, c_anc+c_der, d_anc+d_der],
   least([a_anc, b_anc, c_anc, d_anc], [a_der, b_der, c_der, d_der]), [a_anc, b_anc, c_anc, d_anc]) - 1 as config_id from tot)"""


@query("a1_dictionary", f"""with {SIMILAR_SQL} select config_id, {CONFIG_BIGINT} from ranked_configs""")
def dictionary(spark, sf):
    return spread(combined(spark, sf).dictionary(), "config_id")


@query("a2_config_counts", f"""with {SITES_SQL} select {CONFIG_BIGINT}, count(*) as n_sites from sites group by all""")
def config_counts(spark, sf):
    return spread(sites(spark, sf).config_counts(), "n_sites")


@query("a3_sfs_by_chrom", f"""with {SITES_SQL}, c as (
   select dense_rank() over (order by chrom_id) - 1 as block, * from sites where {POLY})
 select cast(block as bigint) as block, {CONFIG_BIGINT}, cast(count(*) as double) as cnt from c group by all""")
def sfs_by_chrom(spark, sf):
    return spread(sites(spark, sf).extract_by_chromosome().df, "block", "cnt")


@query("a3_sfs_by_runs", """with e as (
   select event_id, event_type, user_id % 5 as a_der, 4 - user_id % 5 as a_anc, event_id % 3 as d_der, 2 - event_id % 3 as d_anc from events),
 p as (select * from e where a_anc + d_anc > 0 and a_der + d_der > 0),
 f as (select *, case when event_type is distinct from lag(event_type) over (order by event_id) then 1 else 0 end as s from p),
 g as (select *, sum(s) over (order by event_id) - 1 as block from f)
 select cast(block as bigint) as block, a_anc, a_der, d_anc, d_der, cast(count(*) as double) as cnt from g group by all""")
def sfs_by_runs(spark, sf):
    """Events as sites: runs of equal event type, in stored order, are the loci."""
    e = table(spark, sf, "events").selectExpr(
        "event_type as chrom_id", "event_id as position", "user_id % 5 as a_der", "4 - user_id % 5 as a_anc",
        "event_id % 3 as d_der", "2 - event_id % 3 as d_anc",
    )
    t = SiteTable.from_counts(e, ("a", "d"), ["a_anc", "d_anc"], ["a_der", "d_der"], sampled_n=(4, 2))
    return spread(t.extract_by_runs("position").df, "block", "cnt", pops=("a", "d"))


@query("a4_sfs_blocks", f"""with {SFS_SQL}
 select dense_rank() over (order by block) - 1 as block, {CONFIG_BIGINT}, cnt from sfs""")
def sfs_blocks(spark, sf):
    return spread(blocks(spark, sf).renumbered().df, "block", "cnt")


NULL_SITES_SQL = f"""{SITES_SQL}, placed as (select * replace (case when d_anc = 2 and a_der = 1 then null else chrom_id end as chrom_id,
   case when position % 7 = 3 then null else position end as position) from sites),
 ranked as (select *, row_number() over (order by chrom_id nulls first, position nulls first, a_anc, b_anc, c_anc, d_anc, a_der, b_der, c_der, d_der) - 1
   as row_index, count(*) over () as row_total from placed)"""


@query("a4_null_positions", f"""with {NULL_SITES_SQL} select cast(floor(row_index / (row_total / 30.0)) as bigint) as block, {CONFIG_BIGINT},
 cast(count(*) as double) as cnt from ranked where {POLY} group by all""")
def sfs_blocks_of_null_positions(spark, sf):
    """A seventh of the sites without a position and some without a chromosome: they come first and are all kept."""
    t = sites(spark, sf)
    placed = t.df.withColumns({
        "chrom_id": F.expr("if(anc[3] = 2 and der[0] = 1, null, chrom_id)"), "position": F.expr("if(position % 7 = 3, null, position)"),
    })
    return spread(SiteTable(placed, t.pops, t.book, sampled_n=SAMPLED_N).extract_blocks(30).df, "block", "cnt")


@query("a5_combined", f"""with {SFS_SQL} select cast(0 as bigint) as block, {CONFIG_BIGINT}, sum(cnt) as cnt from sfs group by all""")
def combined_loci(spark, sf):
    return spread(blocks(spark, sf).combined().df, "block", "cnt")


@query("a6_matrix", f"""with {SFS_SQL} select {key_sql()} as config,
 {", ".join(f"coalesce(sum(cnt) filter (block = {b}), 0.0) as block_{b}" for b in range(N_BLOCKS))} from sfs group by all""")
def matrix(spark, sf):
    wide = blocks(spark, sf).matrix(range(N_BLOCKS))
    return wide.select("config", *[F.col(str(b)).alias(f"block_{b}") for b in range(N_BLOCKS)])


@query("a6_from_matrix", f"""with {SFS_SQL} select block, {CONFIG_BIGINT}, cnt from sfs""")
def from_matrix(spark, sf):
    wide = blocks(spark, sf).matrix(range(N_BLOCKS))
    return spread(Spectrum.from_matrix(wide, POPS, range(N_BLOCKS)).df, "block", "cnt")


@query("a7_n_snps", f"""with {SFS_SQL} select block, sum(cnt) as n_snps from sfs group by rollup(block)""")
def n_snps(spark, sf):
    s = blocks(spark, sf)
    return s.df.rollup("block").agg(F.sum("cnt").alias("n_snps"))


@query("a8_sizes", f"""with {SFS_SQL} select count(distinct block) as n_blocks, count(distinct ({CONFIG})) as n_configs from sfs""")
def shape(spark, sf):
    return blocks(spark, sf).shape()


@query("a9_sampled_n", f"""with {SFS_SQL}, {LONG_SQL} select pop, cast(max(anc + der) as bigint) as n from long group by pop""")
def sampled_n(spark, sf):
    return blocks(spark, sf).observed_sizes().select("pop", F.col("n").cast("bigint").alias("n"))


@query("a18_equality", f"""with {SFS_SQL} select 'left' as side, block, {CONFIG_BIGINT}, cnt from sfs where block = 3""")
def equality(spark, sf):
    """Rows that differ between the spectrum and a copy without block 3."""
    s = blocks(spark, sf).materialised()
    without = Spectrum(s.df.where("block <> 3"), POPS, s.meta, (), False, SAMPLED_N)
    return spread(s.differences(without), "side", "block", "cnt")


@query("a18_equal_sites", f"""with {SITES_SQL}, changed as (select chrom_id, case when chrom_id = 'chr4' and position % 1000 = 1 then position + 0.5 else position end as position, {CONFIG} from sites),
 l as (select chrom_id, position, {CONFIG}, count(*) as n from sites group by all), x as (select chrom_id, position, {CONFIG}, count(*) as n from changed group by all),
 b as (select * from l except select * from x)
 select chrom_id, count(*) as n_sites, count(*) > 0 as differs, true as equal_when_reordered from b group by chrom_id""")
def equal_sites(spark, sf):
    """A copy with places moved on one chromosome: checksums name it, and a copy in other partitions is equal."""
    t = sites(spark, sf)
    moved = replace(t, df=t.df.withColumn("position", F.expr("if(chrom_id = 'chr4' and position % 1000 = 1, position + 0.5D, position)")))
    keys = keys_that_differ(t.df, moved.df, "chrom_id", SITE)
    rows = t.differences(moved).where("side = 'left'").distinct().groupBy("chrom_id").agg(F.count(F.lit(1)).alias("n_sites"))
    equal = t.equals(replace(t, df=t.df.repartition("position")))
    return keys.selectExpr("key as chrom_id", "true as differs").join(rows, "chrom_id").withColumn("equal_when_reordered", F.lit(equal))


FIRST_CHROMS = ("chr1", "chr2")


@query("a1_dictionary_merge", f"""with {SITES_SQL}, f as (
  select {CONFIG}, min(case when chrom_id in {FIRST_CHROMS} then 1 else 2 end) as step from sites group by all),
 o as (select *, row_number() over (partition by step order by [a_anc+a_der, b_anc+b_der, c_anc+c_der, d_anc+d_der],
   least([a_anc, b_anc, c_anc, d_anc], [a_der, b_der, c_der, d_der]), [a_anc, b_anc, c_anc, d_anc]) - 1 as place from f)
 select place + case when step = 2 then (select count(*) from f where step = 1) else 0 end as config_id, {CONFIG_BIGINT} from o""")
def dictionary_merge(spark, sf):
    """A stored dictionary of two chromosomes, to which those of all chromosomes are added: known numbers stay."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/dictionary-{uuid.uuid4().hex}"
    every = sites(spark, sf).df
    store_new(every.where(F.col("chrom_id").isin(*FIRST_CHROMS)), path)
    store_new(every, path)
    return spread(stored(spark, path), "config_id")


@query("a19_sorted_configs", f"""with {SIMILAR_SQL} select config_id, {key_sql()} as config, cnt from ranked_configs""")
def sorted_configs(spark, sf):
    """Counts listed in similarity order."""
    s = combined(spark, sf).materialised()
    return s.dictionary().join(s.df, ["anc", "der"]).select("config_id", config_key().alias("config"), "cnt")


@query("a24_missing_flag", f"""with {SFS_SQL} select block, bool_or(c_anc + c_der <> 4) as has_missing_data from sfs group by block""")
def missing_flag(spark, sf):
    s = blocks(spark, sf)
    return s.df.groupBy("block").agg(F.bool_or(~is_complete(SAMPLED_N)).alias("has_missing_data"))


@query("s15_spectrum_from_rows", f"""with {SITES_SQL} select cast(substr(chrom_id, 4) as bigint) as block, {CONFIG_BIGINT},
 sum(1 + position - position) as cnt from sites where {POLY} group by all""")
def spectrum_from_rows(spark, sf):
    """One row per site with count 1: repeats add up."""
    t = sites(spark, sf).polymorphic().df.select(F.substring("chrom_id", 4, 9).alias("block"), "anc", "der")
    return spread(Spectrum.from_rows(t, POPS).df, "block", "cnt")


@query("s16_full_configs", f"""with {TOTAL_SQL}, g as (select * from range(5) t1(a), range(5) t2(b), range(5) t3(c), range(3) t4(d)
   where a + b + c + d > 0 and a + b + c + d < 14),
 seen as (select a_der as a, b_der as b, c_der as c, d_der as d, cnt from tot where c_anc + c_der = 4)
 select g.a as a_der, g.b as b_der, g.c as c_der, g.d as d_der, coalesce(cnt, 0.0) as cnt from g left join seen using (a, b, c, d)""")
def all_configs(spark, sf):
    """Every possible configuration with its count in the data, 0 where unseen."""
    s = combined(spark, sf)
    listed = full_configs(spark, POPS, SAMPLED_N).join(s.df, ["anc", "der"], "left")
    return listed.select(
        *[F.expr(f"bigint(der[{i}]) as {p}_der") for i, p in enumerate(POPS)], F.coalesce("cnt", F.lit(0.0)).alias("cnt")
    )


@query("r4_batches", f"""with {SIMILAR_SQL} select cast(config_id // 100 as bigint) as batch, count(*) as n_configs, sum(cnt) as n_snps
 from ranked_configs group by all""")
def batches(spark, sf):
    s = combined(spark, sf).materialised()
    joined = s.batches(100).join(s.df, ["anc", "der"])
    return joined.groupBy("batch").agg(F.count(F.lit(1)).alias("n_configs"), F.sum("cnt").alias("n_snps"))
