"""Streamed VCF files give the same sites as a batch read."""

from freqloom.sources.vcf import read_vcf
from freqloom.streaming.sites import append_sites, arriving_sites, running_config_counts

TOP = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
IND2POP = {"s1": "A", "s2": "B"}


def record(k):
    return f"1\t{k}\t.\tA\tT\t.\t.\tAA={'AT'[k % 2]}\tGT\t{k % 2}/{k % 3 % 2}\t{k % 2}/1\n"


def key(df):
    return sorted((r.position, tuple(r.anc), tuple(r.der)) for r in df.collect())


def test_stream_matches_batch(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    header = TOP.splitlines()[1]
    for part in range(3):
        (tmp_path / "in" / f"{part}.vcf").write_text(TOP + "".join(record(k) for k in range(10 * part, 10 * part + 10)))
        append_sites(arriving_sites(spark, folder, header, IND2POP), out, state).awaitTermination()
    batch = read_vcf(spark, folder, IND2POP).df
    assert key(spark.read.parquet(out)) == key(batch)

    counts = running_config_counts(arriving_sites(spark, folder, header, IND2POP))
    query = counts.writeStream.format("memory").queryName("running_counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(tuple(r.anc), tuple(r.der)): r.n_sites for r in spark.table("running_counts").collect()}
    want = {(tuple(r.anc), tuple(r.der)): r["count"] for r in batch.groupBy("anc", "der").count().collect()}
    assert got == want
