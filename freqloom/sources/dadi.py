"""Import of dadi spectrum files: dimensions, bins, mask."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freqloom.functions.configs import int_array_text
from freqloom.operators.spectrum import Spectrum


def read_dadi(spark: SparkSession, path: str) -> Spectrum:
    """Spectrum of one block from a dadi file.

    Bins are row-major; the two monomorphic corners and empty bins are dropped. The mask only decides which bins add to
    the length. A file without "unfolded" in its first line is folded after reading.
    """
    return dadi_from_lines(spark, spark.read.text(path).withColumn("at", F.monotonically_increasing_id()), path)


def dadi_from_lines(spark: SparkSession, lines: DataFrame, name: str) -> Spectrum:
    """The same from ``lines(value, at)``, ordered by ``at``; ``name`` is for messages."""
    lines = lines.where("not startswith(value, '#')")
    # The three lines of the format: a window of three rows.
    numbered = lines.select("value", F.row_number().over(Window.orderBy("at")).alias("line"))
    info = [row.value for row in numbered.where("line = 1 or line = 4").orderBy("line").collect()]
    if len(info) != 1:
        raise ValueError(f"{name} must have three lines besides comments")
    words = info[0].split()
    dims = []
    for word in words:
        if not word.isdigit():
            break
        dims.append(int(word))
    names = [w.replace('"', "") for w in words[len(dims) + 1:]]
    if len(names) != len(dims):
        names = [f"pop{i}" for i in range(len(dims))]
    folded = "un" not in words[len(dims)]

    cells = lambda line, kind, name: numbered.where(f"line = {line}").selectExpr(
        "posexplode(split(trim(value), '\\\\s+')) as (bin, text)"
    ).selectExpr("bin", f"cast(text as {kind}) as {name}")
    bins = cells(2, "double", "cnt")
    length = bins.join(cells(3, "int", "masked"), "bin").where("masked = 0").selectExpr("double(bigint(sum(cnt))) as length")

    digits, radix = [], 1
    for n in reversed(dims):
        digits.insert(0, f"int(bin div {radix} % {n})")
        radix *= n
    rows = bins.where(f"cnt <> 0 and bin > 0 and bin < {radix - 1}").selectExpr(
        "bigint(0) as block", f"array({', '.join(digits)}) as der", "cnt"
    )
    rows = rows.selectExpr(
        "block", f"zip_with({int_array_text([n - 1 for n in dims])}, der, (n, d) -> n - d) as anc", "der", "cnt"
    )
    out = Spectrum(rows, tuple(names), length)
    return out.fold() if folded else out
