"""Numbers that do not depend on how rows are partitioned: exact sums, exact quantiles, and rounding of a double's exact value.

A double is an integer times a power of two. :func:`exact_means` sorts values into bins of 32 binary exponents and adds, per bin, two integer parts of them, all of it by built-in
aggregates; the few bins of a group are put together as one big integer and rounded once. :func:`order_statistics` narrows the range that holds a rank by bounded histograms. :func:`half_even`
finds by an error-free product on which side of a tie a double lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Binary exponents of a bin, the place of a bin's unit below its exponent, and the bits of the lower part.
BIN, BELOW, LOWER = 32, 54, 44
LOWEST_BIN = -34
#: Stands for the bin of values that are not finite.
NOT_FINITE = 1 << 20
#: Bits of the pieces that are added as longs: some 2^33 rows of a group can be.
LIMB = 30


def _bin(x: Column) -> Column:
    size = F.abs(x)
    whole = size < float("inf")
    # An exponent that the logarithm gets wrong by one is no harm: there is room for it on either side.
    return F.when(whole & (size > 0), F.floor(F.log2(size) / BIN)).when(whole, F.lit(0)).otherwise(F.lit(NOT_FINITE)).cast("int")


def _unit(x: Column, at: Column) -> Column:
    """x in units of its bin: powers of two are exact, and two of them in turn neither overflow nor lose a bit."""
    shift = BELOW - BIN * at
    first = F.floor(shift / 2)
    return F.when(at != NOT_FINITE, x * F.pow(F.lit(2.0), first) * F.pow(F.lit(2.0), shift - first)).otherwise(F.lit(0.0))


def _high(unit: Column) -> Column:
    return F.floor(unit / float(1 << LOWER))


def _low(unit: Column, high: Column) -> Column:
    return (unit - high.cast("double") * float(1 << LOWER)).cast("long")


def exact_parts(x: Column) -> Column:
    """bin, high, low: x is (high * 2^LOWER + low) * 2^(BIN * bin - BELOW), exactly; both parts are longs below 2^45."""
    at = _bin(x)
    unit = _unit(x, at)
    high = _high(unit)
    return F.struct(at.alias("bin"), high.alias("high"), _low(unit, high).alias("low"))


def bin_sums(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, name, bin, high, low, n: exact sums of the parts of all values that are not null.

    Each row adds to one group, that of its keys and of its values' bins, and every step reads columns of the one before, so that nothing is worked out twice. Parts are cut into limbs, which add up as longs.
    """
    names = list(values)
    each = lambda make: {f"{c}_{i}": x for i in range(len(names)) for c, x in make(i).items()}
    of = lambda c, i: F.col(f"__{c}_{i}")
    bits = F.lit((1 << LIMB) - 1).cast("long")
    parts = rows.select(*keys, *(x.cast("double").alias(f"__x_{i}") for i, x in enumerate(values.values())))
    parts = parts.withColumns(each(lambda i: {"__bin": _bin(of("x", i))}))
    parts = parts.withColumns(each(lambda i: {"__unit": _unit(of("x", i), of("bin", i))}))
    parts = parts.withColumns(each(lambda i: {"__high": _high(of("unit", i))}))
    parts = parts.withColumns(each(lambda i: {"__low": _low(of("unit", i), of("high", i))}))
    limbs = {"h1": lambda i: F.shiftright(of("high", i), LIMB), "h0": lambda i: of("high", i).bitwiseAND(bits), "l1": lambda i: F.shiftright(of("low", i), LIMB), "l0": lambda i: of("low", i).bitwiseAND(bits)}
    sums = [c for i in range(len(names)) for c in (*(F.sum(x(i)).alias(f"__{n}_{i}") for n, x in limbs.items()), F.count(of("x", i)).alias(f"__n_{i}"))]
    held = parts.groupBy(*keys, *(f"__bin_{i}" for i in range(len(names)))).agg(*sums)
    whole = lambda c, i: (of(f"{c}1", i).cast("decimal(38,0)") * F.lit(1 << LIMB) + of(f"{c}0", i)).cast("decimal(38,0)")
    table = F.array(*(F.struct(F.lit(name).alias("name"), of("bin", i).alias("bin"), whole("h", i).alias("high"), whole("l", i).alias("low"), of("n", i).alias("n")) for i, name in enumerate(names)))
    return add_bins(held.select(*keys, F.explode(table).alias("v")).where("v.n > 0").select(*keys, "v.*"), [*keys, "name", "bin"])


def add_bins(parts: DataFrame, keys: list[str]) -> DataFrame:
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    return parts.groupBy(*keys).agg(whole("high"), whole("low"), F.sum("n").alias("n"))


def rounded_sums(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, n, total: the bins of each group as one integer, rounded once to a double (NaN if a value is not finite)."""
    held = parts.groupBy(*keys, "name").agg(F.collect_list(F.struct("bin", F.col("high").cast("string").alias("high"), F.col("low").cast("string").alias("low"))).alias("bins"), F.sum("n").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals = [total_of([(b["bin"], int(b["high"]), int(b["low"])) for b in bins.as_py()]) for bins in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(totals, pa.float64())], names=[*batch.schema.names[1:], "total"])

    rows = held.select("bins", *keys, "name", "n")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(run, f"{schema}, total double")


def total_of(bins: list[tuple[int, int, int]]) -> float:
    """The double nearest to the sum of the bins."""
    if any(b == NOT_FINITE for b, _, _ in bins):
        return float("nan")
    total = sum(((high << LOWER) + low) << (BIN * (b - LOWEST_BIN)) for b, high, low in bins)
    return total / (1 << (BELOW - BIN * LOWEST_BIN))  # division of integers rounds correctly


def wide(sums: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """One row a group: n of each name as n_<name>, and its exact mean as <name>."""
    pick = lambda name, x: F.max(F.when(F.col("name") == name, x))
    columns = [c for name in names for c in (pick(name, F.col("n")).alias(f"n_{name}"), pick(name, F.col("total") / F.col("n")).alias(name))]
    return sums.groupBy(*keys).agg(*columns) if keys else sums.agg(*columns)


def exact_means(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """keys, n_<name> and <name>: for each value the rounded exact sum over its count, the same bit for bit whatever the order of rows."""
    return wide(rounded_sums(bin_sums(rows, keys, values), keys), keys, list(values))


# ---- quantiles

#: Buckets of a histogram, and values of a range that are looked at one by one.
BUCKETS, FEW = 1024, 4096


def order_statistics(rows: DataFrame, columns: list[str], ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """(column, rank) -> the value of that rank from 0 among the column's values that are neither null nor NaN.

    Ranges are narrowed by histograms, first of exponents (binades), then of equal widths; what reaches the driver is ``BUCKETS`` rows or ``FEW`` values for each rank and round.
    """
    value = F.struct
    long = rows.select(F.explode(F.array(*(value(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns))).alias("v")).select("v.name", "v.x").where("x is not null and not isnan(x)")
    spark = rows.sparkSession
    found: dict[tuple[str, int], float] = {}
    # Round one: all columns at once, by sign and exponent, which rise with the value.
    size = F.abs(F.col("x"))
    exponent = F.when(size == 0, F.lit(0)).when(size < float("inf"), F.floor(F.log2(size)) + 1080).otherwise(F.lit(4000))
    cells = long.groupBy("name", (F.when(F.col("x") < 0, -1).otherwise(1) * exponent).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
    open_ = {}
    for name, wanted in ranks.items():
        own = sorted((r.bucket, r.n, r.low, r.high) for r in cells if r.name == name)
        for rank in wanted:
            open_[name, rank] = _narrowed(own, rank)
    while open_:
        for key, (_, low, high, _) in list(open_.items()):
            if low == high:
                found[key] = low
                del open_[key]
        if not open_:
            break
        goals = [(name, rank, low, high, n <= FEW) for (name, rank), (_, low, high, n) in open_.items()]
        asked = F.broadcast(spark.createDataFrame(goals, "name string, rank long, low double, high double, few boolean"))  # a row for each rank asked for
        near = long.join(asked, "name").where("x >= low and x <= high")
        # Both steps rise with x, rounding included, so a bucket is a range.
        step = F.least(F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * BUCKETS), F.lit(BUCKETS - 1))
        cells = near.groupBy("name", "rank", F.when(F.col("few"), F.lit(-1)).otherwise(step).cast("long").alias("bucket"), F.when(F.col("few"), F.col("x")).alias("only")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect()
        for (name, rank), (left, *_, n) in list(open_.items()):
            own = sorted(((r.only, r.n, r.low, r.high) if n <= FEW else (r.bucket, r.n, r.low, r.high)) for r in cells if (r.name, r.rank) == (name, rank))
            open_[name, rank] = _narrowed(own, left)
    return found


def _narrowed(cells: list[tuple], rank: int) -> tuple[int, float, float, int]:
    """The rank within the cell that holds it, and the cell's range and count."""
    for _, n, low, high in cells:
        if rank < n:
            return rank, low, high, n
        rank -= n
    raise IndexError("the rank is beyond the values")


def exact_quantiles(rows: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """column -> its quantiles with linear interpolation (None without values)."""
    counts = rows.agg(*(F.count(F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")), F.lit(1))).alias(f"n{i}") for i, c in enumerate(columns))).first()
    places = {c: [(counts[i] - 1) * q for q in shares] for i, c in enumerate(columns) if counts[i]}
    ranks = {c: sorted({int(p) + up for p in at for up in (0, 1) if up == 0 or p > int(p)}) for c, at in places.items()}
    values = order_statistics(rows, list(places), ranks) if places else {}
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if c not in places:
            out[c] = [None] * len(shares)
            continue
        out[c] = []
        for p in places[c]:
            low, share = int(p), p - int(p)
            out[c].append(values[c, low] if share == 0 else values[c, low] * (1 - share) + values[c, low + 1] * share)
    return out


# ---- rounding

_SPLIT = float((1 << 27) + 1)


def half_even(x: Column, digits: int = 10) -> Column:
    """x rounded to ``digits`` decimals as its exact binary value lies, true ties to even; what is not finite is an error."""
    if not 0 <= digits <= 22:
        raise ValueError("10 to the digits must be a double without an error")
    scale = float(10**digits)
    upper = _SPLIT * scale - (_SPLIT * scale - scale)
    lower = scale - upper
    product = x * scale
    wide_x = x * _SPLIT
    x_upper = wide_x - (wide_x - x)
    x_lower = x - x_upper
    # product + error is x * scale without rounding.
    error = ((x_upper * upper - product) + x_upper * lower + x_lower * upper) + x_lower * lower
    near = F.rint(product)
    off = product - near
    up, down = F.lit(1.0), F.lit(-1.0)
    tie = F.when((off == 0.5) & (error > 0), near + up).when((off == -0.5) & (error < 0), near + down).otherwise(near)
    # From 2^52 on products are whole and the error is all that is left of the fraction.
    odd = F.pmod(near, F.lit(2.0)) == 1
    beyond = F.when((F.abs(error) == 0.5) & odd, near + F.when(error > 0, up).otherwise(down)).otherwise(near)
    whole = F.when(F.abs(product) < float(1 << 52), tie).otherwise(beyond)
    value = F.when(F.abs(product) >= float(1 << 53), x).otherwise(whole / scale)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.raise_error(F.lit("a published number must be finite")).cast("double")).otherwise(value)
