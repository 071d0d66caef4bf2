"""Traits of stocks by month, and factors from sorts on them.

A trait of a month uses what is known at its end. Factors are spreads of value-weighted legs from
double sorts on size and a trait, as in the published factors; returns are those of the month after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Months of the momentum window before the one that is skipped, and how many of them must have a return.
MOMENTUM, LEAST = 11, 8


def month_number(month: Column) -> Column:
    return F.year(month) * 12 + F.month(month)


def compounded(ret: str, first: int, last: int, by: str = "symbol", month: str = "month", least: int = 1) -> Column:
    """The return over the months from `first` to `last` before a row's own, compounded; null with fewer than `least` known ones.

    The frame is a range of months, not of rows, so a gap is a month without a return. A total loss is -1.
    """
    frame = Window.partitionBy(by).orderBy(month_number(F.col(month))).rangeBetween(-first, -last)
    known = F.count(ret).over(frame)
    ruined = F.coalesce(F.max((F.col(ret) <= -1).cast("int")).over(frame), F.lit(0)) == 1
    grown = F.exp(F.sum(F.when(F.col(ret) > -1, F.log1p(ret))).over(frame)) - 1
    return F.when(known >= least, F.when(ruined, -1.0).otherwise(grown))


def traits(cells: DataFrame, book: DataFrame | None = None, momentum: int = MOMENTUM, least: int = LEAST, keep: tuple[str, ...] = ()) -> DataFrame:
    """(month, symbol, cap, size, value, mom, str, keep...) of cells (month, symbol, px, shares, ret), a row a cell.

    cap is px * shares, size its logarithm, value the logarithm of the last known book equity (book: symbol,
    month from which it is known, equity) over cap; what is not over 0 has none. mom compounds the returns of
    `momentum` months before the last one, which is skipped; str is the last month's own return. Columns named in `keep` go along.
    """
    rows = cells.select("month", "symbol", "ret", (F.col("px") * F.col("shares")).alias("cap"), *keep).withColumn("mom", compounded("ret", momentum, 1, least=least))
    if book is None:
        valued = rows.withColumn("equity", F.lit(None).cast("double"))
    else:
        known = book.select(F.col("month").alias("month"), "symbol", F.col("equity").cast("double").alias("equity"), F.lit(None).cast("double").alias("ret"), F.lit(None).cast("double").alias("cap"), F.lit(None).cast("double").alias("mom"), F.lit(False).alias("cell"), *[F.lit(None).cast(cells.schema[k].dataType).alias(k) for k in keep])
        both = rows.withColumns({"equity": F.lit(None).cast("double"), "cell": F.lit(True)}).unionByName(known)
        before = Window.partitionBy("symbol").orderBy("month", "cell").rowsBetween(Window.unboundedPreceding, 0)
        valued = both.withColumn("equity", F.last("equity", ignorenulls=True).over(before)).where("cell")
    positive = lambda c: F.when(c > 0, F.log(c))
    return valued.select("month", "symbol", "cap", positive(F.col("cap")).alias("size"), positive(F.try_divide("equity", "cap")).alias("value"), "mom", F.col("ret").alias("str"), *keep)


def built_factors(given: DataFrame, legs: dict[str, str], size_by: str) -> DataFrame:
    """(month, mkt, smb, one column a leg) of given (month, symbol, cap, ret, traits...): legs name a trait each, size_by is what smb is sorted with.

    ret is the return of the month after a row's month, whose traits it must not contain; rows without it or a cap are left out. mkt is the
    return of all, weighted by cap. Those with a trait are sorted twice, into halves by cap and into tenths by the trait (ties go by symbol);
    a corner is weighted by cap. A leg is high (the upper three tenths) less low (the lower three), each the mean of small and big; smb is small
    less big, each the mean of low, middle and high. An empty corner counts on neither side; without a corner on one side there is no factor.

    given is read once: a row goes on once for each of its traits, and each month of a trait is sorted by itself.
    """
    traits_ = list(dict.fromkeys([*legs.values(), size_by]))
    values = [F.struct(F.lit(i).alias("trait"), F.col(t).cast("double").alias("v")) for i, t in enumerate(traits_)]
    all_ = F.struct(F.lit(-1).alias("trait"), F.lit(None).cast("double").alias("v"))
    kept = F.filter(F.array(all_, *values), lambda x: (x["trait"] == -1) | x["v"].isNotNull())
    rows = given.where("ret IS NOT NULL AND cap > 0").select("month", "symbol", F.col("cap").cast("double").alias("cap"), F.col("ret").cast("double").alias("ret"), F.explode(kept).alias("_x")).select("month", "symbol", "cap", "ret", "_x.trait", "_x.v")
    own = Window.partitionBy("month", "trait")
    rows = rows.withColumns({"half": F.ntile(2).over(own.orderBy("cap", "symbol")), "part": F.ntile(10).over(own.orderBy("v", "symbol"))})
    third = F.when(F.col("part") <= 3, 0).when(F.col("part") <= 7, 1).otherwise(2)
    corners = rows.groupBy("month", "trait", "half", third.alias("third")).agg(F.sum(F.col("cap") * F.col("ret")).alias("s"), F.sum("cap").alias("c"))
    r = F.try_divide("s", "c")
    mean = lambda at: F.avg(F.when(at, r))
    total = lambda c: F.sum(F.when(F.col("trait") == -1, F.col(c)))
    side = lambda t, third: mean((F.col("trait") == traits_.index(t)) & (F.col("third") == third))
    size = lambda half: mean((F.col("trait") == traits_.index(size_by)) & (F.col("half") == half))
    return corners.groupBy("month").agg((total("s") / total("c")).alias("mkt"), (size(1) - size(2)).alias("smb"), *[(side(t, 2) - side(t, 0)).alias(name) for name, t in legs.items()])
