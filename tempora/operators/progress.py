"""Progress logs of plans: fractions that never fall, and the time that is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SO_FAR = (Window.unboundedPreceding, 0)


def monotone_progress(log: DataFrame) -> DataFrame:
    """The log (plan, seq, stage, fraction, at_s) with fractions inside 0 to 1 that never fall within a stage."""
    own = Window.partitionBy("plan", "stage").orderBy("seq").rowsBetween(*SO_FAR)
    return log.withColumn("fraction", F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fraction"))).over(own))


def remaining_seconds(log: DataFrame, stages: DataFrame, least_s: float = 1.0) -> DataFrame:
    """(plan, seq, stage, remaining_s) of log rows (plan, seq, stage, fraction, at_s) whose stage is in ``stages`` (plan, stage, start, span).

    A stage's own rate counts after ``least_s``; stages that were seen to end give the plan's usual rate, once each. The rate of later stages moves
    from the usual to the own one over the first quarter of a stage. Null while nothing is known.
    """
    rows = log.join(stages, ["plan", "stage"])
    order = Window.partitionBy("plan").orderBy("seq")
    changed = F.coalesce((F.col("stage") != F.lag("stage").over(order)).cast("int"), F.lit(0))
    rows = rows.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(*SO_FAR)))
    run = Window.partitionBy("plan", "run").orderBy("seq").rowsBetween(*SO_FAR)
    rows = rows.withColumn("f", F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "fraction"))).over(run)).withColumn("elapsed", F.greatest(F.lit(0.0), F.col("at_s") - F.first("at_s").over(run)))
    enough = F.col("elapsed") >= least_s
    ends = (F.col("f") >= 1) & enough
    rows = rows.withColumn("ends", ends.cast("int")).withColumn("nth", F.sum("ends").over(Window.partitionBy("plan", "stage").orderBy("seq").rowsBetween(*SO_FAR)))
    first = (F.col("ends") == 1) & (F.col("nth") == 1)
    total = lambda c: F.sum(F.when(first, F.col(c))).over(order.rowsBetween(*SO_FAR))
    rows = rows.withColumn("usual", F.when(total("span") > 0, total("elapsed") / total("span"))).withColumn("own", F.when(enough & (F.col("f") > 0), F.col("elapsed") / (F.col("span") * F.col("f"))))
    trust, later = F.least(F.lit(1.0), F.col("f") / 0.25), F.greatest(F.lit(0.0), 1 - F.col("start") - F.col("span"))
    now = F.col("span") * (1 - F.col("f")) * F.coalesce("own", "usual")
    then = F.coalesce(F.col("usual") * (1 - trust) + F.col("own") * trust, "own", "usual")
    left = F.when(F.col("f") >= 1, F.when(later <= 1e-9, 0.0).otherwise(later * F.col("usual"))).otherwise(F.when(F.coalesce("own", "usual").isNotNull(), F.greatest(F.lit(1.0), now + later * then)))
    return rows.select("plan", "seq", "stage", F.ceil(left).cast("bigint").alias("remaining_s"))
