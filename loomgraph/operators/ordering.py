"""Windows, ranking and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, discard

MONEY, CHUNK = "decimal(28,6)", 14


def summarize_turns(turns: DataFrame, keep: int = 6, size: int = 80) -> DataFrame:
    """The last ``keep`` turns of a conversation whole, older ones shortened."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc(), F.col("text"))
    recent = F.row_number().over(w) <= keep
    return turns.withColumn("kept", recent).withColumn("summary", F.when(F.col("kept"), F.col("text")).otherwise(F.substring("text", 1, size)))


def pack(items: DataFrame, budget: int, keys: list[str]) -> DataFrame:
    """Items in priority order within a budget of characters; the one that
    crosses it is cut, later ones are left out. Repeats of a trimmed text count
    once. items: keys, ord, text, priority."""
    text = F.trim("text")
    one = items.where(F.length(text) > 0).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, text).orderBy(F.col("priority").desc(), "ord"))).where("_rank = 1")
    w = Window.partitionBy(*keys).orderBy(F.col("priority").desc(), "ord")
    before = F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = one.withColumn("_before", before).where(F.col("_before") < budget)
    return placed.withColumn("packed", F.expr(f"substring(text, 1, cast({budget} - _before as int))")).drop("_rank", "_before")


def _one_phase(live: DataFrame) -> DataFrame:
    """live (_group, _pos, _cost, _left) with _first: what is taken before _left
    is below the power of two under it, and whether the phase ends there.

    Tasks of at least that power are big: once one is taken, less than the power
    is left, so one at most is taken in a phase. Small ones all fit until then.
    The phase ends with the first big task that fits beside the small ones before
    it, or with the small one that leaves less than the power. Sums run over
    chunks of positions, then within them: no task has all of a group.
    """
    half = F.pow(F.lit(2.0), F.floor(F.log2(F.col("_left").cast("double")))).cast(MONEY)
    sized = live.withColumns({"_half": half, "_chunk": F.shiftright("_pos", CHUNK)}).withColumn("_small", F.col("_cost") < F.col("_half"))
    amount = F.when(F.col("_small"), F.col("_cost")).otherwise(F.lit(0).cast(MONEY))
    by_chunk = sized.groupBy("_group", "_chunk").agg(F.sum(amount).alias("_sum"))
    ahead = Window.partitionBy("_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = by_chunk.withColumn("_base", F.coalesce(F.sum("_sum").over(ahead), F.lit(0).cast(MONEY))).drop("_sum")
    inside = Window.partitionBy("_group", "_chunk").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_left") - F.col("_base") - F.coalesce(F.sum(amount).over(inside), F.lit(0).cast(MONEY))
    ends = (~F.col("_small") & (F.col("_cost") <= F.col("_room"))) | (F.col("_small") & (F.col("_room") - F.col("_cost") < F.col("_half")))
    return sized.join(base, ["_group", "_chunk"]).withColumn("_room", room).withColumn("_ends", ends).drop("_half", "_chunk", "_base", "_room")


def greedy_fill(tasks: DataFrame, budget: float, keys: list[str]) -> DataFrame:
    """Tasks by lift per effort that still fit, skipping those that don't; ties
    by lift, then id. tasks: keys, id, effort, lift. Efforts count to a millionth;
    tasks without a positive effort fall out.

    A fold in order, done for all groups at once in as many phases as the budget
    has powers of two above the least effort (:func:`_one_phase`).
    """
    names = [*keys, "id", "effort", "lift"]
    order = [F.col("_group"), F.col("_rate").desc(), F.col("lift").desc(), F.col("id")]
    rated = tasks.select(*names).withColumns({"_group": F.to_json(F.struct(*keys)), "_rate": F.col("lift") / F.col("effort"), "_cost": F.col("effort").cast(MONEY)}).where("_cost > 0")
    placed = cut(rated.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()).drop("_rate"), "tasks")
    if budget == float("inf"):
        return placed.select(*names)
    live, parts = placed.withColumn("_left", F.lit(budget).cast(MONEY)).where("_cost <= _left"), []
    while not live.isEmpty():
        marked = cut(_one_phase(live), "phase")
        stop = marked.where("_ends").groupBy("_group").agg(F.min("_pos").alias("_stop"))
        at = marked.join(stop, "_group", "left")
        parts.append(cut(at.where("_pos = _stop or (_small and (_stop is null or _pos < _stop))").select("_group", "_stop", "_cost", "_left", *names), "taken"))
        discard(marked)
        rest = parts[-1].where("_stop is not null").groupBy("_group", "_stop", "_left").agg(F.sum("_cost").alias("_spent"))
        rest = cut(rest.select("_group", "_stop", (F.col("_left") - F.col("_spent")).cast(MONEY).alias("_left")), "left")
        live = placed.join(rest, "_group").where("_pos > _stop and _cost <= _left").drop("_stop")
    out = placed.select(*names).limit(0)
    for part in parts:
        out = out.unionByName(part.select(*names))
    return out


def repeated_failures(attempts: DataFrame) -> DataFrame:
    """Attempts that fail as the one before did. attempts: run, attempt, signature."""
    w = Window.partitionBy("run").orderBy("attempt")
    return attempts.withColumn("repeated", F.coalesce(F.col("signature") == F.lag("signature").over(w), F.lit(False)))


def previous_delta(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Change of a value against the row before."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def debounce(events: DataFrame, key: str, at: str, gap_s: float) -> DataFrame:
    """Bursts of events less than ``gap_s`` apart: burst, first, last, n."""
    w = Window.partitionBy(key).orderBy(at)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    new = F.coalesce((micros - F.lag(micros).over(w)) >= int(gap_s * 1e6), F.lit(True))
    marked = events.withColumn("burst", F.sum(new.cast("int")).over(w.rangeBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(key, "burst").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of a full order."""
    return df.orderBy(*order).limit(k)
