"""As-of aggregates by windows over blocks of days: rows that arrive at once are framed, late ones are merged from the day they arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a block, in histories. A row is sent to each block whose anchors may see it: one, or two for one history in so many.
SPAN = 8


def placed_rows(panel: DataFrame, columns: list[str], history: int) -> DataFrame:
    """The panel's rows by (entity_id, _block), each at the day `_at` that it counts from; `_kind` says what a row stands for.

    day: the row itself at its own day, in its own block (where it may be an anchor) and in the next if anchors there see it.
    arrival: a late row once more, at the day it arrives. first: one row for each entity and block, with the entity's first day.
    A row without an arrival date never arrives. Rows sent: 1 + 1 / SPAN + the share of late rows, for each row of the panel.
    """
    day, span = F.unix_date("activity_date"), SPAN * history
    block = lambda d: F.floor(d / F.lit(span)).cast("int")
    seen = F.when(F.col("available_date").isNotNull(), F.greatest(F.date_add("activity_date", 1), F.col("available_date")))
    rows = panel.filter("activity_date IS NOT NULL AND entity_id IS NOT NULL").withColumns({"_day": day, "_seen": F.unix_date(seen)})
    copies = lambda kind, at: F.transform(F.sequence(block(at), block(F.col("_day") + history)), lambda b: F.struct(F.lit(kind).alias("_kind"), b.alias("_block"), at.alias("_at")))
    late = (F.col("_seen") > F.col("_day") + 1) & (F.col("_seen") <= F.col("_day") + history)
    sent = F.concat(copies("day", F.col("_day")), F.when(late, copies("arrival", F.col("_seen"))).otherwise(F.array()))
    placed = rows.select("entity_id", "activity_date", "available_date", *columns, "_day", "_seen", F.inline(sent))
    # An entity has few blocks, so its first day is found among their first days: no task sees an entity's rows.
    blocks = rows.groupBy("entity_id", block(F.col("_day")).alias("_block")).agg(F.min("_day").alias("_first"))
    firsts = blocks.withColumn("_first", F.min("_first").over(Window.partitionBy("entity_id")))
    firsts = firsts.select("entity_id", "_block", F.lit("first").alias("_kind"), F.col("_first").alias("_at"))
    return placed.unionByName(firsts, allowMissingColumns=True)


class _Frames:
    """Aggregates over what an anchor sees: a window frame of the rows that came at once, and an array of late ones that have arrived."""

    def __init__(self, history: int, recent: int):
        self.days = {"all": (1, history), "recent": (1, recent), "prior": (recent + 1, 2 * recent)}
        self.order = Window.partitionBy("entity_id", "_block").orderBy("_at")
        self.arrived = self.order.rangeBetween(-(history - 1), 0)
        self.prompt = (F.col("_kind") == "day") & (F.col("_seen") <= F.col("_day") + 1)

    def frame(self, how: Callable[[Column], Column], value: Column, window: str) -> Column:
        """`how` over the rows of the window that came at once."""
        low, high = self.days[window]
        return how(F.when(self.prompt, value)).over(self.order.rangeBetween(-high, -low))

    def late(self, array: Column, window: str) -> Column:
        """The late rows of the window that have arrived."""
        low, high = self.days[window]
        return F.filter(array, lambda x: (F.col("_day") - x["_day"]).between(low, high))


def features_by_arrival(panel: DataFrame, metrics: Iterable, kept: list[str], history: int, recent: int, types: dict[str, str]) -> DataFrame:
    """entity_id, prediction_date, the columns `kept`, each metric and the coverage columns, for every anchor; see panel.asof_features.

    types: the type of each metric. One shuffle by entity and block of days and one sort serve all metrics; there is no join. Sums and
    counts of both parts are added, moments are merged about their means, and of values the latest is taken.
    """
    metrics = list(metrics)
    used = sorted({m.column for m in metrics if m.column})
    rows = placed_rows(panel, list(dict.fromkeys([*kept, *used])), history)
    frames = _Frames(history, recent)
    fields = F.struct("_day", "activity_date", "available_date", *used)
    made: dict[str, Column] = {
        "_first": F.max(F.when(F.col("_kind") == "first", F.col("_at"))).over(Window.partitionBy("entity_id", "_block")),
        "_late": F.collect_list(F.when(F.col("_kind") == "arrival", fields)).over(frames.arrived),
        "_n": frames.frame(F.count, F.col("_day"), "all"), "_last": frames.frame(F.max, F.col("activity_date"), "all"), "_arrived": frames.frame(F.max, F.col("available_date"), "all"),
    }
    for i, m in enumerate(metrics):
        value = F.col(m.column) if m.column and m.how != "count" else F.lit(1)
        value = {"true": F.when(value, 1), "positive": F.when(value > 0, 1)}.get(m.how, value)
        if m.how in ("sum", "min", "max"):
            made[f"_m{i}"] = frames.frame(getattr(F, m.how), value, m.window)
        elif m.how == "latest":
            made[f"_m{i}"] = frames.frame(F.max, F.when(value.isNotNull(), F.struct("_day", value.alias("v"))), m.window)
        else:
            made[f"_m{i}"] = frames.frame(F.count, value, m.window)
        if m.how in ("avg", "std"):
            made[f"_s{i}"] = frames.frame(F.sum, value, m.window)
        if m.how == "std":
            made[f"_v{i}"] = frames.frame(F.var_pop, value, m.window)
    anchors = rows.withColumns(made).filter((F.col("_kind") == "day") & (F.col("_block") == F.floor(F.col("_day") / F.lit(SPAN * history))) & (F.col("_day") >= F.col("_first") + history))
    windows = dict.fromkeys(m.window for m in metrics) | {"all": None}
    anchors = anchors.withColumns({f"_late_{w}": frames.late(F.col("_late"), w) for w in windows})
    values = {(m.column, m.window) for m in metrics if m.column}
    anchors = anchors.withColumns({f"_x_{w}_{c}": _values(f"_late_{w}", c) for c, w in values})
    anchors = anchors.withColumns({f"_t{i}": _added(F.col(f"_x_{m.window}_{m.column}"), "double") for i, m in enumerate(metrics) if m.how in ("avg", "std")})
    told = {m.name: _merged(i, m, types[m.name]) for i, m in enumerate(metrics)}
    late = F.col("_late_all")
    told |= {
        "available_days": F.col("_n") + F.size(late), "max_activity_date": F.greatest("_last", F.array_max(F.transform(late, lambda x: x["activity_date"]))),
        "max_available_date": F.greatest("_arrived", F.array_max(F.transform(late, lambda x: x["available_date"]))),
    }
    return anchors.select("entity_id", F.col("activity_date").alias("prediction_date"), *kept, *[v.alias(n) for n, v in told.items()])


def _values(rows: str, column: str) -> Column:
    """The values of a field of some rows that are not null."""
    return F.filter(F.transform(rows, lambda x: x[column]), lambda v: v.isNotNull())


def _added(array: Column, kind: str) -> Column:
    return F.aggregate(array, F.lit(0).cast(kind), lambda a, x: (a + x.cast(kind)).cast(kind))


def _merged(i: int, m, kind: str) -> Column:
    """A metric from its frame over prompt rows (_m, _s, _v) and the values of its late rows."""
    own = F.col(f"_m{i}")
    rows, x = F.col(f"_late_{m.window}"), F.col(f"_x_{m.window}_{m.column}") if m.column else None
    if m.how == "latest":
        late = F.array_max(F.transform(F.filter(rows, lambda r: r[m.column].isNotNull()), lambda r: F.struct(r["_day"].alias("_day"), r[m.column].alias("v"))))
        return F.greatest(own, late)["v"]
    if m.how in ("min", "max"):
        return (F.least if m.how == "min" else F.greatest)(own, F.array_min(x) if m.how == "min" else F.array_max(x))
    if m.how == "sum":
        return F.when(own.isNotNull() | (F.size(x) > 0), (F.coalesce(own, F.lit(0).cast(kind)) + _added(x, kind)).cast(kind))
    if m.how == "count":
        return own + F.size(rows)
    if m.how in ("true", "positive"):
        return own + F.size(F.filter(x, lambda v: v if m.how == "true" else v > 0))
    n, late_n = own + F.size(x), F.size(x)
    if m.how == "observed":
        return n
    if m.how == "avg":
        return F.when(n > 0, (F.coalesce(F.col(f"_s{i}").cast("double"), F.lit(0.0)) + F.col(f"_t{i}")) / n).cast(kind)
    mean, late_mean = F.try_divide(F.col(f"_s{i}").cast("double"), own), F.try_divide(F.col(f"_t{i}"), late_n)
    squares = F.coalesce(F.col(f"_v{i}") * own, F.lit(0.0)) + F.when(late_n > 0, F.aggregate(x, F.lit(0.0), lambda a, v: a + (v.cast("double") - late_mean) * (v.cast("double") - late_mean))).otherwise(0.0)
    apart = F.when((own > 0) & (late_n > 0), (late_mean - mean) * (late_mean - mean) * own * late_n / n).otherwise(0.0)
    return F.when(n > 1, F.sqrt((squares + apart) / (n - 1)))
