"""Gradient-boosted trees over histograms: best-first growth, an L2 term and a least leaf size, on distributed rows."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.quantiles import exact_quantiles, stacked
from tidemark.sources.scratch import materialise

#: Bins of a feature; tasks whose histograms the driver may add up itself; trees after which the rows' sums are written; rows of a block.
BINS, FEW, KEPT, BLOCK = 255, 16, 25, 1 << 16
#: Rows of equal bins as one, packed: their bins, numbers, sums of labels and sums of leaves, one after the other.
STATE = "bins binary, n binary, y binary, raw binary"


@dataclass(frozen=True)
class Growth:
    """Limits of a model."""

    rounds: int = 200
    rate: float = 0.05
    leaves: int = 15
    least: int = 50
    l2: float = 1.0


@dataclass
class Tree:
    """Nodes in the order in which they were made, parents first; feature -1 marks a leaf, and rows with bin <= `bin` go left."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for own, v in ((self.feature, -1), (self.bin, 0), (self.left, 0), (self.right, 0), (self.value, value)):
            own.append(v)
        return len(self.feature) - 1

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row of bins."""
        node, rows = np.zeros(len(bins), np.int64), {0: np.arange(len(bins))}
        for i, f in enumerate(self.feature):  # parents come first, so each looks at its own rows alone
            here = rows.pop(i)
            if f >= 0:
                low = bins[here, f] <= self.bin[i]
                rows[self.left[i]], rows[self.right[i]] = here[low], here[~low]
            else:
                node[here] = i
        return node


@dataclass(frozen=True)
class Split:
    """The best split of a node, and the sums of gradients and Hessians on its left and in whole."""

    gain: float
    feature: int
    bin: int
    left: tuple[float, float]
    whole: tuple[float, float]


def best_split(feature: int, g: np.ndarray, h: np.ndarray, n: np.ndarray, growth: Growth) -> Split:
    """The split of one feature's histogram with the largest gain, ties to the lower bin; gain -inf where no bin leaves enough rows on both sides."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    whole = float(g.sum()), float(h.sum())
    strength = lambda a, b: a * a / (b + growth.l2)
    gain = np.where((nl >= growth.least) & (n.sum() - nl >= growth.least), strength(gl, hl) + strength(whole[0] - gl, whole[1] - hl) - strength(*whole), -np.inf)
    at = int(gain.argmax()) if len(gain) else 0
    return Split(float(gain[at]), feature, at, (float(gl[at]), float(hl[at])), whole) if len(gain) else Split(-math.inf, feature, 0, whole, whole)


def grow(evaluate: Callable[[Tree, list[int]], dict[int, Split]], growth: Growth) -> Tree:
    """One tree, grown best-first: of all leaves the one with the largest gain is split, until there are `growth.leaves` or none gains.

    evaluate(tree, nodes) finds the best splits of leaves of a tree. A call costs a pass over the rows, so it gets the leaves that growth waits
    for together with the children of those that may be split next: calls follow the depth of the tree, not its leaves.
    """
    tried, known, value = Tree(), {}, lambda s: -growth.rate * s[0] / (s[1] + growth.l2)
    tried.add(0.0)
    leaves, waiting = [0], [0]

    def open_up(node: int) -> list[int]:
        if tried.feature[node] < 0:
            s = known[node]
            rest = s.whole[0] - s.left[0], s.whole[1] - s.left[1]
            tried.left[node], tried.right[node] = tried.add(value(s.left)), tried.add(value(rest))
            tried.feature[node], tried.bin[node] = s.feature, s.bin
        return [tried.left[node], tried.right[node]]

    chosen: set[int] = set()
    while waiting:
        known |= evaluate(tried, waiting)
        if 0 in waiting:
            tried.value[0] = value(known[0].whole)
        while len(leaves) < growth.leaves and all(i in known for i in leaves):
            best = max(leaves, key=lambda i: (known[i].gain, -i))
            if known[best].gain <= 0:
                break
            chosen.add(best)
            leaves.remove(best)
            leaves += open_up(best)
        room = growth.leaves - len(leaves)
        waiting = [i for i in leaves if i not in known] if room else []
        if waiting:
            likely = sorted((i for i in leaves if i in known and known[i].gain > 0), key=lambda i: -known[i].gain)[:room]
            waiting += [c for i in likely for c in open_up(i) if c not in known]
    out, number = Tree(), {}
    order = [0]
    for node in order:  # the splits that were chosen, without those only tried
        number[node] = out.add(tried.value[node])
        order += [tried.left[node], tried.right[node]] if node in chosen else []
    for node in chosen:
        i = number[node]
        out.feature[i], out.bin[i], out.left[i], out.right[i] = tried.feature[node], tried.bin[node], number[tried.left[node]], number[tried.right[node]]
    return out


@dataclass
class Boosted:
    """A fitted model: inputs, what fills their gaps, bin edges by feature, and trees."""

    numeric: list[str]
    medians: dict[str, float]
    levels: dict[str, list[str]]
    edges: list[list[float]]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def features(self, df: DataFrame) -> DataFrame:
        """df with `features`: numerics with their gaps filled, then a flag for each level of each category."""
        own = [F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.lit(self.medians[c])) for c in self.numeric]
        flags = [F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("double") for c, vs in self.levels.items() for v in vs]
        return df.withColumn("features", F.array(*own, *flags))

    def bins(self, column: pa.Array) -> np.ndarray:
        x = column.flatten().to_numpy().reshape(-1, len(self.edges))
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def transform(self, df: DataFrame) -> DataFrame:
        """df with `probability` of the positive class."""
        rows, names, schema = self.features(df), df.columns, T.StructType([*df.schema.fields, T.StructField("probability", T.DoubleType())])

        def run(batches):
            for b in batches:
                bins = self.bins(b.column("features"))
                raw = np.full(len(bins), self.base)
                for t in self.trees:
                    raw += np.array(t.value)[t.place(bins)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(1 / (1 + np.exp(-raw)))], [*names, "probability"])

        return rows.mapInArrow(run, schema)


def bin_edges(df: DataFrame, columns: list[str], bins: int = BINS) -> list[list[float]]:
    """Edges halfway between neighbouring values of each column: of all its values where they are few, else of evenly spaced approximate quantiles."""
    rows = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)])
    at = f"array({', '.join(f'{i / bins!r}D' for i in range(bins + 1))})"
    told = rows.agg(*[F.expr(f"struct(approx_count_distinct(c{i}, 0.02) AS kinds, percentile_approx(c{i}, {at}, 10000) AS at)").alias(f"c{i}") for i in range(len(columns))]).first()
    few = [c for i, c in enumerate(columns) if told[i]["kinds"] <= bins]
    own: dict[str, list[float]] = {c: told[i]["at"] or [] for i, c in enumerate(columns)}
    if few:
        values = stacked(df, few).filter("value IS NOT NULL").distinct().collect()  # about `bins` for each column
        exact = {c: [r.value for r in values if r.feature == c] for c in few}
        own |= {c: v for c, v in exact.items() if len(v) <= bins}
    return [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)][: bins - 1] for v in (sorted(set(own[c])) for c in columns)]


def _packed(grouped: DataFrame, base: float) -> DataFrame:
    """Rows (bins, n, y) as blocks of about BLOCK rows."""

    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        n, y = (t[c].to_numpy().astype(float) for c in ("n", "y"))
        own = [b"".join(t["bins"].to_pylist()), n.tobytes(), y.tobytes(), np.full(len(n), base).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in own], ["bins", "n", "y", "raw"])

    def run(batches):
        waiting, rows = [], 0
        for b in batches:
            waiting, rows = [*waiting, b], rows + b.num_rows
            if rows >= BLOCK:
                yield block(waiting)
                waiting, rows = [], 0
        if rows:
            yield block(waiting)

    return grouped.mapInArrow(run, STATE)


def _blocks(b: pa.RecordBatch, width: int):
    """bins, n, y and raw of each block of a batch."""
    for bins, *numbers in zip(*(b.column(c) for c in ("bins", "n", "y", "raw")), strict=True):
        yield np.frombuffer(bins.as_buffer(), np.uint8).reshape(-1, width), *(np.frombuffer(x.as_buffer(), float) for x in numbers)


def _histograms(state: DataFrame, few: bool, tree: Tree, nodes: list[int], width: int, growth: Growth) -> dict[int, Split]:
    """The best split of each of `nodes`. Tasks sum the cells of histograms (node, feature, bin) that have rows, and Spark adds them up.

    At most nodes x features x bins cells reach the driver, whatever the rows; of few tasks they come as they are.
    """
    rank = np.full(len(tree.feature), -1)
    rank[nodes] = np.arange(len(nodes))
    size, count = BINS + 1, (BINS + 1) * width * len(nodes)

    def sums(batches):
        total = np.zeros((3, count))
        for b in batches:
            for bins, n, y, raw in _blocks(b, width):
                at = rank[tree.place(bins)]
                here = np.flatnonzero(at >= 0)
                bins, n, p = bins[here], n[here], 1 / (1 + np.exp(-raw[here]))
                first, values = at[here] * (width * size), (n * p - y[here], n * p * (1 - p), n)
                for f in range(width):
                    cells = first + bins[:, f] + f * size
                    for own, v in zip(total, values, strict=True):
                        own += np.bincount(cells, v, count)
        full = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(full), *(pa.array(x[full]) for x in total)], ["cell", "g", "h", "n"])

    made = state.mapInArrow(sums, "cell long, g double, h double, n double")
    if not few:
        made = made.groupBy("cell").agg(*[F.sum(c).alias(c) for c in ("g", "h", "n")])
    told = made.toArrow()
    cells, total = told["cell"].to_numpy(), np.zeros((3, count))
    for x, c in zip(total, ("g", "h", "n"), strict=True):
        np.add.at(x, cells, told[c].to_numpy())
    found = {}
    for i, node in enumerate(nodes):
        g, h, n = total.reshape(3, len(nodes), width, size)[:, i]
        splits = [best_split(f, g[f], h[f], n[f], growth) for f in range(width)]
        found[node] = max(splits, key=lambda s: (s.gain, -s.feature))
    return found


def fit(train: DataFrame, numeric: list[str], levels: dict[str, list[str]], label: str, growth: Growth = Growth()) -> Boosted:  # noqa: B008
    """Boost `growth.rounds` trees on the rows of train with a label; levels: the known values of each category, whose flags are features.

    Rows are binned once, those of equal bins made one with their number and sum of labels, and written in blocks; each pass over them makes
    histograms of some nodes at a time. A tree's leaves are added to the rows' sums once, in the first pass of the next tree, and every KEPT
    trees the sums are written. Gaps are filled by exact medians; a column without values counts as 0. No row reaches the driver.
    """
    rows = train.filter(F.col(label).isNotNull())
    medians = {c: 0.0 if v is None else v[0] for c, v in exact_quantiles(rows, numeric, [0.5]).items()} if numeric else {}
    model = Boosted(numeric, medians, levels, bin_edges(rows, numeric) + [[0.5] for v in levels.values() for _ in v] if numeric else [[0.5] for v in levels.values() for _ in v])
    y = F.col(label).cast("double")
    positives, n = rows.agg(F.coalesce(F.sum(y), F.lit(0.0)), F.count(F.lit(1))).first()
    if not 0 < positives < n:
        raise ValueError(f"{positives} of {n} labelled rows are positive: nothing to tell apart")
    model.base, width = math.log(positives / (n - positives)), len(model.edges)

    def binned(batches):
        for b in batches:
            bins = model.bins(b.column("features"))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bins], pa.binary()), b.column("y")], ["bins", "y"])

    grouped = model.features(rows).select("features", y.alias("y")).mapInArrow(binned, "bins binary, y double").groupBy("bins").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    state, old = materialise(_packed(grouped, model.base), "boosting-rows").persist(), None
    few = state.rdd.getNumPartitions() <= FEW
    for r in range(growth.rounds):
        model.trees.append(grow(lambda tree, nodes: _histograms(state, few, tree, nodes, width, growth), growth))  # noqa: B023
        if old is not None:
            old.unpersist()
        old, state = state, _advanced(state, model.trees[-1], width, (r + 1) % KEPT == 0)
    for df in (old, state):
        if df is not None:
            df.unpersist()
    return model


def _advanced(state: DataFrame, tree: Tree, width: int, write: bool) -> DataFrame:
    """The rows with the tree's values added, kept when they are first read; written before if asked, so that no long lineage is kept."""

    def run(batches):
        for b in batches:
            raw = [(raw + np.array(tree.value)[tree.place(bins)]).tobytes() for bins, _, _, raw in _blocks(b, width)]
            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("n"), b.column("y"), pa.array(raw, pa.binary())], ["bins", "n", "y", "raw"])

    after = state.mapInArrow(run, STATE)
    return (materialise(after, "boosting-rows") if write else after).persist()
