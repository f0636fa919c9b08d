"""Decision tree on table columns, grown level by level from aggregates over all rows.

Numbers are cut into bins once, nominal columns keep their values. The growing rows are a table with the
node that each one is in; a level is one histogram by node, column, value and class, from which joins and
windows pick each node's split, and a join that hands the rows on. Nothing of the rows' size, and no list
of nodes, reaches the driver, so neither the rows nor the tree are bounded by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelkite.operators.mixed_bayes import split_kinds
from labelkite.operators.rows import hash_split
from labelkite.operators.skew import dense_index, small_rows
from labelkite.operators.vocab import MAX_CLASSES
from labelkite.shared import forget, written

LOW, HIGH = "low", "high"
ROOT = 0
DIGITS = 9  # gains that differ by less are ties


@dataclass(frozen=True)
class TreeModel:
    """``nodes`` is a stored table ``(node, depth, column, edge, branches)`` of the nodes that split.

    ``branches`` leads from a key to ``(child, label)``: a nominal column's value, or whether a number is
    at most ``edge`` (low) or above it (high). ``label`` is the root's most frequent class.
    """

    nodes: DataFrame
    label: str
    numeric: list[str]
    nominal: list[str]
    depth: int
    prediction: str


def number_bins(df: DataFrame, numeric: list[str], max_bins: int) -> DataFrame:
    """``(column, bin, low, high)``: bins of about equal numbers of rows, ``max_bins`` of a column at most.

    A column with no more than ``max_bins`` values has one bin for each. A value lies in one bin, whose
    number is the share of rows below it, times ``max_bins``; bins that no value falls into are left out.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in numeric]))
    values = df.select(cells.alias("_c")).select("_c.*").where("x is not null and not isnan(x)").groupBy("column", "x").agg(F.count("*").alias("n"))
    ordered = dense_index(values, ["column", "x"], "rank")
    # Runs of the order, so that no task sums up a whole column.
    ordered = written(ordered.withColumn("part", F.shiftright("rank", 16)), "bin-values")
    inside = Window.partitionBy("part", "column").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    sums = ordered.groupBy("column", "part").agg(F.sum("n").alias("rows"), F.min("x").alias("first"))
    before = Window.partitionBy("column").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("column", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    totals = ordered.groupBy("column").agg(F.sum("n").alias("total"), F.count("*").alias("values"), F.min("rank").alias("start"))
    below = F.col("offset") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    placed = ordered.join(F.broadcast(offsets), ["column", "part"]).withColumn("below", below).join(F.broadcast(totals), "column")
    number = F.when(F.col("values") <= max_bins, F.col("rank") - F.col("start")).otherwise(F.floor(F.col("below") * max_bins / F.col("total")))
    return placed.withColumn("bin", number.cast("long")).groupBy("column", "bin").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def _impurity(counts: list[Column]) -> Column:
    """Gini impurity of a group, times its rows."""
    n = sum(counts[1:], counts[0])
    return F.when(n > 0, n - sum((c * c for c in counts[1:]), counts[0] * counts[0]) / n).otherwise(0.0)


def _most_frequent(counts: list[Column], classes: list[str]) -> Column:
    """The class with the largest count, the first of equal ones."""
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    found = F.lit(classes[-1])
    for c, name in reversed(list(zip(counts, classes))):
        found = F.when(c == most, name).otherwise(found)
    return found


class _Growing:
    """What stays the same from level to level."""

    def __init__(self, numeric: list[str], nominal: list[str], classes: list[str], bins: dict, min_records: int):
        self.columns = numeric + nominal
        self.numeric, self.classes, self.bins, self.min_records = numeric, classes, bins, min_records
        self.counts = [f"k{j}" for j in range(len(classes))]

    def coded(self, df: DataFrame, target: str) -> DataFrame:
        """``(node, f0, f1, ..., class, n)``: cells as keys whose order is that of the numbers, equal rows once."""
        cells = []
        for c in self.columns:
            if c in self.bins:
                lows = F.array(*[F.lit(low) for _, low, _ in self.bins[c]])
                x = F.col(c).cast("double")
                place = F.greatest(F.size(F.filter(lows, lambda v: v <= x)), F.lit(1))
                cells.append(F.when(x.isNotNull() & ~F.isnan(x), F.lpad(place.cast("string"), 6, "0")))
            else:
                cells.append(F.col(c).cast("string"))
        named = [x.alias(f"f{i}") for i, x in enumerate(cells)]
        rows = df.where(F.col(target).isNotNull()).select(*named, F.col(target).alias("class"))
        rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
        return written(rows.select(F.lit(ROOT).cast("long").alias("node"), "*"), "tree-rows")

    def features(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.columns))]

    def histogram(self, rows: DataFrame) -> DataFrame:
        """Stored ``(node, c, v, k0, k1, ...)``: rows of each class by node, column number and value."""
        cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f).alias("v")) for i, f in enumerate(self.features())]))
        stacked = rows.select("node", "class", "n", cells.alias("cell")).select("node", "class", "n", "cell.c", "cell.v").where("v is not null")
        sums = [F.sum(F.when(F.col("class") == y, F.col("n")).otherwise(0)).alias(k) for y, k in zip(self.classes, self.counts)]
        return written(stacked.groupBy("node", "c", "v").agg(*sums), "histogram")

    def splits(self, histogram: DataFrame) -> DataFrame:
        """Stored ``(node, c, v, after)``: each node's best split; numbers up to ``v`` are low, ``after`` is the next."""
        k = [F.col(x) for x in self.counts]
        n = sum(k[1:], k[0])
        is_number = F.col("c") < len(self.numeric)
        order = Window.partitionBy("node", "c").orderBy("v")
        whole = Window.partitionBy("node", "c")
        low = [F.sum(x).over(order.rowsBetween(Window.unboundedPreceding, 0)) for x in self.counts]
        told = histogram.where(is_number).select(
            "node", "c", "v", F.lead("v").over(order).alias("after"),
            *[x.alias(f"l{j}") for j, x in enumerate(low)],
            *[F.sum(x).over(whole).alias(f"t{j}") for j, x in enumerate(self.counts)],
        )
        below = [F.col(f"l{j}") for j in range(len(k))]
        total = [F.col(f"t{j}") for j in range(len(k))]
        above = [t - x for t, x in zip(total, below)]
        enough = (sum(below[1:], below[0]) >= self.min_records) & (sum(above[1:], above[0]) >= self.min_records)
        gain = _impurity(total) - _impurity(below) - _impurity(above)
        numbers = told.where(F.col("after").isNotNull() & enough).select("node", "c", "v", "after", gain.alias("gain"))
        grouped = histogram.where(~is_number).groupBy("node", "c").agg(
            F.sum(_impurity(k)).alias("parts"),
            F.count_if(n >= self.min_records).alias("large"),
            *[F.sum(x).alias(x) for x in self.counts],
        )
        nothing = F.lit(None).cast("string")
        values = grouped.where("large > 1").select(
            "node", "c", nothing.alias("v"), nothing.alias("after"), (_impurity(k) - F.col("parts")).alias("gain")
        )
        gains = numbers.unionByName(values).withColumn("gain", F.round("gain", DIGITS)).where("gain > 0")
        best = Window.partitionBy("node").orderBy(F.desc("gain"), "c", "v")
        found = gains.withColumn("place", F.row_number().over(best)).where("place = 1")
        return written(found.select("node", "c", "v", "after"), "splits")

    def children(self, histogram: DataFrame, splits: DataFrame, start: int) -> DataFrame:
        """Stored ``(node, key, child, label, open)``; children are numbered from ``start``."""
        of_split = histogram.join(splits.withColumnRenamed("v", "upto"), ["node", "c"])
        key = F.when(F.col("upto").isNull(), F.col("v")).when(F.col("v") <= F.col("upto"), LOW).otherwise(HIGH)
        sums = of_split.groupBy("node", key.alias("key")).agg(*[F.sum(x).alias(x) for x in self.counts])
        k = [F.col(x) for x in self.counts]
        n = sum(k[1:], k[0])
        mixed = (_impurity(k) > 0) & (n >= 2 * self.min_records)
        numbered = dense_index(sums, ["node", "key"], "child", start)
        return written(numbered.select("node", "key", "child", _most_frequent(k, self.classes).alias("label"), mixed.alias("open")), "children")

    def handed_on(self, rows: DataFrame, splits: DataFrame, children: DataFrame) -> DataFrame:
        """The rows of nodes that split, with their ``child``, or null where it has none for them."""
        cell = F.get(F.array(*self.features()), F.col("c"))
        key = F.when(F.col("v").isNull(), cell).when(cell <= F.col("v"), LOW).when(cell.isNotNull(), HIGH)
        known = rows.join(splits.select("node", "c", "v"), "node").withColumn("key", key)
        return known.join(children, ["node", "key"], "left").drop("c", "v", "key")


def tree_fit(
    df: DataFrame,
    target: str,
    columns: list[str] | None = None,
    min_records: int = 2,
    max_depth: int = 30,
    max_bins: int = 64,
    prediction: str = "predicted",
    keys: list[str] | None = None,
    held_out: int = 0,
    seed: int = 42,
) -> TreeModel:
    """Gini tree of all rows. Numbers split in two at an average point, nominal columns by all their values.

    ``keys`` are columns that tell rows apart and are no features. A split needs two children with
    ``min_records`` rows; ties go to the first column in the order numbers, nominal columns, then to the
    smaller value. With ``held_out`` per cent of the rows (by a hash of the keys, or of all columns) set
    aside, the tree is pruned from below: a node splits no more if those rows are classified as well
    without it.
    """
    keys = keys or []
    numeric, nominal = split_kinds(df.drop(*keys), target)
    if columns:
        numeric, nominal = ([c for c in x if c in columns] for x in (numeric, nominal))
    parts = hash_split(df, [100 - held_out, held_out], keys or df.columns, seed) if held_out else [df]
    sizes = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*")).orderBy(target)
    classes = [r[0] for r in small_rows(sizes, MAX_CLASSES, "classes")]
    bins: dict[str, list] = {c: [] for c in numeric}
    if not classes:
        return TreeModel(_node_table(df, _Growing(numeric, nominal, [], bins, 0), [], []), None, numeric, nominal, 0, prediction)
    if numeric:
        found = number_bins(parts[0], numeric, max_bins)
        for r in small_rows(found.orderBy("column", "bin"), len(numeric) * (max_bins + 1), "bins"):
            bins[r["column"]].append((r["bin"], r["low"], r["high"]))
    growing = _Growing(numeric, nominal, classes, bins, min_records)
    rows = growing.coded(parts[0], target)
    root = rows.groupBy("class").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "class").first()
    label = root["class"] if root else None
    levels: list[tuple[DataFrame, DataFrame]] = []
    start = ROOT + 1
    while len(levels) < max_depth and numeric + nominal:
        histogram = growing.histogram(rows)
        splits = growing.splits(histogram)
        children = growing.children(histogram, splits, start)
        forget(histogram)
        made, most = children.agg(F.count("*"), F.count_if("open")).first()
        if not made:
            break
        levels.append((splits, children))
        start += made
        if not most:
            break
        on = growing.handed_on(rows, splits, children).where("open").select(F.col("child").alias("node"), *growing.features(), "class", "n")
        before, rows = rows, written(on, "tree-rows")
        forget(before)
    forget(rows)
    kept = _pruned(growing, growing.coded(parts[1], target), levels, label) if held_out else [s for s, _ in levels]
    return TreeModel(_node_table(df, growing, kept, levels), label, numeric, nominal, len(levels), prediction)


def _pruned(growing: _Growing, rows: DataFrame, levels: list, label: str) -> list[DataFrame]:
    """The splits of each level that are better than none on the rows set aside."""
    # Down: by node, the rows that its label gets wrong, and those of them that no child takes.
    wrong = F.sum(F.when(F.col("class") != F.col("own"), F.col("n")).otherwise(0))
    at = rows.withColumn("own", F.lit(label))
    told = []
    for splits, children in levels:
        on = written(growing.handed_on(at, splits, children), "held-rows")
        stay = on.where("child is null").groupBy("node").agg(wrong.alias("stay"))
        told.append(written(at.groupBy("node").agg(wrong.alias("wrong")).join(stay, "node", "left"), "held-out"))
        at = on.where("child is not null").select(F.col("child").alias("node"), *growing.features(), "class", "n", F.col("label").alias("own"))
    below = at.groupBy("node").agg(wrong.alias("wrong"))
    # Up: what a node gets wrong at best, with its children or as a leaf.
    kept: list[DataFrame] = []
    for depth in reversed(range(len(levels))):
        splits, children = levels[depth]
        inner = children.join(below.withColumnRenamed("node", "child"), "child").groupBy("node").agg(F.sum("wrong").alias("inner"))
        both = told[depth].join(splits.select("node", F.lit(True).alias("splits")), "node", "left").join(inner, "node", "left")
        inside = F.coalesce("inner", F.lit(0)) + F.coalesce("stay", F.lit(0))
        better = F.coalesce(F.col("splits") & (inside < F.col("wrong")), F.lit(False))
        both = written(both.withColumn("better", better).withColumn("inside", inside), "pruning")
        kept.insert(0, splits.join(both.where("better").select("node"), "node", "left_semi"))
        below = both.select("node", F.when(F.col("better"), F.col("inside")).otherwise(F.col("wrong")).alias("wrong"))
    return kept


def _node_table(df: DataFrame, growing: _Growing, kept: list[DataFrame], levels: list) -> DataFrame:
    """Stored ``(node, depth, column, edge, branches)``; an edge is the mean of the values on its two sides."""
    spark = df.sparkSession
    edges = [(i, f"{n + 1:06d}", low, high) for i, c in enumerate(growing.numeric) for n, (_, low, high) in enumerate(growing.bins[c])]
    edges = spark.createDataFrame(edges, "c int, v string, low double, high double")
    names = F.array(*[F.lit(c) for c in growing.columns])
    table = None
    for depth, (splits, (_, children)) in enumerate(zip(kept, levels)):
        entry = F.struct("key", F.struct("child", "label"))
        branches = children.groupBy("node").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("branches"))
        ends = splits.join(F.broadcast(edges.select("c", "v", "high")), ["c", "v"], "left").join(
            F.broadcast(edges.select("c", F.col("v").alias("after"), "low")), ["c", "after"], "left"
        )
        level = ends.join(branches, "node").select(
            "node", F.lit(depth).alias("depth"), F.get(names, "c").alias("column"), ((F.col("high") + F.col("low")) / 2).alias("edge"), "branches"
        )
        table = level if table is None else table.unionByName(level)
    if table is None:
        table = spark.createDataFrame([], "node long, depth int, column string, edge double, branches map<string,struct<child:long,label:string>>")
    return written(table, "tree")


def tree_predict(model: TreeModel, df: DataFrame, prediction: str | None = None) -> DataFrame:
    """The table with the predicted class as one more column.

    A row goes down one level by each join; where its cell is missing, or a value that the node did not
    see, it keeps the class that it has.
    """
    name = prediction or model.prediction
    if not model.numeric + model.nominal:
        return df.withColumn(name, F.lit(model.label).cast("string"))
    numbers = F.create_map(*[x for c in model.numeric for x in (F.lit(c), F.col(c).cast("double"))]) if model.numeric else F.lit(None)
    values = F.create_map(*[x for c in model.nominal for x in (F.lit(c), F.col(c).cast("string"))]) if model.nominal else F.lit(None)
    rows = df.withColumns({"_node": F.lit(ROOT).cast("long"), "_label": F.lit(model.label).cast("string")})
    for depth in range(model.depth):
        level = model.nodes.where(F.col("depth") == depth).select(
            F.col("node").alias("_node"), F.col("column").alias("_column"), F.col("edge").alias("_edge"), F.col("branches").alias("_branches")
        )
        joined = rows.join(level, "_node", "left")
        number = F.try_element_at(numbers, F.col("_column")) if model.numeric else F.lit(None).cast("double")
        value = F.try_element_at(values, F.col("_column")) if model.nominal else F.lit(None).cast("string")
        key = F.when(F.col("_edge").isNull(), value).when(number <= F.col("_edge"), LOW).when(number > F.col("_edge"), HIGH)
        branch = F.when(key.isNotNull(), F.try_element_at("_branches", key))
        rows = joined.withColumn("_to", branch).select(
            *df.columns,
            F.col("_to")["child"].alias("_node"),
            F.coalesce(F.col("_to")["label"], F.col("_label")).alias("_label"),
        )
    return rows.withColumnRenamed("_label", name).drop("_node")
