"""Mixing sources to target weights: budgets down a tree of domain, language and source, prefixes of seeded epochs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parked, words

NONE = "(none)"


@dataclass(frozen=True)
class Plan:
    """``weights[level][value]``, 1 where missing; ``share`` of all tokens to select; at most ``epochs`` passes over a leaf."""

    levels: tuple[str, ...]
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    share: float = 1.0
    epochs: int = 2
    seed: int = 7
    digits: int = 4
    broadcast_leaves: int = 100_000


def weight(plan: Plan, level: str) -> Column:
    known = plan.weights.get(level, {})
    if not known:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, float(v))))
    return F.coalesce(F.element_at(table, F.col(level)), F.lit(1.0))


def pour(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Budget of each node from ``above``, its parent's budget, and its own ``w`` and ``supply``.

    Siblings get their weighted shares. One whose supply is less gets all of it, and what is left
    over goes to its siblings by weight, until all shares fit: in order of supply per weight, a node
    is filled as long as its supply is no more than its share of what the fuller ones leave. The
    budget of a node never exceeds its supply, so only what all siblings together cannot take has
    gone elsewhere, further up.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("supply") / F.col("w"), *[F.col(c) for c in nodes.columns if c not in ("w", "supply", "above")])
    whole = Window.partitionBy(*parent)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    step = nodes.withColumn("_done", F.coalesce(F.sum("supply").over(earlier), F.lit(0)))
    step = step.withColumn("_rest", F.sum("w").over(whole) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0)))
    step = step.withColumn("_level", (F.col("above") - F.col("_done")) / F.col("_rest"))
    step = step.withColumn("_full", F.col("supply") <= F.col("_level") * F.col("w") + 1e-6)
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("supply") / F.col("w"), F.col("_level")))).over(whole)["_level"]
    budget = F.when(F.col("_full") | level.isNull(), F.col("supply")).otherwise(F.floor(level * F.col("w") + 1e-6))
    return step.withColumn("budget", budget.cast("long")).drop("_done", "_rest", "_level", "_full")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """Leaves (levels, tokens) with supply and budget in tokens. Rows: one for each leaf, no more."""
    levels = list(plan.levels)
    supply = leaves.withColumn("supply", F.col("tokens") * plan.epochs)
    total = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * plan.share + 1e-6).cast("long").alias("above"))
    nodes, parent = None, []
    for depth in range(1, len(levels) + 1):
        path = levels[:depth]
        level = supply.groupBy(*path).agg(F.sum("supply").alias("supply")).withColumn("w", weight(plan, path[-1]))
        if nodes is None:
            level = level.withColumn("_all", F.lit(0)).join(total.withColumn("_all", F.lit(0)), "_all")
            nodes = pour(level.withColumn("above", F.least("above", F.sum("supply").over(Window.partitionBy("_all")))), ["_all"]).drop("_all")
        else:
            nodes = pour(level.join(nodes.select(*parent, F.col("budget").alias("above")), parent), parent)
        nodes = nodes.select(*path, "supply", "budget")
        parent = path
    return supply.drop("supply").join(nodes, levels)


def shuffled(key: Column, epoch: Column, plan: Plan) -> Column:
    """Place of a document in the seeded order of an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), epoch.cast("string"), key.cast("string")))


def select(docs: DataFrame, plan: Plan, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Selected rows: doc (a struct of the columns of ``docs``), n_tokens (words and one end) and epoch.

    A leaf's budget covers some whole epochs and a part of the next, in which the documents are
    taken in the epoch's seeded order as long as their tokens together stay within the rest. Places
    are hashes, so the order needs no sort of a leaf: tokens are summed per leaf and leading digits
    of the place, and only the one cell that the budget ends in is ordered, row by row. Null levels
    form a branch of their own. Null and empty texts have one token. Rows that share a doc_id are
    ordered by their text. An empty table gives an empty one.
    """
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), *[F.coalesce(F.col(c).cast("string"), F.lit(NONE)).alias(c) for c in plan.levels], F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    levels = list(plan.levels)
    rows = whole.withColumn("n_tokens", (F.size(words(F.col("_text"))) + 1).cast("long"))
    leaves = parked(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    goal = parked(budgets(leaves, plan), "budgets")
    goal = goal.withColumn("full", F.floor(F.col("budget") / F.col("tokens")).cast("int"))
    goal = goal.withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).select(*levels, "full", "rest")
    placed = rows.join(F.broadcast(goal) if leaves.count() <= plan.broadcast_leaves else goal, levels)
    placed = placed.withColumn("place", shuffled(F.col("_id"), F.col("full"), plan))
    cell = F.substring("place", 1, plan.digits)
    # the cell in which the budget of a leaf ends, and what is left for it
    slim = placed.where("rest > 0").groupBy(*levels, "full", "rest", cell.alias("cell")).agg(F.sum("n_tokens").alias("tokens"))
    run = F.sum("tokens").over(Window.partitionBy(*levels).orderBy("cell"))
    ends = slim.withColumn("run", run).where("run > rest").groupBy(*levels).agg(F.min(F.struct("cell", (F.col("rest") - F.col("run") + F.col("tokens")).alias("left"))).alias("end"))
    ends = parked(ends, "ends")
    ends = F.broadcast(ends) if leaves.count() <= plan.broadcast_leaves else ends
    placed = placed.join(ends, levels, "left")
    before = (F.col("rest") > 0) & (F.col("end").isNull() | (cell < F.col("end.cell")))
    sure = F.when(before, F.col("full") + 1).otherwise(F.col("full"))
    taken = placed.select("doc", "n_tokens", F.explode(F.when(sure > 0, F.sequence(F.lit(0), sure - 1)).otherwise(F.array().cast("array<int>"))).alias("epoch"))
    last = placed.where((F.col("rest") > 0) & (cell == F.col("end.cell")))
    so_far = F.sum("n_tokens").over(Window.partitionBy(*levels).orderBy("place", "_text").rowsBetween(Window.unboundedPreceding, 0))
    part = last.withColumn("so_far", so_far).where(F.col("so_far") <= F.col("end.left")).select("doc", "n_tokens", F.col("full").alias("epoch"))
    return taken.unionByName(part)


def mixed(docs: DataFrame, plan: Plan, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The selected documents with their own columns alone; one chosen for several epochs comes once for each."""
    out = select(docs, plan, doc_id, text)
    return out.select([F.col("doc")[c].alias(c) for c in docs.columns])
