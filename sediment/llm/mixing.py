"""Mixing sources to target weights by entropy balancing.

Every document gets a rate; among all rates of at most ``most`` that meet each source's token target and keep the
tokens of each class of documents (say a language) near the corpus's share, the chosen ones have the least
token-weighted entropy distance from 1. They are exponentially tilted: exp(multiplier of the source + multiplier of the
class), cut off at ``most``. The dual is convex. Its source part is diagonal, so each source's multiplier follows from
those of the classes, row by row; Newton's steps run on the classes' multipliers, with the dual's value, gradient and
Hessian as one Spark aggregate over the table of sources for each trial. Sources are hard constraints. Classes are soft
ones: a ridge, ``RIDGE`` of a class's tokens, pays for what the sources' targets and the cut-off leave out. Classes are
hashed into ``CLASSES`` numbers, which bounds the Hessian. Without classes the gradient is 0 at the start, and a source's
rate is its target divided by its size.

Rates become copies. All documents of a source and class, a cell, have one rate. Each gets its whole part, and the rest
of the cell's target goes to documents in hash order until their words reach it, which leaves half a document over or
short at most. Then single documents of a source are added or taken back while that brings its words closer to its target.

Sources are ranked by code point, null last. A null text has size 0 and nothing is taken of it. Rows with equal ids are
documents of their own; of equal rows as many are taken as the target asks for. An empty table gives an empty
result; other columns are ignored. A hot source is dealt over ``BUCKETS`` hash buckets, of which only the one in
which the target falls is ordered; equal rows are counted for each partition that they come from, and never meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, dealt_join, hot_keys, scratch, stage

BUCKETS = 4096
WEIGHTS = (5, 2, 1)
#: A source's target, and a document's copies, stop at so many times its size.
MOST = 3
#: Numbers of classes, ridge as a share of a class's tokens, Newton steps at most, miss at which they end.
CLASSES, RIDGE, NEWTON_STEPS, ENOUGH = 64, 0.02, 40, 1e-9
#: Single documents of each source that may be turned, one after the other.
TURNS = 3


def _ranked(sources: DataFrame) -> DataFrame:
    """``rank`` from 0 by source, null last, with no task that holds all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = stage(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("within", within).join(parts, "part").withColumn("rank", F.col("first") + F.col("within")).drop("part", "within", "first")


def source_targets(sources: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The sources with ``target``: shares of all ``source_size`` by weight, held at ``most`` sizes, the excess shared anew.

    Each round is an aggregate of two numbers; rounds end when no source is above its bound.
    """
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = stage(_ranked(sources).withColumn("weight", weight), "weights")
    bound = most * F.col("source_size").cast("double")
    total = float(s.agg(F.sum("source_size")).first()[0] or 0)
    level, held = 0.0, F.lit(False)
    while total:
        r = s.agg(F.sum(F.when(held, bound)).alias("held"), F.sum(F.when(~held, F.col("weight"))).alias("open")).first()
        new = (total - (r.held or 0.0)) / r.open if r.open else level
        if new <= level:
            break
        level, held = new, F.col("weight") * new > bound
    return s.withColumn("target", F.least(F.col("weight") * level, bound))


def _tilted(sources: DataFrame, multipliers: list[float], most: int) -> DataFrame:
    """The sources with ``rate`` in each of their cells, and ``base``, exp of the source's multiplier, where the classes have
    the given multipliers. ``full``: the target takes every cell at ``most``, whatever the multipliers.

    Cells that reach ``most`` leave the equation, and the base of the others grows; each pass adds a cell or is the last.
    """
    tilts = F.array(*(F.lit(math.exp(m)) for m in multipliers))
    over = lambda c, base: c["tilt"] * base >= most

    def grown(base: Column, _: Column) -> Column:
        held = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.when(over(c, base), c["size"]).otherwise(0.0))
        free = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.when(over(c, base), 0.0).otherwise(c["size"] * c["tilt"]))
        return F.when(free > 0, F.greatest(base, (F.col("target") - most * held) / free)).otherwise(base)

    s = sources.withColumn("cells", F.transform("cells", lambda c: F.struct(c["cls"].alias("cls"), c["size"].cast("double").alias("size"), F.element_at(tilts, c["cls"] + 1).alias("tilt"))))
    s = s.withColumn("base", F.aggregate(F.sequence(F.lit(0), F.size("cells")), F.lit(0.0), grown)).withColumn("full", F.col("target") >= most * F.col("source_size") * (1 - 1e-12))
    rate = F.when((F.col("source_size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("full"), float(most))
    return s.withColumn("cells", F.transform("cells", lambda c: c.withField("rate", rate.otherwise(F.least(F.lit(float(most)), c["tilt"] * F.col("base"))))))


def _dual(sources: DataFrame, multipliers: list[float], most: int) -> tuple[float, dict, dict]:
    """The dual's value, gradient and Hessian in the classes' multipliers, but for goals and ridge: one aggregate, which has
    CLASSES * (CLASSES + 1) + 1 rows at most."""
    total = lambda cells, of: F.aggregate(cells, F.lit(0.0), lambda a, c: a + of(c))
    row = lambda i, j, x: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), x.cast("double").alias("x"))
    size, most_ = lambda c: c["size"] * c["rate"], float(most)
    s = _tilted(sources, multipliers, most).filter("source_size > 0 and target > 0")
    s = s.withColumn("free", F.filter("cells", lambda c: ~F.col("full") & (c["rate"] < most_) & (c["size"] > 0)))
    # words spent as a function of the multiplier: exponential up to the cut-off, a straight line beyond
    spent = lambda c: F.when(c["rate"] < most_, size(c)).otherwise(c["size"] * most_ * (1 + F.log(c["tilt"] * F.col("base") / most_)))
    value = F.when(F.col("full"), total("cells", lambda c: c["size"] * most_ * F.log(c["tilt"]))).otherwise(total("cells", spent) - F.col("target") * F.log("base"))
    none, weight = F.lit(-1), total("free", size)
    rows = F.concat(
        F.array(row(none, none, value)),
        F.transform("cells", lambda c: row(c["cls"], none, size(c))),
        F.transform("free", lambda c: row(c["cls"], c["cls"], size(c))),
        F.flatten(F.transform("free", lambda c: F.transform("free", lambda d: row(c["cls"], d["cls"], -size(c) * size(d) / weight)))),
    )
    found = s.select(F.inline(rows)).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    at = {(r.i, r.j): r.x for r in found}
    return at.get((-1, -1), 0.0), {i: x for (i, j), x in at.items() if j < 0 <= i}, {k: x for k, x in at.items() if k[1] >= 0}


def _solved(a: list[list[float]], b: list[float]) -> list[float]:
    """x of a x = b, where a is positive definite and small."""
    n, rows = len(b), [[*r, x] for r, x in zip(a, b, strict=True)]
    for i in range(n):
        for k in range(i + 1, n):
            f = rows[k][i] / rows[i][i]
            rows[k] = [y - f * x for x, y in zip(rows[i], rows[k], strict=True)]
    x = [0.0] * n
    for i in reversed(range(n)):
        x[i] = (rows[i][n] - sum(rows[i][k] * x[k] for k in range(i + 1, n))) / rows[i][i]
    return x


def class_multipliers(sources: DataFrame, goals: dict[int, float], most: int = MOST, ridge: float = RIDGE) -> list[float]:
    """Multipliers of all classes, 0 for those without a goal: Newton's steps on the dual, halved until it falls."""
    of, total = sorted(c for c, g in goals.items() if g > 0), sum(goals.values())

    def dual(x: list[float]) -> tuple[float, list[float], list[list[float]]]:
        every = [0.0] * CLASSES
        for c, m in zip(of, x, strict=True):
            every[c] = m
        value, gradient, hessian = _dual(sources, every, most)
        value += sum(goals[c] * m * (ridge * m / 2 - 1) for c, m in zip(of, x, strict=True))
        slope = [gradient.get(c, 0.0) - goals[c] * (1 - ridge * m) for c, m in zip(of, x, strict=True)]
        return value, slope, [[hessian.get((c, d), 0.0) + (c == d) * ridge * goals[c] for d in of] for c in of]

    at = [0.0] * len(of)
    value, slope, bend = dual(at)
    for _ in range(NEWTON_STEPS):
        if max(map(abs, slope), default=0.0) <= ENOUGH * total:
            break
        step, size = _solved(bend, [-x for x in slope]), 1.0
        falls = sum(x * y for x, y in zip(slope, step, strict=True))
        while True:
            new = [x + size * y for x, y in zip(at, step, strict=True)]
            found = dual(new)
            if found[0] <= value + 1e-4 * size * falls + 1e-12 * total or size < 1e-6:
                break
            size /= 2
        at, (value, slope, bend) = new, found
    out = [0.0] * CLASSES
    for c, m in zip(of, at, strict=True):
        out[c] = round(m, 9)  # so that the order in which sums were made doesn't show
    return out


def cell_rates(sources: DataFrame, balanced: bool, most: int = MOST) -> DataFrame:
    """A row for each cell of (key, source_size, target, cells): cls, its size and rate, and what its documents get beside the whole part."""
    multipliers = [0.0] * CLASSES
    if balanced:
        sizes = sources.select("target", "source_size", F.inline("cells"))
        share = sources.agg(F.sum("target") / F.sum("source_size")).first()[0] or 0.0
        goals = {r.cls: share * r["size"] for r in sizes.groupBy("cls").agg(F.sum("size").cast("double").alias("size")).collect()}
        multipliers = class_multipliers(sources, goals, most)
    cells = _tilted(sources, multipliers, most).select("key", "source_size", "target", F.inline("cells")).withColumn("whole", F.floor(F.col("rate") + 1e-9))
    return cells.withColumn("rest", F.greatest(F.lit(0.0), F.col("size") * (F.col("rate") - F.col("whole")))).drop("size", "tilt")


def _turned(rounded: DataFrame, most: int) -> DataFrame | None:
    """The pieces with ``more`` changed by one document of each source that this brings closer to its target, or None if there is none."""
    taken = F.sum(F.col("size") * (F.col("whole") * F.col("n") + F.col("more")))
    left = rounded.groupBy("key").agg((F.first("target") - taken).alias("left"), F.count("*").alias("n"))
    hot = hot_keys(left.select("key", "n"), rounded.count(), 256)
    open_ = dealt_join(rounded, left.select("key", "left"), ["key"], hot).filter(F.when(F.col("left") > 0, (F.col("more") < F.col("n")) & (F.col("whole") < most)).otherwise(F.col("more") > 0))
    off = F.abs(F.col("size") - F.abs("left"))
    best = open_.filter(off < F.abs("left") - 1e-6).groupBy("key").agg(F.min(F.struct(off.alias("off"), "mark", "cls", "size", "piece")).alias("b"), F.first(F.signum("left").cast("long")).alias("turn"))
    turns = stage(best.select(F.col("b.piece").alias("piece"), "turn"), "turns")
    if turns.isEmpty():
        return None
    return stage(rounded.join(turns, "piece", "left").withColumn("more", F.col("more") + F.coalesce("turn", F.lit(0))).drop("turn"), "rounded")


def _rounded(pieces: DataFrame, plan: DataFrame, most: int) -> DataFrame:
    """The pieces with ``more``, how many of their ``n`` equal documents are taken once more than the whole part says."""
    placed = pieces.join(plan, ["key", "cls", "bucket"])
    split = (F.col("start") < F.col("rest")) & (F.col("rest") < F.col("start") + F.col("bucket_size"))
    w = Window.partitionBy("key", "cls", "bucket").orderBy("mark", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("n") * F.col("size")).over(w), F.lit(0))
    reach = F.col("rest") - F.col("start") - inside
    part = F.when(F.col("size") == 0, F.when(reach > 0, F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.greatest(F.lit(0), F.ceil(reach / F.col("size") - 0.5))))
    whole = F.when(F.col("start") + F.col("bucket_size") <= F.col("rest"), F.col("n")).otherwise(0)
    both = placed.filter(~split).withColumn("more", whole.cast("long")).unionByName(placed.filter(split).withColumn("more", part.cast("long")))
    both = both.withColumn("more", F.when(F.col("whole") < most, F.col("more")).otherwise(0))
    now = stage(both.drop("bucket", "bucket_size", "start", "rest"), "rounded")
    for _ in range(TURNS):
        new = _turned(now, most)
        if new is None:
            break
        now = new
    return now


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, classes: str | None = None, row: str | None = None) -> DataFrame:
    """doc_id (and the column ``row``), source, size, source_size, target, rate, copies, taken of each row.

    ``classes`` names the column whose values keep about their share of all words.
    """
    with scratch():
        return _mix(docs, weights, most, classes, row)


def _mix(docs: DataFrame, weights, most: int, classes: str | None, row: str | None) -> DataFrame:
    own = ["doc_id", *([row] if row else [])]
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    cls = F.pmod(F.xxhash64(classes), F.lit(CLASSES)).cast("int") if classes else F.lit(0)
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))
    rows = docs.select(*own, key.alias("key"), cls.alias("cls"), size.alias("size"), F.xxhash64("doc_id", "text").alias("mark"), F.spark_partition_id().alias("part"))
    sized = stage(rows.select("*", F.monotonically_increasing_id().alias("place")), "sizes", keep=True)
    alike = ["key", "cls", "mark", "size", "part"]  # one place that equal rows of a partition share
    grouped = sized.groupBy(*alike).agg(F.count("*").alias("n"))
    pieces = stage(grouped.select("*", F.pmod("mark", F.lit(BUCKETS)).alias("bucket"), F.monotonically_increasing_id().alias("piece")), "pieces")
    buckets = stage(pieces.groupBy("key", "cls", "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("bucket_size")), "buckets")
    cells = buckets.groupBy("key", "cls").agg(F.sum("bucket_size").alias("size")).groupBy("key").agg(F.sum("size").alias("source_size"), F.sort_array(F.collect_list(F.struct("cls", "size"))).alias("cells"))
    named = cells.withColumn("source", F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)))
    sources = stage(source_targets(named, weights, most), "targets")
    rates = stage(cell_rates(sources, classes is not None, most), "rates")
    up_to = lambda of, by: F.coalesce(F.sum(of).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cell, dealt = ["key", "cls"], buckets.withColumn("group", F.floor(F.col("bucket") / math.isqrt(BUCKETS)))
    groups = dealt.groupBy(*cell, "group").agg(F.sum("bucket_size").alias("group_size"))  # so that no task orders all buckets of a cell
    groups = groups.select(*cell, "group", up_to("group_size", [*cell, "group"]).alias("first")).join(rates, cell)
    inside = dealt.select(*cell, "group", "bucket", "bucket_size", up_to("bucket_size", [*cell, "group", "bucket"]).alias("inside"))
    plan = inside.join(groups, [*cell, "group"]).withColumn("start", F.col("first") + F.col("inside")).drop("group", "first", "inside")
    rounded = stage(_rounded(pieces, plan, most).drop("piece"), "taken", keep=True)
    found = sized.join(rounded, alike)
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("place"))
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    each = found.filter(some).withColumn("more", (nth <= F.col("more")).cast("long")).unionByName(found.filter(~some).withColumn("more", (F.col("more") > 0).cast("long")))
    copies = (F.col("whole") + F.col("more")).alias("copies")
    out = each.select(*own, F.when(F.col("key") != "", F.substring("key", 2, 2**31 - 1)).alias("source"), "size", "source_size", "target", "rate", copies)
    return out.withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, classes: str | None = "lang") -> DataFrame:
    """The documents, each as often as the balanced mix takes it, with their columns, whatever their names."""
    keyed = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "mix-docs", keep=True)
    fields = {name: F.col(f"doc.`{name}`").alias(name) for name in ("doc_id", "text", "source", *([classes] if classes else []))}
    copies = mix(keyed.select("row", *fields.values()), weights, most, classes, row="row").filter("copies > 0").select("row", F.col("copies").cast("int").alias("copies"))
    return keyed.join(copies, "row").select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("doc")).select("doc.*")
