"""Mix sources to target token counts by entropy balancing, in DataFrame operations only.

Every document i of size n_i gets a rate r_i, its expected number of copies. The token constraints
say what the sources' taken tokens are, and what each language and each class of length would
have if the mix kept their shares of the corpus. Among all rates, entropy balancing picks those
closest to 1 in the size-weighted entropy ``sum n_i (r_i log r_i - r_i)``: an exponential tilt
``r_i = exp(lambda(source) + mu(language) + nu(length))``, held at ``MOST_COPIES``. Sources meet their
constraints exactly; as sources can fix the languages, mu and nu pay a ridge penalty of ``PULL``.

The convex dual is solved by Newton's method. Given mu and nu, each source's lambda follows from its
own constraint (``level``), which leaves a dual in mu and nu alone. Its gradient and Hessian are
gathered in every step by one distributed aggregation over all sources; what comes back has a
number for each pair of covariates. Documents enter as token sums per source, language and class of
length, the dual's sufficient statistics, gathered once with partial sums first.

Rates become copies by dependent rounding: all documents get floor(r) copies, and the rest of a
source's tokens goes to its documents in the order of hash / (r - floor(r)), up to the one whose
middle passes the missing tokens. So a document gets its further copy with about the probability
r - floor(r), and a source misses its target by half a document at most. The order is cut where
sums over parts of it say; only one part of each source is sorted, without texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import shared

#: The weights that sources get in turn.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST_COPIES = 3
#: Penalty of mu and nu, as a share of all tokens.
PULL = 0.05
#: Languages with a covariate of their own, those of most tokens; the others share one.
LANGUAGES = 32
#: Sizes in words from which a document is in the next class of length.
LENGTHS = (32, 128, 512, 2048)
NEWTON_STEPS = 60
TOLERANCE = 1e-12
#: Decimals of mu and nu, so that reruns agree whatever the order of sums.
DECIMALS = 9
#: Parts of a source's order per unit of hash / probability, and their number.
PARTS, ALL_PARTS = 1 << 14, 1 << 16


def water_level(sources: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """Add ``target`` to ``sources(source_size, weight, ...)``: shares of all sizes by weight, each
    at most ``most`` times its source's size, the excess shared again until none is above.

    With the sources sorted by size / weight, those that are held at their limit come first; the
    level of the rest is what remains over their weights. One row per source goes through the
    window. Sources without words get 0.
    """
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    limit = most * F.col("source_size")
    free = F.struct("_weights", "_level")
    level = (
        sources.withColumn("_left", F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left").cast("double") / F.col("_weights"))
        # the first free source in this order has the largest remaining weight
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= limit, free)).over(everything)["_level"])
    )
    return level.withColumn("target", F.least(F.col("_level") * F.col("weight"), limit.cast("double"))).drop("_left", "_weights", "_level")


def source_table(cells: DataFrame) -> DataFrame:
    """One row per source of ``cells(source, size)``: rank by code point (null last), weight,
    source_size, target."""
    totals = cells.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    return water_level(totals.withColumn("rank", rank).withColumn("weight", weight))


def level(tilted: str, target: str) -> str:
    """SQL of the factor c of one source with ``sum n min(MOST_COPIES, c e)`` = ``target`` over its cells
    (n, e): cells of the largest e are held first. Null if all are."""
    by_tilt = f"array_sort({tilted}, (x, y) -> CASE WHEN x.e > y.e THEN -1 WHEN x.e < y.e THEN 1 ELSE 0 END)"
    start = f"named_struct('held', 0D, 'rest', aggregate({tilted}, 0D, (s, x) -> s + x.n * x.e), 'c', CAST(NULL AS DOUBLE))"
    now = f"({target} - {MOST_COPIES} * s.held) / s.rest"
    step = (
        f"CASE WHEN s.c IS NOT NULL THEN s WHEN {now} * x.e <= {MOST_COPIES} THEN named_struct('held', s.held, 'rest', s.rest, 'c', {now}) "
        "ELSE named_struct('held', s.held + x.n, 'rest', s.rest - x.n * x.e, 'c', CAST(NULL AS DOUBLE)) END"
    )
    return f"aggregate({by_tilt}, {start}, (s, x) -> {step}, s -> s.c)"


def tilted_cells(sources: DataFrame, theta: list[float]) -> DataFrame:
    """``sources(target, cells)`` with ``c`` and the cells' ``w`` (tokens taken) and ``free`` (not held) at
    covariate tilts ``theta``; a cell is (a, b, n): its language's and length's covariate, its tokens."""
    tilts = f"array({', '.join(f'{x!r}D' for x in theta)})"
    tilted = f"transform(cells, x -> named_struct('a', x.a, 'b', x.b, 'n', x.n, 'e', exp({tilts}[x.a] + {tilts}[x.b])))"
    found = sources.withColumn("tilted", F.expr(tilted)).withColumn("c", F.expr(level("tilted", "target")))
    return found.withColumn("tilted", F.expr(f"transform(tilted, x -> named_struct('a', x.a, 'b', x.b, 'n', x.n, 'w', x.n * least({MOST_COPIES}D, c * x.e), 'free', c * x.e < {MOST_COPIES}))"))


def gathered(tilted: DataFrame, k: int) -> tuple[list[float], list[list[float]]]:
    """Sums over all sources at the current tilts: tokens taken per covariate, and the ``k`` x ``k`` Hessian."""
    own = tilted.withColumn("v", F.expr(f"transform(sequence(0, {k - 1}), j -> aggregate(tilted, 0D, (s, x) -> s + CASE WHEN x.free AND (x.a = j OR x.b = j) THEN x.w ELSE 0D END))"))
    own = own.withColumn("all", F.expr("aggregate(tilted, 0D, (s, x) -> s + CASE WHEN x.free THEN x.w ELSE 0D END)"))
    entry = "named_struct('i', {i}, 'j', {j}, 'x', {x})".format
    taken = f"transform(tilted, x -> {entry(i='x.a', j='-1', x='x.w')}), transform(tilted, x -> {entry(i='x.b', j='-1', x='x.w')})"
    free = "CASE WHEN x.free THEN x.w ELSE 0D END"
    cross = ", ".join(f"transform(tilted, x -> {entry(i=i, j=j, x=free)})" for i, j in (("x.a", "x.a"), ("x.b", "x.b"), ("x.a", "x.b"), ("x.b", "x.a")))
    less = f"flatten(transform(sequence(0, {k - 1}), i -> transform(sequence(0, {k - 1}), j -> {entry(i='i', j='j', x='CASE WHEN all > 0 THEN -v[i] * v[j] / all ELSE 0D END')})))"
    rows = own.select(F.explode(F.expr(f"concat({taken}, {cross}, {less})")).alias("s")).groupBy("s.i", "s.j").agg(F.sum("s.x").alias("x")).collect()  # at most k * (k + 1)
    gradient, hessian = [0.0] * k, [[0.0] * k for _ in range(k)]
    for r in rows:
        if r["j"] < 0:
            gradient[r["i"]] = r["x"]
        else:
            hessian[r["i"]][r["j"]] = r["x"]
    return gradient, hessian


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small positive definite system, by elimination."""
    rows = [[*row, y] for row, y in zip(matrix, right, strict=True)]
    for i, pivot in enumerate(rows):
        for other in rows[i + 1 :]:
            factor = other[i] / pivot[i]
            for j in range(i, len(pivot)):
                other[j] -= factor * pivot[j]
    out = [0.0] * len(rows)
    for i in range(len(rows) - 1, -1, -1):
        out[i] = (rows[i][-1] - sum(rows[i][j] * out[j] for j in range(i + 1, len(rows)))) / rows[i][i]
    return out


def covariate_tilts(sources: DataFrame, wanted: list[float], total: float, pull: float = PULL) -> list[float]:
    """mu and nu by Newton steps until the penalized gradient is ``TOLERANCE`` of all tokens. ``sources``
    has (target, cells) of the sources that aren't held whole, ``wanted`` tokens for each covariate."""
    theta = [0.0] * len(wanted)
    if total <= 0:
        return theta
    for _ in range(NEWTON_STEPS):
        taken, hessian = gathered(tilted_cells(sources, theta), len(theta))
        gradient = [t - w + pull * total * x for t, w, x in zip(taken, wanted, theta, strict=True)]
        if max(map(abs, gradient), default=0.0) <= TOLERANCE * total:
            break
        for i, row in enumerate(hessian):
            row[i] += pull * total
        step = solved(hessian, gradient)
        # a full step can overshoot where cells are held
        scale = min(1.0, 0.5 / max(map(abs, step)))
        theta = [x - scale * s for x, s in zip(theta, step, strict=True)]
    return [round(x, DECIMALS) for x in theta]


def document_hash() -> Column:
    """md5 of doc_id, or of the text without one."""
    return F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.coalesce("text", F.lit("")))).cast("binary"))


def length_class(size: Column) -> Column:
    return sum(((size >= n).cast("int") for n in LENGTHS[1:]), (size >= LENGTHS[0]).cast("int"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, size (words; 0 for null), hash of every row."""
    return docs.select("doc_id", "source", "lang", shared.word_count(F.col("text")).alias("size"), document_hash().alias("hash"))


def rates(cells: DataFrame) -> DataFrame:
    """(source, lang, length, source_size, target, rate) of each row of ``cells(source, lang, length, size)``.

    Sources that are held whole have rate ``MOST_COPIES``, those without words or target 0."""
    table, _ = shared.staged(source_table(cells), "mix-sources")
    by_lang = cells.groupBy("lang").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), F.col("lang").asc_nulls_first()).limit(LANGUAGES)
    languages = [r["lang"] for r in by_lang.collect()]
    k = len(languages) + 1 + len(LENGTHS) + 1
    place = F.lit(len(languages))
    for i, name in reversed(list(enumerate(languages))):
        place = F.when(F.col("lang").eqNullSafe(F.lit(name)), i).otherwise(place)
    placed = cells.select("source", "lang", "length", place.alias("a"), (len(languages) + 1 + F.col("length")).alias("b"), F.col("size").cast("double").alias("n"))
    joined = placed.alias("c").join(table.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source"))).select("c.*", "source_size", "target")
    whole = F.col("target") >= MOST_COPIES * F.col("source_size")
    joined, _ = shared.staged(joined.withColumn("held", whole), "mix-cells")
    sums = joined.select(F.explode(F.array("a", "b")).alias("i"), "n", F.when(F.col("held"), MOST_COPIES * F.col("n")).otherwise(0.0).alias("fixed")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("fixed").alias("fixed")).collect()
    total = sum(r["n"] for r in sums) / 2
    goal = (table.agg(F.sum("target")).first()[0] or 0.0) / total if total else 0.0
    wanted = [0.0] * k
    for r in sums:
        wanted[r["i"]] = goal * r["n"] - r["fixed"]
    # languages beyond the first share a covariate, so their cells are one
    grouped = joined.where("not held and target > 0").groupBy("source", "target", "source_size", "a", "b").agg(F.sum("n").alias("n")).where("n > 0")
    free, _ = shared.staged(grouped.groupBy("source", "target").agg(F.sort_array(F.collect_list(F.struct("a", "b", "n"))).alias("cells")), "mix-free")
    theta = covariate_tilts(free, wanted, total)
    tilts = F.array(*map(F.lit, theta))
    levels = tilted_cells(free, theta).select("source", "c")
    found = joined.alias("j").join(levels.alias("l"), F.col("j.source").eqNullSafe(F.col("l.source")), "left").select("j.*", "c")
    tilt = F.exp(F.get(tilts, F.col("a")) + F.get(tilts, F.col("b")))
    rate = F.when((F.col("source_size") == 0) | (F.col("target") <= 0), 0.0).when(F.col("held"), float(MOST_COPIES)).otherwise(F.least(F.lit(float(MOST_COPIES)), F.coalesce(F.col("c") * tilt, F.lit(0.0))))
    return found.select("source", "lang", "length", "source_size", "target", F.col("n").alias("cell_size"), rate.alias("rate"))


def part_of(order: Column) -> Column:
    return F.least(F.floor(order * PARTS), F.lit(ALL_PARTS - 1)).cast("int")


def copy_plan(rows: DataFrame) -> DataFrame:
    """(source, lang, length, source_size, target, rate, cut_part, cut): what decides a document's copies,
    from staged ``rows`` as ``sized`` gives them.

    A document has a further copy if its place (part, then order, hash, doc_id, size) is before the cut."""
    rows = rows.withColumn("length", length_class(F.col("size")))
    cells, _ = shared.staged(rows.groupBy("source", "lang", "length").agg(F.sum("size").alias("size")), "mix-sizes")
    rated, _ = shared.staged(rates(cells), "mix-rates")
    missing = rated.groupBy("source").agg((F.first("target") - F.sum(F.floor("rate") * F.col("cell_size"))).alias("missing"))
    ordered = with_order(rows, rated).where("_order is not null")
    parts, _ = shared.staged(ordered.groupBy("source", "_part").agg(F.sum("size").alias("size")), "mix-parts")
    before = Window.partitionBy("source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.withColumn("first", F.coalesce(F.sum("size").over(before), F.lit(0)))
    reached = first.alias("p").join(missing.alias("m"), F.col("p.source").eqNullSafe(F.col("m.source"))).where("first + size >= missing and missing > 0")
    cuts = reached.groupBy("p.source").agg(F.min(F.struct("_part", "first", "missing")).alias("cut")).select("source", F.col("cut._part").alias("cut_part"), "cut.first", "cut.missing")
    cuts, _ = shared.staged(cuts, "mix-cuts")
    # one part of each source
    edge = ordered.alias("o").join(_few(cuts).alias("c"), F.col("o.source").eqNullSafe(F.col("c.source")) & (F.col("o._part") == F.col("c.cut_part"))).select("o.*", "first", "missing")
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("_order", "hash", "doc_id", "size").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    passed = edge.withColumn("upto", upto).where(F.col("first") + F.col("upto") - F.col("size") / 2 >= F.col("missing"))
    last = passed.groupBy("source").agg(F.min(_place()).alias("cut"))
    # without missing tokens no document has a further copy; if all parts are below, all have
    ends = missing.alias("m").join(cuts.alias("c"), F.col("m.source").eqNullSafe(F.col("c.source")), "left").join(last.alias("l"), F.col("m.source").eqNullSafe(F.col("l.source")), "left")
    ends = ends.select("m.source", F.when(F.col("m.missing") > 0, F.coalesce("cut_part", F.lit(ALL_PARTS))).otherwise(-1).alias("cut_part"), "cut")
    plan = rated.alias("r").join(ends.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source"))).select("r.*", "cut_part", "cut")
    return shared.staged(plan.drop("cell_size"), "mix-plan")[0]


def _place() -> Column:
    return F.struct("_order", "hash", "doc_id", "size")


def _few(plan: DataFrame) -> DataFrame:
    """``plan`` marked for broadcast if its rows are few enough."""
    return F.broadcast(plan) if plan.count() <= 100_000 else plan


def with_order(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows(source, lang, length, hash, ...)`` with their cells' columns, ``_order`` (null for whole rates) and ``_part``."""
    same = F.col("d.source").eqNullSafe(F.col("p.source")) & F.col("d.lang").eqNullSafe(F.col("p.lang")) & (F.col("d.length") == F.col("p.length"))
    joined = rows.alias("d").join(_few(plan).alias("p"), same).select("d.*", *(f"p.{c}" for c in plan.columns if c not in ("source", "lang", "length")))
    unit = F.conv(F.substring("hash", 1, 13), 16, 10).cast("double") / float(1 << 52)
    part = F.col("rate") - F.floor("rate")
    return joined.withColumn("_order", F.when(part > 0, unit / part)).withColumn("_part", part_of(F.col("_order")))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` (as ``sized`` gives them, with what else they have) with source_size, target and copies;
    no row is shuffled while the plan is small."""
    ordered = with_order(rows.withColumn("length", length_class(F.col("size"))), plan)
    further = (F.col("_part") < F.col("cut_part")) | (F.col("_part") == F.col("cut_part")) & F.coalesce(_place() < F.col("cut"), F.lit(True))
    return ordered.withColumn("copies", (F.floor("rate") + F.coalesce(further, F.lit(False)).cast("long")).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """The mix itself: each document of ``docs(doc_id, text, source, lang, ...)`` as often as its copies say,
    all its columns as they are.

    Null sources and languages are values of their own; null and empty texts add no words; texts of
    any length count whole; rows that agree in doc_id and size share their fate; an empty table gives an
    empty one."""
    sizes, path = shared.staged(sized(docs), "mix-rows")
    plan = copy_plan(sizes)
    shared.drop_paths(docs.sparkSession, path)
    rows = docs.select("doc_id", "source", "lang", shared.word_count(F.col("text")).alias("size"), document_hash().alias("hash"), F.struct("*").alias("row"))
    taken = with_copies(rows, plan).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def mix_report(docs: DataFrame) -> DataFrame:
    """Per document of ``docs(doc_id, text, source, lang)``: doc_id, size, source_size, target, taken (words,
    repeats counted), copies. Rows are treated as in ``mix``."""
    rows, _ = shared.staged(sized(docs), "mix-rows")
    out = with_copies(rows, copy_plan(rows))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")

