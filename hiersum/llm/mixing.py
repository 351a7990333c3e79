"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source gets the same expected number of copies, the
source's target over its size.  The whole part is sure.  The fractional parts
are rounded dependently: two documents are paired, and mass (words) moves from
one to the other, in a random direction weighted so that no expectation
changes, until one of the two is integral.  The sum of words never moves.
Documents are paired with others of their size class (powers of two), so that
each class of a source leaves at most one fractional document.

The reduction is a tree: documents are dealt by hash into small blocks of one
source and class, each block folds to at most one fractional document, and
those are dealt again.  A level is one shuffle of what is left, a 64th of the
level before, and a source of any size is many blocks.

About RESERVE documents of each source and class stay out of the tree.  They
are the pool at its root: all have the same probability, and a document that is
paired with the pool exchanges mass with all of it at once, in proportion to
size.  First the fractional documents that the classes left meet the pool,
then the pool's own documents, largest first, meet what is left of it.  Each
becomes integral unless the pool runs empty or full; only then is a fraction
rounded by itself, unbiased like every step before, and only there do the words
taken leave the target.

In a source of few documents that last fraction may be a large share of the
target, and where a document outweighs the others no rounding keeps both the
target and every expectation.  With ``within`` the target goes first: of a
source that ended outside of it, up to ``LEVERS`` open documents of all sizes
are taken together, every choice between one copy more or less for each is
tried, and the one that comes within the bound with the fewest changes is made,
or else the nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bind, checkpoint

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK = 64
#: Documents of each source and size class in the pool at the root, about.
RESERVE = 32
#: Documents that are chosen together where a source missed its target, and those of a size class that may be among them, about.
LEVERS, PER_CLASS = 12, 6
#: Sources' size classes are joined by broadcast up to this many, and by a shuffle beyond.
BROADCAST_CLASSES = 500_000

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words (null text: 0)."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint")).alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """source, source_size, target: shares of all words by weight, at most ``cap`` times a source's own.

    Sources go by code point, null last, and take the weights in turn.  Excess
    over a cap is reshared by weight until no target is above its cap.  With
    the sources sorted by cap over weight those at their cap are a prefix, so
    running sums find the final share without a loop.  Only the table of
    sources passes through the single window.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    ranked = by.withColumn("k", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * cap).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    everything = Window.partitionBy()
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("share", left / F.sum("weight").over(after)).withColumn("at_cap", F.col("share") * F.col("weight") > F.col("cap"))
    final = F.min_by(F.when(~F.col("at_cap"), F.col("share")), F.when(~F.col("at_cap"), F.struct(F.col("cap") / F.col("weight"), F.col("k")))).over(everything)
    return ranked.select("source", "source_size", F.when(F.col("at_cap"), F.col("cap")).otherwise(F.least("cap", F.coalesce(final, F.lit(0.0)) * F.col("weight"))).alias("target"))


def _chance(doc: Column, rep: Column, level: int, seed: int) -> Column:
    """A uniform number in [0, 1) that depends on the document alone, so that reruns agree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), doc, rep), 11).cast("double") / F.lit(float(1 << 53))


_ITEM = "struct<doc_id:bigint,rep:bigint,size:bigint,p:double>"


def _fold(items: Column, level: int, seed: int) -> Column:
    """Fold a block: struct<held: the fractional document or null, done: array of rounded documents>."""
    start = F.struct(F.lit(None).cast(_ITEM).alias("held"), F.array().cast(f"array<{_ITEM}>").alias("done"))
    with_p = lambda x, p: F.struct(x["doc_id"].alias("doc_id"), x["rep"].alias("rep"), x["size"].alias("size"), p.alias("p"))

    def move(state: Column, x: Column) -> Column:
        held = state["held"]

        def moved(m: Column) -> Column:
            # a: words that can go from held to x; b: words that can go back
            forward = _chance(x["doc_id"], x["rep"], level, seed) * (m["a"] + m["b"]) < m["b"]
            emptied = m["out"] <= m["room"]  # forward: held runs dry before x is full
            filled = m["held_room"] <= m["mass"]  # backward: held is full before x runs dry
            p_held = F.when(forward, F.when(emptied, F.lit(0.0)).otherwise(held["p"] - m["a"] / held["size"])).otherwise(F.when(filled, F.lit(1.0)).otherwise(held["p"] + m["b"] / held["size"]))
            p_x = F.when(forward, F.when(m["room"] <= m["out"], F.lit(1.0)).otherwise(x["p"] + m["a"] / x["size"])).otherwise(F.when(m["mass"] <= m["held_room"], F.lit(0.0)).otherwise(x["p"] - m["b"] / x["size"]))
            inside = lambda p: (p > 0) & (p < 1)

            def split(y: Column) -> Column:
                h, z = y["h"], y["z"]
                rest = F.when(inside(h["p"]), h).when(inside(z["p"]), z)
                return F.struct(rest.alias("held"), F.concat(state["done"], F.filter(F.array(h, z), lambda v: ~inside(v["p"]))).alias("done"))

            return bind(F.struct(with_p(held, p_held).alias("h"), with_p(x, p_x).alias("z")), split)

        mass = {"out": held["p"] * held["size"], "room": (1 - x["p"]) * x["size"], "mass": x["p"] * x["size"], "held_room": (1 - held["p"]) * held["size"]}
        amounts = F.struct(*(v.alias(k) for k, v in mass.items()), F.least(mass["out"], mass["room"]).alias("a"), F.least(mass["mass"], mass["held_room"]).alias("b"))
        return F.when(held.isNull(), F.struct(x.alias("held"), state["done"].alias("done"))).otherwise(bind(amounts, moved))

    return F.aggregate(items, start, move)


def _settle(items: Column, p: Column, seed: int) -> Column:
    """Round a source's last documents against its pool: array<struct<doc_id, rep, size, p>> with p 0 or 1.

    ``items`` are structs (in_pool, negative size, doc_id, rep, p) in order;
    ``p`` is the probability that the pool's documents have at first.
    """
    row = "struct<doc_id:bigint,rep:bigint,size:bigint,p:double>"
    weight = F.aggregate(items, F.lit(0.0), lambda n, x: n + F.when(x["in_pool"] == 1, -x["minus"]).otherwise(0).cast("double"))
    start = F.struct(p.alias("p"), weight.alias("left"), F.array().cast(f"array<{row}>").alias("done"))

    def step(state: Column, x: Column) -> Column:
        own = x["in_pool"] == 1
        facts = F.struct((-x["minus"]).cast("double").alias("s"), F.when(own, state["p"]).otherwise(x["p"]).alias("p"), F.greatest(state["left"] + F.when(own, x["minus"]).otherwise(0).cast("double"), F.lit(0.0)).alias("left"))

        def meet(f: Column) -> Column:
            mass, room = state["p"] * f["left"], (1 - state["p"]) * f["left"]
            amounts = F.struct(((1 - f["p"]) * f["s"]).alias("want"), (f["p"] * f["s"]).alias("have"), mass.alias("mass"), room.alias("room"))
            return bind(amounts, lambda m: move(f, m, F.least(m["want"], m["mass"]), F.least(m["have"], m["room"])))

        def move(f: Column, m: Column, up: Column, down: Column) -> Column:
            rises = _chance(x["doc_id"], x["rep"], -1, seed) * (up + down) < down
            own_p = F.when(rises, F.when(m["want"] <= m["mass"], F.lit(1.0)).otherwise(f["p"] + up / f["s"])).otherwise(F.when(m["have"] <= m["room"], F.lit(0.0)).otherwise(f["p"] - down / f["s"]))
            pool = F.when(rises, F.when(m["mass"] <= m["want"], F.lit(0.0)).otherwise(state["p"] - up / f["left"])).otherwise(F.when(m["room"] <= m["have"], F.lit(1.0)).otherwise(state["p"] + down / f["left"]))
            stuck = (up + down <= 0) | (f["left"] <= 0)
            settled = F.struct(F.when(stuck, f["p"]).otherwise(own_p).alias("p"), F.when(stuck, state["p"]).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), pool))).alias("pool"))

            def put(y: Column) -> Column:
                taken = F.when(_chance(x["doc_id"], x["rep"], -2, seed) < y["p"], F.lit(1.0)).otherwise(F.lit(0.0))
                done = F.struct(x["doc_id"].alias("doc_id"), x["rep"].alias("rep"), (-x["minus"]).alias("size"), taken.alias("p"))
                return F.struct(y["pool"].alias("p"), f["left"].alias("left"), F.concat(state["done"], F.array(done)).alias("done"))

            return bind(settled, put)

        return bind(facts, meet)

    return F.aggregate(items, start, step, lambda state: state["done"])


def _steered(rows: DataFrame, within: float, seed: int) -> DataFrame:
    """Rounded rows (``OUT``), with other copies of a few documents in each source that is further than ``within`` of its target from it."""
    of = lambda df: F.col("source").eqNullSafe(df["of"])
    taken = rows.groupBy("source", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"))
    band = F.greatest(F.col("target") * within, F.lit(0.5))
    off = checkpoint(taken.select(F.col("source").alias("of"), (F.col("taken") - F.col("target")).alias("over"), band.alias("band")).where("abs(over) > band"))
    if off.isEmpty():
        return rows
    sure, more = F.floor(F.col("target") / F.col("source_size")), F.col("target") / F.col("source_size")
    open_ = rows.join(off, of(off)).where((F.col("size") > 0) & (more > sure)).withColumn("class", F.floor(F.log2("size")))
    open_ = checkpoint(open_.select("of", "over", "band", "class", "size", "doc_id", "rep", F.when(F.col("copies") > sure, -F.col("size")).otherwise(F.col("size")).alias("delta")))
    many = open_.groupBy(F.col("of").alias("in"), F.col("class").alias("in_class")).agg(F.count(F.lit(1)).alias("n"))
    some = open_.join(many, F.col("of").eqNullSafe(F.col("in")) & (F.col("class") == F.col("in_class"))).where(_chance(F.col("doc_id"), F.col("rep"), 0, seed + 2) * F.col("n") < PER_CLASS)
    held = some.groupBy("of", "over", "band").agg(F.sort_array(F.collect_list(F.struct("size", "doc_id", "rep", "delta")), asc=False).alias("items"))
    # the three largest, and others down to the smallest
    spread = lambda items: F.transform(F.sequence(F.lit(0), F.lit(LEVERS - 1)), lambda i: F.get(items, F.when((F.size(items) <= LEVERS) | (i < 3), i).otherwise(3 + F.floor((i - 3) * (F.size(items) - 4) / (LEVERS - 4)).cast("int"))))
    levers = held.select("of", "over", "band", F.filter(spread(F.col("items")), lambda x: x.isNotNull()).alias("levers"))
    sums = F.aggregate("levers", F.array(F.lit(0).cast("bigint")), lambda s, x: F.concat(s, F.transform(s, lambda v: v + x["delta"])))
    miss = lambda v: F.abs(F.col("over") + v)
    choice = F.transform(sums, lambda v, i: F.struct(F.greatest(miss(v) - F.col("band"), F.lit(0.0)).alias("outside"), F.bit_count(i).alias("changed"), miss(v).alias("miss"), i.alias("mask")))
    chosen = levers.withColumn("mask", F.array_min(choice)["mask"])
    picked = F.filter(F.transform("levers", lambda x, k: F.when(F.call_function("shiftright", F.col("mask"), k).bitwiseAND(F.lit(1)) == 1, x)), lambda x: x.isNotNull())
    change = checkpoint(chosen.select(F.col("of"), F.inline(picked)).select("of", F.col("doc_id").alias("its_id"), F.col("rep").alias("its_rep"), F.col("size").alias("its_size"), "delta"))
    same = of(change) & F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("rep") == F.col("its_rep")) & (F.col("size") == F.col("its_size"))
    return rows.join(change, same, "left").withColumn("copies", F.col("copies") + F.coalesce(F.sign("delta").cast("bigint"), F.lit(0))).select(*OUT)


OUT = ("doc_id", "rep", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: int = 20, reserve: int = RESERVE, within: float | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken: one row per row of ``docs``.

    A document never gets more than ``cap`` copies, and its expected number of
    copies is its source's target over its size.  ``within`` (a share of the
    target) puts the target before that expectation in sources that would end
    further from it; copies still differ from the expectation by less than one.
    A document without words gets none.  Rows are told apart by doc_id, and rows that agree in doc_id,
    source and size by a number, so repeats are rounded one by one.  A null
    source is a source.  An empty table gives an empty result.  Other columns
    are ignored.
    """
    sizes = checkpoint(sized(docs).withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(F.lit(-1).cast("bigint"))))
    by_class = checkpoint(sizes.groupBy("source", "class").agg(F.count(F.lit(1)).alias("n_class"), F.sum("size").alias("size")))
    shares = targets(by_class, weights, cap).withColumnRenamed("source", "named")
    classes = checkpoint(by_class.drop("size").join(shares, F.col("source").eqNullSafe(F.col("named"))).select(F.col("source").alias("named"), F.col("class").alias("in_class"), "n_class", "source_size", "target"))
    n_classes, most = classes.agg(F.count(F.lit(1)), F.max("n_class")).first()
    classes = F.broadcast(classes) if n_classes <= BROADCAST_CLASSES else classes
    repeats = sizes.groupBy("doc_id", "source", "size", "class").agg(F.count(F.lit(1)).alias("n")).select("doc_id", "source", "size", "class", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("rep"))
    joined = repeats.join(classes, F.col("source").eqNullSafe(F.col("named")) & (F.col("class") == F.col("in_class"))).drop("named", "in_class")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rated = joined.withColumn("rate", rate).withColumn("sure", F.floor("rate")).withColumn("p", F.when(F.col("size") > 0, F.col("rate") - F.col("sure")).otherwise(F.lit(0.0)))
    key = ["source", "source_size", "target", "sure", "class", "n_class"]
    whole = rated.where("p = 0").select("doc_id", "rep", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("sure")).otherwise(F.lit(0)).alias("copies"))
    open_ = rated.where("p > 0").select(*key, "doc_id", "rep", "size", "p")
    pooled = _chance(F.col("doc_id"), F.col("rep"), 0, seed + 1) * F.col("n_class") < reserve
    pool, open_ = open_.where(pooled), open_.where(~pooled)
    done, level, span = [whole], 0, float(most or 0)
    while True:
        level, span = level + 1, span / block
        n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_class") / float(block**level))).cast("int")
        dealt = open_.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + 1), F.lit(level), "doc_id", "rep"), n_blocks))
        folded = dealt.groupBy(*key, "block").agg(F.sort_array(F.collect_list(F.struct("doc_id", "rep", "size", "p"))).alias("items"))
        folded = folded.select(*key, _fold(F.col("items"), level, seed).alias("f"))
        rows = checkpoint(folded.select(*key, F.inline(F.filter(F.concat(F.array("f.held"), F.col("f.done")), lambda v: v.isNotNull()))))
        done.append(rows.where("p <= 0 OR p >= 1").select(*OUT[:-1], (F.col("sure") + F.col("p").cast("bigint")).alias("copies")))
        open_ = rows.where("p > 0 AND p < 1")
        if span <= 1:
            break
    last = pool.withColumn("in_pool", F.lit(1)).unionByName(open_.withColumn("in_pool", F.lit(0)))
    item = F.struct("in_pool", (-F.col("size")).alias("minus"), "doc_id", "rep", "p")
    left = last.groupBy(*key[:4]).agg(F.sort_array(F.collect_list(item)).alias("items"))
    rate = F.col("target") / F.col("source_size") - F.col("sure")
    done.append(left.select(*key[:4], F.inline(_settle(F.col("items"), rate, seed))).select(*OUT[:-1], (F.col("sure") + F.col("p").cast("bigint")).alias("copies")))
    result = done[0].select(*OUT)
    for more in done[1:]:
        result = result.unionByName(more.select(*OUT))
    result = result.withColumn("copies", F.col("copies").cast("bigint"))
    if within is not None:
        result = _steered(result, within, seed)
    return result.drop("rep").withColumn("taken", F.col("copies") * F.col("size"))
