"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Sizes are words. Target words per source follow the weights, stop at `max_copies` times the
source's own words, and the excess is reshared by weight (water filling). A source whose target
is e times its size gives floor(e) whole passes and one partial pass.

Every source is permuted by a hash of doc_id and cut into blocks of equal hash range. A pass
uses each block at most once, so the draws of a source are disjoint blocks of a permutation.
The exact number of draws per source is split over the output shards by a binary tree: at each
node the left half gets a multivariate-hypergeometric share of what is there, drawn source by
source, and the rest goes right. Leaves hold exact quotas; a source's draws are handed to the
shards in order, and each shard is shuffled by itself. All choices come from hashes of the
seed, so reruns agree.

What a row needs is a few numbers of its source, so texts are never shuffled for the decision.
The partial pass ends at a hash threshold found by narrowing histograms, never by ordering the
documents of a source in one task; a few documents are then added or taken back to come nearer.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows
without doc_id share one place in the permutation; repeated rows are taken alike; sources
without words have target 0; empty tables give empty results; other columns are kept as they
are (`mix`) or ignored (`assign`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import WORD, stored

WEIGHTS = (1.0, 2.0, 3.0)  # by order of source, repeating
MAX_COPIES = 3
BLOCK_DOCS = 256  # documents in a block, on average
SHARD_LEVELS = 3  # 2^3 output shards
SEED = 7
_SPAN = 1 << 60  # permuted places
_SWAPS = 3
_LEVELS, _FAN_BITS = 4, 12  # histogram narrowing: 4 levels of 4096 parts


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column, seed: int) -> Column:
    """Place of a document in its source's permutation, in [0, 2^60)."""
    return F.xxhash64(F.lit(seed), doc_id.cast("string")).bitwiseAND(F.lit(_SPAN - 1))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


# ---- targets --------------------------------------------------------------------------

def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """(source, n_docs, source_size, target) per source; sizes has source, size.

    The order of the sources needs one sort of the per-source totals (one row per source).
    """
    totals = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    totals = stored(totals.withColumn("weight", weight), "source-totals")
    cap = F.col("source_size") * F.lit(float(max_copies))
    everything = totals.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while everything:  # each pass caps at least one more source or ends
        full, open_weight = totals.agg(
            F.sum(F.when(cap <= F.col("weight") * level, cap).otherwise(0.0)),
            F.sum(F.when(cap <= F.col("weight") * level, 0.0).otherwise(F.col("weight"))),
        ).first()
        if not open_weight or (everything - full) / open_weight <= level:
            break
        level = (everything - full) / open_weight
    return totals.withColumn("target", F.least(cap, F.col("weight") * F.lit(level)))


# ---- partial passes -------------------------------------------------------------------

def cut_points(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds whole (passes), cut (places below it are in the partial pass) and swaps (places
    whose membership is turned over).

    sizes: source, place, size. Each level sums one range of places per source in 4096 parts
    and goes into the part where the running sum passes what is left.
    """
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-12)).otherwise(0)
    state = stored(
        sources.withColumn("whole", ratio.cast("long"))
        .withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("low", F.lit(0).cast("long")),
        "passes",
    )
    width = _SPAN
    for _ in range(_LEVELS):
        width >>= _FAN_BITS
        known = state.select(F.col("source").alias("_s"), F.col("low").alias("_low"))
        part = F.floor((F.col("place") - F.col("_low")) / F.lit(width))
        sums = (
            sizes.join(known, _same(F.col("source"), F.col("_s")))
            .where((F.col("place") >= F.col("_low")) & (F.col("place") < F.col("_low") + F.lit(width << _FAN_BITS)))
            .groupBy(F.col("_s"), part.alias("part")).agg(F.sum("size").alias("words"))
        )
        run = F.sum("words").over(Window.partitionBy("_s").orderBy("part"))
        sums = sums.withColumn("before", run - F.col("words"))
        # the last part that begins at or before what is left
        start = (
            sums.alias("h").join(state.alias("t"), _same(F.col("h._s"), F.col("t.source")))
            .where("h.before <= t.left")
            .groupBy(F.col("h._s").alias("_s"))
            .agg(F.max(F.struct("part", "before", "words")).alias("m"))
        )
        state = stored(
            state.join(start, _same(state.source, start._s), "left")
            .withColumn("low", F.col("low") + F.coalesce(F.col("m.part"), F.lit(0)) * F.lit(width))
            .withColumn("left", F.col("left") - F.coalesce(F.col("m.before"), F.lit(0)))
            .withColumn("edge", F.coalesce(F.col("m.words"), F.lit(0)))
            .select(*[c for c in state.columns if c != "edge"], "edge"),
            "passes",
        )
    # the narrowest part holds about one document: in when that comes nearer to the target
    inside = (F.col("edge") > 0) & (F.col("left") * 2 >= F.col("edge"))
    state = state.withColumn("cut", F.when(F.col("target") > 0, F.col("low") + F.when(inside, F.lit(width)).otherwise(0)).otherwise(0))
    state = state.withColumn("left", F.col("left") - F.when(inside, F.col("edge")).otherwise(0))
    # what is still missing (or too much) is made up by single documents of about that size
    keep = [c for c in state.columns if c not in ("low", "edge")]
    state = state.select(*keep, F.expr("CAST(array() AS ARRAY<BIGINT>)").alias("swaps"))
    for _ in range(_SWAPS):
        missing = F.abs(F.col("left"))
        known = state.where("target > 0").select(F.col("source").alias("_s"), "cut", "left", "swaps")
        best = (
            sizes.join(known, _same(F.col("source"), F.col("_s")))
            .where((F.col("size") > 0) & (F.abs(F.col("size") - missing) < missing)
                   & F.expr("if(left > 0, place >= cut, place < cut) AND NOT array_contains(swaps, place)"))
            .groupBy("_s")
            .agg(F.min(F.struct(F.abs(F.col("size") - missing), F.col("place"), F.col("size"))).alias("b"))
        )
        state = stored(
            state.join(best, _same(state.source, best._s), "left")
            .withColumn("swaps", F.expr("if(b IS NULL, swaps, concat(swaps, array(b.place)))"))
            .withColumn("left", F.expr("if(b IS NULL, left, left - sign(left) * b.size)"))
            .select(*keep, "swaps"),
            "passes",
        )
    return state.drop("left")


# ---- splitting tree -------------------------------------------------------------------

def hypergeometric(total: str, kind: str, draws: str, u: str) -> str:
    """SQL: how many of `draws` items are of the kind that `kind` of `total` are, from u in [0, 1).

    Inversion around the mode: weights follow the ratio of neighbouring probabilities, going up
    from the mode and then down from it, as far as 12 standard deviations.
    """
    low = f"greatest(0D, {draws} + {kind} - {total})"
    high = f"least({draws}, {kind})"
    mode = f"least(greatest(floor(({draws} + 1) * ({kind} + 1) / ({total} + 2)), {low}), {high})"
    reach = (
        f"ceil(12 * sqrt({draws} * ({kind} / greatest({total}, 1D)) * (1 - {kind} / greatest({total}, 1D))"
        f" * ({total} - {draws}) / greatest({total} - 1, 1D)) + 8)"
    )
    up = (f"(({kind} - k) * ({draws} - k)) / ((k + 1) * ({total} - {kind} - {draws} + k + 1))")
    down = (f"(k * ({total} - {kind} - {draws} + k)) / (({kind} - k + 1) * ({draws} - k + 1))")

    def walk(steps: str, ratio: str, sign: str, target: str | None, begin: str) -> str:
        """Sum of the weights on one side; with a target, the outcome where the sum passes it."""
        weight = f"w.w * (transform(array(p.mode {sign} (i - 1)), k -> {ratio})[0])"
        if target is None:
            return (f"aggregate({steps}, named_struct('w', 1D, 'c', 0D), (w, i) -> "
                    f"named_struct('w', {weight}, 'c', w.c + {weight}), w -> w.c)")
        return (f"aggregate({steps}, named_struct('w', 1D, 'c', {begin}, 'k', p.mode), (w, i) -> "
                f"named_struct('w', {weight}, 'c', w.c + {weight}, "
                f"'k', if(w.c <= {target}, p.mode {sign} i, w.k)), w -> w.k)")

    rise = "if(p.top >= 1, sequence(1L, p.top), array())"
    fall = "if(p.deep >= 1, sequence(1L, p.deep), array())"
    rise, fall = (f"CAST({x} AS ARRAY<BIGINT>)" for x in (rise, fall))
    sums = f"named_struct('up', {walk(rise, up, '+', None, '')}, 'down', {walk(fall, down, '-', None, '')})"
    pick = (
        f"transform(array({sums}), r -> transform(array({u} * (1 + r.up + r.down)), v -> CASE "
        f"WHEN v < 1 THEN p.mode "
        f"WHEN v < 1 + r.up THEN {walk(rise, up, '+', 'v', '1D')} "
        f"ELSE {walk(fall, down, '-', 'v', '1D + r.up')} END)[0])[0]"
    )
    shape = (f"named_struct('mode', {mode}, 'top', CAST(least({high} - {mode}, {reach}) AS BIGINT), "
             f"'deep', CAST(least({mode} - {low}, {reach}) AS BIGINT))")
    return f"transform(array({shape}), p -> {pick})[0]"


def split_tree(quotas: DataFrame, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """(shard, source, quota): quotas (source, draws) split exactly over 2^levels shards.

    One row per tree node holds the draws of all sources; a level halves every node. Sources are
    drawn one after the other from what the earlier ones left (conditional hypergeometrics).
    """
    nodes = quotas.groupBy().agg(
        F.sort_array(F.collect_list(F.struct("key", F.col("draws").cast("double").alias("n")))).alias("q")
    ).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        total = "aggregate(q, 0D, (s, x) -> s + x.n)"
        u = f"((xxhash64({seed}, {level}, node, x.key) & {(1 << 52) - 1}L) / {float(1 << 52)}D)"
        share = hypergeometric("s.total", "x.n", "s.need", u)
        step = (
            f"transform(array({share}), d -> named_struct('total', s.total - x.n, 'need', s.need - d, "
            f"'got', concat(s.got, array(d))))[0]"
        )
        left = (
            f"aggregate(q, named_struct('total', {total}, 'need', floor({total} / 2) + CAST(0 AS DOUBLE), "
            f"'got', CAST(array() AS ARRAY<DOUBLE>)), (s, x) -> {step}, s -> s.got)"
        )
        nodes = (
            nodes.withColumn("got", F.expr(left))
            .withColumn("side", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))))
            .select(
                (F.col("node") * 2 + F.col("side")).alias("node"),
                F.expr("transform(q, (x, i) -> named_struct('key', x.key, 'n', "
                       "if(side = 0, got[i], x.n - got[i])))").alias("q"),
            )
        )
        nodes = stored(nodes, "tree-level")
    return nodes.select(F.col("node").alias("shard"), F.explode("q").alias("q")).select(
        "shard", F.col("q.key").alias("key"), F.col("q.n").cast("long").alias("quota")
    )


# ---- the mix --------------------------------------------------------------------------

def plan(
    sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, levels: int = SHARD_LEVELS, seed: int = SEED
) -> DataFrame:
    """One row per source: target, blocks, passes, cut and the running shard quotas.

    sizes: source, place, size.
    """
    sources = cut_points(sizes, targets(sizes, weights, max_copies))
    blocks = F.greatest(F.ceil(F.col("n_docs") / BLOCK_DOCS), F.lit(1)).cast("long")
    width = F.ceil(F.lit(float(_SPAN)) / F.col("blocks")).cast("long")
    sources = stored(
        sources.withColumn("key", F.concat(F.when(F.col("source").isNull(), "1").otherwise("0"), F.coalesce("source", F.lit(""))))
        .withColumn("blocks", blocks)
        .withColumn("width", width)
        .withColumn("draws", F.col("whole") * F.col("blocks") + F.ceil(F.greatest("cut", F.coalesce(F.array_max("swaps") + 1, F.lit(0))) / F.col("width")).cast("long")),
        "source-plan",
    )
    ends = F.expr("transform(sequence(1, size(q)), n -> aggregate(slice(q, 1, n), 0L, (s, x) -> s + x.quota))")
    shards = (
        split_tree(sources.select("key", "draws"), levels, seed).groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("shard", "quota"))).alias("q"))
        .select("key", ends.alias("ends"))
    )
    return stored(sources.join(shards, "key").drop("key"), "mix-plan")


def copies(place_: Column) -> Column:
    """array<struct<pass, block, shard>> of a row joined with its source's plan."""
    return F.expr(
        "transform(filter(sequence(0L, whole), p -> p < whole OR (_place < cut) <> array_contains(swaps, _place)), p -> named_struct("
        "'pass', p, 'block', CAST(floor(_place / width) AS BIGINT), "
        "'shard', aggregate(ends, 0, (n, e) -> n + int(e <= p * blocks + floor(_place / width)))))"
    )


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size")
    ).withColumn("place", place(F.col("doc_id"), seed))


def assign(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, copies."""
    sizes = stored(sized(docs, seed), "sizes")
    made = plan(sizes.select("source", "place", "size"), weights, max_copies, levels, seed)
    chosen = made.select(F.col("source").alias("_s"), "source_size", "target", "whole", "cut", "swaps", "width", "blocks", "ends")
    return (
        sizes.withColumnRenamed("place", "_place")
        .join(chosen, _same(F.col("source"), F.col("_s")))
        .select("doc_id", "size", "source_size", "target", copies(F.col("_place")).alias("copies"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, levels: int = SHARD_LEVELS, seed: int = SEED) -> DataFrame:
    """The mixed documents: columns of docs, one row per copy taken, shards shuffled locally.

    Rows come out by shard (partitioned and ordered inside); texts move once, to their shard.
    """
    sizes = stored(sized(docs, seed).select("source", "place", "size"), "sizes")
    made = plan(sizes, weights, max_copies, levels, seed)
    chosen = made.select(F.struct("source", "whole", "cut", "swaps", "width", "blocks", "ends").alias("_plan"))
    whole_row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    taken = (
        docs.select(whole_row.alias("_row"), place(F.col("doc_id"), seed).alias("_place"))
        .join(chosen, _same(F.col("_row.source").cast("string"), F.col("_plan.source")))
        .select("_row", "_place", "_plan.*")
        .select("_row", "_place", F.explode(copies(F.col("_place"))).alias("_copy"))
    )
    spread = F.pmod(F.col("_place"), F.lit(64))  # a shard is written by several tasks
    order = F.xxhash64(F.lit(seed + 1), "_copy.pass", "_place")
    return (
        taken.repartition("_copy.shard", spread).sortWithinPartitions(F.col("_copy.shard"), order).select("_row.*")
    )
