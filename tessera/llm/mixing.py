"""Mixing sources to target weights by thresholds on a hash, found from nested histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import discard, saved

#: Buckets of a histogram are 2 ** BITS; so many levels are refined, which takes up LEVELS * BITS bits of the hash.
BITS, LEVELS = 12, 3
#: A source is close to its target if so much of it or less is missing.
CLOSE = 0.001
SPANS = "array<struct<since:bigint,to:bigint,most:double>>"
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """``sizes`` (source, size) with target, the words to take: sources in code-point order, null last, have ``weights`` in
    turn and share ``factor`` of all words by them; none gets more than ``most`` times its size, and what is over is shared
    again among the others by weight, until none is above.

    Sources may be many: they are ranked by a range sort, and each round of sharing is one sum over them.
    """
    ordered = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    ordered = saved(ordered.withColumn("part", F.shiftright("at", 33)), "sources")
    # rows by partition of the sort, as many as the session has shuffle partitions
    counts = sorted((r.part, r.n) for r in ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    total = ordered.agg(F.sum("size")).first()[0]
    if not counts:
        return ordered.select("source", "size", F.lit(0.0).alias("target"))
    before, starts = 0, []
    for part, n in counts:
        starts += [F.lit(part), F.lit(before)]
        before += n
    place = F.element_at(F.create_map(*starts), F.col("part")) + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighed = saved(ordered.select("source", "size", turn.alias("weight"), (F.col("size") * most).alias("top")), "weighed")
    level, was = None, None  # words for a weight of one, among the sources that are not full
    while level is None or level != was:
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("top")
        r = weighed.agg(F.sum(F.when(full, F.col("top"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("over")).first()
        if not r.over:
            break
        was, level = level, (factor * total - (r.taken or 0.0)) / r.over
    return weighed.select("source", "size", F.least("top", F.col("weight") * F.lit(float(level))).alias("target"))


def digit(place, level: int):
    """The bucket of a hash at a level, from the top bits down."""
    return F.shiftrightunsigned(place, 64 - BITS * (level + 1)).bitwiseAND((1 << BITS) - 1)


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(key, source, place, size, source_size, target, copies, taken) for each row of ``docs``.

    A source whose target is k times its size and r words more gives k copies of every document, and one more of those
    whose hash is below a threshold that holds about r words. The threshold comes from histograms: words by source and
    top bits of the hash; then only the bucket in which the running sum passes r is looked at by its next bits, LEVELS
    times. Where a long document at the threshold would leave a source more than CLOSE of its target short, the documents
    above that still fit get a threshold of their own in the same way, until that is so of none or nothing fits. Then of
    the documents not taken, the one whose size is nearest to the few words still missing is taken too if that helps.
    Documents are never sorted; the widest aggregate has a row for each source and bucket.

    The hash is of key and text, so the same rows give the same mix whatever their order or partitioning; rows equal in
    both are taken or left together. A null or empty text has size 0; a null source is a source of its own, the last; no
    documents give no rows. Sources may be many: none is brought to the driver.
    """
    rows = saved(docs.select(key, F.col(source).alias("source"), _place(key, text).alias("place"), _size(text).alias("size")), "sizes")
    out = _copied(rows, plan(rows, weights, factor, most))
    return out.select(key, "source", "place", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as :func:`mix` has copies of it."""
    measured = [F.col(source).alias("source"), _place(key, text).alias("place"), _size(text).alias("size")]
    rows = saved(docs.select(*measured), "sizes")
    side = plan(rows, weights, factor, most)
    discard(rows)
    out = _copied(docs.select(F.struct(*docs.columns).alias("row"), *measured), side).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def _place(key: str, text: str):
    return F.xxhash64(key, text)


def _size(text: str):
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def _top():
    """The bits of a hash that thresholds look at."""
    return F.shiftrightunsigned("place", 64 - BITS * LEVELS)


def plan(rows: DataFrame, weights: tuple[float, ...], factor: float, most: float) -> DataFrame:
    """(s, source_size, target, base, spans, extra) by source for ``rows`` (source, place, size): the whole copies of all;
    the spans of hashes, each with the longest document it takes, that give one copy more; and one document besides."""
    sizes = saved(rows.groupBy("source").agg(F.sum("size").alias("size")), "source-sizes")
    base = F.when(F.col("size") > 0, F.least(F.floor(F.col("target") / F.col("size")), F.lit(int(most)))).otherwise(0).cast("int")
    plans = targets(sizes, weights, factor, most).withColumn("base", base)
    plans = saved(plans.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", "base", (F.col("target") - F.col("base") * F.col("size")).alias("left")), "plans")

    now = saved(plans.where("left > 0").select("s", "target", "left", F.lit(0).cast("long").alias("since")), "short")
    steps: DataFrame | None = None
    while now.limit(1).count():
        step = saved(step_of(rows, now), "step")
        steps = step if steps is None else steps.unionByName(step)
        discard(now)
        now = saved(step.where(F.col("rest") > F.col("target") * CLOSE).select("s", "target", F.col("rest").alias("left"), (F.col("to") + 1).alias("since")), "short")
    if steps is None:
        return saved(plans.select("*", F.array().cast(SPANS).alias("spans"), F.lit(None).cast("long").alias("extra")), "plan")
    spans = saved(steps.groupBy("s").agg(F.collect_list(F.struct("since", "to", "most")).alias("spans"), F.min("rest").alias("rest")), "spans")
    # of the documents not taken, the one whose size comes nearest to what is still missing; of equals the least hash
    rest = spans.select(F.col("s").alias("t"), "spans", "rest")
    off = F.abs(F.col("size") - F.col("rest"))
    above = rows.join(rest, rows.source.eqNullSafe(rest.t)).where(~_within() & (off < F.col("rest"))).select("t", "place", off.alias("off"))
    nearest = saved(above.groupBy("t").agg(F.min("off").alias("least")), "nearest").withColumnRenamed("t", "u")
    extra = above.join(nearest, above.t.eqNullSafe(nearest.u) & (above.off == nearest.least)).groupBy("u").agg(F.min("place").alias("extra"))
    both = plans.join(spans.withColumnRenamed("s", "v"), F.col("s").eqNullSafe(F.col("v")), "left").drop("v")
    both = both.join(extra, F.col("s").eqNullSafe(F.col("u")), "left").drop("u", "rest", "left")
    # written, so that its size is known and the join to it can be a broadcast where that is small
    out = saved(both, "plan")
    discard(sizes, plans, spans, nearest)
    return out


def step_of(rows: DataFrame, now: DataFrame) -> DataFrame:
    """(s, target, since, to, most, rest) for the sources of ``now`` (s, target, left, since) that have a document which
    fits: those of hashes from ``since`` to below ``to`` and of at most ``most`` words are taken, ``rest`` words are left."""
    joined = rows.join(now, rows.source.eqNullSafe(now.s)).where((_top() >= F.col("since")) & (F.col("size") <= F.col("left")))
    inside = joined.select("s", "place", "size")
    sums = inside.groupBy("s").agg(F.sum("size").alias("all")).where(F.col("all") > 0).withColumnRenamed("s", "t")
    known = saved(now.join(sums, now.s.eqNullSafe(F.col("t"))).drop("t"), "known")
    whole = known.where(F.col("all") <= F.col("left")).select("s", "target", "since", F.lit(1 << BITS * LEVELS).alias("to"), F.col("left").alias("most"), (F.col("left") - F.col("all")).alias("rest"))

    edge = known.where(F.col("all") > F.col("left")).select("s", "left", F.array().cast("array<bigint>").alias("digits"))
    for level in range(LEVELS):
        cut = edge.select(F.col("s").alias("t"), "left", "digits")
        part = inside.join(cut, F.col("s").eqNullSafe(F.col("t"))).where(_same(level))
        buckets = part.groupBy("s", digit(F.col("place"), level).alias("bucket")).agg(F.sum("size").alias("n"))
        # at most 2 ** BITS rows of a source; its running sum passes what is left in one of them
        upto = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        run = buckets.withColumn("to", F.sum("n").over(upto))
        passed = run.join(cut, F.col("s").eqNullSafe(F.col("t"))).where((F.col("to") - F.col("n") <= F.col("left")) & (F.col("to") > F.col("left")))
        edge = saved(passed.select("s", (F.col("left") - (F.col("to") - F.col("n"))).alias("left"), F.concat("digits", F.array("bucket")).alias("digits")), "edge")
    to = F.aggregate("digits", F.lit(0).cast("long"), lambda a, d: a * (1 << BITS) + d)
    ends = edge.select(F.col("s").alias("t"), F.col("left").alias("rest"), to.alias("to"))
    cut = known.join(ends, F.col("s").eqNullSafe(F.col("t"))).select("s", "target", "since", "to", F.col("left").alias("most"), "rest")
    return whole.unionByName(cut)


def _within():
    """Whether a document is of one of its source's spans."""
    return F.exists("spans", lambda x: (_top() >= x.since) & (_top() < x.to) & (F.col("size") <= x.most))


def _copied(rows: DataFrame, side: DataFrame) -> DataFrame:
    """``rows`` (source, place, size) with their source's plan and the number of copies."""
    more = F.coalesce(_within(), F.lit(False)) | F.coalesce(F.col("place") == F.col("extra"), F.lit(False))
    return rows.join(side, rows.source.eqNullSafe(side.s)).withColumn("copies", F.col("base") + F.when(more, 1).otherwise(0))


def _same(level: int):
    """Rows of the boundary's buckets at all levels before this one."""
    same = F.lit(True)
    for i in range(level):
        same &= digit(F.col("place"), i) == F.element_at("digits", i + 1)
    return same
