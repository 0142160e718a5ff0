"""Joins: size-checked lookups, first substring match, backward as-of, interval membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from faultline.fixed_values import FAULT_SECONDS, INFRA_WORDS
from faultline.functions.names import squash
from faultline.session import cut

BROADCAST_ROWS = 50_000
SALTS = 32


def fits(dim: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Count a dimension, but never past the limit."""
    return dim.limit(rows + 1).count() <= rows


def attach(
    fact: DataFrame,
    dim: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    small: bool | None = None,
) -> DataFrame:
    """Join a dimension onto a fact table.

    The dimension is broadcast only when it was counted (here, or by the caller through `small`).
    Beyond the limit both sides are shuffled on the keys plus a salt, so a key that holds a third
    of the facts is spread over `SALTS` tasks. Works for inner, left, semi and anti joins.
    """
    on = list(on)
    if small is None:
        small = fits(dim)
    if small:
        return fact.join(F.broadcast(dim), on, how)
    salt = F.pmod(F.xxhash64(*fact.columns), F.lit(SALTS)).cast("int")
    copies = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return fact.withColumn("_salt", salt).join(copies, on + ["_salt"], how).drop("_salt")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Send a short table to many tasks before it is unrolled into a long one.

    The number is explicit, because adaptive execution would merge the small partitions again.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *keys)


def keep_known(rows: DataFrame, members: DataFrame, on: Sequence[str], small: bool | None = None) -> DataFrame:
    """Rows whose key is in the dimension."""
    return attach(rows, members.select(*on).distinct(), on, "left_semi", small)


def encode_edges(edges: DataFrame, nodes: DataFrame, small: bool | None = None) -> DataFrame:
    """Edge endpoints as positions of the node list."""
    ends = nodes.select("system", "entity", "entity_idx")
    src = ends.select("system", F.col("entity").alias("src"), F.col("entity_idx").alias("src_idx"))
    dst = ends.select("system", F.col("entity").alias("dst"), F.col("entity_idx").alias("dst_idx"))
    return attach(attach(edges, src, ["system", "src"], small=small), dst, ["system", "dst"], small=small)


# --- first substring match -------------------------------------------------------------------


#: Names that are tested one by one in a single expression; more go through the index.
INLINE_NAMES = 32
#: Letters of the pieces under which names are posted.
GRAM = 3


def grams(text: Column, size: int = GRAM) -> Column:
    """Distinct substrings of `size` letters; a shorter text is one piece."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def _probes(text: Column) -> Column:
    """All pieces under which a name inside `text` can be posted: of full size, shorter ones, and the empty one."""
    return F.array_distinct(F.concat(F.array(F.lit("")), *[grams(text, k) for k in range(1, GRAM + 1)]))


def containing_pairs(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(system, text, name) for distinct texts (system, text) and distinct names (system, name) inside them.

    Each name is posted once, under the piece of it that the fewest names have. A text looks up its own pieces, and
    what it meets is compared in full. Work follows the pieces of the texts and the postings they meet, not texts times
    names. The texts' side is the fact of the join: postings are broadcast when counted as few, else both are salted.
    """
    pieces = names.select("system", "name", F.explode(grams(F.col("name"))).alias("gram"))
    counts = pieces.groupBy("system", "gram").agg(F.count("*").alias("_n"))
    rare = pieces.join(counts, ["system", "gram"]).groupBy("system", "name").agg(F.min(F.struct("_n", "gram")).alias("_g"))
    postings = rare.select("system", F.col("_g.gram").alias("gram"), "name")
    asked = texts.select("system", "text", F.explode(_probes(F.col("text"))).alias("gram"))
    met = attach(asked, postings, ["system", "gram"])
    return met.where(F.contains("text", "name")).select("system", "text", "name")


def _inline(text: str, names: list, exclude: str | None, either: bool) -> Column:
    """The first of a few names, tested in order within one expression."""
    tests = []
    for n in names:
        hit = F.contains(F.col(text), F.lit(n.name))
        if either:
            hit = hit | F.contains(F.lit(n.name), F.col(text))
        if exclude:
            hit = hit & (F.lit(n.name) != F.col(exclude))
        tests.append(F.when((F.col("system") == n.system) & hit, F.lit(n.name)))
    return F.coalesce(*tests, F.lit(None).cast("string"))


def first_containing(
    rows: DataFrame,
    text: str,
    names: DataFrame,
    out: str,
    exclude: str | None = None,
    either: bool = False,
    inline: bool | None = None,
    repeated: bool = False,
) -> DataFrame:
    """Add `out`: the first name (by `idx`) contained in `text`, or NULL.

    `names` holds (system, name, idx). `exclude` is a column whose value may not be chosen;
    with `either`, a text contained in the name counts as well.

    At most `INLINE_NAMES` names are tested within the row, or, where texts are `repeated` and their distinct ones were
    counted as few, once for each of those. Beyond, the distinct texts find their names through an
    index of rare pieces (`containing_pairs`), in both directions if asked; no row carries a list of names.
    """
    if inline is None:
        inline = fits(names, INLINE_NAMES)
    keys = ["system", text] + ([exclude] if exclude else [])
    if inline:
        few = sorted(names.select("system", "name", "idx").collect(), key=lambda n: (n.idx, n.name))
        if repeated:
            held = cut(rows.select(*keys).distinct().limit(BROADCAST_ROWS + 1))
            if held.count() <= BROADCAST_ROWS:
                return attach(rows, held.withColumn(out, _inline(text, few, exclude, either)), keys, "left", True)
        return rows.withColumn(out, _inline(text, few, exclude, either))
    asked = rows.select(*keys).distinct()
    texts = asked.select("system", F.col(text).alias("text")).where("text IS NOT NULL").distinct()
    whole = names.select("system", "name").distinct()
    pairs = containing_pairs(texts, whole)
    if either:
        swapped = containing_pairs(whole.withColumnRenamed("name", "text"), texts.withColumnRenamed("text", "name"))
        pairs = pairs.unionByName(swapped.select("system", F.col("name").alias("text"), F.col("text").alias("name")))
    ranked = names.groupBy("system", "name").agg(F.min("idx").alias("idx"))
    found = attach(pairs, ranked, ["system", "name"]).withColumnRenamed("text", text)
    if exclude:
        own = asked.where(F.col(exclude).isNotNull())
        found = attach(found, own, ["system", text]).where(F.col("name") != F.col(exclude))
    best = found.groupBy(*keys).agg(F.min(F.struct("idx", "name")).alias("_best"))
    best = best.select(*keys, F.col("_best.name").alias(out))
    return attach(rows, best, keys, "left")


def match_components(parts: DataFrame, names: DataFrame, small: bool | None = None, inline: bool | None = None) -> DataFrame:
    """Map fault components to services in three tiers: equal, substring either way, infra word.

    Adds `service` and `tier` (1, 2, 3, or NULL when unmapped). Infra word i stands for slot i mod N.
    """
    if small is None:
        small = fits(names)
    plain = names.select("system", squash(F.col("name")).alias("name"), "idx", F.col("name").alias("_full"))
    asked = parts.withColumn("_part", squash(F.col("component")))
    equal = plain.groupBy("system", F.col("name").alias("_part")).agg(F.min_by("_full", "idx").alias("_s1"))
    step = attach(asked, equal, ["system", "_part"], "left", small)
    folded = plain.groupBy("system", "name").agg(F.min("idx").alias("idx"), F.min_by("_full", "idx").alias("_s2"))
    step = first_containing(step, "_part", folded.drop("_s2"), "_n2", either=True, inline=inline)
    step = attach(step, folded.select("system", F.col("name").alias("_n2"), "_s2"), ["system", "_n2"], "left", small)
    word = F.array_position(
        F.transform(F.array(*[F.lit(w) for w in INFRA_WORDS]), lambda w: F.contains(F.col("_part"), w)), F.lit(True)
    )
    sized = names.groupBy("system").agg(F.count("*").alias("_n"))
    step = attach(step, sized, ["system"], "left", small)
    step = step.withColumn("_slot", F.when(word > 0, (word - 1) % F.col("_n")))
    slots = names.select("system", F.col("idx").alias("_slot"), F.col("name").alias("_s3"))
    step = attach(step, slots, ["system", "_slot"], "left", small)
    tier = (
        F.when(F.col("_s1").isNotNull(), 1).when(F.col("_s2").isNotNull(), 2).when(F.col("_s3").isNotNull(), 3)
    )
    return step.select(
        *parts.columns, F.coalesce("_s1", "_s2", "_s3").alias("service"), tier.cast("bigint").alias("tier")
    )


# --- time ------------------------------------------------------------------------------------


#: Bytes that the packed steps may take to be sent to every executor.
ASOF_BYTES = 8 << 20
#: Steps looked through for one event, on average at most.
ASOF_STEPS = 64


def asof_step(
    events: DataFrame,
    steps: DataFrame,
    ts: str = "ts",
    after_last: str = "drop",
    span: int = 3600,
    budget: int = ASOF_BYTES,
) -> DataFrame:
    """Add `step_ts`: the last time step at or before each event.

    Events without a time or before the first step are dropped; events after the last are dropped too, or kept on
    the last step with `after_last="keep"`.

    The steps are counted first: how many there are, how dense in buckets of `span` seconds, and how many buckets lie
    between the first and the last. If they fit into `budget` bytes, events look them up where they are
    (`_asof_lookup`); else, also where long gaps would make a long table, both sides are merged (`_asof_merge`).
    """
    events = events.where(F.col(ts).isNotNull())
    per = steps.groupBy("system", F.floor(F.col("ts") / span).alias("b")).agg(F.count("*").alias("n"))
    of = per.groupBy("system").agg(F.sum("n").alias("n"), F.count("*").alias("held"), (F.max("b") - F.min("b") + 1).alias("all"))
    n, held, whole = of.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "held", "all")]).first()
    finer = max(1, min(span, n // max(1, held) // ASOF_STEPS))
    if 8 * n + 64 * whole * finer <= budget:
        return _asof_lookup(events, steps, ts, after_last, max(1, span // finer))
    return _asof_merge(events, steps, ts, after_last, max(1, span // finer))


def _asof_lookup(events: DataFrame, steps: DataFrame, ts: str, after_last: str, span: int) -> DataFrame:
    """Steps packed per `span` seconds with the step carried in from the left and sent to all executors; an event needs
    one equality lookup, and none is moved. Empty buckets between occupied ones have a row."""
    bucket = lambda c: F.floor(F.col(c) / span).cast("bigint")
    packed = steps.groupBy("system", bucket("ts").alias("_b")).agg(F.collect_list("ts").alias("_steps"), F.max("ts").alias("_top"))
    order, whole = Window.partitionBy("system").orderBy("_b"), Window.partitionBy("system")
    rows = packed.select(
        "*",
        F.lag("_top").over(order).alias("_carry"),
        F.lead("_b").over(order).alias("_next"),
        F.max("_top").over(whole).alias("_last"),
    ).select("*", F.explode(F.sequence("_b", F.coalesce(F.col("_next") - 1, F.col("_b")))).alias("_at"))
    home = F.col("_b") == F.col("_at")
    table = rows.select(
        "system",
        F.col("_at").alias("_b"),
        "_last",
        F.when(home, F.col("_steps")).otherwise(F.array().cast("array<bigint>")).alias("_steps"),
        F.when(home, F.col("_carry")).otherwise(F.col("_top")).alias("_carry"),
    )
    if after_last == "keep":
        ends = steps.groupBy("system").agg(F.max("ts").alias("_end"))
        events = attach(events, ends, ["system"], small=True).withColumn("_at", F.least(F.col(ts), F.col("_end"))).drop("_end")
    else:
        events = events.withColumn("_at", F.col(ts))
    joined = attach(events.withColumn("_b", bucket("_at")), table, ["system", "_b"], small=True)
    inside = F.array_max(F.filter("_steps", lambda s: s <= F.col("_at")))
    found = joined.withColumn("step_ts", F.coalesce(inside, F.col("_carry"))).where(F.col("step_ts").isNotNull())
    if after_last == "drop":
        found = found.where(F.col(ts) <= F.col("_last"))
    return found.drop("_b", "_steps", "_carry", "_last", "_at")


def _asof_merge(events: DataFrame, steps: DataFrame, ts: str, after_last: str, span: int) -> DataFrame:
    """Events and steps sorted together in ranges of `span` seconds, and one step carried over each range's lower end.

    Only ranges that hold an event or a step exist. Events of a range are dealt to `SALTS` tasks, steps go to each, so
    a burst of events is no single task's work.
    """
    block = lambda c: F.floor(c / span).cast("bigint")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    known = steps.select("system", "ts").distinct()
    held = F.struct(*[F.col(c) for c in events.columns])
    asked = events.select("system", F.col(ts).alias("_at"), F.lit(None).cast("bigint").alias("_step"), held.alias("_e"), (F.rand(7) * SALTS).cast("int").alias("_salt"))
    laid = known.select("system", F.col("ts").alias("_at"), F.col("ts").cast("bigint").alias("_step")).withColumn("_e", F.lit(None).cast(asked.schema["_e"].dataType)).withColumn("_salt", salts)
    rows = asked.unionByName(laid).withColumn("_b", block(F.col("_at")))
    # ranges with a step, and those of events, in order: what each takes over from the one before
    ranges = events.select("system", block(F.col(ts)).alias("_b"), F.lit(None).cast("bigint").alias("_top")).distinct()
    ranges = ranges.unionByName(known.groupBy("system", block(F.col("ts")).alias("_b")).agg(F.max("ts").cast("bigint").alias("_top")))
    tops = ranges.groupBy("system", "_b").agg(F.max("_top").alias("_top"))
    line = Window.partitionBy("system").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select("system", "_b", F.last("_top", ignorenulls=True).over(line).alias("_carry"), F.max("_top").over(Window.partitionBy("system")).alias("_last"))
    inside = Window.partitionBy("system", "_b", "_salt").orderBy("_at", F.col("_e").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("_step", F.last("_step", ignorenulls=True).over(inside)).where(F.col("_e").isNotNull())
    joined = attach(seen.select("system", "_b", "_at", "_step", "_e"), carry, ["system", "_b"])
    found = joined.withColumn("step_ts", F.coalesce("_step", "_carry")).where(F.col("step_ts").isNotNull())
    if after_last == "drop":
        found = found.where(F.col("_at") <= F.col("_last"))
    return found.select(*[F.col("_e")[c].alias(c) for c in events.columns], "step_ts")


def fault_steps(steps: DataFrame, faults: DataFrame, duration: int = FAULT_SECONDS, how: str = "inner") -> DataFrame:
    """Steps with t0 <= ts < t0 + duration for some fault.

    Faults are laid into duration-wide buckets, so the range test runs behind an equality join.
    """
    bucket = lambda c: F.floor(c / duration).cast("bigint")
    laid = faults.withColumnRenamed("ts", "_t0").withColumn(
        "_b", F.explode(F.sequence(bucket(F.col("_t0")), bucket(F.col("_t0") + duration - 1)))
    )
    times = steps.withColumn("_b", bucket(F.col("ts"))).alias("s")
    inside = (F.col("s.ts") >= F.col("f._t0")) & (F.col("s.ts") < F.col("f._t0") + duration)
    same = (F.col("s.system") == F.col("f.system")) & (F.col("s._b") == F.col("f._b"))
    met = times.join(laid.alias("f"), same & inside, how)
    if how == "left_semi":
        return met.drop("_b")
    extra = [c for c in faults.columns if c not in ("system", "ts")]
    return met.select(*[F.col("s." + c) for c in steps.columns], *[F.col("f." + c) for c in extra])


def mark_normal(
    steps: DataFrame, faults: DataFrame, duration: int = FAULT_SECONDS, out: str = "is_normal"
) -> DataFrame:
    """Flag each step: false when some fault covers it."""
    spans = faults.select("system", "ts").distinct()
    hit = fault_steps(steps.select("system", "ts"), spans, duration, "left_semi").withColumn("_n", F.lit(False))
    return steps.join(hit, ["system", "ts"], "left").withColumn(out, F.coalesce("_n", F.lit(True))).drop("_n")


def usable_steps(steps: DataFrame, small: bool | None = None) -> DataFrame:
    """Add `use_step`: the normal steps, or every step of a system that has no normal one."""
    some = steps.groupBy("system").agg(F.bool_or("is_normal").alias("_some"))
    return attach(steps, some, ["system"], small=small).withColumn(
        "use_step", F.col("is_normal") | ~F.col("_some")
    ).drop("_some")


def in_range(
    points: DataFrame,
    ranges: DataFrame,
    at: str,
    start: str,
    stop: str,
    block: int = 256,
) -> DataFrame:
    """Points inside [start, stop) of each range, matched block by block instead of by a range join."""
    laid = ranges.where(F.col(start) < F.col(stop)).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col(start) / block), F.floor((F.col(stop) - 1) / block)))
    )
    placed = points.withColumn("_b", F.floor(F.col(at) / block))
    met = placed.join(laid, ["system", "_b"])
    return met.where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("_b")
