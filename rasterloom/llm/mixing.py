"""Sources interleaved to target weights by Pfair scheduling.

Each source is cut into blocks of text of the same number of bytes.  Weights
are exact shares u/U of whole numbers: u is the weight against the largest one,
U their sum, with U up to 2**41, so that a share is off by less than a part in
10**12 of the largest for each source there is.  Block k of a source (from 0)
is released at slot floor(kU/u) and due at slot ceil((k+1)U/u); each slot goes
to the released block that is due first.  With a full load every block meets
its window, so at any slot each source is less than one block away from its
share of the slots, however many slots there are.

When a source has given its last block the others go on with the same weights
among themselves: a new ``epoch`` begins at the next slot, and windows count
from there.  So no slot stays empty, rows are neither dropped nor repeated, and
``on_target`` tells the rows of epoch 0, where all sources still take part.

The schedule is a list of blocks, not of rows.  ``block_bytes`` is 64 KiB, or
the least power of two by which the mix has no more than ``max_blocks`` (2**18)
blocks and one more a source: the unit of a mix is at most a part in 2**17 of it,
so the schedule's size is bounded while its deviation stays under one block.
It is worked out in SQL, slot by slot, in one row; rows then meet their block's
slot in a join on source and block, which no source can make skewed.

All of it is DataFrame and SQL functions.  Within a source the order is a
pseudo-random one by the hash of the id; a source is numbered in buckets of
that hash - a window per bucket, and prefix sums over buckets - so a source
that holds a third of all rows is not one task's work.

Defined results: a null source is a source of its own; null and empty texts
take no bytes and stand with the block at which they fall; null ids are spread
by the hash of their text; rows equal in id and text have places next to each
other, and which is which shows in no column added; an empty table gives an
empty result.  Columns of the input are kept; those named like the columns
added are replaced.  There may be any number of sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADDED = ("block", "release", "deadline", "slot", "at_byte", "epoch", "on_target")
BLOCK_BYTES, MAX_BLOCKS = 1 << 16, 1 << 18
UNITS = 1 << 41  # the largest sum of shares: times a number of blocks it stays below 2**63
_STRETCH = 256  # slots in a list; lists are joined by stretches, so that appending stays cheap

# The block to be given at slot s.t: among released ones that due first (then the first source by name).
_PICK = """
array_min(transform(u, (w, i) -> if(s.done[i] < blocks[i] and ((s.done[i] - s.base[i]) * s.total) div w <= s.t - s.start,
  struct(((s.done[i] - s.base[i] + 1) * s.total + w - 1) div w as due, i as i), null)))
"""
# What a slot does to the state; an epoch ends with a source's last block.  An aggregate over
# one element names the pick ``p`` for the expression: other than transform it copies nothing.
_DONE = "transform(s.done, (c, i) -> c + if(i = p.i, 1L, 0L))"
_ENDED = "s.done[p.i] + 1 = blocks[p.i]"
_STEP = f"""
aggregate(array({_PICK}), s, (s, p) -> named_struct(
  't', s.t + 1L, 'start', if({_ENDED}, s.t + 1L, s.start), 'epoch', s.epoch + if({_ENDED}, 1L, 0L),
  'total', if({_ENDED}, s.total - u[p.i], s.total), 'done', {_DONE}, 'base', if({_ENDED}, {_DONE}, s.base),
  'picks', array_append(s.picks, named_struct('i', p.i, 'block', s.done[p.i],
    'release', s.start + ((s.done[p.i] - s.base[p.i]) * s.total) div u[p.i], 'deadline', s.start + p.due, 'slot', s.t, 'epoch', s.epoch))))
"""
_PICKS = "array<struct<i: int, block: bigint, release: bigint, deadline: bigint, slot: bigint, epoch: bigint>>"
_FRESH = f"cast(array() as {_PICKS})"
_SCHEDULE = f"""
aggregate(sequence(0L, (slots - 1) div {_STRETCH}),
  named_struct('s', named_struct('t', 0L, 'start', 0L, 'epoch', 0L, 'total', total, 'done', transform(u, w -> 0L), 'base', transform(u, w -> 0L), 'picks', {_FRESH}),
    'lists', cast(array() as array<{_PICKS}>)),
  (a, c) -> aggregate(array(
      aggregate(sequence(c * {_STRETCH}, least((c + 1) * {_STRETCH}, slots) - 1),
        named_struct('t', a.s.t, 'start', a.s.start, 'epoch', a.s.epoch, 'total', a.s.total, 'done', a.s.done, 'base', a.s.base, 'picks', {_FRESH}),
        (s, x) -> {_STEP})), a,
    (a, r) -> named_struct('s', r, 'lists', array_append(a.lists, r.picks))),
  a -> a.lists)
"""


def shares(sources: DataFrame) -> DataFrame:
    """Whole shares ``u`` >= 1 from positive weights ``w``, in proportion to them; one row a source."""
    every = Window.partitionBy()
    units = F.expr(f"{UNITS}L div n")
    ideal = sources.withColumn("n", F.count(F.lit(1)).over(every)).withColumn("most", F.max("w").over(every))
    return ideal.select(*sources.columns, F.greatest(F.round(F.col("w") / F.col("most") * units), F.lit(1)).cast("long").alias("u"))


def schedule(table: DataFrame) -> DataFrame:
    """``(skey, block, release, deadline, slot, epoch)``: a row for each block of each source.

    ``table`` has ``skey``, ``u`` and ``blocks`` >= 1, one row a source.
    """
    one = table.agg(F.sort_array(F.collect_list(F.struct("skey", "u", "blocks"))).alias("all")).filter(F.size("all") > 0)
    one = one.select("all", F.expr("transform(all, x -> x.u)").alias("u"), F.expr("transform(all, x -> x.blocks)").alias("blocks"))
    sums = [F.expr(f"aggregate({c}, 0L, (s, x) -> s + x)").alias(n) for c, n in (("u", "total"), ("blocks", "slots"))]
    lists = one.select("all", "u", "blocks", *sums).select("all", F.explode(F.expr(_SCHEDULE)).alias("list"))
    picks = lists.select("all", F.explode("list").alias("p"))
    return picks.select(F.expr("all[p.i].skey").alias("skey"), *(F.col(f"p.{c}").alias(c) for c in ("block", "release", "deadline", "slot", "epoch")))


def _weight(weights: Column | dict | None) -> Column:
    if weights is None:
        return F.col("bytes")
    if not isinstance(weights, dict):
        return weights
    named = [F.lit(x) for k, v in weights.items() for x in ("" if k is None else f"={k}", float(v))]
    missing = F.raise_error(F.concat(F.lit("no weight for source "), F.col("skey"))).cast("double")
    return F.coalesce(F.try_element_at(F.create_map(*named), F.col("skey")), missing)


def mixed(docs: DataFrame, weights: Column | dict | None = None, block_bytes: int = BLOCK_BYTES, max_blocks: int = MAX_BLOCKS, buckets: int = 4096, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", prefix: str = "") -> DataFrame:
    """The rows with ``block``, ``release``, ``deadline``, ``slot``, ``at_byte``, ``epoch`` and ``on_target``.

    The names of these begin with ``prefix``.  Sorted by ``(slot, at_byte, id)`` they are the mix.  ``weights`` maps sources
    to positive weights (a source that is not named raises an error), or is an
    expression over ``bytes``, the size of a source; the default keeps their shares.
    """
    kept = [c for c in docs.columns if c not in {prefix + a for a in ADDED}]
    source = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit(""))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        *(docs[c] for c in kept),
        source.alias("_mix_source"),
        F.md5(F.coalesce(docs[id_col].cast("string"), F.concat(F.lit("null:"), F.md5(text)))).alias("_mix_digest"),
        F.xxhash64(text).alias("_mix_text"),
        F.octet_length(text).cast("long").alias("_mix_size"),
    )
    rows = rows.withColumn("_mix_bucket", F.expr(f"cast(conv(substring(_mix_digest, 1, 6), 16, 10) as bigint) * {buckets} div 16777216"))
    # one row for each source and bucket, summed before it is shuffled
    narrow = rows.groupBy(F.col("_mix_source").alias("skey"), F.col("_mix_bucket").alias("b")).agg(F.sum("_mix_size").alias("n"))
    before = Window.partitionBy("skey").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = narrow.select(F.col("skey").alias("_mix_source"), F.col("b").alias("_mix_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_mix_before"))
    # one row a source from here on
    sizes = narrow.groupBy("skey").agg(F.sum("n").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())
    least = F.greatest(F.lit(block_bytes), F.ceil(total / max_blocks)).cast("long")
    # the least power of two that is large enough, where a larger block is needed at all
    grown = F.expr("shiftleft(1L, length(bin(_least - 1)))")
    sizes = sizes.withColumn("_least", least).withColumn("_unit", F.when(F.col("_least") > block_bytes, grown).otherwise(F.lit(block_bytes)).cast("long"))
    # a text of no bytes behind the last full block begins a block of its own
    weighed = sizes.select("skey", "_unit", F.greatest(_weight(weights).cast("double"), F.lit(1e-9)).alias("w"), F.expr("bytes div _unit + 1").alias("blocks"))
    table = shares(weighed)
    plan = schedule(table).select(F.col("skey").alias("_mix_source"), F.col("block").alias("_mix_block"), *(F.col(c).alias(f"_mix_{c}") for c in ("release", "deadline", "slot", "epoch")))
    order = Window.partitionBy("_mix_source", "_mix_bucket").orderBy("_mix_digest", id_col, "_mix_size", "_mix_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_mix_local", F.coalesce(F.sum("_mix_size").over(order), F.lit(0))).join(offsets, ["_mix_source", "_mix_bucket"])
    placed = placed.withColumn("_mix_at", F.col("_mix_before") + F.col("_mix_local"))
    units = table.select(F.col("skey").alias("_mix_source"), F.col("_unit").alias("_mix_unit"))
    placed = placed.join(units, "_mix_source").withColumn("_mix_block", F.expr("_mix_at div _mix_unit"))
    timed = placed.join(plan, ["_mix_source", "_mix_block"])
    added = (*(F.col(f"_mix_{c}") for c in ("block", "release", "deadline", "slot", "at", "epoch")), F.col("_mix_epoch") == 0)
    return timed.select(*kept, *(c.alias(prefix + name) for c, name in zip(added, ADDED)))
