"""Mixing sources to target weights by a low-discrepancy schedule.

Slots 0, 1, 2, ... of equal size in words are dealt to sources: slot k goes
where the golden-ratio point frac(k * phi) falls among the cumulative target
shares, so every stretch of the schedule is close to the targets. The slots of a
source are ranked; rank r takes block r of the source's documents, which are
shuffled by a hash, laid end to end, cut into blocks of equal words, and begun
again after the last block. A slot whose source has met its target stays empty,
and slots that a source lacks are added at the end, so each source's words meet
its target, rounded to whole words.

A copy of a document belongs to the slot that its first word falls in, and
``scheduled_documents`` returns it with that slot: in the order of slots every
stretch of the mix is near the targets, but for the length of a block and of the
documents at its ends. ``repeat_documents`` gives the rows in that order.

Ranks and offsets are prefix sums over chunks of bounded size, never over a
whole source in one task.

Defined results: a null or empty text has size 0 and is never taken; a null
source is a source of its own, last in order; ties of the hash go by doc_id and
size, so equal rows are interchangeable and reruns agree; an empty table, or one
without a word, gives targets of 0. Other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quibble.llm.common import free_name
from quibble.operators.numbering import number_rows
from quibble.sources.staging import stage

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
BLOCKS_PER_SOURCE = 1024  # of an average source
CHUNK = 4096  # slots ranked by one group
BUCKET_ROWS = 1_000  # documents summed up by one group, on average
_GOLDEN = 0.6180339887498949


def count_words(text: str = "text") -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    c = F.col(text)
    for blank in "\t\n\x0b\f\r":
        c = F.replace(c, F.lit(blank), F.lit(" "))
    return F.coalesce(F.size(F.array_remove(F.split(c, " "), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``sources(source, source_size)`` with ``rank``, ``weight`` and ``target``.

    A level L gives each source min(most * size, L * weight). It starts at all words shared by
    weight; each round gives what capped sources leave over to the others, until none is above.
    Only the sums of a round reach the driver.
    """
    ordered = number_rows(sources, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    table = stage(ordered.withColumn("weight", weight), "sources")
    cap = F.col("source_size") * most
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = cap <= F.lit(level) * F.col("weight") if capped >= 0 else F.lit(False)
        n, held, free = table.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n == capped or not free:
            break
        level, capped = (total - (held or 0)) / free, n
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def _prefix(df: DataFrame, by: list[str], group: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over the rows before, within ``by``, in the order of (``group``, ``order``).

    Sums per group are added up first, one row per group, then rows within a group.
    """
    sums = df.groupBy(*by, group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*by).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    own = Window.partitionBy(*by, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inner.join(sums, [*by, group]).withColumn(name, F.col("_base") + F.col("_own")).drop("_base", "_own")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """(slot, source_no, rank, start, stop): which words of the source's endless stream a slot takes.

    ``sources`` comes from ``targets``; streams begin at word 0 and end at the rounded target.
    """
    spark = sources.sparkSession
    goal = F.floor(F.col("target") + 0.5).cast("long")
    upper = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # one row per source
    bounds = sources.select("rank", goal.alias("goal"), "target").withColumn("_to", F.sum("target").over(upper))
    bounds = stage(
        bounds.select(
            F.col("rank").alias("source_no"), "goal", F.ceil(F.col("goal") / block).cast("long").alias("quota"),
            (F.col("_to") - F.col("target")).alias("_from"), "_to",
        ),
        "shares",
    )
    total, slots, most = bounds.agg(F.max("_to"), F.sum("quota"), F.max("quota")).first()
    if not total:
        return spark.createDataFrame([], "slot long, source_no long, rank long, start long, stop long")
    # Sources in cells of equal width, so a point is compared with the few that its cell touches.
    cells = 4096
    cell = lambda c: F.least(F.greatest(F.floor(c / total * cells), F.lit(0)), F.lit(cells - 1))
    by_cell = bounds.where("_to > _from").withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to")))))
    points = spark.range(slots).withColumn("_point", F.pmod(F.col("id") * F.lit(_GOLDEN), F.lit(1.0)) * total)
    dealt = points.withColumn("_cell", cell(F.col("_point"))).join(by_cell, "_cell")
    dealt = dealt.where("_point >= _from and _point < _to").select("id", "source_no", F.lit(1).alias("_one"))
    dealt = dealt.withColumn("_chunk", F.floor(F.col("id") / CHUNK))
    ranked = _prefix(dealt, ["source_no"], "_chunk", ["id"], "_one", "rank").select("id", "source_no", "rank")
    ranked = stage(ranked, "ranked")
    had = ranked.groupBy("source_no").agg(F.count(F.lit(1)).alias("_had"))
    lacking = bounds.join(had, "source_no", "left").select(
        "source_no", "quota", F.coalesce("_had", F.lit(0)).alias("_had")
    )
    added = lacking.where("_had < quota").withColumn("rank", F.explode(F.sequence("_had", F.col("quota") - 1)))
    added = added.select((F.lit(slots) + F.col("rank")).alias("id"), "source_no", "rank")
    both = ranked.unionByName(added).join(bounds.select("source_no", "goal", "quota"), "source_no").where("rank < quota")
    start = F.col("rank") * block
    return both.select(
        F.col("id").alias("slot"), "source_no", "rank", start.alias("start"), F.least(start + block, F.col("goal")).alias("stop")
    )


def _placed(docs: DataFrame, seed: str, blocks_per_source: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows of ``mix`` with source_no and ``_start``, their place in the source's words; the schedule; the block."""
    added = ("size", "source_size", "target", "taken")
    kept = [c for c in docs.columns if c not in (*added, "text")]
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = stage(
        docs.select(*[f"`{c}`" for c in kept], count_words().alias("size"), order.alias("_order")), "sizes"
    )
    sums = stage(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows")), "source-sizes"
    )
    goals = stage(targets(sums), "targets")
    n, total = goals.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    block = max(1, (total or 0) // (max(1, n) * blocks_per_source))
    plan = schedule(goals, block)

    # Each document's place in its source's stream of words: hash buckets keep the groups small.
    same = F.col("r.source").eqNullSafe(F.col("g.source"))
    names = goals.select("source", "source_size", "target", "_rows", F.col("rank").alias("source_no"))
    at = rows.alias("r").join(names.alias("g"), same).drop(F.col("g.source"))
    share = F.conv(F.substring("_order", 1, 8), 16, 10).cast("double") / float(1 << 32)
    at = at.withColumn("_bucket", F.floor(share * F.ceil(F.col("_rows") / BUCKET_ROWS)))
    at = _prefix(at, ["source_no"], "_bucket", ["_order", "doc_id", "size"], "size", "_start")

    # Blocks of the stream: how often each is taken, and the documents it cuts through. A pass
    # over the source ends with its last word, so a slot may reach from its end to its beginning.
    size = goals.select(F.col("rank").alias("source_no"), "source_size")
    spans = plan.join(size, "source_no")
    spans = spans.select(
        "source_no", "source_size",
        F.explode(F.sequence(F.floor(F.col("start") / F.col("source_size")), F.floor((F.col("stop") - 1) / F.col("source_size")))).alias("_pass"),
        "start", "stop",
    )
    base = F.col("_pass") * F.col("source_size")
    spans = spans.select(
        "source_no",
        (F.greatest("start", base) - base).alias("_a"),
        (F.least(F.col("stop"), base + F.col("source_size")) - base).alias("_b"),
    )
    cells = spans.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / block), F.floor((F.col("_b") - 1) / block))))
    low, high = F.col("_cell") * block, (F.col("_cell") + 1) * block
    cells = cells.groupBy("source_no", "_cell", F.greatest("_a", low).alias("_a"), F.least("_b", high).alias("_b")).agg(
        F.count(F.lit(1)).alias("_times")
    )
    # The words taken of [a, b) are a difference of a running total: totals at block borders, and
    # the spans of the one block that a document's border lies in.
    per_cell = cells.groupBy("source_no", "_cell").agg(
        F.sum((F.col("_b") - F.col("_a")) * F.col("_times")).alias("_words"),
        F.collect_list(F.struct("_a", "_b", "_times")).alias("_spans"),
    )
    per_cell = per_cell.withColumn("_group", F.floor(F.col("_cell") / CHUNK))
    totals = stage(_prefix(per_cell, ["source_no"], "_group", ["_cell"], "_words", "_before"), "blocks")
    totals = totals.select("source_no", "_cell", "_before", "_spans")

    def upto(at_word: Column) -> Column:
        inside = F.aggregate(
            F.coalesce(F.col("_spans"), F.array()), F.lit(0).cast("long"),
            lambda acc, s: acc + F.greatest(F.lit(0), F.least(at_word, s["_b"]) - s["_a"]) * s["_times"],
        )
        # A block that is never taken lies behind all that are.
        return F.coalesce(F.col("_before"), F.floor(F.col("target") + 0.5).cast("long")) + inside

    at = at.withColumn("_stop", F.col("_start") + F.col("size"))
    for border, name in (("_start", "_from"), ("_stop", "_to")):
        # the last block that begins before the border
        at = at.withColumn("_cell", F.greatest(F.lit(0), F.floor((F.col(border) - 1) / block)))
        at = at.join(totals, ["source_no", "_cell"], "left").withColumn(name, upto(F.col(border)))
        at = at.drop("_before", "_spans", "_cell")
    at = at.select(
        *[f"`{c}`" for c in kept], "size", "source_size", "target", (F.col("_to") - F.col("_from")).alias("taken"),
        F.col("source_no").alias("_source_no"), "_start",
    )
    return at, plan, block


def mix(docs: DataFrame, seed: str = "mix", blocks_per_source: int = BLOCKS_PER_SOURCE) -> DataFrame:
    """``docs`` with size, source_size, target, ``taken``, the words that the mix takes of each row, and ``mix_slot``.

    ``mix_slot`` is the slot of the schedule that the row's first copy falls in, null for a row that is not taken.
    The text is not shuffled: rows travel with their columns other than ``text``. A column with the name
    of an added one is replaced.
    """
    own = {c: f"_own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "source", "text")}  # so that no name clashes
    renamed = docs.select("doc_id", "source", "text", *[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    at, plan, block = _placed(renamed, seed, blocks_per_source)
    at = at.withColumn("_rank", F.when(F.col("taken") > 0, F.floor(F.col("_start") / block)))
    slots = plan.select(F.col("source_no").alias("_source_no"), F.col("rank").alias("_rank"), F.col("slot").alias("mix_slot"))
    added = ("size", "source_size", "target", "taken", "mix_slot")
    kept = [F.col(own.get(c, c)).alias(c) for c in docs.columns if c not in (*added, "text")]
    return at.join(slots, ["_source_no", "_rank"], "left").select(*kept, *added)


def scheduled_documents(docs: DataFrame, seed: str = "mix", blocks_per_source: int = BLOCKS_PER_SOURCE) -> DataFrame:
    """Rows of the mix with ``mix_slot``, the slot of the schedule, and ``mix_word``, the place in the source's stream.

    Each document comes as often as the mix takes its words, rounded to whole documents. The stream of
    a source is taken from its begin on, so at most one document of a source is taken in part; that
    one is rounded. Only rows that are taken move, with their text. Slots hold one source each, and
    (mix_slot, mix_word) is the order of the mix.
    """
    names = [f"`{c}`" for c in docs.columns if c not in ("mix_slot", "mix_word")]
    row = free_name(docs, "_row")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
    copies = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    at, plan, block = _placed(rows.select(F.col(row).alias("_row"), "doc_id", "source", "text"), seed, blocks_per_source)
    taken = at.where("taken > 0").withColumn("_copies", copies).where("_copies > 0")
    taken = taken.select("*", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    taken = taken.withColumn("mix_word", F.col("_copy") * F.col("source_size") + F.col("_start"))
    taken = taken.withColumn("_rank", F.floor(F.col("mix_word") / block))
    slots = plan.select(F.col("source_no").alias("_source_no"), F.col("rank").alias("_rank"), F.col("slot").alias("mix_slot"))
    taken = taken.join(slots, ["_source_no", "_rank"]).select(F.col("_row").alias(row), "mix_slot", "mix_word")
    return rows.drop("mix_slot", "mix_word").join(taken, row).select(*names, "mix_slot", "mix_word")


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``scheduled_documents`` in the order of the mix, with the columns of ``docs``."""
    names = [f"`{c}`" for c in docs.columns]
    added = [c for c in ("mix_slot", "mix_word") if c in docs.columns]  # these stay as they came
    own = docs.withColumnsRenamed({c: f"_own_{c}" for c in added})
    ordered = scheduled_documents(own).orderBy("mix_slot", "mix_word").drop("mix_slot", "mix_word")
    return ordered.withColumnsRenamed({f"_own_{c}": c for c in added}).select(*names)
