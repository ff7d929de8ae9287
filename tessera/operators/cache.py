"""What clients hold and what a server still sends: cache models, byte limits, message chunks, LRU."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Payload bytes of one message at most, and the bytes that a message's header may take.
MESSAGE_BYTES = 987
HEADER_BYTES = 60


def not_held(needed: DataFrame, holdings: DataFrame, keys: list[str]) -> DataFrame:
    """needed without what is held in full (holdings.complete)."""
    return needed.join(holdings.filter("complete").select(*keys), keys, "left_anti")


def resume_offsets(needed: DataFrame, holdings: DataFrame, keys: list[str]) -> DataFrame:
    """Adds skip: the bytes of each needed bin that are held already."""
    held = holdings.select(*keys, F.col("bytes").alias("_b"))
    return needed.join(held, keys, "left").withColumn("skip", F.coalesce("_b", F.lit(0))).drop("_b")


def merge_bins(bins: DataFrame, keys: list[str]) -> DataFrame:
    """One row per bin: its longest copy's length, and whether any copy was marked as the last."""
    return bins.groupBy(*keys).agg(F.max("bytes").alias("bytes"), F.bool_or("complete").alias("complete"))


def fold_model(statements: DataFrame, keys: list[str], order: str) -> DataFrame:
    """State of each bin after its statements in order: kind is 'partial' (with bytes), 'complete' or 'remove'.

    A removal forgets all before it; then the greatest of the partial bytes counts, and complete wins.
    """
    removed = F.max(F.when(F.col("kind") == "remove", F.col(order))).over(Window.partitionBy(*keys))
    after = statements.withColumn("_r", removed).filter(F.col("_r").isNull() | (F.col(order) > F.col("_r")))
    return after.groupBy(*keys).agg(
        F.bool_or(F.col("kind") == "complete").alias("complete"),
        F.coalesce(F.max(F.when(F.col("kind") == "partial", F.col("bytes"))), F.lit(0)).alias("bytes"),
    )


def id_ranges(held: DataFrame, by: list[str], id_col: str) -> DataFrame:
    """Runs of consecutive ids: by..., first, last."""
    rows = held.select(*by, id_col).distinct()
    number = F.row_number().over(Window.partitionBy(*by).orderBy(id_col))
    runs = rows.withColumn("_run", F.col(id_col) - number)
    return runs.groupBy(*by, "_run").agg(F.min(id_col).alias("first"), F.max(id_col).alias("last")).drop("_run")


def model_text(ranges: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """by..., model: the ranges as tokens such as P0-3,P5, in id order."""
    token = F.concat(
        F.lit(prefix), F.col("first").cast("string"), F.when(F.col("last") > F.col("first"), F.concat(F.lit("-"), "last")).otherwise("")
    )
    listed = F.array_sort(F.collect_list(F.struct("first", token.alias("t"))))
    return ranges.groupBy(*by).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("model"))


def parse_model(models: DataFrame, model_col: str = "model") -> DataFrame:
    """One row per token of cache-model text: kind ('partial', 'complete', 'remove'), class, first, last, bytes.

    H (or Ht) names tile headers, P precincts, Hm the main header, M metadata; a minus sign removes; `:n` holds n bytes.
    """
    token = models.select("*", F.explode(F.split(model_col, ",")).alias("_t")).withColumn("_t", F.trim("_t")).filter("_t <> ''")
    m = lambda i: F.regexp_extract("_t", r"^(-?)(Hm|Ht|H|P|M)(\d*)(?:-(\d+))?(?::(\d+))?$", i)
    number = lambda i: F.when(m(i) != "", m(i).cast("bigint"))
    return token.filter(m(2) != "").select(
        *models.columns,
        F.when(m(1) == "-", "remove").when(m(5) != "", "partial").otherwise("complete").alias("kind"),
        F.when(m(2) == "Ht", "H").otherwise(m(2)).alias("class"),
        F.coalesce(number(3), F.lit(0)).alias("first"),
        F.coalesce(number(4), number(3), F.lit(0)).alias("last"),
        number(5).alias("bytes"),
    )


def vbas_bytes(value: str) -> str:
    """SQL for the bytes of a number in groups of seven bits."""
    return f"greatest(1, cast(ceil(length(bin({value})) / 7) as int))"


def bin_id_bytes(value: str) -> str:
    """SQL for the bytes of a bin id, whose first byte has room for four bits."""
    return f"cast(ceil((if({value} = 0, 0, length(bin({value}))) + 3) / 7) as int)"


def messages(bins: DataFrame, size: str, most: int = MESSAGE_BYTES) -> DataFrame:
    """One row per message of each bin: message, msg_offset, msg_length, is_last; an empty bin has one empty message."""
    count = f"greatest(1, cast(ceil({size} / {most}) as int))"
    each = bins.selectExpr("*", f"explode(sequence(0, {count} - 1)) AS message")
    return each.selectExpr(
        "*", f"cast(message as bigint) * {most} AS msg_offset", f"least({size} - message * {most}, {most}) AS msg_length",
        f"message = {count} - 1 AS is_last",
    )


def deliver(bins: DataFrame, by: list[str], order: str, id_col: str, size: str, budget: int) -> DataFrame:
    """Messages of each response (`by`) that a byte limit lets out, with what of their payload is sent.

    Messages go out in order until one finds fewer than HEADER_BYTES plus its payload left: of that one, a part is sent if
    over HEADER_BYTES are left, and nothing after it. The response's first message names its class, in one byte more.
    A message costs a byte at least, so no response reads more messages than its limit has bytes.
    """
    sized = messages(bins, size).withColumn(
        "_cost", F.expr(f"msg_length + {bin_id_bytes(id_col)} + {vbas_bytes('msg_offset')} + {vbas_bytes('msg_length')}")
    )
    earlier = Window.partitionBy(*by).orderBy(order, "message").rowsBetween(Window.unboundedPreceding, -1)
    sent = sized.withColumn("_before", F.sum("_cost").over(earlier)).withColumn(
        "_left", F.lit(budget) - F.when(F.col("_before").isNull(), 0).otherwise(F.col("_before") + 1)
    )
    some = sent.filter(F.col("_left") > HEADER_BYTES)
    # costs only add up, so the first message that does not fit in full leaves too little for any after it
    fits = F.least("msg_length", F.col("_left") - HEADER_BYTES)
    return some.select(*bins.columns, "message", "msg_offset", "msg_length", "is_last", fits.alias("sent"), (fits == F.col("msg_length")).alias("whole"))


def zero_filled(grid: DataFrame, bins: DataFrame, keys: list[str]) -> DataFrame:
    """The full grid of packets with the bins at hand; an absent one is a single zero byte."""
    present = bins.select(*keys, F.col("bytes").alias("_b"))
    joined = grid.join(present, keys, "left")
    return joined.withColumns({"present": F.col("_b").isNotNull(), "bytes": F.coalesce("_b", F.lit(1))}).drop("_b")


def lru_victims(used: DataFrame, by: list[str], item: str, at: str) -> DataFrame:
    """by..., victim: the item whose last use is the oldest."""
    last = used.groupBy(*by, item).agg(F.max(at).alias("_at"))
    return last.groupBy(*by).agg(F.min_by(item, F.struct("_at", item)).alias("victim"))


def lru_kept(touches: DataFrame, by: list[str], item: str, at: str, size: str, budget: int) -> DataFrame:
    """by..., item, bytes, last_touch of what each cache holds after its touches in order of `at`.

    A touch makes an item the newest, with the size of that touch; then the oldest go until the rest fits the budget.
    Sizes may change, so what was pushed out depends on the order: each cache is one fold over its touches, which pass in
    order and are not held; what it holds is bounded by the budget. Equal `at` are taken in order of the item.
    """
    names = [*by, item, at, size]
    rows = touches.select(*names).repartition(*by).sortWithinPartitions(*by, at, item)
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict = OrderedDict()
        now, total = None, 0

        def out() -> pa.RecordBatch:
            last = [(*now, i, n, t) for i, (n, t) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in last], t) for k, t in enumerate(arrow)], names=[*by, item, "bytes", "last_touch"])

        for batch in batches:
            arrow = [batch.schema.field(c).type for c in [*by, item, size, at]]
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                key, (i, t, n) = row[: len(by)], row[len(by) :]
                if key != now:
                    if held:
                        yield out()
                    held, now, total = OrderedDict(), key, 0
                total += n - held.pop(i, (0, None))[0]
                held[i] = (n, t)
                while total > budget and held:
                    total -= held.popitem(last=False)[1][0]
        if held:
            yield out()

    fields = ", ".join(f"`{c}` {types[c]}" for c in [*by, item]) + f", bytes {types[size]}, last_touch {types[at]}"
    return rows.mapInArrow(fold, fields)


def committed(holdings: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """What a session's client holds once a response is out: of each bin the longer of what it held and what was sent. Both
    have keys..., bytes, complete. Responses are made from the holdings as they were, and committed when they are out."""
    columns = [*keys, "bytes", "complete"]
    return merge_bins(holdings.select(*columns).unionByName(sent.select(*columns)), keys)


def with_headers(bins: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """The bins, and of the other set the headers only; both have keys..., class, bytes, complete."""
    both = bins.unionByName(headers_only(other).select(*bins.columns))
    return merge_bins(both, [*keys, "class"])


def headers_only(bins: DataFrame) -> DataFrame:
    """The bins that are not precincts (classes 0 and 1): what a soft reset keeps."""
    return bins.filter(~F.col("class").isin(0, 1))
