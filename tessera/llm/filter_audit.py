"""How filters act together: what each removes, in every order in which they can be applied.

Which rows survive a set of filters does not depend on their order, so the orders of n filters are paths through the 2^n
sets. The sets are walked depth first: each set's survivors are filtered from those of the set before it, kept while
its own continuations are walked, and counted once for all filters that can come next. Each order's steps then are lookups.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, shared_dir

#: A text that makes up one in so many rows at least counts as frequent; there are at most as many of these.
FREQUENT = 1000

_COUNTS = "part string, state string, filter string, alive bigint, removed bigint, good_lost bigint, toxic_lost bigint"


def text_failures(text: Column) -> dict[str, Column]:
    """Which of the filters A to D a text fails: under 100 words; under 80 % distinct words; over 10 % of its code points are
    A-Z; it holds one of #$%&*|. Words are what spaces and the characters 9 to 13 separate; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("bigint") > 10 * F.char_length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def later_copies(rows: DataFrame, id_col: str, key: str) -> DataFrame:
    """rows and a column E: whether another row of an equal key has a smaller id. Null ids have no order: they fail nothing and
    make nothing fail. Rows of the at most FREQUENT most frequent keys are marked by a broadcast join and never meet in one
    task; the others are joined with the least id of their key."""
    copies = materialize(rows.groupBy(key).agg(F.min(id_col).alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "copies")
    bound = -(-rows.count() // FREQUENT)
    frequent = F.broadcast(copies.filter(F.col("_n") >= bound).drop("_n"))
    later = F.coalesce(F.col(id_col) > F.col("_first"), F.lit(False)).alias("E")
    kept = [c for c in rows.columns if c != key]
    crowded = rows.join(frequent, key).select(*kept, later)
    others = rows.join(frequent, key, "left_anti").join(copies.filter(F.col("_n") < bound).drop("_n"), key, "left")
    return crowded.unionByName(others.select(*kept, later))


def flags(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per row of docs: part, good, toxic and a boolean for each filter A to E, true where the row fails it.

    E: the text is that of a row with a smaller id, wherever that is. good and toxic: a label row of the id has quality
    or toxic 1. A null part is the empty string.
    """
    failed = text_failures(F.col("_text"))
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    digest = F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_digest")
    rows = materialize(slim.select("_id", "part", digest, *[c.alias(x) for x, c in failed.items()]), "flags")
    marks = labels.select(F.col(id_col).alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    marks = marks.filter("_id is not null").groupBy("_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    marked = later_copies(rows, "_id", "_digest").join(marks, "_id", "left")
    none = F.lit(False)
    return marked.select("part", F.coalesce("good", none).alias("good"), F.coalesce("toxic", none).alias("toxic"), *[F.col(x) for x in "ABCDE"])


def _leaving(survivors: DataFrame, state: str, nexts: Iterable[str]) -> DataFrame:
    """For each part and each filter that can come next: the rows alive, and those that it removes."""
    sums = [F.count("*").alias("alive")]
    for x in nexts:
        fails = F.col(x)
        sums += [F.count_if(c).alias(f"{x}{i}") for i, c in enumerate((fails, fails & F.col("good"), fails & F.col("toxic")))]
    fields = ", ".join(f"'{x}', alive, {x}0, {x}1, {x}2" for x in nexts)
    counted = survivors.groupBy("part").agg(*sums)
    return counted.selectExpr("part", f"'{state}' as state", f"stack({len(list(nexts))}, {fields}) as (filter, alive, removed, good_lost, toxic_lost)")


def removals(rows: DataFrame, filters: str) -> DataFrame:
    """What each filter removes from the survivors of each set of others: part, state (the set's letters), filter, alive,
    removed, good_lost, toxic_lost. rows: part, good, toxic and a boolean for each letter of filters, true where it fails.

    2^n - 1 counts over survivors for n filters, one for each set but the whole. At most n - 1 sets of survivors, those on
    the way to the set at hand, are kept; blocks that are lost with an executor are filtered from rows again.
    """
    path = f"{shared_dir(rows.sparkSession)}/tessera/removals-{uuid.uuid4().hex}"
    seen = set()

    def walk(survivors: DataFrame, state: str) -> None:
        seen.add(state)
        nexts = [x for x in filters if x not in state]
        _leaving(survivors, state, nexts).write.mode("append").parquet(path)
        for x in nexts:
            after = "".join(sorted(state + x))
            if after in seen or len(after) == len(filters):
                continue
            left = survivors.filter(~F.col(x)).drop(x)
            if len(after) + 1 < len(filters):
                left = left.persist()
            walk(left, after)
            left.unpersist()

    walk(rows, "")
    return rows.sparkSession.read.schema(_COUNTS).parquet(path)


def orders(filters: str) -> list[dict]:
    """Each order's steps, with the set of filters that come before."""
    return [
        {"filter_order": "".join(p), "step": i + 1, "state": "".join(sorted(p[:i])), "filter": x}
        for p in permutations(filters)
        for i, x in enumerate(p)
    ]


def audit(rows: DataFrame, filters: str) -> DataFrame:
    """One row per part, order and step: filter_order, step and the counts within the part: kept (after the step), removed (by
    it), redundant (failing its filter, but removed before), unique_fails (failing its filter only), good_lost and toxic_lost
    (of the removed), shapley (removed by its filter, summed over all orders).

    rows as for removals(). No rows, no parts. The grid of orders is n! * n rows a part, so filters are to be few.
    """
    edges = materialize(removals(materialize(rows, "audit"), filters), "edges")
    grid = F.from_json(F.lit(json.dumps(orders(filters))), "array<struct<filter_order: string, step: int, state: string, filter: string>>")
    steps = edges.filter("state = ''").select("part").distinct().select("part", F.inline(grid))
    counts = ["alive", "removed", "good_lost", "toxic_lost"]
    found = steps.join(edges, ["part", "state", "filter"], "left").fillna(0, counts)
    first, last = F.col("state") == "", F.length("state") == len(filters) - 1
    overall = found.groupBy("part", "filter").agg(
        F.max(F.when(first, F.col("removed"))).alias("fails"),
        F.max(F.when(last, F.col("removed"))).alias("unique_fails"),
        F.sum("removed").alias("shapley"),
    )
    return found.join(overall, ["part", "filter"]).select(
        "part", "filter_order", "step",
        (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails", "good_lost", "toxic_lost", "shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """audit() of the five filters of flags() over all rows of docs, by part.

    Null texts count as empty ones, and as copies of each other. Rows that share an id are counted each, and are copies of one
    another in no case; label rows that share an id are taken together. An empty table gives no rows; without labels,
    nothing good or toxic is lost. Other columns are not read, so their names may be any.
    """
    return audit(flags(docs, labels, id_col, text_col, part_col), "ABCDE")
