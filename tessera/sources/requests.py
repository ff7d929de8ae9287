"""View-window requests as query strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components that can exist at all.
MOST_COMPONENTS = 16384
_ACCEPTED = ("jpp-stream", "image/jpp-stream", "*/*", "*")


def parse_requests(requests: DataFrame, query: str = "query") -> DataFrame:
    """requests' columns with the fields of each query string and error: 'empty', 'malformed', 'type' or null.

    target, fx, fy, round, ox, oy, sx, sy, comps, model, len, quality, cnew, cid, cclose, qid; unknown fields are left
    out, and of a repeated field the last counts.
    """
    text = F.regexp_replace(F.coalesce(F.col(query), F.lit("")), r"^\?", "")
    pairs = F.filter(F.split(text, "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.regexp_replace(p, "^[^=]*=?", "").alias("v")))
    rows = requests.withColumns({"_text": text, "_kv": entries})
    get = lambda k: F.filter("_kv", lambda e: e["k"] == k)
    value = lambda k: F.get(get(k), F.size(get(k)) - 1)["v"]
    names = ("target", "fsiz", "roff", "rsiz", "comps", "model", "len", "quality", "type", "cnew", "cid", "cclose", "qid")
    rows = rows.withColumns({f"_{n}": value(n) for n in names})
    part = lambda c, i: F.regexp_extract(c, r"^(\d+),(\d+)(?:,(round-up|round-down|closest))?$", i)
    number = lambda c, i: F.when(part(c, i) != "", part(c, i).cast("bigint"))
    item = lambda x: F.regexp_extract(x, r"^(\d+)(?:-(\d+))?$", 0) == x
    items = F.filter(F.split("_comps", ","), lambda x: x != "")
    low = lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int")
    high = lambda x: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(x, r"-(\d+)$", 1), F.lit("")), F.lit("999999999")).cast("int"), low(x))
    whole = lambda c: F.col(c).isNull() | F.col(c).rlike(r"^\d+$")
    span = F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.greatest(high(x) - low(x) + 1, F.lit(0)))
    ok_comps = F.coalesce(F.forall(items, lambda x: item(x) & (high(x) >= low(x))), F.lit(True))
    ok = (
        (F.col("_fsiz").isNull() | (part("_fsiz", 1) != ""))
        & (F.col("_roff").isNull() | F.col("_roff").rlike(r"^\d+,\d+$"))
        & (F.col("_rsiz").isNull() | F.col("_rsiz").rlike(r"^\d+,\d+$"))
        & ok_comps & (F.coalesce(F.when(ok_comps, span), F.lit(0)) <= MOST_COMPONENTS) & whole("_len") & whole("_quality") & whole("_qid")
    )
    types = F.transform(F.split("_type", ","), lambda t: F.substring_index(F.trim(t), ";", 1))
    error = (
        F.when(F.col("_text") == "", "empty")
        .when(~ok, "malformed")
        .when(F.col("_type").isNotNull() & ~F.exists(types, lambda t: t.isin(*_ACCEPTED)), "type")
    )
    listed = F.flatten(F.transform(items, lambda x: F.sequence(low(x), high(x))))
    direction = F.regexp_replace(F.nullif(part("_fsiz", 3), F.lit("")), "^round-", "")
    return rows.withColumn("error", error).select(
        *requests.columns, F.col("_target").alias("target"), number("_fsiz", 1).alias("fx"), number("_fsiz", 2).alias("fy"),
        direction.alias("round"), number("_roff", 1).alias("ox"), number("_roff", 2).alias("oy"), number("_rsiz", 1).alias("sx"),
        number("_rsiz", 2).alias("sy"), F.when(F.col("error").isNull(), listed).alias("comps"), F.col("_model").alias("model"),
        F.col("_len").try_cast("bigint").alias("len"), F.col("_quality").try_cast("bigint").alias("quality"), F.col("_cnew").alias("cnew"),
        F.col("_cid").alias("cid"), F.col("_cclose").alias("cclose"), F.col("_qid").try_cast("bigint").alias("qid"), "error",
    )


def format_request(fx: Column, fy: Column, ox: Column, oy: Column, sx: Column, sy: Column, round_: Column, comps: Column) -> Column:
    """The query string of a window; absent parts are left out."""
    direction = F.when(round_ == "closest", ",closest").when(round_ == "up", ",round-up").when(round_ == "down", ",round-down").otherwise("")
    pair = lambda name, a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(F.lit(f"{name}="), a.cast("string"), F.lit(","), b.cast("string")))
    return F.concat_ws(
        "&", F.concat(pair("fsiz", fx, fy), direction), pair("roff", ox, oy), pair("rsiz", sx, sy),
        F.when(F.size(comps) > 0, F.concat(F.lit("comps="), F.array_join(comps.cast("array<string>"), ","))),
    )


def transport(offered: Column) -> Column:
    """The transport agreed on: http, if it is among those offered."""
    return F.when(F.exists(F.split(offered, ","), lambda t: F.trim(t) == "http"), "http")
