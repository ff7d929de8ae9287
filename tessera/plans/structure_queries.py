"""Queries over headers, containers, captures and small tables of a codestream's parts, with their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import color, quant, transform
from tessera.operators import cache, frames, geometry, layout, viewport
from tessera.plans import sample_queries, stream_queries
from tessera.plans.common import SPANS_SQL, canvas, order_requests, part_images, shared_dir, table
from tessera.sources import codestream, images, jpp, requests, rtp, table_functions


def _hex(value: Column, size: int) -> Column:
    return F.lpad(F.hex(value), 2 * size, "0")


def component_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers with codings of their own for single components, of the image or of the tile, and what holds in the end."""
    rows = part_images(spark, sf_dir)
    i = F.col("image_id")
    of_image = codestream.component_segment(i % 3, (i + 1) % 6, i % 4 >= 2)
    of_tile = codestream.component_segment((i + 1) % 3, (i + 2) % 6, i % 4 < 2)
    raw = codestream.main_header_bytes(
        F.col("xsiz"), F.col("ysiz"), F.col("levels"), F.col("reversible"),
        more=F.when(i % 2 == 0, of_image).otherwise(""), tile_more=F.when(i % 5 == 0, of_tile).otherwise(""),
    )
    found = codestream.component_codings(codestream.markers(rows.select("image_id", raw.alias("content"))), "image_id")
    return found.select("image_id", F.col("c").cast("bigint").alias("c"), F.col("levels").cast("bigint").alias("levels"), "reversible", "from")


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers with a plain box, a box of two boxes and a codestream box that takes the rest."""
    n = F.col("p_partkey") % 40
    plain = F.concat(_hex(n + 8, 4), F.hex(F.lit("free")), F.repeat(F.lit("aa"), n.cast("int")))
    head = F.concat(_hex(F.lit(36), 4), F.hex(F.lit("jp2h")), _hex(F.lit(12), 4), F.hex(F.lit("ihdr")), F.lit("00000001"), _hex(F.lit(16), 4), F.hex(F.lit("colr")), F.lit("00" * 8))
    rest = F.concat(F.lit("00000000"), F.hex(F.lit("jp2c")), F.repeat(F.lit("bb"), (n + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.concat(plain, head, rest)).alias("content"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = codestream.boxes(_containers(spark, sf_dir))
    return found.select(
        "p_partkey", F.col("number").cast("bigint").alias("number"), F.col("depth").cast("bigint").alias("depth"), "type", "begin", "end"
    )


def boxes_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of the same containers, by a table function in SQL."""
    table_functions.register(spark)
    sql = "SELECT f.p_partkey, bigint(b.number) number, bigint(b.depth) depth, b.type, b.begin, b.end FROM {files} f, LATERAL boxes(f.content) b"
    return spark.sql(sql, files=_containers(spark, sf_dir))


def messages_in_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent as messages, counted by a table function in SQL."""
    table_functions.register(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("class"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("payload"))
    sql = """SELECT s.doc_id, count_if(m.eor IS NULL) messages, sum(if(m.eor IS NULL, m.msg_length, 0)) bytes, bigint(max(m.eor)) eor, count_if(m.is_last AND m.eor IS NULL) last
        FROM {streams} s, LATERAL jpp_messages(s.bytes) m GROUP BY s.doc_id"""
    return spark.sql(sql, streams=jpp.emit(docs, ["doc_id"], "id"))


def _image_files(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    i, height = F.col("p_partkey"), F.col("p_partkey") % 5 + 1
    count = (height * 4).cast("int")
    if kind == "pnm":
        sample = lambda k: _hex((i * 7 + k * 3) % 256, 1)
        head = F.concat(F.lit("P5\n4 "), height.cast("string"), F.lit("\n255\n"))
    else:
        sample = lambda k: _hex((i * 37 + k * 1001) % 65536, 2)
        head = F.concat(F.lit("PG ML - 16 4 "), height.cast("string"), F.lit("\n"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), count - 1), sample), "")
    raw = F.concat(F.encode(head, "UTF-8"), F.unhex(body))
    broken = F.when(i % 11 == 0, F.substring(raw, 2, 1000)).otherwise(raw)
    return table(spark, sf_dir, "part").select(i.cast("string").alias("path"), broken.alias("content"))


def _lines(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = images.image_lines(_image_files(spark, sf_dir, kind), kind)
        total = F.aggregate("row", F.lit(0).cast("bigint"), lambda a, x: a + x)
        return found.select(
            F.col("path").cast("bigint").alias("image"), F.coalesce(F.col("y").cast("bigint"), F.lit(-1)).alias("y"), F.coalesce(total, F.lit(0)).alias("total"),
            F.coalesce(F.col("row")[0].cast("bigint"), F.lit(0)).alias("first"), F.col("error").isNotNull().alias("broken"),
        )

    return query


def capture_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One capture file a user, some cut off in the last record, and the packets in them."""
    i = F.col("event_id")
    raw = rtp.packet_bytes(i % 65536, i * 1500 % (1 << 32), F.col("user_id"), i % 5 == 4, i % 5 == 0, F.lit(False), F.lit(0).cast("bigint"), F.unhex(F.repeat(F.lit("00"), (i % 50).cast("int"))))
    one = table(spark, sf_dir, "events").select("user_id", "event_id", F.concat(F.unhex(F.lit("ffff")), F.unhex(_hex(F.octet_length(raw), 2)), raw).alias("record"))
    files = one.groupBy("user_id").agg(F.expr("listagg(record, x'') WITHIN GROUP (ORDER BY event_id)").alias("content"))
    cut = F.when(F.col("user_id") % 7 == 0, F.expr("substring(content, 1, octet_length(content) - 5)")).otherwise(F.col("content"))
    found = rtp.parse_packets(rtp.captured_packets(files.select(F.col("user_id").cast("string").alias("path"), cut.alias("content"))))
    return found.groupBy(F.col("path").cast("bigint").alias("user_id")).agg(
        F.count("packet").alias("packets"), F.coalesce(F.sum(F.when(F.col("packet").isNotNull(), F.col("length").cast("bigint"))), F.lit(0)).alias("bytes"),
        F.count("error").alias("errors"), F.coalesce(F.max("ts"), F.lit(-1)).alias("last_ts"),
    )


def rtp_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets broken in eight ways, and the reason why each is not used."""
    i = F.col("event_id")
    fields = {
        "version": F.when(i % 9 == 1, "40").otherwise("80"),
        "kind": F.when(i % 9 == 3, "41").when(i % 9 >= 6, "00").otherwise("40"),
        "second": F.when(i % 9 == 2, "10").otherwise("00"),
        "flags": F.when(i % 9 == 3, "02").when(i % 9 == 4, "00").when(i % 9 == 5, "20").when(i % 9 == 7, "01").otherwise("00"),
        "colour": F.when(i % 9 == 4, "010101").otherwise("000000"),
    }
    text = F.concat(fields["version"], F.lit("60" + "0001" + "00000001" + "00000002"), fields["kind"], fields["second"], F.lit("0000"), fields["flags"], fields["colour"], F.lit("abcd"))
    raw = F.unhex(text)
    cut = F.when(i % 9 == 0, F.substring(raw, 1, 11)).when(i % 9 == 8, F.substring(raw, 1, 15)).otherwise(raw)
    found = rtp.parse_packets(table(spark, sf_dir, "events").select("event_id", cut.alias("packet")))
    return found.select("event_id", F.coalesce("reject", F.lit("")).alias("reject"))


def media_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that list the media types they take."""
    pick = F.col("o_orderkey") % 5
    kinds = F.when(pick == 0, "jpp-stream").when(pick == 1, "image/png, jpp-stream;ptype=ext").when(pick == 2, "image/png").when(pick == 3, "raw,text/plain").otherwise("")
    text = F.concat(F.lit("target=a&fsiz=64,64"), F.when(kinds != "", F.concat(F.lit("&type="), kinds)).otherwise(""))
    found = requests.parse_requests(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("query")))
    return found.select("o_orderkey", F.coalesce("error", F.lit("")).alias("error"))


def code_block_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many code-blocks of 32 by 32 each band of each resolution has."""
    grid = geometry.resolutions(geometry.tiles(part_images(spark, sf_dir))).filter("c = 0").withColumns({"cbw": F.lit(5), "cbh": F.lit(5)})
    found = geometry.code_blocks(geometry.subbands(grid))
    return found.groupBy("image_id", F.col("r").cast("bigint").alias("r"), "band").agg(
        F.sum(F.expr("ncbw * ncbh")).alias("blocks"), F.max("bx1").alias("width"), F.max("by1").alias("height")
    )


def precincts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each request's precincts by rising id: how many, and sums that depend on the order."""
    grid = geometry.resolutions(geometry.tiles(canvas(spark)))
    asked = order_requests(spark, sf_dir)
    keys = viewport.in_order(viewport.precinct_keys(viewport.resolve(asked, canvas(spark)), grid))
    return keys.groupBy("req_id").agg(F.count("*").alias("n"), F.min("I").alias("least"), F.max("I").alias("most"), F.sum(F.expr("I * (place % 7)")).alias("check"))


def smallest_precinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = "transform(sequence(0, levels), r -> named_struct('ppx', cast(4 + (image_id * 7 + r * 5) % 11 AS int), 'ppy', cast(4 + (image_id * 3 + r * 2) % 11 AS int)))"
    found = geometry.smallest_precinct(part_images(spark, sf_dir).withColumn("precincts", F.expr(sizes)))
    return found.select("image_id", F.col("ppx").cast("bigint").alias("ppx"), F.col("ppy").cast("bigint").alias("ppy"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS block", "cast(l_linenumber AS bigint) AS layer", "1 + l_partkey % 9 AS passes").distinct()


def layer_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as layers of blocks: the first pass of each. Repeated line numbers add up."""
    one = _layers(spark, sf_dir).groupBy("block", "layer").agg(F.sum("passes").alias("passes"))
    return layout.pass_starts(one, ["block"], "layer", "passes")


def bytes_per_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS tile", "cast(l_quantity AS bigint) AS length")
    return layout.bytes_by(packets, ["tile"])


def precinct_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of which only some precincts are wanted: the others stay, without bodies."""
    packets = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS tile", "l_suppkey % 16 AS p", "cast(l_quantity AS bigint) AS length")
    wanted = table(spark, sf_dir, "part").selectExpr("p_partkey AS tile", "explode(sequence(p_partkey % 4, 15L, 3L)) AS p")
    found = layout.wanted_packets(packets, wanted, ["tile", "p"])
    return found.groupBy("tile").agg(F.count("*").alias("packets"), F.count_if("dropped").alias("dropped"), F.sum("length").alias("bytes"))


def zero_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of the vectors' planes, in steps of 300, hold nothing."""
    plane = sample_queries._planes(spark, sf_dir)
    row = F.transform("row", lambda x: (x / 300).cast("int"))
    return plane.select("vec_id", F.col("y").cast("bigint").alias("y"), transform.all_zero(row).alias("zero"))


def first_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = frames.assemble(stream_queries.event_packets(spark, sf_dir)).filter("status = 'emitted'")
    return frames.first_frames(done, ["ssrc"], "frame", 3).select("ssrc", "frame", "bytes")


def session_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings after responses that resume what was held, to up to 700 bytes of each bin asked for."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS client", "l_partkey % 3630 AS id", "cast(20 * l_quantity AS bigint) AS bytes", "l_linestatus = 'F' AS complete")
    held = cache.merge_bins(lines, ["client", "id"])
    needed = table(spark, sf_dir, "orders").selectExpr("o_custkey % 100 AS client", "o_orderkey % 3630 AS id").distinct()
    open_ = cache.resume_offsets(cache.not_held(needed, held, ["client", "id"]), held, ["client", "id"])
    sent = open_.select("client", "id", F.greatest(F.col("skip"), F.lit(700)).alias("bytes"), (F.col("skip") >= 700).alias("complete"))
    return cache.committed(held, sent, ["client", "id"])


def merged_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of even clients with the headers of the odd ones that follow them."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS client", "l_orderkey % 9 AS class", "l_partkey % 50 AS id", "cast(l_quantity AS bigint) AS bytes", "l_linestatus = 'F' AS complete")
    bins = cache.merge_bins(rows, ["client", "class", "id"])
    other = bins.filter("client % 2 = 1").withColumn("client", F.col("client") + 1)
    return cache.with_headers(bins.filter("client % 2 = 0"), other, ["client", "id"])


def dwt53_real(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample_queries._samples(spark, sf_dir).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    return sample_queries._long(rows.select("vec_id", transform.forward(F.col("v"), "5/3-real").alias("w")), "w", 6)


def block_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded 31-bit magnitudes of 12-bit bands, with up to five planes missing, as coefficients in each way."""
    v = F.expr("if(event_id % 10 = 0, 0L, shiftleft((event_id * 2654435761) % 4096, 19) + if(event_id % 4 = 0, (event_id * 97) % 524288, 0L))")
    missing = F.expr("cast(event_id % 6 as int)")
    cut = F.when(missing > 0, F.expr("shiftleft(shiftright(v, cast(19 + event_id % 6 as int)), cast(19 + event_id % 6 as int))")).otherwise(F.col("v"))
    rows = table(spark, sf_dir, "events").select("event_id", v.alias("v")).withColumn("v", cut)
    negative, step = F.col("event_id") % 3 == 0, 0.25 + (F.col("event_id") % 8) * 0.125
    make = lambda roi, rev: quant.block_coefficient(F.col("v"), negative, missing, 12, roi, rev, step)
    return rows.select(
        "event_id", make(0, True).alias("reversible"), make(0, False).alias("lossy"), make(5, True).alias("region"),
        quant.block_coefficient_ht(F.col("v"), negative, 12, True).alias("ht"), F.round(quant.block_coefficient_ht(F.col("v"), negative, 12, False, step), 4).alias("ht_lossy"),
    )


def visual_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by level of luma by two models and of both chroma components, sampled in three ways, at some zooms."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 6 + 1 AS level")
    out = []
    for name, sx, sy in (("444", 1.0, 1.0), ("422", 2.0, 1.0), ("420", 2.0, 2.0)):
        luma, chroma = quant.band_frequencies(F.col("level")), quant.band_frequencies(F.col("level"), sx, sy)
        for band in ("HH", "LH", "HL"):
            out.append(F.struct(F.lit(name).alias("format"), F.lit(band).alias("band"), *[
                F.round(w, 6).alias(n) for n, w in (
                    ("mannos", quant.luma_weight(luma[band], "mannos")), ("daly", quant.luma_weight(luma[band], "daly")),
                    ("cb", quant.chroma_weight(chroma[band], "Cb")), ("cr", quant.chroma_weight(chroma[band], "Cr")),
                )
            ]))
    return rows.select("p_partkey", F.explode(F.array(*out)).alias("w")).select("p_partkey", "w.*")


def jpp_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents sent as messages, put together again from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3 * 2).alias("class"), F.col("doc_id").alias("id"), F.encode("text", "UTF-8").alias("payload"))
    found = jpp.bins(jpp.messages(jpp.emit(docs, ["doc_id"], "id")), ["doc_id"])
    return found.select("doc_id", F.col("class").cast("bigint").alias("class"), "id", F.col("bytes").cast("bigint").alias("bytes"), "complete", F.sha2("payload", 256).alias("sha"))


def chroma_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", "1 + p_partkey % 3 AS xr", "1 + p_partkey % 2 AS yr")
    return rows.select("p_partkey", F.coalesce(color.chroma_format(F.col("xr"), F.col("yr")), F.lit("")).alias("format"))


def colour_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is done with frames that describe their colours, or do not, under three sets of options."""
    rows = table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 3 > 0 AS s", "cast(event_id % 20 AS int) AS trans", "cast(event_id % 11 AS int) AS prims")
    options = ({}, {"fallback": "hlg", "wide_fallback": True, "tonemap": "clip"}, {"transfer": "pq", "wide_display": True, "display": "linear"})
    made = [color.colour_choice(F.col("s"), F.col("trans"), F.col("prims"), **o).alias(f"o{i}") for i, o in enumerate(options)]
    text = lambda o: F.concat_ws(" ", o["transfer"], o["wide_gamut"].cast("string"), o["bt2390"].cast("string"), o["display"])
    chosen = rows.select("event_id", *made)
    return chosen.select("event_id", *[text(F.col(f"o{i}")).alias(f"o{i}") for i in range(3)])


def roi_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of high-throughput blocks with a region of interest shifted by 5 bits, of 12-bit bands."""
    v = F.expr("if(event_id % 4 = 0, (event_id * 97) % 524288, shiftleft((event_id * 2654435761) % 4096, 19))")
    rows = table(spark, sf_dir, "events").select("event_id", v.alias("v"))
    negative, step = F.col("event_id") % 3 == 0, 0.25 + (F.col("event_id") % 8) * 0.125
    return rows.select("event_id", quant.block_coefficient_ht(F.col("v"), negative, 12, True, roi=5).alias("whole"), quant.block_coefficient_ht(F.col("v"), negative, 12, False, step, 5).alias("lossy"))


def _written_images(kind: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Vectors' planes as image files, written and read again."""
        images.register(spark)
        folder = f"{shared_dir(spark).removeprefix('file://')}/tessera/images-{uuid.uuid4().hex}"
        signed = kind == "pgx"
        lines = sample_queries._planes(spark, sf_dir).select(
            F.concat(F.col("vec_id").cast("string"), F.lit(f".{kind}")).alias("path"), F.lit(0).alias("c"), F.col("y").cast("int").alias("y"),
            F.transform("row", lambda x: (x % 1000 if signed else F.abs(x) % 256).cast("int")).alias("row"),
        )
        out = lines.repartition("path").sortWithinPartitions("path").write.format(kind).mode("append")
        out.option("depth", 12 if signed else 8).option("signed", str(signed).lower()).save(folder)
        found = spark.read.format(kind).load(folder)
        image = F.regexp_extract("path", r"(\d+)(_00)?\.\w+$", 1).cast("bigint").alias("vec_id")
        return found.select(image, F.col("y").cast("bigint").alias("y"), F.aggregate("row", F.lit(0).cast("bigint"), lambda a, x: a * 3 + x).alias("mixed"))

    return query


QUERIES = {
    f.__name__: f
    for f in (
        component_codings, boxes, capture_parse, rtp_rejects, media_types, code_block_grid, precincts_in_order, smallest_precinct, layer_starts,
        bytes_per_tile, precinct_filter, zero_rows, first_frames, session_commit, merged_headers, dwt53_real, block_coefficients, visual_weights, jpp_bins, chroma_formats, colour_choices, roi_coefficients, boxes_in_sql, messages_in_sql,
    )
} | {"pnm_lines": _lines("pnm"), "pgx_lines": _lines("pgx"), "pnm_written": _written_images("pnm"), "pgx_written": _written_images("pgx")}

_IMAGE_LINES = """WITH f AS (SELECT p_partkey AS image, p_partkey % 5 + 1 AS h FROM part),
s AS (SELECT image, y.y, x.range AS x, {v} AS v FROM f, LATERAL (SELECT unnest(range(h)) AS y) y, range(4) x WHERE image % 11 <> 0)
SELECT image, y, sum(v)::BIGINT AS total, max(v) FILTER (x = 0)::BIGINT AS first, false AS broken FROM s GROUP BY ALL
UNION ALL SELECT image, -1, 0, 0, true FROM f WHERE image % 11 = 0"""

_MIDDLE = "CASE WHEN v <> 0 THEN v | (1::BIGINT << (18 + missing)) ELSE v END"

_WRITTEN = """WITH s AS (SELECT vec_id, y.range AS y, x.range AS x, trunc(embedding[y.range * 8 + x.range + 1]::DOUBLE * 1024)::BIGINT AS v FROM embeddings, range(8) y, range(8) x)
SELECT vec_id, y, sum({v} * pow(3, 7 - x)::BIGINT)::BIGINT AS mixed FROM s GROUP BY vec_id, y"""

ORACLE_SQL = {
    "jpp_bins": "SELECT doc_id, doc_id % 3 * 2 AS class, doc_id AS id, strlen(text) AS bytes, true AS complete, sha256(text) AS sha FROM documents",
    "chroma_formats": "SELECT p_partkey, CASE 10 * (1 + p_partkey % 3) + 1 + p_partkey % 2 WHEN 11 THEN '444' WHEN 21 THEN '422' WHEN 22 THEN '420' ELSE '' END AS format FROM part",
    "pnm_written": _WRITTEN.format(v="abs(v) % 256"),
    "pgx_written": _WRITTEN.format(v="v % 1000"),
    "component_codings": """WITH p AS (SELECT p_partkey AS image_id, p_partkey % 6 AS levels, p_partkey % 2 = 1 AS reversible, c.range AS c FROM part, range(3) c),
k AS (SELECT *, image_id % 5 = 0 AS own, image_id % 5 = 0 AND c = (image_id + 1) % 3 AS by_tile, image_id % 2 = 0 AND c = image_id % 3 AS by_image FROM p)
SELECT image_id, c, CASE WHEN by_tile THEN (image_id + 2) % 6 WHEN by_image AND NOT own THEN (image_id + 1) % 6 ELSE levels END AS levels,
  CASE WHEN by_tile THEN image_id % 4 < 2 WHEN by_image AND NOT own THEN image_id % 4 >= 2 ELSE reversible END AS reversible,
  CASE WHEN by_tile THEN 'tile component' WHEN by_image AND NOT own THEN 'main component' ELSE 'main' END AS "from" FROM k""",
    "boxes": """WITH n AS (SELECT p_partkey, p_partkey % 40 AS n FROM part)
SELECT p_partkey, 0::BIGINT AS number, 0::BIGINT AS depth, 'free' AS type, 8::BIGINT AS begin, n + 8 AS "end" FROM n
UNION ALL SELECT p_partkey, 1, 0, 'jp2h', n + 16, n + 44 FROM n UNION ALL SELECT p_partkey, 2, 1, 'ihdr', n + 24, n + 28 FROM n
UNION ALL SELECT p_partkey, 3, 1, 'colr', n + 36, n + 44 FROM n UNION ALL SELECT p_partkey, 4, 0, 'jp2c', n + 52, n + 52 + n + 1 FROM n""",
    "pnm_lines": _IMAGE_LINES.format(v="(image * 7 + (y.y * 4 + x.range) * 3) % 256"),
    "pgx_lines": _IMAGE_LINES.format(v="((image * 37 + (y.y * 4 + x.range) * 1001) % 65536 + 32768) % 65536 - 32768"),
    "capture_parse": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, user_id % 7 = 0 AS cut FROM events)
SELECT user_id, count(*) FILTER (NOT cut OR back > 1) AS packets, coalesce(sum(event_id % 50) FILTER (NOT cut OR back > 1), 0)::BIGINT AS bytes,
  CASE WHEN bool_or(cut) THEN 1 ELSE 0 END::BIGINT AS errors, coalesce(max(event_id * 1500 % 4294967296) FILTER (NOT cut OR back > 1), -1)::BIGINT AS last_ts FROM e GROUP BY user_id""",
    "rtp_rejects": """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'short' WHEN 1 THEN 'version' WHEN 2 THEN 'future revision' WHEN 3 THEN 'reserved bits'
  WHEN 4 THEN 'colour without flag' WHEN 5 THEN 'caching without reuse' WHEN 7 THEN 'place without flag' WHEN 8 THEN 'overrun' ELSE '' END AS reject FROM events""",
    "media_types": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 IN (2, 3) THEN 'type' ELSE '' END AS error FROM orders",
    "code_block_grid": """WITH im AS (SELECT p_partkey AS image_id, 256 + 64 * p_size AS w, 256 + 48 * (p_partkey % 32) AS h, p_partkey % 6 AS nl FROM part),
b AS (SELECT image_id, r.range AS r, b.band, CASE WHEN r.range = 0 THEN nl ELSE nl - r.range + 1 END AS nb, w, h, b.xo, b.yo
  FROM im, range(6) r, (VALUES ('LL', 0, 0), ('HL', 1, 0), ('LH', 0, 1), ('HH', 1, 1)) b(band, xo, yo) WHERE r.range <= nl AND (r.range = 0) = (b.band = 'LL')),
s AS (SELECT image_id, r, band, ceil((w - CASE WHEN xo = 1 THEN (1 << (nb - 1)) ELSE 0 END) / (1 << nb)::DOUBLE)::BIGINT AS width,
  ceil((h - CASE WHEN yo = 1 THEN (1 << (nb - 1)) ELSE 0 END) / (1 << nb)::DOUBLE)::BIGINT AS height FROM b)
SELECT image_id, r, band, ((width + 31) // 32) * ((height + 31) // 32) AS blocks, width, height FROM s""",
    "precincts_in_order": f"""WITH {SPANS_SQL}, o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 2), (2, 5, 4), (3, 21, 8), (4, 85, 15), (5, 310, 30)) o(r, before, wide)),
k AS (SELECT req_id, c.range + 3 * (o.before + y.y * o.wide + x.x) AS i FROM sp JOIN o ON o.r = sp.r, LATERAL (SELECT unnest(range(x0, x1)) AS x) x, LATERAL (SELECT unnest(range(y0, y1)) AS y) y, range(3) c),
n AS (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY i) - 1 AS place FROM k)
SELECT req_id, count(*) AS n, min(i)::BIGINT AS least, max(i)::BIGINT AS most, sum(i * (place % 7))::BIGINT AS "check" FROM n GROUP BY req_id""",
    "smallest_precinct": """SELECT p_partkey AS image_id, min(4 + (p_partkey * 7 + r.range * 5) % 11)::BIGINT AS ppx, min(4 + (p_partkey * 3 + r.range * 2) % 11)::BIGINT AS ppy
FROM part, range(6) r WHERE r.range <= p_partkey % 6 GROUP BY p_partkey""",
    "layer_starts": """WITH l AS (SELECT l_orderkey AS block, l_linenumber::BIGINT AS layer, sum(DISTINCT 1 + l_partkey % 9)::BIGINT AS passes FROM lineitem GROUP BY ALL)
SELECT *, coalesce(sum(passes) OVER (PARTITION BY block ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l""",
    "bytes_per_tile": "SELECT l_partkey AS tile, count(*) AS packets, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem GROUP BY l_partkey",
    "precinct_filter": """WITH k AS (SELECT l_partkey AS tile, l_quantity::BIGINT AS n, l_suppkey % 16 >= l_partkey % 4 AND (l_suppkey % 16 - l_partkey % 4) % 3 = 0 AS kept FROM lineitem)
SELECT tile, count(*) AS packets, count(*) FILTER (NOT kept) AS dropped, coalesce(sum(n) FILTER (kept), 0)::BIGINT AS bytes FROM k GROUP BY tile""",
    "zero_rows": """WITH s AS (SELECT vec_id, x.range // 8 AS y, trunc(trunc(embedding[x.range + 1]::DOUBLE * 1024) / 300) AS v FROM embeddings, range(64) x)
SELECT vec_id, y, bool_and(v = 0) AS zero FROM s GROUP BY ALL""",
    "first_frames": "WITH f AS (" + stream_queries.ORACLE_SQL["frame_assembly"] + """ WHERE status = 'emitted'),
n AS (SELECT *, row_number() OVER (PARTITION BY ssrc ORDER BY frame) AS n FROM f) SELECT ssrc, frame, bytes FROM n WHERE n <= 3""",
    "session_commit": """WITH h AS (SELECT l_suppkey AS client, l_partkey % 3630 AS id, max((20 * l_quantity)::BIGINT) AS bytes, bool_or(l_linestatus = 'F') AS complete FROM lineitem GROUP BY ALL),
n AS (SELECT DISTINCT o_custkey % 100 AS client, o_orderkey % 3630 AS id FROM orders),
s AS (SELECT n.client, n.id, greatest(coalesce(h.bytes, 0), 700) AS bytes, coalesce(h.bytes, 0) >= 700 AS complete FROM n LEFT JOIN h ON h.client = n.client AND h.id = n.id WHERE NOT coalesce(h.complete, false))
SELECT client, id, max(bytes) AS bytes, bool_or(complete) AS complete FROM (SELECT * FROM h UNION ALL SELECT * FROM s) GROUP BY ALL""",
    "merged_headers": """WITH b AS (SELECT l_suppkey AS client, l_orderkey % 9 AS class, l_partkey % 50 AS id, l_quantity::BIGINT AS bytes, l_linestatus = 'F' AS complete FROM lineitem),
u AS (SELECT * FROM b WHERE client % 2 = 0 UNION ALL SELECT client + 1, class, id, bytes, complete FROM b WHERE client % 2 = 1 AND class NOT IN (0, 1))
SELECT client, class, id, max(bytes) AS bytes, bool_or(complete) AS complete FROM u GROUP BY ALL""",
    "dwt53_real": f"""WITH {sample_queries._VEC}, s0 AS (SELECT vec_id, x, v::DOUBLE AS v FROM s), a AS ({sample_queries._lift('s0', 1, '-0.5::DOUBLE * ({a} + {b})')}),
d AS ({sample_queries._lift('a', 0, '0.25::DOUBLE * ({a} + {b})')}) SELECT vec_id, x, round(v, 6) AS v FROM d""",
    "block_coefficients": f"""WITH e AS (SELECT event_id, event_id % 6 AS missing, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS s, 0.25::DOUBLE + event_id % 8 * 0.125::DOUBLE AS step,
  CASE WHEN event_id % 10 = 0 THEN 0 ELSE (((event_id * 2654435761) % 4096) << 19) + CASE WHEN event_id % 4 = 0 THEN (event_id * 97) % 524288 ELSE 0 END END AS raw FROM events),
c AS (SELECT *, CASE WHEN missing > 0 THEN (raw >> (19 + missing)) << (19 + missing) ELSE raw END AS v FROM e),
m AS (SELECT *, {_MIDDLE} AS m, CASE WHEN v < 524288 THEN v << 5 ELSE v END AS up, floor(step * pow(2, 25) + 0.5)::BIGINT AS scale FROM c)
SELECT event_id, s * ((CASE WHEN missing > 0 THEN m ELSE v END) >> 19) AS reversible, s * ((((m + 32768) >> 16) * scale + 16384) >> 15) AS lossy, s * (up >> 19) AS region,
  s * (v >> 19) AS ht, round(s * (v * step * pow(2, -6)), 4) AS ht_lossy FROM m""",
    "visual_weights": """WITH g AS (SELECT i * 0.0005::DOUBLE AS f FROM range(1, 100001) t(i)),
c AS (SELECT f, 2.6::DOUBLE * (0.0192 + 0.114 * f) * exp(-pow(0.114 * f, 1.1)) AS m,
  0.801::DOUBLE * pow(1 + 0.7 / 100, -0.2) * 0.9 * f * exp(-0.3::DOUBLE * pow(2, 0.15) * 0.9 * f) * sqrt(1 + 0.06 * exp(0.3::DOUBLE * pow(2, 0.15) * 0.9 * f)) AS d FROM g),
t AS (SELECT max(m) AS mt, arg_max(f, m) AS mf, max(d) AS dt, arg_max(f, d) AS df FROM c),
k AS (SELECT p_partkey, x.fmt AS format, b.band, 36 * pow(2, 0.5 - (p_partkey % 6 + 1)) AS y0, x.sx, x.sy
  FROM part, (VALUES ('444', 1, 1), ('422', 2, 1), ('420', 2, 2)) x(fmt, sx, sy), (VALUES ('HH'), ('LH'), ('HL')) b(band)),
q AS (SELECT *, CASE band WHEN 'HH' THEN sqrt(2) * y0 ELSE y0 END AS fl,
  CASE band WHEN 'HH' THEN sqrt(pow(y0 / sx, 2) + pow(y0 / sy, 2)) WHEN 'LH' THEN y0 / sy ELSE y0 / sx END AS fc FROM k)
SELECT p_partkey, format, band,
  round(CASE WHEN fl <= mf THEN 1 ELSE 2.6::DOUBLE * (0.0192 + 0.114 * fl) * exp(-pow(0.114 * fl, 1.1)) / mt END, 6) AS mannos,
  round(CASE WHEN fl <= df THEN 1 ELSE 0.801::DOUBLE * pow(1 + 0.7 / 100, -0.2) * 0.9 * fl * exp(-0.3::DOUBLE * pow(2, 0.15) * 0.9 * fl) * sqrt(1 + 0.06 * exp(0.3::DOUBLE * pow(2, 0.15) * 0.9 * fl)) / dt END, 6) AS daly,
  round(exp(-pow(0.1173 * fc, 0.840)), 6) AS cb, round(exp(-pow(0.0699 * fc, 1.050)), 6) AS cr FROM q, t""",
}

ORACLE_SQL["boxes_in_sql"] = ORACLE_SQL["boxes"]
ORACLE_SQL["messages_in_sql"] = """WITH d AS (SELECT doc_id, strlen(text) AS n FROM documents)
SELECT doc_id, greatest(1, (n + 986) // 987) AS messages, n AS bytes, 2::BIGINT AS eor, 1::BIGINT AS last FROM d"""
ORACLE_SQL["roi_coefficients"] = """WITH e AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE 1 END AS s, 0.25::DOUBLE + event_id % 8 * 0.125::DOUBLE AS step,
  CASE WHEN event_id % 4 = 0 THEN (event_id * 97) % 524288 ELSE ((event_id * 2654435761) % 4096) << 19 END AS v FROM events),
u AS (SELECT *, CASE WHEN v < 524288 THEN v << 5 ELSE v END AS up, floor(step * pow(2, 25) + 0.5)::BIGINT AS scale FROM e)
SELECT event_id, s * (up >> 19) AS whole, s * ((((up + 32768) >> 16) * scale + 16384) >> 15) AS lossy FROM u"""
ORACLE_SQL["colour_choices"] = """WITH e AS (SELECT event_id, event_id % 3 > 0 AS s, event_id % 20 AS t, event_id % 11 AS p FROM events),
c AS (SELECT *, CASE WHEN s AND t IN (1, 6, 14, 15) THEN 'gamma22' WHEN s AND t = 16 THEN 'pq' WHEN s AND t = 18 THEN 'hlg' END AS k FROM e)
SELECT event_id, coalesce(k, 'gamma22') || ' ' || (s AND p = 9)::VARCHAR || ' ' || (coalesce(k, 'gamma22') = 'pq')::VARCHAR || ' srgb' AS o0,
  coalesce(k, 'hlg') || ' ' || CASE WHEN s THEN (p = 9)::VARCHAR ELSE 'true' END || ' false srgb' AS o1, 'pq false true linear' AS o2 FROM c"""
