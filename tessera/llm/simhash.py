"""SimHash fingerprints of word shingles, and links between them by the generalised pigeonhole principle."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize
from tessera.llm.components import connected_components

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 18
#: Candidates that a fingerprint's probes may meet before it is linked through its neighbouring points instead.
MOST_CANDIDATES = 64
#: Cost of a probe beside that of a candidate.
PROBE_COST = 0.5

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of each run of `size` words, repeats included; of all words together if there are fewer; none if no word.

    A-Z are lower-cased; words are what spaces, tabs and line breaks (20, 09-0D) separate; a shingle's words are
    joined by single spaces.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(size, len(words))
    first = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    last = ends[k - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)


def _more_words(h: np.ndarray, word: int) -> np.ndarray:
    """A further 64 hash bits of each shingle: the finalising mix of a counter-based generator; word 0 is h itself."""
    if not word:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * word) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(hashes: list[np.ndarray], words: int = 1) -> np.ndarray:
    """One row of `words` 64-bit numbers per text: a bit is 1 if it is set in over half of the text's hashes."""
    out = np.zeros((len(hashes), words), np.uint64)
    at = 0
    while at < len(hashes):
        to, n = at, 0
        while to < len(hashes) and (to == at or n + len(hashes[to]) <= CHUNK):
            n += len(hashes[to])
            to += 1
        sizes = np.fromiter(map(len, hashes[at:to]), np.int64, to - at)
        base = np.repeat(np.arange(to - at) * 256, sizes)
        flat = np.concatenate(hashes[at:to])
        for w in range(words):
            by_byte = _more_words(flat, w).view(np.uint8).reshape(-1, 8)
            for k in range(8):
                seen = np.bincount(base + by_byte[:, k], minlength=(to - at) * 256).reshape(-1, 256)
                bits = (2 * (seen @ _BITS) > sizes[:, None]).astype(np.uint64)
                out[at:to, w] |= (bits << np.arange(8, dtype=np.uint64)).sum(axis=1).astype(np.uint64) << np.uint64(8 * k)
        at = to
    return out


def simhash(text: Column, size: int) -> Column:
    """The 64-bit fingerprint as a bigint; zero for a null text or one without words."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints([shingle_hashes(t, size) for t in texts])[:, 0].view(np.int64))

    return F.pandas_udf(run, "bigint").asNondeterministic()(text)


def _correlations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often two bits are set together, over a task's fingerprints; as 64 rows of 64 counts."""
    total = np.zeros((64, 64))
    for batch in batches:
        fp = batch.column(0).to_numpy().view(np.uint64)
        bits = ((fp[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
        total += bits.T @ bits
    i, j = np.divmod(np.arange(64 * 64), 64)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel().astype(np.int64))], names=["i", "j", "n"])


def group_bits(together: np.ndarray, n: int, parts: int) -> list[int]:
    """Masks of `parts` groups of bits: each group is grown by the bit that correlates most with what it holds."""
    mean = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    related = np.abs(together / max(n, 1) - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free = set(range(64))
    masks = []
    for p in range(parts):
        size = (64 - p + parts - 1) // parts
        start = max(free, key=lambda b: (related[b, sorted(free)].max(), -b))
        group = [start]
        free.remove(start)
        while len(group) < size:
            best = max(free, key=lambda b: (related[b, group].mean(), -b))
            group.append(best)
            free.remove(best)
        masks.append(sum(1 << b for b in group))
    return masks


def parts_for(bits_set: np.ndarray, n: int, threshold: int) -> int:
    """How many parts to cut fingerprints into, so that a probe plan costs least: few narrow parts meet more and more
    as there are more fingerprints, and wide ones take more probes.

    bits_set: in which share of n fingerprints each bit is 1. A bit that is nearly always alike tells little apart, so
    a part's values are taken as evenly filled over as many bits as its bits are worth.
    """
    worth = -np.log2(np.maximum(bits_set**2 + (1 - bits_set) ** 2, 1e-12))
    costs = {}
    for parts in range(threshold + 1, 0, -1):
        width, mean = 64 / parts, worth.sum() / parts
        price, ball, size = [0.0], 1.0, 1.0
        for u in range(1, threshold + 2):
            price.append(n / 2.0**mean * ball + PROBE_COST * ball)
            size *= (width - u + 1) / u
            ball += size
        best = [0.0] + [math.inf] * (threshold + 1)
        for _ in range(parts):
            best = [min(best[s - u] + price[u] for u in range(s + 1)) for s in range(threshold + 2)]
        costs[parts] = best[-1]
    return min(costs, key=lambda p: (costs[p], -p))


def allocate(counts: np.ndarray, widths: list[int], n: int, threshold: int) -> np.ndarray:
    """Thresholds per part, -1 for a part that is not probed, of least estimated cost for each fingerprint.

    With parts' thresholds that add up to threshold - parts + 1, any fingerprint within the threshold is within some
    part's own. So threshold + 1 units are dealt to the parts; a part with u units is probed up to u - 1 bits away.
    counts: how many fingerprints share the part's value; the other values near it are taken as evenly filled.
    """
    rows, parts = counts.shape
    units = threshold + 1
    price = np.zeros((rows, parts, units + 1))
    for p, width in enumerate(widths):
        ball, size = 1.0, 1.0
        for u in range(1, units + 1):
            price[:, p, u] = counts[:, p] + (ball - 1) * n / 2.0**width + PROBE_COST * ball
            size *= (width - u + 1) / u
            ball += size
    best = np.full((rows, units + 1), np.inf)
    best[:, 0] = 0
    choice = np.zeros((parts, rows, units + 1), np.int8)
    for p in range(parts):
        new = np.full((rows, units + 1), np.inf)
        for s in range(units + 1):
            for u in range(s + 1):
                cost = best[:, s - u] + price[:, p, u]
                better = cost < new[:, s]
                new[better, s] = cost[better]
                choice[p, better, s] = u
        best = new
    out = np.zeros((rows, parts), np.int8)
    left = np.full(rows, units)
    for p in range(parts - 1, -1, -1):
        out[:, p] = choice[p, np.arange(rows), left] - 1
        left -= out[:, p] + 1
    return out


def _probe(masks: list[int], n: int, threshold: int):
    """Fingerprints and their values' counts to probes: all values within the allocated threshold of each part."""
    bits = [[b for b in range(64) if m >> b & 1] for m in masks]

    def flips(width_bits: list[int], r: int) -> np.ndarray:
        one = np.array([1 << b for b in width_bits], np.uint64)
        out = [np.zeros(1, np.uint64)]
        if r >= 1:
            out.append(one)
        if r >= 2:
            i, j = np.triu_indices(len(one), 1)
            out.append(one[i] | one[j])
        return np.concatenate(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            counts = np.array(batch.column("counts").to_pylist(), np.float64).reshape(len(fp), len(masks))
            plan = allocate(counts, list(map(len, bits)), n, threshold)
            found = []
            for p, mask in enumerate(masks):
                for r in range(threshold + 1):
                    mine = fp[plan[:, p] == r]
                    if len(mine):
                        near = flips(bits[p], r)
                        found.append((np.repeat(mine, len(near)), np.full(len(mine) * len(near), p), ((mine & np.uint64(mask))[:, None] ^ near).ravel()))
            if found:
                q, part, value = (np.concatenate(x) for x in zip(*found))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.view(np.int64)), pa.array(part.astype(np.int32)), pa.array(value.view(np.int64))], names=["fp", "part", "value"]
                )

    return run


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def probe_fingerprints(
    prints: DataFrame, threshold: int = 2, parts: int | None = None, most: int = MOST_CANDIDATES
) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) of all pairs at most `threshold` bits apart of which one meets up to `most` others by its probes, and
    the fingerprints (fp) that meet more. prints: distinct values in a column fp, written to files; they are cut into
    parts, the fewer the more there are."""
    n = prints.count()
    together = np.zeros((64, 64))
    sums = prints.select("fp").mapInArrow(_correlations, "i bigint, j bigint, n bigint").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in sums.collect():
        together[r["i"], r["j"]] = r["n"]
    parts = parts or parts_for(np.diag(together) / max(n, 1), n, threshold)
    masks = group_bits(together, n, parts)
    value = lambda p: F.col("fp").bitwiseAND(F.lit(_signed(masks[p])))
    index = prints.select("fp", F.posexplode(F.array(*[value(p) for p in range(parts)])).alias("part", "value"))
    counts = index.groupBy("part", "value").agg(F.count("*").alias("n"))
    counted = materialize(index.join(counts, ["part", "value"]), "parts")
    by_print = counted.groupBy("fp").agg(
        *[F.max(F.when(F.col("part") == p, F.col("n"))).alias(f"n{p}") for p in range(parts)]
    ).select("fp", F.array(*[f"n{p}" for p in range(parts)]).alias("counts"))
    probes = materialize(by_print.mapInArrow(_probe(masks, n, threshold), "fp bigint, part int, value bigint"), "probes")
    met = probes.join(counts, ["part", "value"]).groupBy("fp").agg(F.sum("n").alias("met"))
    dense = materialize(met.filter(F.col("met") > most).select("fp"), "dense")
    sparse = probes.join(dense, "fp", "left_anti").select(F.col("fp").alias("q"), "part", "value")
    apart = F.bit_count(F.col("q").bitwiseXOR(F.col("fp")))
    edges = (
        sparse.join(counted.select("part", "value", "fp"), ["part", "value"])
        .filter((F.col("q") != F.col("fp")) & (apart <= threshold))
        .select(F.least("q", "fp").alias("a"), F.greatest("q", "fp").alias("b"))
    )
    return edges, dense


def link_fingerprints(prints: DataFrame, threshold: int = 2, parts: int | None = None, most: int = MOST_CANDIDATES) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of fingerprints at most `threshold` (2) bits apart.

    Fingerprints whose probes meet few others are linked to all of them within the threshold. Only where they crowd,
    whatever the size of the table, it is otherwise: such a one is linked to the least fingerprint, of those like it,
    in the ball of one bit around itself and around each of its 64 neighbours: two such fingerprints within two bits
    share a point of theirs, and all that share a point are within two bits of each other. So no pair is lost, and
    no group of pairs is listed.
    """
    if threshold != 2:
        raise ValueError("dense surroundings are linked through shared points, which fit a threshold of 2")
    edges, dense = probe_fingerprints(prints, threshold, parts, most)
    points = dense.select("fp", F.explode(F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << b)) for b in range(64)])).alias("flip"))
    points = points.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1")
    shared = points.join(least, "point").select("a", F.col("fp").alias("b")).filter("a <> b")
    return edges.unionByName(shared)


def simhash_components(
    docs: DataFrame, shingle: int = 3, threshold: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (least id reachable, itself included).

    Fingerprints link at `threshold` or fewer differing bits; a text without words, or null, has fingerprint zero and
    links like any other. Null ids are never the least; a component of null ids only has a null component_id.
    Repeated rows are rows of their own. An empty table gives no rows. Other columns are not read.
    """
    held = materialize(docs.select(F.col(id_col).alias("_id"), simhash(F.col(text_col), shingle).alias("fp")), "fingerprints")
    prints = materialize(held.groupBy("fp").agg(F.min("_id").alias("least")), "distinct-fingerprints")
    roots = connected_components(link_fingerprints(prints, threshold))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "roots")
    component = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.join(component, "root").select("fp", "component_id")
    return held.join(of, "fp").select(
        F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
