"""Sequence, variant and label operators (survey section 2.10).

A chromosome is never one row: it is stored as tiles ``(chrom, tile, start, seq)`` of a fixed width.
Intervals are half-open and zero-based.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgene.functions.lineage import stable
from tallgene.functions.rand import hash_int, hash_uniform
from tallgene.functions.ranks import hash_ranks
from tallgene.operators.windows import islands

# Ambiguity letters that stand for more than one base.
AMBIGUOUS = "URYKMSWBHVD"
# Symbols of a site, in matrix column order.
SYMBOLS = ("A", "G", "T", "C", "N", "DEL", "AI", "GI", "TI", "CI", "NI")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# letters -----------------------------------------------------------------------------------------

def cleanup(col) -> Column:
    """seq_cleanup: ambiguity letters become N."""
    return F.translate(_c(col), AMBIGUOUS, "N" * len(AMBIGUOUS))


def collapse_n(col) -> Column:
    """seq_collapse_n: runs of N or of # shrink to one."""
    return F.regexp_replace(F.regexp_replace(F.trim(_c(col)), "N+", "N"), "#+", "#")


def complement(col) -> Column:
    return F.translate(F.regexp_replace(_c(col), "[^ACGT]", "N"), "ACGT", "TGCA")


def reverse_complement(col) -> Column:
    """seq_revcomp: reversed complement, unknown letters become N."""
    return F.reverse(complement(col))


def has_variant(col) -> Column:
    """seq_split_variant: true if a letter outside ACGTN occurs."""
    return _c(col).rlike("[^ACGTN]")


def mismatch_share(ref, other) -> Column:
    """seq_mismatch: share of differing positions over the shared length, relative to the reference's length."""
    a, b = _c(ref), _c(other)
    n = F.least(F.length(a), F.length(b))
    diff = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(diff, F.lit(0), lambda s, x: s + x) / F.length(a)


def center_token(tokens, threshold: int = 500) -> Column:
    """seq_center_token: first index at which the running length passes the threshold, else -1."""
    start = F.struct(F.lit(0).alias("len"), F.lit(0).alias("i"), F.lit(-1).alias("at"))

    def step(acc, t):
        length = acc["len"] + F.length(t)
        hit = (acc["at"] < 0) & (length > threshold)
        return F.struct(length.alias("len"), (acc["i"] + 1).alias("i"), F.when(hit, acc["i"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(_c(tokens), start, step)["at"]


def augment_pairs(pairs) -> DataFrame:
    """seq_augment_pair: for pairs in contact, the seven orientations of seq1 + seq2."""
    a, b = F.col("seq1"), F.col("seq2")
    ar, br, arc, brc = F.reverse(a), F.reverse(b), reverse_complement(a), reverse_complement(b)
    versions = F.array(*[F.concat(x, y) for x, y in ((a, b), (ar, b), (a, br), (ar, br), (arc, b), (a, brc), (arc, brc))])
    others = [c for c in pairs.columns if c not in ("seq1", "seq2")]
    return pairs.where(F.col("contact") == 1).select(*others, F.posexplode(versions).alias("version", "seq"))


# chunks and tiles ----------------------------------------------------------------------------------

def chunk_fixed(seqs, size: int, drop_n: bool = True, reverse: bool = False) -> DataFrame:
    """seq_chunk_fixed: non-overlapping chunks, last one short, all-N chunks dropped, optional reverse complement."""
    # one linear pass per sequence; substring by position would scan from the start for every chunk
    pieces = F.regexp_extract_all("seq", F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    others = [c for c in seqs.columns if c != "seq"]
    out = seqs.select(*others, F.posexplode(pieces).alias("chunk", "seq")).withColumn("chunk", F.col("chunk").cast("bigint"))
    if reverse:
        out = out.withColumn("rc", reverse_complement("seq"))
    return out.where(~F.col("seq").rlike("^N+$")) if drop_n else out


def chunk_tiles(tiles, size: int, drop_n: bool = True, reverse: bool = False) -> DataFrame:
    """seq_chunk_fixed over tiles (chrom, tile, start, seq) of any width: the chunks of ``chunk_fixed`` without a row for the whole sequence.

    A tile is cut at the borders of chunks. What lies inside it is finished there; only the pieces at its two ends, whose chunk goes on
    in a neighbour, are exchanged and joined by (chrom, chunk), in order of their place.
    """
    lead = F.pmod(-F.col("start"), F.lit(size)).cast("int")  # bases that end a chunk of the tile before
    head = F.when(lead > 0, F.array(F.substr("seq", F.lit(1), lead))).otherwise(F.array().cast("array<string>"))
    rest = F.regexp_extract_all(F.substr("seq", lead + 1), F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    cut = tiles.where(F.length("seq") > 0).select("chrom", "start", F.posexplode(F.concat(head, rest)).alias("i", "seq"))
    first = F.floor(F.col("start") / size)
    pieces = cut.select("chrom", (first + F.col("i")).alias("chunk"), "seq")
    # of a tile only its first and its last piece can be short, so the exchanged side cuts these two and no others
    length = F.length("seq")
    tail = F.when(length > lead, F.pmod(length - lead, F.lit(size))).otherwise(F.lit(0))
    end = F.struct((F.col("start") + length - tail).alias("at"), F.substr("seq", length - tail + 1).alias("seq"))
    front = F.struct(F.col("start").alias("at"), F.substr("seq", F.lit(1), lead).alias("seq"))
    short = tiles.where((length > 0) & ((lead > 0) | (tail > 0))).select("chrom", F.inline(F.filter(F.array(front, end), lambda p: F.length(p["seq"]) > 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "seq"))), lambda p: p["seq"]), "")
    joined = short.groupBy("chrom", F.floor(F.col("at") / size).alias("chunk")).agg(text.alias("seq"))
    out = pieces.where(F.length("seq") == size).select("chrom", "chunk", "seq").unionByName(joined)
    if reverse:
        out = out.withColumn("rc", reverse_complement("seq"))
    return out.where(~F.col("seq").rlike("^N+$")) if drop_n else out


#: Chunk numbers whose sizes are added up in one task.
RUN = 1024


def random_cuts(sizes, low: int, high: int, multiplier: int, seed=42) -> DataFrame:
    """(chrom, k, start, end) of consecutive chunks with hashed lengths in low..high times a multiplier, up to the length (chrom, len).

    Starts are prefix sums in two levels: numbers fall into runs, run totals give each run its first start, so a chromosome is many tasks.
    """
    step = low * multiplier
    runs = sizes.where("len > 0").select("chrom", "len", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("len") - 1) / (step * RUN)))).alias("run"))
    last = F.least(F.col("run") * RUN + RUN - 1, F.floor((F.col("len") - 1) / step))
    numbers = runs.repartition("chrom", "run").select("chrom", "len", "run", F.explode(F.sequence(F.col("run") * RUN, last)).alias("k"))
    size = (F.lit(low) + F.floor(hash_uniform(seed, "chrom", "k") * (high - low + 1))) * multiplier
    numbers = numbers.withColumn("size", size)
    before = Window.partitionBy("chrom").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = stable(numbers.groupBy("chrom", "run").agg(F.sum("size").alias("total")).withColumn("first", F.coalesce(F.sum("total").over(before), F.lit(0))))
    inside = Window.partitionBy("chrom", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("first") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    placed = numbers.join(totals.select("chrom", "run", "first"), ["chrom", "run"]).withColumn("start", start).where(F.col("start") < F.col("len"))
    return placed.select("chrom", F.col("k").cast("int").alias("k"), "start", F.least(F.col("start") + F.col("size"), F.col("len")).alias("end"))


def chunk_random(tiles, width: int, low: int, high: int, multiplier: int, seed=42) -> DataFrame:
    """seq_chunk_random: consecutive chunks with hashed lengths in low..high times a multiplier, all-N dropped, cut from tiles of ``width``."""
    cuts = random_cuts(tile_lengths(tiles), low, high, multiplier, seed)
    return extract(tiles, cuts, width).select("chrom", "k", "start", "seq").where(~F.col("seq").rlike("^N+$"))


def to_tiles(seqs, width: int) -> DataFrame:
    """Sequences as fixed-width tiles (chrom, tile, start, seq)."""
    tiles = chunk_fixed(seqs, width, drop_n=False)
    return tiles.select("chrom", F.col("chunk").alias("tile"), (F.col("chunk") * width).alias("start"), "seq")


def tile_lengths(tiles) -> DataFrame:
    return tiles.groupBy("chrom").agg(F.max(F.col("start") + F.length("seq")).alias("len"))


#: Tiles whose text one task holds.
HELD = 1 << 14


def extract(tiles, intervals, width: int, sizes=None) -> DataFrame:
    """Sequence of every interval (chrom, start, end, id...): covered tiles meet by an equi join on (chrom, tile).

    With ``sizes`` (chrom, len) the join and the pieces are dealt over as many tasks as there are HELD tiles, so that the text a task holds
    does not grow with the input.
    """
    keys = intervals.columns
    held = (lambda df, *by: df) if sizes is None else _dealer(sizes, width)
    cover = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width)))
    spread = intervals.where(F.col("end") > F.col("start")).withColumn("tile", cover)
    joined = held(spread, "chrom", "tile").join(held(tiles.select("chrom", "tile", F.col("start").alias("_ts"), "seq"), "chrom", "tile"), ["chrom", "tile"])
    lo = F.greatest(F.col("start") - F.col("_ts"), F.lit(0))
    hi = F.least(F.col("end") - F.col("_ts"), F.length("seq"))
    piece = F.substring(F.col("seq"), (lo + 1).cast("int"), (hi - lo).cast("int"))
    parts = joined.where(hi > lo).select(*keys, F.struct("tile", piece.alias("s")).alias("p"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["s"]), "")
    return held(parts, *keys).groupBy(*keys).agg(text.alias("seq"))


def _dealer(sizes, width: int):
    tiles = sizes.agg(F.sum(F.ceil(F.col("len") / width))).first()[0] or 0
    n = max(sizes.sparkSession.sparkContext.defaultParallelism, -(-tiles // HELD))
    return lambda df, *by: df.repartition(n, *by)


def n_free_intervals(tiles, cutoff: int, flank: int) -> DataFrame:
    """Pieces left after cutting at N runs of at least ``cutoff``, each with ``flank`` letters of the run."""
    sizes = tile_lengths(tiles)
    if flank > cutoff:
        return sizes.select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("len").alias("end"))
    sizes = stable(sizes)
    runs = stable(islands(tiles, "N", cutoff).select("chrom", F.col("start").alias("n0"), F.col("end").alias("n1")))
    w = Window.partitionBy("chrom").orderBy("n0")
    before = F.coalesce(F.lag("n1").over(w) - flank, F.lit(0))
    marked = runs.join(sizes, "chrom").withColumns({"start": before, "last": F.lead("n0").over(w).isNull()})
    heads = marked.where(F.col("n0") > 0).select("chrom", "start", (F.col("n0") + flank).alias("end"))
    tails = marked.where(F.col("last") & (F.col("n1") < F.col("len"))).select("chrom", (F.col("n1") - flank).alias("start"), F.col("len").alias("end"))
    whole = sizes.join(runs.select("chrom"), "chrom", "left_anti").select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("len").alias("end"))
    return heads.unionByName(tails).unionByName(whole)


def remove_n_islands(tiles, width: int, cutoff: int, flank: int) -> DataFrame:
    """seq_remove_n_islands."""
    return extract(tiles, n_free_intervals(tiles, cutoff, flank), width)


def domain_intervals(domains, sizes, resolution: int | None = None) -> DataFrame:
    """seq_cut_intervals: sorted domains plus head and tail pieces; with a resolution, bounds floored and no ends added."""
    if resolution:
        return domains.select("chrom", *[(F.floor(F.col(c) / resolution) * resolution).alias(c) for c in ("start", "end")])
    ends = domains.groupBy("chrom").agg(F.min("start").alias("a"), F.max_by("end", "start").alias("b")).join(sizes, "chrom")
    head = ends.where(F.col("a") != 0).select("chrom", F.lit(0).cast("bigint").alias("start"), F.col("a").alias("end"))
    tail = ends.where(F.col("b") != F.col("len")).select("chrom", F.col("b").alias("start"), F.col("len").alias("end"))
    return domains.select("chrom", "start", "end").unionByName(head).unionByName(tail)


def window_about(intervals, total: int) -> DataFrame:
    """Interval of a fixed length about the centre of another."""
    center = F.floor((F.col("start") + F.col("end")) / 2) - total // 2
    return intervals.withColumn("start", center).withColumn("end", F.col("start") + total)


def promoter_windows(sites, up: int = 200, down: int = 40) -> DataFrame:
    """Strand-aware window: up letters before and down letters after the interval in reading direction."""
    plus = F.col("strand") == "+"
    return sites.withColumns({
        "start": F.greatest(F.lit(0), F.col("start") - F.when(plus, up).otherwise(down)),
        "end": F.col("end") + F.when(plus, down).otherwise(up),
    })


def extract_stranded(tiles, intervals, width: int) -> DataFrame:
    """seq_extract_window: sequence of every interval, reverse complement on the minus strand."""
    return extract(tiles, intervals, width).withColumn(
        "seq", F.when(F.col("strand") == "-", reverse_complement("seq")).otherwise(F.col("seq")))


def match_merge(extracted, labelled) -> DataFrame:
    """seq_match_merge: rows whose sequence equals a labelled sequence; the join compares short hashes first."""
    a = extracted.withColumn("_h", F.xxhash64("seq"))
    b = labelled.select(F.col("seq").alias("_seq"), *[c for c in labelled.columns if c != "seq"]).withColumn("_h", F.xxhash64("_seq"))
    return a.join(b, "_h").where(F.col("seq") == F.col("_seq")).drop("_h", "_seq")


def draw_counts(rows, observed, key: str, seed=42) -> DataFrame:
    """Number of substitutions per row: a hashed draw of an observed count plus N(0, 0.3) noise, rounded, at least 0."""
    pool = hash_ranks(observed.select(key, "k"), [], f"{seed}o", [key], "_rn").select("_rn", F.col("k").alias("_k"))
    n = observed.select(F.count("*")).scalar()
    u1, u2 = hash_uniform(f"{seed}u", key), hash_uniform(f"{seed}v", key)
    noise = 0.3 * F.sqrt(-2 * F.ln(1 - u1)) * F.cos(2 * 3.141592653589793 * u2)
    drawn = rows.withColumn("_rn", F.pmod(hash_int(f"{seed}d", key), n) + 1).join(pool, "_rn")
    return drawn.withColumn("n_sub", F.greatest(F.lit(0), F.bround(F.col("_k") + noise, 0).cast("int"))).drop("_rn", "_k")


def distinct_positions(n: Column, k: Column, seed, key: str) -> Column:
    """k distinct positions of 0..n-1, each subset equally likely, from k draws (Floyd's method)."""
    def step(acc, j):
        t = F.floor(hash_uniform(f"{seed}p", key, j) * (j + 1)).cast("int")
        return F.concat(acc, F.array(F.when(F.array_contains(acc, t), j).otherwise(t)))

    none = F.array().cast("array<int>")
    return F.when(k > 0, F.aggregate(F.sequence(n - k, n - 1), none, step)).otherwise(none)


def random_substitute(rows, letters: str, key: str, seed=42) -> DataFrame:
    """seq_random_substitute: ``n_sub`` hashed positions take hashed letters."""
    n = F.length("seq")
    rows = rows.withColumn("_at", distinct_positions(n, F.least(F.col("n_sub"), n), seed, key))

    def letter(p):
        i = F.floor(hash_uniform(f"{seed}l", key, p) * len(letters)).cast("int")
        return F.substring(F.lit(letters), i + 1, F.lit(1))

    new = F.aggregate("_at", F.col("seq"), lambda s, p: F.overlay(s, letter(p), p + 1, F.lit(1)))
    return rows.withColumn("seq", new).drop("_at")


# variants ------------------------------------------------------------------------------------------

def parse_freq(col) -> Column:
    """var_parse_freq: mean over sources of ``SRC:p0,p1|..`` as an array, ``.`` counts as zero."""
    sources = F.transform(F.split(_c(col), "\\|"), lambda s: F.transform(
        F.split(F.element_at(F.split(s, ":"), -1), ","), lambda p: F.when(p == ".", F.lit(0.0)).otherwise(p.try_cast("double"))))
    zero = F.lit(0.0)
    start = F.struct(F.array().cast("array<double>").alias("s"), F.lit(0).alias("n"))

    def add(acc, x):
        both = F.zip_with(acc["s"], x, lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero))
        return F.struct(both.alias("s"), (acc["n"] + 1).alias("n"))

    return F.aggregate(sources, start, add, lambda acc: F.transform(acc["s"], lambda v: v / acc["n"]))


def fix_reference(alleles, probs, cutoff: float = 0.0) -> Column:
    """var_ref_fix: a reference at or under the cutoff takes all probability; alleles at or under it drop out."""
    p = _c(probs)
    fixed = F.when(p[0] <= cutoff, F.transform(p, lambda x, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))).otherwise(p)
    pairs = F.zip_with(_c(alleles), fixed, lambda a, q: F.struct(a.alias("allele"), q.alias("prob")))
    return F.filter(pairs, lambda x: x["prob"] > cutoff)


def each_allele(variants, *keys: str) -> DataFrame:
    """One row per allele (keys, allele, prob). Spark infers a filter on the size of what ``explode`` reads, which makes every array once more for it; the outer form has none."""
    rows = variants.select(*keys, F.posexplode_outer("alleles").alias("_i", "_a")).where("_i IS NOT NULL")
    return rows.select(*keys, "_a.allele", "_a.prob")


def variant_sites(variants, binned: bool = False) -> DataFrame:
    """Symbols and probabilities at every position a variant touches, summed and scaled to one per site.

    ``variants`` has chrom, pos, ref and alleles array<struct<allele, prob>> (reference first). With ``binned`` a site is one row with its symbols
    as ``a`` array<struct<symbol, prob>>, and the stretch ``_bin`` by which the rows are dealt stays.
    """
    return _whole_sites(variants) if binned else _binned_sites(variants).drop("_bin")


#: Positions of a stretch whose variants and bases meet in one task.
STRETCH = 1024


def _stretches_of_variants(variants) -> tuple[DataFrame, T.DataType]:
    """(chrom, _bin, _v): the variants of every stretch, dealt by (chrom, _bin), and the type of a position. Variants are exchanged, not their rows of one symbol."""
    offsets = F.sequence(F.lit(0), F.length("ref") - 1)
    stretches = F.array_distinct(F.transform(offsets, lambda o: F.floor((F.col("pos") + o) / STRETCH)))
    alleles = F.transform("alleles", lambda x: F.struct(x["allele"].alias("allele"), x["prob"].cast("double").alias("prob")))
    one = F.struct(F.col("pos").cast("bigint").alias("pos"), "ref", alleles.alias("alleles"))
    dealt = variants.select("chrom", one.alias("_v"), F.explode(stretches).alias("_bin")).repartition("chrom", "_bin")
    return dealt.groupBy("chrom", "_bin").agg(F.collect_list("_v").alias("_v")), variants.select(F.col("pos") + F.lit(0)).schema[0].dataType


def _binned_sites(variants) -> DataFrame:
    """:func:`variant_sites` with the stretch ``_bin`` of every position, dealt by (chrom, _bin). The variants of a stretch become its sites in one array operation,
    so no row of an allele's letter is sorted."""
    stretches, pos = _stretches_of_variants(variants)
    sites = stretches.select("chrom", "_bin", F.explode_outer(_sites_of("_v", "_bin", F.lit(STRETCH))).alias("_s")).where("_s IS NOT NULL")  # see each_allele
    return sites.select("chrom", "_bin", F.col("_s.pos").cast(pos).alias("pos"), "_s.symbol", "_s.prob", "_s.is_variant")


def _whole_sites(variants) -> DataFrame:
    """(chrom, _bin, pos, is_variant, a): the same with one row a site, symbols in order."""
    stretches, pos = _stretches_of_variants(variants)
    sites = stretches.select("chrom", "_bin", F.explode_outer(_whole_sites_of("_v", "_bin", F.lit(STRETCH))).alias("_s")).where("_s IS NOT NULL")
    return sites.select("chrom", "_bin", F.col("_s.pos").cast(pos).alias("pos"), "_s.is_variant", "_s.a")


#: Codes of symbols: the letter's number, INSERTED added if an insertion follows it, or one of these.
INSERTED, DELETED, NOTHING = 1 << 21, 1 << 22, 1 << 23


def _symbol(code: int) -> str:
    return "DEL" if code == DELETED else "" if code == NOTHING else chr(code & (INSERTED - 1)) + "I" * bool(code & INSERTED)


def _letters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all letters of texts without nulls, where each text begins and its length."""
    raw = "".join(texts.to_pylist()).encode("utf-32-le", "surrogatepass")
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(raw, np.uint32).astype(np.int64), np.cumsum(n) - n, n


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Number of items of each list, 0 for null, and all items."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), lists.flatten()


def _ramp(n: np.ndarray) -> np.ndarray:
    """0, 1, .. for each count."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


#: Stretches or sites that are worked on together, so that memory does not follow Arrow's batch.
TOGETHER = 512


def _in_slices(fn, stretches: pa.Array, bins: pa.Array, width: pa.Array) -> pa.Array:
    size = width[0].as_py() if len(width) else STRETCH
    return pa.concat_arrays([fn(stretches.slice(i, TOGETHER), bins.slice(i, TOGETHER), size) for i in range(0, max(1, len(bins)), TOGETHER)])


@F.arrow_udf(T.ArrayType(T.StructType().add("pos", "long").add("symbol", "string").add("prob", "double").add("is_variant", "boolean")))
def _sites_of(stretches: pa.Array, bins: pa.Array, width: pa.Array) -> pa.Array:
    def few(stretches: pa.Array, bins: pa.Array, size: int) -> pa.Array:
        group, site, pos, symbol, prob, varies = _few_sites(stretches, bins, size)
        rows = pa.StructArray.from_arrays([pos, symbol, prob, varies], names=["pos", "symbol", "prob", "is_variant"])
        return pa.ListArray.from_arrays(_offsets(group, len(bins)), rows)

    return _in_slices(few, stretches, bins, width)


@F.arrow_udf(T.ArrayType(T.StructType().add("pos", "long").add("is_variant", "boolean").add("a", T.ArrayType(T.StructType().add("symbol", "string").add("prob", "double")))))
def _whole_sites_of(stretches: pa.Array, bins: pa.Array, width: pa.Array) -> pa.Array:
    def few(stretches: pa.Array, bins: pa.Array, size: int) -> pa.Array:
        group, site, pos, symbol, prob, varies = _few_sites(stretches, bins, size)
        a = pa.ListArray.from_arrays(pa.array(np.r_[site, len(group)].astype(np.int32)), pa.StructArray.from_arrays([symbol, prob], names=["symbol", "prob"]))
        rows = pa.StructArray.from_arrays([pos.take(pa.array(site)), varies.take(pa.array(site)), a], names=["pos", "is_variant", "a"])
        return pa.ListArray.from_arrays(_offsets(group[site], len(bins)), rows)

    return _in_slices(few, stretches, bins, width)


def _offsets(group: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.searchsorted(group, np.arange(n + 1)).astype(np.int32))


def _few_sites(stretches: pa.Array, bins: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array, pa.Array, pa.Array]:
    """The symbols of each stretch of variants (pos, ref, alleles) in order of stretch, position and symbol, positions of ``width`` to a stretch: number of the stretch, where each site begins,
    then position, symbol, probability scaled to one per site, and whether the site is not a single certain symbol."""
    n_variants, variants = _parts(stretches)
    n_alleles, alleles = _parts(pc.struct_field(variants, "alleles"))
    allele, prob = pc.struct_field(alleles, "allele"), pc.struct_field(alleles, "prob")
    known = allele.is_valid().to_numpy(zero_copy_only=False)
    letters, begin, la = _letters(pc.fill_null(allele, ""))
    lr = pc.fill_null(pc.utf8_length(pc.struct_field(variants, "ref")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = pc.struct_field(variants, "pos")
    no_at, at = at.is_null().to_numpy(zero_copy_only=False), pc.fill_null(at, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    stretch = np.repeat(np.arange(len(stretches)), n_variants)
    # every allele covers exactly the positions of the reference text; an empty text counts down from 0 to -1, as a sequence does
    of = np.repeat(np.arange(len(variants)), n_alleles)
    n = np.where(lr[of] > 0, lr[of], 2)
    row, o = np.repeat(np.arange(len(of)), n), _ramp(n)
    v = of[row]
    o = np.where(lr[v] > 0, o, -o)
    bin_ = pc.fill_null(bins, 0).to_numpy(zero_copy_only=False)[stretch[v]]
    here = np.where(no_at[v], bins.is_null().to_numpy(zero_copy_only=False)[stretch[v]], ((at[v] + o) // width == bin_) & bins.is_valid().to_numpy(zero_copy_only=False)[stretch[v]])
    row, o, v = row[here], o[here], v[here]
    length = la[row]
    inserted = known[row] & (length > lr[v]) & (o == lr[v] - 1)
    lettered = inserted | (known[row] & (o < length))
    place = begin[row] + np.maximum(o, 0)
    code = np.full(len(row), DELETED, np.int64)
    code[lettered] = np.where(length[lettered] > 0, letters[np.minimum(place[lettered], max(len(letters) - 1, 0))] if len(letters) else 0, NOTHING) + np.where(inserted[lettered], INSERTED, 0)
    pos, group = np.where(no_at[v], 0, at[v] + o), stretch[v]
    codes, code = np.unique(code, return_inverse=True)
    names = [_symbol(int(c)) for c in codes]
    in_order = sorted(range(len(names)), key=names.__getitem__)
    code = np.argsort(np.array(in_order, int))[code]  # numbers of symbols in their order
    has = prob.is_valid().to_numpy(zero_copy_only=False)[row]
    p = np.where(has, pc.fill_null(prob, 0.0).to_numpy(zero_copy_only=False)[row], 0.0)
    order = np.lexsort((code, pos, no_at[v], group))
    group, pos, code, none, has, p = group[order], pos[order], code[order], no_at[v][order], has[order], p[order]

    def starts(*cols: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.logical_or.reduce([np.r_[True, x[1:] != x[:-1]] for x in cols])) if len(cols[0]) else np.zeros(0, int)

    first = starts(group, none, pos, code)
    if len(first):
        p, has = np.add.reduceat(p, first), np.logical_or.reduceat(has, first)
    group, pos, none, code = group[first], pos[first], none[first], code[first]
    site = starts(group, none, pos)
    if len(site):
        size = np.diff(np.r_[site, len(pos)])
        total, some = np.repeat(np.add.reduceat(p, site), size), np.repeat(np.logical_or.reduceat(has, site), size)
        if (has & (total == 0)).any():
            raise ZeroDivisionError("probabilities of a site add up to 0")
        with np.errstate(invalid="ignore", divide="ignore"):
            p = p / total
        varies = np.repeat(np.maximum.reduceat(np.where(has, p, -np.inf), site), size) != 1
    else:
        some = varies = np.zeros(0, bool)
    symbol = pa.array([names[i] for i in in_order], pa.string()).take(pa.array(code))
    return group, site, pa.array(pos, mask=none), symbol, pa.array(p, mask=~has), pa.array(varies, mask=~some)


def scale_sites(sites, *keys: str) -> DataFrame:
    """Probabilities scaled to one per site, with the flag "not a single certain symbol"."""
    site = Window.partitionBy(*(keys or ("chrom", "pos")))
    scaled = sites.withColumn("prob", F.col("prob") / F.sum("prob").over(site))
    return scaled.withColumn("is_variant", F.max("prob").over(site) != 1)


def reference_bases(tiles) -> DataFrame:
    """One row per position: (chrom, pos, base)."""
    return tiles.select("chrom", "start", F.posexplode(F.split("seq", "")).alias("i", "base")).select(
        "chrom", (F.col("start") + F.col("i")).alias("pos"), "base")


def site_matrix(tiles, variants) -> DataFrame:
    """var_site_matrix: variant sites plus certain reference symbols at every other position.

    Tiles meet the variant positions of their stretch, so text is exchanged and never a row a base.
    """
    touched = _binned_sites(variants)
    places = touched.groupBy("chrom", "_bin").agg(F.collect_set("pos").alias("_places"))
    end = F.col("start") + F.greatest(F.length("seq"), F.lit(1))
    cut = tiles.select("chrom", "start", "seq", F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor((end - 1) / STRETCH))).alias("_bin"))
    at = F.greatest("start", F.col("_bin") * STRETCH)
    text = F.substring(F.col("seq"), (at - F.col("start") + 1).cast("int"), (F.least(end, (F.col("_bin") + 1) * STRETCH) - at).cast("int"))
    pieces = cut.select("chrom", "_bin", at.cast("bigint").alias("start"), text.alias("seq"))
    met = pieces.join(places, ["chrom", "_bin"], "left").select("chrom", "start", "_places", F.posexplode(F.split("seq", "")).alias("i", "base"))
    bases = met.withColumn("pos", F.col("start") + F.col("i")).where(~F.coalesce(F.array_contains("_places", F.col("pos")), F.lit(False)))
    certain = bases.select("chrom", "pos", F.col("base").alias("symbol"), F.lit(1.0).alias("prob"), F.lit(False).alias("is_variant"))
    return touched.drop("_bin").unionByName(certain)


def token_variant_labels(chunks, sites, size: int) -> DataFrame:
    """``chunks`` with ``labels``: 1 for every token that lies over a variant position of ``sites`` (chrom, pos), else 0.

    ``chunks`` has chrom, chunk (number of a stretch of ``size`` bases), tokens and reverse: tokens of a reverse complement are laid from the
    chunk's right end, also where the last chunk is short. A chunk meets its own positions, ``size`` at most, by one equi join. Repeated
    sites count once; null tokens give null labels, no tokens none; a null flag means forward.
    """
    own = sites.groupBy("chrom", F.floor(F.col("pos") / size).alias("chunk")).agg(F.collect_set((F.col("pos") % size).cast("int")).alias("_places"))
    places = F.coalesce("_places", F.array().cast("array<int>"))
    return chunks.join(own, ["chrom", "chunk"], "left").withColumn("labels", _covered(F.col("tokens"), places, F.col("reverse"))).drop("_places")


def _covering(tokens, places, reverse) -> list | None:
    """1 for every token over one of the places; from a null token on, nobody knows what lies under them."""
    if tokens is None:
        return None
    known = next((i for i, x in enumerate(tokens) if x is None), len(tokens))
    ends = list(itertools.accumulate(len(x) for x in tokens[:known]))
    length = ends[-1] if ends else 0
    if reverse and known < len(tokens):
        return [None if len(places) else 0] * len(tokens)
    line = bytearray(length)
    for p in places:
        at = length - 1 - p if reverse else p
        if 0 <= at < length:
            line[at] = 1
    labels = [int(line.find(1, at, end) >= 0) for at, end in itertools.pairwise([0, *ends])]
    if known < len(tokens):
        labels.append(None if any(p >= length for p in places) else 0)
        labels += [None if len(places) else 0] * (len(tokens) - known - 1)
    return labels


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _covered(tokens: pd.Series, places: pd.Series, reverse: pd.Series) -> pd.Series:
    return pd.Series([_covering(t, p, r is not None and r == True) for t, p, r in zip(tokens, places, reverse, strict=True)], dtype=object)  # noqa: E712


def overlapping_variants(variants, width: int = 1_000_000) -> DataFrame:
    """Report of records that start inside an earlier record; the furthest end so far runs over stretches of the
    chromosome first, then inside a stretch, so a chromosome is not one sorted group."""
    rows = variants.withColumns({"_w": F.floor(F.col("pos") / width), "_e": F.col("pos") + F.length("ref")})
    rows = rows.where("chrom IS NOT NULL AND pos IS NOT NULL AND _w IS NOT NULL").repartition("chrom", "_w")
    # a digest of all columns, so that none is pruned and both sides share the one exchange
    ends = rows.groupBy("chrom", "_w").agg(F.max("_e").alias("_m"), F.bit_xor(F.xxhash64(*rows.columns)).alias("_all")).where(F.col("_all").isNotNull())
    before = Window.partitionBy("chrom").orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("chrom", "_w", F.max("_m").over(before).alias("_carry"))
    inside = Window.partitionBy("chrom", "_w").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.greatest(F.col("_carry"), F.max("_e").over(inside))
    return rows.join(carried, ["chrom", "_w"]).withColumn("_to", reach).where(F.col("pos") < F.col("_to")).select(variants.columns)


def revcomp_matrix(sites, tiles) -> DataFrame:
    """var_revcomp_matrix: complement symbols, insertion mass moves to the next position, positions are mirrored.

    Neighbours meet by equi joins on (chrom, pos), so a long chromosome is not one window.
    """
    sizes = tile_lengths(tiles)
    is_ins = F.col("symbol").rlike("^.I$")
    ins = sites.where(is_ins).groupBy("chrom", "pos").agg(F.sum("prob").alias("s")).join(sizes, "chrom").where(F.col("pos") < F.col("len") - 1)
    own, prev = ins.select("chrom", "pos", F.col("s").alias("s0")), ins.select("chrom", (F.col("pos") + 1).alias("pos"), F.col("s").alias("s1"))
    base = sites.where(~is_ins).join(own, ["chrom", "pos"], "left").join(prev, ["chrom", "pos"], "left")
    left = F.when(F.col("s0") == 1, F.col("prob")).otherwise(F.col("prob") / (1 - F.coalesce("s0", F.lit(0.0))))
    swapped = F.when(F.length("symbol") == 1, complement("symbol")).otherwise(F.col("symbol"))
    kept = base.select("chrom", "pos", swapped.alias("symbol"), (left * (1 - F.coalesce("s1", F.lit(0.0)))).alias("prob"))
    moved = prev.join(reference_bases(tiles), ["chrom", "pos"]).select(
        "chrom", "pos", F.concat(complement("base"), F.lit("I")).alias("symbol"), F.col("s1").alias("prob"))
    mirrored = kept.unionByName(moved).join(sizes, "chrom").select("chrom", (F.col("len") - 1 - F.col("pos")).alias("pos"), "symbol", "prob")
    return scale_sites(mirrored.where(F.col("prob") != 0))


def draw_allele_pairs(sites, replacement: bool = False, seed=42) -> DataFrame:
    """Two alleles per variant site by probability, as a sorted pair ``a_b`` (a site has at most 11 symbols)."""
    if "a" in sites.columns:
        variant = sites.where("is_variant")
    else:
        variant = sites.where("is_variant").groupBy("chrom", "pos").agg(F.array_sort(F.collect_list(F.struct("symbol", "prob"))).alias("a"))
    return variant.where(F.size("a") > 1).select("chrom", "pos", _pair(replacement, seed).alias("pair"))


def _pair(replacement: bool, seed) -> Column:
    """Sorted pair of two alleles of ``a`` for the site (chrom, pos)."""
    return _drawn_pair("a", hash_uniform(f"{seed}a", "chrom", "pos"), hash_uniform(f"{seed}b", "chrom", "pos"), F.lit(replacement))


def _drawn(n: np.ndarray, prob: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Place in each list of n probabilities at which their running sum passes ``u`` times the total; the last one if none does."""
    upto = np.zeros((len(n), max(1, n.max(initial=1))))  # sums run from the left, as adding one by one does
    upto[np.repeat(np.arange(len(n)), n), _ramp(n)] = prob
    np.cumsum(upto, axis=1, out=upto)
    hit = (u * upto[:, -1])[:, None] < upto
    return np.minimum(np.where(hit.any(1), hit.argmax(1), n - 1), n - 1)


@F.arrow_udf(T.StringType())
def _drawn_pair(items: pa.Array, u: pa.Array, w: pa.Array, replacement: pa.Array) -> pa.Array:
    """Symbols drawn from items (symbol, prob) by ``u`` and by ``w``, without ``replacement`` from all but the first one drawn."""
    n, flat = _parts(items)
    symbol, prob = pc.struct_field(flat, "symbol"), pc.struct_field(flat, "prob").to_numpy(zero_copy_only=False).astype(float)
    u, w = u.to_numpy(zero_copy_only=False).astype(float), w.to_numpy(zero_copy_only=False).astype(float)
    begin = np.cumsum(n) - n
    at = begin + _drawn(n, prob, u)
    one = symbol.take(pa.array(at, pa.int64()))
    if len(n) and replacement[0].as_py():
        two = symbol.take(pa.array(begin + _drawn(n, prob, w), pa.int64()))
    else:
        left = pc.fill_null(pc.not_equal(symbol, one.take(pa.array(np.repeat(np.arange(len(n)), n)))), False).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(left)
        upto = np.r_[0, np.cumsum(left)]
        m = upto[begin + n] - upto[begin]
        two = symbol.take(pa.array(rest)).take(pa.array(np.cumsum(m) - m + _drawn(m, prob[rest], w), pa.int64(), mask=m == 0))
    swap = pc.fill_null(pc.less(two, one), False)
    first, second = pc.if_else(swap, two, one), pc.if_else(swap, one, two)
    return pc.binary_join_element_wise(first, second, "_", null_handling="skip")


def sample_sites(tiles, sites, lexicon, width: int, replacement: bool = False, seed=42) -> DataFrame:
    """var_sample_sites: tiles with one character per variant site for its drawn pair; other letters stay.

    Only variant sites become rows; a tile's string is spliced from the pieces between its sites.
    """
    if "a" not in sites.columns:
        item = F.array_sort(F.collect_list(F.struct("symbol", "prob")))
        sites = sites.groupBy("chrom", "pos", "is_variant").agg(item.alias("a"))
    certain = F.filter(F.transform("a", lambda x: x["symbol"]), lambda x: F.length(x) > 1)
    own = F.when(F.col("is_variant") & (F.size("a") > 1), F.array(_pair(replacement, seed))).when(~F.col("is_variant"), certain)
    tile = F.floor(F.col("pos") / width)
    asked = sites.select("chrom", "pos", F.explode_outer(own).alias("pair")).where("pair IS NOT NULL")  # see each_allele
    letters = asked.join(lexicon, "pair").select("chrom", tile.alias("tile"), F.struct((F.col("pos") % width).cast("int").alias("o"), "letter").alias("v"))
    per = letters.groupBy("chrom", "tile").agg(F.array_sort(F.collect_list("v")).alias("v"))
    return tiles.join(per, ["chrom", "tile"], "left").withColumn("seq", F.coalesce(_spliced("seq", "v"), "seq")).select("chrom", "tile", "start", "seq")


@F.arrow_udf(T.StringType())
def _spliced(seq: pa.Array, letters: pa.Array) -> pa.Array:
    """Texts with a letter (o, letter) in place of the one at each offset, offsets ascending; null without letters or where one is null."""
    n, flat = _parts(letters)
    at, letter = pc.struct_field(flat, "o").to_pylist(), pc.struct_field(flat, "letter").to_pylist()
    out, first = [], 0
    for text, k, some in zip(seq.to_pylist(), n.tolist(), letters.is_valid().to_pylist(), strict=True):
        parts, upto = [], 0
        if some and text is not None:
            for o, x in zip(at[first : first + k], letter[first : first + k], strict=True):
                parts += [text[upto : max(upto, o)], x]
                upto = o + 1
            parts.append(text[upto:])
        out.append("".join(parts) if some and text is not None and None not in parts else None)
        first += k
    return pa.array(out, pa.string())


# labels --------------------------------------------------------------------------------------------

def insulation_labels(chunks, table) -> DataFrame:
    """lab_insulation: chunk with the label of its start, null labels and all-N chunks dropped, two decimals."""
    scored = table.where(F.col("score").isNotNull()).select("chrom", "start", F.round("score", 2).alias("label"))
    return chunks.where(~F.col("seq").rlike("^N+$")).join(scored, ["chrom", "start"])


def _contact_label(oe: Column, binarize: bool) -> Column:
    value = F.coalesce(oe, F.lit(0.0))
    return (value != 0).cast("double") if binarize else F.round(value, 2)


def contact_fixed(chunks, contacts, stride: int = 1, binarize: bool = True) -> DataFrame:
    """lab_contact_fixed: chunk i with chunk i + stride and their contact; pairs made only of N drop out."""
    a = chunks.select("chrom", F.col("chunk").alias("bin1"), F.col("seq").alias("seq1"))
    b = chunks.select("chrom", (F.col("chunk") - stride).alias("bin1"), F.col("seq").alias("seq2"))
    pairs = a.join(b, ["chrom", "bin1"]).where(~F.concat("seq1", "seq2").rlike("^N+$")).withColumn("bin2", F.col("bin1") + stride)
    out = pairs.join(contacts, ["chrom", "bin1", "bin2"], "left")
    return out.select("chrom", "bin1", "bin2", "seq1", "seq2", _contact_label(F.col("oe"), binarize).alias("label"))


def contact_complete(tiles, contacts, sizes, resolution: int, stride: int, width: int, binarize: bool = True) -> DataFrame:
    """The merged form: one piece from chunk i to the end of chunk i + stride."""
    last = F.floor((F.col("len") - resolution * stride - 1) / resolution)
    spans = sizes.where(F.col("len") > resolution * stride).select("chrom", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("bin1"))
    spans = spans.withColumns({"start": F.col("bin1") * resolution, "end": (F.col("bin1") + stride + 1) * resolution, "bin2": F.col("bin1") + stride})
    out = extract(tiles, spans, width).where(~F.col("seq").rlike("^N+$")).join(contacts, ["chrom", "bin1", "bin2"], "left")
    return out.select("chrom", "bin1", "bin2", "seq", _contact_label(F.col("oe"), binarize).alias("label"))


def contact_sequential(chunks, contacts, k: int) -> DataFrame:
    """lab_contact_sequential: full windows of k bins with any contact between bins; labels of the upper triangle, row by row."""
    win = F.floor(F.col("bin1") / k)
    inner = contacts.where((F.col("bin1") < F.col("bin2")) & (win == F.floor(F.col("bin2") / k)) & (F.col("oe") != 0))
    filled = inner.groupBy("chrom", win.alias("window")).agg(F.map_from_entries(F.collect_list(F.struct(
        ((F.col("bin1") % k) * k + F.col("bin2") % k).cast("int").alias("key"), "oe"))).alias("m"))
    cells = F.array(*[F.lit(i * k + j) for i in range(k) for j in range(i + 1, k)])
    labels = F.transform(cells, lambda c: F.round(F.coalesce(F.element_at(F.col("m"), c), F.lit(0.0)), 2))
    wins = filled.withColumn("labels", labels).drop("m")
    windows = chunks.withColumn("window", F.floor(F.col("chunk") / k)).join(wins.select("chrom", "window"), ["chrom", "window"], "left_semi")
    seqs = windows.groupBy("chrom", "window").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("chunk", "seq"))), lambda x: x["seq"]).alias("seqs")).where(F.size("seqs") == k)
    return seqs.join(wins, ["chrom", "window"])


def contact_random(chunks, contacts, sizes, resolution: int, k: int, ratio: float = 1.0, shift: int = 0, binarize: bool = True, seed=0) -> DataFrame:
    """lab_contact_random: samples of k distinct non-N bins with the contacts of all their pairs in draw order.

    Bins are numbered per chromosome in hash order; a sample draws k numbers and meets bins and contacts by equi joins.
    """
    full = stable(chunks.where(~F.col("seq").rlike("^N+$") & (F.length("seq") == resolution)).select("chrom", "chunk"))  # read three times
    numbered = hash_ranks(full, ["chrom"], f"{seed}n", ["chunk"], "_rn")
    pool = full.groupBy("chrom").agg(F.count("*").cast("int").alias("_b")).where(F.col("_b") >= k)
    n = F.floor(F.floor(F.col("len") / (resolution * k)) * F.lit(ratio)).cast("int")
    samples = sizes.join(pool, "chrom").withColumn("_n", n).where("_n > 0").withColumn("sample", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    samples = samples.withColumn("_key", F.concat_ws("/", "chrom", "sample"))
    drawn = samples.select("chrom", "sample", F.posexplode(distinct_positions(F.col("_b"), F.lit(k), seed, "_key")).alias("pos", "_i"))
    bins = drawn.withColumn("_rn", F.col("_i").cast("bigint") + 1).join(numbered, ["chrom", "_rn"]).select("chrom", "sample", "pos", F.col("chunk").alias("bin"))
    rows = bins.groupBy("chrom", "sample").agg(F.array_sort(F.collect_list(F.struct("pos", "bin"))).alias("b"))
    order = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(k) for j in range(i + 1, k)])
    pairs = rows.select("chrom", "sample", "b", F.explode(order).alias("o")).select(
        "chrom", "sample", F.col("o.i").alias("i"), F.col("o.j").alias("j"), F.get("b", F.col("o.i"))["bin"].alias("a"), F.get("b", F.col("o.j"))["bin"].alias("c"))
    keyed = pairs.withColumns({"bin1": F.least("a", "c") + shift, "bin2": F.greatest("a", "c") + shift})
    out = keyed.join(contacts, ["chrom", "bin1", "bin2"], "left")
    return out.select("chrom", "sample", "i", "j", F.col("a").alias("bin_i"), F.col("c").alias("bin_j"), _contact_label(F.col("oe"), binarize).alias("label"))


def measured_hits(hits, labels) -> DataFrame:
    """lab_mpra_join: alignment hits with measured labels; left = lower end, right = upper end + 1."""
    out = hits.join(labels, "seq_id", "left")
    return out.withColumns({"start": F.least("sstart", "send"), "end": F.greatest("sstart", "send") + 1})


def combined_labels(rows, col: str, names: list[str], wanted: list[str], sep: str = ",") -> DataFrame:
    """lab_multi_combined: one joined label string to the requested label columns."""
    parts = F.split(F.col(col), f"\\Q{sep}\\E")
    return rows.select(*[c for c in rows.columns if c != col], *[F.get(parts, F.lit(names.index(w))).alias(w) for w in wanted])
