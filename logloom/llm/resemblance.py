"""Near copies by the share of shingles two texts have in common.

Fingerprints that differ in few bits link first, found as in ``simhash``; what they leave apart is found
by bands of minima.  Either way a pair links only if all its shingles say so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from logloom.llm.columns import text_slices
from logloom.llm.components import components
from logloom.llm.simhash import SEED, digests, majority, near_links
from logloom.session import written

#: Two texts that share 0.8 of their shingles agree on all minima of some band but for 7 in 100,000.
BANDS, ROWS = 24, 5
FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
#: Texts of a bucket that may meet pair by pair; those of a larger one meet by their rare shingles.  It
#: decides speed only: either way finds all pairs of the bucket that are alike.
FEW = 8
#: A round in which a text of each bucket meets all others is repeated while one in so many of its pairs
#: links.  It decides speed only: what is then left meets as far as it can be alike.
PAIRS_A_LINK = 100
#: Bytes of text that a task works on at once.
SLICE_BYTES = 8 << 20


def shingles(hashes: bytes) -> np.ndarray:
    """Sorted hashes of the distinct runs of words."""
    return np.unique(np.frombuffer(hashes, ">u8").astype(np.uint64))


def print_of(found: np.ndarray) -> int:
    return xxh64_intdigest(found.tobytes(), SEED) if len(found) else 0


def buckets(found: np.ndarray) -> list[int]:
    """A hash of the minima of each band."""
    minima = np.empty(len(FACTORS), np.uint64)
    for k, factor in enumerate(FACTORS):
        minima[k] = (found * factor).min()
    return [xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(minima.reshape(BANDS, ROWS))]


def signed(numbers) -> pa.Array:
    return pa.array(np.array(numbers, np.uint64).view(np.int64))


def print_batches(words: int, fingerprinted: bool = False):
    """For each ``row`` with a text: ``print``, a hash of its set of shingles, its ``buckets`` and, on
    request, its ``fingerprint``.

    Texts without words have no bucket; their print and fingerprint are 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("row")
            table = pa.RecordBatch.from_arrays([rows, pc.struct_field(rows, "text")], ["row", "text"])
            for part, texts in text_slices(iter([table]), most=SLICE_BYTES):
                hashes = [digests(t, words) for t in texts.to_pylist()]
                found = [shingles(h) for h in hashes]
                each = [buckets(f) if len(f) else [] for f in found]
                offsets = pa.array(np.cumsum([0, *map(len, each)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, signed([b for e in each for b in e]))
                columns = {"row": part.column("row"), "print": signed([print_of(f) for f in found]), "buckets": lists}
                if fingerprinted:
                    columns["fingerprint"] = signed([majority(h) for h in hashes])
                yield pa.RecordBatch.from_pydict(columns)

    return run


def set_batches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, most=SLICE_BYTES):
            sets = [shingles(digests(t, words)).view(np.int64) for t in texts.to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("print"), pa.array(sets, pa.list_(pa.int64()))], ["print", "set"])

    return run


def alike_batches(least: float):
    """Pass the pairs (a, b) whose sets share at least ``least`` of what either has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of prints whose sets are alike."""
    x, y = sets.select(F.col("print").alias("a"), F.col("set").alias("x")), sets.select(F.col("print").alias("b"), F.col("set").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(alike_batches(least), "a long, b long")


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("print", "other").alias("a"), F.greatest("print", "other").alias("b")).distinct()


def star_pairs(rooted: DataFrame, nth: int) -> DataFrame:
    """Each text of a bucket with one of them, another one each round, if their roots differ."""
    apart = rooted.groupBy("bucket").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct(F.xxhash64("print", F.lit(nth)).alias("h"), "print", "root")).alias("star")
    ).filter("low < high")
    stars = apart.select("bucket", F.col("star.print").alias("other"), F.col("star.root").alias("other_root"))
    return ordered(rooted.join(stars, "bucket").filter("root <> other_root"))


def rare_pairs(texts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs of ``texts`` (print, root) with different roots that can share ``least`` of their shingles.

    All sets are put in one order, rare shingles first.  Of n shingles one set can miss at most
    n - ceil(least n) if it is alike to another, so two such sets meet among the first
    n - ceil(least n) + 1 of each.  What many texts share stands at the end: a passage in all of them
    makes no pairs unless it is nearly the whole text.  From the first shingle that both have on, each
    must have as many left as the two must share.
    """
    cells = sets.join(texts, "print").select("print", "root", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    cells = written(cells, "cells")
    shared = cells.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1
    heads = written(
        cells.join(shared, "shingle")
        .groupBy("print", "root", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("all"))  # one text's shingles
        .select("print", "root", "n", F.posexplode(F.slice("all", F.lit(1), first)).alias("i", "c"))
        .filter("c.df > 1")
        .select("print", "root", "n", (F.col("n") - F.col("i")).alias("after"), F.col("c.shingle").alias("shingle")),
        "heads",
    )
    met = heads.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    heads = heads.join(met.select("shingle"), "shingle", "left_semi")
    other = heads.select("shingle", F.col("print").alias("other"), F.col("root").alias("other_root"), F.col("n").alias("m"), F.col("after").alias("other_after"))
    fit = (F.col("print") < F.col("other")) & (F.col("root") != F.col("other_root"))
    near = (F.col("n") >= F.col("m") * least - 1e-9) & (F.col("m") >= F.col("n") * least - 1e-9)
    enough = F.least("after", "other_after") * (1 + least) >= (F.col("n") + F.col("m")) * least - 1e-9
    return ordered(heads.join(other, "shingle").filter(fit & near & enough))


def rest_pairs(rooted: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """All pairs with different roots that share a bucket and can be alike."""
    sizes = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
    left = rooted.join(sizes.filter("low < high").select("bucket", "n"), "bucket")
    few = left.filter(F.col("n") <= FEW).drop("n")
    other = few.select("bucket", F.col("print").alias("other"), F.col("root").alias("other_root"))
    small = ordered(few.join(other, "bucket").filter("print < other and root <> other_root"))
    return small.union(rare_pairs(left.filter(F.col("n") > FEW).select("print", "root").distinct(), sets, least)).distinct()


def fingerprint_pairs(hashed: DataFrame, most: int) -> DataFrame:
    """Pairs of prints whose fingerprints differ in at most ``most`` bits.

    Sets with one fingerprint meet the smallest of them; that one stands for all of them where
    fingerprints differ.
    """
    held = written(hashed.select("print", "fingerprint").distinct(), "fingerprints")
    first = written(held.groupBy("fingerprint").agg(F.min("print").alias("other")), "firsts")
    near = near_links(first.select(F.col("fingerprint").alias("print")), most).filter("a < b").distinct()
    x, y = first.select(F.col("fingerprint").alias("a"), F.col("other").alias("print")), first.select(F.col("fingerprint").alias("b"), "other")
    same = held.join(first, "fingerprint").select("print", "other").filter("print <> other")
    return ordered(same.union(near.join(x, "a").join(y, "b").select("print", "other")))


def similar_roots(hashed: DataFrame, words: int, least: float, most: int) -> DataFrame:
    """(node, root): the components of prints of similarity ``least`` that are near by their fingerprints
    or share a bucket.

    Near fingerprints link first.  Then a bucket's texts meet one of them, round after round, as long as
    this links enough of them, so that many copies of one text are linked by as many pairs; then those
    that are still apart meet as far as they can be alike.
    """
    placed = hashed.select("print", F.explode("buckets").alias("bucket")).distinct()
    full = placed.groupBy("bucket").agg(F.min("print").alias("low"), F.max("print").alias("high")).filter("low < high")
    members = written(placed.join(full.select("bucket"), "bucket"), "members")
    near = written(fingerprint_pairs(hashed.filter(F.size("buckets") > 0), most), "near")
    some = members.select("print").union(near.select("a")).union(near.select("b")).distinct()
    one = hashed.join(some, "print", "left_semi").groupBy("print").agg(F.min("row.text").alias("text"))
    sets = written(one.mapInArrow(set_batches(words), "print long, set array<long>"), "sets")
    links = written(alike(near, sets, least), "links")
    roots = written(components(links), "roots").toDF("node", "root")
    nth, last = 0, False
    while True:
        rooted = written(
            members.join(roots, members["print"] == roots["node"], "left").select("bucket", "print", F.coalesce("root", "print").alias("root")),
            "rooted",
        )
        pairs = written(rest_pairs(rooted, sets, least) if last else star_pairs(rooted, nth), "pairs")
        found = written(alike(pairs, sets, least), "alike")
        linked, met = found.count(), pairs.count()
        if linked:
            links = written(links.union(found), "links")
            roots = written(components(links), "roots")
        if last or not met:
            return roots
        last = linked * PAIRS_A_LINK < met
        nth += 1


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, most: int = 3) -> DataFrame:
    """One document of each group of near copies, with its columns: the first by doc_id, once if it repeats.

    Near copies share at least ``least`` of the distinct runs of ``words`` words that either has, or are
    joined by a chain of such pairs; every pair that links has been compared by all its shingles.  Pairs
    whose fingerprints differ in at most ``most`` bits are compared first, then those that share a band.
    Null texts and texts without words are copies of each other; documents without an id count last;
    an empty table gives no rows.  Columns of any name may come along: they are carried as one struct.
    """
    carried = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    long = T.LongType()
    schema = T.StructType([carried.schema["row"], T.StructField("print", long), T.StructField("buckets", T.ArrayType(long)), T.StructField("fingerprint", long)])
    hashed = written(carried.mapInArrow(print_batches(words, fingerprinted=True), schema), "hashed")
    roots = similar_roots(hashed, words, least, most)
    prints = hashed.groupBy("print").agg(F.min(F.struct(F.col("row.doc_id").isNull().alias("none"), "row.doc_id")).alias("first"))
    rooted = prints.join(roots, prints["print"] == roots["node"], "left").withColumn("root", F.coalesce("root", "print"))
    keepers = written(
        rooted.groupBy("root").agg(F.min(F.struct("first.none", "first.doc_id", "print")).alias("k")).select("k.doc_id", "k.print"), "keepers"
    )
    same = F.col("d.row.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.print") == F.col("k.print"))
    once = Window.partitionBy("d.row.doc_id", "d.print").orderBy("d.row.text")
    return (
        hashed.alias("d").join(keepers.alias("k"), same, "left_semi")
        .withColumn("nth", F.row_number().over(once))
        .filter("nth = 1")
        .select("row.*")
    )
