"""Near copies by fingerprints that differ in few bits, found by the general pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from logloom.llm.components import components
from logloom.session import written

SEED = 42
BITS, ATOM = 64, 16
#: Ways to join the four atoms of 16 correlated bits into partitions, coarse to fine.
LAYOUTS = (((0, 1), (2, 3)), ((0, 1), (2,), (3,)), ((0,), (1,), (2,), (3,)))
#: Distinct fingerprints on which the layouts' costs are compared; it decides speed, not results.
LAYOUT_SAMPLE = 4096
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def digests(text: str | None, words: int) -> bytes:
    """Eight bytes for each run of ``words`` words, repeats included; a shorter text is one run."""
    tokens = text.encode().translate(LOWER).split() if text else []
    if not tokens:
        return b""
    joined = b" ".join(tokens)
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    ends = np.cumsum(lengths + 1) - 1
    count = max(len(tokens) - words + 1, 1)
    starts, ends = (ends - lengths)[:count].tolist(), ends[-count:].tolist()
    return b"".join([xxh64_digest(joined[a:b], SEED) for a, b in zip(starts, ends)])


def majority(hashes: bytes) -> int:
    """Bits set in over half of the hashes, as an unsigned number; 0 if there are none."""
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(bits)).tobytes())


def fingerprint(text: str | None, words: int = 3) -> int:
    """Bits set in over half of the hashes of all shingles, as an unsigned number."""
    return majority(digests(text, words))


def fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(prints.view(np.int64))], [*batch.schema.names, "print"]
        )


def fingerprints(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` and ``print``, the fingerprint of ``text`` as a signed number.

    Null and empty texts have fingerprint 0.  ``docs`` must not have a column ``print``.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(fingerprint_batches, f"{fields}, print long")


def bits_of(prints: pa.Array) -> np.ndarray:
    """One row of 64 bits for each fingerprint, the highest first."""
    big = prints.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64).byteswap().view(np.uint8)
    return np.unpackbits(big.reshape(-1, 8), axis=1)


def gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each two bits are set together, among the fingerprints of a task."""
    gram = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            bits = bits_of(batch.column("print").slice(at, 4096)).astype(np.float32)
            gram += (bits.T @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(gram[i, j])], ["i", "j", "n"])


def correlated_groups(gram: np.ndarray, n: int) -> list[list[int]]:
    """Bits in groups of 16: each group grows by the bit that is most correlated with it."""
    share = gram / max(n, 1)
    mean = np.diag(share)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs(share - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(tie, 0)
    free, groups = list(range(BITS)), []
    while free:
        group = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < ATOM:
            best = max(free, key=lambda b: (tie[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        groups.append(group)
    return groups


def atoms_of(prints: pa.Array, groups: list[list[int]]) -> np.ndarray:
    """The value of each group of bits: four numbers of 16 bits for each fingerprint."""
    bits = bits_of(prints)
    packed = [np.ascontiguousarray(np.packbits(bits[:, g], axis=1)).view(">u2")[:, 0].astype(np.int64) for g in groups]
    return np.stack(packed, 1) if len(bits) else np.zeros((0, len(groups)), np.int64)


def histogram_batches(groups: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            atoms = atoms_of(batch.column("print"), groups)
            for k in range(atoms.shape[1]):
                value, n = np.unique(atoms[:, k], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value + (k << ATOM)), pa.array(n)], ["cell", "n"]
                )

    return run


def shells(histogram: np.ndarray, most: int) -> np.ndarray:
    """Fingerprints whose atom differs from each value in exactly 0, 1, … ``most`` bits."""
    out = np.zeros((most + 1, 1 << ATOM))
    out[0] = histogram
    places = np.arange(1 << ATOM)
    for bit in range(ATOM):
        flipped = out[:, places ^ (1 << bit)]
        out[1:] += flipped[:-1]
    return out


@dataclass
class Plan:
    """What probing needs: groups of bits, their shells, and how atoms form partitions."""

    groups: list[list[int]]
    shells: np.ndarray  # atom, distance, value
    n: int
    most: int
    layout: tuple = LAYOUTS[-1]

    def masks(self, width: int, distance: int) -> np.ndarray:
        return np.array([sum(1 << b for b in c) for c in combinations(range(width), distance)], np.int64)

    def costs(self, atoms: np.ndarray, layout) -> np.ndarray:
        """Probes and estimated candidates of each partition for thresholds -1, 0, … ``most``."""
        out = np.zeros((len(layout), self.most + 2, len(atoms)))
        for p, members in enumerate(layout):
            at = self.shells[members[0]][:, atoms[:, members[0]]]
            for a in members[1:]:  # atoms are taken as independent of each other
                other, joint = self.shells[a][:, atoms[:, a]], np.zeros_like(at)
                for d in range(self.most + 1):
                    for e in range(d + 1):
                        joint[d] += at[e] * other[d - e] / max(self.n, 1)
                at = joint
            probes = [len(self.masks(ATOM * len(members), d)) for d in range(self.most + 1)]
            out[p, 1:] = np.cumsum(at, 0) + np.cumsum(probes)[:, None]
        return out

    def thresholds(self, atoms: np.ndarray, layout) -> tuple[np.ndarray, np.ndarray]:
        """Cheapest thresholds of each fingerprint, and what they cost.

        Two fingerprints within ``most`` bits differ by at most t in some partition if the t + 1 of
        all partitions add up to ``most`` + 1.  Dynamic programming shares these units out.
        """
        costs, units = self.costs(atoms, layout), self.most + 1
        best = np.full((units + 1, len(atoms)), np.inf)
        best[0] = 0
        taken = np.zeros((len(layout), units + 1, len(atoms)), np.int64)
        for p in range(len(layout)):
            new = np.full_like(best, np.inf)
            for u in range(units + 1):
                for k in range(u + 1):
                    cost = best[u - k] + costs[p, k]
                    better = cost < new[u]
                    new[u] = np.where(better, cost, new[u])
                    taken[p, u] = np.where(better, k, taken[p, u])
            best = new
        left, out = np.full(len(atoms), units), np.zeros((len(layout), len(atoms)), np.int64)
        for p in reversed(range(len(layout))):
            k = taken[p, left, np.arange(len(atoms))]
            out[p], left = k - 1, left - k
        return out, best[units]

    def values(self, atoms: np.ndarray, members) -> np.ndarray:
        out = np.zeros(len(atoms), np.int64)
        for a in members:
            out = out << ATOM | atoms[:, a]
        return out


def probe_batches(plan: Plan):
    """Rows of the index (every fingerprint in every partition) and of the probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                prints = batch.column("print").slice(at, 8192)
                numbers, atoms = prints.to_numpy(zero_copy_only=False), atoms_of(prints, plan.groups)
                limits, _ = plan.thresholds(atoms, plan.layout)
                for p, members in enumerate(plan.layout):
                    value = plan.values(atoms, members)
                    yield rows(p, value, numbers, False)
                    for d in range(plan.most + 1):
                        some = np.flatnonzero(limits[p] >= d)
                        masks = plan.masks(ATOM * len(members), d)
                        step = max(1, 1_000_000 // len(masks))
                        for k in range(0, len(some), step):
                            here = some[k : k + step]
                            probes = (value[here][:, None] ^ masks[None, :]).ravel()
                            yield rows(p, probes, np.repeat(numbers[here], len(masks)), True)

    def rows(p, value, numbers, probe):
        n = len(value)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, p, np.int32)), pa.array(value), pa.array(numbers), pa.array(np.full(n, probe))],
            ["part", "value", "print", "probe"],
        )

    return run


def probing_plan(prints: DataFrame, most: int) -> Plan:
    """Statistics over all fingerprints: 64 x 64 counts of bits, then 4 x 65,536 counts of atoms.

    These tables are all that comes to the driver; their size does not depend on the data.
    """
    gram = np.zeros((BITS, BITS), np.int64)
    counted = prints.mapInArrow(gram_batches, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    for r in counted.collect():
        gram[r["i"], r["j"]] = gram[r["j"], r["i"]] = r["n"]
    n = prints.count()
    groups = correlated_groups(gram, n)
    cells = prints.mapInArrow(histogram_batches(groups), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counted = cells.toArrow()
    histogram = np.zeros(len(groups) << ATOM)
    histogram[counted["cell"].to_numpy()] = counted["n"].to_numpy()
    plan = Plan(groups, np.stack([shells(h, most) for h in histogram.reshape(len(groups), -1)]), n, most)
    sample = prints.orderBy(F.xxhash64("print")).limit(LAYOUT_SAMPLE).toArrow()["print"].combine_chunks()
    if len(sample):
        atoms = atoms_of(sample, groups)
        plan.layout = min(LAYOUTS, key=lambda x: plan.thresholds(atoms, x)[1].sum())
    return plan


def near_links(prints: DataFrame, most: int = 3) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that differ in 1 to ``most`` bits; pairs may repeat.

    ``prints`` has distinct values of ``print`` and is read several times, so it should be a table.
    """
    plan = probing_plan(prints, most)
    table = written(
        prints.mapInArrow(probe_batches(plan), "part int, value long, print long, probe boolean"), "probes"
    )
    index = table.filter("not probe").select("part", "value", F.col("print").alias("b"))
    probes = table.filter("probe").select("part", "value", F.col("print").alias("a"))
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)
    return probes.alias("p").join(
        index.alias("i"), (F.col("p.part") == F.col("i.part")) & (F.col("p.value") == F.col("i.value")) & near
    ).select("a", "b")


def near_groups(hashed: DataFrame, most: int = 3) -> DataFrame:
    """Components of fingerprints: one row (print, doc_id, keeper) for each distinct fingerprint.

    ``hashed`` has doc_id and print and is read several times.  doc_id is the smallest of the
    component and keeper the fingerprint of that document.  Copies share a fingerprint and are
    collapsed before anything is joined.  Documents without an id count last.
    """
    prints = written(hashed.groupBy("print").agg(F.min("doc_id").alias("doc_id")), "prints")
    roots = components(near_links(prints.select("print"), most)).withColumnRenamed("node", "print")
    rooted = written(prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")), "rooted")
    smallest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "print"))
    keepers = rooted.groupBy("root").agg(smallest.alias("k"))
    return rooted.select("print", "root").join(keepers, "root").select(
        "print", F.col("k.doc_id").alias("doc_id"), F.col("k.print").alias("keeper")
    )


def near_copies(docs: DataFrame, most: int = 3) -> DataFrame:
    """Fingerprint of each document and the smallest doc_id that near links lead to.

    Returns doc_id, print (signed) and component_id, one row per row of ``docs``.  Documents with null
    or empty texts share fingerprint 0 and are linked like any others; rows may repeat; documents
    without an id get the component of their text.  An empty table gives no rows.
    """
    hashed = written(fingerprints(docs.select("doc_id", "text")).select("doc_id", "print"), "hashed")
    # a table, so that the join below can be split where a fingerprint has many copies
    groups = written(near_groups(hashed, most).select("print", F.col("doc_id").alias("component_id")), "groups")
    return hashed.join(groups, "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame, most: int = 3) -> DataFrame:
    """One document of each component, with its columns: the first by doc_id, once if it repeats."""

    hashed = written(fingerprints(docs), "hashed")
    keepers = written(near_groups(hashed.select("doc_id", "print"), most).select("doc_id", F.col("keeper").alias("print")).distinct(), "keepers")
    once = Window.partitionBy("doc_id", "print").orderBy("text")
    same = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("d.print") == F.col("k.print"))
    return (
        hashed.alias("d").join(keepers.alias("k"), same, "left_semi")
        .withColumn("nth", F.row_number().over(once))
        .filter("nth = 1")
        .select(*docs.columns)
    )
