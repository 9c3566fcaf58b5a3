"""Packing token pieces into sequences by minimum bin slack."""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm.columns import distinct, row_lengths, runs, starts_of, sums, text_slices
from logloom.session import written

#: Letters and digits of Latin text; texts with other symbols are left to the library as a whole.
LETTERS, DIGITS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ", "0-9²³¹¼-¾"
NOT_SIMPLE = "[^ \\t\\n\\r!-~¡-įı-ɏ‐-‧‰-⁞€]|<[|]"
WORD = f"('s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^ {LETTERS}{DIGITS}]+)"


#: Bytes of text at once.
SLICE_BYTES = 8 << 20


#: Longest word, in bytes, that is merged here; longer ones are left to the library.
LONGEST = 48


def byte_symbols() -> list[str]:
    """The symbol of each byte in byte-level vocabularies: itself if it prints, else one past the Latin letters."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in prints else next(others)) for b in range(256)]


class Merges:
    """Pair merges of a byte-level vocabulary with word ends, for many words of one length at once."""

    def __init__(self, model: dict):
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[s] for s in byte_symbols()], np.int64)
        self.last = np.array([vocabulary[s + end] for s in byte_symbols()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.size = max(vocabulary.values()) + 1
        keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        self.never = len(pairs)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """When a pair is merged; ``never`` if it isn't."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.never)

    def merge(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of words given as rows of symbols, in order: the first pair of the least rank is merged
        until none is left.  Every word that goes on gets one symbol shorter in each round."""
        n, width = symbols.shape
        out, counts, rows = np.zeros((n, width), np.int64), np.ones(n, np.int64), np.arange(n)
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while True:
            done = ranks.min(axis=1, initial=self.never) == self.never
            out[rows[done], : symbols.shape[1]] = symbols[done]
            counts[rows[done]] = symbols.shape[1]
            rows, symbols, ranks = rows[~done], symbols[~done], ranks[~done]
            if not len(rows):
                return out[np.arange(width) < counts[:, None]], counts
            at, each = ranks.argmin(axis=1), np.arange(len(rows))
            new = self.made[ranks[each, at]]
            left = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, left + (left > at[:, None]), 1)
            symbols[each, at] = new
            pairs = np.arange(symbols.shape[1] - 1)
            ranks = np.take_along_axis(ranks, pairs + (pairs >= at[:, None]), 1)
            for side, some in ((at - 1, at > 0), (at, at < symbols.shape[1] - 1)):
                k, p = each[some], side[some]
                ranks[k, p] = self.rank(symbols[k, p], symbols[k, p + 1])

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of large-string words of at most ``LONGEST`` bytes."""
        lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        _, offsets, data = words.buffers()
        places = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words)]
        text = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        counts, found = np.zeros(len(words), np.int64), []
        order = np.argsort(lengths, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []
        for group in groups:
            width = int(lengths[group[0]])
            letters = text[places[group][:, None] + np.arange(width)]
            symbols = np.concatenate([self.inner[letters[:, :-1]], self.last[letters[:, -1:]]], 1)
            ids, counts[group] = self.merge(symbols)
            found.append(ids)
        sorted_ids, sorted_counts = np.concatenate([np.zeros(0, np.int64), *found]), counts[order]
        back = np.empty(len(order), np.int64)
        back[order] = starts_of(sorted_counts)
        return sorted_ids[runs(back, counts)].astype("<u4"), counts


class Ids:
    """Ids of texts as the tokenizers library gives them; each distinct word of a slice is merged once."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.merges = Merges(json.loads(tokenizer.to_str())["model"])

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each has."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum())), counts

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words."""
        long = pc.greater(pc.binary_length(words), LONGEST)
        if not pc.any(long).as_py():
            return self.merges.words(words)
        far = long.to_numpy(zero_copy_only=False)
        counts = np.zeros(len(words), np.int64)
        near_ids, counts[~far] = self.merges.words(words.filter(pc.invert(long)))
        far_ids, counts[far] = self.library(words.filter(long).to_pylist())
        starts = np.where(far, len(near_ids), 0)
        starts[~far] += starts_of(counts[~far])
        starts[far] += starts_of(counts[far])
        return np.concatenate([near_ids, far_ids])[runs(starts, counts)], counts

    def chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks without blanks: lower-cased and split as the library does."""
        lowered = pc.replace_substring_regex(pc.utf8_lower(chunks), WORD, "\\1 ")
        parts = pc.ascii_split_whitespace(lowered)
        words, place = distinct(parts.flatten().cast(pa.large_string()))
        keep = pc.not_equal(words, "").to_numpy(zero_copy_only=False)[place]
        per_chunk = sums(keep.astype(np.int64), row_lengths(parts))
        place = place[keep]
        ids, counts = self.words(words)
        return ids[runs(starts_of(counts)[place], counts[place])], sums(counts[place], per_chunk)

    def simple(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that the library would lower-case and split as is done here."""
        lists = pc.ascii_split_whitespace(texts)
        chunks, place = distinct(lists.flatten())
        ids, counts = self.chunks(chunks)
        row_counts = sums(counts[place], row_lengths(lists))
        return ids[runs(starts_of(counts)[place], counts[place])], row_counts

    def texts(self, texts: pa.Array) -> list[np.ndarray]:
        odd = pc.match_substring_regex(texts, NOT_SIMPLE)
        rows = odd.to_numpy(zero_copy_only=False)
        out: list[np.ndarray] = [np.zeros(0, "<u4")] * len(texts)
        for where, (ids, counts) in (
            (np.flatnonzero(~rows), self.simple(texts.filter(pc.invert(odd)))),
            (np.flatnonzero(rows), self.library(texts.filter(odd).to_pylist())),
        ):
            for k, row in zip(where.tolist(), np.split(ids, np.cumsum(counts)[:-1])):
                out[k] = row
        return out


def piece_batches(vocabulary: bytes, most: int, end_id: int):
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        ids = Ids(Tokenizer.from_buffer(vocabulary))
        for batch, texts in text_slices(batches, most=SLICE_BYTES):
            rows = []
            for k, tokens in enumerate(ids.texts(texts)):
                tokens = np.concatenate([tokens, end])
                for piece, start in enumerate(range(0, len(tokens), most)):
                    part = tokens[start : start + most]
                    rows.append((k, piece, start, len(part), zlib.crc32(part.astype("<u4").tobytes())))
            k, *columns = (np.array(c, np.int64) for c in zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(k)), *(pa.array(c) for c in columns)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def token_pieces(docs: DataFrame, vocabulary: str, most: int, end_id: int = 1) -> DataFrame:
    """Ids of each text and an end id, cut into pieces of at most ``most`` ids: one row per piece.

    Returns doc_id, piece, start, length and ids_crc32.  A null text is empty: its one piece is the
    end id.  Rows may repeat; an empty table gives no rows; nothing is shuffled.
    """
    with open(vocabulary, "rb") as file:
        content = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return (
        docs.select("doc_id", "text")
        .mapInArrow(
            piece_batches(content, most, end_id),
            f"doc_id {kind}, piece long, start long, length long, ids_crc32 long",
        )
        .withColumn("piece", F.col("piece").cast("int"))
    )


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths with the largest sum of at most ``room``, each used at most as often as it is there.

    Sums that can be reached are bits of one integer.  Lengths are added from the longest until the
    room can be filled exactly; walking back through the stored bitsets finds the lengths used.
    """
    reach, mask, trail = 1, (1 << room + 1) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1].tolist():
        many, step = min(int(counts[length]), room // length), 1
        while many:
            step = min(step, many)
            trail.append((length, step, reach))
            reach |= reach << length * step & mask
            many, step = many - step, 2 * step
        if reach >> room:
            break
    at, used = reach.bit_length() - 1, []
    for length, step, before in reversed(trail):
        if not before >> at & 1:
            at -= length * step
            used += [length] * step
    return used


def slack_layout(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Where the r-th piece of each length goes, from the number of pieces of each length.

    Each bin takes the longest length left and the fullest combination for what room remains; the
    same combination is repeated while its lengths last.  At most one row per length and pattern:
    (length, first rank, pieces per bin, first bin, offset of the first in its bin).
    """
    left = np.zeros(room + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    taken, rows, bins = np.zeros(room + 1, np.int64), [], 0
    longest = room
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return rows
        left[longest] -= 1
        pattern = [longest, *fullest(left, room - longest)]
        left[longest] += 1
        lengths, per = np.unique(pattern, return_counts=True)
        times, offset = int((left[lengths] // per).min()), 0
        for length, k in zip(lengths.tolist(), per.tolist()):
            rows.append((length, int(taken[length]), k, bins, offset))
            offset += length * k
        taken[lengths] += per * times
        left[lengths] -= per * times
        bins += times


def place_batches(layout: np.ndarray, columns: list[str]):
    """Look the rank of each piece up in the layout."""
    width = 1 << 42
    order = np.lexsort((layout[:, 1], layout[:, 0]))
    length, rank_from, per_bin, first_bin, first_offset = layout[order].T
    keys = length * width + rank_from

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, size * width + rank, side="right") - 1
            beyond = rank - rank_from[at]
            bins = first_bin[at] + beyond // per_bin[at]
            offset = first_offset[at] + beyond % per_bin[at] * size
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(bins), pa.array(offset)],
                [*columns, "sequence_id", "offset"],
            )

    return run


def pack_pieces(pieces: DataFrame, room: int = 4096) -> DataFrame:
    """Give each piece a sequence of at most ``room`` ids and an offset in it.

    ``pieces`` has doc_id, piece and length.  The driver sees the number of pieces of each length (at
    most ``room`` numbers) and lays out bins by minimum bin slack; the layout says where the r-th
    piece of a length goes and has at most as many rows as lengths and patterns, whatever the number
    of pieces.  Ranks come from counts of (block, length) and positions inside a block, so a length
    that a third of all pieces share is not ranked by one task.
    """
    stored = written(pieces.withColumn("block", F.spark_partition_id()), "pieces")
    sizes = stored.groupBy("block", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    layout = np.array(slack_layout(counts, room), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranked"))
    inside = Window.partitionBy("block", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        stored.withColumn("inside", F.row_number().over(inside) - 1)
        .join(offsets, ["block", "length"])
        .withColumn("rank", F.col("ranked") + F.col("inside"))
    )
    columns = [c for c in pieces.columns]
    fields = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, "rank").mapInArrow(
        place_batches(layout, columns), f"{fields}, sequence_id long, offset long"
    )
