"""Encoding and decoding with a merge-type piece model, by score-ordered agendas."""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from logloom.llm.columns import distinct, glued, row_lengths, runs, starts_of, sums, text_slices

SPACE = "▁"
#: A symbol that Unicode keeps free; texts that hold it are cut in another way.
CUT = "\ufdd0"
NONE = np.int64(1 << 62)
#: Parts of up to so many symbols share tables of agendas; longer ones have a heap each.
TABLE_WIDTHS = (4, 8, 12, 16, 24, 32, 64)


class PieceModel:
    """The pieces and scores of a model file, and what follows from them."""

    def __init__(self, proto: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        lib, n = self.library, self.library.get_piece_size()
        self.names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) for i in range(n)]
        self.value = {i: int(self.names[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        self.byte = {b: i for i, b in self.value.items()}
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i]}
        self.symbol = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        # merges by their two halves, with the rank of the score (equal scores share a rank)
        ranks = {s: r for r, s in enumerate(sorted({lib.get_score(i) for i in self.ids.values()}, reverse=True))}
        self.merges: dict[int, int] = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                left, right = self.ids.get(p[:k]), self.ids.get(p[k:])
                if left is not None and right is not None:
                    self.merges[left << 32 | right] = ranks[lib.get_score(i)] << 20 | i
        self.keys = np.array(sorted(self.merges), np.int64)
        self.values = np.array([self.merges[k] for k in self.keys.tolist()], np.int64)
        self.classes = self.symbol_classes()
        self.spelling = pa.array(self.names, pa.large_string())
        self.is_byte = np.array([i in self.value for i in range(n)])

    def symbol_classes(self) -> list[list[str]]:
        """Symbols that pieces can span: of one class if some piece has them side by side, directly
        or by way of others.  Marks stand only before other symbols."""
        top: dict[str, str] = {}

        def root(c: str) -> str:
            while top.setdefault(c, c) != c:
                top[c] = c = top.setdefault(top[c], top[c])
            return c

        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces of this model span the start of a word")
        for a, b in {q[k : k + 2] for p in self.ids for q in (p.lstrip(SPACE),) for k in range(len(q) - 1)}:
            top[root(a)] = root(b)
        classes: dict[str, list[str]] = {}
        for c in top:
            classes.setdefault(root(c), []).append(c)
        return [sorted(c) for c in classes.values()]

    def cut(self, words: pa.Array) -> pa.LargeListArray:
        """Cut words into parts that no piece can span: marks, then symbols of one class."""
        spell = lambda form: ["[" + "".join(form.format(ord(c)) for c in s) + "]+" for s in self.classes]
        part = lambda form: f"{SPACE}*(?:{'|'.join([*spell(form), f'[^{SPACE}]'])})|{SPACE}+"
        return cut(words, f"(?s)({part('\\x{{{:x}}}')})", f"(?s){part('\\U{:08x}')}")

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and piece of the merge of each pair as one number; ``NONE`` where there is none."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(key), NONE)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def heap(self, ids: list[int]) -> list[int]:
        """Merge the best-scored neighbours, the leftmost of equals, until none are a piece."""
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def entry(left: int, right: int):
            found = merges.get(ids[left] << 32 | ids[right]) if ids[left] >= 0 <= ids[right] else None
            return None if found is None else (found >> 20, left, found & 0xFFFFF)

        agenda = [e for k in range(n - 1) if (e := entry(k, k + 1))]
        heapify(agenda)
        while agenda:
            best = heappop(agenda)
            left = best[1]
            right = after[left]
            # an entry is stale when one of its halves has grown or gone since
            if ids[left] == -2 or right >= n or entry(left, right) != best:
                continue
            ids[left], ids[right] = best[2], -2
            follow = after[left] = after[right]
            if follow < n:
                before[follow] = left
                if e := entry(left, follow):
                    heappush(agenda, e)
            if before[left] >= 0 and (e := entry(before[left], left)):
                heappush(agenda, e)
        return ids

    def table(self, ids: np.ndarray) -> np.ndarray:
        """The same for a table of short parts, one a row, filled up with -3.

        The agenda of a row is the row of its merges; each round takes the best of every row.
        """
        out = np.full_like(ids, -2)
        rows = np.arange(len(ids))
        merges = self.pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        columns = np.arange(ids.shape[1])
        while len(rows):
            # the rank decides, then the place: the first of equals is what argmin finds
            at = (merges >> 20).argmin(1)
            best = merges[np.arange(len(rows)), at]
            go = best < NONE
            if not go.all():
                out[rows[~go]] = ids[~go]
                rows, ids, merges, at, best = rows[go], ids[go], merges[go], at[go], best[go]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            gone = columns[None, :] > at[:, None]
            ids = np.where(gone, np.concatenate([ids[:, 1:], np.full((len(rows), 1), -3)], 1), ids)
            ids[each, at] = best & 0xFFFFF
            merges = np.where(gone[:, :-1], np.concatenate([merges[:, 1:], np.full((len(rows), 1), NONE)], 1), merges)
            left = np.maximum(at - 1, 0)
            merges[each, left] = np.where(at > 0, self.pairs(ids[each, left], ids[each, at]), merges[each, left])
            last = at >= ids.shape[1] - 1
            right = np.minimum(at + 1, ids.shape[1] - 1)
            here = np.minimum(at, merges.shape[1] - 1)
            merges[each, here] = np.where(last, merges[each, here], self.pairs(ids[each, at], ids[each, right]))
        return out

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts one after the other, and how many each has."""
        texts = parts.to_pylist()
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts, symbols = starts_of(lengths), self.symbol[codes]
        flat = np.full(len(codes), -2, np.int64)  # ids at their first symbols, -2 elsewhere
        low = 0
        for width in TABLE_WIDTHS:
            some = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            if len(some):
                table = np.full((len(some), max(width, 2)), -3, np.int64)
                row, column = np.repeat(np.arange(len(some)), lengths[some]), runs(np.zeros(len(some), np.int64), lengths[some])
                places = runs(starts[some], lengths[some])
                table[row, column] = symbols[places]
                table = self.table(table)
                flat[places] = table[row, column]
        for k in np.flatnonzero(lengths > low).tolist():
            one = slice(starts[k], starts[k] + lengths[k])
            flat[one] = self.heap(symbols[one].tolist())
        return self.close_up(flat, codes, lengths)

    def close_up(self, flat: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leave out the places of merged symbols and spell symbols without a piece in bytes."""
        kept = flat >= -1
        ids, counts = flat[kept], sums(kept.astype(np.int64), lengths)
        lost = np.flatnonzero(ids < 0)
        if not len(lost):
            return ids, counts
        # merges keep the order, so the lost symbols are those without a piece, one after the other
        spelled = [
            [self.byte[b] for b in chr(c).encode()] if self.byte else [self.library.unk_id()]
            for c in codes[self.symbol[codes] < 0].tolist()
        ]
        width = np.ones(len(ids), np.int64)
        width[lost] = [len(row) for row in spelled]
        out = np.repeat(ids, width)
        out[out < 0] = [i for row in spelled for i in row]
        return out, sums(width, counts)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of ids: spaces for marks, and runs of byte pieces as UTF-8."""
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]), pa.array(ids))
        texts = pc.replace_substring(glued(self.spelling.take(pa.array(ids)), lists), SPACE, " ")
        rows = np.flatnonzero(sums(self.is_byte[ids].astype(np.int64), counts))
        if not len(rows):
            return texts
        ends, spelled = np.cumsum(counts), []
        for k in rows.tolist():
            out, pending = [], bytearray()
            for i in ids[ends[k] - counts[k] : ends[k]].tolist():
                if i in self.value:
                    pending.append(self.value[i])
                else:
                    out += [bytes(pending).decode("utf-8", "replace"), self.names[i]]
                    pending.clear()
            out.append(bytes(pending).decode("utf-8", "replace"))
            spelled.append("".join(out).replace(SPACE, " "))
        mask = np.zeros(len(counts), bool)
        mask[rows] = True
        return pc.replace_with_mask(texts, pa.array(mask), pa.array(spelled, pa.large_string()))


def encode_words(model: PieceModel, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, int]:
    """Ids, counts and decoded text of distinct words (marks, then other symbols), checked in one batch.

    The library sees each word without its first mark, which it adds itself.  Where it disagrees its
    ids are taken, and the number of such words is returned.
    """
    lists = model.cut(words)
    parts, place = distinct(lists.values)
    ids, counts = model.encode_parts(parts)
    per_word = row_lengths(lists)
    word_ids = ids[runs(starts_of(counts)[place], counts[place])]
    word_counts = sums(counts[place], per_word)
    text = glued(model.decode(ids, counts).take(pa.array(place)), lists)
    checked = model.library.encode(
        pc.replace_substring(pc.utf8_slice_codeunits(words, 1), SPACE, " ").to_pylist(), num_threads=1
    )
    their_counts = np.fromiter(map(len, checked), np.int64, len(checked))
    theirs = np.fromiter(chain.from_iterable(checked), np.int64, int(their_counts.sum()))
    lone = pc.equal(words, SPACE).to_numpy(zero_copy_only=False)  # a mark that ends a text is no word for the library
    if np.array_equal(their_counts[~lone], word_counts[~lone]) and np.array_equal(
        theirs, word_ids[~np.repeat(lone, word_counts)]
    ):
        return word_ids, word_counts, text, 0
    ends, mine, corrected = np.cumsum(word_counts), [], 0
    for k, row in enumerate(checked):
        own = word_ids[ends[k] - word_counts[k] : ends[k]].tolist()
        corrected += own != row and not lone[k]
        mine.append(own if lone[k] else row)
    counts = np.fromiter(map(len, mine), np.int64, len(mine))
    ids = np.fromiter(chain.from_iterable(mine), np.int64, int(counts.sum()))
    return ids, counts, model.decode(ids, counts), corrected


def cut(texts: pa.Array, pattern: str, python_pattern: str) -> pa.LargeListArray:
    """All matches of a pattern that leaves nothing out, for each text; an empty text has none."""
    if not pc.any(pc.match_substring(texts, CUT)).as_py():
        marked = pc.replace_substring_regex(texts, pattern, f"{CUT}\\1")
        return after_first(pc.split_pattern(marked, CUT))
    found = [re.findall(python_pattern, t) for t in texts.to_pylist()]
    lengths = np.array([len(row) for row in found], np.int64)
    values = pa.array([p for row in found for p in row], pa.large_string())
    return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]), values)


def after_first(lists: pa.Array) -> pa.LargeListArray:
    """Lists without their first items: what stands before the first mark is empty."""
    values, lengths = lists.flatten(), row_lengths(lists)
    keep = np.ones(len(values), bool)
    keep[starts_of(lengths)[lengths > 0]] = False
    lengths = np.maximum(lengths - 1, 0)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    return pa.LargeListArray.from_arrays(offsets, values.filter(pa.array(keep)))


#: Bytes of text at once: ids, words and decoded text of a slice take many times as much.
SLICE_BYTES = 12 << 20


def encode_batches(proto: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(proto)
        mark = pa.scalar(SPACE, pa.large_string())
        for batch, texts in text_slices(batches, most=SLICE_BYTES):
            full = pc.binary_length(texts).to_numpy() > 0  # an empty text gets no first mark
            marked = pc.if_else(
                pa.array(full),
                pc.replace_substring(pc.binary_join_element_wise(mark, texts, pa.scalar("", pa.large_string())), " ", SPACE),
                texts,
            )
            if pc.any(pc.match_substring(marked, 2 * SPACE)).as_py():
                lists = cut(marked, f"({SPACE}+[^{SPACE}]*)", f"{SPACE}+[^{SPACE}]*")
                words, place = distinct(lists.values)
            else:  # every mark begins a word
                lists = after_first(pc.split_pattern(marked, SPACE))
                words, place = distinct(lists.values)
                words = pc.binary_join_element_wise(mark, words, pa.scalar("", pa.large_string()))
            ids, counts, decoded, corrected = encode_words(model, words)
            all_ids = ids[runs(starts_of(counts)[place], counts[place])].astype(np.int32)
            text = glued(decoded.take(pa.array(place)), lists)
            row_counts = sums(counts[place], row_lengths(lists))
            yield record(batch, all_ids, row_counts, pc.utf8_slice_codeunits(text, 1), corrected)

    return run


def record(batch, ids, counts, text, corrected) -> pa.RecordBatch:
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            batch.column("doc_id"),
            pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())),
            text.cast(pa.string()),
            pa.array(np.full(batch.num_rows, corrected)),
        ],
        ["doc_id", "ids", "decoded", "corrected"],
    )


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Encode and decode every text with the piece model in the file ``model``.

    Returns doc_id, ids array<int>, decoded string and corrected: the words of the row's batch for
    which the agenda and the library disagreed (the library's ids are then taken; none so far).

    Texts are cut into words and words into parts that no piece can span; each distinct part of a
    slice goes through the agenda once, and each distinct word is compared with the library.  A null
    text is empty and has no ids; rows may repeat; an empty table gives no rows.  Nothing is shuffled.
    """
    with open(model, "rb") as file:
        proto = file.read()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        encode_batches(proto), f"doc_id {kind}, ids array<int>, decoded string, corrected long"
    )
