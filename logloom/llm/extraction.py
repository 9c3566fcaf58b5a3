"""Main text of web pages: a recurrent network labels every block in the context of its whole page."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.blocks import Paths, leaf_blocks
from logloom.llm.columns import text_slices
from logloom.llm.layouts import sample_page

#: Slots of the hashed names and words, and the width of their vectors and of each direction's state.
NAME_SLOTS, WORD_SLOTS, NAME_WIDTH, WORD_WIDTH, STATE = 2048, 1024, 16, 8, 16
NUMBERS = 6
#: Bytes of HTML at once, and blocks (with those that fill up shorter pages) that are labelled at once.
SLICE_BYTES, SLOTS = 4 << 20, 1 << 16


class Blocks(NamedTuple):
    """Blocks of pages, page after page: hashed names and words in runs, and some measures of each."""

    names: np.ndarray
    n_names: np.ndarray
    words: np.ndarray
    n_words: np.ndarray
    numbers: np.ndarray
    lengths: np.ndarray  # blocks of each page


def slot(name: str, slots: int) -> int:
    return crc32(name.encode("utf-8", "replace")) % slots


class WordSlots(dict):
    """The slot of each word met so far."""

    def __missing__(self, word: str) -> int:
        found = self[word] = slot(word, WORD_SLOTS)
        return found


def measure(text: str, words: list[str], linked: int) -> list[float]:
    return [
        np.log1p(len(text)) / 8, np.log1p(len(words)) / 6, min(linked / len(text), 1.0), float(text[-1] in ".!?:;…»”\"'。"),
        (len(text) + 1) / len(words) / 10, sum(map(text.count, ".,;")) / len(words),
    ]


def page_blocks(pages: list[list[tuple[str, int, int]]], paths: Paths) -> Blocks:
    """Everything the network reads of the blocks of ``leaf_blocks``; every word of a block counts."""
    by_set = [np.array(sorted({slot(n, NAME_SLOTS) for n in names}), np.int32) for names in paths.sets]
    names, words, n_words, numbers, known = [], [], [], [], WordSlots()
    for page in pages:
        for text, at, linked in page:
            split = text.lower().split(" ")
            names.append(by_set[at])
            words.extend(map(known.__getitem__, split))
            n_words.append(len(split))
            numbers.append(measure(text, split, linked))
    return Blocks(
        np.concatenate(names) if names else np.zeros(0, np.int32), np.array([len(n) for n in names], np.int64),
        np.array(words, np.int32), np.array(n_words, np.int64),
        np.array(numbers, np.float32).reshape(-1, NUMBERS), np.array([len(p) for p in pages], np.int64),
    )


def run_sums(vectors: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; zero for an empty run."""
    out = np.zeros((len(runs), vectors.shape[1]), np.float32)
    some = runs > 0
    if some.any():
        out[some] = np.add.reduceat(vectors, (np.cumsum(runs) - runs)[some], axis=0)
    return out


def first_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    width = NAME_WIDTH + WORD_WIDTH + NUMBERS
    normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    weights = {"names": normal(NAME_SLOTS, NAME_WIDTH, scale=0.1), "words": normal(WORD_SLOTS, WORD_WIDTH, scale=0.1)}
    for way in ("ahead", "back"):
        weights[way] = normal(width + STATE, 4 * STATE, scale=(width + STATE) ** -0.5)
        weights[f"{way}_bias"] = np.repeat(np.array([0, 1, 0, 0], np.float32), STATE)  # gates: in, keep, out, new
    weights["out"] = normal(width + 2 * STATE, 1, scale=0.1)
    weights["out_bias"] = np.zeros(1, np.float32)
    return weights


def read(weights: dict[str, np.ndarray], blocks: Blocks) -> np.ndarray:
    """The vector of each block: the sum over names of its path, the mean over its words, the measures."""
    of_names = run_sums(weights["names"][blocks.names], blocks.n_names)
    of_words = run_sums(weights["words"][blocks.words], blocks.n_words) / np.maximum(blocks.n_words, 1)[:, None]
    return np.concatenate([of_names, of_words.astype(np.float32), blocks.numbers], 1)


def squash(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def step(gates: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, ...]:
    opened = squash(gates[:, : 3 * STATE])
    new = np.tanh(gates[:, 3 * STATE :])
    i, f, o = opened[:, :STATE], opened[:, STATE : 2 * STATE], opened[:, 2 * STATE :]
    cell = f * cell + i * new
    return i, f, o, new, cell, np.tanh(cell)


def states(x: np.ndarray, present: np.ndarray, w: np.ndarray, bias: np.ndarray, ahead: bool, tape: list | None = None) -> np.ndarray:
    """The state after each block of (block, page, width) input; pages that have ended or not begun keep theirs."""
    count, pages, _ = x.shape
    hidden, cell = np.zeros((pages, STATE), np.float32), np.zeros((pages, STATE), np.float32)
    out = np.empty((count, pages, STATE), np.float32)
    for t in range(count) if ahead else range(count - 1, -1, -1):
        seen = np.concatenate([x[t], hidden], 1)
        i, f, o, new, grown, shown = step(seen @ w + bias, cell)
        here = present[t][:, None]
        if tape is not None:
            tape.append((t, seen, i, f, o, new, cell, shown, here))
        hidden, cell = np.where(here, o * shown, hidden), np.where(here, grown, cell)
        out[t] = hidden
    return out


def back_through(tape: list, above: np.ndarray, w: np.ndarray, d_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the weights and the bias; those of the input are added to ``d_x``."""
    d_w, d_bias = np.zeros_like(w), np.zeros(4 * STATE, np.float32)
    d_hidden = np.zeros(above.shape[1:], np.float32)
    d_cell = np.zeros_like(d_hidden)
    width = d_x.shape[2]
    for t, seen, i, f, o, new, cell, shown, here in reversed(tape):
        d_hidden += above[t]
        d_h, kept_h, kept_c = np.where(here, d_hidden, 0), np.where(here, 0, d_hidden), np.where(here, 0, d_cell)
        d_c = np.where(here, d_cell, 0) + d_h * o * (1 - shown * shown)
        gates = np.concatenate(
            [d_c * new * i * (1 - i), d_c * cell * f * (1 - f), d_h * shown * o * (1 - o), d_c * i * (1 - new * new)], 1
        )
        d_w += seen.T @ gates
        d_bias += gates.sum(0)
        d_seen = gates @ w.T
        d_x[t] += d_seen[:, :width]
        d_hidden, d_cell = kept_h + d_seen[:, width:], kept_c + d_c * f
    return d_w, d_bias


def padded(vectors: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(block, page, width) input, which of it is there, and the flat place of each block in it."""
    pages = len(lengths)
    page = np.repeat(np.arange(pages), lengths)
    nth = np.arange(len(page)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = nth * pages + page
    longest = int(lengths.max(initial=0))
    x = np.zeros((longest * pages, vectors.shape[1]), np.float32)
    present = np.zeros(longest * pages, bool)
    x[place], present[place] = vectors, True
    return x.reshape(longest, pages, -1), present.reshape(longest, pages), place


def scores(weights: dict[str, np.ndarray], vectors: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log odds that each block is main text; pages of like length go together."""
    out = np.zeros(len(vectors), np.float32)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    begin = 0
    while begin < len(order):
        end = begin + 1
        while end < len(order) and (end + 1 - begin) * lengths[order[end]] <= SLOTS:
            end += 1
        group, begin = order[begin:end], end
        rows = np.concatenate([np.arange(starts[p], starts[p] + lengths[p]) for p in group])
        x, present, place = padded(vectors[rows], lengths[group])
        told = [states(x, present, weights[w], weights[f"{w}_bias"], w == "ahead").reshape(-1, STATE)[place] for w in ("ahead", "back")]
        out[rows] = (np.concatenate([vectors[rows], *told], 1) @ weights["out"] + weights["out_bias"])[:, 0]
    return out


def gradients(weights: dict[str, np.ndarray], blocks: Blocks, wanted: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy of the pages' blocks and its gradient for every weight."""
    vectors = read(weights, blocks)
    x, present, place = padded(vectors, blocks.lengths)
    tapes = {"ahead": [], "back": []}
    hidden = {w: states(x, present, weights[w], weights[f"{w}_bias"], w == "ahead", tapes[w]) for w in tapes}
    shown = np.concatenate([vectors, *(hidden[w].reshape(-1, STATE)[place] for w in tapes)], 1)
    odds = (shown @ weights["out"] + weights["out_bias"])[:, 0]
    loss = float(np.mean(np.logaddexp(0, odds) - wanted * odds))
    d_odds = ((squash(odds) - wanted) / len(odds)).astype(np.float32)[:, None]
    found = {"out": shown.T @ d_odds, "out_bias": d_odds.sum(0)}
    d_shown = d_odds @ weights["out"].T
    width = vectors.shape[1]
    d_x = np.zeros_like(x)
    for k, w in enumerate(tapes):
        above = np.zeros((x.shape[0] * x.shape[1], STATE), np.float32)
        above[place] = d_shown[:, width + k * STATE : width + (k + 1) * STATE]
        found[w], found[f"{w}_bias"] = back_through(tapes[w], above.reshape(*x.shape[:2], STATE), weights[w], d_x)
    d_vectors = d_shown[:, :width] + d_x.reshape(-1, width)[place]
    for table, slots, runs, part in (
        ("names", blocks.names, blocks.n_names, d_vectors[:, :NAME_WIDTH]),
        ("words", blocks.words, blocks.n_words, d_vectors[:, NAME_WIDTH : NAME_WIDTH + WORD_WIDTH] / np.maximum(blocks.n_words, 1)[:, None]),
    ):
        found[table] = np.zeros_like(weights[table])
        np.add.at(found[table], slots, np.repeat(part, runs, axis=0).astype(np.float32))
    return loss, found


def forgetful(blocks: Blocks, rng: np.random.Generator, names: float = 0.1, words: float = 0.3) -> Blocks:
    """The blocks without a share of their names and words, so that no single one decides."""
    keep_n, keep_w = rng.random(len(blocks.names)) >= names, rng.random(len(blocks.words)) >= words
    count = lambda keep, runs: np.bincount(np.repeat(np.arange(len(runs)), runs)[keep], minlength=len(runs))
    return blocks._replace(
        names=blocks.names[keep_n], n_names=count(keep_n, blocks.n_names), words=blocks.words[keep_w], n_words=count(keep_w, blocks.n_words)
    )


@lru_cache(maxsize=2)
def trained(pages: int = 900, rounds: int = 6, batch: int = 30, seed: int = 13) -> dict[str, np.ndarray]:
    """The network after ``rounds`` passes over ``pages`` drawn pages whose blocks are labelled.

    The pages come from the layouts of ``sample_page``, not from any table, so the network is the same
    for every input and every run; Adam with a falling rate.
    """
    rng = np.random.default_rng(seed)
    weights = first_weights(rng)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in weights.items()}
    groups = []
    for _ in range(-(-pages // batch)):
        paths, drawn = Paths(), [sample_page(rng) for _ in range(batch)]
        groups.append((page_blocks([leaf_blocks(h, paths) for h, _ in drawn], paths), np.concatenate([l for _, l in drawn]).astype(np.float32)))
    total, nth = rounds * len(groups), 0
    for _ in range(rounds):
        for k in rng.permutation(len(groups)):
            blocks, wanted = groups[k]
            _, slopes = gradients(weights, forgetful(blocks, rng), wanted)
            size = np.sqrt(sum(float((s * s).sum()) for s in slopes.values()))
            nth += 1
            rate = 0.015 * (1 - 0.9 * nth / total)
            for name, slope in slopes.items():
                slope = slope / max(1.0, size)
                m, v = moments[name]
                m += 0.1 * (slope - m)
                v += 0.005 * (slope * slope - v)
                weights[name] -= rate * (m / (1 - 0.9**nth)) / (np.sqrt(v / (1 - 0.995**nth)) + 1e-8)
    return weights


def main_blocks(weights: dict[str, np.ndarray], pages: list[str | None]) -> list[tuple[list[str], int]]:
    """The texts of the blocks of main text of each page, and the number of its blocks."""
    paths = Paths()
    leaves = [leaf_blocks(html, paths) for html in pages]
    blocks = page_blocks(leaves, paths)
    keep = scores(weights, read(weights, blocks), blocks.lengths) > 0
    parts = np.split(keep, np.cumsum(blocks.lengths)[:-1]) if len(pages) else []
    return [([text for (text, _, _), k in zip(page, part) if k], len(page)) for page, part in zip(leaves, parts)]


def extract_batches(weights: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, html in text_slices(batches, "html", SLICE_BYTES):
            found = main_blocks(weights, html.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(["\n".join(texts) for texts, _ in found], pa.string()),
                    pa.array([n for _, n in found], pa.int64()), pa.array([len(texts) for texts, _ in found], pa.int64()),
                ],
                ["page_id", "url", "text", "n_blocks", "n_kept"],
            )

    return run


def extract_text(pages: DataFrame) -> DataFrame:
    """The main text of every page, from its whole html.

    Every block of a page is read with all its words and labelled by a bidirectional LSTM that has seen
    the whole page; blocks of main text are joined by a line break.  Returns page_id, url, text,
    n_blocks and n_kept.  Null, empty and blank html has no blocks and the text ""; broken markup loses
    no text; rows may repeat; an empty table gives no rows.  Nothing is shuffled; the network (about
    200 KB) is trained on the driver from drawn pages, whatever the table.
    """
    kind = lambda c: pages.schema[c].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        extract_batches(trained()), f"page_id {kind('page_id')}, url {kind('url')}, text string, n_blocks long, n_kept long"
    )
