"""Token counts under a unigram model, with forward scores shared by common prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from logloom.llm.columns import distinct, row_lengths, starts_of, sums, text_slices

SPACE = "▁"
#: Pre-tokens: marks with the letters, or with the other symbols, that follow them.
PRETOKEN = f"({SPACE}*(?:\\pL+|[^\\pL{SPACE}]+)|{SPACE}+)"
CUT = "﷐"


def zipf_scores(proto: bytes) -> dict[str, float]:
    """Log probabilities of the pieces of a model file, by Zipf's law over their order in the file.

    The files hold merges, whose scores are ranks; nothing is trained on the corpus.
    """
    lib = sentencepiece.SentencePieceProcessor(model_proto=proto)
    ids = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i))]
    total = math.log(sum(1 / (r + 2) for r in range(len(ids))))
    return {lib.id_to_piece(i): -math.log(r + 2) - total for r, i in enumerate(ids)}


class UnigramTries:
    """The pieces in a trie, against which tries of pre-tokens are scored."""

    def __init__(self, scores: dict[str, float]):
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - 10.0  # for each byte of a symbol without a piece
        states, keys, final = {"": 0}, {}, [-np.inf]
        for piece, score in scores.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in states:
                    states[piece[:k]] = len(final)
                    keys[states[piece[: k - 1]] << 21 | ord(piece[k - 1])] = len(final)
                    final.append(-np.inf)
            final[states[piece]] = score
        self.score = np.array([*final, -np.inf])  # the last state is the dead one
        self.dead = len(final)
        self.keys = np.array(sorted(keys), np.int64)
        self.targets = np.array([keys[k] for k in self.keys.tolist()], np.int64)

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(states), self.dead)
        live = np.flatnonzero(states != self.dead)
        if len(live) and len(self.keys):
            key = states[live] << 21 | codes[live]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[live] = np.where(self.keys[at] == key, self.targets[at], self.dead)
        return out

    def counts(self, words: pa.Array) -> np.ndarray:
        """Tokens of the best segmentation of each distinct word; of equal scores the one of fewer tokens.

        The words' trie grows level by level: in sorted order the words below a node stand together, so
        a node is where parent or symbol change.  The forward step of a node looks back at most as
        many levels as the longest piece has symbols, and is done once for all words below the node.
        """
        order = pc.sort_indices(words).to_numpy().astype(np.int64)
        texts = words.take(pa.array(order)).to_pylist()
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4").astype(np.int64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        starts, out = starts_of(lengths), np.zeros(len(texts), np.int64)
        alive, node = np.arange(len(texts)), np.zeros(len(texts), np.int64)
        # of each node of a level, by levels back: best score, tokens, state of the piece begun there
        best, tokens, states = [np.zeros(1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        depth = 0
        while True:
            stays = lengths[alive] > depth
            done = alive[~stays]
            out[order[done]] = tokens[0][node[~stays]]
            alive, node = alive[stays], node[stays]
            if not len(alive):
                return out
            symbol = codes[starts[alive] + depth]
            new = np.ones(len(alive), bool)
            new[1:] = (node[1:] != node[:-1]) | (symbol[1:] != symbol[:-1])
            parent, c = node[new], symbol[new]
            node, depth = np.cumsum(new) - 1, depth + 1
            best = [b[parent] for b in best[: self.longest]]
            tokens = [t[parent] for t in tokens[: self.longest]]
            states = [self.step(s[parent], c) for s in states[: self.longest]]
            top, n = np.full(len(c), -np.inf), np.zeros(len(c), np.int64)
            for b, t, s in zip(best, tokens, states):
                top, n = better(top, n, b + self.score[s], t + 1)
            lost = np.flatnonzero(np.isneginf(self.score[states[0]]))  # no piece for the symbol itself
            if len(lost):
                size = 1 + (c[lost] > 0x7F) + (c[lost] > 0x7FF) + (c[lost] > 0xFFFF)
                top[lost], n[lost] = better(top[lost], n[lost], best[0][lost] + size * self.unknown, tokens[0][lost] + size)
            best, tokens, states = [top, *best], [n, *tokens], [np.zeros(len(c), np.int64), *states]


def better(score, tokens, other, other_tokens):
    take = (other > score) | ((other == score) & (other_tokens < tokens))
    return np.where(take, other, score), np.where(take, other_tokens, tokens)


def count_batches(scores: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries, mark = UnigramTries(scores), pa.scalar(SPACE, pa.large_string())
        for batch, texts in text_slices(batches):
            lists = pc.utf8_split_whitespace(texts)
            chunks, place = distinct(lists.flatten())
            # a symbol that Unicode keeps free parts the pre-tokens, and itself belongs to none
            marked = pc.replace_substring_regex(
                pc.binary_join_element_wise(mark, chunks, pa.scalar("", pa.large_string())), PRETOKEN, f"\\1{CUT}"
            )
            parts = pc.split_pattern(marked, CUT)
            words, word_place = distinct(parts.flatten())
            real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
            counts = np.zeros(len(words), np.int64)
            counts[real] = tries.counts(words.filter(pa.array(real)))
            per_chunk = row_lengths(parts)
            full = pc.not_equal(chunks, "").to_numpy(zero_copy_only=False)
            chunk_words = np.where(full, sums(real[word_place].astype(np.int64), per_chunk), 0)
            chunk_tokens = np.where(full, sums(counts[word_place], per_chunk), 0)
            lengths = row_lengths(lists)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sums(chunk_words[place], lengths)),
                    pa.array(sums(chunk_tokens[place], lengths)),
                ],
                ["doc_id", "n_pretokens", "n_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """Pre-tokens and unigram tokens of each text, with the pieces in the file ``model``.

    Returns doc_id, n_pretokens and n_tokens.  White space becomes marks before words; runs of letters
    and of other symbols are pre-tokens.  The distinct pre-tokens of a slice go into a trie, and the
    forward step at a node serves every word with that prefix.

    A null or empty text has none of either; rows may repeat; an empty table gives no rows.  Nothing
    is shuffled.
    """
    with open(model, "rb") as file:
        scores = zipf_scores(file.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        count_batches(scores), f"doc_id {kind}, n_pretokens long, n_tokens long"
    )
