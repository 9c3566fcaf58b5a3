"""Languages of documents and of the spans inside them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.columns import distinct, row_lengths, starts_of, sums, text_slices
from logloom.session import written

UNKNOWN = "und"
LAST_HASH = 2**63 - 1
#: First and last code points of scripts; letters elsewhere are of script "other".
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
WORD = r"([^\pL\pM]+)"
LETTER = r"\pL"  # marks alone are no word
GRAM = 3
#: A script counts for a language if it writes this share of the language's sampled words.
SCRIPT_SHARE = 0.01
SMOOTHING = 0.5


@dataclass
class LanguageModel:
    """Log probabilities of letter groups by language, and the scripts of each language."""

    languages: list[str]
    scores: dict[str, np.ndarray]  # letter group -> score for each language
    unseen: np.ndarray
    scripts: dict[int, np.ndarray]  # script -> which languages it can be


def script_of(codes: np.ndarray) -> np.ndarray:
    """Number of the script of each code point; the count of scripts for any other."""
    out = np.full(len(codes), len(SCRIPTS), np.int64)
    for k, ranges in enumerate(SCRIPTS.values()):
        for first, last in ranges:
            out[(codes >= first) & (codes <= last)] = k
    return out


def bounded_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """At most ``per_language`` different labelled texts of each language, those of smallest hash.

    Hashes are counted by language; as they are uniform, a share of their range holds the smallest
    ones, and only that share, of about ``2 * per_language`` hashes whatever the size of the
    language, is ranked.  The texts of the chosen hashes are then read.
    """
    keyed = docs.select("text", "lang", F.xxhash64("text").alias("key")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    different = written(keyed.select("lang", "key").distinct(), "keys")
    sizes = different.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language, as in the model
    if not sizes:
        return keyed.limit(0)
    beyond = lambda n: min(LAST_HASH, -LAST_HASH + (2 * LAST_HASH * (2 * per_language + 100)) // n)
    low = F.element_at(F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], beyond(r["n"]))]), F.col("lang"))
    first = Window.partitionBy("lang").orderBy("key")
    chosen = (
        different.filter(F.col("key") <= low)
        .withColumn("nth", F.row_number().over(first))
        .filter(F.col("nth") <= per_language)
        .groupBy("lang")
        .agg(F.max("key").alias("last"))
        .collect()
    )
    if not chosen:
        return keyed.limit(0)
    last = F.create_map(*[F.lit(x) for r in chosen for x in (r["lang"], r["last"])])
    return keyed.filter(F.col("key") <= F.element_at(last, F.col("lang"))).dropDuplicates(["lang", "key"])


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: w != "")


def learn(docs: DataFrame, per_language: int = 1000) -> LanguageModel:
    """Learn letter groups from a bounded sample of labelled texts.

    ``docs`` has text and lang.  ``per_language`` bounds the sample, and so the tables that come to
    the driver.  Without labelled texts the model has no language and every text is undetermined.
    """
    words = (
        bounded_sample(docs, per_language)
        .select("lang", F.explode(words_of(F.col("text"))).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    padded = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(padded) - (GRAM - 1), F.lit(1))),
        lambda k: F.substring(padded, k, F.lit(GRAM)),
    )
    counts = words.select("lang", "n", F.explode(grams).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    languages: dict[str, int] = {}
    table: dict[str, dict[int, int]] = {}
    for r in counts.orderBy("lang", "gram").collect():
        k = languages.setdefault(r["lang"], len(languages))
        table.setdefault(r["gram"], {})[k] = r["n"]
    seen = np.zeros((len(languages), len(SCRIPTS) + 1))
    for gram, row in table.items():
        if gram[0] == "<":  # the beginning of a word tells its script
            script = script_of(np.array([ord(gram[1])]))[0]
            for k, n in row.items():
                seen[k, script] += n
    totals = np.full(len(languages), SMOOTHING * (len(table) + 1))
    for row in table.values():
        for k, n in row.items():
            totals[k] += n
    scores = {}
    for gram, row in table.items():
        n = np.full(len(languages), SMOOTHING)
        n[list(row)] += list(row.values())
        scores[gram] = np.log(n / totals).astype(np.float32)
    share = seen / np.maximum(seen.sum(1, keepdims=True), 1)
    scripts = {k: share[:, k] >= SCRIPT_SHARE for k in range(len(SCRIPTS) + 1)}
    return LanguageModel(list(languages), scores, np.log(SMOOTHING / totals).astype(np.float32), scripts)


class WordScores:
    """Scores of words by language, relative to the best language of each word."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self.grams = pa.array(list(model.scores), pa.large_string())
        self.table = np.array([*model.scores.values(), model.unseen], np.float32)
        # a letter group of 21-bit code points fits one number
        keys = [self.packed(g) for g in model.scores]
        self.order = np.argsort(np.array(keys, np.uint64), kind="stable")
        self.keys = np.array(keys, np.uint64)[self.order]

    @staticmethod
    def packed(gram: str) -> int:
        out = 0
        for c in gram.ljust(GRAM, "\0"):
            out = out << 21 | ord(c)
        return out

    def __call__(self, words: pa.Array) -> np.ndarray:
        """Mean score of the letter groups of each word, times the root of their number."""
        texts = words.to_pylist()
        padded = "".join([f"<{w}>" for w in texts])
        codes = np.frombuffer(padded.encode("utf-32-le"), "<u4").astype(np.uint64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
        starts = starts_of(lengths)
        grams = codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        row = np.where(self.keys[at] == grams, self.order[at], len(self.keys))
        inside = np.ones(len(codes), bool)  # groups that don't reach over the end of their word
        inside[starts + lengths - 1] = inside[starts + lengths - 2] = False
        row = np.append(row, [0, 0])
        total = np.stack(
            [sums(np.where(inside, self.table[row, k], 0).astype(np.float64), lengths) for k in range(self.table.shape[1])], 1
        )
        allowed = np.array([self.model.scripts[s] for s in range(len(SCRIPTS) + 1)])
        script = script_of(codes[starts + 1].astype(np.int64))
        may = allowed[script]
        may[~may.any(1)] = True  # a script that no language was seen in tells nothing
        total = np.where(may, total, -1e6)
        return (total - total.max(1, keepdims=True)).astype(np.float32)


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of the words of many texts, where each change of label costs ``penalty``.

    ``scores`` has a row for each word, text after text.  All texts advance together, one word a
    round, longest first, so a round is a few array operations whatever the number of texts.
    """
    order = np.argsort(-lengths, kind="stable")
    first, sizes = starts_of(lengths)[order], lengths[order]
    came = np.zeros(scores.shape, np.int16)  # label of the word before
    total = scores[first[sizes > 0]].copy()
    longest = int(sizes.max(initial=0))
    alive = np.searchsorted(-sizes, -np.arange(longest + 1), side="left")  # texts with more words than t
    ends = np.zeros((len(lengths), scores.shape[1]), np.float32)
    ends[: len(total)] = total
    own = np.arange(scores.shape[1], dtype=np.int16)
    for t in range(1, longest):
        n = alive[t]
        ends[n : len(total)] = total[n:]
        total = total[:n]
        best = total.argmax(1)
        switch = total[np.arange(n), best][:, None] - penalty
        stay = total >= switch
        words = first[:n] + t
        came[words] = np.where(stay, own[None, :], best[:, None])
        total = np.where(stay, total, switch) + scores[words]
        total -= total.max(1, keepdims=True)
    ends[: len(total)] = total
    labels = np.zeros(len(scores), np.int16)
    last = ends.argmax(1).astype(np.int16)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        words = first[:n] + t
        labels[words] = last[:n]
        last[:n] = came[words, last[:n]]
    return labels


def label_batches(model: LanguageModel, penalty: float):
    listed = [*model.languages, UNKNOWN]
    names = pa.array(listed, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = WordScores(model) if model.languages else None
        for batch, texts in text_slices(batches, most=8 << 20):
            lists = pc.split_pattern(pc.replace_substring_regex(pc.utf8_lower(texts), WORD, " "), " ")
            words, place = distinct(lists.flatten())
            real = pc.match_substring_regex(words, LETTER).to_numpy(zero_copy_only=False)
            keep = real[place]
            lengths = sums(keep.astype(np.int64), row_lengths(lists))
            found, place = place[keep], None
            if score is None or not len(found):
                label, share, spans = np.full(len(lengths), len(model.languages)), np.zeros(len(lengths)), [[]] * len(lengths)
            else:
                scores = np.zeros((len(words), len(model.languages)), np.float32)
                scores[real] = score(words.filter(pa.array(real)))
                size = pc.utf8_length(words).to_numpy().astype(np.float64)
                label, share, spans = decide(viterbi(scores[found], lengths, penalty), lengths, size[found], len(model.languages))
            kinds = pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64())]))
            rows = [[{"lang": listed[k], "first_word": a, "n_words": n} for k, a, n in row] for row in spans]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, names.take(pa.array(label)), pa.array(share, pa.float64()), pa.array(rows, kinds)],
                [*batch.schema.names, "lang_pred", "score", "spans"],
            )

    return run


def decide(labels: np.ndarray, lengths: np.ndarray, size: np.ndarray, n: int):
    """The language with the most letters, its share of the letters, and runs of one language."""
    text = np.repeat(np.arange(len(lengths)), lengths)
    letters = np.bincount(text * n + labels, size, len(lengths) * n).reshape(-1, n)
    label, total = letters.argmax(1), letters.sum(1)
    share = np.where(total > 0, letters.max(1) / np.maximum(total, 1), 0.0)
    starts = starts_of(lengths)
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(labels)))
    spans: list[list] = [[] for _ in lengths]
    for t, k, a, c in zip(text[begin].tolist(), labels[begin].tolist(), (begin - starts[text[begin]]).tolist(), count.tolist()):
        spans[t].append((k, a, c))
    return np.where(total > 0, label, n), share, spans


def label_languages(docs: DataFrame, model: LanguageModel, penalty: float = 12.0) -> DataFrame:
    """Label the words of each text with languages, and the text with that of most of its letters.

    The columns of ``docs`` come back, which must not hold lang_pred, score (the share of letters in
    that language) or spans array<struct<lang, first_word, n_words>>.  The script of a word narrows
    its candidates; letter groups score them; the Viterbi path pays ``penalty`` for each switch.

    Texts that are null or without letters are ``und`` with score 0, as is every text under a model
    without languages.  Only ``text`` is looked at; nothing is shuffled.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(
        label_batches(model, penalty),
        f"{fields}, lang_pred string, score double, spans array<struct<lang: string, first_word: long, n_words: long>>",
    )
