"""Fill-in-middle samples: texts cut at token ends into prefix, middle and suffix, and put in another order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.columns import text_slices

MARKS = ("<P>", "<S>", "<M>")
ANY_MARK = "<[PSM]>"

ONES = np.uint64(0x0101010101010101)
TOPS = np.uint64(0x8080808080808080)
LOWS = np.uint64(0x7F7F7F7F7F7F7F7F)
SPACES = np.uint64(0x2020202020202020)
#: Bytes of text at once; a few words of eight bytes are held for each.
SLICE_BYTES = 8 << 20


def as_words(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes as little-endian words of eight, filled up with at least one space."""
    whole = np.full(len(data) // 8 * 8 + 8, 0x20, np.uint8)
    whole[: len(data)] = data
    return whole.view("<u8")


def blank_bytes(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is 0x20 or in 0x09 to 0x0D; no carry leaves a byte."""
    low = words & LOWS
    away = words ^ SPACES
    space = ~(((away & LOWS) + LOWS) | away | LOWS)
    from_tab = low + ONES * np.uint64(0x80 - 0x09)
    beyond = low + ONES * np.uint64(0x80 - 0x0E)
    return space | (from_tab & ~beyond & ~words & TOPS)


def token_ends(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that is not blank and stands before a blank one."""
    blank = blank_bytes(words)
    following = blank >> np.uint64(8)
    following[:-1] |= blank[1:] << np.uint64(56)
    following[-1] |= np.uint64(1 << 63)
    return ~blank & following & TOPS


def first_bytes(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that begins a code point."""
    return ~(words & ~(words << np.uint64(1))) & TOPS


class Marks:
    """Rank and select over marked bytes: one count per word, and arithmetic inside it."""

    def __init__(self, flags: np.ndarray):
        self.flags = flags
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(flags), dtype=np.int64)])

    def rank(self, places: np.ndarray) -> np.ndarray:
        """Marks before each byte place."""
        word, byte = places >> 3, (places & 7).astype(np.uint64)
        part = self.flags[word] & ((np.uint64(1) << (byte * np.uint64(8))) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The byte place of the nth mark, from 1."""
        word = np.searchsorted(self.before, nth, side="left") - 1
        upto = (self.flags[word] >> np.uint64(7)) * ONES  # marks up to each byte of the word
        wanted = (nth - self.before[word]).astype(np.uint64) * ONES
        reached = ((upto | TOPS) - wanted) & TOPS
        return word * 8 + 8 - np.bitwise_count(reached)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of large-string texts, one after the other, and where each begins and the last ends."""
    _, offsets, data = texts.buffers()
    places = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[places[0] : places[-1]], places - places[0]


def cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n and the three parts of each text, cut after the smaller and the larger of first % (n+1), second % (n+1)."""
    for batch, texts in text_slices(batches, most=SLICE_BYTES):
        data, places = text_bytes(texts)
        words = as_words(data)
        flags = token_ends(words)
        full = places[1:] > places[:-1]
        last = places[1:][full] - 1  # a text ends a token, also a blank one
        np.bitwise_or.at(flags, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) * np.uint64(8)))
        ends = Marks(flags)
        begun = ends.rank(places)
        n = np.diff(begun)
        draws = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) % (n + 1) for c in ("first", "second")]
        cuts = []
        for k in (np.minimum(*draws), np.maximum(*draws)):
            at = places[:-1].copy()
            some = k > 0
            at[some] = ends.select(begun[:-1][some] + k[some]) + 1
            cuts.append(at)
        points = Marks(first_bytes(words))
        bounds = [places[:-1], *cuts, places[1:]]
        lengths = [points.rank(b) - points.rank(a) for a, b in zip(bounds, bounds[1:])]
        parts = pieces(data, bounds)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(n), *parts, pa.array(lengths[0]), pa.array(lengths[1]), batch.column("third"), batch.column("fourth")],
            ["doc_id", "n", "prefix", "middle", "suffix", "prefix_chars", "middle_chars", "third", "fourth"],
        )


def pieces(data: np.ndarray, bounds: list[np.ndarray]) -> list[pa.Array]:
    """Strings between neighbouring bounds, all out of one buffer."""
    edges = np.ascontiguousarray(np.stack(bounds, 1).ravel())
    whole = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    rows = np.arange(len(bounds[0])) * len(bounds)
    return [whole.take(pa.array(rows + k)).cast(pa.string()) for k in range(len(bounds) - 1)]


def draw(doc_id: Column, seed: int, nth: int) -> Column:
    """The nth group of eight digits of the sha256 of seed:id, as a number; a row without an id draws by ``seed:``."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digits, 8 * nth - 7, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 42, moved: int = 50, suffix_first: int = 80) -> DataFrame:
    """Fill-in-middle samples of whole texts.

    Tokens are words with the blanks before them; blanks at the end are one more.  Returns doc_id,
    text, n (tokens), form, prefix_chars and middle_chars (null if plain) and output.  ``moved`` in
    100 documents are cut twice at token ends, chosen by the hash of seed and doc_id, and of these
    ``suffix_first`` in 100 begin with the suffix (spm), the others with the prefix (psm).  An empty
    text, or one that holds a mark, stays plain.

    A null text is empty; a document of any length is one row; rows may repeat; an empty table gives
    no rows.  Nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    draws = {name: draw(F.col("doc_id"), seed, k + 1) for k, name in enumerate(("first", "second", "third", "fourth"))}
    cut = docs.select("doc_id", "text").select("doc_id", "text", *[c.alias(k) for k, c in draws.items()]).mapInArrow(
        cut_batches,
        f"doc_id {kind}, n long, prefix string, middle string, suffix string, prefix_chars long, middle_chars long, third long, fourth long",
    )
    text = F.concat("prefix", "middle", "suffix")
    plain = (text == "") | text.rlike(ANY_MARK) | (F.col("third") % 100 >= moved)
    form = F.when(plain, "plain").when(F.col("fourth") % 100 < suffix_first, "spm").otherwise("psm")
    mark = dict(zip("PSM", map(F.lit, MARKS)))
    told = cut.withColumns({"text": text, "form": form})
    of_form = lambda c: F.when(F.col("form") != "plain", F.col(c)).alias(c)
    return told.select(
        "doc_id", "text", "n", "form", of_form("prefix_chars"), of_form("middle_chars"),
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(mark["P"], "prefix", mark["S"], "suffix", mark["M"], "middle"))
        .otherwise(F.concat(mark["S"], "suffix", mark["P"], "prefix", mark["M"], "middle")).alias("output"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text of a sample, from its output and form alone."""
    part = lambda nth: F.get(F.split(output, ANY_MARK), nth)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part(1), part(3), part(2)))
        .otherwise(F.concat(part(2), part(3), part(1)))
    )


ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM documents),
numbers AS (
  SELECT *, len(units) AS n,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS d FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(units[greatest(a, b) + 1:], '') AS suffix,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 50 THEN 'plain'
      WHEN d < 80 THEN 'spm' ELSE 'psm' END AS form FROM numbers)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
