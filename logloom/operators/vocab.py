"""Vocabularies, encoding, masking and padding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.order import index_rows, line_block

# The special tokens and their ids.
SPECIALS = ("<pad>", "<unk>", "<eos>", "<sos>", "<mask>")
PAD, UNK, EOS, SOS, MASK = range(5)


def build_vocab(
    tokens: DataFrame, token: str = "token", min_freq: int = 1, max_size: int | None = None
) -> DataFrame:
    """``(token, idx, freq)``: the specials first, then tokens by falling frequency and by name.

    Only the distinct tokens are ranked, in blocks by frequency and the head of the token.
    """
    counts = (
        tokens.filter(~F.col(token).isin(*SPECIALS) & (F.col(token) != ""))
        .groupBy(F.col(token).alias("token"))
        .agg(F.count(F.lit(1)).alias("freq"))
        .filter(F.col("freq") >= max(min_freq, 1))
    )
    ranked = index_rows(
        counts,
        [F.desc("freq"), F.col("token")],
        [-F.col("freq"), F.substring("token", 1, 3)],
        name="_index",
    )
    if max_size is not None:
        ranked = ranked.filter(F.col("_index") < max_size)
    words = ranked.select("token", (F.col("_index") + len(SPECIALS)).alias("idx"), "freq")
    heads = tokens.sparkSession.createDataFrame(
        [(s, i, 0) for i, s in enumerate(SPECIALS)], "token string, idx long, freq long"
    )
    return heads.unionByName(words)


def extend_vocab(vocab: DataFrame, other: DataFrame, sort: bool = True) -> DataFrame:
    """Append the tokens of ``other`` that are new, after the highest id; old ids stay."""
    fresh = other.join(vocab.select("token"), "token", "left_anti")
    order = [F.col("token")] if sort else [F.col("idx")]
    blocks = [F.substring("token", 1, 3)] if sort else [line_block("idx")]
    top = vocab.agg(F.max("idx").alias("m")).scalar()
    added = index_rows(fresh, order, blocks, name="_index").select(
        "token", (F.col("_index") + top + 1).alias("idx"), "freq"
    )
    return vocab.select("token", "idx", "freq").unionByName(added)


def encode_rows(rows: DataFrame, vocab: DataFrame, event: str = "event") -> DataFrame:
    """Add ``idx`` to each row of a long sequence table, ``<unk>`` for unknown tokens.

    A join, so the vocabulary may have any size; Spark broadcasts it when it measures small.
    """
    words = vocab.select(F.col("token").alias(event), "idx")
    return rows.join(words, event, "left").withColumn("idx", F.coalesce("idx", F.lit(UNK).cast("long")))


def encode_arrays(
    chunks: DataFrame,
    vocab: DataFrame,
    key: Sequence[str],
    events: str = "events",
    seq_len: int | None = None,
    with_eos: bool = False,
    with_sos: bool = False,
) -> DataFrame:
    """``ids`` and the length before padding of each sequence; <eos> goes last, then <sos> first."""
    places = chunks.select(*key, F.posexplode(events).alias("pos", "event"))
    rows = F.array_sort(F.collect_list(F.struct("pos", "idx")))
    ids = encode_rows(places, vocab).groupBy(*key).agg(rows.alias("_rows"))
    out = F.col("_rows.idx")
    if with_eos:
        out = F.concat(out, F.array(F.lit(EOS).cast("long")))
    if with_sos:
        out = F.concat(F.array(F.lit(SOS).cast("long")), out)
    coded = ids.select(*key, out.alias("ids")).withColumn("length", F.size("ids"))
    return coded if seq_len is None else coded.withColumn("ids", pad_to("ids", F.lit(seq_len)))


def pad_to(ids: Column | str, length: Column, pad=None) -> Column:
    """Cut or fill an array to ``length``."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    pad = F.lit(PAD).cast("long") if pad is None else pad
    return F.slice(F.concat(ids, F.array_repeat(pad, F.greatest(F.lit(0), length - F.size(ids)))), F.lit(1), length)


def decode_rows(rows: DataFrame, vocab: DataFrame, drop_pads: bool = False) -> DataFrame:
    """Token of each id; an id outside the vocabulary is written ``<id>``."""
    kept = rows.filter(F.col("idx") != PAD) if drop_pads else rows
    unknown = F.concat(F.lit("<"), F.col("idx").cast("string"), F.lit(">"))
    return kept.join(vocab.select("idx", "token"), "idx", "left").withColumn(
        "token", F.coalesce("token", unknown)
    )


# --- masking -----------------------------------------------------------------------------------

_HEX_SPAN = 16**8


def _hex_bound(share: float) -> str:
    return f"{min(int(share * _HEX_SPAN), _HEX_SPAN - 1):08x}"


def mask_rows(
    rows: DataFrame,
    ratio: float,
    vocab_size: Column | int | None = None,
    seed: int = 31,
    predict: bool = True,
    seq: str = "seq_id",
) -> DataFrame:
    """Masked input and labels per position of a long table with ``idx`` and ``dt``.

    A position is masked when the first 8 hex digits of ``md5(seed|seq|pos)`` fall below ``ratio``.
    In prediction every masked position becomes ``<mask>``; in training 80 % do, 10 % become a
    random id and 10 % stay.  Labels are the true ids at masked positions, 0 elsewhere.
    """
    draw = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(seq), F.col("pos").cast("string"))), 1, 8)
    masked = F.col("_draw") < _hex_bound(ratio)
    mask = F.lit(MASK).cast("long")
    if predict:
        shown = mask
    else:
        size = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
        other = F.conv(
            F.substring(F.md5(F.concat_ws("|", F.lit(f"{seed}r"), F.col(seq), F.col("pos").cast("string"))), 1, 8), 16, 10
        ).cast("long") % size
        shown = (
            F.when(F.col("_draw") < _hex_bound(ratio * 0.8), mask)
            .when(F.col("_draw") < _hex_bound(ratio * 0.9), other)
            .otherwise(F.col("idx"))
        )
    zero = F.lit(0).cast("long")
    return (
        rows.withColumn("_draw", draw)
        .withColumn("bert_input", F.when(masked, shown).otherwise(F.col("idx")))
        .withColumn("bert_label", F.when(masked, F.col("idx")).otherwise(zero))
        .withColumn("time_input", F.when(masked, F.lit(0.0)).otherwise(F.col("dt")))
        .withColumn("time_label", F.when(masked, F.col("dt")).otherwise(F.lit(0.0)))
        .drop("_draw")
    )


def model_samples(masked: DataFrame, keys: Sequence[str] = ("seq_id",)) -> DataFrame:
    """Arrays per sequence with ``<sos>`` in front (label 0, time 0)."""
    names = ("bert_input", "bert_label", "time_input", "time_label")
    rows = F.array_sort(F.collect_list(F.struct("pos", *names)))
    heads = {
        "bert_input": F.lit(SOS).cast("long"),
        "bert_label": F.lit(PAD).cast("long"),
        "time_input": F.lit(0.0),
        "time_label": F.lit(0.0),
    }
    grouped = masked.groupBy(*keys).agg(rows.alias("_rows"))
    return grouped.select(
        *keys, *[F.concat(F.array(heads[n]), F.col(f"_rows.{n}")).alias(n) for n in names]
    )


def pad_batches(samples: DataFrame, batch: str, seq_len: int | None = None) -> DataFrame:
    """Pad or cut every array to the longest of its batch, ``seq_len`` at the most."""
    longest = samples.groupBy(batch).agg(F.max(F.size("bert_input")).alias("_length"))
    sized = samples.join(longest, batch)
    if seq_len is not None:
        sized = sized.withColumn("_length", F.least(F.lit(seq_len), "_length"))
    return sized.withColumns(
        {
            n: pad_to(n, F.col("_length"), F.lit(0.0) if n.startswith("time") else None)
            for n in ("bert_input", "bert_label", "time_input", "time_label")
        }
    ).drop("_length")


# --- other id maps -----------------------------------------------------------------------------


def next_label_index(windows: DataFrame, order: Sequence[str], label: str = "next") -> DataFrame:
    """Ids of next-event labels: ``#OOV`` 0, ``#Pad`` 1, the others from 2 by first appearance.

    ``#Pad`` takes part in the order of appearance, so the id of its place stays unused.
    """
    first = windows.groupBy(F.col(label).alias("label")).agg(
        F.min(F.struct(*[F.col(c) for c in order])).alias("_first")
    )
    keys = [F.col(f"_first.{c}") for c in order]
    # Blocks by the first order column keep the ranking of many labels out of one task.
    ranked = index_rows(first, keys, [keys[0]], name="_index")
    idx = F.when(F.col("label") == "#Pad", 1).when(F.col("label") == "#OOV", 0).otherwise(F.col("_index") + 2)
    return ranked.select("label", idx.cast("long").alias("idx"))


def rank_templates(catalogue: DataFrame) -> DataFrame:
    """Template number from 1 by falling occurrences, ties by id."""
    return index_rows(
        catalogue,
        [F.desc("Occurrences"), F.col("EventId")],
        [-F.col("Occurrences"), F.substring("EventId", 1, 2)],
        name="_index",
    ).select("EventId", "Occurrences", (F.col("_index") + 1).alias("rank"))
