"""Message templates: mining, assignment and parameters.

Both miners keep, of each message, its most widely shared words and turn the others into fields.  How
widely a word is shared is counted over the distinct messages of the log: at its place in its leaf
for the position miner, anywhere for the subsequence miner.  A message keeps the words that are
shared at least as widely as the last of the ``threshold`` share that it has to keep; a message that
would have to keep a word of its own is its own template.

The rules have no order: the line numbers, the partitions and the size of the log's pieces don't
matter, only the set of distinct messages.  Everything is grouped and joined on hashes, leaves and
words.  The position miner moves packed cells, one a part; the subsequence miner writes its tables of
counts, so that a join can be split where a word is frequent.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions.text import WILDCARD, template_id, tokenize
from logloom.session import shuffles_dropped, written

#: Bytes and words (eight bytes each) of the messages with one number of words that a task may mine at
#: once.  It decides speed and disk only: more are mined in parts, with the same templates.
TASK_BYTES = 32 << 20
#: Bytes of messages that are packed in one row.
PACK_BYTES = 1 << 20
#: Places of a word whose cells go to one group.
PLACES = 64


def distinct_messages(log: DataFrame, message: Column) -> DataFrame:
    """``message`` and ``key``, one row for each text that occurs; null texts have no template."""
    found = log.select(message.alias("message")).filter(F.col("message").isNotNull()).distinct()
    return found.withColumn("key", F.md5("message"))


def head_leaves(heads: DataFrame, depth: int, max_child: int) -> DataFrame:
    """``n, head, leaf`` of ``n, head, messages``: the number of words, then the branches of the first ``depth - 3``.

    A word with a digit goes to the wildcard branch, and so does one that fewer than one in ``max_child``
    messages of its node begin with; no node has more branches of its own than that.
    """
    placed = heads.withColumn("leaf", F.col("n").cast("string"))
    for step in range(depth - 3):
        placed = placed.withColumn("branch", F.get(F.split("head", " "), F.lit(step)))
        branches = placed.groupBy("leaf", "branch").agg(F.sum("messages").alias("in_branch"))
        nodes = branches.groupBy("leaf").agg(F.sum("in_branch").alias("in_node"))
        wide = branches.join(nodes, "leaf").filter(F.col("in_branch") * max_child >= F.col("in_node"))
        wide = written(wide.select("leaf", "branch", F.col("branch").alias("own")), "branches")
        leaf = F.concat_ws(" ", "leaf", F.coalesce("own", F.lit(WILDCARD)))
        placed = placed.join(wide, ["leaf", "branch"], "left").withColumn("leaf", leaf).drop("branch", "own")
    return placed.select("n", "head", "leaf")


def shared_words(cells: DataFrame, support: DataFrame, keys: list[str], threshold: float, n: Column) -> DataFrame:
    """``key, parts, cut``: the words of a message with their support, in order, and the least support
    of the words it keeps.  Words that are wildcards already have none."""
    counted = cells.join(support, keys).select(
        "key", F.struct("at", "word", F.when(F.col("word") == WILDCARD, 0).otherwise(F.col("support")).alias("support")).alias("part")
    )
    parts = counted.groupBy("key").agg(F.sort_array(F.collect_list("part")).alias("parts"))  # words of one message
    last = F.greatest(F.lit(1), F.ceil(F.lit(float(threshold)) * n)).cast("int") - 1
    widest = F.sort_array(F.col("parts.support"), asc=False)
    return parts.withColumn("cut", F.coalesce(F.get(widest, last), F.lit(0)))


def mine_templates_by_position(
    log: DataFrame, text: Column, depth: int = 4, threshold: float = 0.4, max_child: int = 100
) -> DataFrame:
    """``message → template`` from words at their places, ``text`` being the masked message.

    Messages of one leaf have equal numbers of words.  Messages too short to reach a leaf and blank
    ones are their own templates, with single blanks between words.

    Messages with equal numbers of words meet in one task if they are few enough; those of more frequent
    lengths are dealt out to as many tasks as they need, which count their cells together.
    """
    rows = log.select(text.alias("message")).filter(F.col("message").isNotNull()).withColumn("words", tokenize("message"))
    rows = rows.withColumn("n", F.size("words"))
    weight = F.octet_length("message") + 8 * F.col("n")
    frequent = rows.groupBy("n").agg(F.sum(weight).alias("weight")).filter(F.col("weight") > TASK_BYTES)
    parts = F.ceil(F.col("weight") * 4 / max(1, TASK_BYTES)).alias("parts")  # room for what comes from the others
    frequent = written(frequent.select("n", parts), "lengths")
    head = F.transform(F.slice("words", 1, max(0, depth - 3)), branch_of)
    plain = F.array_join("words", " ")
    columns = ["n", "message", F.when(plain != F.col("message"), plain).alias("plain"), F.array_join(head, " ").alias("head")]
    few = rows.join(frequent, "n", "left_anti").select(*columns)
    mined = few.groupBy("n").applyInArrow(mine_length(depth, threshold, max_child), "message string, template string")
    part = F.pmod(F.xxhash64("message"), F.col("parts")).alias("part")
    many = rows.join(frequent, "n").select(*columns, "parts", part)
    return mined.union(mine_in_parts(many, depth, threshold, max_child)) if frequent.count() else mined


def branch_of(word: Column) -> Column:
    return F.when(word.rlike(r"(?U)\d"), WILDCARD).otherwise(word)


def mine_length(depth: int, threshold: float, max_child: int):
    """Templates of all messages with one number of words; ``head`` has the branches of their first words."""

    def run(table: pa.Table) -> pa.Table:
        message, plain, head = distinct_rows(table)
        n = table["n"][0].as_py()
        if n < max(1, depth - 2):
            return pa.table({"message": message, "template": plain})
        leaf = np.zeros(len(plain), np.int64)
        heads = [h.split(" ") for h in head.to_pylist()]
        for step in range(depth - 3):
            branches, at = np.unique([h[step] for h in heads], return_inverse=True)
            node, in_node = np.unique(leaf, return_inverse=True, return_counts=True)[1:]
            own, each, in_branch = np.unique(node * len(branches) + at, return_inverse=True, return_counts=True)
            wide = (in_branch[each] * max_child >= in_node[node]) & (branches[at] != WILDCARD)
            leaf = node * (len(branches) + 1) + np.where(wide, at, len(branches))
        leaves, leaf = np.unique(leaf, return_inverse=True)
        words, codes = coded_words(plain, n)
        _, cell, counts = message_cells(codes, len(words), leaf, len(leaves))
        return pa.table({"message": message, "template": masked_messages(plain, words, codes, counts, cell, threshold)})

    return run


def distinct_rows(table: pa.Table) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Message, message with single blanks and head of each message that occurs."""
    first = table.group_by("message").aggregate([("plain", "min"), ("head", "min")])
    message = first["message"].combine_chunks()
    return message, pc.coalesce(first["plain_min"].combine_chunks(), message), first["head_min"].combine_chunks()


def coded_words(plain: pa.Array, n: int) -> tuple[pa.Array, np.ndarray]:
    """The words in order, and a row of ``n`` places among them for each message."""
    words, places = in_order(pc.split_pattern(plain, " ").flatten())
    return words, places.reshape(-1, n)


def in_order(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct texts in order, and the place of each text among them."""
    coded = texts.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return coded.dictionary.take(pa.array(order)), place[coded.indices.to_numpy()]


def message_cells(codes: np.ndarray, words: int, leaf: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct cells (word, leaf and place in one number) in order, the cell of each word, and messages a cell."""
    n = codes.shape[1]
    cells = codes.astype(np.int64) * (leaves * n)
    cells += leaf.astype(np.int64)[:, None] * n + np.arange(n)
    cells = cells.ravel()
    order = np.argsort(cells)
    cells = cells[order]
    new = np.append(True, cells[1:] != cells[:-1])
    cell = np.empty(len(order), np.int32)
    cell[order] = np.cumsum(new, dtype=np.int32) - 1
    first = np.flatnonzero(new)
    return cells[first], cell.reshape(codes.shape), np.diff(first, append=len(order))


def masked_messages(
    plain: pa.Array, words: pa.Array, codes: np.ndarray, counts: np.ndarray, cell: np.ndarray, threshold: float
) -> pa.Array:
    """The messages with the words that are shared less widely than the last they have to keep as fields."""
    n = codes.shape[1]
    support = counts.astype(np.min_scalar_type(counts.max()))[cell]
    support[codes == pc.index(words, WILDCARD).as_py()] = 0
    last = max(1, math.ceil(float(threshold) * n)) - 1
    cut = np.partition(support, n - 1 - last, axis=1)[:, n - 1 - last] if last < n else np.zeros(len(plain), np.int64)
    shared = np.flatnonzero(cut > 1)
    kept = np.where(support[shared] >= cut[shared, None], codes[shared], np.int32(len(words))).ravel()
    texts = pa.concat_arrays([words, pa.array([WILDCARD], words.type)]).take(pa.array(kept))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(shared) + 1, dtype=np.int32) * n), texts)
    return pc.replace_with_mask(plain, pa.array(cut > 1), pc.binary_join(lists, " "))


def mine_in_parts(rows: DataFrame, depth: int, threshold: float, max_child: int) -> DataFrame:
    """The same for lengths with any number of messages, of which each task has the ones that hash to its ``part``.

    A part's messages are written packed.  Its cells go out once each, with the number of its messages that
    have them, to one of as many groups as the length has parts, and the number in the other parts comes back.
    """
    parts = rows.groupBy("n", "part").applyInArrow(
        pack_part, "n int, part long, parts long, heads array<string>, messages array<long>, data binary"
    )
    with shuffles_dropped(rows.sparkSession):
        parts = written(parts, "parts")
    same = [F.col("n").alias("length"), F.col("part").alias("piece")]  # names of their own, as cogroup asks for
    each = F.explode(F.arrays_zip("heads", "messages")).alias("each")
    heads = parts.filter(F.col("n") >= max(1, depth - 2)).select(*same, each).select(
        "length", "piece", F.col("each.heads").alias("head"), F.col("each.messages").alias("messages")
    )
    whole = heads.groupBy(F.col("length").alias("n"), "head").agg(F.sum("messages").alias("messages"))
    leaves = written(head_leaves(whole, depth, max_child), "leaves").withColumnRenamed("n", "length")
    placed = heads.join(leaves, ["length", "head"]).select("length", "piece", "head", "leaf")
    packed = parts.select("n", "part", "parts", "data").groupBy("n", "part")
    cells = packed.cogroup(placed.groupBy("length", "piece")).applyInArrow(
        part_cells, "n int, part long, group int, cells binary"
    )
    others = cells.groupBy("n", "group").applyInArrow(count_others, "length int, piece long, group int, others binary")
    with shuffles_dropped(rows.sparkSession):
        others = written(others, "cells")
    found = placed.unionByName(others, allowMissingColumns=True)
    return packed.cogroup(found.groupBy("length", "piece")).applyInArrow(
        mine_part(threshold), "message string, template string"
    )


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
    with pa.ipc.new_stream(sink, table.schema, options=options) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpacked(column: pa.ChunkedArray) -> list[pa.Table]:
    return [pa.ipc.open_stream(cell.as_buffer()).read_all() for chunk in column.chunks for cell in chunk]


def packed_lists(**lists: pa.Array | np.ndarray) -> bytes:
    """Lists of any lengths in one row; numbers, none below 0, as narrow as they can be."""
    narrow = lambda x: pa.array(x.astype(np.min_scalar_type(x.max()))) if isinstance(x, np.ndarray) else x
    row = {name: narrow(x) for name, x in lists.items()}
    return packed_table(pa.table({name: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for name, x in row.items()}))


def unpacked_lists(column: pa.ChunkedArray) -> list[dict[str, pa.Array]]:
    return [{name: t[name].combine_chunks().flatten() for name in t.column_names} for t in unpacked(column)]


def pack_part(table: pa.Table) -> pa.Table:
    """The distinct messages of a part in rows of ``PACK_BYTES``, and with the first row how many have each head."""
    message, plain, head = distinct_rows(table)
    own = pa.table({"message": message, "plain": pc.if_else(pc.equal(plain, message), pa.scalar(None, plain.type), plain), "head": head}).sort_by("message")
    row = np.cumsum(pc.binary_length(own["message"]).to_numpy().astype(np.int64)) // PACK_BYTES
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    ends = np.append(starts[1:], len(row))
    each = pc.value_counts(head)
    later = [None] * (len(starts) - 1)
    same = lambda name: pa.array([table[name][0].as_py()] * len(starts), table.schema.field(name).type)
    return pa.table({
        "n": same("n"), "part": same("part"), "parts": same("parts"),
        "heads": pa.array([each.field("values").to_pylist(), *later], pa.list_(pa.string())),
        "messages": pa.array([each.field("counts").to_pylist(), *later], pa.list_(pa.int64())),
        "data": pa.array([packed_table(own.slice(a, b - a)) for a, b in zip(starts, ends)], pa.binary()),
    })


def placed_part(packed: pa.Table, placed: pa.Table):
    """A part's messages with single blanks or not; its words, their places and the leaves; and its cells, the cell of
    each word, messages a cell and the group of each cell, -1 for wildcards: in the same order at each call."""
    n, parts = packed["n"][0].as_py(), packed["parts"][0].as_py()
    own = pa.concat_tables(unpacked(packed["data"]))
    message = own["message"].combine_chunks()
    plain = pc.coalesce(own["plain"].combine_chunks(), message)
    leaves, leaf = in_order(placed["leaf"].combine_chunks())
    leaf = leaf[pc.index_in(own["head"].combine_chunks(), placed["head"].combine_chunks()).to_numpy()]
    words, codes = coded_words(plain, n)
    cells, cell, counts = message_cells(codes, len(words), leaf, len(leaves))
    word, at = cells // (len(leaves) * n), cells % n
    hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False))[word]
    mixed = hashes + (at // PLACES).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) % np.uint64(parts)
    group = np.where(word == pc.index(words, WILDCARD).as_py(), -1, mixed.astype(np.int64))
    return message, plain, words, codes, leaves, cells, cell, counts, group


def part_cells(packed: pa.Table, placed: pa.Table) -> pa.Table:
    """The cells of a part, one row a group: each word with the number of its cells, then these."""
    out = {"n": [], "part": [], "group": [], "cells": []}
    if len(placed):
        _, _, words, codes, leaves, cells, _, counts, group = placed_part(packed, placed)
        n = codes.shape[1]
        order = np.argsort(group, kind="stable")
        for of in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            if group[of[0]] >= 0:
                word, leaf = cells[of] // (len(leaves) * n), cells[of] // n % len(leaves)
                first = np.flatnonzero(np.diff(word, prepend=-1))
                used, leaf = np.unique(leaf, return_inverse=True)
                out["group"].append(group[of[0]])
                out["cells"].append(packed_lists(
                    words=words.take(pa.array(word[first])), cells=np.diff(np.append(first, len(of))),
                    leaves=leaves.take(pa.array(used)), leaf=leaf, at=cells[of] % n, messages=counts[of],
                ))
        out["n"], out["part"] = ([packed[name][0].as_py()] * len(out["group"]) for name in ("n", "part"))
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))})


def count_others(table: pa.Table) -> pa.Table:
    """For the cells of each part, how many messages of the other parts have them."""
    lists = unpacked_lists(table["cells"])
    joined = lambda name: np.concatenate([x[name].to_numpy().astype(np.int64) for x in lists])
    words, word = in_order(pa.concat_arrays([x["words"] for x in lists]))
    leaves, leaf = in_order(pa.concat_arrays([x["leaves"] for x in lists]))
    sizes = [len(x["at"]) for x in lists]
    before = np.cumsum([0] + [len(x["leaves"]) for x in lists[:-1]])
    at, messages = joined("at"), joined("messages")
    leaf = leaf[joined("leaf") + np.repeat(before, sizes)]
    key = (np.repeat(word.astype(np.int64), joined("cells")) * len(leaves) + leaf) * (at.max() + 1) + at
    _, cell = np.unique(key, return_inverse=True)
    total = np.zeros(cell.max() + 1, np.int64)
    np.add.at(total, cell, messages)
    others = [packed_lists(others=x) for x in np.split(total[cell] - messages, np.cumsum(sizes[:-1]))]
    return pa.table({"length": table["n"], "piece": table["part"], "group": table["group"], "others": pa.array(others, pa.binary())})


def mine_part(threshold: float):
    """Templates of a part's messages; those too short for a leaf have no place in one and are their own."""

    def run(packed: pa.Table, found: pa.Table) -> pa.Table:
        if not len(found):
            own = pa.concat_tables(unpacked(packed["data"]))
            return pa.table({"message": own["message"], "template": pc.coalesce(own["plain"], own["message"])})
        placed = pc.is_null(found["group"])
        message, plain, words, codes, _, _, cell, counts, group = placed_part(packed, found.filter(placed))
        found = found.filter(pc.invert(placed)).sort_by("group")
        order = np.argsort(group, kind="stable")[np.count_nonzero(group < 0) :]
        others = [x["others"].to_numpy().astype(np.int64) for x in unpacked_lists(found["others"])]
        counts[order] += np.concatenate([np.zeros(0, np.int64), *others])
        return pa.table({"message": message, "template": masked_messages(plain, words, codes, counts, cell, threshold)})

    return run


def mine_templates_by_subsequence(log: DataFrame, tokens: Column, threshold: float = 0.5) -> DataFrame:
    """``message → template`` from words in their order; ``tokens`` is the token array and ``message``
    is its text with a line feed between tokens (tokens may hold blanks).

    Messages that keep the same words in the same order share a template, whatever their lengths: these
    words are a common subsequence of all.  It has a field wherever one of them has other words.
    """
    flat = F.array_join(F.transform(tokens, lambda t: F.translate(t, "\r\n", "  ")), "\n")
    words = F.when(F.col("message") != "", F.split("message", "\n")).otherwise(F.array().cast("array<string>"))
    messages = written(distinct_messages(log, flat).withColumn("words", words), "messages")
    each = messages.select(F.explode(F.array_distinct("words")).alias("word")).filter(F.col("word") != WILDCARD)
    support = written(each.groupBy("word").agg(F.count(F.lit(1)).alias("support")), "support")
    cells = messages.select("key", F.posexplode("words").alias("at", "word")).filter(F.col("word") != WILDCARD)
    shared = shared_words(written(cells, "cells"), support, ["word"], threshold, F.size("parts")).filter(F.col("cut") > 1)
    kept = shared.select("key", F.filter("parts", lambda p: p["support"] >= F.col("cut")).alias("kept"))
    before = lambda i: F.coalesce(F.get("kept.at", i - 1), F.lit(-1))
    after = lambda i: F.coalesce(F.get("kept.at", i), F.size("words"))
    fields = F.filter(F.sequence(F.lit(0), F.size("kept")), lambda i: after(i) - before(i) > 1)
    placed = written(
        messages.join(kept, "key").select("key", F.col("kept.word").alias("fixed"), fields.alias("fields")), "placed"
    )
    at = placed.select("fixed", F.explode_outer("fields").alias("field"))
    groups = at.groupBy("fixed").agg(F.collect_set("field").alias("fields"))  # places between the words of one template
    none = F.array().cast("array<string>")
    pieces = F.transform(
        F.sequence(F.lit(0), F.size("fixed")),
        lambda i: F.concat(
            F.when(F.array_contains("fields", i), F.array(F.lit(WILDCARD))).otherwise(none),
            F.when(i < F.size("fixed"), F.array(F.get("fixed", i))).otherwise(none),
        ),
    )
    named = written(groups.select("fixed", F.array_join(F.flatten(pieces), " ").alias("mined")), "templates")
    mined = placed.join(named, "fixed").select("key", "mined")
    return messages.join(mined, "key", "left").select(
        "message", F.coalesce("mined", F.array_join("words", " ")).alias("template")
    )


def assign_templates(log: DataFrame, text: Column, mapping: DataFrame) -> DataFrame:
    """Attach ``EventTemplate`` and ``EventId`` to each row through its masked message."""
    return (
        log.withColumn("message", text)
        .join(mapping, "message")
        .withColumnRenamed("template", "EventTemplate")
        .withColumn("EventId", template_id("EventTemplate"))
        .drop("message")
    )


# --- parameters --------------------------------------------------------------------------------


def _parameter_pattern(template: str, strip: bool) -> re.Pattern | None:
    marked = re.sub(r"\s<.{1,5}>\s" if strip else r"<.{1,5}>", WILDCARD, template)
    if WILDCARD not in marked:
        return None
    blank = r"[^A-Za-z0-9]+" if strip else r"\s+"
    fixed = [blank.join(re.escape(w) for w in re.split(" +", part)) for part in marked.split(WILDCARD)]
    return re.compile("^" + "(.*?)".join(fixed) + "$")


def template_params(rows: DataFrame, content: str = "Content", strip: bool = False) -> DataFrame:
    """``ParameterList``: what the wildcards of the row's template stand for in the raw content.

    Blanks of the template match any white space.  Rows come in Arrow batches and each batch
    compiles the templates it holds once; nothing is grouped, so a frequent template stays spread.
    """
    edges = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    @F.pandas_udf("array<string>")
    def captures(template: pd.Series, text: pd.Series) -> pd.Series:
        patterns: dict[str, re.Pattern | None] = {}
        out = []
        for t, c in zip(template, text):
            if t not in patterns:
                patterns[t] = _parameter_pattern(t, strip)
            pattern = patterns[t]
            hit = pattern.search(c) if pattern is not None and c is not None else None
            found = list(hit.groups()) if hit else []
            out.append([f.strip(edges).strip(" ") for f in found] if strip else found)
        return pd.Series(out)

    return rows.withColumn("ParameterList", captures("EventTemplate", content))
