"""Document fingerprints: hashes of the terms that randomised lexicons share with a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.session import written

#: Families of lexicons, and lexicons in each: a lexicon has half of the terms of the one before.
LADDERS, LEVELS = 12, 12
#: Where the families start among the hashes of terms: at odd places, one in each sixteenth.
LADDER_STARTS = [(r << 59) | (0x5A17C3D2E4B60F9 >> r) for r in range(LADDERS)]
#: Bits after the sign in which any two starts differ.
SHARED = 4
NO_TERMS = "array<bigint>"


BREAKS = r"[\s\p{Punct}]+"


def words(text: Column) -> Column:
    """Words of a text: what stands between blanks and punctuation, in lower case."""
    return F.array_remove(F.split(F.lower(text), BREAKS), "")


def terms(text: Column) -> Column:
    """Sorted hashes of the distinct words of a text."""
    return F.array_sort(F.array_distinct(F.transform(F.array_distinct(words(text)), lambda w: F.xxhash64(w))))


def frequencies(texts: DataFrame) -> DataFrame:
    """(term, idf, only): log(n / texts with it) as a share of the largest, log(n), and the text of a single one.

    ``texts`` has doc_id and text.  ``only`` holds doc_id and a hash of the text, so a term of one text
    is found there again without a row for each term of each text.
    """
    n = texts.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.struct("doc_id", F.xxhash64("text").alias("h"))
    counted = (
        texts.select(place.alias("place"), F.explode(terms(F.col("text"))).alias("term"))
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.min("place").alias("only"))
    )
    idf = F.log(n / F.col("df")) / F.log(F.greatest(n, F.lit(2)))
    return counted.select("term", idf.alias("idf"), F.when(F.col("df") == 1, F.col("only")).alias("only"))


def common_terms(found: DataFrame, low: float) -> DataFrame:
    """One row with the terms below the band.  Each stands in n^(1-low) texts or more, so there are at most n^low
    times the mean number of terms of a text."""
    return found.filter(F.col("idf") < low).agg(F.array_sort(F.collect_list("term")).alias("common"))


def single_terms(found: DataFrame) -> DataFrame:
    """(single_id, singles): for each id the terms of its texts that stand in no other, by a hash of the text."""
    texts = found.filter("only is not null").groupBy("only").agg(F.collect_list("term").alias("single"))  # terms of one text
    return texts.groupBy(F.col("only.doc_id").alias("single_id")).agg(F.collect_list(F.struct("only.h", "single")).alias("singles"))


def shifted(value: Column, places: Column) -> Column:
    return F.call_function("shiftrightunsigned", value, places)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lexicon_hashes(in_band: Column) -> Column:
    """For each ladder, level by level: the hash of all ``in_band`` terms in that lexicon, -1 if there is none.

    The lexicons are fixed and the same for all texts: that of level k of a ladder has the terms whose
    hashes share k leading bits (after the sign) with the ladder's start.  Ladders whose starts share
    those bits share the lexicon, so the first levels are cut once for all of them.  ``in_band`` is
    sorted and distinct.
    """
    hashed = lambda ts: F.when(F.size(ts) > 0, F.xxhash64(ts).bitwiseAND(0xFFFFFFFF)).otherwise(F.lit(-1).cast("long"))
    near = lambda start, k: lambda t: shifted(t.bitwiseXOR(start), F.lit(63) - k).bitwiseAND(1) == 0
    with_hash = lambda acc: F.array_append(acc["out"], hashed(acc["left"]))
    heads = lambda k: sorted({start >> (63 - k) for start in LADDER_STARTS})

    def ladder(group: Column, start: Column) -> Column:
        halved = lambda acc, k: F.struct(F.filter(acc["left"], near(start, k)).alias("left"), with_hash(acc).alias("out"))
        return F.aggregate(F.sequence(F.lit(SHARED + 1), F.lit(LEVELS - 1)), group, halved, with_hash)

    def level(groups: Column, k: int) -> Column:
        """All ladders from the groups of level k on, one for each beginning of k bits."""
        if k == SHARED:
            return F.flatten(F.zip_with(groups, F.array(*[F.lit(c).cast("long") for c in LADDER_STARTS]), ladder))
        known = F.transform(groups, lambda g: F.struct(g["left"].alias("left"), with_hash(g).alias("out")))

        def halves(done: Column) -> Column:
            parts = []
            for head in heads(k + 1):
                of = F.get(done, F.lit(heads(k).index(head >> 1)))
                kept = F.filter(of["left"], near(F.lit(head << (62 - k)).cast("long"), F.lit(k + 1)))
                parts.append(F.struct(kept.alias("left"), of["out"].alias("out")))
            return level(F.array(*parts), k + 1)

        return bound(known, halves)

    return level(F.array(F.struct(in_band.alias("left"), F.array().cast(NO_TERMS).alias("out"))), 0)


def tips(hashes: Column) -> Column:
    """For each ladder a hash of the smallest lexicon that has any of the terms, and of what it has."""
    ladders = F.transform(F.sequence(F.lit(0), F.lit(LADDERS - 1)), lambda r: F.slice(hashes, r * LEVELS + 1, F.lit(LEVELS)))
    return F.transform(ladders, lambda hs: F.xxhash64(F.size(F.filter(hs, lambda h: h >= 0)), F.array_max(F.slice(hs, F.greatest(F.size(F.filter(hs, lambda h: h >= 0)), F.lit(1)), F.lit(1)))))


def likeness(a: str, b: str) -> Column:
    """Share of the ladders on whose smallest lexicons with terms of either text both have the same terms."""
    same = F.zip_with(a, b, lambda x, y: (x == y).cast("double"))
    return F.aggregate(same, F.lit(0.0), lambda s, x: s + x) / LADDERS


def shown(fingerprint: str) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each lexicon, a dash for one without terms."""
    return F.array_join(F.transform(fingerprint, lambda h: F.when(h < 0, "-").otherwise(F.lower(F.lpad(F.hex(h), 8, "0")))), ".")


def next_ids(docs: DataFrame) -> DataFrame:
    """(asker, next, wanted) for each doc_id, in structs: the next lower id, or the first for the last.

    wanted is a third of the asker's code points.  Ids are ordered in ranges of about equal numbers of
    ids; one small row per range goes through the one window without keys.
    """
    sizes = docs.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    ids = sizes.select(
        F.struct("doc_id").alias("asker"),
        F.floor(F.col("n") / 3).cast("int").alias("wanted"),
    )
    ids = written(ids.repartitionByRange("asker").withColumn("block", F.spark_partition_id()), "ids")
    along, every = Window.orderBy("block"), Window.partitionBy()
    edges = (
        ids.groupBy("block").agg(F.max("asker").alias("last"))
        .select("block", F.coalesce(F.lag("last").over(along), F.max("last").over(every)).alias("before"))
    )
    inside = Window.partitionBy("block").orderBy("asker")
    return (
        ids.withColumn("lower", F.lag("asker").over(inside)).alias("i")
        .join(edges.alias("e"), F.col("i.block") == F.col("e.block"))
        .select("asker", F.coalesce("lower", "before").alias("next"), "wanted")
    )


def of_text(lists: str, field: str) -> Column:
    """The array ``field`` that a list of (h, ...) has for the row's text; empty if it has none."""
    mine = F.filter(lists, lambda s: s["h"] == F.xxhash64("text"))
    return F.coalesce(F.get(mine, F.lit(0))[field], F.array().cast(NO_TERMS))


def with_singles(texts: DataFrame, single: DataFrame) -> DataFrame:
    """Add ``single``, the terms of each text that stand in no other.  Texts are dealt by doc_id alone, so
    what is joined by doc_id afterwards does not move them again."""
    joined = texts.join(single, F.col("doc_id").eqNullSafe(F.col("single_id")), "left")
    return joined.withColumn("single", of_text("singles", "single")).drop("single_id", "singles")


def next_heads(own: DataFrame, order: DataFrame) -> DataFrame:
    """(asker, head, next_single): what each document takes from the next one, and that one's single terms."""
    return (
        own.join(order, F.col("doc_id").eqNullSafe(F.col("next.doc_id")))
        .select(F.col("asker.doc_id").alias("asker"), F.substring("text", F.lit(1), F.col("wanted")).alias("head"), "single")
        .groupBy("asker").agg(F.min(F.struct("head", "single")).alias("h"))
        .select("asker", "h.head", F.col("h.single").alias("next_single"))
    )


def prefix(text: str) -> Column:
    """The text without its last third."""
    return F.substring(text, F.lit(1), F.length(text) - F.floor(F.length(text) / 3).cast("int"))


def cut_terms(texts: DataFrame, heads: DataFrame, banded: DataFrame) -> DataFrame:
    """(cut_id, cuts): by hash of the text, the terms that the two cuts make, and which of them are in the band.

    These are the last word of what stays with the first one of the head, and the head's last word; all
    other terms of an edited text are terms of its two sources.
    """
    end = lambda c: F.element_at(F.split(c, BREAKS), -1)
    tails = texts.select("doc_id", F.xxhash64("text").alias("h"), end(prefix("text")).alias("tail"))
    made = F.array_distinct(F.filter(
        F.array(F.concat("tail", F.element_at(F.split("head", BREAKS), 1)), F.when(F.size(F.split("head", BREAKS)) > 1, end(F.col("head")))),
        lambda w: F.coalesce(w, F.lit("")) != "",
    ))
    asked = (
        tails.join(heads, F.col("doc_id").eqNullSafe(F.col("asker")))
        .select("doc_id", "h", F.explode(F.transform(made, lambda w: F.xxhash64(F.lower(w)))).alias("term"))
    )
    known = asked.join(banded.withColumn("sure", F.lit(True)), "term", "left")
    return (
        known.groupBy("doc_id", "h").agg(F.collect_set("term").alias("made"), F.collect_set(F.when(F.col("sure"), F.col("term"))).alias("sure"))
        .groupBy(F.col("doc_id").alias("cut_id")).agg(F.collect_list(F.struct("h", "made", "sure")).alias("cuts"))
    )


def fingerprint_edits(docs: DataFrame, low: float = 0.25) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Returns doc_id, n_chars, edited_sha256 (of the text whose last third is replaced by the beginning of
    the next document by falling doc_id), fingerprint and edited_fingerprint (hashes by ladder and
    level), near_edited and near_next (to the next document's fingerprint).

    The band of terms lies from ``low`` up to, but without, the idf of terms of a single document.  A
    null text is empty.  Rows that share an id (or have none) hold one place in the order, as long
    as the longest of them, and as a next document show their smallest text and fingerprint; all rows
    come back.  A single document is next to itself; an empty table gives no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = written(frequencies(texts), "frequencies")
    order = written(next_ids(docs), "order")
    single = written(single_terms(found), "single")
    common = written(common_terms(found, low), "common")
    own = with_singles(texts, single)
    heads = written(next_heads(own, order), "heads")
    banded = found.filter((F.col("idf") >= low) & F.col("only").isNull()).select("term")
    cuts = written(cut_terms(texts, heads, banded), "cuts")
    edited = (
        own.join(heads, F.col("doc_id").eqNullSafe(F.col("asker"))).join(cuts, F.col("doc_id").eqNullSafe(F.col("cut_id")), "left")
        .select(
            "doc_id", "text", "single", "next_single", F.concat(prefix("text"), "head").alias("edited"),
            of_text("cuts", "made").alias("made"), of_text("cuts", "sure").alias("sure"), common.select("common").scalar().alias("common"),
        )
    )
    without = lambda ts, *gone: F.array_except(ts, F.concat(*gone))
    placed = edited.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.array_sort(without(terms(F.col("text")), "common", "single")).alias("own"),
        F.array_sort(F.array_union(without(terms(F.col("edited")), "common", "single", "next_single", "made"), F.col("sure"))).alias("new"),
    )
    marked = placed.select("doc_id", "n_chars", "edited_sha256", lexicon_hashes(F.col("own")).alias("fingerprint"), lexicon_hashes(F.col("new")).alias("edited_fingerprint"))
    stored = written(
        marked.withColumns({"tips": tips(F.col("fingerprint")), "edited_tips": tips(F.col("edited_fingerprint"))}), "fingerprints"
    )
    following = (
        stored.alias("f").join(order.alias("o"), F.col("f.doc_id").eqNullSafe(F.col("o.next.doc_id")))
        .groupBy(F.col("o.asker.doc_id").alias("asker")).agg(F.min("tips").alias("next_tips"))
    )
    return (
        stored.alias("f").join(following.alias("n"), F.col("f.doc_id").eqNullSafe(F.col("n.asker")))
        .withColumns({"near_edited": likeness("tips", "edited_tips"), "near_next": likeness("tips", "next_tips")})
        .select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    )
