"""Lines that recur across documents, generalised by a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.session import written

#: What parts words of a line, what marks a field, and which words are fields at sight.
BLANKS = " \t\r"
GAP = "[ \\t\\r]+"
FIELD = "<*>"
NUMBERED = "[^ \\t\\r]*[0-9][^ \\t\\r]*"


def plain(line: Column) -> Column:
    """The line without outer blanks, words with digits as fields, words one space apart."""
    fields = F.when(line.rlike("[0-9]"), F.regexp_replace(line, NUMBERED, FIELD)).otherwise(line)
    spaced = F.when(line.rlike("[\\t\\r]|  "), F.regexp_replace(fields, GAP, " ")).otherwise(fields)
    return F.trim(spaced, F.lit(BLANKS))


def spaced(line: Column) -> Column:
    """The line as it is, without outer blanks, words one space apart."""
    return F.trim(F.regexp_replace(line, GAP, " "), F.lit(BLANKS))


def line_rows(docs: DataFrame, depth: int, least: int, share: float = 0) -> DataFrame:
    """One slim row per line of at least ``least`` words: where it is, its leaf and its plain form.

    A leaf of the tree is a number of words and the first ``depth`` words.  Lines in which less than
    ``share`` of the words are without digits have no leaf, and their own words as form.
    """
    words = F.col("words")
    form = F.struct(F.xxhash64(words).alias("h"), F.hash(words).alias("more"))  # 96 bits
    leaf = F.xxhash64(F.size(words), F.slice(words, 1, depth))
    if share:
        fixed = F.size(F.filter(words, lambda w: w != FIELD)) >= F.size(words) * share
        own = F.split(spaced(F.col("line")), " ")
        form = F.when(fixed, form).otherwise(F.struct(F.xxhash64(own, F.lit(1)).alias("h"), F.hash(own, F.lit(1)).alias("more")))
        leaf = F.when(fixed, leaf)
    return (
        docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        # a generator, so that the filter isn't pushed below the split and made to repeat it
        .select("doc_id", "doc", "pos", *["line"] * (share > 0), F.explode(F.array(F.split(plain(F.col("line")), " "))).alias("words"))
        .filter((F.size(words) >= least) & (words[0] != ""))
        .select(
            "doc_id",
            "doc",
            "pos",
            F.size(words).alias("n"),
            leaf.alias("leaf"),
            form.alias("form"),
        )
    )


def generalised(docs: DataFrame, lines: DataFrame, min_docs: int, constant: float, share: float = 0) -> DataFrame:
    """Templates of forms that are not frequent by themselves: (form, template).

    In each leaf a word is constant at its position if forms in ``min_docs`` documents have it there;
    other words become fields.  A form takes part if at least the share ``constant`` of its words is
    constant, and not all; with ``share``, words with digits are not counted as constant.  The text of one line for each form is fetched by document.
    """
    place = F.struct("doc", "pos")
    forms = lines.filter("leaf is not null").groupBy("leaf", "form", "n").agg(
        F.min(place).alias("at"), F.count_distinct("doc").alias("docs")
    )
    leaves = forms.groupBy("leaf").agg(F.count(F.lit(1)).alias("forms"), F.sum("docs").alias("leaf_docs"))
    wanted = (
        forms.join(leaves, "leaf")
        .filter((F.col("forms") > 1) & (F.col("leaf_docs") >= min_docs))
        .groupBy(F.col("at.doc").alias("doc"))
        .agg(F.collect_list(F.struct("at.pos", "leaf", "form", "n", "docs")).alias("wanted"))  # lines of one text
    )
    words = written(
        docs.select(F.xxhash64("doc_id", "text").alias("doc"), "text")
        .join(wanted, "doc")
        .select("wanted", F.explode(F.array(F.split("text", "\n"))).alias("texts"))
        .select("texts", F.explode("wanted").alias("w"))
        .select("w.leaf", "w.form", "w.n", "w.docs", F.get("texts", F.col("w.pos")).alias("line"))
        .dropDuplicates(["leaf", "form"])  # rows that repeat an id and a text are one document
        .select("leaf", "form", "n", "docs", F.posexplode(F.split(plain(F.col("line")), " ")).alias("k", "word")),
        "words",
    )
    support = words.groupBy("leaf", "k", "word").agg(F.sum("docs").alias("support")).filter(F.col("support") >= min_docs)
    fixed = words.join(support, ["leaf", "k", "word"])
    counted = F.filter("words", lambda w: w["word"] != FIELD) if share else F.col("words")
    return (
        fixed.groupBy("leaf", "form", "n")
        .agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("words"))  # words of one line
        .filter((F.size(counted) >= F.col("n") * constant) & (F.size("words") < F.col("n")))
        .select("form", F.struct(F.xxhash64("leaf", "words").alias("h"), F.hash("words", "leaf").alias("more")).alias("template"))
    )


def drop_recurring(
    docs: DataFrame, min_docs: int = 3, depth: int = 3, constant: float = 0.75, least: int = 3, recur: int | None = None, share: float = 0
) -> DataFrame:
    """Drop lines whose template recurs in ``recur`` documents, but for the first document's.

    ``min_docs`` is the support that a word needs to be constant; ``recur`` is the same if not given.
    A line in which less than ``share`` of the words are without digits recurs only as it stands.

    The columns of ``docs`` come back with ``text`` without these lines, and with n_lines and
    n_dropped, which ``docs`` must not have.  Lines parse into leaves by their number of words and their first ``depth``
    words; words with digits, and words that vary in a leaf, are fields.  A template is dropped
    wherever it stands except in its first document (by doc_id, those without an id last), so a
    passage that every copy shares is kept once.  Lines of fewer than ``least`` words are kept.

    Null texts stay null with no lines; rows that repeat an id and a text count as one document and
    all come back; an empty table gives no rows.  Only hashes of lines are grouped: a template that
    a third of all lines share is summed before it is shuffled.  The text is shuffled by document.
    """
    lines = written(line_rows(docs, depth, least, share), "lines")
    templates = generalised(docs, lines, min_docs, constant, share)
    placed = written(
        lines.join(templates, "form", "left").select(
            "doc_id", "doc", "pos", F.coalesce("template", "form").alias("template")
        ),
        "placed",
    )
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc")
    recurring = written(  # a table, so that the join below can be split where a template is frequent
        placed.groupBy("template", "doc").agg(F.min(order).alias("order"))
        .groupBy("template").agg(F.count(F.lit(1)).alias("docs"), F.min("order").alias("first"))
        .filter(F.col("docs") >= (min_docs if recur is None else recur))
        .select("template", F.col("first.doc").alias("first")),
        "recurring",
    )
    dropped = (
        placed.join(recurring, "template")
        .filter(F.col("doc") != F.col("first"))
        .groupBy("doc")
        .agg(F.collect_set("pos").alias("dropped"))  # positions of one text
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "dropped")
    return (
        docs.withColumn("doc_key", F.xxhash64("doc_id", "text"))
        .join(dropped.withColumnRenamed("doc", "doc_key"), "doc_key", "left")
        # a generator, so that each text is split once, and only if it loses lines
        .select(*docs.columns, "dropped", F.explode(F.array(F.when(F.col("dropped").isNotNull(), F.split("text", "\n")))).alias("parts"))
        .select(
            *[c for c in docs.columns if c != "text"],
            F.when(F.col("dropped").isNull(), F.col("text"))
            .otherwise(F.array_join(F.transform(kept, lambda k: F.get("parts", k)), "\n"))
            .alias("text"),
            F.coalesce(1 + F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.when(F.col("dropped").isNotNull(), F.size("dropped")), F.lit(0)).cast("long").alias("n_dropped"),
        )
        .select(*docs.columns, "n_lines", "n_dropped")
    )


def oracle_sql(min_docs: int = 3, depth: int = 3, constant: float = 0.75, least: int = 3) -> str:
    """The same in SQL over ``documents``."""
    return f"""
WITH raw_lines AS (
  SELECT doc_id, text, unnest(range(len(l))) AS pos, unnest(l) AS line
  FROM (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)),
plain_lines AS (
  SELECT doc_id, text, pos,
         regexp_replace(regexp_replace(trim(line, chr(32) || chr(9) || chr(13)),
           '[^ \\t\\r]*[0-9][^ \\t\\r]*', '<*>', 'g'), '[ \\t\\r]+', ' ', 'g') AS form
  FROM raw_lines),
line_rows AS (
  SELECT *, len(string_split(form, ' ')) AS n, array_to_string(string_split(form, ' ')[1:{depth}], ' ') AS head
  FROM plain_lines WHERE form <> '' AND len(string_split(form, ' ')) >= {least}),
forms AS (
  SELECT n, head, form, count(DISTINCT (doc_id, text)) AS docs FROM line_rows GROUP BY ALL),
wanted AS (
  SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY n, head) AS forms, sum(docs) OVER (PARTITION BY n, head) AS leaf_docs FROM forms)
  WHERE forms > 1 AND leaf_docs >= {min_docs}),
words AS (
  SELECT n, head, form, docs, unnest(range(n)) AS k, unnest(string_split(form, ' ')) AS word FROM wanted),
fixed_words AS (
  SELECT * FROM (SELECT *, sum(docs) OVER (PARTITION BY n, head, k, word) AS support FROM words) WHERE support >= {min_docs}),
templates AS (
  SELECT n, head, form, 'T' || n || ' ' || head || '|' || string_agg(k || ':' || word, ' ' ORDER BY k) AS template
  FROM fixed_words GROUP BY n, head, form HAVING count(*) >= n * {constant} AND count(*) < n),
placed AS (
  SELECT l.doc_id, l.text, l.pos, coalesce(t.template, 'F' || l.form) AS template
  FROM line_rows l LEFT JOIN templates t USING (n, head, form)),
recurring AS (
  SELECT template, min(doc_id) AS first FROM placed GROUP BY template HAVING count(DISTINCT (doc_id, text)) >= {min_docs}),
dropped AS (
  SELECT DISTINCT p.doc_id, p.pos FROM placed p JOIN recurring r USING (template) WHERE p.doc_id <> r.first),
every_line AS (
  SELECT r.doc_id, r.pos, r.line, d.pos IS NOT NULL AS gone FROM raw_lines r LEFT JOIN dropped d ON d.doc_id = r.doc_id AND d.pos = r.pos)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM every_line GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL"""
