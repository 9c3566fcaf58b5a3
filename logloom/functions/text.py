"""Column expressions on raw log text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WILDCARD = "<*>"

# The masking patterns of each log source, applied in this order.
MASKS = {
    "windows": (
        r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
        r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}",
        r"0x[0-9a-fA-F]+",
        r"\b\d+\b",
        r"(?<=\=)[^|]+(?=\||$)",
    ),
    "bgl": (r"(0x)[0-9a-fA-F]+", r"\d+.\d+.\d+.\d+", r"\d+"),
    "thunderbird": (
        r"(0x)[0-9a-fA-F]+",
        r"\d+\.\d+\.\d+\.\d+",
        r"(?<=Warning: we failed to resolve data source name )[\w\s]+",
        r"\d+",
    ),
    "hdfs_drain": (
        r"(?<=blk_)[-\d]+",
        r"\d+\.\d+\.\d+\.\d+",
        r"(/[-\w]+)+",
    ),
    "hdfs_spell": (r"(/[-\w]+)+", r"(?<=blk_)[-\d]+"),
}

# The time formats of the log sources.
TIME_FORMATS = {
    "windows": ("yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss"),
    "bgl": ("yyyy-MM-dd-HH.mm.ss.SSSSSS",),
    "thunderbird": ("yyyy.MM.dd HH:mm:ss",),
    "timeline": ("yyyy-MM-dd HH:mm:ss.SSS XXX",),
}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mask_content(text: Column | str, patterns: Sequence[str] = MASKS["windows"]) -> Column:
    """Replace every match of each pattern in turn by ``<*>``, with Unicode digits and words."""
    out = _col(text)
    for pattern in patterns:
        out = F.regexp_replace(out, F.lit("(?U)" + pattern), F.lit(WILDCARD))
    return out


def tokenize(text: Column | str) -> Column:
    """Split on runs of white space; blank text has no tokens."""
    parts = F.split(_col(text), r"(?U)\s+")
    return F.filter(parts, lambda t: t != "")


def tokenize_on_punctuation(text: Column | str) -> Column:
    """Non-ASCII runs become ``<NASCII>``; split on ASCII punctuation except ``<``, ``*``, ``>`` and
    backslash; drop blank tokens.  Blanks do not split, so a token may hold several words."""
    plain = F.regexp_replace(_col(text), r"[^\x00-\x7F]+", "<NASCII>")
    parts = F.split(plain, r"[!\"#$%&'()+,\-./:;=?@\[\]^_`{|}~]")
    return F.filter(parts, lambda t: F.trim(F.regexp_replace(t, r"\s", " ")) != "")


# Fixed value: the characters that count as white space at the ends of a text.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column | str) -> Column:
    """Trim white space of any script, without a pattern."""
    return F.btrim(_col(text), F.lit(BLANKS))


def clean_text(text: Column | str) -> Column:
    """Remove line breaks and trim."""
    return strip(F.translate(_col(text), "\r\n", ""))


def drop_leading_channel(text: Column | str) -> Column:
    """Drop a first part ``Channel=Security`` and empty parts of a ``;`` list; nothing left is null."""
    parts = F.split(_col(text), ";")
    rest = F.when(parts[0] == "Channel=Security", F.slice(parts, 2, F.size(parts))).otherwise(parts)
    return F.nullif(F.array_join(F.filter(rest, lambda p: p != ""), ";"), F.lit(""))


def binary_label(label: Column | str) -> Column:
    """1 unless the label is exactly ``-``; a missing label counts as 1."""
    return (F.coalesce(_col(label), F.lit("")) != "-").cast("int")


def event_time(text: Column | str, formats: Sequence[str] = TIME_FORMATS["windows"]) -> Column:
    """First format that parses; null when none does."""
    tries = [F.try_to_timestamp(_col(text), F.lit(f)) for f in formats]
    return F.coalesce(*tries)


def pad_time(text: Column | str, width: int = 26) -> Column:
    """Fill a time string with zeros on the right up to ``width``; longer ones stay whole."""
    text = _col(text)
    return F.when(F.length(text) >= width, text).otherwise(F.rpad(text, width, "0"))


def in_date_range(ts: Column | str, first: str, last: str) -> Column:
    """``first <= date <= last``, both ends kept."""
    return F.to_date(_col(ts)).between(F.lit(first).cast("date"), F.lit(last).cast("date"))


def before_date(ts: Column | str, day: str) -> Column:
    return F.to_date(_col(ts)) < F.lit(day).cast("date")


def build_content(channel: Column | str, details: Column | str) -> Column:
    """``Channel=…|Details=…``; null when either is."""
    return F.concat(F.lit("Channel="), _col(channel), F.lit("|Details="), _col(details))


def prefixed_content(content: Column | str) -> Column:
    return F.concat(F.lit("Content"), _col(content).cast("string"))


def template_id(template: Column | str) -> Column:
    """First 8 hex digits of the MD5 of a template."""
    return F.substring(F.md5(_col(template)), 1, 8)


def block_ids(content: Column | str) -> Column:
    """Distinct block ids a message mentions."""
    return F.array_distinct(F.regexp_extract_all(_col(content), F.lit(r"(blk_-?\d+)"), F.lit(1)))


def is_complement(project: Column | str) -> Column:
    """Projects whose name ends in ``_C`` hold normal rows only."""
    return _col(project).endswith("_C")


def event_symbol(mined: Column | str, source: Column | str, use: str = "EventId") -> Column:
    """The sequence symbol: the mined template id or the number the source gave."""
    if use not in ("EventId", "EventID"):
        raise ValueError("use must be 'EventId' or 'EventID'")
    return _col(mined) if use == "EventId" else _col(source).cast("string")
