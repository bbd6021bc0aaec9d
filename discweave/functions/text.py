"""Column expressions over labels. Character classes are Unicode, as ``(?U)`` makes them in Java."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRIP = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, STRIP, "")


def sanitize(label: Column, most: int = 120) -> Column:
    """A file name from a label: forbidden and control characters go (so tabs and line ends do
    before white space becomes ``_``), dots and underscores go at the ends, at most ``most``
    characters stay, and nothing becomes ``untitled``."""
    t = F.regexp_replace(label, r'[<>:"/|?*\\]', "")
    t = F.regexp_replace(t, r"[\x00-\x1F]", "")
    t = F.regexp_replace(strip(t), r"(?U)\s+", "_")
    t = F.regexp_replace(t, r"^[._]+|[._]+$", "")
    t = F.regexp_replace(F.substring(t, 1, most), r"[._]+$", "")
    return F.when(t == "", F.lit("untitled")).otherwise(t)


#: Months; a reader may put spaces between the letters, and a zero after the O.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
#: One test for all of them: most labels name no month.
ANY_MONTH = r"(?iUu)\b(" + "|".join(r"\s*".join(m) for m in MONTHS) + r"|O\s*0\s*c\s*t)\b"


def cleanup(text: Column) -> Column:
    """A read label made regular: white space collapsed, digits and Latin letters parted, spaced
    month names closed up, a lone letter joined to the 2 to 4 digits after it, ``2/Nov`` as
    ``2 Nov``."""
    collapse = lambda t: strip(F.regexp_replace(t, r"(?U)\s+", " "))
    t = collapse(F.regexp_replace(text, "\t", " "))
    t = F.regexp_replace(t, r"(?U)(\d)([A-Za-z])", "$1 $2")
    t = F.regexp_replace(t, r"(?U)([A-Za-z])(\d)", "$1 $2")
    mended = t
    for month in MONTHS:
        spaced = r"\s*".join(month)
        mended = F.regexp_replace(mended, rf"(?iUu)\b{spaced}\b", month)
        if month == "Oct":
            mended = F.regexp_replace(mended, r"(?iUu)\bO\s*0\s*c\s*t\b", month)
    t = F.when(t.rlike(ANY_MONTH), mended).otherwise(t)
    t = F.regexp_replace(t, r"(?U)\b([A-Za-z])\s+(\d{2,4})\b", "$1$2")
    t = F.regexp_replace(t, r"(?U)\b(\d{1,2})\s*/\s*([A-Za-z]{3})\b", "$1 $2")
    return collapse(t)


def normalise_label(text: Column) -> Column:
    """Stripped, trailing bars off, white space collapsed."""
    return F.regexp_replace(strip(F.regexp_replace(strip(text), r"\|+$", "")), r"(?U)\s+", " ")


def without_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


ALLOWED = r"[^\p{L}\p{N}\u0590-\u05FF .,!?'()-]"
LETTERS = r"[^\p{L}\p{N}\u0590-\u05FF]"


def quality(text: Column) -> Column:
    """Half the share of characters that labels use, half that of letters and digits; 0 if empty."""
    n = F.length(text)
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / n
    return F.when(n > 0, 0.5 * share(ALLOWED) + 0.5 * share(LETTERS)).otherwise(0.0)


def weighted_quality(text: Column, confidences: Column) -> Column:
    """Mean over the characters of allowed times confidence (0 to 100, cut to its range; missing 0)."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    value = lambda c, q: F.when(c.isNotNull() & ~F.coalesce(c, F.lit("")).rlike(ALLOWED), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(q, F.lit(0.0)) / 100))).otherwise(0.0)
    total = F.aggregate(F.zip_with(chars, F.slice(confidences, F.lit(1), F.greatest(F.lit(1), F.size(chars))), value), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.length(text) > 0, total / F.length(text)).otherwise(0.0)


def mean_confidence(confidences: Column) -> Column:
    """Mean of the confidences there are (null and negative ones aside) over 100, cut to 0..1; 0 for none."""
    there = F.filter(confidences, lambda c: c.isNotNull() & (c >= 0))
    mean = F.aggregate(there, F.lit(0.0), lambda a, v: a + v) / F.size(there) / 100
    return F.when(F.size(there) > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean))).otherwise(0.0)


def blended_quality(weighted: Column, plain: Column, confidence: Column) -> Column:
    return 0.6 * weighted + 0.25 * plain + 0.15 * confidence


def digits(text: Column) -> Column:
    """All digits of a text as one number, null if it has none or too many."""
    return F.nullif(F.regexp_replace(text, "[^0-9]", ""), F.lit("")).try_cast("int")


def digit_key(text: Column) -> Column:
    return F.coalesce(digits(text), F.lit(0))


def track_number(name: Column, prefix: str) -> Column:
    """All digits after a prefix (any case), null where the prefix or digits are missing."""
    return F.when(F.upper(F.substring(name, 1, len(prefix))) == prefix.upper(), digits(F.substring(name, len(prefix) + 1, 1 << 20)))


def menu_base(menu_id: Column) -> Column:
    """What is before ``_pgc``; nothing gives null."""
    return F.nullif(F.substring_index(menu_id, "_pgc", 1), F.lit(""))


def track_line(line: Column) -> Column:
    """``Track N: FILE`` as a struct, null elsewhere."""
    pattern = r"^\s*Track\s+(\d+):\s+(\S+)"
    number = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return F.when(number.isNotNull(), F.struct(number.cast("int").alias("track_no"), F.regexp_extract(line, pattern, 2).alias("file_name")))


def entry_line(line: Column) -> Column:
    """``Entry point: track N hh:mm:ss`` as a struct, null elsewhere."""
    pattern = r"^\s*Entry point:\s+track\s+(\d+)\s+(\d\d:\d\d:\d\d)"
    number = F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))
    return F.when(number.isNotNull(), F.struct(number.cast("int").alias("track_no"), F.regexp_extract(line, pattern, 2).alias("timecode")))


def coordinate_line(line: Column) -> Column:
    """``n  x1,y1 - x2,y2`` with sides as plain differences."""
    pattern = r"^\s*(\d+)\s+(\d+)\s*,\s*(\d+)\s*-\s*(\d+)\s*,\s*(\d+)\s*$"
    part = lambda k: F.regexp_extract(line, pattern, k).cast("int")
    return F.when(line.rlike(pattern), F.struct(part(1).alias("n"), part(2).alias("x"), part(3).alias("y"), (part(4) - part(2)).alias("w"), (part(5) - part(3)).alias("h")))


def numbered_line(line: Column) -> Column:
    pattern = r"^\s*(\d+)\.\s*(.*?)\s*$"
    return F.when(line.rlike(pattern), F.struct(F.regexp_extract(line, pattern, 1).cast("int").alias("n"), F.regexp_extract(line, pattern, 2).alias("text")))


def track_id(n: Column) -> Column:
    return F.format_string("track_%02d", n)


def button_id(n: Column) -> Column:
    return F.format_string("btn%d", n)


def menu_id(title: Column, pgc: Column) -> Column:
    return F.format_string("VTSM_%02d_pgc%02d", title, pgc)


def output_prefix(n: Column) -> Column:
    return F.format_string("%02d_", n)
