"""Tolerant readers for dissector text, and small text renderers used by the report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wirepost.functions import vocab

HEX = r"^0[xX][0-9a-fA-F]+$"
DEC = r"^[+-]?[0-9]+$"


def pick(flat: str, names: list[str]) -> Column:
    """First present alternative as text; a list gives its first element, an empty one null."""
    def one(name):
        value = F.coalesce(F.col(flat)[name], F.lit("None"))
        head = F.get(F.from_json(value, "array<string>"), 0)
        return F.when(value.startswith("["), head).otherwise(value)
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.map_contains_key(F.col(flat), name), one(name)).otherwise(out)
    return out


def pick_all(flat: str, names: list[str]) -> Column:
    """All values of the first present alternative; empty when none is present."""
    def one(name):
        value = F.coalesce(F.col(flat)[name], F.lit("None"))
        listed = F.transform(F.from_json(value, "array<string>"),
                             lambda x: F.coalesce(x, F.lit("None")))
        return F.when(value.startswith("["), listed).otherwise(F.array(value))
    out = F.array().cast("array<string>")
    for name in reversed(names):
        out = F.when(F.map_contains_key(F.col(flat), name), one(name)).otherwise(out)
    return out


def to_int(text: Column) -> Column:
    """Decimal or 0x-prefixed hexadecimal."""
    t = F.trim(text)
    return (F.when(t.rlike(HEX), F.conv(F.substring(t, 3, 64), 16, 10).try_cast("bigint"))
            .when(t.rlike(DEC), t.try_cast("bigint")))


def to_int_decimal(text: Column) -> Column:
    """Decimal only; the hello fields are read this way."""
    t = F.trim(text)
    return F.when(t.rlike(DEC), t.try_cast("bigint"))


def to_float(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def to_epoch(text: Column) -> Column:
    """Epoch seconds from a number or from an ISO timestamp of any sub-second precision."""
    t = F.regexp_replace(F.trim(text), r"(\.\d{6})\d+", "$1")
    stamp = t.try_cast("timestamp")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), F.unix_micros(stamp) / F.lit(1e6))
    return F.coalesce(to_float(text), iso)


def decode_payload(text: Column) -> Column:
    """Colon-separated hex to text; bad UTF-8 becomes the replacement character."""
    digits = F.trim(F.replace(text, F.lit(":"), F.lit("")))
    clean = (digits != "") & (F.length(digits) % 2 == 0) & ~digits.rlike("[^0-9a-fA-F]")
    return F.when(clean, F.make_valid_utf8(F.unhex(digits).cast("string")))


def int_set(col: Column, values) -> Column:
    return F.coalesce(col.isin(list(values)), F.lit(False))


def port_class(port: Column) -> Column:
    out = F.lit(vocab.OTHER)
    for number, name in vocab.PORT_CLASSES.items():
        out = F.when(port == number, name).otherwise(out)
    return out


def finding_id(*parts: Column) -> Column:
    """Stable 16-digit id of the pipe-joined parts; a missing stream id reads `None`."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(F.sha2(text, 256), 1, 16)


def id_number(col: Column) -> Column:
    """The number a 16-digit id writes out, null for any other text."""
    return F.when(col.rlike(r"\A[0-9a-f]{16}\z"), F.conv(col, 16, -10).cast("bigint"))


def id_text(col: Column) -> Column:
    """The 16-digit id of a number."""
    return F.lpad(F.lower(F.hex(col)), 16, "0")


# ------------------------------------------------------------------------- report text
def humanise(col: Column) -> Column:
    words = F.lower(F.replace(F.coalesce(col, F.lit("")), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def lookup(table: dict[str, str], col: Column, default: Column) -> Column:
    out = default
    for code, text in table.items():
        out = F.when(col == code, F.lit(text)).otherwise(out)
    return out


def label(vocabulary: str, col: Column, empty: str = "") -> Column:
    known = lookup(vocab.LABELS.get(vocabulary, {}), col, humanise(col))
    return F.when(col.isNull() | (col == ""), F.lit(empty)).otherwise(known)


def severity_marker(col: Column) -> Column:
    return F.when(col.isNull() | (col == ""), F.lit("")) \
        .otherwise(lookup(vocab.SEVERITY_MARKER, col, F.lit("[?  ]")))


def tone(col: Column) -> Column:
    return F.when(col.isin(vocab.DISPLAY_SEVERITIES), F.lower(col)).otherwise(F.lit("unknown"))


def posture_tone(col: Column) -> Column:
    return F.when(col.isin(list(vocab.LABELS["posture"])), F.lower(col)) \
        .otherwise(F.lit("unknown"))


def frame_label(lo: Column, hi: Column, n: Column) -> Column:
    """`#4`, a contiguous run `#4–#9`, or `#4 +3` for scattered frames."""
    hash_lo = F.concat(F.lit("#"), lo.cast("string"))
    return (F.when(F.coalesce(n, F.lit(0)) == 0, F.lit("—"))
            .when(n == 1, hash_lo)
            .when(hi - lo + 1 == n, F.concat(hash_lo, F.lit("–#"), hi.cast("string")))
            .otherwise(F.concat(hash_lo, F.lit(" +"), (n - 1).cast("string"))))


def number_text(col: Column) -> Column:
    """Two decimals at most, trailing zeros dropped."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", col), r"0+$", ""),
                            r"\.$", "")


def percent_text(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("Not present in assessment")) \
        .otherwise(F.format_string("%.1f%%", col * 100.0))


def clip(col: Column, limit: int = vocab.MAX_CLIP) -> Column:
    """A short form for display; keep the text itself beside it."""
    return F.when(F.length(col) <= limit, col) \
        .otherwise(F.concat(F.substring(col, 1, limit), F.lit(" […truncated]")))
