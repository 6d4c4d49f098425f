"""Reusable Column expressions.

Everything here is a built-in Spark SQL expression, so it stays inside
whole-stage code generation; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word pattern (letters and digits of any script; never
# ``\w``, which is ASCII-only in both Spark and DuckDB), the word-boundary
# marker used by the sub-word codec, and the unknown-piece surface form.
WORD_PATTERN = r"[\p{L}\p{N}]+"
SPACE_MARK = "▁"  # "▁"
UNK_SURFACE = " ⁇ "  # " ⁇ "


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def md5_key(seed, *parts) -> Column:
    """md5 of ``seed:part1:part2…`` — the deterministic random source."""
    cols = [F.lit(str(seed))] + [_c(p).cast("string") for p in parts]
    return F.md5(F.concat_ws(":", *cols))


def md5_uniform(hex_col: Column) -> Column:
    """First 8 hex digits of an md5 as a uniform double in [0, 1)."""
    return F.conv(F.substring(hex_col, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def ids_digest(ids) -> Column:
    """Order-sensitive digest of an id list (md5 of the comma-joined ids)."""
    return F.md5(F.array_join(_c(ids), ","))


def round6(x) -> Column:
    return F.round(_c(x), 6)


def normalise_ws(text) -> Column:
    """Collapse whitespace, strip the ends, mark word starts with ``▁``.

    ``"  A  b\\nc "`` → ``"▁A▁b▁c"``; a blank text becomes ``''``.
    """
    t = F.trim(F.regexp_replace(_c(text), r"\s+", " "))
    return F.when(t == "", F.lit("")).otherwise(
        F.concat(F.lit(SPACE_MARK), F.replace(t, F.lit(" "), F.lit(SPACE_MARK))))


def words_of(text) -> Column:
    """Lower-cased letter/digit words of a text, in order."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD_PATTERN), F.lit(0))


def pad_or_cut_expr(ids, seq_len: int, pad_id: int) -> Column:
    """Pad to ``seq_len + 1`` or keep the first ``seq_len + 1`` ids.

    Long rows lose their tail (and with it eos), as in the original loader.
    """
    ids = _c(ids)
    width = seq_len + 1
    return F.concat(
        F.slice(ids, 1, width),
        F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.lit(width) - F.size(ids))),
    )


def once(value: Column, made) -> Column:
    """``made(value)``, ``value`` being computed once however often it is used there."""
    return F.element_at(F.transform(F.array(value), made), 1)


# Element types that an id list is moved in, with the largest id of each.
_NARROW = {"tinyint": 127, "smallint": 32767}


def pack_ids(ids) -> Column:
    """An id list to be moved, in the narrowest element type that holds all its
    ids; a list that neither byte nor short holds is kept as it is, in ``raw``."""
    def fields(v: Column) -> Column:
        fits, out = F.lit(False), []
        for kind, top in _NARROW.items():
            now = F.coalesce((v["low"] >= -top - 1) & (v["high"] <= top), F.lit(True))
            out.append(F.when(now & ~fits, v["ids"].cast(f"array<{kind}>")).alias(kind))
            fits = now
        return F.struct(*out, F.when(~fits, v["ids"]).alias("raw"))

    seen = once(_c(ids), lambda v: F.struct(v.alias("ids"), F.array_min(v).alias("low"), F.array_max(v).alias("high")))
    return once(seen, fields)


def unpack_ids(packed: Column, kind) -> Column:
    """The list (of type ``kind``) that ``pack_ids`` packed."""
    return F.coalesce(*[packed[k].cast(kind) for k in _NARROW], packed["raw"])
