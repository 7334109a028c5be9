"""File names of a store directory: built, and parsed."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.errors import InvalidArgument

LOG, LOCK, TABLE, DESCRIPTOR, CURRENT, TEMP, INFO_LOG = "log", "lock", "table", "descriptor", "current", "temp", "info_log"
_SUFFIX = {"log": LOG, "sst": TABLE, "ldb": TABLE, "dbtmp": TEMP}
_PLAIN = {"CURRENT": CURRENT, "LOCK": LOCK, "LOG": INFO_LOG, "LOG.old": INFO_LOG}
_LIMIT = 1 << 64
_NUMBERED = re.compile(r"([0-9]+)\.(log|sst|ldb|dbtmp)", re.A)
_MANIFEST = re.compile(r"MANIFEST-\+?([0-9]+)", re.A)


def _positive(number: int) -> int:
    if number <= 0:
        raise InvalidArgument("a file number must be positive")
    return number


def log_name(db: str, number: int) -> str:
    return f"{db}/{_positive(number):06d}.log"


def table_name(db: str, number: int) -> str:
    return f"{db}/{_positive(number):06d}.ldb"


def old_table_name(db: str, number: int) -> str:
    return f"{db}/{_positive(number):06d}.sst"


def descriptor_name(db: str, number: int) -> str:
    return f"{db}/MANIFEST-{_positive(number)}"


def temp_name(db: str, number: int) -> str:
    return f"{db}/{number:06d}.dbtmp"


def current_name(db: str) -> str:
    return f"{db}/CURRENT"


def lock_name(db: str) -> str:
    return f"{db}/LOCK"


def info_log_name(db: str) -> str:
    return f"{db}/LOG"


def old_info_log_name(db: str) -> str:
    return f"{db}/LOG.old"


def parse(name: str) -> tuple[int, str] | None:
    """Number and kind of a file's name (without its directory), or None."""
    if name in _PLAIN:
        return 0, _PLAIN[name]
    if m := _MANIFEST.fullmatch(name):
        found = int(m[1]), DESCRIPTOR
    elif m := _NUMBERED.fullmatch(name):
        found = int(m[1]), _SUFFIX[m[2]]
    else:
        return None
    return found if found[0] < _LIMIT else None


def parse_col(name: Column) -> Column:
    """Struct (number ``DECIMAL(20,0)``, file_type), null where the name isn't one of ours."""
    manifest = F.regexp_extract(name, r"^MANIFEST-\+?([0-9]+)\z", 1)
    digits = F.regexp_extract(name, r"^([0-9]+)\.(?:log|sst|ldb|dbtmp)\z", 1)
    suffix = F.regexp_extract(name, r"^[0-9]+\.(log|sst|ldb|dbtmp)\z", 1)
    plain = F.create_map(*[F.lit(x) for pair in _PLAIN.items() for x in pair])
    kinds = F.create_map(*[F.lit(x) for pair in _SUFFIX.items() for x in pair])
    text = F.regexp_replace(F.when(manifest != "", manifest).when(digits != "", digits), "^0+(?=[0-9])", "")
    # 20 digits fit the decimal; more can't be below 2^64
    number = F.when(F.length(text) <= 20, text.cast("decimal(20,0)"))
    fits = number < F.lit(str(_LIMIT)).cast("decimal(20,0)")
    zero = F.lit(0).cast("decimal(20,0)")
    return (
        F.when(F.try_element_at(plain, name).isNotNull(), F.struct(zero.alias("number"), F.try_element_at(plain, name).alias("file_type")))
        .when(fits & (manifest != ""), F.struct(number.alias("number"), F.lit(DESCRIPTOR).alias("file_type")))
        .when(fits & (digits != ""), F.struct(number.alias("number"), F.try_element_at(kinds, suffix).alias("file_type")))
    )


def numbered_col(db: str, number: Column, suffix: str) -> Column:
    """Six digits at least, or ``MANIFEST-n`` for the descriptor; numbers below one raise except for temp files."""
    n = number.cast("decimal(20,0)").cast("string")
    padded = F.when(F.length(n) < 6, F.lpad(n, 6, "0")).otherwise(n)
    made = F.concat(F.lit(f"{db}/MANIFEST-"), n) if suffix == "MANIFEST" else F.concat(F.lit(f"{db}/"), padded, F.lit(f".{suffix}"))
    if suffix == "dbtmp":
        return made
    return F.when(number > 0, made).otherwise(F.raise_error(F.lit("InvalidArgument: a file number must be positive")).cast("string"))
