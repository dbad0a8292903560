"""External keys, their hashes and document ids."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

MODES = ("none", "sha1_64", "blake2b64", "xxhash64", "python")


@F.arrow_udf(StringType())
def _blake2(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else hashlib.blake2b(t.encode(), digest_size=8).hexdigest() for t in text.to_pylist()], pa.string())


def missing(key: Column) -> Column:
    """Null and empty keys are missing; 0 is a key."""
    return key.isNull() | (key == "")


def hash_key(key: Column, mode: str = "none", prefix: str = "") -> Column:
    """A key as it is, or 64 bits of its hash as 16 hexadecimal digits behind a prefix.

    python: that language's own hash differs between processes, so executors would
    disagree; xxHash takes its place, under the same name.
    """
    if mode not in MODES:
        raise ValueError(f"unknown hash mode: {mode}")
    if mode == "none":
        return key
    xxhash = lambda: F.lpad(F.lower(F.hex(F.xxhash64(key))), 16, "0")
    hashed = {
        "sha1_64": lambda: F.substring(F.sha1(key.cast("binary")), 1, 16),
        "blake2b64": lambda: _blake2(key),
        "xxhash64": xxhash,
        "python": xxhash,
    }[mode]()
    return F.concat(F.lit(prefix), hashed)


def doc_id(key: Column, position: Column | None = None) -> Column:
    """The document id, as text, of a key: whole numbers in canonical form, else 63 bits of BLAKE2b.

    A null key has the id of the hash of its position, and null without one.
    """
    hashed = F.conv(_blake2(key if position is None else F.coalesce(key, position.cast("string"))), 16, 10).cast("decimal(20,0)")
    return F.when(F.trim(key).rlike(r"^[+-]?\d{1,18}$"), F.regexp_replace(F.trim(key), r"^\+", "").cast("long").cast("string")).otherwise((hashed % F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long").cast("string"))


def next_id(ids: Column) -> Column:
    """Aggregate: one more than the largest whole-number id; 1 without any."""
    return F.coalesce(F.max(F.when(ids.rlike(r"^\d{1,18}$"), ids.cast("long"))) + 1, F.lit(1).cast("long"))
