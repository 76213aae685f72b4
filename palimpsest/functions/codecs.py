"""Keys with versions, sizes of records, file names, checksums and hashes, as column functions.

Nulls give nulls. Everything but the two checksums of whole values is a built-in expression; those two are Arrow-batched."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Castagnoli polynomial, reversed; seed and multiplier of the 32-bit hash: fixed values of the format.
CASTAGNOLI, HASH_SEED, HASH_MULTIPLIER = 0x82F63B78, 0xBC9F1D34, 0xC6A4A793
#: Bytes of a version behind a key.
VERSION_BYTES = 8


def encode_key(key: Column, version: Column) -> Column:
    """Bytes that sort by key, then newest version first within a key."""
    return F.concat(F.encode(key, "utf-8"), F.unhex(F.lpad(F.hex(F.bitwise_not(version)), 2 * VERSION_BYTES, "0")))


def parse_version(internal: Column) -> Column:
    """The version behind a key; 0 where there is no room for one and a key."""
    suffix = F.conv(F.hex(F.substring(internal, -VERSION_BYTES, VERSION_BYTES)), 16, 10).cast("decimal(20,0)")
    return F.when(F.octet_length(internal) <= VERSION_BYTES, 0).otherwise((F.lit(str(2**64 - 1)).cast("decimal(20,0)") - suffix).cast("long"))


def parse_key(internal: Column) -> Column:
    """The key before the version; what is shorter than a version is a key as it is."""
    short = F.octet_length(internal) < VERSION_BYTES
    return F.when(short, internal).otherwise(internal.substr(F.lit(1), F.octet_length(internal) - VERSION_BYTES))


def varint_bytes(x: Column) -> Column:
    """Bytes of a number of 0 or more, seven bits each."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("long")


def record_bytes(key_bytes: Column, value_bytes: Column, expires_at: Column) -> Column:
    """Bytes of a record: meta, varints of the two lengths and of the expiry, key with version, value, checksum."""
    return 1 + varint_bytes(key_bytes + VERSION_BYTES) + varint_bytes(value_bytes) + varint_bytes(expires_at) + key_bytes + VERSION_BYTES + value_bytes + 4


def encode_pointer(length: Column, offset: Column, fid: Column) -> Column:
    """A value pointer: three 32-bit numbers, the low byte first."""
    swapped = lambda x: F.concat(*[F.substring(F.lpad(F.hex(x), 8, "0"), i, 2) for i in (7, 5, 3, 1)])
    return F.unhex(F.concat(swapped(length), swapped(offset), swapped(fid)))


def decode_pointer(pointer: Column) -> Column:
    """length, offset, fid of a value pointer."""
    number = lambda at: F.conv(F.concat(*[F.hex(F.substring(pointer, at + i, 1)) for i in (3, 2, 1, 0)]), 16, 10).cast("long")
    return F.struct(number(1).alias("length"), number(5).alias("offset"), number(9).alias("fid"))


def file_name(fid: Column, kind: str = "sst") -> Column:
    return F.format_string(f"%05d.{kind}", fid)


def _matrix(values: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of bytes by length, shortest first: order, padded bytes, lengths."""
    raw = [b"" if v is None else bytes(v) for v in values]
    sizes = np.array([len(x) for x in raw], np.int64)
    out = np.zeros((len(raw), int(sizes.max(initial=0))), np.uint8)
    for i, x in enumerate(raw):
        out[i, : len(x)] = np.frombuffer(x, np.uint8)
    return out, sizes, np.array([v is None for v in values])


def crc32c_of(values: pd.Series) -> pd.Series:
    """CRC-32 with the Castagnoli polynomial of each value's bytes; a place of all values at a time."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(CASTAGNOLI), steps >> 1)
    data, sizes, null = _matrix(values)
    crc = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for i in range(data.shape[1]):
        live = sizes > i
        crc[live] = steps[(crc[live] ^ data[live, i]) & 0xFF] ^ (crc[live] >> 8)
    return pd.Series((crc ^ np.uint32(0xFFFFFFFF)).astype(np.int64)).astype("Int64").mask(null)


def hash32_of(values: pd.Series) -> pd.Series:
    """The 32-bit hash of Bloom filters: words of four bytes are mixed in, then the one to three bytes that are left."""
    data, sizes, null = _matrix(values)
    m = np.uint32(HASH_MULTIPLIER)
    h = np.uint32(HASH_SEED) ^ (sizes.astype(np.uint32) * m)
    wide = np.pad(data, ((0, 0), (0, -data.shape[1] % 4))).view("<u4") if data.size else np.zeros((len(data), 0), np.uint32)
    for i in range(wide.shape[1]):
        whole = sizes >= 4 * (i + 1)
        mixed = (h + wide[:, i]) * m
        left = np.where(4 * i < sizes, np.minimum(sizes - 4 * i, 3), 0)
        tail = (h + wide[:, i]) * m  # bytes beyond the value are 0
        h = np.where(whole, mixed ^ (mixed >> np.uint32(16)), np.where(left > 0, tail ^ (tail >> np.uint32(24)), h))
    return pd.Series(h.astype(np.int64)).astype("Int64").mask(null)


def crc32c(value: Column) -> Column:
    return F.pandas_udf(crc32c_of, "long")(value)


def hash32(value: Column) -> Column:
    return F.pandas_udf(hash32_of, "long")(value)
