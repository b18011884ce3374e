"""Small codes beside geometry: sizes, sortable ids, one-time passwords, blurred images, commits."""

from __future__ import annotations

import base64
import hashlib
import hmac
import math
import struct
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G

#: Names of binary sizes, and the alphabet of blurred images.
SIZES = ("KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB")
BASE83 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz#$%*+,-.:;=?@[]^_{|}~"
HASHES = {"sha1": hashlib.sha1, "sha256": hashlib.sha256, "sha512": hashlib.sha512}


def size_text(size) -> Column:
    """A number of bytes to read: whole under 1024, then two decimals under 10 of a unit, else one."""
    v = G.number(size)
    n = F.abs(v)
    # the unit by comparison, not by a logarithm that may round the wrong way
    text = F.lit("(too large to display)")
    for i in range(len(SIZES), 0, -1):
        part = n / float(1024**i)
        # ties go to the even digit
        digits = lambda k: F.bround(part.cast("decimal(38,18)"), k).cast(f"decimal(38,{k})").cast("string")  # noqa: E731, B023
        shown = F.concat(F.when(part < 10, digits(2)).otherwise(digits(1)), F.lit(f" {SIZES[i - 1]}"))
        text = F.when(n < float(1024 ** (i + 1)), shown).otherwise(text)
    text = F.when(n < 1024, F.concat(F.floor(n).cast("string"), F.lit(" B"))).otherwise(text)
    odd = F.when(F.isnan(v), "(nan)").when(v == math.inf, "(inf)").when(v == -math.inf, "(-inf)")
    return F.when(v.isNotNull(), F.coalesce(odd, F.concat(F.when((v < 0) & (n < float(1024 ** (len(SIZES) + 1))), "-").otherwise(""), text)))


# --- sortable ids ------------------------------------------------------------------------------


def sortable_id(timestamp, sequence) -> Column:
    """64 bits: milliseconds since 1970 above 16 bits of a sequence number."""
    return F.shiftleft(F.unix_millis(G.col(timestamp)), 16).bitwiseOR(G.col(sequence).cast("long").bitwiseAND(F.lit(0xFFFF)))


def sortable_ids(df, name: str, timestamp: Column | None = None):
    """df with a column of ids without gaps from one moment on: rows beyond 65,536 take the next milliseconds, so ids made later than that many milliseconds are larger.

    Rows are counted by partition first, so df must give the same partitions when it is read again.
    """
    n = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}  # a row a partition
    before, at = [], 0
    for p in range(max(n, default=-1) + 1):
        before.append(at)
        at += n.get(p, 0)
    start = F.unix_millis(F.current_timestamp() if timestamp is None else timestamp)
    row = F.get(F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<bigint>"), F.spark_partition_id()) + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumn(name, F.shiftleft(start, 16) + row)


def sortable_id_millis(c) -> Column:
    return F.shiftrightunsigned(G.col(c).cast("long"), 16)


# --- one-time passwords ------------------------------------------------------------------------


def totp_window(seconds, step: int = 30, t0: int = 0) -> Column:
    """The number of the time step that holds a moment in seconds."""
    return F.floor((G.number(seconds) - t0) / step).cast("long")


def totp_code(secret: bytes, window: int, digits: int = 6, algorithm: str = "sha1") -> str:
    digest = hmac.new(secret, struct.pack(">Q", window), HASHES[algorithm]).digest()
    at = digest[-1] & 15
    number = struct.unpack(">I", digest[at : at + 4])[0] & 0x7FFFFFFF
    return str(number % 10**digits).zfill(digits)


def secret_bytes(text: str) -> bytes:
    """A base32 secret, spaces, dashes and missing padding allowed."""
    plain = text.replace(" ", "").replace("-", "").rstrip("=").upper()
    return base64.b32decode(plain + "=" * (-len(plain) % 8))


def totp_generate(secret, window, *, digits: int = 6, algorithm: str = "sha1") -> Column:
    """The code of a base32 secret in a time step."""

    @F.pandas_udf("string")
    def made(secrets: pd.Series, windows: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or pd.isna(w) else totp_code(secret_bytes(s), int(w), digits, algorithm) for s, w in zip(secrets, windows)], dtype=object)

    return made(G.col(secret), G.col(window).cast("long"))


def totp_verify(secret, code, window, *, digits: int = 6, algorithm: str = "sha1", around: int = 1) -> Column:
    """Whether a code fits its time step or one of `around` steps before or after."""

    @F.pandas_udf("boolean")
    def fits(secrets: pd.Series, codes: pd.Series, windows: pd.Series) -> pd.Series:
        out = []
        for s, c, w in zip(secrets, codes, windows):
            if s is None or c is None or pd.isna(w):
                out.append(None)
                continue
            key = secret_bytes(s)
            out.append(any(hmac.compare_digest(totp_code(key, int(w) + i, digits, algorithm), c) for i in range(-around, around + 1) if w + i >= 0))
        return pd.Series(out, dtype=object)

    return fits(G.col(secret), G.col(code).cast("string"), G.col(window).cast("long"))


# --- blurred images ----------------------------------------------------------------------------


def _digits83(value: int, n: int) -> str:
    return "".join(BASE83[value // 83**i % 83] for i in range(n - 1, -1, -1))


def _linear(c: np.ndarray) -> np.ndarray:
    c = c / 255.0
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def _srgb(c: np.ndarray) -> np.ndarray:
    c = np.clip(c, 0.0, 1.0)
    return np.floor(np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055) * 255 + 0.5).astype(int)


def _waves(n: int, size: int) -> np.ndarray:
    return np.cos(np.pi * np.arange(n)[:, None] * np.arange(size)[None, :] / size)


def blur_encode(pixels: bytes, width: int, height: int, nx: int = 4, ny: int = 3) -> str:
    """Cosine components of an image of RGB bytes, row by row, in 83 letters."""
    if not (1 <= nx <= 9 and 1 <= ny <= 9) or len(pixels) != width * height * 3:
        raise ValueError("an image of width x height x 3 bytes and 1 to 9 components a side are needed")
    image = _linear(np.frombuffer(pixels, np.uint8).reshape(height, width, 3).astype(np.float64))
    parts = np.einsum("jy,ix,yxc->jic", _waves(ny, height), _waves(nx, width), image) / (width * height)
    parts *= 2.0
    parts[0, 0] /= 2.0
    flat = parts.reshape(-1, 3)
    dc = _srgb(flat[0])
    out = _digits83(nx - 1 + (ny - 1) * 9, 1)
    most = float(np.abs(flat[1:]).max()) if len(flat) > 1 else 0.0
    scale = max(0, min(82, math.floor(most * 166 - 0.5))) if len(flat) > 1 else 0
    out += _digits83(scale, 1) + _digits83(int(dc[0]) * 65536 + int(dc[1]) * 256 + int(dc[2]), 4)
    top = (scale + 1) / 166 if len(flat) > 1 else 1.0
    for part in flat[1:]:
        q = np.clip(np.floor(np.sign(part / top) * np.sqrt(np.abs(part / top)) * 9 + 9.5), 0, 18).astype(int)
        out += _digits83(int(q[0]) * 361 + int(q[1]) * 19 + int(q[2]), 2)
    return out


def blur_decode(text: str, width: int, height: int, punch: float = 1.0) -> bytes:
    """The blurred image of RGB bytes that a code stands for."""
    value = lambda s: int(sum(BASE83.index(c) * 83**i for i, c in enumerate(reversed(s))))
    sides = value(text[0])
    nx, ny = sides % 9 + 1, sides // 9 + 1
    if len(text) != 4 + 2 * nx * ny:
        raise ValueError("the code's length doesn't fit its number of components")
    top = (value(text[1]) + 1) / 166 * punch
    dc = value(text[2:6])
    parts = [_linear(np.array([dc >> 16, dc >> 8 & 255, dc & 255], float))]
    for i in range(1, nx * ny):
        v = value(text[4 + 2 * i : 6 + 2 * i])
        q = np.array([v // 361, v // 19 % 19, v % 19]) / 9 - 1
        parts.append(np.sign(q) * q * q * top)
    image = np.einsum("jy,ix,jic->yxc", _waves(ny, height), _waves(nx, width), np.array(parts).reshape(ny, nx, 3))
    return _srgb(image).astype(np.uint8).tobytes()


def blurhash_encode(pixels, width, height, *, nx: int = 4, ny: int = 3) -> Column:
    @F.pandas_udf("string")
    def made(p: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else blur_encode(bytes(x), int(a), int(b), nx, ny) for x, a, b in zip(p, w, h)], dtype=object)

    return made(G.col(pixels), G.col(width), G.col(height))


def blurhash_decode(code, width, height, *, punch: float = 1.0) -> Column:
    @F.pandas_udf("binary")
    def made(c: pd.Series, w: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else blur_decode(x.strip(), int(a), int(b), punch) for x, a, b in zip(c, w, h)], dtype=object)

    return made(G.col(code), G.col(width), G.col(height))


# --- on the driver -----------------------------------------------------------------------------


class LRU:
    """A bounded mapping that forgets what was used longest ago."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity, self._items = capacity, OrderedDict()

    def get(self, key, default=None):
        if key not in self._items:
            return default
        self._items.move_to_end(key)
        return self._items[key]

    def peek(self, key, default=None):
        """As get, but it doesn't count as use."""
        return self._items.get(key, default)

    def put(self, key, value) -> None:
        self._items[key] = value
        self._items.move_to_end(key)
        if len(self._items) > self.capacity:
            self._items.popitem(last=False)

    def popitem(self):
        """The item used longest ago, taken out."""
        return self._items.popitem(last=False)

    def pop(self, key, default=None):
        return self._items.pop(key, default)

    def clear(self) -> None:
        self._items.clear()

    def __getitem__(self, key):
        if key not in self._items:
            raise KeyError(key)
        return self.get(key)

    __setitem__ = put

    def __contains__(self, key) -> bool:
        return key in self._items

    def __len__(self) -> int:
        return len(self._items)

    def __iter__(self) -> Iterator:
        return iter(self._items)


def head_commit(git_dir: str = ".git") -> str:
    """The commit that a working tree is at."""
    top = Path(git_dir).resolve()
    head = (top / "HEAD").read_text().strip()
    if not head.startswith("ref: "):
        return head
    ref = (top / head[5:]).resolve()
    if not ref.is_relative_to(top):
        raise ValueError("HEAD points outside of its folder")
    return ref.read_text().strip()
