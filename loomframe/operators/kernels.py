"""Recurrences that feed on their own output: native folds where one value is carried, Arrow functions per stream else."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lift_inverse(residuals: Column) -> Column:
    """Values from residuals of the running predictor: the mean, cut towards zero, of at most three values before."""

    def step(out: Column, r: Column) -> Column:
        last = F.slice(out, F.greatest(F.size(out) - 2, F.lit(1)), F.least(F.size(out), F.lit(3)))
        total = F.aggregate(last, F.lit(0).cast("long"), lambda s, v: s + v)
        n = F.size(last).cast("long")
        mean = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.round((total - total % n) / n).cast("long"))
        return F.concat(out, F.array(mean + r))

    return F.aggregate(residuals, F.array().cast("array<long>"), step)


def xorshift(seed: Column, steps: int) -> Column:
    """The state of a 32-bit xorshift generator (13, 17, 5) after so many steps."""
    mask = 0xFFFFFFFF
    x = seed.cast("long")
    for _ in range(steps):
        x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(mask)
        x = x.bitwiseXOR(F.shiftrightunsigned(x, 17))
        x = x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(mask)
    return x


def picture_number(frame_num: int, current: int, modulus: int) -> int:
    return frame_num - modulus if frame_num > current else frame_num


def reference_buffers(pictures: DataFrame, max_refs: int, log2_max: int = 4) -> DataFrame:
    """The reference buffer after each picture (stream, seq, frame_num, is_idr, is_ref): short-term numbers, newest first.

    An IDR picture empties it; a reference picture takes the place of one with its number, else the buffer first
    slides: the picture of least picture number goes while it is full.
    """
    modulus = 1 << log2_max

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        held: list[int] = []
        rows = []
        for stream, seq, number, idr, ref in group.sort_values("seq")[["stream", "seq", "frame_num", "is_idr", "is_ref"]].itertuples(index=False):
            if idr:
                held = [number] if ref else []
            elif ref:
                held = [x for x in held if x != number]
                while len(held) >= max(1, max_refs):
                    held.remove(min(held, key=lambda x: picture_number(x, number, modulus)))
                held.insert(0, number)
            rows.append((stream, seq, list(held)))
        return pd.DataFrame(rows, columns=["stream", "seq", "held"])

    return pictures.groupBy("stream").applyInPandas(fold, "stream long, seq long, held array<long>")


# --- range coding with static models

SCALE_BITS = 12
LOWER = 1 << 23


def frequencies(counts: Sequence[int]) -> np.ndarray:
    """Counts scaled to a sum of 2^12, at least 1 for each symbol that occurs, by largest remainders."""
    counts = np.asarray(counts, np.float64)
    total = 1 << SCALE_BITS
    exact = counts / counts.sum() * total
    out = np.where(counts > 0, np.maximum(1, np.floor(exact)), 0).astype(np.int64)
    order = np.argsort(-(exact - np.floor(exact)), kind="stable")
    k = 0
    while out.sum() != total:
        s = order[k % len(order)]
        if counts[s] > 0 and (out.sum() < total or out[s] > 1):
            out[s] += 1 if out.sum() < total else -1
        k += 1
    return out


def rans_encode(symbols: bytes, freq: np.ndarray) -> bytes:
    """Bytes, last first, then the final state: asymmetric numeral systems with 32-bit state and byte renewal."""
    first = np.concatenate([[0], np.cumsum(freq)]).tolist()
    freq = freq.tolist()
    state, out = LOWER, bytearray()
    for s in reversed(symbols):
        most = ((LOWER >> SCALE_BITS) << 8) * freq[s]
        while state >= most:
            out.append(state & 255)
            state >>= 8
        state = ((state // freq[s]) << SCALE_BITS) + state % freq[s] + first[s]
    return state.to_bytes(4, "big") + bytes(reversed(out))


def rans_decode(data: bytes, n: int, freq: np.ndarray) -> bytes:
    first = np.concatenate([[0], np.cumsum(freq)])
    symbol = np.repeat(np.arange(len(freq)), freq).tolist()
    first, freq = first.tolist(), freq.tolist()
    state, at, out = int.from_bytes(data[:4], "big"), 4, bytearray()
    for _ in range(n):
        low = state & ((1 << SCALE_BITS) - 1)
        s = symbol[low]
        out.append(s)
        state = freq[s] * (state >> SCALE_BITS) + low - first[s]
        while state < LOWER and at < len(data):
            state = (state << 8) | data[at]
            at += 1
    return bytes(out)


def coded_planes(planes: DataFrame, width: str = "width") -> DataFrame:
    """Planes (id, width, data) coded without loss: gradient residuals, a static model each, range-coded; with a CRC-32 of the plane."""
    import zlib

    def code(batches):
        for pdf in batches:
            rows = []
            for ident, w, data in zip(pdf["id"], pdf[width], pdf["data"]):
                residual = predicted(np.frombuffer(data, np.uint8), int(w))
                freq = frequencies(np.bincount(residual, minlength=256)) if len(residual) else np.zeros(256, np.int64)
                rows.append((ident, int(w), len(data), zlib.crc32(data), freq.tolist(), rans_encode(residual.tobytes(), freq) if len(residual) else b""))
            yield pd.DataFrame(rows, columns=["id", "width", "n", "crc", "freq", "code"])

    return planes.select("id", width, "data").mapInPandas(code, "id long, width int, n int, crc long, freq array<long>, code binary")


def decoded_planes(coded: DataFrame) -> DataFrame:
    """The planes again; a checksum that differs is an error."""
    import zlib

    def decode(batches):
        for pdf in batches:
            rows = []
            for ident, w, n, crc, freq, code in zip(pdf["id"], pdf["width"], pdf["n"], pdf["crc"], pdf["freq"], pdf["code"]):
                residual = np.frombuffer(rans_decode(code, int(n), np.asarray(freq)), np.uint8) if n else np.empty(0, np.uint8)
                data = restored(residual, int(w)).tobytes()
                if zlib.crc32(data) != crc:
                    raise ValueError(f"plane {ident}: the checksum differs")
                rows.append((ident, data))
            yield pd.DataFrame(rows, columns=["id", "data"])

    return coded.mapInPandas(decode, "id long, data binary")


def _guess(left: int, up: int, corner: int) -> int:
    p = left + up - corner
    return left if p < left else up if p > up else p


def predicted(plane: np.ndarray, width: int) -> np.ndarray:
    """Residuals modulo 256 of the gradient predictor; the last row may be short."""
    x = plane.astype(np.int64)
    n = len(x)
    at = np.arange(n)
    left, up, corner = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left[1:] = x[:-1]
    up[width:] = x[:-width] if n > width else x[:0]
    corner[width + 1 :] = x[: -width - 1] if n > width + 1 else x[:0]
    p = left + up - corner
    guess = np.where(p < left, left, np.where(p > up, up, p))
    guess = np.where(at % width == 0, np.where(at < width, 0, up), np.where(at < width, left, guess))
    return ((x - guess) & 255).astype(np.uint8)


def restored(residual: np.ndarray, width: int) -> np.ndarray:
    out, r = [0] * len(residual), residual.tolist()
    for k in range(len(r)):
        col, row = k % width, k >= width
        guess = (out[k - width] if row else 0) if col == 0 else out[k - 1] if not row else _guess(out[k - 1], out[k - width], out[k - width - 1])
        out[k] = (r[k] + guess) & 255
    return np.array(out, np.uint8)


def plane_checksums(planes: DataFrame, data: str = "data", bit_depth: str = "bit_depth") -> DataFrame:
    """Rows with ``checksum``: CRC-32 of the bytes, or for samples of 16 bits and more the 64-bit one, as a number with sign; null for null."""
    from loomframe.sources.messages import mixed_crc64

    @F.pandas_udf("long")
    def wide(column: pd.Series) -> pd.Series:
        signed = lambda v: v - (1 << 64) if v >> 63 else v
        return pd.Series([None if x is None else signed(mixed_crc64(bytes(x))) for x in column], dtype="Int64")

    deep = F.col(bit_depth) >= 16
    return planes.withColumn("checksum", F.when(deep, wide(F.when(deep, F.col(data)))).otherwise(F.crc32(data)))
