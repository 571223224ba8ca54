"""Whitening of vectors by exact integer moments: digit slices multiplied by BLAS.

Vectors become whole numbers. Their moments are sums of products of whole numbers, which
float64 matrix products give exactly as long as no sum passes 2 ** 53: the numbers are cut
into limbs of LIMB bits and multiplied in blocks of ROWS rows. Limb products are put
together as big integers, split into digits, and added up by Spark; only one matrix a
vector length, of whatever number of rows, comes to the driver to be decomposed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isohyet.llm.common import table
from isohyet.shipping import map_arrow

#: Bits of a limb and rows of a block: 2 * LIMB + log2(ROWS) is 53.
LIMB, ROWS = 20, 8192
#: Bits of a digit that Spark adds up.
DIGIT = 32
#: Whole numbers beyond this are not used, nor are their rows.
MOST = 2**62


def whole_numbers(flat: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * c) as 64-bit numbers, and which of them are finite and fit."""
    with np.errstate(invalid="ignore", over="ignore"):
        v = np.floor(flat * float(scale))
        ok = np.abs(v) < MOST
    return np.where(ok, v, 0).astype(np.int64), ok


def _keys(df: DataFrame, column: str, scale: int) -> DataFrame:
    """vec_id and the vector's whole numbers in a binary: its first byte says how many
    bytes each has (the fewest that do), so equal vectors have equal binaries."""

    def run(batches):
        for b in batches:
            lists = b.column(1)
            there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
            lists = lists.take(pa.array(there))
            start = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            x, ok = whole_numbers(flat.to_numpy(zero_copy_only=False).astype(float), scale)
            ok &= flat.is_valid().to_numpy(zero_copy_only=False)
            bad = np.concatenate([[0], np.cumsum(~ok)])
            keep, keys = [], []
            for row, (a, z) in enumerate(zip(start[:-1], start[1:], strict=True)):
                if bad[z] == bad[a]:
                    v = x[a:z]
                    big = int(np.abs(v).max()) if z > a else 0
                    width = 2 if big < 2**15 else 4 if big < 2**31 else 8
                    keep.append(there[row])
                    keys.append(bytes([width]) + v.astype(f"<i{width}").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(keys, pa.binary())], ["vec_id", "key"])

    rows = df.select("vec_id", F.col(column).cast("array<double>").alias("v"))
    return map_arrow(rows, run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, key binary")


def _blocks(batches, column: int = 0):
    """(length, whole numbers as a matrix, rows of the batch) of the keys of each batch,
    by length, in blocks of ROWS."""
    for b in batches:
        keys = b.column(column).to_pylist()
        by: dict[tuple[int, int], list[int]] = {}
        for i, k in enumerate(keys):
            by.setdefault((len(k), k[0]), []).append(i)
        for (size, width), rows in by.items():
            for at in range(0, len(rows), ROWS):
                some = rows[at : at + ROWS]
                x = np.frombuffer(b"".join(keys[i][1:] for i in some), f"<i{width}").astype(np.int64)
                yield b, (size - 1) // width, x.reshape(len(some), (size - 1) // width), np.array(some)


def limbs(y: np.ndarray, n: int) -> list[np.ndarray]:
    """y (64-bit or Python numbers) as n limbs in float64, the last one signed."""
    out = []
    for i in range(n):
        out.append((y if i == n - 1 else y & ((1 << LIMB) - 1)).astype(np.float64))
        y = y >> LIMB
    return out


def exact_gram(y: np.ndarray, bits: int) -> np.ndarray:
    """The products y.T @ y as Python numbers; |y| has at most so many bits."""
    n = bits // LIMB + 1
    parts, total = limbs(y, n), 0
    for s in range(2 * n - 1):
        for i in range(max(0, s - n + 1), min(s, n - 1) + 1):
            product = parts[i].T @ parts[s - i]  # exact: each sum stays below 2 ** 53
            total = total + (product.astype(np.int64).astype(object) << (LIMB * s))
    return total


def _centred(x: np.ndarray, n: int, sums: list[int], bits: int) -> np.ndarray:
    """n * x - sums, as 64-bit numbers where they fit, else as Python numbers."""
    if bits < 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _digits(values: np.ndarray, n: int) -> np.ndarray:
    """Python numbers as n digits each (one row a digit) of 64 bits, the last signed."""
    out = np.empty((n, len(values)), np.int64)
    for i in range(n):
        out[i] = values if i == n - 1 else values & ((1 << DIGIT) - 1)
        values = values >> DIGIT
    return out


def _added(rows: DataFrame) -> dict[tuple[int, int], list[int]]:
    """(length, line): the sums over all tasks of a line's Python numbers. rows: size,
    line, n (numbers in the line), digits (n for each digit, one digit after the other)."""
    sums = rows.select("size", "line", "n", F.posexplode("digits").alias("at", "v")).groupBy("size", "line", "n", "at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    out: dict[tuple[int, int], list[int]] = {}
    for r in sums.collect():  # length ** 2 numbers a length, whatever the number of rows
        line = out.setdefault((r["size"], r["line"]), [0] * r["n"])
        line[r["at"] % r["n"]] += int(r["v"]) << (DIGIT * (r["at"] // r["n"]))
    return out


_LINES = "size int, line int, n int, digits array<bigint>"


def _line(size: int, line: int, values: np.ndarray, digits: int) -> tuple:
    return size, line, len(values), _digits(values, digits).ravel()


def _rows(lines: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*lines, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64()))], ["size", "line", "n", "digits"])


def _first_moments(fit: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """Of each length: rows, sums by dimension, and the bits of the largest number."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        most: dict[int, int] = {}
        for _, size, x, _ in _blocks(batches):
            low, high = x & ((1 << DIGIT) - 1), x >> DIGIT
            s = low.sum(0).astype(object) + (high.sum(0).astype(object) << DIGIT)
            total[size] = total.get(size, 0) + np.append(s, len(x)).astype(object)
            most[size] = max(most.get(size, 0), int(np.abs(x).max()) if x.size else 0)
        lines = [_line(size, 0, t, 4) for size, t in total.items()]
        # of the largest number only its bits are wanted: one count for each
        lines += [_line(size, 1, np.array([int(m.bit_length() == i) for i in range(64)], object), 1) for size, m in most.items()]
        if lines:
            yield _rows(lines)

    found = _added(map_arrow(fit, run, _LINES))
    return {size: (v[-1], v[:-1], max(i for i, c in enumerate(found[size, 1]) if c)) for (size, line), v in found.items() if line == 0}


def _second_moments(fit: DataFrame, first: dict) -> dict[int, list[list[int]]]:
    """Of each length the exact sums of products of n * x - sums."""
    bits = {size: (n * 2 ** (b + 1)).bit_length() for size, (n, _, b) in first.items()}
    digits = {size: (2 * b + first[size][0].bit_length()) // DIGIT + 2 for size, b in bits.items()}

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for _, size, x, _ in _blocks(batches):
            n, sums, _ = first[size]
            total[size] = total.get(size, 0) + exact_gram(_centred(x, n, sums, bits[size]), bits[size])
        lines = [_line(size, i, t[i, i:], digits[size]) for size, t in total.items() for i in range(size)]
        for at in range(0, len(lines), 256):
            yield _rows(lines[at : at + 256])

    return {size: [found[size, i] for i in range(size)] for found in [_added(map_arrow(fit, run, _LINES))] for size in first if size}


def decompose(n: int, upper: list[list[int]], components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit eigenvectors (columns), eigenvalues and shares of the trace, by falling
    eigenvalue, of the covariance whose exact products are given; the entry of a vector
    that is largest in size is positive."""
    d = len(upper)
    v = np.zeros((d, d))
    for i, line in enumerate(upper):
        v[i, i:] = [g / n**3 for g in line]  # whole numbers divided: rounded once
    v = v + np.triu(v, 1).T
    e, w = np.linalg.eigh(v)
    e, w = e[::-1][:components], w[:, ::-1][:, :components]
    w = w * np.sign(w[np.abs(w).argmax(0), np.arange(w.shape[1])])
    trace = np.trace(v)
    # a value that rounding alone can make is none
    e = np.where(e > d * np.finfo(float).eps * max(trace, 0), e, 0.0)
    return w, e, e / trace if trace > 0 else np.zeros(len(e))


def whiten(vectors: DataFrame, components: int = 4, scale: int = 256, column: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: for each
    vector and each of the first components its score, divided by the component's standard
    deviation.

    A vector's whole numbers x are floor(scale * entry). Moments count each distinct x
    once: n of them with sums S and the covariance of x (divisor n), which is exact until
    it is rounded to be decomposed. deviation is the sum of (n * x - S) ** 2, exact
    (decimal; null beyond 38 digits); explained the component's share of the variance; identity_error the largest
    entry, by size, of the scores' covariance over the n less the identity.

    Vectors of each length are whitened by themselves. Rows whose vector is null or holds
    a null or non-finite entry, or one beyond 2 ** 62 when scaled, are left out, and so
    are empty vectors; repeated rows each give their rows. A component without variance
    (one distinct vector, or fewer than its number) has no score (null). No rows, no
    result. Other columns are ignored."""
    rows = table(_keys(vectors, column, scale), "whole-numbers")
    fit = table(rows.select("key").distinct(), "distinct-vectors")
    first = _first_moments(fit)
    second = _second_moments(fit, first)
    bits = {size: (n * 2 ** (b + 1)).bit_length() for size, (n, _, b) in first.items()}
    model = {size: decompose(first[size][0], upper, components) for size, upper in second.items()}

    def scores(size: int, y: np.ndarray) -> np.ndarray:
        w, e, _ = model[size]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(e > 0, (y.astype(float) / first[size][0]) @ w / np.sqrt(e), np.nan)

    def products(batches):
        total: dict[int, np.ndarray] = {}
        for _, size, x, _ in _blocks(batches):
            if size in model:
                z = scores(size, _centred(x, *first[size][:2], bits[size]))
                z = np.column_stack([np.ones(len(z)), z])
                total[size] = total.get(size, 0) + z.T @ z
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.int32()), pa.array([t.ravel() for t in total.values()], pa.list_(pa.float64()))], ["size", "v"])

    found = map_arrow(fit, products, "size int, v array<double>").select("size", F.posexplode("v").alias("at", "v")).groupBy("size", "at").agg(F.sum("v").alias("v")).collect()
    error: dict[int, float] = {}
    for size in model:
        t = np.zeros((len(model[size][1]) + 1) ** 2)
        for r in found:
            if r["size"] == size:
                t[r["at"]] = r["v"]
        t = t.reshape(len(model[size][1]) + 1, -1) / first[size][0]
        off = np.abs(t[1:, 1:] - np.outer(t[0, 1:], t[0, 1:]) - np.eye(len(t) - 1))
        error[size] = float(np.nanmax(off)) if np.isfinite(off).any() else np.nan

    def out(batches):
        kind = pa.decimal128(38, 0)
        for b, size, x, some in _blocks(batches, 1):
            if size not in model:
                continue
            n, sums, _ = first[size]
            y = _centred(x, n, sums, bits[size])
            fits = 2 * bits[size] + size.bit_length() < 63
            deviation = (y**2).sum(1) if fits else (y.astype(object) ** 2).sum(1)
            _, e, share = model[size]
            k = len(e)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(np.repeat(some, k))),
                pa.array(np.tile(np.arange(1, k + 1), len(some)), pa.int32()),
                pa.array(np.full(len(some) * k, n), pa.int64()),
                pa.array([int(v) if v < 10**38 else None for v in np.repeat(deviation, k)], kind),
                pa.array(scores(size, y).ravel(), from_pandas=True),
                pa.array(np.tile(share, len(some))),
                pa.array(np.full(len(some) * k, error[size]), from_pandas=True),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return map_arrow(rows, out, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
