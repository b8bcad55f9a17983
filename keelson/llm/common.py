"""What the text operators share: Arrow chunks, code-point arrays, word hashes and tables in the shared folder.

Texts are handled as one array of code points for a whole chunk of rows, so a feature of every
character or word is a numpy operation over the chunk instead of a loop over texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from keelson.plans.lineage import discard, fresh_path, materialize, shared_dir  # noqa: F401

ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()), "array<double>": pa.list_(pa.float64()),
}
CHUNK = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl: str) -> pa.Schema:
    fields = [f.strip().split(" ", 1) for f in ddl.split(",")]
    return pa.schema([(n, ARROW[t.strip()]) for n, t in fields])


def map_chunks(df: DataFrame, fn: Callable[[dict[str, list]], dict], schema: str, size_by: str = "text", limit: int = CHUNK) -> DataFrame:
    """fn over slices of rows whose `size_by` texts together have about `limit` bytes (one row at least)."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(size_by))), 0).to_numpy(zero_copy_only=False)
            ends, start = np.cumsum(sizes, dtype=np.int64), 0
            while start < n:
                before = int(ends[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
                made = fn(batch.slice(start, stop - start).to_pydict())
                got = pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)
                if got.num_rows:
                    yield got
                start = stop

    return df.mapInArrow(run, schema)


def slices(texts: list[str | None], limit: int = 200_000) -> Iterator[slice]:
    """Consecutive slices of about `limit` characters, one text at least: numpy arrays take a hundred times a text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield slice(start, i)
            start, size = i, 0
        size += len(t or "")
    if start < len(texts):
        yield slice(start, len(texts))


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each text starts (one more entry than texts)."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that spreads every bit."""
    x = np.atleast_1d(np.asarray(x, np.uint64))  # arrays wrap around silently, scalars warn
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C55
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse, modulo 2**64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 2 * CHUNK)
        out = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[:] = out
    return _powers[0], _powers[1]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end] for many spans by one prefix sum of a polynomial."""
    p, inverse = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(0x1F123BB5)) * np.uint64(0xD6E8FEB86659FD93) * p[: len(codes)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def is_space(codes: np.ndarray) -> np.ndarray:
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs where `inside` holds, never across texts: starts, ends and the text of each."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def ascii_lower(codes: np.ndarray) -> np.ndarray:
    return np.where((codes >= 65) & (codes <= 90), codes + 32, codes)


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]], empty ranges included."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
