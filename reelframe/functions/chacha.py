"""ChaCha20 (RFC 8439) with the counter at zero again for every 1,024 bytes, as some segments are coded.

The key stream of a row's key and nonce is 16 blocks, computed for some hundred
rows at once; its bytes repeat over the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Bytes after which the counter starts anew, and the blocks of the key stream that are.
CHUNK = 1_024
BLOCKS = CHUNK // 64
#: Rows that are worked on at once: their key streams take some kilobytes each, whatever the size of an Arrow batch.
ROWS = 256
#: Fixed values of the cipher: "expand 32-byte k", and the words that each quarter round mixes.
CONSTANTS = np.frombuffer(b"expand 32-byte k", "<u4")
COLUMNS, DIAGONALS = ((0, 1, 2, 3), (4, 5, 6, 7), (8, 9, 10, 11), (12, 13, 14, 15)), ((0, 1, 2, 3), (5, 6, 7, 4), (10, 11, 8, 9), (15, 12, 13, 14))


def turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint32(n)) | (x >> np.uint32(32 - n))


def key_streams(keys: np.ndarray, nonces: np.ndarray, blocks: int = BLOCKS, counter: int = 0) -> np.ndarray:
    """(rows, 64 * blocks) bytes from keys (rows, 32) and nonces (rows, 12)."""
    rows = len(keys)
    state = np.empty((16, rows, blocks), np.uint32)
    state[:4] = CONSTANTS[:, None, None]
    state[4:12] = np.ascontiguousarray(keys).view("<u4").T[:, :, None]
    state[12] = np.arange(counter, counter + blocks, dtype=np.uint32)
    state[13:] = np.ascontiguousarray(nonces).view("<u4").T[:, :, None]
    x = state.copy()
    for _ in range(10):
        for lanes in (COLUMNS, DIAGONALS):
            # the four quarter rounds at once
            a, b, c, d = (x[list(lane)] for lane in lanes)
            a += b
            d = turned(d ^ a, 16)
            c += d
            b = turned(b ^ c, 12)
            a += b
            d = turned(d ^ a, 8)
            c += d
            b = turned(b ^ c, 7)
            for lane, value in zip(lanes, (a, b, c, d)):
                x[list(lane)] = value
    return np.ascontiguousarray((x + state).transpose(1, 2, 0)).astype("<u4").view(np.uint8).reshape(rows, 64 * blocks)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, so many at a time at most."""
    return (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS))


def coded(df: DataFrame, data: str = "data", key: str = "key", nonce: str = "nonce", out: str = "coded") -> DataFrame:
    """df with `out`: data coded or decoded by key and nonce, which is the same.

    A key has 32 bytes, a nonce 12, or 8 that come after four zeros. For other
    lengths, and where one of the three is null, out is null. No rows give no rows.
    """
    kept = df.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values = [batch.column(c).to_pylist() for c in (data, key, nonce)]
            good = [i for i, (d, k, n) in enumerate(zip(*values)) if d is not None and k is not None and n is not None and len(k) == 32 and len(n) in (8, 12)]
            result: list[bytes | None] = [None] * batch.num_rows
            if good:
                keys = np.frombuffer(b"".join(values[1][i] for i in good), np.uint8).reshape(-1, 32)
                nonces = np.frombuffer(b"".join(values[2][i].rjust(12, b"\0") for i in good), np.uint8).reshape(-1, 12)
                for i, stream in zip(good, key_streams(keys, nonces)):
                    plain = np.frombuffer(values[0][i], np.uint8)
                    result[i] = (plain ^ np.resize(stream, len(plain))).tobytes() if len(plain) else b""
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.binary())], [*batch.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))
