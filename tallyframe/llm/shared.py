"""Helpers the operators share: words, span hashes and Arrow batches."""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# Fixed odd constants of the 64-bit mixing function (splitmix64).
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)


def mix64(values: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values, one to one."""
    z = values + STEP
    z = (z ^ (z >> np.uint64(30))) * MIX_1
    z = (z ^ (z >> np.uint64(27))) * MIX_2
    return z ^ (z >> np.uint64(31))


class SpanHasher:
    """Hashes of many spans of one sequence in constant time each.

    Symbols are scrambled, weighted by powers of an odd base modulo 2^64 and summed; a span's hash
    is a difference of two sums, shifted back by the inverse power, so it does not depend on where
    the span stands.
    """

    def __init__(self, base: int = 0x5851F42D4C957F2D):
        self.base = base % 2**64
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, size: int) -> None:
        if size <= len(self.powers):
            return
        size = max(size, 2 * len(self.powers), 4096)

        def table(factor):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            return np.cumprod(steps)

        self.powers = table(self.base)
        self.inverses = table(pow(self.base, -1, 2**64))

    def sums(self, symbols: np.ndarray) -> np.ndarray:
        """Running weighted sums of unsigned 64-bit symbols, with a leading zero."""
        self._grow(len(symbols) + 1)
        out = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * self.powers[: len(symbols)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((sums[ends] - sums[starts]) * self.inverses[starts])


# Scrambled value of each byte.
BYTE_CODES = mix64(np.arange(256, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def ascii_words(text: str | None) -> bytes:
    """UTF-8 text with A-Z lower-cased and its words, runs outside [\\x20\\x09-\\x0D], set apart by
    one space. Only those six characters separate words; letters beyond ASCII stay as they are."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())


def word_spans(words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of ``ascii_words`` with the start and end of every word."""
    codes = np.frombuffer(words, np.uint8)
    if not len(codes):
        return codes, np.zeros(0, np.int64), np.zeros(0, np.int64)
    gaps = np.flatnonzero(codes == 32)
    return codes, np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(codes)]))


def shingle_hashes(hasher: SpanHasher, text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's ``width``-word shingles.

    A text of fewer words has one shingle, its whole word sequence; no words, no shingle.
    """
    codes, starts, ends = word_spans(ascii_words(text))
    if not len(starts):
        return np.zeros(0, np.uint64)
    last = max(len(starts) - width + 1, 1)
    sums = hasher.sums(BYTE_CODES[codes])
    return np.unique(hasher.spans(sums, starts[:last], ends[min(width, len(ends)) - 1 :][:last]))


def map_rows(
    df: DataFrame,
    schema: str,
    make: Callable[[], Callable[[pa.RecordBatch], dict]],
) -> DataFrame:
    """Map Arrow batches to columns. ``make`` runs once in each task and returns the function that
    turns a batch into a dict of column name to values."""
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(fields)
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                columns = work(batch.slice(start, 512))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], f.type) for f in target], schema=target
                )

    return df.mapInArrow(run, fields)
