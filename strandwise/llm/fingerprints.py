"""Bit-difference fingerprints and their rotated block tables.

A fingerprint is the sign pattern of a weighted sum of pseudo-random +-1 vectors of its features. Its bits are cut
into blocks; table k holds the fingerprints rotated so that block k comes first, keyed by that block. Two
fingerprints that differ in few bits have some block in common, so a lookup reads one bucket per table.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS, BLOCKS = 20, 16
BITS = BLOCK_BITS * BLOCKS
#: Blocks in one 64-bit word of a stored fingerprint.
PER_WORD = 64 // BLOCK_BITS
WORDS = -(-BLOCKS // PER_WORD)


@lru_cache(50_000)
def _gram(gram: str) -> np.ndarray:
    """Pseudo-random +-1 of a gram; words share most of their grams."""
    bits = np.unpackbits(np.frombuffer(b"".join(xxhash.xxh3_64_digest(f"{k}{gram}") for k in range(BITS // 64)), dtype=np.uint8))
    return 2 * bits.view(np.int8) - 1


class Signer:
    """Fingerprints of weighted token lists; weighted vectors of tokens are kept, as words repeat."""

    def __init__(self, kept: int = 30_000) -> None:
        self._place: dict[tuple[str, float], int] = {}
        self._vectors = np.zeros((kept, BITS), dtype=np.float32)

    def _vector(self, token: str) -> np.ndarray:
        padded = f"^{token}$"
        grams = [token] if token[0].isdigit() or len(token) < 3 or " " in token else [padded[i : i + 3] for i in range(len(padded) - 2)]
        return np.array([_gram(g) for g in grams]).sum(0, dtype=np.int32).astype(np.float32)

    def _indexes(self, features: list[tuple[str, float]]) -> np.ndarray:
        for x in {x for x in features if x not in self._place}:
            at = len(self._place)
            self._place[x] = at
            self._vectors[at] = self._vector(x[0]) * x[1]
        return np.fromiter(map(self._place.__getitem__, features), dtype=np.int64, count=len(features))

    def sign(self, lists: list[list[tuple[str, float]]]) -> np.ndarray:
        """Bits [list, BITS]; an empty list gives zeros."""
        out = np.zeros((len(lists), BITS), dtype=bool)
        size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
        done = 0
        while done < len(lists):
            # a slice whose new tokens are sure to fit beside the kept ones
            to, n = done, 0
            while to < len(lists) and (to == done or n + len(lists[to]) <= 4_000):
                n += len(lists[to])
                to += 1
            if n > len(self._vectors) - len(self._place):
                self._place.clear()
                if n > len(self._vectors):
                    self._vectors = np.zeros((n, BITS), dtype=np.float32)
            at = self._indexes(list(chain.from_iterable(lists[done:to])))
            # the longest lists first, so that those that have an n-th token are the first ones
            order = np.argsort(-size[done:to], kind="stable")
            starts, sizes = (np.cumsum(size[done:to]) - size[done:to])[order], size[done:to][order]
            total = np.zeros((to - done, BITS), dtype=np.float32)
            for k in range(int(sizes[0])):
                m = int(np.searchsorted(-sizes, -k))
                total[:m] += self._vectors[at[starts[:m] + k]]
            out[done + order] = total > 0
            done = to
        return out


@lru_cache(1)
def kept_signer() -> Signer:
    """The signer of a worker, whose vectors serve one task after the other."""
    return Signer()


def packed(bits: np.ndarray) -> np.ndarray:
    """Fingerprints as 64-bit words, `PER_WORD` blocks in each: [fingerprint, WORDS]."""
    words = np.zeros((len(bits), WORDS, 64), dtype=bool)
    for k in range(BLOCKS):
        end = 64 - BLOCK_BITS * (k % PER_WORD)
        words[:, k // PER_WORD, end - BLOCK_BITS : end] = bits[:, k * BLOCK_BITS : (k + 1) * BLOCK_BITS]
    return np.packbits(words, axis=2).view(">i8").astype(np.int64).reshape(len(bits), WORDS)


def difference(a: Column, b: Column) -> Column:
    """Number of bits in which two packed fingerprints differ."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


#: Size of a map of keys, one bit for each value of their first bits: the same for every table.
MAP_BITS = 24


def first_bits(key: Column, n: int) -> Column:
    return F.shiftrightunsigned(key, 64 - n)


def _bit(key: Column) -> Column:
    return first_bits(key, MAP_BITS).bitwiseAND(63).cast("int")


def map_of(table: DataFrame, key: Column) -> DataFrame:
    """`(w, bits)`: which first bits occur among 64-bit keys, in words of 64; 2**18 rows at most."""
    one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(key))
    return table.groupBy(F.shiftright(first_bits(key, MAP_BITS), 6).alias("w")).agg(F.bit_or(one).alias("bits"))


def rows_of(words: DataFrame) -> DataFrame:
    """`(_row, _bits)`: a map in rows of 64 words, 2**12 rows at most, as each row of a broadcast takes several times a word."""
    row = words.groupBy(F.shiftright("w", 6).alias("_row")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("w").bitwiseAND(63).alias("at"), "bits"))).alias("m"))
    return row.select("_row", F.expr("transform(sequence(0L, 63L), i -> coalesce(try_element_at(m, i), 0L))").alias("_bits"))


def in_map(table: DataFrame, key: Column, words: DataFrame) -> DataFrame:
    """The rows whose key may be in the map, which goes to every task; none with a key of the map is lost."""
    columns = table.columns
    at = first_bits(F.col("_k"), MAP_BITS)
    hit = table.withColumn("_k", key).join(F.broadcast(rows_of(words)), F.shiftright(at, 12) == F.col("_row"))
    word = F.col("_bits")[F.shiftright(at, 6).bitwiseAND(63).cast("int")]
    return hit.where(F.call_function("shiftrightunsigned", word, _bit(F.col("_k"))).bitwiseAND(1) == 1).select(*columns)
