"""A Bloom filter as a table: which keys of a partition may have been there before.

A partition's filter is ``words`` words of 64 bits; a key sets four bits in each of
two words.  Rows are (partition columns, ``word``, ``bits``) of words that are not
empty, so filters of any size are built, merged and asked by Spark, and none
passes through the driver.  A key that was put in is always found; of others one in
some ten thousand is, while a filter is not overfull.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter per key, at most keys.
KEY_BITS = 24
LEAST_WORDS = 1 << 10
# A filter that is built anew has room for as many times its keys.
GROWTH = 4


def room(words: int) -> int:
    """Keys that a filter takes."""
    return words * 64 // KEY_BITS


def words_for(keys: int) -> int:
    words = LEAST_WORDS
    while room(words) < keys:
        words *= 2
    return words


def _probes(key: str, words: Column) -> list[tuple[Column, Column]]:
    """Word and bits of a key, twice; the word goes by low bits of a hash, bits by higher ones."""
    probes = []
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), key)
        bits = None
        for place in (32, 38, 44, 50):
            at = F.shiftrightunsigned(h, place).bitwiseAND(F.lit(63)).cast("int")
            bit = F.call_function("shiftleft", F.lit(1).cast("long"), at)
            bits = bit if bits is None else bits.bitwiseOR(bit)
        probes.append((F.pmod(h, words), bits))
    return probes


def filter_rows(keys: DataFrame, key: str, part: list[str], sizes: DataFrame) -> DataFrame:
    """Filter of the keys; ``sizes`` has the ``words`` of each partition, a row each."""
    sized = keys.filter(F.col(key).isNotNull()).select(*part, key).join(F.broadcast(sizes), part)
    probes = F.array(*[F.struct(word.alias("word"), bits.alias("bits"))
                       for word, bits in _probes(key, F.col("words"))])
    return merged(sized.select(*part, F.inline(probes)), part)


def merged(rows: DataFrame, part: list[str]) -> DataFrame:
    """One row per word of filters of equal size put together."""
    return rows.groupBy(*part, "word").agg(F.bit_or("bits").alias("bits"))


def suspected(rows: DataFrame, key: str, part: list[str], filters: DataFrame, sizes: DataFrame) -> DataFrame:
    """``rows`` and whether their key may be in the filter of their partition already.

    Partitions without a size have no filter, and rows without a key cannot be told.
    """
    asked = rows.join(F.broadcast(sizes), part, "left")
    for n, (word, bits) in enumerate(_probes(key, F.col("words"))):
        held = filters.select(*part, F.col("word").alias(f"_word{n}"), F.col("bits").alias(f"_held{n}"))
        asked = asked.withColumns({f"_word{n}": word, f"_bits{n}": bits}).join(
            held, [*part, f"_word{n}"], "left")
    hit = F.lit(True)
    for n in range(2):
        hit = hit & (F.col(f"_held{n}").bitwiseAND(F.col(f"_bits{n}")) == F.col(f"_bits{n}"))
    return asked.select(*rows.columns, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False)).alias("suspected"))
