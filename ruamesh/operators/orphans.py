"""References to records that do not exist: a Bloom filter of the parent keys, then an exact join of the rest.

The filter is blocked: a key hashes to one 64-bit word and to ``BITS`` bits in it, so that building it is one
map-side combined aggregation, all in the JVM. It has 16 bits a key, whatever their number. Its words travel as dense
arrays, 8 bytes a word, and at most ``MAX_WORDS`` (64 MB) at once: more keys are parted by hash, each part with a
filter of its own. What the filter rejects is surely an orphan. The others meet their parents exactly, by key and day,
so that no key's rows gather in one task.

Defined results: null references are no orphans; a reference without a time is an orphan when its key has no record
at all; a record without a load time was always there; repeated rows come once; empty parents make every reference
an orphan. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruamesh.common import cut

MAX_WORDS = 1 << 23
#: Keys to a word of 64 bits; words to an array.
PER_WORD, CHUNK = 4, 1 << 10
BITS = 5


def _word(key: Column, words: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(0)), F.lit(words))


def _bits(key: Column) -> Column:
    """``BITS`` bits of 64, from six bits of a hash each."""
    h = F.xxhash64(key, F.lit(1))
    out = None
    for i in range(BITS):
        one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        out = one if out is None else out.bitwiseOR(one)
    return out


def filter_words(n: int) -> int:
    """Words that a filter of n keys has: a power of two."""
    return 1 << max(4, (-(-n // PER_WORD) - 1).bit_length())


def bloom(keys: DataFrame, column: str, words: int) -> DataFrame:
    """(_rm_chunk, _rm_filter) of the filter over a column: every word, ``CHUNK`` to an array."""
    k = F.col(column).cast("bigint")
    empty = keys.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    set_ = keys.filter(k.isNotNull()).select(_word(k, words).alias("w"), _bits(k).alias("b"))
    each = set_.unionByName(empty).groupBy("w").agg(F.bit_or("b").alias("b"))
    arrays = each.groupBy(F.floor(F.col("w") / CHUNK).alias("_rm_chunk")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("all"))  # CHUNK entries
    return arrays.select("_rm_chunk", F.col("all.b").alias("_rm_filter"))


def probe(rows: DataFrame, column: str, keys: DataFrame, key: str, n: int, max_words: int = MAX_WORDS) -> DataFrame:
    """``rows`` with _rm_maybe: whether the key may be among ``keys`` (n of them); false is certain."""
    parts = -(-filter_words(n) // max_words)
    words = min(filter_words(n), max_words)
    k, out = F.col(column).cast("bigint"), None
    part = lambda c: F.pmod(F.xxhash64(c, F.lit(2)), F.lit(parts))
    for p in range(parts):
        mine, theirs = (rows, keys) if parts == 1 else (rows.filter(part(k) == p), keys.filter(part(F.col(key).cast("bigint")) == p))
        word = _word(k, words)
        hit = F.element_at("_rm_filter", (F.pmod(word, F.lit(CHUNK)) + 1).cast("int")).bitwiseAND(_bits(k)) == _bits(k)
        one = mine.withColumn("_rm_chunk", F.floor(word / CHUNK)).join(F.broadcast(bloom(theirs, key, words)), "_rm_chunk").withColumn("_rm_maybe", hit).drop("_rm_chunk", "_rm_filter")
        out = one if out is None else out.unionByName(one)
    return out


def orphans(refs: DataFrame, ref: str, key: str, at: str, parents: DataFrame, parent_key: str, loaded: str, deleted: str | None = None) -> DataFrame:
    """(row_key, at) of the references without a record at their time.

    A record is there from ``loaded`` (that moment included) until before ``deleted``.
    """
    far = F.lit("9999-12-31 00:00:00").cast("timestamp")
    never = F.lit("0001-01-01 00:00:00").cast("timestamp")
    rows = refs.select(F.col(ref).cast("bigint").alias("_rm_ref"), F.col(key).cast("bigint").alias("row_key"), F.col(at).cast("timestamp").alias("at")).filter("_rm_ref IS NOT NULL").distinct()
    # Copies of a record loaded at one time count once; without deletion only the first load matters.
    gone = F.coalesce(F.col(deleted).cast("timestamp"), far) if deleted else far
    there = parents.select(F.col(parent_key).cast("bigint").alias("_rm_ref"), F.coalesce(F.col(loaded).cast("timestamp"), never).alias("_rm_from"), gone.alias("_rm_to")).filter("_rm_ref IS NOT NULL")
    there = there.groupBy("_rm_ref", "_rm_from").agg(F.max("_rm_to").alias("_rm_to")) if deleted else there.groupBy("_rm_ref").agg(F.min("_rm_from").alias("_rm_from"), F.max("_rm_to").alias("_rm_to"))
    there = cut(there)
    probed = cut(probe(rows, "_rm_ref", there, "_rm_ref", there.count()))
    maybe = probed.filter("_rm_maybe").drop("_rm_maybe")
    # Time decides by running maxima: a record is there at t when the latest end among those loaded until t is later.
    # Keys are cut by day, so a hot key is many groups; what earlier days leave over comes from one row a key and day.
    timed = maybe.filter("at IS NOT NULL")
    known = there.join(maybe.select("_rm_ref").distinct(), "_rm_ref", "left_semi")
    line = timed.select("_rm_ref", F.to_date("at").alias("_rm_day"), F.col("at").alias("_rm_t"), F.lit(1).alias("_rm_kind"), "row_key", F.lit(None).cast("timestamp").alias("_rm_to"))
    line = line.unionByName(known.select("_rm_ref", F.to_date("_rm_from").alias("_rm_day"), F.col("_rm_from").alias("_rm_t"), F.lit(0).alias("_rm_kind"), F.lit(None).cast("bigint").alias("row_key"), "_rm_to"))
    so_far = W.partitionBy("_rm_ref", "_rm_day").orderBy("_rm_t", "_rm_kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    days = line.groupBy("_rm_ref", "_rm_day").agg(F.max("_rm_to").alias("_rm_end"))
    before = W.partitionBy("_rm_ref").orderBy("_rm_day").rowsBetween(W.unboundedPreceding, -1)
    days = days.withColumn("_rm_left", F.max("_rm_end").over(before)).drop("_rm_end")
    judged = line.withColumn("_rm_now", F.max("_rm_to").over(so_far)).filter("_rm_kind = 1").join(days, ["_rm_ref", "_rm_day"])
    gone = judged.filter(~F.coalesce(F.greatest("_rm_now", "_rm_left") > F.col("_rm_t"), F.lit(False))).select("row_key", F.col("_rm_t").alias("at"))
    timeless = maybe.filter("at IS NULL").join(known.select("_rm_ref").distinct(), "_rm_ref", "left_anti").select("row_key", "at")
    return probed.filter(~F.col("_rm_maybe")).select("row_key", "at").unionByName(gone).unionByName(timeless)
