"""Exact duplicates by progressive refinement, in DataFrame functions only.

Texts are equal when identical after lower-casing A-Z. Three measures of a text, each
dearer than the one before, split the rows into ever smaller groups:

1. its length in bytes,
2. the hash of its first 128 code points,
3. the SHA-256 of the whole text.

The first scan counts rows per (length, prefix hash), partially on the map side. A row
goes on only if its length, then its length and prefix, occur at least twice; all others
are settled without reading on. The surviving pairs are noted in a bitmap of at most
2**27 bits (16 MB, whatever the input), which the second scan looks up before it hashes a
full text; a bit set by another pair only means one full hash more. Rows then meet by
(length, prefix, full hash) in counts combined on the map side and one join whose hot
groups adaptive execution splits; no group is ever gathered in one task. Texts are not
shuffled, unless the caller wants them carried along.

Defined results: null counts as the empty text; of equal texts the row with the largest
id stays, a null id being smaller than any other; of rows that repeat that id and text
exactly one stays; an empty table gives no rows. Further columns, of whatever name except
``keep_id``, ``group_size`` and ``kept``, are carried on request.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakebuild.llm.common import cut, text_of

PREFIX = 128
#: Bits of the bitmap: about 16 for each surviving pair, between these powers of two.
LEAST_BITS, MOST_BITS = 18, 27
_BUCKET = 32_768  # bits per row of bitmap_construct_agg
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)  # then lower() touches A-Z only, and is fast
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_hash(text: Column) -> Column:
    """Lowercase hex of the normalised text's SHA-256."""
    return F.sha2(ascii_lower(text), 256)


def surviving_pairs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(size, head) of every length and prefix hash that at least two rows share."""
    text = text_of(text_col)
    pairs = cut(docs.select(F.octet_length(text).alias("size"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))).alias("head"))
                .groupBy("size", "head").agg(F.count("*").alias("n")))
    lengths = pairs.groupBy("size").agg(F.sum("n").alias("of_size")).where("of_size > 1").select("size")
    return cut(pairs.join(lengths, "size", "left_semi").where("n > 1").select("size", "head"))


def _slot(size: Column, head: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(size, head), F.lit(1 << bits)) + 1


def survivor_bitmap(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The pairs as a bitmap (bucket, bitmap) of 2**bits bits, and bits."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * pairs.count()).bit_length()))
    slot = _slot(F.col("size"), F.col("head"), bits)
    return pairs.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap")), bits


def _bit(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substr(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")), F.lit(0)) == 1


def decisions(docs: DataFrame, carry: Sequence[str] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, ``carry``, keep_id, group_size, kept."""
    bitmap, bits = survivor_bitmap(surviving_pairs(docs, text_col))
    text = text_of(text_col)
    own = [F.col(id_col).alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(carry)]]
    sized = docs.select(*own, F.octet_length(text).alias("__size"), F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX))).alias("__head"), text.alias("__text"))
    slot = _slot(F.col("__size"), F.col("__head"), bits)
    marked = sized.withColumn("__slot", slot).join(F.broadcast(bitmap), F.bitmap_bucket_number("__slot") == F.col("bucket"), "left")
    again = _bit(F.col("bitmap"), F.bitmap_bit_position("__slot"))
    full = F.when(again, F.unhex(text_hash(F.col("__text"))))
    rows = cut(marked.select("__id", *[f"__c{i}" for i in range(len(carry))], "__size", "__head", full.alias("__full"),
                             F.monotonically_increasing_id().alias("__row")))
    key = ["__size", "__head", "__full"]
    # Written out, so that both sides of the join are plain shuffles and a hot group can be split.
    groups = cut(rows.where("__full is not null").groupBy(*key).agg(
        F.max(F.struct("__id", "__row")).alias("__last"), F.count("*").alias("__n")).where("__n > 1"))
    met = rows.alias("r").join(groups.alias("g"), [F.col(f"r.{k}") == F.col(f"g.{k}") for k in key], "left")
    single = F.col("__n").isNull()
    return met.select(F.col("__id").alias(id_col), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)],
                      F.when(single, F.col("__id")).otherwise(F.col("__last.__id")).alias("keep_id"),
                      F.coalesce("__n", F.lit(1)).cast("long").alias("group_size"),
                      (single | (F.col("__row") == F.col("__last.__row"))).alias("kept"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    spare = [f"__in{i}" for i in range(len(docs.columns))]
    got = decisions(docs.toDF(*spare), spare, spare[docs.columns.index(id_col)], spare[docs.columns.index(text_col)])
    return got.toDF("id", *spare, "keep_id", "group_size", "kept").where("kept").select(*spare).toDF(*docs.columns)


SQL = f"""
with d as (select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256,
             translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*)::bigint as group_size from d group by t)
select doc_id, keep_id, group_size,
  row_number() over (partition by d.t order by doc_id desc nulls last) = 1 as kept, text_sha256
from d join g on d.t = g.t"""
