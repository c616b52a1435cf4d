"""Contiguous shards of near equal bytes, cut from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortrank.llm.common import materialise, with_global_order


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row into one of n_shards runs of the order (text checksum, size, id), cut at equal byte targets.

    A row belongs to the shard in which its first byte falls, so shards differ by one row's size at most.
    Equal texts are neighbours in that order: a group of copies stays in one shard unless a cut falls inside
    it, and a group larger than a shard is spread over as many as it fills.

    Returns id_col, size (UTF-8 bytes of the text plus 8; 8 for a null text), text_crc32 (0 for a null or empty
    text), shard and slot (0, 1, 2... within the shard). Repeated rows each keep a slot of their own; an empty
    table gives no rows. Texts of any length count whole. Other columns do not come along.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    sized = materialise(
        docs.select(F.col(id_col), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32")), "sizes"
    )
    ordered, _, total = with_global_order(sized, ["text_crc32", "size", id_col], "size")
    placed = ordered.withColumn("shard", F.floor(F.col("_before") * n_shards / max(total, 1)).cast("int"))
    first = placed.groupBy("shard").agg(F.min("_index").alias("_first"))  # one row a shard
    return placed.join(F.broadcast(first), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("_index") - F.col("_first")).alias("slot")
    )
