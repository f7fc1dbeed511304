"""Document to shard routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shard_of(doc_id: Column, num_shards: int) -> Column:
    """First eight bytes of the id's MD5, read as an unsigned number, modulo the shard count.

    The value needs 64 unsigned bits, so it is held as a decimal: a signed long gives other
    shards unless the count is a power of two.
    """
    if num_shards == 1:
        return F.lit(0)
    head = F.conv(F.substring(F.md5(doc_id), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(num_shards)).cast("int")
