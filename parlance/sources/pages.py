"""Pages of Ogg files: a row per page of a binary file, packets within and across pages, durations.

A page that is damaged is a row with ``error``: nothing tells where the next one begins, so it is its
file's last. A checksum that differs doesn't end a file. The walk is a table function of each
file's bytes; all else is done with columns and windows over a file's pages.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values
MAGIC, HEADER, HEAD_MAGIC, RATE = b"OggS", 27, b"OpusHead", 48_000
CONTINUED, FIRST, LAST = 1, 2, 4
HEAD_DEFAULTS = {"channels": 1, "pre_skip": 0, "sample_rate": 48_000}
# end of fixed values

PAGE = "page int, at long, flags int, granule long, serial long, sequence long, crc_good boolean, lacing array<int>, payload binary, error string"
_TURNED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def checksum(data: bytes) -> int:
    """CRC-32 of the polynomial 04C11DB7, neither reflected nor inverted: that of bytes and result turned
    round, without the inversions that the usual one has."""
    plain = zlib.crc32(data.translate(_TURNED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{plain:032b}"[::-1], 2)


class Pages:
    """Table function: the pages of a file's bytes."""

    def eval(self, content: bytes):
        data, at, n = bytes(content or b""), 0, 0
        while at < len(data):
            wrong = self._wrong(data, at)
            if wrong:
                yield (n, at, *[None] * 7, wrong)
                return
            body = at + HEADER + data[at + 26]
            lacing = list(data[at + HEADER : body])
            end = body + sum(lacing)
            flags, granule, serial, sequence, crc = struct.unpack_from("<xBqIII", data, at + 4)
            good = checksum(data[at : at + 22] + bytes(4) + data[at + 26 : end]) == crc
            yield n, at, flags, granule, serial, sequence, good, lacing, data[body:end], None
            at, n = end, n + 1

    @staticmethod
    def _wrong(data: bytes, at: int) -> str | None:
        if data[at : at + 4] != MAGIC:
            return "not a page"
        if at + HEADER > len(data):
            return "the header is cut"
        body = at + HEADER + data[at + 26]
        if body > len(data):
            return "the lacing is cut"
        if body + sum(data[at + HEADER : body]) > len(data):
            return "the payload is cut"
        return None


def read(spark: SparkSession, path: str, kind: str = "*.{ogg,opus}") -> DataFrame:
    """path, content of binary files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", kind).load(path).select("path", "content")


def pages(files: DataFrame) -> DataFrame:
    """path, page, at, flags, granule, serial, sequence, crc_good, lacing, payload, error of files (path, content)."""
    walk = F.udtf(Pages, returnType=PAGE)
    return files.select("path", "content").lateralJoin(walk(F.col("content").outer())).drop("content")


def _pieces(found: DataFrame) -> DataFrame:
    """path, serial, page, piece, data, ends: what the lacing values of a page cut; the last one may not end."""
    order = Window.partitionBy("path", "serial", "page").orderBy("i")
    each = found.where("error is null").select("path", "serial", "page", "flags", "payload", F.posexplode("lacing").alias("i", "size"))
    closed = F.when(F.col("size") < 255, 1).otherwise(0)
    placed = each.withColumns({"piece": F.coalesce(F.sum(closed).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "closed": closed, "start": F.sum("size").over(order) - F.col("size")})
    cut = placed.groupBy("path", "serial", "page", "piece").agg(F.any_value("flags").alias("flags"), F.any_value("payload").alias("p"), F.min("start").alias("start"), F.sum("size").alias("size"), F.max("closed").alias("ends"))
    return cut.select("path", "serial", "page", "flags", "piece", F.expr("substring(p, cast(start as int) + 1, cast(size as int))").alias("data"), (F.col("ends") == 1).alias("ends"))


def page_packets(found: DataFrame) -> DataFrame:
    """path, serial, page, packet, data: packets as a reader sees them that keeps nothing between pages: what a page
    doesn't end is a packet too. Empty ones are dropped."""
    return _pieces(found).where("octet_length(data) > 0").select("path", "serial", "page", F.col("piece").alias("packet"), "data")


def packets(found: DataFrame) -> DataFrame:
    """path, serial, packet, page, data, whole: packets that may go on over pages; page: where one begins.

    Not whole: one whose beginning is missing (the first of a stream that goes on from before, or after a page that
    didn't end it), or that the stream's last page doesn't end.
    """
    order = Window.partitionBy("path", "serial").orderBy("page", "piece")
    before = F.lag("ends", 1, True).over(order)
    joins = (F.col("piece") == 0) & F.col("flags").bitwiseAND(CONTINUED).cast("boolean")
    rows = _pieces(found).withColumns({"joined": joins & ~before, "orphan": joins & before})
    rows = rows.withColumn("packet", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(order) - 1)
    parts = F.array_sort(F.collect_list(F.struct("page", "piece", F.hex("data").alias("h"))))
    grouped = rows.groupBy("path", "serial", "packet").agg(F.min("page").alias("page"), F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")).alias("data"), (F.max("ends") & ~F.max("orphan")).alias("whole"))
    return grouped.where("octet_length(data) > 0")


def heads(found: DataFrame) -> DataFrame:
    """path, channels, pre_skip, sample_rate, valid: from each file's first page, or the defaults."""
    first = found.where("page = 0").withColumn("h", F.hex(F.coalesce("payload", F.lit(b""))))
    valid = (F.octet_length("payload") >= 19) & F.col("h").startswith(HEAD_MAGIC.hex().upper())
    number = lambda at, size: F.conv(F.concat(*[F.substring("h", (at + i) * 2 + 1, 2) for i in range(size - 1, -1, -1)]), 16, 10).cast("long")
    fields = {"channels": number(9, 1), "pre_skip": number(10, 2), "sample_rate": number(12, 4)}
    told = first.withColumn("valid", F.coalesce(valid, F.lit(False)))
    return told.select("path", *[F.when(F.col("valid"), v).otherwise(HEAD_DEFAULTS[k]).alias(k) for k, v in fields.items()], "valid")


def durations(found: DataFrame) -> DataFrame:
    """path, seconds, ended, bad_crc, error: from the last page's position without the head's skip, 0 at least; whether a
    page ends the stream; pages of another checksum; the error of a damaged file, of which good pages count."""
    last = F.max_by("granule", F.when(F.col("error").isNull() & (F.col("granule") >= 0), F.col("page")))
    ended = F.coalesce(F.max(F.col("flags").bitwiseAND(LAST) > 0), F.lit(False))
    sums = found.groupBy("path").agg(last.alias("granule"), ended.alias("ended"), F.count_if(~F.col("crc_good")).alias("bad_crc"), F.max("error").alias("error"))
    skip = F.coalesce("pre_skip", F.lit(0))
    return sums.join(heads(found), "path", "left").select("path", F.when(F.col("granule").isNotNull(), F.greatest(F.col("granule") - skip, F.lit(0)) / RATE).alias("seconds"), "ended", "bad_crc", "error")
