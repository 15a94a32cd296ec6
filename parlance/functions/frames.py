"""Decoding of binary frames of a recorder's protocol, as columns: little-endian fields at fixed
places, all on the JVM. A decoder gives the fields and ``error``, null for a good frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.values import serial

# fixed values
FRAME, DATA_FRAME = 1, 2
FILE_LIST, SYNC_HEAD, SYNC_TAIL, RESUME, DELETED = 26, 28, 29, 22, 31
ENTRIES_AT = 11
EMPTY = 0xFFFFFFFF
CURSOR_PROJECTS, LATE_PROJECTS, SHORT_SERIAL = (901, 705), (888, 881), 10
# end of fixed values


def unsigned(raw: Column, at: Column | int, size: int) -> Column:
    """The little-endian whole number of ``size`` bytes at a place (from 0); null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(raw, at + 1, F.lit(size)))
    turned = F.concat(*[F.substring(digits, F.lit(i * 2 + 1), F.lit(2)) for i in range(size - 1, -1, -1)])
    return F.when(F.octet_length(raw) >= at + size, F.conv(turned, 16, 10).cast("long"))


def _is(raw: Column, opcode: int) -> Column:
    return (unsigned(raw, 0, 1) == FRAME) & (unsigned(raw, 1, 2) == opcode)


def _error(*rules: tuple[Column, str]) -> Column:
    found = F
    for ok, message in rules:
        found = found.when(~F.coalesce(ok, F.lit(False)), F.lit(message))
    return found.alias("error")


def entry_size(version: int) -> int:
    return 8 if version == 1 else 9 if 2 <= version <= 6 else 10


def file_list(frames: DataFrame, raw: str = "raw", version: int = 7) -> DataFrame:
    """``frames`` with stamp, totals, start, entries (session, size, attribute, scene) and error."""
    r, step = F.col(raw), entry_size(version)
    count = F.greatest(F.lit(0), F.floor((F.octet_length(r) - ENTRIES_AT) / step).cast("int"))

    def entry(i: Column) -> Column:
        at = F.lit(ENTRIES_AT) + i * step
        attribute = F.lit(0).cast("long") if step == 8 else unsigned(r, at + (8 if step == 9 else 9), 1)
        scene = unsigned(r, at + 8, 1) if step == 10 else F.lit(0).cast("long")
        return F.struct(unsigned(r, at, 4).alias("session"), unsigned(r, at + 4, 4).alias("size"), attribute.alias("attribute"), scene.alias("scene"))

    places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    error = _error((F.octet_length(r) >= 9, "too short for totals"), (_is(r, FILE_LIST), "not a file list"))
    return frames.select("*", unsigned(r, 3, 4).alias("stamp"), unsigned(r, 7, 2).alias("totals"), unsigned(r, 9, 2).alias("start"), F.transform(places, entry).alias("entries"), error)


def file_data(frames: DataFrame, raw: str = "raw", version: int = 7) -> DataFrame:
    """``frames`` with session, offset, declared length, payload (cut at the frame's end), code (of an
    empty package) and error."""
    r, modern = F.col(raw), version >= 7
    at = 5 if modern else 1
    offset = unsigned(r, at, 4)
    empty = offset == EMPTY
    length = F.when(~empty, unsigned(r, at + 4, 1))
    error = _error(
        (unsigned(r, 0, 1) == DATA_FRAME, "not a data frame"),
        (F.octet_length(r) >= at + 4, "too short for the offset"),
        (~empty | (F.octet_length(r) >= at + 6), "too short for the code"),
        (empty | (F.octet_length(r) >= at + 5), "too short for the length"),
    )
    return frames.select(
        "*",
        (unsigned(r, 1, 4) if modern else F.lit(None).cast("long")).alias("session"),
        offset.alias("offset"),
        length.alias("length"),
        F.when(~empty, F.substring(r, F.lit(at + 6), length.cast("int"))).alias("payload"),
        F.when(empty, unsigned(r, at + 5, 1)).alias("code"),
        error,
    )


def control(frames: DataFrame, raw: str = "raw", version: int = 7) -> DataFrame:
    """``frames`` with kind (head, tail, resume, deleted), session, status, crc, start, scene, start_time, error."""
    r, opcode = F.col(raw), unsigned(F.col(raw), 1, 2)
    kind = F.when(opcode == SYNC_HEAD, "head").when(opcode == SYNC_TAIL, "tail").when(opcode == RESUME, "resume").when(opcode == DELETED, "deleted")
    old = (opcode == DELETED) & F.lit(version < 7)
    shortest = F.when(opcode == SYNC_HEAD, 8).when(opcode == SYNC_TAIL, 9).when(opcode == RESUME, 12).when(old, 4).otherwise(8)
    status = F.when(opcode == SYNC_HEAD, unsigned(r, 7, 1)).when(opcode == RESUME, unsigned(r, 11, 1)).when(old, unsigned(r, 3, 1)).when(opcode == DELETED, unsigned(r, 7, 1))
    full = (opcode == RESUME) & (F.octet_length(r) >= 17)
    resumed = lambda x: F.when(full, x).when(opcode == RESUME, F.lit(0).cast("long"))
    error = _error(((unsigned(r, 0, 1) == FRAME) & kind.isNotNull(), "not a control response"), (F.octet_length(r) >= shortest, "too short"))
    return frames.select(
        "*",
        kind.alias("kind"),
        F.when(~old, unsigned(r, 3, 4)).alias("session"),
        status.alias("status"),
        F.when(opcode == SYNC_TAIL, unsigned(r, 7, 2)).alias("crc"),
        F.when(opcode == RESUME, unsigned(r, 7, 4)).alias("start"),
        resumed(unsigned(r, 12, 1)).alias("scene"),
        resumed(unsigned(r, 13, 4)).alias("start_time"),
        error,
    )


def little_endian(number: Column, size: int) -> Column:
    """The bytes of a whole number, as hexadecimal text."""
    digits = F.lpad(F.hex(number.cast("long")), size * 2, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(size - 1, -1, -1)])


def data_frame(session: Column, offset: Column, payload: Column) -> Column:
    """A data frame's bytes, in the modern form."""
    head = F.concat(F.lit("02"), little_endian(session, 4), little_endian(offset, 4), little_endian(F.octet_length(payload), 1))
    return F.concat(F.unhex(head), payload)


def advertised(frames: DataFrame, raw: str = "raw") -> DataFrame:
    """``frames`` with project, version_type, version, serial, bound, port_version and error of the data in
    an advertisement: fields that each tell the length of the next.

    A short serial number is hexadecimal and the port version stands at a fixed place; for some projects
    it follows the serial number; other long serial numbers have none. A serial number that begins with three digits
    gives the project.
    """
    r, n = F.col(raw), F.octet_length(F.col(raw))
    byte = lambda at: unsigned(r, at, 1)
    two = byte(0) == 2
    f = frames.withColumns({"_at": F.when(two, 4).otherwise(1), "_size": F.when(two, byte(3)).otherwise(byte(0)), "_project": F.when(two, unsigned(r, 1, 2)).otherwise(F.lit(0))})
    f = f.withColumn("_end", (F.col("_at") + F.col("_size")).cast("int"))
    width, at = F.col("_size") - 1, F.col("_at") + 1
    code = F.when(width == 1, unsigned(r, at, 1)).when(width == 2, unsigned(r, at, 2)).when(width == 3, unsigned(r, at, 3)).when(width.isin(4, 8), unsigned(r, at, 4))
    f = f.withColumns({"_version": F.when(code >= 1 << 31, code - (1 << 32)).otherwise(code), "_len": byte(F.col("_end")).cast("int")})
    f = f.withColumns({"_stop": F.col("_end") + 1 + F.col("_len"), "_serial": F.substring(r, F.col("_end") + 2, F.col("_len"))})
    project, stop, length = F.col("_project"), F.col("_stop"), F.col("_len")
    text = F.when(F.hex("_serial").rlike("[1-9A-F]"), F.col("_serial").cast("string")).otherwise("")
    cursor, short = project.isin(*CURSOR_PROJECTS), length < SHORT_SERIAL
    name = F.when(~cursor & short, F.hex("_serial")).otherwise(text)
    port = F.when(cursor, unsigned(r, stop, 2)).when(short, F.when(project.isin(*LATE_PROJECTS), unsigned(r, 18, 2)).otherwise(unsigned(r, 15, 2))).otherwise(F.lit(0))
    own = cursor | short
    gate, size = F.when(own, n - 1).otherwise(stop + 1), F.when(own, F.lit(1)).otherwise(byte(stop))
    bound = F.when((n >= gate + size) & (gate >= 1) & (byte(gate - 1) == 1), byte(gate))
    head = F.substring(name, 1, 3)
    error = _error(
        (n > 0, "no data"),
        (n > byte(0) + 1, "too short for the first field"),
        (n > F.col("_at") + 1, "too short for the version's kind"),
        (width.isin(1, 2, 3, 4, 8), "a version of an unknown width"),
        (n > F.col("_end"), "too short for the version"),
        (n > stop, "too short for the serial number"),
        (port.isNotNull(), "too short for the port version"),
    )
    return f.select(
        *frames.columns,
        F.when(head.rlike("^[+-]?[0-9]+$") & (F.length(name) >= 3), head.cast("long")).otherwise(project).alias("project"),
        F.chr(byte(F.col("_at"))).alias("version_type"),
        F.col("_version").alias("version"),
        serial(name).alias("serial"),
        F.coalesce(bound, F.lit(-1)).alias("bound"),
        port.alias("port_version"),
        error,
    )
