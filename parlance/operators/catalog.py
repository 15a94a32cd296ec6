"""Small table operators: selections, tags, deduplication, grids, listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the first keyword that a text holds, and what it stands for
EVIDENCE = (
    ("RUNTIME", "RUNTIME"),
    ("PROVEN_BYTECODE", "PROVEN_BYTECODE"),
    ("BYTECODE", "PROVEN_BYTECODE"),
    ("PROVEN_OFFICIAL_SOURCE", "PROVEN_OFFICIAL_SOURCE"),
    ("OFFICIAL_DOC", "OFFICIAL_DOC"),
    ("OFFICIAL_BINARY", "OFFICIAL_BINARY"),
    ("CORROBORATED", "CORROBORATED"),
    ("CLOUD_OBSERVED", "CLOUD_OBSERVED"),
    ("LINEAGE", "LINEAGE"),
    ("INFERRED", "INFERRED"),
    ("UNKNOWN", "UNKNOWN"),
    ("PROVEN", "PROVEN_OFFICIAL_SOURCE"),
    ("CONFIRMED", "OFFICIAL_DOC"),
    ("HIGH", "OFFICIAL_DOC"),
    ("MEDIUM", "OFFICIAL_DOC"),
    ("LOW", "INFERRED"),
    ("CLAIM", "CLAIM"),
    ("PLAUSIBLE", "INFERRED"),
)
CUT_HEADER = "X-Mock-Body-Truncated"
# end of fixed values


def evidence_class(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    return reduce(lambda case, x: case.when(F.contains(upper, F.lit(x[0])), x[1]), EVIDENCE, F).otherwise("UNCLASSIFIED")


def tagged(rows: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """``rows`` once for each name of which the pattern is found in the text, as ``tag``."""
    tags = F.array(*[F.when(F.col(text).rlike(p), F.lit(name)) for name, p in patterns.items()])
    return rows.select("*", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("tag"))


def first_of_each(rows: DataFrame, key: str, order: tuple[str, ...]) -> DataFrame:
    """Of the rows of a key the first one."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("nth = 1").drop("nth")


def ordinals(rows: DataFrame, keys: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def joined_text(segments: DataFrame) -> DataFrame:
    """meeting_id, text: texts that aren't empty, in the order of their starts."""
    parts = F.filter(F.array_sort(F.collect_list(F.struct("lo", "seg_no", "text"))), lambda x: F.coalesce(x["text"], F.lit("")) != "")
    return segments.groupBy("meeting_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"))


def numbered_speakers(segments: DataFrame, prefix: str = "Speaker ") -> DataFrame:
    """meeting_id, label, name: numbered from 1 by first appearance."""
    first = segments.groupBy("meeting_id", "label").agg(F.min(F.struct("lo", "seg_no")).alias("f"))
    return first.select("meeting_id", "label", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("meeting_id").orderBy("f"))).alias("name"))


#: Rows of a grid or of a list of centres, each of which meets every row.
FEW = 10_000


def _few(rows: DataFrame, what: str) -> DataFrame:
    if rows.limit(FEW + 1).count() > FEW:
        raise ValueError(f"more than {FEW} {what}")
    return F.broadcast(rows)


def sweep(rows: DataFrame, grid: DataFrame) -> DataFrame:
    """Every row under every threshold of a small grid (threshold)."""
    return rows.crossJoin(_few(grid.select("threshold"), "thresholds"))


def selected(scores: DataFrame, *by: str) -> DataFrame:
    """The row with the least of the columns, one after the other."""
    return scores.agg(F.min_by(F.struct(*scores.columns), F.struct(*by)).alias("x")).select("x.*")


def vocabulary(words: DataFrame, fallback: list[str]) -> DataFrame:
    """word: those seen and the fallback ones, each once."""
    more = words.sparkSession.createDataFrame([(w,) for w in fallback], "word string")
    return words.select("word").union(more).distinct()


def unlisted(there: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    return there.join(listed, key, "left_anti")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """side, n: how many rows only one of two logs has, with multiplicity; none if they are equal."""
    only = lambda a, b, name: a.exceptAll(b).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return only(left, right, "left").unionByName(only(right, left, "right")).where("n > 0")


def replay_record(requests: DataFrame, separator: str = "\n") -> DataFrame:
    """seq, record: requests (seq, request_id, ts, duration_ms, method, path, query, host, body, and
    body_size if the body was cut) in the framed text that replay tools read."""
    body = F.coalesce("body", F.lit(""))
    target = F.concat("path", F.when(F.coalesce("query", F.lit("")) != "", F.concat(F.lit("?"), F.col("query"))).otherwise(""))
    head = F.concat_ws(
        "\r\n",
        F.concat_ws(" ", "method", target, F.lit("HTTP/1.1")),
        F.concat(F.lit("Host: "), F.coalesce("host", F.lit("localhost"))),
        F.when(F.col("body_size").isNotNull(), F.concat(F.lit(CUT_HEADER + ": "), F.col("body_size").cast("string"))),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    nano = lambda x, scale: F.floor(x * scale).cast("long").cast("string")
    first = F.concat_ws(" ", F.lit("1"), "request_id", nano(F.col("ts"), 1_000_000_000), nano(F.coalesce("duration_ms", F.lit(0.0)), 1_000_000))
    return requests.select("seq", F.concat(first, F.lit("\n"), head, F.lit("\r\n\r\n"), body, F.lit(separator)).alias("record"))


def nearest(points: DataFrame, centres: DataFrame) -> DataFrame:
    """``points`` (id, v) with the label of the nearest of a few centres (label, c), ties to the
    smaller label."""
    apart = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    pairs = points.crossJoin(_few(centres, "centres"))
    return pairs.groupBy("id").agg(F.min_by("label", F.struct(apart.alias("d"), "label")).alias("label"), F.sqrt(F.min(apart)).alias("distance"))


def cluster_sizes(clusters: DataFrame, least: int, share: float) -> DataFrame:
    """group, cluster, n, kept: a cluster is kept if it has ``least`` members and the share of its group."""
    sizes = clusters.groupBy("group", "cluster").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("group"))
    return sizes.withColumn("kept", F.col("n") >= F.greatest(F.lit(1), F.lit(least), F.ceil(total * share)))


def registered(objects: DataFrame, known: DataFrame) -> DataFrame:
    """``objects`` (key, body) with the folder of the meeting that is registered (md5, folder) for their bytes."""
    return objects.withColumn("md5", F.md5("body")).join(known.select("md5", "folder"), "md5", "left")


def merged_parts(parts: DataFrame, asked: DataFrame) -> DataFrame:
    """upload, body, error: the uploaded parts (upload, part, etag, body) that are asked for (upload, part, etag)
    in the order of their numbers; a part that is asked for twice, absent or of another etag is an error."""
    bare = lambda c: F.translate(c, '"', "")
    own = parts.select("upload", "part", bare(F.col("etag")).alias("own"), "body")
    pairs = asked.groupBy("upload", "part").agg(F.count("*").alias("times"), F.min(bare(F.col("etag"))).alias("want")).join(own, ["upload", "part"], "left")
    error = F.when(F.col("times") > 1, "listed twice").when(F.col("own").isNull(), "never uploaded").when(F.col("own") != F.col("want"), "of another etag")
    marked = pairs.withColumn("wrong", F.when(error.isNotNull(), F.struct("part", error.alias("what"))))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("body").alias("h")))), lambda x: x["h"]), "")
    rows = marked.groupBy("upload").agg(F.min("wrong").alias("wrong"), body.alias("h"))
    return rows.select("upload", F.when(F.col("wrong").isNull(), F.unhex("h")).alias("body"), F.concat(F.lit("part "), F.col("wrong.part").cast("string"), F.lit(" "), F.col("wrong.what")).alias("error"))
