"""Canonical inputs, derived from the given tables.

The tables are about orders, events and texts; here their rows play usage lines,
snapshots, volumes, manifests and so on. Every row of a table is used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.keys import archive_base, full_key, image_base

TAG = "archive-state"
OWNER = "100000000000"
BUCKET = "backups"
INSTANCE = "i-self"
ZONE = "zone-a"
LEFT_NAME = "temporary volume"
RIGHT_NAME = "stored archive"

# Which objects a snapshot of each kind has: kind, image, partition, codec, encrypted.
STORED = (
    ("click", True, "", "lz4", False),
    ("view", False, "", "zstd", True),
    ("error", True, "", "zstd", False),
    ("error", False, "data", "lz4", False),
    ("purchase", False, "data", "lz4", False),
    ("purchase", False, "data", "zstd", True),
    ("purchase", False, "", "lz4", True),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts) -> Column:
    """Concatenate texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _tag(key, value) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
    return F.struct(as_column(key).alias("Key"), as_column(value).alias("Value"))


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower(F.replace("r_name", F.lit(" "), F.lit("-")))
    return table(spark, sf_dir, "region").select("r_regionkey", name.alias("region"))


def _regional_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "events").withColumn("r_regionkey", (F.col("user_id") % 5).cast("int"))
    return keyed.join(_regions(spark, sf_dir), "r_regionkey")


def usage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report lines as text columns under their report names, plus ``seq``."""
    kind, value = F.col("event_type"), F.col("value")
    day = F.col("ts").cast("date")
    arn = _text(
        "arn:aws:ec2:", F.col("region"), ":", F.lit(10**11) + F.col("user_id") % 3, ":snapshot/snap-", F.col("user_id"), kind
    )
    # Hourly and daily lines, two-day lines, and some that cannot be read.
    rest = (
        F.when(value > 200, "")
        .when(value > 100, _text("/", F.date_add(day, 2), "T00:00:00Z"))
        .when(value < 10, _text("/", day, "T01:00:00Z"))
        .otherwise(_text("/", F.date_add(day, 1), "T00:00:00Z"))
    )
    line = F.struct(
        F.col("event_id").alias("seq"),
        F.when(value < 3, "CreateVolume").otherwise("CreateSnapshot").alias(fv.COL_OPERATION),
        F.when(value < 5, _text("vol-", F.col("user_id"))).otherwise(arn).alias(fv.COL_RESOURCE),
        _text(day, "T00:00:00Z", rest).alias(fv.COL_INTERVAL),
        _text(value, F.when(kind == "view", "GB").otherwise("")).alias(fv.COL_AMOUNT),
        F.when(value < 40, "0.05").when(value < 70, "0.06").otherwise("0.07").alias(fv.COL_RATE),
    )
    # As one generated row per line: operators then read columns, as they would
    # from a report, and no filter on a column repeats how its text was made.
    return _regional_events(spark, sf_dir).select(F.inline(F.array(line)))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per user and kind of event."""
    kind, user = F.col("event_type"), F.col("user_id")
    grouped = (
        _regional_events(spark, sf_dir)
        .groupBy("user_id", "event_type", "region")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("ts").alias("start_time"),
            F.max("ts").alias("last_time"),
            F.min("value").alias("least"),
        )
    )
    state = (
        F.when(kind == "click", "migrate")
        .when(kind == "view", "migrated")
        .when(kind == "error", "validating")
        .when(kind == "purchase", "validated")
    )
    other_tags = F.array(
        _tag("aws:createdBy", F.col("region")),
        _tag(TAG + "-id", user),
        _tag("Purpose (1)", _text(kind, " #", user)),
    )
    own_tag = F.when(state.isNull(), F.array().cast("array<struct<Key:string,Value:string>>")).otherwise(
        F.array(_tag(TAG, state))
    )
    return grouped.select(
        "region",
        F.when(F.col("least") < 0.5, F.lit("999999999999"))
        .otherwise((F.lit(10**11) + user % 3).cast("string"))
        .alias("owner_id"),
        _text("snap-", user, kind).alias("snapshot_id"),
        _text("vol-", user).alias("volume_id"),
        (1 + user % 50 + F.length(kind)).cast("bigint").alias("volume_size"),
        "start_time",
        "last_time",
        F.when(F.col("n") < 9, F.lit("pending")).otherwise(F.lit(fv.STATUS_COMPLETED)).alias("status"),
        F.when(kind == "signup", F.lit("")).otherwise(_text(kind, " backup (", F.col("n"), ")")).alias("description"),
        F.concat(own_tag, other_tags).alias("tags"),
        kind.alias("kind"),
        (F.col("n") * 1000 + user).alias("stored_bytes"),
        F.array(F.lit(""), F.lit("data")).alias("partitions"),
    )


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One volume per supplier; users beyond the suppliers have deleted volumes."""
    supplier = table(spark, sf_dir, "supplier").withColumn("r_regionkey", (F.col("s_suppkey") % 5).cast("int"))
    nation_tag = F.array(_tag("Nation", F.col("s_nationkey")))
    return supplier.join(_regions(spark, sf_dir), "r_regionkey").select(
        "region",
        _text("vol-", F.col("s_suppkey")).alias("volume_id"),
        (1 + F.col("s_suppkey") % 50).cast("bigint").alias("size"),
        F.when(F.col("s_acctbal") > 0, F.concat(nation_tag, F.array(_tag("Name", F.col("s_name")))))
        .otherwise(nation_tag)
        .alias("tags"),
    )


def restored_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary volumes made from snapshots, one per part."""
    attached = lambda *ids: F.array(*[F.struct(F.lit(i).alias("InstanceId")) for i in ids])
    kind = F.col("p_type")
    empty = F.array().cast("array<struct<InstanceId:string>>")
    no_tags = F.array().cast("array<struct<Key:string,Value:string>>")
    return table(spark, sf_dir, "part").select(
        _text("tmp-", F.col("p_partkey")).alias("volume_id"),
        _text("snap-", F.col("p_size"), "click").alias("snapshot_id"),
        F.when(F.col("p_retailprice") < 950, F.lit(ZONE)).otherwise(F.lit("zone-b")).alias("availability_zone"),
        F.when(F.col("p_name").startswith("red"), no_tags)
        .otherwise(F.array(_tag(TAG, F.col("p_brand"))))
        .alias("tags"),
        F.when(kind == "PROMO", attached("i-other"))
        .when(kind == "STANDARD", attached(INSTANCE))
        .when(kind == "LARGE", attached(INSTANCE, "i-other"))
        .otherwise(empty)
        .alias("attachments"),
    )


def _entry(filename: Column, content: Column) -> list[Column]:
    return [filename.cast("binary").alias("filename"), F.md5(content).alias("hash")]


def manifest_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, all turns of a conversation under one name, and passages."""
    documents = table(spark, sf_dir, "documents").select(
        *_entry(_text(F.col("source"), "/", F.col("doc_id")), F.col("text"))
    )
    chats = table(spark, sf_dir, "conversations").select(*_entry(_text("chat/", F.col("conv_id")), F.col("text")))
    passages = table(spark, sf_dir, "benchmark").select(*_entry(_text("bench/", F.col("item_id")), F.col("text")))
    return documents.unionByName(chats).unionByName(passages)


def _changed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, those labelled toxic with a changed text."""
    return (
        table(spark, sf_dir, "documents")
        .join(table(spark, sf_dir, "labels"), "doc_id", "left")
        .withColumn("text", F.when(F.col("toxic") == 1, _text(F.col("text"), "!")).otherwise(F.col("text")))
    )


def manifest_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with changed, renamed and moved entries, and pages for passages."""
    folder = F.when(F.col("quality") == 0, F.lit("review/")).otherwise(F.lit(""))
    documents = _changed_documents(spark, sf_dir).select(
        *_entry(_text(folder, F.col("source"), "/", F.col("doc_id")), F.col("text"))
    )
    role = F.col("role")
    chats = table(spark, sf_dir, "conversations").select(
        *_entry(
            _text(F.when(role == "system", F.lit("system/")).otherwise(F.lit("chat/")), F.col("conv_id")),
            F.when(role == "assistant", _text(F.col("text"), "?")).otherwise(F.col("text")),
        )
    )
    pages = table(spark, sf_dir, "pages").select(*_entry(_text("pages/", F.col("page_id")), F.col("html")))
    return documents.unionByName(chats).unionByName(pages)


def digests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Whole-object digests of originals and of stored copies."""
    original = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("hash"))
    stored = _changed_documents(spark, sf_dir).select("doc_id", F.md5("text").alias("hash"))
    return original, stored


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as archive members: one language holds hard links, one symlinks."""
    lang, digit, doc = F.col("lang"), F.col("n_chars") % 10, F.col("doc_id")
    is_file = ~lang.isin("es", "fr")
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("archive"),
        doc.alias("seq"),
        F.when(lang == "es", "link").when(lang == "fr", "symlink").otherwise("file").alias("type"),
        F.when(lang == "es", _text("/link-", doc))
        .when(lang == "fr", _text("./sym-", doc))
        .otherwise(_text("./", lang, "/", digit))
        .cast("binary")
        .alias("name"),
        F.when(is_file, F.lit("")).otherwise(_text("./en/", digit)).cast("binary").alias("linkname"),
        F.when(is_file, F.md5("text")).alias("hash"),
    )


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of stored objects, some of them in another bucket."""
    spec = F.array(
        *[
            F.struct(
                F.lit(kind).alias("for_kind"),
                F.lit(image).alias("image"),
                F.lit(part).alias("part"),
                F.lit(codec).alias("codec"),
                F.lit(encrypted).alias("encrypted"),
            )
            for kind, image, part, codec, encrypted in STORED
        ]
    )
    identity = F.col("volume_id"), F.col("start_time"), F.col("snapshot_id"), F.col("description")
    base = F.when(F.col("image"), image_base(*identity)).otherwise(archive_base(*identity, F.col("part")))
    return (
        snapshots(spark, sf_dir)
        .withColumn("spec", F.filter(spec, lambda s: s["for_kind"] == F.col("kind")))
        .select("*", F.inline("spec"))
        .select(
            F.when(F.col("region") == "asia", F.lit("elsewhere")).otherwise(F.lit(BUCKET)).alias("bucket"),
            full_key(base, F.col("codec"), F.col("encrypted")).alias("key"),
            F.col("stored_bytes").alias("size"),
        )
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Migration and validation attempts, one per order."""
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        _text("snap-", F.col("o_orderkey")).alias("snapshot_id"),
        F.when(F.col("o_totalprice") > 250000, "validate").otherwise("migrate").alias("mode"),
        (status != "P").alias("ok"),
        (status == "F").alias("inline_validate"),
        F.when(priority == "1-URGENT", "migrated")
        .when(priority == "2-HIGH", "validated")
        .when(priority == "3-MEDIUM", "validating")
        .when(priority == "4-NOT SPECIFIED", "custom")
        .alias("prior_tag"),
        F.when(status == "P", _text("differs in ", F.col("o_custkey"), " files")).alias("message"),
    )


def local_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole volumes, one per snapshot."""
    return snapshots(spark, sf_dir).select("snapshot_id", F.md5("snapshot_id").alias("hash"))


def stored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all stored objects; some are of another content."""
    key = F.col("key")
    owner = F.regexp_extract(key, "(snap-[0-9a-z]+)", 1)
    return objects(spark, sf_dir).select(
        "key", F.md5(F.when(F.col("size") % 7 == 0, key).otherwise(owner)).alias("hash")
    )


def _event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a file of its snapshot; names repeat."""
    event = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        _text("snap-", F.col("user_id"), F.col("event_type")).alias("snapshot_id"),
        F.when(event % 2 == 0, F.lit("")).otherwise(F.lit("data")).alias("partition_name"),
        _text("f", event % 31).cast("binary").alias("filename"),
        F.md5(event.cast("string")).alias("hash"),
    )


def local_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the partitions of all snapshots."""
    return _event_files(spark, sf_dir).drop("event_id")


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of all stored archives: a few are missing, a few have another content."""
    archives = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(part).alias("partition_name"),
                F.lit(codec).alias("codec"),
                F.lit(encrypted).alias("encrypted"),
            )
            for kind, image, part, codec, encrypted in STORED
            if not image
        ]
    )
    identity = F.col("volume_id"), F.col("start_time"), F.col("snapshot_id"), F.col("description")
    keyed = (
        snapshots(spark, sf_dir)
        .withColumn("spec", F.filter(archives, lambda a: a["kind"] == F.col("kind")))
        .select("snapshot_id", *[c for c in ("volume_id", "start_time", "description")], F.inline("spec"))
        .select(
            "snapshot_id",
            "partition_name",
            full_key(archive_base(*identity, F.col("partition_name")), F.col("codec"), F.col("encrypted")).alias("key"),
        )
    )
    event = F.col("event_id")
    other = F.when(event % 1009 == 0, F.md5("filename")).otherwise(F.col("hash"))
    files = _event_files(spark, sf_dir).where(event % 997 != 0).withColumn("hash", other).drop("event_id")
    return files.join(keyed, ["snapshot_id", "partition_name"]).select("key", "filename", "hash")


def requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(_text("snap-", F.col("o_custkey"), "click").alias("snapshot_id"))


def upload_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.floor(F.col("l_extendedprice") * 10000000.0).alias("uncompressed_bytes"),
        F.when(flag == "A", "lz4").when(flag == "N", "zstd").otherwise("none").alias("codec"),
        (F.col("l_quantity") - 10.5).alias("level"),
        (F.col("l_linenumber") - 1).alias("streams"),
    )


def tag_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags with long and foreign values: every turn of every conversation."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.when(role == "system", _text("aws:", F.col("turn")))
        .when(F.col("turn") == 0, F.lit(TAG))
        .otherwise(_text("turn №", F.col("turn"), " (", role, ")"))
        .alias("Key"),
        F.col("text").alias("Value"),
    )
