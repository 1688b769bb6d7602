"""Sources: text, files, folders, archives, manifests and tables as DataFrames.

Everything is read by Spark's own readers, so a path may lie in any store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def texts(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """doc_id, path (null), text: documents from strings."""
    return spark.createDataFrame([(i, None, t) for i, t in rows], "doc_id string, path string, text string")


def folder(spark: SparkSession, path: str, glob: str = "*.adoc") -> DataFrame:
    """path, text, mtime: one row per file below a folder, whatever starts with ``_`` or ``.`` left out; order it by ``path``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    shown = ~F.exists(F.split(F.col("path"), "/"), lambda s: s.startswith("_") | (s.startswith(".") & ~s.isin(".", "..")))
    return found.where(shown).select("path", decode(F.col("content")).alias("text"), F.col("modificationTime").alias("mtime"))


def decode(content: Column) -> Column:
    """Bytes as text, by their byte order mark: UTF-16 of either order, else UTF-8."""
    head = F.hex(F.substring(content, 1, 3))
    rest = lambda n: F.substring(content, n + 1, 1 << 30)
    return (
        F.when(head == "EFBBBF", F.decode(rest(3), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(rest(2), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(rest(2), "UTF-16BE"))
        .otherwise(F.make_valid_utf8(content.cast("string")))
    )


def file_attributes(df: DataFrame, path: str = "path", mtime: str = "mtime") -> DataFrame:
    """Adds docfile, docdir, docname, docfilesuffix, docdate and doctime."""
    p = F.regexp_replace(F.col(path), r"^[a-z]+:/*(?=/)", "")
    base = F.element_at(F.split(p, "/"), -1)
    return df.withColumns({
        "docfile": p, "docdir": F.regexp_replace(p, r"/[^/]*$", ""), "docname": F.regexp_replace(base, r"\.[^.]*$", ""), "docfilesuffix": F.regexp_extract(base, r"(\.[^.]*)$", 1),
        "docdate": F.date_format(F.col(mtime), "yyyy-MM-dd"), "doctime": F.date_format(F.col(mtime), "HH:mm:ss"),
    })


def front_matter(text: Column) -> Column:
    """Struct of front_matter (null without) and body: a block between ``---`` or ``+++`` lines at the top."""
    pattern = r"^(---|\+\+\+)\n([\s\S]*?)\n?\1(?:\n|$)([\s\S]*)$"
    has = text.rlike(pattern)
    return F.struct(F.when(has, F.regexp_extract(text, pattern, 2)).alias("front_matter"), F.when(has, F.regexp_extract(text, pattern, 3)).otherwise(text).alias("body"))


def join_assets(nodes: DataFrame, assets: DataFrame, on: str = "target") -> DataFrame:
    """Nodes with the bytes of the asset they name (null if missing). ``assets``: path, content."""
    return nodes.join(assets.select(F.col("path").alias("asset_path"), F.col("content").alias("asset")), F.col(on) == F.col("asset_path"), "left").drop("asset_path")


#: Media types by file ending.
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp"}


def data_uri(path: Column, content: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    media = F.coalesce(F.try_element_at(F.create_map(*[F.lit(y) for kv in MEDIA.items() for y in kv]), ending), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), media, F.lit(";base64,"), F.base64(content))


def resolve_path(base: Column, target: Column, jail: str | None = None) -> Column:
    """``target`` from the folder ``base``, without ``.`` and ``..``; null if it leaves ``jail``."""
    whole = F.when(target.startswith("/"), target).otherwise(F.concat_ws("/", base, target))

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) > 0, F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(held)
        return F.when((part == "") | (part == "."), held).when(part == "..", up).otherwise(F.array_append(held, part))

    parts = F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step)
    out = F.concat(F.when(whole.startswith("/"), "/").otherwise(""), F.array_join(parts, "/"))
    return out if jail is None else F.when((out == jail) | out.startswith(jail.rstrip("/") + "/"), out)


def archive_entries(archives: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """key, name, size, crc32, data: a row per entry of each ZIP archive; none for what is no archive or is broken."""
    from quire.functions import codec

    found = archives.select(F.col(key).cast("string").alias("key"), F.explode(codec.zip_entries(content)).alias("e"))
    return found.select("key", "e.name", F.octet_length("e.content").cast("bigint").alias("size"), F.crc32("e.content").alias("crc32"), F.col("e.content").alias("data"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a manifest with one JSON object per line."""
    kind = "id string, source string, base_dir string, path string, text string, doctype string, safe string, standalone boolean, attributes map<string,string>, extra map<string,string>"
    return spark.read.schema(kind).json(path)


def page_map(text: Column) -> Column:
    """A page map from its JSON."""
    return F.from_json(text, T.StructType([T.StructField("labels", T.ArrayType(T.StringType())), T.StructField("blocks", T.ArrayType(T.StructType([T.StructField("at", T.StringType()), T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())])))]))


def frame_of(data: bytes):
    """(kind, width, height) from the header of a PNG, GIF or JPEG file, None for others; a JPEG's markers are walked one by one."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return "png", int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    if data[:4] == b"GIF8" and len(data) >= 10:
        return "gif", int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if data[:3] != b"\xff\xd8\xff":
        return None
    at = 2
    while at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return "jpeg", int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return "jpeg", None, None


def image_sizes(files: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """key, kind, width, height, orientation (by EXIF; 1 without) of PNG, GIF and JPEG files; width and height as shown, turned where the orientation says so. Kind is null for others."""
    from quire.functions import codec
    from quire.functions.kernel import kernel

    def facts(data):
        found = frame_of(bytes(data))
        return None if found is None else dict(zip(("kind", "width", "height"), found, strict=True))

    read = files.select(F.col(key).alias("key"), kernel("struct<kind:string,width:int,height:int>")(facts)(content).alias("f"), codec.exif_orientation(content).alias("turn"))
    turned = F.col("turn") > 4
    return read.select("key", F.col("f.kind").alias("kind"), F.when(turned, F.col("f.height")).otherwise(F.col("f.width")).alias("width"), F.when(turned, F.col("f.width")).otherwise(F.col("f.height")).alias("height"), F.coalesce("turn", F.lit(1)).alias("orientation"))


def by_path(files: DataFrame, path: str = "path") -> DataFrame:
    """Files with ``ord``, the arrays of their folders' names and then their own, by which they are ordered folder by folder."""
    return files.withColumn("ord", F.split(F.col(path), "/"))


def cases(spark: SparkSession, path: str, source: str = "input.adoc", settings: str = "case.yml") -> DataFrame:
    """case (its folder), text, settings (JSON of its YAML file; null without) of each folder below a path that holds a source."""
    import json

    from quire.functions.kernel import kernel
    from quire.sources import yaml

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", decode(F.col("content")).alias("text"))
    folder_of, name = F.regexp_replace("path", r"/[^/]*$", ""), F.element_at(F.split("path", "/"), -1)
    inputs = found.where(name == source).select(folder_of.alias("case"), "text")
    more = found.where(name == settings).select(folder_of.alias("s_case"), kernel("string")(lambda t: json.dumps(yaml.load(t)))("text").alias("settings"))
    return inputs.join(more, F.col("case") == F.col("s_case"), "left").drop("s_case")


def heredocs(rows: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """key, nth, text: the documents that source files hold as heredocs (``<<~END`` to ``END``), without their common indentation."""
    pattern = r"<<[~-]?['\"]?([A-Z_]+)['\"]?[^\n]*\n([\s\S]*?)\n[ \t]*\1\b"
    found = rows.select(F.col(key).alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(2))).alias("nth", "text"))
    from quire.operators.preprocess import reindented

    return found.select("key", "nth", reindented(F.col("text")).alias("text"))


def pool(spark: SparkSession, path: str, code: str = "*.{rb,py,dart}") -> DataFrame:
    """path, nth (null: a file of its own), text: documents below a path, and those that code files hold."""
    own = folder(spark, path).select("path", F.lit(None).cast("int").alias("nth"), "text")
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", code).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return own.unionByName(heredocs(files).withColumnRenamed("key", "path"))


#: Safe modes, from all to nothing allowed.
MODES = ("unsafe", "safe", "server", "secure")


def safe_path(base: Column, target: Column, jail: str, mode: str = "safe") -> Column:
    """A target as a safe mode has it: as it is written (unsafe), kept inside the jail by dropping what climbs out of it (safe and server), or null (secure, which includes nothing)."""
    if mode not in MODES:
        raise ValueError(f"unknown safe mode: {mode}")
    if mode == "secure":
        return F.lit(None).cast("string")
    inside = resolve_path(base, target, None if mode == "unsafe" else jail)
    if mode == "unsafe":
        return inside
    kept = F.array_join(F.filter(F.split(target, "/"), lambda p: ~p.isin("..", ".", "")), "/")
    return F.coalesce(inside, F.concat(F.lit(jail.rstrip("/") + "/"), kept))


def relative_path(path: Column, start: Column) -> Column:
    """A path as seen from a folder, both without ``.`` and ``..``."""
    a, b = F.split(F.btrim(path, F.lit("/")), "/"), F.split(F.btrim(start, F.lit("/")), "/")
    same = F.size(F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i)))
    return F.array_join(F.concat(F.array_repeat(F.lit(".."), F.size(b) - same), F.slice(a, same + 1, F.size(a))), "/")
