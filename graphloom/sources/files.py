"""Sources and sinks: source files, manifests, graph documents, image lists."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..storage import bound_batches

#: File suffixes read as text and as images.
TEXT, IMAGE = ("txt", "md", "markdown", "pdf"), ("jpg", "jpeg", "png", "webp", "gif", "bmp")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def classified(files: DataFrame) -> DataFrame:
    """Rows of binaryFile with kind text or image; names that begin with `_` and other files are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(suffix(F.col("path")).isin(*TEXT), F.lit("text")).when(suffix(F.col("path")).isin(*IMAGE), F.lit("image"))
    return files.where(~name.startswith("_")).withColumn("kind", kind).where("kind IS NOT NULL")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """path, kind, hash and content of all source files below a folder."""
    return classified(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)).select("path", "kind", F.sha2("content", 256).alias("hash"), "content")


@F.pandas_udf(T.StringType())
def decoded(path: pd.Series, content: pd.Series) -> pd.Series:
    """Text of a file: UTF-8 with what can't be decoded left out; the pages of a PDF, where its reader is installed, with
    blank lines and a form feed between them."""
    return pd.Series([text_of(p, c) for p, c in zip(path, content, strict=True)], dtype=object)


def text_of(path: str, content: bytes) -> str | None:
    if not path.lower().endswith(".pdf"):
        return content.decode("utf-8", "ignore")
    try:
        from pypdf import PdfReader
    except ImportError:
        return None
    return "\n\n\f".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


PDF_IMAGES = "source string, page int, idx int, name string, content binary, page_text string"


def pdf_images(files: DataFrame) -> DataFrame:
    """Images in PDF files, with the text of their page; nothing where the reader is not installed."""

    def run(frames):
        for frame in frames:
            rows = [r for path, content in zip(frame["path"], frame["content"], strict=True) for r in _images(path, content)]
            yield pd.DataFrame(rows, columns=["source", "page", "idx", "name", "content", "page_text"])

    return files.where(suffix(F.col("path")) == "pdf").select("path", "content").mapInPandas(run, PDF_IMAGES)


def _images(path: str, content: bytes):
    try:
        from pypdf import PdfReader
    except ImportError:
        return
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    for p, page in enumerate(PdfReader(io.BytesIO(content)).pages, 1):
        text = page.extract_text() or ""
        for i, image in enumerate(page.images, 1):
            ext = image.name.rsplit(".", 1)[-1].lower()
            yield path, p, i, f"{stem}/p{p:03d}_{i:02d}.{ext}", image.data, text


def status(files: DataFrame, manifest: DataFrame, removed: bool = False) -> DataFrame:
    """path, status: NEW, CHANGED or processed; with `removed`, REMOVED too, for files that the manifest alone knows (a
    report: nothing of theirs is ever taken back)."""
    both = files.select("path", "hash").join(manifest.select("path", F.col("hash").alias("old")), "path", "full" if removed else "left")
    return both.select("path", F.when(F.col("hash").isNull(), "REMOVED").when(F.col("old").isNull(), "NEW").when(F.col("old") != F.col("hash"), "CHANGED").otherwise("processed").alias("status"))


def pending(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose content the manifest does not know."""
    return files.join(manifest.select("path", "hash"), ["path", "hash"], "left_anti")


def recorded(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """The manifest with the latest record of each path."""
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("processed_at"), "hash"))
    return manifest.unionByName(done).withColumn("k", rank).where("k = 1").drop("k")


IMG = "array<struct<path:string,caption:string,source:string,page:int>>"
_ENTITY = f"struct<name:string,type:string,types:array<string>,aliases:array<string>,attributes:struct<text:array<string>,img:{IMG}>,degree:bigint,hub:boolean>"


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def read_graph(spark: SparkSession, path: str, text_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entities, triples) of a graph document in JSON; empty ones where there is no such file."""
    shape = f"entities map<string,{_ENTITY}>, triples array<struct<h:string,r:string,u:string,sources:array<string>>>"
    doc = spark.read.schema(shape).option("multiLine", True).json(path) if exists(spark, path) else spark.createDataFrame([], shape)
    img = F.array().cast(IMG) if text_only else F.coalesce("e.attributes.img", F.array().cast(IMG))
    e = doc.select(F.explode("entities").alias("key", "e")).select(F.coalesce("e.name", "key").alias("name"), "e.type", "e.types", "e.aliases", "e.attributes.text", img.alias("img"), "e.degree", F.coalesce("e.hub", F.lit(False)).alias("hub"))
    t = doc.select(F.posexplode("triples").alias("seq", "t")).select(F.format_string("%012d", "seq").alias("seq"), "t.*")
    return e, t


def graph_document(entities: DataFrame, triples: DataFrame, version: int = 1) -> DataFrame:
    """ord, key, row: the lines of a graph document, in this order: meta and stats, entities by name (degrees counted
    anew), relations, triples by seq.  Lines are made where their rows are; only a writer needs them in one file."""
    spark = triples.sparkSession
    from ..operators.graph import degrees

    known = entities.drop("degree").join(degrees(triples), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    body = F.to_json(F.struct("name", "type", "types", "aliases", F.struct("text", "img").alias("attributes"), "degree", "hub"))
    e = known.select(F.lit(1).alias("ord"), F.col("name").alias("key"), F.concat(F.to_json(F.array("name")), F.lit(":"), body).alias("row"))
    e = e.withColumn("row", F.regexp_replace("row", r'^\[(".*?(?<!\\)")\]:', "$1:"))
    r = triples.select(F.lit(3).alias("ord"), F.col("r").alias("key"), F.regexp_replace(F.to_json(F.array("r")), r"^\[|\]$", "").alias("row")).distinct()
    t = triples.select(F.lit(5).alias("ord"), F.col("seq").alias("key"), F.to_json(F.struct("h", "r", "u", "sources")).alias("row"))
    n = known.agg(F.count(F.lit(1)).alias("entities"), F.count_if(F.size("img") > 0).alias("multimodal_entities"), F.coalesce(F.sum(F.greatest(F.size("img"), F.lit(0))), F.lit(0)).alias("images"), F.coalesce(F.sum(F.greatest(F.size("text"), F.lit(0))), F.lit(0)).alias("text_attributes"))
    m = triples.agg(F.countDistinct("r").alias("relations"), F.count(F.lit(1)).alias("triples"))
    stats = F.to_json(F.struct("entities", "relations", "triples", "multimodal_entities", "images", "text_attributes"))
    head = n.select(F.lit(1).alias("one"), "*").join(m.select(F.lit(1).alias("one"), "*"), "one").select(F.lit(0).alias("ord"), F.lit("").alias("key"), F.concat(F.lit(f'{{"meta":{{"version":{version}}},"stats":'), stats, F.lit(',"entities":{')).alias("row"))
    marks = spark.createDataFrame([(2, "", '},"relations":['), (4, "", '],"triples":['), (6, "", "]}")], "ord int, key string, row string")
    return head.unionByName(e).unionByName(r).unionByName(t).unionByName(marks)


def save_document(lines: DataFrame, path: str) -> None:
    """Write the lines of a document as one text file below `path`, with commas between rows of a list.  One task streams
    sorted lines; a document is one file by its nature, and larger graphs are kept as tables (write_graph)."""
    rows = lines.withColumn("comma", F.col("ord").isin(1, 3, 5))
    first = rows.where("comma").groupBy("ord").agg(F.min("key").alias("first"))
    text = rows.join(F.broadcast(first), "ord", "left").select("ord", "key", F.concat(F.when(F.col("comma") & (F.col("key") > F.col("first")), F.lit(",")).otherwise(F.lit("")), "row").alias("value"))
    text.repartition(1).sortWithinPartitions("ord", "key").select("value").write.mode("overwrite").text(path)


def _split(ddl: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[at:i])
            at = i + 1
    return [*out, ddl[at:]]


def write_graph(entities: DataFrame, triples: DataFrame, root: str) -> None:
    """Entities (degrees counted anew), triples, sorted relations and stats as Parquet tables."""
    from ..operators.graph import degrees

    known = entities.drop("degree").join(degrees(triples), "name", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    known.write.mode("overwrite").parquet(f"{root}/entities")
    triples.write.mode("overwrite").parquet(f"{root}/triples")
    triples.select("r").distinct().sort("r").write.mode("overwrite").parquet(f"{root}/relations")


def export_json(entities: DataFrame, triples: DataFrame) -> DataFrame:
    """value: one JSON line for each entity and triple, for tools that read lines."""
    e = entities.select(F.to_json(F.struct(F.lit("entity").alias("kind"), *entities.columns)).alias("value"))
    return e.unionByName(triples.select(F.to_json(F.struct(F.lit("triple").alias("kind"), *triples.columns)).alias("value")))


def image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The list of images and their rights."""
    columns = "path string, rights string, included string, source string, source_url string, source_page string, rights_note string"
    return spark.read.schema(columns).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def checked(files: DataFrame, known: DataFrame) -> DataFrame:
    """path, state: ok, changed or unknown, by SHA-256."""
    own = files.select("path", F.sha2("content", 256).alias("now"))
    return own.join(known, "path", "left").select("path", F.when(F.col("sha256").isNull(), "unknown").when(F.col("sha256") == F.col("now"), "ok").otherwise("changed").alias("state"))


def results_document(results: DataFrame, summary: DataFrame) -> DataFrame:
    """value: the summary first, then rows, as JSON lines."""
    return summary.select(F.to_json(F.struct(F.lit("summary").alias("kind"), *summary.columns)).alias("value")).unionByName(results.select(F.to_json(F.struct(F.lit("row").alias("kind"), *results.columns)).alias("value")))


def read_results(spark: SparkSession, path: str, rows: str, summary: str) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of a results document, by their schemas."""
    lines = spark.read.text(path)
    kind = F.get_json_object("value", "$.kind")
    take = lambda name, shape: lines.where(kind == name).select(F.from_json("value", shape).alias("x")).select("x.*")
    return take("row", rows), take("summary", summary)


def split_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """qid: the questions of one split of a split document ({name: [qid, ...], ...})."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json(F.get_json_object("value", f"$.{name}"), "array<string>")).alias("qid"))


def page_texts(files: DataFrame, needed: DataFrame) -> DataFrame:
    """stem, page, text of the pages of needed files (stem).  Pages of a text file are parted by form feeds; those of a
    PDF come from its reader, where that is installed."""
    name = F.element_at(F.split("path", "/"), -1)
    own = files.withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).join(needed.select("stem").distinct(), "stem", "left_semi")
    pages = F.split(F.replace(decoded("path", "content"), F.lit("\n\n\f"), F.lit("\f")), "\f")
    return own.select("stem", F.posexplode(pages).alias("p", "text")).select("stem", (F.col("p") + 1).alias("page"), "text")


#: Perceptual hashes of a block.
HASHES = 2048


def best_matches(rows: DataFrame, known: DataFrame, most: int = 10) -> DataFrame:
    """id, match, distance: of each perceptual hash (id, hash) the nearest known one (match, hash), if at most `most` bits
    differ; the smaller match of equals.  Hashes meet block by block and not in joined bands, since bits that most of
    them share would bring all pairs together as rows."""
    one, two = rows.schema["id"].dataType, known.schema["match"].dataType

    def blocks(df: DataFrame, name: str, kind, to: str) -> DataFrame:
        def run(batches):
            for batch in batches:
                for i in range(0, batch.num_rows, HASHES):
                    part = batch.slice(i, HASHES).sort_by("name")  # the first of equal distances is the smaller one
                    held = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(0))
                    yield pa.RecordBatch.from_arrays([held, pa.array([part.column(1).to_numpy().tobytes()], pa.binary())], [f"{to}s", f"{to}h"])

        schema = T.StructType([T.StructField(f"{to}s", T.ArrayType(kind)), T.StructField(f"{to}h", T.BinaryType())])
        return df.where(F.col("hash").isNotNull()).select(F.col(name).alias("name"), F.col("hash").cast("long")).mapInArrow(run, schema)

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (1, 3))
                differ = np.bitwise_count(a[:, None] ^ b[None, :])
                at = differ.argmin(1)
                best = differ[np.arange(len(a)), at]
                keep = np.nonzero(best <= most)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values.take(pa.array(keep)), batch.column(2)[i].values.take(pa.array(at[keep])), pa.array(best[keep].astype(np.int32))], ["id", "match", "distance"])

    spark = rows.sparkSession
    bound_batches(spark)
    own = blocks(rows, "id", one, "r").repartition(4 * spark.sparkContext.defaultParallelism)
    found = own.crossJoin(blocks(known, "match", two, "k")).select("rs", "rh", "ks", "kh").mapInArrow(nearest, T.StructType([T.StructField("id", one), T.StructField("match", two), T.StructField("distance", T.IntegerType())]))
    return found.groupBy("id").agg(F.min(F.struct("distance", "match")).alias("x")).select("id", "x.match", "x.distance")


def items_of(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark items from a JSON document, with or without an `items` envelope."""
    raw = spark.read.text(path, wholetext=True)
    whole = F.try_parse_json("value")
    listed = F.coalesce(F.to_json(F.try_variant_get(whole, "$.items", "variant")), F.col("value"))
    return raw.select(F.explode(F.from_json(listed, f"array<struct<{','.join(f'{a}:{b}' for a, b in (x.strip().split(' ', 1) for x in _split(S.ITEMS)))}>>")).alias("i")).select("i.*")


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two 64-bit perceptual hashes."""
    return F.bit_count(a.bitwiseXOR(b))


def dhash(gray: list[list[int]]) -> int:
    """The 64-bit difference hash of 8 rows of 9 grey values."""
    bits = 0
    for row in gray:
        for x, y in zip(row, row[1:], strict=False):
            bits = bits << 1 | (x > y)
    return bits - (1 << 64) if bits >> 63 else bits
