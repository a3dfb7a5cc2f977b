"""Material files, policy files and case files as tables."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.materials import document_id, region_assess
from ..functions.text import blank_to_null
from ..rules import materials as R

CASE_SCHEMA = ("case_id string, `case` string, name string, documents_dir string, expected_status string, "
               "expected_risks array<string>, expected_fields map<string,string>, expected_policy_refs array<string>, "
               "category string, expected_tools array<string>")
POLICY_SCHEMA = "array<struct<chunk_id:string,section:string,content:string,content_type:string>>"


def materials_from_bytes(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(materials, rejects) from ``(path, content)``.

    Text files are decoded strictly, without a byte-order mark. PDF, Word, Excel and image bytes are
    for a decoder upstream; they come back as rows without text. Whatever cannot be accepted goes to
    the reject table with its reason.
    """
    suffix = F.regexp_extract(F.lower("path"), r"(\.[^./\\]*)$", 1)
    kind = F.coalesce(*[F.when(suffix == k, v) for k, v in R.FILE_KINDS.items()])
    size = F.length("content")
    bom = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    body = F.when(bom, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    reason = (
        F.when(F.col("content").isNull() | (size == 0) | (size > R.MAX_FILE_BYTES), "文件不能为空且不得超过8MB")
        .when(kind.isNull(), "仅支持PDF、TXT、DOCX、XLSX及图片文件")
        .when((kind == "text") & ~F.is_valid_utf8(body.cast("string")), "文本不是有效的UTF-8"))
    name = F.regexp_extract("path", r"([^/\\]*)$", 1)
    marked = files.select("*", name.alias("file_name"), kind.alias("kind"), reason.alias("reason"),
                          F.when(kind == "text", body.cast("string")).alias("text"))
    text = F.when(F.col("reason").isNull(), F.col("text"))
    doc_type = F.concat("kind", F.when(F.col("kind") == "text", region_assess(F.col("text"))["suffix"]).otherwise(""))
    materials = marked.where("reason is null").select(
        document_id(F.col("content")).alias("document_id"), "file_name", doc_type.alias("document_type"), "path",
        F.length("content").alias("size"), text.alias("text"))
    return materials, marked.where("reason is not null").select("path", "file_name", "reason")


#: Partitions in which a folder of uploads is listed, and the fewest in which its files are read.
LISTERS = 32
#: Paths that a lister hands over at a time, and bytes of files that a reader does.
PATHS, READ_BYTES = 10_000, 1 << 25


def _file_source():
    """A data source that names all files below a folder: ``(path)``, empty files among them.

    What stands directly in the folder is dealt out by name; each partition lists its own subfolders, so nothing is
    listed on the driver.
    """
    import zlib

    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    batch = PATHS

    # classes of this function travel to the workers by value
    class Reader(DataSourceReader):
        def __init__(self, path, parts):
            self.path, self.parts = path, parts

        def partitions(self):
            return [InputPartition(i) for i in range(self.parts)]

        def read(self, partition):
            import pyarrow as pa
            from pyarrow import fs

            files, top = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
            hidden = lambda name: name.startswith(("_", "."))
            handed = lambda paths: pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])
            own = [x for x in files.get_file_info(fs.FileSelector(top)) if zlib.crc32(x.base_name.encode()) % self.parts == partition.value]
            paths = []
            while own:
                entry = own.pop()
                if hidden(entry.base_name):
                    continue
                if entry.type == fs.FileType.Directory:
                    own += files.get_file_info(fs.FileSelector(entry.path))
                elif entry.type == fs.FileType.File:
                    paths.append(entry.path)
                if len(paths) >= batch:
                    yield handed(paths)
                    paths = []
            yield handed(paths)

    class Uploads(DataSource):
        @classmethod
        def name(cls):
            return "claim_uploads"

        def schema(self):
            return "path string"

        def reader(self, schema):
            return Reader(self.options["path"], int(self.options["parts"]))

    return Uploads


def uploaded_files(spark: SparkSession, path: str, parts: int = LISTERS) -> DataFrame:
    """``(path, content)`` of all files below a folder that all workers reach.

    Paths are dealt out before files are read, so one full folder is read by all tasks. Of files that are too large for
    an upload only the beginning is read.
    """
    spark.dataSource.register(_file_source())
    paths = spark.read.format("claim_uploads").option("path", path).option("parts", parts).load()
    n = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most, bound = R.MAX_FILE_BYTES + 1, READ_BYTES

    def read(batches):
        import pandas as pd
        from pyarrow import fs

        files = fs.FileSystem.from_uri(path)[0] if ":" in path else fs.LocalFileSystem()
        for batch in batches:
            rows, size = [], 0
            for name in batch["path"]:
                with files.open_input_stream(name) as stream:
                    rows.append((name, stream.read(most)))
                size += len(rows[-1][1])
                if size >= bound:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "content"])

    return paths.repartition(n, "path").mapInPandas(read, "path string, content binary")


def write_files(files: DataFrame, path: str) -> int:
    """Writes ``files(path, content)`` below a folder that all workers reach; a repeated task writes the same again."""
    def write(batches):
        import pandas as pd
        from pyarrow import fs

        out, top = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
        for batch in batches:
            for folder in {f"{top}/{p}".rpartition("/")[0] for p in batch["path"]}:
                out.create_dir(folder)
            for name, content in zip(batch["path"], batch["content"]):
                with out.open_output_stream(f"{top}/{name}") as stream:
                    stream.write(bytes(content))
            yield pd.DataFrame({"n": [len(batch)]})

    return files.select("path", "content").mapInPandas(write, "n long").agg(F.sum("n")).first()[0] or 0


def material_scan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(materials, rejects) of the files below ``path``; zero-byte files are among the rejects."""
    return materials_from_bytes(uploaded_files(spark, path))


def policy_rows(files: DataFrame) -> DataFrame:
    """Rows of policy files ``(source_file, body)``, each body a JSON array; broken files give no rows."""
    return files.select("source_file", F.posexplode(F.from_json("body", POLICY_SCHEMA)).alias("row_no", "r")).select(
        "source_file", F.col("row_no").cast("bigint").alias("row_no"), "r.chunk_id", "r.section", "r.content")


def policy_scan(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path)
    return policy_rows(files.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body")))


def normalize_cases(raw: DataFrame) -> DataFrame:
    """Evaluation cases; the compact form names only ``case``."""
    none = F.array().cast("array<string>")
    return raw.select(
        F.coalesce("case_id", "case").alias("case_id"), F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("documents_dir", F.concat(F.lit("data/demo/"), "case")).alias("documents_dir"), "expected_status",
        F.coalesce("expected_risks", none).alias("expected_risks"),
        F.coalesce("expected_fields", F.map_from_arrays(none, none)).alias("expected_fields"),
        F.coalesce("expected_policy_refs", none).alias("expected_policy_refs"),
        F.coalesce("category", F.lit("uncategorized")).alias("category"),
        F.coalesce("expected_tools", none).alias("expected_tools"),
    ).where("case_id is not null and documents_dir is not null")


def cases_from_json(lines: DataFrame, column: str = "body") -> DataFrame:
    return normalize_cases(lines.select(F.from_json(column, CASE_SCHEMA).alias("c")).select("c.*"))


def case_scan(spark: SparkSession, path: str) -> DataFrame:
    return normalize_cases(spark.read.schema(CASE_SCHEMA).option("multiLine", "true").json(path))


def ocr_needed(documents: DataFrame, minimum: int = R.LOW_DENSITY_CHARS) -> DataFrame:
    """Documents whose text is too thin to have been read electronically, or that come from recognition."""
    kind = F.coalesce("document_type", F.lit(""))
    thin = F.coalesce(F.length(blank_to_null(F.col("text"))), F.lit(0)) < minimum
    recognized = F.lit(False)
    for prefix in R.OCR_PREFIXES:
        recognized = recognized | kind.startswith(prefix)
    return documents.where(thin | recognized)
