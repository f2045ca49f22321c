"""File sources: chunk files, curated documents, attachment folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.schemas import CHUNK


def json_records(spark: SparkSession, folder: str, schema: StructType = CHUNK, lines: bool = False) -> DataFrame:
    """Records of all ``*.json`` files below a folder, each file one object or an array; with ``lines`` of all text
    files, each line one object or an array.  Elements that are no
    objects are skipped, a broken file gives no record; missing texts are empty except date and department."""
    files = spark.read.text(folder, recursiveFileLookup=True) if lines else spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    items = F.coalesce(F.from_json("value", "array<string>"), F.array("value"))
    each = files.select(F.col("_metadata.file_path").alias("file_path"), F.posexplode(items).alias("pos", "item")).where(F.btrim("item").startswith("{"))
    out = each.select("file_path", "pos", F.from_json("item", schema).alias("r")).where("r is not null").select("file_path", "pos", "r.*")
    keep_null = {"published_at", "department"}
    return out.withColumns({f.name: F.coalesce(f.name, F.lit("")) for f in schema if f.dataType.simpleString() == "string" and f.name not in keep_null})


def one_level(spark: SparkSession, folder: str, schema: StructType, lines: bool = False) -> DataFrame:
    """``<kind>/<id>.json`` one level deep, one object a file (with ``lines`` one a line), with the kind taken from the path."""
    df = spark.read.schema(schema).option("multiLine", not lines).json(f"{folder}/*/*.json")
    return df.select("*", F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("folder_kind"))


def first_of_file(records: DataFrame) -> DataFrame:
    """Kind and document of each chunk file by its first record."""
    return records.groupBy("file_path").agg(F.min_by(F.struct("source_type", "doc_id"), "pos").alias("k"), F.count(F.lit(1)).alias("n_chunks")).select("file_path", "k.*", "n_chunks")


#: Largest attachment that is read (fixed value: 100 MiB).
MAX_ATTACHMENT = 100 << 20


def attachment_files(spark: SparkSession, folder: str, most: int = MAX_ATTACHMENT) -> DataFrame:
    """``source_type, doc_id, file_name, path, length, content`` of ``<kind>/<doc>/<file>`` below a folder; files larger
    than ``most`` bytes are never opened."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(F.col("length") <= most)
    part = lambda i: F.regexp_extract("path", "([^/]+)/([^/]+)/([^/]+)$", i)
    return df.select(part(1).alias("source_type"), part(2).alias("doc_id"), part(3).alias("file_name"), "path", "length", "content")


def seeds(spark: SparkSession, rows: list[tuple[str, str, str, str]]) -> DataFrame:
    """Seed relation ``name, url, source_type, page_kind``."""
    return spark.createDataFrame(rows, "name string, url string, source_type string, page_kind string")


def page_requests(seeds: DataFrame, pages: int, per_page: int = 10) -> DataFrame:
    """Requests of paged board lists: one row a page with its offset."""
    p = seeds.where("page_kind = 'board'").select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page_no"))
    join = F.when(F.contains("url", F.lit("?")), "&").otherwise("?")
    return p.withColumn("request_url", F.concat("url", join, F.lit("mode=list&articleLimit="), F.lit(per_page).cast("string"), F.lit("&article.offset="), ((F.col("page_no") - 1) * per_page).cast("string")))


def fetch(requests: DataFrame, url: str, get=None) -> DataFrame:
    """``*, body, error``: pages fetched in the tasks, one failure a row, never a failed job.  ``get(url) -> str``
    may be given (tests, offline stores); the default is a plain HTTP GET."""
    from pyspark.sql.types import StringType, StructField

    schema = StructType([*requests.schema.fields, StructField("body", StringType()), StructField("error", StringType())])
    at = requests.columns.index(url)

    def default(u: str) -> str:
        from urllib.request import Request, urlopen
        with urlopen(Request(u, headers={"User-Agent": "Mozilla/5.0"}), timeout=60) as r:
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")

    def run(batches):
        import pyarrow as pa
        load = get or default
        for b in batches:
            bodies, errors = [], []
            for u in b.column(at).to_pylist():
                try:
                    bodies.append(load(u))
                    errors.append(None)
                except Exception as x:  # any failure is the row's own
                    bodies.append(None)
                    errors.append(f"{type(x).__name__}: {x}"[:300])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bodies, pa.string()), pa.array(errors, pa.string())], names=[*b.schema.names, "body", "error"])

    return requests.mapInArrow(run, schema)


def fetch_binary(requests: DataFrame, url: str, open_url=None, most: int = MAX_ATTACHMENT, block: int = 1 << 20) -> DataFrame:
    """``*, content, content_type, error``: files fetched in the tasks in blocks.  A file larger than ``most`` bytes, by
    its header or while it is read, is given up and leaves an error and nothing else.  ``open_url(url)`` gives an object
    with ``headers`` and ``read(n)`` (tests, offline stores); the default is a plain HTTP GET."""
    from pyspark.sql.types import BinaryType, StringType, StructField

    schema = StructType([*requests.schema.fields, StructField("content", BinaryType()), StructField("content_type", StringType()), StructField("error", StringType())])
    at = requests.columns.index(url)

    def default(u: str):
        from urllib.request import Request, urlopen
        return urlopen(Request(u, headers={"User-Agent": "Mozilla/5.0"}), timeout=30)

    def load(u: str) -> tuple[bytes, str | None]:
        r = (open_url or default)(u)
        try:
            if int(r.headers.get("Content-Length") or 0) > most:
                raise ValueError(f"larger than {most} bytes")
            parts, size = [], 0
            while part := r.read(block):
                size += len(part)
                if size > most:
                    raise ValueError(f"larger than {most} bytes")
                parts.append(part)
            return b"".join(parts), r.headers.get("Content-Type")
        finally:
            close = getattr(r, "close", None)
            if close:
                close()

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):  # one file at a time leaves the task
                row = b.slice(i, 1)
                try:
                    content, kind = load(row.column(at)[0].as_py())
                    error = None
                except Exception as x:  # any failure is the row's own
                    content, kind, error = None, None, f"{type(x).__name__}: {x}"[:300]
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([content], pa.binary()), pa.array([kind], pa.string()), pa.array([error], pa.string())], names=[*row.schema.names, "content", "content_type", "error"])

    return requests.mapInArrow(run, schema)
