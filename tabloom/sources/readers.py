"""Sources: one dispatcher over Spark's readers, with the checks a plain reader does not make."""

from __future__ import annotations

import csv
import io
import ipaddress
import json
import os
import re
import socket
from dataclasses import dataclass
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: fixed values: what a file name's end or a scheme means
EXTENSIONS = {
    ".csv": "csv", ".tsv": "csv", ".txt": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "ndjson", ".ndjson": "ndjson", ".feather": "arrow", ".arrow": "arrow",
    ".ipc": "arrow", ".xlsx": "excel", ".xls": "excel", ".db": "sqlite", ".sqlite": "sqlite", ".sqlite3": "sqlite", ".orc": "orc",
}
CLOUD = ("s3", "s3a", "gs", "abfss", "abfs", "wasbs", "hdfs", "viewfs")
JDBC = {"postgresql": "org.postgresql.Driver", "postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "mssql": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "redshift": "com.amazon.redshift.jdbc42.Driver"}
WAREHOUSES = {"bigquery": "bigquery", "snowflake": "snowflake"}
MALFORMED_TOLERANCE, MAX_JSON_DEPTH, SNIFF_BYTES = 0.05, 64, 65_536


class SourceError(ValueError):
    """The source cannot be read as asked."""


@dataclass
class Dialect:
    delimiter: str
    header: bool
    encoding: str
    columns: list[str]


def _head(spark: SparkSession, path: str, size: int = SNIFF_BYTES) -> bytes:
    """The first bytes of a file in any store Spark reads."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(p).isDirectory():
        files = [s.getPath() for s in fs.listStatus(p) if not s.getPath().getName().startswith(("_", "."))]
        if not files:
            raise SourceError(f"{path} has no files")
        p = min(files, key=lambda x: x.toString())
    stream = fs.open(p)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def sniff(raw: bytes) -> Dialect:
    """Encoding by mark or by trial, the delimiter that splits most lines alike, and whether the first line is a header."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            encoding = name
            break
    else:
        encoding = "utf-8"
        try:
            raw[: raw.rfind(b"\n") + 1 or len(raw)].decode("utf-8")
        except UnicodeDecodeError:
            encoding = "latin-1"
    text = raw.decode(encoding, "replace")
    if not text.strip():
        raise SourceError("the file is empty")
    best = (0.0, 0, ",", [[]])
    for d in ",\t;|":
        rows = [r for r in csv.reader(io.StringIO(text), delimiter=d) if r][:200]
        if len(rows) > 1 and len(raw) >= SNIFF_BYTES:
            rows = rows[:-1]
        widths = [len(r) for r in rows]
        mode = max(set(widths), key=lambda w: (widths.count(w), w))
        share = widths.count(mode) / len(widths)
        if mode > 1 and (share, mode) > best[:2]:
            best = (share, mode, d, rows)
    if not best[1]:
        best = (1.0, 1, ",", [r for r in csv.reader(io.StringIO(text)) if r])
    first = best[3][0]
    number = re.compile(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    header = all(c.strip() and not number.match(c.strip()) for c in first) and (len(best[3]) == 1 or any(a != b for a, b in zip(first, best[3][1], strict=False)))
    names: list[str] = []
    for i, c in enumerate(first if header else [f"c{i}" for i in range(len(first))]):
        name, n = c.strip() or f"c{i}", 1
        while name in names:
            name, n = f"{c.strip()}_{n}", n + 1
        names.append(name)
    return Dialect(best[2], header, {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf-16": "UTF-16", "latin-1": "ISO-8859-1"}[encoding], names)


def read_csv(spark: SparkSession, path: str, tolerance: float = MALFORMED_TOLERANCE) -> DataFrame:
    """All columns as text, rows of a wrong width left out; more of them than ``tolerance`` is an error."""
    d = sniff(_head(spark, path))
    bad = "_malformed"
    schema = ", ".join([*(f"`{c}` string" for c in d.columns), f"`{bad}` string"])
    df = spark.read.schema(schema).csv(path, sep=d.delimiter, header=d.header, encoding=d.encoding, quote='"', escape='"', multiLine=d.encoding == "UTF-16", mode="PERMISSIVE", columnNameOfCorruptRecord=bad, enforceSchema=True)
    # all columns are read: Spark refuses queries of the malformed column alone, and a row of which it reads some columns
    # is not malformed to it
    total, wrong, _ = df.select(F.count("*"), F.count(bad), F.max(F.hash(*[F.col(f"`{c}`") for c in d.columns]))).first()
    if not total:
        raise SourceError(f"{path} has no rows")
    if wrong / total > tolerance:
        raise SourceError(f"{wrong} of {total} rows of {path} are malformed")
    reads = F.hash(*[F.col(f"`{c}`") for c in d.columns]) >= F.lit(-(1 << 31)).cast("int")  # always true
    return df.where(F.col(bad).isNull() & reads).drop(bad)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """One document: an array of objects, or one object. Deeper nesting than MAX_JSON_DEPTH is malformed."""
    return spark.read.option("multiLine", True).option("maxNestingDepth", MAX_JSON_DEPTH).option("mode", "DROPMALFORMED").json(path)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """An object a line; bad and too deep lines are left out."""
    return spark.read.option("maxNestingDepth", MAX_JSON_DEPTH).option("mode", "DROPMALFORMED").json(path)


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """Feather or Arrow IPC files: listed by Spark as binary files and decoded batch by batch on the executors."""
    import pyarrow as pa
    import pyarrow.feather  # noqa: F401
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)
    first = files.select("content").first()
    if first is None:
        raise SourceError(f"{path} has no files")
    schema = from_arrow_schema(pa.ipc.open_file(pa.BufferReader(bytes(first[0]))).schema)

    def decode(batches):
        for b in batches:
            for raw in b.column(0):
                reader = pa.ipc.open_file(pa.BufferReader(raw.as_buffer()))
                for i in range(reader.num_record_batches):
                    yield reader.get_batch(i)

    return files.select("content").mapInArrow(decode, schema)


def read_excel(spark: SparkSession, path: str, sheet: str | int = 0) -> DataFrame:
    """A sheet, by name or number, of each workbook that ``path`` names, one below the other by column name. Workbooks are
    small files by nature (a sheet has a million rows at most), and are read one after the other on the driver."""
    try:
        import openpyxl  # noqa: F401
        import pandas as pd
    except ImportError as e:
        raise SourceError("reading Excel files needs openpyxl") from e
    return _union_workbooks(spark, path, lambda raw: pd.read_excel(io.BytesIO(raw), sheet_name=sheet))


def _union_workbooks(spark: SparkSession, path: str, parse) -> DataFrame:
    out = None
    for (raw,) in spark.read.format("binaryFile").load(path).orderBy("path").select("content").toLocalIterator():
        one = spark.createDataFrame(parse(bytes(raw)))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise SourceError(f"{path} has no files")
    return out


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, query: str | None = None) -> DataFrame:
    """A table or query of a SQLite file by its standard library driver; of a file with one table the name may be left out."""
    import sqlite3

    import pandas as pd

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        if query is None:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type IN ('table', 'view') AND name NOT LIKE 'sqlite_%' ORDER BY name")]
            if table is None:
                if len(names) != 1:
                    raise SourceError(f"name one of the tables {names}")
                table = names[0]
            if table not in names:
                raise SourceError(f"no table {table!r}")
            query = f'SELECT * FROM "{table}"'
        frame = pd.read_sql_query(query, db)
    return spark.createDataFrame(frame)


def read_jdbc(spark: SparkSession, uri: str, table: str | None = None, query: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """A database by JDBC; ``partition`` is (column, lower, upper, parts) for parallel reads."""
    scheme = urlsplit(uri).scheme.split("+")[0]
    if scheme not in JDBC:
        raise SourceError(f"no JDBC driver is known for {scheme}")
    reader = spark.read.format("jdbc").option("url", f"jdbc:{uri}").option("driver", JDBC[scheme]).options(**options)
    reader = reader.option("query", query) if query else reader.option("dbtable", table)
    if partition:
        column, lower, upper, parts = partition
        reader = reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts)
    return reader.load()


def read_warehouse(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """bigquery://project.dataset.table and snowflake://... through the vendors' Spark connectors."""
    parts = urlsplit(uri)
    return spark.read.format(WAREHOUSES[parts.scheme]).options(**options).load(parts.netloc + parts.path)


def assert_public(url: str) -> None:
    """Refuse URLs whose host is, or resolves to, an address that is not public."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https") or not parts.hostname:
        raise SourceError(f"not a web URL: {url}")
    try:
        found = {ipaddress.ip_address(a[4][0]) for a in socket.getaddrinfo(parts.hostname, parts.port or 443)}
    except OSError as e:
        raise SourceError(f"cannot resolve {parts.hostname}") from e
    if any(not a.is_global for a in found):
        raise SourceError(f"{parts.hostname} is not a public address")


def _extract(body, path: str | None) -> list:
    for part in (path or "").split("."):
        if part:
            body = body[int(part)] if isinstance(body, list) else body.get(part)
    return body if isinstance(body, list) else [body] if body is not None else []


def read_api(spark: SparkSession, url: str, json_path: str | None = None, page_param: str | None = None, page_size: int = 100, cursor_path: str | None = None, cursor_param: str = "cursor", query: str | None = None, max_pages: int = 1000, fetch=None) -> DataFrame:
    """A REST or GraphQL endpoint of JSON: pages by offset or cursor, records at ``json_path``. ``query`` posts GraphQL.
    Redirects are not followed and HTML is refused, and so is a listing of more than ``max_pages`` pages. ``fetch(url, body)`` replaces the network, as in tests."""
    if fetch is None:
        assert_public(url)

        class Stay(HTTPRedirectHandler):
            def redirect_request(self, *a, **k):
                return None

        def fetch(u: str, body: bytes | None) -> bytes:
            request = Request(u, data=body, headers={"Accept": "application/json", "Content-Type": "application/json"})
            return build_opener(Stay).open(request, timeout=30).read()

    records: list[str] = []
    cursor, offset = None, 0
    for n in range(max_pages + 1):
        extra = {page_param: str(offset)} if page_param else {cursor_param: cursor} if cursor else {}
        parts = urlsplit(url)
        target = urlunsplit(parts._replace(query=urlencode([*parse_qsl(parts.query), *extra.items()])))
        raw = fetch(target, json.dumps({"query": query, "variables": extra}).encode() if query else None)
        if raw.lstrip()[:1] == b"<":
            raise SourceError("the endpoint answered with HTML")
        body = json.loads(raw)
        page = [r for r in _extract(body, json_path) if isinstance(r, dict)]
        if page and n == max_pages:
            raise SourceError(f"the listing has more than {max_pages} pages")
        records += [json.dumps(r) for r in page]
        cursor = next(iter(_extract(body, cursor_path)), None) if cursor_path else None
        offset += page_size
        if not page or not (page_param or cursor):
            break
    if not records:
        raise SourceError("no records")
    lines = spark.createDataFrame([(r,) for r in records], "value string")
    schema = spark.read.json(spark.sparkContext.parallelize(records)).schema  # of all records
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_frame(spark: SparkSession, frame) -> DataFrame:
    """Spark, pandas, Arrow or polars frames."""
    if isinstance(frame, DataFrame):
        return frame
    if type(frame).__module__.startswith("polars"):
        frame = frame.to_arrow()
    return spark.createDataFrame(frame)


def open_source(spark: SparkSession, source, kind: str | None = None, **options) -> DataFrame:
    """A DataFrame of whatever ``source`` names: frames, database and warehouse URIs, SQL, web URLs, files in any store."""
    if not isinstance(source, (str, os.PathLike)):
        return read_frame(spark, source)
    source = os.fspath(source)
    scheme = urlsplit(source).scheme.lower() if "://" in source else ""
    if kind is None and scheme.split("+")[0] in JDBC:
        return read_jdbc(spark, source, **options)
    if kind is None and scheme in WAREHOUSES:
        return read_warehouse(spark, source, **options)
    if kind is None and re.match(r"\s*(select|with)\s", source, re.I):
        return spark.sql(source)
    if kind is None and scheme in ("http", "https"):
        return read_api(spark, source, **options)
    if kind is None and scheme == "sqlite":
        return read_sqlite(spark, source.removeprefix("sqlite:///"), **options)
    kind = kind or EXTENSIONS.get(os.path.splitext(source.rstrip("/"))[1].lower(), "csv")
    readers = {"csv": read_csv, "json": read_json, "ndjson": read_ndjson, "arrow": read_arrow, "excel": read_excel, "sqlite": read_sqlite, "parquet": lambda s, p: s.read.parquet(p), "orc": lambda s, p: s.read.orc(p)}
    if kind not in readers:
        raise SourceError(f"no reader for {kind}")
    return readers[kind](spark, source, **options)
