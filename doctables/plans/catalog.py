"""The catalog of stored tables: metadata, JSON rows, documents and sessions as four datasets.

A table is known by (doc_id, ordinal); ``table_id`` is for display and may be shared by documents
with equal file names. The newest write of a document replaces all of its earlier tables.

Layout: ``<root>/<dataset>/ingest_seq=<n>``; rows also by ``bucket``, a hash of the document,
sorted by (doc_id, ordinal, row_index) in their files, so that one table is found by partition pruning
and row-group statistics. A table of any size is spread over many files of its bucket. The number
of buckets is kept with the data. Numbers of writes are claimed by creating a file of that
name; a write counts once its file in ``_commits`` is there; repeating a write changes nothing."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import rows_between

TABLES_SCHEMA = (
    "table_id string, doc_id string, ordinal int, source_file string, table_type string, rows bigint, "
    "columns bigint, column_names array<string>, column_types map<string,string>, "
    "storage_types map<string,string>, html_content string, description string, "
    "session_id string, created_at timestamp, ingest_seq bigint"
)
TABLE_DATA_SCHEMA = (
    "table_id string, doc_id string, ordinal int, row_index bigint, row_data string, "
    "created_at timestamp, ingest_seq bigint, bucket int"
)
DOCUMENTS_SCHEMA = (
    "doc_id string, source_file string, modification_time timestamp, status string, error string, "
    "total_tables bigint, successful_tables bigint, created_at timestamp, ingest_seq bigint"
)
SESSIONS_SCHEMA = (
    "session_id string, source_file string, total_tables bigint, successful_tables bigint, "
    "created_at timestamp, ingest_seq bigint"
)
REQUIRED_FIELDS = ["table_id", "source_file", "rows", "columns", "column_names", "row_data"]
SEARCH_FIELDS = ["table_id", "source_file", "description"]
STORAGE_SQL = {"int64": "bigint", "float64": "double", "bool": "boolean"}
ROWS_PER_FILE = 1_000_000
DATASETS = ("table_data", "processing_sessions", "documents", "tables")

# SQL functions of user queries; each is inlined into the plan as built-in expressions.
SQL_FUNCTIONS = [
    r"""CREATE OR REPLACE TEMPORARY FUNCTION json_extract(j STRING, path STRING) RETURNS STRING
        RETURN get_json_object(j, regexp_replace(path, '\\.?"([^"]*)"', '[\'$1\']'))""",
    r"""CREATE OR REPLACE TEMPORARY FUNCTION cast_integer(v STRING) RETURNS BIGINT
        RETURN CASE WHEN v IS NOT NULL
          THEN coalesce(try_cast(regexp_extract(ltrim(v), '^[+-]?\\d+', 0) AS BIGINT), 0) END""",
    r"""CREATE OR REPLACE TEMPORARY FUNCTION cast_real(v STRING) RETURNS DOUBLE
        RETURN CASE WHEN v IS NOT NULL THEN coalesce(try_cast(regexp_extract(ltrim(v),
          '^[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?', 0) AS DOUBLE), 0) END""",
]


def bucket_of(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


# ---------------------------------------------------------------- reads over any frames


def tables_of_source(tables: DataFrame, source_file: str) -> DataFrame:
    return tables.filter(F.col("source_file") == source_file).orderBy("created_at", "table_id")


def all_tables(tables: DataFrame) -> DataFrame:
    return tables.orderBy(F.desc("created_at"), "table_id")


def metadata_of(tables: DataFrame, ids: str | DataFrame) -> DataFrame:
    """Metadata of one id, or of all ids in a DataFrame."""
    if isinstance(ids, str):
        return tables.filter(F.col("table_id") == ids)
    return tables.join(ids.select("table_id"), "table_id", "left_semi")


def existence(tables: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id and whether it is stored."""
    known = tables.select("table_id").distinct().withColumn("_known", F.lit(True))
    return ids.select("table_id").join(known, "table_id", "left").select(
        "table_id", F.col("_known").isNotNull().alias("found")
    )


def search(tables: DataFrame, term: str, fields: list[str] | None = None,
           literal: bool = False) -> DataFrame:
    """Case-insensitive substring search over id, source and description. ``%`` and ``_`` in the
    term are wildcards unless ``literal``; fields that are not searchable are ignored."""
    fields = [f for f in (SEARCH_FIELDS if fields is None else fields) if f in SEARCH_FIELDS]
    if literal:
        for special in ("\\", "%", "_"):
            term = term.replace(special, "\\" + special)
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.ilike(F.col(f), F.lit(f"%{term}%")), F.lit(False))
    return all_tables(tables.filter(hit))


def table_rows(table_data: DataFrame, table_id: str, limit: int | None = None,
               offset: int = 0) -> DataFrame:
    """Rows of a table as a map with its index, in order; of those picked by limit and offset,
    the ones which are no JSON object are skipped."""
    rows = table_data.filter(F.col("table_id") == table_id)
    if offset or limit is not None:
        rows = rows_between(rows, offset, limit)
    parsed = F.when(
        F.try_parse_json("row_data").isNotNull(), F.from_json("row_data", "map<string,string>")
    )
    return (
        rows.select(F.col("row_index").alias("_row_index"), parsed.alias("row"))
        .filter(F.col("row").isNotNull())
        .orderBy("_row_index")
    )


def typed_table(tables: DataFrame, table_data: DataFrame, table_id: str) -> DataFrame:
    """One stored table with its own columns and types; an unknown id gives an empty frame.
    Reads the table's metadata row to build the schema."""
    wanted = tables.filter(F.col("table_id") == table_id).select("column_names", "storage_types")
    found = wanted.limit(1).take(1)
    names = found[0]["column_names"] if found else []
    storage = found[0]["storage_types"] if found else {}
    schema = ", ".join(
        f"`{n.replace('`', '``')}` {STORAGE_SQL.get(storage.get(n), 'string')}" for n in names
    )
    rows = table_data.filter(F.col("table_id") == table_id)
    if not schema:
        return rows.select("row_index").limit(0)
    return rows.select("row_index", F.from_json("row_data", schema).alias("_r")).select(
        "row_index", "_r.*"
    )


def pipeline_summary(tables: DataFrame) -> DataFrame:
    """Tables and distinct sources in total (one row)."""
    return tables.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.count_distinct("source_file").alias("unique_sources"),
    )


def tables_by_type(tables: DataFrame) -> DataFrame:
    return tables.groupBy("table_type").agg(F.count(F.lit(1)).alias("n"))


def recent_sessions(sessions: DataFrame, n: int = 5) -> DataFrame:
    return sessions.orderBy(F.desc("created_at"), "session_id").limit(n)


def store_summary(tables: DataFrame, table_data: DataFrame, sessions: DataFrame) -> DataFrame:
    """Totals of tables, rows, sessions and distinct sources: one row."""
    one = F.count(F.lit(1))
    return tables.agg(
        one.alias("total_tables"), F.count_distinct("source_file").alias("unique_source_files")
    ).select(
        "total_tables",
        table_data.agg(one.alias("n")).scalar().alias("total_rows"),
        sessions.agg(one.alias("n")).scalar().alias("total_sessions"),
        "unique_source_files",
    )


def tables_with_actual_rows(tables: DataFrame, table_data: DataFrame) -> DataFrame:
    """The catalog with the number of rows really stored per table (0 if none)."""
    counts = table_data.groupBy("table_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        tables.join(counts, "table_id", "left")
        .withColumn("actual_rows", F.coalesce("_n", F.lit(0)))
        .drop("_n")
        .orderBy(F.desc("created_at"), "table_id")
    )


def chat_summary(tables: DataFrame, table_data: DataFrame) -> DataFrame:
    """Tables, stored rows of these tables and distinct sources: one row."""
    listed = tables_with_actual_rows(tables, table_data)
    return listed.agg(
        F.count(F.lit(1)).alias("total_tables"),
        F.coalesce(F.sum("actual_rows"), F.lit(0)).alias("total_data_rows"),
        F.count_distinct(F.coalesce("source_file", F.lit(""))).alias("unique_source_files"),
    )


def source_files(tables: DataFrame) -> DataFrame:
    """Distinct sources, one per row, in order: there may be any number of them."""
    return tables.select("source_file").distinct().orderBy("source_file")


def session_of(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.filter(F.col("session_id") == session_id)


def with_observed_count(result: DataFrame):
    """A result and an observation of its row count, filled by the first action on it."""
    from pyspark.sql import Observation

    seen = Observation()
    return result.observe(seen, F.count(F.lit(1)).alias("row_count")), seen


def superseded_versions(documents: DataFrame) -> DataFrame:
    """Versions (doc_id, ingest_seq) of documents that a later write has replaced."""
    newest = documents.groupBy("doc_id").agg(F.max("ingest_seq").alias("_newest"))
    return documents.join(newest, "doc_id").filter("ingest_seq < _newest").select("doc_id", "ingest_seq")


def without_versions(superseded: DataFrame, versioned: DataFrame) -> DataFrame:
    """Leave superseded versions out: one plain anti join, whose strategy the optimizer picks by size."""
    return versioned.join(superseded, ["doc_id", "ingest_seq"], "left_anti")


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the ids in ``new`` replace those in ``old``."""
    ids = new.select("table_id").distinct()
    return old.join(ids, "table_id", "left_anti").unionByName(new, allowMissingColumns=True)


def validate_records(records: DataFrame) -> DataFrame:
    """Add ``valid``: all required fields are there."""
    ok = F.lit(True)
    for f in REQUIRED_FIELDS:
        ok = ok & (F.col(f).isNotNull() if f in records.columns else F.lit(False))
    return records.withColumn("valid", ok)


def document_log(extracted: DataFrame, created_at: Column, scanned: DataFrame | None = None) -> DataFrame:
    """The outcome of every document of an extraction, also of those without tables and of failed
    ones; ``scanned`` (path, modificationTime) adds the version of the file."""
    is_table = F.col("ordinal") > 0
    per_document = extracted.groupBy("doc_id", "source_file").agg(
        F.max(F.when(~is_table, F.col("error"))).alias("error"),
        F.count_if(is_table).alias("total_tables"), F.count_if(is_table & F.col("ok")).alias("successful_tables"),
    )
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("total_tables") == 0, "no tables").otherwise("processed")
    if scanned is None:
        per_document = per_document.withColumn("modification_time", F.lit(None).cast("timestamp"))
    else:
        versions = scanned.select(F.col("path").alias("source_file"), F.col("modificationTime").alias("modification_time")).distinct()
        per_document = per_document.join(versions, "source_file", "left")
    return per_document.select(
        "doc_id", "source_file", "modification_time", status.alias("status"), "error", "total_tables", "successful_tables",
        created_at.alias("created_at"),
    )


def session_log(stored: DataFrame, run: str, created_at: Column) -> DataFrame:
    """One session row per source of a run. ``stored`` has a row per table, or a row per document as
    ``document_log`` gives, which also lists documents without tables."""
    if "total_tables" in stored.columns:
        counts = [F.sum("total_tables").alias("total_tables"), F.sum("successful_tables").alias("successful_tables")]
    else:
        counts = [F.count(F.lit(1)).alias("total_tables"), F.count_if("ok").alias("successful_tables")]
    return stored.groupBy("source_file").agg(*counts).select(
        F.concat(
            F.lit("session_"), F.substring(F.sha2(F.concat("source_file", F.lit("|" + run)), 256), 1, 16)
        ).alias("session_id"),
        "source_file",
        "total_tables",
        "successful_tables",
        created_at.alias("created_at"),
    )


# ---------------------------------------------------------------- the stored catalog


class Catalog:
    """The datasets under one root folder, in any file format Spark writes."""

    def __init__(self, spark: SparkSession, root: str, format: str = "parquet", buckets: int = 256):
        self.spark = spark
        self.root = root.rstrip("/")
        self.format = format
        self._asked_buckets = buckets

    # files
    def _path(self, dataset: str) -> str:
        return f"{self.root}/{dataset}"

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _names(self, folder: str) -> list[str]:
        """Names in a folder, by one listing."""
        fs, p = self._fs(self._path(folder))
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _create(self, name: str) -> bool:
        """Create an empty file; false where it is there already."""
        fs, p = self._fs(self._path(name))
        fs.mkdirs(p.getParent())
        return fs.createNewFile(p)

    def _delete(self, name: str) -> None:
        fs, p = self._fs(self._path(name))
        fs.delete(p, True)

    @property
    def buckets(self) -> int:
        """The number of buckets the stored rows have, or are to have in a new catalog."""
        kept = [n for n in self._names("_buckets") if n.isdigit()]
        return int(kept[0]) if kept else self._asked_buckets

    # numbers of writes
    def claim(self, label: str | None = None) -> int:
        """A number for a write that no other write has; the same one whenever ``label`` is the same."""
        name = hashlib.sha256(label.encode()).hexdigest() if label is not None else None
        claims = self._names("_claims")
        known = [n for n in claims if name is not None and n.endswith(f"-{name}")]
        if known:
            return min(int(n.split("-")[0]) for n in known)
        number = max([int(n) for n in claims if n.isdigit()] + [int(n) for n in self._names("_commits") if n.isdigit()], default=-1) + 1
        while not self._create(f"_claims/{number}"):
            number += 1
        if name is not None:
            self._create(f"_claims/{number}-{name}")
        return number

    def _committed(self) -> set[int]:
        return {int(n) for n in self._names("_commits") if n.isdigit()}

    def _read(self, dataset: str, schema: str) -> DataFrame:
        """A dataset without what unfinished writes left."""
        here = {int(n.split("=")[1]) for n in self._names(dataset) if n.startswith("ingest_seq=")}
        committed = self._committed()
        if not here & committed:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.format(self.format).schema(schema).load(self._path(dataset))
        unfinished = here - committed
        return df.filter(~F.col("ingest_seq").isin(*unfinished)) if unfinished else df

    # all versions
    def all_tables(self) -> DataFrame:
        return self._read("tables", TABLES_SCHEMA)

    def all_table_data(self) -> DataFrame:
        return self._read("table_data", TABLE_DATA_SCHEMA)

    def all_documents(self) -> DataFrame:
        return self._read("documents", DOCUMENTS_SCHEMA)

    def sessions(self) -> DataFrame:
        return self._read("processing_sessions", SESSIONS_SCHEMA)

    # current versions
    def current(self) -> tuple[DataFrame, DataFrame]:
        """Metadata and rows of the newest version of every document."""
        superseded = superseded_versions(self.all_documents())
        return without_versions(superseded, self.all_tables()), without_versions(superseded, self.all_table_data())

    def tables(self) -> DataFrame:
        return without_versions(superseded_versions(self.all_documents()), self.all_tables())

    def table_data(self) -> DataFrame:
        return without_versions(superseded_versions(self.all_documents()), self.all_table_data())

    def documents(self) -> DataFrame:
        """Every document in its newest version, with its outcome."""
        documents = self.all_documents()
        return without_versions(superseded_versions(documents), documents)

    def metadata_of(self, table_id: str, doc_id: str | None = None) -> DataFrame:
        """Current metadata of the tables with this display id, of one document if that is given."""
        found = self.tables().filter(F.col("table_id") == table_id)
        return found if doc_id is None else found.filter(F.col("doc_id") == doc_id)

    def rows_of(self, table_id: str, doc_id: str | None = None) -> DataFrame:
        """Current rows of one table; reads only its bucket of its newest write.

        A display id that several documents share is an error unless ``doc_id`` says which."""
        found = self.metadata_of(table_id, doc_id).select("doc_id", "ordinal", "ingest_seq").take(2)
        if len(found) > 1:
            raise ValueError(f"several documents have a table {table_id}; give a doc_id")
        if not found:
            return self.all_table_data().limit(0)
        one, ordinal, seq = found[0]
        bucket = self.spark.range(1).select(bucket_of(F.lit(one), self.buckets)).first()[0]
        return self.all_table_data().filter(
            (F.col("ingest_seq") == seq) & (F.col("bucket") == bucket) & (F.col("doc_id") == one) & (F.col("ordinal") == ordinal))

    def typed_table(self, table_id: str, doc_id: str | None = None) -> DataFrame:
        return typed_table(self.metadata_of(table_id, doc_id), self.rows_of(table_id, doc_id), table_id)

    def append(self, tables: DataFrame, table_data: DataFrame, sessions: DataFrame | None = None,
               ingest_seq: int | None = None, documents: DataFrame | None = None) -> int:
        """Write one batch and commit it; the documents in it replace their earlier versions.

        Rows without doc_id and ordinal take them from the batch's metadata by table id. Without
        ``documents``, those of the metadata are taken as processed. Returns the number of the write."""
        seq = self.claim() if ingest_seq is None else ingest_seq
        self._create(f"_buckets/{self._asked_buckets}") if not self._names("_buckets") else None
        self._delete(f"_commits/{seq}")
        if "ordinal" not in tables.columns:
            tables = tables.withColumn("ordinal", F.lit(1))
        if "doc_id" not in table_data.columns:
            table_data = table_data.join(tables.select("table_id", "doc_id", "ordinal"), "table_id")
        rows = (
            table_data.select("table_id", "doc_id", F.col("ordinal").cast("int"), F.col("row_index").cast("bigint"), "row_data", "created_at")
            .withColumn("bucket", bucket_of(F.col("doc_id"), self.buckets))
            .withColumn("_block", F.floor(F.col("row_index") / ROWS_PER_FILE))
        )
        (
            # sized at run time: small buckets share a task, a large one is split
            rows.hint("rebalance", "bucket", "_block").drop("_block")
            .sortWithinPartitions("bucket", "doc_id", "ordinal", "row_index")
            .write.format(self.format).mode("overwrite").partitionBy("bucket")
            .save(f"{self._path('table_data')}/ingest_seq={seq}")
        )
        if documents is None:
            documents = tables.groupBy("doc_id", "source_file").agg(
                F.count(F.lit(1)).alias("total_tables"), F.max("created_at").alias("created_at"),
            ).select(
                "doc_id", "source_file", F.lit(None).cast("timestamp").alias("modification_time"), F.lit("processed").alias("status"),
                F.lit(None).cast("string").alias("error"), "total_tables", F.col("total_tables").alias("successful_tables"), "created_at")
        for name, frame in (("processing_sessions", sessions), ("documents", documents), ("tables", tables)):
            if frame is not None:
                frame.write.format(self.format).mode("overwrite").save(f"{self._path(name)}/ingest_seq={seq}")
        self._create(f"_commits/{seq}")
        return seq

    def compact(self) -> int | None:
        """Write the current state as one write and delete the earlier ones, with what they superseded."""
        before = self._committed()
        if not before:
            return None
        tables, rows = self.current()
        seq = self.append(tables.drop("ingest_seq"), rows, self.sessions().drop("ingest_seq"), documents=self.documents().drop("ingest_seq"))
        for old in before:
            self._delete(f"_commits/{old}")
            for dataset in DATASETS:
                self._delete(f"{dataset}/ingest_seq={old}")
        return seq

    def clear(self) -> None:
        """Empty the catalog; nothing of it stays."""
        for name in ("_commits", *DATASETS, "_claims", "_buckets", "extracted"):
            self._delete(name)

    def backup(self, target: str) -> bool:
        """Copy the current catalog to another, empty root; false when there is nothing to copy."""
        if not self._committed():
            return False
        other = Catalog(self.spark, target, self.format, self.buckets)
        if other._committed():
            raise ValueError(f"the target of a backup must be empty: {target}")
        tables, rows = self.current()
        other.append(tables.drop("ingest_seq"), rows, self.sessions().drop("ingest_seq"), documents=self.documents().drop("ingest_seq"))
        return True

    def restore(self, source: str) -> bool:
        """Replace the catalog by a backup; false when that is missing. The copy is complete before it takes
        the catalog's place."""
        other = Catalog(self.spark, source, self.format)
        fresh, aside = (f"{self.root}.{kind}-{uuid.uuid4().hex}" for kind in ("restored", "replaced"))
        if not other.backup(fresh):
            return False
        fs, here = self._fs(self.root)
        if fs.exists(here):
            fs.rename(here, self._fs(aside)[1])
        fs.rename(self._fs(fresh)[1], here)
        fs.delete(self._fs(aside)[1], True)
        return True

    def sql(self, text: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
        """A query over ``tables``, ``table_data`` and ``processing_sessions``.

        Only queries are accepted. The frames become temporary views of these names, and
        ``json_extract(json, '$."name"')``, ``cast_integer`` and ``cast_real`` are there as
        functions, so that queries written for a JSON store of rows run as they are."""
        statement = text.strip().rstrip(";").strip()
        first = statement.split(None, 1)[0].upper() if statement else ""
        if first not in ("SELECT", "WITH", "VALUES", "(SELECT") or self._is_command(statement):
            raise ValueError("only queries can be run on the catalog")
        for create in SQL_FUNCTIONS:
            self.spark.sql(create)
        tables, rows = self.current()
        tables.createOrReplaceTempView("tables")
        rows.createOrReplaceTempView("table_data")
        self.sessions().createOrReplaceTempView("processing_sessions")
        return self.spark.sql(statement, args=dict(parameters) if parameters else None)

    def _is_command(self, statement: str) -> bool:
        """Whether a statement writes, wherever in it that is said: its parsed plan has a node that is no
        part of a query."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(statement).toString()
        except Exception:
            return False  # no SQL at all; the query itself says why
        return any(line.lstrip("+-: '").startswith(("Insert", "Create", "Drop", "Replace", "Alter", "Delete", "Update", "Merge", "Overwrite", "Append", "Load", "Truncate", "Set"))
                   for line in plan.splitlines())

    def schema_overview(self) -> tuple[DataFrame, DataFrame]:
        """All tables, and the totals, for a consumer."""
        tables, rows = self.current()
        return all_tables(tables), store_summary(tables, rows, self.sessions())
