"""Sinks: tagged JSON lines, tables, a database, GraphML files.

publish() and import_database() are transactional: rows are staged where no reader looks, and become visible
all at once, together with the id of the run that brought them. A run that is killed leaves nothing to see, one
that is repeated adds nothing, and so does a task that is run twice.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spoor.functions.urls import upsert
from spoor.session import discard, ship, written


def json_lines(df: DataFrame, tag: str) -> DataFrame:
    """value: ["tag", {...}] of each row."""
    return df.select(F.concat(F.lit(f'["{tag}",'), F.to_json(F.struct(*df.columns)), F.lit("]")).alias("value"))


def write_json_lines(df: DataFrame, tag: str, path: str) -> None:
    json_lines(df, tag).write.mode("append").text(path)


def write_table(df: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Append to a Parquet table; with keys, only rows whose key it hasn't got."""
    spark = df.sparkSession
    if keys:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            df = upsert(spark.read.parquet(path), df, keys)
        else:
            df = df.dropDuplicates(keys)
    df.write.mode("append").parquet(path)


def write_jdbc(df: DataFrame, url: str, name: str, properties: dict[str, str]) -> None:
    df.write.jdbc(url, name, mode="append", properties=properties)


def read_submissions(spark: SparkSession, url: str, name: str, properties: dict[str, str], id_col: str = "id", url_col: str = "url") -> DataFrame:
    """id, url of submissions, from a database: what root_domains() joins with."""
    return spark.read.jdbc(url, name, properties=properties).select(F.col(id_col).cast("string").alias("id"), F.col(url_col).alias("url"))


def write_graphml(graphs: DataFrame, path: str) -> None:
    """A folder of text files for each log, by what causality.graphs() gives; in the order of their names they are the log's document."""
    in_order = graphs.repartitionByRange("log_id", "part").sortWithinPartitions("log_id", "part")
    in_order.select("log_id", "value").write.mode("overwrite").partitionBy("log_id").text(path)


# ---- a table of Parquet folders, published by manifests


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest_of(spark: SparkSession, path: str) -> dict:
    """version, folders (of rows that readers see) and runs of a published table; version 0 before the first."""
    at, fs = _fs(spark, f"{path}/_manifests")
    names = sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName().endswith(".json")) if fs.exists(at) else []
    if not names:
        return {"version": 0, "folders": [], "runs": []}
    return json.loads("".join(r[0] for r in spark.read.text(f"{path}/_manifests/{names[-1]}", wholetext=True).collect()))


def _commit(spark: SparkSession, path: str, manifest: dict) -> bool:
    """Make a manifest the newest; false if another writer has made one of its version."""
    staged, fs = _fs(spark, f"{path}/_manifests/.{uuid.uuid4().hex}")
    out = fs.create(staged, False)
    out.write(json.dumps(manifest).encode())
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_manifests/{manifest['version']:012}.json")
    plain = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename").NONE  # without overwriting
    how = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = plain
    try:
        files.rename(staged, target, how)
    except Exception as e:  # of the JVM
        if "FileAlreadyExists" not in str(e):
            raise
        fs.delete(staged, False)
        return False
    return True


def publish(df: DataFrame, path: str, run: str, keys: list[str] | None = None) -> bool:
    """Append df to a published table, or with keys those rows whose key it hasn't got; false if this run did so before.

    Writers that publish at once each build on the version that they read; one whose version is taken tries again on the newer one.
    """
    spark = df.sparkSession
    while True:
        now = manifest_of(spark, path)
        if run in now["runs"]:
            return False
        rows = df
        if keys:
            rows = upsert(published(spark, path), df, keys) if now["folders"] else df.dropDuplicates(keys)
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{path}/{folder}")
        if _commit(spark, path, {"version": now["version"] + 1, "folders": [*now["folders"], folder], "runs": [*now["runs"], run]}):
            return True
        at, fs = _fs(spark, f"{path}/{folder}")
        fs.delete(at, True)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version of a published table."""
    folders = manifest_of(spark, path)["folders"]
    if not folders:
        raise ValueError(f"nothing is published at {path}")
    return spark.read.parquet(*(f"{path}/{f}" for f in folders))


# ---- a database, by an import table and one transaction


def _attempts(batches):
    """Rows with the number of the task's attempt."""
    import pyarrow as pa
    from pyspark import TaskContext

    own = TaskContext.get().taskAttemptId()
    for b in batches:
        at = b.schema.get_field_index("attempt")
        yield b.set_column(at, b.schema.field(at), pa.array([own] * b.num_rows, pa.int64()))


def import_database(df: DataFrame, url: str, name: str, run: str, properties: dict[str, str], keys: list[str] | None = None, column_types: str | None = None) -> bool:
    """Append df to a table by way of an import table, or with keys those rows whose key the table hasn't got; false if this run did so before.

    Tasks write to <name>_import, with a number for each row and that of the attempt, so that a task that is run twice
    brings nothing twice. One transaction inside the database then notes the run in <name>_runs and moves the rows.
    column_types: types of columns for tables that are made, as Spark's option createTableColumnTypes has them; those of keys must be comparable.
    """
    spark = df.sparkSession
    ship(spark)
    sql = spark._jvm.java.sql.DriverManager
    props = spark._jvm.java.util.Properties()
    for k, v in properties.items():
        if k != "driver":
            props.setProperty(k, v)
    if "driver" in properties:
        spark._jvm.java.lang.Class.forName(properties["driver"], True, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
    stage, runs = f"{name}_import", f"{name}_runs"
    options = {**properties, **({"createTableColumnTypes": column_types} if column_types else {})}
    rows = written(df.dropDuplicates(keys) if keys else df, "import")  # so that a task that is run again numbers the same rows alike
    quote = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier  # as Spark names the columns of tables it makes
    cols, row_no, attempt, run_col = ", ".join(map(quote, df.columns)), quote("row_no"), quote("attempt"), quote("run")

    def has(table: str) -> bool:
        try:
            spark.read.jdbc(url, table, properties=properties).limit(0).collect()
            return True
        except Exception:  # whatever the database says when there is no such table
            return False

    if not has(runs):
        spark.createDataFrame([], "run string").write.option("createTableColumnTypes", "run VARCHAR(200)").jdbc(url, runs, properties=properties)
    if not has(name):
        df.limit(0).write.options(**options).jdbc(url, name, properties=properties)
    numbered = rows.withColumn("row_no", F.monotonically_increasing_id()).withColumn("attempt", F.lit(0).cast("long"))
    numbered.mapInArrow(_attempts, numbered.schema).write.options(**options).jdbc(url, stage, mode="overwrite", properties=properties)
    con = sql.getConnection(url, props)
    try:
        con.setAutoCommit(False)
        does = con.createStatement()
        quoted = run.replace("'", "''")
        known = does.executeQuery(f"select count(*) from {runs} where {run_col} = '{quoted}'")
        known.next()
        if known.getInt(1):
            con.rollback()
            return False
        does.executeUpdate(f"insert into {runs} values ('{quoted}')")
        there = " and ".join(f"t.{quote(k)} = i.{quote(k)}" for k in keys or ())
        fresh = f" and not exists (select 1 from {name} t where {there})" if keys else ""
        does.executeUpdate(f"insert into {name} ({cols}) select {cols} from {stage} i where {attempt} = (select max({attempt}) from {stage} j where j.{row_no} = i.{row_no}){fresh}")
        does.executeUpdate(f"drop table {stage}")
        con.commit()
        return True
    except BaseException:
        con.rollback()
        raise
    finally:
        con.close()
        discard(rows)
