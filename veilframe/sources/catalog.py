"""Tables with their declared ranges; readers, writers, generated data."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.bounds import Bounds
from ..plans.dialects import DIALECTS, query
from ..plans.nodes import TYPES, Relation, Table, table
from ..plans.sql import parse

SYNTHETIC = "_SYNTHETIC_"
SQL_TYPES = {"boolean": "BOOLEAN", "integer": "BIGINT", "float": "DOUBLE", "text": "STRING", "bytes": "BINARY", "date": "DATE", "datetime": "TIMESTAMP_NTZ", "duration": "INTERVAL DAY TO SECOND", "time": "STRING"}


class Catalog:
    """Relations by name. Ranges, uniqueness and sizes are declared, never taken from private data."""

    def __init__(self, tables: dict[str, Relation] | None = None):
        self.tables: dict[str, Relation] = dict(tables or {})
        self.synthetic: dict[str, Relation] = {}

    def __getitem__(self, name: str) -> Relation:
        return self.tables[name]

    def add(self, name: str, df, declared: dict[str, Bounds] | None = None, unique: set[str] = frozenset(), size: float = math.inf) -> Relation:
        """df: a DataFrame, whose schema is read. declared: ranges by column; the rest stays unknown."""
        schema = {}
        for f in df.schema:
            b = (declared or {}).get(f.name)
            schema[f.name] = (TYPES.get(type(f.dataType), "unknown"), b if b is not None else Bounds(None, f.nullable), f.name in unique)
        self.tables[name] = table(name, schema, (0, size), load=lambda spark, df=df: df)
        return self.tables[name]

    def redirect(self, name: str, df=None) -> None:
        """The synthetic stand-in of a table: df, or the table of that name with the prefix."""
        own = self.tables[name]
        other = self.tables.get(SYNTHETIC + name) if df is None else Table(own.fields, own.size, SYNTHETIC + name, lambda spark, df=df: df)
        if other is None:
            raise ValueError(f"no synthetic table for {name}")
        self.synthetic[name] = other

    def sql(self, text: str) -> Relation:
        return parse(text, self.tables)

    def run(self, spark: SparkSession, text: str) -> DataFrame:
        return self.sql(text).dataframe(spark)


def read(spark: SparkSession, path: str, kind: str = "parquet", **options) -> DataFrame:
    return spark.read.format(kind).options(**options).load(path)


def jdbc(spark: SparkSession, url: str, name: str, partition: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """A database's table, read by ranges of a column if partition = (column, low, high, number) is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition:
        c, low, high, n = partition
        reader = reader.options(partitionColumn=c, lowerBound=low, upperBound=high, numPartitions=n)
    return reader.load()


#: URL patterns and driver classes of the databases.
DATABASES = {
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
    "redshift": ("jdbc:redshift://{host}:{port}/{database}", 5439, "com.amazon.redshift.jdbc42.Driver"),
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433, "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "sqlite": ("jdbc:sqlite:{database}", 0, "org.sqlite.JDBC"),
}


@dataclass(frozen=True)
class Database:
    """A database that Spark reads and writes by its own driver, which must be on the class path."""

    kind: str
    database: str
    host: str = "localhost"
    port: int | None = None
    options: tuple[tuple[str, str], ...] = ()  # user, password, fetchsize ...

    def settings(self, name: str) -> dict[str, str]:
        url, port, driver = DATABASES[self.kind]
        return {"url": url.format(host=self.host, port=self.port or port, database=self.database), "driver": driver, "dbtable": name, **dict(self.options)}

    def read(self, spark: SparkSession, name: str, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
        own = self.settings(name)
        return jdbc(spark, own.pop("url"), own.pop("dbtable"), partition, **own)

    def query(self, spark: SparkSession, r: Relation) -> DataFrame:
        """The relation run by the database, as a query in its dialect."""
        own = self.settings("")
        del own["dbtable"]
        return spark.read.format("jdbc").options(**own, query=query(r, self.kind)).load()

    def create(self, df: DataFrame, name: str) -> None:
        self.writer(df.limit(0), name).mode("errorifexists").save()

    def insert(self, df: DataFrame, name: str, batch: int = 10_000) -> None:
        self.writer(df, name).option("batchsize", batch).mode("append").save()

    def writer(self, df: DataFrame, name: str):
        return df.write.format("jdbc").options(**self.settings(name))


def bigquery(spark: SparkSession, name: str | None = None, r: Relation | None = None, **options) -> DataFrame:
    """A table, or a relation run there as a query; the connector for that source must be on the class path."""
    reader = spark.read.format("bigquery").options(**options)
    return reader.load(name) if r is None else reader.option("viewsEnabled", "true").option("query", query(r, "bigquery")).load()


def bigquery_insert(df: DataFrame, name: str, create: bool = False, **options) -> None:
    df.write.format("bigquery").options(**{"writeMethod": "direct", **options}).mode("errorifexists" if create else "append").save(name)


#: Column types where a dialect's own differ from those of its casts.
COLUMN_TYPES = {
    "postgresql": {"bytes": "BYTEA", "time": "TIME", "duration": "INTERVAL"},
    "redshift": {"text": "VARCHAR(65535)", "bytes": "VARBYTE", "time": "TIME"},
    "mysql": {"text": "LONGTEXT", "integer": "BIGINT", "bytes": "LONGBLOB", "time": "TIME"},
    "mssql": {"boolean": "BIT", "bytes": "VARBINARY(MAX)", "time": "TIME"},
    "sqlite": {"boolean": "INTEGER", "bytes": "BLOB", "date": "TEXT", "time": "TEXT", "duration": "TEXT"},
    "bigquery": {"boolean": "BOOL", "bytes": "BYTES", "time": "TIME", "duration": "INTERVAL"},
}


def column_type(kind: str, dialect: str) -> str:
    if dialect in ("spark", "databricks", "hive"):
        return "TIMESTAMP" if dialect == "hive" and kind == "datetime" else SQL_TYPES.get(kind, "STRING")
    own = {"boolean": "BOOLEAN", "date": "DATE", **DIALECTS[dialect].types, **COLUMN_TYPES[dialect]}
    return own.get(kind, own["text"])


def create_table_sql(r: Relation, name: str, dialect: str = "spark") -> str:
    """NOT NULL where a column's declared range has no null."""
    d = DIALECTS[dialect]
    columns = ", ".join(f"{d.ident(f.name)} {column_type(f.type, dialect)}{'' if f.bounds.nullable else ' NOT NULL'}" for f in r.fields)
    return f"CREATE TABLE {d.ident(name)} ({columns})" + {"spark": " USING parquet", "databricks": " USING delta", "hive": " STORED AS PARQUET"}.get(dialect, "")


def insert_sql(r: Relation, name: str, dialect: str = "spark") -> str:
    """With the dialect's placeholders for the values of a row."""
    d = DIALECTS[dialect]
    marks = [{"postgresql": f"${i}", "redshift": f"${i}", "mssql": f"@p{i}", "bigquery": f"@p{i}"}.get(dialect, "?") for i in range(1, len(r.fields) + 1)]
    return f"INSERT INTO {d.ident(name)} ({', '.join(d.ident(f.name) for f in r.fields)}) VALUES ({', '.join(marks)})"


def create(df: DataFrame, name: str) -> None:
    df.limit(0).write.saveAsTable(name)


def insert(df: DataFrame, name: str) -> None:
    df.write.mode("append").saveAsTable(name)


def random_rows(spark: SparkSession, r: Relation, n: int, seed: int = 1234) -> DataFrame:
    """n rows whose values lie in the columns' ranges."""
    cols = []
    for i, f in enumerate(r.fields):
        u = F.rand(seed + i)
        b = f.bounds
        if f.unique:
            c = F.col("id") if f.type == "integer" else F.md5(F.concat(F.lit(f.name), F.col("id").cast("string")))
        elif b.finite and b.parts:
            c = F.get(F.array(*map(F.lit, b.values())), F.floor(u * len(b.parts)).cast("int"))
        elif f.type in ("integer", "float"):
            low, high = (b.low, b.high) if b.absolute() is not None and b.parts else (0, 100)
            c = F.lit(float(low)) + u * float(high - low)
            c = F.floor(c + 0.5).cast("bigint") if f.type == "integer" else c
        elif f.type == "boolean":
            c = u < 0.5
        elif f.type in ("date", "datetime"):
            low = F.lit(b.low) if b.parts else F.to_date(F.lit("2000-01-01"))
            days = (b.high - b.low).days if b.parts else 8000
            c = F.date_add(low.cast("date"), F.floor(u * (days + 1)).cast("int")).cast("date" if f.type == "date" else "timestamp_ntz")
        else:
            c = F.substring(F.md5((u * 1e9).cast("string")), 1, 8)
        cols.append((F.when(F.rand(seed + 1000 + i) < 0.1, None).otherwise(c) if b.nullable and not f.unique and b.known else c).alias(f.name))
    return spark.range(n).select(*cols)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Both hold the same rows equally often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()
