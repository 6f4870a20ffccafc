"""Vector collections kept as catalogue tables.

A collection has a key, typed columns, a vector column and, if wanted, a
``_dynamic`` JSON column that keeps whatever the schema does not declare.
Metric and index kind are table properties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DYNAMIC = "_dynamic"
PREFIX = "trove."

# Collection defaults.
DENSE_DIM = 1536
INDEX_KIND = "AUTOINDEX"
DENSE_METRIC = "cosine"
SPARSE_METRIC = "ip"
DROP_RATIO = 0.2


def collection_schema(
    fields: T.StructType | None = None, hybrid: bool = False, dynamic: bool = True
) -> T.StructType:
    """Key and vector, then the typed fields, sparse vector and dynamic column."""
    out = T.StructType(
        [
            T.StructField("id", T.LongType(), False),
            T.StructField("embedding", T.ArrayType(T.FloatType())),
        ]
    )
    if hybrid:
        out.add("sparse", T.MapType(T.StringType(), T.DoubleType()))
    for field in fields or []:
        out.add(field)
    if dynamic:
        out.add(DYNAMIC, T.StringType())
    return out


def product_schema() -> T.StructType:
    """The fixed product collection: store, product, price and vector."""
    fields = T.StructType(
        [
            T.StructField("store_name", T.StringType()),
            T.StructField("product_name", T.StringType()),
            T.StructField("price", T.FloatType()),
        ]
    )
    return collection_schema(fields, dynamic=False)


def exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def create(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    metric: str = DENSE_METRIC,
    index: str = INDEX_KIND,
    dim: int | None = DENSE_DIM,
    if_absent: bool = False,
    path: str | None = None,
    partition: str | None = None,
    properties: dict | None = None,
) -> None:
    """Make an empty collection. ``if_absent`` leaves an existing one alone.

    Without ``path`` its data lie in the warehouse and go when it is dropped.
    ``partition`` names a last column whose values get folders of their own;
    further ``properties`` are recorded beside metric, index and dim.
    """
    if if_absent and exists(spark, name):
        return
    properties = {"metric": metric, "index": index, **(properties or {})}
    if dim is not None:
        properties["dim"] = str(dim)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    listed = ", ".join(f"'{PREFIX}{k}' = '{v}'" for k, v in properties.items())
    split = f"PARTITIONED BY (`{partition}`) " if partition else ""
    where = f"LOCATION '{path}' " if path else ""
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {split}{where}TBLPROPERTIES ({listed})")


def recreate(spark: SparkSession, name: str, schema: T.StructType, **kwargs) -> None:
    """Drop the collection if present and make it anew."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    create(spark, name, schema, **kwargs)


def settings(spark: SparkSession, name: str) -> dict[str, str]:
    """What the collection records about itself: ``metric``, ``index``, ``dim``."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    return {r["key"][len(PREFIX) :]: r["value"] for r in rows if r["key"].startswith(PREFIX)}


def location(spark: SparkSession, name: str) -> str:
    """The folder that the collection's data lie in."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").where("col_name = 'Location'")
    return rows.first()["data_type"].rstrip("/")


def insert(df: DataFrame, name: str) -> None:
    """Append rows, matching columns by name and packing undeclared ones.

    A vector whose length is not the recorded ``dim``, or that holds a null,
    fails the insert; see ``split_vectors``.
    """
    spark = df.sparkSession
    rows = fit(df, spark.table(name).schema)
    dim = settings(spark, name).get("dim")
    if dim is not None:
        found = F.format_string("vector of another length than %s or with a null", F.lit(dim))
        checked = F.when(~wrong_vector(int(dim)), F.col("embedding")).otherwise(F.raise_error(found))
        rows = rows.withColumn("embedding", checked)
    rows.write.insertInto(name)


def wrong_vector(dim: int, vector_col: str = "embedding") -> Column:
    """Whether a vector that is there has another length or holds a null."""
    uneven = (F.size(vector_col) != dim) | F.exists(vector_col, lambda x: x.isNull())
    return F.coalesce(F.col(vector_col).isNotNull() & uneven, F.lit(False))


def split_vectors(df: DataFrame, dim: int, vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Rows that a collection of this ``dim`` takes, and those that it refuses."""
    wrong = wrong_vector(dim, vector_col)
    return df.where(~wrong), df.where(wrong)


def insert_row(spark: SparkSession, name: str, **values) -> None:
    """Append one row given as keyword values."""
    declared = [f for f in spark.table(name).schema.fields if f.name in values]
    row = spark.createDataFrame(
        [tuple(values[f.name] for f in declared)], T.StructType(declared)
    )
    insert(row, name)


def fit(df: DataFrame, target: T.StructType) -> DataFrame:
    """Cast to the declared types and pack other columns into ``_dynamic``.

    A value that cannot be cast becomes null; a missing column is null.
    """
    names = {f.name for f in target.fields}
    spare = [c for c in df.columns if c not in names]
    out = []
    for field in target.fields:
        if field.name == DYNAMIC and DYNAMIC not in df.columns:
            packed = F.to_json(F.struct(*spare)) if spare else F.lit(None).cast("string")
            out.append(packed.alias(DYNAMIC))
        elif field.name in df.columns:
            out.append(cast_to(df, field).alias(field.name))
        else:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
    return df.select(*out)


def cast_to(df: DataFrame, field: T.StructField) -> Column:
    """``try_cast`` where the types differ, else the column itself."""
    if df.schema[field.name].dataType == field.dataType:
        return F.col(field.name)
    return F.col(field.name).try_cast(field.dataType)


def dynamic_field(name: str, packed: str = DYNAMIC, kind: str = "string") -> Column:
    """Read one packed field back."""
    return F.get_json_object(F.col(packed), f"$.{name}").try_cast(kind)


def with_auto_id(df: DataFrame, name: str | None = None, id_col: str = "id") -> DataFrame:
    """Add a unique LONG key above the highest key the collection holds.

    The ids are made inside each task, so no shuffle or global sort is needed;
    they are unique but not consecutive.
    """
    start = 0
    spark = df.sparkSession
    if name is not None and exists(spark, name):
        top = spark.table(name).agg(F.max(id_col)).first()[0]
        start = 0 if top is None else top + 1
    return df.select((F.monotonically_increasing_id() + F.lit(start)).alias(id_col), "*")


def describe(spark: SparkSession, name: str) -> DataFrame:
    """Columns, properties and row count of one collection, as rows."""
    table = spark.table(name)
    columns = [("column", f.name, f.dataType.simpleString()) for f in table.schema.fields]
    properties = [("property", k, v) for k, v in settings(spark, name).items()]
    listed = spark.createDataFrame(columns + properties, "kind string, name string, value string")
    rows = table.agg(F.count(F.lit(1)).cast("string").alias("value")).select(
        F.lit("rows").alias("kind"), F.lit("row_count").alias("name"), "value"
    )
    return listed.unionByName(rows)


def list_collections(spark: SparkSession, database: str = "default") -> DataFrame:
    """Names of the tables that carry collection properties."""
    found = []
    for table in spark.catalog.listTables(database):
        if table.isTemporary:
            continue
        rows = spark.sql(f"SHOW TBLPROPERTIES {database}.{table.name}").collect()
        if any(r["key"].startswith(PREFIX) for r in rows):
            found.append((table.name,))
    return spark.createDataFrame(found, "collection string")


def set_index(spark: SparkSession, name: str, index: str, replace: bool = False) -> None:
    """Record the index kind; an existing entry stays unless ``replace``."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").collect()
    if not replace and any(r["key"] == f"{PREFIX}index" for r in rows):
        return
    spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('{PREFIX}index' = '{index}')")
