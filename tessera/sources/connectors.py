"""Network and database connectors: option builders for Spark's own
connectors (JDBC, Kafka, MongoDB, Elasticsearch, Redis, BigQuery, S3A).

None of these were run against live systems here: the tests check the
options they build.  Reads are partitioned by the connector (JDBC
``partitionColumn`` ranges, Kafka topic partitions); nothing is fetched
through the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# JDBC URL prefixes, default ports and driver classes per vendor.
JDBC_VENDORS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306, "com.mysql.cj.jdbc.Driver"),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432, "org.postgresql.Driver"),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433,
              "com.microsoft.sqlserver.jdbc.SQLServerDriver"),
    "oracle": ("jdbc:oracle:thin:@{host}:{port}/{database}", 1521, "oracle.jdbc.OracleDriver"),
    "clickhouse": ("jdbc:clickhouse://{host}:{port}/{database}", 8123, "com.clickhouse.jdbc.ClickHouseDriver"),
    "derby": ("jdbc:derby:{database}", 0, "org.apache.derby.iapi.jdbc.AutoloadedDriver"),
}


def jdbc_options(vendor: str, *, host: str = "localhost", port: int | None = None, database: str = "",
                 user: str | None = None, password: str | None = None, query: str | None = None,
                 table: str | None = None, partition_column: str | None = None, lower_bound=None,
                 upper_bound=None, num_partitions: int | None = None, fetchsize: int = 10_000,
                 limit: int | None = None) -> dict:
    """Options for ``spark.read.format("jdbc")``.  A ``query`` with a
    ``limit`` is wrapped so the database applies the row cap; a partition
    column splits the read into ``num_partitions`` range queries."""
    if vendor not in JDBC_VENDORS:
        raise ValueError(f"unknown JDBC vendor {vendor!r}")
    tmpl, default_port, driver = JDBC_VENDORS[vendor]
    opts = {"url": tmpl.format(host=host, port=port or default_port, database=database), "driver": driver,
            "fetchsize": str(fetchsize)}
    if user is not None:
        opts["user"] = user
    if password is not None:
        opts["password"] = password
    if query and table:
        raise ValueError("give either query or table")
    if query:
        q = query.strip().rstrip(";")
        if limit:
            q = f"SELECT * FROM ({q}) q LIMIT {int(limit)}" if vendor not in ("mssql", "oracle", "derby") else \
                (f"SELECT TOP {int(limit)} * FROM ({q}) q" if vendor == "mssql" else
                 f"SELECT * FROM ({q}) q FETCH FIRST {int(limit)} ROWS ONLY")
        if partition_column:
            opts["dbtable"] = f"({q}) src"
        else:
            opts["query"] = q
    elif table:
        opts["dbtable"] = table
    else:
        raise ValueError("a query or a table is required")
    if partition_column:
        if lower_bound is None or upper_bound is None or not num_partitions:
            raise ValueError("partition_column needs lower_bound, upper_bound and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower_bound), upperBound=str(upper_bound),
                    numPartitions=str(num_partitions))
    return opts


def kafka_options(bootstrap: str, topic: str, *, starting: str = "earliest", ending: str | None = "latest",
                  extra: dict | None = None) -> dict:
    """Bounded (batch) read of a topic: earliest -> latest offsets."""
    o = {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "startingOffsets": starting}
    if ending:
        o["endingOffsets"] = ending
    o.update(extra or {})
    return o


def mongo_options(uri: str, database: str, collection: str, filter_json: str | None = None,
                  limit: int | None = None) -> dict:
    """MongoDB Spark connector: the JSON filter becomes a ``$match`` stage."""
    pipeline = []
    if filter_json:
        pipeline.append({"$match": json.loads(filter_json)})
    if limit:
        pipeline.append({"$limit": int(limit)})
    o = {"connection.uri": uri, "database": database, "collection": collection}
    if pipeline:
        o["aggregation.pipeline"] = json.dumps(pipeline)
    return o


def elasticsearch_options(nodes: str, index: str, query_json: str | None = None, port: int = 9200) -> dict:
    o = {"es.nodes": nodes, "es.port": str(port), "es.resource": index, "es.read.metadata": "false"}
    if query_json:
        o["es.query"] = query_json
    return o


def redis_options(host: str, port: int = 6379, key_pattern: str = "*", db: int = 0) -> dict:
    return {"host": host, "port": str(port), "keys.pattern": key_pattern, "dbNum": str(db), "infer.schema": "true"}


def bigquery_options(project: str, dataset: str, table: str) -> dict:
    return {"table": f"{project}.{dataset}.{table}"}


def s3_path(bucket: str, prefix: str = "") -> str:
    return f"s3a://{bucket}/{prefix.lstrip('/')}"


#: Connectors whose reader takes a row limit itself.
LIMIT_AT_SOURCE = frozenset(JDBC_VENDORS) | {"mongodb"}

FORMATS = {"kafka": "kafka", "mongodb": "mongodb", "elasticsearch": "org.elasticsearch.spark.sql",
           "redis": "org.apache.spark.sql.redis", "bigquery": "bigquery"}


def load(spark: SparkSession, kind: str, params: dict) -> DataFrame:
    """Dispatch a connector spec to a DataFrame reader."""
    p = dict(params)
    if kind in JDBC_VENDORS:
        return spark.read.format("jdbc").options(**jdbc_options(kind, **p)).load()
    if kind == "kafka":
        from pyspark.sql import functions as F
        schema = p.pop("schema", None)
        raw = spark.read.format("kafka").options(**kafka_options(**p)).load()
        return decode_kafka_json(raw.select(F.col("value").cast("string").alias("value")), schema)
    if kind == "s3":
        from tessera.sources.inventory import file_inventory
        return file_inventory(spark, s3_path(p["bucket"], p.get("prefix", "")))
    if kind in ("mongodb", "elasticsearch", "redis", "bigquery"):
        builder = {"mongodb": mongo_options, "elasticsearch": elasticsearch_options, "redis": redis_options,
                   "bigquery": bigquery_options}[kind]
        df = spark.read.format(FORMATS[kind]).options(**builder(**p)).load()
        if kind == "mongodb" and "_id" in df.columns:
            from pyspark.sql import functions as F
            df = df.withColumn("_id", F.col("_id").cast("string"))  # ObjectId -> text, as the reference does
        return df
    raise ValueError(f"unknown connector {kind!r}")


def decode_kafka_json(values: DataFrame, schema=None, column: str = "value") -> DataFrame:
    """JSON message values -> columns.  A value that is not a JSON object is
    wrapped as ``{"value": v}`` (the reference's rule)."""
    from pyspark.sql import functions as F
    v = F.col(column)
    parsed = F.try_parse_json(v)
    is_obj = F.schema_of_variant(parsed).startswith("OBJECT")
    wrapped = (F.when(is_obj, v)
               .when(parsed.isNotNull(), F.to_json(F.struct(parsed.alias("value"))))
               .otherwise(F.to_json(F.struct(v.alias("value")))))
    if schema is None:
        return values.select(wrapped.alias("json"))
    return values.select(F.from_json(wrapped, schema).alias("r")).select("r.*")
