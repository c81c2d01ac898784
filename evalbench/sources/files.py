"""Readers of the engine's file formats; schemas are declared, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "chunk_id string, document_id string, content string, page_start int, page_end int, parse_snapshot string, strategy string"
CHECKPOINTS = "document_id string, source_sha256 string, expected_pages int, mode string, status string, elements array<struct<page:int,category:string,content:string>>"


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; a line that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def chunk_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of one parse snapshot and one strategy with unique ids; anything else raises."""
    df = json_lines(spark, path, CHUNKS)
    n, ids, snapshots, strategies = df.agg(F.count(F.lit(1)), F.countDistinct("chunk_id"), F.countDistinct("parse_snapshot"), F.countDistinct("strategy")).first()
    if n != ids or snapshots > 1 or strategies > 1:
        raise ValueError(f"{n} chunks with {ids} ids of {snapshots} snapshots and {strategies} strategies")
    return df


WINDOWS = "window_id string, document_id string, page_start int, page_end int, content string"


def source_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows, one object a line; raises with the numbers of the first lines that are no window (all fields, pages in order)."""
    fields = [f.split(" ")[0] for f in WINDOWS.split(", ")]
    lines = spark.read.text(path).select(F.col("value"), F.from_json("value", WINDOWS).alias("w"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id"))
    good = F.col("w").isNotNull() & F.forall(F.array(*[F.col(f"w.{f}").isNotNull() for f in fields]), lambda ok: ok) & (F.col("w.page_start") <= F.col("w.page_end"))
    bad = lines.where(~F.coalesce(good, F.lit(False))).select("part", "id").limit(10).collect()
    if bad:
        sizes = dict(lines.groupBy("part").agg(F.count(F.lit(1))).collect())  # one row a split
        ahead = lambda part: sum(n for p, n in sizes.items() if p < part)
        raise ValueError("no window on line " + ", ".join(str(ahead(r.part) + (r.id & (1 << 33) - 1) + 1) for r in bad))
    return lines.select("w.*")


def yaml_mapping(text: str) -> dict:
    """A YAML document whose root is a mapping; a repeated key raises. Needs a YAML parser."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml package") from error

    class Unique(yaml.SafeLoader):
        def construct_mapping(self, node, deep=False):
            keys = [self.construct_object(k, deep=True) for k, _ in node.value]
            if len(set(keys)) < len(keys):
                raise ValueError("a key is repeated")
            return super().construct_mapping(node, deep)

    found = yaml.load(text, Loader=Unique)
    if not isinstance(found, dict):
        raise ValueError("the root is no mapping")
    return found


def yaml_rows(spark: SparkSession, text: str, key: str, schema: str) -> DataFrame:
    """The list of mappings under ``key`` as rows; fields that the schema lacks or a mapping lacks raise."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    rows = yaml_mapping(text).get(key, [])
    for r in rows:
        if set(r) != set(names):
            raise ValueError(f"fields {sorted(r)} instead of {sorted(names)}")
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, CHECKPOINTS)


def elements(checkpoint_rows: DataFrame) -> DataFrame:
    """Elements of checkpoints with their place."""
    return checkpoint_rows.select("document_id", F.posexplode("elements").alias("idx", "e")).select("document_id", "idx", "e.page", "e.category", "e.content")


def bundle(spark: SparkSession, paths: list[str], collections: dict[str, str]) -> dict[str, DataFrame]:
    """JSON bundles whose top level holds arrays: a DataFrame a collection, unioned over the files."""
    schema = ", ".join(f"{name} array<struct<{fields}>>" for name, fields in collections.items())
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    return {name: raw.select(F.explode(name).alias("r")).select("r.*") for name in collections}


def sealed_lines(spark: SparkSession, path: str, sha256: str) -> DataFrame:
    """Lines of a file whose content has the given hash; raises otherwise. A sealed file is one bounded file."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).collect()
    if [r.h for r in found] != [sha256]:
        raise ValueError("the sealed file has changed")
    return spark.read.text(path)
