"""Knowledge bases: named collections of chunks in a catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.chunking import chunks_web
from quillspan.plans.sync import Catalog, upsert

BASES = "base_id string, name string, created_at timestamp, updated_at timestamp, semantic_model string"
CHUNKS = "base_id string, chunk_id string, source_id string, source_name string, source_type string, location string, text string, url string, metadata map<string,string>, embedding array<float>"
DEFAULT_NAME = "Mi base"


def base_identity(name: str) -> str:
    """A stable id from a name, so that a repeated run makes the same base."""
    import hashlib

    return hashlib.sha256(name.encode()).hexdigest()[:16]


def list_bases(catalog: Catalog) -> DataFrame:
    """The bases, the last changed first."""
    return catalog.read("bases", BASES).orderBy(F.desc("updated_at"), "base_id")


SETTINGS = "name string, value string"

# The demonstration base: texts of this project's own.
DEMO_NAME = "Base de demostración"
DEMO = (
    ("memoria.txt", "línea 1", "La memoria de trabajo mantiene activa la información que una tarea necesita y la renueva a medida que la tarea avanza."),
    ("memoria.txt", "línea 3", "Repasar en días distintos ayuda a recordar más que repasar mucho en un solo día."),
    ("barrio.txt", "línea 1", "Un barrio es más que un conjunto de calles: lo forman sus vecinos, su historia y las instituciones que comparten."),
    ("barrio.txt", "línea 3", "Las demandas de un barrio cambian cuando sus organizaciones logran ponerlas en palabras."),
)


def demo_chunks(spark: SparkSession, base_id: str) -> DataFrame:
    """The chunks of the demonstration base."""
    rows = [(base_id, f"{base_id}-{i}", name, name, "txt", place, text, None, None, None) for i, (name, place, text) in enumerate(DEMO)]
    return spark.createDataFrame(rows, CHUNKS)


def initialize(catalog: Catalog) -> str:
    """Readies the catalog and returns the base to show: the last one used, else the last one changed.

    An empty catalog is given the demonstration base.
    """
    bases = list_bases(catalog)
    if bases.isEmpty():
        key = create_base(catalog, DEMO_NAME)
        catalog.publish({"base_chunks": upsert(catalog.read("base_chunks", CHUNKS), demo_chunks(catalog.spark, key), "chunk_id")})
        return key
    used = catalog.read("settings", SETTINGS).filter("name = 'last_base'").select(F.col("value").alias("base_id"))
    kept = bases.join(F.broadcast(used), "base_id", "left_semi").first()  # one row of settings
    return (kept or bases.first()).base_id


def select_base(catalog: Catalog, base_id: str) -> None:
    """Remembers the base for the next start; refuses one that isn't there."""
    if catalog.read("bases", BASES).filter(F.col("base_id") == base_id).isEmpty():
        raise KeyError(base_id)
    catalog.publish({"settings": catalog.spark.createDataFrame([("last_base", base_id)], SETTINGS)})


def create_base(catalog: Catalog, name: str) -> str:
    name = name.strip() or DEFAULT_NAME
    key = base_identity(name)
    now = F.current_timestamp()
    row = catalog.spark.range(1).select(F.lit(key).alias("base_id"), F.lit(name).alias("name"), now.alias("created_at"), now.alias("updated_at"), F.lit(None).cast("string").alias("semantic_model"))
    catalog.publish({"bases": upsert(row, catalog.read("bases", BASES), "base_id")})
    return key


def delete_base(catalog: Catalog, base_id: str) -> None:
    """Takes a base and its chunks away; an empty one is made when none is left."""
    bases = catalog.read("bases", BASES).filter(F.col("base_id") != base_id)
    catalog.publish({"bases": bases, "base_chunks": catalog.read("base_chunks", CHUNKS).filter(F.col("base_id") != base_id)})
    if catalog.read("bases", BASES).isEmpty():
        create_base(catalog, DEFAULT_NAME)


def append_segments(catalog: Catalog, base_id: str, segments: DataFrame) -> None:
    """Cuts segments (source_id, source_name, source_type, seg_idx, text, location, url, metadata) into chunks of a base.

    Chunks that are there keep their vectors, so that a base may have some with
    and some without; the model on record is cleared. Ids follow from source,
    segment and part, and a repeated append changes nothing.
    """
    cut = chunks_web(segments)
    made = cut.select(
        F.lit(base_id).alias("base_id"),
        F.substring(F.sha2(F.concat_ws("\x01", F.lit(base_id), "source_id", F.col("seg_idx").cast("string"), F.col("part").cast("string"), "text"), 256), 1, 24).alias("chunk_id"),
        "source_id", "source_name", "source_type", "location", "text", "url", "metadata", F.lit(None).cast("array<float>").alias("embedding"),
    )
    touched = catalog.read("bases", BASES).withColumn("updated_at", F.when(F.col("base_id") == base_id, F.current_timestamp()).otherwise(F.col("updated_at")))
    touched = touched.withColumn("semantic_model", F.when(F.col("base_id") == base_id, F.lit(None)).otherwise(F.col("semantic_model")))
    catalog.publish({"bases": touched, "base_chunks": upsert(made, catalog.read("base_chunks", CHUNKS), "chunk_id")})


def set_vectors(catalog: Catalog, base_id: str, vectors: DataFrame, model: str) -> None:
    """Gives all chunks of a base the vectors (chunk_id, embedding) of a model."""
    chunks = catalog.read("base_chunks", CHUNKS)
    own = chunks.filter(F.col("base_id") == base_id).drop("embedding").join(vectors.select("chunk_id", "embedding"), "chunk_id", "left")
    rest = chunks.filter(F.col("base_id") != base_id)
    bases = catalog.read("bases", BASES)
    named = bases.withColumn("semantic_model", F.when(F.col("base_id") == base_id, F.lit(model)).otherwise(F.col("semantic_model")))
    catalog.publish({"bases": named, "base_chunks": rest.unionByName(own.select(*rest.columns))})
