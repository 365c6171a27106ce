"""

BENCH_SF_DIR names the tables, BENCH_CPUS the threads.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

HERE = os.path.dirname(os.path.abspath(__file__))


def main() -> int:
    sys.path.insert(0, HERE)
    os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    folder, cpus, work = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), tempfile.mkdtemp(prefix="quillspan-measures-")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from quillspan import catalogue as C
    from quillspan.functions.text import normalize_web
    from quillspan.functions.tokens import tokens_web
    from quillspan.operators import chunking, retrieval
    from quillspan.plans import sync

    conf = {"spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.sql.files.maxPartitionBytes": "2m", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{work}/shared"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    out: dict[str, float] = {}

    def timed(df) -> float:
        began = time.time()
        df.write.format("noop").mode("overwrite").save()
        return time.time() - began

    try:
        documents = C.table(spark, folder, "documents")
        chunks = C.once(spark, folder, "source_chunks", "chunk_id", "source_id", "source_name", "relative_path", "location", "text", "metadata", "embedding")
        queries = C.table(spark, folder, "queries")
        made = chunking.chunks_web(chunking.text_segments(documents, "doc_id", "text", "web")).withColumn("normal", normalize_web("text")).withColumn("tokens", tokens_web("", F.col("normal")))
        n = made.count()
        out["chunks"], out["chunks_per_s"] = n, round(n / timed(made), 1)
        one = queries.filter("query_id = 0")
        for mode in retrieval.MODES:
            timed(retrieval.search_web(one, chunks, mode))
            out[f"one_{mode}_s"] = round(timed(retrieval.search_web(one, chunks, mode)), 2)
        timed(retrieval.search_desktop(one, chunks))
        out["one_desktop_s"] = round(timed(retrieval.search_desktop(one, chunks)), 2)
        out["queries"], out["queries_per_s"] = queries.count(), round(queries.count() / timed(retrieval.search_web(queries, chunks, "hybrid")), 1)
        # known items: the first words of every chunk whose number in its source is divisible by 50
        own = chunks.filter(F.length("text") > 60).withColumn("t", F.substring_index(F.trim("text"), " ", 8))
        asked = own.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(50)) == 0).select(F.xxhash64("chunk_id").alias("query_id"), F.col("t").alias("query_text"), F.lit(None).cast("array<float>").alias("embedding"), F.col("text").alias("wanted"))
        hits = retrieval.search_web(asked.drop("wanted"), chunks, "literal", evidence=False)
        found = hits.join(asked.select("query_id", "wanted"), "query_id").filter(F.col("text") == F.col("wanted")).select("query_id").distinct().count()
        out["known_items"], out["known_item_recall_at_12"] = asked.count(), round(found / max(1, asked.count()), 4)
        # files: a folder with every document, then one in a hundred changed
        root = f"{work}/docs"
        os.makedirs(root)
        texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").filter("text is not null").limit(2_000).collect()]
        for i, t in texts:
            with open(f"{root}/{i}.txt", "w") as f:
                f.write(t)
        began = time.time()
        sync.sync_index(spark, root, f"file://{work}/index")
        out["files"], out["first_sync_s"] = len(texts), round(time.time() - began, 2)
        for i, t in texts[::100]:
            with open(f"{root}/{i}.txt", "w") as f:
                f.write(t + "\n\nCambio.")
        began = time.time()
        out["changed"] = sync.sync_index(spark, root, f"file://{work}/index")["processed"]
        out["sync_of_changes_s"] = round(time.time() - began, 2)
    finally:
        spark.stop()
        shutil.rmtree(work, ignore_errors=True)
    print(json.dumps(out | {"sf": folder, "cpus": int(cpus)}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
