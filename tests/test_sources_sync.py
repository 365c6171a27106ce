"""Reading files, records, incremental sync, streaming."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspan.operators import records as R
from quillspan.plans import sync
from quillspan.sources import files
from quillspan.sources.embedder import Embedder, embedded


def write(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())


def test_listing_rules(spark, tmp_path):
    for name in ("notas/tema.MD", "notas/ignorar.jpg", ".privado/x.txt", ".venv/y.txt", "~$temporal.docx"):
        write(tmp_path / name, "x")
    assert [r.relative_path for r in files.list_files(spark, str(tmp_path)).collect()] == ["notas/tema.MD"]
    with pytest.raises(ValueError):
        files.refuse_large(files.list_files(spark, str(tmp_path)), 0)


def test_decoding_and_lines():
    text = files.decode("Psicología comunitaria\n\nTerritorio".encode("cp1252"))
    assert [(s[0], s[1]) for s in files.plain_segments(text)] == [("Psicología comunitaria", "linea 1"), ("Territorio", "linea 3")]


def test_docx(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('uno')}{p('')}{p('tres')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('')}</w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('')}</w:tc><w:tc>{p(' ')}</w:tc></w:tr></w:tbl>{p('fin')}</w:body></w:document>"
    at = tmp_path / "x.docx"
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("word/document.xml", xml)
    assert [(s[0], s[1]) for s in files.docx_segments(at.read_bytes())] == [("uno", "parrafo 1"), ("tres", "parrafo 3"), ("fin", "parrafo 4"), ("a | b", "tabla 1")]
    assert [s[0] for s in files.docx_blocks(at.read_bytes())] == ["uno", "tres", "a", "b", "fin"]


def test_tables_and_json():
    got = files.delimited_segments("tema,\nuno,https://x.y\n\n,\ndos,\n", ",")
    assert [(s[1], s[0]) for s in got] == [("fila 2", "tema: uno\ncolumna: https://x.y"), ("fila 3", "tema: dos")]
    assert got[0][2] == {"tema": "uno", "columna": "https://x.y"}
    assert [s[0] for s in files.delimited_segments("a,a\n1,2,3,4\n", ",")] == ["a: 1\na_1: 2\n__parsed_extra: 3; 4"]
    assert files.json_segments('{"n": 1, "items": [{"a": {"b": 1.0}}, {}]}')[0][0] == "a.b: 1"
    assert files.json_segments("3")[0][:2] == ("3", "valor JSON")
    with pytest.raises(ValueError, match="line 2"):
        files.json_lines_segments('{"a":1}\n\nnope')


def test_flatten_prints_as_json_tools_do():
    value = {"b": [1, None, True], "2": "x", "1": 2.0, "c": [{"d": []}], "e": None}
    assert R.flatten(value) == [("1", "2"), ("2", "x"), ("b", "1; null; true"), ("c[0].d", "")]
    assert R.flatten([[1], 2]) == [("item[0]", "1"), ("item[1]", "2")]


def test_all_columns_of_orders_are_flattened(spark, tmp_path):
    from datetime import datetime

    from quillspan import catalogue

    rows = [(1, 7, "O", 75462.67, datetime(1998, 2, 6), "5-LOW"), (2, None, " ", 1200.0, datetime(2001, 7, 27, 5, 4, 3), "2-HIGH"), (3, 8, "F", 12345678.5, None, ""), (4, None, None, None, None, None)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: (r.text, r.entries) for r in catalogue.QUERIES["flatten_records_orders"](spark, str(tmp_path)).collect()}
    assert got == {
        1: ("o_orderkey: 1\no_custkey: 7\no_orderstatus: O\no_totalprice: 75462.67\no_orderdate: 1998-02-06 00:00:00\no_orderpriority: 5-LOW", 6),
        2: ("o_orderkey: 2\no_totalprice: 1200\no_orderdate: 2001-07-27 05:04:03\no_orderpriority: 2-HIGH", 4),
        3: ("o_orderkey: 3\no_custkey: 8\no_orderstatus: F\no_totalprice: 12345678.5", 4),
        4: ("o_orderkey: 4", 1),
    }


def test_record_segments(spark):
    df = spark.createDataFrame([(0, "a", "https://u"), (1, None, " "), (2, "b", None)], "i int, tema string, enlace string")
    got = R.records_to_segments(df.withColumn("e", R.entries_of(["tema", "enlace"])), "e", "i").orderBy("i").collect()
    assert [(r.location, r.url) for r in got] == [("fila 2", "https://u"), ("fila 4", None)]
    assert got[0].text == "tema: a\nenlace: https://u"


def test_sync_twice_then_change_and_remove(spark, tmp_path):
    root, index = tmp_path / "docs", f"file://{tmp_path}/index"
    write(root / "a.txt", "uno\n\ndos")
    write(root / "b.md", "tres")
    write(root / "vacio.txt", "")
    write(root / "roto.docx", b"no zip")
    first = sync.sync_index(spark, str(root), index)
    assert (first["scanned"], first["processed"], first["errors"], first["chunks_added"]) == (4, 4, 1, 2)
    second = sync.sync_index(spark, str(root), index)
    assert (second["skipped"], second["chunks_added"]) == (3, 0)
    write(root / "a.txt", "uno cambiado")
    (root / "b.md").unlink()
    third = sync.sync_index(spark, str(root), index)
    assert (third["removed"], third["chunks_added"]) == (1, 1)
    catalog = sync.Catalog(spark, index)
    assert [r.text for r in catalog.read("chunks", sync.CHUNKS).collect()] == ["uno cambiado"]
    states = {r.source_name: (r.status, r.error is not None) for r in catalog.read("manifest", sync.MANIFEST).collect()}
    assert states["vacio.txt"] == (sync.STATUS_EMPTY, False) and states["roto.docx"][1]
    catalog.lock()
    with pytest.raises(FileExistsError):
        sync.sync_index(spark, str(root), index)


def test_a_lock_that_was_left_behind(spark, tmp_path):
    import subprocess

    write(tmp_path / "docs/a.txt", "uno")
    index = f"file://{tmp_path}/index"
    catalog = sync.Catalog(spark, index)
    catalog.lock()
    at = tmp_path / "index/lock"
    held = json.loads(at.read_text())
    ended = subprocess.Popen(["true"])
    ended.wait()
    for left in (held | {"pid": ended.pid}, held | {"since": held["since"] - 2 * sync.STALE_AFTER}, held | {"host": "elsewhere", "since": 0}):
        at.write_text(json.dumps(left))
        sync.sync_index(spark, str(tmp_path / "docs"), index)
        assert not at.exists()
    for now in (held, held | {"host": "elsewhere", "pid": ended.pid}):
        at.write_text(json.dumps(now))
        with pytest.raises(FileExistsError):
            sync.sync_index(spark, str(tmp_path / "docs"), index)
    sync.Catalog(spark, index).unlock()
    assert at.exists()  # another's lock stays


def test_old_versions_go_and_the_cache_stays(spark, tmp_path):
    write(tmp_path / "docs/a.txt", "uno")
    index = f"file://{tmp_path}/index"
    mine = spark.range(3).cache()
    mine.count()
    for _ in range(3):
        sync.sync_index(spark, str(tmp_path / "docs"), index)
    assert mine.storageLevel.useMemory and spark._jsparkSession.sharedState().cacheManager().lookupCachedData(mine._jdf).isDefined()
    mine.unpersist()
    catalog = sync.Catalog(spark, index)
    assert catalog.vacuum() == 4 and catalog.vacuum() == 0
    assert [r.text for r in catalog.read("chunks", sync.CHUNKS).collect()] == ["uno"]


def test_a_large_file_refuses_the_batch(spark, tmp_path, monkeypatch):
    write(tmp_path / "a.txt", "uno")
    listing = files.list_files(spark, str(tmp_path))
    assert files.read_segments(listing, "web").first().text == "uno"
    with pytest.raises(ValueError, match="a.txt"):
        files.read_segments(listing.withColumn("size", F.lit(files.LARGEST_FILE + 1)), "web")


def test_pages_of_a_pdf(monkeypatch):
    def broken(raw):
        raise ValueError("damaged")

    monkeypatch.setattr(files, "_pages_by_fitz", broken)
    monkeypatch.setattr(files, "_pages_by_pypdf", lambda raw: ["una página  con\ntexto propio " * 3, "12", ""])
    assert [s[1] for s in files.pdf_page_segments(b"")] == ["página 1"] and [s[1] for s in files.pdf_segments(b"")] == ["pagina 1", "pagina 2"]
    monkeypatch.setattr(files, "_pages_by_pypdf", lambda raw: ["12"])
    with pytest.raises(ValueError, match="recognition"):
        files.pdf_page_segments(b"")


def test_mirrored_files(spark, tmp_path):
    for name in ("a.txt", "b/c.md"):
        write(tmp_path / "from" / name, name)
    write(tmp_path / "to/old.txt", "stays")
    listing = files.list_files(spark, str(tmp_path / "from"))
    for _ in range(2):
        assert [r.error for r in files.mirrored(listing, str(tmp_path / "to")).collect()] == [None, None]
    assert sorted(str(x.relative_to(tmp_path / "to")) for x in (tmp_path / "to").rglob("*.*")) == ["a.txt", "b/c.md", "old.txt"]
    (tmp_path / "from/a.txt").unlink()
    assert sorted(r.error is None for r in files.mirrored(listing, str(tmp_path / "to")).collect()) == [False, True]


def test_cancelled_work_changes_nothing(spark, tmp_path):
    import threading
    import time

    from quillspan.plans.cancel import cancellable

    catalog = sync.Catalog(spark, f"file://{tmp_path}/c")
    catalog.publish({"t": spark.range(1)})

    def slow(batches):
        import time

        for b in batches:
            time.sleep(20)
            yield b

    with cancellable(spark, "slow") as work:
        threading.Thread(target=lambda: (time.sleep(3), work.cancel())).start()
        began = time.time()
        with pytest.raises(Exception, match="(?i)cancel"):
            catalog.publish({"t": spark.range(5).mapInPandas(slow, "id bigint")})
        assert time.time() - began < 15 and work.cancelled
    assert catalog.read("t", "id bigint").count() == 1


def test_watched_folder(spark, tmp_path):
    from quillspan.streaming.ingest import watch_folder

    root = tmp_path / "in"
    write(root / "a.txt", "hola mundo")
    watch_folder(spark, str(root), f"file://{tmp_path}/index", str(tmp_path / "cp")).awaitTermination(120)
    assert [r.text for r in sync.Catalog(spark, f"file://{tmp_path}/index").read("chunks", sync.CHUNKS).collect()] == ["hola mundo"]


def test_base_round_trip(spark):
    schema = "chunk_id string, source_id string, text string"
    df = spark.createDataFrame([("1", "s", "t", "b1", [1.0])], schema + ", base_id string, embedding array<float>")
    lines = sync.export_base(df, "b1", "mi base")
    assert "embedding" not in json.loads(lines.first().value)["chunk"]
    back = sync.import_base(lines, schema, "b2").first()
    assert (back.text, back.base_id, back.embedding) == ("t", "b2", None) and back.chunk_id != "1"
    with pytest.raises(Exception, match="not an exported base"):
        sync.import_base(spark.createDataFrame([("{}",)], "value string"), schema, "b").collect()


def test_embedder(spark):
    # defined here, so that it travels to the workers by value
    class Lengths(Embedder):
        def prepare(self):
            self.ready = True

        def embed(self, texts):
            import numpy as np

            return np.array([[len(t), 0.0] for t in texts])

    df = spark.createDataFrame([("abc",), (None,)], "t string")
    got = [r.embedding for r in embedded(df, "t", Lengths()).collect()]
    assert got[0] == [1.0, 0.0] and got[1] is None


def test_ocr_merge(spark):
    pages = spark.createDataFrame([("s", 1, "texto largo " * 8), ("s", 2, "x"), ("s", 3, None)], "source_id string, page_number int, text string")
    ocr = spark.createDataFrame([("s", 2, "leído  por\nreconocimiento", 90.0)], "source_id string, page_number int, text string, confidence double")
    got = files.merged_ocr(pages, ocr).orderBy("page_number").collect()
    assert [r.location for r in got] == ["página 1", "página 2 · OCR"]
    assert got[1].metadata == {"extracción": "OCR local"}


def test_render_scale(spark):
    df = spark.createDataFrame([(1000.0, 1000.0), (5000.0, 5000.0)], "w double, h double")
    assert [r[0] for r in df.select(files.render_scale(F.col("w"), F.col("h"))).collect()] == [2.0, 1.2]
