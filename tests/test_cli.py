"""The command line, end to end on a small folder."""

from quillspan import cli

MODULE = '''
import numpy as np
from quillspan.sources.embedder import Embedder

class Letters(Embedder):
    """Counts of letters, as a stand-in for a model."""

    def prepare(self):
        self.ready = True

    def embed(self, texts):
        return np.array([[t.lower().count(c) + 0.01 for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts])
'''


def test_index_search_and_answer(spark, tmp_path, capsys, monkeypatch):
    folder = tmp_path / "docs"
    folder.mkdir()
    (folder / "barrio.txt").write_text("El territorio es un espacio social que los vecinos construyen en la historia del barrio y sus instituciones cercanas.")
    index = f"file://{tmp_path}/index"
    run = lambda *args: (cli.main(["--index", index, *args]), capsys.readouterr().out)
    assert "'processed': 1" in run("index", "--root", str(folder))[1]
    code, said = run("search", "vecinos del barrio")
    assert code == 0 and "barrio.txt" in said and "La búsqueda se resolvió por palabras" in said
    assert "El territorio es un espacio social" in run("answer", "vecinos del barrio")[1]
    assert "No apareció evidencia suficiente" in run("answer", "zzz")[1]
    assert run("warmup")[0] == 1
    (tmp_path / "letters_model.py").write_text(MODULE)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "letters_model.py"))
    with_model = ("--embedder", "letters_model:Letters")
    assert "'dimensions': 26" in run(*with_model, "warmup")[1]
    code, said = run(*with_model, "answer", "territorio")
    assert code == 0 and said.startswith("**Concepto: territorio**") and "[1] barrio.txt" in said
