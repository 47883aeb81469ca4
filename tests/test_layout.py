import re
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_training_data_operators():
    for p in (ROOT / "lodestone").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"^\s*(?:from|import)\s+lodestone\.llm|corpus_pipeline", p.read_text(), re.M), p


def test_no_local_checkpoints_or_cross_joins():
    for p in [*(ROOT / "lodestone").rglob("*.py"), *ROOT.glob("*.py")]:
        assert not re.search(r"localCheckpoint|crossJoin", p.read_text()), p


def test_scratch_follows_the_session(spark):
    from lodestone.tables import scratch, written

    assert scratch(spark) != scratch(spark)

    class Session:
        class conf:
            get = staticmethod(lambda key, default=None: "file:///tmp/some-folder/" if key == "spark.checkpoint.dir" else default)

    assert scratch(Session).startswith("file:///tmp/some-folder/lodestone-")
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert written(df).collect() == df.collect() and written(df.limit(0)).schema == df.schema


def test_the_entry_does_without_the_training_data_operators(monkeypatch):
    """Without the folder its queries are left out; an error within it is no reason to leave them out."""
    import importlib

    import __spark_entry__

    every = set(__spark_entry__.queries())
    real = importlib.import_module

    def missing(name, error):
        def load(x):
            if x == name:
                raise error
            return real(x)

        return load

    for name in ("lodestone.llm.registry", "corpus_pipeline"):
        monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing(name, ModuleNotFoundError(name, name=name)))
        assert {q for q in every if not re.match(r"op[0-9]+_|pipeline$", q)} <= set(__spark_entry__.queries()) <= every
    monkeypatch.setattr(__spark_entry__.importlib, "import_module", missing("lodestone.llm.registry", ModuleNotFoundError("no library", name="somelib")))
    with pytest.raises(ModuleNotFoundError):
        __spark_entry__.queries()
