"""A run that dies between any two writes ends, after the next run, where an undisturbed one does."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import regenerate
from tessera.operators.store import VersionedTable


class Died(Exception):
    pass


def stores_at(spark, path):
    stores = regenerate.Stores(*[VersionedTable(spark, f"{path}/{n}") for n in ("texts", "metadata", "log")])
    stores.texts.write(spark.createDataFrame([(i, "old") for i in range(6)], "doc_id long, text string"))
    stores.metadata.write(spark.createDataFrame([(i, ["was"], i != 5, i != 5, None) for i in range(6)], "doc_id long, file_paths array<string>, needs_sync boolean, is_updating boolean, error string"))
    return stores


def state(stores):
    rows = stores.metadata.read().join(stores.texts.read(), "doc_id").collect()
    return sorted((r.doc_id, r.text, tuple(r.file_paths), r.needs_sync, r.is_updating, r.error) for r in rows)


def run(spark, stores):
    prompts = spark.createDataFrame([(0, "zero"), (1, "one"), (2, " "), (3, "three"), (4, "four")], "doc_id long, prompt string")
    hits = [(i, "own", True, float(k), f"c{i}.{k}", f"f{k % 2}") for i in (0, 1, 2) for k in range(25)] + [(1, "other", False, 9.0, "o", " ")] + [(3, "other", False, 1.0, "o", "f")] + [(4, "own", True, 1.0, "x", None)]
    rows = spark.createDataFrame(hits, "doc_id long, collection string, own boolean, score double, chunk string, path string")
    make = lambda p, c: F.when(p == "four", "").otherwise(F.concat(p, F.lit(":"), F.array_join(c, " ")))
    regenerate.regenerate(stores, prompts, rows, make)


def test_undisturbed(spark, tmp_path):
    stores = stores_at(spark, tmp_path)
    run(spark, stores)
    got = {r[0]: r[1:] for r in state(stores)}
    twenty = " ".join(f"c0.{k}" for k in range(24, 4, -1))
    assert got[0] == (f"zero:{twenty}", ("f0", "f1"), False, False, None) and got[1][0].endswith(" o")
    assert {i: got[i] for i in (2, 3, 4)} == {2: ("old", ("was",), True, False, "no stored prompt"), 3: ("old", ("was",), True, False, "no chunks"), 4: ("old", ("was",), True, False, "empty documentation")}
    assert got[5] == ("old", ("was",), False, False, None) and regenerate.open_intents(stores) is None and not regenerate.finish(stores)


@pytest.mark.parametrize("dies_at", range(4))
def test_dies_before_a_write(spark, tmp_path, monkeypatch, dies_at):
    """Before the intents, the texts, the metadata or the end of the log."""
    calm, stores = stores_at(spark, tmp_path / "calm"), stores_at(spark, tmp_path / "harsh")
    run(spark, calm)
    left, write = [dies_at], VersionedTable.write

    def failing(self, *args, **options):
        if left[0] == 0:
            raise Died
        left[0] -= 1
        return write(self, *args, **options)

    monkeypatch.setattr(VersionedTable, "write", failing)
    with pytest.raises(Died):
        run(spark, stores)
    monkeypatch.setattr(VersionedTable, "write", write)
    if dies_at:
        with pytest.raises(RuntimeError):
            regenerate.begin(stores, stores.log.read())
    run(spark, stores)
    assert state(stores) == state(calm)
