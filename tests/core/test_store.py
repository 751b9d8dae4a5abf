"""Registries as they are written by hand, and tables that outlive a crash."""

import datetime as dt

from quernstone.sources import store

SOURCE = "id string, agenda_urls array<string>, tier int, enabled boolean"


def test_registries_of_any_layout(spark, tmp_path):
    folder = tmp_path / "registry"
    folder.mkdir()
    (folder / "a.json").write_text('[\n  {\n    "id": "a",\n    "agendaUrls": ["https://a.nl", "https://b.nl"],\n    "Tier": 2,\n    "other": {"x": 1}\n  },\n  {"ID": "b", "enabled": true, "tier": "no number"}\n]\n')
    (folder / "b.json").write_text('{"id": "c", "agenda_urls": []}\n{"id": "d"\n\n[{"id": "e"}, {"id": "f", "enabled": false}]\nno json\n')
    (folder / "c.json").write_text('{\n  "id": "g"\n}')
    rows, broken = store.read_json(spark, str(folder), SOURCE)
    assert {r["id"]: tuple(r) for r in rows.collect()} == {
        "a": ("a", ["https://a.nl", "https://b.nl"], 2, None), "b": ("b", None, None, True), "c": ("c", [], None, None), "e": ("e", None, None, None), "f": ("f", None, None, False), "g": ("g", None, None, None),
    }
    assert sorted(r["object"] for r in broken.collect()) == ["no json", '{"id": "d"']
    assert store.read_or_empty(spark, str(folder), SOURCE, "json").count() == 6


def test_what_is_no_table_is_empty(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0.parquet").write_bytes(b"no parquet at all, only words")
    assert store.read_or_empty(spark, str(tmp_path / "x"), "a int").collect() == []
    assert store.read_or_empty(spark, str(tmp_path / "none"), "a int", "json").collect() == []
    assert store.read_last(spark, str(tmp_path / "none"), "a int").collect() == []


def test_a_version_that_is_not_committed_is_not_seen(spark, tmp_path):
    path, of = str(tmp_path / "t"), lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    store.save(of(1, 2), path)
    store.write_version(of(3), path)  # and the run ends here
    assert sorted(r["a"] for r in store.read_last(spark, path, "a int").collect()) == [1, 2]
    for k in range(6):
        store.save(of(10 + k), path)
        assert [r["a"] for r in store.read_last(spark, path, "a int").collect()] == [10 + k]
    assert len(list((tmp_path / "t" / "versions").iterdir())) <= store.KEPT_VERSIONS + 3


def test_a_batch_counts_once(spark, tmp_path):
    path, now = str(tmp_path / "h"), dt.datetime(2026, 6, 12)
    sink = store.health_sink(path, lambda: now)
    of = lambda *rows: spark.createDataFrame(rows, store.HEALTH)
    sink(of(("a", 2, now, None)), 0)
    sink(of(("b", 1, now, None)), 1)
    sink(of(("a", 9, now, None)), 0)  # again after a crash
    assert sorted((r["host"], r["failures"]) for r in store.read_last(spark, path, store.HEALTH).collect()) == [("a", 2), ("b", 1)]
