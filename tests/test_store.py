import json

import pytest

from spanloom.sources import store
from spanloom.sources import writers as O
from spanloom.streaming import summaries as U


def texts(spark, root, version=None):
    return {r.doc_id: r.text for r in store.texts(spark, root, version).collect()}


def test_an_ingest_that_fails_between_its_steps_is_run_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "corpus")
    frame = lambda rows: spark.createDataFrame(rows, "doc_id string, text string")
    docs = frame([("1", "same"), ("2", "same"), ("3", "other"), ("4", None)])
    with pytest.raises(store.StoreError):
        store.manifest(spark, root)
    tried = store.ingest(docs, root, dry_run=True)
    assert (tried["version"], tried["documents"], tried["blobs_written"], tried["deduped"]) == (1, 4, 3, 1)
    assert not (tmp_path / "corpus").exists() and store.runs(spark, root).count() == 0

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(O, "publish_manifest", lost)
        with pytest.raises(RuntimeError, match="lost"):
            store.ingest(docs, root, run_id="a")
    assert store.versions(spark, root) == [] and store.next_version(spark, root) == 1
    again = store.ingest(docs, root, run_id="b")
    assert (again["version"], again["blobs_written"]) == (1, 0)
    first = {"1": "same", "2": "same", "3": "other", "4": ""}
    assert texts(spark, root) == first
    (tmp_path / "corpus" / "manifests" / "version=2").mkdir()  # a version that never got its marker
    more = store.ingest(frame([("5", "new"), ("6", "other")]), root, run_id="c")
    assert (more["version"], more["blobs_written"], more["deduped"]) == (2, 1, 1)
    assert texts(spark, root) == {"5": "new", "6": "other"} and texts(spark, root, 1) == first
    assert {(r.run_id, r.status) for r in store.runs(spark, root).collect()} == {("a", "failed"), ("b", "completed"), ("c", "completed")}


def test_summaries_are_fetched_when_the_root_changes(spark, tmp_path):
    inbox, table, asked = tmp_path / "in", str(tmp_path / "table"), []
    inbox.mkdir()

    def fetch(nodes):
        names = sorted(r.node for r in nodes.collect())
        asked.append(names)
        rows = [(n, [1.0], {f"t{len(asked)}": 2.0}, ["d"]) for n in names if n != "silent"]
        return spark.createDataFrame(rows, "node string, centroid array<double>, terms map<string,double>, domains array<string>")

    def announce(name, *rows):
        (inbox / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("node", "root_hash", "seq"), r, strict=True))) for r in rows))
        stream = U.keep_summaries(U.root_stream(spark, str(inbox)), fetch, table, str(tmp_path / "mark"))
        stream.trigger(availableNow=True).start().awaitTermination()
        return {r.node: (r.root_hash, *r.terms) for r in U.kept_summaries(spark, table).collect()}

    assert announce("1", ("a", "old", 1), ("a", "r1", 2), ("b", "r1", 1), ("silent", "r1", 1), (None, "r", 1)) == {"a": ("r1", "t1"), "b": ("r1", "t1")}
    assert announce("2", ("a", "r1", 3), ("b", "r0", 0)) == {"a": ("r1", "t1"), "b": ("r1", "t1")}  # unchanged, late
    assert asked == [["a", "b", "silent"]]
    assert announce("3", ("a", "r2", 4), ("silent", "r1", 2)) == {"a": ("r2", "t2"), "b": ("r1", "t1")}
    assert asked[1:] == [["a", "silent"]]
