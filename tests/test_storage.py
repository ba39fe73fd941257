import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import frames as M
from spanloom.operators import ingest as G
from spanloom.operators import labels as L
from spanloom.session import durable
from spanloom.sources import readers as S
from spanloom.sources import writers as O
from spanloom.streaming import labels as SL
from spanloom.streaming import traces as ST


def test_yaml_corpus_and_gold(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("documents:\n- {id: d1, outlet: o, chunks: [' One. ', Two]}\n- {id: d2, body: Three}\nedges:\n- {src: 'd1:0', dst: 'd2:0', type: contradicts}\n")
    docs, edges = S.yaml_corpus(spark, path)
    rows = G.chunk_rows(docs).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text) for r in rows] == [("d1:0", "One."), ("d1:1", "Two"), ("d2:0", "Three")]
    assert S.gold_edges(edges, F.lit("climate")).first().relation_class == "story"
    path.write_text("documents:\n- {id: d1}\n")
    with pytest.raises(S.SourceError):
        S.yaml_corpus(spark, path)
    path.write_text("documents:\n- {id: d1, body: x, eval_layer: odd}\n")
    with pytest.raises(Exception, match="bad eval_layer"):
        S.yaml_corpus(spark, path)[0].collect()


def test_node_json_orders_positions_as_numbers(spark, tmp_path):
    doc = {"doc_id": "d", "global_id": "g", "source": "T", "url": "u", "node": "n1", "metadata": {"category": "c", "domain": "x"},
           "chunks": [{"chunk_id": f"d_c{i:03d}", "position": str(i), "text": f"t{i}"} for i in (10, 2, 0)]}
    path = tmp_path / "n.json"
    path.write_text(json.dumps({"node_id": "n1", "documents": [doc]}))
    docs, chunks = S.node_corpus(spark, str(path))
    assert [r.text for r in chunks.orderBy("chunk_index").collect()] == ["t0", "t2", "t10"]
    assert docs.first().eval_tag == "c"


def test_local_folder_fallbacks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"body": " ", "text": "hello", "authors": ["x"], "source_uri": "u"}\n{"content": ""}\n')
    (tmp_path / "note.md").write_text(" body \n")
    rows = {r.text: r for r in S.local_documents(spark, tmp_path).collect()}
    assert set(rows) == {"hello", "body"} and rows["hello"].source == "u" and rows["hello"].authors == ["x"] and rows["body"].title == "note"
    with pytest.raises(FileNotFoundError):
        S.local_documents(spark, tmp_path / "none")


def test_query_set_and_samples_are_checked(spark, tmp_path):
    path = tmp_path / "q.yaml"
    path.write_text("queries:\n- {id: q1, query: x, eval_layer: realism, regression: false}\n- {id: q2, query: y, eval_layer: realism}\n")
    assert [r.id for r in S.regression_queries(S.query_set(spark, path)).collect()] == ["q2"]
    path.write_text("queries:\n- {id: q1, query: x, eval_layer: realism}\n- {id: q1, query: y, eval_layer: realism}\n")
    with pytest.raises(S.SourceError, match="duplicate"):
        S.query_set(spark, path)
    sample = {"cos": 0.4, "p_contra": 0.2, "relation": "unrelated", "same_story": False}
    path.write_text(json.dumps({"manifest": {"n_samples": 1, "embed_model": "m"}, "samples": [sample]}))
    assert S.calibration_samples(spark, path, {"embed_model": "m"}).first().cos == 0.4
    with pytest.raises(S.SourceError):
        S.calibration_samples(spark, path, {"embed_model": "other"})


def test_node_config(tmp_path):
    path = tmp_path / "node.yaml"
    path.write_text("node_id: a\npeers:\n- {node_id: b, url: u}\ntrust_weights:\n  b: {health: 0.2}\ntrust_threshold: 0.5\n")
    config = S.node_config(path)
    assert config["peers"][0]["node"] == "b" and config["weights"] == [{"node": "b", "domain": "health", "weight": 0.2}]


def test_blobs_are_stored_once_and_read_back_by_version(spark, tmp_path):
    docs = spark.createDataFrame([("1", "same"), ("2", "same"), ("3", "other")], "doc_id string, text string")
    store, manifests = str(tmp_path / "blobs"), str(tmp_path / "manifests")
    none = spark.createDataFrame([], "content_hash string")
    O.append_blobs(G.new_blobs(docs, none), store)
    stored = spark.read.parquet(store)
    assert stored.count() == 2 and G.new_blobs(docs, stored).count() == 0
    hashed = docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))
    for version, rows in ((1, hashed.where("doc_id = '1'")), (2, hashed)):
        O.publish_manifest(G.manifest_entries(rows, F.lit(version)).drop("version"), manifests, version)
    table = spark.read.parquet(manifests)
    assert {r.doc_id: r.text for r in G.texts_of_manifest(G.latest_manifest(table), stored).collect()} == {"1": "same", "2": "same", "3": "other"}


def test_bucket_replacement_leaves_other_partitions(spark, tmp_path):
    path = str(tmp_path / "anchors")
    rows = [("p", f"c{i}", "h") for i in range(40)]
    frame = lambda r: spark.createDataFrame(r, "peer string, chunk_id string, content_hash string")
    O.replace_buckets(frame(rows), path)
    O.replace_buckets(frame([("p", "c0", "new")]), path)
    back = {r.chunk_id: r.content_hash for r in spark.read.parquet(path).collect()}
    assert back["c0"] == "new" and len(back) > 30


def test_upsert_keeps_first_id_and_last_fields(spark):
    schema = "doc_id string, content_hash string, outlet string, seq bigint"
    old = spark.createDataFrame([("a", "h1", "x", 1)], schema)
    new = spark.createDataFrame([("b", "h1", "y", 2), ("c", "h2", "z", 3)], schema)
    got = {r.content_hash: (r.doc_id, r.outlet) for r in G.upserted_documents(old, new).collect()}
    assert got == {"h1": ("a", "y"), "h2": ("c", "z")}
    assert {r.outlet for r in G.upserted(old, new, ["content_hash"]).collect()} == {"y", "z"}


def label(seq, ts, src, dst, relation):
    return json.dumps({"seq": seq, "ts": ts, "src_chunk_id": src, "dst_chunk_id": dst, "relation": relation})


def test_streamed_labels_fold_like_the_batch(spark, tmp_path):
    inbox, table, mark = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "mark")
    inbox.mkdir()
    (inbox / "1.json").write_text(label(1, "t2", "a", "b", "contradicts") + "\n" + label(2, "t1", "c", "d", "unrelated") + "\n")
    SL.fold_to_table(SL.label_stream(spark, str(inbox), 1), table, mark).awaitTermination()
    (inbox / "2.json").write_text(label(3, "t1", "b", "a", "unrelated") + "\n" + label(4, "t3", "d", "c", "corroborates") + "\n")
    SL.fold_to_table(SL.label_stream(spark, str(inbox), 1), table, mark).awaitTermination()
    batch = {(r.src, r.dst, r.relation) for r in L.folded(S.label_log(spark, str(inbox))).collect()}
    assert {(r.src, r.dst, r.relation) for r in SL.current_labels(spark, table).collect()} == batch == {("a", "b", "contradicts"), ("d", "c", "corroborates")}
    SL.compact(spark, table, str(tmp_path / "small"))
    assert SL.current_labels(spark, str(tmp_path / "small")).count() == 2
    live = SL.folding(SL.label_stream(spark, str(inbox))).writeStream.outputMode("complete").format("memory").queryName("live_labels").start()
    live.processAllAvailable()
    live.stop()
    assert {(r.src, r.dst, r.relation) for r in spark.table("live_labels").collect()} == batch


def test_malformed_label_fails_the_read(spark, tmp_path):
    (tmp_path / "l.json").write_text("{broken\n")
    with pytest.raises(Exception):
        S.label_log(spark, str(tmp_path)).collect()
    (tmp_path / "l.json").write_text(label(1, "t", "a", "b", "likes") + "\n")
    with pytest.raises(Exception, match="bad relation"):
        S.label_log(spark, str(tmp_path)).collect()


def test_trace_stream_and_sync_cycle(spark, tmp_path):
    inbox = tmp_path / "tr"
    inbox.mkdir()
    events = [("r1", 1, "retrieval_settled"), ("r1", 2, "claim_closed"), ("r1", 3, "final"), ("r2", 1, "final"), ("r2", 2, "claim_closed")]
    (inbox / "1.json").write_text("\n".join(json.dumps({"request_id": r, "seq": s, "event": e}) for r, s, e in events))
    stream = ST.request_summaries(ST.trace_stream(spark, str(inbox)))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("live_traces").start()
    q.processAllAvailable()
    q.stop()
    assert {r.request_id: r.closed_last for r in spark.table("live_traces").collect()} == {"r1": True, "r2": False}
    frame = lambda rows: spark.createDataFrame(rows, "chunk_id string, content_hash string, outlet string, title string")
    seen = []
    ticks = ST.trace_stream(spark, str(inbox))
    run = ST.sync_anchors(ticks, lambda: frame([("a", "1", "o", "t")]), lambda: frame([("a", "2", "o", "t")]),
                          lambda rows, buckets: seen.extend(rows.collect()), str(tmp_path / "mark")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.content_hash for r in seen] == ["2"]


def test_validator_names_each_fault(spark):
    schema = "doc_id string, global_id string, source string, url string, node string, metadata map<string,string>, node_id string"
    meta = {f: "x" for f in G.METADATA_FIELDS}
    docs = spark.createDataFrame([("d1", "gid_" + "0" * 16, "s", "u", "n", meta, "n"), ("d2", "bad", None, "u", "m", {}, "n")], schema)
    chunks = spark.createDataFrame([("d1", "d1_c000", 0, "t"), ("d1", "d1_c002", 2, " ")], "doc_id string, chunk_id string, position int, text string")
    got = {(r.doc_id, r.fault) for r in G.corpus_faults(docs, chunks).collect()}
    assert {("d1", "bad positions"), ("d1", "empty text"), ("d2", "missing field source"), ("d2", "bad global_id"), ("d2", "node differs from node_id"), ("d2", "no chunks")} <= got
    assert not any(f.startswith(("missing", "metadata")) for d, f in got if d == "d1")


def test_head_learns_a_separable_rule(spark):
    vectors = spark.createDataFrame([(f"v{i}", [float(i % 2), 1.0]) for i in range(24)], "chunk_id string, vector array<double>")
    pairs = spark.createDataFrame([(f"v{i}", f"v{j}", "AGREE" if (i - j) % 2 == 0 else "UNRELATED") for i in range(12) for j in range(12, 16)], "src string, dst string, label string")
    examples = M.pair_examples(pairs, vectors)
    said = M.predictions(M.fitted_head(examples), examples)
    assert said.where("label <> predicted").count() == 0


def test_durable_uses_the_session_folder(spark):
    assert durable(spark.range(3)).count() == 3
    assert spark.sparkContext.getCheckpointDir()


def test_run_artifacts(spark, tmp_path):
    metrics = spark.createDataFrame([("rag", None, 0.25)], "arm string, eval_layer string, fabrication_rate double")
    O.write_run(spark.range(1), metrics, {"model": "none"}, str(tmp_path / "run"))
    assert "| fabrication_rate | 0.250 |" in (tmp_path / "run" / "report.md").read_text()
