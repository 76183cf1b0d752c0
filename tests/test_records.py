import json

import pytest

from scorewright.sources import records, sinks


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("idx").collect()]


def test_jsonl_texts(spark, tmp_path):
    lines = ['{"text": " a "}', "", '{"text": " ", "input": "b"}', "raw line ", "5", "null", '["text"]', '["x"]', '"has text"', '"no key"', '{"other": 1}', '{"text": 3, "prompt": "c"}', '{"a": 1} x']
    path = write(tmp_path, "t.jsonl", "\n".join(lines))
    want = ["a", "b", "raw line", "5", "null", '["text"]', '"has text"', "c", '{"a": 1} x']
    assert [t for (t,) in rows(records.jsonl_texts(spark, path), "text")] == want
    assert [t for (t,) in rows(records.jsonl_texts(spark, path, 2), "text")] == want[:2]
    assert records.jsonl_texts(spark, path, 0).count() == 0
    assert records.jsonl_texts(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_salvage(spark, tmp_path):
    text = '{"broken": \n{"b": 1} tail\n```json {"c": 2} ```\n  \n{"a": 1, "a": 2}\nnope'
    got = rows(records.records(spark, write(tmp_path, "s.jsonl", text)), "idx", "record", "how")
    assert (1, '{"b": 1}', "braces") in got and (2, '{"c": 2}', "braces") in got and (4, '{"a": 2}', "line") in got
    assert [g for g in got if g[0] == 5] == []
    whole = '{"a":\n1,\n"b": {"c": 2}}'
    assert rows(records.records(spark, write(tmp_path, "w.jsonl", whole)), "record", "how") == [('{"a": 1, "b": {"c": 2}}', "file")]
    with pytest.raises(FileNotFoundError):
        records.records(spark, str(tmp_path / "none.jsonl"))


def test_no_record_gives_the_default(spark, tmp_path, monkeypatch):
    for name, text in (("empty.jsonl", ""), ("blank.jsonl", "\n \n"), ("none.jsonl", "nothing here")):
        got = rows(records.records(spark, write(tmp_path, name, text)), "idx", "record", "how")
        assert [(i, h) for i, _, h in got] == [(0, "default")]
        assert [m["role"] for m in json.loads(got[0][1])["messages"]] == ["user", "assistant"]
    monkeypatch.setattr(records, "WHOLE_BYTES", 10)
    with pytest.raises(ValueError):
        records.records(spark, write(tmp_path, "long.jsonl", '{"a":\n1,\n"b": 2}'))


def test_lines_of_many_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    path = write(tmp_path, "many.txt", "\n".join(text) + "\n")
    folder = tmp_path / "folder"
    folder.mkdir()
    (folder / "a.txt").write_text("one\n\ntwo")
    (folder / "b.txt").write_text("z" * 5000 + "\nlast\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        assert [t for _, t in rows(records.lines(spark, path), "idx", "line")] == text
        assert rows(records.lines(spark, str(folder)), "idx", "line") == [(0, "one"), (1, ""), (2, "two"), (3, "z" * 5000), (4, "last")]
        assert records.lines(spark, write(tmp_path, "no.txt", "")).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_that_are_no_objects(spark, tmp_path):
    for name, text in (("n.jsonl", '{"prompt": "p"}\n[1]'), ("n.json", '[{"prompt": "p"}, 5]'), ("m.jsonl", "null")):
        with pytest.raises(Exception, match="no object"):
            records.dataset(spark, write(tmp_path, name, text)).collect()
    folder = tmp_path / "d.json"
    folder.mkdir()
    (folder / "a").write_text('[{"prompt": "x"}]')
    (folder / "b").write_text('[{"prompt": "y"}, {"prompt": "z"}]')
    assert rows(records.dataset(spark, str(folder)), "idx", "prompt") == [(0, "x"), (1, "y"), (2, "z")]
    (folder / "c").write_text("5")
    with pytest.raises(ValueError):
        records.dataset(spark, str(folder))


def test_folders_and_rows_at_hand(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"a": i, "b": "é"}) + "\n")
    assert sorted(r.a for r in records.directory(spark, str(tmp_path / "in")).collect()) == [0, 1, 2]
    assert records.in_memory(spark, [(1, None)], "a long, b string").first().b is None


def test_log(tmp_path, capsys):
    for _ in range(2):
        log = sinks.log_to(str(tmp_path / "run.log"), "scorewright-test")
    log.info("one é")
    for handler in log.handlers:
        handler.flush()
    assert (tmp_path / "run.log").read_text(encoding="utf-8").count("one é") == 1 and capsys.readouterr().err.count("one é") == 1
    log.handlers[0].close()
    log.handlers.clear()


def test_dataset(spark, tmp_path):
    lines = ['{"prompt": "p", "answer": null}', "bad", '{"text": "t", "response": "r"}', '{"prompt": null}', "{}"]
    path = write(tmp_path, "d.jsonl", "\n".join(lines))
    want = [("p", None), ("t", "r"), (None, ""), ("", "")]
    assert rows(records.dataset(spark, path), "prompt", "answer") == want
    assert rows(records.dataset(spark, path, 3), "prompt", "answer") == want[:2]
    array = write(tmp_path, "d.json", json.dumps([{"prompt": "x"}, {"text": "y"}]))
    assert rows(records.dataset(spark, array), "prompt") == [("x",), ("y",)]
    assert rows(records.dataset(spark, array, 1), "prompt") == [("x",)]
    assert rows(records.dataset(spark, write(tmp_path, "o.json", '{"prompt": "one"}')), "prompt") == [("one",)]
    with pytest.raises(ValueError):
        records.dataset(spark, write(tmp_path, "d.csv", "x"))


def test_json_to_jsonl(spark, tmp_path):
    path = write(tmp_path, "in.json", json.dumps([{"a": "é你"}, 3, {"b": None}], ensure_ascii=False))
    out = sinks.json_to_jsonl(spark, path)
    assert out.endswith("in.jsonl")
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"a": "é你"}', '{"b": null}']
    with pytest.raises(ValueError):
        sinks.json_to_jsonl(spark, write(tmp_path, "obj.json", "{}"))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a long, b string")
    assert sorted(r.value for r in sinks.as_json(df).collect()) == ['{"a":1,"b":null}', '{"a":2,"b":"é"}']
    sinks.write_epoch(df, str(tmp_path / "out"), 3)
    assert spark.read.parquet(str(tmp_path / "out/epoch_3")).count() == 2
    sinks.write_metrics(spark, {"train_samples": 5}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first().train_samples == 5
