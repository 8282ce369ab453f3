"""Files in and out, manifests, pipelines and streams."""

import json
import subprocess
import wave
import zipfile

import numpy as np
import pytest

from voxmend.operators import splits
from voxmend.plans.pipeline import build_command, command_text, run_commands, run_steps
from voxmend.sources import archives, audio, jsonl, kaldi
from voxmend.sources.config import load_config
from voxmend.streaming import records as streams


def test_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("1", "é/", None), ("2", "中", 3)], "id string, t string, n int")
    assert jsonl.write(df, str(tmp_path / "a")) == 2
    lines = sorted(line for f in (tmp_path / "a").glob("part-*") for line in f.read_text(encoding="utf-8").splitlines())
    assert lines == ['{"id":"1","t":"é/","n":null}', '{"id":"2","t":"中","n":3}']
    assert sorted(map(tuple, jsonl.read(spark, str(tmp_path / "a"), df.schema).collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "b.jsonl").write_text('{"id":"1"}\n\n  \n{"id":"2"} x\n')
    with pytest.raises(Exception, match=r"b\.jsonl:4: invalid JSON"):
        jsonl.read(spark, str(tmp_path / "b.jsonl"), "id string").collect()
    (tmp_path / "many").mkdir()
    for k in range(3):
        (tmp_path / "many" / f"{k}.jsonl").write_text("".join(f'{{"id":"{k}-{i}"}}\n' + "\n" * (i % 2) for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    numbered = jsonl.numbered_lines(spark, str(tmp_path / "many")).where("line <> ''").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(numbered) == 6000 and all((lambda i: r["line_no"] == 1 + i + i // 2)(int(json.loads(r["line"])["id"].split("-")[1])) for r in numbered)
    assert jsonl.read(spark, str(tmp_path / "b.jsonl"), "id string", strict=False).count() == 2
    (tmp_path / "c.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="expected JSON object"):
        jsonl.read(spark, str(tmp_path / "c.jsonl"), "id string").collect()
    assert jsonl.read_values(spark, str(tmp_path / "c.jsonl")).count() == 1
    seen = spark.createDataFrame([("1", "improved", -1, ["r"]), ("2", "worsened", 2, ["r"])], "id string, status string, delta_edits int, reasons array<string>")
    assert {tuple(r) for r in jsonl.write_analysis(seen, str(tmp_path / "e")).collect()} == {("status", "improved", 1), ("status", "worsened", 1), ("reason", "r", 2)}
    counts = jsonl.write_buckets(splits.by_field(df, "id"), str(tmp_path / "d"))
    assert [tuple(r) for r in counts.collect()] == [("1", 1), ("2", 1)]


def test_audio(spark, tmp_path):
    for name, rate, channels in (("a", 16000, 1), ("b", 8000, 2)):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(channels)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.full(800 * channels, 16384, "<i2").tobytes())
    (tmp_path / "c.txt").write_text("no audio")
    heard = {r["path"][-5:]: r["samples"] for r in audio.samples(audio.read_files(spark, str(tmp_path))).collect()}
    assert {k: (len(v), set(v)) for k, v in heard.items()} == {"a.wav": (800, {0.5}), "b.wav": (1600, {0.5})}


def test_zip_members(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/x.jsonl", "hello")
    out = tmp_path / "out" / "x.jsonl"
    assert archives.unpack_member(str(tmp_path / "a.zip"), str(out))["status"] == "written" and out.read_text() == "hello"
    assert archives.unpack_member(str(tmp_path / "a.zip"), str(out), member="m") == {"status": "exists", "member": "m", "output": str(out), "bytes": 5}
    with pytest.raises(ValueError, match="no member"):
        archives.pick_member(["a"], "t", "b")
    with pytest.raises(ValueError, match="which"):
        archives.pick_member(["a", "b"], "t")
    assert archives.pick_member(["p/t", "b"], "t") == "p/t"


def test_manifest(spark, tmp_path):
    (tmp_path / "text").write_text("﻿u1 hello  there\nu2 x\n\nu1 again\n", encoding="utf-8")
    found = kaldi.read_pairs(spark, str(tmp_path / "text"))
    assert [(r["id"], r["value"]) for r in found.orderBy("ord").collect()] == [("u1", "again"), ("u2", "x")]
    scp = spark.createDataFrame([("u2", "/b.wav"), ("u9", "/c.wav")], "id string, value string")
    rows = kaldi.manifest(found, scp, "/d/")
    assert {tuple(r) for r in rows.collect()} == {("u1", "/d/u1.wav", "again"), ("u2", "/b.wav", "x")}
    there, missing = kaldi.existing(rows, spark.createDataFrame([("/b.wav",)], "path string"))
    assert there.count() == 1 and missing.first()["id"] == "u1"
    (tmp_path / "bad").write_text("alone\n")
    with pytest.raises(Exception, match="bad:1: expected 'id value'"):
        kaldi.read_pairs(spark, str(tmp_path / "bad")).collect()


def test_pipelines(spark, tmp_path):
    command = build_command({"script": "s.py", "args": {"input": "a b", "dry_run": True, "skip": False, "topk": [1, 2]}})
    assert command[1:] == ["s.py", "--input", "a b", "--dry-run", "--topk", "1", "2"] and "'a b'" in command_text(command)
    assert build_command({"script": "s.py", "python": "/opt/py"})[0] == "/opt/py"
    for bad in ({}, {"script": "x", "args": [1]}):
        with pytest.raises(ValueError):
            build_command(bad)
    for bad in ({"steps": {}, "name": "n"} | {"steps": "x"}, {"steps": ["x"]}, {"steps": [], "env": ["A"]}, {"steps": [{}]}):
        with pytest.raises(ValueError):
            run_commands(bad, dry_run=True)
    own = run_commands({"name": "n", "log_file": str(tmp_path / "own.json"), "steps": [{"script": "a.py"}, {"name": "b", "script": "b.py"}]}, dry_run=True)
    kept = json.loads((tmp_path / "own.json").read_text())
    assert [x["name"] for x in kept["steps"]] == ["step_1", "b"] and kept["updated_at"] and kept == own
    (tmp_path / "c.json").write_text(json.dumps({"name": "n", "steps": [{"name": "one", "script": "s.py"}]}))
    run_commands(load_config(str(tmp_path / "c.json")), dry_run=True, log_file=str(tmp_path / "log" / "l.json"))
    assert json.loads((tmp_path / "log" / "l.json").read_text())["steps"][0]["status"] == "dry_run"
    (tmp_path / "s.py").write_text("raise SystemExit(3)")
    with pytest.raises(subprocess.CalledProcessError):
        run_commands({"steps": [{"name": "f", "script": str(tmp_path / "s.py")}]}, log_file=str(tmp_path / "l2.json"))
    assert json.loads((tmp_path / "l2.json").read_text())["steps"][0]["returncode"] == 3
    (tmp_path / "c2.json").write_text("[1]")
    with pytest.raises(ValueError, match="mapping"):
        load_config(str(tmp_path / "c2.json"))
    done = run_steps(spark.range(10), [("first", splits.first_rows, {"n": 4, "order": "id"})], str(tmp_path / "l3.json"))
    assert done.count() == 4


def test_stream_runs_the_batch_transform(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"id":"1","split":""}\n{"id":"2","split":"x"}\n')
    records = streams.read_records(spark, str(tmp_path / "in"), "id string, split string")
    streams.start(records, splits.by_field, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert {(r["id"], r["bucket"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("1", "unknown"), ("2", "x")}
