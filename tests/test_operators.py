"""Record transforms and reports on small record sets."""

import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from voxmend.functions.prompts import compact_json, hotword_lines, input_block
from voxmend.functions.register import register
from voxmend.operators import baselines, exports, filters, models, records, reports, rules, splits
from voxmend.operators.evidence import with_evidence
from voxmend.plans import training

RAW = "dataset string, split string, id string, reference string, nbest array<string>, nbest_pinyin array<string>"


def raw(spark, *rows):
    return spark.createDataFrame(list(rows), RAW)


def test_training_record(spark):
    made = records.training_records(raw(spark, (None, "dev", "utt1", "房地产中介", ["", " ", "房地产中界", "房地产中介", "x"], ["p1"]), ("d", None, "u2", None, None, None)), nbest_size=2)
    a, b = made.orderBy("id").collect()[::-1]
    assert (a["id"], a["source"], a["input"]["nbest"], a["input"]["nbest_pinyin"]) == ("utt1", "chinesehp/aishell-1", ["房地产中界", "房地产中介"], ["p1", "房 地 产 中 介"])
    assert [(e["from"], e["to"], e["reason"]) for e in a["output"]["edits"]] == [("界", "介", "middle_span_replace")]
    assert (b["input"]["asr_top1"], b["input"]["nbest"], b["output"]["edits"], b["reference"]) == ("", [], [], "")
    text = records.training_records(raw(spark, ("d", "s", "1", "ref", ["hyp"], None)), output_mode="text").first()
    assert text["output"]["corrected_text"] == "ref"
    with pytest.raises(ValueError, match="output_mode"):
        records.training_records(raw(spark, ("d", "s", "1", "r", [], None)), output_mode="no")


def test_rules_and_oracle(spark):
    nbest = ["房地产中界协会", "房地产中介协会", "房地产中介协会"]
    made = records.training_records(raw(spark, ("d", "s", "1", "房地产中介协会", nbest, None)))
    done = records.rule_correct(made, max_char_distance=2).first()
    assert done["prediction"] == nbest[1] and done["correction_result"]["accepted"]
    assert [(e["from"], e["to"], e["reason"]) for e in done["predicted_edits"]["edits"]] == [("界", "介", "rule_nbest_same_pinyin")]
    best = baselines.with_baselines(made).first()["baseline_predictions"]["oracle_nbest"]
    assert (best["prediction"], best["index"], best["distance"]) == (nbest[1], 1, 0)
    report = baselines.report(records.training_records(raw(spark, ("d", "s", "1", "abc", ["axc", "abc"], None), ("d", "s", "2", "", ["a"], None)))).first()
    assert (report["samples"], report["top1_cer"], report["oracle_cer"]) == (1, 1 / 3, 0.0)
    none = with_evidence(records.training_records(raw(spark, ("d", "s", "1", "abc", ["", " "], None)))).select(baselines.oracle(F.col("ev")).alias("o")).first()["o"]
    assert (none["index"], none["distance"], none["text"]) == (0, 3, "")
    # The first hypothesis is skipped whatever it says, and one without others is left alone.
    alone = records.training_records(raw(spark, ("d", "s", "1", "abc", ["abd"], None)))
    assert with_evidence(alone).select(rules.rule_candidate(F.col("ev"))).first()[0] == "abd"


def test_apply_needs_an_input_block(spark):
    flat = spark.createDataFrame([("a", ["b"], [{"from": "a", "to": "b", "reason": ""}])], "asr_top1 string, nbest array<string>, predicted_edits array<struct<`from`:string,`to`:string,reason:string>>")
    r = records.apply_edits(flat).first()
    assert r["correction_result"]["reasons"] == ["from_not_supported:a"] and r["prediction"] == "a"
    nulls = flat.withColumn("predicted_edits", F.lit(None).cast(flat.schema["predicted_edits"].dataType))
    assert records.apply_edits(nulls).first()["correction_result"]["accepted"]


def test_hot_words_back_edits_and_show_scores(spark):
    block = F.struct(F.lit("中界").alias("asr_top1"), F.array(F.lit("中界")).alias("nbest"), F.array().cast("array<string>").alias("nbest_pinyin"))
    edits = F.struct(F.array(F.struct(F.lit("界").alias("from"), F.lit("介").alias("to"), F.lit("").alias("reason"))).alias("edits"))
    base = spark.range(1).select(F.lit("1").alias("id"), block.alias("input"), edits.alias("output"), F.lit("中介").alias("reference"))
    assert not records.apply_edits(base).first()["correction_result"]["accepted"]
    plain = base.withColumn("input", F.col("input").withField("hotwords", F.array(F.lit("中介"))))
    structs = base.withColumn("input", F.col("input").withField("hotwords", F.array(F.struct(F.lit("中介").alias("text"), F.lit(0.5).alias("score")))))
    for df, line in ((plain, "- 中介"), (structs, "- 中介 (score=0.5000)")):
        assert records.apply_edits(df).first()["prediction"] == "中介"
        assert filters.with_reason(df, require_verifier_pass=True).first()["filter_reason"] == "kept"
        assert exports.to_chat(df).first()["messages"][1]["content"].endswith("Hotwords:\n" + line)
    flat = spark.createDataFrame([("1", "ac", ["ac", "ab", "ab"], "ab")], "id string, asr_top1 string, nbest array<string>, reference string")
    assert records.rule_correct(flat).first()["prediction"] == "ab"


def test_prepared(spark):
    rows = raw(spark, *[("d", "dev" if i % 2 else "train", str(i), "ab", ["ac"], None) for i in range(6)])
    assert [r["id"] for r in records.prepared(rows, "dev", 2).orderBy("id").collect()] == ["1", "3"]
    assert records.prepared(rows).count() == 6


def test_filter(spark):
    made = records.training_records(
        raw(spark, ("d", "s", "1", "", ["a"], None), ("d", "s", "2", "abcd", ["wxyz"], None), ("d", "s", "3", "abcd", ["abcd"], None), ("d", "s", "4", "a" * 40 + "b" * 30, ["a" * 40 + "c" * 30], None), ("d", "s", "5", "abcx", ["abcd"], None))
    )
    got = {r["id"]: r["filter_reason"] for r in filters.with_reason(made, drop_empty_edits=True, require_verifier_pass=True).collect()}
    assert got == {"1": "empty_text", "2": "baseline_cer_too_high", "3": "empty_edits", "4": "too_many_changed_chars", "5": "verifier:to_not_supported:x"}
    assert filters.kept(made).count() == 2
    bad = made.withColumn("raw", F.lit('{"edits": 3}'))
    assert {r[0] for r in filters.with_reason(bad, edits_json="raw").where("id = '3'").select("filter_reason").collect()} == {"bad_edits"}


def test_reports(spark):
    rows = spark.createDataFrame([("1", "abc", "abd", "abc", ["x"]), ("2", "abc", "abc", "abx", ["x", "y"]), ("3", "abc", "abx", "aby", []), ("4", "", "a", "", None)], "id string, reference string, asr_top1 string, prediction string, why array<string>")
    done = rows.withColumn("correction_result", F.struct(F.col("why").alias("reasons"), F.col("prediction").alias("text")))
    one = reports.evaluate(done, baseline_field="asr_top1").first()
    assert (one["samples"], one["edits"], one["baseline_edits"], one["improved_samples"], one["worsened_samples"], one["unchanged_samples"]) == (3, 2, 2, 1, 1, 1)
    seen = reports.analyzed(done)
    assert {r["status"]: r["samples"] for r in reports.status_counts(seen).collect()} == {"improved": 2, "worsened": 1, "unchanged": 1}
    assert [tuple(r) for r in reports.reason_counts(seen).collect()] == [("x", 2), ("y", 1)]
    assert reports.top_changes(seen, 1).count() == 3
    assert reports.evaluate(done.where("false")).first()["cer"] == 0.0
    values = spark.createDataFrame([(float(x),) for x in (4, 2, 3, 1)], "x double")
    assert [r["value"] for r in reports.nearest_rank(values, "x", [0.0, 0.5, 1.0]).orderBy("p").collect()] == [1.0, 3.0, 4.0]
    assert [r["value"] for r in reports.nearest_rank(values.where("false"), "x", [0.5]).collect()] == [0.0]


def test_splits(spark):
    df = spark.range(1000).withColumn("split", F.when(F.col("id") % 2 == 0, "a"))
    sizes = {r["bucket"]: r["count"] for r in splits.by_hash(df, "id").groupBy("bucket").count().collect()}
    assert sizes == {"train": 900, "dev": 50, "test": 50}
    assert {r["bucket"] for r in splits.by_field(df).select("bucket").distinct().collect()} == {"a", "unknown"}
    assert splits.first_rows(df, 3, "id").count() == 3 and splits.first_rows(df, 0, "id").count() == 1000


def test_exports(spark):
    made = records.training_records(raw(spark, ("d", "s", "1", "房地产中介", ["房地产中界", "房地产中介"], None)))
    chat = exports.export(made, "Qwen-Messages").first()["messages"]
    assert [m["role"] for m in chat] == ["system", "user", "assistant"]
    assert json.loads(chat[2]["content"]) == {"edits": [{"from": "界", "to": "介", "reason": "middle_span_replace"}]} and " " not in chat[2]["content"]
    assert chat[1]["content"].endswith("\n\nASR: 房地产中界\nN-best:\n1. 房地产中界\n2. 房地产中介\nPinyin:\n1. 房 地 产 中 界\n2. 房 地 产 中 介")
    assert exports.export(made, "prompt").columns == ["prompt", "completion"] and exports.export(made, "query-response").columns == ["query", "response"]
    assert len(exports.inference_messages(made).first()["messages"]) == 2
    assert len(exports.training_texts(made, "internal", 2).first()["text"]) == 16
    with pytest.raises(ValueError, match="format"):
        exports.export(made, "other")
    hot = spark.createDataFrame([([{"text": " a ", "score": 0.00015}, {"text": "b", "score": None}],)], "h array<struct<text:string,score:double>>")
    assert hot.select(hotword_lines(F.col("h"), True)).first()[0] == ["- a (score=0.0001)", "- b"]
    empty = spark.createDataFrame([("", None)], "t string, n array<string>").select(input_block(F.col("t"), F.col("n"), F.array(F.lit("p")))).first()[0]
    assert empty == "Pinyin:\n1. p"
    assert spark.range(1).select(compact_json(F.struct(F.lit(None).cast("string").alias("a")))).first()[0] == '{"a":null}'


def test_a_teacher_over_http(spark, monkeypatch):
    made = records.training_records(raw(spark, ("d", "s", "1", "ab", ["ac"], None), ("d", "s", "2", "ab", ["ad"], None)))
    dry = models.teach(made, name="t", dry_run=True).first()
    assert (dry["teacher_model"], dry["predicted_edits"]["edits"], dry["parse_warnings"]) == ("t", [], [])
    seen = []

    class Teacher(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            said = json.dumps({"choices": [{"message": {"content": '{"edits":[{"from":"c","to":"b"}]}'}}]}).encode()
            self.send_response(200 if len(seen) < 3 else 500)
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Teacher)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = models.chat_client(f"http://127.0.0.1:{server.server_port}/v1/", "m", ("NO_SUCH_KEY", "PATH"))
    real = records.apply_edits(models.teach(made, client, "m", limit=1)).collect()
    assert len(real) == 1 and real[0]["correction_result"]["reasons"] == ["to_not_supported:b"]
    path, key, asked = seen[0]
    assert (path, key.startswith("Bearer "), asked["model"], asked["temperature"], [m["role"] for m in asked["messages"]]) == ("/v1/chat/completions", True, "m", 0, ["system", "user"])
    with pytest.raises(Exception, match="NO_SUCH_KEY"):
        models.teach(made, models.chat_client("http://x", "m", ("NO_SUCH_KEY",)), "m").collect()
    with pytest.raises(Exception, match="HTTP 500"):
        models.teach(made, client, "m").collect()
        models.teach(made, client, "m").collect()
    server.shutdown()
    with pytest.raises(ValueError, match="teacher"):
        models.teach(made)


def test_inference_and_recognition(spark):
    made = records.training_records(raw(spark, ("d", "s", "1", "ab", ["ac"], None), ("d", "s", "2", "xy", ["xy"], None)))

    def model():
        return lambda prompts: [' [{"from":"c","to":"b"}]\n' if "ASR: ac" in p and p.endswith("<assistant>\n") else "none" for p in prompts]

    got = {r["id"]: r for r in models.infer(made, model).collect()}
    assert (got["1"]["model_output"], len(got["1"]["predicted_edits"]["edits"])) == ('[{"from":"c","to":"b"}]', 1)
    assert got["2"]["parse_warnings"] == ["no_valid_json_edits"] and "messages" not in got["1"].asDict()
    chats = exports.to_chat(made)
    assert models.infer(chats, model, "qwen-messages", limit=1).count() == 1
    manifest = spark.createDataFrame([("1", "a.wav", "ref", 3), ("2", "", "r", 4)], "id string, audio string, reference string, speaker int")
    heard = models.transcribe(manifest.where("id = '1'"), lambda: lambda paths: [[f" {p} ", "", "y"] for p in paths]).first()
    assert (heard["nbest"], heard["asr_top1"], heard["metadata"]) == (["a.wav", "y"], "a.wav", {"speaker": "3"})
    with pytest.raises(Exception, match="Missing audio path for record 2"):
        models.transcribe(manifest, lambda: lambda paths: [["x"] for _ in paths]).collect()
    assert models.beams(3) == {"num_beams": 5, "num_return_sequences": 5}


def test_training_contract(spark, tmp_path):
    made = records.training_records(raw(spark, ("d", "s", "1", "ab", ["ac"], None)))
    settings = training.Settings("dummy", input_format="internal", target_modules="a, b,", max_length=1)
    said = training.dry_run(settings, made, made)
    assert (said["train_rows"], said["eval_rows"], len(said["sample"][0]["text"])) == (1, 1, 8)
    path = training.write_metadata(settings, 1, 0, str(tmp_path / "out"))
    kept = json.loads(open(path, encoding="utf-8").read())
    assert kept["lora"] == {"r": 16, "alpha": 32, "dropout": 0.05, "target_modules": ["a", "b"], "qlora": False} and kept["precision"] == {"bf16": False, "fp16": False} and kept["train_rows"] == 1


def test_functions_by_name(spark):
    assert "model_edits" in register(spark)
    row = spark.sql("SELECT normal_text('ａ, b。') AS n, size(model_edits('[{\"from\":\"a\",\"to\":\"b\"}]').edits) AS e, edit_distance('中界', '中介') AS d, error_rate('', '') AS z, error_rate('a', 'ab') AS h, sounds_like(array('a'), array('a')) AS s").first()
    assert tuple(row) == ("ab", 1, 1, 0.0, 0.5, True)
