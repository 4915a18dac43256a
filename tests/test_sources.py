import json

import pytest

from variegate.operators import replies, tasks
from variegate.sources import readers, schemas, writers


def test_task_and_answer_files(spark, tmp_path):
    task_file, answer_file = tmp_path / "tasks.json", tmp_path / "answers.json"
    task_file.write_text(json.dumps([
        {"task_name": "a", "task_name_original": "A", "task_prompt": "p: ", "task_list": ["x", "ü"]},
        {"task_name": "b", "task_name_original": "B", "task_prompt": "q: ", "task_list": ["z"]}]),
        encoding="utf-8")
    answer_file.write_text(json.dumps([[["one", "two"], []], [["drei"]]], indent=4))
    asked = readers.read_tasks(spark, str(task_file))
    assert asked.schema == schemas.TASKS or asked.columns == schemas.TASKS.names
    assert {(r["task_idx"], r["query_idx"], r["query"]) for r in asked.collect()} == {
        (0, 0, "x"), (0, 1, "ü"), (1, 0, "z")}
    answers = readers.read_answers(spark, str(answer_file))
    assert {tuple(r) for r in answers.collect()} == {
        (0, 0, 0, "one"), (0, 0, 1, "two"), (0, 1, None, None), (1, 0, 0, "drei")}
    writers.write_answers(answers, str(tmp_path / "flat"))
    again = readers.read_answers(spark, str(tmp_path / "flat"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in answers.collect()}


def test_embeddings_by_run(spark, tmp_path):
    df = spark.createDataFrame(
        [("e", "m", "org/model", False, 0, 0, 0, [1.0, 2.0]),
         ("e", "m", "other", False, 0, 0, 0, [3.0, 4.0])], schemas.EMBEDDINGS)
    path = str(tmp_path / "vectors")
    writers.write_embeddings(df, path)
    run = readers.read_embeddings(spark, path).where("generation_model = 'org/model'")
    assert [r["embedding"] for r in run.collect()] == [[1.0, 2.0]]
    plan = run._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(generation_model" in plan
    assert readers.read_embeddings(spark, path).schema["answer_only"].dataType.typeName() == "boolean"


def test_run_columns_and_attempt_log(spark, tmp_path):
    attempts = spark.createDataFrame([(0, 0, 0, "1. red paper boat", "stop")], schemas.ATTEMPTS)
    log = replies.attempt_log(replies.check_attempts(attempts))
    path = str(tmp_path / "log")
    for env in ("first", "second"):
        writers.append_attempt_log(writers.with_run(log, env, "org/model"), path)
    rows = spark.read.parquet(path).collect()
    assert {(r["env"], r["generation_model"], r["ok"]) for r in rows} == {
        ("first", "org/model", True), ("second", "org/model", True)}
    assert all(r["logged_at"] is not None for r in rows)


def test_request_lines(spark, tmp_path):
    asked = spark.createDataFrame([(0, "t", "T", "p ", 0, 'q "ü"\n')], schemas.TASKS)
    answers = spark.createDataFrame([(0, 0, 0, "a\\b")], schemas.ANSWERS)
    prompts = tasks.judge_prompts(asked, answers)
    writers.write_requests(tasks.rating_requests(prompts, "gpt-4.1"), str(tmp_path / "rate"))
    line = json.loads(next((tmp_path / "rate").glob("*.txt")).read_text(encoding="utf-8"))
    assert line["body"]["messages"][1]["content"] == 'Question: p q "ü"\n\nAnswer: 1. a\\b'
    texts = tasks.contextualize(tasks.with_task_context(asked, answers))
    writers.write_requests(tasks.embedding_requests(texts, "env", "m"), str(tmp_path / "embed"))
    raw = next((tmp_path / "embed").glob("*.json")).read_text(encoding="utf-8")
    assert "ü" in raw
    assert json.loads(raw) == {"custom_id": "env-0-0-0", "method": "POST", "url": "/v1/embeddings",
                               "body": {"model": "m", "input": 'Q: p  q "ü"\n\nA: a\\b'}}


def chat(custom_id, **message):
    return json.dumps({"custom_id": custom_id, "response": {"body": {"choices": [
        {"message": message}]}}})


def call(text):
    return [{"function": {"arguments": text}}]


FULL = json.dumps({m: i for i, m in enumerate(
    ["Fluency", "Flexibility", "Originality", "Elaboration", "Overall"], start=1)})


def test_rating_responses(spark, tmp_path):
    path = tmp_path / "ratings.jsonl"
    path.write_text("\n".join([
        chat("tool", content=None, tool_calls=call(FULL)), chat("content", content=FULL), "",
        chat("null", content='{"Fluency":2.5}', tool_calls=None), chat("bad", content="oops"),
        chat("both", content='{"Fluency":5}', tool_calls=call('{"Fluency":4}'))]))
    df = readers.read_rating_responses(spark, str(path))
    rows = {r["custom_id"]: r for r in df.collect()}
    assert [rows["tool"][m] for m in schemas.RATINGS.names[1:]] == [1, 2, 3, 4, 5]
    assert rows["tool"]["is_complete"] and rows["content"]["is_complete"]
    assert rows["null"]["fluency"] == 2.5 and not rows["null"]["is_complete"]
    assert rows["bad"]["fluency"] is None and not rows["bad"]["is_complete"]
    assert rows["both"]["fluency"] == 4
    writers.write_ratings(df, str(tmp_path / "csv"))
    back = readers.read_ratings(spark, str(tmp_path / "csv"))
    assert back.columns == schemas.RATINGS.names and back.count() == 5
    with pytest.raises(Exception, match="incomplete rating"):
        readers.read_rating_responses(spark, str(path), strict=True).collect()


def test_embedding_responses(spark, tmp_path):
    path = tmp_path / "vectors.jsonl"
    good = {"custom_id": "e-0-1-2", "response": {"body": {"data": [{"embedding": [0.5, 1]}]}}}
    path.write_text(json.dumps(good) + "\n\n  \n")
    rows = readers.read_embedding_responses(spark, str(path)).collect()
    assert [(r["custom_id"], r["embedding"]) for r in rows] == [("e-0-1-2", [0.5, 1.0])]
    path.write_text(json.dumps(good) + "\n{broken\n")
    with pytest.raises(Exception):
        readers.read_embedding_responses(spark, str(path)).collect()
    assert readers.read_embedding_responses(spark, str(path), strict=False).count() == 2


def test_scores(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, "ncd", None, 0.5)], schemas.SCORES)
    writers.write_scores(df, str(tmp_path / "csv"))
    assert [tuple(r) for r in readers.read_scores(spark, str(tmp_path / "csv")).collect()] == [
        (0, 1, "ncd", None, 0.5)]
    writers.write_scores(df, str(tmp_path / "parquet"), format="parquet")
    assert (tmp_path / "parquet" / "method=ncd").is_dir()
    again = readers.read_scores(spark, str(tmp_path / "parquet")).collect()
    assert [tuple(r) for r in again] == [(0, 1, "ncd", None, 0.5)]


def test_csv_by_name(spark, tmp_path):
    path = tmp_path / "ratings.csv"
    path.write_text("fluency,flexibility,originality,elaboration,overall,custom_id,note\n"
                    "1,2,3,4,5,cp-0,x\n")
    row = readers.read_ratings(spark, str(path)).first()
    assert tuple(row) == ("cp-0", 1.0, 2.0, 3.0, 4.0, 5.0)
    (tmp_path / "scores.csv").write_text("score,method\n0.5,ncd\n")
    with pytest.raises(ValueError, match="columns missing"):
        readers.read_scores(spark, str(tmp_path / "scores.csv"))
    (tmp_path / "bad.csv").write_text("task_idx,query_idx,method,arg_n,score\n0,0,ncd,,high\n")
    with pytest.raises(Exception):
        readers.read_scores(spark, str(tmp_path / "bad.csv")).collect()


def test_broken_and_colliding_documents(spark, tmp_path):
    for name, text in (("cut", '[{"task_name": "a", "task_li'), ("other", '{"a": [1'), ("empty", "")):
        file = tmp_path / f"{name}.json"
        file.write_text(text)
        with pytest.raises(Exception):
            readers.read_tasks(spark, str(file)).collect()
        with pytest.raises(Exception):
            readers.read_answers(spark, str(file)).collect()
    both = tmp_path / "both.json"
    both.mkdir()
    for name in "ab":
        (both / f"{name}.json").write_text('[[["x"]]]')
    with pytest.raises(ValueError, match="collide"):
        readers.read_answers(spark, str(both))


def test_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert readers.read_ledger(spark, path).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_ledger(spark, path, strict=True)
    writers.append_ledger(spark, path, "b0", "f0", "x.jsonl")
    writers.append_ledger(spark, path, "b1", "f1", "x.jsonl", "completed")
    rows = readers.read_ledger(spark, path).orderBy("seq").collect()
    assert [(r["seq"], r["batch_id"], r["status"]) for r in rows] == [
        (0, "b0", None), (1, "b1", "completed")]


def test_many_writers_of_the_ledger(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "ledger")
    with ThreadPoolExecutor(8) as pool:
        done = [pool.submit(writers.append_ledger, spark, path, f"b{i}", f"f{i}", "x.jsonl", None)
                for i in range(8)]
        [d.result() for d in done]
    rows = readers.read_ledger(spark, path).collect()
    assert sorted(r["seq"] for r in rows) == list(range(8))
    assert {r["batch_id"] for r in rows} == {f"b{i}" for i in range(8)}
    # a batch that is entered again, after a failure, keeps its place and its first entry
    first = {r["batch_id"]: r["seq"] for r in rows}
    writers.append_ledger(spark, path, "b3", "other", "y.jsonl", "completed")
    again = {r["batch_id"]: (r["seq"], r["input_file_id"]) for r in readers.read_ledger(spark, path).collect()}
    assert again == {b: (n, f"f{b[1:]}") for b, n in first.items()}


def test_entries_of_the_older_form(spark, tmp_path):
    path = str(tmp_path / "ledger")
    spark.createDataFrame([(1, "b", None, "x", None), (0, "c", None, "x", "completed")], schemas.LEDGER) \
        .write.parquet(path)
    writers.append_ledger(spark, path, "a", "f", "x")
    assert [(r["seq"], r["batch_id"]) for r in readers.read_ledger(spark, path).orderBy("seq").collect()] == [
        (0, "c"), (1, "b"), (2, "a")]
