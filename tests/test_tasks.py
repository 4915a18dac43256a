import json

import pytest
from pyspark.sql import functions as F

from variegate.functions import prompts
from variegate.operators import ledger, replies, tasks
from variegate.operators.embed import embed, hashed_embedding
from variegate.sources import schemas

TASKS = [(0, "cp", "Common", "Find problems: ", 0, "party"),
         (0, "cp", "Common", "Find problems: ", 1, "trip")]
ANSWERS = [(0, 0, 0, "cake"), (0, 0, 1, "noise"), (0, 1, None, None)]


@pytest.fixture
def given(spark):
    return (spark.createDataFrame(TASKS, schemas.TASKS),
            spark.createDataFrame(ANSWERS, schemas.ANSWERS))


def test_context_join(spark, given):
    asked, answers = given
    missing = answers.where("query_idx = 0")
    assert tasks.with_task_context(asked, missing).count() == 2
    assert tasks.with_task_context(asked, answers, strict=True).count() == 3
    with pytest.raises(Exception, match="no answers for query 0-1"):
        tasks.with_task_context(asked, missing, strict=True).collect()


def test_texts(given):
    asked, answers = given
    joined = tasks.with_task_context(asked, answers)
    texts = {r["answer_idx"]: r["text"] for r in tasks.contextualize(joined).collect()}
    assert texts == {0: "Q: Find problems:  party\nA: cake", 1: "Q: Find problems:  party\nA: noise",
                     None: None}
    only = tasks.contextualize(joined, answer_only=True)
    assert {r["text"] for r in only.collect()} == {"cake", "noise", None}
    assert tasks.embedding_requests(tasks.contextualize(joined), "my-env", "m").count() == 2


def test_messages(given):
    asked, _ = given
    first = tasks.generation_messages(asked, "google/Gemma-2", 5).orderBy("query_idx").first()
    assert [m["role"] for m in first["messages"]] == ["user"]
    assert first["messages"][0]["content"].startswith("\nFor each of the following questions, "
                                                      "generate 5 creative and")
    assert first["messages"][0]["content"].endswith("text.\nFind problems: party")
    first = tasks.generation_messages(asked, "other").orderBy("query_idx").first()
    assert [m["role"] for m in first["messages"]] == ["system", "user"]
    assert "generate creative and" in first["messages"][0]["content"]
    assert first["messages"][1]["content"] == "Find problems: party"


def test_judge_prompts(given):
    asked, answers = given
    rows = {r["query_idx"]: r for r in tasks.judge_prompts(asked, answers, strict=True).collect()}
    assert rows[0]["prompt"] == "Question: Find problems: party\nAnswer: 1. cake 2. noise"
    assert rows[1]["prompt"] == "Question: Find problems: trip\nAnswer: "
    assert (rows[0]["n_answers"], rows[1]["n_answers"]) == (2, 0)


@pytest.mark.parametrize("block", [1, 2, 4096])
def test_parts_make_up_the_prompts(spark, given, block):
    """With gaps in the positions, a null among the answers and a query without any."""
    asked, _ = given
    answers = spark.createDataFrame(
        [(0, 0, 7, "late"), (0, 0, 2, "first"), (0, 0, 3, None), (0, 0, 5000, "last")],
        "task_idx int, query_idx int, answer_idx int, answer string")
    prompts = {r["query_idx"]: r for r in tasks.judge_prompts(asked, answers).collect()}
    assert prompts[0]["prompt"].endswith("Answer: 1. first 2. late 3. last")
    assert prompts[1]["n_answers"] == 0
    found = {}
    for row in tasks.judge_prompt_parts(asked, answers, block).orderBy("part").collect():
        found[row["query_idx"]] = found.get(row["query_idx"], "") + row["text"]
    assert found == {k: r["prompt"] for k, r in prompts.items()}
    assert tasks.rating_requests(tasks.judge_prompts(asked, answers), "gpt-4.1").count() == len(found)


@pytest.mark.parametrize("model", ["gpt-4-0613", "gpt-4.1"])
def test_rating_requests(given, model):
    asked, answers = given
    requests = tasks.rating_requests(tasks.judge_prompts(asked, answers), model)
    row = requests.orderBy("custom_id").first()
    body = json.loads(row["body"])
    assert row["custom_id"] == "cp-0" and row["url"] == "/v1/chat/completions"
    assert body["model"] == model
    assert body["messages"][0] == {"role": "system", "content": prompts.RUBRIC}
    assert body["messages"][1]["content"].endswith("1. cake 2. noise")
    names = ["Fluency", "Flexibility", "Originality", "Elaboration", "Overall"]
    if model == "gpt-4-0613":
        parameters = body["tools"][0]["function"]["parameters"]
        assert parameters["required"] == names and "additionalProperties" not in parameters
        assert body["tool_choice"]["function"] == {"name": "creativity_score"}
        assert "response_format" not in body
    else:
        assert body["max_completion_tokens"] == 64
        schema = body["response_format"]["json_schema"]
        assert schema["strict"] is True and schema["schema"]["additionalProperties"] is False
        assert list(schema["schema"]["properties"]) == names and "tools" not in body


def test_ids(one):
    key = one(prompts.split_answer_id(F.col("t")), t="my-env-1-2-3")
    assert tuple(key) == ("my-env", 1, 2, 3)
    assert tuple(one(prompts.split_answer_id(F.col("t")), t="oops")) == (None,) * 4
    assert tuple(one(prompts.split_query_id(F.col("t")), t="a-b-7")) == ("a-b", 7)


def test_responses_and_pending(spark):
    requests = spark.createDataFrame([("a",), ("b",)], "custom_id string")
    responses = spark.createDataFrame([("a", 1.0)], "custom_id string, overall double")
    rows = {r["custom_id"]: r["is_answered"] for r in
            tasks.correlate_responses(requests, responses).collect()}
    assert rows == {"a": True, "b": False}
    answers = spark.createDataFrame(ANSWERS, schemas.ANSWERS)
    vectors = spark.createDataFrame([(0, 0, 0, [1.0]), (0, 0, 1, None)],
                                    "task_idx int, query_idx int, answer_idx int, "
                                    "embedding array<double>")
    assert [r["answer"] for r in tasks.pending_answers(answers, vectors).collect()] == ["noise"]


def test_counts_and_lengths(given):
    _, answers = given
    counts = {r["query_idx"]: r["n_answers"] for r in tasks.answer_counts(answers).collect()}
    assert counts == {0: 2, 1: 0}
    lengths = {r["query_idx"]: r["answer_length"] for r in tasks.answer_length(answers).collect()}
    assert lengths == {0: 1.0, 1: None}


def test_nest(spark, given):
    _, answers = given
    rows = {r["query_idx"]: r["items"] for r in tasks.nest(answers, "answer").collect()}
    assert rows == {0: ["cake", "noise"], 1: []}
    sliced = tasks.nest(answers, "answer", slice_size=1).collect()
    assert {(r["query_idx"], r["part"]): r["items"] for r in sliced} == {
        (0, 0): ["cake"], (0, 1): ["noise"], (1, 0): []}
    far = spark.createDataFrame([(0, 0, i, str(i)) for i in (0, 5000, 10000)],
                                "task_idx int, query_idx int, answer_idx int, answer string")
    assert [r["items"] for r in tasks.nest(far, "answer").collect()] == [["0", "5000", "10000"]]
    parts = tasks.nest(far, "answer", slice_size=2).collect()
    assert {r["part"]: r["items"] for r in parts} == {0: ["0", "5000"], 1: ["10000"]}


def test_ratings_by_query(spark, given):
    asked, _ = given
    ratings = spark.createDataFrame([("cp-0", 1.0), ("cp-9", 2.0), ("odd", 3.0)],
                                    "custom_id string, fluency double")
    found = tasks.ratings_by_query(ratings, asked).collect()
    assert [tuple(r) for r in found] == [(0, 0, 1.0)]


def test_assemble(spark):
    left = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "task_idx int, query_idx int, a double")
    right = spark.createDataFrame([(0, 1, 2.0), (0, 2, 3.0)], "task_idx int, query_idx int, b double")
    rows = {r["query_idx"]: (r["a"], r["b"]) for r in tasks.assemble_scores(left, right).collect()}
    assert rows == {0: (1.0, None), 1: (None, 2.0), 2: (None, 3.0)}
    with pytest.raises(ValueError, match="more than one table"):
        tasks.assemble_scores(left, left)
    with pytest.raises(Exception, match="more than one row"):
        tasks.assemble_scores(left.union(left), right).collect()


ATTEMPTS = [
    (0, 0, 0, "1. it is on\n2. so", "stop"), (0, 0, 1, " 1. red paper boat\n2. blue paper boat\n",
                                              "stop"),
    (0, 0, 2, "1. green paper boat", "stop"),
    (0, 1, 0, "1. it is", "stop"), (0, 1, 25, "1. red paper boat", "stop"),
    (0, 2, 0, "1. red paper boat\n2. it i", "length"), (0, 4, 30, "1. red paper boat", "stop"),
]


def test_replies(spark):
    attempts = spark.createDataFrame(ATTEMPTS, schemas.ATTEMPTS)
    checked = replies.check_attempts(attempts)
    chosen = {r["query_idx"]: r for r in replies.select_replies(checked).collect()}
    assert chosen[0]["attempt"] == 1
    assert chosen[0]["text"] == "1. red paper boat\n2. blue paper boat"
    assert chosen[0]["items"] == ["red paper boat", "blue paper boat"]
    assert chosen[1]["text"] is None and chosen[1]["items"] == []   # the 26th round is too late
    assert chosen[4]["text"] is None and chosen[4]["items"] == []   # and has no earlier one
    assert chosen[2]["items"] == ["red paper boat", "it i"]         # kept, though cut off
    dropped = replies.select_replies(checked, drop_truncated=True).where("query_idx = 2").first()
    assert dropped["items"] == ["red paper boat"]
    capped = replies.select_replies(checked, max_items=1).where("query_idx = 0").first()
    assert capped["items"] == ["red paper boat"]
    answers = replies.answers_of(replies.select_replies(checked))
    assert answers.where("query_idx = 1").first()["answer"] is None
    queries = spark.createDataFrame([(0, i) for i in range(4)], "task_idx int, query_idx int")
    pending = {r["query_idx"] for r in replies.pending_queries(queries, checked).collect()}
    assert pending == {1, 3}
    log = replies.attempt_log(checked)
    assert {(r["query_idx"], r["attempt"], r["ok"]) for r in log.collect()} == {
        (0, 0, False), (0, 1, True), (1, 0, False), (2, 0, True)}
    summary = {r["attempt"]: (r["n_ok"], r["n_failed"]) for r in
               replies.attempt_summary(log).collect()}
    assert summary == {0: (1, 2), 1: (1, 0)}
    with pytest.raises(ValueError, match="Invalid language"):
        replies.check_attempts(attempts, language="klingon")


def test_ledger(spark):
    rows = [(0, "b0", "f", "x.jsonl", "completed"), (1, "b1", "f", "x.jsonl", "failed"),
            (2, "b2", "f", "y.jsonl", None)]
    df = spark.createDataFrame(rows, schemas.LEDGER)
    assert ledger.lookup_batch(df, "x.jsonl").first()["batch_id"] == "b0"
    assert ledger.lookup_batch(df, "x.jsonl", "latest").first()["batch_id"] == "b1"
    with pytest.raises(ValueError, match="no entry in the ledger for z"):
        ledger.lookup_batch(df, "z")
    assert [r["batch_id"] for r in ledger.completed_batches(df).collect()] == ["b0"]
    with pytest.raises(Exception, match="is not done"):
        ledger.completed_batches(df, strict=True).collect()
    with pytest.raises(ValueError):
        ledger.pick_batches(df, "any")


def test_embed(spark):
    df = spark.createDataFrame([("a b a",), ("",)], "text string")
    vectors = [r["embedding"] for r in hashed_embedding(df, dimensions=64).collect()]
    assert [len(v) for v in vectors] == [64, 64]
    assert [sum(v) for v in vectors] == [5.0, 0.0]     # three words and two pairs
    rows = embed(df, "text", lambda batch: batch.map(
        lambda t: [float(len(t))] if t else None)).collect()
    assert [r["embedding"] for r in rows] == [[5.0], None]
