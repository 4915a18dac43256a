"""Texts and request bodies sent to models."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# The instruction of the generation step.
INSTRUCTION = (
    "\nFor each of the following questions, generate {count}creative and original ideas. "
    "Provide an explanation for each idea. "
    'List the ideas using numbered bullets (e.g., "1.", "2.", etc.).'
    "Use a line break only to separate each idea. "
    "Do not include any introductory text."
)

# The rubric of the rating step, its five metrics and its two
# request forms.
RUBRIC = (
    "You are an expert of psychology. Your objective is to assess the subject's creativity through their answers to some question/answering task related to divergent thinking. You will be given a question-answer pair. Your task is to score the answer."
    "\nYou should rate the answer on five metrics. For all five metrics, assign a score between 1 and 5, with 5 being the highest. Five metrics are:"
    "\n1) Fluency. Fluency refers to the ability to generate a large quantity of ideas or solutions to a given problem. This measure isn't concerned with the quality or uniqueness of the ideas, but rather the sheer volume. The more ideas one can produce, the higher the fluency is."
    "\n2) Flexibility. Flexibility is the capacity to shift one's thinking and to produce a wide range of ideas from different categories or perspectives. It involves being able to think outside of the box and to switch from one type of idea to another."
    "\n3) Originality. Originality refers to the ability to come up with unique or novel ideas that differ from the norm. It's not just about producing many ideas (fluency), but also about producing ideas that are different from what others might typically think of."
    "\n4) Elaboration. Elaboration is the ability to expand upon or add detail to ideas. It involves taking a simple idea and building upon it, adding complexity and depth. Elaboration isn't just about creating more, but about deepening what is there."
    "\n5) Finally, you will provide an overall score between 1 and 5, with 5 being the highest. You should only give the score, format like: Fluency: 3"
)
METRICS = ["Fluency", "Flexibility", "Originality", "Elaboration", "Overall"]
FUNCTION_NAME = "creativity_score"
FUNCTION_DESCRIPTION = "Assess the creativity of an answer based on five metrics."
TOOL_CALL_MODEL = "gpt-4-0613"
MAX_COMPLETION_TOKENS = 64
CHAT_URL = "/v1/chat/completions"
EMBEDDING_URL = "/v1/embeddings"


def chat_messages(model: Column, task_prompt: Column, query: Column,
                  n_items: int | None = None) -> Column:
    """System and user message, or one user message for models without a system role."""
    instruction = INSTRUCTION.format(count="" if n_items is None else f"{n_items} ")
    question = F.concat(task_prompt, query)
    system = _message("system", F.lit(instruction))
    merged = F.concat(F.lit(instruction + "\n"), question)
    return F.when(F.lower(model).contains("gemma"), F.array(_message("user", merged))) \
        .otherwise(F.array(system, _message("user", question)))


def contextualized(task_prompt: Column, query: Column, answer: Column) -> Column:
    """The text to embed: the answer together with its question."""
    return F.concat(F.lit("Q: "), task_prompt, F.lit(" "), query, F.lit("\nA: "), answer)


def judge_question(task_prompt: Column, query: Column, numbered: Column) -> Column:
    return F.concat(F.lit("Question: "), task_prompt, query, F.lit("\nAnswer: "), numbered)


def custom_id(*parts: Column) -> Column:
    return F.concat_ws("-", *[part.cast("string") for part in parts])


def split_answer_id(column: Column) -> Column:
    """``env-task-query-answer``; read from the right, as env may hold ``-``."""
    pattern = r"^(.*)-(\d+)-(\d+)-(\d+)$"
    return F.struct(
        F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")).alias("env"),
        *[F.regexp_extract(column, pattern, i).try_cast("int").alias(name)
          for i, name in enumerate(("task_idx", "query_idx", "answer_idx"), start=2)])


def split_query_id(column: Column) -> Column:
    """``task_name-query``"""
    pattern = r"^(.*)-(\d+)$"
    return F.struct(
        F.nullif(F.regexp_extract(column, pattern, 1), F.lit("")).alias("task_name"),
        F.regexp_extract(column, pattern, 2).try_cast("int").alias("query_idx"))


def embedding_request(request_id: Column, model: Column, text: Column) -> list[Column]:
    return [
        request_id.alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(EMBEDDING_URL).alias("url"),
        F.struct(model.alias("model"), text.alias("input")).alias("body"),
    ]


def rating_request(request_id: Column, model: Column, question: Column,
                   rubric: str | None = None) -> list[Column]:
    """``body`` is JSON text, as its form depends on the model."""
    opening = F.to_json(F.struct(
        model.alias("model"),
        F.array(_message("system", F.lit(RUBRIC if rubric is None else rubric)),
                _message("user", question)).alias("messages")))
    ending = F.when(model == TOOL_CALL_MODEL, F.lit(json.dumps(_tool_call_options())[1:])) \
        .otherwise(F.lit(json.dumps(_schema_options())[1:]))
    return [
        request_id.alias("custom_id"),
        F.lit("POST").alias("method"),
        F.lit(CHAT_URL).alias("url"),
        _extend_json(opening, ending).alias("body"),
    ]


def request_line(custom_id: Column, method: Column, url: Column, body: Column) -> Column:
    """One request with a JSON body as one line of JSON."""
    opening = F.to_json(F.struct(custom_id.alias("custom_id"), method.alias("method"),
                                 url.alias("url")))
    return _extend_json(opening, F.concat(F.lit('"body": '), body, F.lit("}")))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _extend_json(opening: Column, members: Column) -> Column:
    return F.concat(F.regexp_replace(opening, r"\}\z", ", "), members)


def _metric_schema(**extra) -> dict:
    return {"type": "object", "properties": {m: {"type": "number"} for m in METRICS},
            "required": METRICS, **extra}


def _tool_call_options() -> dict:
    function = {"name": FUNCTION_NAME, "description": FUNCTION_DESCRIPTION,
                "parameters": _metric_schema()}
    return {"tools": [{"type": "function", "function": function}],
            "tool_choice": {"type": "function", "function": {"name": FUNCTION_NAME}}}


def _schema_options() -> dict:
    schema = {"name": FUNCTION_NAME, "schema": _metric_schema(additionalProperties=False),
              "strict": True}
    return {"max_completion_tokens": MAX_COMPLETION_TOKENS,
            "response_format": {"type": "json_schema", "json_schema": schema}}
