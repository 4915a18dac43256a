"""Fixed schemas of every table the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


TEXT, INT, LONG, DOUBLE, FLAG = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


QUERY_KEYS = ["task_idx", "query_idx"]
RUN_KEYS = ["env", "embedding_model", "generation_model", "answer_only"]

TASK_JSON = ("struct<task_name: string, task_name_original: string, "
             "task_prompt: string, task_list: array<string>>")
TASK_SET_JSON = f"array<{TASK_JSON}>"
ANSWERS_JSON = "array<array<array<string>>>"

TASKS = _struct(task_idx=INT, task_name=TEXT, task_name_original=TEXT, task_prompt=TEXT,
                query_idx=INT, query=TEXT)
ANSWERS = _struct(task_idx=INT, query_idx=INT, answer_idx=INT, answer=TEXT)
ATTEMPTS = _struct(task_idx=INT, query_idx=INT, attempt=INT, text=TEXT, finish_reason=TEXT)
EMBEDDINGS = _struct(env=TEXT, embedding_model=TEXT, generation_model=TEXT, answer_only=FLAG,
                     task_idx=INT, query_idx=INT, answer_idx=INT,
                     embedding=T.ArrayType(T.FloatType()))

EMBEDDING_REQUEST = _struct(custom_id=TEXT, method=TEXT, url=TEXT,
                            body=_struct(model=TEXT, input=TEXT))
_VECTOR = _struct(embedding=T.ArrayType(DOUBLE))
EMBEDDING_RESPONSE = _struct(
    custom_id=TEXT, response=_struct(body=_struct(data=T.ArrayType(_VECTOR))))
_CALL = _struct(function=_struct(arguments=TEXT))
_CHOICE = _struct(message=_struct(content=TEXT, tool_calls=T.ArrayType(_CALL)))
RATING_RESPONSE = _struct(
    custom_id=TEXT, response=_struct(body=_struct(choices=T.ArrayType(_CHOICE))))

RATINGS = _struct(custom_id=TEXT, fluency=DOUBLE, flexibility=DOUBLE, originality=DOUBLE,
                  elaboration=DOUBLE, overall=DOUBLE)
LEDGER = _struct(seq=LONG, batch_id=TEXT, input_file_id=TEXT, input_file_name=TEXT, status=TEXT)
LEDGER_ENTRY = T.StructType([*LEDGER.fields, T.StructField("written_ns", LONG)])
SCORES = _struct(task_idx=INT, query_idx=INT, method=TEXT, arg_n=INT, score=DOUBLE)
