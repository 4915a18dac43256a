"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from variegate.functions import lists, words
from variegate.functions.prompts import split_answer_id, split_query_id
from variegate.functions.ratings import rating_columns
from variegate.operators import (dense_embed, diversity, embed, ledger, replies, scoring, sentences, statistics,
                                 tasks)
from variegate.functions.byte_pairs import read_ranks
from variegate.operators.compression_distance import compression_distance
from variegate.operators.score_table import register_score_table
from variegate.operators.self_bleu import self_bleu
from variegate.operators.token_counts import answer_length_tokens as mean_tokens, token_totals
from variegate.plans import corpus, reports
from variegate.plans.corpus import DOCUMENT_KEYS, table
from variegate.session import shared_folder
from variegate.sources import readers, schemas, writers

Query = Callable[[SparkSession, str], DataFrame]

EMBEDDING_MODEL = "hashed-words"
MERGES = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # a public merge list; only the driver reads it
ATTEMPT_RULES = {"min_items": 2, "max_items": 8, "min_tokens": 3}


def six(name: str, column: Column | None = None) -> Column:
    return F.round(F.col(name) if column is None else column, 6).alias(name)


def long(name: str, column: Column | None = None) -> Column:
    return (F.col(name) if column is None else column).cast("long").alias(name)


# Diversity of vectors

def diversity_by_label(spark: SparkSession, folder: str) -> DataFrame:
    profile = diversity.diversity_profile(
        table(spark, folder, "embeddings"), ["label"], order="vec_id")
    return profile.select(long("label"), six("score"), six("entropy"), "n_items")


def _first_vectors(spark: SparkSession, folder: str, n: int) -> DataFrame:
    return diversity.diversity_score(
        table(spark, folder, "embeddings"), ["label"], order="vec_id", max_items=n) \
        .select(long("label"), six("score"))


def diversity_first_two(spark: SparkSession, folder: str) -> DataFrame:
    return _first_vectors(spark, folder, 2)


def diversity_first_three(spark: SparkSession, folder: str) -> DataFrame:
    return _first_vectors(spark, folder, 3)


def cosine_profile(spark: SparkSession, folder: str) -> DataFrame:
    profile = diversity.diversity_profile(
        table(spark, folder, "embeddings"), ["label"], order="vec_id",
        wanted=["n_items", "n_missing", "n_negative_pairs", "mean_cosine"])
    return profile.select(long("label"), "n_items", "n_missing", "n_negative_pairs",
                          six("mean_cosine"))


def spectrum_moments(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of squares and cubes of all eigenvalues, over all vectors."""
    profile = diversity.diversity_profile(
        table(spark, folder, "embeddings"), ["label"], order="vec_id",
        wanted=["n_items", "sum_squares", "sum_cubes"])
    return profile.select(long("label"), "n_items", *[
        F.round(name, 9).alias(name) for name in ("sum_squares", "sum_cubes")])


def diversity_summary(spark: SparkSession, folder: str) -> DataFrame:
    scores = diversity.diversity_score(
        table(spark, folder, "embeddings"), ["label"], order="vec_id")
    return statistics.mean_ci(scores, "score", ["label"]).select(
        long("label"), "is_total", "n", six("mean"), six("margin"))


def nested_vectors(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.vector_answers(table(spark, folder, "embeddings"))
    nested = tasks.nest(answers, "embedding")
    values = F.flatten("items")
    # each value times its place, which no other order of the values gives
    products = F.transform(values, lambda v, i: v.cast("double") * (i + 1))
    return nested.select(long("query_idx"), long("n_vectors", F.size("items")),
                         long("n_values", F.size(values)),
                         six("checksum", F.aggregate(products, F.lit(0.0), lambda a, v: a + v)))


def pending_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors with a negative first value are taken as not made yet."""
    answers = corpus.vector_answers(table(spark, folder, "embeddings")) \
        .withColumn("answer", F.col("answer_idx").cast("string"))
    made = answers.withColumn("embedding", F.when(F.col("embedding")[0] >= 0, F.col("embedding")))
    return tasks.pending_answers(answers, made).select(
        long("query_idx"), long("answer_idx"), "answer")


def embedding_responses(spark: SparkSession, folder: str) -> DataFrame:
    lines = corpus.vector_response_lines(table(spark, folder, "embeddings"))
    parsed = lines.select(F.from_json("value", schemas.EMBEDDING_RESPONSE).alias("r")).select(
        split_answer_id(F.col("r.custom_id")).alias("key"),
        readers.first_embedding(F.col("r.response")).cast("array<float>").alias("embedding"))
    return parsed.select("key.env", long("query_idx", F.col("key.query_idx")),
                         long("answer_idx", F.col("key.answer_idx")),
                         long("dimensions", F.size("embedding")),
                         six("first_value", F.col("embedding")[0].cast("double")))


def embeddings_from_responses(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the embeddings table that responses make up."""
    lines = corpus.vector_response_lines(table(spark, folder, "embeddings"))
    parsed = lines.select(F.from_json("value", schemas.EMBEDDING_RESPONSE).alias("r")).select(
        "r.custom_id", readers.first_embedding(F.col("r.response")).alias("embedding"))
    made = tasks.embeddings_from_responses(parsed, EMBEDDING_MODEL, "some/model")
    return made.select("env", "embedding_model", "generation_model", "answer_only",
                       long("task_idx"), long("query_idx"), long("answer_idx"),
                       F.posexplode("embedding").alias("place", "value")) \
        .withColumn("place", long("place")).withColumn("value", six("value", F.col("value").cast("double")))


# Lists and replies

def extract_items_rendered(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    numbered = documents.select("doc_id", corpus.numbered_lines(F.col("text")).alias("text"))
    return numbered.select("doc_id", F.posexplode(lists.extract_items(F.col("text")))
                           .alias("item_idx", "item")) \
        .select("doc_id", long("item_idx"), "item")


def extract_items_plain(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    items = documents.select("doc_id", lists.extract_items(F.col("text")).alias("items"))
    return items.select("doc_id", long("n_items", F.size("items")),
                        F.array_join("items", "|").alias("items"))


def meaningful_items(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents"))
    counted = answers.select("doc_id", long("answer_idx"), long(
        "n_tokens", F.size(words.meaningful_tokens(F.col("answer")))))
    return counted.withColumn("is_meaningful", F.col("n_tokens") >= ATTEMPT_RULES["min_tokens"])


def _checked(spark: SparkSession, folder: str) -> DataFrame:
    attempts = corpus.conversation_attempts(table(spark, folder, "conversations"))
    return replies.check_attempts(attempts, **ATTEMPT_RULES)


def valid_attempts(spark: SparkSession, folder: str) -> DataFrame:
    return _checked(spark, folder).select(
        long("query_idx"), long("attempt"), long("n_items", F.size("items")), "ok")


def selected_replies(spark: SparkSession, folder: str) -> DataFrame:
    chosen = replies.select_replies(_checked(spark, folder), ATTEMPT_RULES["max_items"])
    return chosen.select(long("query_idx"), long("attempt"), "text",
                         F.array_join("items", "|").alias("items"))


def selected_answers(spark: SparkSession, folder: str) -> DataFrame:
    chosen = replies.select_replies(_checked(spark, folder), ATTEMPT_RULES["max_items"],
                                    drop_truncated=True)
    return replies.answers_of(chosen).select(long("query_idx"), long("answer_idx"), "answer")


def pending_queries(spark: SparkSession, folder: str) -> DataFrame:
    asked = corpus.conversation_tasks(table(spark, folder, "conversations"))
    return replies.pending_queries(asked, _checked(spark, folder)).select(
        long("query_idx"), "query")


def attempt_log(spark: SparkSession, folder: str) -> DataFrame:
    return replies.attempt_log(_checked(spark, folder)).select(
        long("query_idx"), long("attempt"), "ok", long("n_items", F.size("parsed_answer")))


def attempt_summary(spark: SparkSession, folder: str) -> DataFrame:
    return replies.attempt_summary(replies.attempt_log(_checked(spark, folder))).select(
        long("attempt"), "n_ok", "n_failed")


# Prompts, requests and responses

def generation_messages(spark: SparkSession, folder: str) -> DataFrame:
    asked = corpus.conversation_tasks(table(spark, folder, "conversations"))
    both = [tasks.generation_messages(asked, model, 5).withColumn("model", F.lit(model))
            for model in ("some/Gemma-2", "some/other")]
    return both[0].unionByName(both[1]).select(
        long("query_idx"), "model", F.posexplode("messages").alias("message_idx", "message")) \
        .select("query_idx", "model", long("message_idx"), "message.role", "message.content")


def _context(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return tasks.with_task_context(corpus.conversation_tasks(conversations),
                                   corpus.conversation_answers(conversations))


def contextualized_text(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.contextualize(_context(spark, folder)).select(
        long("query_idx"), long("answer_idx"), "text")


def _prompts(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return tasks.judge_prompts(corpus.conversation_tasks(conversations),
                               corpus.conversation_answers(conversations))


def judge_prompts(spark: SparkSession, folder: str) -> DataFrame:
    return _prompts(spark, folder).select(long("query_idx"), "n_answers", "prompt")


def judge_prompt_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts put together from their parts."""
    parts = F.sort_array(F.collect_list(F.struct("part", "text")))
    return judge_prompt_parts(spark, folder).groupBy("query_idx").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("prompt"))


def judge_prompt_parts(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    return tasks.judge_prompt_parts(corpus.conversation_tasks(conversations),
                                    corpus.conversation_answers(conversations)) \
        .select(long("query_idx"), long("part"), "text")


def flattened_tasks(spark: SparkSession, folder: str) -> DataFrame:
    documents = corpus.task_document(table(spark, folder, "conversations"))
    parsed = readers.parsed_documents(documents, "value", schemas.TASK_SET_JSON, ["number"])
    flat = readers.flatten_tasks(parsed)
    return flat.select(long("task_idx"), "task_name", "task_name_original", "task_prompt",
                       long("query_idx"), "query")


def flattened_answers(spark: SparkSession, folder: str) -> DataFrame:
    documents = corpus.answer_document(table(spark, folder, "conversations"))
    parsed = readers.parsed_documents(documents, "value", schemas.ANSWERS_JSON, ["number"])
    flat = readers.flatten_answers(parsed, keep=["number"])
    return flat.select(long("number"), long("task_idx"), long("query_idx"), long("answer_idx"),
                       "answer")


def exported_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Replies of all conversations, written as one nested array in parts and read again."""
    conversations = table(spark, folder, "conversations")
    listed = corpus.conversation_tasks(conversations).select(*schemas.QUERY_KEYS)
    answers = listed.join(corpus.conversation_answers(conversations), schemas.QUERY_KEYS, "left")
    path = shared_folder(spark, "answers") + ".json"
    writers.write_nested_answers(answers, path)
    return readers.read_answers(spark, path).select(
        long("task_idx"), long("query_idx"), long("answer_idx"), "answer")


def embedding_requests(spark: SparkSession, folder: str) -> DataFrame:
    texts = tasks.contextualize(_context(spark, folder))
    requests = tasks.embedding_requests(texts, "my-env", EMBEDDING_MODEL)
    return requests.select(
        "custom_id", "method", "url", F.col("body.model").alias("model"),
        F.col("body.input").alias("input"),
        long("answer_idx", split_answer_id(F.col("custom_id"))["answer_idx"]))


def rating_requests(spark: SparkSession, folder: str) -> DataFrame:
    prompts = _prompts(spark, folder)
    both = [tasks.rating_requests(prompts, model) for model in ("gpt-4-0613", "gpt-4.1")]
    body = lambda path: F.get_json_object("body", path)
    return both[0].unionByName(both[1]).select(
        "custom_id", long("query_idx", split_query_id(F.col("custom_id"))["query_idx"]),
        "method", "url", body("$.model").alias("model"),
        body("$.messages[0].role").alias("first_role"),
        long("rubric_length", F.length(body("$.messages[0].content"))),
        body("$.messages[1].content").alias("question"),
        body("$.tool_choice.function.name").alias("forced_tool"),
        long("max_tokens", body("$.max_completion_tokens")),
        body("$.response_format.json_schema.strict").alias("strict"))


def parsed_ratings(spark: SparkSession, folder: str) -> DataFrame:
    lines = corpus.label_response_lines(table(spark, folder, "labels"))
    responses = lines.select(F.from_json("value", schemas.RATING_RESPONSE).alias("r"))
    return responses.select("r.custom_id", *rating_columns(
        readers.first_message(F.col("r.response"))))


def ratings_by_query(spark: SparkSession, folder: str) -> DataFrame:
    """Ratings of documents, whose task is named ``doc``, with the keys of their query."""
    asked = table(spark, folder, "documents").select(
        F.lit("doc").alias("task_name"), F.lit(0).alias("task_idx"),
        F.col("doc_id").cast("int").alias("query_idx"))
    found = tasks.ratings_by_query(parsed_ratings(spark, folder), asked)
    return found.withColumn("task_idx", long("task_idx")) \
        .withColumn("query_idx", long("query_idx"))


def unanswered_requests(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is asked for a rating, labelled ones have been answered."""
    custom_id = F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("custom_id")
    requests = table(spark, folder, "documents").select(custom_id, "lang")
    responses = parsed_ratings(spark, folder).select("custom_id", "overall")
    return tasks.correlate_responses(requests, responses)


def ledger_first_entries(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.pick_batches(corpus.event_ledger(table(spark, folder, "events")))


def ledger_latest_entries(spark: SparkSession, folder: str) -> DataFrame:
    return ledger.pick_batches(corpus.event_ledger(table(spark, folder, "events")), "latest")


def completed_batches(spark: SparkSession, folder: str) -> DataFrame:
    batches = ledger.pick_batches(corpus.event_ledger(table(spark, folder, "events")))
    return ledger.completed_batches(batches)


# Answers and scores of texts

def answer_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.answer_counts(corpus.document_answers(table(spark, folder, "documents")),
                               DOCUMENT_KEYS)


def answer_length(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.answer_length(corpus.document_answers(table(spark, folder, "documents")),
                               DOCUMENT_KEYS, words.whitespace_tokens) \
        .select(*DOCUMENT_KEYS, six("answer_length"))


def answer_length_words(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.answer_length(corpus.document_answers(table(spark, folder, "documents")),
                               DOCUMENT_KEYS).select(*DOCUMENT_KEYS, six("answer_length"))


def answer_length_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return mean_tokens(corpus.document_answers(table(spark, folder, "documents")), read_ranks(MERGES),
                       DOCUMENT_KEYS).select(*DOCUMENT_KEYS, six("answer_length"))


def token_counts_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each whole document."""
    return token_totals(table(spark, folder, "documents"), ["doc_id"], "text", read_ranks(MERGES))


def abbreviation_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = sentences.abbreviation_statistics(table(spark, folder, "documents"), "text")
    return found.select("type", "n_stop", "n_plain", six("score"),
                        (F.col("score") >= sentences.ABBREVIATION).alias("is_abbreviation"))


def sentence_starters(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    model = sentences.fit_sentences(documents, "text")
    found = sentences.starter_statistics(documents, "text", model.abbreviations)
    return found.select("type", "n_starts", "n_all", F.round("score", 4).alias("score"),
                        (F.col("score") >= sentences.STARTER).alias("is_starter"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences and words of each document, by borders learned from all documents."""
    documents = table(spark, folder, "documents")
    model = sentences.fit_sentences(documents, "text")
    return documents.select(
        "doc_id", long("n_sentences", F.size(sentences.sentences(F.col("text"), model))),
        long("n_tokens", F.size(sentences.trained_tokens(F.col("text"), model))))


def self_bleu_conversations(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.conversation_answers(table(spark, folder, "conversations"))
    return self_bleu(answers, ["query_idx"], tokenizer=words.whitespace_tokens) \
        .select(long("query_idx"), six("score"))


def self_bleu_documents(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents"))
    return self_bleu(answers, DOCUMENT_KEYS, tokenizer=words.whitespace_tokens) \
        .select(*DOCUMENT_KEYS, six("score"))


def self_bleu_words(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents"))
    return scoring.score(answers, DOCUMENT_KEYS, "self_bleu", 2) \
        .select(*DOCUMENT_KEYS, "method", long("arg_n"), six("score"))


def compression_distance_documents(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents"))
    return compression_distance(answers, DOCUMENT_KEYS).select(*DOCUMENT_KEYS, six("score"))


def hashed_embedding_size(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents")) \
        .where(F.col("answer").isNotNull())
    vectors = embed.hashed_embedding(answers, "answer")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return vectors.select("doc_id", long("answer_idx"), long("dimensions", F.size("embedding")),
                          long("n_features", total))


def scores_in_sql(spark: SparkSession, folder: str) -> DataFrame:
    """Self-BLEU of each document's lines by the table function, in a statement."""
    register_score_table(spark)
    answers = corpus.document_answers(table(spark, folder, "documents"))
    found = spark.sql("SELECT * FROM score(TABLE({answers}) PARTITION BY (lang, doc_id), 'self_bleu', 2)",
                      answers=answers)
    return found.select(*DOCUMENT_KEYS, "method", long("arg_n"), six("score"))


def diversity_documents(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents"))
    present = answers.where(F.col("answer").isNotNull())
    return diversity.diversity_score(
        present, DOCUMENT_KEYS, queries=answers, text="answer",
        embed=lambda rows: embed.hashed_embedding(rows, "answer")) \
        .select(*DOCUMENT_KEYS, six("score"))


def diversity_dense_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Diversity of each document's lines by vectors learned from all lines, negative cosines and all."""
    answers = corpus.document_answers(table(spark, folder, "documents"))
    present = answers.where(F.col("answer").isNotNull())
    model = dense_embed.fit_dense(present, "answer", dimensions=16, features=4096, rounds=4)
    scores = diversity.diversity_score(
        present, DOCUMENT_KEYS, queries=answers, text="answer",
        embed=lambda rows: dense_embed.dense_embedding(rows, model, "answer"))
    return scores.select(*DOCUMENT_KEYS, six("score"))


def context_diversity(spark: SparkSession, folder: str) -> DataFrame:
    """Diversity of each conversation's replies, each read with the turn that asked for them."""
    conversations = table(spark, folder, "conversations")
    scores = reports.context_diversity(corpus.conversation_tasks(conversations),
                                       corpus.conversation_answers(conversations))
    return scores.select(long("task_idx"), long("query_idx"), six("score"))


def context_diversity_summary(spark: SparkSession, folder: str) -> DataFrame:
    scores = context_diversity(spark, folder)
    return statistics.mean_ci(scores, "score", ["task_idx"]).select(
        long("task_idx"), "is_total", "n", six("mean"), six("margin"))


def context_diversity_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Queries, those scored 0, and those scored 1, whose answers are none and all alike."""
    scores = context_diversity(spark, folder)
    return scores.groupBy("task_idx").agg(
        F.count("score").alias("n_queries"),
        F.count(F.when(F.col("score") == 0, 1)).alias("n_empty"),
        F.count(F.when(F.col("score") == 1, 1)).alias("n_single"))


# Statistics

def mean_ci_documents(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "documents").select(
        "lang", F.col("n_chars").cast("double").alias("score"))
    return statistics.mean_ci(sizes, "score", ["lang"]).select(
        "lang", "is_total", "n", six("mean"), six("margin"))


def _rated(spark: SparkSession, folder: str) -> DataFrame:
    """Length, line count and rating of each document; the rating is missing for many."""
    documents = table(spark, folder, "documents").select(
        *DOCUMENT_KEYS, "n_chars", F.size(corpus.lines(F.col("text"))).alias("n_lines"),
        F.size(words.whitespace_tokens(F.col("text"))).alias("n_words"))
    return documents.join(table(spark, folder, "labels").select("doc_id", "quality"),
                          "doc_id", "left")


def spearman_by_language(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.spearman(_rated(spark, folder), "quality", "n_lines", ["lang"]).select(
        "lang", "n", "n_used", six("rho"), six("p"))


def partial_spearman_total(spark: SparkSession, folder: str) -> DataFrame:
    return statistics.partial_spearman(_rated(spark, folder), "quality", "n_lines",
                                       "n_words").select("n", "n_used", six("rho"), six("p"))


def correlation_report(spark: SparkSession, folder: str) -> DataFrame:
    report = statistics.correlation_report(_rated(spark, folder), ["n_lines"], ["quality"],
                                           "n_words", ["lang"])
    return report.select("lang", "score", "rating", *[six(c) for c in (
        "zero_order_rho", "zero_order_p", "partial_rho", "partial_p")], "n", "n_used",
        six("change"), F.round("change_percent", 3).alias("change_percent"))


def assembled_scores(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents"))
    ratings = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    counts = tasks.answer_counts(answers, ["doc_id"])
    lengths = tasks.answer_length(answers, ["doc_id"], words.whitespace_tokens)
    return tasks.assemble_scores(ratings, counts, lengths, keys=["doc_id"]).select(
        "doc_id", long("quality"), long("toxic"), "n_answers", six("answer_length"))


def score_summary(spark: SparkSession, folder: str) -> DataFrame:
    answers = corpus.document_answers(table(spark, folder, "documents"))
    scores = reports.score_answers(answers, DOCUMENT_KEYS)
    return reports.score_summary(scores, "lang").select(
        "method", "lang", "is_total", "n", six("mean"), six("margin"))


def score_rating_report(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: three scores of every document, related to its rating by language."""
    documents = table(spark, folder, "documents")
    ratings = documents.select(*DOCUMENT_KEYS).join(table(spark, folder, "labels"), "doc_id")
    return reports.score_rating_report(
        corpus.document_answers(documents), ratings, DOCUMENT_KEYS, "quality", ["lang"])


QUERIES: dict[str, Query] = {query.__name__: query for query in (
    diversity_by_label, diversity_first_two, diversity_first_three, cosine_profile,
    spectrum_moments, diversity_summary, nested_vectors, embeddings_from_responses,
    pending_answers, embedding_responses,
    extract_items_rendered, extract_items_plain, meaningful_items, valid_attempts,
    selected_replies, selected_answers, pending_queries, attempt_log, attempt_summary,
    generation_messages, contextualized_text, judge_prompts, judge_prompt_parts,
    judge_prompt_joined, flattened_tasks, flattened_answers, exported_answers, ratings_by_query,
    embedding_requests, rating_requests, parsed_ratings, unanswered_requests,
    ledger_first_entries, ledger_latest_entries, completed_batches, answer_counts,
    answer_length, answer_length_words, answer_length_tokens, token_counts_documents,
    abbreviation_statistics, sentence_starters, sentence_counts, self_bleu_conversations, self_bleu_documents,
    self_bleu_words, scores_in_sql, compression_distance_documents, hashed_embedding_size,
    diversity_documents, diversity_dense_documents, context_diversity, context_diversity_summary,
    context_diversity_counts, mean_ci_documents, spearman_by_language, partial_spearman_total,
    correlation_report, assembled_scores, score_summary, score_rating_report)}
