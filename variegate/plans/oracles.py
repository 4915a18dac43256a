"""The same results in SQL, for the queries that SQL can express."""

from __future__ import annotations

from variegate.functions.prompts import (CHAT_URL, EMBEDDING_URL, FUNCTION_NAME, INSTRUCTION,
                                         MAX_COMPLETION_TOKENS, RUBRIC, TOOL_CALL_MODEL)
from variegate.functions.significance import normal_quantile
from variegate.functions.words import STOP_WORDS
from variegate.plans.catalog import ATTEMPT_RULES, EMBEDDING_MODEL, MERGES

SPACE = (r"[\t\n\v\f\r \x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
         r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
QUOTES = "[«“‘„»”’]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {quoted(pattern)}, {replacement}, 'g')"


def lines(text: str) -> str:
    return f"list_filter(string_split({text}, chr(10)), lambda l: trim(l) <> '')"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda t: t <> '')"


def word_tokens(text: str) -> str:
    """Without look-around: a rule that would share a character runs twice."""
    marked = replace_all(text, r"""([^.\s])\.([\])}>"'»”’ ]*(?:\s|$))""", r"'\1 . \2'")
    for _ in range(2):
        marked = replace_all(marked, r"([:,])([^0-9]|$)", r"' \1 \2'")
    for pattern in (r"\.{2,}", r"--|[;@#$%&?!*\[\](){}<>]", f"{QUOTES}|`+"):
        marked = replace_all(marked, pattern, r"' \0 '")
    marked = replace_all(marked, r'(^|[\s(\[{<])"', r"'\1 `` '")
    marked = replace_all(marked, "''|\"", "' '' '".replace("''", "''''"))
    marked = replace_all(marked, r"(?i)([^'\s])('(?:ll|re|ve|s|m|d)?|n't)(\s|$)", r"'\1 \2\3'")
    for first, second in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"),
                          ("got", "ta"), ("lem", "me"), ("more", "'n"), ("wan", "na")):
        for _ in range(2):
            marked = replace_all(
                marked, rf"(?i)(^|{NOT_WORD})({first})({second})($|{NOT_WORD})",
                r"'\1\2 \3\4'")
    marked = replace_all(marked, rf"(?i)(^|\s)('t)(is|was)($|{NOT_WORD})", r"'\1\2 \3\4'")
    return tokens(marked)


def numbered(items: str, separator: str) -> str:
    return (f"array_to_string(list_transform({items}, lambda v, i: i || '. ' || v), "
            f"{separator})")


def items(text: str) -> str:
    joined = f"coalesce({text}, '')"
    for pattern, replacement in (
        (rf"\n{SPACE}+", "chr(10)"),
        ("-{3,}", "' '"),
        (rf"\n(\p{{Nd}}+[.:]){SPACE}+", r"'<<SPLIT>>\1'"),
        (r"\n", "' '"),
        (r"\*+", "' '"),
        (rf"{SPACE}+", "' '"),
    ):
        joined = replace_all(joined, pattern, replacement)
    after = quoted(rf"(?:^|{NOT_WORD})\p{{Nd}}+[.:]{SPACE}*(.*)")
    return (f"list_filter(list_transform(string_split({joined}, '<<SPLIT>>'), "
            f"lambda p: trim(regexp_extract(trim(p), {after}, 1))), lambda v: v <> '')")


def meaningful(text: str) -> str:
    plain = replace_all(f"lower({text})", r"[!-/:-@\[-`{-~]", "''")
    plain = replace_all(plain, f"({QUOTES})", r"' \1 '")
    for first, second in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"),
                          ("lem", "me"), ("wan", "na")):
        for _ in range(2):
            plain = replace_all(plain, rf"(^|{NOT_WORD}){first}{second}($|{NOT_WORD})",
                                rf"'\1{first} {second}\2'")
    stops = ", ".join(quoted(word) for word in STOP_WORDS["english"])
    return (f"list_filter({tokens(plain)}, lambda w: regexp_full_match(w, '\\p{{L}}+') "
            f"AND NOT list_contains([{stops}], w))")


ANSWERS = f"""
lined AS (SELECT lang, doc_id, {lines('text')} AS all_lines FROM documents),
answers AS (
  SELECT lang, doc_id, unnest(range(len(all_lines))) AS answer_idx, unnest(all_lines) AS answer
  FROM lined)"""

_RULES = ATTEMPT_RULES
_ITEM = f"len({meaningful('v')}) >= {_RULES['min_tokens']}"
CHECKED = f"""
raw AS (
  SELECT conv_id AS query_idx, turn AS attempt, text AS said,
         {numbered(lines('text'), 'chr(10)')} AS text
  FROM conversations WHERE role = 'assistant'),
listed AS (
  SELECT *, ends_with(said, '.') AS stopped, {items('text')} AS all_items
  FROM raw WHERE attempt < 20),
counted AS (
  SELECT *, CASE WHEN stopped THEN all_items ELSE all_items[:-2] END AS whole_items
  FROM listed),
checked AS (
  SELECT *, len(whole_items) >= {_RULES['min_items']}
    AND len(list_filter(whole_items[:{_RULES['max_items']}], lambda v: NOT {_ITEM})) = 0 AS ok
  FROM counted)"""

FIRST_OK = """
first_ok AS (
  SELECT query_idx, min(attempt) FILTER (WHERE ok) AS attempt FROM checked GROUP BY query_idx)"""

TASKS = """
tasks AS (
  SELECT conv_id AS query_idx, 'Reply to this turn: ' AS task_prompt,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'user'), '') AS query
  FROM conversations GROUP BY conv_id)"""

CONTEXT = TASKS + """,
context AS (
  SELECT query_idx, turn AS answer_idx, text AS answer, task_prompt, query
  FROM tasks JOIN conversations ON conv_id = query_idx WHERE role = 'assistant')"""

PROMPTS = CONTEXT + """,
answered AS (
  SELECT query_idx, list(answer ORDER BY answer_idx) FILTER (WHERE answer IS NOT NULL) AS said
  FROM context GROUP BY query_idx),
prompts AS (
  SELECT query_idx, coalesce(len(said), 0)::BIGINT AS n_answers, 'Question: ' || task_prompt
    || query || chr(10) || 'Answer: ' || coalesce(array_to_string(list_transform(
      said, lambda v, i: i || '. ' || v), ' '), '') AS prompt
  FROM tasks LEFT JOIN answered USING (query_idx))"""

EVENTS = """
ledger AS (
  SELECT event_id AS seq, 'batch_' || event_id AS batch_id, 'file_' || user_id AS input_file_id,
         'run_' || user_id || '.jsonl' AS input_file_name,
         CASE WHEN event_type = 'purchase' THEN 'completed' ELSE event_type END AS status
  FROM events)"""

RATINGS = """
ratings AS (
  SELECT doc_id, 'doc-' || doc_id AS custom_id, NOT (quality = 0 AND toxic = 1) AS is_complete,
         quality, toxic FROM labels)"""


def ledger_entries(choose: str, where: str = "true") -> str:
    columns = ", ".join(f"{choose}({c}, seq) AS {c}" for c in ("batch_id", "input_file_id",
                                                               "status"))
    return f"""WITH {EVENTS}
SELECT input_file_name, {choose}(seq, seq) AS seq, {columns}
FROM ledger WHERE {where} GROUP BY input_file_name"""


def first_vectors(n: int) -> str:
    return f"""
vectors AS (
  SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i
  FROM embeddings),
chosen AS (SELECT * FROM vectors WHERE i <= {n}),
sizes AS (SELECT label, count(*) AS n FROM chosen GROUP BY label),
cosines AS (
  SELECT a.label, a.i AS i, b.i AS j, greatest(list_cosine_similarity(
    a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS c
  FROM chosen a JOIN chosen b ON a.label = b.label AND a.i < b.i)"""


FIRST_TWO = f"""{first_vectors(2)},
spectrum AS (
  SELECT label, unnest([(1 + c) / 2, (1 - c) / 2]) AS l FROM cosines
  UNION ALL SELECT label, 1.0 FROM sizes WHERE n = 1),
scores AS (
  SELECT label, exp(-sum(CASE WHEN l > 1e-12 THEN l * ln(l) ELSE 0 END)) AS score
  FROM spectrum GROUP BY label)"""

FIRST_THREE = f"""{first_vectors(3)},
sums AS (
  SELECT label, sqrt(sum(c * c) / 3) AS r, product(c) AS p FROM cosines GROUP BY label),
angles AS (
  SELECT label, r, CASE WHEN r = 0 THEN 0
    ELSE acos(greatest(-1, least(1, p / (r * r * r)))) END AS phi FROM sums),
spectrum AS (
  SELECT label, unnest([(1 + 2 * r * cos(phi / 3)) / 3,
                        (1 + 2 * r * cos((phi + 2 * pi()) / 3)) / 3,
                        (1 + 2 * r * cos((phi + 4 * pi()) / 3)) / 3]) AS l FROM angles)"""


def self_bleu(source: str, keys: str, max_n: int) -> str:
    """``source`` is a CTE ``toks(keys, i, toks)``."""
    on_keys = " AND ".join(f"a.{key} = b.{key}" for key in keys.split(", "))
    a_keys = ", ".join(f"a.{key}" for key in keys.split(", "))
    return f"""WITH {source},
sized AS (SELECT *, len(toks) AS size FROM toks),
orders AS (SELECT unnest(range(1, {max_n + 1})) AS n),
starts AS (SELECT {keys}, i, toks, unnest(range(1, size + 1)) AS p, size FROM sized),
grams AS (
  SELECT {keys}, i, n, array_to_string(toks[p:p + n - 1], ' ') AS gram, count(*) AS c
  FROM starts, orders WHERE p + n - 1 <= size GROUP BY ALL),
tops AS (
  SELECT *, row_number() OVER w AS place, max(c) OVER w AS most, nth_value(c, 2) OVER w AS second
  FROM grams WINDOW w AS (PARTITION BY {keys}, n, gram ORDER BY c DESC, i
                          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
matched AS (
  SELECT {keys}, i, n,
    sum(least(c, CASE WHEN place = 1 THEN coalesce(second, 0) ELSE most END)) AS m
  FROM tops GROUP BY ALL),
precisions AS (
  SELECT {a_keys}, a.i, a.size,
    exp(sum(ln((CASE WHEN coalesce(b.m, 0) = 0 THEN 0.1 ELSE b.m END)
               / greatest(a.size - o.n + 1, 1))) / {max_n}) AS mean,
    coalesce(max(b.m) FILTER (WHERE o.n = 1), 0) AS words
  FROM sized a CROSS JOIN orders o
  LEFT JOIN matched b ON {on_keys} AND a.i = b.i AND o.n = b.n
  GROUP BY ALL),
nearest AS (
  SELECT {a_keys}, a.i, min(row(abs(a.size - b.size), b.size)) AS best
  FROM sized a JOIN sized b ON {on_keys} AND a.i <> b.i GROUP BY ALL),
answer_scores AS (
  SELECT {a_keys}, CASE WHEN b.best IS NULL OR a.words = 0 THEN 0
    WHEN a.size > b.best[2] THEN a.mean
    ELSE a.mean * exp(1 - b.best[2] / a.size) END AS score
  FROM precisions a LEFT JOIN nearest b ON {on_keys} AND a.i = b.i)"""


DOCUMENT_TOKENS = f"""{ANSWERS},
toks AS (SELECT lang, doc_id, answer_idx AS i, {tokens('lower(answer)')} AS toks FROM answers)"""

DOCUMENT_WORDS = f"""{ANSWERS},
toks AS (
  SELECT lang, doc_id, answer_idx AS i, {word_tokens('lower(answer)')} AS toks FROM answers)"""

CONVERSATION_TOKENS = f"""
toks AS (
  SELECT conv_id AS query_idx, turn AS i, {tokens('lower(text)')} AS toks
  FROM conversations WHERE role = 'assistant')"""

RATED = f"""
rated AS (
  SELECT d.lang, d.doc_id, l.quality AS y, len({lines('d.text')}) AS x,
         len({tokens('d.text')}) AS z
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
complete AS (SELECT * FROM rated WHERE y IS NOT NULL)"""


def ranks(by: str) -> str:
    def rank(value: str) -> str:
        group = f"PARTITION BY {by}" if by else ""
        same = f"PARTITION BY {by}, {value}" if by else f"PARTITION BY {value}"
        return (f"rank() OVER ({group} ORDER BY {value}) "
                f"+ (count(*) OVER ({same}) - 1) / 2 AS r{value}")
    columns = ", ".join(rank(value) for value in "xyz")
    return f"ranked AS (SELECT {by or '0 AS one'}, {columns} FROM complete)"


def p_value(rho: str, freedom: str) -> str:
    """Two-sided p, by Simpson's rule over the density of the correlation."""
    steps = 4000
    height = f"pow(1 - pow(abs({rho}) * k / {steps}, 2), ({freedom}) / 2.0 - 1)"
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    beta = f"exp(lgamma(0.5) + lgamma(({freedom}) / 2.0) - lgamma(({freedom} + 1) / 2.0))"
    return (f"(1 - 2 * (SELECT sum({weight} * {height}) FROM range({steps + 1}) g(k)) "
            f"* abs({rho}) / {steps} / 3 / {beta})")


def correlations(by: str) -> str:
    first = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    all_rows = (f"totals AS (SELECT {by or '0 AS one'}, count(*) AS n_all FROM rated {group})")
    join = f"USING ({by or 'one'})"
    return f"""WITH {RATED},
{ranks(by)},
{all_rows},
plain AS (
  SELECT {by or '0 AS one'}, count(*) AS m, corr(rx, ry) AS xy, corr(rx, rz) AS xz,
         corr(ry, rz) AS yz FROM ranked {group}),
both_rho AS (
  SELECT {first} n_all AS n, m, xy, (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) AS xyz
  FROM totals JOIN plain {join})"""


WHITE = (r"\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")


def merged_words(source: str) -> str:
    """``words(id, word)`` of the texts of ``source(id, text)``, and ``sizes(word, n)``, their tokens.

    Runs of white space and of other signs are taken apart first, as there is no look-ahead: a
    blank at the end of a run goes to the word behind it, another sign stands alone. Each step then
    joins the first pair of least rank in every word.
    """
    signs = quoted(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+")
    return f"""RECURSIVE
runs AS (
  SELECT id, regexp_extract_all(text, {quoted(f'[{WHITE}]+|[^{WHITE}]+')}) AS r FROM ({source})),
run AS (SELECT id, i, r[i] AS t, r[i - 1] AS before, i < len(r) AS inside,
    regexp_full_match(r[i], {quoted(f'[{WHITE}]+')}) AS blank
  FROM runs, unnest(range(1, len(r) + 1)) AS n(i)),
words AS (
  SELECT id, unnest(CASE
    WHEN NOT blank THEN regexp_extract_all(
      CASE WHEN i > 1 AND before[-1] = ' ' THEN ' ' ELSE '' END || t, {signs})
    WHEN NOT inside THEN [t]
    ELSE list_filter([t[:-2], CASE WHEN t[-1] = ' ' THEN '' ELSE t[-1] END], lambda x: x <> '')
    END) AS word FROM run),
ranks AS (
  SELECT hex(from_base64(token)) AS h, rank FROM read_csv({quoted(MERGES)}, delim = ' ',
    header = false, quote = '', escape = '', columns = {{'token': 'VARCHAR', 'rank': 'BIGINT'}})),
steps AS (
  SELECT DISTINCT word, regexp_extract_all(hex(encode(word)), '..') AS p FROM words
  UNION ALL
  SELECT word, list_concat(list_append(p[:i - 1], p[i] || p[i + 1]), p[i + 2:]) FROM (
    SELECT word, any_value(p) AS p, arg_min(i, rank * 1000000 + i) AS i
    FROM (SELECT word, p, i, p[i] || p[i + 1] AS h FROM steps, unnest(range(1, len(p))) AS n(i)) s
      JOIN ranks USING (h) GROUP BY word)),
sizes AS (SELECT word, min(len(p)) AS n FROM steps GROUP BY word)"""


_OPEN = r"""^[\[({<"'«“‘„]+"""
_CLOSE = r"""[\])}>"'»”’]*$"""
_BARE = replace_all("t", _OPEN + r"""|[\])}>"'»”’,;:!?]+$""", "''")
_ENDS = rf"(?:[^.]\.|[!?]){_CLOSE}"

BORDERS = f"""
texts AS (SELECT doc_id, {tokens('text')} AS ts FROM documents),
pairs AS (
  SELECT doc_id, i, ts[i] AS token, CASE WHEN i > 1 THEN ts[i - 1] END AS before,
    CASE WHEN i < len(ts) THEN ts[i + 1] END AS following
  FROM texts, unnest(range(1, len(ts) + 1)) AS n(i)),
cores AS (
  SELECT *, {_BARE.replace('(t,', '(token,')} AS core, {_BARE.replace('(t,', '(before,')} AS core_before,
    {_BARE.replace('(t,', '(following,')} AS core_following FROM pairs),
kinds AS (
  SELECT *, lower(regexp_replace(core, '\\.+$', '')) AS type,
    lower(regexp_replace(core_before, '\\.+$', '')) AS type_before,
    lower(regexp_replace(core_following, '\\.+$', '')) AS type_following,
    regexp_matches(core, '[^.]\\.$') AS stop, regexp_matches(core_before, '[^.]\\.$') AS stop_before,
    regexp_matches(token, {quoted(_ENDS)}) AS ends, regexp_matches(before, {quoted(_ENDS)}) AS ends_before
  FROM cores),
stops AS (
  SELECT type, count(*) FILTER (stop) AS n_stop, count(*) FILTER (NOT stop) AS n_plain,
    len(type) - len(replace(type, '.', '')) AS inner_stops FROM kinds GROUP BY type),
ratio AS (
  SELECT *, sum(n_stop) OVER ()::DOUBLE / sum(n_stop + n_plain) OVER ()::DOUBLE AS p,
    len(type) - inner_stops AS size FROM stops),
abbreviations AS (
  SELECT type, n_stop, n_plain, 2 * (n_stop * ln(0.99::DOUBLE) + n_plain * ln(1 - 0.99::DOUBLE)
      - n_stop * ln(p + 1e-8) - n_plain * ln(1 - p + 1e-8))
    * exp(-size) * (inner_stops + 1) * pow(size::DOUBLE, -n_plain) AS score
  FROM ratio WHERE n_stop > 0 AND regexp_matches(type, '\\p{{L}}')),
short AS (SELECT coalesce(list(type), []) AS a FROM abbreviations WHERE score >= 0.3)"""

STARTERS = f"""{BORDERS},
behind AS (
  SELECT type, count(*) FILTER (coalesce(ends_before
      AND NOT (list_contains(a, type_before) AND stop_before), false)) AS n_starts, count(*) AS n_all
  FROM kinds, short GROUP BY type),
shares AS (
  SELECT *, sum(n_starts) OVER ()::DOUBLE AS b, sum(n_all) OVER ()::DOUBLE AS n FROM behind),
chances AS (
  SELECT *, n_starts / b AS x, (n_all - n_starts) / (n - b) AS y, n_all / n AS m,
    b - n_starts AS rest, (n - b) - (n_all - n_starts) AS others FROM shares),
starters AS (
  SELECT type, n_starts, n_all, CASE WHEN x > m THEN 2 * (
      n_starts * ln(x + 1e-8) + rest * ln(1 - x + 1e-8)
      + (n_all - n_starts) * ln(y + 1e-8) + others * ln(1 - y + 1e-8)
      - n_starts * ln(m + 1e-8) - rest * ln(1 - m + 1e-8)
      - (n_all - n_starts) * ln(m + 1e-8) - others * ln(1 - m + 1e-8)) ELSE 0 END AS score
  FROM chances WHERE n_starts > 0 AND regexp_matches(type, '\\p{{L}}')),
first AS (SELECT coalesce(list(type), []) AS s FROM starters WHERE score >= 30)"""


ORACLES: dict[str, str] = {
    "diversity_first_two": f"WITH {FIRST_TWO} SELECT label::BIGINT AS label, "
                           "round(score, 6) AS score FROM scores",
    "diversity_first_three": f"""WITH {FIRST_THREE}
SELECT label::BIGINT AS label,
       round(exp(-sum(CASE WHEN l > 1e-12 THEN l * ln(l) ELSE 0 END)), 6) AS score
FROM spectrum GROUP BY label""",
    "cosine_profile": """
WITH cosines AS (
  SELECT a.label, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
sums AS (
  SELECT label, count(*) FILTER (WHERE c < 0) AS n_negative_pairs,
         round(avg(greatest(c, 0)), 6) AS mean_cosine FROM cosines GROUP BY label)
SELECT label::BIGINT AS label, count(embedding) AS n_items,
       count(*) - count(embedding) AS n_missing, any_value(n_negative_pairs) AS n_negative_pairs,
       any_value(mean_cosine) AS mean_cosine
FROM embeddings LEFT JOIN sums USING (label) GROUP BY label""",
    "spectrum_moments": """
WITH vectors AS (
  SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL),
cosines AS (
  SELECT a.label, a.vec_id AS i, b.vec_id AS j,
         CASE WHEN a.vec_id = b.vec_id THEN 1
              ELSE greatest(list_cosine_similarity(a.v, b.v), 0) END AS c
  FROM vectors a JOIN vectors b USING (label)),
sizes AS (SELECT label, count(*) AS n FROM vectors GROUP BY label),
squares AS (SELECT label, sum(c * c) AS s FROM cosines GROUP BY label),
paths AS (
  SELECT a.label, a.i, b.j AS k, sum(a.c * b.c) AS p
  FROM cosines a JOIN cosines b ON a.label = b.label AND a.j = b.i GROUP BY ALL),
cubes AS (
  SELECT p.label, sum(p.p * c.c) AS s FROM paths p JOIN cosines c
  ON p.label = c.label AND p.i = c.i AND p.k = c.j GROUP BY ALL)
SELECT label::BIGINT AS label, n AS n_items, round(q.s / (n * n), 9) AS sum_squares,
       round(c.s / (n * n * n), 9) AS sum_cubes
FROM sizes JOIN squares q USING (label) JOIN cubes c USING (label)""",
    "nested_vectors": """
WITH nested AS (
  SELECT label, flatten(list(embedding ORDER BY vec_id)) AS v, count(*) AS n
  FROM embeddings GROUP BY label)
SELECT label::BIGINT AS query_idx, n AS n_vectors, len(v)::BIGINT AS n_values,
       round(list_sum(list_transform(v, lambda x, i: x::DOUBLE * i)), 6) AS checksum
FROM nested""",
    "embeddings_from_responses": f"""
SELECT 'my-env' AS env, '{EMBEDDING_MODEL}' AS embedding_model, 'some/model' AS generation_model,
       false AS answer_only, 0::BIGINT AS task_idx, label::BIGINT AS query_idx,
       vec_id AS answer_idx, unnest(range(len(embedding))) AS place,
       round(unnest(embedding)::DOUBLE, 6) AS value FROM embeddings""",
    "pending_answers": """
SELECT label::BIGINT AS query_idx, vec_id AS answer_idx, vec_id::VARCHAR AS answer
FROM embeddings WHERE embedding[1] < 0""",
    "embedding_responses": """
SELECT 'my-env' AS env, label::BIGINT AS query_idx, vec_id AS answer_idx,
       len(embedding)::BIGINT AS dimensions, round(embedding[1]::DOUBLE, 6) AS first_value
FROM embeddings""",
    "extract_items_rendered": f"""
WITH found AS (
  SELECT doc_id, {items(numbered(lines('text'), 'chr(10)'))} AS all_items FROM documents)
SELECT doc_id, unnest(range(len(all_items))) AS item_idx, unnest(all_items) AS item
FROM found""",
    "extract_items_plain": f"""
WITH found AS (SELECT doc_id, {items('text')} AS all_items FROM documents)
SELECT doc_id, len(all_items)::BIGINT AS n_items,
       coalesce(array_to_string(all_items, '|'), '') AS items FROM found""",
    "meaningful_items": f"""
WITH {ANSWERS},
counted AS (SELECT doc_id, answer_idx, len({meaningful('answer')}) AS k FROM answers)
SELECT doc_id, answer_idx::BIGINT AS answer_idx, k::BIGINT AS n_tokens, k >= 3 AS is_meaningful
FROM counted""",
    "valid_attempts": f"""WITH {CHECKED}
SELECT query_idx, attempt, len(all_items)::BIGINT AS n_items, ok FROM checked""",
    "selected_replies": f"""WITH {CHECKED}, {FIRST_OK}
SELECT f.query_idx, f.attempt, c.text, coalesce(array_to_string(
         c.all_items[:{_RULES['max_items']}], '|'), '') AS items
FROM first_ok f LEFT JOIN checked c ON f.query_idx = c.query_idx AND f.attempt = c.attempt""",
    "selected_answers": f"""WITH {CHECKED}, {FIRST_OK},
chosen AS (
  SELECT f.query_idx, c.whole_items[:{_RULES['max_items']}] AS kept
  FROM first_ok f LEFT JOIN checked c ON f.query_idx = c.query_idx AND f.attempt = c.attempt),
filled AS (
  SELECT query_idx, CASE WHEN len(coalesce(kept, [])) = 0 THEN [NULL] ELSE kept END AS kept
  FROM chosen),
spread AS (
  SELECT query_idx, unnest(range(len(kept))) AS answer_idx, unnest(kept) AS answer FROM filled)
SELECT query_idx, CASE WHEN answer IS NOT NULL THEN answer_idx END AS answer_idx, answer
FROM spread""",
    "pending_queries": f"""WITH {CHECKED}, {TASKS}
SELECT query_idx, query FROM tasks
WHERE NOT EXISTS (SELECT 1 FROM checked c WHERE c.query_idx = tasks.query_idx AND c.ok)""",
    "attempt_log": f"""WITH {CHECKED}, {FIRST_OK}
SELECT c.query_idx, c.attempt, c.ok, len(c.all_items)::BIGINT AS n_items
FROM checked c JOIN first_ok f USING (query_idx)
WHERE f.attempt IS NULL OR c.attempt <= f.attempt""",
    "attempt_summary": f"""WITH {CHECKED}, {FIRST_OK}
SELECT c.attempt, count(*) FILTER (WHERE c.ok) AS n_ok, count(*) FILTER (WHERE NOT c.ok) AS n_failed
FROM checked c JOIN first_ok f USING (query_idx)
WHERE f.attempt IS NULL OR c.attempt <= f.attempt GROUP BY c.attempt""",
    "generation_messages": f"""WITH {TASKS},
instruction AS (SELECT {quoted(INSTRUCTION.format(count='5 '))} AS text)
SELECT query_idx, 'some/other' AS model, 0::BIGINT AS message_idx, 'system' AS role,
       text AS content FROM tasks, instruction
UNION ALL SELECT query_idx, 'some/other', 1, 'user', task_prompt || query FROM tasks
UNION ALL SELECT query_idx, 'some/Gemma-2', 0, 'user', text || chr(10) || task_prompt || query
FROM tasks, instruction""",
    "contextualized_text": f"""WITH {CONTEXT}
SELECT query_idx, answer_idx, 'Q: ' || task_prompt || ' ' || query || chr(10) || 'A: ' || answer
       AS text FROM context""",
    "judge_prompts": f"WITH {PROMPTS} SELECT * FROM prompts",
    "judge_prompt_joined": f"WITH {PROMPTS} SELECT query_idx, prompt FROM prompts",
    "judge_prompt_parts": f"""WITH {CONTEXT},
placed AS (
  SELECT query_idx, answer, row_number() OVER (PARTITION BY query_idx ORDER BY answer_idx) AS part
  FROM context WHERE answer IS NOT NULL)
SELECT query_idx, 0::BIGINT AS part,
       'Question: ' || task_prompt || query || chr(10) || 'Answer: ' AS text FROM tasks
UNION ALL
SELECT query_idx, part, CASE WHEN part = 1 THEN '' ELSE ' ' END || part || '. ' || answer
FROM placed""",
    "flattened_tasks": f"""WITH {TASKS}
SELECT 0::BIGINT AS task_idx, 'chat ' || query_idx // 100 AS task_name,
       'Chat' AS task_name_original, 'Reply: ' AS task_prompt,
       row_number() OVER (PARTITION BY query_idx // 100 ORDER BY query_idx) - 1 AS query_idx, query
FROM tasks""",
    "flattened_answers": """
WITH numbers AS (
  SELECT conv_id, conv_id // 100 AS number,
         row_number() OVER (PARTITION BY conv_id // 100 ORDER BY conv_id) - 1 AS query_idx
  FROM (SELECT DISTINCT conv_id FROM conversations)),
said AS (
  SELECT conv_id, text AS answer, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1
         AS answer_idx FROM conversations WHERE role = 'assistant')
SELECT number, 0::BIGINT AS task_idx, query_idx, answer_idx, answer
FROM numbers LEFT JOIN said USING (conv_id)""",
    "ratings_by_query": f"""WITH {RATINGS}
SELECT 0::BIGINT AS task_idx, doc_id AS query_idx,
       CASE WHEN is_complete THEN (quality + 1)::DOUBLE END AS fluency,
       CASE WHEN is_complete THEN (quality * 2 + toxic + 1)::DOUBLE END AS flexibility,
       CASE WHEN is_complete THEN (quality * 0.5 + 2)::DOUBLE END AS originality,
       CASE WHEN is_complete THEN (toxic + 2)::DOUBLE END AS elaboration,
       CASE WHEN is_complete THEN (quality + toxic + 1)::DOUBLE END AS overall, is_complete
FROM ratings JOIN documents USING (doc_id)""",
    "context_diversity_counts": f"""WITH {CONTEXT},
counts AS (
  SELECT query_idx, count(answer) AS n FROM tasks LEFT JOIN context USING (query_idx)
  GROUP BY query_idx)
SELECT 0::BIGINT AS task_idx, count(*) AS n_queries, count(*) FILTER (WHERE n = 0) AS n_empty,
       count(*) FILTER (WHERE n = 1) AS n_single FROM counts""",
    "embedding_requests": f"""WITH {CONTEXT}
SELECT 'my-env-0-' || query_idx || '-' || answer_idx AS custom_id, 'POST' AS method,
       '{EMBEDDING_URL}' AS url, '{EMBEDDING_MODEL}' AS model,
       'Q: ' || task_prompt || ' ' || query || chr(10) || 'A: ' || answer AS input, answer_idx
FROM context""",
    "rating_requests": f"""WITH {PROMPTS},
models AS (SELECT unnest(['{TOOL_CALL_MODEL}', 'gpt-4.1']) AS model)
SELECT 'chat-' || query_idx AS custom_id, query_idx, 'POST' AS method, '{CHAT_URL}' AS url, model,
       'system' AS first_role, {len(RUBRIC)}::BIGINT AS rubric_length, prompt AS question,
       CASE WHEN model = '{TOOL_CALL_MODEL}' THEN '{FUNCTION_NAME}' END AS forced_tool,
       CASE WHEN model <> '{TOOL_CALL_MODEL}' THEN {MAX_COMPLETION_TOKENS}::BIGINT END AS max_tokens,
       CASE WHEN model <> '{TOOL_CALL_MODEL}' THEN 'true' END AS strict
FROM prompts, models""",
    "parsed_ratings": f"""WITH {RATINGS}
SELECT custom_id, CASE WHEN is_complete THEN (quality + 1)::DOUBLE END AS fluency,
       CASE WHEN is_complete THEN (quality * 2 + toxic + 1)::DOUBLE END AS flexibility,
       CASE WHEN is_complete THEN (quality * 0.5 + 2)::DOUBLE END AS originality,
       CASE WHEN is_complete THEN (toxic + 2)::DOUBLE END AS elaboration,
       CASE WHEN is_complete THEN (quality + toxic + 1)::DOUBLE END AS overall, is_complete
FROM ratings""",
    "unanswered_requests": f"""WITH {RATINGS}
SELECT 'doc-' || d.doc_id AS custom_id, d.lang,
       CASE WHEN is_complete THEN (quality + toxic + 1)::DOUBLE END AS overall,
       r.doc_id IS NOT NULL AS is_answered
FROM documents d LEFT JOIN ratings r ON d.doc_id = r.doc_id""",
    "ledger_first_entries": ledger_entries("arg_min"),
    "ledger_latest_entries": ledger_entries("arg_max"),
    "completed_batches": f"SELECT * FROM ({ledger_entries('arg_min')}) WHERE status = 'completed'",
    "answer_counts": f"""WITH {ANSWERS}
SELECT lang, doc_id, len(all_lines)::BIGINT AS n_answers FROM lined""",
    "answer_length": f"""WITH {ANSWERS}
SELECT d.lang, d.doc_id, round(avg(len({tokens('answer')})), 6) AS answer_length
FROM documents d LEFT JOIN answers a USING (doc_id) GROUP BY 1, 2""",
    "answer_length_words": f"""WITH {ANSWERS}
SELECT d.lang, d.doc_id, round(avg(len({word_tokens('answer')})), 6) AS answer_length
FROM documents d LEFT JOIN answers a USING (doc_id) GROUP BY 1, 2""",
    "self_bleu_conversations": self_bleu(CONVERSATION_TOKENS, "query_idx", 4) + """
SELECT query_idx, round(avg(score), 6) AS score FROM answer_scores GROUP BY query_idx""",
    "self_bleu_documents": self_bleu(DOCUMENT_TOKENS, "lang, doc_id", 4) + """
SELECT lang, doc_id, round(avg(score), 6) AS score FROM answer_scores GROUP BY lang, doc_id""",
    "self_bleu_words": self_bleu(DOCUMENT_WORDS, "lang, doc_id", 2) + """
SELECT lang, doc_id, 'self_bleu' AS method, 2::BIGINT AS arg_n, round(avg(score), 6) AS score
FROM answer_scores GROUP BY lang, doc_id""",
    "scores_in_sql": self_bleu(DOCUMENT_TOKENS, "lang, doc_id", 2) + """
SELECT lang, doc_id, 'self_bleu' AS method, 2::BIGINT AS arg_n, round(avg(score), 6) AS score
FROM answer_scores GROUP BY lang, doc_id""",
    "hashed_embedding_size": f"""WITH {ANSWERS}
SELECT doc_id, answer_idx::BIGINT AS answer_idx, 256::BIGINT AS dimensions,
       greatest(2 * len({tokens('answer')}) - 1, 0)::BIGINT AS n_features FROM answers""",
    "mean_ci_documents": f"""
SELECT lang, grouping(lang) > 0 AS is_total, count(*) AS n, round(avg(n_chars), 6) AS mean,
       round({normal_quantile(0.95)!r} * stddev_samp(n_chars) / sqrt(count(*)), 6) AS margin
FROM documents GROUP BY GROUPING SETS ((lang), ())""",
    "spearman_by_language": correlations("lang") + f"""
SELECT lang, n, m AS n_used, round(xy, 6) AS rho, round({p_value('xy', 'm - 2')}, 6) AS p
FROM both_rho""",
    "partial_spearman_total": correlations("") + f"""
SELECT n, m AS n_used, round(xyz, 6) AS rho, round({p_value('xyz', 'm - 3')}, 6) AS p
FROM both_rho""",
    "correlation_report": correlations("lang") + f"""
SELECT lang, 'n_lines' AS score, 'quality' AS rating, round(xy, 6) AS zero_order_rho,
       round({p_value('xy', 'm - 2')}, 6) AS zero_order_p, round(xyz, 6) AS partial_rho,
       round({p_value('xyz', 'm - 3')}, 6) AS partial_p, n, m AS n_used,
       round(xyz - xy, 6) AS change,
       round(CASE WHEN xy = 0 THEN 0 ELSE (xyz - xy) / abs(xy) * 100 END, 3) AS change_percent
FROM both_rho""",
    "assembled_scores": f"""WITH {ANSWERS},
sums AS (
  SELECT doc_id, count(answer) AS n_answers, avg(len({tokens('answer')})) AS answer_length
  FROM documents LEFT JOIN answers USING (doc_id) GROUP BY doc_id)
SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic, n_answers,
       round(answer_length, 6) AS answer_length
FROM sums FULL JOIN labels USING (doc_id)""",
    "answer_length_tokens": f"""WITH {merged_words(
        "SELECT doc_id || ':' || i AS id, l[i] AS text FROM (SELECT doc_id, "
        + lines('text') + " AS l FROM documents), unnest(range(1, len(l) + 1)) AS n(i)")},
totals AS (
  SELECT split_part(id, ':', 1)::BIGINT AS doc_id, sum(n) AS n FROM words JOIN sizes USING (word)
  GROUP BY 1)
SELECT lang, doc_id, round(n / len({lines('text')}), 6) AS answer_length
FROM documents LEFT JOIN totals USING (doc_id)""",
    "token_counts_documents": f"""WITH {merged_words("SELECT doc_id AS id, text FROM documents")},
totals AS (SELECT id AS doc_id, sum(n) AS n FROM words JOIN sizes USING (word) GROUP BY 1)
SELECT doc_id, count(text)::BIGINT AS n_texts, coalesce(any_value(n), 0)::BIGINT AS n_tokens
FROM documents LEFT JOIN totals USING (doc_id) GROUP BY doc_id""",
    "abbreviation_statistics": f"""WITH {BORDERS}
SELECT type, n_stop, n_plain, round(score, 6) + 0.0 AS score, score >= 0.3 AS is_abbreviation
FROM abbreviations""",
    "sentence_starters": f"""WITH {STARTERS}
SELECT type, n_starts, n_all, round(score, 4) AS score, score >= 30 AS is_starter FROM starters""",
    "sentence_counts": f"""WITH {STARTERS},
judged AS (
  SELECT doc_id, i, token, ends, stop AND ends AND list_contains(a, type) AND following IS NOT NULL
    AND NOT (regexp_matches(following, {quoted('(?:' + _OPEN + r')?\p{Lu}')})
      AND list_contains(s, type_following)) AS held
  FROM kinds, short, first),
texts_held AS (
  SELECT doc_id, count(*) FILTER (ends AND NOT held)
      + (NOT coalesce(arg_max(ends AND NOT held, i), true))::INT AS n_sentences,
    string_agg(CASE WHEN held THEN regexp_replace(token, {quoted(r"\.(" + _CLOSE + ")")}, '_\1')
      ELSE token END, ' ' ORDER BY i) AS text
  FROM judged GROUP BY doc_id)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences,
  coalesce(len({word_tokens('h.text')}), 0)::BIGINT AS n_tokens
FROM documents LEFT JOIN texts_held h USING (doc_id)""",
    "exported_answers": """
WITH said AS (
  SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
listed AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS n
  FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT 0::BIGINT AS task_idx, n::BIGINT AS query_idx,
  CASE WHEN turn IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 END
    ::BIGINT AS answer_idx, text AS answer
FROM listed LEFT JOIN said USING (conv_id)""",
}
