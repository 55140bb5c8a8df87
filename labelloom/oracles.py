"""DuckDB SQL for the registered queries, written apart from the operators."""

from __future__ import annotations

from labelloom.functions.wording import (
    CHAT,
    FAULT_LINE,
    LABEL_NAMES,
    LONG,
    MISSING_MARKERS,
    NORMAL_LINE,
    SHORT,
    SYSTEM,
    UNKNOWN_NAME,
)
from labelloom.queries import DOCUMENT_SCORER


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_CONTRACTS = """
contracts AS (
  SELECT doc_id, concat('doc_', CAST(doc_id AS VARCHAR)) AS filename,
    CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN '   ' ELSE text END AS code,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 'abc' WHEN doc_id % 19 = 0 THEN '3.7'
         ELSE CAST(doc_id % 11 AS VARCHAR) END AS label_encoded
  FROM documents)"""

_NUMBER = r"'^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$'"
_FILLED = (
    r"'[^\t\n\x0b\f\r \x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]'"
)

_NUMBERED = f"""{_CONTRACTS},
numbered AS (
  SELECT *, CASE WHEN regexp_matches(label_encoded, {_NUMBER})
    THEN try_cast(trim(label_encoded) AS DOUBLE) END AS number
  FROM contracts)"""

_JUDGED = f"""{_NUMBERED},
judged AS (
  SELECT *, CASE
    WHEN code IS NULL OR label_encoded IS NULL THEN 'missing'
    WHEN NOT regexp_matches(code, {_FILLED}) THEN 'blank'
    WHEN number IS NULL THEN 'bad_label'
    WHEN CAST(trunc(number) AS INT) NOT BETWEEN 0 AND 8 THEN 'out_of_domain' END AS reject
  FROM numbered)"""

_CLEANED = f"""{_JUDGED},
cleaned AS (
  SELECT doc_id, filename, code, CAST(trunc(number) AS INT) AS label_encoded
  FROM judged WHERE reject IS NULL)"""

_NAMES = "names(label, name) AS (VALUES " + ", ".join(
    f"({label}, {_text(name)})" for label, name in LABEL_NAMES.items()
) + ")"

_LINES = f"""{_NAMES},
lines AS (
  SELECT string_agg(CASE WHEN label < 8
    THEN replace(replace({_text(FAULT_LINE)}, '{{label}}', CAST(label AS VARCHAR)), '{{name}}', name)
    ELSE replace({_text(NORMAL_LINE)}, '{{label}}', CAST(label AS VARCHAR)) END,
    chr(10) ORDER BY label) AS body
  FROM names)"""

_LONG_BEFORE = f"(SELECT replace({_text(LONG.before)}, '{{labels}}', body) FROM lines)"
_SYSTEM = f"(SELECT replace({_text(SYSTEM.before)}, '{{labels}}', body) FROM lines)"


def _hash(key: str, seed: int, step: str) -> str:
    return f"md5(concat('{seed}:{step}:', CAST({key} AS VARCHAR)))"


def _split(source: str, label: str, key: str, test_size: str, seed: int, name: str) -> str:
    """CTEs of a stratified split of ``source`` called ``name``."""
    return f"""
{name}_counts AS (SELECT {label} AS c, count(*) AS n_c FROM {source} GROUP BY ALL),
{name}_total AS (
  SELECT sum(n_c)::HUGEINT AS n, sum(n_c)::HUGEINT - ceil({test_size}::DOUBLE * sum(n_c)::DOUBLE)::HUGEINT AS n_train
  FROM {name}_counts),
{name}_shares AS (
  SELECT c, n_c, n_train, n_c::HUGEINT * n_train // n AS whole, n_c::HUGEINT * n_train % n AS rest
  FROM {name}_counts, {name}_total),
{name}_quotas AS (
  SELECT c, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, c)
    <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END AS quota
  FROM {name}_shares),
{name} AS (
  SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.{label} ORDER BY {_hash('s.' + key, seed, 'split')}, s.{key})
    <= q.quota THEN 'train' ELSE 'test' END AS split
  FROM {source} s JOIN {name}_quotas q ON s.{label} = q.c)"""


_SPLIT = f"{_CLEANED}, {_split('cleaned', 'label_encoded', 'doc_id', '0.2', 42, 'parted')}"

_RESPONSES = """
responses AS (
  SELECT doc_id, CAST(doc_id % 9 AS INT) AS label_encoded,
    CASE WHEN doc_id % 10 = 0 THEN '' WHEN doc_id % 10 = 1 THEN 'no idea'
    WHEN doc_id % 10 = 2 THEN concat('9 ', CAST(doc_id % 9 AS VARCHAR))
    ELSE concat(' ', CAST((doc_id * 7) % 9 AS VARCHAR), '.') END AS response
  FROM documents),
answered AS (
  SELECT doc_id, label_encoded, response,
    coalesce(try_cast(nullif(regexp_extract(response, '[0-8]'), '') AS INT), -1) AS prediction
  FROM responses)"""

# The answer of the rule scorer on a code cell.
_RULED = (
    "CASE WHEN code IS NULL THEN -1 "
    + " ".join(f"WHEN contains(code, {_text(word)}) THEN {label}" for word, label in DOCUMENT_SCORER.rules)
    + " ELSE -1 END"
)

_LABELLED = """
labelled AS (
  SELECT d.doc_id, d.text AS code, CAST(l.quality * 4 + l.toxic * 5 AS INT) AS label_encoded
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE d.text IS NOT NULL)"""

_TOKENS = f"""
tokens AS (
  SELECT doc_id, length(text) AS n,
    list_transform(string_split(substr(text, 1, 2048), ''), lambda x: unicode(x)) AS ids
  FROM documents)"""

_ORACLES = {
    "csv_roundtrip": f"""WITH {_CONTRACTS}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, filename, code, label_encoded FROM contracts""",
    "csv_skip_bad_lines": f"""
SELECT CAST(doc_id AS VARCHAR) AS filename,
  CASE WHEN text NOT IN ({", ".join(map(_text, MISSING_MARKERS))}) THEN text END AS code,
  CASE WHEN lang <> 'de' THEN lang END AS label_encoded
FROM documents WHERE lang NOT IN ('es', 'fr')""",
    "resolve_source": f"""WITH {_CONTRACTS}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, label_encoded FROM contracts""",
    "strict_label": """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(substr(o_orderpriority, 1, 1) AS INT) END AS label
FROM orders""",
    "csv_mixed_line_ends": """
SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang FROM documents""",
    "csv_encoding_fallback": "SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(text, '') AS text, lang FROM documents",
    "nullify_markers": """
SELECT o_orderkey,
  CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN 'Nan' ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderstatus NOT IN ('F', 'P') THEN o_orderstatus END AS status
FROM orders""",
    "validate_dataset": f"""WITH {_CONTRACTS}
SELECT 'column' AS item, column_name AS detail, CAST(1 AS BIGINT) AS n
FROM (VALUES ('code'), ('label_encoded')) AS required(column_name)
UNION ALL SELECT 'rows', '', count(*) FROM contracts
UNION ALL SELECT 'label', label_encoded, count(*) FROM contracts
  WHERE label_encoded IS NOT NULL GROUP BY label_encoded""",
    "run_config": f"""WITH {_JUDGED}
SELECT 'word-counts' AS model_name, CAST(0.2 AS DOUBLE) AS test_size, CAST(42 AS BIGINT) AS random_state,
  CAST(NULL AS VARCHAR) AS max_samples, CAST(2048 AS BIGINT) AS max_length, false AS balanced,
  count(*) AS rows_in, count(*) FILTER (WHERE reject IS NULL) AS kept,
  count(*) FILTER (WHERE reject IS NOT NULL) AS removed
FROM judged""",
    "export_split_text": f"""WITH {_SPLIT}, {_LINES}
SELECT split, concat({_LONG_BEFORE}, code, {_text(LONG.after)}, ' ', CAST(label_encoded AS VARCHAR)) AS text
FROM parted""",
    "drop_missing": f"""WITH {_CONTRACTS}
SELECT * FROM contracts WHERE code IS NOT NULL AND label_encoded IS NOT NULL""",
    "drop_blank": f"""WITH {_CONTRACTS}
SELECT * FROM contracts WHERE regexp_matches(code, {_FILLED})""",
    "coerce_label": f"""WITH {_NUMBERED}
SELECT doc_id, number, CAST(trunc(number) AS INT) AS label_encoded FROM numbered WHERE number IS NOT NULL""",
    "label_domain": f"""WITH {_NUMBERED}
SELECT doc_id, CAST(trunc(number) AS INT) AS label_encoded FROM numbered
WHERE CAST(trunc(number) AS INT) BETWEEN 0 AND 8""",
    "clean_tolerant": f"WITH {_CLEANED} SELECT * FROM cleaned",
    "clean_strict": f"WITH {_LABELLED} SELECT * FROM labelled",
    "clean_domain": f"WITH {_LABELLED} SELECT * FROM labelled WHERE label_encoded BETWEEN 0 AND 8",
    "profile_rows": f"""WITH {_CONTRACTS}
SELECT count(*) AS n_rows, CAST(4 AS INT) AS n_columns,
  'doc_id, filename, code, label_encoded' AS columns FROM contracts""",
    "label_distribution": f"""WITH {_CLEANED}
SELECT label_encoded AS label, count(*) AS n FROM cleaned GROUP BY label_encoded""",
    "label_distribution_named": f"""WITH {_NUMBERED}, {_NAMES},
counts AS (
  SELECT CAST(trunc(number) AS INT) AS label, count(*) AS n FROM numbered WHERE number IS NOT NULL GROUP BY ALL)
SELECT c.label, coalesce(names.name, {_text(UNKNOWN_NAME)}) AS name, n
FROM counts c LEFT JOIN names ON c.label = names.label""",
    "label_distribution_table": """
SELECT c_nationkey AS label, any_value(n_name) AS name, count(*) AS n
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_nationkey""",
    "missing_values": f"""WITH {_CONTRACTS}, counted AS (
  SELECT 'code' AS "column", count(*) - count(code) AS n_missing FROM contracts
  UNION ALL SELECT 'label_encoded', count(*) - count(label_encoded) FROM contracts
  UNION ALL SELECT 'filename', count(*) - count(filename) FROM contracts
  UNION ALL SELECT 'doc_id', count(*) - count(doc_id) FROM contracts)
SELECT * FROM counted WHERE n_missing > 0""",
    "clean_report": f"""WITH {_JUDGED}
SELECT count(*) AS rows_in,
  count(*) FILTER (WHERE reject = 'missing') AS missing,
  count(*) FILTER (WHERE reject = 'blank') AS blank,
  count(*) FILTER (WHERE reject = 'bad_label') AS bad_label,
  count(*) FILTER (WHERE reject = 'out_of_domain') AS out_of_domain,
  count(*) FILTER (WHERE reject IS NULL) AS kept,
  count(*) FILTER (WHERE reject IS NOT NULL) AS removed
FROM judged""",
    "split_sizes": f"WITH {_SPLIT} SELECT split, count(*) AS n FROM parted GROUP BY split",
    "landing_report": f"""WITH {_JUDGED}
SELECT count(*) AS rows_in,
  count(*) FILTER (WHERE reject = 'missing') AS missing,
  count(*) FILTER (WHERE reject = 'blank') AS blank,
  count(*) FILTER (WHERE reject = 'bad_label') AS bad_label,
  count(*) FILTER (WHERE reject = 'out_of_domain') AS out_of_domain,
  count(*) FILTER (WHERE reject IS NULL) AS kept,
  count(*) FILTER (WHERE reject IS NOT NULL) AS removed,
  count(*) AS landed, count(code) AS with_code
FROM judged""",
    "preparing_report": f"""WITH {_SPLIT}, {_LINES}
SELECT split, count(*) AS rows, count(*) * 3 // 16 AS steps,
  max(length(concat({_LONG_BEFORE}, code, {_text(LONG.after)}, ' ', CAST(label_encoded AS VARCHAR))))::INT AS longest
FROM parted GROUP BY split""",
    "training_steps": f"""WITH {_SPLIT}
SELECT split, count(*) AS n, count(*) * 3 // 16 AS steps FROM parted GROUP BY split""",
    "preview": f"WITH {_CONTRACTS} SELECT * FROM contracts ORDER BY doc_id LIMIT 5",
    "sample_exact": f"WITH {_CLEANED} SELECT * FROM cleaned ORDER BY {_hash('doc_id', 42, 'sample')}, doc_id LIMIT 500",
    "eval_subset": f"""WITH {_SPLIT}
SELECT doc_id, filename, code, label_encoded FROM parted WHERE split = 'test'
ORDER BY {_hash('doc_id', 42, 'eval')}, doc_id LIMIT 100""",
    "eval_subset_shares": f"""WITH {_split('orders', 'o_orderpriority', 'o_orderkey', '0.1', 7, 'parted')},
test AS (SELECT o_orderkey, o_orderpriority FROM parted WHERE split = 'test'),
subset AS (SELECT o_orderkey FROM test ORDER BY {_hash('o_orderkey', 7, 'eval')}, o_orderkey LIMIT 500)
SELECT o_orderpriority, count(*) AS n_test, count(s.o_orderkey) AS n_subset
FROM test t LEFT JOIN subset s ON t.o_orderkey = s.o_orderkey GROUP BY o_orderpriority""",
    "cap_per_class": f"""WITH {_CLEANED}
SELECT doc_id, label_encoded FROM cleaned
QUALIFY row_number() OVER (PARTITION BY label_encoded ORDER BY {_hash('doc_id', 42, 'cap')}, doc_id) <= 600 // 9
  OR count(*) OVER () <= 600""",
    "cap_per_language": f"""
SELECT * FROM documents
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_hash('doc_id', 42, 'cap')}, doc_id) <= 800 // 4
  OR count(*) OVER () <= 800""",
    "stratified_split": f"WITH {_SPLIT} SELECT doc_id, label_encoded, split FROM parted",
    "stratified_split_languages": f"""WITH classed AS (
  SELECT doc_id, CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END AS label_encoded
  FROM documents),
{_split('classed', 'label_encoded', 'doc_id', '0.2', 42, 'parted')}
SELECT doc_id, label_encoded, split FROM parted""",
    "stratified_split_orders": f"""WITH {_split('orders', 'o_orderpriority', 'o_orderkey', '0.1', 7, 'parted')}
SELECT o_orderkey, o_orderpriority, split FROM parted""",
    "prompt_train": f"""WITH {_CLEANED}, {_LINES}
SELECT doc_id, concat({_LONG_BEFORE}, code, {_text(LONG.after)}, ' ', CAST(label_encoded AS VARCHAR)) AS text
FROM cleaned""",
    "prompt_infer": f"""WITH {_CONTRACTS}, {_LINES}
SELECT doc_id, {_LONG_BEFORE} || code || {_text(LONG.after)} AS text FROM contracts""",
    "prompt_short": f"""WITH {_CLEANED}
SELECT doc_id, concat({_text(SHORT.before)}, substr(code, 1, 1000), {_text(SHORT.after)}, ' ',
  CAST(label_encoded AS VARCHAR)) AS text, CAST(length(code) AS INT) AS code_chars
FROM cleaned""",
    "prompt_chat": f"""WITH {_CLEANED}, {_LINES}
SELECT doc_id, concat({_SYSTEM}, {_text(CHAT.before)}, code, {_text(CHAT.after)}) AS text,
  concat('system: ', {_SYSTEM}, chr(10), 'user: ', code, chr(10), 'assistant: ',
    CAST(label_encoded AS VARCHAR)) AS messages
FROM cleaned""",
    "prompt_chat_turns": f"""WITH {_LINES}
SELECT conv_id, turn, concat({_SYSTEM}, {_text(CHAT.before)}, text, {_text(CHAT.after)}) AS text
FROM conversations WHERE role = 'user'""",
    "generated_part": r"""
SELECT q.conv_id, q.turn,
  regexp_replace(regexp_replace(a.text, '^\s+', ''), '\s+$', '') AS response
FROM conversations q JOIN conversations a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
WHERE q.role = 'user' AND a.role = 'assistant'""",
    "first_label": f"WITH {_RESPONSES} SELECT doc_id, response, prediction AS label FROM answered",
    "first_label_orders": """
SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS label FROM orders""",
    "tokenise": f"""WITH {_TOKENS}
SELECT doc_id, CAST(n AS INT) AS n_tokens, CAST(ids AS VARCHAR) AS input_ids FROM tokens""",
    "tokenise_batched": """WITH raw AS (
  SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents)
SELECT doc_id, CAST(n AS INT) AS n_tokens,
  CAST(list_transform(range(0, least(n, 2048)),
    lambda i: CAST(concat('0x', substr(h, 2 * i + 1, 2)) AS INT)) AS VARCHAR) AS input_ids
FROM raw""",
    "pad_mask": f"""WITH {_TOKENS}
SELECT doc_id,
  CAST(list_resize(ids, 2048, 0) AS VARCHAR) AS input_ids,
  CAST(list_transform(range(1, 2049), lambda i: CASE WHEN i <= n THEN 1 ELSE 0 END) AS VARCHAR) AS attention_mask
FROM tokens""",
    "token_batches": f"""WITH {_TOKENS}
SELECT doc_id, len(list_resize(ids, least(n, 2048)))::BIGINT AS n_tokens,
  coalesce(list_sum(list_resize(ids, least(n, 2048))), 0)::BIGINT AS sum_ids,
  coalesce(list_sum(list_resize(ids, least(n, 2048))), 0)::BIGINT AS sum_labels, TRUE AS is_close
FROM tokens""",
    "lm_labels": f"""WITH {_TOKENS}
SELECT doc_id, CAST(list_transform(list_resize(ids, 2048, 0),
  lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS VARCHAR) AS labels
FROM tokens""",
    "truncation_report": f"""WITH {_CLEANED}, {_LINES}, sized AS (
  SELECT length(concat({_LONG_BEFORE}, code, {_text(LONG.after)}, ' ', CAST(label_encoded AS VARCHAR))) AS n
  FROM cleaned)
SELECT count(*) AS total, count(*) FILTER (WHERE n > 2048) AS cut_rows,
  CAST(coalesce(sum(greatest(n - 2048, 0)), 0) AS BIGINT) AS cut_tokens, max(n) AS longest
FROM sized""",
    "classify_table": f"""WITH {_CONTRACTS}
SELECT CAST(doc_id AS VARCHAR) AS doc_id, filename, code, label_encoded, {_RULED} AS llm_prediction FROM contracts""",
    "accuracy_all": f"""WITH {_RESPONSES}
SELECT count(*) AS total, count(*) FILTER (WHERE prediction = label_encoded) AS correct,
  CAST(100 AS DOUBLE) * count(*) FILTER (WHERE prediction = label_encoded) / count(*) AS percent
FROM answered""",
    "accuracy_answered": f"""WITH {_NUMBERED}, ruled AS (SELECT number, {_RULED} AS prediction FROM numbered)
SELECT count(*) AS total, count(*) FILTER (WHERE prediction = number) AS correct,
  CAST(100 AS DOUBLE) * count(*) FILTER (WHERE prediction = number) / count(*) AS percent
FROM ruled WHERE prediction <> -1""",
    "accuracy_by_class": f"""WITH {_RESPONSES}, {_NAMES}
SELECT label_encoded AS label, any_value(name) AS name, count(*) AS total,
  count(*) FILTER (WHERE prediction = label_encoded) AS correct,
  round_even(CAST(100 AS DOUBLE) * count(*) FILTER (WHERE prediction = label_encoded) / count(*), 1) AS percent
FROM answered JOIN names ON label_encoded = names.label GROUP BY label_encoded""",
    "evaluate": f"""WITH {_CLEANED}, {_NAMES}, ruled AS (SELECT label_encoded, {_RULED} AS prediction FROM cleaned),
counted AS (
  SELECT label_encoded AS label, count(*) AS total,
    count(*) FILTER (WHERE prediction <> -1) AS answered,
    count(*) FILTER (WHERE prediction = label_encoded) AS correct
  FROM ruled GROUP BY ROLLUP (label_encoded))
SELECT coalesce(CAST(counted.label AS VARCHAR), 'all') AS label, name, total, answered, correct,
  CAST(100 AS DOUBLE) * correct / total AS percent_all,
  CAST(100 AS DOUBLE) * correct / nullif(answered, 0) AS percent_answered
FROM counted LEFT JOIN names ON counted.label = names.label""",
    "classify_stream": f"""WITH {_NAMES}, codes AS (SELECT doc_id, text AS code FROM documents),
ruled AS (SELECT doc_id, {_RULED} AS prediction FROM codes WHERE regexp_matches(code, {_FILLED}))
SELECT doc_id, prediction, name FROM ruled LEFT JOIN names ON prediction = label""",
    "prepare": f"""WITH {_SPLIT}, {_LINES}
SELECT doc_id, label_encoded, split, concat({_LONG_BEFORE}, code, {_text(LONG.after)}, ' ',
  CAST(label_encoded AS VARCHAR)) AS text
FROM parted""",
}

_ORACLES["prepare_tokens"] = f"""WITH {_SPLIT}, {_LINES},
texts AS (
  SELECT doc_id, split, concat({_LONG_BEFORE}, code, {_text(LONG.after)}, ' ', CAST(label_encoded AS VARCHAR)) AS text
  FROM parted),
cut AS (
  SELECT doc_id, split, CAST(length(text) AS INT) AS n_tokens,
    list_transform(string_split(substr(text, 1, 2048), ''), lambda x: unicode(x)) AS ids
  FROM texts)
SELECT doc_id, split, n_tokens, CAST(list_resize(ids, 2048, 0) AS VARCHAR) AS input_ids,
  CAST(list_transform(range(1, 2049), lambda i: CASE WHEN i <= n_tokens THEN 1 ELSE 0 END) AS VARCHAR) AS attention_mask,
  CAST(list_transform(list_resize(ids, 2048, 0), lambda x: CASE WHEN x = 0 THEN -100 ELSE x END) AS VARCHAR) AS labels
FROM cut"""

_LANGUAGES = f"""classed AS (
  SELECT doc_id, text AS code, CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END
    AS INT) AS label_encoded
  FROM documents),
{_split('classed', 'label_encoded', 'doc_id', '0.2', 42, 'parted')},
test AS (SELECT doc_id, code, label_encoded FROM parted WHERE split = 'test')"""

# SQL states which rows a trained model must answer, and that it reaches its floor.
_ORACLES["fit_classifier"] = f"""WITH {_LANGUAGES}
SELECT doc_id, label_encoded, true AS same_when_loaded, true AS is_class FROM test"""
_ORACLES["naive_bayes"] = rf"""WITH {_LANGUAGES},
cut AS (
  SELECT doc_id, label_encoded AS label, split, code IS NULL AS missing,
    regexp_extract_all(code, '[^\x20\x09-\x0D]+') AS words
  FROM parted),
training AS (SELECT * FROM cut WHERE split = 'train' AND NOT missing),
classes AS (SELECT label, count(*) AS n, sum(len(words)) AS total FROM training GROUP BY label),
counts AS (SELECT label, word, count(*) AS n FROM (SELECT label, unnest(words) AS word FROM training) GROUP BY ALL),
vocabulary AS (SELECT DISTINCT word FROM counts),
weights AS (
  SELECT classes.label, vocabulary.word,
    round(ln((coalesce(counts.n, 0) + 1)::DOUBLE / (total + (SELECT count(*) FROM vocabulary))::DOUBLE) * 1048576)::BIGINT AS weight
  FROM classes CROSS JOIN vocabulary LEFT JOIN counts ON counts.label = classes.label AND counts.word = vocabulary.word),
asked AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(words) AS word FROM cut WHERE split = 'test') GROUP BY ALL),
sums AS (SELECT doc_id, label, sum(n * weight) AS score FROM asked JOIN weights USING (word) GROUP BY ALL),
scored AS (
  SELECT cut.doc_id, cut.label AS label_encoded, missing, classes.label,
    coalesce(score, 0) + round(ln(classes.n::DOUBLE / (SELECT sum(n) FROM classes)::DOUBLE) * 1048576)::BIGINT AS score
  FROM cut CROSS JOIN classes
  LEFT JOIN sums ON sums.doc_id = cut.doc_id AND sums.label = classes.label WHERE split = 'test'),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place FROM scored)
SELECT doc_id, label_encoded, CASE WHEN missing THEN -1 ELSE label END::INT AS prediction FROM best WHERE place = 1"""
_ORACLES["model_accuracy"] = f"""WITH {_LANGUAGES}
SELECT coalesce(CAST(label_encoded AS VARCHAR), 'all') AS label, count(*) AS total, count(*) AS answered,
  true AS reaches_floor
FROM test GROUP BY ROLLUP (label_encoded)"""
_ORACLES["model_selection"] = f"""WITH {_LANGUAGES}
SELECT count(*) AS total, true AS reaches_floor FROM test"""
# The validation part is cut from each class by the same rule as the test part, so its size is stated too.
_ORACLES["train_epochs"] = f"""WITH {_LANGUAGES},
sizes AS (
  SELECT count(*) FILTER (WHERE split = 'train') AS fitted, ceil(0.2 * count(*) FILTER (WHERE split = 'train')) AS judged
  FROM parted)
SELECT epoch::INT AS epoch, (fitted - judged)::BIGINT AS rows, judged::BIGINT AS validation_rows,
  true AS falls, true AS below_chance, true AS reaches_floor
FROM sizes, range(1, 5) AS epochs (epoch)"""
_ORACLES["classify_file_model"] = f"""WITH {_LANGUAGES}
SELECT doc_id, code, label_encoded, true AS is_class FROM test"""
_ORACLES["train_and_evaluate"] = f"""WITH {_LABELLED},
known AS (SELECT * FROM labelled WHERE label_encoded BETWEEN 0 AND 8),
{_split('known', 'label_encoded', 'doc_id', '0.2', 42, 'parted')}
SELECT coalesce(CAST(label_encoded AS VARCHAR), 'all') AS label, count(*) AS total, count(*) AS answered,
  true AS reaches_floor
FROM parted WHERE split = 'test' GROUP BY ROLLUP (label_encoded)"""
_ORACLES["prepare_low_memory"] = f"""WITH {_LABELLED}, {_LINES},
{_split('labelled', 'label_encoded', 'doc_id', '0.2', 42, 'parted')},
train AS (SELECT * FROM parted WHERE split = 'train' ORDER BY {_hash('doc_id', 42, 'sample')}, doc_id LIMIT 500),
chosen AS (FROM train UNION ALL FROM parted WHERE split = 'test')
SELECT doc_id, label_encoded, split,
  concat({_LONG_BEFORE}, code, {_text(LONG.after)}, ' ', CAST(label_encoded AS VARCHAR)) AS text
FROM chosen"""
_ORACLES["prepare_least_memory"] = f"""WITH {_LABELLED},
known AS (SELECT * FROM labelled WHERE label_encoded BETWEEN 0 AND 8),
{_split('known', 'label_encoded', 'doc_id', '0.2', 42, 'parted')},
train AS (
  SELECT * FROM parted WHERE split = 'train'
  QUALIFY row_number() OVER (PARTITION BY label_encoded ORDER BY {_hash('doc_id', 42, 'cap')}, doc_id) <= 800 // 9
    OR count(*) OVER () <= 800),
chosen AS (FROM train UNION ALL FROM parted WHERE split = 'test')
SELECT doc_id, label_encoded, split, concat({_text(SHORT.before)}, substr(code, 1, 1000),
  {_text(SHORT.after)}, ' ', CAST(label_encoded AS VARCHAR)) AS text
FROM chosen"""
_ORACLES["csv_split_records"] = _ORACLES["csv_roundtrip"]


def oracle_sql() -> dict[str, str]:
    return {name: sql.strip() for name, sql in _ORACLES.items()}
