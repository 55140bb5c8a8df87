"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_URL_FILTER = r"""
WITH cut AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
    SELECT page_id,
        coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path
    FROM cut
), rules(name, rule_host, rule_path, rule_verdict) AS (
    VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
           ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), fitting AS (
    SELECT page_id, arg_max(name, length(name)) AS name, arg_max(rule_verdict, length(name)) AS rule_verdict
    FROM parts JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT page_id, host, path, name AS rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts LEFT JOIN fitting USING (page_id)
"""

_EXACT_DEDUP = """
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY text)
"""

_SOURCE_MIX = r"""
WITH texts AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
        md5('42:' || coalesce(doc_id::VARCHAR, '')) AS drawn
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
    FROM texts GROUP BY source
), limited AS (
    SELECT source, source_size, weight, 3 * source_size AS most,
        row_number() OVER (ORDER BY 3 * source_size / weight, source NULLS LAST) AS place
    FROM sources
), units AS (
    SELECT place, weight, most,
        (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
        / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS unit
    FROM limited
), targets AS (
    SELECT source, source_size, least(most::DOUBLE,
        weight * (SELECT arg_min(unit, place) FROM units WHERE weight * unit <= most)) AS target
    FROM limited
), numbered AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number, floor(target)::BIGINT AS take FROM targets
), shares AS (
    SELECT *, (sum(take) OVER (ORDER BY number) - take)::BIGINT AS before, (sum(take) OVER ())::BIGINT AS total FROM numbered
), spans AS (
    SELECT *, least(floor(before * (2147483648::DOUBLE / total)), 2147483648)::BIGINT AS low,
        CASE WHEN before + take = total THEN 2147483648
            ELSE least(floor((before + take) * (2147483648::DOUBLE / total)), 2147483648)::BIGINT END AS high,
        (total + 1023) // 1024 AS n_slots, (take + 1023) // 1024 AS needed
    FROM shares WHERE total > 0
), points AS (
    SELECT i AS slot, (i % 2147483648) * 1327217885 % 2147483648 AS point FROM range((SELECT max(n_slots) FROM spans)) line(i)
), named AS (
    SELECT slot, number, needed, row_number() OVER (PARTITION BY number ORDER BY slot) - 1 AS block
    FROM points JOIN spans ON low <= point AND point < high
), late AS (
    SELECT n_slots + number AS slot, number, unnest(range(coalesce(slots, 0), needed)) AS block
    FROM spans LEFT JOIN (SELECT number, count(*) AS slots FROM named GROUP BY number) USING (number)
), schedule AS (
    SELECT slot, number, block FROM named WHERE block < needed
    UNION ALL SELECT slot, number, block FROM late
), placed AS (
    SELECT doc_id, size, texts.source AS source, source_size, target, number, take,
        sum(size) OVER (PARTITION BY texts.source ORDER BY drawn, doc_id ROWS UNBOUNDED PRECEDING) - size AS start,
        row_number() OVER () AS uid
    FROM texts JOIN numbered ON texts.source IS NOT DISTINCT FROM numbered.source
), passages AS (
    SELECT uid, number, epoch * source_size + start AS first, least(epoch * source_size + start + size, take) AS last
    FROM placed, range(3) epochs(epoch)
), pieces AS (
    SELECT uid, number, first, last, unnest(range((first // 1024)::BIGINT, ((last - 1) // 1024)::BIGINT + 1)) AS block
    FROM passages WHERE first < last
), met AS (
    SELECT uid, sum(least(last, (pieces.block + 1) * 1024) - greatest(first, pieces.block * 1024)) AS taken,
        min(slot) AS first_slot, max(slot) AS last_slot
    FROM pieces JOIN schedule ON schedule.number = pieces.number AND schedule.block = pieces.block
    GROUP BY uid
)
SELECT doc_id, size, source, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot, last_slot
FROM placed LEFT JOIN met USING (uid)
"""

_TOP_K = """
WITH whole AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS vector
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), ranked AS (
    SELECT asked.vec_id AS query_id, other.vec_id AS vec_id,
        list_inner_product(asked.vector, other.vector)::BIGINT AS score,
        row_number() OVER (PARTITION BY asked.row
            ORDER BY list_inner_product(asked.vector, other.vector) DESC, other.vec_id)::INTEGER AS rank
    FROM whole asked JOIN whole other ON asked.vec_id % 50 = 0 AND asked.row <> other.row
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

_CONVERSATION_REPAIR = r"""
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) ORDER BY i) AS codes
    FROM range(256) numbers(i)
), keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS named
    FROM conversations
), faulty AS (
    SELECT keyed.*, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(named, ''), lambda c: ord(c)::BIGINT)),
        lambda x, y: xor(x >> 8, codes[xor(x % 256, y) + 1]))) % 20 AS fault
    FROM keyed, crc
), damaged AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM faulty, range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) copies(c)
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
        left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
        right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) NOT IN ('.', '!', '?') AS unended
    FROM damaged
), judged AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS repeated,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY place) || initial NOT IN ('su', 'ua', 'au') AS unfit
    FROM placed
), figures AS (
    SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count_if(blank) AS blank, count_if(repeated AND NOT blank) AS duplicate,
        count_if(unended AND NOT blank AND NOT repeated) AS truncated, count_if(unfit) AS illegal
    FROM judged GROUP BY conv_id
), edits(edit, target, given, price) AS (
    VALUES ('K', 's', NULL, 0), ('K', 'u', NULL, 0), ('K', 'a', NULL, 0),
        ('R', 'u', 'user', 2), ('R', 'a', 'assistant', 2), ('D', NULL, NULL, 3)
), paths AS (
    SELECT DISTINCT conv_id, 0::BIGINT AS place, '' AS state, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS lines
    FROM conversations
    UNION ALL
    SELECT conv_id, place, state, cost, audit, lines FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS choice FROM (
            SELECT conv_id, place, coalesce(target, state) AS state,
                cost + price + CASE WHEN inserted IS NULL THEN 0 ELSE 2 END
                    + CASE WHEN unended AND edit <> 'D' THEN 1 ELSE 0 END AS cost,
                audit || CASE WHEN inserted IS NULL THEN '' ELSE 'I' END || edit AS audit,
                lines || CASE WHEN inserted IS NULL THEN [] ELSE [inserted || ':'] END
                    || CASE edit WHEN 'D' THEN [] ELSE [coalesce(given, role) || ':' || text] END AS lines
            FROM (
                SELECT paths.conv_id, judged.place, state, cost, audit, lines, edit, target, given, price, role, text,
                    unended, CASE WHEN target = 'u' AND state = 'u' THEN 'assistant'
                        WHEN target = 'a' AND state <> 'u' THEN 'user' END AS inserted
                FROM paths
                JOIN judged ON judged.conv_id IS NOT DISTINCT FROM paths.conv_id AND judged.place = paths.place + 1
                JOIN edits ON edit = 'D' OR (NOT blank AND NOT repeated AND (edit = 'R' OR initial = target)
                    AND (target <> 's' OR state = ''))
            )
        )
    ) WHERE choice = 1
), ended AS (
    SELECT conv_id, place, cost + CASE state WHEN 's' THEN 4 WHEN 'u' THEN 2 ELSE 0 END AS cost,
        audit || CASE state WHEN 's' THEN 'II' WHEN 'u' THEN 'I' ELSE '' END AS audit,
        lines || CASE state WHEN 's' THEN ['user:', 'assistant:'] WHEN 'u' THEN ['assistant:'] ELSE [] END AS lines
    FROM paths
), cheapest AS (
    SELECT ended.*, coalesce(n, 0) AS n, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
        coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
        row_number() OVER (PARTITION BY ended.conv_id ORDER BY cost, audit) AS choice
    FROM ended LEFT JOIN figures ON figures.conv_id IS NOT DISTINCT FROM ended.conv_id
    WHERE place = coalesce(n, 0)
)
SELECT conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate,
    truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, cost::BIGINT AS cost, audit,
    sha256(array_to_string(lines, chr(10))) AS repaired_sha256
FROM cheapest WHERE choice = 1
"""

ORACLES: dict[str, str] = {
    "op3_url_filter": _URL_FILTER,
    "op8_top_k": _TOP_K,
    "op9_source_mix": _SOURCE_MIX,
    "op5_exact_dedup": _EXACT_DEDUP,
    "op13_conversation_repair": _CONVERSATION_REPAIR,
}
