"""The queries as DuckDB SQL, for those that SQL can express."""
from __future__ import annotations

ORACLE: dict[str, str] = {}

_WS = r"[ \t-\r]+"

ORACLE["op9_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM documents),
starts AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS win
    FROM (SELECT doc_id, words, unnest(range(1, greatest(1, len(words) - 6))) AS i FROM w)),
many AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM starts) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM many) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(list_filter(words, lambda x: regexp_matches(x, '^[^\p{{Ll}}]*\p{{Lu}}[^\p{{Ll}}]*$'))) AS n_caps,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_stutter
    FROM w LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
    + 4 * (100 * n_symbols > 10 * n_words)::BIGINT + 8 * (100 * n_dup_lines > 40 * n_lines)::BIGINT
    + 16 * (100 * n_caps > 50 * n_words)::BIGINT + 32 * (100 * n_stutter > 30 * n_words)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
    fail_bits = 0 AS kept, fail_bits FROM b
"""

ORACLE["op4_chat_format"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, lag(role) OVER o IS DISTINCT FROM role OR lag(turn) OVER o IS NULL AS opens,
    regexp_replace(text, '([<\[])(\\*)(/?s>|\|[A-Za-z_]+\|>|/?INST\]|/?SYS>>)', '\1\2\\\3', 'g') AS safe FROM c
    WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (7 + sum(length(safe) + CASE WHEN opens THEN 9 + length(role) + 8 + 7 ELSE 8 END))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""


def _op1() -> str:
    """The walk in twenty unrolled rounds; rules as in the operator."""
    fits = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) "
               f"AND starts_with(path, '/{r.partition('/')[2]}')"
            for r in ("net/", "example.net/en/", "example.com/de/", "org/fr/")}
    order = ("example.net/en/", "example.com/de/", "org/fr/", "net/")
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN '{r}'" for r in order) + " END"
    low = "translate(regexp_extract({0}, '{1}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""named AS (SELECT page_id, html, coalesce({low.format('url', '://([^/?#]*)')}, '') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)""",
             f"ruled AS (SELECT *, {rule} AS rule FROM named)",
             """said AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
        WHEN rule IS NOT NULL THEN 'allow' END AS says FROM ruled)""",
             r"""links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html,
        '(?i)\s(?:href|src)\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM named)""",
             "counted AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND src <> '' GROUP BY ALL)",
             "ahead AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM counted)",
             """edges AS MATERIALIZED (SELECT 'trust' AS walk, src, dst, weight FROM ahead UNION ALL
        SELECT 'distrust', dst, src, weight / sum(weight) OVER (PARTITION BY dst) FROM ahead)""",
             """shares AS (SELECT host, avg((coalesce(says, '') = 'allow')::INT) AS trust,
        avg((coalesce(says, '') = 'block')::INT) AS distrust FROM said WHERE host <> '' GROUP BY host)""",
             """seeds AS (SELECT 'trust' AS walk, host, trust AS mass FROM shares WHERE trust > 0 UNION ALL
        SELECT 'distrust', host, distrust FROM shares WHERE distrust > 0)""",
             "r0 AS MATERIALIZED (SELECT walk, host, 0.15 * mass / sum(mass) OVER (PARTITION BY walk) AS rank FROM seeds)"]
    for k in range(20):
        parts.append(f"""r{k + 1} AS MATERIALIZED (SELECT walk, host, sum(rank) AS rank FROM (SELECT * FROM r0 UNION ALL
        SELECT r.walk, e.dst, 0.85 * r.rank * e.weight FROM r{k} r JOIN edges e ON r.walk = e.walk AND r.host = e.src)
        GROUP BY walk, host)""")
    parts.append("""carried AS (SELECT r.walk, r.host, (r.rank - coalesce(r0.rank, 0)) / sum(r.rank) OVER (PARTITION BY r.walk) AS c
        FROM r20 r LEFT JOIN r0 USING (walk, host))""")
    parts.append("""hosts AS (SELECT host, coalesce(sum(c) FILTER (walk = 'trust'), 0) AS t,
        coalesce(sum(c) FILTER (walk = 'distrust'), 0) AS d FROM carried GROUP BY host)""")
    return f"""WITH {', '.join(parts)}
        SELECT page_id, s.host, path, rule, coalesce(says, CASE WHEN d > t AND d * (SELECT count(*) FROM shares) > 0.01
            THEN 'block' ELSE 'allow' END) AS verdict FROM said s LEFT JOIN hosts h ON s.host = h.host"""


ORACLE["op1_url_trust"] = _op1()

ORACLE["op2_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, list_slice(w, i, i + 9) AS gram FROM
    (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(gram) AS k FROM g),
s AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS gram FROM
    (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
h AS (SELECT doc_id, item_id, i, k FROM s JOIN g USING (gram)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE["op8_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_WS}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, i, list_slice(w, i, i + 34) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
p AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(
        list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN p USING (doc_id)
"""


def mixing_sql(documents: str) -> str:
    """Rows of the mix over a table or subquery: ids, texts' digests, sizes, targets and copies."""
    return rf"""
sizes AS MATERIALIZED (SELECT doc_id, source, md5(coalesce(text, '')) AS tie,
    len(regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')) AS size FROM {documents}),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
wt AS (SELECT *, list_extract([5.0::DOUBLE, 2.0, 1.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)) AS w,
    2.0::DOUBLE * source_size AS most FROM src),
cum AS (SELECT *, coalesce(sum(most) OVER o, 0) AS used, coalesce(sum(w) OVER o, 0) AS gone FROM wt
    WINDOW o AS (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM src) - used) / ((SELECT sum(w) FROM wt) - gone) AS level FROM cum),
top AS (SELECT coalesce((SELECT level FROM lv WHERE level * w <= most ORDER BY most / w, source NULLS LAST LIMIT 1), 0) AS level),
goal AS MATERIALIZED (SELECT source, source_size, least(most, top.level * w) AS target FROM wt, top),
mix AS MATERIALIZED (SELECT s.*, source_size, target, row_number() OVER (PARTITION BY s.source ORDER BY size DESC, doc_id NULLS FIRST, tie) - 1 AS place,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('42:' || coalesce(s.source, '') || ':' || (s.source IS NULL)::VARCHAR), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
    FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
mixed AS (SELECT *, (floor(shift + rate * (place + 1)) - floor(shift + rate * place))::BIGINT AS copies FROM mix)"""


ORACLE["op6_mixing"] = f"WITH {mixing_sql('documents')} SELECT doc_id, size, source_size, target, copies * size AS taken FROM mixed"


def line_dedup_sql(documents: str) -> str:
    """Rows ``doc_id``, line and chunk counts and ``kept`` text of the line dedup over a table or subquery."""
    return rf"""
ln AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents}),
hs AS (SELECT *, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM ln),
cuts AS (SELECT *, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR (i > 1 AND (31 * h[i - 1] + h[i]) % 4 = 0)) AS e FROM hs),
ch AS MATERIALIZED (SELECT doc_id, k - 1 AS no, e[k] - coalesce(e[k - 1], 0) AS lines,
    array_to_string(list_slice(l, coalesce(e[k - 1], 0) + 1, e[k]), chr(10)) AS chunk
    FROM (SELECT *, unnest(range(1, len(e) + 1)) AS k FROM cuts)),
mk AS MATERIALIZED (SELECT *, lines > 1 AND regexp_matches(chunk, '\S') AND
    row_number() OVER (PARTITION BY chunk ORDER BY doc_id, no) > 1 AS gone FROM ch),
dedup AS MATERIALIZED (SELECT doc_id, sum(lines)::BIGINT AS n_lines, count(*) AS n_chunks,
    coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed,
    coalesce(string_agg(chunk, chr(10) ORDER BY no) FILTER (NOT gone), '') AS kept FROM mk GROUP BY doc_id)"""


ORACLE["op5_line_dedup"] = f"""WITH {line_dedup_sql('documents')}
    SELECT doc_id, n_lines, n_chunks, n_removed, sha256(kept) AS kept_sha256 FROM dedup"""

ORACLE["op11_fill_in_middle"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS d,
    regexp_extract_all(coalesce(text, ''), '[ \t-\r]*[^ \t-\r]+|[ \t-\r]+') AS u FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || substr(d, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (len(u) + 1) AS b,
    ('0x' || substr(d, 17, 8))::BIGINT % 100 AS r, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS s FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r >= 50 THEN 'plain'
    WHEN s < 80 THEN 'spm' ELSE 'psm' END AS form, array_to_string(list_slice(u, 1, least(a, b)), '') AS p,
    array_to_string(list_slice(u, least(a, b) + 1, greatest(a, b)), '') AS m, array_to_string(list_slice(u, greatest(a, b) + 1, n), '') AS e FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
    CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || e || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || e || '<M>' || m END)
    AS output_sha256, sha256(text) AS restored_sha256 FROM f
"""

ORACLE["op12_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS fails FROM d),
l AS (SELECT doc_id, max(quality) AS good, max(toxic) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good = 1) AS good, count(*) FILTER (toxic = 1) AS toxic
    FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM x a, x b, x c, x d, x e
    WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before
    FROM (SELECT *, unnest(range(1, 6)) AS step FROM o)),
g AS (SELECT part, filter_order, step::INT AS step, bit,
    coalesce(sum(n) FILTER (fails & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails & before <> 0 AND fails & bit <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails & before = 0 AND fails & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM g
"""
