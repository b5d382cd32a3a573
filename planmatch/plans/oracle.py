"""The same queries as SQL, for a second engine on the same tables."""

from __future__ import annotations

# ------------------------------------------------------------- shared pieces

CATALOG = """
cat AS (SELECT p_partkey, p_name, p_brand, p_retailprice,
    CASE WHEN p_partkey % 7 <> 0 THEN p_type END AS p_type,
    CASE WHEN p_partkey % 5 <> 0 THEN p_size END AS p_size FROM part)"""

WISHES = """
wish AS (SELECT c_custkey AS request_id,
    CASE WHEN c_acctbal < 0 THEN 'Brand#99' ELSE 'Brand#' || (c_nationkey + 1) END AS brand,
    floor(c_acctbal / 200)::BIGINT AS size_cap,
    floor(c_acctbal / 100)::BIGINT + 900 AS price_cap,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'PROMO' WHEN 'BUILDING' THEN 'ECONOMY'
        WHEN 'HOUSEHOLD' THEN 'SMALL' WHEN 'MACHINERY' THEN 'TINY' END AS typ
    FROM customer),
conditions AS (
    SELECT request_id, 1 AS ord, 'p_brand' AS col, '=' AS op, brand AS value FROM wish
    UNION ALL SELECT request_id, 2, 'p_size', '<=', size_cap::VARCHAR FROM wish
    UNION ALL SELECT request_id, 3, 'p_retailprice', '<=', price_cap::VARCHAR FROM wish
    UNION ALL SELECT request_id, 4, 'p_type', '=', typ FROM wish WHERE typ IS NOT NULL)"""

SCORES = """
scores AS (SELECT c_custkey AS request_id, l.col,
        ((c_custkey * 31 + l.i * 17) % 100) / 100.0::DOUBLE AS score
    FROM customer, (VALUES (0, 'p_brand'), (1, 'p_size'), (2, 'p_retailprice'),
        (3, 'p_type'), (4, 'delivery')) l(i, col)
    WHERE NOT (l.col = 'p_size' AND c_mktsegment = 'HOUSEHOLD')
      AND NOT (l.col = 'delivery' AND c_nationkey >= 5)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score, col) AS rk
    FROM scores)"""

RELAXED = f"""{CATALOG}, {WISHES}, {SCORES},
rks AS (SELECT request_id, max(rk) AS n_labels,
    coalesce(max(CASE WHEN col = 'p_brand' THEN rk END), 1000) AS rb,
    coalesce(max(CASE WHEN col = 'p_size' THEN rk END), 1000) AS rs,
    coalesce(max(CASE WHEN col = 'p_retailprice' THEN rk END), 1000) AS rp,
    coalesce(max(CASE WHEN col = 'p_type' THEN rk END), 1000) AS rt
    FROM ranked GROUP BY request_id),
pairs AS (SELECT w.request_id, p_partkey, p_retailprice, p_brand, p_type, p_size, greatest(
    CASE WHEN coalesce(p_brand = brand, false) THEN 0 ELSE rb END,
    CASE WHEN coalesce(p_size <= size_cap, false) THEN 0 ELSE rs END,
    CASE WHEN coalesce(p_retailprice <= price_cap, false) THEN 0 ELSE rp END,
    CASE WHEN typ IS NULL OR coalesce(p_type = typ, false) THEN 0 ELSE rt END) AS level
    FROM wish w JOIN rks USING (request_id), cat),
best AS (SELECT *, min(level) OVER (PARTITION BY request_id) AS best
    FROM pairs WHERE level < 1000),
answer AS (SELECT request_id, level, row_number() OVER (
        PARTITION BY request_id ORDER BY p_retailprice, p_partkey) AS pos,
        p_retailprice, p_partkey, p_brand, p_type, p_size
    FROM best WHERE level = best QUALIFY pos <= 3),
levels AS (SELECT r.request_id, coalesce(a.level, r.n_labels) AS level, a.level IS NULL AS is_empty
    FROM rks r LEFT JOIN (SELECT DISTINCT request_id, level FROM answer) a USING (request_id))"""

# Conditions left at the level reached.
KEPT = """
kept AS (SELECT c.* FROM conditions c JOIN levels v USING (request_id)
    LEFT JOIN ranked r ON r.request_id = c.request_id AND r.col = c.col AND r.rk <= v.level
    WHERE r.col IS NULL)"""

# Requests of suppliers on order lines: five numeric columns and two flags.
WIDE = """
scored AS (SELECT s_suppkey AS k, l.col, row_number() OVER (PARTITION BY s_suppkey
        ORDER BY (s_suppkey * 31 + l.i * 17) % 100, l.col) AS rk
    FROM supplier, (VALUES (0, 'q'), (1, 'p'), (2, 'd'), (3, 't'), (4, 'n'), (5, 'r'), (6, 's')) l(i, col)),
rks AS (SELECT k, max(rk) FILTER (col = 'q') AS rq, max(rk) FILTER (col = 'p') AS rp,
    max(rk) FILTER (col = 'd') AS rd, max(rk) FILTER (col = 't') AS rt, max(rk) FILTER (col = 'n') AS rn,
    max(rk) FILTER (col = 'r') AS rr, max(rk) FILTER (col = 's') AS rs FROM scored GROUP BY k),
pairs AS (SELECT k AS request_id, l.*, l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey AS l_key,
    greatest(CASE WHEN l_quantity >= k % 5 * 10 THEN 0 ELSE rq END,
        CASE WHEN l_extendedprice <= (k % 7 + 1) * 10000 THEN 0 ELSE rp END,
        CASE WHEN l_discount BETWEEN [0.0::DOUBLE, 0.02::DOUBLE, 0.04::DOUBLE][k % 3 + 1]
            AND [0.05::DOUBLE, 0.07::DOUBLE, 0.1::DOUBLE][k % 3 + 1] THEN 0 ELSE rd END,
        CASE WHEN l_tax <= [0.02::DOUBLE, 0.05::DOUBLE][k % 2 + 1] THEN 0 ELSE rt END,
        CASE WHEN l_linenumber > k % 4 THEN 0 ELSE rn END,
        CASE WHEN l_returnflag IN (['A', 'N'][k % 2 + 1], ['R', 'N'][k % 2 + 1]) THEN 0 ELSE rr END,
        CASE WHEN l_linestatus = ['X', 'O', 'F'][k % 3 + 1] THEN 0 ELSE rs END) AS level
    FROM rks, lineitem l),
best AS (SELECT * FROM pairs QUALIFY level = min(level) OVER (PARTITION BY request_id))"""

# Spans of dates and texts on orders; the first columns stand for the labels.
RANGES = """
scored AS (SELECT s_suppkey AS k, l.i, row_number() OVER (PARTITION BY s_suppkey
        ORDER BY (s_suppkey * 31 + l.i * 17) % 100, l.col) AS rk
    FROM supplier, (VALUES (0, 'o_orderdate'), (1, 'o_orderpriority'), (2, 'o_totalprice')) l(i, col)),
rks AS (SELECT k, max(rk) FILTER (i = 0) AS rd, max(rk) FILTER (i = 1) AS rp, max(rk) FILTER (i = 2) AS rt,
    DATE '1995-01-01' + (k * 37 % 2900)::INTEGER AS since FROM scored GROUP BY k),
pairs AS (SELECT k AS request_id, o.*, greatest(
        CASE WHEN o_orderdate BETWEEN since AND since + (k % 60)::INTEGER THEN 0 ELSE rd END,
        CASE WHEN o_orderpriority >= (k % 6 + 1)::VARCHAR THEN 0 ELSE rp END,
        CASE WHEN o_totalprice <= (k % 9 + 1) * 20000 THEN 0 ELSE rt END) AS level
    FROM rks, orders o),
best AS (SELECT * FROM pairs QUALIFY level = min(level) OVER (PARTITION BY request_id))"""

# Wishes for brand and type alone; types are untidy and compared folded.
RELAXED_FOLDED = (
    RELAXED.replace("CASE WHEN p_partkey % 7 <> 0 THEN p_type END", """CASE WHEN p_partkey % 7 <> 0 THEN
        CASE p_partkey % 3 WHEN 0 THEN lower(p_type) WHEN 1 THEN ' ' || p_type || '  ' ELSE p_type END END""")
    .replace("coalesce(p_size <= size_cap, false)", "true")
    .replace("coalesce(p_retailprice <= price_cap, false)", "true")
    .replace("coalesce(p_type = typ, false)", "coalesce(lower(trim(p_type)) = lower(typ), false)")
)

# The type wish of the misspelt requests, and their test.
RELAXED_CLOSE = (
    RELAXED.replace("coalesce(p_type = typ, false)", """coalesce(
        contains(lower(trim(p_type)), typ) OR
        levenshtein(lower(trim(p_type)), typ) <= greatest(1, length(typ) // 4), false)""")
    .replace("THEN 'PROMO'", "THEN 'promos'")
    .replace("THEN 'ECONOMY'", "THEN 'econimy'")
    .replace("THEN 'SMALL'", "THEN 'mall'")
    .replace("THEN 'TINY'", "THEN 'tinny'")
)

RENDER = "string_agg(col || ' ' || op || ' ' || value, ' AND ' ORDER BY ord)"

SENTENCE = r"[^.!?]*[.!?]+[ \t\r\n]*|[^.!?]+"
BLANKS = r"[ \t\r\n]+"


def tokens(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{BLANKS}'), lambda t: t <> '')"


def windows(words: str, size: int, overlap: int) -> str:
    step = size - overlap
    count = f"greatest(ceil((len({words}) - {overlap}) / {step}.0)::BIGINT, 1)"
    return (
        f"list_transform(range({count}), "
        f"lambda i: list_slice({words}, i * {step} + 1, i * {step} + {size}))"
    )


def filled(size: int, overlap: int) -> str:
    """CTEs ending in `filled(doc_id, chunk_no, n_tokens, chunk_text)`: sentences found by the
    running count of words, upto[i] of those before piece i, from one chunk's first to the next's."""
    return f"""cut AS (SELECT doc_id, flatten(list_transform(list_filter(list_transform(
        regexp_extract_all(text, '{SENTENCE}'), lambda s: {tokens("s")}), lambda w: len(w) > 0),
        lambda w: {windows("w", size, 0)})) AS pieces FROM documents WHERE text IS NOT NULL),
    ends AS (SELECT doc_id, unnest(range(1, len(pieces) + 1)) AS i, unnest(pieces) AS piece FROM cut),
    sums AS (SELECT doc_id, list_prepend(0, list(upto ORDER BY i)) AS upto FROM (
        SELECT doc_id, i, (sum(len(piece)) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS upto FROM ends)
        GROUP BY doc_id),
    steps(doc_id, chunk_no, a, b) AS (
        SELECT doc_id, 0::BIGINT, 1::BIGINT, len(list_filter(upto, lambda u: u <= {size}))::BIGINT - 1 FROM sums
        UNION ALL
        SELECT doc_id, chunk_no + 1, a, len(list_filter(upto, lambda u: u <= upto[a] + {size}))::BIGINT - 1 FROM (
            SELECT doc_id, chunk_no, upto, list_min(list_filter(range(a, b + 2), lambda j:
                upto[b + 1] - upto[j] <= {overlap} AND upto[b + 2] - upto[j] <= {size})) AS a
            FROM steps JOIN sums USING (doc_id) WHERE b + 1 < len(upto))),
    filled AS (
        SELECT doc_id, chunk_no::INTEGER AS chunk_no, upto[b + 1] - upto[a] AS n_tokens, array_to_string(
            list_transform(list_slice(pieces, a, b), lambda w: array_to_string(w, ' ')), ' ') AS chunk_text
        FROM steps JOIN sums USING (doc_id) JOIN cut USING (doc_id)
        UNION ALL SELECT doc_id, 0, 0, '' FROM cut WHERE len(pieces) = 0)"""


def semantic(percentile: float) -> str:
    """CTEs ending in `semantic(doc_id, source, text, chunks)`, neighbours one each way."""
    return f"""
parts AS (SELECT doc_id, source, text, regexp_extract_all(text, '{SENTENCE}') AS s FROM documents),
words AS (SELECT *, list_transform(s, lambda x: list_distinct({tokens("lower(x)")})) AS w FROM parts),
grouped AS (SELECT *, list_transform(range(1, len(w) + 1), lambda i:
        list_distinct(flatten(list_slice(w, greatest(i - 1, 1), i + 1)))) AS g FROM words),
distances AS (SELECT *, list_transform(range(1, len(g)), lambda i: CASE
        WHEN len(g[i]) + len(g[i + 1]) = 0 THEN 0.0::DOUBLE
        ELSE 1 - len(list_intersect(g[i], g[i + 1]))::DOUBLE
            / (len(g[i]) + len(g[i + 1]) - len(list_intersect(g[i], g[i + 1]))) END) AS d FROM grouped),
cuts AS (SELECT *, list_aggregate(d, 'quantile_cont', {percentile / 100}) AS cut FROM distances),
starts AS (SELECT doc_id, source, text, s,
        [1] || list_filter(range(2, len(s) + 1), lambda i: d[i - 1] > cut) AS b FROM cuts),
semantic AS (SELECT doc_id, source, text, list_transform(range(1, len(b) + 1), lambda j:
        array_to_string(list_slice(s, b[j], coalesce(b[j + 1], len(s) + 1) - 1), '')) AS chunks FROM starts)"""


def exploded(source: str, chunks: str) -> str:
    return f"""SELECT doc_id, (unnest(range(len({chunks}))))::INTEGER AS chunk_no,
    unnest({chunks}) AS chunk_text FROM {source}"""


def chunk_rows(source: str, chunks: str) -> str:
    return f"""SELECT doc_id, chunk_no, len({tokens("chunk_text")})::INTEGER AS n_tokens, chunk_text
    FROM ({exploded(source, chunks)})"""


WINDOW_TEXTS = "list_transform({w}, lambda w: array_to_string(w, ' '))"

CENTROIDS = """
cells AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM cells GROUP BY label, pos),
centroids AS (SELECT label, list(x ORDER BY pos) AS center FROM means GROUP BY label),
cosines AS (SELECT vec_id, c.label, list_cosine_similarity(embedding::DOUBLE[], center) AS score
    FROM embeddings, centroids c)"""

NEAREST = f"""{CENTROIDS},
nearest AS (SELECT *, row_number() OVER (
    PARTITION BY label ORDER BY round(score, 9) DESC, vec_id) AS rank FROM cosines QUALIFY rank <= 5)"""

LETTERS = "(VALUES ('e', 'brand'), ('i', 'delivery'), ('n', 'price'), ('t', 'size'), ('r', 'type')) l(letter, label)"

TURNS = f"""
turns AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn_no
    FROM conversations WHERE role = 'user'),
weights AS (SELECT conv_id, turn_no, label, round((length(lower(text))
        - length(replace(lower(text), letter, '')))::DOUBLE / length(lower(text)), 6) AS weight
    FROM turns, {LETTERS} WHERE length(text) > 0),
heavy AS (SELECT * FROM weights WHERE weight > 0)"""


def weight_in(items: str) -> str:
    return f"coalesce(list_filter({items}, lambda x: x.label = l)[1].weight, 0)"


# Needs WITH RECURSIVE.
FOLD = f"""{TURNS},
lists AS (SELECT conv_id, turn_no, list({{'weight': weight, 'label': label}} ORDER BY weight, label) AS items
    FROM heavy GROUP BY conv_id, turn_no),
told AS (SELECT conv_id, turn_no, length(text) % 4 AS level, coalesce(items, []) AS items
    FROM turns LEFT JOIN lists USING (conv_id, turn_no)),
fold AS (
    SELECT conv_id, turn_no, items FROM told WHERE turn_no = 0
    UNION ALL
    SELECT conv_id, turn_no, list_slice(m, coalesce(list_filter(range(1, len(m) + 1), lambda i:
            m[i].weight / (turn_no + 1) >= 0.2 AND i - 1 <= level)[1], 1), len(m)) AS items
    FROM (SELECT t.conv_id, t.turn_no, t.level, list_sort(list_transform(list_distinct(
            list_transform(f.items, lambda x: x.label) || list_transform(t.items, lambda x: x.label)),
            lambda l: {{'weight': {weight_in("f.items")} + {weight_in("t.items")}, 'label': l}})) AS m
        FROM fold f JOIN told t ON t.conv_id = f.conv_id AND t.turn_no = f.turn_no + 1))"""

SESSION = f"""WITH RECURSIVE {FOLD},
final AS (SELECT * FROM fold QUALIFY turn_no = max(turn_no) OVER (PARTITION BY conv_id))
SELECT conv_id, chat_length, rk, item.label AS label, round(item.weight, 6) AS weight FROM (
    SELECT conv_id, turn_no + 1 AS chat_length, unnest(range(1, len(items) + 1)) AS rk,
        unnest(items) AS item FROM final)"""

EVERY_TURN = f"""RECURSIVE {FOLD},
stored AS (SELECT conv_id, turn_no + 1 AS turn_no, unnest(items) AS item FROM fold),
merged AS (SELECT conv_id, turn_no, label, sum(weight) AS weight FROM (
        SELECT conv_id, turn_no, label, weight FROM heavy
        UNION ALL SELECT conv_id, turn_no, item.label, item.weight FROM stored JOIN turns USING (conv_id, turn_no))
    GROUP BY conv_id, turn_no, label),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn_no ORDER BY weight, label) AS rk FROM merged),
memory AS (SELECT conv_id, turn_no, min(CASE WHEN turn_no > 0 AND weight / (turn_no + 1) >= 0.2
        AND rk - 1 <= length(text) % 4 THEN rk END) AS memory
    FROM ordered JOIN turns USING (conv_id, turn_no) GROUP BY conv_id, turn_no)"""


ORACLE: dict[str, str] = {
    "scan_catalog_csv": """SELECT * REPLACE (' a "' || p_name || '",' || chr(10) || 'b, ' || p_name || ' ' AS p_name)
        FROM part""",
    "scan_documents": """SELECT lang, source, count(*) AS n, sum(length(text))::BIGINT AS length
        FROM documents GROUP BY lang, source""",
    "classifier_response": f"WITH {SCORES} SELECT request_id, col, score FROM scores",
    "result_envelope": f"""WITH {RELAXED}, {KEPT},
        sql AS (SELECT request_id, {RENDER} AS sql_query FROM conditions GROUP BY request_id),
        final AS (SELECT request_id, {RENDER} AS final_query FROM kept GROUP BY request_id),
        labels AS (SELECT request_id, string_agg(col, ',' ORDER BY rk) AS labels,
            string_agg(score::VARCHAR, ',' ORDER BY rk) AS weights FROM ranked GROUP BY request_id),
        plans AS (SELECT request_id, string_agg(p_partkey::VARCHAR, ',' ORDER BY pos) AS plan_keys,
            string_agg(p_brand, ',' ORDER BY pos) AS plan_p_brand, string_agg(p_type, ',' ORDER BY pos) AS plan_p_type,
            string_agg(p_size::VARCHAR, ',' ORDER BY pos) AS plan_p_size,
            string_agg(p_retailprice::VARCHAR, ',' ORDER BY pos) AS plan_p_retailprice FROM answer GROUP BY request_id),
        asked AS (SELECT *, c_custkey % 50 = 0 AND c_mktsegment <> 'FURNITURE' AS bad FROM customer)
        SELECT c_custkey AS request_id, CASE WHEN bad THEN 500 ELSE 200 END AS status,
            CASE WHEN NOT bad THEN 'Something for ' || c_name END AS user_query,
            CASE WHEN NOT bad THEN sql_query END AS sql_query,
            CASE WHEN NOT bad THEN coalesce(final_query, '') END AS final_query,
            CASE WHEN bad THEN '' ELSE labels END AS labels, CASE WHEN bad THEN '' ELSE weights END AS weights,
            CASE WHEN bad THEN '' ELSE coalesce(plan_keys, '') END AS plan_keys,
            CASE WHEN bad THEN '' ELSE coalesce(plan_p_brand, '') END AS plan_p_brand,
            CASE WHEN bad THEN '' ELSE coalesce(plan_p_type, '') END AS plan_p_type,
            CASE WHEN bad THEN '' ELSE coalesce(plan_p_size, '') END AS plan_p_size,
            CASE WHEN bad THEN '' ELSE coalesce(plan_p_retailprice, '') END AS plan_p_retailprice,
            CASE WHEN bad THEN '>= does not suit column: p_type' END AS error
        FROM asked LEFT JOIN sql ON c_custkey = sql.request_id
            LEFT JOIN final ON c_custkey = final.request_id
            LEFT JOIN labels ON c_custkey = labels.request_id
            LEFT JOIN plans ON c_custkey = plans.request_id""",
    "filter_conjunction": """SELECT * FROM part
        WHERE p_type = 'ECONOMY' AND p_size <= 20 AND p_retailprice <= 950""",
    "predicate_ops": """SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem
        WHERE l_linestatus = 'F' AND l_discount >= 0.02::DOUBLE AND l_tax <= 0.06::DOUBLE
          AND l_extendedprice < 60000 AND l_linenumber > 1 AND l_quantity BETWEEN 10 AND 30
          AND l_returnflag IN ('A', 'R')""",
    "fuzzy_category": """SELECT p_partkey, p_type, p_name FROM part
        WHERE levenshtein(lower(trim(p_type)), 'economic') <= 2 OR contains(lower(trim(p_type)), 'economic')
           OR levenshtein(lower(trim(p_name)), 'widge') <= 1 OR contains(lower(trim(p_name)), 'widge')""",
    "normalize_category": r"""SELECT lower(trim(regexp_replace(
            '  ' || upper(p_name) || '   Add ' || chr(9) || ' On  ' || p_type || ' ', '\s+', ' ', 'g'))) AS category,
        count(*) AS n FROM part GROUP BY category""",
    "unlimited_sentinel": """WITH m AS (SELECT p_brand,
            CASE WHEN p_size >= 40 THEN 99999999 ELSE p_size END AS minutes FROM part)
        SELECT p_brand, round(avg(minutes) FILTER (minutes <> 99999999), 6) AS average,
            count(*) FILTER (minutes = 99999999) AS n_unlimited,
            count(*) FILTER (minutes >= 30) AS n_at_least_30 FROM m GROUP BY p_brand""",
    "project_requested": "SELECT p_brand, p_size, p_partkey FROM part",
    "project_fallback": "SELECT * FROM part",
    "parse_column_list": """WITH reply AS (SELECT c_custkey AS request_id, c_mktsegment AS m, c_name FROM customer)
        SELECT request_id,
            CASE m WHEN 'AUTOMOBILE' THEN '[''p_brand'', ''p_size'']'
                WHEN 'BUILDING' THEN '["p_type",''' || c_name || ''']'
                WHEN 'FURNITURE' THEN '[''' || c_name || ''',''m'']]'
                WHEN 'MACHINERY' THEN '' END AS slice,
            CASE m WHEN 'AUTOMOBILE' THEN 'p_brand|p_size'
                WHEN 'BUILDING' THEN 'p_type|' || c_name ELSE '' END AS names,
            CASE WHEN m IN ('AUTOMOBILE', 'BUILDING') THEN 2 ELSE -1 END AS n_names,
            m NOT IN ('AUTOMOBILE', 'BUILDING') AS bad FROM reply""",
    "missing_reply": """SELECT q.conv_id, q.turn, coalesce(a.text, 'Nothing found') AS reply
        FROM conversations q LEFT JOIN conversations a
            ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant'
        WHERE q.role = 'user'""",
    "relax_single": f"""WITH {CATALOG},
        leveled AS (SELECT *, greatest(CASE WHEN coalesce(p_type = 'TINY', false) THEN 0 ELSE 1 END,
            CASE WHEN coalesce(p_brand = 'Brand#7', false) THEN 0 ELSE 2 END) AS level FROM cat)
        SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice, level
        FROM leveled QUALIFY level = min(level) OVER ()""",
    "relax_batch": f"WITH {RELAXED} SELECT * FROM answer",
    "relax_batch_close": f"WITH {RELAXED_CLOSE} SELECT * FROM answer",
    "relax_batch_wide": f"""WITH {WIDE}
        SELECT request_id, level, row_number() OVER (PARTITION BY request_id ORDER BY l_extendedprice, l_key) AS pos,
            l_extendedprice, l_key, l_quantity, l_linestatus FROM best QUALIFY pos <= 3""",
    "relax_batch_ranges": f"""WITH {RANGES}
        SELECT request_id, level, row_number() OVER (PARTITION BY request_id ORDER BY o_totalprice, o_orderkey) AS pos,
            o_totalprice, o_orderkey, o_orderpriority FROM best QUALIFY pos <= 3""",
    "relax_batch_folded": f"WITH {RELAXED_FOLDED} SELECT request_id, level, pos, p_retailprice, p_partkey, p_brand, p_type FROM answer",
    "relax_level": f"""WITH {RELAXED}
        SELECT v.request_id, v.level, coalesce(string_agg(r.col, ',' ORDER BY r.rk), '') AS dropped
        FROM levels v LEFT JOIN ranked r ON r.request_id = v.request_id AND r.rk <= v.level
        GROUP BY v.request_id, v.level""",
    "is_empty": f"WITH {RELAXED} SELECT request_id, is_empty FROM levels",
    "drop_conditions_on": f"WITH {RELAXED}, {KEPT} SELECT request_id, ord, col, op, value FROM kept",
    "render_final_query": f"""WITH {RELAXED}, {KEPT}
        SELECT request_id, {RENDER} AS final_query FROM kept GROUP BY request_id""",
    "rank_relevance": f"WITH {SCORES} SELECT request_id, col, score, rk FROM ranked",
    "score_relevance": f"WITH {CENTROIDS} SELECT vec_id, label, round(score, 6) AS score FROM cosines",
    "sort_by_price": "SELECT p_brand, p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey",
    "top3": "SELECT * FROM part ORDER BY p_retailprice NULLS LAST, p_partkey LIMIT 3",
    "rows_to_column_map": """WITH best AS (SELECT *, row_number() OVER (
            PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS pos FROM part QUALIFY pos <= 3)
        SELECT p_brand, column_name, (pos - 1)::INTEGER AS place, p_partkey AS row_key, value FROM (
            SELECT p_brand, pos, p_partkey, 'p_name' AS column_name, p_name AS value FROM best
            UNION ALL SELECT p_brand, pos, p_partkey, 'p_type', p_type FROM best
            UNION ALL SELECT p_brand, pos, p_partkey, 'p_retailprice', p_retailprice::VARCHAR FROM best)""",
    "chunk_static": f"""WITH w AS (SELECT doc_id, {tokens("text")} AS words FROM documents),
        c AS (SELECT doc_id, {WINDOW_TEXTS.format(w=windows("words", 512, 20))} AS chunks FROM w)
        {chunk_rows("c", "chunks")}""",
    "chunk_sentences": f"""WITH RECURSIVE {filled(100, 20)}
        SELECT doc_id, chunk_no, n_tokens::INTEGER AS n_tokens, chunk_text FROM filled""",
    "chunk_semantic": f"WITH {semantic(95.0)} {chunk_rows('semantic', 'chunks')}",
    "chunk_guarded_doc": f"""WITH {semantic(95.0)},
        sized AS (SELECT *, list_max(list_transform(chunks, lambda c: len({tokens("c")}))) AS largest,
            {tokens("text")} AS words FROM semantic),
        chosen AS (SELECT doc_id, CASE WHEN largest > 200
            THEN {WINDOW_TEXTS.format(w=windows("words", 200, 20))} ELSE chunks END AS chunks FROM sized)
        {chunk_rows("chosen", "chunks")}""",
    "chunk_guarded_batch": f"""WITH {semantic(95.0)},
        sized AS (SELECT *, list_max(list_transform(chunks, lambda c: len({tokens("c")}))) AS largest,
            {tokens("text")} AS words FROM semantic),
        flagged AS (SELECT *, max(largest) OVER (PARTITION BY source) AS batch_largest FROM sized),
        chosen AS (SELECT doc_id, CASE WHEN batch_largest > 400
            THEN {WINDOW_TEXTS.format(w=windows("words", 400, 20))} ELSE chunks END AS chunks FROM flagged)
        {chunk_rows("chosen", "chunks")}""",
    "cosine_topk": f"WITH {NEAREST} SELECT vec_id, label, round(score, 6) AS score, rank FROM nearest",
    "ann_recall": f"WITH {NEAREST} SELECT label, count(*) AS n_found, true AS reached FROM nearest GROUP BY label",
    "index_recall": """SELECT 10 * count(*) AS n_found, true AS reached
        FROM embeddings WHERE vec_id % 20 = 0 AND embedding IS NOT NULL""",
    "assemble_context": f"""WITH {NEAREST},
        context AS (SELECT label, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY rank) AS context
            FROM nearest LEFT JOIN documents ON vec_id = doc_id GROUP BY label)
        SELECT label, 'What is said about topic ' || label || '?' || chr(10) || chr(10)
            || 'Given the context:' || chr(10) || coalesce(context, '') AS prompt
        FROM (SELECT DISTINCT label FROM embeddings) LEFT JOIN context USING (label)""",
    "merge_weights": f"WITH {EVERY_TURN} SELECT conv_id, turn_no, label, round(weight, 6) AS weight FROM merged",
    "order_weights": f"WITH {EVERY_TURN} SELECT conv_id, turn_no, label, round(weight, 6) AS weight, rk FROM ordered",
    "memory_point": f"WITH {EVERY_TURN} SELECT conv_id, turn_no, memory FROM memory",
    "truncate_memory": f"""WITH {EVERY_TURN}
        SELECT conv_id, turn_no, label, round(weight, 6) AS weight, rk, turn_no + 1 AS chat_length
        FROM ordered JOIN memory USING (conv_id, turn_no) WHERE rk >= coalesce(memory, 1)""",
    "remembered_conditions": f"""WITH {EVERY_TURN}
        SELECT conv_id, turn_no, label AS col, h.weight AS value FROM heavy h
            JOIN ordered USING (conv_id, turn_no, label) JOIN memory USING (conv_id, turn_no)
        WHERE rk >= coalesce(memory, 1)""",
    "session_fold": SESSION,
    "session_stream": SESSION,
    "q_match": """WITH leveled AS (SELECT *, greatest(CASE WHEN p_size <= 0 THEN 0 ELSE 1 END,
            CASE WHEN p_type = 'PROMO' THEN 0 ELSE 2 END,
            CASE WHEN p_brand = 'Brand#3' THEN 0 ELSE 3 END) AS level FROM part)
        SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice
        FROM leveled QUALIFY level = min(level) OVER ()""",
    "q_argmax_count": """SELECT n_name, n FROM (SELECT c_nationkey, count(*) AS n FROM customer
            GROUP BY c_nationkey ORDER BY n DESC, c_nationkey LIMIT 1)
        JOIN nation ON c_nationkey = n_nationkey""",
    "q_count_where": "SELECT count(*) AS n FROM part WHERE p_type = 'SMALL'",
    "q_argmin_group": """SELECT p_brand, p_retailprice FROM part WHERE p_type = 'ECONOMY'
        ORDER BY p_retailprice, p_partkey LIMIT 1""",
    "q_avg_where": """SELECT o_orderpriority, round(avg(o_totalprice), 6) AS average, count(*) AS n
        FROM orders WHERE o_totalprice >= 100000 GROUP BY o_orderpriority""",
    "q_budget_near": """SELECT round(min(c_acctbal), 6) AS low,
            round(quantile_cont(c_acctbal, 0.25), 6) AS q25, round(quantile_cont(c_acctbal, 0.5), 6) AS median,
            round(quantile_cont(c_acctbal, 0.75), 6) AS q75, round(max(c_acctbal), 6) AS high
        FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (
            SELECT n_regionkey FROM nation WHERE n_name = 'NATION_3'))""",
    "q_rank_price": """SELECT p_partkey, p_retailprice, rank() OVER (ORDER BY p_retailprice) AS rank,
        dense_rank() OVER (ORDER BY p_retailprice) AS dense_rank FROM part""",
    "q_bounded_has_all": """SELECT * FROM part WHERE p_size <= 30
        AND list_contains(string_split(p_name, ' '), 'red') AND list_contains(string_split(p_name, ' '), 'widget')""",
    "q_correlation": "SELECT round(corr(p_size, p_retailprice), 6) AS correlation FROM part",
    "q_argmax_excluding": """WITH stats AS (SELECT p_brand, round(avg(p_retailprice), 9) AS mean,
            count(*) FILTER (p_type = 'ECONOMY') AS n FROM part GROUP BY p_brand)
        SELECT p_brand, n FROM stats
        WHERE n > 0 AND mean <= (SELECT quantile_cont(mean, 0.5) FROM stats)
        ORDER BY n DESC, p_brand LIMIT 1""",
    "q_budget_unlimited": """SELECT p_partkey, p_retailprice, 99999999 AS minutes FROM part
        WHERE p_retailprice <= 950 AND p_size >= 40""",
    "q_at_least": """SELECT l_quantity, l_orderkey, l_linenumber, l_extendedprice
        FROM lineitem WHERE l_quantity >= 30""",
}
