"""The same results as DuckDB SQL, for the operators that SQL can express."""

from __future__ import annotations

from barwise.llm import line_dedup

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _unescaped(text: str) -> str:
    for entity, char in line_dedup.ENTITIES.items():
        text = f"replace({text}, {_quoted(entity)}, {_quoted(char)})"
    return text


ORACLES: dict[str, str] = {
    "op7_exact_dedup": f"""WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
            sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op6_line_dedup": f"""WITH p AS (
            SELECT page_id, nullif(lower(regexp_extract(url, {_quoted(line_dedup.HOST)}, 1)), '') AS host,
                list_filter(list_transform(string_split({_unescaped(
                    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), "
                    + _quoted(line_dedup.UNSEEN) + ", '', 'g'), '[\\r\\n]', ' ', 'g'), "
                    + _quoted(line_dedup.BREAKS) + ", chr(10), 'g'), '<[^>]*>', '', 'g')"
                )}, chr(10)), lambda x: trim(regexp_replace(x, '[\\x09-\\x0D\\x20]+', ' ', 'g'))), lambda x: x <> '') AS lines
            FROM pages),
        s AS (SELECT host, count(*) AS host_pages FROM p WHERE host IS NOT NULL GROUP BY host),
        l AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p WHERE host IS NOT NULL),
        b AS (SELECT host, list(line) AS common FROM (
                SELECT host, line FROM l JOIN s USING (host) GROUP BY host, line, host_pages
                HAVING count(*) >= {line_dedup.LEAST_PAGES} AND count(*) > {line_dedup.RATIO} * host_pages) GROUP BY host),
        k AS (SELECT p.*, host_pages,
                list_filter(lines, lambda x: NOT coalesce(list_contains(common, x), false)) AS kept
            FROM p LEFT JOIN s USING (host) LEFT JOIN b USING (host))
        SELECT page_id, host, host_pages, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
            array_to_string(kept, chr(10)) AS text FROM k""",
    "op11_hard_negatives": """WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, a.label AS own, r.vec_id, r.label, list_dot_product(a.v, r.v)::BIGINT AS score
            FROM v a JOIN v r ON len(a.v) = len(r.v) AND a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = own
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id,
            (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
            vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE label <> own AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY rank <= 10""",
    "op12_lexical_search": rf"""WITH d AS (
            SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS terms FROM documents),
        g AS (SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_all FROM d WHERE len(terms) > 0),
        t AS (SELECT doc_id, any_value(len(terms))::BIGINT AS n, term, count(*) AS tf
            FROM (SELECT doc_id, terms, unnest(terms) AS term FROM d) GROUP BY doc_id, term),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS term FROM benchmark),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM t WHERE term IN (SELECT term FROM q) GROUP BY term), g),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * n_docs) // n_all)))))::BIGINT AS score
            FROM q JOIN t USING (term) JOIN w USING (term), g GROUP BY item_id, doc_id)
        SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
        FROM s WHERE score > 0 QUALIFY rank <= 50""",
    "op13_warc": """WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex
            FROM pages)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + ((('0x' || substr(hex, (5 * i // 4 + 1)::INT, 2))::INT >> (3 - 5 * i % 4)::INT) & 31), 1)), '') AS payload_digest,
            CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
        FROM p WINDOW w AS (PARTITION BY body)""",
}
