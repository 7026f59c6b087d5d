"""SQL of the queries that SQL can express, for DuckDB over the same tables."""

from dateloom.llm.line_rules import BOILERPLATE

#: The list of entries_of and the captures of captures_of in SQL.
_URLS = r"""
    p AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 120 AS INT)) AS fetched,
                 regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.$', '') AS host,
                 list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS steps
          FROM pages),
    h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS k,
                 array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM p WHERE host <> ''),
    e AS (SELECT host AS pattern, k % 60 AS day, 'add' AS action FROM h WHERE k % 3 = 0
          UNION SELECT host, k % 60 + 20, 'remove' FROM h WHERE k % 6 = 0
          UNION SELECT host, k % 60 + 45, 'add' FROM h WHERE k % 9 = 0
          UNION SELECT domain, k % 90, 'add' FROM h WHERE k % 7 = 0
          UNION SELECT domain, k % 90 + 10, 'remove' FROM h WHERE k % 14 = 0
          UNION SELECT host || '/en', k % 100, 'add' FROM h WHERE k % 2 = 1)
"""

SQL: dict[str, str] = {
    "op5_url_filter": f"""
        WITH {_URLS},
        d AS (SELECT pattern, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT)) AS listed, max(action) AS action FROM e GROUP BY 1, 2),
        t AS (SELECT *, lag(action) OVER (PARTITION BY pattern ORDER BY listed) AS before FROM d),
        c AS (SELECT pattern, action, listed AS valid_from, lead(listed) OVER (PARTITION BY pattern ORDER BY listed) AS valid_to
              FROM t WHERE before IS NULL OR before <> action),
        k AS (SELECT page_id, url, fetched, host, unnest(list_distinct(
                 list_concat(list_transform(range(1, greatest(1, len(string_split(host, '.')) - 1) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
                             list_transform(range(1, len(steps) + 1), lambda i: host || '/' || array_to_string(steps[:i], '/'))))) AS key
              FROM p WHERE host <> ''),
        b AS (SELECT page_id, pattern, valid_from, valid_to FROM k JOIN c ON key = pattern AND action = 'add'
                 AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)
              QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, pattern DESC) = 1)
        SELECT p.page_id, p.url, strftime(p.fetched, '%Y-%m-%d %H:%M:%S') AS fetched, b.pattern IS NOT NULL AS blocked, b.pattern,
               strftime(b.valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(b.valid_to, '%Y-%m-%d %H:%M:%S') AS valid_to
        FROM p LEFT JOIN b USING (page_id)
    """,
    "op6_line_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
        g AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
        n AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        l AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '') AS lw FROM (SELECT doc_id, unnest(lines) AS line FROM w)),
        f AS (SELECT doc_id, length(array_to_string(lw, '')) AS chars,
                     len(list_filter(lw, lambda x: x LIKE '%!!')) > 0.3 * len(lw)
                     OR length(line) - length(translate(line, '#*$%&|<>', '')) > 0.1 * length(line)
                     OR (len(lw) >= 12 AND NOT regexp_matches(line, '[.!?:;…]["''”’»)]*([ \t-\r]|$)'))
                     OR len(list_filter(lw, lambda x: list_contains(['|', '•', '»', '>', '/', '·'], x))) > 0.2 * len(lw)
                     OR len(list_filter(range(1, len(lw)), lambda i: lw[i] = lw[i + 1])) > 0.5 * len(lw)
                     OR (len(lw) <= 40 AND regexp_matches(lower(line), '@')) AS failed
              FROM l),
        s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (failed) AS n_failed_lines, coalesce(sum(chars) FILTER (failed), 0) AS gone FROM f GROUP BY doc_id),
        o AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                     CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
                     CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n.n, 0) AS BIGINT) AS n_repeat_words,
                     CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines, coalesce(gone, 0) AS gone
              FROM w LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND gone / greatest(1, word_chars) <= 0.3 AS kept, n_lines, n_failed_lines
        FROM o
    """.replace("'@'", "'" + "|".join(BOILERPLATE) + "'"),
    "op7_line_chunks": r"""
        WITH l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
        w AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n,
                     CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) AS h FROM l WHERE regexp_matches(line, '[^ \t-\r]')),
        r AS (SELECT *, (h + 48271 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY k), 0)) % 2147483647 AS r FROM w),
        b AS (SELECT *, lag(r) OVER d AS r1, lag(r, 2) OVER d AS r2, lead(r) OVER d AS s1 FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY k)),
        c AS (SELECT *, sum(CASE WHEN k = 0 OR (k >= 2 AND k < n - 1 AND ((r < r1 AND r <= s1) OR (k % 2 = 0 AND r = r1 AND r = r2 AND r = s1))) THEN 1 ELSE 0 END)
                     OVER (PARTITION BY doc_id ORDER BY k) AS chunk_no FROM b),
        g AS (SELECT doc_id, min(k) AS k, string_agg(line, chr(10) ORDER BY k) AS chunk FROM c GROUP BY doc_id, chunk_no HAVING count(*) > 1),
        x AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) AS turn FROM g) WHERE turn > 1 GROUP BY 1),
        p AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY k) AS j, line, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM w
              UNION ALL SELECT doc_id, i, i, line, NULL FROM w WHERE len(list_filter(regexp_split_to_array(line, '[ \t-\r]+'), lambda x: x <> '')) >= 50),
        q AS (SELECT *, row_number() OVER (PARTITION BY line, next ORDER BY doc_id, i) AS turn FROM p WHERE j IS NOT NULL),
        o AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM q WHERE turn > 1),
        f AS (SELECT l.doc_id, l.i, l.line, o.i IS NOT NULL AS gone FROM l LEFT JOIN o USING (doc_id, i))
        SELECT doc_id, count(*) AS n_lines, coalesce(max(x.n), 0) AS n_removed_chunks, count(*) FILTER (gone) AS n_removed_lines,
               md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS text_md5
        FROM f LEFT JOIN x USING (doc_id) GROUP BY doc_id
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS digest FROM p),
             f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY digest)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN f USING (digest)
    """,
}
