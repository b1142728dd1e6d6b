"""DuckDB counterparts of the training-data queries that SQL can express."""

from __future__ import annotations

from . import licenses, rules

OP1 = r"""WITH p AS (SELECT page_id, url, lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]+)', 1), '\.+$', '')) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path, 1704067200 + (page_id * 7919 % 2160) * 3600 AS ts FROM pages),
 vs AS (SELECT 'domain' AS kind, host AS value FROM p WHERE host <> '' UNION SELECT 'path', host || '/' || lower(split_part(path, '/', 2)) FROM p WHERE host <> '' AND path NOT IN ('', '/')),
 v AS (SELECT kind, value, CAST('0x' || substr(md5(value), 1, 7) AS BIGINT) AS c FROM vs),
 e AS (SELECT kind, value, 'add' AS action, 1704067200 + c % 50 * 86400 AS ts FROM v WHERE c % 3 = 0 UNION ALL SELECT kind, value, 'remove', 1704067200 + (c % 50 + 10 + c % 17) * 86400 FROM v WHERE c % 3 = 0 AND c % 4 > 0 UNION ALL SELECT kind, value, 'add', 1704067200 + (c % 50 + 33) * 86400 FROM v WHERE c % 3 = 0 AND c % 8 = 1),
 t AS (SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY kind, value ORDER BY ts, action DESC) AS before FROM e) WHERE action <> coalesce(before, 'remove')),
 s AS (SELECT kind, value, ts AS since, until FROM (SELECT *, lead(ts) OVER (PARTITION BY kind, value ORDER BY ts, action DESC) AS until FROM t) WHERE action = 'add'),
 k AS (SELECT page_id, ts, host, string_split(host, '.') AS ls, list_filter(string_split(lower(path), '/'), lambda x: x <> '') AS ps, lower(regexp_replace(url, '#.*$', '')) AS u FROM p WHERE host <> ''),
 q AS (SELECT page_id, ts, 'domain' AS kind, array_to_string(ls[len(ls) - i + 1:], '.') AS value FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM k) UNION ALL SELECT page_id, ts, 'path', host || '/' || array_to_string(ps[1:i], '/') FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM k) UNION ALL SELECT page_id, ts, 'url', u FROM k),
 m AS (SELECT page_id, list_sort(list(DISTINCT q.kind || ':' || q.value)) AS ms FROM q JOIN s ON s.kind = q.kind AND s.value = q.value AND s.since <= q.ts AND (until IS NULL OR q.ts < until) GROUP BY page_id)
SELECT p.page_id, host, CAST(coalesce(len(ms), 0) AS BIGINT) AS n_matches, coalesce(array_to_string(ms, ' '), '') AS matches, ms IS NOT NULL AS blocked FROM p LEFT JOIN m USING (page_id)"""

OP3 = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM w WHERE len(w) >= 35),
 h AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM g),
 r AS (SELECT doc_id, i FROM h WHERE s IN (SELECT s FROM h GROUP BY s HAVING count(*) > 1)),
 c AS (SELECT DISTINCT doc_id, i + j AS p FROM r, range(35) t(j)),
 gone AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY doc_id),
 k AS (SELECT w.doc_id, w.w, gone.ps, list_filter(w.w, lambda x, i: ps IS NULL OR NOT list_contains(ps, i)) AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k"""

OP6 = r"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
 n AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
 bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM n)),
 dw AS (SELECT doc_id, i, z.n, array_to_string(w[i:i + z.n - 1], ' ') AS s FROM (SELECT doc_id, w, l.n AS n, unnest(range(1, len(w) - l.n + 2)) AS i FROM d, (SELECT DISTINCT n FROM n) l WHERE len(w) >= l.n) z),
 h AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
 p AS (SELECT doc_id, count(DISTINCT i + j) AS hit FROM h, range(10) t(j) WHERE j < n GROUP BY doc_id),
 q AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, ids IS NOT NULL AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)"""

OP8 = rf"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 c AS (SELECT *, [length(regexp_replace(t, '[^a-z]+', '', 'g')), length(regexp_replace(t, '[^\x20\x09-\x0D]+', '', 'g')), length(regexp_replace(t, '[^A-Z]+', '', 'g')), length(regexp_replace(t, '[^0-9]+', '', 'g')), length(regexp_replace(t, '[^.,;:!?''\x22()-]+', '', 'g'))] AS k5, length(regexp_replace(t, '[\x00-\x7F]+', '', 'g')) AS other FROM d),
 m AS (SELECT *, list_concat(k5, [length(t) - list_sum(k5) - other, other]) AS k FROM c),
 x AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM d) GROUP BY ALL),
 ks AS (SELECT lang, sum(len(w)) AS nw, [sum(k[1]), sum(k[2]), sum(k[3]), sum(k[4]), sum(k[5]), sum(k[6]), sum(k[7])] AS rk FROM m GROUP BY lang),
 al AS (SELECT NULL AS lang, sum(len(w)) AS nw, [sum(k[1]), sum(k[2]), sum(k[3]), sum(k[4]), sum(k[5]), sum(k[6]), sum(k[7])] AS rk FROM m),
 kk AS (SELECT * FROM ks WHERE lang IS NOT NULL AND nw >= {rules.LEAST_REFERENCE} AND nw * {rules.LEAST_SHARE} >= (SELECT nw FROM al) UNION ALL SELECT * FROM al),
 x2 AS (SELECT lang, word, n FROM x WHERE lang IN (SELECT lang FROM kk WHERE lang IS NOT NULL) UNION ALL SELECT NULL, word, sum(n) FROM x GROUP BY word),
 top AS (SELECT lang, list(word ORDER BY r) AS ws, list(CAST(n AS BIGINT) ORDER BY r) AS ns FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM x2) WHERE r <= {rules.COMMON} GROUP BY lang),
 ref AS (SELECT kk.lang, ws, list_concat(ns, [nw - list_sum(ns)]) AS rn, rk FROM kk JOIN top ON top.lang IS NOT DISTINCT FROM kk.lang),
 g AS (SELECT doc_id, i, hash FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS hash FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3))),
 rp AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, hash) AS c FROM g), range(3) t(j) WHERE c > 1 GROUP BY doc_id),
 ln AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 s AS (SELECT m.doc_id, len(w) AS nw, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS wc, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS ns, coalesce(ln.n, 0) AS nd, coalesce(rp.n, 0) AS nr, k, rk, rn,
  list_concat(list_transform(ws, lambda v: len(list_filter(w, lambda q: q = v))), [len(list_filter(w, lambda q: NOT list_contains(ws, q)))]) AS hist FROM m LEFT JOIN ref ON ref.lang IS NOT DISTINCT FROM CASE WHEN m.lang IN (SELECT lang FROM kk WHERE lang IS NOT NULL) THEN m.lang END LEFT JOIN rp ON rp.doc_id = m.doc_id LEFT JOIN ln ON ln.doc_id = m.doc_id),
 j AS (SELECT *, list_transform(k, lambda v: v / nullif(list_sum(k), 0)) AS p1, list_transform(rk, lambda v: v / list_sum(rk)) AS q1, list_transform(hist, lambda v: v / nullif(list_sum(hist), 0)) AS p2, list_transform(rn, lambda v: v / list_sum(rn)) AS q2 FROM s),
 y AS (SELECT *, sqrt(greatest(0, list_sum(list_transform(range(1, 8), lambda i: (CASE WHEN p1[i] > 0 THEN p1[i] * log2(2 * p1[i] / (p1[i] + q1[i])) ELSE 0 END) + (CASE WHEN q1[i] > 0 THEN q1[i] * log2(2 * q1[i] / (p1[i] + q1[i])) ELSE 0 END))) / 2)) AS js1,
  sqrt(greatest(0, list_sum(list_transform(range(1, len(rn) + 1), lambda i: (CASE WHEN p2[i] > 0 THEN p2[i] * log2(2 * p2[i] / (p2[i] + q2[i])) ELSE 0 END) + (CASE WHEN q2[i] > 0 THEN q2[i] * log2(2 * q2[i] / (p2[i] + q2[i])) ELSE 0 END))) / 2)) AS js2 FROM j)
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(ns AS BIGINT) AS n_symbols, CAST(nd AS BIGINT) AS n_dup_lines, CAST(nr AS BIGINT) AS n_repeat_words, nw < 50 OR 100 * nr > 50 * nw AS base_failed,
 NOT (nw < 50 OR 100 * nr > 50 * nw) AND NOT (wc >= {rules.MIN_CHARS} AND js1 > {rules.MAX_CLASS_JS}) AND NOT (nw >= {rules.MIN_WORDS} AND js2 > {rules.MAX_WORD_JS}) AS kept FROM y"""

OP10 = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
 i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
 m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, d.doc_id = coalesce(m.c, d.doc_id) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = d.doc_id"""

OP11 = r"""WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS (SELECT a.id AS anchor_id, r.id, a.label = r.label AS same, CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score FROM v a JOIN v r ON a.id <> r.id WHERE a.id % 100 = 0),
 p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
 n AS (SELECT anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10"""

OP12 = r"""WITH p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
 g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 30),
 n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
 c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1),
 s AS (SELECT q.lang, q.phrase, a, cut, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (l.f + r.f) AS BIGINT) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM c) q
  JOIN g l ON l.lang = q.lang AND l.k = cut AND l.phrase = array_to_string(w[1:cut], ' ') JOIN g r ON r.lang = q.lang AND r.k = q.k - cut AND r.phrase = array_to_string(w[cut + 1:q.k], ' ')),
 m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
 x AS (SELECT lang, phrase, max(a) AS f FROM (SELECT lang, a, array_to_string(w[i:i + z - 1], ' ') AS phrase FROM (SELECT lang, a, w, z, unnest(range(1, k - z + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS z) WHERE z < k)) GROUP BY ALL),
 y AS (SELECT m.* FROM m LEFT JOIN x USING (lang, phrase) WHERE f IS NULL OR CAST(100 AS HUGEINT) * f < CAST(80 AS HUGEINT) * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM y JOIN n USING (lang) QUALIFY rank <= 2000"""

_NOTICES = ", ".join(f"({i}, '{text}', '{label}')" for i, (text, label) in enumerate(licenses.NOTICES))
_PHRASES = ", ".join(f"('{text}', '{label}')" for text, label in licenses.PHRASES)
OP13 = rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
 n AS (SELECT notice, label, string_split(text, ' ') AS w FROM (VALUES {_NOTICES}) v(notice, text, label)),
 ng AS (SELECT notice, i - 1 AS t, array_to_string(w[i:i + {licenses.GRAM - 1}], ' ') AS g FROM (SELECT notice, w, unnest(range(1, len(w) - {licenses.GRAM - 2})) AS i FROM n)),
 dg AS (SELECT doc_id, i - 1 AS d, array_to_string(w[i:i + {licenses.GRAM - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {licenses.GRAM - 2})) AS i FROM d WHERE len(w) >= {licenses.GRAM})),
 v AS (SELECT DISTINCT doc_id, notice, d - t AS diagonal, t FROM dg JOIN ng USING (g)),
 x AS (SELECT doc_id, notice, diagonal, sum(new) OVER (PARTITION BY doc_id, notice ORDER BY diagonal) AS grp FROM (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, notice ORDER BY diagonal) > {licenses.GAP} THEN 1 ELSE 0 END AS new FROM (SELECT DISTINCT doc_id, notice, diagonal FROM v))),
 c AS (SELECT doc_id, notice, grp, count(DISTINCT t + j) AS covered FROM v JOIN x USING (doc_id, notice, diagonal), range({licenses.GRAM}) r(j) GROUP BY ALL),
 s AS (SELECT doc_id, label, covered / len(w) AS cover FROM c JOIN n USING (notice) WHERE covered / len(w) >= {licenses.LEAST_COVER}),
 p AS (SELECT label, string_split(text, ' ') AS pw FROM (VALUES {_PHRASES}) v(text, label)),
 b AS (SELECT doc_id, label, i - 1 AS pl FROM (SELECT doc_id, w, label, pw, unnest(range(1, len(w) - len(pw) + 2)) AS i FROM d, p WHERE len(w) >= len(pw)) WHERE w[i:i + len(pw) - 1] = pw),
 bs AS (SELECT doc_id, count(*) AS n, min(pl) AS lo, max(pl) AS hi, list(DISTINCT label) AS ls FROM b GROUP BY doc_id),
 ss AS (SELECT doc_id, max(cover) AS m, list(DISTINCT label) AS ms FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, array_to_string(list_sort(coalesce(ls, [])), ',') AS base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(ls, []), coalesce(ms, [])))), ',') AS labels, coalesce(m, 0.0) AS score FROM d LEFT JOIN bs USING (doc_id) LEFT JOIN ss USING (doc_id)"""

ORACLES = {"op1_url_filters": OP1, "op3_substring_dedup": OP3, "op6_decontamination": OP6, "op8_quality_rules": OP8, "op10_minhash": OP10, "op11_hard_negatives": OP11, "op12_collocations": OP12, "op13_license_scans": OP13}
