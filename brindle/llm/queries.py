"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from .ann import op4_ann_lists
from .conversations import op11_trie_peeling
from .decontaminate import op2_decontaminate
from .htmltext import op3_html_template
from .langid import op10_langid_profiles
from .neardup import op7_neardup_probminhash
from .quality import op5_quality_weak
from .repeats import op13_repeats_anchor
from .runs import op12_runs_lpf
from .sentencepiece import op8_sentencepiece_unigram
from .shard import op1_shard_kk
from .tokens_orc import op9_tokens_orc
from .warc import op6_warc_zstd

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win
  FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, x.i AS i, n, x.win AS win
  FROM (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: struct_pack(i := i, win := array_to_string(w[i:i + n - 1], ' ')))) AS x FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, n, item FROM dw JOIN bw USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.*, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""

OP11_SQL = """
WITH tab AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) AS r(i))),
turns AS (
  SELECT conv_id AS c, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS turn,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(turn ORDER BY n) AS w FROM turns GROUP BY c),
sums AS (
  SELECT c, w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM own, tab),
rebuilt AS (
  SELECT s.c, coalesce(o.w[1:s.h], []) || coalesce(s.w[s.h + 1:], []) AS w FROM sums AS s LEFT JOIN own AS o ON o.c = s.c - s.c % 5),
keyed AS (
  SELECT c, len(w) AS n, d, w[1:d] AS node, CASE WHEN d > 0 THEN octet_length(encode(w[d].x)) ELSE 0 END AS bytes
  FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, min(c) AS conv_id, d, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS own,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d) AS ends
  FROM keyed GROUP BY node, d),
above AS (
  SELECT x.conv_id, x.d, y.conv_id AS up, y.d AS up_d, x.own
  FROM nodes AS x JOIN keyed AS k ON k.c = x.conv_id AND k.d <= x.d JOIN nodes AS y ON y.node = k.node AND y.d = k.d),
children AS (SELECT up, up_d, count(*) AS n FROM above WHERE up_d = d - 1 GROUP BY 1, 2),
totals AS (
  SELECT a.up, a.up_d, CAST(sum(a.own) AS BIGINT) AS saved, count(*) FILTER (ch.n IS NULL) AS leaves
  FROM above AS a LEFT JOIN children AS ch ON ch.up = a.conv_id AND ch.up_d = a.d GROUP BY 1, 2)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, p.up AS parent_conv_id, CAST(x.n_convs AS BIGINT) AS n_convs, CAST(coalesce(ch.n, 0) AS BIGINT) AS n_children,
  CAST(t.leaves AS BIGINT) AS n_leaves, t.saved AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM nodes AS x JOIN totals AS t ON t.up = x.conv_id AND t.up_d = x.d
LEFT JOIN children AS ch ON ch.up = x.conv_id AND ch.up_d = x.d
LEFT JOIN above AS p ON p.conv_id = x.conv_id AND p.d = x.d AND p.up_d = x.d - 1
"""

OP12_SQL = r"""
WITH tab AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) AS r(i))),
d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1])), 4294967295) AS h
  FROM documents, tab),
p AS (
  SELECT k, w, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) ELSE len(w) END AS a,
    CASE WHEN h % 10 = 0 AND len(w) > 0 THEN 1 + (len(w) - (h // 10) % len(w)) // (3 + (h // 10) % 8) ELSE 1 END AS p
  FROM d),
e AS (SELECT k, n, i, w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END] AS x FROM (SELECT *, unnest(range(0, n)) AS i FROM p)),
pairs AS (SELECT l.k, r.i - l.i AS q, l.i FROM e AS l JOIN e AS r ON l.k = r.k AND l.x = r.x AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
stretches AS (
  SELECT k, q, min(i) AS s, count(*) + q AS l
  FROM (SELECT k, q, i, i - row_number() OVER (PARTITION BY k, q ORDER BY i) AS g FROM pairs)
  GROUP BY k, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT k, s, l, min(q) AS q FROM stretches GROUP BY k, s, l),
told AS (
  SELECT k, count(*) AS n_runs, list(struct_pack(s := s, l := l, q := q) ORDER BY l / q DESC, s, q)[1] AS best, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines
  FROM runs GROUP BY k),
gone AS (SELECT DISTINCT k, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT k, string_agg(x, ' ' ORDER BY i) AS c FROM e ANTI JOIN gone USING (k, i) GROUP BY k)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period,
  CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM d LEFT JOIN told USING (k) LEFT JOIN kept USING (k)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
a AS (SELECT k, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT k, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM a),
again AS (SELECT k, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT k, list(DISTINCT p) AS g FROM (SELECT k, unnest(range(i, i + 35)) AS p FROM again) GROUP BY k),
kept AS (
  SELECT k, string_agg(x, ' ' ORDER BY p) AS s
  FROM (SELECT k, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) AS u
  WHERE NOT EXISTS (SELECT 1 FROM (SELECT k AS gk, unnest(g) AS gp FROM gone) WHERE gk = u.k AND gp = u.p)
  GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(g), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (k) LEFT JOIN kept USING (k)
"""


def queries() -> dict:
    return {
        "op1_shard_kk": op1_shard_kk,
        "op2_decontaminate": op2_decontaminate,
        "op3_html_template": op3_html_template,
        "op4_ann_lists": op4_ann_lists,
        "op5_quality_weak": op5_quality_weak,
        "op6_warc_zstd": op6_warc_zstd,
        "op7_neardup_probminhash": op7_neardup_probminhash,
        "op8_sentencepiece_unigram": op8_sentencepiece_unigram,
        "op9_tokens_orc": op9_tokens_orc,
        "op10_langid_profiles": op10_langid_profiles,
        "op11_trie_peeling": op11_trie_peeling,
        "op12_runs_lpf": op12_runs_lpf,
        "op13_repeats_anchor": op13_repeats_anchor,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op6_warc_zstd": OP6_SQL, "op11_trie_peeling": OP11_SQL, "op12_runs_lpf": OP12_SQL, "op13_repeats_anchor": OP13_SQL}
