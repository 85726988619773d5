"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .chat import op12_chat_formatting
from .common import UPPER, LOWER, read
from .decontaminate import op6_decontamination
from .fim import op11_fill_in_middle
from .html import op4_html_extraction
from .jaccard import op7_jaccard_join
from .lm import op2_lm_scoring, unigram_base
from .packing import op10_best_fit_packing
from .quality import op3_quality_classifier
from .repeats import op1_suffix_dedup
from .rules import base_statistics, op5_quality_rules
from .toxicity import op9_toxicity
from .trie import op13_prefix_trie
from .warc import op8_warc_fixity

QUERIES = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_decontamination": op6_decontamination,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_warc_fixity": op8_warc_fixity,
    "op9_toxicity": op9_toxicity,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_chat_formatting": op12_chat_formatting,
    "op13_prefix_trie": op13_prefix_trie,
    # what SQL can tell of op2 and op5
    "unigram_base": lambda spark, sf_dir: unigram_base(read(spark, sf_dir, "documents")),
    "text_statistics": lambda spark, sf_dir: base_statistics(read(spark, sf_dir, "documents")),
}

_FOLDED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: Every run of 50 words that has occurred before, by document and place; those that overlap are one passage.
_REPEATS = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT doc_id, pos, md5(array_to_string(w[pos + 1:pos + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS pos FROM d WHERE len(w) >= 50)),
c AS (SELECT doc_id, pos, lag(doc_id) OVER (PARTITION BY h ORDER BY doc_id, pos) AS src FROM g),
f AS (SELECT doc_id, pos, src, CASE WHEN pos < lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM c WHERE src IS NOT NULL),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM f)
SELECT doc_id, min(pos) AS start_word, max(pos) + 50 - min(pos) AS n_words, arg_min(src, pos) AS source_id FROM s GROUP BY doc_id, span
"""

#: All pairs by shared shingles, then the smallest id that links reach.
_LINKS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, least) AS (SELECT a, a FROM e UNION SELECT e.b, r.least FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT node, min(least) AS least FROM r GROUP BY 1) m ON m.node = d.doc_id
"""

#: Windows of an item's size laid by every shared shingle, compared exactly with multiplicities; the best of each pair.
_LEAKS = rf"""
WITH d AS (SELECT DISTINCT doc_id, md5(text) AS t, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT DISTINCT item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT doc_id, t, len(w) AS words, i, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1:i + 5], ' ') END AS g
    FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
bs AS (SELECT item_id, len(w) AS n, i, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i + 1:i + 5], ' ') END AS g
    FROM (SELECT *, unnest(range(0, greatest(1, len(w) - 4))) AS i FROM b WHERE len(w) > 0)),
bc AS (SELECT item_id, n, g, count(*) AS c FROM bs GROUP BY 1, 2, 3),
t AS (SELECT item_id, n, sum(c) AS total FROM bc GROUP BY 1, 2),
h AS (SELECT DISTINCT doc_id, t, words, item_id, n, greatest(0, least(ds.i - bs.i, words - n)) AS start FROM ds JOIN bs USING (g)),
w AS (SELECT h.doc_id, h.t, h.item_id, h.start, h.n, least(h.n, h.words) AS size, ds.g, count(*) AS c
    FROM h JOIN ds ON ds.doc_id = h.doc_id AND ds.t = h.t AND ds.i >= h.start AND ds.i < h.start + greatest(least(h.n, h.words) - 4, 1) GROUP BY ALL),
o AS (SELECT w.doc_id, w.t, w.item_id, w.start, w.n, sum(w.c) AS own, sum(least(w.c, coalesce(bc.c, 0))) AS common
    FROM w LEFT JOIN bc ON bc.item_id = w.item_id AND bc.g = w.g GROUP BY ALL),
x AS (SELECT doc_id, o.item_id, start, o.n, common / (own + total - common) AS similarity FROM o JOIN t ON t.item_id = o.item_id WHERE 100 * common >= 75 * (own + total - common))
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start_word, CAST(n AS BIGINT) AS n_words, similarity FROM x
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

#: Words, lines and windows of three words.
_STATISTICS = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
r AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM r),
k AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
FROM d LEFT JOIN k ON k.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
"""

#: DuckDB has no crc32, so here all texts are counted, none is held out.
_UNIGRAMS = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word FROM d),
c AS (SELECT word, count(*) AS c FROM x GROUP BY 1),
t AS (SELECT (SELECT count(*) FROM x) + (SELECT count(*) FROM d) AS n, (SELECT count(*) FROM c) + 1 AS v, (SELECT count(*) FROM d) AS ends),
s AS (SELECT doc_id, count(*) AS words, sum(log10(c + 1)) AS logs FROM x JOIN c USING (word) GROUP BY 1)
SELECT d.doc_id, coalesce(words, 0) + 1 AS n_tokens, t.n AS train_tokens, coalesce(logs, 0) + log10(ends + 1) - (coalesce(words, 0) + 1) * log10(t.n + t.v + 1) AS base_score
FROM d CROSS JOIN t LEFT JOIN s ON s.doc_id = d.doc_id
"""

#: Cuts by code points, drawn by the hash of the id.
_MIDDLES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT doc_id, t, length(t) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM d),
c AS (SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""

#: Turns in order, each with its mark, a blank, the escaped text and its end.
_CHATS = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    regexp_replace(text, '([\[<])(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)', '\1\\\2\3', 'g') AS inside, regexp_replace(role, '([\[<])(\\*)(/?(?:INST|SYS|ROLE)\]|/?s>)', '\1\\\2\3', 'g') AS other FROM a),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS lines, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS learned,
    3 + sum(CASE role WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 WHEN 'system' THEN 5 ELSE 13 + length(other) END + 1 + length(inside) + 4) AS formatted_chars FROM e GROUP BY 1)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""

#: Every node by the digests of its turns; what lies below a node by its descendants. crc32 is worked out bit by bit.
_TRIE = r"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, xor(list_reduce(flatten([[ascii(z), 0, 0, 0, 0, 0, 0, 0] FOR z IN string_split(CAST(c AS VARCHAR), '')]),
    lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384), 4294967295), 4294967295) % 6 AS h FROM t),
w AS (SELECT ids.c, i, r, x FROM ids JOIN t ON t.c = ids.c - (ids.c % 100 + 100) % 100 AND t.i <= ids.h UNION ALL SELECT t.c, i, r, x FROM t JOIN ids ON ids.c = t.c AND t.i > ids.h),
k AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY i) AS d, length(x) AS size, md5(length(r) || ':' || r || x) AS k FROM w),
s AS (SELECT ids.c, coalesce(string_agg(k.k, '' ORDER BY d), '') AS path, count(d) AS n FROM ids LEFT JOIN k ON k.c = ids.c GROUP BY 1),
m AS (SELECT s.c, n, d, substr(path, 1, 32 * d) AS p FROM (SELECT *, unnest(range(0, n + 1)) AS d FROM s) s),
a AS (SELECT m.d, p, min(m.c) AS conv_id, count(*) AS n_convs, max(coalesce(size, 0)) AS size, coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (m.n = m.d), '') AS ends
    FROM m LEFT JOIN k ON k.c = m.c AND k.d = m.d GROUP BY 1, 2),
o AS (SELECT d - 1 AS d, substr(p, 1, 32 * (d - 1)) AS p, count(*) AS n_children FROM a WHERE d > 0 GROUP BY 1, 2),
e AS (SELECT a.*, coalesce(n_children, 0) AS n_children FROM a LEFT JOIN o USING (d, p)),
b AS (SELECT up, substr(p, 1, 32 * up) AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM e) GROUP BY 1, 2)
SELECT e.conv_id, CAST(e.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, e.n_convs, CAST(e.n_children AS BIGINT) AS n_children, b.n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN b ON b.up = e.d AND b.p = e.p LEFT JOIN a q ON q.d = e.d - 1 AND q.p = substr(e.p, 1, 32 * (e.d - 1))
"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": _REPEATS,
    "op6_decontamination": _LEAKS,
    "op7_jaccard_join": _LINKS,
    "op11_fill_in_middle": _MIDDLES,
    "op12_chat_formatting": _CHATS,
    "op13_prefix_trie": _TRIE,
    "unigram_base": _UNIGRAMS,
    "text_statistics": _STATISTICS,
}
