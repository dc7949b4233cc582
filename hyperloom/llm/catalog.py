"""The named queries of this package and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op9_chat
from .fingerprint import op6_fingerprints
from .langid import op1_language_id
from .mixing import op5_mixing
from .neardup import op2_ngram_jaccard
from .packing import op3_packing
from .pylm import op4_lm_score
from .quality import op7_quality_classifier
from .rules import BUCKETS, MAX_REPEAT_PERCENT, MIN_WORDS, SMOOTHING, THRESHOLD, op8_quality_rules
from .toxicity import op10_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_language_id, op2_ngram_jaccard, op3_packing, op4_lm_score, op5_mixing, op6_fingerprints, op7_quality_classifier, op8_quality_rules, op9_chat, op10_toxicity)
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: All pairs of classes that share a shingle; for tables whose ids are set and differ.
_OP2 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS s FROM w),
c AS (SELECT s, min(doc_id) AS class_id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
t AS (SELECT class_id, n, unnest(s) AS t FROM c),
p AS (SELECT x.class_id AS a, y.class_id AS b FROM t x JOIN t y ON x.t = y.t AND x.class_id != y.class_id GROUP BY 1, 2, x.n, y.n HAVING 5 * count(*) >= 4 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM reach r JOIN p ON p.a = r.b),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a),
g AS (SELECT a, least(a, min(b)) AS group_id FROM reach GROUP BY a)
SELECT s.doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(group_id, class_id, doc_id) AS group_id, len(s.s)::BIGINT AS n_shingles, doc_id = coalesce(group_id, class_id, doc_id) AS is_first
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN l ON l.a = class_id LEFT JOIN g ON g.a = class_id
"""

#: For up to TRUSTED_ROWS rows labelled as good, which are then all trusted, and documents with ids that differ.
_OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM g),
twice AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) AS r(j) GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM l WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
bytes AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM d),
flat AS (SELECT doc_id, unnest(range(1, len(b) + 1)) AS i, unnest(b) AS b FROM bytes),
four AS (SELECT doc_id, b || lead(b, 1) OVER w || lead(b, 2) OVER w || lead(b, 3) OVER w AS b FROM flat WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, ((('0x' || b)::BIGINT::HUGEINT * {0x9E3779B1}) % 4294967296)::BIGINT // {1 << 32 - (BUCKETS.bit_length() - 1)} AS v FROM four WHERE b IS NOT NULL),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
n AS (SELECT v, count(*) AS raw, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM good)) AS trusted FROM grams GROUP BY v),
r AS (SELECT v, ln((trusted + {SMOOTHING}::DOUBLE) / (sum(trusted) OVER ()::DOUBLE * raw / sum(raw) OVER ()::DOUBLE + {SMOOTHING}::DOUBLE))::FLOAT::DOUBLE AS x FROM n),
m AS (SELECT doc_id, sum(x) / count(*) AS llr FROM grams JOIN r USING (v) GROUP BY doc_id),
o AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(llr, 0) AS llr
FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN m USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM o)
SELECT * REPLACE (round(llr, 6) AS llr), NOT base_failed AND llr >= {THRESHOLD} AS kept FROM f
"""

_OP9 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS DISTINCT FROM -7
UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, role || text AS said FROM t)
SELECT conv_id, count(*) AS n_turns,
sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(length('<|turn|><|text|><|end|>') + length(said) + length(said) - length(replace(said, chr(92), '')) + (length(role) - length(replace(role, '<|', '')) + length(text) - length(replace(text, '<|', ''))) // 2)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Learned models, tokens and sampled seatings have no SQL form; tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard": _OP2, "op8_quality_rules": _OP8, "op9_chat": _OP9}
