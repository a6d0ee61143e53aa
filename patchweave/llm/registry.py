"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from .ann import op6_ann
from .bpe import op13_bpe
from .chat_format import op4_chat_format
from .jaccard_join import op10_jaccard_join
from .language_id import op9_language_id
from .mixing import op7_mixing
from .packing import op5_packing
from .quality_classifier import op8_quality_classifier
from .quality_rules import op1_quality_rules
from .secret_scans import op3_secret_scans
from .spelling import op12_spelling
from .token_counts import op2_token_counts
from .whitening import op11_whitening

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scans": op3_secret_scans,
    "op4_chat_format": op4_chat_format,
    "op5_packing": op5_packing,
    "op6_ann": op6_ann,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_bpe": op13_bpe,
}
#: Exact nearest neighbours.
NEAREST = """WITH v AS (SELECT vec_id AS id, [x::DOUBLE for x in embedding] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
s AS (SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.v, c.v) AS score FROM v q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v) WHERE q.id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""
#: Links by counting common shingles, components by reachability.
SIMILAR = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(sh) AS h, sh FROM (SELECT doc_id, s, unnest(s) AS sh FROM s)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS both_ FROM e a JOIN e b ON a.h = b.h AND a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * both_ >= 75 * (na + nb - both_)),
k AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id, doc_id AS r FROM s UNION SELECT reach.doc_id, k.b FROM reach JOIN k ON k.a = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM s JOIN c ON c.doc_id = s.doc_id"""
#: Slips by a crc32 computed from its table, near words by a text they share with one letter left out (at one place, if they are as long), roots by walking forms.
VARIANTS = r"""WITH RECURSIVE bit AS (SELECT i, i::BIGINT AS v, 0 AS k FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bit WHERE k < 8),
tab AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bit WHERE k = 8),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
own AS MATERIALIZED (SELECT doc_id, w, count(*) AS n FROM run WHERE length(w) >= 7 GROUP BY 1, 2),
raw AS MATERIALIZED (SELECT w, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM own),
sum AS MATERIALIZED (SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, [('0x' || substr(x, i::INT, 2))::BIGINT for i in range(1, length(x), 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM raw, tab),
slip AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM sum),
word AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slip WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
part AS MATERIALIZED (SELECT word, n, 0 AS i, word AS v FROM word UNION ALL SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS MATERIALIZED (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM part a JOIN part b ON a.v = b.v AND a.word <> b.word WHERE a.i = b.i OR a.i = 0 OR b.i = 0),
near AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS o, max(m) AS m FROM pair GROUP BY 1),
form AS MATERIALIZED (SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN o END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM word LEFT JOIN near ON near.word = word.word),
walk AS (SELECT word, word AS root FROM form UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON form.word = walk.root WHERE form.form IS NOT NULL),
root AS (SELECT word, root FROM walk JOIN (SELECT word AS stop FROM form WHERE form IS NULL) ON stop = root)
SELECT form.word, form, root, n, n_near, form_n FROM form JOIN root ON root.word = form.word"""
ORACLES: dict[str, str] = {"op6_ann": NEAREST, "op10_jaccard_join": SIMILAR, "op12_spelling": VARIANTS}
