"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op8_decontaminate
from .fingerprints import op5_fingerprints
from .language_id import op1_language_id
from .mixing import op4_mixing
from .near_dedup import op2_near_dedup
from .paragraphs import op9_paragraphs
from .pii import op3_pii
from .repeats import op7_repeats
from .secrets import op10_secrets
from .toxicity import op6_toxicity

_ALL = [op1_language_id, op2_near_dedup, op3_pii, op4_mixing, op5_fingerprints, op6_toxicity, op7_repeats, op8_decontaminate, op9_paragraphs, op10_secrets]
#: Near duplicates by all shared shingles, and repeated strings by all 50-byte strings in hex; the other operators hold models, draws or sketches that SQL can't express.
ORACLE: dict[str, str] = {
    "op7_repeats": r"""WITH t AS (SELECT doc_id, hex(encode(coalesce(text,''))) AS h, octet_length(encode(coalesce(text,''))) AS n FROM documents),
c AS (SELECT doc_id, b, substr(h, (2000*b+1)::BIGINT, 2098) AS p FROM (SELECT doc_id, h, unnest(range(0, (n-49+999)//1000)) AS b FROM t WHERE n>=50)),
g AS (SELECT doc_id, i, s FROM (SELECT doc_id, 1000*b+j AS i, substr(p, 2*j+1, 100) AS s FROM c, range(0,1000) r(j)) WHERE length(s)=100),
m AS (SELECT s, min(doc_id) AS d FROM g GROUP BY s HAVING min(doc_id)<max(doc_id)),
hit AS (SELECT g.doc_id, g.i FROM g JOIN m USING (s) WHERE m.d<g.doc_id),
o AS (SELECT doc_id, i, CASE WHEN i<=lag(i) OVER (PARTITION BY doc_id ORDER BY i)+50 THEN 0 ELSE 1 END AS new FROM hit),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i)+50 AS e FROM k GROUP BY doc_id, run),
q AS (SELECT r.doc_id, a, e, lag(e,1,0) OVER (PARTITION BY r.doc_id ORDER BY a) AS before FROM r),
z AS (SELECT q.doc_id, sum(e-a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2*before+1, 2*(a-before)), '' ORDER BY a) AS kept, max(e) AS last FROM q JOIN t ON t.doc_id=q.doc_id GROUP BY q.doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed,0)::BIGINT AS n_removed, coalesce(n_spans,0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN z.doc_id IS NULL THEN h ELSE kept||substr(h, 2*last+1) END)) AS kept_sha256 FROM t LEFT JOIN z ON z.doc_id=t.doc_id""",
    "op2_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[\x20\x09-\x0D]+'), lambda x: x<>'') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w)>=5 THEN list_distinct(list_transform(range(1,len(w)-3), lambda i: array_to_string(w[i:i+4],' '))) WHEN len(w)>0 THEN [array_to_string(w,' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g=b.g AND a.doc_id<>b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100*count(*)>=70*(a.n+b.n-count(*))),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a=r.c)
SELECT s.doc_id, len(any_value(s.s))::BIGINT AS n_shingles, min(r.c) AS component_id, s.doc_id=min(r.c) AS kept FROM s JOIN r ON r.doc_id=s.doc_id GROUP BY s.doc_id""",
}


def queries() -> dict:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
