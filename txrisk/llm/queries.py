"""Registered queries of the subpackage and their SQL twins.

Each query applies one operator, with production parameters, to its whole table.
"""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import (chat, embed_dedup, exact_dedup, langid, license_scan, line_dedup, mixing,
                        packing, secret_scan, simhash, spelling, token_output, turn_repair)
from txrisk.llm.common import prepare, table
from txrisk.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@_query("op1_embedding_links", """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0
    AND list_sum([abs(x) for x in embedding]) > 0),
l AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT u, w FROM l UNION SELECT r.u, l.w FROM r JOIN l ON r.w = l.u),
n AS (SELECT u, count(*) AS c FROM l GROUP BY u),
m AS (SELECT u, min(w) AS w FROM r GROUP BY u)
SELECT vec_id, coalesce(n.c, 0) AS n_links, least(vec_id, coalesce(m.w, vec_id)) AS component_id,
  vec_id <= coalesce(m.w, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.u = vec_id LEFT JOIN m ON m.u = vec_id""")
def op1(spark, sf):
    """Embedding near-dedup of all vectors by an epsilon grid order join."""
    return embed_dedup.embedding_links(table(spark, sf, "embeddings"))


@_query("op2_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(role, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
    '\[(\\*)(/?INST\])', '[\\\1\2', 'g'))
  + length(regexp_replace(regexp_replace(text, '<(\\*)(/?s>)', '<\\\1\2', 'g'),
    '\[(\\*)(/?INST\])', '[\\\1\2', 'g')) + 17 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
    FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) + 3 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""")
def op2(spark, sf):
    """Chat formatting with a grammar round trip, plus the adversarial conversation -1."""
    extra = spark.sql("""SELECT * FROM VALUES
        (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')
        AS t(conv_id, turn, role, text)""")
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return chat.summarise(chat.format_conversations(c.unionByName(extra)))


@_query("op3_exact_dedup", """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)""")
def op3(spark, sf):
    """Exact dedup of all documents: the half with an even id hash is history, the
    other half arrives and is looked up in history's minimal perfect hash."""
    docs = table(spark, sf, "documents")
    return exact_dedup.exact_dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)


@_query("op4_token_matrices")
def op4(spark, sf):
    """All documents as packed token-id matrices."""
    return token_output.packed_ids(table(spark, sf, "documents"))


@_query("op5_license_scan")
def op5(spark, sf):
    """License notices in all documents."""
    return license_scan.scan_licenses(table(spark, sf, "documents"))


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('42|' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * n AS cap
  FROM s),
o AS (SELECT *, row_number() OVER q AS pos,
    CAST(sum(n) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
      / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level,
    CAST(cap AS DOUBLE) / w AS ratio
  FROM w WINDOW q AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST),
    b AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(pos) AS first FROM o WHERE level <= ratio),
t AS (SELECT source, n, CASE WHEN pos >= f.first
    THEN least((SELECT level FROM o, f WHERE pos = f.first) * w, CAST(cap AS DOUBLE))
    ELSE CAST(cap AS DOUBLE) END AS target FROM o, f),
p AS (SELECT d.*, t.n, t.target,
    CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
    CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, n AS source_size, target,
  CAST(CASE WHEN n = 0 THEN 0 ELSE budget // n * size
    + greatest(0, least(size, budget % n - ahead)) END AS BIGINT) AS taken
FROM p"""


@_query("op6_source_mix", _MIX_SQL)
def op6(spark, sf):
    """Mix of all documents by source weights 1, 2, 3, at most three epochs."""
    return mixing.mix(table(spark, sf, "documents"))


@_query("op7_packing")
def op7(spark, sf):
    """Hierarchical multi-length packing of all documents."""
    return packing.pack(table(spark, sf, "documents"))


@_query("op8_language_id")
def op8(spark, sf):
    """Language of every document, learned from four fifths of them."""
    d = langid.identify(table(spark, sf, "documents").select("doc_id", "text", "lang"))
    return d.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "coverage")


@_query("op9_line_dedup", r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
m AS (SELECT *, [CASE WHEN regexp_matches(t, '[0-9]') THEN '<*>' ELSE t END
    for t in string_split_regex(line, '[\x09-\x0D\x20]+') if t <> ''] AS m FROM l),
g AS (SELECT *, len(m) AS n FROM m WHERE len(m) >= 3),
k AS (
  SELECT doc_id, pos, n || '|' || array_to_string(m, ' ') AS k FROM g
  UNION ALL
  SELECT doc_id, pos, n || '|' || i || '|' || array_to_string(list_concat(list_concat(
    m[1:2 + (n - 2) * i // 4], ['<*>']), m[3 + (n - 2) * (i + 1) // 4:n]), ' ')
  FROM g, range(4) AS r(i) WHERE n >= 10),
r AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
x AS (SELECT DISTINCT doc_id, pos FROM k JOIN r USING (k) WHERE doc_id <> first),
c AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.pos) FILTER (x.pos IS NULL) AS text,
    count(x.pos) AS n_dropped
  FROM l LEFT JOIN x ON l.doc_id = x.doc_id AND l.pos = x.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
  coalesce(c.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id""")
def op9(spark, sf):
    """All documents without the lines of recurring templates, those of the tree's
    leaves included, which the SQL does not have."""
    d = line_dedup.drop_recurring_lines(table(spark, sf, "documents").select("doc_id", "text"), tree=True)
    return d.withColumnRenamed("_dropped", "n_dropped")


@_query("op10_simhash")
def op10(spark, sf):
    """SimHash classes of all documents: 3-word shingles, at most 2 differing bits."""
    c = simhash.simhash_classes(table(spark, sf, "documents"), shingle=3, max_bits=2, seed=42)
    return c.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                    "component_id")


#: CRC-32 of a string k in DuckDB: table t.tab of 256 entries, bytes from the hex form.
_CRC_TABLE = """t AS (SELECT list(list_reduce(list_prepend(i, range(8)),
    lambda c, _: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM range(256) AS r(i))"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295,
    [CAST('0x' || substr(hex(encode(k)), 2 * j + 1, 2) AS BIGINT) for j in range(strlen(k))]),
    lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])))"""


def _repair_sql() -> str:
    def d(q):
        return f"{{'c': w{q}.c + 3, 'a': 'D' || w{q}.a}}"

    def k(kind, q):
        return (f"{{'c': CASE WHEN kind = '{kind}' AND fault <> 'x' THEN w{q}.c + extra ELSE 1000000000 "
                f"END, 'a': 'K' || w{q}.a}}")

    def r(q):
        return f"{{'c': CASE WHEN fault <> 'x' THEN w{q}.c + 2 + extra ELSE 1000000000 END, 'a': 'R' || w{q}.a}}"

    def i(q):
        return f"{{'c': v{q}.c + 2, 'a': 'I' || v{q}.a}}"

    return rf"""
WITH RECURSIVE {_CRC_TABLE},
o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations),
c AS (SELECT o.*, {_CRC} % 20 AS c FROM o, t),
e AS (SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
    CASE c WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, (VALUES (1), (2)) AS n(n) WHERE c <> 0 AND (n = 1 OR c = 3)),
e1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1
    AS again FROM e),
f AS (SELECT *, row_number() OVER q AS pos, lag(substr(role, 1, 1)) OVER q || substr(role, 1, 1) AS pair
  FROM e1 WINDOW q AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), again)),
g AS (SELECT *, substr(role, 1, 1) AS kind, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN again THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'none' END AS what
  FROM f),
h AS (SELECT *, CASE WHEN what IN ('blank', 'duplicate') THEN 'x' ELSE 'o' END AS fault,
    CASE WHEN what = 'truncated' THEN 1 ELSE 0 END AS extra FROM g),
s AS (SELECT conv_id, count(*) AS n,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (what = 'blank') AS blank, count(*) FILTER (what = 'duplicate') AS duplicate,
    count(*) FILTER (what = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM h GROUP BY conv_id),
w AS (
  SELECT conv_id, n + 1 AS pos, {{'c': 0, 'a': ''}} AS w0, {{'c': 4, 'a': 'II'}} AS w1,
    {{'c': 2, 'a': 'I'}} AS w2, {{'c': 0, 'a': ''}} AS w3 FROM s
  UNION ALL
  SELECT conv_id, pos, list_min([v0, {i(2)}, {{'c': v3.c + 4, 'a': 'II' || v3.a}}]),
    list_min([v1, {i(2)}, {{'c': v3.c + 4, 'a': 'II' || v3.a}}]),
    list_min([v2, {i(3)}]), list_min([v3, {i(2)}])
  FROM (SELECT h.conv_id, h.pos,
      list_min([{d(0)}, {k('s', 1)}, {k('u', 2)}, {r(2)}]) AS v0,
      list_min([{d(1)}, {k('u', 2)}, {r(2)}]) AS v1,
      list_min([{d(2)}, {k('a', 3)}, {r(3)}]) AS v2,
      list_min([{d(3)}, {k('u', 2)}, {r(2)}]) AS v3
    FROM w JOIN h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.pos = w.pos - 1) AS x),
b AS (SELECT conv_id, w0.c AS cost, w0.a AS audit FROM w WHERE pos = 1),
u AS (SELECT conv_id, i, substr(audit, CAST(i AS INT), 1) AS edit,
    i - strlen(replace(audit[1:i], 'I', '')) AS skipped
  FROM b, (SELECT unnest(range(1, 20001)) AS i) AS r WHERE i <= length(audit)),
y AS (SELECT u.*, h.role, h.text, row_number() OVER p AS out,
    first_value(edit = 'K' AND h.kind = 's') OVER p AS system
  FROM u LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM u.conv_id AND h.pos = u.i - u.skipped AND edit <> 'I'
  WHERE edit <> 'D' WINDOW p AS (PARTITION BY u.conv_id ORDER BY i)),
z AS (SELECT conv_id, sha256(string_agg((CASE WHEN edit = 'K' THEN role
      WHEN (out - CAST(system AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':'
    || coalesce(text, ''), chr(10) ORDER BY i)) AS repaired_sha256 FROM y GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
  coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS a
LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id"""


@_query("op11_turn_repair", _repair_sql())
def op11(spark, sf):
    """Damaged conversations, their faults, cheapest edits and repaired text."""
    c = table(spark, sf, "conversations")
    return turn_repair.report(c, turn_repair.damage(c))


def _secret_sql() -> str:
    rules = [("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
              r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?"""
              r"([A-Za-z0-9+/_.=-]+)", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
             ("pem", "-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----", 0, 0),
             ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{20,}", 0, 0),
             ("github", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0), ("slack", "xox[abprs]-[A-Za-z0-9-]{20,}", 0, 0)]
    # matches are set between two private-use code points, then the text is cut there
    each = " UNION ALL ".join(
        f"""SELECT b, {k} AS k, '{kind}' AS kind, CAST(sum(length(hit) + gap) OVER (PARTITION BY b ORDER BY i) - gap
          - length(hit) AS BIGINT) AS start, length(hit) AS size, length(regexp_extract(hit, '{p}', {g})) >= {least} AS ok
        FROM (SELECT b, i, CASE WHEN i = 1 THEN '' ELSE split_part(x, chr(57345), 1) END AS hit,
            length(CASE WHEN i = 1 THEN x ELSE split_part(x, chr(57345), 2) END) AS gap
          FROM (SELECT b, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM (SELECT b, string_split(
            regexp_replace(text, '({p})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS xs
            FROM t WHERE regexp_matches(text, '{p}'))))"""
        for k, (kind, p, g, least) in enumerate(rules))
    return f"""
WITH t AS (SELECT DISTINCT sha256(coalesce(text, '')) AS b, coalesce(text, '') AS text FROM documents),
m AS ({each}),
s AS (SELECT *, kind || ':' || start || ':' || start + size AS span FROM m WHERE ok AND size > 0),
g AS (SELECT b, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base,
    string_agg(span, ',' ORDER BY start, k) AS spans FROM s GROUP BY b)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN g ON g.b = sha256(coalesce(d.text, ''))"""


@_query("op12_secret_scan", _secret_sql())
def op12(spark, sf):
    """Secrets in all documents. The half with an even id hash has been scanned before
    under the base rules; then all rules and all documents come."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    ledger, early = scratch_path(spark, "secret-ledger"), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    secret_scan.record(docs.where(early), ledger)
    secret_scan.scan(docs.where(early), ledger, secret_scan.BASE)
    secret_scan.record(docs.where(~early), ledger)
    secret_scan.scan(docs, ledger, secret_scan.RULES)
    return secret_scan.summarise(secret_scan.by_path(spark, ledger, secret_scan.RULES))


_SPELLING_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
g AS (SELECT w, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w AS k, count(*) AS n
  FROM r WHERE length(w) >= 7 GROUP BY doc_id, w),
h AS (SELECT w, n, {_CRC} AS h FROM g, t),
m AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT))
    || substr(w, CAST(h % length(w) + 2 AS INT)) ELSE w END AS w, n FROM h),
v AS (SELECT w, CAST(sum(n) AS BIGINT) AS n FROM m WHERE length(w) >= 7 GROUP BY w HAVING sum(n) >= 2),
d AS (SELECT w, n, i, substr(w, 1, CAST(i - 1 AS INT)) || substr(w, CAST(i + 1 AS INT)) AS x
  FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM v)),
p AS (SELECT a.w, a.n, b.w AS o, b.n AS m FROM d a JOIN d b ON a.i = b.i AND a.x = b.x AND a.w <> b.w
  UNION SELECT a.w, a.n, v.w, v.n FROM d a JOIN v ON v.w = a.x
  UNION SELECT v.w, v.n, a.w, a.n FROM d a JOIN v ON v.w = a.x),
q AS (SELECT w, count(*) AS n_near, min({{'m': -m, 'o': o}}) AS best FROM p GROUP BY w),
f AS (SELECT v.w, v.n, coalesce(n_near, 0) AS n_near,
    CASE WHEN -best.m >= 10 * v.n THEN best.o END AS form,
    CASE WHEN -best.m >= 10 * v.n THEN -best.m END AS form_n FROM v LEFT JOIN q ON q.w = v.w),
c AS (SELECT w, w AS last, 0 AS step FROM f
  UNION ALL SELECT c.w, f.form, step + 1 FROM c JOIN f ON f.w = c.last WHERE f.form IS NOT NULL),
z AS (SELECT w, arg_max(last, step) AS root FROM c GROUP BY w)
SELECT f.w AS word, form, root, n, n_near, form_n FROM f JOIN z ON z.w = f.w"""


@_query("op13_spelling_variants", _SPELLING_SQL)
def op13(spark, sf):
    """Spelling variants among the words of all documents, some of them mistyped."""
    return spelling.variant_groups(spelling.vocabulary(table(spark, sf, "documents"), every=31))
