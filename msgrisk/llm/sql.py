"""DuckDB SQL for the corpus queries that SQL can express, written from their rules."""

from __future__ import annotations

from msgrisk.llm import secret_scan


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ------------------------------------------------------------------- secrets
def _spans(rule: secret_scan.Rule, rank: int) -> str:
    """Matches of one rule by the lengths of what lies between and in them."""
    p = _quoted(rule.pattern)
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
            'size': length(m[i]), 'value': length(v[i])}})) AS s
        FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {rule.group}) AS v, string_split_regex(t, {p}) AS g FROM texts)
        WHERE len(m) > 0"""


def secret_spans() -> str:
    rules = secret_scan.RULES
    parts = " UNION ALL ".join(f"SELECT * FROM ({_spans(r, i)}) WHERE s.value >= {r.least}" for i, r in enumerate(rules))
    base = ", ".join(f"'{k}'" for k in secret_scan.BASE_KINDS)
    one = "kind || ':' || s.start::BIGINT || ':' || (s.start + s.size)::BIGINT"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in secret_scan.BASE_KINDS)
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({parts})
        SELECT d.doc_id, {counts}, sha256(coalesce(string_agg({one}, ',' ORDER BY s.start, rank) FILTER (WHERE kind IN ({base})), '')) AS base_sha256,
          coalesce(string_agg({one}, ',' ORDER BY s.start, rank), '') AS spans
        FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id"""


# --------------------------------------------------------------------- pages
# Base32 of a digest: every five hexadecimal digits make four letters.
_FIVE = "list_sum(list_transform(range(1, 6), lambda k: (instr('0123456789abcdef', substr(h, (5 * g + k)::INT, 1)) - 1) * (1 << (4 * (5 - k)))))::BIGINT"
_BASE32 = f"""array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_FIVE}) >> s) & 31)::INT + 1, 1)), '')), '')"""
PAGES = f"""WITH rows AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM rows)
    SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
      CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts"""

# ------------------------------------------------------------------- benchmark
# Every window of a document that shares a shingle with an item; fingerprints are no work for SQL.
DECONTAMINATION = r"""WITH
    item_words AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
    items AS (SELECT item_id, len(w) AS size, len(w) - 4 AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram
      FROM item_words WHERE len(w) >= 5),
    wanted AS (SELECT item_id, size, n, gram, count(*) AS m FROM items GROUP BY ALL),
    doc_words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
    doc_grams AS (SELECT doc_id, len(w) AS n_words, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram
      FROM doc_words WHERE len(w) >= 5),
    hits AS MATERIALIZED (SELECT doc_id, item_id, n_words, size, n, pos, gram, m, greatest(least(size, n_words) - 4, 1) AS n_win FROM doc_grams JOIN wanted USING (gram)),
    covers AS (SELECT doc_id, item_id, n, n_win, gram, m, unnest(range(greatest(pos - n_win + 1, 0), least(pos, greatest(n_words - size, 0)) + 1)) AS start, size FROM hits),
    held AS (SELECT doc_id, item_id, size, n, n_win, start, gram, m, count(*) AS c FROM covers GROUP BY ALL),
    windows AS (SELECT doc_id, item_id, size, start, sum(least(c, m)) AS common, n, n_win FROM held GROUP BY ALL),
    scored AS (SELECT doc_id, item_id, start, size, common / (n_win + n - common) AS similarity FROM windows)
    SELECT doc_id, item_id, start::INT AS start, size::INT AS words, round(similarity, 6) AS similarity FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS place FROM scored WHERE similarity >= 0.8) WHERE place = 1"""

# --------------------------------------------------------------------- vectors
VECTORS = """WITH RECURSIVE
    fine AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
      WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
    reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
    least_of AS (SELECT a, least(a, min(b)) AS m FROM reached GROUP BY a),
    degrees AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN least_of l ON l.a = vec_id LEFT JOIN degrees d ON d.a = vec_id"""

# ------------------------------------------------------------------- centroids
def _round(i: int) -> str:
    """Nearest centroid of each vector, ties by number, and the centroids moved to the floor of the mean."""
    gap = "list_sum(list_transform(range(1, 65), lambda j: (k.v[j] - c.v[j]) * (k.v[j] - c.v[j])))::BIGINT"
    return f"""near{i} AS MATERIALIZED (SELECT r, vec_id, v, m.gap AS gap, m.c AS c FROM (
        SELECT k.r, any_value(k.vec_id) AS vec_id, any_value(k.v) AS v, min({{'gap': {gap}, 'c': c.c}}) AS m FROM kept k, cent{i} c GROUP BY k.r)),
      sums{i} AS (SELECT c, j, sum(v[j])::HUGEINT AS s, count(*) AS n FROM near{i}, range(1, 65) t(j) GROUP BY c, j),
      cent{i + 1} AS MATERIALIZED (SELECT c, coalesce(any_value(moved), any_value(old.v)) AS v FROM cent{i} old
        LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS moved FROM sums{i} GROUP BY c) USING (c) GROUP BY c),"""


CENTROIDS = f"""WITH
    kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cent0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept ORDER BY h LIMIT 16)),
    {_round(0)} {_round(1)} {_round(2)} {_round(3)}
    whole AS (SELECT sum(gap)::BIGINT AS inertia FROM near3),
    own AS (SELECT c, sum(gap)::BIGINT AS cluster_inertia FROM near3 GROUP BY c)
    SELECT vec_id, n.c::INT AS cluster, gap AS distance, cluster_inertia, inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
    FROM near3 n JOIN own USING (c) JOIN cent3 f USING (c), whole"""

# ---------------------------------------------------------------------- search
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SEARCH = f"""WITH
    docs AS MATERIALIZED (SELECT row_number() OVER () AS d, doc_id, {_TERMS} AS w FROM documents),
    sizes AS (SELECT d, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
    corpus AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM sizes),
    postings AS MATERIALIZED (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM docs) GROUP BY d, term),
    df AS (SELECT term, count(*) AS df FROM postings GROUP BY term),
    items AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
    parts AS (SELECT item_id, d, doc_id, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df.df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))) AS part
      FROM items JOIN postings USING (term) JOIN df USING (term) JOIN sizes USING (d), corpus),
    scored AS (SELECT item_id, d, doc_id, sum(part)::BIGINT AS score FROM parts GROUP BY ALL HAVING sum(part) > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

ORACLES = {
    "op5_secret_scan": secret_spans(),
    "op6_warc_pages": PAGES,
    "op7_benchmark_decontamination": DECONTAMINATION,
    "op8_embedding_near_duplicates": VECTORS,
    "op11_centroid_clusters": CENTROIDS,
    "op13_lexical_search": SEARCH,
}
