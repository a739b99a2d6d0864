"""The numbered queries over the test tables, and their SQL where it can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from . import (
    ball_search,
    collocations,
    decontaminate,
    fingerprint,
    language_id,
    line_dedup,
    near_dedup,
    packing,
    quality_gam,
    secrets,
    token_file,
    toxicity,
    warc,
)

UPPER, LOWER = line_dedup.UPPER, line_dedup.LOWER


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   '{UPPER}', '{LOWER}') AS line_key
  FROM l
), hot AS (
  SELECT line_key, max(doc_id) AS keeper FROM k WHERE length(line_key) >= 20
  GROUP BY line_key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, h.keeper IS NOT NULL AND h.keeper <> k.doc_id AS gone
  FROM k LEFT JOIN hot h ON k.line_key = h.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), ''))
         AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_gam.train(docs, _table(spark, sf_dir, "labels"))
    return quality_gam.scored(docs, model).select(
        "doc_id",
        quality_gam.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs)
    return docs.select(
        "doc_id",
        language_id.held_out("doc_id", 4, 2).alias("held_out"),
        language_id.predicted(docs, model).alias("p"),
    ).select("doc_id", "held_out", "p.lang_pred", "p.score")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY ALL
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id < page_id THEN first_id END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_file.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read(spark, manifest)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)
    base = F.filter("found", lambda s: s["rule"] < secrets.BASE)
    return found.select(
        "doc_id",
        *[secrets.count_of(F.col("found"), i).alias(f"n_{secrets.RULES[i].kind}") for i in range(secrets.BASE)],
        F.sha2(secrets.named(base), 256).alias("base_sha256"),
        secrets.named(F.col("found")).alias("spans"),
    )


def _op7_sql() -> str:
    def rows(no: int, rule: secrets.Rule) -> str:
        p = rule.pattern.replace("'", "''")
        return f"""
  SELECT doc_id, {no} AS rule, '{rule.kind}' AS kind,
         unnest(regexp_extract_all(t, '{p}')) AS m,
         unnest(regexp_extract_all(t, '{p}', {rule.group})) AS g,
         unnest(list_slice(string_split_regex(t, '{p}'), 1, len(regexp_extract_all(t, '{p}')))) AS gap,
         generate_subscripts(regexp_extract_all(t, '{p}'), 1) AS i, {rule.least} AS least
  FROM d WHERE regexp_matches(t, '{p}')"""

    union = " UNION ALL ".join(rows(no, r) for no, r in enumerate(secrets.RULES))
    named = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rule"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), u AS ({union}
), p AS (
  SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rule ORDER BY i)::BIGINT AS stop FROM u
), s AS (
  SELECT doc_id, rule, kind, stop - length(m) AS start, stop FROM p WHERE length(g) >= least
), a AS (
  SELECT doc_id, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access,
         count(*) FILTER (WHERE rule = 2) AS n_hex,
         string_agg({named}) FILTER (WHERE rule < {secrets.BASE}) AS base, string_agg({named}) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compared(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: F.round(c, 6) for c in ("near_edited", "near_next")})


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         lead(coalesce(text, '')) OVER w AS after, first_value(coalesce(text, '')) OVER w AS top,
         coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id
  FROM documents WINDOW w AS (ORDER BY doc_id DESC)
), e AS (
  SELECT doc_id, n, next_id, t,
         substring(t, 1, n - n // 3) || substring(coalesce(after, top), 1, n // 3) AS edited
  FROM d
), both_ AS (SELECT doc_id, 0 AS which, t AS x FROM e UNION ALL SELECT doc_id, 1, edited FROM e
), p AS (
  SELECT doc_id, which, sha256(piece) AS ha, sha256('1' || piece) AS hb FROM (
    SELECT doc_id, which, unnest(string_split(x, chr(10))) AS piece FROM both_)
), own AS (
  SELECT doc_id, which, lane AS no,
         (sum(('0x' || substring(CASE WHEN lane < 4 THEN ha ELSE hb END, (15 * (lane % 4) + 1)::INT, 15))::BIGINT)
          % 1152921504606846976)::BIGINT AS v
  FROM p, range(8) r(lane) GROUP BY ALL
), s AS (
  SELECT doc_id, which, md5(piece) AS h FROM (
    SELECT doc_id, which,
           unnest(string_split(regexp_replace(x, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS piece
    FROM both_) WHERE piece <> ''
), number_ AS (SELECT doc_id, which, 8 AS no, count(h) AS v FROM both_ LEFT JOIN s USING (doc_id, which) GROUP BY ALL
), counts AS (
  SELECT doc_id, which, 9 + 30 * word + bit AS no,
         sum((('0x' || substring(h, (15 * word + 1)::INT, 15))::BIGINT >> bit::INT) & 1073741825)::BIGINT AS v
  FROM s, range(2) w(word), range(30) b(bit) GROUP BY ALL
), every AS (
  SELECT doc_id, which, no, coalesce(v, 0) AS v FROM both_ CROSS JOIN range(69) r(no)
  LEFT JOIN (FROM own UNION ALL FROM number_ UNION ALL FROM counts) USING (doc_id, which, no)
), f AS (
  SELECT doc_id, which, list(v ORDER BY no) AS v FROM every GROUP BY ALL
), j AS (
  SELECT e.doc_id, e.n, e.edited, a.v AS va, b.v AS vb, c.v AS vc
  FROM e JOIN f a ON a.doc_id = e.doc_id AND a.which = 0 JOIN f b ON b.doc_id = e.doc_id AND b.which = 1
  JOIN f c ON c.doc_id = e.next_id AND c.which = 0
), lanes AS (
  SELECT doc_id, n, edited, va, vb, vc,
         list_transform(range(120), lambda i: 2 * ((va[10 + i // 2] >> (30 * (i % 2))::INT) & 1073741823) - va[9]) AS xa,
         list_transform(range(120), lambda i: 2 * ((vb[10 + i // 2] >> (30 * (i % 2))::INT) & 1073741823) - vb[9]) AS xb,
         list_transform(range(120), lambda i: 2 * ((vc[10 + i // 2] >> (30 * (i % 2))::INT) & 1073741823) - vc[9]) AS xc
  FROM j
), dots AS (
  SELECT *, list_sum(list_transform(xa, lambda x: x * x))::DOUBLE AS aa,
         list_sum(list_transform(xb, lambda x: x * x))::DOUBLE AS bb,
         list_sum(list_transform(xc, lambda x: x * x))::DOUBLE AS cc,
         list_sum(list_transform(range(1, 121), lambda i: xa[i] * xb[i]))::DOUBLE AS ab,
         list_sum(list_transform(range(1, 121), lambda i: xa[i] * xc[i]))::DOUBLE AS ac
  FROM lanes
)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256,
       list_aggregate(list_transform(va, lambda x: format('{:015x}', x)), 'string_agg', '') AS fingerprint,
       list_aggregate(list_transform(vb, lambda x: format('{:015x}', x)), 'string_agg', '') AS edited_fingerprint,
       round(CASE WHEN va = vb THEN 1.0::DOUBLE WHEN aa * bb > 0 THEN greatest(0, least(1, ab / (sqrt(aa) * sqrt(bb)))) ELSE 0 END, 6) AS near_edited,
       round(CASE WHEN va = vc THEN 1.0::DOUBLE WHEN aa * cc > 0 THEN greatest(0, least(1, ac / (sqrt(aa) * sqrt(cc)))) ELSE 0 END, 6) AS near_next
FROM dots
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.matches(docs, _table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH i AS (
  SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS ws
  FROM benchmark
), si AS (
  SELECT DISTINCT item_id, least(len(ws), 5) AS k,
         unnest(list_transform(range(1, len(ws) - least(len(ws), 5) + 2),
                               lambda p: array_to_string(ws[p:p + least(len(ws), 5) - 1], ' '))) AS s
  FROM i WHERE len(ws) > 0
), q AS (SELECT item_id, k, count(*) AS n_item FROM si GROUP BY item_id, k), sizes AS (SELECT DISTINCT k FROM si), d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda w: w <> '') AS ws
  FROM documents
), sd AS (
  SELECT DISTINCT doc_id, k,
         unnest(list_transform(range(1, len(ws) - k + 2), lambda p: array_to_string(ws[p:p + k - 1], ' '))) AS s
  FROM d, sizes WHERE len(ws) >= k
)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM sd JOIN si USING (s, k) JOIN q USING (item_id, k)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(_table(spark, sf_dir, "documents").select("text", "lang"))


OP11_SQL = rf"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
  FROM w, range(1, 6) r(k) WHERE len(ws) >= k
), f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL
), totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE f >= 100 AND k >= 2
), parts AS (
  SELECT lang, a, unnest(list_transform(range(1, k - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM c, range(2, 5) r(size) WHERE size < k
), kept AS (
  SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL) USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:], ' ') AS y
  FROM kept, range(1, 5) r(cut) WHERE cut < k
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n,
         ((1000 * a)::HUGEINT * n // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y
  JOIN totals ON totals.lang = cuts.lang
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY rank <= 2000
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id",
        quality_gam.held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op13_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return ball_search.ranked(_table(spark, sf_dir, "benchmark"), docs)


OP13_SQL = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents
), size AS (SELECT count(*) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM d WHERE len(ws) > 0
), i AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), it AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL
), tf AS (
  SELECT doc_id, n, term, count(*) AS tf
  FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) SEMI JOIN it USING (term) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term
), s AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM it JOIN tf USING (term) JOIN w USING (term), size GROUP BY ALL
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
""".replace("\\\\", "\\")


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_gam": op2_quality_gam,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_near_dedup": op5_near_dedup,
    "op6_warc": op6_warc,
    "op7_secret_scan": op7_secret_scan,
    "op8_fingerprint": op8_fingerprint,
    "op9_token_file": op9_token_file,
    "op10_decontaminate": op10_decontaminate,
    "op11_collocations": op11_collocations,
    "op12_toxicity": op12_toxicity,
    "op13_ball_search": op13_ball_search,
}
ORACLES = {
    "op1_line_dedup": OP1_SQL,
    "op6_warc": OP6_SQL,
    "op7_secret_scan": _op7_sql(),
    "op8_fingerprint": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
    "op11_collocations": OP11_SQL,
    "op13_ball_search": OP13_SQL,
}
