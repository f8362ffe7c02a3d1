"""The registered queries of the text operators and their SQL."""

from __future__ import annotations

import public_tokenizers

from tallypanel.llm import (
    alignment,
    bpe,
    line_dedup,
    lm_score,
    mixing,
    ngram_join,
    nn_descent,
    preferences,
    quality_fm,
    quality_rules,
    sharding,
    toxicity,
    whitening,
)
from tallypanel.llm.common import table

QUERIES = {}
SQL = {}


def query(name, sql=None):
    def register(build):
        QUERIES[name] = build
        if sql:
            SQL[name] = sql
        return build

    return register


@query(
    "op1_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, unnest(range(len(parts))) AS pos, unnest(parts) AS line
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    ),
    keyed AS (
      SELECT *, translate(
        regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM lines
    ),
    common AS (
      SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ),
    marked AS (
      SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AS dropped
      FROM keyed k LEFT JOIN common c ON k.key = c.key
    )
    SELECT doc_id, count(*) AS n_lines, count_if(dropped)::BIGINT AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
    """,
)
def op1_line_dedup(spark, sf_dir):
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


MIX_COLUMNS = ["doc_id", "source", "size", "source_size", "weight", "target", "copies", "taken"]


@query(
    "op8_source_mixing",
    r"""
    WITH sizes AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
      FROM documents
    ),
    totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
    shares AS (
      SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM totals
    ),
    -- Sources in the order in which they reach their limit as the level rises.
    rising AS (
      SELECT *, sum(source_size) OVER ()::BIGINT AS words, sum(weight) OVER ()::BIGINT AS weights,
        coalesce(sum(3 * source_size) OVER up, 0)::BIGINT AS stopped,
        coalesce(sum(weight) OVER up, 0)::BIGINT AS stopped_weight,
        row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source) AS step
      FROM shares
      WINDOW up AS (ORDER BY 3.0::DOUBLE * source_size / weight, source
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    ),
    found AS (
      SELECT arg_min((words - stopped)::DOUBLE / (weights - stopped_weight), step) AS level FROM rising
      WHERE (words - stopped)::DOUBLE / (weights - stopped_weight) * weight <= 3 * source_size
    ),
    targets AS (
      SELECT source, source_size, weight, least((3 * source_size)::DOUBLE, level * weight) AS target,
        ('0x' || substr(md5('0:' || coalesce('s' || source, 'n')), 1, 4))::INT::DOUBLE / 65536 AS u
      FROM shares, found
    ),
    placed AS (
      SELECT s.doc_id, s.source, s.size, t.source_size, t.weight, t.target, t.u,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
        row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id) - 1 AS place
      FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
    ),
    taken AS (
      SELECT *, (floor((place + 1) * rate + u) - floor(place * rate + u))::BIGINT AS copies FROM placed
    )
    SELECT doc_id, source, size, source_size, weight::INT AS weight, target, copies, copies * size AS taken
    FROM taken
    """,
)
def op8_source_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select(*MIX_COLUMNS)


@query("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_byte_bpe")
def op7_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.token_report(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op10_quality_fm")
def op10_quality_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_fm.quality(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query("op4_ngram_jaccard_join")
def op4_ngram_jaccard_join(spark, sf_dir):
    found = ngram_join.similar_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links", "kept")



@query(
    "op5_embedding_near_dedup",
    """
    WITH RECURSIVE good AS (
      SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM good a
      JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.93
    ),
    reach AS (
      SELECT a AS v, a AS w FROM links
      UNION
      SELECT r.v, l.b FROM reach r JOIN links l ON r.w = l.a
    ),
    roots AS (SELECT v, min(w) AS root FROM reach GROUP BY v),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(r.root, e.vec_id) AS component_id,
      coalesce(r.root, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN roots r ON e.vec_id = r.v LEFT JOIN counts c ON e.vec_id = c.a
    """,
)
def op5_embedding_near_dedup(spark, sf_dir):
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


PREFERENCE_COLUMNS = [
    "pair_id", "chosen", "rejected", "prefix_turns", "prompt", "chosen_text", "rejected_text",
    "chosen_loss_chars", "rejected_loss_chars",
]


@query(
    "op6_preference_formatting",
    r"""
    WITH turns AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id
          ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
      FROM conversations
    ),
    keyed AS (SELECT *, md5(role || chr(10) || text) AS key FROM turns),
    answers AS (
      SELECT conv_id, arg_max(text, place) AS text, max(place) AS last
      FROM turns WHERE role = 'assistant' GROUP BY conv_id
    ),
    kinds AS (
      SELECT text, min(conv_id) AS giver, row_number() OVER (ORDER BY md5(text)) - 1 AS n, count(*) OVER () AS m
      FROM answers GROUP BY text
    ),
    branches AS (
      SELECT a.conv_id, a.last, o.text AS instead, o.giver,
        row_number() OVER (ORDER BY a.conv_id NULLS FIRST) - 1 AS pair_id
      FROM answers a JOIN kinds k ON a.text = k.text JOIN kinds o ON o.n = (k.n + 1) % k.m WHERE k.m > 1
    ),
    pairs AS (SELECT pair_id, conv_id AS chosen, giver AS rejected FROM branches),
    told AS (
      SELECT b.pair_id, true AS is_chosen, k.place, k.role, k.text, k.key
      FROM branches b JOIN keyed k ON b.conv_id IS NOT DISTINCT FROM k.conv_id AND k.place <= b.last
      UNION ALL
      SELECT b.pair_id, false AS is_chosen, k.place, k.role,
        CASE WHEN k.place = b.last THEN b.instead ELSE k.text END AS text,
        CASE WHEN k.place = b.last THEN md5(role || chr(10) || b.instead) ELSE k.key END AS key
      FROM branches b JOIN keyed k ON b.conv_id IS NOT DISTINCT FROM k.conv_id AND k.place <= b.last
    ),
    places AS (
      SELECT pair_id, place, max(key) FILTER (WHERE is_chosen) AS c, max(key) FILTER (WHERE NOT is_chosen) AS r
      FROM told GROUP BY pair_id, place
    ),
    ends AS (
      SELECT pair_id, coalesce(min(place) FILTER (WHERE c IS DISTINCT FROM r), max(place) + 1) AS prefix_turns
      FROM places GROUP BY pair_id
    ),
    shown AS (
      SELECT t.*, e.prefix_turns, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece,
        CASE WHEN role = 'assistant' THEN length(text) + 8 ELSE 0 END AS loss
      FROM told t JOIN ends e USING (pair_id)
    )
    SELECT p.pair_id, p.chosen, p.rejected, any_value(s.prefix_turns) AS prefix_turns,
      coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE is_chosen AND place < s.prefix_turns), '') AS prompt,
      coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE is_chosen AND place >= s.prefix_turns), '') AS chosen_text,
      coalesce(string_agg(piece, '' ORDER BY place) FILTER (WHERE NOT is_chosen AND place >= s.prefix_turns), '') AS rejected_text,
      coalesce(sum(loss) FILTER (WHERE is_chosen AND place >= s.prefix_turns), 0)::BIGINT AS chosen_loss_chars,
      coalesce(sum(loss) FILTER (WHERE NOT is_chosen AND place >= s.prefix_turns), 0)::BIGINT AS rejected_loss_chars
    FROM pairs p JOIN shown s USING (pair_id) GROUP BY p.pair_id, p.chosen, p.rejected
    """,
)
def op6_preference_formatting(spark, sf_dir):
    """Every conversation against a branch of it: the tables name no preferences."""
    return preferences.format_branches(table(spark, sf_dir, "conversations")).select(*PREFERENCE_COLUMNS)


@query("op3_lm_scoring")
def op3_lm_scoring(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return lm_score.score(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark, sf_dir):
    paths = [public_tokenizers.path(p) for p in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return alignment.align_report(table(spark, sf_dir, "documents"), *paths)


@query(
    "op12_sharding",
    """
    WITH RECURSIVE steps AS (
      -- The table of the checksum: what each byte leads to.
      SELECT list(v ORDER BY i) AS t FROM (
        SELECT i, list_reduce(range(8),
          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS v
        FROM range(256) r(i))
    ),
    facts AS (
      SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size,
        ('0x' || substr(md5(coalesce('#' || doc_id, 'null')), 1, 15))::BIGINT AS key,
        xor(list_reduce(
          list_transform(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\\1 ', 'g'), ' ')[:-2],
            lambda h: ('0x' || h)::BIGINT),
          lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)::BIGINT AS crc
      FROM documents, steps
    ),
    jumps AS (
      SELECT r, key::HUGEINT AS key, 0::BIGINT AS shard, 0::BIGINT AS ahead, n FROM facts, (VALUES (8), (9)) v(n)
      UNION ALL
      SELECT r, next, ahead AS shard,
        floor((ahead + 1) * (2147483648.0::DOUBLE / ((next // 8589934592)::DOUBLE + 1)))::BIGINT AS ahead, n
      FROM (
        SELECT *, (key * 2862933555777941757::HUGEINT + 1) % 18446744073709551616::HUGEINT AS next
        FROM jumps WHERE ahead < n
      )
    ),
    ends AS (
      SELECT r, max(shard) FILTER (WHERE n = 8)::INT AS shard, max(shard) FILTER (WHERE n = 9)::INT AS grown_shard
      FROM jumps GROUP BY r
    )
    SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard, grown_shard,
      row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot
    FROM facts JOIN ends USING (r)
    """,
)
def op12_sharding(spark, sf_dir):
    return sharding.assign(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
