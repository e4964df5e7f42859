"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bin_packing, chat_rotation, decontamination, hard_negatives, language_id, ngram_join, periodic_runs, sharding, substring_dedup, token_ids, topk_search, unigram, warc
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.run(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.run(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encode_decode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.run(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.run(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_rotation.rotate(table(spark, sf_dir, "conversations"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.run(table(spark, sf_dir, "embeddings"))


def op11_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.run(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.run(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_sharding, op2_token_ids, op3_language_id, op4_sentencepiece, op5_substring_dedup, op6_warc, op7_decontamination, op8_ngram_join, op9_chat_rotation, op10_topk_search, op11_bin_packing, op12_periodic_runs, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_substring_dedup": r"""
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            p AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
            m AS (SELECT win, min(doc_id) AS mn FROM p GROUP BY win),
            gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM p JOIN m USING (win) WHERE mn < doc_id),
            words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
            kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.pos) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos WHERE gone.pos IS NULL GROUP BY words.doc_id)
            SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id""",
        "op6_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
            d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, upper(sha1(body)) AS hex, max(page_id) OVER (PARTITION BY body) AS top FROM p),
            c AS (SELECT *, list_transform([1, 11, 21, 31], lambda a: ('0x' || substr(hex, a, 10))::BIGINT) AS ints FROM d)
            SELECT page_id, payload_bytes,
              array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((ints[k // 8 + 1] >> (35 - 5 * (k % 8))) & 31) + 1)::INT, 1)), '') AS payload_digest,
              CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM c""",
        "op7_decontamination": r"""
            WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
            b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
            iw AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0))),
            sizes AS (SELECT DISTINCT k FROM iw),
            dw AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS win FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, sizes)),
            hit AS (SELECT dw.doc_id, item_id, i, dw.k FROM dw JOIN iw ON dw.win = iw.win AND dw.k = iw.k),
            pos AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
            items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
            SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
            FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
        "op8_ngram_join": r"""
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
            n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
            pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
            links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
            both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
            reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
            SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = w.doc_id""",
        "op9_chat_rotation": r"""
            WITH r AS (SELECT conv_id, coalesce(turn, 0) AS turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g'), '[\r\n]', ' ', 'g') AS speaker, regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') AS text FROM conversations WHERE conv_id IS NOT NULL),
            n AS (SELECT *, floor(turn / 512) AS run, (row_number() OVER (PARTITION BY conv_id, floor(turn / 512) ORDER BY turn, speaker, text) - 1) // 512 AS place FROM r),
            t AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY run, place) - 1 AS part FROM n),
            p AS (SELECT DISTINCT conv_id, speaker AS participant FROM t WHERE speaker <> 'system'),
            c AS (SELECT t.*, participant, '<|im_start|>' || CASE WHEN speaker = participant THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user name=' || speaker END || chr(10) AS head, text || '<|im_end|>' AS body FROM t JOIN p USING (conv_id)),
            e AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, participant ORDER BY turn, speaker, text ROWS UNBOUNDED PRECEDING) AS stop FROM c)
            SELECT conv_id, part, participant, count(*)::BIGINT AS n_turns, string_agg(head || body || chr(10), '' ORDER BY turn, speaker, text) AS text,
              coalesce(string_agg((stop - 1 - length(body))::BIGINT || '-' || (stop - 1)::BIGINT, ',' ORDER BY turn, speaker, text) FILTER (WHERE speaker = participant), '') AS mask
            FROM e GROUP BY conv_id, part, participant""",
        "op10_topk_search": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
              WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
            SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
        "op12_periodic_runs": r"""
            WITH w0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
            h AS (SELECT *, len(ws)::BIGINT AS n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) AS h FROM w0),
            g AS (SELECT *, h // 10 AS g, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM h),
            w AS (SELECT doc_id, n, CASE WHEN a < n THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM g),
            p AS (SELECT doc_id, i - 1 AS i, array_to_string(ws[i:i + 4], ' ') AS five FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
            e AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM p x JOIN p y ON x.doc_id = y.doc_id AND x.five = y.five AND x.i < y.i),
            s AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e) GROUP BY doc_id, q, island HAVING count(*) + 4 + q >= greatest(6, 4 * q)),
            r AS (SELECT doc_id, start, length, q AS period FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.doc_id = s.doc_id AND t.q < s.q AND t.start <= s.start AND t.start + t.length >= s.start + s.length)),
            top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM r),
            lines AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs FROM r GROUP BY doc_id),
            gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) + 1 AS pos FROM r),
            words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
            kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.pos) AS t FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos WHERE gone.pos IS NULL GROUP BY words.doc_id)
            SELECT w.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, top.start::BIGINT AS start, top.length::BIGINT AS length, top.period::BIGINT AS period, (1000 * top.length // top.period)::BIGINT AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
            FROM w LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN top ON top.doc_id = w.doc_id AND top.k = 1 LEFT JOIN kept ON kept.doc_id = w.doc_id""",
        "op13_hard_negatives": """
            WITH v AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
              WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, list_inner_product(a.e, v.e)::BIGINT AS score FROM v a JOIN v ON a.vec_id % 100 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
            p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same) WHERE k <= 5),
            n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
              FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
            SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
    }
