"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hard_negatives, language_gru, line_dedup, merkle, near_dups, packing, pieces, quality_gam, quality_rules, secret_ledger, token_files, warc
from tessera.llm._shared import ascii_lower, crc_mod, cut, new_folder, table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_gam.train(docs, table(spark, sf_dir, "labels"))
    return quality_gam.classify(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed_rules", ",").alias("failed_rules"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.decontaminate_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dups.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long"), F.col("n_removed").cast("long"), F.sha2("text", 256).alias("text_sha256"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), PIECES, as_list=False)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_language_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_gru.train(docs)
    out = language_gru.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    # headers and digests alone: small, and used by several joins
    captures = warc.assemble(cut(warc.read_records(spark, path, payloads=False)))
    # a row each pages row
    captures = captures.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    page = lambda c: F.element_at(F.col(f"{c}.fields"), "page-id").cast("long")
    return captures.select(page("metadata").alias("page_id"), "response.payload_bytes", "response.payload_digest", F.col("response.type").alias("record_type"), page("refers_to_metadata").alias("refers_to"))


def op9_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = secret_ledger.scan_documents(docs, new_folder(spark, "ledger"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin(*secret_ledger.BASE))
    return out.select("doc_id", *[count(k).alias(f"n_{k}") for k in secret_ledger.BASE], F.sha2(secret_ledger.spans_text(base), 256).alias("base_sha256"), secret_ledger.spans_text(F.col("found")).alias("spans"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, WORDS, end_id=1)
    return token_files.read_offsets(spark, path, token_files.ids_crc32(F.col("ids")).alias("ids_crc32")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTES, end_id=0, capacity=1024, with_ids=False)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = merkle.leaf(*[ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS])
    return merkle.manifest(table(spark, sf_dir, "documents"), claimed=F.when(crc_mod(F.col("doc_id"), 3) == 0, claimed)).audit()


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.vectors(table(spark, sf_dir, "embeddings"), hard_negatives.shifted_label()))


QUERIES = {f.__name__: f for f in (op1_quality_gam, op2_quality_rules, op3_winnowing, op4_hyperminhash, op5_line_windows, op6_pieces, op7_language_gru, op8_warc, op9_secret_ledger, op10_token_files, op11_packing, op12_merkle, op13_hard_negatives)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FIELD = "coalesce(strlen({0}::VARCHAR) || ':' || {0}, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, z: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)"
_BENCH_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"

ORACLE_SQL = {
    "op3_winnowing": f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 13 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) END) AS x FROM b),
ns AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, ns WHERE len(w) >= n),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN iw ON iw.n = dw.n AND iw.x = array_to_string(w[i:i + dw.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
t AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_hyperminhash": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.v WHERE r.c < l.y),
m AS (SELECT v AS doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op5_line_windows": """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, n, array_to_string(l[i:i + n - 1], chr(10)) AS x FROM (SELECT doc_id, l, least(len(l), 3) AS n, unnest(range(1, len(l) - least(len(l), 3) + 2)) AS i FROM d)),
f AS (SELECT doc_id, i, n, row_number() OVER (PARTITION BY n, x ORDER BY doc_id, i) AS k FROM w WHERE regexp_matches(x, '[^ \t\n\v\f\r]')),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM f WHERE k > 1),
e AS (SELECT d.doc_id, u.i, l[u.i] AS line, g.i IS NULL AS stays FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d) u JOIN d USING (doc_id, l) LEFT JOIN g ON g.doc_id = u.doc_id AND g.i = u.i),
o AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '') AS t FROM e GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, CASE WHEN text IS NULL THEN NULL ELSE sha256(t) END AS text_sha256 FROM d LEFT JOIN o USING (doc_id)""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS keep FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(s, ''), lambda c: to_base(instr('0123456789abcdef', c) - 1, 2, 4)), '') AS bits FROM q)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::INT, 1)), '') AS payload_digest,
CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keep <> page_id THEN keep END AS refers_to FROM b""",
    "op12_merkle": f"""
WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM (
SELECT doc_id, lang, {_LEAF("text")} AS leaf, CASE WHEN {_CRC} % 3 = 0 THEN {_LEAF(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS claimed FROM documents)),
t(lang, level, pos, h) AS (SELECT lang, 0, pos, leaf FROM l UNION ALL SELECT lang, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM t) WHERE c > 1 GROUP BY lang, level, pos // 8),
top AS (SELECT lang, max(level) AS levels FROM t GROUP BY 1),
s AS (SELECT t.lang, h AS subroot, row_number() OVER (ORDER BY t.lang NULLS FIRST) - 1 AS pos FROM t JOIN top ON t.lang IS NOT DISTINCT FROM top.lang AND level = levels),
g(level, pos, h) AS (SELECT 0, pos, subroot FROM s UNION ALL SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS c FROM g) WHERE c > 1 GROUP BY level, pos // 8),
r AS (SELECT h AS root, level AS levels FROM g WHERE level = (SELECT max(level) FROM g)),
runs AS (SELECT doc_id, t.level AS k, l.pos // (8 ** t.level)::BIGINT AS own, t.pos, h FROM l JOIN t ON t.lang IS NOT DISTINCT FROM l.lang AND t.pos // 8 = l.pos // (8 ** (t.level + 1))::BIGINT JOIN top ON top.lang IS NOT DISTINCT FROM l.lang AND t.level < top.levels
UNION ALL SELECT doc_id, 1000 + g.level, s.pos // (8 ** g.level)::BIGINT, g.pos, h FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN g ON g.pos // 8 = s.pos // (8 ** (g.level + 1))::BIGINT, r WHERE g.level < r.levels),
p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS k, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS a, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS b FROM runs GROUP BY doc_id, runs.k),
f(doc_id, k, node) AS (SELECT doc_id, 0, coalesce(claimed, leaf) FROM l UNION ALL SELECT f.doc_id, p.k, sha256(p.a || node || p.b) FROM f JOIN p ON p.doc_id = f.doc_id AND p.k = f.k + 1),
z AS (SELECT doc_id, arg_max(node, k) AS folded_root FROM f GROUP BY 1),
q AS (SELECT doc_id, sha256(string_agg(a || b, '' ORDER BY k)) AS proof_sha256 FROM p GROUP BY 1)
SELECT l.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified FROM l JOIN s ON s.lang IS NOT DISTINCT FROM l.lang JOIN z USING (doc_id) LEFT JOIN q USING (doc_id), r""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS alike, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
