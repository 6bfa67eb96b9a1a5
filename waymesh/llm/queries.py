"""The corpus operators as registered queries: thin digests over each operator's own interface."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, classifier, collocation, embeddings, jaccard, langid, merkle, mixing, quality, secrets, substrings, token_counts, warc
from ._shared import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(langid.in_training()))
    return langid.predict(docs, model).withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score", "rejected", "unseen")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.weigh_in_turn)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), measures=True)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per distinct encoded length, with the suffix sums that answer every context limit."""
    histogram = token_counts.length_histogram(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return token_counts.with_suffix_sums(histogram).drop("grp")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf and path, and what is found where a share of the rows has another n_chars."""
    shown = merkle.manifest(
        table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id",
        tampered={"n_chars": F.col("n_chars") + 1}, where=F.crc32(F.col("doc_id").cast("string")) % 7 == 0,
    )
    return shown.select("doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "path"), 256).alias("proof_sha256"), "folded_root", "verified")


#: The least score of a document that is called good.
GOOD = 0.3


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = classifier.fit(docs, labels.where(~classifier.held_out()))
    scored = classifier.predict(docs, model)
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.mine(table(spark, sf_dir, "documents")).select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")


_ALL = [op1_language_id, op2_byte_bpe, op3_ngram_jaccard, op4_suffix_dedup, op5_source_mix, op6_embedding_dedup, op7_secrets, op8_quality_rules, op9_warc_index, op10_token_counts, op11_merkle_manifest, op12_quality_classifier, op13_collocations]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_ASCII_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REACH = """
linked AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(id, low) AS (SELECT a, a FROM linked UNION SELECT r.id, e.b FROM reach r JOIN linked e ON r.low = e.a),
comp AS (SELECT id, min(low) AS low FROM reach GROUP BY id)"""

_ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_ASCII_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.low, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id""",
    "op6_embedding_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.9), {_REACH},
n AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(comp.low, vec_id) AS component_id, coalesce(comp.low, vec_id) = vec_id AS kept FROM v LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.id = vec_id""",
    "op8_quality_rules": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g) WHERE k > 1) GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lines, 0) AS lines FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR (5 * n_symbols > word_chars AND n_words > 0) OR word_chars < 2 * n_words OR word_chars > 40 * n_words OR 2 * n_dup_lines > lines) AS kept FROM f""",
    "op9_warc_index": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages), m AS (SELECT n, d, max(page_id) AS newest FROM p WHERE n >= 1000 GROUP BY n, d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < newest THEN newest END AS refers_to FROM p LEFT JOIN m USING (n, d)""",
    "op11_merkle_manifest": r"""
WITH RECURSIVE v AS (SELECT doc_id, lang, source, n_chars, text, list_reduce(list_prepend(4294967295, [ord(x) FOR x IN string_split(doc_id::VARCHAR, '')]::BIGINT[]), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda q, i: xor(q >> 1, 3988292384 * (q & 1)))) AS crc FROM documents),
h AS (SELECT doc_id, lang, sha256(a || b || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || t) AS leaf, CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN sha256(a || b || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || t) END AS changed FROM
 (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') AS a, coalesce(strlen(lang) || ':' || lang, '-') AS b, coalesce(strlen(text) || ':' || text, '-') AS t FROM v)),
leaves AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM h),
nodes(g, level, i, n, h) AS (SELECT g, 0, i, n, leaf FROM leaves UNION ALL SELECT g, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY g, level, i // 2, n),
roots AS (SELECT g, h, level AS height, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, n, h) AS (SELECT 0, g, n, h FROM roots UNION ALL SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
climb AS (SELECT g, i, unnest(range((SELECT max(level) FROM nodes))) AS level FROM leaves), place AS (SELECT g, i, level, (i >> level) & 1 AS side, xor(i >> level, 1) AS want FROM climb),
rise AS (SELECT g, height, unnest(range((SELECT max(level) FROM tops) + 1)) AS level FROM roots),
steps AS (SELECT c.g, c.i, c.level, side, s.h FROM place c JOIN nodes s ON s.g = c.g AND s.level = c.level AND s.i = want WHERE s.n > 1
 UNION ALL SELECT l.g, l.i, r.height + r.level, (r.g >> r.level) & 1, t.h FROM leaves l JOIN rise r ON r.g = l.g JOIN tops t ON t.level = r.level AND t.i = xor(r.g >> r.level, 1) WHERE t.n > 1),
fold(g, i, level, top, h) AS (SELECT l.g, l.i, 0, r.height + (SELECT max(level) FROM tops), coalesce(changed, leaf) FROM leaves l JOIN roots r ON r.g = l.g
 UNION ALL SELECT f.g, f.i, f.level + 1, top, sha256(CASE WHEN s.side = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END) FROM fold f LEFT JOIN steps s ON s.g = f.g AND s.i = f.i AND s.level = f.level WHERE f.level < top),
proof AS (SELECT g, i, sha256(string_agg(h, '' ORDER BY level)) AS p FROM steps GROUP BY g, i)
SELECT doc_id, leaf, r.h AS subroot, t.h AS root, coalesce(p, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified FROM leaves l JOIN roots r ON r.g = l.g JOIN tops t ON t.n = 1 LEFT JOIN proof ON proof.g = l.g AND proof.i = l.i JOIN fold f ON f.g = l.g AND f.i = l.i AND f.level = f.top""",
    "op13_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
q AS (SELECT lang, row_number() OVER () AS id, w FROM p), u AS (SELECT lang, id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM q),
e AS (SELECT lang, x, lead(x) OVER z AS y, lead(x, 2) OVER z AS v FROM u WINDOW z AS (PARTITION BY id ORDER BY i)),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM (SELECT lang, 1 AS k, x AS g FROM e UNION ALL SELECT lang, 2, x || ' ' || y FROM e WHERE y IS NOT NULL UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || v FROM e WHERE v IS NOT NULL) GROUP BY lang, k, g),
c AS (SELECT lang, k, g, f, string_split(g, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
h AS (SELECT lang, k, g, f AS a, 1 AS cut, w[1] AS p, array_to_string(w[2:], ' ') AS q FROM c UNION ALL SELECT lang, k, g, f, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT h.lang, h.g, h.k, a, cut, x.f AS l, y.f AS r, (1000000 * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score FROM h JOIN f x ON x.lang = h.lang AND x.g = p JOIN f y ON y.lang = h.lang AND y.g = q),
b AS (SELECT lang, g, k, a, arg_min((l, r), (score, cut)) AS lr, min(score) AS score FROM s GROUP BY lang, g, k, a),
m AS (SELECT lang, g, max(a) AS most FROM (SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS g, f AS a FROM c WHERE k = 3) GROUP BY lang, g),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank FROM b LEFT JOIN m ON k = 2 AND m.lang = b.lang AND m.g = b.g WHERE most IS NULL OR 100 * most < 50 * a)
SELECT lang, rank, g AS phrase, a, lr[1] AS l, lr[2] AS r, n, score::BIGINT AS score FROM o JOIN n USING (lang) WHERE rank <= 2000""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
