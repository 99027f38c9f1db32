"""One query per operator over its whole table, with the contract's parameters."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsight.functions.frames import materialise, new_folder
from twinsight.llm import (
    class_lm,
    collocations,
    decontaminate,
    html_text,
    mixing,
    near_dedup,
    nearest,
    quality_rules,
    ranked_search,
    substring_dedup,
    token_counts,
    token_files,
    toxicity,
)

WORD_BPE = "word_bpe_49k.json"
END_ID = 1


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    counted = token_counts.with_token_counts(docs, tokenizer_path(WORD_BPE))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_file_sums(table(spark, folder, "documents"))


def token_file_sums(docs: DataFrame) -> DataFrame:
    """Write token files and read them back: ``doc_id, start, n_tokens, ids_crc32``."""
    spark = docs.sparkSession
    out = new_folder(spark, "token-files")
    token_files.write_token_files(docs, out, tokenizer_path(WORD_BPE), END_ID)
    sums = materialise(token_files.with_crc32(token_files.read_token_files(spark, out)))  # a few numbers a document
    return token_files.with_starts(sums, sums).select("doc_id", "start", "n_tokens", "ids_crc32")


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge_quality(table(spark, folder, "documents"))
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"]
    return judged.select("doc_id", *columns)


def held_out(parts: int) -> Column:
    """Rows whose crc32 of the id as text leaves the remainder 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == 2, F.lit(False))


def fitted_toxicity(docs: DataFrame, folder: str) -> toxicity.ToxicityModel:
    labels = table(docs.sparkSession, folder, "labels").select("doc_id", "toxic").filter(~held_out(4))
    return toxicity.fit_toxicity(docs.select("doc_id", "text"), labels)


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = toxicity.score_toxicity(docs, fitted_toxicity(docs, folder))
    return scored.select("doc_id", held_out(4).alias("held_out"), "score", "predicted")


def op5_class_lm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", held_out(7).alias("held_out"))
    return class_lm.score_texts(docs)


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = html_text.with_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_find_leaks(spark: SparkSession, folder: str) -> DataFrame:
    leaks = decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return leaks.select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_token_files": op2_token_files,
    "op3_quality_rules": op3_quality_rules,
    "op4_toxicity": op4_toxicity,
    "op5_class_lm": op5_class_lm,
    "op6_near_dedup": op6_near_dedup,
    "op7_main_text": op7_main_text,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_find_leaks": op10_find_leaks,
    "op11_collocations": op11_collocations,
    "op12_nearest": op12_nearest,
    "op13_ranked_search": op13_ranked_search,
}

MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':mix') AS draw
  FROM documents),
s AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY key) - 1 AS rank FROM d GROUP BY key),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, key) AS pos, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM w),
c AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM r),
level AS (SELECT coalesce(arg_min((budget - caps) / free, pos) FILTER (WHERE cap > weight * ((budget - caps) / free)), 1e300) AS level FROM c),
t AS (SELECT key, source_size, least(cap, weight * level) AS target,
    CASE WHEN source_size > 0 THEN CAST(floor(least(cap, weight * level) / source_size) AS BIGINT) ELSE 0 END AS whole FROM w, level),
e0 AS (SELECT d.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS room, false AS again FROM d JOIN t ON d.key = t.key)
"""
# The operator fills until nothing fits; so many rounds are more than the test tables need.
_ROUNDS = 12
for _r in range(_ROUNDS):
    MIX_SQL += f""",
x{_r} AS MATERIALIZED (SELECT key, draw, sum(size) OVER (PARTITION BY key ORDER BY draw) AS upto FROM e{_r} WHERE NOT again AND size > 0 AND size <= room),
y{_r} AS MATERIALIZED (SELECT e.key, max(x.draw) AS cut, max(x.upto) AS used FROM (SELECT DISTINCT key, room FROM e{_r}) e JOIN x{_r} x ON e.key = x.key AND x.upto <= e.room GROUP BY e.key),
e{_r + 1} AS MATERIALIZED (SELECT e.* EXCLUDE (room, again), e.room - coalesce(y.used, 0) AS room,
  e.again OR (e.size > 0 AND e.size <= e.room AND e.draw <= coalesce(y.cut, '')) AS again FROM e{_r} e LEFT JOIN y{_r} y ON e.key = y.key)"""
MIX_SQL += f"""
SELECT doc_id, size, source_size, target, CAST((whole + CAST(again AS INT)) * size AS BIGINT) AS taken FROM e{_ROUNDS}
"""

LEAK_SQL = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
q AS (SELECT id AS item_id, count(*) AS n_shingles FROM s WHERE kind = 'i' GROUP BY id),
p AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.shingle = i.shingle AND d.kind = 'd' AND i.kind = 'i' GROUP BY 1, 2)
SELECT doc_id, p.item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM p JOIN q ON p.item_id = q.item_id WHERE 1000 * n_shared >= 800 * n_shingles
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT w.doc_id, count(s.shingle) AS n_shingles FROM w LEFT JOIN s ON w.doc_id = s.doc_id GROUP BY w.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
r AS (SELECT doc_id, doc_id AS reached FROM n UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a)
SELECT n.doc_id, n_shingles, min(reached) AS component_id, n.doc_id = min(reached) AS kept FROM n JOIN r ON n.doc_id = r.doc_id GROUP BY n.doc_id, n_shingles
"""

REPEAT_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS seq FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
f AS (SELECT seq, min(struct_pack(d := doc_id, i := i)) AS first FROM s GROUP BY seq HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(s.i, s.i + 20)) AS i FROM s JOIN f ON s.seq = f.seq WHERE struct_pack(d := doc_id, i := s.i) <> f.first),
k AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
x AS (SELECT k.doc_id, k.i, k.w[k.i] AS word FROM k ANTI JOIN r ON k.doc_id = r.doc_id AND k.i = r.i),
t AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS kept FROM x GROUP BY doc_id)
SELECT w.doc_id, len(w.w) AS n_words, len(w.w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN t ON w.doc_id = t.doc_id
"""

PHRASE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, x.f AS l, y.f AS r,
    CAST(1000000::HUGEINT * a * a // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1 : cut], ' ')
  JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cut + 1 :], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1 : 2], ' ') AS phrase, a FROM c WHERE k = 3
    UNION ALL SELECT lang, array_to_string(w[2 : 3], ' '), a FROM c WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
WHERE coalesce(100 * longer < 50 * a, true) QUALIFY rank <= 2000
"""

SEARCH_SQL = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
f AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM d) GROUP BY ALL),
i AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f WHERE term IN (SELECT term FROM q) GROUP BY term), totals),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN w ON q.term = w.term JOIN f ON f.term = q.term, totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

ORACLES = {
    "op13_ranked_search": SEARCH_SQL,
    "op11_collocations": PHRASE_SQL,
    "op8_substring_dedup": REPEAT_SQL,
    "op6_near_dedup": NEAR_SQL,
    "op10_find_leaks": LEAK_SQL,
    "op9_mix_sources": MIX_SQL,
}
