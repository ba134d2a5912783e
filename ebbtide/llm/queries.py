"""Registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ebbtide.llm import (
    chat,
    decontamination,
    exact_dedup,
    html_text,
    mixing,
    ngram_join,
    phrases,
    quality,
    secret_scan,
    spelling,
    token_file,
    unigram,
    url_filter,
)
from ebbtide.llm.common import bounded_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string"
    )
    return chat.digests(chat.format_conversations(rows.unionByName(extra)))


_CONTROL = r"(\\*(?:### |</turn>))"
CHAT_SQL = rf"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
   UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
 sized AS (SELECT *, length(regexp_replace(text, '{_CONTROL}', '\\\1', 'g')) + length(role) + 15
   + CASE WHEN role IN ('system', 'user', 'assistant') THEN 0 ELSE 2 END AS chars FROM turns),
 whole AS (SELECT conv_id, count(*) AS n_turns,
   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS lines,
   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
   sum(chars) AS chars FROM sized GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
 CAST(chars AS BIGINT) AS formatted_chars FROM whole"""


def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similarity_components(table(spark, folder, "documents"), size=4, percent=85)


NGRAM_SQL = rf"""WITH RECURSIVE words AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
   '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 grams AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ')
   ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS g
   FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS i)),
 sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
 common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
 links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
 reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id"""


def op3_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digests(secret_scan.find_secrets(table(spark, folder, "documents")))


def op4_token_count(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents"))


DEDUP_SQL = f"""WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)"""


def op7_token_file(spark: SparkSession, folder: str) -> DataFrame:
    return token_file.token_files(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


#: verdict, host and path of the rules that come before the model.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, folder, "pages"), URL_RULES)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, folder, "documents"))


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


SPELLING_SQL = rf"""WITH RECURSIVE bits AS (SELECT i AS byte, CAST(i AS BIGINT) AS v, 0 AS step FROM range(256) t(i)
   UNION ALL SELECT byte, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, step + 1 FROM bits WHERE step < 8),
 crc AS MATERIALIZED (SELECT list(v ORDER BY byte) AS t FROM bits WHERE step = 8),
 runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
 held AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
 marked AS (SELECT run, n, xor(list_reduce(flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
   lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END)),
   lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM held, crc),
 words AS MATERIALIZED (SELECT w AS word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0
   THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS w FROM marked)
   WHERE length(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
 cut AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)),
 pairs AS (SELECT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
   UNION SELECT a.word, a.n, b.word, b.n FROM words a JOIN cut b ON a.word = b.rest
   UNION SELECT b.word, b.n, a.word, a.n FROM words a JOIN cut b ON a.word = b.rest),
 best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-bn, encode(b))) AS form, max(bn) AS form_n FROM pairs GROUP BY a),
 near AS MATERIALIZED (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
   CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
 walk AS (SELECT word, word AS at, form AS ahead FROM near
   UNION ALL SELECT walk.word, walk.ahead, near.form FROM walk JOIN near ON near.word = walk.ahead)
SELECT near.word, form, walk.at AS root, n, n_near, form_n FROM near JOIN walk ON walk.word = near.word AND walk.ahead IS NULL"""


def op12_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(table(spark, folder, "pages"))


def op13_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


PHRASES_SQL = rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id,
   unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
 words AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
 grams AS (SELECT lang, k AS size, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM words, LATERAL (SELECT unnest([1, 2, 3]) AS k),
   LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
 f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
 totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
 cuts AS (SELECT lang, size, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f, LATERAL (SELECT unnest(generate_series(1, size - 1)) AS k)),
 scored AS (SELECT c.lang, c.size, c.phrase, a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score FROM cuts c
   JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(w[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(w[k + 1:c.size], ' ')),
 weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
 free AS (SELECT * FROM weakest s WHERE NOT EXISTS (SELECT 1 FROM cuts t WHERE s.size = 2 AND t.size = 3 AND t.lang = s.lang AND 100 * t.a >= 50 * s.a
   AND s.phrase = CASE t.k WHEN 1 THEN array_to_string(t.w[2:3], ' ') ELSE array_to_string(t.w[1:2], ' ') END)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM free)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_ngram_join": op2_ngram_join,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_count": op4_token_count,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_file": op7_token_file,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_source_mix": op10_source_mix,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_html_extraction": op12_html_extraction,
    "op13_phrase_mining": op13_phrase_mining,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": CHAT_SQL,
    "op2_ngram_join": NGRAM_SQL,
    "op6_exact_dedup": DEDUP_SQL,
    "op11_spelling_variants": SPELLING_SQL,
    "op13_phrase_mining": PHRASES_SQL,
}
