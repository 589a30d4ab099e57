"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from fleetspan.llm import chat, collocations, decontamination, fingerprint, licenses, minhash, mixing, resampling, secret_scan, token_counts
from fleetspan.llm import token_files, toxicity, urls
from fleetspan.llm.common import table
from fleetspan.session import configure, scratch_path

_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def sql_words(text: str) -> str:
    return _WORDS.format(_LOWER.format(text))


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(prepare(spark), sf_dir)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and Arrow batches bounded in bytes: texts can be long."""
    configure(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    return spark


def _licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), licenses.default_templates(spark))


def _sql_licenses() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in licenses.TEMPLATES)
    return rf"""
WITH t AS (SELECT license_id, {sql_words("text")} AS w FROM (VALUES {values}) v(license_id, text)),
ts AS (SELECT DISTINCT license_id, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS s FROM t, unnest(range(1, len(w) - 3)) r(i)),
d AS (SELECT DISTINCT doc_id, text, {sql_words("text")} AS w FROM documents),
ds AS (SELECT doc_id, text, i - 1 AS spot, array_to_string(w[i:i + 4], ' ') AS s FROM d, unnest(range(1, len(w) - 3)) r(i)),
hit AS (SELECT ds.doc_id, ds.text, ds.s, spot, ts.license_id, n, spot // n AS block FROM ds JOIN ts ON ds.s = ts.s),
place AS (SELECT *, block AS b FROM hit WHERE spot + 5 <= (block + 2) * n
          UNION ALL SELECT *, block - 1 AS b FROM hit WHERE block > 0 AND spot + 5 <= (block + 1) * n),
found AS (SELECT doc_id, text, license_id, b * n AS first_word, count(DISTINCT s)
                 / (SELECT count(*) FROM ts x WHERE x.license_id = p.license_id) AS share
          FROM place p GROUP BY doc_id, text, license_id, b, n)
SELECT doc_id, license_id, count(DISTINCT first_word) AS n_windows, max(share) AS containment, min(first_word) AS first_word
FROM found WHERE share >= 0.8 GROUP BY doc_id, license_id"""


def _decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL_DECONTAMINATION = f"""
WITH i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {sql_words("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM (SELECT item, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) r(p)),
d AS (SELECT DISTINCT doc_id, text, {sql_words("text")} AS w FROM documents),
dw AS (SELECT doc_id, text, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
       FROM d, (SELECT DISTINCT n FROM iw) x, unnest(range(1, len(w) - n + 2)) r(p)),
hit AS (SELECT doc_id, text, p, dw.n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
pos AS (SELECT doc_id, text, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) r(q) GROUP BY ALL),
its AS (SELECT doc_id, text, count(DISTINCT item) AS n_items, sha256(string_agg(DISTINCT item, ',' ORDER BY item)) AS h FROM hit GROUP BY ALL)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos ON pos.doc_id IS NOT DISTINCT FROM d.doc_id AND pos.text IS NOT DISTINCT FROM d.text
       LEFT JOIN its ON its.doc_id IS NOT DISTINCT FROM d.doc_id AND its.text IS NOT DISTINCT FROM d.text"""


def _urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.default_rules(spark))


_SQL_HOST = r"translate(coalesce(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SQL_PATH = r"coalesce(regexp_extract({0}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
_SQL_KEY = "CASE WHEN contains({0}, '://') THEN " + _SQL_HOST + " || " + _SQL_PATH + r" || regexp_extract({0}, '(?s)^.*?://[^/?#]*[^?#]*(\??[^#]*)', 1) END"
SQL_URLS = rf"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
     ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
goals AS (SELECT url, CASE WHEN regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
     WHEN regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS goal FROM tags),
ends AS (SELECT url, CASE WHEN contains(goal, '://') THEN goal WHEN starts_with(goal, '//') THEN 'http:' || goal
     WHEN starts_with(goal, '/') THEN 'http://' || {_SQL_HOST.format("url")} || goal
     ELSE 'http://' || {_SQL_HOST.format("url")} || regexp_extract({_SQL_PATH.format("url")}, '(?s)^(.*/)?', 0) || goal END AS goal FROM goals WHERE goal <> ''),
edge AS (SELECT DISTINCT {_SQL_KEY.format("url")} AS a, {_SQL_KEY.format("goal")} AS b FROM ends),
both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
fit AS (SELECT DISTINCT k, h, p, rules.verdict, rules.host || rules.path AS rule FROM (
     SELECT NULL AS k, {_SQL_HOST.format("url")} AS h, {_SQL_PATH.format("url")} AS p FROM pages
     UNION SELECT a, {_SQL_HOST.format("'http://' || a")}, {_SQL_PATH.format("'http://' || a")} FROM reach) u
     JOIN rules ON (h = rules.host OR ends_with(h, '.' || rules.host)) AND starts_with(p, rules.path)),
own AS (SELECT h, p, arg_max(rule, len(rule)) AS rule, arg_max(verdict, len(rule)) AS verdict FROM fit GROUP BY h, p),
bad AS (SELECT DISTINCT r.a AS k FROM reach r JOIN own ON own.h = {_SQL_HOST.format("'http://' || r.b")}
     AND own.p = {_SQL_PATH.format("'http://' || r.b")} WHERE own.verdict = 'block'),
low AS (SELECT a AS k, min(b) AS alias FROM reach GROUP BY a)
SELECT page_id, {_SQL_HOST.format("url")} AS host, {_SQL_PATH.format("url")} AS path, own.rule AS rule,
     coalesce(own.verdict, CASE WHEN bad.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, low.alias AS alias
FROM pages LEFT JOIN own ON own.h = {_SQL_HOST.format("url")} AND own.p = {_SQL_PATH.format("url")}
     LEFT JOIN bad ON bad.k = {_SQL_KEY.format("url")} LEFT JOIN low ON low.k = {_SQL_KEY.format("url")}"""


TOKENIZER = "word_bpe_49k.json"
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id long, turn long, role string, text string"
    )
    return chat.read_back(chat.format_conversations(turns.unionByName(extra)), ordered=True).drop("n_parts")


SQL_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), ':', '\:'), '#', '\#'), '<', '\<') || ': '
             || replace(replace(replace(text, '\', '\\'), '### ', '\### '), '</turn>', '\</turn>') || '</turn>' || chr(10) AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, formatted)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, formatted) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(formatted))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id"""


def _mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


SQL_NEAR = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS sh FROM d, unnest(range(1, greatest(len(w) - 1, 2))) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(y) AS component_id, d.doc_id = min(y) AS kept
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN reach ON x = d.doc_id GROUP BY d.doc_id, n"""


def _toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def _secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def _token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = table(spark, sf_dir, "documents"), scratch_path(spark, "token-files")
    return token_files.read_documents(token_files.write_token_files(docs, public_tokenizers.path(TOKENIZER), folder))


def _resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The checksum of a word byte by byte, over the usual table for the reflected polynomial 0xEDB88320.
SQL_RESAMPLING = f"""
WITH crc(t) AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
       lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
d AS (SELECT doc_id, {sql_words("text")} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS word FROM d), bw AS (SELECT unnest({sql_words("text")}) AS word FROM benchmark),
codes AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw) x),
bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h) // 2 + 1), lambda i: CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT))),
       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS b FROM codes, crc),
s AS (SELECT b, count(*) AS n FROM dw JOIN bucket USING (word) GROUP BY b), t AS (SELECT b, count(*) AS n FROM bw JOIN bucket USING (word) GROUP BY b),
size AS (SELECT (SELECT coalesce(sum(n), 0)::DOUBLE FROM s) AS ss, (SELECT coalesce(sum(n), 0)::DOUBLE FROM t) AS tt),
gain AS (SELECT r.b, floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * (ss + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * (tt + 10000))))::BIGINT AS g
       FROM range(10000) r(b) LEFT JOIN s ON s.b = r.b LEFT JOIN t ON t.b = r.b, size),
weighed AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
       + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN weighed ON weighed.doc_id = d.doc_id),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, scored.n_features, scored.weight, scored.score, CASE WHEN place <= (SELECT count(*) FROM placed) * 10 // 100 THEN place END AS rank
FROM scored LEFT JOIN placed ON placed.doc_id = scored.doc_id"""


def _collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


SQL_COLLOCATIONS = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER.format("text")}, '[.,;:!?
-]')), '[^ 	]+') AS w FROM documents),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS a
      FROM p, unnest(range(1, 6)) x(k), unnest(range(1, len(w) - k + 2)) y(i) GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
often AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE a >= 100),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
      FROM often, unnest(range(2, k)) x(m), unnest(range(1, k - m + 2)) y(i) WHERE k > 2),
open_ AS (SELECT * FROM often o WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM inner_ c WHERE c.lang = o.lang AND c.phrase = o.phrase AND 100 * c.a >= 100 * o.a)),
cut AS (SELECT o.lang, o.phrase, o.a, j, l.a AS l, r.a AS r, n, 1000 * o.a::HUGEINT * n // (l.a::HUGEINT * r.a) AS score
      FROM open_ o, unnest(range(1, o.k)) x(j), often l, often r, total t
      WHERE l.lang = o.lang AND l.phrase = array_to_string(o.w[1:j], ' ') AND r.lang = o.lang AND r.phrase = array_to_string(o.w[j + 1:], ' ') AND t.lang = o.lang),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best) x WHERE rank <= 2000"""


QUERIES: dict[str, Query] = {
    "op1_license_scan": Query(_licenses, _sql_licenses()),
    "op2_chat_formatting": Query(_chat, SQL_CHAT),
    "op3_benchmark_decontamination": Query(_decontamination, SQL_DECONTAMINATION),
    "op4_source_mixing": Query(_mixture),
    "op5_minhash_near_dedup": Query(_near, SQL_NEAR),
    "op6_toxicity": Query(_toxicity),
    "op7_document_fingerprints": Query(_fingerprints),
    "op8_secret_scan": Query(_secrets),
    "op9_token_counts": Query(_tokens),
    "op10_url_filter": Query(_urls, SQL_URLS),
    "op11_token_files": Query(_token_files),
    "op12_importance_resampling": Query(_resampling, SQL_RESAMPLING),
    "op13_phrase_collocations": Query(_collocations, SQL_COLLOCATIONS),
}
