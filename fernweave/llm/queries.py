"""The registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table. `ORACLE` has DuckDB SQL for those that SQL can express."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fernweave.llm.collocations import collocations
from fernweave.llm.decontaminate import contaminated_spans
from fernweave.llm.divergence import source_divergence
from fernweave.llm.licenses import license_scan
from fernweave.llm.lm_score import lm_scores
from fernweave.llm.mixing import mix_sources, word_tokens
from fernweave.llm.quality import learn_quality, quality_scores
from fernweave.llm.quality_rules import learn_rules, quality_rules
from fernweave.llm.sharding import hilbert_shards
from fernweave.llm.simhash import simhash_components
from fernweave.llm.store import stored
from fernweave.llm.syncmers import syncmer_fingerprints
from fernweave.llm.token_counts import token_counts
from fernweave.llm.url_filter import filter_urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    slim = stored(docs.select("doc_id", "source", "lang", size.alias("bytes"), F.crc32("text").alias("text_crc32")), "slim")
    placed = hilbert_shards(slim, n_shards=8, law="rows", size=F.col("bytes"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(table(spark, sf_dir, "documents").select("doc_id", "source", word_tokens(F.col("text")).alias("tokens")), "tokens")
    mixed = mix_sources(docs, max_repeat=MAX_REPEAT, block_tokens=BLOCK_TOKENS, seed=SEED, tokens=F.col("tokens"))
    return mixed.select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "epoch", "block")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op6_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmer_fingerprints(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate(F.coalesce("spans", F.array()), F.lit(0).cast("long"), lambda n, x: n + x["last"] - x["first"] + 1)
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_scores(docs, learn_quality(docs, table(spark, sf_dir, "labels")))


def url_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LISTED, "domain string, listed_on string, action string").select("domain", F.to_timestamp("listed_on").alias("listed_at"), "action")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch time: each counts as fetched on the day of 2021 to 2024 that its id mod 1461 names."""
    fetched = F.expr("timestamp_seconds(1609459200 + pmod(page_id, 1461) * 86400)")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched_at"))
    found = filter_urls(captures, url_list(spark))
    return found.select("page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "n_active", "rule_domain", "rule_action", "blocked")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules(docs, learn_rules(docs, table(spark, sf_dir, "labels")))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


#: Of op4: most epochs of a source, tokens in a block, seed of the permutations.
MAX_REPEAT, BLOCK_TOKENS, SEED = 1.25, 1 << 16, 17

# Dated entries of the URL list of op10, (domain, day, action).
LISTED = [
    ("cheap-pills.example.com", "2021-02-01", "block"),
    ("casino-win.example.com", "2021-06-15", "block"),
    ("casino-win.example.com", "2022-09-01", "allow"),
    ("casino-win.example.com", "2023-03-10", "block"),
    ("free-bets.example.com", "2022-01-01", "block"),
    ("free-bets.example.com", "2024-01-01", "allow"),
    ("ads-track.example.org", "2021-03-01", "block"),
    ("ads-track.example.org", "2023-01-01", "allow"),
    ("example.org", "2023-07-01", "block"),
    ("example.org", "2023-07-15", "allow"),
    ("m.example.net", "2021-01-01", "block"),
    ("tionsh.example.net", "2022-05-05", "allow"),
    ("example.net", "2024-06-01", "block"),
    ("example.net", "2024-06-20", "allow"),
]

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_mixing": op4_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_syncmers": op6_syncmers,
    "op7_decontamination": op7_decontamination,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_quality": op9_quality,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_quality_rules": op12_quality_rules,
    "op13_source_divergence": op13_source_divergence,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: DuckDB SQL where it can express the result; the other queries rest on hashes or models that it lacks.
ORACLE: dict[str, str] = {
    # The shares raised to the exponent are bisected in 40 halvings; the rest is running sums.
    "op4_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS n FROM documents), s AS (SELECT source, sum(n)::BIGINT AS t FROM d GROUP BY 1),
p AS (SELECT list(t / (SELECT sum(t) FROM s)::DOUBLE) AS p, sum(t)::BIGINT AS budget FROM s),
ends AS (SELECT list_max([pow(x, -1.0) FOR x IN p]) / list_sum([pow(x, 0.0) FOR x IN p]) <= {MAX_REPEAT} + 1e-12 AS flat, list_max([pow(x, 0.0) FOR x IN p]) / list_sum(p) <= {MAX_REPEAT} + 1e-12 AS plain FROM p),
b(i, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
 SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, list_max([pow(x, (lo + hi) / 2 - 1) FOR x IN p]) / list_sum([pow(x, (lo + hi) / 2) FOR x IN p]) <= {MAX_REPEAT} + 1e-12 AS ok FROM b, p WHERE i < 40)),
e AS (SELECT CASE WHEN flat THEN 0.0 WHEN NOT plain THEN 1.0 ELSE round((SELECT hi FROM b WHERE i = 40), 6) END AS a FROM ends),
w AS (SELECT source, t, round(pow(t / (SELECT sum(t) FROM s)::DOUBLE, a) / list_sum([pow(x, a) FOR x IN p]), 9) AS weight, budget FROM s, e, p),
q AS (SELECT *, floor(weight * budget)::BIGINT AS quota, ceil(floor(weight * budget) / t)::BIGINT AS epochs FROM w),
r AS (SELECT d.doc_id, d.source, d.n, q.t, q.weight, q.quota, unnest(range(q.epochs)) AS epoch FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, ('0x' || substr(md5('{SEED}/' || epoch || '/' || doc_id), 1, 15))::BIGINT AS place FROM r),
c AS (SELECT *, epoch * t + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM k)
SELECT doc_id, source, n AS n_tokens, round(weight, 6) AS weight, epoch::INT AS epoch, (pos // greatest(1, floor(weight * {BLOCK_TOKENS})::BIGINT))::BIGINT AS block FROM c WHERE pos < quota""",
    # All windows of all items against all places of all documents.
    "op7_decontamination": f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), iw AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM win), dg AS (SELECT doc_id, m, k, array_to_string(w[k : k + m - 1], ' ') AS g FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw CROSS JOIN sizes WHERE len(w) >= m)),
hit AS (SELECT dg.doc_id, dg.k, dg.m, win.item_id FROM dg JOIN win USING (m, g)),
pos AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + m)) AS place FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT dw.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op10_url_filter": f"""
WITH l(domain, listed_on, action) AS (VALUES {", ".join(f"('{d}', TIMESTAMP '{t}', '{a}')" for d, t, a in LISTED)}), v AS (SELECT *, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS until FROM l),
p AS (SELECT page_id, nullif(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '[.]+$', ''), '') AS host, TIMESTAMP '2021-01-01' + to_days((page_id % 1461)::INT) AS seen FROM pages),
a AS (SELECT page_id, v.domain, v.action, row_number() OVER (PARTITION BY page_id ORDER BY length(v.domain) DESC) AS k, count(*) OVER (PARTITION BY page_id) AS n FROM p JOIN v ON (host = v.domain OR ends_with(host, '.' || v.domain)) AND listed_on <= seen AND (until IS NULL OR seen < until))
SELECT p.page_id, host, strftime(seen, '%Y-%m-%d') AS fetched_on, coalesce(n, 0) AS n_active, a.domain AS rule_domain, a.action AS rule_action, coalesce(a.action = 'block', false) AS blocked FROM p LEFT JOIN a ON p.page_id = a.page_id AND k = 1""",
    # All phrases of one to five words of all pieces are counted.
    "op11_collocations": rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents),
p AS (SELECT lang, unnest(string_split_regex(x, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
parts AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
inside AS (SELECT lang, f, unnest([array_to_string(w[1 : m - 1], ' '), array_to_string(w[2 : m], ' ')]) AS phrase FROM parts WHERE m > 2),
gone AS (SELECT DISTINCT f.lang, f.phrase FROM f JOIN inside i ON f.lang = i.lang AND f.phrase = i.phrase AND 100 * i.f >= 100 * f.f),
kept AS (SELECT * FROM parts WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = parts.lang AND gone.phrase = parts.phrase)),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM kept),
scored AS (SELECT c.lang, c.phrase, c.k, c.f AS a, x.f AS l, y.f AS r, n, (1000::HUGEINT * c.f * n // (x.f::HUGEINT * y.f))::BIGINT AS score
 FROM cuts c JOIN total USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1 : c.m], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= 2000""",
    # Every group and language gives every kept term its probability.
    "op13_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
own AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT DISTINCT lang, source FROM d),
sizes AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM groups g LEFT JOIN own USING (lang, source) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
p AS (SELECT s.lang, s.source, k.term, coalesce(o.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(o.c, 0) + 1) // (s.n + v) AS p, 1 + 1000000000::HUGEINT * (k.c + 1) // (l.n + v) AS q
 FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN own o ON o.lang = s.lang AND o.source = s.source AND o.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM rows QUALIFY part = 'pair' OR rank <= 200""",
}
