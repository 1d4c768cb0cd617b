"""The operators of this package over the given tables, each next to its SQL if SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenura.llm import (
    ann,
    bloom_lm,
    decontaminate,
    html_main,
    language,
    periodic_runs,
    phrases,
    quality,
    secrets,
    sentencepiece,
    sharding,
    simhash,
    token_files,
)
from tenura.llm.common import held_out, table
from tenura.session import shared_dir


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).withColumn("held_out", held_out(F.col("doc_id"), 4))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.summary(secrets.scan(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.concat_ws(",", "secrets").cast("binary"), 256)
    return found.select("doc_id", "n_candidates", "n_secrets", digest.alias("secrets_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.item_digest(F.col("items")).alias("items_sha256"),
        "contaminated",
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_lm.score(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentencepiece.read_model()
    encoded = sentencepiece.encode(table(spark, sf_dir, "documents"), pieces)
    return sentencepiece.round_trips(encoded, pieces).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_xxhash64"),
        "round_trip",
    )


OP5_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, array_to_string(w[s + 1 : s + 10], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(0, greatest(len(w) - 9, 1))) AS s FROM item WHERE len(w) > 0)),
place AS (
  SELECT r, s, n, array_to_string(w[s + 1 : s + n], ' ') AS phrase
  FROM (SELECT r, w, n, unnest(range(0, len(w) - n + 1)) AS s
        FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hit AS (SELECT r, s, place.n, item FROM place JOIN win USING (phrase) WHERE place.n = win.n),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.extract(pages, html_main.fit(pages))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.fit(docs)).withColumn("held_out", held_out(F.col("doc_id"), 4))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    token_files.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path, with_ids=False)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the text of every tenth id (by checksum) repeats from some word on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = docs.select(
        "doc_id", "text", h.alias("h"), F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("words")
    ).select("*", F.expr("h div 10").alias("g"), F.size("words").cast("long").alias("n"))
    first = words.select("*", F.expr("cast(g % nullif(n, 0) as int)").alias("a"))
    period = first.select("*", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)").alias("p"))
    repeated = F.expr("concat(slice(words, 1, a), transform(sequence(0, cast(n - a - 1 as int)), i -> words[a + i % p]))")
    changed = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(repeated, " "))
    return period.select("doc_id", F.coalesce(changed, F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(planted(table(spark, sf_dir, "documents")))
    run = found.schema["runs"].dataType.elementType.simpleString()
    listed = F.transform("runs", lambda x: F.concat_ws(",", x.start, x.length, x.period))
    best = F.aggregate(
        "runs",
        F.lit(None).cast(run),
        lambda so_far, x: F.when(
            so_far.isNull() | (x.length * so_far.period > so_far.length * x.period), x
        ).otherwise(so_far),
    )
    return found.select("doc_id", "runs", "collapsed", listed.alias("listed"), best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("listed", lambda x: F.concat(x, F.lit("\n"))), "").cast("binary"), 256).alias(
            "runs_sha256"
        ),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
word AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
place AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM word),
total AS (SELECT lang, count(*) AS n FROM place GROUP BY lang),
f AS (
  SELECT lang, w[i : i + k - 1] AS p, count(*) AS f
  FROM place, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
longer AS (
  SELECT lang, p, max(f) AS most
  FROM (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, f FROM f WHERE len(p) = 3 AND f >= 10) GROUP BY ALL),
candidate AS (
  SELECT lang, p, f AS a FROM f LEFT JOIN longer USING (lang, p)
  WHERE len(p) > 1 AND f >= 10 AND (most IS NULL OR 100 * most < 50 * f)),
cut AS (
  SELECT candidate.lang, candidate.p, a, k, x.f AS l, y.f AS r,
         (1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS score
  FROM candidate, (SELECT unnest([1, 2]) AS k) AS k, f AS x, f AS y
  WHERE k < len(candidate.p) AND x.lang = candidate.lang AND y.lang = candidate.lang
    AND x.p = candidate.p[1:k] AND y.p = candidate.p[k + 1 :]),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS nth FROM cut),
ranked AS (
  SELECT *, array_to_string(p, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank
  FROM best WHERE nth = 1)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


QUERIES = {
    "op1_quality": op1_quality,
    "op2_secrets": op2_secrets,
    "op3_language_model": op3_language_model,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_decontamination": op5_decontamination,
    "op6_sharding": op6_sharding,
    "op7_nearest": op7_nearest,
    "op8_simhash": op8_simhash,
    "op9_html": op9_html,
    "op10_language": op10_language,
    "op11_token_files": op11_token_files,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {"op5_decontamination": OP5_SQL, "op13_phrases": OP13_SQL}
