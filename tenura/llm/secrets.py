"""Secret scan: candidates by pattern, false positives removed by a random forest, all in SQL functions."""

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenura.llm.common import free_name, hashed_sample, join_counted, row_key
from tenura.session import store

# What a candidate can be made of, and words that hint at or against a credential.
CORE = r"[A-Za-z0-9_+/\-]{10,}"
ASSIGNED = r"[=:]"
PREFIX = r"(AKIA|ASIA|AIza|gh[pousr]_|xox[abp]-|sk-)"
HINT = r"(?i)(secret|token|passw|pwd|api_?key|apikey|auth|bearer|credential|private|access)"
HARMLESS = r"(?i)(example|sample|test|mock|dummy|fixture|vendor|lock$|\.md$|docs?/)"
PLACEHOLDER = "[SECRET]"
# What a hint word is set to, in one word; and a whole word that follows such an assignment.
VALUE = r"""["'`]?([^\s"'`]{6,}?)["'`]?[.,;]?$"""
SET_HERE = HINT + r"""[A-Za-z0-9_\-]*["']?[=:]+""" + VALUE
SET_BEFORE = HINT + r"""[A-Za-z0-9_\-]*["']?[=:]*$"""

SALTS = 16

FEATURES = [
    "length",
    "digit_share",
    "upper_share",
    "lower_share",
    "symbol_share",
    "transitions",
    "distinct_share",
    "hex_only",
    "coverage",
    "assigned",
    "quoted",
    "hint_here",
    "hint_before",
    "hint_after",
    "path_depth",
    "path_harmless",
]


def candidates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source"
) -> DataFrame:
    """Strings that could be credentials, with their surroundings.

    A candidate is a run of at least ten letters, digits or ``_+/-`` in a word
    that has a digit or a known prefix, or stands after an assignment; or the
    whole value, of any signs and at least six of them with a digit, that a hint
    word is set to. Returns row (a number for each input row), key (equal rows
    share it), doc_id, path, at (the word's position), word, before2, before,
    after, candidate. A row without candidates is there once with a null
    candidate.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        row_key(docs, doc_id, text).alias("key"),
        F.col(doc_id).alias("doc_id"),
        (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"),
        F.split(F.col(text), r"\s+").alias("words"),
    )
    words = rows.select("*", F.posexplode_outer("words").alias("at", "word"))
    before = F.get("words", F.col("at") - 1)
    possible = (F.char_length("word") >= 10) & (
        F.col("word").rlike("[0-9]")
        | F.col("word").rlike(ASSIGNED)
        | F.col("word").rlike(PREFIX)
        | F.coalesce(before.rlike(ASSIGNED + "$"), F.lit(False))
    )
    # before an assignment sign of its own stands the word that is set
    hinted = F.when(before.rlike(f"^{ASSIGNED}+$"), F.get("words", F.col("at") - 2).rlike(SET_BEFORE)).otherwise(
        before.rlike(ASSIGNED + "+$") & before.rlike(SET_BEFORE)
    )
    digit = F.col("word").rlike("[0-9]")
    value = F.when(digit & F.col("word").rlike(SET_HERE), F.regexp_extract("word", SET_HERE, 2)).when(
        digit & F.coalesce(hinted, F.lit(False)) & F.col("word").rlike("^" + VALUE),
        F.regexp_extract("word", "^" + VALUE, 1),
    )
    kept = (
        words.withColumn("possible", F.coalesce(possible, F.lit(False)))
        .withColumn("value", F.when(value.rlike("[0-9]"), value))
        .where(F.col("possible") | F.col("value").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
    )
    cores = F.when(F.col("possible"), F.regexp_extract_all("word", F.lit(CORE), F.lit(0)))
    # a value stands for the runs inside it
    whole = F.concat(
        F.array("value"), F.filter(F.coalesce(cores, F.array().cast("array<string>")), lambda c: ~F.contains("value", c))
    )
    return kept.select(
        "row",
        "key",
        "doc_id",
        "path",
        "at",
        "word",
        F.get("words", F.col("at") - 2).alias("before2"),
        before.alias("before"),
        F.get("words", F.col("at") + 1).alias("after"),
        F.explode_outer(F.when(F.col("value").isNotNull(), whole).otherwise(cores)).alias("candidate"),
    )


def dictionary(docs: DataFrame, share: int = 400_000, least: int = 5, text: str = "text") -> DataFrame:
    """Words (3 to 20 letters a-z, any case) that are at least a ``share``-th of all words, and occur ``least`` times: word.

    So there are at most ``share`` of them, however large the corpus is.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^a-z]+")).alias("word"))
    counts = store(words.where(F.char_length("word").between(3, 20)).groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(least, -(-total // share))).select("word")


def _share(pattern: str) -> Column:
    """Share of the candidate's characters that match."""
    rest = F.char_length(F.regexp_replace("candidate", pattern, ""))
    return 1 - rest / F.char_length("candidate")


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` without rows that have no candidate, and one number per feature of ``FEATURES``.

    Coverage is the share of the candidate's characters inside parts (runs of
    small letters, capitalised or not, or of capitals) that ``words`` holds.
    """
    found = found.where(F.col("candidate").isNotNull())
    each = found.groupBy("candidate").agg(F.count("*").alias("n"))
    parts = each.select(
        "candidate",
        F.explode(F.regexp_extract_all("candidate", F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))).alias("part"),
    )
    # the dictionary has a bounded size
    covered = (
        parts.join(F.broadcast(words.withColumnRenamed("word", "known")), F.lower("part") == F.col("known"))
        .groupBy("candidate")
        .agg(F.sum(F.char_length("part")).alias("covered"))
    )
    each = store(each.join(covered, "candidate", "left"))
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"
    head = F.expr("substring_index(word, candidate, 1)")
    size = F.char_length("candidate")
    slashes = F.char_length("path") - F.char_length(F.replace("path", F.lit("/"), F.lit("")))
    return join_counted(found, each, "candidate", "n").select(
        *found.columns,
        size.cast("double").alias("length"),
        _share("[0-9]").alias("digit_share"),
        _share("[A-Z]").alias("upper_share"),
        _share("[a-z]").alias("lower_share"),
        _share(r"[_+/\-]").alias("symbol_share"),
        (F.size(F.regexp_extract_all("candidate", F.lit(change), F.lit(0))) / size).alias("transitions"),
        (F.size(F.array_distinct(F.split("candidate", ""))) / size).alias("distinct_share"),
        _flag(F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex_only"),
        (F.coalesce("covered", F.lit(0)) / size).alias("coverage"),
        _flag(head.rlike(ASSIGNED) | F.col("before").rlike(ASSIGNED + "$")).alias("assigned"),
        _flag(F.col("word").rlike("[\"'`]")).alias("quoted"),
        _flag(head.rlike(HINT)).alias("hint_here"),
        F.greatest(_flag(F.col("before").rlike(HINT)), _flag(F.col("before2").rlike(HINT))).alias("hint_before"),
        _flag(F.col("after").rlike(HINT)).alias("hint_after"),
        F.coalesce(slashes, F.lit(0)).cast("double").alias("path_depth"),
        _flag(F.col("path").rlike(HARMLESS)).alias("path_harmless"),
    )


def labelled_by_format(features: DataFrame) -> DataFrame:
    """Labels for findings whose format settles the matter: label 1.0 or 0.0; other rows are left out.

    For corpora without reviewed findings. A key id of a known format, or a
    mixed hexadecimal string that a hint word is set to, is a credential. Numbers
    and signs alone, and strings mostly made of dictionary words, are none.
    """
    known = F.col("candidate").rlike("^(A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[bp]-[0-9A-Za-z-]{20,})$")
    hinted = (F.col("hint_here") + F.col("hint_before") > 0) & (F.col("assigned") == 1)
    letters = F.col("lower_share") + F.col("upper_share")
    mixed = (F.col("digit_share") > 0.1) & (letters > 0.1)
    positive = known | (hinted & mixed & (F.col("coverage") < 0.5))
    negative = (letters == 0) | (F.col("coverage") > 0.8)
    label = F.when(positive, 1.0).when(negative & ~hinted, 0.0)
    return features.withColumn("label", label).where(F.col("label").isNotNull())


def fit(findings: DataFrame, max_findings: int = 20_000, trees: int = 30, depth: int = 6):
    """A random forest over labelled findings (``FEATURES`` and label).

    At most ``max_findings`` of them are used, drawn by a hash of the
    candidate. None if the labels do not have both classes.
    """
    keys = [c for c in ("row", "at", "candidate", "word", "before") if c in findings.columns]
    drawn = store(hashed_sample(findings, max_findings, findings.count(), *keys).select(*FEATURES, "label"))
    if drawn.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt"
    )
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), forest]).fit(drawn)


def scan(
    docs: DataFrame,
    findings: DataFrame | None = None,
    threshold: float = 0.5,
    doc_id: str = "doc_id",
    text: str = "text",
    path: str | None = "source",
) -> DataFrame:
    """Every candidate with the forest's probability that it is a secret.

    ``findings`` are labelled findings: the columns path, word, before2,
    before, after, candidate and label (1 a secret, 0 none; others are
    ignored). Without them, findings whose format settles the matter are the
    training rows. If the labels do not have both classes, candidates next to
    a hint word are secrets. Returns row, key, doc_id, at, candidate,
    probability, is_secret; a row without candidates, such as a null or empty
    text, is there once with a null candidate. Repeated rows are scanned each
    on its own, with the same verdicts; a very long text has as many candidates
    as it has.
    """
    found = store(candidates(docs, doc_id, text, path))
    words = store(dictionary(docs, text=text))
    features = store(with_features(found, words))
    if findings is None:
        labelled = labelled_by_format(features)
    else:
        columns = ["path", "word", "before2", "before", "after", "candidate", "label"]
        labelled = with_features(findings.select(*columns).where(F.col("label").isin(0, 1)), words)
        labelled = labelled.withColumn("label", F.col("label").cast("double"))
    forest = fit(labelled)
    if forest is None:
        scored = features.withColumn("p", F.greatest("hint_here", "hint_before"))
    else:
        scored = forest.transform(features).withColumn("p", vector_to_array("probability")[1])
    none = found.where(F.col("candidate").isNull()).groupBy("row").agg(
        F.first("key").alias("key"), F.first("doc_id").alias("doc_id")
    )
    none = none.join(features.select("row").distinct(), "row", "left_anti")
    return scored.select(
        "row", "key", "doc_id", "at", "candidate", F.col("p").alias("probability"), (F.col("p") >= threshold).alias("is_secret")
    ).unionByName(none.withColumn("is_secret", F.lit(False)), allowMissingColumns=True)


def summary(scanned: DataFrame) -> DataFrame:
    """Per input row: doc_id, n_candidates, n_secrets, secrets (distinct, sorted)."""
    secret = F.when(F.col("is_secret"), F.col("candidate"))
    return (
        scanned.groupBy("row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.count("candidate").alias("n_candidates"),
            F.count(secret).alias("n_secrets"),
            F.sort_array(F.collect_set(secret)).alias("secrets"),
        )
        .drop("row")
    )


def redact(docs: DataFrame, scanned: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every secret of a text replaced by ``[SECRET]`` wherever it stands in it.

    ``scanned`` is what ``scan`` returned for ``docs``. Only rows with the same
    id and the same text share secrets, so a group is one text's. Rows with a
    missing id, and null and empty texts, stay as they are but for that.
    """
    key, found, salt = (free_name(docs, name) for name in ("key", "found", "salt"))
    sized = F.struct(F.char_length("candidate").alias("n"), F.col("candidate").alias("s"))
    secrets = (
        scanned.where("is_secret")
        .groupBy(F.col("key").alias(key))
        # the longest first, so that none is cut by a shorter one that it contains
        .agg(F.sort_array(F.collect_set(sized), False).alias(found))
    )
    nothing = F.array().cast("array<struct<n:int,s:string>>")
    clean = F.aggregate(
        F.coalesce(F.col(found), nothing), F.col(text), lambda so_far, x: F.replace(so_far, x.s, F.lit(PLACEHOLDER))
    )
    # equal rows may be many: they meet their secrets in several tasks
    salted = secrets.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keyed = docs.withColumn(key, row_key(docs, doc_id, text)).withColumn(
        salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    )
    return keyed.join(salted, [key, salt], "left").withColumn(text, clean).select(*docs.columns)
