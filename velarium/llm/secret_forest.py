"""Secret scans: a pattern proposes candidates, a random forest removes false positives. DataFrame operations only.

A candidate is a whole run of the characters that keys are made of, with its closing `=` if no value follows them: either 16 or more with at least one digit and one letter, or 8 or more
of any that are assigned to a name (`=` or `:`, blanks and a quote allowed between). Its features are length, transitions between character classes, distinct
characters, digits, vowels, dictionary coverage, whether it looks like a path or an address, and what the word before and the word after say. Those words are read
beside the run and never taken from it, so a candidate can be the word before or after of the next. The forest is trained on labelled findings: those given, or
`labelled_findings`, which makes them from stated rules at a fixed number of rows.

Null and blank texts have no candidates; texts of any length are scanned whole. Equal findings of a text are each reported, in order, and so are those of repeated rows and of
rows with a null id. Columns of the input other than id and text are not read, whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "A-Za-z0-9_+/.@-"
#: A name, and what may stand between it and its value; at most 40 blanks on each side, as a lookbehind needs a bound.
NAME, QUOTE, BLANKS = r"[A-Za-z][\w.-]{0,40}", "[\"'`]?", r"[ \t]{0,40}"
#: The candidate alone; all context is looked at and not consumed.
CANDIDATE = (
    rf"(?<![{KEY}])(?=[{KEY}]{{8}})(?:(?=[{KEY}]{{16}})(?=[A-Za-z_+/.@-]*+[0-9])(?=[0-9_+/.@-]*+[A-Za-z])"
    rf"|(?<=[=:]{BLANKS}{QUOTE})(?<={NAME}[\"']?{BLANKS}[=:]{{1,2}}{BLANKS}{QUOTE}))[{KEY}]++(?:=++(?![\"'`{KEY}]))?+"
)
#: The word before and its separator at the end of the text on the left, the word after at the start of the text on the right.
BEFORE = rf"(?:({NAME})[\"']?{BLANKS}([=:]{{1,2}}|[ \t]){BLANKS}){QUOTE}$"
AFTER = rf"^{QUOTE}[ \t]{{1,40}}([\w.-]{{1,40}})"
#: Characters that BEFORE and AFTER can reach.
REACH = 130
#: Words of texts and code that cover a candidate which is no secret (fixed values).
DICTIONARY = "access account admin api app archive assets auth base bin blob branch bucket build cache class client cloud code commit common config content core data default dev dist docs document example file files final function github google home html http https image images import index info item java json lib link local log main master message method model module name net node null object org package page path permission point prod project public python query release report request resource result root sample schema script server service session shared site source sql src static status string style system table target temp test text the type update user util value version video view web with www".split()
#: What neighbouring words say for and against (fixed values).
SECRET_WORDS = "(?i)key|secret|token|passw|pwd|credential|auth|bearer|private|signature"
HARMLESS_WORDS = "(?i)sha|md5|commit|checksum|digest|hash|etag|uuid|guid|revision|build|version|mail|from|id$"
FEATURES = ["length", "transitions", "distinct", "digits", "upper", "vowels", "coverage", "path", "address", "hex", "assigned", "says_secret", "says_harmless", "after_harmless"]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: id, ordinal in the text, before, sep, candidate, after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.col(id_col).alias("__sf_id"), text.alias("text"), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("all"))
    # what lies between the candidates: piece i is before candidate i, piece i + 1 after it
    found = found.select("__sf_id", "all", F.when(F.size("all") > 0, F.split("text", CANDIDATE, -1)).alias("between"))
    at = lambda name, i: F.coalesce(F.get(F.col(name), i), F.lit(""))
    beside = F.transform(
        "all",
        lambda c, i: F.struct(
            F.substring(F.concat(at("all", i - 1), at("between", i)), -REACH, REACH).alias("left"), c.alias("candidate"), F.substring(F.concat(at("between", i + 1), at("all", i + 1)), 1, REACH).alias("right")
        ),
    )
    # outer: the filter that Spark would derive from a plain explode runs the pattern a second time
    each = found.select("__sf_id", F.posexplode_outer(beside).alias("ordinal", "context")).filter(F.col("context").isNotNull())
    part = lambda side, pattern, k: F.coalesce(F.regexp_extract(F.col("context")[side], pattern, k), F.lit(""))
    return each.select(F.col("__sf_id").alias(id_col), "ordinal", part("left", BEFORE, 1).alias("before"), part("left", BEFORE, 2).alias("sep"), F.col("context.candidate").alias("candidate"), part("right", AFTER, 1).alias("after"))


def with_features(found: DataFrame) -> DataFrame:
    """The candidates and their features as double columns."""
    c = F.col("candidate")
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("double")
    flag = lambda x: x.cast("double")
    change = "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    left = F.length(F.regexp_replace(F.lower(c), "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))), ""))
    return found.withColumns(
        {
            "length": F.length(c).cast("double"),
            "transitions": (count(change) / n),
            "distinct": F.size(F.array_distinct(F.split(c, ""))).cast("double") / n,
            "digits": count("[0-9]") / n,
            "upper": count("[A-Z]") / n,
            "vowels": count("[aeiouAEIOU]") / n,
            "coverage": (n - left) / n,
            "path": flag(c.rlike(r"^[./~]|/[A-Za-z_.-]+/|\.[a-z]{2,4}$|://")),
            "address": flag(c.contains("@")),
            "hex": flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
            "assigned": flag(F.col("sep").rlike("[=:]")),
            "says_secret": flag(F.col("before").rlike(SECRET_WORDS)),
            "says_harmless": flag(F.col("before").rlike(HARMLESS_WORDS)),
            "after_harmless": flag(F.col("after").rlike(HARMLESS_WORDS)),
        }
    )


def _pick(options: list[str], draw: Column) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(draw, F.lit(len(options))) + 1).cast("int"))


def labelled_findings(spark: SparkSession, rows: int = 4000, seed: int = 13) -> DataFrame:
    """Findings made from stated rules: before, sep, candidate, after, label (1: secret). Same rows for a given seed.

    Secrets are random hexadecimal, alphanumeric or prefixed values, mostly assigned to names that say so, and short values assigned to them. Harmless are
    checksums and revisions, e-mail addresses, file paths, identifiers of dictionary words, dotted versions and timestamps, and plain words after a name.
    """
    draw = lambda k: F.xxhash64(F.lit(seed), F.lit(k), F.col("id"))
    hexes = F.sha1(draw("hex").cast("string"))
    mixed = F.translate(F.substring(F.base64(F.unhex(F.sha2(draw("mix").cast("string"), 256))), 1, 40), "=+/", "Qx7")
    words = F.concat_ws("_", _pick(DICTIONARY, draw("w1")), _pick(DICTIONARY, draw("w2")), _pick(DICTIONARY, draw("w3")), F.pmod(draw("n"), F.lit(100)).cast("string"))
    path = F.concat(F.lit("/"), _pick(DICTIONARY, draw("p1")), F.lit("/"), _pick(DICTIONARY, draw("p2")), F.lit("/"), _pick(DICTIONARY, draw("p3")), F.pmod(draw("n"), F.lit(90)).cast("string"), _pick([".py", ".json", ".html", ".png"], draw("x")))
    mail = F.concat(_pick(DICTIONARY, draw("m")), F.lit("."), F.pmod(draw("n"), F.lit(90)).cast("string"), F.lit("@mail"), F.pmod(draw("h"), F.lit(10)).cast("string"), F.lit(".example.com"))
    stamp = F.concat(F.lit("2024-0"), (F.pmod(draw("a"), F.lit(9)) + 1).cast("string"), F.lit("-17T0"), F.pmod(draw("b"), F.lit(10)).cast("string"), F.lit(".30.00Z"))
    secret_name = _pick(["api_key", "secret", "token", "password", "client_secret", "auth_token", "private_key", "aws_secret_access_key"], draw("name"))
    harmless_name = _pick(["sha", "commit", "checksum", "digest", "etag", "revision", "uuid", "md5sum"], draw("name"))
    other_name = _pick(["the", "see", "in", "path", "file", "of", "value", "from", ""], draw("name"))
    short = F.substring(mixed, F.lit(1), F.pmod(draw("short"), F.lit(8)) + 8)
    plain = F.concat(_pick(DICTIONARY, draw("w1")), _pick(DICTIONARY, draw("w2")), _pick(["ing", "ation", "ment", "s"], draw("w3")))
    kind = F.pmod(draw("kind"), F.lit(14))
    rows_ = spark.range(rows).withColumn("kind", kind)
    is_secret = (F.col("kind") < 6) | (F.col("kind") == 12)
    sep = F.when(F.col("kind") >= 12, _pick(["=", ":"], draw("sep"))).when(is_secret, _pick(["=", "=", ":", " "], draw("sep"))).otherwise(_pick(["=", ":", " ", " "], draw("sep")))
    value = (
        F.when(F.col("kind") < 2, hexes)
        .when(F.col("kind") < 4, mixed)
        .when(F.col("kind") == 4, F.concat(_pick(["AKIA", "ghp_", "sk_live_", "xoxb-", "AIza"], draw("pre")), F.substring(mixed, 1, 24)))
        .when(F.col("kind") == 5, F.upper(hexes))
        .when(F.col("kind") < 8, hexes)
        .when(F.col("kind") == 8, mail)
        .when(F.col("kind") == 9, path)
        .when(F.col("kind") == 10, words)
        .when(F.col("kind") == 12, short)
        .when(F.col("kind") == 13, plain)
        .otherwise(stamp)
    )
    before = F.when(is_secret, secret_name).when(F.col("kind") < 8, harmless_name).otherwise(other_name)
    return rows_.select(before.alias("before"), sep.alias("sep"), value.alias("candidate"), F.lit("").alias("after"), is_secret.cast("double").alias("label"))


def _vectors(found: DataFrame) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=FEATURES, outputCol="__sf_x").transform(with_features(found))


def train(findings: DataFrame, trees: int = 30, depth: int = 7, seed: int = 13):
    """A forest over labelled findings (before, sep, candidate, after, label)."""
    from pyspark.ml.classification import RandomForestClassifier

    return RandomForestClassifier(featuresCol="__sf_x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(_vectors(findings).select("__sf_x", "label"))


def scan(docs: DataFrame, model=None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, ordinal, finding_sha256, before, n_chars, score, secret. The value itself is not repeated."""
    from pyspark.ml.functions import vector_to_array

    if model is None:
        model = train(labelled_findings(docs.sparkSession))
    scored = model.transform(_vectors(candidates(docs, id_col, text_col)))
    score = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return scored.select(
        id_col,
        "ordinal",
        F.sha2("candidate", 256).alias("finding_sha256"),
        F.lower("before").alias("before"),
        F.length("candidate").alias("n_chars"),
        score.alias("score"),
        (score >= threshold).alias("secret"),
    )
