"""Secret scans: candidate strings in texts, judged by a random forest, on JVM expressions only."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from encore.sources.workspace import cut

# What marks a path as not real, and words that stand near a secret.
SAMPLE_PATHS = r"test|example|sample|fixture|demo|doc"
KEY_WORDS = r"pass(word|wd|phrase)?|pwd|secret|token|api|key|auth|credential|bearer"
SPACES = r"[\x20\x09-\x0D]+"
SHORTEST = 8
LONG = 20
# What is in front of a piece of a word, the piece, and the quote that ends it.
PIECE = (
    r"""([^A-Za-z0-9+/_\-]*?)((?:(?<=[=:]["'`])[^\s"'`,&?=:]+|(?<=[=:])[A-Za-z0-9+/_\-.!#$%*@^~]+|"""
    r"""[A-Za-z0-9+/_\-]+(?:\.[A-Za-z0-9+/_\-]+)*)(?:={1,2}(?=$|[,;&)\]}>.?|\\]|["'`](?:$|[,;&)\]}>:])))?)(["'`]?)"""
)
# A shorter piece than LONG has one of these.
TELLING = r"[0-9!#$%*@^~;|<>(){}\[\]\\=]"
DICTIONARY = 256
TRAIN_ROWS = 20_000
FEATURES = [
    "length", "digits", "uppers", "symbols", "changes", "rarity", "covered", "sample_path", "depth", "key_before", "assigned", "key_after",
]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(key, path, place, part, value, name, before, after): strings that might be secrets.

    A text is read as words between ASCII white space; ``place`` is the word's number from 0.
    A word's pieces, numbered by ``part`` from 0, are its runs of letters, digits and ``+/_-``,
    joined by single dots, with a padding of ``=``. Behind a ``=`` or ``:`` a piece goes on
    over other punctuation, in quotes up to the quote; quotes, ``,``, ``&``, ``?``, ``=`` and
    ``:`` always end one. A candidate is a piece of eight characters or more with a digit or
    other punctuation, or of twenty or more. ``name`` is the piece in front of its ``=`` or
    ``:``, with the one that leads to it, as in ``password[0]=``. Null and empty texts have
    none; repeated rows have theirs again; other columns are not read.
    """
    words = F.split(F.col(text), SPACES)
    inner = docs.select(F.col(key).alias("_key"), F.col(path).cast("string").alias("_path"), words.alias("w"))
    able = lambda w: (F.length(w) >= SHORTEST) & ((F.length(w) >= LONG) | w.rlike(TELLING))
    found = F.filter(
        F.transform("w", lambda w, i: F.when(able(w), F.struct(
            i.alias("place"), w.alias("word"), F.concat_ws(" ", F.get("w", i - 2), F.get("w", i - 1)).alias("before"),
            F.coalesce(F.get("w", i + 1), F.lit("")).alias("after"),
        ))),
        lambda x: x.isNotNull(),
    )
    rows = inner.select("_key", "_path", F.explode(found).alias("c")).select("_key", "_path", "c.*")
    group = lambda k: F.regexp_extract_all("word", F.lit(PIECE), F.lit(k))
    rows = rows.withColumns({"_gaps": group(1), "_pieces": group(2), "_quotes": group(3)})

    def value(i: Column) -> Column:
        piece = F.get("_pieces", i)
        return F.when(F.get("_quotes", i) == "", F.regexp_replace(piece, "[.!]+$", "")).otherwise(piece)

    def name(i: Column) -> Column:
        lead = F.when(F.get("_gaps", i - 1).rlike(r"""^[^"'`,&;?=:]+$"""), F.concat(F.coalesce(F.get("_pieces", i - 2), F.lit("")), F.get("_gaps", i - 1)))
        own = F.concat(F.coalesce(lead, F.lit("")), F.coalesce(F.get("_pieces", i - 1), F.lit("")))
        return F.when(F.get("_gaps", i).rlike("[=:]"), own).otherwise("")

    parts = F.transform("_pieces", lambda _, i: F.struct(i.alias("part"), value(i).alias("value"), F.lower(name(i)).alias("name")))
    wanted = F.filter(parts, lambda x: able(x["value"]))
    return rows.select(
        F.col("_key").alias(key), F.coalesce("_path", F.lit("")).alias("path"), "place", F.lower("before").alias("before"),
        F.lower("after").alias("after"), F.explode(wanted).alias("c"),
    ).select(key, "path", "place", "c.part", "c.value", "c.name", "before", "after")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all documents, lower-cased words of letters only."""
    words = F.filter(F.split(F.lower(F.col(text)), SPACES), lambda w: w.rlike(r"^[a-z]{2,}$"))
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


class Language:
    """Letter transitions and frequent words of a corpus; both have a fixed size."""

    def __init__(self, counts: DataFrame, size: int = DICTIONARY):
        pairs = (
            counts.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("p"))
            .groupBy("p").agg(F.sum("n").alias("n")).collect()
        )
        seen = {r["p"]: r["n"] for r in pairs}
        total = [sum(seen.get(chr(97 + a) + chr(97 + b), 0) for b in range(26)) for a in range(26)]
        self.share = [
            (seen.get(chr(97 + a) + chr(97 + b), 0) + 1) / (total[a] + 26) for a in range(26) for b in range(26)
        ]
        top = counts.where(F.length("word") >= 3).orderBy(F.desc("n"), "word").limit(size).collect()
        self.words = sorted((r["word"] for r in top), key=lambda w: (-len(w), w))


def features(found: DataFrame, language: Language) -> DataFrame:
    """Candidates with the numbers that the forest reads."""
    value, low = F.col("value"), F.lower("value")
    size = F.length(value).cast("double")
    kept = lambda pattern: F.length(F.regexp_replace(value, pattern, "")) / size
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "."), "[A-Z]+", ":"), "[0-9]+", ";"), "+/_-", "!!!!")
    share = F.array(*[F.lit(float(s)) for s in language.share])

    def transition(i: Column) -> Column:
        a, b = F.ascii(F.substr(low, i, F.lit(1))) - 97, F.ascii(F.substr(low, i + 1, F.lit(1))) - 97
        letters = a.between(0, 25) & b.between(0, 25)
        return F.when(letters, -F.log(F.get(F.col("_share"), F.when(letters, a * 26 + b).otherwise(0)))).otherwise(6.0)

    steps = F.transform(F.sequence(F.lit(1), F.length(value) - 1), transition)
    known = F.regexp_replace(low, "|".join(language.words) or "$^", "")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.withColumn("_share", share).withColumns(
        {
            "length": size,
            "digits": kept("[^0-9]"),
            "uppers": kept("[^A-Z]"),
            "symbols": kept("[A-Za-z0-9]"),
            "changes": F.length(kinds) / size,
            "rarity": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (size - 1),
            "covered": 1 - F.length(known) / size,
            "sample_path": flag(F.lower("path").rlike(SAMPLE_PATHS)),
            "depth": F.size(F.split("path", "/")).cast("double"),
            "key_before": flag(F.col("before").rlike(KEY_WORDS) | F.col("name").rlike(KEY_WORDS)),
            "assigned": flag((F.col("name") != "") | F.col("before").rlike(r"[=:]$")),
            "key_after": flag(F.col("after").rlike(KEY_WORDS)),
        }
    ).drop("_share")


def fit(labelled: DataFrame, label: str = "label", rows: int = TRAIN_ROWS, trees: int = 24, depth: int = 6, seed: int = 17) -> RandomForestClassificationModel | None:
    """Random forest on at most ``rows`` distinct labelled findings.

    Each label has half of them, or what the other leaves; of more the first in the order of
    a hash are taken. Rows with a null label are left out. Without findings of both labels
    there is no model.
    """
    some = labelled.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("_label"), *FEATURES, F.xxhash64("value", "before", "after").alias("_h"))
    some = cut(some.distinct())
    sizes = {r["_label"]: r["count"] for r in some.groupBy("_label").count().collect()}
    if len(sizes) < 2:
        return None
    (a, n), (b, m) = sorted(sizes.items())
    first = min(n, max(rows // 2, rows - m))
    taken = [some.where(F.col("_label") == v).orderBy("_h", *FEATURES).limit(k) for v, k in ((a, first), (b, rows - first))]
    some = taken[0].unionByName(taken[1]).repartition(8, "_h")
    train = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(some).select("_label", "_features")
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed)
    return forest.fit(train)


def judge(found: DataFrame, model: RandomForestClassificationModel | None, name: str = "score") -> DataFrame:
    """Candidates with the probability that they are secrets; without a model it is 0, none is marked."""
    if model is None:
        return found.withColumn(name, F.lit(0.0))
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(found)
    model.setFeaturesCol("_features").setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    return model.transform(rows).withColumn(name, vector_to_array("_probability")[1]).drop("_features", "_probability")


def known_format(value: str = "value", name: str = "name", before: str = "before") -> Column:
    """Label of a finding that its form alone decides: 1, 0 or null.

    Stands for the findings that people have labelled: key ids with a provider's prefix and
    hexadecimal strings given to a name like ``password`` are secrets; words of letters,
    and numbers, are not.
    """
    named = F.col(name).rlike(KEY_WORDS) | F.col(before).rlike(rf"({KEY_WORDS})\S* *[=:]$")
    return F.when(F.col(value).rlike("^AKIA[0-9A-Z]{16}$") | (named & F.col(value).rlike("^[0-9a-f]{16,}$")), 1).when(
        F.col(value).rlike("^[A-Za-z]+$|^[0-9+/_.-]+$"), 0
    )
