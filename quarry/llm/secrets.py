"""Secret scans: candidates by pattern, then a random forest that removes false positives.

A candidate is a run of at least 16 characters of keys and encodings, whatever stands before it; the word
before it, if one stands near, is looked for apart.  The forest judges its length, its character classes and the
transitions between them, how much of it dictionary words cover, whether it looks like a path, an
address or a number, and its neighbouring word.  It is fitted with Spark ML on labelled findings: some made by rule, of usual
kinds of keys and of what is taken for them, and, where documents are given, candidates of a bounded sample of
their own texts, labelled by rule as well (no table has labels of secrets), which are hard negatives for the most part.
Its trees become one column expression, so that scanning is a map over the rows with built-in
functions only: no shuffle and no Python on the executors.

Edge cases: null and empty texts have no findings; texts are scanned whole, however long; the same
secret twice in a text is two findings; repeated rows are scanned like any other; other columns are
passed through; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import forget, written

BODY = r"[A-Za-z0-9+/_=.@:-]"
#: The candidate alone; a run that begins earlier is never entered, and gives back nothing.
CANDIDATE = rf"(?<!{BODY}){BODY}{{16,}}+"
#: The word before (without digits at its end) and what may stand between it and a candidate, at the end of what stands before.
NEIGHBOUR = r"(?<![A-Za-z_])([A-Za-z_]{1,24})[0-9]{0,4}[\"'`]?[ \t]{0,2}[=:]?[>]?[ \t]{0,2}[\"'`(\[{]?$"
#: A run that goes from its name to its value.
NAMED = "^([A-Za-z_]{1,24})[0-9]{0,4}[=:]([^=:]{16,}={0,2})$"
#: Characters before a candidate in which its neighbouring word is looked for: more than NEIGHBOUR can match.
REACH = 48
MARK = "[SECRET]"
#: Documents whose candidates the forest is fitted on, about.
FIT_DOCUMENTS = 2000
#: A candidate of a sampled text counts as a secret if it is named as one and looks like this: letters and digits without words.
KEYLIKE = "^(?=[^0-9]*[0-9][^0-9]*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_=-]{16,}$"
#: Fixed words: what a leaked value is usually called, and what names something harmless.
NAMES = ("token", "secret", "key", "apikey", "api_key", "access_key", "password", "passwd", "pwd", "auth", "bearer", "credential", "private_key", "client_secret")
HARMLESS = ("commit", "sha", "checksum", "digest", "hash", "etag", "revision", "md5", "uuid", "id", "version", "see", "file", "url", "card", "from", "by")
#: Words and syllables that make up names and prose; a key made at random holds few of them.
DICTIONARY = ("tion", "ment", "able", "ing", "the", "and", "for", "with", "from", "that", "this", "have", "are", "was", "not", "ent", "ion", "eau", "que", "elle", "oi", "keit", "heit", "ung", "ich", "sch", "ein", "ver", "ge", "ción", "ado", "mente", "os", "as", "er", "re", "in", "on", "an", "en", "es", "ed", "th", "st", "nd", "ou", "ea", "name", "value", "test", "data", "list", "index", "config", "example", "com", "org", "net", "www", "http", "user", "mail", "src", "main", "lib", "util")


def _per(part: Column, whole: Column) -> Column:
    return part / F.greatest(F.length(whole), F.lit(1)).cast("double")


def _left(value: Column, pattern: str) -> Column:
    """Characters of value that the pattern matches."""
    return (F.length(value) - F.length(F.regexp_replace(value, pattern, ""))).cast("double")


def features(value: Column, before: Column) -> Column:
    """What the forest sees of a candidate and the word before it."""
    low = F.lower(value)
    name = F.lower(before)
    changes = F.length(F.regexp_replace(F.regexp_replace(value, "[a-z]++|[^A-Za-z0-9]++", "a"), "[A-Z]++|[0-9]++", "b")).cast("double")
    return F.array(
        F.length(value).cast("double"),
        _per(_left(value, "[0-9]"), value),
        _per(_left(value, "[A-Z]"), value),
        _per(_left(value, "[a-z]"), value),
        _per(_left(value, "[^A-Za-z0-9]"), value),
        _per(changes, value),
        _per(F.size(F.array_distinct(F.split(value, ""))).cast("double"), value),
        _per(_left(low, "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")"), value),
        F.rlike(low, F.lit("^[0-9a-f]++$")).cast("double"),
        F.rlike(value, F.lit("^[0-9:./_-]++$")).cast("double"),
        F.rlike(low, F.lit(r"@[a-z0-9-]++\.|^https?:|^www\.|/.*/|\.(?:com|org|net|io|html?|py|txt|md|json)$")).cast("double"),
        F.rlike(value, F.lit("^(?:AKIA|ASIA|ghp_|gho_|xox[abp]-|sk-|eyJ|AIza)")).cast("double"),
        name.isin(*NAMES).cast("double"),
        name.isin(*HARMLESS).cast("double"),
        F.rlike(value, F.lit("(.)\\1{3}")).cast("double"),
    )


def labelled_findings(spark: SparkSession, per_kind: int = 60) -> DataFrame:
    """value, before and label of findings made by rule: keys of usual kinds, and what is taken for them."""
    made = spark.range(per_kind).select("id", F.expr("sha2(concat('s', id), 512)").alias("h"))
    h = F.col("h")

    def text(alphabet: str, n: int, salt: int) -> Column:
        drawn = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(h, k, F.lit(salt)), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1)))
        return F.array_join(drawn, "")

    def word(n: int, salt: int) -> Column:
        syllables = F.array(*(F.lit(s) for s in DICTIONARY[:47]))
        return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.element_at(syllables, (F.pmod(F.xxhash64(h, k, F.lit(salt)), F.lit(47)) + 1).cast("int"))), "")

    def of(names: tuple[str, ...], salt: int) -> Column:
        return F.element_at(F.array(*(F.lit(n) for n in names)), (F.pmod(F.xxhash64(h, F.lit(salt)), F.lit(len(names))) + 1).cast("int"))

    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexed, mixed = "0123456789abcdef", low + up + digits
    prose = ("the", "of", "and", "le", "der", "que", "")
    kinds = [
        (1, text(hexed, 40, 1), of(NAMES, 2)), (1, text(hexed, 32, 3), of(NAMES, 4)), (1, text(hexed, 64, 5), of(NAMES, 6)), (1, text(mixed, 40, 7), of(NAMES, 8)),
        (1, text(mixed + "+/", 44, 9), of(NAMES + prose, 10)), (1, F.concat(F.lit("AKIA"), text(up + digits, 16, 11)), of(NAMES + prose, 12)), (1, F.concat(F.lit("ghp_"), text(mixed, 36, 13)), of(NAMES + prose, 14)),
        (1, F.concat(F.lit("sk-"), text(mixed, 32, 15)), of(NAMES + prose, 16)), (1, text(mixed, 24, 17), of(NAMES, 18)),
        (0, text(hexed, 40, 21), of(HARMLESS, 22)), (0, text(hexed, 64, 23), of(HARMLESS, 24)), (0, text(hexed, 32, 25), of(HARMLESS, 26)), (0, text(digits, 16, 27), of(prose + HARMLESS, 28)),
        (0, word(7, 29), of(prose, 30)), (0, F.initcap(word(8, 31)), of(prose, 32)), (0, F.upper(word(7, 33)), of(prose, 34)), (0, F.concat(word(7, 35), F.lit(".")), of(prose, 36)),
        (0, F.concat(word(2, 37), F.lit("."), text(digits, 2, 38), F.lit("@mail"), text(digits, 1, 39), F.lit(".example.com")), of(prose, 40)), (0, F.concat(F.lit("https://www."), word(3, 41), F.lit(".com/"), word(2, 42)), of(prose + ("url",), 43)),
        (0, F.concat(F.lit("src/"), word(3, 44), F.lit("/"), word(3, 45), F.lit(".py")), of(prose + ("file",), 46)), (0, F.concat(word(3, 47), F.lit("_"), word(3, 48), F.lit("_"), word(2, 49)), of(NAMES + prose, 50)),
        (0, F.concat_ws("-", text(hexed, 8, 51), text(hexed, 4, 52), text(hexed, 4, 53), text(hexed, 4, 54), text(hexed, 12, 55)), of(HARMLESS, 56)), (0, F.repeat(text(low, 1, 57), 20), of(NAMES + prose, 58)),
        (0, F.repeat(F.lit("="), 20), of(prose, 59)), (0, F.concat(text(digits, 4, 60), F.lit("-"), text(digits, 2, 61), F.lit("-"), text(digits, 2, 62), F.lit("T"), text(digits, 2, 63), F.lit(":"), text(digits, 2, 64)), of(prose, 65)),
        (0, F.concat(text("123456789", 1, 66), F.lit("."), text(digits, 2, 67), F.lit("."), text(digits, 12, 68)), of(HARMLESS + prose, 69)),
    ]
    every = F.array(*(F.struct(F.lit(label).cast("double").alias("label"), value.alias("value"), before.alias("before")) for label, value, before in kinds))
    return made.select(F.explode(every).alias("x")).select("x.*")


def candidates(text: Column) -> Column:
    """The candidates of a text, in order: array of (value, before)."""
    whole = F.coalesce(text, F.lit(""))
    found = F.regexp_extract_all(whole, F.lit(CANDIDATE), F.lit(0))
    # what stands before each candidate: the text since the one before, and the end of that one, which may be its name
    gaps = F.zip_with(F.concat(F.array(F.lit("")), found), F.split(whole, CANDIDATE, -1), lambda x, gap: F.concat(F.right(x, F.lit(REACH)), F.right(gap, F.lit(REACH))))
    split = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda x, gap: F.struct(x.alias("value"), F.regexp_extract(gap, NEIGHBOUR, 1).alias("before")))
    # a candidate that runs from its name to its value (name=value, name:value) is cut after the sign
    return F.transform(split, lambda x: F.when(F.rlike(x["value"], F.lit(NAMED)), F.struct(F.regexp_extract(x["value"], NAMED, 2).alias("value"), F.regexp_extract(x["value"], NAMED, 1).alias("before"))).otherwise(x))


def drawn_findings(documents: DataFrame, text: str = "text", rows: int = FIT_DOCUMENTS) -> DataFrame:
    """value, before and label of the candidates of about `rows` documents, chosen by a hash of their texts; equal ones once."""
    total = max(1, documents.count())
    chosen = documents.where(F.pmod(F.xxhash64(text), F.lit(1 << 20)) < max(1, min(1 << 20, (rows << 20) // total)))
    found = chosen.select(F.explode(candidates(F.col(text))).alias("x")).select("x.*").distinct()
    words = F.length(F.regexp_replace(F.lower("value"), "(?:" + "|".join(sorted(DICTIONARY, key=len, reverse=True)) + ")", "")) < 0.7 * F.length("value")
    return found.withColumn("label", (F.lower("before").isin(*NAMES) & F.rlike("value", F.lit(KEYLIKE)) & ~words).cast("double"))


def fit(findings: DataFrame, trees: int = 15, depth: int = 6, seed: int = 11) -> RandomForestClassificationModel:
    """A random forest on findings with value, before, label (1.0 for a secret) and, if they have it, weight."""
    weight = F.col("weight") if "weight" in findings.columns else F.lit(1.0)
    rows = findings.where("value is not null and label is not null").select("label", weight.alias("weight"), array_to_vector(features(F.col("value"), F.coalesce("before", F.lit("")))).alias("features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird", weightCol="weight").fit(rows.coalesce(1))


def trees_of(model: RandomForestClassificationModel) -> list:
    """Each tree as nested (feature, threshold, left, right); a leaf is its probability of a secret."""

    def walk(node):
        if node.subtreeDepth() == 0:
            stats = node.impurityStats().stats()
            total = stats[0] + stats[1]
            return stats[1] / total if total else 0.0
        split = node.split()
        return (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()))

    return [walk(tree._java_obj.rootNode()) for tree in model.trees]


def probability(trees: list, seen: Column) -> Column:
    """The mean of the trees' probabilities as a column over an array of features."""

    def branch(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        at, threshold, left, right = tree
        return F.when(F.get(seen, at) <= threshold, branch(left)).otherwise(branch(right))

    return reduce(lambda a, b: a + b, [branch(t) for t in trees]) / float(len(trees))


def scan(documents: DataFrame, trees: list, text: str = "text", least: float = 0.5, into: str = "findings") -> DataFrame:
    """Adds the findings of each row, in order: array of (value, before, score); a column that is already named so is replaced, so name another `into` to keep it."""
    seen = F.transform(candidates(F.col(text)), lambda x: F.struct(x["value"].alias("value"), x["before"].alias("before"), features(x["value"], x["before"]).alias("seen")))
    scored = F.transform(seen, lambda x: F.struct(x["value"].alias("value"), x["before"].alias("before"), probability(trees, x["seen"]).alias("score")))
    return documents.withColumn(into, F.filter(scored, lambda x: x["score"] >= least))


def redact(documents: DataFrame, trees: list, text: str = "text") -> DataFrame:
    """The documents with every secret in their texts replaced by a mark; nothing else changes."""
    scanned = documents.select(F.struct(*documents.columns).alias("__row"), F.col(text).alias("__text"))
    scanned = scan(scanned, trees, text="__text", into="__found")
    clean = F.when(F.size("__found") == 0, F.col("__text")).otherwise(F.aggregate(F.array_sort(F.array_distinct(F.transform("__found", lambda x: x["value"])), lambda a, b: F.length(b) - F.length(a)), F.col("__text"), lambda t, v: F.replace(t, v, F.lit(MARK))))
    return scanned.select("__row.*", clean.alias("__clean")).select(*(F.col("__clean").alias(c) if c == text else F.col(c) for c in documents.columns))


def fitted(spark: SparkSession, documents: DataFrame | None = None, text: str = "text") -> list:
    """The forest of the findings made by rule and of those drawn from the documents; both kinds weigh the same in all."""
    made = labelled_findings(spark)
    if documents is not None:
        drawn = written(drawn_findings(documents, text), "findings")
        share = made.count() / max(1, drawn.count())
        made = made.select("value", "before", "label", F.lit(1.0).alias("weight")).union(drawn.select("value", "before", "label", F.lit(share).alias("weight")))
    found = trees_of(fit(made))
    if documents is not None:
        forget(drawn)
    return found
