"""Secret scan: candidates, and a random forest that takes the false positives out (DataFrame functions and Spark ML only)."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import written

#: A candidate is a run of at least 16 letters, digits or base-64 signs.
CANDIDATE = r"[A-Za-z0-9+/_=\-]{16,}"

#: Candidates that dots join (a JWT's parts) form a chain and share what stands around it. Possessive, so that long chains don't nest in the matcher.
CHAIN = rf"{CANDIDATE}(?:\.{CANDIDATE})*+"

#: Names of what holds a secret, in the three words before a candidate or in its own word.
SECRET_NAMES = r"(?i)token|secret|passw|api_?key|access_?key|auth|credential|private|bearer"

#: Parts of a path (here: the source) that speak for samples and generated files.
SAMPLE_PATHS = r"(?i)test|example|sample|fixture|mock|doc|lock|min\.js"

#: A word of a dictionary is of 3 to 8 small letters and in at least this share of the documents, so a dictionary has at most mean words / DICTIONARY words.
DICTIONARY = 1e-3

#: At most so many labelled findings of each label train the forest.
MOST_FINDINGS = 10_000

#: Up to so many dictionary words are broadcast (some 16 bytes each).
MOST_SENT_WORDS = 200_000

FEATURES = ("length", "transitions", "coverage", "named", "assigned", "quoted", "sample_path", "near_length")

#: Published formats of keys and tokens.
KEY_FORMATS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[0-9A-Za-z]{24,}|AIza[0-9A-Za-z_\-]{35}|xox[abprs]-[0-9A-Za-z\-]{10,}|glpat-[0-9A-Za-z_\-]{20})$"

#: Random values of a digest's length, in one case of hexadecimal digits.
DIGEST = r"^(?=.{32}$|.{40}$|.{64}$)([0-9a-f]+|[0-9A-F]+)$"

#: Words beside a digest that say that it is a checksum or the id of a version.
CHECKSUMS = r"(?i)\b(?:commit|checksum|sha-?\d{1,3}|md5|digest|integrity|revision|etag|blob|merge)\b"

#: A value that stands in so many different surroundings is a sample or a placeholder, not a secret, unless it has a published key format.
SAMPLE_PLACES = 3

#: Made-up findings of each kind that train the forest where there are no reviewed ones.
SEEDS_EACH = 60

#: The share of different values (by a hash) whose labels never train: the forest is measured on them.
HELD_OUT = 5


def candidates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, at (its word's number), part (its number in the word), candidate, path; and of what stands around it in its
    word, back to the chain before, and in three words on each side: named, assigned, quoted, near_length, near (the neighbouring words' hash), and summed (they
    speak of a checksum).
    No row holds more text than the candidate, however many its word has."""
    path = F.col(f"`{path_col}`").cast("string") if path_col else F.lit(None).cast("string")
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), path.alias("path"))
    rows = rows.where(F.rlike("text", F.lit(CANDIDATE))).select("doc_id", "path", F.split("text", r"[\x20\x09-\x0D]+", -1).alias("words"))
    places = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: F.rlike(F.element_at("words", i), F.lit(CANDIDATE)))
    rows = rows.select("doc_id", "path", "words", F.explode(places).alias("at"))
    before = F.array_join(F.slice("words", F.greatest(F.col("at") - 3, F.lit(1)), F.least(F.col("at") - 1, F.lit(3))), " ")
    rows = rows.select("doc_id", "path", "at", F.element_at("words", F.col("at")).alias("word"), before.alias("before"), F.array_join(F.slice("words", F.col("at") + 1, 3), " ").alias("after"))
    near = {"near": F.xxhash64("before", "after"), "near_named": F.rlike("before", F.lit(SECRET_NAMES)), "near_assigned": F.rlike("before", F.lit(r"[=:]$")), "near_length": F.length(F.concat("before", "after")) / 6, "summed": F.rlike(F.concat_ws(" ", "before", "after"), F.lit(CHECKSUMS))}
    rows = rows.withColumns(near).withColumns({"chain": F.regexp_extract_all("word", F.lit(CHAIN), F.lit(0)), "gaps": F.split("word", CHAIN, -1)})
    n = F.size("chain")  # and one gap more
    sides = {
        "gap": F.slice("gaps", F.lit(1), n),
        "tail": F.concat(F.transform(F.slice("gaps", F.lit(2), n - 1), lambda g: F.substr(g, F.lit(1), F.lit(1))), F.slice("gaps", n + 1, F.lit(1))),
        "last": F.concat(F.array(F.lit("")), F.slice("chain", F.lit(1), n - 1)),
    }
    kept = ("doc_id", "path", "at", "near", "near_named", "near_assigned", "near_length", "summed")
    rows = rows.withColumns(sides).select(*kept, F.arrays_zip("last", "gap", "chain", "tail").alias("chains"))

    def own(u: Column, k: Column) -> Column:
        named = F.rlike(F.concat(u["last"], u["gap"], u["tail"]), F.lit(SECRET_NAMES))
        assigned, quoted = F.rlike(F.concat(u["gap"], u["chain"], u["tail"]), F.lit(r"^[^=:]+[=:].")), F.rlike(F.concat(u["gap"], u["tail"]), F.lit("[\"'`]"))
        return F.struct(F.regexp_extract_all(u["chain"], F.lit(CANDIDATE), F.lit(0)).alias("own"), named.alias("named"), assigned.alias("assigned"), quoted.alias("quoted"), (k == 0).alias("first"))

    def each(u: Column) -> Column:
        return F.transform(u["own"], lambda c: F.struct(c.alias("candidate"), *[u[x].alias(x) for x in ("named", "assigned", "quoted", "first")]))

    rows = rows.select(*kept, F.posexplode(F.flatten(F.transform(F.transform("chains", own), each))).alias("part", "found")).select(*kept, (F.col("part") + 1).alias("part"), "found.*")
    named = F.col("near_named") | F.col("named") | F.rlike("candidate", F.lit(SECRET_NAMES))
    return rows.withColumns({"named": named, "assigned": F.col("near_assigned") & F.col("first") | F.col("assigned")}).drop("first", "near_named", "near_assigned")


def dictionary(df: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The frequent short words of all texts: word."""
    words = F.array_distinct(F.filter(F.split(F.col(f"`{text_col}`").cast("string"), r"[\x20\x09-\x0D]+", -1), lambda w: F.length(w).between(3, 8) & F.rlike(w, F.lit("^[a-z]+$"))))
    met = written(df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("met")))
    return written(met.where(F.col("met") >= max(2.0, DICTIONARY * df.count())).select("word"))


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Per different candidate the share of its letters that lie in words of the dictionary: id (the candidate's hash), coverage."""
    letters = F.split(F.lower("candidate"), "")
    own = found.select("candidate").distinct().select(F.xxhash64("candidate").alias("id"), F.length("candidate").alias("length"), letters.alias("letters"))
    pieces = F.transform(F.sequence(F.lit(1), F.col("length") - 2), lambda i: F.array_join(F.slice("letters", i, 8), ""))
    starts = own.select("id", "length", F.posexplode(pieces).alias("start", "piece"))  # eight letters a row, however long the candidate
    parts = starts.select("id", "length", "start", F.explode(F.sequence(F.lit(3), F.length("piece"))).alias("size"), "piece").withColumn("word", F.substr("piece", F.lit(1), F.col("size")))
    few = words.limit(MOST_SENT_WORDS + 1).count() <= MOST_SENT_WORDS
    longest = parts.join(F.broadcast(words) if few else words, "word").groupBy("id", "length", "start").agg(F.max("size").alias("size"))
    cells = longest.select("id", "length", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("cell")).groupBy("id", "length").agg(F.count_distinct("cell").alias("n"))
    return cells.select("id", (F.col("n") / F.col("length")).alias("coverage"))


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with the forest's features as doubles."""
    c = F.col("candidate")
    length = F.length(c)
    change = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=\-])(?=[^+/_=\-])"
    found = found.join(coverage(found, words), F.xxhash64("candidate") == F.col("id"), "left").drop("id")
    columns = {
        "length": length,
        "transitions": F.regexp_count(c, F.lit(change)) / length,
        "coverage": F.coalesce("coverage", F.lit(0.0)),
        **{k: F.col(k) for k in ("named", "assigned", "quoted", "near_length")},
        "sample_path": F.coalesce(F.rlike("path", F.lit(SAMPLE_PATHS)), F.lit(False)),
    }
    return found.withColumns({k: v.cast("double") for k, v in columns.items()})


def check_digit(number: Column) -> Column:
    """Whether a row of digits ends in the check digit of card numbers: from the right every second digit counts double, as the sum of its digits."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda d: d.try_cast("int"))
    weighed = F.transform(digits, lambda d, k: F.when(k % 2 == 0, d).when(d < 5, 2 * d).otherwise(2 * d - 9))
    return F.aggregate(weighed, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` with the column label, by evidence that is no feature of the forest; it stands in for a table of reviewed findings.

    1: a published key format, however often it comes, but for documented examples. 0, of the others: a value in SAMPLE_PLACES or more different
    surroundings (a sample or a placeholder), one letter over and over, digits with a card number's check digit, digits or letters of one case alone
    (numbers and words), a digest beside a word that says that it is a checksum or a version. Null: neither is known.
    """
    c = F.col("candidate")
    places = found.groupBy("candidate").agg(F.count_distinct("near").alias("places")).where(F.col("places") >= SAMPLE_PLACES)
    often = written(places.select(F.xxhash64("candidate").alias("often")).distinct())
    few = often.limit(MOST_SENT_WORDS + 1).count() <= MOST_SENT_WORDS
    found = found.join(F.broadcast(often) if few else often, F.xxhash64("candidate") == F.col("often"), "left")
    kinds = F.size(F.array_distinct(F.split(c, "")))
    plain = F.rlike(c, F.lit("^([a-z]+|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)$"))
    example = F.rlike(c, F.lit("(?i)example|placeholder"))
    no = F.col("often").isNotNull() | (kinds == 1) | plain | example | (F.rlike(c, F.lit("^[0-9]+$")) & check_digit(c)) | (F.rlike(c, F.lit(DIGEST)) & F.col("summed"))
    return found.withColumn("label", F.when(F.rlike(c, F.lit(KEY_FORMATS)) & ~example, 1.0).when(no, 0.0)).drop("often")


def seed_findings(spark: SparkSession) -> DataFrame:
    """doc_id, text, source, label: SEEDS_EACH made-up lines of each kind, with one candidate each: keys and passwords in code and settings (1); commit ids,
    checksums, UUIDs, numbers, placeholders and names (0). Values are digits of hashes, so no list of them is kept."""
    n = F.col("n")
    digest = lambda k: F.sha2(F.concat_ws("|", n.cast("string"), F.lit(str(k))), 256)
    hexed = lambda k, size: F.substring(digest(k), 1, size)
    mixed = lambda k, size: F.substring(F.regexp_replace(F.concat(F.base64(F.unhex(digest(k))), F.base64(F.unhex(digest(-k)))), "[+/=]", ""), 1, size)
    digits = lambda k, size: F.substring(F.regexp_replace(F.concat(digest(k), digest(-k)), "[a-f]", ""), 1, size)
    word = lambda k: F.get(F.array(*map(F.lit, "the and for one old file line next user page run set new call read all".split())), F.pmod(F.xxhash64(n, F.lit(k)), F.lit(16)).cast("int"))
    prose = lambda k: F.concat_ws(" ", word(k), word(k + 1), word(k + 2))
    uuid = lambda k: F.regexp_replace(hexed(k, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    kinds = [
        (1, "settings.py", 'token = "', hexed(1, 40), '"'), (1, "deploy.env", "API_KEY=", hexed(2, 32), ""), (1, "notes", "password: ", hexed(3, 32), ","), (1, "config.py", "aws_access_key_id = ", F.concat(F.lit("AKIA"), F.upper(mixed(4, 16))), ""),
        (1, "ci.yml", "GH_TOKEN: ", F.concat(F.lit("ghp_"), mixed(5, 36)), ""), (1, "pay.js", "apiKey = '", F.concat(F.lit("sk_live_"), mixed(6, 24)), "';"), (1, "maps.html", 'api_key="', F.concat(F.lit("AIza"), mixed(7, 35)), '"'), (1, "bot.rb", "secret='", mixed(8, 32), "'"),
        (1, "page", 'TOKEN = "', F.upper(hexed(9, 40)), '"'), (1, "web", "Authorization: Bearer ", mixed(10, 40), ""), (0, "log", "commit ", hexed(11, 40), ""), (0, "SUMS", "", hexed(12, 64), "  dist.tar.gz"), (0, "page", "md5 ", hexed(13, 32), ""),
        (0, "app.log", "request ", uuid(14), " done"), (0, "page", "", digits(15, 16), ""), (0, "page", "number ", digits(16, 20), "."), (0, "page", "", F.repeat(word(17), F.lit(7)), ""), (0, "docs", 'password = "', F.repeat(F.lit("x"), F.lit(24)), '"'),
        (0, "code.py", "def ", F.concat_ws("_", word(18), word(19), word(20), word(21), word(22)), "():"), (0, "git", "index ", hexed(23, 40), " 100644"), (0, "tests", "checked out ", hexed(24, 40), ""), (0, "page", "(", hexed(25, 40), ")"),
        (0, "lock", "resolved #", hexed(26, 40), ""), (0, "etc", "etag: W/", hexed(27, 32), ""), (0, "page", "token_count = ", digits(28, 17), ""), (0, "page", "secretary of ", F.repeat(word(29), F.lit(6)), " met"),
    ]
    each = [F.struct(F.lit(float(label)).alias("label"), F.lit(path).alias("source"), F.concat(prose(100 + 10 * k), F.lit(" "), F.lit(a), value, F.lit(b), F.lit(" "), prose(105 + 10 * k)).alias("text"), F.lit(k).alias("k")) for k, (label, path, a, value, b) in enumerate(kinds)]
    rows = spark.range(SEEDS_EACH, numPartitions=1).withColumnRenamed("id", "n").select("n", F.explode(F.array(*each)).alias("s"))
    return rows.select((F.col("s.k") * SEEDS_EACH + n).alias("doc_id"), "s.text", "s.source", "s.label")


def _sample(found: DataFrame) -> DataFrame:
    """Up to MOST_FINDINGS rows of each label, those first in the order of a hash, in one order whatever the partitions."""
    order = F.xxhash64("candidate", "near", "doc_id", "at", "part")
    found = found.where(F.pmod(F.xxhash64("candidate", F.lit("fold")), F.lit(HELD_OUT)) != 0)
    own = [found.where(F.col("label") == label).select("label", order.alias("order"), *FEATURES).orderBy("order", *FEATURES).limit(MOST_FINDINGS) for label in (0.0, 1.0)]
    return own[0].unionByName(own[1])


def _seeded(spark: SparkSession, words: DataFrame) -> DataFrame:
    """label, order and features of the made-up findings."""
    seeds = written(seed_findings(spark))
    found = with_features(candidates(seeds), words).join(seeds.select("doc_id", F.col("label").alias("label")), "doc_id")
    return found.select("label", F.xxhash64("candidate", "doc_id").alias("order"), *FEATURES)


def scan_secrets(df: DataFrame, *, findings: DataFrame | None = None, cut: float = 0.5, trees: int = 20, depth: int = 6, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """One row per candidate: doc_id, at (the word's number), part (the candidate's number in its word), candidate, probability, is_secret.

    A random forest on the candidate's length, changes of character class, coverage by the corpus's frequent words, path, and neighbouring
    words, trained on at most MOST_FINDINGS findings of each label, sets ``is_secret`` where its probability is at least ``cut``.
    ``findings`` (candidate, label 0/1) are reviewed ones; without them ``label_findings`` labels those of ``df``, and ``seed_findings`` makes up more of both labels. Both
    labels weigh the same. Of all different values one in HELD_OUT trains nothing (``held_out_figures`` measures the forest on those). The verdict is the
    forest's alone. With findings of one label only there is no forest: probability is null and a candidate is a secret if it is labelled so.

    Null and empty texts have no candidates; a null path speaks for nothing; null ids are kept. Repeated rows give repeated results. An empty
    table gives no rows. Other columns are not read. Texts are split whole, candidates of any length are taken whole.
    """
    found = _judged(df, findings=findings, cut=cut, trees=trees, depth=depth, id_col=id_col, text_col=text_col, path_col=path_col)
    return found.select("doc_id", "at", "part", "candidate", "probability", "is_secret")


def held_out_figures(df: DataFrame, **options: object) -> DataFrame:
    """label, is_secret, n of the labelled candidates that trained nothing; ``options`` as for ``scan_secrets``."""
    options = {"findings": None, "cut": 0.5, "trees": 20, "depth": 6, "id_col": "doc_id", "text_col": "text", "path_col": "source"} | options
    found = _judged(df, **options).where("label is not null").where(F.pmod(F.xxhash64("candidate", F.lit("fold")), F.lit(HELD_OUT)) == 0)
    return found.groupBy("label", "is_secret").agg(F.count("*").alias("n"))


def _judged(df: DataFrame, *, findings: DataFrame | None, cut: float, trees: int, depth: int, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    found = written(candidates(df, id_col=id_col, text_col=text_col, path_col=path_col))
    words = dictionary(df, text_col=text_col)
    found = written(with_features(found, words))
    if findings is None:
        found = label_findings(found)
    else:
        known = findings.select("candidate", F.col("label").cast("double").alias("label")).dropna().groupBy("candidate").agg(F.max("label").alias("label"))
        found = found.join(known, "candidate", "left")
    train = written(_sample(found) if findings is not None else _sample(found).unionByName(_seeded(df.sparkSession, words)))
    if train.select("label").distinct().count() < 2:
        return found.withColumns({"probability": F.lit(None).cast("double"), "is_secret": F.coalesce(F.col("label") == 1, F.lit(False))})
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sizes = {r.label: r["count"] for r in train.groupBy("label").count().collect()}
    weight = F.when(F.col("label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * sum(sizes.values())
    train = assemble.transform(train.repartition(1).sortWithinPartitions("label", "order", *FEATURES)).select("label", "features", weight.alias("weight"))  # bounded by MOST_FINDINGS
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=17, featuresCol="features", labelCol="label", weightCol="weight", rawPredictionCol="__raw", probabilityCol="__p", predictionCol="__predicted").fit(train)
    scored = forest.transform(assemble.transform(found)).withColumn("probability", F.round(_second(F.col("__p")), 9))
    return scored.withColumn("is_secret", F.col("probability") >= cut)


def _second(vector: Column) -> Column:
    return F.element_at(vector_to_array(vector), 2)
