"""Secret scan: candidates by pattern, and a random forest that removes false positives, trained from labelled findings."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, spaced, whole

#: A candidate is every run of so many of these characters or more, wherever it stands in a text.
LEAST = 12
RUN = "[A-Za-z0-9+/_.-]{%d,}+"
#: The name in front of a candidate, from its lead read backwards: the marks between the two, then the run before them.
NAME = "^([^A-Za-z0-9+/_.-]*[A-Za-z0-9+/_.-]*)"
KEYS = "(?i)(passw|pwd|secret|token|api.?key|access.?key|auth|bearer|credential|private)"
BENIGN = "(?i)(commit|revision|checksum|md5|sha\\d|hash|uuid|guid|version|build|isbn|order|invoice|phone|serial|digest|etag)"
RISKY_PATH = "(?i)(\\.env|config|secret|credential|deploy|prod|settings|\\.pem|\\.key)"
TAME_PATH = "(?i)(test|example|sample|doc|readme|fixture|mock|spec|demo|tutorial)"
#: A word of letters between white space, full stops and commas left out.
LETTERS = "(?<!\\S)[a-z]{3,40}(?=[.,;:!?]*+(?:\\s|$))"
#: What of a candidate can be a word: letters of one case, or one capital and small letters.
PARTS = "[A-Z]?[a-z]+|[A-Z]+"
#: What stands for the mean transition of a candidate without two letters in a row.
NO_LETTERS = -2.0


@dataclass
class Language:
    """What the corpus says of words: words (word, c) that occur often enough, and log10 of each letter's share after each letter, a constant 26 x 26."""

    words: DataFrame
    transitions: list[float]


def learn_language(df: DataFrame, text_col: str, scratch: Scratch, least_count: int = 3) -> Language:
    """Counts all words of letters of all texts, and their letter pairs by how often the words occur. Only the 676 pairs come to the driver."""
    counts = df.select(F.explode(F.regexp_extract_all(F.lower(whole(text_col)), F.lit(LETTERS), 0)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    counts = scratch.table(counts, "words")
    pairs = counts.select("c", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.substring("word", k, F.lit(2)))).alias("pair"))
    met = [[1.0] * 26 for _ in range(26)]
    for r in pairs.groupBy("pair").agg(F.sum("c").alias("n")).collect():
        met[ord(r["pair"][0]) - 97][ord(r["pair"][1]) - 97] += r["n"]
    return Language(counts.filter(F.col("c") >= least_count), [math.log10(n / sum(row)) for row in met for n in row])


def candidates(df: DataFrame, id_col: str, text_col: str, path_col: str | None, least: int = LEAST) -> DataFrame:
    """One row per candidate: id, path, start (characters before it), candidate, word, before, before2, after.

    Texts are split at white space, and of each word every RUN is a candidate, less full stops and hyphens at its end if it still has least characters. word is the
    candidate with the name and marks in front of it; before, before2 and after are the words around the one that it stands in. Only words with a run are exploded.
    """
    run = RUN % least
    path = F.coalesce(F.col(path_col).cast("string"), F.lit("")) if path_col else F.lit("")
    rows = df.select(F.col(id_col).alias("_id"), path.alias("_path"), F.split(spaced(whole(text_col)), " ").alias("_w"))
    none = F.array().cast("array<struct<i:int,at:bigint>>")
    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("at"), none.alias("found"))

    def step(a: Column, w: Column) -> Column:
        here = F.struct(a["i"].alias("i"), a["at"].alias("at"))
        found = F.when((F.length(w) >= least) & w.rlike(run), F.concat(a["found"], F.array(here))).otherwise(a["found"])
        return F.struct((a["i"] + 1).alias("i"), (a["at"] + F.length(w) + 1).alias("at"), found.alias("found"))

    def word(i: Column) -> Column:
        return F.coalesce(F.get(F.col("_w"), i), F.lit(""))

    rows = rows.withColumn("_f", F.aggregate("_w", start, step, lambda a: a["found"])).filter(F.size("_f") > 0)
    around = F.transform("_f", lambda f: F.struct(f["at"].alias("at"), word(f["i"]).alias("w"), word(f["i"] - 1).alias("before"), word(f["i"] - 2).alias("before2"), word(f["i"] + 1).alias("after")))
    rows = rows.select("_id", "_path", F.explode(around).alias("_f")).select("_id", "_path", "_f.*")
    # Gaps and runs of a word take turns, so a run starts behind the gaps up to it and the runs before it.
    rows = rows.withColumns({"_runs": F.regexp_extract_all("w", F.lit(run), 0), "_gaps": F.split("w", run, -1)})
    turns = F.arrays_zip(F.col("_gaps").alias("gap"), F.col("_runs").alias("run"))
    empty = F.struct(F.col("at").alias("at"), F.lit("").alias("last"), F.array().cast("array<struct<start:bigint,run:string,lead:string>>").alias("found"))

    def turn(a: Column, t: Column) -> Column:
        at = a["at"] + F.length(t["gap"])
        one = F.struct(at.alias("start"), t["run"].alias("run"), F.concat(a["last"], t["gap"]).alias("lead"))
        return F.struct((at + F.length(t["run"])).alias("at"), t["run"].alias("last"), F.concat(a["found"], F.array(one)).alias("found"))

    # The last gap has no run behind it.
    turns = F.slice(turns, F.lit(1), F.size("_runs"))
    rows = rows.select("_id", "_path", F.explode(F.aggregate(turns, empty, turn, lambda a: a["found"])).alias("_r"), "before", "before2", "after").select("_id", "_path", "_r.*", "before", "before2", "after")
    rows = rows.withColumn("candidate", F.regexp_replace("run", "[.-]++$", "")).filter(F.length("candidate") >= least)
    name = F.reverse(F.regexp_extract(F.reverse("lead"), NAME, 1))
    return rows.withColumn("word", F.concat(name, "candidate")).drop("run", "lead")


def coverage(df: DataFrame, words: DataFrame) -> DataFrame:
    """Adds dictionary: the share of a candidate's characters that are in parts that the corpus has as words.

    Each different candidate is taken apart once and its parts are looked up by a join, so the dictionary has any size; the shares go back by candidate.
    """
    parts = df.select("candidate").distinct().select("candidate", F.explode(F.regexp_extract_all("candidate", F.lit(PARTS), 0)).alias("_part"))
    parts = parts.select("candidate", F.lower("_part").alias("word")).filter(F.length("word") >= 3)
    shares = parts.join(words.select("word"), "word", "left_semi").groupBy("candidate").agg(F.sum(F.length("word")).alias("_held"))
    return df.join(shares, "candidate", "left").withColumn("dictionary", F.coalesce(F.col("_held") / F.length("candidate"), F.lit(0.0))).drop("_held")


def features(df: DataFrame, language: Language) -> tuple[DataFrame, list[str]]:
    """Adds the forest's inputs to rows of candidate, word, before, before2, after, _path."""
    df = coverage(df, language.words)
    c, n = F.col("candidate"), F.length("candidate")
    kind = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "Z"), "+/_.-", "-----")
    letters, table = F.lower(c), F.array(*map(F.lit, language.transitions))
    code = F.transform(F.split(letters, ""), lambda x: F.ascii(x) - 97)
    pairs = F.filter(F.zip_with(code, F.slice(code, F.lit(2), n), lambda a, b: F.when(a.between(0, 25) & b.between(0, 25), a * 26 + b)), lambda i: i.isNotNull())
    # Codes of pairs of letters, looked up in the corpus's table.
    transitions = F.try_divide(F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.get(table, i)), F.size(pairs).cast("double"))
    near = F.concat_ws(" ", "before2", "before", F.regexp_extract("word", "^([A-Za-z0-9+/_.-]*+)[^A-Za-z0-9+/_.-]", 1))
    flags = {"key_near": near.rlike(KEYS), "key_after": F.col("after").rlike(KEYS), "benign_near": near.rlike(BENIGN), "risky_path": F.col("_path").rlike(RISKY_PATH), "tame_path": F.col("_path").rlike(TAME_PATH), "assigned": F.col("word").rlike("[=:]") | F.col("before").rlike("[=:]$"), "quoted": F.col("word").rlike("[\"']"), "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$"), "dashed": c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"), "dated": c.rlike("(19|20)[0-9]{2}[-_.]?[01][0-9]"), "all_digits": c.rlike("^[0-9._/+-]+$"), "prefixed": c.rlike("^(A[KS]IA[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|AIza|sk-|eyJ)")}
    numbers = {
        "length": n.cast("double"),
        "digits": F.regexp_count(c, F.lit("[0-9]")) / n,
        "uppers": F.regexp_count(c, F.lit("[A-Z]")) / n,
        "others": F.regexp_count(c, F.lit("[+/_.-]")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "changes": F.regexp_count(kind, F.lit("a(?!a)|Z(?!Z)|9(?!9)|-(?!-)")) / n,
        "longest_run": F.array_max(F.transform(F.regexp_extract_all(kind, F.lit("(a+|Z+)"), 1), lambda x: F.length(x))).cast("double") / n,
        "transitions": F.coalesce(transitions, F.lit(NO_LETTERS)),
    }
    columns = {k: F.coalesce(v, F.lit(0.0)) for k, v in numbers.items()} | {k: v.cast("double") for k, v in flags.items()}
    return df.withColumns(columns), ["dictionary", *columns]


def labelled_findings(spark: SparkSession, n: int = 6000, seed: int = 5, words: DataFrame | None = None, most_words: int = 2000) -> DataFrame:
    """Labelled findings to train from where a user has none: candidate, word, before, before2, after, _path, label.

    Drawn by hash from templates: keys, tokens and passwords of usual forms among code and prose, and what is mistaken for them: hashes,
    identifiers, versions, dates, file names, placeholders, numbers, words of prose in any case. Either kind is found at any path, keys more often at risky ones. words (word, c)
    adds long words of the corpus, at most most_words of them by hash, as false findings.
    """
    rows = spark.range(n, numPartitions=2).select("id", *(F.sha2(F.concat(F.lit(f"{seed}:{k}:"), F.col("id").cast("string")), 512).alias(f"h{k}") for k in range(3)))
    hexes, more = F.col("h0"), F.col("h1")

    def pick(values: list[str], salt: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64("id", F.lit(f"{seed}{salt}")), F.lit(len(values))) + 1).cast("int"))

    mixed = F.regexp_replace(F.base64(F.unhex("h0")), "[=]", "")
    prose = pick("the of and in on was were here line value see with then und der que los et la".split(), "p")
    key = pick(["password=", "token=", "secret:", "api_key=", "access_key=", "PASSWORD=", "auth_token:"], "k")
    name = F.concat(pick(["report", "userprofile", "customerdata", "ProductImage", "default_config", "getUserName", "version_release", "sampleDocument", "chapter-section"], "n"), F.lit("_"), pick(["final", "backup", "index", "v2", "table", "Latest", "draft"], "m"), F.substring(F.regexp_replace(more, "[a-f]", ""), 1, 4))
    uuid = F.concat_ws("-", *(F.substring(hexes, a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    number = F.substring(F.regexp_replace(F.concat(hexes, more), "[a-f]", ""), 1, 14)
    date = F.concat(F.lit("20"), F.substring(number, 1, 2), pick(["-03-", "-07-", "-11-", "-12-"], "d"), F.substring(number, 5, 1), F.lit("1T10.30.00"))
    plain = F.lit("")
    letters = F.translate(mixed, "0123456789+/", "kRzVqXwJbMTc")
    syllables = F.concat(*(pick("the ing ent ion ver con sta per tra men ber lan ade ori ele ita ren sol mar tin".split(), f"S{k}") for k in range(5)))
    spoken = F.element_at(F.array(syllables, F.upper(syllables), F.initcap(syllables)), (F.pmod(F.xxhash64("id", F.lit(f"{seed}C")), F.lit(3)) + 1).cast("int"))
    yes = [
        (F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(mixed, "[+/]", "X"), 1, 16))), plain, prose, plain),
        (F.substring(hexes, 1, 18), key, prose, plain), (F.substring(hexes, 1, 32), F.lit("'"), pick(["=", ":"], "q"), pick(["secret", "api_key", "password", "private_key"], "e")),
        (F.substring(mixed, 1, 40), key, prose, plain), (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(mixed, "[+/]", "a"), 1, 36)), plain, pick(["token:", "with", "Bearer", "key"], "r"), prose),
        (F.substring(mixed, 1, 24), F.lit("\""), F.lit(":"), pick(["\"password\"", "secret", "access_key"], "s")), (F.concat(F.lit("sk-"), F.substring(mixed, 1, 32)), plain, pick(["key", "auth", "the"], "t"), prose),
        (F.substring(letters, 1, 20), key, prose, plain),
    ]
    no = [
        (uuid, plain, pick(["uuid", "id", "the", "guid"], "u"), prose), (F.substring(hexes, 1, 40), plain, pick(["commit", "revision", "sha1", "checksum"], "v"), prose), (F.substring(hexes, 1, 64), F.lit("sha256:"), pick(["digest", "layer", "hash"], "w"), prose),
        (name, plain, prose, prose), (date, plain, prose, prose), (number, plain, pick(["phone", "order", "invoice", "no", "the"], "x"), prose),
        (F.concat(pick(["changeme", "yourpassword", "example-token-", "placeholder"], "y"), F.substring(number, 1, 4)), key, prose, plain), (F.concat(F.lit("1."), F.substring(number, 1, 2), F.lit("."), F.substring(number, 3, 2), F.lit("-snapshot.build")), plain, pick(["version", "release", "build"], "z"), prose),
        (F.concat(pick(["https", "docs", "images"], "a"), F.lit("/page/section/"), F.substring(number, 1, 6)), plain, prose, prose), (F.concat(F.lit("and"), pick(["thetion", "enreaha", "erlyble", "keitung"], "b"), F.substring(number, 1, 2)), plain, prose, prose),
        (spoken, plain, prose, prose), (F.concat_ws("-", pick(["state-of", "long", "well", "self"], "g"), F.substring(syllables, 1, 8)), plain, prose, prose), (spoken, key, prose, plain),
    ]
    at = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30))
    label = (F.col("id") % 2).cast("double")
    choices = [(label == k, t, i, len(ts)) for k, ts in ((1, yes), (0, no)) for i, t in enumerate(ts)]

    def chosen(column: int) -> Column:
        return reduce(lambda c, x: c.when(x[0] & (at % x[3] == x[2]), x[1][column]), choices[1:], F.when(choices[0][0] & (at % choices[0][3] == choices[0][2]), choices[0][1][column]))

    rows = rows.select("id", chosen(0).alias("candidate"), chosen(1).alias("_lead"), chosen(2).alias("before"), chosen(3).alias("before2"), prose.alias("after"), F.when(label == 1, pick(["config/prod.env", "src/deploy.py", "src0", "web", "crawl", "settings.yaml", "tests/fixture.json"], "P")).otherwise(pick(["docs/example.md", "tests/fixture.json", "src0", "web", "crawl", "src/app.py", "config/prod.env"], "P")).alias("_path"), label.alias("label"))
    rows = rows.withColumn("word", F.concat("_lead", "candidate")).drop("id", "_lead")
    if words is None:
        return rows
    some = words.filter(F.length("word") >= LEAST).select("word").orderBy(F.xxhash64("word"), "word").limit(most_words)
    return rows.unionByName(some.select(F.col("word").alias("candidate"), F.lit("the").alias("before"), F.lit("of").alias("before2"), F.lit("and").alias("after"), F.lit("web").alias("_path"), F.lit(0.0).alias("label"), "word"))


def train_forest(labelled: DataFrame, language: Language, trees: int = 40, depth: int = 8, seed: int = 3) -> RandomForestClassificationModel:
    """A forest over features() from labelled findings (columns as in labelled_findings), a table of human size."""
    rows, names = features(labelled, language)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(rows)


def scan_secrets(df: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5, least: int = LEAST) -> DataFrame:
    """One row per candidate in the whole texts: id, start (characters before it), length, candidate, score, is_secret.

    A candidate has least characters or more; shorter passwords are told from words by nothing that these features see. The score is the share of the forest for a secret; below
    threshold a candidate is a false positive. The dictionary and the letter transitions are those of all the texts given. Null and empty texts have no candidate; a null path is empty.
    Repeated rows give their candidates again, with equal scores; null ids are carried along. An empty table gives an empty result. Other columns of df aren't read, and words of any length are
    taken whole. Only JVM functions: words are counted with a map-side combine, candidates meet the dictionary by joins that Spark can split, and the forest has a fixed size.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "secrets")
    language = learn_language(df, text_col, scratch)
    labelled = scratch.table(labelled_findings(spark, words=language.words), "labelled") if labelled is None else labelled
    model = train_forest(labelled, language)
    found = scratch.table(candidates(df, id_col, text_col, path_col, least), "candidates")
    rows, names = features(found, language)
    rows = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
    score = vector_to_array("probability")[1]
    return rows.select(F.col("_id").alias(id_col), "start", F.length("candidate").cast("long").alias("length"), "candidate", F.round(score, 6).alias("score"), (score >= threshold).alias("is_secret"))
