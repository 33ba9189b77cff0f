"""Secret scan: pattern candidates, and a random forest that removes false positives.

A candidate is the value after the assignment of a password, token or key, whatever its
length and characters; a JSON web token with all its parts; or a run of key characters that
is long enough and holds a digit or begins with a known prefix.  A quoted value ends at its
quote, an unquoted one at white space, without the closing marks before it.  The
forest sees its length, its characters' kinds and transitions, how much of it dictionary
words cover, whether it stands in a path, and the words next to it.  The dictionary holds
some words of code and paths and the corpus's own: those letters-only words that most of
its documents hold, counted over all of them.  The forest is trained from labelled
findings: value, before, after, label.  Without findings of one's own,
``labelled_findings`` generates some: keys, tokens and passwords as true ones; digests,
ids, paths, numbers, identifiers and placeholders as false ones.

Everything is DataFrame functions and the JVM's own forest; texts are split at their
candidates, so each candidate's context is the text between it and its neighbours.

Defined results: null and empty texts have no candidates; repeated rows give repeated
findings; rows without doc_id are scanned too; extra columns are kept by ``masked`` and
ignored by ``findings``; an empty table has no findings.  Candidates are numbered from 0
in each text.  Labelled findings with a null value or label don't count; without any, or
with one label only, every candidate's score is the share of secrets among them (0 without
any).  Of words that equally many documents hold the first by code point come first.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._io import saved

#: What names a secret, up to where its value begins: name, suffix, closing marks, sign, scheme, quote.
NAMED = (
    r"(?<=(?:(?i:secret|token|passw(?:or)?d|passphrase|passcode|passwd|pwd|credential|auth(?:orization)?|bearer|(?:api|access|private|signing|encryption|account|shared|master|client|service|ssh)[_\-. ]?key)|(?<![A-Za-z])(?i:key|pass|pin))"
    r"s?(?:[A-Z0-9_\-.][\w.\-]{0,24})?[\"'`\])]{0,2}[ \t]{0,8}[=:>]{1,2}[ \t]{0,8}(?:(?i:bearer|basic|token)[ ])?[\"'`]?)"
)
#: A value up to its closing quote, which a backslash escapes; else up to white space, closing marks or the next pair.
#: The repeated groups take one character at a time, so they need no stack however long a line is.
VALUE = (
    r"(?:" + "|".join(rf"(?<={q})(?:(?!(?<!\\){q})[^\n])++(?={q})" for q in "\"'`") + "|"
    r"(?![\"'`]|(?i:bearer|basic|token)[ ])(?:(?![\"'`.,;:)\]}>]*+(?:\s|$)|[,;&][A-Za-z_]\w{0,30}+=|[\"'`][,;:)\]}>]|</)\S)++)"
)
#: A value by its context, a JSON web token, or a maximal run of 16 or more key characters with a digit in it or a known prefix.
CANDIDATE = (
    rf"(?<=[=:>\"'`\s])(?=\S)(?<=[=:>][ \t]{{0,8}}(?:[A-Za-z]{{5,6}}[ ])?[\"'`]?){NAMED}{VALUE}"
    r"|(?<![A-Za-z0-9_+/\-])(?:eyJ[A-Za-z0-9_\-]{5,}+(?:\.{1,2}[A-Za-z0-9_\-]++){1,4}+={0,2}"
    r"|(?=[A-Za-z_+/\-]*+[0-9]|AKIA|ASIA|gh[pos]_|glpat-|sk_live_|xox[abp]-)[A-Za-z0-9_+/\-]{16,}+={0,2})"
)
BEFORE, AFTER = 48, 16
TRUE_WORDS = r"(?i)(secret|token|passw|pwd|api.?key|access.?key|private.?key|auth|credential|bearer|aws)[^\n]{0,24}$"
FALSE_WORDS = r"(?i)(commit|sha-?1|sha-?256|md5|checksum|digest|hash|uuid|guid|build|revision|example|sample|dummy|order|invoice|card|phone|isbn|version)[^\n]{0,24}$"
PREFIXES = r"^(AKIA|ASIA|ghp_|gho_|ghs_|xox[abp]-|sk_live_|rk_live_|AIza|glpat-|eyJ)"
#: Values that only say where the secret is, or that there is none.
REFERENCE = r"(?i)^(\$[({]?[a-z_].*|%[a-z_]+%|[<{\[].*[>}\]]|\*+|\.+|-+|_+|[a-z_][\w.]*[(\[].*|[a-z_]+(\.[a-z_]+)+|null|none|nil|true|false|undefined|string|str|n/a)$"
FILLER = r"(?i)(example|placeholder|changeme|xxxx|your|dummy|sample|0000|1234|abcd)"
#: Words of code and paths, which a dictionary holds beside the corpus's.
DICTIONARY = (
    "about access after again api app assets back base before body book build button cache call change class client code commit common config content core count create data date default demo dist document "
    "down draft each edit element error event example export false field file filter first font form frame from func function general get group handler header home image import index info input install item "
    "java key last layer layout left level lib like line link list load local log main make manager map master menu message method mode model module name new next node note null number object old open option "
    "order other page panel param part password path place plugin point position post print process product project public query read record report request reset result return right root row run sample save "
    "scale script search section select server service session set show simple site size source space stage start state static status step stop store string style sub system table target task temp template "
    "test text the this time title token tool top total track tree true type update upload user util value version view web widget width window with word work write year your"
).split()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["length", "transitions", "digits", "uppers", "symbols", "distinct", "dictionary", "vowels", "hexadecimal", "path", "true_words", "false_words", "assigned", "quoted", "prefix", "filler", "reference"]
TREES, DEPTH, SEED = 24, 8, 7
#: Words that a dictionary takes from the corpus at most (they travel in the plan), and documents that must hold one.
CORPUS_WORDS, HOLDERS = 512, 5
#: Findings that labelled_findings generates: a bound on the default training set.
GENERATED = 4800


def kinds(value: Column) -> Column:
    """The value with a for lower case, A for upper case, 0 for digits and _ for the rest."""
    plain = LETTERS + LETTERS.upper() + "0123456789+/-="
    return F.regexp_replace(F.translate(value, plain, "a" * 26 + "A" * 26 + "0" * 10 + "____"), "[^aA0]", "_")


def dictionary(docs: DataFrame, most: int = CORPUS_WORDS) -> list[str]:
    """Lower-case words for the dictionary: the built-in ones, and those that most documents hold."""
    words = F.array_distinct(F.split(F.lower(F.col("text").cast("string")), "[^a-z0-9]+"))
    held = docs.select(F.explode(words).alias("word")).where(F.length("word").between(4, 20)).groupBy("word").agg(F.count("*").alias("n"))
    held = held.where((F.col("n") >= HOLDERS) & F.col("word").rlike("^[a-z]+$"))
    top = [r["word"] for r in held.orderBy(F.desc("n"), "word").limit(most).collect()]
    return sorted({*top, *(w for w in DICTIONARY if len(w) > 3)})


def with_features(rows: DataFrame, words: list[str]) -> DataFrame:
    """rows (value, before, after) with the forest's features."""
    v, b, a = F.col("value"), F.col("before"), F.col("after")
    n = F.length(v).cast("double")
    kind = kinds(v)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")

    def share(of: Column, chars: str) -> Column:
        return (n - F.length(F.regexp_replace(of, f"[{chars}]", ""))) / n

    known = F.lit(f" {' '.join(words)} ")
    parts = F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))
    covered = F.aggregate(F.filter(parts, lambda p: F.contains(known, F.concat(F.lit(" "), F.lower(p), F.lit(" ")))), F.lit(0), lambda total, p: total + F.length(p))
    made = {
        "length": F.log2(n),
        "transitions": (F.length(F.regexp_replace(kind, r"(.)\1+", "$1")) - 1) / F.greatest(n - 1, F.lit(1.0)),
        "digits": share(kind, "0"),
        "uppers": share(kind, "A"),
        "symbols": share(kind, "_"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(36.0)),
        "dictionary": covered / n,
        "vowels": share(F.lower(v), "aeiou"),
        "hexadecimal": flag(F.lower(v).rlike("^[0-9a-f]+$")),
        "path": flag(F.instr(v, "/") > 0) + flag(b.rlike(r"[/.]$")) + flag(a.rlike(r"^[/.][a-z]")) + flag(b.rlike(r"://\S*$")),
        "true_words": flag(b.rlike(TRUE_WORDS)),
        "false_words": flag(b.rlike(FALSE_WORDS)),
        "assigned": flag(b.rlike(r"[=:]\s*[\"']?$")),
        "quoted": flag(b.rlike(r"[\"']$") & a.rlike(r"^[\"']")),
        "prefix": flag(v.rlike(PREFIXES)),
        "filler": flag(v.rlike(FILLER)),
        "reference": flag(v.rlike(REFERENCE)),
    }
    return rows.withColumns(made)


def labelled_findings(spark: SparkSession, n: int = GENERATED, seed: int = SEED) -> DataFrame:
    """value, before, after, label: generated findings, alike on every run."""
    i = F.col("id")
    h = lambda k: F.sha2(F.concat_ws("-", F.lit(f"{seed}-{k}"), i.cast("string")), 256)
    pick = lambda k, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(F.xxhash64(i, F.lit(k)), F.lit(len(xs))) + 1).cast("int"))
    base32 = lambda k, m: F.substring(F.translate(F.upper(h(k)), "0189", "GHJK"), 1, m)
    # letters of both cases: every other hex digit pair moved along the alphabet
    mixed = lambda k, m: F.substring(F.translate(F.concat(F.regexp_replace(F.base64(F.unhex(h(k))), "[+/=]", "x"), F.base64(F.unhex(h(f"{k}b")))), "+/=", "yz9"), 1, m)
    prose = pick("p", "and the report of ", "than on ering ", "see the page for ", "le mot de ", "und der Bericht ", "a list of | ")
    sign = pick("s", " = \"", "=", ": ", "=\"", " = '", ": \"", " ")
    true_name = pick("t", "token", "password", "api_key", "secret", "AUTH_TOKEN", "access-key", "TOKEN", "client_secret", "passwd")
    false_name = pick("f", "commit", "sha1", "md5", "checksum", "digest", "uuid", "build", "revision", "order", "invoice", "file hash", "example")
    uuid = F.concat_ws("-", F.substring(h("u"), 1, 8), F.substring(h("u"), 9, 4), F.substring(h("u"), 13, 4), F.substring(h("u"), 17, 4), F.substring(h("u"), 21, 12))
    number = F.concat(pick("n", "4", "5", "7", "9"), F.lpad(F.abs(F.xxhash64(i, F.lit("num"))).cast("string"), 15, "3").substr(1, 15))
    word = lambda k: pick(k, *DICTIONARY[::7])
    cases = [
        (1, F.substring(h(1), 1, 40), F.concat(prose, true_name, sign)),
        (1, F.upper(F.substring(h(2), 1, 40)), F.concat(prose, F.upper(true_name), sign)),
        (1, F.substring(h(3), 1, 18), F.concat(prose, true_name, sign)),
        (1, F.concat(pick("k", "AKIA", "ASIA"), base32(4, 16)), prose),
        (1, F.concat(pick("k", "AKIA", "ASIA"), base32(5, 16)), F.concat(prose, pick("kn", "aws_access_key_id", "key"), sign)),
        (1, mixed(6, 40), F.concat(prose, true_name, sign)),
        (1, F.concat(pick("g", "ghp_", "glpat-", "sk_live_", "xoxb-"), mixed(7, 36)), prose),
        (1, mixed(8, 24), F.concat(prose, true_name, sign)),
        (0, F.substring(h(9), 1, 40), F.concat(prose, false_name, sign)),
        (0, F.substring(h(10), 1, 32), F.concat(prose, false_name, sign)),
        (0, F.substring(h(11), 1, 40), prose),
        (0, uuid, F.concat(prose, pick("un", "", "id ", "uuid: ", "request "))),
        (0, number, F.concat(prose, pick("nn", "", "", "card ", "no. ", "order="))),
        (0, F.concat_ws("/", word("w1"), word("w2"), F.concat(word("w3"), F.substring(h(12), 1, 8))), F.concat(prose, pick("pp", "https://site.example/", "/", "src/"))),
        (0, F.concat_ws("_", word("w4"), word("w5"), word("w6"), F.lit("v12")), F.concat(prose, pick("ww", "", "call ", "id="))),
        (0, F.concat(pick("e", "EXAMPLEKEY", "your-token-here-", "xxxxxxxxxxxxxxxx", "changeme-password-", "0000000000000000"), pick("e2", "1234", "0001", "99")), F.concat(prose, true_name, sign)),
    ]
    # short, letters-only and punctuated values, tokens with dots; words, numbers and references in their place
    letters = lambda k, m: F.substring(F.translate(mixed(k, 40), "0123456789", "QwXyKzJvHb"), 1, m)
    marks = lambda k: pick(k, "!", "@", "#", "$", "%", "^", "&", "*", "?", "~")
    segment = lambda k, m: F.substring(F.concat(mixed(k, 40), mixed(f"{k}c", 40)), 1, m)
    short = F.concat(F.substring(mixed(13, 12), 1, 5), pick("d", "1", "7", "42", "9", "2024"), F.substring(mixed(14, 12), 1, 3), pick("e3", "", "x", "Qz", "pLm4"))
    noun = pick("q", "hunter", "dragon", "monkey", "winter", "falcon", "purple", "Tr0ub4d", "s3cur", "Lakers", "zebra")
    punctuated = F.concat(letters(15, 3), pick("d3", "9", "3", "81"), marks("m1"), mixed(16, 3), marks("m2"), mixed(17, 4), marks("m3"), pick("e4", "", "zR4", "#mN8%"))
    plain = F.concat(word("w7"), pick("w8", "", "", "s", "ing"))
    reference = pick("r", "${DB_PASSWORD}", "$TOKEN", "os.environ[\"KEY\"]", "config.password", "getToken()", "<password>", "********", "None", "null", "{{ secret }}", "process.env.API_KEY", "string", "%PASSWORD%", "settings.token")
    cases += [
        (1, short, F.concat(prose, true_name, sign)),
        (1, F.concat(noun, pick("d4", "1", "2", "77", "123", "99"), pick("q2", "", "", "hunter", "dragon", "er")), F.concat(prose, true_name, sign)),
        (1, letters(18, 22), F.concat(prose, true_name, sign)),
        (1, punctuated, F.concat(prose, true_name, sign)),
        (1, F.concat_ws(".", F.concat(F.lit("eyJ"), segment(19, 33)), F.concat(F.lit("eyJ"), segment(20, 50)), segment(21, 43)), F.concat(prose, pick("jn", "", "", "Bearer ", "token="))),
        (0, plain, F.concat(prose, true_name, sign)),
        (0, F.initcap(plain), F.concat(prose, true_name, sign)),
        (0, F.concat_ws(" ", word("w9"), word("w10"), pick("w11", "", "the user", "for this page")), F.concat(prose, true_name, sign)),
        (0, reference, F.concat(prose, true_name, sign)),
        (0, pick("z", "1", "8", "64", "512", "2048", "3600", "0.5", "10"), F.concat(prose, true_name, sign)),
    ]
    which = F.pmod(i, F.lit(len(cases)))
    chain = F.when(which == 0, F.struct(F.lit(cases[0][0]).alias("label"), cases[0][1].alias("value"), cases[0][2].alias("before")))
    for k, (label, value, before) in enumerate(cases[1:], 1):
        chain = chain.when(which == k, F.struct(F.lit(label).alias("label"), value.alias("value"), before.alias("before")))
    rows = spark.range(0, n, 1, 4).withColumn("c", chain)
    after = F.when(F.col("c.before").rlike("\"$"), F.lit("\" and the")).when(F.col("c.before").rlike("'$"), F.lit("' of")).otherwise(pick("a", " and the", ". Then", "\nthe end", " |"))
    return rows.select("c.value", "c.before", after.alias("after"), F.col("c.label").cast("double").alias("label"))


def assembled(rows: DataFrame, words: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(rows, words))


def train(labelled: DataFrame, words: list[str]) -> RandomForestClassificationModel | float:
    """The forest, from labelled findings (value, before, after, label); the share of secrets where there aren't two labels."""
    rows = labelled.where("value is not null and label is not null").fillna("", ["before", "after"])
    n, true = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < true < n:
        return float(true) / max(n, 1)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, labelCol="label", featuresCol="features")
    return forest.fit(assembled(rows, words).select("features", "label"))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, nth, value, before, after of every candidate of every text."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("text_key")).where(F.col("text").rlike(CANDIDATE))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("rest", F.split("text", CANDIDATE, -1)).drop("text")
    each = F.transform("found", lambda v, k: F.struct(v.alias("value"), F.substring(F.get("rest", k), -BEFORE, BEFORE).alias("before"), F.substring(F.get("rest", k + 1), 1, AFTER).alias("after")))
    return rows.select("doc_id", "text_key", F.posexplode(each).alias("nth", "c")).select("doc_id", "text_key", "nth", "c.value", "c.before", "c.after")


def scored(rows: DataFrame, model: RandomForestClassificationModel | float, words: list[str]) -> DataFrame:
    """rows with score, the forest's probability, and is_secret."""
    keep = rows.columns
    found = rows.withColumn("score", F.lit(model)) if isinstance(model, float) else model.transform(assembled(rows, words)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
    return found.select(*keep, "score", (F.col("score") >= 0.5).alias("is_secret"))


def findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of every text with its score and verdict."""
    words = dictionary(docs)
    # written first: the generated findings are one long expression, which every later step would repeat
    model = train(saved(labelled if labelled is not None else labelled_findings(docs.sparkSession), "labelled"), words)
    return scored(candidates(docs), model, words)


def masked(docs: DataFrame, labelled: DataFrame | None = None, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret in text replaced by the mask; n_chars follows where it exists."""
    text = F.col("text").cast("string")
    own = lambda name: f"__quillon_{name}"
    true = findings(docs, labelled).where("is_secret").groupBy(F.col("doc_id").alias(own("id")), F.col("text_key").alias(own("key"))).agg(F.collect_set("nth").alias(own("bad")))
    has = F.coalesce(text.rlike(CANDIDATE), F.lit(False))
    clean, rest = docs.where(~has), docs.where(has)
    joined = rest.join(true, F.col("doc_id").cast("long").eqNullSafe(F.col(own("id"))) & (F.xxhash64(text) == F.col(own("key"))), "left")
    bad = F.col(own("bad"))
    rebuilt = joined.withColumn(own("between"), F.split(text, CANDIDATE, -1))
    parts = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda v, k: F.concat(F.get(own("between"), k), F.when(F.array_contains(bad, k), F.lit(mask)).otherwise(v)))
    rebuilt = rebuilt.withColumn(own("new"), F.when(bad.isNull(), text).otherwise(F.concat(F.concat_ws("", parts), F.element_at(own("between"), -1))))
    made = {"text": F.col(own("new"))}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(bad.isNull(), F.col("n_chars")).otherwise(F.length(own("new")).cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns).unionByName(rebuilt.select(*(made[c].alias(c) if c in made else F.col(c) for c in docs.columns)))


def digest(docs: DataFrame) -> DataFrame:
    """Every candidate with its verdict."""
    return findings(docs).select("doc_id", "nth", "value", "score", "is_secret")
