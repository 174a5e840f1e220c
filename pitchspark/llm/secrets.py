"""Secret scans (4): candidates filtered by a random forest trained on labelled findings. DataFrame and Spark ML functions only."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spans import find, let

KEY = "[A-Za-z0-9+/=_-]"
#: A run of 16 key characters with further parts behind dots, or a whole private key block. Runs are entered at their start.
CANDIDATE = (
    rf"(?<!{KEY}){KEY}{{16,}}+(?:\.[A-Za-z0-9_-]{{8,}}+)*+"
    r"|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,40}PRIVATE KEY-----"
)
#: What a text must hold in lower case for ``HELD`` to find anything.
MARKS = ["key", "token", "secret", "passw", "pwd", "credential", "auth", "://"]
#: A value of any length and characters behind a credential's name, quoted or up to white space, and the password in a URL.
HEAD = (
    r"(?:(?i:key|token|secret|passw|pwd|credential|auth)[A-Za-z0-9_-]{0,64}+[\"']?\s{0,8}[:=]{1,3}\s{0,8}"
    r"|[A-Za-z][A-Za-z0-9+.-]{0,31}://[^\s/:@]{0,256}:(?=[^\s/@]{1,256}@))"
)
HELD = HEAD + r"(?:\"[^\"\n]+|'[^'\n]+|`[^`\n]+|(?<=://[^\s/:@]{0,256}:)[^\s/@]+|[^\s\"'`]+)"
URL = r"://[^\s/:@]*:$"
CUE = r"(?i)(?:key|token|secret|passw|pwd|credential|auth|bearer|api)"
#: Words beside digests and numbers that are no secrets.
HARMLESS = r"(?i)(?:commit|revision|sha-?\d*|md5|checksum|digest|hash|etag|uuid|guid|version|build|isbn|order|serial)"
#: Texts that findings are planted in (a bound), trees and their depth.
PLANTED_ROWS, TREES, DEPTH, SEED = 600, 20, 8, 7
FEATURES = ["n", "transitions", "digits", "uppers", "distinct", "coverage", "slashes", "joints", "in_url", "in_path", "cue", "harmless", "assigned", "quoted"]


def dictionary(docs: DataFrame) -> str:
    """A bit for each of 26**3 letter triples: whether it is at least as frequent in the words of all texts as by chance."""
    words = docs.select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    counts = words.groupBy("w").agg(F.count("*").alias("n"))
    # letters first: a place in an array is found at once, one in a very long word is not
    three = lambda own: F.transform(F.sequence(F.lit(0), F.length("w") - 3), lambda i: F.concat(*[F.get(own, i + k) for k in range(3)]))
    triple = let(F.split("w", ""), three)
    rows = counts.select("n", F.explode(triple).alias("t")).groupBy("t").agg(F.sum("n").alias("n")).collect()
    letters, total = string.ascii_lowercase, sum(r.n for r in rows)
    have = {r.t for r in rows if r.n * len(letters) ** 3 >= total}
    return "".join("1" if a + b + c in have else "0" for a in letters for b in letters for c in letters)


def _coverage(value: Column, bits: str) -> Column:
    """Share of the letter triples of a candidate that the dictionary has."""
    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(-1)

    def share(codes: Column) -> Column:
        def known(i: Column) -> Column:
            a, b, c = F.get(codes, i), F.get(codes, i + 1), F.get(codes, i + 2)
            return F.when((a >= 0) & (b >= 0) & (c >= 0), F.get(F.split(F.lit(bits), ""), (a * 26 + b) * 26 + c).cast("int")).otherwise(0)

        all_known = F.aggregate(F.transform(F.sequence(F.lit(0), F.size(codes) - 3), known), F.lit(0), lambda s, x: s + x) / (F.size(codes) - 2)
        return F.when(F.size(codes) >= 3, all_known).otherwise(0.0)

    return let(F.transform(F.split(F.lower(value), ""), code), share)


def _held(text: Column) -> Column:
    """Spans as ``find`` gives them of the values that ``HELD`` finds, less those that are whole runs of key characters."""
    marked = reduce(Column.__or__, [F.contains(F.lower(text), F.lit(m)) for m in MARKS])
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    def span(x: Column) -> Column:
        head = F.regexp_extract(x["value"], "^" + HEAD.replace("(?=[^\\s/@]{1,256}@)", "") + "[\"'`]?", 0)
        bare = ~head.rlike("[\"'`]$") & ~head.rlike(URL)
        value = F.substring(x["value"], F.length(head) + 1, F.length(x["value"]))
        value = F.when(bare, F.regexp_replace(value, r"[,;.)\]}]+$", "")).otherwise(value)
        start = x["start"] + F.length(head)
        return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(F.concat(x["before"], head), F.lit(48)).alias("before"), x["after"].alias("after"))

    run = lambda x: x["value"].rlike(f"^(?:{CANDIDATE})$") & ~x["before"].rlike(f"{KEY}$") & ~x["after"].rlike(f"^{KEY}")
    found = F.when(marked, find(text, HELD)).otherwise(none)
    return F.filter(F.transform(found, span), lambda x: (F.length(x["value"]) > 0) & ~run(x))


def candidates(docs: DataFrame, bits: str, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns ``keys``, start, end, value and FEATURES of every span that ``CANDIDATE`` or ``HELD`` finds."""
    text = F.coalesce("text", F.lit(""))
    found = docs.select(*keys, F.explode(F.concat(find(text, CANDIDATE), _held(text))).alias("s")).select(*keys, "s.*")
    n = F.length("value")
    share = lambda chars: F.regexp_count("value", F.lit(chars)) / n
    flag = lambda c, pattern: F.col(c).rlike(pattern).cast("double")
    transitions = F.regexp_count("value", F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])")) / n
    return found.select(
        *keys,
        "start",
        "end",
        "value",
        n.cast("double").alias("n"),
        transitions.alias("transitions"),
        share("[0-9]").alias("digits"),
        share("[A-Z]").alias("uppers"),
        (F.size(F.array_distinct(F.split("value", ""))) / n).alias("distinct"),
        _coverage(F.col("value"), bits).alias("coverage"),
        share("/").alias("slashes"),
        share("[_.-]").alias("joints"),
        flag("before", r"://\S*$").alias("in_url"),
        (flag("before", r"[/\\\\]$") + flag("after", r"^(?:[/\\\\]|\.[a-z]{1,4}\b)")).alias("in_path"),
        flag("before", CUE).alias("cue"),
        (flag("before", HARMLESS + r"\W{0,4}(?:\S*\s)?\W*$")).alias("harmless"),
        flag("before", r"[:=]\s*[\"'`]?$").alias("assigned"),
        flag("before", r"[\"'`]$").alias("quoted"),
    )


#: How findings are planted: fixed words of a kind before its values.
NAMED = ['token = "', 'api_key: "', "secret=", "Authorization: Bearer ", 'password = "', "auth_token: "]
PLAIN = ["", '"', "(", "value ", "= ", "is: "]
DIGESTS = ["commit ", "sha1 ", "md5: ", "checksum = ", 'etag="', "revision "]
STAND_INS = ["your_token_here", "changeme_changeme", "xxxxxxxxxxxxxxxx", "example_key_value", "replace_with_own_secret"]
PREFIXES = ["sk_live_", "ghp_", "AKIA", "xoxb-", "glpat-"]


def planted(docs: DataFrame, rows: int = PLANTED_ROWS, seed: int = SEED) -> DataFrame:
    """text, value, label, named: values of known kinds planted among words of about ``rows`` of ``docs``, a row each.

    Labels come from how a value was made, never from what stands around it. Secrets (1): hexadecimal and base-64
    strings, keys with a prefix, dotted tokens and passwords, half of them without a credential's name. Others (0):
    identifiers, long words, paths and addresses made of the text's own words, digests, identifiers and numbers behind
    their names, and stand-ins, of which some stand behind a credential's name.
    """
    h = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    some = docs.where(F.pmod(h, F.lit(max(1, docs.count() // rows))) == 0).select(h.alias("h"), "text").orderBy("h").limit(rows)
    spare = F.array(*map(F.lit, "some words stand here where texts have none of their own to plant".split()))
    words = F.filter(F.concat(F.split(F.coalesce("text", F.lit("")), "[^A-Za-z]+"), spare), lambda w: F.length(w) > 2)
    some = some.select("h", words.alias("w")).withColumn("w", F.slice("w", F.pmod("h", F.greatest(F.size("w") - 11, F.lit(1))).cast("int") + 1, F.lit(12)))
    some = some.select("h", "w", F.explode(F.sequence(F.lit(0), F.lit(16))).alias("kind"))
    some = some.withColumn("r", F.sha2(F.concat_ws(":", "h", "kind", F.lit(seed)).cast("binary"), 512))
    some = some.withColumns({"b": F.base64(F.unhex("r")), "pick": F.pmod(F.xxhash64("r"), F.lit(1 << 20)).cast("int")})
    some = some.withColumn("a", F.regexp_replace("b", "[^A-Za-z0-9]", ""))
    one = lambda values: F.get(F.array(*map(F.lit, values)), F.pmod("pick", F.lit(len(values))))
    cut = lambda c, at, n: F.substring(F.col(c), F.lit(at), F.lit(n) if isinstance(n, int) else n)
    own = F.slice("w", 1, F.col("pick") % 3 + 3)
    digits = F.translate("r", "abcdef", "012345")
    values = [
        cut("r", 1, 40), cut("r", 9, 32), cut("b", 1, F.col("pick") % 40 + 24), F.concat(one(PREFIXES), cut("a", 1, 24)),
        F.concat(F.lit("eyJ"), cut("a", 1, 17), F.lit("."), cut("a", 20, 30), F.lit("."), cut("b", 50, 27)), F.upper(cut("r", 1, 40)),
        F.concat(cut("a", 1, F.col("pick") % 7 + 4), one(list("!@#%&*?")), cut("a", 30, 3)),
        F.lower(F.array_join(own, "_")), F.array_join(F.transform(own, lambda x: F.initcap(x)), ""), F.lower(F.array_join(own, "")), F.array_join(own, "/"),
        F.lower(F.array_join(F.slice("w", 1, 4), "-")), cut("r", 1, 40), cut("r", 9, 32),
        F.concat_ws("-", cut("r", 1, 8), cut("r", 9, 4), cut("r", 13, 4), cut("r", 17, 4), cut("r", 21, 12)), F.substring(digits, F.lit(1), F.col("pick") % 5 + 16), one(STAND_INS),
    ]
    some = some.withColumn("value", F.get(F.array(*values), F.col("kind")))
    named = F.when(F.col("kind") == 6, True).when(F.col("kind") < 6, F.col("pick") % 16 < 8).when(F.col("kind") == 16, F.col("pick") % 16 < 12).otherwise((F.col("pick") % 16 < 3) & ~F.col("kind").isin(12, 13, 14))
    head = F.when(named, one(NAMED)).when(F.col("kind").isin(12, 13, 14), one(DIGESTS)).when(F.col("kind") == 11, F.concat(F.lit("https://"), F.lower(F.element_at("w", 6)), F.lit(".com/"))).otherwise(one(PLAIN))
    tail = F.when(head.endswith('"'), F.lit('"')).when(head.endswith("("), F.lit(")")).otherwise(F.lit(""))
    side = lambda at: F.array_join(F.slice("w", at, F.lit(3)), " ")
    text = F.concat(side(F.lit(7)), F.lit(" "), head, F.col("value"), tail, F.lit(" "), side(F.lit(10)))
    return some.select(text.alias("text"), "value", (F.col("kind") < 7).cast("double").alias("label"), named.alias("named"))


def labelled_findings(findings: DataFrame, bits: str) -> DataFrame:
    """The candidates that are the labelled ``value`` of their text, with label and FEATURES."""
    found = candidates(findings.withColumnRenamed("value", "labelled"), bits, ("labelled", "label", *[c for c in ("named",) if c in findings.columns]))
    return found.where("value = labelled").drop("labelled")


def train(findings: DataFrame) -> PipelineModel:
    """The forest over ``FEATURES`` of labelled findings."""
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="x"), forest]).fit(findings)


def scored(model: PipelineModel, found: DataFrame) -> DataFrame:
    """``found`` with its score, the forest's share of votes for a secret."""
    return model.transform(found).withColumn("score", vector_to_array("probability")[1])


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, value_sha256, score, is_secret for every candidate in ``docs``.

    A candidate is a private key block, a run of 16 or more of A-Z a-z 0-9 + / = _ - with further parts behind dots, a
    value of any length behind a credential's name (quoted, or up to white space), or the password in a URL.
    ``findings`` are labelled texts (text, value, label 0 or 1); by default ``planted`` ones. The forest sees length,
    character transitions, dictionary coverage, path and neighbouring words; the dictionary is all words of ``docs``.

    Null or empty texts have no candidates; very long ones are searched within their row. Null ids stay null; repeated
    rows repeat theirs. An empty table gives an empty result. Other columns are ignored. Offsets are code points, end
    exclusive.
    """
    bits = dictionary(docs)
    found = stored(candidates(docs.select(F.col("doc_id").cast("long"), "text"), bits), "candidates")
    known = stored(labelled_findings(planted(docs) if findings is None else findings, bits), "findings")
    if found.isEmpty():
        rows = found.withColumn("score", F.lit(0.0))
    elif known.select("label").distinct().count() < 2:
        raise ValueError("findings of both labels are needed")
    else:
        rows = scored(train(known), found)
    return rows.select("doc_id", "start", "end", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), (F.col("score") >= 0.5).alias("is_secret"))
