"""PII (8): base patterns, and further spans by weak supervision. DataFrame and Spark ML functions only."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, on_row, row_key, small, stored
from .spans import find, let

BASE = ["email", "ip", "card", "phone"]
ADDED = ["email_masked", "phone_local", "ssn", "iban", "name", "address", "card_like", "ip_like", "phone_like", "name_known"]
KINDS = BASE + ADDED
#: Kinds whose labelers are weighed together: base spans show what sure ones look like, near misses what others do.
FAMILIES = {"email_masked": "email", "phone_local": "phone", "phone_like": "phone", "card_like": "card", "ip_like": "ip", "name_known": "name"}
#: Near misses: what a base kind's pattern finds and its test fails.
NEAR = {"card_like": "card", "ip_like": "ip", "phone_like": "phone"}
# Runs are entered at their start, or where the last match ended: what the plain patterns find, in linear time.
# A card's digits are at least 14: shorter ones would fail, and no part of them could pass.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "email_masked": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]++)++",
    "phone_local": r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<=\b(?:Mr|Mrs|Ms|Dr|Prof|Dear|Name|name|Contact|Frau|Herr|Señora?|Madame|Monsieur)[.:]{0,1} )\p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+){0,2}+",
    "address": r"(?<![A-Za-z0-9])[0-9]{1,5}(?: \p{Lu}\p{Ll}{1,30}){1,3}?(?<= (?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Square|Court|Way))\b",
}
#: Characters that a text must hold for a kind's pattern to run.
NEEDS = {
    "email": "@", "phone": r"\+", "email_masked": r"(?i)[\[(]at[\])]", "address": r"[0-9] \p{Lu}",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof|Dear|Name|name|Contact|Frau|Herr|Señora?|Madame|Monsieur)[.:]? \p{Lu}",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
CUES = {
    "email": "mail|contact|write|address",
    "ip": "ip|host|server|addr|login",
    "card": "card|visa|master|amex|credit|pay",
    "phone": "phone|tel|call|fax|mobile|contact",
    "email_masked": "mail|contact|write|address",
    "phone_local": "phone|tel|call|fax|mobile|contact",
    "ssn": "ssn|social|security|tax",
    "iban": "iban|account|bank|transfer",
    "name": "name|contact|dear|signed|born|lives|mail|call",
    "address": "address|lives?|live at|home|deliver|ship|visit",
}
CUES |= {near: CUES[kind] for near, kind in NEAR.items()} | {"name_known": CUES["name"]}
AGAINST = "version|order|invoice|serial|isbn|build|figure|table"
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "co", "uk", "de", "fr", "es", "it", "nl", "eu", "info", "biz", "us", "ca", "au", "ch", "at"]
#: First digits of card issuers, from and to, with their numbers' lengths; and of international calling codes.
ISSUERS = [
    ("2221", "2720", [16]), ("300", "305", [14]), ("34", "34", [15]), ("3528", "3589", [16]), ("36", "36", [14]), ("37", "37", [15]), ("38", "39", [14]),
    ("4", "4", [16, 19]), ("50", "50", [16, 19]), ("51", "55", [16]), ("56", "58", [16, 19]), ("6011", "6011", [16, 19]), ("62", "62", [16, 17, 18, 19]),
    ("644", "649", [16, 19]), ("65", "65", [16, 19]),
]
CALLING = [
    ("1", "1"), ("20", "20"), ("211", "269"), ("27", "27"), ("290", "299"), ("30", "34"), ("350", "359"), ("36", "36"), ("370", "389"), ("39", "41"),
    ("420", "423"), ("43", "49"), ("500", "509"), ("51", "58"), ("590", "599"), ("60", "66"), ("670", "692"), ("7", "7"), ("81", "82"), ("84", "84"),
    ("850", "856"), ("86", "86"), ("880", "886"), ("90", "95"), ("960", "979"), ("98", "98"), ("992", "998"),
]
COUNTRIES = ["DE", "FR", "ES", "GB", "IT", "NL", "BE", "AT", "CH", "IE", "PT", "LU", "DK", "SE", "NO", "FI", "PL", "CZ"]
VOTES = ["form", "gazetteer", "context", "edges"]
EM_ROUNDS, ACCEPT = 50, 0.5
#: How often the check of a family that has one says -1, 0 and 1 of personal spans, and of others: true numbers are seldom
#: mistyped, and a tenth of all numbers passes by chance. What is known of a labeler is not estimated.
CHECKED = {family: ((0.02, 0.01, 0.97), (0.89, 0.01, 0.1)) for family in NEAR.values()}
#: Of other numbers one in 97 passes for an account's, and most do for a social security number, of which few can't be one.
CHECKED |= {"iban": ((0.02, 0.01, 0.97), (0.98, 0.01, 0.01)), "ssn": ((0.005, 0.005, 0.99), (0.12, 0.01, 0.87))}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{PART}(?:\.{PART}){{3}}$")
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _mod97(value: Column) -> Column:
    """Whether an IBAN's check digits fit: letters are numbers from 10 on, the first four characters come last."""
    bare = F.replace(value, F.lit(" "))
    turned = F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.left(bare, F.lit(4)))

    def step(rest: Column, c: Column) -> Column:
        n = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (rest * F.when(n > 9, 100).otherwise(10) + n) % 97

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _begins(digits: Column, ranges: list[tuple]) -> Column:
    """Whether digits begin within one of the ranges, and have one of its lengths where it names some."""
    ok = F.lit(False)
    for low, high, *lengths in ranges:
        own = F.left(digits, F.lit(len(low))).between(low, high)
        ok = ok | (own & F.length(digits).isin(lengths[0]) if lengths else own)
    return ok


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column) -> Column:
    """What the labelers say of a candidate: 1 personal, -1 not, 0 nothing."""
    value, d = s["value"], _digits(s["value"])
    last = F.lower(F.regexp_extract(value, r"([A-Za-z]+)$", 1))
    like = NEAR.get(kind, kind)
    never = F.lit(False)
    form, gazetteer = {
        "email": (_vote(F.length(value) <= 254, F.lit(True)), _vote(last.isin(DOMAINS), last == "")),
        "ip": (_vote(_passes("ip", value), F.lit(True)), _vote(never, value.rlike(r"^0*(?:0|127|22[4-9]|2[3-5][0-9])\."))),
        "card": (_vote(F.lit(kind == "card"), F.lit(True)), _vote(_begins(d, ISSUERS), F.lit(True))),
        "phone": (_vote(F.lit(kind == "phone"), ~F.length(d).between(7, 15)), _vote(_begins(d, CALLING), F.lit(True))),
        "email_masked": (_vote(last != "", F.lit(True)), _vote(last.isin(DOMAINS), last == "")),
        "phone_local": (_vote(d.rlike("^[2-9][0-9]{2}[2-9]"), F.lit(True)), _vote(never, d.rlike("^(.)\\1+$"))),
        "ssn": (_vote(~d.rlike("^(?:000|666|9)|^...00|0000$"), F.lit(True)), F.lit(0)),
        "iban": (_vote(_mod97(value), F.lit(True)), _vote(F.left(value, F.lit(2)).isin(COUNTRIES), F.lit(True))),
        "name": (_vote(value.contains(" "), never), F.lit(0)),
        "name_known": (_vote(value.contains(" "), never), F.lit(1)),
        "address": (_vote(value.rlike(r"^[1-9]"), F.lit(True)), F.lit(0)),
    }[like]
    context = _vote(s["before"].rlike(rf"(?i)\b(?:{CUES[kind]})"), s["before"].rlike(rf"(?i)\b(?:{AGAINST})\b"))
    edges = _vote(s["before"].rlike(r"(?:^|[\s\"'(<>:,;=])$") & s["after"].rlike(r"^(?:$|[\s\"')<>:,;.!?])"), s["before"].rlike("[A-Za-z0-9]$") | s["after"].rlike("^[A-Za-z0-9]"))
    return F.array(form.cast("int"), gazetteer.cast("int"), context.cast("int"), edges.cast("int"))


def _shape(value: Column) -> Column:
    """What the classifier sees of the span itself: classes of its length and of its share of digits."""
    size = F.length(value)
    return F.array(F.least(F.floor(size / 8), F.lit(4)).cast("int"), F.floor(F.regexp_count(value, F.lit("[0-9]")) * 3 / F.greatest(size, F.lit(1))).cast("int"))


#: Hash buckets of the words next to a span, and one for none.
NEXT = 32


def _around(s: Column) -> Column:
    """The last word before the span and the first one after it, as buckets."""
    bucket = lambda w: F.when(w == "", NEXT).otherwise(F.pmod(F.xxhash64(F.lower(w)), F.lit(NEXT))).cast("int")
    return F.array(bucket(F.regexp_extract(s["before"], r"(\p{L}+)[^\p{L}]*$", 1)), bucket(F.regexp_extract(s["after"], r"^[^\p{L}]*(\p{L}+)", 1)))


def _span(kind: str, s: Column) -> Column:
    rank = F.lit(KINDS.index(kind)).alias("kind")
    word = F.when(F.lit(kind in LEARNED), s["value"]).alias("word")
    size = F.length(s["value"]).alias("n")
    return F.struct(s["start"].alias("start"), rank, s["end"].alias("end"), size, _votes(kind, s).alias("votes"), _shape(s["value"]).alias("shape"), _around(s).alias("around"), word)


def tagged(docs: DataFrame) -> DataFrame:
    """The row's key, base, more: the base spans, and the further candidates that overlap none of them, with their votes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string,after:string>>")

    matches = docs.select(*row_key(), *[F.when(text.rlike(NEEDS.get(k, "[0-9]")), find(text, PATTERNS[k])).otherwise(none).alias(k) for k in PATTERNS])

    def spans(kind: str) -> Column:
        like = NEAR.get(kind, kind)
        own = F.col(like)
        if like in NEAR.values():
            own = F.filter(own, lambda s: _passes(like, s["value"]) == (kind == like))
        return F.transform(own, lambda s: _span(kind, s))

    more = [k for k in ADDED if k in PATTERNS or k in NEAR]
    found = matches.select(*ROW, F.sort_array(F.concat(*map(spans, BASE))).alias("base"), F.sort_array(F.concat(*map(spans, more))).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    # of candidates that overlap the first stays
    first = F.filter("more", lambda m, i: (i == 0) | ~F.exists(F.slice("more", 1, i), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return found.withColumn("more", apart).withColumn("more", first)


#: Kinds whose gazetteer is learned: a span that is found in so many documents is known.
LEARNED, KNOWN_DOCS = ("name", "address"), 2


def learned(found: DataFrame) -> DataFrame:
    """kind, word: names and addresses that candidates of several different texts hold; a copy of a text adds nothing."""
    words = found.select("_text", "_more", F.explode("more").alias("m")).where("m.word is not null").select("_text", "_more", F.col("m.kind").alias("kind"), F.col("m.word").alias("word")).distinct()
    return words.groupBy("kind", "word").agg(F.count("*").alias("n")).where(F.col("n") >= KNOWN_DOCS).select("kind", "word")


def with_gazetteer(found: DataFrame, known: DataFrame) -> DataFrame:
    """``found`` with votes for names and addresses that are ``known``."""
    words = found.select("row", F.explode("more").alias("m")).where("m.word is not null").select("row", F.col("m.kind").alias("kind"), F.col("m.word").alias("word")).distinct()
    hits = words.join(known, ["kind", "word"]).groupBy("row").agg(F.collect_set(F.struct("kind", "word")).alias("known"))
    out = found.join(hits, "row", "left")
    votes = lambda m: F.when(F.array_contains("known", F.struct(m["kind"].alias("kind"), m["word"].alias("word"))), F.transform(m["votes"], lambda v, i: F.when(i == 1, 1).otherwise(v))).otherwise(m["votes"])
    voted = F.transform("more", lambda m: m.withField("votes", votes(m)))
    return out.withColumn("more", F.when(F.col("known").isNotNull(), voted).otherwise(F.col("more"))).drop("known")


RUN = r"(?<!\p{L})\p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+)++(?!\p{L})"


def known_names(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The row's key and spans: known names of two and three words wherever a text has them, without a form of address too."""
    names = known.where((F.col("kind") == KINDS.index("name")) & F.contains("word", F.lit(" "))).select("word")
    text = F.coalesce(F.col("text"), F.lit(""))

    def windows(run: Column) -> Column:
        words = F.split(run["value"], " ")

        def at(i: Column, n: int) -> Column:
            before, value = F.array_join(F.slice(words, F.lit(1), i), " "), F.array_join(F.slice(words, i + 1, F.lit(n)), " ")
            start = run["start"] + F.length(before) + F.when(i > 0, 1).otherwise(0)
            left, right = F.concat(run["before"], F.left(run["value"], start - run["start"])), F.concat(F.substring(run["value"], start - run["start"] + F.length(value) + 1, F.length(run["value"])), run["after"])
            return F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(left, F.lit(48)).alias("before"), F.left(right, F.lit(48)).alias("after"))

        return F.flatten(F.array(*[F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: i + n <= F.size(words)), lambda i: at(i, n)) for n in (2, 3)]))

    runs = docs.where(text.rlike(RUN)).select(*row_key(), F.explode(find(text, RUN)).alias("run"))
    spans = runs.select(*ROW, F.explode(windows(F.col("run"))).alias("s")).join(names.withColumnRenamed("word", "name"), F.col("s.value") == F.col("name"), "left_semi")
    spans = spans.select(*ROW, _span("name_known", F.col("s")).alias("s")).distinct()
    # of names that overlap the first stays, and the longer of two that begin together
    order = F.array_sort(F.collect_list("s"), lambda x, y: F.when(x["start"] != y["start"], F.signum((x["start"] - y["start"]).cast("double"))).otherwise(F.signum((y["end"] - x["end"]).cast("double"))).cast("int"))
    rows = spans.groupBy(*ROW).agg(order.alias("s"))
    return rows.select(*ROW, F.filter("s", lambda m, i: (i == 0) | ~F.exists(F.slice("s", 1, i), lambda b: m["start"] < b["end"])).alias("names"))


def reliabilities(votes: np.ndarray, n: np.ndarray, check: tuple | None = None) -> np.ndarray:
    """P(personal) of each vote pattern by expectation-maximisation; ``n`` says how often a pattern occurs.

    Labelers are independent given the truth, with a rate of each vote for either truth. ``check``: the rates of the
    first labeler, for spans and for others, where they are known.
    """
    p = np.clip(0.5 + votes.sum(1) / (2.2 * votes.shape[1]), 0.05, 0.95)
    for _ in range(EM_ROUNDS):
        share = (n * p).sum() / n.sum()
        log = np.stack([np.full(len(n), np.log(share)), np.full(len(n), np.log1p(-share))])
        for j in range(votes.shape[1]):
            for t, weight in enumerate((n * p, n * (1 - p))):
                if check and j == 0:
                    log[t] += np.log(np.array(check[t]))[votes[:, j] + 1]
                    continue
                rate = np.array([(weight * (votes[:, j] == v)).sum() + (0.5 if v * (1 - 2 * t) >= 0 else 0.1) for v in (-1, 0, 1)])
                log[t] += np.log(rate / rate.sum())[votes[:, j] + 1]
        p = np.clip(1 / (1 + np.exp(log[1] - log[0])), 1e-6, 1 - 1e-6)
    return p


#: One feature for each vote of each labeler on each kind, as labelers err differently on each, for the kind, for the span's
#: shape, and for the words next to it.
N_FEATURES = len(KINDS) * (3 * len(VOTES) + 1) + 9 + 2 * (NEXT + 1)


def _active(kind: Column, votes: Column, shape: Column, around: Column) -> Column:
    """The numbers of a span's features; all others are 0."""
    cast = [((kind * len(VOTES) + j) * 3 + F.get(votes, F.lit(j)) + 1).cast("int") for j in range(len(VOTES))]
    rest = 3 * len(VOTES) * len(KINDS)
    words = [F.get(around, F.lit(j)) + rest + len(KINDS) + 9 + j * (NEXT + 1) for j in range(2)]
    return F.array(*cast, (kind + rest).cast("int"), F.get(shape, F.lit(0)) + rest + len(KINDS), F.get(shape, F.lit(1)) + rest + len(KINDS) + 5, *words)


def train(candidates: DataFrame) -> tuple[float, list[float]] | None:
    """Intercept and weights of the span classifier from (kind, votes, shape, around) of all candidates.

    Of kinds and votes there are at most 14 * 3**4 patterns, whatever the input: ``reliabilities`` labels those of each
    family of kinds on the driver. With shapes and words around, all of them counted, they train a logistic regression,
    each weighted by how often it occurs and by how likely either label is.
    """
    counts = stored(candidates.groupBy("kind", "votes", "shape", "around").agg(F.count("*").alias("n")), "patterns")
    rows = counts.groupBy("kind", "votes").agg(F.sum("n").alias("n")).orderBy("kind", "votes").collect()
    if not rows:
        return None
    family = [FAMILIES.get(KINDS[r.kind], KINDS[r.kind]) for r in rows]
    p = np.zeros(len(rows))
    for name in set(family):
        own = np.array([f == name for f in family])
        p[own] = reliabilities(np.array([r.votes for r in rows])[own], np.array([float(r.n) for r in rows])[own], CHECKED.get(name))
    name = lambda kind, votes: ":".join(map(str, [kind, *votes]))
    known = F.create_map(*[F.lit(x) for r, q in zip(rows, p, strict=True) for x in (name(r.kind, r.votes), float(q))])
    q = known[F.concat_ws(":", F.col("kind").cast("string"), F.col("votes").cast("array<string>"))]
    either = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), (F.col("n") * q).alias("w")), F.struct(F.lit(0.0).alias("label"), (F.col("n") * (1 - q)).alias("w"))))
    active = _active(F.col("kind"), F.col("votes"), F.col("shape"), F.col("around"))
    one_hot = F.transform(F.sequence(F.lit(0), F.lit(N_FEATURES - 1)), lambda i: F.array_contains(active, i).cast("double"))
    data = counts.select(either.alias("e"), array_to_vector(one_hot).alias("features")).select("e.*", "features")
    model = LogisticRegression(regParam=0.001, weightCol="w").fit(data)
    return float(model.intercept), [float(x) for x in model.coefficients]


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans for every row of ``docs``.

    Base spans (email, ip, card, phone) always stay. Candidates that overlap none are masked e-mails, local phone
    numbers, social security numbers, IBANs, names behind a form of address, street addresses, near misses of base
    kinds, and names that candidates of several texts hold, wherever they stand: regex, gazetteer (issuers, calling codes,
    domains, countries, learned names and addresses) and context labelers vote on base spans and candidates alike,
    expectation-maximisation weighs them family by family, and a classifier trained on the result, which sees the words
    around too, admits candidates. A near miss has failed its kind's check, so it also needs a cue before it. Offsets
    are code points, end exclusive.

    A null or empty text has no spans: counts 0 and the hash of the empty string. Very long texts are searched within
    their row. Null ids stay null; repeated rows are scanned each. An empty table gives an empty result. Other columns
    are ignored.
    """
    found = stored(tagged(docs).withColumn("row", F.monotonically_increasing_id()), "spans")
    known = stored(learned(found), "known")
    found = with_gazetteer(found, small(known))
    if not known.isEmpty():
        names = stored(known_names(docs, small(known)), "names")
        found = on_row(found, small(names), "left")
        free = F.filter("names", lambda m: ~F.exists(F.concat("base", "more"), lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        found = found.withColumn("more", F.when(F.col("names").isNotNull(), F.sort_array(F.concat("more", free))).otherwise(F.col("more"))).drop("names")
    found = stored(found, "voted")
    model = train(found.select(F.explode(F.concat("base", "more")).alias("s")).select("s.kind", "s.votes", "s.shape", "s.around"))
    if model is None:
        admitted = F.col("more")
    else:
        weights = F.array(*map(F.lit, model[1]))
        score = lambda m: F.aggregate(_active(m["kind"], m["votes"], m["shape"], m["around"]), F.lit(model[0]), lambda total, i: total + F.get(weights, i))
        sure = lambda m: ~m["kind"].isin([KINDS.index(k) for k in NEAR]) | (F.get(m["votes"], F.lit(VOTES.index("context"))) > 0)
        admitted = F.filter("more", lambda m: sure(m) & (score(m) >= float(np.log(ACCEPT / (1 - ACCEPT)))))
    names = F.array(*map(F.lit, KINDS))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    every = found.withColumn("every", F.sort_array(F.concat(F.col("base"), admitted)))
    return every.select(F.col("_doc").alias("doc_id"), *map(count, BASE), F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))
