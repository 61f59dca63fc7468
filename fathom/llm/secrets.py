"""Secrets in text: three fixed patterns, and strings that look drawn at random.

Two character Markov models, of random strings and of ordinary identifiers, are trained from labelled
samples: counts of neighbouring characters, smoothed and divided by row. A string's log-likelihood ratio
is the sum, over its neighbouring characters, of the logarithm of one model's probability over the
other's. Long strings whose ratio is high, in all and per character, are reported.

Everything is DataFrame functions; no Python runs on rows. The model is an array of fixed size (one number
for each pair of the alphabet), and no row leaves its partition but the counts of the training sample.
"""

from __future__ import annotations

import json
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the base rules.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 6, 20, 24

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"
SAMPLE_ROWS = 2000
RANDOM_STRINGS = 4000
PER_PAIR = 0.35
IN_ALL = 14.0
#: Identifiers that stand in ordinary text and code, labelled by hand; words of the corpus join them.
IDENTIFIERS = (
    "getElementById addEventListener XMLHttpRequest toLowerCase hasOwnProperty parseInt isNullOrEmpty StringBuilder"
    " ArrayIndexOutOfBoundsException NullPointerException application_settings max_retry_count default_timeout_seconds"
    " user_id created_at updated_at is_active first_name last_name email_address phone_number date_of_birth"
    " MAX_BUFFER_SIZE DEFAULT_ENCODING CONTENT_TYPE HTTP_STATUS_CODE ENABLE_FEATURE_FLAG LOG_LEVEL ENVIRONMENT"
    " config/settings/production usr/local/share/documents src/main/java/com/example/service index-page-header"
    " btn-primary-large nav-item-active main-content-wrapper sidebar-widget-title article-body-text footer-links"
    " self-contained state-of-the-art well-known long-term decision-making user-friendly up-to-date"
    " internationalization responsibilities telecommunications characteristically misunderstanding"
    " Donaudampfschifffahrt Geschwindigkeitsbegrenzung anticonstitutionnellement electroencefalografista"
    " version-1-2-3 release_2024_01 chapter12 section3 figure4a table_10 iso8601 utf8 base64 sha256 md5sum x86_64"
    " thread_pool_executor connection_timeout_ms num_partitions read_only write_ahead_log primary_key foreign_key"
    " calculateTotalPrice validateUserInput handleFormSubmit onButtonClick renderTemplate loadConfiguration"
).split()


def matched(text: Column, pattern: str, group: int = 0) -> Column:
    """All leftmost matches that do not overlap: start, end (code points) and the text of a group.

    What lies between matches gives their places; the running place is carried along.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    wanted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    pairs = F.arrays_zip(
        F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length).alias("gap"),
        F.transform(whole, F.length).alias("size"),
        wanted.alias("value"),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + pair["gap"]
        one = F.struct(begin.alias("start"), (begin + pair["size"]).alias("end"), pair["value"].alias("value"))
        return F.struct((begin + pair["size"]).alias("at"), F.concat(state["found"], F.array(one)).alias("found"))

    return F.aggregate(pairs, start, step, lambda state: state["found"])


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the three base rules, by kind, in order.

    A run of hex digits or of an access key is as long as it can be, so asking for the least length
    in the pattern finds the same runs; an assignment's value is matched first and measured then.
    """
    access = ACCESS.replace("+", f"{{{ACCESS_LENGTH - 4},}}")
    hexes = HEX.replace("+", f"{{{HEX_LENGTH},}}")
    assign = F.filter(matched(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_LENGTH)
    return {
        "assign": F.when(text.rlike(ASSIGN), assign).otherwise(_none()),
        "access": F.when(F.contains(text, F.lit("AKIA")) & text.rlike(access), matched(text, access)).otherwise(_none()),
        "hex": F.when(text.rlike(hexes), matched(text, hexes)).otherwise(_none()),
    }


def pairs_of(string: Column) -> Column:
    """Numbers of a string's neighbouring characters in the table of pairs."""
    size = len(ALPHABET)
    codes = F.transform(F.regexp_extract_all(string, F.lit("."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    ahead = F.slice(codes, F.lit(2), F.greatest(F.size(codes) - 1, F.lit(0)))
    behind = F.slice(codes, F.lit(1), F.greatest(F.size(codes) - 1, F.lit(0)))
    return F.zip_with(behind, ahead, lambda a, b: a * size + b)


def labelled_samples(docs: DataFrame, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``string``, ``random``: words of ``sample_rows`` texts (those with the smallest hashes) without what the
    base rules find, also in capitals, the identifiers above and runs of one character; and, random, strings
    made from digests in four usual writings."""
    spark = docs.sparkSession
    chosen = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t")).withColumn("h", F.xxhash64("t"))
    few = max(1, docs.count() // (4 * sample_rows))
    chosen = chosen.where(F.pmod("h", F.lit(few)) == 0).orderBy("h").limit(sample_rows)
    clean = F.col("t")
    for pattern in (ASSIGN, ACCESS, rf"{HEX[:-1]}{{{HEX_LENGTH},}}"):
        clean = F.regexp_replace(clean, pattern, " ")
    words = chosen.select(F.explode(F.regexp_extract_all(clean, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("string"))
    plain = [(i,) for i in IDENTIFIERS * 50] + [(c * 100,) for c in ALPHABET for _ in range(5)]
    ordinary = words.union(words.select(F.upper("string"))).union(spark.createDataFrame(plain, "string string"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), r"\s", "")
    drawn = spark.range(RANDOM_STRINGS).select(
        F.explode(
            F.array(
                digest,
                base64,
                F.regexp_replace(F.upper(base64), "[^A-Z0-9]", ""),
                F.regexp_replace(base64, "[^A-Za-z0-9]", ""),
            )
        ).alias("string")
    )
    return ordinary.withColumn("random", F.lit(False)).union(drawn.withColumn("random", F.lit(True)))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all pairs of characters; pairs are smoothed by one count."""
    counts = samples.select("random", F.explode(pairs_of(F.col("string"))).alias("pair")).groupBy("random", "pair").count()
    size = len(ALPHABET)
    models = {kind: [1.0] * size**2 for kind in (True, False)}
    for row in counts.where("pair >= 0").collect():  # two models of fixed size
        models[row["random"]][row["pair"]] += row["count"]
    for kind, model in models.items():
        for a in range(size):
            total = sum(model[a * size : (a + 1) * size])
            model[a * size : (a + 1) * size] = [x / total for x in model[a * size : (a + 1) * size]]
    return [log(p / q) for p, q in zip(models[True], models[False])]


def ratio(string: Column, model: list[float]) -> Column:
    """A string's log-likelihood ratio, positive if it looks random."""
    table = F.from_json(F.lit(json.dumps(model)), "array<double>")
    return F.aggregate(pairs_of(string), F.lit(0.0), lambda total, pair: total + F.get(table, pair))


def find_secrets(docs: DataFrame, model: list[float], text: str = "text", per_pair: float = PER_PAIR, in_all: float = IN_ALL):
    """``docs`` with ``assign``, ``access``, ``hex`` and ``random``: arrays of spans (start, end, value).

    A random span overlaps none of the base spans and mixes two of small letters, capitals and digits. Null is the empty text, which has none. Columns of
    these names are replaced. An empty table gives an empty table.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumns(base_spans(whole))
    taken = F.concat("assign", "access", "hex")

    def suspect(span: Column) -> Column:
        score = ratio(span["value"], model)
        classes = [F.when(span["value"].rlike(c), 1).otherwise(0) for c in ("[a-z]", "[A-Z]", "[0-9]")]
        free = (classes[0] + classes[1] + classes[2] >= 2) & ~F.exists(taken, lambda t: (t["start"] < span["end"]) & (span["start"] < t["end"]))
        return free & (score >= in_all) & (score >= per_pair * (F.length(span["value"]) - 1))

    strings = F.when(whole.rlike(CANDIDATE), matched(whole, CANDIDATE)).otherwise(_none())
    return found.withColumn("random", F.filter(strings, suspect))


def span_list(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans by start, then in the order of ``kinds``, joined by commas."""
    def tagged(number: int, kind: str) -> Column:
        said = lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("said")
        return F.transform(F.col(kind), lambda s: F.struct(s["start"], F.lit(number).alias("number"), said(s)))

    spans = [tagged(k, kind) for k, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*spans)), lambda s: s["said"]), ",")
