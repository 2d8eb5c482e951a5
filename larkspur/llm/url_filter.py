"""URL filter: rules, and where none fits the ratio of two character language models, in DataFrame operations only.

The urls that rules allow or block teach a model of accepted and one of rejected urls: variable-order Markov models over a fixed alphabet of
SYMBOLS classes, contexts of up to two symbols, each order smoothed by the one below it (Witten-Bell). A url's score is the
log-likelihood ratio over its length, and the threshold is the one that separates a held-back part of the decided urls best.

A model is a table of SYMBOLS^3 grams, whatever the input; it enters the plan as a constant array, and a url is
scored where it is read, without a shuffle. Scores are sums of integers (2^-16 bit), so they do not depend on any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Each a symbol of its own; all digits are one, all other characters are one, and one stands before the start.
SIGNS = "/.-_?&=#%:"
OTHER = 26 + 1 + len(SIGNS)
START = OTHER + 1
SYMBOLS = START + 1
UNIT = 1 << 16
#: Scores are calibrated in steps of so many units.
STEP = 1 << 10
#: verdict, host and path of each rule.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Of the decided urls those whose md5 begins with one of these digits calibrate, the others teach.
CALIBRATE = ("0", "1", "2")
OUT = ("host", "path", "rule", "verdict", "ratio")


def parsed(df: DataFrame, url_col: str) -> DataFrame:
    """row (a struct of the columns of df), url (null is empty), judged (what follows ://, or the whole url without it), host and path."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url"))
    rows = rows.withColumn("rest", F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit("")))
    rows = rows.withColumn("host", F.regexp_extract("rest", "^[^/?#]*", 0)).withColumn("judged", F.when(F.instr("url", "://") > 0, F.col("rest")).otherwise(F.col("url")))
    path = F.regexp_extract(F.expr("substring(rest, char_length(host) + 1)"), "^[^?#]*", 0)
    return rows.withColumn("path", path).withColumn("host", F.translate("host", UPPER, LOWER)).drop("rest")


def ruled(rows: DataFrame, rules: tuple) -> DataFrame:
    """rows with rule, the longest that fits (or null), and said, its verdict."""
    name, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # the longest is asked last and so wins
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, said = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(verdict)).otherwise(said)
    return rows.withColumn("rule", name).withColumn("said", said)


def symbols(text: Column) -> Column:
    """The symbol of each character, after two starts."""
    known = LOWER + UPPER + "0123456789" + SIGNS
    target = [chr(48 + i) for i in range(26)] * 2 + [chr(48 + 26)] * 10 + [chr(48 + 27 + i) for i in range(len(SIGNS))]
    plain = F.regexp_replace(text, f"[^a-zA-Z0-9{''.join(chr(92) + s for s in SIGNS)}]", " ")
    coded = F.transform(F.split(F.translate(plain, known + " ", "".join(target) + chr(48 + OTHER)), ""), lambda c: F.ascii(c) - 48)
    start = F.array(F.lit(START), F.lit(START))
    return F.when(text == "", start).otherwise(F.concat(start, F.filter(coded, lambda c: c >= 0)))


def grams(codes: Column) -> Column:
    """The gram of each symbol after the starts: it and the two before it, as one number."""

    def of(known: Column) -> Column:
        n = F.size(known)
        at = lambda i: F.get(known, i)
        return F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: (at(i - 2) * SYMBOLS + at(i - 1)) * SYMBOLS + at(i))).otherwise(F.array().cast("array<int>"))

    return F.transform(F.array(codes), of)[0]  # codes are computed once, not for each gram


def smoothed(counts: np.ndarray) -> np.ndarray:
    """The probability of the last symbol of each gram after the first two."""
    below = np.full((1, 1, SYMBOLS), 1 / SYMBOLS)
    for c in (counts.sum((0, 1), keepdims=True), counts.sum(0, keepdims=True), counts):
        total, kinds = c.sum(2, keepdims=True), (c > 0).sum(2, keepdims=True)
        below = np.where(total > 0, (c + kinds * below) / np.maximum(total + kinds, 1), below)
    return np.broadcast_to(below, counts.shape)


def ratios(counted: pd.DataFrame) -> np.ndarray:
    """log2 of accepted over rejected probability of each gram, in units."""
    tables = []
    for verdict in ("allow", "block"):
        part = counted[counted["said"] == verdict]
        flat = np.zeros(SYMBOLS**3)
        flat[part.gram] = part.n
        tables.append(smoothed(flat.reshape(SYMBOLS, SYMBOLS, SYMBOLS)))
    return np.rint(np.log2(tables[0] / tables[1]) * UNIT).astype(np.int64).ravel()


def threshold(bins: pd.DataFrame) -> int:
    """The step from which on to allow: right for the largest sum of shares of both verdicts, the least such step. Without one of the verdicts, 0."""
    both = bins.pivot_table(index="step", columns="said", values="n", aggfunc="sum", fill_value=0).sort_index()
    if not {"allow", "block"} <= set(both.columns):
        return 0
    blocked_below = np.concatenate([[0], np.cumsum(both["block"])]) / both["block"].sum()
    allowed_from = 1 - np.concatenate([[0], np.cumsum(both["allow"])]) / both["allow"].sum()
    edges = [*both.index, both.index[-1] + 1]
    return int(edges[int(np.argmax(np.round(blocked_below + allowed_from, 12)))])


def filter_urls(df: DataFrame, url_col: str = "url", rules: tuple = RULES) -> DataFrame:
    """df with host, path, rule, verdict (allow or block) and ratio (mean log-likelihood ratio in bits; null for an empty url).

    A null url, or one without ://, has an empty host and path. Without :// the models judge the whole url; an empty one, or nothing after ://, is
    allowed, as there is nothing against it. So are all urls without a rule where the rules allow or block none at all. Without decided urls of
    both verdicts among those held back, the threshold is 0: no likelier rejected than accepted. Repeated rows get the same result each;
    urls of any length are read whole. Columns of df that have the names of results are replaced, others kept whatever their names; an empty df gives an empty result.
    """
    rows = ruled(parsed(df, url_col), rules)
    decided = rows.where("said IS NOT NULL").select("said", "judged", F.substring(F.md5("url"), 1, 1).isin(*CALIBRATE).alias("held"))
    counted = decided.where("NOT held").select("said", F.explode(grams(symbols(F.col("judged")))).alias("gram")).groupBy("said", "gram").agg(F.count("*").alias("n")).toPandas()  # 2 * SYMBOLS^3 rows at most
    teaches = {"allow", "block"} <= set(counted["said"])
    table = ratios(counted) if teaches else np.zeros(SYMBOLS**3, np.int64)
    known = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")  # folded into one constant
    total = F.aggregate(grams(symbols(F.col("judged"))), F.lit(0).cast("long"), lambda s, g: s + F.get(known, g))
    step = F.floor(total / F.char_length("judged") / STEP).cast("long")
    bins = decided.where("held AND judged <> ''").select("said", step.alias("step")).groupBy("said", "step").agg(F.count("*").alias("n")).toPandas()  # the scores' range in steps
    least = threshold(bins) if len(bins) else 0
    scored = rows.withColumn("ratio", F.when(F.col("judged") != "", total / F.char_length("judged") / UNIT))
    by_model = F.when(F.floor(F.col("ratio") * (UNIT / STEP)) >= least, "allow").when(F.col("ratio").isNull(), "allow").otherwise("block")
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c.lower() not in OUT]
    return scored.select(*kept, "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), "ratio")
