"""Weakly supervised quality rules, with built-in functions only.

Each rule votes good (1) or bad (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns (3 ** rules at most, whatever the
table's size) estimates how often each rule votes either way on good and on bad documents, and the share of good ones, taking the votes as
independent given the truth. A document is kept if it passes the base limits and its posterior probability of being good is at
least one half. Good votes never count against a document, bad ones never for it, abstentions not at all.

Texts are read once, for a table of counts and votes. One job adds up its vote patterns (a few rows a task are shuffled), the next looks the
posterior up in a broadcast of those patterns.

Defined results: a null text is an empty one; without words all counts are 0, base_failed is true and every rule abstains; the posterior of a
pattern without votes is the share of good documents; repeated rows count each; very long texts are read whole; other columns are not read, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.llm.lineage import materialize

ROUNDS = 20
#: First guesses for documents with and without a bad vote; bound of one vote's log evidence.
WITH_BAD, WITHOUT_BAD, MOST = 0.2, 0.9, 4.0
# Frequent function words of English, German, French and Spanish.
STOPWORDS = "the of and to in a is that it for was on are as with be by der die das und ist in den von zu mit sich auf nicht ein eine im le la les de des et est un une dans que pour en qui el los las y que se con por una no su para es".split()
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column) -> Column:
    """Words that lie in a 3-word window which occurs twice or more in the text."""
    windows = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ranked, lambda s: F.filter(F.transform(s, lambda x, k: F.when((x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]), x["i"])), lambda i: i.isNotNull()))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    return let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, and what else the rules look at."""
    text = F.coalesce("text", F.lit(""))
    split = docs.select("doc_id", text.alias("text"), F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0)).alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"))
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?:;][\x20\x09-\x0D]*$"))).cast("long").alias("n_ended"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOPWORDS))).cast("long").alias("n_stopwords"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"),
    )


#: Rules as SQL: when good, when bad; anything else abstains. Shares are compared as whole numbers.
RULES = {
    "word_length": ("word_chars BETWEEN 3 * n_words AND 9 * n_words", "word_chars > 12 * n_words OR word_chars < 2 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    "duplicate_lines": ("n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    "repetition": ("20 * n_repeat_words <= n_words", "5 * n_repeat_words > n_words"),
    "stopwords": ("100 * n_stopwords >= 6 * n_words", "100 * n_stopwords < 2 * n_words"),
    "line_ends": ("2 * n_ended >= n_lines", "10 * n_ended < n_lines"),
    "variety": ("100 * n_distinct >= 25 * n_words", "100 * n_distinct < 15 * n_words"),
}


def vote(rule: str) -> str:
    good, bad = RULES[rule]
    return f"CASE WHEN n_words = 0 THEN 0 WHEN {good} THEN 1 WHEN {bad} THEN -1 ELSE 0 END"


def posteriors(patterns: DataFrame) -> DataFrame:
    """votes and quality (posterior probability) of each pattern in ``patterns`` (votes, n); all rounds are one expression over one row."""
    table = F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n"))))
    total = lambda rows, of: F.aggregate(rows, F.lit(0.0), lambda s, r: s + of(r))

    def quality(p: Column, state: Column) -> Column:
        evidence = F.aggregate(F.zip_with(p["votes"], state["evidence"], lambda v, e: F.when(v > 0, e["good"]).when(v < 0, e["bad"]).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        return 1 / (1 + F.exp(-(F.log(state["share"] / (1 - state["share"])) + evidence)))

    def maximise(rows: Column) -> Column:
        good, bad = total(rows, lambda r: r["n"] * r["q"]), total(rows, lambda r: r["n"] * (1 - r["q"]))

        def weight(j: Column, sign: int, sums: Column) -> Column:
            cast = lambda r: F.get(r["votes"], j) == sign
            on_good, on_bad = total(rows, lambda r: F.when(cast(r), r["n"] * r["q"]).otherwise(F.lit(0.0))), total(rows, lambda r: F.when(cast(r), r["n"] * (1 - r["q"])).otherwise(F.lit(0.0)))
            return F.log((on_good + 1) / (sums["good"] + 3)) - F.log((on_bad + 1) / (sums["bad"] + 3))

        def fitted(sums: Column) -> Column:
            votes = F.transform(F.sequence(F.lit(0), F.lit(len(RULES) - 1)), lambda j: F.struct(F.greatest(F.lit(0.0), F.least(F.lit(MOST), weight(j, 1, sums))).alias("good"), F.least(F.lit(0.0), F.greatest(F.lit(-MOST), weight(j, -1, sums))).alias("bad")))
            return F.struct(votes.alias("evidence"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), sums["good"] / (sums["good"] + sums["bad"]))).alias("share"))

        return let(F.struct(good.alias("good"), bad.alias("bad")), fitted)

    rated = lambda q: F.transform("table", lambda p: F.struct(p["votes"].alias("votes"), p["n"].alias("n"), q(p).alias("q")))
    guess = rated(lambda p: F.when(F.exists(p["votes"], lambda v: v < 0), F.lit(WITH_BAD)).otherwise(F.lit(WITHOUT_BAD)))
    step = lambda state, _: let(rated(lambda p: quality(p, state)), maximise)
    fitted = patterns.agg(table.alias("table")).where(F.size("table") > 0).withColumn("state", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), let(guess, maximise), step))
    return fitted.select(F.explode("table").alias("p"), "state").select(F.col("p.votes").alias("votes"), quality(F.col("p"), F.col("state")).alias("quality"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (rounded to 3 places) and kept of every document."""
    voted = materialize(measures(docs).withColumn("votes", F.array(*(F.expr(vote(r)).cast("int") for r in RULES))))
    known = posteriors(voted.groupBy("votes").agg(F.count("*").alias("n")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.join(F.broadcast(known), "votes").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), F.round("quality", 3).alias("quality"), (~failed & (F.col("quality") >= 0.5)).alias("kept"))


def sql() -> str:
    """The same in DuckDB; the rounds are unrolled."""
    names = list(RULES)
    words = ", ".join(f"'{w}'" for w in dict.fromkeys(STOPWORDS))
    n = range(len(names))
    q = "1 / (1 + exp(-(ln(share / (1 - share))" + "".join(f" + CASE WHEN v{i} > 0 THEN g{i} WHEN v{i} < 0 THEN b{i} ELSE 0 END" for i in n) + ")))"
    guess = f"CASE WHEN least({', '.join(f'v{i}' for i in n)}) < 0 THEN {WITH_BAD} ELSE {WITHOUT_BAD} END"
    weight = lambda i, sign: f"ln((sum(CASE WHEN v{i} = {sign} THEN n * q ELSE 0 END) + 1) / (sum(n * q) + 3)) - ln((sum(CASE WHEN v{i} = {sign} THEN n * (1 - q) ELSE 0 END) + 1) / (sum(n * (1 - q)) + 3))"
    fit = ", ".join(f"greatest(0, least({MOST}, {weight(i, 1)})) AS g{i}, least(0, greatest(-{MOST}, {weight(i, -1)})) AS b{i}" for i in n)
    rounds = []
    for k in range(ROUNDS + 1):
        source = f"(SELECT p.*, {q} AS q FROM p, e{k - 1})" if k else f"(SELECT *, CAST({guess} AS DOUBLE) AS q FROM p)"
        rounds.append(f"e{k} AS MATERIALIZED (SELECT greatest(0.01, least(0.99, sum(n * q) / sum(n))) AS share, {fit} FROM {source})")
    votes = ", ".join(f"{vote(r)} AS v{i}" for i, r in enumerate(names))
    keys = ", ".join(f"v{i}" for i in range(len(names)))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM documents),
g AS (SELECT id, pos, w[pos:pos + 2] AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS pos FROM d)),
r AS (SELECT id, count(DISTINCT pos) AS n FROM (SELECT id, pos + unnest([0, 1, 2]) AS pos FROM (SELECT id, pos, count(*) OVER (PARTITION BY id, g) AS c FROM g) WHERE c > 1) GROUP BY id),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(l, lambda x: regexp_matches(x, '[.!?:;][\x20\x09-\x0D]*$'))) AS n_ended,
    len(list_filter(w, lambda x: lower(x) IN ({words}))) AS n_stopwords, len(list_distinct(w)) AS n_distinct FROM d LEFT JOIN r USING (id)),
v AS MATERIALIZED (SELECT *, {votes}, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
p AS MATERIALIZED (SELECT {keys}, count(*) AS n FROM v GROUP BY {keys}),
{", ".join(rounds)},
k AS (SELECT {keys}, {q} AS quality FROM p, e{ROUNDS})
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
    CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, round(quality, 3) AS quality, NOT base_failed AND quality >= 0.5 AS kept
FROM v JOIN k USING ({keys})
"""
