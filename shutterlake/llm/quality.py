"""Quality rules with risk-controlled cutoffs (operator 10), DataFrame functions only.

Each document has counts of its words, symbols, repeated lines and repeated
words. Two fixed base rules reject at once. Every further rule rejects a document
whose share, in whole percent, lies above the cutoff of its stratum. A cutoff is
taken only if labelled good documents prove it: with k of n good documents above
it, the exact binomial tail P(X <= k | n, risk) has to stay below the allowed
error. The cutoffs of a rule are tested from the mildest on and their tails only
grow, so one rule in one stratum spends its error once; the error is divided by
rules x strata (Bonferroni), the risk by rules. So, with probability 1 - ERROR,
fewer than RISK of the good documents of any stratum are rejected by the cutoffs.
A stratum with too few labels gets no cutoff and keeps what the base rules keep.

Defined results: a null text has no words and fails the base rules; a null
stratum is a stratum of its own; repeated rows are judged each; of several labels
for a document the lowest counts; a label that is null or of no document counts
for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.text import SPACE, UPPER, table, whole, words
from shutterlake.session import materialize

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

#: Largest share of good documents that the cutoffs of one stratum may reject.
RISK = 0.02
#: Probability with which that promise may fail for any stratum.
ERROR = 0.05

#: Rules: name, count above, count below; the share is 100 * above / below.
RULES = (
    ("symbols", "n_symbols", "word_chars"),
    ("dup_lines", "n_dup_lines", "n_lines"),
    ("repeat_words", "n_repeat_words", "n_words"),
    ("capitals", "n_capitals", "word_chars"),
    ("bangs", "n_bangs", "n_words"),
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_bangs")


def _windows(w: str) -> Column:
    """A 64-bit hash for each window of three words."""
    n = F.size(w)
    return F.when(
        n >= 3,
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, counts): each input row as a struct, beside its counts (COUNTS).

    Only a text in which some window of three words occurs again sorts its
    windows, so that equal ones become neighbours. Nothing is shuffled.
    """
    t = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), whole(docs[text]).alias("t"))
    t = t.select("row", "t", words(F.col("t")).alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    t = t.select("row", "t", "w", lines.alias("lines"), _windows("w").alias("h"))
    t = t.select("*", (F.size(F.array_distinct("h")) < F.size("h")).alias("again"))
    pairs = F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    t = t.withColumn("s", F.when(F.col("again"), pairs))
    last = F.size("s") - 1
    hit = F.filter(
        F.sequence(F.lit(0), last),
        lambda j: ((j > 0) & (F.get("s", j - 1)["h"] == F.get("s", j)["h"]))
        | ((j < last) & (F.get("s", j + 1)["h"] == F.get("s", j)["h"])),
    )
    t = t.withColumn("at", F.when(F.col("again"), F.transform(hit, lambda j: F.get("s", j)["i"])))
    covered = F.flatten(F.transform("at", lambda i: F.array(i, i + 1, i + 2)))

    def count(cls: str) -> Column:
        return F.regexp_count("t", F.lit(f"[{cls}]")).cast("long")

    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("again"), F.size(F.array_distinct(covered))).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        count(UPPER).alias("n_capitals"),
        count("!").alias("n_bangs"),
    )
    # Exploding one struct keeps the planner from copying these expressions into
    # every filter and projection above, where they would be computed again.
    return t.select("row", F.explode(F.array(counts)).alias("counts"))


def base_failed(c: str = "counts") -> Column:
    n, r = F.col(c)["n_words"], F.col(c)["n_repeat_words"]
    return (n < MIN_WORDS) | (r * 100 > n * MAX_REPEAT_PERCENT)


def percent(above: str, below: str, c: str = "counts") -> Column:
    """Whole percent, rounded down, at most 100; 0 for nothing of nothing."""
    a, b = F.col(c)[above], F.col(c)[below]
    return F.when(b > 0, F.least(F.floor(a * 100 / b), F.lit(100))).otherwise(0).cast("int")


def _log_tail(k: Column, n: Column, p: float) -> Column:
    """log P(X <= k) for X ~ Binomial(n, p), summed in logarithms."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("t"), (n * F.log(F.lit(1 - p))).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        t = acc["t"] + F.log((n - i + 1) / i) + odds
        return F.struct(
            t.alias("t"),
            (F.greatest(acc["s"], t) + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s"),
        )

    some = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(some, start, step)["s"]


def fit_cutoffs(
    counted: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    stratum: str = "lang",
    risk: float = RISK,
    error: float = ERROR,
) -> DataFrame:
    """One row per stratum: `stratum`, and a cutoff in percent (or null) per rule.

    Holdout: the documents labelled good (quality 1) that pass the base rules.
    They are counted per stratum, rule and percent, so a stratum of any size
    becomes at most 101 rows before the shuffle. Written out, as it is read for
    all documents.
    """
    good = labels.groupBy(labels["doc_id"].alias("id")).agg(F.min(labels["quality"]).alias("q"))
    seen = (
        counted.where(~base_failed())
        .select(
            F.col("row")[doc_id].alias("id"),
            F.col("row")[stratum].alias("stratum"),
            *[percent(a, b).alias(r) for r, a, b in RULES],
        )
        .join(good.where(F.col("q") == 1), "id")
    )
    cells = (
        seen.select(
            "stratum",
            F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("pct")) for r, _, _ in RULES])).alias("x"),
        )
        .groupBy("stratum", "x.rule", "x.pct")
        .count()
        .groupBy("stratum", "rule")
        .agg(
            F.sum("count").alias("n"),
            F.map_from_entries(F.collect_list(F.struct("pct", "count"))).alias("at"),
        )
    )
    cells = materialize(cells)  # at most rules x strata rows
    tests = max(1, cells.count())
    p = risk / len(RULES)
    above = cells.select(
        "stratum", "rule", "n", "at", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("cut")
    ).select(
        "stratum", "rule", "n", "cut",
        F.aggregate(
            F.map_entries("at"),
            F.lit(0).cast("long"),
            lambda acc, e: acc + F.when(e["key"] > F.col("cut"), e["value"]).otherwise(0),
        ).alias("k"),
    )
    # Beyond its mean the tail exceeds any error asked for, so k stays below n * p.
    passed = above.where(
        F.when(F.col("k") <= F.col("n") * p, _log_tail(F.col("k"), F.col("n").cast("double"), p) <= F.log(F.lit(error / tests))).otherwise(False)
    )
    return materialize(
        passed.groupBy("stratum").agg(*[F.min(F.when(F.col("rule") == r, F.col("cut"))).alias(r) for r, _, _ in RULES])
    )


def judge(counted: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(row, counts, base_failed, rule, kept); `rule` names the first cutoff that rejected.

    `cutoffs` is a written table with a row per stratum, so Spark broadcasts it
    when it is small and splits hot strata when it is not.
    """
    cut = cutoffs.select(F.col("stratum").alias("_s"), F.struct(*[r for r, _, _ in RULES]).alias("cut"))
    joined = counted.join(cut, F.col("row")[stratum].eqNullSafe(F.col("_s")), "left")
    broken = F.coalesce(*[F.when(percent(a, b) > F.col("cut")[r], F.lit(r)) for r, a, b in RULES])
    out = joined.select("row", "counts", base_failed().alias("base_failed"), F.when(~base_failed(), broken).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    Counts are what costs here, so the cutoffs are fitted on the labelled
    documents alone: no other counts for them.
    """
    ids = labels.select(labels["doc_id"].alias("_label")).distinct()
    labelled = docs.join(ids, docs["doc_id"] == ids["_label"], "left_semi").select("doc_id", "text", "lang")
    cutoffs = fit_cutoffs(with_counts(labelled), labels)
    kept = judge(with_counts(docs), cutoffs).where("kept")
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    counted = with_counts(docs).select(F.struct("row.doc_id", "row.lang").alias("row"), "counts")
    counted = materialize(counted)
    out = judge(counted, fit_cutoffs(counted, table(spark, folder, "labels")))
    return out.select(
        "row.doc_id", *[F.col("counts")[c].alias(c) for c in COUNTS], "base_failed", "rule", "kept"
    )


_PCT = "\n    UNION ALL ".join(
    f"SELECT doc_id, lang, '{r}' AS rule, CASE WHEN {b} > 0 THEN least(({a} * 100) // {b}, 100) ELSE 0 END AS pct FROM counts WHERE NOT base_failed"
    for r, a, b in RULES
)
SQL = rf"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^{SPACE}]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM t),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
counts AS (
  SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} AS base_failed FROM (
    SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(covered.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
      (length(t) - length(translate(t, '{UPPER}', '')))::BIGINT AS n_capitals,
      (length(t) - length(translate(t, '!', '')))::BIGINT AS n_bangs
    FROM w LEFT JOIN covered ON w.doc_id = covered.doc_id)),
pct AS (
    {_PCT}),
good AS (SELECT pct.* FROM pct JOIN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1) USING (doc_id)),
cells AS (SELECT lang, rule, count(*) AS n, list(pct) AS pcts FROM good GROUP BY lang, rule),
above AS (SELECT lang, rule, n, cut, len(list_filter(pcts, lambda x: x > cut)) AS k
          FROM (SELECT *, unnest(range(0, 100)) AS cut FROM cells)),
logs AS (SELECT *, list_transform(range(0, k + 1), lambda i: lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1)
            + i * ln({RISK / len(RULES)!r}) + (n - i) * ln(1 - {RISK / len(RULES)!r})) AS x
         FROM above WHERE k <= n * {RISK / len(RULES)!r}),
cutoff AS (SELECT lang, rule, min(cut) AS cut FROM logs
           WHERE list_max(x) + ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x)))))
             <= ln({ERROR} / greatest(1, (SELECT count(*) FROM cells)))
           GROUP BY lang, rule),
broken AS (SELECT p.doc_id, p.rule, {" ".join(f"CASE p.rule WHEN '{r}' THEN {i} ELSE 0 END +" for i, (r, _, _) in enumerate(RULES))} 0 AS place
           FROM pct p JOIN cutoff c ON p.lang IS NOT DISTINCT FROM c.lang AND p.rule = c.rule AND p.pct > c.cut),
firsts AS (SELECT doc_id, arg_min(rule, place) AS rule FROM broken GROUP BY doc_id)
SELECT c.doc_id, {", ".join("c." + x for x in COUNTS)}, c.base_failed, f.rule, NOT c.base_failed AND f.rule IS NULL AS kept
FROM counts c LEFT JOIN firsts f ON c.doc_id = f.doc_id
"""
