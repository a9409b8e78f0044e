"""Quality rules whose cutoffs are chosen on labelled documents under an exact bound on false rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.work import let, small_side, written

BLANK = r"[ \t-\r]+"
#: Scores that a rule may reject for, and the cutoffs among which the labelled documents choose.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_ratio": (0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.5),
    "dup_line_ratio": (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeat_ratio": (0.04, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18),
    "caps_ratio": (0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps")


def _repeat_words(words: Column, n: int) -> Column:
    """Words inside n-word windows that occur twice or more in ``words``."""

    def covered(g: Column) -> Column:
        def hits(s: Column) -> Column:
            same = lambda i, j: F.get(s, i)["g"] == F.get(s, j)["g"]
            at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)))
            return F.sort_array(F.transform(at, lambda i: F.get(s, i)["i"]))

        grown = lambda a, x: F.struct(x.alias("at"), (a["sum"] + F.least(F.lit(n), x - a["at"])).alias("sum"))
        start = F.struct(F.lit(-n).alias("at"), F.lit(0).alias("sum"))
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
        return F.aggregate(let(ordered, hits), start, grown, lambda a: a["sum"])

    each = lambda f: F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: f(F.slice(words, i, n)))
    # Where no two hashes of windows are equal, no two windows are; the others are compared themselves.
    differ = let(each(F.xxhash64), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) < n, F.lit(0)).when(differ, F.lit(0)).otherwise(let(each(lambda w: F.array_join(w, " ")), covered))


def text_features(text: Column) -> Column:
    """A struct of FEATURES of the whole text, as longs; null counts as a text without words."""

    def of(t: Column) -> Column:
        words = F.filter(F.split(t, BLANK, -1), lambda w: w != "")
        lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
        return F.struct(
            let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w, 5).cast("long").alias("n_repeat_words"))).alias("w"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
            F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.regexp_count(t, F.lit(r"[A-Z]")).cast("long").alias("n_caps"),
        )

    flat = lambda s: F.struct(*[(s["w"][f] if f in ("n_words", "word_chars", "n_repeat_words") else s["l"][f] if f in ("n_lines", "n_dup_lines") else s[f]).alias(f) for f in FEATURES])
    return let(let(F.coalesce(text, F.lit("")), of), flat)


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 10) | (f["n_repeat_words"] * 100 > f["n_words"] * 20)


def scores(f: Column) -> dict[str, Column]:
    share = lambda a, b: f[a].cast("double") / F.greatest(f[b], F.lit(1))
    return {"symbol_ratio": share("n_symbols", "word_chars"), "dup_line_ratio": share("n_dup_lines", "n_lines"), "repeat_ratio": share("n_repeat_words", "n_words"), "caps_ratio": share("n_caps", "word_chars")}


def tail_over_level(k: Column, n: Column, alpha: float, level: Column) -> Column:
    """P(Binomial(n, alpha) <= k) / level, exactly summed in logarithms; 1e300 where k >= alpha * n.

    At such k the probability is near a half or more: no certificate needs it.
    """
    ratio = F.log(F.lit(alpha / (1 - alpha)))
    first = n * F.log1p(F.lit(-alpha)) - F.log(level)
    start = F.struct(first.alias("t"), F.exp(first).alias("s"))
    step = lambda a, i: let(a["t"] + F.log((n - i + 1) / i) + ratio, lambda t: F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s")))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * alpha, F.lit(1e300)).otherwise(F.aggregate(terms, start, step, lambda a: a["s"]))


def fit_cutoffs(holdout: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """For each stratum, the lowest certified cutoff of each rule (null: none is certified).

    ``holdout`` has stratum and a struct f of FEATURES of labelled good documents. The cutoffs of a rule
    are tested in a stratum in a fixed sequence, from the mildest down, and the first that fails ends it:
    c is certified if, were its true false-rejection rate over alpha / rules, at most as many good
    documents as were seen above c would be seen with probability at most delta / (strata * rules). That
    is the exact binomial (Clopper-Pearson) bound; the sequence needs no correction for its own length,
    as a wrong certificate in it needs the first wrong one, and strata and rules share delta by
    Bonferroni. So with probability 1 - delta, in all strata at once, at most alpha of the good documents
    are rejected, all rules together. Fewer documents lie above a milder cutoff, so what passes is
    always the mild end of the sequence: the lowest that passes is the cutoff. Strata with too few
    labels reject nothing.
    """
    per_rule = alpha / len(RULES)
    s = scores(F.col("f"))
    seen = holdout.groupBy("stratum").agg(F.count("*").alias("n"), *[F.sum(F.when(s[r] > c, 1).otherwise(0)).alias(f"k_{r}_{i}") for r, cs in RULES.items() for i, c in enumerate(cs)])
    seen = written(seen, "rule-counts")
    level = F.lit(delta / (max(1, seen.count()) * len(RULES)))
    ok = lambda r, i: tail_over_level(F.col(f"k_{r}_{i}"), F.col("n"), per_rule, level) <= 1
    picks = [F.array_min(F.array(*[F.when(ok(r, i), F.lit(c)) for i, c in enumerate(cs)])).alias(f"cut_{r}") for r, cs in RULES.items()]
    return written(seen.select("stratum", "n", *picks), "rule-cutoffs")


def stratum(lang: Column) -> Column:
    return F.coalesce(lang, F.lit(""))


def good_labels(labels: DataFrame) -> DataFrame:
    """Ids of documents that every label of theirs calls good; null ids and null labels don't count."""
    return labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


def _verdict(featured: DataFrame, cutoffs: DataFrame) -> DataFrame:
    s = scores(F.col("f"))
    hit = lambda r: F.coalesce(s[r] > F.col(f"cut_{r}"), F.lit(False))
    cuts = small_side(cutoffs.select(F.col("stratum").alias("__stratum"), *[f"cut_{r}" for r in RULES]), 128)
    out = featured.join(cuts, F.col("stratum") == F.col("__stratum"), "left")
    return out.withColumn("base_failed", base_failed(F.col("f"))).withColumn("rejected_by", F.array_compact(F.array(*[F.when(hit(r), F.lit(r)) for r in RULES])))


def quality_report(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, the base features, base_failed, kept, rejected_by.

    Texts are read once; their features are written, and both the labelled documents and the verdicts
    come from there. Strata are languages (null: one of its own). Null texts have no words and fail
    the base rules; repeated rows count and are judged each; empty tables give an empty result, and
    without labels the base rules alone decide. Other columns of ``docs`` are not read.
    """
    rows = written(docs.select(docs["doc_id"].alias("doc_id"), stratum(docs["lang"]).alias("stratum"), text_features(docs["text"]).alias("f")), "rule-features")
    holdout = rows.join(good_labels(labels), "doc_id", "left_semi").where(~base_failed(F.col("f")))
    out = _verdict(rows, fit_cutoffs(holdout, alpha, delta))
    kept = ~F.col("base_failed") & (F.size("rejected_by") == 0)
    return out.select("doc_id", *[F.col(f"f.{c}").alias(c) for c in FEATURES[:5]], "base_failed", kept.alias("kept"), F.array_join("rejected_by", ",").alias("rejected_by"))


def filter_documents(docs: DataFrame, labels: DataFrame, alpha: float = 0.04, delta: float = 0.05) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns and no others.

    Rows are written with their features, which are computed once; texts are never shuffled.
    """
    rows = written(docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("doc_id"), stratum(docs["lang"]).alias("stratum"), text_features(docs["text"]).alias("f")), "rule-rows")
    holdout = rows.select("doc_id", "stratum", "f").join(good_labels(labels), "doc_id", "left_semi").where(~base_failed(F.col("f")))
    out = _verdict(rows, fit_cutoffs(holdout, alpha, delta))
    return out.where(~F.col("base_failed") & (F.size("rejected_by") == 0)).select("row.*")
