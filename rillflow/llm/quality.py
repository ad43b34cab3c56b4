"""Quality rules with adaptive thresholds, in DataFrame functions only.

Method: instead of fixed cutoffs, a mergeable quantile sketch (Greenwald-Khanna summaries, partially aggregated
before the shuffle, so a source with a third of all rows is no hot group) of each measure for each language and
source. A measure is out of range beyond ``median + reach * (median - low quantile) + slack``: the side of the
distribution that junk does not reach sets the scale, so up to half a group may be junk. Groups of fewer than
``least_rows`` rows use their language's sketch, and small languages that of all rows. The thresholds (a
row for each group) are then joined to the rows, which are filtered.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillflow.llm.common import cut

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """measure: a column of ``measures``; high: whether large values are bad; slack: least distance from the median."""

    measure: str
    high: bool
    slack: float


#: One row in a language and source may lie this far from the median before a rule rejects it.
RULES = (
    Rule("symbols_per_word", True, 0.15),
    Rule("dup_line_share", True, 0.3),
    Rule("upper_share", True, 0.15),
    Rule("word_length", True, 3.0),
    Rule("word_length", False, 2.0),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order."""
    return F.array_remove(F.split(text, SPACES, -1), "")


def _repeated(words: Column, width: int = 8) -> Column:
    """Words that lie in windows found twice or more in the text, by window hashes: O(n log n) in the words."""

    def of_windows(h: Column) -> Column:
        place = F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))

        def of_sorted(p: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return F.coalesce(a["x"] == b["x"], F.lit(False))

            twice = F.filter(p, lambda e, k: same(e, F.get(p, k - 1)) | same(e, F.get(p, k + 1)))

            def covered(at: Column) -> Column:
                own = F.transform(
                    at, lambda v, k: F.least(F.lit(width), F.coalesce(F.get(at, k + 1) - v, F.lit(width)))
                )
                return F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x)

            return let(F.array_sort(F.transform(twice, lambda e: e["i"])), covered)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(
            let(F.array_sort(place), of_sorted)
        )

    def of_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))

        def windows(h: Column) -> Column:
            starts = F.sequence(F.lit(0), F.size(h) - width)
            return F.transform(starts, lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(width))))

        return let(let(hashes, windows), of_windows)

    return F.when(F.size(words) > width, of_words(words)).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, text_col: str = "text", prefix: str = "_m_") -> DataFrame:
    """The rows with one more column, a struct of counts and measures of the whole text. A null text has no words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def times(t: Column, pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)).cast("long")

    def counts(t: Column) -> Column:
        def of_words(w: Column) -> Column:
            lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
            return let(
                lines,
                lambda ls: F.struct(
                    F.size(w).cast("long").alias("n_words"),
                    F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                    times(t, SYMBOL).alias("n_symbols"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                    _repeated(w).alias("n_repeat_words"),
                    F.size(ls).cast("long").alias("n_lines"),
                    times(t, "[A-Z]").alias("n_upper"),
                ),
            )

        return let(words_of(t), of_words)

    return docs.select("*", let(text, counts).alias(prefix))


def measures(m: Column) -> dict[str, Column]:
    def share(a: str, b: str) -> Column:
        return m[a] / F.greatest(m[b], F.lit(1))

    return {
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "upper_share": share("n_upper", "word_chars"),
        "word_length": share("word_chars", "n_words"),
    }


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def thresholds(rows: DataFrame, m: str, keys: tuple[str, str], accuracy: int = 2000) -> DataFrame:
    """Quantile sketches of the measures by language and source, by language, and over all rows.

    Rows that fail the base rules stay out. level: 0 for (language, source), 1 for language, 3 for all.
    """
    values = measures(F.col(m))
    base = rows.where(~base_failed(F.col(m))).select(
        F.col(keys[0]).cast("string").alias("k_lang"), F.col(keys[1]).cast("string").alias("k_source"),
        *(v.alias(k) for k, v in values.items()),
    )
    sketches = [F.percentile_approx(k, [0.1, 0.5, 0.9], accuracy).alias(k) for k in values]
    return base.rollup("k_lang", "k_source").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"), *sketches
    )


def judged(
    measured_rows: DataFrame,
    lang_col: str = "lang",
    source_col: str = "source",
    rules: tuple[Rule, ...] = RULES,
    reach: float = 4.0,
    least_rows: int = 50,
    broadcast_rows: int = 20_000,
    cut_rows: Callable[[DataFrame], DataFrame] = cut,
) -> DataFrame:
    """Rows that carry the struct ``_m_`` (see ``measured``) with ``_base_failed`` and ``_kept`` added.

    kept is false where the base rules fail and else the verdict of the adaptive rules. Null languages
    and sources are groups of their own. Without any row that passes the base rules there is nothing to compare with.
    """
    rows = cut_rows(measured_rows)
    table = cut(thresholds(rows, "_m_", (lang_col, source_col)))
    names = list(measures(F.col("_m_")))
    stats = [F.struct("n", *names)]
    small = table.count() <= broadcast_rows

    def level(which: int, *keys: str) -> DataFrame:
        own = table.where((F.col("level") == which) & (F.col("n") >= least_rows))
        own = own.select(*(F.col(k).alias(f"_{which}_{k}") for k in keys), stats[0].alias(f"_s{which}"))
        return F.broadcast(own) if small else own

    def on(which: int, **keys: str) -> Column:
        parts = [F.col(f"_{which}_{k}").eqNullSafe(F.col(c).cast("string")) for k, c in keys.items()]
        out = parts[0]
        for p in parts[1:]:
            out = out & p
        return out

    found = rows.join(level(0, "k_lang", "k_source"), on(0, k_lang=lang_col, k_source=source_col), "left")
    found = found.join(level(1, "k_lang"), on(1, k_lang=lang_col), "left")
    # one row at most: its few numbers go into the plan
    overall = table.where("level = 3").select("n", *names).first()
    stat = F.coalesce("_s0", "_s1")
    if overall is not None:
        numbers = [F.array(*map(F.lit, overall[c])).alias(c) for c in names]
        stat = F.coalesce(stat, F.struct(F.lit(overall.n).alias("n"), *numbers))
    values = measures(F.col("_m_"))
    bad = F.lit(False)
    for rule in rules:
        q = stat[rule.measure]
        low, mid, high = q[0], q[1], q[2]
        value = values[rule.measure]
        bad = bad | (
            value > mid + reach * (mid - low) + rule.slack if rule.high else value < mid - reach * (high - mid) - rule.slack
        )
    failed = base_failed(F.col("_m_"))
    return found.select(
        *measured_rows.columns, failed.alias("_base_failed"), (~failed & ~F.coalesce(bad, F.lit(False))).alias("_kept")
    )


def quality_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                   source_col: str = "source", **options) -> DataFrame:
    """(doc_id, counts, base_failed, kept) for each row, without carrying the texts any further than the counts."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"),
        F.col(text_col).alias("text"),
    )
    out = judged(measured(rows).drop("text"), **options)
    return out.select("doc_id", "_m_.n_words", "_m_.word_chars", "_m_.n_symbols", "_m_.n_dup_lines", "_m_.n_repeat_words",
                      F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op7_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return quality_counts(docs)
