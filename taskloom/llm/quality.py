"""Quality rules as one projection compiled from a threshold table (operator 9).

``RULES`` is data: a rule names a ratio or count, a lower and an upper bound and the number of words from
which it applies. ``compile_rules`` turns the table into one boolean column; with the measures it makes one
projection over the scan, with neither a shuffle nor a user function.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, SPACES, lower_ascii, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5

#: Common function words of the corpus' languages (English, French, German, Spanish). Fixed values. Texts of 50 words or more in
#: other languages have none of them and fail the rule ``stop_words``; for those, give words of their own, or rules without that one.
STOP_WORDS = (
    "a an and are as at be by for from has in is it not of on or that the this to was were with "
    "au aux ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une "
    "als auf aus bei das dem den der des die ein eine im ist mit nicht und von war zu zur "
    "al con del el en es la las lo los no o para por que se su un una y"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    low: float | None
    high: float | None
    from_words: int = 0


#: A document is kept if every measure lies within its bounds (a rule below ``from_words`` words passes).
RULES = (
    Rule("length", "n_words", 10, 1_000_000),
    Rule("mean_word", "word_chars / n_words", 2.0, 20.0),
    Rule("symbols", "n_symbols / n_words", None, 0.25),
    Rule("stop_words", "n_stop_words / n_words", 0.02, None, 50),
    Rule("duplicate_lines", "n_dup_lines / n_lines", None, 0.3),
    Rule("repeats", "n_repeat_words / n_words", None, 0.2),
)


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> dict[str, Column]:
    """The measures of a text as columns, null being an empty text.

    Repeats: the hashes of all windows of five words are sorted with their positions; those with an equal
    neighbour are found twice or more, and each covers five words or as many as the next one leaves it. Sorting
    keeps this near linear in the words of a document, whatever repeats in it."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, f"{SPACE_CLASS}+"), lambda w: w != "")
    letters = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def repeated(h: Column) -> Column:
        n = F.size(h) - (WINDOW - 1)
        windows = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.xxhash64(*[F.get(h, i - 1 + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))
        ordered = F.transform(F.array(F.array_sort(windows)), lambda s: F.sort_array(F.transform(
            F.filter(F.transform(s, lambda x, i: F.struct(x["i"].alias("i"), ((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])).alias("twice"))), lambda x: F.coalesce(x["twice"], F.lit(False))),
            lambda x: x["i"])))[0]
        covered = F.transform(F.array(ordered), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x))[0]
        return F.when(n > 1, covered).otherwise(F.lit(0).cast("long"))

    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(letters).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(words, lambda w: lower_ascii(w).isin(*stop_words))).cast("long"),
        "n_repeat_words": F.transform(F.array(hashed), repeated)[0].cast("long"),
    }


def _passes(rule: Rule) -> Column:
    top, _, below = rule.measure.partition(" / ")
    value = F.col(top).cast("double")
    if below:  # without a denominator the measure counts as 0
        value = F.when(F.col(below) > 0, value / F.col(below)).otherwise(F.lit(0.0))
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (value >= rule.low)
    if rule.high is not None:
        ok = ok & (value <= rule.high)
    return ok | (F.col("n_words") < rule.from_words) if rule.from_words else ok


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(all rules pass, names of those that fail) over the columns of ``measures``."""
    every = F.lit(True)
    for r in rules:
        every = every & _passes(r)
    failed = F.filter(F.array(*[F.when(~_passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return every, failed


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """One row per row of ``docs``: id_col, the measures, base_failed, kept, failed_rules.

    base_failed: fewer than 10 words, or over 20 of 100 words in repeated windows; such a document is not kept.
    Null and empty texts have no words. Repeated rows are judged alike; other columns are not read; an empty table gives
    no rows. ``stop_words`` are in lower case."""
    rows = docs.select(F.col(id_col).alias("__id"), *[c.alias(k) for k, c in measures(F.col(text_col), stop_words).items()])
    every, failed = compile_rules(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & every).alias("kept"), "n_lines", "n_stop_words", F.array_join(failed, ",").alias("failed_rules"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def _sql_rule(r: Rule) -> str:
    top, _, below = r.measure.partition(" / ")
    value = f"CASE WHEN {below} > 0 THEN {top}::DOUBLE / {below} ELSE 0.0 END" if below else f"{top}::DOUBLE"
    ok = " AND ".join([f"({value}) >= {r.low}"] * (r.low is not None) + [f"({value}) <= {r.high}"] * (r.high is not None))
    return f"({ok} OR n_words < {r.from_words})" if r.from_words else f"({ok})"


_BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP9_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: translate(x, {_BLANK}, '') <> '') AS ls, text FROM t),
g AS (SELECT doc_id, p.i AS i, concat_ws(' ', ws[p.i], ws[p.i + 1], ws[p.i + 2], ws[p.i + 3], ws[p.i + 4]) AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5) p),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
r AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM c WHERE n >= 2),
k AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS n_repeat_words FROM r GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(text, {_BLANK}, ''))::BIGINT AS word_chars,
             (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(k.n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(ls)::BIGINT AS n_lines,
             len(list_filter(ws, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN k ON w.doc_id = k.doc_id),
b AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND {" AND ".join(map(_sql_rule, RULES))}) AS kept, n_lines, n_stop_words,
       concat_ws(',', {", ".join(f"CASE WHEN NOT {_sql_rule(r)} THEN '{r.name}' END" for r in RULES)}) AS failed_rules
FROM b
"""
