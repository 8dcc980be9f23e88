"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule has a condition that rejects a document and an expression of its cost (units of work
that a row takes). Both are averaged over a sample of rows; rules then run in the order of
rejections per unit of cost, and a row that one rule has rejected is not shown to the later ones.
The order decides how much work is done, never which documents are kept.

Defined results: a null or blank text has no words and fails the base rules; repeated rows are
judged alike, each on its own; an empty table gives an empty result; columns whose names clash
with the measures are overwritten in the result of ``measure``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import let, query, table, words

SAMPLE_ROWS = 2_000  # rows, about, that costs and rejections are estimated on
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Column
    cost: Column


def covered_words(ws: Column) -> Column:
    """Words that lie in a window of five words which occurs twice or more in the text.

    Windows are compared by their 64-bit hash. Only texts with a repeated window sort theirs.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 5),
        lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(5)]),
    )

    def count(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        repeated = let(
            placed,
            lambda s: F.filter(s, lambda x, k: (x.h == F.get(s, k + 1).h) | ((k > 0) & (x.h == F.get(s, k - 1).h))),
        )
        places = F.sort_array(F.transform(repeated, lambda x: x.i))
        total = let(
            places,
            lambda p: F.aggregate(
                F.transform(p, lambda at, k: F.least(F.lit(5), F.coalesce(F.get(p, k + 1) - at, F.lit(5)))),
                F.lit(0).cast("long"), lambda a, x: a + x,
            ),
        )
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(ws) >= 6, let(windows, count)).otherwise(F.lit(0).cast("long"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The measures of every whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    measures = F.struct(
        let(
            words(F.col(text)),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                covered_words(w).alias("n_repeat_words"),
            ),
        ).alias("w"),
        let(
            lines,
            lambda x: F.struct(
                F.size(x).cast("long").alias("n_lines"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            ),
        ).alias("l"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
    )
    return docs.withColumn("measures_", measures).withColumns(
        {c: F.col(f"measures_.w.{c}") for c in ("n_words", "word_chars", "n_repeat_words")}
        | {c: F.col(f"measures_.l.{c}") for c in ("n_lines", "n_dup_lines")}
        | {"n_symbols": F.col("measures_.n_symbols")}
    ).drop("measures_")


def base_fails() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules on the measures. The cost counts what the measure had to look at."""
    n, chars, symbols = F.col("n_words"), F.col("word_chars"), F.col("n_symbols")
    return [
        Rule("too_few_words", n < 10, n),
        Rule("repeated_windows", 100 * F.col("n_repeat_words") > 20 * n, 12 * n),
        Rule("symbols", 100 * symbols > 30 * n, chars + n),
        Rule("repeated_lines", 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"), chars / 8 + F.col("n_lines")),
        Rule("word_length", (chars < 2 * n) | (chars > 20 * n), n + chars / 4),
    ]


def order_rules(measured: DataFrame, rules: list[Rule], rows: int | None = None) -> list[Rule]:
    """The rules by rejections per cost, highest first, estimated on a hash sample of about SAMPLE_ROWS rows."""
    rows = measured.count() if rows is None else rows
    sample = measured.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE_ROWS))) == 0)
    found = sample.agg(
        *[F.avg(F.coalesce(r.rejects, F.lit(False)).cast("int")).alias(f"r{k}") for k, r in enumerate(rules)],
        *[F.avg(r.cost).alias(f"c{k}") for k, r in enumerate(rules)],
    ).first()
    worth = {r.name: (found[f"r{k}"] or 0.0) / max(found[f"c{k}"] or 0.0, 1e-9) for k, r in enumerate(rules)}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name))


def cascade(measured: DataFrame, ordered: list[Rule]) -> DataFrame:
    """Add rejected_by: the first rule, in this order, that rejects the row; null if all let it pass."""
    return measured.withColumn("rejected_by", F.coalesce(*[F.when(r.rejects, F.lit(r.name)) for r in ordered]))


def judge(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Measures, rejected_by, base_failed and kept for every row."""
    measured = measure(docs)
    ordered = order_rules(measured, rules or default_rules(), docs.count())
    return cascade(measured, ordered).withColumns(
        {"base_failed": base_fails(), "kept": ~base_fails() & F.col("rejected_by").isNull()}
    )


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM d),
win AS (SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM w WHERE len(ws) >= 6),
grams AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM win),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams),
spots AS (SELECT r, unnest(range(i, i + 5)) AS p FROM twice WHERE n > 1),
cover AS (SELECT r, count(DISTINCT p) AS n FROM spots GROUP BY r),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
    CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cover USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 30 * n_words
    OR 100 * n_dup_lines > 30 * n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
FROM m
"""


@query("op8_quality_rules", OP8_SQL)
def op8_quality_rules(spark, sf_dir):
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
