"""Quality rules: a threshold table compiled into one Spark projection. Native, no user functions.

Words are maximal runs of characters other than blank and ``\\t\\n\\v\\f\\r``; lines are split at ``\\n``.
A rule bounds the ratio of two counts. It is compared in whole numbers (``scale * part > bound * whole``),
so that SQL can repeat it exactly. A text that breaks no rule and passes the base test is kept.

* null or empty text: no words, fails the base test; * very long text: arrays of its words inside one row,
sorted once, no quadratic step; * repeated rows: each judged; * empty table: empty result; * other columns
are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the be to of and that have with a in is was it for on as are this by at or from an "
    "der die das und ein eine ist nicht von zu mit im den des auf sich für dem als auch "
    "le la les de des et un une est dans que pour qui ne pas au du en sur ce "
    "el los las y del se por con para una no su lo al como más"
).split()


@dataclass(frozen=True)
class Rule:
    """``low <= scale * part / whole <= high``; a missing bound is open. No bound applies to whole = 0."""

    name: str
    part: str
    whole: str
    scale: int = 100
    low: int | None = None
    high: int | None = None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", scale=10, low=25, high=120),
    Rule("symbols_per_word", "n_symbols", "n_words", high=10),
    Rule("stop_words_per_word", "n_stop_words", "n_words", scale=1000, low=5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=30),
)

GAP = r"[\x20\x09-\x0D]+"


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once per row, inside higher-order functions too."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    parts = F.split(text, GAP)
    return F.filter(parts, lambda word: word != "")


def repeat_words(word: Column, width: int = 3) -> Column:
    """How many words lie in windows of ``width`` words that occur twice or more.

    A text whose window hashes are all different has none (equal windows have equal hashes). Otherwise
    the windows themselves are sorted with their places; equal neighbours give the repeated places; each
    repeated window adds the words up to the next one.
    """
    hashes = F.transform(word, lambda _, i: F.xxhash64(*(F.get(word, i + k) for k in range(width)), i > F.size(word) - width))
    window = F.transform(
        F.slice(word, F.lit(1), F.size(word) - (width - 1)),
        lambda x, i: F.struct(F.concat_ws(" ", x, *(F.get(word, i + k) for k in range(1, width))).alias("w"), i.alias("i")),
    )

    def repeated(ordered: Column) -> Column:
        at = lambda i: F.get(ordered, i)["w"]
        hits = F.filter(ordered, lambda x, i: (at(i + 1) == x["w"]) | ((i > 0) & (at(i - 1) == x["w"])))
        places = F.sort_array(F.transform(hits, lambda x: x["i"]))
        return F.aggregate(
            places,
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last")),
            lambda acc, i: F.struct((acc["n"] + F.least(F.lit(width), i - acc["last"])).alias("n"), i.alias("last")),
        )["n"]

    none = F.lit(0).cast("long")
    few = (F.size(word) <= width) | (F.size(F.array_distinct(hashes)) == F.size(word))
    return F.when(few, none).otherwise(bind(F.sort_array(window), repeated))


def counts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the counts that rules use, all longs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split_up = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        "text",
        words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    measured = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": repeat_words(F.col("words")),
        "n_lines": F.size("lines"),
        "n_stop_words": F.size(F.filter("words", lambda word: F.lower(word).isin(*STOP_WORDS))),
        "n_bullet_lines": F.size(F.filter("lines", lambda line: F.ltrim(line).rlike("^[-*•]"))),
        "n_ellipsis_lines": F.size(F.filter("lines", lambda line: F.rtrim(line).rlike("(\\.\\.\\.|…)$"))),
    }
    return split_up.select("doc_id", *(column.cast("long").alias(name) for name, column in measured.items()))


def broken(rule: Rule) -> Column:
    part, whole = F.col(rule.part) * rule.scale, F.col(rule.whole)
    tests = [] if rule.low is None else [part < whole * rule.low]
    tests += [] if rule.high is None else [part > whole * rule.high]
    test = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return (whole > 0) & test


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, ``base_failed``, the names of broken rules, and ``kept``."""
    measured = counts(docs)
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    named = F.array(*(F.when(broken(rule), F.lit(rule.name)) for rule in rules))
    return measured.withColumns({"base_failed": base, "broken_rules": F.filter(named, lambda name: name.isNotNull())}).withColumn(
        "kept", ~F.col("base_failed") & (F.size("broken_rules") == 0)
    )


def query(docs: DataFrame) -> DataFrame:
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same in SQL, with joins and windows where the query uses arrays."""
    tests = [
        f"({rule.whole} > 0 AND {rule.scale} * {rule.part} {sign} {bound} * {rule.whole})"
        for rule in rules
        for sign, bound in (("<", rule.low), (">", rule.high))
        if bound is not None
    ]
    gap = "[^\\x20\\x09-\\x0D]+"
    stop = ", ".join(f"'{word}'" for word in sorted(set(STOP_WORDS)))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(text, '{gap}')) AS word, generate_subscripts(regexp_extract_all(text, '{gap}'), 1) AS i FROM d),
per_word AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars,
                    count(*) FILTER (lower(word) IN ({stop})) AS n_stop_words FROM w GROUP BY r),
win AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
hot AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM hot, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
l AS (SELECT r, line FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{gap}')),
per_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                    count(*) FILTER (regexp_matches(line, '^ *[-*•]')) AS n_bullet_lines,
                    count(*) FILTER (regexp_matches(line, '(\\.\\.\\.|…) *$')) AS n_ellipsis_lines FROM l GROUP BY r),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             coalesce(n_lines, 0) AS n_lines, coalesce(n_stop_words, 0) AS n_stop_words,
             coalesce(n_bullet_lines, 0) AS n_bullet_lines, coalesce(n_ellipsis_lines, 0) AS n_ellipsis_lines
      FROM d LEFT JOIN per_word USING (r) LEFT JOIN rep USING (r) LEFT JOIN per_line USING (r)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT ({" OR ".join(tests)})) AS kept
FROM b"""
