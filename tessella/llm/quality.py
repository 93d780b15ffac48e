"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Measures are column expressions over a text's words and lines. Every rule is a measure with a lower or
an upper bound; the verdict and the names of the rules that fail come from the same projection, with no
user function and no shuffle.

Cases: a null or empty text has no words and fails; a null key stays null; each repeated row gets its own
result; an empty table gives an empty result; texts are measured whole, a window of words is compared by
a 64-bit hash and sorted within its row, so the work is n log n in the length. Other columns are not
looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import PRE, keyed_text

SPACE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
# Frequent words of the four languages of the corpus.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his at from are this have or had an they which you",
    "de": "der die das und in zu den mit von ist des sich auf für im dem nicht ein eine als auch es an er hat aus bei sind",
    "fr": "de la le et les des en un du une que est pour qui dans par plus au sur ne se ce il sont avec pas on sa ou",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me sin",
}


@dataclass(frozen=True)
class Rule:
    """Fails where the measure is under ``least`` or over ``most``."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    base: bool = False


#: The base rules, then the method's own.
RULES = (
    Rule("too_few_words", "n_words", least=50, base=True),
    Rule("repeated_windows", "repeat_share", most=0.5, base=True),
    Rule("symbols_per_word", "symbols_per_word", most=0.1),
    Rule("mean_word_length", "mean_word_chars", least=2.0, most=15.0),
    Rule("capitals", "upper_share", most=0.4),
    Rule("letters", "letter_share", least=0.6),
    Rule("stop_words", "stop_share", least=0.04),
    Rule("repeated_lines", "dup_line_share", most=0.5),
    Rule("bullet_lines", "bullet_share", most=0.9),
    Rule("cut_off_lines", "ellipsis_share", most=0.3),
)


def words_of(text: Column) -> Column:
    bare = F.trim(text, F.lit(SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def repeated_words(ordered: Column) -> Column:
    """Words in windows of three found twice or more; ``ordered`` has (hash, position) of each window in order."""
    at = F.filter(
        F.transform(
            ordered,
            lambda w, k: F.when(
                (k > 0) & (w["h"] == F.get(ordered, k - 1)["h"]) | (w["h"] == F.get(ordered, k + 1)["h"]), w["at"]
            ),
        ),
        lambda p: p.isNotNull(),
    )
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("until"))
    return F.aggregate(
        F.sort_array(at),
        start,
        lambda s, p: F.struct(
            (s["total"] + p + 3 - F.greatest(p, s["until"])).alias("total"), (p + 3).alias("until")
        ),
        lambda s: s["total"],
    )


def measures(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The key, the counts and the ratios that rules can name."""
    text, words, lines = (F.col(f"{PRE}{c}") for c in ("text", "words", "lines"))
    rows = keyed_text(df, id_col, text_col).select(
        "*",
        words_of(text).alias(f"{PRE}words"),
        F.filter(F.split(text, "\n", -1), lambda line: F.length(F.trim(line, F.lit(SPACE))) > 0).alias(f"{PRE}lines"),
    )
    n = F.size(words)
    hashes = F.when(
        n >= 3,
        F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    )
    rows = rows.select("*", hashes.alias(f"{PRE}hashes"))
    hashes = F.col(f"{PRE}hashes")
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    ordered = F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    rows = rows.select("*", ordered.alias(f"{PRE}ordered"))
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws.split()})
    length = lambda c: F.length(c).cast("long")
    rows = rows.select(
        F.col(f"{PRE}id").alias(id_col),
        n.cast("long").alias("n_words"),
        length(F.translate(text, SPACE, "")).alias("word_chars"),
        (length(text) - length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.coalesce(repeated_words(F.col(f"{PRE}ordered")), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        length(F.regexp_replace(text, r"\P{L}+", "")).alias("n_letters"),
        length(F.regexp_replace(text, r"\P{Lu}+", "")).alias("n_upper"),
        F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))).isin(stop))).cast("long").alias("n_stop"),
        F.size(F.filter(lines, lambda line: F.ltrim(line, F.lit(SPACE)).rlike("^[-*•‣●]"))).cast("long").alias("n_bullets"),
        F.size(F.filter(lines, lambda line: F.rtrim(line, F.lit(SPACE)).rlike(r"(\.\.\.|…)$"))).cast("long").alias("n_cut_off"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return rows.select(
        "*",
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_upper", "n_letters").alias("upper_share"),
        share("n_letters", "word_chars").alias("letter_share"),
        share("n_stop", "n_words").alias("stop_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_bullets", "n_lines").alias("bullet_share"),
        share("n_cut_off", "n_lines").alias("ellipsis_share"),
    )


def broken(rule: Rule) -> Column:
    value, tests = F.col(rule.measure), []
    if rule.measure == "repeat_share":  # in whole numbers, as the bound is exact
        return F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * rule.most)) * F.col("n_words")
    if rule.least is not None:
        tests.append(value < rule.least)
    if rule.most is not None:
        tests.append(value > rule.most)
    return tests[0] if len(tests) == 1 else tests[0] | tests[1]


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: key, measures, ``base_failed``, ``failed_rules`` and ``kept``."""
    fails = lambda some: F.array_compact(F.array(*(F.when(broken(r), F.lit(r.name)) for r in some)))
    base = [r for r in rules if r.base]
    return measures(df, id_col, text_col).select(
        "*",
        (F.size(fails(base)) > 0).alias("base_failed") if base else F.lit(False).alias("base_failed"),
        fails(rules).alias("failed_rules"),
        (F.size(fails(rules)) == 0).alias("kept"),
    )


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``df`` whose text passes every rule, as they are.

    A filter on the verdict would be pushed below the projections, where every use of a word would split the
    text again; a verdict that also looks at the row's number stays where it is.
    """
    rows = df.select(F.struct("*").alias(f"{PRE}row"), F.col(text_col).alias(f"{PRE}body"))
    judged = judge(rows, f"{PRE}row", f"{PRE}body", rules)
    verdict = F.col("kept") & (F.monotonically_increasing_id() >= 0)
    return judged.select(f"{PRE}row", verdict.alias(f"{PRE}kept")).where(f"{PRE}kept").select(f"{PRE}row.*")


def quality_digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return judge(df, id_col, text_col).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def quality_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``quality_digest``."""
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws.split()}))
    tests = [
        " or ".join(
            [f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None)
        )
        for r in rules
        if not r.base
    ]
    return rf"""
    with w as (
      select doc_id, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) ls
      from (select doc_id, coalesce(text, '') t from documents)),
    win as (
      select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] k
      from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
    rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1),
    cov as (select doc_id, count(distinct p) n from (select doc_id, unnest([i, i + 1, i + 2]) p from rep) group by 1),
    m as (
      select doc_id, len(ws) n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols,
        len(ls) - len(list_distinct(ls)) n_dup_lines,
        coalesce(n, 0) n_repeat_words,
        len(ls) n_lines,
        length(regexp_replace(t, '\P{{L}}+', '', 'g')) n_letters,
        length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) n_upper,
        len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) in ({stop}))) n_stop,
        len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•‣●]'))) n_bullets,
        len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) n_cut_off
      from w left join cov using (doc_id)),
    r as (
      select *, n_symbols / greatest(n_words, 1) symbols_per_word, word_chars / greatest(n_words, 1) mean_word_chars,
        n_upper / greatest(n_letters, 1) upper_share, n_letters / greatest(word_chars, 1) letter_share,
        n_stop / greatest(n_words, 1) stop_share, n_dup_lines / greatest(n_lines, 1) dup_line_share,
        n_bullets / greatest(n_lines, 1) bullet_share, n_cut_off / greatest(n_lines, 1) ellipsis_share,
        n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed
      from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      not (base_failed or {" or ".join(tests)}) as kept
    from r"""
