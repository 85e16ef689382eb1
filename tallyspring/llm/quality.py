"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

All measures of a text are built-in array and string expressions; nothing is shuffled, so a text costs the
same in any corpus and one very long text needs memory for its own words only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of languages in Latin script, in lower case, letters only.
STOP_WORDS = sorted(set((
    "the of and to a in is that for it was on with be as by are this "
    "de la le et les des en un une du que est pour qui dans "
    "der die und den von zu das mit auf sich für ist im ein eine nicht "
    "el y los se del las por no con una su es para al "
    "il di che non per sono della o os da em não uma um mais com "
    "het een van en dat niet op zijn te i w na z się nie do jest och att som det är på "
    "og af til ikke ja ei on että bir ve bu da için si nu cu din v na je že se az és hogy nem"
).split()))


#: Marks that may stand around a word.
MARKS = ".,;:!?()[]{}\"“”„«»…-–—*_"

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Fails a text of at least ``from_words`` words (as counted in ``words``) when ``factor * part`` is outside ``least * whole`` to ``most * whole``."""

    name: str
    part: str
    whole: str
    least: int | None = None
    most: int | None = None
    factor: int = 100
    from_words: int = 0
    words: str = "n_words"


#: The verdict beyond the base rules. Ratios are in hundredths.
THRESHOLDS = (
    Rule("mean word length", "word_chars", "n_words", least=200, most=1200),
    Rule("symbols for each word", "n_symbols", "n_words", most=10),
    Rule("words with a letter", "n_letter_words", "n_words", least=80),
    # other scripts have no list, so the rule looks at words in Latin script only
    Rule("stop words", "n_stop_words", "n_latin_words", least=1, from_words=60, words="n_latin_words"),
    Rule("repeated lines", "n_dup_lines", "n_lines", most=50),
    Rule("lines that end in an ellipsis", "n_ellipsis_lines", "n_lines", most=30),
    Rule("lines that start with a bullet", "n_bullet_lines", "n_lines", most=90),
)


def let(value: Column, body) -> Column:
    """``body`` over ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = 8) -> Column:
    """Words inside windows that occur twice or more in the array. Windows are compared by 64-bit hash."""

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(pairs: Column) -> Column:
            again = F.filter(pairs, lambda p, k: F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.when(k > 0, F.get(pairs, k - 1)["h"]) == p["h"], F.lit(False)))
            return F.sort_array(F.transform(again, lambda p: p["i"]))

        def add(state: Column, start: Column) -> Column:
            return F.struct((state["n"] + F.least(F.lit(window), start - state["last"])).alias("n"), start.alias("last"))

        return F.aggregate(let(ordered, starts), F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), add, lambda s: s["n"])

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(covered(hashes))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (window - 1)), lambda i: F.xxhash64(F.slice(words, i, window)))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(hashes, count))


def measures(text: Column) -> Column:
    """A struct with the counts of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    parts = F.struct(
        text.alias("text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^ \t-\r]"))).alias("lines"),
    )

    def counts(d: Column) -> Column:
        size = lambda a, f: F.size(F.filter(a, f)).cast("long")
        return F.struct(
            F.size(d["words"]).cast("long").alias("n_words"),
            F.length(F.array_join(d["words"], "")).cast("long").alias("word_chars"),
            (F.length(d["text"]) - F.length(F.regexp_replace(d["text"], SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(d["lines"]) - F.size(F.array_distinct(d["lines"]))).cast("long").alias("n_dup_lines"),
            repeated_words(d["words"]).cast("long").alias("n_repeat_words"),
            F.size(d["lines"]).cast("long").alias("n_lines"),
            size(d["words"], lambda w: F.rlike(w, F.lit(r"\p{L}"))).alias("n_letter_words"),
            size(d["words"], lambda w: F.rlike(w, F.lit(r"[A-Za-z]"))).alias("n_latin_words"),
            size(d["words"], lambda w: F.btrim(F.lower(w), F.lit(MARKS)).isin(STOP_WORDS)).alias("n_stop_words"),
            size(d["lines"], lambda x: F.rlike(x, F.lit(r"(\.\.\.|…)[ \t-\r]*$"))).alias("n_ellipsis_lines"),
            size(d["lines"], lambda x: F.rlike(x, F.lit(r"^[ \t-\r]*[-*•]"))).alias("n_bullet_lines"),
        )

    return let(parts, counts)


def compiled(rules: tuple[Rule, ...], m: Column) -> Column:
    """True where every rule holds."""
    ok = F.lit(True)
    for r in rules:
        part, whole = m[r.part] * F.lit(r.factor), m[r.whole]
        holds = F.lit(True)
        if r.least is not None:
            holds = holds & (part >= whole * F.lit(r.least))
        if r.most is not None:
            holds = holds & (part <= whole * F.lit(r.most))
        ok = ok & (holds | (m[r.words] < F.lit(r.from_words)))
    return ok


def quality(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS, min_words: int = 20, most_repeated: int = 30) -> DataFrame:
    """One row per input row: id, the measures, base_failed and kept.

    Null and empty texts have no words, so they fail the base rules. Ids may be null or repeat. Other columns are left out.
    """
    rows = df.select(F.col(id_col), measures(F.col(text_col)).alias("m"))
    base = (F.col("m.n_words") < min_words) | (F.col("m.n_repeat_words") * 100 > F.col("m.n_words") * most_repeated)
    judged = rows.select(F.col(id_col), F.col("m"), base.alias("base_failed"))
    return judged.select(id_col, "m.*", "base_failed", (~F.col("base_failed") & compiled(rules, F.col("m"))).alias("kept"))
