"""Quality rules: one threshold table, compiled into one Spark projection without user functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, spread

SPACE = "[\\x20\\x09-\\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they "
    "this to was we were which will with you "
    "aber als am an auch auf aus bei das dass dem den der des die du ein eine er es für hat ich ihr im in ist mit "
    "nicht noch sein sich sie sind so um und von war wie wir zu zum zur über "
    "à au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur mais ne nous on ou par pas "
    "plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cuando de del donde el ella ellos en entre es esta este hay la las lo los me muy más no para pero "
    "por porque que se sin sobre su sus un una y ya"
).split()

#: measure, smallest and largest value that is kept (None: no bound). Ratios of a text without words are null, which passes.
RULES = (
    ("n_words", 50, None),
    ("repeat_word_ratio", None, 0.5),
    ("mean_word_length", 1.5, 25.0),
    ("symbol_word_ratio", None, 0.5),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
)




def measures(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A struct __row of the columns keep of df (all, if None), and a struct __q of counts and ratios.

    Null text counts as empty: no words, and every ratio null. All of a text is measured, however long.
    """
    base = df.select(
        F.struct(*[df[c] for c in (df.columns if keep is None else keep)]).alias("__row"),
        F.coalesce(df[text_col], F.lit("")).alias("__t"),
    )
    inner = F.btrim("__t", F.lit(BLANKS))
    base = base.select("__row", "__t", F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{SPACE}+")).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    n = F.size("__w")
    word = lambda i: F.get("__w", i)
    places = F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0)))
    base = base.withColumn("__h", F.when(n >= 3, F.transform(places, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2)))))
    # Windows are sorted only where hashes are equal, by hash first: their strings are compared only for equal hashes.
    windows = F.when(
        F.size(F.array_distinct("__h")) < F.size("__h"),
        F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), F.concat(word(i), F.lit(" "), word(i + 1), F.lit(" "), word(i + 2)).alias("s"), i.alias("i")))),
    )
    base = base.select(
        "__row",
        n.cast("long").alias("n_words"),
        F.length(F.translate("__t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("__l"),
        windows.alias("__s"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
    )
    # Sorted windows: a window is repeated if it equals one of its neighbours.
    before = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit(None).cast("string").alias("s"), F.lit(-1).alias("i"))), F.col("__s"))
    flagged = F.zip_with(before, F.col("__s"), lambda a, b: F.when(a["s"] == b["s"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    base = base.select(
        "__row", "n_words", "word_chars", "n_symbols", "n_stop_words",
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.array_distinct(F.flatten(F.filter(flagged, lambda x: F.size(x) > 0))).alias("__r"),
    )
    words = F.size(F.array_distinct(F.flatten(F.transform("__r", lambda i: F.array(i, i + 1, i + 2)))))
    words = F.coalesce(F.when(F.size("__r") > 0, words), F.lit(0)).cast("long")
    base = base.withColumn("n_repeat_words", words)
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0)).cast("double")
    return base.select(
        "__row",
        F.struct(
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines",
            ratio("n_repeat_words", "n_words").alias("repeat_word_ratio"),
            ratio("word_chars", "n_words").alias("mean_word_length"),
            ratio("n_symbols", "n_words").alias("symbol_word_ratio"),
            ratio("n_stop_words", "n_words").alias("stop_word_ratio"),
            ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ).alias("__q"),
    )


def compiled(rules=RULES, at: str = "__q") -> Column:
    """The rules as one boolean column: true if every rule passes."""
    passed = F.lit(True)
    for name, low, high in rules:
        value = F.col(f"{at}.{name}")
        if low is not None:
            passed &= F.coalesce(value >= low, F.lit(True))
        if high is not None:
            passed &= F.coalesce(value <= high, F.lit(True))
    return passed


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: its id, all counts and ratios, base_failed and kept.

    A null or empty text has no words and fails; a null id stays null; repeated rows each get a row; an empty table
    gives an empty result; further columns are left aside, whatever their names.
    """
    out = measures(spread(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))), "text", ["doc_id"])
    failed = (F.col("__q.n_words") < 50) | (100 * F.col("__q.n_repeat_words") > 50 * F.col("__q.n_words"))
    return out.select("__row.doc_id", "__q.*", failed.alias("base_failed"), (~failed & compiled(rules)).alias("kept"))


def keep(df: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of df that pass all rules, with the columns of df as they were.

    A running number, which the filter names, keeps the optimizer from putting the measures' expressions into the
    filter, once for each rule that uses them.
    """
    held = measures(df, text_col).withColumn("__nth", F.monotonically_increasing_id())
    return held.where(compiled(rules) & (F.col("__nth") >= 0)).select("__row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = verdicts(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT k, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, w[i], w[i + 1], w[i + 2]) AS n FROM p),
r AS (SELECT k, count(DISTINCT j) AS n_repeat_words FROM (SELECT k, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY k),
l AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: lower(x) IN ({_STOPS}))) AS n_stop
  FROM d JOIN l USING (k) LEFT JOIN r USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND word_chars / n_words::DOUBLE BETWEEN 1.5 AND 25.0 AND n_symbols / n_words::DOUBLE <= 0.5
         AND n_stop / n_words::DOUBLE >= 0.01 AND n_dup_lines / n_lines::DOUBLE <= 0.5 AS kept
FROM m
"""
