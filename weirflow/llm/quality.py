"""Quality rules, line first: drop failing lines, then reject documents that lost too much text.

Rules per line (lines without a word neither fail nor count):

* punctuation: a tenth or more of its characters are marks of `#*$%&|<>!`, or a line of 60 or more
  characters has no sentence mark `.!?:;…` at all, unless the next line goes on in lower case, as in
  prose that is wrapped;
* navigation: three or more menu separators `|»›>`, at least one in 40 characters;
* boilerplate: a line of up to 300 characters that holds a page-furniture phrase, of four languages.

A document is kept if its base counts pass (50 words, at most half of them in repeated three-word
windows) and the surviving lines hold at least half of the characters of its lines.

Defined cases: null text counts as empty; an empty text has zero counts and fails; repeated rows get
equal verdicts; an empty table gives an empty result; other columns are carried by `clean_documents`
and never clash. Windows are compared by 64-bit hash within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[#*$%&|<>!]"
ENDS = r"[.!?:;…]"
MENU = r"[|»›>]"
GOES_ON = r"^[\x20\x09-\x0D]*\p{Ll}"
WORD = r"[^\x20\x09-\x0D]"
#: Phrases of page furniture as patterns, matched without regard to case.
PHRASES = (
    "accept cookies", "all rights reserved", "back to top", "click here", "cookie policy",
    "enable javascript", "forgot your password", "lorem ipsum", "privacy policy", "read more",
    "share on facebook", "share on twitter", "sign up for our newsletter", "skip to content",
    "subscribe to our newsletter", "terms of service", "terms of use", "we use cookies",
    "alle rechte vorbehalten", "cookies akzeptieren", "datenschutzerkl[äÄ]rung", "newsletter abonnieren", "passwort vergessen", "zum inhalt springen",
    "aceptar cookies", "ir al contenido", "pol[íÍ]tica de cookies", "pol[íÍ]tica de privacidad", "suscr[íÍ]bete", "todos los derechos reservados",
    "accepter les cookies", "aller au contenu", "conditions d.utilisation", "mot de passe oubli[éÉ]", "politique de confidentialit[éÉ]", "tous droits r[éÉ]serv[éÉ]s",
)
FURNITURE = "(?i)" + "|".join(PHRASES)
MIN_WORDS = 50
REPEAT_PCT = 50
KEEP_PCT = 50


def _punctuation(x: Column, after: Column) -> Column:
    n = F.length(x)
    return (F.regexp_count(x, F.lit(MARKS)) * 10 >= n) | ((n >= 60) & ~x.rlike(ENDS) & ~F.coalesce(after.rlike(GOES_ON), F.lit(False)))


def _navigation(x: Column) -> Column:
    n = F.regexp_count(x, F.lit(MENU))
    return (n >= 3) & (n * 40 >= F.length(x))


def _boilerplate(x: Column) -> Column:
    return (F.length(x) <= 300) & x.rlike(FURNITURE)


def _fails(x: Column, after: Column) -> Column:
    return _punctuation(x, after) | _navigation(x) | _boilerplate(x)


def judge(docs: DataFrame, text: str = "text", keep_pct: int = KEEP_PCT) -> DataFrame:
    """Rows as struct `row`, with the counts, `clean_text` and the verdict `kept` beside it.

    Every step is a column expression on one row: nothing is shuffled. Each long intermediate array
    is a column of its own so that no lambda computes it again.
    """
    d = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.select("row", "t", words_of(F.col("t")).alias("w"), F.split("t", "\n").alias("all_lines"))
    d = d.withColumn("n", F.size("w"))
    windows = "if(n < 3, array(), transform(sequence(0, n - 3), i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS p)))"
    d = d.select(
        "row", "t", "n",
        F.length(F.array_join("w", "")).alias("word_chars"),
        F.filter("all_lines", lambda x: x.rlike(WORD)).alias("lines"),
        F.sort_array(F.expr(windows)).alias("s"),
    )
    d = d.select(
        "*",
        # positions of windows equal to a neighbour in hash order
        F.expr("transform(filter(s, (x, i) -> x.h = get(s, i - 1).h OR x.h = get(s, i + 1).h), x -> x.p)").alias("p"),
        F.filter("lines", lambda x, i: ~_fails(x, F.get("lines", i + 1))).alias("good"),
        F.aggregate("lines", F.lit(0), lambda a, x: a + F.length(x)).alias("line_chars"),
    )
    # each repeated window covers three words, fewer where the next one starts sooner
    covered = (
        "aggregate(sort_array(p), struct(-3 AS last, 0 AS total),"
        " (a, q) -> struct(q AS last, a.total + least(3, q - a.last) AS total), a -> a.total)"
    )
    d = d.select(
        "row",
        F.col("n").cast("long").alias("n_words"),
        F.col("word_chars").cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("good")).cast("long").alias("n_failed_lines"),
        F.col("line_chars").cast("long").alias("line_chars"),
        F.aggregate("good", F.lit(0), lambda a, x: a + F.length(x)).cast("long").alias("clean_chars"),
        F.array_join("good", "\n").alias("clean_text"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PCT)
    d = d.withColumn("base_failed", failed)
    enough = F.col("clean_chars") * 100 >= F.col("line_chars") * keep_pct
    return d.withColumn("kept", ~F.col("base_failed") & enough)


def clean_documents(docs: DataFrame, text: str = "text", keep_pct: int = KEEP_PCT) -> DataFrame:
    """Kept documents with all their columns; text holds the surviving lines, n_chars its length."""
    # The row number keeps the optimizer from pushing the verdict below the arrays it is made of, where each
    # lambda would build them anew for every element.
    judged = judge(docs, text, keep_pct).withColumn("number", F.monotonically_increasing_id())
    judged = judged.filter(F.col("kept") & (F.col("number") >= 0))
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(F.col("clean_text").alias(c))
        elif c == "n_chars":
            cols.append(F.length("clean_text").cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col("row")[c].alias(c))
    return judged.select(*cols)
