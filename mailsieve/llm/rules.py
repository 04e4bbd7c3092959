"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself: punctuation (long lines must end as a sentence does, and symbols must be rare), navigation (rows of short items between bars, lone menu words) and boilerplate (stock phrases in short
lines, shouting). Failing lines are removed; a document that loses more than MAX_LOST_PERCENT of its word characters is
rejected, as is one that fails the base rules. All is computed within a row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
SYMBOLS = r"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, MAX_LOST_PERCENT = 50, 50, 50
#: Lines from LONG_LINE characters on must end as a sentence does: with one of these, and closing quotes or brackets after it.
LONG_LINE, SHORT_LINE = 40, 200
ENDINGS = r"""[.!?:;\x{2026}\x{3002}]["')\]\x{201D}\x{2019}\x{00BB}]*$"""
#: Stock phrases and menu words in four languages, fixed values.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "terms and conditions", "use of cookies", "enable javascript", "lorem ipsum", "subscribe to our newsletter", "sign up for our newsletter",
    "follow us on", "share on facebook", "share on twitter", "powered by wordpress", "click here to", "log in to comment",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "verwendung von cookies", "newsletter abonnieren", "folgen sie uns", "hier klicken", "zum warenkorb",
    "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "utilisation de cookies", "abonnez-vous à", "suivez-nous", "cliquez ici",
    "todos los derechos reservados", "política de privacidad", "términos de uso", "aviso legal", "uso de cookies", "suscríbete a", "síguenos en", "haz clic aquí",
]
MENU = [
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "search", "contact", "contact us", "about", "about us", "sitemap", "next", "previous", "back to top", "skip to content", "read more", "share", "print", "faq", "help",
    "startseite", "menü", "anmelden", "abmelden", "registrieren", "suche", "kontakt", "impressum", "über uns", "weiter", "zurück", "nach oben", "mehr lesen", "teilen", "drucken", "hilfe",
    "accueil", "connexion", "s'inscrire", "recherche", "rechercher", "contactez-nous", "à propos", "plan du site", "suivant", "précédent", "haut de page", "lire la suite", "partager", "imprimer", "aide",
    "inicio", "menú", "iniciar sesión", "registrarse", "buscar", "contacto", "sobre nosotros", "mapa del sitio", "siguiente", "anterior", "volver arriba", "leer más", "compartir", "imprimir", "ayuda",
]


def _count(text: Column, chars: str) -> Column:
    """Characters of text within the class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def line_passes(line: Column) -> Column:
    """Whether a line that has a word stays. Lines without a word always stay."""
    symbols, bars = _count(line, SYMBOLS), F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))
    length = F.length(line)
    punctuation = (symbols * 20 <= length) & ((length < LONG_LINE) | F.substring(F.rtrim(line), -8, 8).rlike(ENDINGS)) & ~F.endswith(F.rtrim(line), F.lit("!!"))
    navigation = (bars < 3) & ~((length <= SHORT_LINE) & F.lower(F.trim(line)).isin(MENU))
    boilerplate = (length > SHORT_LINE) | ~F.lower(line).rlike("|".join(BOILERPLATE))
    shouting = (length >= LONG_LINE) & (line == F.upper(line)) & (line != F.lower(line))
    return punctuation & navigation & boilerplate & ~shouting


def judged(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat: int = MAX_REPEAT_PERCENT, max_lost: int = MAX_LOST_PERCENT) -> DataFrame:
    """docs with one more column, `rules`: struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_chars, kept.

    A column of docs that is itself named rules is replaced. A null text counts as empty: no words, so it fails the base
    rules. Repeated rows are judged alike. An empty table gives an empty table.
    """
    own = [c for c in docs.columns if c != "rules"]
    text = F.coalesce(F.col("doc.text").cast("string"), F.lit(""))
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("doc"))
    df = df.select("doc", text.alias("t"), F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "").alias("ws"), F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]")).alias("lines"))
    n = F.size("ws")
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))
    df = df.select("doc", "t", n.cast("long").alias("n_words"), "lines", F.when(n >= 3, hashes).otherwise(F.array().cast("array<long>")).alias("win"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    pairs = F.when(F.size(F.array_distinct("win")) < F.size("win"), F.array_sort(F.transform("win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none)
    df = df.select("doc", "t", "n_words", "lines", pairs.alias("pairs"))
    again = F.filter("pairs", lambda x, j: F.get("pairs", j - 1)["h"].eqNullSafe(x["h"]) | F.get("pairs", j + 1)["h"].eqNullSafe(x["h"]))
    df = df.select("doc", "t", "n_words", "lines", F.array_sort(F.transform(again, lambda x: x["i"])).alias("at"))
    covered = F.aggregate(F.transform("at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("at", j + 1), p + 3) - p)), F.lit(0), lambda a, x: a + x)
    kept_text = F.array_join(F.filter("lines", line_passes), "\n")
    df = df.select(
        "doc", "n_words", (F.length("t") - _count(F.col("t"), SPACE)).cast("long").alias("word_chars"), _count(F.col("t"), SYMBOLS).alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"), kept_text.alias("kt"),
    )
    df = df.select("*", ((F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))).alias("base_failed"), (F.length("kt") - _count(F.col("kt"), SPACE)).cast("long").alias("kept_chars"))
    kept = ~F.col("base_failed") & (100 * F.col("kept_chars") >= (100 - max_lost) * F.col("word_chars"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept_chars"]
    return df.select(*[F.col(f"doc.`{c}`").alias(c) for c in own], F.struct(*names, F.col("kt").alias("clean_text"), kept.alias("kept")).alias("rules"))


def quality_rules(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id and the figures and verdict of every row; see judged() for nulls, empty texts and repeated rows."""
    return judged(docs.select("doc_id", "text"), **limits).select("doc_id", "rules.*")


def passing(docs: DataFrame, **limits: int) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they were."""
    # the id, always 0 or more, keeps the optimiser from copying the verdict's expressions into a filter below the projection
    cols = [F.col(f"`{c}`") for c in docs.columns if c != "rules"]
    rows = judged(docs, **limits).select(*cols, (F.col("rules.kept") & (F.monotonically_increasing_id() >= 0)).alias("rules"))
    return rows.where("rules").drop("rules")
