"""Line-first cleaning with DataFrame functions only.

Each line is judged by rules on its punctuation (no end though it is long, runs of marks, one word over and over),
on navigation and on boilerplate in four languages; lines that fail are removed, and a document that loses more than
MAX_LOSS_PERCENT of its text is rejected.

Defined cases: a null text has no words, lines or symbols, and fails the base rule; lines without a word are
kept in the cleaned text and count as no loss; other columns are kept as they are; an empty table gives an
empty table. 5-word windows are compared by 64-bit hashes of 64-bit word hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOSS_PERCENT = 50
WINDOW = 5
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: A line of prose ends like this; a line of LONG_LINE words is no prose if it doesn't, a shorter one is a heading.
END = r"""[.!?:;,…"'”’»)\]][\x20\x09-\x0D]*$"""
LONG_LINE = 12
STUTTER = 6  # words, of which a third or fewer differ
#: Words of menus, and phrases of page furniture, in English, German, French and Spanish.
NAVIGATION = (
    "home|menu|login|log in|sign in|sign up|register|next|previous|prev|back to top|skip to content|read more|share|search|sitemap|contact|about us|subscribe"
    "|startseite|menü|anmelden|registrieren|weiter|weiterlesen|zurück|nach oben|suche|kontakt|über uns|impressum"
    "|accueil|connexion|se connecter|s.inscrire|suivant|précédent|haut de page|lire la suite|rechercher|à propos"
    "|inicio|menú|iniciar sesión|registrarse|siguiente|anterior|volver arriba|leer más|buscar|contacto|acerca de"
)
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of use|terms of service|terms and conditions|lorem ipsum|enable javascript|licensed under|released under|copyright ©|©"
    "|alle rechte vorbehalten|datenschutzerklärung|nutzungsbedingungen|allgemeine geschäftsbedingungen|cookie-richtlinie"
    "|tous droits réservés|politique de confidentialité|mentions légales|conditions d.utilisation|politique de cookies"
    "|todos los derechos reservados|política de privacidad|términos de uso|aviso legal|política de cookies"
)


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def fails(line: Column) -> Column:
    """Whether a line with a word breaks a rule."""
    low = F.lower(line)
    many_symbols = 10 * F.regexp_count(line, F.lit(r"[#*$%&|<>{}\\\[\]~^_=+]")) > 3 * F.length(line)
    no_letters = ~line.rlike(r"[\p{L}\p{N}]")
    bangs = line.rlike(r"[!?#*$%&|]{4,}")
    noise = F.regexp_count(line, F.lit(r"[#*$%&|<>]{3,}"))
    unended = ~line.rlike(END)

    def by_words(w: Column) -> Column:
        n = F.size(w)
        return (unended & (n >= LONG_LINE)) | ((n >= 2) & (2 * noise >= n)) | ((n >= STUTTER) & (3 * F.size(F.array_distinct(w)) <= n))

    menu = low.rlike(rf"^[\x20\x09-\x0D]*(?:{NAVIGATION})(?:[\x20\x09-\x0D]*[|>»·/-][\x20\x09-\x0D]*[^|>»·/]{{1,30}})*[\x20\x09-\x0D]*$") | line.rlike(r"^[^|»>]{0,30}(?:[\x20\x09-\x0D]*[|»>][^|»>]{0,30}){2,}$")
    furniture = (F.length(line) <= 200) & low.rlike(BOILERPLATE)
    return many_symbols | no_letters | bangs | menu | furniture | let(F.regexp_extract_all(line, F.lit(WORD), F.lit(0)), by_words)


def repeated(words: Column) -> Column:
    """How many words lie in WINDOW-word windows that occur twice or more."""

    def count(h: Column) -> Column:
        def of(w: Column) -> Column:
            def covered(s: Column) -> Column:  # windows in order of hash, then place
                twice = F.filter(F.transform(s, lambda x, i: F.when((x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]), x["i"])), lambda p: p.isNotNull())
                return let(F.sort_array(twice), lambda at: F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b))

            many = let(F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered)
            return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(many)

        windows = F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
        return let(windows, of)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(F.transform(words, lambda w: F.xxhash64(w)), count))


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed, loss
    (percent of the characters of lines with words), kept and cleaned (the text without failing lines)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.expr(f"trim(BOTH '\\t\\n\\u000B\\f\\r ' FROM coalesce(`{text}`, ''))")
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+", -1))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated(w).cast("long").alias("n_repeat_words")))

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, has_word)
        marked = F.filter(lines, lambda x: ~(has_word(x) & fails(x)))
        return F.struct(let(full, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"), F.size(x).alias("n"), F.length(F.array_join(x, "")).alias("chars"))).alias("all"), let(marked, lambda x: F.struct(F.array_join(x, "\n").alias("text"), let(F.filter(x, has_word), lambda y: F.struct(F.size(y).alias("n"), F.length(F.array_join(y, "")).alias("chars"))).alias("full"))).alias("kept"))

    got = docs.withColumns({"__words": of_words, "__lines": let(F.split(whole, "\n", -1), of_lines), "n_symbols": F.regexp_count(whole, F.lit(r"[#*$%&|<>]")).cast("long")})
    lost = F.col("__lines.all.chars") - F.col("__lines.kept.full.chars")
    base = (F.col("__words.n_words") < MIN_WORDS) | (100 * F.col("__words.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("__words.n_words"))
    kept = ~base & (100 * lost <= MAX_LOSS_PERCENT * F.col("__lines.all.chars"))
    return got.withColumns({"n_words": F.col("__words.n_words"), "word_chars": F.col("__words.word_chars"), "n_dup_lines": F.col("__lines.all.dup"), "n_repeat_words": F.col("__words.n_repeat_words"), "base_failed": base, "kept": kept, "n_lines_removed": (F.col("__lines.all.n") - F.col("__lines.kept.full.n")).cast("long"), "loss": F.coalesce(100.0 * lost / F.nullif(F.col("__lines.all.chars"), F.lit(0)), F.lit(0.0)), "cleaned": F.col("__lines.kept.text")}).drop("__words", "__lines")
