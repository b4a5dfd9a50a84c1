"""Quality rules for lines first and documents after: DataFrame expressions alone, no shuffle."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.common import unused, without

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words of a window, and the base rules: words of a document at least, and per cent of its words in repeated windows at most.
WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
#: A line fails with three symbols and more than SYMBOL_SHARE per cent of its words; with three shouted words that are over MARK_SHARE per cent; without a final mark under STUB words.
SYMBOL_SHARE, MARK_SHARE, STUB = 30, 33, 4
#: A line is navigation with three separators that are SEPARATOR_SHARE per cent of its words or more, or as a menu entry; it can be boilerplate up to so many words.
SEPARATOR_SHARE, BOILERPLATE_WORDS = 25, 30
#: A document is rejected when more than so many per cent of its characters in words stand in failed lines.
MOST_LOST = 70
SEPARATOR = r"^[|»›•·>/→–—-]+$"
MARKED = r"([!?]{2,}|[.]{4,})$"
#: What a line must hold to be looked at word by word. Other letters than Latin ones make a class of characters slow.
COUNTED, COUNTED_TOO = r"[#*$%&|<>/»·-]", ("›", "•", "→", "–", "—", "!!", "!?", "?!", "??", "....")
FINAL = r"[.!?:;…。！？][\"'”’»)\]]*$"
#: Entries of menus and phrases of boilerplate in English, German, French and Spanish, in lower case.
MENU = (
    "home", "menu", "search", "login", "log in", "log out", "sign in", "sign up", "register", "about us", "contact", "contact us", "read more", "click here", "next", "previous", "back to top", "skip to content", "share this",
    "startseite", "anmelden", "suche", "mehr lesen", "impressum", "kontakt", "accueil", "connexion", "recherche", "lire la suite", "contactez-nous", "inicio", "buscar", "iniciar sesión", "leer más", "contacto",
)
BOILERPLATE = (
    "all rights reserved", "copyright ©", "terms of use", "terms of service", "privacy policy", "cookie policy", "uses cookies", "use cookies", "accept cookies", "enable javascript", "subscribe to our newsletter", "licensed under", "released under the", "permission is hereby granted", "powered by",
    "alle rechte vorbehalten", "verwendet cookies", "datenschutzerklärung", "nutzungsbedingungen", "tous droits réservés", "utilise des cookies", "mentions légales", "politique de confidentialité", "todos los derechos reservados", "utiliza cookies", "aviso legal", "política de privacidad",
)
RULES = ("navigation", "boilerplate", "punctuation")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def judged_line(line: Column) -> Column:
    """(line, n_words, chars, symbols, failed): failed is the first rule that the line breaks, or null. A line without words breaks none."""

    def of(plain: Column) -> Column:
        # Most lines hold no mark that a rule counts; the words of the others are tried one by one.
        words = F.split(plain, " ")
        count = lambda pattern: F.size(F.filter(words, lambda x: x.rlike(pattern)))
        counts = [count(SEPARATOR).alias("separators"), count(MARKED).alias("marks"), F.regexp_count(plain, F.lit(SYMBOLS)).alias("symbols")]
        seen = F.when(reduce(or_, map(plain.contains, COUNTED_TOO), plain.rlike(COUNTED)), F.struct(*counts)).otherwise(F.struct(*[F.lit(0).alias(n) for n in ("separators", "marks", "symbols")]))
        chars = F.length(F.replace(plain, F.lit(" "), F.lit("")))
        n = F.when(plain == "", 0).otherwise(F.length(plain) - chars + 1)
        return F.transform(F.array(F.struct(plain.alias("plain"), F.when(n <= BOILERPLATE_WORDS, F.lower(plain)).otherwise("").alias("low"), n.alias("n_words"), chars.alias("chars"), seen.alias("seen"))), judged)[0]

    def judged(x: Column) -> Column:
        n, low, seen = x["n_words"], x["low"], x["seen"]
        menu = (n <= 6) & F.regexp_replace(low, "[.:]$", "").isin(*MENU)
        shouted = (seen["marks"] >= 3) & (100 * seen["marks"] > MARK_SHARE * n)
        symbols = (seen["symbols"] >= 3) & (100 * seen["symbols"] > SYMBOL_SHARE * n)
        failed = (
            F.when(n == 0, F.lit(None).cast("string"))
            .when(((seen["separators"] >= 3) & (100 * seen["separators"] >= SEPARATOR_SHARE * n)) | menu, "navigation")
            .when((n <= BOILERPLATE_WORDS) & reduce(or_, map(low.contains, BOILERPLATE)), "boilerplate")
            .when(symbols | shouted | ((n < STUB) & ~x["plain"].rlike(FINAL)), "punctuation")
        )
        return F.struct(line.alias("line"), n.alias("n_words"), x["chars"].alias("chars"), seen["symbols"].alias("symbols"), failed.alias("failed"))

    odd = line.startswith(" ") | line.endswith(" ") | line.contains("  ") | line.rlike(r"[\x09-\x0D]")
    return F.transform(F.array(F.when(odd, F.array_join(_words(line), " ")).otherwise(line)), of)[0]


def repeated_words(words: str, hashes: str) -> Column:
    """Words in windows that an array column of words holds twice or more; hashes has a hash of each window.

    Different hashes mean different windows; where two are equal, the windows are sorted and compared as they are.
    """
    window = lambda x, i: F.struct(x.alias("h"), F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("text"), i.alias("at"))

    def starts(s: Column) -> Column:
        twice = lambda x, k: F.coalesce(F.get(s, k - 1)["text"] == x["text"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["text"] == x["text"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, twice), lambda x: x["at"]))

    step = lambda s, i: F.struct((i + WINDOW).alias("end"), (s["n"] + i + WINDOW - F.greatest(s["end"], i)).alias("n"))
    total = F.aggregate(F.transform(F.array(F.sort_array(F.transform(hashes, window))), starts)[0], F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total)


def clean_lines(docs: DataFrame) -> DataFrame:
    """docs with ``text`` without the lines that fail, the counts of the base rules, lines failed by rule, ``lost_chars``, ``base_failed`` and ``kept``.

    Lines are parted by \\n; each is judged by itself: navigation (separators between entries, or a menu entry), boilerplate (phrases of licenses, cookies and rights),
    punctuation (symbols, shouting, stubs without a final mark). A document is kept if it meets the base rules and at most MOST_LOST per cent of its characters in words stand in failed
    lines. One pass in the JVM, no shuffle. Defined cases: a null or empty text has no words and is not kept; very long texts are taken whole; a line equal to an earlier one
    counts as repeated whatever its rule; repeated rows, null ids and other columns are carried; columns named like the new ones are replaced; an empty table gives an empty one.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[f"n_{r}" for r in RULES], "lost_chars", "base_failed", "kept")
    docs = without(docs, *made)
    w, h, lines = unused(docs, "__w", "__h", "__lines")
    rest = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    split = docs.select(*rest, _words(text).alias(w), F.transform(F.split(text, "\n"), judged_line).alias(lines))
    hashes = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col(w), i + k) for k in range(1, WINDOW)]))
    split = split.withColumn(h, hashes)
    total = lambda field, rows: F.aggregate(rows, F.lit(0).cast("long"), lambda s, x: s + x[field])
    broken = lambda rule: F.size(F.filter(lines, lambda x: x["failed"] == rule)).cast("long")
    said = F.transform(F.filter(lines, lambda x: x["n_words"] > 0), lambda x: x["line"])
    counted = split.select(
        *rest,
        F.array_join(F.transform(F.filter(lines, lambda x: x["failed"].isNull()), lambda x: x["line"]), "\n").alias("text"),
        F.size(w).cast("long").alias("n_words"),
        total("chars", lines).alias("word_chars"),
        total("symbols", lines).alias("n_symbols"),
        F.size(said).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(said)).cast("long").alias(lines),
        repeated_words(w, h).cast("long").alias("n_repeat_words"),
        *[broken(r).alias(f"n_{r}") for r in RULES],
        total("chars", F.filter(lines, lambda x: x["failed"].isNotNull())).alias("lost_chars"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    counted = counted.withColumns({"n_dup_lines": F.col("n_dup_lines") - F.col(lines), "base_failed": failed}).drop(lines)
    return counted.withColumn("kept", ~F.col("base_failed") & (100 * F.col("lost_chars") <= MOST_LOST * F.col("word_chars")))
