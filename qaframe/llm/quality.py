"""Line-first quality rules (operator 1), DataFrame expressions only.

Every line of a text is judged on its own by three families of rules:

* punctuation: symbol soup, shouting, or a short fragment without a closing mark;
* navigation: runs of menu separators, or a line that is only a menu word;
* boilerplate: legal, cookie and script notices.

Failing lines are removed; a document is rejected when too small a share of
its characters is left.  All work stays inside one row: no shuffle, so neither
a hot source nor a group of copies makes a hot task.

Defined results: a null or empty text has no words and no lines, all counts
0, `base_failed` true and `kept` false; its cleaned text is empty.  A null id is
judged like any other.  Repeated rows are judged row by row.  Lines and texts are
judged whole, however long.  An empty table gives an empty result.  Only the id and
text columns are read, so extra columns of any name do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qaframe.llm.common import WS, WS_CHARS

SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
# menu words and notices in the languages of the corpora: English, German, French, Spanish
MENU_WORDS = ["home", "login", "log in", "sign in", "sign up", "register", "search", "menu", "next", "previous",
              "contact", "contact us", "about", "about us", "share", "read more", "back to top",
              "startseite", "anmelden", "registrieren", "suche", "suchen", "menü", "weiter", "zurück", "kontakt",
              "impressum", "über uns", "teilen", "mehr lesen", "weiterlesen", "nach oben",
              "accueil", "connexion", "se connecter", "inscription", "s'inscrire", "recherche", "rechercher", "suivant",
              "précédent", "contactez-nous", "à propos", "partager", "lire la suite", "haut de page", "plan du site",
              "inicio", "iniciar sesión", "registrarse", "buscar", "menú", "siguiente", "anterior", "contacto",
              "acerca de", "sobre nosotros", "compartir", "leer más", "volver arriba", "mapa del sitio"]
BOILERPLATE = ["all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy",
               "use cookies", "uses cookies", "enable javascript", "lorem ipsum", "licensed under", "released under",
               "copyright ©", "copyright (c)", "subscribe to our newsletter",
               "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies",
               "verwenden cookies", "javascript aktivieren", "lizenziert unter", "newsletter abonnieren",
               "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales",
               "utilise des cookies", "utilisons des cookies", "activer javascript", "abonnez-vous à notre newsletter",
               "todos los derechos reservados", "términos de uso", "condiciones de uso", "política de privacidad",
               "aviso legal", "utiliza cookies", "utilizamos cookies", "usamos cookies", "activar javascript",
               "suscríbase a nuestro boletín"]
CLOSING = '.!?…:;。！？"”»\')]'


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50      # words in repeated 3-word windows
    max_symbol_percent: int = 10      # symbols per 100 characters of a line
    fragment_words: int = 4           # a line of fewer words needs a closing mark,
    fragment_chars: int = 40          # if it has so many characters at most
    separators: int = 3               # menu separators that make a navigation line,
    words_per_separator: int = 6      # if there is one for so many words at least
    shout_words: int = 5
    min_kept_percent: int = 60        # characters that must survive the line rules


def _class(chars: str) -> Column:
    """A regular expression for one of these characters."""
    return F.lit("[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]")


def line_facts(lines: Column, marked: Column, noticed: Column) -> Column:
    """Per line: its stripped text, how many rule characters it has, and its
    lower-cased text if it can be a notice or a menu word.  `marked` tells whether
    the whole text has a rule character at all, `noticed` whether it has a phrase."""
    menu_chars = max(map(len, MENU_WORDS))
    edge = lambda c: F.instr(F.lit(WS_CHARS), c) > 0
    spaces_off = F.transform(lines, lambda x: F.trim(x))
    stripped = F.transform(spaces_off, lambda s: F.when(
        edge(F.left(s, F.lit(1))) | edge(F.right(s, F.lit(1))), F.btrim(s, F.lit(WS_CHARS))).otherwise(s))
    def facts(count: bool, lower: bool) -> Column:
        return F.transform(stripped, lambda s: F.struct(
            s.alias("s"), (F.regexp_count(s, _class(SYMBOLS + SEPARATORS)) if count else F.lit(0)).alias("marks"),
            (F.lower(s) if lower else F.when(F.length(s) <= menu_chars, F.lower(s))).alias("low")))

    # decided per text: inside the lambda it would be evaluated for every line
    return (F.when(marked & noticed, facts(True, True)).when(marked, facts(True, False))
            .when(noticed, facts(False, True)).otherwise(facts(False, False)))


def line_fails(e: Column, r: QualityRules) -> Column:
    """True for a line (of `line_facts`) that a rule removes, never for a blank
    one.  Cheap conditions come first: the rest is not evaluated after them."""
    s = e["s"]
    words = F.regexp_count(s, F.lit(f"[{WS}]+")) + 1
    symbols = F.regexp_count(s, _class(SYMBOLS))
    seps = F.regexp_count(s, _class(SEPARATORS))
    soup = (e["marks"] > 0) & (symbols * 100 > F.length(s) * r.max_symbol_percent)
    fragment = ((F.length(s) <= r.fragment_chars) & (F.instr(F.lit(CLOSING), F.right(s, F.lit(1))) == 0)
                & (words < r.fragment_words))
    shouting = (s == F.upper(s)) & (s != F.lower(s)) & (words >= r.shout_words)
    navigation = (e["marks"] >= r.separators) & (seps >= r.separators) & (seps * r.words_per_separator >= words)
    menu = F.coalesce(e["low"].isin(MENU_WORDS), F.lit(False))
    notice = F.lit(False)
    for phrase in BOILERPLATE:
        notice = notice | F.contains(e["low"], F.lit(phrase))
    boilerplate = e["low"].isNotNull() & notice
    return (s != "") & (soup | navigation | fragment | menu | boilerplate | shouting)


def _repeats(df: DataFrame) -> DataFrame:
    """Replace `grams`, the hashes of the 3-word windows, by `n_repeat_words`: word
    positions covered by a window that occurs twice or more.

    Only texts with a repeated hash go on.  Their windows are sorted as longs of
    the upper hash bits and the position, so that equal windows are neighbours;
    neighbours are compared by their whole hashes.  Where two hashes share the
    upper bits, equal windows may lie apart: such a text is sorted again, by the
    whole hash and the position.  The covered positions are summed over the sorted
    starts: a start covers three words, less what the next start covers already.
    Steps are columns of their own, so none is evaluated twice."""
    rest = [c for c in df.columns if c != "grams"]
    mask = F.expr("shiftleft(1L, cast(ceil(log2(size(grams) + 1)) as int)) - 1")
    repeated = F.size(F.array_distinct("grams")) < F.size("grams")
    df = df.select(*rest, "grams", F.when(repeated, mask).alias("mask"))
    df = df.select(*rest, "grams", "mask", F.when(F.col("mask").isNotNull(), F.sort_array(F.transform(
        "grams", lambda g, i: g.bitwiseAND(F.bitwise_not("mask")).bitwiseOR(i.cast("bigint"))))).alias("pairs"))
    at = lambda p: F.get("grams", p.bitwiseAND(F.col("mask")).cast("int"))
    same = F.zip_with("pairs", F.slice("pairs", 2, 1 << 30),
                      lambda a, b: F.when(a.bitwiseXOR(b).between(0, F.col("mask")), at(a) == at(b)))
    df = df.select(*rest, "grams", "mask", "pairs", F.when(F.col("mask").isNotNull(), same).alias("same"))
    mixed = F.coalesce(F.exists("same", lambda s: ~F.coalesce(s, F.lit(True))), F.lit(False))
    df = df.select(*rest, "grams", "mask", "pairs", "same", mixed.alias("mixed"))
    whole = F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.cast("bigint").alias("i"))))
    df = df.select(*rest, "grams", "mask", "same", "mixed",
                   F.when(F.col("mixed"), F.transform(whole, lambda e: e["i"])).otherwise(F.col("pairs")).alias("pairs"))
    df = df.select(*rest, "mask", "pairs", F.when(F.col("mixed"), same).otherwise(F.col("same")).alias("same"))
    position = lambda p, s: F.when(s, p.bitwiseAND(F.col("mask")))
    starts = F.sort_array(F.array_compact(F.array_union(
        F.zip_with("pairs", "same", position), F.zip_with(F.slice("pairs", 2, 1 << 30), "same", position))))
    df = df.select(*rest, F.when(F.col("mask").isNotNull(), starts).alias("starts"))
    covered = F.zip_with("starts", F.slice("starts", 2, 1 << 30), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return df.select(*rest, F.coalesce(total, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def quality(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """One row per input row: the base counts, the verdict and the cleaned text.

    `n_lines`, `n_failed_lines`, `kept_percent` and `cleaned` come from the
    line rules; `kept` is false when the base rules fail or when less than
    `min_kept_percent` of the text's characters survive."""
    ident = F.col(id_col).alias("id")
    base = docs.select(ident, F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    split = base.select("id", "t", F.array_remove(F.split("t", f"[{WS}]+"), "").alias("words"),
                        F.split("t", "\n").alias("lines"))
    grams = F.slice(F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))),
                    F.lit(1), F.greatest(F.size("words") - 2, F.lit(0)))
    wordy = F.filter("lines", lambda x: x.rlike(f"[^{WS}]"))
    marked = F.col("n_symbols") > 0
    for c in SEPARATORS:
        if c not in SYMBOLS:
            marked = marked | F.contains("t", F.lit(c))
    # a phrase has no line break and no blank at its ends: a line has it only if the text has it
    noticed = F.lit(False)
    for phrase in BOILERPLATE:
        noticed = noticed | F.contains("low", F.lit(phrase))
    split = split.withColumn("n_symbols", F.regexp_count("t", _class(SYMBOLS)).cast("bigint")).withColumn("low", F.lower("t"))
    split = split.withColumn("marked", marked).withColumn("noticed", noticed)
    facts = split.select(
        "id", "t", "lines", F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        "n_symbols", grams.alias("grams"), wordy.alias("wordy"),
        line_facts(F.col("lines"), F.col("marked"), F.col("noticed")).alias("facts"))
    judged = _repeats(facts.select(
        "id", "t", "lines", "n_words", "word_chars", "n_symbols", "grams",
        (F.size("wordy") - F.size(F.array_distinct("wordy"))).cast("bigint").alias("n_dup_lines"),
        F.transform("facts", lambda e: line_fails(e, rules)).alias("fails")))
    good = F.array_join(F.array_compact(F.zip_with("lines", "fails", lambda x, f: F.when(~f, x))), "\n")
    cleaned = judged.select(
        "*", F.size(F.filter("fails", lambda f: f)).cast("bigint").alias("n_failed_lines"),
        F.when(F.exists("fails", lambda f: f), good).otherwise(F.col("t")).alias("cleaned"))
    left = F.when(F.col("n_failed_lines") == 0, F.col("word_chars")).otherwise(
        F.length(F.regexp_replace("cleaned", f"[{WS}]+", "")).cast("bigint"))
    failed = ((F.col("n_words") < rules.min_words)
              | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")))
    enough = F.col("left") * 100 >= F.col("word_chars") * rules.min_kept_percent
    # always true, but not deterministic for the optimizer: a filter on `kept` stays
    # above these columns instead of being pushed down with copies of them all
    here = F.spark_partition_id() >= 0
    return cleaned.withColumn("left", left).select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & enough & here).alias("kept"),
        F.size("lines").cast("bigint").alias("n_lines"), "n_failed_lines",
        F.when(F.col("word_chars") > 0, F.floor(F.col("left") * 100 / F.col("word_chars"))).alias("kept_percent"),
        "cleaned")
