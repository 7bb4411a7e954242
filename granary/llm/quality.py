"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much text go.

A word is a run of anything but ASCII white space. Figures that the base rules use are taken from the whole text
as it came; the line rules decide what of it stays.
"""

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import words

#: The base rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A document that keeps less than this share of its words' characters is rejected.
MIN_KEPT_PERCENT = 50
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Marks between the entries of a menu line; a line with so many, and one to every three words or so, is navigation.
SEPARATORS = {x.encode() for x in "|»›•·>/"}
NAVIGATION_MARKS, NAVIGATION_WORDS_EACH = 3, 3
#: Symbols for each hundred words from which a line of some length is noise.
SYMBOL_PERCENT, SHOUT_PERCENT, SHOUT_WORDS = 25, 80, 5
#: A line's last character, quotes and brackets set aside, that ends a sentence.
ENDS = (".", "!", "?", "…", ":", ";", ",", "。", "！", "？", "।", "؟")
CLOSERS = "\"'”’»)]}*_"
#: Shorter unfinished lines are headings or entries and not judged by punctuation alone.
HEADING_WORDS = 12
#: Phrases of page furniture, lower-cased, by language.
PHRASES = {
    "en": (
        "accept all cookies", "all rights reserved", "click here to", "cookie policy", "cookie settings", "enable javascript", "javascript is disabled", "lorem ipsum", "privacy policy", "read more", "share this",
        "sign up for our newsletter", "skip to content", "subscribe to our newsletter", "terms of service", "terms of use", "we use cookies",
    ),
    "de": ("alle cookies akzeptieren", "alle rechte vorbehalten", "allgemeine geschäftsbedingungen", "cookie-einstellungen", "datenschutzerklärung", "hier klicken", "javascript aktivieren", "newsletter abonnieren", "nutzungsbedingungen", "weiterlesen", "wir verwenden cookies", "zum inhalt springen"),
    "fr": ("abonnez-vous à notre newsletter", "accepter tous les cookies", "aller au contenu", "cliquez ici", "conditions d'utilisation", "lire la suite", "mentions légales", "nous utilisons des cookies", "paramètres des cookies", "politique de confidentialité", "tous droits réservés"),
    "es": ("aceptar todas las cookies", "aviso legal", "configuración de cookies", "haga clic aquí", "leer más", "política de privacidad", "saltar al contenido", "suscríbete a nuestro boletín", "términos de uso", "todos los derechos reservados", "utilizamos cookies"),
}
BOILERPLATE = tuple(p for held in PHRASES.values() for p in held)
#: Boilerplate phrases condemn lines of at most so many words; a long line that mentions one is prose.
BOILERPLATE_WORDS = 20


def line_fault(line: str, seen: bool) -> str | None:
    """The first rule that a line with words breaks; None for a line that stays."""
    w = words(line)
    marks = sum(map(SEPARATORS.__contains__, w))
    if marks >= NAVIGATION_MARKS and marks * NAVIGATION_WORDS_EACH >= len(w) - marks:
        return "navigation"
    if len(w) >= 3 and 100 * len(SYMBOLS.findall(line)) >= SYMBOL_PERCENT * len(w):
        return "symbols"
    if len(w) >= SHOUT_WORDS:
        letters = [c for c in line if c.isalpha()]
        if letters and 100 * sum(c.isupper() for c in letters) >= SHOUT_PERCENT * len(letters):
            return "shouting"
    if seen:
        return "repeated"
    if len(w) <= BOILERPLATE_WORDS:
        low = line.lower()
        if any(p in low for p in BOILERPLATE):
            return "boilerplate"
    if len(w) > HEADING_WORDS and not line.rstrip().rstrip(CLOSERS).endswith(ENDS) and not any(x in line for x in ENDS[:4]):
        return "punctuation"
    return None


def repeat_words(w: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more, first occurrences included."""
    windows = list(zip(w, w[1:], w[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, upto = 0, 0  # upto: end of what is counted
    for i, x in enumerate(windows):
        if counts[x] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def judged(text: str | None) -> tuple[int, int, int, int, int, int, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, kept characters of words, cleaned text."""
    text = text or ""
    w = words(text)
    chars = len(text) - sum(map(text.count, " \t\n\r\x0b\x0c"))
    seen: set[str] = set()
    repeats, kept_chars, kept = 0, 0, []
    for line in text.split("\n"):
        if not words(line):
            kept.append(line)
            continue
        again = line in seen
        repeats += again
        seen.add(line)
        if line_fault(line, again) is None:
            kept.append(line)
            kept_chars += len(line) - sum(map(line.count, " \t\r\x0b\x0c"))
    return len(w), chars, len(SYMBOLS.findall(text)), repeats, repeat_words(w), kept_chars, "\n".join(kept)


FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "kept_chars")


def measured(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """kept (the columns ``keep`` as a struct, so that no name clashes) with FIGURES, clean, base_failed and passes.

    A map over rows, without a shuffle. Null and empty texts count as empty and fail the base rules, texts are judged
    whole however long they are, repeated rows each for themselves; an empty table gives no row.
    """
    kinds = [*[(n, pa.int64()) for n in FIGURES], ("clean", pa.string())]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for i in range(0, big.num_rows, 500):
                x = big.slice(i, 500)
                cols = list(zip(*(judged(t) for t in x["judged"].to_pylist()))) or [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([x["kept"], *(pa.array(c, k) for c, (_, k) in zip(cols, kinds))], names=["kept", *(n for n, _ in kinds)])

    rows = docs.select(F.struct(*[docs[c] for c in keep]).alias("kept"), docs[text_col].alias("judged"))
    schema = rows.select("kept").schema
    for n in FIGURES:
        schema = schema.add(n, "long")
    out = rows.mapInArrow(judge, schema.add("clean", "string"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    loses = 100 * F.col("kept_chars") < MIN_KEPT_PERCENT * F.col("word_chars")
    return out.withColumn("base_failed", failed).withColumn("passes", ~failed & ~loses)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars, clean_text.

    A row for every row of ``docs``, null and repeated ids included; edge cases as for :func:`measured`. Other columns,
    whatever their names, are not read.
    """
    out = measured(docs, [id_col], text_col)
    names = {n: n for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")} | {"passes": "kept", "kept_chars": "kept_chars", "clean": "clean_text"}
    return out.select(F.col("kept")[id_col].alias(id_col), *[F.col(c).alias(n) for c, n in names.items()])


def cleaned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Kept rows with the columns of ``docs``; the text, and ``n_chars`` if there, without failing lines.

    Edge cases as for :func:`measured`; columns may have any name and be null.
    """
    others = [c for c in docs.columns if c != text_col]
    out = measured(docs, others, text_col).where("passes")
    columns = {c: F.col("kept")[c] for c in others} | {text_col: F.col("clean")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.length("clean").cast(docs.schema["n_chars"].dataType)
    return out.select(*[columns[c].alias(c) for c in docs.columns])
