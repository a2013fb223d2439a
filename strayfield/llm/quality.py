"""Quality rules: lines are judged first, then the documents that lose too much by it.

Each line is judged on its own: a line of symbols or a fragment without closing punctuation (punctuation rule), a row of
menu items (navigation rule), a stock phrase of web
pages or a stutter of one word (boilerplate rule) is taken out. A document that keeps too
little of its text after that, or that fails the word count or the repetition rule, is rejected.

Everything is a column expression over the document's own row: no shuffle, no Python, whole texts.

Edge cases: a NULL or empty text has no words and no lines, so it fails the word count. Lines without a word are never
counted, and stay. Repeated rows are judged alike. Columns of the input that have the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strayfield.llm.common import SPACE, fresh, let, replace, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
WINDOW = 8
MAX_SYMBOLS = 30  # symbols of a line for each 100 words
FRAGMENT = 4  # a shorter line must close with punctuation
SEPARATOR_SHARE = 8  # a menu has a separator for every so many tokens at least
PHRASE_WORDS = 20  # a stock phrase condemns a line of at most so many words
MIN_KEPT = 50  # percent of the characters that must stay
CLOSED = r"[.!?…:;。！？]['\"’”»)\]]*$"
TAIL = 4  # characters at the end of a line among which the closing mark must be
STUTTER = r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:[\x20\x09-\x0D]+\1(?![^\x20\x09-\x0D])){3}"  # one word four times in a row
PHRASES = (
    "javascript is", "enable javascript", "cookie policy", "accept cookies", "use of cookies", "privacy policy",
    "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "click here", "read more",
    "sign up for", "subscribe to our",
)


WORD, GAP = r"[^\x20\x09-\x0D]", r"[\x20\x09-\x0D]"
MARKS = r"[#*$%&|<>»›•·/]"  # a line without these is neither symbols nor a menu
AT_MOST = rf"^{GAP}*+(?:{WORD}++{GAP}*+){{0,%d}}+$"


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def line_fails(line: Column) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rule takes out.

    The cheap patterns come first: most lines have no mark, close with punctuation and are too long for a phrase.
    """
    bars = F.regexp_count(line, F.lit(rf"[|»›>•·/](?<=(?:^|{GAP}).)(?={GAP}|$)"))
    marked = lambda n: (n_symbols(line) * 100 > n * MAX_SYMBOLS) | let(bars, lambda b: (b >= 2) & (b * SEPARATOR_SHARE >= n))
    menu_or_symbols = line.rlike(MARKS) & let(F.regexp_count(line, F.lit(WORD + "+")), marked)
    fragment = ~F.right(F.rtrim(line, F.lit(SPACE)), F.lit(TAIL)).rlike(CLOSED) & line.rlike(AT_MOST % (FRAGMENT - 1))
    phrase = line.rlike(AT_MOST % PHRASE_WORDS) & F.lower(line).rlike("|".join(PHRASES))
    return line.rlike(WORD) & (menu_or_symbols | fragment | phrase | line.rlike(STUTTER))


def kept_lines(text: Column) -> Column:
    """The lines that no rule takes out, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: ~line_fails(line))


def repeated_words(tokens: Column) -> Column:
    """Number of words inside a window of eight that occurs twice or more in the text.

    Distinct window hashes prove that nothing repeats. Otherwise the windows themselves are sorted with their places:
    equal ones stand side by side, and their places, sorted again, give the words covered.
    """
    starts = F.sequence(F.lit(0), F.size(tokens) - WINDOW)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(WINDOW)]))
    placed = F.array_sort(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(tokens, i + 1, WINDOW), " ").alias("s"), i.alias("i"))))

    def covered(pairs: Column) -> Column:
        same = lambda p, k: F.coalesce(F.get(pairs, k)["s"] == p["s"], F.lit(False))
        hits = F.array_sort(F.transform(F.filter(pairs, lambda p, k: same(p, k - 1) | same(p, k + 1)), lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(a["end"] - i, F.lit(0))).alias("n"))
        return F.aggregate(hits, start, step)["n"]

    unique = F.size(F.array_distinct(hashed)) == F.size(tokens) - (WINDOW - 1)
    return F.when(F.size(tokens) <= WINDOW, 0).when(unique, 0).otherwise(let(placed, covered))


def measures(text: Column) -> Column:
    """A struct of all counts of a text."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    length = lambda ls: F.aggregate(ls, F.lit(0).cast("long"), lambda n, line: n + F.length(line))

    def of(tokens: Column, ls: Column) -> Column:
        return F.struct(
            F.size(tokens).cast("long").alias("n_words"),
            F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
            n_symbols(whole).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(tokens).cast("long").alias("n_repeat_words"),
            length(ls).alias("line_chars"),
            length(F.filter(ls, lambda line: ~line_fails(line))).alias("kept_chars"),
        )

    return let(words(text), lambda tokens: let(lines, lambda ls: of(tokens, ls)))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEATED)


def accepted(m: Column) -> Column:
    return ~base_failed(m) & (m["kept_chars"] * 100 >= m["line_chars"] * MIN_KEPT)


def judged(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``line_chars``,
    ``kept_chars``, ``base_failed`` and ``kept``."""
    (name,) = fresh(df, "measures")
    m = F.col(name)
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "line_chars", "kept_chars"]
    marked = df.withColumn(name, measures(F.col(f"`{text}`")))
    return replace(marked, **{f: m[f] for f in fields}, base_failed=base_failed(m), kept=accepted(m)).drop(name)


def clean(df: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that are kept, without the lines that were taken out; columns as in ``df``.

    A text that loses no line stays as it is, byte for byte. ``n_chars``, where ``df`` has it, follows the text.
    """
    name, new_text = fresh(df, "measures", "cleaned")
    kept = df.withColumn(name, measures(F.col(f"`{text}`"))).where(accepted(F.col(name)))
    kept = kept.withColumn(new_text, F.array_join(kept_lines(F.col(f"`{text}`")), "\n"))
    new = {text: F.col(new_text)}
    if n_chars in df.columns:
        new[n_chars] = F.length(new_text).cast(df.schema[n_chars].dataType)
    return kept.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])
