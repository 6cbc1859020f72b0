"""Text functions as Column expressions. White space is Unicode's, as in the programs whose results they match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import let


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalise(text: Column) -> Column:
    """Lower case, runs of white space as one blank, stripped."""
    return F.lower(strip(F.regexp_replace(text, r"(?U)\s+", " ")))


def normalise_escaped(text: Column) -> Column:
    r"""As ``normalise``, with the escapes \n, \r and \t taken for white space first."""
    return normalise(F.regexp_replace(text, r"\\[nrt]", " "))


def words(text: Column) -> Column:
    """Words between white space; an empty array for a blank text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def run_starts(words_: Column, n: int) -> Column:
    """Positions (from 1) at which n words start; empty if there are fewer."""
    return F.when(F.size(words_) >= n, F.sequence(F.lit(1), F.size(words_) - (n - 1))).otherwise(F.array().cast("array<int>"))


def shingles(words_: Column, n: int, joined: bool = False) -> Column:
    """Distinct runs of n words, as 64-bit hashes or joined with blanks; empty if there are fewer words.

    Each word is hashed once, and a run's hash is that of its words' hashes, so no text is built for a run."""
    if joined:
        return let(words_, lambda w: F.array_distinct(F.transform(run_starts(w, n), lambda i: F.array_join(F.slice(w, i, n), " "))))
    hashed = F.transform(words_, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.array_distinct(F.transform(run_starts(h, n), lambda i: F.xxhash64(F.slice(h, i, n)))))


def word_spans(text: Column) -> Column:
    """Half-open offsets of the words between white space."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        end = acc["at"] + F.length(piece)
        start = end - F.length(F.regexp_replace(piece, r"(?U)\s+", ""))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("found"))

    return F.aggregate(pieces, zero, step, lambda acc: acc["found"])


def word_end(text: Column, k: Column) -> Column:
    """Offset after the k-th word (from 1); 0 for k = 0."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)\s*\S+"), F.lit(0))
    return F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda n, p: n + F.length(p))


def capitalise_first(text: Column) -> Column:
    """First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))


def slug(text: Column) -> Column:
    """Lower-case letters and digits joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def escape_json(text: Column) -> Column:
    """The text as it stands inside a JSON string."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.substring(whole, F.lit(7), F.length(whole) - 8)


def unescape_json(fragment: Column) -> Column:
    """The text of a part of a JSON string; null if it is none."""
    whole = F.concat(F.lit('{"x":"'), fragment, F.lit('"}'))
    return F.get_json_object(whole, "$.x")


def cut_at(text: Column, markers: list[str]) -> Column:
    """The text before the first of the markers, stripped at its end; all of it without one."""
    for m in markers:
        text = F.when(text.contains(m), F.left(text, F.instr(text, F.lit(m)) - 1)).otherwise(text)
    return F.regexp_replace(text, r"(?U)\s+$", "")


def shortened(text: Column, limit: int = 200) -> Column:
    """White space squeezed, and what is longer than ``limit`` cut with three dots in the place of its end."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit - 3)), F.lit("..."))).otherwise(flat)


def token_set(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9_]+"), F.lit(0)))


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two texts' token sets."""
    return F.size(F.array_intersect(token_set(a), token_set(b)))


def same_text(a: Column, b: Column) -> Column:
    """Whether two addresses are the same: without case and surrounding white space; null is like nothing."""
    return F.coalesce(F.lower(strip(a)) == F.lower(strip(b)), F.lit(False))


def parsed_time(text: Column) -> Column:
    """A time in one of the usual forms; null for any other text."""
    forms = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm", "dd.MM.yyyy"]
    return F.coalesce(*(F.try_to_timestamp(strip(text), F.lit(f)) for f in forms))


def escape_xml(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def html_snippet(html: Column, limit: int = 1200) -> Column:
    """Tags as blanks, white space squeezed, cut to ``limit`` characters."""
    return F.left(strip(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"(?U)\s+", " ")), F.lit(limit))


def html_title(html: Column) -> Column:
    """Text of the first heading of level 1 to 3; empty if there is none."""
    return strip(F.regexp_replace(F.regexp_extract(html, r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>", 1), "<[^>]+>", ""))


def qa_words(text: Column) -> Column:
    """Words of an answer: lower case, without ASCII punctuation and articles."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return words(F.regexp_replace(bare, r"\b(a|an|the)\b", " "))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda ab: F.aggregate(F.array_distinct(ab["a"]), F.lit(0), lambda n, w: n + F.least(count(ab["a"], w), count(ab["b"], w))))


def qa_f1(prediction: Column, truth: Column) -> Column:
    """Harmonic mean of word precision and recall, 0 without common words."""
    both = F.struct(qa_words(prediction).alias("p"), qa_words(truth).alias("t"))
    score = lambda ab: let(bag_overlap(ab["p"], ab["t"]), lambda same: F.when(same == 0, F.lit(0.0)).otherwise(2.0 * same / (F.size(ab["p"]) + F.size(ab["t"]))))
    return let(both, score)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length, within [0, 1]; 1 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.levenshtein(a, b) / longest))


def overlong_word(text: Column, limit: int = 50) -> Column:
    """Whether the text has a run of word characters of at least ``limit`` without "http"."""
    return F.exists(F.regexp_extract_all(text, F.lit(rf"\w{{{limit},}}"), F.lit(0)), lambda w: ~w.contains("http"))


def most_repeated_run(text: Column, n: int = 8) -> Column:
    """How often the most frequent run of n words occurs; 0 if there are fewer words."""
    grams = let(words(text), lambda w: F.array_sort(F.transform(run_starts(w, n), lambda i: F.xxhash64(F.array_join(F.slice(w, i, n), " ")))))
    zero = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, g: Column) -> Column:
        run = F.when(acc["last"] == g, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(grams, zero, step, lambda acc: acc["best"])


def sentences(text: Column) -> Column:
    """Sentences ending in . ! or ? before white space or at a line end, stripped, without empty ones. Common abbreviations and decimals don't end one."""
    held = F.regexp_replace(text, r"\b(Mr|Mrs|Ms|Dr|Prof|St|Inc|Ltd|Jr|Sr|e\.g|i\.e|etc)\.", "$1\u0001")
    held = F.regexp_replace(held, r"(\d)\.(\d)", "$1\u0001$2")
    cut = F.split(F.regexp_replace(held, r"([.!?]+[\"')\]]*)(\s+|$)", "$1\u0002"), "[\u0002\n]")
    return F.filter(F.transform(cut, lambda s: strip(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")


def segments(text: Column, size: int = 100) -> Column:
    """Pieces of ``size`` words, joined with blanks."""
    starts = lambda w: F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return let(words(text), lambda w: F.transform(starts(w), lambda i: F.array_join(F.slice(w, i, size), " ")))


def first_code_line(text: Column) -> Column:
    """First line without a back-tick, # or //; empty if there is none."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.contains("`") & ~x.contains("#") & ~x.contains("//"))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit(""))


def number_precision(prediction: Column, truth: Column) -> Column:
    """Share of the numbers in the prediction that equal the truth; 0 without numbers."""
    found = F.regexp_extract_all(prediction, F.lit(r"\d+"), F.lit(0))
    return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(F.size(F.filter(found, lambda x: x == truth)) / F.size(found))


def is_json(text: Column) -> Column:
    """Whether the text is valid JSON; null counts as not."""
    return F.try_parse_json(text).isNotNull()


def last_json_string(text: Column, key: str) -> Column:
    """A string field of a JSON object, with or without a code fence around it; null if it doesn't parse or the field is no string."""
    bare = strip(F.regexp_replace(strip(text), r"(?s)^```[A-Za-z]*\s*|\s*```$", ""))
    value = F.try_parse_json(bare)
    return F.when(F.schema_of_variant(F.try_variant_get(value, f"$.{key}", "variant")) == "STRING", F.try_variant_get(value, f"$.{key}", "string"))
