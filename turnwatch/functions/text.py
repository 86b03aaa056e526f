"""Text columns: sentences, windows, views, clean-up and small parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnwatch.functions.vectors import bind

# Fixed values of message extraction.
MIN_WORDS, RELEVANCE, MIN_SELECTED, MAX_WINDOW = 30, 0.18, 1, 3
# Fixed patterns: sentence end before a capital, clause breaks, short fragments.
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z])"
CLAUSE_BREAK = (r"(?U);\s+|(?<=\.)\s+(?:Also|Separately|Additionally|Furthermore|Moreover),?\s+")
FRAGMENT = r"(?U)^\s*\S+(?:\s+\S+)?\s*$"  # fewer than three words
# Every white space character.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                           0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))
_JOIN = "\u0001"


def strip(text: Column) -> Column:
    """Trim every kind of white space."""
    return F.btrim(text, F.lit(BLANKS))


def word_count(text: Column) -> Column:
    return bind(strip(text), lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)\s+"))))


def sentences(text: Column) -> Column:
    """Sentences of a text; fragments below three words join the sentence before them."""
    return bind(strip(text), lambda whole: bind(_clauses(whole), lambda parts: _glue(whole, parts)))


def _clauses(whole: Column) -> Column:
    parts = F.flatten(F.transform(F.split(whole, SENTENCE_END), lambda p: F.split(strip(p), CLAUSE_BREAK)))
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def _glue(whole: Column, parts: Column) -> Column:
    # A short fragment is glued with a blank, anything else starts a new sentence.
    glued = F.array_join(F.transform(parts, lambda p, i: F.when(
        i == 0, p).when(p.rlike(FRAGMENT), F.concat(F.lit(" "), p)).otherwise(F.concat(F.lit(_JOIN), p))), "")
    return F.when(whole == "", F.array().cast("array<string>")).when(
        F.size(parts) == 0, F.array(whole)).otherwise(F.split(glued, _JOIN))


def sliding_windows(sents: Column, largest: int = MAX_WINDOW) -> Column:
    """Texts of all runs of 2..largest neighbouring sentences, shorter runs first."""
    def runs(width: int) -> Column:
        starts = F.when(F.size(sents) >= width, F.sequence(F.lit(1), F.size(sents) - (width - 1))) \
            .otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.array_join(F.slice(sents, s, F.lit(width)), " "))
    return F.flatten(F.array(*[runs(w) for w in range(2, largest + 1)]))


def first_best(texts: Column, scores: Column, otherwise: Column) -> tuple[Column, Column]:
    """The first text with the highest score above zero, and that score."""
    top = F.array_max(scores)
    hit = F.coalesce(top > 0, F.lit(False))
    at = F.array_position(scores, top).cast("int")
    return (F.when(hit, F.try_element_at(texts, at)).otherwise(otherwise),
            F.when(hit, top).otherwise(0.0))


def extracted(text: Column, sents: Column, scores: Column, tau: float = RELEVANCE, long: Column | None = None) -> dict[str, Column]:
    """Relevant sentences of a long message, or the message itself. ``long`` tells long messages where that is known."""
    long = (word_count(text) > MIN_WORDS) & (F.size(sents) > 1) if long is None else long
    keep = F.filter(F.arrays_zip(sents.alias("t"), scores.alias("s")), lambda x: x["s"] >= tau)
    use = long & (F.size(keep) >= MIN_SELECTED)
    use = F.coalesce(use, F.lit(False))
    return {"was_extracted": use,
            "extracted_text": F.when(use, F.array_join(F.transform(keep, lambda x: x["t"]), " ")).otherwise(text)}


def cosine_views(text: Column, was_extracted: Column, chunk: Column, window: Column) -> Column:
    return F.when(was_extracted, F.array(chunk, text, window)).otherwise(F.array(text))


def nli_views(text: Column, sents: Column, was_extracted: Column, chunk: Column, window: Column,
              window_score: Column) -> Column:
    """Chunk, best window (when it scored), every sentence, then the whole message; or just
    the sentences."""
    none = F.array().cast("array<string>")
    long = F.concat(F.array(chunk), F.when(window_score > 0, F.array(window)).otherwise(none),
                    sents, F.array(text))
    return F.when(was_extracted, long).otherwise(sents)


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(text, F.lit(""))), r"(?U)\s+", " ")


def fold_case(text: Column) -> Column:
    """Lower case for comparison; sharp s and final sigma meet their plain forms."""
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


def natural_key(pid: Column) -> list[Column]:
    """Sort key with p2 before p10 and other ids last."""
    number = F.regexp_extract(F.lower(F.trim(pid)), r"^p(\d+)$", 1)
    known = number != ""
    return [F.when(known, 0).otherwise(1), F.when(known, number.cast("decimal(38,0)")),
            F.when(~known, pid)]


def example_lines(raw: Column) -> Column:
    """Lines of a response as examples: longer than ten characters, bullets and numbers off."""
    lines = F.transform(F.split(strip(raw), "\n"), strip)
    lines = F.filter(lines, lambda x: F.length(x) > 10)
    return F.transform(lines, lambda x: F.btrim(F.btrim(x, F.lit("- ")), F.lit("0123456789.)")))


def json_list(text: Column) -> Column:
    """JSON list text as an array without blanks; anything else is an empty array."""
    items = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, strip), lambda x: F.coalesce(x != "", F.lit(False)))


def json_list_text(items: Column) -> Column:
    return F.to_json(F.filter(F.transform(items, strip), lambda x: x != ""))


def spell_changes(original: Column, corrected: Column) -> Column:
    """Words that differ between two texts, aligned by position, ignoring case."""
    def differ(a: Column, b: Column) -> Column:
        n = F.least(F.size(a), F.size(b))
        pairs = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n),
                           lambda x, y: F.struct(x.alias("was"), y.alias("now")))
        return F.filter(pairs, lambda p: F.lower(p["was"]) != F.lower(p["now"]))
    words = [F.split(strip(c), r"(?U)\s+") for c in (original, corrected)]
    return bind(words[0], lambda a: bind(words[1], lambda b: differ(a, b)))
