"""Text functions as columns: all run inside the JVM, without Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists of the text rules.
STOP_WORDS = "a an the to and or of in on for with is are was were be by at as it this that we i".split()
STATE_CHANGING_TOOLS = "write search_replace image_gen image_edit spawn_subagent scheduler_create scheduler_delete Write Edit NotebookEdit".split()
FAILURE_SIGNALS = ["fail", "error", "crash", "deadlock", "timeout", "panic", "失败", "报错", "死锁", "崩溃"]
SUCCESS_WORDS = ["ok", "pass", "passed", "fixed", "resolved", "succeed", "succeeds", "succeeded"]
SUCCESS_SIGNALS = ["成功", "通过", "修复"]
RETRACTION_MARKERS = ["no longer", "not anymore", "removed", "deleted", "cancelled", "canceled", "completed", "moved on", " over ", "instead of"]


def _lit_array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def tokens(text: Column) -> Column:
    """Words of ASCII letters and digits, lower-cased, without stop words; runs of other letters and digits as bigrams. Repeats stay."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z0-9]+|[\p{L}\p{N}&&[^\x00-\x7F]]+"), F.lit(0))

    def of(run: Column) -> Column:
        n = F.char_length(run)
        pairs = F.when(n == 1, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(run, i, F.lit(2))))
        return F.when(run < F.lit("\u0080"), F.array(F.lower(run))).otherwise(pairs)

    return F.filter(F.flatten(F.transform(runs, of)), lambda t: ~t.isin(STOP_WORDS))


def content_tokens(text: Column) -> Column:
    """tokens without the words that names of state-changing tools are made of."""
    words = sorted({w.lower() for t in STATE_CHANGING_TOOLS for w in t.split("_") if w.lower() not in STOP_WORDS})
    tool = _lit_array(words)
    return F.filter(tokens(text), lambda t: ~F.array_contains(tool, t))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def containment(a: Column, b: Column) -> Column:
    """Shared part of the smaller set; 0 if either is empty."""
    low = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(low, F.lit(0)), F.lit(0.0))


def text_jaccard(a: Column, b: Column) -> Column:
    """Of white-space words in lower case; 1 if both texts have none."""
    words = lambda c: F.filter(F.array_distinct(F.split(F.lower(c), r"\s+")), lambda w: w != "")
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.nullif(union, F.lit(0)))


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def pair_signature(a: Column, b: Column) -> Column:
    """What two texts share: their common tokens in order, joined by spaces."""
    return F.array_join(F.array_sort(F.array_intersect(a, b)), " ")


def outcome_polarity(text: Column) -> Column:
    """true: success, false: failure, null: neither. Success words outweigh failure words."""
    low = F.lower(text)
    success = F.regexp_like(low, F.lit("(^|[^\\p{L}\\p{N}])((" + "|".join(SUCCESS_WORDS) + ")([^\\p{L}\\p{N}]|$)|success)")) | F.regexp_like(low, F.lit("|".join(SUCCESS_SIGNALS)))
    return F.when(success, F.lit(True)).when(F.regexp_like(low, F.lit("|".join(FAILURE_SIGNALS))), F.lit(False))


def effective_polarity(stored: Column, text: Column) -> Column:
    """A stored polarity counts before the words of the text; mixed and neutral are neither."""
    return F.when(stored == "negative", F.lit(False)).when(stored == "positive", F.lit(True)).when(stored.isNull(), outcome_polarity(text))


def outcomes_contradict(old: Column, new: Column) -> Column:
    """Exactly one of two polarities is a failure."""
    failed = lambda c: F.coalesce(~c, F.lit(False))
    return failed(old) != failed(new)


def polarity_bucket(stored: Column, text: Column) -> Column:
    p = outcome_polarity(text)
    return F.coalesce(stored, F.when(p, F.lit("positive")).when(~p, F.lit("negative")).otherwise(F.lit("neutral")))


def is_retraction(text: Column) -> Column:
    return F.regexp_like(F.lower(text), F.lit("|".join(RETRACTION_MARKERS)))


def strip_bracket_prefix(text: Column) -> Column:
    """Without the first '[...] ' at the start."""
    return F.regexp_replace(F.ltrim(text), r"(?s)^\[.*?\] \s*", "")


def date_tokens(text: Column) -> Column:
    """Distinct valid YYYY-MM-DD dates outside longer runs of digits, after the bracket prefix is dropped; in order."""
    found = F.regexp_extract_all(strip_bracket_prefix(text), F.lit(r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"), F.lit(0))
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: F.try_to_timestamp(d, F.lit("yyyy-MM-dd")).isNotNull())))


def estimate_tokens(text: Column) -> Column:
    """One a CJK character, one for each four others, rounded up."""
    cjk = F.char_length(F.regexp_replace(text, "[^一-鿿　-〿]", ""))
    return (cjk + F.ceil((F.char_length(text) - cjk) / 4)).cast("long")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def snippet(text: Column, n: int = 80) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


#: Words that are no entities though capitalised.
ENTITY_STOP = (
    "the a an and but so or if then than she he they we i you me us her him his hers their my your our its what when where why how who which that this "
    "these those there here it as at of in on to for with by from do does did have has had was were will would shall should can could may might must is are "
    "be been being yes no ok okay hi hey hello thanks thank please like going got get go went one two three first last today tomorrow yesterday sunday monday "
    "tuesday wednesday thursday friday saturday january february march april june july august september october november december"
).split()


def entity_tokens(text: Column) -> Column:
    """Capitalised words within sentences, lower-cased, without a final 's: names rather than the first words of sentences.

    A word starts at an ASCII letter and goes on over ASCII letters, digits and apostrophes.
    """
    stop = _lit_array(ENTITY_STOP)
    # Each match is a word with what stands before it: white space after the last word, or one other character.
    with_before = F.regexp_extract_all(F.ltrim(F.coalesce(text, F.lit(""))), F.lit(r"(?:^|[^\s])?\s*[A-Za-z][A-Za-z0-9']*"), F.lit(0))
    inner = F.filter(with_before, lambda w: F.regexp_like(w, F.lit("^(?:\\s+|[^\\s.!?\"“”A-Za-z]\\s*)[A-Z][A-Za-z0-9']+$")))
    names = F.transform(inner, lambda w: F.lower(F.regexp_replace(F.regexp_extract(w, "([A-Z][A-Za-z0-9']*)$", 1), "'s$", "")))
    return F.filter(names, lambda w: (F.char_length(w) >= 2) & ~F.array_contains(stop, w))
