"""Sentences, clauses, cause/effect, cleaning, keywords and token arrays."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .keys import _col

# fixed values: a sentence, from a capital letter to the closing mark
SENTENCE_START, SENTENCE_END = r"[A-Z]{1}[^\._!?]*", r"\s+[^.!?\n]*"
SENTENCE = SENTENCE_START + SENTENCE_END
# fixed values: marks of sections and paragraphs in the corpus
MARKERS = ("\n_START_SECTION_\n", "\n_START_PARAGRAPH_\n")
SPACES = r"(?U)\s+"


def ascii_only(col) -> Column:
    """Drop every character outside ASCII."""
    return F.regexp_replace(_col(col), r"[^\x00-\x7F]", "")


def strip_markers(col, markers=MARKERS) -> Column:
    """Prepare running text for sentence extraction: dotted abbreviations, tildes and corpus markers."""
    out = _col(col)
    for old, new in (("e.g.", "eg"), ("i.e.", "ie"), ("~", "-"), *((m, ". ") for m in markers)):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def words(col) -> Column:
    """Array of the words between white space."""
    return F.filter(F.split(_col(col), SPACES), lambda w: w != "")


def word_count(col) -> Column:
    return F.size(words(col))


def quoted(word: str) -> str:
    """A word as itself in a regular expression, whatever characters it has."""
    return r"\Q" + word.replace(r"\E", r"\E\\E\Q") + r"\E"


def keyword_pattern(keywords) -> str:
    """Case-insensitive whole-word test for any keyword; letters of any alphabet bound a word."""
    return r"(?iU)\b(" + "|".join(quoted(k) for k in keywords) + r")\b"


def contains_keyword(col, keywords) -> Column:
    return _col(col).rlike(keyword_pattern(keywords))


def sentences(col, pattern: str = SENTENCE) -> Column:
    """Array of sentences: from a capital letter to the closing mark."""
    return F.regexp_extract_all(_col(col), F.lit(pattern), F.lit(0))


def clauses_with_keyword(sentence, keywords, min_words: int = 6) -> Column:
    """Array of struct(clause_ref, text) for one sentence.

    Clauses are the parts between commas that have at least ``min_words`` words, one of them exactly
    a keyword. A sentence with no such clause is returned whole with clause_ref -1.
    """
    sentence = _col(sentence)
    parts = F.transform(
        F.split(sentence, ","),
        lambda part, i: F.struct(i.alias("clause_ref"), F.regexp_replace(part, r"(?U)^\s+|\s+$", "").alias("text")))
    wanted = F.array(*[F.lit(k) for k in keywords])

    def qualifies(part):
        tokens = words(part["text"])
        return (F.size(tokens) >= min_words) & F.arrays_overlap(tokens, wanted)

    whole = F.array(F.struct(F.lit(-1).alias("clause_ref"), sentence.alias("text")))
    kept = F.filter(parts, qualifies)
    return F.when((F.size(parts) == 1) | (F.size(kept) == 0), whole).otherwise(kept)


def around_keyword(sentence, keyword: str) -> tuple[Column, Column]:
    """(before, after) the first appearance of a connective; both parts must be non-empty, else NULL."""
    sentence = _col(sentence)
    at = F.instr(sentence, keyword)
    before = F.substr(sentence, F.lit(1), at - 1)
    after = F.substr(sentence, at + F.lit(len(keyword)))
    ok = at > 1
    return F.when(ok, before), F.when(ok & (after != ""), after)


def first_keyword(col, keywords) -> Column:
    """The first keyword, in list order, that appears as a whole word after a space; NULL when none does."""
    col = _col(col)
    tests = [F.when(col.rlike(r"(?U)\s" + quoted(k) + r"\b"), F.lit(k)) for k in keywords]
    return F.coalesce(*tests)


def keyword_positions(col, keywords) -> Column:
    """0-based position of each keyword in the text, -1 when absent, in list order."""
    return F.array(*[F.instr(_col(col), k) - 1 for k in keywords])


def clean_tokens(col) -> Column:
    """Lower-case tokens without tags, punctuation, digits and repeated spaces."""
    out = F.lower(_col(col))
    out = F.regexp_replace(out, r"<([^>]+)>", "")
    out = F.regexp_replace(out, r"[!-/:-@\[-`{-~]+", " ")
    out = F.regexp_replace(out, r"[0-9]+", "")
    return F.filter(F.split(out, r"\s+"), lambda w: w != "")


def term_tokens(col, min_len: int = 2) -> Column:
    """Lower-case runs of letters, digits or underscores of at least ``min_len`` characters."""
    return F.regexp_extract_all(F.lower(_col(col)), F.lit(r"[\p{L}\p{N}_]{%d,}" % min_len), F.lit(0))


def join_wordpieces(pieces, open_mark: str = "[CLS]", close_mark: str = "[SEP]") -> Column:
    """Rebuild text from word pieces: ' ##' joins a piece to the one before; markers are dropped."""
    out = F.array_join(_col(pieces), " ")
    for mark in (" ##", open_mark, close_mark):
        out = F.replace(out, F.lit(mark), F.lit(""))
    return out


def token_positions(arr, wanted) -> Column:
    """0-based first positions of the wanted tokens that occur, in the order of ``wanted``."""
    arr = _col(arr)
    spots = F.array(*[F.array_position(arr, w) for w in wanted])
    return F.transform(F.filter(spots, lambda p: p > 0), lambda p: (p - 1).cast("int"))


def pad_tokens(arr, length: int, pad=0) -> Column:
    """Pad to ``length`` with padding inserted before the closing token; longer arrays are left as they are."""
    arr = _col(arr)
    n = F.size(arr)
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0)))
    return F.when(n == 0, fill).otherwise(
        F.concat(F.slice(arr, F.lit(1), F.greatest(n - 1, F.lit(0))), fill, F.slice(arr, F.greatest(n, F.lit(1)), F.lit(1))))


def teacher_pairs(arr) -> tuple[Column, Column]:
    """(all but the last, all but the first) element."""
    arr = _col(arr)
    n = F.greatest(F.size(arr) - 1, F.lit(0))
    return F.slice(arr, F.lit(1), n), F.slice(arr, F.lit(2), n)


def padding_mask(arr, pad=0) -> Column:
    """1 where the element is padding, else 0."""
    return F.transform(_col(arr), lambda x: F.when(x == F.lit(pad), 1).otherwise(0))


def lookahead_mask(arr) -> Column:
    """Number of steps hidden from each step: step i of n (from 1) must not see the n - i that follow.

    The square mask is the rule "j > i"; it is never written out, since its size is the square of the text's length.
    """
    n = F.size(_col(arr))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: n - i)).otherwise(F.array().cast("array<int>"))
