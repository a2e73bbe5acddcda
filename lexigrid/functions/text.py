"""Scalar text functions: type inference, spans, keys and renderings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "▁"


def type_from_name(name: Column, given: Column | None = None, prefixes: tuple[tuple[str, str], ...] = (("wiki17", "wikipedia"), ("web13", "blogs_and_forums"))) -> Column:
    """A given type stays; else the first prefix of the name that fits; else unknown."""
    out = F.lit("unknown")
    for prefix, kind in reversed(prefixes):
        out = F.when(name.startswith(prefix), kind).otherwise(out)
    return out if given is None else F.coalesce(F.nullif(given, F.lit("")), out)


#: Prefixes of the second corpus.
TREEBANK_TYPES = (("aja", "periodicals"), ("ilu", "fiction"), ("arborest", "fiction"), ("tea", "science"))


def treebank_type(name: Column) -> Column:
    """The type of a treebank file by the start of its name, else unknown."""
    return type_from_name(name, prefixes=TREEBANK_TYPES)


def clean_marks(token: Column) -> Column:
    """The subword mark becomes a blank; blanks at the ends go."""
    return F.trim(F.translate(token, MARK, " "))


def is_silent(token: Column) -> Column:
    """nothing is left of the token without its mark."""
    return clean_marks(token) == ""


def span_text(text: Column, start: Column, end: Column) -> Column:
    """Text of the half-open, zero-based span."""
    return F.substring(text, start + 1, end - start)


def mark_span(text: Column, start: Column, end: Column) -> Column:
    """The span between angle brackets."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit("<"), span_text(text, start, end), F.lit(">"), F.substring(text, end + 1, F.length(text)))


def substitute_span(text: Column, start: Column, end: Column, candidate: Column) -> Column:
    """P16."""
    return F.overlay(text, candidate, start + 1, end - start)


def span_matches(text: Column, start: Column, end: Column, word: Column) -> Column:
    """The span's text is the word, whatever the case: small letters or capitals are the same, as those of ``ß`` and ``SS``."""
    span = span_text(text, start, end)
    return (F.lower(span) == F.lower(word)) | (F.upper(span) == F.upper(word))


def sentence_key(source: Column, sentence_id: Column) -> Column:
    """P18."""
    return F.concat_ws("|||", source, sentence_id.cast("string"))


def count_and_share(n: Column, total: Column) -> Column:
    """``n / total (p%)``; a total of zero is an error."""
    share = F.when(total > 0, F.round(n * 100 / total, 2)).otherwise(F.raise_error(F.lit("total must be positive")).cast("double"))
    return F.concat(n.cast("string"), F.lit(" / "), total.cast("string"), F.lit(" ("), F.format_number(share, 2), F.lit("%)"))


def snippet(text: Column, start: Column, end: Column, around: int = 20) -> Column:
    """The span with some text on both sides, line ends written as ``\\n``."""
    lo = F.greatest(start - around, F.lit(0))
    hi = F.least(end + around, F.length(text))
    return F.replace(span_text(text, lo, hi), F.lit("\n"), F.lit("\\n"))


def safe_name(text: Column) -> Column:
    """Runs of characters that file names may not hold become one ``_``."""
    return F.regexp_replace(text, r"[^\w\-.]+", "_")


def mapped(value: Column, names: dict[str, str]) -> Column:
    """P25: the display name, or the value itself."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value) if pairs else value


def span_array(start: Column, end: Column) -> Column:
    """P26."""
    return F.array(start.cast("int"), end.cast("int"))


def rounded(p: Column) -> Column:
    """P27."""
    return F.round(p, 5)


def feature_map(feats: Column) -> Column:
    """P20: ``K=V|K=V`` as a map. Pieces that are not one pair are dropped; of a repeated key the last stays."""
    pieces = F.filter(F.transform(F.split(F.coalesce(feats, F.lit("")), r"\|"), lambda p: F.split(p, "=")), lambda p: F.size(p) == 2)
    # as the one item of an array the pieces are a variable of the filter, so they are split once, not once a piece
    last = F.transform(F.array(pieces), lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.greatest(F.size(ps), F.lit(1))), lambda q: q[0] == p[0])))[0]
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p[0].alias("k"), p[1].alias("v"))))


def clean_lemma(lemma: Column) -> Column:
    """``=`` goes only between letters."""
    return F.regexp_replace(lemma, r"(?<=\p{L})=(?=\p{L})", "")


def pick_file(name: Column) -> Column:
    """struct(inflection_type, n, pick) of a pick file's name, null if it is none; the first pick has no number."""
    pattern = r"infl_type_(\d+)_randomly_picked_(\d+)_sentences(?:_pick_(\d+))?\.jl$"
    pick = F.regexp_extract(name, pattern, 3)
    parts = F.struct(F.regexp_extract(name, pattern, 1).cast("int").alias("inflection_type"), F.regexp_extract(name, pattern, 2).cast("int").alias("n"), F.when(pick == "", 1).otherwise(pick.try_cast("int")).alias("pick"))
    return F.when(name.rlike(pattern), parts)
