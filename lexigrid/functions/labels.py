"""Label algebra: pure column functions over labels of the form ``form``, ``POS`` or ``form_POS``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDERS = ("-", "NONE")


def compose(form: Column, pos: Column) -> Column:
    """form_pos, or whichever part is there; ``_`` if neither is."""
    form, pos = F.coalesce(form, F.lit("")), F.coalesce(pos, F.lit(""))
    return F.when((form != "") & (pos != ""), F.concat(form, F.lit("_"), pos)).when(pos != "", pos).when(form != "", form).otherwise("_")


def compose_or_empty(form: Column, pos: Column) -> Column:
    """The older rule, where two empty parts give the empty label."""
    label = compose(form, pos)
    return F.when(label == "_", "").otherwise(label)


def is_pos(part: Column) -> Column:
    """A lone part is a part of speech iff it has letters and all are upper case."""
    return (F.upper(part) == part) & (F.lower(part) != part)


def decompose(label: Column) -> Column:
    """P5: struct(form, pos)."""
    parts = F.split(label, "_")
    one = F.size(parts) == 1
    first = parts[0]
    form = F.when(one, F.when(is_pos(first), "").otherwise(first)).otherwise(first)
    pos = F.when(one, F.when(is_pos(first), first).otherwise("")).otherwise(F.get(parts, F.lit(1)))
    return F.when(label.isNotNull(), F.struct(form.alias("form"), pos.alias("pos")))


def form_of(label: Column) -> Column:
    """The text before the first ``_``."""
    return F.split_part(label, F.lit("_"), F.lit(1))


def number_case(label: Column) -> Column:
    """struct(number, case), split at the first blank; without one the number is null."""
    at = F.instr(label, " ")
    number = F.when(at > 0, F.substring(label, F.lit(1), at - 1))
    case = F.when(at > 0, F.substring(label, at + 1, F.length(label))).otherwise(label)
    return F.when(label.isNotNull(), F.struct(number.alias("number"), case.alias("case")))


def lenient(label: Column) -> Column:
    """``adt`` if the words ill or all stand in the label."""
    return F.when(label.rlike(r"\b(ill|all)\b"), "adt").otherwise(label)


def other(label: Column) -> Column:
    """``other`` unless one of the words n, g, p, adt stands in the label."""
    return F.when(label.rlike(r"\b(n|g|p|adt)\b"), label).otherwise("other")


def lenient_frames(df: DataFrame, true_col: str = "true_label", pred_col: str = "pred_label") -> tuple[DataFrame, DataFrame]:
    """P10: (all rows with lenient labels and number/case parts, the same with labels mapped to other)."""
    full = df
    for c in (true_col, pred_col):
        full = full.withColumn(f"{c}_lenient", lenient(F.col(c)))
        for src in (c, f"{c}_lenient"):
            full = full.withColumns({f"{src}_number": number_case(F.col(src))["number"], f"{src}_case": number_case(F.col(src))["case"]})
    filtered = full.withColumns({f"{c}_lenient": other(F.col(f"{c}_lenient")) for c in (true_col, pred_col)})
    return full, filtered


def normalise_true(label: Column, missing: str = "missing_true_label") -> Column:
    """Text written like a one-element list gives the element; null or blank gives ``missing``."""
    inner = F.regexp_extract(label, r"^\[\s*['\"](.*?)['\"]\s*\]$", 1)
    return F.when(label.isNull() | (F.trim(label) == ""), missing).when(inner != "", inner).otherwise(label)


def first_of_list(label: Column, missing: str = "missing_true_label") -> Column:
    """P11 for array columns: the first element, or ``missing``."""
    return F.coalesce(F.try_element_at(label, F.lit(1)), F.lit(missing))


def parse_placeholders(text: str | None) -> tuple[str, ...]:
    """Comma-separated placeholders, upper-cased; the default pair if none is given."""
    found = {p.strip().upper() for p in (text or "").split(",") if p.strip()}
    return tuple(sorted(found)) or PLACEHOLDERS


def is_placeholder(label: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    return label.isNull() | (F.trim(label) == "") | F.upper(F.trim(label)).isin(*placeholders)


def normalise_placeholder(label: Column, placeholders: tuple[str, ...] = PLACEHOLDERS) -> Column:
    """Placeholders become the first of the set in order of text."""
    return F.when(is_placeholder(label, placeholders), min(placeholders)).otherwise(label)


def replace_values(df: DataFrame, mapping: dict[str, str], columns: list[str]) -> DataFrame:
    """P13."""
    return df.replace(mapping, subset=columns)


def vocabulary(forms: DataFrame, parts: DataFrame) -> DataFrame:
    """L1: form_POS products, then lone parts of speech, then lone forms, then ``?_POS``; duplicates stay.

    Both inputs are label inventories of a few dozen rows, one column each.
    """
    f, p = forms.toDF("form"), parts.toDF("pos")
    pieces = [
        f.crossJoin(p).select(compose(F.col("form"), F.col("pos")).alias("label")),
        p.select(F.col("pos").alias("label")), f.select(F.col("form").alias("label")),
        p.select(F.concat(F.lit("?_"), "pos").alias("label")),
    ]
    return reduce(DataFrame.unionAll, pieces)


def unknown_labels(df: DataFrame, vocab: DataFrame, label_col: str = "label") -> DataFrame:
    """F13, U4s: labels that the vocabulary lacks, with counts."""
    return df.groupBy(label_col).agg(F.count("*").alias("n")).join(vocab.select(F.col("label").alias(label_col)).distinct(), label_col, "left_anti")


def require_known(df: DataFrame, vocab: DataFrame, label_col: str = "label") -> None:
    """U4s: raise, naming up to 50 labels, if any is not in the vocabulary."""
    missing = [r[0] for r in unknown_labels(df, vocab, label_col).orderBy(label_col).limit(50).collect()]
    if missing:
        raise ValueError(f"labels without an id: {missing}")


def compare_vocabularies(a: DataFrame, b: DataFrame) -> DataFrame:
    """U2s: (label, status) with only_a, only_b, id_mismatch or same, over (label, id) tables; the last id counts."""
    x, y = (t.groupBy("label").agg(F.max("id").alias(n)) for t, n in ((a, "id_a"), (b, "id_b")))
    status = F.when(F.col("id_b").isNull(), "only_a").when(F.col("id_a").isNull(), "only_b").when(F.col("id_a") != F.col("id_b"), "id_mismatch").otherwise("same")
    return x.join(y, "label", "full").select("label", "id_a", "id_b", status.alias("status"))
