"""Subtokens of words: offsets, first pieces, label sequences, and the top-label and annotation jobs over the scorer boundary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lexigrid.functions.text import MARK, clean_marks, is_silent
from lexigrid.operators.selection import IGNORED
from lexigrid.operators.spans import chunks, overlaps, piece_offsets

#: A tokenizer: the pieces of a text. ``load`` functions make one once a task.
Tokenizer = Callable[[str], list[str]]


#: Rows that Python holds at a time, read and found, whatever the batch.
READ_ROWS, FOUND_ROWS = 64, 16_384


def map_rows(df: DataFrame, ddl: str, load: Callable[[], Callable[..., Iterator[tuple]]]) -> DataFrame:
    """Rows to rows in Arrow batches: ``load`` once a task, its function once a row, which gives tuples of ``ddl``'s fields.

    What is found is handed on after FOUND_ROWS rows, in the midst of a text too, as one batch of texts may give millions.
    """
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_row = load()
        for batch in batches:
            rows = (row for at in range(0, batch.num_rows, READ_ROWS) for row in zip(*(c.to_pylist() for c in batch.slice(at, READ_ROWS).columns), strict=True))
            found = (out for row in rows for out in of_row(*row))
            while part := list(islice(found, FOUND_ROWS)):
                columns = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ddl)


def subtoken_spans(docs: DataFrame, load: Callable[[], Tokenizer], id_col: str = "doc_id", text_col: str = "text", offset: str | None = None) -> DataFrame:
    """(id, sub, piece, start, end) of each subtoken of a text; special pieces have null spans.

    ``offset`` names a column that is added to all places, for texts that are chunks of others. Null and
    empty texts give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def setup():
        tokenizer = load()

        def of_row(i, text, shift):
            pieces = tokenizer(text) if text else []
            for k, (piece, span) in enumerate(zip(pieces, piece_offsets(text or "", pieces), strict=True)):
                yield i, k, piece, *((span[0] + shift, span[1] + shift) if span else (None, None))

        return of_row

    rows = docs.select(F.col(id_col), F.col(text_col), F.col(offset).cast("int") if offset else F.lit(0))
    return map_rows(rows, f"`{id_col}` {kind}, sub int, piece string, start int, end int", setup)


def offsets_by_word(text: str, pieces: list[str], tokenizer: Tokenizer) -> list[tuple[int, int]]:
    """Spans of a text's pieces by tokenising its words again, one by one.

    Pieces that do not come in the words' order are an error. Inside a word a piece spans where its letters
    stand next; if they don't stand there, it spans the whole word.
    """
    out, k = [], 0
    for m in re.finditer(r"\S+", text):
        word, at = m.group(), 0
        for own in tokenizer(word):
            if k == len(pieces) or pieces[k] != own:
                raise ValueError(f"piece {k} is not {own!r}, the next one of {word!r}")
            body = own.replace(MARK, "")
            place = word.find(body, at) if body else at
            if place < 0:
                out.append(m.span())
            else:
                at = place + len(body)
                out.append((m.start() + place, m.start() + at))
            k += 1
    if k != len(pieces):
        raise ValueError(f"{len(pieces) - k} pieces belong to no word")
    return out


def subtoken_spans_by_word(docs: DataFrame, load: Callable[[], Tokenizer], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """X2b over a table: (id, sub, piece, start, end)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def setup():
        tokenizer = load()

        def of_row(i, text):
            pieces = [p for w in (text or "").split() for p in tokenizer(w)]
            for k, (piece, span) in enumerate(zip(pieces, offsets_by_word(text or "", pieces, tokenizer), strict=True)):
                yield i, k, piece, *span

        return of_row

    return map_rows(docs.select(F.col(id_col), F.col(text_col)), f"`{id_col}` {kind}, sub int, piece string, start int, end int", setup)


def unmatched_subtokens(words: DataFrame, subtokens: DataFrame, key: str = "doc_id", piece: str = "piece") -> DataFrame:
    """Subtokens with a span and some text that no word takes."""
    real = subtokens.where(F.col("start").isNotNull() & ~is_silent(F.col(piece)))
    taken = overlaps(words, real, key).select(key, F.col("b_start").alias("start"), F.col("b_end").alias("end")).distinct()
    return real.join(taken, [key, "start", "end"], "left_anti")


#: A decorator of X4: from a word's subtokens, an array of (sub, piece, labels) in order, to the columns the word gets.
Decorator = Callable[[Column], dict[str, Column]]


def first_labels(parts: Column) -> dict[str, Column]:
    """The decorator of X4 unless another is given: the labels of the first subtoken."""
    return {"labels": parts[0]["labels"]}


def first_subtoken(mapping: DataFrame, by: list[str], sub: str = "sub", labels: str = "labels", piece: str = "piece", decorator: Decorator = first_labels) -> DataFrame:
    """Each word takes what the decorator makes of its subtokens and keeps the list of its pieces, marks cleaned.

    ``mapping`` has one row for each word and subtoken of it. The decorator's columns stay inside the plan, like any others.
    """
    parts = F.sort_array(F.collect_list(F.struct(F.col(sub).alias("sub"), F.col(piece).alias("piece"), F.col(labels).alias("labels"))))
    whole = mapping.groupBy(*by).agg(parts.alias("__x"))
    made = decorator(F.col("__x"))
    return whole.select(*by, *[c.alias(labels if n == "labels" else n) for n, c in made.items()], F.transform("__x", lambda p: clean_marks(p["piece"])).alias("pieces"))


def tag_words(docs: DataFrame, words: DataFrame, load: Callable[[], Callable[[str], list[tuple[str, list[tuple[str, float]]]]]], top: int = 3, id_col: str = "doc_id", most: int = 1000) -> DataFrame:
    """M6: top labels of each word: X1 chunks, a tagger over chunks, X3 words of its subtokens, X4 first subtoken.

    The tagger gives (piece, [(label, probability), ..]) for each subtoken of a chunk. ``words`` are spans
    (id, start, end). A word without a subtoken is left out. Probabilities have five decimals; labels of
    one probability go by name.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def setup():
        tagger = load()

        def of_row(i, chunk, start, text):
            found = tagger(text)
            spans = piece_offsets(text, [p for p, _ in found])
            for k, ((piece, scores), span) in enumerate(zip(found, spans, strict=True)):
                if span:
                    best = sorted(((-round(p, 5), label) for label, p in scores))[:top]
                    yield i, chunk * (most + 2) + k, piece, span[0] + start, span[1] + start, [{"label": x, "probability": -p} for p, x in best]

        return of_row

    parts = chunks(docs, id_col, most=most).select(id_col, "chunk", "start", "piece")
    tagged = map_rows(parts, f"`{id_col}` {kind}, sub int, piece string, start int, end int, labels array<struct<label:string,probability:double>>", setup)
    pairs = overlaps(words.select(id_col, "start", "end"), tagged, id_col)
    mapping = pairs.join(tagged.select(id_col, F.col("start").alias("b_start"), F.col("end").alias("b_end"), "sub", "piece", "labels"), [id_col, "b_start", "b_end"])
    return first_subtoken(mapping.withColumnsRenamed({"w_start": "start", "w_end": "end"}), [id_col, "start", "end"])


def encode_words(rows: DataFrame, load: Callable[[], Tokenizer], label_ids: DataFrame, by: list[str], most: int = 512, ends: tuple[str, str] = ("[CLS]", "[SEP]"), double_end: bool = False, unknown: str = "[UNK]") -> DataFrame:
    """One sequence a sentence from word rows (by, pos, word, label): (by, pieces, label_ids, length).

    A word's first piece has its label's id and the others IGNORED, as have all pieces of a word whose label
    ``label_ids`` (label, id) lacks. A word without pieces gives ``unknown``. Pieces are cut to ``most`` less
    the end pieces; then come one end piece, or two, and the start piece in front. ``length`` is that of the
    sequence before padding; ``padded`` pads it.
    """
    ddl = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)

    def setup():
        tokenizer = load()
        return lambda *row: [(*row[:-2], tokenizer(row[-2]) or [unknown] if row[-2] else [unknown], row[-1])]

    known = label_ids.groupBy(F.col("label").alias("__l")).agg(F.max("id").alias("__id"))
    labelled = rows.join(known, F.col("label") == F.col("__l"), "left").select(*by, F.col("pos").cast("long").alias("pos"), "word", F.coalesce("__id", F.lit(IGNORED)).cast("int").alias("label_id"))
    pieced = map_rows(labelled, f"{ddl}, pos long, pieces array<string>, label_id int", setup)
    one = F.transform("pieces", lambda p, k: F.struct(p.alias("p"), F.when(k == 0, F.col("label_id")).otherwise(IGNORED).alias("l")))
    seq = pieced.withColumn("x", one).groupBy(*by).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda r: r["x"])).alias("x"))
    start, end = ends
    tail = F.array(*[F.struct(F.lit(end).alias("p"), F.lit(IGNORED).alias("l"))] * (2 if double_end else 1))
    cut = F.slice("x", 1, most - (3 if double_end else 2))
    whole = F.concat(F.array(F.struct(F.lit(start).alias("p"), F.lit(IGNORED).alias("l"))), cut, tail)
    return seq.select(*by, whole.alias("x")).select(*by, F.col("x.p").alias("pieces"), F.col("x.l").alias("label_ids"), F.size("x").alias("length"))


def padded(values: Column, most: int, fill: str | int) -> Column:
    """The array filled up to ``most`` places."""
    return F.concat(values, F.array_repeat(F.lit(fill), F.greatest(F.lit(most) - F.size(values), F.lit(0))))


def exact_spans(words: DataFrame, layer: DataFrame, by: list[str]) -> DataFrame:
    """Words with the annotations whose span is the same; words without one stay, with a null annotation."""
    return words.join(layer, [*by, "start", "end"], "left")


def annotate_rows(words: DataFrame, layer: DataFrame, by: list[str], order: str = "ann", pick: str = "first", seed: int = 1, label: str = "label") -> DataFrame:
    """M7: each row's label from the layer span that is exactly its own: the first analysis, or one by hash.

    ``ambiguous`` is true for more than one analysis; ``analyses`` is their number, and a row without one
    has a null label. ``order`` is the analyses' order column. The hash is of the seed, the row and the
    place, so a pick can be repeated.
    """
    if pick not in ("first", "random"):
        raise ValueError(pick)
    key = F.col(order) if pick == "first" else F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in [*by, "start", order]]).cast("binary")), F.col(order))
    one = layer.groupBy(*by, "start", "end").agg(F.min_by(label, key).alias("pred_label"), F.count(F.lit(1)).alias("analyses"))
    out = exact_spans(words, one, by)
    return out.withColumns({"analyses": F.coalesce("analyses", F.lit(0)), "ambiguous": F.coalesce(F.col("analyses") > 1, F.lit(False))})


def expand_suffixes(entities: DataFrame, words: DataFrame, by: list[str], suffixes: tuple[str, ...]) -> DataFrame:
    """An entity that one of the suffix words follows after one blank takes the word in."""
    w = words.where(F.lower("word").isin(*suffixes)).select(*by, (F.col("start") - 1).alias("end"), F.col("end").alias("__end"))
    return entities.join(w, [*by, "end"], "left").withColumn("end", F.coalesce("__end", "end")).drop("__end").select(*entities.columns)


def drop_inside(entities: DataFrame, by: list[str]) -> DataFrame:
    """Entities that lie inside a longer one go; of equal spans all stay.

    Ordered by start, then longest first, one lies inside another iff an earlier, longer one reaches its end.
    """
    w = Window.partitionBy(*by).orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    longest = F.max(F.struct(F.col("end").alias("e"), (-F.col("start")).alias("s"))).over(w)
    e = entities.withColumn("__m", longest)
    inside = (F.col("__m.e") > F.col("end")) | ((F.col("__m.e") == F.col("end")) & (-F.col("__m.s") < F.col("start")))
    return e.where(~F.coalesce(inside, F.lit(False))).drop("__m")
