"""Treebank annotations to the reduced tag set. Rules are tables and when-chains; of several that fit the last one stands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigrid.session import cut

#: Case codes of the reduced form.
CASES = {
    "Nom": "n", "Gen": "g", "Par": "p", "Ill": "ill", "Ine": "in", "Ela": "el", "All": "all", "Ade": "ad", "Abl": "abl",
    "Tra": "tr", "Ter": "ter", "Ess": "es", "Abe": "ab", "Com": "kom", "Add": "adt", "Dat": "all",
}
#: Lemmas of the negative auxiliary.
NEGATIVE_WORDS = ("ära", "ei")
NUMBERS = {"Sing": "sg", "Plur": "pl"}
#: Verb forms as (polarity, conditions, form); ``-`` means that the feature must be absent. Later rows stand over earlier ones.
VERB_FORMS = (
    ("", "VerbForm=Inf", "da"),
    ("", "VerbForm=Sup Voice=Act Case=Ill", "ma"), ("", "VerbForm=Sup Voice=Act Case=Ine", "mas"), ("", "VerbForm=Sup Voice=Act Case=Ela", "mast"),
    ("", "VerbForm=Sup Voice=Act Case=Tra", "maks"), ("", "VerbForm=Sup Voice=Act Case=Abe", "mata"), ("", "VerbForm=Sup Voice=Pass", "tama"),
    ("", "VerbForm=Part Tense=Past Voice=Act", "nud"), ("", "VerbForm=Part Tense=Past Voice=Pass", "tud"), ("", "VerbForm=Conv", "des"),
    ("neg", "negaux", "neg"),
    ("neg", "Voice=Act Mood=Ind Tense=Pres", "neg o"), ("neg", "Voice=Act Mood=Imp Tense=Pres Person=2 Number=Sing", "o"),
    ("neg", "Voice=Act Mood=Imp Tense=Pres Person=2 Number=Plur", "neg ge"), ("neg", "Voice=Act Mood=Imp Tense=Pres Person=3 Number=Plur", "neg gu"),
    ("neg", "Voice=Act Mood=Ind Tense=Past", "neg nud"), ("neg", "Voice=Act Mood=Cnd Tense=Pres", "neg ks"), ("neg", "Voice=Pass Mood=Ind Tense=Pres", "ta"),
    ("aff", "Mood=Ind Tense=Pres Person=1 Number=Sing", "n"), ("aff", "Mood=Ind Tense=Pres Person=1 Number=Plur", "me"), ("aff", "Mood=Ind Tense=Pres Person=2 Number=Sing", "d"),
    ("aff", "Mood=Ind Tense=Pres Person=2 Number=Plur", "te"), ("aff", "Mood=Ind Tense=Pres Person=3 Number=Sing", "b"), ("aff", "Mood=Ind Tense=Pres Person=3 Number=Plur", "vad"),
    ("aff", "Mood=Ind Tense=Pres Voice=Pass Person=-", "takse"),
    ("aff", "Mood=Ind Tense=Past Person=1 Number=Sing", "sin"), ("aff", "Mood=Ind Tense=Past Person=1 Number=Plur", "sime"), ("aff", "Mood=Ind Tense=Past Person=2 Number=Sing", "sid"),
    ("aff", "Mood=Ind Tense=Past Person=2 Number=Plur", "site"), ("aff", "Mood=Ind Tense=Past Person=3 Number=Sing", "s"), ("aff", "Mood=Ind Tense=Past Person=3 Number=Plur", "sid"),
    ("aff", "Mood=Ind Tense=Past Voice=Pass Person=-", "ti"),
    ("aff", "Mood=Imp Tense=Pres Voice=Act Number=Sing Person=-", "gu"), ("aff", "Mood=Imp Tense=Pres Voice=Act Number=Sing Person=2", "o"), ("aff", "Mood=Imp Tense=Pres Voice=Act Number=Sing Person=3", "gu"),
    ("aff", "Mood=Imp Tense=Pres Voice=Act Number=Plur Person=1", "gem"), ("aff", "Mood=Imp Tense=Pres Voice=Act Number=Plur Person=2", "ge"), ("aff", "Mood=Imp Tense=Pres Voice=Act Number=Plur Person=3", "gu"),
    ("aff", "Mood=Qot Tense=Pres Voice=Act", "vat"), ("aff", "Mood=Qot Tense=Pres Voice=Pass", "tavat"),
    ("aff", "Mood=Cnd Tense=Pres Voice=Act Person=1 Number=Sing", "ksin"), ("aff", "Mood=Cnd Tense=Pres Voice=Act Person=2 Number=Sing", "ksid"), ("aff", "Mood=Cnd Tense=Pres Voice=Act Person=3 Number=Sing", "ks"),
    ("aff", "Mood=Cnd Tense=Pres Voice=Act Person=1 Number=Plur", "ksime"), ("aff", "Mood=Cnd Tense=Pres Voice=Act Person=2 Number=Plur", "ksite"), ("aff", "Mood=Cnd Tense=Pres Voice=Act Person=3 Number=Plur", "ksid"),
    ("aff", "Mood=Cnd Tense=Pres Voice=Act Person=-", "ks"),
    ("aff", "Mood=Cnd Tense=Past Voice=Act Person=1 Number=Sing", "nuksin"), ("aff", "Mood=Cnd Tense=Past Voice=Act Person=2 Number=Sing", "nuksid"), ("aff", "Mood=Cnd Tense=Past Voice=Act Person=3 Number=Sing", "nuks"),
    ("aff", "Mood=Cnd Tense=Past Voice=Act Person=1 Number=Plur", "nuksime"), ("aff", "Mood=Cnd Tense=Past Voice=Act Person=2 Number=Plur", "nuksite"), ("aff", "Mood=Cnd Tense=Past Voice=Act Person=3 Number=Plur", "nuksid"),
    ("", "Mood=Cnd Tense=Pres Voice=Pass Number=- Person=-", "taks"),
)


def _last(rules: list[tuple[Column, Column | str]], start: Column) -> Column:
    """The value of the last rule that holds, else ``start``."""
    out = start
    for cond, value in rules:
        out = F.when(cond, value).otherwise(out)
    return out


def corrected(tokens: DataFrame, lemma_mode: str = "strip") -> DataFrame:
    """Treebank corrections over lemma, upostag, xpostag, feats (map). Modes for verb lemmas: strip, ma or keep."""
    feats = F.coalesce("feats", F.create_map().cast("map<string,string>"))
    up, lemma, x = F.col("upostag"), F.col("lemma"), F.col("xpostag")
    filled = F.coalesce(x, F.when(up == "CCONJ", "J").when(up == "PRON", "P").when((up == "AUX") & (lemma == "olema"), "V").when((up == "NOUN") | ((up == "SYM") & (lemma == "%")), "S").when(up == "PUNCT", "Z").when(up == "X", "N").otherwise(F.raise_error(F.concat(F.lit("no xpos for upos "), F.coalesce(up, F.lit("null"))))))
    ending = "(ma|nud|tud|dud)$"
    verb = {"strip": F.regexp_replace(lemma, ending, ""), "ma": F.regexp_replace(lemma, ending, "ma"), "keep": lemma}[lemma_mode]
    f = lambda k: F.try_element_at(feats, F.lit(k))
    ordinal = F.coalesce((filled == "N") & (up == "ADJ") & (f("NumType") == "Ord") & (f("NumForm").isNull() | (f("NumForm") == "Digit")), F.lit(False))
    noun = F.coalesce((filled == "V") & (up == "NOUN") & (lemma == "lihtsus"), F.lit(False))
    return tokens.withColumns({
        "feats": feats, "lemma": F.when(x == "V", verb).otherwise(lemma), "upostag": F.when(ordinal, "NUM").otherwise(up),
        "xpostag": F.when(ordinal, "O").when(noun, "S").otherwise(filled),
    })


def reduced_pos(upos: Column, xpos: Column, feats: Column) -> Column:
    """U2."""
    f = lambda k: F.try_element_at(feats, F.lit(k))
    number = (upos == "NUM") | ((upos == "ADJ") & f("NumType").isNotNull())
    return _last([
        ((upos == "PROPN") & (xpos == "S"), F.lit("H")), (f("Degree") == "Cmp", F.lit("C")), (f("Degree") == "Sup", F.lit("U")),
        (number & (f("NumType") == "Card"), F.lit("N")), (number & (f("NumType") == "Ord"), F.lit("O")),
        (xpos == "B", F.lit("I")), (xpos == "E", F.lit("Z")), ((xpos == "nominal") & (upos == "SYM"), F.lit("Z")),
    ], xpos)


def nominal_form(feats: Column) -> Column:
    """Number and case code; ``adt`` has no number; without number or case the empty form. An unknown case is an error."""
    f = lambda k: F.try_element_at(feats, F.lit(k))
    table = lambda d, c: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), c)
    case = F.when(f("Case").isNotNull(), F.coalesce(table(CASES, f("Case")), F.raise_error(F.concat(F.lit("unknown case "), f("Case")))))
    return F.when(f("Number").isNull() | f("Case").isNull(), "").when(case == "adt", "adt").otherwise(F.concat_ws(" ", table(NUMBERS, f("Number")), case))


def verb_form(upos: Column, xpos: Column, lemma: Column, feats: Column, start: Column) -> Column:
    """U4: only for xpos V, else ``start``; of several rules that fit the last one stands.

    A verb with number and case is an error. Rules that ask for the same features are one look-up by their values.
    """
    f = lambda k: F.try_element_at(feats, F.lit(k))
    negative = F.coalesce(f("Polarity") == "Neg", F.lit(False)) | F.coalesce(f("Connegative") == "Yes", F.lit(False))
    negaux = (upos == "AUX") & lemma.isin(*NEGATIVE_WORDS)
    tables: dict[tuple, dict[str, tuple[int, str]]] = {}
    for place, (polarity, conditions, form) in enumerate(VERB_FORMS):
        wanted = dict(c.split("=") for c in conditions.split() if "=" in c)
        tables.setdefault((polarity, "negaux" in conditions, *sorted(wanted)), {})["|".join(wanted[k] for k in sorted(wanted))] = place, form
    found = []
    for (polarity, aux, *names), table in tables.items():
        fits = {"neg": negative, "aff": ~negative, "": F.lit(True)}[polarity]
        key = F.concat_ws("|", *[F.coalesce(f(k), F.lit("-")) for k in names]) if names else F.lit("")
        pairs = [x for k, (place, form) in table.items() for x in (F.lit(k), F.struct(F.lit(place).alias("place"), F.lit(form).alias("form")))]
        found.append(F.when(fits & negaux if aux else fits, F.try_element_at(F.create_map(*pairs), key)))
    form = F.coalesce(F.greatest(*found)["form"], start)
    odd = f("Number").isNotNull() & f("Case").isNotNull()
    error = F.raise_error(F.concat(F.lit("a verb with number and case: "), F.coalesce(lemma, F.lit("null")), F.lit(" "), start)).cast("string")  # an unknown case comes first
    return F.when((xpos == "V") & odd, error).when(xpos == "V", form).otherwise(start)


#: Distinct inputs of the rules that are broadcast at most; a treebank has a few thousand.
FEW_INPUTS = 50_000


def reduced(tokens: DataFrame) -> DataFrame:
    """Form and pos columns of every token (upostag, xpostag, lemma, feats map).

    The rules look at the tags, the features and for a few words at the lemma, so they are followed once for each
    distinct input and joined back to the tokens by it, by broadcast if there are few of them, as in any treebank. Null
    tags and features are inputs like others. Features in another order are the same input.
    """
    odd = F.try_element_at("feats", F.lit("Number")).isNotNull() & F.try_element_at("feats", F.lit("Case")).isNotNull()
    lemma = F.when(F.col("lemma").isin(*NEGATIVE_WORDS) | (odd & (F.col("xpostag") == "V")), F.col("lemma"))  # the second is an error that names it
    names = ["__up", "__x", "__lemma", "__feats"]
    keyed = tokens.withColumns(dict(zip(names, (F.col("upostag"), F.col("xpostag"), lemma, F.array_sort(F.map_entries("feats"))), strict=True)))
    keyed = keyed.withColumn("__key", F.to_json(F.struct(*names), {"ignoreNullFields": "false"}))
    inputs = keyed.groupBy("__key").agg(*[F.first(n).alias(n) for n in names])
    feats = F.map_from_entries("__feats")
    form = verb_form(F.col("__up"), F.col("__x"), F.col("__lemma"), F.col("__f"), nominal_form(F.col("__f")))
    known = cut(inputs.withColumn("__f", feats)).select("__key", reduced_pos(F.col("__up"), F.col("__x"), F.col("__f")).alias("pos"), form.alias("form"))
    known = cut(known)
    out = keyed.drop("pos", "form").join(F.broadcast(known) if known.count() <= FEW_INPUTS else known, "__key")
    return out.drop("__key", *names)


def reduced_layer(layer: DataFrame, annotations: str = "annotations") -> DataFrame:
    """A layer's spans with the form and pos of every annotation in their array (structs of upostag, xpostag, lemma, feats map)."""

    def of(a: Column) -> Column:
        up, x, lemma, feats = (a[c] for c in ("upostag", "xpostag", "lemma", "feats"))
        return F.struct(verb_form(up, x, lemma, feats, nominal_form(feats)).alias("form"), reduced_pos(up, x, feats).alias("pos"), lemma.alias("lemma"))

    return layer.withColumn(annotations, F.transform(annotations, of))


def document_names(docs: DataFrame, file: str, tid: str) -> DataFrame:
    """U6."""
    return docs.withColumn("document", F.format_string("%s_%03d.json", F.col(file), F.col(tid)))
