"""Problem 5: sentences of texts in any language and script, in SQL expressions alone.

Terminators that end nothing (in decimals, web addresses, initials, abbreviations,
German ordinals, and quotations that their sentence carries on) are masked by private-use
characters of the same length; the masked text is split by the terminators of its scripts;
the units' lengths give their places, and the units are read from the text as it was.

Null and blank texts have no sentences. The last sentence ends with the text, white space
at its end apart. Rows repeated under one key count once. Everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Terminators, and the private-use characters that stand for them while masked.
MARKS = ".!?…।؟。！？"
MASKS = "".join(chr(0xE000 + i) for i in range(len(MARKS)))
#: Abbreviations that never end a sentence (those that may, such as "etc.", need no mask: what follows them decides).
ABBREVIATIONS = (
    "Dr Prof Mr Mrs Ms St Jr Sr Sra Srta Mme Mlle Hr Fr "
    "Fig Figs Tab Ch Chap Sect Sec App Eq Eqs eq eqs No no Nos nos Nr Abb Kap Vgl vgl cf Cf vs viz ca approx max min resp al ed eds vol Vol pp "
    "Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec "
    "bzw bspw evtl ggf inkl sog Bd Hrsg "
    "env av éd chap fig art "
    "EE pág págs núm ej cap vid "
    "проф акад см рис табл гл тыс млн им доц "
    "डॉ प्रो"
).split()
BLOCK = 256
_SPACE = r"\s  "
SPACES = " \t\n\x0b\f\r" + _SPACE[2:]
_CLOSE = rf"(?:[\"”’'»)\]“«›]|[{_SPACE}]»(?=[{_SPACE},.;:]|\z))*(?:\[\d+(?:[,–-]\s?\d+)*\])*"
_OPEN = rf"(?:[\"“„«»‘‚'(\[¿¡—–-][{_SPACE}]?)*"
_START = rf"{_OPEN}(?:[\p{{Lu}}\p{{Lt}}\p{{Lo}}\p{{N}}]|\p{{Ll}}{{1,2}}\p{{Lu}})"
_NEXT = rf"(?=[{_SPACE}]*\z|[{_SPACE}]+{_START})"
_ENDS = ".!?…।॥؟۔。！？"
#: A terminator ends a sentence before white space and a beginning; also where that space was lost between two words.
_LATIN = rf"[.!?…।॥؟۔]++{_CLOSE}{_NEXT}|[.!?]++(?<=[\p{{Ll}})\d][.!?]{{1,3}})(?:\[\d+\])*(?=\p{{Lu}}\p{{Ll}})|[.!?]++(?<=[\p{{L}})][.!?]{{1,3}})\[\d+\](?=[{_SPACE}]*[\p{{Lu}}\p{{N}}])"
_WIDE = r"[。！？]++[”’」』）】\"]*"
#: Runs without a terminator are passed at once; only at a terminator it is asked whether the sentence ends.
UNIT = rf"(?=[{_SPACE}]*[^{_SPACE}])(?:[^{_ENDS}]++|(?!{_LATIN}|{_WIDE})[{_ENDS}]++)*+(?:{_LATIN}|{_WIDE}|\z)"

#: What carries a quotation on: a comma or dash after it, a word in lower case, or a Japanese particle.
_ON = rf"(?=[{_SPACE}]*[,;:，；]|[{_SPACE}]*[—–-][{_SPACE}]*\p{{Ll}}|[{_SPACE}]+(?!\p{{Ll}}{{1,2}}\p{{Lu}})\p{{Ll}}|[とはをがのにでもっ、])"
QUOTES = "|".join(rf"{a}[^{a}{b}]*{b}" for a, b in (("“", "”"), ("„", "“"), ("«", "»"), ("»", "«"), ("「", "」"), ("『", "』")))
#: A quotation that a colon opens belongs to its sentence; only its own end may end that.
SAID, SAID_END = r"[:：]\s?[“「][^“”「」]*[^“”「」。！？.!?]", r"(?=[。！？.!?]+[”」])"
ADDRESS = r"(?:https?://|www\.)[^\s<>]*[^\s<>.,;:!?)\]”»]|[\p{L}\p{N}._-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"


#: A full stop in a decimal (also without its zero), after an initial or single letter (but not "p.m." and "и т. д." before a beginning), or after an abbreviation.
#: The stop itself comes first, so that all other characters are passed at once.
_WORD_BEFORE = r"(?<![\p{L}\p{M}\p{N}])"
NO_END = (
    r"\.(?:(?=\d)(?:(?<=\d\.)|(?<=(?<![\p{L}\p{N})\]])\.))"
    + rf"|(?<={_WORD_BEFORE}\p{{L}}\p{{M}}{{0,4}}\.)(?!(?<=[ap]\.m\.|т\.\sд\.|т\.д\.)[{_SPACE}]+\p{{Lu}})"
    + rf"|(?=[{_SPACE},;)\p{{L}}\p{{N}}(])(?<={_WORD_BEFORE}(?:{'|'.join(ABBREVIATIONS)})\.))"
)


def masked_within(text: Column, pattern: str, after: str = "", opens: str | None = None) -> Column:
    """The text with every terminator masked inside a match of the pattern that `after` follows; `opens` are the characters a match may begin with."""
    found = rf"(?:{pattern}){after}"
    rest = rf"[^{opens}]+|." if opens else rf".+?(?={found}|\z)"
    parts = F.regexp_extract_all(text, F.lit(rf"(?s){found}|{rest}"), F.lit(0))
    # A part is a match as a whole or holds none; what follows it is not in it, so only its form is asked.
    each = F.transform(parts, lambda p: F.when(p.rlike(rf"(?s)\A(?:{pattern})\z"), F.translate(p, MARKS, MASKS)).otherwise(p))
    return F.when(text.rlike(found), F.array_join(each, "")).otherwise(text)


def masked(df: DataFrame, name: str) -> DataFrame:
    """`df` with all terminators of the text column `name` masked that end no sentence; lengths stay.

    Each step is a column of its own, as the next reads it more than once, and is taken only where its marks stand.
    """
    text, dot = F.col(name), MASKS[0]
    german = text.rlike(r"\d\.\s+\p{Lu}") & text.rlike(r"(?i)(?<!\p{L})(?:der|die|das|und|den|dem)(?!\p{L})")
    where = lambda found, step: F.when(found, step).otherwise(text)
    quoted = text.contains("“") | text.contains("„") | text.contains("«") | text.contains("»") | text.contains("「") | text.contains("『")
    steps = [
        where(text.contains("www.") | text.contains("://") | text.contains("@"), masked_within(text, ADDRESS)),
        where(text.contains("."), F.regexp_replace(text, NO_END, dot)),
        where(german, F.regexp_replace(text, rf"(?<![\p{{N}}\p{{L}}.,])(\d{{1,2}})\.(?=[{_SPACE}]+\p{{L}})", "$1" + dot)),
        where(quoted, masked_within(text, QUOTES, _ON, "“„«»「『")),
        where((text.contains(":") | text.contains("：")) & quoted, masked_within(text, SAID, SAID_END, ":：")),
    ]
    for step in steps:
        df = df.withColumn(name, step)
    return df


def with_places(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """`df` with an array column `name` of (i, begin, end): the text's sentences, numbered from 1, with the code points before and up to the end of each.

    White space at the text's end is in no sentence; a unit that lies in it ends before it begins. Null and blank texts have none.
    """
    rows = masked(df.withColumn("_m", F.col(text_col)), "_m")
    sizes = F.transform(F.regexp_extract_all("_m", F.lit(UNIT), F.lit(0)), lambda p: F.length(p))
    total = lambda part: F.aggregate(part, F.lit(0), lambda t, n: t + n)
    # Running sums by whole blocks and a rest, so that very long texts stay far from the square of their sentences.
    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size("_n") / BLOCK).cast("int")), lambda b: total(F.slice("_n", b * BLOCK + 1, F.lit(BLOCK))))
    full = lambda i: F.floor(i / BLOCK).cast("int")
    upto = lambda i: total(F.slice("_b", F.lit(1), full(i))) + total(F.slice("_n", full(i) * BLOCK + 1, i % BLOCK))
    places = F.transform(F.sequence(F.lit(1), F.size("_n")), lambda i: F.struct(i.alias("i"), upto(i - 1).alias("begin"), F.least(upto(i), F.col("_w")).alias("end")))
    rows = rows.withColumn("_w", F.length(F.rtrim(F.col(text_col), F.lit(SPACES)))).withColumn("_n", sizes).withColumn("_b", blocks)
    none = F.array().cast("array<struct<i:int,begin:int,end:int>>")
    return rows.withColumn(name, F.when(F.size("_n") > 0, places).otherwise(none)).drop("_m", "_w", "_n", "_b")


def sentences(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, sentence, text, sent_end): the sentences of each text, numbered from 1.

    One narrow pass over the texts as they lie, so a key delivered twice is split twice; of the results one is kept.
    """
    rows = df.select(*keys, F.col(text_col).alias("_t")).filter(F.col("_t").rlike(rf"[^{_SPACE}]"))
    # Outer, and filtered by nothing but what it yields: else the planner asks the whole chain of masks, many times over, in a filter beneath it.
    rows = with_places(rows, "_t", "_u").select(*keys, "_t", F.explode_outer("_u").alias("_u")).filter("_u.end > _u.begin")
    rows = rows.select(*keys, "_t", F.col("_u.i").alias("_i"), F.col("_u.begin").alias("_begin"), F.col("_u.end").alias("sent_end"))
    text = F.btrim(F.substring("_t", F.col("_begin") + 1, F.col("sent_end") - F.col("_begin")), F.lit(SPACES))
    return rows.select(*keys, F.col("_i").alias("sentence"), text.alias("text"), "sent_end").dropDuplicates([*keys, "sentence"])
