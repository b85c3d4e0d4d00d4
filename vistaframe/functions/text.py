"""Text of questions and answers: repair, normal forms, filters, paths, prompts. All of it stays in the JVM.

Patterns use ``(?U)``: word characters and boundaries are those of Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistaframe.functions.numbers import numbers_to_words, tokens

#: Literals that a CSV reader takes for missing; lower-case ``none`` is text. Fixed values.
NA_TOKENS = ("None", "n/a", "null", "NA", "nan")
#: Names that contain one of these are no objects to ask about. Fixed values.
STOP_WORDS = ("wall", "wal", "floor", "flor", "floro", "ceiling")
#: Whole-word repairs of questions and answers, in this order. Fixed values.
REPAIRS = (
    ("ouchs", "couches"), ("touches", "couches"), ("touchs", "couches"), ("hairs", "chairs"), ("what\\?", "hat"),
    ("divided", "divider"), ("divideds", "divider"), ("desk tops", "desktops"), ("desk top", "desktops"), ("ots", "tvs"),
    ("attress", "matterss"), ("chairperson", "chair"), ("water purified", "water purifier"), ("constable", "table"),
    ("loveseat", "couch"), ("mind fridge", "mini fridge"), ("chase", "chair"), ("hair", "chair"), ("so far", "sofa"),
    ("times", "tiles"), ("faiting", "painting"), ("shelling", "ceiling"), ("comfortable", "comforter"),
    ("protector screen", "projector screen"), ("current", "curtain"), ("chart", "trash"), ("atble", "table"),
    ("backet", "bucket"), ("auricle", "cubicle"), ("purified", "purifier"),
)
#: Repairs of questions only and of answers only, made before the others. Fixed values.
QUESTION_REPAIRS = (("red", "bed"),)
ANSWER_REPAIRS = (("what\\?", "hat"),)
#: Endings of prompts. Fixed values.
SUFFIX_ONE_WORD = " Answer in one word if possible."
SUFFIX_STRICT = ".Answer in one word.Don't use the word 'based'."
#: Templates of questions. Fixed values.
TEMPLATES = {
    "color": "What is the color of the %s?",
    "count": "How many %ss are there?",
    "prominent": "What is the most prominent object?",
    "closest": "What is closest to the %s?",
    "farthest": "What is farthest to the %s?",
    "relative": "Where is %s relative to %s?",
    "any": "Is there any %s?",
    "no": "Is there no %s?",
    "where": "Where is %s?",
}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_na(text: Column) -> Column:
    """NULL for the literals that stand for missing."""
    return F.when(~text.isin(*NA_TOKENS), text)


def is_stop_name(name: Column) -> Column:
    lowered = F.lower(name)
    return reduce(lambda x, y: x | y, [lowered.contains(w) for w in STOP_WORDS])


def whole_word(text: Column, word: str, by: str) -> Column:
    """Whole words in any case replaced."""
    return F.regexp_replace(text, rf"(?iU)\b{word}\b", by)


def gray(answer: Column) -> Column:
    return whole_word(answer, "grey", "gray")


def repaired(text: Column, first: Iterable[tuple[str, str]] = ()) -> Column:
    """Repairs in their order. Each is tried only on texts that hold one of the words at all."""
    every = [*first, *REPAIRS]
    fixed = reduce(lambda t, r: whole_word(t, *r), every, text)
    return F.when(text.rlike(rf"(?iU)\b(?:{'|'.join(w for w, _ in every)})\b"), fixed).otherwise(text)


def says_all(question: Column, answer: Column) -> Column:
    """True if either holds the word all or alls; NULL texts do not."""
    return F.coalesce(question.rlike(r"(?iU)\b(?:all|alls)\b"), F.lit(False)) | F.coalesce(answer.rlike(r"(?iU)\b(?:all|alls)\b"), F.lit(False))


def is_noise(text: Column) -> Column:
    """True for numbered walls anywhere and for a text that is ``I think``."""
    return F.coalesce(text.rlike(r"(?iU)wall\d+") | text.rlike(r"(?iU)^i think$"), F.lit(False))


def normalized_answer(text: Column) -> Column:
    """Lower case, without punctuation, single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def question_tokens(text: Column) -> Column:
    """Lower case, without ``? . ,``, cut at white space."""
    return tokens(F.translate(F.lower(text), "?.,", ""))


def separated(text: Column, pairs: Iterable[tuple[str, str]]) -> Column:
    """Words written together taken apart (pairs is a small table, read on the driver). Whole words are looked up in a map
    that the optimizer folds to a constant; pairs of more than one word are replaced one by one."""
    single = {a.lower(): b for a, b in pairs if re.fullmatch(r"\w+", a)}
    several = [(a, b) for a, b in pairs if not re.fullmatch(r"\w+", a)]
    if several:
        text = reduce(lambda t, p: F.regexp_replace(t, rf"(?iU)\b{re.escape(p[0])}\b", p[1].replace("\\", "\\\\").replace("$", "\\$")), several, text)
    if not single:
        return text
    table = F.str_to_map(F.lit("\x01".join(f"{a}\x02{b}" for a, b in sorted(single.items()))), F.lit("\x01"), F.lit("\x02"))
    parts = F.split(text, r"(?U)\b")
    return F.array_join(F.transform(parts, lambda w: F.coalesce(F.try_element_at(table, F.lower(w)), w)), "")


def without_trailing_digits(text: Column) -> Column:
    """``chair12`` to ``chair``; digits within a word and words of digits stay."""
    return F.regexp_replace(text, r"(?U)\b(\w+?)(\d+)\b", "$1")


def processed_name(text: Column, pairs: Iterable[tuple[str, str]] = (), spell=None) -> Column:
    """Words taken apart, numbers as words, trailing digits off, spelling (a slot), full stops at the end off, lower case."""
    worded = numbers_to_words(separated(text, pairs))
    fixed = without_trailing_digits(worded)
    return F.lower(F.rtrim(spell(fixed) if spell else fixed, F.lit(".")))


def processed_answer(text: Column, pairs: Iterable[tuple[str, str]] = ()) -> Column:
    """``processed_name`` without spelling; empty for NULL."""
    return F.coalesce(processed_name(text, pairs), F.lit(""))


def plural(name: Column) -> Column:
    return F.concat(name, F.lit("s"))


def asked(kind: str, *names: Column) -> Column:
    """The question; NULL if a name is."""
    if not names:
        return F.lit(TEMPLATES[kind])
    return F.when(reduce(lambda x, y: x & y, [n.isNotNull() for n in names]), F.format_string(TEMPLATES[kind], *names))


def without_first(text: Column, part: str) -> Column:
    """Without the first occurrence of part."""
    at = F.locate(part, text)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), F.substring(text, at + len(part), F.length(text)))).otherwise(text)


def image_path(root: str, relative: Column, name: str = "SUNRGBD") -> Column:
    """root/name/relative, the first name in relative left out, slashes forward."""
    return F.concat(F.lit(f"{root}/{name}/"), F.regexp_replace(without_first(F.replace(relative, F.lit("\\"), F.lit("/")), name), "^/+", ""))


def daquar_paths(image: Column) -> Column:
    """STRUCT(rgb, depth) of an image id."""
    return F.struct(F.concat(F.lit("images/"), image, F.lit(".png")).alias("rgb"), F.concat(F.lit("depth/"), image, F.lit("_depth.png")).alias("depth"))


def relative_path(path: Column, name: str = "SUNRGBD", up: int = 2) -> Column:
    """What stands after the first name, without the last components, slashes forward; NULL if name isn't in it."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    kept = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0))), "/")
    return F.when(kept.contains(name), F.regexp_extract(kept, rf"{name}/?(.*)$", 1))


def padded_id(number: Column, width: int = 12) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def after_marker(text: Column, marker: str = "assistant") -> Column:
    """Generated text after the first marker and up to the next, else all of it; stripped, lower case, numbers as words."""
    parts = F.split(text, marker)
    return numbers_to_words(F.lower(strip(F.when(F.size(parts) > 1, F.get(parts, 1)).otherwise(text))))


def last_sentence(text: Column) -> Column:
    """The part after the last full stop; stripped, lower case, numbers as words."""
    return numbers_to_words(F.lower(strip(F.element_at(F.split(text, r"\."), -1))))


def val_loss(path: Column) -> Column:
    """The loss in the name of a checkpoint, infinite if there is none."""
    found = F.regexp_extract(path, r"val_loss=([\d.]+)\.ckpt", 1)
    return F.coalesce(found.try_cast("double"), F.lit(float("inf")))


def instruct(question: Column, answer: Column | None = None, images: int = 1) -> Column:
    """A conversation in the form of instructions: the question, a mark for each picture and, for training, the answer."""
    head = F.concat(F.lit("<s>[INST] "), question, F.lit("\n[IMG] " * images + "[/INST] "))
    return head if answer is None else F.concat(head, answer, F.lit(" </s>"))


def chat(question: Column, answer: Column | None = None) -> Column:
    """A conversation of one question and, for training, its answer."""
    head = F.concat(F.lit("user: "), question, F.lit(SUFFIX_ONE_WORD))
    return head if answer is None else F.concat(head, F.lit("\nassistant: "), answer)
