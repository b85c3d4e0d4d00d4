"""Same or near-same records across splits.

Method: each record is brought to a canonical form (case, punctuation, white space, the wording of its question and the
way its path is written) and hashed to 128 bits; the hashes of the evaluation splits are joined with those of the training
split, and matches are counted by split and source. A question's form is the kind of question and its objects in their
roles. Usual wordings are told by their first and last words, variants by patterns, misspelt ones by edit distance to the
fixed words, and any other wording by what it holds: one kind's words (``KINDS``) and, in order, the words that are neither
those nor function words. What has no kind is compared as normalised text.

At scale: one narrow row a record (two BIGINT hashes and the id) is all that is shuffled; each side is keyed and written
once. Keys that hold more than one in ``HOT_SHARE`` rows of either side, of which there can be no more than twice
``HOT_SHARE``, are found by a pre-aggregated count and salted on the side where they are hotter, in proportion to their
size; the pairs of a hot key are then made by many tasks. Counting needs no pairs at all: it joins one row a key.

Defined cases
* null path, null question, a path without a file, a question without letters or digits: the record makes no pair.
* records sent again (same id, same fields): count once. A null id: the record makes no pair.
* a question without the words of a kind, or of two kinds, or without an object: it matches only questions whose normalised
  text is equal. Names of objects are compared as they stand, but for the plural after ``are`` and in counts.
* empty tables: no rows. Columns besides those named: not read. Very long questions: whole, in time linear in length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaframe.session import cut

#: At most so many keys can hold more than the 1 / HOT_SHARE part of the rows each: the bound of what is broadcast.
HOT_SHARE = 2000

#: Introductions and endings that say nothing about what is asked. Fixed values.
_BEFORE = r"^(?:(?:q|question|query|prompt|user|please answer|please tell me|please|answer|\d+) )+"
_AFTER = r"(?: in (?:the |this )?(?:picture|image|photo|scene)| here| please| located| to be found)+$"


def normal(text: Column) -> Column:
    """Lower case; every run that is neither letter nor digit becomes one space; no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def bare_question(question: Column) -> Column:
    """The normal text without introductions and endings, ``what s`` and ``whats`` written out."""
    s = F.regexp_replace(F.regexp_replace(normal(question), _BEFORE, ""), _AFTER, "")
    return F.regexp_replace(s, r"^(what|where) ?s ", "$1 is ")


#: Wordings as (pattern of the bare question, kind); the groups are the roles. Fixed values.
_WORDINGS = [
    (r"^what is (?:the )?most prominent object$", "prominent", 0),
    (r"^what is (?:the )?colou?r of (?:the )?(.+)$", "color", 1),
    (r"^how many (.+?)s? are there$", "count", 1),
    (r"^what is (?:the )?closest to (?:the )?(.+)$", "closest", 1),
    (r"^what is (?:the )?f[au]rthest (?:to|from) (?:the )?(.+)$", "farthest", 1),
    (r"^where is (?:the )?(.+) relative to (?:the )?(.+)$", "relative", 2),
    (r"^is there any (.+)$", "any", 1),
    (r"^is there no (.+)$", "no", 1),
]


def _like(word: Column, target: str, most: int) -> Column:
    """A word within so many edits of the target (a swap of neighbours is two)."""
    d = F.levenshtein(word, F.lit(target), most)
    return F.coalesce((d >= 0) & (d <= most), F.lit(False))


def _any_like(word: Column, targets: list[str], most: int) -> Column:
    return reduce(lambda x, y: x | y, [_like(word, t, most) for t in targets])


def _misspelt(bare: Column) -> Column:
    """The key of a question whose fixed words are misspelt; the names of objects stay as they are."""
    w = F.split(bare, " ")
    n = F.size(w)
    at = lambda i: F.get(w, F.lit(i) if isinstance(i, int) else i)

    def rest(start: Column | int, *skip: str) -> Column:
        """The words from start on, less those of skip that come first, in this order."""
        i = F.lit(start) if isinstance(start, int) else start
        for s in skip:
            i = i + F.when(F.get(w, i) == s, 1).otherwise(0)
        return F.array_join(F.slice(w, i + 1, F.greatest(n - i, F.lit(0))), " ")

    def keyword(targets: list[str], most: int, *follows: str) -> Column:
        """Where a keyword, and what must follow it, stands among the second to the fifth word; NULL if nowhere."""
        there = lambda i: _any_like(at(i), targets, most) & (F.coalesce(at(i + 1).isin(*follows), F.lit(False)) if follows else F.lit(True))
        return reduce(lambda later, i: F.when(there(i), i).otherwise(later), [4, 3, 2, 1], F.lit(None).cast("int"))

    none = F.lit(None).cast("string")
    what = _like(at(0), "what", 2) | _like(at(0), "whats", 2)
    after_is = F.when(at(1).isin("is", "s"), 2).otherwise(1)
    # "where does the lamp stand" is no misspelling of "where is"
    where = (_like(at(0), "where", 2) | _like(at(0), "wheres", 2)) & ~F.coalesce(at(1).isin("does", "do", "did", "can", "could", "would", "exactly"), F.lit(False))
    k_color, k_close = keyword(["color", "colour"], 2, "of"), keyword(["closest"], 3, "to")
    k_far, k_prominent = keyword(["farthest", "furthest"], 3, "to", "from"), keyword(["prominent"], 4)
    relative = F.array_position(F.transform(w, lambda x, i: _like(x, "relative", 3) & (F.get(w, i + 1) == "to") & (i > 0)), True)
    first = after_is + F.when(F.get(w, after_is) == "the", 1).otherwise(0)
    any_closer = F.levenshtein(at(2), F.lit("any")) - F.levenshtein(at(2), F.lit("no"))
    counted = F.array_join(F.slice(w, 3, F.greatest(n - 4, F.lit(0))), " ")
    return (
        F.when(_like(at(0), "how", 1) & _like(at(1), "many", 2) & (n > 4) & _like(at(n - 1), "there", 2), F.concat(F.lit("count|"), F.regexp_replace(counted, "s$", "")))
        .when(what & k_prominent.isNotNull() & (k_prominent + 2 == n), F.lit("prominent"))
        .when(what & k_color.isNotNull() & (k_color >= after_is), F.concat(F.lit("color|"), rest(k_color + 1, "of", "the")))
        .when(what & k_close.isNotNull(), F.concat(F.lit("closest|"), rest(k_close + 1, "to", "the")))
        .when(what & k_far.isNotNull(), F.concat(F.lit("farthest|"), rest(k_far + 1, "to", "from", "the")))
        .when(
            where & (relative > 0),
            F.concat(F.lit("relative|"), F.array_join(F.slice(w, first + 1, F.greatest((relative - 1 - first).cast("int"), F.lit(0))), " "), F.lit("|"), rest((relative + 1).cast("int"), "the")),
        )
        .when(where, F.concat(F.lit("where|"), rest(1, "is", "s", "the")))
        .when(
            _like(at(0), "is", 1) & _like(at(1), "there", 2) & (n > 3) & (F.length(at(2)) <= 4),
            F.concat(F.when((any_closer < 0) | ((any_closer == 0) & at(2).rlike("[ay]")), "any|").otherwise("no|"), rest(3)),
        )
        .otherwise(none)
    )


#: The usual wordings as (start, end, kind): told by their first and last words, before any pattern is tried. Fixed values.
_USUAL = [
    ("what is the color of the ", "", "color"), ("what is closest to the ", "", "closest"), ("what is farthest to the ", "", "farthest"),
    ("how many ", "s are there", "count"), ("is there any ", "", "any"), ("is there no ", "", "no"),
]


def _usual(bare: Column) -> Column:
    """The key of a question in one of the usual wordings, else NULL."""
    key = F.when(bare == "what is the most prominent object", "prominent")
    for start, end, kind in _USUAL:
        asked = bare.startswith(start) & bare.endswith(end) if end else bare.startswith(start)
        name = F.substring(bare, F.lit(len(start) + 1), F.length(bare) - (len(start) + len(end)))
        key = key.when(asked & (F.length(bare) > len(start) + len(end)), F.concat(F.lit(f"{kind}|"), name))
    where, relative = F.substring(bare, F.lit(10), F.length(bare)), " relative to "
    parts = F.split(where, relative)
    two = F.when(F.size(parts) == 2, F.concat(F.lit("relative|"), F.get(parts, F.lit(0)), F.lit("|"), F.get(parts, F.lit(1))))
    plain = bare.startswith("where is ") & ~where.startswith("the ") & ~where.contains(" the ")
    return key.when(plain & where.contains(relative), two).when(plain & ~where.contains(" to "), F.concat(F.lit("where|"), where))


#: Words that tell the kind of a question, whatever its wording; of several kinds the first here counts, but for the pairs that
#: go together. Fixed values.
KINDS = [
    ("relative", r"relative|relation|position(?:ed)?|direction"), ("prominent", r"prominent|dominant|dominating"), ("farthest", r"farthest|furthest|(?:most|least close) (?:far|distant|remote)|remotest"), ("closest", r"closest|nearest|most close"),
    ("color", r"colou?rs?|colou?red|hue|shade"), ("count", r"count|many|number|amount|quantity"), ("no", r"no|not|without|lacks?|lacking|missing|absent"), ("any", r"any|exists?|contains?|present|visible|at least one|is there an?|are there"), ("where", r"where|location|located|place"),
]
#: Words that stand for no object. Fixed values.
_FUNCTION = (
    r"a|an|the|of|in|on|at|to|from|by|with|for|is|are|was|were|be|does|do|did|has|have|having|had|what|which|whats|whose|who|how|where|wheres|there|this|that|these|those|it|its|you|we|i|me|us|can|could|would|will|please|tell|say|name|give|show|"
    r"see|seen|find|found|object|objects|thing|things|item|items|here|and|most|one|ones|if|whether|or|as|all|total|some|s"
)


#: Phrases that stand for no object, though their words may be part of a name. Fixed values.
_ASIDE = (
    r"\b(?:in |of |on |does |do |from )?(?:the|this|that) (?:picture|image|photo|scene|room|view)\b(?! frame)|"
    r"\b(?:stands?|sits?|lies?|looks?|appears?|is placed|placed)(?= (?:the )?(?:closest|nearest|farthest|furthest|relative|in relation|with respect|from|next|most)\b)"
)


def _by_content(bare: Column) -> Column:
    """The key of a question by the words it holds, whatever their order: its kind and what is neither a kind's word nor a
    function word; NULL without a kind, or without an object where the kind asks about one."""
    bare = F.regexp_replace(bare, _ASIDE, " ")
    held = [(kind, bare.rlike(rf"\b(?:{words})\b")) for kind, words in KINDS]
    kind = reduce(lambda rest, k: F.when(k[1], k[0]).otherwise(rest), reversed(held), F.lit(None).cast("string"))
    every = "|".join(words for _, words in KINDS)
    names = F.trim(F.regexp_replace(F.regexp_replace(bare, rf"\b(?:{every})\b", " "), rf"\b(?:{_FUNCTION})\b", " "))
    plural = (kind == "count") | bare.rlike(r"\bare\b")
    name = F.when(plural, F.regexp_replace(F.regexp_replace(names, " +", " "), r"(?<=[^s])s$", "")).otherwise(F.regexp_replace(names, " +", " "))
    # two roles: what stands before the word of the relation, and what stands after it
    sides = F.split(bare, r"\b(?:relative to|in relation to|with respect to|position(?:ed)? (?:to|from)|as seen from|seen from|compared (?:to|with))\b")
    clean = lambda side: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(side, rf"\b(?:{every})\b", " "), rf"\b(?:{_FUNCTION})\b", " "), " +", " "))
    first, second = clean(F.get(sides, F.lit(0))), clean(F.get(sides, F.lit(1)))
    return (
        F.when(kind == "prominent", F.when(name == "", "prominent"))
        .when((F.size(sides) == 2) & (first != "") & (second != ""), F.concat(F.lit("relative|"), first, F.lit("|"), second))
        .when((kind != "relative") & (name != ""), F.concat(kind, F.lit("|"), name))
    )


def question_key(bare: Column) -> Column:
    """Kind of the question and its objects in their roles; NULL if there is nothing to ask. Takes ``bare_question``."""
    key = None
    for pattern, kind, roles in _WORDINGS:
        value = F.lit(kind) if not roles else F.concat_ws("|", F.lit(kind), *[F.regexp_extract(bare, pattern, r + 1) for r in range(roles)])
        key = F.when(bare.rlike(pattern), value) if key is None else key.when(bare.rlike(pattern), value)
    key = key.when(bare.rlike("^where is ") & ~bare.contains(" to "), F.concat(F.lit("where|"), F.regexp_extract(bare, r"^where is (?:the )?(.+)$", 1)))
    return F.when(bare != "", F.coalesce(_usual(bare), key, _misspelt(bare), _by_content(bare), F.concat(F.lit("text|"), bare)))


def picture_key(path: Column) -> Column:
    """sensor/place/scene/folder/file in lower case, whatever stands before and however it is divided; NULL without a file."""
    parts = F.regexp_replace(F.regexp_replace(F.lower(F.trim(path)), r"[\\/]+(?:\.[\\/]+)*", "/"), r"^(?:\./|/)+", "")
    return F.nullif(F.substring_index(F.regexp_replace(F.trim(parts), r"^.*(?:^|/)sunrgbd/", ""), "/", -5), F.lit(""))


def source_of(picture: Column) -> Column:
    """The sensor folder of a ``picture_key``."""
    return F.when(F.size(F.split(picture, "/")) >= 5, F.get(F.split(picture, "/"), F.lit(0)))


def hashes(frames: dict[str, DataFrame], id_col: str = "Question_Id", question: str = "Questions", path: str = "Image_Path") -> DataFrame:
    """(split, id, h1, h2, source) of the records of each split with a path and a question, each once. All splits go through
    one expression, which is large: a plan holds it once."""
    named = lambda split, df: df.select(F.lit(split).alias("split"), F.col(f"`{id_col}`").alias(id_col), F.col(f"`{question}`").alias(question), F.col(f"`{path}`").alias(path))
    df = reduce(DataFrame.unionAll, [named(split, frame) for split, frame in frames.items()])
    q, p = F.col(f"`{question}`"), F.col(f"`{path}`")
    rows = df.where(F.col(f"`{id_col}`").isNotNull() & q.isNotNull() & p.isNotNull())
    rows = rows.select("split", F.col(f"`{id_col}`").alias("id"), bare_question(q).alias("bare"), picture_key(p).alias("picture"))
    # a filter on the key would compute it twice, so a record without one gets a key that no other record has
    own = F.concat(F.lit("none|"), F.col("id").cast("string"))
    keyed = rows.select("split", "id", F.coalesce(question_key(F.col("bare")), own).alias("asked"), F.coalesce("picture", own).alias("picture"))
    hashed = keyed.select("split", "id", F.xxhash64("picture", "asked").alias("h1"), F.xxhash64("asked", F.lit(7), "picture").alias("h2"), source_of(F.col("picture")).alias("source"))
    return hashed.distinct()


def overlapping_pairs(train: DataFrame, evals: DataFrame, **columns: str) -> DataFrame:
    """(train_id, eval_id) of the records of evals that occur, exactly or almost, in train."""
    both = cut(hashes({"train": train, "eval": evals}, **columns).select("split", "id", "h1", "h2"), "overlap")
    t, e = (both.where(F.col("split") == split).select("id", "h1", "h2") for split in ("train", "eval"))
    held = {r[0]: r[1] for r in both.groupBy("split").count().collect()}
    totals = held.get("train", 0), held.get("eval", 0)
    counts = both.groupBy("h1", "h2").agg(F.count_if(F.col("split") == "train").alias("t"), F.count_if(F.col("split") == "eval").alias("e"))
    parts = lambda side, total: F.ceil(F.col(side) * HOT_SHARE / F.lit(max(1, total))).cast("int")
    # only a key of both sides makes pairs; the side with more parts is cut, the other one copied to each part
    hot = counts.where((F.col("t") > 0) & (F.col("e") > 0)).select("h1", "h2", parts("t", totals[0]).alias("t"), parts("e", totals[1]).alias("e")).where("t > 1 OR e > 1")
    rows = [(r["h1"], r["h2"], max(r["t"], r["e"]), r["t"] >= r["e"]) for r in hot.collect()]
    hot = F.broadcast(t.sparkSession.createDataFrame(rows, "h1 long, h2 long, salts int, cut_train boolean"))

    def salted(side: DataFrame, cut_here: Column, name: str) -> DataFrame:
        own = F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")
        salts = F.when(F.col("salts").isNull(), F.array(F.lit(0))).when(cut_here, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("salts") - 1))
        return side.join(hot, ["h1", "h2"], "left").select("h1", "h2", F.col("id").alias(name), F.explode(salts).alias("salt"))

    left, right = salted(t, F.col("cut_train"), "train_id"), salted(e, ~F.col("cut_train"), "eval_id")
    return left.join(right, ["h1", "h2", "salt"]).select("train_id", "eval_id")


def overlap_counts(train: DataFrame, evals: dict[str, DataFrame], **columns: str) -> DataFrame:
    """(split, source, records, overlapping, pairs): records with a path and a question, those that occur in train, and their pairs."""
    own = next(name for name in ("train", "training", "_train") if name not in evals)
    each = cut(hashes({own: train, **evals}, **columns).groupBy("split", "source", "h1", "h2").agg(F.count("*").alias("n")), "overlap")
    t = each.where(F.col("split") == own).groupBy("h1", "h2").agg(F.sum("n").alias("n_train"))
    joined = each.where(F.col("split") != own).join(t, ["h1", "h2"], "left")
    return joined.groupBy("split", "source").agg(
        F.sum("n").alias("records"),
        F.coalesce(F.sum(F.when(F.col("n_train").isNotNull(), F.col("n"))), F.lit(0)).alias("overlapping"),
        F.coalesce(F.sum(F.col("n") * F.col("n_train")), F.lit(0)).alias("pairs"),
    )
