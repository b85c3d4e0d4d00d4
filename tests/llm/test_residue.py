"""Slots, filler, errors and notices, and sentences that only speak of them."""

import pytest

from vistaframe.llm import residue as R

CASES = [
    ("slot", "How many {{object}}s are there?"), ("slot", "Answer: %s"), ("slot", "The [your color] touches the edge."), ("slot", "Color: {}"), ("slot", "step=3 loss=${loss} val=1"), ("slot", "Room: <camera id/>"),
    ("slot", "| Count | [[n_objects]] |"), ("slot", "Die Farbe von %first_object% ist blau."), ("slot", "A: XXXXX"), ("slot", "Where is ?????"), ("slot", "What is closest to the <%= room %>?"), ("slot", "Remarks: TBD:date"),
    ("slot", 'The label said "{caption}", yet the outline follows it.'), ("slot", "How many ___s are there?"), ("slot", "Scene: (room goes here)"),
    ("filler", "Lorem ipsum dolor sit amet consectetur adipiscing elit sed tempor."), ("filler", "Your description here."), ("filler", "asdf jkl asdf asdf jkl asdf asdf jkl asdf asdf jkl asdf"), ("filler", "bla bla bla bla bla bla"),
    ("filler", "Texte à remplacer."), ("filler", "Aquí va la descripción."), ("filler", "qwer asdfgh zxcv hjkl vbnm"), ("filler", "Enter scene notes in this box."),
    ("error", "404 | Not Found"), ("error", "Error 502: Bad Gateway"), ("error", "The wall is white. HTTP 503 - Service Unavailable Retry"), ("error", "The page is temporarily unavailable, try later."), ("error", '{"status": 503, "detail": "This cannot be loaded.", "data": null}'),
    ("error", "<error><code>410</code><message>Gone for good.</message></error>"), ("error", 'Traceback (most recent call last):\n  File "a.py", line 3, in main\nKeyError: \'x\''), ("error", "status: 429\nreason: Slow down.\nbody:"), ("error", "Zugriff verweigert."),
    ("error", "La fiche n'a pas pu être chargée, réessayez plus tard."), ("error", "Su solicitud no está disponible ahora."), ("error", "Back to start page\nIncident 3fa9c1d2\nWe could not find this scene."),
    ("script", "Please enable JavaScript to use this app."), ("script", "© scene browser\nYou need to turn on scripts."), ("script", "LES SCRIPTS SONT BLOQUÉS PAR VOTRE NAVIGATEUR."), ("script", "<noscript>To see the scene, allow scripts and cookies.</noscript>"), ("script", "Su navegador tiene los scripts desactivados."),
]
MENTIONS = [
    None, "", " \n\t", "wall", "The set {left, right, above} covers it.", "Older prompts wrote {{x_name}} and newer ones %s where the name goes; both are explained in the guide.", "A checker now rejects captions that still hold [caption] or the word lorem.",
    "In the template file the mark <room/> is replaced by the name.", 'A template such as "How many {}s are there?" yields wrong plurals.', "The prompt builder documents one slot per field: `{{object}}` stands for the name.", r"The loss is \frac{1}{N}\sum_{i} d_i^{2}.",
    'Ticket 7 quotes the message "The page is temporarily unavailable. Try later." and was closed.', "Die Meldung „Die Seite wurde nicht gefunden“ trat in Lauf 7 auf.", "Our crawler met 9 answers with status 404 last week; we dropped those pages.",
    "Access to the studio was denied to the second team, so the wall could not be scanned.", "Enabling JavaScript in the viewer settings made it work.", "The viewer was rewritten in JavaScript, and two scripts are required to build it.", "We removed the filler text (lorem ipsum and the like) from 9 records.",
    'When the gateway timed out in run 3, the log said "502" and the job was started again.', "XXL shelves, [S] and [M] are printed on the box.", "<|endoftext|>  The wall is white.", "<image>\nWhat is this?", '{"name": "wall", "x": [1, 2]}', "36 % of all, 5% of some", "a#b c|d|e ~ 5 @home", "user: Is there any wall?\nassistant: yes",
]


def frame(spark, texts, source="s"):
    rows = [(i, t, f"{source}{i % 3}" if i % 4 else None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, form string")


def test_cases_and_mentions(spark):
    texts = [t for _, t in CASES] + MENTIONS
    got = {}
    for r in R.found(frame(spark, texts)).collect():
        got.setdefault(r["doc_id"], set()).add(r["reason"])
    wrong = [(texts[i], want, got.get(i)) for i, (want, _) in enumerate(CASES) if want not in got.get(i, set())]
    wrong += [(texts[i], None, got[i]) for i in range(len(CASES), len(texts)) if i in got]
    assert not wrong


def test_residue_and_rest(spark):
    df = frame(spark, ["ok", "A: XXXXX", None, "A: XXXXX and 404 Not Found"])
    df = df.union(df).union(spark.createDataFrame([(None, "Accès refusé.", None, "x")], df.schema))
    assert sorted((r[0] for r in R.residue(df).collect()), key=str) == sorted([1, 3, None], key=str)
    assert sorted(r["doc_id"] for r in R.without_residue(df).collect()) == [0, 0, 2, 2]
    assert R.residue(df.limit(0)).count() == 0 and R.without_residue(df.limit(0)).count() == 0


def test_weak_phrases_count_only_where_they_recur(spark):
    assert R.residue(frame(spark, ["Try again later."] * 3)).count() == 0
    assert R.residue(frame(spark, ["Try again later."] * 6)).count() == 6


@pytest.mark.parametrize("text", ["-" * 50_000, "{" * 50_000, "qwertyuiop" * 5_000, "asd " * 20_000, "lorem " * 20_000, "<a" * 30_000, "[x" * 30_000, "a " * 50_000, "( " * 30_000 + ".", '"' * 50_001])
def test_very_long_texts_end(spark, text):
    R.residue(frame(spark, [text])).collect()


def test_masks(spark):
    from pyspark.sql import functions as F

    text = "On 2024-05-01 see https://x.y/z?a=1 or a.b@c.de,  code 3fa9c1: 12.5 of 7"
    assert spark.range(1).select(R.masked(F.lit(text))).first()[0] == "On <when> see <address> or <address>, code 0: 0 of 0"


def reasons(spark, texts):
    got = {r["doc_id"]: r["reason"] for r in R.found(frame(spark, texts)).collect()}
    return [got.get(i) for i in range(len(texts))]


def test_repeats_and_mashed_keys_in_capitals(spark):
    filler = ["ASDF JKL ASDF ASDF", "Bla bla bla", "Bla bla bla bla", "QWERTY ASDF", "QWER ASDFGH ZXCV HJKL VBNM", "The wall is Very very VERY very white", "ÉTÉ été Été"]
    assert reasons(spark, [*filler, "The Wall is a wall"]) == ["filler"] * len(filler) + [None]


def test_pseudo_latin_without_rare_words(spark):
    filler = ["Ut enim ad minim veniam, quis nisi", "Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit anim id est laborum.", "SED DO EIUSMOD TEMPOR UT LABORE", "The wall: dolor sit amet, elit sed magna aliqua"]
    assert reasons(spark, [*filler, "Dolor sit amet, elit sed walls", "Est-ce que le mur est non peint?"]) == ["filler"] * len(filler) + [None] * 2


def test_typed_twice_after_other_words(spark):
    filler = ["Notes: Type something Type something The wall", "Notes: type something, TYPE SOMETHING.", "Type something"]
    assert reasons(spark, [*filler, "Notes: type something The wall"]) == ["filler"] * len(filler) + [None]
