from __future__ import annotations

import random

import pytest
from llm_rows import DOC
from pyspark.sql import functions as F

from quillspark.llm import residue

REAL = "The cache keeps the last answers, and the team reads them when the load is low. It is not obvious why this helps."
OWN = "amber birch cedar delta ember fjord grove heath iron jade kelp lime moss nettle oak pine quartz reed sand thorn umber vine willow yarrow".split()


def prose(seed, n=6):
    """Sentences that no other record has."""
    r = random.Random(seed)
    w = lambda: r.choice(OWN) + str(seed % 7) + r.choice(OWN)
    return " ".join(f"When the {w()} of the {w()} is set, the {w()} that we {w()} in the {w()} is not lost." for _ in range(n))


def found(spark, texts, first=0):
    return {r["doc_id"] for r in residue.found(spark.createDataFrame([(first + i, t, "en", None, None) for i, t in enumerate(texts)], DOC)).collect()}


def test_template_filled_in_left_open_and_blank(spark):
    """One template filled in 40 times, 4 times with names left in and 4 times with nothing, and one error page in new words."""
    towns = ["Turin", "Lyon", "Porto", "Ghent", "Graz"]
    say = lambda a, b, c: f"Dear {a}, your parcel {b} has been sent to {c} by the night train. We hope that it finds you well."
    texts = [say(OWN[i % 24].title(), 1000 + 7 * i, towns[i % 5]) for i in range(40)]
    texts += [say("first_name", "order_id", "city_name") for _ in range(4)]
    texts += [say("", 1400 + i, "") for i in range(4)]
    texts += ["The thing you were after has left the building.\nOur crew was told. Ticket 77."] * 30
    texts += [prose(i) for i in range(60)]
    assert found(spark, texts) == set(range(40, 78))


def test_filler_in_place_of_text(spark):
    """Sentences that stand in each other's company only are residue; lines that also head real text are menus."""
    filler = ["Words will be put in here.", "The second block is yours to fill.", "A picture of the office comes next.", "Tell them why they should buy."]
    r = random.Random(3)
    texts = ["Home | About | Shop\n\n" + " ".join(r.sample(filler, 3)) + f" Part {i} of it." for i in range(24)]
    texts += [f"Home | About | Shop\n\n{prose(100 + i)}" for i in range(30)]
    texts += [f"{prose(200 + i)} {filler[i % 4]}" for i in range(4)]
    assert found(spark, texts) == set(range(24))


def test_words_of_no_language(spark):
    """Sentences without any common word of a known language."""
    r = random.Random(5)
    odd = [" ".join(f"{r.choice(['lor', 'dan', 'vis'])}{r.choice(['qua', 'mip', 'tem'])}{r.choice(['sol', 'fel'])}" for _ in range(9)).capitalize() + "." for _ in range(3)]
    texts = odd + [prose(i) for i in range(70)] + [odd[0] + " " + prose(99)]
    assert found(spark, texts) == {0, 1, 2}


def test_slots_of_any_syntax(spark):
    """Marked names that recur where records differ; a value that all records share is text, and so is what varies freely."""
    names = ["name", "order", "town"]
    rows = [f"{prose(i)} Dear ⟦{names[i % 3]}⟧, the box for ⟪{names[i % 2]}⟫ is on its way." for i in range(8)]
    rows += [f"{prose(20 + i)} The row {i} holds ⟦name⟧ for all of us." for i in range(8)]
    rows += [f"{prose(40 + i)} This was shown by ⟦{w}⟧ in the first year." for i, w in enumerate("Adams Baker Clark Davis Evans Frank".split())]
    rows += [prose(60 + i) + " In the page the line `⟦name⟧` stands for “⟦order⟧”, the code is ```⟦town⟧```." for i in range(8)]
    assert found(spark, rows) == set(range(8))


def test_repeated_pages(spark):
    """An error page is told by the many documents that are nothing else, whatever its words; a sentence of it in real text is none."""
    texts = [f"La pagina non è qui.\nCodice {i}." for i in range(6)] + [REAL * 9] * 6 + ["La pagina non è qui.\nCodice 9.\n" + REAL * 2]
    texts += [f"```\nreturn {i}\n```" for i in range(6)]
    assert found(spark, texts) == set(range(6))


def test_one_gap_in_a_short_page(spark):
    """A line that differs in a few words from those of known pages is aligned with them."""
    end = "Walk back to the hall and ring the bell."
    texts = [f"The {OWN[i % 3]} door is shut for the day.\n{end} Sheet {i}." for i in range(18)] + [f"The {OWN[5 + i]} door is shut for the day.\n{end}" for i in range(4)]
    texts += ["The moss door is shut for the day."] + [prose(i) for i in range(40)]
    assert found(spark, texts) == set(range(23))


@pytest.mark.parametrize("suffix", ["", " "])
def test_odd_rows(spark, suffix):
    rows = [(1, None, "en", None, None), (2, "" + suffix, None, None, None), (None, "404", None, None, None), (3, (REAL + suffix) * 5000, "en", None, None), (3, REAL, "en", None, None), (4, "?!" + suffix, "", None, None), (5, "```x", None, None, None)]
    df = spark.createDataFrame(rows, DOC).withColumn("key", F.lit("clash")).withColumn("keys", F.lit(0)).withColumn("n", F.lit(1))
    got = residue.detect(df)
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 2, 3, 4, 5] and got.filter("is_residue").count() == 0
    assert residue.clean(df).count() == len(rows) and residue.clean(df).columns == df.columns
    assert residue.found(df.limit(0)).count() == 0 and residue.found(df.drop("lang")).count() == 0
