from __future__ import annotations

import time

import pytest
from llm_rows import REGEN, msgs
from pyspark.sql import functions as F

from quillspark.llm import pairs
from quillspark.runtime import table

Q = "How would you explain the first snow to the night team in 13 minutes?"


@pytest.fixture(scope="module")
def field(spark, sf):
    return pairs.train(table(spark, sf.replace("sf0.001", "sf0.01"), "regen"), 1500)


@pytest.mark.parametrize(
    "answer, want",
    [
        (Q, True), (Q.upper(), True), ("> " + Q, True), (Q + "\n\n" + Q, True), ("Question: " + Q, True), ("How would you explain the first snow to the night team", True),
        ("This was the question that I got from you a while ago: " + Q, True), ("You wrote: " + Q + "\n\n2026", False), (Q + " It is cold.", False), ("", False), ("How would you", False), ("How", False),
    ],
)
def test_copy_check(answer, want):
    assert pairs.is_copy(Q, answer) is want


def test_cases(spark, field):
    good = "The first snow falls when the air is cold. The team should know that the roads are wet and that the lamps are on."
    conv = {
        1: (None, "stop"), 2: (msgs(("user", Q)), "stop"), 3: (msgs(("user", Q), ("assistant", None)), None), 4: (msgs(("user", Q), ("assistant", "<think>x</think> ...")), "stop"),
        5: (msgs(("user", Q), ("assistant", good)), "LENGTH"), 6: (msgs(("user", Q), ("assistant", "<think>on and on")), "stop"), 7: (msgs(("user", Q), ("assistant", Q.title())), "stop"),
        8: (msgs(("user", Q), ("assistant", good)), "stop"), 9: (msgs(("Human", "q"), ("assistant", "a"), ("user", Q), ("gpt", good)), None), 10: ([], None), 11: ([None], None),
        12: (msgs(("user", Q), ("assistant", "I am sorry, but I can't help with that.")), "stop"),
        13: (msgs(("user", Q), ("assistant", "Der erste Schnee fällt, wenn die Luft kalt ist. Das Team soll wissen, dass die Straße nass ist und die Lampen nicht aus sind.")), "stop"),
        14: (msgs(("user", Q + " Reply in German."), ("assistant", "Der erste Schnee fällt, wenn die Luft kalt ist. Das Team soll wissen, dass die Straße nass ist.")), "stop"),
        17: (msgs(("user", Q), ("assistant", "最初の雪は空気が冷たいときに降ります。道が濡れていることを知っておいてください。")), "stop"),
        18: (msgs(("user", Q + " Reply in Japanese."), ("assistant", "最初の雪は空気が冷たいときに降ります。道が濡れていることを知っておいてください。")), "stop"),
        15: (msgs(("user", Q), ("assistant", good * 3000)), "stop"), 16: (msgs(("user", Q), ("assistant", "7")), "stop"),
    }
    df = spark.createDataFrame([(k, *v) for k, v in conv.items()] + [(5, *conv[5])], REGEN).withColumn("defect", F.lit("clash"))
    got = sorted((r["resp_id"], r["defect"]) for r in pairs.defects(df, field).collect())
    e, t = "empty", "truncated"
    assert got == [(1, e), (2, e), (3, e), (4, e), (5, t), (5, t), (6, t), (7, "copied"), (10, e), (11, e), (12, "refusal"), (13, "other_language"), (17, "other_language")]
    assert pairs.defects(df.limit(0), field).count() == 0
    assert pairs.summary(pairs.defects(df, field), df).count() == 5


def test_fit_without_rows(spark):
    assert pairs.defects(spark.createDataFrame([], REGEN)).count() == 0


def test_held_out_cuts(spark, sf, field):
    """Rows that ended by length are no examples of the fit; their answers must be told as unfinished."""
    rows = table(spark, sf.replace("sf0.001", "sf0.01"), "regen").filter("finish_reason = 'length'").collect()
    todo = []
    for r in rows:
        q, a = pairs.question_and_answer([m.asDict() for m in r["conversations"]])
        body, open_trace = pairs.split_trace(a or "")
        if body and not open_trace:
            parts = pairs.clauses(body)
            todo.append(pairs.features(parts, q, pairs.allowed_languages(q), field.known, pairs.bits.hits(field.repeated, pairs._clause_hashes([pairs.clause_key(p) for p in parts])).tolist())[0])
    hit = sum(y[-1] == pairs.UNFINISHED for y in field.decode(todo))
    assert len(todo) > 20 and hit >= 0.9 * len(todo)


def test_vocabulary_of_all_rows(spark):
    """Words are counted over all answers, ideographs one by one, last words that may be cut not at all."""
    a = ["The lamps are on.\nSee the harbour", "The harbour is wet. The lam", "这里下雪。雪很大", None]
    df = spark.createDataFrame([(i, msgs(("user", "Zebra?"), ("assistant", x)), "stop") for i, x in enumerate(a)], REGEN)
    got = {r["key"]: r["n"] for r in pairs.vocabulary(df).collect()}

    def n(*keys):
        return [got.get(h, 0) for h in pairs._hashes(list(keys)).tolist()]

    assert n("wthe", "wharbour", "wlam", "w雪", "w大", "wzebra", "esee the harbour", "eSee the harbour") == [2, 1, 0, 1, 0, 0, 0, 1]
    assert pairs.asked(["雪很大"]) == "大" and pairs.asked(["It is on."]) is None


def test_last_word_known_outside_of_the_sample(spark):
    """The verdict follows the vocabulary of all rows given, not that of the rows the field was fitted on."""
    emit = pairs.np.zeros((pairs.BUCKETS, len(pairs.LABELS)))
    emit[pairs._bucket("e_unknown"), pairs.UNFINISHED] = 9
    field = pairs.Field(emit, pairs.np.zeros((len(pairs.LABELS),) * 2), frozenset())
    a = ["They met at the harbour", "The harbour is wet.", "They met at the harb", "They met at the lighthouse"]
    df = spark.createDataFrame([(i, msgs(("user", Q), ("assistant", x)), "stop") for i, x in enumerate(a)], REGEN)
    assert sorted(map(tuple, pairs.defects(df, field).collect())) == [(2, "truncated"), (3, "truncated")]


def test_refusals_in_words_that_no_seed_has(spark, sf):
    """Refusals that no seed matches are found by their shape and company, and sound answers are not taken for them."""
    rows = table(spark, sf.replace("sf0.001", "sf0.1"), "regen")
    other = "outside what i am allowed|my rules stand|turned down|pick another subject|not going there|conversation should end|asked not to discuss|no comment|no reply to this|instructions do not cover|rather not go|not be right for me|request i can take"
    other = pairs.re.compile(other, pairs.re.IGNORECASE)
    assert not any(pairs.SEEDS.search(x) for x in other.pattern.split("|"))
    found = {r["resp_id"]: r["defect"] for r in pairs.defects(rows).collect()}
    held = hit = sound = wrong = 0
    for r in rows.filter("conversations IS NOT NULL").collect():
        q, a = pairs.question_and_answer([m.asDict() if m is not None else None for m in r["conversations"]])
        body, open_trace = pairs.split_trace(a or "")
        if open_trace or r["finish_reason"] == "length" or '"' in body:
            continue
        if len(body) < 150 and other.search(body) and not pairs.SEEDS.search(body):
            held, hit = held + 1, hit + (found.get(r["resp_id"]) == "refusal")
        elif len(body) > 400:
            sound, wrong = sound + 1, wrong + (found.get(r["resp_id"]) == "refusal")
    assert held > 100 and hit >= 0.9 * held and wrong <= 0.001 * sound


def test_field_is_kept_for_the_same_files(spark, sf, monkeypatch):
    rows = table(spark, sf, "regen")
    a = pairs.trained(rows, 200)
    monkeypatch.setattr(pairs, "train", None)
    b = pairs.trained(rows.select("*"), 200)
    assert (a.emit == b.emit).all() and a.known == b.known and (a.repeated == b.repeated).all()


ODD = ["", "7", "B2B in 1999 3rd_try 007x", "a.b  c!\tD?\x1c e", "One.\r\nTwo. Three!\n\n\n? four", "x\x00y. Z", "1) Say 10 000 kg (20%). 2) No_1 ...", "Straße 5. Ёж ٣ 雪が降る。 Ja?", "Said \"so.\") Then", "```a1 = 0x00\n```", "00 0a a00 0", "end.\n", "end.* ", "what?!  yes"]


def test_texts_are_taken_apart_as_by_the_patterns():
    """Tables of bytes give what the patterns of clauses, words, keys and endings say, on odd texts too."""
    for parts in [*([x] for x in ODD), ODD, [x for x in ODD if x.isascii() and "\x00" not in x]]:
        words, raw = pairs.said(parts)
        want = [pairs._WORD_OR_NUMBER.findall(x.replace("_", " ").casefold()) for x in parts]
        want = [[y for w in ws for y in (pairs.re.findall("[a-z]+|[0-9]+", w) if w.isascii() else [w])] for ws in want]
        assert [["0" if w.isascii() and w.isdigit() else w for w in ws] for ws in words] == [["0" if w.isascii() and w.isdigit() else w for w in ws] for ws in want]
        assert pairs.said_letters(words, raw) == [pairs._DROP.sub("", x.casefold()) for x in parts] == [pairs.canon(x) for x in parts]
        assert pairs.said_keys(words, raw) == pairs.clause_keys(parts) == [pairs.clause_key(x) for x in parts]
    for x in ODD:
        assert pairs._pieces(x) == [y for y in map(str.strip, pairs._CUT.split(x)) if y]
        assert pairs._stopped(x, True) is bool(pairs._END.search(x))


def test_taking_apart_is_cheaper_than_the_patterns():
    texts = [f"The lamps of room {i} are on, and the team of 12 people knows it by now. See the 3rd harbour! Is it wet?\n- It was {i * 7} times." * 5 for i in range(300)]

    def tables():
        return [pairs.said_keys(*pairs.said(pairs._pieces(x))) for x in texts]

    def patterns():
        return [[pairs._DIGITS.sub("0", " ".join(pairs._WORD_OR_NUMBER.findall(y.casefold()))) for y in map(str.strip, pairs._CUT.split(x)) if y] for x in texts]

    def cost(f):
        took = []
        for _ in range(5):
            began = time.thread_time()
            f()
            took.append(time.thread_time() - began)
        return min(took)

    assert [len(x) for x in tables()] == [len(x) for x in patterns()] and cost(tables) < 0.7 * cost(patterns)


def test_features_of_an_example_are_found_once():
    made = [pairs._example(["The lamps are on.", "It is wet"], Q, pairs.ANSWER)]

    def told(parts):
        return pairs.np.zeros(len(parts), dtype=bool)

    first, again = (pairs._featured(made, lambda keys: {}, told)[0] for _ in range(2))
    assert first == again and first[0][0] is again[0][0]
