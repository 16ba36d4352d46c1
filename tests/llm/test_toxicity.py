"""The grammar's clauses, and accuracy on held-out rows."""

import random

from pyspark.sql import functions as F

from briefloom.llm.toxicity import (CATEGORIES, CLAUSE, INSULTS, NEGATIONS, REACH, REPORTS, SYMBOLS, TARGETS, THREATS, Grammar, compose,
                                    held_out, negation, reported, score, target, train)


def arcs(text):
    return dict(zip(CATEGORIES, (round(float(x), 1) for x in Grammar().arcs(text)), strict=True))


def test_clauses():
    assert arcs("An idiot.")["plain"] == 4
    assert arcs("You idiot!")["targeted"] == 4
    assert arcs("That was not stupid.")["negated"] == 4
    assert arcs("It was not so very, very, very far from stupid.")["plain"] == 4
    assert arcs("Someone said idiot.")["reported"] == 4
    assert arcs('The word "idiot" stood there.')["reported"] == 4
    assert arcs("I will kill you.")["threat"] == 4
    assert arcs("I will kill time. You know.")["threat"] == 0
    assert sum(arcs("A calm text about nothing.").values()) == 0
    g = Grammar()
    assert g.score("You idiot!") > g.score("An idiot.") > g.score("not stupid") > g.score("") == g.score("calm")


def test_composition_equals_all_paths_one_after_another():
    """Every output of each transducer is passed on by hand; their sum is what the composed machine has."""
    rng = random.Random(4)
    whole = compose(compose(negation(), reported()), target())
    for _ in range(400):
        clause = [(s, rng.choice([1.0, 2.0, 4.0]) if s in ("insult", "threat") else 0.0) for s in rng.choices(SYMBOLS, k=rng.randrange(0, 9))]
        words = [s for s, _ in clause]
        by_hand = [z for x in negation().paths(words) for y in reported().paths(x) for z in target().paths(y)]
        assert sorted(by_hand) == sorted(whole.paths(words)) and len(by_hand) == 1  # one reading of each clause
        want = [sum(w for path in by_hand for out, (_, w) in zip(path, clause, strict=True) if out == c) for c in CATEGORIES]
        assert CLAUSE.run(clause).tolist() == want


def test_sums_over_more_than_one_path():
    # Two equal guesses: twice the weight, by brute force and by the machine.
    t = target()
    twice = type(t)(t.starts + ("none",), t.finals, t.arcs)
    machine = type(CLAUSE)(twice)
    clause = [("other", 0.0), ("insult", 3.0), ("insult", 1.0)]
    paths = list(twice.paths([s for s, _ in clause]))
    want = [sum(w for path in paths for out, (_, w) in zip(path, clause, strict=True) if out == c) for c in CATEGORIES]
    assert len(paths) == 2 and machine.run(clause).tolist() == want == [8.0, 0, 0, 0, 0]


def direct(words):
    """The clause rules, read off the words' places."""
    out, quotes = dict.fromkeys(CATEGORIES, 0.0), 0
    targeted = any(w in TARGETS for w in words)
    for i, w in enumerate(words):
        negated = any(x in NEGATIONS for x in words[max(0, i - REACH):i])
        told = quotes % 2 == 1 or any(x in REPORTS for x in words[:i])
        quotes += w == '"'
        if w in THREATS:
            out["threat"] += 4 * (targeted and not negated)
        elif any(w.startswith(s) for s in INSULTS):
            out["reported" if told else "negated" if negated else "targeted" if targeted else "plain"] += 4
    return out


def test_texts_equal_the_rules_read_directly():
    rng = random.Random(5)
    words = ["you", "not", "said", '"', "idiot", "idiots", "kill", "calm", "house", "tree", "stupid", "never"]
    for _ in range(300):
        clauses = [rng.choices(words, k=rng.randrange(0, 14)) for _ in range(rng.randrange(1, 4))]
        want = [sum(direct(c)[k] for c in clauses) for k in CATEGORIES]
        assert Grammar().arcs(". ".join(" ".join(c) for c in clauses)).tolist() == want


def labelled(spark, n=600):
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = rng.random() < 0.2
        if toxic:
            w.insert(rng.randrange(len(w)), "zorg" + rng.choice(["", "ling", "en", "u"]))
        rows.append((i, " ".join(w), int(toxic)))
    rows += [(n + i, rows[0][1] + " uniqueword", 0) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learns_stems_from_the_training_part_only(spark):
    df = labelled(spark)
    g = train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any(s.startswith("zorg") for s in g.stems)
    got = score(df, g).where(held_out()).groupBy("toxic", "predicted").count().collect()
    assert all(r.toxic == r.predicted for r in got) and len(got) == 2
    # Turning every held-out label round changes nothing.
    turned = df.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    h = train(df.select("doc_id", "text"), turned.select("doc_id", "toxic"))
    assert h.stems == g.stems and (h.weights == g.weights).all()


def test_nulls_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, None, 0.5), (1, "", 0.5), (None, "you idiot", 0.5)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    g = train(df, labels)
    got = score(df, g).collect()
    assert [r.predicted for r in sorted(got, key=lambda r: str(r.text))] == [0, 0, 1] and all(0 <= r.score <= 1 for r in got)
    assert score(df.limit(0), train(df.limit(0), labels.limit(0))).count() == 0
