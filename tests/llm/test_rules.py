"""The order of the quality rules against brute force over measured costs, and that it moves no verdict."""

import itertools
import random

from pyspark.sql import functions as F

from siltstone.llm import rules

from test_operators import prose

BAD = ["w### " * 80, " | ".join("abcdef" * 20), "q!! " * 80, "\n".join(["a b c d e", "f g h i j"] * 20), "OF ALL THE THINGS " * 30, " ".join(f"w{i} w{i}" for i in range(60))]


def corpus(spark, copies=0):
    texts = [prose(random.Random(i)) for i in range(60)] + [b + f" x{i}" for i, b in enumerate(BAD * 4)] + [None, "", "\n"] + [BAD[1]] * copies
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, __t string").repartition(5)


def measured(df):
    return rules.measured(rules.drawn(df, ["doc_id", "text"]), rules.facts(rules.whole(F.col("text"))), rules.RULES)


def test_the_order_is_that_of_brute_force_and_always_the_same(spark):
    df = corpus(spark)
    order = [r.name for r in rules.ordered(measured(df))]
    assert all([r.name for r in rules.ordered(measured(df.repartition(n)))] == order for n in range(1, 11))
    # row by row: the rule with the most rejections for its cost among the rows that are left
    known = rules.facts(rules.whole(F.col("text")))
    rows = df.select(*[r.rejects(known).alias(f"r{i}") for i, r in enumerate(rules.RULES)], *[r.cost(known).cast("double").alias(f"c{i}") for i, r in enumerate(rules.RULES)]).collect()
    left, want, names = rows, [], [r.name for r in rules.RULES]
    while len(want) < len(names):
        best = min((i for i in range(len(names)) if names[i] not in want), key=lambda i: (-sum(r[f"r{i}"] for r in left) / max(sum(r[f"c{i}"] for r in left), 1.0), sum(r[f"c{i}"] for r in left), names[i]))
        want.append(names[best])
        left = [r for r in left if not r[f"r{best}"]]
    assert order == want


def test_each_rule_is_as_cheap_as_any_order_makes_it():
    # of two rules that reject alike the cheaper goes first; one whose rows are all rejected already goes last
    a, b, c = (rules.Rule(x, lambda f: None) for x in "abc")
    found = [((True, True, False), 10, [500.0, 100.0, 100.0]), ((False, False, True), 1, [50.0, 10.0, 10.0]), ((False, False, False), 20, [1000.0, 200.0, 200.0])]

    def cost(order):
        return sum(g[2]["abc".index(name)] for g in found for i, name in enumerate(order) if not any(g[0]["abc".index(x)] for x in order[:i]))

    got = "".join(r.name for r in rules.ordered(found, (a, b, c)))
    assert got == "bca" and cost(got) == min(cost(p) for p in itertools.permutations("abc"))


def test_the_sample_is_bounded_and_drawn_by_rows(spark):
    df = corpus(spark, copies=400)
    drawn = rules.drawn(df, ["doc_id", "text"], 100)
    share = drawn.where(F.col("text") == BAD[1]).count()
    assert drawn.count() == 100 and 60 <= share <= 95  # 400 of 487 rows are copies
    assert drawn.count() == rules.drawn(df.repartition(3), ["doc_id", "text"], 100).intersect(drawn).count()


def test_order_moves_no_verdict(spark):
    df = corpus(spark)
    known = rules.facts(rules.whole(F.col("text")))
    order = rules.ordered(measured(df))
    verdicts = [df.select("doc_id", rules.cascade(known, list(o)).isNull().alias("k")).orderBy("doc_id").collect() for o in (order, order[::-1])]
    assert verdicts[0] == verdicts[1]
    out = rules.judge(df)
    assert out.columns == [*df.columns, "failed_rule"] and out.where("failed_rule IS NULL").count() == sum(r["k"] for r in verdicts[0])


def test_nothing_repeats_and_no_good_row(spark):
    df = corpus(spark)
    assert rules.quality_rules(df.where("false")).count() == 0 and rules.judge(df.where("false")).count() == 0
    assert rules.quality_rules(df.where("text IS NULL OR text = ''")).where("kept OR NOT base_failed").count() == 0
    twice = rules.quality_rules(df.unionByName(df)).groupBy(*rules.quality_rules(df).columns).count()
    assert twice.count() == df.count() and twice.where("count <> 2").count() == 0
    short = spark.createDataFrame([(1, "few words")], "doc_id long, text string")
    assert [tuple(r)[-2:] for r in rules.quality_rules(short).collect()] == [(True, False)]
