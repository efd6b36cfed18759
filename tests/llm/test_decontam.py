import random

from pyspark.sql import functions as F

from ledgerloom.llm import template_decontam as D

from .helpers import documents

ITEM = "If Anna buys 12 apples for 3 dollars each and gives Anna 5 kg of flour how much does she pay in all today"


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def hits(spark, docs, items):
    return {(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, docs), bench(spark, items)).collect()}


def text(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def brute(docs, items):
    """Verbatim runs of lower-cased words of RUN or the whole item, of texts without numbers and names."""
    out = set()
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            need = min(D.RUN, len(v))
            grams = {tuple(v[k : k + need]) for k in range(len(v) - need + 1)} if v else set()
            if any(tuple(w[k : k + need]) in grams for k in range(len(w) - need + 1)):
                out.add((d, i))
    return out


def test_against_brute_force(spark):
    rng = random.Random(9)
    items = [(i, text(i, rng.choice([5, 8, 9, 12, 13, 14, 30, 60]))) for i in range(40)]
    docs = []
    for d in range(200):
        body = text(1000 + d, rng.randint(0, 80)).split()
        for _ in range(rng.randint(0, 2)):
            v = rng.choice(items)[1].split()
            lo = rng.randint(0, len(v) // 2)
            at = rng.randint(0, len(body))
            body[at:at] = v[lo : lo + rng.randint(1, len(v))]
        docs.append((d, " ".join(body)))
    got, want = hits(spark, docs, items), brute(docs, items)
    assert want and got == want


def test_reparameterised(spark):
    before = "some words come first and then "
    docs = [
        (1, before + ITEM), (2, before + ITEM.replace("12", "40").replace("3 ", "7 ").replace("5 kg", "2.5 lbs")), (3, before + ITEM.replace("Anna", "Boris")),
        (4, before + ITEM.replace("Anna", "Boris", 1)), (5, before + "if we talk of apples and flour then how much does she pay"), (6, before + ITEM.upper()),
    ]
    got = {r.doc_id: r for r in D.contaminated(documents(spark, docs), bench(spark, [(9, ITEM)])).collect()}
    assert {1, 2, 3} <= set(got) and 5 not in got
    assert got[1].n_changed == 0 and got[2].n_changed >= 3
    assert 4 not in got or got[4].run_words < 22  # Anna is Boris and Anna at once


def test_edges(spark):
    items = [(1, text(1, 30)), (2, text(1, 30)), (3, None), (4, ""), (None, text(2, 30)), (5, "12 34 56 78 90 12 34 56 78 90 12 34 56 78")]
    docs = [(1, None), (2, ""), (3, " \n "), (4, text(3, 50000) + " " + text(1, 30)), (None, text(1, 30)), (5, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15"), (6, text(1, 30)), (6, "other"), (7, text(2, 30))]
    assert hits(spark, docs, items) == {(4, 1), (6, 1)}
    assert hits(spark, [], items) == set() and hits(spark, docs, []) == set()
    clash = documents(spark, [(6, text(1, 30))])
    for name in ("words", "item_id", "hash", "shift", "window", "raw"):
        clash = clash.withColumn(name, F.lit(0))
    extra = bench(spark, [(1, text(1, 30))]).withColumn("doc_id", F.lit(3)).withColumn("words", F.lit(3))
    assert D.contaminated(clash, extra).count() == 1


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_ROWS", -1)
    assert hits(spark, [(1, text(7, 20) + " " + text(1, 20)), (2, text(8, 40))], [(3, text(1, 20))]) == {(1, 3)}


def test_native(spark):
    """No Python on the main path."""
    plan = D.contaminated(documents(spark, [(1, "a")]), bench(spark, [(1, ITEM)]))._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))


def test_verbatim_with_few_literals(spark):
    """Copies word for word count, whatever the words are and wherever the copy starts."""
    items = [(1, "What is 7 times 8?"), (2, "Add 12 and 15 and 18 and 21 and 24 and 27 and 30 and 33"), (3, "if a<b and b<c then a<c and x<y or not z<w so we stop"), (4, "we saw Anna Boris Carla David Emil Frieda Gustav Hanna Ida Jonas Karl Lena")]
    docs = [(10 * i + k, text(k, k) + " " + t + " " + text(k + 50, 4)) for i, t in items for k in range(7)]
    docs += [(100, text(1, 3) + " what is 9 times 6? " + text(2, 3)), (101, "add 1 and 2 and 3 and 4 and 5 and 6 and 7 and 8")]
    assert hits(spark, docs, items) == {(10 * i + k, i) for i, _ in items for k in range(7)}


def test_offset_does_not_matter(spark):
    """One literal-rich window in an exchanged passage is enough, at every place of the document."""
    item = "1 2 3 4 5 we count red apples and pears daily"
    docs = [(k, text(k, k) + " " + item.replace("1 2 3 4 5", "6 7 8 9 0")) for k in range(1, 8)]
    assert hits(spark, docs, [(1, item), (2, text(90, 20))]) == {(k, 1) for k in range(1, 8)}


def test_part_of_a_run_is_consistent(spark):
    """A slot that contradicts another cuts the run and does not reject it."""
    item = text(1, 13) + " 5 apples " + text(2, 25) + " 5 boxes " + text(3, 13)
    docs = [(1, item.replace("5 boxes", "7 boxes")), (2, "so " + item.replace("5 apples", "7 apples"))]
    short = "we give Anna 4 new red pens and Boris 6 and Anna 5"
    docs += [(3, "now " + short.replace("Anna", "Carla", 1)), (4, "now " + short.replace("Anna", "Carla"))]
    assert hits(spark, docs, [(1, item), (2, short)]) == {(1, 1), (2, 1), (4, 2)}


def test_first_word_and_white_space(spark):
    """The first word of an item may look like a name where it stands; line feeds are spaces."""
    items = [(1, "What is the capital of this old country?"), (2, "Maria buys 12 apples and gives Peter the whole lot"), (3, "then we ask Peter about the road to Berlin and the one to Hamburg over there")]
    docs = [(1, "they asked What is the capital of this old country? and left"), (2, "we saw, Clara buys 40 apples and gives Hans the whole lot of them"), (3, "then we ask\nPeter about the road to \r\n Berlin and the one to  Hamburg over there")]
    docs += [(4, docs[2][1].replace("Peter", "Clara"))]
    assert hits(spark, docs, items) == {(1, 1), (2, 2), (3, 3), (4, 3)}
