import random
import unicodedata

from tidemill.llm.contamination import leaked_items, registers_of, size_class, words_of


def brute(docs, items, run=12):
    out = set()
    for d, t in docs:
        words = words_of(t) if t else []
        have = {tuple(words[i : i + run]) for i in range(len(words) - run + 1)}
        for i, p in items:
            w = words_of(p) if p else []
            if any(tuple(w[k : k + run]) in have for k in range(len(w) - run + 1)):
                out.add((d, i))
    return out


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as passage")
    i = spark.createDataFrame(items, "item_id long, passage string").selectExpr("*", "'x' as text")
    return {(r.doc_id, r.item_id) for r in leaked_items(d, i).collect()}


def test_partitions():
    assert [registers_of(size_class(n)) for n in (12, 128, 511, 512, 2048, 4096)] == [2, 2, 2, 3, 4, 4]


def test_equals_brute_force(spark):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randrange(8, 50)))) for i in range(12)]
    docs = []
    for d in range(60):
        w = rng.choices(vocab, k=rng.randrange(0, 200))
        if d % 2:
            src = rng.choice(items)[1].split()
            at, n = rng.randrange(max(1, len(src) - 9)), rng.randrange(8, 26)
            where = rng.randrange(len(w) + 1)
            w[where:where] = src[at : at + n]
        docs.append((d, " ".join(w)))
    long = rng.choices(vocab, k=9000)
    long[4090:4090] = items[0][1].split() + items[3][1].split()
    docs.append((900, " ".join(long)))
    want = brute(docs, items)
    assert len(want) > 10
    assert run(spark, docs, items) == want


def test_writing_does_not_matter(spark):
    p = "In Herbst zählte Zellham am alten Wehr 108 Laternen, verkaufte 272 davon in Quillport und schwieg"
    forms = [
        p.upper(),
        unicodedata.normalize("NFD", p),
        p.replace(" ", "\n  "),
        "**In** *Herbst* <b>zählte</b> [Zellham](http://x.example) " + " — ".join(p.split()[3:]),
        '{"q": "' + p.replace("ä", "\\u00e4").replace(", ", ",\\n") + '"}',
        p.replace("Laternen", "Later­nen").replace("alten", "al​ten"),
    ]
    docs = list(enumerate(forms)) + [(90, " ".join(p.split()[:11])), (91, None), (92, ""), (93, p.replace("Wehr", "Tor"))]
    assert run(spark, docs, [(1, p), (2, None), (3, "short one")]) == {(i, 1) for i in range(len(forms))}


def test_repeated_rows_and_empty_tables(spark):
    p = " ".join(f"t{i}" for i in range(15))
    assert run(spark, [(1, p), (1, p)], [(5, p), (5, p)]) == {(1, 5)}
    assert run(spark, [], [(5, p)]) == set() and run(spark, [(1, p)], []) == set()
