import corpus_pipeline as p
import numpy as np

from tempora.llm import ngram_join, piece_codec
from tempora.llm.common import table

from .test_decontaminate import brute as brute_overlaps


def brute_groups(docs):
    """Smallest id of each group of documents that links join, by comparing all pairs."""
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, t in docs for w in [("".join(c.lower() if c.isascii() else c for c in t)).split()]}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)) and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    one = p.identify_languages(spark, docs, sf_dir)
    assert one.columns == docs.columns and one.count() >= 0.97 * docs.count()
    two = p.dedup_lines(spark, one, sf_dir)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    three = {r.doc_id for r in p.drop_near_copies(spark, two, sf_dir).collect()}
    groups = brute_groups(rows)
    assert three == {i for i, g in groups.items() if i == g}
    kept = [(i, t) for i, t in rows if i in three]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    bad = {i for i, _ in brute_overlaps(kept, items)}
    result = p.run(spark, sf_dir).collect()
    exact = {i for i, t in kept for _, u in items if u in t}
    assert three - bad <= {r.doc_id for r in result} <= three - exact
    v = piece_codec.Pieces.load(piece_codec.MODEL)
    texts = dict(kept)
    assert all(piece_codec.decode_ids(np.array(r.ids, dtype=int), v) == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in result)


def test_ngram_join_cases(spark):
    rows = [(1, "a b c d e f"), (2, "A  b c\td e f"), (3, "x y"), (4, "X\ny"), (5, ""), (6, None), (None, "a b c d e f"), (None, "q r s"), (7, "a b c d e f g"), (8, "w " * 60_000), (9, " \n "), (1, "a b c d e f"), (10, "W " * 40_000)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, component int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.link_groups(df).collect()), key=str)
    want = [(1, 2, 1), (2, 2, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (None, 2, 1), (None, 1, None), (7, 3, 7), (8, 1, 8), (9, 0, 9), (1, 2, 1), (10, 1, 8)]
    assert got == sorted(want, key=str)
    assert sorted(str(r.doc_id) for r in ngram_join.keep_one(df).collect()) == sorted(["1", "1", "3", "5", "6", "None", "None", "7", "8", "9"])
    assert ngram_join.link_groups(df.limit(0)).count() == 0


def test_many_near_copies_against_brute_force(spark):
    import random

    rnd = random.Random(4)
    base = [rnd.choice("abcdefghijklmnop") + str(rnd.randint(0, 99)) for _ in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(90)] = f"n{rnd.randint(0, 9999)}"
        rows.append((i, " ".join(w[: 90 - rnd.randint(0, 20)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link_groups(df).collect()} == brute_groups(rows)


def test_stages_take_nulls_repeats_and_empty_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    item = table(spark, sf_dir, "benchmark").first().text
    kind = docs.schema.simpleString()[len("struct<") : -1].replace(":", " ")
    prose = [r.text for r in docs.where("lang = 'en'").orderBy("doc_id").limit(3).collect()]
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (2, prose[0], None, None, None), (2, prose[0], None, None, None), (None, prose[1], "xx", "b", 5), (3, f"{prose[2]}\n{item}", "en", "c", 1), (4, "w " * 30_000, "en", "c", 1)], kind)
    for extra in (docs.limit(0), docs):
        rows = p.identify_languages(spark, odd.unionByName(extra), sf_dir)
        assert rows.columns == docs.columns
    kept = p.identify_languages(spark, odd.unionByName(docs), sf_dir).where("doc_id IS NULL OR doc_id < 5 AND source IN ('a', 'b', 'c')").collect()
    assert all(r.text for r in kept)
    two = p.dedup_lines(spark, odd, sf_dir)
    assert sorted((str(r.doc_id), r.text is None) for r in two.collect()) == sorted((str(r.doc_id), r.text is None) for r in odd.collect())
    three = p.drop_near_copies(spark, odd, sf_dir)
    assert three.columns == docs.columns and three.where("doc_id IS NULL").count() == 2 and three.where("doc_id = 2").count() == 2
    four = p.drop_contaminated(spark, odd, sf_dir)
    assert four.columns == docs.columns and sorted(str(r.doc_id) for r in four.collect()) == ["1", "2", "2", "4", "None", "None"]
    five = p.encode_pieces(spark, odd, sf_dir).collect()
    assert len(five) == 7 and [r.n_tokens for r in five if r.ids is None] in ([None], [-1]) and [r.n_tokens for r in five if r.doc_id == 1] == [0]
    for f in (p.dedup_lines, p.drop_near_copies, p.drop_contaminated, p.encode_pieces, p.identify_languages):
        assert f(spark, docs.limit(0), sf_dir).count() == 0
