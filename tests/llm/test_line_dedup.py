import random
import struct

import xxhash

from tempora.llm import line_dedup
from tempora.llm.common import table


def brute(docs, gw=25, gl=3, rw=50, rl=4):
    """Line dedup in plain Python, over (id, text) rows in order of id."""
    lines = [[(p, x.strip(" ")) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")] for _, t in docs]

    def end(own, i, words, most):
        total = 0
        for e in range(i, min(i + most, len(own))):
            total += own[e][1].count(" ") + 1
            if total >= words or e - i + 1 == most:
                return e
        return None

    return lines, end


def guaranteed(docs, rw=50, rl=4):
    """(row, line places) of runs of a window's length that stand earlier as well: these must go."""
    lines, end = brute(docs)
    seen, must = set(), []
    for r, own in enumerate(lines):
        for i in range(len(own)):
            e = end(own, i, rw, rl)
            if e is not None:
                run = tuple(x for _, x in own[i : e + 1])
                if run in seen:
                    must.append((r, [p for p, _ in own[i : e + 1]]))
                seen.add(run)
    return must


def check(docs, out):
    first = {}
    for r, (_, t) in enumerate(docs):
        for p, x in enumerate((t or "").split("\n")):
            if x.strip(" "):
                first.setdefault(x.strip(" "), (r, p))
    left = {}
    for r, (_, t) in enumerate(docs):
        was, now = (t or "").split("\n"), (out[r] or "").split("\n")
        j, kept = 0, set()
        for p, x in enumerate(was):
            if j < len(now) and now[j] == x:
                kept.add(p)
                j += 1
        assert t in (None, "") or out[r] == "" or j == len(now)  # what stays is a subsequence
        left[r] = kept
    remaining = {x.strip(" ") for r in range(len(docs)) for x in (out[r] or "").split("\n")}
    assert all(x in remaining for x in first)  # the first copy of every line stays somewhere
    return left


def test_random_documents(spark):
    rnd = random.Random(5)
    line = lambda n: " ".join(rnd.choice("abcdefghij") * rnd.randint(1, 4) for _ in range(n))
    pool = [line(rnd.randint(1, 12)) for _ in range(300)]
    passages = [[line(60)], [line(5), line(6), line(7), line(8), line(9)], [line(30), "", line(31)]]
    docs = []
    for i in range(80):
        own = [rnd.choice(pool) for _ in range(rnd.randint(0, 12))]
        if i % 2:
            at = rnd.randint(0, len(own))
            own[at:at] = rnd.choice(passages)
        docs.append((i, "\n".join(own)))
    docs += [(80, None), (81, ""), (82, docs[3][1]), (83, "\n".join(passages[1] * 3)), (84, "\n".join(["word " * 30] * 300)), (85, "x" * 100_000), (86, "\n\n \n")]
    df = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, cuts string").coalesce(1)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert len(got) == len(docs) and all(r.cuts == "c" for r in got.values())
    out = [got[i].text for i, _ in docs]
    check(docs, out)
    for r, places in guaranteed(docs):
        lines = docs[r][1].split("\n")
        run = "\n".join(lines[places[0] : places[-1] + 1])
        assert run not in (out[r] or "") or docs[r][1].count(run) > 1, (r, run)
    assert out[80] is None and out[81] == "" and out[86] == "\n\n \n" and out[84] == "word " * 30 and out[85] == "x" * 100_000
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_query_deletes_only_repeats(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    out = {r.doc_id: r.text for r in line_dedup.query(spark, sf_dir).collect()}
    check(docs, [out[i] for i, _ in docs])
    assert any(out[i] != t for i, t in docs)


def test_repeated_windows_go_whole_whichever_copy_is_first(spark):
    rnd = random.Random(7)
    line = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n))
    run = [line(30) for _ in range(3)]
    texts = [f"{x}\n{line(20)}" for x in run] + ["\n".join(run)] * 2  # each line first stands alone, then the run stands twice
    frequent, others = [line(26) for _ in range(6)], [line(n) for n in (3, 9, 20, 28) for _ in range(5)]
    for _ in range(60):
        texts.append("\n".join(rnd.choice(rnd.choice([frequent, others])) for _ in range(rnd.randint(1, 12))))
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    check(docs, [out[i] for i, _ in docs])
    assert out[4] == ""
    must = {}
    for r, places in guaranteed(docs):
        must.setdefault(r, set()).update(places)
    for r, gone in must.items():
        rest = iter(x for p, x in enumerate(texts[r].split("\n")) if p not in gone)
        assert out[r] == "" or all(x in rest for x in out[r].split("\n")), r


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def folded(hashes):
    """Spark's xxhash64 of an array of longs."""
    h = 42
    for x in hashes:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return signed(h)


def dedup(docs, gw=25, gl=3, rw=50, rl=4):
    """The whole rule in plain Python: what stays of each text, over (id, text) rows in order."""
    lines, end = brute(docs)
    hashes = [[signed(xxhash.xxh64_intdigest(x.encode(), 42)) for _, x in own] for own in lines]
    places, windows = {}, {}
    for r, own in enumerate(lines):
        grams = [(e, folded(hashes[r][i : e + 1]) if e is not None else None) for i in range(len(own)) for e in [end(own, i, gw, gl)]]
        for i in range(len(own)):
            to = end(own, i, rw, rl)
            if to is not None:
                inside = [(grams[i + k][1], -(i + k)) for k in range(rl) if i + k < len(own) and grams[i + k][0] is not None and grams[i + k][0] <= to]
                places.setdefault(min(inside)[0], set()).add((r, -min(inside)[1]))
                windows.setdefault(tuple(x for _, x in own[i : to + 1]), []).append((r, i, to))
    gone = [set() for _ in docs]
    for found in places.values():
        (fr, fa), *rest = sorted(found)
        for r, at in rest:
            a = z = 0
            while min(at, fa) > a and lines[r][at - a - 1][1] == lines[fr][fa - a - 1][1]:
                a += 1
            while at + z < len(lines[r]) and fa + z < len(lines[fr]) and lines[r][at + z][1] == lines[fr][fa + z][1]:
                z += 1
            gone[r].update(range(lines[r][at - a][0], lines[r][at + z - 1][0] + 1))
    for found in windows.values():
        for r, i, to in sorted(found)[1:]:
            gone[r].update(range(lines[r][i][0], lines[r][to][0] + 1))
    return [t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if p not in g) for (_, t), g in zip(docs, gone, strict=True)]


def test_query_equals_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect())
    got = {r.doc_id: r.text for r in line_dedup.query(spark, sf_dir).collect()}
    assert [got[i] for i, _ in docs] == dedup(docs)


def test_later_copies_of_overlapping_passages_equal_brute_force(spark):
    rnd = random.Random(11)
    line = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=5)) for _ in range(n))
    texts = []
    for _ in range(60):  # a passage of one window in two documents, three of its lines in one before them
        run = [line(14) for _ in range(4)]
        texts += ["\n".join([*run[:3], line(14)]), "\n".join([line(9), *run]), "\n".join([*run, line(9)])]
    texts += ["\n".join(rnd.choice(texts).split("\n")[: rnd.randint(1, 6)] + [line(8)] + rnd.choice(texts).split("\n")) for _ in range(60)]
    long = [line(26) for _ in range(1_500)]
    texts += ["\n".join(long), "\n".join(x if i % 7 else line(26) for i, x in enumerate(long)), None, "", "\n \n"]
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row int, data int").repartition(5)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [out[i].text for i, _ in docs] == dedup(docs) and {(r.row, r.data) for r in out.values()} == {(1, 2)}
    assert all(x not in (out[i + 2].text or "").split("\n") for i in range(0, 180, 3) for x in texts[i + 1].split("\n")[1:])
