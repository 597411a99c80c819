import random

import numpy as np
import pytest

from tempora.llm import piece_codec as c


@pytest.fixture(scope="module")
def pieces():
    return c.Pieces.load(c.MODEL)


def brute(text, v):
    """The best segmentation of a whole text by a plain table over its characters."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=c.MODEL)
    table = {m.id_to_piece(i): (m.get_score(i), i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
    s = (" " + text).replace("▁", "\x00").replace(" ", "▁")
    best = [(0.0, 0, None)] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for k in range(min(e, v.longest), 0, -1):
            p = s[e - k : e]
            score, i = table.get(p, (None, None))
            if i is None and k == 1:
                score = v.unknown
            if score is not None and (best[e] is None or best[e - k][0] + score > best[e][0]):
                best[e] = (best[e - k][0] + score, k, i)
    ids, e = [], len(s)
    while e:
        _, k, i = best[e]
        ids = ([i] if i is not None else [int(v.byte_ids[x]) for x in (s[e - 1] if s[e - 1] != "\x00" else "▁").encode()]) + ids
        e -= k
    return ids


def test_against_brute_force(pieces):
    rnd = random.Random(3)
    texts = ["Hello  world\nfoo é", "a▁b", "日本😀", " lead", "tail ", "x\n\n y"] + ["".join(rnd.choice("the of in er té\n ▁") for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    flat, at = c.encode_texts(texts, pieces)
    for i, t in enumerate(texts):
        assert flat[at[i] : at[i + 1]].tolist() == brute(t, pieces), t


def test_round_trip_and_cases(spark, pieces):
    texts = [None, "", " ", "\n", "plain words", "  two  blanks ", "▁", "x" * 60_000, "long text " * 20_000, "é😀", "plain words"]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)], "doc_id long, text string, t array<int>")
    out = c.decode(c.encode(df).withColumnRenamed("text", "was")).collect()
    assert all(r.text == r.was for r in out) and len(out) == len(texts)
    by = {r.doc_id: r for r in out}
    assert by[0].ids is None and by[1].ids == [] and by[4].ids == by[10].ids and by[0].t == [1]
    assert c.encode(df.limit(0)).count() == 0


def test_query_is_exact(spark, sf_dir):
    assert c.query(spark, sf_dir).where("NOT exact OR n_tokens <> size(ids)").count() == 0
    assert np.isfinite(c.Pieces.load(c.MODEL).scores).all()


def test_ids_that_are_no_pieces(spark, pieces):
    for bad in ([-1, -2], [5, len(pieces.texts)]):
        with pytest.raises(ValueError):
            c.decode_ids(np.array(bad), pieces)
    df = spark.createDataFrame([([259, None],), (None,), ([],)], "ids array<int>")
    assert [r.text for r in c.decode(df).collect()] == [None, None, ""]
